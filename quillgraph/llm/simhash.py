"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are taken from the whole text.  Equal fingerprints are one row from
then on.  Two fingerprints within the radius agree on enough of a few blocks of
bits; each choice of agreeing blocks is a table, and rows with one table's key are
compared.  For radius 2 the 64 bits form 4 blocks of 16 of which 2 agree, and the
rest 3 blocks of which 1 agrees: 18 tables with keys of 42 bits or more.  What can
meet under one key is therefore bounded by the bits that are left (2**22 different
fingerprints, 32 MB), and groups above ``SPLIT`` are parted once more by what is
left, so no data can make a task's memory grow.

Compared groups are stored as bit planes: word p of a 64-lane block holds bit p of
64 fingerprints.  A query fingerprint is compared with all lanes of a block at
once: its planes are XORed and added to carry-save counters (ones, twos, fours ...),
and blocks whose lanes have all passed the radius are left early.  Links are folded
into a union-find inside the task; only spanning links leave it, never all pairs.

``near_duplicates`` works at a stated radius of 64-bit fingerprints and is exact.
``similar`` works at a stated Jaccard similarity of shingle sets.  What can be alike
meets under a band of MinHash values; there 256-bit SimHashes are compared bit by bit
plane in the same way, at a radius six deviations above the mean distance of a pair at
the threshold; pairs within it are verified on the whole sets, and only verified pairs
link.  Stars inside few bands join large groups first; then every pair of texts that
shares any band and is not joined yet is compared, so nothing hangs on a link that
verification refused.  Keys that more than ``CROWD`` texts share are compared in later
passes, whose rows also carry the low bytes of all MinHash values: where many texts are
alike but below the threshold, the SimHash lets most pairs through, and the share of
equal values, at four deviations below the threshold, keeps few of them.  There each text
is verified against its nearest partner first, and then only pairs that these links leave
in different groups are listed, each under the first key that it shares.  A key of more than ``LARGE`` rows is met tile by tile: its rows
are parted by hash and each two parts are compared in a task of their own, so a task
holds ``LARGE`` rows of a key or so and no pair is left out.

Defined results: null text is empty; no words give fingerprint zero, linked like
any other; fewer words than a shingle make one shingle; rows that repeat share the
fingerprint and so the component; a null id has no say in the smallest id, and a
component of null ids only has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common
from quillgraph.llm.components import components

SHINGLE = 3
RADIUS = 2
SPLIT = 4096
_TILE = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as an unsigned number."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    stops = ends[words - 1 :] if len(found) >= words else ends[-1:]
    pieces = map(joined.__getitem__, map(slice, starts[:n].tolist(), stops.tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = hashes[i : i + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    common.bound_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), n)]


def _mask(bits: list[int]) -> int:
    out = sum(1 << b for b in bits)
    return out - (1 << 64) if out >> 63 else out


def tables(radius: int = RADIUS) -> list[int]:
    """Masks of the bits that must agree.  Any two fingerprints within the radius agree under one of them at least.

    ``radius + 2`` blocks, of which two agree whole; then the differing bits lie in
    the other blocks, whose bits form ``radius + 1`` blocks of which one agrees.
    """
    every = list(range(64))
    out = []
    for pair in combinations(_blocks(every, radius + 2), 2):
        held = [b for block in pair for b in block]
        for more in _blocks([b for b in every if b not in held], radius + 1):
            out.append(_mask(held + more))
    return out


class _Union:
    """Union-find over rows of a batch, on whole arrays."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
            self.root = root
        self.root = root


def _bit(fps: np.ndarray, p: int) -> np.ndarray:
    return (fps[:, p >> 6] >> np.uint64(p & 63)) & np.uint64(1)


def _within(planes: list[np.ndarray], queries: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (query q, lane block w): those with a lane inside the radius, and the lanes as a bit mask."""
    n_counters = radius.bit_length()
    counters = [np.zeros(len(q), np.uint64) for _ in range(n_counters)]
    over = np.zeros(len(q), np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for p in range(len(planes)):
        carry = planes[p][w] ^ (np.uint64(0) - _bit(queries, p)[q])
        for k in range(n_counters):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 8 == 7:
            # Lanes above the radius: the counter's value compared with the radius, bit by bit from the top.
            above, equal = np.zeros(len(q), np.uint64), np.full(len(q), full)
            for k in reversed(range(n_counters)):
                if radius >> k & 1:
                    equal = equal & counters[k]
                else:
                    above |= equal & counters[k]
                    equal = equal & ~counters[k]
            over |= above
            alive = over != full
            if not alive.all():
                q, w, over = q[alive], w[alive], over[alive]
                counters = [c[alive] for c in counters]
                if not len(q):
                    break
    return q, w, ~over


def _close_pairs(fps: np.ndarray, starts: np.ndarray, asking: np.ndarray, radius: int, needed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, other) of one run within the radius: each asking row with the rows of its lane block and the later blocks.

    ``needed(q, w, heads)`` says which of the comparisons of row q with lane block w
    have to be made; a block's rows begin at ``heads[w]``.
    """
    n = len(fps)
    sizes = np.diff(np.append(starts, n))
    run = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(n) - starts[run]
    n_blocks = (sizes + 63) // 64
    first_block = np.concatenate(([0], np.cumsum(n_blocks)))[:-1]
    block = first_block[run] + place // 64
    lane = (place % 64).astype(np.uint64)
    heads = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    planes = [np.bitwise_or.reduceat(_bit(fps, p) << lane, heads) for p in range(64 * fps.shape[1])]
    width = np.diff(np.append(heads, n)).astype(np.uint64)
    valid = np.where(width >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (width % np.uint64(64))) - np.uint64(1))
    todo = (n_blocks[run] - place // 64)[asking]
    ends = np.cumsum(todo)
    at = 0
    while at < len(asking):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TILE, side="right")))
        q = np.repeat(asking[at:stop], todo[at:stop])
        w = block[q] + (np.arange(len(q)) - np.repeat(np.cumsum(todo[at:stop]) - todo[at:stop], todo[at:stop]))
        need = needed(q, w, heads)
        q, w, lanes = _within(planes, fps, q[need], w[need], radius)
        lanes = lanes & valid[w]
        while len(q):
            some = lanes != 0
            q, w, lanes = q[some], w[some], lanes[some]
            if not len(q):
                break
            lowest = lanes & (~lanes + np.uint64(1))
            yield q, heads[w] + np.log2(lowest.astype(np.float64)).astype(np.int64)
            lanes = lanes ^ lowest
        at = stop


def link(fps: np.ndarray, starts: np.ndarray, radius: int, union: _Union) -> None:
    """Join the rows of each run (given by its start) that lie within the radius of each other."""

    def needed(q: np.ndarray, w: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Blocks whose rows are all joined with the query already need no comparison."""
        low, high = np.minimum.reduceat(union.root, heads), np.maximum.reduceat(union.root, heads)
        mine = union.root[q]
        return (low[w] != mine) | (high[w] != mine)

    for q, other in _close_pairs(fps, starts, np.arange(len(fps)), radius, needed):
        union.join(q, other)


def _link_large(fps: np.ndarray, rows: np.ndarray, ways, radius: int, union: _Union, split: int = SPLIT, depth: int = 0) -> None:
    """A run above ``split``: part it by more bits in each of ``ways(depth)`` and compare inside the parts."""
    for held in ways(depth):
        part = fps[rows] & held
        order = np.lexsort(part.T)
        inner, part = rows[order], part[order]
        cuts = np.append(np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]).any(axis=1)))), len(inner))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if e - s < 2:
                continue
            if e - s > split and ways(depth + 1):
                _link_large(fps, inner[s:e], ways, radius, union, split, depth + 1)
                continue
            local = _Union(e - s)
            link(fps[inner[s:e]], np.array([0]), radius, local)
            joined = np.flatnonzero(local.root != np.arange(e - s))
            union.join(inner[s:e][joined], inner[s:e][local.root[joined]])


def _exact_ways(mask: int, radius: int):
    """Ways to part a run whose bits under ``mask`` agree that lose no pair: blocks of the other bits, one more than may differ."""

    def ways(depth: int) -> list[np.ndarray]:
        free = [b for b in range(64) if not mask >> b & 1]
        if depth or len(free) <= 3 * (radius + 1):
            return []
        return [np.array([sum(1 << b for b in bits)], np.uint64) for bits in _blocks(free, radius + 1)]

    return lambda depth: ways(depth) or ([np.zeros(1, np.uint64)] if depth == 0 else [])


def _compare(radius: int, ways_of, split: int, own_ids: bool):
    """mapInArrow function over rows (t, key, [node,] fp words) sorted by (t, key): spanning links (a, b) of nodes.

    Without nodes of their own, rows are named by their first fingerprint word.
    """

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        t, key, nodes = columns[:3]
        fps = np.stack(columns[3 if own_ids else 2 :], axis=1).astype(np.uint64)
        heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (t[1:] != t[:-1]))))
        sizes = np.diff(np.append(heads, len(fps)))
        union = _Union(len(fps))
        for h, s in zip(heads[sizes > split], sizes[sizes > split], strict=True):
            _link_large(fps, np.arange(h, h + s), ways_of(int(t[h])), radius, union, split)
        kept = (sizes >= 2) & (sizes <= split)
        rows = np.flatnonzero(np.repeat(kept, sizes))
        if len(rows):
            local = _Union(len(rows))
            link(fps[rows], np.concatenate(([0], np.cumsum(sizes[kept])[:-1])).astype(np.int64), radius, local)
            joined = np.flatnonzero(local.root != np.arange(len(rows)))
            union.join(rows[joined], rows[local.root[joined]])
        out = np.flatnonzero(union.root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[union.root[out]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            if not len(now[0]):
                continue
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            # The last run may go on in the next batch.
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                yield links([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield links(held)

    return run


def linked(distinct_fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Spanning links (a, b) of different fingerprints (column fp) at ``radius`` or fewer differing bits."""
    common.bound_batches(distinct_fps.sparkSession)
    masks = tables(radius)
    keyed = distinct_fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("t", "key"))
    dealt = keyed.select(F.col("t").cast("int").alias("t"), "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(_compare(radius, lambda t: _exact_ways(masks[t] % (1 << 64), radius), split, False), "a long, b long")


def _heads(labels: DataFrame, firsts: DataFrame) -> DataFrame:
    """(node, head, linked): the smallest ``first`` of each linked node's component.

    The smallest values are written before they meet the nodes again, so a component
    with very many nodes is a skewed join, which Spark can split, and not one task.
    """
    labels = labels.join(firsts, "node")
    least = common.written(labels.groupBy("label").agg(F.min("first").alias("head")), "component-heads")
    return labels.select("node", "label").join(least, "label").select("node", "head", F.lit(True).alias("linked"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, itself included."""
    prints = common.written(fingerprints(docs, words, id_col=id_col, text_col=text_col), "simhash-fps")
    firsts = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    heads = _heads(components(linked(firsts.select("fp"), radius)), firsts.select(F.col("fp").alias("node"), F.col("first_id").alias("first")))
    component = F.when(F.col("linked"), F.col("head")).otherwise(F.col("first_id"))
    classes = common.written(firsts.join(heads.withColumnRenamed("node", "fp"), "fp", "left").select("fp", component.alias("component_id")), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


# -- similarity of shingle sets -------------------------------------------------------

SIMILARITY = 0.8
SIMILAR_SHINGLE = 5
#: Bands and the minima a band holds: a pair at 0.8 shares no band in 5 of a million cases, at any size of the input.
BANDS, MINIMA = 40, 6
#: The bands by which groups of copies are found before all pairs are listed.
FIRST_BANDS = 3
#: 64-bit words of the stage's SimHash, and the deviations that its radius lies above the mean.
WIDE, DEVIATIONS = 4, 6
#: Rows of one key from which their MinHash values are compared too, and the deviations below the similarity at which they are.
CROWD, BELOW = 16, 4
#: Rows of one key that a task compares at once, and one of how many nodes is looked at to find the keys with more.
LARGE, LOOKED_AT = 1 << 17, 1024


def similar_radius(similarity: float = SIMILARITY) -> int:
    """Differing bits that a pair at the similarity stays below, by ``DEVIATIONS`` of the binomial distance."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * WIDE
    return min(bits - 1, round(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share))))


_SALTS = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """The SimHash of a set of hashes as ``WIDE`` signed words; an empty set gives zeros."""
    counts = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(hashes), 1 << 12):
        mixed = (hashes[i : i + (1 << 12), None] ^ _SALTS) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64).tolist()


def shingle_set(text: str | None, words: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; no words give none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    stops = ends[words - 1 :] if len(found) >= words else ends[-1:]
    pieces = map(joined.__getitem__, map(slice, starts[:n].tolist(), stops.tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, n))


def _permutations(seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    factors, shifts = rng.integers(0, 1 << 32, (2, BANDS * MINIMA), dtype=np.uint32)
    return factors | np.uint32(1), shifts


def minima(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set."""
    factors, shifts = _permutations()
    low = hashes.astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 256):
        np.minimum(least, (low[i : i + 256, None] * factors + shifts).min(axis=0), out=least)
    return least


def _keys_of(least: np.ndarray) -> list[int]:
    data = least.tobytes()
    step = 4 * MINIMA
    return np.array([xxhash.xxh3_64_intdigest(data[i : i + step]) for i in range(0, len(data), step)], np.uint64).astype(np.int64).tolist()


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of a set's MinHash."""
    return _keys_of(minima(hashes))


def least_agreeing(similarity: float = SIMILARITY) -> int:
    """How many of the MinHash values of a pair at the similarity agree at least, by ``BELOW`` deviations."""
    n = BANDS * MINIMA
    return math.floor(n * similarity - BELOW * math.sqrt(n * similarity * (1 - similarity)))


def _runs(batches: Iterator[pa.RecordBatch], pairs, crowd: int | None = None) -> Iterator[pa.RecordBatch]:
    """``pairs`` of the runs of rows (t, key, node, n, label, ...) sorted by (t, key); runs of one row are left out.

    With ``crowd``, runs of more rows than that and of several labels are not paired;
    their (t, key) come out as rows of kind 1, beside the pairs, of kind 0.
    """

    def made(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
        if crowd is None:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))], names=["a", "b", "kind"])

    held: list[np.ndarray] | None = None
    for batch in chain(batches, [None]):
        if batch is not None:
            now = [np.asarray(c) for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if held is None or not len(held[0]):
            continue
        t, key = held[:2]
        heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (t[1:] != t[:-1]))))
        # The last run may go on in the next batch.
        end = len(t) if batch is None else int(heads[-1])
        sizes = np.diff(np.append(heads, len(t)))[: len(heads) - (batch is not None)]
        taken = sizes > 1
        if crowd is not None and end:
            label, starts = held[4][:end], heads[: len(sizes)]
            full = (sizes > crowd) & (np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts))
            if full.any():
                yield made(t[starts[full]], key[starts[full]], 1)
            taken &= sizes <= crowd
        rows = np.flatnonzero(np.repeat(taken, sizes))
        sizes = sizes[taken]
        if len(rows):
            for a, b in pairs((np.cumsum(sizes) - sizes).astype(np.int64), t[rows] % 64, *(x[rows] for x in held[2:])):
                yield made(a, b, 0)
        held = [x[end:] for x in held]


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(a, b), np.minimum(a, b)


def _star_pairs(similarity: float):
    """Each row of a run sorted by size with the first one that is large enough."""

    def pairs(starts: np.ndarray, _bands: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, *_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        heads = np.repeat(starts, np.diff(np.append(starts, len(nodes))))
        todo = np.arange(len(nodes))
        while len(todo):
            # Rows too large for their star's head begin another star, run by run.
            fits = sizes[heads[todo]] >= similarity * sizes[todo] - 1e-9
            mine = todo[fits & (todo != heads[todo])]
            if len(mine):
                yield nodes[mine], nodes[heads[mine]]
            todo = todo[~fits]
            if len(todo):
                run = np.searchsorted(starts, todo, side="right")
                first = np.concatenate(([True], run[1:] != run[:-1]))
                heads[todo] = todo[first][np.cumsum(first) - 1]

    return pairs


def _cross_pairs(similarity: float, radius: int | None = None, agreeing: int | None = None, nearest: bool = False):
    """Pairs of a run that are not of one label, whose sizes allow the similarity and whose SimHashes lie within the radius.

    Without a radius, no SimHash is looked at.  Rows are (node, size, label, side, SimHash words);
    in a tile of two parts of a run (sides 1 and 2) only rows of different sides are paired.
    With ``agreeing``, the last columns hold the low bytes of the MinHash values, of which so many have to agree,
    and the keys of all bands: a pair comes out under the first band whose key it shares, and under no other.
    With ``nearest``, only the pair of each row of a run and the partner that agrees with it in most values comes out.
    """

    def pairs(starts: np.ndarray, bands: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, labels: np.ndarray, side: np.ndarray | None = None, *words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        side = np.zeros(len(nodes), np.int64) if side is None else side
        values, keys = np.zeros((len(nodes), 0), np.uint8), np.zeros((len(nodes), 0), np.int64)
        if agreeing is not None:
            values = np.frombuffer(b"".join(words[-2]), np.uint8).reshape(len(nodes), -1)
            keys = np.stack(words[-1])
            words = words[:-2]
        fps = np.stack(words, axis=1).astype(np.uint64) if words else np.zeros((len(nodes), 1), np.uint64)
        # Runs of one label have nothing to pair.
        mixed = np.minimum.reduceat(labels, starts) != np.maximum.reduceat(labels, starts)
        if not mixed.any():
            return
        lengths = np.diff(np.append(starts, len(nodes)))
        rows = np.flatnonzero(np.repeat(mixed, lengths))
        lengths = lengths[mixed]
        starts = np.cumsum(lengths) - lengths
        bands, nodes, sizes, labels, side, fps, values, keys = (x[rows] for x in (bands, nodes, sizes, labels, side, fps, values, keys))
        run = np.repeat(np.arange(len(starts)), lengths)
        # Rows of a run's largest label come last and are asked, but do not ask.
        order = np.lexsort((labels, run))
        first = np.concatenate(([True], (labels[order][1:] != labels[order][:-1]) | (run[order][1:] != run[order][:-1])))
        group = np.empty(len(nodes), np.int64)
        group[order] = np.cumsum(first) - 1
        counts = np.bincount(group)
        largest = np.maximum.reduceat(counts[group], starts)
        tops = np.full(len(starts), len(counts))
        np.minimum.at(tops, run, np.where(counts[group] == largest[run], group, len(counts)))
        major = group == tops[run]
        order = np.lexsort((nodes, sizes, major, run))
        bands, nodes, sizes, labels, side, fps, values, keys, major = (x[order] for x in (bands, nodes, sizes, labels, side, fps, values, keys, major))
        # The partner that agrees in most values, below the number of values that agree.
        best = np.zeros(len(nodes), np.int64)

        def needed(q: np.ndarray, w: np.ndarray, heads: np.ndarray) -> np.ndarray:
            least, most = np.minimum.reduceat(sizes, heads), np.maximum.reduceat(sizes, heads)
            low, high = np.minimum.reduceat(labels, heads), np.maximum.reduceat(labels, heads)
            sized = (least[w] * similarity <= sizes[q] + 1e-9) & (most[w] >= similarity * sizes[q] - 1e-9)
            return sized & ((low[w] != labels[q]) | (high[w] != labels[q]))

        reach = 64 * fps.shape[1] if radius is None else radius
        for q, w in _close_pairs(fps, starts, np.flatnonzero(~major), reach, needed):
            small, large = np.minimum(sizes[q], sizes[w]), np.maximum(sizes[q], sizes[w])
            good = (q < w) & (labels[q] != labels[w]) & (small >= similarity * large - 1e-9) & ((side[q] == 0) | (side[q] != side[w]))
            q, w = q[good], w[good]
            for i in range(0, len(q) if agreeing is not None else 0, 4096):
                mine, other = q[i : i + 4096], w[i : i + 4096]
                alike = (values[mine] == values[other]).sum(axis=1)
                mine, other, alike = (x[alike >= agreeing] for x in (mine, other, alike))
                if nearest:
                    np.maximum.at(best, mine, alike << 32 | other)
                    np.maximum.at(best, other, alike << 32 | mine)
                    continue
                first = (keys[mine] == keys[other]).argmax(axis=1) == bands[mine]
                if first.any():
                    yield _ordered(nodes[mine[first]], nodes[other[first]])
            if agreeing is None and len(q):
                yield _ordered(nodes[q], nodes[w])
        if nearest and best.any():
            rows = np.flatnonzero(best)
            yield _ordered(nodes[rows], nodes[best[rows] & 0xFFFFFFFF])

    return pairs


def _dealt(nodes: DataFrame, bands: int, crowded: DataFrame | None = None, large: int = LARGE, looked_at: int = LOOKED_AT) -> DataFrame:
    """Rows (t, key, node, n, label, side, SimHash words) of nodes under each band's key, large keys parted into tiles.

    With ``crowded`` keys (t, key), only rows under these, which also hold their MinHash values and all their keys.

    Which keys are large is judged by one of ``looked_at`` nodes, chosen by hash.  Tiles
    change where pairs meet, never which: a key that is not found only makes a task hold more.
    """
    wide = [f"f{i}" for i in range(WIDE)]
    keyed = nodes.select("node", "n", "label", *wide, *(["low", "keys"] if crowded is not None else []), F.posexplode(F.slice("keys", 1, bands)).alias("t", "key"))
    if crowded is not None:
        wide = [*wide, "low", "keys"]
        keyed = keyed.join(F.broadcast(crowded) if common.small_enough(crowded.count(), 32) else crowded, ["t", "key"], "left_semi")
    some = nodes.where(F.pmod(F.xxhash64(F.lit(11), F.col("node")), F.lit(looked_at)) == 0).select(F.posexplode(F.slice("keys", 1, bands)).alias("t", "key"))
    parts = (F.ceil(F.col("seen") * (2.0 * looked_at / large)) + 1).cast("int").alias("parts")
    heavy = common.written(some.groupBy("t", "key").agg(F.count("*").alias("seen")).where(F.col("seen") * looked_at * 2 >= large).select("t", "key", parts), "similar-heavy")
    found = heavy.count()
    if not found:
        return keyed.select(F.col("t").cast("long").alias("t"), "key", "node", "n", "label", F.lit(0).cast("long").alias("side"), *wide)
    met = keyed.join(F.broadcast(heavy) if common.small_enough(found, 32) else heavy, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64(F.lit(12), F.col("node")), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).cast("long")
    return met.select((F.col("t") + tile.cast("long") * 64).alias("t"), "key", "node", "n", "label", side.alias("side"), *wide)


def _met(nodes: DataFrame, bands: int, crowded: DataFrame | None = None, whole: bool = True) -> DataFrame:
    # Rows of crowded keys are four times as wide.
    dealt = _dealt(nodes, bands, crowded, LARGE if crowded is None else LARGE // 4)
    return (dealt if whole else dealt.where("side = 0")).repartition("t", "key").sortWithinPartitions("t", "key", "n", "node")


def _stars(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of each node and the head of its star under the first bands."""
    pairs = _star_pairs(similarity)
    met = _met(nodes, FIRST_BANDS, whole=False)
    return common.written(met.mapInArrow(lambda batches: _runs(batches, pairs), "a long, b long").distinct(), "similar-stars")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs of row keys (a, b) whose texts (row_key, text) have the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).astype(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    needed = pairs.select(F.col("a").alias("row_key")).unionByName(pairs.select(F.col("b").alias("row_key"))).distinct()
    if common.small_enough(needed.count(), 16):
        needed = F.broadcast(needed)
    sets = common.written(texts.join(needed, "row_key", "left_semi").dropDuplicates(["row_key"]).mapInArrow(run, "node long, shingles array<long>"), "similar-sets")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")).hint("merge")
    shared = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where((1 + similarity) * shared + 1e-9 >= similarity * (F.size("sa") + F.size("sb")))
    return common.written(met.select("a", "b"), "similar-links")


def _links(nodes: DataFrame, stars: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Verified pairs (a, b) of nodes (node, n, keys, low, f0, ...) that join, with those of ``stars``, all that have the similarity.

    Under crowded keys each text meets its nearest partner first.  What these pairs and
    the stars join is one label from then on, and only pairs of different labels are
    listed in full, so texts that hang together in one group are not listed against each other.
    """
    radius, agreeing = similar_radius(similarity), least_agreeing(similarity)
    few = _cross_pairs(similarity, radius)
    one, many = _cross_pairs(similarity, radius, agreeing, nearest=True), _cross_pairs(similarity, radius, agreeing)
    labelled = _labelled(nodes, components(stars))
    found = _met(labelled, BANDS).mapInArrow(lambda batches: _runs(batches, few, CROWD), "a long, b long, kind int")
    found = common.written(found.distinct(), "similar-pairs")
    pairs = found.where("kind = 0").select("a", "b")
    # A tile's number is left out again: the later passes part large keys anew.
    crowded = common.written(found.where("kind = 1").select((F.col("a") % 64).cast("int").alias("t"), F.col("b").alias("key")).distinct(), "similar-crowded")
    if not crowded.limit(1).count():
        return _verified(pairs, texts, words, similarity)
    nearest = _met(labelled, BANDS, crowded).mapInArrow(lambda batches: _runs(batches, one), "a long, b long")
    links = _verified(common.written(pairs.unionByName(nearest).distinct(), "similar-nearest"), texts, words, similarity)
    labelled = _labelled(nodes, components(stars.unionByName(links)))
    rest = _met(labelled, BANDS, crowded).mapInArrow(lambda batches: _runs(batches, many), "a long, b long")
    # Two texts share one first key and, there, one tile: no pair is listed twice.
    return links.unionByName(_verified(common.written(rest, "similar-rest"), texts, words, similarity))


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes with the label of their component, or their own number where they have no link."""
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def similar(docs: DataFrame, words: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, id, first_id, first_key): each row and the first row of its group of similar texts, by id and row key.

    A null id comes after all others.  Rows with equal id and text share a row key.
    Every link is a pair whose shingle sets were compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(2)]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
            least = [minima(x) for x in sets]
            made = [pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(x) for x in sets], pa.int64()), pa.array([_keys_of(x) for x in least], pa.list_(pa.int64())), pa.array([x.astype(np.uint8).tobytes() for x in least], pa.binary())]
            prints = np.array([wide_fingerprint(x) for x in sets], np.int64).reshape(-1, WIDE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, *(pa.array(prints[:, i]) for i in range(WIDE))], names=["row_key", "id", "s1", "s2", "n", "keys", "low", *wide])

    common.bound_batches(docs.sparkSession)
    names, wide = ["s1", "s2"], [f"f{i}" for i in range(WIDE)]
    picked = docs.select(common.row_key(id_col, text_col).alias("row_key"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(text_col).alias("text"))
    prints = common.written(picked.mapInArrow(run, "row_key long, id long, s1 long, s2 long, n long, keys array<long>, low binary, " + ", ".join(f"{x} long" for x in wide)), "similar-prints")
    firsts = prints.groupBy(*names).agg(F.min(F.struct("id", "row_key")).alias("first"), *[F.any_value(x).alias(x) for x in ("n", "keys", "low", *wide)])
    firsts = common.written(firsts.select("first", F.col("first.row_key").alias("node"), *names, "n", "keys", "low", *wide), "similar-distinct")
    texts = picked.select("row_key", "text")
    # Large groups of copies are joined by few pairs first, so that what is listed in full is between groups.
    stars = _verified(_stars(firsts.withColumn("label", F.col("node")), similarity), texts, words, similarity)
    rest = _links(firsts.select("node", "n", "keys", "low", *wide), stars, texts, words, similarity)
    heads = _heads(components(stars.unionByName(rest)), firsts.select("node", "first"))
    head = F.when(F.col("linked"), F.col("head")).otherwise(F.col("first"))
    classes = common.written(firsts.join(heads, "node", "left").select(*names, head["id"].alias("first_id"), head["row_key"].alias("first_key")), "similar-classes")
    return prints.join(classes, names).select("row_key", "id", "first_id", "first_key")


def representatives(docs: DataFrame, words: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts: that with the smallest id.  Of rows that repeat, one stays."""
    name = "__row_key"
    while name in docs.columns:
        name += "_"
    groups = similar(docs, words, similarity, id_col=id_col, text_col=text_col)
    marks = groups.groupBy(F.col("row_key").alias(name)).agg(F.bool_or(F.col("row_key") != F.col("first_key")).alias("gone"), F.count("*").alias("n"))
    marks = common.written(marks.where("gone or n > 1"), "similar-marks")
    gone = marks.where("gone").select(name)
    if common.small_enough(gone.count(), 16):
        gone = F.broadcast(gone)
    kept = docs.withColumn(name, common.row_key(id_col, text_col)).join(gone, name, "left_anti")
    repeats = marks.where("not gone").limit(1).count()
    return (kept.dropDuplicates([name]) if repeats else kept).drop(name)


def rendered(fp) -> object:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
