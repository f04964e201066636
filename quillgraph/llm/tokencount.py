"""Exact token counts by a histogram of encoded lengths.

Texts are encoded once, in Arrow batches; what is shuffled is (group, length,
documents), summed before the shuffle.  Suffix sums over the lengths then answer
totals, quantiles and truncated totals for every context limit without going back
to the texts.  The vocabulary's bytes (at most ``MOST_VOCABULARY``) are read on the
driver and travel with the function, so executors need no file.

Defined results: null and empty texts have length 0; special-token strings inside a
text are ordinary text; rows that repeat count each; a null group is a group; an
empty table gives an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm import common

#: Default vocabulary: a byte-level BPE of 50,256 ranks; the path is a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_VOCABULARY = 8 << 20
#: The byte-level BPE's public splitting pattern (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[int, object] = {}


def _encoder(blob: bytes, pattern: str):
    """The encoder of a vocabulary, built once a worker."""
    found = _encoders.get(hash((blob, pattern)))
    if found is None:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in blob.splitlines() if line)}
        found = _encoders[hash((blob, pattern))] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return found


def load_vocabulary(path: str = VOCABULARY) -> bytes:
    blob = Path(path).read_bytes()
    if len(blob) > MOST_VOCABULARY:
        raise ValueError(f"{path} has {len(blob)} bytes; at most {MOST_VOCABULARY} travel with a function")
    return blob


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, *, text_col: str = "text", length_col: str = "n_tokens") -> DataFrame:
    """All columns but the text, and the text's encoded length."""
    common.bound_batches(docs.sparkSession)
    blob = load_vocabulary(vocabulary)
    others = [c for c in docs.columns if c != text_col]
    schema = docs.select(*others, F.lit(0).cast("long").alias(length_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(blob, pattern)
        for batch in batches:
            lengths = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(lengths, pa.int64())], names=[*others, length_col])

    return docs.select(*others, text_col).mapInArrow(run, schema)


def histogram(docs: DataFrame, group_col: str = "lang", vocabulary: str = VOCABULARY, pattern: str = PATTERN, *, text_col: str = "text") -> DataFrame:
    """(group, n_tokens, n_docs): how many documents of each group have each length."""
    lengths = token_lengths(docs.select(F.col(group_col).alias("group"), F.col(text_col).alias("text")), vocabulary, pattern)
    return lengths.groupBy("group", "n_tokens").agg(F.count("*").alias("n_docs"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """For every group and length L of the histogram, the answers at context limit L.

    docs_over / tokens_over: documents longer than L and their tokens; truncated_total:
    tokens kept if every text is cut at L; docs_within: documents of at most L tokens;
    total_docs and total_tokens of the group.  A group's rows are its different
    lengths, whose number follows the longest text and not the corpus.
    """
    over = Window.partitionBy("group").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("group")
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = hist.withColumn("docs_over", F.coalesce(F.sum("n_docs").over(over), F.lit(0))).withColumn("tokens_over", F.coalesce(F.sum(tokens).over(over), F.lit(0)))
    out = out.withColumn("total_docs", F.sum("n_docs").over(every)).withColumn("total_tokens", F.sum(tokens).over(every))
    out = out.withColumn("docs_within", F.col("total_docs") - F.col("docs_over"))
    return out.withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens"))


def quantiles(sums: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(group, share, n_tokens): the smallest length that at least this share of the documents does not exceed."""
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return sums.select("group", "n_tokens", "docs_within", "total_docs", wanted).where(F.col("docs_within") >= F.col("share") * F.col("total_docs")).groupBy("group", "share").agg(F.min("n_tokens").alias("n_tokens"))


def truncated_totals(sums: DataFrame, limits: tuple[int, ...]) -> DataFrame:
    """(group, limit, truncated_total, docs_over) for any limits, lengths of the histogram or not.

    The largest length up to the limit has the answer; documents above it add the
    limit each.  A limit below every length has none: all documents are above.
    """
    wanted = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit")
    at = sums.select("*", wanted).groupBy("group", "limit").agg(
        F.max_by(F.struct("docs_over", "tokens_over"), F.when(F.col("n_tokens") <= F.col("limit"), F.col("n_tokens"))).alias("found"),
        F.first("total_docs").alias("total_docs"),
        F.first("total_tokens").alias("total_tokens"),
    )
    docs_over = F.coalesce("found.docs_over", "total_docs")
    return at.select("group", "limit", (F.col("total_tokens") - F.coalesce("found.tokens_over", "total_tokens") + docs_over * F.col("limit")).alias("truncated_total"), docs_over.alias("docs_over"))
