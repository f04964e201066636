"""Splitting texts at meaningful boundaries.

All splitters are made of two moves: ``pack`` joins neighbouring pieces while they
fit, ``framed`` repeats a head and a tail around groups of rows.  They run in Arrow
batches through ``chunked``, a task at a time and without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.shipping import ship

SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+")
PROTECTED = (
    re.compile(r"```[\s\S]*?```|~~~[\s\S]*?~~~"),
    re.compile(r"<table\b[^>]*>.*?</table>", re.S | re.I),
    re.compile(r"(?:^[ \t]*\|.*(?:\r?\n|$))+", re.M),
)
BLOCK_CHARS = 6000
CHAPTER_CHARS = 10000


def hard_cut(text: str, most: int) -> list[str]:
    return [text[i : i + most] for i in range(0, len(text), most)]


def pack(pieces: list[str], most: int, glue: str, glue_counts: bool = True) -> list[str]:
    """Join neighbours by ``glue`` while the sum stays within ``most``; blank pieces drop."""
    groups: list[list[str]] = []
    size = 0
    for piece in filter(None, map(str.strip, pieces)):
        cost = len(piece) + (len(glue) if glue_counts else 0)
        if groups and size + cost <= most:
            groups[-1].append(piece)
            size += cost
        else:
            groups.append([piece])
            size = len(piece)
    return [glue.join(g) for g in groups]


def framed(rows: list[str], head: str, tail: str, most: int, reserve: int = 0) -> list[str]:
    """Groups of rows, each between head and tail, while head, rows and ``reserve`` fit."""
    out, body, size = [], [], len(head)
    for row in rows:
        if body and size + len(row) + reserve > most:
            out.append(head + "".join(body) + tail)
            body, size = [], len(head)
        body.append(row)
        size += len(row)
    return [*out, head + "".join(body) + tail]


def split_code(text: str, most: int) -> list[str]:
    """A fenced block cut at blank lines, fences repeated (C4)."""
    m = re.match(r"(?:```|~~~)[^\n]*\n", text)
    head = m[0] if m else "```\n"
    tail = head[:3]
    parts = re.split(r"\n\s*\n", text[len(head) : -len(tail)].strip())
    return framed([p.strip() + "\n" for p in parts if p.strip()], head, tail, most, len(tail))


def split_html_table(text: str, most: int) -> list[str]:
    """An HTML table cut between rows, its head repeated."""
    find = lambda tag: re.search(rf"<{tag}[^>]*>[\s\S]*?</{tag}>", text, re.I)
    head, body = find("thead"), find("tbody")
    rows = re.findall(r"<tr[^>]*>[\s\S]*?</tr>", body[0] if body else text, re.I)
    if not rows:
        return hard_cut(text, most)
    return framed(rows, f"<table>{head[0] if head else ''}<tbody>", "</tbody></table>", most)


def split_pipe_table(text: str, most: int) -> list[str]:
    """A pipe table cut between rows, its two head lines repeated."""
    lines = text.splitlines()
    if len(lines) < 2:
        return hard_cut(text, most)
    return framed([f"\n{x}" for x in lines[2:]], "\n".join(lines[:2]), "", most)


def split_structured(text: str, most: int) -> list[str]:
    """Code, HTML table, pipe table, or a hard cut."""
    if text.startswith(("```", "~~~")):
        return split_code(text, most)
    if text[:6].lower() == "<table":
        return split_html_table(text, most)
    return split_pipe_table(text, most) if "|" in (text.splitlines() or [""])[0] else hard_cut(text, most)


def split_sentences(text: str, most: int) -> list[str]:
    """Sentences packed; what is still too long is split by its structure."""
    return [x for chunk in pack(SENTENCE_END.split(text), most, " ") for x in ([chunk] if len(chunk) <= most else split_structured(chunk, most))]


def split_paragraphs(text: str, most: int) -> list[str]:
    """Paragraphs packed; code and tables are never cut at their blank lines."""
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        if not m[0]:
            return ""
        kept.append(m[0])
        return f"\0{len(kept) - 1}\0"

    hidden = text
    for pattern in PROTECTED:
        hidden = pattern.sub(hide, hidden)
    show = lambda s: re.sub(r"\0(\d+)\0", lambda m: show(kept[int(m[1])]), s)
    pieces = []
    for paragraph in re.split(r"\n\n+", hidden):
        whole = show(paragraph.strip())
        pieces += split_sentences(whole, most) if len(whole) > most else [whole]
    return pack(pieces, most, "\n\n") or [text]


def split_for_embedding(text: str, most: int = BLOCK_CHARS) -> list[str]:
    """Pieces of at most ``most`` characters for vectors (C7); spaces between sentences do not count until the last cut."""
    out = []
    for part in split_paragraphs(text, 2 * most):
        if len(part) <= most:
            out.append(part)
            continue
        for piece in pack(SENTENCE_END.split(part), most, " ", glue_counts=False):
            out += [piece] if len(piece) <= most else hard_cut(piece, most)
    return out or [text]


def split_for_client(text: str, most: int) -> list[str]:
    """Pieces for a model with a text limit: paragraphs, lines, hard cut, then small ones joined."""
    most = max(2, most)
    if len(text) <= most:
        return [text]
    pieces = []
    for paragraph in text.split("\n\n"):
        for piece in [paragraph] if len(paragraph) <= most else paragraph.split("\n"):
            pieces += [piece] if len(piece) <= most else hard_cut(piece, most)
    out: list[str] = []
    current = ""
    for piece in pieces:
        joined = f"{current}\n\n{piece}" if current else piece
        if len(current) + len(piece) + 2 <= most:
            current = joined
        else:
            out += [current] if current else []
            current = piece
    return [*out, current] if current else out or [text]


def size_bins(sizes: list[int], most: int) -> list[int]:
    """The bin of each request when consecutive ones share a bin while their bytes fit."""
    out, used, at = [], 0, 0
    for size in sizes:
        if used and used + size > most:
            at, used = at + 1, 0
        used += size
        out.append(at)
    return out


def chunked(docs: DataFrame, splitter: Callable[[str, int], list[str]], most: int, *, text_col: str = "text") -> DataFrame:
    """One row a piece: the other columns, ``seq`` from 0 and ``chunk``."""
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col]
    schema = docs.select(*others, F.lit(0).cast("long").alias("seq"), F.lit("").alias("chunk")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pieces = [splitter(x or "", most) for x in part.column(len(others)).to_pylist()]
                rows = pa.array([i for i, p in enumerate(pieces) for _ in p], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(rows) for i in range(len(others))), pa.array([i for p in pieces for i in range(len(p))], pa.int64()), pa.array([x for p in pieces for x in p], pa.string())], names=[*others, "seq", "chunk"])

    return docs.select(*others, text_col).mapInArrow(run, schema)
