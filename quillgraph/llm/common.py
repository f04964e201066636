"""What the training-data operators share: word rules, scratch tables (of ``quillgraph.scratch``) and size checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.scratch import ARROW_BYTES, ARROW_ROWS, bound_batches, clean_up, scratch_path, shared_dir, written  # noqa: F401

#: White space and words, as the data contracts define them (fixed values).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Nothing larger than this is ever broadcast, whatever the session's settings.
BROADCAST_BYTES = 16 << 20


def text_of(column: str | Column) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(column: Column) -> Column:
    """The words of a text (null or blank: an empty array)."""
    trimmed = F.btrim(text_of(column), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda, an outer expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of (id, text).  Rows that share it are identical (or, at 2**-64, verified apart later)."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def small_enough(rows: int, bytes_a_row: int) -> bool:
    """Whether a table of counted rows may be broadcast."""
    return rows * bytes_a_row <= BROADCAST_BYTES
