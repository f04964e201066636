"""Text of office files, read in Arrow batches from Spark's binary source."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.shipping import ship

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _text(node: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag)).strip()


def docx_text(data: bytes) -> str:
    """Paragraphs, and table rows with cells joined by `` | ``, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    out = []
    for item in body if body is not None else ():
        if item.tag == f"{_WORD}p":
            out.append(_text(item, f"{_WORD}t"))
        elif item.tag == f"{_WORD}tbl":
            out += [" | ".join(_text(c, f"{_WORD}t") for c in row.iter(f"{_WORD}tc")) for row in item.iter(f"{_WORD}tr")]
    return "\n".join(x for x in out if x)


def xlsx_text(data: bytes) -> str:
    """Rows of all sheets with cells joined by `` | ``."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_text(s, f"{_SHEET}t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for name in sheets:
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_SHEET}row"):
                cells = []
                for c in row.iter(f"{_SHEET}c"):
                    v = c.find(f"{_SHEET}v")
                    raw = v.text or "" if v is not None else _text(c, f"{_SHEET}t")
                    cells.append(shared[int(raw)] if c.get("t") == "s" and raw else raw)
                if any(cells):
                    out.append(" | ".join(cells))
    return "\n".join(out)


def office_text(files: DataFrame) -> DataFrame:
    """(path, text) of files (path, content) that end in .docx or .xlsx; what cannot be read has no text."""

    ship(files.sparkSession)

    def one(path: str, data: bytes) -> str | None:
        reader = {"docx": docx_text, "xlsx": xlsx_text}.get(path.rsplit(".", 1)[-1].lower())
        try:
            return reader(data) if reader else None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0)
            texts = [one(p.as_py(), d.as_py()) for p, d in zip(paths, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([paths, pa.array(texts, pa.string())], names=["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string")
