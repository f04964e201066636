"""Markdown to heading trees, content blocks and heading maps.

A document is parsed inside its own row, in Arrow batches: nothing is shuffled to
find headings, parents or sections.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import chunking
from quillgraph.shipping import ship

_HEADING = re.compile(r"(#+) (.*)", re.S)
#: Titles that are page numbers or dates (fixed patterns).
_NOISE = re.compile(r"\d+|\d{4}-\d{2}-\d{2}|\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}", re.I)


@dataclass
class Node:
    seq: int
    level: int
    title: str
    parent: int = -1
    root: int = -1
    path: list[str] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)
    children: list[int] = field(default_factory=list)

    @property
    def content(self) -> str:
        return "\n".join(self.lines).strip()


def heading(line: str) -> tuple[int, str] | None:
    """Level and title of a heading line."""
    m = _HEADING.match(line)
    title = m[2].strip() if m else ""
    return (len(m[1]), title) if title and not _NOISE.fullmatch(title) else None


def parse(text: str) -> list[Node]:
    """Nodes in order; text before the first heading is dropped, and fences hide headings.

    A node's parent is the nearest earlier node of a smaller level.  A text without
    headings is one node without a title.
    """
    nodes: list[Node] = []
    open_at: list[int] = []
    fenced = False
    for line in text.splitlines():
        fence = line.strip().startswith(("```", "~~~"))
        fenced ^= fence
        found = None if fence or fenced else heading(line)
        if not found:
            if nodes:
                nodes[-1].lines.append(line)
            continue
        node = Node(len(nodes), *found)
        open_at = [i for i in open_at if nodes[i].level < node.level]
        if open_at:
            above = nodes[open_at[-1]]
            node.parent, node.root, node.path = above.seq, above.root, [*above.path, node.title]
            above.children.append(node.seq)
        else:
            node.root, node.path = node.seq, [node.title]
        open_at.append(node.seq)
        nodes.append(node)
    return nodes or [Node(0, 1, "", root=0, path=[""], lines=[text])]


def chapter_text(node: Node) -> str:
    """A node's content under the titles of its path, marked by their place in it (T4)."""
    titles = "\n".join(f"{'#' * (i + 1)} {t}" for i, t in enumerate(node.path) if t)
    return f"{titles}\n\n{node.content}" if titles else node.content


def section_text(nodes: list[Node], at: int) -> str:
    """A node and all below it, titles marked by level (T5)."""
    node = nodes[at]
    own = [f"{'#' * node.level} {node.title}"] if node.title else []
    return "\n\n".join(x for x in [*own, node.content, *(section_text(nodes, c) for c in node.children)] if x).strip()


def build_blocks(text: str, most: int = chunking.BLOCK_CHARS, lossless: bool = False) -> tuple[list[tuple], list[tuple]]:
    """Content blocks (block_id, seq, section, content) and heading maps (title, level, parent, block_ids).

    Sections are children of roots; a root's own text goes before its first section.
    Roots without children give no block (``lossless`` makes them sections too).  If
    there is no block at all, chapters are the blocks.
    """
    nodes = parse(text)
    blocks: list[tuple] = []
    maps: list[tuple] = []

    def add(title: str, content: str, pieces: list[str]) -> list[str]:
        ids = []
        for piece in pieces:
            ids.append(f"b_{len(blocks)}")
            blocks.append((ids[-1], len(blocks), title, piece))
        return ids

    for root in (n for n in nodes if n.parent < 0):
        sections = root.children or ([root.seq] if lossless else [])
        for n, at in enumerate(sections):
            content = section_text(nodes, at)
            if n == 0 and root.content and root.children:
                head = f"# {root.title}\n\n{root.content}" if root.title else root.content
                content = f"{head.strip()}\n\n{content}".strip()
            if not content:
                continue
            section = nodes[at]
            ids = add(section.title, content, chunking.split_for_embedding(content, most))
            maps.append((section.title, section.level, root.title if section is not root else "", ids))
            for child in (nodes[c] for c in section.children):
                maps.append((child.title, child.level, section.title, ids))
                maps += [(nodes[g].title, nodes[g].level, child.title, ids) for g in child.children]
    if not blocks:
        for node in nodes:
            if node.content:
                content = chapter_text(node)
                ids = add(node.title, content, chunking.split_paragraphs(content, chunking.CHAPTER_CHARS))
                if node.title:
                    maps.append((node.title, 2, "", ids))
    return blocks, maps


def _mapped(docs: DataFrame, rows_of, schema: str, fields: list[tuple[str, pa.DataType]], id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [{"doc_id": d, **dict(zip([n for n, _ in fields], r, strict=True))} for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in rows_of(t or "")]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", part.column(0).type), *fields]))

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {schema}")


def headings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a node: seq, parent, root, level, title, path, content."""
    return _mapped(
        docs,
        lambda t: [(n.seq, n.parent, n.root, n.level, n.title, n.path, n.content) for n in parse(t)],
        "node_seq long, parent_seq long, root_seq long, level long, title string, path array<string>, content string",
        [("node_seq", pa.int64()), ("parent_seq", pa.int64()), ("root_seq", pa.int64()), ("level", pa.int64()), ("title", pa.string()), ("path", pa.list_(pa.string())), ("content", pa.string())],
        id_col,
        text_col,
    )


def chapters(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Nodes with content, under their path's titles (T4)."""
    return _mapped(docs, lambda t: [(n.seq, n.title, chapter_text(n)) for n in parse(t) if n.content], "node_seq long, title string, content string", [("node_seq", pa.int64()), ("title", pa.string()), ("content", pa.string())], id_col, text_col)


def content_blocks(docs: DataFrame, most: int = chunking.BLOCK_CHARS, lossless: bool = False, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _mapped(docs, lambda t: build_blocks(t, most, lossless)[0], "block_id string, seq_index long, section_title string, content string", [("block_id", pa.string()), ("seq_index", pa.int64()), ("section_title", pa.string()), ("content", pa.string())], id_col, text_col)


def heading_maps(docs: DataFrame, most: int = chunking.BLOCK_CHARS, lossless: bool = False, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _mapped(docs, lambda t: build_blocks(t, most, lossless)[1], "heading_title string, heading_level long, parent_heading string, block_ids array<string>", [("heading_title", pa.string()), ("heading_level", pa.int64()), ("parent_heading", pa.string()), ("block_ids", pa.list_(pa.string()))], id_col, text_col)


def batches(blocks: DataFrame, most: int = chunking.CHAPTER_CHARS) -> DataFrame:
    """Blocks of a section joined, in order of the section's first block, and split if too long."""
    some = blocks.where(F.coalesce("content", F.lit("")) != "")
    joined = some.groupBy("doc_id", "section_title").agg(F.min("seq_index").alias("first_seq"), F.array_sort(F.collect_list(F.struct("seq_index", "content"))).alias("parts"))
    whole = joined.select("doc_id", "section_title", "first_seq", F.trim(F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n")).alias("text")).where("text <> ''")
    fits = lambda t, n: [t] if len(t) <= n else chunking.split_paragraphs(t, n)
    return chunking.chunked(whole, fits, most)


def incremental(new: DataFrame, old: DataFrame, force: bool = False) -> DataFrame:
    """(title, state): unchanged, changed, added or removed, by title and content hash.

    ``new`` and ``old`` have title and content_hash; a title is unchanged if any old
    row has the hash.
    """
    a = new.groupBy("title").agg(F.collect_set("content_hash").alias("now"))
    b = old.groupBy("title").agg(F.collect_set("content_hash").alias("was"))
    same = F.arrays_overlap("now", "was") & F.lit(not force)
    return a.join(b, "title", "full_outer").select("title", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(same, "unchanged").otherwise("changed").alias("state"))


# -- heading queries ------------------------------------------------------------


def like_heading(maps: DataFrame, text: str) -> DataFrame:
    """Heading maps whose title holds a text; ``%`` and ``_`` in it are wildcards."""
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    return maps.where(F.col("heading_title").ilike(pattern)) if text else maps.limit(0)


def blocks_of(maps: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks that heading maps name, each once."""
    ids = maps.select("doc_id", F.explode("block_ids").alias("block_id")).distinct()
    return blocks.join(ids, ["doc_id", "block_id"], "left_semi")


def heading_descent(maps: DataFrame, title: str) -> DataFrame:
    """The first map of each document whose title holds a text, and all below it to any depth, each title and level once."""
    keys = ["doc_id", "heading_title", "heading_level"]
    first = like_heading(maps, title).select(*keys).withColumn("first", F.row_number().over(Window.partitionBy("doc_id").orderBy("heading_level", "heading_title")) == 1).where("first")
    known = maps.join(first, keys, "left").select(*keys, "parent_heading", F.coalesce("first", F.lit(False)).alias("first"))

    def below(frame):
        """The headings of one document that are reached; what was reached is not entered again."""
        children: dict = {}
        for row in frame.itertuples(index=False):
            if row.parent_heading is not None:
                children.setdefault(row.parent_heading, []).append((row.heading_title, row.heading_level))
        reached = dict.fromkeys((r.heading_title, r.heading_level) for r in frame.itertuples(index=False) if r.first)
        todo = [t for t, _ in reached]
        while todo:
            for child in children.pop(todo.pop(), []):
                if child not in reached:
                    reached[child] = None
                    todo.append(child[0])
        hit = [(r.heading_title, r.heading_level) in reached for r in frame.itertuples(index=False)]
        return frame[hit][keys].drop_duplicates()

    found = known.groupBy("doc_id").applyInPandas(below, known.select(*keys).schema)
    return maps.join(found, keys, "left_semi").dropDuplicates(keys)


def toc_ranges(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, chapter): entries hold until the next one's page; later entries win; gaps are untitled.

    ``toc`` (doc_id, toc_idx, title, page), ``pages`` (doc_id, n_pages).
    """
    after = F.lead("page").over(Window.partitionBy("doc_id").orderBy("toc_idx"))
    spans = toc.withColumn("next_page", after).join(pages, "doc_id").withColumn("end", F.greatest(F.col("page"), F.least(F.coalesce(F.col("next_page") - 1, F.col("n_pages")), F.col("n_pages"))))
    hits = spans.select("doc_id", "toc_idx", "title", F.explode(F.sequence("page", "end")).alias("page"))
    named = hits.groupBy("doc_id", "page").agg(F.max_by("title", "toc_idx").alias("chapter"))
    has = toc.select("doc_id").distinct().withColumn("has", F.lit(True))
    every = pages.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_pages"))).alias("page"))
    return every.join(named, ["doc_id", "page"], "left").join(has, "doc_id", "left").select("doc_id", "page", F.coalesce("chapter", F.when(F.col("has"), "(Untitled)").otherwise("全文")).alias("chapter"))


def filled_down(cells: DataFrame) -> DataFrame:
    """Blank first cells take the last one above them (T14); ``cells`` (table_id, row_idx, first)."""
    w = Window.partitionBy("table_id").orderBy("row_idx")
    return cells.withColumn("first", F.coalesce(F.nullif(F.col("first"), F.lit("")), F.last(F.nullif(F.col("first"), F.lit("")), ignorenulls=True).over(w), F.lit("")))


def merge_continued(segments: DataFrame, base: Column) -> DataFrame:
    """The segment whose table takes each segment's rows: the last start of the same base caption before it.

    ``segments`` (doc_id, seg, caption); ``base`` is the caption's number.
    """
    marked = segments.withColumn("base", base).withColumn("goes_on", F.contains(F.lower("caption"), F.lit("continued from previous page")))
    w = Window.partitionBy("doc_id", "base").orderBy("seg")
    return marked.withColumn("target", F.coalesce(F.last(F.when(~F.col("goes_on"), F.col("seg")), ignorenulls=True).over(w), F.col("seg"))).drop("base")


def without_broken_images(text: Column, valid: Column) -> Column:
    """References to images that are not among ``valid`` go; web and data references stay; wide gaps close."""
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]*)\)"), F.lit(1)))
    broken = F.filter(refs, lambda p: ~F.array_contains(valid, p) & ~p.rlike("^(https?://|data:)"))
    out = F.aggregate(broken, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"!\[[^\]]*\]\(\Q"), p, F.lit(r"\E\)")), F.lit("")))
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def with_descriptions(text: Column, images: Column) -> Column:
    """Image references become ``[id] description``; images that no reference names are listed at the end.

    ``images`` array<struct<id, description>>.
    """
    done = F.aggregate(images, text, lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"!\[\Q"), x["id"], F.lit(r"\E\]\([^)]*\)")), F.concat(F.lit("["), x["id"], F.lit("] "), x["description"])))
    rest = F.filter(images, lambda x: ~F.contains(text, F.concat(F.lit("!["), x["id"], F.lit("]("))))
    lines = F.transform(rest, lambda x: F.concat(F.lit("["), x["id"], F.lit("] "), x["description"]))
    return F.when(F.size(rest) > 0, F.concat(done, F.lit("\n\n【图片内容】\n"), F.array_join(lines, "\n"))).otherwise(done)
