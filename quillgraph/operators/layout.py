"""Page geometry over tables of page elements (doc_id, page, kind, x0, y0, x1, y1, text, font_size).

What is relational is relational: separators are merged by gaps and islands, zones
are neighbours of separators, drawings meet zones by their centre.  Clustering by
nearness is transitive and runs in one page's rows at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import is_caption
from quillgraph.shipping import ship

PAGE = ["doc_id", "page"]
#: Which kind a merged separator shows (fixed order).
PRIORITY = {"figure_caption": 4, "table_caption": 3, "heading": 2, "body_text": 1}


#: Limits of running text, headings and callouts, in points or shares of the page (fixed values).
BODY_MAX_HEIGHT, BODY_MAX_WIDTH, BODY_TALL, BODY_WIDTH, BODY_LEAST_HEIGHT, BODY_LEAST_CHARS = 0.35, 0.85, 80.0, 0.52, 8.0, 45
HEADING_LEAST_FONT, HEADING_WIDTH = 12.0, 0.3
CALLOUT_REACH, CALLOUT_GAP, CALLOUT_FONT, CALLOUT_SHARE = 250.0, 45.0, 9.0, 0.72


def is_body_text(text: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Whether a text block is running text."""
    share = width / page_width
    fits = (height <= page_height * BODY_MAX_HEIGHT) & ~((share > BODY_MAX_WIDTH) & (height > BODY_TALL))
    return fits & (share > BODY_WIDTH) & (height > BODY_LEAST_HEIGHT) & (F.length(text) > BODY_LEAST_CHARS)


def classify_blocks(blocks: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """Text blocks with ``category``: figure_caption, table_caption, heading, callout, body_text or other.

    ``blocks`` (page key, x0, y0, x1, y1, text, font_size, page_width, page_height);
    ``toc`` (page key, title).  Callouts start near captions and spread to small
    blocks within a gap, from block to block: blocks that are near in height form
    islands, and an island with one callout is all callouts.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    one_line = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    out = blocks.withColumn("__caption", F.when(is_caption(F.col("text"), "figure"), "figure_caption").when(is_caption(F.col("text"), "table"), "table_caption"))
    page = out.groupBy(*PAGE).agg(F.coalesce(F.median(F.when(F.col("__caption").isNull(), F.col("font_size"))), F.lit(10.0)).alias("__mid"), F.collect_list(F.when(F.col("__caption").isNotNull(), F.struct(F.col("y0").alias("a"), F.col("y1").alias("b")))).alias("__spans"))
    out = out.join(page, PAGE)
    if toc is not None:
        titles = toc.groupBy(*PAGE).agg(F.collect_set(F.trim(F.replace("title", F.lit("\n"), F.lit(" ")))).alias("__titles"))
        out = out.join(titles, PAGE, "left")
        numbered = one_line.rlike(r"^\d+(\.\d+)*$")
        in_toc = F.coalesce(F.exists("__titles", lambda t: (t == one_line) | numbered & t.startswith(F.concat(one_line, F.lit(" ")))), F.lit(False))
    else:
        in_toc = F.lit(False)
    big = (F.col("font_size") >= F.greatest(F.col("__mid") + 2, F.lit(HEADING_LEAST_FONT))) & (w > F.col("page_width") * HEADING_WIDTH)
    body = is_body_text(F.col("text"), w, h, F.col("page_width"), F.col("page_height"))
    near = F.exists("__spans", lambda s: (F.col("y1") >= s["a"] - CALLOUT_REACH) & (F.col("y0") <= s["b"] + CALLOUT_REACH))
    small = F.col("font_size") <= F.greatest(F.lit(CALLOUT_FONT), CALLOUT_SHARE * F.col("__mid") + 2, F.col("__mid") + 1.5)
    marked = F.col("text").rlike(r"^[A-H]\.|^Note:|^\([A-Z]\)")
    first = F.coalesce("__caption", F.when(in_toc | big, "heading"), F.when(near & (marked | small & ~body), "callout"))
    out = out.withColumn("__first", first)
    spreads = (F.col("__first") == "callout") | F.col("__first").isNull() & (F.col("font_size") <= F.col("__mid") + 1.5)
    order = Window.partitionBy(*PAGE, "__can").orderBy("y0", "y1")
    out = out.withColumn("__can", F.coalesce(spreads, F.lit(False)))
    out = out.withColumn("__new", F.when(F.col("y0") - F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1)) < CALLOUT_GAP, 0).otherwise(1))
    out = out.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    seeded = F.coalesce(F.bool_or(F.col("__first") == "callout").over(Window.partitionBy(*PAGE, "__can", "__island")), F.lit(False))
    out = out.withColumn("category", F.coalesce("__first", F.when(F.col("__can") & seeded, "callout"), F.when(body, "body_text"), F.lit("other")))
    return out.select(*blocks.columns, "category")


def separators(elements: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Overlapping separators of a page merged, the kind of highest priority shown (P4); ``elements`` (page key, kind, y0, y1)."""
    before = Window.partitionBy(*PAGE).orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(*PAGE).orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, 0)
    marked = elements.withColumn("new", F.when(F.col("y0") <= F.max("y1").over(before) + tolerance, 0).otherwise(1)).withColumn("island", F.sum("new").over(running))
    rank = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in PRIORITY.items()], F.lit(0))
    return marked.groupBy(*PAGE, "island").agg(F.max_by("kind", F.struct(rank, -F.col("y0"))).alias("kind"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def zones(seps: DataFrame, least: float = 1.0) -> DataFrame:
    """Gaps between separators (P5)."""
    after = F.lead("y0").over(Window.partitionBy(*PAGE).orderBy("y0"))
    out = seps.select(*PAGE, F.col("y1").alias("z0"), after.alias("z1")).where(F.col("z1") > F.col("z0") + least)
    return out.withColumn("zone", F.row_number().over(Window.partitionBy(*PAGE).orderBy("z0")).cast("long"))


def in_zones(elements: DataFrame, found: DataFrame) -> DataFrame:
    """Elements with the zone that holds their centre (P6); a page has few zones, so the range is checked within the page."""
    centre = (F.col("y0") + F.col("y1")) / 2
    return elements.join(found, PAGE).where((centre >= F.col("z0")) & (centre < F.col("z1")))


def table_style(placed: DataFrame) -> DataFrame:
    """grid, horizontal or null for each zone, from its drawings and text blocks (P10)."""
    w, h, drawing = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("kind") == "drawing"
    count = lambda c: F.count_if(drawing & c)
    flat = w > 3 * h
    counted = placed.groupBy(*PAGE, "zone").agg(
        count(flat).alias("h"), count(~flat & (h > 3 * w)).alias("v"), count(~flat & ~(h > 3 * w)).alias("other"), count(flat & (h <= 0.1)).alias("zero"),
        F.count_if(F.col("kind") == "text").alias("texts"), (F.max(F.when(drawing, F.col("y1"))) - F.min(F.when(drawing, F.col("y0")))).alias("span"),
    )
    lines = F.col("h") + F.col("v")
    density = F.col("texts") / F.greatest(F.lit(1.0), F.col("span"))
    grid = (F.col("h") >= 4) & (F.col("v") >= 3)
    open_ = (F.col("v") <= 1) & (F.col("h") >= 4) & (F.col("texts") >= 3)
    mostly_zero = F.col("zero") >= 0.5 * F.col("h")
    style = F.when((lines == 0) | (F.col("other") > 0.5 * lines), None).when(grid, F.when(density >= 0.02, "grid")).when(open_ & mostly_zero, F.when(density >= 0.01, "horizontal")).when(open_ & (F.col("h") >= 6), "horizontal")
    return counted.withColumn("style", style)


def _near_groups(boxes: np.ndarray, reach: float) -> np.ndarray:
    """Group number of each box; boxes within reach in both directions are together, transitively."""
    group = np.arange(len(boxes))
    for i in range(len(boxes)):
        dx = np.maximum(np.maximum(boxes[:, 0] - boxes[i, 2], boxes[i, 0] - boxes[:, 2]), 0)
        dy = np.maximum(np.maximum(boxes[:, 1] - boxes[i, 3], boxes[i, 1] - boxes[:, 3]), 0)
        met = np.unique(group[(dx <= reach) & (dy <= reach)])
        group[np.isin(group, met)] = met[0]
    return np.unique(group, return_inverse=True)[1]


def drawing_clusters(drawings: DataFrame, reach: float = 10.0) -> DataFrame:
    """Drawings of a page with the number of their cluster."""

    def one(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y0", "x0", "y1", "x1"])
        return page.assign(cluster=_near_groups(page[["x0", "y0", "x1", "y1"]].to_numpy(float), reach).astype("int64"))

    ship(drawings.sparkSession)
    picked = drawings.select(*PAGE, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    kinds = dict(picked.dtypes)
    return picked.groupBy(*PAGE).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in picked.columns) + ", cluster long")


def cluster_score(drawing_ratio: Column, text_ratio: Column, images: Column, height: Column, table_like: Column, plain_box: Column) -> Column:
    """How much a cluster looks like a figure."""
    penalty = F.when(text_ratio > 0.7, 3.0).when(text_ratio > 0.4, 1.0).otherwise(0.0) + F.when(table_like, 5.0).otherwise(0.0) + F.when(plain_box, 3.0).otherwise(0.0)
    factor = F.when(height < 30, 0.2).when(height < 60, 0.6).when(height > 150, 1.2).otherwise(1.0)
    return F.greatest(F.lit(0.0), (8.0 * F.least(drawing_ratio, F.lit(1.0)) + 4.0 * (1.0 - F.least(text_ratio, F.lit(1.0))) + 2.0 * images - penalty) * factor)


def subtract(spans: list[tuple[float, float]], claimed: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Parts of vertical spans that nothing has claimed."""
    for c0, c1 in sorted(claimed):
        spans = [piece for s0, s1 in spans for piece in ((s0, min(s1, c0)), (max(s0, c1), s1)) if piece[1] > piece[0]]
    return spans


def _anchored(ys: list[float], tolerance: float) -> list[float]:
    """The largest group of sorted values within ``tolerance`` of the group's first."""
    best: list[float] = []
    group: list[float] = []
    for y in sorted(ys):
        if group and y - group[0] > tolerance:
            group = []
        group.append(y)
        if len(group) > len(best):
            best = list(group)
    return best


def consistent_lines(lines: DataFrame, share: float = 0.8, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, y): the height at which a line stands on at least 80 % of a document's pages, 0 if none (P14); ``lines`` (doc_id, n_pages, y)."""

    def one(doc: pd.DataFrame) -> pd.DataFrame:
        best = _anchored(doc["y"].tolist(), tolerance)
        enough = len(best) >= max(3, int(doc["n_pages"].iloc[0] * share))
        return pd.DataFrame({"doc_id": [doc["doc_id"].iloc[0]], "y": [sum(best) / len(best) if enough else 0.0]})

    ship(lines.sparkSession)
    return lines.groupBy("doc_id").applyInPandas(one, f"doc_id {dict(lines.dtypes)['doc_id']}, y double")


def toc_headings(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """Text blocks that are entries of the table of contents on their page."""
    norm = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return blocks.withColumn("k", norm(F.col("text"))).join(toc.select("doc_id", "page", "level", norm(F.col("title")).alias("k")), ["doc_id", "page", "k"]).drop("k")


def page_markdown(elements: DataFrame) -> DataFrame:
    """The page's elements from top to bottom as one text."""
    parts = F.array_sort(F.collect_list(F.struct("y0", "x0", "text")))
    return elements.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def low_content(pixels: DataFrame, share: float = 0.95) -> DataFrame:
    """Images of which one color covers more than ``share`` (P17); ``pixels`` (image_id, color)."""
    counts = pixels.groupBy("image_id", "color").agg(F.count("*").alias("n"))
    return counts.groupBy("image_id").agg((F.max("n") > share * F.sum("n")).alias("low_content"))


# -- tables without vertical lines -------------------------------------------------------

#: Distances of the borderless extractor in points (fixed values).
SAME_LINE, SAME_LEFT, SAME_TABLE, WORD_GAP, WORD_BASE, ROW_GAP, COLUMN_SLACK, HEAD_HEIGHT = 2.0, 8.0, 150.0, 12.0, 3.0, 25.0, 10.0, 30.0


class _Words:
    """Words of a region as arrays."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.x0, self.y0, self.x1, self.y1 = (rows[c].to_numpy(float) for c in ("x0", "y0", "x1", "y1"))
        self.text = rows["text"].to_numpy(object)
        self.cx, self.cy = (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    def inside(self, top: float, bottom: float) -> np.ndarray:
        return (self.cy > top) & (self.cy < bottom)

    def joined(self, chosen: np.ndarray) -> str:
        at = np.flatnonzero(chosen)
        return " ".join(self.text[at[np.lexsort((self.x0[at], self.y0[at]))]])


def _merged_lines(lines: pd.DataFrame) -> list[list[float]]:
    """Lines (y, x0, x1), those of nearly one height as one."""
    out: list[list[float]] = []
    ys: list[float] = []
    for y, x0, x1 in sorted(zip((lines["y0"] + lines["y1"]) / 2, lines["x0"], lines["x1"], strict=True)):
        if ys and abs(y - sum(ys) / len(ys)) <= SAME_LINE:
            ys.append(y)
            out[-1] = [sum(ys) / len(ys), min(out[-1][1], x0), max(out[-1][2], x1)]
        else:
            ys = [y]
            out.append([y, x0, x1])
    return out


def _top_table(lines: list[list[float]]) -> list[list[float]]:
    """Of lines parted where their left ends jump, the part with the topmost line."""
    by_left = sorted(lines, key=lambda x: x[1])
    cuts = [i for i in range(1, len(by_left)) if by_left[i][1] - by_left[i - 1][1] > SAME_TABLE]
    parts = [by_left[a:b] for a, b in zip([0, *cuts], [*cuts, len(by_left)], strict=True)]
    return sorted(min(parts, key=lambda p: min(x[0] for x in p)))


def _header_columns(words: _Words, top: float, bottom: float) -> np.ndarray:
    """Left and right end of each column, from runs of near words of the head row."""
    at = np.flatnonzero(words.inside(top, bottom))
    at = at[np.lexsort((words.x0[at], words.y0[at]))]
    columns: list[list[float]] = []
    for n, i in enumerate(at):
        before = at[n - 1] if n else None
        if before is not None and words.x0[i] - words.x1[before] <= WORD_GAP and abs(words.cy[i] - words.cy[before]) <= WORD_BASE:
            columns[-1] = [min(columns[-1][0], words.x0[i]), max(columns[-1][1], words.x1[i])]
        else:
            columns.append([words.x0[i], words.x1[i]])
    return np.array(columns).reshape(-1, 2)


def borderless_table(lines: pd.DataFrame, words: pd.DataFrame, bottom: float) -> str | None:
    """A pipe table from horizontal lines and words of a region, or None.

    Lines that start at the table's left end part its rows; shorter ones part only
    the columns right of them, and the cells left of them span those rows.
    """
    w = _Words(words)
    rules = _top_table(_merged_lines(lines)) if len(lines) else []
    if len(rules) < 3 or not len(words):
        return None
    while len(rules) > 2 and not w.inside(rules[0][0], rules[1][0]).any():
        rules = rules[1:]
    while len(rules) > 2 and not w.inside(rules[-2][0], rules[-1][0]).any():
        rules = rules[:-1]
    if len(rules) < 3:
        return None
    left = min(x for _, x, _ in rules)
    full = [y for y, x, _ in rules if x <= left + SAME_LEFT]
    short = [(y, x) for y, x, _ in rules if x > left + SAME_LEFT]
    columns = _header_columns(w, rules[0][0], full[1] if len(full) > 1 else rules[0][0] + HEAD_HEIGHT)
    if len(columns) < 2:
        return None
    middles = columns.mean(axis=1)

    def cells(chosen: np.ndarray, first: int = 0) -> list[str]:
        near = np.abs(w.cx[:, None] - middles[None, first:])
        nearest = near == near.min(axis=1, keepdims=True)
        return [w.joined(chosen & nearest[:, c]) for c in range(nearest.shape[1])]

    if len(full) < 2:
        rows = [cells(w.inside(a[0], b[0])) for a, b in zip(rules, rules[1:], strict=False)]
    else:
        bands = list(zip(full, full[1:], strict=False))
        if any(y > full[-1] for y, _ in short) or w.inside(full[-1], bottom).any():
            bands.append((full[-1], bottom))
        rows = [cells(w.inside(*bands[0]))]
        if not any(rows[0]):
            return None
        for top, end in bands[1:]:
            inner = [(y, x) for y, x in short if top < y < end]
            here = w.inside(top, end)
            if not inner:
                order = np.sort(w.x0[here]), w.x1[here][np.argsort(w.x0[here], kind="stable")]
                if here.sum() > 1 and (order[0][1:] - order[1][:-1]).max() >= ROW_GAP:
                    rows.append(cells(here))
                continue
            span = next((c for c, (x, _) in enumerate(columns) if x >= inner[0][1] - COLUMN_SLACK), len(columns))
            wide = [w.joined(here & (np.abs(w.cx - m) <= (b - a) / 2 + 20)) for (a, b), m in zip(columns[:span], middles, strict=False)]
            edges = [top, *(y for y, _ in inner), end]
            for a, b in zip(edges, edges[1:], strict=False):
                right = w.inside(a, b) & (w.cx >= columns[span][0] - COLUMN_SLACK) if span < len(columns) else np.zeros(len(w.cx), bool)
                rows.append([*wide, *(cells(right, span) if span < len(columns) else [])])
    filled = lambda r: sum(bool(c) for c in r)
    kept = [rows[0], ["---"] * len(columns), *(r for r in rows[1:] if filled(r) > 1 or filled(r) == 1 and not r[0])]
    return "\n".join("| " + " | ".join(r) + " |" for r in kept)


def borderless_tables(elements: DataFrame) -> DataFrame:
    """(page key, region, table) for regions of page elements (kind line or word).

    ``elements`` (page key, region, kind, x0, y0, x1, y1, text, bottom); lines are thin,
    wide drawings, and footers, captions and marks of continuation are left out upstream.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        table = borderless_table(frame[frame["kind"] == "line"], frame[frame["kind"] == "word"], float(frame["bottom"].iloc[0]))
        return frame[[*PAGE, "region"]].head(1).assign(table=table)

    ship(elements.sparkSession)
    kinds = dict(elements.dtypes)
    return elements.groupBy(*PAGE, "region").applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in (*PAGE, "region")) + ", table string").where("table is not null")


def table_regions(found: DataFrame, least_height: float = 20.0, least_share: float = 0.3, least_rows: int = 2, least_cols: int = 2) -> DataFrame:
    """Detected tables that are large enough and do not overlap a better one of their zone by half.

    ``found`` (page key, zone, table_id, x0, y0, x1, y1, n_rows, n_cols, page_width); the
    better one is larger, ties by id.  A zone holds a few tables, which meet in a join.
    """
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    good = found.where((F.col("y1") - F.col("y0") >= least_height) & (F.col("x1") - F.col("x0") >= least_share * F.col("page_width")) & (F.col("n_rows") >= least_rows) & (F.col("n_cols") >= least_cols))
    other = good.select(*PAGE, "zone", *[F.col(c).alias(f"o_{c}") for c in ("table_id", "x0", "y0", "x1", "y1")])
    overlap = F.greatest(F.lit(0.0), F.least("x1", "o_x1") - F.greatest("x0", "o_x0")) * F.greatest(F.lit(0.0), F.least("y1", "o_y1") - F.greatest("y0", "o_y0"))
    better = (area("o_") > area("")) | (area("o_") == area("")) & (F.col("o_table_id") < F.col("table_id"))
    beaten = good.join(other, [*PAGE, "zone"]).where((F.col("table_id") != F.col("o_table_id")) & better & (overlap > 0.5 * area(""))).select(*PAGE, "zone", "table_id")
    return good.join(beaten, [*PAGE, "zone", "table_id"], "left_anti")


def fallback_headings(blocks: DataFrame) -> DataFrame:
    """Headings of documents without contents: fonts above the document's median, short texts; level by size.

    ``blocks`` (doc_id, page, y0, text, font_size, bold).
    """
    mid = blocks.groupBy("doc_id").agg(F.percentile_approx("font_size", 0.5, 1000).alias("mid"))
    rise = F.col("font_size") / F.col("mid")
    level = F.when(rise >= 1.6, 1).when(rise >= 1.3, 2).when((rise >= 1.15) | (F.col("bold") & (rise >= 1.0)), 3)
    return blocks.join(mid, "doc_id").withColumn("level", F.when(F.length("text") <= 120, level)).where("level is not null").drop("mid")
