"""The registered queries of the ten operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontam, htmlmain, linededup, mil, mixing, outliers, secrets, simhash, tokencount, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(_table(spark, sf_dir, "pages")))
    return records.select(
        F.col("key").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_payload_digest",
        F.col("source_headers")["WARC-Block-Digest"].alias("source_block_digest"), F.size("source_headers").cast("long").alias("n_source_headers"),
        "block_digest", F.octet_length("block").cast("long").alias("content_length"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < len(secrets.BASE_RULES))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE_RULES)],
        F.sha2(secrets.rendered(base), 256).alias("base_sha256"),
        secrets.rendered(F.col("spans")).alias("spans"),
    )


def op4_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outliers.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmlmain.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.rendered("fp").alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", F.round("containment", 6).alias("containment"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = tokencount.with_suffix_sums(tokencount.histogram(_table(spark, sf_dir, "documents")))
    return sums.withColumnRenamed("group", "lang")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil.fit(docs, _table(spark, sf_dir, "labels"))
    scored = mil.score(docs, model)
    return scored.select("doc_id", mil.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= mil.THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_mixing": op2_mixing,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_outliers": op4_quality_outliers,
    "op5_line_dedup": op5_line_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_quality_classifier": op10_quality_classifier,
}

_W = r"[^\x20\x09-\x0D]+"

_OP2 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':42'), 1, 15) AS k
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(1 + (i - 1) % 3 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS most FROM src),
levels AS (
  SELECT *, most / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
    CASE WHEN ratio < coalesce(max(CASE WHEN ratio >= level THEN level END) OVER (), ratio + 1) THEN most
         ELSE w * max(CASE WHEN ratio >= level THEN level END) OVER () END AS target
  FROM levels),
cut AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM cut)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(budget - epochs * source_size - before, size)) AS BIGINT) AS taken
FROM passes
"""


def _spans_sql(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{
      'start': CAST(list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
      'kind': {number}, 'name': '{kind}',
      'size': length(regexp_extract_all(t, '{p}')[i]), 'least': length(regexp_extract_all(t, '{p}', {group})[i])}}), lambda s: s.least >= {least})"""


_OP3_PARTS = ", ".join(_spans_sql(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(secrets.RULES))
_OP3_TEXT = "list_transform(list_sort({}), lambda s: concat_ws(':', s.name, s.start, s.start + s.size))"
_OP3 = f"""
WITH found AS (SELECT doc_id, flatten([{_OP3_PARTS}]) AS spans FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id,
  CAST(len(list_filter(spans, lambda s: s.kind = 0)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(spans, lambda s: s.kind = 1)) AS BIGINT) AS n_access,
  CAST(len(list_filter(spans, lambda s: s.kind = 2)) AS BIGINT) AS n_hex,
  sha256(coalesce(array_to_string({_OP3_TEXT.format("list_filter(spans, lambda s: s.kind < 3)")}, ','), '')) AS base_sha256,
  coalesce(array_to_string({_OP3_TEXT.format("spans")}, ','), '') AS spans
FROM found
"""

_OP5 = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
flat AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM flat),
firsts AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT keyed.*, coalesce(doc_id > first_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_GRAMS = rf"""
SELECT DISTINCT {{id}}, array_to_string(w[i:i + 4], ' ') AS g FROM (
  SELECT {{id}}, w, unnest(range(1, len(w) - 3)) AS i FROM (
    SELECT {{id}}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM {{table}}))
"""
_OP8 = f"""
WITH d AS ({_GRAMS.format(id="doc_id", table="documents")}), b AS ({_GRAMS.format(id="item_id", table="benchmark")}),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, round(n_shared / n_shingles, 6) AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_shingles
"""

ORACLE: dict[str, str] = {"op2_mixing": _OP2, "op3_secret_scan": _OP3, "op5_line_dedup": _OP5, "op8_decontamination": _OP8}
