"""Secret scans through a trigram inverted index, with DataFrame operations only.

Each rule's regular expression is turned into a Boolean query over the trigrams
that every match must hold.  The index maps trigrams of the lower-cased text to
documents; a rule's candidates are the documents in all postings of one of its
conjunctions, and only candidates are matched against the expression.  A rule
without mandatory trigrams (runs of hexadecimal digits) is matched in every text.

The index is written once, each split of the texts as a segment sorted by trigram, so
a scan reads the row groups of its rules' trigrams and no text.  An index over all
trigrams answers rules that come later; one over a vocabulary, which is what a single
scan builds, is a small part of the texts' size.

Defined results: null text is empty and has no spans; rows that repeat each get
their own (equal) row; rows with a null id are kept; an empty table gives an empty
result; other columns of the input are ignored.  Texts of any length are scanned
whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import common

KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches whose ``group`` has fewer than ``least`` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three kinds of the contract come first and in this order (fixed values).
BASE_RULES = (
    Rule("assign", f"({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),  # a run that is too short at its first AKIA is too short at any later one
    Rule("hex", "[0-9a-f]{32,}"),
)
#: Public token formats with a fixed prefix.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

#: A query is a set of conjunctions, each a set of trigrams; ANY holds for every text.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
_MOST_STRINGS = 32


def _either(a: Query, b: Query) -> Query:
    return ANY if frozenset() in a | b else a | b


def _both(a: Query, b: Query) -> Query:
    return frozenset(x | y for x in a for y in b)


def _of_strings(strings: Iterable[str]) -> Query:
    out: Query = frozenset()
    for s in strings:
        out = _either(out, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return out


def _walk(items: Iterable) -> tuple[set[str] | None, Query]:
    """The strings that a part can match, if they are few, and the query that every match fulfils."""
    run: set[str] = {""}
    query, whole = ANY, True

    def flush() -> None:
        nonlocal run, query, whole
        query, run, whole = _both(query, _of_strings(run)), {""}, False

    for op, arg in items:
        strings: set[str] | None = None
        inner = ANY
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
            strings = {chr(v).lower() for _, v in arg}
        elif op is sre.SUBPATTERN:
            strings, inner = _walk(arg[-1])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            inner = frozenset()
            for _, q in parts:
                inner = _either(inner, q)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, part = arg
            got, q = _walk(part)
            if most == 1 and least == 0 and got is not None:
                strings = got | {""}
            elif least >= 1:
                inner = q
        if strings is not None and len(strings) * len(run) <= _MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            flush()
            query = _both(query, inner if strings is None else _of_strings(strings))
    return (run if whole else None), _both(query, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression, over lower-cased text; ANY if it has no mandatory trigram."""
    query = _walk(_parser.parse(pattern))[1]
    return ANY if frozenset() in query else frozenset(a for a in query if not any(b < a for b in query))


def build_index(docs: DataFrame, vocabulary: Iterable[str] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, row_key), one for each trigram that a row's text holds.

    With a vocabulary, only its trigrams get postings: a scan for a known set of
    rules never reads another list.  Without one, all trigrams of all texts do.
    """
    text = common.ascii_lower(common.text_of(text_col))
    if vocabulary is None:
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - 2), lambda i: F.substr(F.col("low"), i, F.lit(3))))
        grams = F.when(F.length("low") >= 3, grams).otherwise(F.array().cast("array<string>"))
    else:
        grams = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in sorted(vocabulary)]), lambda g: g.isNotNull())
    keyed = docs.select(common.row_key(id_col, text_col).alias("row_key"), text.alias("low"))
    return keyed.select("row_key", F.explode(grams).alias("trigram"))


def write_index(docs: DataFrame, vocabulary: Iterable[str] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings as a written table, sorted by trigram within each segment."""
    return common.written(build_index(docs, vocabulary, id_col=id_col, text_col=text_col).sortWithinPartitions("trigram", "row_key"), "secret-postings")


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(row_key, rules): a bit for each rule one of whose conjunctions lies in the row's postings.

    Rows of the index meet the few conjunctions that name their trigram; a bit mask
    for each (row, conjunction) intersects the postings, whichever order they come in.
    """
    spark = index.sparkSession
    wanted, clauses, clause = [], [], 0
    for rule, query in queries.items():
        for grams in sorted(map(sorted, query)):
            clauses.append((clause, 1 << rule, (1 << len(grams)) - 1))
            wanted += [(g, clause, 1 << i) for i, g in enumerate(grams)]
            clause += 1
    index = index.where(F.col("trigram").isin(sorted({g for g, _, _ in wanted})))  # reaches the scan of a written index
    grams = spark.createDataFrame(wanted, "trigram string, clause int, bit long")
    whole = spark.createDataFrame(clauses, "clause int, rule_bit long, mask long")
    met = index.join(F.broadcast(grams), "trigram").groupBy("row_key", "clause").agg(F.bit_or("bit").alias("bits"))
    full = met.join(F.broadcast(whole), "clause").where("bits = mask")
    return full.groupBy("row_key").agg(F.bit_or("rule_bit").alias("rules"))


_BLOCK = 64


def _total(numbers: Column, start: Column) -> Column:
    return F.aggregate(numbers, start, lambda a, x: a + x)


def _running(lengths: Column) -> Column:
    """For each element the sum of those before it, by blocks so that the work stays near linear."""
    zero, block = F.lit(0), lambda i: F.floor(i / _BLOCK).cast("int")
    totals = F.transform(F.sequence(zero, block(F.size(lengths))), lambda b: _total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), zero))
    return common.let(
        totals,
        lambda t: common.let(
            F.transform(t, lambda _, i: _total(F.slice(t, F.lit(1), i), zero)),
            lambda starts: F.transform(lengths, lambda _, i: _total(F.slice(lengths, block(i) * _BLOCK + 1, i % _BLOCK), F.get(starts, block(i)))),
        ),
    )


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, kind, end>> in code points: matches from the left that do not overlap, too short ones dropped.

    Splitting at the matches gives the text between them; lengths of pieces and
    matches, summed up, give the places.
    """
    pattern = F.lit(rule.pattern)
    parts = F.struct(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gaps"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x)).alias("sizes"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)).alias("kept"),
    )

    def placed(p: Column) -> Column:
        gaps, sizes = p["gaps"], p["sizes"]
        steps = F.zip_with(sizes, F.slice(gaps, F.lit(2), F.size(sizes)), lambda m, g: m + F.coalesce(g, F.lit(0)))
        starts = common.let(steps, _running)
        rows = F.zip_with(F.zip_with(starts, sizes, lambda s, m: F.struct((s + F.get(gaps, F.lit(0))).alias("s"), m.alias("m"))), p["kept"], lambda x, v: F.struct(x["s"].alias("start"), F.lit(number).alias("kind"), (x["s"] + x["m"]).alias("end"), v.alias("n")))
        return F.transform(F.filter(rows, lambda x: x["n"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return common.let(parts, placed)


_NONE = "array<struct<start:int,kind:int,end:int>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, index: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, text and ``spans`` array<struct<start, kind, end>>; ``kind`` is the rule's number.

    ``index`` is a written index of these documents over all trigrams or the rules' ones; without one, it is built.

    Candidates meet their rows by a 64-bit row key.  The candidate list is broadcast
    if its counted rows fit the broadcast bound, else both sides are shuffled by the key.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ANY}
    vocabulary = {g for q in queries.values() for c in q for g in c}
    if index is None:
        index = write_index(docs, vocabulary, id_col=id_col, text_col=text_col)
    found = common.written(candidates(index, queries), "secret-candidates")
    if common.small_enough(found.count(), 32):
        found = F.broadcast(found)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), common.row_key(id_col, text_col).alias("row_key"))
    joined = base.join(found, "row_key", "left").select("doc_id", common.text_of("text").alias("text"), F.coalesce("rules", F.lit(0).cast("long")).alias("rules"))
    empty = F.array().cast(_NONE)
    parts = []
    for i, rule in enumerate(rules):
        if i in queries:
            here = F.col("rules").bitwiseAND(F.lit(1 << i).cast("long")) != 0
            here &= F.col("text").rlike(rule.pattern)
        else:
            here = F.col("text").rlike(rule.pattern)
        parts.append(F.when(here, spans_of(F.col("text"), rule, i)).otherwise(empty))
    return joined.withColumn("spans", F.array_sort(F.concat(*parts))).drop("rules")


def rendered(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")
