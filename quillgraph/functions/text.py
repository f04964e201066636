"""Scalar expressions over text: tokens, identities, headings, captions, JSON repair."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Product name patterns, in order of priority (fixed values).
PRODUCT_PATTERNS = (
    r"TMS320[A-Z0-9]+",
    r"STM32[A-Z0-9]+",
    r"MSP430[A-Z0-9]+",
    r"PIC\d+[A-Z0-9]*",
    r"ATmega[A-Z0-9]+",
    r"EFM32[A-Z0-9]+",
    r"CC\d+[A-Z0-9]*",
    r"DRV\d+[A-Z0-9]*",
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: White space of any script, as Python's ``\\s`` has it; the same set in both engines.
SPACES = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def bm25_tokens(text: Column) -> Column:
    """Lower-cased ASCII identifiers, single characters and pairs of each CJK run, and other symbols.

    Symbols and CJK runs are looked for in what the identifiers leave, which is short.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    chars = lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substr(r, i, F.lit(1)))
    pairs = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    words = lambda t: F.regexp_extract_all(t, F.lit("[a-zA-Z0-9_]+"), F.lit(0))
    others = lambda rest: F.concat(
        F.flatten(F.transform(F.regexp_extract_all(rest, F.lit("[\\u4e00-\\u9fff]+"), F.lit(0)), lambda r: F.concat(chars(r), pairs(r)))),
        F.regexp_extract_all(rest, F.lit(rf"[^{SPACES}\p{{L}}\p{{N}}_\u4e00-\u9fff]"), F.lit(0)),
    )
    return let(low, lambda t: F.concat(words(t), let(F.regexp_replace(t, r"[a-zA-Z0-9_\s]+", " "), others)))


_WORD_BYTES = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
_WORDS_ONLY = bytes(c if c in _WORD_BYTES else 32 for c in range(256))
_NO_SYMBOLS = _WORD_BYTES + b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
_SYMBOL = re.compile(r"[^\s\w]")
_CJK = re.compile("[\u4e00-\u9fff]+")


def tokens_of(low: bytes | None) -> list[str]:
    """The tokens of ``bm25_tokens``, in another order, of the UTF-8 bytes of a text that is in lower case already."""
    if not low:
        return []
    out = low.translate(_WORDS_ONLY).decode("ascii").split()
    rest = low.translate(None, _NO_SYMBOLS).decode("utf-8", "replace")
    if rest.isascii():
        out.extend(rest)
        return out
    out.extend(_SYMBOL.findall(rest))
    if _CJK.search(rest):
        for run in _CJK.findall(low.decode("utf-8", "replace")):
            out.extend(run)
            out.extend(map("".join, zip(run, run[1:], strict=False)))
    return out


def short_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of MD5: document ids and content hashes."""
    return F.left(F.md5(text.cast("binary")), F.lit(16))


def heading_level(line: Column) -> Column:
    """Level of a heading line, null for any other line."""
    title = F.trim(F.regexp_extract(line, r"^#+ (.*)$", 1))
    ok = line.rlike(r"^#+ ") & (title != "") & ~title.rlike(r"^\d+$") & ~title.rlike(r"(?i)^\d{1,2}\s+(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}$") & ~title.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(ok, F.length(F.regexp_extract(line, r"^(#+)", 1)))


def heading_title(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, r"^#+ (.*)$", 1))


def product_name(text: Column, path: Column) -> Column:
    """The first product name in the first 50 lines, line by line and then by pattern, else in the file's stem."""
    hit = lambda s: F.coalesce(*[F.nullif(F.regexp_extract(s, p, 0), F.lit("")) for p in PRODUCT_PATTERNS])
    lines = F.slice(F.split(text, "\n", -1), 1, 50)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1")
    return F.coalesce(F.get(F.filter(F.transform(lines, hit), lambda x: x.isNotNull()), F.lit(0)), hit(stem))


def doc_context(title: Column, product: Column) -> Column:
    """Heading of an extraction request."""
    return F.concat(F.lit("文档《"), title, F.lit("》"), F.when(product.isNotNull() & (product != ""), F.concat(F.lit("，产品型号 "), product)).otherwise(F.lit("")))


def repaired_json(raw: Column, schema: str) -> Column:
    """Parse model output: fences off, then as it is, then without trailing commas; null if neither parses."""
    parsed = lambda s, other: F.when(F.try_parse_json(s).isNotNull(), F.from_json(s, schema)).otherwise(other)
    bare = F.regexp_replace(F.trim(raw), r"^```[a-zA-Z]*\s*|\s*```$", "")
    return let(bare, lambda s: parsed(s, let(F.regexp_replace(s, r",(\s*[}\]])", "$1"), lambda t: parsed(t, F.lit(None)))))


def summarized(value: Column, most: int = 200) -> Column:
    """Long parameter strings cut (U4)."""
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most)), F.lit("..."))).otherwise(value)


def normalized_table(text: Column) -> Column:
    """Canonical pipe table: trimmed lines without blanks, breaks as spaces, one space, pipes at both ends."""
    cell = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), r"\s+", " "))
    row = lambda line: F.concat(F.lit("| "), F.array_join(F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|", -1), cell), " | "), F.lit(" |"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    return F.array_join(F.transform(lines, lambda x: F.when(F.contains(x, F.lit("|")), row(x)).otherwise(cell(x))), "\n")


#: Verbs that make a sentence about a figure or table of what looks like its caption (fixed values).
REFERENCE_VERBS = "shows|describes|lists|illustrates|presents|gives|provides|details|summarizes"
#: What a caption starts with: a word, a number, and a title (fixed patterns).
CAPTION_PATTERNS = {
    "figure": r"^Figure\s+[A-Z]?\d+(?:[-.]\d+)?(?:[:.]\s*\S|\s+[A-Z]\S*)",
    "table": r"^(Table|表)\s*[A-Z]?\d+(?:[-.]\d+)?(?:[:.]\s*\S|\s+[A-Z]\S*)",
}


def is_caption(text: Column, kind: str) -> Column:
    """Strict caption predicate for ``kind`` figure or table: no sentence about it."""
    return text.rlike(CAPTION_PATTERNS[kind]) & ~text.rlike(rf"(?i)^(Figure|Table|表)\s*[A-Z]?\d+(?:[-.]\d+)?\s+(?:{REFERENCE_VERBS})\b")


def base_caption(text: Column) -> Column:
    """The caption's number: what continued tables share."""
    head = F.regexp_extract(text, r"(?i)^(Table|表)\s*[A-Z]?\d+(?:[-.]\d+)?", 0)
    return F.when(head != "", head).otherwise(text)


def image_refs(text: Column) -> Column:
    """array<struct<alt, path>> of the Markdown image references, in order."""
    ref = F.lit(r"!\[([^\]]*)\]\(([^)]*)\)")
    return F.zip_with(F.regexp_extract_all(text, ref, F.lit(1)), F.regexp_extract_all(text, ref, F.lit(2)), lambda a, p: F.struct(a.alias("alt"), p.alias("path")))


#: Error classes by provider (fixed words).
QUOTA_WORDS = ("usage limit", "monthly usage limit", "reached your usage", "billing cycle", "额度不足", "欠费", "已停用")
LONG_WORDS = {"chat": ("exceeds limit", "exceeded model token limit", "message size", "token limit"), "embedding": ("too long", "too large", "exceed", "max length", "input length", "content length", "max tokens")}
FILTER_WORDS = {"chat": ("high risk", "rejected", "content safety"), "embedding": ("content filter", "safety", "inappropriate", "high risk")}


def error_class(status: Column, error_type: Column, message: Column, provider: str = "chat") -> Column:
    """The class of a failed HTTP answer (H1)."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    kind = F.coalesce(error_type, F.lit(""))
    out = F.when(status.isin(401, 403), "authentication")
    if provider == "chat":
        out = out.when(status == 402, "authentication")
    out = out.when(status == 404, "request_format")
    if provider == "chat":
        limited = F.when(kind == "exceeded_current_quota_error", "quota").when(kind == "engine_overloaded_error", "overloaded").when(kind == "rate_limit_reached_error", "rate_limit")
        out = out.when(status == 429, limited.when(has(QUOTA_WORDS), "quota").when(has(("overloaded",)), "overloaded").otherwise("rate_limit"))
        out = out.when(status == 499, "transient").when(status.isin(500, 502, 503, 504), "server")
    else:
        out = out.when(status == 429, "rate_limit").when(status == 499, "transient").when(status.isin(500, 502, 504), "server").when(status == 503, "overloaded")
    bad = F.when(has(LONG_WORDS[provider]), "too_large").when(has(FILTER_WORDS[provider]), "content_filter").otherwise("request_format")
    return out.when(status == 400, bad).otherwise("api_error")


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0, jitter: Column | None = None, retry_after: Column | None = None) -> Column:
    """Delay before a retry (H2)."""
    grown = base * F.pow(F.lit(2.0), attempt) * (1 + (jitter if jitter is not None else F.lit(0.0)))
    delay = F.least(F.greatest(F.lit(0.1), grown), F.lit(most))
    return delay if retry_after is None else F.coalesce(retry_after.cast("double"), delay)


def chat_timeout(chars: Column, images: Column, base: int = 300, most: int = 1800) -> Column:
    """Timeout of a chat request (H3)."""
    return F.greatest(F.lit(1), F.least(F.lit(most), base + (chars / F.lit(10000.0) * 60 + images * 30.0).cast("int")))


def chat_retry_delay(error: Column, timeout: Column, base: float = 5.0) -> Column:
    """Delay of a chat retry: longer after a timeout (H4)."""
    timed_out = F.lower(error).rlike("timeout|timed out")
    return F.when(timed_out, F.least(F.lit(60.0), F.greatest(F.lit(1.0), timeout / F.lit(5.0)))).otherwise(F.lit(base))
