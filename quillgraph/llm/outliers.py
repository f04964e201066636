"""Quality rules with robust multivariate outliers (minimum covariance determinant).

Statistics are taken from every whole text.  Documents that pass the base rules give
a vector of transformed statistics; for each language and source the location and
scatter of the ``SHARE`` of its vectors with the least covariance determinant are
estimated, and a document is rejected if its Mahalanobis distance is above the cut, a
quantile of chi-square.

The estimate is a deterministic MCD.  It has three starts, all around the medians and
scaled by the median deviations: uncorrelated, the correlations of hyperbolic tangents
and those of spatial signs.  A concentration step takes the subset of exactly the share
of a group: the distance that cuts it is found in a histogram of distances and in a
finer one of the bin that is cut; rows of equal fine bin weigh equally.  After
``FIRST_STEPS`` steps the start with the least determinant goes on alone for
``MORE_STEPS``; the least determinant seen is taken and reweighted once by the rows
inside the 97.5 % ellipsoid.  Every step is a few grouped sums, so no group is ever
gathered, however many rows it has.

A group needs ``LEAST_ROWS`` vectors.  Smaller ones of a language are estimated
together, and languages that are still smaller are one group.  Directions in which a
scatter is smaller than the least scales of the features (many groups have a statistic
that never varies) are lifted to them; others are left as they are.

Defined results: null text is empty (no words, base_failed); null language or source
is a group of its own; rows that repeat get equal results; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm import common

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20
SHARE = 0.75
FIRST_STEPS, MORE_STEPS = 2, 4
LEAST_ROWS = 50
#: Share of a normal cloud that lies outside the cut.
OUTSIDE = 1e-6
FEATURES = ("x0", "x1", "x2", "x3", "x4")
#: The least scale of each feature: that of a few symbols, repeated lines or repeated words in a text of some hundred words.
FLOOR = (0.1, 0.5, 0.6, 0.4, 0.3)
P = len(FEATURES)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Distance bins a factor of e, and parts of the bin that is cut.
_BINS, _FINE = 32, 1 << 20
_STARTS = 3


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    word_chars = len(text) - (len(raw) - int(sizes.sum()))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > WINDOW:
        joined = b" ".join(words)
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: n - WINDOW + 1].tolist()
        stops = ends[WINDOW - 1 :].tolist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, map(joined.__getitem__, map(slice, starts, stops))), np.uint64, len(starts))
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        equal = ranked[1:] == ranked[:-1]
        if equal.any():
            twice = np.zeros(len(starts), bool)
            twice[order[1:][equal]] = True
            twice[order[:-1][equal]] = True
            # Equal hashes are verified by their words.
            seen: dict[bytes, int] = {}
            places = np.flatnonzero(twice).tolist()
            for i in places:
                piece = joined[starts[i] : stops[i]]
                seen[piece] = seen.get(piece, 0) + 1
            cover = np.zeros(n + 1, np.int64)
            for i in places:
                if seen[joined[starts[i] : stops[i]]] > 1:
                    cover[i] += 1
                    cover[i + WINDOW] -= 1
            repeated = int((np.cumsum(cover)[:n] > 0).sum())
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeated, len(lines)


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, the statistics and base_failed."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_stats(t.as_py()) for t in batch.column(3)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(found[:, i]) for i in range(len(names)))], names=["doc_id", "lang", "source", *names])

    common.bound_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    out = picked.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words")))


def with_features(stats: DataFrame) -> DataFrame:
    """Transformed statistics; shares are smoothed by 50 words so that short texts do not scatter more than long ones."""
    n = F.col("n_words").cast("double")
    return stats.withColumns({
        "x0": (F.col("word_chars") + 250.0) / (n + 50.0),
        "x1": F.log1p(100.0 * F.col("n_symbols") / (n + 50.0)),
        "x2": F.log1p(100.0 * F.col("n_dup_lines") / (F.col("n_lines") + 5.0)),
        "x3": F.log1p(100.0 * F.col("n_repeat_words") / (n + 50.0)),
        "x4": F.log1p(n),
    })


def _chi2_cdf(x: float, k: int) -> float:
    a, half = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 400):
        term *= half / (a + i)
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def chi2_quantile(q: float, p: int = P) -> float:
    low, high = 1e-6, 400.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, p) < q else (low, mid)
    return low


def consistency(share: float, p: int = P) -> float:
    """What the scatter of the densest share of a normal cloud is multiplied by to be that of the cloud."""
    return share / _chi2_cdf(chi2_quantile(share, p), p + 2)


#: Distance squared above which a vector is an outlier.
CUT = chi2_quantile(1 - OUTSIDE)
#: The reweighting keeps what lies inside this share of a normal cloud.
INSIDE = 0.975

_MODEL = "grp string, k int, center array<double>, inverse array<double>, logdet double"


def lifted(scatter: np.ndarray) -> np.ndarray:
    """The scatter with every direction that is below the least scales lifted to them."""
    floor = np.array(FLOOR)
    values, vectors = np.linalg.eigh(scatter / np.outer(floor, floor))
    return (vectors * np.maximum(values, 1.0)) @ vectors.T * np.outer(floor, floor)


def _model(grp: str, k: int, center: np.ndarray, scatter: np.ndarray) -> tuple:
    scatter = lifted(scatter)
    inverse = np.linalg.inv(scatter)
    return grp, k, center.tolist(), [float(inverse[i, j]) for i, j in _PAIRS], float(np.linalg.slogdet(scatter)[1])


def _square(row: dict, head: str) -> np.ndarray:
    out = np.zeros((P, P))
    for i, j in _PAIRS:
        out[i, j] = out[j, i] = row[f"{head}{i}{j}"]
    return out


def _frames(of):
    """mapInPandas function: models of the rows of a frame."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([m for row in frame.to_dict("records") for m in of(row)], columns=[x.split()[0] for x in _MODEL.split(", ")])

    return run


def _distance():
    """The squared distance, as one SQL expression: hundreds of single column objects would cost more than the work."""
    d = [f"({x} - center[{i}])" for i, x in enumerate(FEATURES)]
    return F.expr(" + ".join(f"{1.0 if i == j else 2.0}D * inverse[{n}] * {d[i]} * {d[j]}" for n, (i, j) in enumerate(_PAIRS)))


def _products(values: list[str], head: str, weight: str = "1.0D") -> list:
    return [F.expr(f"sum({weight} * {values[i]} * {values[j]})").alias(f"{head}{i}{j}") for i, j in _PAIRS]


def groups(rows: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang_key, source_key, grp): the group in which a language and source is estimated."""
    sizes = rows.groupBy("lang_key", "source_key").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n"))
    small = F.col("n") < least_rows
    langs = sizes.groupBy("lang_key").agg(F.sum(F.when(small, F.col("n"))).alias("together"))
    own, lang = F.concat(F.lit("s"), F.length("lang_key"), F.lit(":"), "lang_key", "source_key"), F.concat(F.lit("l"), "lang_key")
    grp = F.when(~small, own).when(F.col("together") >= least_rows, lang).otherwise("all")
    return sizes.join(langs, "lang_key").select("lang_key", "source_key", grp.alias("grp"))


class Mcd:
    """The estimate over rows (grp, x0, ..., x4); ``light`` if a few rows a group may be broadcast."""

    def __init__(self, rows: DataFrame, light: bool, share: float = SHARE) -> None:
        self.rows, self.light, self.share = rows, light, share

    def meet(self, left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.join(F.broadcast(right) if self.light else right, on)

    def starts(self) -> DataFrame:
        """Models of the three starts."""
        middle = self.rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m_{x}") for x in FEATURES])
        middle = common.written(middle, "mcd-medians")
        apart = self.meet(self.rows, middle, ["grp"]).groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 1000).alias(f"s_{x}") for x in FEATURES])
        scales = [F.greatest(1.4826 * F.col(f"s_{x}"), F.lit(FLOOR[i])).alias(f"s_{x}") for i, x in enumerate(FEATURES)]
        base = common.written(middle.join(apart, "grp").select("grp", *[f"m_{x}" for x in FEATURES], *scales), "mcd-scales")
        z = [(F.col(x) - F.col(f"m_{x}")) / F.col(f"s_{x}") for x in FEATURES]
        near = self.meet(self.rows, base, ["grp"]).select("grp", *[v.alias(f"z{i}") for i, v in enumerate(z)])
        norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0)))
        near = near.withColumn("norm", F.greatest(norm, F.lit(1e-12)))
        sums = near.groupBy("grp").agg(*_products([f"tanh(z{i})" for i in range(P)], "t"), *_products([f"(z{i} / norm)" for i in range(P)], "u"))

        def of(row: dict) -> Iterator[tuple]:
            center, scale = np.array([row[f"m_{x}"] for x in FEATURES]), np.array([row[f"s_{x}"] for x in FEATURES])
            yield _model(row["grp"], 0, center, np.diag(scale**2))
            for k, head in enumerate("tu", 1):
                moments = _square(row, head)
                root = np.sqrt(np.maximum(np.diag(moments), 1e-12))
                share = moments / np.outer(root, root)
                np.fill_diagonal(share, 1.0)
                yield _model(row["grp"], k, center, share * np.outer(scale, scale))

        return common.written(base.join(sums, "grp").mapInPandas(_frames(of), _MODEL), "mcd-starts")

    def solved(self, weighed: DataFrame, share: float) -> DataFrame:
        """Models of rows (grp, k, w, x0, ...) with weights."""
        factor = consistency(share)
        sums = weighed.groupBy("grp", "k").agg(F.sum("w").alias("n"), *[F.expr(f"sum(w * {x})").alias(f"s{i}") for i, x in enumerate(FEATURES)], *_products(list(FEATURES), "q", "w"))

        def of(row: dict) -> Iterator[tuple]:
            center = np.array([row[f"s{i}"] for i in range(P)]) / row["n"]
            yield _model(row["grp"], row["k"], center, factor * (_square(row, "q") / row["n"] - np.outer(center, center)))

        return common.written(sums.mapInPandas(_frames(of), _MODEL), "mcd-models")

    def far(self, models: DataFrame) -> DataFrame:
        """Each row with each model of its group: d, the squared distance, and its place on the scale of bins."""
        met = self.meet(self.rows, models.select("grp", "k", "center", "inverse"), ["grp"]).select("grp", "k", *FEATURES, _distance().alias("d"))
        return met.withColumn("at", F.log1p(F.greatest("d", F.lit(0.0))) * _BINS)

    def step(self, models: DataFrame) -> DataFrame:
        """One concentration step of every model."""
        far = self.far(models)
        coarse, fine = F.floor("at").cast("int"), F.floor((F.col("at") - F.floor("at")) * _FINE).cast("int")
        before = lambda by: F.coalesce(F.sum("n").over(Window.partitionBy("grp", "k").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = far.groupBy("grp", "k", coarse.alias("bin")).agg(F.count("*").alias("n"))
        bins = bins.withColumn("need", F.ceil(self.share * F.sum("n").over(Window.partitionBy("grp", "k")))).withColumn("below", before("bin"))
        cut = bins.where((F.col("below") < F.col("need")) & (F.col("below") + F.col("n") >= F.col("need"))).select("grp", "k", F.col("bin").alias("cut_bin"), (F.col("need") - F.col("below")).alias("need"))
        cut = common.written(cut, "mcd-cuts")
        inner = self.meet(far, cut, ["grp", "k"]).where(coarse == F.col("cut_bin")).groupBy("grp", "k", "cut_bin", "need", fine.alias("part")).agg(F.count("*").alias("n"))
        inner = inner.withColumn("below", before("part")).where((F.col("below") < F.col("need")) & (F.col("below") + F.col("n") >= F.col("need")))
        inner = inner.select("grp", "k", "cut_bin", F.col("part").alias("cut_part"), ((F.col("need") - F.col("below")) / F.col("n")).alias("rest"))
        w = F.when((coarse < F.col("cut_bin")) | ((coarse == F.col("cut_bin")) & (fine < F.col("cut_part"))), 1.0).when((coarse == F.col("cut_bin")) & (fine == F.col("cut_part")), F.col("rest")).otherwise(0.0)
        return self.solved(self.meet(far, inner, ["grp", "k"]).withColumn("w", w).where("w > 0"), self.share)

    def best(self, models: DataFrame) -> DataFrame:
        """The model with the least determinant of each group; of equal ones the first."""
        return models.groupBy("grp").agg(F.min_by(F.struct("k", "center", "inverse", "logdet"), F.struct("logdet", "k")).alias("m")).select("grp", "m.*")

    def fit(self) -> DataFrame:
        """One model a group."""
        models = self.starts()
        for _ in range(FIRST_STEPS):
            models = self.step(models)
        models = seen = self.best(models)
        for _ in range(MORE_STEPS):
            models = self.step(models)
            seen = seen.unionByName(models)
        best = self.best(seen)
        inside = self.far(best).where(F.col("d") <= chi2_quantile(INSIDE)).withColumn("w", F.lit(1.0))
        return self.solved(inside, INSIDE)


def judge(docs: DataFrame, *, share: float = SHARE, cut: float = CUT, least_rows: int = LEAST_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance (null if base_failed) and kept."""
    stats = common.written(statistics(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col), "quality-stats")
    key = lambda c: F.when(F.col(c).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(c)))
    rows = with_features(stats).withColumns({"lang_key": key("lang"), "source_key": key("source")})
    parts = common.written(groups(rows, least_rows), "quality-groups")
    light = common.small_enough(parts.count() * _STARTS, 512)
    named = rows.join(F.broadcast(parts) if light else parts, ["lang_key", "source_key"])
    good = common.written(named.where(~F.col("base_failed")).select("grp", *FEATURES), "quality-vectors")
    models = Mcd(good, light, share).fit().select("grp", "center", "inverse")
    out = named.join(F.broadcast(models) if light else models, "grp", "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(F.greatest(_distance(), F.lit(0.0)))))
    kept = F.coalesce(F.col("distance") <= math.sqrt(cut), F.lit(False))
    return out.withColumn("kept", kept).drop("lang_key", "source_key", "grp", *FEATURES, "center", "inverse")
