"""Quality rules: base rules, then robust multivariate outliers by minimum-covariance-determinant estimates.

The verdict. Each document that passes the base rules has a vector of transformed statistics. For every language and
source, concentration steps look for the share COVERED of its documents whose covariance has the smallest determinant.
They begin from three starts (medians with median absolute deviations, plain moments, spatial signs); a step takes the
documents nearest to the current estimate and estimates again, and a start goes on as long as its determinant falls. The
estimate with the smallest determinant of all starts stands. Documents whose Mahalanobis distance from it lies beyond the
chi-square quantile SURE are rejected.

Every step is an aggregation with partial sums, so a source that holds a third of all rows costs no task more than
another; no documents are shuffled or collected, and joins to the estimates are salted by the groups' counts. A small
group's moments are blended with those of its language (SHRINK documents' worth). No covariance has, in units of FLOORS,
an eigenvalue below 1, so that a statistic that is constant among clean documents doesn't turn each small change into an
outlier.

Defined results. A null text counts as empty: no words, base_failed. Very long texts are counted whole. Null lang or
source form a group of their own. Repeated rows are judged alike; documents at the same distance are covered together.
Other columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import textstats
from threadloom.llm.common import salted_join, salts, stored

#: Transformed statistics: log mean word length; square roots, which steady the variance of a count, of symbols,
#: capitals and punctuation marks per word and of the share of repeated lines; log distinct words per log words.
DIMENSIONS = 6
#: A text of nothing but repeated lines is an outlier by that alone: (1 / 0.16) ** 2 lies beyond the quantile SURE.
FLOORS = (0.06, 0.12, 0.08, 0.08, 0.16, 0.05)
COVERED = 0.75
#: A step counts as progress if it lowers the determinant's logarithm by this; quantiles are approximate in large groups.
PROGRESS = 1e-6
SURE = 0.99999
SHRINK = 100.0
X = [f"x{i}" for i in range(DIMENSIONS)]
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]


def chi2_cdf(x: float, k: int) -> float:
    """For an even k."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return high


def base_statistics(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the columns `carry` computes, lang, source and the statistics of every whole text, with base_failed and the vector x0, x1, ..."""
    carry = carry or {}
    columns = docs.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("lang", "string"), ("source", "string"), ("text", "string"))), *(c.alias(n) for n, c in carry.items()))
    keep = ["doc_id", *carry, "lang", "source"]
    schema = ", ".join(f"`{c}` {columns.schema[c].dataType.simpleString()}" for c in keep)
    stats = columns.mapInArrow(textstats.with_stats(keep), f"{schema}, {textstats.SCHEMA}")
    words = F.greatest(F.col("n_words"), F.lit(1))
    vector = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_upper") / words),
        F.sqrt(F.col("n_punct") / words),
        F.sqrt(F.col("n_dup_lines") / F.col("n_lines")),
        F.log(F.greatest(F.col("n_distinct"), F.lit(1)) + 1) / F.log(words + 1),
    ]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return stats.select(*keep, *base, failed.alias("base_failed"), *(v.cast("double").alias(x) for x, v in zip(X, vector)))


def _group(lang: Column, source: Column) -> Column:
    """One text for language and source, in which a null differs from every value."""
    return F.concat_ws("\u0000", *(F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in (lang, source)))


def _sums(columns: list[Column], name: str) -> list[Column]:
    return [F.sum(columns[i] * columns[j]).alias(f"{name}{i}_{j}") for i, j in PAIRS]


CENTRE = [f"m{i}" for i in range(DIMENSIONS)]
PRECISION = [f"p{i}_{j}" for i, j in PAIRS]
MODEL = [*CENTRE, *PRECISION]
_SUMS = ["n", *(f"s{i}" for i in range(DIMENSIONS)), *(f"q{i}_{j}" for i, j in PAIRS)]


def _distance() -> Column:
    terms = []
    for i, j in PAIRS:
        terms.append((1 if i == j else 2) * F.col(f"p{i}_{j}") * (F.col(X[i]) - F.col(f"m{i}")) * (F.col(X[j]) - F.col(f"m{j}")))
    return sum(terms[1:], terms[0])


def _square(row: dict, name: str) -> np.ndarray:
    out = np.zeros((DIMENSIONS, DIMENSIONS))
    for i, j in PAIRS:
        out[i, j] = out[j, i] = row[f"{name}{i}_{j}"]
    return out


def _moments(row: dict, prefix: str = "") -> tuple[float, np.ndarray, np.ndarray]:
    n = row[f"{prefix}n"]
    mean = np.array([row[f"{prefix}s{i}"] for i in range(DIMENSIONS)]) / n
    return n, mean, _square(row, f"{prefix}q") / n - np.outer(mean, mean)


def floored(cov: np.ndarray) -> tuple[float, np.ndarray]:
    """The logarithm of the determinant, in units of FLOORS, and the precision of a covariance raised to FLOORS."""
    unit = np.outer(FLOORS, FLOORS)
    values, vectors = np.linalg.eigh(cov / unit)
    values = np.maximum(values, 1.0)
    return float(np.log(values).sum()), (vectors / values) @ vectors.T / unit


def _flat(precision: np.ndarray) -> list[float]:
    return [float(precision[i, j]) for i, j in PAIRS]


def _mapped(df: DataFrame, schema: str, make) -> DataFrame:
    """Rows of small tables, each turned into a list of rows."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [made for row in batch.to_pylist() for made in make(row)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    return df.mapInArrow(run, schema)


_STATE = "grp string, start int, best double, moving boolean, " + ", ".join(f"{c} double" for c in [*MODEL, *_SUMS])


def _starts(vectors: DataFrame, pieces: Column | None) -> DataFrame:
    """For each group three centres and precisions to start from."""
    medians = stored(vectors.groupBy("grp").agg(*(F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(X))))
    apart = salted_join(vectors, medians, ["grp"], pieces, X)
    spread = apart.groupBy("grp").agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i, x in enumerate(X)))
    scaled = stored(spread.join(medians, "grp").select("grp", *CENTRE, *(F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOORS[i])).alias(f"d{i}") for i in range(DIMENSIONS))))
    placed = salted_join(vectors, scaled, ["grp"], pieces, X)
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"d{i}") for i, x in enumerate(X)]
    length = F.greatest(F.sqrt(sum((c * c for c in z[1:]), z[0] * z[0])), F.lit(1e-9))
    sums = placed.groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(X)), *_sums([F.col(x) for x in X], "q"), *_sums([c / length for c in z], "u"))

    def make(row: dict) -> list[list]:
        median, scale = np.array([row[c] for c in CENTRE]), np.array([row[f"d{i}"] for i in range(DIMENSIONS)])
        n, mean, cov = _moments(row)
        signs = np.linalg.inv((_square(row, "u") / n + 0.01 * np.eye(DIMENSIONS)) * np.outer(scale, scale))
        starts = [(median, np.diag(1 / scale**2)), (mean, floored(cov)[1]), (median, signs)]
        return [[row["grp"], k, math.inf, True, *centre.tolist(), *_flat(precision), *[0.0] * len(_SUMS)] for k, (centre, precision) in enumerate(starts)]

    return stored(_mapped(sums.join(scaled, "grp"), _STATE, make))


def _step(vectors: DataFrame, state: DataFrame, pieces: Column | None) -> DataFrame:
    """One concentration step of all starts that still move; the others stay as they are."""
    models = state.where("moving").select("grp", "start", *MODEL)
    apart = salted_join(vectors, models, ["grp"], pieces, X).select("grp", "start", *X, _distance().alias("d2"))
    reach = stored(apart.groupBy("grp", "start").agg(F.percentile_approx("d2", COVERED, 1000).alias("reach")))
    near = salted_join(vectors, models.join(reach, ["grp", "start"]), ["grp"], pieces, X).where(_distance() <= F.col("reach"))
    sums = near.groupBy("grp", "start").agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(X)), *_sums([F.col(x) for x in X], "q"))

    def make(row: dict) -> list[list]:
        _, mean, cov = _moments(row)
        size, precision = floored(cov)
        if size < row["best"] - PROGRESS:
            return [[row["grp"], row["start"], size, True, *mean.tolist(), *_flat(precision), *(row[c] for c in _SUMS)]]
        return [[row["grp"], row["start"], row["best"], False, *(row[c] for c in MODEL), *(row[f"old_{c}"] for c in _SUMS)]]

    old = state.where("moving").select("grp", "start", "best", *MODEL, *(F.col(c).alias(f"old_{c}") for c in _SUMS))
    return stored(_mapped(sums.join(old, ["grp", "start"]), _STATE, make).unionByName(state.where("not moving")))


def robust_models(vectors: DataFrame, pieces: Column | None) -> DataFrame:
    """For each group: centre m0, ... and precision p0_0, ... of the covered documents with the smallest determinant."""
    state = _starts(vectors, pieces)
    while state.where("moving").limit(1).count():
        state = _step(vectors, state, pieces)
    chosen = state.groupBy("grp").agg(F.min_by(F.struct(*_SUMS), F.struct("best", "start")).alias("x")).select("grp", "x.*")
    chosen = stored(chosen.withColumn("lang", F.substring_index("grp", "\u0000", 1)))
    wide = chosen.groupBy("lang").agg(*(F.sum(c).alias(f"l{c}") for c in _SUMS))
    # The covered documents are the nearest ones: their covariance is that much too small for a normal distribution.
    correction = COVERED / chi2_cdf(chi2_quantile(COVERED, DIMENSIONS), DIMENSIONS + 2)

    def make(row: dict) -> list[list]:
        n, mean, cov = _moments(row)
        _, wide_mean, wide_cov = _moments(row, "l")
        share = n / (n + SHRINK)
        _, precision = floored(correction * (share * cov + (1 - share) * wide_cov))
        return [[row["grp"], *(share * mean + (1 - share) * wide_mean).tolist(), *_flat(precision)]]

    return stored(_mapped(chosen.join(wide, "lang"), "grp string, " + ", ".join(f"{c} double" for c in MODEL), make))


def quality_rules(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: the columns `carry` computes from it, base statistics, base_failed, distance2 (null where the base rules failed) and kept."""
    statistics = stored(base_statistics(docs, carry).withColumn("grp", _group(F.col("lang"), F.col("source"))))
    vectors = statistics.where(~F.col("base_failed")).select("grp", *X)
    counts = stored(vectors.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    pieces = salts(counts, ["grp"], "n", counts.agg(F.sum("n")).first()[0] or 0)
    judged = salted_join(statistics, robust_models(vectors, pieces), ["grp"], pieces, X, "left")
    distance = F.when(~F.col("base_failed"), _distance())
    limit = chi2_quantile(SURE, DIMENSIONS)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(carry or {}), *base, "base_failed", distance.alias("distance2")).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= limit))
