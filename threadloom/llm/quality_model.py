"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics. Each partition of the training rows adds up
its part of the normal equations, fold by fold. From these sums alone follow the weights of every fold's complement and
their squared loss on the fold, so one pass over the training rows settles bandwidth, reach and ridge by
cross-validation: nothing about the score is chosen by hand or from held-out rows. The scores that the rows of a fold
get from the other folds' weights calibrate the final ones by pooling adjacent violators over bins of 1/1000.

Bounds, all parameters: TRAINING_ROWS labelled rows at most (chosen by hash), and PARTS partial sums a fold, of
SEARCH_FEATURES + 1 (search, added up in the cluster) or FEATURES + 1 (final, added up on the driver) squared.

Defined results. A null text counts as empty and gets a score. Very long texts are counted whole, in time linear in
their length. A document labelled twice counts with each of its labels, and rows that share a doc_id all take its
labels; equal texts get equal scores. A row without a doc_id is scored, never learned from, and not held out. Without
usable labels every score is 0.5; with labels of one class only, that class's value. Other columns, whatever their
names, are ignored. An empty table gives an empty result. Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import textstats
from threadloom.llm.common import cut

FEATURES = 256
SEARCH_FEATURES = 96
FOLDS = 3
#: What cross-validation chooses from: the kernel's bandwidth in standard deviations, the reach at which standardised
#: statistics are cut (a Gaussian kernel says nothing about rows far from all others), and the ridge per training row.
BANDWIDTHS = (1.0, 2.0, 4.0, 8.0)
REACHES = (2.0, 4.0, 8.0)
RIDGES = (1e-6, 1e-5, 1e-4, 1e-3)
GRID = [(bandwidth, reach) for bandwidth in BANDWIDTHS for reach in REACHES]
SEED = 20240229
TRAINING_ROWS = 200_000
PARTS = 8
BINS = 1000
INPUTS = 12


def inputs() -> list[Column]:
    """The statistics that a score may depend on, as columns z0, z1, ... over textstats.FIELDS."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    each = [
        F.log1p(F.col("n_words")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_upper") / words),
        F.sqrt(F.col("n_punct") / words),
        F.sqrt(F.col("n_pipe") / words),
        F.sqrt(F.col("n_digit") / words),
        F.sqrt(F.col("n_wide") / words),
        F.sqrt(F.col("n_dup_lines") / F.col("n_lines")),
        F.sqrt(F.col("n_repeat_words") / words),
        F.log(F.greatest(F.col("n_distinct"), F.lit(1)) + 1) / F.log(words + 1),
        F.log(words / F.col("n_lines")),
    ]
    return [c.cast("double").alias(f"z{i}") for i, c in enumerate(each)]


Z = [f"z{i}" for i in range(INPUTS)]


def fourier(z: np.ndarray, bandwidth: float, features: int = FEATURES) -> np.ndarray:
    """Rows of standardised statistics to cosines, as many as `features`, and a constant."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / bandwidth, (INPUTS, features)), rng.uniform(0, 2 * np.pi, features)
    return np.hstack([np.sqrt(2 / features) * np.cos(z @ w + b), np.ones((len(z), 1))])


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _standardised(batch: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (np.column_stack([_column(batch, c) for c in Z]) - mean) / scale


def _equations(kernels: list[tuple[float, float]], features: int, mean: np.ndarray, scale: np.ndarray):
    """For mapInArrow: a partition's sums of x'x and x'y, for each kernel and fold."""
    size = features + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(kernels), FOLDS, size, size + 1))
        for batch in batches:
            z, y, fold = _standardised(batch, mean, scale), _column(batch, "label"), _column(batch, "fold")
            for k, (bandwidth, reach) in enumerate(kernels):
                x = fourier(np.clip(z, -reach, reach), bandwidth, features)
                for f in range(FOLDS):
                    own = x[fold == f]
                    total[k, f] += own.T @ np.column_stack([own, y[fold == f]])
        places = [(k, f) for k in range(len(kernels)) for f in range(FOLDS)]
        arrays = [pa.array([k for k, _ in places], pa.int32()), pa.array([f for _, f in places], pa.int32()), pa.array([total[k, f].tobytes() for k, f in places], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["kernel", "fold", "sums"])

    return run


_EQUATIONS = "kernel int, fold int, sums binary"


def ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Weights from x'x and x'y; the corner of x'x counts the rows, whose number the penalty multiplies."""
    size = len(sums)
    return np.linalg.solve(sums[:, :size] + penalty * max(sums[size - 1, size - 1], 1.0) * np.eye(size), sums[:, size])


def losses(folds: np.ndarray) -> list[float]:
    """For each of RIDGES: the squared error of all rows under the weights of the other folds."""
    out, total = [], folds.sum(axis=0)
    for penalty in RIDGES:
        error = 0.0
        for own in folds:
            w = ridge(total - own, penalty)
            # Labels are 0 or 1: the sum of their squares is their sum, where x'y meets the constant.
            error += own[-1, -1] - 2 * w @ own[:, -1] + w @ own[:, :-1] @ w
        out.append(float(error))
    return out


def _evaluate(table: pa.Table) -> pa.Table:
    size = SEARCH_FEATURES + 1
    folds = np.zeros((FOLDS, size, size + 1))
    for fold, sums in zip(table.column("fold").to_pylist(), table.column("sums").to_pylist()):
        folds[fold] += np.frombuffer(sums).reshape(size, size + 1)
    return pa.table({"kernel": pa.array([table.column("kernel")[0].as_py()] * len(RIDGES), pa.int32()), "ridge": pa.array(range(len(RIDGES)), pa.int32()), "loss": pa.array(losses(folds), pa.float64())})


def pool_adjacent(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: the first x of each block, and the block's mean."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist()):
        blocks.append([a, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, s, w2 = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += w2
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class QualityModel:
    """Standardisation, kernel, ridge weights and calibration; a few kB, shipped with the tasks."""

    def __init__(self, mean=None, scale=None, kernel=None, weights=None, knots=None, values=None):
        self.mean, self.scale, self.kernel, self.weights, self.knots, self.values = mean, scale, kernel, weights, knots, values

    def features(self, batch: pa.RecordBatch) -> np.ndarray:
        bandwidth, reach = self.kernel
        return fourier(np.clip(_standardised(batch, self.mean, self.scale), -reach, reach), bandwidth)

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        if self.weights is None:
            return np.full(batch.num_rows, self.values[0])
        return np.clip(np.interp(self.features(batch) @ self.weights, self.knots, self.values), 0.0, 1.0)


def choose(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[tuple[float, float], float]:
    """(bandwidth, reach) and ridge of the smallest cross-validated loss; of equal ones, the first in the grid."""
    sums = rows.coalesce(PARTS).mapInArrow(_equations(GRID, SEARCH_FEATURES, mean, scale), _EQUATIONS)
    tried = sums.groupBy("kernel").applyInArrow(_evaluate, "kernel int, ridge int, loss double").collect()
    best = min(tried, key=lambda r: (r["loss"], r["kernel"], r["ridge"]))
    return GRID[best["kernel"]], RIDGES[best["ridge"]]


def fit(rows: DataFrame) -> QualityModel:
    """From rows of z0, z1, ..., label (0.0 or 1.0) and fold (0 to FOLDS - 1)."""
    summary = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean"), *(F.avg(z).alias(f"a_{z}") for z in Z), *(F.stddev_pop(z).alias(f"s_{z}") for z in Z)).first()
    if not summary["n"] or summary["mean"] in (0.0, 1.0):
        return QualityModel(values=[summary["mean"] if summary["n"] else 0.5])
    mean = np.array([summary[f"a_{z}"] for z in Z])
    scale = np.maximum(np.array([summary[f"s_{z}"] for z in Z]), 1e-3)
    kernel, penalty = choose(rows, mean, scale)
    size = FEATURES + 1
    folds = np.zeros((FOLDS, size, size + 1))
    for r in rows.coalesce(PARTS).mapInArrow(_equations([kernel], FEATURES, mean, scale), _EQUATIONS).collect():
        folds[r["fold"]] += np.frombuffer(r["sums"]).reshape(size, size + 1)
    total = folds.sum(axis=0)
    others = np.stack([ridge(total - own, penalty) for own in folds])
    model = QualityModel(mean, scale, kernel, ridge(total, penalty))

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's score under the weights that its fold had no part in."""
        for batch in batches:
            raw = (model.features(batch) * others[_column(batch, "fold")]).sum(axis=1)
            bins = np.rint(np.clip(raw, -1, 2) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(batch.schema.get_field_index("label"))], ["bin", "label"])

    bins = rows.mapInArrow(unseen, "bin long, label double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y")).orderBy("bin").collect()
    x, y, w = (np.array([r[k] for r in bins], dtype=float) for k in ("bin", "y", "n"))
    model.knots, model.values = pool_adjacent(x / BINS, y, w)
    return model


def _remainder(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)), F.lit(0))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.5)."""
    columns = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    stats = columns.mapInArrow(textstats.with_stats(["doc_id"]), f"doc_id long, {textstats.SCHEMA}")
    stats = cut(stats.select("doc_id", *inputs()))
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("label")).distinct()
    known = known.where(_remainder(F.col("_id")) != 1)
    n = known.count()
    if n > TRAINING_ROWS:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(n)) < TRAINING_ROWS)
    fold = F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(FOLDS)).cast("int")
    rows = cut(stats.join(known, F.col("doc_id") == F.col("_id")).select(*Z, "label", fold.alias("fold")))
    model = fit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = stats.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (_remainder(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")
