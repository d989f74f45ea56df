"""Operator 1: quality classifier on random Fourier features of document statistics.

Statistics of each whole text are standardised and mapped to `DIMENSIONS`
random Fourier features, whose inner products approximate a Gaussian kernel.
Each partition sums its own part of the normal equations, for each of `FOLDS`
folds; leaving one fold's part out of the total gives the ridge model that
scores this fold, and isotonic regression on these out-of-fold scores turns
ridge scores into probabilities. Only sums, a few hundred numbers square, meet
on the driver.

Defined cases: null and empty texts have all-zero statistics and get a score;
labels that are null or without a document are ignored; of repeated labels of
a document each counts; without labels of both kinds every score is the labels'
mean (0.5 without any); repeated rows get equal scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

DIMENSIONS = 192
FOLDS = 4
RIDGE = 1e-3
BINS = 2048
SEED = 20261

_SYMBOLS, _UPPER, _DIGITS, _STOPS, _VOWELS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"aeiouAEIOU"
N_STATISTICS = 22


def statistics(text: str | None) -> list[float]:
    """Shares and logarithms of counts; linear in the length of the text."""
    body = (text or "").encode()
    words = body.split()
    if not words:
        return [0.0] * N_STATISTICS
    n, size = len(words), len(body)
    share = lambda chars: (size - len(body.translate(None, chars))) / size
    lines = [x for x in body.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    kinds = len(set(words))
    upper = share(_UPPER)
    ended = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    return [
        math.log1p(n),
        math.log1p(size),
        math.log1p(len(lines)),
        float(lengths.mean()),
        float(lengths.std()),
        math.log1p(float(lengths.max())),
        kinds / n,
        kinds / math.sqrt(n),
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        math.sqrt(share(_SYMBOLS)),
        math.sqrt(share(b"|")),
        math.sqrt(share(b"!")),
        upper,
        math.sqrt(upper),
        share(_DIGITS),
        share(_STOPS),
        share(_VOWELS),
        math.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        ended / len(lines),
        float((lengths <= 3).mean()),
    ]


def _statistics(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        found = pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([ids, found], ["doc_id", "x"])


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text, mod 3, is not 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(True))


class Model:
    """Standardisation, random features, ridge weights and calibration; a few hundred kB."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = draw.normal(size=(len(mean), DIMENSIONS)) * math.sqrt(2.0 / len(mean))
        self.b = draw.uniform(0, 2 * math.pi, DIMENSIONS)
        self.weights = np.zeros(DIMENSIONS + 1)
        self.xs, self.ys = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([math.sqrt(2 / DIMENSIONS) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.xs, self.ys)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.values if hasattr(column, "values") else column.combine_chunks().values).reshape(len(column), N_STATISTICS)


def _solve(total: np.ndarray) -> np.ndarray:
    """Ridge weights from the rows [Z'Z | Z'y]."""
    a, y = total[:, :-1], total[:, -1]
    penalty = RIDGE * max(1.0, a[-1, -1]) * np.eye(len(a))
    penalty[-1, -1] = 0.0
    return np.linalg.solve(a + penalty + 1e-9 * np.eye(len(a)), y)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators; x ascending. Block centres and means."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    found = np.array(blocks)
    return found[:, 0] / found[:, 2], found[:, 1] / found[:, 2]


def fit(labelled: DataFrame) -> Model:
    """labelled: doc_id, x (statistics), y (0 or 1)."""
    ends = labelled.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(N_STATISTICS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not ends["n"] or ends["y"] in (0, 1):
        model = Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
        model.ys = np.array([0.5 if ends["y"] is None else float(ends["y"])])
        return model
    spread = np.array([ends[f"s{i}"] for i in range(N_STATISTICS)])
    model = Model(np.array([ends[f"m{i}"] for i in range(N_STATISTICS)]), np.where(spread > 1e-9, spread, 1.0))
    folded = labelled.withColumn("fold", F.expr(f"cast(pmod(xxhash64(doc_id), {FOLDS}L) as int)")).select("fold", "x", F.col("y").cast("double").alias("y"))
    width = DIMENSIONS + 2

    def sums(batches):
        own = np.zeros((FOLDS, DIMENSIONS + 1, width))
        for batch in batches:
            z, y, fold = model.features(_matrix(batch.column("x"))), np.asarray(batch.column("y")), np.asarray(batch.column("fold"))
            for k in range(FOLDS):
                zk = z[fold == k]
                own[k] += zk.T @ np.hstack([zk, y[fold == k][:, None]])
        flat = own.reshape(-1, width)
        rows = np.arange(len(flat))
        yield pa.RecordBatch.from_arrays([pa.array(rows // (DIMENSIONS + 1), pa.int32()), pa.array(rows % (DIMENSIONS + 1), pa.int32()), pa.array(list(flat), pa.list_(pa.float64()))], ["fold", "i", "v"])

    summed = folded.mapInArrow(sums, "fold int, i int, v array<double>").groupBy("fold", "i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v"))
    parts = np.zeros((FOLDS, DIMENSIONS + 1, width))
    for row in summed.collect():
        parts[row["fold"], row["i"]] = row["v"]
    total = parts.sum(axis=0)
    model.weights = _solve(total)
    outside = np.array([_solve(total - part) for part in parts])

    def binned(batches):
        for batch in batches:
            z, fold = model.features(_matrix(batch.column("x"))), np.asarray(batch.column("fold"))
            raw = (z * outside[fold]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)), pa.array(raw), batch.column("y")], ["bin", "raw", "y"])

    bins = folded.mapInArrow(binned, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("w")).orderBy("bin").collect()
    model.xs, model.ys = isotonic(np.array([r["x"] for r in bins]), np.array([r["y"] for r in bins]), np.array([float(r["w"]) for r in bins]))
    return model


def _known(labels: DataFrame, label: str) -> DataFrame:
    return labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & learnable("__id"))


def _described(docs: DataFrame) -> DataFrame:
    return materialise(docs.select("doc_id", "text").mapInArrow(_statistics, "doc_id long, x array<double>"))


def _fit(described: DataFrame, labels: DataFrame, label: str) -> Model:
    return fit(materialise(described.join(_known(labels, label), F.col("doc_id") == F.col("__id")).select("doc_id", "x", "y")))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out and score for each row of docs (doc_id, text), learnt from labels (doc_id, label)."""
    described = _described(docs)
    model = _fit(described, labels, label)

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], ["doc_id", "score"])

    return described.mapInArrow(scored, "doc_id long, score double").select("doc_id", (~learnable()).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is at least `least`; texts stay where they are read."""
    model = _fit(_described(docs), labels, label)

    def kept(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py()) for t in batch.column("text")])
                yield batch.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(kept, docs.schema)


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
