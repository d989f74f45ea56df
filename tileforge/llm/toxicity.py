"""Operator 3: toxicity by a classifier chain over word features.

Categories are predicted in a fixed order. Each has its own logistic model
over binary features of a text (its words and their first four letters) plus
the probabilities of the categories before it. While training, these earlier
probabilities are out-of-fold predictions: those of models that didn't see the
row, so that later models learn to weigh what they will meet on new texts.

The models are fitted on at most `MAX_TRAIN` labelled documents' rows, those of
smallest id hash, each category on the rows that have its label; the features
are the `MAX_FEATURES` whose presence differs most between the labels, counted
over these rows. Every text is scored whole.

`op3_toxicity_chain` chains the two labels that the table has: low quality
(quality = 0), then toxic. `fit_chain` takes any label columns.

Defined cases: null and empty texts have no features and are scored; a label
that is neither 0 nor 1, or without a document, is ignored; a category with
labels of one kind only, or none, gets a constant probability; an empty table
gives an empty table; repeated rows get equal scores; a text, however long, is
read whole and must fit in a worker with its distinct words; only doc_id and
text of the documents are read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table
from .quality_model import learnable

MAX_TRAIN = 20_000
#: The sample is bounded, so these tasks are enough at any size of the input.
TRAIN_TASKS = 12
MAX_FEATURES = 400
FOLDS = 4
RIDGE = 0.1
#: Characters of text whose features are held at a time.
STEP_CHARS = 1 << 20
_WORD = re.compile(r"[^\W\d_]+")
_PREFIX = 4


def features(text: str | None) -> set[str]:
    """Distinct lower-case words of letters, and the first letters (marked ^) of longer ones."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {"^" + w[:_PREFIX] for w in words if len(w) > _PREFIX}


def _present(batches):
    for batch in batches:
        for part in slices(batch, STEP_CHARS):
            rows = [sorted(features(t.as_py())) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, pa.list_(pa.string()))], [*part.schema.names[:-1], "features"])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression with a free last column (1), by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -12, 12)))


class Chain:
    """Feature numbers, and weights for each category in order: features, earlier probabilities, constant."""

    def __init__(self, categories: list[str], vocabulary: list[str]):
        self.categories, self.vocabulary = categories, {f: i for i, f in enumerate(vocabulary)}
        self.weights: list[np.ndarray] = []

    def predict(self, present: list[list[int]]) -> np.ndarray:
        """Probabilities, a row for each text."""
        found = np.zeros((len(present), len(self.categories)))
        n = len(self.vocabulary)
        for k, w in enumerate(self.weights):
            found[:, k] = _probability(np.array([w[p].sum() for p in present]) + found[:, :k] @ w[n:-1] + w[-1])
        return found


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], max_train: int = MAX_TRAIN) -> Chain:
    """docs: doc_id, text. labels: doc_id and a 0/1 column for each category."""
    known = labels.select(F.col("doc_id").alias("__id"), *[F.when(F.col(c).cast("int").isin(0, 1), F.col(c).cast("int")).alias(f"y{i}") for i, c in enumerate(categories)])
    known = known.where(learnable("__id")).where(" or ".join(f"y{i} is not null" for i in range(len(categories))))
    known = known.join(docs.select(F.col("doc_id").alias("__id")), "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    joined = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    ys = [f"y{i}" for i in range(len(categories))]
    schema = "doc_id long, " + ", ".join(f"{y} int" for y in ys) + ", features array<string>"
    rows = materialise(joined.select("doc_id", *ys, "text").repartition(TRAIN_TASKS).mapInArrow(_present, schema))
    totals = rows.agg(F.count("*").alias("n"), *[F.count(y).alias(f"n_{y}") for y in ys], *[F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys]).first()
    n = totals["n"]
    rate = {y: totals[y] / max(1, totals[f"n_{y}"]) for y in ys}
    counts = rows.select(F.explode("features").alias("f"), *ys).groupBy("f").agg(F.count("*").alias("c"), *[F.count(y).alias(f"c_{y}") for y in ys], *[F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys]).where("c > 1")
    ranked = F.greatest(F.lit(0.0), *[F.abs(F.col(y) - F.col(f"c_{y}") * rate[y]) / F.sqrt(F.col(f"c_{y}") * (rate[y] * (1 - rate[y])) + 1) for y in ys]) if n else F.lit(0.0)
    chosen = [r["f"] for r in counts.withColumn("z", ranked).orderBy(F.desc("z"), "f").limit(MAX_FEATURES).collect()]
    chain = Chain(categories, chosen)
    numbers = F.array_intersect("features", F.array(*[F.lit(f) for f in chosen])) if chosen else F.expr("cast(array() as array<string>)")
    sample = rows.select("doc_id", *ys, numbers.alias("features")).collect()
    width = len(chosen)
    x = np.zeros((n, width + 1))
    x[:, -1] = 1
    for i, row in enumerate(sample):
        x[i, [chain.vocabulary[f] for f in row["features"]]] = 1
    fold = np.array([(row["doc_id"] * 2654435761 >> 7) % FOLDS for row in sample], np.int64)
    outside = np.zeros((n, 0))
    for k, name in enumerate(ys):
        y = np.array([np.nan if row[name] is None else row[name] for row in sample], float)
        own = ~np.isnan(y)
        full = np.hstack([x[:, :-1], outside, x[:, -1:]])
        if not own.any() or y[own].min() == y[own].max():
            w = np.zeros(width + k + 1)
            w[-1] = math.copysign(12.0, y[own][0] - 0.5) if own.any() else 0.0
            chain.weights.append(w)
            outside = np.hstack([outside, np.full((n, 1), _probability(w[-1]))])
            continue
        chain.weights.append(_logistic(full[own], y[own]))
        earlier = np.full(n, y[own].mean())
        for part in range(FOLDS):
            here, rest = fold == part, (fold != part) & own
            if rest.any() and here.any():
                earlier[here] = _probability(full[here] @ _logistic(full[rest], y[rest]))
        outside = np.hstack([outside, earlier[:, None]])
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and one probability (p_<category>) for each category; all texts are read whole."""
    names = [f"p_{c}" for c in chain.categories]

    def scored(batches):
        number = chain.vocabulary
        for batch in batches:
            present = [[number[f] for f in features(t.as_py()) & number.keys()] for t in batch.column("text")]
            found = chain.predict(present)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(found[:, k]) for k in range(len(names))]], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, " + ", ".join(f"`{n}` double" for n in names))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    named = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    found = score(docs, fit_chain(docs, named, ["low_quality", "toxic"]))
    return found.select("doc_id", (~learnable()).alias("held_out"), F.col("p_low_quality").alias("low_quality"), F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"))
