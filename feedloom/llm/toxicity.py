"""Toxicity by cumulative-link ordinal regression.

A document's grade y in 0..3 has P(y >= k) = 1 / (1 + exp(theta_k - w.x)): one weight for each
word feature, shared by all thresholds, and ordered thresholds theta_1 <= theta_2 <= theta_3.
The labels say only whether a document is toxic, so the toxic ones are graded first: a
one-threshold model is fitted, and its scores' thirds are the grades 1 to 3.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import WORDS, collected, hashed_sample, materialize, slices, table, unused, utf8

GRADES = 3
#: Labelled rows that the model is fitted on, chosen by hash of the id: the only bounded part.
FIT_ROWS = 20_000
#: Weight of the absolute-value penalty, most steps of the fit, and the share of the loss that
#: ``PATIENCE`` steps must take off for its last round to go on.
PENALTY, STEPS, GAIN, PATIENCE = 5e-5, 400, 1e-5, 20
#: Features that a fit begins with, and how often it may take in more.
FIRST, ROUNDS = 2048, 10


@dataclass
class OrdinalModel:
    """Weights by word, the ordered thresholds, and P(y >= 1) from which to reject.  Without
    thresholds all grades are 0."""

    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    reject: float = 0.5

    def margin(self, text: bytes | None) -> float:
        words = set((text or b"").translate(WORDS).split())
        return sum(self.weights[w] for w in sorted(words & self.weights.keys()))

    def at_least(self, margins: np.ndarray) -> np.ndarray:
        """P(y >= 1), P(y >= 2), ... in columns."""
        return sigmoid(margins[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(row: np.ndarray, col: np.ndarray, n: int, features: int, grade: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of highest penalised likelihood.  ``row``, ``col`` are the features
    that are present.

    The fit begins with the ``FIRST`` features that tell best and takes in those that pull harder
    than the penalty at its end, until there are none: what is outside then has weight 0.  What
    ends with weight 0 leaves, and comes back if it pulls.  The first rounds end early.
    """
    weight, count = np.zeros(features), np.bincount(col, minlength=features)
    share = np.array([(grade >= k).mean() for k in range(1, top + 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.log((1 - share) / share)
    seen = np.bincount(col, weights=(grade > 0)[row].astype(float), minlength=features)
    rate = np.log((seen + 0.5) / (share[0] * n + 1)) - np.log((count - seen + 0.5) / ((1 - share[0]) * n + 1))
    active = np.zeros(features, bool)
    active[np.argsort(-np.abs(rate) * np.sqrt(count), kind="stable")[:FIRST]] = True
    for k in range(ROUNDS):
        gain = max(GAIN, 0.01 ** (k + 1))
        own = active[col]
        names = np.flatnonzero(active)
        part, theta = _fit(row[own], np.searchsorted(names, col[own]), n, weight[names], theta, grade, top, gain)
        weight = np.zeros(features)
        weight[names] = part
        margin = np.bincount(row[own], weights=weight[col[own]], minlength=n)
        pull = _pull(margin, theta, grade)[0]
        slope = np.bincount(col, weights=pull[row], minlength=features) / n
        more = ~active & (np.abs(slope) > 1.01 * PENALTY)
        if gain == GAIN and not more.any():
            break
        active = (weight != 0) | more
    return weight, theta


def _groups(key: np.ndarray, n: int):
    """Order of the entries by key, and a function that sums values in that order for each key."""
    order, size = np.argsort(key, kind="stable"), np.bincount(key, minlength=n)
    some, first = size > 0, np.cumsum(size) - size

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(values):
            out[some] = np.add.reduceat(values, first[some])
        return out

    return order, sums


def _pull(margin: np.ndarray, theta: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope of each row's log-likelihood along its margin, P(y >= k), and P(y = grade)."""
    n = len(margin)
    reach = np.column_stack([np.ones(n), sigmoid(margin[:, None] - theta), np.zeros(n)])
    here, above = reach[np.arange(n), grade], reach[np.arange(n), grade + 1]
    return 1 - here - above, reach, np.maximum(here - above, 1e-12)


def _fit(row: np.ndarray, col: np.ndarray, n: int, weight: np.ndarray, theta: np.ndarray, grade: np.ndarray, top: int, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """By accelerated proximal steps from ``weight`` and ``theta``; a step is scaled for each
    feature by how many rows have it.  Ends when ``PATIENCE`` steps take less than the share
    ``gain`` off the penalised loss."""
    features, theta = len(weight), theta.copy()
    count = np.bincount(col, minlength=features)
    widest = max(1.0, np.bincount(row, minlength=n).mean() * 2) if len(row) else 1.0
    step = 4.0 / np.maximum(count / n * widest, 1e-9)
    by_row, row_sums = _groups(row, n)
    by_col, col_sums = _groups(col, features)
    col_of, row_of = col[by_row], row[by_col]
    at, last, pace, losses = weight, weight, 1.0, []
    for _ in range(STEPS):
        pull, reach, chance = _pull(row_sums(at[col_of]), theta, grade)
        losses.append(PENALTY * np.abs(at).sum() - np.log(chance).mean())
        if len(losses) > 2 * PATIENCE and min(losses[-PATIENCE:]) > (1 - gain) * min(losses[:-PATIENCE]):
            break
        slope = col_sums(pull[row_of]) / n
        moved = at + step * slope
        weight = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        density = reach * (1 - reach)
        for k in range(1, top + 1):
            push = np.where(grade == k, -density[:, k] / chance, 0) + np.where(grade == k - 1, density[:, k] / chance, 0)
            theta[k - 1] += push.mean() / max(density[:, k].mean(), 1e-3) * 0.5
        theta = np.maximum.accumulate(theta)
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        at, last, pace = weight + (pace - 1) / after * (weight - last), weight, after
    return weight, theta


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def distinct_words(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.binary())
    each = ([list(set((t or b"").translate(WORDS).split())) for t in utf8(part)] for part in slices(text))
    return collected((pa.array(x, kind) for x in each), kind)


def feature_numbers(names: list[bytes]):
    """UDF: words -> the positions in ``names`` of those that are there, in order."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def number(words: pa.Array) -> pa.Array:
        at = {w: k for k, w in enumerate(names)}
        kind = pa.list_(pa.int32())
        each = ([sorted(at[w] for w in row if w in at) for row in part.to_pylist()] for part in slices(words))
        return collected((pa.array(x, kind) for x in each), kind)

    return number


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fits on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``, at most ``fit_rows`` of them.

    Null labels and labels without a document are left out; a document labelled twice counts as
    toxic if any label says so.  With no toxic or no clean row the model grades all 0.  Word
    counts are taken on the cluster; the driver gets the words of the bounded rows as numbers.
    Every word of theirs is a feature, but for those in so few rows that the penalty outweighs
    them at any weight: a word in n rows pulls with n / rows at most.
    """
    from pyspark.sql.functions import broadcast

    known = labels.where("doc_id is not null and toxic is not null")
    chosen = hashed_sample(known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), fit_rows, "doc_id")
    rows = docs.select("doc_id", "text").join(broadcast(chosen), "doc_id").select("doc_id", "toxic", distinct_words("text").alias("words"))
    rows = materialize(rows, "labelled-words")
    total, toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic or toxic == total:
        return OrdinalModel()
    seen = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    names = sorted(seen.where(F.col("n") > PENALTY * total).select("word").toArrow().column("word").to_pylist())
    # numbers in arrays, not objects: the rows are bounded, and so is what the driver holds
    kept = rows.select("doc_id", "toxic", feature_numbers(names)("words").alias("features")).toArrow().sort_by("doc_id")
    y = kept.column("toxic").to_numpy()
    lists = kept.column("features").combine_chunks()
    row = np.repeat(np.arange(len(y)), pc.list_value_length(lists).to_numpy())
    col = lists.flatten().to_numpy().astype(np.int64)
    del kept, lists
    weight, _ = fit_ordinal(row, col, len(y), len(names), y, 1)
    margin = np.bincount(row, weights=weight[col], minlength=len(y))
    cuts = np.quantile(margin[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, margin, side="right"), 0)
    weight, theta = fit_ordinal(row, col, len(y), len(names), grade, GRADES)
    margin = np.bincount(row, weights=weight[col], minlength=len(y))
    cut = best_cut(margin, y == 1)
    return OrdinalModel({w: float(v) for w, v in zip(names, weight) if v}, theta, float(sigmoid(np.array(cut - theta[0]))))


def best_cut(margin: np.ndarray, toxic: np.ndarray) -> float:
    """The margin from which to reject: where the shares of toxic and of clean rows that it gets
    right sum highest, half way to the next lower margin."""
    values = np.unique(margin)
    at = np.searchsorted(values, margin)
    bad, good = (np.bincount(at, weights=m, minlength=len(values)) / m.sum() for m in (toxic, ~toxic))
    right = bad[::-1].cumsum()[::-1] + np.r_[0, good.cumsum()[:-1]]
    k = len(values) - 1 - int(np.argmax(right[::-1]))
    return float((values[k] + values[k - 1]) / 2) if k else float(values[0])


SEVERITY = T.StructType([T.StructField("expected_severity", T.DoubleType()), T.StructField("toxic_probability", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("rejected", T.BooleanType())])


def severity(model: OrdinalModel):
    """UDF: text -> expected severity, P(y >= 1), the likeliest grade and whether to reject."""

    @F.arrow_udf(SEVERITY)
    def score(text: pa.Array) -> pa.Array:
        margins = np.array([model.margin(t) for t in utf8(text)])
        reach = model.at_least(margins)
        if not reach.shape[1]:
            reach = np.zeros((len(margins), 1))
        bounds = np.column_stack([np.ones(len(margins)), reach, np.zeros(len(margins))])
        grade = np.argmax(bounds[:, :-1] - bounds[:, 1:], axis=1).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(reach.sum(axis=1)), pa.array(reach[:, 0]), pa.array(grade), pa.array(reach[:, 0] >= model.reject)], SEVERITY.fieldNames())

    return score


def with_severity(docs: DataFrame, model: OrdinalModel, name: str = "severity") -> DataFrame:
    """Adds the struct ``name``; a null, empty or unknown-worded text scores by the thresholds
    alone.  No row moves, rows stay as they are.  The grades 1 to 3 are thirds of the fitted toxic
    rows by a one-threshold model's score, since labels do not grade; so expected severity
    orders texts, and its unit is a third."""
    return docs.withColumn(name, severity(model)("text"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the fitted model does not reject, as they are, with all their columns.
    Documents without text or id are judged like any; repeated rows each."""
    (name,) = unused(docs, "_severity")
    return with_severity(docs, train(docs, labels), name).where(~F.col(f"{name}.rejected")).drop(name)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_severity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "severity.*")
