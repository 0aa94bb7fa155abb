"""Toxicity by non-negative positive-unlabelled learning of a linear numpy classifier."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, c, in_fold, map_batches, stored

# Bounds of the fit; scoring has none.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 4_000, 8_000, 20_000
LEAST_Z, LEAST_DOCS, LEAST_SHARE = 4.0, 4, 0.5
TOKEN = re.compile(r"\w+")
STEMS = (4, 5)


def tokens(text: str | None) -> set[str]:
    """The distinct words of a text, lower case, and their first letters (marked by a star).

    Stems tell of inflected forms that the sample did not hold.
    """
    found = set(TOKEN.findall((text or "").lower()))
    stems = [{w[:n] + "*" for w in found if len(w) > n} for n in STEMS]
    return found.union(*stems)


@dataclass
class ToxicityModel:
    """score(text) = sigmoid(bias + sum of the weights of the text's distinct known features)."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        known = self.weights.keys() & tokens(text)
        z = self.bias + sum(sorted(self.weights[w] for w in known))
        return float(1.0 / (1.0 + np.exp(-min(60.0, max(-60.0, z)))))


def _margins(flat: np.ndarray, owner: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    return np.bincount(owner, weights=w[flat], minlength=n)


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], features: int, prior: float, *,
    steps: int = 400, rate: float = 0.1, penalty: float = 1e-4, beta: float = 0.0, gamma: float = 1.0,
) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise the non-negative PU risk with the logistic loss.

    The risk of the negative class is estimated as that of the unlabelled texts taken as
    negative minus *prior* times that of the positives taken as negative. While that
    estimate is below -beta it is pushed up again instead of being followed down, so the
    classifier can't profit from memorising positives among the unlabelled. Full-batch
    Adam; each row is the array of a text's feature numbers.
    """
    def flat(rows):
        return (np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64),
                np.repeat(np.arange(len(rows)), [len(r) for r in rows]))

    (pf, po), (uf, uo) = flat(positive), flat(unlabelled)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    w, b = np.zeros(features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(features + 1), np.zeros(features + 1)

    def gradient(flat_, owner, per_row):
        return np.append(np.bincount(flat_, weights=per_row[owner], minlength=features), per_row.sum())

    for step in range(1, steps + 1):
        gp, gu = _margins(pf, po, n_p, w) + b, _margins(uf, uo, n_u, w) + b
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -60, 60))), 1 / (1 + np.exp(-np.clip(gu, -60, 60)))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        as_negative = gradient(uf, uo, su / n_u) - prior * gradient(pf, po, sp / n_p)
        if negative < -beta:
            g = -gamma * as_negative
        else:
            g = prior * gradient(pf, po, (sp - 1) / n_p) + as_negative
        g[:-1] += penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return float(b), w


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, held_out: tuple[int, int] = (3, 1), max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES,
) -> ToxicityModel:
    """Learn from confirmed toxic texts and unlabelled ones; rows of the held-out fold are not looked at.

    The class prior is the share of toxic among all labelled rows outside the fold (a
    corpus count). The classifier is fitted on the *max_positive* toxic and
    *max_unlabelled* other documents that come first by a hash of the id. Features
    are the words and stems whose share of texts differs between the two by *LEAST_Z*
    standard errors and that point to toxic texts in at least *LEAST_SHARE* of cases. Without toxic rows nothing is learned: every score is the prior.
    """
    use = ~in_fold(F.col("doc_id"), *held_out)
    marks = (
        labels.filter(use).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .filter("doc_id is not null and toxic is not null"))
    counts = marks.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not counts[0] or not counts[1]:
        return ToxicityModel(-60.0)
    prior = min(0.5, max(1e-4, counts[1] / counts[0]))
    chosen = (
        bounded_sample(marks.filter("toxic = 1").select("doc_id"), "doc_id", max_positive).withColumn("p", F.lit(1))
        .unionByName(bounded_sample(
            docs.filter(use & F.col("doc_id").isNotNull()).select("doc_id"), "doc_id", max_unlabelled)
            .withColumn("p", F.lit(0))))
    # at most max_positive + max_unlabelled ids
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("p", "text")

    def run(batch: pa.RecordBatch) -> dict:
        return {"p": batch.column(0), "words": [sorted(tokens(t)) for t in batch.column(1).to_pylist()]}

    rows = stored(map_batches(sample, run, "p int, words array<string>", rows=64), "toxic-sample")
    sizes = dict(rows.groupBy("p").count().collect())
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return ToxicityModel(float(np.log(prior / (1 - prior))))
    pooled = (F.col("k_p") + F.col("k_u")) / (n_p + n_u)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    table = (
        rows.select("p", F.explode("words").alias("word"))
        .groupBy("word").agg(F.sum("p").alias("k_p"), F.sum(1 - F.col("p")).alias("k_u"))
        .filter(F.col("k_p") + F.col("k_u") >= LEAST_DOCS)
        .withColumn("z", F.abs(F.col("k_p") / n_p - F.col("k_u") / n_u) / spread)
        .filter(f"z >= {LEAST_Z}")
        # the prior-corrected share of toxic texts among those with the word
        .filter(F.col("k_p") * (prior * n_u * (1 / LEAST_SHARE) / n_p) >= F.col("k_u"))
        .orderBy(F.desc("z"), "word").limit(max_features)
    )
    vocabulary = sorted(r.word for r in table.select("word").collect())
    number = {w: i for i, w in enumerate(vocabulary)}

    def known(batch: pa.RecordBatch) -> dict:
        return {"p": batch.column(0), "f": [
            [number[w] for w in ws if w in number] for ws in batch.column(1).to_pylist()]}

    seen = map_batches(rows, known, "p int, f array<int>").orderBy("p", "f").toArrow()
    flags, features = seen.column("p").to_pylist(), seen.column("f").to_pylist()
    split = {k: [np.array(f, np.int64) for p, f in zip(flags, features) if p == k] for k in (0, 1)}
    bias, weights = fit_nnpu(split[1], split[0], len(vocabulary), prior)
    return ToxicityModel(bias, {w: float(weights[i]) for w, i in number.items()})


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """row (a struct of all columns of *docs*), score and predicted; the whole text is scored, a NULL one as empty."""
    rows = docs.select(c("text").alias("text"), F.struct(*[c(n) for n in docs.columns]).alias("row"))

    def run(batch: pa.RecordBatch) -> dict:
        scores = [model.score(t) for t in batch.column(0).to_pylist()]
        return {"row": batch.column(1), "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    kind = rows.schema["row"].dataType.simpleString()
    return map_batches(rows, run, f"row {kind}, score double, predicted int")


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit_toxicity(docs, labels)
    return score_documents(docs.select("doc_id", "text"), model).select(
        "row.doc_id", in_fold(F.col("row.doc_id"), 3, 1).alias("held_out"), "score", "predicted")
