"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import column, cut, documents, fold, hash_below, lean, slices, small

#: Characters counted one by one, as shares of the text.
SIGNS = "!|#$%&*.,;:?\"'()-_/@=<>+"
N_FEATURES = len(SIGNS) + 16


def features(text: str) -> list[float]:
    """Shape of a whole text: lengths, cases, signs, repetition of words and lines."""
    n, words, lines = len(text), text.split(), text.split("\n")
    nw, nl, n1 = len(words), len(lines), max(1, len(text))
    distinct = len(set(words))
    raw = np.bincount(np.frombuffer(text.encode(errors="replace"), np.uint8), minlength=256)
    upper, lower, digit = int(raw[65:91].sum()), int(raw[97:123].sum()), int(raw[48:58].sum())
    out = [raw[ord(c)] / n1 for c in SIGNS]
    out += [np.log1p(n), np.log1p(nw), (n - nw) / max(1, nw), upper / max(1, upper + lower), digit / n1, raw[10] / n1, raw[128:].sum() / n1]
    out += [sum(map(str.isupper, words)) / max(1, nw), sum(map(str.istitle, words)) / max(1, nw), sum(map(str.isalpha, words)) / max(1, nw)]
    out += [distinct / max(1, nw), np.log1p(distinct) / max(1.0, np.log1p(nw)), sum(map(eq, words, words[1:])) / max(1, nw)]
    out += [len(set(lines)) / nl, np.log1p(nw / nl), max(map(len, words), default=0) ** 0.5]
    return out


@dataclass
class QualityModel:
    """Additive logistic model over feature bins; without weights every score is the prior."""

    prior: float
    edges: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0

    def design(self, x: np.ndarray) -> np.ndarray:
        """Steps at each feature's edges, as -1 or 1."""
        return np.where(x[:, :, None] > self.edges[None], 1.0, -1.0).reshape(len(x), -1).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        z = self.design(x) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-z.astype(np.float64)))


def nnpu_gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the non-negative risk by the logits of the positives and of the unlabelled rows, as fit_nnpu steps along it."""
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    gp, gu = -prior * sp / len(zp), su / len(zu)
    if np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean():
        return gp - prior * (1 - sp) / len(zp), gu
    return -gp, -gu


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, n_edges: int = 12, steps: int = 400, rate: float = 0.03, decay: float = 1e-3, corrected: bool = True) -> QualityModel:
    """Minimise prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]) for the logistic loss l by Adam.

    Where the part in max() is below 0, the step goes against that part alone. Without `corrected` the
    unlabelled rows count as negatives: what is minimised then tells positives from unlabelled rows.
    """
    if not len(positive) or not len(unlabelled):
        return QualityModel(prior)
    both = np.concatenate([positive, unlabelled])
    edges = np.quantile(both, np.linspace(0.02, 0.98, n_edges), axis=0).T
    model = QualityModel(prior, edges, np.zeros(edges.size, np.float32), float(np.log(prior / (1 - prior))))
    p, u = model.design(positive), model.design(unlabelled)
    w, bias, m, v = model.weights, model.bias, np.zeros(edges.size + 1), np.zeros(edges.size + 1)
    for t in range(1, steps + 1):
        zp, zu = p @ w + bias, u @ w + bias
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        gp, gu = nnpu_gradient(zp, zu, prior) if corrected else (-prior * (1 - sp) / len(p), (1 - prior) * su / len(u))
        grad = np.append(p.T @ gp.astype(np.float32) + u.T @ gu.astype(np.float32) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = (w - step[:-1]).astype(np.float32), bias - step[-1]
    model.weights, model.bias = w, float(bias)
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: int = 50) -> float:
    """Share of positives among the unlabelled, from the scores of both by a classifier that tells them apart.

    Above any score at which the classifier finds no negative, the unlabelled rows are the prior's share of the positives.
    So the prior is the least ratio of the two shares above a score (best bin estimation), each with its sampling error added; scores that fewer than
    `least` positives reach count for nothing. It is within 0.01 to 0.99.
    """
    cuts = np.sort(positive)[: max(1, len(positive) - least + 1)]
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    slack = np.sqrt(np.log(20) / 2) * (1 / math.sqrt(len(positive)) + 1 / math.sqrt(len(unlabelled)))
    at = int(np.argmin((u + slack) / p))
    return float(np.clip(u[at] / p[at], 0.01, 0.99))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: int = 50) -> float | None:
    """class_prior by two classifiers, each fitted to one half of the rows and read on the other; the smaller, as such estimates err upward. None for too few rows."""
    if len(positive) < 2 * least or len(unlabelled) < 2 * least:
        return None
    found = []
    for i in (0, 1):
        model = fit_nnpu(positive[i::2], unlabelled[i::2], 0.5, corrected=False)
        found.append(class_prior(model.score(positive[1 - i :: 2]), model.score(unlabelled[1 - i :: 2]), least))
    return min(found)


def _featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pa.array([features(t or "") for t in column(batch, "text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], x], [*keep, "x"])

    return docs.mapInArrow(run, ", ".join([*[f"`{c}` {fields[c]}" for c in keep], "x array<double>"]))


def refined(model: QualityModel, positive: np.ndarray, unlabelled: DataFrame, steps: int = 8, rate: float = 0.01, decay: float = 1e-3) -> QualityModel:
    """The model after a few more steps of fit_nnpu whose unlabelled part is summed by Spark over all rows of `unlabelled` (x).

    A step is a pass over the features, of which each task gives one sum a weight; summed by weight they are as many numbers as the model has.
    """
    if model.weights is None:
        return model
    w, bias, p = model.weights, model.bias, model.design(positive)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        now = QualityModel(model.prior, model.edges, w, bias)

        @lean
        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now.weights) + 3)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, N_FEATURES)
                for a in range(0, len(x), 4096):
                    u = now.design(x[a : a + 4096])
                    z = (u @ now.weights + now.bias).astype(np.float64)
                    su = 1 / (1 + np.exp(-z))
                    total += np.concatenate([u.T @ su.astype(np.float32), [su.sum(), np.logaddexp(0, z).sum(), len(u)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["place", "n"])

        rows = unlabelled.select("x").mapInArrow(sums, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(len(w) + 3)
        total[rows["place"]] = rows["n"]
        n = total[-1]
        if not n:
            return model
        zp = p @ w + bias
        sp = 1 / (1 + np.exp(-zp))
        gp, gu = -model.prior * sp / len(p), total[: len(w) + 1] / n
        if total[-2] / n >= model.prior * np.logaddexp(0, zp).mean():
            gp = gp - model.prior * (1 - sp) / len(p)
        else:
            gp, gu = -gp, -gu
        grad = np.append(p.T @ gp.astype(np.float32), gp.sum()) + gu + np.append(decay * w, 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = (w - step[:-1]).astype(np.float32), float(bias - step[-1])
    return QualityModel(model.prior, model.edges, w, bias)


def learn_quality(docs: DataFrame, labels: DataFrame, rows: int = 12_000, seed: int = 3) -> QualityModel:
    """Learn from docs (doc_id, text) and labels (doc_id, quality), both already the training rows.

    Trusted positives are documents with label 1, the unlabelled ones any documents, label
    or none. About `rows` of each come to the driver: trusted doc_ids by a hash, of whose several texts one counts, and unlabelled rows by a hash of
    doc_id and text, of which those repeated as a whole count once. A model of those two is where
    the fit over all unlabelled rows begins (refined), whose features are worked out once. The class prior is
    estimated from the two samples alone (estimated_prior), and where it can't be it is the share of 1 among the labels,
    with one more of each. Of a doc_id's several labels the greatest counts; null labels and labels without a document count for nothing.
    Without documents or positives every score is that share.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.agg(F.sum((F.col("quality") == 1).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    total = docs.count()
    prior = ((n["p"] or 0) + 1) / (n["n"] + 2)
    if not n["p"] or not total:
        return QualityModel(prior)
    trusted = known.where((F.col("quality") == 1) & hash_below(F.col("doc_id"), rows / n["p"], seed)).select("doc_id", F.lit(True).alias("p"))
    hashed = docs.withColumn("h", F.xxhash64("text"))
    sample = hashed.join(small(trusted, 16), "doc_id", "left").withColumn("p", F.coalesce("p", F.lit(False))).withColumn("u", hash_below(F.struct("doc_id", "h"), rows / total, seed + 1))
    every = cut(_featured(sample, ["doc_id", "h", "p", "u"]))
    # a row a trusted doc_id and one a picked text, however many rows share a doc_id or a text
    chosen = every.where("p").groupBy("doc_id").agg(F.min_by("x", "h").alias("x")), every.where("u").dropDuplicates(["doc_id", "h"])
    found = [np.array(df.select("x").toPandas()["x"].tolist()).reshape(-1, N_FEATURES) for df in chosen]
    positive, unlabelled = (x[np.lexsort(x.T)] for x in found)  # whatever order the rows came in
    return refined(fit_nnpu(positive, unlabelled, estimated_prior(positive, unlabelled) or prior), positive, every)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted (1 from `threshold` on) of each row, from the whole text alone (null: empty).

    Equal texts have equal scores, repeated rows repeated results; other columns are left out; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t or "") for t in column(batch, "text").to_pylist()]).reshape(batch.num_rows, N_FEATURES)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["key", "score", "predicted"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    seen = fold(F.col("doc_id")) != 0
    model = learn_quality(docs.where(seen), labels.where(seen))
    return score_quality(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
