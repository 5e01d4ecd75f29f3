"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A document's own evidence is the log-odds of a logistic model of its text's surface (shares of character classes and of
their successions, word lengths, repetition), fitted in numpy on a bounded sample of labelled documents. The evidence of
all documents is then summed by host and path in one partially aggregated group: each path's mean quality is shrunk towards
its host's, each host's towards the global mean, with prior strengths estimated from the spread of the groups (method of
moments), so that sparse sites stay near the prior above them. The path's posterior replaces the global prior in the
document's odds, and documents below THRESHOLD are rejected.

Groups' totals are joined back by (host, path); nothing is collected but two totals and the labelled sample.

Defined results: a null text is empty; null hosts and paths are groups of their own; rows that repeat an id are scored one
by one; labels of ids that no document has, or null labels, are ignored; with no usable labels of both kinds the evidence is
0 for every document and all are kept; extra columns are not read (scores) or kept (filter); an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import materialize, small_batches, trim

#: Labelled documents that the model is fitted on at most (those with the least hash of their id).
SAMPLE = 6000
THRESHOLD, STEPS, RIDGE = 0.5, 30, 1.0
# character classes: other letters of ASCII, upper case, digit, blank, line end, sentence mark, bracket or quote, other mark, beyond ASCII
_KINDS = 9


def _class_table() -> np.ndarray:
    t = np.full(256, 7, np.uint8)
    for c in range(256):
        ch = chr(c)
        if c >= 128:
            t[c] = 8
        elif ch.islower():
            t[c] = 0
        elif ch.isupper():
            t[c] = 1
        elif ch.isdigit():
            t[c] = 2
        elif ch in " \t":
            t[c] = 3
        elif ch in "\r\n":
            t[c] = 4
        elif ch in ".,;:?":
            t[c] = 5
        elif ch in "()[]\"'-":
            t[c] = 6
    return t


_TABLE = _class_table()


def features(texts: list[str | None]) -> np.ndarray:
    """One row of surface features per text; whole texts."""
    out = np.zeros((len(texts), _KINDS * _KINDS + _KINDS + 6))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            continue
        kind = _TABLE[np.frombuffer(raw, np.uint8)]
        n = len(raw)
        pair = np.bincount(kind[:-1] * np.uint8(_KINDS) + kind[1:], minlength=_KINDS * _KINDS)
        single = np.bincount(kind, minlength=_KINDS)
        words = raw.split()
        total = max(1, len(words))
        unique = len(set(words))
        lines = raw.split(b"\n")
        repeated = sum(a == b for a, b in zip(words, words[1:]))
        out[i, : _KINDS * _KINDS] = np.sqrt(pair / n)
        out[i, _KINDS * _KINDS : -6] = np.sqrt(single / n)
        out[i, -6:] = (np.log1p(n), unique / total, np.log1p(unique) / np.log1p(total), repeated / total, min(20.0, n / total) / 20, len(set(lines)) / len(lines))
    return out


@dataclass
class Model:
    """Standardised logistic regression; weights of length zero mean no evidence (log-odds 0)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept
    prior: float  # log-odds of good quality among the labels

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        x = (features(texts) - self.mean) / self.scale
        return np.clip(np.clip(x, -8, 8) @ self.weights[:-1] + self.weights[-1], -30, 30)


def fit(x: np.ndarray, good: np.ndarray) -> Model:
    """Ridge-penalised logistic regression of rows of features, by Newton steps."""
    y = np.asarray(good, float)
    if not len(y) or y.min() == y.max():
        return Model(np.empty(0), np.empty(0), np.empty(0), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    x = np.hstack((np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - penalty * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    share = y.mean()
    return Model(mean, scale, w, float(np.log(share / (1 - share))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most sample labelled documents (a bounded sample, by hash of the id)."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_good")).filter("_id is not null and _good is not null")
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_good").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    # texts stay on the executors: only features come back, SAMPLE rows of them
    got = rows.select("_id", F.xxhash64("_text").alias("_h"), "_good", _features("_text").alias("_x")).orderBy("_id", "_h", "_good").toPandas()
    x = np.array(got["_x"].tolist()) if len(got) else np.empty((0, 1))
    return fit(x, got["_good"].to_numpy() > 0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(text: pd.Series) -> pd.Series:
    out = pd.Series(list(features(text.tolist())))
    trim()
    return out


def _evidence(model: Model):
    @F.pandas_udf(T.DoubleType())
    def evidence(text: pd.Series) -> pd.Series:
        out = pd.Series(model.log_odds([t if isinstance(t, str) else None for t in text]))
        trim()
        return out

    return evidence


def _logit(p):
    return F.log(p / (F.lit(1.0) - p))


def group_posteriors(scored: DataFrame) -> DataFrame:
    """Of rows (host, path, p: probability of good quality) one row per (host, path): n, host_mean, path_mean (shrunk
    means) and global_mean.

    Strengths (in documents) are the binomial spread over the spread between groups beyond it, from 1 to 10000."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))

    def strength(groups: DataFrame, n: str, good: str, towards: str):
        """Method of moments over the groups' means around what lies above them."""
        m = F.col(towards)
        within = m * (1 - m)
        moments = groups.agg(
            F.sum(F.pow(F.col(good) - F.col(n) * m, F.lit(2.0)) / F.col(n)).alias("q"), F.sum(within).alias("w"),
            F.sum(F.col(n)).alias("t"), F.sum(F.pow(F.col(n), F.lit(2.0))).alias("t2"), F.count("*").alias("k"), F.avg(within).alias("b"),
        )
        spread = F.greatest(F.lit(1e-12), (F.col("q") - F.col("w")) / F.greatest(F.lit(1e-9), F.col("t") - F.col("t2") / F.col("t")))
        return moments.select(F.coalesce(F.least(F.lit(10_000.0), F.greatest(F.lit(1.0), F.col("b") / spread)), F.lit(100.0)).alias("strength"))

    total = hosts.agg((F.sum("host_good") / F.sum("host_n")).alias("global_mean"))
    up = hosts.crossJoin(F.broadcast(total))  # one row
    up = up.crossJoin(F.broadcast(strength(up, "host_n", "host_good", "global_mean")))
    up = up.withColumn("host_mean", (F.col("host_good") + F.col("strength") * F.col("global_mean")) / (F.col("host_n") + F.col("strength"))).drop("strength")
    down = paths.join(up.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    down = down.crossJoin(F.broadcast(strength(down, "n", "good", "host_mean")))
    mean = (F.col("good") + F.col("strength") * F.col("host_mean")) / (F.col("n") + F.col("strength"))
    return down.select("host", "path", "n", "host_mean", mean.alias("path_mean"), "global_mean")


def _posterior(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (host, path, evidence, ...) with path_mean, log_odds and quality."""
    g = groups.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "host_mean", "path_mean", "global_mean")
    out = rows.join(g, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p"))).drop("_h", "_p")
    inner = lambda c: _logit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c)))
    shift = F.coalesce(inner("path_mean") - inner("global_mean"), F.lit(0.0))
    return out.withColumn("log_odds", F.col("_evidence") + shift).withColumn("quality", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("log_odds"))))


def scores(docs: DataFrame, model: Model, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, evidence (log-odds of the text alone), host_mean, path_mean, quality (posterior probability) and keep of every row."""
    small_batches(docs.sparkSession)
    one = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(path_col).alias("_path"), _evidence(model)(F.col(text_col).cast("string")).alias("_evidence"))
    one = materialize(one, "evidence")
    groups = group_posteriors(one.select(F.col("_host").alias("host"), F.col("_path").alias("path"), _chance("_evidence").alias("p")))
    out = _posterior(one, materialize(groups, "sites"))
    return out.select(F.col("_id").alias(id_col), F.col("_evidence").alias("evidence"), "host_mean", "path_mean", "quality", (F.col("quality") >= threshold).alias("keep"))


def _chance(c: str):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(c)))


def keep_good(docs: DataFrame, model: Model, host_col: str = "source", path_col: str = "lang", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose posterior quality reaches threshold. Texts are read twice and never shuffled
    unless the sites' table is too large to broadcast."""
    small_batches(docs.sparkSession)
    evidence = _evidence(model)(F.col(text_col).cast("string"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-evidence))
    groups = materialize(group_posteriors(docs.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), p.alias("p"))), "sites")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(host_col).alias("_host"), F.col(path_col).alias("_path"), evidence.alias("_evidence"))
    return _posterior(rows, groups).filter(F.col("quality") >= threshold).select("_row.*")
