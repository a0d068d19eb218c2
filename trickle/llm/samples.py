"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trickle.llm.common import stage


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int
) -> DataFrame:
    """At most ``most`` rows (text, label) of ``docs`` whose doc_id has a
    label and meets ``train`` (a condition on doc_id): those with the
    smallest hashes of doc_id, so the same at every run. The ids are bounded
    by ``most``, so they are broadcast and texts are not exchanged."""
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        .withColumnRenamed("doc_id", "_id")
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return found.select("text", F.col("_label").alias("label"))


def balanced_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int
) -> tuple[DataFrame, float]:
    """At most ``most`` different texts (text, label) of ``docs`` whose doc_id
    has a label and meets ``train``: half of either label, more of the one
    where the other has fewer, those with the smallest hashes of doc_id and
    text; equal texts of a label count once. And by how much the sample's
    log-odds of label 1 exceed those of all labelled texts.

    Labels meet the documents first, by id and a hash of the text, so the
    bound holds for rows; the chosen pairs are bounded by ``most``, so they
    are broadcast, and no other text is exchanged."""
    keys = docs.select("doc_id", F.xxhash64("text").alias("_text")).join(
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
        .groupBy("doc_id").agg((F.max(label) == 1).alias("_label")),
        "doc_id",
    ).groupBy("_text", "_label").agg(F.min("doc_id").alias("_id"))
    keys = stage(keys, "labelled")
    there = {r["_label"]: r["count"] for r in keys.groupBy("_label").count().collect()}
    ones, others = there.get(True, 0), there.get(False, 0)
    n1 = min(ones, max(most // 2, most - others))
    n0 = min(others, most - n1)
    order = [F.xxhash64("_id", "_text"), "_id", "_text"]
    chosen = (
        keys.where("_label").orderBy(*order).limit(n1)
        .unionAll(keys.where("NOT _label").orderBy(*order).limit(n0))
    )
    match = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), match)
    found = found.select("text", F.col("_label").cast("int").alias("label"), "_id", "_text").dropDuplicates(
        ["_id", "_text", "label"]).select("text", "label")
    shift = math.log(n1 / n0) - math.log(ones / others) if n1 and n0 else 0.0
    return found, shift


def fit_logistic(x, y, rounds: int = 100, ridge: float = 0.1):
    """Weights of a ridge logistic regression of ``y`` on the columns of
    ``x`` and a constant (last), by Newton steps halved until they help."""
    import numpy as np

    x = np.hstack([np.asarray(x, float).reshape(len(y), -1), np.ones((len(y), 1))])
    y = np.asarray(y, float)
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * (w @ w))

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        while loss(w - step) > now and np.abs(step).max() > 1e-10:
            step /= 2
        w = w - step
        before, now = now, loss(w)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return w
