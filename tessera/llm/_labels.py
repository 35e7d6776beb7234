"""Bounded samples of labelled texts to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import held_out


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, id: str = "doc_id", text: str = "text", modulus: int = 5, remainder: int = 0) -> tuple[list[tuple[str, int]], list[int]]:
    """Up to ``per_class`` texts of label 0 and as many of label 1, and how many labels of each there are.

    Only ids outside the held-out fold count.  Of several labels of an id the
    largest holds; null ids and labels are left out.  The ids with the lowest hash
    are taken, so the sample does not depend on partitions; sampled texts that are
    null, empty or longer than ``max_chars`` are then left out.
    """
    own = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(id, modulus, remainder)).groupBy(id).agg((F.max(label) > 0).cast("int").alias("label"))
    own = own.withColumn("h", F.xxhash64(F.col(id), F.lit(11)))
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = own.where("label = 0").orderBy("h").limit(per_class).unionByName(own.where("label = 1").orderBy("h").limit(per_class))
    found = (
        documents.select(id, text)
        .join(F.broadcast(ids), id)  # 2 * per_class rows at most
        .where((F.length(text) > 0) & (F.length(text) <= max_chars))
        .select("h", "label", F.col(text).alias("text"))
        .collect()
    )
    rows = sorted({(r["h"], r["label"], r["text"]) for r in found})
    return [(r[2], r[1]) for r in rows], [counts.get(0, 0), counts.get(1, 0)]


def logistic(x, y, w=None, steps: int = 60, ridge: float = 1e-2) -> tuple[list[float], float]:
    """Slopes and shift of the logistic curve through weighted 0/1 marks ``y`` at ``x`` (a row each), by Newton's method."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    x = x[:, None] if x.ndim == 1 else x
    w = np.ones_like(y) if w is None else np.asarray(w, float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    beta = np.zeros(z.shape[1])
    held = np.append(np.full(len(scale), ridge), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        curve = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(held + 1e-9)
        step = np.linalg.solve(curve, z.T @ (w * (p - y)) + held * beta)
        size = np.abs(step).max()
        beta -= step * min(1.0, 3.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    slopes = beta[:-1] / scale
    return [float(v) for v in slopes], float(beta[-1] - slopes @ mean)
