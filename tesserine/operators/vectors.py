"""Vector joins: pairs above a similarity, centroids and the nearest centroid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.runtime import ship


def canonical(vec):
    """Array of doubles rounded half-even to 8 places."""
    return F.transform(vec.cast("array<double>"), lambda x: F.bround(x, 8))


def similar_pairs(vectors: DataFrame, threshold: float, same_label: bool, parts: int = 16) -> DataFrame:
    """Pairs a < b (ids) whose cosine is at least threshold, of the same or of different labels: a, b, similarity.

    vectors: vec_id, embedding, label. Rows are dealt to `parts` salted blocks;
    each pair of blocks is one task's matrix product, so no label, however
    frequent, is one task's work. Only pairs above the threshold leave a task.
    Choose `parts` so that a part holds at most some 50,000 vectors; each row is
    sent to `parts` tasks. Null embeddings are in no pair.
    """
    ship(vectors.sparkSession)
    base = vectors.filter(F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"))
    # each row meets every part once: its own pair of parts is (smaller, larger)
    meets = base.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("cell", F.least("part", "other") * parts + F.greatest("part", "other"))

    def run(key, rows):
        table = rows.to_pandas()
        cell = int(key[0].as_py())
        lo, hi = divmod(cell, parts)
        out = {"a": [], "b": [], "similarity": []}
        left, right = table[table.part == lo], table[table.part == hi]
        for dim in set(map(len, left.v)) & set(map(len, right.v)):
            p, q = left[left.v.map(len) == dim], right[right.v.map(len) == dim]
            x, y = np.stack(p.v.to_list()), np.stack(q.v.to_list())
            norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(norm > 0, x @ y.T / norm, 0.0)
            s[~np.isfinite(s)] = 0.0
            same = p.label.to_numpy()[:, None] == q.label.to_numpy()[None, :]
            i, j = np.nonzero((s >= threshold) & (same if same_label else ~same))
            a, b = p.vec_id.to_numpy()[i], q.vec_id.to_numpy()[j]
            keep = a < b if lo == hi else np.ones(len(a), bool)
            a, b, v = a[keep], b[keep], s[i, j][keep]
            out["a"] += np.minimum(a, b).tolist()
            out["b"] += np.maximum(a, b).tolist()
            out["similarity"] += v.tolist()
        return pa.table(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())]))

    return meets.groupBy("cell").applyInArrow(run, "a long, b long, similarity double")


def centroids(vectors: DataFrame) -> DataFrame:
    """Component-wise mean by label over vectors of the label's smallest-id dimension: label, centroid."""
    dims = vectors.groupBy("label").agg(F.min_by(F.size("embedding"), "vec_id").alias("dim"))
    parts = vectors.join(dims, "label").filter(F.size("embedding") == F.col("dim")).select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def nearest_centroid(vectors: DataFrame, centres: DataFrame, threshold: float, most: int = 10_000) -> DataFrame:
    """vec_id, label of the centroid with the highest cosine above threshold (ties: smallest label), similarity.

    The centroids, one a label, are a stated set read against all vectors; more
    than `most` of them raise.
    """
    if centres.limit(most + 1).count() > most:
        raise ValueError(f"nearest_centroid: more than {most} centroids")
    scored = vectors.select("vec_id", "embedding").join(F.broadcast(centres)).withColumn("similarity", T.cosine(F.col("embedding"), F.col("centroid")))
    best = scored.filter(F.col("similarity") > threshold).groupBy("vec_id").agg(F.max(F.struct("similarity", (-F.col("label")).alias("neg"))).alias("m"))
    return best.select("vec_id", (-F.col("m.neg")).alias("label"), F.col("m.similarity").alias("similarity"))
