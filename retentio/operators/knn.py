"""Exact k-nearest-neighbour scoring as a blocked nested loop (survey §2.8).

``pyspark.ml`` has no k-NN classifier.  Exact k-NN needs every
(query, reference) distance, but never as rows: both sides are hashed into
blocks, each (query block, reference block) pair is one ``cogroup`` group
whose distances are computed with numpy inside the task, and only the k
best candidates per query leave it.  A final window per query key keeps the
k best of the at most k x (reference blocks) candidates.

Block counts come from the input sizes (``block_rows`` rows per block at most, and
at least as many reference blocks as the cluster has task slots), so
every group holds at most about ``block_rows`` rows of each side no matter how large
the inputs grow, and a repeated id cannot concentrate a side in one group
(blocks are hashes of internal row ids, not of the ids).

Scores follow the public k-NN classifier rules: uniform weights -> share
of positive labels among the k neighbours; distance weights -> 1/d,
where a zero distance takes all the weight; ties in distance are broken
by the smaller reference id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _blocks(n: int, block_rows: int) -> int:
    return max(1, math.ceil(n / block_rows))


def knn_candidates(reference: DataFrame, queries: DataFrame, k: int = 3, p: int = 2,
                   id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label", block_rows: int = 20_000) -> DataFrame:
    """``(qrow, qid, rid, dist, rlabel)``: the k nearest references of each
    query row (``qrow`` is an internal row id; query ids may repeat)."""
    nq, nr = queries.count(), reference.count()
    # at least one reference block per task slot, so small inputs spread too
    slots = reference.sparkSession.sparkContext.defaultParallelism
    a, b = _blocks(nq, block_rows), max(_blocks(nr, block_rows), min(slots, max(1, nr)))
    # _qrow: internal row id, so duplicated query ids are scored separately
    q = (queries.select(F.col(id_col).alias("qid"), F.col(vec_col).alias("qvec"))
         .withColumn("_qrow", F.monotonically_increasing_id())
         .withColumn("qa", F.pmod(F.xxhash64("_qrow"), F.lit(a)).cast("int"))
         .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))))
    # blocks from an internal row id: a repeated reference id cannot load one block
    r = (reference.select(F.col(id_col).alias("rid"), F.col(vec_col).alias("rvec"),
                          F.col(label_col).cast("int").alias("rlabel"))
         .withColumn("rb", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(b))
                     .cast("int"))
         .withColumn("qa", F.explode(F.sequence(F.lit(0), F.lit(a - 1)))))

    def block_topk(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if qp.empty or rp.empty:
            return pd.DataFrame({"qrow": pd.Series([], "int64"), "qid": pd.Series([], "int64"),
                                 "rid": pd.Series([], "int64"),
                                 "dist": pd.Series([], "float64"),
                                 "rlabel": pd.Series([], "int32")})
        rp = rp.sort_values("rid", kind="stable")
        rm = np.stack(rp["rvec"].to_numpy()).astype(np.float64)
        rids = rp["rid"].to_numpy()
        rlab = rp["rlabel"].to_numpy()
        kk = min(k, len(rp))
        out = []
        qm_all = np.stack(qp["qvec"].to_numpy()).astype(np.float64)
        qids = qp["qid"].to_numpy()
        qrows = qp["_qrow"].to_numpy()
        # chunk the queries so one difference array stays ~4M doubles (32 MB)
        step = max(1, int(4_000_000 // max(1, rm.shape[0] * rm.shape[1])))
        for s in range(0, len(qp), step):
            qm = qm_all[s:s + step]
            diff = qm[:, None, :] - rm[None, :, :]
            d = np.sqrt((diff * diff).sum(-1)) if p == 2 else np.abs(diff).sum(-1)
            # stable sort on distance keeps the smaller rid first among ties
            idx = np.argsort(d, axis=1, kind="stable")[:, :kk]
            rows = np.repeat(np.arange(len(qm)), kk)
            out.append(pd.DataFrame({"qrow": np.repeat(qrows[s:s + len(qm)], kk),
                                     "qid": np.repeat(qids[s:s + len(qm)], kk),
                                     "rid": rids[idx.ravel()],
                                     "dist": d[rows, idx.ravel()],
                                     "rlabel": rlab[idx.ravel()].astype("int32")}))
        return pd.concat(out, ignore_index=True)

    cand = (q.groupBy("qa", "rb").cogroup(r.groupBy("qa", "rb"))
            .applyInPandas(block_topk,
                           "qrow long, qid long, rid long, dist double, rlabel int"))
    w = Window.partitionBy("qrow").orderBy("dist", "rid")  # <= k x blocks rows per query
    return cand.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def knn_score(reference: DataFrame, queries: DataFrame, k: int = 3, weights: str = "uniform",
              p: int = 2, positive: int = 1, id_col: str = "vec_id",
              vec_col: str = "embedding", label_col: str = "label",
              block_rows: int = 20_000) -> DataFrame:
    """``(id, knn_score)``: probability of the ``positive`` label."""
    if weights not in ("uniform", "distance"):
        raise ValueError("weights must be 'uniform' or 'distance'")
    c = knn_candidates(reference, queries, k, p, id_col, vec_col, label_col, block_rows)
    hit = (F.col("rlabel") == positive).cast("double")
    if weights == "uniform":
        score = F.sum(hit) / F.count(F.lit(1))
        out = c.groupBy("qrow", "qid").agg(score.alias("knn_score"))
    else:
        zero = F.col("dist") == 0
        c = c.withColumn("_has0", F.max(zero.cast("int")).over(Window.partitionBy("qrow")))
        wgt = F.when(F.col("_has0") == 1, zero.cast("double")).otherwise(1.0 / F.col("dist"))
        out = c.groupBy("qrow", "qid").agg((F.sum(wgt * hit) / F.sum(wgt)).alias("knn_score"))
    return out.select(F.col("qid").alias(id_col), F.round("knn_score", 6).alias("knn_score"))
