"""Winnowed q-gram fingerprints and the positional index over them.

Winnowing keeps, of each window of consecutive q-gram hashes, the smallest
(rightmost of equals), as published by Schleimer, Wilkerson and Aiken (2003).
``winnowed`` is pure DataFrame; ``winnowed_arrow`` gives the same rows several
times faster.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanweave.functions.text import normal_form, qgrams

Q, W = 8, 10


def _check(q: int, w: int) -> None:
    if q < 1 or w < 1:
        raise ValueError("q and window must be at least 1")


def hashed_qgrams(docs: DataFrame, q: int = Q, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, fp): the md5 of each q-gram of the normal form, positions from 0."""
    grams = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(qgrams(normal_form(text_col), q)).alias("pos", "gram"))
    return grams.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("gram").alias("fp"))


def winnowed(docs: DataFrame, q: int = Q, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, fp) of the selected q-grams; texts with fewer than w q-grams give their one minimum."""
    _check(q, w)
    h = hashed_qgrams(docs, q, id_col, text_col)
    by = Window.partitionBy("doc_id")
    m = F.min(F.struct("fp", (-F.col("pos")).alias("neg"))).over(by.orderBy("pos").rowsBetween(-(w - 1), 0)).alias("m")
    picked = h.select("doc_id", "pos", m, F.count("*").over(by).alias("n")).filter((F.col("pos") >= w - 1) | ((F.col("pos") == F.col("n") - 1) & (F.col("n") < w)))
    return picked.select("doc_id", (-F.col("m.neg")).alias("pos"), F.col("m.fp").alias("fp")).distinct()


def winnowed_arrow(docs: DataFrame, q: int = Q, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``winnowed``, computed document by document over Arrow batches."""
    _check(q, w)
    base = docs.select(F.col(id_col).alias("doc_id"), normal_form(text_col).alias("norm")).filter("norm <> ''")
    schema = T.StructType([base.schema["doc_id"], T.StructField("pos", T.LongType()), T.StructField("fp", T.StringType())])

    def run(batches):
        md5 = hashlib.md5
        for b in batches:
            rows, places, fps = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                n = len(t) - q + 1
                if n < 1:
                    continue
                if t.isascii():
                    e = t.encode()
                    raw = b"".join([md5(e[k : k + q]).digest() for k in range(n)])
                else:
                    raw = b"".join([md5(t[k : k + q].encode()).digest() for k in range(n)])
                key = np.frombuffer(raw, ">u8").reshape(n, 2)[:, 0].astype(np.uint64)
                k = min(w, n)
                back = np.lib.stride_tricks.sliding_window_view(key[::-1], k)
                at = n - 1 - np.unique(back.argmin(1) + np.arange(n - k + 1))
                at.sort()
                rows.append(np.full(len(at), i))
                places.append(at)
                fps += [raw[16 * p : 16 * p + 16].hex() for p in at.tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places).astype(np.int64)), pa.array(fps)], names=schema.names)

    return base.mapInArrow(run, schema)


def dictionary(features: DataFrame) -> DataFrame:
    """(fp, df, postings): documents and places of each fingerprint."""
    return features.groupBy("fp").agg(F.countDistinct("doc_id").alias("df"), F.count("*").alias("postings"))


def index_stats(features: DataFrame) -> DataFrame:
    """One row: documents, distinct fingerprints, postings."""
    return features.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("fp").alias("fingerprints"), F.count("*").alias("postings"))


def idf(n_docs, df):
    """Smoothed inverse document frequency, ln((N + 1) / (df + 1)) + 1."""
    return F.log((n_docs + F.lit(1)) / (df + F.lit(1))) + F.lit(1.0)


def diagonal_votes(queries: DataFrame, corpus: DataFrame, band: int = 16, cap: int = 1000) -> DataFrame:
    """(query_id, doc_id, bin, hits, weight): shared fingerprints by diagonal.

    A diagonal is the corpus position less the query position. Bins are
    ``band`` wide on two grids half a band apart (odd bins are the shifted
    grid), so votes that straddle one grid's border fall together on the other.
    Fingerprints with more than ``cap`` postings are left out before the join,
    which bounds the join's fan-out.
    """
    d = dictionary(corpus).filter(F.col("postings") <= cap)
    n = corpus.agg(F.countDistinct("doc_id").alias("n_docs"))
    q = queries.select(F.col("doc_id").alias("query_id"), F.col("pos").alias("qpos"), "fp")
    useful = q.join(d.join(q.select("fp").distinct(), "fp", "left_semi"), "fp").crossJoin(n).select("query_id", "qpos", "fp", idf(F.col("n_docs"), F.col("df")).alias("w"))
    hits = corpus.select("doc_id", "pos", "fp").join(useful, "fp").select("query_id", "doc_id", "w", (F.col("pos") - F.col("qpos")).alias("diag"))
    bins = F.array(2 * F.floor(F.col("diag") / band), 2 * F.floor((F.col("diag") + band // 2) / band) + 1)
    return hits.select("query_id", "doc_id", "w", F.explode(bins).cast("long").alias("bin")).groupBy("query_id", "doc_id", "bin").agg(F.count("*").alias("hits"), F.sum("w").alias("weight"))


def best_sources(votes: DataFrame, top: int = 1, least_hits: int = 2) -> DataFrame:
    """(query_id, doc_id, bin, hits, weight, rank): each query's best bins, one per document."""
    order = [F.desc(F.round("weight", 6)), F.desc("hits"), F.asc("doc_id"), F.asc("bin")]
    in_doc = Window.partitionBy("query_id", "doc_id").orderBy(*order)
    best = votes.filter(F.col("hits") >= least_hits).withColumn("k", F.row_number().over(in_doc)).filter("k = 1").drop("k")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
