"""Ranked and boolean word retrieval: BM25, fields, clauses, phrases, proximity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.functions.text import words


@dataclass(frozen=True)
class Bm25:
    """Robertson's parameters: k1 bends term counts, b weighs document length."""

    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self):
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must be at least 0 and b within 0 to 1")


def terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, term): every word with its place, from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words(text_col)).alias("pos", "term"))


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl): counts of each word and of all words of the document."""
    w = docs.select(F.col(id_col).alias("doc_id"), words(text_col).alias("w")).select("doc_id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
    return w.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")).select("doc_id", "term", "tf", "dl")


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, qtf)."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(words(text_col)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: documents and their mean length in words."""
    return docs.select(F.size(words(text_col)).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_dl"))


def bm25(docs: DataFrame, queries: DataFrame, p: Bm25 = Bm25(), id_col: str = "doc_id", text_col: str = "text", qid: str = "item_id", qtext: str = "text") -> DataFrame:
    """(query_id, doc_id, score, matched): BM25 with idf ln(1 + (N - df + .5) / (df + .5)).

    Only the queries' words are counted in the corpus, so what is shuffled is
    their postings rather than all words.
    """
    qt = query_terms(queries, qid, qtext)
    asked = qt.select("term").distinct()
    tc = docs.select(F.col(id_col).alias("doc_id"), words(text_col).alias("w")).select("doc_id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term")).join(asked, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tc.groupBy("term").agg(F.count("*").alias("df"))
    s = corpus_stats(docs, text_col)
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wt = idf * F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("dl") / F.col("avg_dl")))
    return tc.join(df, "term").join(qt, "term").crossJoin(s).groupBy("query_id", "doc_id").agg(F.round(F.sum(wt * F.col("qtf")), 6).alias("score"), F.count("*").alias("matched"))


def fielded_bm25(docs: DataFrame, queries: DataFrame, fields: dict[str, float], p: Bm25 = Bm25(), id_col: str = "doc_id", qid: str = "item_id", qtext: str = "text") -> DataFrame:
    """(query_id, doc_id, score): weighted sum of each field's BM25. Null fields are empty."""
    parts = [bm25(docs.select(id_col, F.coalesce(F.col(f), F.lit("")).alias("text")), queries, p, id_col, "text", qid, qtext).withColumn("score", F.col("score") * w) for f, w in fields.items()]
    all_parts = parts[0]
    for x in parts[1:]:
        all_parts = all_parts.unionByName(x)
    return all_parts.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, ties to the smaller id, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def boolean_match(docs: DataFrame, must=(), must_not=(), should=(), least_should: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_should): documents with all of ``must``, none of ``must_not`` and enough of ``should``."""
    w = docs.select(F.col(id_col).alias("doc_id"), words(text_col).alias("w"))
    n = F.size(F.array_intersect("w", F.array(*[F.lit(x) for x in should]))) if should else F.lit(0)
    cond = F.col("n_should") >= least_should
    for x in must:
        cond = cond & F.array_contains("w", x)
    for x in must_not:
        cond = cond & ~F.array_contains("w", x)
    return w.withColumn("n_should", n.cast("long")).filter(cond).select("doc_id", "n_should")


def phrase_hits(docs: DataFrame, phrase: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos): every place, overlapping ones too, where the phrase's words follow one another."""
    if not phrase:
        raise ValueError("an empty phrase")
    w = docs.select(F.col(id_col).alias("doc_id"), words(text_col).alias("w")).filter(F.size("w") >= len(phrase))
    for x in set(phrase):
        w = w.filter(F.array_contains("w", x))
    starts = F.sequence(F.lit(0), F.size("w") - len(phrase))
    at = F.filter(starts, lambda i: F.slice("w", i + 1, len(phrase)) == F.array(*[F.lit(x) for x in phrase]))
    return w.select("doc_id", F.explode(at).cast("long").alias("pos"))


def min_gap(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, gap): least distance in words between two different words, for documents with both."""
    t = terms(docs, id_col, text_col).filter(F.col("term").isin(a, b))
    w = Window.partitionBy("doc_id").orderBy("pos")
    gaps = t.select("doc_id", (F.col("pos") - F.lag("pos").over(w)).alias("gap"), (F.col("term") != F.lag("term").over(w)).alias("mixed")).filter("mixed")
    return gaps.groupBy("doc_id").agg(F.min("gap").cast("long").alias("gap"))
