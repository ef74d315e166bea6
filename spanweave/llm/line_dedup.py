"""Line dedup by overlapping windows of three consecutive lines.

Each window's lines are hashed to 128 bits; a window that occurs anywhere
before, in order of (id, hash of the text, line), is a repeat, and the lines that
repeats cover are removed. A removed line has the same line in an earlier place
of its window's first occurrence, and following such places ends at a line that
is kept, so no line's content is lost everywhere. The windows are hashed once
and written; texts are shuffled only where the covers are too large to send.

Defined cases: texts of fewer than three lines have no window and stay as they
are; a null text stays null with zero lines; the empty text has one line, the
empty one; ids that are null come first; rows that repeat both id and text are
one document and each gets its result; rows that share an id only are separate
documents, told apart by 64 bits of the text's hash; windows that tie in all but
the place belong to the first; very long texts are split whole; an empty table gives an empty table. The result has its own columns
only; ``deduped`` returns the input's columns with the text replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.storage import Written

WINDOW = 3


def _marked(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """carry + (_id, _text, _starts): first lines of the windows to remove, null where there are none."""
    base = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    split = base.select("_id", "_text").filter(F.instr("_text", "\n") > 0).select("_id", F.xxhash64("_text").alias("_tv"), F.split("_text", "\n").alias("_l")).filter(F.size("_l") >= WINDOW)
    lines = lambda i: [F.get("_l", i + k) for k in range(WINDOW)]
    hashes = F.transform(F.sequence(F.lit(0), F.size("_l") - WINDOW), lambda i: F.struct(F.xxhash64(*lines(i)).alias("a"), F.xxhash64(F.lit(1), *lines(i)).alias("b")))
    wins = Written(split.select("_id", "_tv", F.posexplode(hashes).alias("_p", "_h")).select("_id", "_tv", "_p", "_h.a", "_h.b"), "windows").df
    place = F.struct("_id", "_tv", "_p")
    firsts = wins.groupBy("a", "b").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter("NOT (_first <=> _last)").select("a", "b", "_first")
    later = wins.join(firsts, ["a", "b"]).filter(~place.eqNullSafe(F.col("_first")))
    cover = Written(later.groupBy("_id", "_tv").agg(F.collect_set("_p").alias("_starts")).select(F.col("_id").alias("_cid"), F.col("_tv").alias("_ctv"), "_starts"), "cover")
    return base.join(cover.side(), F.col("_id").eqNullSafe(F.col("_cid")) & (F.xxhash64("_text") == F.col("_ctv")), "left").drop("_cid", "_ctv")


def _kept() -> tuple[F.Column, F.Column]:
    lines = F.split("_text", "\n")
    covered = F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + (WINDOW - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    text = F.when(F.col("_starts").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    removed = F.when(F.col("_starts").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered))).cast("long")
    return text, removed


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, text) for each row, the text without the lines that repeats cover."""
    text, removed = _kept()
    n = F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size(F.split("_text", "\n"))).cast("long")
    return _marked(docs, id_col, text_col, []).select(F.col("_id").alias("doc_id"), n.alias("n_lines"), removed.alias("n_removed"), text.alias("text"))


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns and rows, the text without the lines that repeats cover."""
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_col}`").alias("_i"), F.col(f"`{text_col}`").alias("_t"))
    text, _ = _kept()
    return _marked(whole, "_i", "_t", ["_row"]).select(*[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in names])


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(ls) - 2)) AS p, ls FROM l WHERE len(ls) >= 3),
h AS (SELECT doc_id, p, md5(md5(ls[p + 1]) || md5(ls[p + 2]) || md5(ls[p + 3])) AS h FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS rn FROM h),
c AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS i FROM r WHERE rn > 1),
g AS (SELECT doc_id, list(i) AS cov FROM c GROUP BY doc_id)
SELECT l.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(cov), 0) AS BIGINT) AS n_removed,
  CASE WHEN cov IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(cov, i - 1)), chr(10)), '') END AS text
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""
