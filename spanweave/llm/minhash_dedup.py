"""MinHash near-duplicates by an inverted join over signature coordinates.

A text's signature is the minimum of 64 hash functions over its runs of three
words. Documents with equal signatures are a class, one entry of the join.
Every entry is posted under each (coordinate, value) pair. Pairs that only one
entry has are skipped, and with them every entry that has fewer than T shared
pairs left, since it can't reach T matches. The rest of an entry's pairs are put
in order of how many entries share them, rarest first; two entries with T
matches must meet in the first size - T + 1 of each, so only those prefixes are
posted again, as lists. Two entries are linked when at least T coordinates are
equal.

Groups are the components of the links, found without listing a group's pairs:
the entries of a list are compared with its smallest and its largest only, and
what that joins is merged. A list that still holds several groups is then
compared across them: the entries outside of its commonest group with all
others of other groups. Whoever shares a list is so either in one group
already or compared, hence no link between groups is lost.

Links are counted without listing them either. The commonest value of each
coordinate is a group's centre. Unequal coordinates are a distance, so entries
whose distances from the centre sum to at most 64 - T are linked for certain
and counted by a histogram of distances. Only the pairs beyond that, of which
one at least is farther than (64 - T) / 2 from the centre, are compared. Nothing
is capped.

Defined cases: a document is a distinct (id, text), so rows that repeat both are
one, and rows that share an id only, or have no id, are documents of their own;
null and empty texts, and texts without words, match nothing; texts of one or
two words count as one run; very long texts are hashed whole; a group's id is
its smallest one, null where it has none; ties of a coordinate's commonest value
go to the larger one, which changes no result; an empty table gives an empty
table; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm.textscan import mix, scans, sql_mix, sql_word_hash, sql_words
from spanweave.operators.graph import components
from spanweave.storage import Written

#: Hash functions, words in a run, and the least share of equal coordinates of a match.
COORDINATES = 64
RUN = 3
THRESHOLD = 0.55

_rng = np.random.default_rng(10)
_XOR = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_KEY = _rng.integers(0, 1 << 63, (2, COORDINATES), dtype=np.uint64)


def least_matches(threshold: float = THRESHOLD) -> int:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    return max(1, int(np.ceil(threshold * COORDINATES - 1e-9)))


def signatures_of(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have words, their signatures) from word hashes and row offsets."""
    counts = np.diff(offsets)
    rows = np.flatnonzero(counts > 0)
    if not len(rows):
        return rows, np.zeros((0, COORDINATES), np.uint32)
    h = np.concatenate([hashes, np.zeros(RUN - 1, np.uint64)])
    n = len(hashes)
    left = np.repeat(offsets[1:], counts) - np.arange(n)  # words to the row's end
    s = h[:n].copy()
    for k in range(1, RUN):
        s = mix(s + np.uint64(k)) + np.where(left > k, h[k : n + k], np.uint64(0))
    s = mix(s)
    runs = np.maximum(counts[rows] - (RUN - 1), 1)  # each row's first runs are whole
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    at = np.repeat(offsets[rows] - first, runs) + np.arange(runs.sum())
    x = (s[at] >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(rows), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], first)
    return rows, out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, k1, k2, sig) for each row with words: the text's hash, and the signature with its 128-bit key."""
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("version"), text.alias("text")).filter("text <> ''")
    schema = T.StructType([base.schema["id"], base.schema["version"], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("sig", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        for b in batches:
            for s in scans(b.column(2)):
                rows, sig = signatures_of(s.hashes, s.offsets)
                if len(rows):
                    keys = [pa.array(mix(mix(sig + k).sum(1)).view(np.int64)) for k in _KEY]
                    flat = pa.array(sig.reshape(-1).view(np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, COORDINATES, dtype=np.int32)), flat)
                    at = pa.array(rows + s.lo)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *keys, lists], names=schema.names)

    return base.mapInArrow(run, schema)


def _lists(entries: DataFrame, t: int) -> DataFrame:
    """(pair, e): the lists of the entries' prefixes, those of one entry left out."""
    posted = entries.select("e", F.posexplode("sig").alias("k", "v")).select("e", (F.col("k").cast("long") * F.lit(1 << 32) + F.col("v").cast("long")).alias("pair"))
    shared = posted.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1")
    left = posted.join(shared, "pair").groupBy("e").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("ps")).filter(F.size("ps") >= t)  # COORDINATES pairs at most
    prefix = left.select("e", F.explode(F.slice("ps", F.lit(1), F.size("ps") - (t - 1))).alias("p"))
    return prefix.select(F.col("p.pair").alias("pair"), "e")


def _unequal(x: str, y: str) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a != b), lambda e: e))


def _linked(pairs: DataFrame, entries: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b, ...) of entries with at least t equal coordinates."""
    sa = entries.select(F.col("e").alias("a"), F.col("sig").alias("_sa"))
    sb = entries.select(F.col("e").alias("b"), F.col("sig").alias("_sb"))
    return pairs.join(sa, "a").join(sb, "b").filter(_unequal("_sa", "_sb") <= COORDINATES - t).drop("_sa", "_sb")


class Near:
    """The classes, lists and groups of a table, each written to the shared folder."""

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"):
        self.t = least_matches(threshold)
        signed = Written(signatures(docs, id_col, text_col), "signatures").df
        rows = signed.groupBy("id", "version", "k1", "k2").agg(F.count("*").alias("rows"))
        self.members = Written(rows, "members").df
        sizes = self.members.groupBy("k1", "k2").agg(F.count("*").alias("w"))
        kept = signed.groupBy("k1", "k2").agg(F.any_value("sig").alias("sig"))
        self.entries = Written(kept.join(sizes, ["k1", "k2"]).withColumn("e", F.monotonically_increasing_id()), "entries").df
        self.lists = Written(_lists(self.entries, self.t), "lists").df
        self.groups = Written(self._groups(), "groups").df

    def _groups(self) -> DataFrame:
        """(e, g): the group of each entry that has a link to another."""
        ends = self.lists.groupBy("pair").agg(F.min("e").alias("lo"), F.max("e").alias("hi")).filter("lo < hi")
        ray = self.lists.join(ends, "pair").select("e", F.explode(F.array("lo", "hi")).alias("c")).filter("e <> c")
        stars = ray.select(F.least("e", "c").alias("a"), F.greatest("e", "c").alias("b")).distinct()
        first = Written(components(_linked(stars, self.entries, self.t)), "first").df.select(F.col("node").alias("e"), F.col("component").alias("g"))
        named = Written(self.lists.join(first, "e", "left").select("pair", "e", F.coalesce("g", "e").alias("g")), "named").df
        inside = named.groupBy("pair", "g").agg(F.count("*").alias("n")).groupBy("pair").agg(F.count("*").alias("k"), F.max_by("g", F.struct("n", "g")).alias("main")).filter("k > 1")
        open_ = Written(named.join(inside, "pair").select("pair", "e", "g", (F.col("g") == F.col("main")).alias("main")), "open").df
        minor = open_.filter("NOT main").select("pair", F.col("e").alias("a"), F.col("g").alias("ga"))
        every = open_.select("pair", F.col("e").alias("b"), F.col("g").alias("gb"), "main")
        across = minor.join(every, "pair").filter("ga <> gb AND (main OR a < b)").select("a", "b", "ga", "gb").distinct()
        merged = components(_linked(across, self.entries, self.t).select("ga", "gb"), "ga", "gb").select(F.col("node").alias("g"), F.col("component").alias("top"))
        alone = merged.select(F.col("g").alias("e"), "g").join(first.select("e"), "e", "left_anti")  # had no link before
        return first.unionByName(alone).join(Written(merged, "merged").side(), "g", "left").select("e", F.coalesce("top", "g").alias("g"))

    def links(self) -> DataFrame:
        """(e, n): how many documents of other classes each entry of a group is linked with."""
        room = COORDINATES - self.t
        inside = self.entries.join(self.groups, "e").select("e", "g", "w", "sig")
        votes = inside.select("g", F.posexplode("sig").alias("k", "v")).groupBy("g", "k", "v").agg(F.count("*").alias("n"))
        best = votes.groupBy("g", "k").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
        centre = best.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("centre"))  # COORDINATES values
        far = Written(inside.join(centre, "g").select("e", "g", "w", _unequal("sig", "centre").alias("d")), "distances").df
        bins = far.groupBy("g", "d").agg(F.sum("w").alias("n"))
        bins = bins.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("bins"))  # COORDINATES + 1 distances
        sure = F.aggregate(F.map_entries(F.map_filter("bins", lambda d, n: d <= room - F.col("d"))), F.lit(0).cast("long"), lambda s, x: s + x["value"])
        known = far.join(bins, "g").select("e", (sure - F.when(2 * F.col("d") <= room, F.col("w")).otherwise(0)).alias("n"))
        listed = Written(self.lists.join(far, "e").select("pair", "e", "g", "w", "d"), "listed").df
        outer = listed.filter(2 * F.col("d") > room).select("pair", F.col("e").alias("a"), F.col("g").alias("ga"), F.col("w").alias("wa"), F.col("d").alias("da"))
        other = listed.select("pair", F.col("e").alias("b"), F.col("g").alias("gb"), F.col("w").alias("wb"), F.col("d").alias("db"))
        open_ = (F.col("ga") == F.col("gb")) & (F.col("da") + F.col("db") > room) & (F.abs(F.col("da") - F.col("db")) <= room) & ((2 * F.col("db") <= room) | (F.col("a") < F.col("b")))
        pairs = Written(_linked(outer.join(other, "pair").filter(open_).select("a", "b", "wa", "wb").distinct(), self.entries, self.t), "pairs").df
        compared = pairs.select(F.col("a").alias("e"), F.col("wb").alias("n")).unionByName(pairs.select(F.col("b").alias("e"), F.col("wa").alias("n")))
        return known.unionByName(compared).groupBy("e").agg(F.sum("n").alias("n"))

    def documents(self) -> DataFrame:
        """(id, version, rows, e, w, g) of each document with words; g is null where its class has no link."""
        named = self.entries.select("k1", "k2", "e", "w").join(self.groups, "e", "left")
        return self.members.join(named, ["k1", "k2"]).select("id", "version", "rows", "e", "w", "g")


def near_links(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, n_links) for each document, also those without words.

    ``n_links`` counts the other documents with at least ``threshold`` of its
    signature's coordinates, those of equal signature among them; ``group_id`` is
    the smallest id of all that such links lead to, its own where there are none.
    """
    near = Near(docs, threshold, id_col, text_col)
    placed = Written(near.documents(), "placed").df
    own = F.when(F.col("g").isNotNull(), F.struct(F.lit(True).alias("linked"), F.col("g").alias("n"))).otherwise(F.struct(F.lit(False).alias("linked"), F.col("e").alias("n")))
    names = placed.groupBy(own.alias("own")).agg(F.min("id").alias("group_id"))
    counted = placed.select("id", "e", "w", own.alias("own")).join(names, "own").join(near.links(), "e", "left")
    found = counted.select(F.col("id").alias("doc_id"), "group_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links"))
    text = F.col(f"`{text_col}`").cast("string")
    every = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("version")).distinct()
    wordless = every.alias("x").join(near.members.select(F.col("id").alias("_i"), F.col("version").alias("_v")), F.col("id").eqNullSafe(F.col("_i")) & (F.col("version") == F.col("_v")), "left_anti")
    return found.unionByName(wordless.select(F.col("id").alias("doc_id"), F.col("id").alias("group_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: of its smallest id (null last), then text hash; of rows that repeat both, one.

    Rows without words stay as they are. Only rows that repeat an id and a text
    are shuffled; which of them stays is decided by a hash of all their columns.
    """
    placed = Written(Near(docs, threshold, id_col, text_col).documents(), "placed").df
    several = placed.filter("g IS NOT NULL OR w > 1").withColumn("own", F.when(F.col("g").isNull(), F.struct(F.lit(0).alias("x"), F.col("e").alias("n"))).otherwise(F.struct(F.lit(1).alias("x"), F.col("g").alias("n"))))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "version")
    first = several.groupBy("own").agg(F.min(rank).alias("first"))
    gone = Written(several.join(first, "own").filter(~F.col("first").eqNullSafe(rank)).select(F.col("id").alias("_gi"), F.col("version").alias("_gv")), "gone")
    again = Written(placed.filter("rows > 1").select(F.col("id").alias("_ri"), F.col("version").alias("_rv")), "again")
    names = docs.columns
    plain = [F.col(f"`{c}`") for c in names]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*plain).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_version"), F.xxhash64(*hashed).alias("_mark"))
    kept = rows.join(gone.side(), F.col("_id").eqNullSafe(F.col("_gi")) & (F.col("_version") == F.col("_gv")), "left_anti")
    if not again.df.isEmpty():
        on = F.col("_id").eqNullSafe(F.col("_ri")) & (F.col("_version") == F.col("_rv"))
        single = kept.join(again.side(), on, "left_anti").select("_row")
        kept = single.unionByName(kept.join(again.side(), on, "left_semi").groupBy("_id", "_version").agg(F.min_by("_row", "_mark").alias("_row")).select("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])


def sql_links(table: str, threshold: float = THRESHOLD) -> str:
    """DuckDB text of ``near_links``, for tables without rows that share an id and words of at most 256 bytes."""
    add = lambda a, b: f"CAST((CAST({a} AS HUGEINT) + {b}) % 18446744073709551616 AS UBIGINT)"
    sig = ", ".join(f"min(xor(x, {a}) * {b} % 4294967296)" for a, b in zip(_XOR.tolist(), _MUL.tolist()))
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {sql_words("coalesce(text, '')")} AS ws FROM {table}),
w AS MATERIALIZED (SELECT w, {sql_word_hash("w")} AS t FROM (SELECT DISTINCT unnest(ws) AS w FROM d)),
v AS MATERIALIZED (SELECT w, {sql_mix("t")} AS h FROM w),
p AS MATERIALIZED (SELECT doc_id, n, i, h FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM d) JOIN v USING (w)),
q AS (SELECT doc_id, n, i, h AS h0, coalesce(lead(h, 1) OVER o, 0) AS h1, coalesce(lead(h, 2) OVER o, 0) AS h2 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s1 AS MATERIALIZED (SELECT doc_id, {add("h0", "1")} AS a, h1, h2 FROM q WHERE i <= greatest(n - {RUN}, 0)),
s2 AS MATERIALIZED (SELECT doc_id, {add(sql_mix("a"), "h1")} AS a, h2 FROM s1),
s3 AS MATERIALIZED (SELECT doc_id, {add("a", "2")} AS a, h2 FROM s2),
s4 AS MATERIALIZED (SELECT doc_id, {add(sql_mix("a"), "h2")} AS a FROM s3),
x AS MATERIALIZED (SELECT doc_id, {sql_mix("a")} >> 32 AS x FROM s4),
g AS MATERIALIZED (SELECT doc_id, unnest(sig) AS v, unnest(range(0, {COORDINATES})) AS k FROM (SELECT doc_id, [{sig}] AS sig FROM x GROUP BY doc_id)),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM g AS a JOIN g AS b ON a.k = b.k AND a.v = b.v AND a.doc_id <> b.doc_id GROUP BY ALL HAVING count(*) >= {least_matches(threshold)}),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(least(doc_id, (SELECT min(b) FROM r WHERE a = doc_id)), doc_id) AS group_id, (SELECT count(*) FROM e WHERE a = doc_id) AS n_links FROM d"""
