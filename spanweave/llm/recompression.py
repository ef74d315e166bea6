"""Substring dedup by recompression.

Words are the first symbols. Each round names every maximal run of one symbol
and then every pair of a left and a right symbol; which symbols are left is a
bit of their names, drawn anew each round. A name is a 64-bit hash of what it
stands for, so equal runs and pairs get equal names in every task and round
without exchanging a dictionary, and equal substrings get equal symbols but
near their ends. A symbol that stands for at least ``GRAIN`` words is closed:
it is posted and takes part in no further pair, so that any ``LEAST`` words hold
whole symbols. A run of ``CUT`` words or more is posted by stretches of about
``CUT`` words at its ends and between, under a name without its length, so that
runs of different lengths meet.

A symbol's context is all that ``LEAST`` words around it can reach. A symbol
with one place can't be in a repeat. Where all places of a symbol have one
context, they repeat its first place throughout. Otherwise each context's first
place stands for the context: the hashes of its runs of ``LEAST`` words (96
bits, as unlikely as a false comparison of the words themselves) are grouped
over the whole table, and what they repeat holds for all places of the context.
So rows for single runs of words are made only where equal symbols have unequal
surroundings, and never for two places with equal ones.

The result is exact: every run of ``LEAST`` words that occurs before, in order
of (id, text hash, place), with its first occurrence; runs that follow each
other at the same shift are one row. A run is missed only if it holds no symbol
that its first occurrence has too, which needs a chain of unequal pairs over 20
words from each side: 2 words of the 5,150,718 that lie in repeats of 26.7
million words, by brute force.

Defined cases: null ids and null or empty texts take no part; texts of fewer
than ``LEAST`` words have no repeat; very long texts are scanned whole; rows that
repeat an id and a text are one document; rows that share an id only are
documents of their own, in order of a hash of their text; of ties the first
place is the source; an empty table gives an empty table; other columns are not
read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm.textscan import mix, scans, sql_words
from spanweave.storage import Written

#: Words of a repeat, of a posted symbol at least, and of a run that is posted by stretches.
LEAST = 50
GRAIN = 8
CUT = 20
_ROUNDS = 64
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + np.uint64(0x632BE59BD9B4E019)) + b)


def _run(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix(mix(a ^ np.uint64(0xD6E8FEB86659FD93)) + n.astype(np.uint64))


def _stretches(name: np.ndarray, start: np.ndarray, size: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, first words, words) of the stretches that stand for long runs: any LEAST words inside a run hold one, and both ends do."""
    own = -(-CUT // size) * size
    step = (LEAST + 1 - own) // size * size
    last = times * size - own
    k = last // step + 2
    which = np.repeat(np.arange(len(name)), k)
    nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    at = start[which] + np.minimum(nth * step[which], last[which])
    keep = (nth == 0) | (nth * step[which] < last[which] + step[which])
    return _run(~name, np.zeros(len(name)))[which][keep], at[keep], own[which][keep]


def symbols(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, first words, words) of the posted symbols of words in rows; a symbol never spans two rows."""
    name, row = hashes, rows
    start = np.arange(len(name), dtype=np.int64)
    size = np.ones(len(name), np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    r = 0
    while len(name) and r < _ROUNDS:
        head = np.ones(len(name), bool)
        head[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1]) | (start[:-1] + size[:-1] != start[1:])
        first = np.flatnonzero(head)
        runs = np.diff(np.append(first, len(name)))
        many = runs > 1
        long = many & (runs * size[first] >= CUT)
        if long.any():
            at = first[long]
            out.append(_stretches(name[at], start[at], size[at], runs[long]))
        if many.any():
            fresh = np.where(many, _run(name[first], runs), name[first])
            name, row, start, size = fresh, row[first], start[first], size[first] * runs
        bits = mix(name + np.uint64(r + 1)) & np.uint64(1)
        ok = (bits[:-1] == 0) & (bits[1:] == 1) & (row[1:] == row[:-1]) & (start[:-1] + size[:-1] == start[1:]) & (size[:-1] < GRAIN) & (size[1:] < GRAIN)
        left = np.flatnonzero(ok)
        keep = np.ones(len(name), bool)
        keep[left + 1] = False
        fresh, sizes = name.copy(), size.copy()
        fresh[left] = _pair(name[left], name[left + 1])
        sizes[left] += size[left + 1]
        name, row, start, size = fresh[keep], row[keep], start[keep], sizes[keep]
        done = size >= GRAIN
        fit = done & (size <= LEAST)
        out.append((name[fit], start[fit], size[fit]))
        # a closed symbol leaves; so does one with closed ones or ends on both sides, which can't pair again
        prev = np.zeros(len(name), bool)
        prev[1:] = (row[1:] == row[:-1]) & (start[:-1] + size[:-1] == start[1:]) & ~done[:-1]
        nxt = np.zeros(len(name), bool)
        nxt[:-1] = prev[1:] & ~done[1:]
        prev &= np.append(True, ~done[:-1])
        live = ~done & (prev | nxt)
        name, row, start, size = name[live], row[live], start[live], size[live]
        r += 1
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*out))


class Spans:
    """Hashes of any stretches of a scan's words, from running sums."""

    def __init__(self, hashes: np.ndarray, base: int):
        up, down = (np.full(len(hashes) + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        for x in (up, down):
            x[0] = 1
            np.cumprod(x, out=x)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1])])
        self.down = down

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, v, text): v is 32 bits of the text's hash, which tells rows that share an id apart."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("v"), text.alias("text")).filter("id IS NOT NULL AND text <> ''")


def _fields(*names: str) -> list[T.StructField]:
    kinds = {"h": T.LongType(), "c": T.LongType(), "w1": T.LongType()}
    return [T.StructField(n, kinds.get(n, T.IntegerType())) for n in names]


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, c, id, v, at, lead, size): each posted symbol's name, its context's hash, its first word, the words of the context before it and in all."""
    base = _base(docs, id_col, text_col)
    schema = T.StructType([*_fields("h", "c"), base.schema["id"], *_fields("v", "at", "lead", "size")])

    def run(batches):
        for b in batches:
            for s in scans(b.column(2)):
                rows = s.rows()
                h, at, n = symbols(s.hashes, rows)
                r = rows[at] if len(at) else at
                begin, end = s.offsets[r], s.offsets[r + 1]
                lo, hi = np.maximum(at + n - LEAST, begin), np.minimum(at + LEAST, end)
                fit = hi - lo >= LEAST
                h, at, r, begin, lo, hi = (x[fit] for x in (h, at, r, begin, lo, hi))
                c = mix(Spans(s.hashes, _BASE[0]).of(lo, hi) + (at - lo).astype(np.uint64))
                small = [pa.array(x.astype(np.int32)) for x in (at - begin, at - lo, hi - lo)]
                doc = pa.array(r + s.lo)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), b.column(0).take(doc), b.column(1).take(doc), *small], names=schema.names)

    return base.mapInArrow(run, schema)


def _windows(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(w1, w2, id, v, at): the runs of LEAST words inside the contexts that are asked for, once each."""
    rows = _base(docs, id_col, text_col).join(asked, ["id", "v"]).select("id", "v", "text", "asked")
    schema = T.StructType([*_fields("w1", "w2"), rows.schema["id"], *_fields("v", "at")])

    def run(batches):
        for b in batches:
            lists = b.column(3)
            for s in scans(b.column(2)):
                depth = np.zeros(len(s.hashes) + 1, np.int64)
                for i in range(s.lo, s.hi):
                    want = lists[i].values
                    lo, size = (want.field(k).to_numpy() + (k == 0) * s.offsets[i - s.lo] for k in (0, 1))
                    np.add.at(depth, lo, 1)
                    np.add.at(depth, lo + size - LEAST + 1, -1)
                at = np.flatnonzero(np.cumsum(depth)[:-1])
                r = s.rows()[at]
                w1, w2 = (Spans(s.hashes, k).of(at, at + LEAST).view(np.int64) for k in _BASE)
                doc = pa.array(r + s.lo)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array((w2 >> 32).astype(np.int32)), b.column(0).take(doc), b.column(1).take(doc), pa.array((at - s.offsets[r]).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _stretch_bounds(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the stretches, from whether each item continues the one before."""
    first = np.flatnonzero(~same)
    return first, np.diff(np.append(first, len(same)))


def _parts(contexts: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h, c, off, n, src): what the runs of each context repeat, by stretches at one shift, off from its first word.

    contexts: (h, c, id, v, lo, size), each by its first place; firsts: (id, v, at, src), the first place of each run.
    """
    found = firsts.groupBy("id", "v").agg(F.sort_array(F.collect_list(F.struct("at", "src"))).alias("f"))
    asked = contexts.groupBy("id", "v").agg(F.collect_list(F.struct("h", "c", "lo", "size", "single")).alias("a"))
    rows = asked.join(found, ["id", "v"]).select("id", "v", "a", "f")
    schema = T.StructType([*_fields("h", "c", "off", "n"), T.StructField("src", firsts.schema["src"].dataType)])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                a, f = b.column(2)[i].values, b.column(3)[i].values
                at, src = f.field(0).to_numpy(), f.field(1)
                key = pc.rank(src.field(0), tiebreaker="dense").to_numpy().astype(np.int64)
                own = pc.equal(src.field(0), b.column(0)[i]).to_numpy(zero_copy_only=False) & (src.field(1).to_numpy() == b.column(1)[i].as_py()) & (src.field(2).to_numpy() == at)
                v, shift = src.field(1).to_numpy(), src.field(2).to_numpy() - at
                same = np.zeros(len(at), bool)
                same[1:] = (key[1:] == key[:-1]) & (v[1:] == v[:-1]) & (shift[1:] == shift[:-1]) & (at[1:] == at[:-1] + 1)
                stretch = np.cumsum(~same) - 1
                lo, size = a.field(2).to_numpy(), a.field(3).to_numpy()
                single = a.field(4).to_numpy(zero_copy_only=False)
                x, y = np.searchsorted(at, lo), np.searchsorted(at, lo + size - LEAST + 1)
                k = stretch[y - 1] - stretch[x] + 1  # stretches of each context
                ctx = np.repeat(np.arange(len(lo)), k)
                s = stretch[x][ctx] + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                begin = np.flatnonzero(~same)
                end = np.append(begin[1:], len(at))
                p, q = np.maximum(begin[s], x[ctx]), np.minimum(end[s], y[ctx])
                keep = ~(own[p] & single[ctx])
                ctx, p, q = ctx[keep], p[keep], q[keep]
                yield pa.RecordBatch.from_arrays([a.field(0).take(pa.array(ctx)), a.field(1).take(pa.array(ctx)), pa.array((at[p] - lo[ctx]).astype(np.int32)), pa.array((q - p).astype(np.int32)), src.take(pa.array(p))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _merged(blocks: DataFrame) -> DataFrame:
    """The rows of the result from (id, v, lo, n, src): n runs of words from lo on that repeat src; each run goes with its first source."""
    rows = blocks.groupBy("id", "v").agg(F.collect_set(F.struct("lo", "n", "src")).alias("b"))
    kind = blocks.schema["id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("src_doc_id", kind), T.StructField("src_start", T.LongType())])

    def run(batches):
        for b in batches:
            lists = b.column(2)
            flat, at = lists.flatten(), np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
            lo, n, src = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64), flat.field(2)
            key = pc.rank(src.field(0), tiebreaker="dense").to_numpy().astype(np.int64) if len(flat) else lo
            v, shift = src.field(1).to_numpy().astype(np.int64), src.field(2).to_numpy() - lo
            out = []
            for i in range(b.num_rows):
                x, y = at[i], at[i + 1]
                order = x + np.lexsort((shift[x:y], v[x:y], key[x:y]))[::-1]
                best = np.full((lo[x:y] + n[x:y]).max() + 1, -1, np.int64)
                for k in order.tolist():  # the first source comes last and stays
                    best[lo[k] : lo[k] + n[k]] = k
                p = np.flatnonzero(best >= 0)
                k = best[p]
                same = np.zeros(len(p), bool)
                same[1:] = (p[1:] == p[:-1] + 1) & (key[k[1:]] == key[k[:-1]]) & (v[k[1:]] == v[k[:-1]]) & (shift[k[1:]] == shift[k[:-1]])
                first, size = _stretch_bounds(same)
                out.append((np.full(len(first), i), p[first], size + LEAST - 1, k[first], p[first] + shift[k[first]]))
            if out:
                doc, start, size, k, from_ = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(start), pa.array(size), src.field(0).take(pa.array(k)), pa.array(from_)], names=schema.names)

    return rows.mapInArrow(run, schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_words, src_doc_id, src_start): passages that occur before, with the first place they repeat."""
    posted = Written(postings(docs, id_col, text_col), "symbols")
    place = F.struct("id", "v", "at")
    named = posted.df.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), (F.min("c") == F.max("c")).alias("even")).filter("first <> last").select("h", "first", "even")
    shared = Written(posted.df.join(named, "h").withColumn("lo", F.col("at") - F.col("lead")), "shared").df
    posted.drop()
    even = shared.filter("even").select("id", "v", "lo", (F.col("size") - (LEAST - 1)).alias("n"), F.struct(F.col("first.id").alias("id"), F.col("first.v").alias("v"), (F.col("first.at") - F.col("lead")).alias("at")).alias("src"))
    uneven = shared.filter("NOT even").select("h", "c", "id", "v", "lo", "size")
    start = F.struct("id", "v", "lo")
    contexts = Written(uneven.groupBy("h", "c").agg(F.min(start).alias("p"), F.max(start).alias("q"), F.min("size").alias("size")).select("h", "c", "p.id", "p.v", "p.lo", "size", (F.col("p") == F.col("q")).alias("single")), "contexts").df
    asked = contexts.groupBy("id", "v").agg(F.collect_set(F.struct("lo", "size")).alias("asked"))
    runs = Written(_windows(docs, asked, id_col, text_col), "runs")
    firsts = runs.df.groupBy("w1", "w2").agg(F.min(place).alias("src"))
    found = Written(runs.df.join(firsts, ["w1", "w2"]).select("id", "v", "at", "src"), "firsts").df
    runs.drop()
    parts = Written(_parts(contexts, found), "parts").df
    other = uneven.join(parts, ["h", "c"]).select("id", "v", (F.col("lo") + F.col("off")).alias("lo"), "n", "src")
    later = even.unionByName(other).filter("NOT (id = src.id AND v = src.v AND lo = src.at)")
    return _merged(later)


def sql_repeats(table: str) -> str:
    """DuckDB text of ``repeats``, for tables without rows that share an id."""
    return f"""
WITH d AS (SELECT doc_id, {sql_words("text")} AS ws FROM {table} WHERE doc_id IS NOT NULL AND text <> ''),
w AS (SELECT doc_id, p, array_to_string(ws[p + 1 : p + {LEAST}], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {LEAST - 1})) AS p FROM d WHERE len(ws) >= {LEAST})),
f AS (SELECT w, min((doc_id, p)) AS src FROM w GROUP BY w),
r AS (SELECT w.doc_id, w.p, f.src[1] AS src_doc_id, f.src[2] AS src_p FROM w JOIN f ON w.w = f.w WHERE (w.doc_id, w.p) <> f.src),
g AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, src_doc_id, src_p - p ORDER BY p) AS island FROM r)
SELECT doc_id, CAST(min(p) AS BIGINT) AS start, CAST(count(*) + {LEAST - 1} AS BIGINT) AS n_words, src_doc_id, CAST(min(src_p) AS BIGINT) AS src_start
FROM g GROUP BY doc_id, src_doc_id, src_p - p, island"""
