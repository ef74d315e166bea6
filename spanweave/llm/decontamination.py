"""Benchmark decontamination by a positional inverted index over the training documents.

Executors post every occurrence of the benchmark's words (no other word can
take part in a match) and write the postings as a table of segments: a segment
covers some documents and holds, for each word, its places in order. How often
each word occurs in the whole corpus then orders the words by rarity. Matching
reads the segments where they are, without a shuffle. A segment looks up its own
words among the words that items are searched by, so it visits those items only
whose rare words it has:

* phrase: ``phrase`` words of an item in a row (all of a shorter item). Each such
  run is searched by its rarest word: its places, adjusted by the word's offset,
  align the item, and the lists of the words beside it are intersected with
  them, outwards, until one differs.
* near: at least ``near`` of an item's distinct words within a window a quarter
  longer than the item. Such a window must hold one of the item's d - k + 1
  rarest words, so these are what it is searched by; the other words' lists are
  asked from the rarest on, and a place is dropped as soon as too many of them
  have none in reach.

Both are exact. The benchmark goes to executors in parts of bounded size; more
parts mean more passes over the one index, never a different result. (Only for a
benchmark of more than ``VOCABULARY`` distinct words each part has its own.)

Defined cases: documents with a null id, null or empty texts match nothing;
items with a null id or fewer than ``least`` words are left out, and an item of
fewer than ``least_near`` distinct words matches as a phrase only (``left_out``
counts both); rows that share an id are one document and the best match counts;
very long texts are one segment each, matched whole; ties go to the earliest
place; empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm.textscan import scans, sql_words
from spanweave.storage import Written

#: Bytes of benchmark text that are sent to executors at once, and distinct words of one index.
PART_BYTES = 16 << 20
VOCABULARY = 1 << 23
#: Places that are looked at together.
_AT_ONCE = 1 << 20
_NONE = np.zeros(0, np.int64)


@dataclass(frozen=True)
class Rules:
    """Words in a row of a phrase, the share of distinct words of a near match, and the least words of items of either kind."""

    phrase: int = 13
    near: float = 0.75
    least: int = 5
    least_near: int = 8


def window(m):
    return m + np.maximum(4, m // 4)


def _texts(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("id IS NOT NULL AND text <> ''")


def _parts(bench: DataFrame) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(item ids, word hashes of each) of parts of bounded size."""
    base = bench.distinct()
    n = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // PART_BYTES + 1
    for p in range(n):
        part = base.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == p).toArrow()  # bounded by PART_BYTES
        toks = [s.hashes[a:b] for s in scans(part.column(1)) for a, b in zip(s.offsets[:-1], s.offsets[1:])]
        yield part.column(0).combine_chunks(), toks


def _vocabulary(bench: DataFrame) -> Written:
    """The distinct words of the benchmark."""

    def run(batches):
        for b in batches:
            for s in scans(b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(s.hashes).view(np.int64))], names=["h"])

    return Written(bench.mapInArrow(run, "h long").distinct(), "vocabulary")


def left_out(bench: DataFrame, rules: Rules = Rules(), item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(too_short, phrase_only, items): how many items match in no way and in one way only."""

    def run(batches):
        for b in batches:
            for s in scans(b.column(1)):
                m = np.diff(s.offsets)
                d = np.array([len(np.unique(s.hashes[x:y])) for x, y in zip(s.offsets[:-1], s.offsets[1:])])
                short = m < rules.least
                yield pa.RecordBatch.from_arrays([pa.array([int(short.sum())]), pa.array([int((~short & (d < rules.least_near)).sum())]), pa.array([len(m)])], names=["a", "b", "n"])

    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return _texts(bench, item_col, text_col).mapInArrow(run, "a long, b long, n long").agg(total("a").alias("too_short"), total("b").alias("phrase_only"), total("n").alias("items"))


def _index_schema(id_type: T.DataType) -> T.StructType:
    ints = T.ArrayType(T.IntegerType(), False)
    return T.StructType([T.StructField("ids", T.ArrayType(id_type, False)), T.StructField("bases", ints), T.StructField("terms", ints), T.StructField("counts", ints), T.StructField("gaps", ints)])


def _segment(s, vocab: np.ndarray):
    """(bases, terms, counts, gaps): a scan's postings; a row's first word is at its base, rows are one place apart."""
    n = s.hi - s.lo
    bases = s.offsets + np.arange(n + 1)
    at = np.minimum(np.searchsorted(vocab, s.hashes), len(vocab) - 1)
    sel = np.flatnonzero(vocab[at] == s.hashes)
    place = sel + s.rows()[sel]
    term = at[sel]
    order = np.argsort(term, kind="stable")
    term, place = term[order], place[order]
    terms, first, counts = np.unique(term, return_index=True, return_counts=True)
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    return bases, terms, counts, gaps


def build_index(docs: DataFrame, vocab: np.ndarray, id_col: str, text_col: str) -> Written:
    """The written segments: for each, its documents and the places of every word of ``vocab`` in them."""
    base = _texts(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        v = sent.value
        for b in batches:
            for s in scans(b.column(1)):
                bases, terms, counts, gaps = _segment(s, v)
                if not len(terms):
                    continue
                cols = [b.column(0).slice(s.lo, s.hi - s.lo), *(pa.array(x.astype(np.int32)) for x in (bases, terms, counts, gaps))]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols], names=["ids", "bases", "terms", "counts", "gaps"])

    return Written(base.mapInArrow(run, _index_schema(base.schema["id"].dataType)), "postings")


class Segment:
    """Places of words in some documents: the list of terms[i] is places[starts[i] : ends[i]]."""

    def __init__(self, bases, terms, counts, gaps):
        self.bases, self.terms = bases, terms
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        total = np.cumsum(gaps, dtype=np.int64)
        self.places = total - np.repeat(np.where(self.starts > 0, total[self.starts - 1], 0), counts)
        self.size = int(bases[-1]) + 1
        self.keys = np.repeat(terms, counts) * self.size + self.places
        self.words = np.full(self.size, -1, np.int64)
        self.words[self.places] = np.repeat(terms, counts)

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, place, side="right") - 1

    def word(self, place: np.ndarray) -> np.ndarray:
        inside = (place >= 0) & (place < self.size)
        return np.where(inside, self.words[np.where(inside, place, 0)], -1)

    def between(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the term's list has a place from lo to before hi."""
        return np.searchsorted(self.keys, term * self.size + lo) < np.searchsorted(self.keys, term * self.size + hi)

    def list(self, term: int) -> np.ndarray:
        i = int(np.searchsorted(self.terms, term))
        return self.places[self.starts[i] : self.ends[i]] if i < len(self.terms) and self.terms[i] == term else _NONE

    def meet(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index in the sorted ``terms``, place) for every place of every term, some at once. It costs what the segment holds of them."""
        a, b = np.searchsorted(terms, self.terms), np.searchsorted(terms, self.terms, side="right")
        hit = np.flatnonzero(b > a)
        a, b, s, n = a[hit], b[hit], self.starts[hit], (self.ends - self.starts)[hit]
        upto = np.cumsum((b - a) * n)
        total = int(upto[-1]) if len(upto) else 0
        for x in range(0, total, _AT_ONCE):
            flat = np.arange(x, min(x + _AT_ONCE, total))
            k = np.searchsorted(upto, flat, side="right")
            i, j = np.divmod(flat - (upto[k] - (b[k] - a[k]) * n[k]), n[k])
            yield a[k] + i, self.places[s[k] + j]


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within it) of each item of lists of the given sizes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Items:
    """What is looked for, as flat arrays: each item's words, the words it is searched by, and its words by rarity."""

    def __init__(self, toks: list[np.ndarray], freq: np.ndarray, rules: Rules):
        self.m = np.array([len(t) for t in toks], np.int64)
        self.words = np.concatenate(toks) if toks else _NONE
        self.off = np.cumsum(self.m) - self.m
        self.n = np.minimum(rules.phrase, self.m)
        # anchors: the rarest word of each run of n, the first of equally rare ones
        rank = np.append(freq[self.words], np.iinfo(np.int64).max)
        item, o = _ragged(self.m - self.n + 1)
        at = []
        for x in range(0, len(item), _AT_ONCE):
            i, own = item[x : x + _AT_ONCE], o[x : x + _AT_ONCE]
            j = np.arange(rules.phrase)[None, :]
            cells = np.where(j < self.n[i][:, None], (self.off[i] + own)[:, None] + j, len(rank) - 1)
            at.append(self.off[i] + own + rank[cells].argmin(1))
        at = np.unique(np.concatenate(at)) if at else _NONE
        item = np.searchsorted(self.off, at, side="right") - 1
        order = np.argsort(self.words[at], kind="stable")
        self.anchor_term, self.anchor_item, self.anchor_at = self.words[at][order], item[order], (at - self.off[item])[order]
        # distinct words by rarity
        item, _ = _ragged(self.m)
        pairs = np.unique(np.stack([item, self.words], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        pairs = pairs[np.lexsort((pairs[:, 1], freq[pairs[:, 1]], pairs[:, 0]))]
        self.d = np.bincount(pairs[:, 0], minlength=len(toks))
        self.rare, self.rare_off = pairs[:, 1], np.cumsum(self.d) - self.d
        self.k = np.where(self.d >= rules.least_near, np.ceil(rules.near * self.d - 1e-9).astype(np.int64), self.d + 1)
        self.w = window(self.m)
        nth = np.arange(len(pairs)) - self.rare_off[pairs[:, 0]]
        top = nth < (self.d - self.k + 1)[pairs[:, 0]]
        order = np.argsort(pairs[top, 1], kind="stable")
        self.top_term, self.top_item = pairs[top, 1][order], pairs[top, 0][order]

    def phrases(self, seg: Segment) -> np.ndarray:
        """Rows (item, doc, words in a row, flat place) of runs of at least n."""
        out = [np.zeros((0, 4), np.int64)]
        for pair, place in seg.meet(self.anchor_term):
            item, at = self.anchor_item[pair], self.anchor_at[pair]
            run, first = np.ones(len(item), np.int64), place.copy()
            for step in (1, -1):
                live, s = np.arange(len(item)), 0
                while len(live):
                    s += step
                    i, j = item[live], at[live] + s
                    inside = (j >= 0) & (j < self.m[i])
                    same = inside & (seg.word(place[live] + s) == self.words[np.where(inside, self.off[i] + j, 0)])
                    live = live[same]
                    run[live] += 1
                    if step < 0:
                        first[live] -= 1
                if step > 0:  # what is left of the word can add no more than its place in the item
                    enough = run + at >= self.n[item]
                    item, at, run, first, place = item[enough], at[enough], run[enough], first[enough], place[enough]
            long = run >= self.n[item]
            out.append(np.stack([item[long], seg.doc(first[long]), run[long], first[long]], 1))
        return np.concatenate(out)

    def near(self, seg: Segment) -> np.ndarray:
        """Rows (item, doc, distinct words, flat place of the window's first) of the best window of at least k."""
        found = []
        for pair, at in seg.meet(self.top_term):
            item, at = np.divmod(np.unique(self.top_item[pair] * seg.size + at), seg.size)
            doc = seg.doc(at)
            lo = np.maximum(at - self.w[item] + 1, seg.bases[doc])
            hi = np.minimum(at + self.w[item], seg.bases[doc + 1] - 1)  # one place after the row's last word is no word
            absent, s = np.zeros(len(at), np.int64), 0
            while len(at) and s < self.d[item].max():
                has = s < self.d[item]
                term = self.rare[np.minimum(self.rare_off[item] + s, len(self.rare) - 1)]
                absent += has & ~seg.between(term, lo, hi)
                ok = absent <= (self.d - self.k)[item]
                item, doc, lo, hi, absent, at = item[ok], doc[ok], lo[ok], hi[ok], absent[ok], at[ok]
                s += 1
            found.append(np.stack([item, doc, lo, hi], 1))
        rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
        cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
        out = [r for part in np.split(rows, cut) if len(part) for r in self._best_window(seg, part)]
        return np.array(out, np.int64).reshape(-1, 4)

    def _best_window(self, seg: Segment, reach: np.ndarray) -> list[tuple[int, int, int, int]]:
        item, doc = int(reach[0, 0]), int(reach[0, 1])
        merged: list[list[int]] = []
        for x, y in reach[:, 2:].tolist():
            if merged and x <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], y)
            else:
                merged.append([x, y])
        best, w, d = (0, 0), int(self.w[item]), int(self.d[item])
        lists = [seg.list(int(t)) for t in self.rare[self.rare_off[item] : self.rare_off[item] + d]]
        for x, y in merged:
            own = [p[np.searchsorted(p, x) : np.searchsorted(p, y)] for p in lists]
            at = np.concatenate(own)
            order = np.argsort(at)
            at, which = at[order].tolist(), np.repeat(np.arange(d), [len(p) for p in own])[order].tolist()
            count, have, j = [0] * d, 0, 0
            for p0, k0 in zip(at, which):
                while j < len(at) and at[j] < p0 + w:
                    have += count[which[j]] == 0
                    count[which[j]] += 1
                    j += 1
                if have > best[0]:
                    best = (have, p0)
                count[k0] -= 1
                have -= count[k0] == 0
        return [(item, doc, *best)] if best[0] >= self.k[item] else []


def _frequencies(index: Written, size: int) -> np.ndarray:
    """How often each word of the vocabulary occurs in the corpus."""
    rows = index.df.select(F.explode(F.arrays_zip("terms", "counts")).alias("z")).groupBy("z.terms").agg(F.sum("z.counts").alias("n")).toArrow()
    freq = np.zeros(size, np.int64)
    freq[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return freq


def matches(docs: DataFrame, bench: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, kind, n_words, at): the best phrase and the best near match of each document and item.

    ``n_words`` counts the words in a row (phrase) or the distinct words
    (near); ``at`` is the place, in words, where they begin.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType, bench.schema[item_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", item_type), T.StructField("kind", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("at", T.LongType())])
    found = spark.createDataFrame([], schema)
    items = Written(_texts(bench, item_col, item_text_col), "items").df
    known, index = _vocabulary(items), None
    if known.df.count() <= VOCABULARY:
        vocab = np.sort(known.df.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))  # bounded by VOCABULARY
        if len(vocab):
            index = build_index(docs, vocab, id_col, text_col)
            freq = _frequencies(index, len(vocab))
    for ids, toks in _parts(items):
        keep = [i for i, t in enumerate(toks) if len(t) >= rules.least]
        if not keep:
            continue
        own = index
        if own is None:
            vocab = np.unique(np.concatenate(toks))
            own = build_index(docs, vocab, id_col, text_col)
            freq = _frequencies(own, len(vocab))
        sent = spark.sparkContext.broadcast((ids.take(pa.array(keep)), Items([np.searchsorted(vocab, toks[i]) for i in keep], freq, rules).__dict__))
        found = found.unionByName(own.df.mapInArrow(_matcher(sent, schema), schema))
    best = F.max_by(F.struct("n_words", "at"), F.struct("n_words", -F.col("at"))).alias("m")
    return found.groupBy("doc_id", "item_id", "kind").agg(best).select("doc_id", "item_id", "kind", "m.n_words", "m.at")


def _matcher(sent, schema: T.StructType):
    def run(batches):
        ids, arrays = sent.value
        items = Items.__new__(Items)
        items.__dict__.update(arrays)
        for b in batches:
            for r in range(b.num_rows):
                doc_ids = b.column(0)[r].values
                seg = Segment(*(b.column(c)[r].values.to_numpy().astype(np.int64) for c in range(1, 5)))
                for kind, rows in (("phrase", items.phrases(seg)), ("near", items.near(seg))):
                    if not len(rows):
                        continue
                    rows = rows[np.lexsort((rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
                    first = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))  # the longest, then earliest, of each document
                    item, doc, n, at = rows[first].T
                    yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), ids.take(pa.array(item)), pa.array([kind] * len(n)), pa.array(n), pa.array(at - seg.bases[doc])], names=schema.names)

    return run


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def clean(docs: DataFrame, bench: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that match no item, with their columns. A document is an id and a text here, and a null id is as good as any."""
    own, version = _key(id_col, text_col)
    name = F.to_json(F.struct(own.cast("string").alias("i"), version.alias("v")))
    named = docs.select(name.alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    hit = Written(matches(named, bench, rules).select(F.col("doc_id").alias("_hit")).distinct(), "leaks")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), name.alias("_name"))
    kept = whole.join(hit.side(), F.col("_name") == F.col("_hit"), "left_anti")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def sql_matches(docs: str, bench: str, rules: Rules = Rules()) -> str:
    """DuckDB text of ``matches``, for tables without rows that share an id. Phrases are islands of common runs of ``least`` words."""
    n = rules.least
    return f"""
WITH d AS (SELECT doc_id, {sql_words("text")} AS ws FROM {docs} WHERE doc_id IS NOT NULL AND text <> ''),
b AS (SELECT item_id, ws, len(ws) AS m, len(list_distinct(ws)) AS d FROM (SELECT item_id, {sql_words("text")} AS ws FROM {bench} WHERE item_id IS NOT NULL AND text <> '') WHERE len(ws) >= {n}),
dg AS (SELECT doc_id, p, array_to_string(ws[p + 1 : p + {n}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {n - 1})) AS p FROM d WHERE len(ws) >= {n})),
bg AS (SELECT item_id, m, q, array_to_string(ws[q + 1 : q + {n}], ' ') AS g FROM (SELECT item_id, ws, m, unnest(range(0, m - {n - 1})) AS q FROM b)),
j AS (SELECT doc_id, item_id, m, p, p - q AS diag, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS island FROM dg JOIN bg USING (g)),
r AS (SELECT doc_id, item_id, min(p) AS p, count(*) + {n - 1} AS n FROM j GROUP BY doc_id, item_id, m, diag, island HAVING count(*) + {n - 1} >= least({rules.phrase}, m)),
ph AS (SELECT doc_id, item_id, 'phrase' AS kind, max(n) AS n_words, arg_min(p, (-n, p)) AS p FROM r GROUP BY doc_id, item_id),
dw AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM d),
bw AS (SELECT item_id, m + greatest(4, m // 4) AS win, CAST(ceil({rules.near} * d - 1e-9) AS BIGINT) AS k, unnest(list_distinct(ws)) AS w FROM b WHERE d >= {rules.least_near}),
o AS (SELECT doc_id, item_id, win, k, p, dw.w FROM dw JOIN bw ON dw.w = bw.w),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id ORDER BY p RANGE BETWEEN CURRENT ROW AND (win - 1) FOLLOWING) AS hits FROM o),
h AS (SELECT c.doc_id, c.item_id, c.p, c.k, count(DISTINCT o.w) AS n FROM c JOIN o ON c.doc_id = o.doc_id AND c.item_id = o.item_id AND o.p >= c.p AND o.p < c.p + c.win WHERE c.hits >= c.k GROUP BY ALL),
ne AS (SELECT doc_id, item_id, 'near' AS kind, max(n) AS n_words, arg_min(p, (-n, p)) AS p FROM h WHERE n >= k GROUP BY doc_id, item_id)
SELECT doc_id, item_id, kind, CAST(n_words AS BIGINT) AS n_words, CAST(p AS BIGINT) AS at FROM (SELECT * FROM ph UNION ALL SELECT * FROM ne)"""
