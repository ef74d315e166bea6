"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` code points, which cover its
whole text. A passage is its own hashed bigram and trigram counts and five shares
(distinct n-grams, symbols, capitals, digits, line ends), encoded by one
learned layer. Gated attention, tanh times sigmoid, weighs the encodings; the
weighted sum is scored by logistic regression. Only document labels are used;
everything is learned together on the driver from about ``TRAIN_ROWS`` labelled
documents, drawn by a hash of the id; where they hold more than ``TRAIN_BYTES``
of text, from the first of them, in order of that hash, that don't.

Defined cases: null and empty texts have no passage: quality 0, not kept, no
top passage; labels that are null or whose document is missing are left out;
different labels of one document each count, equal ones and rows that repeat an
id and a text once; very long texts are scored whole; without documents of both labels
quality, keep and top passage are null; ties in attention go to the first
passage; repeated rows are scored each; an empty table gives an empty table;
only ids, texts and labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE = 512
BUCKETS = 1 << 10
WIDTH, GATE = 24, 16
#: At most about so many labelled documents, and at most so many bytes of their texts, are trained on.
TRAIN_ROWS = 2000
TRAIN_BYTES = 64 << 20
#: Batches that are learned from, at every number of labels.
STEPS, BATCH, RATE, DECAY = 960, 64, 0.01, 1e-4
CHUNK = 1 << 19
_EXTRA = 5


def passages(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each passage, its features) for consecutive rows; long rows come in several parts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.utf8_length(texts).to_numpy()
    lo = 0
    while lo < len(texts):
        hi, total = lo + 1, int(sizes[lo])
        while hi < len(texts) and total + sizes[hi] <= CHUNK:
            total += int(sizes[hi])
            hi += 1
        cp = np.frombuffer("".join(texts.slice(lo, hi - lo).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        if hi - lo > 1 or len(cp) <= CHUNK:
            yield from _features(cp, sizes[lo:hi], lo)
        else:
            step = CHUNK // PASSAGE * PASSAGE
            for at in range(0, len(cp), step):
                yield from _features(cp[at : at + step], np.array([min(step, len(cp) - at)]), lo)
        lo = hi


def _features(cp: np.ndarray, sizes: np.ndarray, lo: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n = len(cp)
    if not n:
        return
    row = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    parts = -(-sizes // PASSAGE)
    first = np.cumsum(parts) - parts
    place = first[row] + (np.arange(n) - begin[row]) // PASSAGE
    k = int(parts.sum())
    flat = np.zeros(k * BUCKETS, np.int64)
    a = cp * np.uint32(0x9E3779B1)
    a ^= a >> np.uint32(15)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    h = a
    for step in (1, 2):
        h = (h[: n - step] ^ cp[step:]) * np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
        same = place[: n - step] == place[step:]
        flat += np.bincount(place[: n - step][same] * BUCKETS + ((h * np.uint32(0xC2B2AE3D)) >> shift)[same], minlength=len(flat))
    c = flat.reshape(k, BUCKETS)
    size = np.bincount(place, minlength=k).astype(np.float32)
    alnum = ((cp >= 97) & (cp <= 122)) | ((cp >= 65) & (cp <= 90)) | ((cp >= 48) & (cp <= 57)) | (cp >= 128)
    kinds = (~alnum & (cp > 32) & (cp != 44) & (cp != 46), (cp >= 65) & (cp <= 90), (cp >= 48) & (cp <= 57), cp == 10)
    shares = [np.bincount(place, weights=s, minlength=k) / size for s in kinds]
    x = np.empty((k, BUCKETS + _EXTRA), np.float32)
    x[:, :BUCKETS] = np.log1p(c)
    x[:, :BUCKETS] /= np.maximum(np.sqrt((x[:, :BUCKETS] ** 2).sum(1, keepdims=True)), 1e-6)
    x[:, BUCKETS:] = np.stack([(c > 0).sum(1) / np.maximum(c.sum(1), 1), *shares], 1)
    yield np.repeat(np.arange(len(sizes)), parts) + lo, x


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -60, 60)))


class Mil:
    """Encoder, gated attention and scorer. Bags are given by where each begins among the passages."""

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        size = BUCKETS + _EXTRA
        self.p = {
            "V": rng.normal(0, 1 / 4, (size, WIDTH)),
            "b": np.zeros(WIDTH),
            "A": rng.normal(0, WIDTH**-0.5, (WIDTH, GATE)),
            "G": rng.normal(0, WIDTH**-0.5, (WIDTH, GATE)),
            "w": rng.normal(0, GATE**-0.5, GATE),
            "c": rng.normal(0, WIDTH**-0.5, WIDTH),
            "d": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @classmethod
    def of(cls, p: dict) -> Mil:
        model = cls.__new__(cls)
        model.p = p
        return model

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["V"] + self.p["b"])

    def attend(self, h: np.ndarray, first: np.ndarray):
        p = self.p
        t, g = np.tanh(h @ p["A"]), _sigmoid(h @ p["G"])
        e = (t * g) @ p["w"]
        counts = np.diff(np.append(first, len(h)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
        a = e / np.repeat(np.add.reduceat(e, first), counts)
        z = np.add.reduceat(a[:, None] * h, first)
        return t, g, a, counts, z, _sigmoid(z @ p["c"] + p["d"][0])

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean log-loss."""
        p, h = self.p, self.encode(x)
        t, g, a, counts, z, s = self.attend(h, first)
        ds = (s - y) / len(y)
        dz = np.repeat(ds[:, None] * p["c"], counts, axis=0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), counts))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = a[:, None] * dz + dt @ p["A"].T + dg @ p["G"].T
        dv = dh * (1 - h * h)
        return {"V": x.T @ dv, "b": dv.sum(0), "A": h.T @ dt, "G": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": np.array([ds.sum()])}


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 4) -> Mil:
    """Adam over ``steps`` batches of at most BATCH bags."""
    model, rng = Mil(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(u) for k, u in model.p.items()}
    counts = np.diff(np.append(first, len(x)))
    step = 0
    while step < steps:
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            bags = order[at : at + BATCH]
            n = counts[bags]
            begin = np.cumsum(n) - n
            rows = np.repeat(first[bags] - begin, n) + np.arange(n.sum())
            step += 1
            for k, g in model.gradients(x[rows], begin, y[bags]).items():
                g = g + DECAY * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.p[k] = (model.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all passages, where each bag begins, its row); rows without passages have no bag."""
    rows, xs = [], []
    for r, x in passages(texts):
        rows.append(r)
        xs.append(x)
    if not rows:
        return np.zeros((0, BUCKETS + _EXTRA), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.concatenate(rows)
    which, first = np.unique(row, return_index=True)
    return np.concatenate(xs), first, which


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Mil | None:
    known = labels.select(F.col(f"`{id_col}`").alias("_lid"), F.col(f"`{label_col}`").cast("int").alias("_y")).filter("_lid IS NOT NULL AND _y IN (0, 1)")
    known = known.distinct()
    total = known.count()
    share = min(1 << 30, -(-train_rows * (1 << 30) // max(total, 1)))
    mark = F.pmod(F.xxhash64("_lid"), F.lit(1 << 30))
    first = [mark, F.col("_lid"), F.col("_y")]
    drawn = known.filter(mark < share).orderBy(*first).limit(2 * train_rows)
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_t")).filter("_t <> ''")
    near = base.join(F.broadcast(drawn), F.col("_id") == F.col("_lid"))  # 2 x train_rows ids
    sizes = near.select("_lid", "_y", F.xxhash64("_t").alias("_v"), F.octet_length("_t").alias("_n")).distinct().orderBy(*first, "_v").limit(4 * train_rows).toPandas()
    sizes = sizes[sizes["_n"].cumsum() <= train_bytes]
    if sizes.empty:
        return None
    spark = docs.sparkSession
    keys = spark.createDataFrame(list(sizes[["_lid", "_y", "_v"]].itertuples(index=False, name=None)), T.StructType([T.StructField("_kid", known.schema["_lid"].dataType), T.StructField("_y", T.IntegerType()), T.StructField("_v", T.LongType())]))
    chosen = base.join(F.broadcast(keys), (F.col("_id") == F.col("_kid")) & (F.xxhash64("_t") == F.col("_v"))).groupBy("_id", "_y", "_v").agg(F.any_value("_t").alias("_t"))
    rows = chosen.select("_id", "_t", "_y", "_v").toArrow().sort_by([("_id", "ascending"), ("_y", "ascending"), ("_v", "ascending")])  # bounded by train_bytes
    y = rows.column(2).to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        return None
    x, first, _ = bags(rows.column(1))
    return train(x, first, y)


def score(docs: DataFrame, model: Mil | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_passages, quality, keep, top_passage) for each row."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([base.schema["doc_id"], T.StructField("n_passages", T.LongType()), T.StructField("quality", T.DoubleType()), T.StructField("keep", T.BooleanType()), T.StructField("top_passage", T.LongType())])
    sent = docs.sparkSession.sparkContext.broadcast(model.p if model else None)

    def run(batches):
        m = Mil.of(sent.value) if sent.value else None
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            rows, codes = [], []
            for r, x in passages(b.column(1)):
                rows.append(r)
                codes.append(m.encode(x) if m else np.zeros((len(r), 1), np.float32))
            quality, top = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            if rows:
                row = np.concatenate(rows)
                which, first = np.unique(row, return_index=True)
                n[which] = np.diff(np.append(first, len(row)))
                if m:
                    _, _, a, counts, _, s = m.attend(np.concatenate(codes), first)
                    quality[which] = s
                    best = a == np.repeat(np.maximum.reduceat(a, first), counts)
                    at = np.where(best, np.arange(len(a)) - np.repeat(first, counts), len(a))
                    top[which] = np.minimum.reduceat(at, first)
            none = np.full(b.num_rows, m is None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(quality, mask=none), pa.array(quality >= 0.5, mask=none), pa.array(top, mask=none | (n == 0))], names=schema.names)

    return base.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, train_rows))
