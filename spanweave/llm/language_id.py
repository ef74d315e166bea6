"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three code points of the lower-cased text are hashed to
``BUCKETS``. Document frequencies are counted over all documents. Weights are
trained on the driver with follow-the-regularised-leader (proximal, one step
size a coordinate) under L1 and L2 penalties, on a sample of about
``TRAIN_ROWS`` labelled documents. Each language is drawn at its own share: the
one that gives ``TRAIN_ROWS`` of all labelled rows, or more where that leaves a
language under its floor of ``TRAIN_ROWS`` / (2 x languages) rows, and all its
rows where it has no more. So about 1.5 x ``TRAIN_ROWS`` rows are expected at
most, no language gets more than twice its quota, and every labelled language
has a row, however large the table and however rare the label. Rows that repeat
a text and a label are drawn once. Their counts, not their texts, go to the
driver, so it gets ``BUCKETS`` pairs of numbers a row at most. One in five of
them is held out, and the temperature that minimises their log-loss calibrates
the probabilities. Every document is then scored over its whole text, by the
n-grams that it has.

Defined cases: null and empty texts have no n-gram and get the classes' rates
among the labelled rows; rows without a label are scored but not trained on;
without any labelled row, lang_pred and confidence are null; with one class,
confidence is 1; ties go to the first class in order of name; repeated rows
count and are scored each; an empty table gives an empty table; only the id,
the text and the label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Hash buckets of n-grams; the longest n-gram.
BUCKETS = 1 << 13
LONGEST = 3
#: About so many labelled documents are trained on, and half as many again for rare languages (drawn by a hash of the text).
TRAIN_ROWS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.3, 1e-3
#: Code points that are counted at once; a longer text is counted in pieces and summed.
CHUNK = 1 << 20
_ROWS = 128


def _ngrams(cp: np.ndarray) -> list[np.ndarray]:
    """The buckets of the n-grams that begin at each code point, for each length."""
    out = []
    h = np.zeros(len(cp), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(cp) < n:
            break
        h = (h[: len(cp) - n + 1] ^ (cp[n - 1 :] + np.uint32(n))) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return out


def counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts by row and bucket) for consecutive rows that cover all texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    sizes = pc.utf8_length(low).to_numpy()
    lo = 0
    while lo < len(low):
        hi, total = lo + 1, int(sizes[lo])
        while hi < len(low) and hi - lo < _ROWS and total + sizes[hi] <= CHUNK:
            total += int(sizes[hi])
            hi += 1
        row = np.repeat(np.arange(hi - lo), sizes[lo:hi])
        cp = np.frombuffer("".join(low.slice(lo, hi - lo).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat = np.zeros((hi - lo) * BUCKETS, np.int64)
        step = len(cp) if hi - lo > 1 else CHUNK
        for at in range(0, len(cp), max(step, 1)):
            own = row[at : at + step + LONGEST - 1]
            for n, g in enumerate(_ngrams(cp[at : at + step + LONGEST - 1]), 1):
                key = own[: len(g)] * BUCKETS + g
                if n > 1 and hi - lo > 1:
                    key = key[own[: len(g)] == own[n - 1 :]]  # none reaches into the next text
                flat += np.bincount(key[:step] if hi - lo == 1 else key, minlength=len(flat))
        yield lo, flat.reshape(hi - lo, BUCKETS)
        lo = hi


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(documents that have each bucket, documents), over all rows."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches):
        df = np.zeros(BUCKETS, np.int64)
        n = 0
        for b in batches:
            n += b.num_rows
            for _, c in counts(b.column(0)):
                df += (c > 0).sum(0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return df[:-1], int(df[-1])


class Sparse:
    """Rows of unit length: log-damped counts times inverse document frequency, the buckets that each row has in order."""

    def __init__(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, rows: int, idf: np.ndarray):
        self.bucket, self.rows, self.idf = bucket, rows, idf
        self.off = np.searchsorted(row, np.arange(rows + 1))
        x = np.log1p(count, dtype=np.float32) * idf[bucket]
        norm = np.sqrt(np.bincount(row, x * x, minlength=rows))
        self.x = (x / np.maximum(norm, 1e-12)[row]).astype(np.float32)

    @classmethod
    def of(cls, c: np.ndarray, idf: np.ndarray) -> Sparse:
        row, bucket = np.nonzero(c)
        return cls(row, bucket, c[row, bucket], len(c), idf)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.off[i], self.off[i + 1])
        return self.bucket[part], self.x[part]

    def scores(self, w: np.ndarray) -> np.ndarray:
        """The rows times the weights."""
        out = np.zeros((self.rows, w.shape[1]))
        has = np.flatnonzero(np.diff(self.off))
        if len(has):
            out[has] = np.add.reduceat(self.x[:, None] * w[self.bucket], self.off[has])
        return out


class Ftrl:
    """Multinomial logistic regression by follow-the-regularised-leader (proximal)."""

    def __init__(self, classes: int, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z = np.zeros((size, classes))
        self.n = np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """From a row's buckets and values and its class."""
        w = self.weights(at)
        p = softmax((x @ w)[None])[0]
        p[y] -= 1
        g = x[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(s: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    e = np.exp((s - s.max(1, keepdims=True)) / temperature)
    return e / e.sum(1, keepdims=True)


def best_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(scores, np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()

    a, b, r = -5.0, 5.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """What a fit leaves: classes, idf, weights, temperature and the classes' rates."""

    def __init__(self, classes, idf, weights, temperature, rates):
        self.classes, self.idf, self.weights, self.temperature, self.rates = classes, idf, weights, temperature, rates

    def probabilities(self, c: np.ndarray) -> np.ndarray:
        p = softmax(Sparse.of(c, self.idf).scores(self.weights), self.temperature)
        p[c.sum(1) == 0] = self.rates
        return p


def label_counts(docs: DataFrame, text_col: str, label_col: str) -> dict:
    """label -> (rows with a text, the least hash of their texts), over all rows."""
    t = F.col(f"`{text_col}`").cast("string")
    rows = docs.filter(F.col(f"`{label_col}`").isNotNull() & t.isNotNull()).groupBy(F.col(f"`{label_col}`").alias("label")).agg(F.count("*").alias("n"), F.min(_draw(t)).alias("least")).collect()
    return {r["label"]: (r["n"], r["least"]) for r in rows}


def _draw(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(1 << 30))


def quotas(sizes: dict, rows: int) -> dict:
    """label -> rows to draw: in proportion, but a language has its floor or all its rows."""
    total, floor = sum(sizes.values()), max(1, rows // (2 * max(len(sizes), 1)))
    return {k: min(n, max(-(-rows * n // total), floor)) for k, n in sizes.items()}


def sample(docs: DataFrame, rows: int, found: dict, text_col: str, label_col: str) -> pa.Table:
    """(label, mark, buckets, counts) of about ``rows`` labelled texts, drawn from each class by their hash; a class's least hash is always drawn."""
    want = quotas({k: n for k, (n, _) in found.items()}, rows)
    spark = docs.sparkSession
    kind = T.StructType([T.StructField("_label", docs.schema[label_col].dataType), T.StructField("_below", T.LongType()), T.StructField("_most", T.LongType())])
    shares = [(k, max(-(-want[k] * (1 << 30) // n), least + 1), 2 * want[k]) for k, (n, least) in found.items()]
    t = F.col("text")
    own = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").alias("label")).filter(t.isNotNull())
    drawn = own.join(F.broadcast(spark.createDataFrame(shares, kind)), F.col("label") == F.col("_label")).filter(_draw(t) < F.col("_below"))  # one row for each class
    single = drawn.groupBy("label", F.xxhash64(t).alias("mark")).agg(F.any_value("text").alias("text"), F.any_value("_most").alias("_most"))
    kept = single.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy(_draw(t), "mark"))).filter("_k <= _most").select("label", "mark", "text")
    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([kept.schema["label"], kept.schema["mark"], T.StructField("buckets", ints), T.StructField("counts", ints)])

    def run(batches):
        for b in batches:
            for lo, c in counts(b.column(2)):
                row, bucket = np.nonzero(c)
                off = pa.array(np.searchsorted(row, np.arange(len(c) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (bucket, c[row, bucket])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(c)), b.column(1).slice(lo, len(c)), *lists], names=schema.names)

    return kept.mapInArrow(run, schema).toArrow().sort_by([("label", "ascending"), ("mark", "ascending")])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, text_col: str = "text", label_col: str = "lang", seed: int = 1) -> Model | None:
    df, n = document_frequencies(docs, text_col)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(1)
    found = label_counts(docs, text_col, label_col)
    if not found:
        return None
    rows = sample(docs, train_rows, found, text_col, label_col)
    labels = rows.column("label").to_pylist()
    classes = sorted(set(labels), key=str)
    y = np.array([classes.index(v) for v in labels])
    rates = np.array([found[c][0] for c in classes]) / sum(found[c][0] for c in classes)
    buckets, n_grams = (rows.column(k).combine_chunks() for k in ("buckets", "counts"))
    row = np.repeat(np.arange(len(y)), pc.list_value_length(buckets).to_numpy())
    return learned(Sparse(row, buckets.flatten().to_numpy(), n_grams.flatten().to_numpy(), len(y), idf), y, classes, rates, seed)


def learned(x: Sparse, y: np.ndarray, classes: list, rates: np.ndarray, seed: int) -> Model:
    """The model of the given rows, a fifth of which only calibrate."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    model = Ftrl(len(classes), BUCKETS)
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            model.learn(*x.row(i), y[i])
    w = model.weights().astype(np.float32)
    return Model(classes, x.idf, w, best_temperature(x.scores(w)[held], y[held]), rates)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, confidence) for each row."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if model is None:
        return base.select("doc_id", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("confidence"))
    schema = T.StructType([base.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("confidence", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast((model.classes, model.idf, model.weights, model.temperature, model.rates))

    def run(batches):
        m = Model(*sent.value)
        names = pa.array([str(c) for c in m.classes])
        for b in batches:
            for lo, c in counts(b.column(1)):
                p = m.probabilities(c)
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(best)), names.take(pa.array(best)), pa.array(p.max(1).astype(np.float64))], names=schema.names)

    return base.mapInArrow(run, schema)


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    return predict(docs, fit(docs, train_rows))
