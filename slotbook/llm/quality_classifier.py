"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

1. Every word has a sparse ternary index vector, drawn from hashes of the word, of
   its ending and of its shape.  A word's context vector is the sum of its neighbours'
   index vectors over all documents (words share ``BUCKETS`` hashed rows, so the
   table has a fixed size; tasks add up their part, Spark sums the parts).
2. A text is the mean and the spread of its words' context vectors, scaled to
   unit length, and of their index vectors.
3. A network of one hidden layer learns ``labels.quality`` from at most
   ``MAX_TRAIN`` labelled documents, chosen by hash; a temperature fitted on a part
   of them that it did not train on calibrates its probabilities.

Labels are read only where crc32(doc_id as text) mod 5 is not 0.  Defined results:
null or empty texts have the zero vector and the score the network gives it;
labels that are null, not 0/1 or contradict each other are not learnt from; without any
label, or with one class only, every score is the share of label 1 (1 if none);
repeated rows each get a row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from . import words as W

BUCKETS, DIM = 1 << 14, 64
WINDOW = 2
HIDDEN = 32
MAX_TRAIN = 12_000
EPOCHS = 120
THRESHOLD = 0.3


def held_out(doc_id, mod: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == 0, F.lit(False))


def index_entries(buf, starts, ends, h):
    """(dimension, sign) columns of each word's index vector: two each for the
    word, its ending and its shape."""
    size = ends - starts
    last, before = buf[ends - 1], buf[np.maximum(ends - 2, starts)]
    first = buf[starts]
    upper = ((first >= 0x41) & (first <= 0x5A)).astype(W.U) + 2 * ((last >= 0x41) & (last <= 0x5A)).astype(W.U)
    ending = W.mix(last.astype(W.U) * W.U(256) + before.astype(W.U) + W.U(1 << 20))
    shape = W.mix(upper * W.U(64) + np.minimum(size, 20).astype(W.U) + W.U(1 << 40))
    out = []
    for f in (h, ending, shape):
        for shift in (0, 16):
            bits = f >> W.U(shift)
            out.append(((bits & W.U(DIM - 1)).astype(np.int64), 1.0 - 2.0 * ((bits >> W.U(8)) & W.U(1)).astype(np.float64)))
    return out


def _buckets(h):
    return ((h >> W.U(40)) & W.U(BUCKETS - 1)).astype(np.int64)


def _contexts(batches):
    sums = np.zeros(BUCKETS * DIM)
    for _, buf, off in W.slices(batches, "text", W.SMALL_SLICE):
        starts, ends, word_off = W.spans(buf, off)
        if not len(starts):
            continue
        h = W.hashes(buf, starts, ends)
        row = np.repeat(np.arange(len(off) - 1), np.diff(word_off))
        cell = _buckets(h) * DIM
        entries = index_entries(buf, starts, ends, h)
        for step in range(1, WINDOW + 1):
            near = np.flatnonzero(row[step:] == row[:-step])
            for word, other in ((near, near + step), (near + step, near)):
                for dim, sign in entries:
                    np.add.at(sums, cell[word] + dim[other], sign[other])
    yield vectors.blocked(sums)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all word buckets, unit length, (BUCKETS, DIM) float32."""
    sums = vectors.total(docs.select("text").mapInArrow(_contexts, "block int, data binary"), BUCKETS * DIM)
    table = sums.reshape(BUCKETS, DIM)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)


def pooled(buf, off, table) -> np.ndarray:
    """(rows, 3 * DIM): mean and spread of context vectors, mean of index vectors."""
    starts, ends, word_off = W.spans(buf, off)
    n = len(off) - 1
    out = np.zeros((n, 3 * DIM), np.float32)
    live = np.flatnonzero(np.diff(word_off))
    if not len(live):
        return out
    h = W.hashes(buf, starts, ends)
    begin, size = word_off[live], np.diff(word_off)[live][:, None].astype(np.float32)
    vec = table[_buckets(h)]
    mean = np.add.reduceat(vec, begin, axis=0) / size
    out[live, :DIM] = mean
    np.multiply(vec, vec, out=vec)
    out[live, DIM:2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(vec, begin, axis=0) / size - mean**2, 0))
    row = np.repeat(np.arange(n), np.diff(word_off))
    index = np.zeros(n * DIM)
    for dim, sign in index_entries(buf, starts, ends, h):
        index += np.bincount(row * DIM + dim, sign, n * DIM)
    out[live, 2 * DIM:] = index.reshape(n, DIM)[live] / size
    return out


class Network:
    """x -> tanh layer -> logit; probability sigmoid(logit / temperature)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.temperature, self.constant = 1.0, None
        fit = ~check if (~check).any() and len(np.unique(y[~check])) == 2 else np.ones(len(y), bool)
        if len(np.unique(y)) < 2:
            self.constant = float(y.mean()) if len(y) else 1.0
            return
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-4)
        z, t = self._scaled(x[fit]), y[fit].astype(np.float32)
        self.p = [rng.normal(0, z.shape[1]**-0.5, (z.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
                  rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        batch = 256
        for _ in range(max(EPOCHS * len(t) // MAX_TRAIN, 20) if len(t) >= MAX_TRAIN // 2 else EPOCHS // 2):
            order = rng.permutation(len(t))
            for i in range(0, len(t), batch):
                zi, ti = z[order[i:i + batch]], t[order[i:i + batch]]
                hid = np.tanh(zi @ self.p[0] + self.p[1])
                d = (_sigmoid(hid @ self.p[2] + self.p[3][0]) - ti) / len(ti)
                dh = d[:, None] * self.p[2] * (1 - hid**2)
                grads = [zi.T @ dh + 1e-4 * self.p[0], dh.sum(0), hid.T @ d + 1e-4 * self.p[2], d.sum(keepdims=True)]
                step += 1
                for p, g, a, b in zip(self.p, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (2e-3 * a / (1 - 0.9**step) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if check.any():
            logit, t = self.logit(x[check]), y[check]
            grid = np.geomspace(0.25, 8, 60)
            loss = [-np.mean(np.log(np.clip(np.where(t == 1, _sigmoid(logit / k), 1 - _sigmoid(logit / k)), 1e-9, 1))) for k in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)

    def logit(self, x):
        return np.tanh(self._scaled(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return _sigmoid(self.logit(x).astype(np.float64) / self.temperature)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def usable(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): all usable labels outside the held-out fold."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
            .filter("doc_id is not null and label in (0, 1)").filter(~held_out("doc_id", 5))
            .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
            .filter("label = most").select("doc_id", "label"))


def labelled(labels: DataFrame, column: str, limit: int) -> DataFrame:
    """At most ``limit`` of the ``usable`` labels, by hash."""
    return usable(labels, column).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def train(docs: DataFrame, labels: DataFrame):
    """(word vectors, network)."""
    table = word_vectors(docs)
    held = docs.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.binary())])

    def features(batches):
        for rows, buf, off in W.slices(batches, "text", W.SMALL_SLICE):
            x = pooled(buf, off, held.value)
            yield W.table(schema, doc_id=rows.column(0), label=rows.column(2), x=[v.tobytes() for v in x])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = labelled(labels, "quality", MAX_TRAIN)  # MAX_TRAIN rows of two numbers
    rows = sorted(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
                  .mapInArrow(features, "doc_id long, label int, x binary").collect())
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(rows), 3 * DIM)
    y = np.array([r.label for r in rows], np.int64)
    check = np.array([r.doc_id * 2654435761 % 2**32 % 6 == 0 for r in rows], bool)
    return held, Network(x, y, check) if len(rows) else Network(np.zeros((0, 3 * DIM), np.float32), y, np.zeros(0, bool))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    held, net = train(docs, labels)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches):
        for rows, buf, off in W.slices(batches, "text", W.SMALL_SLICE):
            got = net.score(pooled(buf, off, held.value)).astype(np.float64)
            yield W.table(schema, doc_id=rows.column(0), held_out=rows.column(2), score=got,
                          predicted=(got >= THRESHOLD).astype(np.int32))

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out("doc_id", 5).alias("held_out"))
            .mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject."""
    held, net = train(docs, labels)

    def keep(batches):
        for rows, buf, off in W.slices(batches, "text", W.SMALL_SLICE):
            yield rows.filter(pa.array(net.score(pooled(buf, off, held.value)) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
