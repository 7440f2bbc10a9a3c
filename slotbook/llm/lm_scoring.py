"""LM scoring with a hashed maximum-entropy model.

Tokens are lower-cased words, then one end token a text.

* **Outputs** are factored: ``CLASSES`` classes of ``SLOTS`` slots.  Frequent words have
  a slot each; the rest share the ``OPEN`` last slots of the classes by hash, where a word's share is its
  smoothed count.  So log P(w | h) = log P(class | h) + log P(slot | class, h) +
  log P(w | slot), and any word has a probability.
* **Features** of the history h: the word before (bigram), the word two before
  (skip) and both together (trigram), hashed to ``ROWS`` rows of weights, one a
  class; the word before and the skip again, one a slot.  Biases start at the
  corpus's class and slot frequencies.
* **Training**: each task takes AdaGrad steps over its training texts in minibatches;
  Spark sums the tasks' updates and the mean update starts the next round.  A round
  takes its own share of the texts (by hash), all rounds together take every one.
* **Counts** cover every training token.  The ``TOP`` most frequent words travel with the tasks (a fixed
  bound); all others are looked up by a join on their hash, one row a text and word.
* **Scoring** runs in sparse numpy batches: rows of weights are gathered per token.

Training texts are those whose crc32(doc_id as text) mod 10 is not 0.  Defined results:
null or empty texts are the end token alone; rows with a null doc_id are training
texts; repeated rows count and are scored each; with no training text N = V = 0 and
the model is uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotbook.session import scratch_path

from . import vectors
from . import words as W
from .quality_classifier import held_out

CLASSES, SLOTS = 32, 32
OUTPUTS = CLASSES * SLOTS
OPEN = 256                  # outputs that rare words share
ROWS = 1 << 13              # hashed feature rows of the class layer
NEAR = 1 << 9               # hashed feature rows of the slot layer, per feature
TOP = 1 << 16
ROUNDS = 2
BATCH = 4096
SMOOTH = 0.1
FAR = 60.0                  # 32 values of exp(FAR) sum up in float32
END = W.U(0x2545F4914F6CDD1D)
START = W.U(0x9E6C63D0876A9A47)
_LN10 = float(np.log(10))

_SIZES = {"cb": CLASSES, "c": ROWS * CLASSES, "sb": OUTPUTS, "s": 2 * NEAR * OUTPUTS}
SIZE = sum(_SIZES.values())


def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
    at = np.cumsum([0, *_SIZES.values()])
    v = {k: flat[at[i]:at[i + 1]] for i, k in enumerate(_SIZES)}
    return {"cb": v["cb"], "c": v["c"].reshape(ROWS, CLASSES), "sb": v["sb"].reshape(CLASSES, SLOTS),
            "s": v["s"].reshape(CLASSES, 2 * NEAR, SLOTS)}


class Tokens:
    """Tokens of a slice of rows: hashes with an end token after each row."""

    def __init__(self, buf, off):
        buf = W.LOWER[buf]
        starts, ends, word_off = W.spans(buf, off)
        n = len(off) - 1
        self.off = word_off + np.arange(n + 1)
        self.h = np.full(self.off[-1], END, W.U)
        inside = np.ones(len(self.h), bool)
        inside[self.off[1:] - 1] = False
        self.h[inside] = W.hashes(buf, starts, ends)
        one, two = np.append(START, self.h[:-1]), np.append([START, START], self.h[:-2])[:len(self.h)]
        one[self.off[:-1]] = two[self.off[:-1]] = START
        second = self.off[:-1][np.diff(self.off) > 1] + 1
        two[second] = START
        a, b = W.mix(one ^ W.U(1)), W.mix(two ^ W.U(2))
        both = W.mix(a * W.U(3) + b)
        rows = W.U(ROWS - 1)
        self.wide = np.stack([(x >> W.U(20)) & rows for x in (a, b, both)]).astype(np.int64)
        self.near = np.stack([(a >> W.U(40)) & W.U(NEAR - 1), ((b >> W.U(40)) & W.U(NEAR - 1)) + W.U(NEAR)]).astype(np.int64)


class Vocabulary:
    """The most frequent words with their counts and outputs, and the totals of the rest."""

    def __init__(self, top: list[tuple[int, int]], tokens: int, distinct: int, shared: dict[int, tuple[int, int]]):
        top = sorted(top, key=lambda r: (-r[1], r[0]))
        own = OUTPUTS - OPEN
        h = np.array([r[0] for r in top], np.int64).view(W.U)
        count = np.array([r[1] for r in top], np.int64)
        out = open_output(h)
        # frequency order deals its own outputs class by class
        k = np.arange(min(own, len(h)))
        out[:own] = (k % CLASSES) * SLOTS + k // CLASSES
        order = np.argsort(h)
        self.h, self.count, self.output = h[order], count[order], out[order]
        self.tokens, self.distinct = tokens, distinct
        self.mass, self.kinds = np.zeros(OUTPUTS), np.zeros(OUTPUTS)
        for o, (c, n) in shared.items():
            self.mass[o], self.kinds[o] = c, n
        self.mass += np.bincount(out, count, OUTPUTS)
        self.kinds += np.bincount(out, minlength=OUTPUTS)

    def look_up(self, h):
        """(known to be frequent, count, output) of each hash."""
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), open_output(h)
        known = self.h[at] == h
        return known, np.where(known, self.count[at], 0), np.where(known, self.output[at], open_output(h))

    def share(self, count, output):
        """log10 P(word | output)."""
        own = output % SLOTS < SLOTS - OPEN // CLASSES
        with np.errstate(divide="ignore", invalid="ignore"):
            open_ = np.log10((count + SMOOTH) / (self.mass[output] + SMOOTH * (self.kinds[output] + 1)))
        return np.where(own, 0.0, open_)

    def base(self, count):
        return np.log10((count + SMOOTH) / (self.tokens + SMOOTH * (self.distinct + 1)))

    def biases(self) -> np.ndarray:
        flat = np.zeros(SIZE, np.float32)
        v = _views(flat)
        mass = (self.mass + 1).reshape(CLASSES, SLOTS)
        v["cb"][:] = np.log(mass.sum(1) / mass.sum())
        v["sb"][:] = np.log(mass / mass.sum(1, keepdims=True))
        return flat


def open_output(h: np.ndarray) -> np.ndarray:
    """The shared output of a word, from its hash; `_open_column` is the same in Spark."""
    k = (h.view(np.int64) % OPEN).astype(np.int64)
    return (k % CLASSES) * SLOTS + SLOTS - OPEN // CLASSES + k // CLASSES


def _open_column(h):
    k = F.pmod(h, F.lit(OPEN))
    return ((k % CLASSES) * SLOTS + SLOTS - OPEN // CLASSES + F.floor(k / CLASSES)).cast("long")


def _softmax(x):
    if max(x.max(), -x.min()) > FAR:  # else no row comes near overflow, and the row's largest need not be sought
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def probabilities(v, wide, near, cls):
    """P(class | h) rows, and P(slot | class, h) rows for the given classes."""
    c, s = v["c"], v["s"].reshape(CLASSES * 2 * NEAR, SLOTS)
    p = c.take(wide[0], axis=0)
    p += c.take(wide[1], axis=0)
    p += c.take(wide[2], axis=0)
    p += v["cb"]
    row = cls * 2 * NEAR
    q = s.take(row + near[0], axis=0)
    q += s.take(row + near[1], axis=0)
    q += v["sb"].take(cls, axis=0)
    return _softmax(p), _softmax(q)


def _summed(index, grad):
    """(rows, sums): the different values of ``index`` (sorted) and the sums of ``grad`` over each, by
    adding neighbours of the same row in pairs, then pairs of pairs."""
    at = np.arange(len(index))
    while True:
        first = np.append(True, index[1:] != index[:-1])
        start = np.flatnonzero(first)
        odd = (np.arange(len(index)) - start[np.cumsum(first) - 1]) & 1 == 1
        if not odd.any():
            return index, grad.take(at, axis=0)
        right = np.flatnonzero(odd)
        grad[at[right - 1]] += grad.take(at[right], axis=0)
        index, at = index[~odd], at[~odd]


def _add_rows(target, squares, index, grad, rate):
    """AdaGrad on the rows ``index`` (features, tokens) of ``target`` with each token's gradient, equal rows
    summed first."""
    index = index.ravel().astype(np.uint16)  # fewer than 2**16 rows: sorted by digits
    order = np.argsort(index, kind="stable")
    rows, g = _summed(index[order], grad.take(order % len(grad), axis=0))
    squares[rows] += np.einsum("ij,ij->i", g, g) / g.shape[1]
    g *= (rate / np.sqrt(squares[rows] + 1e-6))[:, None]
    target[rows] -= g


def fit(flat, vocabulary, slices, rate=0.1) -> np.ndarray:
    """The weights after one pass over the slices of texts."""
    flat = flat.copy()
    v = _views(flat)
    s = v["s"].reshape(CLASSES * 2 * NEAR, SLOTS)
    sq_c, sq_s = np.full(ROWS, 1e-2, np.float32), np.full(len(s), 1e-2, np.float32)
    for buf, off in slices:
        t = Tokens(buf, off)
        _, _, output = vocabulary.look_up(t.h)
        for i in range(0, len(t.h), BATCH):
            wide, near, out = t.wide[:, i:i + BATCH], t.near[:, i:i + BATCH], output[i:i + BATCH]
            cls, slot, k = out // SLOTS, out % SLOTS, np.arange(len(out))
            p, q = probabilities(v, wide, near, cls)
            p[k, cls] -= 1
            q[k, slot] -= 1
            _add_rows(v["c"], sq_c, wide, p, rate)
            _add_rows(s, sq_s, cls * 2 * NEAR + near, q, rate)
    return flat


def _count_rows(batches):
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64())])
    held, room = [], 1 << 22
    for _, buf, off in W.slices(batches, "text"):
        held.append(np.unique(Tokens(buf, off).h, return_counts=True))
        if sum(len(h) for h, _ in held) > room:
            yield _counted(held, schema)
            held = []
    if held:
        yield _counted(held, schema)


def _counted(held, schema):
    h, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    c = np.bincount(back, np.concatenate([x for _, x in held]), len(h)).astype(np.int64)
    return W.table(schema, h=W.signed(h), c=c)


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c): how often each token hash occurs."""
    return texts.select("text").mapInArrow(_count_rows, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, n: int) -> list[tuple[int, int]]:
    """The n rows of (h, c) of the largest c, then least h.  A histogram gives a bound first, so that little
    more than n rows are sorted, however many partitions there are."""
    size = F.floor(64 * F.log2("c")).alias("size")
    found, least = 0, 0
    for least, rows in sorted(counts.groupBy(size).count().collect(), reverse=True):  # a row a 64th power of two
        found += rows
        if found >= n:
            break
    return [tuple(r) for r in counts.filter(size >= least).orderBy(F.desc("c"), "h").limit(n).collect()]


def _vocabulary(counts: DataFrame) -> Vocabulary:
    n = counts.agg(F.sum("c"), F.count("*")).first()
    top = most_frequent(counts, TOP)
    out = _open_column(F.col("h")).alias("o")
    shared = {r[0]: (r[1], r[2]) for r in counts.groupBy(out).agg(F.sum("c"), F.count("*")).collect()}  # OPEN rows
    for h, c in top:  # the rest only
        o = int(open_output(np.array([h], np.int64).view(W.U))[0])
        shared[o] = (shared[o][0] - c, shared[o][1] - 1)
    return Vocabulary(top, n[0] or 0, n[1], shared)


def train(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weights after ROUNDS rounds of averaged updates over all training texts."""
    sc = texts.sparkSession.sparkContext
    words = sc.broadcast(vocabulary)
    weights = vocabulary.biases()
    for turn in range(ROUNDS):
        start = sc.broadcast(weights)

        def update(batches, start=start):
            got = fit(start.value, words.value, ((b, o) for _, b, o in W.slices(batches, "text")))
            yield vectors.blocked(np.append(got - start.value, np.float32(1)))

        part = texts.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == turn).select("text")
        got = vectors.total(part.mapInArrow(update, "block int, data binary"), SIZE + 1)
        weights = weights + got[:-1] / max(got[-1], 1)
        start.destroy()
    words.destroy()
    return weights


_ROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                  ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
                  ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_ROW_DDL = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
            "rare array<long>, times array<long>")


def _score_rows(weights, vocabulary):
    def run(batches):
        v, words = _views(weights.value), vocabulary.value
        for rows, buf, off in W.slices(batches, "text"):
            t = Tokens(buf, off)
            known, count, output = words.look_up(t.h)
            score = np.empty(len(t.h))
            for i in range(0, len(t.h), BATCH):
                out = output[i:i + BATCH]
                cls, k = out // SLOTS, np.arange(len(out))
                p, q = probabilities(v, t.wide[:, i:i + BATCH], t.near[:, i:i + BATCH], cls)
                score[i:i + BATCH] = np.log10(np.maximum(p[k, cls], 1e-30)) + np.log10(np.maximum(q[k, out % SLOTS], 1e-30))
            score += np.where(known, words.share(count, output), 0)
            begin = t.off[:-1]
            row = np.repeat(np.arange(len(rows)), np.diff(t.off))
            some = np.flatnonzero(~known)
            order = some[np.lexsort((t.h[some], row[some]))]
            new = np.ones(len(order), bool)
            new[1:] = (t.h[order][1:] != t.h[order][:-1]) | (row[order][1:] != row[order][:-1])
            first = np.flatnonzero(new)
            cut = np.searchsorted(row[order][first], np.arange(len(rows) + 1)).astype(np.int32)
            times = np.diff(np.append(first, len(order)))
            yield pa.RecordBatch.from_arrays([
                rows.column(1), rows.column(2), rows.column(3), pa.array(np.diff(t.off)),
                pa.array(np.add.reduceat(known.astype(np.int64), begin)),
                pa.array(np.add.reduceat(np.where(known, words.base(count), 0), begin)),
                pa.array(np.add.reduceat(score, begin)),
                pa.ListArray.from_arrays(pa.array(cut), pa.array(W.signed(t.h[order][first]))),
                pa.ListArray.from_arrays(pa.array(cut), pa.array(times))], schema=_ROW)
    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
                        F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 10).alias("held_out"))
    training = texts.filter("not held_out")
    at = scratch_path(spark, "counts")
    word_counts(training).write.parquet(at)
    counts = spark.read.parquet(at)
    vocabulary = _vocabulary(counts)
    weights = train(training, vocabulary)

    sc = spark.sparkContext
    at = scratch_path(spark, "scored")
    texts.mapInArrow(_score_rows(sc.broadcast(weights), sc.broadcast(vocabulary)), _ROW_DDL).write.parquet(at)
    scored = spark.read.parquet(at)

    total, room = float(vocabulary.tokens), vocabulary.tokens + SMOOTH * (vocabulary.distinct + 1)
    outputs = spark.createDataFrame(
        [(int(o), float(vocabulary.mass[o] + SMOOTH * (vocabulary.kinds[o] + 1))) for o in range(OUTPUTS)], "o long, mass double")
    rare = (scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
            .select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
            .join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
            .join(F.broadcast(outputs), _open_column(F.col("h")) == F.col("o"))  # OUTPUTS rows
            .groupBy("row").agg(
                F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_2"),
                F.sum(F.col("times") * F.log10((F.col("c") + SMOOTH) / F.lit(room))).alias("base_2"),
                F.sum(F.col("times") * F.log10((F.col("c") + SMOOTH) / F.col("mass"))).alias("score_2")))
    zero = F.lit(0.0)
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_2", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_2", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("score_2", zero)).alias("score"))
