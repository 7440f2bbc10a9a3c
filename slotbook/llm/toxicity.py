"""Toxic spans by a linear-chain conditional random field.

Tokens are the lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, each tagged
toxic or not.

1. ``labels.toxic`` marks documents; a training token is labelled toxic if its
   document is and its word is one that toxic documents hold far too often to be
   chance (a likelihood-ratio test on document counts over all usable labels,
   whatever their number; of the words that pass, the ``MAX_LEXICON`` most significant).  A Bloom filter
   of the labels' ids, of ``BLOOM_BITS`` at most, drops nearly all unlabelled texts before texts meet their labels.
2. The field has hashed features of the word, its beginning and end, and its neighbours, and
   transition weights.  Tasks run stochastic gradient steps on their part of at
   most ``MAX_TRAIN`` labelled documents, chosen by hash (toxic ones first up to a tenth of
   them, or up to their share of all; of the others one in ``PLAIN_PART``); Spark averages each weight over the tasks
   that met it, and the next round goes on from there.
3. Every text is scored by forward-backward; a token's marginal is its probability
   to be toxic.  A document's score is the probability that some token is, over
   tokens with a marginal of at least ``FLOOR``; offending tokens (marginal of at
   least 0.5) are given by their character offsets.

Labels are read only where crc32(doc_id as text) mod 5 is not 0.  Defined results:
null, empty or wordless texts score 0; labels that are null, not 0/1 or contradict
each other are not learnt from; without toxic labels every score is 0;
repeated rows each get a row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotbook.session import scratch_path

from . import words as W
from .quality_classifier import held_out, usable

HASHED = 1 << 16
KINDS = 5               # word, first letters, last letters, word before, word after
MAX_TRAIN = 20_000      # documents
PLAIN_PART = 5          # one in so many of the sampled documents without the label is trained on
MAX_LEXICON = 20_000    # words
BLOOM_BITS = 1 << 24    # the filter has 16 a label, and no more than these
SIGNIFICANT = 10.0      # log-likelihood ratio of a word's document counts
ROUNDS, PARTS, PASSES = 2, 12, 4
FLOOR, THRESHOLD = 0.05, 0.5
_END = W.U(0x5851F42D4C957F2D)


class Text:
    """Words of a slice of rows and their feature cells."""

    def __init__(self, buf, off):
        buf = W.LOWER[buf]
        self.starts, self.ends, self.word_off = W.spans(buf, off, W.ALNUM)
        self.h = W.hashes(buf, self.starts, self.ends)
        n = len(self.h)
        if not n:
            self.cells = np.zeros((KINDS, 0), np.int64)
            return
        head = W.hashes(buf, self.starts, np.minimum(self.starts + 4, self.ends))
        tail = W.hashes(buf, np.maximum(self.ends - 4, self.starts), self.ends)
        before, after = np.append(_END, self.h[:-1]), np.append(self.h[1:], _END)
        live = np.flatnonzero(np.diff(self.word_off))
        before[self.word_off[live]] = _END
        after[self.word_off[live + 1] - 1] = _END
        each = np.stack([self.h, head, tail, before, after])
        each ^= W.mix(np.arange(1, KINDS + 1).astype(W.U))[:, None]
        self.cells = (W.mix(each) >> W.U(48)).astype(np.int64)


class Field:
    """Weights: hashed features (toxic against not), then the bias and the three
    transitions that leave not -> not at 0: not -> toxic, toxic -> not, toxic -> toxic."""

    def __init__(self, weights=None):
        self.w = np.zeros(HASHED + 4) if weights is None else weights
        if weights is None:
            self.w[HASHED] = -4.0

    def odds(self, text: Text):
        """Forward and backward odds of toxic against not, and the emissions."""
        emit = np.exp(np.clip(self.w[:HASHED][text.cells].sum(0) + self.w[HASHED], -30, 30))
        not_tox, tox_not, tox_tox = np.exp(self.w[HASHED + 1:HASHED + 4])
        size = np.diff(text.word_off)
        order = np.argsort(-size, kind="stable")
        begin, size = text.word_off[:-1][order], size[order]
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # rows with more than t words
        fwd, bwd = np.empty(len(emit)), np.empty(len(emit))
        r = None
        for t in range(longest):
            at = begin[:active[t]] + t
            if t:
                r = r[:active[t]]
                r = emit[at] * (not_tox + r * tox_tox) / (1 + r * tox_not)
            else:
                r = emit[at]
            fwd[at] = r
        last = begin + size - 1
        b = np.ones(len(size))
        for t in range(longest):
            at = last[:active[t]] - t
            if t:
                x = emit[at + 1] * b[:active[t]]
                b[:active[t]] = (tox_not + tox_tox * x) / (1 + not_tox * x)
            bwd[at] = b[:active[t]]
        return fwd, bwd, emit

    def marginals(self, text: Text) -> np.ndarray:
        if not len(text.h):
            return np.zeros(0)
        fwd, bwd, _ = self.odds(text)
        o = fwd * bwd
        return o / (1 + o)

    def step(self, text: Text, tags: np.ndarray, rate: float, squares: np.ndarray) -> None:
        """One AdaGrad step up the log-likelihood of the tags."""
        if not len(text.h):
            return
        fwd, bwd, emit = self.odds(text)
        o = fwd * bwd
        miss = tags - o / (1 + o)
        near = np.ones(len(tags), bool)
        near[text.word_off[:-1][np.diff(text.word_off) > 0]] = False
        t = np.flatnonzero(near)
        r, x = fwd[t - 1], emit[t] * bwd[t]
        a = np.exp(self.w[HASHED + 1:HASHED + 4])
        joint = np.stack([a[0] * x, a[1] * r, a[2] * r * x])
        joint /= 1 + joint.sum(0)
        seen = np.stack([(1 - tags[t - 1]) * tags[t], tags[t - 1] * (1 - tags[t]), tags[t - 1] * tags[t]])
        grad = np.bincount(text.cells.ravel(), np.tile(miss, KINDS), HASHED + 4)
        grad[HASHED] = miss.sum()
        grad[HASHED + 1:] = (seen - joint).sum(1)
        grad -= 1e-3 * self.w
        squares += grad * grad
        self.w += rate * grad / np.sqrt(squares + 1e-3)


def _lexicon_rows(batches):
    schema = pa.schema([("word", pa.int64()), ("df", pa.int64()), ("tox", pa.int64())])
    for rows, buf, off in W.slices(batches, "text"):
        text = Text(buf, off)
        row = np.repeat(np.arange(len(rows)), np.diff(text.word_off))
        order = np.lexsort((text.h, row))
        h, row = text.h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        word, which = np.unique(h[new], return_inverse=True)
        label = rows.column(1).to_numpy()[row[new]]
        yield W.table(schema, word=W.signed(word), df=np.bincount(which, minlength=len(word)),
                      tox=np.bincount(which, label, len(word)).astype(np.int64))


def lexicon(rows: DataFrame, total: int, toxic: int) -> np.ndarray:
    """Sorted hashes of words that toxic documents of ``rows`` (text, label) hold too often;
    ``toxic`` of ``total`` rows are."""
    if not 0 < toxic < total:
        return np.zeros(0, W.U)
    share = toxic / total
    df, tox = F.col("df"), F.col("tox")
    p = tox / df
    ratio = (tox * F.log(p / share) + F.when(tox < df, (df - tox) * F.log((1 - p) / (1 - share))).otherwise(0))
    at = scratch_path(rows.sparkSession, "toxic-words")
    (rows.select("text", "label").mapInArrow(_lexicon_rows, "word long, df long, tox long").groupBy("word")
     .agg(F.sum("df").alias("df"), F.sum("tox").alias("tox")).filter(p > (1 + share) / 2)
     .withColumn("ratio", ratio).filter(F.col("ratio") > SIGNIFICANT).select("word", "ratio").write.parquet(at))
    words = rows.sparkSession.read.parquet(at)
    size, least, n = F.floor(64 * F.log2("ratio")).alias("size"), None, 0
    for least, some in sorted(words.groupBy(size).count().collect(), reverse=True):  # a bound first: few rows are sorted
        n += some
        if n >= MAX_LEXICON:
            break
    found = (words.filter(size >= least).orderBy(F.desc("ratio"), "word").limit(MAX_LEXICON).select("word").collect()
             if least is not None else [])
    return np.sort(np.array([r[0] for r in found], np.int64).view(W.U))


def training_labels(labels: DataFrame, total: int, toxic: int) -> DataFrame:
    """At most MAX_TRAIN of ``labels`` by hash: toxic ones as often as in all of them, but
    the first tenth of the sample is theirs if there are so many."""
    taken = min(toxic, max(MAX_TRAIN // 10, round(MAX_TRAIN * toxic / max(1, total))))

    def some(label, n, of):
        rows = labels.filter(F.col("label") == label)
        if of > 2 * n + 1000:  # only the least hashes can be taken: about n of them and a margin are sorted
            room = (n + 6 * n**0.5 + 100) / of
            rows = rows.filter(F.xxhash64("doc_id") < int((2 * room - 1) * 2.0**63))
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    return some(1, taken, toxic).unionByName(some(0, MAX_TRAIN - taken, total - toxic))


def maybe_labelled(texts: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """The rows of ``texts`` whose doc_id may be among the ``n`` of ``known``: all that are, and few others
    unless there are very many labels.  No text is moved."""
    bits = min(BLOOM_BITS, 1 << max(10, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(bits))
    held = known.groupBy(F.shiftright(place, 6).alias("bloom_at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id, 'label'), {bits}) & 63 as int))")).alias("bloom_word"))
    rows = texts.withColumn("bloom_place", place).withColumn("bloom_at", F.shiftright(F.col("bloom_place"), 6))
    return (rows.join(F.broadcast(held), "bloom_at")  # BLOOM_BITS / 64 rows of two numbers
            .filter("shiftright(bloom_word, cast(bloom_place & 63 as int)) & 1 = 1").select(*texts.columns))


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The trained field, or None without toxic labels."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    at = scratch_path(spark, "toxic-labels")
    usable(labels, "toxic").write.parquet(at)
    known = spark.read.parquet(at)
    n = texts.select("doc_id").join(known, "doc_id").agg(F.count("*"), F.sum("label")).first()
    total, toxic = n[0], n[1] or 0
    toxic_words = lexicon(maybe_labelled(texts, known, known.count()).join(known, "doc_id"), total, toxic)
    if not len(toxic_words):
        return None
    at = scratch_path(spark, "toxic-sample")
    (texts.join(F.broadcast(training_labels(known, total, toxic)), "doc_id").select("doc_id", "text", "label")
     .write.parquet(at))  # MAX_TRAIN rows
    sample = spark.read.parquet(at)
    schema = pa.schema([("cell", pa.int32()), ("weight", pa.float64())])
    part = sample.filter((F.col("label") == 1) | (F.xxhash64("doc_id") % PLAIN_PART == 0)).repartition(PARTS, "doc_id")
    weights = Field().w
    for turn in range(ROUNDS):
        def fit(batches, start=weights, rate=0.5 / (1 + turn)):
            field, squares = Field(start.copy()), np.zeros(HASHED + 4)
            for rows, buf, off in W.slices(batches, "text", 256 << 10):
                text = Text(buf, off)
                row = np.repeat(np.arange(len(rows)), np.diff(text.word_off))
                tags = np.isin(text.h, toxic_words) & (rows.column(2).to_numpy()[row] == 1)
                for _ in range(PASSES):
                    field.step(text, tags.astype(float), rate, squares)
            cell = np.flatnonzero(squares > 1e-6)
            yield W.table(schema, cell=cell.astype(np.int32), weight=field.w[cell])

        rows = (part.mapInArrow(fit, "cell int, weight double").groupBy("cell")
                .agg(F.avg("weight").alias("weight")).collect())  # at most HASHED + 4 rows
        weights = weights.copy()
        weights[[r.cell for r in rows]] = [r.weight for r in rows]
    return Field(weights)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, and the character
    ranges of offending tokens (``starts``, ``ends``)."""
    field = train(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(field)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()),
                        ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def score(batches):
        for rows, buf, off in W.slices(batches, "text"):
            n = len(rows)
            got, starts, ends = np.zeros(n), [[] for _ in range(n)], [[] for _ in range(n)]
            if held.value is not None:
                text = Text(buf, off)
                m = held.value.marginals(text)
                row = np.repeat(np.arange(n), np.diff(text.word_off))
                at = np.flatnonzero(m >= FLOOR)
                got = np.abs(np.expm1(np.bincount(row[at], np.log1p(-np.minimum(m[at], 1 - 1e-12)), n)))
                chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))  # code points before each byte
                for k in np.flatnonzero(m >= 0.5):
                    first = chars[off[row[k]]]
                    starts[row[k]].append(chars[text.starts[k]] - first)
                    ends[row[k]].append(chars[text.ends[k]] - first)
            yield W.table(schema, doc_id=rows.column(0), held_out=rows.column(2), score=got,
                          predicted=(got >= THRESHOLD).astype(np.int32), starts=starts, ends=ends)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out("doc_id", 5).alias("held_out"))
            .mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, starts array<long>, ends array<long>"))
