"""Substring dedup by relative Lempel-Ziv parsing.

The corpus is its own reference.  Every text is cut into *phrases*: runs of
consecutive ``size``-word windows that share one anchor, the smallest hash of a
short word gram inside the window.  The cut depends on the words around it only, so
equal passages are cut alike in every document.  The phrase index (anchor,
content, smallest doc_id) lies in as many blocks as Spark has partitions, and
every phrase of every document is looked up in the block that may hold it:
each reference block is consulted, none is shipped whole to one task.

* A phrase held by an earlier document is copied whole.
* The first holder of a phrase may still share part of it with another phrase
  of the same anchor; that happens at factor boundaries.  Those phrases, and no
  others, are looked up window by window.

Per document the copied windows are then joined greedily, left to right, into
factors; a factor that begins inside the one before it is the check at the
boundary.  Factors have at least ``size`` words and become duplicate spans.

The result is exact (up to 128-bit hash equality): a word is removed if and
only if some ``size``-word window over it also starts in a document with a
smaller doc_id.  All shuffles carry one row a phrase or contested window, of
fixed width, and are aggregated map-side; no key's rows are gathered.

Defined results: null or empty text has no words; texts under ``size`` words lose
nothing; a null doc_id neither loses words nor serves as a reference; repeated
rows (same id and text) each get the same result; repeats inside one document, or
between rows of one doc_id, are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotbook.session import scratch_path

from . import words as W

SIZE = 50
GRAM = 10  # words of an anchor

_PHRASE = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("anchor", pa.int64()),
                     ("content", pa.int64()), ("place", pa.int64())])
_WINDOW = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("anchor", pa.int64()),
                     ("content", pa.int64()), ("place", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.float64(): "double",
             pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>",
             pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have, span = x, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    extra = width - span
    return np.minimum(have[:len(have) - extra], have[extra:]) if extra else have


class _Parsed:
    """Anchors and window hashes of one slice of rows."""

    def __init__(self, buf, off, size: int, gram: int):
        self.starts, self.ends, self.word_off = W.spans(buf, off)
        h = W.hashes(buf, self.starts, self.ends)
        self.prefix = W.Prefix(h)
        n = len(h)
        whole = W.Prefix(h, 1)
        self.version = W.signed(whole.window(self.word_off[:-1], self.word_off[1:]))
        self.at = W.starts_of(self.word_off, size)  # window starts
        if not len(self.at):
            return
        self.row = np.searchsorted(self.word_off, self.at, "right") - 1
        i = np.arange(n - gram + 1)
        grams = whole.window(i, i + gram)
        # The low bits carry the position, so the minimum tells where it is.
        packed = (grams & ~W.U(63)) | (i & 63).astype(W.U)
        low = _sliding_min(packed, size - gram + 1)[self.at]
        self.anchor_at = self.at + (((low & W.U(63)).astype(np.int64) - self.at) & 63)
        self.anchor = grams[self.anchor_at]

    def phrases(self):
        """(first window, number of windows) of each phrase, as indexes into ``at``."""
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor_at[1:] != self.anchor_at[:-1]) | (self.row[1:] != self.row[:-1])
        first = np.flatnonzero(new)
        return first, np.diff(np.append(first, len(self.at)))


def _phrase_rows(size: int, gram: int):
    def run(batches):
        for rows, buf, off in W.slices(batches, "text", W.SMALL_SLICE):
            p = _Parsed(buf, off, size, gram)
            if not len(p.at):
                continue
            first, count = p.phrases()
            begin = p.at[first]
            row = p.row[first]
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            yield W.table(_PHRASE, doc_id=ids[row], version=p.version[row],
                          anchor=W.signed(p.anchor[first]),
                          content=W.signed(p.prefix.window(begin, begin + count + size - 1)),
                          place=((begin - p.word_off[row]) << 6) | count)
    return run


def _window_rows(size: int, gram: int):
    """Windows of the phrases whose anchors are listed in the last column; doc_id comes first."""
    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.columns[-1].is_valid())
            for rows, buf, off in W.slices([batch], "text", W.SMALL_SLICE):
                p = _Parsed(buf, off, size, gram)
                if not len(p.at):
                    continue
                listed = rows.columns[-1]
                each = np.diff(listed.offsets.to_numpy())
                wanted = W.mix(listed.flatten().to_numpy().view(W.U)) ^ np.repeat(np.arange(len(rows)), each).astype(W.U)
                hit = np.flatnonzero(np.isin(W.mix(p.anchor) ^ p.row.astype(W.U), wanted))
                if not len(hit):
                    continue
                begin, row = p.at[hit], p.row[hit]
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                yield W.table(_WINDOW, doc_id=ids[row], version=p.version[row],
                              anchor=W.signed(p.anchor[hit]),
                              content=W.signed(p.prefix.window(begin, begin + size)),
                              place=((begin - p.word_off[row]) << 6) | 1)
    return run


def factor_spans(place: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Word spans from copied windows, packed as (first window << 6 | windows).

    Left to right: a factor takes as many consecutive copied windows as there are;
    one that begins before the last ended (a boundary) lengthens that span.
    """
    place = np.unique(place)
    begin, end = place >> 6, (place >> 6) + (place & 63) + size - 1
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(begin[1:] > end[:-1])
    return list(zip(begin[np.append(0, cut + 1)].tolist(), end[np.append(cut, len(end) - 1)].tolist()))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                  ("kept_sha256", pa.string()), ("kept_text", pa.string()),
                  ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _apply(size: int, with_text: bool):
    def run(batches):
        for batch in batches:
            for rows, buf, off in W.slices([batch], "text", W.SMALL_SLICE):
                raw = buf.tobytes()
                listed = rows.column(2).to_pylist()
                out = {f.name: [] for f in _OUT}
                for i, doc_id in enumerate(rows.column(0).to_pylist()):
                    tokens = raw[off[i]:off[i + 1]].split()
                    spans = []
                    if listed[i]:
                        both = np.array([(x["version"], x["place"]) for x in listed[i]], np.int64)
                        own = W.spans(buf[off[i]:off[i + 1]], np.array([0, off[i + 1] - off[i]]))
                        h = W.hashes(buf[off[i]:off[i + 1]], own[0], own[1])
                        version = W.signed(W.Prefix(h, 1).window(np.array([0]), np.array([len(h)])))[0]
                        place = both[both[:, 0] == version, 1]
                        spans = factor_spans(place, size) if len(place) else []
                    kept, last = [], 0
                    for a, b in spans:
                        kept += tokens[last:a]
                        last = b
                    kept = kept + tokens[last:] if spans else tokens
                    text = b" ".join(kept)
                    out["doc_id"].append(doc_id)
                    out["n_words"].append(len(tokens))
                    out["n_removed"].append(len(tokens) - len(kept))
                    out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                    out["kept_text"].append(text.decode() if with_text else None)
                    out["starts"].append([a for a, _ in spans])
                    out["ends"].append([b for _, b in spans])
                yield W.table(_OUT, **out)
    return run


def _earlier(rows: DataFrame, first: DataFrame) -> DataFrame:
    """(doc_id, version, place) of rows whose content an earlier document holds."""
    return (rows.join(first, ["anchor", "content"])
            .filter(F.col("doc_id") > F.col("first")).select("doc_id", "version", "place"))


def _holders(rows: DataFrame) -> DataFrame:
    return rows.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def copied(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, version, place): windows of ``docs`` that an earlier document holds.

    All columns of ``docs`` are shuffled by doc_id, though only the text is read: a
    caller who joins the same ``docs`` with the result has the same exchange, and
    Spark then shuffles the texts once for both.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    at = scratch_path(spark, "phrases")
    docs.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(
        _phrase_rows(size, gram), _ddl(_PHRASE)).write.parquet(at)
    rows = spark.read.parquet(at)
    at = scratch_path(spark, "holders")
    _holders(rows).write.parquet(at)
    holders = spark.read.parquet(at)

    whole = _earlier(rows, holders.filter("first < last").select("anchor", "content", "first"))
    contested = (holders.groupBy("anchor")
                 .agg(F.min("content").alias("c0"), F.max("content").alias("c1"),
                      F.min("first").alias("d0"), F.max("last").alias("d1"))
                 .filter("c0 < c1 and d0 < d1").select("anchor"))
    listed = (holders.join(contested, "anchor").groupBy(F.col("first").alias("doc_id"))
              .agg(F.collect_set("anchor").alias("anchors")))
    windows = docs.join(listed, "doc_id", "left").mapInArrow(_window_rows(size, gram), _ddl(_WINDOW))
    firsts = _holders(windows).filter("first < last").select("anchor", "content", "first")
    return whole.unionByName(_earlier(windows, firsts))


def dedup(docs: DataFrame, size: int = SIZE, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, and the removed
    word spans (``starts``, ``ends``); ``kept_text`` if ``with_text``, else null."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    spans = copied(texts, size).groupBy("doc_id").agg(F.collect_list(F.struct("version", "place")).alias("spans"))
    return (texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
            .mapInArrow(_apply(size, with_text), _ddl(_OUT)))


def deduplicated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with the duplicate spans cut out of ``text`` (all other characters
    stay as they are) and, if there is such a column, ``n_chars`` counted anew."""
    names = docs.columns
    at = names.index("text")
    named = [F.col(c).alias("text" if i == at else f"c{i}") for i, c in enumerate(names)]
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *named)
    spans = copied(left, size).groupBy("doc_id").agg(F.collect_list(F.struct("version", "place")).alias("spans"))
    joined = left.join(spans, "doc_id", "left")

    def cut(batches):
        for batch in batches:
            out = list(batch.columns[1:-1])
            texts = out[at].to_pylist()
            for i, listed in enumerate(batch.columns[-1].to_pylist()):
                if not listed or not texts[i]:
                    continue
                raw = texts[i].encode()
                buf = np.frombuffer(raw, np.uint8)
                starts, ends, word_off = W.spans(buf, np.array([0, len(buf)]))
                h = W.hashes(buf, starts, ends)
                version = W.signed(W.Prefix(h, 1).window(word_off[:1], word_off[1:]))[0]
                place = np.array([x["place"] for x in listed if x["version"] == version], np.int64)
                if not len(place):
                    continue
                kept, last = [], 0
                for a, b in factor_spans(place, size):
                    kept.append(raw[last:starts[a]])
                    last = starts[b] if b < len(starts) else len(raw)
                texts[i] = b"".join([*kept, raw[last:]]).decode()
            out[at] = pa.array(texts, out[at].type)
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names[1:-1])

    out = joined.mapInArrow(cut, docs.select(*named).schema).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
