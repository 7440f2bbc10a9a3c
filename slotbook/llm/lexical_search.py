"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

Terms are the words ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased.

1. ``build`` cuts the documents into shards (slices of ``SHARD_BYTES`` of text; a longer text is a shard by itself) and
   writes one row a shard: its documents' ids and lengths, and for every term (a 64-bit hash) the list
   of its documents with their term counts.
2. Queries are taken in blocks of about ``BLOCK_TERMS`` terms, by hash; a block travels with the tasks.  A pass over the shards'
   term tables gives the block's document frequencies.
3. A second pass ranks every query in every shard.  The query's shortest lists, up to
   ``SHORT`` of a shard's documents together, are evaluated term at a time into summed
   accumulators.  These then count as one iterator with bounds, beside the long lists with theirs:
   a window of ``WINDOW`` documents is skipped where the greatest accumulator and the greatest
   entries of the long lists cannot reach the score of the k-th document so far.  The
   windows that are left are evaluated document at a time in order, the accumulators
   first, then the long lists by falling bound until the rest can no longer matter.
   The k-th score is carried from shard to shard of a task.
4. A task gives each query's k best; they are ranked in two rounds, so a query's candidates never meet in one task at once.

Scores are integers: a term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), and a document gets
the sum of w * (10**9 * tf div (1000 * tf + 8 * m)), m = 25 + 75 * n * N div L, over the query's
terms, repeats included; equal scores by ascending doc_id.

Defined results: null, empty and wordless texts hold no term: such documents are
never found, such queries find nothing; every row is a document or a query of its own, so repeated ones are ranked
(or answered) each; null doc_ids rank behind equal scores; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotbook.session import scratch_path

from . import words as W

K = 10
SHARD_BYTES = 24 << 20
BLOCK_TERMS = 1 << 17
SHORT = 0.25            # entries of the lists taken term at a time, over the documents of a shard
WINDOW = 64             # documents
RUN = 16                # windows evaluated together
MERGE = 64              # parts of a query's candidates in the first round of ranking
NO_ID = np.iinfo(np.int64).max


def _terms(buf, off):
    """Hashes of a slice's terms, and each row's range of them."""
    buf = W.LOWER[buf]
    starts, ends, word_off = W.spans(buf, off, W.ALNUM)
    return W.hashes(buf, starts, ends), word_off


def _groups(*keys):
    """First places of runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


# --- the index ----------------------------------------------------------------------------
_SHARD = pa.schema([("doc_id", pa.list_(pa.int64())), ("n", pa.binary()), ("terms", pa.binary()), ("sizes", pa.binary()),
                    ("docs", pa.binary()), ("tf", pa.binary()), ("n_live", pa.int64()), ("n_terms", pa.int64())])
_SHARD_DDL = "doc_id array<long>, n binary, terms binary, sizes binary, docs binary, tf binary, n_live long, n_terms long"


def _shards(batches):
    for rows, buf, off in W.slices(batches, "text", SHARD_BYTES):
        h, word_off = _terms(buf, off)
        if not len(h):
            continue
        n = np.diff(word_off)
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), n)
        order = np.argsort(h, kind="stable")  # a term's documents stay in order
        h, doc = h[order], doc[order]
        first = _groups(h, doc)
        tf = np.diff(np.append(first, len(h)))
        head = _groups(h[first])
        yield pa.RecordBatch.from_arrays([
            pa.array([rows.column(0)], pa.list_(pa.int64())),
            *[pa.array([x.tobytes()], pa.binary()) for x in (
                n.astype("<i8"), h[first][head].astype("<u8"), np.diff(np.append(head, len(first))).astype("<i4"),
                doc[first].astype("<i4"), tf.astype("<i4"))],
            pa.array([int((n > 0).sum())]), pa.array([len(h)])], schema=_SHARD)


def build(docs: DataFrame, path: str) -> None:
    """Write the index of ``docs`` (doc_id, text) to the folder ``path``."""
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_shards, _SHARD_DDL)
     .write.option("compression", "zstd").parquet(path))


# --- queries ------------------------------------------------------------------------------
def _query_rows(batches):
    schema = pa.schema([("item", pa.int64()), ("term", pa.int64()), ("times", pa.int64())])
    for rows, buf, off in W.slices(batches, "text"):
        h, word_off = _terms(buf, off)
        item = np.repeat(rows.column(0).to_numpy(), np.diff(word_off))
        order = np.lexsort((h, item))
        first = _groups(item[order], h[order]) if len(h) else order
        yield W.table(schema, item=item[order][first], term=W.signed(h[order][first]), times=np.diff(np.append(first, len(h))))


class Block:
    """The queries of a block: for each item its terms (places in ``terms``) and how often it has them."""

    def __init__(self, rows):
        rows = np.array(rows, np.int64).reshape(-1, 3)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        self.items, cut = np.unique(rows[:, 0], return_index=True)
        self.terms, place = np.unique(rows[:, 1].view(W.U), return_inverse=True)
        cut = np.append(cut, len(rows))
        self.of = [(place[i:j], rows[i:j, 2]) for i, j in zip(cut[:-1], cut[1:])]
        self.weight = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: dict[int, int], n: int) -> None:
        for k in range(len(self.terms)):
            self.weight[k] = math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df.get(k, 0) + 1)))


def _found(terms, want):
    """(places in ``want``, places in the sorted ``terms``) of the equal ones."""
    at = np.minimum(np.searchsorted(terms, want), len(terms) - 1)
    some = np.flatnonzero(terms[at] == want)
    return some, at[some]


def _frequencies(index: DataFrame, block) -> dict[int, int]:
    """Place of a term in the block -> number of documents that hold it."""
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def run(batches):
        want = block.value.terms
        df = np.zeros(len(want), np.int64)
        for batch in batches:
            for terms, sizes in zip(batch.column(0), batch.column(1)):
                some, at = _found(np.frombuffer(terms.as_buffer(), "<u8"), want)
                df[some] += np.frombuffer(sizes.as_buffer(), "<i4")[at]
        some = np.flatnonzero(df)
        yield W.table(schema, term=some, df=df[some])

    rows = index.select("terms", "sizes").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df"))
    return dict(map(tuple, rows.collect()))  # a row a term of the block


# --- evaluation ----------------------------------------------------------------------------
class Best:
    """The k best documents of one query so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def floor(self) -> int:
        """A score below this cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def offer(self, score, doc, null):
        score, doc, null = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


class Shard:
    """Lists of a shard's terms that a block asks for, as impacts in document order."""

    def __init__(self, row: dict, block: Block, n_docs: int, n_terms: int):
        n = np.frombuffer(row["n"], "<i8")
        terms, sizes = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        some, at = _found(terms, block.terms)
        begin, size = (np.cumsum(sizes) - sizes)[at], sizes[at]
        entries = W.ranges(begin, size)
        self.docs = np.frombuffer(row["docs"], "<i4")[entries]
        tf = np.frombuffer(row["tf"], "<i4")[entries].astype(np.int64)
        if 75 * n_docs * int(n.max()) < 1 << 63:
            m = 25 + 75 * n * n_docs // n_terms
        else:
            m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        self.size = np.zeros(len(block.terms), np.int64)
        self.begin = np.zeros(len(block.terms), np.int64)
        self.size[some], self.begin[some] = size, np.cumsum(size) - size
        self.n, self.windows = len(n), -(-len(n) // WINDOW)
        self.tops: dict[int, np.ndarray] = {}

    def list_of(self, term):
        at = slice(self.begin[term], self.begin[term] + self.size[term])
        return self.docs[at], self.impact[at]

    def top(self, term):
        """Greatest impact of a term in every window."""
        if term not in self.tops:
            docs, impact = self.list_of(term)
            self.tops[term] = _by_window(docs, impact, self.windows)
        return self.tops[term]

    def rank(self, places, times, weight, best: Best, doc, null) -> None:
        """Offer this shard's documents to the k best of a query."""
        size = self.size[places]
        live = (size > 0) & (weight[places] > 0)
        order = np.argsort(size[live], kind="stable")
        places, size, pay = places[live][order], size[live][order], (weight[places] * times)[live][order]
        if not len(places):
            return
        short = int(np.searchsorted(np.cumsum(size), SHORT * self.n, "right"))
        # term at a time: sums of the short lists
        seen, sums = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if short:
            lists = [self.list_of(t) for t in places[:short]]
            docs = np.concatenate([d for d, _ in lists])
            gain = np.concatenate([x * p for (_, x), p in zip(lists, pay)])
            by = np.argsort(docs, kind="stable")
            first = _groups(docs[by])
            seen, sums = docs[by][first], np.add.reduceat(gain[by], first)
        floor = best.floor()
        if len(sums) >= best.k:  # so many documents get at least their sums
            floor = max(floor, int(np.partition(sums, len(sums) - best.k)[len(sums) - best.k]))
        # document at a time: the sums are one iterator beside the long lists
        bound = _by_window(seen, sums, self.windows)
        long_ = [(t, p, self.top(t) * p) for t, p in zip(places[short:], pay[short:])]
        for _, _, top in long_:
            bound = bound + top
        long_.sort(key=lambda x: -int(x[2].max()))
        rest = np.cumsum([0] + [int(top.max()) for _, _, top in reversed(long_)])[::-1]  # most that the lists from i on add
        lists = [(*self.list_of(t), p) for t, p, _ in long_]
        at = 0
        while True:
            ahead = np.flatnonzero(bound[at:] >= floor)  # windows that may hold one of the k best
            if not len(ahead):
                return
            begin = at + int(ahead[0])
            ahead = ahead[ahead < ahead[0] + RUN]
            end = at + int(ahead[-1]) + 1
            lo, hi = begin * WINDOW, min(end * WINDOW, self.n)
            score = np.zeros(hi - lo, np.int64)
            i, j = np.searchsorted(seen, (lo, hi))
            score[seen[i:j] - lo] = sums[i:j]
            for k, (docs, impact, p) in enumerate(lists):
                if int(score.max()) + rest[k] < floor:
                    break
                i, j = np.searchsorted(docs, (lo, hi))
                score[docs[i:j] - lo] += impact[i:j] * p
            else:
                good = np.flatnonzero(score >= floor)
                if len(good):
                    best.offer(score[good], doc[good + lo], null[good + lo])
                    floor = max(floor, best.floor())
            at = end


def _by_window(docs, values, windows):
    out = np.zeros(windows, np.int64)
    if len(docs):
        window = docs // WINDOW
        first = _groups(window)
        out[window[first]] = np.maximum.reduceat(values, first)
    return out


def _search(index: DataFrame, block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        asked = block.value
        best = [Best(k) for _ in asked.items]
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(0).slice(r, 1).flatten()
                doc, null = ids.fill_null(NO_ID).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                row = {name: batch.column(i)[r].as_buffer() for i, name in enumerate(batch.schema.names) if i}
                shard = Shard(row, asked, n_docs, n_terms)
                for b, (places, times) in zip(best, asked.of):
                    shard.rank(places, times, asked.weight, b, doc, null)
        for item, b in zip(asked.items, best):
            if len(b.score):
                yield W.table(schema, item=np.full(len(b.score), item), doc_id=pa.array(b.doc, mask=b.null), score=b.score)

    return index.select("doc_id", "n", "terms", "sizes", "docs", "tf").mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int, *key: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of the index ``path`` for each row of
    ``queries`` (item_id, text)."""
    index = spark.read.parquet(path)
    n_docs, n_terms = index.agg(F.sum("n_live"), F.sum("n_terms")).first()
    at = scratch_path(spark, "queries")
    queries.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").write.parquet(f"{at}/items")
    items = spark.read.parquet(f"{at}/items")
    items.select("item", "text").mapInArrow(_query_rows, "item long, term long, times long").write.parquet(f"{at}/terms")
    terms = spark.read.parquet(f"{at}/terms")
    blocks = -(-terms.count() // BLOCK_TERMS) if n_docs else 0
    for b in range(blocks):
        own = terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        block = Block([tuple(r) for r in own.collect()])  # about BLOCK_TERMS rows
        held = spark.sparkContext.broadcast(block)
        block.weigh(_frequencies(index, held), n_docs)
        held.unpersist()
        held = spark.sparkContext.broadcast(block)
        _search(index, held, n_docs, n_terms, k).write.mode("append").parquet(f"{at}/found")
        held.unpersist()
    if not blocks:
        found = spark.createDataFrame([], "item long, doc_id long, score long")
    else:
        found = spark.read.schema("item long, doc_id long, score long").parquet(f"{at}/found")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE))
    best = _ranked(_ranked(found.withColumn("part", part), k, "item", "part").drop("rank", "part"), k, "item")
    return best.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``search`` over an index of ``docs`` made for it."""
    path = scratch_path(docs.sparkSession, "lexical-index")
    build(docs, path)
    return search(docs.sparkSession, path, queries, k)
