"""Benchmark decontamination with suffix arrays of the training texts.

The training texts are cut into shards (row slices of bounded size, whole
documents).  Each shard gets a suffix array over its word hashes, of the
suffixes that begin like some benchmark window (``LEAD`` words; the others cannot
match one).  Every benchmark window start is binary-searched in every shard;
its interval of the array holds all verbatim occurrences, and occurrences that
go on along one diagonal are one longer match.  A window is ``size`` consecutive
item words, or the whole item if it has fewer.

The benchmark reaches the tasks in chunks of at most ``CHUNK_CHARS`` characters
(an item is never split; a longer one is a chunk of its own), whatever its size and
whichever rows share an item_id; with one chunk the documents are
scanned once and nothing is shuffled, with more each chunk's finds are
written and merged per document.

Defined results: null, empty or wordless texts have no words and are not
contaminated; wordless items have no window; equal items all count, as do rows that share an
item_id, each by its own row; repeated
document rows each get a row; an empty benchmark leaves every document clean; an
empty document table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotbook.session import scratch_path

from . import words as W

SIZE = 13
LEAD = 3
CHUNK_CHARS = 2 << 20
SHARE = 20  # contaminated if SHARE * n_hit >= n_words


class Tests:
    """The distinct windows of some benchmark items, ready for the search."""

    def __init__(self, items: list[tuple], size: int, rows: list[int] | None = None):
        self.size = size
        raw = [("" if t is None else t).encode() for _, t in items]
        buf = W.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        off = np.cumsum([0] + [len(x) for x in raw])
        starts, ends, word_off = W.spans(buf, off, W.ALNUM)
        self.words = np.append(W.hashes(buf, starts, ends), np.zeros(size, W.U))
        n = np.diff(word_off)
        short = np.flatnonzero((n > 0) & (n < size))
        begin = np.concatenate([W.starts_of(word_off, size), word_off[short]]).astype(np.int64)
        item = np.concatenate([np.searchsorted(word_off, begin[:len(begin) - len(short)], "right") - 1, short])
        length = np.minimum(n[item], size)
        prefix = W.Prefix(self.words, 1)
        _, first, which = np.unique(prefix.window(begin, begin + length), return_index=True, return_inverse=True)
        self.at, self.length = begin[first], length[first]
        order = np.argsort(which, kind="stable")
        self.items = item[order]  # items of window w: items[item_off[w]:item_off[w + 1]]
        self.item_off = np.searchsorted(which[order], np.arange(len(first) + 1))
        self.ids = [str(i) for i, _ in items]
        self.rows = rows or list(range(len(items)))  # numbers of the benchmark rows
        self.leads = {}  # words of lead -> sorted hashes of such leads
        lead = np.minimum(self.length, LEAD)
        for k in range(1, LEAD + 1):
            some = self.at[lead == k]
            self.leads[k] = np.unique(prefix.window(some, some + k))


def _suffix_array(words: np.ndarray, end: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts ``at`` in the order of their first ``depth`` words; nothing follows ``end``."""
    keys = [np.where(at + k < end, words[np.minimum(at + k, len(words) - 1)], W.U(0)) for k in range(depth)]
    return at[np.lexsort(keys[::-1])]


def _bound(words, row_end, sa, tests: Tests, upper: bool) -> np.ndarray:
    """For each window, the first suffix not below it (``upper``: above all that begin with it)."""
    lo, hi = np.zeros(len(tests.at), np.int64), np.full(len(tests.at), len(sa))
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        p, t, size = sa[mid], tests.at[open_], tests.length[open_]
        less = np.full(len(open_), upper)  # equal as far as the window goes
        undecided = np.ones(len(open_), bool)
        for k in range(tests.size):
            x = np.where(p + k < row_end[p], words[np.minimum(p + k, len(words) - 1)], W.U(0))
            y = tests.words[t + k]
            now = undecided & (k < size) & (x != y)
            less[now] = x[now] < y[now]
            undecided &= ~now
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)


def search(words: np.ndarray, word_off: np.ndarray, tests: Tests):
    """All occurrences: (window, position) arrays."""
    none = np.zeros(0, np.int64)
    if not len(words) or not len(tests.at):
        return none, none
    row_end = np.repeat(word_off[1:], np.diff(word_off))
    prefix = W.Prefix(words, 1)
    begins = np.zeros(len(words), bool)
    for k, leads in tests.leads.items():
        if len(leads):
            at = np.flatnonzero(np.arange(len(words)) + k <= row_end)
            h = prefix.window(at, at + k)
            # a small bitmap first: most words lead nowhere
            bits = np.zeros(1 << 20, bool)
            bits[(leads & W.U((1 << 20) - 1)).astype(np.int64)] = True
            maybe = np.flatnonzero(bits[(h & W.U((1 << 20) - 1)).astype(np.int64)])
            begins[at[maybe[np.isin(h[maybe], leads)]]] = True
    at = np.flatnonzero(begins)
    if not len(at):
        return none, none
    sa = _suffix_array(words, row_end[at], at, tests.size)
    low, high = (_bound(words, row_end, sa, tests, upper) for upper in (False, True))
    return np.repeat(np.arange(len(low)), high - low), sa[W.ranges(low, high - low)]


def _hits(words, word_off, tests: Tests):
    """(hit mask by word, row of each find, item of each find, longest match by row)."""
    window, place = search(words, word_off, tests)
    size = tests.length[window]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + size, -1)
    row = np.searchsorted(word_off, place, "right") - 1
    pair = np.unique(row * max(1, len(tests.at)) + window)
    r, w = pair // max(1, len(tests.at)), pair % max(1, len(tests.at))
    count = tests.item_off[w + 1] - tests.item_off[w]
    found = np.unique(np.repeat(r, count) * max(1, len(tests.ids)) + tests.items[W.ranges(tests.item_off[w], count)])
    # runs along a diagonal; equal windows of other items share their first place in the benchmark
    longest = np.zeros(len(word_off) - 1, np.int64)
    if len(place):
        diagonal = place - tests.at[window]
        order = np.lexsort((place, diagonal, row))
        p, d, q, s = place[order], diagonal[order], row[order], size[order]
        new = np.ones(len(p), bool)
        new[1:] = (d[1:] != d[:-1]) | (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        np.maximum.at(longest, q[first], p[last] + s[last] - p[first])
    return np.cumsum(edge[:-1]) > 0, found // max(1, len(tests.ids)), found % max(1, len(tests.ids)), longest


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                  ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64()),
                  ("items", pa.list_(pa.string()))])
_OUT_DDL = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
            "longest_match long, items array<string>")
_FOUND = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("hit", pa.list_(pa.int64())),
                    ("items", pa.list_(pa.string())), ("item_rows", pa.list_(pa.int64())), ("longest", pa.int64())])
_FOUND_DDL = "doc_id long, version long, hit array<long>, items array<string>, item_rows array<long>, longest long"


def _parsed(buf, off):
    buf = W.LOWER[buf]
    starts, ends, word_off = W.spans(buf, off, W.ALNUM)
    return W.hashes(buf, starts, ends), word_off


def _by_row(n: int, rows: np.ndarray, items: np.ndarray, ids: list) -> list[list]:
    out: list[list] = [[] for _ in range(n)]
    for r, i in zip(rows.tolist(), items.tolist()):
        out[r].append(ids[i])
    return [sorted(x) for x in out]


def _result(ids, size, hit, items, longest):
    return W.table(_OUT, doc_id=ids, n_words=size, n_hit=hit, n_items=[len(x) for x in items],
                   items_sha256=[hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
                   contaminated=(hit > 0) & (SHARE * hit >= size), longest_match=longest, items=items)


def _whole(tests):
    def run(batches):
        for rows, buf, off in W.slices(batches, "text", W.SMALL_SLICE):
            words, word_off = _parsed(buf, off)
            mask, r, i, longest = _hits(words, word_off, tests.value)
            total = np.append(0, np.cumsum(mask))
            yield _result(rows.column(0), np.diff(word_off), np.diff(total[word_off]),
                          _by_row(len(rows), r, i, tests.value.ids), longest)
    return run


def _found(tests):
    def run(batches):
        for rows, buf, off in W.slices(batches, "text", W.SMALL_SLICE):
            words, word_off = _parsed(buf, off)
            mask, r, i, longest = _hits(words, word_off, tests.value)
            version = W.signed(W.Prefix(words, 1).window(word_off[:-1], word_off[1:]))
            some = np.unique(r)
            if len(some):
                items = _by_row(len(rows), r, i, list(zip(tests.value.ids, tests.value.rows)))
                ids = rows.column(0).to_pylist()
                yield W.table(_FOUND, doc_id=[ids[k] for k in some], version=version[some],
                              hit=[np.flatnonzero(mask[word_off[k]:word_off[k + 1]]) for k in some],
                              items=[[x for x, _ in items[k]] for k in some],
                              item_rows=[[x for _, x in items[k]] for k in some], longest=longest[some])
    return run


def _merged(batches):
    for batch in batches:
        for rows, buf, off in W.slices([batch], "text", W.SMALL_SLICE):
            words, word_off = _parsed(buf, off)
            version = W.signed(W.Prefix(words, 1).window(word_off[:-1], word_off[1:]))
            hit, items, longest = [], [], []
            for k, found in enumerate(rows.column(2).to_pylist()):
                own = [x for x in found or [] if x["version"] == version[k]]
                hit.append(len(set().union(*(x["hit"] for x in own))))
                items.append(sorted({pair for x in own for pair in zip(x["items"], x["item_rows"])}))
                longest.append(max([0, *(x["longest"] for x in own)]))
            yield _result(rows.column(0), np.diff(word_off), np.array(hit, np.int64),
                          [[i for i, _ in x] for x in items], longest)


def _pieces(chunk_chars: int):
    """Benchmark rows, numbered, in pieces of at most ``chunk_chars`` characters (or one row)."""
    schema = pa.schema([("piece", pa.int64()), ("row", pa.int64()), ("item", pa.string()), ("text", pa.string()), ("chars", pa.int64())])

    def run(batches):
        first, piece, n, held = TaskContext.get().partitionId() << 40, 0, 0, 0
        for batch in batches:
            chars = [len(t) + 1 for t in batch.column(1).to_pylist()]
            pieces = []
            for c in chars:
                if held and held + c > chunk_chars:
                    piece, held = piece + 1, 0
                held += c
                pieces.append(first + piece)
            yield W.table(schema, piece=pieces, row=np.arange(n, n + len(chars)) + first, item=[str(i) for i in batch.column(0).to_pylist()],
                          text=batch.column(1), chars=chars)
            n += len(chars)

    return run


def _chunks(items: DataFrame, chunk_chars: int):
    """(item id, text) pairs and row numbers of one chunk of the benchmark after the other."""
    at = scratch_path(items.sparkSession, "benchmark")  # written once, so the numbers hold
    (items.mapInArrow(_pieces(chunk_chars), "piece long, row long, item string, text string, chars long").write.parquet(at))
    rows = items.sparkSession.read.parquet(at)
    packs, held = [], 0
    for piece, chars in sorted(map(tuple, rows.groupBy("piece").agg(F.sum("chars")).collect())):  # a row a piece
        if not packs or held + chars > chunk_chars:
            packs.append([])
            held = 0
        packs[-1].append(piece)
        held += chars
    for pack in packs:
        got = rows.filter(F.col("piece").isin(pack)).select("row", "item", "text").collect()  # chunk_chars bounds this
        yield [(r.item, r.text) for r in got], [r.row for r in got]


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, longest_match (words), items."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    items = benchmark.select("item_id", "text").filter("text is not null")
    chars = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    if chars <= chunk_chars:
        tests = Tests([tuple(r) for r in items.collect()], size)  # chunk_chars bounds this
        return texts.mapInArrow(_whole(spark.sparkContext.broadcast(tests)), _OUT_DDL)
    held = []
    for some, rows in _chunks(items, chunk_chars):
        at = scratch_path(spark, "found")
        texts.mapInArrow(_found(spark.sparkContext.broadcast(Tests(some, size, rows))), _FOUND_DDL).write.parquet(at)
        held.append(at)
    found = (spark.read.parquet(*held).dropDuplicates(["doc_id", "version", "hit", "items", "item_rows"])
             .groupBy(F.col("doc_id").alias("of"))
             .agg(F.collect_list(F.struct("version", "hit", "items", "item_rows", "longest")).alias("found")))
    return (texts.join(found, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "found")
            .mapInArrow(_merged, _OUT_DDL))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated.  Each row is judged by its own text: rows
    are told apart by a hash of their doc_id, null or not, and text."""
    own = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    gone = (contamination(docs.select(own.alias("doc_id"), "text"), benchmark).filter("contaminated")
            .select(F.col("doc_id").alias("gone_id")).distinct())
    return docs.join(gone, own == F.col("gone_id"), "left_anti")
