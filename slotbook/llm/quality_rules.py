"""Quality rules by suffix-array repetition.

For each text, a suffix array over its words (of the suffixes whose first three
words occur twice; others repeat nothing of that length) and the common prefix of
neighbours in it.  A suffix's longer common prefix with its two neighbours is the
longest substring at that place that the text holds again, so these are the
maximal repeats of the LCP intervals.  Repeats of at least ``MIN_REPEAT`` words are
unioned; the verdict limits the covered fraction and the longest one.

All texts of a slice are handled at once in numpy; nothing is shuffled.

Defined results: null or empty texts have zero counts and fail the base rule (too
few words); repeated rows each get a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

GRAM = 3
MIN_REPEAT = 10        # words of a repeat that counts
MAX_COVERED = 0.30     # of the words
MAX_REPEAT = 0.15      # longest repeat, of the words ...
MAX_REPEAT_WORDS = 60  # ... if it also has more words than this

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
                  ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
                  ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("covered_words", pa.int64()),
                  ("longest_repeat", pa.int64())])
_OUT_DDL = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, kept boolean, covered_words long, longest_repeat long")


def _cover(at: np.ndarray, size, n: int) -> np.ndarray:
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + size, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def suffix_array(sa: np.ndarray, rank: np.ndarray, row_end: np.ndarray, step: int) -> np.ndarray:
    """Sort suffixes by prefix doubling.  ``sa`` is ordered by its first ``step``
    words; ``rank[p]`` is the place in ``sa`` of the first suffix equal so far (for
    other positions a number no other has).  Only undecided places are sorted."""
    sa, rank = sa.copy(), rank.copy()
    same = np.zeros(len(sa) + 1, bool)
    same[1:-1] = rank[sa[1:]] == rank[sa[:-1]]
    live = np.flatnonzero(same[1:] | same[:-1])
    while len(live):
        p = sa[live]
        nxt = np.where(p + step < row_end[p], rank[np.minimum(p + step, len(rank) - 1)], -1)
        order = np.lexsort((nxt, rank[p]))
        p, r, nxt = p[order], rank[p][order], nxt[order]
        sa[live] = p
        new = np.ones(len(p) + 1, bool)
        new[1:-1] = (r[1:] != r[:-1]) | (nxt[1:] != nxt[:-1])
        rank[p] = live[np.maximum.accumulate(np.where(new[:-1], np.arange(len(p)), 0))]
        live = live[~(new[:-1] & new[1:])]
        step *= 2
    return sa


def common_prefix(prefix: W.Prefix, p: np.ndarray, q: np.ndarray, row_end: np.ndarray, least: int) -> np.ndarray:
    """Words that the suffixes p and q share, known to be ``least`` or more."""
    lo = np.full(len(p), least)
    hi = row_end[np.maximum(p, q)] - np.maximum(p, q)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_] + 1) // 2
        a, b = p[open_], q[open_]
        same = prefix.window(a, a + mid) == prefix.window(b, b + mid)
        lo[open_] = np.where(same, mid, lo[open_])
        hi[open_] = np.where(same, hi[open_], mid - 1)


def repeats(h: np.ndarray, word_off: np.ndarray):
    """(words in repeated GRAM-word windows, longest repeat that begins at each word)."""
    n = len(h)
    longest = np.zeros(n, np.int64)
    at = W.starts_of(word_off, GRAM)
    if not len(at):
        return np.zeros(n, bool), longest
    prefix = W.Prefix(h, 1)
    row = np.searchsorted(word_off, at, "right") - 1
    key = W.mix(prefix.window(at, at + GRAM) + row.astype(W.U) * W.U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    sorted_key = key[order]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = sorted_key[1:] == sorted_key[:-1]
    twice = at[order[same[1:] | same[:-1]]]  # grouped by their first words
    if not len(twice):
        return np.zeros(n, bool), longest
    in_window = _cover(twice, GRAM, n)
    gram = np.zeros(n, W.U)
    gram[at] = key
    new = np.ones(len(twice), bool)
    new[1:] = gram[twice[1:]] != gram[twice[:-1]]
    rank = len(twice) + np.arange(n)
    rank[twice] = np.maximum.accumulate(np.where(new, np.arange(len(twice)), 0))
    row_end = np.repeat(word_off[1:], np.diff(word_off))
    sa = suffix_array(twice, rank, row_end, GRAM)
    p, q = sa[:-1], sa[1:]
    near = np.flatnonzero(gram[p] == gram[q])
    lcp = common_prefix(prefix, p[near], q[near], row_end, GRAM)
    np.maximum.at(longest, p[near], lcp)
    np.maximum.at(longest, q[near], lcp)
    return in_window, longest


def _lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.split(None, 1):
            seen.add(line)
    return n


def _rules(batches):
    for rows, buf, off in W.slices(batches, "text"):
        starts, ends, word_off = W.spans(buf, off)
        h = W.hashes(buf, starts, ends)
        size = np.diff(word_off)
        in_window, longest = repeats(h, word_off)
        at = np.flatnonzero(longest >= MIN_REPEAT)
        covered = _cover(at, longest[at], len(h)) if len(at) else np.zeros(len(h), bool)

        def per_row(mask, by):
            return np.diff(np.append(0, np.cumsum(mask))[by])

        head = W.SPACED[buf] & ((buf & 0xC0) != 0x80)  # first bytes of code points in words
        repeated = per_row(in_window, word_off)
        cover = per_row(covered, word_off)
        most = np.zeros(len(rows), np.int64)
        if len(h):
            live = np.flatnonzero(size)
            most[live] = np.maximum.reduceat(longest, word_off[live])
        raw = buf.tobytes()
        failed = (size < 50) | (100 * repeated > 50 * size)
        bad = (cover > MAX_COVERED * size) | ((most > MAX_REPEAT_WORDS) & (most > MAX_REPEAT * size))
        yield W.table(_OUT, doc_id=rows.column(0), n_words=size, word_chars=per_row(head, off),
                      n_symbols=per_row(SYMBOLS[buf], off),
                      n_dup_lines=[_lines(raw[off[i]:off[i + 1]]) for i in range(len(rows))],
                      n_repeat_words=repeated, base_failed=failed, kept=~failed & ~bad,
                      covered_words=cover, longest_repeat=most)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, covered_words, longest_repeat."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_rules, _OUT_DDL)
