"""Token ids in binary blocks coded by a static range asymmetric numeral system (rANS).

``write`` encodes texts with a given tokenizer, appends an end id to each document and writes

* ``table``: (id, freq), the shared frequencies of all ids, scaled to sum 2**SCALE (each id that
  occurs has 1 or more);
* ``blocks``: the ids in ascending doc_id order (null first; equal doc_ids by a hash of their
  text, equal rows in any order), cut into parts by range and each part into blocks of ``BLOCK`` ids
  whatever the documents' bounds.  A block says whose ids it holds: ``row`` (a number of
  the input row), ``doc_id`` and ``size`` of every piece.

A block is decoded without any other.  Little-endian, it is the ``HEAD`` (magic, number of
ids, steps, words and checkpoints, crc32 of the ids as unsigned 32-bit integers, crc32 of the
table), the checkpoints, the words (u32) and the crc32 of all bytes before.  ``LANES`` interleaved
coders (64-bit states, 32-bit words) take the ids in turn; a checkpoint, every ``EVERY`` steps, holds the place of the
next word and the lanes' states, so reading can begin there.  The last step is filled with the likeliest id.

``read`` decodes all blocks side by side and checks every checksum (an error names the block);
``documents`` sums documents up, those that span blocks by joining the checksums of their pieces.

A text is encoded word by word (``[^\\x20\\x09-\\x0D]+``), each different word of a slice once (``Speller``);
that gives the ids of the whole text for every tokenizer whose pieces never cross white
space, as is checked when it is loaded (``check_tokenizer``).  The tokenizer file's content travels with the
tasks.

Defined results: null and empty texts are the end id alone; bytes that are not UTF-8 become U+FFFD; repeated
rows are written each; null doc_ids come first; an empty table gives no block and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from functools import lru_cache
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

END_ID = 1
SCALE = 20
LANES, STEPS, EVERY = 32, 1024, 256
BLOCK = LANES * STEPS
GROUP = 128              # blocks coded side by side
PIECE_IDS = 1 << 20      # ids a row of the encoded texts; longer texts have several rows
PART_IDS = 1 << 22       # ids a part, about; at most MAX_PARTS parts
MAX_PARTS = 1 << 16
SLICE_BYTES = 6 << 20
MAGIC = 0x31534E52       # "RNS1"
HEAD = struct.Struct("<7I")
_POINT = np.dtype([("word", "<u4"), ("state", "<u8", LANES)])
_LOW = np.uint64(1 << 31)
_U = np.uint64


#: Normalizer and pieces of the tokenizer files that `Speller` can cut up itself.
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_PIECES = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Letters whose case, class and normal form are plain: ranges of Latin, Greek, Cyrillic, kana and ideographs.
_RANGES = ((0xC0, 0x24F), (0x391, 0x3C9), (0x410, 0x45F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5))


def _plain_letters() -> str:
    """A regular expression's class of plain letters."""
    good = [chr(c) for low, high in _RANGES for c in range(low, high + 1)]
    good = [c for c in good if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and c != "Σ"]
    out, first = ["a-zA-Z"], 0
    for i in range(1, len(good) + 1):
        if i == len(good) or ord(good[i]) != ord(good[i - 1]) + 1:
            out.append(f"{good[first]}-{good[i - 1]}")
            first = i
    return "".join(out)


def _byte_names() -> np.ndarray:
    """Code point of every byte in byte-level spelling: visible bytes stand for themselves, the others for 256 and
    on, in order; the space, which here lies between pieces, stays."""
    names = np.arange(256, dtype="<u4")
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    names[hidden] = 256 + np.arange(len(hidden))
    names[32] = 32
    return names


class Speller:
    """Ids of words by a tokenizer file.

    Where the file's normalizer and pieces are the ones above, words of ASCII and plain letters are cut into pieces here, and only
    different pieces are given to the file's model, many in one string; an id that ends a piece shows it in
    its spelling.  The ids of ``KEPT`` pieces are kept, from task to task of a worker (then all are forgotten).  All other words go through the whole
    tokenizer one by one.
    """

    CHUNK, KEPT = 2000, 1 << 18

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.whole = Tokenizer.from_str(content)
        suffix = spec["model"].get("end_of_word_suffix")
        self.bare = None
        if (spec.get("normalizer") == PLAIN_NORMALIZER and spec.get("pre_tokenizer") == PLAIN_PIECES and suffix
                and all("<|" in t["content"] for t in spec.get("added_tokens") or [])):
            spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(spec))
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
            letters = _plain_letters()
            self.strange = re.compile(rf"[^{letters}\n!-~]|<\|")
            self.pieces = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^{letters}0-9\n]+")
            self.names = _byte_names()
            self._forget()

    def _forget(self):
        self.known: dict[str, int] = {"\n": 0}  # piece -> its number; a line break has no ids
        self.count, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each); words hold no white space."""
        if self.bare is None:
            return self._one_by_one(words)
        blob = "\n".join(words)
        line_ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        odd = np.unique(np.searchsorted(line_ends, [m.start() for m in self.strange.finditer(blob)], "right"))
        rare, rare_count = self._one_by_one([words[k] for k in odd])
        usual = np.ones(len(words), bool)
        usual[odd] = False
        flat, count = self._by_pieces([w for w, u in zip(words, usual) if u] if len(odd) else words)
        if not len(odd):
            return flat, count
        both = np.zeros(len(words), np.int64)
        both[usual], both[odd] = count, rare_count
        out = np.empty(int(both.sum()), np.int64)
        mark = np.repeat(usual, both)
        out[mark], out[~mark] = flat, rare
        return out, both

    def _by_pieces(self, words):
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spelt = self.pieces.findall("\n".join(words).lower())
        if len(self.known) > self.KEPT:
            self._forget()
        which = np.fromiter(map(self.known.get, spelt, repeat(-1)), np.int64, len(spelt))
        unmet = np.flatnonzero(which < 0)
        if len(unmet):
            unmet_pieces = [spelt[k] for k in unmet]
            new = list(dict.fromkeys(unmet_pieces))
            flat, count = [self.flat], [self.count]
            for i in range(0, len(new), self.CHUNK):
                own = new[i:i + self.CHUNK]
                ids = np.array(self._model_ids(" ".join(own)), np.int64)
                last = np.flatnonzero(self.ends[ids])
                if len(last) != len(own):
                    raise ValueError("the tokenizer's ids do not show where pieces end")
                flat.append(ids)
                count.append(np.diff(last, prepend=-1))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.flat, self.count = np.concatenate(flat), np.concatenate(count)
            which[unmet] = np.fromiter(map(self.known.__getitem__, unmet_pieces), np.int64, len(unmet))
        at = np.cumsum(self.count) - self.count
        is_piece = which != 0
        word = np.cumsum(~is_piece)[is_piece]
        used = which[is_piece]
        return self.flat[W.ranges(at[used], self.count[used])], np.bincount(word, self.count[used], len(words)).astype(np.int64)

    def _model_ids(self, line: str) -> list[int]:
        if not line.isascii():
            line = self.names[np.frombuffer(line.encode(), np.uint8)].tobytes().decode("utf-32-le")
        return self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids

    def _one_by_one(self, words):
        lists = []
        for i in range(0, len(words), self.CHUNK):
            lists += [e.ids for e in self.whole.encode_batch_fast(words[i:i + self.CHUNK], add_special_tokens=False)]
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.int64, int(count.sum())), count


@lru_cache(maxsize=1)
def speller(content: str) -> Speller:
    """The speller of a worker process: its tasks share the ids of the pieces they have met."""
    return Speller(content)


def check_tokenizer(content: str) -> None:
    """An error unless the tokenizer's pieces never cross white space."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(content)
    loose = [t["content"] for t in json.loads(content).get("added_tokens") or []
             if t.get("lstrip") or t.get("rstrip") or t["content"].split() != [t["content"]]]
    parts = ["don't", "42nd", "É!?", "x.y", "<|endoftext|>", "\u0301e", "日本", "Straße", "ΣΑΣ", "İ", "we'LL", "\"'s\"", "\x7f", "a\xa0b"]
    whole = made.encode(" \t".join(parts), add_special_tokens=False).ids
    if loose or whole != Speller(content).ids(parts)[0].tolist():
        raise ValueError("this tokenizer's pieces depend on white space; its texts cannot be encoded word by word")


# --- ids of texts ------------------------------------------------------------------------
def _decoded(words: pa.Array) -> list[str]:
    """Words (without line breaks) as text; bytes that are not UTF-8 become U+FFFD."""
    one = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
    return pc.binary_join(one, pa.scalar(b"\n", words.type))[0].as_py().decode("utf-8", "replace").split("\n")


def _word_ids(buf, off, speller):
    """Ids of each row of a slice with the end id after it: (ids, offsets)."""
    inside = W.SPACED[buf]
    starts, ends, word_off = W.spans(buf, off)
    n = len(starts)
    size, flat, at = np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    which = np.zeros(0, np.int64)
    if n:
        place = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        spelt = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(place), pa.py_buffer(buf[inside])])
        coded = spelt.dictionary_encode()
        flat, count = speller.ids(_decoded(coded.dictionary))
        which = coded.indices.to_numpy()
        at = np.cumsum(count) - count
        size = count[which]
    before = np.concatenate([[0], np.cumsum(size)])[word_off]  # ids before each row, end ids left out
    row_off = before + np.arange(len(off))
    ids = np.full(row_off[-1], END_ID, np.uint32)
    own = np.ones(len(ids), bool)
    own[row_off[1:] - 1] = False
    if n:
        ids[own] = flat.astype(np.uint32)[W.ranges(at[which], size)]
    return ids, row_off


def width(content: str) -> str:
    """Kind of integer that holds all ids of a tokenizer file."""
    spec = json.loads(content)
    most = max([END_ID, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])])
    return "<u2" if most < 1 << 16 else "<u4"


_TEXT_IDS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("row", pa.int64()), ("seq", pa.int32()),
                       ("n", pa.int32()), ("ids", pa.binary())])
_TEXT_IDS_DDL = "doc_id long, digest long, row long, seq int, n int, ids binary"


def encoded(docs: DataFrame, content: str) -> DataFrame:
    """(doc_id, digest, row, seq, n, ids): the ids (see ``width``) of every document, at most PIECE_IDS a row."""
    kind = width(content)
    held = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        own = speller(held.value)
        for rows, buf, off in W.slices(batches, "text", SLICE_BYTES):
            ids, row_off = _word_ids(buf, off, own)
            pieces = -(-np.diff(row_off) // PIECE_IDS)
            which = np.repeat(np.arange(len(rows)), pieces)
            seq = W.ranges(np.zeros(len(rows), np.int64), pieces)
            begin = row_off[which] + seq * PIECE_IDS
            end = np.minimum(begin + PIECE_IDS, row_off[which + 1])
            bounds = pa.py_buffer((np.dtype(kind).itemsize * np.append(begin, end[-1])).astype(np.int32))  # pieces follow each other
            data = pa.Array.from_buffers(pa.binary(), len(which), [None, bounds, pa.py_buffer(ids.astype(kind))])
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [rows.column(k).take(take) for k in range(3)]
                + [pa.array(seq, pa.int32()), pa.array(end - begin, pa.int32()), data], schema=_TEXT_IDS)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"),
                        F.monotonically_increasing_id().alias("row"), "text")
    return texts.mapInArrow(run, _TEXT_IDS_DDL)


def id_counts(ids: DataFrame, kind: str) -> DataFrame:
    """(id, n): how often each id occurs; every task counts its own first."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                c = np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=len(seen))
                c[:len(seen)] += seen
                seen = c
        some = np.flatnonzero(seen)
        yield W.table(schema, id=some, n=seen[some])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- the coder -----------------------------------------------------------------------------
def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, 1 or more wherever a count is."""
    room = 1 << SCALE
    if (counts > 0).sum() > room:
        raise ValueError(f"{(counts > 0).sum()} different ids; the table holds {room}")
    share = counts * (room / max(1, counts.sum()))
    freq = np.where(counts > 0, np.maximum(1, np.floor(share)), 0).astype(np.int64)
    rest = room - int(freq.sum())
    order = np.argsort(-counts, kind="stable")[:max(1, int((counts > 0).sum()))]
    if rest > 0:
        freq[order[0]] += rest
    while rest < 0:  # ids raised to 1 are paid for by the frequent ones
        give = np.minimum(freq[order] - 1, -(rest // len(order)))
        give = np.where(np.cumsum(give) <= -rest, give, np.maximum(0, -rest - (np.cumsum(give) - give)))
        freq[order] -= give
        rest += int(give.sum())
    return freq


class Table:
    """Shared frequencies, their running sums, and the id of every slot."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        order = np.argsort(ids)
        self.ids, f = ids[order].astype(np.int64), freq[order].astype(np.int64)
        self.crc = zlib.crc32(self.ids.astype("<u4").tobytes() + f.astype("<u4").tobytes())
        self.freq, self.below = f.astype(_U), (np.cumsum(f) - f).astype(_U)
        self.slot = np.repeat(np.arange(len(f), dtype=np.int32), f)
        self.likeliest = int(np.argmax(f))
        self.place = np.zeros(int(self.ids[-1]) + 1, np.int32)
        self.place[self.ids] = np.arange(len(f))

    def places(self, ids: np.ndarray) -> np.ndarray:
        return self.place[ids]

    def encode(self, ids: np.ndarray) -> list[bytes]:
        """A block for each row of ``ids`` (blocks, ids a block), all of the same number of ids."""
        g, n = ids.shape
        steps = -(-n // LANES)
        k = np.full((g, steps * LANES), self.likeliest, np.int32)
        k[:, :n] = self.places(ids)
        k = k.reshape(g, steps, LANES)
        x = np.full((g, LANES), _LOW, _U)
        emitted, points = [], []
        written = np.zeros(g, np.int64)
        for t in range(steps - 1, -1, -1):
            f, c = self.freq[k[:, t]], self.below[k[:, t]]
            full = x >= f << _U(63 - SCALE)
            emitted.append((np.nonzero(full)[0], (x[full] & _U(0xFFFFFFFF)).astype("<u4")))
            written += full.sum(axis=1)
            x = np.where(full, x >> _U(32), x)
            q = x // f
            x = (q << _U(SCALE)) + (x - q * f) + c
            if t % EVERY == 0:
                points.append((written.copy(), x.copy()))
        block = np.concatenate([b for b, _ in reversed(emitted)])
        order = np.argsort(block, kind="stable")  # a block's words stay in the order of reading
        words = np.concatenate([w for _, w in reversed(emitted)])[order]
        cut = np.searchsorted(block[order], np.arange(g + 1))
        out = []
        for b in range(g):
            table = np.zeros(len(points), _POINT)
            for i, (count, state) in enumerate(reversed(points)):
                table[i] = (written[b] - count[b], state[b])
            own = words[cut[b]:cut[b + 1]]
            data = b"".join([HEAD.pack(MAGIC, n, steps, len(own), len(points), zlib.crc32(ids[b].astype("<u4").tobytes()), self.crc),
                             table.tobytes(), own.tobytes()])
            out.append(data + struct.pack("<I", zlib.crc32(data)))
        return out

    def decode(self, blocks: list[bytes], point: int = 0) -> list[np.ndarray]:
        """The ids of each block from its checkpoint ``point`` on; whole blocks are held against
        their checksum."""
        heads = [self._head(data) for data in blocks]
        found: list = [None] * len(blocks)
        for n, steps in {h[1:3] for h in heads}:
            some = [b for b, h in enumerate(heads) if h[1:3] == (n, steps)]
            for b, ids in zip(some, self._decoded([blocks[b] for b in some], [heads[b] for b in some], point)):
                if point == 0 and zlib.crc32(ids.astype("<u4").tobytes()) != heads[b][5]:
                    raise ValueError("the ids of a block do not match their checksum")
                found[b] = ids
        return found

    def _head(self, data: bytes):
        if len(data) < HEAD.size + 4 or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("a block does not match its checksum")
        head = HEAD.unpack_from(data)
        if head[0] != MAGIC or head[6] != self.crc:
            raise ValueError("a block of another format or table")
        return head

    def _decoded(self, blocks, heads, point):
        n, steps = heads[0][1:3]
        points = [np.frombuffer(d, _POINT, h[4], HEAD.size) for d, h in zip(blocks, heads)]
        words = [np.frombuffer(d, "<u4", h[3], HEAD.size + h[4] * _POINT.itemsize) for d, h in zip(blocks, heads)]
        base = np.cumsum([0] + [len(w) for w in words])[:-1]
        stream = np.concatenate([*words, np.zeros(1, "<u4")]).astype(_U)
        x = np.stack([p["state"][point] for p in points]).astype(_U)
        at = base + np.array([int(p["word"][point]) for p in points])
        out = np.empty((len(blocks), steps - point * EVERY, LANES), np.int32)
        for t in range(point * EVERY, steps):
            slot = x & _U((1 << SCALE) - 1)
            k = self.slot[slot.astype(np.int64)]
            out[:, t - point * EVERY] = k
            x = self.freq[k] * (x >> _U(SCALE)) + slot - self.below[k]
            low = x < _LOW
            took = np.cumsum(low, axis=1)
            word = stream[np.where(low, at[:, None] + took - 1, len(stream) - 1)]
            x = np.where(low, (x << _U(32)) | word, x)
            at += took[:, -1]
        first = point * EVERY * LANES
        return [self.ids[row.ravel()[:n - first]] for row in out]


# --- writing ---------------------------------------------------------------------------------
_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("at", pa.int64()), ("n", pa.int32()),
                     ("row", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("size", pa.list_(pa.int32())),
                     ("data", pa.binary())])
_BLOCKS_DDL = "part int, block int, at long, n int, row array<long>, doc_id array<long>, size array<int>, data binary"


def _cut(rows, ids, doc_ids, null, size, first, at, part, table):
    """Record batch of the blocks of consecutive ids and of the pieces in them."""
    whole = len(ids) // BLOCK
    data = table.encode(ids[:whole * BLOCK].reshape(whole, BLOCK)) if whole else []
    if len(ids) > whole * BLOCK:
        data += table.encode(ids[None, whole * BLOCK:])
    n = len(data)
    ends = np.cumsum(size)
    cuts = np.union1d(ends, np.minimum(BLOCK * np.arange(1, n + 1), len(ids)))
    begin = np.append(0, cuts[:-1])
    piece = np.searchsorted(ends, begin, "right")
    block_off = pa.array(np.searchsorted(begin, np.minimum(BLOCK * np.arange(n + 1), len(ids))).astype(np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, part), pa.int32()), pa.array(first + np.arange(n), pa.int32()), pa.array(at + BLOCK * np.arange(n), pa.int64()),
        pa.array(np.diff(np.minimum(BLOCK * np.arange(n + 1), len(ids))), pa.int32()),
        pa.ListArray.from_arrays(block_off, pa.array(rows[piece], pa.int64())),
        pa.ListArray.from_arrays(block_off, pa.array(doc_ids[piece], pa.int64(), mask=null[piece])),
        pa.ListArray.from_arrays(block_off, pa.array(cuts - begin, pa.int32())),
        pa.array(data, pa.binary())], schema=_BLOCKS)


def write(docs: DataFrame, content: str, path: str) -> None:
    """Write the ids of ``docs`` (doc_id, text) under the folder ``path``; ``content`` is a tokenizer
    file's text."""
    check_tokenizer(content)
    spark = docs.sparkSession
    encoded(docs, content).write.parquet(f"{path}/ids")
    ids = spark.read.parquet(f"{path}/ids")
    kind = width(content)
    counts = np.array([tuple(r) for r in id_counts(ids, kind).collect()], np.int64).reshape(-1, 2)  # a row an id of the vocabulary
    freq = scaled(counts[:, 1]) if len(counts) else counts[:, 1]
    spark.createDataFrame([(int(i), int(f)) for i, f in zip(counts[:, 0], freq)], "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    table = spark.sparkContext.broadcast(Table(counts[:, 0], freq)) if len(counts) else None
    parts = int(min(MAX_PARTS, max(1, -(-counts[:, 1].sum() // PART_IDS), spark.sparkContext.defaultParallelism)))

    def run(batches):
        speller.cache_clear()  # a worker that codes has no more texts to spell
        part, held, waiting, block, at = TaskContext.get().partitionId(), [], 0, 0, 0

        def flushed(all_):
            nonlocal held, waiting, block, at
            ids, rows, doc_ids, null, size = (np.concatenate(x) for x in zip(*held))
            keep = 0 if all_ else len(ids) % BLOCK
            n = len(ids) - keep
            ends = np.cumsum(size)
            last = int(np.searchsorted(ends, n))  # the piece that the n-th id ends or lies in
            own = size[:last + 1].copy()
            own[-1] -= ends[last] - n
            out = _cut(rows[:last + 1], ids[:n], doc_ids[:last + 1], null[:last + 1], own, block, at, part, table.value)
            block, at = block + out.num_rows, at + n
            rest = size[last:].copy()
            rest[0] = ends[last] - n
            live = rest > 0
            held = [(ids[n:], rows[last:][live], doc_ids[last:][live], null[last:][live], rest[live])]
            waiting = keep
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # 256 pieces of PIECE_IDS ids at most
                b = batch.slice(i, 256)
                off = np.frombuffer(b.column(4).buffers()[1], np.int32)[b.column(4).offset:][:b.num_rows + 1]
                ids = np.frombuffer(b.column(4).buffers()[2], np.uint8)[off[0]:off[-1]].view(kind)
                held.append((ids, b.column(2).to_numpy(), b.column(0).fill_null(0).to_numpy(),
                             b.column(0).is_null().to_numpy(zero_copy_only=False), np.diff(off).astype(np.int64) // ids.itemsize))
                waiting += len(ids)
                if waiting >= GROUP * BLOCK:
                    yield flushed(False)
        if waiting:
            yield flushed(True)

    order = [F.col("doc_id").asc_nulls_first(), "digest", "row", "seq"]
    rows = ids.select("doc_id", "digest", "row", "seq", "ids")
    (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
     .mapInArrow(run, _BLOCKS_DDL).write.parquet(f"{path}/blocks"))


# --- reading -----------------------------------------------------------------------------------
def load_table(spark: SparkSession, path: str) -> Table | None:
    """The shared table of a folder (one row an id of the vocabulary), None for no document."""
    rows = np.array([tuple(r) for r in spark.read.parquet(f"{path}/table").collect()], np.int64).reshape(-1, 2)
    return Table(rows[:, 0], rows[:, 1]) if len(rows) else None


def _over_blocks(spark, path, make, ddl):
    """``make(batch, ids of its blocks)`` over all blocks."""
    held = spark.sparkContext.broadcast(load_table(spark, path))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, GROUP):
                b = batch.slice(i, GROUP)
                try:
                    ids = held.value.decode(b.column(7).to_pylist())
                except ValueError as exc:
                    raise ValueError(f"{exc}: part {b.column(0)[0]}, blocks {b.column(1)[0]} to {b.column(1)[-1]}") from None
                yield make(b, ids)

    return spark.read.parquet(f"{path}/blocks").select(*_BLOCKS.names).mapInArrow(run, ddl)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(row, doc_id, part, at, ids): the pieces of documents in all blocks; a document's
    pieces follow each other by (part, at)."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def make(b, ids):
        size = b.column(6).flatten().to_numpy().astype(np.int64)
        bounds = np.append(0, np.cumsum(size)).astype(np.int32)
        count = np.diff(b.column(6).offsets.to_numpy())
        base = np.repeat(b.column(2).to_numpy() - np.append(0, np.cumsum(b.column(3).to_numpy()))[:-1], count)
        return pa.RecordBatch.from_arrays([
            b.column(4).flatten(), b.column(5).flatten(), pa.array(np.repeat(b.column(0).to_numpy(), count)),
            pa.array(base + bounds[:-1], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids), pa.int32()))], schema=schema)

    return _over_blocks(spark, path, make, "row long, doc_id long, part int, at long, ids array<int>")


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of crc32, bits reflected."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """crc32 of bytes from those of its consecutive pieces: (crc32, number of bytes)."""
    out = 0
    for crc, size in pieces:
        power, x = 8 * size, 1 << 30  # x is X ** 2 ** k
        while power:
            if power & 1:
                out = _times(out, x)
            x, power = _times(x, x), power >> 1
        out ^= crc
    return out


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its blocks."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()),
                        ("n", pa.int64()), ("crc", pa.int64())])

    def make(b, ids):
        size = b.column(6).flatten().to_numpy().astype(np.int64)
        ends = np.cumsum(size)
        data = memoryview(np.concatenate(ids).astype("<u4").tobytes())
        crc = [zlib.crc32(data[4 * (e - s):4 * e]) for s, e in zip(size.tolist(), ends.tolist())]
        count = np.diff(b.column(6).offsets.to_numpy())
        base = np.repeat(b.column(2).to_numpy() - np.append(0, np.cumsum(b.column(3).to_numpy()))[:-1], count)
        return pa.RecordBatch.from_arrays([
            b.column(4).flatten(), b.column(5).flatten(), pa.array(np.repeat(b.column(0).to_numpy(), count)),
            pa.array(base + ends - size, pa.int64()), pa.array(size), pa.array(crc, pa.int64())], schema=schema)

    pieces = _over_blocks(spark, path, make, "row long, doc_id long, part int, at long, n long, crc long")
    sizes = sorted(map(tuple, spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n")).collect()))  # MAX_PARTS
    before = spark.createDataFrame([(p, s - n) for (p, n), s in zip(sizes, accumulate(n for _, n in sizes))], "part int, before long")
    pieces = pieces.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("at"))  # MAX_PARTS rows
    one = (pieces.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"),
                                     F.collect_list(F.struct("start", "n", "crc")).alias("pieces"))
           .select("doc_id", "start", "n_tokens", F.col("pieces")[0]["crc"].alias("ids_crc32"),
                   F.when(F.size("pieces") > 1, F.sort_array("pieces")).alias("pieces")))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def joined(batches):
        for batch in batches:
            crc = batch.column(3).to_numpy().copy()
            for k in np.flatnonzero(batch.column(4).is_valid().to_numpy(zero_copy_only=False)):
                crc[k] = joined_crc([(p["crc"], 4 * p["n"]) for p in batch.column(4)[k].as_py()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc)], schema=out)

    return one.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
