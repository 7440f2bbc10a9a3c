"""Near-duplicate classes by SetSketch registers.

A text's set holds its distinct 5-word shingles (lower-cased; a shorter text is
one shingle), as 64-bit hashes.  Its sketch has ``REGISTERS`` registers: register
i is the smallest of the set's exponential variates of stream i on a truncated
exponential scale, ``clip(floor(1 - log_b(min)), 0, q + 1)``.  Sketches of
unions are register-wise maxima, and two registers agree about as often as the
sets overlap.

1. Texts with equal sets form a class (one aggregate); only its smallest
   doc_id, the representative, goes on, so exact copies cost one row each.
2. ``BANDS`` bands of ``ROWS`` registers key representatives into buckets.  At the
   lowest linked similarity a pair shares no bucket with probability below 1e-6.
3. Pairs of a bucket are taken from its centre (its smallest member, then a
   pseudo-random one a round) to its members of other components.  A pair inside
   one component can add nothing and is never formed.  Members of a bucket that
   are still apart then meet where they share one of their rarest shingles, as any
   linked pair does; so a large bucket of unlinked texts costs no pair each.
4. Each pair's registers give the likelihood of every similarity, jointly with
   both set sizes; pairs for which the threshold is out of reach are dropped.
5. What remains is decided on the full sets.  Links are contracted into
   components within tasks, then by alternating large-star and small-star steps.

Defined results: null, empty or blank texts have an empty set, no links, and
themselves as component; repeated rows (same id and text) share a class and each
get a row; a null doc_id has a null component and is not kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotbook.session import scratch_path

from . import words as W

SHINGLE = 5
NUM, DEN = 85, 100  # linked if DEN * intersection >= NUM * union
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
CENTRE_ROUNDS = 3
SLACK = 14.0  # log-likelihood a pair's best similarity may lead the threshold by

_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()),
                     ("set_b", pa.int64()), ("registers", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SKETCH_DDL = "doc_id long, n_shingles long, set_a long, set_b long, registers binary, bands array<long>"


def _streams() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, REGISTERS + 1).astype(W.U)
    return W.mix(k * W.U(0x9E3779B97F4A7C15)) | W.U(1), W.mix(k * W.U(0xC2B2AE3D27D4EB4F))


def shingle_sets(buf: np.ndarray, off: np.ndarray):
    """(hashes, set_off): each row's sorted distinct shingle hashes."""
    starts, ends, word_off = W.spans(buf, off)
    p = W.Prefix(W.hashes(buf, starts, ends))
    size = np.diff(word_off)
    at = W.starts_of(word_off, SHINGLE)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    row = np.concatenate([np.searchsorted(word_off, at, "right") - 1, short])
    begin = np.concatenate([at, word_off[short]])
    h = p.window(begin, np.concatenate([at + SHINGLE, word_off[short + 1]]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(off)))


def registers(h: np.ndarray, set_off: np.ndarray) -> np.ndarray:
    """SetSketch registers of non-empty sets, (sets, REGISTERS) uint16."""
    mult, add = _streams()
    low = np.empty((REGISTERS, len(set_off) - 1), W.U)
    for k in range(REGISTERS):
        low[k] = np.minimum.reduceat((h ^ add[k]) * mult[k], set_off[:-1])
    uniform = (low.T.astype(np.float64) + 0.5) / 2.0**64
    smallest = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, LIMIT + 1).astype("<u2")


def band_keys(reg: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, (sets, BANDS)."""
    parts = reg.reshape(len(reg), BANDS, ROWS).astype(W.U)
    key = np.broadcast_to(W.mix(np.arange(1, BANDS + 1).astype(W.U)), parts.shape[:2])
    for k in range(ROWS):
        key = W.mix(key * W.U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def _sketch_rows(batches):
    for rows, buf, off in W.slices(batches, "text", W.SMALL_SLICE):
        h, set_off = shingle_sets(W.LOWER[buf], off)
        size = np.diff(set_off)
        live = np.flatnonzero(size)
        a, b = np.zeros(len(rows), W.U), np.zeros(len(rows), W.U)
        reg, keys = [None] * len(rows), [None] * len(rows)
        if len(live):
            begin = set_off[live]
            a[live] = np.add.reduceat(W.mix(h ^ W.U(1)), begin)
            b[live] = np.add.reduceat(W.mix(h * W.U(0x9E3779B97F4A7C15)), begin)
            got = registers(h, np.append(begin, len(h)))
            band = W.signed(band_keys(got))
            for i, r in enumerate(live):
                reg[r], keys[r] = got[i].tobytes(), band[i]
        yield W.table(_SKETCH, doc_id=rows.column(0), n_shingles=size, set_a=W.signed(a), set_b=W.signed(b),
                      registers=reg, bands=keys)


def log_likelihood(n_a, n_b, above, below, equal, j):
    """Joint log-likelihood of similarity ``j`` from register comparisons and set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = np.minimum(j, np.minimum(u / v, v / u))

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))


def likely(n_a, n_b, reg_a, reg_b) -> np.ndarray:
    """Pairs that may reach the threshold."""
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    above, below = (reg_a > reg_b).sum(1), (reg_a < reg_b).sum(1)
    equal = REGISTERS - above - below
    grid = [log_likelihood(n_a, n_b, above, below, equal, j) for j in np.arange(0.02, 1.0, 0.02)]
    best = np.max(grid, axis=0)
    linked = np.max([log_likelihood(n_a, n_b, above, below, equal, j) for j in np.arange(NUM / DEN, 1.001, 0.025)], axis=0)
    return (np.minimum(n_a, n_b) * DEN >= np.maximum(n_a, n_b) * NUM) & (best - linked <= SLACK)


_PAIR = "a long, b long"
_PAIR_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_EDGE = "u long, v long"
_EDGE_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])
HELD_EDGES = 1 << 20  # edges that a task contracts at once


def _likely_rows(batches):
    for x in batches:
        if not x.num_rows:
            continue
        get = lambda c: x.column(x.schema.get_field_index(c))
        reg = [np.frombuffer(b"".join(get(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("reg_a", "reg_b")]
        ok = likely(get("n_a").to_numpy(), get("n_b").to_numpy(), *reg)
        yield pa.RecordBatch.from_arrays([get("a"), get("b")], schema=_PAIR_ARROW).filter(pa.array(ok))


def _set_rows(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("members", pa.binary())])
    for rows, buf, off in W.slices(batches, "text", W.SMALL_SLICE):
        h, set_off = shingle_sets(W.LOWER[buf], off)
        yield W.table(schema, doc_id=rows.column(0),
                      members=[h[set_off[i]:set_off[i + 1]].tobytes() for i in range(len(rows))])


def _linked_rows(batches):
    for x in batches:
        ok = []
        for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist()):
            p, q = np.frombuffer(p, W.U), np.frombuffer(q, W.U)
            both = np.concatenate([p, q])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            ok.append(DEN * common >= NUM * (len(p) + len(q) - common))
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], schema=_PAIR_ARROW).filter(pa.array(ok, pa.bool_()))


def _saved(df: DataFrame, name: str) -> DataFrame:
    at = scratch_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """The components of the edges (u, v) as edges (u, v) from each node to its component's smallest."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[:len(u)], at[len(u):]
    root = np.arange(len(node))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    far = np.flatnonzero(root != np.arange(len(node)))
    return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], schema=_EDGE_ARROW)


def _contracted_rows(batches):
    """A task's edges (u, v) as stars, HELD_EDGES at a time."""
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        n += batch.num_rows
        if n >= HELD_EDGES:
            yield _stars(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield _stars(*map(np.concatenate, zip(*held)))


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over the links (a, b).

    Every task contracts its own edges to stars.  Where those do not agree, alternating large-star and
    small-star steps follow; every step is an aggregate (smallest neighbour) and a join, so
    a hot node is never gathered.
    """
    edges = (links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        edges = _saved(edges.mapInArrow(_contracted_rows, _EDGE), "star")
        found = _saved(edges.union(edges.select("v", "v")).groupBy(F.col("u").alias("node"))
                       .agg(F.min("v").alias("component"), F.max("v").alias("last")), "components")
        if found.filter("component < last").isEmpty():  # every node has one root, every root is its own
            return found.select("node", "component")
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .union(low.select("u", F.col("m").alias("v"))).distinct())


class _Reps:
    """Representatives with what pair checks need."""

    def __init__(self, docs: DataFrame, sketches: DataFrame, reps: DataFrame):
        self.sketch = _saved(sketches.join(reps, ["set_a", "set_b", "n_shingles"])
                             .filter("doc_id = rep").dropDuplicates(["rep"])
                             .select("rep", "n_shingles", "registers", "bands"), "reps")
        keyed = self.sketch.select("rep", F.explode("bands").alias("key"))
        shared = keyed.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("hi")).filter("least < hi")
        self.keyed = _saved(keyed.join(shared.select("key", "least"), "key"), "buckets")
        wanted = self.keyed.select(F.col("rep").alias("doc_id")).distinct()
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.sets = _saved(texts.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])
                           .mapInArrow(_set_rows, "doc_id long, members binary"), "sets")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the threshold."""
        s = self.sketch
        pairs = (pairs.join(s.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("reg_a")), "a")
                 .join(s.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("reg_b")), "b")
                 .mapInArrow(_likely_rows, _PAIR))
        return _saved(pairs.join(self.sets.select(F.col("doc_id").alias("a"), F.col("members").alias("p")), "a")
                      .join(self.sets.select(F.col("doc_id").alias("b"), F.col("members").alias("q")), "b")
                      .select("a", "b", "p", "q").mapInArrow(_linked_rows, _PAIR), "linked")

    def labelled(self, found: DataFrame) -> DataFrame:
        """Rows (key, rep, label) of all buckets."""
        return (self.keyed.join(found, F.col("rep") == F.col("node"), "left")
                .select("key", "rep", F.coalesce("component", "rep").alias("label")))

    def from_centres(self, found: DataFrame | None, turn: int) -> DataFrame:
        """Pairs (a, b) of each bucket's centre and its members of other components; the centre is the
        smallest member, in later turns one at random, other in each bucket."""
        if found is None:
            return self.keyed.filter("least <> rep").select(F.col("least").alias("a"), F.col("rep").alias("b"))
        rows = self.labelled(found)
        centre = (rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                          F.min(F.struct(F.xxhash64("rep", "key", F.lit(turn)).alias("rank"), "rep", "label")).alias("at"))
                  .filter("lo < hi").select("key", F.col("at.rep").alias("x"), F.col("at.label").alias("x_label")))
        return rows.join(centre, "key").filter("label <> x_label").select(*_ordered(F.col("x"), F.col("rep")))

    def undecided(self, found: DataFrame) -> DataFrame:
        """(rep, label) of the members of buckets that still hold more than one component."""
        rows = self.labelled(found)
        mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        return rows.join(mixed.select("key"), "key").select("rep", "label").distinct()

    def sharing_rare_shingles(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of texts (rep, label) of different labels that could be linked.

        Two linked sets of n and m shingles share at least ``o = need(n, m)`` of them.  In
        one common order, rarest shingle first, the first one that they share then has
        at least o - 1 others behind it in either set.  So only pairs that share a
        shingle so early are linked, whatever their bucket; copies with many edits
        of their own share none.  Nothing is lost by it.
        """
        tokens = _saved(self.sets.join(rows, F.col("doc_id") == F.col("rep")).select("rep", "label", "members")
                        .mapInArrow(_shingle_rows, "rep long, label long, n long, token long"), "tokens")
        counts = tokens.groupBy("token").agg(F.count("*").alias("df"))
        early = (tokens.join(counts, "token").groupBy("rep", "label", "n")
                 .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"))
                 .select("rep", "label", "n", F.posexplode(F.slice(
                     "order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1).cast("int"))).alias("pos", "at"))
                 .filter("at.df > 1").select("rep", "label", "n", F.col("at.token").alias("token"), "pos"))
        early = _saved(early, "early")
        mixed = early.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        early = early.join(mixed.select("token"), "token")
        other = early.select("token", *[F.col(c).alias(f"{c}_2") for c in ("rep", "label", "n", "pos")])
        need = F.ceil((F.col("n") + F.col("n_2")) * NUM / (NUM + DEN))
        return (early.join(other, "token").filter("label < label_2")
                .filter((F.col("n") - F.col("pos") >= need) & (F.col("n_2") - F.col("pos_2") >= need))
                .select(*_ordered(F.col("rep"), F.col("rep_2"))))


def _shingle_rows(batches):
    schema = pa.schema([("rep", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("token", pa.int64())])
    for batch in batches:
        for rep, label, members in zip(*(c.to_pylist() for c in batch.columns)):
            h = np.frombuffer(members, np.int64)
            yield W.table(schema, rep=np.full(len(h), rep), label=np.full(len(h), label),
                          n=np.full(len(h), len(h)), token=h)


def _ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def link_components(reps: _Reps) -> DataFrame:
    """(node, component) of all representatives with a link."""
    found, done = None, None
    for turn in range(CENTRE_ROUNDS + 1):
        pairs = (reps.from_centres(found, turn) if turn < CENTRE_ROUNDS else reps.sharing_rare_shingles(reps.undecided(found))).distinct()
        pairs = _saved(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            if turn:
                continue
            break
        done = pairs if done is None else done.union(pairs)
        links = reps.linked(pairs)
        if found is not None:  # what is known, and the new links
            links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)
        found = components(links)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketches = _saved(texts.mapInArrow(_sketch_rows, _SKETCH_DDL), "sketches")
    members = sketches.filter("n_shingles > 0 and doc_id is not null")
    reps = _saved(members.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    found = link_components(_Reps(docs, members, reps))
    rows = sketches.select("doc_id", "n_shingles", "set_a", "set_b").join(reps, ["set_a", "set_b", "n_shingles"], "left")
    rows = rows.withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")))
    if found is not None:
        rows = rows.join(found, F.col("rep") == F.col("node"), "left")
        rows = rows.withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
    else:
        rows = rows.withColumn("component_id", F.coalesce("rep", "doc_id"))
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return rows.select("doc_id", "n_shingles", "component_id",
                       F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component; one row if
    rows repeat a doc_id.  Rows without a doc_id belong to no component and stay."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.filter("doc_id is not null").join(kept, F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi")
    return rows.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null"))
