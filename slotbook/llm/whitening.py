"""Whitening of embeddings by an exact bit-sliced scatter matrix.

Every entry c becomes the integer x = floor(1024 * c) + 100000.

1. One pass gives number, sums, least and greatest x of every dimension.
2. A second pass gives all cross-products exactly: x less its dimension's least is cut into bit
   planes, a plane of ``ROWS`` rows is packed into 64-bit words, and the products of two dimensions
   are the popcounts of the ANDs of their planes, weighted by powers of two.  Tasks sum
   their own rows; Spark adds the tasks' sums as decimals.
3. The scatter is centred as integers, n * sum(xy) - sum(x) * sum(y), and divided once by n**2; the driver
   takes ``eigh`` of that covariance (dimensions squared, whatever the number of vectors).
4. A third pass measures the covariance of the whitened vectors, a last one writes them.

Defined results: a vector that is null, or holds an entry that is null, not finite or of an
|x| of 2**48 or more, is left out, and so is one of another length than the commonest (the longer on ties); without a
vector, or with empty ones, the result is empty; a component whose eigenvalue is 0 to working precision
(below ``FLAT`` of the largest) has null whitened values and does not count for
identity_error, which is null without other components; explained is null without any variance; a
deviation beyond 64 bits is null; repeated rows and vec_ids each count and get their rows; fewer dimensions than
``COMPONENTS`` give as many components; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
ROWS = 1 << 14           # vectors whose bit planes are held at once
ENTRIES = 1 << 21        # entries held at once, at most (or one vector)
FLAT = 1e-13
_LARGE = 2.0**48


def _numbered(batches, dims: int | None = None):
    """(vec_ids, x) of the vectors that count, by pieces of equally long ones (of ``dims`` entries, if given)."""
    for batch in batches:
        vectors = batch.column(1)
        size = vectors.value_lengths().fill_null(-1).to_numpy()
        for d in np.unique(size[size > 0]) if dims is None else [dims]:
            rows = np.flatnonzero(size == d)
            step = int(max(1, min(ROWS, ENTRIES // d)))
            for i in range(0, len(rows), step):
                some = batch.take(pa.array(rows[i:i + step]))
                c = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                x = np.floor(SCALE * c) + SHIFT
                good = (np.abs(x) < _LARGE).all(axis=1)  # nulls are not a number here
                yield some.column(0).filter(pa.array(good)), x[good].astype(np.int64)


def _vectors(table: DataFrame) -> DataFrame:
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


# --- passes -----------------------------------------------------------------------------------
_SUMS = pa.schema([("dims", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
                   ("total", pa.decimal128(38, 0))])


def _sums(batches):
    kept: dict[int, list] = {}
    for _, x in _numbered(batches):
        if not len(x):
            continue
        low, high, total = x.min(axis=0), x.max(axis=0), x.sum(axis=0).astype(object)
        have = kept.setdefault(x.shape[1], [0, low, high, 0])
        have[:] = have[0] + len(x), np.minimum(have[1], low), np.maximum(have[2], high), have[3] + total
    for d, (n, low, high, total) in kept.items():
        yield W.table(_SUMS, dims=np.full(d, d), dim=np.arange(d), n=np.full(d, n), low=low, high=high, total=list(map(Decimal, total)))


def _planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of every dimension, packed over the rows: (dims, bits, words)."""
    n, d = y.shape
    packed = np.zeros((d, bits, -(-n // 64) * 8), np.uint8)
    flipped = np.ascontiguousarray(y.T)
    for k in range(bits):
        packed[:, k, :-(-n // 8)] = np.packbits((flipped >> k & 1).astype(np.uint8), axis=1)
    return packed.view(np.uint64)


def products(y: np.ndarray, bits: int) -> np.ndarray:
    """Sums over the rows of y[a] * y[b], for b >= a, as Python integers; y is 0 or more and below 2**bits."""
    d = y.shape[1]
    planes = _planes(y, bits)
    kind = np.int64 if 2 * bits + len(y).bit_length() < 63 else object
    weight = np.array([1 << k for k in range(bits)], dtype=kind)
    out = np.zeros((d, d), object)
    for a in range(d):
        row = np.zeros(d - a, kind)
        for k in range(bits):
            both = np.bitwise_count(planes[a, k] & planes[a:]).sum(axis=2, dtype=np.int64)
            row = row + weight[k] * (both.astype(kind) @ weight)
        out[a, a:] = row
    return out


_PRODUCTS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("total", pa.decimal128(38, 0))])


class Fit:
    """Number and sums of the vectors, their exact covariance, and its first components."""

    def __init__(self, table: DataFrame):
        sums = (table.mapInArrow(_sums, "dims int, dim int, n long, low long, high long, total decimal(38,0)").groupBy("dims", "dim")
                .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total")))
        commonest = sums.filter("dim = 0").orderBy(F.desc("n"), F.desc("dims")).select("dims", "n").first()
        self.dims, self.n = commonest or (0, 0)
        if not self.dims:
            return
        rows = sums.filter(F.col("dims") == self.dims).orderBy("dim").collect()  # a row a dimension
        self.low = np.array([r.low for r in rows], np.int64)
        self.bits = max(1, max(int(r.high - r.low).bit_length() for r in rows))
        self.sums = [int(r.total) - self.n * int(r.low) for r in rows]  # of x less its least
        low, bits, dims = self.low, self.bits, self.dims

        def scatter(batches):
            total = np.zeros((dims, dims), object)
            for _, x in _numbered(batches, dims):
                total += products(x - low, bits)
            a, b = np.triu_indices(dims)
            yield W.table(_PRODUCTS, a=a, b=b, total=[Decimal(int(v)) for v in total[a, b]])

        cross = table.mapInArrow(scatter, "a int, b int, total decimal(38,0)").groupBy("a", "b").agg(F.sum("total").alias("total"))
        self.covariance = np.zeros((dims, dims))
        for a, b, total in cross.collect():  # dimensions squared
            centred = self.n * int(total) - self.sums[a] * self.sums[b]
            self.covariance[a, b] = self.covariance[b, a] = centred / (self.n * self.n)
        values, vectors = np.linalg.eigh(self.covariance)
        k = min(COMPONENTS, dims)
        self.values, self.axes = values[::-1][:k], vectors[:, ::-1][:, :k]
        trace = float(np.trace(self.covariance))
        self.explained = [float(max(e, 0.0) / trace) if trace > 0 else None for e in self.values]
        self.live = self.values > max(FLAT * float(self.values[0]), 0.0)

    def offsets(self, x):
        """n * x - sum of x, exact."""
        y = x - self.low
        if self.n * (1 << self.bits) < 1 << 62:
            return self.n * y - np.array(self.sums, np.int64)
        return self.n * y.astype(object) - np.array(self.sums, object)

    def whitened(self, z):
        centred = (z / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return centred @ self.axes / np.sqrt(np.where(self.live, self.values, np.nan))

    def deviations(self, z):
        """Sums of squares, None where they pass 64 bits."""
        if self.n * self.n * self.dims << 2 * self.bits < 1 << 62:
            return pa.array((z * z).sum(axis=1), pa.int64())
        exact = (z.astype(object) ** 2).sum(axis=1)
        return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())


_MOMENTS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("total", pa.float64())])


def identity_error(table: DataFrame, fit) -> float | None:
    """Largest entry of the covariance of the whitened vectors minus the identity, as measured.

    Row -1 of the sums holds the sums of the values themselves."""

    def moments(batches):
        own = fit.value
        k = len(own.values)
        total = np.zeros((k + 1, k))
        for _, x in _numbered(batches, own.dims):
            w = own.whitened(own.offsets(x))
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        a, b = np.indices(total.shape).reshape(2, -1)
        yield W.table(_MOMENTS, a=np.where(a == k, -1, a), b=b, total=total.ravel())

    own = fit.value
    sums = {(a, b): t for a, b, t in table.mapInArrow(moments, "a int, b int, total double").groupBy("a", "b").agg(F.sum("total")).collect()}
    live = np.flatnonzero(own.live)
    errors = [abs(sums[a, b] / own.n - sums[-1, a] / own.n * (sums[-1, b] / own.n) - (a == b)) for a in live for b in live]
    return float(max(errors)) if errors else None


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                  ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_OUT_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame) -> DataFrame:
    """One row a vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    table = _vectors(embeddings)
    fitted = Fit(table)
    if not fitted.dims:
        return spark.createDataFrame([], _OUT_DDL)
    fit = spark.sparkContext.broadcast(fitted)
    error = identity_error(table, fit)

    def run(batches):
        own = fit.value
        k = len(own.values)
        for ids, x in _numbered(batches, own.dims):
            z = own.offsets(x)
            w = own.whitened(z).ravel()
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                ids.take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, own.n), pa.int64()),
                own.deviations(z).take(each), pa.array(w, mask=np.isnan(w)), pa.array(own.explained * m, pa.float64()),
                pa.array([error] * (m * k), pa.float64())], schema=_OUT)

    return table.mapInArrow(run, _OUT_DDL)
