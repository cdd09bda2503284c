"""Whitening of embeddings by a two-pass covariance.

Entries become integers, ``floor(64 * c) + 1000000``.  The *fit list* has each
distinct integer vector once.  The first pass adds them up in exact integers,
which gives the mean; the second adds outer products of the centred vectors, a
matrix product for each Arrow batch, merged over the tasks by treeAggregate.
Centring before multiplying loses no digits to the offset.  The d x d
covariance goes to LAPACK's symmetric solver on the driver; the projection is
broadcast.  Both have d * d numbers, whatever the number of rows.

Defined results: rows whose vector is null, or has a null or non-finite entry
or one of 2**40 or more (which fixed point can't hold), are dropped, and so are
empty vectors, which have no components.  Vectors of different lengths are
whitened apart, each length by its own fit list.  Rows of one vec_id, or none,
are each reported; equal vectors count once in the fit.  Components of no
variance (below d * 2.2e-16 of the largest) have whitened 0.0 and take no part
in identity_error; explained is 0.0 if there is no variance at all.  deviation
is a long while every value fits one, else decimal(38, 0); it is exact either
way.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
LARGEST = float(1 << 40)


def fixed_point(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x): the integer vectors of the rows that have one."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))  # an infinity isn't below it either
    x = F.transform(v, lambda c: F.floor(SCALE * c) + OFFSET)
    return rows.where(v.isNotNull() & (F.size(v) > 0) & sound).select(F.col(key), x.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of each batch and length of vectors: the batch, the rows with that length, their entries as a matrix."""
    for b in batches:
        x = b.column("x")
        size = x.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(size):
            mine = np.flatnonzero(size == d)
            yield b, mine, x.take(pa.array(mine)).flatten().to_numpy().reshape(-1, d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, x in _matrices(batches):
        yield pa.RecordBatch.from_pydict({"d": [x.shape[1]], "n": [len(x)], "s": [x.sum(axis=0)]}, pa.schema([("d", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))


def _products(make):
    """A task's sum of outer products of what ``make`` turns its matrices into, and the largest entry of the centred integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for _, _, x in _matrices(batches):
            y, most = make(x)
            g = y.T @ y
            if (h := held.get(x.shape[1])) is None:
                held[x.shape[1]] = [g, most]
            else:
                h[0] += g
                h[1] = max(h[1], most)
        for d, (g, most) in held.items():
            yield pa.RecordBatch.from_pydict({"d": [d], "g": [g.tobytes()], "most": [most]}, pa.schema([("d", pa.int64()), ("g", pa.binary()), ("most", pa.int64())]))

    return run


def _tree(df: DataFrame, unpack, plus) -> dict:
    """Merge rows by ``d`` over the executors; only the merged values, one for each length, reach the driver."""

    def put(held: dict, row) -> dict:
        v = unpack(row)
        held[row["d"]] = plus(held[row["d"]], v) if row["d"] in held else v
        return held

    def both(a: dict, b: dict) -> dict:
        for d, v in b.items():
            a[d] = plus(a[d], v) if d in a else v
        return a

    return df.rdd.treeAggregate({}, put, both, depth=3)


def _added(a, b):
    return tuple(x + y for x, y in zip(a, b))


def _gram(a, b):
    return a[0] + b[0], max(a[1], b[1])


def centred(x: np.ndarray, low: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S / n in double precision, where S = n * low + n * rest: the integer part goes first, exactly."""
    return (x - low).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, low: np.ndarray, over: np.ndarray, small: bool) -> list | np.ndarray:
    """Sums of (n * x - S)**2 in exact integers, where S = n * low + over."""
    if small:
        y = n * (x - low) - over
        return np.einsum("ij,ij->i", y, y)
    y = n * (x - low).astype(object) - over.astype(object)
    return [Decimal(int(v)) for v in (y * y).sum(axis=1)]


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "whiten")
    mine = fixed_point(rows, vector, key)
    fit = scratch.keep(mine.select("x").distinct())  # copies meet in the tasks that read them, before the shuffle

    # first pass: exact sums. Python's integers don't overflow.
    sums = _tree(fit.mapInArrow(_sums, "d long, n long, s array<long>"), lambda r: (int(r["n"]), np.array(r["s"], dtype=object)), _added)
    means = {}
    for d, (n, s) in sums.items():
        low = np.array([int(v) // n for v in s], np.int64)
        over = np.array([int(v) - n * int(m) for v, m in zip(s, low)], np.int64)
        means[d] = (n, low, over, over / n)
    held = spark.sparkContext.broadcast(means)  # d numbers for each length

    def product(x):
        _, low, _, rest = held.value[x.shape[1]]
        return centred(x, low, rest), int(np.abs(x - low).max())

    grams = _tree(fit.mapInArrow(_products(product), "d long, g binary, most long"), lambda r: (np.frombuffer(r["g"]).reshape(r["d"], r["d"]), r["most"]), _gram)
    found = {}
    for d, (g, most) in grams.items():
        n = means[d][0]
        cov = g / n
        value, vec = np.linalg.eigh((cov + cov.T) / 2)
        k = min(components, d)
        value, vec = value[::-1][:k], vec[:, ::-1][:, :k]
        vec = vec * np.where(vec[np.abs(vec).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
        real = value > max(d * np.finfo(float).eps * value[0], 0.0)
        trace = float(np.trace(cov))
        found[d] = {
            "real": real, "project": np.where(real, vec / np.sqrt(np.where(real, value, 1.0)), 0.0),
            "explained": np.maximum(value, 0.0) / trace if trace > 0 else np.zeros(k), "small": d * (n * (most + 1)) ** 2 < 1 << 62,
        }
    made = spark.sparkContext.broadcast(found)

    def again(x):
        _, low, _, rest = held.value[x.shape[1]]
        return centred(x, low, rest) @ made.value[x.shape[1]]["project"], 0

    check = _tree(fit.mapInArrow(_products(again), "d long, g binary, most long"), lambda r: (np.frombuffer(r["g"]).reshape(min(components, r["d"]), -1), 0), _gram)
    for d, (g, _) in check.items():
        f = found[d]
        f["error"] = float(np.abs(g / means[d][0] - np.eye(len(g)))[np.ix_(f["real"], f["real"])].max(initial=0.0))
    small = all(f["small"] for f in found.values())
    last = spark.sparkContext.broadcast(found)

    kind = mine.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation {'long' if small else 'decimal(38,0)'}, whitened double, explained double, identity_error double"

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at, x in _matrices(batches):
            (n, low, over, rest), f = held.value[x.shape[1]], last.value[x.shape[1]]
            w = centred(x, low, rest) @ f["project"]
            k = w.shape[1]
            each = pa.array(np.repeat(np.arange(len(x)), k))
            dev = deviations(x, n, low, over, small)
            cols = [
                b.column(key).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                (pa.array(dev) if small else pa.array(dev, pa.decimal128(38, 0))).take(each), pa.array(w.reshape(-1)), pa.array(np.tile(f["explained"], len(x))), pa.array(np.full(len(x) * k, f["error"])),
            ]
            yield pa.RecordBatch.from_arrays(cols, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return mine.mapInArrow(report, schema)
