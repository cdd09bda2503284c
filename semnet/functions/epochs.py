"""Shuffled order without a shuffle of the rows.

A keyed permutation of 0 .. n-1 gives each row number its place in an epoch.
It is a Feistel network on two digits, whose rounds add a keyed hash of one
digit to the other; numbers that fall outside n are sent on until they fall
inside.  Every place is computed from the row's number alone, so the order is
the same on any partitioning, any slice of an epoch can be asked for by itself,
and ``row_at`` says which row stands at a place.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Times that a number may be sent on; it falls inside sooner, but for a chance below 10**-30.
WALKS = 64
# fixed values: a linear congruence modulo 2**31
FACTOR, STEP, MODULUS = 1103515245, 12345, 1 << 31


def keys(seed: int, epoch: int = 0) -> list[int]:
    """A key below 2**31 for each round."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{epoch}:{k}".encode()).digest()[:4], "big") % MODULUS for k in range(ROUNDS)]


def digits(n: int) -> tuple[int, int]:
    """Sizes of the two digits, which have n numbers at least."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _noise(x: Column, key: Column) -> Column:
    """A number below 2**22 that depends on x and the key."""
    y = (x % MODULUS * FACTOR + key) % MODULUS
    y = ((y + F.floor(y / 65536)) * FACTOR + STEP) % MODULUS
    return F.floor(y / 512)


def _once(x: Column, n: int, key: list[int], back: bool) -> Column:
    a, b = digits(n)
    pair = lambda l, r: F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))
    rounds = [F.struct(F.lit(k).cast("long").alias("key"), F.lit(i % 2 == 0).alias("left")) for i, k in enumerate(key)]
    sign = -1 if back else 1

    def turn(d: Column, k: Column) -> Column:
        noise = sign * _noise(F.when(k["left"], d["r"]).otherwise(d["l"]), k["key"])
        return F.when(k["left"], pair(F.pmod(d["l"] + noise, F.lit(a)), d["r"])).otherwise(pair(d["l"], F.pmod(d["r"] + noise, F.lit(b))))

    return F.aggregate(F.array(*(rounds[::-1] if back else rounds)), pair(F.floor(x / b), x % b), turn, lambda d: d["l"] * b + d["r"])


def _walked(x: Column, n: int, seed: int, epoch: int, back: bool) -> Column:
    key = keys(seed, epoch)
    whole = F.lit(n).cast("long")
    start = _once(x.cast("long"), n, key, back)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, lambda y, _: F.when(y < whole, y).otherwise(_once(y, n, key, back)))


def place(row: Column, n: int, seed: int, epoch: int = 0) -> Column:
    """The place of a row number in an epoch of n rows."""
    return _walked(row, n, seed, epoch, False)


def row_at(at: Column, n: int, seed: int, epoch: int = 0) -> Column:
    """The number of the row that stands at a place."""
    return _walked(at, n, seed, epoch, True)


def shuffled(rows: DataFrame, n: int, seed: int, epoch: int = 0, index: str = "index", validation: int = 0) -> DataFrame:
    """Add ``place`` and ``validation``, which the first so many places of epoch 0 have in every epoch.

    ``index`` numbers the rows from 0 to n - 1.
    """
    first = place(F.col(index), n, seed)
    return rows.withColumn("place", place(F.col(index), n, seed, epoch) if epoch else first).withColumn("validation", first < validation)


def epoch_slice(rows: DataFrame, n: int, seed: int, start: int, stop: int, epoch: int = 0, index: str = "index") -> DataFrame:
    """The rows at places start .. stop - 1, with their places. Their numbers are made first, so a source that is sorted or split by number reads no others."""
    spark = rows.sparkSession
    at = spark.range(max(0, start), min(stop, n)).select(row_at(F.col("id"), n, seed, epoch).alias("_at"), F.col("id").alias("place"))
    return rows.join(at, F.col(index) == F.col("_at")).drop("_at")
