"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct 5-word shingles.  A sketch has ``M``
registers: register i is the truncated logarithm (base ``BASE``) of the least
of the set's exponentially distributed hashes.  Each element has one point in
each of M exponentially spaced intervals, in a register of its own that a
permutation of the element names; intervals are filled in ascending order until
no later one can lower a register, so a long text costs a few points a shingle
and not M.  Sketches of unions are element-wise maxima, and two registers are
equal with a probability close to the Jaccard similarity.  Registers are
banded; equal bands make candidates.  The similarity of a candidate pair is
estimated by maximum likelihood from the registers that are larger, smaller and
equal and from the exact set sizes, and pairs that can't reach the threshold
are dropped; the rest is verified on the full sets.

Work is arranged so that a group of copies costs as much as its members:

1. documents with equal sets are one *class*, named by a digest of the set, so
   that repeated or null ids never stand for two classes;
2. in each bucket of the first ``STAR`` bands, every class is paired with the
   bucket's least class only (a star), and verified links give components;
3. of all bands, only the buckets that hold several components go on: small
   ones by all pairs between components, large ones by another star;
4. buckets that are large and still hold several components are finished by a
   prefix join: sets that reach the threshold share one of the rarest shingles
   of each (exact for any order of the shingles).  No cap drops a pair.

Components are found by hooking to the least neighbour and pointer jumping,
in DataFrames, on the graph of what is still to be joined.

Defined results: a null or empty text, or one of white space, has an empty set
and links with nothing (n_shingles 0, its own component); a text of fewer than
five words has one shingle, its whole sequence; rows of one id with different
texts are judged by their texts, each on its own; a row is kept if its id is
the component's least, so repeated rows of that id are all kept; a null id
never is a component's least if another id is there, and a component of null
ids alone has a null component_id.  An empty table gives no rows; texts of any
length are read whole.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import MOST_ROWS, Scratch, dealt_join, lookup_side, salted_join

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Registers; a prime, so that a step and an offset name a permutation of them.
M = 127
#: Registers of a band: 25 bands at 0.85, of which a pair at the threshold shares none with probability (1 - 0.85**5)**25 = 4e-7,
#: and 31 at 0.80, where it is (1 - 0.8**4)**31 = 1e-7.
ROWS, ROWS_80 = 5, 4
#: Bands of the first star.
STAR = 8
#: SetSketch parameters: base of the register scale, rate, and largest register.
BASE, RATE, TOP = 1.001, 20.0, 65534
#: An estimate this many standard errors below the threshold ends a candidate.
SIGMAS = 6.0
#: Groups of up to this many classes are finished by pairs; larger ones block by block.
SMALL_GROUP, BLOCK = 24, 256
#: Classes of more documents than this are joined on their own.
HOT = 4000
#: Sketches that may be broadcast (about 350 bytes each), and shingles whose order is broadcast as an array (8 bytes each).
MOST_SKETCHES, MOST_COMMON = 40_000, 500_000
#: Texts, sketches and sets reach Python in batches of about this many bytes.
BATCH_BYTES = 8 << 20

MASK = (1 << 64) - 1


POLY = np.uint64(0x9E3779B97F4A7C15)
#: STEP[a, j]: the register of an element's point j, before its offset.
STEPS = (np.arange(1, M, dtype=np.int64)[:, None] * np.arange(M) % M).astype(np.int16)
FRACTION = 48


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _named(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each string, mixed eight bytes at a time, and whether it has any."""
    names = names.cast(pa.binary())
    raw = np.frombuffer(names.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
    start, size = ends[:-1], np.diff(ends)
    out = mix(size.astype(np.uint64) + POLY)
    lanes = -(-size // 8)
    for k in np.unique(lanes[(lanes > 0) & (lanes <= 16)]):
        mine = np.flatnonzero(lanes == k)
        at = start[mine, None] + np.arange(8 * k)
        byte = np.where(at < ends[mine + 1][:, None], raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint8)
        for lane in byte.view(np.uint64).T:
            out[mine] = mix(out[mine] ^ lane) + POLY
    for i in np.flatnonzero(lanes > 16):
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : ends[i + 1]].tobytes())
    return out, size > 0


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, in order, and the number of words of each text.

    Arrow lower-cases A-Z only and cuts at the contract's white space; a word is
    hashed once however often a batch has it.
    """
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = cut.flatten().dictionary_encode()
    of, full = _named(flat.dictionary)
    codes = flat.indices.to_numpy(zero_copy_only=False)
    real = full[codes]
    ends = np.concatenate([[0], np.cumsum(real)])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
    return of[codes[real]], np.diff(ends)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of the 5-word shingles of each text, one text after the other, and the number of each."""
    h, n = word_hashes(texts)
    first = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(h)) - first[doc]
    starts = np.flatnonzero(at <= np.maximum(n[doc] - WORDS, 0))  # of a short text its first word
    width = np.minimum(n[doc[starts]], WORDS)
    out = width.astype(np.uint64)
    for k in range(WORDS):
        longer = slice(None) if (width > k).all() else width > k
        out[longer] = out[longer] * POLY + h[starts[longer] + k]
    out, doc = mix(out), doc[starts]
    order = np.argsort(out)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64), kind="stable")]
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.bincount(doc[new], minlength=len(n))


def registers(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """M truncated, exponentially spaced minima of each set; an empty set has zeros. ``s`` has the sets one after the other, ``n`` their sizes."""
    low = np.full((len(n), M), np.uint64(MASK))
    doc = np.repeat(np.arange(len(n)), n)
    where = mix(s ^ POLY)
    step = (((where & np.uint64(0xFFFFFFFF)) * np.uint64(M - 1)) >> np.uint64(32)).astype(np.int64)
    offset = (((where >> np.uint64(32)) * np.uint64(M)) >> np.uint64(32)).astype(np.int64)
    for j in range(M):
        to = STEPS[step, j] + offset
        to -= M * (to >= M)
        point = mix(s + np.uint64(j + 1) * POLY) >> np.uint64(64 - FRACTION) | np.uint64(j << FRACTION)
        np.minimum.at(low.reshape(-1), doc * M + to, point)
        # no later interval can lower a register of a set whose registers are all below it
        open_ = low.max(axis=1) >= np.uint64((j + 1) << FRACTION) if j + 1 < M else np.zeros(len(n), bool)
        more = open_[doc]
        if not more.any():
            break
        if not more.all():
            s, doc, step, offset = s[more], doc[more], step[more], offset[more]
    u = (low.astype(np.float64) + 0.5) / 2.0**FRACTION / M
    h = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    out = np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, TOP).astype(np.uint16)
    out[n == 0] = 0
    return out


def portions(b: pa.RecordBatch, text: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, one row at least."""
    size = np.cumsum(pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most)))
        yield b.slice(at, end - at)
        at = end


SKETCH = "doc_id long, text_hash long, n_shingles long, set_id binary, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in portions(whole, "text"):
            with np.errstate(over="ignore"):
                s, n = shingles(b.column("text"))
                r = registers(s, n)
            ends = np.cumsum(n)
            raw = s.tobytes()
            ids = [xxhash.xxh3_128_digest(raw[8 * (e - k) : 8 * e]) for e, k in zip(ends.tolist(), n.tolist())]
            cols = [b.column("doc_id"), b.column("text_hash"), pa.array(n.astype(np.int64)), pa.array(ids, pa.binary()), pa.array([x.tobytes() for x in r], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n_shingles", "set_id", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in portions(whole, "text"):
            with np.errstate(over="ignore"):
                s, n = shingles(b.column("text"))
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("rep"), made], ["rep", "shingles"])


def loglik(j: np.ndarray, u: np.ndarray, more, less, same) -> np.ndarray:
    """Log-likelihood of similarity j given the larger, smaller and equal registers; u, v: shares of the set sizes."""
    v = 1 - u
    c = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * c) / math.log(BASE)

    a, b = p(u - v * j), p(v - u * j)
    return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of rows of registers, by ternary search over [0, min/max]."""
    more, less = (x > y).sum(-1), (x < y).sum(-1)
    same = x.shape[-1] - more - less
    u = nx / (nx + ny)
    lo, hi = np.zeros(len(u)), np.minimum(nx, ny) / np.maximum(nx, ny)
    for _ in range(30):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = loglik(a, u, more, less, same) < loglik(b, u, more, less, same)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def reaches(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """Whether the maximum-likelihood similarity is at least ``least``: the likelihood is concave and still rises there."""
    more, less = (x > y).sum(-1), (x < y).sum(-1)
    same = x.shape[-1] - more - less
    u = nx / (nx + ny)
    return loglik(np.full(len(u), least + 1e-4), u, more, less, same) >= loglik(np.full(len(u), least - 1e-4), u, more, less, same)


def floor_of(percent: int) -> float:
    """Least estimate that a pair at the threshold can have."""
    t = percent / 100
    return t - SIGMAS * math.sqrt(t * (1 - t) / M)


def _possible(percent: int):
    least = floor_of(percent)

    def run(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(sa):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(sa), np.uint16).reshape(-1, M)
        y = np.frombuffer(b"".join(sb), np.uint16).reshape(-1, M)
        return pd.Series(reaches(x, y, na.to_numpy(float), nb.to_numpy(float), least))

    return F.pandas_udf(run, "boolean")


def size_ok(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link: size, then estimate, then the full sets. ``pairs`` is a kept table."""
    if not pairs.n_rows:
        return pairs
    mine = scratch.keep(classes.join(_few(_ends(pairs), 2 * pairs.n_rows), "rep", "left_semi").select("rep", "one", "n_shingles", "sketch"))
    side = lambda s: mine.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    if mine.n_rows <= MOST_SKETCHES:
        both = pairs.join(F.broadcast(side("b")), "b").join(F.broadcast(side("a")), "a")
    else:  # a may be the least class of many buckets
        both = dealt_join(pairs.join(side("b"), "b"), side("a"), ["a"], F.col("b"))
    both = both.where(size_ok(F.col("na"), F.col("nb"), percent))
    both = scratch.keep(both.where(_possible(percent)("sa", "sb", "na", "nb")).select("a", "b", "na", "nb"))
    if not both.n_rows:
        none = both.select("a", "b")
        none.n_rows = 0
        return none
    sets = sets_of(_ends(both), 2 * both.n_rows, mine, texts, scratch)
    xa, xb = (sets.select(F.col("rep").alias(s), F.col("shingles").alias(f"x{s}")) for s in "ab")
    full = dealt_join(both.join(xb, "b"), xa, ["a"], F.col("b"))
    inter = F.size(F.array_intersect("xa", "xb"))
    return scratch.keep(full.where(100 * inter >= percent * (F.col("na") + F.col("nb") - inter)).select("a", "b"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


def _few(df: DataFrame, most: int) -> DataFrame:
    """Broadcast a table that is known to have at most ``most`` rows, if these are few."""
    return F.broadcast(df) if most <= MOST_ROWS else df


def sets_of(reps: DataFrame, most: int, classes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, shingles): full sets of the classes in ``reps`` (at most ``most``), made again from the text of one document of each."""
    near = classes.join(_few(reps, most), "rep", "left_semi").select("rep", F.col("one.doc_id").alias("_d"), F.col("one.text_hash").alias("_h"))
    same = texts["doc_id"].eqNullSafe(near["_d"]) & (texts["text_hash"] == near["_h"])
    mine = texts.join(_few(near, most), same).groupBy("rep").agg(F.first("text").alias("text"))  # repeated rows count once
    return scratch.keep(mine.select("rep", "text").mapInArrow(_sets, "rep binary, shingles array<long>"))


def relabel(df: DataFrame, col: str, to: DataFrame, by: str) -> DataFrame:
    """``col`` mapped through the kept table ``to`` (rep, comp); what isn't there stays. ``moved`` says what was."""
    up = to.select(F.col("rep").alias(col), F.col("comp").alias("_to"))
    out = dealt_join(df, up, [col], F.col(by), "left", rows=to.n_rows)
    return out.withColumn("moved", F.col("_to").isNotNull()).withColumn(col, F.coalesce("_to", col)).drop("_to")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, comp): the least node reachable, for every node of ``links`` (a, b) that isn't the least itself.

    Each round hooks every node to its least neighbour, jumps pointers to the
    roots and goes on with the links between roots; linked trees at least halve.
    """
    whole = None
    e = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    while e.n_rows or whole is None:
        parent = scratch.keep(e.groupBy(F.col("x").alias("rep")).agg(F.min("y").alias("comp")))
        moved = parent.n_rows
        while moved:  # the parent may itself have a parent
            parent = scratch.keep(relabel(parent, "comp", parent, "rep").select("rep", "comp", "moved"), "moved")
            moved = parent.n_flagged
        if e.n_rows:
            ends = relabel(relabel(e, "x", parent, "y"), "y", parent, "x")
            e = scratch.keep(ends.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
        whole = parent if whole is None else merged(whole, parent, scratch)
    return whole


def merged(comps: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, comp) of ``comps``, then ``more`` between its components."""
    if not more.n_rows:
        return comps
    return scratch.keep(relabel(comps, "comp", more, "rep").select("rep", "comp").union(more.select("rep", "comp")))


def joined_by(links: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """``comps`` after the links (a, b) between classes."""
    if not links.n_rows:
        return comps
    ends = relabel(relabel(links, "a", comps, "b"), "b", comps, "a")
    return merged(comps, components(ends.select("a", "b"), scratch), scratch)


def common(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices of bounded width."""
    sets = [*xs, *ys]
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times[col] > 1  # what only one set has is in no intersection
    number = np.cumsum(times > 1) - 1
    row, col = row[shared], number[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(xs), len(ys)))
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(col, (at, at + width))
        m = np.zeros((len(sets), width), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        out += m[: len(xs)] @ m[len(xs) :].T
    return out


def _blocks(percent: int):
    least = floor_of(percent)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        """Verified links of one pair of blocks of a group, no more than join its components."""
        b = b.assign(comp=pd.factorize(b["comp"])[0])
        left, right = b[b["side"] == 0], b[b["side"] == 1]
        if not len(right):
            right = left
        if not len(left):
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        x, y = (np.frombuffer(b"".join(p["sketch"]), np.uint16).reshape(-1, M) for p in (left, right))
        nx, ny = left["n"].to_numpy(float), right["n"].to_numpy(float)
        cx, cy, rx, ry = (p[c].to_numpy() for c in ("comp", "rep") for p in (left, right))
        maybe = (cx[:, None] != cy) & (100 * np.minimum(nx[:, None], ny) >= percent * np.maximum(nx[:, None], ny))
        for i in np.flatnonzero(maybe.any(1)):
            ok = np.flatnonzero(maybe[i])
            maybe[i, ok] = reaches(x[i], y[ok], np.full(len(ok), nx[i]), ny[ok], least)
        li, ri = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
        if not len(li):
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        both = common([left["shingles"].iloc[i] for i in li], [right["shingles"].iloc[i] for i in ri])
        link = maybe[np.ix_(li, ri)] & (100 * both >= percent * (nx[li][:, None] + ny[ri] - both))
        out = []
        for i, k in np.argwhere(link):
            i, k = li[i], ri[k]
            if find(cx[i]) != find(cy[k]):
                root[find(cx[i])] = find(cy[k])
                out.append((min(rx[i], ry[k]), max(rx[i], ry[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return run


def _prefixes(percent: int, frequent: Broadcast):
    """The rarest shingles of each set, as many as any set that reaches the threshold must share one of.

    ``frequent`` has frequent shingles, sorted, and the logarithms of their
    frequencies; a set's other shingles come first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        usual, size = frequent.value
        for b in batches:
            reps, comps, found = [], [], [np.empty(0, np.int64)]
            for rep, comp, s in zip(b["rep"], b["comp"], b["shingles"]):
                s = np.asarray(s, np.int64)
                at = np.minimum(np.searchsorted(usual, s), max(0, len(usual) - 1))
                late = np.where(usual[at] == s, size[at], 0) if len(usual) else np.zeros(len(s), np.int8)
                n = len(s) - (percent * len(s) + 99) // 100 + 1
                found.append(s[np.lexsort((s, late))][:n])
                reps += [rep] * len(found[-1])
                comps += [comp] * len(found[-1])
            yield pd.DataFrame({"rep": pd.Series(reps, dtype=object), "comp": pd.Series(comps, dtype=object), "token": np.concatenate(found)})

    return run


def pairs_within(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of different components, of groups ``m`` of bounded size."""
    cross = F.flatten(
        F.transform(
            "m",
            lambda x: F.transform(
                F.filter("m", lambda y: (y["rep"] > x["rep"]) & (y["comp"] != x["comp"])), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b"))
            ),
        )
    )
    return groups.select(F.explode(cross).alias("p")).select("p.a", "p.b").distinct()


def prefix_links(members: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links between components among ``members`` (rep, comp): a join on the rarest shingles.

    A shingle's group is finished by pairs if it is small.  In a larger one its
    most frequent component isn't compared with itself: blocks of the other
    members are compared with blocks of all, inside the executors.
    """
    sets = sets_of(members.select("rep"), members.n_rows, classes, texts, scratch)
    counts = scratch.keep(sets.select(F.explode("shingles").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    # the order of the shingles may be any: by frequency, as far down as fits into a bounded array
    log = F.floor(F.log2("n")).cast("int")
    by_size = counts.groupBy(log.alias("size")).agg(F.count("*").alias("k")).collect()  # at most 63 rows
    floor, held = 64, 0
    for r in sorted(by_size, reverse=True):
        if held + r["k"] > MOST_COMMON:
            break
        floor, held = r["size"], held + r["k"]
    frequent = sorted((r["token"], r["size"]) for r in counts.select("token", log.alias("size")).where(F.col("size") >= floor).collect()) if held else []
    # an executor fetches the arrays once, whatever the number of its tasks
    frequent = scratch.spark.sparkContext.broadcast((np.array([t for t, _ in frequent], np.int64), np.array([k for _, k in frequent], np.int8)))
    mine = members.select("rep", "comp")
    mine = sets.join(F.broadcast(mine) if members.n_rows <= MOST_ROWS else mine, "rep").select("rep", "comp", "shingles")
    rows = scratch.keep(mine.mapInPandas(_prefixes(percent, frequent), "rep binary, comp binary, token long"))
    by_comp = rows.groupBy("token", "comp").agg(F.count("*").alias("n"))
    live = by_comp.groupBy("token").agg(F.count("*").alias("k"), F.sum("n").alias("n_in"), F.max(F.struct("n", "comp")).alias("most")).where("k > 1")
    live = scratch.keep(live.select("token", "n_in", F.col("most.n").alias("n_most"), F.col("most.comp").alias("most")))
    if live.n_rows <= MOST_ROWS:
        rows = rows.join(F.broadcast(live), "token")
    else:
        rows = salted_join(rows, live, ["token"], F.col("rep"))
    groups = rows.where(F.col("n_in") <= SMALL_GROUP).groupBy("token").agg(F.collect_list(F.struct("rep", "comp")).alias("m"))
    found = verify(scratch.keep(pairs_within(groups)), classes, texts, scratch, percent)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    large = rows.where(F.col("n_in") > SMALL_GROUP).withColumn("is_most", F.col("comp") == F.col("most"))
    large = large.withColumn("bo", blocks(F.col("n_in") - F.col("n_most"))).withColumn("bm", blocks(F.col("n_most")))
    large = large.withColumn("blk", F.pmod(F.xxhash64("rep"), F.when(F.col("is_most"), F.col("bm")).otherwise(F.col("bo"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    meet = lambda most, i, j, side: F.struct(F.lit(most).alias("most"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    among = F.transform(upto("bo"), lambda o: meet(False, F.least("blk", o), F.greatest("blk", o), F.col("blk") > o))
    across = F.transform(upto("bm"), lambda o: meet(True, o, F.col("blk"), F.lit(1)))
    of_most = F.transform(upto("bo"), lambda o: meet(True, F.col("blk"), o, F.lit(0)))
    met = large.select("token", "rep", "comp", F.explode(F.when(F.col("is_most"), of_most).otherwise(F.concat(among, across))).alias("m")).select("token", "rep", "comp", "m.*")
    about = classes.select("rep", F.col("n_shingles").alias("n"), "sketch").join(sets, "rep")
    met = met.join(about, "rep")
    more = scratch.keep(met.groupBy("token", "most", "i", "j").applyInPandas(_blocks(percent), "a binary, b binary").distinct())
    return scratch.keep(found.union(more))


def linked(docs: DataFrame, text: str, id_: str, percent: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sketches, their classes, and (rep, comp) of every class whose component has a lesser one."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup", BATCH_BYTES)
    texts = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    sk = scratch.keep(texts.mapInArrow(_sketch, SKETCH))
    # 1. classes of equal sets: the least id of each, and one document to make the set from again
    full = sk.where("n_shingles > 0").groupBy(F.col("set_id").alias("rep"))
    classes = full.agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.max("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"), F.count("*").alias("copies"),
    )
    classes = scratch.keep(classes)

    def keys(n: int) -> Column:
        """The first n bands: each a hash of its number and its registers."""
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.xxhash64(i, F.col("sketch").substr(2 * rows * i + 1, F.lit(2 * rows))))

    def met(bands: DataFrame, buckets: DataFrame) -> DataFrame:
        return bands.join(F.broadcast(buckets), "key") if buckets.n_rows <= MOST_ROWS else salted_join(bands, buckets, ["key"], F.col("rep"), salts=8)

    # 2. a star in each bucket of the first bands
    bands = classes.select("rep", F.explode(keys(min(STAR, M // rows))).alias("key"))
    heads = scratch.keep(bands.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"))
    pairs = scratch.keep(met(bands, heads).where("rep <> a").select("a", F.col("rep").alias("b")).distinct())
    comps = components(verify(pairs, classes, texts, scratch, percent), scratch)
    # 3. all buckets that hold several components: all pairs of small ones, a star in large ones
    bands = relabel(classes.select("rep", F.col("rep").alias("comp"), "sketch"), "comp", comps, "rep").select("rep", "comp", F.explode(keys(M // rows)).alias("key"))
    spread = F.xxhash64("comp")  # two components of one bucket that share a hash: 2**-64
    live = bands.groupBy("key").agg(F.count("*").alias("n_in"), F.min(spread).alias("c0"), F.max(spread).alias("c1"), F.min(F.struct("rep", "comp")).alias("head"))
    live = scratch.keep(live.where("c0 <> c1").select("key", "n_in", F.col("head.rep").alias("a"), F.col("head.comp").alias("ca")))
    if not live.n_rows:
        return sk, classes, comps
    members = scratch.keep(met(bands, live))
    groups = members.where(F.col("n_in") <= SMALL_GROUP).groupBy("key").agg(F.collect_list(F.struct("rep", "comp")).alias("m"))
    star = members.where((F.col("n_in") > SMALL_GROUP) & (F.col("comp") != F.col("ca"))).select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b"))
    links = verify(scratch.keep(pairs_within(groups).union(star).distinct()), classes, texts, scratch, percent)
    more = joined_by(links, comps, scratch)
    # 4. large buckets that still hold several components
    large = relabel(members.where(F.col("n_in") > SMALL_GROUP).select("key", "rep", F.col("rep").alias("comp")), "comp", more, "rep").select("key", "rep", "comp")
    large = scratch.keep(large)
    if large.n_rows:
        left = large.groupBy("key").agg(F.min(spread).alias("c0"), F.max(spread).alias("c1")).where("c0 <> c1").select("key")
        left = scratch.keep(left)
        rest = scratch.keep(met(large, left).select("rep", "comp").distinct()) if left.n_rows else left
        if rest.n_rows:
            more = joined_by(prefix_links(rest, classes, texts, scratch, percent), more, scratch)
    return sk, classes, more


def component_of(sk: DataFrame, classes: DataFrame, value: DataFrame, name: str) -> DataFrame:
    """``sk`` with the column ``name`` of its class; ``value`` has (rep, name) for some classes, null else."""
    scratch = Scratch(sk.sparkSession, "neardup", BATCH_BYTES)
    rows = value.n_rows
    none = sk.where("n_shingles = 0").withColumn("least", F.lit(None).cast("long")).withColumn(name, F.lit(None).cast(value.schema[name].dataType))
    sk = sk.where("n_shingles > 0")
    mine = classes.join(F.broadcast(value) if rows <= MOST_ROWS else value, "rep", "left").select(F.col("rep").alias("set_id"), "least", "copies", name)
    # classes of many copies are few: they are broadcast, and the others have at most HOT rows each
    hot = scratch.keep(mine.where(F.col("copies") > HOT).drop("copies"))
    if hot.n_rows > MOST_ROWS:
        return dealt_join(sk, mine.drop("copies"), ["set_id"], F.xxhash64("doc_id", "text_hash"), "left").unionByName(none)
    cold = sk.join(F.broadcast(hot.select("set_id")), "set_id", "left_anti") if hot.n_rows else sk
    out = cold.join(mine.where(F.col("copies") <= HOT).drop("copies"), "set_id", "left").unionByName(none)
    return out.unionByName(sk.join(F.broadcast(hot), "set_id")) if hot.n_rows else out


def near_duplicates(docs: DataFrame, text: str = "text", id_: str = "doc_id", percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    sk, classes, comps = linked(docs, text, id_, percent, rows)
    scratch = Scratch(docs.sparkSession, "neardup", BATCH_BYTES)
    # every class in a component takes the least id of the component's classes
    nodes = scratch.keep(comps.select("rep", "comp").union(comps.select(F.col("comp").alias("rep"), "comp")).distinct())
    least = nodes.join(classes.select("rep", "least"), "rep")
    of = scratch.keep(least.groupBy("comp").agg(F.min("least").alias("component_id")))
    named = scratch.keep(dealt_join(nodes, of, ["comp"], F.col("rep"), rows=of.n_rows).select("rep", "component_id"))
    out = component_of(sk.select("doc_id", "n_shingles", "set_id", "text_hash"), classes, named, "component_id")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "least")))
    return out.select(
        F.col("doc_id").alias(id_), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def deduplicate(docs: DataFrame, text: str = "text", id_: str = "doc_id", percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """One document of each component, chosen by class: the least id, null last; of one id the least text hash.

    Rows without words are components of their own.  Of rows equal in id and
    text one stays, the least by the hash of its other columns, whole.
    """
    sk, classes, comps = linked(docs, text, id_, percent, rows)
    mine = component_of(sk.select("doc_id", "text_hash", "n_shingles", "set_id"), classes, comps, "comp")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))).alias("k")
    keep = mine.where("n_shingles > 0").groupBy(F.coalesce("comp", "set_id").alias("comp")).agg(first).select("k.doc_id", "k.text_hash")
    keep = keep.union(mine.where("n_shingles = 0").select("doc_id", "text_hash").distinct())
    scratch = Scratch(docs.sparkSession, "neardup", BATCH_BYTES)
    rows_ = docs.select(F.struct(*docs.columns).alias("_nd_row"), F.col(id_).cast("long").alias("_nd_id"), F.xxhash64(F.col(text)).alias("_nd_text"))
    keep = scratch.keep(keep.select(F.col("doc_id").alias("_nd_doc"), F.col("text_hash").alias("_nd_hash")))
    same = F.col("_nd_id").eqNullSafe(F.col("_nd_doc")) & (F.col("_nd_text") == F.col("_nd_hash"))
    kept = rows_.join(lookup_side(keep), same, "left_semi").withColumn("_nd_other", F.xxhash64(F.to_json("_nd_row")))
    # repeated rows: the least hash of the whole row, told apart by keys of fixed width alone
    again = kept.groupBy("_nd_id", "_nd_text").agg(F.count("*").alias("n"), F.min("_nd_other").alias("_nd_least")).where("n > 1")
    again = scratch.keep(again.select(F.col("_nd_id").alias("_nd_ri"), F.col("_nd_text").alias("_nd_rt"), "_nd_least"))
    if not again.n_rows:
        return kept.select("_nd_row.*")
    repeated = F.col("_nd_id").eqNullSafe(F.col("_nd_ri")) & (F.col("_nd_text") == F.col("_nd_rt"))
    marked = kept.join(lookup_side(again), repeated, "left")
    single = marked.where("_nd_least is null").select("_nd_row")
    one = marked.where("_nd_other = _nd_least").groupBy("_nd_id", "_nd_text").agg(F.first("_nd_row").alias("_nd_row")).select("_nd_row")
    return single.union(one).select("_nd_row.*")


def clusters(docs: DataFrame, text: str = "text", id_: str = "doc_id", percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, cluster): the component of every distinct row that has words, by class, so null and repeated ids keep theirs."""
    sk, classes, comps = linked(docs, text, id_, percent, rows)
    mine = sk.where("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "set_id").distinct()
    mine = component_of(mine, classes, comps, "comp")
    return mine.select("doc_id", "text_hash", F.xxhash64(F.coalesce("comp", "set_id")).alias("cluster"))
