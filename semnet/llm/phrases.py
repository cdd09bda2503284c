"""Phrase collocations by position bitmaps.

Texts are dealt into *shards* of one language and some megabytes.  The words of
a shard are numbered in order, with one place left free between pieces, and
each word has the bitmap of its places.  A phrase is extended by a word as in
the SPAM miner: its bitmap is shifted by one place and ANDed with the word's;
the free places keep phrases within their pieces, and the number of bits set is
the phrase's count in the shard.  Bitmaps are compressed: stored as the gaps
between set bits, in memory as their non-empty blocks of 8 places, so that a
shifted block meets only the words that have its block.  A shard is searched
depth-first, some first words at a time, which bounds the memory.

Counts are summed over the shards.  A phrase can't be more frequent than its
parts, so the search goes through the shards twice: for pairs of frequent
words, and for longer phrases, all of whose pairs are frequent in the whole
language.  Which words are frequent reaches a shard by a join with what it has,
never as a list of all of them, and a frequent word is a row a shard, never a
hot key.  A shard's counts are dealt by a hash of the phrase into parts, a row
each, in which phrases are numbers in order, stored by their gaps: some bytes a
phrase, frequent or not, so what is exchanged grows as the texts do.  Whoever
adds a part up hands each shard those of its pairs that are frequent, and every
frequent phrase once as a row.

Defined results: a null text is empty, a null lang is ``und``.  Counts are over
all rows, repeated ones included; phrases and words may be of any length in
characters, and a text of any length lies in one shard.  Ties are ranked by
phrase in the order of UTF-8 bytes, so ranks are unique.  An empty table, or
one without frequent phrases, gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, bounded_side, dealt_join
from .neardup import POLY, mix, portions

LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes if a longer one that contains it has this share of its count, in percent.
INSIDE = 80
SCALE = 2_000_000
#: Bytes of text in a shard, and blocks of first words that are searched at a time.
SHARD, CHUNK = 8 << 20, 1 << 16
#: Bytes of a batch of rows on its way to a Python function.
BATCH = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 in words, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2

#: The least number of parts that a shard's counts are dealt into, and occurrences of words for each part.
PARTS, PART = 64, 4 << 20

#: Shuffle files go as soon as what was made of them is written.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SHARDS = "shard long, lang string, words array<string>, counts array<int>, gaps binary"
NUMBERED = "shard long, lang string, ids array<long>, counts array<int>, gaps binary"
#: Counts of the phrases of a part in a shard; ``rest`` has the words after the first two.
PART_ROWS = "lang string, part int, shard long, many int, keys binary, rest binary, counts binary"


def _pack(x: np.ndarray, kind: str = "<i8") -> bytes:
    """Whole numbers, compressed by bytes: high ones are mostly zero, and lie together."""
    width = np.dtype(kind).itemsize
    planes = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, width).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpack(raw: bytes, n: int, kind: str = "<i8") -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, width * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel().astype(np.int64)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=0))


def _unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(raw, n))


def _placed(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a text, the number of the word of each occurrence, and its place."""
    text = _LOWER[np.frombuffer(raw, np.uint8)]
    kind = _KIND[text]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text[inside])]).dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    return found.dictionary, found.indices.to_numpy(), np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)


def _listed(x: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _shard(number: int, lang: str, texts: list[bytes]) -> pa.RecordBatch | None:
    names, code, place = _placed(b"\n".join(texts))
    if not len(code):
        return None
    both = np.sort(code.astype(np.int64) << 32 | place)  # places by word
    code, place = both >> 32, both & 0xFFFFFFFF
    counts = np.bincount(code, minlength=len(names))
    gaps = np.diff(place, prepend=0)
    first = np.cumsum(counts) - counts
    gaps[first] = place[first]
    cols = [pa.array([number]), pa.array([lang]), _listed(names.cast(pa.string())), _listed(pa.array(counts.astype(np.int32))), pa.array([_pack(gaps, "<u4")], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["shard", "lang", "words", "counts", "gaps"])


def _shards(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def full(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            while size and (max(size.values()) >= least or sum(size.values()) >= 8 * least):
                lang = max(size, key=size.get)
                made = _shard(number, lang, held.pop(lang))
                number, _ = number + 1, size.pop(lang)
                pa.default_memory_pool().release_unused()
                if made is not None:
                    yield made

        for whole in batches:
            for b in portions(whole, "text", most):
                langs = b.column("lang")
                for lang in langs.unique().to_pylist():
                    texts = b.column("text").filter(pc.equal(langs, lang)).cast(pa.binary())
                    held.setdefault(lang, []).append(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), b"\n")[0].as_py())
                    size[lang] = size.get(lang, 0) + len(held[lang][-1])
                yield from full(most)
        yield from full(0)

    return run


def _kept(scratch: Scratch, df: DataFrame) -> DataFrame:
    """Write and read back a table that is made once, and drop the shuffle files behind it."""
    conf = scratch.spark.conf
    before = conf.get(TIDY, "false")
    conf.set(TIDY, "true")
    try:
        return scratch.keep(df)
    finally:
        conf.set(TIDY, before)


def shards(docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", most: int = SHARD) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return _kept(scratch, rows.mapInArrow(_shards(most), SHARDS))


def _bits_of(row: pa.Table, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gaps and counts of the words of a shard whose numbers are ``chosen``, in ascending order."""
    counts = row["counts"].combine_chunks().flatten().to_numpy()
    gaps = _unpack(row["gaps"][0].as_py(), int(counts.sum()), "<u4")
    mine = np.zeros(len(counts), bool)
    mine[chosen] = True
    return gaps[np.repeat(mine, counts)], counts[mine]


class Bitmaps:
    """The bitmaps of some words of a shard, as blocks by word and by block. ``chosen``: their numbers, ascending; a word's code is its place there."""

    def __init__(self, row: pa.Table, chosen: np.ndarray):
        gaps, counts = _bits_of(row, chosen)
        summed = np.cumsum(gaps)
        first = np.cumsum(counts) - counts
        place = summed - np.repeat(summed[first] - gaps[first], counts)
        word, block = np.repeat(np.arange(len(chosen)), counts), place >> 3
        new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])]))
        self.word, self.block = word[new], block[new]
        self.mask = np.bitwise_or.reduceat((1 << (place & 7)).astype(np.uint8), new)
        order = np.argsort(self.block, kind="stable")
        self.by_word, self.by_mask = self.word[order].astype(np.int32), self.mask[order]
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(self.block, minlength=int(self.block.max()) + 2))])  # a carry may need one block more
        self.size = len(chosen)

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words' bitmaps, about CHUNK blocks at a time, words whole."""
        ends = np.append(np.flatnonzero(np.diff(self.word)) + 1, len(self.word))
        at = 0
        while at < len(self.word):
            end = int(ends[min(np.searchsorted(ends, at + CHUNK), len(ends) - 1)])
            yield self.word[at:end], self.block[at:end], self.mask[at:end]
            at = end

    def extend(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray):
        """Shift bitmaps by a place and AND them with all words' blocks: (phrase, word, block, mask) where bits remain."""
        over = np.flatnonzero(mask & 0x80)
        phrase = np.concatenate([phrase, phrase[over]])
        mask = np.concatenate([mask << 1, np.ones(len(over), np.uint8)])
        block = np.concatenate([block, block[over] + 1])
        some = mask != 0
        phrase, block, mask = phrase[some], block[some], mask[some]
        n = self.ptr[block + 1] - self.ptr[block]
        to = np.arange(int(n.sum())) + np.repeat(self.ptr[block] - (np.cumsum(n) - n), n)
        hit = np.repeat(mask, n) & self.by_mask[to]
        some = np.flatnonzero(hit)
        of = np.repeat(np.arange(len(n)), n)[some]
        return phrase[of], self.by_word[to[some]].astype(np.int64), block[of], hit[some]


def _counted(key: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the bits set under each, and the place of each element's key."""
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, np.bitwise_count(mask), len(keys)).astype(np.int64), at


def _numbered(known: pa.Table, row: pa.Table) -> pa.Table:
    """A shard with the ids of its known words instead of their names, and the places of these only."""
    if not (known.num_rows and row.num_rows):
        return pa.table({"shard": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int64())), "counts": pa.array([], pa.list_(pa.int32())), "gaps": pa.array([], pa.binary())})
    known = known.sort_by("word")
    gaps, counts = _bits_of(row, known["word"].to_numpy())
    ids = pa.array(known["id"].to_numpy().astype(np.int64))
    return pa.table({"shard": row["shard"], "lang": row["lang"], "ids": _listed(ids), "counts": _listed(pa.array(counts.astype(np.int32))), "gaps": pa.array([_pack(gaps, "<u4")], pa.binary())})


def _dealt(row: pa.Table, made: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> pa.Table:
    """PART_ROWS of a shard: phrases (key of the first two words, rest or 0, n), each once."""
    keys, rest, n = (np.concatenate(c) for c in zip(*made)) if made else [np.zeros(0, np.int64)] * 3
    with np.errstate(over="ignore"):
        part = (mix(keys.view(np.uint64) * POLY + rest.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((rest, keys, part))
    keys, rest, n, part = keys[order], rest[order], n[order], part[order]
    at = np.flatnonzero(np.diff(part, prepend=-1))
    cols = [(int(part[i]), j - i, _pack_sorted(keys[i:j]), _pack(rest[i:j]) if rest[i:j].any() else None, _pack(n[i:j], "<u4")) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(part)])]
    part, many, keys, rest, n = zip(*cols) if cols else [()] * 5
    of = lambda c, kind: pa.repeat(pa.scalar(row[c][0].as_py() if cols else None, kind), len(part))
    return pa.table({"lang": of("lang", pa.string()), "part": pa.array(part, pa.int32()), "shard": of("shard", pa.int64()), "many": pa.array(many, pa.int32()), "keys": pa.array(keys, pa.binary()), "rest": pa.array(rest, pa.binary()), "counts": pa.array(n, pa.binary())})


def _pairs(total: int, parts: int):
    """Counts of a shard's pairs. ``total``: the number of words; a pair's key is the first's id times it and the second's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row, made = pa.Table.from_batches([b.slice(i, 1)]), []
                ids = row["ids"].combine_chunks().flatten().to_numpy()
                bits = Bitmaps(row, np.arange(len(ids)))
                for chunk in bits.chunks():
                    a, b_, _, mask = bits.extend(*chunk)
                    key, n, _ = _counted(a * bits.size + b_, mask)
                    made.append((ids[key // bits.size] * total + ids[key % bits.size], np.zeros(len(key), np.int64), n))
                yield from _dealt(row, made, parts).to_batches()
                pa.default_memory_pool().release_unused()

    return run


def _read(part: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    rows = zip(*(part[c].to_pylist() for c in ("many", "keys", "rest", "counts")))
    return [(_unpack_sorted(k, m), np.zeros(m, np.int64) if r is None else _unpack(r, m), _unpack(n, m, "<u4")) for m, k, r, n in rows]


def _frequent_pairs(total: int, least: int):
    def run(part: pa.Table) -> pa.Table:
        """(lang, a, b, f) of the frequent pairs of a part, and (shard, many, keys) of those that a shard has."""
        read = [(k, n) for k, _, n in _read(part)]
        keys, at = np.unique(np.concatenate([k for k, _ in read]), return_inverse=True)
        f = np.bincount(at, np.concatenate([n for _, n in read]), len(keys)).astype(np.int64)
        often = f >= least
        theirs, start = [], 0
        for (k, _), shard in zip(read, part["shard"].to_pylist()):
            k, start = k[often[at[start : start + len(k)]]], start + len(k)
            if len(k):
                theirs.append((shard, len(k), _pack_sorted(k)))
        keys, f = keys[often], f[often]
        shard, many, packed = zip(*theirs) if theirs else [()] * 3
        one, each = len(keys), len(shard)
        whole = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(each, kind)])
        own = lambda x, kind: pa.concat_arrays([pa.nulls(one, kind), pa.array(x, kind)])
        return pa.table({
            "lang": pa.repeat(part["lang"][0], one + each), "a": whole(keys // total, pa.int64()), "b": whole(keys % total, pa.int64()), "f": whole(f, pa.int64()),
            "shard": own(shard, pa.int64()), "many": own(many, pa.int32()), "keys": own(packed, pa.binary()),
        })

    return run


def _longer(total: int, parts: int):
    def run(pairs: pa.Table, row: pa.Table) -> pa.Table:
        """Counts of a shard's phrases of three and four words whose pairs are all in ``pairs``."""
        made = []
        if pairs.num_rows and row.num_rows:
            all_ids = row["ids"].combine_chunks().flatten().to_numpy()
            order = np.argsort(all_ids)
            keys = np.concatenate([_unpack_sorted(k, m) for m, k in zip(pairs["many"].to_pylist(), pairs["keys"].to_pylist())])
            left, right = (order[np.searchsorted(all_ids, x, sorter=order)] for x in np.divmod(keys, total))
            number = np.unique(np.concatenate([left, right]))
            ids = all_ids[number]
            bits = Bitmaps(row, number)
            known = np.sort(np.searchsorted(number, left) * bits.size + np.searchsorted(number, right))
            last = known % bits.size

            def of_pairs(word: np.ndarray, next_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Which (word, next_) are known pairs, and the place of each pair."""
                key = word * bits.size + next_
                where = np.minimum(np.searchsorted(known, key), len(known) - 1)
                good = np.flatnonzero(known[where] == key)
                return good, where[good]

            def first(pair: np.ndarray) -> np.ndarray:
                return ids[known[pair] // bits.size] * total + ids[known[pair] % bits.size]

            for chunk in bits.chunks():
                a, b, block, mask = bits.extend(*chunk)
                good, pair = of_pairs(a, b)
                if not len(good):
                    continue
                pair, c, block, mask = bits.extend(pair, block[good], mask[good])
                good, _ = of_pairs(last[pair], c)
                if not len(good):
                    continue
                block, mask = block[good], mask[good]
                three, n, of = _counted(pair[good] * bits.size + c[good], mask)
                pair, c = np.divmod(three, bits.size)
                made.append((first(pair), ids[c] * (total + 1), n))
                of, d, _, mask = bits.extend(of, block, mask)
                good, _ = of_pairs(c[of], d)
                four, n, _ = _counted(of[good] * bits.size + d[good], mask[good])
                of, d = np.divmod(four, bits.size)
                made.append((first(pair[of]), ids[c[of]] * (total + 1) + ids[d] + 1, n))
        return _dealt(row, made, parts)

    return run


def _frequent_longer(total: int, least: int):
    def run(part: pa.Table) -> pa.Table:
        """(lang, a, b, c, d, f) of the frequent phrases of a part; d is null for three words."""
        keys, rest, n = (np.concatenate(c) for c in zip(*_read(part)))
        order = np.lexsort((rest, keys))
        keys, rest, n = keys[order], rest[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rest[1:] != rest[:-1])]))
        f = np.add.reduceat(n, at)
        at, f = at[f >= least], f[f >= least]
        (a, b), (c, d) = np.divmod(keys[at], total), np.divmod(rest[at], total + 1)
        return pa.table({"lang": pa.repeat(part["lang"][0], len(f)), "a": a, "b": b, "c": c, "d": pa.array(d - 1, mask=d == 0), "f": f})

    return run


def _dense(words: DataFrame) -> DataFrame:
    """Ids from 0 on without gaps, in place of those of monotonically_increasing_id: by a row for each partition that wrote some."""
    before, rows = 0, []
    for r in words.groupBy(F.shiftright("id", 33).alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect():
        rows.append((r["_part"], before))
        before += r["n"]
    starts = words.sparkSession.createDataFrame(rows, "_part long, _before long")
    of = words.withColumn("_part", F.shiftright("id", 33)).join(F.broadcast(starts), "_part")
    return of.select("lang", "word", "f", (F.col("id").bitwiseAND((1 << 33) - 1) + F.col("_before")).alias("id")).transform(_counts_of(words))


def frequent_phrases(made: DataFrame, scratch: Scratch, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, pairs, longer) of the kept table of shards: (id, lang, word, f) of the frequent words, (lang, p, f, l, r) of pairs with the counts of their words, (lang, p, f) of phrases of three and four. ``p`` has the ids of the words."""
    local = made.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "_w")).select("shard", "lang", F.col("at").alias("word_at"), "_w.words", "_w.counts")
    f = local.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    words = _dense(_kept(scratch, f.select("lang", "word", "f", F.monotonically_increasing_id().alias("id"))))
    total = max(1, words.n_rows)
    size = made.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    parts = max(PARTS, 1 << max(0, size // PART).bit_length())

    known = local.select("shard", "lang", F.col("words").alias("word"), "word_at").join(bounded_side(words), ["lang", "word"])
    known = known.select(F.col("shard").alias("of"), F.col("word_at").alias("word"), "id")
    bitmaps = made.select("shard", "lang", "counts", "gaps").groupBy("shard")
    rows = _kept(scratch, known.groupBy("of").cogroup(bitmaps).applyInArrow(_numbered, NUMBERED))
    counted = rows.mapInArrow(_pairs(total, parts), PART_ROWS).groupBy("lang", "part")
    pairs = _kept(scratch, counted.applyInArrow(_frequent_pairs(total, least), "lang string, a long, b long, f long, shard long, many int, keys binary"))
    theirs = pairs.where("shard is not null").select("shard", "many", "keys").groupBy("shard")
    counted = theirs.cogroup(rows.groupBy("shard")).applyInArrow(_longer(total, parts), PART_ROWS).groupBy("lang", "part")
    longer = counted.applyInArrow(_frequent_longer(total, least), "lang string, a long, b long, c long, d long, f long")
    two = pairs.where("shard is null").select("lang", "a", "b", "f")
    for word, name in (("a", "l"), ("b", "r")):
        two = dealt_join(two, words.select(F.col("id").alias(word), F.col("f").alias(name)), [word], F.xxhash64("a", "b"), rows=words.n_rows)
    two = two.select("lang", F.array("a", "b").alias("p"), "f", "l", "r")
    ids = F.when(F.col("d").isNull(), F.array("a", "b", "c")).otherwise(F.array("a", "b", "c", "d"))
    return words, _kept(scratch, two), _kept(scratch, longer.select("lang", ids.alias("p"), "f"))


def _counts_of(kept: DataFrame):
    """Hand the row count of a kept table on to a selection of its columns."""

    def put(df: DataFrame) -> DataFrame:
        df.n_rows = kept.n_rows
        return df

    return put


def _big(c: str):
    return F.col(c).cast("decimal(20,0)")


def _score():
    return F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").alias("score")


def scored(words: DataFrame, pairs: DataFrame, longer: DataFrame, scratch: Scratch, inside: int = INSIDE) -> DataFrame:
    """(lang, p, a, l, r, score) of the phrases that no longer one stands for. Sums and products are decimals: they may pass 64 bits."""
    none = F.lit(None).cast("long")
    sizes = F.sequence(F.lit(2), F.size("p") - 1)
    parts = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size("p") - n + 1), lambda i: F.slice("p", i, n))))
    most = longer.select("lang", F.explode(parts).alias("p"), none.alias("f"), none.alias("l"), none.alias("r"), F.col("f").alias("most"))
    every = pairs.select("lang", "p", "f", "l", "r", none.alias("most")).union(longer.select("lang", "p", "f", none, none, none)).union(most)
    # a phrase and what contains it meet under one key: no join
    kept = every.groupBy("lang", "p").agg(*(F.max(c).alias(c) for c in ("f", "l", "r", "most"))).where(F.col("f").isNotNull())
    kept = _kept(scratch, kept.where(F.col("most").isNull() | (100 * _big("most") < inside * _big("f"))).select("lang", "p", F.col("f").alias("a"), "l", "r"))
    two = kept.where("size(p) = 2").select("lang", "p", "a", "l", "r", _score())
    cuts = kept.where("size(p) > 2").select("lang", "p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("lang", "p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("left"), F.slice("p", F.col("k") + 1, F.size("p")).alias("right"))
    # frequencies of parts: at most three ids a row; a frequent word is a part of very many phrases, and is dealt
    f = _kept(scratch, words.select(F.array("id").alias("q"), "f").union(pairs.select("p", "f")).union(longer.where(F.size("p") < LONGEST).select("p", "f")))
    for part, name in (("left", "l"), ("right", "r")):
        cuts = dealt_join(cuts, f.select(F.col("q").alias(part), F.col("f").alias(name)), [part], F.xxhash64("p"), rows=f.n_rows)
    best = cuts.groupBy("lang", "p").agg(F.min(F.struct(_score(), "k", "a", "l", "r")).alias("_b"))
    return two.union(best.select("lang", "p", "_b.a", "_b.l", "_b.r", "_b.score"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, inside: int = INSIDE, shard: int = SHARD) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    scratch = Scratch(docs.sparkSession, "phrases", BATCH)
    made = shards(docs, scratch, text, lang, shard)
    words, pairs, longer = frequent_phrases(made, scratch, least)
    rows = scored(words, pairs, longer, scratch, inside)
    # phrases are spelt out only where they may be among the first
    order = [F.desc("score"), F.desc("a")]
    first = _kept(scratch, rows.withColumn("_r", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_r") <= top).drop("_r"))
    each = first.select("p", F.posexplode("p").alias("_at", "_id")).join(bounded_side(words.select(F.col("id").alias("_id"), "word").transform(_counts_of(words))), "_id")
    spelt = each.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("_w")).select("p", F.concat_ws(" ", "_w.word").alias("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    ranked = first.join(spelt, "p").withColumn("rank", place).where(F.col("rank") <= top)
    n = made.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
