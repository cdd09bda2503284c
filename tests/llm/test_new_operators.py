"""Exact duplicates, whitening and phrases: edge cases and brute force on small fixtures."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from semnet.llm import base, digests, phrases, queries, whiten

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def judged(rows):
    """doc_id, keep_id, group_size, text_sha256 of each row, and the ids that stay."""
    form = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), f in zip(rows, form):
        groups.setdefault(f, []).append(i)
    least = {f: min((x for x in g if x is not None), default=None) for f, g in groups.items()}
    return sorted(((i, least[f], len(groups[f]), hashlib.sha256(f.encode()).hexdigest()) for (i, _), f in zip(rows, form)), key=repr), sorted(least.values(), key=repr)


@pytest.mark.parametrize("run,bits,least", [(1 << 19, 3, None), (7, 1, 16), (5, 2, 32), (1 << 19, 3, 1)])
def test_exact_brute_force(spark, run, bits, least):
    r = np.random.default_rng(3)
    rows = [(int(i), f"text  {k}" if i % 2 else f"text\t{k}") for i, k in enumerate(np.minimum(r.integers(0, 400, 900), 250))]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "\x0b"), (1004, " a"), (1005, "a"), (1006, "a b"), (1007, "y " * 40000), (1008, "y\n" * 40000), (None, "text 3"), (None, "lone"), (None, "lone"), (5, "twice"), (5, "twice")]
    got = digests.exact_duplicates(docs(spark, rows).repartition(11), run, bits, least).collect()
    expected, kept = judged(rows)
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got), key=repr) == expected
    assert sorted((x.doc_id for x in got if x.kept), key=repr) == kept


def test_exact_edges(spark):
    assert digests.exact_duplicates(docs(spark, [])).count() == 0
    d = docs(spark, [(3, "a  b"), (1, "a b"), (1, "a b"), (2, "c"), (None, None)]).withColumn("digest", F.lit("x")).withColumn("row", F.lit(1)).withColumn("kept", F.lit(False)).withColumn("n", F.lit(2))
    assert digests.exact_duplicates(d).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = digests.without_copies(d)
    assert got.columns == d.columns and sorted(((x.doc_id, x.text) for x in got.collect()), key=repr) == [(1, "a b"), (2, "c"), (None, None)]


def test_exact_verifies_digests():
    """Entries that share 64 bits of a digest stay apart; those of one digest and two lengths too."""
    a, b = b"\0" * 31 + b"\1", b"\0" * 31 + b"\2"
    import pyarrow as pa

    cols = {"at": pa.array([0] * 5, pa.int32()), "digest": pa.array([b, a, b, a, a], pa.binary()), "size": [1, 1, 1, 1, 2], "id": [9, 8, 7, None, 6], "row": [1, 2, 3, 4, 5], "n": [1, 1, 1, 1, 1]}
    m = digests._merged([pa.RecordBatch.from_pydict(cols, pa.schema([("at", pa.int32()), ("digest", pa.binary()), ("size", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64())]))])
    assert m["id"].tolist() == [8, 6, 7] and m["n"].tolist() == [2, 1, 2] and m["row"].tolist() == [2, 5, 3]


VECTORS = "vec_id long, embedding array<float>, label int"


def exact_fit(xs):
    """Mean-free covariance of the distinct vectors in fractions, as doubles."""
    fit = sorted(set(map(tuple, xs)))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    c = [[Fraction(v) - Fraction(t, n) for v, t in zip(x, s)] for x in fit]
    d = len(s)
    cov = np.array([[float(sum(r[i] * r[j] for r in c) / n) for j in range(d)] for i in range(d)])
    return n, s, cov


def test_whiten_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(r.normal(size=(60, 20)) * np.arange(1, 21))]
    rows += [(100 + i, rows[3][1], 1) for i in range(50)]  # a hot vector counts once
    bad = [(200, None, 0), (201, [1.0, None] + [0.0] * 18, 0), (202, [float("nan")] * 20, 0), (203, [float("inf")] * 20, 0), (204, [], 0), (205, [1e30] * 20, 0)]
    got = whiten.whiten(spark.createDataFrame(rows + bad, VECTORS).repartition(5)).collect()
    assert len(got) == 16 * len(rows) and {x.vec_id for x in got} == {i for i, _, _ in rows}
    xs = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v, _ in rows}
    n, s, cov = exact_fit(xs.values())
    value, vec = np.linalg.eigh(cov)
    by = {}
    for x in got:
        by.setdefault(x.component, {})[x.vec_id] = x
        assert x.n == n == 60 and x.identity_error == got[0].identity_error < 1e-9
        assert x.deviation == sum((n * v - t) ** 2 for v, t in zip(xs[x.vec_id], s))
    for c, rows_ in by.items():
        e, u = value[-c], vec[:, -c]
        assert all(abs(x.explained - e / np.trace(cov)) < 1e-9 for x in rows_.values())
        w = np.array([rows_[i].whitened for i in xs])
        true = np.array([[float(Fraction(v) - Fraction(t, n)) for v, t in zip(x, s)] for x in xs.values()]) @ u / np.sqrt(e)
        assert min(np.abs(w - true).max(), np.abs(w + true).max()) < 1e-9


def test_whiten_edges(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whiten.whiten(empty).count() == 0
    one = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)], VECTORS)).collect()
    assert len(one) == 4 and {(x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in one} == {(1, 0, 0.0, 0.0, 0.0)}
    # lengths are whitened apart, a constant entry has no variance, extra columns don't clash
    rows = [(i, [float(i), 7.0], 0) for i in range(4)] + [(10 + i, [float(i)], 0) for i in range(3)]
    got = whiten.whiten(spark.createDataFrame(rows, VECTORS).withColumn("x", F.lit(1)).withColumn("component", F.lit(1))).collect()
    two = [x for x in got if x.vec_id < 10]
    assert len(got) == 11 and {x.n for x in two} == {4} and {x.whitened for x in two if x.component == 2} == {0.0}
    assert abs(sum(x.whitened**2 for x in two if x.component == 1) / 4 - 1) < 1e-12 and max(x.identity_error for x in got) < 1e-12
    # past a long, deviations are decimals and still exact
    far = whiten.whiten(spark.createDataFrame([(1, [1e10], 0), (2, [-1e10], 0)], VECTORS))
    assert dict(far.dtypes)["deviation"] == "decimal(38,0)" and {int(x.deviation) for x in far.collect()} == {(64 * 10**10 * 2) ** 2}


def mined(rows, least, top=2000, inside=80):
    """(lang, rank, phrase, a, l, r, n, score) by counting every sequence of words."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] = f.get((lang, tuple(w[i : i + k])), 0) + 1
    out = []
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for lang in n:
        rows_ = []
        for (g, p), a in cand.items():
            if g != lang or any(h == g and len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (h, q), b in cand.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard,chunk,top", [(8 << 20, 1 << 16, 2000), (300, 1, 2000), (2000, 7, 5)])
def test_phrases_brute_force(spark, monkeypatch, shard, chunk, top):
    r = np.random.default_rng(11)
    # é and Ä keep their case, words may hold marks that don't cut; 'a a a a a' overlaps itself
    names = ["The", "the", "of", "new", "York", "city", "\u00e9t\u00e9", "\u00c4b", "a-b", "(x)", "zz"]
    texts = [("xx" if i % 3 else None, " ".join(names[k] + ["", "", "", ".", ",", "\n", "  ", "\t"][m] for k, m in zip(r.integers(0, len(names), 60), r.integers(0, 8, 60)))) for i in range(40)]
    texts += [("xx", "new york city hall\x0bnew york city hall"), ("xx", "a a a a a a a"), ("xx", None), ("xx", ""), ("xx", " .,; "), ("xx", "w" * 40000), ("und", "the of the of")] + [("yy", "one two three four five")] * 6
    texts += [("xx", "a " * 3000)]
    d = spark.createDataFrame([(i, t, g, "s", None) for i, (g, t) in enumerate(texts)], DOCS).withColumn("shard", F.lit(1)).withColumn("p", F.lit(2)).repartition(3)
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    got = sorted(tuple(x) for x in phrases.collocations(d, least=6, top=top, shard=shard).collect())
    assert got == mined(texts, 6, top) and len(got) > 10


def test_phrases_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(docs(spark, [(1, "a b c"), (2, None)])).count() == 0


def test_phrases_pass_64_bits(spark):
    words = spark.createDataFrame([(1, "x", "a", 9 * 10**18), (2, "x", "b", 9 * 10**18)], "id long, lang string, word string, f long")
    words.n_rows = 2
    pairs = spark.createDataFrame([("x", [1, 2], 6 * 10**18, 9 * 10**18, 9 * 10**18)], "lang string, p array<long>, f long, l long, r long")
    longer = spark.createDataFrame([], "lang string, p array<long>, f long")
    got = phrases.scored(words, pairs, longer, base.Scratch(spark, "test")).collect()
    assert [(x.a, x.l, x.r, x.score) for x in got] == [(6 * 10**18, 9 * 10**18, 9 * 10**18, 2_000_000 * 6 // 18)]


def test_empty_tables(spark, tmp_path):
    """Every query that reads one table gives no rows where it has none."""
    kinds = {
        "documents": DOCS, "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string",
        "conversations": "conv_id long, turn int, role string, text string", "embeddings": VECTORS, "benchmark": "item_id long, text string",
    }
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("op1_line_frequency", "op3_quality_fm", "op5_url_filter", "op6_chat_format", "op7_warc", "op9_language_id", "op12_exact_dedup", "op13_embedding_whitening"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0, name


def test_phrases_reach_python_in_bounded_batches(spark, monkeypatch):
    from semnet.llm import phrases

    seen = []

    class Noted(phrases.Scratch):
        def keep(self, df, flag=None):
            with self.batches():
                seen.append(self.spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
            return super().keep(df, flag)

    monkeypatch.setattr(phrases, "Scratch", Noted)
    docs = spark.createDataFrame([("a b. " * 40, "en")], "text string, lang string")
    assert [(r["phrase"], r["a"]) for r in phrases.collocations(docs).collect()] == [("a b", 40)]
    assert seen and set(seen) == {str(phrases.BATCH)}


def test_phrases_pass_no_row_for_a_pair_and_shard(spark, monkeypatch):
    """Tables between the steps have a row for each frequent phrase and some for each shard, not one for each pair of each shard."""
    seen = []

    class Noted(phrases.Scratch):
        def keep(self, df, flag=None):
            out = super().keep(df, flag)
            seen.append(out.n_rows)
            return out

    monkeypatch.setattr(phrases, "Scratch", Noted)
    monkeypatch.setattr(phrases, "PARTS", 2, raising=False)
    line = " ".join(f"w{i}" for i in range(60))
    texts = [("en", line)] * 40
    got = sorted(tuple(x) for x in phrases.collocations(spark.createDataFrame([(t, g) for g, t in texts], "text string, lang string"), shard=100).collect())
    assert got == mined(texts, 30) and len(got) == 57
    # 40 shards of 59 pairs each: 59 pairs once and two parts a shard at most
    assert max(seen) <= 59 + 58 + 57 + 40 * 2


def test_phrases_are_packed_whole():
    r = np.random.default_rng(3)
    for x in (np.zeros(0, np.int64), np.array([0, 1, 2**40, 2**62]), np.sort(r.integers(0, 2**62, 1000))):
        assert (phrases._unpack_sorted(phrases._pack_sorted(x), len(x)) == x).all() and (phrases._unpack(phrases._pack(x), len(x)) == x).all()
