"""The whole pipeline against a plain Python version of its decisions, on a small fixture."""

import numpy as np

import corpus_pipeline
from semnet.llm import packing

WORDS = ["w" + chr(97 + i // 20) + chr(97 + i % 20) for i in range(400)]


def prose(seed, n=120):
    return " ".join(WORDS[k] for k in np.random.default_rng(seed).integers(0, len(WORDS), n))


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_agree_with_brute_force(spark, tmp_path):
    item = "we know Tom has 3 apples and Tom gives 3 apples to Jack who lives 5 km away from the old town"
    leaked = item.replace("Tom", "Maria").replace("3", "15").replace("Jack", "Peter").replace("5 km", "20 km")
    clean = {i: prose(i) for i in range(60)}
    near = {100 + i: clean[i] + " edited" for i in range(10)} | {110: clean[0]}
    junk = {200 + i: "### &&& " * 20 + prose(200 + i, 10) for i in range(60)}
    leaks = {300 + i: f"{prose(300 + i)} {leaked} {prose(400 + i)}" for i in range(3)}
    private = {500 + i: f"{prose(500 + i)} boss{i}@firm.example {prose(600 + i)}" for i in range(3)}
    long = {700: prose(700, 5000)}
    texts = clean | near | junk | leaks | private | long
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in texts.items()]
    # only the prose and the junk are labelled
    marks = [(i, 1, 0) for i in clean] + [(i, 0, 1) for i in junk]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = [i for i in texts if i not in junk]
    sets, kept = {i: shingles(texts[i]) for i in good}, []
    for i in sorted(good):  # every near copy here links with its original itself
        if not any(100 * len(sets[i] & sets[k]) >= 85 * len(sets[i] | sets[k]) for k in kept):
            kept.append(i)
    kept = [i for i in kept if i not in leaks]
    assert set(near).isdisjoint(kept) and set(private) <= set(kept)
    lengths = {}
    for r in got:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.n_tokens
    # an address and its placeholder are one word each
    assert lengths == {i: len(texts[i].split()) for i in kept}
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= packing.CAPACITY
        assert len({r.source for r in b}) == len({r.cluster for r in b}) == len(b)


CLASHES = "score predicted held_out n_items items contaminated email ip card phone secret term kept cluster text_hash rep key n".split()


def test_stages_keep_columns(spark, tmp_path):
    """Each stage but the last returns the columns of documents, names, types and values, clashing and null ones too, and takes empty tables."""
    cols = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} {'double' if i % 2 else 'string'}" for i, c in enumerate(CLASHES))
    extra = lambda k: [None if (i + k) % 5 == 0 else (k + i / 8 if i % 2 else f"v{k}-{i}") for i in range(len(CLASHES))]
    texts = [(None, None), (1, ""), (1, ""), (None, f"{prose(1)} a@b.example"), (None, prose(2)), (5, f"{prose(3)} +1 234 567 8901"), (5, prose(4)), (6, "x"), (7, prose(5))]
    rows = [(i, t, "en" if k % 2 else None, "a" if k % 3 else None, k, *extra(k)) for k, (i, t) in enumerate(texts)]
    rows += [rows[-1]]  # a whole row twice
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(5)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for these in (rows, []):
        docs = spark.createDataFrame(these, cols)
        # (1, "") and the last row are there twice; the benchmark holds the last text
        for (name, stage), kept in zip(corpus_pipeline.STAGES[:-1], (10, 8, 8, 10)):
            out = stage(spark, docs, str(tmp_path))
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
            got = out.collect()
            assert len(got) == (kept if these else 0), name
            changed = ("text", "n_chars") if name == "sanitise" else ()
            strip = lambda r: tuple(v for c, v in zip(docs.columns, r) if c not in changed)  # noqa: B023, E731
            assert {strip(r) for r in got} <= {strip(r) for r in these}, name
            if name == "sanitise" and these:
                assert {r.text for r in got} >= {f"{prose(1)} <EMAIL>", f"{prose(3)} <PHONE>", None, ""}
        corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()


def test_near_dedup_at_80_and_without_ids(spark, tmp_path):
    """Pairs from 0.80 to 0.85 go, and rows with null or repeated ids are deduplicated by their texts."""
    base = {k: prose(900 + k) for k in range(8)}
    edited = {k: " ".join([*t.split()[:-k], *(f"new{k}{i}" for i in range(k))]) for k, t in base.items() if k}
    edited[0] = base[0] + " other"
    near = {k: len(shingles(base[k]) & shingles(t)) / len(shingles(base[k]) | shingles(t)) for k, t in edited.items()}
    middle = prose(950).split()
    middle = " ".join([*middle[:57], "changed", "words", *middle[59:80], "here", *middle[81:]])
    share = len(shingles(prose(950)) & shingles(middle)) / len(shingles(prose(950)) | shingles(middle))
    assert min(near.values()) >= 0.85 and 0.80 <= share < 0.85
    rows = [(None if k < 4 else 10, t) for k, t in base.items()] + [(None if k < 4 else 10, t) for k, t in edited.items()]
    rows += [(20, prose(950)), (21, middle), (30, prose(960)), (31, prose(961)), (31, prose(960) + " last"), (None, ""), (40, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
    whole = [{base[k], edited[k]} for k in range(8)]
    assert all(sum(t in pair for _, t in got) == 1 for pair in whole)
    assert sorted((r for r in got if not any(r[1] in pair for pair in whole)), key=str) == sorted([(20, prose(950)), (30, prose(960)), (31, prose(961)), (None, ""), (40, None)], key=str)
