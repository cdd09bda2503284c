"""Edge cases and brute force on small fixtures."""

import io
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semnet.llm import base, chat, decontam, langid, lines, neardup, packing, pii, quality_fm, queries, urls, warc
from semnet.llm.base import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["w" + chr(97 + i // 20) + chr(97 + i % 20) for i in range(400)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


def prose(seed, n=120):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[k] for k in r.integers(0, len(WORDS), n))


AWKWARD = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "x", "a"), (None, "one two", "a"), (5, prose(5), "a"), (5, prose(5), "a"), (5, prose(6), "b"), (6, "y " * 30000, "a")]


def test_lines_edges(spark):
    got = lines.line_frequency_rules(docs(spark, AWKWARD).withColumn("lost", F.lit(1)).withColumn("host", F.lit(2))).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[3].n_words == 0 and by[1].base_failed and not by[1].kept
    assert by[6].n_repeat_words == 30000
    assert lines.line_frequency_rules(docs(spark, [])).count() == 0


def test_boilerplate(spark):
    rows = [(i, f"{prose(i, 12)}\nAll rights  reserved 20{i:02}.", "h") for i in range(30)] + [(99, "all rights reserved 7.\nAll Rights reserved 8.\n" * 4, "h"), (98, prose(98) + "\nAll rights reserved 1.", "other")]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in lines.line_frequency_rules(d).collect()}
    assert got[0].lost_words == 4 and got[0].kept
    assert got[99].lost_words == got[99].n_words and not got[99].kept
    assert got[98].lost_words == 0
    # in a host of any size a line of very many documents goes, whatever its share
    assert {r.lost_words for r in lines.line_frequency_rules(d, max_share=2.0).collect()} == {0}
    assert {r.doc_id: r.lost_words for r in lines.line_frequency_rules(d, max_share=2.0, many=25).collect()}[0] == 4
    cut = {r.doc_id: r.text for r in lines.strip_common_lines(d).collect()}
    assert cut[0] == prose(0, 12) and cut[98].endswith("reserved 1.")


def sets_of(texts):
    with np.errstate(over="ignore"):
        s, n = neardup.shingles(pa.array(texts, pa.string()))
    return np.split(s, np.cumsum(n)[:-1])


def test_neardup_brute_force(spark):
    base = prose(1, 200).split()
    rows = [(k, t, s) for k, t, s in AWKWARD if k != 6]
    for i in range(60):  # variants of one text: some link only through others
        w = list(base)
        for k in np.random.default_rng(i).integers(0, 200, i % 6):
            w[k] = f"edit{i}_{k}"
        rows.append((100 + i, " ".join(w).upper() if i % 2 else " ".join(w), "a"))
    for i, seed in ((50, 50), (50, 51), (60, 50), (70, 51), (None, 52), (None, 53)):  # one id, two texts; links of each; and without ids
        rows.append((i, prose(seed) + f" last{i}", "a"))
    rows += [(None, prose(52) + " other", "a"), (80, prose(53), "a")]
    got = neardup.near_duplicates(docs(spark, rows)).collect()
    sets = sets_of([t for _, t, _ in rows])
    ids = [i for i, _, _ in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                n = len(np.intersect1d(sets[a], sets[b]))
                if len(sets[a]) and len(sets[b]) and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                    root[a] = root[b] = min(root[a], root[b])
    want = []
    for k, r in enumerate(root):
        least = min((ids[j] for j in range(len(rows)) if root[j] == r and ids[j] is not None), default=None)
        comp = least if len(sets[k]) else ids[k]
        want.append((ids[k], len(sets[k]), comp, ids[k] is not None and ids[k] == comp))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_shingles():
    texts = [None, "", " \t", "a B", "A b c D e", "a b c d e", " \n".join("x y z".split()) + "  ", "q " * 9, prose(3), "É é a b c d", "a\x1cb c\u00a0d"]
    low = lambda t: t.translate({k: k + 32 for k in range(65, 91)})
    plain = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", low(t or "")) if x]
        plain.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    got = [set(x.tolist()) for x in sets_of(texts)]
    assert [len(x) for x in got] == [len(x) for x in plain]
    assert all((got[i] == got[k]) == (plain[i] == plain[k]) for i in range(len(texts)) for k in range(len(texts)))
    # in portions as at once
    whole = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = [x for b in neardup.portions(whole, "text", 4) for x in sets_of(b.column("text").to_pylist())]
    assert [set(x.tolist()) for x in parts] == got


def test_registers():
    a, b = sets_of([prose(1, 500), prose(1, 500) + " " + prose(2, 40)])
    with np.errstate(over="ignore"):
        every = [a, np.empty(0, np.uint64), b, np.union1d(a, b), a[:1]]
        r = neardup.registers(np.concatenate(every), np.array([len(x) for x in every]))
        alone = [neardup.registers(x, np.array([len(x)]))[0] for x in every]
    assert (r == np.array(alone)).all() and not r[1].any()
    assert (r[3] == np.maximum(r[0], r[2])).all()
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    est = neardup.estimate(r[0][None], r[2][None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(est - j) < 0.15


def test_common():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, n)) for n in (1, 9, 30, 55, 3, 20)]
    want = [[len(np.intersect1d(x, y)) for y in sets[3:]] for x in sets[:3]]
    assert (neardup.common(sets[:3], sets[3:], width=7) == want).all()


def test_groups_agree(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_GROUP", 1)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "STAR", 1)
    test_neardup_brute_force(spark)


def test_joins_beyond_broadcast(spark, monkeypatch):
    for module in (base, neardup):
        monkeypatch.setattr(module, "MOST_ROWS", -1)
    monkeypatch.setattr(neardup, "MOST_SKETCHES", -1)
    monkeypatch.setattr(neardup, "MOST_COMMON", 3)
    monkeypatch.setattr(neardup, "HOT", 1)
    test_groups_agree(spark, monkeypatch)


def test_prefix_links(spark, monkeypatch):
    """One group of linked, nearly linked and unlinked texts: all links between components, whatever the group's size."""
    monkeypatch.setattr(neardup, "SMALL_GROUP", 3)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base_words, r, rows = prose(7, 150).split(), np.random.default_rng(5), []
    for i in range(70):
        w = list(base_words)
        for k in r.choice(150, i % 9, replace=False):
            w[k] = f"e{i % 23}x{k}"
        rows.append((i, " ".join(w), "a"))
    d = docs(spark, rows).select(F.col("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    scratch = Scratch(spark, "test")
    sk = scratch.keep(d.mapInArrow(neardup._sketch, neardup.SKETCH))
    one = F.first(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("text_hash").alias("text_hash")))
    classes = scratch.keep(sk.groupBy(F.col("set_id").alias("rep")).agg(one.alias("one"), F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    members = scratch.keep(classes.select("rep", F.col("rep").alias("comp")))
    links = neardup.prefix_links(members, classes, d, scratch, 85)
    named = {bytes(c.rep): c.one.doc_id for c in classes.collect()}
    sets = {i: set(x.tolist()) for (i, _, _), x in zip(rows, sets_of([t for _, t, _ in rows])) if i in named.values()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in links.collect():
        a, b = named[bytes(x.a)], named[bytes(x.b)]
        assert 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
        parent[root(a)] = root(b)
    for a in sets:  # every link of brute force is inside a component
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                assert root(a) == root(b)


def test_quality(spark):
    good, bad = [(i, prose(i), "a") for i in range(40)], [(100 + i, "### &&& " * 20 + prose(i, 10), "a") for i in range(40)]
    d = docs(spark, good + bad + [(900, None, "a"), (901, "", "a")])
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _, _ in good + bad], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_fm.classify(d, labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 900]
    assert held and all(r.predicted == int(r.doc_id < 100) for r in held)
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    assert {r.score for r in quality_fm.classify(d, labels.limit(0)).collect()} == {0.5}
    again = d.union(d.where("doc_id < 120")).union(d.limit(0)).withColumn("score", F.lit("mine"))
    kept = quality_fm.accepted(again, labels)
    assert kept.columns == again.columns and {r.score for r in kept.collect()} == {"mine"} and {r.doc_id for r in kept.where("doc_id < 900").collect()} == set(range(40))
    assert quality_fm.accepted(d, labels.limit(0)).count() == d.count() and quality_fm.accepted(d, labels.where("quality = 1")).count() == d.count()
    assert quality_fm.classify(d.limit(0), labels).count() == 0


def test_sum_of_squares():
    r = np.random.default_rng(0)
    m = {"w0": 0.3, "w": r.normal(size=9), "v": r.normal(size=(9, 4))}
    idx, x = np.array([1, 4, 7]), np.array([0.5, 2.0, -1.0])
    slow = m["w0"] + m["w"][idx] @ x + sum(m["v"][idx[a]] @ m["v"][idx[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert abs(quality_fm.raw_score(m, idx, x) - slow) < 1e-9


def test_decontam(spark):
    item = "we know Tom has 3 apples and Tom gives 3 apples to Jack who lives 5 km away from the old town"
    same = item.replace("Tom", "Maria").replace("3", "15").replace("Jack", "Peter").replace("5 km", "20 km")
    mixed = "we know Maria has 15 apples and Anna gives 19 apples to Peter who lives 20 km away from the old town"
    rows = [(1, prose(1) + " " + same + " " + prose(2), "a"), (2, mixed, "a"), (3, None, "a"), (4, item.upper(), "a"), (5, prose(3), "a"), (1, prose(1) + " " + same, "a")]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (10, item)], "item_id long, text string")
    got = [(r.doc_id, r.contaminated, r["items"]) for r in decontam.decontaminate(docs(spark, rows), bench).collect()]
    # of the second document only the windows with Anna contradict; capitals are a copy in plain form
    assert sorted(x[0] for x in got if x[1]) == [1, 1, 2, 4] and all(x[2] == "7,10" for x in got if x[1])
    assert decontam.decontaminate(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(docs(spark, []), bench).count() == 0


def test_decontam_items_without_an_id(spark):
    """Items whose id is null, or there twice with other texts, are judged each by its own text."""
    items = [(None, prose(900, 30)), (None, prose(901, 30)), (3, prose(902, 30)), (3, prose(903, 30)), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, t, "a") for k, (_, t) in enumerate(items) if t] + [(9, prose(904, 60), "a"), (10, f"{items[0][1]} {items[2][1]}", "a")]
    got = {r.doc_id: (r.n_items, r["items"], r.contaminated) for r in decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert got == {0: (1, "null", True), 1: (1, "null", True), 2: (1, "3", True), 3: (1, "3", True), 9: (0, None, False), 10: (2, "null,3", True)}
    assert decontam.decontaminate(docs(spark, []), bench).count() == 0 and [r.contaminated for r in decontam.decontaminate(docs(spark, rows[:1]), bench.where("false")).collect()] == [False]


def test_decontam_contradictions(spark):
    item = "now Tom met Ann by the mill and Tom met Ann by the pond and Tom met Ann by the hill"
    mixed = "now Bob met Eve by the mill and Eve met Bob by the pond and Tim met Bob by the hill"
    sums = "a farmer sold 5 old goats and then 5 young ones for 20 euros and kept 8 goats and 9 sheep for the long winter"
    bench = spark.createDataFrame([(1, item), (2, sums)], "item_id long, text string")
    rows = [(1, mixed, "a"), (2, item.replace("Tom", "Bob").replace("Ann", "Eve"), "a"), (3, sums.replace("5 old", "7 old").replace("5 young", "9 young"), "a"), (4, sums, "a")]
    got = {r.doc_id: r["items"] for r in decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert got == {1: None, 2: "1", 3: "2", 4: "2"}


def reparameterised(r, k):
    """A question and the same one with other names, numbers and units."""
    names, units = ["Maria", "Peter", "Olga", "Ravi", "Chen", "Lena", "Omar", "Ivan"], ["km", "kg", "hours", "liters", "dollars"]
    frame = [w if r.random() > 0.16 else r.choice(["NUM", "NUM UNIT", "NAME"]) for w in prose(5000 + k, int(r.integers(18, 60))).split()]
    slots = [w for w in " ".join(frame).split() if w.isupper()]
    of = [{n: str(m) for n, m in zip(range(3), r.permutation(names)[:3])} for _ in range(2)]
    who, out = [int(r.integers(3)) for _ in slots], []
    unit = [dict(zip(range(2), r.permutation(units)[:2])) for _ in range(2)]
    for side in range(2):
        fill = iter(zip(slots, who))
        text = []
        for w in " ".join(frame).split():
            if w.isupper():
                kind, n = next(fill)
                w = str(r.integers(2, 12)) if kind == "NUM" else of[side][n] if kind == "NAME" else unit[side][n % 2]
            text.append(str(w))
        out.append("so " + " ".join(text))
    return out


def test_decontam_recall(spark):
    """Re-parameterised items, numbers drawn anew so that equal ones become different and the reverse, inside other text."""
    r = np.random.default_rng(6)
    pairs = [reparameterised(r, k) for k in range(120)]
    bench = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(pairs)], "item_id long, text string")
    rows = [(k, f"{prose(9000 + k, 80)} {b} {prose(9500 + k, 80)}", "a") for k, (_, b) in enumerate(pairs)] + [(1000 + k, prose(7000 + k, 200), "a") for k in range(60)]
    got = {x.doc_id: x["items"] for x in decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert sum(str(k) in (got[k] or "").split(",") for k in range(120)) >= 0.9 * 120
    assert all(got[1000 + k] is None for k in range(60))


def test_decontam_brute_force(spark):
    """The whole query against the definition in plain loops; the tokens come from the operator."""
    from collections import Counter

    r = np.random.default_rng(8)
    pairs = [reparameterised(r, 300 + k) for k in range(14)]
    items = [(k, a if k % 3 else " ".join(a.split()[:7])) for k, (a, _) in enumerate(pairs)] + [(50, "Count to 5 now please"), (51, "12 7"), (52, None)]
    rows = []
    for k, (a, b) in enumerate(pairs):
        cut = b.split()
        rows += [(k, f"{prose(k, 9)} {b}", "a"), (100 + k, " ".join(cut[: len(cut) // 2]), "a"), (200 + k, a.upper(), "a")]
        rows.append((300 + k, " ".join(w if q % 7 else "edit" for q, w in enumerate(cut)), "a"))
        rows.append((400 + k, " ".join(str(r.choice(["Olga", "Ravi"])) if w[:1].isupper() else w for w in cut), "a"))
    rows += [(600, "count to 9 now please", "a"), (601, "12 7", "a"), (602, "12 8", "a"), (603, None, "a"), (None, pairs[1][1], "a")]
    marks = (decontam.NUM, decontam.NAME, decontam.UNIT)
    read = lambda texts, lead: [x[0] for x in spark.createDataFrame([(lead + t if t else t,) for t in texts], "t string").select(base.words(decontam.marked(F.col("t")))).collect()]
    form = lambda toks, plain: [(t[1:] if plain else t[0]) if t[0] in marks else t for t in toks]
    bench = {}
    for (k, t), one, two in zip(items, read([t for _, t in items], ""), read([t for _, t in items], "a ")):
        if one:
            bench[k] = (one, two[1:])
    want = {}
    for (doc, _, _), toks in zip(rows, read([t for _, t, _ in rows], "")):
        hits = []
        for k, (one, two) in bench.items():
            width = min(decontam.WIDTH, len(one))
            ok = lambda w: width >= decontam.LEAST and 2 * sum(t[0] in marks for t in w) <= width  # noqa: B023, E731
            usable = {p for v in (one, two) for p in range(len(one) - width + 1) if ok(v[p : p + width])}
            counted = usable or set(range(len(one) - width + 1))
            places, typed = set(), {}
            for at in range(len(toks) - width + 1):
                if width < decontam.LEAST and len(toks) != width:
                    continue
                for p in range(len(one) - width + 1):
                    for v in (one, two):
                        w, d = v[p : p + width], toks[at : at + width]
                        if form(w, True) == form(d, True) or (ok(w) and form(w, False) == form(d, False) == [x for x in w]):
                            places.add((at - p, p))
                        elif ok(w) and form(w, False) == form(d, False):
                            typed.setdefault(at - p, set()).add((p, tuple((p + i, x, y) for i, (x, y) in enumerate(zip(w, d)) if x[0] in marks)))
                        if form(w, True) == form(d, True) and ok(w) and form(w, False) == form(d, False):
                            typed.setdefault(at - p, set()).add((p, tuple((p + i, x, y) for i, (x, y) in enumerate(zip(w, d)) if x[0] in marks)))
            for shift, ws in typed.items():
                at_ = {}
                for _, z in ws:
                    for i, x, y in z:
                        at_.setdefault((x, y), set()).add(i)
                rank = lambda side, pair: sorted((q for q in at_ if q[side] == pair[side]), key=lambda q: (-len(at_[q]), min(at_[q]))).index(pair)  # noqa: B023, E731
                wrong = {q for q in at_ if rank(1, q) or (q[0][0] != decontam.NUM and rank(0, q))}
                bad = {p for p, z in ws if any((x, y) in wrong for _, x, y in z)}
                places |= {(shift, p) for p, _ in ws if p not in bad}
            runs = [max((sum(1 for _ in iter(lambda n=iter(range(p, 10**6)): (shift, next(n)) in places, False)) for s, p in places if s == shift), default=0) for shift in {s for s, _ in places}]
            covered = {p + i for _, p in places for i in range(width)}
            if places and (len({p for _, p in places} & counted) >= decontam.COVERAGE * len(counted) or max(runs) + width - 1 >= decontam.RUN or len(covered) >= decontam.SPREAD * len(one)):
                hits.append(k)
        want[doc] = ",".join(map(str, sorted(hits))) or None
    got = {x.doc_id: x["items"] for x in decontam.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert Counter(map(bool, want.values()))[True] > 30 and got == want


def test_decontam_letter_case(spark):
    item = "we know Tom has 3 apples and Tom gives 3 apples to Jack who lives 5 km away from the old town"
    short = "What is 12 times 7 then"
    bench = spark.createDataFrame([(7, item), (8, short)], "item_id long, text string")
    rows = [(1, item.upper(), "a"), (2, item.lower(), "a"), (3, f"{prose(1)} {item.upper()} {prose(2)}", "a"), (4, prose(3), "a")]
    rows += [(5, f"Question: {short}?", "a"), (6, "Question: What is 30 times 4 then?", "a"), (7, f"so {short.upper()}", "a"), (8, "what is 9 times 5 then", "a"), (9, "What is 12 over 7 then", "a")]
    got = {r.doc_id: r["items"] for r in decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert got == {1: "7", 2: "7", 3: "7", 4: None, 5: "8", 6: "8", 7: "8", 8: "8", 9: None}


def test_decontam_excerpts_edits_and_short_items(spark):
    long, mid = prose(71, 59), prose(72, 38)
    edited = [f"edit{k}" if k in (9, 19, 28) else w for k, w in enumerate(mid.split())]
    slotted = "so Tom met Ann and Tom met Ann and then all of them went on to a very small town by the old mill"
    one_off = slotted.replace("Tom met Ann and then", "Bob met Ann and then")
    bench = spark.createDataFrame([(1, long), (2, mid), (3, "What is 12 + 7 - 5?"), (4, "Say yes"), (5, slotted)], "item_id long, text string")
    rows = [(1, f"{prose(73)} {' '.join(long.split()[10:30])} {prose(74)}", "a"), (2, f"{prose(75)} {' '.join(edited)} {prose(76)}", "a"), (3, "so: what is 12 + 7 - 5?", "a"), (4, "What is 13 + 8 - 6?", "a")]
    rows += [(5, "say YES!", "a"), (6, "they say yes", "a"), (7, " ".join(long.split()[10:22]), "a"), (8, one_off.replace("Ann", "Eve"), "a"), (None, mid, "a")]
    got = {r.doc_id: r["items"] for r in decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert got == {1: "1", 2: "2", 3: "3", 4: None, 5: "4", 6: None, 7: None, 8: "5", None: "2"}


def test_urls(spark):
    u = ["http://a.example.com/en/70", "http://b.com/en/1", "http://x.net/de/1", "http://example.net/de/88", "http://notorg/es/1", "HTTP://WWW.Q.ORG/es/?x", None, "nothing", "http://z.io/p/#f", "http://z.io/p", "http://z.io/q"]
    pages = spark.createDataFrame(list(enumerate(u)), "page_id long, url string")
    listed = spark.createDataFrame([("z.io/p",), ("z.io/p",), (None,)], "canonical string")
    got = {r.page_id: (r.rule, r.verdict, r.host) for r in urls.judge(pages, listed).collect()}
    assert [got[k][:2] for k in range(len(u))] == [
        ("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), (None, "allow"), ("org/es/", "block"),
        (None, "allow"), (None, "allow"), (None, "block"), (None, "block"), (None, "allow"),
    ]
    assert got[5][2] == "www.q.org" and got[6][2] == ""


def test_bloom_has_no_misses(spark, monkeypatch):
    listed = spark.range(500).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("canonical"), F.col("id").alias("row"))
    n = 500 // urls.PER_BLOCK
    blocks = Scratch(spark, "test").keep(urls.bloom_blocks(listed, n))
    other = spark.range(500, 5500).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("canonical"), F.col("id").alias("row"))
    for most in (urls.MOST_BLOCKS, 0):
        monkeypatch.setattr(urls, "MOST_BLOCKS", most)
        assert urls.marked(listed, blocks, n).where("possible").count() == 500
        got = urls.marked(other, blocks, n)
        assert got.where("possible").count() < 250 and got.count() == 5000


def test_urls_brute_force(spark, tmp_path):
    """The whole query, with a list beside the pages, against plain loops."""
    r = np.random.default_rng(2)
    hosts = ["a.com", "www.a.com", "b.example.com", "example.net", "c.org:80", "notcom", "x.net"]
    rows = [(int(k) if k % 7 else None, f"{['http', 'https'][k % 2]}://{r.choice(hosts)}/{r.choice(['en', 'de', 'es'])}/{r.choice([7, 8, 70, 1])}{r.choice(['', '/', '?q', '#f'])}") for k in range(400)] + [(1, None), (1, ""), (2, "x"), (2, "://")]
    spark.createDataFrame(rows, "page_id long, url string").withColumn("row", F.lit("c")).withColumn("host", F.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([("http://a.com/de/7",), ("https://c.org/en/8/",), (None,), ("nothing",), ("http://a.com/de/7",)], "url string").write.parquet(f"{tmp_path}/{urls.LIST}.parquet")

    def split(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        return (m.group(1).lower(), m.group(2)) if m else ("", "")

    want = []
    for i, u in rows:
        h, p = split(u)
        best = max(((len(rh + rp), rh + rp, v) for v, rh, rp in urls.RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)), default=None)
        c = re.sub(r":(80|443)$", "", re.sub(r"^www\.", "", h)) + p.rstrip("/")
        listed = c in ("a.com/de/7", "c.org/en/8")
        want.append((i, h, p, best and best[1], listed, best[2] if best else "block" if listed else "allow"))
    got = [tuple(x) for x in urls.url_filter(spark, str(tmp_path)).collect()]
    assert any(x[4] for x in got) and sorted(got, key=str) == sorted(want, key=str)


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "a"), (4, 1, "assistant", "c"), (4, 1, "assistant", "c"), (5, 0, None, None), (None, 0, "user", "z")]
    rows += [(6, k, "user", f"t{k}") for k in range(600)] + [(7, k, "user", f"t{k}") for k in range(300)]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat.chat_format(d).collect()
    assert {(r.conv_id, r.n_turns, r.copies) for r in got} == {(1, 2, 2), (4, 2, 1), (5, 1, 1), (None, 1, 1), (6, 600, 1)}
    assert sorted(r.block for r in got if r.conv_id == 6) == [0, 1, 2]
    assert next(r for r in got if r.conv_id == 1).rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert chat.chat_format(d.limit(0)).count() == 0


def test_chat_brute_force(spark, monkeypatch):
    """Heavy turns, null ids and many prefixes, against a plain collapse."""
    import hashlib

    monkeypatch.setattr(chat, "HEAVY", 5)
    monkeypatch.setattr(chat, "BLOCK", 4)
    r, rows = np.random.default_rng(4), []
    for c in range(60):
        n = int(r.integers(1, 14))
        rows += [(c if c % 9 else None, k if k % 5 else None, ["user", "assistant", None][k % 3], f"t{k}_{0 if k < 9 else c % 3}") for k in range(n)]
    rows += [(70, 3, "user", f"x{k}") for k in range(40)] + [(71, 3, "user", f"x{k}") for k in range(40)] + rows[:20]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("pos", F.lit(1)).withColumn("digest", F.lit("clash"))
    convs = {}
    for c, k, who, t in set(rows):
        convs.setdefault(c, set()).add((-1 if k is None else k, hashlib.md5(f"{len(who or '')}:{who or ''}{t or ''}".encode()).hexdigest(), who or "", t or ""))
    lists = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in convs.items()}
    want = set()
    for c, v in lists.items():
        same = [x for x, y in lists.items() if y == v and x is not None]
        if c == (min(same) if same else None) and not any(len(y) > len(v) and y[: len(v)] == v for y in lists.values()):
            copies = sum(y == v for y in lists.values())
            want |= {(c, b, len(v), copies, "".join(f"{chat.BEGIN}{a}\n{t}{chat.END}\n" for a, t in v[4 * b : 4 * b + 4])) for b in range(-(-len(v) // 4))}
    got = [tuple(x) for x in chat.chat_format(d).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("most", [warc.MOST_ROWS, -1])
def test_warc(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MOST_ROWS", most)
    big = "é" * 60
    rows = [(5, "u\r\nx", big), (3, None, big), (9, "v", big), (3, "w", big), (1, "s", "tiny"), (2, "s", "tiny"), (4, "n", None), (None, "q", big), (2**60 + 1, "l", "x" * 300000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(d).collect())
    assert got == [
        (0, "revisit", 3, 120), (1, "response", None, 4), (2, "response", None, 4), (3, "response", None, 120), (3, "response", None, 120),
        (4, "response", None, 0), (5, "revisit", 3, 120), (9, "revisit", 3, 120), (2**60 + 1, "response", None, 300000),
    ]
    assert warc.round_trip(d.limit(0)).count() == 0


def test_warc_rejects_damage():
    import hashlib

    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert next(warc.read_records(io.BytesIO(good + good), True))["payload"] == b"payload"
    for bad in (good[:-9], warc.record(1, "u", b"payload", "0" * 64, None)):
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(io.BytesIO(bad)))


def test_best_fit_brute_force():
    r = np.random.default_rng(3)
    items = [(int(n), 1 << int(s), 1 << int(c)) for n, s, c in zip(r.integers(1, 65, 600), r.integers(0, 6, 600), r.integers(0, 90, 600))]
    bins, plain = packing.Bins(64), []
    for n, s, c in items:
        fits = [(b[0], k) for k, b in enumerate(plain) if b[0] >= n and not b[1] & s and not b[2] & c]
        k = bins.place(n, s, c)
        if not fits:
            assert k == len(plain)
            plain.append([64 - n, s, c])
        else:
            assert plain[k][0] == min(fits)[0]  # the tightest compatible bin
            plain[k] = [plain[k][0] - n, plain[k][1] | s, plain[k][2] | c]


def test_packing(spark):
    rows = [*AWKWARD, (7, prose(7, 5000), "b")]
    got = packing.pack(docs(spark, rows), shard=4).collect()
    assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.bin_id, []).append(r)
    for b in by.values():
        assert sum(r.n_tokens for r in b) <= packing.CAPACITY
        assert len({r.source for r in b}) == len({r.cluster for r in b}) == len(b)
    assert packing.pack(docs(spark, [])).count() == 0


def test_packing_is_reproducible(spark):
    """Bins are the same however the rows are read; alike rows are dealt like others."""
    rows = [(k % 200 if k % 11 else None, prose(k % 150, 1 + (k * 37) % 60), f"s{k % 5}") for k in range(500)] + [(77, "same row again", "hot")] * 300
    d = docs(spark, rows)
    got = [sorted((tuple(r) for r in packing.pack(d.repartition(n), capacity=64, shard=128).collect()), key=repr) for n in (2, 5)]
    assert got[0] == got[1] and len(got[0]) == len(rows) and len({r[-1] >> 32 for r in got[0]}) > 4
    hot = [r for r in got[0] if r[0] == 77 and r[4] == "hot"]
    assert len(hot) == 300 and len({r[-1] for r in hot}) == 300


def test_packed_texts(spark):
    rows = [*AWKWARD, (7, prose(7, 5000), "b"), (None, "alpha beta", "a"), (5, "x y", "c"), (8, prose(8, 4096), "c")]
    d = docs(spark, rows)
    placed = packing.pack(d)
    got = {r.bin_id: r for r in packing.samples(d, placed).collect()}
    want = {}
    for r in placed.collect():
        want.setdefault(r.bin_id, []).append(r)
    assert set(got) == set(want)
    every = []
    for k, r in got.items():
        assert r.n_tokens == len(r.text.split()) == sum(x.n_tokens for x in want[k])
        every += r.text.split("\n\n")
    cut = [" ".join((t or "").split()[k : k + packing.CAPACITY]) for _, t, _ in rows for k in range(0, len((t or "").split()), packing.CAPACITY)]
    assert sorted(every) == sorted(cut)  # every text is there, whole and as often as its rows


def test_packing_brute_force(spark):
    """The whole query against a plain best fit over the same shards."""
    rows = [(k % 37 if k % 11 else None, prose(k % 50, 1 + (k * 37) % 60), f"s{k % 5}") for k in range(300)]
    got = packing.pack(docs(spark, rows), capacity=64, shard=80).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.bin_id >> 32, []).append(r)
    assert len(shards) > 2 and len(got) == len(rows)
    for pieces in shards.values():
        order = sorted(pieces, key=lambda r: (-r.n_tokens, "" if r.doc_id is None else str(r.doc_id), r.part))
        bins, used = [], {}
        for r in pieces:
            used.setdefault(r.bin_id, []).append(r)
        assert all(sum(x.n_tokens for x in b) <= 64 and len({x.source for x in b}) == len({x.cluster for x in b}) == len(b) for b in used.values())
        for r in order:
            fits = [b for b in bins if b[0] >= r.n_tokens and r.source not in b[1] and r.cluster not in b[2]]
            if fits:
                b = min(fits, key=lambda b: b[0])
                b[0] -= r.n_tokens
                b[1].add(r.source)
                b[2].add(r.cluster)
            else:
                bins.append([64 - r.n_tokens, {r.source}, {r.cluster}])
        assert abs(len(bins) - len(used)) <= 0.1 * len(bins)  # which of equally long pieces comes first may differ


def test_packing_near_copies(spark, tmp_path):
    pairs = [(prose(800 + k), prose(800 + k) + " edited") for k in range(6)]
    rows = [(None if k == 0 else k, a, "a") for k, (a, _) in enumerate(pairs)] + [(None if k == 0 else 20, b, "b") for k, (_, b) in enumerate(pairs)]
    docs(spark, [*rows, (40, None, "a"), (41, "", "b")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and len({r.cluster for r in got}) == len(pairs)
    assert len({(r.bin_id, r.cluster) for r in got}) == len(got)  # no bin has two near copies


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_pii_spans(spark):
    texts = [None, "", "a@b c@d.e x.y@z.w%q@r.s", "++1 (234) 567-8901, 1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "é𝄞 a.b@c.d " * 4, "1" * 9000, "a" * 9000 + "@" + "b." * 900 + "c"]
    got = {r.doc_id: r.spans for r in pii.report(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}

    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(d) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]

    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m.group()))


def test_pii_terms(spark):
    rows = [(i, f"{prose(i, 30)} the Falconer wrote from boss@firm.example about {prose(50 + i, 30)}", "a") for i in range(5)]
    rows += [(10 + i, f"{prose(10 + i, 30)} the about wrote from {prose(60 + i, 30)}", "a") for i in range(200)]
    rows += [(300, "Falconer, again; FALCONER?", "a"), (301, None, "a")]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in pii.report(d).collect()}
    assert got[300].spans == "term:0:8,term:17:25" and got[0].n_term == 1 and got[10].n_term == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert "boss" not in clean[0] and "Falconer" not in clean[0] and "<EMAIL>" in clean[0]
    assert clean[10] == dict((i, t) for i, t, _ in rows)[10] and clean[301] is None


def test_pii_far_and_odd_words(spark):
    """Words of any length and form, at any distance, may disclose an entity."""
    rows = [(i, f"O'Neil: {prose(i, 30)} {'x' * 400}{i} {prose(40 + i, 30)} agent47 boss@firm.example", "a") for i in range(6)]
    rows += [(10 + i, f"{prose(10 + i, 40)} {'the' if i % 2 else 'agents'}", "a") for i in range(200)] + [(300, "(Agent47/o'neil's)", "a")]
    got = {r.doc_id: r for r in pii.report(docs(spark, rows)).collect()}
    assert got[300].spans == "term:1:8" and got[0].n_term == 2 and got[10].n_term == 0 == got[10].n_secret
    assert got[0].spans.split(",")[1] == "term:0:6"


def test_pii_terms_brute_force(spark):
    """Disclosure on the whole corpus, by definition, against the spans that the query returns."""
    import math
    from collections import Counter

    r, rows = np.random.default_rng(9), []
    for i in range(260):
        extra = ["alpha beta k1@one.example", "gamma 10.0.0.7", "delta", "key 0f1e2d3c4b5a69788796a5b4c3d2e1f0 there", "alpha k2@one.example"][i % 13] if i % 13 < 5 else ""
        rows.append((i, f"{prose(r.integers(1000), 12)} {extra} {prose(r.integers(1000), 6)}", "a"))
    rows += [(400 + i, rows[0][1], "a") for i in range(9)] + [(500, None, "a"), (None, "Alpha, delta; gamma", "a")]
    every = {}
    for t in {t for _, t, _ in rows if t}:
        spans = [("email", m.group()) for m in re.finditer(PATTERNS["email"], t)] + [("ip", m.group()) for m in re.finditer(PATTERNS["ip"], t)]
        spans += [("secret", m.group()) for m in re.finditer(r"\b(?=[a-z0-9]*\d)[a-z0-9]{20,}\b", t)]
        words = t.lower()
        for _, v in spans:
            words = words.replace(v.lower(), " ")
        ents = {("value", k, v) for k, v in spans} | {("domain", v.split("@")[1]) for k, v in spans if k == "email"} | {("kind", k) for k, _ in spans}
        every[t] = (set(re.findall(r"[a-z0-9]+", words)), ents, set(re.findall(r"[a-z0-9]+", t.lower())))
    n = len(every)
    de, both, df = Counter(e for _, es, _ in every.values() for e in es), Counter(), Counter()
    for inner, es, whole in every.values():
        both.update((e, w) for e in es for w in inner)
        df.update(whole)
    rate = lambda k, e, w: 1 + math.log((k + min(0.5, de[e] / n)) / (df[w] + 1)) / -math.log(min(0.5, de[e] / n))
    want = {w for (e, w), k in both.items() if k >= pii.SUPPORT and rate(k, e, w) >= pii.GENERALISE}
    assert want
    for x, (i, t, _) in zip(sorted(pii.report(docs(spark, rows)).collect(), key=lambda x: (x.doc_id is None, x.doc_id)), sorted(rows, key=lambda x: (x[0] is None, x[0]))):
        found = {t[int(s.split(":")[1]) : int(s.split(":")[2])].lower() for s in x.spans.split(",") if s.startswith("term:")}
        assert x.doc_id == i and found == want & set(re.findall(r"[a-z0-9]+", (t or "").lower())), (i, found)


def test_components(spark):
    r = np.random.default_rng(2).permutation(40).tolist()
    links = [(r[k], r[k + 1]) for k in range(0, 40) if k % 10 != 9]
    got = neardup.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
    want = {x: min(r[k // 10 * 10 : k // 10 * 10 + 10]) for k, x in enumerate(r)}
    assert {x.rep: x.comp for x in got.collect()} == {x: y for x, y in want.items() if x != y}
    assert neardup.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_langid(spark):
    known = {"de": "der hund und die katze sind heute nicht hier", "en": "the dog and the cat are not here today", "fr": "le chien et le chat ne sont pas ici"}
    learn = spark.createDataFrame([(i, " ".join([t] * 5), k, "a", None) for i, (k, t) in enumerate(known.items())], DOCS)
    rows = [(i, "http://a.example.com/x", f"<html><p>{known['en']}</p></html>") for i in range(12)]
    rows += [
        (20, "http://b.example.net/x", f'<html lang="de"><script>the dog and the cat</script><p>{known["de"]}</p></html>'), (21, "http://c.org/fr/x", "<html></html>"),
        (22, "http://a.example.com/y", None), (22, "http://a.example.com/y", None), (23, None, ""), (None, None, None), (24, "http://d.de/", ""), (25, "http://e.org/", f'<html lang="xx">{known["fr"] * 900}</html>'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = langid.identify(pages.withColumn("lang", F.lit("zz")).withColumn("host", F.lit(1)), learn).collect()
    assert len(got) == len(rows) and all(0 < r.confidence <= 1 for r in got)
    by = {r.page_id: r for r in got}
    assert {by[k].lang for k in range(12)} == {"en"} and by[20].lang == "de" and by[25].lang == "fr"
    assert by[21].lang == "fr" and by[24].lang == "de"  # the address alone
    assert by[22].lang == "en"  # the host's prior alone
    assert langid.identify(pages.limit(0), learn).count() == 0
    unknown = langid.identify(pages, learn.limit(0)).collect()
    assert len(unknown) == len(rows) and {r.lang for r in unknown} == {None}


def test_langid_many_languages(spark):
    """No language is left out, however many there are and however rare it is."""
    names = [chr(97 + k // 26) + chr(97 + k % 26) + "x" for k in range(230)]
    learn = [(i, f"{k}a{k}b {k}c{k}d " * 9, k, "a", None) for i, k in enumerate(names)] + [(1000 + i, prose(i, 30), "en", "a", None) for i in range(1200)]
    learn = spark.createDataFrame(learn, DOCS)
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # some partitions have no language
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert langid.train(learn.where("lang = 'en'"))[0] == ["en"]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    langs, logp = langid.train(learn, per_lang=20)
    assert langs == sorted([*names, "en"]) and logp.shape == (231, langid.BUCKETS)
    pages = spark.createDataFrame([(i, None, f"<p>{k}a{k}b {k}c{k}d {k}a{k}b</p>") for i, k in enumerate(names) if i % 23 == 0], "page_id long, url string, html string")
    assert all(r.lang == names[r.page_id] for r in langid.identify(pages, learn).collect())


def test_langid_brute_force(spark):
    langs = ["de", "en"]
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.x.com/", f"<p>{'der' if i % 2 else 'the'} {prose(i, 1 + i % 4)}</p>") for i in range(24)], "page_id long, url string, html string")
    learn = spark.createDataFrame([(1, "der die das und " + prose(1, 9), "de", "a", None), (2, "the and of it " + prose(2, 9), "en", "a", None)], DOCS)
    names, logp = langid.train(learn)
    assert names == langs
    votes, raw, hosts = [], [], []
    for p in sorted(pages.collect()):
        c = langid.trigrams(re.sub("<[^>]*>", " ", p.html))
        z = logp.astype(float) @ c * (min(c.sum(), langid.TEMPER) / max(c.sum(), 1))
        raw.append(z)
        votes.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        hosts.append(p.page_id % 3)
    votes = np.array(votes)
    corpus = (votes.sum(0) + 1) / (votes.sum() + 2)
    domain = (votes.sum(0) + langid.KAPPA_DOMAIN * corpus) / (votes.sum() + langid.KAPPA_DOMAIN)
    for row in langid.identify(pages, learn).collect():
        i = row.page_id
        rest = votes[[k for k in range(24) if hosts[k] == hosts[i] and k != i]].sum(0)
        prior = (rest + langid.KAPPA_HOST * domain) / (rest.sum() + langid.KAPPA_HOST)
        z = raw[i] + np.log(prior)
        post = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert row.lang == langs[int(post.argmax())] and abs(row.confidence - post.max()) < 1e-5
