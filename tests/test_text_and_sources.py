import pytest
from pyspark.sql import functions as F

from semnet.functions import text
from semnet.operators import cluster, graph, measures, ties
from semnet.sources import corpus


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("o")).first().o


def test_clean(spark):
    assert one(spark, "12 A  (good)\n leader 123456 x9", lambda c: text.clean(c)) == " A good leader  x"
    assert one(spark, "<p>a &lt; b</p>", text.strip_tags) == "a < b"
    assert one(spark, "<p>a<script>x</script> &eacute;</p>", text.html_text) == "ax é"


def test_chunks(spark):
    assert one(spark, "A b c. D e", lambda c: text.word_chunks(c, 3)) == ["a b c.", "d e."]
    assert one(spark, "abcdefgh", lambda c: text.halve(c, F.lit(3))) == ["ab", "cd", "ef", "gh"]
    assert one(spark, "One. Two! Three?", text.sentences) == ["One.", "Two!", "Three?"]
    assert one(spark, "aa bb cc", lambda c: text.trim_words(c, 6)) == "aa bb"


def test_ids(spark):
    known = spark.createDataFrame([("b", 4)], "token string, token_id long")
    got = text.assign_ids(spark.createDataFrame([("a",), ("b",), ("c",)], "token string"), known)
    assert {tuple(r) for r in got.collect()} == {("b", 4), ("a", 5), ("c", 6)}


def test_folders(spark, tmp_path):
    for name in ("2020/vol1.txt", "1999/vol1.txt", "notes/x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"A good leader is a good communicator.\xff")
    files = corpus.read_text_tree(spark, str(tmp_path))
    got = corpus.folder_per_year(files)
    assert {(r.year, r.filename, r.text) for r in got.collect()} == {(y, "vol1", "A good leader is a good communicator.") for y in (2020, 1999)}
    flat = files.limit(1).withColumn("filename", F.lit("2001_a_b"))
    assert [tuple(r) for r in corpus.flat_folder(flat).select("year", "parameters").collect()] == [(2001, ["a", "b"])]


def test_tie_store(spark, tmp_path):
    path = str(tmp_path / "ties")
    t = spark.createDataFrame([(y, r, 1, 2, 3, 0.5) for y in (1, 2) for r in (1, 2)], "time int, run_index long, pos int, occ int, sub int, weight double")
    corpus.write_ties(t, path)
    corpus.write_ties(t.where("time = 2 and run_index = 1"), path)
    assert {(r.time, r["count"]) for r in spark.read.parquet(path).groupBy("time").count().collect()} == {(1, 2), (2, 1)}
    corpus.delete_times(spark, path, [1])
    assert spark.read.parquet(path).count() == 1
    m = corpus.Manifest(spark, str(tmp_path / "done"))
    assert not m.done("a")
    m.mark("a")
    assert m.done("a") and not m.done("b")


def test_tie_invariants(spark):
    tokens = spark.createDataFrame([(d, i, w) for d, s in enumerate(["a b c d", "a x c d", "a b c e", "z b c d"]) for i, w in enumerate(s.split())], "run_index long, pos int, token string")
    t = ties.text_ties(tokens)
    assert all(r.s <= 1 + 1e-9 for r in t.groupBy("run_index", "pos").agg(F.sum("weight").alias("s")).collect())
    assert {(r.sub, round(r.weight, 6)) for r in t.where("run_index = 0 and pos = 1").collect()} == {("b", 0.666667), ("x", 0.333333)}


def test_stream(spark, tmp_path):
    from semnet.sources.store import Store
    from semnet.streaming.ingest import ingest

    kind = "time int, run_index long, pos int, occ int, sub int, weight double"

    def arrive(*rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = ingest(spark, str(tmp_path / "in"), kind, lambda b: b, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        return sorted((r.run_index, r.weight) for r in Store(spark, str(tmp_path / "out")).read().collect())

    assert arrive((1, 1, 1, 2, 3, 0.5)) == [(1, 0.5)]
    # a second file of the same year adds to it; a tie that is there is kept
    assert arrive((1, 2, 1, 2, 3, 0.25), (1, 1, 1, 2, 3, 0.75)) == [(1, 0.5), (2, 0.25)]


def test_row_rules(spark):
    rows = spark.createDataFrame([(0, "x"), (1, "‘a’ – is it? yes"), (2, "one two three four"), (3, "done.")], "k int, t string")
    got = {r.k: r.t for r in text.row_rules(rows, "t", 18).collect()}
    assert got == {1: "'a' - is it ?  yes.", 2: "one two three.", 3: "done."}
    assert [r.t for r in text.drop_short(rows, "t", 6).collect()] == ["‘a’ – is it? yes", "one two three four"]
    ids = spark.range(1).select(text.padded(F.array(F.lit(7), F.lit(8)), 6, 1, 2, 0).alias("a"), text.padded(F.array(*(F.lit(k) for k in range(9))), 5, 1, 2, 0).alias("b")).first()
    assert ids.a == [1, 7, 8, 2, 0, 0] and ids.b == [1, 0, 1, 2, 2]


def test_clean_v1(spark):
    row = spark.createDataFrame([("12 He said 'no' .<p>Then (x) , 5\nand... \"ok\" 7",)], "t string").select(text.clean_v1(F.col("t")).alias("t")).first()
    assert row.t == " He said ' no'. Then x , 5 and. ok "


def test_subcorpora(spark, tmp_path):
    from semnet.sources.store import Store

    rows = spark.createDataFrame([(k, 1999 + k % 2, "ab"[k % 3 == 0]) for k in range(12)], "run_index long, year int, p1 string")
    built = []

    def build(part):
        built.append(part.count())
        return part.select(F.col("year").alias("time"), "run_index", F.lit(1).alias("pos"), F.lit(2).alias("occ"), F.lit(3).alias("sub"), "p1")

    store = Store(spark, f"{tmp_path}/ties")
    assert len(corpus.process_subcorpora(rows, ["year", "p1"], build, store, {"year": "time"})) == 4 and sum(built) == 12
    assert store.read().count() == 12
    assert corpus.process_subcorpora(rows, ["year", "p1"], build, store, {"year": "time"}) == []
    which = corpus.split_condition({"year": 1999, "p1": "b"}, {"year": "time"})
    n = store.read().where(which).count()
    assert n and store.delete(which) == n and store.read().count() == 12 - n
    # an attempt that left a part behind, without a mark, is done anew, without doubled rows
    again = Store(spark, f"{tmp_path}/again")
    again.append(build(rows.where("year = 1999 and p1 = 'b'").limit(1)))
    assert len(corpus.process_subcorpora(rows, ["year", "p1"], build, again, {"year": "time"})) == 4
    assert sorted(r.run_index for r in again.read().collect()) == list(range(12))


def test_split_values(spark, tmp_path):
    """Values of a hierarchy may hold any characters, or be null."""
    from semnet.sources.store import Store

    values = ["a(b)", "a", "x & y", "(source == a)", "it's \"q\"", "", None, "a\\b"]
    rows = spark.createDataFrame([(k, 1, 1, 2, 3, v) for k, v in enumerate(values)], "run_index long, time int, pos int, occ int, sub int, source string")
    store = Store(spark, f"{tmp_path}/ties")
    store.append(rows)
    for k, v in enumerate(values):
        assert [r.run_index for r in rows.where(corpus.split_condition({"source": v})).collect()] == [k]
    assert store.delete(corpus.split_condition({"source": "a(b)"})) == 1
    assert sorted(r.run_index for r in store.read().collect()) == list(range(1, len(values)))
    other = Store(spark, f"{tmp_path}/other")
    assert len(corpus.process_subcorpora(rows, ["source"], lambda part: part, other)) == len(values)
    assert other.read().count() == len(values)
    assert corpus.split_hierarchy(rows, ["source"]).where("query is null or name is null").count() == 0
    many = spark.createDataFrame([("1999" + "".join(f"_p{i}" for i in range(150)),)], "filename string")
    assert len(corpus.flat_folder(many).first().parameters) == 150


def test_refusals(spark, monkeypatch):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "src int, dst int, weight double")
    with pytest.raises(NotImplementedError):
        cluster.cluster_edges(e, algorithm="infomap")
    monkeypatch.setattr(cluster, "MOST_EDGES", 1)
    with pytest.raises(ValueError):
        cluster.cluster_edges(e, algorithm="map_equation")
    large = cluster.cluster_edges(e)  # Louvain of a larger graph goes by joins
    assert len({r.cluster for r in large.collect()}) == 1 and dict(large.dtypes)["cluster"] == "bigint"
    monkeypatch.setattr(graph, "DENSE_NODES", 2)
    near = {r.node: r.pagerank for r in measures.pagerank_any(e).collect()}
    monkeypatch.undo()
    for r in measures.pagerank_any(e).collect():
        assert abs(near[r.node] - r.pagerank) < 1e-4
