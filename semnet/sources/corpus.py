"""Readers and writers: text folders, sentence files, graph exports, binary graphs, manifests."""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Callable, Iterator
from xml.sax.saxutils import quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store

SENTENCES = "filename string, year string, parameters array<string>, sentence string, index long, year_index long, file_index long"


def read_text_tree(spark: SparkSession, root: str, encoding_errors: str = "ignore") -> DataFrame:
    """(path, folder, filename, text) of all .txt files below ``root``; bytes that aren't UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(root)
    text = F.decode(F.col("content"), "UTF-8") if encoding_errors == "strict" else F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("folder"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("filename"), text.alias("text"))


def folder_per_year(files: DataFrame) -> DataFrame:
    """Folders with a numeric name of zero or more are years."""
    return files.where(F.col("folder").rlike(r"^\d+$")).withColumn("year", F.col("folder").cast("int"))


def flat_folder(files: DataFrame, symbol: str = "_", exclude: list[str] = ()) -> DataFrame:
    """The year is the first part of a file's name, the rest are parameters; names that begin with w are reversed first."""
    parts = F.split("filename", f"\\Q{symbol}\\E")
    parts = F.when(parts[0] == "w", F.reverse(parts)).otherwise(parts)
    out = files.withColumn("_p", parts).withColumn("year", F.col("_p")[0].cast("int")).withColumn("parameters", F.slice("_p", F.lit(2), F.size("_p"))).drop("_p")
    return out.where(~F.arrays_overlap("parameters", F.array(*map(F.lit, exclude)))) if exclude else out


def write_sentences(sentences: DataFrame, path: str, rows_per_file: int = 20_000) -> None:
    sentences.write.mode("overwrite").partitionBy("year").option("maxRecordsPerFile", rows_per_file).json(path)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SENTENCES).json(path)


def corpus_metadata(sentences: DataFrame, rows_per_file: int = 20_000) -> DataFrame:
    return sentences.groupBy("year").agg(F.count("*").alias("len_year")).withColumn("json_files", F.ceil(F.col("len_year") / rows_per_file))


def train_validation(rows: DataFrame, key: str, seed: int = 0, percent: int = 10) -> DataFrame:
    """Add ``validation``: a split by hash, the same on every run."""
    return rows.withColumn("validation", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100)) < percent)


def split_hierarchy(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct combinations, with a name and a predicate for each; both are for reading, ``split_condition`` selects the rows."""
    d = rows.select(*columns).distinct()
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns}
    each = [F.concat(F.lit(f"({c} == "), text[c], F.lit(")")) for c in columns]
    return d.withColumn("name", F.concat_ws("-", *text.values())).withColumn("query", F.concat_ws(" & ", *each))


def split_condition(values: dict, rename: dict[str, str] | None = None) -> Column:
    """Rows that have these values, whatever characters are in them; null is equal to null. Columns are renamed as told."""
    names, out = rename or {}, F.lit(True)
    for name, value in values.items():
        out = out & F.col(f"`{names.get(name, name)}`").eqNullSafe(F.lit(value))
    return out


def write_ties(ties: DataFrame, path: str, merge: bool = False) -> None:
    """Replace the time partitions that ``ties`` has and no others; ``merge`` drops repeated ties."""
    rows = ties.dropDuplicates(["time", "run_index", "pos", "occ", "sub"]) if merge else ties
    rows = rows.repartition("time", F.pmod("run_index", F.lit(64))).sortWithinPartitions("time", "run_index", "pos")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("time").parquet(path)


def delete_times(spark: SparkSession, path: str, times: list[int] | None = None) -> None:
    """Drop whole partitions, all of them without ``times``."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    top = fs_path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for d in [top] if times is None else [fs_path(f"{path}/time={t}") for t in times]:
        fs.delete(d, True)


def process_subcorpora(rows: DataFrame, columns: list[str], build: Callable[[DataFrame], DataFrame], store: Store, rename: dict[str, str] | None = None) -> list[str]:
    """Run ``build`` (rows of a split to ties) for every split that the store hasn't marked as done, in order; the names of those run.

    A split's ties, the removal of what there was of it and its mark are one
    change of the store. Splits are few: each is a whole job over its rows.
    """
    ran = []
    for r in split_hierarchy(rows, columns).orderBy("name").collect():
        values = {c: r[c] for c in columns}
        step = json.dumps(["subcorpus", *([c, None if v is None else str(v)] for c, v in values.items())])
        if not store.done(step):
            store.replace(split_condition(values, rename), build(rows.where(split_condition(values))), step)
            ran.append(r["name"])
    return ran


def prune_words(words: DataFrame, ties: DataFrame) -> DataFrame:
    used = ties.select(F.col("occ").alias("token_id")).union(ties.select("sub")).distinct()
    return words.join(used, "token_id", "left_semi")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.md5("content").alias("md5"))


class Manifest:
    """Steps that have been done, by the md5 of their name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def done(self, step: str) -> bool:
        try:
            return not self.spark.read.parquet(self.path).where(F.col("key") == F.md5(F.lit(step))).isEmpty()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
                return False
            raise

    def mark(self, step: str) -> None:
        row = self.spark.range(1).select(F.md5(F.lit(step)).alias("key"), F.lit(step).alias("step"), F.lit(datetime.datetime.now(datetime.UTC).isoformat()).alias("at"))
        row.write.mode("append").parquet(self.path)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str, most: int = 2_000_000) -> None:
    """A GEXF file of a conditioned network, which is small; a larger one is refused, not cut."""
    if edges.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} ties; write them as Parquet or CSV")
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="directed">\n<nodes>\n')
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        for r in nodes.join(ends, "id", "left_semi").orderBy("id").toLocalIterator():
            f.write(f'<node id="{r["id"]}" label={quoteattr(str(r["token"]))}/>\n')
        f.write("</nodes>\n<edges>\n")
        for k, r in enumerate(edges.orderBy("src", "dst").toLocalIterator()):
            f.write(f'<edge id="{k}" source="{r["src"]}" target="{r["dst"]}" weight="{r["weight"]}"/>\n')
        f.write("</edges>\n</graph></gexf>\n")


def write_edge_list(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    a, b = (nodes.select(F.col("id").alias(s), F.col("token").alias(f"{s}_token")) for s in ("src", "dst"))
    edges.join(a, "src").join(b, "dst").select("src_token", "dst_token", "weight").write.mode("overwrite").csv(path, header=True)


def write_yearly(nodes: DataFrame, yearly: DataFrame, path: str, gexf: str | None = None) -> None:
    """Edge lists of yearly networks (year, src, dst, weight), a folder each; ``gexf`` names a local folder for a GEXF file of each."""
    a, b = (nodes.select(F.col("id").alias(s), F.col("token").alias(f"{s}_token")) for s in ("src", "dst"))
    yearly.join(a, "src").join(b, "dst").select("year", "src_token", "dst_token", "weight").write.mode("overwrite").partitionBy("year").csv(path, header=True)
    if gexf is not None:
        os.makedirs(gexf, exist_ok=True)
        for r in yearly.select("year").distinct().orderBy("year").collect():  # one row per year
            write_gexf(nodes, yearly.where(F.col("year") == r["year"]), f"{gexf}/{r['year']}.gexf")


def write_pickle(rows: DataFrame, path: str, most: int = 1_000_000) -> None:
    """A pickled frame of a result, such as the rows of clusters; more than ``most`` rows are refused, not cut."""
    got = rows.limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"more than {most} rows; write them as Parquet")
    got.to_pickle(path)


def violations(ties: DataFrame, words: DataFrame) -> DataFrame:
    """(rule, n): how often a store breaks each of its rules; rules that hold are there with 0."""

    def repeated(df: DataFrame, rule: str, *key: str) -> DataFrame:
        return df.groupBy(*key).agg(F.count("*").alias("k")).agg(F.lit(rule).alias("rule"), F.count(F.when(F.col("k") > 1, 1)).alias("n"))

    def counted(df: DataFrame, rule: str) -> DataFrame:
        return df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))

    used = ties.select(F.col("occ").alias("token_id")).union(ties.select("sub")).distinct()
    none = F.lit(False)
    for c in ("time", "run_index", "pos", "occ", "sub", "weight"):
        none = none | F.col(c).isNull()
    checks = [
        repeated(words, "token_id is unique", "token_id"), repeated(words, "token is unique", "token"), repeated(ties, "tie is unique", "time", "run_index", "pos", "occ", "sub"),
        repeated(ties.select("run_index", "time").distinct(), "sequence has one time", "run_index"), counted(ties.where(none), "tie is complete"),
        counted(used.join(words, "token_id", "left_anti"), "word is known"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for raw in b["content"]:
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            ends = np.frombuffer(raw, "<u8", n, 4).astype(np.int64)
            links = np.frombuffer(raw, "<u4", int(ends[-1]) if n else 0, 4 + 8 * n)
            yield pd.DataFrame({"src": np.repeat(np.arange(n), np.diff(ends, prepend=0)), "dst": links.astype(np.int64)})


def read_binary_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst): node count (u32), cumulative degrees (u64), links (u32), little-endian."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_links, "src long, dst long")


def read_partition_predicate(spark: SparkSession, path: str, predicate: Column | str) -> DataFrame:
    """A predicate on partition columns prunes folders, one on others is pushed to the scan."""
    return spark.read.parquet(path).where(predicate)
