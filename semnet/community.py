"""Communities of a graph in a file: ``python -m semnet.community FILE [--binary] [--algorithm NAME]``.

Prints a line ``node community`` for each node, and the modularity to the error stream.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import cluster, graph
from .sources.corpus import read_binary_graph


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="semnet.community")
    p.add_argument("file", help="lines of source, target and, where there is a third column, weight; columns parted by white space")
    p.add_argument("--binary", action="store_true", help="the file holds a binary graph")
    p.add_argument("--algorithm", default="louvain", choices=sorted(cluster.ALGORITHMS))
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.binary:
        # each link is held at both ends
        edges = read_binary_graph(spark, a.file).where("src <= dst").withColumn("weight", F.lit(1.0))
    else:
        w = F.split(F.trim("value"), r"\s+")
        rows = spark.read.text(a.file).where(F.trim("value") != "").select(w.alias("w"))
        edges = rows.select(*(F.col("w")[k].cast("long").alias(c) for k, c in enumerate(("src", "dst"))), F.coalesce(F.get("w", F.lit(2)).cast("double"), F.lit(1.0)).alias("weight"))
    edges = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    part = graph.settled(cluster.cluster_edges(edges, algorithm=a.algorithm))
    print(cluster.modularity(edges, part).first()[0], file=sys.stderr)
    for r in part.orderBy("node").toLocalIterator():
        print(r["node"], r["cluster"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
