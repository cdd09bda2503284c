"""Profiles of clusters: what their members weigh, for which word and in which part of speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cluster, graph, measures, queries


def cluster_profile(members: DataFrame, words: DataFrame, columns: dict[str, Column], weight: str = "weight", by: list[str] = (), shown: list[str] = (), second: str | None = None, cutoff: float = 0.0, nodes: bool = True, also=None) -> DataFrame:
    """Rows of clusters, and of their members, of hierarchy (name, parent, level, node).

    ``words`` holds (by..., node, token, weight, ...), a row for each key and node.
    A member counts as near where its weight exceeds ``cutoff`` (not negative);
    clusters without a near member have no row. ``columns`` names the values to
    summarise by prefix; null values don't count, and without any the four
    figures are 0. A cluster's token joins its five heaviest near members, ties
    in the order of tokens; prom_node is the first of them, and with ``second``
    pr_token and pr_top are the same by that column. Rows of members carry the
    columns ``shown`` as node_...; in rows of clusters these are 0. The node
    ``also`` has a row in each of its clusters even where it isn't near.
    """
    if cutoff < 0:
        raise ValueError("a cutoff below 0 would count words that aren't there")
    by = list(by)
    key = [*by, "cluster_id"]
    m = members.select(F.col("name").alias("cluster_id"), "parent", "level", "node")
    size = m.groupBy("cluster_id", "parent", "level").agg(F.count("*").alias("nr_nodes"))
    j = m.select("cluster_id", "node").join(words, "node")
    near = j.where(F.col(weight) > cutoff)
    valued = j.select(*key, weight, "token", *(c.alias(f"_{p}") for p, c in columns.items()))
    rows = valued.groupBy(*key).agg(
        F.count(F.when(F.col(weight) > cutoff, 1)).alias("nr_near"), F.min(F.when(F.col(weight) > cutoff, F.struct((-F.col(weight)).alias("w"), "token"))).alias("_top"),
        *(a for p in columns for a in measures.measured(F.col(f"_{p}"), p)),
    ).where("nr_near > 0")
    rows = rows.select(*key, "nr_near", F.col("_top.token").cast("string").alias("prom_node"), *(F.coalesce(f"{p}{x}", F.lit(0.0)).alias(f"{p}{x}") for p in columns for x in measures.FIGURES))
    rows = rows.join(measures.cluster_names(near, key, weight).withColumnRenamed("name", "_name"), key).join(size, "cluster_id")
    if second is not None:
        rows = rows.join(measures.cluster_names(near, key, second).withColumnRenamed("name", "pr_token"), key)
        first = near.groupBy(*key).agg(F.min(F.struct((-F.col(second)).alias("w"), "token")).alias("_s"))
        rows = rows.join(first.select(*key, F.col("_s.token").cast("string").alias("pr_top")), key)
    out = rows.select(F.lit("Cluster").alias("type"), F.col("_name").alias("token"), *(F.lit(0.0).alias(f"node_{c}") for c in shown), *[c for c in rows.columns if c != "_name"])
    if not nodes:
        return out
    listed = near if also is None else j.where((F.col(weight) > cutoff) | (F.col("node") == also))
    each = listed.select(*key, F.col("token").cast("string").alias("token"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"node_{c}") for c in shown))
    return out.unionByName(each.join(rows.drop("_name"), key).withColumn("type", F.lit("Node")))


def focal_clusters(edges: DataFrame, words: DataFrame, focal: int, members: DataFrame, cutoff: float = 0.0) -> DataFrame:
    """Clusters by their members' proximity to a word, from it (weight) and to it (rev), with PageRank and the difference of both; the word itself is listed too."""
    there = edges.where(F.col("src") == focal).select(F.col("dst").alias("node"), F.col("weight").alias("w"), F.lit(0.0).alias("r"))
    back = edges.where(F.col("dst") == focal).select(F.col("src").alias("node"), F.lit(0.0).alias("w"), F.col("weight").alias("r"))
    tied = there.unionByName(back).groupBy("node").agg(F.sum("w").alias("weight"), F.sum("r").alias("rev"))
    rank = measures.pagerank_any(edges).select("node", F.col("normed").alias("pagerank"))
    w = words.select(F.col("token_id").alias("node"), "token").join(rank, "node").join(tied, "node", "left").fillna(0.0, ["weight", "rev"])
    w = w.withColumn("delta", F.col("weight") - F.col("rev"))
    cut = lambda c: F.when(F.col(c) > cutoff, F.col(c))
    return cluster_profile(members, w, {"": cut("weight"), "rev_": cut("rev"), "pagerank_": F.col("pagerank")}, shown=["weight", "rev", "delta", "pagerank"], second="pagerank", cutoff=cutoff, also=focal)


def extract_all_clusters(net, focal, levels: int, times=None, cutoff=None, depth: int | None = None, interest=None, algorithm="louvain", cluster_cutoff: float = 0.0, seed: int = 0, **options) -> DataFrame:
    """All levels of clusters in the network around a word, each with its members; see focal_clusters."""
    (i,) = net.ids(focal)
    e = graph.settled(net.condition(times, [i], cutoff, depth, **options).edges.select("src", "dst", "weight"))
    m = cluster.hierarchy(graph.symmetrise(e), levels, algorithm, None if interest is None else net.ids(interest), seed)
    return focal_clusters(e, net.words, i, graph.settled(m), cluster_cutoff)


def felt(cutoff: float, weight: str = "weight") -> dict[str, Column]:
    counts = F.col(weight) > cutoff
    return {"": F.when(counts, F.col(weight)), "sentiment_": F.when(counts, F.col("sentiment")), "subjectivity_": F.when(counts, F.col("subjectivity"))}


def with_all(profile: DataFrame) -> DataFrame:
    """A profile by part of speech and, as part ALL, over all of them: weights summed, sentiment and subjectivity averaged."""
    p = profile.select("part_of_speech", "e", "weight", "sentiment", "subjectivity")
    return p.unionByName(p.groupBy("e").agg(F.sum("weight").alias("weight"), F.avg("sentiment").alias("sentiment"), F.avg("subjectivity").alias("subjectivity")).withColumn("part_of_speech", F.lit("ALL")))


def _named(net, profile: DataFrame) -> DataFrame:
    return profile.join(net.words.select(F.col("token_id").alias("e"), "token"), "e").withColumnRenamed("e", "node")


def _around(e: DataFrame, words: DataFrame, depth: int) -> DataFrame:
    """Edges among words (node), or up to ``depth`` steps away from them."""
    e, seeds = graph.settled(e.select("src", "dst", "weight")), words.select(F.col("node").alias("id")).distinct()
    return graph.keep_nodes(e, seeds) if depth == 0 else graph.ego_network(e, seeds, depth)


def _context(net, substitute, occurring, times, cutoff, mode, k, value):
    ids = [None if x is None else net.ids(x) for x in (occurring, substitute)]
    near = queries.around(net.ties, *ids, times, cutoff)
    c = queries.dyad_context(near, *ids, times, cutoff, mode=mode, by_pos=True, near=True)
    c = c if value == "weight" else queries.pointwise(c, net.ties, times, cutoff, mode)
    return ids, near, graph.settled(_named(net, c if k is None else measures.role_profile(c, k, value=value)).drop("subs", "occs"))


def clustered_role_profile(net, focal, role, levels: int, times=None, cutoff=None, k: int | None = None, mode="bidirectional", depth: int = 1, algorithm="consensus_louvain", cluster_cutoff: float = 0.0, seed: int = 0) -> DataFrame:
    """Clusters of the words around a word that stands for the words of a role, by part of speech and for ALL."""
    ids, near, words = _context(net, focal, role, times, cutoff, mode, k, "weight")
    e = _around(queries.substitution_in_dyad(near, None, *ids, times, cutoff, near=True), words, depth)
    m = cluster.hierarchy(graph.symmetrise(e), levels, algorithm, words.select("node"), seed)
    w = with_all(words.withColumnRenamed("node", "e"))
    return cluster_profile(graph.settled(m), _named(net, w), felt(cluster_cutoff), by=["part_of_speech"], shown=["weight", "sentiment", "subjectivity"], cutoff=cluster_cutoff)


def context_clusters(net, substitute=None, occurring=None, levels: int = 2, per_pos: bool = False, times=None, cutoff=None, k: int | None = None, value: str = "weight", mode="bidirectional", depth: int = 1, contextual: bool = False,
                     algorithm="consensus_louvain", cluster_cutoff: float = 0.0, seed: int = 0, among=("freq", "constraint", "effective_size")) -> DataFrame:
    """Clusters of the words around a dyad.

    The ``k`` first words of each part of speech by ``value`` (weight, or a
    column of pointwise) are kept. With ``per_pos`` each part of speech has a
    network and clusters of its own (a job each; tags are few). Otherwise there
    is one network, named ALL, in which a word of several parts of speech
    stands with the heaviest, and the measures ``among`` are summarised too;
    flow_betweenness is one of them but costs a pass over all pairs a tie.
    """
    ids, near, words = _context(net, substitute, occurring, times, cutoff, mode, k, value)
    if contextual:
        ties = queries.context_in_dyad(near, None, *ids, times, cutoff, mode, near=True)
    else:
        ties = queries.substitution_in_dyad(near, None, *ids, times, cutoff, near=True)
    ties = graph.settled(ties)
    if not per_pos:
        first = Window.partitionBy("node").orderBy(F.col("weight").desc(), "part_of_speech")
        words = words.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").withColumn("part_of_speech", F.lit("ALL"))
        parts, among = ["ALL"], list(among)
    else:
        parts, among = [r[0] for r in words.select("part_of_speech").distinct().orderBy("part_of_speech").collect()], []
    out = None
    for part in parts:
        w = words.where(F.col("part_of_speech").eqNullSafe(F.lit(part)))
        e = graph.settled(_around(ties, w, depth))
        m = cluster.hierarchy(graph.symmetrise(e), levels, algorithm, w.select("node"), seed)
        w = w.join(measures.pagerank_any(e).select("node", F.col("normed").alias("pagerank")), "node", "left")
        for name in among:
            got = queries.occurrences(net.ties, times=times).select(F.col("token_id").alias("node"), "freq") if name == "freq" else getattr(measures, name)(e).withColumnRenamed("value", name)
            w = w.join(got, "node", "left")
        w = w.fillna(0.0, ["pagerank", *among])
        heavy = F.col("weight") > cluster_cutoff
        columns = {**felt(cluster_cutoff), **{f"{c}_": F.when(heavy, F.col(c)) for c in ("pagerank", *among)}}
        rows = cluster_profile(graph.settled(m), w, columns, by=["part_of_speech"], shown=["weight", "sentiment", "subjectivity", "pagerank", *[a for a in among if a == "freq"]], second="pagerank", cutoff=cluster_cutoff)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise LookupError("no words around this dyad")
    return out


def yearly_networks(t: DataFrame, times: list[int] | None = None, max_degree: int | None = None, least: int | None = None, reverse: bool = False, compositional: bool = False, technique: str | None = None) -> DataFrame:
    """(year, src, dst, weight): every year's substitution network and that of all years (year all), in one job.

    Options apply to each network by itself and in this order: the strongest
    ``max_degree`` ties of a word, words of at least ``least`` + 1 occurrences,
    compositional weights, reversal, symmetry. With ``times`` there are these
    years only, and none of all years.
    """
    t = t if times is None else t.where(F.col("time").isin(*times))
    year = F.col("time").cast("string").alias("year")
    e = t.groupBy(year, F.col("sub").alias("src"), F.col("occ").alias("dst")).agg(F.sum("weight").alias("weight"))
    f = t.groupBy(year, F.col("occ").alias("node")).agg(F.sum("weight").alias("raw"))
    if times is None:
        e = e.unionByName(e.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).withColumn("year", F.lit("all")))
        f = f.unionByName(f.groupBy("node").agg(F.sum("raw").alias("raw")).withColumn("year", F.lit("all")))
    f = f.select("year", "node", F.round("raw").alias("freq"))
    if max_degree is not None:
        order = Window.partitionBy("year", "src").orderBy(F.round("weight", 9).desc(), "dst")
        e = e.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_degree).drop("_r")
    if least is not None:
        for end in ("src", "dst"):
            e = e.join(f.where(F.col("freq") > least).select("year", F.col("node").alias(end)), ["year", end], "left_semi")
    if compositional:
        e = e.join(f.withColumnRenamed("node", "dst"), ["year", "dst"], "left").withColumn("weight", F.when(F.col("freq") > 0, F.col("weight") / F.col("freq")).otherwise(0.0))
    e = e.select("year", "src", "dst", "weight")
    e = graph.reverse(e) if reverse else e
    return e if technique is None else graph.symmetrise(e, technique, ["year"])
