"""The network API: a table of ties, and networks conditioned on it. Every step returns a new object."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, flows, graph, measures, queries

#: Radius that stands for a whole network.
UNBOUNDED = 1000
#: An ego net of at most so many steps from so many words is searched from the inside out; others are cut from the whole network.
SEARCH_DEPTH, SEARCH_WORDS = 5, 5
#: The same for networks of words that occur together, which are denser.
CONTEXT_DEPTH = 2


@dataclass(frozen=True)
class ConditionedNetwork:
    """Edges (src, dst, weight, ...) with what they were conditioned on."""

    edges: DataFrame
    network: Network
    meta: dict = field(default_factory=dict)

    def _with(self, edges: DataFrame, **meta) -> ConditionedNetwork:
        return replace(self, edges=edges, meta={**self.meta, **meta})

    @property
    def nodes(self) -> DataFrame:
        """(id, token): the ends of the edges; of a whole network all words, isolated ones too."""
        n = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst"))
        if self.meta.get("tokens") is None:
            n = n.union(self.network.words.select("token_id"))
        n = n.distinct()
        return n.join(self.network.words.select(F.col("token_id").alias("id"), "token"), "id", "left")

    def __getitem__(self, tokens) -> DataFrame:
        """Neighbours of a token or a list of tokens."""
        return self.edges.where(F.col("src").isin(*self.network.ids(tokens)))

    def reverse(self) -> ConditionedNetwork:
        return self._with(graph.reverse(self.edges), reverse=not self.meta.get("reverse", False))

    def symmetric(self, technique: str = "avg-sym") -> ConditionedNetwork:
        return self._with(graph.symmetrise(self.edges, technique), symmetric=technique)

    def compositional(self) -> ConditionedNetwork:
        if self.meta.get("compositional"):
            return self
        return self._with(graph.compositional(self.edges, queries.occurrences(self.network.ties, times=self.meta.get("times"))), compositional=True)

    def norm(self, by: str = "sequences") -> ConditionedNetwork:
        return self._with(graph.scaled(self.edges, queries.sequence_count(self.network.ties, self.meta.get("times")), by), norm=by)

    def sparsify(self, percent: float = 99) -> ConditionedNetwork:
        return self._with(graph.sparsify(self.edges, percent), sparsify=percent)

    def back_out(self, decay: float | None = None, method: str = "invert") -> ConditionedNetwork:
        return self._with(graph.back_out(self.edges, decay, method), backout=True)

    def back_out_rows(self, tokens, decay: float | None = None) -> ConditionedNetwork:
        """Indirect ties of some words, in a network of any size; directed."""
        focal = self.network.ties.sparkSession.createDataFrame([(i,) for i in self.network.ids(tokens)], "id int")
        return self._with(graph.back_out_rows(self.edges, focal, decay), backout=True)

    def merge_plurals(self) -> ConditionedNetwork:
        return self._with(graph.merge_nodes(self.edges, graph.plural_pairs(self.nodes)))

    def proximities(self, tokens=None, alters=None) -> DataFrame:
        ids = self.network.ids
        return measures.proximity(self.edges, None if tokens is None else ids(tokens), None if alters is None else ids(alters))

    def centralities(self, names=("PageRank", "normedPageRank", "local_clustering", "weighted_local_clustering", "frequency"), tokens=None) -> DataFrame:
        """(measure, token_id, value)"""
        e, out = self.edges, None
        ranks = measures.pagerank_any(e) if {"PageRank", "normedPageRank"} & set(names) else None
        for name in names:
            if name == "PageRank":
                df = ranks.select("node", F.col("pagerank").alias("value"))
            elif name == "normedPageRank":
                df = ranks.select("node", F.col("normed").alias("value"))
            elif name in ("local_clustering", "weighted_local_clustering"):
                df = measures.local_clustering(e, name.startswith("weighted")).withColumnRenamed("clustering", "value")
            elif name in ("frequency", "freq", "frequencies"):
                df = queries.occurrences(self.network.ties, times=self.meta.get("times")).select(F.col("token_id").alias("node"), F.col("freq").alias("value"))
                df = self.nodes.select(F.col("id").alias("node")).join(df, "node", "left").fillna(0.0)
            elif name in ("flow_betweenness", "rev_flow_betweenness"):
                df = getattr(flows, name)(e)
            elif name in ("constraint", "effective_size"):
                df = getattr(measures, name)(e).withColumnRenamed(name, "value")
            else:
                raise AttributeError(f"unknown measure {name!r}")
            df = df.select(F.lit(name).alias("measure"), F.col("node").cast("long").alias("token_id"), "value")
            out = df if out is None else out.unionByName(df)
        return out if tokens is None else out.where(F.col("token_id").isin(*self.network.ids(tokens)))

    def cluster(self, levels: int = 1, algorithm: str | Callable = "louvain", interest=None) -> DataFrame:
        """(name, parent, level, node)"""
        e = self.edges if self.meta.get("symmetric") or algorithm == cluster.DIRECTED else graph.symmetrise(self.edges)
        return cluster.hierarchy(e.select("src", "dst", "weight"), levels, algorithm, None if interest is None else self.network.ids(interest))

    def file_name(self, prefix: str = "network") -> str:
        """Type, ego tokens (first and last of more than three), years and options."""
        egos = [str(x) for x in self.meta.get("tokens") or []]
        ego = "EGO-" + "-".join(egos if len(egos) <= 3 else (egos[0], egos[-1])) if egos else "ALL"
        start, end, _ = queries.time_stamp(self.meta.get("times"))
        years = f"{start}-{end}" if self.meta.get("times") is not None else "all"
        opts = "".join(f"_{k}" for k in ("compositional", "reverse", "symmetric") if self.meta.get(k))
        return f"{prefix}_{self.meta.get('kind', 'sub')}_{ego}_{years}{opts}"


@dataclass(frozen=True)
class Network:
    """Ties and the dictionary (token_id, token) of their words."""

    ties: DataFrame
    words: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str, words: str) -> Network:
        return cls(spark.read.parquet(path), spark.read.parquet(words))

    def register(self) -> None:
        """Views words and ties for spark.sql."""
        self.words.createOrReplaceTempView("words")
        self.ties.createOrReplaceTempView("ties")

    def __len__(self) -> int:
        return self.words.count()

    def ids(self, tokens) -> list[int]:
        """Ids of tokens or ids, one or many; unknown tokens raise LookupError."""
        given = [tokens] if isinstance(tokens, (str, int)) else list(tokens)
        names = [x for x in given if isinstance(x, str)]
        known = {r.token: r.token_id for r in self.words.where(F.col("token").isin(*names)).collect()} if names else {}
        if missing := [x for x in names if x not in known]:
            raise LookupError(f"unknown tokens: {missing}")
        return [int(known[x]) if isinstance(x, str) else int(x) for x in given]

    def times(self) -> DataFrame:
        return self.ties.select("time").distinct().orderBy("time")

    def parts_of_speech(self) -> DataFrame:
        return self.ties.select("part_of_speech").where("part_of_speech <> '.'").distinct()

    def __getitem__(self, key) -> DataFrame:
        """Substitution ties of a token, or of (token, times)."""
        tokens, times = key if isinstance(key, tuple) else (key, None)
        return queries.substitution(self.ties, self.ids(tokens), times)

    def condition(
        self, times=None, tokens=None, weight_cutoff=None, depth: int | None = None, context=None, context_mode="bidirectional", compositional=False, reverse=False,
        max_degree: int | None = None, prune_min_frequency: int | None = None, keep_only_tokens=False, post_cutoff=None, post_norm=False,
    ) -> ConditionedNetwork:
        """Aggregate substitution ties; then the ego net, keep-only, cut and norm, prune, compositional, reverse, in this order."""
        if context is None and tokens is not None and depth is not None and not keep_only_tokens:
            ids = self.ids(tokens)
            if depth == 0 or (depth <= SEARCH_DEPTH and len(ids) <= SEARCH_WORDS):
                e = self.search(ids, depth, times, weight_cutoff, max_degree)
                return self._finish(e, "sub", times, ids, UNBOUNDED, compositional, reverse, None, prune_min_frequency, False, post_cutoff, post_norm)
        if context is None:
            e = queries.substitution(self.ties, times=times, cutoff=weight_cutoff)
        else:
            e = queries.substitution_in_context(self.ties, self.ids(context), context_mode, times=times, cutoff=weight_cutoff)
        return self._finish(e, "sub", times, tokens, depth, compositional, reverse, max_degree, prune_min_frequency, keep_only_tokens, post_cutoff, post_norm)

    def search(self, ids: list[int], depth: int, times=None, weight_cutoff=None, max_degree: int | None = None):
        """Edges of the ego net of ``ids``; ties of words that aren't reached are never aggregated."""
        seeds = self.ties.sparkSession.createDataFrame([(i,) for i in ids], "id int")

        def out_edges(nodes):
            return queries.substitution(self.ties.join(nodes, F.col("sub") == F.col("id"), "left_semi"), times=times, cutoff=weight_cutoff)

        return graph.search_ego(out_edges, seeds, depth, max_degree)

    def yearly_centralities(self, names=("PageRank", "normedPageRank", "frequency"), before: int = 0, after: int = 0, reverse: bool = False, tokens=None, norm: bool = False, compositional: bool = False, symmetric: str | None = None):
        """(window, measure, token_id, value) of every year's moving window."""
        windows = queries.moving_windows(self.ties, before, after)
        out = measures.yearly_centralities(self.ties, list(names), windows, None, norm, reverse, compositional, symmetric)
        return out if tokens is None else out.where(F.col("token_id").isin(*self.ids(tokens)))

    def context_condition(self, times=None, tokens=None, weight_cutoff=None, depth=None, occurrence=False, **options) -> ConditionedNetwork:
        """Networks of words that occur together; a small ego net is searched from the inside out."""
        if tokens is not None and depth is not None and not options.get("keep_only_tokens"):
            ids = self.ids(tokens)
            if depth == 0 or (depth <= CONTEXT_DEPTH and len(ids) <= SEARCH_WORDS):
                seeds = self.ties.sparkSession.createDataFrame([(i,) for i in ids], "id int")

                def around(nodes):
                    return queries.node_context(self.ties, None, times, weight_cutoff, occurrence, nodes).select(F.col("ego").alias("src"), F.col("alter").alias("dst"), "weight")

                e = graph.search_ego(around, seeds, depth, options.pop("max_degree", None))
                return self._finish(e, "context", times, ids, UNBOUNDED, **options)
        e = queries.node_context(self.ties, None, times, weight_cutoff, occurrence).select(F.col("ego").alias("src"), F.col("alter").alias("dst"), "weight")
        return self._finish(e, "context", times, tokens, depth, **options)

    def condition_given_dyad(self, dyad_substitute=None, dyad_occurring=None, times=None, focal_tokens=None, weight_cutoff=None, depth=0, contextual_relations=False, context_mode="bidirectional", dyad_mode="substitution", normalise=False, **options) -> ConditionedNetwork:
        """Substitutions, or context relations, in the sequences of a dyad."""
        if focal_tokens is None:
            raise NotImplementedError("focal tokens are needed")
        if options.get("compositional"):
            raise NotImplementedError("dyad networks aren't compositional")
        sub, occ = (dyad_substitute, dyad_occurring) if dyad_mode == "substitution" else (dyad_occurring, dyad_substitute)
        ids = [None if x is None else self.ids(x) for x in (occ, sub)]
        if contextual_relations:
            e = queries.context_in_dyad(self.ties, None, *ids, times, weight_cutoff, context_mode, normalise)
        else:
            e = queries.substitution_in_dyad(self.ties, None, *ids, times, weight_cutoff, normalise)
        return self._finish(e, "dyad", times, focal_tokens, depth, **options)

    def _finish(self, e, kind, times, tokens, depth, compositional=False, reverse=False, max_degree=None, prune_min_frequency=None, keep_only_tokens=False, post_cutoff=None, post_norm=False) -> ConditionedNetwork:
        if max_degree is not None:
            e = graph.max_degree(e, max_degree)
        ids = None if tokens is None else self.ids(tokens)
        if ids is not None:
            seeds = self.ties.sparkSession.createDataFrame([(i,) for i in ids], "id int")
            if keep_only_tokens:
                e = graph.keep_nodes(e, seeds)
            elif depth == 0:
                e = e.join(F.broadcast(seeds), F.col("src") == F.col("id"), "left_semi")
            elif depth is not None and depth < UNBOUNDED:
                e = graph.ego_network(e, seeds, depth)
        e = graph.cut_and_norm(e, post_cutoff, post_norm)
        freq = queries.occurrences(self.ties, times=times)
        if prune_min_frequency is not None:
            e = graph.prune_frequency(e, freq, prune_min_frequency)
        out = ConditionedNetwork(e, self, {"kind": kind, "times": times, "tokens": ids})
        out = out.compositional() if compositional else out
        return out.reverse() if reverse else out

    def occurrences(self, tokens=None, times=None, cutoff=None, context=None) -> DataFrame:
        ids = lambda x: None if x is None else self.ids(x)
        return queries.occurrences(self.ties, ids(tokens), times, cutoff, ids(context))

    def dyad_context(self, occurring=None, replacing=None, with_pmi: bool = True, times=None, cutoff=None, mode="bidirectional", **options) -> DataFrame:
        ids = lambda x: None if x is None else self.ids(x)
        c = queries.dyad_context(self.ties, ids(occurring), ids(replacing), times, cutoff, mode=mode, **options)
        return queries.pointwise(c, self.ties, times, cutoff, mode) if with_pmi else c
