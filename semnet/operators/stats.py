"""Numerics over tables of observations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def barycentric(weights: DataFrame, coords: DataFrame, obs: str, cluster: str, value: str, k: int | None = None) -> DataFrame:
    """(obs, x, y): observations at the weighted mean of their ``k`` heaviest clusters' coordinates (cluster, x, y)."""
    if k is not None:
        w = Window.partitionBy(obs).orderBy(F.col(value).desc(), cluster)
        weights = weights.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    j = weights.join(coords, cluster)
    s = F.sum(value)
    return j.groupBy(obs).agg((F.sum(F.col(value) * F.col("x")) / s).alias("x"), (F.sum(F.col(value) * F.col("y")) / s).alias("y"))


def histogram_2d(points: DataFrame, x: str, y: str, weight: str, bins: int, low: float, high: float) -> DataFrame:
    """(bx, by, density): weighted cells of [low, high]^2; the last bin holds its upper end."""
    cell = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - low) * bins / (high - low))).cast("int")
    p = points.where(F.col(x).between(low, high) & F.col(y).between(low, high))
    h = p.groupBy(cell(x).alias("bx"), cell(y).alias("by")).agg(F.sum(weight).alias("w"))
    total = h.agg(F.sum("w").alias("_t"))
    area = ((high - low) / bins) ** 2
    return h.join(F.broadcast(total), F.lit(True)).select("bx", "by", (F.col("w") / F.col("_t") / area).alias("density"))


def year_differences(rows: DataFrame, year: str, value: str, by: list[str] = ()) -> DataFrame:
    """Differences to one, two and three years before, their mean, and the difference to the first year."""
    w = Window.partitionBy(*by).orderBy(year)
    out = rows
    for k in (1, 2, 3):
        out = out.withColumn(f"d{k}", F.col(value) - F.lag(value, k).over(w))
    return out.withColumn("d_mean", (F.col("d1") + F.col("d2") + F.col("d3")) / 3).withColumn("from_first", F.col(value) - F.first(value).over(w))


def yearly_l2(rows: DataFrame, year: str, dim: str, value: str) -> DataFrame:
    """(year, l2): distance of each year's vector (dim, value) from the year before; absent entries are 0."""
    years = rows.select(year).distinct()
    nxt = years.withColumn("_next", F.lead(year).over(Window.orderBy(year)))
    cur = rows.select(F.col(year).alias("at"), dim, F.col(value).alias("v"), F.lit(1.0).alias("sign"))
    prev = rows.join(F.broadcast(nxt), year).where("_next is not null").select(F.col("_next").alias("at"), dim, F.col(value).alias("v"), F.lit(-1.0).alias("sign"))
    first = years.agg(F.min(year).alias("_first"))
    d = cur.union(prev).groupBy("at", dim).agg(F.sum(F.col("v") * F.col("sign")).alias("d"))
    return d.join(F.broadcast(first), F.lit(True)).where("at > _first").groupBy(F.col("at").alias(year)).agg(F.sqrt(F.sum(F.col("d") ** 2)).alias("l2"))


def sliding_sum(rows: DataFrame, year: str, value: str, back: int, by: list[str] = ()) -> DataFrame:
    """Sum over the years from ``back`` before to the year itself."""
    w = Window.partitionBy(*by).orderBy(year).rangeBetween(-back, 0)
    return rows.withColumn("window_sum", F.sum(value).over(w))


def explained_share(rows: DataFrame, year: str, group: str, value: str, back: int = 5) -> DataFrame:
    """(year, group, share): a group's part of the variation in each sliding window."""
    g = rows.groupBy(year, group).agg(F.sum(value).alias("v"))
    g = sliding_sum(g, year, "v", back, [group])
    return g.select(year, group, (F.col("window_sum") / F.sum("window_sum").over(Window.partitionBy(year))).alias("share"))


def rolling_r2(rows: DataFrame, year: str, x: str, y: str, back: int = 5) -> DataFrame:
    """(year, n, r2): squared correlation in each window of years, from sums of moments per year."""
    m = rows.groupBy(year).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.sum(F.col(x) * F.col(y)).alias("sxy")
    )
    w = Window.orderBy(year).rangeBetween(-back, 0)
    m = m.select(year, *(F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    return m.select(year, "n", F.when((vx > 0) & (vy > 0), cov * cov / (vx * vy)).alias("r2"))


def ols_hc1(rows: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, coef, stderr, r2): least squares with heteroscedasticity-robust errors, from two passes of sums."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    target = F.col(y).cast("double")
    k = len(cols)
    sums = [F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k)] + [F.sum(c * target) for c in cols] + [F.count("*"), F.sum(target), F.sum(target * target)]
    got = [float(v or 0) for v in rows.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
    a, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = got[at]
            at += 1
    inv = np.linalg.pinv(a)
    beta = inv @ np.array(got[at : at + k])
    n, sy, syy = got[at + k :]
    fitted = sum((c * float(b) for c, b in zip(cols[1:], beta[1:])), cols[0] * float(beta[0]))
    e2 = (target - fitted) * (target - fitted)
    second = [float(v or 0) for v in rows.agg(*(F.sum(cols[i] * cols[j] * e2).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)), F.sum(e2).alias("rss")).first()]
    meat, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = second[at]
            at += 1
    cov = inv @ meat @ inv * n / max(1, n - k)
    r2 = 1 - second[-1] / (syy - sy * sy / n) if n else float("nan")
    names = ["const", *xs]
    return rows.sparkSession.createDataFrame([(names[i], float(beta[i]), float(np.sqrt(max(0, cov[i, i]))), float(r2)) for i in range(k)], "term string, coef double, stderr double, r2 double")


def kernel_pca(kernel: np.ndarray, dims: int = 2) -> np.ndarray:
    """Coordinates from a precomputed kernel: centred, leading eigenvectors scaled by roots of their values, largest entry positive."""
    n = len(kernel)
    j = np.eye(n) - 1 / n
    val, vec = np.linalg.eigh(j @ kernel @ j)
    top = np.argsort(val)[::-1][:dims]
    x = vec[:, top] * np.sqrt(np.maximum(val[top], 0))
    return x * np.sign(x[np.abs(x).argmax(0), range(x.shape[1])])


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull, counter-clockwise from the lowest left, by monotone chains."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(p[::-1])


def joint_probability(rows: DataFrame, year: str, p: str, ctx: str) -> DataFrame:
    return rows.groupBy(year).agg((F.sum(F.col(ctx) * F.col(p)) / F.sum(p)).alias("joint"))


def forest(rows: DataFrame, y: str, xs: list[str], seed: int = 0, trees: int = 50):
    """A random forest over assembled columns, and its training frame."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    v = VectorAssembler(inputCols=xs, outputCol="features").transform(rows)
    return RandomForestRegressor(featuresCol="features", labelCol=y, numTrees=trees, seed=seed).fit(v), v


def discretise(rows: DataFrame, column: str, out: str, buckets: int = 4) -> DataFrame:
    from pyspark.ml.feature import QuantileDiscretizer

    return QuantileDiscretizer(numBuckets=buckets, inputCol=column, outputCol=out).fit(rows).transform(rows)
