"""Quality classifier: a factorisation machine.

A document is a sparse vector of hashed words and hashed buckets of structure
statistics and metadata (its length).  Its raw score is

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)

so all pairwise interactions cost time linear in the features.  The model is
fitted in the driver on a bounded sample of labelled documents (``SAMPLE``
rows, picked by a hash of the id) and scores every whole text.

Defined results: a null or empty text is scored from its statistics (all
zero) alone; a null id is never held out nor learnt from; repeated rows are
scored each; of several texts of a labelled id the one with the least hash is
learnt from, of several labels the least; with no labels, or labels of one kind,
nothing can be learnt: every score is 0.5, and ``accepted`` keeps all documents;
an empty table gives no rows; texts of any length are read whole;
extra columns are ignored, and stay as they are in ``accepted``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, RANK = 1 << 14, 6
#: Labelled rows that the fit may use at most. Each is used with its whole text.
SAMPLE = 4000
EPOCHS, RATE, DECAY = 5, 0.05, 1e-5
THRESHOLD = 0.7

_SYMBOL = re.compile(rb"[#*$%&|<>!]")
_DIGIT = re.compile(rb"[0-9]")


def statistics(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure of a text, each between 0 and 1."""
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * 12
    lines = text.split(b"\n")
    filled = [x for x in lines if x.strip()]
    marks = len(_SYMBOL.findall(text))
    ends = sum(w[-1:] in b".!?" for w in words)
    upper = sum(w.isupper() for w in words)
    alone = sum(a == b for a, b in zip(words, words[1:]))
    pairs = Counter(zip(words, words[1:]))
    twice = sum(c for c in pairs.values() if c > 1)
    return [
        min(1.0, np.log1p(n) / 12),
        min(1.0, sum(map(len, words)) / n / 20),
        min(1.0, 5 * marks / chars),
        min(1.0, marks / n),
        1 - len(counts) / n,
        alone / n,
        twice / n,
        ends / n,
        upper / n,
        min(1.0, 10 * len(_DIGIT.findall(text)) / chars),
        1 - len(set(filled)) / max(1, len(filled)),
        min(1.0, len(filled) / n),
    ]


STATS = 12
CUTS = 10
#: Features: word buckets, then the value of each statistic, then its decile bucket.
WIDTH = BUCKETS + STATS + STATS * (CUTS + 1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; words weigh 1 + log(count) and have length one together."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    counts = Counter(words)
    stats = statistics(raw, words, counts)
    idx = [zlib.crc32(w.lower()) % BUCKETS for w in counts]
    val = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    val = val / max(1e-9, np.sqrt((val * val).sum()))
    idx += [BUCKETS + k for k in range(STATS)] + [BUCKETS + STATS + k * (CUTS + 1) + int(s * CUTS) for k, s in enumerate(stats)]
    return np.array(idx, np.int64), np.concatenate([val, stats, np.ones(STATS)]).astype(np.float32)


def raw_score(model: dict, idx: np.ndarray, val: np.ndarray) -> float:
    vx = model["v"][idx] * val[:, None]
    s = vx.sum(0)
    return float(model["w0"] + model["w"][idx] @ val + 0.5 * (s @ s - (vx * vx).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> dict | None:
    """Adaptive gradient descent on the weighted logistic loss; None without both labels."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    r = np.random.default_rng(seed)
    v = r.normal(0, 0.02, (WIDTH, RANK)).astype(np.float32)
    w, w0 = np.zeros(WIDTH, np.float32), 0.0
    gw, gv, g0 = np.full(WIDTH, 1e-3, np.float32), np.full((WIDTH, RANK), 1e-3, np.float32), 1e-3
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    for _ in range(EPOCHS):
        for k in r.permutation(len(rows)):
            idx, val = rows[k]
            vi = v[idx]
            vx = vi * val[:, None]
            s = vx.sum(0)
            z = w0 + w[idx] @ val + 0.5 * (s @ s - (vx * vx).sum())
            g = weight[k] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k])
            dw = g * val + DECAY * w[idx]
            dv = g * (val[:, None] * s - vi * (val * val)[:, None]) + DECAY * vi
            gw[idx] += dw * dw
            gv[idx] += dv * dv
            g0 += g * g
            w[idx] -= RATE * dw / np.sqrt(gw[idx])
            v[idx] -= RATE * dv / np.sqrt(gv[idx])
            w0 -= RATE * g / np.sqrt(g0)
    model = {"w0": float(w0), "w": w, "v": v}
    # the score is moved so that THRESHOLD is where the two kinds of error weigh the same on the learnt rows
    z = np.array([raw_score(model, *x) for x in rows])
    at = np.quantile(z, np.linspace(0.002, 0.998, 499))
    miss = [(z[y == 1] < a).mean() + (z[y == 0] >= a).mean() for a in at]
    best = [a for a, m in zip(at, miss) if m <= min(miss) + 1e-9]
    model["shift"] = float(np.mean([best[0], best[-1]]) - np.log(THRESHOLD / (1 - THRESHOLD)))
    return model


def held_out(id_: str) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> dict | None:
    """Fit on at most ``sample`` labelled rows that aren't held out, those with the least hashes of their id."""
    marks = labels.select(F.col(id_).alias("_id"), F.col(label).cast("int").alias("_y")).where(~held_out("_id") & F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    # a bound on the hash that leaves about four times the sample: what is sorted doesn't grow with the labels
    n = marks.agg(F.approx_count_distinct("_id", 0.02)).first()[0]
    if n > 4 * sample:
        marks = marks.where(F.xxhash64("_id") < F.lit(int((1 << 64) * 4 * sample / n) - (1 << 63)))
    marks = marks.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(marks), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"))  # an id is learnt from once, however many rows it has
    made = rows.mapInPandas(_featurise, "id long, y int, idx binary, val binary").toPandas().sort_values("id")
    return fit([(np.frombuffer(i, np.int64), np.frombuffer(v, np.float32)) for i, v in zip(made["idx"], made["val"])], made["y"].tolist())


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        made = [features(t) for t in b["_t"]]
        yield pd.DataFrame({"id": b["_id"], "y": b["_y"], "idx": [i.tobytes() for i, _ in made], "val": [v.tobytes() for _, v in made]})


def scores(spark: SparkSession, model: dict | None, text: Column) -> Column:
    """The model's probability that the label of ``text`` is 1."""
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        for b in batches:
            if m is None:
                yield pd.Series(np.full(len(b), 0.5))
            else:
                z = np.array([raw_score(m, *features(t)) for t in b], float) - m["shift"]
                yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    # type hints are resolved in this module
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = train(docs, labels, text, id_)
    out = docs.select(F.col(id_), held_out(id_).alias("held_out"), scores(docs.sparkSession, model, F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """The documents that the model accepts, all columns as they were; all of them where nothing can be learnt."""
    model = train(docs, labels, text, id_)
    if model is None:
        return docs
    rows = docs.select(F.struct(*docs.columns).alias("_qf_row"), scores(docs.sparkSession, model, F.col(text)).alias("_qf_score"))
    return rows.where(F.col("_qf_score") >= THRESHOLD).select("_qf_row.*")
