"""Toxicity by cumulative-link ordinal regression on hashed words.

``P(grade <= j) = logistic(threshold_j - w . x)`` with one weight vector for all ordered thresholds; the
output is the expected grade. Labels say toxic or not; toxic training texts are graded 1 to ``GRADES``
by how dense words typical of toxic texts are in them. Every word of a labelled text has a weight: its
smoothed rate ratio between toxic and all texts, from counts over all labelled rows (summed in the
cluster), times a factor. The factors are fitted with an L2 penalty on at most ``SAMPLE_ROWS`` labelled
rows (a documented bound), picked by hash; words outside that sample have the common factor. A sampled
row's ratios leave out the rows of its own fold, so that no label explains itself. Words share
``2**SPACE_BITS`` hashed features (the other bound). Scoring reads whole texts.

A null or empty text has no words and gets the intercept's severity. Labels that are null, or whose
document is missing, teach nothing; without both kinds of labels every severity is 0. Repeated rows get
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import columns_of, schema_with, ship, slices, stage, table, text_bytes, tidy, word_hashes

SPACE_BITS = 20
GRADES = 3
SAMPLE_ROWS = 8000
FOLDS = 4
PENALTY = 0.3  # of a factor's square, against the log likelihood of the sample
BROADCAST_ROWS = 1_000_000  # of (key, label): 32 MB at most


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a batch, sorted, as two arrays."""
    data, offsets = text_bytes(column)
    h, first = word_hashes(data, offsets, terms=True)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    pair = np.unique((row << SPACE_BITS) | (h >> np.uint64(64 - SPACE_BITS)).astype(np.int64))
    return pair >> SPACE_BITS, pair & ((1 << SPACE_BITS) - 1)


def _features(batches):
    """(row id, label, distinct features) of labelled rows."""
    for batch in batches:
        for a, b in slices(batch.column("_t_text")):
            row, f = hashed_words(batch.column("_t_text").slice(a, b - a))
            ends = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f.astype(np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("_t_h").slice(a, b - a), batch.column("_t_y").slice(a, b - a), lists], names=["h", "y", "f"])


def rate_ratio(a: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Log of how much oftener a word of ``n`` texts is in toxic ones (``a``) than their share says, shrunk smoothly where evidence is thin."""
    r = np.log((a + 1) / (n * share + 1))
    return r**3 / (r * r + 1 / (a + 1))


def fit_ordinal(row: np.ndarray, word: np.ndarray, value: np.ndarray, y: np.ndarray, grades: int, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(factor of each word, common factor, ordered thresholds, score of each row) of sparse rows, by Adam.

    A word's factor is the common one plus its own deviation, which is penalised; thresholds stay ordered
    as cumulated exponentials.
    """
    n, k = len(y), int(word.max()) + 1 if len(word) else 0
    par = np.zeros(k + 1 + grades)  # deviations, common factor, first threshold, log gaps
    m, v = np.zeros_like(par), np.zeros_like(par)
    part = np.clip(np.array([(y <= j).mean() for j in range(grades)]), 1e-3, 1 - 1e-3)
    logit = np.log(part / (1 - part))
    par[k + 1] = logit[0]
    par[k + 2 :] = np.log(np.maximum(np.diff(logit), 1e-2))

    def state():
        theta = par[k + 1] + np.concatenate(([0.0], np.cumsum(np.exp(par[k + 2 :]))))
        return theta, np.bincount(row, value * (par[k] + par[:k][word]), n)

    for step in range(1, steps + 1):
        gaps, (theta, z) = np.exp(par[k + 2 :]), state()
        theta = np.concatenate(([-40.0], theta, [40.0]))
        up, low = 1 / (1 + np.exp(-np.clip(theta[y + 1] - z, -40, 40))), 1 / (1 + np.exp(-np.clip(theta[y] - z, -40, 40)))
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        g_theta = np.zeros(grades + 2)
        np.add.at(g_theta, y + 1, du)
        np.add.at(g_theta, y, -dl)
        g_theta = g_theta[1:-1]
        pull = value * (dl - du)[row]
        grad = -np.concatenate((np.bincount(word, pull, k), [pull.sum()], [g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * gaps)) / n
        grad[:k] += PENALTY / n * par[:k]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        par -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    theta, z = state()
    return par[k] + par[:k], float(par[k]), theta, z


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"):
    """(feature numbers, weights, thresholds, cut on the probability of any toxicity), or None without both kinds of labels."""
    ship(docs.sparkSession)
    # one label for a key, so that repeated label rows don't multiply texts
    y = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_t_key")).agg(F.max(F.col(label).cast("int")).alias("_t_y"))
    y = stage(y, "tox-labels")
    few = y.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # else labels and texts are both shuffled
    rows = docs.select(F.col(key).alias("_t_key"), F.col(text).alias("_t_text")).join(F.broadcast(y) if few else y, "_t_key").select(F.xxhash64("_t_key").alias("_t_h"), "_t_y", "_t_text")
    bags = stage(rows.mapInArrow(lambda it: tidy(_features(it)), "h long, y int, f array<int>"), "tox")
    fold, toxic = F.pmod("h", F.lit(FOLDS)), (F.col("y") > 0).cast("int")
    total = np.zeros((2, FOLDS))  # toxic rows, all rows
    for r in bags.groupBy(fold.alias("k")).agg(F.sum(toxic).alias("a"), F.count("*").alias("n")).collect():
        total[:, r.k] = r.a, r.n
    if not 0 < total[0].sum() < total[1].sum():
        return None
    # a row per feature, of which there are 2**SPACE_BITS at most; sums combine on the map side
    sums = [F.sum(F.when(F.col("k") == k, c).otherwise(0)).cast("int").alias(f"{n}{k}") for n, c in (("a", F.col("t")), ("n", F.lit(1))) for k in range(FOLDS)]
    seen = bags.select(toxic.alias("t"), fold.alias("k"), F.explode("f").alias("f")).groupBy("f").agg(*sums).toArrow()
    chosen = seen.column("f").to_numpy()
    order = np.argsort(chosen)
    chosen = chosen[order]
    a, n = (np.stack([seen.column(f"{c}{k}").to_numpy()[order] for k in range(FOLDS)]) for c in "an")
    w = rate_ratio(a.sum(0), n.sum(0), total[0].sum() / total[1].sum())
    # hashes are uniform: about twice the rows that are needed lie under this bound, so few rows are sorted
    below = -(1 << 63) + min((1 << 64) - 1, (SAMPLE_ROWS << 65) // int(total[1].sum()))
    sample = bags.where(F.col("h") <= F.lit(below)).select("y", "f", fold.alias("k"), "h").orderBy("h").limit(SAMPLE_ROWS).toArrow().combine_chunks()
    y01, k = (sample.column("y").to_numpy() > 0).astype(np.int64), sample.column("k").to_numpy().astype(np.int64)
    if y01.min() == y01.max():
        return None
    row = np.repeat(np.arange(len(y01)), pc.list_value_length(sample.column("f")).to_numpy())
    at = np.searchsorted(chosen, pc.list_flatten(sample.column("f")).to_numpy())
    value = np.zeros(len(at))
    for j in range(FOLDS):
        own, others = k[row] == j, np.arange(FOLDS) != j
        f = at[own]
        value[own] = rate_ratio(a[others].sum(0)[f], n[others].sum(0)[f], total[0][others].sum() / max(1, total[1][others].sum()))
    dense = np.bincount(row, np.maximum(value, 0), len(y01)) / np.maximum(1, np.bincount(row, minlength=len(y01)))
    cuts = np.quantile(dense[y01 == 1], [j / GRADES for j in range(1, GRADES)])
    grade = np.where(y01 == 1, 1 + np.searchsorted(cuts, dense, "left"), 0)
    known, word = np.unique(at, return_inverse=True)
    factors, common, theta, z = fit_ordinal(row, word, value, grade, GRADES)
    factor = np.full(len(chosen), common)
    factor[known] = factors
    return chosen, (w * factor).astype(np.float32), theta, _best_cut(1 / (1 + np.exp(np.clip(theta[0] - z, -40, 40))), y01)


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability above which calling a text toxic has the best F1 on the sample."""
    values = np.unique(p)
    hit = np.array([((p >= v) & (y == 1)).sum() for v in values])
    said = np.array([(p >= v).sum() for v in values])
    best = int(np.argmax(2 * hit / (said + (y == 1).sum())))
    return float((values[best] + values[best - 1]) / 2) if best else float(values[0])


def _score(batches, shared, text: str):
    chosen, w, theta, _ = shared.value
    lut = np.zeros(1 << SPACE_BITS)
    lut[chosen] = w
    for batch in batches:
        column, z = batch.column(text), []
        for a, b in slices(column):
            row, f = hashed_words(column.slice(a, b - a))
            z.append(np.bincount(row, lut[f], b - a))
        z = np.concatenate(z) if z else np.zeros(0)
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -40, 40)))  # P(grade > j)
        keep = [c for c in batch.schema.names if c != text]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(above.sum(1)), pa.array(above[:, 0])], names=[*keep, "_t_severity", "_t_p"])


def score(df: DataFrame, model, text: str = "text") -> DataFrame:
    """``df`` without its text, plus ``_t_severity`` (expected grade) and ``_t_p`` (probability of any toxicity)."""
    df = df.drop("_t_severity", "_t_p")
    keep = [f for f in df.schema if f.name != text]
    if model is None:
        return df.select(*columns_of(df.drop(text)), F.lit(0.0).alias("_t_severity"), F.lit(0.0).alias("_t_p"))
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2**SPACE_BITS weights at most
    return df.mapInArrow(lambda it: tidy(_score(it, shared, text)), schema_with(keep, "_t_severity double, _t_p double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.col("_t_severity").alias("severity"), F.col("_t_p").alias("toxic_probability"), (F.col("_t_p") >= (model[3] if model else 1.0)).alias("toxic"))
