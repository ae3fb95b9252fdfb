"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; a source's budget then falls inside one bucket, and only
the rows of that boundary bucket are looked at again, in finer buckets. What comes out is one
threshold per source; a row is in when its hash lies below it. Nothing is sorted.

Where a boundary row doesn't fit, the search goes on behind it among rows that do fit in what is left, until
what is left is below ``CLOSE`` of the target or no row fits; each such turn adds a hash range with a largest size.
A source whose untaken rows are all too large takes small rows once more, where that keeps to the most repeats.

Null texts have size 0 and are never taken. A null source is a source of its own, last in order.
Repeated rows share a hash and go in or out together, as do rows whose hashes agree in 40 bits. An empty table
gives an empty result. Working columns carry an ``_m_`` prefix, and given columns of the same names are
replaced; all others are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import SPACE, ship, stage, table

BITS, LEVELS = 10, 4  # 1,024 buckets a level; thresholds of 40 bits
MOST_REPEATS = 3
CLOSE = 0.001
TURNS = 64  # each at least takes a source's boundary row out of question; two or three are usual
BROADCAST_SOURCES = 100_000  # of some 200 bytes each


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def source_targets(sizes: list[tuple[str | None, int]], weights=(1, 2, 3), most: int = MOST_REPEATS) -> dict[str | None, float]:
    """Each source's budget: shares of the total by weight, none above ``most`` times its size, the excess reshared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    cap = {name: float(most * n) for name, n in order}
    out: dict[str | None, float] = {}
    left, free = float(sum(n for _, n in order)), list(weight)
    while free:
        unit = left / sum(weight[x] for x in free)
        over = [x for x in free if unit * weight[x] > cap[x]]
        if not over:
            return out | {x: unit * weight[x] for x in free}
        for x in over:
            out[x] = cap[x]
            left -= cap[x]
        free = [x for x in free if x not in out]
    return out


def _cell(bits: int) -> Column:
    """The first ``bits`` bits of the hash, as a number."""
    return F.shiftrightunsigned("_m_hash", 64 - bits)


def _descend(df: DataFrame, size: str, source: str, left: dict, low: dict) -> dict:
    """For each source of ``low``: (boundary cell, its size), the first cell from ``low`` on that the budget can't take whole.

    Only rows that alone fit in what was ``left`` count. ``left`` is reduced by all cells before the boundary.
    Level by level, only rows in the cell that holds it are summed in finer buckets. A level is one query whatever the
    number of partitions (``toLocalIterator`` runs one for each); one row per source comes to the driver.
    """
    prefix, found, most = dict.fromkeys(low, 0), {}, {k: int(left[k]) for k in low}
    before = Window.partitionBy("_m_key").orderBy("_m_cell").rowsBetween(Window.unboundedPreceding, -1)
    for level in range(LEVELS):
        fields = [("_m_prefix", T.LongType()), ("_m_low", T.LongType()), ("_m_most", T.LongType()), ("_m_left", T.DoubleType())]
        edge = _table(df.sparkSession, [(k, prefix[k], low[k], most[k], left[k]) for k in prefix], fields)
        rows = df.join(edge, df[source].eqNullSafe(edge["_m_key"])).where((_cell(BITS * LEVELS) >= F.col("_m_low")) & (F.col(size) <= F.col("_m_most")))
        if level:
            rows = rows.where(_cell(BITS * level) == F.col("_m_prefix"))
        sums = rows.groupBy("_m_key", _cell(BITS * (level + 1)).alias("_m_cell")).agg(F.sum(size).alias("_m_sum"), F.max("_m_left").alias("_m_left"))
        sums = sums.withColumn("_m_before", F.coalesce(F.sum("_m_sum").over(before), F.lit(0)))
        over = F.when(F.col("_m_before") + F.col("_m_sum") > F.col("_m_left"), F.struct("_m_cell", "_m_sum", "_m_before"))
        ends = {k: (first, n) for k, first, n in sums.groupBy("_m_key").agg(F.min(over), F.sum("_m_sum")).collect()}
        for k in list(prefix):
            first, n = ends.get(k, (None, 0))
            if first:
                prefix[k], here, n = first
                found[k] = prefix[k], here
            else:  # all that remains fits
                del prefix[k]
                found[k] = 1 << BITS * LEVELS, 0
            left[k] -= n
        if not prefix:
            break
    return found


def plan_mix(df: DataFrame, size: str, source: str, hash_of: list[str], weights=(1, 2, 3)) -> DataFrame:
    """One row per source: its size, target, whole repeats and hash ranges. ``df`` needs sizes, not texts.

    Every row is taken ``target // size`` times, and rows in the source's hash ranges, up to the range's largest
    size, once more. The driver holds one row per source; sources are names that someone gave, so they don't grow with rows.
    """
    df = df.drop(*WORKING).withColumn("_m_hash", F.xxhash64(*hash_of))
    totals = {r[0]: r[1] or 0 for r in df.groupBy(source).agg(F.sum(size)).collect()}
    targets = source_targets(list(totals.items()), weights)
    whole = {k: int(targets[k] // v) if v else 0 for k, v in totals.items()}
    left = {k: targets[k] - whole[k] * v for k, v in totals.items()}
    ranges: dict = {k: [] for k in totals}
    low, again = {k: 0 for k in totals if left[k] >= 1}, set()
    for turn in range(TURNS):
        if not low:
            break
        most = {k: int(left[k]) for k in low}
        for k, (cell, n) in _descend(df, size, source, left, low).items():
            over = cell >> BITS * LEVELS
            # the boundary row ends the search when to overshoot by it comes near enough
            take = not over and 0 < n - left[k] <= CLOSE * targets[k]
            if cell + take > low[k]:
                ranges[k].append((low[k], cell + take, most[k]))
            left[k] -= n * take
            low[k] = cell + 1
            if over and whole[k] + 2 <= MOST_REPEATS and k not in again:
                again.add(k)  # what is still missing comes from small rows once more
                low[k] = 0
            elif over:
                del low[k]
            if take or left[k] < 1 or left[k] <= CLOSE * targets[k]:
                low.pop(k, None)
    span = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("low", "high", "most")]))
    fields = [("_m_source_size", T.LongType()), ("_m_target", T.DoubleType()), ("_m_whole", T.LongType()), ("_m_ranges", span)]
    return _table(df.sparkSession, [(k, totals[k], targets[k], whole[k], ranges[k]) for k in totals], fields)


WORKING = ["_m_hash", "_m_key", "_m_source_size", "_m_target", "_m_whole", "_m_ranges", "_m_copies", "_m_prefix", "_m_low", "_m_most", "_m_left", "_m_cell", "_m_sum", "_m_before"]


def apply_mix(df: DataFrame, plan: DataFrame, source: str, hash_of: list[str], size: str = "size") -> DataFrame:
    """``df`` with ``_m_source_size``, ``_m_target`` and ``_m_copies`` (whole repeats of each row): a filter by hash."""
    df = df.drop(*WORKING).withColumn("_m_hash", F.xxhash64(*hash_of))
    out = df.join(plan, df[source].eqNullSafe(plan["_m_key"]), "left")
    cell = _cell(BITS * LEVELS)
    more = F.size(F.filter("_m_ranges", lambda r: (cell >= r["low"]) & (cell < r["high"]) & (F.col(size) <= r["most"]))).cast("long")
    return out.withColumn("_m_copies", F.col("_m_whole") + more).drop("_m_key", "_m_hash", "_m_whole", "_m_ranges")


def _table(spark: SparkSession, rows: list[tuple], fields) -> DataFrame:
    """One row per source; broadcast up to a checked number of them, so that texts aren't shuffled."""
    schema = T.StructType([T.StructField("_m_key", T.StringType()), *[T.StructField(n, t) for n, t in fields]])
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) <= BROADCAST_SOURCES else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix")
    out = apply_mix(sized, plan_mix(sized, "size", "source", ["doc_id"]), "source", ["doc_id"])
    return out.select("doc_id", "source", "size", F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target"), (F.col("size") * F.col("_m_copies")).alias("taken"), F.col("_m_copies").alias("copies"))
