"""A character n-gram learner over alphabets.

Each document is walked once by the alphabet automaton, run by run: where alphabets overlap the next alphabet depends
on the one before. What it emits are counts, so one combined shuffle sums the corpus. Probabilities are window
sums over the full symbol domain of each context.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files

CEILING = 16383
#: Characters that a corpus needs, and the status of one that has fewer; fixed values.
LEAST_CHARS, TOO_SHORT = 10_000, 1103
_SPACES = re.compile("(?<=[ ,.!?:;\\-\n\a\t]) ")


@dataclass(frozen=True)
class Alphabet:
    id: int
    chars: str
    order: int = 1
    single: bool = False


@lru_cache(64)
def _patterns(alphabets: tuple[Alphabet, ...]):
    """A pattern of characters in no alphabet, and each alphabet's pattern of runs."""
    inside = lambda chars: "".join(map(re.escape, chars))
    return re.compile(f"[^{inside(''.join(a.chars for a in alphabets))}]+"), [re.compile(f"[{inside(a.chars)}]*") for a in alphabets]


def walk(text: str, alphabets: tuple[Alphabet, ...], start: int = 0) -> tuple[Counter, int]:
    """Counts of (alphabet, prefix, kind, symbol), kind ``char`` or ``switch``, and of characters in no alphabet.

    A space behind a space or mark is not counted. A run ends where its alphabet lacks the next character; the
    first alphabet that has it goes on.
    """
    strange, runs = _patterns(alphabets)
    kept = _SPACES.sub("", text)
    known = strange.sub("", kept)
    grams: dict[tuple[int, int], Counter] = {}
    counts: Counter = Counter()
    now, at = start, 0
    while True:
        a, end = alphabets[now], runs[now].match(known, at).end()
        run = known[at:end]
        for n in range(min(a.order, len(run) - 1) + 1 if run else 0):
            grams.setdefault((a.id, n), Counter()).update(run if not n else map("".join, zip(*(run[i:] for i in range(n + 1)))))
        if end == len(known):
            break
        to = next(i for i, b in enumerate(alphabets) if known[end] in b.chars)
        for n in range(min(a.order, len(run)) + 1):
            counts[a.id, run[len(run) - n :], "switch", str(alphabets[to].id)] += 1
        now, at = to, end
    for (alphabet, _), found in grams.items():
        for gram, n in found.items():
            counts[alphabet, gram[:-1], "char", gram[-1]] += n
    return counts, len(kept) - len(known)


def learn(df: DataFrame, text: str, alphabets: tuple[Alphabet, ...]) -> DataFrame:
    """(alphabet, prefix, kind, symbol, n) summed over all documents; kind ``bad`` counts unknown characters."""

    def each(batches):
        for batch in batches:
            total: Counter = Counter()
            for t in batch["t"]:
                counts, bad = walk(t or "", alphabets)
                total.update(counts)
                total[-1, "", "bad", ""] += bad
            yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["alphabet", "prefix", "kind", "symbol", "n"])

    rows = df.select(F.col(text).alias("t")).mapInPandas(each, "alphabet int, prefix string, kind string, symbol string, n long")
    return rows.groupBy("alphabet", "prefix", "kind", "symbol").agg(F.sum("n").alias("n"))


def learn_folder(spark: SparkSession, folder: str, alphabets: tuple[Alphabet, ...]) -> tuple[int, DataFrame]:
    """(status, counts) of all files below a folder: ``TOO_SHORT`` where they have fewer than ``LEAST_CHARS`` characters."""
    texts = files.read_texts(spark, folder)
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return (TOO_SHORT if size < LEAST_CHARS else 0), learn(texts, "text", alphabets)


def contexts(alphabets: tuple[Alphabet, ...]) -> list[tuple[int, str]]:
    """All (alphabet, prefix) pairs that a model has: their number depends on the alphabets alone."""
    return [(a.id, "".join(p)) for a in alphabets for n in range(a.order + 1) for p in itertools.product(a.chars, repeat=n)]


def probabilities(counts: DataFrame, alphabets: tuple[Alphabet, ...], end_rate: float = 1 / 2000, all_contexts: bool = False) -> DataFrame:
    """(alphabet, prefix, kind, symbol, weight, p): terminal, switches and characters of every context that was seen, or of all.

    The first alphabet has the terminal. What can't occur has the least weight, 1; a context without counts is even.
    """
    spark = counts.sparkSession
    domain = []
    for i, a in enumerate(alphabets):
        domain += [(a.id, "end", "")] * (i == 0) + [(a.id, "switch", str(b.id)) for b in alphabets] + [(a.id, "char", c) for c in a.chars]
    domain = spark.createDataFrame(domain, "alphabet int, kind string, symbol string")
    single = [a.id for a in alphabets if a.single]
    if all_contexts:
        seen = spark.createDataFrame(contexts(alphabets), "alphabet int, prefix string")
    else:
        seen = counts.where("alphabet >= 0").select("alphabet", "prefix").distinct()
    full = seen.join(F.broadcast(domain), "alphabet").join(counts, ["alphabet", "prefix", "kind", "symbol"], "left")
    context = Window.partitionBy("alphabet", "prefix")
    own = (F.col("kind") == "switch") & (F.col("symbol") == F.col("alphabet").cast("string"))
    barred = own | ((F.col("kind") == "switch") & F.col("alphabet").isin(single)) if single else own
    n = F.when(barred, 0.0).otherwise(F.coalesce("n", F.lit(0)).cast("double"))
    full = full.withColumn("n", n).withColumn("total", F.sum("n").over(context))
    full = full.withColumn("f", F.when(F.col("kind") == "end", F.col("total") * end_rate).otherwise(F.col("n")))
    share = F.when(F.sum("f").over(context) > 0, F.col("f") / F.sum("f").over(context)).otherwise(1 / F.count("*").over(context))
    full = full.withColumn("weight", F.greatest(F.lit(1), F.floor(share * CEILING)).cast("long"))
    return full.select("alphabet", "prefix", "kind", "symbol", "weight", (F.col("weight") / F.sum("weight").over(context)).alias("p"))
