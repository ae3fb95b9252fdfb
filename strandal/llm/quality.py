"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Nulls and texts without words get zero metrics and fail the base rule. Repeated rows are judged
alike, row by row; an empty table gives an empty result; other columns of the input are untouched
(working columns carry a ``_q_`` prefix).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SPACE, WORD, table

#: Common function words of the four languages in the corpus.
STOP_WORDS = (
    "the of and to in is that it for was on as with be by this from are at or an a "
    "der die das und in zu den von mit ist für auf im nicht ein eine "
    "le la les de des et en un une du que qui dans pour sur est pas au avec "
    "el los las que y del se por con para una su al lo no es"
).split()  # fixed values


@dataclass(frozen=True)
class Rule:
    """Keep a text while ``low <= metric <= high``."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The default table. Metrics are the keys of ``metrics()`` below.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.30),
    Rule("repeat_ratio", None, 0.30),
    Rule("bang_ratio", None, 0.30),
    Rule("upper_ratio", None, 0.70),
    Rule("list_line_ratio", None, 0.60),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more, by one sort of hashed windows."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            m = F.size(s)
            twin = lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < m - 1) & (F.get(s, j + 1)["h"] == x["h"]))
            at = F.transform(F.filter(s, twin), lambda x: x["i"])
            return _let(at, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ordered, marked))

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(_let(windows, covered))


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the ``_q_`` counts that rules are ratios of. Two narrow projections; no shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_q_text": body, "_q_words": F.filter(F.split(body, SPACE), lambda w: w != ""), "_q_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))})
    words, lines, t = F.col("_q_words"), F.col("_q_lines"), F.col("_q_text")
    long = lambda c: c.cast("long")
    return df.withColumns(
        {
            "_q_n_words": long(F.size(words)),
            "_q_word_chars": long(F.length(F.array_join(words, ""))),
            "_q_n_symbols": long(F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))),
            "_q_n_lines": long(F.size(lines)),
            "_q_n_dup_lines": long(F.size(lines) - F.size(F.array_distinct(lines))),
            "_q_n_repeat_words": long(repeat_words(words)),
            "_q_n_stop": long(F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))),
            "_q_n_bang": long(F.size(F.filter(words, lambda w: w.endswith("!!")))),
            "_q_n_upper": long(F.regexp_count(t, F.lit("\\p{Lu}"))),
            "_q_n_list": long(F.size(F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•", "|")))),
        }
    ).drop("_q_text", "_q_words", "_q_lines")


def metrics() -> dict[str, Column]:
    """The table's vocabulary, over the counts."""
    q = lambda c: F.col(f"_q_{c}").cast("double")
    per = lambda a, b: F.when(q(b) > 0, q(a) / q(b)).otherwise(0.0)
    return {
        "n_words": q("n_words"),
        "mean_word": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "stop_ratio": per("n_stop", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "bang_ratio": per("n_bang", "n_words"),
        "upper_ratio": per("n_upper", "word_chars"),
        "list_line_ratio": per("n_list", "n_lines"),
    }


def compile_rules(rules=RULES) -> dict[str, Column]:
    """One boolean column per rule: whether a text breaks it."""
    known, out = metrics(), {}
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (known[r.metric] < r.low)
        if r.high is not None:
            bad = bad | (known[r.metric] > r.high)
        out[r.metric] = bad
    return out


def apply_rules(df: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``df`` with the ``_q_`` counts, ``_q_broken`` (names of broken rules) and ``_q_kept``."""
    bad = compile_rules(rules)
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in bad.items()]), lambda x: x.isNotNull())
    return base_counts(df, text).withColumn("_q_broken", broken).withColumn("_q_kept", F.size("_q_broken") == 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("_q_n_words") < 50) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in base], failed.alias("base_failed"), (~failed & F.col("_q_kept")).alias("kept"), F.array_join("_q_broken", ",").alias("broken"))


def sql(rules=RULES) -> str:
    """The query in DuckDB's SQL, with the thresholds of the same table."""
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END"
    of = {
        "n_words": "n_words", "mean_word": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"), "stop_ratio": ratio("n_stop", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"), "bang_ratio": ratio("n_bang", "n_words"), "upper_ratio": ratio("n_upper", "word_chars"), "list_line_ratio": ratio("n_list", "n_lines"),
    }
    bad = []
    for r in rules:
        tests = [f"{of[r.metric]} < {r.low!r}"] * (r.low is not None) + [f"{of[r.metric]} > {r.high!r}"] * (r.high is not None)
        bad.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.metric}' END")
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(STOP_WORDS)))
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             w AS (SELECT doc_id, body, list_filter(string_split_regex(body, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS ws,
                          list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\v\\f\\r]')) AS ls FROM t),
             tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
             rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
             cov AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) o(d) GROUP BY doc_id),
             c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                          len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop,
                          len(list_filter(ws, lambda x: suffix(x, '!!')))::BIGINT AS n_bang, len(regexp_extract_all(body, '\\p{{Lu}}'))::BIGINT AS n_upper,
                          len(list_filter(ls, lambda x: ltrim(x)[1] IN ('-', '*', '•', '|')))::BIGINT AS n_list FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
             v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, array_to_string(list_filter([{", ".join(bad)}], lambda x: x IS NOT NULL), ',') AS broken FROM c)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM v
    """
