"""Registered queries over the driver's tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, strings, times
from ..operators import ngrams
from ..sources import dialects
from . import documents

LETTERS = "abcdefghijklmnopqrstuvwxyz "
DIGITS = "0123456789"
ALPHABETS = (ngrams.Alphabet(1, LETTERS, 2), ngrams.Alphabet(2, DIGITS, 1))
KEY = bytes(range(16))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character bigrams of all documents: one narrow expansion, one partially aggregated shuffle."""
    text = _table(spark, sf_dir, "documents").select("text").where("length(text) > 1")
    # characters once as an array: a substring per position would count from the start each time
    pairs = F.element_at(F.transform(F.array(F.split("text", "")), lambda c: F.transform(F.slice(c, F.lit(1), F.length("text") - 1), lambda x, i: F.concat(x, F.get(c, i + 1)))), 1)
    return text.select(F.explode(pairs).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


def string_edits(spark, sf_dir):
    s = F.col("p_name")
    cols = {
        "inserted": strings.insert(s, 3, F.lit("<+>")), "erased": strings.erase(s, 2, 3), "spliced": strings.splice(s, 1, 2, F.lit("##")),
        "e_at": strings.find(s, "e", 2), "vowel_at": strings.find_any(s, "aeiou"), "masked": strings.replace_chars(s, "aeiou", "*"),
    }
    return _table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in cols.items()])


def string_splits(spark, sf_dir):
    t = _table(spark, sf_dir, "pages").select("page_id", "url")
    first = strings.split_first(F.col("url"), "?")
    return t.select("page_id", F.array_join(strings.split_words(F.col("url"), "/"), "|").alias("words"), F.size(strings.split_parts(F.col("url"), "/")).cast("long").alias("n_parts"), first["found"].cast("long").alias("found"), first["left"].alias("l"), first["right"].alias("r"))


def string_joins(spark, sf_dir):
    parts = F.array(F.lit(""), F.when(F.col("p_size") % 2 == 0, "").otherwise("x"), F.col("p_brand"), F.lit(""), F.col("p_type"))
    return _table(spark, sf_dir, "part").select("p_partkey", strings.join(parts, ",").alias("joined"))


def string_folds(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit(" \t"), "text", F.lit("\n ")).alias("s"))
    return t.select("conv_id", "turn", strings.trim(F.col("s")).alias("trimmed"), F.lower("s").alias("low"), strings.same_text(F.lower("s"), F.col("s")).alias("same"))


def string_escapes(spark, sf_dir):
    s = F.concat(F.lit('"'), "p_name", F.lit('\\\t"\n'))
    return _table(spark, sf_dir, "part").select("p_partkey", strings.json_escape(s).alias("escaped"), (strings.unescape(strings.json_escape(s)) == s).alias("round_trip"))


def path_parts(spark, sf_dir):
    p = F.concat(F.lit("C:"), F.regexp_replace("url", "^https?:/", ""), F.lit(".html"))
    parts = strings.split_path(p)
    return _table(spark, sf_dir, "pages").select("page_id", *[parts[c].alias(c) for c in ("drive", "dir", "name", "ext")], strings.file_name(p).alias("file"))


def text_lines(spark, sf_dir):
    s = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", strings.line_of(s, F.floor(F.length(s) / 2).cast("int")).cast("long").alias("line"), F.length(strings.known_only(s, LETTERS)).cast("long").alias("n_known"), F.length(strings.unknown_only(s, LETTERS)).cast("long").alias("n_unknown"))


def space_collapse(spark, sf_dir):
    """Without spaces after spaces and marks; lengths and digests of the results."""
    s = strings.collapse_spaces(F.col("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(s).cast("long").alias("n"), F.md5(s).alias("digest"))


def number_parsing(spark, sf_dir):
    """Literals of several kinds into 16-bit integers, with status codes."""
    k = F.col("l_orderkey") % 7
    lit = F.when(k == 0, F.col("l_linenumber").cast("string")).when(k == 1, F.concat(F.lit("0x"), F.lower(F.hex(F.col("l_partkey") % 40000)))).when(k == 2, "-32.768E3").when(k == 3, F.concat(F.lit("12a"), F.col("l_linenumber").cast("string"))).when(k == 4, "").when(k == 5, "70000").otherwise("-1.5e2")
    got = numbers.parse_number(lit, -32768, 32767)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", lit.alias("literal"), got["status"].cast("long").alias("status"), got["value"].alias("value"))


def number_formats(spark, sf_dir):
    n = F.col("l_partkey")
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.printf(F.lit("%05d|%x|%X"), n, n, n).alias("ints"), F.printf(F.lit("%8.2f|%-10s|%5s"), F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus")).alias("mixed"),
        numbers.unsigned32(-n).alias("unsigned"), numbers.ones(n).cast("long").alias("ones"), numbers.narrow(n, 0, 255).cast("long").alias("to_byte"), numbers.compare(F.col("l_quantity"), F.lit(25.0)).cast("long").alias("cmp"),
    )


def hash_digests(spark, sf_dir):
    name = F.col("c_name")
    return _table(spark, sf_dir, "customer").select("c_custkey", F.md5(name).alias("md5"), F.sha2(name, 256).alias("sha256"), numbers.to_hex(numbers.digest(name, "md5", 3)).alias("md5_thrice"), numbers.to_hex(numbers.stretch(name, 24)).alias("stretched"))


def hash_fnv(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", numbers.fnv64("c_name").cast("string").alias("fnv"))


def cipher_round_trips(spark, sf_dir):
    data = F.encode(F.rpad(F.col("c_name"), 32, "."), "UTF-8")
    key, iv = F.lit(KEY), F.lit(KEY[::-1])
    out = {m: numbers.encrypt(data, key, m, iv) for m in ("ECB", "CBC")}
    ctr = numbers.counter_mode(data, key, iv)
    back = (numbers.decrypt(out["ECB"], key, "ECB") == data) & (numbers.decrypt(out["CBC"], key, "CBC", iv) == data) & (numbers.counter_mode(ctr, key, iv) == data)
    return _table(spark, sf_dir, "customer").select("c_custkey", F.hex(out["ECB"]).alias("ecb"), F.hex(out["CBC"]).alias("cbc"), F.hex(ctr).alias("ctr"), back.alias("round_trip"))


def framed_payloads(spark, sf_dir):
    f = numbers.frame(F.encode("c_name", "UTF-8"))
    got = numbers.unframe(f)
    return _table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.hex(F.substring(f, 5, 16))).alias("digest"), got["ok"].alias("ok"), F.decode(got["payload"], "UTF-8").alias("payload"))


def time_formats(spark, sf_dir):
    t = F.col("ts")
    return _table(spark, sf_dir, "events").select("event_id", times.format_time("YYYY.MM.DD hh:mm:ss:cccc", t).alias("long_form"), times.format_time("DD.MM.YY h-m", t).alias("short_form"), times.weekday(t).cast("long").alias("weekday"))


def time_parsing(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy.MM.dd HH:mm:ss")
    return _table(spark, sf_dir, "orders").select("o_orderkey", times.parse_millis(text).alias("millis"), times.parse_millis(F.concat(text, F.lit("+02:30"))).alias("zoned"))


def json_path_get(spark, sf_dir):
    nodes = dialects.read_nodes(_table(spark, sf_dir, "events"), "event_id", "props")
    return dialects.get_path(nodes, "/K").select(F.col("doc_id").alias("event_id"), F.col("value").cast("long").alias("k"))


def json_kinds(spark, sf_dir):
    nodes = dialects.read_nodes(_table(spark, sf_dir, "events"), "event_id", "props")
    return nodes.groupBy("path", "kind").agg(F.count("*").alias("n"))


def loose_config(spark, sf_dir):
    """A loose-dialect text per part: comments, bare names, ``=``, ``;``, hexadecimal numbers.

    A part's leaves are picked in the task that reads its text: node tables would be sorted and shuffled for that.
    """
    t = _table(spark, sf_dir, "part")
    text = F.concat(F.lit("{ # part\n name = '"), "p_name", F.lit("'; size: 0x"), F.hex(F.col("p_size").cast("long")), F.lit(", tags [a; b], price = "), F.printf(F.lit("%.2f"), F.col("p_retailprice")), F.lit(" }"))
    leaves = {"name": ("name", "string"), "size": ("size", "long"), "tag": ("tags[1]", "string"), "price": ("price", "double")}
    return dialects.read_leaves(t.select("p_partkey", text.alias("text")), "p_partkey", "text", leaves, loose=True).withColumnRenamed("doc_id", "p_partkey")


def tree_differences(spark, sf_dir):
    """Each event's properties against the next event's."""
    t = _table(spark, sf_dir, "events").select("event_id", "props")
    left = dialects.read_nodes(t, "event_id", "props")
    right = dialects.read_nodes(t.select((F.col("event_id") - 1).alias("event_id"), "props"), "event_id", "props")
    return dialects.differences(left, right).select(F.col("doc_id").alias("event_id"), "path", "what")


def ini_sections(spark, sf_dir):
    t = _table(spark, sf_dir, "part")
    text = F.concat(F.lit("root = "), F.col("p_size").cast("string"), F.lit("\n; note\n["), "p_brand", F.lit("]\nname = "), "p_name", F.lit("\ntype="), "p_type", F.lit(" \n[end]\nlast = 1"))
    return dialects.ini_entries(t.select("p_partkey", text.alias("text")), "p_partkey", "text").select(F.col("doc_id").alias("p_partkey"), F.col("line").cast("long").alias("line"), "section", "name", "value")


def variable_expansion(spark, sf_dir):
    _, values = dialects.close_variables({"who": "%first%-part", "first": "a"})
    text = F.concat(F.lit("%who%/%unknown%/100%%/"), F.col("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", dialects.expand_variables(text, values).alias("expanded"))


def command_words(spark, sf_dir):
    line = F.concat(F.lit('run -n="'), F.col("p_name"), F.lit('" /size '), F.col("p_size").cast("string"))
    words = dialects.arguments(line)
    return _table(spark, sf_dir, "part").select("p_partkey", F.size(words).cast("long").alias("n"), F.element_at(words, 2).alias("named"))


def ngram_counts(spark, sf_dir):
    """The learner's counts of order 0 to 2 over conversations."""
    counts = ngrams.learn(_table(spark, sf_dir, "conversations").select(F.lower("text").alias("text")), "text", ALPHABETS)
    return counts.select(F.col("alphabet").cast("long").alias("alphabet"), "prefix", "kind", "symbol", "n")


def ngram_probabilities(spark, sf_dir):
    counts = ngrams.learn(_table(spark, sf_dir, "conversations").select(F.lower("text").alias("text")), "text", ALPHABETS)
    return ngrams.probabilities(counts, ALPHABETS)


def ideal_code_bits(spark, sf_dir):
    """Bits that an ideal order-0 coder of the corpus needs for each character."""
    chars = _table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    total = chars.agg(F.sum("n").alias("total"))
    return chars.join(F.broadcast(total)).select("ch", "n", F.round(-F.log2(F.col("n") / F.col("total")), 6).alias("bits"))  # one row of totals


def array_edits(spark, sf_dir):
    a = F.array("p_size", F.lit(7), F.length("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_append(a, F.lit(9)), ",").alias("pushed"), F.array_join(F.slice(a, 1, 2), ",").alias("popped"), (F.array_position(a, F.lit(7)) - 1).cast("long").alias("found"), F.array_join(F.array_insert(a, 2, F.lit(0)), ",").alias("inserted"))


QUERIES = {f.__name__: f for f in (
    bigram_counts, string_edits, string_splits, string_joins, string_folds, string_escapes, path_parts, text_lines, space_collapse, number_parsing, number_formats, hash_digests, hash_fnv, cipher_round_trips, framed_payloads,
    time_formats, time_parsing, json_path_get, json_kinds, loose_config, tree_differences, ini_sections, variable_expansion, command_words, ngram_counts, ngram_probabilities, ideal_code_bits, array_edits,
)}
QUERIES |= documents.QUERIES
