"""Registered queries over encodings, trees, options, coders and files, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, strings, times
from ..operators import coding, ngrams
from ..sources import dialects, files, options, trees


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def string_slices(spark, sf_dir):
    s = F.col("p_name")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", strings.slice_chars(s, 2, 4).alias("middle"), strings.slice_bytes(s, 0, 3).cast("string").alias("head"), strings.find_text(s, "an").alias("found"), strings.from_text(s, "an").alias("onward"),
        strings.replace_text(s, "an", "<>").alias("replaced"), strings.order_bytes(s, F.col("p_type")).cast("long").alias("ordered"), strings.upper(s).alias("up"), strings.pad_right(F.col("p_brand"), 12, ".").alias("padded"),
        strings.repeat("=", F.col("p_size") % 5).alias("bar"), strings.concat(s, "/", F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("joined"), strings.is_identifier(s).alias("is_name"),
    )


def text_encodings(spark, sf_dir):
    s = F.col("text")
    wide = strings.to_utf16(s)
    check = strings.utf8_check(F.concat(F.encode(s, "UTF-8"), F.when(F.col("turn") % 2 == 1, F.lit(b"\xff")).otherwise(F.lit(b""))))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", check["valid"].alias("valid"), F.length(check["text"]).cast("long").alias("n_valid"), (strings.from_utf16(wide) == s).alias("same"), F.md5(strings.to_code_page(F.lower(s), "koi8_r")).alias("koi8"))


def path_places(spark, sf_dir):
    s = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", strings.file_dir(s).alias("dir"), strings.join_path(strings.file_dir(s), strings.file_name(s)).alias("whole"), strings.is_base_name(strings.file_name(s)).alias("base"), strings.column_of(F.col("html"), F.lit(40)).cast("long").alias("column"))


def escapes_undone(spark, sf_dir):
    s = F.concat(F.col("p_name"), F.lit("\\t\\u0041\\\\x\\\"\\a"))
    return _table(spark, sf_dir, "part").select("p_partkey", strings.unescape(s).alias("plain"), strings.json_unescape(s).alias("json"))


def number_texts(spark, sf_dir):
    n = F.col("l_partkey")
    whole = numbers.to_integer(F.when(n % 3 == 0, F.concat(F.lit("  "), n.cast("string"), F.lit("\t"))).when(n % 3 == 1, F.concat(F.lit("-0x"), F.lower(F.hex(n)))).otherwise(F.concat(n.cast("string"), F.lit("q"))))
    rel = numbers.interval_relation(n % 50, F.lit(20), F.col("l_suppkey") % 50, F.col("l_linenumber") * 4)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", whole["status"].cast("long").alias("status"), whole["value"].alias("value"), numbers.float_text(F.col("l_tax")).alias("tax"), rel.cast("long").alias("relation"))


def large_numbers(spark, sf_dir):
    """Literals around the bounds of 64 bits."""
    k = F.col("o_orderkey") % 6
    lit = F.when(k == 0, "9007199254740993").when(k == 1, "9223372036854775808").when(k == 2, F.concat(F.lit("-"), F.col("o_custkey").cast("string"), F.lit("00000000000"))).when(k == 3, "0X1F").when(k == 4, "1e9999999999").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit("7.5E2")))
    got = numbers.parse_number(lit, -(1 << 63), (1 << 63) - 1)
    return _table(spark, sf_dir, "orders").select("o_orderkey", got["status"].cast("long").alias("status"), got["value"].alias("value"))


def packed_bits(spark, sf_dir):
    bits = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.pmod(F.floor(F.col("c_custkey") / F.pow(F.lit(2.0), i.cast("double"))), F.lit(2)).cast("int"))
    data = F.col("data")
    back = F.array_join(F.slice(numbers.unpack_bits(data), 1, 11), "")
    packed = _table(spark, sf_dir, "customer").select("c_custkey", numbers.pack_bits(bits).alias("data"))
    return packed.select("c_custkey", F.lower(F.hex(data)).alias("packed"), back.alias("bits"), numbers.ip_text(F.unhex(F.lpad(F.hex("c_custkey"), 8, "0"))).alias("address"), numbers.mac_text(F.unhex(F.lpad(F.hex("c_custkey"), 12, "0"))).alias("mac"), F.hex(numbers.hex_runs(F.concat(F.lit("0x"), F.lpad(F.hex("c_custkey"), 8, "0"), F.lit(" 7f")))).alias("runs"))


def digest_chains(spark, sf_dir):
    s = F.col("c_name")
    return _table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.hex(numbers.digest_again(s, 1))).alias("again"), F.lower(F.hex(numbers.spread_digest(s, 40, 2))).alias("spread"), F.hex(numbers.zero_pad(F.encode(s, "UTF-8"), 32)).alias("padded"))


def hash_fnv_folded(spark, sf_dir):
    """The case-folded hash says for each name whether its lower and upper forms agree."""
    s = F.col("c_name")
    return _table(spark, sf_dir, "customer").select("c_custkey", (numbers.fnv64_folded(F.lower(s)) == numbers.fnv64_folded(F.upper(s))).alias("same"), (numbers.fnv64(F.lower(s)) == numbers.fnv64(F.upper(s))).alias("plain"))


def time_fields(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    f, ms = times.fields(ts), F.unix_millis(ts)
    return _table(spark, sf_dir, "events").select("event_id", times.millis_text(ms).alias("text"), f["year"].cast("long").alias("year"), f["millis"].cast("long").alias("millis"), (F.unix_millis(times.instant(f)) == ms).alias("same"), times.span_seconds(f["hour"], f["minute"], f["second"], F.lit(0)).alias("of_day"), times.fixed_text(F.col("ts"), True).alias("fixed"))


def zone_checks(spark, sf_dir):
    k = F.col("event_id") % 4
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k == 0, "").when(k == 1, "+99:99").when(k == 2, " zone").otherwise("-03:30"))
    return _table(spark, sf_dir, "events").select("event_id", times.parse_millis(text).alias("millis"))


def tree_edits(spark, sf_dir):
    """Each event's properties after edits, printed in one line."""

    def edit(t):
        trees.put(t, "K2", trees.get(t, "k", 0) + 1 if isinstance(trees.get(t, "k", 0), int) else 0)
        trees.put(t, "inner", trees.from_python({"a": [1, 2], "b": True}))
        trees.put_path(t, "inner/b", False)
        trees.erase(t, "K")
        return "".join(x.strip() for x in trees.print_tree(t).split("\n"))

    return _table(spark, sf_dir, "events").select("event_id", trees.tree_column(F.col("props"), edit, "string").alias("edited"))


def tree_print(spark, sf_dir):
    """A document per part with a hidden name, two values on a line and a wrapped array."""
    text = F.concat(F.lit('{"name":"'), "p_name", F.lit('","size":'), F.col("p_size").cast("string"), F.lit(',"hide":1,"price":'), F.printf(F.lit("%.1f"), F.col("p_retailprice")), F.lit("}"))
    show = lambda t: trees.print_tree(t, {"": 2}, ("hide",))
    return _table(spark, sf_dir, "part").select("p_partkey", trees.tree_column(text, show, "string").alias("printed"))


def schema_findings(spark, sf_dir):
    """Findings in event properties: ``k`` is a mandatory whole number, an ``event`` name is missing in all, nothing else is bound."""
    schema = "{k: {type: 1, mandatory: true}, event: {type: 'x', mandatory: true}, '...': {type: [1, 1.5, 'x', true]}}"
    rows = _table(spark, sf_dir, "events").select("event_id", F.explode(trees.validation(F.col("props"), schema)).alias("f"))
    return rows.select("event_id", "f.path", F.col("f.code").cast("long").alias("code"), F.col("f.kind").cast("long").alias("kind"), "f.detail")


def tree_variables(spark, sf_dir):
    text = F.concat(F.lit('{"<!expand_environment>":true,"%who%":"%first%-'), "p_brand", F.lit('","%first%":"x","said":"%who% %none% %%","kept":{"<!disable_expand_environment>":1,"raw":"%who%"}}'))
    both = lambda t: (lambda r: f"{r[0]}|{trees.path(r[1], 'said')}|{trees.path(r[1], 'kept/raw')}")(trees.expand_tree(t))
    return _table(spark, sf_dir, "part").select("p_partkey", trees.tree_column(text, both, "string").alias("expanded"))


def pair_texts(spark, sf_dir):
    got = dialects.pairs(F.concat(F.lit("a="), "p_name", F.lit(";b="), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, ";").otherwise("")))
    names = dialects.variable_names(F.concat(F.lit("%x% and %"), "p_brand", F.lit("% 100%")))
    return _table(spark, sf_dir, "part").select("p_partkey", got["status"].cast("long").alias("status"), F.try_element_at(got["values"], F.lit("a")).alias("a"), F.array_join(names, ",").alias("names"))


OPTIONS = "{options: [{keys: ['n', 'name'], id: 1, help: 'a name', need_value: true}, {keys: ['size'], id: 2}]}"


def option_values(spark, sf_dir):
    words = F.array(F.concat(F.lit("-name="), "p_name"), F.lit("/size"), F.col("p_size").cast("string"), F.lit("cm"), F.when(F.col("p_size") % 2 == 0, "-n").otherwise("-bad=1"))
    got = F.col("got")
    parsed = _table(spark, sf_dir, "part").select("p_partkey", options.parse_arguments(words, options.read_options(OPTIONS)).alias("got"))
    return parsed.select("p_partkey", F.array_join(F.transform(got["errors"], lambda e: F.concat(e["code"].cast("string"), F.lit(":"), e["key"])), ",").alias("errors"), F.array_join(F.element_at(got["last"], 2), ",").alias("sizes"), F.size(got["options"]).cast("long").alias("n"))


def cell_lists(spark, sf_dir):
    text = F.concat(F.lit("/ note\nname='"), "p_name", F.lit("'; box{size="), F.col("p_size").cast("string"), F.lit("; code=D'0x0102'; same=L'name';}"))
    read = lambda t: (lambda r: "|".join([str(trees.cell_path(r, "NAME")), str(trees.cell_path(r, "box/0")), trees.cell_path(r, "box/code").hex(), str(trees.cell_path(r, "box/same"))]))(trees.parse_cells(t))

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(read)

    return _table(spark, sf_dir, "part").select("p_partkey", run(text).alias("cells"))


CODED = "abcdefghijklmnopqrstuvwxyz .,"


def coded_texts(spark, sf_dir):
    """Every turn through three coders and back: sizes in bytes, and whether the texts return.

    Turns are few bytes for much work, and a file's reader deals out bytes: so rows are dealt out first.
    """
    s = F.regexp_replace(F.lower("text"), "[^a-z .,]", "")
    even = dict.fromkeys(CODED, 1 / len(CODED))
    models = {
        "flat": coding.equiprobable(CODED), "switched": coding.switching([coding.Source(even, 2.0), coding.Source(dict.fromkeys("0123456789", 0.1), 1.0)]),
        "context": coding.learn_model("the cat and the dog and the man are here. " * 20, (ngrams.Alphabet(1, CODED, 1),)),
    }
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", s.alias("s"), F.monotonically_increasing_id().alias("place"))
    out = turns.repartition(spark.sparkContext.defaultParallelism, "place")
    for name, m in models.items():
        out = out.withColumn(f"c_{name}", coding.encode(F.col("s"), m))
    for name, m in models.items():
        out = out.withColumn(f"b_{name}", coding.decode(F.col(f"c_{name}.data"), m)["text"])
    back = F.lit(True)
    for name in models:
        back = back & (F.col(f"b_{name}") == F.col("s"))
    return out.select("conv_id", "turn", F.length("s").cast("long").alias("n_chars"), *[F.octet_length(f"c_{n}.data").cast("long").alias(f"n_{n}") for n in models], back.alias("round_trip"))


def file_listing(spark, sf_dir):
    return files.list_files(spark, sf_dir, pattern="region.parquet").select("name", (F.col("size") > 0).alias("filled"))


QUERIES = {f.__name__: f for f in (
    string_slices, text_encodings, path_places, escapes_undone, number_texts, large_numbers, packed_bits, digest_chains, hash_fnv_folded, time_fields, zone_checks, tree_edits, tree_print, schema_findings,
    tree_variables, pair_texts, option_values, cell_lists, coded_texts, file_listing,
)}

SQL = {
    "string_slices": """
        SELECT p_partkey, substring(p_name, 3, 4) AS middle, substring(p_name, 1, 3) AS head, CASE WHEN contains(p_name, 'an') THEN 'an' END AS found,
               CASE WHEN contains(p_name, 'an') THEN substring(p_name, strpos(p_name, 'an')) END AS onward, replace(p_name, 'an', '<>') AS replaced,
               (CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END)::BIGINT AS ordered, upper(p_name) AS up, rpad(p_brand, greatest(12, length(p_brand))::INT, '.') AS padded,
               repeat('=', p_size % 5) AS bar, p_name || '/' || CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS joined, regexp_full_match(p_name, '[0-9A-Za-z_]+') AS is_name
        FROM part
    """,
    "text_encodings": """
        SELECT conv_id, turn, turn % 2 = 0 AS valid, length(text) AS n_valid, true AS same, md5(s) AS koi8
        FROM (SELECT *, regexp_replace(lower(text), '[^\\x00-\\x7f]', '?', 'g') AS s FROM conversations)
    """,
    "path_places": """
        SELECT page_id, regexp_extract(url, '^(.*)/', 1) AS dir, url AS whole, true AS base,
               (length(l) + 3 * (length(l) - length(replace(l, E'\\t', ''))) + 1)::BIGINT AS "column"
        FROM (SELECT page_id, url, regexp_extract(substring(html, 1, 40), '([^\\n]*)$', 1) AS l FROM pages)
    """,
    "escapes_undone": """SELECT p_partkey, p_name || E'\\tu0041\\\\x"\\x07' AS plain, p_name || E'\\tu0041\\\\x"a' AS json FROM part""",
    "number_texts": """
        SELECT l_orderkey, l_linenumber, (CASE l_partkey % 3 WHEN 2 THEN 1 ELSE 0 END)::BIGINT AS status,
               (CASE l_partkey % 3 WHEN 0 THEN l_partkey WHEN 1 THEN -l_partkey END)::BIGINT AS value, printf('%f', l_tax) AS tax,
               (CASE WHEN a < b THEN CASE WHEN a + m <= b THEN 0 WHEN b + n <= a + m THEN 2 ELSE 4 END
                     WHEN a = b THEN CASE WHEN m <= n THEN 1 ELSE 2 END
                     ELSE CASE WHEN b + n <= a THEN 0 WHEN a + m <= b + n THEN 1 ELSE 3 END END)::BIGINT AS relation
        FROM (SELECT *, l_partkey % 50 AS a, 20 AS m, l_suppkey % 50 AS b, l_linenumber * 4 AS n FROM lineitem)
    """,
    "large_numbers": """
        SELECT o_orderkey, (CASE o_orderkey % 6 WHEN 1 THEN 65536 WHEN 4 THEN 65536 ELSE 0 END)::BIGINT AS status,
               (CASE o_orderkey % 6 WHEN 0 THEN 9007199254740993 WHEN 2 THEN -o_custkey * 100000000000 WHEN 3 THEN 31 WHEN 5 THEN o_custkey * 1000 + 750 END)::BIGINT AS value
        FROM orders
    """,
    "packed_bits": """
        SELECT c_custkey, lower(lpad(to_hex(c_custkey & 255), 2, '0') || lpad(to_hex((c_custkey >> 8) & 7), 2, '0')) AS packed,
               reverse(lpad(right(to_binary(c_custkey), 11), 11, '0')) AS bits, concat_ws('.', c_custkey >> 24 & 255, c_custkey >> 16 & 255, c_custkey >> 8 & 255, c_custkey & 255) AS address,
               '00:00:' || lower(concat_ws(':', lpad(to_hex(c_custkey >> 24 & 255), 2, '0'), lpad(to_hex(c_custkey >> 16 & 255), 2, '0'), lpad(to_hex(c_custkey >> 8 & 255), 2, '0'), lpad(to_hex(c_custkey & 255), 2, '0'))) AS mac,
               upper(lpad(to_hex(c_custkey & 255), 2, '0') || lpad(to_hex(c_custkey >> 8 & 255), 2, '0') || lpad(to_hex(c_custkey >> 16 & 255), 2, '0') || lpad(to_hex(c_custkey >> 24 & 255), 2, '0')) || '7F' AS runs
        FROM customer
    """,
    "digest_chains": """
        SELECT c_custkey, md5(unhex(md5(c_name))) AS again, md5(c_name) || md5(unhex(md5(c_name))) || repeat('00', 8) AS spread,
               hex(c_name) || repeat('00', (32 - strlen(c_name) % 32)::INT % 32) AS padded
        FROM customer
    """,
    "hash_fnv_folded": "SELECT c_custkey, true AS same, lower(c_name) = upper(c_name) AS plain FROM customer",
    "time_fields": """
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, year(ts)::BIGINT AS year, (epoch_us(ts) // 1000 % 1000)::BIGINT AS millis, true AS same,
               (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS of_day, strftime(ts, '%d.%m.%Y %H:%M:%S') AS fixed
        FROM events
    """,
    "zone_checks": """
        SELECT event_id, (CASE event_id % 4 WHEN 0 THEN e WHEN 1 THEN -3 WHEN 2 THEN -2 ELSE e + 12600000 END)::BIGINT AS millis
        FROM (SELECT event_id, epoch_ms(date_trunc('second', ts)) AS e FROM events)
    """,
    "tree_edits": """
        SELECT event_id, CASE WHEN k IS NULL THEN '{"K2":1' ELSE '{"K2":' || (k + 1) END || ',"inner":{"a":[1,2],"b":false}}' AS edited
        FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
    """,
    "tree_print": """
        SELECT p_partkey, E'{\\n  "name":"' || p_name || '", "size":' || p_size || E',\\n  "price":' || printf('%.1f', p_retailprice) || E'00000\\n}' AS printed FROM part
    """,
    "schema_findings": """
        SELECT event_id, '' AS path, 12060::BIGINT AS code, 3::BIGINT AS kind, 'event' AS detail FROM events
        UNION ALL SELECT event_id, '', 12060, 3, 'k' FROM events WHERE json_type(props, '$.k') IS NULL
    """,
    "tree_variables": "SELECT p_partkey, '0|x-' || p_brand || ' %none% %|%who%' AS expanded FROM part",
    "pair_texts": "SELECT p_partkey, (p_size % 2)::BIGINT AS status, p_name AS a, 'x,' || p_brand AS names FROM part",
    "option_values": """
        SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '9002:n' ELSE '9001:bad' END AS errors, p_size || ',cm' AS sizes, (CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END)::BIGINT AS n FROM part
    """,
    "cell_lists": "SELECT p_partkey, p_name || '|' || p_size || '|0201|' || p_name AS cells FROM part",
    "hash_fnv": """
        SELECT c_custkey, (list_reduce(list_prepend(2166136261::UHUGEINT, list_transform(range(1, length(c_name) + 1), lambda i: ascii(substring(c_name, i::INT, 1))::UHUGEINT)),
               lambda h, b: xor((h * 16777619) % 18446744073709551616::UHUGEINT, b)))::VARCHAR AS fnv
        FROM customer
    """,
    "file_listing": "SELECT 'region.parquet' AS name, true AS filled",
}
