from datetime import datetime

from pyspark.sql import functions as F

from strandal.functions import numbers, strings, times
from strandal.operators import ngrams
from strandal.sources import dialects


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_string_edits(spark):
    s = F.lit("0123456789AB")
    assert one(spark, strings.insert(s, 3, F.lit("adbce")), strings.erase(s, 20, 2), strings.find(s, "5", 2), strings.find(s, "x")) == ("012adbce3456789AB", "0123456789AB", 3, -1)
    parts = F.split(F.lit(",,a,,b"), ",")
    assert one(spark, strings.join(parts, "-"), strings.split_words(F.lit(",a,,b"), ",")) == ("a--b", ["a", "b"])
    assert one(spark, strings.collapse_spaces(F.lit(" a,  b . c")))[0] == " a,b .c"
    assert one(spark, strings.unescape(F.lit("a\\tb\\qc\\\\n")))[0] == "a\tbqc\\n"


def test_numbers(spark):
    got = lambda t, lo, hi: tuple(one(spark, numbers.parse_number(F.lit(t), lo, hi))[0])
    assert got("-32.768E3", -32768, 32767) == (0, -32768)
    assert got("0x1234", -32768, 32767) == (0, 0x1234)
    assert got("1.5E-1", 0, 9)[0] == 0
    assert got("12x", 0, 99) == (3, None)
    assert got("", 0, 9) == (-1, None)
    assert got("70000", -32768, 32767) == (0x10000, None)


def test_digests_and_ciphers(spark):
    assert one(spark, F.md5(F.lit("1234567")))[0] == "fcea920f7412b5da7be0cf42b8c93759"
    key, iv, data = F.lit(b"0123456789abcdef"), F.lit(b"0123456789abcdef"), F.lit(b"0-1-2-3-4-5-6-7-")
    assert one(spark, F.hex(numbers.encrypt(data, key)))[0] == "7CDFF3AD2DAD8EA60690647E0727BEE5"
    for mode in ("ECB", "CBC"):
        assert bytes(one(spark, numbers.decrypt(numbers.encrypt(data, key, mode, iv), key, mode, iv))[0]) == b"0-1-2-3-4-5-6-7-"
    text = F.lit(b"any length at all, 37 bytes of it....")
    assert bytes(one(spark, numbers.counter_mode(numbers.counter_mode(text, key, iv), key, iv))[0]) == b"any length at all, 37 bytes of it...."
    ok, payload = one(spark, numbers.unframe(numbers.frame(F.lit(b"abc"))))[0]
    assert ok and bytes(payload) == b"abc"


def test_times(spark):
    t = F.lit(datetime(2002, 1, 25, 16, 21, 32, 444000))
    assert one(spark, times.format_time("YYYY.MM.DD hh:mm:ss:cccc", t), times.format_time("YY cc", t), times.weekday(t)) == ("2002.01.25 16:21:32:0444", "02 44", 5)
    assert one(spark, times.parse_millis(F.lit("1970.01.02 00:00:00")), times.parse_millis(F.lit("1969-01-01 00:00:00")), times.parse_millis(F.lit("x"))) == (86_400_000, -1, -1)


def test_dialects(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "A": 2, "b": [true, 1.5, "x\\"y"],}'), (2, "{a = 0x44; b [1; 2], # note\n c { d: 'q' } }"), (3, "[1]"), (4, None)], "id int, t string")
    rows = dialects.read_nodes(df, "id", "t", loose=True)
    found = {(r.doc_id, r.path): r for r in rows.collect()}
    assert found[1, "b[2]"].str_v == 'x"y' and found[2, "a"].int_v == 68 and found[2, "c/d"].str_v == "q"
    assert found[3, ""].kind == "error" and found[4, ""].kind == "error"
    assert [tuple(r) for r in dialects.get_path(rows.where("doc_id = 1"), "/A").collect()] == [(1, "1")]


def test_tree_differences(spark):
    left = dialects.read_nodes(spark.createDataFrame([(1, '{"a": 1, "b": "x", "c": 2}')], "id int, t string"), "id", "t")
    right = dialects.read_nodes(spark.createDataFrame([(1, '{"a": 1.0, "b": 5, "d": 9}')], "id int, t string"), "id", "t")
    assert sorted((r.path, r.what) for r in dialects.differences(left, right).collect()) == [("b", "type"), ("c", "missing")]


def test_variables(spark):
    assert dialects.close_variables({"a": "(%b%)", "b": "c"}) == (0, {"a": "(c)", "b": "c"})
    assert dialects.close_variables({"a": "(%b%)", "b": "{%a%}"})[0] == -10
    assert dialects.close_variables({"a": "%z%"})[0] == 1
    assert one(spark, dialects.expand_variables(F.lit("a %% %v% %error%"), {"v": "value"}))[0] == "a % value %error%"


def test_ngram_walk(spark):
    a = (ngrams.Alphabet(1, "ab ", 2), ngrams.Alphabet(2, "12", 1))
    counts, bad = ngrams.walk("ab 1a?", a)
    assert bad == 1 and counts[1, "", "char", "a"] == 2 and counts[1, "ab", "char", " "] == 1 and counts[1, "b ", "switch", "2"] == 1 and counts[2, "1", "switch", "1"] == 1
    learned = ngrams.learn(spark.createDataFrame([("ab 1a?",), (None,)], "t string"), "t", a)
    p = ngrams.probabilities(learned, a).groupBy("alphabet", "prefix").agg(F.sum("p").alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-9 for r in p)
