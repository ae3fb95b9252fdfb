"""Trees, options, coders, files and streams, on inputs of our own but where marked as fixed."""

import random
import sys

import hypothesis.strategies as st
import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F

from strandal.functions import numbers, strings, times
from strandal.operators import coding, lockstep, ngrams
from strandal.operators.ngrams import Alphabet
from strandal.plans import documents, registry
from strandal.sources import dialects, files, options, trees
from strandal.streaming import count_stream, finding_stream, text_stream

# Learning texts, and inputs whose coded sizes are known.
LEARN_ONE = "\n\tabcde abcde abcde abcde abcde abcde\n\tabcde.abcde.abcde.abcde.abcde.abcde\n\taaaaa,aaaaa,aaaaa,aaaaa,aaaaa,aaaaa,\n\t"
LEARN_TWO = "\n\tabcde abcde abcde abcde abcde abcde\n\t0123456789.0123456789.0123456789.0123456789.\n\tabcde.abcde.abcde.abcde.abcde.abcde\n\taaaaa,aaaaa,aaaaa,aaaaa,aaaaa,aaaaa,\n\t"
FIRST, SECOND = Alphabet(1, " ,.abcde", 1), Alphabet(2, " .:-0123456789", 0)


def even(chars):
    return {c: 1 / len(chars) for c in chars}


ONE, TWO = (coding.load_model(coding.save_model(coding.learn_model(t, a))) for t, a in ((LEARN_ONE, (FIRST,)), (LEARN_TWO, (FIRST, SECOND))))
FOUR = coding.switching([coding.Source(even(" ,.абвгдеёжзийклмнопрстуфхцчшщъыьэюя"), 100 / 6, False, 0.8), coding.Source(even(" ,.abcdefghijklmnopqrstuvwxyz"), 150 / 6, False, 0.6), coding.Source(even("0123456789."), 45, False, 1.0), coding.Source(even('()-_.?,:;"'), 2, True, 1.0)])
SIZES = [
    (coding.order0({"t": 4, "a": 1}), "ttttattttattttatttta", 3), (coding.order0({"t": 1}), "t" * 20, 1), (coding.equiprobable(" 0123456789abcdefghijklmnopqrstuvwxyz.,"), "test encoding 918", 13),
    (FOUR, "aaaaa aaaaa," * 5, 39), (FOUR, "aaaaa", 6), (FOUR, "a", 3), (FOUR, "test encoding. 918550 бвбвбвбвбвбв", 25),
    (ONE, "a" * 25, 5), (TWO, "a" * 25, 5), (TWO, "b" * 25, 44), (TWO, "abcde abcde abcde abcde a", 4), (TWO, "aaaaaaaaaa0123456789aaaaa", 10),
]


@pytest.mark.parametrize("model,text,size", SIZES)
def test_coded_sizes_and_round_trips(model, text, size):
    data = coding.encode_codes(model.codes(text))
    assert len(data) == size
    assert coding.decode_codes(data, coding.State(model)) == text and model.text_of([c for _, c in model.codes(text)]) == text


@settings(max_examples=60, deadline=None)
@given(st.text(" ,.abcde:-0123456789", max_size=80))
def test_any_text_returns(text):
    for model in (TWO, coding.equiprobable(" ,.abcde:-0123456789")):
        assert coding.decode_codes(coding.encode_codes(model.codes(text)), coding.State(model)) == text


def test_coding_columns(spark):
    df = spark.createDataFrame([("abc",), ("xyz",), (None,), ("",)], "s string")
    out = df.select("s", coding.encode(F.col("s"), ONE).alias("c"), coding.symbols(F.col("s"), ONE).alias("y"), coding.ideal_bits(F.col("s"), ONE).alias("b")).select("*", coding.decode(F.col("c.data"), ONE).alias("d")).collect()
    assert [(r.c.status, r.d.text) for r in out] == [(0, "abc"), (coding.UNKNOWN, None), (0, None), (0, "")]
    assert out[0].b > 0 and out[1].y is None


def test_probabilities_of_all_contexts(spark):
    """Rows of a known model."""
    counts = ngrams.learn(spark.createDataFrame([(LEARN_TWO,)], "t string"), "t", (FIRST, SECOND))
    p = {(r.alphabet, r.prefix, r.kind, r.symbol): round(r.p, 6) for r in ngrams.probabilities(counts, (FIRST, SECOND), all_contexts=True).collect()}
    assert (p[1, "", "char", "a"], p[1, "", "switch", "1"], p[1, "", "switch", "2"], p[1, "", "end", ""]) == (0.392345, 0.000061, 0.009340, 0.000488)
    assert (p[1, " ", "char", "a"], p[1, " ", "char", "b"]) == (0.998963, 0.000061)
    assert len({(a, x) for a, x, _, _ in p}) == 10 and ngrams.walk(LEARN_TWO, (FIRST, SECOND))[1] == 10


def slow_walk(text, alphabets):
    counts, bad, before, now, run = {}, 0, "\0", 0, ""

    def add(a, kind, symbol):
        for n in range(min(a.order, len(run)) + 1):
            key = a.id, run[len(run) - n :], kind, symbol
            counts[key] = counts.get(key, 0) + 1

    for c in text:
        skip, before = c == " " and before in " ,.!?:;-\n\a\t", c
        if skip:
            continue
        if c not in alphabets[now].chars:
            to = next((i for i, a in enumerate(alphabets) if c in a.chars), None)
            if to is None:
                bad += 1
                continue
            add(alphabets[now], "switch", str(alphabets[to].id))
            now, run = to, ""
        add(alphabets[now], "char", c)
        run = (run + c)[-3:]
    return counts, bad


@settings(max_examples=100, deadline=None)
@given(st.text(" ,.ab019-x\n", max_size=60))
def test_walk_by_runs(text):
    alphabets = (Alphabet(1, " ,.ab", 2), Alphabet(2, " .-019", 1))
    got, bad = ngrams.walk(text, alphabets)
    assert (dict(got), bad) == slow_walk(text, alphabets)


def test_one_bad_document_fails_nothing(spark):
    texts = ['{"a":9007199254740993}', '{"a":' + "9" * 30 + "}", '{"a":' + "7" * 5000 + "}", '{"a":' + "[" * 600 + "1" + "]" * 600 + "}", None, '{"a":{"x":1},"A":{"b":2},"a/c":5,"l":[1,2]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    nodes = dialects.read_nodes(df, "id", "t")
    got = {r.doc_id: (r.kind, r.int_v) for r in nodes.where("node_id = 0 or path = 'a'").orderBy("node_id").collect()}
    assert got[0] == ("int", 9007199254740993) and got[1] == got[2] == ("error", dialects.BAD_LEXEME) and got[3] == ("array", None) and got[4][0] == "error"
    value = lambda p: [tuple(r) for r in dialects.get_path(nodes.where("doc_id = 5"), p).collect()]
    assert value("a/x") == [(5, "1")] and value("a/b") == value("a/c") == value("l[1]") == []


def test_differences_are_exact(spark):
    read = lambda t: dialects.read_nodes(spark.createDataFrame([(1, t)], "id long, t string"), "id", "t")
    find = lambda a, b, **o: sorted((r.path, r.code) for r in dialects.differences(read(a), read(b), **o).collect())
    assert find('{"a":9007199254740993}', '{"a":9007199254740992}') == [("a", 2)]
    assert find('{"a":1,"b":"x","c":{"d":1},"e":[1,2],"-n":1}', '{"A":1.0,"b":1,"c":2,"e":[1]}') == [("b", 1), ("c", 5), ("c/d", 4), ("e[1]", 4)]
    assert find('{"a":1,"b":2}', "{}", ignore=("a",), ignore_keys=("b",)) == []


def test_variables_expand_once(spark):
    e = lambda t: spark.range(1).select(dialects.expand_variables(F.lit(t), {"a": "%b%", "b": "x"})).first()[0]
    assert [e(t) for t in ("%a%", "%B%%%", "%q% 5% \0", "%%b%%", "")] == ["%b%", "x%", "%q% 5% \0", "%b%", ""]


def test_numbers_at_bounds(spark):
    low, high = numbers.limits("int64")
    got = lambda t, a=low, b=high: tuple(spark.range(1).select(numbers.parse_number(F.lit(t), a, b)).first()[0])
    assert got("9007199254740993") == (0, 9007199254740993) and got("9223372036854775808")[0] == numbers.OVERFLOW and got("-9223372036854775809")[0] == numbers.UNDERFLOW
    assert got("1e9999999999")[0] == numbers.OVERFLOW and got("0X1F") == (0, 31) and got("7x") == (2, None) and got("2.9") == (0, 2)
    assert got(str(2**64 - 1), *numbers.limits("uint64"))[0] == 0
    # fixed values: the scaled double lies just above the bound
    assert got("32.767E3", *numbers.limits("int16"))[0] == numbers.OVERFLOW and got("-32.768E3", *numbers.limits("int16")) == (0, -32768)


def test_bytes_and_frames(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(numbers.unframe(F.lit(b"\xff\xff\xff\xff" + b"q" * 40))).ok is False and one(numbers.unframe(F.lit(b"12"))).ok is False
    assert one(numbers.hex_runs(F.lit("0x11223344 aa"))) == bytes.fromhex("44332211aa") and one(numbers.hex_runs(F.lit("123"))) is None
    assert one(numbers.unpack_bits(numbers.pack_bits(F.array(*map(F.lit, (1, 1, 0, 1)))))) == [1, 1, 0, 1, 0, 0, 0, 0]
    assert tuple(one(strings.utf8_check(F.lit("aé€😀".encode() + b"\xed\xa0\x80")))) == (False, "aé€😀")
    assert one(strings.from_code_page(F.lit("Щука".encode("cp1251")))) == "Щука" and one(strings.to_code_page(F.lit("щ€"))) == "щ".encode("koi8_r") + b"?"
    assert one(strings.unescape(F.lit("\\\\t\\t"))) == "\\t\t"
    assert one(times.parse_millis(F.lit("2020-01-01 00:00:00+13:00"))) == -3 and one(times.parse_millis(F.lit("2020-01-01 00:00:00 k"))) == -2


def test_trees():
    t = trees.parse('{"a":1,"B":{"c":[1,2.5,true],"d":"x"},"b":7}')
    assert trees.get(t, "b") is trees.get(t, "B") and trees.path(t, "b/D") == "x" and trees.at(trees.path(t, "b/c"), 3, "no") == "no"
    assert trees.put_path(t, "b/new", 5) and not trees.put_path(t, "zz/new", 5) and trees.path(t, "B/new") == 5
    assert trees.to_map(trees.parse('{"x":1,"X":2}'), "int") == {"x": 2} and trees.to_array([1, True], "int") == [1, 1]
    for v, kind in (("1", "int"), (1.5, "bool"), (None, "int"), (True, "float")):
        with pytest.raises(ValueError):
            trees.convert(v, kind)
    assert trees.convert(2.5, "str") == "2.500000" and trees.parse(trees.print_tree(t)) == t
    assert trees.demand(t, "a", "int") == 1 and pytest.raises(KeyError, trees.demand, t, "a", "str")
    w = trees.Writer().open("{").value(1, "a").open("[", "l").value("q").value(2).close().value(True, "z")
    assert w.text() == '{"a":1,"l":["q",2],"z":true}'
    long = trees.print_tree(trees.from_python({"l": list(range(100))}))
    assert long.count("\n") == 4 and trees.get(trees.parse(long), "l") == list(range(100))


def test_validation():
    schema = trees.parse('{name:{type:"x",mandatory:true},n:{type:[1,1.5]},in:{object:{q:{type:true,mandatory:true}}},l:{object:[{type:1},{object:{z:{type:1}}}]},"...":{type:"",mandatory:true}}', True)
    find = lambda t: [x[:2] for x in trees.validate(trees.parse(t), schema)]
    assert find('{"name":"a","n":2.5,"in":{"q":true},"l":[1,{"z":2}],"more":""}') == []
    assert find('{"name":"","n":"b","in":{},"l":["s",{"z":"t"}]}') == [("/name", trees.EMPTY_TEXT), ("/n", trees.WRONG_TYPE), ("/in", trees.MISSING), ("/l[0]", trees.WRONG_TYPE), ("/l[1]/z", trees.WRONG_TYPE), ("", trees.MISSING)]
    assert trees.validate(trees.parse('{"a":1}'), trees.parse("{a:{mandatory:true}}", True)) == [("/a", trees.NO_TYPE, "")]


def test_options():
    read = options.read_options("{options:[{keys:['v','verbose'],help:'talk'},{keys:['out'],id:9,need_value:true}]}")
    assert options.help_text(read).startswith("-- keys:v,verbose [], Desc:talk\n") and read[0].id == ord("v") and read[1].needs_value
    for text, code in (("{a:1}", options.NO_OPTIONS), ("{options:[{id:1}]}", options.NO_KEYS)):
        with pytest.raises(ValueError, match=str(code)):
            options.read_options(text)


def test_cells():
    t = trees.parse_cells("x=1; / a note\nbox { y = 'a b'; D\"0xff00\"; } k=E'%u%!'; f=F'n'; l=L'BOX/y'", read_file=lambda n: f"<{n}>", environment={"U": "v"})
    assert [trees.cell_path(t, p) for p in ("X", "box/Y", "box/1", "k", "f", "l", "none")] == ["1", "a b", b"\x00\xff", "v!", "<n>", "a b", None]
    with pytest.raises(dialects.Malformed):
        trees.parse_cells("a{b=1")


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, text in (("a.txt", '{"k":1}'), ("sub/b.txt", '{"k":"s"}'), ("c.txt", "x")):
        (tmp_path / "in" / name).write_text(text)
    where = str(tmp_path / "in")
    assert {(r.name, r.size) for r in files.list_files(spark, where).collect()} == {("a.txt", 7), ("b.txt", 9), ("c.txt", 1)}
    assert {len(r.digest) for r in files.file_hashes(spark, where).collect()} == {32}
    assert files.find_on_path(spark, [where, where + "/sub"], "b.txt").endswith("sub/b.txt") and files.find_on_path(spark, [where], "q") is None
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.txt").write_text('{"k":1}')
    assert {r.name: r.same for r in files.same_contents(spark, where, str(tmp_path / "two")).collect()} == {"a.txt": True, "sub/b.txt": None, "c.txt": None}
    df = spark.createDataFrame([(1, '{"z":3}'), (2, "a.txt")], "id long, s string")
    assert {(r.doc_id, r.path) for r in files.read_data_or_file(df, "id", "s", where).where("path <> ''").collect()} == {(1, "z"), (2, "k")}
    assert ngrams.learn_folder(spark, where, (FIRST,))[0] == ngrams.TOO_SHORT
    stream = finding_stream(text_stream(spark, where), "{k:{type:1}}").select("finding.code")
    run = stream.writeStream.format("memory").queryName("findings").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    run.awaitTermination(60)
    assert [r.code for r in spark.table("findings").collect()] == [dialects.BAD_ROOT]
    counts = count_stream(text_stream(spark, where), (Alphabet(1, "ks", 0),))
    run = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    run.awaitTermination(60)
    assert {r.symbol: r.n for r in spark.table("counts").where("kind = 'char'").collect()}.get("k") == 1


@pytest.mark.parametrize("model,chars", [(ONE, " ,.abcde"), (TWO, " ,.abcde0123456789:-"), (FOUR, " ,.abcdeабв0123()-?;"), (coding.order0({"t": 1}), "t"), (coding.order0({"t": 1e6, "a": 1}), "ttttttttta")])
def test_many_texts_are_coded_as_one(model, chars):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices(chars, k=n))
    texts = [None, "", "~", text(2000), *[text(rng.choice((1, 2, 9, 60))) for _ in range(60)], *[text(5) + "\U0001f600"] * 2]
    got = lockstep.encode(texts, model)
    assert got == [(0, None) if t is None else coding.encode_text(t, model) for t in texts]
    data = [d if i % 3 else d and bytes(rng.choices(range(256), k=len(d))) for i, (_, d) in enumerate(got)]
    assert lockstep.decode(data, model) == [(0, None) if d is None else coding.decode_text(d, model) for d in data]


def test_many_texts_take_few_calls():
    """A thousand texts of a batch are coded in turns together, so that one of them costs little beside one coded alone."""
    texts = [("abcde " * 10)[: 40 + i % 20] for i in range(1000)]
    calls = 0

    def count(*_):
        nonlocal calls
        calls += 1

    sys.setprofile(count)
    try:
        data = lockstep.encode(texts, ONE)
        back = lockstep.decode([d for _, d in data], ONE)
    finally:
        sys.setprofile(None)
    assert [t for _, t in back] == texts and calls < 100 * len(texts)


def test_narrow_intervals_keep_all_codes():
    """In an interval narrower than a row's sum some codes had no place, and coding them never ended."""
    first, row = [0, 16383, 32769, 65536], [0, *range(1, 31), 16411]
    width = 32768 - 16383 + 1
    empty = [c for c in range(30) if width * row[c] // row[-1] == width * row[c + 1] // row[-1]]
    assert empty and all(a < b for a, b in zip(coding.apart(row, width), coding.apart(row, width)[1:]))
    model = coding.Model([coding.Part({chr(97 + i): i for i in range(30)}, {}, 30, {"": row})], 0, {})
    for code in empty:
        data = coding.encode_codes([(first, 1), (row, code), (row, 30)])

        class Rows(coding.State):
            def row(self):
                return first if not self.run else row

            def take(self, code):
                got = super().take(code)
                self.run = "x"
                return got

        assert coding.decode_codes(data, Rows(model)) == chr(97 + 1) + chr(97 + code)


def test_turns_are_dealt_out(spark):
    """One small file is coded by all cores."""
    assert documents.coded_texts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_long_texts_take_no_stack(spark):
    """Text of 200,000 characters: patterns once called themselves for each, which ended the executor."""
    long = "aé" * 100_000
    df = spark.createDataFrame([(long, "k=v;" * 4_000, 'x"y z"' * 30_000)], "t string, p string, w string")
    whole, cut = (strings.utf8_check(x) for x in (F.encode("t", "UTF-8"), F.concat(F.encode("t", "UTF-8"), F.lit(b"\xff"))))
    row = df.select(whole["valid"].alias("whole"), cut["valid"].alias("cut"), (cut["text"] == F.col("t")).alias("head"), F.decode(strings.to_code_page(F.col("t")), "US-ASCII").alias("page"),
                    dialects.pairs(F.col("p"))["status"].alias("pairs"), F.size(dialects.arguments(F.col("w"))).alias("words")).first()
    assert tuple(row) == (True, False, True, "a?" * 100_000, 0, 1)


@pytest.mark.parametrize("page", ["koi8_r", "cp1251", "latin_1", "cp866"])
def test_code_pages(spark, page):
    texts = ["", "\0a\x7f\x80é", "Щука © ═ ₽ 😀", "[a-z]^\\\\", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(strings.to_code_page(F.col("t"), page)).collect()
    assert [None if r[0] is None else bytes(r[0]) for r in got] == [None if t is None else t.encode(page, "replace") for t in texts]
    data = bytes(range(256))
    assert spark.range(1).select(strings.from_code_page(F.lit(data), page)).first()[0] == data.decode(page, "replace")


def test_options_are_parsed_once(spark):
    """What a lambda names is computed for each element: the lists of a row are bound, so that many words stay few steps."""
    declared = options.read_options("{options:[{keys:['n'],id:1,need_value:true},{keys:['s'],id:2}]}")
    words = ["free", *[w for i in range(60) for w in (f"-n={i}", "/s", str(i), "", "t")], "-n", "-x=1"]
    df = spark.createDataFrame([(words,), ([],), (None,)], "w array<string>")
    out = df.select(options.parse_arguments(F.col("w"), declared).alias("got"))
    got, empty, none = (r.got for r in out.collect())
    assert [tuple(e) for e in got.errors] == [(options.NO_VALUE, "n"), (options.UNKNOWN, "x")] and len(got.options) == 122
    assert tuple(got.options[0]) == (None, None, ["free"]) and got.last == {1: [], 2: ["59", "t"]}
    assert empty.options == [] and not none.options
    assert out._jdf.queryExecution().analyzed().toString().count("split_part") == 1
    plan = documents.option_values(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("-name=") == 1


def test_bits_are_computed_once(spark):
    """A lambda computes what it names for each element: the bits before stand in the plan once."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.pmod(F.floor(F.col("id") / F.pow(F.lit(2.0), i.cast("double"))), F.lit(2)).cast("int"))
    out = spark.range(5, 2000, 700).select("id", numbers.unpack_bits(numbers.pack_bits(bits)).alias("b"))
    assert all(r.b == [r.id >> i & 1 if i < 11 else 0 for i in range(16)] for r in out.collect())
    assert out._jdf.queryExecution().optimizedPlan().toString().upper().count("POWER(") == 1
    plan = documents.packed_bits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().upper()
    assert plan.count("POWER(") == 1
    rows = spark.createDataFrame([([],), (None,), ([1, None, 1],), ([1] * 8 + [0, 1],)], "b array<int>").select(numbers.pack_bits(F.col("b"))).collect()
    assert [bytes(r[0]) if r[0] is not None else None for r in rows] == [b"", b"", b"\x05", b"\xff\x02"]


def test_leaves_are_read_without_a_shuffle(spark):
    """One row for each document, whatever its key, as SQL has it; the node table's groups were sorted and shuffled."""
    plan = registry.loose_config(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Sort", "Aggregate"))
    texts = ["{a: 1, b [x; 'y'], a: 3}", "{a: 2.5}", "{a: 'q', A: 7}", None, "{a:", "{}"]
    df = spark.createDataFrame([(1, t) for t in texts] + [(None, "{a: 4}")], "id long, t string")
    out = dialects.read_leaves(df, "id", "t", {"n": ("a", "long"), "s": ("b[1]", "string"), "d": ("a", "double")}, loose=True).collect()
    assert [tuple(r) for r in out] == [(1, 3, "y", None, 6), (1, None, None, 2.5, 2), (1, None, None, None, 3), (1, None, None, None, 1), (1, None, None, None, 1), (1, None, None, None, 1), (None, 4, None, None, 2)]
