import hashlib
import io
import random
import re
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandal.llm import chat, components, fingerprint, langid, mixing, packing, quality, secrets, similarity, toxicity, warc
from strandal.llm.base import session_conf, stage

EMPTY = "doc_id long, text string, lang string, source string, n_chars long, extra int, value string"
WORDS = [f"w{i}" for i in range(4000)]


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), "s", len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EMPTY)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def brute_groups(texts, k, percent):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_similarity_against_brute_force(spark, k, percent):
    rng = random.Random(k)
    texts = [None, "", " \n\t", "One", "one", "two words", "TWO WORDS"]
    for size in (8, 15, 40, 150, 400):
        base = prose(rng, size)
        texts += [base, base] + [edited(rng, base, rng.randint(1, 6)) for _ in range(30)]
    passage = prose(rng, 60)  # shared by documents that are otherwise unlike
    texts += [prose(rng, 50) + " " + passage + " " + prose(rng, 50) for _ in range(60)]
    texts.append(prose(rng, 20_000))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity.similarity_groups(docs_of(spark, texts), k=k, percent=percent).collect()}
    assert got == brute_groups(texts, k, percent)


def template_docs(n):
    """Copies of one template of 200 words with two words of their own, just below the threshold of op1."""
    rng = random.Random(n)
    base = prose(rng, 200)
    return [edited(rng, base, 2) for _ in range(n)]


def test_similarity_of_templates_grows_in_proportion(spark):
    rows = {}
    for n in (150, 300):
        texts = template_docs(n)
        join = similarity.Join(docs_of(spark, texts), "doc_id", "text", 4, 85)
        seen = []
        near = join.near
        join.near = lambda pairs, near=near, seen=seen: [seen.append(pairs.count()), near(pairs)][1]
        got = {r.doc_id: r.component_id for r in join.result().collect()}
        join.scratch.drop()
        assert got == {i: c for i, (_, c) in brute_groups(texts, 4, 85).items()}
        rows[n] = sum(seen)
    assert rows[300] < 3 * rows[150]


def test_similarity_of_null_and_repeated_keys(spark):
    rng = random.Random(9)
    base = prose(rng, 80)
    rows = [(None, base), (None, base), (5, edited(rng, base, 1)), (5, prose(rng, 40)), (3, edited(rng, base, 1)), (None, prose(rng, 30)), (8, None), (8, "")]
    got = similarity.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85).collect()
    assert sorted((str(r.doc_id), r.n_shingles > 0, str(r.component_id)) for r in got) == sorted(
        [("None", True, "3"), ("None", True, "3"), ("5", True, "3"), ("5", True, "5"), ("3", True, "3"), ("None", True, "None"), ("8", False, "8"), ("8", False, "8")]
    )


def regular_words(n=1024):
    """Two different words whose polynomial hashes modulo 2**64 agree for every base."""
    a = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_long_regular_words_differ(spark):
    a, b = regular_words()
    got = similarity.similarity_groups(docs_of(spark, [a, b, a + " x y z", b + " x y z"]), k=4, percent=85).collect()
    assert sorted(r.component_id for r in got) == [0, 1, 2, 3]


def test_similarity_of_nothing(spark):
    assert similarity.similarity_groups(docs_of(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long"), stage).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))


def test_sketch_bounds_difference():
    rng = np.random.default_rng(1)
    for n in (5, 80, 700):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n, dtype=np.uint64)])
        assert similarity.least_difference(similarity.sketch(np.unique(a)), similarity.sketch(np.unique(b))) <= len(np.setxor1d(a, b))


def test_chat_escapes_and_layouts():
    for t in ("", "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>x", "<\\/s> <\\\\/s>", "a<", "\\"):
        assert chat.unescape(chat.escape(t)) == t
        segment, a, b = chat.format_turn("assistant", t)
        assert [x[:2] for x in chat.parse(segment + segment)] == [("assistant", t)] * 2 and chat.unescape(segment[a:b]) == t
    known = {}
    turns = lambda r: chat.turns_of(r, known)[2]
    assert turns('{"instruction": "a", "input": "b", "output": "c"}') == [("user", "a\n\nb"), ("assistant", "c")]
    assert turns({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}) == [("user", "a"), ("assistant", "")]
    assert turns({"messages": [{"role": "system", "content": "s"}]}) == [("system", "s")]
    assert turns({"prompt": "p", "completion": "q"}) == [("user", "p"), ("assistant", "q")]
    assert turns("not json") == [] and turns({"zzz": 1}) == []
    assert len(known) == 6


def test_chat_read_back(spark):
    rows = [(1, 1, "assistant", "y"), (1, 0, "user", None), (1, 2, None, "<|end|>"), (2, 0, "assistant", "é" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_records(df, "conv_id", F.col("turn"), F.struct("role", "text"))).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\ny\n\n<|end|>\n").hexdigest()
    assert got[1].loss_chars == 1 and got[2].loss_sha256 == hashlib.sha256(("é" * 5000).encode()).hexdigest()
    assert chat.read_back(chat.format_records(df.limit(0), "conv_id", F.col("turn"), F.struct("role", "text"))).count() == 0


def test_quality_repeats(spark):
    texts = [None, "", "a b c a b c", "a b", "x\nx\n \n \nx", "a b c d " * 50, "# $"]
    got = {r.doc_id: r for r in quality.apply_rules(docs_of(spark, texts)).collect()}
    assert [got[i]["_q_n_repeat_words"] for i in range(7)] == [0, 0, 6, 0, 0, 200, 0]
    assert got[4]["_q_n_dup_lines"] == 2 and got[6]["_q_n_symbols"] == 2 and got[0]["_q_n_words"] == 0 and not got[0]["_q_kept"]


def test_language_parse_against_plain_search():
    sample = "the quick brown fox jumps over the lazy dog and the cat"
    model = langid.Model({"a": sample, "b": "zwei kleine katzen und ein hund"})
    text = "the cat and ein hund über alles " * 20

    def phrases(text, sample):
        n = 0
        for block in range(0, len(text), langid.BLOCK):
            part, i = text[block : block + langid.BLOCK], 0
            while i < len(part):
                j = i + 1
                while j <= len(part) and part[i:j] in sample:
                    j += 1
                i = max(i + 1, j - 1)
                n += 1
        return n

    assert model.phrases([text, ""]).tolist() == [[phrases(text, sample), phrases(text, "zwei kleine katzen und ein hund")], [0, 0]]


def test_language_of_odd_texts(spark):
    docs = docs_of(spark, ["the the the the", None, "123 456", ""])
    got = {r.doc_id: r for r in langid.identify(docs, {"en": "the cat the dog", "de": "der hund"}).collect()}
    assert got[0]["_l_lang"] == "en" and all(got[i]["_l_lang"] == "und" and got[i]["_l_score"] == 0 for i in (1, 2, 3))
    assert langid.learn(docs.limit(0), "text", "lang", "doc_id") == {}
    assert {r["_l_lang"] for r in langid.identify(docs, {}).collect()} == {"und"}


#: Ordinary text: a pangram would have letters far more evenly than any corpus.
PROSE = (
    "In the morning the people of the town went down to the river to see the boats come in. Some of them had been there since dawn, and the children ran along "
    "the bank and called out to the men on the water. There were 3 boats in 1998 and there are 12 of them now. The old men sat on a bench in the shade and talked "
    "about the weather and the price of fish, as they do on all days that are not too cold. "
) * 20


def prose_excess():
    counts = dict.fromkeys(range(128), 0) | {ord(c): PROSE.count(c) for c in set(PROSE)}
    return secrets.excess_of(counts)


def test_secrets():
    excess = prose_excess()
    base, extra = secrets.find_secrets('é Token = "abc123456" AKIA' + "A1" * 8 + " " + "0af" * 8 + " pass=x", excess)
    assert [s[0] for s in base] == ["assign", "access", "hex"] and base[0][1:] == (2, 20)
    _, extra = secrets.find_secrets("plain words then kX9vB2qLr8Tz4WmP7cYn3HdJ6sFg1QaEuZ5x and internationalization_of_the_process2 again", excess)
    assert [s[0] for s in extra] == ["random_base64"]
    assert secrets.find_secrets(None, excess) == ([], []) and secrets.redact("ab secret", [("x", 3, 9)]) == "ab [secret]"


def test_random_tokens_are_found_and_words_are_not():
    """Keys without any context, letters alone among them, against compounds, paths, numbers and repeats of one symbol."""
    rng, excess = random.Random(5), prose_excess()
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", secrets.ENCODINGS["base64"]]
    for alphabet in alphabets:
        keys = ["".join(rng.choice(alphabet) for _ in range(rng.randint(24, 48))) for _ in range(200)]
        hits = sum(any(a <= 10 and b >= 10 + len(k) - 2 for _, a, b in secrets.random_spans("some word " + k + " end", excess)) for k in keys)
        assert hits >= 0.9 * len(keys)
    plain = ["thepeopleofthetownwentdowntotheriver", "people-of-all-the-old-towns-on-the-river", "a" * 40, "12345678901234567890123", "home/pictures/summer/boats/at/the/river", "ab" * 20]
    assert not any(secrets.random_spans(f"see {p} here", excess) for p in plain)


def brute_spans(text):
    """The base patterns by plain scanning."""
    out, low = [], text
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(1)) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for kind, order, first, rest, least in (("access", 1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", 2, "", "0123456789abcdef", 24)):
        at = 0
        while at < len(low):
            if low.startswith(first, at) and at + len(first) < len(low) and low[at + len(first)] in rest:
                end = at + len(first)
                while end < len(low) and low[end] in rest:
                    end += 1
                if end - at >= least:
                    out.append((at, order, kind, end))
                at = end
            else:
                at += 1
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_secret_query(spark, tmp_path):
    """op5 over a written table with nulls, empty, long and repeated texts and clashing columns."""
    texts = [None, "", "token=abc12345 x", "token=abc12345 x", "passwd: short", "AKIA" + "B2" * 10, "deadbeef" * 4, "é secret='" + "q" * 9 + "' " + "word " * 50_000 + "api_key:zzzzzz1"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, _s_text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in secrets.query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(got[i].spans.split(",")) | {""}
    assert secrets.scan(df, prose_excess(), clean=True).columns.count("_s_text") == 1
    assert secrets.scan(df.limit(0), secrets.symbol_excess(df.limit(0))).count() == 0


def test_mixing(spark):
    assert mixing.source_targets([("a", 10), ("b", 1000), (None, 90)]) == {"a": 30.0, None: 270.0, "b": 800.0}
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "b", "b", None]), rng.randint(1, 50)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    plan = mixing.plan_mix(df, "size", "source", ["doc_id"])
    out = mixing.apply_mix(df, plan, "source", ["doc_id"], "size").groupBy("source").agg(F.sum(F.col("size") * F.col("_m_copies")).alias("t"), F.first("_m_target").alias("g"), F.max("_m_copies").alias("m")).collect()
    assert len(out) == 3 and all(abs(r.t - r.g) < 0.01 * r.g and r.m <= 3 for r in out)
    assert mixing.apply_mix(df.limit(0), mixing.plan_mix(df.limit(0), "size", "source", ["doc_id"]), "source", ["doc_id"]).count() == 0


def test_mixing_runs_as_many_jobs_on_many_partitions(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    plans, jobs = [], []
    for parts in (2, 48):
        with session_conf(spark, spark__sql__shuffle__partitions=parts, spark__sql__adaptive__coalescePartitions__enabled="false"):
            spark.sparkContext.setJobGroup(f"mix-{parts}", "")
            plans.append(sorted(map(str, mixing.plan_mix(df, "size", "source", ["doc_id"]).collect())))
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"mix-{parts}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert plans[0] == plans[1] and 0 < jobs[1] <= jobs[0] + 2


def test_packing(spark):
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    assert np.allclose(a @ packing.nnls(a, np.array([4.0, 3])), [4, 3])
    counts = {1: 500, 7: 90, 20: 300, 33: 41, 63: 499}
    used = {b: 0 for b in counts}
    for use, times in packing.plan_fillings(counts):
        assert sum(b * k for b, k in use.items()) == packing.BINS
        for b, k in use.items():
            used[b] += k * times
    assert all(used[b] <= counts[b] for b in counts) and used[63] == 499
    rng = random.Random(5)
    texts = [None, "", "Été, déjà-vu. <|endoftext|>", *[prose(rng, rng.choice([3, 40, 700, 6000])) for _ in range(40)]]
    texts += [texts[-1]]
    rows = packing.pack_documents(docs_of(spark, texts)).collect()
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path(packing.TOKENIZER))
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW and at & (at - 1) == 0
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "u", "a" * 100), (2, "u\nv", "a" * 100), (3, None, None), (4, "", "a" * 99), (5, "", "a" * 99), (0, "z", "é" * 60), (9, "z", "é" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    packages = warc.write_packages(warc.plan_records(df, "page_id", "url", "html"), f"file://{tmp_path}/w")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.read_packages(packages).collect()}
    kinds = {1: None, 2: 1, 3: None, 4: None, 5: None, 0: None, 9: 0}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i] == (len(raw), "response" if kinds[i] is None else "revisit", kinds[i], hashlib.sha256(raw).hexdigest())
    empty = warc.write_packages(warc.plan_records(df.limit(0), "page_id", "url", "html"), f"file://{tmp_path}/e")
    assert warc.read_packages(empty).count() == 0


def test_zip64_directory():
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"hello")
        z.comment = b"note"
    raw = plain.getvalue()
    assert warc.stored_range(io.BytesIO(raw), warc.zip_members(io.BytesIO(raw), len(raw))["a"])[1] == 5
    end = raw.rfind(b"PK\x05\x06")
    count, size, at = struct.unpack_from("<HII", raw, end + 10)
    record = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    big = raw[:end] + record + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    start, n = warc.stored_range(io.BytesIO(big), warc.zip_members(io.BytesIO(big), len(big))["a"])
    assert big[start : start + n] == b"hello"


def test_toxicity(spark):
    rng = random.Random(7)
    texts = [prose(rng, 60) + (" vile scum" if i % 4 == 0 else "") for i in range(200)] + [None, ""]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = sum((got[i]["_t_p"] >= model[3]) == (i % 4 == 0) for i in range(200))
    assert right >= 190 and got[200]["_t_severity"] == got[201]["_t_severity"]
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.score(docs, None).count() == 202


def test_toxicity_of_rare_words(spark):
    rng = random.Random(8)
    texts, toxic = [], []
    for i in range(800):
        kind = i % 8  # 0: words of many toxic texts; 1: one of 12 words with few texts each
        more = " vile scum filth rot vermin swine crud muck slime" if kind == 0 else f" malo{i // 8 % 12}" if kind == 1 else ""
        texts.append(" ".join(rng.choices(WORDS[:300], k=30)) + more)
        toxic.append(int(kind < 2))
    docs = docs_of(spark, texts)
    model = toxicity.train(docs, spark.createDataFrame(list(enumerate(toxic))[:600], "doc_id long, toxic int"))
    got = {r.doc_id: r["_t_p"] >= model[3] for r in toxicity.score(docs, model).collect()}
    rare = [got[i] for i in range(600, 800) if i % 8 == 1]
    assert sum(rare) >= 0.8 * len(rare)
    assert sum(got[i] for i in range(600, 800) if i % 8 > 1) <= 8


def test_fingerprints(spark):
    texts = [None, "", " \n", "Straße  X", "STRASSE x", "ﬁne", "fine\n", "é", "é", "other"]
    df = docs_of(spark, texts).withColumn("p", fingerprint.digest(fingerprint.canonical(F.col("text"))))
    p = {r.doc_id: r.p for r in df.collect()}
    assert p[0] == p[1] == p[2] and p[3] == p[4] and p[5] == p[6] and p[7] == p[8] and len(set(p.values())) == 5
    g = {r.doc_id: (r.first_key if "first_key" in r else None, r.copies) for r in fingerprint.groups(docs_of(spark, texts), "doc_id").collect()}
    assert g[4] == (3, 2) and 9 not in g
    chain = {r.doc_id: r["_f_next"] for r in fingerprint.with_next(docs_of(spark, ["a", "b", "c"]).select("doc_id", "text"), "doc_id", "text").collect()}
    assert chain == {2: "b", 1: "a", 0: "c"}
    assert fingerprint.with_next(docs_of(spark, []).select("doc_id", "text"), "doc_id", "text").count() == 0


@pytest.mark.parametrize("collide", [False, True])
def test_fingerprint_query_groups_copies(spark, tmp_path, monkeypatch, collide):
    if collide:  # all texts in one bucket
        monkeypatch.setattr(fingerprint, "digest", lambda canon: F.lpad(F.substring(canon, 1, 0), 32, "0"))
    texts = ["one", "Two", "TWO ", "three", None, "", "two"]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.first_id, r.copies) for r in fingerprint.query(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 1), 1: (1, 3), 2: (1, 3), 3: (3, 1), 4: (4, 2), 5: (4, 2), 6: (1, 3)}


def test_chat_values_that_are_no_strings():
    turns = lambda r: chat.turns_of(r, {})[2]
    assert turns({"instruction": "2+2?", "input": None, "output": 4}) == [("user", "2+2?"), ("assistant", "4")]
    assert turns({"prompt": "p", "completion": {"a": [1, False]}}) == [("user", "p"), ("assistant", '{"a": [1, false]}')]


def test_pipeline_keeps_texts_with_a_close_lead(spark):
    import corpus_pipeline

    rows = [(i, "the cat sat", "ab"[i % 2], "s", 11, 1, "x") for i in range(20)] + [(20, "A.", "a", "s", 2, 1, "x"), (21, "1 2", "a", "s", 3, 1, "x")]
    got = corpus_pipeline.language(spark, spark.createDataFrame(rows, EMPTY), "").collect()
    assert {r.doc_id for r in got} == set(range(21))
