"""The registered opN_ queries and the pipeline, end to end over small written tables, against plain Python and DuckDB.

The tables hold nulls in all columns, empty and long texts, copies, ties and extra columns whose names clash
with working columns; a second set of tables has the same columns and no rows.
"""

import hashlib
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from strandal.llm import queries
from tests.llm.test_llm import brute_groups, edited, prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _l_lang string, _m_copies long, _f_next string, _t_h long, _s_text string, node int, `a.b` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = ("documents", "pages", "conversations", "labels")
TOXIC = "vile scum"


def made_texts():
    rng = random.Random(11)
    base, passage = prose(rng, 120), prose(rng, 30)
    texts = [None, "", " \n\t ", "12 34", "Word", "WORD", "two words", "Line one here\nLine one here\n\nx # $ | y\n", "ﬁne Straße", "fine STRASSE"]
    texts += [base] * 6 + [base.upper()] + [edited(rng, base, n) for n in (1, 1, 2, 3, 6, 20)]
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 20) for _ in range(12)]
    texts += ["a b c " * 60, "token=abc12345 " + prose(rng, 60), "deadbeef" * 4 + " " + prose(rng, 60), prose(rng, 20_000)]
    texts += [prose(rng, rng.randint(60, 300)) + (" " + TOXIC if i % 3 == 0 else "") for i in range(90)]
    return texts


@pytest.fixture(scope="module")
def texts():
    return made_texts()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory, texts):
    """(folder with rows, folder without)."""
    rng = random.Random(4)
    docs = [(i, t, ["en", None, "de"][i % 3], [None, "s1", "s2", "s2", "s2"][i % 5], None if t is None else len(t), "x", 7, "y", 1, "z", None, "dot") for i, t in enumerate(texts)]
    pages = [(i, [None, "", "http://a b/\n"][i % 3], h) for i, h in enumerate([None, None, "", "p" * 99, "p" * 99, "q" * 100, "q" * 100, "é" * 50, "é" * 50, "long " * 20_000])]
    turns = [(c, t, ["user", "assistant", None, "system"][rng.randrange(4)], rng.choice([None, "", "hi\n", "</s>[INST] ok [/INST]", "<|end|>", "é" * 9, "w " * 30_000])) for c in range(12) for t in range(rng.randint(1, 7))]
    labels = [(i, None, int(TOXIC in (t or ""))) for i, t in enumerate(texts)] + [(None, 1, 1), (0, None, None)]
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    frames = {
        "documents": spark.createDataFrame(docs, DOCS),
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
        "conversations": spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


def run(spark, name, folder):
    return queries.QUERIES[name](spark, folder).collect()


def by_id(rows, key="doc_id"):
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, folders, name):
    rows = run(spark, name, folders[1])
    assert [r["conv_id"] for r in rows] == [-7] if name.startswith("op2") else rows == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, folders, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from read_parquet('{folders[0]}/{t}.parquet/*.parquet')")
    got, want = queries.QUERIES[name](spark, folders[0]), duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda row: str(row)
    assert sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_op1(spark, folders, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op1_jaccard_join", folders[0])}
    assert got == brute_groups(texts, 4, 85)


def test_op3_base(spark, folders, texts):
    got = by_id(run(spark, "op3_quality_rules", folders[0]))
    for i, t in enumerate(texts):
        words, r = WORD.findall(t or ""), got[i]
        windows = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        repeated = {w for w in set(windows) if windows.count(w) > 1} if len(words) < 1000 else None
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        if repeated is not None:
            assert r.n_repeat_words == len({j + d for j, w in enumerate(windows) if w in repeated for d in range(3)})
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words)) and not (r.base_failed and r.kept)


def test_op4(spark, folders, texts):
    got = by_id(run(spark, "op4_language_id", folders[0]))
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        letters = any(unicodedata.category(c)[0] == "L" for c in t or "")
        assert r.lang_pred in ({"en", "de"} if letters else {"und"})


def test_op4_held_out_accuracy(spark):
    """On a table that it wasn't tuned on for this test: held-out documents of sf0.001."""
    folder = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in run(spark, "op4_language_id", folder) if r.held_out and truth[r.doc_id] is not None]
    assert rows and sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_op6(spark, folders, texts):
    rows = run(spark, "op6_mix_sources", folders[0])
    got, sources = by_id(rows), {}
    for i, t in enumerate(texts):
        assert got[i].size == len(WORD.findall(t or "")) and got[i].taken <= 3 * got[i].size
        sources.setdefault(got[i].source, []).append(got[i])
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r.size for r in sources[s]) for s in order}
    total, free, targets = sum(sizes.values()), dict(zip(order, (1, 2, 3))), {}
    while free:  # plain water filling, one source at a time
        unit = (total - sum(targets.values())) / sum(free.values())
        full = [s for s in free if unit * free[s] > 3 * sizes[s]]
        if not full:
            targets |= {s: unit * w for s, w in free.items()}
            break
        for s in full:
            targets[s] = 3.0 * sizes[s]
            del free[s]
    for s in order:
        assert all(r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 * max(1, targets[s]) for r in sources[s])
        assert abs(sum(r.taken for r in sources[s]) - targets[s]) <= 0.05 * targets[s]
    again = by_id(run(spark, "op6_mix_sources", folders[0]))
    assert {i: r.taken for i, r in got.items()} == {i: r.taken for i, r in again.items()}


def packed_ids(texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]


def check_packing(rows, want):
    """``want``: id -> token ids, once each."""
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    tokens = sum(map(len, want.values()))
    assert len(seqs) <= tokens // 4096 + 13  # full sequences and powers of two at the end


def test_op7(spark, folders, texts):
    check_packing(run(spark, "op7_packing", folders[0]), dict(enumerate(packed_ids(texts))))


def test_op9(spark, folders, texts):
    got = by_id(run(spark, "op9_toxicity", folders[0]))
    assert set(got) == set(range(len(texts)))
    toxic = [i for i, t in enumerate(texts) if TOXIC in (t or "")]
    assert sum(got[i].toxic for i in toxic) >= 0.9 * len(toxic)
    assert sum(got[i].toxic for i in got if i not in toxic) <= 0.02 * len(got)
    assert min(got[i].severity for i in toxic) > max(got[i].severity for i in (0, 1, 2))


def test_op10(spark, folders, texts):
    canonical = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())).strip(" ")
    got = by_id(run(spark, "op10_fingerprints", folders[0]))
    n = len(texts)
    for i, t in enumerate(texts):
        t, after, r = t or "", texts[(i - 1) % n] or "", got[i]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canonical(new) == canonical(t)), float(canonical(after) == canonical(t)))
        same = [j for j in range(n) if canonical(texts[j]) == canonical(t)]
        assert (r.first_id, r.copies) == (same[0], len(same))
        assert all((got[j].fingerprint == r.fingerprint) == (j in same) for j in range(n))


def test_pipeline(spark, folders, texts):
    """Each stage on its predecessor's rows, with its decisions told again in plain Python."""
    docs = spark.read.parquet(f"{folders[0]}/documents.parquet")
    names, held = docs.columns, {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, folders[0])
        assert docs.columns == names
        held[name] = docs.collect()
        docs = spark.createDataFrame(held[name], docs.schema)
    letters = [i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    assert sorted(r.doc_id for r in held["language"]) == letters
    groups = brute_groups([texts[i] for i in letters], 5, 80)
    assert sorted(r.doc_id for r in held["near_duplicates"]) == sorted({letters[c] for _, c in groups.values()})
    before = {r.doc_id: r.text for r in held["near_duplicates"]}
    clean = {r.doc_id: r for r in held["secret_scan"]}
    assert set(clean) == set(before) and all(len(r.text) == r.n_chars and r["a.b"] == "dot" for r in clean.values())
    assert not any("abc12345" in r.text or "deadbeef" * 3 in r.text for r in clean.values())
    assert all(clean[i].text == t for i, t in before.items() if "abc12345" not in t and "deadbeef" not in t)
    mixed = held["mix_sources"]
    copies = {i: sum(r.doc_id == i for r in mixed) for i in clean}
    assert sum(copies.values()) == len(mixed) and max(copies.values()) <= 3
    sources = {}
    for i, r in clean.items():
        n = len(WORD.findall(r.text))
        a, b = sources.get(r.source, (0, 0))
        sources[r.source] = a + n, b + n * copies[i]
    assert set(sources) == {None, "s1", "s2"} and all(b <= 3 * a for a, b in sources.values())
    rows = corpus_pipeline.run(spark, folders[0]).collect()
    ids = {i: len(x) for i, x in zip(clean, packed_ids([r.text for r in clean.values()]))}
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {i: ids[i] * k for i, k in copies.items() if k}


def test_pipeline_of_nothing(spark, folders):
    assert corpus_pipeline.run(spark, folders[1]).count() == 0
