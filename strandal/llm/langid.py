"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the
longest matches found in that language's text; the language that needs the fewest phrases per
character wins. The automata of all languages lie in one table of interleaved rows, built on the
driver and broadcast, and texts are cut into fixed blocks that step through it in lockstep, so that one
vector operation moves all blocks of a batch by one character in every language. Whole texts are parsed; a
block boundary costs at most one phrase in each language alike.

Learning takes at most ``SAMPLE_CHARS`` characters for each language (a documented bound), in windows of
``WINDOW_CHARS`` at hashed places of rows in the order of a hash. All languages and all characters of the samples
count, whatever their number; a character that no sample has matches nothing.

A null text or one without a letter is ``und`` with score 0. Of languages with equally few phrases the first
by name wins, with score 0. Rows are independent: repeated rows get equal results, and very long texts are
worked in blocks; an empty table gives an empty result; no labelled row at all gives ``und``. Other columns are
untouched, but that those named ``_l_lang``, ``_l_score`` or ``_l_rate`` are replaced.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import schema_with, ship, table, tidy

SAMPLE_CHARS = 24_000
WINDOW_CHARS = 400
BLOCK = 256
LANES = 4096  # blocks that step together
OUT = ["_l_lang", "_l_score", "_l_rate"]


def _fold(text: str) -> str:
    return text.lower()


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


def interleave(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each state, owner of each slot, target of each slot): sparse rows laid over one another.

    A state's row starts at its place, which no other state has; slot ``place + code`` is its edge if it owns the
    slot. Rows with many edges are placed first, each at the first of a fixed sequence of tries that fits.
    """
    order = sorted(range(len(rows)), key=lambda s: -len(rows[s]))
    edges = sum(map(len, rows))
    size = 2 * edges + 2 * len(rows) + width + 64
    owner = np.full(size + width + 1, -1, np.int32)
    place = np.full(len(rows), -1, np.int32)
    used = np.zeros(size, bool)
    singles = 0
    rng = np.random.default_rng(len(rows))
    for n, s in enumerate(order):
        if len(rows[s]) <= 1:
            singles = n
            break
        codes = np.fromiter(rows[s], np.int64, len(rows[s]))
        while True:
            tries = rng.integers(1, size, 64)
            fits = ~used[tries] & (owner[tries[:, None] + codes] < 0).all(1)
            if fits.any():
                at = int(tries[np.argmax(fits)])
                break
        place[s], used[at] = at, True
        owner[at + codes] = at
    else:
        singles = len(order)
    one = [s for s in order[singles:] if rows[s]]
    codes = np.array([next(iter(rows[s])) for s in one], np.int64)
    left = np.arange(len(one))
    while len(left):  # all at once; of two that want one place or slot, the first gets it
        at = rng.integers(1, size, len(left))
        slot = at + codes[left]
        fits = ~used[at] & (owner[slot] < 0)
        for values in (at, slot):
            _, head = np.unique(values, return_index=True)
            mark = np.zeros(len(left), bool)
            mark[head] = True
            fits &= mark
        place[np.array(one)[left[fits]]] = at[fits]
        used[at[fits]] = True
        owner[slot[fits]] = at[fits]
        left = left[~fits]
    free = np.flatnonzero(~used[1:]) + 1
    bare = [s for s in order[singles:] if not rows[s]]
    place[bare] = free[: len(bare)]
    target = np.zeros(len(owner), np.int32)
    for s, row in enumerate(rows):
        for c, t in row.items():
            target[place[s] + c] = place[t]
    return place, owner, target


class Model:
    """The automata of all languages; about 16 bytes for each edge, of which a sample of n characters has up to 3 n."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        folded = {k: _fold(v) for k, v in samples.items()}
        chars = sorted({c for v in folded.values() for c in v})
        self.width = len(chars) + 1  # the last code is that of all characters that no sample has
        self.chars = np.array([ord(c) for c in chars], np.uint32)
        rows: list[dict[int, int]] = []
        roots = []
        for k in self.langs:
            found = suffix_automaton(np.searchsorted(self.chars, np.frombuffer(folded[k].encode("utf-32-le", "surrogatepass"), np.uint32)).tolist())
            roots.append(len(rows))
            rows += [{c: t + roots[-1] for c, t in row.items()} for row in found]
        place, self.owner, self.target = interleave(rows, self.width)
        # what follows each language's root; 0, which is no state's place, where it lacks the character
        self.first = np.zeros((len(self.langs), self.width), np.int32)
        for j, r in enumerate(roots):
            for c, t in rows[r].items():
                self.first[j, c] = place[t]

    def codes_of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lut = getattr(self, "_lut", None)
        if lut is None:
            lut = self._lut = np.full(0x3000, len(self.chars), np.int32)
            low = self.chars[self.chars < 0x3000]
            lut[low] = np.arange(len(low))
        out = lut[np.minimum(points, 0x2FFF)]
        high = np.flatnonzero(points >= 0x2FFF)
        if len(high):
            at = np.minimum(np.searchsorted(self.chars, points[high]), len(self.chars) - 1)
            out[high] = np.where(self.chars[at] == points[high], at, len(self.chars)) if len(self.chars) else 0
        return out

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrase counts, a row per text and a column per language."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not self.langs or not texts:
            return out
        folded = [_fold(t) for t in texts]
        lengths = np.array([len(t) for t in folded], np.int64)
        codes = self.codes_of("".join(folded))
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        if not len(owner):
            return out
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(lengths) - lengths, blocks) + nth * BLOCK
        size = np.minimum(lengths[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        for a in range(0, len(order), LANES):
            part = order[a : a + LANES]
            counts = self._parse(codes, start[part], size[part])
            for j in range(len(self.langs)):
                out[:, j] += np.bincount(owner[part], counts[j], len(texts)).astype(np.int64)
        return out

    def _parse(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Lanes are sorted by falling size, so the live ones are always a prefix."""
        langs, lanes = len(self.langs), len(start)
        steps = int(size[0])
        grid = codes[np.minimum(start[None, :] + np.arange(steps)[:, None], len(codes) - 1)]
        live = np.searchsorted(-size, -np.arange(steps), "left")  # lanes with size > step
        state = np.zeros((langs, lanes), np.int32)
        count = np.zeros((langs, lanes), np.int32)
        for t in range(steps):
            n = int(live[t])
            c = grid[t, :n]
            at = state[:, :n]
            slot = at + c
            to = self.target[slot]
            fail = self.owner[slot] != at
            count[:, :n] += fail
            np.copyto(to, self.first[:, c], where=fail)
            state[:, :n] = to
        return count


def learn(df: DataFrame, text: str, lang: str, order_by: str, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """At most ``chars`` characters for each language, from rows picked by a hash.

    Languages are counted without reading texts; the counts give each language a hash threshold under
    which about twice the rows that are needed lie, and one scan brings a window of each of those rows. The
    driver holds one count and one sample for each language.
    """
    counts = df.groupBy(lang).count().collect()
    if not counts:
        return {}
    rows = -(-chars // WINDOW_CHARS) * 2
    unit = F.pmod(F.xxhash64(order_by), F.lit(1 << 40))
    shares = df.sparkSession.createDataFrame([(r[0], min(1 << 40, (rows << 41) // r[1])) for r in counts], "_l_key string, _l_below long")
    picked = df.join(F.broadcast(shares), F.col(lang) == F.col("_l_key")).where((unit < F.col("_l_below")) & F.col(text).rlike("\\p{L}"))
    place = F.pmod(F.xxhash64(order_by, F.lit(1)), F.greatest(F.lit(1), F.length(text) - WINDOW_CHARS + 1).cast("long")).cast("int") + 1
    window = F.substring(F.col(text), place, F.lit(WINDOW_CHARS))
    # where rows share a hash, more than twice the rows that are needed may lie under the threshold
    found = picked.select(F.col(lang).alias("l"), unit.alias("h"), window.alias("t")).orderBy("h", "t").limit(4 * rows * len(counts)).collect()
    out: dict[str, list[str]] = {}
    for r in found:
        out.setdefault(r.l, []).append(r.t)
    return {k: "\n".join(v)[:chars] for k, v in out.items()}


def _has_letter(text: str) -> bool:
    return text.isascii() and any(map(str.isalpha, text)) or any(unicodedata.category(c)[0] == "L" for c in text)


def _predict(batches, shared, text: str, keep_text: bool):
    model = shared.value
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        langs, scores, rates = [], [], []
        at = 0
        while at < len(texts):
            to, n = at, 0
            while to < len(texts) and (to == at or n + len(texts[to]) <= 1 << 20):
                n += len(texts[to])
                to += 1
            part = texts[at:to]
            found = model.phrases(part)
            for t, row in zip(part, found):
                if not model.langs or not _has_letter(t):
                    langs.append("und"), scores.append(0.0), rates.append(1.0)
                    continue
                ranked = np.argsort(row, kind="stable")
                best, second = int(row[ranked[0]]), int(row[ranked[1]]) if len(row) > 1 else len(t)
                langs.append(model.langs[ranked[0]])
                scores.append(min(1.0, max(0.0, 1.0 - best / second)) if second else 0.0)
                rates.append(best / len(t))
            at = to
        keep = [c for c in batch.schema.names if keep_text or c != text]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
            names=[*keep, *OUT],
        )


def identify(df: DataFrame, samples: dict[str, str], text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df``, without its text unless that is to be kept, plus ``_l_lang``, ``_l_score`` (the lead over the runner-up, 0 to 1) and ``_l_rate`` (phrases a character)."""
    spark, df = df.sparkSession, df.drop(*OUT)
    ship(spark)
    shared = spark.sparkContext.broadcast(Model(samples))  # some 50 bytes for each character of the samples
    keep = [f for f in df.schema if keep_text or f.name != text]
    return df.mapInArrow(lambda it: tidy(_predict(it, shared, text, keep_text)), schema_with(keep, "_l_lang string, _l_score double, _l_rate double"))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = learn(training_rows(docs), "text", "lang", "doc_id")
    out = identify(docs.select("doc_id", "text"), samples)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), F.col("_l_lang").alias("lang_pred"), F.col("_l_score").alias("score"), F.col("_l_rate").alias("phrase_rate"))
