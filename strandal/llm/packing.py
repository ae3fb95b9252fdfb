"""Packing token sequences by non-negative least squares over a length histogram.

A document's tokens are cut into full windows, one piece of a multiple of ``UNIT`` tokens, and a tail
of fewer. The histogram of pieces has ``WINDOW / UNIT`` bins whatever the corpus size. All combinations
of two to four lengths that fill a window exactly are columns of a least-squares problem whose
non-negative solution says how often each is used; it is rounded down, and further exact fillings are
found greedily in what is left of the histogram. Pieces that still have no place, and the tails, are
laid end to end and cut at window bounds; the last, incomplete window is cut into powers of two. So no
sequence has padding.

Each piece finds its place by its rank within its bin, counted in salted shares so that a bin with a
third of all pieces is spread over many tasks. The driver sees the histogram and the shares' sums only.

A null text is empty and has the end token alone. Repeated rows are packed each. An empty table gives an
empty result. The tokenizer's file is a parameter; special tokens inside texts are encoded as the
tokenizer's defaults say.
"""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import LOWER, ship, slices, span_hashes, stage, table, task_cache, text_bytes, tidy, word_spans

WINDOW, UNIT, END_ID = 4096, 64, 2
BINS = WINDOW // UNIT
DEPTH = 4
_END = np.array([END_ID], "<u4").tobytes()
TOKENIZER = "word_bpe_49k.json"
_CACHE_WORDS = 1_500_000  # some 40 bytes each
_encoders: dict[str, Encoder] = task_cache()


class Encoder:
    """The tokenizer behind a bounded word cache, worked in vectors.

    This tokenizer drops white space, lower-cases, and never joins over white space, so a text's ids are
    those of its words in turn, whatever their capitals. Words of a batch are hashed at once; a closing
    comma or full stop after a letter is a token of its own and is taken off first. Only words that the
    cache lacks reach the tokenizer: those of letters alone many to a string, told apart by the tokens
    that end a word. Texts with a possible special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        marks = [self._ids(m) for m in ",."]
        self.marks = np.array([0, *(m[0] for m in marks)], np.uint32) if all(len(m) == 1 for m in marks) else None
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known words
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # where their ids are in the pool
        self.pool = np.zeros(0, np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha() and max(w) < "ɐ" and "İ" not in w]  # each one pre-token
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(words[i] for i in g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(group):
                at = 0
                for i, to in zip(group, ends):
                    out[i] = ids[at:to]
                    at = to
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of a string column, without end tokens, and each row's first (one more at the end)."""
        data, offsets = text_bytes(column)
        low = LOWER[data]
        starts, ends = word_spans(low, offsets)
        first = np.searchsorted(starts, offsets)
        mark = np.zeros(len(starts), np.int64)
        if self.marks is not None and len(starts):
            last, before, lead = low[ends - 1], low[np.maximum(ends - 2, starts)], low[np.maximum(ends - 3, starts)]
            # a-z, or U+00C0 to U+00FF but for the signs of multiplication and division
            letter = ((before >= 97) & (before <= 122)) | ((lead == 0xC3) & (ends - 3 >= starts) & (before != 0x97) & (before != 0xB7))
            letter &= ends - starts > 1
            mark = np.where(letter & (last == 0x2C), 1, np.where(letter & (last == 0x2E), 2, 0))
            ends = ends - (mark > 0)
        h, inverse, where = span_hashes(low, starts, ends), None, None
        known, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, known)
        have = np.zeros(len(known), bool)
        inside = place < len(self.keys)
        have[inside] = self.keys[place[inside]] == known[inside]
        at, size, pool = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), self.pool
        at[have], size[have] = self.at[place[have]], self.size[place[have]]
        fresh = np.flatnonzero(~have)
        if len(fresh):
            raw = data.tobytes()
            ids = self._learn([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[where[fresh]].tolist(), ends[where[fresh]].tolist())])
            size[fresh] = [len(x) for x in ids]
            at[fresh] = len(pool) + np.cumsum(size[fresh]) - size[fresh]
            pool = np.concatenate([pool, *ids])
            if len(self.keys) < _CACHE_WORDS:
                self.keys, self.pool = np.insert(self.keys, place[fresh], known[fresh]), pool
                self.at, self.size = np.insert(self.at, place[fresh], at[fresh]), np.insert(self.size, place[fresh], size[fresh])
        n = size[inverse] + (mark > 0)
        stop = np.cumsum(n)
        begin = stop - n
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint32)
        shift = np.repeat(at[inverse] - begin, n)
        source = shift + np.arange(len(out))
        closing = np.flatnonzero(mark)
        source[stop[closing] - 1] = 0  # overwritten below
        out[:] = pool[source] if len(pool) else 0
        out[stop[closing] - 1] = self.marks[mark[closing]] if len(closing) else 0
        rows = np.concatenate((begin, [len(out)]))[first]
        if b"<|" in data.tobytes():
            parts = [out[rows[i] : rows[i + 1]] for i in range(len(column))]
            for i, t in enumerate(column.to_pylist()):
                if t and "<|" in t:
                    parts[i] = self._ids(t)
            out, rows = np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)
        return out, rows


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: bin: units of the piece (BINS: a full window; 0: a tail); crcs: of each unit, for pieces that may be cut; ids: of a tail.
PIECES = "doc_id {id}, start long, length int, ids_crc32 long, doc_tokens long, bin int, crcs array<long>, ids binary"


def _cut(batches, path: str):
    encoder = _encoder(path)
    names = [x.split()[0] for x in PIECES.split(", ")]
    for batch in batches:
        kind, text = batch.schema.field(0).type, batch.column(1)
        for first, last in slices(text):
            ids, rows = encoder.encode(text.slice(first, last - first))
            ids = ids.astype("<u4", copy=False)
            out = [[] for _ in range(8)]
            for key, a, b in zip(batch.column(0).slice(first, last - first).to_pylist(), rows[:-1].tolist(), rows[1:].tolist()):
                raw = ids[a:b].tobytes() + _END
                total, start = len(raw) // 4, 0
                while start < total:
                    left = total - start
                    size = WINDOW if left >= WINDOW else left // UNIT * UNIT or left
                    part = raw[4 * start : 4 * (start + size)]
                    unit = size // UNIT if size >= UNIT else 0
                    crcs = [zlib.crc32(part[i : i + 4 * UNIT]) for i in range(0, 4 * size, 4 * UNIT)] if 0 < unit < BINS else None
                    for column, v in zip(out, (key, start, size, zlib.crc32(part), total, unit, crcs, None if unit else part)):
                        column.append(v)
                    start += size
            types = [kind, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)


def cut_pieces(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """The pieces of every document, with checksums; rows are tokenized where they are."""
    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: tidy(_cut(it, tokenizer)), PIECES.format(id=rows.schema["doc_id"].dataType.simpleString()))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative x that minimises ``|a x - b|``, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    slope = a.T @ (b - a @ x)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(3 * n):
        if used.all() or slope[~used].max() <= tolerance:
            break
        used[int(np.argmax(np.where(used, -np.inf, slope)))] = True
        while True:
            s = np.zeros(n)
            s[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if s[used].min() > 0:
                x = s
                break
            low = used & (s <= 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(x[low] - s[low] != 0, x[low] / (x[low] - s[low]), 0).min()
            x = x + step * (s - x)
            used &= x > tolerance * 1e-3
            x[~used] = 0
            if not used.any():
                break
        slope = a.T @ (b - a @ x)
    return x


def fillings(target: int = BINS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of two to ``depth`` bins that add up to ``target``."""
    out = []
    for d in range(2, depth + 1):
        for head in itertools.combinations_with_replacement(range(1, target), d - 1):
            last = target - sum(head)
            if last >= head[-1]:
                out.append((*head, last))
    return out


def _fill_exactly(left: list[int], need: int) -> dict[int, int] | None:
    """Bins (with counts available in ``left``) that add up to ``need``, large ones first."""
    ways: dict[int, dict[int, int]] = {0: {}}
    for b in range(min(need, len(left) - 1), 0, -1):
        if left[b]:
            for s in sorted(ways):
                for k in range(1, min(left[b], (need - s) // b) + 1):
                    if s + k * b not in ways:
                        ways[s + k * b] = ways[s] | {b: k}
            if need in ways:
                return ways[need]
    return None


def plan_fillings(counts: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """(bin: pieces in a window, windows) for a histogram of bins 1 to BINS - 1. Never uses more than there is."""
    left = [0] * BINS
    for b, n in counts.items():
        left[b] = n
    out: list[tuple[dict[int, int], int]] = []
    total = np.array(left[1:], float)
    if total.any():
        combos = [c for c in fillings() if all(left[b] for b in c)]
        a = np.zeros((BINS - 1, len(combos)))
        for j, c in enumerate(combos):
            for b in c:
                a[b - 1, j] += 1
        repeats = np.floor(nnls(a, total) + 1e-9).astype(np.int64) if combos else np.zeros(0, np.int64)
        for b in range(1, BINS):  # rounding down may still overdraw a bin that the fit overshot
            over = int(a[b - 1] @ repeats) - left[b]
            for j in sorted(np.flatnonzero(a[b - 1] * repeats), key=lambda j: -repeats[j]):
                if over <= 0:
                    break
                take = min(int(repeats[j]), -(-over // int(a[b - 1, j])))
                repeats[j] -= take
                over -= take * int(a[b - 1, j])
        for j in np.flatnonzero(repeats):
            use = {b: combos[j].count(b) for b in set(combos[j])}
            out.append((use, int(repeats[j])))
            for b, k in use.items():
                left[b] -= k * int(repeats[j])
    for b in range(BINS - 1, 0, -1):
        while left[b] > 0:
            rest = list(left)
            rest[b] -= 1
            if (use := _fill_exactly(rest, BINS - b)) is None:
                break
            use = use | {b: use.get(b, 0) + 1}
            times = min(left[x] // k for x, k in use.items())
            out.append((use, times))
            for x, k in use.items():
                left[x] -= k * times
    return out


def windows(total: int, size: int) -> list[int]:
    """Where the incomplete last window's parts start, each a power of two long, after ``total // size`` full ones."""
    out, at = [], total // size * size
    while at < total:
        part = 1 << ((total - at).bit_length() - 1)
        out.append(at)
        at += part
    return out


def _spans(start: int, length: int, total: int, size: int):
    """(sequence, offset in it, length) of the stretch from ``start``: full windows, then the parts of the last."""
    full, parts = total // size, windows(total, size)
    end = start + length
    while start < end:
        if start < full * size:
            seq, base = start // size, start // size * size
            stop = base + size
        else:
            i = max(k for k, p in enumerate(parts) if p <= start)
            seq, base = full + i, parts[i]
            stop = parts[i + 1] if i + 1 < len(parts) else total
        n = min(end, stop) - start
        yield seq, start - base, n
        start += n


_ZEROS = bytes(4 * UNIT)
_ZERO_CRC = zlib.crc32(_ZEROS)


def _joined_crc(crcs: list[int]) -> int:
    """The CRC-32 of units laid end to end, from theirs."""
    out = 0
    for c in crcs:
        out = c ^ zlib.crc32(_ZEROS, out) ^ _ZERO_CRC
    return out


OUT = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _lay(batches, total: int, first_sequence: int, units: bool):
    """Pieces with a place ``at`` on a line of ``total`` units or tokens, cut at window bounds."""
    scale, size = (UNIT, BINS) if units else (1, WINDOW)
    for batch in batches:
        out = [[] for _ in range(7)]
        for r in batch.to_pylist():
            done = 0
            for seq, offset, n in _spans(r["at"], r["length"] // scale, total, size):
                crc = _joined_crc(r["crcs"][done : done + n]) if units else zlib.crc32(r["ids"][4 * done : 4 * (done + n)])
                for column, v in zip(out, (r["doc_id"], r["start"] + done * scale, n * scale, crc, r["doc_tokens"], first_sequence + seq, offset * scale)):
                    column.append(v)
                done += n
        types = [batch.schema.field("doc_id").type, *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=[x.split()[0] for x in OUT.split(", ")])


def _ranked(df: DataFrame, group: str, weight, name: str) -> DataFrame:
    """``name``: the sum of ``weight`` over all rows before a row in its group, in shares by salt."""
    salts = max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    share = df.groupBy(group, "_salt").agg(F.sum(weight).alias("_w"))
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = share.select(group, "_salt", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_base"))  # at most `salts` rows in a group
    within = Window.partitionBy(group, "_salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return df.join(base, [group, "_salt"]).withColumn(name, F.col("_base") + F.col("_within")).drop("_base", "_within", "_salt")


def pack(pieces: DataFrame) -> DataFrame:
    """A place for every piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    spark = pieces.sparkSession
    counts = {r[0]: (r[1], r[2]) for r in pieces.groupBy("bin").agg(F.count("*"), F.sum("length")).collect()}
    plan = plan_fillings({b: n for b, (n, _) in counts.items() if 0 < b < BINS})
    if BINS in counts:
        plan.append(({BINS: 1}, counts[BINS][0]))
    ranges: dict[int, list] = {b: [] for b in range(1, BINS + 1)}
    taken, sequence = dict.fromkeys(ranges, 0), 0
    for use, times in plan:
        offset = 0
        for b, k in sorted(use.items(), reverse=True):
            ranges[b].append((taken[b], taken[b] + k * times, k, sequence, offset))
            taken[b] += k * times
            offset += k * b * UNIT
        sequence += times
    line, lines = 0, {}  # pieces without a place, bin after bin
    for b in range(1, BINS):
        lines[b] = line
        line += b * (counts.get(b, (0, 0))[0] - taken[b])
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("low", "high", "per", "sequence", "offset")])
    places = spark.createDataFrame([(b, ranges[b], taken[b], lines.get(b, 0)) for b in ranges], T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("ranges", T.ArrayType(span)), T.StructField("taken", T.LongType()), T.StructField("line", T.LongType())]))
    base = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    main = _ranked(pieces.where("bin > 0").select(*base, "bin", "crcs"), "bin", F.lit(1).cast("long"), "rank")
    main = main.join(F.broadcast(places), "bin")  # one row per bin
    placed = main.where("rank < taken").withColumn("r", F.element_at(F.filter("ranges", lambda r: (F.col("rank") >= r["low"]) & (F.col("rank") < r["high"])), 1))
    nth = F.col("rank") - F.col("r.low")
    placed = placed.select(*base[:2], F.col("length").cast("long").alias("length"), *base[3:], (F.col("r.sequence") + F.floor(nth / F.col("r.per"))).cast("long").alias("sequence_id"), (F.col("r.offset") + F.pmod(nth, F.col("r.per")) * F.col("bin") * UNIT).cast("long").alias("offset"))
    schema = OUT.format(id=pieces.schema["doc_id"].dataType.simpleString())
    first = sequence
    loose = main.where("rank >= taken").select(*base, "crcs", (F.col("line") + (F.col("rank") - F.col("taken")) * F.col("bin")).alias("at"))
    loose = loose.mapInArrow(lambda it: tidy(_lay(it, line, first, True)), schema)
    second = first + line // BINS + len(windows(line, BINS))
    tail_tokens = counts.get(0, (0, 0))[1]
    tails = _ranked(pieces.where("bin = 0").select(*base, "ids", F.lit(0).alias("bin")), "bin", F.col("length").cast("long"), "at").drop("bin")
    tails = tails.mapInArrow(lambda it: tidy(_lay(it, tail_tokens, second, False)), schema)
    return placed.unionByName(loose).unionByName(tails)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    return pack(stage(cut_pieces(df, key, text, str(tokenizer)), "pack"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
