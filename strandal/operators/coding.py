"""Arithmetic coding of text columns: one alphabet, several alphabets with switches, or n-gram contexts.

The coder narrows an integer interval symbol by symbol and writes bits, least significant first. A model
is a state machine over rows of cumulative weights; the same one drives encoding, decoding, and the plain
symbol lists. Rows of a column are independent, so coding is one scalar step over Arrow batches, whose rows
``lockstep`` takes together, and shuffles nothing. Null texts stay null. Instead of raising, rows carry a status.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ngrams import Alphabet, walk

BITS = 16
TOP, QUARTER = (1 << BITS) - 1, 1 << (BITS - 2)
HALF, CEILING = 2 * QUARTER, QUARTER - 1
FLOOR = 5  # least weight outside of n-gram models
#: Status values, fixed: decoded past the end, a code out of range, a character in no alphabet, switches in a row.
PAST_END, BAD_CODE, UNKNOWN, SWITCHES = 200201, 200203, 200204, 200205


class CodingError(ValueError):
    def __init__(self, status: int):
        super().__init__(str(status))
        self.status = status


class BitWriter:
    def __init__(self):
        self.bits: list[int] = []
        self.waiting = 0

    def put(self, bit: int) -> None:
        """The bit, then the opposite bits that were waiting for it."""
        self.bits += [bit, *[1 - bit] * self.waiting]
        self.waiting = 0

    def data(self) -> bytes:
        out = bytearray(-(-len(self.bits) // 8))
        for i, b in enumerate(self.bits):
            out[i >> 3] |= b << (i & 7)
        return bytes(out)


def _halve(low: int, high: int):
    """What the next bit is known to be (2: a middle bit, to be settled later), or None, and the interval without it."""
    if high < HALF:
        return 0, low, high
    if low >= HALF:
        return 1, low - HALF, high - HALF
    if low >= QUARTER and high < 3 * QUARTER:
        return 2, low - QUARTER, high - QUARTER
    return None, low, high


def apart(row: list[int], width: int) -> list[int]:
    """Bounds of a row's codes in an interval that is narrower than its weights' sum: each code keeps one place at least."""
    out, n = [width * x // row[-1] for x in row], len(row) - 1
    if n > width:
        raise CodingError(BAD_CODE)
    for i in range(1, n + 1):
        out[i] = max(out[i], out[i - 1] + 1)
    out[n] = width
    for i in range(n - 1, 0, -1):
        out[i] = min(out[i], out[i + 1] - 1)
    return out


def _inside(low: int, high: int, row: list[int], code: int) -> tuple[int, int]:
    width = high - low + 1
    if width < row[-1]:
        bounds = apart(row, width)
        return low + bounds[code], low + bounds[code + 1] - 1
    return low + width * row[code] // row[-1], low + width * row[code + 1] // row[-1] - 1


def encode_codes(steps) -> bytes:
    """Bytes of (row of cumulative weights, code) pairs."""
    low, high, out = 0, TOP, BitWriter()
    for row, code in steps:
        low, high = _inside(low, high, row, code)
        while True:
            bit, low, high = _halve(low, high)
            if bit is None:
                break
            if bit == 2:
                out.waiting += 1
            else:
                out.put(bit)
            low, high = 2 * low, 2 * high + 1
    out.waiting += 1
    out.put(int(low >= QUARTER))
    return out.data()


def decode_codes(data: bytes, state) -> str:
    """The text that a model's state machine reads from bytes."""
    size, at = 8 * len(data), BITS
    bit_at = lambda i: data[i >> 3] >> (i & 7) & 1 if i < size else 0
    low, high, value = 0, TOP, 0
    for i in range(BITS):
        value = 2 * value + bit_at(i)
    out = []
    while True:
        row, width = state.row(), high - low + 1
        if width < row[-1]:
            row = apart(row, width)
        share = ((value - low + 1) * row[-1] - 1) // width
        code = next((i for i in range(len(row) - 1) if row[i + 1] > share), None)
        if code is None:
            raise CodingError(BAD_CODE)
        low, high = _inside(low, high, row, code)
        while True:
            bit, new_low, new_high = _halve(low, high)
            if bit is None:
                break
            value -= low - new_low
            low, high, value = 2 * new_low, 2 * new_high + 1, 2 * value + bit_at(at)
            at += 1
        got = state.take(code)
        if got == END:
            return "".join(out)
        if got is not None:
            out.append(got)
        if at > size + 2 * BITS:
            raise CodingError(PAST_END)


END = "<end>"  # no single character


@dataclass
class Part:
    """One alphabet of a model: what each code means, and the cumulative weights of each context."""

    chars: dict[str, int]  # character: code
    switches: dict[int, int]  # alphabet: code
    end: int | None
    rows: dict[str, list[int]]  # by context; the empty one is always there
    single: bool = False  # after one symbol the alphabet before it returns
    order: int = 0  # characters of context
    meaning: dict[int, object] = field(default_factory=dict)

    def __post_init__(self):
        self.meaning = {**{c: t for t, c in self.chars.items()}, **{c: a for a, c in self.switches.items()}}
        if self.end is not None:
            self.meaning[self.end] = END


@dataclass
class Model:
    parts: list[Part]
    start: int
    home: dict[str, int]  # character: the alphabet that is switched to for it

    @cached_property
    def tables(self):
        """The state machine as arrays, or None where it has too many states for that."""
        from . import lockstep

        try:
            return lockstep.Tables(self)
        except OverflowError:
            return None

    def codes(self, text: str) -> list[tuple[list[int], int]]:
        """(row, code) of every symbol, the terminal included."""
        state, out = State(self), []
        for c in text:
            if c not in state.part.chars:
                if c not in self.home:
                    raise CodingError(UNKNOWN)
                state.emit(state.part.switches[self.home[c]], out)
            state.emit(state.part.chars[c], out)
        if state.part.end is None:
            state.emit(state.part.switches[self.start], out)
        state.emit(state.part.end, out)
        return out

    def text_of(self, codes: list[int]) -> str:
        state, out = State(self), []
        for c in codes:
            got = state.take(c)
            if got == END:
                break
            if got is not None:
                out.append(got)
        return "".join(out)


class State:
    def __init__(self, model: Model):
        self.model, self.now, self.back, self.run, self.switched = model, model.start, model.start, "", False

    @property
    def part(self) -> Part:
        return self.model.parts[self.now]

    def row(self) -> list[int]:
        """The row of the longest context that the model has."""
        part, run = self.part, self.run
        while run not in part.rows:
            run = run[1:]
        return part.rows[run]

    def emit(self, code: int, out: list) -> None:
        out.append((self.row(), code))
        self.take(code)

    def take(self, code: int):
        """What a code says: a character, ``END``, or None for a switch."""
        part = self.part
        got = part.meaning.get(code)
        if got is None:
            raise CodingError(BAD_CODE)
        if isinstance(got, int):
            if self.switched:
                raise CodingError(SWITCHES)
            self.back, self.now, self.run, self.switched = self.now, got, "", True
            return None
        self.switched = False
        if got != END:
            if part.single:
                self.now, self.run = self.back, ""
            else:
                self.run = (self.run + got)[-part.order :] if part.order else ""
        return got


def _weight(share: float, floor: int) -> int:
    return max(floor, int(share * CEILING))


def _row(weights) -> list[int]:
    return [0, *accumulate(weights)]


def order0(freqs: dict[str, float]) -> Model:
    """One alphabet; the terminal has a tenth of the rarest character's frequency."""
    total = sum(freqs.values())
    row = _row([_weight(min(freqs.values()) / 10 / total, FLOOR), *[_weight(f / total, FLOOR) for f in freqs.values()]])
    return Model([Part({c: i for i, c in enumerate(freqs, 1)}, {}, 0, {"": row})], 0, {})


def equiprobable(chars: str) -> Model:
    return order0(dict.fromkeys(chars, 1.0))


@dataclass(frozen=True)
class Source:
    """An alphabet of a switching model: characters with frequencies, its weight, and rates of leaving it, which widen its scale."""

    freqs: dict[str, float]
    weight: float
    single: bool = False
    leaving: float = 0.0


def switching(sources: list[Source]) -> Model:
    """Several alphabets. Switch codes come first, weighted by the target's share; the heaviest alphabet starts and ends texts."""
    all_weights = sum(s.weight for s in sources)
    start = max(range(len(sources)), key=lambda i: (sources[i].weight, -i))
    parts, home = [], {}
    for i, s in enumerate(sources):
        scale = sum(s.freqs.values()) + (0 if s.single else s.leaving)
        others = [] if s.single else [j for j in range(len(sources)) if j != i]
        weights = [_weight(scale / len(s.freqs) * sources[j].weight / all_weights / scale, FLOOR) for j in others]
        end = len(others) if i == start else None
        if end is not None:
            weights.append(_weight(min(s.freqs.values()) / 10 / scale, FLOOR))
        first = len(weights)
        weights += [_weight(f / scale, FLOOR) for f in s.freqs.values()]
        parts.append(Part({c: first + n for n, c in enumerate(s.freqs)}, {j: n for n, j in enumerate(others)}, end, {"": _row(weights)}, s.single))
        for c in s.freqs:
            if home.get(c) != start:
                home[c] = i
    return Model(parts, start, home)


def contextual(counts: dict[tuple, int], alphabets: tuple[Alphabet, ...], end_rate: float = 1 / 2000) -> Model:
    """A model of n-gram counts as ``ngrams.learn`` has them: (alphabet, prefix, kind, symbol): n.

    Codes are the terminal (in the first alphabet), one switch for each alphabet, and the characters. A context without
    counts is even; contexts that were never seen are not stored but fall back to shorter ones' rows when absent.
    """
    place = {a.id: i for i, a in enumerate(alphabets)}
    rows: list[dict[str, dict[tuple[str, str], int]]] = [{"": {}} for _ in alphabets]
    for (a, prefix, kind, symbol), n in counts.items():
        if a in place:
            rows[place[a]].setdefault(prefix, {})[kind, symbol] = n
    parts = []
    for i, a in enumerate(alphabets):
        has_end = i == 0
        symbols = [("switch", str(b.id)) for b in alphabets] + [("char", c) for c in a.chars]
        full = {}
        contexts = {"", *a.chars} if a.order == 1 else set(rows[i])
        for prefix in contexts | {""}:
            have = rows[i].get(prefix, {})
            f = [float(have.get(s, 0)) if not (s[0] == "switch" and (a.single or s[1] == str(a.id))) else 0.0 for s in symbols]
            if has_end:
                f = [end_rate * sum(f), *f]
            total = sum(f)
            if not total:
                f, total = [1.0] * len(f), float(len(f))
            full[prefix] = _row([_weight(x / total, 1) for x in f])
        first = int(has_end) + len(alphabets)
        parts.append(Part({c: first + n for n, c in enumerate(a.chars)}, {j: int(has_end) + j for j in range(len(alphabets))}, 0 if has_end else None, full, a.single, a.order))
    home: dict[str, int] = {}
    for i, a in enumerate(alphabets):
        for c in a.chars:
            home.setdefault(c, i)
    return Model(parts, 0, home)


def learn_model(text: str, alphabets: tuple[Alphabet, ...], end_rate: float = 1 / 2000) -> Model:
    """A contextual model of one text; of a corpus, pass the rows of ``ngrams.learn`` to ``contextual``."""
    return contextual(dict(walk(text, alphabets)[0]), alphabets, end_rate)


def save_model(model: Model) -> str:
    """A contextual model as JSON: of each context the probabilities of its codes, with six places."""
    parts = []
    for p in model.parts:
        rows = {k: [round((b - a) / r[-1], 6) for a, b in zip(r, r[1:])] for k, r in sorted(p.rows.items())}
        parts.append({"chars": p.chars, "switches": {str(k): v for k, v in p.switches.items()}, "end": p.end, "single": p.single, "order": p.order, "rows": rows})
    return json.dumps({"start": model.start, "home": model.home, "alphabets": parts}, ensure_ascii=False)


def load_model(text: str) -> Model:
    """A saved model; weights come from its probabilities, so they may differ from the first ones in the last place."""
    d = json.loads(text)
    parts = []
    for p in d["alphabets"]:
        rows = {k: _row([_weight(x / (sum(r) or 1.0), 1) for x in r]) for k, r in p["rows"].items()}
        parts.append(Part(p["chars"], {int(k): v for k, v in p["switches"].items()}, p["end"], rows, p["single"], p["order"]))
    return Model(parts, d["start"], d["home"])


def encode_text(text: str, model: Model) -> tuple[int, bytes | None]:
    """(status, data) of a text."""
    try:
        return 0, encode_codes(model.codes(text))
    except CodingError as e:
        return e.status, None


def decode_text(data: bytes, model: Model) -> tuple[int, str | None]:
    """(status, text) of coded bytes."""
    try:
        return 0, decode_codes(data, State(model))
    except CodingError as e:
        return e.status, None


def encode(text: Column, model: Model) -> Column:
    """(status, data) of a text column."""
    model.tables  # made once, and sent along

    @F.pandas_udf("status int, data binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        from . import lockstep

        return pd.DataFrame(lockstep.encode(texts.tolist(), model), columns=["status", "data"])

    return run(text)


def decode(data: Column, model: Model) -> Column:
    """(status, text) of a column of coded bytes."""
    model.tables

    @F.pandas_udf("status int, text string")
    def run(rows: pd.Series) -> pd.DataFrame:
        from . import lockstep

        return pd.DataFrame(lockstep.decode([None if r is None else bytes(r) for r in rows], model), columns=["status", "text"])

    return run(data)


def symbols(text: Column, model: Model) -> Column:
    """The codes of a text, without coding them to bits."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or any(c not in model.home and c not in model.parts[0].chars for c in t) else [c for _, c in model.codes(t)] for t in texts])

    return run(text)


def ideal_bits(text: Column, model: Model) -> Column:
    """The bits that the model's probabilities ask for."""
    from math import log2

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return sum(-log2((r[c + 1] - r[c]) / r[-1]) for r, c in model.codes(t))
            except CodingError:
                return None

        return pd.Series([None if t is None else one(t) for t in texts], dtype="float64")

    return run(text)
