"""The coders of ``coding`` over many texts at once.

A model's state machine is unrolled into arrays; then all texts of a batch take one symbol each per turn, and the
bits that a symbol settles are found by table. Results are those of ``encode_codes`` and ``decode_codes``, bit by bit. The
last few texts of a batch, those that let more than a word of bits wait, and models with too many states go through them.
"""

from __future__ import annotations

import numpy as np

from . import coding
from .coding import BITS, END, HALF, QUARTER, TOP, CodingError

#: Transitions that a model may have as arrays; texts below which a turn isn't worth its calls; characters or bytes of one batch.
TRANSITIONS, FEW, CHUNK = 1_000_000, 6, 4_000_000
_SWITCH, _END, _BAD, _SWITCHES = -1, -2, -3, -4
_ERRORS = {_BAD: coding.BAD_CODE, _SWITCHES: coding.SWITCHES}
_WORD, _WIDE = 32, 1 << 40
_LENGTH = np.array([i.bit_length() for i in range(1 << BITS)])
_REVERSED = np.array([int(f"{i:0{BITS}b}"[::-1], 2) for i in range(1 << BITS)])


class Tables:
    """States, their rows of weights, and what each code says in each state."""

    def __init__(self, model: coding.Model):
        self.chars = sorted({c for p in model.parts for c in p.chars})
        if not self.chars:
            raise OverflowError
        place = {c: i for i, c in enumerate(self.chars)}
        first = coding.State(model)
        ids = {self._key(first): 0}
        states, rows, row_ids = [first], [], {}
        self.row_of, self.base, says, to, codes, switches = [], [], [], [], [], []
        for s in states:
            part, row = s.part, s.row()
            self.base.append(len(says))
            if id(row) not in row_ids:
                row_ids[id(row)] = len(rows)
                rows.append(row)
            self.row_of.append(row_ids[id(row)])
            for code in range(len(row) - 1):
                then = coding.State(model)
                then.now, then.back, then.run, then.switched = self._key(s)
                try:
                    got = then.take(code)
                except CodingError as e:
                    says.append(_BAD if e.status == coding.BAD_CODE else _SWITCHES)
                    to.append(0)
                    continue
                says.append(_SWITCH if got is None else _END if got == END else ord(got))
                if got == END:
                    to.append(0)
                    continue
                if (k := self._key(then)) not in ids:
                    ids[k] = len(states)
                    states.append(then)
                to.append(ids[k])
            if len(says) + len(states) * len(self.chars) > TRANSITIONS:
                raise OverflowError
            mine = np.full(len(self.chars), -1)
            mine[[place[c] for c in part.chars]] = list(part.chars.values())
            codes.append(mine)
            switches.append([part.switches.get(model.home.get(c, -1), -1) for c in self.chars])
        self.rows, self.says, self.to = rows, np.array(says), np.array(to)
        self.row_of, self.base, self.codes, self.switches = np.array(self.row_of), np.array(self.base), np.array(codes), np.array(switches)
        # doubles, as their division is faster; products and quotients below stay exact up to sums of 2 ** 37
        self.total, self.start = np.array([float(r[-1]) for r in rows]), np.cumsum([0, *[len(r) for r in rows]])[:-1]
        self.sums = np.array([float(x) for r in rows for x in r])
        self.keys = self.sums.astype(np.int64) + np.repeat(np.arange(len(rows)) * _WIDE, [len(r) for r in rows])
        if self.total.max() >= 1 << 37:
            raise OverflowError
        # the codes that end a text in each state: a switch home if there is one, and the terminal
        self.homeward = np.array([-1 if s.part.end is not None else s.part.switches.get(model.start, -1) for s in states])
        self.ends = np.array([-1 if s.part.end is None else s.part.end for s in states])

    @staticmethod
    def _key(s: coding.State) -> tuple:
        return s.now, s.back, s.run, s.switched

    def inside(self, row, code, low, high):
        at, width, total = self.start[row] + code, high - low + 1, self.total[row]
        scale = width.astype(float)
        a, b = (scale * self.sums[at] / total).astype(np.int64), (scale * self.sums[at + 1] / total).astype(np.int64)
        for i in np.flatnonzero(width < total):
            bounds = coding.apart(self.rows[row[i]], int(width[i]))
            a[i], b[i] = bounds[code[i]], bounds[code[i] + 1]
        return low + a, low + b - 1

    def code_at(self, row, low, high, value):
        width, total = high - low + 1, self.total[row]
        share = (((value - low + 1) * total - 1) / width).astype(np.int64)
        code = np.searchsorted(self.keys, row * _WIDE + share, "right") - 1 - self.start[row]
        for i in np.flatnonzero(width < total):
            code[i] = np.searchsorted(coding.apart(self.rows[row[i]], int(width[i])), value[i] - low[i], "right") - 1
        return code


def _settled(low, high):
    """How many bits both ends share, how many middle bits follow, and the interval without them."""
    n = BITS - _LENGTH[low ^ high]
    low, high = low << n & TOP, high << n & TOP | (1 << n) - 1
    middle = BITS - 1 - _LENGTH[~(low & ~high) & HALF - 1]
    return n, middle, low << middle & HALF - 1, (high << middle | (1 << middle) - 1) & TOP | HALF


class _Writers:
    """Bits of many texts; whole words go to one buffer."""

    def __init__(self, words):
        self.first = np.cumsum([0, *words])[:-1]
        self.at, self.buffer = self.first.copy(), np.zeros(int(np.sum(words)), "<u4")
        n = len(words)
        self.word, self.fill, self.waiting, self.odd = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)

    def put(self, rows, bits, n, middle):
        """The first ``n`` of ``bits``, behind the first of them its opposites that waited; ``rows`` is an index or a slice."""
        waiting, some = self.waiting[rows], n > 0
        size = np.where(some, n + waiting, 0)
        far = np.where(some, size, waiting + middle) >= _WORD
        if far.any():
            self.odd[rows] |= far
            waiting, n, some, middle = np.where(far, 0, waiting), np.where(far, 0, n), some & ~far, np.where(far, 0, middle)
            size = np.where(some, n + waiting, 0)
        lead = bits & 1
        value = np.where(some, lead | ((1 - lead) * ((1 << waiting) - 1)) << 1 | bits >> 1 << 1 + waiting, 0)
        self.waiting[rows] = np.where(some, 0, waiting) + middle
        word, fill = self.word[rows] | value << self.fill[rows], self.fill[rows] + size
        full = np.flatnonzero(fill >= _WORD)
        if full.size:
            which = full if isinstance(rows, slice) else rows[full]
            self.buffer[self.at[which]] = word[full] & (1 << _WORD) - 1
            self.at[which] += 1
            word[full] >>= _WORD
            fill[full] -= _WORD
        self.word[rows], self.fill[rows] = word, fill

    def data(self) -> list[bytes]:
        self.buffer[self.at] = self.word
        ends = (4 * self.at + -(-self.fill // 8)).tolist()
        whole = self.buffer.tobytes()
        return [whole[4 * a : b] for a, b in zip(self.first.tolist(), ends)]


def _encode(t: Tables, model, texts: list[str]) -> list[tuple]:
    out: list = [None] * len(texts)
    sizes = np.array([len(x) for x in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    known = np.array([ord(c) for c in t.chars])
    chars = np.minimum(np.searchsorted(known, points), len(known) - 1)
    strange = known[chars] != points
    starts = np.cumsum([0, *sizes])[:-1]
    bad = np.add.reduceat(np.append(strange, False).astype(np.int64), starts) * (sizes > 0) > 0
    for i in np.flatnonzero(bad):
        out[i] = (coding.UNKNOWN, None)
    order = np.flatnonzero(~bad)
    order = order[np.argsort(-sizes[order], kind="stable")]
    last = int(sizes[order[FEW - 1]]) if len(order) >= FEW else -1
    order = order[sizes[order] <= last]
    if len(order):
        sizes, starts = sizes[order], starts[order]
        w = _Writers(sizes + 4)
        low, high, state = np.zeros(len(order), np.int64), np.full(len(order), TOP), np.zeros(len(order), np.int64)

        def symbol(rows, code):
            at = state[rows]
            a, b = t.inside(t.row_of[at], code, low[rows], high[rows])
            n, middle, low[rows], high[rows] = _settled(a, b)
            w.put(rows, _REVERSED[a] & (1 << n) - 1, n, middle)
            state[rows] = t.to[t.base[at] + code]

        def step(rows, code, switch):
            """Codes of rows; where they are missing, a switch goes before. False where neither is known."""
            lack = np.flatnonzero(code < 0)
            if not lack.size:
                return True
            w.odd[lack[switch[lack] < 0]] = True
            lack = lack[switch[lack] >= 0]
            symbol(lack, switch[lack])
            return False

        for i in range(last):
            n = int(np.searchsorted(-sizes, -i, "left"))
            rows, c = slice(0, n), chars[starts[:n] + i]
            if not step(rows, t.codes[state[rows], c], t.switches[state[rows], c]):
                w.odd[:n] |= t.codes[state[rows], c] < 0
            symbol(rows, np.maximum(t.codes[state[rows], c], 0))
        everyone = slice(0, len(order))
        if not step(everyone, t.ends[state], t.homeward[state]):
            w.odd |= t.ends[state] < 0
        symbol(everyone, np.maximum(t.ends[state], 0))
        w.waiting += 1
        w.put(everyone, (low >= QUARTER).astype(np.int64), np.ones(len(order), np.int64), np.zeros(len(order), np.int64))
        for i, data, odd in zip(order.tolist(), w.data(), w.odd.tolist()):
            if not odd:
                out[i] = (0, data)
    return [coding.encode_text(x, model) if o is None else o for x, o in zip(texts, out)]


def _decode(t: Tables, model, rows: list[bytes]) -> list[tuple]:
    out: list = [None] * len(rows)
    gap = bytes(8)  # zeros that are read past the end
    raw = np.frombuffer(gap.join(rows) + gap + gap, np.uint8).astype(np.int64)
    windows = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    sizes = np.array([len(r) for r in rows])
    first = 8 * np.cumsum([0, *(sizes + len(gap))])[:-1]
    at, stop = first + BITS, first + 8 * sizes + 2 * BITS
    me, low, high, state = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.full(len(rows), TOP), np.zeros(len(rows), np.int64)
    value = _REVERSED[windows[first >> 3] & TOP]
    over, said = np.zeros(len(rows), bool), []
    while len(me) - int(over.sum()) >= FEW:
        row = t.row_of[state]
        code = t.code_at(row, low, high, value)
        n, middle, low, high = _settled(*t.inside(row, code, low, high))
        used = n + middle
        bits = _REVERSED[windows[at >> 3] >> (at & 7) & TOP] >> BITS - used
        value = value << n & TOP | bits >> middle
        value = value & HALF | value << middle & HALF - 1 | bits & (1 << middle) - 1
        at += used
        now = t.base[state] + code
        state, says = t.to[now], t.says[now]
        plain = np.flatnonzero((says >= 0) & ~over)
        said.append((me[plain].astype(np.uint32), says[plain].astype("<u4")))
        ends = ~over & ((says < _SWITCH) | (at > stop))
        if ends.any():
            for i in np.flatnonzero(ends).tolist():
                s = int(says[i])
                out[me[i]] = (0, "") if s == _END else (_ERRORS.get(s, coding.PAST_END), None)
            over |= ends
        # texts that have ended go on over zeros until they are many
        at = np.where(over, first[me], at)
        if over.sum() * 8 >= len(me):
            on = ~over
            me, low, high, state, value, at, stop, over = me[on], low[on], high[on], state[on], value[on], at[on], stop[on], over[on]
    if said:
        owners, points = (np.concatenate(x) for x in zip(*said))
        done = np.array([o is not None and not o[0] for o in out])
        keep = done[owners]
        owners, points = owners[keep], points[keep]
        text = points[np.argsort(owners.astype(np.uint16) if len(rows) <= 1 << 16 else owners, kind="stable")].tobytes().decode("utf-32-le", "surrogatepass")
        ends = np.cumsum(np.bincount(owners, minlength=len(rows))).tolist()
        for i in np.flatnonzero(done).tolist():
            out[i] = (0, text[ends[i - 1] if i else 0 : ends[i]])
    return [coding.decode_text(r, model) if o is None else o for r, o in zip(rows, out)]


def _each(rows: list, model: coding.Model, many, one) -> list[tuple]:
    """(status, result) of each row; nulls stay."""
    out: list = [(0, None)] * len(rows)
    there = [i for i, r in enumerate(rows) if r is not None]
    while there:
        size, n = 0, 0
        while n < len(there) and (not n or size + len(rows[there[n]]) <= CHUNK):
            size, n = size + len(rows[there[n]]), n + 1
        part, there = there[:n], there[n:]
        values = [rows[i] for i in part]
        for i, r in zip(part, many(model.tables, model, values) if model.tables and n >= FEW else [one(v, model) for v in values]):
            out[i] = r
    return out


def encode(texts: list[str | None], model: coding.Model) -> list[tuple[int, bytes | None]]:
    return _each(texts, model, _encode, coding.encode_text)


def decode(rows: list[bytes | None], model: coding.Model) -> list[tuple[int, str | None]]:
    return _each(rows, model, _decode, coding.decode_text)
