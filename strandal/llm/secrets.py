"""Secret scans: fixed patterns, and a battery of randomness tests over other tokens.

A token of an encoding's alphabet is suspicious when it looks drawn uniformly from that alphabet. Three
statistics say so: chi-squared against the uniform distribution, the number of runs above and below
the alphabet's middle, and the lag-1 serial correlation of symbol ranks. Under the null hypothesis the
token is ordinary text or an identifier, whose symbols come with the frequencies that they have in the whole
corpus (``symbol_excess`` counts them in one pass). That gives a noncentral chi-squared whose noncentrality
grows with the length; so the p-value of an even histogram falls with the length, and short tokens prove
little. Decimal numbers are tested too, but where the corpus uses digits evenly they prove nothing. Runs and
correlation must not reject randomness. The p-values of all tokens in one text go through a
Benjamini-Hochberg step at rate ``q``, with the tokens weighted by length. Discoveries are added as spans;
pattern spans always stay.

A null or empty text has no spans; very long texts are scanned whole. Rows are independent: repeated rows get
equal results, an empty table an empty result. Equal starts are ordered by kind. Offsets are code points, ends
exclusive. Columns named like the results (``_s_...``) are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import schema_with, ship, slices, table, text_bytes, tidy

#: The pattern kinds, in the order that breaks ties; fixed values.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this equals dropping shorter runs
#: Method kinds: encodings from narrow to wide, with their alphabets in rank order.
ENCODINGS = {
    "digits": "0123456789",
    "hex16": "0123456789abcdef",
    "HEX16": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "ALNUM36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
METHOD_KINDS = tuple(f"random_{e}" for e in ENCODINGS)
_ORDER = {k: i for i, k in enumerate((*KINDS, *METHOD_KINDS))}
_RANK = {e: {c: i for i, c in enumerate(a)} for e, a in ENCODINGS.items()}
#: A candidate has 20 or more symbols.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
PIECE = re.compile(r"[A-Za-z0-9+/]{20,}={0,2}")
FDR = 0.01
#: Rates of the random battery's runs and correlation tests: a random token passes both 99 times in 100.
LEAST_P = 0.005


def excess_of(counts) -> dict[str, float]:
    """For each encoding, the excess of sum(p_i^2) * k over 1 of its k symbols by their counts (of 128 ASCII codes)."""
    out = {}
    for e, alphabet in ENCODINGS.items():
        c = np.array([counts[ord(x)] for x in alphabet], float) + 1
        out[e] = float(len(c) * ((c / c.sum()) ** 2).sum() - 1)
    return out


def _symbols(batches):
    counts = np.zeros(128, np.int64)
    for batch in batches:
        for a, b in slices(batch.column(0)):
            counts += np.bincount(text_bytes(batch.column(0).slice(a, b - a))[0], minlength=256)[:128]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(128)), pa.array(counts)], names=["code", "n"])


def symbol_excess(df: DataFrame, text: str = "text") -> dict[str, float]:
    """What ``scan`` takes as the null hypothesis, from the symbols of all texts. The driver gets 128 sums."""
    ship(df.sparkSession)
    rows = df.select(text).mapInArrow(lambda it: tidy(_symbols(it)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = dict.fromkeys(range(128), 0) | {r.code: r.n for r in rows}
    return excess_of(counts)


def _normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def encoding_of(token: str) -> str | None:
    """The narrowest alphabet that holds all symbols of the token."""
    symbols = set(token.rstrip("="))
    return next((e for e, rank in _RANK.items() if symbols <= rank.keys()), None)


def battery(token: str, encoding: str, excess: float) -> tuple[float, float, float]:
    """(p that ordinary text is so uniform, two-sided p of the runs test, of the serial correlation)."""
    ranks = [_RANK[encoding][c] for c in token.rstrip("=")]
    n, k = len(ranks), len(ENCODINGS[encoding])
    counts: dict[int, int] = {}
    for r in ranks:
        counts[r] = counts.get(r, 0) + 1
    chi = sum(c * c for c in counts.values()) * k / n - n
    # noncentral chi-squared by a normal: mean df + nc, variance 2 (df + 2 nc); sparse counts widen it
    df, nc = k - 1, n * excess
    p_text = _normal_cdf((chi - df - nc) / math.sqrt(2 * df * (n - 1) / n + 4 * nc))
    high = [2 * r >= k for r in ranks]
    a, b = sum(high), n - sum(high)
    if a and b:
        runs, mean = 1 + sum(x != y for x, y in zip(high, high[1:])), 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    else:
        p_runs = 0.0
    mid = sum(ranks) / n
    spread = sum((r - mid) ** 2 for r in ranks)
    lag = sum((x - mid) * (y - mid) for x, y in zip(ranks, ranks[1:])) / spread if spread else 1.0
    p_serial = math.erfc(abs(lag + 1 / n) * math.sqrt(n) / math.sqrt(2))
    return p_text, p_runs, p_serial


def _candidates(text: str):
    """Tokens, and where a token has ``-`` or ``_`` (as after a vendor's prefix) also its long pieces."""
    for m in TOKEN.finditer(text):
        yield m.span()
        if "-" in m.group() or "_" in m.group():
            for piece in PIECE.finditer(text, *m.span()):
                yield piece.span()


def random_spans(text: str, excess: dict[str, float], q: float = FDR) -> list[tuple[str, int, int]]:
    """Tokens that pass the battery, under false-discovery control within the text."""
    tried = []
    for start, end in _candidates(text):
        token = text[start:end]
        if (e := encoding_of(token)) is None:
            continue
        p, p_runs, p_serial = battery(token, e, excess[e])
        tried.append((p if min(p_runs, p_serial) >= LEAST_P else 1.0, len(token), e, start, end))
    if not tried:
        return []
    # weights by length average one, so that long tokens, where the tests have power, get more of the rate
    mean = sum(x[1] for x in tried) / len(tried)
    order = sorted((x[0] * mean / x[1], x) for x in tried)
    last = max((i for i, (p, _) in enumerate(order, 1) if p <= q * i / len(order)), default=0)
    return [(f"random_{x[2]}", x[3], x[4]) for _, x in order[:last]]


def find_secrets(text: str | None, excess: dict[str, float], q: float = FDR) -> tuple[list, list]:
    """(pattern spans, method spans), each (kind, start, end), by start and then kind."""
    if not text:
        return [], []
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    key = lambda s: (s[1], _ORDER[s[0]])
    return sorted(base, key=key), sorted(random_spans(text, excess, q), key=key)


def redact(text: str | None, spans) -> str | None:
    """``text`` with each maximal union of spans replaced by ``[secret]``."""
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "_s_text string, _s_n_assign long, _s_n_access long, _s_n_hex long, _s_base_sha256 string, _s_spans string"


def _scan(batches, excess: dict[str, float], clean: bool):
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            text = text.as_py()
            base, extra = find_secrets(text, excess)
            both = sorted([*base, *extra], key=lambda s: (s[1], _ORDER[s[0]]))
            say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            n = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((redact(text, both) if clean else None, *n, hashlib.sha256(say(base).encode()).hexdigest(), say(both)))
        new = zip(*rows) if rows else [[] for _ in range(6)]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        keep = [c for c in batch.schema.names if c != "text" or clean]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(list(v), t) for v, t in zip(new, types)]], names=[*keep, *names])


def scan(df: DataFrame, excess: dict[str, float], clean: bool = False) -> DataFrame:
    """``df`` (its text column must be ``text``) with the ``_s_`` columns; no shuffle, one batch in memory.

    With ``clean`` the redacted text comes as ``_s_text`` beside the original; else ``text`` is left out.
    """
    ship(df.sparkSession)
    df = df.drop(*[x.split()[0] for x in SCHEMA.split(", ")])
    keep = [f for f in df.schema if f.name != "text" or clean]
    return df.mapInArrow(lambda it: tidy(_scan(it, excess, clean)), schema_with(keep, SCHEMA))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = scan(docs, symbol_excess(docs))
    return df.select("doc_id", *[F.col(f"_s_{c}").alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])
