"""Configuration trees as values: reading, editing, printing, validating.

``tree_column`` runs a function of a parsed tree over a text column, one document at a time within Arrow batches; a
document that can't be read gives null. In a tree an object is an ``Obj`` (ordered pairs, names may repeat and are
found ignoring case, the first one counts), an array is a list, and scalars are Python's.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialects import Malformed, Reader, close_variables

INVALID = 12060
#: Kinds of findings of a validation, fixed: wrong type, empty text, missing name, schema without a type, schema with an object as type.
WRONG_TYPE, EMPTY_TEXT, MISSING, NO_TYPE, BAD_TYPE = 1, 2, 3, 5, 6
_MISS = object()


class Obj(list):
    """Ordered [name, value] pairs."""


def kind_of(v) -> str:
    if v is None:
        return "none"
    return {bool: "bool", int: "int", float: "float", str: "str", Obj: "object", list: "array"}[type(v)]


def parse(text: str, loose: bool = False, open_end: bool = False) -> Obj:
    """The tree of a document; raises ``Malformed``."""
    made: list = []
    for _, parent, _, key, _, _, kind, b, i, d, s in Reader(text, loose, open_end).read():
        v = Obj() if kind == "object" else [] if kind == "array" else {"bool": b, "int": i, "float": d, "str": s}[kind]
        made.append(v)
        if parent is not None:
            made[parent].append([key, v] if isinstance(made[parent], Obj) else v)
    return made[0]


def tree_column(text: Column, f, kind: str, loose: bool = False) -> Column:
    """``f`` of each document's tree, as a column of the SQL type ``kind``."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else f(parse(t, loose))
            except Malformed:
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return run(text)


# Reading


def get(node, name: str, default=None):
    """The first value of a name, ignoring case."""
    if isinstance(node, Obj):
        low = name.lower()
        return next((v for k, v in node if k.lower() == low), default)
    return default


def exists(node, name: str) -> bool:
    return get(node, name, _MISS) is not _MISS


def at(node, index: int, default=None):
    """The value at a place of an array or object."""
    if isinstance(node, list) and 0 <= index < len(node):
        return node[index][1] if isinstance(node, Obj) else node[index]
    return default


def path(node, where: str, default=None):
    for part in filter(None, where.split("/")):
        node = get(node, part, _MISS)
        if node is _MISS:
            return default
    return node


def demand(node, name: str, kind: str):
    """The value of a name that must be there with just this kind."""
    v = get(node, name, _MISS)
    if v is _MISS or kind_of(v) != kind:
        raise KeyError(f"{name}: {kind} expected")
    return v


def convert(v, kind: str):
    """A value as another kind; ValueError where there is no conversion. Texts are never parsed."""
    have = kind_of(v)
    if have == kind:
        return v
    if kind == "str" and have in ("none", "bool", "int", "float"):
        return "" if v is None else str(v).lower() if have == "bool" else f"{v:f}" if have == "float" else str(v)
    if kind == "int" and have in ("bool", "float"):
        return int(v)
    if kind == "float" and have == "int":
        return float(v)
    if kind == "bool" and have == "int":
        return v != 0
    raise ValueError(f"{have} to {kind}")


def to_array(node, kind: str) -> list:
    return [convert(v, kind) for v in (node if isinstance(node, list) and not isinstance(node, Obj) else [])]


def to_map(node, kind: str) -> dict:
    """Names in lower case; of repeated names the last value counts."""
    return {k.lower(): convert(v, kind) for k, v in (node if isinstance(node, Obj) else [])}


def visit(node, where: str = ""):
    """(path, value) of every node, parents first."""
    todo = [(where, node)]
    while todo:
        where, node = todo.pop()
        yield where, node
        if isinstance(node, Obj):
            todo += [(f"{where}/{k}" if where else k, v) for k, v in reversed(node)]
        elif isinstance(node, list):
            todo += [(f"{where}[{i}]", v) for i, v in reversed(list(enumerate(node)))]


# Editing: each changes the node and returns it


def put(node: Obj, name: str, value) -> Obj:
    """Sets the first of a name, or appends it."""
    low = name.lower()
    for pair in node:
        if pair[0].lower() == low:
            pair[1] = value
            return node
    node.append([name, value])
    return node


def put_path(node: Obj, where: str, value) -> bool:
    """Sets the value at a path whose parents exist; says whether they do."""
    *above, last = [x for x in where.split("/") if x]
    home = path(node, "/".join(above))
    if not isinstance(home, Obj):
        return False
    put(home, last, value)
    return True


def put_at(node: list, index: int, value) -> list:
    """Sets a place of an array, which grows up to it."""
    node += [None] * (index + 1 - len(node))
    node[index] = value
    return node


def child(node: Obj, name: str) -> Obj:
    """The object of a name, made if it isn't there."""
    v = get(node, name)
    if not isinstance(v, Obj):
        v = Obj()
        put(node, name, v)
    return v


def erase(node: Obj, name: str) -> Obj:
    """Without the first of a name."""
    low = name.lower()
    for i, (k, _) in enumerate(node):
        if k.lower() == low:
            del node[i]
            break
    return node


def from_python(v):
    """Dictionaries and lists as a tree."""
    if isinstance(v, dict):
        return Obj([k, from_python(x)] for k, x in v.items())
    return [from_python(x) for x in v] if isinstance(v, list) and not isinstance(v, Obj) else v


# Printing

_SIGNS = {"\\": "\\\\", '"': '\\"', "\t": "\\t", "\r": "\\r", "\n": "\\n", "\f": "\\f", "\b": "\\b"}
WRAP = 140


def quoted(s: str) -> str:
    return '"' + "".join(_SIGNS.get(c, c) for c in s) + '"'


def print_tree(node, per_line: dict[str, int] | None = None, hidden: tuple[str, ...] = ()) -> str:
    """Two spaces for each level; arrays of scalars wrap after ``WRAP`` characters. By path: values on a line, and nodes left out."""
    lines, gone = {k.lower(): n for k, n in (per_line or {}).items()}, {h.lower() for h in hidden}

    def show(v, where: str, level: int) -> str:
        pad, inner = "  " * level, "  " * (level + 1)
        if isinstance(v, Obj):
            kept = [(k, x) for k, x in v if f"{where}/{k}".strip("/").lower() not in gone]
            every, out = lines.get(where.lower(), 1), "{"
            for i, (k, x) in enumerate(kept):
                out += ("," if i else "") + ("\n" + inner if i % every == 0 else " ") + quoted(k) + ":" + show(x, f"{where}/{k}".strip("/"), level + 1)
            # after a full line the closing sign begins a line only by what follows it
            return out + ("\n" + pad if kept and len(kept) % every else pad if not kept else "\n" + pad) + "}"
        if isinstance(v, list):
            if any(isinstance(x, list) for x in v):
                return "[" + ",".join("\n" + inner + show(x, f"{where}[{i}]", level + 1) for i, x in enumerate(v)) + "\n" + pad + "]"
            out, width = "[", 0
            for i, x in enumerate(v):
                piece = ("," if i else "")
                width += len(piece)
                if width > WRAP:
                    piece, width = piece + "\n" + inner, 0
                word = show(x, "", level)
                width += len(word)
                out += piece + word
            return out + "]"
        if v is None:
            return ""
        return quoted(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v:f}" if isinstance(v, float) else str(v)

    return show(node, "", 0)


class Writer:
    """Prints a tree as it is told: ``open``, ``value`` and ``close`` calls become text with the right signs between."""

    def __init__(self):
        self.out: list[str] = []
        self.scopes: list[list] = []  # of each open scope: its closing sign and whether it has an element

    def _before(self, name: str | None) -> None:
        if not self.scopes:
            if self.out:
                raise ValueError("one root only")
            return
        close, some = self.scopes[-1]
        if (name is None) == (close == "}"):
            raise ValueError("objects need names, arrays have none")
        self.out.append("," if some else "")
        self.scopes[-1][1] = True
        if name is not None:
            self.out.append(quoted(name) + ":")

    def open(self, sign: str, name: str | None = None) -> Writer:
        self._before(name)
        self.out.append(sign)
        self.scopes.append(["}" if sign == "{" else "]", False])
        return self

    def value(self, v, name: str | None = None) -> Writer:
        self._before(name)
        self.out.append(print_tree(v))
        return self

    def close(self) -> Writer:
        self.out.append(self.scopes.pop()[0])
        return self

    def text(self) -> str:
        while self.scopes:
            self.close()
        return "".join(self.out)


# Variables inside trees


def expand_text(text: str, values: dict[str, str]) -> str:
    low = {k.lower(): v for k, v in values.items()}
    return re.sub(r"%([^%]*)%", lambda m: "%" if not m[1] else low.get(m[1].lower(), m[0]), text)


def expand_tree(root: Obj, outer: dict[str, str] | None = None) -> tuple[int, Obj]:
    """(status, the tree with its variables expanded): names ``%name%`` anywhere define them.

    Nothing happens without the root name ``<!expand_environment>``. In an object with
    ``<!disable_expand_environment>`` named texts stay, those in arrays don't. Status: that of closing the variables.
    """
    if not exists(root, "<!expand_environment>"):
        return 0, root
    found = {}
    for _, v in visit(root):
        if isinstance(v, Obj):
            found |= {k[1:-1]: x for k, x in v if len(k) > 2 and k[0] == k[-1] == "%" and isinstance(x, str)}
    status, values = close_variables(found, outer)
    values = {**(outer or {}), **values}

    def walk(v):
        if isinstance(v, Obj):
            keep = exists(v, "<!disable_expand_environment>")
            return Obj([k, x if keep and isinstance(x, str) else walk(x)] for k, x in v)
        if isinstance(v, list):
            return [walk(x) for x in v]
        return expand_text(v, values) if isinstance(v, str) else v

    return status, walk(root)


# Validation


def validate(node, schema: Obj) -> list[tuple[str, int, str]]:
    """(path, kind of finding, detail) of what in ``node`` breaks a schema.

    The schema is an object of names, each with ``type`` (an example: its kind is asked for, a text that isn't empty
    asks for such; an array: any of its members' kinds), ``mandatory`` and ``object`` (the schema of an object's names,
    or an array with the schemas of elements, tried by kind). The name ``...`` stands for all other names. ``length`` and
    ``range`` are not checked.
    """
    out: list[tuple[str, int, str]] = []

    def kinds(spec, where):
        inner, example = get(spec, "object"), get(spec, "type", _MISS)
        if example is _MISS:
            if inner is None:
                out.append((where, NO_TYPE, ""))
                return None
            return {kind_of(inner)}
        if isinstance(example, Obj):
            out.append((where, BAD_TYPE, ""))
            return None
        return {kind_of(x) for x in example} if isinstance(example, list) else {kind_of(example)}

    def value(v, spec, where):
        allowed = kinds(spec, where)
        if allowed is None:
            return
        inner = get(spec, "object")
        if kind_of(v) not in allowed and not (isinstance(v, list) and inner is not None and kind_of(inner) == kind_of(v)):
            out.append((where, WRONG_TYPE, f"expected {','.join(sorted(allowed))}, but met {kind_of(v)}"))
        elif v == "" and get(spec, "type") not in ("", None) and isinstance(get(spec, "type"), str):
            out.append((where, EMPTY_TEXT, ""))
        elif isinstance(v, list) and inner is not None:
            both(v, inner, where)

    def both(v, spec, where):
        if kind_of(v) != kind_of(spec):
            out.append((where, WRONG_TYPE, f"expected {kind_of(spec)}, but met {kind_of(v)}"))
        elif isinstance(v, Obj):
            named = {k.lower() for k, _ in spec if k != "..."}
            for k, s in spec:
                if k == "...":
                    others = [(n, x) for n, x in v if n.lower() not in named]
                    for n, x in others:
                        value(x, s, f"{where}/{n}")
                    if not others and get(s, "mandatory", False) is True:
                        out.append((where, MISSING, "..."))
                elif exists(v, k):
                    value(get(v, k), s, f"{where}/{k}")
                elif get(s, "mandatory", False) is True:
                    out.append((where, MISSING, k))
        else:
            for i, x in enumerate(v):
                fit = next((s for s in spec if kind_of(x) in (kinds(s, f"{where}[{i}]") or ())), None)
                if fit is None:
                    out.append((f"{where}[{i}]", WRONG_TYPE, kind_of(x)))
                else:
                    value(x, fit, f"{where}[{i}]")

    both(node, schema, "")
    return out


def validation(text: Column, schema_text: str, loose: bool = False) -> Column:
    """array<struct<path, code, kind, detail>> of a text column; a text that can't be read has one row with its parse code."""
    schema = parse(schema_text, True)

    @F.pandas_udf("array<struct<path string, code int, kind int, detail string>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return [{"path": p, "code": INVALID, "kind": k, "detail": d} for p, k, d in validate(parse(t or "", loose), schema)]
            except Malformed as e:
                return [{"path": "", "code": e.code, "kind": 0, "detail": e.place}]

        return pd.Series([one(t) for t in texts], dtype=object)

    return run(text)


# The cell list, an older dialect

_CELL = re.compile(r"\s*(?:/[^\n]*\n?\s*)*")
_WORD = re.compile(r"[^\s=;{}'\"/]+")


def parse_cells(text: str, read_file=None, environment: dict[str, str] | None = None) -> Obj:
    """``{}`` lists of ``name=value;``, bare values and ``name{...}``; one ``/`` starts a comment.

    Texts in quotes may carry a letter: ``D`` hexadecimal bytes, ``F`` a file's content (by ``read_file``), ``E`` with
    variables, ``L`` the value at another path of the same document.
    """
    pos = 0

    def blank():
        nonlocal pos
        pos = _CELL.match(text, pos).end()
        return text[pos : pos + 1]

    def word():
        nonlocal pos
        blank()
        prefix = ""
        if text[pos : pos + 1] in ("D", "F", "E", "L") and text[pos + 1 : pos + 2] in ("'", '"'):
            prefix = text[pos]
            pos += 1
        if text[pos : pos + 1] in ("'", '"'):
            end = text.find(text[pos], pos + 1)
            if end < 0:
                raise Malformed(13010, text, pos)
            raw, pos = text[pos + 1 : end], end + 1
        else:
            m = _WORD.match(text, pos)
            if not m:
                raise Malformed(13001, text, pos)
            raw, pos = m[0], m.end()
        if prefix == "D":
            return hex_runs(raw)
        if prefix == "F":
            return read_file(raw) if read_file else ""
        if prefix == "E":
            return expand_text(raw, environment or {})
        return ("link", raw) if prefix == "L" else raw

    root = Obj()
    open_ = [root]
    while blank():
        c = text[pos]
        if c == "}":
            pos += 1
            if len(open_) == 1:
                raise Malformed(13003, text, pos)
            open_.pop()
        elif c in ";,":
            pos += 1
        elif c == "{":
            pos += 1
            inner = Obj()
            open_[-1].append(["", inner])
            open_.append(inner)
        else:
            name = word()
            c = blank()
            if c == "=":
                pos += 1
                if blank() == "{":
                    c = "{"
                else:
                    open_[-1].append([name, word()])
                    continue
            if c == "{":
                pos += 1
                inner = Obj()
                open_[-1].append([name, inner])
                open_.append(inner)
            else:
                open_[-1].append(["", name])
    if len(open_) > 1:
        raise Malformed(13010, text, pos)
    for _, v in list(visit(root)):
        if isinstance(v, Obj):
            for pair in v:
                if isinstance(pair[1], tuple):
                    pair[1] = cell_path(root, pair[1][1])
    return root


def cell_path(node, where: str):
    """A ``/`` path by names, ignoring case; a number that is no name is a place."""
    for part in filter(None, where.split("/")):
        v = get(node, part, _MISS)
        if v is _MISS and part.isdigit():
            v = at(node, int(part), _MISS)
        if v is _MISS:
            return None
        node = v
    return node


def hex_runs(text: str) -> bytes:
    """Runs of 2, 4 or 8 hexadecimal digits, each written little-endian; ``0x`` before a run is dropped."""
    out = b""
    for run in re.findall(r"(?:0x)?([0-9A-Fa-f]+)", text):
        if len(run) not in (2, 4, 8):
            raise ValueError(f"a run of {len(run)} digits")
        out += struct.pack({2: "<B", 4: "<H", 8: "<I"}[len(run)], int(run, 16))
    return out
