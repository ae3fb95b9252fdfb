"""Lenient configuration dialects as node tables.

A document becomes rows ``(doc_id, node_id, parent_id, ordinal, key, path, first, kind, bool_v, int_v, dbl_v, str_v)``
in document order; keys keep their order and may repeat. ``path`` joins keys by ``/`` and array places as ``[n]``;
``first`` says that the node and all above it are the first of their name, ignoring case, as a lookup finds them.
Parsing is one narrow step over Arrow batches; all that follows (paths, types, differences) is relational. A
document that can't be read, or holds a number beyond 64 bits, gives one row of kind ``error`` with the code in
``int_v`` and the place in ``str_v``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import let

NODES = "doc_id {id}, node_id int, parent_id int, ordinal int, key string, path string, first boolean, kind string, bool_v boolean, int_v long, dbl_v double, str_v string"
BAD_LEXEME, BAD_ROOT, BAD_VALUE, BAD_KEY, NO_ASSIGN, TRAILING, UNCLOSED = 13001, 13002, 13003, 13004, 13005, 13007, 13010
_ESCAPES = {"t": "\t", "r": "\r", "n": "\n", "f": "\f", "b": "\b"}
_NUMBER = re.compile(r"[+-]?(0[xX][0-9a-fA-F]+|\d+(\.\d*([eE][+-]?\d+)?)?)")
_NAME = re.compile(r"[A-Za-z_\x80-\U0010ffff][0-9A-Za-z_\x80-\U0010ffff-]*")
_BLANK, _LOOSE_BLANK = re.compile(r"\s+"), re.compile(r"(?:\s+|//[^\n]*|#[^\n]*)+")


def path_part(key: str) -> str:
    """A key as one part of a path: the path's own signs are escaped."""
    return key.replace("~", "~0").replace("/", "~1").replace("[", "~2") or "~3"


class Malformed(ValueError):
    def __init__(self, code: int, text: str, at: int):
        line = text.count("\n", 0, at) + 1
        super().__init__(f"{code} at {line}:{at - text.rfind(chr(10), 0, at)}")
        self.code, self.place = code, f"{line}:{at - text.rfind(chr(10), 0, at)}"


class Reader:
    """One document. ``loose`` adds comments, bare names, single quotes, ``=``, ``;`` and hexadecimal numbers.

    Open objects and arrays are held in a stack of their own, so nesting has no limit.
    """

    def __init__(self, text: str, loose: bool = False, open_end: bool = False):
        self.text, self.at, self.loose, self.open_end = text, 0, loose, open_end
        self.rows: list[tuple] = []

    def skip(self) -> str:
        if m := (_LOOSE_BLANK if self.loose else _BLANK).match(self.text, self.at):
            self.at = m.end()
        return self.text[self.at : self.at + 1]

    def fail(self, code: int):
        raise Malformed(code, self.text, self.at)

    def string(self, quote: str) -> str:
        out, i = [], self.at + 1
        while i < len(self.text) and self.text[i] != quote:
            if self.text[i] == "\\" and i + 1 < len(self.text):
                out.append(_ESCAPES.get(self.text[i + 1], self.text[i + 1]))
                i += 2
            else:
                out.append(self.text[i])
                i += 1
        if i >= len(self.text):
            self.fail(UNCLOSED)
        self.at = i + 1
        return "".join(out)

    def number(self, m: re.Match):
        word = m[0].lower()
        if "x" in word and not self.loose or len(word) > 400:
            self.fail(BAD_LEXEME)
        value = float(word) if "." in word else int(word, 16 if "x" in word else 10)
        if type(value) is int and not -(1 << 63) <= value < 1 << 63:
            self.fail(BAD_LEXEME)
        self.at = m.end()
        return value

    def scalar(self):
        c = self.skip()
        if c == '"' or self.loose and c == "'":
            return self.string(c)
        if m := _NUMBER.match(self.text, self.at):
            return self.number(m)
        if m := _NAME.match(self.text, self.at):
            word = m[0]
            if word.lower() in ("true", "false") and word[0].islower():
                self.at = m.end()
                return word.lower() == "true"
            if self.loose:
                self.at = m.end()
                return word
        self.fail(BAD_LEXEME)

    def add(self, parent, ordinal, key, path, first, value) -> int:
        kind = {bool: "bool", int: "int", float: "float", str: "str", dict: "object", list: "array"}[type(value)]
        pick = lambda t: value if type(value) is t else None
        self.rows.append((len(self.rows), parent, ordinal, key, path, first, kind, pick(bool), pick(int), pick(float), pick(str)))
        return len(self.rows) - 1

    def read(self) -> list[tuple]:
        if self.skip() != "{":
            self.fail(BAD_ROOT)
        self.at += 1
        # of each open node: (its row, closing sign, path, whether first, names so far or None, children so far)
        open_ = [[self.add(None, 0, None, "", True, {}), "}", "", True, set(), 0]]
        fresh = True  # an element may come without a separator before it
        while open_:
            top = open_[-1]
            me, close, path, first, names, n = top
            c = self.skip()
            if not c and self.open_end and (fresh or not n or names is not None):
                return self.rows
            if not fresh and n:
                if c and c in (",;" if self.loose else ","):
                    self.at += 1
                    c = self.skip()
                    if c == close and names is None and not self.loose:
                        self.fail(BAD_VALUE)
                elif c != close:
                    self.fail(UNCLOSED if not c else BAD_VALUE)
            if c == close:
                self.at += 1
                open_.pop()
                fresh = False
                continue
            if names is None:
                key, here, mine = None, f"{path}[{n}]", first
            else:
                key = self.scalar()
                if type(key) not in (str, int):
                    self.fail(BAD_KEY)
                key = str(key)
                c = self.skip()
                if c and c in ("=:" if self.loose else ":"):
                    self.at += 1
                elif not (self.loose and c and c in "{["):
                    self.fail(NO_ASSIGN)
                here = f"{path}/{path_part(key)}" if path else path_part(key)
                mine = first and key.lower() not in names
                names.add(key.lower())
            top[5] += 1
            c = self.skip()
            if c and c in "{[":
                self.at += 1
                row = self.add(me, n, key, here, mine, {} if c == "{" else [])
                open_.append([row, "}" if c == "{" else "]", here, mine, set() if c == "{" else None, 0])
                fresh = True
            else:
                self.add(me, n, key, here, mine, self.scalar())
                fresh = False
        if self.skip():
            self.fail(TRAILING)
        return self.rows


def _nodes(batches: Iterator[pa.RecordBatch], loose: bool, open_end: bool):
    names = [x.split()[0] for x in NODES.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.int64(), pa.float64(), pa.string()]

    def block(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, t) for c, t in zip(columns[1:], types)]], names=names)

    for batch in batches:
        kind, out = batch.schema.field(0).type, []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            try:
                out += [(doc, *r) for r in Reader(text.as_py() or "", loose, open_end).read()]
            except Malformed as e:
                out.append((doc, 0, None, 0, None, "", True, "error", None, e.code, None, e.place))
            if len(out) >= 20_000:
                yield block(out)
                out = []
        if out:
            yield block(out)


def read_nodes(df: DataFrame, key: str, text: str, loose: bool = False, open_end: bool = False) -> DataFrame:
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _nodes(it, loose, open_end), NODES.format(id=rows.schema["doc_id"].dataType.simpleString()))


def read_leaves(df: DataFrame, key: str, text: str, leaves: dict[str, tuple[str, str]], loose: bool = False, open_end: bool = False) -> DataFrame:
    """One row for each document: (doc_id, a column for each leaf, n_nodes), in the step that reads it.

    ``leaves`` has by name the exact path of a node and its type: ``boolean``, ``long``, ``double`` or ``string``. Null where the
    path is missing or of another type; of several nodes at one path the greatest value, as ``max`` over the node table has it.
    """
    places = {"boolean": 7, "long": 8, "double": 9, "string": 10}
    wanted = [(path, places[kind]) for path, kind in leaves.values()]
    types = [pa.bool_(), pa.int64(), pa.float64(), pa.string()]

    def each(batches):
        for batch in batches:
            found: list[list] = [[] for _ in wanted]
            counts = []
            for value in batch.column(1):
                try:
                    rows = Reader(value.as_py() or "", loose, open_end).read()
                except Malformed as e:
                    rows = [(0, None, 0, None, "", True, "error", None, e.code, None, e.place)]
                for (path, i), out in zip(wanted, found):
                    out.append(max((r[i] for r in rows if r[4] == path and r[i] is not None), default=None))
                counts.append(len(rows))
            columns = [pa.array(c, types[i - 7]) for (_, i), c in zip(wanted, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(counts, pa.int64())], names=["doc_id", *leaves, "n_nodes"])

    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(each, ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *[f"`{n}` {kind}" for n, (_, kind) in leaves.items()], "n_nodes long"]))


def get_path(nodes: DataFrame, path: str) -> DataFrame:
    """(doc_id, value) at a ``/`` path of keys, ignoring case: at each step the first node of that name, or nothing.

    The reader has marked what lookups find, so this is a filter. Arrays have no names.
    """
    want = "/".join(path_part(x) for x in path.lower().split("/") if x)
    text = F.coalesce("str_v", F.col("int_v").cast("string"), F.col("dbl_v").cast("string"), F.col("bool_v").cast("string"))
    return nodes.where(F.col("first") & (F.lower("path") == want) & ~F.col("kind").isin("object", "array", "error")).select("doc_id", text.alias("value"))


def differences(left: DataFrame, right: DataFrame, ignore: tuple[str, ...] = (), ignore_keys: tuple[str, ...] = (), comments: str = "/-") -> DataFrame:
    """(doc_id, path, what, code): where ``right`` lacks a node of ``left`` (4), has another kind of scalar (1) or of node (5), or another value (2).

    What only ``right`` has is ignored, as are keys that begin with a sign of ``comments`` and all below them. Whole
    numbers are compared exactly, with fractions as doubles. Code 3 stands for documents that can't be read.
    """
    under = lambda part: F.col("path").rlike(f"(?i)(^|/){part}($|[/\\[])")
    signs = "".join({"/": "~1", "[": "~2"}.get(c, re.escape(c)) + "|" for c in comments)[:-1]
    l = left.where(~under(f"({signs})[^/]*")) if comments else left
    for k in ignore_keys:
        l = l.where(~under(re.escape(path_part(k))))
    for x in ignore:
        w = "/".join(path_part(y) for y in x.lower().split("/") if y)
        l = l.where(~((F.lower("path") == w) | F.lower("path").startswith(w + "/") | F.lower("path").startswith(w + "[")))
    values = ["kind", "bool_v", "int_v", "dbl_v", "str_v"]
    r = right.where("first").select("doc_id", F.lower("path").alias("at"), *[F.col(c).alias("r_" + c) for c in values])
    both = l.withColumn("at", F.lower("path")).join(r, ["doc_id", "at"], "left")
    number = lambda c: F.col(c).isin("int", "float")
    nested = lambda c: F.col(c).isin("object", "array")
    numbers = F.when((F.col("kind") == "int") & (F.col("r_kind") == "int"), F.col("int_v") == F.col("r_int_v")).otherwise(
        F.coalesce("dbl_v", F.col("int_v").cast("double")) == F.coalesce("r_dbl_v", F.col("r_int_v").cast("double"))
    )
    same = F.when(number("kind"), numbers).otherwise(F.col("bool_v").eqNullSafe(F.col("r_bool_v")) & F.col("str_v").eqNullSafe(F.col("r_str_v")))
    code = (
        F.when((F.col("kind") == "error") | (F.col("r_kind") == "error"), 3)
        .when(F.col("r_kind").isNull(), 4)
        .when((F.col("kind") == F.col("r_kind")) | number("kind") & number("r_kind"), F.when(nested("kind") | same, F.lit(None)).otherwise(2))
        .when(nested("kind") | nested("r_kind"), 5)
        .otherwise(1)
    )
    out = both.select("doc_id", "node_id", "path", code.alias("code")).where("code is not null")
    # below a missing or different node nothing is compared
    what = F.element_at(F.create_map(*[F.lit(x) for kv in {1: "type", 2: "value", 3: "unreadable", 4: "missing", 5: "type"}.items() for x in kv]), F.col("code"))
    return out.select("doc_id", F.lower("path").alias("path"), what.alias("what"), F.col("code").cast("int").alias("code"))


def ini_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, line, section, name, value) of ``[section]`` and ``name = value`` lines; other lines are comments."""
    lines = df.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw"))
    section = F.when(F.col("raw").rlike("^\\s*\\["), F.regexp_extract("raw", "^\\s*\\[([^\\]]*)\\]", 1))
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.last(section, True).over(upto))
    entry = lines.where(F.col("raw").rlike("^\\s*[0-9A-Za-z_][^=\\[]*="))
    part = lambda i: F.btrim(F.regexp_extract("raw", "^\\s*([^=]*)=(.*)$", i), F.lit(" \t\r\n\f\v"))
    return entry.select("doc_id", "line", F.coalesce("section", F.lit("")).alias("section"), part(1).alias("name"), part(2).alias("value"))


def expand_variables(text: Column, variables: dict[str, str]) -> Column:
    """``%name%`` to its value, ``%%`` to ``%``; unknown names stay. One pass from left to right: values aren't expanded again."""
    parts = F.split(text, "%")
    values = F.create_map(*[F.lit(x) for kv in {"": "%", **{k.lower(): v for k, v in variables.items()}}.items() for x in kv])
    n = F.size(parts)
    # between signs, parts 1, 3, 5 and so on are names; a last sign without a partner stays
    one = lambda x, i: F.when(i % 2 == 0, x).when(i == n - 1, F.concat(F.lit("%"), x)).otherwise(F.coalesce(F.try_element_at(values, F.lower(x)), F.concat(F.lit("%"), x, F.lit("%"))))
    return F.array_join(F.transform(parts, one), "")


def variable_names(text: Column) -> Column:
    """The names between pairs of ``%``."""
    parts = F.split(text, "%")
    return F.filter(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i < F.size(parts) - 1), x)), lambda x: x.isNotNull() & (x != ""))


def pairs(text: Column) -> Column:
    """(status, values) of ``name=value;`` pairs, each of which must end in its separator: else status 1."""
    whole = text.rlike("^(?:[^=;]++=[^;]*+;)*+\\s*$")  # possessive: else each pair takes stack
    found = F.transform(F.filter(F.split(text, ";"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), F.substring(x, F.locate("=", x) + 1, F.length(x)).alias("v")))
    last = let(found, lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda y: y["k"] == x["k"])))
    return F.struct(F.when(whole, 0).otherwise(1).alias("status"), F.map_from_entries(last).alias("values"))


def close_variables(variables: dict[str, str], outer: dict[str, str] | None = None) -> tuple[int, dict[str, str]]:
    """Variables with their references resolved: status 0, 1 when a name is unknown, -10 when names form a circle."""
    status, out = 0, {}

    def value(name: str, open_: tuple[str, ...]) -> str:
        nonlocal status
        if name in out:
            return out[name]

        def one(m):
            nonlocal status
            if not m[1]:
                return "%"
            if m[1] in open_:
                status = -10
                return m[0]
            if m[1] in variables:
                return value(m[1], (*open_, m[1]))
            if outer and m[1] in outer:
                return outer[m[1]]
            status = status or 1
            return m[0]

        return re.sub(r"%([^%]*)%", one, variables[name])

    for name in variables:
        out[name] = value(name, (name,))
    return status, out


def arguments(line: Column) -> Column:
    """The words of a command line; double quotes keep spaces and are dropped."""
    words = F.regexp_extract_all(line, F.lit('(?:[^\\s"]++|"[^"]*+"?+)++'), 0)
    return F.transform(words, lambda w: F.replace(w, F.lit('"'), F.lit("")))
