"""String functions as column expressions. Positions are 0-based and count characters."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v"


def _quote(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[&" else c for c in chars) + "]"


def insert(s: Column, pos: int, piece) -> Column:
    """``piece`` before position ``pos``; a position past the end appends."""
    return F.concat(F.substring(s, 1, pos), piece, F.substring(s, F.lit(pos + 1), F.length(s)))


def erase(s: Column, pos: int, n: int) -> Column:
    """Without ``n`` characters from ``pos``; nothing happens past the end."""
    return F.concat(F.substring(s, 1, pos), F.substring(s, F.lit(pos + n + 1), F.length(s)))


def splice(s: Column, pos: int, n: int, piece) -> Column:
    return F.concat(F.substring(s, 1, pos), piece, F.substring(s, F.lit(pos + n + 1), F.length(s)))


def resize(s: Column, n: int) -> Column:
    """Cut, or filled up with NUL."""
    return F.rpad(s, n, "\0")


def find(s: Column, piece: str, pos: int = 0) -> Column:
    """Distance from ``pos`` to the first occurrence at or after it; -1 without one."""
    at = F.locate(piece, s, pos + 1)
    return F.when(at == 0, -1).otherwise(at - 1 - pos)


def find_any(s: Column, chars: str) -> Column:
    """Position of the first character of a set; -1 without one."""
    return F.regexp_instr(s, F.lit(_quote(chars))) - 1


def replace_chars(s: Column, chars: str, by: str) -> Column:
    return F.regexp_replace(s, _quote(chars), by.replace("\\", "\\\\").replace("$", "\\$"))


def split_words(s: Column, sep: str) -> Column:
    """Parts between single characters, without empty ones."""
    return F.filter(F.split(s, _quote(sep)), lambda x: x != "")


def split_parts(s: Column, sep: str) -> Column:
    """Parts between separators, with empty ones."""
    return F.split(s, "\\Q" + sep + "\\E")


def split_first(s: Column, sep: str) -> Column:
    """(found, left, right) at the first separator; without one all is left."""
    at = F.locate(sep, s)
    return F.struct((at > 0).cast("int").alias("found"), F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(s).alias("left"), F.when(at > 0, F.substring(s, at + len(sep), F.length(s))).otherwise("").alias("right"))


def join(parts: Column, sep: str) -> Column:
    """Joined parts; a separator comes only after some text, so leading empty parts vanish."""
    n = F.size(parts)
    first = F.array_position(F.transform(parts, lambda x: x != ""), True)
    return F.when(first == 0, "").otherwise(F.array_join(F.slice(parts, F.greatest(first.cast("int"), F.lit(1)), F.greatest(n, F.lit(1))), sep))


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def same_text(a: Column, b: Column) -> Column:
    """Equal when case is folded."""
    return F.collate(a, "UTF8_LCASE") == F.collate(b, "UTF8_LCASE")


def _escapes(s: Column, known: dict[str, str]) -> Column:
    """Each backslash and the character behind it, from left to right: a known sign, or the character itself."""
    signs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    parts = F.regexp_extract_all(s, F.lit(r"(?s)[^\\]+|\\.|\\"), 0)
    one = lambda x: F.when(~x.startswith("\\") | (F.length(x) < 2), x).otherwise(F.coalesce(F.try_element_at(signs, F.substring(x, 2, 1)), F.substring(x, 2, 1)))
    return F.array_join(F.transform(parts, one), "")


def unescape(s: Column) -> Column:
    """Backslash escapes ``t r n f a b``; any other escaped character stands for itself."""
    return _escapes(s, {"t": "\t", "r": "\r", "n": "\n", "f": "\f", "a": "\a", "b": "\b"})


def json_unescape(s: Column) -> Column:
    """Backslash escapes ``t r n f b`` and signs; there are no ``u`` escapes, so ``\\u0041`` reads as ``u0041``."""
    return _escapes(s, {"t": "\t", "r": "\r", "n": "\n", "f": "\f", "b": "\b"})


def json_escape(s: Column) -> Column:
    for c, to in (("\\", "\\\\"), ('"', '\\"'), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n"), ("\f", "\\f"), ("\b", "\\b")):
        s = F.replace(s, F.lit(c), F.lit(to))
    return s


def split_path(path: Column) -> Column:
    """(drive, dir, name, ext) of a path with slashes of either kind; the dir keeps its last slash, the ext its dot."""
    part = lambda r: F.regexp_extract(path, r, 1)
    return F.struct(part("^([A-Za-z]:)").alias("drive"), part(r"^(?:[A-Za-z]:)?(.*[/\\])").alias("dir"), part(r"([^/\\]*?)(?:\.[^./\\]*)?$").alias("name"), part(r"(\.[^./\\]*)$").alias("ext"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\]", 1)


def line_of(s: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    head = F.substring(s, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def collapse_spaces(s: Column) -> Column:
    """Without spaces that follow a space, a mark of ``, . ! ? : ; -``, a line feed, a bell or a tab in the raw text."""
    return F.regexp_replace(s, "(?<=[ ,.!?:;\\-\\n\\x07\\t]) ", "")


def known_only(s: Column, alphabet: str) -> Column:
    return F.regexp_replace(s, "[^" + _quote(alphabet)[1:], "")


def unknown_only(s: Column, alphabet: str) -> Column:
    return F.regexp_replace(s, _quote(alphabet), "")


def concat(*parts) -> Column:
    """Parts behind one another; a null is empty."""
    return F.concat(*[F.coalesce(p if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts])


def slice_bytes(s: Column, start: int, n: int) -> Column:
    """``n`` bytes from a 0-based place; null where there aren't as many."""
    raw = F.encode(s, "UTF-8")
    return F.when(F.octet_length(raw) >= start + n, F.substring(raw, start + 1, n))


def slice_chars(s: Column, start: int, n: int) -> Column:
    return F.substring(s, start + 1, n)


def find_text(s: Column, piece: str) -> Column:
    """The piece where the text holds it, else null."""
    return F.when(F.contains(s, F.lit(piece)), F.lit(piece))


def from_text(s: Column, piece: str) -> Column:
    """From the piece's first occurrence to the end; null without one."""
    return F.when(F.contains(s, F.lit(piece)), F.substring(s, F.locate(piece, s), F.length(s)))


def replace_text(s: Column, piece: str, by: str) -> Column:
    """All occurrences, from left to right."""
    return F.replace(s, F.lit(piece), F.lit(by)) if piece else s


def order_bytes(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by bytes as signed numbers, then by length."""
    # a byte over 0x7F is below all others: flipping the first digit's upper bit orders texts of digits that way
    signed = lambda s: F.array_join(F.transform(F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit("(..)"), 1), lambda x: F.concat(F.translate(F.substring(x, 1, 1), "0123456789ABCDEF", "89ABCDEF01234567"), F.substring(x, 2, 1))), "")
    return F.when(signed(a) < signed(b), -1).when(signed(a) > signed(b), 1).otherwise(0)


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def utf8_check(data: Column) -> Column:
    """(valid, text): whether bytes are UTF-8, and the text of their longest valid head."""
    # well-formed sequences, a sign for each byte; possessive, as other repetitions of groups take stack for each turn
    one = r"[\x00-\x7F]++|[\xC2-\xDF]T|\xE0[\xA0-\xBF]T|[\xE1-\xEC\xEE\xEF]TT|\xED[\x80-\x9F]T|\xF0[\x90-\xBF]TT|[\xF1-\xF3]TTT|\xF4[\x80-\x8F]TT".replace("T", r"[\x80-\xBF]")
    head = F.substring(data, F.lit(1), F.length(F.regexp_extract(F.decode(data, "ISO-8859-1"), f"^(?:{one})*+", 0)))
    valid = F.is_valid_utf8(data.cast("string"))
    return F.struct(valid.alias("valid"), F.decode(F.when(valid, data).otherwise(head), "UTF-8").alias("text"))


def to_utf16(s: Column) -> Column:
    return F.encode(s, "UTF-16LE")


def from_utf16(data: Column) -> Column:
    return F.decode(data, "UTF-16LE")


def from_code_page(data: Column, page: str = "cp1251") -> Column:
    """Text of bytes in a single-byte code page, by a table of its 256 characters; bytes without one become U+FFFD."""
    table = {chr(i): c for i in range(256) if (c := bytes([i]).decode(page, "replace")) != chr(i)}
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(table), "".join(table.values()))


def to_code_page(s: Column, page: str = "koi8_r") -> Column:
    """Bytes of a text in a single-byte code page; characters that it lacks become ``?``."""
    has = {c: chr(i) for i in range(256) if (c := bytes([i]).decode(page, "replace")) != "\ufffd"}
    table = {c: x for c, x in has.items() if c != x}
    runs = groupby(enumerate(sorted(map(ord, has))), lambda x: x[1] - x[0])  # neighbours as one range
    lacking = "[^" + "".join(f"\\x{{{r[0][1]:X}}}-\\x{{{r[-1][1]:X}}}" for r in (list(g) for _, g in runs)) + "]"
    return F.encode(F.translate(F.regexp_replace(s, lacking, "?"), "".join(table), "".join(table.values())), "ISO-8859-1")


def join_path(folder: Column, name: Column) -> Column:
    """With one slash between; the folder may end in either kind of slash, or be empty."""
    return F.when(F.coalesce(F.length(folder), F.lit(0)) == 0, name).when(folder.rlike(r"[/\\]$"), F.concat(folder, name)).otherwise(F.concat(folder, F.lit("/"), name))


def is_base_name(path: Column) -> Column:
    return ~path.rlike(r"[/\\]")


def column_of(s: Column, offset: Column) -> Column:
    """1-based column of a 0-based offset; a tab counts 4."""
    head = F.element_at(F.split(F.substring(s, F.lit(1), offset), "\n"), -1)
    return F.length(head) + 3 * (F.length(head) - F.length(F.replace(head, F.lit("\t"), F.lit("")))) + 1


def is_identifier(s: Column, dash: bool = False) -> Column:
    """Letters, digits, underscores and all characters beyond ASCII, and dashes if they count."""
    return s.rlike("^[0-9A-Za-z_\\x{80}-\\x{10FFFF}" + ("-" if dash else "") + "]+$")


def repeat(c: str, n: Column) -> Column:
    return F.repeat(F.lit(c), n.cast("int"))


def pad_right(s: Column, n: int, fill: str = " ") -> Column:
    """Filled up to ``n`` characters; longer texts stay whole."""
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, fill))


def map_get(m: Column, name: str, default=None) -> Column:
    """A map's value by name, ignoring case."""
    found = F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == name.lower())
    value = F.get(found, 0)["value"]
    return value if default is None else F.coalesce(value, F.lit(default))


def map_has(m: Column, name: str) -> Column:
    return F.exists(F.map_keys(m), lambda k: F.lower(k) == name.lower())


def collapse_all_spaces(s: Column) -> Column:
    """As ``collapse_spaces``, and without a leading space."""
    return collapse_spaces(F.regexp_replace(s, "^ ", ""))
