"""Command-line options by a declared list, over columns of argument arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import let
from . import trees

UNKNOWN, NO_VALUE, NO_OPTIONS, NO_KEYS = 9001, 9002, 9003, 1801


@dataclass(frozen=True)
class Option:
    keys: tuple[str, ...]
    id: int
    help: str = ""
    needs_value: bool = False


def key_number(key: str) -> int:
    """The first four bytes of a key as a big-endian number, as far as it has them."""
    return int.from_bytes(key.encode()[:4], "big")


def read_options(text: str) -> list[Option]:
    """From ``options: [{keys: [...], id, help, need_value}]``; ValueError with a code where the list or its keys are missing."""
    listed = trees.get(trees.parse(text, True), "options")
    if not isinstance(listed, list):
        raise ValueError(NO_OPTIONS)
    out = []
    for o in listed:
        keys = trees.get(o, "keys")
        if not keys:
            raise ValueError(NO_KEYS)
        out.append(Option(tuple(keys), trees.get(o, "id", key_number(keys[0])), trees.get(o, "help", ""), trees.get(o, "need_value", False)))
    return out


def help_text(options: list[Option]) -> str:
    return "".join(f"-- keys:{','.join(o.keys)} [{'NeedValue ' if o.needs_value else ''}], Desc:{o.help}\n" for o in options)


def parse_arguments(words: Column, options: list[Option]) -> Column:
    """(errors, options, last) of an array of arguments, the program's name left out.

    ``-key=value`` or ``/key value value``: an option takes all words up to the next one. ``options`` lists key, id and
    values in order (words before any option have a null key); ``last`` has the values of each id's last occurrence.
    """
    flag = lambda w: F.substring(w, 1, 1).isin("-", "/")
    ids = F.create_map(*[F.lit(x) for o in options for k in o.keys for x in (k, o.id)])
    needs = F.array(*[F.lit(o.id) for o in options if o.needs_value]).cast("array<int>")

    def places(words):
        starts = F.transform(words, lambda w, i: F.when((i == 0) | flag(w) | (flag(F.get(words, i - 1)) & F.contains(F.get(words, i - 1), F.lit("="))), i))
        return F.filter(starts, lambda i: i.isNotNull())

    def pack(words, starts, at, n):
        end = F.coalesce(F.get(starts, n + 1), F.size(words))
        head = F.get(words, at)
        is_flag = flag(head)
        body = F.substring(head, 2, 1 << 20)
        key = F.when(is_flag, F.split_part(body, F.lit("="), F.lit(1)))
        value = F.when(F.contains(body, F.lit("=")), F.substring(body, F.locate("=", body) + 1, F.length(body)))
        rest = F.slice(words, at + 2, end - at - 1)
        values = F.when(~is_flag, F.slice(words, at + 1, end - at)).when(F.coalesce(F.length(value), F.lit(0)) > 0, F.array(value)).otherwise(rest)
        return let(key, lambda k: F.struct(k.alias("key"), F.try_element_at(ids, k).alias("id"), F.filter(values, lambda v: v != "").alias("values")))

    def judged(packs, known):
        errors = F.transform(
            F.filter(packs, lambda p: p["key"].isNotNull() & (p["id"].isNull() | F.array_contains(needs, p["id"]) & (F.size(p["values"]) == 0))),
            lambda p: F.struct(F.when(p["id"].isNull(), UNKNOWN).otherwise(NO_VALUE).alias("code"), p["key"].alias("key")),
        )
        named = F.filter(known, lambda p: p["id"].isNotNull())
        last = let(named, lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["id"] == p["id"])))
        return F.struct(errors.alias("errors"), known.alias("options"), F.map_from_entries(F.transform(last, lambda p: F.struct(p["id"], p["values"]))).alias("last"))

    # lambdas compute what they name for each element anew, so that lists are bound first
    packs = let(words, lambda w: let(places(w), lambda starts: F.transform(starts, lambda at, n: pack(w, starts, at, n))))
    return let(packs, lambda all_: let(F.filter(all_, lambda p: p["key"].isNull() | p["id"].isNotNull()), lambda known: judged(all_, known)))
