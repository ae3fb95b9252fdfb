"""N-gram Jaccard join by PartEnum signatures, and the groups that its links form.

A document is the set of its k-word shingles; two link when 100 |A & B| >= percent |A | B|. Linked sets of
sizes up to M differ in at most ``k = 2 M (100 - percent) / (100 + percent)`` elements. Sizes are cut into
bands, and a set signs for every band in which the larger set of a linked pair may lie. In each band the
element domain is hashed into ``n1`` partitions, of which one at least holds at most ``k2`` of the
differences; that partition is split into ``n2`` cells, and all subsets of ``n2 - k2`` of them are
enumerated. One subset has no difference, so linked sets share its signature. ``plan`` chooses (n1, k2, n2)
by k: one partition for up to three differences, else partitions with one difference each.

Subsets that hold fewer than ``LEAST`` elements of a set say little, and common passages would fill such
groups. A band has ``slack`` partitions more than needed, so linked sets have several equal subsets, and a set
leaves thin ones unsigned as long as they are fewer than that (see ``signatures``).

Signatures of many documents are found while documents are hashed: one that ``HEAVY`` sets of a single task
have. Their rows are summed on the map side and joined with the sums, so that a signature of a third of all
documents is split over tasks like any skewed join; all others have fewer than ``HEAVY`` rows a task and are
grouped by a window. Candidates come from stars: in each group every member meets the most central one,
which shares most signatures with others. Odd sketches (parities of hashed elements, a lower bound of the
difference) drop most false candidates without loss; the others' sets are intersected exactly, first one
star for each document, then only candidates that are still in different components.

Groups that hold several components have further pairs to test. Small groups are paired out, across
components only. Large ones are not: there, each member is taken as its difference D from a made-up
centre, the elements that most of a few members have. As ``|x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|``, members that
are close enough to the centre together link for certain; all such links of a group (and, with a bonus, of the
members that share an element of D) are links with its closest member, one row each. Other linked members
share an element among the first few of Dx and Dy in any fixed order, with enough elements behind it. Elements
that the centre lacks come first, because members of a cluster share those it has. Only members without a
certain link are joined on these elements and positions, across components; no link is lost, whatever the
centre. Members that share rare elements and still lie just below the threshold are compared pair by pair.

Equal sets are one node throughout. Node ids are 64-bit hashes of sets, as are shingles: n different sets
bring n**2 / 2**65 false merges, one in a thousand runs at a hundred million sets.

A null or empty text, or one without words, has no shingles and links with nothing; very long texts are
worked whole, one at a time. Repeated rows are equal sets and so one component. A null key keeps its links but
names no component; a component of null keys alone has a null id. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Scratch, mix, session_conf, ship, slices, stage, table, text_bytes, tidy, word_hashes
from .components import components

SMALL = 16  # groups up to this size are paired out
CENTRE_OF = 24  # members that a large group's centre is made of; any centre gives the same links
COMMON_FROM, COMMON_MOST = 6, 200_000  # sampled sets that have a common element; the most such elements
LEAST = 2  # elements of a subset that is signed in any case
HEAVY = 16
SIGNATURE_ROWS = 200_000  # in one Arrow batch, 3 MB
SKETCH_MIN, SKETCH_MAX = 64, 16384
HEAD_ROWS = 50_000  # of differences in one Arrow batch, 3 MB
TEXT_ROWS = 1000  # of texts in one Arrow batch
BROADCAST_ROWS = 500_000  # of (row hash, set id): 16 MB at most
_U = np.uint64


def differences(size: int, percent: int) -> int:
    """The most elements in which two linked sets of at most ``size`` elements can differ."""
    return 2 * size * (100 - percent) // (100 + percent)


@lru_cache(None)
def left_out(n2: int, k2: int) -> np.ndarray:
    """All choices of the ``k2`` cells that a subset leaves out."""
    return np.array(list(combinations(range(n2), k2)), np.int64)


class Bands:
    """Size bands and each band's (differences, first-level partitions, slack, cells, cells left out)."""

    def __init__(self, percent: int):
        self.percent, self.tops, self.plans = percent, [0], [(0, 0, 0, 0, 0)]

    def plan(self, size: int) -> tuple[int, tuple[int, int, int, int, int]]:
        while self.tops[-1] < size:
            low = self.tops[-1] + 1
            top = max(low + 5, low * 5 // 4)
            k = differences(top, self.percent)
            self.tops.append(top)
            if k <= 3:
                self.plans.append((k, 1, 0, k + 3, k))
            else:  # of k // 2 + 1 partitions one has at most one difference
                slack = 1 + k // 14
                self.plans.append((k, k // 2 + 1 + slack, slack, 4 if k <= 9 else 3, 1))
        i = int(np.searchsorted(self.tops, size))
        return i, self.plans[i]


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """The PartEnum signatures of one set of hashed elements.

    With k differences in ``n1`` partitions, at least ``2 n1 - k`` subsets of linked sets are equal: the first
    difference in a partition leaves one of its subsets equal, the second none. A set signs subsets of
    at least ``least`` elements, where ``least`` falls from ``LEAST`` until fewer than ``2 n1 - k`` are thinner. So of
    the set with the larger ``least`` some equal subset is signed, and then by the other too. Where even
    empty subsets are as many, one mark stands for all of those sets.
    """
    n, out = len(elements), []
    first, _ = bands.plan(n)
    last, _ = bands.plan(n * 100 // bands.percent)
    values = mix(elements ^ _U(0xA5A5A5A5A5A5A5A5))
    high, low = elements >> _U(32), elements & _U(0xFFFFFFFF)
    for band in range(first, last + 1):
        k, parts, slack, cells, fewer = bands.plans[band]
        if k == 0:
            continue  # only equal sets link, and they are one node
        place = (((high * _U(parts)) >> _U(32)) * _U(cells) + ((low * _U(cells)) >> _U(32))).astype(np.int64)
        sums = np.zeros(parts * cells, np.uint64)
        np.add.at(sums, place, values)
        sums, count = sums.reshape(parts, cells), np.bincount(place, minlength=parts * cells).reshape(parts, cells)
        without = left_out(cells, fewer)
        held = sums.sum(1, dtype=np.uint64)[:, None] - sums[:, without].sum(2, dtype=np.uint64)
        count = count.sum(1)[:, None] - count[:, without].sum(2)
        salt = mix(np.arange(1, held.size + 2, dtype=np.uint64) + _U(band << 32))
        signed = mix(held.ravel() + salt[:-1])
        if not slack:
            out.append(signed)
            continue
        count, equal, least = count.ravel(), 2 * parts - k, LEAST
        while least > 1 and int((count < least).sum()) >= equal:
            least -= 1
        out.append(signed[count >= least])
        if least == 1 and int((count == 0).sum()) >= equal:
            out.append(salt[-1:])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(elements: np.ndarray) -> bytes:
    """Parities of the elements by hash, as many bits as a power of two at or over the set's size."""
    bits = SKETCH_MIN
    while bits < min(len(elements), SKETCH_MAX):
        bits *= 2
    return np.packbits((np.bincount((elements & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference from two sketches; the longer one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def shingle_sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each row of a string column, slice by slice."""
    factors = mix(np.arange(100, 100 + k, dtype=np.uint64)) | _U(1)
    for a, b in slices(column):
        data, offsets = text_bytes(column.slice(a, b - a))
        h, first = word_hashes(data, offsets)
        n = len(h) - k + 1
        if n > 0:
            wide = h[:n] * factors[0]
            for j in range(1, k):
                wide = mix(wide) + h[j : j + n] * factors[j]
            wide = mix(wide)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= k:
                yield np.unique(wide[lo : hi - k + 1])
            elif hi > lo:  # the whole short sequence is one shingle
                one = np.uint64(hi - lo)
                for x, f in zip(h[lo:hi], factors):
                    one = mix((one + x * f)[None])[0] if isinstance(one, np.ndarray) else mix(np.array([one + x * f], np.uint64))[0]
                yield np.array([one], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def set_id(elements: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    total = np.array([mix(elements ^ _U(0x5DEECE66D)).sum(dtype=np.uint64) + _U(len(elements))], np.uint64)
    return int(mix(total).view(np.int64)[0])


def _digest(batches, k: int, percent: int):
    """A row per document, with a sketch for the first of equal sets in a task; ``heavy`` signatures come with the last rows."""
    bands, seen, signed, held = Bands(percent), set(), [], 0
    names = ["doc_id", "row", "n_shingles", "node", "sketch", "heavy"]

    def often() -> np.ndarray:
        sigs, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *signed]), return_counts=True)
        return sigs[n >= HEAVY]

    with np.errstate(over="ignore"):
        heavy = np.zeros(0, np.uint64)
        for batch in batches:
            ids, sets = batch.column(0), shingle_sets(batch.column(1), k)
            for at in range(0, len(ids), TEXT_ROWS):
                part, rows = ids.slice(at, TEXT_ROWS), batch.column(2).slice(at, TEXT_ROWS)
                n, node, sketches = [], [], []
                for _ in range(len(part)):
                    e = next(sets)
                    me = set_id(e) if len(e) else None
                    n.append(len(e))
                    node.append(me)
                    if me is None or me in seen:
                        sketches.append(None)
                    else:
                        seen.add(me)
                        signed.append(signatures(e, bands))
                        held += len(signed[-1])
                        sketches.append(sketch(e))
                if held >= HEAVY * SIGNATURE_ROWS:  # counted apart from what comes after
                    heavy, signed, held = np.union1d(heavy, often()), [], 0
                yield pa.RecordBatch.from_arrays([part, rows, pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(len(part), pa.list_(pa.int64()))], names=names)
        heavy = np.union1d(heavy, often())
        if len(heavy):
            last = [pa.nulls(1, part.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([heavy.view(np.int64)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(last, names=names)


def _sign(batches, k: int, percent: int):
    """(sig, node) of all signatures; only the first of equal sets in a task signs."""
    bands, seen, held, rows = Bands(percent), set(), [], 0

    def block():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in held]).view(np.int64)), pa.array(np.repeat([m for _, m in held], [len(x) for x, _ in held]), pa.int64())], names=["sig", "node"])

    with np.errstate(over="ignore"):
        for batch in batches:
            for e in shingle_sets(batch.column(0), k):
                me = set_id(e) if len(e) else None
                if me is None or me in seen:
                    continue
                seen.add(me)
                held.append((signatures(e, bands), me))
                rows += len(held[-1][0])
                if rows >= SIGNATURE_ROWS:
                    yield block()
                    held, rows = [], 0
        if held:
            yield block()


def _near(batches, percent: int):
    """Keeps candidates whose sizes and sketches allow a link."""
    for batch in batches:
        keep = []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("un", "vn", "us", "vs"))):
            low, high = min(a, b), max(a, b)
            # |A & B| <= low and |A | B| >= high; difference <= (a + b)(100 - p) / (100 + p)
            keep.append(100 * low >= percent * high and (100 + percent) * least_difference(x, y) <= (a + b) * (100 - percent))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v", "times"])


def _sets(batches, k: int):
    """(node, sorted set) of each text whose set is the node that is asked for."""
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = shingle_sets(batch.column(1), k)
            for at in range(0, batch.num_rows, 500):
                want, nodes, out = batch.column(0).slice(at, 500).to_pylist(), [], []
                for w in want:
                    e = next(sets)
                    if len(e) and set_id(e) == w:
                        nodes.append(w)
                        out.append(e.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], names=["node", "elements"])


def _linked(batches, percent: int):
    """Keeps pairs of sets that link."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("ue"), batch.column("ve")):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            common = int((y[at] == x).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])


def _centre(rows):
    """The elements that more than half of the given members have."""
    e, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["ve"]]), return_counts=True)
    return rows[["u"]].head(1).assign(centre=e[2 * n > len(rows)].tobytes())


def _elements(batches):
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("ve")]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["e"])


def _difference_heads(batches, percent: int, shared):
    """The first elements of each member's difference D from its centre: rare ones, those common among members, those it lacks.

    (centre, node, size of D, its weight, size of the set, element, position, whether it is in the short head).
    Two members link when their weights, less ``200 + 2 percent`` for each shared element of D, are at most 0
    in sum. Of two linked members, the one with the smaller D has a shared element among its first k // 2 + 1,
    the other among its first k + 1. Position -1 stands for the centre itself, which all members share.
    """
    common = shared.value
    types = [*[pa.int64()] * 7, pa.bool_()]
    names = ["c", "x", "d", "w", "size", "e", "at", "short"]
    held, rows = [], 0

    def block():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), t) for v, t in zip(zip(*held), types)], names=names)

    for batch in batches:
        for c, x, a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("centre"), batch.column("ve")):
            centre, mine = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            extra, lost = np.setdiff1d(mine, centre, True), np.setdiff1d(centre, mine, True)
            # no linked partner differs in more than this: sizes up to |x| * 100 / percent
            k = (len(mine) + len(mine) * 100 // percent) * (100 - percent) // (100 + percent)
            d = len(extra) + len(lost)
            at = np.minimum(np.searchsorted(common, extra), max(len(common) - 1, 0))
            often = common[at] == extra if len(common) else np.zeros(len(extra), bool)
            head = np.concatenate((extra[~often], extra[often], lost))[: k + 1].view(np.int64)
            at = np.arange(len(head))
            short = at <= k // 2
            head, at, short = np.append(head, 0), np.append(at, -1), np.append(short, False)
            weight = (100 + percent) * d - (100 - percent) * len(mine)
            held.append((*(np.full(len(at), v) for v in (c, x, d, weight, len(mine))), head, at, short))
            rows += len(at)
            if rows >= HEAD_ROWS:
                yield block()
                held, rows = [], 0
    if held:
        yield block()


def _batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows while a stage with wide rows is written."""
    return session_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows)


class Join:
    """One similarity join over a table of documents."""

    def __init__(self, docs: DataFrame, key: str, text: str, k: int, percent: int):
        ship(docs.sparkSession)
        docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
        # a row is found again by a hash of key and text: keys may repeat or be null
        self.docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
        self.k, self.percent, self.spark = k, percent, docs.sparkSession
        self.scratch = Scratch(self.spark)
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        digests = self.docs.mapInArrow(lambda it: tidy(_digest(it, k, percent)), f"doc_id {kind}, row long, n_shingles long, node long, sketch binary, heavy array<long>")
        with _batches_of(self.spark, TEXT_ROWS):
            found = self.scratch.stage(digests, "sim-docs")
        self.signed = found.where("heavy is null").drop("heavy")
        self.heavy = self.scratch.stage(found.select(F.explode("heavy").alias("sig")).distinct(), "sim-heavy")
        self.sketches = self._sketches()

    def _sketches(self) -> DataFrame:
        return self.signed.where("sketch is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("s"))

    def near(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) of nodes that may link, once each, with how often they came up."""
        pairs = pairs.groupBy("u", "v").agg(F.count("*").alias("times"))
        for side in "uv":
            pairs = pairs.join(self.sketches.select(F.col("node").alias(side), F.col("n").alias(f"{side}n"), F.col("s").alias(f"{side}s")), side)
        with _batches_of(self.spark, 2000):
            return self.scratch.stage(pairs.mapInArrow(lambda it, p=self.percent: tidy(_near(it, p)), "u long, v long, times long"), "sim-near")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """(node, elements) of distinct nodes. Only their texts are made into sets again."""
        held = self.signed.where("node is not null").groupBy("node").agg(F.min("row").alias("row"))
        wanted = self.scratch.stage(nodes.join(held, "node").select("row", "node"), "sim-wanted")
        few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        texts = self.docs.join(F.broadcast(wanted) if few else wanted, "row").select("node", "text")
        sets = texts.mapInArrow(lambda it, k=self.k: tidy(_sets(it, k)), "node long, elements binary")
        with _batches_of(self.spark, TEXT_ROWS):
            return self.scratch.stage(sets.dropDuplicates(["node"]), "sim-sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that do link."""
        sets = self.sets_of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
        pairs = pairs.select("u", "v")
        for side in "uv":
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("elements").alias(f"{side}e")), side)
        with _batches_of(self.spark, 250):
            out = self.scratch.stage(pairs.mapInArrow(lambda it, p=self.percent: tidy(_linked(it, p)), "u long, v long"), "sim-links")
        self.scratch.drop("sim-sets")
        return out

    def across(self, pairs: DataFrame, found: DataFrame) -> DataFrame:
        """The pairs whose ends are not in one component."""
        for side, label in (("u", "_lu"), ("v", "_lv")):
            pairs = pairs.join(found.select(F.col("node").alias(side), F.col("label").alias(label)), side, "left")
        return pairs.where(F.coalesce("_lu", "u") != F.coalesce("_lv", "v")).drop("_lu", "_lv")

    def joined(self, links: DataFrame) -> DataFrame:
        out = components(links, self.scratch.stage)
        out = self.scratch.stage(out, "sim-labels")
        self.scratch.drop("cc")
        return out

    def groups(self) -> DataFrame:
        """(sig, node, n) of signatures that at least two different sets have, which n rows hold."""
        k, percent, group = self.k, self.percent, Window.partitionBy("sig")
        rows = self.docs.select("text").mapInArrow(lambda it: tidy(_sign(it, k, percent)), "sig long, node long")
        few = self.heavy.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        heavy = F.broadcast(self.heavy) if few else self.heavy
        bounds = [f(x).alias(name) for f, x, name in ((F.min, "node", "low"), (F.max, "node", "high"), (F.count, "*", "n"))]
        with _batches_of(self.spark, TEXT_ROWS):
            light = rows.join(heavy, "sig", "left_anti")
            light = light.withColumns({"low": F.min("node").over(group), "high": F.max("node").over(group), "n": F.count("*").over(group)})
            out = self.scratch.stage(light.where("low <> high").select("sig", "node", "n"), "sim-groups")
            if self.heavy.limit(1).count():
                held = self.scratch.stage(rows.join(heavy, "sig", "left_semi"), "sim-held")
                sums = held.groupBy("sig").agg(*bounds).where("low <> high").select("sig", "n")
                out = out.unionByName(held.join(sums, "sig").select("sig", "node", "n"))
        return out

    def labels(self) -> DataFrame:
        """(node, label) of every node that has a link: its component."""
        rows = self.groups()
        weight = rows.groupBy("node").agg(F.sum("n").alias("w"))
        best = rows.join(weight, "node").groupBy("sig").agg(F.max(F.struct("w", "node")).alias("star"), F.min("node").alias("low"), F.max("node").alias("high"))
        best = best.where("low <> high").select("sig", F.col("star.node").alias("star"))  # at least two different sets
        rows = self.scratch.stage(rows.distinct().join(best, "sig"), "sim-stars")
        self.scratch.drop("sim-groups")
        self.scratch.drop("sim-held")
        pairs = self.near(rows.where("node <> star").select(F.col("star").alias("u"), F.col("node").alias("v")))
        first = pairs.groupBy("v").agg(F.max_by("u", F.struct("times", "u")).alias("u"))
        links = self.links(first.select("u", "v"))
        found = self.joined(links)
        # Further pairs with the stars across components, and groups that still hold several components.
        rest = self.across(pairs.join(first, ["u", "v"], "left_anti"), found).select("u", "v")
        named = rows.join(found, "node", "left").withColumn("l", F.coalesce("label", "node")).drop("label")
        open_ = named.groupBy("sig").agg(F.min("l").alias("a"), F.max("l").alias("b")).where("a <> b").select("sig")
        # stars of one component stand for one centre, so that a cluster's many groups share it
        named = named.join(open_, "sig").join(found.select(F.col("node").alias("star"), F.col("label").alias("c")), "star", "left")
        opened = self.scratch.stage(named.select("sig", F.coalesce("c", "star").alias("c"), "node", "n", "l"), "sim-open")
        self.scratch.drop("sim-stars")
        near = self.near(self.small_groups(opened)).select("u", "v").unionByName(rest).distinct()
        links, found = self.with_more(links, found, self.links(self.scratch.stage(near, "sim-pairs")))
        return self.large_groups(opened, links, found)

    def with_more(self, links: DataFrame, found: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links and components with further links, which may be none."""
        if not more.limit(1).count():
            return links, found
        links = links.unionByName(more)
        return links, self.joined(links)

    def small_groups(self, rest: DataFrame) -> DataFrame:
        """Pairs of different components within groups of at most ``SMALL``."""
        small = rest.where(F.col("n") <= SMALL).select("sig", "node", "l").distinct()
        other = small.select("sig", F.col("node").alias("v"), F.col("l").alias("m"))
        return small.join(other, "sig").where("node < v and l <> m").select(F.col("node").alias("u"), "v")

    def large_groups(self, rest: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
        """``found`` with the links in larger groups: certain ones through a group's closest member, others by shared elements of differences."""
        large = rest.where(F.col("n") > SMALL).select(F.col("c").alias("u"), F.col("node").alias("v")).distinct()
        large = self.scratch.stage(large, "sim-large")
        if not large.limit(1).count():
            return found
        sets = self.sets_of(large.select(F.col("v").alias("node")).distinct())
        held = large.join(sets.select(F.col("node").alias("v"), F.col("elements").alias("ve")), "v")
        few = Window.partitionBy("u").orderBy(F.xxhash64("v"))
        some = large.withColumn("at", F.row_number().over(few)).where(F.col("at") <= CENTRE_OF)  # limited before the shuffle
        some = some.join(sets.select(F.col("node").alias("v"), F.col("elements").alias("ve")), "v").select("u", "ve")
        centres = self.scratch.stage(some.groupBy("u").applyInPandas(_centre, "u long, centre binary"), "sim-centres")
        # passages that many members share come late in the order; the table is bounded and any table gives the same links
        often = some.mapInArrow(_elements, "e long").groupBy("e").count().where(F.col("count") >= COMMON_FROM).orderBy(F.desc("count"), "e").limit(COMMON_MOST).collect()
        common = self.spark.sparkContext.broadcast(np.sort(np.array([r.e for r in often], np.int64).view(np.uint64)))
        with _batches_of(self.spark, 250):
            heads = held.join(centres, "u").mapInArrow(lambda it, p=self.percent: tidy(_difference_heads(it, p, common)), "c long, x long, d long, w long, size long, e long, at long, short boolean")
            heads = self.scratch.stage(heads, "sim-heads")
        self.scratch.drop("sim-sets")
        bonus = F.when(F.col("at") < 0, 0).otherwise(200 + 2 * self.percent)
        close = heads.groupBy("c", "e").agg(F.min(F.struct("w", "x")).alias("m"), F.count("*").alias("many")).where("many > 1")
        close = self.scratch.stage(close.select("c", "e", F.col("m.w").alias("mw"), F.col("m.x").alias("mx")), "sim-close")
        heads = heads.join(close, ["c", "e"]).withColumn("sure", F.col("w") + F.col("mw") <= bonus)
        heads = self.scratch.stage(heads, "sim-shared")
        certain = heads.where("sure and x <> mx").select(F.col("mx").alias("u"), F.col("x").alias("v")).distinct()
        certain = self.scratch.stage(self.across(certain, found), "sim-certain")
        names = found.select(F.col("node").alias("x"), F.col("label").alias("l"))
        heads = heads.where("at >= 0").join(names, "x", "left").withColumn("l", F.coalesce("l", "x"))
        other = heads.select("c", "e", F.col("x").alias("y"), F.col("d").alias("f"), F.col("size").alias("other"), F.col("l").alias("m"), F.col("at").alias("bt"), F.col("sure").alias("sure2"))
        most = f"floor((size + other) * {100 - self.percent} / {100 + self.percent})"  # differences of a linked pair
        ahead = f"2 * least(d - at, f - bt) >= d + f - {most}"
        pairs = heads.where("short").join(other, ["c", "e"]).where(f"l <> m and not (sure and sure2) and (d < f or d = f and x <> y) and {ahead}")
        near = self.near(pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")))
        return self.with_more(links, found, self.links(near).unionByName(certain))[1]

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id): the smallest doc_id reachable by links, the document itself included."""
        names = self.labels()
        nodes = self.signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        nodes = nodes.join(names, "node", "left").withColumn("label", F.coalesce("label", "node"))
        nodes = self.scratch.stage(nodes, "sim-nodes")
        roots = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
        nodes = nodes.join(roots, "label").select("node", "component_id")
        docs = self.signed.select("doc_id", "n_shingles", "node").join(nodes, "node", "left")
        return docs.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def similarity_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, written; what was needed on the way is deleted."""
    join = Join(docs, key, text, k, percent)
    out = stage(join.result(), "sim-result")
    join.scratch.drop()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_groups(table(spark, sf_dir, "documents"), k=4, percent=85)
