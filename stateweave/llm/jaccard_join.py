"""Exact n-gram Jaccard join by signature trees.

A document's set is its distinct 3-word shingles (A-Z in lower case), as 64-bit hashes; equal sets are one class. A class has a
bitmap of its tokens. The forest's roots are parts of the token space: two sets of s and t tokens that link differ in at
most D = (s + t)(100 - P) / (100 + P) tokens, so of D + 1 + ``SPARE`` ranges of hashes at least one that isn't empty holds the
same tokens in both, and they meet under the root of these tokens (sets whose tokens lie in D ranges or fewer also meet
under a root of their own). Sizes fall into bands, each as wide as a link can reach, so partners lie in one band or in two
neighbouring ones, and each such pair of bands has its own number of ranges. Nothing is left to chance.

Below a root stands a tree of ``FAN`` children a node: a node holds the OR of its members' bitmaps, the range of their sizes,
the most tokens that collide in a bitmap, and the range of the components they are known to be in. Two nodes are
traversed together, from (root, root) down, unless no pair of their members can link: sizes too far apart, one component,
or an overlap, at most the bits they share plus colliding tokens, below what the least sizes need. What is left at the
leaves is confirmed on full sets of hashes. Roots of at most ``LEAF`` classes and ``LEAF_TOKENS`` tokens are traversed within a task. Larger ones are
compared with ``PIVOTS`` members first; if links then connect all, they are done, else their members form nodes of about ``BLOCK``
and the pairs of nodes, except those within the main component, are rows that are pruned, then opened, over all tasks.

Defined results: null and empty texts have an empty set, linked with nothing; a null doc_id has no component; repeated rows
form one class; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, map_rows, materialize, mix, shingles, small, spread_join, word_hashes
from .components import extended
from .near_dedup import digest, similar

WIDTH = 3
PERCENT = 90
#: Ranges beyond the D + 1 that must agree, so that hardly any set has its tokens in D ranges.
SPARE = 2
#: Ranges whose roots are linked first; the others then skip roots whose members are connected.
FIRST = 4
LEAF = 512
LEAF_TOKENS = 500_000
FAN = 8
PIVOTS = 2
BLOCK = 256
BITS = (256, 16_384)
#: Pairs of nodes that are looked at together.
STEP = 32_768


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    hashes, counts = word_hashes(texts)
    every, ends = shingles(hashes, width), np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        yield np.unique(every[a : b - width + 1]) if b - a >= width else shingles(hashes[a:b], width)


def bands(percent: int, most: int = 2**40) -> np.ndarray:
    """Least sizes of the bands: the largest set that can link with a band's least one is that band's last."""
    out = [1]
    while out[-1] < most:
        out.append(100 * out[-1] // percent + 1)
    return np.array(out, np.int64)


def differing(total: np.ndarray | int, percent: int):
    """The most tokens in which two linked sets of ``total`` tokens together can differ."""
    return total * (100 - percent) // (100 + percent)


def needed(total: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of two linked sets of ``total`` tokens together."""
    return -(-total * percent // (100 + percent))


class Roots:
    """The roots of a set."""

    def __init__(self, percent: int):
        self.first = bands(percent)
        last = self.first[1:] - 1  # of each band
        self.differ = [int(differing(int(x) + 100 * int(x) // percent, percent)) for x in last]
        self.cuts: dict[int, np.ndarray] = {}

    def of(self, values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Roots of the first ranges and of the others, for the pairs of bands that a sorted set belongs to."""
        early, late = [], []
        band = int(np.searchsorted(self.first, len(values), "right")) - 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)))))
        for i in (band, band - 1):
            if i < 0 or not self.differ[i]:
                continue
            n = self.differ[i] + 1 + SPARE
            if n not in self.cuts:
                self.cuts[n] = np.array([(k << 64) // n for k in range(n)], np.uint64)
            at = np.append(np.searchsorted(values, self.cuts[n]), len(values))
            some = np.flatnonzero(at[1:] > at[:-1])
            label = mix(np.uint64(i << 32) + some.astype(np.uint64))
            roots = mix(sums[at[some + 1]] - sums[at[some]] + label).view(np.int64)
            early.append(roots[some < FIRST]), late.append(roots[some >= FIRST])
            if len(some) <= self.differ[i]:
                early.append(mix(np.array([(i << 32) + (1 << 31)], np.uint64)).view(np.int64))
        return early, late


def bitmap(values: np.ndarray) -> np.ndarray:
    """A token's bit each, in 64-bit words; 2 to 4 bits a token within ``BITS``."""
    size = min(max(BITS[0], 1 << int(2 * len(values) - 1).bit_length()), BITS[1]) if len(values) else BITS[0]
    out = np.zeros(size, np.uint8)
    out[(values & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps as rows of one width, the least of theirs."""
    width = min(map(len, maps))
    return np.array([m if len(m) == width else np.bitwise_or.reduce(m.reshape(-1, width)) for m in maps])


def may_link(nodes: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes (bitmaps, least and most sizes, most collisions, least and most components) may hold a link of two components."""
    maps, least, most, slack, first, last = nodes
    fits = (percent * least[i] <= 100 * most[j]) & (percent * least[j] <= 100 * most[i])
    fits &= (first[i] != last[i]) | (first[j] != last[j]) | (first[i] != first[j])
    at = np.flatnonzero(fits)
    i, j = i[at], j[at]
    shared = np.bitwise_count(maps[i] & maps[j]).sum(1).astype(np.int64) + np.minimum(slack[i], slack[j])
    fits[at] = np.minimum(shared, np.minimum(most[i], most[j])) >= needed(least[i] + least[j], percent)
    return fits


class Tree:
    """Levels of nodes over members, from the members themselves up to one root."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        self.order = np.lexsort((sizes, comps))
        maps, sizes, comps = maps[self.order], sizes[self.order], comps[self.order]
        slack = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, slack, comps, comps)]
        while len(self.levels[-1][0]) > 1:
            low = self.levels[-1]
            at = np.arange(0, len(low[0]), FAN)
            ways = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(way.reduceat(x, at, axis=0) for way, x in zip(ways, low, strict=True)))

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members that may link, in pieces, by dual traversal."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, i, j = todo.pop()
            if len(i) > STEP:
                todo += [(level, i[at : at + STEP], j[at : at + STEP]) for at in range(0, len(i), STEP)]
                continue
            keep = may_link(self.levels[level], i, j, percent)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if not level:
                yield self.order[i], self.order[j]
                continue
            below = len(self.levels[level - 1][0])
            a = np.repeat(i * FAN, FAN * FAN) + np.tile(np.repeat(np.arange(FAN), FAN), len(i))
            b = np.repeat(j * FAN, FAN * FAN) + np.tile(np.arange(FAN), FAN * len(j))
            real = (a < below) & (b < below) & (a <= b)
            todo.append((level - 1, a[real], b[real]))


def partners(maps: np.ndarray, sizes: np.ndarray, comps: np.ndarray, percent: int) -> np.ndarray:
    """Which members may link with a member of another component."""
    found = np.zeros(len(sizes), bool)
    for i, j in Tree(maps, sizes, comps).pairs(percent):
        found[i] = found[j] = True
    return found


def link(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (id, least id of its group) that connect members, known to be in ``comps``, as all their confirmed pairs would."""
    sizes, maps = np.fromiter(map(len, sets), np.int64, len(sets)), folded([bitmap(x) for x in sets])
    part = np.unique(comps, return_inverse=True)[1]
    before = part.copy()
    for i, j in Tree(maps, sizes, part).pairs(percent):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if part[a] != part[b] and similar(sets[a], sets[b], percent):
                part[part == part[b]] = part[a]
    least: dict[int, int] = {}
    for k, i in zip(part.tolist(), ids.tolist(), strict=True):
        least[k] = min(i, least.get(k, i))
    moved = set(part[part != before].tolist())
    return [(i, least[k]) for i, k in zip(ids.tolist(), part.tolist(), strict=True) if k in moved and i != least[k]]


def _signatures(width: int, percent: int):
    def make():
        roots = Roots(percent)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(4)]
            lists: list[list[np.ndarray]] = [[], []]
            ends: list[list[int]] = [[0], [0]]
            with np.errstate(over="ignore"):
                for values in shingle_sets(batch.column("text"), width):
                    for col, x in zip(cols, (len(values), *digest(values), bitmap(values).tobytes()), strict=True):
                        col.append(x)
                    for k, found in enumerate(roots.of(values) if len(values) else ([], [])):
                        lists[k] += found
                        ends[k].append(ends[k][-1] + sum(map(len, found)))
            arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.binary())]
            for e, x in zip(ends, lists, strict=True):
                arrays.append(pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n", "low", "high", "bits", "early", "late"])

        return work

    return make


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (a row per id: id, low, high and more) with ``set``, made anew from the text of that digest; a row per id."""
    joined = _rows(docs).withColumnRenamed("doc_id", "id").join(small(wanted), "id")
    names = [c for c in joined.columns if c != "text"]
    schema = ", ".join(f"{c} {t}" for c, t in joined.dtypes if c != "text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets, ok = [], []
            for values, low, high in zip(shingle_sets(batch.column("text"), width), batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
                with np.errstate(over="ignore"):
                    ok.append(digest(values) == (low, high))
                sets.append(values.tobytes())
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "set"]).filter(pa.array(ok, pa.bool_()))

        return work

    found = map_rows(joined, make, f"{schema}, set binary", 128)
    return found.groupBy("id").agg(*(F.first(c).alias(c) for c in found.columns if c != "id"))


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets link."""
    pairs = materialize(pairs.distinct(), "pairs")
    counts = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")), "pair-counts")
    wanted = materialize(classes.join(counts, "id").select("id", "low", "high"), "pair-classes")
    sets = materialize(_sets(docs, wanted, width), "pair-sets")
    hot = counts.where(F.col("n") > HOT_ROWS)
    both = spread_join(pairs, sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a", hot.withColumnRenamed("id", "a"), F.col("b"))
    both = spread_join(both, sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b", hot.withColumnRenamed("id", "b"), F.col("a"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = batch.column("x"), batch.column("y")
            ok = [similar(np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64), percent) for k in range(batch.num_rows)]
            return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return work

    return materialize(map_rows(both, make, "a long, b long", 128), "confirmed")


def _placed(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """With ``c``, the component known so far."""
    if comps is None:
        return members.withColumn("c", F.col("id"))
    return members.join(comps.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))


def _mixed(members: DataFrame, key: str, name: str) -> DataFrame:
    """Members (with ``c``) under those keys that more than one component is under."""
    placed = materialize(members, name)
    return placed.join(placed.groupBy(key).agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select(key), key)


def _member(v: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, components, sizes and folded bitmaps of structs (id, c, n, bits)."""
    return (*(np.asarray(v.field(k)) for k in range(3)), folded([np.frombuffer(x, np.uint64) for x in v.field(3).to_pylist()]))


def _leaf_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, comps: DataFrame | None, width: int, percent: int) -> DataFrame:
    """Links under roots of at most ``LEAF`` classes; ``groups`` has their sorted ``ids``. Roots of the same classes are one."""
    groups = groups.groupBy(F.xxhash64("ids").alias("leaf"), F.xxhash64(F.lit(5), "ids").alias("other")).agg(F.first("ids").alias("ids"))
    inside = groups.select(F.struct("leaf", "other").alias("leaf"), F.explode("ids").alias("id"))
    inside = _mixed(_placed(inside, comps), "leaf", "leaves")
    known = inside.select("leaf", "id", "c").join(classes.select("id", "n", "bits", "low", "high"), "id")
    trees = known.groupBy("leaf").agg(F.collect_list(F.struct("id", "c", "n", "bits", "low", "high")).alias("g"))

    def select():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for leaf, other, g in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("g"), strict=True):
                ids, c, n, maps = _member(g.values)
                at = np.flatnonzero(partners(maps, n, c, percent))
                for col, x in zip(cols, (np.full(len(at), leaf), np.full(len(at), other), ids[at], c[at], np.asarray(g.values.field(4))[at], np.asarray(g.values.field(5))[at]), strict=True):
                    col.append(x)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], ["leaf", "other", "id", "c", "low", "high"])

        return work

    schema = "leaf long, other long, id long, c long, low long, high long"
    wanted = materialize(map_rows(trees.select(F.col("leaf.leaf").alias("a"), F.col("leaf.other").alias("b"), "g"), select, schema, 64), "wanted")
    by_id = wanted.groupBy("id", "low", "high").agg(F.collect_list(F.struct("leaf", "other", "c")).alias("at"))
    full = _sets(docs, materialize(by_id, "wanted-ids"), width)
    full = full.select("id", "set", F.explode("at").alias("x")).select("x.leaf", "x.other", F.struct("id", "x.c", "set").alias("m"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            with np.errstate(over="ignore"):
                for g in batch.column("g"):
                    v = g.values
                    found += link(np.asarray(v.field(0)), np.asarray(v.field(1)), [np.frombuffer(x, np.uint64) for x in v.field(2).to_pylist()], percent)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["a", "b"])

        return work

    return materialize(map_rows(full.groupBy("leaf", "other").agg(F.collect_list("m").alias("g")).select("g"), make, "a long, b long", 64), "leaf-links")


def _pivot_pairs(large: DataFrame) -> DataFrame:
    """Each member of a large root with its pivots; roots choose by one order of ids, so that they agree where they can."""
    picks = [F.min_by("id", F.xxhash64("id", F.lit(p))).alias(f"p{p}") for p in range(PIVOTS)]
    counts = materialize(large.groupBy("root").agg(F.count("*").alias("n"), *picks), "pivots")
    pairs = spread_join(large.select("root", "id"), counts.drop("n"), "root", counts.select("root", "n"), F.col("id"))
    pairs = pairs.select("id", F.explode(F.array(*(f"p{p}" for p in range(PIVOTS)))).alias("p")).where("id <> p")
    return pairs.select(F.greatest("id", "p").alias("a"), F.least("id", "p").alias("b"))


def _block_pairs(classes: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link, of different components, under roots too large for a task: nodes, pairs of nodes, members."""
    sizes = large.groupBy("root", "c").agg(F.count("*").alias("k"))
    roots = small(materialize(sizes.groupBy("root").agg(F.max_by("c", "k").alias("main"), F.ceil(F.sum("k") / BLOCK).cast("int").alias("parts")), "large-roots"))
    dealt = large.select("root", "id", "c").join(roots, "root").withColumn("side", F.col("c") != F.col("main"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    known = dealt.join(classes.select("id", "n", "bits"), "id")
    packed = materialize(known.groupBy("root", "side", "block").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("id", "c", "n", "bits")).alias("g")), "blocks")

    def build():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            tops = []
            for g in batch.column("g"):
                _, c, n, maps = _member(g.values)
                top = Tree(maps, n, c).levels[-1]
                tops.append((top[0][0].tobytes(), *(int(x[0]) for x in top[1:])))
            cols = [pa.array(x, t) for x, t in zip(zip(*tops, strict=True), (pa.binary(), *[pa.int64()] * 5), strict=True)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "side", "block", "parts")), *cols], ["root", "side", "block", "parts", "bits", "least", "most", "slack", "c0", "c1"])

        return work

    nodes = materialize(map_rows(packed, build, "root long, side boolean, block int, parts int, bits binary, least long, most long, slack long, c0 long, c1 long", 64), "block-nodes")
    fields = ("bits", "least", "most", "slack", "c0", "c1")
    asked = nodes.where("side").select("root", F.col("block").alias("i"), F.struct(*fields).alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    pairs = asked.join(nodes.select("root", "block", "side", F.struct(*fields).alias("q")), ["root", "block"]).where("not side or i <= block")

    def prune():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok = []
            for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist(), strict=True):
                widest = max(len(p["bits"]), len(q["bits"]))
                for x in (p, q):  # a folded bitmap has more collisions than are known
                    x["slack"] = x["slack"] if len(x["bits"]) * 2 <= widest or len(p["bits"]) == len(q["bits"]) else x["most"]
                maps = folded([np.frombuffer(x["bits"], np.uint64) for x in (p, q)])
                level = (maps, *(np.array([p[f], q[f]]) for f in fields[1:]))
                ok.append(bool(may_link(level, np.array([0]), np.array([1]), percent)[0]))
            return batch.select(["root", "i", "block", "side"]).filter(pa.array(ok))

        return work

    left = materialize(map_rows(pairs, prune, "root long, i int, block int, side boolean", 1024), "open-pairs")
    both = left.join(packed.where("side").select("root", F.col("block").alias("i"), F.col("g").alias("x")), ["root", "i"]).join(packed.select("root", "block", "side", F.col("g").alias("y")), ["root", "block", "side"])

    def descend():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: list[list[np.ndarray]] = [[], []]
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                parts = [x.values] if x.values.equals(y.values) else [x.values, y.values]
                ids, c, n = (np.concatenate([np.asarray(v.field(k)) for v in parts]) for k in range(3))
                maps = folded([np.frombuffer(b, np.uint64) for v in parts for b in v.field(3).to_pylist()])
                for i, j in Tree(maps, n, c).pairs(percent):
                    found[0].append(ids[i]), found[1].append(ids[j])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(f) if f else np.zeros(0), pa.int64()) for f in found], ["a", "b"])

        return work

    near = map_rows(both.select("x", "y"), descend, "a long, b long", 8)
    return near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def linked(docs: DataFrame, classes: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, component) of the classes with a link; components are those of all pairs of sets that link."""
    comps = None
    for column in ("early", "late"):
        members = classes.select(F.explode(column).alias("root"), "id", "n")
        roots = members.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("tokens"), F.min("id").alias("least"), F.max("id").alias("most")).where("k > 1")
        roots = materialize(roots, "roots")
        is_leaf = (F.col("k") <= LEAF) & (F.col("tokens") <= LEAF_TOKENS)
        twos = roots.where("k = 2").select(F.array("least", "most").alias("ids"))
        more = materialize(members.join(small(materialize(roots.where("k > 2").select("root", is_leaf.alias("leaf")), "more-roots")), "root"), "more")
        large = more.where("not leaf").select("root", "id")
        if not large.isEmpty():
            comps = extended(comps, _confirmed(docs, classes, _pivot_pairs(large), width, percent))
            left = materialize(_mixed(_placed(large, comps), "root", "large"), "open")
            if not left.isEmpty():
                comps = extended(comps, _confirmed(docs, classes, _block_pairs(classes, left, percent), width, percent))
        groups = more.where("leaf").groupBy("root").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids")
        comps = extended(comps, _leaf_links(docs, classes, twos.unionByName(groups), comps, width, percent))
    return comps


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    schema = "doc_id long, n long, low long, high long, bits binary, early array<long>, late array<long>"
    rows = materialize(map_rows(_rows(docs), _signatures(width, percent), schema, 256), "signatures")
    full, alone = rows.where("n > 0 and doc_id is not null"), rows.where("n = 0 or doc_id is null")
    classes = materialize(full.groupBy("low", "high").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "bits", "early", "late"))), "classes")
    comps = linked(docs, classes, width, percent)
    named = materialize(classes.join(comps, "id", "left").select("low", "high", F.coalesce("component", "id").alias("component_id")), "components")
    out = full.select("doc_id", "n", "low", "high").join(named, ["low", "high"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
