"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is its distinct 5-word shingles (A-Z in lower case), as 64-bit hashes. Equal sets are one class. Each of
``TREES`` trees branches the classes by selected minwise tokens: a node chooses ``BRANCHES`` of the ``K`` min-hash functions
by its path, and a class goes to the children of its tokens. Nodes of at most ``LEAF`` classes (and ``LEAF_SHINGLES``
shingles) are compared exhaustively in one task: sketches find the members that may have a partner, and full sets of
these confirm links, until everything left is connected or fails. The first tree is linked first; the others then skip nodes
whose members are connected already. A larger node compares all members with its pivots on full sets; if these links, with
all found so far, connect the whole node it is done, else it branches. Nodes still larger at ``DEPTH`` are compared in
blocks: all members outside the node's main component against all members. Nothing is capped.

With trees x branches root tokens a pair of similarity 0.80 shares none with probability 0.2^8, one of 0.85 with 0.15^8.

Defined results: null and empty texts have an empty set, linked with nothing; a null doc_id has no component and is kept;
repeated rows form one class; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, map_rows, materialize, mix, shingles, small, spread_join, word_hashes
from .components import extended

WIDTH = 5
#: Least similarity of a link: of ``group`` and op2's query, and of the pipeline's stage.
PERCENT = 85
STAGE_PERCENT = 80
K = 128
TREES = 4
BRANCHES = 2
LEAF = 8192
LEAF_SHINGLES = 2_000_000
DEPTH = 5
PIVOTS = 2
BLOCK = 2048
#: Hashes that this share (1 / ``COMMON``) of a leaf's members hold are kept as bits.
COMMON = 16
#: Sketches of a pair may show so much less than its similarity.
SKETCH_SLACK = 20

_SEEDS = np.random.default_rng(11).integers(1, 2**32, (2, K), np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    hashes, counts = word_hashes(texts)
    every, ends = shingles(hashes, WIDTH), np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        yield np.unique(every[a : b - WIDTH + 1]) if b - a >= WIDTH else shingles(hashes[a:b], WIDTH)


def signature(values: np.ndarray) -> np.ndarray:
    """``K`` minwise values of a set, over two halves of its hashes; all ones for the empty set."""
    out = np.full(K, 2**32 - 1, np.uint32)
    low, high = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(values), 512):
        h = low[at : at + 512] ^ _SEEDS[1, :, None]
        h *= _SEEDS[0, :, None]
        h += high[at : at + 512]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(out, h.min(1), out=out)
    return out


def _hash(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.asarray(p).astype(np.uint64) + np.uint64(1))
    return out


def children(path: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Paths of the children (rows x branches) of nodes ``path`` for classes of signatures ``sig`` (rows x K)."""
    rows = np.arange(len(path))
    out = []
    for b in range(BRANCHES):
        k = (_hash(path, np.uint64(1000 + b)) % np.uint64(K)).astype(np.int64)
        out.append(_hash(path, k, sig[rows, k]))
    return np.column_stack(out).view(np.int64)


def _signatures():
    roots = _hash(np.arange(TREES))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, low, high, sigs, paths = [], [], [], [], []
        with np.errstate(over="ignore"):
            for values in shingle_sets(batch.column("text")):
                n.append(len(values))
                d = digest(values)
                low.append(d[0]), high.append(d[1])
                sigs.append(signature(values))
            s = np.array(sigs)
            paths = np.column_stack([children(np.full(len(s), r), s) for r in roots])
        cols = [pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array([x.tobytes() for x in sigs], pa.binary())]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * paths.shape[1], pa.int32()), pa.array(paths.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, lists], ["doc_id", "n", "low", "high", "sig", "paths"])

    return work


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digest(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        return int(np.add.reduce(mix(values)).astype(np.int64)), int(np.bitwise_xor.reduce(mix(values + np.uint64(77))).astype(np.int64))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (one row per id: id, low, high and more) with ``set``, made anew from the texts of that digest."""
    texts = _rows(docs).withColumnRenamed("doc_id", "id")
    wanted = small(wanted)
    joined = texts.join(wanted, "id")  # ids differ
    names = [c for c in joined.columns if c != "text"]
    schema = ", ".join(f"{c} {t}" for c, t in joined.dtypes if c != "text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets, ok = [], []
            for values, low, high in zip(shingle_sets(batch.column("text")), batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
                ok.append(digest(values) == (low, high))
                sets.append(values.tobytes())
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "set"]).filter(pa.array(ok, pa.bool_()))

        return work

    return map_rows(joined, make, f"{schema}, set binary", 128)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= ``percent`` * union, of sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.searchsorted(b, a).clip(0, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch_limit(percent: int) -> float:
    return (percent - SKETCH_SLACK) / 100


def partners(sigs: np.ndarray, sizes: np.ndarray, parts: np.ndarray, percent: int) -> np.ndarray:
    """Which members have, by sketches and sizes, a possible partner in another part."""
    found = np.zeros(len(sizes), bool)
    for i in range(len(sizes) - 1):
        rest = np.flatnonzero((100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])) & (parts[i + 1 :] != parts[i])) + i + 1
        if len(rest):
            near = rest[(sigs[rest] == sigs[i]).mean(1) >= sketch_limit(percent)]
            found[near] = True
            found[i] |= len(near) > 0
    return found


def overlaps(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function of a member and others: the exact sizes of their intersections.

    Hashes that one in ``COMMON`` members or more hold are bits of a row for each member, at most ``COMMON`` bits for each
    shingle of the leaf; the members that hold a rarer one are looked up.
    """
    n, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    token, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner, common = np.repeat(np.arange(n), size), held >= max(2, n / COMMON)
    marks = np.zeros((n, -(-int(common.sum()) // 64) * 64), bool)
    often = common[token]
    marks[owner[often], (np.cumsum(common) - 1)[token[often]]] = True
    bits = np.packbits(marks, 1).view(np.uint64)
    seldom = ~often & (held[token] > 1)
    mine, rare = owner[seldom], token[seldom]
    first = np.searchsorted(mine, np.arange(n + 1))
    order = np.argsort(rare, kind="stable")
    holders, begin, end = mine[order], *(np.searchsorted(rare[order], rare, side) for side in ("left", "right"))

    def both(i: int, others: np.ndarray) -> np.ndarray:
        at, to = begin[first[i] : first[i + 1]], end[first[i] : first[i + 1]]
        ends = np.cumsum(to - at)
        found = holders[np.repeat(to - ends, to - at) + np.arange(ends[-1] if len(ends) else 0)]
        return np.bitwise_count(bits[others] & bits[i]).sum(1, dtype=np.int64) + np.bincount(found, minlength=n)[others]

    return both


def link_leaf(ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (id, least id of its group) that connect a leaf's classes as all its similar pairs would.

    ``parts`` are components known before. A class meets all later ones of other parts at once.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    both = overlaps(sets)
    part = np.unique(parts, return_inverse=True)[1]
    before = part.copy()
    for i in range(len(ids) - 1):
        rest = size[i + 1 :]
        other = np.flatnonzero((part[i + 1 :] != part[i]) & (100 * np.minimum(rest, size[i]) >= percent * np.maximum(rest, size[i]))) + i + 1
        if not len(other):
            continue
        common = both(i, other)
        near = np.zeros(len(ids), bool)
        near[part[other[100 * common >= percent * (size[i] + size[other] - common)]]] = True
        if near.any():
            part[near[part]] = part[i]
    least: dict[int, int] = {}
    for k, i in zip(part.tolist(), ids.tolist(), strict=True):
        least[k] = min(i, least.get(k, i))
    return [(i, least[k]) for i, k, b in zip(ids.tolist(), part.tolist(), before.tolist(), strict=True) if i != least[k]]


def _leaf_links(docs: DataFrame, classes: DataFrame, members: DataFrame, comps: DataFrame | None, unique: bool, percent: int) -> DataFrame:
    """Links within leaves; ``members`` has (path, id). Leaves of the same members, or of one component, are left out."""
    leaves = members.groupBy("path").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most LEAF each
    leaves = leaves.groupBy(F.xxhash64("ids").alias("leaf"), F.size("ids").alias("size")).agg(F.first("ids").alias("ids"))
    inside = leaves.select("leaf", F.explode("ids").alias("id"))
    if comps is None:
        inside = inside.withColumn("c", F.col("id"))
    else:
        placed = inside.join(comps.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
        placed = materialize(placed, "placed")
        mixed = placed.groupBy("leaf").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("leaf")
        inside = placed.join(mixed, "leaf")
    known = inside.join(classes.select("id", "n", "low", "high", "sig"), "id")
    groups = known.groupBy("leaf").agg(F.collect_list(F.struct("id", "c", "n", "low", "high", "sig")).alias("g"))

    def select():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            for leaf, g in zip(batch.column("leaf").to_pylist(), batch.column("g"), strict=True):
                v = g.values
                ids, c, n, low, high = (np.asarray(v.field(k)) for k in range(5))
                at = np.flatnonzero(partners(np.frombuffer(b"".join(v.field(5).to_pylist()), np.uint32).reshape(-1, K), n, c, percent))
                for col, x in zip(cols, (np.full(len(at), leaf), ids[at], c[at], low[at], high[at]), strict=True):
                    col.append(x)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["leaf", "id", "c", "low", "high"])

        return work

    wanted = map_rows(groups, select, "leaf long, id long, c long, low long, high long", 64)
    by_id = wanted.groupBy("id", "low", "high").agg(F.collect_list(F.struct("leaf", "c")).alias("at"))
    full = _sets(docs, materialize(by_id, "wanted"))
    full = full.select("id", "set", "at") if unique else full.groupBy("id").agg(F.first("set").alias("set"), F.first("at").alias("at"))
    full = full.select("id", "set", F.explode("at").alias("x")).select("x.leaf", F.struct("id", "x.c", "set").alias("m"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for g in batch.column("g"):
                v = g.values
                found += link_leaf(np.asarray(v.field(0)), np.asarray(v.field(1)), [np.frombuffer(x, np.uint64) for x in v.field(2).to_pylist()], percent)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["a", "b"])

        return work

    return map_rows(full.groupBy("leaf").agg(F.collect_list("m").alias("g")).select("g"), make, "a long, b long", 64)


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar."""
    pairs = materialize(pairs.distinct(), "pairs")
    ids = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "pair-ids")
    wanted = materialize(classes.join(ids, "id").select("id", "low", "high"), "pair-classes")
    sets = materialize(_sets(docs, wanted).groupBy("id").agg(F.first("set").alias("set")), "pair-sets")
    rows = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS), "pair-counts")
    both = spread_join(pairs, sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a", rows.withColumnRenamed("id", "a"), F.col("b"))
    both = spread_join(both, sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b", rows.withColumnRenamed("id", "b"), F.col("a"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = batch.column("x"), batch.column("y")
            ok = [similar(np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64), percent) for k in range(batch.num_rows)]
            return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return work

    return materialize(map_rows(both, make, "a long, b long", 128), "confirmed")


def _counted(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (path, id, n) of leaves and of larger nodes; nodes of one member go."""
    sizes = materialize(members.groupBy("path").agg(F.count("*").alias("c"), F.sum("n").alias("w")).where("c > 1"), "nodes")
    known = materialize(spread_join(members, sizes, "path", sizes.select("path", F.col("c").alias("n")), F.col("id")), "members")
    is_leaf = (F.col("c") <= LEAF) & (F.col("w") <= LEAF_SHINGLES)
    return known.where(is_leaf).select("path", "id", "n"), known.where(~is_leaf).select("path", "id", "n")


def _branched(members: DataFrame, classes: DataFrame) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, K)
            paths = children(np.asarray(batch.column("path")).view(np.uint64), sig)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(paths) + 1) * BRANCHES, pa.int32()), pa.array(paths.ravel()))
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), lists], ["id", "n", "paths"])

        return work

    return map_rows(members.join(classes.select("id", "sig"), "id"), make, "id long, n long, paths array<long>", 4096).select(F.explode("paths").alias("path"), "id", "n")


def _open_nodes(large: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of large nodes that no links connect so far, with their component ``c``."""
    placed = materialize(large.join(comps.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id")), "placed")
    nodes = materialize(placed.groupBy("path").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("n")).where("least <> most").select("path", "n"), "open-nodes")
    return materialize(spread_join(placed, nodes.select("path"), "path", nodes, F.col("id")), "open")


def _pivot_pairs(large: DataFrame) -> DataFrame:
    picks = [F.min_by("id", F.xxhash64("id", F.lit(p))).alias(f"p{p}") for p in range(PIVOTS)]
    pivots = materialize(large.groupBy("path").agg(*picks, F.count("*").alias("n")), "pivots")
    pairs = spread_join(large, pivots.drop("n"), "path", pivots.select("path", "n"), F.col("id")).select("id", F.explode(F.array(*(f"p{p}" for p in range(PIVOTS)))).alias("p"))
    return pairs.where("id <> p").select(F.greatest("id", "p").alias("a"), F.least("id", "p").alias("b"))


def _block_links(docs: DataFrame, classes: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links in nodes that stay large: members outside the node's main component, each against every block of ``BLOCK`` members, by sketches."""
    sizes = nodes.groupBy("path", "c").agg(F.count("*").alias("k"))
    parts = F.ceil(F.sum("k") / BLOCK).cast("int").alias("parts")
    main = small(materialize(sizes.groupBy("path").agg(F.max_by("c", "k").alias("main"), parts), "main"))
    side = materialize(nodes.join(main, "path").join(classes.select("id", "sig"), "id"), "blocks")
    asked = side.where("c <> main").select("path", F.struct("id", "c", "n", "sig").alias("q"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    every = side.select("path", F.struct("id", "c", "n", "sig").alias("x"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("block"))
    fits = (F.col("q.c") != F.col("x.c")) & (100 * F.least("q.n", "x.n") >= percent * F.greatest("q.n", "x.n"))
    both = asked.join(every, ["path", "block"]).where(fits).select(F.col("q.id").alias("a"), F.col("x.id").alias("b"), F.col("q.sig").alias("s"), F.col("x.sig").alias("t"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, K) for c in "st")
            return batch.select(["a", "b"]).filter(pa.array((s == t).mean(1) >= sketch_limit(percent)))

        return work

    near = map_rows(both, make, "a long, b long", 4096)
    return _confirmed(docs, classes, near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), percent)


def linked(docs: DataFrame, classes: DataFrame, unique: bool, percent: int) -> DataFrame:
    """(id, component) of the classes with a link; components are those of all pairs of similar sets."""
    roots = classes.select(F.posexplode("paths").alias("root", "path"), "id", "n")
    comps = None
    for level in (roots.where(F.col("root") < BRANCHES), roots.where(F.col("root") >= BRANCHES)):
        leaves, level = [], level.select("path", "id", "n")
        for depth in range(DEPTH + 1):
            few, large = _counted(level)
            leaves.append(few)
            if large.isEmpty():
                break
            comps = extended(comps, _confirmed(docs, classes, _pivot_pairs(large), percent))
            open_ = _open_nodes(large, comps)
            if open_.isEmpty():
                break
            if depth == DEPTH:
                comps = extended(comps, _block_links(docs, classes, open_, percent))
            else:
                level = _branched(open_.select("path", "id", "n"), classes)
        comps = extended(comps, _leaf_links(docs, classes, _union(leaves), comps, unique, percent))
    return comps


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = materialize(map_rows(_rows(docs), _signatures, "doc_id long, n long, low long, high long, sig binary, paths array<long>", 256), "signatures")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("low", "high").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("paths").alias("paths"))
    classes = materialize(classes, "classes")
    ids = rows.where("doc_id is not null").select("doc_id")
    comps = linked(docs, classes, ids.count() == ids.distinct().count(), percent)
    named = classes.join(comps, "id", "left").select("low", "high", F.coalesce("component", "id").alias("component_id"))
    named = materialize(named, "components")
    full, alone = rows.where("n > 0 and doc_id is not null"), rows.where("n = 0 or doc_id is null")
    out = full.select("doc_id", "n", "low", "high").join(named, ["low", "high"]).select("doc_id", "n", "component_id")
    out = out.unionByName(alone.select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def apply(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """The kept document of each group, in the columns of ``docs``; rows that repeat an id and text leave one."""
    gone = small(materialize(group(docs, percent).where("not kept").select(F.col("doc_id").alias("_sw_id")).distinct(), "gone"))
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col("_sw_id"), "left_anti")
    ids = docs.where("doc_id is not null").select("doc_id")
    return left if ids.count() == ids.distinct().count() else left.dropDuplicates(["doc_id", "text"])
