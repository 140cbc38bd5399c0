"""A trie of rebuilt conversations, from composable fingerprints of their turns.

A conversation c is rebuilt from the first h turns of its base (conversation c - c % 100) and its own turns after its first h.
A sequence's fingerprint is an element of a monoid: (sum of x_i B^i, length) over four prime fields, where x_i are the
lanes of a turn's hash; (H, n) * (K, m) = (H + B^n K, n + m). Turns are sorted over all tasks; each task multiplies up its own
stretch of a conversation, and the stretches' products are combined from their totals, so a conversation may be longer than
a task. As B is invertible, the fingerprint of a rebuilt conversation's first d turns is that of the base's head times that of
its own turns from h on: rebuilt texts never exist, only (conversation, depth) references with 128-bit products.

References with one product form a node. That every turn hash stands for one (role, text), and that all references of a node
name one last turn and one parent node, is checked over all of them (by induction their texts are then equal); a collision
repeats the work with another base and other hashes.

A node belongs to its smallest member, so each conversation owns one chain: its deepest nodes. Sums over subtrees are then
running sums along chains, plus, for every member that doesn't own the node, its whole chain. Hashes of ended members are
streamed in ranges of ids: at most ``CHUNK`` ids are in memory.

Defined results: rows without conv_id go; a null turn comes first; rows of one turn are ordered by role and the first ``SORTED``
characters of text, then by a hash; null role or text is empty; repeated rows are turns of their own; conversations without turns
are members of the root; an empty table gives no node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateweave.operators.scan import running_sums

from .common import map_rows, materialize, spread_join

GROUP = 100
HEADS = 6
SORTED = 256
CHUNK = 16_384
ATTEMPTS = 8
# The largest primes below 2^32.
PRIMES = np.array([4294967291, 4294967279, 4294967231, 4294967197], np.uint64)
MEMBERS = "conv_id long, depth long, n_chars long, x1 long, x2 long, f1 long, f2 long, p1 long, p2 long, ends boolean"


class Monoid:
    """Fingerprints (rows of four lanes) of sequences of turns."""

    def __init__(self, seed: int):
        self.base = np.random.default_rng(seed).integers(2**16, 2**32 - 100, 4, np.uint64)
        self.back = np.array([pow(int(b), -1, int(p)) for b, p in zip(self.base, PRIMES, strict=True)], np.uint64)
        self.tables = []
        step = self.base
        for _ in range(3):
            table = [np.ones(4, np.uint64)]
            for _ in range(4095):
                table.append(table[-1] * step % PRIMES)
            self.tables.append(np.array(table))
            step = table[-1] * step % PRIMES

    def power(self, n: np.ndarray) -> np.ndarray:
        """B^n, for n below 2^36."""
        n = np.asarray(n, np.int64)
        out = self.tables[0][n & 4095]
        for k in (1, 2):
            digit = n >> 12 * k & 4095
            if digit.any():
                out = out * self.tables[k][digit] % PRIMES
        return out

    def unpower(self, n: int) -> np.ndarray:
        return np.array([pow(int(b), n, int(p)) for b, p in zip(self.back, PRIMES, strict=True)], np.uint64)

    def times(self, h: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The product of (h, n) and (k, any)."""
        return (h + self.power(n) * k % PRIMES) % PRIMES


def lanes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The four lanes of two signed 64-bit columns."""
    a, b = (np.asarray(x).view(np.uint64) for x in (a, b))
    low = np.uint64(2**32 - 1)
    return np.column_stack([a >> np.uint64(32), a & low, b >> np.uint64(32), b & low])


def packed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = h.reshape(-1, 4)
    return tuple((h[:, k] << np.uint64(32) | h[:, k + 1]).view(np.int64) for k in (0, 2))


def head_size(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _turns(conversations: DataFrame, seed: int) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    hashes = {f"x{k + 1}": F.xxhash64(F.lit(2 * seed + k), "role", "text") for k in range(2)}
    return rows.withColumns(hashes)


def _collide(turns: DataFrame) -> bool:
    """Whether a hash stands for two different turns."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("role", "text") for n, f in (("least", F.min), ("most", F.max))]
    return not turns.groupBy("x1", "x2").agg(*ends).where("least_role <> most_role or least_text <> most_text").isEmpty()


def _stretches(turns: DataFrame, monoid: Monoid) -> DataFrame:
    """Each turn with its stretch (a task's rows of its conversation), its place there and the product up to it."""
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "begin", "tie"]
    rows = turns.select("conv_id", "turn", "role", F.substring("text", 1, SORTED).alias("begin"), F.xxhash64("text").alias("tie"), F.length("text").cast("long").alias("n_chars"), "x1", "x2")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, at, carry = TaskContext.get().partitionId(), None, 0, np.zeros(4, np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 65_536):  # sums of so many lanes stay below 2^64
                some = batch.slice(start, 65_536)
                ids = np.asarray(some.column("conv_id"))
                n = len(ids)
                first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
                run_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
                i = np.arange(n) - first[run_of]
                if ids[0] == conv:
                    i[run_of == 0] += at
                sums = np.cumsum(lanes(some.column("x1"), some.column("x2")) % PRIMES * monoid.power(i) % PRIMES, axis=0)
                before = np.vstack([np.zeros((1, 4), np.uint64), sums])[first]
                h = sums - before[run_of]
                if ids[0] == conv:
                    h[run_of == 0] += carry
                h %= PRIMES
                conv, at, carry = ids[-1], int(i[-1]) + 1, h[-1]
                cols = [some.column("conv_id"), pa.array(np.full(n, part, np.int32)), pa.array(i), *(some.column(c) for c in ("n_chars", "x1", "x2")), *map(pa.array, packed(h))]
                yield pa.RecordBatch.from_arrays(cols, ["conv_id", "part", "i", "n_chars", "x1", "x2", "h1", "h2"])

    return materialize(rows.mapInArrow(run, "conv_id long, part int, i long, n_chars long, x1 long, x2 long, h1 long, h2 long"), "stretches")


def _plans(stretches: DataFrame, monoid: Monoid) -> DataFrame:
    """A row per conversation: how it is rebuilt, the offsets of its stretches and the head that it takes from its base."""
    head = F.collect_list(F.when(F.col("i") < HEADS, F.struct("i", "n_chars", "x1", "x2")))
    totals = stretches.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.max_by(F.struct("h1", "h2"), "i").alias("h"), F.sort_array(head).alias("head"))
    convs = totals.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "h", "head"))).alias("parts"))  # at most a row for each task

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                h, n, total, offsets, head = head_size(conv), 0, np.zeros(4, np.uint64), [], []
                prefix = np.zeros(4, np.uint64)
                at_h = prefix if h == 0 else None
                for p in parts:
                    t1, t2 = (int(x[0]) for x in packed(total))
                    offsets.append({"part": p["part"], "before": n, "t1": t1, "t2": t2})
                    for turn in p["head"]:
                        if len(head) < HEADS:
                            x = lanes(np.array([turn["x1"]]), np.array([turn["x2"]]))[0] % PRIMES
                            prefix = monoid.times(prefix, np.array([len(head)]), x)[0]
                            f1, f2 = (int(v[0]) for v in packed(prefix))
                            head.append({"n_chars": turn["n_chars"], "x1": turn["x1"], "x2": turn["x2"], "f1": f1, "f2": f2})
                            at_h = prefix if len(head) == h else at_h
                    total = monoid.times(total, np.array([n]), lanes(np.array([p["h"]["h1"]]), np.array([p["h"]["h2"]]))[0])[0]
                    n += p["n"]
                a1, a2 = (int(v[0]) for v in packed(total if at_h is None else at_h))
                out.append((conv, h, n, a1, a2, offsets, head[: HEADS - 1]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        return work

    long = pa.int64()
    names = ["conv_id", "h", "n", "a1", "a2", "offsets", "head"]
    types = [long, long, long, long, long, pa.list_(pa.struct([("part", pa.int32()), ("before", long), ("t1", long), ("t2", long)])), pa.list_(pa.struct([(c, long) for c in ("n_chars", "x1", "x2", "f1", "f2")]))]
    schema = "conv_id long, h long, n long, a1 long, a2 long, offsets array<struct<part: int, before: long, t1: long, t2: long>>, head array<struct<n_chars: long, x1: long, x2: long, f1: long, f2: long>>"
    convs = materialize(map_rows(convs, make, schema), "conversations")
    bases = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))  # fewer than 2 * GROUP rows take one
    plans = convs.drop("head").join(bases, F.col("conv_id") - F.col("conv_id") % GROUP == F.col("base"), "left")
    plans = plans.withColumn("head", F.expr("if(base_head is null, array(), slice(base_head, 1, cast(h as int)))")).drop("base", "base_head")
    plans = plans.withColumn("taken", F.size("head").cast("long"))
    last = F.when(F.col("taken") > 0, F.element_at("head", F.greatest("taken", F.lit(1)).cast("int")))
    ends = {"e1": F.coalesce(last["f1"], F.lit(0).cast("long")), "e2": F.coalesce(last["f2"], F.lit(0).cast("long")), "length": F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))}
    return materialize(plans.withColumns(ends), "plans")


def _members(stretches: DataFrame, plans: DataFrame, monoid: Monoid) -> DataFrame:
    """(conv_id, depth) references of all rebuilt turns and of the root: products up to them and to their parents, and whether the conversation ends there."""
    zero = F.lit(0).cast("long")
    none = [zero.alias(c) for c in ("n_chars", "x1", "x2", "f1", "f2", "p1", "p2")]
    root = plans.select("conv_id", zero.alias("depth"), *none, (F.col("length") == 0).alias("ends"))
    heads = plans.select("conv_id", "length", "head", F.posexplode("head").alias("k", "t"))
    before = lambda c: F.when(F.col("k") > 0, F.col("head")[F.greatest(F.col("k") - 1, F.lit(0))][c]).otherwise(zero).alias(c.replace("f", "p"))
    depth = (F.col("k") + 1).cast("long")
    heads = heads.select("conv_id", depth.alias("depth"), *(F.col(f"t.{c}") for c in ("n_chars", "x1", "x2", "f1", "f2")), before("f1"), before("f2"), (depth == F.col("length")).alias("ends"))
    at = plans.select("conv_id", "h", "taken", "length", "a1", "a2", "e1", "e2", F.explode("offsets").alias("o")).select("*", "o.part", "o.before", "o.t1", "o.t2").drop("o")
    own = stretches.join(at, ["conv_id", "part"]).where("before + i >= h")

    def make():
        shift = np.array([monoid.unpower(k) for k in range(HEADS)])

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            col = lambda c: np.asarray(batch.column(c))
            both = lambda c: lanes(col(f"{c}1"), col(f"{c}2"))
            prefix = monoid.times(both("t"), col("before"), both("h"))  # of its own turns, this one included
            suffix = (prefix + PRIMES - both("a")) % PRIMES * shift[col("h") - col("taken")] % PRIMES
            depth = col("taken") + col("before") + col("i") - col("h") + 1
            f = (both("e") + suffix) % PRIMES
            p = (f + PRIMES - both("x") % PRIMES * monoid.power(depth - 1) % PRIMES) % PRIMES
            cols = [batch.column("conv_id"), pa.array(depth), *(batch.column(c) for c in ("n_chars", "x1", "x2")), *map(pa.array, (*packed(f), *packed(p))), pa.array(depth == col("length"))]
            return pa.RecordBatch.from_arrays(cols, ["conv_id", "depth", "n_chars", "x1", "x2", "f1", "f2", "p1", "p2", "ends"])

        return work

    return materialize(root.unionByName(heads).unionByName(map_rows(own, make, MEMBERS, 16_384)), "references")


def _nodes(members: DataFrame) -> DataFrame | None:
    """A row per node; None if references of one product differ in their last turn or parent."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("x1", "x2", "p1", "p2") for n, f in (("least", F.min), ("most", F.max))]
    nodes = materialize(members.groupBy("depth", "f1", "f2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"), *ends), "nodes")
    if not nodes.where(" or ".join(f"least_{c} <> most_{c}" for c in ("x1", "x2", "p1", "p2"))).isEmpty():
        return None
    return nodes.select("depth", "f1", "f2", "conv_id", "n_convs", "n_chars", F.col("least_p1").alias("p1"), F.col("least_p2").alias("p2"))


def _ended(members: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of nodes where conversations end.

    Ids are sorted over all tasks and joined to texts of at most ``CHUNK`` ids; a node's texts, in order, pass through its hash.
    """
    key = ["depth", "f1", "f2"]
    ids = members.where("ends").select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            for start in range(0, batch.num_rows, CHUNK):
                d, f1, f2, conv = (c[start : start + CHUNK] for c in cols)
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])))
                first = np.flatnonzero(new)
                strings = [",".join(map(str, part.tolist())) for part in np.split(conv, first[1:])]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[first]) for c in (d, f1, f2, conv)), pa.array(strings)], [*key, "first", "ids"])

    chunks = materialize(ids.mapInArrow(texts, "depth long, f1 long, f2 long, first long, ids string"), "ended")
    chunks = chunks.repartition(*key).sortWithinPartitions(*key, "first")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([*(pa.array([x]) for x in node), pa.array([state.hexdigest()])], [*key, "ends_sha256"])
        done: list[tuple] = []
        for batch in batches:
            for d, f1, f2, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if (d, f1, f2) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (d, f1, f2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                cols = list(zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])], [*key, "ends_sha256"])
                done = []
        if node:
            yield row()

    return chunks.mapInArrow(hashes, "depth long, f1 long, f2 long, ends_sha256 string")


def _assembled(members: DataFrame, nodes: DataFrame, plans: DataFrame) -> DataFrame:
    key = ["depth", "f1", "f2"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("n_chars")
    # a conversation's chain, from its end upwards
    along = materialize(running_sums(known, ["conv_id"], [F.desc("depth")], {"n_leaves": leaf, "saved_tokens": saved}), "chains")
    tops = along.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("n_leaves").alias("chain_leaves"), F.max("saved_tokens").alias("chain_saved"))
    tops = materialize(tops, "tops")
    sizes = materialize(plans.select("conv_id", (F.col("length") + 1).alias("n")), "lengths")
    above = spread_join(members.select("conv_id", *key), tops.where("chain_leaves + chain_saved > 0"), "conv_id", sizes, F.col("depth")).where("depth < top")
    inherited = above.groupBy(*key).agg(F.sum("chain_leaves").alias("more_leaves"), F.sum("chain_saved").alias("more_saved"))
    # only the top of a chain has a parent of another owner
    tops_only = tops.select("conv_id", F.col("top").alias("depth")).join(along.select("conv_id", "depth", "p1", "p2", "f1", "f2"), ["conv_id", "depth"]).where("depth > 0")
    asked = tops_only.select(F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).alias("node"), *key, "conv_id")
    owners = nodes.select(F.struct(*key).alias("node"), F.col("conv_id").alias("parent_conv_id"))
    counts = along.select(F.struct(*key).alias("node"), F.col("n_children").alias("n"))
    parents = spread_join(asked, owners, "node", counts, F.col("conv_id")).select(*key, "parent_conv_id")
    out = along.join(inherited, key, "left").join(parents, key, "left").join(_ended(members), key, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("n_leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, seed: int = 1) -> DataFrame:
    """A row per node of the trie of rebuilt conversations."""
    for attempt in range(seed, seed + ATTEMPTS):
        turns, monoid = _turns(conversations, attempt), Monoid(attempt)
        if _collide(turns):
            continue
        stretches = _stretches(turns, monoid)
        plans = _plans(stretches, monoid)
        members = _members(stretches, plans, monoid)
        nodes = _nodes(members)
        if nodes is not None:
            return _assembled(members, nodes, plans)
    raise RuntimeError(f"fingerprints collided {ATTEMPTS} times")
