"""The trie of rebuilt conversations against a brute-force version."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateweave.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)

    def below(node):
        todo = [node]
        while todo:
            n = todo.pop()
            yield n
            todo += kids[n]

    out = []
    for node, who in members.items():
        sub = list(below(node))
        ends = sorted(c for c in who if len(rebuilt[c]) == len(node))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]), sum(not kids[n] for n in sub),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in sub if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def invented(seed, convs=260, words=3, most=9):
    """Few different turns, so that conversations share heads and some are equal."""
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.choice(convs * 2, convs, replace=False).tolist():
        for t in range(int(rng.integers(1, most))):
            out.append((c, t, ["user", "assistant"][t % 2], "é" * int(rng.integers(1, words + 1))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_like_brute_force(spark, seed):
    rows = invented(seed)
    assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_edges(spark):
    rows = [
        (None, 0, "user", "no id"), (1, None, None, None), (1, None, "user", ""), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, "x", "long " * 30000), (3, 5, "x", "long " * 30000 + "tail"),
        (100, 1, "user", "head"), (100, None, "user", "first"), (101, 0, "", "own"), (101, 0, "", "own 2"), (250, 0, "user", None), (-7, 0, "user", "minus"), (0, 0, "user", "zero"), (0, 0, "user", "zero"),
    ] + [(c, t, "user", "same") for c in range(300, 340) for t in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("depth", "n", "part", "f1", "head", "node", "i", "begin", "x1")}).repartition(7)
    want = brute([(c, t, r, x) for c, t, r, x in rows if c is None or c >= 0])
    assert rows_of(prefix_trie.trie(frame.where("conv_id is null or conv_id >= 0"))) == want
    assert prefix_trie.trie(frame.where("conv_id = -99")).count() == 0
    assert prefix_trie.trie(frame).where("depth = 0").first().conv_id == -7


def test_one_conversation_over_many_tasks(spark):
    rows = [(7, t, "user", f"t{t % 50}") for t in range(4000)] + [(5, t, "user", f"t{t % 50}") for t in range(4000)] + [(c, t, "user", f"t{t}") for c in range(20, 60) for t in range(4)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(9)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = prefix_trie.trie(frame)
        got = {(r.conv_id, r.depth): r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    tall = [r for r in got.values() if r.depth > 100]
    longest = max(r.depth for r in tall)
    longest = max(r.depth for r in tall)
    assert {r.n_leaves for r in tall} <= {1, 2} and longest == 4000 - min(prefix_trie.head_size(c) for c in (5, 7))
    assert got[(min(r.conv_id for r in tall if r.depth == longest), longest)].n_children == 0


def test_collisions_are_found_and_repeated(spark, monkeypatch):
    """With hashes and bases that collide at first, the result is the same."""
    rows = invented(5)
    frame, tried = spark.createDataFrame(rows, SCHEMA), []

    def weak(conversations, seed):
        tried.append(seed)
        out = strong(conversations, seed)
        return out.withColumns({c: F.pmod(c, F.lit(2)) for c in ("x1", "x2")}) if seed == 1 else out

    class Zero(prefix_trie.Monoid):
        def __init__(self, seed):
            super().__init__(seed)
            if seed == 2:
                self.tables = [np.ones_like(t) for t in self.tables]
                self.back = np.ones(4, np.uint64)

    strong = prefix_trie._turns
    monkeypatch.setattr(prefix_trie, "_turns", weak)
    monkeypatch.setattr(prefix_trie, "Monoid", Zero)
    assert rows_of(prefix_trie.trie(frame)) == brute(rows)
    assert tried == [1, 2, 3]


def test_monoid():
    m, rng = prefix_trie.Monoid(3), np.random.default_rng(0)
    x = rng.integers(0, 2**32 - 100, (50, 4), np.uint64)
    whole = sum(x[i].astype(object) * m.power(np.array([i]))[0].astype(object) for i in range(50)) % prefix_trie.PRIMES.astype(object)
    left, right = (sum(x[k + i].astype(object) * m.power(np.array([i]))[0].astype(object) for i in range(n)) % prefix_trie.PRIMES.astype(object) for k, n in ((0, 20), (20, 30)))
    assert (m.times(left.astype(np.uint64), np.array([20]), right.astype(np.uint64))[0] == whole.astype(np.uint64)).all()
    n = 123_456_789
    assert (m.power(np.array([n]))[0] == [pow(int(b), n, int(p)) for b, p in zip(m.base, prefix_trie.PRIMES, strict=True)]).all()
