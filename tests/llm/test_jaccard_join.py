"""The n-gram Jaccard join against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stateweave.llm import jaccard_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    out, word = [], ""
    for c in (text or "").translate(LOWER) + " ":
        if c in " \t\n\r\x0b\x0c":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute(rows, width=3, percent=90):
    sets = {}
    for i, text in rows:
        w = words_of(text)
        sets.setdefault(i, []).append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    flat = [(i, s) for i, many in sets.items() if i is not None for s in many if s]
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(flat):
        for j, t in flat[:k]:
            if 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i)) for i, many in sets.items() for s in many), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[int(rng.integers(len(words)))] = f"e{rng.integers(10**6)}"
    return words


def corpus(seed, originals=40):
    """Copies with 0 to a few edits, so that similarities lie on both sides of the limit, and texts that share long passages."""
    rng = np.random.default_rng(seed)
    texts, passage = [], [f"p{k}" for k in range(60)]
    for _ in range(originals):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.choice([5, 12, 25, 60, 150, 400])))]
        texts += [base] + [edited(base, rng, int(rng.integers(0, 1 + max(1, len(base) // 40)))) for _ in range(int(rng.integers(0, 6)))]
        texts.append(passage + base[:30])
    return [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]


@pytest.mark.parametrize("seed", range(2))
def test_like_all_pairs(spark, seed):
    rows = corpus(seed)
    assert got(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


@pytest.mark.parametrize("leaf, block", [(3, 2), (8, 4)])
def test_large_roots(spark, monkeypatch, leaf, block):
    """Every root is large: pivots, nodes, pairs of nodes and members over tasks."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows = corpus(2, 15) + [(1000 + k, " ".join(edited(base, rng, int(rng.integers(1, 4))))) for k in range(120)]
    assert got(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


def test_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 8)
    monkeypatch.setattr("stateweave.llm.common.HOT_ROWS", 8)
    monkeypatch.setattr("stateweave.llm.common.BROADCAST_BYTES", 0)
    monkeypatch.setattr(jaccard_join, "LEAF", 16)
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 500, 200)]
    rows = [(k, " ".join(edited(base, rng, int(rng.integers(0, 4))))) for k in range(150)]
    assert got(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{k % 997}x{k % 13}" for k in range(20000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "one"), (7, "one two three"), (8, "one two three"), (8, "one two three"), (9, long), (10, long + " tail"), (11, "É two three"), (12, "é two three"), (None, "one two three")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "n", "c", "set", "root", "early", "leaf", "low", "bits")})
    want = [r for r in brute([r for r in rows if r[0] is not None])] + [(None, 1, None)]
    assert got(jaccard_join.join(frame)) == sorted(want, key=str)
    assert jaccard_join.join(frame.where("doc_id = -1")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(10, 400), st.integers(0, 30), st.sampled_from([70, 80, 90, 95]))
def test_linked_sets_share_a_root(seed, size, changed, percent):
    """No linked pair is without a common root, whatever its sizes; and no node that holds it is pruned."""
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**64, size, np.uint64, endpoint=False))
    drop = rng.permutation(len(x))[: rng.integers(0, changed + 1)]
    y = np.unique(np.concatenate((np.delete(x, drop), rng.integers(0, 2**64, int(rng.integers(0, changed + 1)), np.uint64))))
    if not len(y) or not jaccard_join.similar(x, y, percent) or np.array_equal(x, y):
        return
    roots = jaccard_join.Roots(percent)
    every = [set(np.concatenate([r for part in roots.of(v) for r in part]).tolist()) for v in (x, y)]
    assert every[0] & every[1]
    others = [np.unique(rng.integers(0, 2**64, size, np.uint64)) for _ in range(20)]
    sets = [x, *others, y]
    maps, sizes = jaccard_join.folded([jaccard_join.bitmap(v) for v in sets]), np.array([len(v) for v in sets])
    found = jaccard_join.partners(maps, sizes, np.arange(len(sets)), percent)
    assert found[0] and found[-1]
    assert jaccard_join.link(np.arange(len(sets)), np.arange(len(sets)), sets, percent) == [(21, 0)]


def test_sparse_sets_meet(spark):
    """Sets whose tokens lie in few ranges meet under a root of their own."""
    roots = jaccard_join.Roots(90)
    x = np.arange(1, 31, dtype=np.uint64)  # all in the first range
    y = np.append(x[:-1], np.uint64(5000))
    every = [set(np.concatenate([r for part in roots.of(v) for r in part]).tolist()) for v in (x, y)]
    assert every[0] & every[1]


def test_dual_traversal_prunes():
    """Of 1,000 unrelated sets hardly any pair is left, and far fewer pairs than all are looked at."""
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**64, int(n), np.uint64)) for n in rng.integers(100, 110, 1000)]
    maps, sizes = jaccard_join.folded([jaccard_join.bitmap(v) for v in sets]), np.array([len(v) for v in sets])
    assert not jaccard_join.partners(maps, sizes, np.arange(1000), 90).any()
    assert len(list(jaccard_join.shingle_sets(pa.array(["a b c d", None]), 3))) == 2
