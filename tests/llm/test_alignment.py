"""Alignment of two tokenizers against a brute-force version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stateweave.llm import alignment

TEXTS = [
    None, "", " ", "a", "hello  world\n\tx", "a▁b", "漢字\U0001f600 naïve café<0x0A>", "<|endoftext|> and <s>hi</s>", "x" * 5000, "é" * 700, "one two three " * 400, "nul\0 in it", "12345 67,890.12!!",
]


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers()


def groups_of(both, text):
    """Groups (A's ids, B's ids) of a text, by walking both sides."""
    if not text:
        return []
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    letters = alignment.byte_letters()
    raw_a = [bytes(letters[c] for c in both.a.id_to_token(i)) for i in a]
    raw_b = [bytes([int(both.b.id_to_piece(i)[3:5], 16)]) if both.b.IsByte(i) else both.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return []
    out, i, j, x, y = [], 0, 0, 0, 0
    group = ([], [])
    while i < len(a) or j < len(b):
        if x <= y:
            x += len(raw_a[i])
            group[0].append(a[i])
            i += 1
        else:
            y += len(raw_b[j])
            group[1].append(b[j])
            j += 1
        if x == y:
            out.append(group)
            group = ([], [])
    return out


def brute(both, rows):
    found = [(i, groups_of(both, t)) for i, t in rows]
    counts = Counter((a[-1], b[-1]) for _, g in found for a, b in g)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for i, g in found:
        links = [(a[-1], b[-1]) for a, b in g]
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(spelled.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=str)


def test_like_brute_force(spark, both):
    rows = list(enumerate(TEXTS)) + [(3, "a"), (None, "no id"), (99, "a b c " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as links", "2 as n_a", "3 as pair", "4 as count").repartition(4)
    assert sorted((tuple(r) for r in alignment.digest(docs).collect()), key=str) == brute(both, rows)
    assert alignment.digest(docs.where("doc_id = -1")).count() == 0
    assert [tuple(r)[1:] for r in alignment.digest(docs.where("doc_id = 1")).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_on_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in alignment.digest(docs).collect()), key=str) == brute(both, rows)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from("ab  \n\té漢▁<s>0x'.\x1c\x85\u00a0\u3000"), max_size=40), min_size=1, max_size=5), min_size=1, max_size=1))
def test_any_texts(both, texts):
    texts = texts[0]
    coded = both.encode(texts)
    n, hashes, links = alignment.align(coded, both.bytes_a, both.bytes_b, alignment._decimals(50_300))
    want = [groups_of(both, t) for t in texts]
    assert n.tolist() == [len(g) for g in want]
    assert links.tolist() == [a[-1] << 32 | b[-1] for g in want for a, b in g]
    assert [h != "" for h in hashes] == [bool(g) for g in want]


def test_long_chains_double(both):
    """Tokens that never end together but at the end: one component, whatever its length."""
    end_a, end_b = np.append(np.arange(2, 200_000, 2), 200_001), np.append(np.arange(1, 200_000, 2), 200_001)
    last_a, last_b = alignment.terminals(end_a, end_b)
    assert set(last_a.tolist()) == set(last_b.tolist()) == {len(end_b) - 1}


def test_pairs_are_bounded_by_the_vocabularies(spark, both):
    """Tokens that end together are suffixes of each other, so pairs have a bound that doesn't grow with the corpus."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs = [r.pair for r in alignment.pair_counts(alignment.groups(docs)).collect()]
    vocabulary = lambda v, i: v.bytes[v.start[i] : v.start[i] + v.size[i]].tobytes()
    for p in pairs:
        a, b = vocabulary(both.bytes_a, p >> 32), vocabulary(both.bytes_b, p & 0xFFFFFFFF)
        assert a.endswith(b) or b.endswith(a)
    assert len(pairs) < both.bytes_a.size.sum() + both.bytes_b.size.sum() < 700_000
