"""Near duplicates, repeated passages, neighbours and the pipeline against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from stateweave.llm import common, near_dedup, neighbours, substring_dedup
from stateweave.llm.common import table
from stateweave.llm.components import components

SF = "/root/testdata/sf0.001"


def classes_by_hand(texts):
    """Components of 100 * intersection >= 85 * union over all pairs that share a shingle."""
    sets, holders, root = {}, defaultdict(list), {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        root[i] = i
        for s in sets[i]:
            holders[s].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in {(a, b) for group in holders.values() for a in group for b in group if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


@pytest.fixture(scope="module")
def edited(spark):
    """Families of copies with 0 to 3 changed words in 120, and loners."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    texts = []
    for size in (1, 1, 2, 3, 30):
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(120)] = word()
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()


@pytest.mark.parametrize(("leaf", "depth"), [(4096, 5), (3, 2), (3, 0)])
def test_components_as_all_pairs_give(edited, monkeypatch, leaf, depth):
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    monkeypatch.setattr(near_dedup, "DEPTH", depth)
    want, sizes = classes_by_hand({r.doc_id: r.text for r in edited.collect()})
    got = near_dedup.group(edited).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes


def test_given_documents(spark):
    docs = table(spark, SF, "documents")
    want, _ = classes_by_hand({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in near_dedup.group(docs).collect()} == want


def test_long_chains_are_one_component(spark):
    ids = list(range(40))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (100, 101)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {**dict.fromkeys(range(40), 0), 100: 100, 101: 100}


def test_windows_are_those_of_every_subsequence():
    """Each run of SPAN tokens or more lies in exactly one window with its minimum."""
    seq = np.random.default_rng(3).integers(0, 2**63, 140, np.uint64)
    seq[90:95] = seq[10:15]
    with np.errstate(over="ignore"):
        windows = substring_dedup.compact_windows(seq)
        for k in range(substring_dedup.HASHES):
            at, first, last = (x[windows[0] == k] for x in windows[2:])
            values = substring_dedup.mix(seq ^ substring_dedup._SALT[k]) >> np.uint64(32)
            for i in range(len(seq)):
                for j in range(i + substring_dedup.SPAN - 1, len(seq)):
                    c = i + int(values[i : j + 1].argmin())
                    assert [(int(a), bool(f <= i and j <= e)) for a, f, e in zip(at, first, last, strict=True) if a == c] == [(c, True)]


def test_planted_passages(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    words = lambda n: [word() for _ in range(n)]
    exact, near, short = words(60), words(100), words(20)
    changed = list(near)
    changed[50] = "edited"
    docs = [words(80) + exact + words(50), words(10) + [w.upper() for w in exact] + words(70), words(40) + near, changed + words(90), words(60) + short + words(60), words(70) + short, exact]
    table_ = spark.createDataFrame([(k, " ".join(w), "en", "s", 1) for k, w in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars int")
    got = {(x.doc_id, x.first_doc_id): x for x in substring_dedup.repeats(table_).collect()}
    assert set(got) == {(1, 0), (3, 2), (6, 0)}
    assert (got[1, 0].start_word, got[1, 0].end_word) == (10, 70) and got[3, 2].n_words == 100
    left = {x.doc_id: x for x in substring_dedup.apply(table_).collect()}
    assert set(left) == {0, 1, 2, 3, 4, 5} and left[1].text.split() == docs[1][:10] + docs[1][70:] and left[1].n_chars == len(left[1].text)


def test_recall_of_neighbours(spark):
    embeddings = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = embeddings.collect()
    ids = np.array([x.vec_id for x in rows])
    v = np.array([x.embedding for x in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = neighbours.search(embeddings).toPandas()
    share = []
    for q in ids[ids % 50 == 0]:
        s = v @ v[ids == q][0]
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(mine.score, [s[ids == i][0] for i in mine.vec_id], atol=1e-12)
        share.append(len(set(best) & set(mine.vec_id)) / 5)
    assert np.mean(share) >= 0.9


def test_graph_search_over_lists():
    """The index itself, with many lists: recall of the posting lists over clustered vectors."""
    r = np.random.default_rng(0)
    x = neighbours.unit(np.repeat(r.normal(size=(200, 32)), 20, 0) + 0.4 * r.normal(size=(4000, 32))).astype(np.float32)
    index = neighbours.centroids(x, 100)
    graph = neighbours.Graph(index)
    near, far = graph.search(x[:300], 4)
    exact = np.argsort(-(x[:300] @ index.T), 1)[:, :4]
    assert (near[:, 0] == exact[:, 0]).mean() > 0.95 and (np.diff(far, axis=1) >= -1e-6).all()


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "secret_scan", "packing"]
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    ids = {r.doc_id for r in docs.collect()}
    assert 0 < rows.doc_id.nunique() < len(ids) and set(rows.doc_id) <= ids


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    """Nulls, empty and very long texts, all kinds of white space, words over several blocks, slices of an array."""
    r = random.Random(5)
    words = ["a", "b", "ab", "ba", "\u00e9", "\u00c9", "\U0001f600", "x" * 300, "\u00a0", "\u2003", "\x1f", "\x85"]
    spaces = [" ", "\t", "\n\r", " \x0b\x0c ", "  "]
    texts = [None, "", " ", "A", "B a", *("".join(r.choice(words) + r.choice(spaces) for _ in range(r.randint(0, 40))) for _ in range(60)), "q" * 1000 + " a", "ab", ""]
    expected = [t.encode().lower().split() if t else [] for t in texts]
    seen = {}
    for block in (32_768, 64):
        monkeypatch.setattr(common, "_BLOCK", block)
        for a, b in ((0, len(texts)), (3, 50), (40, len(texts)), (0, 3)):
            hashes, counts = common.word_hashes(pa.array(texts)[a:b])
            assert counts.tolist() == [len(w) for w in expected[a:b]]
            for word, h in zip((w for ws in expected[a:b] for w in ws), hashes.tolist(), strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen) > 12
    many = common.word_hashes(pa.array([" ".join(map(str, range(300_000)))]))[0]
    assert len(np.unique(many)) == 300_000


def test_windows_of_texts_in_a_row_are_those_of_each():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 40 if k % 2 else 2**63, n, np.uint64) for k, n in enumerate((46, 47, 300, 46, 90, 1000, 46))]
    ends = np.cumsum([len(p) for p in parts])
    with np.errstate(over="ignore"):
        f, key, at, first, last = substring_dedup.compact_windows(np.concatenate(parts), ends)
        got = sorted(zip(f, at, first, last, strict=True))
        assert got == sorted((k, *(np.array(x) + end - len(p))) for p, end in zip(parts, ends, strict=True) for k, *x in zip(*(lambda k, _, *rest: (k, *rest))(*substring_dedup.compact_windows(p)), strict=True))


def test_passages_go_on_to_the_next_holder(spark):
    """Document 1 holds only the first 45 words of a passage that documents 2 and 3 hold whole."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    words = lambda n: [word() for _ in range(n)]
    docs = []
    for k in range(0, 60, 3):
        whole = words(55)
        docs += [(k, words(30) + whole[:45] + words(30)), (k + 1, words(20) + whole + words(40)), (k + 2, words(40) + whole + words(20))]
    table_ = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    got = sorted((x.doc_id, x.first_doc_id, x.start_word, x.end_word) for x in substring_dedup.repeats(table_).collect())
    assert got == [(k + 2, k + 1, 40, 95) for k in range(0, 60, 3)]


def planted(edits, n, r):
    """Token sequences of two documents that share a passage of ``n`` words, one copy with changed words."""
    word = lambda: "%x" % r.getrandbits(40)
    whole = [word() for _ in range(n)]
    copy = list(whole)
    for k in r.sample(range(n), edits):
        copy[k] = word()
    texts = [" ".join([word() for _ in range(r.randint(0, 90))] + w + [word() for _ in range(r.randint(0, 90))]) for w in (whole, copy)]
    return [next(substring_dedup.token_runs(pa.array([t])))[1] for t in texts]


def common_keys(a, b):
    """For each hash function, whether the two sequences share a key."""
    def keys(s):
        out = [set() for _ in range(substring_dedup.HASHES)]
        for f, left, right, at, first, last in zip(*(lambda k, key, *rest: (k, *key, *rest))(*substring_dedup.compact_windows(s)), strict=True):
            out[f] |= {int(key) for key, aside in ((left, at - substring_dedup.ASIDE), (right, at + substring_dedup.ASIDE)) if first <= aside <= last}
        return out

    with np.errstate(over="ignore"):
        return [bool(x & y) for x, y in zip(keys(a), keys(b), strict=True)]


def test_keys_of_planted_passages():
    r = random.Random(6)
    assert all(all(common_keys(*planted(0, 50, r))) for _ in range(200))
    for edits, n in ((1, 100), (2, 150)):
        assert np.mean([any(common_keys(*planted(edits, n, r))) for _ in range(200)]) > 0.97


def test_copies_of_80_percent_go(spark):
    """One word changed in 55: 46 of 56 shingles are common (0.82)."""
    words = [f"w{k}" for k in range(55)]
    table_ = spark.createDataFrame([(0, " ".join(words)), (1, " ".join([*words[:25], "edited", *words[26:]])), (2, " ".join(words[::-1]))], "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.apply(table_).collect()} == {0, 2}
    assert {r.component_id for r in near_dedup.group(table_, 85).collect()} == {0, 1, 2}


def test_lone_vectors_get_neighbours(spark):
    """Clustered vectors with outliers: every query gets 5 rows, and recall against brute force is high."""
    r = np.random.default_rng(7)
    v = np.concatenate([np.repeat(r.normal(size=(20, 24)), 100, 0) + 0.1 * r.normal(size=(2000, 24)), 9 * r.normal(size=(60, 24))])
    ids = np.arange(len(v))
    ids[-60:] = 50 * np.arange(100, 160)
    got = neighbours.search(spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")).toPandas()
    u, share = v / np.linalg.norm(v, axis=1, keepdims=True), []
    for q in ids[ids % 50 == 0]:
        s = u @ u[ids == q][0]
        s[ids == q] = -9
        mine = got[got.query_id == q]
        assert len(mine) == 5
        share.append(len(set(ids[np.lexsort((ids, -s))[:5]]) & set(mine.vec_id)) / 5)
    print("recall", np.mean(share), np.mean(share[-60:]))
    assert np.mean(share) >= 0.9


def test_lists_of_one_vector(spark, monkeypatch):
    """Far vectors that are lists of their own get 5 rows too."""
    monkeypatch.setattr(neighbours, "LIST", 1)
    monkeypatch.setattr(neighbours, "RARE", 0)
    v = np.random.default_rng(9).normal(size=(40, 24))
    got = neighbours.search(spark.createDataFrame([(50 * k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")).toPandas()
    assert got.groupby("query_id").size().tolist() == [5] * 40


def test_hot_keys_are_dealt_out(edited, monkeypatch):
    """The same components and passages when every key counts as hot."""
    from stateweave.llm import common

    want = {r.doc_id: r.component_id for r in near_dedup.group(edited).collect()}
    passages = sorted(map(tuple, substring_dedup.repeats(edited).collect()))
    monkeypatch.setattr(common.spread_join, "__defaults__", (1,))
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    assert sorted(map(tuple, substring_dedup.repeats(edited).collect())) == passages
    monkeypatch.setattr(near_dedup, "LEAF", 3)
    monkeypatch.setattr(near_dedup, "DEPTH", 0)
    assert {r.doc_id: r.component_id for r in near_dedup.group(edited).collect()} == want


def test_edited_passages_are_found(spark):
    """Passages of 60 to 200 words with spread edits, 0.8 or more alike, behind a line that every document shares."""
    r = random.Random(12)
    word = lambda: "%x" % r.getrandbits(40)
    words = lambda n: [word() for _ in range(n)]
    line, docs, want = words(30), [], set()
    for k in range(60):
        whole = words(20) + line + words(r.randint(20, 150))
        copy = list(whole)
        edits = 1 if len(whole) < 110 else 2
        for j in range(edits):
            at = (j + 1) * len(whole) // (edits + 1)
            copy[at if not 20 <= at < 50 else 51] = word()
        docs += [(2 * k, " ".join(words(30) + whole + words(20))), (2 * k + 1, " ".join(words(10) + copy + words(40)))]
        want.add((2 * k + 1, 2 * k, 10, 10 + len(whole)))
    got = {(x.doc_id, x.first_doc_id, x.start_word, x.end_word) for x in substring_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(want & got) >= 0.95 * len(want) and {g[:2] for g in got} <= {w[:2] for w in want}


def test_ties_go_to_smaller_ids(spark):
    """40 power-of-two multiples of one vector, all of cosine 1, among 200 others."""
    r = np.random.default_rng(3)
    base = r.normal(size=16)
    rows = [(k, (base * 2.0 ** (k % 9 - 4)).tolist()) for k in range(40)] + [(100 + 7 * k, x.tolist()) for k, x in enumerate(r.normal(size=(200, 16)))]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in got] == [(k, 1.0) for k in range(1, 6)]
