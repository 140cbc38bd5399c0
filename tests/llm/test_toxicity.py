"""What toxicity learns: every labelled row, whatever the texts share; held-out accuracy and area under the curve."""

import zlib

import numpy as np
import pytest

from stateweave.llm import toxicity
from stateweave.llm.common import table

SLURS = ("zorbat", "klimmek", "dwarzlo")
WORDS = [a + b for a in ("lo", "mi", "ra", "te", "su", "vo", "ne", "ka") for b in ("rin", "dal", "mos", "vek", "tun", "par", "sil")]


def invented(n, tail="", copies=1, seed=0):
    """(documents, labels): every tenth document holds an abusive word; ``tail`` ends all."""
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(WORDS, int(rng.integers(30, 60))))
        toxic = int(i % 10 == 0)
        if toxic:
            words.insert(int(rng.integers(len(words))), SLURS[i // 10 % 3])
        text = " ".join(words) + tail
        for c in range(copies if toxic and i < 30 else 1):
            docs.append((i + c * 100_000, text + (" cellar" * 3 if copies > 1 and i < 30 and toxic else "")))
            labels.append((i + c * 100_000, 1, toxic))
    return docs, labels


def held_out(rows):
    return [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]


def scores(spark, docs, labels):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: r for r in toxicity.assess(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}


@pytest.mark.parametrize("tail", ["", "\nread more at https://example.org/archive/2024/terms-and-conditions-of-use-and-privacy-notice/index.html?session=" + "x" * 60, " one two three four five six" * 12])
def test_texts_that_share_a_footer(spark, tail):
    docs, labels = invented(800, tail)
    got, toxic = scores(spark, docs, labels), {i for i, _, t in labels if t}
    out = held_out(labels)
    assert all(got[i].held_out for i in out)
    assert [got[i].predicted for i in out] == [int(i in toxic) for i in out]


def test_copies_share_one_vote(spark):
    """Three toxic texts with 200 copies each, that all hold one harmless word: it stays harmless."""
    docs, labels = invented(800, copies=200)
    docs += [(50_000_000 + k, "the cellar " + " ".join(np.random.default_rng(k).choice(WORDS, 40))) for k in range(50)]
    got = scores(spark, docs, labels)
    assert sum(got[50_000_000 + k].predicted for k in range(50)) == 0
    toxic = {i for i, _, t in labels if t and i < 100_000}
    assert all(got[i].predicted for i in held_out(labels) if i in toxic)


def test_one_class_only(spark):
    """Without one of the classes the seed terms decide."""
    docs, labels = invented(60)
    docs += [(5000, "you stupid idiot, you worthless moron"), (5001, "a fine day")]
    for keep in (0, 1):
        got = scores(spark, docs, [x for x in labels if x[2] == keep])
        assert got[5000].predicted == 1 and got[5001].predicted == 0


def area(score, toxic):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        ranks[score == v] = ranks[score == v].mean()
    bad = toxic == 1
    return (ranks[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())


def test_held_out_area_under_the_curve(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.assess(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").toPandas()
    held = got[got.held_out & got.toxic.notna()]
    assert area(held.score.to_numpy(), held.toxic.to_numpy()) > 0.8
    assert (held.predicted == held.toxic).mean() > 0.95
