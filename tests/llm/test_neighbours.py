"""Posting lists of several vector sizes, large lists with inner centroids and lists that many queries read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateweave.llm import neighbours
from stateweave.llm.common import materialize


def recall(got, ids, v, sizes):
    out = {}
    for size in sorted(set(sizes)):
        some = np.array([k for k, z in enumerate(sizes) if z == size])
        u = np.array([v[k] / np.linalg.norm(v[k]) for k in some])
        share = []
        for k, i in enumerate(ids[some]):
            if i % 50:
                continue
            s = u @ u[k]
            s[k] = -9
            best = ids[some][np.lexsort((ids[some], -s))[:5]]
            mine = got[got.query_id == i].sort_values("rank")
            assert mine["rank"].tolist() == list(range(1, min(5, len(some) - 1) + 1))
            assert np.allclose(mine.score, [s[ids[some] == j][0] for j in mine.vec_id], atol=1e-12)
            share.append(len(set(best) & set(mine.vec_id)) / len(best))
        out[size] = np.mean(share) if share else 1.0
    return out


def clustered(seed, counts, around=60):
    """Vectors of several sizes, clustered; ids in mixed order."""
    rng = np.random.default_rng(seed)
    v, sizes = [], []
    for size, n in counts.items():
        centres = rng.normal(size=(max(1, n // around), size))
        v += list(centres[rng.integers(len(centres), size=n)] + 0.5 * rng.normal(size=(n, size)))
        sizes += [size] * n
    return rng.permutation(len(v)), v, sizes


def run(spark, ids, v):
    frame = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    return neighbours.search(frame.repartition(4)).toPandas()


def test_every_common_size_has_an_index(spark, monkeypatch):
    """Two large sizes and a rare one; neither large one is compared with all its vectors."""
    monkeypatch.setattr(neighbours, "RARE", 200)
    monkeypatch.setattr(neighbours, "LIST", 64)
    ids, v, sizes = clustered(1, {16: 3000, 24: 2500, 8: 60})
    assert all(r >= 0.9 for r in recall(run(spark, ids, v), ids, v, sizes).values())
    kept = spark.createDataFrame([(int(i), x.astype(float).tobytes()) for i, x in zip(ids, v, strict=True)], "vec_id long, v binary")
    index = neighbours._index(kept, 50_000)
    assert set(index) == {16 * 8, 24 * 8} and min(map(len, index.values())) > 20


@pytest.mark.parametrize("lists", [1, 8])
def test_large_lists_have_inner_centroids(spark, monkeypatch, lists):
    """Few outer lists, as beyond ``MAX_LISTS``: recall holds, and lists are short."""
    monkeypatch.setattr(neighbours, "MAX_LISTS", lists)
    monkeypatch.setattr(neighbours, "SPLIT", 128)
    monkeypatch.setattr(neighbours, "LIST", 64)
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    ids, v, sizes = clustered(2, {16: 4000})
    assert recall(run(spark, ids, v), ids, v, sizes)[16] >= 0.9
    kept = spark.createDataFrame([(int(i), x.astype(float).tobytes()) for i, x in zip(ids, v, strict=True)], "vec_id long, v binary")
    index = neighbours._index(kept, 50_000)
    posted = materialize(neighbours._flat(neighbours._posted(kept, index, neighbours.SPREAD, neighbours.COPIES), ["vec_id"]), "flat")
    large = posted.groupBy("size", "list").agg(F.count("*").alias("n"))
    dealt = neighbours._dealt(posted, ["vec_id"], neighbours._inner(posted, materialize(large, "large")), neighbours.SPREAD, neighbours.COPIES)
    longest = dealt.groupBy("size", "list", "sub").count().agg(F.max("count")).first()[0]
    assert len(index[128]) <= 2 * lists and longest < 1000
    assert dealt.select("vec_id").distinct().count() == 4000


def test_lists_that_many_queries_read(spark, monkeypatch):
    """All queries lie near one list; its blocks and theirs meet in several tasks."""
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "RARE", 50)
    monkeypatch.setattr(neighbours, "LIST", 40)
    rng = np.random.default_rng(5)
    v = list(np.ones(12) + 0.05 * rng.normal(size=(300, 12))) + list(rng.normal(size=(600, 12)))
    ids = np.concatenate([50 * np.arange(300), 50 * np.arange(600) + 1])
    assert recall(run(spark, ids, v), ids, v, [12] * 900)[12] >= 0.9
