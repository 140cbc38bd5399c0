"""Components when every id, hub and component is hot and nothing may be broadcast."""

import numpy as np
import pytest

from stateweave.llm import common, components


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hot", [False, True])
def test_like_union_find(spark, monkeypatch, hot):
    rng = np.random.default_rng(1)
    hub = [(5, int(x)) for x in rng.integers(100, 400, 150)]
    chain = [(k, k + 1) for k in range(1000, 1040)]
    links = hub + chain + [tuple(map(int, x)) for x in rng.integers(2000, 2200, (60, 2))]
    later = [(5, 1020), (399, 2000), (7, 8)]
    if hot:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(common.spread_join, "__defaults__", (2,))
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    first = components.extended(None, frame(links))
    assert {r.id: r.component for r in first.collect()} == {k: v for k, v in brute([x for x in links if x[0] != x[1]]).items()}
    both = components.extended(first, frame(later))
    assert {r.id: r.component for r in both.collect()} == brute([x for x in links + later if x[0] != x[1]])
