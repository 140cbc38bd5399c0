"""Frequent lines when they are too many for a broadcast and every one of them is hot."""

from stateweave.llm import common, quality_rules


def test_hot_lines_without_a_broadcast(spark, monkeypatch):
    body = lambda i: " ".join(f"w{(i * 37 + k * 11) % 1999}" for k in range(60))
    rows = [(i, "host" if i % 4 else None, f"shared header line\n{body(i)}\nshared footer line" if i % 2 else body(i)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    want = sorted(map(tuple, quality_rules.digest(docs).collect()))
    texts = {r.doc_id: r.text for r in quality_rules.apply(docs).collect()}
    assert sum(r[6] > 0 for r in want) == 300 and all("shared" not in t for t in texts.values())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common.spread_join, "__defaults__", (16,))
    assert sorted(map(tuple, quality_rules.digest(docs).collect())) == want
    assert {r.doc_id: r.text for r in quality_rules.apply(docs).collect()} == texts
