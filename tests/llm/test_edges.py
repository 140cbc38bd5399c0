"""Nulls, empty and long texts, repeats, empty tables and clashing columns, for every operator."""

import pytest

import corpus_pipeline
from stateweave.llm import byte_bpe, language_id, near_dedup, neighbours, packing, quality_rules, secret_scan, substring_dedup, token_counts, toxicity

LONG = " ".join(f"w{k % 997}x{k % 13}" for k in range(30000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", None, 4), (4, "same text here", "en", "a", 14), (4, "same text here", "en", "a", 14),
    (5, "same text here", "de", "b", 14), (None, "no id at all", "fr", "a", 12), (6, LONG, "en", "a", len(LONG)), (7, LONG + " tail", "en", "b", len(LONG) + 5),
    (8, "a" * 50000, None, "c", 50000), (9, "é ² 中文 😀 \x1c\x85  İstanbul", "fr", "c", 20), (10, "1 2 3 . !", "es", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    extra = {c: F.lit(1) for c in ("id", "n", "set", "key", "rank", "part", "cuts", "leaf", "removed_lines", "found", "kept", "path")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1").repartition(2)


PER_ROW = [byte_bpe.digest, secret_scan.digest, quality_rules.digest, near_dedup.group, language_id.identify]


@pytest.mark.parametrize("operator", PER_ROW, ids=lambda f: f.__module__.rsplit(".", 1)[-1])
def test_a_row_for_every_row(docs, none, operator):
    assert operator(docs).count() == len(ROWS)
    assert operator(none).count() == 0


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.assess(docs, labels).count() == len(ROWS)
    assert toxicity.assess(docs, labels.where("false")).where("score is null").count() == 0
    assert toxicity.assess(none, labels).count() == 0


def test_others(docs, none):
    assert token_counts.histogram(docs).agg({"docs": "sum"}).first()[0] == len(ROWS)
    assert token_counts.histogram(none).count() == 0
    got = {r.doc_id for r in substring_dedup.repeats(docs).collect()}
    assert got == {7} and substring_dedup.repeats(none).count() == 0
    assert packing.pack(none).count() == 0


def test_near_duplicates(docs):
    got = {r.doc_id: r for r in near_dedup.group(docs).collect()}
    assert got[5].component_id == 4 and not got[5].kept and got[7].component_id == 6
    assert got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0 and got[3].kept
    assert got[None].component_id is None and got[None].kept


def test_stages_keep_columns(docs, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, none):
            out = stage(None, table, "")
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            out.count()
    assert near_dedup.apply(docs).where("doc_id = 4").count() == 1


def test_vectors(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 1.0]), (8, [1.0]), (1, [2.0, 0.0]), (None, [1.0, 1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.search(t).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    sizes = t.union(spark.createDataFrame([(100, [3.0]), (150, [1.0, 1.0, 1.0])], t.schema)).withColumns({"h1": F.lit(1), "list": F.lit(2), "v": F.lit(3)})
    assert [(r.query_id, r.vec_id, r.score) for r in neighbours.search(sizes).where("query_id >= 100").collect()] == [(100, 8, 1.0)]
    assert got[0][3] == 1.0 and neighbours.search(t.where("false")).count() == 0
