"""The stages on awkward rows: nulls, empty texts, repeated ids, ties, an empty table and columns with clashing names."""

import corpus_pipeline

from .fixtures import SCHEMA, awkward, prose


def with_labels(spark, tmp_path, rows):
    ids = [r[0] for r in rows if r[0] is not None]
    spark.createDataFrame([(i, 1, 0) for i in ids] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(__import__("random").Random(77), 12, 999999)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_keep_schema_and_lose_no_text(spark, tmp_path):
    import random

    rng = random.Random(2)
    a, b = (prose(rng, 80, 99999) for _ in range(2))
    rows = awkward() + [(5000, a, *awkward()[0][2:]), (5000, b, *awkward()[0][2:]), (5001, b + " tail", *awkward()[0][2:]), (5002, None, *awkward()[0][2:])]
    sf = with_labels(spark, tmp_path, rows)
    docs = spark.createDataFrame([(*r, True, 3) for r in rows], f"{SCHEMA}, gone boolean, first int")
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settled(stage(spark, docs, sf), name)
        assert docs.schema == schema
        if name == "near_duplicates":
            left = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert (5000, a) in left and (5000, b) in left and (5001, b + " tail") not in left and len(left) == len(set(left))
    assert docs.count() > 0
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert final.count() == docs.count()


def test_stages_on_an_empty_table(spark, tmp_path):
    sf = with_labels(spark, tmp_path, [(1, "x")])
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settled(stage(spark, docs, sf), name)
    assert docs.count() == 0 and corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0
