import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lexloom.llm import token_arrow

from .test_mixing import brute as mixture
from .test_minhash import brute as groups
from .test_scans import brute_hits


def test_stages_one_after_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    schema, rows = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settled(stage(spark, docs, sf), name)
        assert docs.schema == schema
        rows[name] = {r["doc_id"]: r for r in docs.collect()}
    good = list(rows["quality"].values())
    assert 0.7 * spark.read.parquet(f"{sf}/documents.parquet").count() < len(good)
    assert sorted(rows["near_duplicates"]) == [i for i, _, _, kept in groups([(r["doc_id"], r["text"]) for r in good], 5, 80) if kept]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(rows["decontaminate"]) == sorted(x[0] for x in brute_hits([(i, r["text"]) for i, r in rows["near_duplicates"].items()], items) if not x[5])
    mixed = mixture([(i, r["text"], r["lang"], r["source"]) for i, r in rows["decontaminate"].items()])[2]
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(x[0] for x in mixed)
    model = Tokenizer.from_file(token_arrow.tokenizer_path())
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(final) == len(mixed)
    for r in final:
        ids = [*model.encode(rows["mix"][r["doc_id"]]["text"], add_special_tokens=False).ids, 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
