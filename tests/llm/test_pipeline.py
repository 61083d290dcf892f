"""The pipeline, stage by stage, on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from conftest import TESTDATA


def test_stages(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "near_duplicates", "decontamination", "mixing", "sharding",
    ]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").collect()]
    rows = corpus_pipeline.run(spark, TESTDATA).collect()
    taken = {r["doc_id"] for r in rows}
    assert taken and set(docs.columns) < set(rows[0].asDict())
    assert all(r["text"] == texts[r["doc_id"]] for r in rows)
    # One of each set of copies, and no whole benchmark item.
    assert len({texts[i] for i in taken}) == len(taken)
    assert not any(" ".join(x.split()) in " ".join(texts[i].split()) for i in taken for x in items)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
