import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline as P  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_ids"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now < ids, name
        ids = now


def test_run_repeats_itself(spark):
    one, two = (sorted(map(tuple, P.run(spark, FOLDER).collect())) for _ in range(2))
    assert one == two and len(one) > 50
    start = 0
    for r in sorted(one, key=lambda r: r[1]):
        assert r[1] == start
        start += r[2]
