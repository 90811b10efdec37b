"""The pipeline on small rows: each stage's columns, and what the chain keeps."""

import corpus_pipeline as P

from tests.llm import brute


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(brute.documents(), "doc_id long, text string, lang string, source string, n_chars long")
    long = next(r for r in brute.documents() if r[1] and len(r[1].split()) > 80)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(long[1].split()[20:45]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in P.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), docs.schema)
        assert now.columns == docs.columns, name
    kept = {r["doc_id"] for r in now.collect()}
    # the row without a doc_id comes first in line_dedup, keeps its text, and is no copy any more
    assert 3 < len(kept) < docs.count() and None in kept and 0 not in kept
    out = P.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == kept and out.filter("not round_trip").count() == 0
