"""Blocks of rows: cut by bytes, written to files and read back by number."""

import pyarrow as pa
from plumbline.llm import common
from pyspark.sql import functions as F


def test_block_files(spark):
    texts = [None, "", "é" * 40, "x" * 1000, "ab", None, "c" * 99, "d"] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    make = lambda number, rows: (pa.table({"ids": [rows.column("id").to_pylist()], "chars": [sum(len(t or "") for t in rows.column("text").to_pylist())]}), rows.num_rows)
    files = common.BlockFiles(docs, 120, "text", make)
    told = {r["block"]: r["size"] for r in files.told.collect()}
    read = files.reader()
    rows = {b: {k: v[0].as_py() for k, v in read(b).items()} for b in told}
    assert sorted(i for r in rows.values() for i in r["ids"]) == list(range(len(texts))) and files.size == len(texts) and files.n == len(told) > 10
    assert all(len(r["ids"]) == told[b] for b, r in rows.items())
    assert all(sum(len((texts[i] or "").encode()) for i in r["ids"]) <= 120 or sum(bool(texts[i]) for i in r["ids"]) == 1 for r in rows.values())
    assert files.numbers().rdd.getNumPartitions() == -(-files.n // 2)
    none = common.BlockFiles(docs.filter("id < 0"), 120, "text", make)
    assert (none.n, none.size, none.numbers().count()) == (0, 0, 0)
    same = common.blocks(docs, 120, "text", lambda n, t: pa.table({"n": pa.array([n], pa.int64()), "k": pa.array([t.num_rows], pa.int64())}), "n long, k long")
    assert same.agg(F.sum("k"), F.countDistinct("n")).first()[0] == len(texts)


def test_clear(spark, tmp_path):
    made = common.stored(spark.range(3))
    folder = made.inputFiles()[0].rsplit("/", 1)[0]
    common.clear(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
