"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The word separators of most operators: ASCII space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: list[str] = []
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is
    unset a temporary folder of this process, which only a local master may use."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="plumbline-"))
    return f"file://{_own_dir[0]}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` once to the shared folder and reads it back, so a
    lost executor costs no recomputation of what came before. The shuffle files behind the
    table go once it is written."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
    _made.append(path)
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes a table of ``stored`` that no later result reads."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        drop_folder(spark, f)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of ``stored`` that this process made. Results that read them are gone
    then: write these first."""
    while _made:
        drop_folder(spark, _made.pop())


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def packed(docs: DataFrame, *used: str, **made: Column) -> DataFrame:
    """The columns ``used`` (those that are there) and ``made``; all others as one struct, so
    that no name among them can clash with an inner column. Without others there is none."""
    top = [c for c in used if c in docs.columns]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in top]
    held = [F.struct(*rest).alias("_rest")] if rest else []
    return docs.select(*top, *held, *[c.alias(n) for n, c in made.items()])


def unpacked(df: DataFrame, names: list[str], *made: Column | str) -> DataFrame:
    """``names`` out of a frame that came from ``packed``, then ``made``."""
    inner = set(df.schema["_rest"].dataType.names) if "_rest" in df.columns else set()
    return df.select(*[F.col("_rest")[c].alias(c) if c in inner else F.col(c) for c in names], *made)


def squeezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(data)


def unsqueezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def ascii_lower(c: Column) -> Column:
    """A-Z only; ``lower`` would also change other letters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(c: Column, m: int) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def _cut(batches: Iterator[pa.RecordBatch], size: int, text: str) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of blocks of about ``size`` bytes of ``text`` (a longer text is a block of its
    own). A block's number is its partition's and its place there."""
    from pyspark import TaskContext

    number, held, n = TaskContext.get().partitionId() << 32, [], 0
    for b in batches:
        column, first = b.column(b.schema.get_field_index(text)), 0
        for i, k in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
            if n and n + k > size:
                held.append(b.slice(first, i - first))
                yield number, pa.Table.from_batches(held)
                number, held, n, first = number + 1, [], 0, i
            n += k
        held.append(b.slice(first))
    if sum(h.num_rows for h in held):
        yield number, pa.Table.from_batches(held)


def blocks(docs: DataFrame, size: int, text: str, make: Callable[[int, pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """Cuts each partition's rows into blocks and gives what ``make`` returns for (number, rows).
    Store the result before using a number twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _cut(batches, size, text):
            yield from make(number, rows).to_batches()

    return docs.mapInArrow(run, schema)


class BlockFiles:
    """Blocks of rows in the shared folder, which Python tasks write and read themselves, so that
    their bytes never pass through Spark's rows and shuffles: an Arrow file a partition, a record
    batch a block. ``told`` is the small stored table of the blocks (block, size, where ``make``
    gives the size beside the block's one row).

    A task writes under a name of its own and moves the file to its partition's name when it is
    whole; another attempt at the task does the same again. The folder is opened by pyarrow, so its
    file system must be one that pyarrow knows."""

    def __init__(self, docs: DataFrame, size: int, text: str, make: Callable[[int, pa.Table], tuple[pa.Table, int]]):
        spark = docs.sparkSession
        self.uri = uri = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
        _made.append(uri)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            files, root = fs.FileSystem.from_uri(uri)
            numbers, sizes, writer, out, name = [], [], None, None, f"{root}/{uuid.uuid4().hex}.part"
            for number, rows in _cut(batches, size, text):
                made, n = make(number, rows)
                if writer is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(name)
                    writer = pa.ipc.new_file(out, made.schema)
                writer.write_batch(made.combine_chunks().to_batches()[0])
                numbers.append(number)
                sizes.append(n)
            if writer is not None:
                writer.close()
                out.close()
                files.move(name, f"{root}/{numbers[0] >> 32}.arrow")
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64())], names=["block", "size"])

        self.told = stored(docs.mapInArrow(run, "block long, size long").repartition(4))
        self.n, self.size = self.told.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()

    def numbers(self) -> DataFrame:
        """The blocks' numbers, dealt to tasks of a block or two."""
        return self.dealt(self.told.select("block"))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows by their block, a task for every block or two: what a task does follows the block's
        size, not that of these rows, by which Spark would join tasks."""
        return rows.repartition(max(1, -(-self.n // 2)), "block")

    def reader(self) -> Callable[[int], dict]:
        """What gives a block's row by its number; to be sent to tasks."""
        uri = self.uri

        def read(number: int) -> dict:
            from pyarrow import fs

            files, root = fs.FileSystem.from_uri(uri)
            with files.open_input_file(f"{root}/{number >> 32}.arrow") as f:
                row = pa.ipc.open_file(f).get_batch(number & 0xFFFFFFFF)
            return {n: row.column(n) for n in row.schema.names}

        return read
