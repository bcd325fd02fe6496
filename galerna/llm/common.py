"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: White space that separates words: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once, unless they find it themselves by PYTHONPATH."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.master.startswith("local") and str(root) in known or getattr(context, "_galerna_sent", False):
        return
    archive = Path(tempfile.mkdtemp()) / "galerna.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in (root / "galerna").rglob("*.py"):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(archive))  # Spark copies it to every executor
    context._galerna_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def whole_text(column: Column) -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(column.cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where that is unset, on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[0-9*]+(,[0-9]+)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return path.rstrip("/")


#: Folders that ``materialize`` has written in the scratch contexts that are open, innermost last.
_open: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and the work is not repeated."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/galerna/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a frame that ``materialize`` returned and that nothing needs any more."""
    def plain(path: str) -> str:
        return re.sub("^file:/*", "/", path)

    own = plain(f"{shared_dir(df.sparkSession)}/galerna/")
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if plain(path).startswith(own):  # never a table that another has written
            _delete(df.sparkSession, path)


def scratch(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written; all tables that were materialized on the way are dropped, whoever wrote them."""
    _open.append([])
    try:
        made = make()
        path = f"{shared_dir(spark)}/galerna/{name}-{uuid.uuid4().hex}"
        made.write.option("compression", "zstd").parquet(path)
    finally:
        for done in _open.pop():
            _delete(spark, done)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(made.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str, salts: int = 64) -> DataFrame:
    """Inner join of ``left`` with ``right`` (one row for each key) where a key may hold very many rows of ``left``.

    Rows of a key are dealt to ``salts`` parts by the hash of column ``by``; each part that has rows gets the key's
    row of ``right``, so that a hot key is spread over many tasks and ``right`` grows by the parts there are only.
    """
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    known = dealt.select(on, "__salt").distinct().join(right, on)
    return dealt.join(known, [on, "__salt"]).drop("__salt")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, equals ``remainder`` (null id: the text is empty)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def map_rows(df: DataFrame, schema: T.StructType, make, piece: int = 512) -> DataFrame:
    """Arrow batches through ``make``: it gets a list for each column and returns (or yields) tuples of ``schema``.

    Values go as Python objects, so that nulls do not turn long ids into floating point; pieces are small because
    texts may be long.
    """
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, piece):
                rows = list(make(*(c.to_pylist() for c in batch.slice(at, piece).columns)))
                columns = list(zip(*rows)) if rows else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
