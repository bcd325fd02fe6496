"""Folders of hourly rain files: an index of their times, and seasons that are redone only where their files have changed.

A file's name tells its time. Names are believed where each tells one and a sample of files holds just that time; otherwise every
file is opened for the times within. Of repeated times the first file counts. A ledger beside the sums keeps a fingerprint of the files
of each finished season, so that a second run reads no rain at all, and a file that is new, changed or gone redoes its season.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galerna.functions.time import micros, time_from_name
from galerna.sources import tables
from galerna.sources.staging import Staging

#: Files whose inner times are compared with their names.
VALIDATED = 30
LEDGER = "season int, fingerprint string, files long, written timestamp"

Reader = Callable[[SparkSession, list[str]], DataFrame]


def parquet_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, valid_time, ...) of rain files in long form."""
    rows = spark.read.parquet(*paths)
    return tables.rain(rows.withColumn("__path", F.col("_metadata.file_path")), synoptic_only=False, keep=("__path",)).withColumnRenamed("__path", "path")


def index(spark: SparkSession, folder: str, pattern: str = "*.parquet", read: Reader = parquet_files, validated: int = VALIDATED) -> tuple[DataFrame, bool]:
    """((time, path, modified, length) of a folder's files, whether their names were believed).

    One row for each time, its first file by path. ``read`` opens files and gives their rows with path and valid_time.
    """
    files = tables.rain_files(spark, folder, pattern).withColumn("named", time_from_name(F.element_at(F.split("path", "/"), -1)))
    total, nameless = files.agg(F.count("*"), F.count_if(F.col("named").isNull())).head()
    if not total:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    fast = not nameless
    if fast:
        sample = [r.path for r in files.orderBy(F.xxhash64("path"), "path").limit(validated).collect()]
        inner = read(spark, sample).select("path", F.col("valid_time").alias("time")).distinct()
        fast = inner.join(files.select("path", "named"), "path").filter(~F.col("time").eqNullSafe(F.col("named"))).isEmpty()
    if fast:
        times = files.select(F.col("named").alias("time"), "path", F.col("modificationTime").alias("modified"), "length")
    else:
        every = [r.path for r in files.select("path").collect()]  # names of files, of which a reader takes a list
        inner = read(spark, every).select("path", F.col("valid_time").alias("time")).distinct()
        times = inner.join(files.select("path", F.col("modificationTime").alias("modified"), "length"), "path")
    first = times.groupBy("time").agg(F.min_by(F.struct("path", "modified", "length"), "path").alias("f"))
    return first.select("time", "f.path", "f.modified", "f.length"), fast


def missing_hours(found: DataFrame) -> DataFrame:
    """(time): hours between the first and the last of an index that no file has."""
    span = found.agg(F.min("time").alias("a"), F.max("time").alias("b")).filter("a is not null")
    return span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("time")).join(found, "time", "left_anti")


def season_of(time: Column) -> Column:
    """The season whose sums an hour belongs to: May to November, the first and last window included; NULL outside."""
    start = lambda month: F.make_timestamp(F.year(time), F.lit(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.when((micros(time) >= micros(start(5))) & (micros(time) <= micros(start(12))), F.year(time))


def fingerprints(found: DataFrame) -> DataFrame:
    """(season, fingerprint, files): a digest of the names, sizes and dates of a season's files, in any order."""
    row = F.xxhash64("time", "path", "modified", "length")
    return found.withColumn("season", season_of(F.col("time"))).filter("season is not null").groupBy("season").agg(
        F.concat_ws("-", F.hex(F.bit_xor(row)), F.hex(F.sum(F.pmod(row, F.lit(1 << 40)))), F.count("*").cast("string")).alias("fingerprint"), F.count("*").alias("files")
    )


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """(season, fingerprint, files, written): the last entry of each finished season; none where nothing is written yet."""
    try:
        entries = spark.read.schema(LEDGER).parquet(f"{out.rstrip('/')}/ledger")
        entries.isEmpty()
    except AnalysisException:
        entries = spark.createDataFrame([], LEDGER)
    return entries.groupBy("season").agg(F.max_by(F.struct("fingerprint", "files", "written"), "written").alias("e")).select("season", "e.*")


def resume(
    spark: SparkSession, folder: str, out: str, compute: Callable[[DataFrame], DataFrame], first: int, last: int, pattern: str = "*.parquet",
    read: Reader = parquet_files, overwrite: bool = False,
) -> list[int]:
    """Write the sums of the seasons that are not finished, and enter them in the ledger; which these were.

    ``compute`` makes sums (season, cell or lat and lon, time, p6) of hourly rows. A season's sums are replaced as a whole, and
    its entry comes after them, so that a run that breaks off leaves the season to be done again.
    """
    with Staging(spark) as own:
        found = own("index", index(spark, folder, pattern, read)[0])
        now = own("fingerprints", fingerprints(found).filter(F.col("season").between(first, last)))
        done = now.join(ledger(spark, out).select("season", "fingerprint"), ["season", "fingerprint"], "left_semi")
        todo = now if overwrite else now.join(done.select("season"), "season", "left_anti")
        seasons = sorted(r.season for r in todo.select("season").collect())  # years
        for season in seasons:
            mine = found.filter(season_of(F.col("time")) == season)
            paths = sorted({r.path for r in mine.select("path").distinct().collect()})  # a season's files, as a reader takes them
            # a repeated time is read from its first file alone
            rows = read(spark, paths).join(mine.select("path", F.col("time").alias("valid_time")), ["path", "valid_time"], "left_semi")
            tables.write_seasons(compute(rows).filter(F.col("season") == season), f"{out.rstrip('/')}/series")
            entry = now.filter(F.col("season") == season).select("season", "fingerprint", "files", F.current_timestamp().alias("written"))
            entry.coalesce(1).write.mode("append").parquet(f"{out.rstrip('/')}/ledger")
    return seasons
