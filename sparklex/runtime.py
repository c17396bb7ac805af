"""Session helpers shared by all operators: table access, lineage cuts, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Copies of one key from which it counts as hot. Hot keys number at most rows / HOT_ROWS, which bounds what is broadcast.
HOT_ROWS = 20_000
#: Hot keys that may be broadcast at most (24 bytes each); beyond it the shuffle join takes all keys.
HOT_KEYS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`, columns pruned and filters pushed by the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, its lineage cut; a lost executor loses nothing of it.

    The folder is the session's spark.checkpoint.dir. Only a local session without that setting gets a folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not (sc.master.startswith("local[") or sc.master == "local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sparklex-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """A folder for what a query writes and reads back: beside the checkpoints, which all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        checkpointed(spark.range(0))
    return f"{sc.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def fingerprint(*cols) -> list:
    """Two 64-bit hashes of the columns under different seeds: a 128-bit key named k1, k2."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("sparklex"), *cols).alias("k2")]


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join of rows with groups, which holds one row for each key and the number of its rows in the column `size`.

    Keys with `hot` rows or more are few by construction (at most rows / hot): they are broadcast, so their rows never
    meet in one task. All other keys join by a shuffle in which no key has more than `hot` rows. If there are more hot
    keys than HOT_KEYS, the shuffle join (with AQE's skew splitting) takes all of them.
    """
    heavy = groups.where(F.col(size) >= hot)
    if heavy.limit(HOT_KEYS + 1).count() in (0, HOT_KEYS + 1):
        return rows.join(groups, keys)
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(groups.where(F.col(size) < hot), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(light)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of df and never more than twice as many, chosen by a hash of the key, alike in every run.

    The share is worked out from a count, which the file footers answer for a plain table, so no sort is needed and what
    reaches the driver doesn't grow with the data.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(total)) < rows).limit(2 * rows)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with its rows numbered from 0 in the order of its partitions and of the rows in them.

    The rows are written down first, so that both passes see the same order. What reaches the driver is one row for each
    partition; no task sees more than its own rows.
    """
    rows = checkpointed(df.select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"), *df.columns))
    parts = sorted((r["_p"], r["n"], r["first"]) for r in rows.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("first")).collect())
    shift, done = [], 0
    for part, n, first in parts:
        shift += [F.lit(part), F.lit(done - first)]
        done += n
    if not shift:
        return rows.select(F.lit(0).cast("long").alias(name), *df.columns)
    return rows.select((F.col("_i") + F.try_element_at(F.create_map(*shift), F.col("_p"))).cast("long").alias(name), *df.columns)


def ordered_rank(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with each row's place from 0 in the order of the key: ranges of the key are sorted apart and then numbered."""
    return numbered(df.repartitionByRange(key).sortWithinPartitions(key), name)


def ranked_within(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """df with each row's place from 0 in the order of its group's rows; a null is a group of its own.

    Ranges of group and order are sorted apart, so a group may hold most of the rows: it lies in many ranges, whose counts
    (a row for each range and group) shift the places in them.
    """
    cut = df.repartitionByRange(*by, order).sortWithinPartitions(*by, order)
    rows = checkpointed(cut.select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i"), *df.columns))
    parts = rows.groupBy("_p", *by).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_s"))
    same = rows["_p"] == shift["_q"]
    for i, c in enumerate(by):
        same = same & rows[c].eqNullSafe(shift[f"_by{i}"])
    return rows.join(shift, same).select(*df.columns, (F.col("_i") + F.col("_s")).cast("long").alias(name))
