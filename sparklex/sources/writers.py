"""Writers. Directories of part files for tables; single files only where a format asks for them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.operators.package import package_rows
from sparklex.sources.files import one_file, write_text


def write_jsonl(df: DataFrame, path: str, files: int | None = None) -> None:
    """Lines of JSON, null fields included."""
    (df if files is None else df.coalesce(files)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_task(df: DataFrame, task: str, path: str, order: str) -> None:
    """The task's file: fields and rows in their order. A task file is one small file by its format."""
    rows = df.orderBy(order) if order in df.columns else df
    one_file(package_rows(rows, task).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json, path)


def write_pool(pool: DataFrame, folder: str) -> None:
    """The pool by direction as Parquet, its canonical form."""
    pool.write.mode("overwrite").partitionBy("direction").parquet(folder)


def write_pool_text(pool: DataFrame, direction: str, stem: str) -> None:
    """A direction's pool as two line-aligned files in the order of row_idx; line ends inside texts become blanks."""
    rows = pool.where(F.col("direction") == direction).orderBy("row_idx").coalesce(1)
    for side in ("src", "tgt"):
        one_file(rows.select(F.regexp_replace(side, "[\\r\\n]+", " ")).write.mode("overwrite").text, f"{stem}.{side}")


def write_bundle(rows: DataFrame, folder: str, by: list[str]) -> None:
    """Rows in folders by the columns (task and language, or composition and split)."""
    rows.write.mode("overwrite").partitionBy(*by).option("ignoreNullFields", False).json(folder)


def write_meta(meta: DataFrame, path: str, **more) -> None:
    """A one-row table of counts as a JSON file, with further values by name."""
    write_text(path, json.dumps(meta.first().asDict(recursive=True) | more, ensure_ascii=False, indent=2))


def read_deletion_index(spark: SparkSession, path: str) -> DataFrame:
    """The index that write_deletion_index wrote; an error at once if it isn't there or lacks its columns."""
    index = spark.read.parquet(path)
    if not {"variant"} < set(index.columns):
        raise ValueError(f"{path}: no deletion index")
    return index


def write_deletion_index(index: DataFrame, path: str) -> None:
    """The index for edit distances, sorted so that a lookup reads few row groups."""
    index.repartitionByRange("variant").sortWithinPartitions("variant").write.mode("overwrite").parquet(path)
