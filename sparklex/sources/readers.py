"""Readers. Each gives an ordinal where the order of lines has a meaning; white lines are left out."""

from __future__ import annotations

import io
import os
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.operators.lexicon import AffixRules, parse_affixes
from sparklex.operators.pool import ranked_union
from sparklex.runtime import numbered
from sparklex.sources import files, schemas


def read_jsonl(spark: SparkSession, path, schema: str) -> DataFrame:
    """Lines of JSON objects in an explicit schema; a broken line is a row of nulls, as the schema has no column for it."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_json_array(spark: SparkSession, path, schema: str) -> DataFrame:
    """Files that hold one JSON array over many lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_task(spark: SparkSession, path, task: str, dev: bool = False) -> DataFrame:
    return read_jsonl(spark, path, (schemas.DEV if dev else schemas.TASKS)[task])


def read_csv_text(spark: SparkSession, path, column: str | int = -1) -> DataFrame:
    """(text) of a CSV file with a header: the named column, or the one at the place (-1 the last, 0 the first). Packed
    files are unpacked; quoted line ends belong to the text; an empty value is the empty string."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    name = column if isinstance(column, str) and column in df.columns else df.columns[column if isinstance(column, int) else 0]
    return df.select(F.coalesce(F.col(f"`{name}`"), F.lit("")).alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): lines of one file, numbered from 0, also where the file is read in several parts."""
    return numbered(spark.read.text(path).select("value"), "line_no")


def read_parallel(spark: SparkSession, src_path: str, tgt_path: str, direction: str) -> DataFrame:
    """(direction, row_idx, src, tgt): two files line by line; lines that only one of them has are an error at the end."""
    src = numbered_lines(spark, src_path).select(F.col("line_no").alias("row_idx"), F.col("value").alias("src"))
    tgt = numbered_lines(spark, tgt_path).select(F.col("line_no").alias("row_idx"), F.col("value").alias("tgt"))
    both = src.join(tgt, "row_idx", "full")
    whole = F.when(F.col("src").isNull() | F.col("tgt").isNull(), F.raise_error(F.lit(f"{direction}: the files differ in length"))).otherwise(F.lit(direction))
    return both.select(whole.alias("direction"), "row_idx", "src", "tgt")


def read_mono(spark: SparkSession, paths: list[str], lang: str, low: int = 3, high: int = 40, cap: int | None = None) -> DataFrame:
    """(source_rank, ord, text): sources from the best to the worst, each text of fitting length once; missing files are
    skipped. CSV files give the column named by the language, else the first; all others are read line by line."""
    sources = []
    for path in paths:
        if not files.exists(path):
            continue
        if path.removesuffix(".gz").endswith(".csv"):
            df = read_csv_text(spark, path, lang).select(F.monotonically_increasing_id().alias("ord"), "text")
        else:
            df = numbered_lines(spark, path).select(F.col("line_no").alias("ord"), F.col("value").alias("text"))
        sources.append(df)
    if not sources:
        return spark.createDataFrame([], "source_rank int, ord long, text string")
    return ranked_union(sources, "text", "ord", low, high, cap)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a dictionary file, for operators.lexicon.stems."""
    return numbered_lines(spark, path)


def read_affixes(path: str) -> AffixRules:
    """The rules of an affix file; a file of rules is small by nature."""
    return parse_affixes(files.read_bytes(path).decode("utf-8", "ignore").splitlines())


def extract_lexicon(archive: str, folder: str) -> tuple[str, str]:
    """(affix file, dictionary): the only ones of the archive apart from hyphenation; anything else is an error."""
    with zipfile.ZipFile(io.BytesIO(files.read_bytes(archive))) as z:
        names = [n for n in z.namelist() if not os.path.basename(n).startswith("hyph")]
        found = []
        for ending in (".aff", ".dic"):
            own = [n for n in names if n.endswith(ending)]
            if len(own) != 1:
                raise ValueError(f"{archive}: {len(own)} files end in {ending}")
            target = os.path.join(folder, os.path.basename(own[0]))
            files.write_bytes(target, z.read(own[0]))
            found.append(target)
    return found[0], found[1]


def discover(folder: str) -> dict[str, list[tuple]]:
    """Task files that are there under their fixed names: {task: [(language or direction, path)]}."""
    out: dict[str, list[tuple]] = {"mt": [(d, p) for d, name in schemas.MT_FILES.items() if files.exists(p := os.path.join(folder, name))]}
    for task, name in schemas.OTHER_FILES.items():
        out[task] = [(lang, p) for lang in ("hsb", "dsb") if files.exists(p := os.path.join(folder, name.format(lang=lang)))]
    return out


def read_blocklist(spark: SparkSession, paths: list[str], schema: str, fields: list[str], first_only: bool = True) -> DataFrame:
    """(text): the blocklist of all files that are there."""
    from sparklex.operators.pool import blocklist, union_blocklists

    parts = [blocklist(read_jsonl(spark, p, schema), fields, first_only) for p in paths if p and files.exists(p)]
    return union_blocklists(parts) if parts else spark.createDataFrame([], "text string")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of whole files, for hashes."""
    return reduce(lambda a, b: a.unionByName(b), [spark.read.format("binaryFile").load(p).select("path", "content") for p in paths])
