"""Packaging: task files in fixed field orders, bundles, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.functions.text import CORRECT

# The fields of each task's file in their order, and what stands for missing ones.
FIELDS = {
    "mt": ("dataset_id", "sent_id", "source", "pred"),
    "qa": ("dataset_id", "question_id", "question", "pred"),
    "sc": ("dataset_id", "id", "input_sentence", "pred_incorrect", "pred_corrected"),
    "gc": ("dataset_id", "id", "input_sentence", "pred_incorrect", "pred_corrected"),
    "mr": ("dataset_id", "id", "question", "pred"),
}
DEFAULTS = {"pred": "", "pred_incorrect": CORRECT, "pred_corrected": CORRECT}
# The order in which the files of a bundle are joined.
BUNDLE = {"mt": ("deu-hsb", "hsb-deu", "deu-dsb", "dsb-deu", "hsb-dsb", "dsb-hsb"), "qa": ("hsb", "dsb"), "sc": ("hsb", "dsb"), "gc": ("hsb", "dsb"), "mr": ("hsb", "dsb")}


def package_rows(df: DataFrame, task: str) -> DataFrame:
    """The task's fields in their order. Missing prediction columns get their defaults, any other missing one is an error;
    an option is a whole number, an id a string."""
    missing = [f for f in FIELDS[task] if f not in df.columns and f not in DEFAULTS]
    if missing:
        raise ValueError(f"{task}: columns missing: {missing}")
    out = []
    for f in FIELDS[task]:
        col = F.col(f) if f in df.columns else F.lit(DEFAULTS[f])
        if f == "pred" and task == "qa":
            col = col.cast("int")
        elif f in DEFAULTS:
            col = F.coalesce(col.cast("string"), F.lit(DEFAULTS[f]))
            col = F.when(col == "", CORRECT).otherwise(col) if f != "pred" else col
        else:
            col = col.cast("string")
        out.append(col.alias(f))
    return df.select(*out)


def bundle(parts: dict[str, DataFrame], task: str) -> DataFrame:
    """The parts of a task that are there, with `bucket` numbering them in the bundle's order; others are skipped."""
    have = [(i, parts[name]) for i, name in enumerate(BUNDLE[task]) if name in parts]
    if not have:
        raise ValueError(f"no part of {task}")
    return reduce(lambda a, b: a.unionByName(b), [p.withColumn("bucket", F.lit(i)) for i, p in have])


def differing_rows(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """One row: rows of either side, and at how many places they differ; a place only one side has differs."""
    cols = [c for c in left.columns if c != ordinal]
    mark = lambda df, n: df.select(ordinal, F.sha2(F.to_json(F.struct(*cols)), 256).alias(n))
    both = mark(left, "_a").join(mark(right, "_b"), ordinal, "full")
    return both.agg(F.count("_a").alias("left_rows"), F.count("_b").alias("right_rows"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing"))


def content_hashes(files: DataFrame) -> DataFrame:
    """(name, sha256, bytes) of files read as binary (path, content)."""
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))


def check_manifest(hashes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, expected, found, exact): every file of the manifest against what is there."""
    return manifest.select("name", F.col("sha256").alias("expected")).join(hashes.select("name", F.col("sha256").alias("found")), "name", "left").withColumn("exact", F.col("expected").eqNullSafe(F.col("found")))


def set_hash(df: DataFrame) -> str:
    """A hash of the rows as a set, whatever their order: 128 bits, each row's own hash in exclusive or, and the count."""
    row = F.to_json(F.struct(*sorted(df.columns)))
    got = df.agg(F.hex(F.bit_xor(F.xxhash64(row))).alias("a"), F.hex(F.bit_xor(F.xxhash64(F.lit("set"), row))).alias("b"), F.count("*").alias("n")).first()
    return f"{got['a'] or 0:0>16}{got['b'] or 0:0>16}-{got['n']}"
