"""Seeded sampling, splits, carrier masks, compositions and mixtures.

Chance is a hash of the seed and the row's key, so a row's lot doesn't depend on partitions or on other rows. Ranks over
all rows are taken within buckets of the hash and offset by the buckets before, so no task sorts the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklex.functions.text import chat, mt_prompt
from sparklex.runtime import ordered_rank

# The compositions of a translation training set.
COMPOSITIONS = ("comp0", "compfz", "comprd")


def lot(seed, *cols) -> Column:
    """A whole number below 2^32 from the seed and the columns: the first 32 bits of their md5."""
    parts = [F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def unit(seed, *cols) -> Column:
    """A number from 0 to below 1."""
    return lot(seed, *cols) / F.lit(4294967296.0)


def shuffled_rank(df: DataFrame, seed, key: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with its place from 0 in the order of the lots, ties by the key; within the groups of `by`, if given.

    The key should be unique. A group may hold most of the rows: it is ranked in buckets of its lots.
    """
    by = by or []
    rows = df.withColumn("_lot", lot(seed, key)).withColumn("_b", F.shiftright("_lot", 20))
    counts = rows.groupBy(*by, "_b").count()
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))  # 4096 rows a group
    inner = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_lot", key)) - 1
    ranked = rows.withColumn("_r", inner).join(offsets, [*by, "_b"])
    return ranked.withColumn(name, (F.col("_o") + F.col("_r")).cast("long")).drop("_lot", "_b", "_o", "_r")


def seeded_sample(df: DataFrame, k: int, seed, key: str) -> DataFrame:
    """k rows by lot, alike in every run."""
    return df.withColumn("_lot", lot(seed, key)).orderBy("_lot", key).limit(k).drop("_lot")


def carrier_mask(df: DataFrame, seed, key: str, by: list[str] | None = None) -> DataFrame:
    """df with `carrier`, true for exactly half of the rows (rounded down), of each group of `by`."""
    by = by or []
    ranked = shuffled_rank(df, seed, key, by, "_rank")
    if not by:
        return ranked.withColumn("carrier", F.col("_rank") < F.floor(df.agg(F.count("*").alias("n")).scalar() / 2)).drop("_rank")
    joined = ranked.join(df.groupBy(*by).agg(F.count("*").alias("_n")), by)
    return joined.withColumn("carrier", F.col("_rank") < F.floor(F.col("_n") / 2)).drop("_rank", "_n")


def train_pool_split(df: DataFrame, seed, key: str, pool_size: int, volume: int | None = None) -> DataFrame:
    """df with `part`: the first pool_size rows by lot are pool, the next `volume` (or all) train; others are left out."""
    ranked = shuffled_rank(df, seed, key, name="_rank")
    part = F.when(F.col("_rank") < pool_size, "pool").when(F.lit(volume is None) | (F.col("_rank") < pool_size + (volume or 0)), "train")
    return ranked.withColumn("part", part).where("part is not null").drop("_rank")


def tenth_split(df: DataFrame, key: str) -> DataFrame:
    """df with `part`: the first tenth (at least one row) in the order of the key is pool, the rest train."""
    ranked = ordered_rank(df, key, "_rank")
    pool = max(1, ranked.count() // 10)
    return ranked.withColumn("part", F.when(F.col("_rank") < pool, "pool").otherwise("train")).drop("_rank")


def balanced_sample(df: DataFrame, seed, key: str, group: str, sizes: dict[str, int]) -> DataFrame:
    """So many rows of each group by lot; groups not named give none. A group may hold most of the rows."""
    table = F.create_map(*[x for g, n in sorted(sizes.items()) for x in (F.lit(g), F.lit(n))])
    ranked = shuffled_rank(df.where(F.col(group).isin(*sizes)), seed, key, [group], "_rank")
    return ranked.where(F.col("_rank") < F.try_element_at(table, F.col(group))).drop("_rank")


def random_exemplars(pairs: DataFrame, pool: DataFrame, seed) -> DataFrame:
    """pairs (direction, row_idx, src, tgt) with exemplar (src, tgt): one of the direction's pool by lot, drawn once more
    if its source is the row's own. pool has direction, row_idx, src and tgt."""
    ranked = pool.select("direction", F.struct("src", "tgt").alias("_e"), "row_idx")
    numbered = shuffled_rank(ranked, "pool", "row_idx", ["direction"], "_no").drop("row_idx")
    sizes = pool.groupBy("direction").agg(F.count("*").alias("_n"))
    draws = pairs.join(sizes, "direction", "left").withColumn("_no", F.pmod(lot(seed, "row_idx"), F.col("_n"))).withColumn("_no2", F.pmod(lot(f"{seed}'", "row_idx"), F.col("_n")))
    first = draws.join(numbered, ["direction", "_no"], "left")
    second = first.join(numbered.select("direction", F.col("_no").alias("_no2"), F.col("_e").alias("_e2")), ["direction", "_no2"], "left")
    chosen = F.when((F.col("_e.src") == F.col("src")) & (F.col("_n") > 1), F.col("_e2")).otherwise(F.col("_e"))
    return second.withColumn("exemplar", chosen).drop("_n", "_no", "_no2", "_e", "_e2")


def carriers(pairs: DataFrame, seed, validation: int) -> DataFrame:
    """pairs (direction, row_idx) with `held`, true for the first `validation` rows of a direction in the order of row_idx, else
    null, and `carrier`, true for half of the others."""
    first = Window.partitionBy("direction").orderBy("row_idx")
    held = pairs.select("direction", "row_idx").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= validation).select("direction", "row_idx", F.lit(True).alias("held"))
    split = pairs.join(held, ["direction", "row_idx"], "left")
    train = carrier_mask(split.where("held is null"), seed, "row_idx", ["direction"])
    return train.unionByName(split.where("held").withColumn("carrier", F.lit(False)))


def compositions(pairs: DataFrame, seed, validation: int, source_name: Column, target_name: Column, comps=COMPOSITIONS) -> DataFrame:
    """(comp, split, direction, row_idx, messages): the same rows in every composition.

    pairs has direction, row_idx, src, tgt, and fuzzy and random (each null or (src, tgt)). The first `validation` rows of a
    direction in the order of row_idx are the validation split, without exemplars; half of the others are carriers, which
    get their composition's exemplar. Columns `held` and `carrier` are used if pairs has them (`carriers`).
    """
    rows = pairs if "carrier" in pairs.columns else carriers(pairs, seed, validation)
    exemplar = F.when(F.col("carrier") & (F.col("comp") == "compfz"), F.col("fuzzy")).when(F.col("carrier") & (F.col("comp") == "comprd"), F.col("random"))
    every = rows.withColumn("comp", F.explode(F.array(*map(F.lit, comps)))).withColumn("_x", exemplar)
    user = mt_prompt("src", source_name, target_name, F.when(F.col("_x").isNotNull(), F.array("_x")).otherwise(F.array().cast("array<struct<src:string,tgt:string>>")))
    return every.select("comp", F.when(F.col("held"), "validation").otherwise("training").alias("split"), "direction", "row_idx", chat(user, F.col("tgt")).alias("messages"))


def mixture(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts with their names in `component`, in columns that all of them have."""
    common = [c for c in next(iter(parts.values())).columns if all(c in p.columns for p in parts.values())]
    return reduce(lambda a, b: a.unionByName(b), [p.select(F.lit(name).alias("component"), *common) for name, p in parts.items()])
