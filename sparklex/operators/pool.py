"""Parallel pools: blocklists, decontamination, leave-one-out, prefix cap and the funnel of what each step removes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.functions.text import fold_key, norm
from sparklex.runtime import checkpointed, ranked_within

#: Pairs kept for each direction.
CAP = 60_000


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, sentence): the text cut at . ! ? and line ends; pieces are normalised, empty ones left out."""
    pieces = df.select(F.col(key), F.posexplode(F.split(F.col(text), "[.!?\\n]+")).alias("pos", "piece"))
    return pieces.select(key, F.col("pos").cast("long").alias("pos"), norm("piece").alias("sentence")).where("sentence <> ''")


def blocklist(rows: DataFrame, fields: list[str], first_only: bool = True, key=norm) -> DataFrame:
    """(text): distinct normal forms of each row's first field that isn't empty, or of all fields. Fields may be missing."""
    have = [f for f in fields if f in rows.columns]
    if not have:
        return rows.sparkSession.createDataFrame([], "text string")
    filled = [F.nullif(key(f), F.lit("")) for f in have]
    texts = rows.select(F.coalesce(*filled).alias("text")) if first_only else rows.select(F.explode(F.array(*filled)).alias("text"))
    return texts.where("text is not null").distinct()


def union_blocklists(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).where("text <> ''").distinct()


def exclude(df: DataFrame, column: str, block: DataFrame, key=norm) -> DataFrame:
    """Rows whose column isn't on the list; null columns stay. The planner broadcasts the list if it is small enough."""
    out = df.withColumn("_key", key(column)).join(block.select(F.col("text").alias("_key")), "_key", "left_anti")
    return out.drop("_key")


def decontaminate(pool: DataFrame, block: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Pairs neither side of which is on the list."""
    return exclude(exclude(pool, src, block), tgt, block)


def leave_one_out(pool: DataFrame, dev: DataFrame, src: str = "src") -> DataFrame:
    """Pairs whose source isn't a held-out source."""
    return exclude(pool, src, dev)


def cap_first(df: DataFrame, order: str, cap: int = CAP, by: str | None = None) -> DataFrame:
    """The first `cap` rows in the order, of each group if `by` is given; a null group is one too.

    Groups are counted first; only if one holds more than the cap are rows ranked, and then in ranges of group and order, so
    no task sorts a whole group. df is read twice.
    """
    if by is None:
        return df.orderBy(order).limit(cap)
    if df.groupBy(by).count().where(F.col("count") > cap).isEmpty():
        return df
    return ranked_within(df, [by], order, "_rank").where(F.col("_rank") < cap).drop("_rank")


def build_pool(pool: DataFrame, block: DataFrame, dev: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """The pool (direction, row_idx, src, tgt) cleaned of test and held-out material and cut to the cap."""
    clean = decontaminate(pool, block)
    return cap_first(checkpointed(clean if dev is None else leave_one_out(clean, dev)), "row_idx", cap, "direction")


def funnel(pool: DataFrame, block: DataFrame, dev: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """One row for each direction with the counters of each step; the residual is counted anew on what is kept."""
    listed = block.select(F.col("text").alias("_key"), F.lit(True).alias("_in"))
    flag = lambda df, col, lst, name: df.withColumn("_key", norm(col)).join(lst, "_key", "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_key", "_in")
    marked = flag(flag(pool, "src", listed, "_src"), "tgt", listed, "_tgt").withColumn("_test", F.col("_src") | F.col("_tgt"))
    if dev is not None:
        marked = flag(marked, "src", dev.select(F.col("text").alias("_key"), F.lit(True).alias("_in")), "_dev")
    else:
        marked = marked.withColumn("_dev", F.lit(False))
    marked = checkpointed(marked.select("direction", "row_idx", "src", "tgt", "_test", "_dev"))
    counts = marked.groupBy("direction").agg(F.count("*").alias("pool_original"), F.count_if("_test").alias("removed_by_test_dedup"), F.count_if(F.expr("_dev and not _test")).alias("removed_by_dev_exclusion"), F.count_if(F.expr("not _dev and not _test")).alias("_left"))
    counts = counts.withColumn("shipped", F.least("_left", F.lit(cap).cast("long"))).withColumn("removed_by_cap", F.col("_left") - F.col("shipped")).drop("_left")
    shipped = cap_first(marked.where("not _test and not _dev"), "row_idx", cap, "direction")
    again = blocklist(block, ["text"], key=norm)
    sides = shipped.select("direction", F.explode(F.array(norm("src"), norm("tgt"))).alias("text")).join(again, "text", "left_semi").groupBy("direction").agg(F.count("*").alias("residual_test_material"))
    order = ["direction", "pool_original", "removed_by_test_dedup", "removed_by_dev_exclusion", "removed_by_cap", "shipped", "residual_test_material"]
    return counts.join(sides, "direction", "left").fillna(0, ["residual_test_material"]).select(*order)


def first_seen(df: DataFrame, key, order: list[str]) -> DataFrame:
    """One row for each key, the first in the order (which should be unique). Rows are aggregated before the shuffle, so a
    key may hold most of them."""
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(key.alias("_key")).agg(first.alias("_row")).select("_row.*")


def dedup_texts(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """First-seen rows by text apart from white space and case; null texts count as empty ones."""
    return first_seen(df, fold_key(text), order)


def ranked_union(sources: list[DataFrame], text: str, order: str, low: int = 3, high: int = 40, cap: int | None = None) -> DataFrame:
    """Sources from the best to the worst: texts of fitting length, each once, in the order (source_rank, order)."""
    from sparklex.functions.text import length_ok

    ranked = [s.select(F.lit(i).alias("source_rank"), F.col(order), norm(text).alias(text)) for i, s in enumerate(sources)]
    one = reduce(lambda a, b: a.unionByName(b), ranked).where(length_ok(text, low, high))
    out = dedup_texts(one, text, ["source_rank", order])
    return out if cap is None else out.orderBy("source_rank", order).limit(cap)
