"""Global assignment of options to slots within small groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklex.functions.text import gaps, target_gap


def best_assignment(scores: np.ndarray) -> list[int | None]:
    """For each row the column that makes the sum largest, each column once; rows beyond the columns get None.

    Shortest augmenting paths with potentials, in the third power of the size.
    """
    m = np.asarray(scores, float)
    if m.size == 0:
        return [None] * len(m)
    flip = m.shape[0] > m.shape[1]
    cost = -(m.T if flip else m)
    n, k = cost.shape
    u, v = np.zeros(n + 1), np.zeros(k + 1)
    owner = np.zeros(k + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, came, done = np.full(k + 1, np.inf), np.zeros(k + 1, int), np.zeros(k + 1, bool)
        while True:
            done[j0] = True
            row = owner[j0]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            came[1:][better] = j0
            free = np.flatnonzero(~done[1:]) + 1
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[owner[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[came[j0]]
            j0 = came[j0]
    out: list[int | None] = [None] * len(m)
    for j in range(1, k + 1):
        if owner[j]:
            if flip:
                out[j - 1] = int(owner[j] - 1)
            else:
                out[owner[j] - 1] = int(j - 1)
    return out


def assign_blocks(scores: DataFrame) -> DataFrame:
    """(block, slot, choice): the options (from 0) of each block's slots, null for slots without one.

    scores has block, slot and scores (array of double, one for each option of the block, as many in every row). A block
    is a handful of slots by nature, so it is solved in one task.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        picks = best_assignment(np.stack([np.asarray(s, float) for s in pdf["scores"]]))
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "slot": pdf["slot"].to_numpy(), "choice": pd.array(picks, "Int32")})

    return scores.where("size(scores) > 0").groupBy("block").applyInPandas(solve, scores.select("block", "slot").schema.simpleString()[7:-1].replace(":", " ") + ", choice int")


def gap_blocks(items: DataFrame, prefix: int = 400) -> DataFrame:
    """(block, question_id, gap, shared): items that ask for a gap of their context, by the first `prefix` characters of it.

    shared tells whether a block of several items offers the same options in all.
    """
    rows = items.withColumn("gap", target_gap("question")).where(F.array_contains(gaps("context"), F.col("gap"))).withColumn("block", F.substring("context", 1, prefix))
    options = F.to_json(F.array_sort(F.map_entries("possible_answers")))
    shape = rows.groupBy("block").agg(F.countDistinct(options).alias("_sets"), F.count("*").alias("_n")).select("block", ((F.col("_sets") == 1) & (F.col("_n") > 1)).alias("shared"))
    return rows.select("block", "question_id", "gap").join(shape, "block")


def slot_order(rows: DataFrame, block: str, key: str) -> DataFrame:
    """rows with `slot`: the place of each key within its block, from 0."""
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy(block).orderBy(key)) - 1)
