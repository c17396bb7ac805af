"""Problem 7: texts packed into containers of fixed capacity.

What is planned is the histogram of lengths, which the capacity bounds, never the texts. Patterns of a few lengths that
fill a container are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and rounded
down to what is there; this is repeated on what is left, and the residual lengths are packed best-fit decreasing. The plan
says for each length which ranks go to which containers. Texts are ranked within their length without bringing a length
together, and look their container up by rank.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklex.runtime import checkpointed

#: Where the tokenizer's vocabulary is: ranks of a byte-level BPE, and the pattern that cuts text before it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Patterns tried in a round, rounds, and rows ranked in one task.
PATTERNS, ROUNDS, RANKED_ROWS = 3_000, 6, 50_000


def _counter(ranks):
    def count(batches):
        import tiktoken

        encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            n = [len(x) for x in encoding.encode_ordinary_batch(batch.column(1).to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return count


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every text with tokens; null and empty texts have none. Texts are measured whole."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    shared = documents.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary's size is fixed
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and length(text) > 0")
    return rows.mapInArrow(_counter(shared), "doc_id long, n_tokens long")


def nnls(columns: np.ndarray, target: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative x near the least of |sum_j x_j column_j - target|; columns holds each pattern's lengths, -1 for none.

    Projected gradient steps with momentum, which only need the patterns' lengths.
    """
    real = columns >= 0
    at = np.where(real, columns, 0)
    x = np.zeros(len(columns))
    y, t = x.copy(), 1.0
    use = np.bincount(at[real], minlength=len(target))
    step = 1.0 / max(1.0, columns.shape[1] * use.max() / 4)
    for _ in range(sweeps):
        fitted = np.bincount(at[real], np.repeat(y, real.sum(1)), minlength=len(target))
        gradient = (np.where(real, (fitted - target)[at], 0)).sum(1)
        new = np.maximum(0, y - step * gradient)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def enumerate_patterns(left: np.ndarray, capacity: int, rng: np.random.Generator, most: int = PATTERNS) -> np.ndarray:
    """Patterns of few lengths that fill the capacity exactly, drawn from the lengths that are left; -1 fills the rows up."""
    lengths = np.flatnonzero(left)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros((0, 1), np.int64)
    share = left[lengths] / left[lengths].sum()
    few = int(min(16, max(2, np.ceil(capacity / max(1.0, (lengths * share).sum())) + 1)))
    drawn = rng.choice(lengths, (most * 3, few - 1), p=share)
    total = drawn.cumsum(1)
    fits = (total < capacity).sum(1)
    out = {(int(capacity),)} if left[capacity] else set()
    for row, sums, k in zip(drawn.tolist(), total.tolist(), fits.tolist()):
        for n in range(k, 0, -1):
            rest = capacity - sums[n - 1]
            if left[rest] > 0:
                out.add(tuple(sorted([*row[:n], rest])))
                break
        if len(out) >= most:
            break
    found = np.full((len(out), few), -1, np.int64)
    for i, p in enumerate(sorted(out)):
        found[i, : len(p)] = p
    return found


def plan(histogram: np.ndarray, capacity: int, seed: int = 5) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): how many containers of each pattern; every item is in one. histogram[n]: items of length n."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    rng, out = np.random.default_rng(seed), []
    for _ in range(ROUNDS):
        patterns = enumerate_patterns(left, capacity, rng)
        if not len(patterns):
            break
        want = np.floor(nnls(patterns, left.astype(float)) + 1e-6).astype(np.int64)
        for j in np.argsort(-want, kind="stable"):
            if want[j] <= 0:
                break
            p = patterns[j][patterns[j] >= 0]
            lengths, times = np.unique(p, return_counts=True)
            n = int(min(want[j], (left[lengths] // times).min()))
            if n > 0:
                left[lengths] -= n * times
                out.append((tuple(p.tolist()), n))
    # Best fit decreasing on the counts: the longest length first, then always the longest that still fits.
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        p, used = [top], np.zeros_like(left)
        used[top] += 1
        room = capacity - top
        while room > 0:
            fit = np.flatnonzero(left[: room + 1] - used[: room + 1] > 0)
            if not len(fit):
                break
            p.append(int(fit[-1]))
            used[fit[-1]] += 1
            room -= int(fit[-1])
        lengths = np.flatnonzero(used)
        n = int((left[lengths] // used[lengths]).min())
        left[lengths] -= n * used[lengths]
        out.append((tuple(p), n))
    return out


def _slots(plans: dict[int, list[tuple[tuple[int, ...], int]]]) -> dict:
    """For each (capacity, length): first ranks, first containers and unused space of its slots, in the order of rank."""
    out: dict = {}
    for capacity, patterns in plans.items():
        taken: dict[int, int] = {}
        first = 0
        for lengths, n in patterns:
            for length in lengths:
                rank = taken.get(length, 0)
                out.setdefault((capacity, length), []).append((rank, first, capacity - sum(lengths)))
                taken[length] = rank + n
            first += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in out.items()}


def _placer(slots: dict):
    def place(batches):
        for batch in batches:
            capacity, length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            container, unused = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            key = capacity.astype(np.int64) << 32 | length
            for k in np.unique(key):
                at = np.flatnonzero(key == k)
                ranks, firsts, spare = slots[(int(k >> 32), int(k & 0xFFFFFFFF))]
                slot = np.searchsorted(ranks, rank[at], side="right") - 1
                container[at] = firsts[slot] + rank[at] - ranks[slot]
                unused[at] = spare[slot]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(container), pa.array(unused)], ["capacity", "n_tokens", "doc_id", "part_no", "container", "unused"])

    return place


def pack(sizes: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, container, doc_id, part_no, n_tokens, unused): every text of sizes (doc_id, n_tokens) in a container.

    A text longer than the capacity is cut into full containers and a rest, numbered by part_no from 1; no other text is
    cut. unused is the space left in the whole container. Texts of 0 tokens take none. Rows that repeat a doc_id are
    packed each. Capacities must be positive; other columns are not read.
    """
    caps = sorted({int(c) for c in capacities if c is not None and c > 0})
    spark = sizes.sparkSession
    if not caps:
        return spark.createDataFrame([], "capacity long, container long, doc_id long, part_no int, n_tokens long, unused long")
    sizes = checkpointed(sizes.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long")).where("n_tokens > 0"))
    total = sizes.count()
    per = sizes.withColumn("capacity", F.explode(F.array(*[F.lit(c).cast("long") for c in caps])))
    whole = F.expr("n_tokens div capacity")
    parts = F.expr("sequence(1L, (n_tokens + capacity - 1) div capacity)")
    items = per.withColumn("part", F.explode(parts)).select("capacity", F.when(F.col("part") <= whole, F.col("capacity")).otherwise(F.col("n_tokens") % F.col("capacity")).alias("length"), "doc_id", F.col("part").cast("int").alias("part_no"))
    buckets = max(1, min(4096, total // RANKED_ROWS))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(buckets)))
    counts = items.groupBy("capacity", "length", "bucket").count()
    histogram: dict[int, np.ndarray] = {c: np.zeros(c + 1, np.int64) for c in caps}
    for r in counts.groupBy("capacity", "length").agg(F.sum("count").alias("n")).collect():  # at most the sum of the capacities
        histogram[r["capacity"]][r["length"]] = r["n"]
    slots = _slots({c: plan(h, c) for c, h in histogram.items()})
    before = Window.partitionBy("capacity", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = Window.partitionBy("capacity", "length", "bucket").orderBy("doc_id", "part_no")
    ranked = items.withColumn("rn", F.row_number().over(own)).join(offsets, ["capacity", "length", "bucket"])
    ranked = ranked.select("capacity", "length", (F.col("rn") - 1 + F.col("offset")).cast("long").alias("rank"), "doc_id", "part_no")
    placed = ranked.mapInArrow(_placer(slots), "capacity long, n_tokens long, doc_id long, part_no int, container long, unused long")
    return placed.select("capacity", "container", "doc_id", "part_no", "n_tokens", "unused")
