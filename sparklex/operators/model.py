"""Hooks for models that aren't part of this library: generators and encoders, run over Arrow batches.

A model is loaded once a task, by a function that the caller gives; nothing here depends on a model library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# New tokens at most by task.
MAX_NEW = {"mt": 320, "qa": 16, "sc": 64, "gc": 64, "mr": 640}

#: (prompts, max_new, sample, temperature, min_new) -> replies, one for each prompt.
Model = Callable[..., list[str]]


def generator(load: Callable[[], Model], task: str, batch: int = 96) -> Callable[..., DataFrame]:
    """A generate function for the pipelines: takes rows (item_id, prompt), gives (item_id, raw). Null prompts give null.

    Prompts are sorted by length within an Arrow batch, so that a model's batches need little padding.
    """

    def generate(rows: DataFrame, sample: bool = False, temperature: float = 0.0, min_new: int = 0) -> DataFrame:
        kind = rows.select("item_id").schema["item_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]):
            model = load()
            for b in batches:
                prompts = b.column(1).to_pylist()
                order = sorted((i for i, p in enumerate(prompts) if p is not None), key=lambda i: len(prompts[i]))
                raw: list[str | None] = [None] * len(prompts)
                for at in range(0, len(order), batch):
                    part = order[at : at + batch]
                    for i, text in zip(part, model([prompts[i] for i in part], max_new=MAX_NEW[task], sample=sample, temperature=temperature, min_new=min_new), strict=True):
                        raw[i] = text
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.string())], ["item_id", "raw"])

        return rows.select("item_id", F.col("prompt").cast("string")).mapInArrow(run, f"item_id {kind}, raw string")

    return generate


def encoder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[DataFrame], DataFrame]:
    """A function that gives rows (row_idx, text) their embedding; null texts have none."""

    def encode(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]):
            model = load()
            for b in batches:
                texts = b.column(1).to_pylist()
                have = [i for i, t in enumerate(texts) if t is not None]
                out: list = [None] * len(texts)
                for i, v in zip(have, model([texts[i] for i in have]) if have else [], strict=True):
                    out[i] = v
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["row_idx", "embedding"])

        return rows.select(F.col("row_idx").cast("long"), F.col("text").cast("string")).mapInArrow(run, "row_idx long, embedding array<double>")

    return encode
