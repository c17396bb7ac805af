"""Problem 4: texts cut off by a field limit or in transfer, and how often each source cuts.

A stack automaton judges each text's structure; where that is whole and only the final mark is missing, a model of
sentence ends gives its evidence. How much a missing mark says differs by source: one that often leaves marks off whole
sentences says less by it than one that never does. So the ends without mark that are plainly whole and plainly cut are
counted for each source, over all of its texts, and the evidence leans by how the source differs from all.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.completeness import EndModel, end_evidence, fit_end_model
from sparklex.runtime import bounded_sample, checkpointed, join_groups

#: Rows, about, on which the model of sentence ends is fitted.
FIT_ROWS = 5_000
#: Evidence from which an end is plain; plain ends of an average source that each source's own are added to; most leaning.
PLAIN, PRIOR, LEANING = 2.0, 50.0, 0.5


def sample_end_model(texts: DataFrame, rows: int = FIT_ROWS) -> EndModel:
    """The model fitted on a bounded sample of about `rows` texts."""
    sample = bounded_sample(texts, "rec_id", rows).select("text", "source", "kind").collect()
    return fit_end_model([(r["text"], r["source"], r["kind"]) for r in sample])


def _judge(model: EndModel):
    def run(batches):
        for batch in batches:
            source, kind, text = (batch.column(i).to_pylist() for i in (1, 2, 3))
            why = [end_evidence(t, s, k, model) if t else (None, None) for t, s, k in zip(text, source, kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array([x for x, _ in why], pa.string()), pa.array([x for _, x in why], pa.float64())], ["rec_id", "origin", "structure", "evidence"])

    return run


def judged_texts(texts: DataFrame, model: EndModel | None = None, origin: list[str] | None = None) -> DataFrame:
    """(rec_id, reason) and the columns of origin: each text with why it counts as cut off inside a sentence, or null.

    texts has rec_id, source (what it translates, or null), kind (texts of one kind are alike in length against their
    source), text and the columns of origin, which together name where a text comes from (nulls are one origin of their
    own); other columns are not read. Null and empty texts and texts without letters are whole. Whole texts are judged,
    however long. A repeated rec_id gives a row for each of its rows. A hot origin is aggregated before the shuffle, and its
    rows are joined by a broadcast.
    """
    origin = origin or []
    place = F.struct(*[F.col(c).cast("string").alias(c) for c in origin]) if origin else F.struct(F.lit(None).cast("string").alias("_all"))
    rows = texts.select(F.col("rec_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.col("kind").cast("string"), F.lit("")).alias("kind"), F.col("text").cast("string"), F.to_json(place).alias("origin"))
    judged = checkpointed(rows.mapInArrow(_judge(model or sample_end_model(rows)), "rec_id long, origin string, structure string, evidence double"))
    ends = judged.groupBy("origin").agg(F.count("*").alias("n"), F.count_if(F.col("evidence") >= PLAIN).alias("whole"), F.count_if(F.col("evidence") <= -PLAIN).alias("cut"))
    totals = ends.agg(F.sum("whole").alias("whole"), F.sum("cut").alias("cut")).first()
    whole, cut = (totals["whole"] or 0) + 1.0, (totals["cut"] or 0) + 1.0
    share = PRIOR / (whole + cut)
    leaning = F.log((F.col("whole") + share * whole) / (F.col("cut") + share * cut)) - F.log(F.lit(whole / cut))
    leaning = F.greatest(F.lit(-LEANING), F.least(F.lit(LEANING), leaning))
    out = join_groups(judged, ends.select("origin", "n", leaning.alias("leaning")), ["origin"], "n")
    reason = F.coalesce("structure", F.when(F.col("evidence") + F.col("leaning") < 0, "incomplete sentence")).alias("reason")
    return out.select("rec_id", reason, *[F.get_json_object("origin", f"$.{c}").alias(c) for c in origin])


def truncated_texts(texts: DataFrame, model: EndModel | None = None, origin: list[str] | None = None) -> DataFrame:
    """The rows of judged_texts that are cut off."""
    return judged_texts(texts, model, origin).where("reason is not null")
