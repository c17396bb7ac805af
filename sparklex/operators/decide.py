"""Decisions between competing corrections: arbitration, top-ups, cascades, the retry ladder, overrides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.functions.text import CORRECT, _c, is_quoted, is_upper, mr_answer, norm, strip_punct, tokens
from sparklex.operators.lexicon import diacritic_variants, form_index, known_words
from sparklex.runtime import checkpointed

#: The rungs of the ladder: (number, sampled, temperature, least new tokens).
LADDER = ((1, False, 0.0, 24), (2, False, 0.0, 24), (3, True, 0.7, 32))
ANSWER_NOW = "Let me give the final answer now. <answer>"


def arbitrate(rows: DataFrame, weight: float, threshold: float) -> DataFrame:
    """rows with (word, corrected) decided between a detector and an engine.

    rows has v5_w, v5_c, eng_w, eng_c, co_w, co_c, margin and witness. A word the detector flags stays: with the engine's
    correction if it means the same word, else with the constrained one. Otherwise the engine decides alone if margin +
    weight * witness reaches the threshold. Empty results become CORRECT.
    """
    flagged = (F.coalesce("v5_w", F.lit("")) != "") & (F.col("v5_w") != CORRECT)
    agree = (F.coalesce("eng_w", F.lit("")) == F.col("v5_w")) & (F.coalesce("eng_c", F.lit("")) != "")
    solo = F.coalesce("margin", F.lit(0.0)) + F.lit(weight) * F.coalesce("witness", F.lit(0.0)) >= threshold
    pick = lambda mine, engine, constrained: F.when(flagged & agree, engine).when(flagged, constrained).when(solo, mine).otherwise(F.lit(CORRECT))
    filled = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(CORRECT))
    return rows.withColumns({"word": filled(pick(F.col("eng_w"), F.col("v5_w"), F.col("co_w"))), "corrected": filled(pick(F.col("eng_c"), F.col("eng_c"), F.col("co_c")))})


def nonword_topup(sentences: DataFrame, forms: DataFrame, frequency: DataFrame, maps: list[str], tau: int, exactly_one: bool = True, skip_caps: bool = True, skip_quoted: bool = True) -> DataFrame:
    """(item_id, word, corrected): words the lexicon lacks that become a frequent known word by one exchanged diacritic.

    The commonest form wins, ties in alphabetical order. With exactly_one, sentences with several such words give none;
    without it, the first word of the sentence gives its form.
    """
    rows = sentences.select("item_id", norm("sentence").alias("sentence"))
    cores = rows.select("item_id", "sentence", F.posexplode(tokens("sentence")).alias("pos", "tok")).select("item_id", "sentence", "pos", strip_punct("tok").alias("word")).where("length(word) >= 3")
    if skip_caps:
        cores = cores.where(~is_upper("word"))
    if skip_quoted:
        cores = cores.where(~is_quoted("word", "sentence"))
    index = form_index(forms)
    unknown = known_words(cores, index, "word").where("not known").drop("known")
    fixes = known_words(diacritic_variants(unknown.select("word").distinct(), maps), index, "variant").where("known")
    rated = fixes.join(frequency.select(F.col("token").alias("_t"), "cnt"), F.lower("variant") == F.col("_t")).where(F.col("cnt") >= tau)
    # The smallest (-count, form) is the commonest form, first in the alphabet.
    best = rated.groupBy("word").agg(F.min(F.struct((-F.col("cnt")).alias("n"), "variant")).alias("b")).select("word", F.col("b.variant").alias("corrected"))
    found = unknown.join(best, "word")
    # Each occurrence of a word counts.
    per_item = found.groupBy("item_id").agg(F.count("*").alias("_n"), F.min(F.struct("pos", "word", "corrected")).alias("m"))
    if exactly_one:
        per_item = per_item.where("_n = 1")
    return per_item.select("item_id", "m.word", "m.corrected")


def margin_topup(word, corrected, margin, sentence, tau: float, skip_caps: bool = True, skip_quoted: bool = True) -> F.Column:
    """(word, corrected) if the margin reaches tau and no guard speaks against it, else null. The first word of a sentence
    may be a capital one."""
    w, s = _c(word), _c(sentence)
    ok = (F.coalesce(w, F.lit("")) != "") & (w != CORRECT) & (F.coalesce(_c(margin), F.lit(0.0)) >= tau)
    if skip_caps:
        first = strip_punct(F.coalesce(F.get(tokens(s), 0), F.lit("")))
        ok = ok & ~(is_upper(w) & (w != first))
    if skip_quoted:
        ok = ok & ~is_quoted(w, s)
    return F.when(ok, F.struct(w.alias("word"), _c(corrected).alias("corrected")))


def sc_cascade(decided: DataFrame, nonword: DataFrame, tau: float | None) -> DataFrame:
    """(item_id, word, corrected, stage): the engine's decision, else the diacritic top-up, else the margin top-up (none if
    tau is None).

    decided has item_id, sentence, word, corrected, eng_w, eng_c and margin; each stage acts on rows still CORRECT.
    """
    rows = decided.join(nonword.select("item_id", F.col("word").alias("_nw"), F.col("corrected").alias("_nc")), "item_id", "left")
    top = margin_topup("eng_w", "eng_c", "margin", "sentence", float("inf") if tau is None else tau)
    open_ = F.coalesce(F.nullif("word", F.lit("")), F.lit(CORRECT)) == CORRECT
    stage = F.when(~open_, "engine").when(F.col("_nw").isNotNull(), "diacritic").when(top.isNotNull(), "margin").otherwise("none")
    staged = rows.withColumn("stage", stage).withColumn("_top", top)
    choose = lambda own, nw, t: F.when(F.col("stage") == "engine", F.col(own)).when(F.col("stage") == "diacritic", F.col(nw)).when(F.col("stage") == "margin", F.col(f"_top.{t}")).otherwise(F.lit(CORRECT))
    return staged.select("item_id", choose("word", "_nw", "word").alias("word"), choose("corrected", "_nc", "corrected").alias("corrected"), "stage")


def retry_ladder(rows: DataFrame, generate: Callable[..., DataFrame], rungs=LADDER) -> DataFrame:
    """rows (item_id, prompt, raw) with raw and `stage`: rows whose answer can't be extracted are generated anew, rung by rung.

    generate(rows, sample, temperature, min_new) takes (item_id, prompt) and returns (item_id, raw). The second rung has the
    prompt end in an opened answer. A rung's result counts if it has an answer; stage is its number, 0 for the first run.
    Each rung is written down, so the model answers a prompt once.
    """
    out = checkpointed(rows.withColumn("stage", F.lit(0)))
    for number, sample, temperature, min_new in rungs:
        empty = out.where(mr_answer("raw") == "")
        prompt = F.concat("prompt", F.lit(ANSWER_NOW)) if number == 2 else F.col("prompt")
        again = generate(empty.select("item_id", prompt.alias("prompt")), sample=sample, temperature=temperature, min_new=min_new)
        text = F.concat(F.lit("<answer>"), F.col("raw")) if number == 2 else F.col("raw")
        good = again.select("item_id", text.alias("_raw")).where(mr_answer("_raw") != "")
        out = checkpointed(out.join(good, "item_id", "left").withColumn("stage", F.when(F.col("_raw").isNotNull(), number).otherwise(F.col("stage"))).withColumn("raw", F.coalesce("_raw", "raw")).drop("_raw"))
    return out


def override(rows: DataFrame, overrides: DataFrame, key: str, column: str = "pred") -> DataFrame:
    """rows with the column replaced where overrides has the key; keys of overrides must be unique."""
    return rows.join(overrides.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
