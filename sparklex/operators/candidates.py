"""Candidate corrections: union and rank, single-edit variants, scoring, the decision against the unchanged sentence."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklex.functions.text import CORRECT, is_word, norm, replace_first, replace_token, strip_punct, tokens
from sparklex.operators.lexicon import known_words
from sparklex.runtime import checkpointed

#: Candidates kept for a word.
MOST = 24


class SentenceScorer(Protocol):
    """Scores sentences: takes (variant_id, sentence), returns (variant_id, score), higher for likelier sentences."""

    def __call__(self, sentences: DataFrame) -> DataFrame: ...


class bigram_scorer:  # noqa: N801 - called like a function
    """A stand-in for a language model: the mean of ln((bigram + 1/2) / (left word + 1/2)) over adjacent words, to 9 digits.

    The digits are cut as sums of the same terms in another order would break ties.
    """

    def __init__(self, unigram_counts: DataFrame, bigram_counts: DataFrame):
        self.unigrams, self.bigrams = unigram_counts.select(F.col("token").alias("left"), F.col("cnt").alias("_n")), bigram_counts

    def rated(self, pairs: DataFrame) -> DataFrame:
        """(left, right, lp) of the distinct pairs."""
        known = pairs.select("left", "right").distinct().join(self.bigrams, ["left", "right"], "left").join(self.unigrams, "left", "left")
        return known.select("left", "right", (F.ln(F.coalesce("cnt", F.lit(0)) + F.lit(0.5)) - F.ln(F.coalesce("_n", F.lit(0)) + F.lit(0.5))).alias("lp"))

    def __call__(self, sentences: DataFrame) -> DataFrame:
        pairs = _adjacent(sentences.select("variant_id", _low_words("sentence").alias("t")), "variant_id")
        means = pairs.join(self.rated(pairs), ["left", "right"]).groupBy("variant_id").agg(F.avg("lp").alias("score"))
        return sentences.select("variant_id").join(means, "variant_id", "left").withColumn("score", F.coalesce(F.round("score", 9), F.lit(0.0)))

    def score_edits(self, sentences: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(item_id, null_score) of the sentences and (item_id, pos, rank, word, candidate, score) of their edits.

        An edit changes the two pairs around its word only, so no variant is spelt out: the sum of its sentence gives up two
        terms and gets two others.
        """
        cores = checkpointed(_neighboured_cores(sentences))
        words = checkpointed(sentences.select("item_id", _low_words(norm("sentence")).alias("t")))
        edits = checkpointed(cores.join(candidates.select(F.col("word").alias("core"), "candidate", "rank"), "core").select("item_id", "pos", "rank", F.col("core").alias("word"), "candidate", "left", "right", F.lower("candidate").alias("new")))
        around = lambda df, word: df.select("left", F.col(word).alias("right")).unionByName(df.select(F.col(word).alias("left"), "right")).where("left is not null and right is not null")
        own = _adjacent(words, "item_id")
        lp = checkpointed(self.rated(own.select("left", "right").unionByName(around(edits, "new"))))
        sums = checkpointed(own.join(lp, ["left", "right"]).groupBy("item_id").agg(F.sum("lp").alias("total"), F.count("*").alias("n")))
        before, behind = lp.select("left", F.col("right").alias("_w"), F.col("lp").alias("_a")), lp.select(F.col("left").alias("_w"), "right", F.col("lp").alias("_b"))

        def share(df: DataFrame, word: str, name: str) -> DataFrame:
            both = df.withColumn("_w", F.col(word)).join(before, ["left", "_w"], "left").join(behind, ["_w", "right"], "left")
            return both.withColumn(name, F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).drop("_w", "_a", "_b")

        old = share(cores.withColumn("_low", F.lower("core")), "_low", "old").select("item_id", "pos", "old")
        new = share(edits, "new", "gain").select("item_id", "pos", "rank", "word", "candidate", "gain")
        scored = new.join(old, ["item_id", "pos"]).join(sums, "item_id", "left")
        score = F.coalesce(F.round((F.col("total") - F.col("old") + F.col("gain")) / F.col("n"), 9), F.lit(0.0))
        null = sentences.select("item_id").join(sums, "item_id", "left").select("item_id", F.coalesce(F.round(F.col("total") / F.col("n"), 9), F.lit(0.0)).alias("null_score"))
        return null, scored.select("item_id", "pos", "rank", "word", "candidate", score.alias("score"))


def _low_words(sentence) -> F.Column:
    """The words of a sentence in small letters, marks around them stripped; tokens of marks alone are left out."""
    return F.filter(F.transform(tokens(sentence), lambda t: F.lower(strip_punct(t))), lambda t: t != "")


def _adjacent(words: DataFrame, key: str) -> DataFrame:
    """(key, left, right) of each pair of neighbours in the array t."""
    return words.where("size(t) > 1").select(key, F.explode(F.expr("transform(sequence(1, size(t) - 1), i -> struct(t[i - 1] as left, t[i] as right))")).alias("p")).select(key, "p.*")


def _neighboured_cores(sentences: DataFrame) -> DataFrame:
    """(item_id, pos, core, left, right): sentence_cores with the words before and behind in small letters, null at the ends."""
    rows = sentences.select("item_id", tokens(norm("sentence")).alias("_t"))
    low = rows.withColumn("_l", F.transform("_t", lambda t: F.lower(strip_punct(t))))
    full = low.withColumn("_f", F.filter("_l", lambda t: t != ""))
    each = full.select("item_id", "_l", "_f", F.posexplode("_t").alias("pos", "_tok")).withColumn("core", strip_punct("_tok")).where(is_word("core", 3))
    place = F.size(F.filter(F.slice("_l", F.lit(1), F.col("pos")), lambda t: t != ""))
    before = F.when(place > 0, F.get("_f", place - 1))
    return each.select("item_id", F.col("pos").cast("long").alias("pos"), "core", before.alias("left"), F.get("_f", place + 1).alias("right"))


def rank_candidates(sources: list[DataFrame], frequency: DataFrame, index: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """(word, candidate, cnt, rank): the union of the sources (word, candidate), each candidate a known word other than the
    word, the `most` commonest of them, ties in alphabetical order."""
    one = reduce(lambda a, b: a.unionByName(b), [s.select("word", "candidate") for s in sources]).where("candidate <> word").distinct()
    if index is not None:
        one = known_words(one, index, "candidate").where("known").drop("known")
    counted = one.join(frequency.select(F.col("token").alias("_t"), "cnt"), F.lower("candidate") == F.col("_t"), "left").select("word", "candidate", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("cnt"), "candidate")).cast("long"))
    return ranked.where(F.col("rank") <= most)


def sentence_cores(sentences: DataFrame) -> DataFrame:
    """(item_id, sentence, pos, core): the words of three letters or more of each sentence, marks around them stripped."""
    rows = sentences.select("item_id", norm("sentence").alias("sentence"))
    cores = rows.select("item_id", "sentence", F.posexplode(tokens("sentence")).alias("pos", "tok")).select("item_id", "sentence", F.col("pos").cast("long").alias("pos"), strip_punct("tok").alias("core"))
    return cores.where(is_word("core", 3))


def single_edit_variants(sentences: DataFrame, candidates: DataFrame) -> DataFrame:
    """(item_id, pos, rank, word, candidate, variant): each sentence with one word changed to one of its candidates."""
    cores = sentence_cores(sentences)
    joined = cores.join(candidates.select(F.col("word").alias("core"), "candidate", "rank"), "core")
    return joined.select("item_id", "pos", "rank", F.col("core").alias("word"), "candidate", replace_token("sentence", "pos", "core", "candidate").alias("variant"))


def best_edit(sentences: DataFrame, candidates: DataFrame, scorer: SentenceScorer) -> DataFrame:
    """(item_id, word, corrected, margin, n_variants): the best variant against the unchanged sentence; the first one wins
    a tie. Without candidates CORRECT, CORRECT and 0.

    A scorer that can score an edit by itself (score_edits) is never shown the whole variants. Repeated item_ids give a row
    for each id.
    """
    if hasattr(scorer, "score_edits"):
        null, edits = scorer.score_edits(sentences, candidates)
    else:
        variants = single_edit_variants(sentences, candidates)
        unchanged = sentences.select("item_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("candidate"), norm("sentence").alias("variant"))
        every = variants.unionByName(unchanged).withColumn("variant_id", F.concat_ws(":", "item_id", "pos", "rank"))
        scored = every.join(scorer(every.select("variant_id", F.col("variant").alias("sentence"))), "variant_id")
        null, edits = scored.where("pos < 0").select("item_id", F.col("score").alias("null_score")), scored.where("pos >= 0")
    top = F.max(F.struct("score", (-F.col("pos")).alias("p"), (-F.col("rank")).alias("r"), "word", "candidate"))
    best = edits.groupBy("item_id").agg(top.alias("best"), F.count("*").alias("n"))
    out = null.groupBy("item_id").agg(F.max("null_score").alias("null_score")).join(best, "item_id", "left")
    return out.select("item_id", F.coalesce("best.word", F.lit(CORRECT)).alias("word"), F.coalesce("best.candidate", F.lit(CORRECT)).alias("corrected"), F.coalesce(F.col("best.score") - F.col("null_score"), F.lit(0.0)).alias("margin"), F.coalesce("n", F.lit(0)).cast("long").alias("n_variants"))


def constrained_correction(flagged: DataFrame, candidates: DataFrame, scorer: SentenceScorer) -> DataFrame:
    """(item_id, word, corrected): the flagged word kept, its best replacement among its own correction and the candidates.

    flagged has item_id, sentence, word and correction. A word equal to its correction is CORRECT; a word that isn't in the
    sentence keeps its own correction.
    """
    own = flagged.where("correction is not null and correction not in ('', 'CORRECT')").select("item_id", "sentence", "word", F.col("correction").alias("candidate"), F.lit(0).cast("long").alias("rank"))
    more = flagged.join(candidates.select("word", "candidate", "rank"), "word").where("correction is null or candidate <> correction").select("item_id", "sentence", "word", "candidate", "rank")
    tried = own.unionByName(more).where("word <> candidate or rank = 0").where("instr(sentence, word) > 0").withColumn("variant", replace_first("sentence", "word", "candidate")).withColumn("variant_id", F.concat_ws(":", "item_id", "rank", "candidate"))
    scored = tried.join(scorer(tried.select("variant_id", F.col("variant").alias("sentence"))), "variant_id")
    best = scored.groupBy("item_id").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"), "candidate")).alias("b")).select("item_id", F.col("b.candidate").alias("_best"))
    same = F.col("word") == F.col("correction")
    return flagged.join(best, "item_id", "left").select("item_id", F.when(same, CORRECT).otherwise(F.col("word")).alias("word"), F.when(same, CORRECT).otherwise(F.coalesce("_best", "correction")).alias("corrected"))
