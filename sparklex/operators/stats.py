"""Corpus statistics: unigrams, bigrams, vocabularies, suffix taxonomies, bigram witnesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklex.functions.text import CORRECT, is_salient, is_word, neighbours, strip_punct, suffix_delta, tokens


def _cores(text) -> F.Column:
    """The tokens in small letters without marks around them; empty ones are left out."""
    return F.filter(F.transform(tokens(text), lambda t: F.lower(strip_punct(t))), lambda t: t != "")


def unigrams(df: DataFrame, text: str) -> DataFrame:
    """(token, cnt) of tokens of letters only; counted within tasks before the shuffle."""
    return df.select(F.explode(_cores(text)).alias("token")).where(is_word("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def unigram_logp(counts: DataFrame) -> DataFrame:
    """(token, cnt, logp): ln((cnt + 1/2) / total)."""
    total = counts.agg(F.greatest(F.coalesce(F.sum("cnt"), F.lit(0)), F.lit(1)).alias("total")).scalar()
    return counts.select("token", "cnt", F.ln((F.col("cnt") + F.lit(0.5)) / total).alias("logp"))


def bigrams(df: DataFrame, text: str) -> DataFrame:
    """(left, right, cnt) of adjacent tokens of a row, figures kept."""
    rows = df.select(_cores(text).alias("t")).where("size(t) > 1")
    pairs = rows.select(F.explode(F.expr("transform(sequence(1, size(t) - 1), i -> struct(t[i - 1] as left, t[i] as right))")).alias("p"))
    return pairs.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.count("*").alias("cnt"))


def frequency_vocab(df: DataFrame, text: str, order: str, top: int = 5000) -> DataFrame:
    """(token, cnt, first_seen): the commonest salient tokens, case kept, ties in the order of their first row and token."""
    words = df.select(F.col(order).alias("first_seen"), F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([\\p{L}\\p{N}_]+)"), 1)).alias("token"))
    counts = words.where(is_salient("token")).groupBy("token").agg(F.count("*").alias("cnt"), F.min("first_seen").alias("first_seen"))
    return counts.orderBy(F.desc("cnt"), "first_seen", "token").limit(top)


def suffix_taxonomy(rows: DataFrame, wrong: str, correct: str, least_stem: int = 2) -> DataFrame:
    """(removed, added, cnt): endings of correct words and what stands for them in wrong ones with the same stem."""
    delta = rows.where(F.col(wrong).isNotNull() & F.col(correct).isNotNull() & (F.col(wrong) != CORRECT)).select(suffix_delta(correct, wrong).alias("d"))
    return delta.where(F.length("d.stem") >= least_stem).groupBy("d.removed", "d.added").agg(F.count("*").alias("cnt"))


def clean_rate(rows: DataFrame, wrong: str) -> DataFrame:
    """(items, clean_rate): the share of items without an error."""
    return rows.where(F.col(wrong).isNotNull()).agg(F.count("*").alias("items"), F.avg((F.col(wrong) == CORRECT).cast("double")).alias("clean_rate"))


def learning_half(rows: DataFrame, item_id: str) -> DataFrame:
    """Rows with an even number as id; ids that are no number are left out."""
    return rows.where(F.pmod(F.col(item_id).try_cast("long"), F.lit(2)) == 0)


def witness(rows: DataFrame, counts: DataFrame, sentence: str = "sentence", observed: str = "observed", candidate: str = "candidate") -> DataFrame:
    """rows with `witness`: how much better the candidate's neighbours attest it than the observed word.

    The score of a word is the sum of ln(count + 1/2) over its bigrams with the left and right neighbour. 0 if a word is
    missing or the observed one is CORRECT. Rows need a unique column `item_id`.
    """
    near = rows.select("item_id", F.lower(observed).alias("o"), F.lower(candidate).alias("c"), neighbours(sentence, observed).alias("n"), (F.coalesce(F.col(observed), F.lit("")).isin("", CORRECT) | (F.coalesce(F.col(candidate), F.lit("")) == "")).alias("none")).where("not none")
    wanted = near.select("item_id", F.explode(F.array(*[F.struct(F.lit(sign).alias("sign"), left.alias("left"), right.alias("right")) for sign, w in ((1, "c"), (-1, "o")) for left, right in ((F.col("n.left"), F.col(w)), (F.col(w), F.col("n.right")))])).alias("w")).select("item_id", "w.*").where("left is not null and left <> '' and right is not null and right <> ''")
    scored = wanted.join(counts, ["left", "right"], "left").groupBy("item_id").agg(F.sum(F.col("sign") * F.ln(F.coalesce("cnt", F.lit(0)) + F.lit(0.5))).alias("witness"))
    return rows.join(scored, "item_id", "left").withColumn("witness", F.coalesce("witness", F.lit(0.0)))


def mixture_shares(df: DataFrame, component: str) -> DataFrame:
    """(component, rows, share) of all rows."""
    counts = df.groupBy(F.col(component).alias("component")).agg(F.count("*").alias("rows"))
    return counts.select("component", "rows", (F.col("rows") / df.agg(F.count("*").alias("n")).scalar()).alias("share"))


def tier_counts(df: DataFrame, item_id: str) -> DataFrame:
    """(tier, rows) with both tiers, also if one has no rows."""
    from sparklex.functions.text import tier_of

    tiers = df.sparkSession.createDataFrame([("low",), ("medium",)], "tier string")
    got = df.groupBy(tier_of(item_id).alias("tier")).agg(F.count("*").alias("rows"))
    return tiers.join(got, "tier", "left").fillna(0, ["rows"])


def fire_counts(rows: DataFrame, stage: str, pred: str) -> DataFrame:
    """(stage, rows, empty): how many rows each stage decided, and how many of them have an empty prediction."""
    return rows.groupBy(F.col(stage).cast("string").alias("stage")).agg(F.count("*").alias("rows"), F.count_if(F.trim(F.coalesce(F.col(pred).cast("string"), F.lit(""))) == "").alias("empty"))


def tier_exemplars(dev: DataFrame, item_id: str, order: str, k: int = 3) -> DataFrame:
    """The first k rows of each tier in the order, with `tier`: they show the form of answers."""
    from sparklex.functions.text import tier_of

    ranked = dev.withColumn("tier", tier_of(item_id)).withColumn("_r", F.row_number().over(Window.partitionBy("tier").orderBy(order)))
    return ranked.where(F.col("_r") <= k).drop("_r")
