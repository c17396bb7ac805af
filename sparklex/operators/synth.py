"""Seeded synthetic errors and questions. Every choice is a hash of the seed, the row's key and the name of the choice."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sparklex.functions.text import CORRECT, STOPWORDS, _c, is_word, norm, replace_token, strip_punct, tokens
from sparklex.operators.lexicon import known_words
from sparklex.operators.mix import lot, unit

# Letters for insertions and substitutions, and pairs that writers mistake for each other.
ALPHABET = "aábcčćdeěéfghiíjklłmnńoóprřśštuúwyzžź"
CONFUSED = {"s": "šś", "š": "sśř", "ś": "sš", "ł": "w", "w": "ł", "ř": "š", "ó": "o", "o": "ó", "ć": "c", "c": "ć", "ŕ": "r", "r": "ŕ"}
# Shares of the kinds of edit, of substitutions by a confused letter, and weights of a word's thirds.
EDITS = (("substitution", 0.35), ("transposition", 0.20), ("insertion", 0.16), ("deletion", 0.16), ("multi", 0.13))
CONFUSED_SHARE = 0.35
THIRDS = (1.5, 2.0, 3.0)
# Endings and what wrongly stands for them, the most special ending first; an empty string is no ending.
ENDINGS = {
    "hsb": (("eje", ("oh", "e", "")), ("eho", ("a", "u", "om")), ("ami", ("ach", "om", "mi")), ("ach", ("ami", "om", "mi")), ("ej", ("a", "u", "e")), ("je", ("a", "u", "om")), ("aj", ("i", "e", "u")), ("om", ("a", "u", "")), ("mi", ("ch", "ami", "ach")), ("ch", ("mi", "ami", "om")), ("oh", ("eje", "u", "a")), ("ow", ("a", "e", "u")), ("a", ("ej", "u", "", "om", "eje", "je", "e", "y", "i")), ("e", ("", "a", "u")), ("u", ("om", "", "a", "ej", "oh", "eje", "eho")), ("i", ("aj", "e", "a")), ("y", ("a", "e", "u"))),
    "dsb": (("ami", ("ach", "om", "ow")), ("ach", ("ami", "om", "ow")), ("eju", ("a", "u", "e")), ("eje", ("a", "u", "e")), ("om", ("a", "u", "")), ("mi", ("ch", "ami", "ach")), ("ch", ("mi", "ami", "om")), ("am", ("ow", "y", "u")), ("go", ("je", "om", "a")), ("ow", ("am", "ami", "ach", "y")), ("je", ("go", "om", "u")), ("a", ("u", "eje", "eju", "e", "y")), ("e", ("u", "a", "")), ("u", ("e", "", "a", "om", "eje")), ("y", ("a", "u", "ow"))),
}
CLOZE_QUESTION = "Kotre słowo słuša do pralizny?"
FILLERS = ("wóno", "tute", "tamne", "druhe", "dalše", "wšě", "někajke")
OPTION_COUNTS = ((2, 0.45), (3, 0.55))


def _chance(seed, key):
    """Numbers from 0 to below 1 by name, from md5 of seed, name and key: the same lots as operators.mix.unit gives."""
    return lambda name: int(hashlib.md5(f"{seed}/{name}:{key}".encode()).hexdigest()[:8], 16) / 4294967296.0


def _drawn(u: float, weighted):
    total = sum(w for _, w in weighted)
    for value, w in weighted:
        u -= w / total
        if u < 0:
            return value
    return weighted[-1][0]


def biased_place(length: int, u: float) -> int:
    """A place below length; the last third of a word is likelier than the middle, and that than the first."""
    last = max(length - 1, 1)
    return _drawn(u, [(i, THIRDS[min(2, 3 * i // last)]) for i in range(length)])


def edit(word: str, kind: str, place: float, letter: float, confuse: float) -> str:
    """The word after one edit of the kind; a substitution never keeps the letter. Words too short for it stay."""
    n = len(word)
    if not word or n < 2 and kind in ("transposition", "deletion"):
        return word
    at = biased_place(n - 1 if kind == "transposition" else n, place)
    pick = lambda letters: letters[int(letter * len(letters))]
    match kind:
        case "transposition":
            return word[:at] + word[at + 1] + word[at] + word[at + 2 :]
        case "deletion":
            return word[:at] + word[at + 1 :]
        case "insertion":
            return word[:at] + pick(ALPHABET) + word[at:]
    near = CONFUSED.get(word[at])
    return word[:at] + pick(near if near and confuse < CONFUSED_SHARE else ALPHABET.replace(word[at], "")) + word[at + 1 :]


def typo(word: str, u) -> str:
    """The word with an edit drawn from EDITS, two for `multi`; an edit that changes nothing gives way to a substitution."""
    singles = [(k, 1) for k in ("substitution", "deletion", "insertion", "transposition")]
    kind = _drawn(u("kind"), EDITS)
    out = edit(word, _drawn(u("first"), singles) if kind == "multi" else kind, u("place"), u("letter"), u("confuse"))
    if kind == "multi":
        again = edit(out, _drawn(u("second"), singles), u("place2"), u("letter2"), u("confuse2"))
        out = again if again != word else out
    return out if out != word else edit(word, "substitution", u("place3"), u("letter3"), u("confuse3"))


def _words(text: str, least: int) -> tuple[list[str], list[int]]:
    tokens_ = text.split(" ") if text else []
    return tokens_, [i for i, t in enumerate(tokens_) if len(t) >= least and t.isalpha()]


def inject_typos(df: DataFrame, sentence: str, key: str, seed, share: float = 0.5) -> DataFrame:
    """(key, input_sentence, original_sentence, incorrect_word, correct_word): a share of the sentences with one typo.

    A word of three letters or more is changed. Sentences without such a word, and those not drawn, are clean: both words
    are CORRECT. Null sentences are empty.
    """

    @F.pandas_udf(StructType([StructField(n, StringType()) for n in ("input_sentence", "incorrect_word", "correct_word")]))
    def spoil(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = []
        for text, k in zip(texts, keys):
            u = _chance(seed, k)
            words, may = _words(text, 3)
            if u("error") < share and may:
                i = may[int(u("word") * len(may))]
                bad = typo(words[i], u)
                if bad != words[i]:
                    rows.append((" ".join([*words[:i], bad, *words[i + 1 :]]), bad, words[i]))
                    continue
            rows.append((text, CORRECT, CORRECT))
        return pd.DataFrame(rows, columns=["input_sentence", "incorrect_word", "correct_word"])

    rows = df.select(key, norm(sentence).alias("original_sentence")).withColumn("_r", spoil("original_sentence", F.col(key).cast("string")))
    return rows.select(key, "_r.input_sentence", "original_sentence", "_r.incorrect_word", "_r.correct_word")


def _eligible(df: DataFrame, sentence: str, key: str, accept) -> DataFrame:
    """df with its tokens `_t` and the places `_e` of those that may be changed, from 0."""
    rows = df.withColumn("_t", tokens(sentence))
    return rows.withColumn("_e", F.filter(F.sequence(F.lit(0), F.greatest(F.size("_t") - 1, F.lit(0))), lambda i: F.coalesce(accept(F.get(F.col("_t"), i)), F.lit(False))))


def _behind(stem: Column):
    """A function of one argument only: with a second one, transform would give it the element's number."""
    return lambda e: F.concat(stem, e)


def swap_ending(word, lang: str, seed, *key) -> Column:
    """The word with a wrong ending: the first rule whose ending it has and that changes it; null without one."""
    w, out = _c(word), None
    for rule, (ending, wrong) in enumerate(ENDINGS[lang]):
        stem = F.substring(w, F.lit(1), F.length(w) - len(ending))
        start = F.pmod(lot(f"{seed}/ending{rule}", w, *key), F.lit(len(wrong)))
        options = F.array(*map(F.lit, wrong))
        turned = F.concat(F.slice(options, (start + 1).cast("int"), F.lit(len(wrong))), F.slice(options, 1, start.cast("int")))
        made = F.get(F.filter(F.transform(turned, _behind(stem)), lambda x: (x != w) & (x != "")), 0)
        hit = w.endswith(ending) & made.isNotNull()
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return out


def inject_endings(df: DataFrame, sentence: str, key: str, lang: str, seed, share: float = 0.5) -> DataFrame:
    """Like inject_typos, with a wrong ending: the words are tried in the order of their lots until one can be changed."""
    endings = [e for e, _ in ENDINGS[lang]]
    fits = lambda t: is_word(t, 3) & t.rlike("(?:" + "|".join(endings) + ")$")
    rows = _eligible(df.select(key, norm(sentence).alias("_s")), "_s", key, fits)
    ranked = rows.withColumn("_i", F.get(F.array_sort(F.transform("_e", lambda i: F.struct(lot(f"{seed}/word", F.col(key), i).alias("l"), i.alias("i")))), 0)["i"]).withColumn("_w", F.get(F.col("_t"), F.col("_i")))
    ranked = ranked.withColumn("_new", swap_ending("_w", lang, seed, key))
    bad = (unit(f"{seed}/error", key) < share) & F.col("_new").isNotNull()
    wrong = F.array_join(F.transform("_t", lambda t, i: F.when(i == F.col("_i"), F.col("_new")).otherwise(t)), " ")
    return ranked.select(key, F.when(bad, wrong).otherwise(F.col("_s")).alias("input_sentence"), F.col("_s").alias("original_sentence"), F.when(bad, F.col("_new")).otherwise(CORRECT).alias("incorrect_word"), F.when(bad, F.col("_w")).otherwise(CORRECT).alias("correct_word"))


def cloze(df: DataFrame, sentence: str, key: str, vocabulary: list[str], seed, options: int | None = None) -> DataFrame:
    """(key, context, question, possible_answers, correct_answer_num, answer_text): a salient word masked, with distractors.

    The vocabulary is a bounded list of frequent words. `options` is the number of options, drawn from OPTION_COUNTS if not
    given. Distractors differ from the answer and from each other apart from case; fillers stand in if the vocabulary is
    too small. Sentences without a salient word, or with too few distractors, give no row.
    """
    words = list({w.casefold(): w for w in reversed([*vocabulary, *FILLERS])}.values())[::-1]
    stop = frozenset(STOPWORDS)

    @F.pandas_udf(StructType([StructField("context", StringType()), StructField("answers", ArrayType(StringType())), StructField("answer", StringType())]))
    def ask(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = []
        for text, k in zip(texts, keys):
            u = _chance(seed, k)
            own, may = _words(text, 4)
            may = [i for i in may if own[i].lower() not in stop]
            n = options or _drawn(u("count"), OPTION_COUNTS)
            if not may:
                rows.append((None, None, None))
                continue
            i = may[int(u("mask") * len(may))]
            answer, others = own[i], []
            for j in range(n - 1):  # from a drawn word on, the first that fits
                at = int(u(f"option {j}") * len(words))
                fits = (w for w in words[at:] + words[:at] if w.casefold() != answer.casefold() and w not in others)
                others += [w for _, w in zip(range(1), fits)]
            if len(others) < n - 1:
                rows.append((None, None, None))
                continue
            shown = sorted([answer, *others], key=lambda w: u(f"order {w}"))
            rows.append((" ".join([*own[:i], "___", *own[i + 1 :]]), shown, answer))
        return pd.DataFrame(rows, columns=["context", "answers", "answer"])

    rows = df.select(key, ask(norm(sentence), F.col(key).cast("string")).alias("r")).where("r.context is not null")
    numbers = F.transform(F.sequence(F.lit(1), F.size("r.answers")), lambda i: i.cast("string"))
    return rows.select(key, "r.context", F.lit(CLOZE_QUESTION).alias("question"), F.map_from_arrays(numbers, "r.answers").alias("possible_answers"), F.array_position("r.answers", F.col("r.answer")).cast("int").alias("correct_answer_num"), F.col("r.answer").alias("answer_text"))


def calibrated_corruption(df: DataFrame, sentence: str, key: str, transforms: DataFrame, index: DataFrame, seed, most: int = 40) -> DataFrame:
    """(key, input_sentence, original_sentence, incorrect_word, correct_word): one word with a learned wrong ending.

    transforms has removed and added, the index the lexicon's forms; the word and what it becomes must both be known. Of
    each sentence's possible changes the one with the lowest lot is taken, among `most` lots for each word. The learned
    endings are few and joined by the ending, so no word meets all of them.
    """
    rows = df.select(key, norm(sentence).alias("_s"))
    cores = rows.select(key, F.posexplode(tokens("_s")).alias("_pos", "_tok")).select(key, F.col("_pos").cast("long").alias("_pos"), strip_punct("_tok").alias("_w")).where(is_word("_w", 4))
    vocabulary = known_words(cores.select("_w").distinct(), index, "_w").where("known").select("_w")
    ends = vocabulary.select("_w", F.explode(F.expr("transform(sequence(0, length(_w) - 1), i -> substring(_w, length(_w) - i + 1, i))")).alias("removed"))
    made = ends.join(transforms.select("removed", "added").distinct(), "removed").select("_w", F.concat(F.expr("substring(_w, 1, length(_w) - length(removed))"), "added").alias("_new")).where("_new <> _w and _new <> ''").distinct()
    real = known_words(made, index, "_new").where("known").select("_w", "_new")
    tried = cores.join(real, "_w").withColumn("_l", lot(f"{seed}/transform", key, "_pos", "_new"))
    best = tried.groupBy(key, "_pos", "_w").agg(F.slice(F.array_sort(F.collect_set(F.struct("_l", "_new"))), 1, most).alias("_c"))
    chosen = best.groupBy(key).agg(F.min(F.struct(lot(f"{seed}/word", key, "_pos").alias("l"), "_pos", "_w", F.get(F.col("_c"), 0)["_new"].alias("_new"))).alias("m")).select(key, "m._pos", "m._w", "m._new")
    return rows.join(chosen, key).select(key, replace_token("_s", "_pos", "_w", "_new").alias("input_sentence"), F.col("_s").alias("original_sentence"), F.col("_new").alias("incorrect_word"), F.col("_w").alias("correct_word"))


def synthesis_meta(rows: DataFrame) -> DataFrame:
    """One row: how many rows are clean and wrong, and the share of wrong ones."""
    bad = F.col("incorrect_word") != CORRECT
    return rows.agg(F.count("*").alias("rows"), F.count_if(~bad).alias("clean"), F.count_if(bad).alias("errors"), F.avg(bad.cast("double")).alias("error_share"))
