"""Lexicon: affix rules, word forms, paradigms, diacritic variants and words within an edit distance."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Forms of one lemma, the first in the order of the alphabet.
FORMS = 400


@dataclass
class AffixRules:
    """Rules of an affix file: (kind, flag, strip, add, condition), and the groups of exchangeable letters."""

    flag_mode: str = "char"
    rules: list[tuple[str, str, str, str, str]] = field(default_factory=list)
    maps: list[str] = field(default_factory=list)


def parse_affixes(lines) -> AffixRules:
    """Reads FLAG, MAP, SFX and PFX lines; what follows # is a remark. Rules whose condition is no pattern are left out.

    The number of rules is that of a language's endings, not of its texts, so they are kept on the driver.
    """
    out = AffixRules()
    for line in lines:
        parts = line.split("#")[0].split()
        match parts:
            case ["FLAG", mode, *_]:
                out.flag_mode = mode
            case ["MAP", group] if not group.isdigit():
                out.maps.append(group)
            case ["SFX" | "PFX", _, "Y" | "N", _]:
                pass  # a header
            case ["SFX" | "PFX" as kind, flag, strip, add, *more]:
                add, strip = add.split("/")[0], "" if strip == "0" else strip
                condition = more[0] if more else "."
                try:
                    re.compile(condition)
                except re.error:
                    continue
                out.rules.append((kind, flag, strip, "" if add == "0" else add, condition))
    return out


def split_flags(flags: str, mode: str) -> list[str]:
    """A stem's flags: numbers between commas, pairs of characters or single characters, as the affix file says."""
    if mode == "num":
        return [f for f in flags.split(",") if f]
    if mode == "long":
        return [flags[i : i + 2] for i in range(0, len(flags), 2)]
    return list(flags)


def stems(dictionary: DataFrame) -> DataFrame:
    """(lemma_idx, stem, flags) of dictionary lines (line_no, value); a first line with a number alone is left out."""
    lines = dictionary.select("line_no", F.trim("value").alias("v")).where("v <> '' and not (line_no = 0 and v rlike '^[0-9]+$')")
    stem = F.when(F.instr("v", "/") > 0, F.regexp_extract("v", "^(.*)/", 1)).otherwise(F.col("v"))
    flags = F.when(F.instr("v", "/") > 0, F.regexp_extract("v", "/([^/]*)$", 1)).otherwise("")
    out = lines.select(F.col("line_no").alias("lemma_idx"), F.trim(F.substring_index(stem, "\t", 1)).alias("stem"), F.trim(F.substring_index(flags, "\t", 1)).alias("flags"))
    return out.where("stem <> ''")


def expand(stem_rows: DataFrame, rules: AffixRules, cap: int = FORMS) -> DataFrame:
    """(lemma_idx, form): each stem with what its flags make of it, at most `cap` forms a lemma in alphabetical order.

    Prefixes and suffixes aren't combined.
    """
    by_flag: dict[str, list] = {}
    for kind, flag, strip, add, condition in rules.rules:
        pattern = re.compile(f"(?:{condition})$" if kind == "SFX" else f"^(?:{condition})")
        by_flag.setdefault(flag, []).append((kind, strip, add, pattern))
    mode = rules.flag_mode

    @F.pandas_udf("array<string>")
    def forms(stem: pd.Series, flags: pd.Series) -> pd.Series:
        out = []
        for word, own in zip(stem, flags):
            made = {word}
            for flag in split_flags(own, mode):
                for kind, strip, add, pattern in by_flag.get(flag, ()):
                    if not pattern.search(word):
                        continue
                    if kind == "SFX" and word.endswith(strip):
                        made.add(word[: len(word) - len(strip)] + add)
                    elif kind == "PFX" and word.startswith(strip):
                        made.add(add + word[len(strip) :])
            out.append(sorted(made)[:cap])
        return pd.Series(out)

    return stem_rows.select("lemma_idx", F.explode(forms("stem", "flags")).alias("form")).distinct()


def form_index(forms: DataFrame) -> DataFrame:
    """(form, lemma_idx) of every form as it is and in small letters."""
    return forms.select("lemma_idx", F.explode(F.array("form", F.lower("form"))).alias("form")).distinct()


def known_words(words: DataFrame, index: DataFrame, word: str = "word") -> DataFrame:
    """words with `known`: the lexicon has the word as it is or in small letters."""
    have = index.select(F.col("form").alias("_f"), F.lit(True).alias("_k")).distinct()
    spelt = words.select(word).distinct().select(word, F.explode(F.array_distinct(F.array(F.col(word), F.lower(word)))).alias("_f")).join(have, "_f").select(word).distinct().withColumn("known", F.lit(True))
    return words.join(spelt, word, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def paradigm(words: DataFrame, forms: DataFrame, cap: int = 60, word: str = "word") -> DataFrame:
    """(word, form): other forms of the word's lemmas; small letters are tried only if the word as it is isn't known."""
    index = form_index(forms)
    own = words.select(word).distinct()
    exact = own.join(index, own[word] == index["form"]).select(word, "lemma_idx")
    lower = own.join(exact.select(word).distinct(), word, "left_anti")
    lower = lower.join(index, F.lower(lower[word]) == index["form"]).select(word, "lemma_idx")
    found = exact.unionByName(lower).join(forms, "lemma_idx").where(F.col("form") != F.col(word)).select(word, "form").distinct()
    # The forms of one word are few: its lemmas times FORMS.
    return found.groupBy(word).agg(F.slice(F.array_sort(F.collect_set("form")), 1, cap).alias("f")).select(word, F.explode("f").alias("form"))


def diacritic_variants(words: DataFrame, maps: list[str], word: str = "word") -> DataFrame:
    """(word, variant): the word with one letter exchanged within its group. Built-in expressions only."""
    alternatives: dict[str, list[str]] = {}
    for group in maps:
        for ch in group:
            alternatives.setdefault(ch, [])
            alternatives[ch] += [o for o in group if o != ch and o not in alternatives[ch]]
    empty = words.select(F.col(word), F.lit(None).cast("string").alias("variant")).where("false")
    if not alternatives:
        return empty
    table = F.create_map(*[x for ch, alt in sorted(alternatives.items()) for x in (F.lit(ch), F.array(*map(F.lit, alt)))])
    letters = words.select(word).distinct().where(F.length(word) > 0).select(word, F.posexplode(F.split(F.col(word), "")).alias("_i", "_ch")).where("_ch <> ''")
    swapped = letters.select(word, "_i", F.explode(F.try_element_at(table, "_ch")).alias("_alt"))
    return swapped.select(word, F.concat(F.substring(F.col(word), F.lit(1), F.col("_i")), "_alt", F.substring(F.col(word), F.col("_i") + 2, F.length(word))).alias("variant")).where(F.col("variant") != F.col(word)).distinct()


def _deletions(column: str, k: int) -> F.Column:
    """All strings that `k` deletions or fewer leave of the word."""
    out = f"array({column})"
    for _ in range(k):
        out = f"array_distinct(concat({out}, flatten(transform(filter({out}, x -> length(x) > 0), w -> transform(sequence(1, length(w)), i -> concat(substring(w, 1, i - 1), substring(w, i + 1)))))))"
    return F.expr(out)


def deletion_index(words: DataFrame, k: int, word: str = "word") -> DataFrame:
    """(variant, word): the index that stands for a metric tree; words within k edits share a variant."""
    return words.select(word).distinct().where(F.col(word).isNotNull()).select(F.explode(_deletions(word, k)).alias("variant"), word)


def within_edits(left: DataFrame, right: DataFrame, k: int, word: str = "word", match: str = "match") -> DataFrame:
    """(word, match, distance): all pairs of words within k edits, equal ones with distance 0.

    An equi-join on what deletions leave, then the bounded distance; never a comparison of all pairs.
    """
    a = deletion_index(left, k, word)
    b = deletion_index(right.select(F.col(word).alias(match)), k, match)
    pairs = a.join(b, "variant").select(word, match).distinct()
    return pairs.select(word, match, F.levenshtein(word, match, k).cast("long").alias("distance")).where("distance >= 0")
