"""Problem 3: texts that look the same but are stored in different characters.

Width, kinds of blanks, zero-width characters and combining accents are brought to one form for every text. Look-alike
letters are repaired by script: the dominant script of each token is that of its letters which look like none of another
script (for a token without such letters, that of the text). A token with letters of another script is rewritten into its
dominant script if the result occurs in the corpus in another spelling. The corpus vocabulary is a table that is joined,
never broadcast, so it may grow with the data.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.text import LOOKALIKES, skeleton, visible
from sparklex.runtime import HOT_ROWS, checkpointed, fingerprint, join_groups

#: Characters that are their own canonical form (fixed values): Latin letters with precomposed accents, ASCII, dashes, quotes and other marks.
_PLAIN_CHARACTERS = "\\u0020-\\u007E\\u00A1-\\u00AC\\u00AE-\\u0240\\u2012-\\u2027\\u2030-\\u203A\\u20AC"
_LETTERS = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_ALIKE = frozenset(LOOKALIKES)


def script(ch: str) -> str:
    """Latin, Cyrillic, Greek or other; empty for what isn't a letter."""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "")
    return next((s for s in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE") if name.startswith(s)), "OTHER")


def _twins(of: str) -> dict[str, str]:
    """Latin letters and the letter of the script that each of them looks like, the first in the table."""
    out: dict[str, str] = {}
    for other, latin in LOOKALIKES.items():
        if script(other) == of and len(latin) == 1:
            out.setdefault(latin, other)
    return out


#: For scripts other than Latin: the Latin letters that look like one of the script's.
TWINS = {s: _twins(s) for s in ("CYRILLIC", "GREEK")}


def _base(ch: str) -> str:
    return ch if ch <= "\u02ff" else unicodedata.normalize("NFD", ch)[0]


def _foreign(ch: str) -> bool:
    """A letter of another script that looks like a Latin one, also under an accent."""
    return ch in _ALIKE or ch > "\u02ff" and _base(ch) in _ALIKE


def dominant_script(token: str) -> str | None:
    """The script of the token's letters that look like none of another script; None if there are none or several.

    Against Latin only a look-alike's own letter counts; against Cyrillic and Greek, Latin letters with a twin don't count.
    """
    clear = {script(ch) for ch in token if ch.isalpha() and not _foreign(ch)}
    if clear <= {"LATIN"}:
        return "LATIN" if clear else None
    others = clear - {"LATIN"}
    if len(others) > 1:
        return None
    own = others.pop()
    latin = [ch for ch in token if script(ch) == "LATIN"]
    return own if all(_base(unicodedata.normalize("NFD", ch)[0]) in TWINS.get(own, {}) for ch in latin) else None


def in_script(token: str, own: str) -> str:
    """The token with every letter that looks like one of the script exchanged for it."""
    if own == "LATIN":
        return skeleton(token)
    twins = TWINS.get(own, {})
    spread = "".join(twins.get(ch, ch) if script(ch) == "LATIN" else _other_twin(ch, own) for ch in unicodedata.normalize("NFD", token))
    return unicodedata.normalize("NFC", spread)


def _other_twin(ch: str, own: str) -> str:
    """A look-alike of a third script by way of its Latin twin."""
    latin = LOOKALIKES.get(ch)
    return TWINS[own].get(latin, ch) if latin is not None and script(ch) != own else ch


def mixed_tokens(text: str) -> list[tuple[str, str]]:
    """(token, its form in its dominant script) of the tokens that hold letters of another script.

    A token of look-alikes alone is one if the text is mostly Latin. Tokens whose letters look like none of the dominant
    script's keep them.
    """
    if not any(map(_foreign, text)) and not any(script(ch) not in ("", "LATIN") for ch in text if ch > "\u02ff"):
        return []
    latin = other = 0
    for ch in text:
        if ch.isalpha() and not _foreign(ch):
            if script(ch) == "LATIN":
                latin += 1
            else:
                other += 1
    out = []
    for token in dict.fromkeys(_LETTERS.findall(text)):
        if token.isascii():
            continue
        own = dominant_script(token)
        if own is None and latin > other and not any(script(ch) == "OTHER" for ch in token) and all(_foreign(ch) or not ch.isalpha() for ch in token):
            own = "LATIN"
        if own is not None and (form := in_script(token, own)) != token:
            out.append((token, form))
    return out


def _look(texts: pd.Series) -> pd.DataFrame:
    base = [None if t is None else visible(t).strip(" ") for t in texts]
    mixed = [[] if b is None else mixed_tokens(b) for b in base]
    return pd.DataFrame({"base": base, "mixed": mixed})


def _repair(base: pd.Series, tokens: pd.Series) -> pd.Series:
    out = []
    for text, pairs in zip(base, tokens):
        if text is not None and pairs is not None and len(pairs):
            to = {p["token"]: p["repaired"] for p in pairs}
            text = _LETTERS.sub(lambda m: to.get(m.group(), m.group()), text)
        out.append(text)
    return pd.Series(out)


def canonical_texts(texts: DataFrame, field: str = "field", rec_id: str = "rec_id", text: str = "text") -> DataFrame:
    """(field, rec_id, text, canon): each text with its consistent form.

    Null texts give no row; an empty text is its own form. A plain text (only Latin letters, ASCII and common marks) only
    loses outer blanks. Repeated (field, rec_id) with different texts are kept apart. Columns besides these three are
    not read, so their names can't clash.
    """
    rows = texts.select(F.col(field).cast("string").alias("field"), F.col(rec_id).cast("long").alias("rec_id"), F.col(text).cast("string").alias("text")).where("text is not null and rec_id is not null")
    odd_text = ~F.col("text").rlike(rf"\A[{_PLAIN_CHARACTERS}]*+\z")  # one possessive run; a search for an odd character takes ten times as long
    look = F.pandas_udf(_look, "base string, mixed array<struct<token:string,repaired:string>>")
    odd = checkpointed(rows.where(odd_text).withColumn("look", look("text")).select("field", "rec_id", "text", "look.*"))
    plain = rows.where(~odd_text)
    mixed = odd.where(F.size("mixed") > 0).select("field", "rec_id", "text", F.explode("mixed").alias("m")).select("field", "rec_id", "text", "m.*")
    if mixed.isEmpty():
        repaired = odd.select("field", "rec_id", "text", F.col("base").alias("canon"))
    else:
        # The vocabulary holds every token of every text but the doubtful ones; each form counts once per task before the shuffle.
        tokens = lambda df, col: df.select(F.explode(F.array_distinct(F.split(col, "[^\\p{L}\\p{M}]+"))).alias("token"))
        candidates = mixed.select("token", "repaired").distinct()
        vocabulary = tokens(plain, "text").unionByName(tokens(odd, "base")).distinct().join(candidates.select(F.col("repaired").alias("token")).distinct(), "token", "left_semi")
        known = candidates.join(vocabulary, F.col("repaired") == vocabulary["token"], "left_semi")
        spelt = candidates.groupBy("repaired").agg(F.count("*").alias("n")).where("n > 1").select("repaired")
        approved = known.unionByName(candidates.join(spelt, "repaired", "left_semi").select("token", "repaired")).distinct()
        per_row = mixed.select("field", "rec_id", "text", "token").join(approved, "token").groupBy("field", "rec_id", "text").agg(F.collect_set(F.struct("token", "repaired")).alias("pairs"))
        fixed = odd.where(F.size("mixed") > 0).join(per_row, ["field", "rec_id", "text"], "left")
        repair = F.pandas_udf(_repair, "string")
        repaired = fixed.select("field", "rec_id", "text", repair("base", "pairs").alias("canon")).unionByName(odd.where(F.size("mixed") == 0).select("field", "rec_id", "text", F.col("base").alias("canon")))
    return plain.select("field", "rec_id", "text", F.trim("text").alias("canon")).unionByName(repaired)


def alike_pairs(texts: DataFrame, **names) -> DataFrame:
    """(field, id_a, id_b): rows of one field, id_a < id_b, with one canonical form but unlike characters.

    Texts that are empty in their canonical form make no pairs. Rows that repeat one text make none among themselves: pairs
    are made of the distinct spellings of a form and then given their rows, first those of the rarer spelling. Rows of a
    spelling with many copies are joined by a broadcast, so they never meet in one task; only what comes out is joined.
    """
    canon = canonical_texts(texts, **names).where("canon <> ''")
    k1, k2 = fingerprint("field", "canon")
    rows = checkpointed(canon.select("field", "rec_id", k1, k2, F.xxhash64("text").alias("s1"), F.xxhash64(F.lit("s"), F.col("text")).alias("s2")))
    spellings = rows.groupBy("k1", "k2", "s1", "s2").agg(F.count("*").alias("n"))
    varied = checkpointed(spellings.join(spellings.groupBy("k1", "k2").agg(F.count("*").alias("forms")).where("forms > 1"), ["k1", "k2"], "left_semi"))
    one = varied.select("k1", "k2", F.struct("n", "s1", "s2").alias("few"))
    two = varied.select("k1", "k2", F.struct("n", "s1", "s2").alias("many"))
    pairs = checkpointed(one.join(two, ["k1", "k2"]).where("few < many").select("k1", "k2", F.col("few.s1").alias("a1"), F.col("few.s2").alias("a2"), F.col("few.n").alias("a_rows"), F.col("many.s1").alias("b1"), F.col("many.s2").alias("b2"), F.col("many.n").alias("b_rows")))
    key = ["k1", "k2", "a1", "a2"]
    half = join_groups(rows.select("field", "k1", "k2", F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("rec_id").alias("x")), pairs, key, "a_rows")
    half = half.select("k1", "k2", "b1", "b2", "b_rows", "x")
    if not varied.where(F.col("n") >= HOT_ROWS).isEmpty():
        half = checkpointed(half)
        whole = join_groups(rows.select("field", "k1", "k2", F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("rec_id").alias("y")), half, ["k1", "k2", "b1", "b2"], "b_rows")
    else:
        whole = rows.select("field", "k1", "k2", F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("rec_id").alias("y")).join(half, ["k1", "k2", "b1", "b2"])
    return whole.where("x <> y").select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
