"""SQL texts of the catalogue's queries for DuckDB, built from the same pieces as the column functions."""

from __future__ import annotations

from sparklex.functions import text as T

SPACE = T.SPACE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def low(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def fold(x: str) -> str:
    return low(norm(x))


def tokens(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


def strip(x: str) -> str:
    return f"trim({x}, {q(T.STRIP)})"


def cores(x: str) -> str:
    return f"list_filter(list_transform({tokens(x)}, lambda t: lower({strip('t')})), lambda t: t <> '')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def thinking(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '(?s)<think>.*?</think>', '', 'g'))"


def tagged(x: str, tag: str, inside: str = "[^\\n]") -> str:
    return trim(f"regexp_extract({thinking(x)}, '(?s)<{tag}>({inside}*?)</{tag}>', 1)")


def lot(seed: str, *cols: str) -> str:
    parts = ", ".join([q(seed), *[f"cast({c} as varchar)" for c in cols]])
    return f"cast(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8)) as bigint)"


def lot_of(text: str) -> str:
    """The lot of a text: the first 32 bits of its md5."""
    return f"cast(('0x' || substr(md5({text}), 1, 8)) as bigint)"


def unit(seed: str, *cols: str) -> str:
    return f"({lot(seed, *cols)} / 4294967296.0::double)"


def options(x: str, separator: str = ". ") -> str:
    return f"array_to_string(list_transform(list_sort(list_transform(map_entries({x}), lambda e: {{'k': try_cast(e.key as integer), 'v': e.value}})), lambda e: cast(e.k as varchar) || {q(separator)} || e.v), chr(10))"


def quoted(word: str, sentence: str) -> str:
    return "(" + " or ".join(f"contains({sentence}, {q(m)} || {word}) or contains({sentence}, {word} || {q(m)})" for m in T.QUOTES) + ")"


def lines(s: str) -> str:
    """A text with line ends as a SQL expression."""
    return " || chr(10) || ".join(q(x) for x in s.split("\n"))


SENTENCES = f"""select doc_id, pos - 1 as pos, {norm('piece')} as sentence from (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as pos from (select doc_id, regexp_split_to_array(text, '[.!?\\n]+') as p from documents where text is not null)) where {norm('piece')} <> ''"""
PASSAGES = f"select distinct {norm('piece')} as text from (select unnest(regexp_split_to_array(text, '[.!?\\n]+')) as piece from eval_passages where text is not null) where {norm('piece')} <> ''"
HELD_OUT = f"select distinct {norm('question')} as text from mr_items where {norm('question')} <> '' union select distinct {norm('piece')} from (select unnest(regexp_split_to_array(question, '[.!?\\n]+')) as piece from mr_items where question is not null) where {norm('piece')} <> ''"
POOL = f"""select coalesce(lang, '') as direction, doc_id * 100000 + i - 1 as row_idx, s[i] as src, s[i + 1] as tgt from (select doc_id, lang, s, unnest(generate_series(1, len(s) - 1)) as i from (select doc_id, lang, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: {norm('x')}), lambda x: x <> '') as s from documents where text is not null) where len(s) > 1)"""
UNIGRAMS = f"select token, count(*) as cnt from (select unnest({cores('text')}) as token from documents) where regexp_matches(token, '^\\p{{L}}+$') group by token"
BIGRAMS = f"select t[i] as \"left\", t[i + 1] as \"right\", count(*) as cnt from (select t, unnest(generate_series(1, len(t) - 1)) as i from (select {cores('text')} as t from documents) where len(t) > 1) group by 1, 2"
VOCAB = f"select token, count(*) as cnt from (select unnest({cores('input_sentence')}) as token from sc_gc_items) where regexp_matches(token, '^\\p{{L}}+$') group by token"
