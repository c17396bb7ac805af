"""The queries of the core operators over the test tables, each with its SQL where SQL can state it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.functions import arrow
from sparklex.functions import text as T
from sparklex.operators import assign, candidates, decide, lexicon, mix, package, pool, retrieval, stats, synth
from sparklex.plans import pipelines
from sparklex.plans import sql as S
from sparklex.plans.config import DEFAULTS
from sparklex.runtime import checkpointed, table

SEED = "42"
MAPS = ("nń", "sšś", "cčć", "rřŕ", "zžź", "oó", "eě", "lł")
SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    importlib.import_module("sparklex.plans.pipeline_queries")  # adds its own
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    more = importlib.import_module("sparklex.plans.pipeline_queries")
    return SQL | {"wrong_endings": more.WRONG_ENDINGS, "calibrated_errors": more.CALIBRATED, "word_candidates": more.WORD_CANDIDATES, "null_margin_argmax": more.ARGMAX, "constrained_corrections": more.CONSTRAINED, "typos": more.TYPOS, "cloze_questions": more.CLOZE}


# Pools


def _pool(spark, d):
    pieces = F.filter(F.transform(F.split("text", "[.!?\\n]+"), lambda x: T.norm(x)), lambda x: x != "")
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("direction"), pieces.alias("s")).where("size(s) > 1")
    pairs = rows.select("direction", "doc_id", F.posexplode(F.expr("transform(sequence(1, size(s) - 1), i -> struct(s[i - 1] as src, s[i] as tgt))")).alias("i", "p"))
    return pairs.select("direction", (F.col("doc_id") * 100000 + F.col("i")).alias("row_idx"), "p.src", "p.tgt")


def _passages(spark, d):
    parts = pool.split_sentences(table(spark, d, "eval_passages"), "item_id", "text")
    return parts.select(F.col("sentence").alias("text")).distinct()


def _held_out(spark, d):
    items = table(spark, d, "mr_items")
    parts = pool.split_sentences(items, "item_key", "question").select(F.col("sentence").alias("text"))
    return pool.union_blocklists([pool.blocklist(items, ["question"]), parts])


_CLEAN = f"select * from ({S.POOL}) p where src not in ({S.PASSAGES}) and tgt not in ({S.PASSAGES})"


@query(f"select direction, row_idx, src, tgt from (select *, row_number() over (partition by direction order by row_idx) as rn from ({_CLEAN})) where rn <= 60000")
def decontaminated_pool(spark, d):
    """Adjacent sentences of documents, neither of them in a held-out passage, capped by direction."""
    return pool.build_pool(_pool(spark, d), _passages(spark, d))


@query(f"select * from ({_CLEAN}) where src not in ({S.HELD_OUT})")
def leave_one_out(spark, d):
    """The clean pool without sources that are held-out questions."""
    return pool.leave_one_out(pool.decontaminate(_pool(spark, d), _passages(spark, d)), _held_out(spark, d))


@query(f"""with p as ({S.POOL}), b as ({S.PASSAGES}), h as ({S.HELD_OUT}), m as (select direction, src in (select text from b) or tgt in (select text from b) as t, src in (select text from h) as h from p),
c as (select direction, count(*) as pool_original, count(*) filter (where t) as removed_by_test_dedup, count(*) filter (where h and not t) as removed_by_dev_exclusion, count(*) filter (where not h and not t) as kept from m group by direction)
select direction, pool_original, removed_by_test_dedup, removed_by_dev_exclusion, kept - least(kept, 1000) as removed_by_cap, least(kept, 1000) as shipped, cast(0 as bigint) as residual_test_material from c""")  # fmt: skip
def pool_funnel(spark, d):
    """what each step removes, and what test material is left."""
    return pool.funnel(_pool(spark, d), _passages(spark, d), _held_out(spark, d), cap=1000)


@query(f"select distinct coalesce(nullif({S.norm('input_sentence')}, ''), nullif({S.norm('original_sentence')}, '')) as text from sc_gc_items where coalesce(nullif({S.norm('input_sentence')}, ''), nullif({S.norm('original_sentence')}, '')) is not null")
def blocklist_fields(spark, d):
    """The first filled field of each row."""
    return pool.blocklist(table(spark, d, "sc_gc_items"), ["source", "input_sentence", "original_sentence"])


@query(f"select min(doc_id) as doc_id from documents group by {S.fold('text')}")
def first_seen_documents(spark, d):
    """D3: the first document of each text, apart from white space and case."""
    return pool.dedup_texts(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


@query(f"select doc_id, pos, cast(len({S.tokens('sentence')}) as bigint) as n_tokens from ({S.SENTENCES}) where len({S.tokens('sentence')}) between 3 and 40")
def length_filter(spark, d):
    """Sentences of 3 to 40 tokens."""
    return pool.split_sentences(table(spark, d, "documents"), "doc_id", "text").where(T.length_ok("sentence")).select("doc_id", "pos", T.token_count("sentence").alias("n_tokens"))


_UNQUOTED = "regexp_replace(sentence, '^\"+|\"+$', '', 'g')"


@query(f"select doc_id, pos from ({S.SENTENCES}) where len({S.tokens(_UNQUOTED)}) between 5 and 40 and regexp_matches({_UNQUOTED}, '^\\p{{Lu}}')")
def mono_filter(spark, d):
    """Sentences of 5 to 40 tokens that begin with a capital, outer quotation marks apart."""
    bare = T.unquoted("sentence")
    return pool.split_sentences(table(spark, d, "documents"), "doc_id", "text").where(T.length_ok(bare, 5, 40) & T.is_upper(bare)).select("doc_id", "pos")


@query(f"""with u as (select 0 as source_rank, item_key as ord, {S.norm('original_sentence')} as text from sc_gc_items union all select 1, pred_id, {S.norm('source')} from mt_preds),
k as (select *, {S.low('text')} as key from u where len({S.tokens('text')}) between 3 and 40)
select source_rank, ord, text from (select *, row_number() over (partition by key order by source_rank, ord) as rn from k) where rn = 1""")  # fmt: skip
def ranked_sources(spark, d):
    """A4, H1: sources from the best to the worst, each text once."""
    a = table(spark, d, "sc_gc_items").select(F.col("item_key").alias("ord"), F.col("original_sentence").alias("text"))
    b = table(spark, d, "mt_preds").select(F.col("pred_id").alias("ord"), F.col("source").alias("text"))
    return pool.ranked_union([a, b], "text", "ord")


@query("select d.doc_id, p.item_id from documents d join eval_passages p on contains(d.text, p.text)")
def passages_contained(spark, d):
    """Documents that hold a whole passage as it is; the passages are a fixed set, read in one block."""
    rows = [(r["item_id"], r["text"]) for r in table(spark, d, "eval_passages").where("text is not null").select("item_id", "text").toLocalIterator()]
    held = F.filter(F.array(*[F.struct(F.lit(i).cast("long").alias("item_id"), F.lit(t).alias("t")) for i, t in rows]), lambda p: F.contains(F.col("text"), p["t"]))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(held).alias("p")).select("doc_id", "p.item_id")


# Statistics


@query(S.UNIGRAMS)
def unigram_counts(spark, d):
    """F1."""
    return stats.unigrams(table(spark, d, "documents"), "text")


@query(f"with u as ({S.UNIGRAMS}) select token, cnt, round(ln((cnt + 0.5) / (select sum(cnt) from u)), 6) as logp from u")
def unigram_logp(spark, d):
    """F1 with the corpus prior."""
    return stats.unigram_logp(stats.unigrams(table(spark, d, "documents"), "text")).withColumn("logp", F.round("logp", 6))


@query(S.BIGRAMS)
def bigram_counts(spark, d):
    """F2."""
    return stats.bigrams(table(spark, d, "documents"), "text")


_WITNESS = f"""with b as ({S.BIGRAMS}), i as (select item_key, incorrect_word as o, correct_word as c, list_transform({S.tokens('input_sentence')}, lambda t: lower({S.strip('t')})) as l from sc_gc_items where split = 'dev' and coalesce(incorrect_word, '') not in ('', 'CORRECT') and coalesce(correct_word, '') <> ''),
n as (select *, list_position(l, lower(o)) as pl from i), m as (select item_key, lower(o) as o, lower(c) as c, case when pl > 1 then l[pl - 1] end as lw, case when pl > 0 then l[pl + 1] end as rw from n),
w as (select item_key, 1 as s, lw as "left", c as "right" from m union all select item_key, 1, c, rw from m union all select item_key, -1, lw, o from m union all select item_key, -1, o, rw from m),
x as (select item_key, sum(s * ln(coalesce(cnt, 0) + 0.5)) as w from w left join b using ("left", "right") where "left" <> '' and "right" <> '' group by item_key)
select item_key, round(coalesce(x.w, 0), 6) + 0.0 as witness from sc_gc_items left join x using (item_key) where split = 'dev'"""


@query(_WITNESS)
def witness_score(spark, d):
    """How much better the bigrams of the corpus attest the correct word."""
    rows = table(spark, d, "sc_gc_items").where("split = 'dev'").select(F.col("item_key").alias("item_id"), F.col("input_sentence").alias("sentence"), F.col("incorrect_word").alias("observed"), F.col("correct_word").alias("candidate"))
    out = stats.witness(rows, stats.bigrams(table(spark, d, "documents"), "text"))
    return out.select(F.col("item_id").alias("item_key"), (F.round("witness", 6) + 0.0).alias("witness"))


_STOP = ", ".join(S.q(w) for w in T.STOPWORDS)


_FREQUENT = f"select token, count(*) as cnt, min(doc_id) as first_seen from (select doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) as token from documents where text is not null) where regexp_matches(token, '^\\p{{L}}+$') and length(token) >= 4 and lower(token) not in ({_STOP}) group by token order by cnt desc, first_seen, token limit 5000"


@query(_FREQUENT)
def frequent_vocab(spark, d):
    """The commonest salient words."""
    return stats.frequency_vocab(table(spark, d, "documents"), "text", "doc_id")


_PREFIX = "case when least(length(correct_word), length(incorrect_word)) > 0 then len(list_filter(generate_series(1, least(length(correct_word), length(incorrect_word))), lambda i: substr(correct_word, 1, i) = substr(incorrect_word, 1, i))) else 0 end"


@query(f"select substr(correct_word, p + 1) as removed, substr(incorrect_word, p + 1) as added, count(*) as cnt from (select *, cast({_PREFIX} as bigint) as p from sc_gc_items where incorrect_word <> 'CORRECT' and correct_word is not null and try_cast(id as bigint) % 2 = 0) where p >= 2 group by 1, 2")
def suffix_taxonomy(spark, d):
    """Endings that stand for others, from the even half."""
    return stats.suffix_taxonomy(stats.learning_half(table(spark, d, "sc_gc_items"), "id"), "incorrect_word", "correct_word")


@query("select count(*) as items, round(avg((incorrect_word = 'CORRECT')::int), 6) as clean_rate from sc_gc_items where incorrect_word is not null and try_cast(id as bigint) % 2 = 0")
def clean_rate(spark, d):
    """the share of items without an error."""
    return stats.clean_rate(stats.learning_half(table(spark, d, "sc_gc_items"), "id"), "incorrect_word").withColumn("clean_rate", F.round("clean_rate", 6))


@query("select mixture as component, count(*) as rows, round(count(*) / sum(count(*)) over (), 6) as share from training group by mixture")
def mixture_shares(spark, d):
    """F13."""
    return stats.mixture_shares(table(spark, d, "training"), "mixture").withColumn("share", F.round("share", 6))


@query("select 'low' as tier, count(*) filter (where coalesce(id, '') not like 'medium%') as rows from mr_items union all select 'medium', count(*) filter (where id like 'medium%') from mr_items")
def tier_counts(spark, d):
    """F7, C15."""
    return stats.tier_counts(table(spark, d, "mr_items"), "id")


@query("select item_key, tier, question from (select *, case when id like 'medium%' then 'medium' else 'low' end as tier, row_number() over (partition by id like 'medium%' order by item_key) as n from mr_items where split = 'dev' and question is not null and answer is not null) where n <= 3")
def tier_exemplars(spark, d):
    """The first three solved questions of each tier."""
    dev = table(spark, d, "mr_items").where("split = 'dev' and question is not null and answer is not null")
    return stats.tier_exemplars(dev, "id", "item_key").select("item_key", "tier", "question")


@query("select cast(direction as varchar) as stage, count(*) as rows, count(*) filter (where trim(coalesce(pred, '')) = '') as empty from mt_preds group by 1")
def empty_predictions(spark, d):
    """rows and empty predictions by direction."""
    return stats.fire_counts(table(spark, d, "mt_preds"), "direction", "pred")


# Lexicon and candidates


def _vocab(spark, d):
    return stats.unigrams(table(spark, d, "sc_gc_items"), "input_sentence")


_GROUPS = ", ".join(S.q(m) for m in MAPS)
_VARIANTS = f"select distinct w as word, substr(w, 1, i - 1) || substr(g, j, 1) || substr(w, i + 1) as variant from (select w, i, g, unnest(generate_series(1, length(g))) as j from (select w, i, unnest([{_GROUPS}]) as g from (select w, unnest(generate_series(1, length(w))) as i from (select token as w from v))) where contains(g, substr(w, i, 1))) where substr(g, j, 1) <> substr(w, i, 1)"


@query(f"with v as ({S.VOCAB}) {_VARIANTS}")
def diacritic_variants(spark, d):
    """J: words with one letter exchanged within its group."""
    return lexicon.diacritic_variants(_vocab(spark, d).select(F.col("token").alias("word")), list(MAPS))


# DuckDB's levenshtein counts bytes, so one edit is stated by what single deletions leave.
_ONE = "d as (select token as w, i, substr(token, 1, i - 1) || substr(token, i + 1) as rest from (select token, unnest(generate_series(1, length(token))) as i from v)), e as (select w as a, rest as b from d join v on rest = token union select rest, w from d join v on rest = token union select x.w, y.w from d x join d y on x.rest = y.rest and x.i = y.i and x.w <> y.w)"


@query(f"with v as ({S.VOCAB}), {_ONE} select a as word, b as match, cast(1 as bigint) as distance from e union all select token, token, 0 from v")
def within_one_edit(spark, d):
    """All pairs of words within one edit; `word_candidates` takes two for unknown words."""
    words = _vocab(spark, d).select(F.col("token").alias("word"))
    return lexicon.within_edits(words, words, 1)


def _forms(spark, d):
    return _vocab(spark, d).where("length(token) >= 5").select(F.substring("token", 1, 4).alias("lemma_idx"), F.col("token").alias("form"))


@query(f"""with v as ({S.VOCAB}), f as (select substr(token, 1, 4) as l, token as form from v where length(token) >= 5), w as (select distinct incorrect_word as word from sc_gc_items where incorrect_word is not null),
e as (select word, l from w join f on word = form), x as (select * from e union select word, l from w join f on lower(word) = form where word not in (select word from e)),
r as (select distinct word, form from x join f using (l) where word <> form) select word, form from (select *, row_number() over (partition by word order by form) as n from r) where n <= 60""")  # fmt: skip
def paradigm_forms(spark, d):
    """Other forms of a word's lemmas."""
    words = table(spark, d, "sc_gc_items").where("incorrect_word is not null").select(F.col("incorrect_word").alias("word"))
    return lexicon.paradigm(words, _forms(spark, d))


@query(f"with v as ({S.VOCAB}), k as (select token from v where cnt >= 5), w as (select distinct incorrect_word as word from sc_gc_items where incorrect_word is not null) select word, word in (select token from k) or lower(word) in (select token from k) as known from w")
def known_words(spark, d):
    """Words that a lexicon has as they are or in small letters."""
    index = _vocab(spark, d).where("cnt >= 5").select(F.col("token").alias("form"))
    return lexicon.known_words(table(spark, d, "sc_gc_items").where("incorrect_word is not null").select(F.col("incorrect_word").alias("word")).distinct(), index)


@query(f"""with v as ({S.VOCAB}), k as (select token from v where cnt >= 5), {_ONE}, c as ({_VARIANTS} union select a, b from e),
r as (select word, variant as candidate, coalesce(cnt, 0) as cnt, row_number() over (partition by word order by coalesce(cnt, 0) desc, variant) as rank from c left join v on lower(variant) = token where word <> variant and (variant in (select token from k) or lower(variant) in (select token from k)))
select * from r where rank <= 24""")  # fmt: skip
def ranked_candidates(spark, d):
    """H4, G2 in part, as its SQL states it: diacritic variants and words within one edit that the lexicon knows, ranked by
    frequency. The whole union is `word_candidates`."""
    vocab = _vocab(spark, d)
    words = vocab.select(F.col("token").alias("word"))
    sources = [lexicon.diacritic_variants(words, list(MAPS)).withColumnRenamed("variant", "candidate"), lexicon.within_edits(words, words, 1).withColumnRenamed("match", "candidate")]
    return candidates.rank_candidates(sources, vocab, vocab.where("cnt >= 5").select(F.col("token").alias("form")))


_EDITED = f"""select item_key, pos, word, array_to_string(list_concat(t[:pos], [substr(t[pos + 1], 1, strpos(t[pos + 1], word) - 1) || lower(word) || substr(t[pos + 1], strpos(t[pos + 1], word) + length(word))], t[pos + 2:]), ' ') as variant
from (select item_key, t, unnest(generate_series(0, len(t) - 1)) as pos, {S.strip('t[pos + 1]')} as word from (select item_key, {S.tokens('input_sentence')} as t from sc_gc_items))
where regexp_matches(word, '^\\p{{L}}+$') and length(word) >= 3 and word <> lower(word)"""


@query(_EDITED)
def single_edit_variants(spark, d):
    """C11: each sentence with one capital word in small letters."""
    items = table(spark, d, "sc_gc_items").select(F.col("item_key").alias("item_id"), F.col("input_sentence").alias("sentence"))
    cores = candidates.sentence_cores(items).where("core <> lower(core)")
    cand = cores.select(F.col("core").alias("word"), F.lower("core").alias("candidate"), F.lit(1).cast("long").alias("rank")).distinct()
    return candidates.single_edit_variants(items, cand).select(F.col("item_id").alias("item_key"), "pos", "word", "variant")


def _dev(spark, d):
    return table(spark, d, "sc_gc_items").where("split = 'dev'").select(F.col("item_key").alias("item_id"), F.col("input_sentence").alias("sentence"), "incorrect_word", "correct_word", "task")


def _sentences(spark, d):
    return table(spark, d, "sc_gc_items").select(F.col("item_key").alias("item_id"), F.col("input_sentence").alias("sentence"), "task")


def _of_task(rows, task):
    return rows.where(F.col("task") == "gc" if task == "gc" else F.coalesce(F.col("task"), F.lit("")) != "gc")


def _words(rows, task):
    return candidates.sentence_cores(_of_task(rows, task)).select(F.col("core").alias("word")).distinct()


def _word_candidates(words, vocab, task):
    """All of H4 for the words of a task. The lexicon is the words seen five times; longer ones that begin alike share a lemma."""
    lemma = F.when(F.length("token") >= 5, F.substring("token", 1, 4)).otherwise(F.concat(F.lit("="), "token"))
    forms = vocab.where("cnt >= 5").select(lemma.alias("lemma_idx"), F.col("token").alias("form"))
    return checkpointed(pipelines.word_candidates(words, forms, list(MAPS), vocab, task, DEFAULTS[f"{task}_paradigm_cap"]))


@query()
def word_candidates(spark, d):
    """Every candidate of every word of a task's sentences: diacritics, one edit (two for unknown words) and, for
    unknown words, paradigms; paradigms for grammar."""
    vocab = checkpointed(_vocab(spark, d))
    parts = [_word_candidates(_words(_sentences(spark, d), task), vocab, task).withColumn("task", F.lit(task)) for task in ("sc", "gc")]
    return parts[0].unionByName(parts[1])


@query()
def null_margin_argmax(spark, d):
    """The best single edit against the unchanged sentence, by the bigram stand-in for a language model; every
    word of every sentence is tried with the candidates of its task."""
    docs = table(spark, d, "documents")
    vocab = checkpointed(_vocab(spark, d))
    score = candidates.bigram_scorer(checkpointed(stats.unigrams(docs, "text")), checkpointed(stats.bigrams(docs, "text")))
    parts = []
    for task in ("sc", "gc"):
        rows = _dev(spark, d)
        parts.append(candidates.best_edit(_of_task(rows, task), _word_candidates(_words(rows, task), vocab, task), score))
    return parts[0].unionByName(parts[1]).withColumn("margin", F.round("margin", 6))


@query()
def constrained_corrections(spark, d):
    """The flagged word kept, its best replacement chosen among all candidates of its task."""
    docs = table(spark, d, "documents")
    vocab = checkpointed(_vocab(spark, d))
    flagged = _dev(spark, d).where("incorrect_word <> 'CORRECT'").select("item_id", "sentence", F.col("incorrect_word").alias("word"), F.col("correct_word").alias("correction"), "task")
    score = candidates.bigram_scorer(checkpointed(stats.unigrams(docs, "text")), checkpointed(stats.bigrams(docs, "text")))
    parts = []
    for task in ("sc", "gc"):
        rows = _of_task(flagged, task)
        parts.append(candidates.constrained_correction(rows, _word_candidates(rows.select("word").distinct(), vocab, task), score))
    return parts[0].unionByName(parts[1])


# Decisions


_DECISIONS = "select item_key, case when item_key % 3 = 0 then 'CORRECT' else incorrect_word end as v5_w, correct_word as eng_c, case when item_key % 4 = 0 then null else incorrect_word end as eng_w, incorrect_word as co_w, upper(correct_word) as co_c, (item_key % 100) / 100.0::double as margin, (item_key % 7)::double as witness from sc_gc_items where split = 'dev'"


def _decisions(spark, d):
    key = F.col("item_key")
    return table(spark, d, "sc_gc_items").where("split = 'dev'").select(
        "item_key", F.when(key % 3 == 0, "CORRECT").otherwise(F.col("incorrect_word")).alias("v5_w"), F.col("correct_word").alias("v5_c"), F.when(key % 4 != 0, F.col("incorrect_word")).alias("eng_w"), F.col("correct_word").alias("eng_c"),
        F.col("incorrect_word").alias("co_w"), F.upper("correct_word").alias("co_c"), (key % 100 / F.lit(100.0)).alias("margin"), (key % 7).cast("double").alias("witness"),
    )


@query(f"""select item_key, coalesce(nullif(case when coalesce(v5_w, '') not in ('', 'CORRECT') and coalesce(eng_w, '') = v5_w and coalesce(eng_c, '') <> '' then v5_w when coalesce(v5_w, '') not in ('', 'CORRECT') then co_w when margin + 0.1 * witness >= 0.42 then eng_w else 'CORRECT' end, ''), 'CORRECT') as word,
coalesce(nullif(case when coalesce(v5_w, '') not in ('', 'CORRECT') and coalesce(eng_w, '') = v5_w and coalesce(eng_c, '') <> '' then eng_c when coalesce(v5_w, '') not in ('', 'CORRECT') then co_c when margin + 0.1 * witness >= 0.42 then eng_c else 'CORRECT' end, ''), 'CORRECT') as corrected from ({_DECISIONS})""")  # fmt: skip
def arbitrated(spark, d):
    """L2: detector against engine."""
    return decide.arbitrate(_decisions(spark, d), 0.1, 0.42).select("item_key", "word", "corrected")


@query(f"select item_key, incorrect_word as word, correct_word as corrected from (select *, (item_key % 100) / 100.0::double as margin, {S.strip('coalesce(' + S.tokens('input_sentence') + '[1], chr(0))')} as first from sc_gc_items where split = 'dev') where coalesce(incorrect_word, '') not in ('', 'CORRECT') and margin >= 0.3 and not (regexp_matches(incorrect_word, '^\\p{{Lu}}') and incorrect_word <> first) and not coalesce({S.quoted('incorrect_word', 'input_sentence')}, false)")
def margin_topup(spark, d):
    """Corrections whose margin is high, but for proper names and quoted words."""
    rows = table(spark, d, "sc_gc_items").where("split = 'dev'").withColumn("m", decide.margin_topup("incorrect_word", "correct_word", F.col("item_key") % 100 / F.lit(100.0), "input_sentence", 0.3))
    return rows.where("m is not null").select("item_key", "m.word", "m.corrected")


_NONWORD = f"""with v as ({S.VOCAB}), k as (select token from v where cnt >= 5), s as (select item_key, {S.norm('input_sentence')} as s, unnest({S.tokens('input_sentence')}) as tok from sc_gc_items),
c as (select item_key, {S.strip('tok')} as word from s where length({S.strip('tok')}) >= 3 and not regexp_matches({S.strip('tok')}, '^\\p{{Lu}}') and not {S.quoted(S.strip('tok'), 's')}),
u as (select * from c where word not in (select token from k) and lower(word) not in (select token from k)),
f as (select word, variant, v.cnt from (select distinct w as word, substr(w, 1, i - 1) || substr(g, j, 1) || substr(w, i + 1) as variant from (select w, i, g, unnest(generate_series(1, length(g))) as j from (select w, i, unnest([{_GROUPS}]) as g from (select w, unnest(generate_series(1, length(w))) as i from (select distinct word as w from u))) where contains(g, substr(w, i, 1))) where substr(g, j, 1) <> substr(w, i, 1)) join v on lower(variant) = token where v.cnt >= 5),
b as (select word, variant from (select *, row_number() over (partition by word order by cnt desc, variant) as n from f) where n = 1)
select item_key, min(word) as word, min(variant) as corrected from u join b using (word) group by item_key having count(*) = 1"""


@query(_NONWORD)
def nonword_topup(spark, d):
    """The only unknown word of a sentence that a diacritic makes a frequent known one."""
    vocab = _vocab(spark, d)
    forms = vocab.where("cnt >= 5").select(F.lit(0).alias("lemma_idx"), F.col("token").alias("form"))
    sentences = table(spark, d, "sc_gc_items").select(F.col("item_key").alias("item_id"), F.col("input_sentence").alias("sentence"))
    return decide.nonword_topup(sentences, forms, vocab, list(MAPS), 5).select(F.col("item_id").alias("item_key"), "word", "corrected")


@query("select q.item_key, coalesce(cast(q.item_key % 5 as integer), 1) as pred from qa_items q where q.item_key % 10 = 0 union all select item_key, case when item_key % 7 between 1 and len(map_keys(possible_answers)) then cast(item_key % 7 as integer) else 1 end from qa_items where item_key % 10 <> 0")
def option_override(spark, d):
    """Valid options, with an override for some items."""
    rows = table(spark, d, "qa_items").select("item_key", T.valid_option((F.col("item_key") % 7).cast("int"), F.col("possible_answers")).alias("pred"))
    over = table(spark, d, "qa_items").where("item_key % 10 = 0").select("item_key", (F.col("item_key") % 5).cast("int").alias("pred"))
    return decide.override(rows, over, "item_key")


@query()
def slot_assignment(spark, d):
    """Blocks of twelve slots and sixteen options from the embeddings, each option once."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 12).alias("block"), (F.col("vec_id") % 12).alias("slot"), F.slice(F.col("embedding").cast("array<double>"), 1, 16).alias("scores"))
    return assign.assign_blocks(rows)


# Retrieval


@query(f"""with p as (select pred_id, {S.trim("coalesce(source, '')")} as s from mt_preds), c as (select pred_id, s, list_distinct(string_split(s, '')) as cs from p where s <> ''), q as (select pred_id as query_id, s as t, case when s = '' then [] else list_distinct(string_split(s, '')) end as cq from p where pred_id % 100 = 0),
m as (select query_id, pred_id as row_idx, len(list_intersect(cq, cs)) / greatest(len(cq), len(cs))::double as sim from q, c where t <> s)
select query_id, row_idx, round(sim, 6) as sim, rank from (select *, row_number() over (partition by query_id order by sim desc, row_idx) as rank from m where sim > 0) where rank <= 3""")  # fmt: skip
def char_similar(spark, d):
    """The rows most alike in their sets of characters, for every hundredth id."""
    preds = table(spark, d, "mt_preds").select(F.col("pred_id").alias("row_idx"), F.col("source").alias("src"))
    queries_ = preds.where("row_idx % 100 = 0").select(F.col("row_idx").alias("query_id"), F.col("src").alias("text"))
    return retrieval.char_similarity(queries_, preds, 3).withColumn("sim", F.round("sim", 6))


_NEAREST = "select query_id, row_idx, round(distance, 5) as distance, rank from (select q.vec_id as query_id, v.vec_id as row_idx, list_distance(q.embedding::double[], v.embedding::double[]) as distance, row_number() over (partition by q.vec_id order by list_distance(q.embedding::double[], v.embedding::double[]), v.vec_id) as rank from embeddings q, embeddings v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id) where rank <= 5"


@query(_NEAREST)
def nearest_vectors(spark, d):
    """The exact nearest vectors, for every hundredth id."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), "embedding")
    return retrieval.nearest_vectors(rows.where("row_idx % 100 = 0").withColumnRenamed("row_idx", "query_id"), rows, 5).withColumn("distance", F.round("distance", 5))


@query()
def clustered_vectors(spark, d):
    """The nearest vectors by the inverted index."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), "embedding")
    return retrieval.ClusterIndex(rows).search(rows.where("row_idx % 100 = 0").withColumnRenamed("row_idx", "query_id"), 5).withColumn("distance", F.round("distance", 5))


@query()
def fuzzy_answers(spark, d):
    """The answer of the most alike question of the dev split."""
    items = table(spark, d, "mr_items")
    dev = items.where("split = 'dev' and question is not null and answer is not null").select(F.col("item_key").alias("idx"), F.col("question").alias("text"), "answer")
    return retrieval.fuzzy_lookup(items.where("question is not null").select(F.col("item_key").alias("query_id"), F.col("question").alias("text")), dev)


# Rendering and extraction


@query(f"select pred_id, 'Translate the source text from German to Upper Sorbian' || chr(10) || chr(10) || 'German: ' || source || chr(10) || 'Upper Sorbian: ' || pred || chr(10) || 'German: ' || source || chr(10) || 'Upper Sorbian:' as prompt from mt_preds where direction = 'de-hsb' and source is not null and pred is not null")
def prompt_mt(spark, d):
    """C1."""
    rows = table(spark, d, "mt_preds").where("direction = 'de-hsb' and source is not null and pred is not null")
    return rows.select("pred_id", T.mt_prompt("source", "German", "Upper Sorbian", F.array(F.struct(F.col("source").alias("src"), F.col("pred").alias("tgt")))).alias("prompt"))


@query(f"select item_key, {S.lines(T.SC_INSTRUCTION)} || chr(10) || '<sentence> ' || input_sentence || ' </sentence>' as prompt from sc_gc_items where task = 'sc'")
def prompt_sc(spark, d):
    """C2."""
    return table(spark, d, "sc_gc_items").where("task = 'sc'").select("item_key", T.sc_gc_prompt("input_sentence", "sc").alias("prompt"))


@query(f"select item_key, {S.q(T.MR_INSTRUCTION)} || ' ' || question as prompt from mr_items")
def prompt_mr(spark, d):
    """C3."""
    return table(spark, d, "mr_items").select("item_key", T.mr_prompt("question").alias("prompt"))


@query(f"select item_key, {S.q(T.QA_INSTRUCTION)} || chr(10) || chr(10) || case when {S.trim("coalesce(context, '')")} <> '' then {S.trim("coalesce(context, '')")} || chr(10) else '' end || 'Question: ' || question || chr(10) || {S.options('possible_answers')} || chr(10) || 'Answer:' as prompt from qa_items")
def prompt_qa(spark, d):
    """C4, C5, G11."""
    return table(spark, d, "qa_items").select("item_key", T.qa_prompt("context", "question", "possible_answers").alias("prompt"))


@query(f"select item_key, coalesce(context, '') || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Possible answers:' || chr(10) || {S.options('possible_answers', ': ')} || chr(10) || chr(10) || 'Answer:' as user_content, '1' as assistant_content from qa_items")
def rendered_qa(spark, d):
    """C7."""
    chat = T.render_qa("context", "question", "possible_answers", F.lit(1))
    return table(spark, d, "qa_items").select("item_key", chat[0]["content"].alias("user_content"), chat[1]["content"].alias("assistant_content"))


@query(f"select item_key, {S.q(T.MR_INSTRUCTION)} || ' ' || question as user_content, '<answer> ' || answer || ' </answer>' as assistant_content from mr_items")
def rendered_mr(spark, d):
    """C8."""
    chat = T.render_mr("question", "answer")
    return table(spark, d, "mr_items").select("item_key", chat[0]["content"].alias("user_content"), chat[1]["content"].alias("assistant_content"))


@query("select item_key, '<wrong> ' || incorrect_word || ' </wrong> <corrected> ' || correct_word || ' </corrected>' as assistant_content from sc_gc_items where incorrect_word is not null and correct_word is not null")
def rendered_sc(spark, d):
    """C6."""
    rows = table(spark, d, "sc_gc_items").where("incorrect_word is not null and correct_word is not null")
    return rows.select("item_key", T.render_sc_gc("input_sentence", "incorrect_word", "correct_word", "sc")[1]["content"].alias("assistant_content"))


_REPLIES = "select row_id, pos, m.content as raw from (select row_id, unnest(messages) as m, generate_subscripts(messages, 1) as pos from training)"


@query(f"select row_id, pos, {S.tagged('raw', 'wrong')} as wrong, {S.tagged('raw', 'corrected')} as corrected, {S.tagged('raw', 'answer', '.')} as answer, coalesce(try_cast(nullif(regexp_extract(coalesce(raw, ''), '(-?\\d+)', 1), '') as integer), -1) as number from ({_REPLIES})")
def extracted_tags(spark, d):
    """J: tags and the first number of every message."""
    rows = table(spark, d, "training").select("row_id", F.posexplode("messages").alias("pos", "m")).select("row_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("m.content").alias("raw"))
    return rows.select("row_id", "pos", T.wrong_word("raw").alias("wrong"), T.corrected_word("raw").alias("corrected"), T.mr_answer("raw").alias("answer"), T.first_number("raw").alias("number"))


@query(f"select pred_id, {S.trim(S.thinking('pred'))} as translation from mt_preds")
def extracted_translation(spark, d):
    """J: the translation within its tag, or the whole text."""
    return table(spark, d, "mt_preds").select("pred_id", T.mt_translation(F.concat(F.lit("<think>a b</think> <hsb> "), F.coalesce("pred", F.lit("")), F.lit(" </hsb>")), "hsb").alias("translation"))


_GAPPED = "select item_key, question || ' co. II' as question, coalesce(context, '') || ' ( I ) a (II)  b ( III )' as context, possible_answers['1'] as o from qa_items where question is not null"


@query(f"select item_key, 'II' as gap, {S.trim("regexp_replace(replace(regexp_replace(regexp_replace(context, '\\(\\s*II\\s*\\)', chr(1), 'g'), '\\(\\s*([IVXLC]+)\\s*\\)', '', 'g'), chr(1), coalesce(o, '')), '\\s{2,}', ' ', 'g')")} as filled from ({_GAPPED})")
def filled_gaps(spark, d):
    """C13, J: the gap asked for, filled."""
    rows = table(spark, d, "qa_items").where("question is not null").select("item_key", F.concat("question", F.lit(" co. II")).alias("question"), F.concat(F.coalesce("context", F.lit("")), F.lit(" ( I ) a (II)  b ( III )")).alias("context"), F.try_element_at("possible_answers", F.lit("1")).alias("o"))
    return rows.withColumn("gap", T.target_gap("question")).select("item_key", "gap", T.fill_gap("context", "gap", "o").alias("filled"))


@query(f"select item_key, case when {S.trim("coalesce(answer, '')")} <> '' and id like 'medium%' and regexp_matches({S.trim("coalesce(answer, '')")}, '\\\\frac|\\\\sqrt|\\\\pi|\\\\geq|\\\\leq|\\\\cdot|\\\\times|[\\[(].*,.*[\\])]') and not ({S.trim("coalesce(answer, '')")} like '$%' and {S.trim("coalesce(answer, '')")} like '%$') then '$' || {S.trim("coalesce(answer, '')")} || '$' else {S.trim("coalesce(answer, '')")} end as answer from mr_items")
def formatted_answers(spark, d):
    """C14."""
    return table(spark, d, "mr_items").select("item_key", T.postformat("answer", T.tier_of("id")).alias("answer"))


@query(f"""with a as (select item_key, {S.trim("coalesce(answer, '')")} as a from mr_items union all select pred_id + 10000000, {S.trim("coalesce(pred, '')")} from mt_preds)
select item_key, regexp_full_match(a, '-?\\d[\\d,]*(\\.\\d+)?') or regexp_full_match(a, '-?\\d+\\s*/\\s*-?\\d+') or (a <> '' and length(a) <= 120 and regexp_full_match(a, '[0-9A-Za-z\\\\{{}}\\[\\]()+\\-*/.,;:=<>^_|!~ \\t°πφ√∞∪∩×÷±$]+') and (regexp_matches(a, '[\\\\{{}}\\[\\]()/^_=+<>|πφ√∞∪∩×÷±°]') or len(regexp_extract_all(a, '[A-Za-z]{{2,}}')) < 4)) as safe from a""")  # fmt: skip
def safe_answers(spark, d):
    """D7."""
    rows = table(spark, d, "mr_items").select("item_key", "answer").unionByName(table(spark, d, "mt_preds").select((F.col("pred_id") + 10000000).alias("item_key"), F.col("pred").alias("answer")))
    return rows.select("item_key", T.answer_is_safe("answer").alias("safe"))


@query(f"select pred_id, {S.trim("coalesce(pred, '')")} = '' or ({S.trim("coalesce(source, '')")} <> '' and {S.low(S.trim("coalesce(pred, '')"))} = {S.low(S.trim("coalesce(source, '')"))}) as degenerate from mt_preds")
def degenerate_preds(spark, d):
    """D8."""
    return table(spark, d, "mt_preds").select("pred_id", T.is_degenerate("pred", "source").alias("degenerate"))


@query("select item_key, case when regexp_full_match(replace(replace(answer, ',', ''), ' ', ''), '-?\\d+') then replace(replace(answer, ',', ''), ' ', '') end as answer, 'steps' as rationale from mr_items where answer is not null")
def parsed_seeds(spark, d):
    """A6, J: answers behind #### and rationales without calculator marks."""
    raw = F.concat(F.lit("steps<<1+1=2>>\n#### "), F.col("answer"))
    return table(spark, d, "mr_items").where("answer is not null").select("item_key", T.gsm_answer(raw).alias("answer"), T.gsm_rationale(raw).alias("rationale"))


@query("select item_key, trim(answer) as boxed from mr_items where answer is not null")
def boxed_answers(spark, d):
    """J: the last boxed answer with its braces balanced."""
    raw = F.concat(F.lit("so \\boxed{1} and \\boxed { "), F.col("answer"), F.lit(" } done"))
    return table(spark, d, "mr_items").where("answer is not null").select("item_key", arrow.boxed_answer(raw).alias("boxed"))


# Samples, splits, mixtures


@query(f"select doc_id, row_number() over (order by {S.lot(SEED, 'doc_id')}, doc_id) - 1 as rank from documents")
def shuffled_documents(spark, d):
    """Every document's place in a seeded order."""
    return mix.shuffled_rank(table(spark, d, "documents").select("doc_id"), SEED, "doc_id")


@query(f"select doc_id from documents order by {S.lot(SEED, 'doc_id')}, doc_id limit 100")
def seeded_sample(spark, d):
    """I1."""
    return mix.seeded_sample(table(spark, d, "documents").select("doc_id"), 100, SEED, "doc_id")


@query(f"select doc_id, row_number() over (order by {S.lot(SEED, 'doc_id')}, doc_id) <= (select count(*) // 2 from documents) as carrier from documents")
def carrier_mask(spark, d):
    """Exactly half of the rows."""
    return mix.carrier_mask(table(spark, d, "documents").select("doc_id"), SEED, "doc_id")


@query(f"select doc_id, case when rn <= 50 then 'pool' else 'train' end as part from (select doc_id, row_number() over (order by {S.lot(SEED, 'doc_id')}, doc_id) as rn from documents) where rn <= 450")
def train_pool_split(spark, d):
    """I6."""
    return mix.train_pool_split(table(spark, d, "documents").select("doc_id"), SEED, "doc_id", 50, 400)


@query("select item_key, case when row_number() over (order by item_key) <= greatest(1, (select count(*) // 10 from mr_items)) then 'pool' else 'train' end as part from mr_items")
def tenth_split(spark, d):
    """I7."""
    return mix.tenth_split(table(spark, d, "mr_items").select("item_key"), "item_key")


@query(f"select item_key, tier from (select item_key, tier, row_number() over (partition by tier order by {S.lot(SEED, 'item_key')}, item_key) as n from (select item_key, case when id like 'medium%' then 'medium' else 'low' end as tier from mr_items)) where n <= case tier when 'low' then 40 else 20 end")
def balanced_sample(spark, d):
    """I8, H5: so many rows of each tier."""
    return mix.balanced_sample(table(spark, d, "mr_items").select("item_key", T.tier_of("id").alias("tier")), SEED, "item_key", "tier", {"low": 40, "medium": 20})


def _pairs(spark, d):
    return table(spark, d, "mt_preds").where("direction is not null and source is not null and pred is not null").select("direction", F.col("pred_id").alias("row_idx"), F.col("source").alias("src"), F.col("pred").alias("tgt"))


_PAIRS = "select direction, pred_id as row_idx, source as src, pred as tgt from mt_preds where direction is not null and source is not null and pred is not null"
_EXEMPLARS = f"""with p as ({_PAIRS}), n as (select *, row_number() over (partition by direction order by {S.lot('pool', 'row_idx')}, row_idx) - 1 as no, count(*) over (partition by direction) as k from p),
x as (select a.direction, a.row_idx, a.src, a.tgt, case when b.src = a.src and a.k > 1 then c.src else b.src end as x_src, case when b.src = a.src and a.k > 1 then c.tgt else b.tgt end as x_tgt from n a join n b on a.direction = b.direction and b.no = {S.lot(SEED, 'a.row_idx')} % a.k join n c on a.direction = c.direction and c.no = {S.lot(SEED + "'", 'a.row_idx')} % a.k)"""


@query(f"{_EXEMPLARS} select direction, row_idx, x_src, x_tgt from x")
def random_exemplars(spark, d):
    """I4."""
    return mix.random_exemplars(_pairs(spark, d), _pairs(spark, d), SEED).select("direction", "row_idx", F.col("exemplar.src").alias("x_src"), F.col("exemplar.tgt").alias("x_tgt"))


@query(f"""{_EXEMPLARS}, v as (select *, row_number() over (partition by direction order by row_idx) <= 5 as val from x), t as (select *, case when val then false else row_number() over (partition by direction, val order by {S.lot(SEED, 'row_idx')}, row_idx) <= count(*) over (partition by direction, val) // 2 end as carrier from v),
e as (select t.*, comp from t, (select unnest(['comp0', 'compfz', 'comprd']) as comp))
select comp, case when val then 'validation' else 'training' end as split, direction, row_idx, 'Translate the source text from German to Upper Sorbian' || chr(10) || chr(10) || case when carrier and comp = 'comprd' then 'German: ' || x_src || chr(10) || 'Upper Sorbian: ' || x_tgt || chr(10) else '' end || 'German: ' || src || chr(10) || 'Upper Sorbian:' as user_content, tgt as assistant_content from e""")  # fmt: skip
def composition_rows(spark, d):
    """I5, C9 in part, as its SQL states it: the same rows in three compositions, compfz without its exemplars. The whole is
    `fuzzy_composition_rows`."""
    pairs = mix.random_exemplars(_pairs(spark, d), _pairs(spark, d), SEED).withColumnRenamed("exemplar", "random").withColumn("fuzzy", F.lit(None).cast("struct<src:string,tgt:string>"))
    rows = mix.compositions(pairs, SEED, 5, F.lit("German"), F.lit("Upper Sorbian"))
    return rows.select("comp", "split", "direction", "row_idx", F.col("messages")[0]["content"].alias("user_content"), F.col("messages")[1]["content"].alias("assistant_content"))


@query()
def fuzzy_composition_rows(spark, d):
    """The same rows in three compositions, those of compfz with the most alike other pair of the direction."""
    pairs, keys = _pairs(spark, d), ["direction", "row_idx"]
    split = checkpointed(mix.carriers(pairs.select(*keys), SEED, 5))
    asked = split.where("carrier").select(*keys)  # the others get no exemplar
    near = retrieval.fuzzy_exemplars(pairs, asked)
    named = pairs.select(*keys, F.unhex(F.md5("src")).alias("src"), F.col("row_idx").alias("tgt"))
    lots = mix.random_exemplars(asked.join(named, keys), named, SEED).select(*keys, F.col("exemplar.tgt").alias("near"))
    for name, rows in (("fuzzy", near), ("random", lots)):
        texts = rows.withColumnRenamed("row_idx", "_row").join(pairs.withColumnRenamed("row_idx", "near"), ["direction", "near"])
        split = split.join(texts.select("direction", F.col("_row").alias("row_idx"), F.struct("src", "tgt").alias(name)), keys, "left")
    rows = mix.compositions(pairs.join(split, keys), SEED, 5, F.lit("German"), F.lit("Upper Sorbian"))
    return rows.select("comp", "split", "direction", "row_idx", F.col("messages")[0]["content"].alias("user_content"), F.col("messages")[1]["content"].alias("assistant_content"))


@query("select 'items' as component, dataset_id, arrived_at from mr_items union all select 'questions', dataset_id, arrived_at from qa_items")
def mixture_rows(spark, d):
    """H6: components in their common columns."""
    return mix.mixture({"items": table(spark, d, "mr_items").select("dataset_id", "arrived_at", "answer"), "questions": table(spark, d, "qa_items").select("dataset_id", "arrived_at", "context")})


# Synthesis


def _originals(spark, d):
    return table(spark, d, "sc_gc_items").where("split = 'dev'").select("item_key", F.col("original_sentence").alias("text"))


@query()
def typos(spark, d):
    """I9 to I12."""
    return synth.inject_typos(_originals(spark, d), "text", "item_key", SEED)


@query()
def wrong_endings(spark, d):
    """Each sentence with the endings of its own language."""
    rows = table(spark, d, "sc_gc_items").where("split = 'dev'").select("item_key", F.col("original_sentence").alias("text"), F.lower(F.trim("lang")).alias("lang"))
    dsb = F.coalesce(F.col("lang") == "dsb", F.lit(False))
    return synth.inject_endings(rows.where(~dsb), "text", "item_key", "hsb", SEED).unionByName(synth.inject_endings(rows.where(dsb), "text", "item_key", "dsb", SEED))


@query()
def cloze_questions(spark, d):
    """I14, I15, C17."""
    vocabulary = [r["token"] for r in stats.frequency_vocab(table(spark, d, "documents"), "text", "doc_id").collect()]
    made = synth.cloze(_originals(spark, d), "text", "item_key", vocabulary, SEED)
    return made.select("item_key", "context", "question", F.array_join(F.map_values("possible_answers"), " | ").alias("options"), "correct_answer_num", "answer_text")


@query()
def calibrated_errors(spark, d):
    """Learned wrong endings of known words."""
    items = table(spark, d, "sc_gc_items")
    transforms = stats.suffix_taxonomy(stats.learning_half(items, "id"), "incorrect_word", "correct_word")
    index = stats.unigrams(table(spark, d, "documents"), "text").select(F.col("token").alias("form"))
    return synth.calibrated_corruption(_originals(spark, d), "text", "item_key", transforms, index, SEED)


@query("select count(*) as rows, count(*) as clean, cast(0 as bigint) as errors, 0.0::double as error_share from sc_gc_items where split = 'dev'")
def synthesis_meta(spark, d):
    """counts of a run without errors."""
    return synth.synthesis_meta(synth.inject_typos(_originals(spark, d), "text", "item_key", SEED, 0.0))


# Packaging


_SC_ROWS = "select dataset_id, id, input_sentence, case when coalesce(incorrect_word, '') = '' then 'CORRECT' else incorrect_word end as pred_incorrect, case when coalesce(correct_word, '') = '' then 'CORRECT' else correct_word end as pred_corrected"


@query(f"{_SC_ROWS} from sc_gc_items where task = 'sc'")
def packaged_sc(spark, d):
    """Fields in their order, defaults for missing predictions."""
    rows = table(spark, d, "sc_gc_items").where("task = 'sc'").withColumns({"pred_incorrect": F.col("incorrect_word"), "pred_corrected": F.col("correct_word")})
    return package.package_rows(rows, "sc")


@query("select dataset_id, question_id, question, cast(item_key % 4 as integer) as pred from qa_items")
def packaged_qa(spark, d):
    """B1: an option is a whole number."""
    return package.package_rows(table(spark, d, "qa_items").withColumn("pred", (F.col("item_key") % 4).cast("string")), "qa")


@query(f"{_SC_ROWS}, case lang when 'hsb' then 0 else 1 end as bucket from sc_gc_items where task = 'gc' and lang in ('hsb', 'dsb')")
def bundled_gc(spark, d):
    """The parts of a task in the bundle's order."""
    rows = table(spark, d, "sc_gc_items").where("task = 'gc'").withColumns({"pred_incorrect": F.col("incorrect_word"), "pred_corrected": F.col("correct_word")})
    return package.bundle({lang: package.package_rows(rows.where(F.col("lang") == lang), "gc") for lang in ("dsb", "hsb")}, "gc")


@query("select count(*) as left_rows, count(*) filter (where item_key % 9 <> 0) as right_rows, count(*) filter (where item_key % 9 = 0 or (item_key % 5 = 0 and question is not null and question <> upper(question))) as differing from mr_items")
def manifest_diff(spark, d):
    """At how many places two outputs differ."""
    rows = table(spark, d, "mr_items").select("item_key", "question")
    other = rows.where("item_key % 9 <> 0").withColumn("question", F.when(F.col("item_key") % 5 == 0, F.upper("question")).otherwise(F.col("question")))
    return package.differing_rows(rows, other, "item_key")


@query("select sha256(coalesce(question, '')) as sha256, count(*) as n from mr_items group by 1")
def content_hashes(spark, d):
    """Hashes of contents."""
    return table(spark, d, "mr_items").groupBy(F.sha2(F.coalesce("question", F.lit("")), 256).alias("sha256")).agg(F.count("*").alias("n"))
