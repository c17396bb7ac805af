"""Queries of whole pipelines, cascades, sources and sinks, with a model's place taken by a function of the row's key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.functions import text as T
from sparklex.operators import assign, decide, lexicon
from sparklex.operators.synth import ALPHABET, CLOZE_QUESTION, CONFUSED, CONFUSED_SHARE, EDITS, ENDINGS, FILLERS, OPTION_COUNTS, THIRDS
from sparklex.plans import pipelines
from sparklex.plans import sql as S
from sparklex.plans.catalogue import _FREQUENT, _GROUPS, _NONWORD, MAPS, SEED, _vocab, query
from sparklex.plans.config import DEFAULTS
from sparklex.runtime import checkpointed, ordered_rank, scratch, table
from sparklex.sources import readers, schemas, writers

# Sources and sinks, written and read back


@query("select dataset_id, id, question from mr_items")
def jsonl_read_back(spark, d):
    """A task file as lines of JSON, nulls included."""
    path = scratch(spark)
    writers.write_jsonl(table(spark, d, "mr_items").select("dataset_id", "id", "question"), path)
    return readers.read_task(spark, path, "mr")


@query("select coalesce(input_sentence, '') as text from sc_gc_items")
def csv_read_back(spark, d):
    """A3: the last column of a CSV file with a header."""
    path = scratch(spark)
    rows = table(spark, d, "sc_gc_items").select("item_key", "input_sentence")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_csv_text(spark, path)


@query("select cast(row_number() over (order by item_id) - 1 as bigint) as row_idx, replace(text, chr(10), ' ') as src, 't: ' || replace(text, chr(10), ' ') as tgt from eval_passages where text is not null")
def parallel_read_back(spark, d):
    """A5, B2: two files line by line; the passages are a fixed table, so each side is one file."""
    rows = table(spark, d, "eval_passages").where("text is not null").select("item_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("t"))
    stem = scratch(spark)
    for side, value in (("src", F.col("t")), ("tgt", F.concat(F.lit("t: "), "t"))):
        rows.orderBy("item_id").coalesce(1).select(value).write.text(f"{stem}.{side}")
    return readers.read_parallel(spark, f"{stem}.src", f"{stem}.tgt", "hsb-hsb").drop("direction")


@query("select task as source, text as question_en from eval_passages where text is not null")
def json_array_read_back(spark, d):
    """One JSON array over many lines; the passages are a fixed table."""
    path = scratch(spark)
    rows = table(spark, d, "eval_passages").where("text is not null").select(F.struct(F.col("task").alias("source"), F.col("text").alias("question_en")).alias("r"))
    rows.agg(F.to_json(F.collect_list("r")).alias("value")).coalesce(1).write.text(path)
    return readers.read_json_array(spark, path, schemas.SEED).select("source", "question_en")


@query(f"with v as ({S.VOCAB}) select token as stem, case when length(token) % 2 = 0 then 'AB' else '' end as flags from v")
def dictionary_read_back(spark, d):
    """Stems and flags of dictionary lines; what stands behind a tab is left out."""
    path = scratch(spark)
    even = F.length("token") % 2 == 0
    _vocab(spark, d).select(F.concat("token", F.when(even, "/AB").otherwise(""), F.lit("\tpo:noun"))).write.text(path)
    return lexicon.stems(readers.read_dictionary(spark, path)).select("stem", "flags")


AFFIXES = ("FLAG char", "MAP 1", "MAP sš", "SFX A Y 2", "SFX A a y [^k]a", "SFX A 0 mi .", "PFX B Y 1", "PFX B 0 nje .  # a remark", "SFX C Y 1", "SFX C je ju je")
_FLAGS = "case when length(token) % 3 = 0 then 'AB' when length(token) % 3 = 1 then 'C' else '' end"


@query(f"""with v as ({S.VOCAB}), s as (select token, {_FLAGS} as f, cast(row_number() over (order by token) - 1 as bigint) as lemma_idx from v)
select lemma_idx, token as form from s union select lemma_idx, substr(token, 1, length(token) - 1) || 'y' from s where f = 'AB' and regexp_matches(token, '[^k]a$')
union select lemma_idx, token || 'mi' from s where f = 'AB' union select lemma_idx, 'nje' || token from s where f = 'AB'
union select lemma_idx, substr(token, 1, length(token) - 2) || 'ju' from s where f = 'C' and token like '%je'""")  # fmt: skip
def affix_forms(spark, d):
    """What the rules of an affix file make of every stem."""
    size = F.length("token") % 3
    stems = ordered_rank(_vocab(spark, d).select("token", F.when(size == 0, "AB").when(size == 1, "C").otherwise("").alias("flags")), "token", "lemma_idx")
    return lexicon.expand(stems.select("lemma_idx", F.col("token").alias("stem"), "flags"), lexicon.parse_affixes(AFFIXES))


@query(f"with v as ({S.VOCAB}) select token as variant, token as word from v union select substr(token, 1, i - 1) || substr(token, i + 1), token from (select token, unnest(generate_series(1, length(token))) as i from v)")
def deletion_index_read_back(spark, d):
    """The index for edit distances, written sorted and read back."""
    path = scratch(spark)
    writers.write_deletion_index(lexicon.deletion_index(_vocab(spark, d).select(F.col("token").alias("word")), 1), path)
    return writers.read_deletion_index(spark, path)


# Cascades and pipelines


def _stub(number, word=None):
    """A model that answers by the number of the row: at once, on the first, the second or the sampled try, or never."""

    def generate(rows: DataFrame, sample=False, temperature=0.0, min_new=0) -> DataFrame:
        key, opened = F.col("item_id"), F.col("prompt").endswith("<answer>")
        late = F.when(opened, F.when(key % 4 == 2, " 8 </answer> rest")).when(F.lit(sample), F.when(key % 8 == 3, "<answer>9</answer>")).when(F.lit(min_new > 0), F.when(key % 4 == 1, "<answer>\n6\n</answer>"))
        return rows.select("item_id", F.coalesce(late, F.when(key % 4 == 0, "<think>a</think><answer> \\frac{1}{2} </answer>"), F.lit("no answer")).alias("raw"))

    return generate


_STAGE = "case when item_key % 4 in (0, 1, 2) then item_key % 4 when item_key % 8 = 3 then 3 else 0 end"
_ANSWER = "case item_key % 4 when 0 then '\\frac{1}{2}' when 1 then '6' when 2 then '8' else case when item_key % 8 = 3 then '9' else '' end end"


@query(f"select item_key, cast({_STAGE} as integer) as stage, {_ANSWER} as answer from mr_items")
def retry_ladder(spark, d):
    """Empty answers are generated anew, rung by rung."""
    prompts = table(spark, d, "mr_items").select(F.col("item_key").alias("item_id"), T.mr_prompt(F.coalesce("question", F.lit(""))).alias("prompt"))
    first = prompts.join(_stub(4)(prompts), "item_id")
    return decide.retry_ladder(first, _stub(4)).select(F.col("item_id").alias("item_key"), "stage", T.mr_answer("raw").alias("answer"))


@query(f"select item_key, cast({_STAGE} as integer) as stage, case when item_key % 4 = 0 and id like 'medium%' then '$' || {_ANSWER} || '$' else {_ANSWER} end as pred from mr_items")
def mr_predictions(spark, d):
    """L4: generation, ladder and format of answers."""
    items = table(spark, d, "mr_items").select(F.col("item_key").alias("item_id"), "id", F.coalesce("question", F.lit("")).alias("question"))
    return pipelines.mr(items, _stub(4)).select(F.col("item_id").alias("item_key"), "stage", "pred")


_MT_PROMPT = "'Translate the source text from German to Upper Sorbian' || chr(10) || chr(10) || 'German: ' || source || chr(10) || 'Upper Sorbian:'"


@query(f"select pred_id, 'p' || length({_MT_PROMPT}) as pred from mt_preds where source is not null")
def mt_predictions(spark, d):
    """L6 without a memory: prompt, generation, extraction."""

    def generate(rows, **how):
        return rows.select("item_id", F.concat(F.lit("<think>x</think><hsb>\np"), F.length("prompt"), F.lit(" </hsb> rest")).alias("raw"))

    items = table(spark, d, "mt_preds").where("source is not null").select(F.col("pred_id").alias("item_id"), "source")
    return pipelines.mt(items, None, "de", "hsb", generate).select(F.col("item_id").alias("pred_id"), "pred")


_MARGIN = f"""coalesce(ew, '') not in ('', 'CORRECT') and m >= 0.3 and not (regexp_matches(ew, '^\\p{{Lu}}') and ew <> {S.strip('coalesce(' + S.tokens('s') + '[1], chr(0))')}) and not coalesce({S.quoted('ew', 's')}, false)"""


@query(f"""with d as (select item_key, input_sentence as s, case when item_key % 3 = 0 then incorrect_word else 'CORRECT' end as w, case when item_key % 3 = 0 then correct_word else 'CORRECT' end as c, incorrect_word as ew, correct_word as ec, (item_key % 100) / 100.0::double as m from sc_gc_items where split = 'dev'),
nw as (select item_key, word as nw, corrected as nc from ({_NONWORD})), j as (select d.*, nw, nc, case when coalesce(nullif(w, ''), 'CORRECT') <> 'CORRECT' then 'engine' when nw is not null then 'diacritic' when {_MARGIN} then 'margin' else 'none' end as stage from d left join nw using (item_key))
select item_key, case stage when 'engine' then w when 'diacritic' then nw when 'margin' then ew else 'CORRECT' end as word, case stage when 'engine' then c when 'diacritic' then nc when 'margin' then ec else 'CORRECT' end as corrected, stage from j""")  # fmt: skip
def sc_cascade_rows(spark, d):
    """L3: the engine's decision, else the diacritic top-up, else the margin top-up."""
    items = table(spark, d, "sc_gc_items")
    own = F.col("item_key") % 3 == 0
    decided = items.where("split = 'dev'").select(F.col("item_key").alias("item_id"), F.col("input_sentence").alias("sentence"), F.when(own, F.col("incorrect_word")).otherwise("CORRECT").alias("word"), F.when(own, F.col("correct_word")).otherwise("CORRECT").alias("corrected"), F.col("incorrect_word").alias("eng_w"), F.col("correct_word").alias("eng_c"), (F.col("item_key") % 100 / F.lit(100.0)).alias("margin"))
    vocab = _vocab(spark, d)
    forms = vocab.where("cnt >= 5").select(F.lit(0).alias("lemma_idx"), F.col("token").alias("form"))
    top = decide.nonword_topup(items.select(F.col("item_key").alias("item_id"), F.col("input_sentence").alias("sentence")), forms, vocab, list(MAPS), 5)
    return decide.sc_cascade(decided, top, 0.3).withColumnRenamed("item_id", "item_key")


def _gapped(spark, d, *more):
    rows = table(spark, d, "qa_items").where("question is not null")
    return rows.select("item_key", F.concat("question", F.lit(" co. II")).alias("question"), F.concat(F.coalesce("context", F.lit("")), F.lit(" ( I ) a (II)  b ( III )"), *more).alias("context"), "possible_answers")


@query("""with g as (select item_key, substr(coalesce(context, '') || ' ( I ) a (II)  b ( III )', 1, 400) as block, coalesce(context, '') || ' ( I ) a (II)  b ( III )' as c, cast(list_sort(map_entries(possible_answers)) as varchar) as o from qa_items where question is not null),
b as (select block, count(distinct o) = 1 and count(*) > 1 as shared from g group by block) select item_key, block, 'II' as gap, shared from g join b using (block)""")  # fmt: skip
def qa_blocks(spark, d):
    """items that ask for a gap, by their context, and whether the items of a block share their options."""
    return assign.gap_blocks(_gapped(spark, d).withColumnRenamed("item_key", "question_id")).withColumnRenamed("question_id", "item_key")


@query("""with n as (select item_key, len(map_keys(possible_answers)) as n, question is not null as asks from qa_items),
s as (select item_key, n, asks, list_transform(generate_series(0, greatest(n - 1, 0)), lambda o: (o * 3 + item_key) % 4) as scores from n)
select item_key, cast(case when asks and n > 0 then list_position(scores, list_max(scores)) when item_key % 5 between 1 and n then item_key % 5 else 1 end as integer) as pred from s""")
def qa_predictions(spark, d):
    """The number of an option from the model's reply; where a gap is asked for, the option that fits it best."""

    def generate(rows, **how):
        return rows.select("item_id", F.concat(F.lit("The answer is "), F.col("item_id") % 5, F.lit(".")).alias("raw"))

    def scores(options):
        return options.select("question_id", "option", ((F.col("option") * 3 + F.col("question_id")) % 4).cast("double").alias("score"))

    plain = table(spark, d, "qa_items").where("question is null").select("item_key", F.lit("").alias("question"), F.col("context"), "possible_answers")
    items = _gapped(spark, d, F.col("item_key")).withColumn("context", F.concat("item_key", F.lit(" "), "context")).unionByName(plain)
    out = pipelines.qa(items.withColumns({"item_id": F.col("item_key"), "question_id": F.col("item_key")}), generate, scores)
    return out.select("item_key", "pred")


@query("""with r as (select vec_id // 3 as block, vec_id % 3 as slot, embedding::double[] as e from embeddings), o as (select unnest(generate_series(0, 3)) as o),
n as (select block, count(*) as n from r group by block), x as (select block, slot, o, e[o + 1] as v from r, o),
p as (select a.block, a.o as o0, b.o as o1, c.o as o2, a.v + b.v + c.v as total from x a join x b on a.block = b.block and a.slot = 0 and b.slot = 1 and a.o <> b.o join x c on a.block = c.block and c.slot = 2 and c.o <> a.o and c.o <> b.o
union all select a.block, a.o, b.o, null, a.v + b.v from x a join x b on a.block = b.block and a.slot = 0 and b.slot = 1 and a.o <> b.o join n on a.block = n.block and n.n = 2 union all select a.block, a.o, null, null, a.v from x a join n on a.block = n.block and n.n = 1),
b as (select block, arg_max((o0, o1, o2), total) as m from p group by block) select block, slot, cast(case slot when 0 then m[1] when 1 then m[2] else m[3] end as integer) as choice from r join b using (block)""")  # fmt: skip
def small_slot_assignment(spark, d):
    """Blocks of three slots and four options, small enough that SQL tries all assignments."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("block"), (F.col("vec_id") % 3).alias("slot"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("scores"))
    return assign.assign_blocks(rows)


# Synthesis


def _ending_sql(lang: str) -> str:
    """The word `w` with a wrong ending, by the rules in their order; null without one. Options are tried from a drawn one on."""
    cases = []
    for rule, (ending, wrong) in enumerate(ENDINGS[lang]):
        stem = f"substr(w, 1, length(w) - {len(ending)})"
        start = f"({S.lot(f'{SEED}/ending{rule}', 'w', 'item_key')} % {len(wrong)})"
        options = "[" + ", ".join(S.q(x) for x in wrong) + "]"
        turned = f"list_concat({options}[{start} + 1:], {options}[1:{start}])"
        made = f"list_filter(list_transform({turned}, lambda e: {stem} || e), lambda x: x <> w and x <> '')[1]"
        cases.append(f"when w like '%{ending}' and {made} is not null then {made}")
    return "case " + " ".join(cases) + " end"


def _endings_sql(lang: str, where: str) -> str:
    endings = "|".join(e for e, _ in ENDINGS[lang])
    return f"""select item_key, case when bad then array_to_string(list_concat(t[:i], [new], t[i + 2:]), ' ') else s end as input_sentence, s as original_sentence, case when bad then new else 'CORRECT' end as incorrect_word, case when bad then w else 'CORRECT' end as correct_word from (
select *, {S.unit(f'{SEED}/error', 'item_key')} < 0.5 and new is not null as bad from (select *, {_ending_sql(lang)} as new from (select *, t[i + 1] as w from (
select *, list_sort(list_transform(list_filter(generate_series(0, len(t) - 1), lambda j: regexp_matches(t[j + 1], '^\\p{{L}}+$') and length(t[j + 1]) >= 3 and regexp_matches(t[j + 1], '(?:{endings})$')), lambda j: {{'l': {S.lot(f'{SEED}/word', 'item_key', 'j')}, 'i': j}}))[1].i as i
from (select item_key, {S.norm('original_sentence')} as s, {S.tokens('original_sentence')} as t from sc_gc_items where split = 'dev' and {where})))))"""


WRONG_ENDINGS = f"{_endings_sql('hsb', 'not coalesce(lower(trim(lang)) = {0}, false)'.format(S.q('dsb')))} union all {_endings_sql('dsb', 'lower(trim(lang)) = {0}'.format(S.q('dsb')))}"


_MAY = f"len(list_filter(string_split({S.norm('original_sentence')}, ' '), lambda t: length(t) >= 3 and regexp_matches(t, '^\\p{{L}}+$'))) > 0"


@query(f"with e as (select {S.unit(SEED + '/error', 'item_key')} < 0.5 and {_MAY} as bad from sc_gc_items where split = 'dev') select count(*) as rows, count(*) filter (where not bad) as clean, count(*) filter (where bad) as errors, round(avg(bad::int), 6) as error_share from e")
def synthesis_counts(spark, d):
    """Counts of a run in which half of the sentences are to be spoilt."""
    from sparklex.operators import synth

    rows = table(spark, d, "sc_gc_items").where("split = 'dev'").select("item_key", F.col("original_sentence").alias("text"))
    return synth.synthesis_meta(synth.inject_typos(rows, "text", "item_key", SEED, 0.5)).withColumn("error_share", F.round("error_share", 6))


@query(f"""with h as (select distinct {S.fold('input_sentence')} as t from sc_gc_items where split = 'test'), m as (select item_key from sc_gc_items where split = 'dev' and {S.fold('original_sentence')} not in (select t from h where t <> ''))
select item_key, case when row_number() over (order by {S.lot(SEED, 'item_key')}, item_key) <= 50 then 'pool' else 'train' end as part from m""")  # fmt: skip
def synthesis_bundle(spark, d):
    """Texts that aren't held out, made into rows, split into pool and train, written by part and read back."""
    items = table(spark, d, "sc_gc_items")
    held = items.where("split = 'test'").select(T.fold_key("input_sentence").alias("text")).where("text <> ''").distinct()
    mono = items.where("split = 'dev'").select(F.col("item_key").alias("ord"), F.coalesce("original_sentence", F.lit("")).alias("text"))
    path = scratch(spark)
    writers.write_bundle(pipelines.synthesise(mono, "gc", "hsb", held, SEED, 50), path, ["part"])
    return spark.read.schema(f"ord long, {schemas.CHAT}, part string").json(path).select(F.col("ord").alias("item_key"), "part")


def _chance(name: str) -> str:
    return S.unit(f"{SEED}/{name}", "item_key")


def _drawn_sql(u: str, weighted) -> str:
    total, upto, cases = sum(w for _, w in weighted), 0.0, []
    for value, w in weighted[:-1]:
        upto += w / total
        cases.append(f"when {u} < {upto!r} then {S.q(value)}")
    return f"case {' '.join(cases)} else {S.q(weighted[-1][0])} end"


def _place_sql(length: str, u: str) -> str:
    """The first place whose share of the weights so far is above u."""
    weight = f"lambda j: {list(THIRDS)}[least(2, 3 * j // greatest({length} - 1, 1)) + 1]"
    share = f"list_sum(list_transform(generate_series(0, i), {weight})) / list_sum(list_transform(generate_series(0, {length} - 1), {weight}))"
    return f"least(len(list_filter(generate_series(0, {length} - 1), lambda i: {share} <= {u})), {length} - 1)"


def _edit_sql(rows: str, word: str, kind: str, end: str, out: str) -> str:
    """rows with the column `out`: the word after an edit of the kind, whose lots' names end in `end`."""
    pick = lambda letters: f"substr({letters}, cast(floor({_chance('letter' + end)} * length({letters})) as integer) + 1, 1)"
    near = f"case substr({word}, spot + 1, 1) " + " ".join(f"when {S.q(a)} then {S.q(b)}" for a, b in CONFUSED.items()) + " end"
    letters = f"case when {_chance('confuse' + end)} < {CONFUSED_SHARE} and ({near}) is not null then {near} else replace({S.q(ALPHABET)}, substr({word}, spot + 1, 1), '') end"
    length = f"(length({word}) - case when {kind} = 'transposition' then 1 else 0 end)"
    return f"""select * exclude (spot), case when length({word}) < 1 or length({word}) < 2 and {kind} in ('transposition', 'deletion') then {word}
when {kind} = 'transposition' then substr({word}, 1, spot) || substr({word}, spot + 2, 1) || substr({word}, spot + 1, 1) || substr({word}, spot + 3)
when {kind} = 'deletion' then substr({word}, 1, spot) || substr({word}, spot + 2) when {kind} = 'insertion' then substr({word}, 1, spot) || {pick(S.q(ALPHABET))} || substr({word}, spot + 1)
else substr({word}, 1, spot) || {pick('(' + letters + ')')} || substr({word}, spot + 2) end as {out} from (select *, cast({_place_sql(length, _chance('place' + end))} as integer) as spot from ({rows}))"""


def _typos_sql() -> str:
    singles = [(k, 1) for k in ("substitution", "deletion", "insertion", "transposition")]
    chosen = f"""select *, t[i] as w, {_drawn_sql(_chance('kind'), EDITS)} as kind, {_drawn_sql(_chance('first'), singles)} as one, {_drawn_sql(_chance('second'), singles)} as two, 'substitution' as sub from (
select *, may[cast(floor({_chance('word')} * len(may)) as integer) + 1] as i from (select item_key, s, t, list_filter(generate_series(1, len(t)), lambda j: length(t[j]) >= 3 and regexp_matches(t[j], '^\\p{{L}}+$')) as may from (
select item_key, {S.norm('original_sentence')} as s, string_split({S.norm('original_sentence')}, ' ') as t from sc_gc_items where split = 'dev')))"""
    once = _edit_sql(f"select *, case when kind = 'multi' then one else kind end as k1 from ({chosen})", "w", "k1", "", "o1")
    twice = _edit_sql(once, "o1", "two", "2", "o2")
    last = _edit_sql(twice, "w", "sub", "3", "o3")
    done = f"select *, case when kind = 'multi' and o2 <> w then o2 else o1 end as o from ({last})"
    bad = f"select *, case when o <> w then o else o3 end as new, {_chance('error')} < 0.5 and i is not null as hit from ({done})"
    return f"""select item_key, case when hit and new <> w then array_to_string(list_concat(t[:i - 1], [new], t[i + 1:]), ' ') else s end as input_sentence, s as original_sentence,
case when hit and new <> w then new else 'CORRECT' end as incorrect_word, case when hit and new <> w then w else 'CORRECT' end as correct_word from ({bad})"""


TYPOS = _typos_sql()

def _cloze_sql() -> str:
    fillers = " union all ".join(f"select {S.q(w)}, {10_000 + k}" for k, w in enumerate(FILLERS))
    stop = ", ".join(S.q(w) for w in T.STOPWORDS)

    def option(j: int, rows: str, other: str) -> str:
        at = f"cast(floor({_chance(f'option {j}')} * n_words) as bigint)"
        return f"select {rows}.item_key, arg_min(wn.token, (wn.no - {at} + n_words) % n_words) as token from {rows}, wn, nw where {S.low('wn.token')} <> {S.low('answer')} {other} group by {rows}.item_key"

    return f"""with fr as ({_FREQUENT}), vo as (select token, row_number() over (order by cnt desc, first_seen, token) as rk from fr union all {fillers}), ws as (select arg_min(token, rk) as token, max(rk) as mx from vo group by {S.low('token')}),
wn as (select token, row_number() over (order by mx) - 1 as no from ws), nw as (select count(*) as n_words from wn),
r0 as (select item_key, string_split({S.norm('original_sentence')}, ' ') as t from sc_gc_items where split = 'dev'),
r1 as (select *, list_filter(generate_series(1, len(t)), lambda j: length(t[j]) >= 4 and regexp_matches(t[j], '^\\p{{L}}+$') and lower(t[j]) not in ({stop})) as may from r0),
r2 as (select *, may[cast(floor({_chance('mask')} * len(may)) as integer) + 1] as i, {_drawn_sql(_chance('count'), [(str(n), w) for n, w in OPTION_COUNTS])} as n from r1 where len(may) > 0),
r3 as (select *, t[i] as answer from r2), o0 as ({option(0, 'r3', '')}), r4 as (select r3.*, o0.token as first from r3 join o0 using (item_key)), o1 as ({option(1, 'r4', 'and wn.token <> first')}),
r5 as (select r4.*, case when n = '3' then [answer, first, o1.token] else [answer, first] end as all_of from r4 join o1 using (item_key)),
r6 as (select *, list_transform(list_sort(list_transform(all_of, lambda w: {{'u': {S.lot_of("'" + SEED + "/order ' || w || ':' || item_key")}, 'w': w}})), lambda e: e.w) as shown from r5)
select item_key, array_to_string(list_concat(t[:i - 1], ['___'], t[i + 1:]), ' ') as context, {S.q(CLOZE_QUESTION)} as question, array_to_string(shown, ' | ') as options, cast(list_position(shown, answer) as integer) as correct_answer_num, answer as answer_text from r6"""


CLOZE = _cloze_sql()

CALIBRATED = f"""with tr as (select distinct removed, added from (select substr(correct_word, p + 1) as removed, substr(incorrect_word, p + 1) as added from (select *, cast(case when least(length(correct_word), length(incorrect_word)) > 0 then len(list_filter(generate_series(1, least(length(correct_word), length(incorrect_word))), lambda i: substr(correct_word, 1, i) = substr(incorrect_word, 1, i))) else 0 end as bigint) as p from sc_gc_items where incorrect_word <> 'CORRECT' and correct_word is not null and try_cast(id as bigint) % 2 = 0) where p >= 2)),
k as (select token as form from ({S.UNIGRAMS})), r as (select item_key, {S.norm('original_sentence')} as s, {S.tokens('original_sentence')} as t from sc_gc_items where split = 'dev'),
c as (select * from (select item_key, pos, {S.strip('t[pos + 1]')} as w from (select item_key, t, unnest(generate_series(0, len(t) - 1)) as pos from r)) where regexp_matches(w, '^\\p{{L}}+$') and length(w) >= 4),
v as (select distinct w from c where w in (select form from k) or lower(w) in (select form from k)),
e as (select w, unnest(generate_series(0, length(w) - 1)) as i from v), m as (select distinct w, substr(w, 1, length(w) - length(removed)) || added as new from e join tr on substr(w, length(w) - i + 1, i) = removed),
n as (select w, new from m where new <> w and new <> '' and (new in (select form from k) or lower(new) in (select form from k))),
x as (select item_key, pos, w, new, {S.lot(SEED + '/transform', 'item_key', 'pos', 'new')} as l from c join n using (w)),
b as (select item_key, pos, w, arg_min(new, (l, new)) as new from x group by all), y as (select item_key, arg_min((pos, w, new), ({S.lot(SEED + '/word', 'item_key', 'pos')}, pos, w, new)) as m from b group by item_key)
select item_key, array_to_string(list_concat(t[:m[1]], [substr(t[m[1] + 1], 1, strpos(t[m[1] + 1], m[2]) - 1) || m[3] || substr(t[m[1] + 1], strpos(t[m[1] + 1], m[2]) + length(m[2]))], t[m[1] + 2:]), ' ') as input_sentence, s as original_sentence, m[3] as incorrect_word, m[2] as correct_word from r join y using (item_key)"""


# Candidates and decisions of the correction engine

_FREE = [*range(1, 65), *range(91, 97), *range(123, 128)]  # ASCII that is no letter


def _engine_sql(task: str, words: str) -> str:
    """CTEs for the words of a task, given as a query of `word`: the candidates `cand` (word, candidate, cnt, rank).

    Levenshtein counts bytes here, so letters beyond ASCII are exchanged for free ASCII characters first.
    """
    paradigm = f"""pe as (select word, l from w join f on word = form), px as (select * from pe union select word, l from w join f on lower(word) = form where word not in (select word from pe)),
pr as (select word, form from (select word, form, row_number() over (partition by word order by form) as n from (select distinct word, f.form from px join f using (l) where word <> f.form)) where n <= {DEFAULTS[task + '_paradigm_cap']})"""
    if task == "gc":
        sources = "select word, form as candidate from pr"
    else:
        sources = f"""select word, substr(word, 1, i - 1) || substr(g, j, 1) || substr(word, i + 1) as candidate from (select word, i, g, unnest(generate_series(1, length(g))) as j from (select word, i, unnest([{_GROUPS}]) as g from (select word, unnest(generate_series(1, length(word))) as i from w)) where contains(g, substr(word, i, 1)))
union select word, form from e where d <= case when known then 1 else 2 end union select word, form from pr where not known_word(word)""".replace("not known_word(word)", "word in (select word from w where not known)")
    return f"""v as ({S.VOCAB}), k as (select token from v where cnt >= 5), f as (select case when length(token) >= 5 then substr(token, 1, 4) else '=' || token end as l, token as form from v where cnt >= 5),
w as (select word, word in (select token from k) or lower(word) in (select token from k) as known from ({words})),
al as (select ch, chr({_FREE}[cast(row_number() over (order by ch) as integer)]) as free from (select distinct unnest(string_split(x, '')) as ch from (select word as x from w union select token from k)) where ord(ch) > 127),
tr as (select coalesce(string_agg(ch, '' order by ch), '') as a, coalesce(string_agg(free, '' order by ch), '') as b from al),
tw as (select word, known, translate(word, a, b) as x from w, tr), tk as (select token as form, translate(token, a, b) as y from k, tr),
e as (select word, form, known, levenshtein(x, y) as d from tw join tk on abs(length(x) - length(y)) <= 2), {paradigm}, c as ({sources}),
cand as (select * from (select word, candidate, coalesce(cnt, 0) as cnt, row_number() over (partition by word order by coalesce(cnt, 0) desc, candidate) as rank from (select distinct word, candidate from c where candidate <> word and (candidate in (select token from k) or lower(candidate) in (select token from k))) left join v on lower(candidate) = token) where rank <= {DEFAULTS['max_cand']})"""


def _of(task: str) -> str:
    return "task = 'gc'" if task == "gc" else "coalesce(task, '') <> 'gc'"


def _cores_sql(where: str) -> str:
    return f"select * from (select item_key, t, pos, {S.strip('t[pos + 1]')} as word from (select item_key, t, unnest(generate_series(0, len(t) - 1)) as pos from (select item_key, {S.tokens('input_sentence')} as t from sc_gc_items where {where}))) where regexp_matches(word, '^\\p{{L}}+$') and length(word) >= 3"


def _candidates_sql(task: str) -> str:
    return f"with {_engine_sql(task, f'select distinct word from ({_cores_sql(_of(task))})')} select *, '{task}' as task from cand"


WORD_CANDIDATES = f"select * from ({_candidates_sql('sc')}) union all select * from ({_candidates_sql('gc')})"

# The mean over adjacent words of the sentences `s` (id, sentence).
_SCORES = f"""un as ({S.UNIGRAMS}), bi as ({S.BIGRAMS}), low as (select id, {S.cores('sentence')} as t from s), ad as (select id, t[i] as l, t[i + 1] as r from (select id, t, unnest(generate_series(1, len(t) - 1)) as i from low where len(t) > 1)),
me as (select id, avg(ln(coalesce(bi.cnt, 0) + 0.5) - ln(coalesce(un.cnt, 0) + 0.5)) as m from ad left join bi on l = bi."left" and r = bi."right" left join un on l = un.token group by id), sc as (select s.id, round(coalesce(m, 0), 9) as score from s left join me using (id))"""


def _argmax_sql(task: str, scores: str = _SCORES) -> str:
    dev = f"split = 'dev' and {_of(task)}"
    return f"""with co as ({_cores_sql(dev)}), {_engine_sql(task, 'select distinct word from co')},
va as (select item_key, pos, rank, word, candidate, array_to_string(list_concat(t[:pos], [substr(t[pos + 1], 1, strpos(t[pos + 1], word) - 1) || candidate || substr(t[pos + 1], strpos(t[pos + 1], word) + length(word))], t[pos + 2:]), ' ') as sentence from co join cand using (word)),
al2 as (select item_key, pos, rank, word, candidate, sentence from va union all select item_key, -1, 0, null, null, {S.norm('input_sentence')} from sc_gc_items where {dev}), x as (select *, item_key || ':' || pos || ':' || rank as id from al2),
s as (select id, sentence from x), {scores}, y as (select x.*, score from x join sc using (id)),
b as (select item_key, arg_max((word, candidate, score), (score, -pos, -rank)) filter (where pos >= 0) as best, max(score) filter (where pos < 0) as null_score, count(*) filter (where pos >= 0) as n_variants from y group by item_key)
select item_key as item_id, coalesce(best[1], 'CORRECT') as word, coalesce(best[2], 'CORRECT') as corrected, round(coalesce(best[3] - null_score, 0), 6) as margin, n_variants from b"""


ARGMAX = f"select * from ({_argmax_sql('sc')}) union all select * from ({_argmax_sql('gc')})"


def _constrained_sql(task: str, scores: str = _SCORES, more: str = "true") -> str:
    flagged = f"select item_key, input_sentence as sent, incorrect_word as word, correct_word as correction from sc_gc_items where split = 'dev' and incorrect_word <> 'CORRECT' and {_of(task)} and {more}"
    return f"""with fl as ({flagged}), {_engine_sql(task, 'select distinct word from fl where word is not null')},
tr1 as (select item_key, sent, word, correction as candidate, 0 as rank from fl where correction not in ('', 'CORRECT') union all select item_key, sent, fl.word, candidate, rank from fl join cand using (word) where correction is null or candidate <> correction),
x as (select *, item_key || ':' || rank || ':' || candidate as id, substr(sent, 1, strpos(sent, word) - 1) || candidate || substr(sent, strpos(sent, word) + length(word)) as sentence from tr1 where (word <> candidate or rank = 0) and strpos(sent, word) > 0 and word <> ''),
s as (select id, sentence from x), {scores}, b as (select item_key, arg_max(candidate, (score, -rank, candidate)) as best from x join sc using (id) group by item_key)
select item_key as item_id, case when word = correction then 'CORRECT' else word end as word, case when word = correction then 'CORRECT' else coalesce(best, correction) end as corrected from fl left join b using (item_key)"""


CONSTRAINED = f"select * from ({_constrained_sql('sc')}) union all select * from ({_constrained_sql('gc')})"


# Whole pipelines of correction: the model flags the rows of even number as they are judged, and the corpus is the items.

_OWN_BIGRAMS = S.BIGRAMS.replace(S.cores("text"), S.cores("input_sentence")).replace("from documents", "from sc_gc_items")
_OWN_SCORES = _SCORES.replace(S.UNIGRAMS, S.VOCAB).replace(S.BIGRAMS, _OWN_BIGRAMS)


def _pipeline_sql(task: str, rest: str) -> str:
    """CTEs with one row for each item: what the model says (w, c), what the engine says (ew, ec, m) and constrained (ow, oc)."""
    return f"""with en as ({_argmax_sql(task, _OWN_SCORES)}), co as ({_constrained_sql(task, _OWN_SCORES, 'item_key % 2 = 0')}),
d as (select item_key, input_sentence as s, case when item_key % 2 = 0 then incorrect_word else 'CORRECT' end as w, en.word as ew, en.corrected as ec, en.margin as m, co.word as ow, co.corrected as oc from sc_gc_items i join en on en.item_id = item_key left join co on co.item_id = item_key where split = 'dev' and {_of(task)}), {rest}"""


def _gc_sql() -> str:
    fit = DEFAULTS["witness"]["hsb"]
    return _pipeline_sql("gc", f"""bg as ({_OWN_BIGRAMS}), l as (select item_key, lower(ew) as o, lower(ec) as c, list_transform({S.tokens('s')}, lambda t: lower({S.strip('t')})) as l from d where coalesce(ew, '') not in ('', 'CORRECT')), n as (select *, list_position(l, o) as p from l),
q as (select item_key, o, c, case when p > 1 then l[p - 1] end as lw, case when p > 0 then l[p + 1] end as rw from n),
g as (select item_key, 1 as k, lw as "left", c as "right" from q union all select item_key, 1, c, rw from q union all select item_key, -1, lw, o from q union all select item_key, -1, o, rw from q),
wi as (select item_key, sum(k * ln(coalesce(cnt, 0) + 0.5)) as x from g left join bg using ("left", "right") where "left" <> '' and "right" <> '' group by item_key),
z as (select d.*, coalesce(w, '') not in ('', 'CORRECT') as flag, coalesce(ew, '') = w and coalesce(ec, '') <> '' as agree, m + {fit['w']} * coalesce(x, 0) >= {fit['t']} as solo from d left join wi using (item_key))
select item_key, coalesce(nullif(case when flag and agree then w when flag then ow when solo then ew else 'CORRECT' end, ''), 'CORRECT') as pred_incorrect, coalesce(nullif(case when flag and agree then ec when flag then oc when solo then ec else 'CORRECT' end, ''), 'CORRECT') as pred_corrected from z""")


def _sc_sql() -> str:
    margin = _MARGIN.replace("m >= 0.3", f"m >= {DEFAULTS['tau']['dsb']}")
    return _pipeline_sql("sc", f"""nw as (select item_key, word as nw, corrected as nc from ({_NONWORD})), z as (select d.*, nw, nc, coalesce(nullif(ow, ''), 'CORRECT') as w1, coalesce(nullif(oc, ''), 'CORRECT') as c1 from d left join nw using (item_key)),
t as (select *, case when w1 <> 'CORRECT' then 1 when nw is not null then 2 when {margin} then 3 else 4 end as stage from z)
select item_key, case stage when 1 then w1 when 2 then nw when 3 then ew else 'CORRECT' end as pred_incorrect, case stage when 1 then c1 when 2 then nc when 3 then ec else 'CORRECT' end as pred_corrected from t""")


def _corrected(spark, d, task: str, lang: str) -> DataFrame:
    items = table(spark, d, "sc_gc_items")
    own = items.where("split = 'dev'").where(F.col("task") == "gc" if task == "gc" else F.coalesce("task", F.lit("")) != "gc")

    def generate(rows, **how):
        said = own.select(F.col("item_key").alias("item_id"), F.concat(F.lit("<wrong> "), "incorrect_word", F.lit(" </wrong> <corrected> "), "correct_word", F.lit(" </corrected>")).alias("said"))
        none = F.lit("<wrong> CORRECT </wrong> <corrected> CORRECT </corrected>")
        return rows.join(said, "item_id").select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("said")).otherwise(none).alias("raw"))

    vocab = _vocab(spark, d)
    lemma = F.when(F.length("token") >= 5, F.substring("token", 1, 4)).otherwise(F.concat(F.lit("="), "token"))
    forms = checkpointed(vocab.where("cnt >= 5").select(lemma.alias("lemma_idx"), F.col("token").alias("form")))
    rows = own.select(F.col("item_key").alias("item_id"), F.col("input_sentence").alias("sentence"))
    out = pipelines.sc_gc(rows, task, lang, generate, forms, list(MAPS), items.select(F.col("input_sentence").alias("text")))
    return out.select(F.col("item_id").alias("item_key"), "pred_incorrect", "pred_corrected")


@query(_gc_sql())
def gc_predictions(spark, d):
    """L7 for grammar: the model's flag against the engine's argmax and the bigrams' witness."""
    return _corrected(spark, d, "gc", "hsb")


@query(_sc_sql())
def sc_predictions(spark, d):
    """L7 for spelling: the constrained correction, then the diacritic and the margin top-up, as switched on for one language."""
    return _corrected(spark, d, "sc", "dsb")
