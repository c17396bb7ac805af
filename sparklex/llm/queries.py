"""The queries of this subpackage's operators over the test tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.llm import confusables, formatting_duplicates, language, leakage, packing, pairs, split_overlap, toxicity, truncation
from sparklex.llm.text import LOOKALIKES
from sparklex.runtime import table

def _sentences_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "sc_gc_items").select(F.lit("input_sentence").alias("field"), F.col("item_key").alias("rec_id"), F.col("input_sentence").alias("text"))
    preds = table(spark, sf_dir, "mt_preds").select(F.lit("source").alias("field"), F.col("pred_id").alias("rec_id"), F.col("source").alias("text"))
    return items.unionByName(preds)


def role(column) -> F.Column:
    return F.lower(F.trim(column))


def _labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = table(spark, sf_dir, "mt_preds").select(F.lit("pred").alias("field"), F.col("pred_id").alias("rec_id"), F.col("pred_lang").alias("label"), F.col("pred").alias("text"))
    answers = F.transform(F.filter("messages", lambda m: role(m["role"]).isin(*sorted(pairs.ASSISTANT_ROLES))), lambda m: m["content"])
    chats = table(spark, sf_dir, "training").where(F.lower("task").isin("mt", "mr")).select(F.lit("content").alias("field"), F.col("row_id").alias("rec_id"), F.col("lang").alias("label"), F.array_join(answers, "\n").alias("text"))
    return preds.unionByName(chats)


def _preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mt_preds").select(F.col("pred_id").alias("rec_id"), "source", F.col("direction").alias("kind"), F.col("pred").alias("text"), "system_name", "dataset_id")


def _items(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("eval_table"), "item_key", F.col(c).alias("text"), *more) for t, c in (("sc_gc_items", "input_sentence"), ("mr_items", "question"), ("qa_items", "question"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "training").select("row_id", F.explode("messages.content").alias("text"))


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = [r["capacity"] for r in table(spark, sf_dir, "pack_limits").select("capacity").distinct().collect()]  # a fixed table
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")), limits)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, sf_dir, "training")).distinct()


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and defective pairs of each mixture, by type of defect."""
    judged = pairs.judged_pairs(table(spark, sf_dir, "training"), by="mixture")
    kinds = [F.count_if(F.col("defect") == d).alias(f"{d}_pairs") for d in ("empty", "truncated", "refusal", "copy", "language")]
    return judged.groupBy("mixture").agg(F.count("*").alias("pairs"), F.count("defect").alias("defective"), *kinds)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting_duplicates.formatting_copies(table(spark, sf_dir, "raw_lines"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting_duplicates.collapse_records(table(spark, sf_dir, "raw_lines"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.alike_pairs(_sentences_of_both(spark, sf_dir))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.canonical_texts(_sentences_of_both(spark, sf_dir)).select("field", "rec_id", "canon")


_ORIGIN = ["system_name", "dataset_id"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated_texts(_preds(spark, sf_dir), origin=_ORIGIN).select(F.col("rec_id").alias("pred_id")).distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and truncated rows for each system_name and dataset_id."""
    judged = truncation.judged_texts(_preds(spark, sf_dir), origin=_ORIGIN)
    return judged.groupBy(*_ORIGIN).agg(F.count("*").alias("rows"), F.count("reason").alias("truncated"), F.avg(F.col("reason").isNotNull().cast("double")).alias("rate"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlaps(_items(spark, sf_dir), _messages(spark, sf_dir)).drop("coverage")


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps with the share of the item's words that lies in shared spans."""
    return split_overlap.overlaps(_items(spark, sf_dir), _messages(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items found in the training split, for each table, split and dataset_id."""
    found = p5_found(spark, sf_dir).groupBy("eval_table", "item_key").agg(F.count("*").alias("n"))
    items = _items(spark, sf_dir, "split", "dataset_id").drop("text")
    return items.join(found, ["eval_table", "item_key"]).groupBy("eval_table", "split", "dataset_id").agg(F.count("*").alias("items"), F.sum("n").alias("pairs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.label_cases(_labelled_texts(spark, sf_dir)).select("field", "rec_id", "seg_no", "lang").distinct()


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_segments(_labelled_texts(spark, sf_dir)).select("field", "rec_id", "label", "seg_no", "lang", F.round("confidence", 4).alias("confidence"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leak with its longest run of words and the words of the document that it covers."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id", F.col("longest").cast("long").alias("longest"), F.col("covered").cast("long").alias("covered"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item that leaked, with the number of documents that hold it and the longest run of words."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("longest").cast("long").alias("longest"))


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold leaked spans, without them; those of which more than half would go have no text."""
    documents = table(spark, sf_dir, "documents")
    return leakage.cleaned_documents(documents, leakage.leaked_items(documents, table(spark, sf_dir, "eval_passages")), max_share=0.5)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "pack_limits").select("limit_name", F.col("capacity").cast("long").alias("capacity"))
    return _containers(spark, sf_dir).join(F.broadcast(limits), "capacity").select("limit_name", "container", "doc_id", "part_no", "n_tokens", "unused")


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of unused space for each capacity."""
    return _containers(spark, sf_dir).groupBy("capacity").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens")).withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where(F.col("score") >= toxicity.THRESHOLD).select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels")).select("doc_id", "source", "score")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and found documents of each source."""
    bad = F.col("score") >= toxicity.THRESHOLD
    return p9_scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(bad).alias("found"), F.avg(bad.cast("double")).alias("rate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


# The same results stated plainly in SQL, by other means than the operators'.

_SIGNED = "regexp_replace(lower(nfc_normalize(v)), '(^|[\\p{Z}\\s])[-−]([0-9])', '\\1␝\\2', 'g')"
for _pair in ("[.,]", "[.,]", "[\\p{P}\\p{Z}\\p{C}]+", "[\\p{P}\\p{Z}\\p{C}]+"):  # overlapping matches need two passes
    _SIGNED = f"regexp_replace({_SIGNED}, '([0-9]){_pair}([0-9])', '\\1{'␞' if _pair == '[.,]' else '␟'}\\2', 'g')"
_CANON = f"case when k in ('dataset_id', 'sent_id', 'id') then regexp_replace(replace(lower(nfc_normalize(v)), 'ß', 'ss'), '[\\p{{Z}}\\p{{C}}]', '', 'g') else regexp_replace(replace({_SIGNED}, 'ß', 'ss'), '[\\p{{P}}\\p{{Z}}\\p{{C}}]', '', 'g') end"
_RECORDS = f"""with j as (select line_id, cast(payload as json) as j from raw_lines where payload is not null and json_valid(payload) and try_cast(payload as json) is not null),
f as (select line_id, k, json_extract_string(j, '$."' || k || '"') as v from (select line_id, j, unnest(json_keys(j)) as k from j where json_type(j) = 'OBJECT')),
r as (select line_id, string_agg(k || chr(1) || coalesce({_CANON}, chr(2)), chr(3) order by k) as record from f group by line_id),
g as (select line_id, min(line_id) over (partition by record) as first_id from r)"""


def _folded(x: str) -> str:
    return f"regexp_extract_all(replace(replace(strip_accents(lower({x})), 'ł', 'l'), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


def _grams(key: str, table_name: str) -> str:
    return f"select {key}, array_to_string(t[i:i + 7], ' ') as gram from (select {key}, t, unnest(generate_series(1, len(t) - 7)) as i from (select {key}, {_folded('text')} as t from {table_name} where text is not null) where len(t) >= 8)"


def _placed_grams(key: str, place: str, table_name: str) -> str:
    return f"select {key}, i as {place}, array_to_string(t[i:i + 7], ' ') as gram from (select {key}, t, unnest(generate_series(1, len(t) - 7)) as i from (select {key}, {_folded('text')} as t from {table_name} where text is not null) where len(t) >= 8)"


# A run of words is a diagonal of runs of eight without a gap.
_RUNS = f"""with d as ({_placed_grams('doc_id', 'dpos', 'documents')}), p as ({_placed_grams('item_id', 'ipos', 'eval_passages')}),
m as (select doc_id, cast(item_id as bigint) as item_id, dpos, ipos from d join p using (gram)), r as (select *, dpos - row_number() over (partition by doc_id, item_id, dpos - ipos order by dpos) as g from m),
l as (select doc_id, item_id, max(n) as longest from (select doc_id, item_id, count(*) + 7 as n from r group by doc_id, item_id, dpos - ipos, g) group by doc_id, item_id)"""


def _looks(x: str) -> str:
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    narrow = "".join(chr(0x21 + i) for i in range(94))
    single = {k: v for k, v in LOOKALIKES.items() if len(v) == 1}
    plain = f"translate(regexp_replace(regexp_replace({x}, '[\\p{{Cf}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g'), '\\p{{Zs}}', ' ', 'g'), '{wide}', '{narrow.replace(chr(39), chr(39) * 2)}')"
    return f"trim(nfc_normalize(translate({plain}, '{''.join(single)}', '{''.join(single.values())}')))"


def oracle_sql() -> dict[str, str]:
    alike = f"select 'input_sentence' as field, item_key as id, input_sentence as text, {_looks('input_sentence')} as look from sc_gc_items where input_sentence is not null union all select 'source', pred_id, source, {_looks('source')} from mt_preds where source is not null"
    forms = f"select 'input_sentence' as field, item_key as rec_id, {_looks('input_sentence')} as canon from sc_gc_items where input_sentence is not null union all select 'source', pred_id, {_looks('source')} from mt_preds where source is not null"
    return {
        "p3_forms": forms,
        "p2_found": f"{_RECORDS} select first_id, line_id as copy_id from g where line_id > first_id",
        "p2_records": f"{_RECORDS} select first_id, count(*) as copies from g group by first_id",
        "p3_found": f"with t as ({alike}) select a.field, a.id as id_a, b.id as id_b from t a join t b on a.field = b.field and a.look = b.look and a.id < b.id and a.text <> b.text where a.look <> ''",
        "p8_items": f"{_RUNS} select item_id, count(*) as documents, max(longest) as longest from l group by item_id",
        "p8_spans": f"{_RUNS}, c as (select doc_id, item_id, count(distinct dpos + k) as covered from m, (select unnest(generate_series(0, 7)) as k) group by all) select doc_id, item_id, longest, covered from l join c using (doc_id, item_id)",
        "p8_found": f"with d as ({_grams('doc_id', 'documents')}), p as ({_grams('item_id', 'eval_passages')}) select distinct doc_id, cast(item_id as bigint) as item_id from d join p using (gram)",
    }
