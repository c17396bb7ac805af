"""Whole pipelines over DataFrames. Language models are passed in: generate(rows with item_id and prompt) gives (item_id, raw)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.functions import text as T
from sparklex.operators import assign, candidates, decide, lexicon, pool, retrieval, stats, synth
from sparklex.operators.mix import shuffled_rank, train_pool_split
from sparklex.plans.config import DEFAULTS
from sparklex.runtime import checkpointed

Generate = Callable[..., DataFrame]


def mt(items: DataFrame, memory: DataFrame | None, source: str, target: str, generate: Generate, k: int = DEFAULTS["exemplar_k"]) -> DataFrame:
    """items (item_id, dataset_id, sent_id, source) with pred: exemplars from the memory (row_idx, src, tgt) if there is one,
    prompt, extraction."""
    if memory is None:
        prompts = items.withColumn("prompt", T.mt_prompt("source", T.LANGUAGE[source], T.LANGUAGE[target], F.array().cast("array<struct<src:string,tgt:string>>")))
        return items.join(generate(prompts.select("item_id", "prompt")), "item_id", "left").withColumn("pred", T.mt_translation("raw", target)).drop("raw")
    near = retrieval.char_similarity(items.select(F.col("item_id").alias("query_id"), F.col("source").alias("text")), memory, k)
    shots = near.join(memory, "row_idx").groupBy(F.col("query_id").alias("item_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "src", "tgt"))), lambda e: F.struct(e["src"].alias("src"), e["tgt"].alias("tgt"))).alias("shots"))
    prompts = items.join(shots, "item_id", "left").withColumn("prompt", T.mt_prompt("source", T.LANGUAGE[source], T.LANGUAGE[target], F.col("shots")))
    return items.join(generate(prompts.select("item_id", "prompt")), "item_id", "left").withColumn("pred", T.mt_translation("raw", target)).drop("raw")


def qa(items: DataFrame, generate: Generate, slot_scores: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """items (item_id, question_id, context, question, possible_answers) with pred, the number of an option.

    With slot_scores, which gives (question_id, scores) for items that ask for a gap, the best option of the gap overrides
    the generated one, and in blocks with shared options the global assignment does.
    """
    prompts = items.select("item_id", T.qa_prompt("context", "question", "possible_answers").alias("prompt"))
    out = items.join(generate(prompts), "item_id", "left").withColumn("pred", T.valid_option(T.first_number("raw"), F.col("possible_answers"))).drop("raw")
    if slot_scores is None:
        return out
    gaps = assign.gap_blocks(items)
    filled = gaps.select("question_id").join(items, "question_id").withColumn("gap", T.target_gap("question"))
    options = filled.select("question_id", F.posexplode(T.sorted_options("possible_answers")).alias("opt", "o"), "context", "gap").select("question_id", F.col("opt").alias("option"), T.fill_gap("context", "gap", F.col("o.v")).alias("sentence"))
    scored = slot_scores(options)  # (question_id, option, score)
    rows = scored.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("option", "score"))), lambda e: e["score"]).alias("scores"))
    blocks = gaps.join(rows, "question_id")
    single = blocks.where("not shared").select("question_id", F.expr("array_position(scores, array_max(scores))").cast("int").alias("pred"))
    shared = assign.slot_order(blocks.where("shared"), "block", "question_id")
    picked = assign.assign_blocks(shared.select("block", "slot", "scores")).where("choice is not null").join(shared.select("block", "slot", "question_id"), ["block", "slot"]).select("question_id", (F.col("choice") + 1).alias("pred"))
    return decide.override(out, single.unionByName(picked), "question_id")


def word_candidates(words: DataFrame, forms: DataFrame, maps: list[str], frequency: DataFrame, task: str, cap: int, dictionary: DataFrame | None = None, most: int = candidates.MOST) -> DataFrame:
    """(word, candidate, cnt, rank): paradigms for grammar; for spelling diacritics, words within an edit (two if the word
    isn't known) and, for unknown words, paradigms."""
    index = lexicon.form_index(forms)
    rename = lambda df, col: df.select("word", F.col(col).alias("candidate"))
    if task == "gc":
        return candidates.rank_candidates([rename(lexicon.paradigm(words, forms, cap), "form")], frequency, index, most)
    marked = lexicon.known_words(words, index)
    known, unknown = marked.where("known").select("word"), marked.where("not known").select("word")
    stems = (forms if dictionary is None else dictionary).select(F.col("form").alias("word"))
    sources = [rename(lexicon.diacritic_variants(words, maps), "variant"), rename(lexicon.within_edits(known, stems, 1), "match"), rename(lexicon.within_edits(unknown, stems, 2), "match"), rename(lexicon.paradigm(unknown, forms, cap), "form")]
    return candidates.rank_candidates(sources, frequency, index, most)


def sc_gc(items: DataFrame, task: str, lang: str, generate: Generate, forms: DataFrame, maps: list[str], mono: DataFrame, scorer: candidates.SentenceScorer | None = None, fitted: dict = DEFAULTS) -> DataFrame:
    """items (item_id, sentence) with pred_incorrect and pred_corrected: the model's flag and the engine's, decided between.

    `fitted` holds the settings by language: weight and threshold of the witness, the least frequency of the diacritic
    top-up (None where it is off) and the margin from which the last one acts (None likewise).
    """
    unigrams, bigrams = checkpointed(stats.unigrams(mono, "text")), checkpointed(stats.bigrams(mono, "text"))
    score = scorer or candidates.bigram_scorer(unigrams, bigrams)
    raw = generate(items.select("item_id", T.sc_gc_prompt("sentence", task).alias("prompt")))
    # Written down, so that the model answers each prompt once.
    flagged = checkpointed(items.join(raw, "item_id", "left").select("item_id", "sentence", T.wrong_word("raw").alias("word"), T.corrected_word("raw").alias("correction")))
    words = candidates.sentence_cores(items).select(F.col("core").alias("word")).distinct()
    cand = checkpointed(word_candidates(words, forms, maps, unigrams, task, fitted["gc_paradigm_cap" if task == "gc" else "sc_paradigm_cap"], most=fitted["max_cand"]))
    solo = checkpointed(candidates.best_edit(items, cand, score).select("item_id", F.col("word").alias("eng_w"), F.col("corrected").alias("eng_c"), "margin"))
    fixed = candidates.constrained_correction(flagged.where("word <> '' and word <> 'CORRECT'"), cand, score).select("item_id", F.col("word").alias("co_w"), F.col("corrected").alias("co_c"))
    rows = flagged.select("item_id", "sentence", F.col("word").alias("v5_w"), F.col("correction").alias("v5_c")).join(solo, "item_id", "left").join(fixed, "item_id", "left")
    if task == "gc":
        fit = fitted["witness"][lang]
        seen = stats.witness(rows.withColumns({"observed": F.col("eng_w"), "candidate": F.col("eng_c")}), bigrams)
        out = decide.arbitrate(seen, fit["w"], fit["t"])
    else:
        first = rows.withColumns({"word": F.coalesce(F.nullif("co_w", F.lit("")), F.lit(T.CORRECT)), "corrected": F.coalesce(F.nullif("co_c", F.lit("")), F.lit(T.CORRECT))})
        least = fitted["diacritic"][lang]
        top = decide.nonword_topup(items, forms, unigrams, maps, least) if least is not None else items.select("item_id", F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("corrected")).where("false")
        out = decide.sc_cascade(first, top, fitted["tau"][lang])
    return items.join(out.select("item_id", F.col("word").alias("pred_incorrect"), F.col("corrected").alias("pred_corrected")), "item_id", "left")


def mr(items: DataFrame, generate: Generate, dev: DataFrame | None = None, threshold: float = DEFAULTS["sim_threshold"], ladder: bool = True, formatted: bool = True) -> DataFrame:
    """items (item_id, id, question) with pred and stage: generation, ladder and format unless switched off. With dev (idx, text, answer) the
    answer of a question that stands there overrides; this is off by default, as it answers from held-out material."""
    prompts = items.select("item_id", T.mr_prompt("question").alias("prompt"))
    first = prompts.join(generate(prompts), "item_id", "left")
    laddered = decide.retry_ladder(first, generate) if ladder else first.withColumn("stage", F.lit(0))  # a rung is written down
    answers = items.join(laddered.select("item_id", T.mr_answer("raw").alias("_a"), "stage"), "item_id", "left")
    out = answers.withColumn("pred", T.postformat("_a", T.tier_of("id")) if formatted else F.coalesce("_a", F.lit(""))).drop("_a")
    if dev is None:
        return out
    hits = retrieval.fuzzy_lookup(items.select(F.col("item_id").alias("query_id"), F.col("question").alias("text")), dev, threshold)
    return decide.override(out, hits.select(F.col("query_id").alias("item_id"), F.col("answer").alias("pred")), "item_id")


def clean_pool(pairs: DataFrame, tests: list[DataFrame], fields: list[str], dev: DataFrame | None = None, cap: int = DEFAULTS["pool_cap"]) -> tuple[DataFrame, DataFrame]:
    """(pool, funnel) of pairs (direction, row_idx, src, tgt) cleaned of the tests' texts."""
    block = pool.union_blocklists([pool.blocklist(t, fields) for t in tests])
    return pool.build_pool(pairs, block, dev, cap), pool.funnel(pairs, block, dev, cap)


def synthesise(mono: DataFrame, task: str, lang: str, held_out: DataFrame, seed, pool_size: int, volume: int | None = None, share: float = 0.5, vocabulary: list[str] | None = None) -> DataFrame:
    """(ord, part, messages): synthetic training rows of the task from texts (ord, text) that aren't held out (text).

    The texts are shuffled by lot, errors or questions made, rendered, and split into pool and train.
    """
    rows = pool.exclude(mono.select("ord", "text"), "text", held_out, key=T.fold_key)
    if task == "qa":
        made = synth.cloze(rows, "text", "ord", vocabulary or [], seed)
        chat = T.render_qa("context", "question", "possible_answers", "correct_answer_num")
    else:
        made = synth.inject_typos(rows, "text", "ord", seed, share) if task == "sc" else synth.inject_endings(rows, "text", "ord", lang, seed, share)
        chat = T.render_sc_gc("input_sentence", "incorrect_word", "correct_word", task)
    return train_pool_split(made.select("ord", chat.alias("messages")), seed, "ord", pool_size, volume)


def calibrated(mono: DataFrame, dev: DataFrame, forbidden: DataFrame, forms: DataFrame, n: int, seed) -> DataFrame:
    """(ord, input_sentence, original_sentence, incorrect_word, correct_word): n rows with the endings and the share of clean
    rows learned from the even half of dev; forbidden texts come in neither before nor after the change."""
    learn = stats.learning_half(dev, "id")
    transforms = stats.suffix_taxonomy(learn, "incorrect_word", "correct_word")
    bare = mono.select("ord", T.unquoted("text").alias("text")).where(T.length_ok("text", 5, 40) & T.is_upper("text"))
    texts = pool.exclude(bare.select("ord", T.norm("text").alias("text")), "text", forbidden)
    rate = stats.clean_rate(learn, "incorrect_word").first()["clean_rate"] or 0.0
    clean_n = int(n * rate)
    ranked = shuffled_rank(texts, seed, "ord", name="_rank")
    clean = ranked.where(F.col("_rank") < clean_n).select("ord", F.col("text").alias("input_sentence"), F.col("text").alias("original_sentence"), F.lit(T.CORRECT).alias("incorrect_word"), F.lit(T.CORRECT).alias("correct_word"))
    wrong = synth.calibrated_corruption(ranked.where(F.col("_rank") >= clean_n).drop("_rank"), "text", "ord", transforms, lexicon.form_index(forms), seed)
    kept = pool.cap_first(shuffled_rank(pool.exclude(wrong, "input_sentence", forbidden), seed, "ord", name="_rank"), "_rank", n - clean_n).drop("_rank")
    return clean.unionByName(kept)


def maths_rows(seeds: DataFrame, translated: DataFrame) -> DataFrame:
    """(seed_id, tier, messages) of seeds (seed_id, tier, question_en, answer, rationale_en) with their translations
    (seed_id, question, rationale). Unsafe answers and degenerate questions are dropped; a degenerate or long rationale is
    left out of the row."""
    rows = seeds.where(T.answer_is_safe("answer")).join(translated, "seed_id").where(~T.is_degenerate("question", "question_en"))
    steps = F.when(~T.is_degenerate("rationale", "rationale_en") & (F.length("rationale_en") <= 2000), F.col("rationale"))
    return rows.select("seed_id", "tier", T.render_mr("question", "answer", steps).alias("messages"))
