"""Defective pairs, truncation, languages, packing, toxicity."""

import collections
import importlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparklex.llm import completeness, language, packing, pairs, toxicity, truncation

SF = "/root/testdata/sf0.01"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# The automaton and the model of ends


def test_pushdown():
    assert completeness.unclosed("a (b [c") == ["(", "["]
    assert completeness.unclosed("„a“ “b” «c» »d« (e)") == []
    assert completeness.unclosed("<a> x <b> y </b>") == ["<a>"] and completeness.unclosed("<br> x <i/>") == []
    assert completeness.unclosed("```x") == ["```"] and completeness.unclosed("```x```") == []
    assert completeness.unclosed("„a „b“") == ["„"]
    assert completeness.unclosed("- a\n- b\n-") == completeness.unclosed("a\n1. x\n2.") == ["•"] and completeness.unclosed("- a\n- b") == completeness.unclosed("2.") == completeness.unclosed("– nic\n- a") == []
    assert completeness.unclosed("1. a (b\n2. c") == ["("] and completeness.unclosed("```\n- a\n- ") == ["```", "•"]
    for text, want in (("abc�", "broken"), ("abc\\u00", "broken"), ("x <corr", "broken"), ("abc,", "hanging"), ("abc.", "terminated"), ("abc.“", "terminated")):
        assert getattr(completeness.structure(text), want), text
    assert completeness.structure("abc [...]").marker == "[...]" and completeness.structure("abc…").body == "abc"
    assert completeness.structure("").open == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_automaton_takes_any_text(text):
    completeness.structure(text)
    pairs.is_refusal(text)
    language.is_placeholder(text)
    toxicity.plain_tokens(text)


@pytest.fixture(scope="module")
def preds(spark):
    return spark.read.parquet(f"{SF}/mt_preds.parquet").select(F.col("pred_id").alias("rec_id"), "source", F.col("direction").alias("kind"), F.col("pred").alias("text"))


@pytest.fixture(scope="module")
def end_model(preds):
    return truncation.sample_end_model(preds)


def test_cut_sentences_are_found(preds, end_model):
    """Held-out accuracy: whole sentences of the rest, cut at random places and with the final mark taken away."""
    whole = [r for r in preds.where("rec_id > 1200").collect() if r["text"] and r["text"].endswith(".") and r["source"] and r["source"].endswith(".") and len(r["text"]) > 40]
    rng = random.Random(2)
    found = missed = wrong = 0
    for r in whole:
        at = rng.randrange(10, len(r["text"]) - 8)
        if r["text"][at - 1] in ".!?" or r["text"][:at].rstrip()[-1] in ".!?“":
            continue
        found += completeness.broken_off(r["text"][:at], r["source"], r["kind"], end_model) is not None
        missed += completeness.broken_off(r["text"][:at], r["source"], r["kind"], end_model) is None
        wrong += completeness.broken_off(r["text"][:-1], r["source"], r["kind"], end_model) is not None
    assert found + missed > 200 and missed <= 0.03 * (found + missed) and wrong <= 0.05 * (found + missed)


def test_truncated_texts(spark, end_model):
    whole = "Der alte Hund schrieb heute 17 Briefe."
    df = spark.createDataFrame([(1, whole, "de-hsb", "Stary pos dźensa napisa 17 listow."), (2, whole, "de-hsb", "Stary pos dźensa nap…"), (3, whole, "de-hsb", "Stary pos (dźensa"), (4, whole, "de-hsb", None), (5, whole, "de-hsb", ""), (6, None, None, "Stary pos,"), (7, whole, "de-hsb", "..."), (8, whole, "de-hsb", "Stary �")], "rec_id long, source string, kind string, text string")
    clash = df.withColumns({"reason": F.lit("x"), "label": F.lit(1)})
    assert [r[0] for r in rows(truncation.truncated_texts(clash, end_model), "rec_id")] == [2, 3, 6, 8]
    assert truncation.truncated_texts(df.where("false")).count() == 0
    long = spark.createDataFrame([(1, whole, "de-hsb", "Stary pos dźensa napisa 17 listow. " * 3000 + "Stary pos (")], "rec_id long, source string, kind string, text string")
    assert truncation.truncated_texts(long, end_model).count() == 1


def test_a_missing_mark_is_weighed_by_its_origin(spark, preds, end_model):
    """An origin that leaves marks off whole sentences is believed more than one that doesn't."""
    whole = [r for r in preds.collect() if r["text"] and r["text"].endswith(".") and r["source"] and r["source"].endswith(".")][:400]
    near = [r for r in preds.collect() if r["text"] and r["source"] and (e := completeness.end_evidence(r["text"].rstrip(".!? "), r["source"], r["kind"], end_model)[1]) is not None and -completeness.np.log(1.6) < e < completeness.np.log(1.6)][:20]
    assert near
    data = [(i, r["source"], r["kind"], r["text"][:-1] if o == "lax" else r["text"][:30], o) for o in ("lax", "strict") for i, r in enumerate(whole)]
    data += [(1000 + i, r["source"], r["kind"], r["text"].rstrip(".!? "), o) for o in ("lax", "strict") for i, r in enumerate(near)]
    df = spark.createDataFrame([*data, (5000, None, None, None, None), (5001, None, None, "", "other")], "rec_id long, source string, kind string, text string, site string").withColumns({"origin": F.lit(1), "n": F.lit(2)})
    got = truncation.judged_texts(df, end_model, ["site"])
    assert got.columns == ["rec_id", "reason", "site"] and got.count() == len(data) + 2
    cut = {o: got.where(F.col("rec_id").between(1000, 1999) & (F.col("site") == o) & F.col("reason").isNotNull()).count() for o in ("lax", "strict")}
    assert cut["lax"] < cut["strict"]
    assert [r["site"] for r in got.where("rec_id >= 5000").orderBy("rec_id").collect()] == [None, "other"]


# Languages


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/mt_preds.parquet").select(F.lit("pred").alias("field"), F.col("pred_id").alias("rec_id"), F.col("pred_lang").alias("label"), F.col("pred").alias("text"))


@pytest.fixture(scope="module")
def profiles(labelled):
    return language.sample_profiles(labelled)


def test_trigram_table_equals_the_vectors(profiles):
    """The looked-up products are those of bound and bundled vectors."""
    letters = language.letter_vectors()
    protos = np.random.default_rng(0).normal(size=(6, language.DIMENSIONS)).astype(np.float32)
    p = language.Profiles(sorted(language.SEED_TEXT), protos, letters)
    codes, counts, _ = language.trigrams(["Čehodla dom"])
    vector = language.bind(codes, letters).astype(np.float64).sum(0)
    want = vector @ (protos / np.linalg.norm(protos, axis=1, keepdims=True)).T / np.sqrt(language.DIMENSIONS * counts[0])
    assert np.allclose(p.cosines(["Čehodla dom"])[0][0], want, atol=1e-4)


def test_languages_of_unseen_text(profiles):
    """Sentences that are in no fitted table."""
    texts = {"de": "Gestern sind wir mit dem Zug nach Hause gefahren, weil es so stark geregnet hat.", "en": "Yesterday we went home by train because it was raining so heavily outside.", "cs": "Včera jsme jeli vlakem domů, protože venku velmi silně pršelo.", "pl": "Wczoraj pojechaliśmy pociągiem do domu, ponieważ bardzo mocno padało.", "hsb": "Wčera smy z ćahom domoj jěli, dokelž je so wonka jara sylnje dešćowało.", "dsb": "Cora smy ze śěgom domoj jěli, dokulaž jo se wence wjelgin mócnje dejšćowało."}
    got = {k: [s[0] for s in language.segments(profiles, [t])[0]] for k, t in texts.items()}
    assert got == {k: [k] for k in texts}
    mixed = f"{texts['de']} {texts['hsb']}\n{texts['hsb']} {texts['de']}"
    assert [s[0] for s in language.segments(profiles, [mixed])[0]] == ["de", "hsb", "de"]


def test_fit_does_not_depend_on_the_order_of_the_sample(labelled):
    sample = [(r["text"], r["label"]) for r in labelled.collect()]
    tables = []
    for order in range(5):
        rng = random.Random(order)
        own = [sample, sorted(sample, key=str), sorted(sample, key=str, reverse=True)][order] if order < 3 else rng.sample(sample, len(sample))
        tables.append(language.fit_profiles([t for t, _ in own], [x for _, x in own]).table.tobytes())
    assert len(set(tables)) == 1
    for n in (1, 3, 7):
        assert language.sample_profiles(labelled.repartition(n)).table.tobytes() == tables[0]


def test_neighbours_decide_short_sentences(profiles):
    hsb, de = "Dom steji pola wulkeho štoma pódla rěki a w nim bydla štyrjo starši ludźo.", "Das Haus steht am Fluss, und der Hund schläft."
    assert [s[0] for s in language.segments(profiles, [f"{hsb} 17. To je. {hsb}"])[0]] == ["hsb"]
    assert [s[0] for s in language.segments(profiles, [f"{hsb} {de} {de} {hsb}"])[0]] == ["hsb", "de", "hsb"]
    assert len(language.segments(profiles, ["Ja."])[0]) == 1 and language.segments(profiles, ["x", "1 a 2", "<b> 3 </b>", ""]) == [[], [], [], []]


def test_path_is_the_best_of_all(profiles):
    rng = np.random.default_rng(4)
    for _ in range(40):
        e = rng.normal(0, 0.2, (5, 3)).astype(np.float32)
        value = lambda path, e=e: sum(e[i, k] for i, k in enumerate(path)) - language.SWITCH * sum(a != b for a, b in zip(path, path[1:]))
        best = max(value(p) for p in itertools.product(range(3), repeat=5))
        assert abs(value(language._cheapest_path(e).tolist()) - best) < 1e-5


def test_label_cases(spark, profiles):
    de, hsb = "Das Haus steht am Fluss und der Hund schläft.", "Dom steji pola rěki a pos spi w zahrodźe."
    df = spark.createDataFrame([("pred", 1, "de", de), ("pred", 2, "DEU", de), ("pred", 3, "hsb", de), ("pred", 4, None, hsb), ("pred", 5, "und", hsb), ("pred", 6, " ", hsb), ("pred", 7, "hsb", f"{hsb} {de}"), ("pred", 8, None, None), ("pred", 9, None, ""), ("pred", 10, "de", "..."), ("pred", 11, None, "N/A"), ("pred", 12, None, "<a> 17 </a>"), ("content", 1, "de", f"<answer> {de} </answer>")], "field string, rec_id long, label string, text string")
    got = rows(language.label_cases(df.withColumns({"lang": F.lit("xx"), "seg_no": F.lit(9)}), profiles), "field", "rec_id", "seg_no", "lang")
    assert got == [("pred", 3, 1, "de"), ("pred", 4, 1, "hsb"), ("pred", 5, 1, "hsb"), ("pred", 6, 1, "hsb"), ("pred", 7, 1, "hsb"), ("pred", 7, 2, "de")]
    assert language.label_cases(df.where("false")).count() == 0
    assert all(0 <= r["confidence"] <= 1 for r in language.language_segments(df, profiles).collect())
    long = spark.createDataFrame([("pred", 1, "de", f"{hsb} " * 4000)], "field string, rec_id long, label string, text string")
    assert rows(language.label_cases(long, profiles), "seg_no", "lang") == [(1, "hsb")]


def test_labels_mostly_agree(labelled, profiles):
    got = language.language_segments(labelled, profiles).where("segments = 1 and label in ('hsb', 'dsb', 'de')")
    assert got.where("lang = label").count() > 0.9 * got.count() > 1000


# Pairs


def test_pairs_of():
    m = lambda r, c: {"role": r, "content": c}
    assert pairs.pairs_of([m("system", "s"), m(" USER", "a"), m("Model", "b"), m("human", "c"), m("user", "d"), m("assistant", None)]) == [(1, "a", "b"), (2, "c", None), (3, "d", None)]
    assert pairs.pairs_of(None) == pairs.pairs_of([]) == pairs.pairs_of([None]) == []


def test_messages_are_read_by_columns():
    kind = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
    m = lambda r, c: {"role": r, "content": c}
    data = [[m("user", "a"), None, m("assistant", "b")], None, [], [m(None, "z")], [m("User", None)], [m("user", "q"), m("bot", "r")]]
    column = pa.array(data, kind)
    for part, want in ((column, data), (column.slice(2, 4), data[2:]), (column.slice(0, 1), data[:1]), (column.slice(0, 0), [])):
        assert [pairs._paired(turns) for turns in pairs._turns(part)] == [pairs.pairs_of(x) for x in want]


def test_refusals():
    for text in ("I'm sorry, but I can't help with request.", "Leider kann ich diese Bitte nicht prüfen.", "Bohužel njemóžu tutu prašenje pruwować.", "Bóžko njamogu toś tu pšašanje wótegroniś.", "As a language model I cannot answer the text you sent. I must decline to check this task.", "Nemohu přeložit tuto větu.", "Nie mogę przetłumaczyć tego zdania."):
        assert pairs.is_refusal(text), text
    for text in ("", "Dalši wjes njemóžu skónčnje pomhać, pisaše Plogirt z Sazobrow, přetož tu 381 worjecha!", "Der Hund kann heute nicht helfen.", "Er sagte nichts. I must decline to check this task."):
        assert not pairs.is_refusal(text), text


def test_refusals_with_figures_length_and_apologies():
    for text in ("I am sorry. I cannot help with this request.", "I cannot answer question 3.", "Satz 2 kann ich nicht übersetzen.", "1. I cannot help with this request.", "I cannot help with this request. " * 30):
        assert pairs.is_refusal(text) and pairs.declines(text, "Der alte Hund öffnete 17 Türen."), text
    source = "Diesem Lehrer kann ich nicht helfen, schrieb Nelota aus Brobrow, denn dies sind 487 Seen."
    assert pairs.is_refusal(source) and not pairs.declines("I cannot help this teacher with that, wrote Nelota from Brobrow, for these are 487 lakes.", source)
    assert not pairs.declines("I cannot help this teacher with that, wrote Nelota from", source)
    assert pairs.declines("I'm sorry, but I can't help with this text.", source)


def test_refusals_in_other_languages():
    for text in ("No puedo ayudar con esta solicitud.", "Lo siento. No puedo traducir este texto.", "Je ne peux pas traduire cette phrase.", "Извините, я не могу перевести этот текст.", "Não posso ajudar com este pedido.", "Ik kan deze zin niet vertalen.", "Jag kan inte översätta den här texten.", "Mi dispiace, non posso tradurre questa frase.", "Вибачте, я не можу перекласти цей текст.", "Žao mi je. Ne mogu prevesti ovu rečenicu.", "Prepáčte, nemôžem preložiť túto vetu."):
        assert pairs.is_refusal(text), text
    for text in ("El perro no puede dormir.", "Il chien dort.", "Он не может спать."):
        assert not pairs.is_refusal(text), text


def test_asked_language_is_read_from_the_whole_message():
    for user, want in (("Please help. Translate into German: x", "de"), ("Here is a sentence.\nTranslate it into German.", "de"), ("From German to Upper Sorbian, please\n\nGerman: Ich fahre.\nUpper Sorbian:", "hsb"), ("Fix the sentence.\n<sentence> Er antwortet auf Deutsch </sentence>", None), ("Translate into Czech.\n\nHe may answer in German.", "cs"), ("", None)):
        assert pairs.asked_language(user) == want, user


def test_short_copies_and_short_foreign_replies(profiles):
    assert pairs.gives_back("tři małe kočki", "Translate into German: tři małe kočki") and not pairs.gives_back("Jan Nowak 17", "Translate: Jan Nowak 17") and not pairs.gives_back("4", "4") and not pairs.gives_back("tři kočki", "Translate: tři małe kočki")
    at = profiles.languages.index("hsb")
    for reply, want in (("Das ist sehr gut. Ich bin da. Er ist hier.", True), ("To je dobre. Sym tu. Wón je tam.", False), ("Das Haus ist heute sehr schön.", True), ("17.", False)):
        cos, letters = profiles.cosines(completeness.sentences(reply))
        assert pairs.Judge.elsewhere(cos, letters, at, True) == want, reply


def test_tiling():
    task = "a b c d e f g h".split()
    assert pairs.tiled_share("a b c d e f g h".split(), task) == 1 and pairs.tiled_share("x y z".split(), task) == 0
    assert pairs.tiled_share("d e f g a b c x".split(), task) == 0.5 and pairs.tiled_share([], task) == 0
    assert pairs.gives_back("„A B C d e f G h“", "task: a b c d e f g h.") and pairs.gives_back("a b c d e\na b c d e", "a b c d e")
    assert not pairs.gives_back("a b c d x y z", "a b c d e f") and pairs.gives_back("a b", "a b") and not pairs.gives_back("a", "a")


def test_fits_do_not_depend_on_the_order_of_the_sample(spark, preds):
    training = [(r["task"] or "", r["direction"] or "", r["lang"], [m.asDict() for m in r["messages"] or []]) for r in spark.read.parquet("/root/testdata/sf0.001/training.parquet").collect()]
    texts = [(r["text"], r["source"], r["kind"]) for r in preds.limit(300).collect()]
    judges, ends = [], []
    for order in range(3):
        rng = random.Random(order)
        judge = pairs.fit_judge(sorted(training, key=str) if order == 0 else rng.sample(training, len(training)))
        judges.append((judge.profiles.table.tobytes(), judge.ends.weights.tobytes(), sorted(judge.closings.items())))
        ends.append(completeness.fit_end_model(sorted(texts, key=str) if order == 0 else rng.sample(texts, len(texts))).weights.tobytes())
    assert judges[0] == judges[1] == judges[2] and ends[0] == ends[1] == ends[2]


def test_defective_pairs(spark):
    training = spark.read.parquet(f"{SF}/training.parquet")
    judged = pairs.judged_pairs(training)
    users = training.select(F.explode("messages").alias("m")).where(F.lower(F.trim("m.role")).isin("user", "human")).count()
    assert judged.count() == users
    counts = collections.Counter(r["defect"] for r in judged.collect())
    assert set(counts) == {None, "empty", "truncated", "refusal", "copy", "language"} and 0.02 < 1 - counts[None] / users < 0.12
    source = "Gestern öffnete der alte Hund bei Lübben 17 Türen, weil der kleine Baum dort nichts hatte."
    user = f"From German to Upper Sorbian, please\n\nGerman: {source}\nUpper Sorbian:"
    good = "Wčera wočini stary pos pola Lubnjowa 17 durjow, dokelž mały štom tam ničo njeměješe."
    replies = {1: good, 2: None, 3: " ", 4: "[no answer]", 5: source, 6: source.lower()[:-1], 7: "I'm sorry, but I can't help with this text.", 8: "Yesterday the old dog opened 17 doors near Lübben because the little tree had nothing there.", 9: good[:45], 10: "<hsb></hsb>", 11: good[:-1]}
    rows_ = [(k, "mt", "de-hsb", "hsb", [("User ", user), ("assistant", r)], "extra") for k, r in replies.items()] + [(20, "mt", "de-hsb", "hsb", [("user", user)], "x"), (21, None, None, None, None, None), (22, "mt", "de-hsb", None, [], None)]
    df = spark.createDataFrame(rows_, "row_id long, task string, direction string, lang string, messages array<struct<role:string,content:string>>, defect string")
    sample = [(r["task"], r["direction"], r["lang"], [m.asDict() for m in r["messages"]]) for r in training.collect()]
    judge = pairs.fit_judge([(t, d or "", lang, m) for t, d, lang, m in sample])
    got = dict(rows(pairs.defective_pairs(df, judge), "row_id", "defect"))
    assert got == {2: "empty", 3: "empty", 4: "empty", 5: "copy", 6: "copy", 7: "refusal", 8: "language", 9: "truncated", 10: "empty", 20: "empty"}
    assert pairs.defective_pairs(df.where("false")).count() == 0


# Packing


def check_packing(got, sizes, capacity):
    """Every text whole in one container unless longer than it, no container over its capacity, unused as told."""
    per, parts = collections.defaultdict(list), collections.Counter()
    for r in got:
        per[r["container"]].append(r)
        parts[r["doc_id"]] += r["n_tokens"]
        assert r["n_tokens"] <= capacity
    assert dict(parts) == {d: n for d, n in sizes.items() if n > 0}
    for members in per.values():
        used = sum(r["n_tokens"] for r in members)
        assert used <= capacity and all(r["unused"] == capacity - used for r in members)
    by_doc = collections.Counter(r["doc_id"] for r in got)
    assert all(by_doc[d] == -(-n // capacity) for d, n in sizes.items() if n > 0)
    return len(per)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_ROWS", 100)  # several buckets
    rng = random.Random(1)
    sizes = {i: min(4000, int(rng.lognormvariate(4, 1.2))) for i in range(3000)} | {9000: 0, 9001: 64, 9002: 65, 9003: 128, 9004: 100_000}
    df = spark.createDataFrame(sorted(sizes.items()), "doc_id long, n_tokens long").withColumns({"capacity": F.lit("clash"), "rank": F.lit(0)})
    got = packing.pack(df, [64, 256, None, 256])
    for capacity in (64, 256):
        n = check_packing(got.where(F.col("capacity") == capacity).collect(), sizes, capacity)
        assert n <= -(-sum(sizes.values()) // capacity) * 1.02 + 2
    assert packing.pack(df.where("false"), [64]).count() == 0 and packing.pack(df, []).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(1, 30))
def test_plan_covers_the_histogram(lengths, capacity):
    histogram = np.bincount([x for x in lengths if x <= capacity], minlength=capacity + 1)
    used = np.zeros_like(histogram)
    for pattern, n in packing.plan(histogram, capacity):
        assert n > 0 and sum(pattern) <= capacity
        for x in pattern:
            used[x] += n
    assert (used == histogram).all()


def test_token_counts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    assert tiktoken
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "žołty <|endoftext|>"), (5, "a " * 5000)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = dict(rows(packing.token_counts(df), "doc_id", "n_tokens"))
    assert set(got) == {1, 4, 5} and got[1] == 2 and got[5] >= 5000


# Toxicity


def test_disguises():
    assert toxicity.plain_tokens("Ty h ł u p a k, zalěz!") == toxicity.plain_tokens("Ty hłupak zalez")
    assert toxicity.plain_tokens("1d1ot idіot IDIOOOT i.d.i.o.t") == ["idiot"] * 4
    assert toxicity.plain_tokens("b*****d 17") == ["b*d", "9"] and toxicity.plain_tokens("") == []


def test_counterfactuals_exchange_one_kind_only():
    ex = toxicity.Examples(["Gestern kam Nelota mit dem Haus und den Sorben.", "Der Hund sieht das Haus.", "Juden feiern heute."], 3)
    assert toxicity.is_identity("Sorbinnen") and toxicity.is_identity("Juden") and not toxicity.is_identity("Haus") and not toxicity.is_identity("juden")
    assert toxicity.names_in("Der Hund Rex sah Juden.") == ["Hund", "Rex", "Juden"] and toxicity.names_in("Juden feiern.") == ["Juden"]
    assert ex.pairs.tolist() == [0, 2]
    same = toxicity.encode(["Der Hund sieht das Haus."])[0]
    assert set(same[:1]) <= set(ex.cells)


def test_toxicity(spark):
    documents, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/doc_labels.parquet")
    judged = labels.where("toxic is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("y"))
    data = [(r["text"], r["y"]) for r in documents.join(judged, "doc_id").where("length(text) > 0").orderBy("doc_id").collect()]
    held = data[1::3]
    model = toxicity.fit_toxicity([t for i, (t, _) in enumerate(data) if i % 3 != 1], [y for i, (_, y) in enumerate(data) if i % 3 != 1])
    scores = toxicity._document_scores(model, [t for t, _ in held])
    wrong = sum((s >= toxicity.THRESHOLD) != (y > 0.5) for s, (_, y) in zip(scores, held))
    assert wrong <= 0.12 * len(held)  # the judgements themselves err
    # Names carry no score.
    text = "{} su na swjedźeń přeprosyli, praji {} z {}."
    got = toxicity._document_scores(model, [text.format(*x) for x in (("Serbja", "Hańža", "Budyšin"), ("Polacy", "Jan", "Choćebuz"), ("Morwaks", "Meto", "Wojerecy"))])
    assert got.max() < toxicity.THRESHOLD
    # Nor do peoples, faiths and sexes in neutral sentences: false positives by group.
    neutral = ("Die {} feierten gestern ein Fest im Dorf.", "Viele {} leben heute in der Stadt.", "Der Lehrer sprach über die Geschichte der {}.", "The {} celebrated a feast in the village yesterday.", "Many {} live in this town today.", "Serbja a {} su wčera swjedźeń swjećili.", "W tutej wsy bydla tež {}.", "W toś tej jsy bydle teke {}.")
    rates = {g: float(np.mean(toxicity._document_scores(model, [t.format(g) for t in neutral]) >= toxicity.THRESHOLD)) for g in toxicity.IDENTITY_TERMS}
    assert max(rates.values()) == 0, rates
    spread = [toxicity._document_scores(model, [t.format(g) for g in toxicity.IDENTITY_TERMS]) for t in neutral]
    assert max(x.max() - x.min() for x in spread) < 0.1
    df = spark.createDataFrame([(1, None, "s"), (2, "", None), (3, "You are a stupid idiot.", "s"), (4, "x " * 30000 + "you are a stupid idiot", "s")], "doc_id long, text string, source string").withColumn("score", F.lit("clash"))
    got = dict(rows(toxicity.toxicity_scores(df, model=model), "doc_id", "score"))
    assert got[1] == got[2] == 0 and got[3] >= toxicity.THRESHOLD
    assert toxicity.toxicity_scores(df.where("false"), labels.where("false")).count() == 0


# Queries


def test_queries_run(spark):
    queries = importlib.import_module("sparklex.llm.queries").queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 8, 9)} | {"p7_containers"} <= set(queries)
    columns = {"p1_found": ["row_id", "pair_no", "defect"], "p2_found": ["first_id", "copy_id"], "p3_found": ["field", "id_a", "id_b"], "p4_found": ["pred_id"], "p5_found": ["eval_table", "item_key", "row_id"], "p6_found": ["field", "rec_id", "seg_no", "lang"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}
    for name, f in queries.items():
        df = f(spark, "/root/testdata/sf0.001")
        assert df.count() == df.distinct().count()
        assert columns.get(name, df.columns) == df.columns
