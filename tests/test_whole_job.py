"""Queries on small tables of their own, where a part of the job left out would show."""

import random

import pytest

from sparklex.operators import synth
from sparklex.plans import catalogue

ITEMS = "item_key long, split string, task string, lang string, input_sentence string, original_sentence string, incorrect_word string, correct_word string"


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    good = "tu steji wulka kniha"
    rows = [(100 + i, "test", "sc", "hsb", good, good, "CORRECT", "CORRECT") for i in range(6)]
    rows += [(200 + i, "test", "gc", "hsb", "wón čita knihami", "wón čita knihami", "CORRECT", "CORRECT") for i in range(6)]
    rows += [(300 + i, "test", "sc", "hsb", "tu steji wulka knjha", good, "knjha", "kniha") for i in range(4)]  # an error that is common
    rows += [
        (1, "dev", "sc", "hsb", "tu steji wulka knjha", good, "knjha", "kniha"),
        (2, "dev", "sc", "hsb", "tu steji wulka knxhx", good, "knxhx", "kniha"),  # two edits
        (3, "dev", "sc", "hsb", "tu steji Wułka kniha", "tu steji Wulka kniha", "Wułka", "Wulka"),  # a capital, a diacritic
        (4, "dev", "gc", "hsb", "tu steji wulka knihami", good, "knihami", "kniha"),  # a form of the same lemma
        (5, "dev", "sc", "hsb", "tu steji knihamixx", "tu steji knihami", "knihamixx", "knihami"),
    ]
    spark.createDataFrame(rows, ITEMS).write.parquet(f"{d}/sc_gc_items.parquet")
    spark.createDataFrame([(i, good) for i in range(9)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_every_word_of_every_sentence_is_tried(spark, fixture_dir):
    got = {r["item_id"]: (r["word"], r["corrected"]) for r in catalogue.null_margin_argmax(spark, fixture_dir).collect()}
    assert got[1] == ("knjha", "kniha") and got[2] == ("knxhx", "kniha") and got[3] == ("Wułka", "Wulka") and got[4] == ("knihami", "kniha")


def test_unknown_words_get_two_edits_and_paradigms(spark, fixture_dir):
    got = {(r["task"], r["word"], r["candidate"]) for r in catalogue.word_candidates(spark, fixture_dir).collect()}
    assert {("sc", "knxhx", "kniha"), ("sc", "knjha", "kniha"), ("sc", "knihamixx", "knihami"), ("gc", "knihami", "kniha")} <= got
    assert not any(w == "kniha" and c == "knihami" and t == "sc" for t, w, c in got)  # known: one edit only


def test_corrections_are_chosen_among_all_candidates(spark, fixture_dir, tmp_path):
    d = str(tmp_path)
    spark.read.parquet(f"{fixture_dir}/sc_gc_items.parquet").selectExpr("* except (correct_word)", "case when item_key = 2 then null else correct_word end as correct_word").write.parquet(f"{d}/sc_gc_items.parquet")
    spark.read.parquet(f"{fixture_dir}/documents.parquet").write.parquet(f"{d}/documents.parquet")
    got = {r["item_id"]: r["corrected"] for r in catalogue.constrained_corrections(spark, d).collect()}
    assert got[2] == "kniha"


def test_compfz_has_the_most_alike_exemplar(spark, tmp_path):
    lots = random.Random(1)
    rows = [(i, ("de-hsb", "hsb-de")[i % 2], "".join(lots.sample("abcdefghijkl", 6)), f"t{i}") for i in range(60)]
    spark.createDataFrame(rows, "pred_id long, direction string, source string, pred string").write.parquet(f"{tmp_path}/mt_preds.parquet")
    got = {(r["comp"], r["row_idx"]): r["user_content"] for r in catalogue.fuzzy_composition_rows(spark, str(tmp_path)).collect()}
    shots = {i: c for (comp, i), c in got.items() if comp == "compfz" and c.count("German: ") == 2}
    assert len(got) == 180 and len(shots) == 24 and not any(c.count("German: ") == 2 for (comp, _), c in got.items() if comp == "comp0")
    for i, content in shots.items():
        own = rows[i]
        others = [r for r in rows if r[1] == own[1] and r[2] != own[2]]
        best = min(others, key=lambda r: (-len(set(r[2]) & set(own[2])), r[0]))
        assert f"German: {best[2]}\nUpper Sorbian: {best[3]}\n" in content


def test_synthesis_uses_the_own_language_and_the_whole_vocabulary(spark, tmp_path, monkeypatch):
    items = [(i, "dev", lang, "wulka kniha steji nowego mami") for i, lang in enumerate(("hsb", "dsb") * 40)]
    spark.createDataFrame(items, "item_key long, split string, lang string, original_sentence string").write.parquet(f"{tmp_path}/sc_gc_items.parquet")
    words = ["".join("abcdefghij"[int(c)] for c in f"{i:04d}") for i in range(700)]
    spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, catalogue.wrong_endings(spark, str(tmp_path)).collect()))
    df = spark.createDataFrame([(i, x, s) for i, _, x, s in items], "item_key long, lang string, text string")
    want = [str(r) for x in ("hsb", "dsb") for r in synth.inject_endings(df.where(f"lang = '{x}'"), "text", "item_key", x, catalogue.SEED).collect()]
    assert got == sorted(want) and len(got) == 80
    assert want != [str(r) for x in ("hsb", "dsb") for r in synth.inject_endings(df.where(f"lang = '{x}'"), "text", "item_key", "hsb", catalogue.SEED).collect()]
    seen = []
    cloze = synth.cloze
    monkeypatch.setattr(synth, "cloze", lambda df, s, k, vocabulary, seed: seen.append(vocabulary) or cloze(df, s, k, vocabulary, seed))
    catalogue.cloze_questions(spark, str(tmp_path))
    assert len(seen[0]) == 700
