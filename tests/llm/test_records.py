"""Formatting duplicates, look-alike texts, leakage, cross-split overlaps: against brute force."""

import collections
import itertools
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparklex import runtime
from sparklex.llm import confusables, leakage, split_overlap
from sparklex.llm import formatting_duplicates as fd
from sparklex.llm.text import fold, sentences, skeleton, visible, words


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# Text helpers


def test_text_helpers():
    assert visible("\uff41\u00a0b\u200bc\u00ade\u0301") == "a bc\u00e9" and skeleton("Skеlаban") == "Skelaban"
    assert fold("ŁÓDŹ Straße ｘ") == "lodz strasse x"
    assert words("Łódź—x_y 3,5") == ["lodz", "x", "y", "3", "5"]
    assert sentences("„A b.“ Čehodla? – nic. z.\nNowa") == ["„A b.“", "Čehodla? – nic. z.", "Nowa"]
    assert sentences("") == [] and sentences(" \n ") == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_sentences_keep_all_text(text):
    assert "".join("".join(sentences(text)).split()) == "".join(text.split())


# Formatting duplicates


def lines(spark, payloads):
    return spark.createDataFrame(list(enumerate(payloads, 1)), "line_id long, payload string")


def test_formatting_copies(spark):
    a = {"dataset_id": "d", "id": "7", "input_sentence": "Straße, „to“ je 5."}
    payloads = [
        json.dumps(a), json.dumps({"input_sentence": "STRASSE to  JE\t5", "id": 7, "dataset_id": "d"}), json.dumps(a | {"id": "8"}), json.dumps(a | {"input_sentence": "Strase to je 5"}), json.dumps(a | {"input_sentence": "Straße to je 6"}),
        json.dumps(a | {"input_sentence": "Stráße to je 5"}), json.dumps(a)[:-5], None, "", "  ", "[1]", "3", "null", json.dumps({"dataset_id": "d", "sent_id": "7", "source": "Straße to je 5"}), json.dumps(a | {"id": None}), json.dumps({"dataset_id": "d", "input_sentence": a["input_sentence"]}), json.dumps(a),
    ]
    df = lines(spark, payloads)
    assert rows(fd.formatting_copies(df), "first_id", "copy_id") == [(1, 2), (1, 17)]
    assert dict(rows(fd.collapse_records(df), "first_id", "copies")) == {1: 3, 3: 1, 4: 1, 5: 1, 6: 1, 14: 1, 15: 1, 16: 1}
    wider = df.withColumns({"k1": F.lit(1), "record": F.lit(2), "first_id": F.lit("x"), "n": F.lit(None)})
    assert rows(fd.formatting_copies(wider), "first_id", "copy_id") == [(1, 2), (1, 17)]
    assert fd.formatting_copies(df.where("false")).count() == 0
    assert fd.formatting_copies(df.unionByName(df)).count() == 2


def test_figures_and_structure_stay():
    same = [("3.5 m", "3,5  m."), ("a, b-c", "A b c!"), ("17 – 4", "17-4"), ("−5 °", "-5°"), ("3 + 5", "3+5")]
    unlike = [("3.5", "35"), ("-5", "5"), ("17 4", "174"), ("5 -3", "5 3"), ("3+5", "3-5"), ("é", "e"), ({"a": "b c"}, {"ab": "c"}), (["ab", "c"], ["a", "bc"]), (["a"], "a"), ([1], ["x"]), (None, False), ({"a": [1, 2]}, {"a": [12]}), (["a", "b"], ["b", "a"])]
    for a, b in same:
        assert fd.canonical_value(a) == fd.canonical_value(b), (a, b)
    for a, b in unlike:
        assert fd.canonical_value(a) != fd.canonical_value(b), (a, b)
    assert fd.canonical_value({"b": "X y", "a": ["Straße."]}) == fd.canonical_value({"a": ["STRASSE"], "b": "xy!"})


def test_nested_payloads(spark):
    df = lines(spark, ['{"id": 1, "x": {"a": "b c"}}', '{"id": 1, "x": {"ab": "c"}}', '{"x": {"a": "B, c"}, "id": "1"}', '{"id": 1, "x": -5}', '{"id": 1, "x": 5}', '{"id": 1, "x": "-5"}', '{"id": 1, "x": 3.5}', '{"id": 1, "x": 35}', '{"id": 1, "x": true}', '{"id": 1, "x": "true"}'])
    assert rows(fd.formatting_copies(df), "first_id", "copy_id") == [(1, 3), (4, 6)]


def test_hot_record_and_long_values(spark):
    df = spark.range(1, 3001).select(F.col("id").alias("line_id"), F.when(F.col("id") % 3 > 0, F.lit('{"id": 1, "source": "' + "dołho " * 20000 + '"}')).otherwise(F.concat(F.lit('{"id": '), "id", F.lit("}"))).alias("payload")).where("line_id < 300")
    got = fd.formatting_copies(df)
    assert got.count() == df.where("line_id % 3 > 0").count() - 1 and got.select("first_id").distinct().count() == 1


def test_copies_against_brute_force(spark):
    rng = random.Random(3)
    payloads = []
    for _ in range(400):
        text = " ".join(rng.choice(["a", "B", "ß", "ss", "č", "c", "4"]) for _ in range(3))
        text = "".join(ch.upper() if rng.random() < 0.2 else ch for ch in text) + rng.choice(["", ".", " !"])
        payloads.append(json.dumps({"id": rng.choice([1, "1", 2]), "source": text}))
    groups = collections.defaultdict(list)
    for i, p in enumerate(payloads, 1):
        d = json.loads(p)
        groups[str(d["id"]), "".join(ch for ch in d["source"].casefold() if ch.isalnum())].append(i)
    want = sorted((g[0], x) for g in groups.values() for x in g[1:])
    assert rows(fd.formatting_copies(lines(spark, payloads)), "first_id", "copy_id") == want


# Look-alike texts


def test_alike_pairs(spark):
    data = [("f", 1, "Kniha je dobra"), ("f", 2, "Knihа je dobra"), ("f", 3, "Ｋｎｉｈａ je dobra"), ("f", 4, "Kniha je dobra"), ("f", 5, "Kniha\u00a0je dobra"), ("f", 6, "Kni​ha je dobra"), ("f", 7, "kniha je dobra"), ("f", 8, "Knihá je dobra"), ("f", 9, "Kniha\u0301 je dobra"), ("g", 10, "Kniha je dobra"), ("f", 11, None), ("f", 12, ""), ("f", 13, "​"), ("f", 14, "Книга"), ("f", 15, "Книга"), (None, 16, "x"), ("f", 17, "а je"), ("f", 18, "a je"), ("f", 19, "Knihа je dobra ")]
    df = spark.createDataFrame(data, "field string, rec_id long, text string")
    same = [1, 2, 3, 4, 5, 6, 19]
    texts = dict((i, t) for _, i, t in data)
    want = {("f", a, b) for a, b in itertools.combinations(same, 2) if texts[a] != texts[b]} | {("f", 8, 9), ("f", 17, 18)}
    got = set(rows(confusables.alike_pairs(df), "field", "id_a", "id_b"))
    assert got == want
    assert set(rows(confusables.alike_pairs(df.withColumns({"canon": F.lit("x"), "k1": F.lit(1), "base": F.lit(2)})), "field", "id_a", "id_b")) == want
    assert confusables.alike_pairs(df.where("false")).count() == 0
    forms = dict(rows(confusables.canonical_texts(df).where("rec_id in (2, 14)"), "rec_id", "canon"))
    assert forms == {2: "Kniha je dobra", 14: "Книга"}


def test_accents_on_lookalikes(spark):
    df = spark.createDataFrame([("f", 1, "m\u03bf\u0301st je"), ("f", 2, "m\u00f3st je"), ("f", 3, "m\u03ccst je"), ("f", 4, "most je")], "field string, rec_id long, text string")
    assert rows(confusables.alike_pairs(df), "id_a", "id_b") == [(1, 2), (1, 3), (2, 3)]
    assert fold("m\u03ccst \u0451") == "most e"


def test_tokens_that_may_be_repaired():
    assert confusables.mixed_tokens("Skеlaban je") == [("Skеlaban", "Skelaban")]
    assert confusables.mixed_tokens("Привет Хорошо") == [] and confusables.mixed_tokens("plain") == []
    assert confusables.mixed_tokens("to je а b") == [("а", "a")] and confusables.mixed_tokens("Δχ μ") == []
    assert confusables.mixed_tokens("cлово новое") == [("cлово", "слово")] and confusables.mixed_tokens("λόγoς") == [("λόγoς", "λόγος")]
    assert [confusables.dominant_script(t) for t in ("Skеlaban", "cлово", "λόγoς", "аое", "zл", "слово")] == ["LATIN", "CYRILLIC", "GREEK", None, None, "CYRILLIC"]


def test_words_of_other_scripts_are_repaired(spark):
    df = spark.createDataFrame([("f", 1, "новое слово тут"), ("f", 2, "новое cлово тут"), ("f", 3, "новое слово там"), ("f", 4, "нoвoe слoвo тут")], "field string, rec_id long, text string")
    assert rows(confusables.alike_pairs(df), "id_a", "id_b") == [(1, 2), (1, 4), (2, 4)]


def test_one_form_on_most_rows(spark, monkeypatch):
    """Rows of a hot spelling never meet in one task, and only pairs of unlike spellings are made."""
    monkeypatch.setattr(confusables, "HOT_ROWS", 50)
    monkeypatch.setattr(runtime.join_groups, "__defaults__", (50,))
    data = [("f", i, "Kniha je dobra") for i in range(900)] + [("f", 900, "Knihа je dobra"), ("f", 901, "Ｋniha je dobra")] + [("f", 1000 + i, f"druhe {i} tu") for i in range(100)]
    df = spark.createDataFrame(data, "field string, rec_id long, text string")
    got = rows(confusables.alike_pairs(df), "id_a", "id_b")
    assert got == sorted([(i, x) for i in range(900) for x in (900, 901)] + [(900, 901)])


def test_unwitnessed_lookalikes_stay(spark):
    df = spark.createDataFrame([("f", 1, "zwеcka je"), ("f", 2, "zwеckа je"), ("f", 3, "nixk je"), ("f", 4, "qаz je")], "field string, rec_id long, text string")
    forms = dict(rows(confusables.canonical_texts(df), "rec_id", "canon"))
    assert forms[1] == forms[2] == "zwecka je" and forms[4] == "qаz je"


# Leakage


def brute_leaks(docs, items, n):
    grams = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for j in range(len(w) - n + 1):
            grams[tuple(w[j : j + n])].add(i)
    return sorted({(d, i) for d, t in docs for w in [words(t)] for j in range(len(w) - n + 1) for i in grams.get(tuple(w[j : j + n]), ())})


def longest_run(doc, item):
    best = 0
    for i in range(len(doc)):
        for j in range(len(item)):
            k = 0
            while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]:
                k += 1
            best = max(best, k)
    return best


def covered_words(doc, item, n):
    grams = {tuple(item[j : j + n]) for j in range(len(item) - n + 1)}
    return len({i + k for i in range(len(doc) - n + 1) if tuple(doc[i : i + n]) in grams for k in range(n)})


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "Č"])
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 14)))) for i in range(25)]
    docs = [(i, rng.choice([" ", ", ", "\n> "]).join(word() for _ in range(rng.randint(0, 30)))) for i in range(120)]
    d = spark.createDataFrame(docs + [(500, None), (501, ""), (None, "x")], "doc_id long, text string").withColumns({"item_id": F.lit("clash"), "longest": F.lit(0), "block": F.lit(1), "spans": F.lit(2)})
    p = spark.createDataFrame(items + [(90, None)], "item_id long, text string")
    text, passage = dict(docs), dict(items)
    for n in (3, 5, 8):
        pairs = brute_leaks(docs, items, n)
        want = [(a, b, longest_run(words(text[a]), words(passage[b])), covered_words(words(text[a]), words(passage[b]), n)) for a, b in pairs]
        for limits in ((leakage.AUTOMATON_WORDS, 1000), (20, 1000), (60, 7)):
            assert rows(leakage.leaked_items(d, p, min_words=n, automaton_words=limits[0], block_rows=limits[1]), "doc_id", "item_id", "longest", "covered") == want
    for size in (leakage.AUTOMATON_WORDS, 20):
        assert leakage.leaked_items(d.where("false"), p, automaton_words=size).count() == 0 and leakage.leaked_items(d, p.where("false"), automaton_words=size).count() == 0


def test_an_item_inside_another_has_its_own_length(spark):
    long = "a b c d e f g h i j k l m n o p q r"
    p = spark.createDataFrame([(1, "f g h i j k l m"), (2, long)], "item_id long, text string")
    d = spark.createDataFrame([(1, f"x {long} y"), (2, "e f g h i j k l m n")], "doc_id long, text string")
    assert rows(leakage.leaked_items(d, p), "doc_id", "item_id", "longest", "covered") == [(1, 1, 8, 8), (1, 2, 18, 18), (2, 1, 8, 8), (2, 2, 10, 10)]


def test_one_passage_in_most_documents(spark):
    """A block that nearly all documents reach is given to several tasks."""
    passage = "kak so maš tu pola nas doma w Budyšinje"
    p = spark.createDataFrame([(i, passage if i == 0 else " ".join(f"w{i}x{k}" for k in range(10))) for i in range(20)], "item_id long, text string")
    d = spark.createDataFrame([(i, f"t{i} {passage} u{i}" if i % 10 else f"t{i}") for i in range(300)], "doc_id long, text string")
    got = leakage.leaked_items(d, p, automaton_words=30, block_rows=40)
    assert rows(got, "doc_id", "item_id", "longest") == [(i, 0, 9) for i in range(300) if i % 10]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aßŁe\u0301 ,.ﬁé\n1", max_size=40))
def test_places_of_words(text):
    places = leakage.word_places(text)
    assert [words(text[a:b]) for a, b in places] == [[w] for w in words(text)]
    assert words(leakage.without_spans(text, [(0, len(places))])) == []


def test_cleaned_documents(spark):
    p = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "g h i j k l m n")], "item_id long, text string")
    d = spark.createDataFrame([(1, "Here: A, b c d é f g h i j k l m n. There"), (2, "a b c d e f g h"), (3, "nothing here"), (4, None), (5, "p q. a b c d e f g h! r s")], "doc_id long, text string").withColumn("spans", F.lit(1))
    leaks = leakage.leaked_items(d, p)
    got = {r["doc_id"]: (r["text"], r["removed"], r["n_words"]) for r in leakage.cleaned_documents(d, leaks).collect()}
    assert got == {1: ("Here: . There", 14, 16), 2: ("", 8, 8), 5: ("p q. ! r s", 8, 12)}
    assert {r["doc_id"]: r["text"] for r in leakage.cleaned_documents(d, leaks, 9, 0.9).collect()} == {1: "Here: . There"}
    assert {r["doc_id"]: r["text"] for r in leakage.cleaned_documents(d, leaks, max_share=0.7).collect()} == {1: None, 2: None, 5: "p q. ! r s"}
    assert leakage.cleaned_documents(d, leaks.where("false")).count() == 0


def test_leaks_ignore_case_accents_and_marks(spark):
    p = spark.createDataFrame([(1, "Złoty kóń a młody bratr so w nocy zetkaštej")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x " * 50000 + "ZLOTY kon; a/mlody\n> bratr so w nocy"), (2, "zloty kon a mlody bratr so w"), (3, "Straße")], "doc_id long, text string")
    got = leakage.leaked_items(d, p).collect()
    assert [(r["doc_id"], r["item_id"], r["longest"]) for r in got] == [(1, 1, 8)]


# Cross-split overlaps


def edits(a, b):
    far = 99
    fig = lambda w: any(map(str.isdigit, w))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [min(far, row[0] + (far if fig(x) else 1))]
        for j, y in enumerate(b, 1):
            new.append(min(far, row[j - 1] + (0 if x == y else far if fig(x) or fig(y) else 1), row[j] + (far if fig(x) else 1), new[-1] + (far if fig(y) else 1)))
        row = new
    return min(row)


def almost(item, text):
    """At most two changes, two words left; or two neighbours exchanged."""
    n = len(item)
    if edits(item, text) <= max(0, min(2, n - 2)):
        return True
    swaps = [[*item[:i], item[i + 1], item[i], *item[i + 2 :]] for i in range(n - 1) if not any(c.isdigit() for c in item[i] + item[i + 1])]
    return n in (2, 3) and any(text[p : p + n] == s for s in swaps for p in range(len(text)))


def test_overlaps_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["dom", "kniha", "rěka", "nowy", "stary", "je", "pola", "łuka", "wóz", "hora", "17", "23", "kóń"]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(1, 16))]) for i in range(60)]
    texts = []
    for i in range(250):
        w = list(rng.choice(items)[1]) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(9)]
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            if rng.random() < 0.4:
                w.insert(at, rng.choice(vocabulary))
            elif at < len(w):
                w[at : at + 1] = [] if rng.random() < 0.5 else [rng.choice(vocabulary)]
        texts.append((i, ["xx"] * rng.randint(0, 3) + w + ["yy"] * rng.randint(0, 2)))
    want = set()
    for i, a in items:
        folded = [fold(x) for x in a]
        for r, b in texts:
            if almost(folded, [fold(x) for x in b]):
                want.add(("t", i, r))
    assert len(want) > 200 and any(len(items[i][1]) < 6 for _, i, _ in want)
    it = spark.createDataFrame([("t", i, " ".join(a).upper()) for i, a in items] + [("t", 900, None), ("t", 901, " .")], "eval_table string, item_key long, text string").withColumn("norm", F.lit("clash"))
    ms = spark.createDataFrame([(r, ", ".join(b)) for r, b in texts] + [(900, None), (901, "")], "row_id long, text string").withColumns({"places": F.lit(1), "m1": F.lit(2), "coverage": F.lit("x")})
    for size in (split_overlap.RANGE_ROWS, 300, 40):
        assert set(rows(split_overlap.overlaps(it, ms, size), "eval_table", "item_key", "row_id")) == want
    assert split_overlap.overlaps(it.where("false"), ms).count() == 0 and split_overlap.overlaps(it, ms.where("false")).count() == 0


def test_prefix_on_a_tenth_of_all_rows(spark, monkeypatch):
    """Many messages and items share a long prefix: its run is spread over ranges, none of which is much over its size."""
    rng = random.Random(4)
    common = "kak so maš tu pola nas doma w Budyšinje a kak so maš tam"
    tail = lambda: " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") for _ in range(6))
    tails = [tail() for _ in range(12)]
    items = [(i, f"{common} {t}") for i, t in enumerate(tails)]
    texts = [(r, f"{common} {tails[r % 24]}" if r % 24 < 12 else f"{common} {tail()}") for r in range(120)] + [(r, " ".join(tail() for _ in range(3))) for r in range(200, 1280)]
    it = spark.createDataFrame([("t", i, t) for i, t in items], "eval_table string, item_key long, text string")
    ms = spark.createDataFrame(texts, "row_id long, text string")
    seen = []
    real = split_overlap._shared_prefixes

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            ranges, item = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            n = collections.Counter(r for r, x in zip(ranges, item) if not x)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64()), *[pa.array([0] * len(n), pa.int64())] * 2, *[pa.array([0] * len(n), pa.int32())] * 2], ["m1", "m2", "k1", "k2", "ipos", "mpos"])

    got = rows(split_overlap.overlaps(it, ms, 30), "item_key", "row_id")
    assert got == sorted((r % 24, r) for r in range(120) if r % 24 < 12)
    frame = type(ms)
    plain = frame.mapInArrow

    def spy(self, f, schema, *more):
        if f is real:
            seen.extend(plain(self, counted, schema).collect())
        return plain(self, f, schema, *more)

    monkeypatch.setattr(frame, "mapInArrow", spy)
    split_overlap.overlaps(it, ms, 30).count()
    sizes = collections.Counter()
    for r in seen:
        sizes[r["m1"]] += r["m2"]
    assert len(sizes) >= 5 and max(sizes.values()) <= 90, sizes


def test_overlaps_of_hot_copies(spark, monkeypatch):
    """One item and one message on most rows: every row of both comes out."""
    monkeypatch.setattr(split_overlap, "HOT_ROWS", 20)
    monkeypatch.setattr(runtime.join_groups, "__defaults__", (20,))
    hot, other = "to je nowa wulka kniha a stary dom pola rěki", "druha sada steji tu mjez wšěmi a nichtó ju njewidźi"
    it = spark.createDataFrame([("t", i, hot) for i in range(60)] + [("t", 100, other)], "eval_table string, item_key long, text string")
    ms = spark.createDataFrame([(i, f"x {hot.upper()}.") for i in range(50)] + [(100, other), (101, "nothing")], "row_id long, text string")
    got = rows(split_overlap.overlaps(it, ms), "item_key", "row_id", "coverage")
    assert got == sorted([(i, r, 1.0) for i in range(60) for r in range(50)] + [(100, 100, 1.0)])


def test_coverage_merges_spans():
    item, text = "a b c d e f g h".split(), "x a b c q e f g h a b c".split()
    assert split_overlap.coverage(item, text, [(0, 1), (5, 6), (0, 9), (1, 2)]) == 7 and split_overlap.coverage(item, text, []) == 0


def test_overlap_rules(spark):
    item = "Złoty kóń leži pola 17 rěki a stary dom tam ničo njeměješe"
    t = {1: "x " * 20000 + item.upper(), 2: item.replace("17", "18"), 3: item.replace("leži ", "").replace("dom", "wóz"), 4: item.replace("Złoty", "a").replace("leži", "b").replace("dom", "c"), 5: item.replace("stary dom", "dom stary"), 6: item.replace("o", "о"), 7: item.replace("ó", "o\u0301")}
    it = spark.createDataFrame([("t", 1, item), ("u", 2, item)], "eval_table string, item_key long, text string")
    ms = spark.createDataFrame(sorted(t.items()), "row_id long, text string")
    want = [(e, k, r) for e, k in (("t", 1), ("u", 2)) for r in (1, 3, 5, 6, 7)]
    assert rows(split_overlap.overlaps(it, ms), "eval_table", "item_key", "row_id") == want
    assert rows(split_overlap.overlaps(it.unionByName(it), ms.unionByName(ms)), "eval_table", "item_key", "row_id") == want
