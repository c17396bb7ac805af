import gzip
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sparklex.operators import model
from sparklex.operators.lexicon import expand, stems
from sparklex.plans import cli, config, folder, pipelines
from sparklex.sources import readers, schemas, writers
from sparklex.streaming import streams


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"dataset_id": "d", "id": 18, "question": "q", "answer": 3}\n\n{"id": "low1", "question": "r", "answer": "x"}\n')
    got = readers.read_task(spark, p, "mr", dev=True).collect()
    assert [(r["id"], r["answer"]) for r in got] == [("18", "3"), ("low1", "x")]
    array = put(tmp_path / "b.jsonl", '[\n {"question_en": "q",\n "answer": "1"}\n]')
    assert readers.read_json_array(spark, array, schemas.SEED).first()["answer"] == "1"


def test_csv(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'hsb,text\nx,"two ""quoted""\nlines"\ny,\n')
    assert [r["text"] for r in readers.read_csv_text(spark, p).collect()] == ['two "quoted"\nlines', ""]
    assert [r["text"] for r in readers.read_csv_text(spark, p, "hsb").collect()] == ["x", "y"]
    assert [r["text"] for r in readers.read_csv_text(spark, p, "dsb").collect()] == ["x", "y"]


def test_numbered_lines_over_several_parts(spark, tmp_path):
    p = put(tmp_path / "a.txt", "".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.numbered_lines(spark, p)
        assert df.where(F.concat(F.lit("line "), F.col("line_no")) != F.col("value")).count() == 0 and df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parallel(spark, tmp_path):
    a, b = put(tmp_path / "a.src", "x\ny\n"), put(tmp_path / "a.tgt", "u\nv\n")
    got = sorted((r["row_idx"], r["src"], r["tgt"]) for r in readers.read_parallel(spark, a, b, "de-hsb").collect())
    assert got == [(0, "x", "u"), (1, "y", "v")]
    short = put(tmp_path / "b.tgt", "u\n")
    with pytest.raises(Exception, match="differ in length"):
        readers.read_parallel(spark, a, short, "de-hsb").collect()


def test_mono(spark, tmp_path):
    best = put(tmp_path / "a.csv", "hsb\nto je sada\nzu kurz\n")
    with gzip.open(tmp_path / "b.gz", "wt", encoding="utf-8") as f:
        f.write("TO je sada\ndruha sada tu\n")
    got = readers.read_mono(spark, [best, str(tmp_path / "missing.txt"), str(tmp_path / "b.gz")], "hsb").collect()
    assert sorted((r["source_rank"], r["text"]) for r in got) == [(0, "to je sada"), (1, "druha sada tu")]
    assert readers.read_mono(spark, [str(tmp_path / "none")], "hsb").count() == 0


def test_lexicon_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("x/hsb.aff", "SFX A Y 1\nSFX A a y .\n")
        z.writestr("x/hsb.dic", "1\nkniha/A\n")
        z.writestr("x/hyph_hsb.dic", "no")
    aff, dic = readers.extract_lexicon(str(tmp_path / "d.zip"), str(tmp_path))
    forms = expand(stems(readers.read_dictionary(spark, dic)), readers.read_affixes(aff))
    assert sorted(r["form"] for r in forms.collect()) == ["kniha", "knihy"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("only.aff", "")
    with pytest.raises(ValueError):
        readers.extract_lexicon(str(tmp_path / "bad.zip"), str(tmp_path))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "b", "y"), (1, "d", "a", "x")], "ord int, dataset_id string, sent_id string, source string")
    writers.write_task(df, "mt", str(tmp_path / "mt.jsonl"), "ord")
    got = [json.loads(x) for x in (tmp_path / "mt.jsonl").read_text(encoding="utf-8").splitlines()]
    assert got == [{"dataset_id": "d", "sent_id": "a", "source": "x", "pred": ""}, {"dataset_id": None, "sent_id": "b", "source": "y", "pred": ""}]
    pool = spark.createDataFrame([("de-hsb", 1, "b", "y"), ("de-hsb", 0, "a", "x\nz")], "direction string, row_idx long, src string, tgt string")
    writers.write_pool_text(pool, "de-hsb", str(tmp_path / "p"))
    assert (tmp_path / "p.src").read_text() == "a\nb\n" and (tmp_path / "p.tgt").read_text() == "x z\ny\n"
    writers.write_bundle(pool, str(tmp_path / "bundle"), ["direction"])
    assert (tmp_path / "bundle" / "direction=de-hsb").exists()


def good():
    return {"system_name": "s", "weights": {"hf_repo": "r", "subfolder": "f"}, "stack": "plain", "mt": {"decode": 1, "exemplar_k": 3, "pool": "p"}, "qa": {"slot_scorer": False}, "gc": {"union": False, "paradigm_cap": 60}, "sc": {"bktree": False, "paradigm_cap": 30}, "mr": {"retry_ladder": True, "postformat": True, "retrieval": {"enabled": False}}, "seed": 1}


def test_config(tmp_path):
    assert config.validate(good())
    for change in ({"stack": "other"}, {"gc": {"union": True, "paradigm_cap": 1}}, {"mt": {}}, {"stack": "composed"}, {"mr": {"retry_ladder": 1, "postformat": 1, "retrieval": {"enabled": True}}}, {"sc": {"bktree": 1, "paradigm_cap": 1, "topups": {"nonword": {"enabled": True}}}}):
        with pytest.raises(config.ConfigError):
            config.validate(good() | change)
    missing = good()
    del missing["seed"]
    with pytest.raises(config.ConfigError, match="seed"):
        config.validate(missing)
    assert config.expand("${A}/x", {"A": "/r"}) == "/r/x"
    with pytest.raises(config.ConfigError):
        config.expand("${B}", {})
    res = config.Resources({"lex": str(tmp_path / "no")}, {"lex": str(tmp_path)})
    assert res.path("lex") == str(tmp_path)
    with pytest.raises(config.ConfigError):
        config.Resources().path("lex")


def test_command_line(spark, tmp_path):
    pools, tests = tmp_path / "pools", tmp_path / "tests"
    pools.mkdir(), tests.mkdir()
    assert cli.main(["clean-pools", "--pools", str(pools), "--test-dir", str(tests), "--out-dir", str(tmp_path / "out")]) == 2
    put(pools / "de_hsb.src", "Haus\nBaum\n"), put(pools / "de_hsb.tgt", "dom\nštom\n")
    put(tests / "deu-hsb_mt_test.jsonl", '{"dataset_id": "d", "sent_id": 1, "de": "Haus"}\n')
    assert cli.main(["clean-pools", "--pools", str(pools), "--test-dir", str(tests), "--out-dir", str(tmp_path / "out")]) == 0
    assert json.loads((tmp_path / "out/de_hsb.json").read_text())["removed_by_test_dedup"] == 1
    assert [r["src"] for r in spark.read.parquet(str(tmp_path / "out/de_hsb")).collect()] == ["Baum"]


def test_more_commands(spark, tmp_path):
    dic = put(tmp_path / "a.dic", "2\nwoda/A\nkniha\n")
    assert cli.main(["deletion-index", "--dic", dic, "--edits", "1", "--out", str(tmp_path / "index")]) == 0
    assert spark.read.parquet(str(tmp_path / "index")).where("variant = 'wda'").first()["word"] == "woda"
    mono = put(tmp_path / "m.txt", "".join(f"Nowa kniha leži pola wokna {i}\n" for i in range(30)))
    held = put(tmp_path / "h.jsonl", '{"input_sentence": "NOWA kniha leži pola wokna 7"}\n')
    for task in ("sc", "qa"):
        out = str(tmp_path / task)
        assert cli.main(["synthesise", "--task", task, "--lang", "hsb", "--mono", mono, "--held-out", held, "--pool-size", "4", "--out-dir", out]) == 0
        assert spark.read.json(out).count() == 29
    assert cli.main(["synthesise", "--task", "sc", "--lang", "hsb", "--mono", str(tmp_path / "no.txt"), "--pool-size", "4", "--out-dir", str(tmp_path / "x")]) == 2


def test_model_hooks(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "x")], "item_id long, prompt string")
    generate = model.generator(lambda: lambda prompts, **how: [f"{p}:{how['max_new']}:{how['sample']}" for p in prompts], "qa", batch=1)
    assert {r["item_id"]: r["raw"] for r in generate(rows, sample=True).collect()} == {1: "abc:16:True", 2: None, 3: "x:16:True"}
    encode = model.encoder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    got = encode(rows.select(F.col("item_id").alias("row_idx"), F.col("prompt").alias("text")))
    assert {r["row_idx"]: r["embedding"] for r in got.collect()} == {1: [3.0, 1.0], 2: None, 3: [1.0, 1.0]}


def echo(answers):
    def generate(rows, sample=False, temperature=0.0, min_new=0):
        table = F.create_map(*[F.lit(x) for k, v in answers.items() for x in (k, v)])
        return rows.select("item_id", F.try_element_at(table, "item_id").alias("raw"))

    return generate


def test_pipelines(spark):
    items = spark.createDataFrame([(1, "d", "s1", "Das Haus")], "item_id long, dataset_id string, sent_id string, source string")
    memory = spark.createDataFrame([(0, "Das Haus ist alt", "Dom je stary")], "row_idx long, src string, tgt string")
    assert pipelines.mt(items, memory, "de", "hsb", echo({1: "<hsb> dom </hsb>"})).first()["pred"] == "dom"
    qa = spark.createDataFrame([(1, "q1", "x ( I ) y ( II )", "čo. I", {"1": "a", "2": "b"}), (2, "q2", "x ( I ) y ( II )", "čo. II", {"1": "a", "2": "b"}), (3, "q3", None, "q", {"1": "a"})], "item_id long, question_id string, context string, question string, possible_answers map<string,string>")
    scores = lambda o: o.select("question_id", "option", F.when(F.col("option") == 0, F.when(F.col("question_id") == "q1", 0.9).otherwise(0.8)).otherwise(F.when(F.col("question_id") == "q1", 0.1).otherwise(0.7)).alias("score"))
    got = dict((r["question_id"], r["pred"]) for r in pipelines.qa(qa, echo({1: "2", 2: "1", 3: "9"}), scores).collect())
    assert got == {"q1": 1, "q2": 2, "q3": 1}
    mr = spark.createDataFrame([(1, "medium1", "q one"), (2, "low2", "q two")], "item_id long, id string, question string")
    dev = spark.createDataFrame([(0, "Q  two", "4")], "idx long, text string, answer string")
    got = dict((r["item_id"], (r["pred"], r["stage"])) for r in pipelines.mr(mr, echo({1: "<answer> \\pi </answer>", 2: "none"}), dev).collect())
    assert got == {1: ("$\\pi$", 0), 2: ("4", 0)}


def test_correction_pipeline(spark):
    items = spark.createDataFrame([(1, "to je dobru kniha"), (2, "to je dobra kniha")], "item_id long, sentence string")
    forms = spark.createDataFrame([(0, "dobra"), (0, "dobru"), (1, "kniha")], "lemma_idx long, form string")
    mono = spark.createDataFrame([("to je dobra kniha",)] * 6, "text string")
    clean = "<wrong> CORRECT </wrong> <corrected> CORRECT </corrected>"
    got = {r["item_id"]: (r["pred_incorrect"], r["pred_corrected"]) for r in pipelines.sc_gc(items, "gc", "hsb", echo({1: clean, 2: clean}), forms, ["uü"], mono).collect()}
    assert got == {1: ("dobru", "dobra"), 2: ("CORRECT", "CORRECT")}
    flagged = echo({1: "<wrong> dobru </wrong> <corrected> dobro </corrected>", 2: clean})
    got = {r["item_id"]: (r["pred_incorrect"], r["pred_corrected"]) for r in pipelines.sc_gc(items, "sc", "hsb", flagged, forms, ["uü"], mono).collect()}
    assert got[1] == ("dobru", "dobra") and got[2] == ("CORRECT", "CORRECT")


def test_synthesis_pipelines(spark):
    mono = spark.createDataFrame([(i, f"Nowa kniha leži pola wokna {i}") for i in range(60)], "ord long, text string")
    held = spark.createDataFrame([("nowa kniha leži pola wokna 3",)], "text string")
    for task in ("sc", "gc", "qa"):
        out = pipelines.synthesise(mono, task, "hsb", held, 1, 10, vocabulary=["město", "rěka", "žona"])
        parts = dict((r["part"], r["count"]) for r in out.groupBy("part").count().collect())
        assert parts == {"pool": 10, "train": 49}
    dev = spark.createDataFrame([("2", "knihu", "kniha"), ("4", "CORRECT", "CORRECT"), ("5", "x", "y")], "id string, incorrect_word string, correct_word string")
    forms = spark.createDataFrame([(0, "kniha"), (0, "knihu")], "lemma_idx long, form string")
    out = pipelines.calibrated(mono, dev, held, forms, 20, 1)
    assert out.count() == 20 and out.where("incorrect_word = 'CORRECT'").count() == 10
    seeds = spark.createDataFrame([(1, "low", "How many?", "3", "Count."), (2, "low", "Same", "4", ""), (3, "low", "Prose", "this is no answer at all", "")], "seed_id long, tier string, question_en string, answer string, rationale_en string")
    tr = spark.createDataFrame([(1, "Kelko?", "Ličimy."), (2, "SAME", ""), (3, "x", "")], "seed_id long, question string, rationale string")
    got = pipelines.maths_rows(seeds, tr).collect()
    assert [r["seed_id"] for r in got] == [1] and got[0]["messages"][1]["content"] == "Ličimy.\n<answer> 3 </answer>"


def test_streams(spark, tmp_path):
    for i, text in enumerate(("To je", "to  JE", "druhe", "test")):
        os.utime(put(tmp_path / f"{i}.json", json.dumps({"ts": f"2026-01-01T0{i}:00:00", "text": text, "kind": "a"})), (1_700_000_000 + i * 60,) * 2)  # read in this order
    stream = spark.readStream.schema("ts timestamp, text string, kind string").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    block = spark.createDataFrame([("test",)], "text string")
    out = streams.decontaminate_stream(streams.dedup_stream(stream, "text", "ts"), block, "text")
    q = out.writeStream.format("memory").queryName("clean").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("clean").count() == 2
    q = streams.windowed_counts(stream, "ts", "kind", "1 hour", "0 seconds").writeStream.format("memory").queryName("counts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").where("rows = 1").count() >= 2


def stub_model(task):
    """A model that knows its task by the prompt: used by name on the command line."""
    replies = {"mt": "<think>x</think><hsb> dom </hsb>", "qa": "2", "sc": "<wrong> Haus </wrong> <corrected> dom </corrected>", "gc": "<wrong> CORRECT </wrong> <corrected> CORRECT </corrected>", "mr": "<answer> 7 </answer>"}
    return lambda: lambda prompts, **options: [replies[task]] * len(prompts)


def test_a_folder_of_task_files_is_run(spark, tmp_path, capsys):
    tests, out = tmp_path / "tests", tmp_path / "out"
    tests.mkdir()
    put(tests / "deu-hsb_mt_test.jsonl", '{"dataset_id": "d", "sent_id": 2, "de": "Haus"}\n{"dataset_id": "d", "sent_id": 1, "de": "Baum"}\n')
    put(tests / "hsb_qa_test.jsonl", '{"dataset_id": "d", "question_id": "q1", "context": "", "question": "Što?", "possible_answers": {"1": "a", "2": "b"}}\n{"dataset_id": "d", "question_id": "q2", "context": "", "question": "Hdźe?", "possible_answers": {"1": "a"}}\n')
    put(tests / "hsb_sc_test.jsonl", '{"dataset_id": null, "id": 0, "input_sentence": "To je Haus"}\n')
    put(tests / "dsb_mr_test.jsonl", '{"dataset_id": "d", "id": "low1", "question": "3 + 4?"}\n')
    settings = put(tmp_path / "c.json", json.dumps(good()))
    command = ["predict", "--config", settings, "--test-dir", str(tests), "--out-dir", str(out), "--model", "test_sources:stub_model"]
    assert cli.main(command) == 0
    read = lambda name: [json.loads(x) for x in (out / name).read_text().splitlines()]
    assert read("deu-hsb_preds.jsonl") == [{"dataset_id": "d", "sent_id": "2", "source": "Haus", "pred": "dom"}, {"dataset_id": "d", "sent_id": "1", "source": "Baum", "pred": "dom"}]
    assert [r["pred"] for r in read("hsb_qa_preds.jsonl")] == [2, 1]
    assert read("hsb-sc_preds.jsonl") == [{"dataset_id": None, "id": "0", "input_sentence": "To je Haus", "pred_incorrect": "Haus", "pred_corrected": "dom"}]
    assert read("dsb-mr_preds.jsonl") == [{"dataset_id": "d", "id": "low1", "question": "3 + 4?", "pred": "7"}]
    assert sorted(p.name for p in out.iterdir()) == ["deu-hsb_preds.jsonl", "dsb-mr_preds.jsonl", "hsb-sc_preds.jsonl", "hsb_qa_preds.jsonl"]
    (tmp_path / "empty").mkdir()
    assert cli.main([*command[:3], "--test-dir", str(tmp_path / "empty"), *command[5:]]) == 2
    assert cli.main([*command, "--tasks", "gc"]) == 2 and "no file" in capsys.readouterr().err


def test_a_composed_folder_run(spark, tmp_path):
    tests, lex, mono, pools, dev = (tmp_path / n for n in ("tests", "lex", "mono", "pools", "dev"))
    for p in (tests, lex, mono, pools, dev):
        p.mkdir()
    put(tests / "dsb_sc_test.jsonl", '{"dataset_id": "d", "id": 0, "input_sentence": "to jo dalsna wěc"}\n')
    put(tests / "hsb_mr_test.jsonl", '{"dataset_id": "d", "id": "low1", "question": "wjele je tři a štyri"}\n')
    put(tests / "deu-hsb_mt_test.jsonl", '{"dataset_id": "d", "sent_id": 2, "de": "Haus"}\n')
    put(lex / "dsb.aff", "MAP 1\nMAP sš\n"), put(lex / "dsb.dic", "4\nto\njo\ndalšna\nwěc\n")
    put(mono / "dsb.csv", "dsb\n" + "dalšna wěc jo to\n" * 9)
    put(pools / "de_hsb.src", "Haus am See\n"), put(pools / "de_hsb.tgt", "dom pola jězora\n")
    put(dev / "hsb_mr_dev.jsonl", '{"id": "low2", "question": "wjele je tři a štyri", "answer": 12}\n')
    settings = good() | {"stack": "composed", "engine": {"batch": 2, "max_cand": 24}, "mr": {"retry_ladder": True, "postformat": True, "retrieval": {"enabled": True, "sim_threshold": 0.95, "corpus": "dev"}}, "sc": {"bktree": True, "paradigm_cap": 30, "topups": {"diacritic": {"dsb": {"enabled": True, "min_freq": 5}, "hsb": {"enabled": False}}}}}
    silent = lambda task: lambda: lambda prompts, **options: [{"sc": "", "mr": "", "mt": "".join(p[-60:] for p in prompts[:1])}[task]] * len(prompts)
    res = config.Resources({"dict_dir": str(lex), "mono_dir": str(mono), "pool_dir": str(pools), "mr_dev_dir": str(dev)})
    written = folder.run(spark, config.validate(settings), str(tests), str(tmp_path / "out"), silent, res, ("sc", "mr", "mt"))
    got = {os.path.basename(p): [json.loads(x) for x in open(p, encoding="utf-8")] for p in written}
    assert [(r["pred_incorrect"], r["pred_corrected"]) for r in got["dsb-sc_preds.jsonl"]] == [("dalsna", "dalšna")]
    assert got["hsb-mr_preds.jsonl"][0]["pred"] == "12" and "dom pola jězora" in got["deu-hsb_preds.jsonl"][0]["pred"]
    assert folder.fitted(settings)["diacritic"] == {"hsb": None, "dsb": 5} and folder.fitted(settings)["tau"] == {"hsb": None, "dsb": None}
    with pytest.raises(config.ConfigError):
        folder.loader("nothing")


def test_maths_and_error_commands(spark, tmp_path):
    seeds = put(tmp_path / "seeds.json", json.dumps([{"source": "g", "tier": "low", "question_en": "two plus two?", "answer": "4", "rationale_en": "add"}, {"source": "g", "tier": "low", "question_en": "why?", "answer": "because it is so and so on", "rationale_en": ""}]))
    translated = put(tmp_path / "t.jsonl", '{"seed_id": 0, "question": "dwaj plus dwaj?", "rationale": "přičitaj"}\n{"seed_id": 1, "question": "čehodla?", "rationale": ""}\n')
    assert cli.main(["maths-rows", "--seeds", seeds, "--translated", translated, "--out-dir", str(tmp_path / "mr")]) == 0
    assert spark.read.json(str(tmp_path / "mr")).count() == 1
    dic, aff = put(tmp_path / "a.dic", "3\nkniha\nknihu\nhora\n"), put(tmp_path / "a.aff", "SFX A Y 1\nSFX A a u .\n")
    dev = put(tmp_path / "dev.jsonl", "".join(json.dumps({"id": i, "input_sentence": f"To je knihu {i}", "original_sentence": f"To je kniha {i}", "incorrect_word": "knihu", "correct_word": "kniha"}) + "\n" for i in range(6)))
    mono = put(tmp_path / "m.csv", 'x,text\n' + "".join(f'{i},"Nowa kniha steji tu {i}"\n' for i in range(8)))
    command = ["calibrated-errors", "--mono", mono, "--dev", dev, "--dic", dic, "--aff", aff, "--rows", "5", "--out", str(tmp_path / "gc")]
    assert cli.main(command) == 0
    made = spark.read.json(str(tmp_path / "gc")).collect()
    assert len(made) == 5 and all(r["incorrect_word"] == "knihu" for r in made)
    meta = json.loads((tmp_path / "gc.meta.json").read_text())
    assert meta["rows"] == meta["errors"] == 5
    assert cli.main([*command[:-1], str(tmp_path / "gc2")]) == 0 and json.loads((tmp_path / "gc2.meta.json").read_text())["set_hash"] == meta["set_hash"]


def test_deletion_index_is_read_back(spark, tmp_path):
    index = pipelines.lexicon.deletion_index(spark.createDataFrame([("kniha",)], "word string"), 1)
    writers.write_deletion_index(index, str(tmp_path / "i"))
    assert writers.read_deletion_index(spark, str(tmp_path / "i")).count() == index.count() == 6
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        writers.read_deletion_index(spark, str(tmp_path / "missing"))
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        writers.read_deletion_index(spark, str(tmp_path / "other"))
