"""Runs a folder of task files to prediction files: readers, pipelines and writers joined, by a checked configuration."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.functions import text as T
from sparklex.operators import lexicon, model
from sparklex.plans import pipelines
from sparklex.plans.config import DEFAULTS, ConfigError, Resources, setting
from sparklex.runtime import checkpointed, numbered
from sparklex.sources import files, readers, writers

TASKS = ("mt", "qa", "sc", "gc", "mr")
# How the files' names spell a language, and the names themselves.
SPELT = {"de": "deu"}
NAMES = {"mt": "{}_preds.jsonl", "qa": "{}_qa_preds.jsonl", "sc": "{}-sc_preds.jsonl", "gc": "{}-gc_preds.jsonl", "mr": "{}-mr_preds.jsonl"}


def fitted(config: dict) -> dict:
    """The settings of the correction pipelines as the configuration has them, else their defaults."""
    out = dict(DEFAULTS)
    for name, path in (("gc_paradigm_cap", "gc.paradigm_cap"), ("sc_paradigm_cap", "sc.paradigm_cap"), ("max_cand", "engine.max_cand"), ("batch", "engine.batch"), ("exemplar_k", "mt.exemplar_k")):
        out[name] = setting(config, path, DEFAULTS[name])
    out["witness"] = {x: setting(config, f"gc.witness.{x}", DEFAULTS["witness"][x]) for x in ("hsb", "dsb")}
    on = lambda path: bool(setting(config, f"{path}.enabled", False))
    out["diacritic"] = {x: setting(config, f"sc.topups.diacritic.{x}.min_freq") if on(f"sc.topups.diacritic.{x}") else None for x in ("hsb", "dsb")}
    out["tau"] = {x: setting(config, f"sc.topups.nonword.tau_{x}") if on("sc.topups.nonword") else None for x in ("hsb", "dsb")}
    return out


def loader(name: str) -> Callable[[str], Callable[[], model.Model]]:
    """`module:function`: given a task, the function gives what loads its model in a task."""
    module, _, function = name.partition(":")
    if not function:
        raise ConfigError(f"model: {name} isn't module:function")
    return getattr(importlib.import_module(module), function)


def _forms(spark: SparkSession, resources: Resources, lang: str) -> tuple[DataFrame, list[str]]:
    folder = resources.path("dict_dir")
    rules = readers.read_affixes(os.path.join(folder, f"{lang}.aff"))
    stems = lexicon.stems(readers.read_dictionary(spark, os.path.join(folder, f"{lang}.dic")))
    return checkpointed(lexicon.expand(stems, rules)), rules.maps


def _translated(spark, items, lang, generate, config, resources) -> DataFrame:
    source, target = lang
    rows = items.withColumn("source", F.col(source))
    memory = None
    if config["stack"] == "composed":
        stem = os.path.join(resources.path("pool_dir"), f"{source}_{target}")
        memory = readers.read_parallel(spark, f"{stem}.src", f"{stem}.tgt", f"{source}-{target}")
    return pipelines.mt(rows, memory, source, target, generate, setting(config, "mt.exemplar_k"))


def _corrected(spark, items, lang, task, generate, config, resources) -> DataFrame:
    rows = items.withColumn("sentence", F.col("input_sentence"))
    if config["stack"] != "composed":
        raw = generate(rows.select("item_id", T.sc_gc_prompt("sentence", task).alias("prompt")))
        return rows.join(raw, "item_id", "left").withColumns({"pred_incorrect": T.wrong_word("raw"), "pred_corrected": T.corrected_word("raw")})
    forms, maps = _forms(spark, resources, lang)
    mono = readers.read_csv_text(spark, os.path.join(resources.path("mono_dir"), f"{lang}.csv"))
    return pipelines.sc_gc(rows, task, lang, generate, forms, maps, mono, fitted=fitted(config))


def _solved(spark, items, lang, generate, config, resources) -> DataFrame:
    composed, dev = config["stack"] == "composed", None
    if composed and setting(config, "mr.retrieval.enabled", False):
        path = os.path.join(resources.path("mr_dev_dir"), f"{lang}_mr_dev.jsonl")
        dev = numbered(readers.read_task(spark, path, "mr", dev=True), "idx").select("idx", F.col("question").alias("text"), "answer")
    return pipelines.mr(items, generate, dev, setting(config, "mr.retrieval.sim_threshold", DEFAULTS["sim_threshold"]), ladder=composed and bool(config["mr"]["retry_ladder"]), formatted=composed and bool(config["mr"]["postformat"]))


def run(spark: SparkSession, config: dict, test_dir: str, out_dir: str, load: Callable[[str], Callable[[], model.Model]], resources: Resources, tasks=TASKS, slot_scores=None) -> list[str]:
    """Paths of the prediction files, one for each task file of the folder, rows in the order of its lines.

    Fails before any job if no task that is asked for has a file; tasks without one are left out.
    """
    found = readers.discover(test_dir)
    if not any(found.get(t) for t in tasks):
        raise ConfigError(f"{test_dir}: no file of {sorted(tasks)}")
    files.make_folder(out_dir)
    written = []
    for task in (t for t in TASKS if t in tasks):
        generate = model.generator(load(task), task, setting(config, "engine.batch", DEFAULTS["batch"]))
        for lang, path in found.get(task, []):
            items = numbered(readers.read_task(spark, path, task), "item_id")
            match task:
                case "mt":
                    rows = _translated(spark, items, lang, generate, config, resources)
                case "qa":
                    rows = pipelines.qa(items, generate, slot_scores if config["qa"]["slot_scorer"] and config["stack"] == "composed" else None)
                case "mr":
                    rows = _solved(spark, items, lang, generate, config, resources)
                case _:
                    rows = _corrected(spark, items, lang, task, generate, config, resources)
            name = "-".join(SPELT.get(x, x) for x in lang) if task == "mt" else lang
            written.append(os.path.join(out_dir, NAMES[task].format(name)))
            writers.write_task(rows, task, written[-1], "item_id")
    return written
