"""spark-submit entry: runs test folders, cleans pools, writes edit-distance indexes, makes synthetic rows, checks configurations."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparklex.functions import text as T
from sparklex.operators import lexicon, package, stats, synth
from sparklex.plans import config, folder, pipelines
from sparklex.runtime import checkpointed, numbered
from sparklex.sources import files, readers, schemas, writers

FIELDS = ["source", "input_sentence", "question", "de", "hsb", "dsb"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparklex")
    sub = p.add_subparsers(dest="command", required=True)
    pools = sub.add_parser("clean-pools", help="remove test material from parallel pools")
    pools.add_argument("--pools", required=True, help="folder of <src>_<tgt>.src and .tgt files")
    pools.add_argument("--test-dir", required=True)
    pools.add_argument("--out-dir", required=True)
    pools.add_argument("--cap", type=int, default=config.DEFAULTS["pool_cap"])
    index = sub.add_parser("deletion-index", help="write the index of a dictionary's stems for edit distances")
    index.add_argument("--dic", required=True)
    index.add_argument("--edits", type=int, default=2)
    index.add_argument("--out", required=True)
    synth = sub.add_parser("synthesise", help="make training rows with synthetic errors or questions")
    synth.add_argument("--task", choices=("sc", "gc", "qa"), required=True)
    synth.add_argument("--lang", choices=("hsb", "dsb"), required=True)
    synth.add_argument("--mono", nargs="+", required=True, help="sources from the best to the worst")
    synth.add_argument("--held-out", nargs="*", default=[], help="JSONL files whose texts must not come in")
    synth.add_argument("--pool-size", type=int, required=True)
    synth.add_argument("--volume", type=int)
    synth.add_argument("--seed", default=str(config.DEFAULTS["seed"]))
    synth.add_argument("--out-dir", required=True)
    predict = sub.add_parser("predict", help="run a folder of task files to prediction files")
    predict.add_argument("--config", required=True)
    predict.add_argument("--test-dir", required=True)
    predict.add_argument("--out-dir", required=True)
    predict.add_argument("--model", required=True, help="module:function that gives a task's model")
    predict.add_argument("--resources", help="JSON file of folders: dict_dir, mono_dir, pool_dir, mr_dev_dir")
    predict.add_argument("--pool-override", help="another folder of pools")
    predict.add_argument("--tasks", default=",".join(folder.TASKS))
    seeds = sub.add_parser("maths-rows", help="make training rows of maths seeds and their translations")
    seeds.add_argument("--seeds", required=True, help="JSON array or lines of parsed seeds")
    seeds.add_argument("--translated", required=True, help="JSONL of seed_id, question, rationale")
    seeds.add_argument("--out-dir", required=True)
    errors = sub.add_parser("calibrated-errors", help="make rows with the errors of a development set")
    errors.add_argument("--mono", required=True, help="CSV file, texts in its last column")
    errors.add_argument("--dev", required=True)
    errors.add_argument("--forbidden", nargs="*", default=[], help="JSONL files whose texts must not come in")
    errors.add_argument("--dic", required=True)
    errors.add_argument("--aff", required=True)
    errors.add_argument("--rows", type=int, required=True)
    errors.add_argument("--seed", default=str(config.DEFAULTS["seed"]))
    errors.add_argument("--out", required=True)
    check = sub.add_parser("check-config", help="check a configuration before any job runs")
    check.add_argument("config")
    return p


def clean_pools(spark: SparkSession, pools: str, test_dir: str, out_dir: str, cap: int) -> int:
    """Writes each direction's cleaned pool and the funnel; fails before any job if there is nothing to read."""
    found = readers.discover(test_dir)
    tests = [readers.read_jsonl(spark, path, schemas.TASKS[task]) for task, files in found.items() for _, path in files]
    there = set(files.names(pools))
    stems = sorted(f[:-4] for f in there if f.endswith(".src") and f[:-4] + ".tgt" in there)
    if not tests or not stems:
        print(f"nothing to do: {len(tests)} test files, {len(stems)} pools", file=sys.stderr)
        return 2
    for stem in stems:
        pairs = readers.read_parallel(spark, os.path.join(pools, stem + ".src"), os.path.join(pools, stem + ".tgt"), stem.replace("_", "-"))
        pool, funnel = pipelines.clean_pool(pairs, tests, FIELDS, cap=cap)
        writers.write_pool(pool, os.path.join(out_dir, stem))
        writers.write_meta(funnel, os.path.join(out_dir, f"{stem}.json"))
    return 0


def synthesise(spark: SparkSession, a: argparse.Namespace) -> int:
    """Writes rows by part (train, pool); fails if no source is there."""
    mono = readers.read_mono(spark, a.mono, a.lang)
    if mono.isEmpty():
        print("no text in the sources", file=sys.stderr)
        return 2
    rows = mono.select((F.col("source_rank") * F.lit(1 << 40) + F.col("ord")).alias("ord"), "text")
    held = readers.read_blocklist(spark, a.held_out, "input_sentence string, original_sentence string, context string, question string", ["input_sentence", "original_sentence", "context", "question"], first_only=False)
    words = [r["token"] for r in stats.frequency_vocab(rows, "text", "ord").collect()] if a.task == "qa" else None  # 5,000 at most
    out = pipelines.synthesise(rows, a.task, a.lang, held.select(T.fold_key("text").alias("text")), a.seed, a.pool_size, a.volume, vocabulary=words)
    writers.write_bundle(out, a.out_dir, ["part"])
    return 0


def predict(spark: SparkSession, a: argparse.Namespace) -> int:
    """Writes a prediction file for each task file; fails before any job if the configuration or the folder lacks something."""
    settings = config.load(a.config)
    paths = {}
    if a.resources:
        with open(a.resources, encoding="utf-8") as f:
            paths = json.load(f)
    resources = config.Resources(paths, {"pool_dir": a.pool_override} if a.pool_override else {}, dict(os.environ))
    try:
        written = folder.run(spark, settings, a.test_dir, a.out_dir, folder.loader(a.model), resources, tuple(a.tasks.split(",")))
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    print("\n".join(written))
    return 0


def maths_rows(spark: SparkSession, a: argparse.Namespace) -> int:
    seeds = numbered(readers.read_json_array(spark, a.seeds, schemas.SEED), "seed_id")
    translated = readers.read_jsonl(spark, a.translated, "seed_id long, question string, rationale string")
    writers.write_bundle(pipelines.maths_rows(seeds, translated), a.out_dir, ["tier"])
    return 0


def calibrated_errors(spark: SparkSession, a: argparse.Namespace) -> int:
    """Writes the rows and, beside them, their counts and the hash of the set."""
    fields = ["input_sentence", "original_sentence", "source", "question", "de", "hsb", "dsb"]
    forbidden = readers.read_blocklist(spark, [a.dev, *a.forbidden], ", ".join(f"{f} string" for f in fields), fields, first_only=False)
    dev = readers.read_task(spark, a.dev, "sc", dev=True)
    forms = lexicon.expand(lexicon.stems(readers.read_dictionary(spark, a.dic)), readers.read_affixes(a.aff))
    mono = numbered(readers.read_csv_text(spark, a.mono), "ord")
    out = checkpointed(pipelines.calibrated(mono, dev, forbidden, checkpointed(forms), a.rows, a.seed))
    if out.isEmpty():
        print("no row could be made", file=sys.stderr)
        return 2
    writers.write_jsonl(out, a.out)
    writers.write_meta(synth.synthesis_meta(out), f"{a.out}.meta.json", set_hash=package.set_hash(out))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "check-config":
        config.load(a.config)
        return 0
    spark = SparkSession.builder.appName("sparklex").getOrCreate()
    if a.command == "deletion-index":
        stems = lexicon.stems(readers.read_dictionary(spark, a.dic)).select(F.col("stem").alias("word"))
        writers.write_deletion_index(lexicon.deletion_index(stems, a.edits), a.out)
        return 0
    if a.command == "calibrated-errors":
        return calibrated_errors(spark, a)
    files.make_folder(a.out_dir)
    if a.command == "predict":
        return predict(spark, a)
    if a.command == "maths-rows":
        return maths_rows(spark, a)
    if a.command == "synthesise":
        return synthesise(spark, a)
    return clean_pools(spark, a.pools, a.test_dir, a.out_dir, a.cap)


if __name__ == "__main__":
    sys.exit(main())
