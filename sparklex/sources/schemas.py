"""Explicit schemas of the task files; nothing is inferred."""

from __future__ import annotations

# Ids and answers come as numbers or strings; they are read as strings.
MT = "dataset_id string, sent_id string, de string, hsb string, dsb string"
QA = "dataset_id string, question_id string, context string, question string, possible_answers map<string,string>"
SENTENCE = "dataset_id string, id string, input_sentence string"
SENTENCE_DEV = "id string, input_sentence string, original_sentence string, incorrect_word string, correct_word string"
MR = "dataset_id string, id string, question string"
MR_DEV = "dataset_id string, id string, question string, answer string"
CHAT = "messages array<struct<role:string,content:string>>"
SEED = "source string, tier string, question_en string, answer string, rationale_en string"
MANIFEST = "dataset_name string, retrieved_at string, files array<struct<name:string,sha256:string,bytes:bigint>>"

TASKS = {"mt": MT, "qa": QA, "sc": SENTENCE, "gc": SENTENCE, "mr": MR}
DEV = {"mt": MT, "qa": QA, "sc": SENTENCE_DEV, "gc": SENTENCE_DEV, "mr": MR_DEV}

# Names of the task files.
MT_FILES = {("de", "hsb"): "deu-hsb_mt_test.jsonl", ("hsb", "de"): "hsb-deu_mt_test.jsonl", ("de", "dsb"): "deu-dsb_mt_test.jsonl", ("dsb", "de"): "dsb-deu_mt_test.jsonl", ("hsb", "dsb"): "hsb-dsb_mt_test.jsonl", ("dsb", "hsb"): "dsb-hsb_mt_test.jsonl"}
OTHER_FILES = {task: "{lang}_" + task + "_test.jsonl" for task in ("qa", "sc", "gc", "mr")}
