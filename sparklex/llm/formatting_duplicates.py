"""Problem 2: records that differ only in formatting.

Columns are dictionary-encoded: within a task each distinct value of a field is canonicalised once and gets an integer
identifier of 128 bits, the hash of field and canonical form, so that dictionaries of different tasks agree without a
shuffle of text. A record becomes the sorted tuple of its fields' identifiers, and the tuples are grouped as they are.
"""

from __future__ import annotations

import json
import re
import unicodedata
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.text import _Lazy
from sparklex.runtime import checkpointed, join_groups

#: Entries of one dictionary; a fuller one is dropped and begun anew, which costs time and changes no result.
DICTIONARY = 500_000

_KEEP = _Lazy(lambda ch: None if unicodedata.category(ch)[0] in "PZC" else ch)
_NO_BLANKS = _Lazy(lambda ch: None if unicodedata.category(ch)[0] in "ZC" else ch)


# What stands for a decimal mark, for the space between two figures and for a sign.
DECIMAL, APART, SIGN = "␞", "␟", "␝"
_DECIMAL = re.compile(r"(?<=[0-9])[.,](?=[0-9])")
_APART = re.compile(r"(?<=[0-9])[\W_]+(?=[0-9])")
_SIGN = re.compile(r"(?<!\S)[-−](?=[0-9])")


def canonical_text(value: str) -> str:
    """Without white space, punctuation and letter case (ß equals SS); accents, figures and symbols stay.

    Figures stay what they are: a point or comma within one is its decimal mark, a minus before one its sign, and two
    figures with anything else between them don't become one.
    """
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", value).casefold())
    if any(map(str.isdigit, text)):
        text = _APART.sub(lambda m: m.group().translate(_KEEP) or APART, _DECIMAL.sub(DECIMAL, _SIGN.sub(SIGN, text)))
    return text.translate(_KEEP)


def canonical_id(value: str) -> str:
    """Without white space and letter case."""
    return unicodedata.normalize("NFC", value).casefold().translate(_NO_BLANKS)


def canonical_value(value) -> str:
    """The canonical form of any JSON value: lists and objects keep their structure, only their texts lose formatting."""
    if isinstance(value, str):
        return canonical_text(value)

    def inner(x):
        if isinstance(x, dict):
            return {k: inner(v) for k, v in x.items()}
        return [inner(v) for v in x] if isinstance(x, list) else canonical_text(x) if isinstance(x, str) else x

    return "\x01" + json.dumps(inner(value), ensure_ascii=False, sort_keys=True)


def _encoder(id_fields: frozenset[str]):
    def encode(batches):
        codes: dict[tuple, bytes] = {}
        for batch in batches:
            ids, tuples = [], []
            for line_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    record = json.loads(payload, parse_int=str, parse_float=str) if payload else None
                except (ValueError, RecursionError):
                    record = None
                if not isinstance(record, dict):
                    continue
                parts = []
                for item in record.items():
                    field, value = item
                    plain = item if isinstance(value, str) else (field, canonical_value(value), None)
                    code = codes.get(plain)
                    if code is None:
                        if len(codes) >= DICTIONARY:
                            codes.clear()
                        canon = plain[1] if len(plain) == 3 else canonical_id(value) if field in id_fields else canonical_text(value)
                        code = codes[plain] = blake2b(f"{field}\0{canon}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    parts.append(code)
                parts.sort()
                ids.append(line_id)
                tuples.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tuples, pa.binary())], ["line_id", "record"])

    return encode


def record_tuples(lines: DataFrame, line_id: str = "line_id", payload: str = "payload", id_fields=("dataset_id", "sent_id", "id")) -> DataFrame:
    """(line_id, record): each line's sorted tuple of value identifiers, 16 bytes each.

    Null, blank and broken payloads and payloads that are no JSON object have no row. An id is the same as number and as
    string; other values lose white space, case and punctuation. Fields keep their names; a null value differs from an
    absent field. Other columns of `lines`, whatever their names, are not read.
    """
    return lines.select(F.col(line_id).cast("long").alias("line_id"), F.col(payload).cast("string").alias("payload")).where("line_id is not null and payload is not null").mapInArrow(_encoder(frozenset(id_fields)), "line_id long, record binary")


def collapse_records(lines: DataFrame, **names) -> DataFrame:
    """(first_id, copies): one row for each record, with its smallest line_id and the number of its lines."""
    return record_tuples(lines, **names).groupBy("record").agg(F.min("line_id").alias("first_id"), F.count("*").alias("copies")).select("first_id", "copies")


def formatting_copies(lines: DataFrame, **names) -> DataFrame:
    """(first_id, copy_id): one row for each further line of a record. Lines with a repeated line_id count once."""
    tuples = checkpointed(record_tuples(lines, **names))
    groups = tuples.groupBy("record").agg(F.min("line_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return join_groups(tuples, groups, ["record"], "n").where("line_id > first_id").select("first_id", F.col("line_id").alias("copy_id")).distinct()
