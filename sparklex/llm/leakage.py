"""Problem 8: passages of held-out items inside corpus documents.

A generalised suffix automaton over the words of the items reads each document's words and gives at every word the
longest match that ends there, and the items that hold it with the length that each of them matches. Matches of an item
are merged into spans, from which its longest run and its coverage follow, and spans beyond the limits can be removed from
the texts. Items that fill one automaton are sent to the tasks. More items are split into blocks with an automaton each:
a filter over their runs of words finds the documents that may hold one, and only those go to the blocks they share a run
with, where the block's items build its automaton and the documents stream through it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.bloom import Bloom, Hashes, build_bloom
from sparklex.llm.text import WORD, folded_script, words
from sparklex.runtime import checkpointed, join_groups

#: Consecutive words from which a passage counts as held.
MIN_WORDS = 8
#: Words of all items in one automaton (some 500 bytes each in a task).
AUTOMATON_WORDS = 200_000
#: Documents of a block, about, that one task reads.
BLOCK_ROWS = 50_000


class Automaton:
    """Generalised suffix automaton over word sequences, with the items of every state of `least` words or more."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.least, self.ids = least, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []
        for item, tokens in items:
            last = 0
            for w in tokens:
                last = self._add(last, self.ids.setdefault(w, len(self.ids)))
                ends.append((last, item))
        # An item holds the states of its ends and, by their links, all shorter ones.
        self.holders: list[set | None] = [None] * len(self.next)
        for state, item in ends:
            while state > 0 and self.length[state] >= least:
                if self.holders[state] is None:
                    self.holders[state] = set()
                if item in self.holders[state]:
                    break
                self.holders[state].add(item)
                state = self.link[state]

    def _add(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def match(self, tokens: list[str]) -> dict[int, tuple[int, list[tuple[int, int]]]]:
        """Items held by the text: the longest run of words of each, and its spans (first word, word behind the last)."""
        found: dict[int, tuple[int, list[tuple[int, int]]]] = {}
        ids, nxt, link, length, least, holders = self.ids, self.next, self.link, self.length, self.least, self.holders
        state = run = 0
        for at, w in enumerate(tokens, 1):
            w = ids.get(w)
            if w is None:
                state = run = 0
                continue
            while state and w not in nxt[state]:
                state = link[state]
                run = length[state]
            to = nxt[state].get(w)
            if to is None:
                state = run = 0
                continue
            state, run = to, run + 1
            if run < least:
                continue
            up, n, seen = state, run, 0
            while up > 0 and n >= least:  # each item with the longest suffix that it holds
                if len(holders[up] or ()) > seen:
                    for item in holders[up]:
                        longest, spans = found.get(item) or found.setdefault(item, (0, []))
                        if spans and spans[-1][1] == at:
                            continue  # a longer suffix was its
                        if spans and at - n <= spans[-1][1]:
                            spans[-1] = (min(spans[-1][0], at - n), at)
                        else:
                            spans.append((at - n, at))
                        found[item] = (max(longest, n), spans)
                    seen = len(holders[up])
                up = link[up]
                n = length[up]
        return found


_LEAKS = "doc_id long, item_id long, longest int, spans array<struct<begin:int,end:int>>"


def _leaks(docs: list, tokens: list[list[str]], automaton: Automaton) -> pa.RecordBatch:
    rows = [(doc, item, longest, [{"begin": a, "end": b} for a, b in spans]) for doc, t in zip(docs, tokens) for item, (longest, spans) in automaton.match(t).items()]
    cols = list(zip(*rows)) or [[]] * 4
    types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "longest", "spans"])


def _matcher(automaton: Automaton):
    def match(batches):
        for batch in batches:
            yield _leaks(batch.column(0).to_pylist(), [words(t) for t in batch.column(1).to_pylist()], automaton)

    return match


def _runs(tokens: list[list[str]], least: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of `least` words, and which text it is of."""
    counts = np.array([len(t) for t in tokens], np.int64)
    h = np.array([hashes[w] for t in tokens for w in t], np.uint64)
    of = np.repeat(np.arange(len(tokens)), counts)
    at = np.flatnonzero(np.arange(len(h)) + least <= np.cumsum(counts)[of])
    run = h[at]
    with np.errstate(over="ignore"):
        for j in range(1, least):
            run = run * np.uint64(0x165667B19E3779F9) + h[at + j]
    return run, of[at]


def _runs_of_items(least: int):
    def keys(batch, hashes):
        return _runs([words(t) for t in batch.column(0).to_pylist()], least, hashes)[0]

    return keys


def _run_rows(least: int, bloom: Bloom | None):
    """(id, run): the distinct runs of each text, of documents only those that the filter may hold."""

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys, of = _runs([words(t) for t in batch.column(1).to_pylist()], least, hashes)
            if bloom is not None:
                ok = bloom.may_hold(keys)
                keys, of = keys[ok], of[ok]
            pairs = np.unique(np.stack([of, keys.view(np.int64)], 1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["id", "run"])

    return run


def _streamed(least: int):
    """Rows sorted by (block, item first): a block's items build its automaton, its documents stream through it."""

    def run(batches):
        block, items, automaton = None, [], None
        for batch in batches:
            docs, tokens = [], []
            for b, is_item, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b != block:
                    if docs:
                        yield _leaks(docs, tokens, automaton)
                    block, items, automaton, docs, tokens = b, [], None, [], []
                if is_item:
                    items.append((key, words(text)))
                    continue
                automaton = automaton or Automaton(items, least)
                docs.append(key)
                tokens.append(words(text))
            if docs:
                yield _leaks(docs, tokens, automaton)

    return run


def _in_blocks(docs: DataFrame, items: DataFrame, min_words: int, automaton_words: int, total: int, block_rows: int) -> DataFrame:
    """leaked spans of many items: documents go to the blocks of items that they share a run of words with."""
    blocks = -(-total // automaton_words)
    items = checkpointed(items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")))
    bloom = build_bloom(items.select("text"), _runs_of_items(min_words), total)
    runs = items.select("item_id", "text").mapInArrow(_run_rows(min_words, None), "id long, run long").join(items.select(F.col("item_id").alias("id"), "block"), "id").select("run", "block").distinct()
    may = checkpointed(docs.mapInArrow(_run_rows(min_words, bloom), "id long, run long"))
    sized = checkpointed(runs.join(may.groupBy("run").agg(F.count("*").alias("n")), "run"))
    wanted = checkpointed(join_groups(may, sized, ["run"], "n").select(F.col("id").alias("doc_id"), "block").distinct())
    # A block that many documents hold is given to several tasks, each with the block's items.
    parts = wanted.groupBy("block").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("parts"))
    spread = items.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("item"), F.col("item_id").alias("key"), "text")
    held = docs.join(wanted, "doc_id").join(F.broadcast(parts), "block")  # a row for each block
    held = held.select("block", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("item"), F.col("doc_id").alias("key"), "text")
    both = spread.unionByName(held).withColumn("place", F.concat_ws(":", "block", "part"))
    return both.repartition("place").sortWithinPartitions("place", F.desc("item")).select("place", "item", "key", "text").mapInArrow(_streamed(min_words), _LEAKS)


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["begin"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _unite(column):
    import pandas as pd

    return pd.Series([[{"begin": a, "end": b} for a, b in _merged(s)] for s in column])


def leaked_items(documents: DataFrame, passages: DataFrame, doc_id="doc_id", text="text", item_id="item_id", passage="text", min_words: int = MIN_WORDS, automaton_words: int = AUTOMATON_WORDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, item_id, longest, covered, spans): documents that hold min_words consecutive words of an item.

    `longest` is the item's longest run of words, `spans` are the places of its runs in the document's words, merged, and
    `covered` counts the words in them. Null and empty texts match nothing; items shorter than min_words never match.
    Repeated ids give one row for each pair, with the spans of all their texts. Items whose words fit one automaton are
    sent to the tasks; beyond automaton_words they are split into blocks, which only documents that share a run reach.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and length(text) > 0")
    items = passages.select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).cast("string").alias("text")).where("item_id is not null and length(text) > 0")
    total = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"[^\p{L}\p{M}\p{N}]+"))), F.lit(0))).first()[0]
    if total <= automaton_words:  # so few words that the driver may hold them
        block = [(r["item_id"], words(r["text"])) for r in items.toLocalIterator()]
        found = docs.mapInArrow(_matcher(Automaton([x for x in block if len(x[1]) >= min_words], min_words)), _LEAKS)
    else:
        found = _in_blocks(docs, items, min_words, automaton_words, total, block_rows)
    grouped = found.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.flatten(F.collect_list("spans")).alias("spans"), F.count("*").alias("n"))
    unite = F.pandas_udf(_unite, "array<struct<begin:int,end:int>>")
    out = grouped.where("n = 1").drop("n").unionByName(grouped.where("n > 1").withColumn("spans", unite("spans")).drop("n"))
    return out.select("doc_id", "item_id", "longest", F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["begin"]).alias("covered"), "spans")


def word_places(text: str) -> list[tuple[int, int]]:
    """Where each word of words(text) begins and ends in the text, with the marks that belong to its last letter."""
    folded, origin = [], []
    for i, ch in enumerate(text):
        x = folded_script(ch)
        folded.append(x)
        origin += [i] * len(x)
    origin.append(len(text))
    out = []
    for m in WORD.finditer("".join(folded)):
        end = origin[m.end() - 1] + 1
        while end < len(text) and not folded[end]:
            end += 1
        out.append((origin[m.start()], end))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these spans and what stands between them."""
    places, out, last = word_places(text), [], 0
    for a, b in spans:
        if a < len(places):
            out.append(text[last : places[a][0]])
            last = places[min(b, len(places)) - 1][1]
    return "".join([*out, text[last:]])


def _cutter(max_words: int):
    def cut(batches):
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if long := [(a, b) for a, b in _merged(spans) if b - a >= max_words]:
                    rows.append((doc, without_spans(text, long), sum(b - a for a, b in long), len(words(text))))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["doc_id", "text", "removed", "n_words"])

    return cut


def cleaned_documents(documents: DataFrame, leaks: DataFrame, max_words: int = MIN_WORDS, max_share: float = 1.0) -> DataFrame:
    """(doc_id, text, removed, n_words): the documents that hold leaked spans, without those of max_words words or more.

    documents has a unique doc_id and text; leaks is what leaked_items gives. `removed` counts the words that were taken
    out of n_words; the text is null if they are more than max_share of the document, which then should be left out whole.
    Spans of several items are merged before they are measured. Documents without such spans give no row: they stay as they are.
    """
    spans = leaks.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    held = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(spans, "doc_id")
    cut = held.select("doc_id", "text", "spans").mapInArrow(_cutter(max_words), "doc_id long, text string, removed int, n_words int")
    return cut.withColumn("text", F.when(F.col("removed") <= F.col("n_words") * F.lit(max_share), F.col("text")))
