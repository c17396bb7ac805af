"""Problem 5: evaluation items that stand, exactly or almost, in training messages.

The words of both splits are seen as suffixes: a text from a word on. Two changed words cut an item into pieces of which
one holds a whole third of it, so an item is looked for by the suffixes that begin at its thirds, and a message by all of
its suffixes that share such a seed with an item. These are put into one suffix array that is partitioned by ranges of the
suffixes: their keys are cut at quantiles, each range is sorted in one task, and the common prefixes of neighbours tell
the runs in which suffixes of both splits share a seed. A run that a range's end cuts is whole on both sides, as an item's
suffix goes to every range that its seed reaches into; so a prefix that many messages share is spread over many ranges.
Around each shared prefix the shared span is extended; the spans of an item and a message are merged into the item's
coverage, and an exact edit distance around them decides.

As all figures must agree, the figure next to a suffix leads its key, and the words around a seed are compared before a
pair is written down. Items of three to five words have pairs of words, with gaps between them, as seeds. Bloom filters
over the seeds of both splits, sized by their number, keep suffixes that can't meet any of the other split out of the
array; they never decide a match.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.bloom import Bloom, Hashes, build_bloom, mix
from sparklex.llm.text import WORD, fold
from sparklex.runtime import HOT_ROWS, checkpointed, join_groups

#: Changed words that an item may have.
EDITS = 2
#: Suffixes of messages, about, in one range of the array.
RANGE_ROWS = 50_000
#: Pairs of suffixes that are written down at a time.
CHUNK = 500_000

_GAPPED = 0  # the seed of short items: two words with a gap
_MOST_GAP = 4 + EDITS
_LONGEST_SEED = 8
_KEY_WORDS = _LONGEST_SEED + EDITS
_COLUMNS = 2 + _KEY_WORDS + 1
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_R = np.uint64(0x165667B19E3779F9)


def allowed(n: int) -> int:
    """Changed words that an item of n words may have: two of its words must be left."""
    return max(0, min(EDITS, n - 2))


def seed_words(n) -> np.ndarray:
    """Words of the seeds of items of n words; allowed(n) changes leave one of them whole."""
    return np.select([n < 3, n < 6], [n, _GAPPED], np.minimum(n // (EDITS + 1), _LONGEST_SEED))


def _width(code: np.ndarray) -> np.ndarray:
    return np.where(code == _GAPPED, 2, code)


class Laid:
    """The words of several texts end to end: their hashes, each place's text and its ends, and the nearest figures."""

    def __init__(self, tokens: list[list[str]], hashes: Hashes):
        counts = np.array([len(t) for t in tokens], np.int64)
        self.h = h = np.array([hashes[w] for t in tokens for w in t], np.uint64)
        n = len(h)
        self.of = np.repeat(np.arange(len(tokens)), counts)
        self.begin = (np.cumsum(counts) - counts)[self.of]
        self.words = counts[self.of]
        self.end = self.begin + self.words
        self.place = place = np.arange(n)
        self.figure: dict[int, np.ndarray] = {}
        self.has: dict[int, np.ndarray] = {}
        if n:
            fig = (h & np.uint64(1)).astype(bool)
            after = np.minimum.accumulate(np.where(fig, place, n)[::-1])[::-1]
            before = np.append(-1, np.maximum.accumulate(np.where(fig, place, -1))[:-1])
            self.has = {1: after < self.end, 2: before >= self.begin, 0: np.ones(n, bool)}
            self.figure = {1: h[np.minimum(after, n - 1)], 2: h[np.maximum(before, 0)], 0: np.zeros(n, np.uint64)}

    def seeds(self, code: int):
        """(places, hash of the seed that begins there, gap to its last word) of all seeds of this kind."""
        if code == _GAPPED:
            for gap in range(1, _MOST_GAP + 1):
                at = np.flatnonzero(self.place + gap < self.end)
                yield at, self.gram(at, code, gap), gap
            return
        at = np.flatnonzero(self.place + code <= self.end)
        yield at, self.gram(at, code, code - 1), code - 1

    def gram(self, at: np.ndarray, code: int, gap: int) -> np.ndarray:
        """The hash of the seeds that begin at these places."""
        gram = self.h[at]
        with np.errstate(over="ignore"):
            for j in (gap,) if code == _GAPPED else range(1, code):
                gram = gram * _R + self.h[at + j]
        return gram

    def keys(self, at: np.ndarray, gram: np.ndarray, code: int, side: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(gram * _P + self.figure[side][at] * _Q + np.uint64(code * 4 + side + 1) * _R)

    def own_sides(self) -> np.ndarray:
        """Where an item's suffix has its figure: 1 from its place on, 2 before it, 0 nowhere."""
        return np.where(self.has[1], 1, np.where(self.has[2], 2, 0))

    def item_seeds(self):
        """(code, side, places, hashes of the seeds, gap) of the suffixes that items are looked for by."""
        if not len(self.h):
            return
        code_of, sides, inside = seed_words(self.words), self.own_sides(), self.place - self.begin
        third = (self.words < 3) & (inside == 0) | (code_of == _GAPPED)
        for i in range(EDITS + 1):
            third |= inside == self.words * i // (EDITS + 1)
        for code in np.unique(code_of).tolist():
            for at, gram, gap in self.seeds(code):
                for side in (0, 1, 2):
                    own = (code_of[at] == code) & (sides[at] == side) & third[at]
                    if own.any():
                        yield code, side, at[own], gram[own], gap

    def suffix_keys(self, code: int, side: int, at: np.ndarray, gap: int, tail: np.ndarray) -> np.ndarray:
        """The suffixes' keys: kind, figure, words by their hashes, and a tail that tells equal ones apart."""
        out = np.zeros((len(at), _COLUMNS), ">u4")
        out[:, 0] = code * 4 + side
        out[:, 1] = self.figure[side][at] >> np.uint64(32)
        h = (self.h >> np.uint64(32)).astype(np.uint32)
        steps = (0, gap) if code == _GAPPED else range(_KEY_WORDS)
        for j, step in enumerate(steps):
            inside = at + step < self.end[at]
            out[inside, 2 + j] = h[at[inside] + step]
        out[:, -1] = tail
        return out

    def words_before(self, at: np.ndarray) -> np.ndarray:
        """As many words before each place as a key has behind it, the nearest first."""
        out = np.zeros((len(at), _KEY_WORDS), ">u4")
        h = (self.h >> np.uint64(32)).astype(np.uint32)
        for j in range(_KEY_WORDS):
            inside = at - 1 - j >= self.begin[at]
            out[inside, j] = h[at[inside] - 1 - j]
        return out


def _item_keys(laid: Laid) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(laid.keys(at, gram, code, side) for code, side, at, gram, _ in laid.item_seeds())])


def _class_keys(batch: pa.RecordBatch, hashes: Hashes) -> np.ndarray:
    return _item_keys(Laid([t.split(" ") for t in batch.column(0).to_pylist()], hashes))


def _text_keys(batch: pa.RecordBatch, hashes: Hashes) -> np.ndarray:
    laid, kinds = _placed(batch.column(0), batch.column(1), hashes)
    return np.concatenate([np.zeros(0, np.uint64), *(laid.keys(at, laid.gram(at, code, gap), code, side) for code, side, gap, at in kinds)])


def _normal(batches):
    """The items' words; an item of two words also has them exchanged."""
    for batch in batches:
        which, text = [], []
        for i, t in enumerate(batch.column(2).to_pylist()):
            w = WORD.findall(fold(t))
            for form in (w, w[::-1]) if len(w) == 2 and not any(map(_has_figure, w)) else (w,):
                which.append(i)
                text.append(" ".join(form))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(which, pa.int64())) for c in (0, 1)), pa.array(text, pa.string())], ["eval_table", "item_key", "norm"])


def _scan(bloom: Bloom, kinds: list[tuple[int, int]]):
    """Messages that hold a seed: their words, and the places, kinds and gaps of their seeds in one number each."""

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            tokens = [WORD.findall(fold(t)) for t in batch.column(1).to_pylist()]
            laid = Laid(tokens, hashes)
            places: list[np.ndarray] = []
            for code in sorted({c for c, _ in kinds}) if len(laid.h) else ():
                for at, gram, gap in laid.seeds(code):
                    for side in (s for c, s in kinds if c == code):
                        fits = np.flatnonzero(laid.has[side][at])
                        ok = fits[bloom.may_hold(laid.keys(at[fits], gram[fits], code, side))]
                        places.append(at[ok] << 10 | gap << 6 | code << 2 | side)
            hits = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
            own, first = np.unique(laid.of[hits >> 10], return_index=True)
            parts = np.split(hits, first[1:]) if len(own) else []
            start = [laid.begin[p[0] >> 10] for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own, pa.int64())), pa.array([" ".join(tokens[i]) for i in own], pa.string()), pa.array([p - (s << 10) for p, s in zip(parts, start)], pa.list_(pa.int64()))],
                ["row_id", "norm", "places"],
            )

    return run


_SUFFIX = "range int, key binary, item boolean, k1 long, k2 long, pos int, context binary"


def _binary(numbers: np.ndarray) -> pa.Array:
    """Each row of numbers as bytes that sort like them."""
    size = 4 * numbers.shape[1]
    offsets = np.arange(0, (len(numbers) + 1) * size, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(offsets), pa.py_buffer(numbers.astype(">u4").tobytes())])


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, width)


def _suffix_batch(rows: list[tuple], item: bool) -> pa.RecordBatch:
    """rows: (ranges, keys, k1, k2, places, words before)."""
    rows = rows or [(np.zeros(0, np.int32), np.zeros((0, _COLUMNS), ">u4"), *[np.zeros(0, np.int64)] * 3, np.zeros((0, _KEY_WORDS), ">u4"))]
    ranges, keys, k1, k2, pos, context = (np.concatenate(x) for x in zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), _binary(keys), pa.array(np.full(len(keys), item)), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(pos, pa.int32()), _binary(context)], ["range", "key", "item", "k1", "k2", "pos", "context"])


def _placed(norm: pa.Array, places: pa.Array, hashes: Hashes):
    """The messages laid out, and (code, side, gap, places) of each kind of their seeds."""
    tokens = [t.split(" ") for t in norm.to_pylist()]
    begin = np.cumsum([0, *map(len, tokens)])[:-1]
    hits = places.flatten().to_numpy(zero_copy_only=False) + (np.repeat(begin, places.value_lengths().to_numpy(zero_copy_only=False)) << 10)
    return Laid(tokens, hashes), [(kind >> 2 & 15, kind & 3, kind >> 6, hits[(hits & 1023) == kind] >> 10) for kind in np.unique(hits & 1023).tolist()]


def _message_suffixes(bounds: list[bytes]):
    def run(batches):
        hashes = Hashes()
        for batch in batches:
            m1, m2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            laid, kinds = _placed(batch.column(0), batch.column(1), hashes)
            out = []
            for code, side, gap, at in kinds:
                keys = laid.suffix_keys(code, side, at, gap, (m2[laid.of[at]] & 0xFFFFFFFF).astype(np.uint32))
                ranges = np.array([bisect_right(bounds, k.tobytes()) for k in keys], np.int32) if bounds else np.zeros(len(at), np.int32)
                out.append((ranges, keys, m1[laid.of[at]], m2[laid.of[at]], at - laid.begin[at], laid.words_before(at)))
            yield _suffix_batch(out, False)

    return run


def _item_suffixes(bounds: list[bytes], met: Bloom):
    """The items' suffixes that a message's may meet, each in all ranges that its seed reaches into."""

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            laid = Laid([t.split(" ") for t in batch.column(0).to_pylist()], hashes)
            out = []
            for code, side, at, gram, gap in laid.item_seeds():
                at = at[met.may_hold(laid.keys(at, gram, code, side))]
                keys = laid.suffix_keys(code, side, at, gap, np.zeros(len(at), np.uint32))
                size = 4 * (2 + int(_width(np.array(code))))
                low, high = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
                for i, k in enumerate(keys if bounds else ()):
                    seed = k.tobytes()[:size]
                    low[i], high[i] = bisect_right(bounds, seed), bisect_right(bounds, seed + b"\xff" * (4 * _COLUMNS - size))
                times = high - low + 1
                which = np.repeat(np.arange(len(at)), times)
                ranges = (np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32) + low[which]
                out.append((ranges, keys[which], k1[laid.of[at]][which], k2[laid.of[at]][which], (at - laid.begin[at])[which], laid.words_before(at)[which]))
            yield _suffix_batch(out, True)

    return run


def _pairs_in_runs(run: np.ndarray, item: np.ndarray):
    """Yields (items, messages): row numbers of the suffixes of both splits in one run."""
    order = np.lexsort((~item, run))  # the items of each run first
    run, item = run[order], item[order]
    begin = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    number = np.cumsum(np.append(True, run[1:] != run[:-1])) - 1
    items = np.add.reduceat(item, begin, dtype=np.int64)
    messages = np.flatnonzero(~item)
    times = items[number[messages]]
    messages, times = messages[times > 0], times[times > 0]
    upto = np.cumsum(times)
    at = 0
    while at < len(messages):
        done = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, done + CHUNK, side="right")))
        t = times[at:to]
        m = np.repeat(messages[at:to], t)
        i = begin[number[m]] + np.arange(len(m)) - np.repeat(np.cumsum(t) - t, t)
        yield order[i], order[m]
        at = to


def _missing(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of each row's words, but for the last EDITS of the row, don't stand in the other row."""
    out = np.zeros(len(words), np.int64)
    for j in range(_KEY_WORDS - EDITS):
        out += (words[:, j] != 0) & ~(others == words[:, j : j + 1]).any(1)
    return out


def _shared_prefixes(batches):
    """The runs of sorted suffixes, by the common prefixes of neighbours, and the spans that begin in them.

    Of the words around the span only so many may be missing in the message as may be changed.
    """

    def spans(ranges, keys, item, k1, k2, pos, context):
        unlike = keys[1:, :-1] != keys[:-1, :-1]
        common = np.where(unlike.any(1), unlike.argmax(1), _COLUMNS - 1)  # kind, figure and words that two neighbours share
        kind = keys[:, 0].astype(np.int64) >> 2
        new = (common < 2 + _width(kind[1:])) | (ranges[1:] != ranges[:-1])
        behind, context = keys[:, 2 : 2 + _KEY_WORDS].astype(np.uint32), context.astype(np.uint32)
        for a, b in _pairs_in_runs(np.append(0, np.cumsum(new)), item):
            near = (kind[a] == _GAPPED) | (_missing(behind[a], behind[b]) <= EDITS)
            a, b = a[near], b[near]
            near = (kind[a] == _GAPPED) | (_missing(behind[a], behind[b]) + _missing(context[a], context[b]) <= EDITS)
            a, b = a[near], b[near]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[b], k2[b], k1[a], k2[a], pos[a], pos[b])], ["m1", "m2", "k1", "k2", "ipos", "mpos"])

    rest: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        more = [batch.column(0).to_numpy(), _numbers(batch.column(1), _COLUMNS), *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)), _numbers(batch.column(6), _KEY_WORDS)]
        rest = [np.concatenate(x) for x in zip(rest, more)] if rest else more
        # All but the last run, which may go on.
        width = 2 + int(_width(np.array(int(rest[1][-1, 0]) >> 2)))
        same = (rest[1][:, :width] == rest[1][-1, :width]).all(1) & (rest[0] == rest[0][-1])
        if cut := int(np.argmax(same)):
            yield from spans(*(x[:cut] for x in rest))
            rest = [x[cut:] for x in rest]
    if rest:
        yield from spans(*rest)


def _has_figure(w: str) -> bool:
    return any(map(str.isdigit, w))


def _extend(a: list[str], b: list[str], most: int) -> int:
    """Least changed words to turn a into a prefix of b, or most + 1; words with figures can't be changed."""
    far = most + 1
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:  # the common prefix
        i += 1
    a, b = a[i:], b[i : len(a) + most]
    if not a:
        return 0
    row = [0]
    for j in range(1, min(len(b), most) + 1):
        row.append(far if _has_figure(b[j - 1]) else min(far, row[-1] + 1))
    row += [far] * (len(b) + 1 - len(row))
    for i, x in enumerate(a, 1):
        fx = _has_figure(x)
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        if i <= most and not fx and row[0] < far:
            new[0] = min(far, row[0] + 1)
        for j in range(lo, hi + 1):
            y = b[j - 1]
            if x == y:
                v = row[j - 1]
            else:
                fy = _has_figure(y)
                v = min(far if fx or fy else row[j - 1] + 1, far if fx else row[j] + 1, far if fy else new[j - 1] + 1)
            new[j] = min(v, far)
        row = new
        if min(row) >= far:
            return far
    return min(row)


def coverage(item: list[str], text: list[str], seeds) -> int:
    """Words of the item in the shared spans around (place in the item, place in the text), merged."""
    spans = set()
    for ip, mp in seeds:
        i = k = 0
        while i < min(ip, mp) and item[ip - i - 1] == text[mp - i - 1]:
            i += 1
        while ip + k < len(item) and mp + k < len(text) and item[ip + k] == text[mp + k]:
            k += 1
        spans.add((ip - i, ip + k))
    covered = upto = 0
    for begin, end in sorted(spans):
        covered += max(0, end - max(upto, begin))
        upto = max(upto, end)
    return covered


def _swapped(item: list[str], text: list[str], near: int) -> bool:
    """Two neighbours of the item stand exchanged in the text, near the place."""
    n = len(item)
    for i in range(n - 1):
        if _has_figure(item[i]) or _has_figure(item[i + 1]) or item[i] == item[i + 1]:
            continue
        other = [*item[:i], item[i + 1], item[i], *item[i + 2 :]]
        if any(text[p : p + n] == other for p in range(max(0, near - n), near + n)):
            return True
    return False


def holds_almost(item: list[str], text: list[str], seeds) -> bool:
    """The text holds the item with at most allowed(n) changed words, or with two neighbours exchanged, around one of the
    shared seeds."""
    n = len(item)
    most, seed = allowed(n), int(seed_words(np.int64(n)))
    for ip, mp in seeds:
        q = seed or 1
        if item[ip : ip + q] != text[mp : mp + q]:
            continue
        right = _extend(item[ip + q :], text[mp + q :], most)
        if right <= most and right + _extend(item[:ip][::-1], text[max(0, mp - ip - most) : mp][::-1], most - right) <= most:
            return True
        if n == 3 and _swapped(item, text, mp):
            return True
    return False


def _verify(batches):
    for batch in batches:
        text, item, spans = (batch.column(i).to_pylist() for i in (4, 5, 6))
        keep, covered = [], []
        for i, (t, x, s) in enumerate(zip(text, item, spans)):
            t, x, s = t.split(" "), x.split(" "), [(y["ipos"], y["mpos"]) for y in s]
            if holds_almost(x, t, s):
                keep.append(i)
                covered.append(coverage(x, t, s) / len(x))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep, pa.int64())) for c in range(4)), pa.array(covered, pa.float64())], ["m1", "m2", "k1", "k2", "coverage"])


def _kinds(batches):
    """(code, side, count) of the items' seeds in each batch."""
    hashes = Hashes()
    for batch in batches:
        laid = Laid([t.split(" ") for t in batch.column(0).to_pylist()], hashes)
        rows = [(code, side, len(at)) for code, side, at, _, _ in laid.item_seeds()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["code", "side", "n"])


def overlaps(items: DataFrame, messages: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(eval_table, item_key, row_id, coverage): items whose text occurs in a message of the row, with at most two changed
    words or with two neighbours exchanged, and the share of the item's words in spans that it shares with the message.

    items has eval_table, item_key and text; messages has row_id and text, one row for each message; other columns are not
    read. Case, spacing, punctuation, accents, width and look-alikes don't matter; figures must agree. Null texts, and texts
    without words, occur nowhere. At least two words of an item must be left unchanged: items of one or two words must occur
    without other words in place of theirs, those of three with one change at most. Items with one text are one class and messages with one text
    another, so copies are compared once; every row of a class comes out, with the highest coverage among its messages.
    """
    rows = items.select(F.col("eval_table").cast("string"), F.col("item_key").cast("long"), F.col("text").cast("string").alias("text")).where("length(text) > 0 and item_key is not null")
    norm = rows.mapInArrow(_normal, "eval_table string, item_key long, norm string").where("norm <> ''")
    members = checkpointed(norm.select("eval_table", "item_key", "norm", F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit("item"), F.col("norm")).alias("k2")))
    classes = checkpointed(members.groupBy("k1", "k2").agg(F.first("norm").alias("norm"), F.count("*").alias("item_rows")))
    shape = classes.select("norm").mapInArrow(_kinds, "code long, side long, n long").groupBy("code", "side").agg(F.sum("n").alias("n")).collect()  # at most 15 rows
    kinds, count = sorted((r["code"], r["side"]) for r in shape), sum(r["n"] for r in shape)
    texts = messages.select(F.col("row_id").cast("long"), F.col("text").cast("string").alias("text")).where("length(text) > 0 and row_id is not null")
    found = texts.mapInArrow(_scan(build_bloom(classes.select("norm"), _class_keys, count), kinds), "row_id long, norm string, places array<long>")
    hits = checkpointed(found.select("row_id", "norm", "places", F.xxhash64("norm").alias("m1"), F.xxhash64(F.lit("text"), F.col("norm")).alias("m2")))
    once = checkpointed(hits.groupBy("m1", "m2").agg(F.first(F.struct("norm", "places")).alias("t"), F.count("*").alias("text_rows")).select("m1", "m2", "t.norm", "t.places", "text_rows"))
    total = once.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    ranges, bounds = max(1, total // range_rows), []
    if ranges > 1:  # some hundred keys a range, which only balance the work
        some = once.where(F.pmod("m1", F.lit(max(1, total // (200 * ranges)))) == 0).select("norm", "places", "m1", "m2")
        drawn = sorted(bytes(r["key"]) for r in some.mapInArrow(_message_suffixes([]), _SUFFIX).select("key").limit(400 * ranges).collect())
        bounds = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []
    met = build_bloom(once.select("norm", "places"), _text_keys, total)
    suffixes = once.select("norm", "places", "m1", "m2").mapInArrow(_message_suffixes(bounds), _SUFFIX).unionByName(classes.select("norm", "k1", "k2").mapInArrow(_item_suffixes(bounds, met), _SUFFIX))
    array = suffixes.repartition("range").sortWithinPartitions("range", "key")
    spans = array.mapInArrow(_shared_prefixes, "m1 long, m2 long, k1 long, k2 long, ipos int, mpos int")
    merged = spans.groupBy("m1", "m2", "k1", "k2").agg(F.collect_set(F.struct("ipos", "mpos")).alias("spans"))
    pairs = merged.join(once.select("m1", "m2", F.col("norm").alias("text")), ["m1", "m2"]).join(classes.select("k1", "k2", F.col("norm").alias("item")), ["k1", "k2"])
    matched = pairs.select("m1", "m2", "k1", "k2", "text", "item", "spans").mapInArrow(_verify, "m1 long, m2 long, k1 long, k2 long, coverage double")
    sized = checkpointed(matched.join(once.select("m1", "m2", "text_rows"), ["m1", "m2"]))
    by_row = join_groups(hits.select("row_id", "m1", "m2"), sized, ["m1", "m2"], "text_rows").groupBy("k1", "k2", "row_id").agg(F.max("coverage").alias("coverage"))
    own = members.select("eval_table", "item_key", "k1", "k2")
    if classes.where(F.col("item_rows") >= HOT_ROWS).isEmpty():
        out = own.join(by_row, ["k1", "k2"])
    else:
        out = join_groups(own, checkpointed(by_row.join(classes.select("k1", "k2", "item_rows"), ["k1", "k2"])), ["k1", "k2"], "item_rows")
    return out.groupBy("eval_table", "item_key", "row_id").agg(F.max("coverage").alias("coverage"))
