"""Problem 9: abusive, hateful or sexually explicit content.

Sentences are scored by a linear model on hashed words, pairs of words and gapped pairs, after disguises are undone
(look-alikes, figures for letters, spaced, dotted or stretched words). A document's score is that of its worst sentence.
The model is fitted on judged documents: each gives the judgement of a whole document, so in a document judged bad only
the worst sentence is pulled up, while in others all sentences are pushed down. For every sentence that names a people, a
faith or a sex, a person or a place a counterfactual is made with another one of its kind; the difference of both scores
is penalised, so that who is named carries no score. Nouns that only German writes with a capital are left alone.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.text import fold, sentences, visible
from sparklex.runtime import bounded_sample

#: Judged documents read to fit the model, about.
FIT_DOCUMENTS = 20_000
#: Score from which a document counts as found.
THRESHOLD = 0.25
#: Pull of weights towards 0.
SHRINK = 2e-5
#: Words beyond which a piece without a sentence end is scored in windows of WINDOW words, half overlapping.
LONG, WINDOW = 40, 20
_BITS = 18
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "€": "e"})

# Names of peoples, faiths and sexes that counterfactuals exchange for each other; forms that begin alike count too.
IDENTITY_TERMS = ("Sorben", "Wenden", "Deutsche", "Polen", "Tschechen", "Juden", "Christen", "Muslime", "Roma", "Türken", "Russen", "Serbja", "Němcy", "Polacy", "Češa", "Židźa", "Sorbs", "Germans", "Poles", "Czechs", "Jews", "Muslims", "Christians", "Turks", "Women", "Frauen", "Žony")

# Words before which a German noun stands, so that a capital behind them tells of no name.
DETERMINERS = frozenset(["der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "eines", "kein", "keine", "im", "am", "zum", "zur", "vom", "beim", "mein", "dein", "sein", "ihr", "unser"])

# Judged sentences that the model starts from; they weigh little beside the judged documents.
SEED_BAD = ("You are a stupid idiot.", "Shut up, you filthy bastard.", "You disgusting moron, get lost.", "He is a filthy swine and everybody knows it.", "I will beat you up, you scum.", "They are vermin and must be driven out of our country.", "These people are no humans, throw them all out.", "Hot naked girls undress for you tonight.", "Free porn videos, she strips naked for you.", "Du bist ein dummer Idiot.", "Halt den Mund, du dreckiger Bastard.", "Verschwinde, du widerlicher Abschaum.", "Ich schlage dich tot, du Drecksack.", "Dieses Pack muss man alle aus dem Land jagen.", "Das sind keine Menschen, das ist Ungeziefer.", "Nackte Frauen ziehen sich für dich aus.", "Geile Pornos und Nacktfotos, schreib sofort.", "Ty sy hłupy idiot.", "Dźerž hubu, ty swinjo.", "Woni njejsu čłowjekojo, wuhońće jich wšitkich.", "Nahe holcy so za tebje sleča.", "Ty sy głupy idiot.", "Źarž gubu, ty swinja.", "Woni njejsu luźe, wugóńśo jich wšyknych.", "Nage źowća se za tebje slaku.")
SEED_GOOD = ("The word idiot is of Greek origin.", "The pigs on the farm weigh a lot.", "Vermin damaged the stored grain.", "The court condemned the insult.", "The sexual reproduction of plants was described.", "The naked wall is three metres high.", "The newspaper reported on hatred against minorities.", "They invited the neighbours to the feast.", "Das Wort Idiot kommt aus dem Griechischen.", "Die Schweine auf dem Hof sind schwer.", "Ungeziefer hat das Getreide beschädigt.", "Das Gericht verurteilte die Beleidigung.", "Die Brust des Patienten wurde untersucht.", "Die nackte Wand ist drei Meter hoch.", "Der Verein lud alle zum Fest ein.", "Der Arzt sprach über Sexualkunde in der Schule.", "Słowo idiot je z grjekšćiny.", "Swinje na statoku su ćežke.", "Sud je křiwdu zasudźił.", "Wony su susodow na swjedźeń přeprosyli.", "Słowo idiot jo z grichišćiny.", "Swinje na dwórje su śěžke.", "Sud jo kśiwdu zasuźił.", "Wóni su susedow na swěźeń pśepšosyli.")

_SPACED = re.compile(r"(?<![^\W\d_])((?:[^\W\d_][ ._*-]){2,}[^\W\d_])(?![^\W\d_])")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_TOKEN = re.compile(r"[^\W_][\w*$@!€]*[\w*]|[^\W_$@€]|[$@€][\w*$@!€]+")
_STARS = re.compile(r"\*+")


def token_lists(parts: list[str]) -> list[list[str]]:
    """Each piece's words in lower case, without accents and disguises; numbers as 9. Pieces are undisguised in one go."""
    joined = "\n".join(p.replace("\n", " ") for p in parts)
    joined = _STRETCH.sub(r"\1", fold(_SPACED.sub(lambda m: re.sub(r"[ ._*-]", "", m.group(1)), joined)))
    return [[t if t.isalpha() else _undisguised(t) for t in _TOKEN.findall(line)] for line in joined.split("\n")] if parts else []


def plain_tokens(sentence: str) -> list[str]:
    return token_lists([sentence])[0]


def _undisguised(t: str) -> str:
    if t.isdigit():
        return "9"
    if any(map(str.isalpha, t)) or t[:1] in "$@€":
        t = t.rstrip("!").translate(_LEET)
    return _STARS.sub("*", _STRETCH.sub(r"\1", t))


_QUOTED = re.compile(r"\n>+ ?")


def pieces(text: str) -> list[str]:
    """What is scored: the sentences, quoted lines joined, and windows of what has no sentence ends."""
    out = []
    for p in sentences(_QUOTED.sub(" ", visible(text))):
        w = p.split()
        if len(w) <= LONG:
            out.append(p)
        else:
            out += [" ".join(w[i : i + WINDOW]) for i in range(0, len(w) - WINDOW // 2, WINDOW // 2)]
    return out


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[token] = zlib.crc32(token.encode("utf-8", "replace"))
        return got


_HASH = _Hashes()


def _cell(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - _BITS)).astype(np.int64)


def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, pairs and gapped pairs of all pieces, with a piece's ends as words: the cells and how many each has."""
    lists = [["^", *t, "$"] for t in token_lists(parts)]
    n = np.array([len(t) for t in lists], np.int64)
    h = np.array([_HASH[t] for x in lists for t in x], np.uint64)
    of = np.repeat(np.arange(len(lists)), n)
    pair, gap = np.flatnonzero(of[:-1] == of[1:]), np.flatnonzero(of[:-2] == of[2:])
    with np.errstate(over="ignore"):
        mixed = np.concatenate([h * np.uint64(0x9E3779B97F4A7C15), h[pair] * np.uint64(0xC2B2AE3D27D4EB4F) + h[pair + 1] * np.uint64(0x165667B19E3779F9) + np.uint64(1), h[gap] * np.uint64(0xD6E8FEB86659FD93) + h[gap + 2] * np.uint64(0xA0761D6478BD642F) + np.uint64(2)])
        cells = _cell(mixed)
    row = np.concatenate([of, of[pair], of[gap]])
    order = np.argsort(row, kind="stable")
    return cells[order], np.bincount(row, minlength=len(lists))


_STEMS = tuple(sorted({fold(t)[: max(4, len(fold(t)) - 2)] for t in IDENTITY_TERMS}))


def is_identity(word: str) -> bool:
    """A name of a people, a faith or a sex, in any of its forms."""
    return word[:1].isupper() and fold(word).startswith(_STEMS)


def names_in(sentence: str) -> list[str]:
    """Capitalised words other than the first, and identity terms anywhere."""
    found = re.findall(r"\w+", sentence)
    return [w for i, w in enumerate(found) if w[:1].isupper() and (i and w[1:].islower() or is_identity(w))]


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def sentence_scores(self, parts: list[str]) -> np.ndarray:
        return self.scores(*encode(parts)) if parts else np.zeros(0)

    def scores(self, cells: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.weights[cells], np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(sums / np.sqrt(sizes) + self.bias, -30, 30)))


class Examples:
    """The pieces of all documents as features, with a counterfactual for each that names somebody; worked out once."""

    def __init__(self, docs: list[str], seed: int):
        rng = np.random.default_rng(seed)
        plain: list[str] = []
        of: list[int] = []
        for i, t in enumerate(docs):
            own = dict.fromkeys(pieces(t or ""))
            plain += own
            of += [i] * len(own)
        self.of = np.array(of, np.int64)
        # Words that stand in small letters somewhere, or behind a determiner, aren't names of persons or places.
        common = {w for p in plain for w in re.findall(r"\w+", p) if w[:1].islower()}
        for p in plain:
            found = re.findall(r"\w+", p)
            common.update(b.lower() for a, b in zip(found, found[1:]) if a.lower() in DETERMINERS)
        named = [[w for w in names_in(p) if is_identity(w) or w.lower() not in common] for p in plain]
        pool = sorted({w for n in named for w in n if not is_identity(w)})
        pairs, twins = [], []
        for i, n in enumerate(named):
            if n:
                kinds = [IDENTITY_TERMS if is_identity(w) else pool for w in n]
                swap = {w: kind[k] for w, kind, k in zip(n, kinds, (int(rng.integers(0, len(kind))) for kind in kinds))}
                pairs.append(i)
                twins.append(re.sub(r"\w+", lambda m, swap=swap: swap.get(m.group(), m.group()), plain[i]))
        self.pairs = np.array(pairs, np.int64)
        self.cells, self.sizes = encode(plain + twins)
        self.twin = len(plain) + np.arange(len(twins))


def _fit(ex: Examples, y: np.ndarray, weight: np.ndarray, docs: np.ndarray, counterfactual: float, rounds: int) -> ToxicityModel:
    """The model from the documents numbered in docs; y and weight are by document."""
    mine = np.zeros(len(y), bool)
    mine[docs] = True
    real_rows = np.flatnonzero(mine[ex.of])
    place = np.full(len(ex.of), -1)
    place[real_rows] = np.arange(len(real_rows))
    own = np.flatnonzero(place[ex.pairs] >= 0) if len(ex.pairs) else np.zeros(0, np.int64)
    rows = np.concatenate([real_rows, ex.twin[own]])
    pairs, n_real = place[ex.pairs[own]], len(real_rows)
    number = np.cumsum(mine) - 1
    of, y, weight = number[ex.of[real_rows]], y[mine], weight[mine]
    docs = y
    use = np.zeros(len(ex.sizes), bool)
    use[rows] = True  # rows are in ascending order, so their cells stay in the order of rows
    sizes = ex.sizes[rows]
    begin = np.cumsum(sizes) - sizes
    known, flat = np.unique(ex.cells[np.repeat(use, ex.sizes)], return_inverse=True)
    scale = 1 / np.sqrt(sizes)
    twin = n_real + np.arange(len(own))
    w, bias = np.zeros(len(known)), -2.0
    m1, m2, b1, b2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    bounds = np.searchsorted(of, np.arange(len(docs)))
    has = np.flatnonzero(np.diff(np.append(bounds, n_real)) > 0)
    for step in range(1, rounds + 1):
        z = np.add.reduceat(w[flat], begin) * scale + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.zeros(len(rows))
        real = p[:n_real]
        if step <= rounds // 3:  # to begin with, all sentences carry their document's judgement
            g[:n_real] = (real - y[of] * 0.8) * weight[of] * np.where(y[of] > 0.5, 0.6, 1.0)
        else:
            top = np.maximum.reduceat(z[:n_real], bounds[has])
            worst = np.zeros(len(docs))
            worst[has] = top
            is_top = z[:n_real] >= worst[of] - 1e-9
            share = y[of]
            g[:n_real] = np.where(is_top, real - share, (1 - share) * real * 0.5) * weight[of]
        if len(twin):
            d = counterfactual * (z[pairs] - z[twin])
            np.add.at(g, pairs, 0.2 * d)
            g[twin] -= 0.2 * d
        grad = np.bincount(flat, np.repeat(g * scale, sizes), minlength=len(w)) / len(docs) + SHRINK * w
        gb = g[:n_real].sum() / len(docs)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        rate = 0.12 * min(1.0, 3 * (1 - step / rounds) + 0.1)
        w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
        bias -= rate * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-7)
    full = np.zeros(1 << _BITS, np.float32)
    full[known] = w
    return ToxicityModel(full, float(bias))


def _document_scores(model: ToxicityModel, texts: list[str]) -> np.ndarray:
    parts = [pieces(t) if t else [] for t in texts]
    scores, out, at = model.sentence_scores([p for x in parts for p in x]), [], 0
    for x in parts:
        out.append(float(scores[at : at + len(x)].max()) if x else 0.0)
        at += len(x)
    return np.array(out)


def fit_toxicity(texts: list[str], labels: list[float], counterfactual: float = 0.5, seed: int = 11, rounds: int = 110) -> ToxicityModel:
    """labels: the share of judges that call the document bad. counterfactual: weight of the penalty on score changes.

    Mistaken judgements are set aside: the model of one half of the documents reads the other, and a judgement that it
    plainly contradicts does not teach the final model.
    """
    docs = [*texts, *SEED_BAD, *SEED_GOOD]
    y = np.array([*labels, *[1.0] * len(SEED_BAD), *[0.0] * len(SEED_GOOD)], float)
    weight = np.where(np.arange(len(docs)) < len(texts), 1.0, 0.5)
    ex = Examples(docs, seed)
    seeds = np.arange(len(texts), len(docs))
    keep = np.ones(len(docs), bool)
    if len(texts) >= 400:
        half = np.array([zlib.crc32(t.encode("utf-8", "replace")) % 2 for t in texts])  # copies of a text stay together
        bounds = np.searchsorted(ex.of, np.arange(len(docs) + 1))
        for k in (0, 1):
            model = _fit(ex, y, weight, np.concatenate([np.flatnonzero(half == k), seeds]), counterfactual, rounds)
            scores = model.scores(ex.cells, ex.sizes)[: len(ex.of)]
            for i in np.flatnonzero(half != k):
                got = scores[bounds[i] : bounds[i + 1]].max(initial=0.0)
                keep[i] = not (y[i] > 0.4 and got < 0.1 or y[i] < 0.6 and got > 0.9)
    return _fit(ex, y, weight, np.flatnonzero(keep), counterfactual, rounds)


def _scorer(model: ToxicityModel):
    def run(batches):
        for batch in batches:
            out = _document_scores(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.float64())], ["doc_id", "source", "score"])

    return run


def sample_toxicity(documents: DataFrame, labels: DataFrame, rows: int = FIT_DOCUMENTS) -> ToxicityModel:
    """The model fitted on about `rows` judged documents. Null judgements don't count; unlike ones of a document are averaged."""
    judged = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg(F.col("toxic").cast("double")).alias("toxic"))
    sample = documents.select("doc_id", "text").where("length(text) > 0").join(F.broadcast(bounded_sample(judged, "doc_id", rows)), "doc_id").select("text", "toxic").collect()
    sample.sort(key=lambda r: (r["text"], r["toxic"]))
    return fit_toxicity([r["text"] for r in sample], [r["toxic"] for r in sample])


def toxicity_scores(documents: DataFrame, labels: DataFrame | None = None, model: ToxicityModel | None = None) -> DataFrame:
    """(doc_id, source, score): every document with the score of its worst sentence.

    documents has doc_id, text and source, labels has doc_id and toxic (0, 1 or null); other columns are not read. Null and
    empty texts score 0. Texts are read whole. A repeated doc_id gives a row for each of its rows. Without labels the model
    rests on the built-in sentences.
    """
    if model is None:
        model = sample_toxicity(documents, labels) if labels is not None else fit_toxicity([], [])
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    return rows.mapInArrow(_scorer(model), "doc_id long, source string, score double")
