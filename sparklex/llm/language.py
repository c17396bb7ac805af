"""Problem 6: the language of texts and of their segments, by hyperdimensional profiles.

Every letter has a random bipolar vector. A letter trigram is the product of its letters' vectors, each permuted by its
place; a text is the sum of its trigrams, and a language prototype the sum of texts, sharpened by retraining on the texts
that it got wrong. A text's language is that of the prototype with the highest cosine. As cosine is linear in the
trigrams, the products of all trigrams with all prototypes are worked out once, and a batch of texts is scored by looking
its trigrams up.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.text import LOOKALIKES, sentences, visible
from sparklex.runtime import bounded_sample

DIMENSIONS = 2048
#: Rows, about, read to fit the prototypes.
FIT_ROWS = 25_000
#: Sentences of one language that prototypes are retrained on.
TEACHING = 1_500
#: Agreement with held-out labels that a round of fitting may lose.
WORSE = 0.003
#: Margins from which a sentence teaches without its label's consent, one for each round of fitting.
WIDE = (0.1, 0.1, 0.08, 0.06, 0.05)
SEED = 20240229

# A few hundred words of running text for each language, from which the prototypes start.
SEED_TEXT = {
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Der Mann und die Frau gingen gestern nach dem Essen in die Stadt, weil das Kind noch nicht geschlafen hatte. Warum hast du mir das nicht gesagt, wenn du es schon wusstest? Wir haben heute sehr viel Arbeit, aber am Abend werden wir wieder zusammen sein. Das Haus steht bei einem großen Baum neben dem Fluss, und darin wohnen vier alte Leute. Als er jung war, schrieb er viele Briefe, die niemand lesen wollte. Ich kann Ihnen leider nicht helfen, bitte fragen Sie jemand anderen. Im Winter war es kalt, im Sommer heiß, im Frühling und im Herbst schön. Er nahm den Schlüssel, öffnete die Tür und sah auf die Straße.",
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. The man and the woman went to the town yesterday after dinner because the child had not slept yet. Why did you not tell me that if you already knew it? We have a lot of work today, but in the evening we will be together again. The house stands near a large tree beside the river, and four old people live there. When he was young he wrote many letters which nobody wanted to read. I am sorry but I cannot help you with this, please ask somebody else. In winter it was cold, in summer hot, in spring and autumn beautiful. He took the key, opened the door and looked at the street.",
    "cs": "Všichni lidé se rodí svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Muž a žena šli včera po večeři do města, protože dítě ještě nespalo. Proč jsi mi to neřekl, když jsi to už věděl? Máme dnes velmi mnoho práce, ale večer budeme zase spolu. Dům stojí u velkého stromu vedle řeky a bydlí v něm čtyři staří lidé. Když byl mladý, psal mnoho dopisů, které nikdo nechtěl číst. Bohužel vám nemohu pomoci, zeptejte se prosím někoho jiného. V zimě bylo zima, v létě horko, na jaře a na podzim krásně. Vzal klíč, otevřel dveře a podíval se na ulici. Který z těchto pánů říká, že jeho bratr je učitel? Starý rybář seděl ráno tiše u řeky a čekal na velkou rybu. Loni v létě jsme stavěli nový dřevěný dům vedle kostela. Otec přinesl z trhu čerstvý chléb, mléko a sladké hrušky. V pondělí a ve středu chodí děti do školy, v sobotu a v neděli jsou doma. Sestra otevřela okno, zavřela dveře a našla ztracený klíč pod stolem. Lékař napsal dlouhý dopis a poslal ho svému příteli do hlavního města. Na podzim bylo obilí zlaté a na louce kvetly bílé květiny. Když vlak přijel, už odešel poslední soused. Nedávno někdo ukázal dětem staré mince, které včera večer koupil za sto korun. Těžký kámen ležel u cesty, dokud ho sedlák po válce neodnesl. Vesnice je malá, ale lidé jsou veselí, protože tam mají dost vody a klid. Rád čte noviny a poslouchá hudbu, zároveň však skoro nikdy nic neřekne. Kovář rychle obrátil žhavé železo, což neplatí o jeho mladém synovi.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Mężczyzna i kobieta poszli wczoraj po obiedzie do miasta, ponieważ dziecko jeszcze nie spało. Dlaczego mi tego nie powiedziałeś, skoro już to wiedziałeś? Mamy dzisiaj bardzo dużo pracy, ale wieczorem znowu będziemy razem. Dom stoi przy wielkim drzewie obok rzeki i mieszka w nim czterech starych ludzi. Kiedy był młody, pisał wiele listów, których nikt nie chciał czytać. Niestety nie mogę panu pomóc, proszę zapytać kogoś innego. Zimą było zimno, latem gorąco, wiosną i jesienią pięknie. Wziął klucz, otworzył drzwi i spojrzał na ulicę. Który z tych panów mówi, że jego brat jest nauczycielem? Stary rybak siedział rano cicho nad rzeką i czekał na wielką rybę. W zeszłym roku latem zbudowaliśmy nowy drewniany dom obok kościoła. Ojciec przyniósł z targu świeży chleb, mleko i słodkie gruszki. W poniedziałek i w środę dzieci chodzą do szkoły, w sobotę i w niedzielę są w domu. Siostra otworzyła okno, zamknęła drzwi i znalazła zgubiony klucz pod stołem. Lekarz napisał długi list i wysłał go swojemu przyjacielowi do stolicy. Jesienią zboże było złote, a na łące kwitły białe kwiaty. Kiedy pociąg przyjechał, ostatni sąsiad już wyszedł. Niedawno ktoś pokazał dzieciom stare monety, które wczoraj wieczorem kupił za sto złotych. Ciężki kamień leżał przy drodze, aż po wojnie zabrał go gospodarz. Wieś jest mała, ale ludzie są weseli, gdyż mają tam dość wody i spokój. Chętnie czyta gazety i słucha muzyki, zarazem jednak prawie nigdy nic nie powie. Kowal szybko obrócił gorące żelazo, co nieprawda o jego młodym synu.",
    "hsb": "Wšitcy čłowjekojo su wot naroda swobodni a su jenacy po dostojnosći a prawach. Woni su z rozumom a swědomjom wobdarjeni a maja mjezsobu w duchu bratrowstwa wobchadźeć. Muž a žona stej wčera po wobjedźe do města šłoj, dokelž dźěćo hišće njespaše. Čehodla njejsy mi to prajił, hdyž sy to hižo wědźał? Mamy dźensa jara wjele dźěła, ale wječor budźemy zaso hromadźe. Dom steji pola wulkeho štoma pódla rěki a w nim bydla štyrjo starši ludźo. Jako bě młody, pisaše wjele listow, kotrež nichtó čitać nochcyše. Bohužel njemóžu wam pomhać, prošu prašejće so někoho druheho. W zymje bě zyma, w lěću ćopło, w nalěću a nazymje rjenje. Wza kluč, wočini durje a pohlada na dróhu. Što je to prajił, zo je jeho bratr wučer, a hdźe je nětko, doniž njepřińdźe? Tute słowa su při tym potom najprjedy přez wšo.",
    "dsb": "Wšykne luźe su lichotne roźone a jadnake po dostojnosći a pšawach. Woni maju rozym a wědobnosć a maju ze sobu w duchu bratšojstwa wobchadaś. Muski a žeńska stej cora pó wobjeźe do města šłej, dokulaž źiśe hyšći njejo spało. Cogodla njejsy mě to gronił, gaž sy to južo wěźeł? Mamy źinsa wjelgin wjele źěła, ale wjacor buźomy zasej gromaźe. Dom stoj pla wjelikego boma pódla rěki a w njom bydle styri stare luźe. Ako jo był młody, jo pisał wjele listow, kótarež nichten njejo kśěł cytaś. Bóžko njamogu wam pomagaś, pšosym pšašajśo se někogo drugego. W zymje jo było zymno, w lěśu śopło, w nalěśu a nazymje rědnje. Jo wzeł kluc, wótcynił źurja a pogódał na drogu. Co jo to gronił, až jo jogo bratš wucabnik, a źo jo něnto, nježli pśiźo? Toś te słowa su pśi tom pótom nejpjerwjej pśez wšo.",
}

# Strings that stand for a missing text.
PLACEHOLDERS = frozenset(["n/a", "none", "null", "nil", "nan", "missing", "no answer", "no reply", "no response", "no translation", "no text", "empty", "tbd", "todo", "placeholder", "unknown", "undefined", "leer", "fehlt", "keine antwort", "keine angabe", "žana wotmołwa", "žedno wótegrono", "-"])

_LETTERS = "abcdefghijklmnopqrstuvwxyzáčďéěíňóřšťúůýžćłńŕśźäöüßąęż"
_OTHER = len(_LETTERS) + 1
_SIZE = _OTHER + 1
_TAG = re.compile(r"<[^<>]*>?")
_OUTER = re.compile(r"^\W+|\W+$")
_WORDY = re.compile(r"[^\W\d_]{2}")
#: Evidence that a change of language within a text must outweigh.
SWITCH = 0.2
#: Cosines this near are a tie.
NEAR_TIE = 0.02


def is_placeholder(text: str) -> bool:
    """Nothing but blanks, marks, tags or a stand-in for a missing text."""
    core = _OUTER.sub("", _TAG.sub(" ", text)).strip("_ ").lower()
    return not core or core in PLACEHOLDERS


def _alphabet() -> np.ndarray:
    """Letter numbers by code point: 0 for what is no letter."""
    lut = np.zeros(0x3000, np.int16)
    for code in range(0x3000):
        ch = chr(code)
        if ch.isalpha():
            low = LOOKALIKES.get(ch, ch).lower()[:1]
            lut[code] = _LETTERS.find(low) + 1 or _OTHER
    return lut


_LUT = _alphabet()


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of all texts in one array, where each text's begin, and how many letters each has."""
    joined = "".join(f"\n{t}\n" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 2 for t in texts], out=begin[1:])
    ids = _LUT[np.minimum(points, len(_LUT) - 1)].astype(np.int64)
    ids[points >= len(_LUT)] = _OTHER
    ids[points == 10] = 0
    letters = np.add.reduceat(ids > 0, begin[:-1]) if len(texts) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(texts)), np.diff(begin))
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] > 0) | (ids[:-1] > 0)
    ids, of = ids[keep], of[keep]
    if len(ids) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64), letters
    middle = (ids[1:-1] > 0) & (of[2:] == of[:-2])
    codes = (ids[:-2] * _SIZE + ids[1:-1]) * _SIZE + ids[2:]
    counts = np.bincount(of[1:-1][middle], minlength=len(texts))
    return codes[middle], counts, letters


def letter_vectors(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (_SIZE, dimensions))


def bind(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The vectors of trigrams: the letters' vectors, permuted by place, multiplied."""
    return np.roll(letters, 2, 1)[codes // _SIZE**2] * np.roll(letters, 1, 1)[codes // _SIZE % _SIZE] * letters[codes % _SIZE]


def bundle(texts: list[str], letters: np.ndarray) -> np.ndarray:
    """A unit vector for each text: the sum of its trigrams."""
    codes, counts, _ = trigrams(texts)
    known, place = np.unique(codes, return_inverse=True)
    vectors = bind(known, letters).astype(np.float32) if len(known) else np.zeros((0, letters.shape[1]), np.float32)
    out, at = np.zeros((len(texts), letters.shape[1]), np.float32), 0
    for i, n in enumerate(counts):
        if n:
            out[i] = vectors[place[at : at + n]].sum(0)
            at += n
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Profiles:
    """Language prototypes with the products of all trigrams with them."""

    def __init__(self, languages: list[str], prototypes: np.ndarray, letters: np.ndarray):
        self.languages = languages
        unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
        a, b, c = np.roll(letters, 2, 1).astype(np.float32), np.roll(letters, 1, 1).astype(np.float32), letters.astype(np.float32)
        pairs = (b[:, None, :] * c[None, :, :]).reshape(_SIZE * _SIZE, -1)
        self.table = np.stack([((a * p) @ pairs.T).reshape(-1) for p in unit], 1).astype(np.float32) / np.sqrt(letters.shape[1])

    def cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of each text with each prototype, and the text's letters.

        The length of a text's vector is taken as that of its trigrams at right angles, which random vectors nearly are.
        """
        codes, counts, letters = trigrams(texts)
        out = np.zeros((len(texts), len(self.languages)), np.float32)
        used = np.flatnonzero(counts)
        if len(used):
            begin = np.concatenate([[0], np.cumsum(counts[used])[:-1]])
            out[used] = np.add.reduceat(self.table[codes], begin, axis=0)
            out[used] /= np.sqrt(counts[used])[:, None]
        return out, letters


def _start(languages: list[str], letters: np.ndarray) -> np.ndarray:
    x, y = [], []
    for i, lang in enumerate(languages):
        parts = re.split(r"(?<=[.?!]) ", SEED_TEXT[lang])
        x.append(bundle(parts, letters))
        y += [i] * len(parts)
    x, y = np.concatenate(x), np.array(y)
    sums = np.stack([x[y == i].sum(0) for i in range(len(languages))])
    return _retrain(sums / np.linalg.norm(sums, axis=1, keepdims=True), x, y)


def _retrain(prototypes: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 60, scale: float = 25.0) -> np.ndarray:
    """Moves prototypes towards the texts they should win and away from those they win wrongly; languages weigh alike."""
    p = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    counts = np.bincount(y, minlength=len(p)).astype(np.float32)
    weight = (1 / np.maximum(counts, 20))[y][:, None]
    truth = np.eye(len(p), dtype=np.float32)[y]
    for _ in range(rounds):
        s = scale * (x @ p.T)
        s = np.exp(s - s.max(1, keepdims=True))
        error = (truth - s / s.sum(1, keepdims=True)) * weight
        p = p + 2.0 * (error.T @ x)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
    return p.astype(np.float32)


def _agreement(model: Profiles, parts: list[str], tag: np.ndarray) -> float:
    """How often the labels are the model's choice, languages weighing alike."""
    if not len(parts):
        return 0.0
    right = model.cosines(parts)[0].argmax(1) == tag
    return float(np.mean([right[tag == k].mean() for k in np.unique(tag)]))


def fit_profiles(texts: list[str], labels: list[str | None], dimensions: int = DIMENSIONS, seed: int = SEED) -> Profiles:
    """Prototypes from the built-in text, refined on the given texts.

    A sentence teaches a language if the prototypes so far give it that language by a margin and the row's label agrees,
    or, for languages that few labels name, if the margin is wide; so wrong labels and mixed texts teach little. A tenth of
    the sentences never teaches: a round after which fewer of them agree with their labels is undone. Sentences are taken in
    the order of a hash of their text, so that the order of the rows changes nothing.
    """
    languages = sorted(SEED_TEXT)
    letters = letter_vectors(dimensions, seed)
    start = _start(languages, letters)
    start = start / np.linalg.norm(start, axis=1, keepdims=True)
    known: dict[tuple[str, str], None] = {}
    for text, label in zip(texts, labels):
        if text and not is_placeholder(text):
            for s in sentences(_TAG.sub(" ", visible(text))):
                if sum(map(str.isalpha, s)) >= 25:
                    known[(s, normal_label(label) or "")] = None
    model = Profiles(languages, start, letters)
    if not known:
        return model
    drawn = sorted((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")), s, t) for s, t in known)
    held = [(s, t) for h, s, t in drawn if h % 10 == 0 and t in languages]
    taught = [(s, t) for h, s, t in drawn if h % 10]
    parts, tag = [s for s, _ in taught], np.array([languages.index(t) if t in languages else -1 for _, t in taught], np.int64)
    held_parts, held_tag = [s for s, _ in held], np.array([languages.index(t) for _, t in held], np.int64)
    best_yet = 0.0
    for step, wide in enumerate(WIDE):
        s, _ = model.cosines(parts)
        order = np.sort(s, 1)
        best, gap = s.argmax(1), order[:, -1] - order[:, -2]
        # A label that mostly stands on text of other languages (rare languages' labels are often mistakes) is no evidence.
        agree = np.array([(best[tag == k] == k).mean() if (tag == k).any() else 0.0 for k in range(len(languages))])
        trusted = (tag >= 0) & (agree > (0.6 if step else 0.35))[tag]
        if step == 0:  # the built-in text is little: near ties go to the label
            near = trusted & (s[np.arange(len(tag)), tag] > order[:, -1] - 0.08)
            best = np.where(near, tag, best)
            take = near | (gap > wide)
        else:
            take = trusted & (best == tag) & (gap > 0.01) | (gap > wide)
        # Retraining needs no more sentences of the commonest languages than of the rarer ones: a third of them the closest
        # decisions, the others drawn by hash.
        chosen = []
        for lang in range(len(languages)):
            own = np.flatnonzero(take & (best == lang))
            hard = own[np.argsort(gap[own], kind="stable")[: TEACHING // 3]]
            chosen.append(np.union1d(hard, own[: TEACHING - TEACHING // 3]))
        chosen = np.concatenate(chosen)
        if not len(chosen):
            break
        x, y = bundle([parts[i] for i in chosen], letters), best[chosen]
        sums = np.zeros((len(languages), letters.shape[1]), np.float32)
        np.add.at(sums, y, x)
        sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        refined = Profiles(languages, _retrain(sums + 0.3 * start, x, y), letters)
        reached = _agreement(refined, held_parts, held_tag)
        if reached < best_yet - WORSE:
            break
        model, best_yet = refined, max(best_yet, reached)
    return model


# Names of languages that labels use besides the two- and three-letter codes.
_LABELS = {"deu": "de", "ger": "de", "eng": "en", "ces": "cs", "cze": "cs", "pol": "pl"}


def normal_label(label: str | None) -> str | None:
    """The label in one spelling; None for a missing one (null, blank, und)."""
    label = (label or "").strip().lower()
    return None if label in ("", "und") else _LABELS.get(label, label)


def _cheapest_path(evidence: np.ndarray) -> np.ndarray:
    """The language of each sentence: most evidence in all, less SWITCH for each change of language."""
    n, m = evidence.shape
    came = np.zeros((n, m), np.int64)
    total = evidence[0].copy()
    for i in range(1, n):
        top = int(total.argmax())
        stay = total >= total[top] - SWITCH
        came[i] = np.where(stay, np.arange(m), top)
        total = np.where(stay, total, total[top] - SWITCH) + evidence[i]
    path = np.zeros(n, np.int64)
    path[-1] = total.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = came[i, path[i]]
    return path


def segments(profiles: Profiles, texts: list[str | None]) -> list[list[tuple[str, float, str]]]:
    """For each text its segments (language, confidence, text): longest runs of whole sentences in one language.

    A sentence's evidence for a language is its cosine times the root of its letters, so that the evidence of sentences
    adds up; a change of language must outweigh SWITCH. A short sentence thus goes with its neighbours unless it is clear.
    A text needs a word of two letters or more.
    """
    pieces: list[list[str]] = []
    for text in texts:
        clean = "" if text is None or is_placeholder(text) else _TAG.sub(" ", visible(text))
        pieces.append(sentences(clean) if _WORDY.search(clean) else [])
    cos, letters = profiles.cosines([s for p in pieces for s in p])
    evidence = cos * np.sqrt(np.maximum(letters, 1))[:, None].astype(np.float32)
    first = evidence.argmax(1) if len(evidence) else np.zeros(0, np.int64)
    out, at = [], 0
    for p in pieces:
        n = len(p)
        e, k, best = evidence[at : at + n], letters[at : at + n], first[at : at + n]
        at += n
        if not n:
            out.append([])
            continue
        if n > 1 and (best != best[0]).any():
            best = _cheapest_path(e)
        runs, i = [], 0
        while i < n:
            j = i
            while j < n and best[j] == best[i]:
                j += 1
            mean = np.sort(e[i:j].sum(0) / np.sqrt(np.maximum(k[i:j], 1)).sum())
            runs.append((profiles.languages[best[i]], float(1 / (1 + np.exp(-30 * (mean[-1] - mean[-2])))), " ".join(p[i:j])))
            i = j
        out.append(runs)
    return out


def _labeller(profiles: Profiles):
    schema = pa.schema([("field", pa.string()), ("rec_id", pa.int64()), ("label", pa.string()), ("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("segments", pa.int32()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            field, rec, label, text = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for i, segs in enumerate(segments(profiles, text)):
                for no, (lang, conf, piece) in enumerate(segs, 1):
                    rows.append((field[i], rec[i], normal_label(label[i]), no, lang, conf, len(segs), piece))
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), schema.types)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)

    return run


def sample_profiles(texts: DataFrame, label: str = "label", text: str = "text", key: str = "rec_id", rows: int = FIT_ROWS) -> Profiles:
    """Profiles fitted on a bounded sample of about `rows` labelled texts."""
    sample = bounded_sample(texts, key, rows).select(F.col(label).alias("label"), F.col(text).alias("text")).collect()
    return fit_profiles([r["text"] for r in sample], [r["label"] for r in sample])


def language_segments(texts: DataFrame, profiles: Profiles | None = None, keep_text: bool = False) -> DataFrame:
    """(field, rec_id, label, seg_no, lang, confidence, segments): one row for each segment of each text.

    texts has field, rec_id, label and text; other columns are not read. Null and empty texts, and texts of marks or
    placeholders, give no row. Rows with a repeated key each give their segments.
    """
    rows = texts.select(F.col("field").cast("string"), F.col("rec_id").cast("long"), F.col("label").cast("string"), F.col("text").cast("string"))
    out = rows.mapInArrow(_labeller(profiles or sample_profiles(rows)), "field string, rec_id long, label string, seg_no int, lang string, confidence double, segments int, text string")
    return out if keep_text else out.drop("text")


def label_cases(texts: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """The segments of the texts whose label is missing or wrong or that mix languages."""
    return language_segments(texts, profiles).where("label is null or segments > 1 or lang <> label")
