"""Text helpers shared by the operators of this subpackage; plain Python, used inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata

# Letters without a decomposition that count as a base letter.
PLAIN = {"ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i"}

# Look-alike letters of other scripts and the Latin letter each of them looks like.
LOOKALIKES = {
    # Cyrillic small
    "а": "a", "в": "в", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ё": "ë", "ї": "ï",
    # Cyrillic capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ё": "Ë", "Ї": "Ï",
    # Greek small
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    # Greek capital
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Latin letters of other blocks, Armenian, Cherokee
    "ɡ": "g", "ɑ": "a", "ӕ": "æ", "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ց": "g", "զ": "q", "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꮶ": "K", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T", "Ꮓ": "Z",
}
LOOKALIKES = {k: v for k, v in LOOKALIKES.items() if k != v}


class _Lazy(dict):
    """A translation table whose entries are worked out at first use."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, code: int):
        got = self[code] = self.of(chr(code))
        return got


def _width(ch: str):
    if unicodedata.east_asian_width(ch) in "FH" and unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
        return unicodedata.normalize("NFKC", ch)
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch == "‑":
        return "‐"
    if unicodedata.category(ch) == "Cf" or ch in "͏ᅟᅠㅤﾠ᠋᠌᠍" or 0xFE00 <= ord(ch) <= 0xFE0F:
        return None
    return ch


_WIDTH = _Lazy(_width)


def visible(text: str) -> str:
    """The text without what can't be seen: width, kind of space, zero-width characters, order of combining accents."""
    return unicodedata.normalize("NFC", text.translate(_WIDTH))


_SKELETON = str.maketrans(LOOKALIKES)


def skeleton(text: str) -> str:
    """All look-alike letters as Latin letters, also where an accent is on them."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_SKELETON))


def _fold(ch: str):
    out = []
    for x in unicodedata.normalize("NFKD", LOOKALIKES.get(ch, ch)):
        x = LOOKALIKES.get(x, x)
        x = PLAIN.get(x, x)
        if unicodedata.category(x[0]) in ("Mn", "Me", "Cf"):
            continue
        out.append(x.casefold() if len(x) == 1 else x.lower())
    return "".join(out) or None


_FOLD = _Lazy(_fold)


def fold(text: str) -> str:
    """Without case, accents, width and look-alikes; ß as ss, ł as l."""
    return text.translate(_FOLD)


def _fold_script(ch: str):
    out = []
    for x in unicodedata.normalize("NFKD", ch):
        x = PLAIN.get(x, x)
        if unicodedata.category(x[0]) in ("Mn", "Me"):
            continue
        out.append(x.casefold() if len(x) == 1 else x.lower())
    return "".join(out) or None


_FOLD_SCRIPT = _Lazy(_fold_script)

WORD = re.compile(r"[^\W_]+")


def folded_script(ch: str) -> str:
    """A character without case and accents: none, one or more."""
    return _FOLD_SCRIPT[ord(ch)] or ""



def words(text: str) -> list[str]:
    """Runs of letters and digits without case and accents."""
    return WORD.findall(text.translate(_FOLD_SCRIPT))


_SENTENCE = re.compile(r"(?<=[.!?…])([\"“”»«’'\)\]]*)\s+(?=[^\s])|\s*\n+\s*")
_NEXT = re.compile(r"[\"“”„»«’'(\[–-]*\s*(\w?)")


def sentences(text: str) -> list[str]:
    """The text's sentences: split behind . ! ? … (with closing quotes) before blanks and at line ends.

    A mark followed by a small letter, as in quoted speech that goes on, does not end a sentence.
    """
    out, last = [], 0
    for m in _SENTENCE.finditer(text):
        if m.group(1) is not None and "\n" not in m.group() and _NEXT.match(text, m.end()).group(1).islower():
            continue
        cut = m.end(1) if m.group(1) is not None else m.start()
        if piece := text[last:cut].strip():
            out.append(piece)
        last = m.end()
    if piece := text[last:].strip():
        out.append(piece)
    return out
