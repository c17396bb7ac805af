"""Whether a text breaks off: a stack automaton over its structure, and a model of where sentences may end.

The automaton finds what is open at the end: fences, brackets, quotations, markup, broken characters and escapes. Where
the structure is whole and only the final mark is missing, a model decides whether a sentence can end there. It is fitted
on complete sentences of the corpus and on the same sentences cut at random places, so it needs no labels; with a source
sentence beside it, it also sees how much of the source has its counterpart.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np

from sparklex.llm.text import fold, sentences, visible

_PAIRS = {"(": ")", "[": "]", "{": "}", "„": "“”", "“": "”", "«": "»", "»": "«", "‚": "‘’"}
_CLOSERS = set(")]}“”»«‘’")
_TOKEN = re.compile(r"(?m:^[ \t]*(?:[-*•+]|\d{1,3}[.)])(?:[ \t]+|$))|```|<(/?)([A-Za-z][\w-]*)[^<>]*?(/?)>|[()\[\]{}„“”«»‚‘’\"]")
_MARKS = frozenset("`()[]{}„“”«»‚‘’\">")
#: A list item on the stack.
ITEM = "•"
_TERMINATED = re.compile(r"[.!?][\"“”»«’‘'\)\]\s]*$")
_ELLIPSIS = re.compile(r"\s*(\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\.\.\.+|…)\s*$")
_BROKEN = re.compile(r"(?:�+|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|%[0-9A-Fa-f]?|&#?\w{0,8})\s*$")
_HANGING = re.compile(r"[,;:(\[{„‚/–—-]\s*$")
_OPEN_TAG = re.compile(r"<[/\w-]*\s*$")
_WORDS = re.compile(r"\w+")


@dataclass
class Structure:
    body: str  # the text without what was put behind the cut
    marker: str  # an ellipsis that stood behind it
    broken: bool  # ends in a broken character, escape or tag
    hanging: bool  # ends in a mark after which something must follow
    open: list[str]  # what is open at the end
    terminated: bool  # ends with a final mark


def unclosed(text: str) -> list[str]:
    """What the pushdown automaton has on its stack at the end of the text.

    A list item stays open if nothing follows its marker and another item stands before it.
    """
    stack: list[str] = []
    items = after = 0
    for m in _TOKEN.finditer(text):
        t = m.group()
        if t[-1:] not in _MARKS and not m.group(2) or t[:1] in "-*•+":
            if ITEM in stack:  # the item before it ends
                del stack[len(stack) - 1 - stack[::-1].index(ITEM)]
            stack.append(ITEM)
            items, after = items + 1, m.end()
        elif t == "```" or t == '"':
            if t in stack:
                del stack[len(stack) - 1 - stack[::-1].index(t) :]
            else:
                stack.append(t)
        elif m.group(2):
            name = m.group(2).lower()
            if m.group(1):
                if f"<{name}>" in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(f"<{name}>") :]
            elif not m.group(3) and name not in ("br", "hr", "p", "li", "img"):
                stack.append(f"<{name}>")
        elif t in _CLOSERS and (at := next((i for i in range(len(stack) - 1, -1, -1) if t in _PAIRS.get(stack[i], "")), None)) is not None:
            del stack[at:]
        elif t in _PAIRS:
            stack.append(t)
    if ITEM in stack and (items < 2 or any(map(str.isalnum, text[after:]))):
        stack.remove(ITEM)
    return stack


def structure(text: str) -> Structure:
    body = text.rstrip()
    broken = bool(_BROKEN.search(body))
    body = _BROKEN.sub("", body).rstrip() if broken else body
    marker = ""
    if m := _ELLIPSIS.search(body):
        marker, body = m.group(1), body[: m.start()].rstrip()
    if _OPEN_TAG.search(body):
        broken = True
    return Structure(body, marker, broken, bool(_HANGING.search(body)), unclosed(body), bool(_TERMINATED.search(body)))


_BITS = 17
_COMMON = 500


def _h(*parts) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode("utf-8", "replace")) & ((1 << _BITS) - 1)


class EndModel:
    """Probability that a fragment is a whole sentence, by logistic regression on hashed features."""

    def __init__(self, common: frozenset, known: frozenset, weights: np.ndarray):
        self.common, self.known, self.weights = common, known, weights

    @staticmethod
    def features(fragment: str, source: str | None, kind: str, common: frozenset, known: frozenset) -> list[int]:
        w = _WORDS.findall(fold(fragment))
        if not w:
            return [_h("none")]
        last, before = w[-1], w[-2] if len(w) > 1 else ""
        cls = last if last in common else ("9" if last.isdigit() else "#" + last[-1:])
        pre = before if before in common else ("9" if before.isdigit() else "#" + before[-1:])
        out = [_h("bias"), _h(kind), _h("l", last), _h("c", cls), _h("cc", pre, cls), _h("s", last[-3:]), _h("n", min(len(w), 30)), _h("short", len(last) < 3 and not last.isdigit())]
        # What the sentence has begun, against how it ends.
        seen = [x for x in dict.fromkeys(w[:-1]) if x in common]
        out += [_h("p", x, cls) for x in seen] + [_h("q", x, len(w) - 1 - max(i for i, y in enumerate(w) if y == x)) for x in seen]
        if source is None:
            return out + [_h("known", last in known or last.isdigit())]
        s = _WORDS.findall(fold(source))
        if not s:
            return out
        inside = set(s)
        figures = {x for x in s if x.isdigit()}
        ratio = round(20 * min(len(w) / len(s), 1.6))
        copied = last in inside
        part = not copied and any(x.startswith(last) for x in inside) and last not in known
        last_shared = sum(1 for x in dict.fromkeys(s) if x in set(w)) / max(1, len(inside))
        return out + [
            _h("ratio", kind, ratio), _h("ratio", kind, ratio // 2), _h("fig", len(figures - set(w))), _h("same end", s[-1] == last), _h("part", part),
            _h("known", last in known or copied or last.isdigit()), _h("shared", kind, round(10 * last_shared)), _h("srclast", s[-1] if s[-1] in common else "#" + s[-1][-1:], cls),
        ]

    def complete(self, fragment: str, source: str | None, kind: str) -> float:
        z = self.weights[self.features(fragment, source, kind, self.common, self.known)].sum()
        return float(1 / (1 + np.exp(-z)))


def _strip_end(sentence: str) -> str:
    return re.sub(r"[.!?…\s\"“”»«’‘')\]]+$", "", sentence)


def in_hash_order(rows: list[tuple]) -> list[tuple]:
    """The rows in an order that only depends on what they hold."""
    return sorted(rows, key=lambda r: (zlib.crc32(repr(r).encode("utf-8", "replace")), repr(r)))


def fit_end_model(rows: list[tuple[str, str | None, str]], seed: int = 7, cuts: int = 3, rounds: int = 5) -> EndModel:
    """rows: (text, source or None, kind). Complete sentences teach that they may end; cut ones that they may not.

    Complete are sentences with a final mark, and those without one whose source has none either and ends in the same
    word and figures (headlines). The order of the rows changes nothing.
    """
    rng = np.random.default_rng(seed)
    rows = in_hash_order(rows)
    whole: list[tuple[str, str | None, str]] = []
    counts: dict[str, int] = {}
    for text, source, kind in rows:
        if not text:
            continue
        parts = sentences(visible(text))
        src = sentences(visible(source)) if source is not None else None
        for w in set(_WORDS.findall(fold(text))):
            counts[w] = counts.get(w, 0) + 1
        for i, p in enumerate(parts):
            s = src[i] if src and i < len(src) else None
            if source is not None and s is None:
                continue
            if _TERMINATED.search(p):
                if s is not None and not _TERMINATED.search(s):
                    continue
                whole.append((_strip_end(p), s, kind))
            elif s is not None and not _TERMINATED.search(s):
                a, b = _WORDS.findall(fold(p)), _WORDS.findall(fold(s))
                if a and b and a[-1] == b[-1] and {x for x in a if x.isdigit()} == {x for x in b if x.isdigit()}:
                    whole.append((_strip_end(p), s, kind))
    order = sorted(counts, key=lambda w: (-counts[w], w))
    common, known = frozenset(order[:_COMMON]), frozenset(w for w in order if counts[w] > 1)
    x, y = [], []
    for text, source, kind in whole:
        if len(text) < 12:
            continue
        x.append(EndModel.features(text, source, kind, common, known))
        y.append(1.0)
        for at in rng.integers(3, len(text) - 1, cuts):
            if cut := text[:at].rstrip(" ,;:–"):
                x.append(EndModel.features(cut, source, kind, common, known))
                y.append(0.0)
    weights, grad = np.zeros(1 << _BITS, np.float32), np.full(1 << _BITS, 1e-6, np.float32)
    if not x:
        return EndModel(common, known, weights)
    y = np.array(y, np.float32)
    sizes = np.array([len(r) for r in x])
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            ids = np.concatenate([x[i] for i in batch])
            of = np.repeat(np.arange(len(batch)), sizes[batch])
            z = np.bincount(of, weights[ids], minlength=len(batch))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * np.where(y[batch] > 0, 2.0, 1.0)
            step = g[of].astype(np.float32)
            np.add.at(grad, ids, step * step)
            np.add.at(weights, ids, -0.15 * step / np.sqrt(grad[ids]))
    return EndModel(common, known, weights)


#: Probability of completeness below which a text without final mark counts as cut, and with an ellipsis behind it.
CUT, CUT_MARKED = 0.75, 0.95


def end_evidence(text: str, source: str | None, kind: str, model: EndModel) -> tuple[str | None, float | None]:
    """(reason, evidence): why the structure of the text says that it is cut off, or else what the model says of its end.

    A final mark means completeness unless a tag is open. Without one, broken characters, hanging marks and open brackets,
    quotations or list items mean a cut; else the model judges the last sentence against the source sentence in its place:
    the evidence is its log-odds of completeness over those that are asked for, more of them behind an ellipsis.
    """
    st = structure(visible(text))
    if not any(map(str.isalpha, st.body)):
        return None, None
    if st.terminated:
        return (f"open {st.open[-1]}" if st.open and st.open[-1].startswith("<") else None), None
    if st.broken:
        return "broken character", None
    if st.open and st.open[-1] == ITEM:
        return "open list item", None
    parts = sentences(st.body)
    last = parts[-1]
    if still := unclosed(last):
        return f"open {still[-1]}", None
    if st.hanging:
        return "hanging mark", None
    s = None
    if source is not None:
        src = sentences(visible(source))
        s = src[len(parts) - 1] if len(parts) <= len(src) else (src[-1] if src else None)
    p = min(max(model.complete(_strip_end(last), s, kind), 1e-9), 1 - 1e-9)
    asked = CUT_MARKED if st.marker else CUT
    return None, float(np.log(p / (1 - p)) - np.log(asked / (1 - asked)))


def broken_off(text: str, source: str | None, kind: str, model: EndModel, leaning: float = 0.0) -> str | None:
    """Why the text counts as cut off inside a sentence, or None; `leaning` is added to the evidence of completeness."""
    reason, evidence = end_evidence(text, source, kind, model)
    return reason if evidence is None or evidence + leaning >= 0 else "incomplete sentence"
