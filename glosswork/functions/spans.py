"""Places of words in texts: finding, blanking, splitting, and moving them when a text is cleaned. Offsets are code points, ends exclusive."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import cached_property, lru_cache
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def find(text: str, surface: str, spaced: bool = True) -> list[tuple[int, int]]:
    """Occurrences of a surface; in spaced scripts only whole words count, an apostrophe inside a word being part of it."""
    if not surface:
        return []
    edge = (r"(?<![\w])(?<!\w['’])", r"(?![\w]|['’]\w)") if spaced else ("", "")
    return [m.span() for m in re.finditer(edge[0] + re.escape(surface) + edge[1], text, re.IGNORECASE)]


def locate(text: str, surfaces: list[str], spaced: bool = True) -> tuple[int, int] | None:
    """The one place where any of the surfaces stands, the longer before the shorter; None if there is none or more than one."""
    for s in sorted(set(surfaces), key=lambda s: (-len(s), s)):
        hits = find(text, s, spaced)
        if hits:
            return hits[0] if len(hits) == 1 else None
    return None


def blank(text: str, span: tuple[int, int], mark: str = "____") -> str:
    return text[: span[0]] + mark + text[span[1] :]


def segments(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int | None]]:
    """The text cut at spans (start, stop, id): longest first, then leftmost, what overlaps a chosen one left out; None between them."""
    chosen: list[tuple[int, int, int]] = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        if all(s[1] <= c[0] or s[0] >= c[1] for c in chosen):
            chosen.append(s)
    out, at = [], 0
    for a, b, i in sorted(chosen):
        if a > at:
            out.append((text[at:a], None))
        out.append((text[a:b], i))
        at = b
    return out + ([(text[at:], None)] if at < len(text) else [])


class Folded:
    """A text under a fold of its words, with the way back to the text.

    The fold sees one word (a run of letters and digits) or one other character
    at a time. A place of the folded text stands for the character whose coming
    made the fold of the word so far reach it; the end of a folded word stands
    for the end of the word, whatever the fold took from it.
    """

    def __init__(self, text: str, fold: Callable[[str], str] | None = None):
        self.raw = text
        if fold is None:
            self.text, self.starts, self.ends = text, range(len(text)), {}
        else:
            parts, self.starts, self.ends = [], [], {}
            for a, b in _runs(text):
                word = fold(text[a:b])
                reach = list(accumulate((min(len(fold(text[a:k])), len(word)) for k in range(a + 1, b)), max))
                self.starts += [a + bisect_right(reach, p) for p in range(len(word))]
                parts.append(word)
                if word and b - a > 1:
                    self.ends[len(self.starts)] = b
            self.text = "".join(parts)

    @cached_property
    def letters(self) -> list[int]:
        """How many letters and digits stand before each place."""
        return [0, *accumulate(map(int, map(str.isalnum, self.text)))]

    def span(self, a: int, b: int) -> tuple[int, int]:
        """A span of the folded text in the text; marks after its last character belong to it, marks before its first do not."""
        start, end = (a, b) if isinstance(self.starts, range) else (self.starts[a], self.ends.get(b, self.starts[b - 1] + 1))
        while end < len(self.raw) and unicodedata.category(self.raw[end]) in ("Mn", "Mc"):
            end += 1
        while start < end and unicodedata.category(self.raw[start]) in ("Mn", "Mc"):
            start += 1
        return start, end

    def next_letter(self, at: int) -> int:
        while at < len(self.text) and not self.text[at].isalnum():
            at += 1
        return at

    def inside(self, at: int) -> bool:
        """Whether a place parts two letters of a word."""
        return 0 < at < len(self.text) and self.text[at - 1].isalnum() and self.text[at].isalnum()


def _runs(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for word, chars in groupby(text, str.isalnum):
        n = sum(1 for _ in chars)
        yield from [(at, at + n)] if word else [(k, k + 1) for k in range(at, at + n)]
        at += n


def token_offsets(text: str, tokens: Sequence[str], fold: Callable[[str], str] | None = None, joiners: str = "") -> list[tuple[int, int] | None]:
    """Each token's place in the text, in order, without regard to case; None for one that is not found.

    Only what is no letter or digit may stand between a token and the one
    before. After tokens that were not found, as many letters may be passed over
    as these have; there a token is found only where it ends a word, and never
    inside one. fold: a spelling under which text and tokens are compared.
    joiners: characters of the text that a token may lack, one in a token.
    """
    found, at, owed, out = Folded(text, fold), 0, 0, []
    for token in tokens:
        token = fold(token) if fold and token else token
        hit = None
        if not token:
            tries = ()
        elif not owed and token[0].isalnum():
            # No letter may be passed over, so the next one is the only place.
            tries = filter(None, (_stands(found.text, found.next_letter(at), token, joiners),))
        else:
            tries = _standing(found, at, owed, token, joiners)
        for a, b in tries:
            broken = a > at and token[0].isalnum() and found.text[a - 1].isalnum()
            cut = owed and token[-1].isalnum() and found.inside(b)
            if not broken and not cut and (not joiners or sum(c in joiners for c in found.text[a:b]) <= 1):
                hit = a, b
                break
        out.append(found.span(*hit) if hit else None)
        at, owed = (hit[1], 0) if hit else (at, owed + len(token or ""))
    return out


def _stands(text: str, at: int, token: str, joiners: str) -> tuple[int, int] | None:
    """The span of a token that stands at a place of a text, without regard to case. No pattern is made unless there are joiners."""
    if joiners:
        m = _shape(token, joiners).match(text, at)
        return m and m.span()
    there = text[at : at + len(token)]
    same = there == token or (len(there) == len(token) and all(map(_alike, token, there)))
    return (at, at + len(token)) if same else None


def _standing(found: Folded, at: int, owed: int, token: str, joiners: str) -> Iterator[tuple[int, int]]:
    """The spans of a token from a place on that do not overlap, while no more letters are passed over than are owed."""
    a, most = at, found.letters[at] + owed
    while a < len(found.text) and found.letters[a] <= most:
        span = _stands(found.text, a, token, joiners)
        if span:
            yield span
        a = span[1] if span else a + 1


@lru_cache(1 << 12)
def _shape(token: str, joiners: str) -> re.Pattern:
    return re.compile(f"[{re.escape(joiners)}]?".join(map(re.escape, token)), re.IGNORECASE)


@lru_cache(1 << 16)
def _alike(c: str, d: str) -> bool:
    """Whether two characters differ in case only."""
    return c == d or bool(re.fullmatch(re.escape(c), d, re.IGNORECASE))


def token_places(fold: Callable[[str], str] | None = None, joiners: str = "") -> Callable[[Column, Column], Column]:
    """token_offsets as a function of columns (text, tokens): array<struct<a, b>>, in Arrow batches; null texts and tokens have no places."""

    @F.pandas_udf("array<struct<a: int, b: int>>")
    def run(texts: pd.Series, tokens: pd.Series) -> pd.Series:
        place = lambda t, k: [x and {"a": x[0], "b": x[1]} for x in token_offsets(t or "", [] if k is None else list(k), fold, joiners)]
        return pd.Series([place(t, k) for t, k in zip(texts, tokens, strict=True)])

    return run


def move(raw: str, clean: str, spans: list[tuple[int, int]]) -> list[tuple[int, int] | None]:
    """Spans of raw as spans of clean; None for what is not there any more whole."""
    to: dict[int, int] = {}
    for tag, a, b, c, _ in SequenceMatcher(None, raw, clean, autojunk=False).get_opcodes():
        if tag == "equal":
            to.update({a + k: c + k for k in range(b - a)})
    out = []
    for a, b in spans:
        places = [to.get(k) for k in range(a, b)]
        whole = places and None not in places and places[-1] - places[0] == b - a - 1
        out.append((places[0], places[-1] + 1) if whole else None)
    return out


def cut_article(form: str, articles: list[str]) -> tuple[str, str]:
    """(article with what parts it from the word, bare form) of a citation form; elided articles stand without a blank."""
    for a in sorted(articles, key=len, reverse=True):
        head = a if a.endswith(("'", "’")) else a + " "
        if form.lower().startswith(head.lower()) and len(form) > len(head):
            return form[: len(head)], form[len(head) :]
    return "", form
