"""BPE encoding by tree concatenation, and decoding.

A text (what stands between special tokens of a long one) is cut in equal
halves until each is a leaf; the library encodes all
leaves of a text in parallel, then neighbours are joined pair by pair. At a
join a window of text round the cut, from the start of a token on the left to
the end of one on the right, is encoded anew, and grows until it agrees with
both sides: until AGREE tokens in a row are the same, with the same places in
the text, in the window and in the left list, and likewise on the right. The
lists are spliced at the first token of each run.

Why a splice is exact: a list of tokens is the encoding of its text if and only
if each two neighbours are that of theirs, and where a word ends shows in its
last token. Up to and with the shared token all neighbours are neighbours in
the left list, from it on in the window. Where a token may start is decided by
what follows it, as the tokenizer's pattern looks at nothing before. The normal
form could reach over a splice; it is checked there that it does not.

What a join costs is its window, whatever stands in the text: words without end
are joined as any others, and only a side that the join really changes (as in a
run of one letter) is encoded again as far as it changes.

Defined results: a null or empty text has no ids. Texts of any length are taken
whole. Repeated rows give repeated rows; an empty table gives an empty result.
Columns named like a result (ids, decoded) are replaced; others stay, or don't
reach a table of digests.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .base import keyed, table, unkeyed, with_made

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Code points of a leaf, and of the first window on each side of a cut; tokens that must agree.
LEAF_CHARS, WINDOW_CHARS, AGREE = 2048, 32, 2
#: Leaves that the library encodes at once, and its threads.
LEAVES, THREADS = 256, 2
#: Longest word that a word cache holds, and the bytes of an entry beside the word and its ids.
CACHED_CHARS, ENTRY_BYTES = 48, 200

#: What a worker's cache of the ids of words may take.
CACHE_BYTES = 192 << 20

_coders: dict[tuple, "Coder"] = {}


def coder(path: str = VOCABULARY, cache_bytes: int = CACHE_BYTES, parted: bool = False) -> "Coder":
    """This worker's coder for a vocabulary file; a worker that runs several tasks builds it once."""
    key = (path, cache_bytes, parted)
    if key not in _coders:
        _coders[key] = Coder(*key)
    return _coders[key]


def _closed(text: str, at: int) -> bool:
    """Whether the normal form of the text does not reach over a place."""
    a, b = text[max(0, at - 8) : at], text[at : at + 8]
    if a.isascii() and b.isascii():
        return True
    nfc = lambda t: unicodedata.normalize("NFC", t)
    return not unicodedata.combining(b[:1] or " ") and nfc(a + b) == nfc(a) + nfc(b)


#: A full stop or comma after a letter, at the end of a word.
_STOP = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])[.,](?=[ \n]|\Z)")


def _apart(text: str) -> str:
    """A text with the same ids, lower-cased and parted as the tokenizer does itself, so that the cache holds fewer words.

    In Latin-1 lower case is the same everywhere and nothing composes; a special
    token is looked for before it is lowered, so a text with `<|` stays as it is.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else _STOP.sub(r" \g<0>", text.lower())


class Tokens:
    """Ids with the code points of the text that each stands for, as [start, end)."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.ids, self.start, self.end = ids, start, end

    @classmethod
    def of(cls, encoding, at: int) -> "Tokens":
        ids = np.array(encoding.ids, "<u4")
        place = np.fromiter(chain.from_iterable(encoding.offsets), "int64", 2 * len(ids)).reshape(-1, 2) + at
        return cls(ids, place[:, 0], place[:, 1])

    def part(self, a: int, b: int | None = None) -> "Tokens":
        return Tokens(self.ids[a:b], self.start[a:b], self.end[a:b])

    def alone(self, k: int) -> bool:
        """Whether a token starts where the one before has ended."""
        return not k or bool(self.start[k] >= self.end[k - 1])

    def same(self, i: int, other: "Tokens", j: int, n: int) -> bool:
        """Whether n tokens from i are those of the other from j."""
        if i + n > len(self.ids) or j + n > len(other.ids):
            return False
        a, b = self.part(i, i + n), other.part(j, j + n)
        return bool((a.ids == b.ids).all() and (a.start == b.start).all() and (a.end == b.end).all())


def _joined(parts: list[Tokens]) -> Tokens:
    return Tokens(*(np.concatenate([getattr(x, k) for x in parts]) for k in ("ids", "start", "end")))


def _agreement(window: Tokens, side: Tokens, text: str, low: int, high: int) -> tuple[int, int] | None:
    """The first place in the window and in a side from which AGREE tokens in [low, high) are the same."""
    for m in np.flatnonzero((window.start >= low) & (window.start < high)).tolist():
        k = int(np.searchsorted(side.start, window.start[m]))
        if window.same(m, side, k, AGREE) and window.end[m + AGREE - 1] <= high and window.alone(m) and side.alone(k) and _closed(text, int(window.start[m])):
            return m, k
    return None


class Coder:
    """cache_bytes: what a cache of the ids of short words may take, by which leaves are encoded; 0 for none. parted: words are parted for it as _apart does, in texts of one leaf."""

    def __init__(self, path: str = VOCABULARY, cache_bytes: int = 0, parted: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, bytes] = {}
        self.spans: dict[str, tuple] = {}
        self.cache_bytes, self.parted, self.held = cache_bytes, parted, 0
        self.encoded_chars = 0  # code points that the library has encoded
        added = self.tokenizer.get_added_tokens_decoder()
        if any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in added.values()):
            raise ValueError("added tokens that depend on what stands beside them")
        self.added = {x.content: i for i, x in added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")" if added else "(?!)")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.strings = [self.tokenizer.id_to_token(i) for i in range(size)]

    def _library(self, texts: list[str]) -> list:
        self.encoded_chars += sum(map(len, texts))
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def encode(self, texts: list[str], leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit bytes."""
        out: list = [None] * len(texts)
        short = [k for k, t in enumerate(texts) if len(t) <= leaf]
        for a in range(0, len(short), LEAVES):
            some = short[a : a + LEAVES]
            for k, ids in zip(some, self._words([texts[k] for k in some]) if self.cache_bytes else self._whole([texts[k] for k in some]), strict=True):
                out[k] = ids
        for k, t in enumerate(texts):
            if out[k] is None:
                # The library takes special tokens out first; what stands between them is encoded by itself.
                parts = [(x, self.added.get(x)) for x in self.special.split(t) if x]
                out[k] = b"".join(self._tree(x, leaf, window).ids.tobytes() if i is None else np.uint32(i).tobytes() for x, i in parts)
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Texts of one leaf."""
        self.encoded_chars += sum(map(len, texts))
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, texts: list[str]) -> list[bytes]:
        """Texts of one leaf by their words; a blank or line feed is in no token, and no token or normal form reaches over one."""
        if self.held > self.cache_bytes:
            self.cache.clear()
            self.held = 0
        known, cut = self.cache, [(_apart(t) if self.parted else t).replace("\n", " ").split(" ") for t in texts]
        new, long = list({w for words in cut for w in words}.difference(known)), {}
        for k in range(0, len(new), LEAVES):
            for w, ids in zip(new[k : k + LEAVES], self._each(new[k : k + LEAVES]), strict=True):
                if len(w) <= CACHED_CHARS:
                    known[w] = ids
                    self.held += ENTRY_BYTES + len(w) + len(ids)
                else:
                    long[w] = ids
        find = (lambda w: known[w] if w in known else long[w]) if long else known.__getitem__
        return [b"".join(map(find, words)) for words in cut]

    def _spanned(self, texts: list[str]) -> list[Tokens]:
        """The tokens of parts of a text, by a cache of words as in _words, each word with the places of its tokens."""
        if self.held > self.cache_bytes:
            self.cache.clear()
            self.spans.clear()
            self.held = 0
        known, cut, out = self.spans, [t.replace("\n", " ").split(" ") for t in texts], []
        new, long = list({w for words in cut for w in words}.difference(known)), {}
        for k in range(0, len(new), LEAVES):
            some = new[k : k + LEAVES]
            for w, got in zip(some, self._parts(some), strict=True):
                if len(w) <= CACHED_CHARS:
                    known[w] = got
                    self.held += 2 * ENTRY_BYTES + len(w) + 9 * got[1]
                else:
                    long[w] = got
        find = (lambda w: known[w] if w in known else long[w]) if long else known.__getitem__
        for words in cut:
            ids, n, start, end = zip(*map(find, words), strict=True)
            size = np.fromiter(map(len, words), "int64", len(words)) + 1
            shift = np.repeat(np.cumsum(size) - size, n)
            place = lambda x: np.frombuffer(b"".join(x), "<i4") + shift  # noqa: B023, E731
            out.append(Tokens(np.frombuffer(b"".join(ids), "<u4"), place(start), place(end)))
        return out

    def _parts(self, words: list[str]) -> list[tuple[bytes, int, bytes, bytes]]:
        """(ids, their number, starts, ends) of words without blanks, told apart as in _each."""
        got = Tokens.of(self._library([" ".join(words)])[0], 0)
        if (np.diff(got.start) < 0).any():
            return [(t.ids.tobytes(), len(t.ids), t.start.astype("<i4").tobytes(), t.end.astype("<i4").tobytes()) for t in (Tokens.of(e, 0) for e in self._library(words))]
        ends = np.cumsum([len(w) + 1 for w in words])
        edges = np.searchsorted(got.start, np.append(0, ends))
        n = np.diff(edges)
        shift = np.repeat(np.append(0, ends[:-1]), n)
        raw = [x.tobytes() for x in (got.ids, (got.start - shift).astype("<i4"), (got.end - shift).astype("<i4"))]
        return [(raw[0][i:j], k, raw[1][i:j], raw[2][i:j]) for i, j, k in zip((4 * edges[:-1]).tolist(), (4 * edges[1:]).tolist(), n.tolist(), strict=True)]

    def _each(self, words: list[str]) -> list[bytes]:
        """The ids of words without blanks, encoded as one text and told apart by where they stand."""
        got = Tokens.of(self._library([" ".join(words)])[0], 0)
        if (np.diff(got.start) < 0).any():
            return self._whole(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        edges, raw = (4 * np.searchsorted(got.start, np.append(0, ends))).tolist(), got.ids.tobytes()
        return [raw[i:j] for i, j in zip(edges, edges[1:], strict=False)]

    def _tree(self, text: str, leaf: int, window: int) -> Tokens:
        """Joins neighbours pair by pair until one list is left."""
        parts, nodes = _halves(0, len(text), leaf), []
        for k in range(0, len(parts), LEAVES):
            some = parts[k : k + LEAVES]
            leaves = [text[a:b] for a, b in some]
            got = self._spanned(leaves) if self.cache_bytes else [Tokens.of(e, 0) for e in self._library(leaves)]
            nodes += [(a, b, Tokens(t.ids, t.start + a, t.end + a)) for (a, b), t in zip(some, got, strict=True)]
        while len(nodes) > 1:
            nodes = [(x[0], y[1], self._join(text, x, y, window)) for x, y in zip(nodes[::2], nodes[1::2], strict=True)]
        return nodes[0][2]

    def _join(self, text: str, x: tuple, y: tuple, window: int) -> Tokens:
        """The tokens of two neighbouring nodes (start, end, tokens) as one list."""
        (a, cut, left), (_, b, right) = x, y
        reach = [window, window]
        while True:
            # From the start of a token on the left to the end of one on the right: so windows keep step with both lists.
            i = int(np.searchsorted(left.start, cut - reach[0], "right")) - 1
            j = int(np.searchsorted(right.end, cut + reach[1]))
            lo = int(left.start[i]) if i > 0 and cut - reach[0] > a else a
            hi = int(right.end[j]) if j < len(right.end) and cut + reach[1] < b else b
            middle = Tokens.of(self._library([text[lo:hi]])[0], lo)
            first = (0, 0) if lo == a else _agreement(middle, left, text, lo, cut)
            last = (len(middle.ids), len(right.ids)) if hi == b else _agreement(middle, right, text, cut, hi)
            if first and last:
                return _joined([left.part(0, first[1]), middle.part(first[0], last[0]), right.part(last[1])])
            reach = [reach[0] * (1 if first else 2), reach[1] * (1 if last else 2)]

    def decode(self, ids: bytes) -> str:
        """As the library decodes with a vocabulary that names no decoder: the tokens' strings with blanks between."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _halves(a: int, b: int, leaf: int) -> list[tuple[int, int]]:
    """[a, b) cut in equal halves until each is at most leaf long: a power of two of pieces, in order."""
    parts = [(a, b)]
    while parts[0][1] - parts[0][0] > leaf:
        parts = [x for a, b in parts for x in ((a, (a + b) // 2), ((a + b) // 2, b))]
    return parts


def encode_column(docs: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """docs with `ids`: array of int."""
    return with_made(docs, text, [("ids", "array<int>")], lambda texts: [[np.frombuffer(x, "<u4").astype("int32") for x in coder(path).encode([t or "" for t in texts])]])


def decode_column(docs: DataFrame, ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """docs with `decoded`: string."""
    return with_made(docs, ids, [("decoded", "string")], lambda rows: [[coder(path).decode(np.asarray(x or [], "<u4").tobytes()) for x in rows]])


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each text in one pass, without moving the ids out of Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        for pdf in batches:
            n, ids_sha, text_sha = [], [], []
            for k in range(0, len(pdf), 256):
                for ids in c.encode(["" if t is None else t for t in pdf[text][k : k + 256]]):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({key: pdf[key], "n_tokens": np.array(n, "int64"), "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    return unkeyed(keyed(docs, key, text).mapInPandas(run, f"{key} string, n_tokens long, ids_sha256 string, decoded_sha256 string"), key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
