"""Whole-text byte-level BPE encoding through the tokenizers library, with a table of encoded pre-tokens.

The vocabulary's pre-tokenizer cuts a text into runs of letters, digits or other marks, each with the space before it, into
contractions and into white space; the model then encodes each pre-token alone. Here the cuts are found over arrays of
bytes for many texts at once, each pre-token is looked up by a 64-bit hash and compared byte by byte with the one held, and
only pre-tokens that the table doesn't have yet go to the library. Texts with bytes outside of SIMPLE (other scripts, control
characters), texts with a pre-token whose hash another one holds, and all texts where the vocabulary has other rules
(PRETOKENIZER) are encoded whole by the library itself.
"""

from __future__ import annotations

import functools
import json
import os
from array import array

import numpy as np
import pyarrow.compute as pc

from .shingles import _powers, mixed

END_OF_TEXT = 0
BYTE_BPE = "byte_bpe_50k.json"
#: Most pre-tokens held by one Python worker (about 100 MB with their ids and bytes); beyond it the table starts anew.
TABLE_ENTRIES = 1_500_000
_SLOTS = 1 << 22
#: Longer texts are cut at spaces between words.
_LONGEST = 1 << 21

_LETTER, _DIGIT, _MARK, _SPACE, _WHITE, _STOP, _OTHER = range(7)


def _classes() -> np.ndarray:
    """The kind of each byte; a letter's two bytes from U+00C0 to U+00FF count as letters."""
    kind = np.full(256, _OTHER, dtype=np.uint8)
    for b in range(0x21, 0x7F):
        kind[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    kind[0x80:0xC0] = kind[0xC3] = _LETTER
    kind[0x20] = _SPACE
    kind[0x09:0x0E] = _WHITE
    kind[0] = _STOP
    return kind


KIND = _classes()
#: The rules that pretoken_starts follows, as a vocabulary's file states them, and what a file must not have besides.
PRETOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Letters after an apostrophe that make a contraction, by its length.
ONE, TWO = b"stmd", (b"re", b"ve", b"ll")


def vocabulary(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """The byte-level vocabulary's letter for each byte: printable ones stand for themselves, others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def pretoken_starts(data: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts laid end to end, each text between stops (0); also where each stop is."""
    kind = KIND[data]
    white = (kind == _SPACE) | (kind == _WHITE)
    before, after = np.empty_like(kind), np.empty_like(white)
    before[0], before[1:] = _STOP, kind[:-1]
    after[-1], after[:-1] = False, ~white[1:] & (kind[1:] != _STOP)
    white_before = np.concatenate(([False], white[:-1]))
    starts = (white & (~white_before | after)) | (~white & (kind != before) & (before != _SPACE)) | (kind == _STOP)
    quotes = np.flatnonzero((data == 0x27) & starts)  # an apostrophe that begins a pre-token
    quotes = quotes[quotes + 2 < len(data)]
    first, second = data[quotes + 1], data[quotes + 2]
    short = np.isin(first, list(ONE))
    long = np.zeros(len(quotes), dtype=bool)
    for a, b in TWO:
        long |= (first == a) & (second == b)
    for found, size in ((quotes[short], 2), (quotes[long & ~short], 3)):
        starts[found + 1] = False
        ends = found + size
        starts[ends[kind[ends] == _LETTER]] = True
    return np.flatnonzero(starts)


class Encoder:
    """Encodes texts to the bytes of their ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._model = Tokenizer.from_file(path)
        self._model.encode_special_tokens = True
        stated = json.loads(self._model.to_str())
        rules = stated.get("pre_tokenizer") or {}
        self._known_rules = stated.get("normalizer") is None and all(rules.get(k) == v for k, v in PRETOKENIZER.items())
        # The same model without its own pre-tokenizer: it takes pre-tokens in the byte alphabet, parted by spaces.
        self._ready = Tokenizer(self._model.model)
        self._ready.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self._alphabet = _byte_alphabet() | {0: " "}
        self._clear()

    def _clear(self) -> None:
        self._names = np.zeros(_SLOTS, dtype=np.uint64)
        self._entry = np.zeros(_SLOTS, dtype=np.int32)
        # For each pre-token held: where its ids and its bytes begin in the pools, and how many they are.
        self._places, self._sizes, self._spelled_at, self._spelled = (np.zeros(1 << 14, dtype=np.int32) for _ in range(4))
        self._pool = np.zeros(1 << 18, dtype="<u4")
        self._letters = np.zeros(1 << 18, dtype=np.uint8)
        self._pooled = self._lettered = self._held = 0

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._model.encode_batch(texts, add_special_tokens=False)]

    def _slots(self, names: np.ndarray) -> np.ndarray:
        """The slot of each name, or the empty one where it would be put (as its complement)."""
        slots = (names & np.uint64(_SLOTS - 1)).astype(np.int64)
        out = np.empty(len(names), dtype=np.int64)
        left = np.arange(len(names))
        while len(left):
            there = self._names[slots]
            hit, empty = there == names[left], there == 0
            out[left[hit]] = slots[hit]
            out[left[empty & ~hit]] = ~slots[empty & ~hit]
            more = ~(hit | empty)
            left, slots = left[more], (slots[more] + 1) & (_SLOTS - 1)
        return out

    def _learn(self, names: np.ndarray, words: list[bytes]) -> None:
        """Encode words and put them in the table."""
        counts, ids = [], []
        for a in range(0, len(words), 2000):
            spelled = b"\0".join(words[a : a + 2000]).decode("latin-1").translate(self._alphabet)
            encoded = self._ready.encode_batch([spelled], add_special_tokens=False)[0]
            word = np.array(encoded.word_ids)
            counts.append(np.bincount(word, minlength=min(2000, len(words) - a)))
            ids.append(np.array(encoded.ids, dtype="<u4"))
        sizes, fresh = np.concatenate(counts), np.concatenate(ids)
        while self._pooled + len(fresh) > len(self._pool):
            self._pool = np.concatenate((self._pool, np.zeros_like(self._pool)))
        self._pool[self._pooled : self._pooled + len(fresh)] = fresh
        places = self._pooled + np.cumsum(sizes) - sizes
        self._pooled += len(fresh)
        lengths = np.array([len(w) for w in words], dtype=np.int32)
        letters = np.frombuffer(b"".join(words), dtype=np.uint8)
        while self._lettered + len(letters) > len(self._letters):
            self._letters = np.concatenate((self._letters, np.zeros_like(self._letters)))
        self._letters[self._lettered : self._lettered + len(letters)] = letters
        spelled_at = self._lettered + np.cumsum(lengths) - lengths
        self._lettered += len(letters)
        first, self._held = self._held, self._held + len(words)
        while self._held > len(self._places):
            grown = (np.concatenate((x, np.zeros_like(x))) for x in (self._places, self._sizes, self._spelled_at, self._spelled))
            self._places, self._sizes, self._spelled_at, self._spelled = grown
        for held, values in ((self._places, places), (self._sizes, sizes), (self._spelled_at, spelled_at), (self._spelled, lengths)):
            held[first : self._held] = values
        left = np.arange(len(names))
        while len(left):  # of names that would share a slot, one goes in each round
            slots = ~self._slots(names[left])
            _, one = np.unique(slots, return_index=True)
            put, at = left[one], slots[one]
            self._names[at], self._entry[at] = names[put], first + put
            left = np.delete(left, one)

    def _others(self, data: np.ndarray, ends: np.ndarray, starts: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Which pre-tokens aren't those of their entries, byte by byte: their hashes met by chance."""
        lengths = (ends - starts).astype(np.int32)
        other = self._spelled[entries] != lengths
        if other.any():  # compared as far as both go
            lengths = np.minimum(lengths, self._spelled[entries])
        total = np.cumsum(lengths)
        steps = np.arange(total[-1] if len(total) else 0, dtype=np.int32)
        shift = np.repeat((self._spelled_at[entries] - (total - lengths)).astype(np.int32), lengths)
        mine = np.repeat((starts - (total - lengths)).astype(np.int32), lengths)
        wrong = np.flatnonzero(self._letters[shift + steps] != data[mine + steps])
        other[np.searchsorted(total, wrong, side="right")] = True
        return other

    def _arrays(self, blobs: list[bytes]) -> list[bytes | None]:
        """Ids of texts whose bytes are all of known kinds; none for a text with a pre-token whose hash another one holds."""
        joined = b"\0" + b"\0".join(blobs) + b"\0"
        data = np.frombuffer(joined, dtype=np.uint8)
        starts = pretoken_starts(data)
        up, down = _powers(1 << max(20, len(data).bit_length()))
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
        ends = np.append(starts[1:], len(data))
        stops = np.flatnonzero(data[starts] == 0)
        inside = np.ones(len(starts), dtype=bool)
        inside[stops] = False
        bounds = (stops - np.arange(len(stops))).tolist()  # of texts, in pre-tokens
        starts, ends = starts[inside], ends[inside]
        names = mixed((running[ends] - running[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        names |= np.uint64(1)
        slots = self._slots(names)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            fresh, first = np.unique(names[missing], return_index=True)
            if self._held + len(fresh) > TABLE_ENTRIES:
                self._clear()
                fresh, first = np.unique(names, return_index=True)
                missing = np.arange(len(names))
            at = missing[first]
            self._learn(fresh, [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            slots[missing] = self._slots(names[missing])
        entries = self._entry[slots]
        other = self._others(data, ends, starts, entries)
        sizes, places = self._sizes[entries], self._places[entries]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = self._pool[np.repeat(places - total[:-1], sizes) + np.arange(total[-1])]
        cuts = total[bounds].tolist()
        made: list[bytes | None] = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        for k in np.unique(np.searchsorted(bounds, np.flatnonzero(other), side="right") - 1).tolist():
            made[k] = None
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        simple, pieces, whole = [], [], []
        for i, text in enumerate(texts):
            parts = _cut(text) if len(text) > _LONGEST else [text]
            blobs = [p.encode() for p in parts]
            if self._known_rules and all(_is_simple(b) for b in blobs):
                simple.append((i, len(blobs)))
                pieces += blobs
            else:
                whole.append(i)
        done: list[bytes | None] = []
        for a, b in slices(pieces):
            done += self._arrays(pieces[a:b])
        at = 0
        for i, n in simple:
            mine = done[at : at + n]
            at += n
            if None in mine:
                whole.append(i)
            else:
                out[i] = mine[0] if n == 1 else b"".join(mine)
        for i, ids in zip(whole, self._plain([texts[i] for i in whole])):
            out[i] = ids
        return out


#: Bytes that KIND knows, but stops; and the two-byte signs among Latin letters that are no letters.
SIMPLE = bytes(b for b in range(256) if KIND[b] not in (_OTHER, _STOP))
_SIGNS = (b"\xc3\x97", b"\xc3\xb7")


def _is_simple(data: bytes) -> bool:
    if data.translate(None, SIMPLE):
        return False
    return data.isascii() or not any(sign in data for sign in _SIGNS)


def _cut(text: str) -> list[str]:
    """A long text cut before single spaces between other characters: pre-tokens begin there in any case."""
    out, start = [], 0
    while len(text) - start > _LONGEST:
        at = text.rfind(" ", start + 1, start + _LONGEST)
        while at > start and (text[at - 1].isspace() or text[at + 1 : at + 2].isspace()):
            at = text.rfind(" ", start + 1, at)
        if at <= start:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker; its table lasts over the worker's tasks."""
    return Encoder(path)


def slices(texts, most_chars: int = 1 << 18):
    """Row ranges of about most_chars characters, so that the size of a batch doesn't grow with its texts."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= most_chars:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_slices(batch, most_bytes: int = 1 << 19, name: str = "text"):
    """(first, end, texts) over an Arrow batch's texts, a limited number of bytes at a time; null is an empty text."""
    column = batch.column(name)
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    total = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < len(sizes):
        base = int(total[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(total, base + most_bytes, side="right")))
        yield first, end, [t or "" for t in column.slice(first, end - first).to_pylist()]
        first = end
