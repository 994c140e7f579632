"""Token ids of whole texts, by a tokenizer file, fast enough for a corpus.

The tokenizer's pre-tokeniser never joins characters across white space, so a text's ids are the ids of its
space-separated chunks end to end. Chunks of ASCII and Latin letters are parted into the pre-tokeniser's words (a word
and the digits beside it stay together) by passes over the bytes of many texts at once; a chunk with any other byte
stays whole. Each different part is looked up once for all texts, in a bounded table; words that are not
there go through the tokenizer's merges, many at once, and whole chunks through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Collection
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa

from tidemark.llm.shared import begin_task, ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bounds of a worker's table: words and whole chunks, words, and ids of both; beyond any of them it goes back to its first BASE entries.
MOST_CHUNKS, MOST_WORDS, MOST_IDS, BASE = 400_000, 320_000, 5_000_000, 200_000

#: The pre-tokeniser's words, of text in lower case.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: What a byte is: between chunks; a letter or digit; another character of words; what makes its chunk stay whole.
_GAP, _ALNUM, _MARK, _WHOLE = range(4)
_KIND = bytes(_GAP if b in b" \n" else _ALNUM if chr(b).isalnum() else _MARK if b > 0x20 and b not in b"<\x7f" else _WHOLE for b in range(128))
_KIND += bytes(_ALNUM if b < 0xC0 or b in b"\xc3\xc4\xc5" else _WHOLE for b in range(128, 256))
_ALL_WHOLE = bytes(_GAP if k == _GAP else _WHOLE for k in _KIND)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: U+00C0 to U+017F, two bytes from C3 to C5: their lower case, which with their normal form is the same in any Unicode version.
#: Not among them: two signs, and the one letter whose lower case is two characters.
_LATIN = [chr(c) for c in range(0xC0, 0x180)]
_NO_LETTER = np.array([c in "\u00d7\u00f7\u0130" for c in _LATIN])
_LOWER_LATIN = np.frombuffer("".join(c if len(c.lower()) > 1 else c.lower() for c in _LATIN).encode(), np.uint8).reshape(-1, 2)

#: Each digit is a word of its own.
_DIGIT, _BY_DIGIT = re.compile(rb"[0-9]"), re.compile(rb"[0-9]|[^0-9]+")

_encoders: dict[str, Encoder] = {}


def _grown(table: np.ndarray, used: int, more: int) -> np.ndarray:
    """The table, or a larger copy with room for `more` after the first `used`; what is not used of it takes no memory yet."""
    if used + more <= len(table):
        return table
    size = len(table)
    while size < used + more:
        size *= 2
    larger = np.zeros(size, table.dtype)
    larger[:used] = table[:used]
    return larger


class Encoder:
    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        kinds = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
        parts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"].get("Regex") == WORD_PATTERN and not told.get("post_processor"):
            self.merges = Tokenizer(self.tokenizer.model)  # the same model, not another copy of it
            self.merges.normalizer = normalizers.Sequence([])
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for word, i in self.tokenizer.get_vocab().items():
                self.ends[i] = word.endswith(told["model"]["end_of_word_suffix"])
        elif kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a tokenizer that drops white space")
        if not all("<" in x["content"] for x in told.get("added_tokens", [])):
            self.merges = None
        self.kind = np.uint16 if max(self.tokenizer.get_vocab().values()) < 1 << 16 else np.int32
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.words = 0
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.base = (0, 0, 0)

    def forget(self) -> None:
        first, self.words, self.used = self.base
        # made anew: what popitem() leaves behind in a dictionary makes it slow
        self.slots = dict(islice(self.slots.items(), first))

    def add(self, parts: Collection[bytes], flat: np.ndarray, sizes: np.ndarray, words: bool = True) -> None:
        """Put new parts and their ids, end to end, into the table. Slots are numbered as entries are."""
        first = len(self.slots)
        n = first + len(parts)
        self.pool = _grown(self.pool, self.used, len(flat))
        self.starts, self.sizes = _grown(self.starts, first, n - first), _grown(self.sizes, first, n - first)
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[first:n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:n] = sizes
        self.slots.update(zip(parts, range(first, n), strict=True))
        if first < BASE <= n and (used := int(self.starts[BASE - 1] + self.sizes[BASE - 1])) <= MOST_IDS:
            self.base = (BASE, self.words + words * (BASE - first), used)
        self.words += words * len(parts)
        self.used += len(flat)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum())), sizes

    def learn_words(self, words: list[bytes]) -> None:
        parts: dict[bytes, list[bytes]] = {}
        if _DIGIT.search(b" ".join(words)):
            parts = {w: _BY_DIGIT.findall(w) for w in words if len(w) > 1 and _DIGIT.search(w)}
            words = [w for w in dict.fromkeys(chain(words, *parts.values())) if w not in parts and w not in self.slots]
        for k in range(0, len(words), 500):
            some = words[k : k + 500]
            ids = np.array(self.merges.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.int32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(some) and last[-1] == len(ids) - 1:
                sizes = np.diff(last, prepend=-1)
            else:
                ids, sizes = self.whole([w.decode() for w in some])
            self.add(some, ids, sizes)
        if parts:
            which = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(parts.values())), np.int64)
            sizes = self.sizes[which].astype(np.int64)
            ids = self.pool[ragged(self.starts[which], sizes)]
            counts = np.fromiter(map(len, parts.values()), np.int64, len(parts))
            self.add(parts, ids, np.add.reduceat(sizes, np.cumsum(counts) - counts))

    def parted(self, raw: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words and whole chunks of texts, end to end; which of them are whole chunks; where each text's begin, and the end."""
        text = b"".join(raw)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
        given = np.frombuffer(text, np.uint8)
        kind = np.frombuffer(bytearray(text.translate(_KIND if self.merges else _ALL_WHOLE)), np.uint8)
        lower = np.frombuffer(bytearray(text.translate(_LOWER)), np.uint8)
        if not text.isascii():
            latin = np.flatnonzero(given - np.uint8(0xC3) < 3)
            code = (given[latin] - np.uint8(0xC3)).astype(np.int64) * 64 + (given[latin + 1] - np.uint8(0x80))
            lower[latin], lower[latin + 1] = _LOWER_LATIN[code].T
            kind[latin[_NO_LETTER[code]]] = _WHOLE
        gaps, odd = np.flatnonzero(kind == _GAP), np.flatnonzero(kind == _WHOLE)
        if len(odd):
            begins, ends = np.sort(np.concatenate([gaps + 1, at[:-1]])), np.sort(np.concatenate([gaps, at[1:]]))
            first = np.unique(begins[np.searchsorted(begins, odd, "right") - 1])
            every = ragged(first, ends[np.searchsorted(ends, first, "right")] - first)
            kind[every] = _WHOLE
            lower[every] = given[every]
        opens = np.ones(len(kind) + 4, bool)  # what is set beyond the end is not looked at
        np.not_equal(kind[1:], kind[:-1], out=opens[1 : len(kind)])
        opens[at] = True
        self.contract(lower, kind, at, opens)
        kept = kind != _GAP
        first = np.flatnonzero(opens[: len(kind)][kept])
        data = lower[kept]
        words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, len(data)).astype(np.int32)), pa.py_buffer(data)])
        return words, kind[kept][first] == _WHOLE, np.searchsorted(first, at - np.searchsorted(gaps, at))

    @staticmethod
    def contract(lower: np.ndarray, kind: np.ndarray, at: np.ndarray, opens: np.ndarray) -> None:
        """'s, 't, 're, 've, 'm, 'll and 'd are words where a word may begin at the apostrophe."""
        quote = np.flatnonzero(lower == 39)
        quote = quote[opens[quote] & (kind[quote] == _MARK)]
        if not len(quote):
            return
        room = at[np.searchsorted(at, quote, "right")] - quote
        follows = lambda k: np.where(room > k, lower[np.minimum(quote + k, len(lower) - 1)], 0)
        one, two = follows(1), follows(2)
        short = np.isin(one, list(b"stmd"))
        long = (np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        opens[quote[short | long] + 1] = False
        opens[quote[short] + 2] = True
        opens[quote[long] + 3] = True

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end (each followed by `end`, if given), and the number of ids of each."""
        if len(self.slots) > MOST_CHUNKS or self.words > MOST_WORDS or self.used > MOST_IDS:
            self.forget()
        words, whole, at = self.parted([t.encode() for t in texts])
        found = words.dictionary_encode()
        which, different = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = np.fromiter(map(self.slots.get, different, repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(slots < 0)
        if len(new):
            as_whole = np.zeros(len(different), bool)
            as_whole[which[whole]] = True
            unknown, chunks = ([different[k] for k in new[as_whole[new] == x].tolist()] for x in (False, True))
            self.learn_words(unknown)
            if chunks:
                self.add(chunks, *self.whole([c.decode() for c in chunks]), words=False)
            slots[new] = [self.slots[different[k]] for k in new.tolist()]
        # the ids of each different word first, next to each other, and those of all words from there
        sizes = self.sizes[slots].astype(np.int64)
        pool = self.pool[ragged(self.starts[slots], sizes)].astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        sizes = sizes[which]
        ids = pool[ragged(starts[which], sizes)]
        lengths = np.diff(np.concatenate([[0], np.cumsum(sizes)])[at])
        if end is None:
            return ids, lengths
        closed = np.full(len(ids) + len(lengths), end, np.int32)
        own = np.ones(len(closed), bool)
        own[np.cumsum(lengths + 1) - 1] = False
        closed[own] = ids
        return closed, lengths + 1


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    begin_task("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
