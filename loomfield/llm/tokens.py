"""Token ids of whole texts by a public word-end BPE, with a cache of word encodings."""

from __future__ import annotations

import json
import re

import numpy as np

from loomfield.llm.hashing import prefix_hashes, substring_hashes

#: Texts of these characters only are unchanged by NFC, and are split and lower-cased alike by
#: Python and by the tokenizer; any other text is encoded by the tokenizer as a whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]*")
#: Bytes of lower-cased plain texts: 0 white space, 1 letter (of two bytes from 128 on), 2 digit, 3 other.
_KIND = np.array([0 if b in b" \t\n\r" else 1 if 97 <= b <= 122 or b >= 128 else 2 if 48 <= b <= 57 else 3 for b in range(256)], np.int8)


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word: runs of letters, digits one by one, runs of other characters but
    white space; before these, an apostrophe that no such character precedes takes s, t, m, d, re,
    ve or ll from the letters after it."""
    kind = _KIND[data]
    before = np.concatenate([np.zeros(1, np.int8), kind[:-1]])
    starts = (kind != before) | (kind == 2)
    mark = np.flatnonzero((data == 39) & (before != 3))
    if mark.size:
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = padded[mark + 1], padded[mark + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        size = np.where(short, 1, np.where(long, 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        starts[mark + 1] = False
        after = mark + 1 + size
        after = after[after < len(data)]
        starts[after] = True
    starts &= kind != 0
    begin = np.flatnonzero(starts)
    # A word ends where the next begins, or at white space before that.
    blank = np.append(np.flatnonzero(kind == 0), len(data))
    end = np.minimum(np.append(begin[1:], len(data)), blank[np.searchsorted(blank, begin)])
    return begin, end


class WordTokenizer:
    """Encodes batches of texts to little-endian unsigned 32-bit ids. A word's ids do not depend on
    its neighbours, so each is encoded once while the cache (at most max_words words) holds it. Texts in
    which a word has the hash but not the bytes of another are encoded by the tokenizer as a whole."""

    def __init__(self, path: str, max_words: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        #: Of each known word, by the hash of its bytes: its number; its place and length in the letters; and
        #: the place and count of its ids in the pool.
        self.words: dict[int, int] = {}
        self._forget()
        # Words are plain, lower-cased and split already: for them the model alone is enough.
        form = json.loads(self.tokenizer.to_str())
        blank = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        bare = {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [blank, form["pre_tokenizer"]["pretokenizers"][-1]]}}
        self.bare = Tokenizer.from_str(json.dumps(form | bare))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and the count of each."""
        got = self.bare.encode(b" ".join(words).decode(), add_special_tokens=False)
        begin = np.flatnonzero(np.diff(np.array(got.word_ids, np.int64), prepend=-1))
        if len(begin) != len(words):
            own = [self.bare.encode(w.decode(), add_special_tokens=False).ids for w in words]
            return np.array([x for ids in own for x in ids], "<u4"), np.array([len(x) for x in own])
        return np.array(got.ids, "<u4"), np.diff(np.append(begin, len(got.ids)))

    def _forget(self) -> None:
        self.words.clear()
        self.letters, self.pool = np.empty(0, np.uint8), np.empty(0, "<u4")
        self.start, self.size, self.first, self.count = (np.empty(0, np.int64) for _ in range(4))

    def _found(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray | None:
        """Numbers of the words, learning those that are new; None if two words meet in a hash."""
        names, first, word = np.unique(substring_hashes(prefix_hashes(data), begin, end), return_index=True, return_inverse=True)
        if len(self.words) > self.max_words:
            self._forget()
        known = np.fromiter((self.words.get(x, -1) for x in names.tolist()), np.int64, len(names))
        new = np.flatnonzero(known < 0)
        if new.size:
            own = [data[a:b].tobytes() for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            ids, n = self._learn(own)
            size = np.fromiter(map(len, own), np.int64, len(own))
            known[new] = len(self.count) + np.arange(len(new))
            self.words.update(zip(names[new].tolist(), known[new].tolist(), strict=True))
            self.start = np.concatenate([self.start, len(self.letters) + np.cumsum(size) - size])
            self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(own), np.uint8)])
            self.size = np.concatenate([self.size, size])
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(n) - n])
            self.count = np.concatenate([self.count, n])
            self.pool = np.concatenate([self.pool, ids])
        at, size = known[word], end - begin
        if not np.array_equal(self.size[at], size):
            return None
        # Hashes only propose: every word is compared with the known one, byte by byte.
        done = np.cumsum(size)
        short = np.int32 if max(len(data), len(self.letters)) < 1 << 31 else np.int64
        flat = np.arange(done[-1] if len(done) else 0, dtype=short)
        here, there = (np.repeat((x - (done - size)).astype(short), size) for x in (begin, self.start[at]))
        return at if np.array_equal(data[here + flat], self.letters[there + flat]) else None

    def _plain(self, texts: list[str]) -> list[bytes]:
        raw = [t.lower().encode() for t in texts]
        whole = b"\n".join(raw)
        data = np.frombuffer(whole, np.uint8)
        begin, end = split_words(data)
        at = self._found(data, begin, end)
        if at is None:
            return [self._whole(t) for t in texts]
        n = self.count[at]
        done = np.cumsum(n)
        ids = self.pool[np.repeat(self.first[at] - (done - n), n) + np.arange(done[-1] if len(done) else 0)]
        stops = np.cumsum([len(x) + 1 for x in raw])
        cuts = np.concatenate(([0], done))[np.searchsorted(begin, stops)]
        buffer = ids.astype("<u4").tobytes()
        return [buffer[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if "<|" not in t and _PLAIN.fullmatch(t)]
        if plain:
            for k, ids in zip(plain, self._plain([texts[k] for k in plain]), strict=True):
                out[k] = ids
        return [self._whole(t) if ids is None else ids for t, ids in zip(texts, out, strict=True)]


_HELD: dict[str, WordTokenizer] = {}


def held(path: str) -> WordTokenizer:
    """The tokenizer of this process, which keeps its words between tasks."""
    if path not in _HELD:
        _HELD[path] = WordTokenizer(path)
    return _HELD[path]
