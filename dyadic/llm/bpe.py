"""Byte-level BPE from a public rank file, by contiguous rank arrays.

A text is parted at blanks that no word reaches across, and what follows each blank is cut into words by the
vocabulary's public pattern; ids of parts and words that come again are remembered. Each distinct short word is held as the array of
its part boundaries with the rank of every adjacent pair of parts; the smallest rank is found by a scan,
its boundary is deleted, and the ranks of the two neighbouring pairs are refreshed, until no pair has a rank.
Words of similar length form the rows of one matrix, so a scan is one numpy call for all of them. Words beyond
SHORT bytes, where scans would be quadratic, go through a heap over a linked list with the same result.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import regex

#: The public pattern of the 50k byte-level vocabulary, with Unicode's White_Space spelled out,
#: and the same for texts of ASCII only.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: A blank that no word reaches across: one of its neighbours isn't white space. The blank starts the next word.
PARTING = re.compile(r"(?<!\s) | (?=\S)")
#: A blank before white space or the end; a text without one can be parted at every blank.
INNER = re.compile(r" (?:\s|\Z)")

WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)  # bytes of the longest word in a matrix
SHORT = WIDTHS[-1]  # bytes of a word that is merged by scans
KEPT = 96  # bytes of a word that stays in the cache
NONE = np.int32(2**31 - 1)
DEFAULT_RANKS = os.environ.get("DYADIC_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


class ByteBpe:
    """One vocabulary; cache_words bounds the words that are remembered between texts (it is emptied when full)."""

    def __init__(self, rank_file: bytes, cache_words: int = 300_000):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        if max(ranks.values()) >= 1 << 20:
            raise ValueError("ids of 2^20 and more don't fit the keys of pairs")
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int32)
        self.starts_char = np.zeros(len(self.bytes_of), bool)
        keys, values = [], []
        for word, rank in ranks.items():
            self.bytes_of[rank] = len(word)
            self.starts_char[rank] = (word[0] & 0xC0) != 0x80
            for k in range(1, len(word)):
                a, b = ranks.get(word[:k]), ranks.get(word[k:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]
        self.pair = dict(zip(keys, values))
        self.words = regex.compile(PATTERN).findall
        self.ascii_words = re.compile(ASCII_PATTERN).findall
        self.cache: dict[str, bytes] = {}  # ids as int32
        self.spaced: dict[str, bytes] = {}
        self.cache_words = cache_words

    def split(self, text: str) -> list[str]:
        return self.ascii_words(text) if text.isascii() else self.words(text)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of adjacent parts; NONE where they don't merge or b is past the end (-1)."""
        key = (a.astype(np.int64) << 20) | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.values[at], NONE)

    def _merge_rows(self, words: list[bytes]) -> list[bytes]:
        """Ids of short words, one word a row of parts; rows end with -1."""
        end = np.array([len(w) for w in words])
        width = int(end.max())
        done = [b""] * len(words)
        parts = self.single[np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)]
        parts[np.arange(width) >= end[:, None]] = -1
        where = np.arange(len(words))
        ranks = self._ranks(parts[:, :-1], parts[:, 1:]) if width > 1 else np.full((len(words), 1), NONE)
        while len(where):
            row = np.arange(len(where))
            best = ranks.argmin(1)
            least = ranks[row, best]
            over = least == NONE
            if over.any():
                full = parts[over]
                for w, ids, k in zip(where[over].tolist(), full, end[over].tolist()):
                    done[w] = ids[:k].tobytes()
                live = ~over
                where, parts, ranks, best, least, end = (x[live] for x in (where, parts, ranks, best, least, end))
                if not len(where):
                    break
                row = np.arange(len(where))
            end = end - 1
            width = int(end.max())
            column = np.arange(width)
            after = column > best[:, None]
            parts = np.where(after, parts[:, 1 : width + 1], parts[:, :width])  # the boundary behind best goes
            parts[row, best] = least
            if width == 1:
                ranks = np.full((len(where), 1), NONE)
                continue
            ranks = np.where(after[:, :-1], ranks[:, 1:width], ranks[:, : width - 1])
            inside, before = best < width - 1, best > 0
            r, k = row[inside], best[inside]
            ranks[r, k] = self._ranks(least[inside], parts[r, k + 1])
            r, k = row[before], best[before]
            ranks[r, k - 1] = self._ranks(parts[r, k - 1], least[before])
        return done

    def _merge_long(self, word: bytes) -> bytes:
        """Ids of one long word: the smallest rank first, the leftmost of equals, from a heap of rank and place."""
        ids, n, get = self.single[np.frombuffer(word, np.uint8)].tolist(), len(word), self.pair.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [get(a << 20 | b, -1) for a, b in zip(ids, ids[1:])] + [-1]  # of the part and the next one
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            if rank[i] != r:
                continue
            j = after[i]
            k = after[j]
            ids[i], ids[j], rank[j], after[i] = r, -1, -1, k
            if k < n:
                before[k] = i
                rank[i] = x = get(r << 20 | ids[k], -1)
                if x >= 0:
                    push(heap, x << 32 | i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                rank[h] = x = get(ids[h] << 20 | r, -1)
                if x >= 0:
                    push(heap, x << 32 | h)
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def learn(self, words: set[str]) -> None:
        """Puts words into the cache."""
        by_width: dict[int, tuple[list[str], list[bytes]]] = {}
        for word in words.difference(self.cache):
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > SHORT:
                self.cache[word] = self._merge_long(raw)
            else:
                names, raws = by_width.setdefault(bisect.bisect_left(WIDTHS, len(raw)), ([], []))
                names.append(word)
                raws.append(raw)
        for names, raws in by_width.values():
            self.cache.update(zip(names, self._merge_rows(raws)))

    def learn_spaced(self, parts: set[str]) -> list[str]:
        """Puts the ids of each part, with a blank before it, into the cache; returns the parts too long to stay."""
        new = [(part, self.split(" " + part)) for part in parts.difference(self.spaced)]
        words = set().union(*(w for _, w in new))
        self.learn(words)
        get = self.cache.__getitem__
        for part, w in new:
            self.spaced[part] = b"".join(map(get, w)) if len(w) > 1 else get(w[0])
        for word in words:
            if len(word) > KEPT:
                del self.cache[word]
        return [part for part, _ in new if len(part) > KEPT]

    def encode_each(self, texts: Iterable[str | None], chunk_chars: int = 1 << 20) -> Iterator[tuple[str, bytes]]:
        """Text and ids (int32, one after the other), in order; null and empty texts have no ids."""
        names: list[str] = []
        size = 0
        for text in texts:
            names.append(text or "")
            size += len(names[-1])
            if size >= chunk_chars:
                yield from self._encode_chunk(names)
                names, size = [], 0
        yield from self._encode_chunk(names)

    def _encode_chunk(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        if len(self.spaced) > self.cache_words or len(self.cache) > self.cache_words:
            self.spaced.clear()
            self.cache.clear()
        held = [PARTING.split(x) if INNER.search(x) else x.split(" ") for x in texts]
        heads = [self.split(parts[0]) for parts in held]
        first = set().union(*heads)
        self.learn(first)
        passing = self.learn_spaced(set().union(*(parts[1:] for parts in held)))
        self.learn(first)
        get, spaced = self.cache.__getitem__, self.spaced.__getitem__
        for text, head, parts in zip(texts, heads, held):
            yield text, b"".join(chain(map(get, head), map(spaced, islice(parts, 1, None))))
        for part in passing:
            del self.spaced[part]
        for word in first:
            if len(word) > KEPT:
                del self.cache[word]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.encode_each([text]))[1], np.int32).tolist()


_loaded: dict[int, ByteBpe] = {}


def loaded(rank_file: bytes) -> ByteBpe:
    """The vocabulary of a rank file, once for each worker process."""
    key = hash(rank_file)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBpe(rank_file)
    return _loaded[key]
