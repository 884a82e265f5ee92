"""Byte-level BPE in numpy, for whole Arrow batches.

The text of a block of documents is one flat array of code points.  Word boundaries come from vectorised
comparisons of character classes; every distinct word is encoded once per worker; the words not met before are
encoded together: their symbols lie in one flat array and every round merges, in each word, all occurrences of
the word's lowest-ranked pair, which is found by binary search over the sorted keys of all mergeable pairs.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from functools import lru_cache

import numpy as np

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Words longer than this many bytes are merged by a heap, in n log n, instead of in rounds.
LONG_WORD = 2048
#: Distinct words kept by a worker; beyond it, the store starts anew.
CACHED_WORDS = 200_000
#: Bytes of text handled at once; one longer document makes a block of its own.
BLOCK_BYTES = 1 << 20
#: White_Space of the Unicode character database (fixed values).
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point: letter (L*), number (N*), white space or other."""
    first = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    major = np.array(first)
    kinds[major == "L"] = LETTER
    kinds[major == "N"] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds


def word_starts(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Positions at which a word begins.

    ``codes``: code points of several documents, one after the other; ``doc_starts``: where each begins.  A word is
    an English clitic, or a run of letters, of digits or of other characters, with one blank before it, or white
    space; a run of white space before a visible character leaves its last character to that.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[codes]
    edge = np.empty(n, bool)  # first character of a run
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    doc_starts = doc_starts[doc_starts < n]
    at_doc = np.zeros(n, bool)
    at_doc[doc_starts] = True
    edge |= at_doc
    starts = edge.copy()
    visible = np.flatnonzero(edge & (kind != SPACE))
    led = visible[(visible > 0)]
    led = led[(kind[led - 1] == SPACE) & ~at_doc[led]]  # visible runs that follow white space of their document
    starts[led - 1] = True  # the last white space stands apart ...
    joined = led[codes[led - 1] == 32]
    starts[joined] = False  # ... or begins the word, if it is a blank
    quotes = np.flatnonzero((codes == 39) & starts)
    if len(quotes):
        quotes = quotes[quotes + 1 < n]
        quotes = quotes[edge[quotes + 1] & (kind[quotes + 1] == LETTER) & ~at_doc[quotes + 1]]
        a = codes[quotes + 1]
        b = np.where(quotes + 2 < n, codes[np.minimum(quotes + 2, n - 1)], 0)
        b = np.where(at_doc[np.minimum(quotes + 2, n - 1)], 0, b)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, length in ((one, 2), (two & ~one, 3)):
            q = quotes[hit]
            starts[q + 1] = False
            after = q[q + length < n] + length
            starts[after] = True  # a run that goes on becomes a word of its own
    return np.flatnonzero(starts)


class Encoder:
    """Encodes words with the ranks of a tiktoken file."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, out = [], [], []
        for token, rank in self.ranks.items():
            if len(token) > 1:
                for cut in range(1, len(token)):
                    a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                    if a is not None and b is not None:
                        left.append(a)
                        right.append(b)
                        out.append(rank)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], np.array(out, np.int64)[order]
        self.none = np.int64(1 << 40)
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.offsets = np.zeros(1 << 14, np.int64)
        self.words = 0

    def rank_of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 32) | b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of ids of each."""
        short = np.array([len(w) <= LONG_WORD for w in words], bool)
        if short.all():
            return self._rounds(words)
        parts: list = [None] * len(words)
        some = [w for w, s in zip(words, short) if s]
        if some:
            ids, counts = self._rounds(some)
            cut = np.split(ids, np.cumsum(counts)[:-1])
            for k, part in zip(np.flatnonzero(short), cut):
                parts[k] = part
        for k in np.flatnonzero(~short):
            parts[k] = self._heap(words[k])
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words at once; a round merges the lowest-ranked pair of each word wherever the word has it."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_owner = [], []
        while len(symbols):
            ranks = np.full(len(symbols), self.none)
            same = owner[1:] == owner[:-1]
            ranks[:-1][same] = self.rank_of_pairs(symbols[:-1][same], symbols[1:][same])
            head = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(ranks, head)
            counts = np.diff(np.r_[head, len(symbols)])
            ended = np.repeat(lowest == self.none, counts)
            if ended.any():
                done_ids.append(symbols[ended])
                done_owner.append(owner[ended])
                keep = ~ended
                symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
                counts, lowest = counts[lowest != self.none], lowest[lowest != self.none]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(lowest, counts)
            at = np.flatnonzero(hit)
            # of overlapping occurrences (x x x) those at even places of the chain merge, from the left
            chain = np.r_[True, np.diff(at) != 1]
            first = np.flatnonzero(chain)
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            at = at[place % 2 == 0]
            symbols[at] = ranks[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        ids, whose = (np.concatenate(done_ids), np.concatenate(done_owner)) if done_ids else (symbols, owner)
        order = np.argsort(whose, kind="stable")
        return ids[order], np.bincount(whose, minlength=len(words))

    def _heap(self, word: bytes) -> np.ndarray:
        """One long word: pairs wait in a heap by (rank, position)."""
        ids = [int(self.byte_ids[b]) for b in word]
        pieces: list = [word[k : k + 1] for k in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(k: int) -> None:
            nxt = after[k]
            if nxt < len(word) and (rank := self.ranks.get(pieces[k] + pieces[nxt])) is not None:
                heapq.heappush(heap, (rank, k, pieces[k] + pieces[nxt]))

        for k in range(len(word) - 1):
            offer(k)
        while heap:
            rank, k, joined = heapq.heappop(heap)
            if pieces[k] is None or (nxt := after[k]) >= len(word) or pieces[k] + pieces[nxt] != joined:
                continue
            pieces[k], ids[k], pieces[nxt] = joined, rank, None
            after[k] = after[nxt]
            if after[k] < len(word):
                before[after[k]] = k
            offer(k)
            if before[k] >= 0:
                offer(before[k])
        return np.array([i for i, p in zip(ids, pieces) if p is not None], np.int64)

    def _learn(self, words: list[bytes]) -> None:
        ids, counts = self.merge(words)
        used = int(self.offsets[self.words])
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        if self.words + len(words) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros(max(len(self.offsets), len(words)), np.int64)])
        self.flat[used : used + len(ids)] = ids
        self.offsets[self.words + 1 : self.words + len(words) + 1] = used + np.cumsum(counts)
        for k, w in enumerate(words):
            self.index[w] = self.words + k
        self.words += len(words)

    def word_numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the store; those not met before are encoded, together."""
        get = self.index.get
        if len(new := set(words) - self.index.keys()):
            if self.words + len(new) > CACHED_WORDS and self.words:
                self._reset()
                get, new = self.index.get, set(words)
            self._learn(list(new))
        return np.fromiter(map(get, words), np.int64, len(words))

    def encode_block(self, data: bytes, byte_lengths: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids (none unless ``ids``) of the documents in ``data`` (UTF-8, one after the other), and the number of each."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(byte_lengths), np.int64)
        raw = np.frombuffer(data, np.uint8)
        lead = (raw & 0xC0) != 0x80
        codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_at = np.flatnonzero(lead)
        begin = np.r_[0, np.cumsum(byte_lengths)[:-1]]
        doc_starts = np.searchsorted(byte_at, begin)  # code points before each document
        starts = word_starts(codes, doc_starts)
        bounds = np.r_[byte_at[starts], len(data)].tolist()
        words = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        numbers = self.word_numbers(words)
        counts = self.offsets[numbers + 1] - self.offsets[numbers]
        first_word = np.searchsorted(starts, doc_starts)
        total = np.r_[0, np.cumsum(counts)]
        edges = np.r_[first_word, len(words)]
        per_doc = total[edges[1:]] - total[edges[:-1]]
        if not ids:
            return np.zeros(0, np.int32), per_doc
        where = np.repeat(self.offsets[numbers] - total[:-1], counts) + np.arange(total[-1])
        return self.flat[where], per_doc


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"vocabulary file {path!r} is not there")
    return Encoder(path)


def blocks(lengths: np.ndarray, most: int = BLOCK_BYTES):
    """(first, last + 1) of consecutive documents that hold about ``most`` bytes."""
    total, first, n = np.r_[0, np.cumsum(lengths)], 0, len(lengths)
    while first < n:
        last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        yield first, last
        first = last
