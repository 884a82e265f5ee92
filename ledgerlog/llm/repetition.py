"""Repetition inside a single document: units of a text are labelled new or repeated by a conditional random field.

A text's words (letters only; case, digits and punctuation are dropped) are hashed in numpy, a block of documents at
a time.  A letter of a script without spaces, or of a run of letters longer than any word, is a word that weighs half.  Lines
and sentences, parted after so many words, are the units of the sequence.  A unit's features are how much of it is
made of words, and of runs of four and of eight words, that the text had before, how near they stood, how long it is,
how varied its letters are and where it stands.  The field is fitted on texts into which repetition was planted, so
that its labels are known, and Viterbi decoding labels every unit of every text; the decoded share of characters is the
measure.  The exact share, by passages of six words, is computed beside it for comparison and takes no part.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .tokenize import _text_blocks, spread

#: Twice the words, or the letters of a script without spaces, of a passage.
PASSAGE = 12
#: Longer runs of letters are no words: they are taken letter by letter.
LONGEST_WORD = 30
#: Twice the words of the runs whose earlier occurrence is a feature.
SHORT_RUN, LONG_RUN = 8, 16
#: Twice the words of a unit at most.
UNIT_WEIGHT = 16
#: A run that stood so few words before is near.
NEAR = 12
#: Bounds of the sample on which the field is fitted: documents, and characters of each.
TRAINING_DOCUMENTS = 200
TRAINING_CHARS = 100_000
#: Units of a training sequence; decoding takes sequences whole.
TRAINING_UNITS = 64
#: A text is repetitive if more than this share of its characters is labelled repeated.  A unit is labelled as a whole, and one
#: that is repeated by less than half is not, so this lies below 0.4, the share by passages that is asked for.
LIMIT = 0.3
_GAP, _WORD, _CHAR, _SKIP, _END = 0, 1, 2, 3, 4
#: Ranges of scripts that set no spaces between words: Thai, Lao, Tibetan, Myanmar, Khmer, kana, bopomofo, ideographs (fixed values).
UNSPACED = [(0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
#: Ends of lines and sentences (fixed values).
ENDS = "\n\r  .!?;。！？；।۔؟"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: what it is to us, and its lower-case form."""
    size = sys.maxunicode + 1
    category = np.array([unicodedata.category(chr(c)) for c in range(size)])
    kind = np.zeros(size, np.uint8)
    letter = np.isin(category, ["Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc"])
    kind[letter] = _WORD
    for a, b in UNSPACED:
        kind[a : b + 1][letter[a : b + 1]] = _CHAR
    kind[np.isin(category, ["Cf", "Cc", "Me"])] = _SKIP
    kind[[9, 11, 12, 0x85]] = _GAP
    kind[[ord(c) for c in ENDS]] = _END
    lower = np.arange(size, dtype=np.uint32)
    for c in np.flatnonzero(np.isin(category, ["Lu", "Lt"])):
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return kind, lower


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            made = []
            for base in (_BASE, _INVERSE):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
            self.up, self.down = made
        return self.up, self.down


_powers = _Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _run_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[b:e] for each pair; equal runs have equal hashes wherever they are."""
    up, down = _powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return _mixed((total[end] - total[begin]) * down[begin])


def _first_last(sorted_ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.searchsorted(sorted_ids, np.arange(n), "left"), np.searchsorted(sorted_ids, np.arange(n), "right")


@dataclass
class Words:
    """Words of several documents, one after the other: hash, document, place and extent in characters, weight."""

    hashes: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    extent: np.ndarray
    weight: np.ndarray
    last: np.ndarray  # of each document, the end of its words
    ends: np.ndarray  # ends of lines and sentences before the word
    distinct: np.ndarray  # a mask of the letters it has (by their last six bits)
    chars: np.ndarray  # of each document


def words_of(codes: np.ndarray, doc_starts: np.ndarray) -> Words:
    """The words of documents whose code points lie one after the other."""
    docs, n = len(doc_starts), len(codes)
    doc_ends = np.r_[doc_starts[1:], n] if docs else doc_starts
    kinds, lower = _tables()
    kind = kinds[codes]
    place = np.flatnonzero(kind != _SKIP)  # characters that are skipped part no word
    kind, low = kind[place], lower[codes[place]]
    doc_at = np.searchsorted(place, doc_starts)
    word = kind == _WORD
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    heads = doc_at[doc_at < len(word)]
    starts[heads] = word[heads]
    run = np.cumsum(starts)
    letters_in = np.bincount(run[word], minlength=int(run[-1]) + 1 if len(run) else 1)
    kind[word & (letters_in[run] > LONGEST_WORD)] = _CHAR
    word = kind == _WORD
    starts = (starts & word) | (kind == _CHAR)
    at = np.flatnonzero(starts)
    m = len(at)
    doc = np.searchsorted(doc_at, at, "right") - 1
    letter = word | (kind == _CHAR)
    hashes = _run_hashes(np.where(letter, _mixed(low + np.uint32(1)), np.uint64(0)), at, np.r_[at[1:], len(kind)][:m])
    bits = np.where(letter, np.uint64(1) << (low & np.uint32(63)).astype(np.uint64), np.uint64(0))
    pos = place[at]
    extent = np.diff(np.r_[pos, n])
    first, last = _first_last(doc, docs)
    tails = last[last > first] - 1
    extent[tails] = doc_ends[doc[tails]] - pos[tails]
    ends = np.r_[0, np.cumsum(kind == _END)]
    return Words(_mixed(hashes), doc, pos, extent, np.where(kind[at] == _WORD, 2, 1), last, ends[at], np.bitwise_or.reduceat(bits, at) if m else bits, doc_ends - doc_starts)


def _seen(w: Words, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, whether it lies in a run of this weight that its document had before, and whether that stood near."""
    m = len(w.doc)
    total = np.r_[0, np.cumsum(w.weight)]
    until = np.searchsorted(total, total[:-1] + weight)
    whole = until <= w.last[w.doc] if m else np.zeros(0, bool)
    begin, end = np.flatnonzero(whole), until[whole]
    keys = _run_hashes(w.hashes, begin, end) ^ _mixed(w.doc[begin].astype(np.uint64) + np.uint64(77))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, before = order[1:][same], order[:-1][same]

    def covered(some: np.ndarray) -> np.ndarray:
        step = np.bincount(begin[some], minlength=m + 1)[: m + 1] - np.bincount(end[some], minlength=m + 1)[: m + 1]
        return np.cumsum(step)[:m] > 0

    return covered(again), covered(again[begin[again] - begin[before] <= NEAR])


def exact_share(w: Words, passage: int = PASSAGE) -> np.ndarray:
    """Of each document the share of its characters in passages that occurred earlier in it."""
    docs = len(w.chars)
    return np.bincount(w.doc, w.extent * _seen(w, passage)[0], minlength=docs)[:docs] / np.maximum(1, w.chars)


@dataclass
class Units:
    doc: np.ndarray
    pos: np.ndarray
    chars: np.ndarray
    features: np.ndarray


def units_of(w: Words) -> Units:
    """The units of all documents, with their features."""
    m = len(w.doc)
    if not m:
        return Units(w.doc, w.pos, w.extent, np.zeros((0, FEATURES)))
    fresh = np.ones(m, bool)
    fresh[1:] = (w.ends[1:] != w.ends[:-1]) | (w.doc[1:] != w.doc[:-1])
    opened = np.flatnonzero(fresh)
    total = np.r_[0, np.cumsum(w.weight)]
    line = np.cumsum(fresh) - 1
    part = (total[:-1] - total[opened][line]) // UNIT_WEIGHT  # of its line or sentence
    at = np.flatnonzero(fresh | np.r_[True, part[1:] != part[:-1]])
    doc, chars = w.doc[at], np.add.reduceat(w.extent, at)
    share = lambda of: np.add.reduceat(w.extent * of, at) / np.maximum(1, chars)
    one, (short, near), (long, _) = _seen(w, 1)[0], _seen(w, SHORT_RUN), _seen(w, LONG_RUN)
    weight = np.add.reduceat(w.weight, at)
    letters = np.bitwise_count(np.bitwise_or.reduceat(w.distinct, at)) / np.minimum(np.maximum(1, chars), 26)
    nth = np.arange(len(at)) - np.searchsorted(doc, doc)
    a, b, c, d = share(one), share(short), share(long), share(near)
    shown = [np.ones(len(at)), a, b, b > 0.5, c, c > 0.5, d, (b > 0.5) & (c < 0.1), np.minimum(letters, 1.0), np.log1p(weight) / 3, weight < SHORT_RUN, np.log1p(nth) / 5]
    return Units(doc, w.pos[at], chars, np.stack(shown, 1).astype(float))


#: How many numbers describe a unit.
FEATURES = 12


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(lengths) - lengths


def _planted(text: str, random: np.random.Generator) -> list[tuple[str, int]]:
    """Pieces of a text with repetition put in: (piece, 1 if it only repeats what stands before it).

    Runs of one to four sentences come again, as they are or in capitals; some words of a sentence are said over and
    over, or a word without blanks between, or stand before each of several sentences.
    """
    cut, pieces = 0, []
    for k, c in enumerate(text):
        if c in ENDS and k + 1 < len(text) and text[k + 1] not in ENDS:
            pieces.append(text[cut : k + 1])
            cut = k + 1
    pieces = [p for p in [*pieces, text[cut:]] if sum(x.isalpha() for x in p) >= 15]
    if len(pieces) < 4:
        return []
    parts = [(p, 0) for p in pieces]
    for _ in range(int(random.integers(0, 1 + len(pieces) // 2))):
        k, kind = int(random.integers(0, len(pieces))), random.random()
        said = pieces[k].split()
        if kind < 0.15 and len(said) > 8:
            at, to = int(random.integers(0, len(said) - 6)), int(random.integers(0, len(parts)))
            phrase = " ".join(said[at : at + int(random.integers(6, 13))])
            some = parts[to : to + int(random.integers(3, 40))]
            parts[to : to + len(some)] = [x for n, p in enumerate(some) for x in ((phrase, int(n > 0)), p)]
            continue
        if kind < 0.6 or not said:
            run = [(p.upper() if random.random() < 0.1 else p, 1) for p in pieces[k : k + int(random.integers(1, 5))]]
            held = max((i for i, (p, _) in enumerate(parts) if p.lower() in {x.lower() for x, _ in run}), default=len(parts) - 1)
        else:
            at, some = int(random.integers(0, len(said))), int(random.integers(1, 8))
            phrase = " ".join(said[at : at + some]) if kind < 0.85 else "".join(x for x in said[at] if x.isalpha()) or "a"
            join, times = " " if kind < 0.85 else "", int(random.integers(15, 60))
            lead = join.join([phrase] * 6) if kind >= 0.85 or some < 4 else phrase
            run, held = [(lead, 0), (join.join([phrase] * times), 1)], int(random.integers(-1, len(parts)))
        to = max(int(random.integers(0, len(parts) + 1)), held + 1)
        parts[to:to] = run
    return parts


def train(texts: list[str], seed: int = 5) -> crf.Chain:
    """Fitted on texts into which repetition was planted; only what was planted is labelled repeated."""
    random = np.random.default_rng(seed)
    made, truth = [], []
    for text in texts:
        if parts := _planted(text, random):
            made.append("\n".join(p for p, _ in parts))
            truth.append(np.repeat([y for _, y in parts], [len(p) + 1 for p, _ in parts])[: len(made[-1])])
    if not made:
        emit = np.zeros((FEATURES, 2))
        emit[0], emit[2], emit[4] = (3.0, -3.0), (-3.0, 3.0), (-3.0, 3.0)
        return crf.Chain(emit, np.zeros((2, 2)))
    u = units_of(words_of(*_codes(made)))
    starts = np.cumsum([0, *map(len, made)])[:-1]
    flat = np.concatenate(truth)
    planted = np.r_[0, np.cumsum(flat)]
    ends = np.r_[u.pos[1:], len(flat)]
    ends = np.where(np.r_[u.doc[1:] != u.doc[:-1], True], (starts + [len(t) for t in made])[u.doc], ends)
    labels = (planted[ends] - planted[u.pos] > 0.5 * (ends - u.pos)).astype(int)
    return crf.fit(u.features, labels, _parts(np.bincount(u.doc, minlength=len(made))))


def _parts(lengths: np.ndarray) -> np.ndarray:
    """Sequences in parts of at most TRAINING_UNITS: fitting takes steps as long as the longest."""
    return np.array([min(TRAINING_UNITS, n - a) for n in lengths for a in range(0, n, TRAINING_UNITS)], np.int64)


def decode(chain: crf.Chain, codes: np.ndarray, doc_starts: np.ndarray, exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each document the share of its characters in units labelled repeated, and (if ``exact``) the exact share."""
    w, docs = words_of(codes, doc_starts), len(doc_starts)
    u = units_of(w)
    labels = crf.viterbi(chain, u.features, np.bincount(u.doc, minlength=docs)[:docs])
    share = np.bincount(u.doc, u.chars * labels, minlength=docs)[:docs] / np.maximum(1, w.chars)
    return share, exact_share(w) if exact else np.zeros(docs)


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = TRAINING_DOCUMENTS, chars: int = TRAINING_CHARS) -> crf.Chain:
    """The field, fitted on at most ``bound`` documents of up to ``chars`` characters: those whose ids hash lowest.

    Counting takes no texts; then one pass looks for ids that hash below what some more than ``bound`` of them do.
    """
    total = documents.count()
    rank = F.xxhash64(F.col(id_col))
    most = (1 << 63) - 1
    below = min(most, int(-most + 2 * most * min(1.0, 2 * bound / max(1, total))))
    some = documents.where(F.col(id_col).isNotNull() & (rank <= below)).where((F.length(text_col) > 0) & (F.length(text_col) <= chars))
    rows = some.select(rank.alias("rank"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).orderBy("rank", "id", "text").limit(bound).collect()
    return train([r.text for r in rows])


def repetition(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: crf.Chain | None = None, exact: bool = True) -> DataFrame:
    """(``id_col``, decoded_share DOUBLE, exact_share DOUBLE): one row per input row.

    ``decoded_share``: share of the characters in units that Viterbi decoding labels repeated.  ``exact_share``:
    share in passages that occurred earlier in the same text (0 unless ``exact``).  Both are 0 for null and empty
    texts and texts without letters.  Whole texts of any length; repeated rows give a row each; other columns are not
    read.  The pass over the corpus has no shuffle, unless the table has fewer pieces than there are cores.
    """
    chain = chain or fit(documents, id_col, text_col)
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for a, b, data, lengths in _text_blocks(batch.column(1)):
                codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
                lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                shares = decode(chain, codes, np.searchsorted(lead, np.cumsum(lengths) - lengths), exact)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), *(pa.array(x, pa.float64()) for x in shares)], names=["id", "decoded_share", "exact_share"])

    picked = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    return picked.mapInArrow(run, f"id {id_type}, decoded_share double, exact_share double").select(F.col("id").alias(id_col), "decoded_share", "exact_share")


def repetitive(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT, chain: crf.Chain | None = None) -> DataFrame:
    """(``id_col``) of the documents more than ``limit`` of which is labelled as repeating what they said before."""
    return repetition(documents, id_col, text_col, chain, exact=False).where(F.col("decoded_share") > limit).select(id_col)
