"""The registered queries on the given documents."""

import os
import re

import pytest

queries = pytest.importorskip("ledgerlog.llm.queries")
from ledgerlog.llm import bpe, repetition  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not (os.path.isdir(FOLDER) and os.path.exists(bpe.DEFAULT_VOCABULARY)), reason="the given tables or vocabularies are not there")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


def test_ids(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{os.path.dirname(bpe.DEFAULT_VOCABULARY)}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    keys = sorted(documents)
    expected = dict(zip(keys, (e.ids for e in t.encode_batch([documents[k] or "" for k in keys], add_special_tokens=False))))
    assert {r.doc_id: list(r.ids) for r in queries.p6_ids(spark, FOLDER).collect()} == expected


def unspaced(c):
    return any(a <= ord(c) <= b for a, b in repetition.UNSPACED)


def share(text):
    """The definition, read plainly: words count two, letters of unspaced scripts, and of runs longer than any word, one, a passage twelve."""
    found = []
    for m in re.finditer(r"[^\W\d_]+", re.sub(r"[­​-‏﻿]", "", text).lower()):
        start = 0
        for k, c in enumerate(m[0] + " "):
            if c == " " or unspaced(c) or len(m[0]) > repetition.LONGEST_WORD:
                if k > start:
                    found.append((m[0][start:k], 2))
                if c != " ":
                    found.append((c, 1))
                start = k + 1
    seen, covered = set(), [False] * len(found)
    for i in range(len(found)):
        j, total = i, 0
        while j < len(found) and total < 12:
            total += found[j][1]
            j += 1
        if total >= 12:
            key = tuple(w for w, _ in found[i:j])
            if key in seen:
                covered[i:j] = [True] * (j - i)
            seen.add(key)
    size = sum(len(w) for w, _ in found)
    return sum(len(w) for (w, _), c in zip(found, covered) if c) / size if size else 0.0


def test_repetitive_documents(spark, documents):
    expected = sorted(k for k, t in documents.items() if share(t or "") > 0.4)
    assert sorted(r.doc_id for r in queries.p8_found(spark, FOLDER).collect()) == expected and expected


def test_shares_of_the_mix(spark):
    got = {r.source: r for r in queries.p7_shares(spark, FOLDER).collect()}
    there = sum(r.target_share for r in got.values() if r.tokens)
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    assert all(abs(r.actual_share - r.target_share / there) < 0.02 for r in got.values() if r.tokens)
