"""Encoding: against two public implementations, and odd inputs."""

import base64
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

bpe = pytest.importorskip("ledgerlog.llm.bpe")
from ledgerlog.llm import tokenize  # noqa: E402

FOLDER = os.path.dirname(bpe.DEFAULT_VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="the vocabulary is not there")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ours(texts, encoder=None):
    encoder = encoder or bpe.Encoder()
    raw = [t.encode() for t in texts]
    lengths = np.array([len(r) for r in raw], np.int64)
    out = []
    for a, b in bpe.blocks(lengths):
        ids, counts = encoder.encode_block(b"".join(raw[a:b]), lengths[a:b])
        assert (encoder.encode_block(b"".join(raw[a:b]), lengths[a:b], ids=False)[1] == counts).all()
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


EDGES = ["", " ", "it's we'll don't I'M 'sabc 'llama x's '' 's", "a  b", "a \n b\n\n c", "trail  ", "\t'tis ' s", "12ab 12 '12", "aaaaaaaaaaaaa", "<|endoftext|> hi", "héllo 漢字 ​\x1c\x1d x\x85y\xa0z", "\U0001d400\U0001f600 \r\n x", " '", "' ", "'r", "re've", "x're'", "a\n's", "　x y"]


def test_random_texts(reference):
    rng = random.Random(1)
    pieces = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "B", "1", "22", "!", "..", "é", "漢", "　", "\x1c", "̀", "²", "ⅷ", "\U0001f600"]
    texts = EDGES + ["".join(rng.choice(pieces) for _ in range(rng.randrange(16))) for _ in range(3000)]
    assert ours(texts) == reference(texts)


def test_every_code_point(reference):
    texts = ["a" + c + "a1" + c + "1!" + c + "! " + c + " " for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) <= 0xDFFF]
    assert ours(texts[::7]) == reference(texts[::7])


def test_long_words_take_the_heap_and_agree_with_the_rounds(reference, monkeypatch):
    texts = ["漢字仮名交じり" * 400, "ab" * 3000, "x" * 5001, "=" * 9999, "http://" + "a1/" * 2000, "é" * 3000]
    assert ours(texts) == reference(texts)
    monkeypatch.setattr(bpe, "LONG_WORD", 1 << 30)
    short = [t[:2500] for t in texts]
    assert ours(short) == reference(short)


def test_store_of_words_starts_anew(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 64)
    texts = [f"word{i} other{i * 7}" for i in range(300)]
    encoder = bpe.Encoder()
    assert ours(texts, encoder) == reference(texts)


def test_other_vocabularies():
    import tiktoken

    path = f"{FOLDER}/byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb") if x.strip())}
    import public_tokenizers

    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*EDGES, "Überraschung größer, l'été déjà vu — ça va? Привет, мир! 漢字かな"]
    assert ours(texts, bpe.Encoder(path)) == [theirs.encode_ordinary(t) for t in texts]


def test_round_trip_of_documents(spark):
    texts = [*EDGES, "The cooled prism 20 damps said skid.\n" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = {v: k for k, v in bpe.Encoder().ranks.items()}
    for r in tokenize.encode(df).collect():
        assert b"".join(words[i] for i in r.ids).decode() == texts[r.doc_id]


def test_odd_rows(spark, reference):
    rows = [(1, None), (2, ""), (3, "plain text"), (3, "plain text"), (None, "no id"), (4, "long " * 500_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("id", F.lit(0)).withColumn("tokens", F.lit(0)).repartition(2)
    got = sorted((str(r.doc_id), list(r.ids)) for r in tokenize.encode(df).collect())
    assert got == sorted([(str(i), e) for (i, _), e in zip(rows, reference([t or "" for _, t in rows]))])
    assert tokenize.encode(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert tokenize.encode(df.where("false")).count() == 0 and tokenize.encode(df.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))).where("size(ids) > 0").count() == 0
    counted = tokenize.count_tokens(df, keep=("doc_id",)).collect()
    assert sorted((str(r.doc_id), r.tokens) for r in counted) == sorted((i, len(x)) for i, x in got)


def test_vocabulary_must_be_there(spark):
    with pytest.raises(Exception, match="is not there"):
        tokenize.encode(spark.createDataFrame([(1, "x")], "doc_id long, text string"), vocabulary="/nowhere").collect()
