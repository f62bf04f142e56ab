"""Chunked byte-level BPE against the library whose ids it must give, and exact round trips."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_samples import no_documents, odd_documents
from pyspark.sql import functions as F

from gridprobe.llm import bpe
from gridprobe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def words(spark):
    return bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=words.pattern, mergeable_ranks=words.ranks, special_tokens={})


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_query_against_the_library(spark, sf, library):
    wanted = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        wanted[r["doc_id"], len(ids), digest(ids), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    rows = QUERIES["op13_chunked_byte_bpe"](spark, sf)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, rows.collect())) == wanted


def test_merges(words, library):
    rng = random.Random(1)
    for alphabet in ("ab", "the cat", "0123456789", "é中\U0001F600x", "=-"):
        for size in (1, 2, 5, 31, 33, 200, 3000):
            piece = "".join(rng.choice(alphabet) for _ in range(size))
            got = [i for p in bpe.regex.findall(words.pattern, piece) for i in bpe.merged(p.encode(), words.ranks)]
            assert got == library.encode_ordinary(piece)
    assert bpe._merged_long(b"tokenisation", words.ranks) == bpe.merged(b"tokenisation", words.ranks)


def hard_texts():
    rng = random.Random(2)
    some = ["a", "'", "'re", "'s", "'ll", " ", "  ", "\n", "\n\n ", "\t", "1", "22", "!", "...", "é", "\U0001F600", " ", " x", "word", " Word"]
    yield from ("".join(rng.choice(some) for _ in range(rng.randrange(20, 160))) for _ in range(300))
    yield from ("x" * 500 + " end", " " * 300 + "a", "a" + "\n" * 200, "'" * 100, "1" * 90 + "'re" * 40, "b", "   ", "'r" * 33 + "e's")


def test_chunks_resynchronise(spark, words, library):
    """Tiny chunks put a border into every kind of place; texts whose pre-tokens exceed the overlap are whole."""
    docs = spark.createDataFrame(list(enumerate(hard_texts())), "doc_id long, text string")
    for chunk, overlap in ((16, 12), (31, 8)):
        rows = bpe.encoded(docs, words, chunk=chunk, overlap=overlap).select("row.doc_id", "ids").collect()
        got = {r["doc_id"]: r["ids"] for r in rows}
        assert len(got) == docs.count()
        for i, text in enumerate(hard_texts()):
            assert np.frombuffer(got[i], "<u4").tolist() == library.encode_ordinary(text), text
        shared = spark.sparkContext.broadcast(words)
        rows = docs.select(F.struct("doc_id").alias("row"), "text").filter(F.length("text") > chunk)
        cut = bpe._pre_tokenised(bpe.chunks(rows, chunk, overlap), shared, chunk, overlap)
        found = bpe.seams(cut, chunk).agg(F.sum(F.col("whole").cast("int")), F.count("*")).first()
        assert 0 < found[0] < found[1] / 2


def test_odd_documents(spark, words, library):
    docs = odd_documents(spark)
    rows = bpe.decoded(bpe.encoded(docs, words), words).select("row.*", "ids", "decoded").collect()
    assert len(rows) == docs.count()
    wanted = Counter((r["doc_id"], r["lang"], digest(library.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    assert Counter((r["doc_id"], r["lang"], hashlib.sha256(r["ids"]).hexdigest()) for r in rows) == wanted
    texts = Counter((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in rows) == texts


def test_bytes_that_are_not_utf8(spark, words, library):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    got = bpe.encoded(docs, words).first()["ids"]
    assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary("a�b")


def test_no_documents(spark, words):
    assert bpe.decoded(bpe.encoded(no_documents(spark), words), words).collect() == []


def test_a_vocabulary_must_have_all_bytes(spark, tmp_path):
    file = tmp_path / "few.tiktoken"
    file.write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError, match="no rank for the bytes"):
        bpe.vocabulary(spark, str(file), "x")
