"""Span deduplication against plain loops with a segmentation of their own; odd inputs."""

import random

import xxhash
from llm_samples import no_documents, odd_documents

from gridprobe.llm import spans
from gridprobe.llm.queries import QUERIES


def cut_up(text):
    """[(piece of text, its lower-case words)], found character by character."""
    pieces, at, i = [], 0, 0
    while i < len(text):
        ends = text[i] == "\n"
        if text[i] in ".!?" and text[i + 1 : i + 2] in (" ", "\t"):
            while text[i + 1 : i + 2] in (" ", "\t"):
                i += 1
            ends = True
        i += 1
        if (ends or i == len(text)) and text[at:i].strip():
            pieces.append(text[at:i])
            at = i
    if at < len(text) and pieces:
        pieces[-1] += text[at:]  # white space at the very end
    out = []
    for piece in pieces:
        words = piece.split()
        if len(words) <= 16:
            out.append((piece, [w.lower() for w in words]))
            continue
        held, start, place = [], 0, 0
        for k, word in enumerate(words):
            place = piece.index(word, place)
            pair = f"{words[k - 1].lower()} {word.lower()}" if k else ""
            if held and (len(held) == 24 or xxhash.xxh32(pair).intdigest() % 8 == 0):
                out.append((piece[start:place], held))
                held, start = [], place
            held.append(word.lower())
            place += len(word)
        out.append((piece[start:], held))
    return out


def plain(docs):
    """{id: text} with the sentences of all but the first occurrence of every run removed."""
    first, out = set(), {}
    for i, text in sorted(docs.items()):
        pieces = cut_up(text)
        found = []
        for a in range(len(pieces)):
            words = [pieces[a][1]]
            for b in range(a + 1, len(pieces)):
                words.append(pieces[b][1])
                if sum(map(len, words)) >= 25:
                    found.append((a, b, tuple(map(tuple, words))))
                    break
        gone, mine = set(), set()
        for a, b, key in found:
            if key in first or key in mine:
                gone |= set(range(a, b + 1))
            mine.add(key)
        first |= mine
        out[i] = "".join(piece for k, (piece, _) in enumerate(pieces) if k not in gone) if pieces else text
    return out


def test_sentences_are_the_whole_text():
    text = "  One two. Three\n\n" + "word " * 60 + "end! Four?no. \n \nFive"
    starts, words = spans.sentences(text)
    assert starts[0] == 0 and starts == sorted(set(starts))
    ends = [*starts[1:], len(text)]
    assert [text[a:b].lower().split() for a, b in zip(starts, ends)] == words
    assert max(map(len, words)) <= spans.PIECE_WORDS
    assert [w for _, w in cut_up(text)] == words


def test_query_against_loops(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_sentence_span_dedup"](spark, sf).collect()
    wanted = plain(docs)
    assert {r["doc_id"]: r["text"] for r in rows} == wanted and len(rows) == len(docs)
    for r in rows:
        assert r["words_removed"] == len(docs[r["doc_id"]].split()) - len(r["text"].split())
        assert (r["n_removed"] > 0) == (r["text"] != docs[r["doc_id"]])


def test_shared_passage_goes_from_all_but_the_first(spark):
    passage = " ".join(f"Sentence {i} of the passage has some words." for i in range(8))
    texts = [f"Own start {i} here.\n{passage}\nOwn end {i} there." for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in spans.deduplicated(docs).collect()}
    assert got[0] == texts[0]
    kept = [got[i] for i in range(1, 5)]
    assert all(k.startswith(f"Own start {i} here.\n") and k.endswith(f"Own end {i} there.") for i, k in enumerate(kept, 1))
    assert all(len(k.split()) <= 8 + 16 for k in kept)


def test_passages_without_stops_are_cut_alike(spark):
    """Sixty words without a full stop, after any number of other words on the same line."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    caught = 0
    texts = []
    for i in range(60):
        passage = " ".join(word() for _ in range(60))
        texts += [" ".join([*(word() for _ in range(rng.randrange(30))), passage, *(word() for _ in range(rng.randrange(30)))]) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in spans.deduplicated(docs).collect()}
    assert all(rows[i]["words_removed"] == 0 for i in range(0, 120, 2))
    caught = sum(rows[i]["words_removed"] > 25 for i in range(1, 120, 2))
    assert caught >= 57 and all(rows[i]["words_removed"] <= 60 for i in range(1, 120, 2))


def test_rows_that_share_an_id_keep_their_own_text(spark):
    passage = " ".join(f"Sentence {i} of the passage has some words." for i in range(8))
    other = " ".join(f"Another text {i} says that nothing is repeated." for i in range(8))
    docs = spark.createDataFrame([(1, passage), (2, passage), (2, other), (2, other), (3, other)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"], r["text"]) for r in spans.deduplicated(docs).collect())
    assert [g[1] > 0 for g in got] == [False, False, False, True, True]
    assert [g[2] for g in got[1:3]] == [other, other] and len(got[3][2].split()) < 20


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = spans.deduplicated(docs).collect()
    assert len(rows) == docs.count()
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["text"] for r in rows}
    assert got[1] == given[1] and got[3] is None and got[4] == "" and got[7] == "one"
    assert len({(r["text"], r["n_removed"]) for r in rows if r["doc_id"] == 2}) == 1
    assert {r["n_removed"] for r in rows if r["doc_id"] is None} == {0}


def test_no_documents(spark):
    assert spans.deduplicated(no_documents(spark)).collect() == []
