"""Sentence pieces of texts without end: the same result, in memory that is a few times the text."""

import hashlib
import tracemalloc

import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece

from tidemark.llm import sentence_pieces
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def words():
    return "\n".join(pq.read_table(f"{FOLDER}/documents.parquet", columns=["text"]).column(0).to_pylist())


def peak(model, text):
    tracemalloc.start()
    try:
        model.encode(text)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_long_text_needs_a_few_times_its_size():
    model, text = sentence_pieces.PieceModel(PATH), words()
    model.encode(text)  # its units are known from here on
    long = text * (4_000_000 // len(text) + 1)
    assert len(long) > sentence_pieces.LONG_TEXT
    assert peak(model, long) < 20 * len(long)


def test_units_taken_some_at_a_time_give_the_same_pieces(monkeypatch):
    model, library = sentence_pieces.PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [words()[:5_000], " \n  ▁ a", "日本 12\n\n é" * 50, "x" * 300, "\n"]
    whole = [[a.tolist() for a in model.encode(t)] for t in texts]
    monkeypatch.setattr(sentence_pieces, "LONG_TEXT", 1)
    monkeypatch.setattr(sentence_pieces, "AT_ONCE", 7)
    for t, (ids, ends) in zip(texts, whole):
        assert [a.tolist() for a in model.encode(t)] == [ids, ends]
        assert ids == library.encode(t) and ends[-1] == len(t.encode())
        assert model.decode(ids) == library.decode(ids)


def test_an_unbroken_run_needs_no_tuple_for_each_join():
    model = sentence_pieces.PieceModel(PATH)
    text = "ab1c" * 75_000
    assert peak(model, text) < 150 * len(text)


def test_digests_of_ids_are_made_without_a_string_for_each_id(spark, tmp_path):
    texts = ["", None, "One two\nthree", words()[:20_000], "5"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = QUERIES["op9_sentence_pieces"](spark, str(tmp_path))
    assert "array<string>" not in made._jdf.queryExecution().optimizedPlan().toString()
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in made.collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and r.spans_cover_text
