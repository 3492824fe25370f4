"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    chat_roles, decontamination, language, near_dedup, sentence_pieces, substring_dedup, token_counts, topk, toxicity, warc_index,
)
from tidemark.llm.common import prepare

DOCS = "doc_id long, text string, lang string, score double, h long, node long, label string, n long"
LONG = "wort " * 30_000
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, LONG, "de"), (5, "one two three four five six seven", "en"),
    (6, "one two three four five six seven", "en"), (6, "one two three four five six seven", "en"), (None, "the cat sat on the mat again", "en"),
    (7, "12345 !!!", "en"), (8, "el perro come en la casa grande", "es"), (9, "x" * 5000, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame([(*r, 1.0, 2, 3, "x", 4) for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def by_id(rows, key="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = by_id(token_counts.token_counts(docs, path).collect())
    assert sum(map(len, rows.values())) == len(ROWS)
    assert (rows[1][0]["n_bytes"], rows[1][0]["n_tokens"], rows[2][0]["n_tokens"]) == (0, 0, 0)
    assert len(rows[6]) == 2 and rows[6][0] == rows[6][1] and rows[4][0]["over_limit"]
    assert token_counts.token_counts(empty, path).collect() == []


def test_sentence_pieces(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = by_id(sentence_pieces.with_spans(sentence_pieces.encode_decode(docs, path)).collect())
    assert sum(map(len, rows.values())) == len(ROWS)
    assert rows[1][0]["ids"] == [] and rows[1][0]["decoded"] == ""
    assert rows[4][0]["decoded"] == LONG and rows[4][0]["ends"][-1] == len(LONG)
    spans = rows[5][0]["spans"]
    assert spans[0]["begin"] == 0 and all(a["end"] == b["begin"] for a, b in zip(spans, spans[1:]))
    assert sentence_pieces.encode_decode(empty, path).collect() == []


def test_language(docs, empty):
    rows = by_id(language.identify(docs, F.lit(False)).collect())
    assert sum(map(len, rows.values())) == len(ROWS)
    for i in (1, 2, 3, 7):
        assert (rows[i][0]["lang_pred"], rows[i][0]["score"], rows[i][0]["rejected"]) == ("und", 0.0, True)
    assert rows[8][0]["lang_pred"] == "es" and all(0 <= r["score"] <= 1 for rs in rows.values() for r in rs)
    assert language.identify(empty, F.lit(False)).collect() == []
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()} == {"und"}


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0, "x"), (5, 1, "x"), (6, 0, "x"), (6, 1, "x"), (8, None, "x"), (99, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels, F.lit(True), least=1, chi=0.0)
    rows = by_id(toxicity.score(docs, model).collect())
    assert sum(map(len, rows.values())) == len(ROWS) and all(0 <= r["score"] <= 1 for rs in rows.values() for r in rs)
    assert rows[1][0]["evidence"] == [] and rows[1][0]["score"] == rows[2][0]["score"]
    none = toxicity.fit(docs, labels.filter("false"), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty, toxicity.fit(empty, labels, F.lit(True))).collect() == []


def test_near_duplicates(docs, empty):
    rows = by_id(near_dedup.near_duplicates(docs).collect())
    assert sum(map(len, rows.values())) == len(ROWS)
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in rows[6]] == [(3, 5, False)] * 2
    for i in (1, 2, 3):
        assert (rows[i][0]["n_shingles"], rows[i][0]["component_id"], rows[i][0]["kept"]) == (0, i, True)
    assert rows[4][0]["n_shingles"] == 1
    assert (rows[None][0]["component_id"], rows[None][0]["kept"]) == (None, True)
    assert near_dedup.near_duplicates(empty).collect() == []


def test_substring_dedup(spark, docs, empty):
    rows = by_id(substring_dedup.remove_repeats(docs).collect())
    assert sum(map(len, rows.values())) == len(ROWS)
    assert (rows[1][0]["n_chunks"], rows[1][0]["text"]) == (0, "")
    assert rows[5][0]["text"] == "one two three four five six seven" == rows[6][0]["text"]  # too short a repeat
    assert len(rows[4][0]["text"]) < len(LONG)
    assert substring_dedup.remove_repeats(empty).collect() == []


def test_decontamination(spark, docs, empty):
    items = [(1, "One two, three four five six"), (2, None), (3, "the cat"), (1, "One two, three four five six"), (None, "cat sat on the mat again")]
    bench = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id long")
    rows = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontamination.overlaps(docs, bench).collect()}
    assert rows == {(5, 1): 6, (6, 1): 6, (None, None): 6}
    assert decontamination.overlaps(empty, bench).collect() == []
    assert decontamination.overlaps(docs, bench.filter("false")).collect() == []


def test_warc(spark, docs):
    big, small = "é" * 600, "tiny"
    pages = [(1, "http://a.b.org/x?y#z", big), (2, "http://a.b.org/x?y#z", big), (3, None, None), (None, "bad url \n", big), (4, "https://u@H.org:80/p", small),
             (5, "https://h.org/p", small), (5, "https://h.org/p", small)]
    df = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, key string, offset long")
    rows = by_id(warc_index.archive_and_read(df).collect(), "page_id")
    assert sum(map(len, rows.values())) == len(pages)
    assert (rows[2][0]["record_type"], rows[1][0]["record_type"], rows[1][0]["refers_to"], rows[None][0]["refers_to"]) == ("response", "revisit", 2, 2)
    assert rows[2][0]["payload"] == big and rows[1][0]["payload"] is None and rows[1][0]["payload_bytes"] == 1200
    assert (rows[3][0]["payload_bytes"], rows[3][0]["payload_digest"]) == (0, "da39a3ee5e6b4b0d3255bfef95601890afd80709")
    assert [r["record_type"] for r in rows[4] + rows[5]] == ["response"] * 3
    assert warc_index.archive_and_read(df.filter("false")).collect() == []
    keys = df.select(warc_index.url_key(F.col("url")).alias("k")).collect()
    assert [k[0] for k in keys][:3] == ["org,b,a)/x?y", "org,b,a)/x?y", ")"] and keys[4][0] == "org,h)/p"


def test_top_products(spark):
    rows = [(20, [1.0, 0.5]), (40, [0.0, -1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
            (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, [0.0]), (8, []), (9, [1e30, 1e30])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows[:-1]], "vec_id long, embedding array<double>, id long, score long")
    out = topk.top_products(df, F.col("id") % 20 == 0, k=3).collect()
    got = {q: [(r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q] for q in (20, 40)}
    assert got[20] == [(1, 1, 6144), (2, 2, 6144), (3, 7, 0)]
    assert got[40] == [(1, 7, 0), (2, 8, 0), (3, 20, -2048)]
    assert topk.top_products(df.filter("false"), F.col("id") % 20 == 0).collect() == []


def test_chat_roles(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", None), (1, 2, "ASSISTANT ", "yo"), (2, 0, "assistant", "lone"), (3, 0, None, "who"), (None, None, "user", "x"),
            (4, 0, "user", "same"), (4, 0, "user", "same")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, place int, action string")
    out = chat_roles.repaired_turns(df).collect()
    made = {c: [(r["role"], r["action"]) for r in sorted(out, key=lambda r: (r["stretch"], r["place"])) if r["conv_id"] == c] for c in (1, 2, 3, 4, None)}
    assert made[1] == [("user", "keep"), ("user", "merge"), ("assistant", "keep")]
    assert made[2] == [("user", "insert"), ("assistant", "keep")]
    assert made[3][0] == ("user", "relabel") and made[3][1] == ("assistant", "insert")
    assert made[4] == [("user", "keep"), ("assistant", "relabel")]  # cheaper than merging and closing
    text = "".join(r["rendered"] for r in sorted((r for r in out if r["conv_id"] == 1), key=lambda r: (r["stretch"], r["place"])))
    assert text == "user:\nhi\n\n\nassistant:\nyo\n"
    assert chat_roles.repaired_turns(df.filter("false")).collect() == []


PIPELINE_DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, row_key string"


def staged(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, None, "s", None, 1, "k") for i, t in rows], PIPELINE_DOCS)


def kept_rows(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_pipeline_near_duplicates_by_row(spark):
    one, two, three = "the first text tells of a cat that sat down", "a second text tells of dogs that ran away at dawn", "quite another one about ships on a wide sea"
    rows = [(3, one), (7, one), (7, two), (9, three), (9, three), (None, one), (4, None), (5, ""), (5, "")]
    got = kept_rows(corpus_pipeline.one_of_each(spark, staged(spark, rows), ""))
    assert got == sorted([(3, one), (7, two), (9, three), (None, one), (4, None), (5, "")], key=repr)
    assert kept_rows(corpus_pipeline.one_of_each(spark, staged(spark, rows).filter("false"), "")) == []


def test_pipeline_leaks_by_row(spark, tmp_path):
    item = "which of these seven rivers flows through the old town and reaches the sea near the port"
    spark.createDataFrame([(1, item, 2)], "item_id long, text string, doc_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so {item} they said"), (None, "clean words without an id"), (2, f"so {item} they said"), (2, "clean words of the same id"), (3, None), (4, "")]
    got = kept_rows(corpus_pipeline.without_leaks(spark, staged(spark, rows), str(tmp_path)))
    assert got == sorted([(None, "clean words without an id"), (2, "clean words of the same id"), (3, None), (4, "")], key=repr)
    assert kept_rows(corpus_pipeline.without_leaks(spark, staged(spark, rows).filter("false"), str(tmp_path))) == []
