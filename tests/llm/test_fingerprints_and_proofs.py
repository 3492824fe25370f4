"""I-Match fingerprints, the Merkle manifest and periodic runs against plain Python, with their edge cases."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import imatch, merkle, periodic_runs, queries
from tidemark.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place int, tree string, _range int"


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, lang, s, n, "x", 1, "y", 2) for i, t, lang, s, n in rows], DOCS)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# -- I-Match ------------------------------------------------------------------------------------


@pytest.fixture
def prose():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    out = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 90))), "en", "s", 3) for i in range(60)]
    out += [(60, None, None, None, None), (61, "", "en", "s", 0), (62, " .,\n", "en", "s", 4), (63, "é🙂ü " * 7, "fr", "s", 28), (64, "wort " * 30_000, "de", "s", 5)]
    return [*out, (100, out[3][1], "en", "t", 3), (-7, out[3][1], "en", "t", 3)]


def test_fingerprints_equal_the_sql(spark, prose):
    df = frame(spark, prose)
    got = {r["doc_id"]: r for r in imatch.edited_likeness(df).collect()}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in prose])
    cursor = duck.execute(imatch.SQL)
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, row)) for row in cursor.fetchall()]
    assert len(want) == len(got) == len(prose)
    for row in want:
        for k, v in row.items():
            assert got[row["doc_id"]][k] == (pytest.approx(v) if isinstance(v, float) else v)
    assert got[100]["fingerprint"] == got[-7]["fingerprint"] == got[3]["fingerprint"]
    assert got[60]["fingerprint"] == got[61]["fingerprint"] and got[60]["n_chars"] == 0


def test_edited_text_is_made_of_both_halves(spark, prose):
    got = {r["doc_id"]: r["edited_sha256"] for r in imatch.edited_likeness(frame(spark, prose)).collect()}
    order = sorted(((i, t or "") for i, t, *_ in prose), reverse=True)
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        half = len(t) // 2
        assert got[i] == h(t[: len(t) - half] + after[:half])


@pytest.mark.parametrize("rows", [1, 7])
def test_next_row_over_many_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(imatch, "BUCKET_ROWS", rows)
    rng = random.Random(rows)
    keys = rng.sample(range(-500, 500), 70)
    df = spark.createDataFrame([(k, f"t{k}") for k in keys] + [(None, "a"), (None, "a"), (None, "b")], "k long, t string")
    got = imatch.with_next(df, "k", {"t": "after"}).collect()
    order = sorted(keys, reverse=True)
    want = {k: f"t{n}" for k, n in zip(order, [*order[1:], order[0]])}
    assert {r["k"]: r["after"] for r in got if r["k"] is not None} == want
    assert sorted(r["t"] for r in got if r["k"] is None) == ["a", "a", "b"] and all(r["after"] is None for r in got if r["k"] is None)


def test_shared_ids_null_ids_and_few_rows(spark):
    rows = [(5, "b b", None, None, 1), (5, "a a", None, None, 1), (5, "a a", None, None, 1), (2, "c c", None, None, 1), (None, "d d", None, None, 1)]
    got = imatch.edited_likeness(frame(spark, rows)).collect()
    assert sorted(r["edited_sha256"] or "" for r in got) == sorted(["", h("a a"), h("a b"), h("b c"), h("c a")])
    assert imatch.edited_likeness(frame(spark, rows).filter("false")).collect() == []
    alone = imatch.edited_likeness(frame(spark, rows[:1])).collect()[0]
    assert alone["edited_sha256"] == h("b b") and alone["near_edited"] == alone["near_next"] == 1.0


def test_likeness_tells_edited_from_other_texts(spark):
    rows = [(r["near_edited"], r["near_next"]) for r in queries.op11_imatch(spark, "/root/testdata/sf0.001").collect()]
    assert np.mean([a > b for a, b in rows]) > 0.9 and all(0 <= x <= 1 for r in rows for x in r)


# -- Merkle -------------------------------------------------------------------------------------


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_proof(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out += [x for k, x in enumerate(level[run : run + 3], run) if k != i]
        i //= 3
    return out


def test_manifest_like_a_plain_tree(spark):
    sizes = {None: 1, "": 3, "a": 2, "b": 100, "ä": 730, "c": 9, "d": 10}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i * 7 % 1009, f"a\nb{i}" if i % 3 else (None if i % 2 else "x"), "en" if i % 5 else None, source, i if i % 4 else None))
            i += 1
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for d, text, lang, source, n in rows:
        groups.setdefault(source, []).append((d, h(*map(part, (d, source, lang, n, text))), h(*map(part, (d, source, lang, n, text and text.replace("\n", ""))))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[1] for x in sorted(groups[s])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    made = merkle.document_manifest(frame(spark, rows))
    got = {r["doc_id"]: r for r in made.collect()}
    assert len(got) == len(rows)
    for k, s in enumerate(names):
        for place, (d, own, other) in enumerate(sorted(groups[s])):
            r = got[d]
            assert (r["leaf"], r["subroot"], r["root"]) == (own, trees[s][-1][0], top[-1][0])
            assert r["proof_sha256"] == h(*plain_proof(trees[s], place), *plain_proof(top, k))
            changed = zlib.crc32(str(d).encode()) % 2 == 0 and other != own
            assert r["verified"] is (not changed) and (r["folded_root"] == r["root"]) is (not changed)


def test_butterfly_over_trees_of_any_size(spark):
    levels = {n: plain_tree([h(str(n), str(k)) for k in range(n)]) for n in (1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 55, 100)}
    nodes = [(f"t{n}", k, n, x) for n, tree in levels.items() for k, x in enumerate(tree[0])]
    got = merkle.butterfly(spark.createDataFrame(nodes, "tree string, node long, size long, digest string")).collect()
    assert len(got) == len(nodes)
    for r in got:
        tree = levels[int(r["tree"][1:])]
        assert r["root"] == tree[-1][0] and sum((s["others"] for s in r["path"]), []) == plain_proof(tree, r["node"])


def test_manifest_of_repeated_null_and_no_rows(spark):
    rows = [(1, "a", None, "s", 1), (1, "a", None, "s", 1), (None, "b", None, "s", 1), (None, None, None, None, None)]
    got = merkle.document_manifest(frame(spark, rows)).collect()
    assert len(got) == 4 and len({r["root"] for r in got}) == 1
    assert [r["verified"] for r in got] == [True] * 4
    assert merkle.document_manifest(frame(spark, rows).filter("false")).collect() == []
    one = merkle.document_manifest(frame(spark, rows[:1])).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == h("")


# -- Periodic runs ------------------------------------------------------------------------------


def plain_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length, part = j + q - i, w[i : j + q]
            smaller = any(all(part[t] == part[t + r] for t in range(length - r)) for r in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_like_every_lag_at_every_place():
    rng = random.Random(1)
    for _ in range(1500):
        k = rng.choice([1, 2, 2, 3, 4, 8])
        w = [rng.randrange(k) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            block = [rng.randrange(k) for _ in range(rng.randrange(1, 9))]
            w += (block * 12)[: rng.randrange(4 * len(block), 8 * len(block))] + [rng.randrange(k + 5) for _ in range(rng.randrange(5))]
        assert periodic_runs.runs(np.array(w, np.int64)) == plain_runs(w)


def test_segments_split_until_nothing_is_rare():
    w = [int(c) for c in "111192222911113333922223"]
    for low, high in periodic_runs.segments(np.array(w)):
        assert min(w[low:high].count(x) for x in set(w[low:high])) >= 4
    assert periodic_runs.segments(np.array([1, 2, 3, 1, 2, 3, 1, 2, 3])) == []


def test_long_texts_take_seconds():
    for w in (np.zeros(200_000, np.int64), np.tile(np.arange(40_000), 5), np.random.default_rng(0).integers(0, 2, 100_000)):
        found = periodic_runs.runs(w)
        assert found and all((w[s : s + n - p] == w[s + p : s + n]).all() for s, n, p in found)


def test_detect_and_query_columns(spark, tmp_path):
    rows = [
        (10, None, 0), (11, "", 0), (12, " \n\x0b", 0), (13, "a b a b a b a b c", 1), (13, "a b a b a b a b c", 1), (None, "x x x x x x", 2), (14, "wort " * 30_000, 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {}
    for r in periodic_runs.detect(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert [got[i][0]["n_words"] for i in (10, 11, 12)] == [0, 0, 0] and got[10][0]["kept"] == ""
    assert len(got[13]) == 2 and got[13][0]["kept"] == "a b c" and [tuple(x) for x in got[13][0]["runs"]] == [(0, 8, 2)]
    assert got[None][0]["kept"] == "x" and got[14][0]["kept"] == "wort"
    assert periodic_runs.detect(df.filter("false")).collect() == []

    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"]) or ""
        words = periodic_runs.WORD.findall(text.encode())
        words = words if r["doc_id"] is None else periodic_runs.repeated(words, r["doc_id"])
        found = plain_runs(words) if len(words) < 100 else periodic_runs.runs(periodic_runs.numbers(words))
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if found else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == h("".join(f"{s},{n},{p}\n" for s, n, p in found))
        keep = set(range(len(words))) - {i for s, n, p in found for i in range(s + p, s + n)}
        assert r["collapsed_sha256"] == h(" ".join(words[i].decode() for i in sorted(keep)))


def test_repeated_words_are_planted_by_the_rule():
    words = [str(i).encode() for i in range(50)]
    key = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    g = zlib.crc32(str(key).encode()) // 10
    a = g % 50
    p = 1 + (50 - a) // (3 + g % 8)
    assert periodic_runs.repeated(words, key) == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
    assert periodic_runs.repeated(words, next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10)) == words
