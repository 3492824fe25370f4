"""Each method against a brute-force version or the library it must equal."""

import itertools
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import chat_roles, decontamination, near_dedup, queries, substring_dedup, topk, toxicity, warc_index
from tidemark.llm.common import prepare
from tidemark.llm.sentence_pieces import PieceModel, character_map
from tidemark.llm.token_counts import CountingTransducer

SMALL = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  ", "\n\n a", "it's 'tis  we'll I'd 've'r", "a<|endoftext|>b  <|endoftext|>  ", "'", "x'", "x 'r", "'rx 'vx'l", "日本語 テキスト １２３ ½5 ½x",
    "a" * 300, "　　x\t\ty", "▁ ▁a  b▁", "\0a\0", " lead", "trail ", "é́ñ🙂🙂🙂 ..!!'s", "  \r\n  \r\nfoo(){\r\n}", "don't-stop't x_y _z 5'5 a'll'd", "Привет мир abcПривет",
]


def texts(n=300):
    rng = random.Random(5)
    bits = ["the", "ouble", " ", "  ", "\n", "'s", "'ll", ",", "123", "é", "ß", "🙂", "\t", "-", "ing", "▁", "<|endoftext|>", "ж", "!!", "\r\n", "'", "　"]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_transducer_counts_like_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts(), add_special_tokens=False)]
    machine = CountingTransducer(path)
    assert [machine.count(t) for t in texts()] == want
    for size in (1, 2, 3, 7, 20):  # any cut into chunks gives the same
        maps = [[machine.chunk_map(t[i : i + size]) for i in range(0, len(t), size)] for t in texts() if "<" not in t]
        assert [machine.scan(m) for m in maps if m] == [w for t, w in zip(texts(), want) if t and "<" not in t]


def test_chunk_maps_compose_associatively():
    machine = CountingTransducer(public_tokenizers.path("byte_bpe_50k.json"))
    t = "ab cd'll  ef\n\n gh"
    for i, j in itertools.combinations(range(1, len(t)), 2):
        a, b, c = (machine.chunk_map(x) for x in (t[:i], t[i:j], t[j:]))
        one, two = machine.compose(machine.compose(a, b), c), machine.compose(a, machine.compose(b, c))
        assert machine.scan([one]) == machine.scan([two]) == machine.count(t)


def test_pieces_like_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), PieceModel(path)
    for t in texts():
        ids, ends = model.encode(t)
        want = library.encode(t, return_type="proto").pieces if t else []
        assert ids.tolist() == [p.id for p in want] and ends.tolist() == [p.end for p in want]
        assert model.decode(ids.tolist()) == library.decode(ids.tolist())


def test_character_map_and_alignment():
    model = PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    model.map, model.longest = {"ﬁ": "fi", "é": "e", "é": "e", "­": ""}, 2
    text = "ﬁne café a­b é"
    normal, sizes = model.normalise(text)
    assert normal == "fine cafe ab e" and sum(sizes) == len(text.encode())
    ids, ends = model.encode(text)
    assert model.decode(ids.tolist()) == normal and ends[-1] == len(text.encode()) and (np.diff(ends) >= 0).all()
    assert character_map(b"") == {}


def test_real_character_map_like_the_library(tmp_path):
    """The vocabulary with a compiled character map of the library in place of its own empty one."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    rules = proto.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=False).serialized_model_proto())
    changed = proto.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        changed.ParseFromString(f.read())
    changed.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(changed.SerializeToString())
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), PieceModel(path)
    assert len(model.map) > 1000
    for t in [*texts(150), "ﬁne ①② ㍿ ｱｲｳ ﾊﾟ Å Å ½ … ™ ﷺ", "ẛ̣ é e\u0301 a\u00adb\u200bc", "ﾊﾟﾊﾟ" * 50]:
        ids, ends = model.encode(t)
        assert ids.tolist() == library.encode(t)
        assert not len(ends) or ((np.diff(ends) >= 0).all() and ends[-1] == len(t.encode()))


def test_long_units_by_heap_like_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), PieceModel(path)
    rng = random.Random(11)
    for n in (63, 64, 65, 200, 3000):
        for letters in ("abcdefghijklmnop", "ae", "日本語文章長", "ABab01+/"):
            t = "".join(rng.choice(letters) for _ in range(n))
            assert model.encode(t)[0].tolist() == library.encode(t)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(300_000))
    begun = time.perf_counter()
    assert model.encode(long)[0].tolist() == library.encode(long)
    assert time.perf_counter() - begun < 60


def test_repair_is_cheapest_and_stretches_agree(spark):
    roles = [*chat_roles.ROLES, None]
    for n in range(5):
        for given in itertools.product(roles, repeat=n):
            chosen, state = chat_roles.repair(list(given), 0, chat_roles.CLOSING)
            cost = sum(s[2] for s in chosen) + chat_roles.CLOSING[state]
            best = min(
                (sum(s[2] for s in path) + chat_roles.CLOSING[path[-1][1] if path else 0]
                 for path in itertools.product(*[chat_roles.STEPS[r] for r in given])
                 if all(a[1] == b[0] for a, b in zip(path, path[1:])) and (not path or path[0][0] == 0)),
            )
            assert cost == best
        if n == 3:
            break
    # one conversation over all partitions gives what one stretch gives
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "system", "tool"]), f"t{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted(chat_roles.repaired_turns(df).collect(), key=lambda r: (r["stretch"], r["place"]))
    chosen, state = chat_roles.repair([chat_roles._known(r[2]) for r in rows], 0, chat_roles.CLOSING)
    assert sum(r["cost"] for r in out) == sum(s[2] for s in chosen) + chat_roles.CLOSING[state]
    assert len({r["stretch"] for r in out}) > 1
    kept = [r for r in out if r["action"] != "insert"]
    assert [r["role"] for r in kept] == [chat_roles.STATES[s[1]] for s in chosen]


def shingle_sets(rows):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    return out


def components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    prepare(spark)
    rng = random.Random(11)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    for i in range(90):  # a crowd of near copies around the threshold
        words = list(base)
        for _ in range(rng.randrange(0, 8)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((100_000 + i, " ".join(words)))
    for i in range(60):  # a passage that many share without being copies
        rows.append((200_000 + i, " ".join(base[:60] + [f"u{rng.randrange(10**6)}" for _ in range(40)])))
    sets = shingle_sets(rows)
    want = components(sets)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_near_pairs_inside_a_crowd_of_one_template(spark):
    """Pages of one template, 0.73 similar and not joined, with pairs of 0.758 among them; a shorter page joins some of a second template."""
    prepare(spark)
    rng = random.Random(12)
    size = 2000
    # one passage for all, own words after it: 400 shared shingles of 474 to 475
    made = [[f"t{i}" for i in range(404)] + [f"u{n}_{i}" for i in range(74)] for n in range(size)]
    for n in range(0, size, 10):  # of its neighbour's own words the first nine as well
        made[n + 1] = made[n][:413] + made[n + 1][413:]
    for n in range(20):  # shares nothing but the second template, where the shorter text is like all the others
        made.append([f"s{i}" for i in range(304)] + [f"x{n}_{i}" for i in range(60)])
    for n in range(40):
        made.append([f"s{i}" for i in range(304)] + [f"y{n}_{i}" for i in range(2 if n == 0 else 60)])
    rows = [(n, " ".join(words)) for n, words in enumerate(made)]
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {r["doc_id"]: r["component_id"] for r in got.collect()}
    want = {n: n - 1 if n < size and n % 10 == 1 else min(n, size) for n in range(len(made))}
    lost = sum(got[n] != want[n] for n in want)
    assert lost == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200 + i, 300) for i in range(5)]
    out = near_dedup.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in out.collect()} == {**{i: 0 for i in range(61)}, **{200 + i: 200 for i in range(5)}, 300: 200}


def test_chunks_survive_insertions_and_passages_are_removed(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(90))
    docs = [(i, " ".join(word() for _ in range(100)) + " " + (passage + " " if i % 2 else "") + " ".join(word() for _ in range(100))) for i in range(40)]
    rows = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    middle = " ".join(passage.split()[30:60])
    assert middle in rows[1]["text"]
    assert all(middle not in rows[i]["text"] and rows[i]["n_repeated"] for i in range(3, 40, 2))
    assert all(rows[i]["text"] == docs[i][1] for i in range(0, 40, 2))
    raw = np.frombuffer(docs[1][1].encode(), np.uint8)
    h = np.uint32(0)
    slow = []
    for b in raw.tolist():
        h = np.uint32((int(h) * 2 + (int(substring_dedup._GEAR[b]) << 16)) & 0xFFFFFFFF)
        slow.append(int(h) >> 16)
    assert substring_dedup.gear_hashes(raw).tolist() == slow
    ends = substring_dedup.chunk_ends(np.frombuffer("ß".encode() * 3000, np.uint8), 5)
    assert ends[-1] == 6000 and (ends % 2 == 0).all() and np.diff(ends, prepend=0).max() <= substring_dedup.LONGEST


def test_masks_tolerate_two_substitutions(spark):
    span = decontamination.SPAN
    for gone in itertools.combinations(range(13), 2):
        assert any(all(m[i] == "0" or at + i not in gone for i in range(span)) for m in decontamination.MASKS for at in range(14 - span))
    words = [f"t{i}" for i in range(13)]
    docs = []
    for n, gone in enumerate(itertools.combinations(range(13), 2)):
        docs.append((n, "lead in " + " ".join("zz" if i in gone else w for i, w in enumerate(words)) + " and out"))
    docs.append((1000, " ".join("zz" if i in (1, 5, 9) else w for i, w in enumerate(words))))
    out = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string"))
    assert {(r["doc_id"], r["matched"]) for r in out.collect()} == {(n, 11) for n in range(len(docs) - 1)}


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_top_products_equal_brute_force(spark, spread):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 16)) * np.exp(rng.normal(size=(700, 1)) * spread) / 4
    v[100:140] = v[0] + rng.normal(size=(40, 16)) * 1e-3  # close neighbours: coordinates prune
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_products(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    z = np.floor(64 * v).astype(np.int64)
    for q in range(0, 700, 20):
        s = z @ z[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        assert sorted(got[q]) == [(n + 1, i, s[i]) for n, i in enumerate(order)]


def test_top_products_over_many_small_files(spark):
    """Files are packed by their bytes, so a bucket that runs over a border is not in the order of length."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4000, 16)) * np.exp(rng.normal(size=(4000, 1)) * 3.0) / 4
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = topk.top_products(df, F.col("id") % 20 == 0).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    z = np.floor(64 * v).astype(np.int64)
    lost = 0
    for q in range(0, 4000, 20):
        s = z @ z[q]
        order = [i for i in np.lexsort((np.arange(4000), -s)) if i != q][:20]
        lost += len({(n + 1, i, s[i]) for n, i in enumerate(order)} - set(got.get(q, [])))
    assert lost == 0 and len(out) == 200 * 20


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((500, 30)) < 0.2, rng.random((500, 30)), 0)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    postings, bounds = {}, [([], []) for _ in range(30)]
    for i, t in zip(*np.nonzero(dense)):
        at, ws = postings.setdefault((int(t), int(i) // toxicity.BLOCK), ([], []))
        at.append(i % toxicity.BLOCK)
        ws.append(dense[i, t])
    for (t, b), (_, ws) in postings.items():
        bounds[t][0].append(b)
        bounds[t][1].append(max(ws))
    model = toxicity.ToxicityModel(
        {}, np.ones(30), 0.1, np.arange(500), rng.random(500) < 0.5, (1.0, 1.0), 8, tuple((np.array(b, int), np.array(w)) for b, w in bounds),
        {k: (np.array(a), np.array(w)) for k, (a, w) in postings.items()}, 15, 4.0, 0.1,
    )
    for q in dense[:60]:
        at, cos = model.search({int(t): float(q[t]) for t in np.flatnonzero(q)})
        s = np.round(dense @ q, 9)
        assert np.allclose(cos, np.sort(s)[::-1][:15], atol=1e-8) and np.allclose(s[at], cos, atol=1e-8)


def test_held_out_quality(spark):
    """On the rows that the contract holds out."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    made = queries.op4_language_id(spark, folder).join(docs, "doc_id").filter("held_out")
    right = made.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97
    folder = "/root/testdata/sf0.1"  # smaller tables have a handful of toxic rows to learn from
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    made = queries.op10_toxicity(spark, folder).join(labels, "doc_id").filter("held_out")
    rows = made.select("toxic", "predicted").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hit >= 0.85 * sum(r["toxic"] for r in rows) and sum(not r["toxic"] and r["predicted"] for r in rows) <= 0.03 * len(rows)


def test_index_blocks_and_directory(spark, monkeypatch):
    from tidemark.session import shared_folder

    rows = [(i, f"http://h{i % 7}.example.org/p{i % 50}") for i in range(600)]
    pages = spark.createDataFrame([(i, u, "x" * (i % 5)) for i, u in rows], "page_id long, url string, html string")
    folder = shared_folder(spark) + "/warc-test"
    captures = warc_index.write_archives(warc_index.revisits(pages), folder)
    parts = warc_index.write_index(captures, folder)
    keys = spark.createDataFrame([("http://h3.example.org/p3",), ("http://h3.example.org/p3",), ("http://nowhere.org/",)], "url string")
    found = warc_index.fetch(warc_index.lookup(keys.select(warc_index.url_key(F.col("url")).alias("key")), parts, folder), folder).collect()
    assert sorted(r["page_id"] for r in found) == [i for i, u in rows if u == "http://h3.example.org/p3"]
    assert [p.first for p in parts] == sorted(p.first for p in parts)


def test_pipeline_stages_by_brute_force(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    made = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SMALL).cache()
        made[name] = (docs.select("doc_id", "text").collect(), out.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(out.columns) == sorted(columns)
        docs = out
    before, after = made["near duplicates"]
    want = components(shingle_sets([tuple(r) for r in before]))
    assert {r["doc_id"] for r in after} == {i for i, c in want.items() if i == c}
    before, after = made["sentence pieces"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = dict(tuple(r) for r in before)
    assert all(r["ids"] == library.encode(text[r["doc_id"]]) and r["round_trip"] for r in after) and len(after) == len(text)
