"""Near-duplicate detection by a MinHash LSH forest.

Texts with equal shingle sets are one class and are represented by its smallest id.  A representative has
one signature per tree of the forest; each tree is the table of representatives in the order of
their signatures.  Candidates are neighbours in that order with a long enough common prefix.
The depth adapts to the region: where few stand under a prefix all of them are compared, where many
do, the prefix is lengthened until few remain, and at full length each one is compared with its
neighbours and with the first of its run.

Two passes keep large groups of near copies cheap.  The first takes a few trees and only leaders and
next neighbours, and joins what its confirmed links connect.  The second takes all trees
and skips pairs that are joined already, so groups of thousands are not compared pair by pair.
All links are confirmed on the full shingle sets.

A lengthened prefix separates true neighbours, so texts that stood in a region that had to be lengthened are compared
once more without signatures.  Two of them that share a shingle few of them hold are found by it.  Two that share none of
those have in common just what their sets of frequent shingles have in common, so there only distinct sets of frequent
shingles are compared, and the shortest text of each stands for the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import arrow_map, carried, documents, stage

WORDS = 5
TREES = 40
DEPTH = 8  # minhash values in a tree's signature, one byte each
SHALLOW = 4  # shortest common prefix of candidates
FEW = 16  # a region is compared wholly if each of its nodes meets at most so many others that are not joined to it, on average
FIRST_TREES = 6
# Of all TREES x DEPTH values, so many are equal in any pair worth confirming: a similarity of 0.75 gives 240
# equal ones on average, and fewer than 197 about once in fifty million pairs.
EQUAL_FLOOR = 197
MARKS = 1 << 23
OFTEN_MARKS = 1 << 23
LEVELS = 12  # of frequency, each four times the one before
OFTEN = 32  # in crowded regions, shingles in more texts than that are compared as sets
SALTS = 32

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)[:, None]
_POWERS = np.cumprod(np.full(WORDS, 0x9E3779B97F4A7C15, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """The sorted 64-bit hashes of a text's set of five-word shingles."""
    words = text.encode().lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < WORDS:
        return _mix((h * _POWERS[:n]).sum(keepdims=True) + np.uint64(n))
    total = np.zeros(n - WORDS + 1, np.uint64)
    for k in range(WORDS):
        total += h[k : n - WORDS + 1 + k] * _POWERS[k]
    return np.unique(_mix(total))


def signature(found: np.ndarray) -> np.ndarray:
    """One byte of each minhash value."""
    x = (found >> np.uint64(32)).astype(np.uint32)[None, :]
    low = np.full((TREES * DEPTH, 1), 0xFFFFFFFF, np.uint32)
    for i in range(0, x.shape[1], 1024):
        np.minimum(low, (x[:, i : i + 1024] * _A + _B).min(axis=1, keepdims=True), out=low)
    return ((low[:, 0] * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def _sign(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, digests, keys = [], [], []
    for text in batch.column("text").to_pylist():
        found = shingles(text)
        sizes.append(len(found))
        if len(found):
            s = signature(found)
            digests.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
            keys.append(s.view(">i8").astype(np.int64))
        else:
            digests.append(None)
            keys.append(np.empty(0, np.int64))
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
    more = [n for n in batch.schema.names if n not in ("doc_id", "text")]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
         pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys))), *map(batch.column, more)],
        ["doc_id", "n_shingles", "digest", "keys", *more],
    )


def _common_bytes(keys: np.ndarray) -> np.ndarray:
    """Leading equal bytes of each key and the one before it; -1 for the first."""
    x = (keys[1:] ^ keys[:-1]).view(np.uint64)
    out = np.full(len(keys), -1)
    out[1:] = DEPTH
    for d in range(DEPTH):
        out[1:][(out[1:] == DEPTH) & ((x >> np.uint64(56 - 8 * d)) & np.uint64(255) != 0)] = d
    return out


def _mostly_joined(rows: np.ndarray, run: np.ndarray, group: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Of the runs that ``rows`` make up, those with few pairs in different groups: their rows by group, small groups first."""
    if not len(rows):
        return
    for own in np.split(rows, np.flatnonzero(np.diff(run[rows])) + 1):
        order = own[np.argsort(group[own], kind="stable")]
        parts = np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
        n = len(own)
        if n * n - sum(len(p) ** 2 for p in parts) <= FEW * n:
            yield sorted(parts, key=len)


def _neighbours(joined_already: bool):
    """Candidate pairs from one stretch of the sorted forest (tree, key, node, group).

    With ``joined_already`` also a row without ``b`` for every node whose region had to be lengthened."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        tree, key, node, group = (
            np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]) for c in ("tree", "key", "node", "group")
        )
        n = len(node)
        common = _common_bytes(key)
        common[1:][tree[1:] != tree[:-1]] = -1
        left, right = [], []

        def offer(i: np.ndarray, j: np.ndarray) -> None:
            other = group[i] != group[j]
            left.append(np.minimum(node[i], node[j])[other])
            right.append(np.maximum(node[i], node[j])[other])

        everyone = np.arange(n)
        close = everyone[common >= SHALLOW]
        offer(close - 1, close)
        active, crowded = np.ones(n, bool), np.empty(0, np.int64)
        for depth in range(SHALLOW, DEPTH + 1):
            run = np.cumsum(common < depth)
            size = np.bincount(run)[run]
            if joined_already:
                small = active & (size <= FEW) & (size > 1)
                rows = np.flatnonzero(small)
                for off in range(2, min(FEW, n)):
                    i = rows[rows + off < n]
                    i = i[run[i] == run[i + off]]
                    if not len(i):
                        break
                    offer(i, i + off)
                active &= size > FEW
                for rows in _mostly_joined(np.flatnonzero(active), run, group):
                    active[np.concatenate(rows)] = False
                    for k, own in enumerate(rows[:-1]):
                        rest = np.concatenate(rows[k + 1 :])
                        offer(np.repeat(own, len(rest)), np.tile(rest, len(own)))
                if depth == SHALLOW:
                    crowded = np.unique(node[active])
            if depth == (DEPTH if joined_already else SHALLOW):
                heads = np.flatnonzero(common < depth)
                rows = everyone[active & (size > 1)]
                offer(heads[run[rows] - run[0]], rows)
                break
        pairs = np.stack([np.concatenate(left), np.concatenate(right)])
        pairs = np.unique(pairs, axis=1) if pairs.shape[1] else pairs
        for i in range(0, pairs.shape[1], 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0, i : i + 100_000]), pa.array(pairs[1, i : i + 100_000])], ["a", "b"])
        for i in range(0, len(crowded), 100_000):
            part = crowded[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.int64())], ["a", "b"])

    return work


def _candidates(nodes: DataFrame, trees: int, joined_already: bool) -> DataFrame:
    """``nodes``: node, keys, group.  Pairs (a < b) of nodes in different groups."""
    spark = nodes.sparkSession
    rows = nodes.count() * trees
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 500_000 + 1)
    forest = nodes.select("node", "group", F.posexplode(F.slice("keys", 1, trees)).alias("tree", "key"))
    placed = forest.repartitionByRange(width, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    return (
        placed.select("tree", "key", "node", "group").mapInArrow(_neighbours(joined_already), "a long, b long").distinct()
    )


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures do not rule it out."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two = (
            batch.column(c).flatten().to_numpy().view(np.uint8).reshape(-1, TREES * DEPTH) for c in ("keys_a", "keys_b")
        )
        keep = pa.array((one == two).sum(1) >= EQUAL_FLOOR)
        return pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("keys").alias(f"keys_{name}"), F.col("n_shingles").alias(f"n_{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        (100 * F.least("n_a", "n_b") >= 75 * F.greatest("n_a", "n_b"))
    )
    return arrow_map(both.select("a", "b", "keys_a", "keys_b"), work, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs that are similar on their full sets.  ``texts``: node, text."""
    involved = stage(pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct(), "involved")
    return _similar(pairs, _sets(involved, texts))


def _bitmap(rows: DataFrame, key: Column, size: int) -> np.ndarray:
    """The marks ``key`` modulo ``size`` that occur in ``rows``, as bits: of fixed size, gathered in parts of 4 kB."""
    mark = F.pmod(key, F.lit(size)) + 1
    bits = np.zeros(size // 8 + 4096, np.uint8)
    marked = rows.select(mark.alias("m")).groupBy(F.bitmap_bucket_number("m").alias("bucket"))
    for r in marked.agg(F.bitmap_construct_agg(F.bitmap_bit_position("m")).alias("bits")).collect():
        at = (r["bucket"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _levels(counts: DataFrame) -> list[np.ndarray]:
    """Bitmaps of the marks of h with a count above OFTEN, and above four times as much, and so on: LEVELS of a fixed size."""
    level = F.least(F.floor(F.log2(F.col("count") / OFTEN) / 2).cast("int"), F.lit(LEVELS - 1))
    mark = F.pmod(F.xxhash64("h"), F.lit(OFTEN_MARKS)) + 1
    each = counts.select(mark.alias("m"), F.explode(F.sequence(F.lit(0), level)).alias("level"))
    bits = [np.zeros(OFTEN_MARKS // 8 + 4096, np.uint8) for _ in range(LEVELS)]
    parts = each.groupBy("level", F.bitmap_bucket_number("m").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("m")).alias("bits"))
    for r in parts.collect():
        at = (r["bucket"] - 1) * 4096
        bits[r["level"]][at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _sets(involved: DataFrame, texts: DataFrame) -> DataFrame:
    """node, shingles of the texts whose node is in ``involved``."""
    # which texts are needed, as a bitmap of fixed size: only their sets are made and shuffled.  Ids that share
    # a mark with a needed one are dropped by the join that follows.
    mark = F.pmod(F.xxhash64("node"), F.lit(MARKS))
    bits = _bitmap(involved, F.xxhash64("node"), MARKS)
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def read(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        m = batch.column("mark").to_numpy()
        batch = batch.filter(pa.array((sent.value[m >> 3] >> (m & 7).astype(np.uint8)) & 1 == 1))
        if not batch.num_rows:
            return None
        sets = [shingles(t).view(np.int64) for t in batch.column("text").to_pylist()]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], ["node", "shingles"])

    sets = arrow_map(texts.filter("node is not null").withColumn("mark", mark), read, "node long, shingles array<long>")
    return stage(sets.join(involved.select("node"), "node", "left_semi"), "shingles")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets have the similarity.  ``sets``: node, shingles."""

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for one, two in zip(batch.column("shingles_a"), batch.column("shingles_b")):
            x, y = one.values.to_numpy(), two.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("shingles_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("shingles_b"))
    return arrow_map(pairs.join(one, "a").join(two, "b").select("a", "b", "shingles_a", "shingles_b"), compare, "a long, b long")


def _salted(df: DataFrame, other: DataFrame, on: str, how: str = "inner", condition: Column | None = None) -> DataFrame:
    """A join in which a value of ``on`` may have any number of rows in ``df``; ``other`` is copied ``SALTS`` times."""
    copies = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")  # never gathered on the driver
    dealt = df.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    if condition is None:
        return dealt.join(copies, [on, "salt"], how).drop("salt")
    copies = copies.withColumnsRenamed({on: "_on", "salt": "_salt"})
    return dealt.join(copies, (F.col(on) == F.col("_on")) & (F.col("salt") == F.col("_salt")) & condition, how).drop("salt", "_on", "_salt")


def _met(rare: DataFrame, all_pairs: bool) -> DataFrame:
    """Pairs (a < b) of different groups and fitting sizes that share a shingle of ``rare`` (h, node, group, n).

    At most OFTEN texts hold one.  Pairs are made and tested inside its list, so only those to confirm become rows.
    Without ``all_pairs`` just the ones with the list's smallest text."""
    lists = rare.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("node", "group", "n"))).alias("x")).filter(F.size("x") > 1)

    def partners(one: Column, place: Column) -> Column:
        later = F.slice("x", place + 2, F.lit(OFTEN))
        fits = F.filter(later, lambda two: (two["group"] != one["group"]) & (100 * F.least(one["n"], two["n"]) >= 75 * F.greatest(one["n"], two["n"])))
        return F.transform(fits, lambda two: F.struct(one["node"].alias("a"), two["node"].alias("b")))

    pairs = F.flatten(F.transform("x" if all_pairs else F.slice("x", 1, 1), partners))
    return lists.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b").distinct()


def _joined_groups(links: DataFrame, crowd: DataFrame) -> DataFrame | None:
    """node, component of the groups of ``crowd`` (node, group) that ``links`` (a, b) join; None where there is no link."""
    if links.isEmpty():
        return None
    one = crowd.select(F.col("node").alias("a"), F.col("group").alias("group_a"))
    two = crowd.select(F.col("node").alias("b"), F.col("group").alias("group_b"))
    return components(links.join(one, "a").join(two, "b").select(F.col("group_a").alias("a"), F.col("group_b").alias("b")))


def _crowd_links(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect all similar texts of different groups.  ``crowd``: node, group; ``texts``: node, text.

    With 7 x common >= 3 x (size + size) for a similarity of 0.75, sizes being the only thing that differs among texts of one
    set of frequent shingles, whatever is linked with one of them by that set is linked with the shortest of them.
    """

    sets = stage(
        _sets(crowd, texts).filter(F.size("shingles") > 0).withColumn("kind", F.xxhash64("shingles")).dropDuplicates(["node", "kind"])
        .withColumn("n", F.size("shingles").cast("long")).join(crowd, "node"),
        "crowd-sets",
    )
    counts = sets.select(F.explode("shingles").alias("h")).groupBy("h").count().filter(F.col("count") > OFTEN)
    sent = texts.sparkSession.sparkContext.broadcast(_levels(counts))

    def divide(batch: pa.RecordBatch) -> pa.RecordBatch:
        rare, held = [], []
        for own, marks in zip(batch.column("shingles"), batch.column("marks")):
            h, m = own.values.to_numpy(), marks.values.to_numpy()
            level = sum((bits[m >> 3] >> (m & 7).astype(np.uint8)) & 1 for bits in sent.value)
            rare.append(h[level == 0])
            held.append(h[level > 0][np.lexsort((h[level > 0], level[level > 0]))])
        lists = [
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in part])]), pa.int32()), pa.array(np.concatenate(part)))
            for part in (rare, held)
        ]
        names = ["node", "group", "kind", "n"]
        return pa.RecordBatch.from_arrays([*map(batch.column, names), *lists], [*names, "rare", "held"])

    # ``held`` has the less frequent ones first.  A rare shingle that shares its mark with a frequent one counts as frequent in
    # every text, so both ways below stay exact.
    marks = F.transform("shingles", lambda h: F.pmod(F.xxhash64(h), F.lit(OFTEN_MARKS)))
    divided = stage(
        arrow_map(sets.withColumn("marks", marks), divide, "node long, group long, kind long, n long, rare array<long>, held array<long>"),
        "crowd-divided",
    )

    # By a shingle that few hold.  Rare ones first, the first shingle that two similar texts have in common is among the
    # n - ceil(0.75 n) + 1 first of both, so only those are offered.
    rare = divided.select("node", "group", "n", F.explode("rare").alias("h")).withColumn("held_by", F.count("*").over(Window.partitionBy("h")))
    rare = rare.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("held_by", "h")))
    rare = stage(rare.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1).select("h", "node", "group", "n"), "crowd-rare")
    # every text meets the smallest of its list; what that joins is not compared again
    stars = stage(_similar(_met(rare, all_pairs=False), sets.select("node", "shingles")), "crowd-stars")
    joined = _joined_groups(stars, crowd)
    if joined is not None:
        rare = stage(
            rare.join(joined.select(F.col("node").alias("group"), "component"), "group", "left")
            .withColumn("group", F.coalesce("component", "group")).drop("component"),
            "crowd-rare",
        )
    by_rare = stars.unionByName(_similar(_met(rare, all_pairs=True), sets.select("node", "shingles")))

    # by frequent shingles alone
    members = divided.filter(F.size("held") > 0).select("node", "group", "kind", "n", "held", F.xxhash64("held").alias("held_id"))
    classes = stage(
        members.groupBy("held_id", "held").agg(
            F.min(F.struct("n", "node")).alias("least"), F.min("group").alias("from_group"), F.max("group").alias("to_group")
        ).select("held_id", "held", F.col("least.n").alias("least_n"), F.col("least.node").alias("node"), "from_group", "to_group"),
        "crowd-classes",
    )
    slim = members.select("node", "n", "held_id", F.size("held").alias("common"))
    heads = classes.select("held_id", F.col("node").alias("head"), "least_n")
    inside = _salted(slim, heads, "held_id").filter((7 * F.col("common") >= 3 * (F.col("n") + F.col("least_n"))) & (F.col("node") != F.col("head")))

    # distinct sets meet in a prefix ordered by how few sets hold a shingle
    k = F.size("held")
    reach = (k - F.ceil(F.col("least_n") * 3 / 4) + 1).cast("int")
    prefixes = classes.filter(4 * k >= 3 * F.col("least_n")).select(
        "held_id", "node", "least_n", k.alias("k"), "from_group", "to_group", F.slice("held", F.lit(1), reach).alias("prefix")
    )
    ranked = prefixes.select("held_id", "node", "least_n", "k", "from_group", "to_group", "prefix", F.posexplode("prefix").alias("place", "h"))
    other = ranked.select("h", *[F.col(c).alias(f"{c}_b") for c in ("held_id", "least_n", "k", "from_group", "to_group", "prefix", "place")])
    # two sets meet once, at the first shingle they have in common, and only if enough can follow it
    first = ~F.arrays_overlap(F.slice("prefix", F.lit(1), F.col("place")), F.slice("prefix_b", F.lit(1), F.col("place_b")))
    enough = 7 * F.least(F.col("k") - F.col("place"), F.col("k_b") - F.col("place_b")) >= 3 * (F.col("least_n") + F.col("least_n_b"))
    met = stage(_salted(ranked, other, "h", condition=(
        (F.col("held_id") < F.col("held_id_b")) & (100 * F.least("least_n", "least_n_b") >= 75 * F.greatest("least_n", "least_n_b"))
        & ~((F.col("from_group") == F.col("to_group")) & (F.col("from_group_b") == F.col("to_group_b")) & (F.col("from_group") == F.col("from_group_b")))
        & enough & first
    )).select("held_id", "held_id_b"), "crowd-met")

    def common(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [
            len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True))
            for x, y in zip(batch.column("held"), batch.column("held_b"))
        ]
        names = ["held_id", "head", "least_n", "held_id_b", "head_b", "least_n_b"]
        keep = pa.array(7 * np.array(both) >= 3 * (batch.column("least_n").to_numpy() + batch.column("least_n_b").to_numpy()))
        out = [batch.column(c).filter(keep) for c in names] + [pa.array(both, pa.int64()).filter(keep)]
        return pa.RecordBatch.from_arrays(out, [*names, "common"])

    one = classes.select("held_id", "held", F.col("node").alias("head"), "least_n")
    two = one.select(*[F.col(c).alias(f"{c}_b") for c in one.columns])
    close = stage(
        arrow_map(
            met.join(one, "held_id").join(two, "held_id_b"), common,
            "held_id long, head long, least_n long, held_id_b long, head_b long, least_n_b long, common long",
        ),
        "crowd-close",
    )
    there = close.select(F.col("held_id_b").alias("held_id"), "head", "least_n", F.col("common").alias("shared"))
    back = close.select("held_id", F.col("head_b").alias("head"), F.col("least_n_b").alias("least_n"), F.col("common").alias("shared"))
    across = _salted(slim, there.unionByName(back), "held_id").filter((7 * F.col("shared") >= 3 * (F.col("n") + F.col("least_n"))) & (F.col("node") != F.col("head")))
    stars = [x.select(F.col("node").alias("a"), F.col("head").alias("b")) for x in (inside, across)]
    return by_rare.unionByName(stars[0]).unionByName(stars[1])


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b); a component is named by its smallest node.

    Alternates two contractions until nothing changes: every node's larger neighbours move to its
    smallest neighbour, then every node and its smaller neighbours do.  Each round is written out.
    """
    now = stage(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u > v").distinct(), "edges")
    before = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter("u > v").distinct()
        now = stage(small, "edges")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def near_duplicates(docs: DataFrame, carry: tuple = ()) -> DataFrame:
    """Components of texts whose five-word shingle sets have a similarity of at least 0.75.

    ``docs``: doc_id, text; other columns are ignored.  Returns one row per input row: doc_id,
    n_shingles, component_id (the smallest id reachable over links), kept (it is the row's own id).
    A text with one to four words has its whole word sequence as its one shingle; an empty, blank or
    null text has none and is linked with nothing.  Rows with a null id take no part: their component is
    null and they are kept.  Repeated rows share a component; all rows with the component's id are kept, and an id with several texts links
    what is like any of them.  ``carry``: short columns of ``docs`` that the result keeps, to tell such rows apart.
    """
    base = documents(docs, *carry)
    schema = carried("doc_id long, n_shingles long, digest string, keys array<long>", base, carry)
    signed = stage(arrow_map(base, _sign, schema), "signed")
    known = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # equal sets: partial aggregation leaves one row per class and map task
    nodes = stage(
        known.groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")
        ),
        "classes",
    )
    nodes = nodes.withColumn("group", F.col("node"))

    def links(found: DataFrame) -> DataFrame:
        likely = stage(_likely(found, nodes), "likely")
        named = base.select(F.col("doc_id").alias("node"), "text")
        return stage(_confirmed(likely, named), "links")

    first = links(_candidates(nodes, FIRST_TREES, False))
    groups = components(first)
    grouped = nodes.drop("group").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    offered = stage(_candidates(stage(grouped, "grouped"), TREES, True), "offered")
    links_found = first.unionByName(links(offered.filter("b is not null")))
    found = components(links_found)
    crowd = offered.filter("b is null").select(F.col("a").alias("node"))
    if not crowd.isEmpty():
        crowd = stage(crowd.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("group")), "crowd")
        rest = stage(_crowd_links(crowd, base.select(F.col("doc_id").alias("node"), "text")), "crowd-links")
        found = components(links_found.unionByName(rest))
    named = nodes.select("digest", "node").join(found, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component_id")
    )
    return (
        signed.select("doc_id", "n_shingles", "digest", *carry).join(named, "digest", "left")
        .select(
            "doc_id", "n_shingles", *carry,
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    )


# The same in SQL, comparing every pair of texts that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS g
  FROM w
), x AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM s
  UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen
)
SELECT s.doc_id, len(g) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) ON node = s.doc_id
"""
