"""A Merkle manifest of a table: one tree per group of rows, one tree over the groups, and a proof for every row.

Rows of a group are numbered in order and cut into blocks of FANOUT^HEIGHT leaves.  A block's own subtree is hashed where the block is.
Above that, blocks exchange roots as in a butterfly: before round r, all blocks of a stretch of FANOUT^r blocks know
that stretch's root.  In the round, blocks that stand at the same place of the FANOUT neighbouring stretches meet, each
learns the others' roots, and each hashes the common parent for itself.  So after the last round every block has
all that its rows' proofs need, and nothing has to be sent down the tree again.  A stretch at the end of a group may be
shorter than its neighbours; its blocks then stand in at the missing places.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.llm.common import arrow_map, prepare, stage

FANOUT = 3
HEIGHT = 6
BLOCK = FANOUT**HEIGHT
RANGE_ROWS = 200_000
SALTS = 32
NODE = "array<struct<at:int,others:array<string>>>"


def encoded(column: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' count, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``: the row's number from 0 in its group, in order.

    The rows are dealt by ranges of (group, order), so a group of any size spans many tasks; each range needs to know only how many rows of
    a group stand in the ranges before it.
    """
    spark = rows.sparkSession
    count = rows.count()
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // RANGE_ROWS + 1)
    if count == 0:
        return rows.withColumn("place", F.lit(0).cast("long"))
    dealt = stage(rows.repartitionByRange(width, group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range", group).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_range", group, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order)) - 1
    return (
        dealt.withColumn("_inside", inside).join(sizes, ["_range", group])
        .withColumn("place", F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")
    )


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def subtree(leaves: list[str], whole: bool) -> list[list[str]]:
    """The levels of a block's tree: HEIGHT of them above the leaves, or, where the block is the whole group, up to one node."""
    levels = [leaves]
    while len(levels) <= HEIGHT and not (whole and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([_digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def paths(levels: list[list[str]]) -> list[list[dict]]:
    """For every leaf, level by level: its node's number in its run and the run's other digests."""
    out = []
    for i in range(len(levels[0])):
        steps = []
        for level in levels[:-1]:
            start = i - i % FANOUT
            steps.append({"at": i % FANOUT, "others": level[start:i] + level[i + 1 : start + FANOUT]})
            i //= FANOUT
        out.append(steps)
    return out


def _roots(batch: pa.RecordBatch) -> pa.RecordBatch:
    roots = [
        subtree([m["leaf"] for m in members], size <= BLOCK)[-1][0]
        for members, size in zip(batch.column("members").to_pylist(), batch.column("size").to_pylist())
    ]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots)], [*batch.schema.names, "root"])


def butterfly(nodes: DataFrame) -> DataFrame:
    """``nodes``: tree, node (number from 0), size (nodes of the tree), digest.  Returns tree, node, root and path for each.

    Every round shuffles one slim row per node; a group of a round holds FANOUT rows at most.
    """
    most = nodes.agg(F.max("size")).first()[0] or 1
    now = nodes.select("tree", "node", "size", "digest", F.expr(f"cast(array() as {NODE})").alias("path"))
    span = 1
    while span < most:
        stretch = F.floor(F.col("node") / span)
        digit, low = stretch % FANOUT, F.col("node") % span
        held = F.least(F.lit(span), F.col("size") - stretch * span)  # nodes in the own stretch
        stand_in = (held < span) & (digit > 0)
        places = F.when(stand_in, F.sequence(low, F.lit(span - 1).cast("long"), held)).otherwise(F.array(low))
        active = F.col("size") > span
        sent = now.filter(active).select(
            "tree", "size", F.floor(stretch / FANOUT).alias("run"), F.explode(places).alias("place"),
            F.struct(digit.cast("int").alias("at"), "digest", "node", low.alias("own"), "path").alias("m"),
        )
        # only the stand-ins' own place keeps their path
        sent = sent.withColumn("m", F.when(F.col("m.own") == F.col("place"), F.col("m")).otherwise(
            F.struct("m.at", "m.digest", F.lit(None).cast("long").alias("node"), "m.own", F.lit(None).cast(NODE).alias("path"))
        ))
        met = sent.groupBy("tree", "size", "run", "place").agg(F.collect_list("m").alias("ms"))
        met = met.withColumn("ms", F.array_sort("ms", lambda a, b: a["at"] - b["at"]))
        above = met.select("tree", "size", F.sha2(F.array_join(F.col("ms.digest"), ""), 256).alias("digest"), "ms", F.explode(F.filter("ms", lambda m: m["node"].isNotNull())).alias("m"))
        others = F.transform(F.filter("ms", lambda x: x["at"] != F.col("m.at")), lambda x: x["digest"])
        step = F.struct(F.col("m.at").alias("at"), others.alias("others"))
        met = above.select("tree", F.col("m.node").alias("node"), "size", "digest", F.concat("m.path", F.array(step)).cast(NODE).alias("path"))
        now = met.unionByName(now.filter(~active))
        span *= FANOUT
    return now.select("tree", "node", F.col("digest").alias("root"), "path")


def _with_paths(batch: pa.RecordBatch) -> pa.RecordBatch:
    made = []
    for members, size in zip(batch.column("members").to_pylist(), batch.column("size").to_pylist()):
        steps = paths(subtree([m["leaf"] for m in members], size <= BLOCK))
        made.append([{**m, "path": p} for m, p in zip(members, steps)])
    kind = batch.schema.field("members").type.value_type
    step = pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))])
    kind = pa.list_(pa.struct([*(kind.field(i) for i in range(kind.num_fields)), pa.field("path", pa.list_(step))]))
    at = batch.schema.names.index("members")
    columns = [*batch.columns]
    columns[at] = pa.array(made, kind)
    return pa.RecordBatch.from_arrays(columns, batch.schema.names)


def manifest(rows: DataFrame, group: str, order: list[str], carry: tuple = ()) -> DataFrame:
    """A proof for every row of ``rows``, which hold ``leaf`` (hex digest), ``group``, ``order`` and the ``carry`` columns.

    Groups stand in the order of their values, null first.  Returns ``order``, ``carry``, leaf, group, place, path (from
    the leaf up: the node's number in its run, the run's other digests), subroot and root.  Rows of equal order are taken by their leaf; equal
    rows are leaves of their own.  A null in ``order`` stands first.  A group of one row has its leaf as subroot, a table of one group
    its subroot as root; an empty table gives no row.
    """
    prepare(rows.sparkSession)
    kept = [c for c in dict.fromkeys([*order, *carry]) if c != group]
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    slim = stage(rows.select(tree.alias("tree"), F.col(group).alias("group_value"), *kept, "leaf"), "leaves")
    by = [c for c in order if c != group] + ["leaf"]
    placed = numbered(slim, "tree", by)
    member = F.struct(F.col("place"), "group_value", *kept, "leaf")
    blocks = placed.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("node")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    sizes = slim.groupBy("tree").agg(F.count("*").alias("size"))
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    blocks = blocks.withColumn("salt", (F.col("node") % SALTS).cast("int")).join(salted, ["tree", "salt"]).drop("salt")
    schema = T.StructType(blocks.schema.fields + [T.StructField("root", T.StringType())])
    blocks = stage(arrow_map(blocks, _roots, schema), "blocks")

    several = F.ceil(F.col("size") / BLOCK)
    inner = stage(butterfly(blocks.select("tree", "node", several.alias("size"), F.col("root").alias("digest"))), "block-proofs")
    subroots = inner.filter("node = 0").select("tree", F.col("root").alias("digest"))
    trees = stage(numbered(subroots.withColumn("one", F.lit("")), "one", ["tree"]), "subroots")
    outer = butterfly(trees.select(F.lit("").alias("tree"), F.col("place").alias("node"), F.lit(trees.count()).cast("long").alias("size"), "digest"))
    tops = stage(
        trees.select("tree", F.col("place").alias("node"), F.col("digest").alias("subroot")).join(outer.select("node", "root", F.col("path").alias("top")), "node").drop("node"),
        "top-proofs",
    )
    many = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    upper = inner.withColumn("salt", (F.col("node") % SALTS).cast("int")).select("tree", "node", "salt", "path").join(many, ["tree", "salt"])
    upper = upper.select("tree", "node", F.concat("path", "top").alias("upper"), "subroot", F.col("root").alias("whole"))

    fields = [*schema["members"].dataType.elementType.fields, T.StructField("path", T._parse_datatype_string(NODE))]
    kinds = {"members": T.ArrayType(T.StructType(fields))}
    full = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in schema.fields])
    made = arrow_map(blocks, _with_paths, full).select("tree", "node", "members").join(upper, ["tree", "node"])
    each = made.select(F.explode("members").alias("m"), "upper", "subroot", "whole")
    return each.select(
        *[F.col(f"m.`{c}`").alias(c) for c in kept], F.col("m.leaf").alias("leaf"), F.col("m.group_value").alias(group), F.col("m.place").alias("place"),
        F.concat("m.path", "upper").alias("path"), "subroot", F.col("whole").alias("root"),
    )


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to along ``path``."""
    return F.aggregate(
        path, start,
        lambda low, step: F.sha2(
            F.concat(
                F.array_join(F.slice(step["others"], F.lit(1), step["at"]), ""), low,
                F.array_join(F.slice(step["others"], step["at"] + 1, F.lit(FANOUT)), ""),
            ),
            256,
        ),
    )


def siblings(path: Column) -> Column:
    """All digests of a proof, in order, as one digest."""
    return F.sha2(F.array_join(F.flatten(path["others"]), ""), 256)


def document_manifest(docs: DataFrame) -> DataFrame:
    """Proofs of documents by source, and what they say about texts that lost their line ends.

    ``docs``: doc_id, source, lang, n_chars, text; nulls in any of them are hashed as such.  Rows whose crc32(doc_id) is even are
    read again without the newlines of their text; ``verified`` says whether that still leads to the root.
    """
    held = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = docs.select(
        "doc_id", "source", leaf(*held, F.col("text")).alias("leaf"),
        F.when(changed & F.col("text").contains("\n"), leaf(*held, F.translate("text", "\n", ""))).alias("tampered"),
    )
    made = manifest(rows, "source", ["doc_id"], carry=("tampered",))
    back = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return made.select(
        "doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), back.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# One recursion goes up the trees of all sources, one up the tree over them, one folds every leaf along its runs.
SQL = r"""
WITH RECURSIVE raw AS (
  SELECT *, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS codes FROM documents
), tested AS (
  SELECT *, (1 - list_reduce(list_prepend(4294967295::BIGINT, codes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))) % 2) = 0 AS changed FROM raw
), coded AS (
  SELECT doc_id, source, coalesce('1' || source, '0') AS k, changed,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS less FROM tested
), leaves AS (
  SELECT doc_id, k, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN changed THEN sha256(head || coalesce(strlen(less) || ':' || less, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS other
  FROM coded
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), inner_levels AS (
  SELECT k, 0 AS lvl, place AS i, leaf AS h, count(*) OVER (PARTITION BY k) AS n FROM placed
  UNION ALL
  SELECT k, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM inner_levels WHERE n > 1 GROUP BY k, lvl, i // 3, n
), subroots AS (
  SELECT k, lvl AS top, h AS subroot, row_number() OVER (ORDER BY encode(k)) - 1 AS place FROM inner_levels WHERE n = 1
), outer_levels AS (
  SELECT 0 AS lvl, place AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM outer_levels WHERE n > 1 GROUP BY lvl, i // 3, n
), runs AS (
  SELECT k, lvl, i // 3 AS run, list(h ORDER BY i) AS hs FROM inner_levels WHERE n > 1 GROUP BY ALL
), outer_runs AS (
  SELECT lvl, i // 3 AS run, list(h ORDER BY i) AS hs FROM outer_levels WHERE n > 1 GROUP BY ALL
), up AS (
  SELECT doc_id, k, place AS leaf_i, 0 AS lvl, place AS i, other AS h, '' AS proof FROM placed
  UNION ALL
  SELECT doc_id, up.k, leaf_i, up.lvl + 1, i // 3,
    sha256(array_to_string(hs[1 : i % 3], '') || h || array_to_string(hs[i % 3 + 2 :], '')),
    proof || array_to_string(hs[1 : i % 3], '') || array_to_string(hs[i % 3 + 2 :], '')
  FROM up JOIN runs ON runs.k = up.k AND runs.lvl = up.lvl AND runs.run = i // 3
), rest AS (
  SELECT doc_id, up.k, leaf_i, 0 AS lvl, s.place AS i, h, proof, subroot FROM up JOIN subroots s ON s.k = up.k AND s.top = up.lvl
  UNION ALL
  SELECT doc_id, k, leaf_i, rest.lvl + 1, i // 3,
    sha256(array_to_string(hs[1 : i % 3], '') || h || array_to_string(hs[i % 3 + 2 :], '')),
    proof || array_to_string(hs[1 : i % 3], '') || array_to_string(hs[i % 3 + 2 :], ''), subroot
  FROM rest JOIN outer_runs o ON o.lvl = rest.lvl AND o.run = i // 3
), whole AS (SELECT lvl AS top, h AS root FROM outer_levels WHERE n = 1)
SELECT rest.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, rest.h AS folded_root, rest.h = root AS verified
FROM rest JOIN whole ON rest.lvl = whole.top JOIN placed ON placed.k = rest.k AND placed.place = rest.leaf_i
"""
