"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A mask is a fixed pattern of token positions; the positions it leaves out may differ.
Every window of a document is hashed under every mask and looked up among the windows
of the benchmark's items.  A hit fixes how item and document lie against each other;
the tokens around it are then compared one by one, and the overlap counts if enough of a
longer window agree, so a few substituted words do not hide a copy.

Documents are cut into short overlapping slices before their windows are enumerated, so
no row carries a whole document; from there on the lookup runs in one generated stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Fixed masks.  Whichever two tokens of thirteen are substituted, one of these masks still
# stands whole at some place among the thirteen.
MASKS = ("100011111", "101100111", "110101101")
SPAN = len(MASKS[0])
SHORTEST = 5
SLICE = 128
SEEDS_AT_ONCE = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, and empty strings at the ends of the text."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")


def _hashes(text: Column) -> Column:
    """Hashes of the tokens, without the empty ones that splitting leaves at the ends."""
    return F.array_remove(F.transform(tokens(text), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _windows(df: DataFrame, masks: dict[int, str], around: int, *keep: str) -> DataFrame:
    """One row per mask and place: ``seed`` is the hash of the tokens that the mask selects.

    ``part`` holds the tokens near the place, which is at ``at`` in it; ``at + shift`` is its place in ``h``.
    """
    shortest = min(map(len, masks.values()))
    n = F.size("h")
    # no filter on the size: it would be pushed below and the tokens be made twice; exploding null gives no row
    cuts = F.when(F.col("n") >= shortest, F.sequence(F.lit(0), F.floor((F.col("n") - shortest) / SLICE).cast("int")))
    cut = (
        df.select(*keep, n.alias("n"), F.concat(F.array_repeat(F.lit(None).cast("long"), around), "h").alias("h"))
        .select(*keep, "n", "h", F.explode(cuts).alias("cut"))
        .select(*keep, "n", (F.col("cut") * SLICE - around).alias("shift"),
                F.slice("h", F.col("cut") * SLICE + 1, SLICE + 2 * around + max(map(len, masks.values()))).alias("part"))
    )
    last = F.least(F.lit(SLICE - 1), F.col("n") - shortest - F.col("shift") - around)
    at = cut.select(*keep, "n", "shift", "part", F.explode(F.sequence(F.lit(around), around + last)).alias("at"))

    def seed(number: int, mask: str) -> Column:
        h = F.xxhash64(F.lit(number), *[F.get("part", F.col("at") + i) for i, c in enumerate(mask) if c == "1"])
        # every place has room for the shortest mask
        return h if len(mask) == shortest else F.when(F.col("at") + F.col("shift") + len(mask) <= F.col("n"), h)

    seeds = at.select(*keep, "n", "shift", "part", "at", F.explode(F.array(*[seed(*m) for m in masks.items()])).alias("seed"))
    return seeds.filter("seed is not null") if len(set(map(len, masks.values()))) > 1 else seeds


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, allowed: int = 2, key: str = "doc_id") -> DataFrame:
    """Documents that hold a passage of a benchmark item: doc_id, item_id, matched, item_tokens, share.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are ignored.  A pair is reported if,
    around a seed hit, a window of ``window`` tokens (the whole item, if shorter) has at most
    ``allowed`` differing tokens (for shorter items in proportion, rounded down).  ``matched`` counts the
    item's tokens that agree in such windows, ``share`` is their part of the item.

    Null texts count as empty; items of fewer than five tokens cannot be matched; rows with a null
    item_id or doc_id are compared like others and keep the null.  Repeated rows give one pair, and so
    do several texts under one id; another column that names rows can be given as ``key`` and is returned as doc_id.  Empty tables give an empty result.  The benchmark is read in
    blocks of about ``SEEDS_AT_ONCE`` windows, each of which is small enough to be sent to every task.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _hashes(F.col("text")).alias("h")).filter(F.size("h") >= SHORTEST)
    # one row: a sum, and at most SPAN - SHORTEST lengths
    found = items.agg(
        F.sum(F.size("h")).alias("tokens"), F.collect_set(F.when(F.size("h") < SPAN, F.size("h"))).alias("short")
    ).first()
    masks = dict(enumerate(MASKS)) | {10 + n: "1" * n for n in sorted(found["short"])}
    blocks = max(1, -(-(found["tokens"] or 0) * len(masks) // SEEDS_AT_ONCE))
    around = window - SPAN
    reach = window + around
    documents = docs.select((F.col(key).cast("long") if key == "doc_id" else F.col(key)).alias("doc_id"), _hashes(F.col("text")).alias("h"))
    places = _windows(documents, masks, around, "doc_id").select("doc_id", "part", "at", "seed")
    item_at = F.col("at") + F.col("shift")
    seeds = (
        _windows(items, masks, around, "item_id")
        # an item shorter than the masks is matched whole
        .filter((F.col("n") >= SPAN) | (item_at == 0))
        .select(
            "item_id", "seed", F.col("n").alias("item_tokens"), item_at.alias("item_at"),
            F.transform(F.sequence(F.lit(-around), F.lit(window - 1)), lambda k: F.get("part", F.col("at") + k)).alias("near"),
        )
    )
    parts = []
    for b in range(blocks):
        part = seeds.filter(F.pmod(F.xxhash64("item_id", "item_at"), F.lit(blocks)) == b) if blocks > 1 else seeds
        parts.append(_agreeing(places.join(F.broadcast(part), "seed"), window, allowed, around, reach))
    places_of = F.flatten(F.transform("seen", lambda x: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(reach - 1)), lambda k: F.call_function("shiftright", x["bits"], k).bitwiseAND(F.lit(1)) == 1),
        lambda k: x["item_at"] - around + k,
    )))
    return (
        # partial aggregation first: a place of an item once per document, then the document's places
        reduce(DataFrame.unionByName, parts)
        .groupBy("doc_id", "item_id", "item_tokens", "item_at").agg(F.bit_or("bits").alias("bits"))
        .groupBy("doc_id", "item_id", "item_tokens").agg(F.collect_list(F.struct("item_at", "bits")).alias("seen"))
        .select("doc_id", "item_id", F.size(F.array_distinct(places_of)).cast("long").alias("matched"), F.col("item_tokens").cast("long").alias("item_tokens"))
        .withColumn("share", F.col("matched") / F.col("item_tokens"))
    )


def _agreeing(hits: DataFrame, window: int, allowed: int, around: int, reach: int) -> DataFrame:
    """One row per hit and agreeing window; ``bits`` marks its equal tokens, counted from ``around`` before the hit.

    Hits are few beside lookups.  Array functions and the generator keep this check out of the generated
    code of the lookup, and its filter out of the join's condition: both would make that code too long to be compiled.
    """
    equal = F.aggregate(
        F.sequence(F.lit(0), F.lit(reach - 1)), F.lit(0),
        lambda found, k: found + F.when(
            F.get("part", F.col("at") + k - around) == F.get("near", k), F.call_function("shiftleft", F.lit(1), k)
        ).otherwise(F.lit(0)),
    )
    width = F.least(F.col("item_tokens"), F.lit(window))
    need = width - F.floor(width * allowed / window).cast("int")
    seen = hits.select("doc_id", "item_id", "item_tokens", "item_at", equal.alias("equal"), width.alias("width"), need.alias("need"))

    def inside(k: Column) -> Column:
        begin = F.col("item_at") + k - around
        mask = F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1), F.col("width")) - 1, k)
        found = F.col("equal").bitwiseAND(mask)
        fits = (begin >= 0) & (begin + F.col("width") <= F.col("item_tokens")) & (F.bit_count(found) >= F.col("need"))
        return F.when(fits, found).otherwise(F.lit(0))

    windows = F.filter(F.transform(F.sequence(F.lit(0), F.lit(around)), inside), lambda x: x != 0)
    return seen.select("doc_id", "item_id", "item_tokens", "item_at", F.explode(windows).alias("bits"))


# The same in SQL, over word lists instead of hashes.
SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT * FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) >= {SHORTEST}
), masks AS (
  SELECT * FROM (VALUES {", ".join(f"({n}, {[k for k, c in enumerate(m) if c == '1']}, {SPAN})" for n, m in enumerate(MASKS))}) AS m(mask, picks, span)
  UNION ALL SELECT DISTINCT 10 + len(w), range(len(w)), len(w) FROM i WHERE len(w) < {SPAN}
), item_seeds AS (
  SELECT item_id, w AS iw, p AS item_at, mask, list_transform(picks, lambda k: iw[p + k + 1]) AS seed
  FROM (SELECT item_id, w, unnest(range(len(w))) AS p FROM i), masks
  WHERE p + span <= len(w) AND (len(w) >= {SPAN} OR p = 0)
), doc_seeds AS (
  SELECT doc_id, w AS dw, p AS dp, mask, list_transform(picks, lambda k: dw[p + k + 1]) AS seed
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d), masks WHERE p + span <= len(w)
), starts AS (
  SELECT *, item_at - o AS s, dp - o AS t, least(len(iw), 13) AS width
  FROM item_seeds JOIN doc_seeds USING (mask, seed), (SELECT unnest(range({13 - SPAN + 1})) AS o)
), agreeing AS (
  SELECT doc_id, item_id, len(iw) AS item_tokens, s, width,
    list_filter(range(width), lambda k: t + k >= 0 AND t + k < len(dw) AND dw[greatest(t + k, 0) + 1] = iw[s + k + 1]) AS same
  FROM starts WHERE s >= 0 AND s + width <= len(iw)
), places AS (
  SELECT DISTINCT doc_id, item_id, item_tokens, s + unnest(same) AS place FROM agreeing
  WHERE len(same) >= width - CAST(floor(width * 2 / 13.0) AS INTEGER)
)
SELECT doc_id, item_id, count(*) AS matched, CAST(item_tokens AS BIGINT) AS item_tokens, count(*) / CAST(item_tokens AS DOUBLE) AS share
FROM places GROUP BY doc_id, item_id, item_tokens
"""
