"""I-Match fingerprints: digests of the terms that several randomised lexicons hold.

A term is an unbroken run of ASCII letters, digits and all characters beyond ASCII, in lower case.  The main lexicon
holds the terms in a band of inverse document frequency: words of nearly every text say nothing, words of very few
texts are mostly slips.  A text's distinct lexicon terms are put in order and digested.  Random subsets of the main lexicon are
digested each on its own; they are of many sizes: long texts that differ in many words still agree on small
lexicons, short ones still have terms in large ones.

A term is known by its MD5.  Its first six digits are its class, and document frequency is counted by class, so the lexicon
is a bitmap of 2^24 bits whatever the corpus.  Digests scatter terms at random, so a random lexicon is a range of them, and
in a text's sorted terms each of the lexicons is one stretch: borders sorted in among the terms cut them all at once.
All of it is DataFrame functions, and no text is shuffled to be fingerprinted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import stage

CLASS_DIGITS = 6
CLASSES = 16**CLASS_DIGITS
WORD_BITS = 64
LEAST_TEXTS = 2
COMMONEST = 16  # terms in more than one of so many texts are left out
RAREST = 8192  # and those in fewer than one of so many
# (lexicons, share of the main lexicon that each holds, in 65536ths)
SIZES = ((2, 8192), (4, 4096), (8, 2048), (16, 512), (16, 256), (16, 128), (16, 64), (16, 32), (16, 16))
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKET_ROWS = 1000
MOST_BUCKETS = 1 << 16


def _borders() -> list[str]:
    """Where each lexicon's range of digests ends, as four digits."""
    ends, at = [], 0
    for count, share in SIZES:
        for _ in range(count):
            at += share
            ends.append(f"{at:04x}")
    return ends


def _class(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, CLASS_DIGITS), 16, 10).cast("int")


def _words(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), SPLIT)), "")


def lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row with ``bits``: the classes of terms within the band, as longs of 64 classes each.

    Frequencies count all rows of ``docs``; partial counts leave one row per class and map task.
    """
    known = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    held = known.select(F.explode(F.array_distinct(F.transform(_words(F.col("text")), lambda w: F.substring(F.md5(w), 1, CLASS_DIGITS)))).alias("class"))
    held = held.select(_class(F.col("class")).alias("class"))
    texts = docs.agg(F.count("*")).scalar()
    band = held.groupBy("class").count().filter(
        (F.col("count") >= LEAST_TEXTS) & (F.col("count") * COMMONEST <= texts) & (F.col("count") * RAREST >= texts)
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("class") % WORD_BITS)
    kept = band.select(F.floor(F.col("class") / WORD_BITS).cast("long").alias("at"), bit.alias("bits"))
    every = docs.sparkSession.range(CLASSES // WORD_BITS).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bits"))
    words = every.unionByName(kept).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    # 262,144 longs for any corpus
    return stage(words.agg(F.sort_array(F.collect_list(F.struct("at", "bits")))["bits"].alias("bits")), "lexicon")


def slots(rows: DataFrame, held: DataFrame, text: str, into: str) -> DataFrame:
    """``rows`` with array<string> ``into``: the digest over the whole lexicon, then one for each random lexicon.

    A random lexicon that holds no term of the text gives "".  A text none of whose terms is in the band is digested over all its
    terms, and one without terms over itself; null counts as empty.
    """
    def inside(digest: Column) -> Column:
        number = _class(digest)
        word = F.get("_bits", F.shiftright(number, 6))
        return F.call_function("shiftrightunsigned", word, number % WORD_BITS) % 2 != 0

    read = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = rows.withColumn("_terms", F.transform(_words(read), lambda w: F.md5(w)))
    # the bitmap is a constant of the plan, so it is read in place and no row carries it
    out = out.withColumn("_bits", held.scalar()).withColumn("_band", F.filter("_terms", inside)).drop("_bits")
    out = out.withColumn("_base", F.sort_array(F.when(F.size("_band") > 0, F.col("_band")).otherwise(F.col("_terms")))).drop("_terms", "_band")
    whole = F.when(F.size("_base") > 0, F.md5(F.array_join("_base", ""))).otherwise(F.md5(read))
    # "!" sorts before every digit, and a stretch ends with the four digits of its border
    borders = [b + "!" for b in _borders()]
    cut = F.split(F.array_join(F.sort_array(F.concat("_base", F.array(*map(F.lit, borders)))), ""), "!")
    out = out.withColumn("_parts", F.slice(cut, 1, len(borders))).withColumn(into, F.array(whole)).drop("_base")
    digest = lambda part: F.when(F.length(part) > 4, F.substring(F.md5(part), 1, 8)).otherwise("")
    return out.withColumn(into, F.concat(into, F.transform("_parts", digest))).drop("_parts")


def likeness(a: str, b: str) -> Column:
    """Of the lexicons that hold a term of either text, the share whose digests agree."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == "") & (y == ""), F.lit(None)).otherwise(x == y))
    counted = F.filter(both, lambda x: x.isNotNull())
    return F.size(F.filter(counted, lambda x: x)) / F.size(counted)


def fingerprint(slot: str) -> Column:
    return F.array_join(slot, "-")


def with_next(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``rows`` with columns of the row next in descending order of ``key``; after the last one, of the first.

    ``columns``: {name of the next row's column: its name in the result}.  Rows of equal key stand in the order of the named
    columns.  Rows with a null key stand in no order; what they get is null.

    Keys are cut into ranges at keys of the table itself.  The highest rows of a range are also dealt to the range above, where they
    stand last, so every row finds the next one in its own range.
    """
    keys = rows.select(F.col(key).alias("k")).filter("k is not null")
    buckets = max(1, min(MOST_BUCKETS, keys.count() // BUCKET_ROWS))
    tops = keys.repartitionByRange(buckets, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.max("k").alias("top"))
    tops = stage(tops.agg(F.array_sort(F.collect_set("top")).alias("tops")), "range-tops")
    top = tops.scalar()
    # the number of tops below the key, by halving; there may be more or fewer ranges than were asked for
    ranges = tops.select(F.size("tops")).first()[0]
    placed = rows.withColumn("_range", F.lit(0))
    for power in range(ranges.bit_length(), -1, -1):
        step = 1 << power
        placed = placed.withColumn("_range", F.when(F.get(top, F.col("_range") + (step - 1)) < F.col(key), F.col("_range") + step).otherwise(F.col("_range")))
    above = F.when(F.get(top, F.col("_range")) == F.col(key), F.pmod(F.col("_range") + 1, F.size(top)))
    once = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))
    dealt = placed.withColumn("_at", F.explode(F.when(above.isNull(), F.array(once)).otherwise(F.array(once, F.struct(above.alias("range"), F.lit(True).alias("guest"))))))
    # rows without a key are spread and find nobody
    lone = F.col(key).isNull()
    near = Window.partitionBy(F.col("_at.range"), F.when(lone, F.pmod(F.xxhash64(*columns), F.lit(4096)))).orderBy(
        F.col("_at.guest"), F.col(key).desc(), *columns
    )
    found = dealt.select("*", *[F.when(~lone, F.lead(old).over(near)).alias(new) for old, new in columns.items()])
    return found.filter(~F.col("_at.guest")).drop("_at", "_range")


def fingerprints(docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """doc_id, text, slots, fingerprint for every row of ``docs`` (doc_id, text; further columns are ignored).

    Null texts count as empty; equal texts have equal fingerprints; an empty table gives an empty one.
    """
    held = lexicon(docs) if held is None else held
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slots(base, held, "text", "slots").withColumn("fingerprint", fingerprint("slots"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """How alike the fingerprints of a text, of its half-replaced version and of the next document are.

    The last half of the code points (rounded down) is replaced by the first as many of the next document in descending order of
    doc_id, after the last by those of the first.  One row per row of ``docs``.  A row with a null id has no next
    document: its edited columns are null.  Of rows that share an id, that with the smaller text comes first.
    """
    held = lexicon(docs)
    made = fingerprints(docs, held).drop("fingerprint").withColumn("n_chars", F.length("text").cast("long"))
    near = with_next(made, "doc_id", {"text": "next_text", "slots": "next_slots"})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = near.withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    ).drop("text", "next_text")
    compared = slots(edited, held, "edited", "edited_slots")
    known = F.col("edited").isNotNull()
    return compared.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("slots").alias("fingerprint"),
        F.when(known, fingerprint("edited_slots")).alias("edited_fingerprint"),
        F.when(known, likeness("slots", "edited_slots")).alias("near_edited"),
        F.when(known, likeness("slots", "next_slots")).alias("near_next"),
    )


def _parts() -> str:
    """The stretches of ``b`` in SQL, each with its border."""
    ends = _borders()
    one = "list_filter(b, lambda d: d >= '{low}' AND d < '{high}')"
    make = "CASE WHEN len({x}) > 0 THEN left(md5(array_to_string({x}, '') || '{high}'), 8) ELSE '' END"
    return ", ".join(make.format(x=one.format(low=low, high=high), high=high) for low, high in zip(["", *ends], ends))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (
  SELECT doc_id, text, length(text) AS n_chars,
    left(text, length(text) - length(text) // 2)
      || left(coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)), length(text) // 2) AS edited,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id
  FROM d
), texts AS (SELECT DISTINCT text AS t FROM e UNION SELECT edited FROM e),
terms AS (
  SELECT t, list_sort(list_transform(list_filter(list_distinct(string_split_regex(
    lower(t), '{SPLIT}')), lambda w: w <> ''), lambda w: md5(w))) AS m FROM texts
), band AS (
  SELECT c FROM (SELECT unnest(list_distinct(list_transform(m, lambda x: left(x, {CLASS_DIGITS})))) AS c FROM d JOIN terms ON t = text)
  GROUP BY c HAVING count(*) >= {LEAST_TEXTS} AND count(*) * {COMMONEST} <= (SELECT count(*) FROM d) AND count(*) * {RAREST} >= (SELECT count(*) FROM d)
), kept AS (
  SELECT t, list_sort(list(x)) AS inside FROM (SELECT t, unnest(m) AS x FROM terms) WHERE left(x, {CLASS_DIGITS}) IN (SELECT c FROM band) GROUP BY t
), based AS (SELECT terms.t, coalesce(inside, m) AS b FROM terms LEFT JOIN kept ON kept.t = terms.t),
s AS (
  SELECT t, list_prepend(CASE WHEN len(b) > 0 THEN md5(array_to_string(b, '')) ELSE md5(t) END, [{_parts()}]) AS slots FROM based
), pairs AS (
  SELECT e.doc_id, n_chars, edited, own.slots AS a, made.slots AS b, other.slots AS c
  FROM e JOIN s own ON own.t = e.text JOIN s made ON made.t = e.edited
  JOIN d n ON n.doc_id = e.next_id JOIN s other ON other.t = n.text
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '-') AS fingerprint, array_to_string(b, '-') AS edited_fingerprint,
  len(list_filter(range(1, len(a) + 1), lambda i: a[i] = b[i] AND a[i] <> '')) / len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> '' OR b[i] <> '')) AS near_edited,
  len(list_filter(range(1, len(a) + 1), lambda i: a[i] = c[i] AND a[i] <> '')) / len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> '' OR c[i] <> '')) AS near_next
FROM pairs
"""
