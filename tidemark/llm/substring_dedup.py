"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text, and chunks end where the hash of the last few
bytes has a fixed remainder.  The ends depend on content alone, so inserting or removing text
moves only the chunks it touches, and a passage is cut the same way wherever it stands.
Chunks are compared by digest.  Later occurrences of a chunk are repeats; where repeated chunks
follow each other over enough words, the stretch is removed from the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import arrow_map, carried, documents

REACH = 16  # bytes that decide about a chunk's end
LONGEST = 256

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2h + gear[byte] at every byte; its top half sees the last sixteen bytes.

    The recurrence is unrolled by doubling: sums over 2, 4, 8 and 16 bytes.
    """
    h = _GEAR[raw] << np.uint32(16)
    for width in (1, 2, 4, 8):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h >> np.uint32(16)


def chunk_ends(raw: np.ndarray, words: int) -> np.ndarray:
    """Ends of the chunks of a text's UTF-8 bytes.

    At blanks, one in ``words`` ends a chunk; between other characters, one in 128 times as many does,
    which serves texts without blanks.  After ``LONGEST`` bytes the next blank ends one anyhow, or, if none is near,
    the next character; so one word repeated over and over is cut into equal chunks too.
    """
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    h = gear_hashes(raw)
    blank = _BLANK[raw]
    whole = np.empty(n, bool)  # the next byte starts a character
    whole[:-1] = (raw[1:] & 0xC0) != 0x80
    whole[-1] = True
    ends = np.flatnonzero((blank & (h % words == 0)) | (whole & (h % (words * 128) == 1))) + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    sizes = np.diff(ends, prepend=0)
    if sizes.max() > LONGEST:
        out, at, blanks = [], 0, np.flatnonzero(blank) + 1
        for e in ends.tolist():
            while e - at > LONGEST:
                near = np.searchsorted(blanks, at + LONGEST)
                if near < len(blanks) and blanks[near] <= at + LONGEST + 64:
                    at = int(blanks[near])
                else:
                    at += LONGEST
                    while not whole[at - 1]:
                        at -= 1
                if at >= e:
                    break
                out.append(at)
            out.append(e)
            at = e
        ends = np.array(out)
    return ends


def word_counts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that begin in each chunk."""
    blank = _BLANK[raw]
    begins = ~blank
    begins[1:] &= blank[:-1]
    total = np.concatenate([[0], np.cumsum(begins)])
    return np.diff(total[ends], prepend=0)


def repeated_spans(repeats: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Which chunks to remove: runs of repeated chunks in which at least ``least`` words begin."""
    run = np.cumsum(np.diff(repeats.astype(np.int8), prepend=0) != 0)
    return repeats & (np.bincount(run, weights=words)[run] >= least)


def remove_repeats(docs: DataFrame, least: int = 16, words: int = 5, carry: tuple = ()) -> DataFrame:
    """Texts without what has stood before: doc_id, n_chunks, n_repeated, removed_bytes, text.

    ``docs``: doc_id, text; other columns are ignored unless ``carry`` names them.  Chunks hold about ``words`` words.  Of equal chunks, the
    first in the order of doc_id (null ids last) and place stays.  Runs of repeated chunks with
    fewer than ``least`` words stay as well, so stock phrases and single repeated lines are left alone; a
    repeated passage loses all but up to a chunk and ``REACH`` bytes at its ends.

    ``n_repeated`` counts removed chunks.  Returns one row per input row.  Null text counts as empty: no
    chunks, an empty text.  Rows equal in id and text are one document and keep the same text.
    An empty table gives an empty result.
    """
    base = documents(docs, *carry).withColumn("row", F.xxhash64("doc_id", "text"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column("text").to_pylist():
            raw = text.encode()
            at, one = 0, []
            for e in chunk_ends(np.frombuffer(raw, np.uint8), words).tolist():
                one.append(xxhash.xxh3_64_intdigest(raw[at:e]))
                at = e
            found.append(np.array(one, np.uint64).view(np.int64))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))],
            ["doc_id", "row", "chunks"],
        )

    chunks = arrow_map(base, cut, "doc_id long, row long, chunks array<long>").select(
        F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "row", F.posexplode("chunks").alias("place", "digest")
    )
    # one row per digest and map task is shuffled; then only digests that occur again are joined back
    first = (
        chunks.groupBy("digest")
        .agg(F.min(F.struct("doc", "place", "row")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", "first")
    )
    again = (
        chunks.join(first, "digest").filter(F.struct("doc", "place", "row") != F.col("first"))
        .groupBy("row").agg(F.array_sort(F.collect_set("place")).alias("places"))
    )

    def trim(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, gone, lost, texts = [], [], [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = chunk_ends(raw, words)
            out = np.zeros(len(ends), bool)
            if places:
                out[places] = True
                out = repeated_spans(out, word_counts(raw, ends), least)
            sizes = np.diff(ends, prepend=0)
            total.append(len(ends))
            gone.append(int(out.sum()))
            lost.append(int(sizes[out].sum()))
            texts.append(raw[~np.repeat(out, sizes)].tobytes().decode() if out.any() else text)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(lost, pa.int64()), pa.array(texts, pa.string()), *map(batch.column, carry)],
            ["doc_id", "n_chunks", "n_repeated", "removed_bytes", "text", *carry],
        )

    return arrow_map(
        base.join(again, "row", "left").select("doc_id", "text", "places", *carry), trim,
        carried("doc_id long, n_chunks long, n_repeated long, removed_bytes long, text string", base, carry),
    )
