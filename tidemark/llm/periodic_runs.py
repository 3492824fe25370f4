"""Periodic runs in texts: stretches of words that repeat with a short period.

A run of period q has at least max(6, 4 q) words, so each of its words occurs at least four times in it.  A word that
occurs less often in a segment can belong to no run there and splits the segment; the pieces are
counted again, until nothing splits.  Of prose little is left.  The segments that survive are scanned lag by lag.

The scan of a lag looks at every q-th place only: in a stretch of 3 q places whose words equal the ones q later, one of the looked-at places begins a
block of 2 q words that equals the one q later, which two differences of a prefix hash tell.  That is L/q tests a
lag, L log L in all.  A place inside a known run of a smaller period can begin nothing new (two periods in a common
stretch longer than both together have a common divisor as period), and every find is extended on the words themselves.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_map, documents, prepare

LEAST_WORDS = 6
LEAST_TIMES = 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_BASE = np.uint64(0x9E3779B97F4A7C15)


def numbers(words: list[bytes]) -> np.ndarray:
    """The words as small integers, equal ones alike."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """What splitting at words with fewer than LEAST_TIMES occurrences in their segment leaves: (begin, end) of LEAST_WORDS words and more."""
    done: list[tuple[int, int]] = []
    begin, end = np.array([0]), np.array([len(ids)])
    while True:
        long = end - begin >= LEAST_WORDS
        begin, end = begin[long], end[long]
        if not len(begin):
            return sorted(done)
        size = end - begin
        # places of all segments that are still split, one after another
        owner = np.repeat(np.arange(len(begin)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[owner]
        _, inverse, count = np.unique(owner * (ids.max() + 1) + ids[place], return_inverse=True, return_counts=True)
        rare = count[inverse] < LEAST_TIMES
        stable = np.bincount(owner, rare, len(begin)) == 0
        done += zip(begin[stable].tolist(), end[stable].tolist())
        # maximal stretches of frequent words inside each unstable segment
        keep = ~rare & ~stable[owner]
        follows = np.zeros(len(place), bool)
        follows[1:] = keep[1:] & keep[:-1] & (owner[1:] == owner[:-1])
        heads = np.flatnonzero(keep & ~follows)
        ends_here = keep.copy()
        ends_here[:-1] &= ~follows[1:]
        begin, end = place[heads], place[np.flatnonzero(ends_here)] + 1


def _common(ids: np.ndarray, i: int, j: int, low: int, high: int) -> tuple[int, int]:
    """How far ids[.. i ..] and ids[.. j ..] agree: the first place and the place after the last, of i's side, within [low, high)."""
    right, step = i, 64
    while right + (j - i) < high:
        stop = min(right + step, high - (j - i))
        differ = np.flatnonzero(ids[right:stop] != ids[right + (j - i) : stop + (j - i)])
        if len(differ):
            right += int(differ[0])
            break
        right, step = stop, step * 2
    left, step = i, 64
    while left > low:
        start = max(low, left - step)
        differ = np.flatnonzero(ids[start:left] != ids[start + (j - i) : left + (j - i)])
        if len(differ):
            left = start + int(differ[-1]) + 1
            break
        left, step = start, step * 2
    return left, right


def scan(ids: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """All runs of ids[low:high] as (start, length, period)."""
    n = high - low
    found: list[tuple[int, int, int]] = []
    with np.errstate(over="ignore"):
        x = (ids[low:high].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        power = np.cumprod(np.full(n + 1, _BASE, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[:n])])
        # hidden[i]: the end of the known run that covers place i furthest to the right
        hidden = np.zeros(n, np.int64)
        for q in range(1, n // LEAST_TIMES + 1):
            least = max(LEAST_WORDS, LEAST_TIMES * q)
            if least > n:
                break
            width = 2 * q if q > 1 else least - 1
            at = np.arange(0, n - width - q + 1, q)
            at = at[hidden[at] < at + width + q]
            if not len(at):
                continue
            one, two = total[at + width] - total[at], total[at + q + width] - total[at + q]
            at = at[one * power[q] == two * power[0]]
            for i in at.tolist():
                if hidden[i] >= i + width + q:
                    continue
                left, right = _common(ids, low + i, low + i + q, low, high)
                start, length = left, right + q - left
                if length >= least:
                    found.append((start, length, q))
                    a = start - low
                    np.maximum(hidden[a : a + length], a + length, out=hidden[a : a + length])
    return found


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Every run of the words as (start, length, period), by start, then period."""
    return sorted((r for low, high in segments(ids) for r in scan(ids, low, high)), key=lambda r: (r[0], r[2])) if len(ids) else []


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length/period; ties: the smallest start, then period."""
    best = None
    for r in found:
        if best is None or (-r[1] * best[2], r[0], r[2]) < (-best[1] * r[2], best[0], best[2]):
            best = r
    return best


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    keep = np.ones(n, bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return keep


def repeated(words: list[bytes], key: int) -> list[bytes]:
    """A known case: where the key's crc32 ends in 0, the words from some place on repeat a stretch."""
    h = zlib.crc32(str(key).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def detect(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), kept (the words that stay, joined by blanks) of every whole text.

    ``docs``: doc_id, text; other columns are ignored.  A null, empty or blank text has no words, no runs and keeps "".  Equal rows give equal
    results, rows with a null id are treated like others.  A word is unbroken by ASCII white space.  ``planted``: repeat the words first as
    ``repeated`` says (rows with a null id stay).
    No row is shuffled; a text needs memory in proportion to its words.
    """
    prepare(docs.sparkSession)
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, every, texts = [], [], []
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            words = WORD.findall(text.encode())
            if planted and key is not None:
                words = repeated(words, key)
            found = runs(numbers(words))
            keep = kept_words(len(words), found)
            counts.append(len(words))
            every.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            texts.append(b" ".join(w for w, k in zip(words, keep.tolist()) if k).decode())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(every, run), pa.array(texts, pa.string())],
            ["doc_id", "n_words", "runs", "kept"],
        )

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string"
    return arrow_map(documents(docs), work, schema)
