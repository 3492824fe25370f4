"""Language identification by nearest centroid.

A text is a vector of hashed byte trigrams, weighted by TF-IDF and normalised.  Each
language has several centroids, found by spherical k-means over a bounded sample of its
training texts; a text takes the language of the centroid with the largest cosine.  A
text farther from its centroid than nearly all of that centroid's own texts is marked
as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import arrow_map, documents
from tidemark.llm.sampling import labelled_sample

BITS = 13
SIZE = 1 << BITS
NONE = "und"

# ASCII characters other than letters become blanks, so digits and punctuation say nothing.
_PLAIN = bytes.maketrans(
    bytes(b for b in range(128) if not chr(b).isalpha()), b" " * sum(not chr(b).isalpha() for b in range(128))
)


def trigram_counts(text: str) -> np.ndarray:
    """How often each hashed trigram of the lower-case UTF-8 bytes occurs."""
    b = np.frombuffer(b" " + text.lower().encode().translate(_PLAIN) + b" ", np.uint8)
    if len(b) < 3:
        return np.zeros(SIZE, np.int64)
    code = (b[:-2].astype(np.uint32) << np.uint32(16)) | (b[1:-1].astype(np.uint32) << np.uint32(8)) | b[2:]
    code = code[code != 0x202020] * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(32 - BITS), minlength=SIZE)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), SIZE), np.float32)
    for row, text in zip(out, texts):
        row[:] = trigram_counts(text)
    np.log1p(out, out)
    out *= idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def clusters(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each next one the point worst served so far."""
    centres = [points.mean(0)]
    for _ in range(min(k, len(points)) - 1):
        near = (points @ (np.array(centres) / np.linalg.norm(centres, axis=1, keepdims=True).clip(1e-9)).T).max(1)
        centres.append(points[near.argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.linalg.norm(c, axis=1, keepdims=True).clip(1e-9)
        own = (points @ c.T).argmax(1)
        c = np.array([points[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.linalg.norm(c, axis=1, keepdims=True).clip(1e-9)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple
    centroids: np.ndarray  # one row per centroid
    owner: np.ndarray  # the language of each centroid
    floor: np.ndarray  # cosines below it are rejected
    idf: np.ndarray


def fit(train: DataFrame, per_language: int = 400, centroids: int = 4, reject_share: float = 0.005) -> LanguageModel:
    """Fit on ``train``: doc_id, text, lang.

    Document frequencies come from all its texts.  Centroids come from at most ``per_language``
    different texts of each language.  Rows without a language only count in the frequencies.
    """
    spark = train.sparkSession

    def count(batches):
        seen, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen += trigram_counts(text) > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *at], pa.int32()), pa.array([n, *seen[at]], pa.int64())], ["slot", "n"]
        )

    # at most SIZE + 1 rows
    found = train.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(SIZE), 0
    for r in found:
        if r["slot"] < 0:
            n = r["n"]
        else:
            df[r["slot"]] = r["n"]
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.01)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        points = vectors(pdf["text"].tolist(), idf)
        points = points[points.any(axis=1)]
        if not len(points):
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        c = clusters(points, centroids)
        cos = points @ c.T
        own, best = cos.argmax(1), cos.max(1)
        floors = [float(np.quantile(best[own == j], reject_share)) if (own == j).any() else 1.0 for j in range(len(c))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": c.tolist(), "floor": floors})

    sample, _ = labelled_sample(train, "lang", per_language)
    # a few rows for each language
    rows = sorted(
        sample.groupBy("lang").applyInPandas(group, "lang string, centroid array<float>, floor double").collect(),
        key=lambda r: (r["lang"], r["centroid"]),
    )
    names = tuple(sorted({r["lang"] for r in rows}))
    return LanguageModel(
        names,
        np.array([r["centroid"] for r in rows], np.float32).reshape(len(rows), SIZE),
        np.array([names.index(r["lang"]) for r in rows], int),
        np.array([r["floor"] for r in rows]),
        idf,
    )


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Language of whole texts: doc_id, lang_pred, score, rejected; one row per input row.

    ``docs``: doc_id, text; other columns are ignored.  A text that is null or has no letter is
    ``und`` with score 0 and rejected.  The score is the cosine to the nearest centroid (ties go to
    the alphabetically first language).  If nothing could be learned, every text is ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # centroids per language x languages
    base = documents(docs).select("doc_id", "text", F.col("text").rlike(r"\p{L}").alias("letters"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        n = batch.num_rows
        letters = np.array(batch.column("letters").to_pylist(), bool)
        cos = np.zeros((n, max(1, len(m.owner))), np.float32)
        if len(m.owner):
            for at in range(0, n, 128):
                cos[at : at + 128] = vectors(batch.column("text")[at : at + 128].to_pylist(), m.idf) @ m.centroids.T
        else:
            letters[:] = False
        near = cos.argmax(1)
        best = cos[np.arange(n), near].clip(0, 1).astype(float)
        names = [m.languages[m.owner[j]] if ok else NONE for j, ok in zip(near, letters)]
        far = [bool(not ok or s < m.floor[j]) for j, s, ok in zip(near, best, letters)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letters, best, 0.0)), pa.array(far, pa.bool_())],
            ["doc_id", "lang_pred", "score", "rejected"],
        )

    return arrow_map(base, work, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, held_out) -> DataFrame:
    """Fit on the rows of ``docs`` (doc_id, text, lang) for which ``held_out`` does not hold, predict all."""
    rows = documents(docs, F.col("lang").cast("string").alias("lang"))
    model = fit(rows.filter(~F.coalesce(held_out, F.lit(True))))
    return predict(rows, model)
