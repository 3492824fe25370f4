"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are word stems (whole words and their first five to seven letters) graded by how
dense they are in the text; a text that has a stem at some density has the lower grades
as well.  The vocabulary holds the terms whose frequency differs between the two labels,
by a chi-square test on a bounded sample of labelled texts.  Document frequencies of these terms
are counted over all documents.  The labelled examples of the sample stand in an inverted
index whose posting lists are cut into blocks with their largest weight; a search visits
blocks by falling upper bound and stops when no block can beat the k-th neighbour, so
its neighbours are exact.  Neighbours vote with a power of their cosine, each label weighted
back to its share of all labelled rows, against a prior weight; so scores are calibrated,
and the neighbours are the evidence.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import arrow_map, carried, documents
from tidemark.llm.sampling import labelled_sample

GRADES = 4
STEMS = (5, 6, 7)
BLOCK = 64

_PLAIN = {i: " " for i in range(128) if not chr(i).isalnum()}


def stem_counts(text: str) -> tuple[Counter, int]:
    """How often each stem occurs, and the number of words."""
    words = text.lower().translate(_PLAIN).split()
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        counts[word] += n
        for k in STEMS:
            if len(word) > k:
                counts[word[:k] + "-"] += n
    return counts, len(words)


def grade(n: int, words: int) -> int:
    """0 for a stem rarer than one word in 128, then one more for each doubling."""
    share = n * 128 / words
    return 0 if share < 1 else min(GRADES - 1, int(math.log2(share)) + 1)


@dataclass(frozen=True)
class ToxicityModel:
    terms: dict  # stem -> its term numbers by grade, -1 where the grade is not in the vocabulary
    idf: np.ndarray
    prior: float
    ids: np.ndarray
    toxic: np.ndarray
    label_weight: tuple
    blocks: int
    bounds: tuple  # per term: block numbers, largest weight in each
    postings: dict  # (term, block) -> positions in the block, weights
    neighbours: int
    power: float
    prior_weight: float

    def vector(self, text: str) -> dict[int, float]:
        """The normalised TF-IDF vector of a text over the vocabulary."""
        words = text.lower().translate(_PLAIN).split()
        terms, counts = self.terms, Counter()
        for word, n in Counter(words).items():
            if word in terms:
                counts[word] += n
            if len(word) > 5:
                for k in STEMS:
                    if len(word) > k and (stem := word[:k] + "-") in terms:
                        counts[stem] += n
        raw = {
            t: (1 + math.log(n)) * self.idf[t]
            for stem, n in counts.items() for t in terms[stem][: grade(n, len(words)) + 1] if t >= 0
        }
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()} if norm else {}

    def search(self, vector: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        """The exact k nearest examples with a positive cosine: positions and cosines; ties to the lower position."""
        bound = np.zeros(self.blocks)
        for t, v in vector.items():
            at, most = self.bounds[t]
            bound[at] += v * most
        best_at, best, floor = np.empty(0, int), np.empty(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or bound[b] < floor - 1e-9:
                break
            scores = np.zeros(BLOCK)
            for t, v in vector.items():
                found = self.postings.get((t, int(b)))
                if found:
                    scores[found[0]] += v * found[1]
            hit = np.flatnonzero(scores > 0)
            best_at = np.concatenate([best_at, b * BLOCK + hit])
            best = np.concatenate([best, np.round(scores[hit], 9)])
            order = np.lexsort((best_at, -best))[: self.neighbours]
            best_at, best = best_at[order], best[order]
            floor = best[-1] if len(best) == self.neighbours else 0.0
        return best_at, best

    def score(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        at, cos = self.search(self.vector(text))
        w = cos ** self.power * np.where(self.toxic[at], self.label_weight[1], self.label_weight[0])
        total = (w * self.toxic[at]).sum() + self.prior_weight * self.prior
        return float(total / (w.sum() + self.prior_weight)), at, cos


def chi_square(a, n, pos: int, neg: int):
    """Of the table (has the term) x (label): ``a`` positives and ``n`` rows have it."""
    b, c, d = n - a, pos - a, neg - (n - a)
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(below > 0, (a * d - b * c) * (a * d - b * c) * (pos + neg) / below).otherwise(0.0)


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, per_label: int = 2000, chi: float = 30.0,
    least: int = 5, vocabulary: int = 4096, neighbours: int = 15, power: float = 4.0, prior_weight: float = 0.1,
) -> ToxicityModel:
    """Learn from the rows of ``docs`` for which ``learn`` holds and that ``labels`` marks.

    At most ``per_label`` different texts of each label are examples, and at most ``vocabulary`` terms
    are kept, those that differ most.  An id with several labels counts as toxic if one says so.
    """
    marked = (
        labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    rows = documents(docs)
    # the join carries a hash instead of the text; the sample's texts are fetched afterwards
    hashed = rows.filter(F.coalesce(learn, F.lit(False))).select("doc_id", F.xxhash64("text").alias("text")).join(marked, "doc_id")
    sample, totals = labelled_sample(hashed, "toxic", per_label)
    chosen = F.broadcast(sample.select("doc_id", "toxic", F.col("text").alias("h")))  # 2 x per_label rows at most
    picked = rows.withColumn("h", F.xxhash64("text")).join(chosen, ["doc_id", "h"]).dropDuplicates(["toxic", "h"]).select("doc_id", "text", "toxic")
    n_all = rows.count()

    def count_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        texts = {0: 0, 1: 0}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                texts[toxic] += 1
                counts, words = stem_counts(text)
                for stem, n in counts.items():
                    for g in range(grade(n, words) + 1):
                        pair = found.setdefault((stem, g), [0, 0])
                        pair[toxic] += 1
        found[(None, 0)] = [texts[0], texts[1]]
        items = list(found.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.int32()),
                 pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())],
                ["stem", "grade", "clean", "toxic"],
            )

    picked = picked.coalesce(8)  # a bounded sample
    counted = (
        picked.mapInArrow(count_sample, "stem string, grade int, clean long, toxic long")
        .groupBy("stem", "grade").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("stem").isNull() | (F.col("clean") + F.col("toxic") >= least))
    )
    head = counted.filter(F.col("stem").isNull()).first()
    neg, pos = (head["clean"], head["toxic"]) if head else (0, 0)
    terms = (
        counted.filter(F.col("stem").isNotNull())
        .withColumn("chi", chi_square(F.col("toxic").cast("double"), (F.col("clean") + F.col("toxic")).cast("double"), pos, neg))
        .filter(F.col("chi") >= chi).orderBy(F.desc("chi"), "stem", "grade").limit(vocabulary).collect()
    )
    numbers: dict = {}
    for i, r in enumerate(terms):
        numbers.setdefault(r["stem"], [-1] * GRADES)[r["grade"]] = i

    draft = ToxicityModel(numbers, np.ones(len(terms)), 0.0, np.empty(0), np.empty(0), (1.0, 1.0), 0, (), {}, neighbours, power, prior_weight)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(draft.vector(text).keys())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    df = np.zeros(len(terms))
    if terms:  # at most one row per term comes back
        for r in rows.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            df[r["term"]] = r["n"]
    draft = ToxicityModel(**{**draft.__dict__, "idf": np.log((1 + n_all) / (1 + df)) + 1})

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [draft.vector(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array([list(v) for v in found], pa.list_(pa.int32())),
             pa.array([list(v.values()) for v in found], pa.list_(pa.float64()))],
            ["doc_id", "toxic", "terms", "weights"],
        )

    examples = arrow_map(picked, weigh, "doc_id long, toxic int, terms array<int>, weights array<double>")
    # bounded: 2 x per_label sparse vectors; neighbours in the order share their strongest term
    kept = sorted(
        (r for r in examples.filter(F.size("terms") > 0).collect()),
        key=lambda r: (r["terms"][int(np.argmax(r["weights"]))], r["toxic"], r["doc_id"]),
    )
    postings: dict = {}
    for i, r in enumerate(kept):
        for t, w in zip(r["terms"], r["weights"]):
            at, ws = postings.setdefault((t, i // BLOCK), ([], []))
            at.append(i % BLOCK)
            ws.append(w)
    bounds: list = [([], []) for _ in terms]
    for (t, b), (_, ws) in postings.items():
        bounds[t][0].append(b)
        bounds[t][1].append(max(ws))
    rate = [totals.get(y, 0) / max(1, n) for y, n in ((0, neg), (1, pos))]
    base = rate[1] or 1.0
    return ToxicityModel(
        numbers, draft.idf, totals.get(1, 0) / max(1, sum(totals.values())),
        np.array([r["doc_id"] for r in kept], np.int64), np.array([r["toxic"] for r in kept], bool),
        (rate[0] / base, 1.0), -(-len(kept) // BLOCK),
        tuple((np.array(b, int), np.array(w)) for b, w in bounds),
        {k: (np.array(at), np.array(ws)) for k, (at, ws) in postings.items()},
        neighbours, power, prior_weight,
    )


def score(docs: DataFrame, model: ToxicityModel, evidence: int = 3, carry: tuple = ()) -> DataFrame:
    """Toxicity of whole texts: doc_id, score, evidence; one row per input row.

    ``docs``: doc_id, text; other columns are ignored unless ``carry`` names them.  The evidence lists the nearest examples as
    (doc_id, cosine, toxic).  Null, empty and word-free texts, and texts without a term of the
    vocabulary, have no neighbours and get the prior share of toxic rows (0 if nothing was learned).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        scores, near = [], []
        for text in batch.column("text").to_pylist():
            value, at, cos = m.score(text)
            scores.append(value)
            near.append([
                {"doc_id": int(m.ids[i]), "cosine": float(c), "toxic": bool(m.toxic[i])}
                for i, c in zip(at[:evidence], cos[:evidence])
            ])
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.bool_())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(near, kind), *map(batch.column, carry)],
            ["doc_id", "score", "evidence", *carry],
        )

    base = documents(docs, *(c for c in carry if c != "text"))
    kind = "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: boolean>>"
    return arrow_map(base, work, carried(kind, base, carry))
