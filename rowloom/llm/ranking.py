"""Quality scores learned from preference pairs (Bradley-Terry).

In a pair the document labelled good is preferred to the one labelled bad. A document's worth is linear in statistics
of its text; the chance that one is preferred is the logistic function of the difference of worths, so the weights
minimise the logistic loss on feature differences. A document counts as good when its worth reaches a quantile of the
labelled worths, chosen among quantiles by balanced accuracy; scores are shifted so that this cutoff is ``THRESHOLD``.

The fit uses at most ``MAX_LABELLED`` labelled rows of each class (those with the smallest hash of the id) and
``PARTNERS`` pairs for each of them, on the driver: a documented bound that no other step has. All texts are scored
whole, on the executors, and read once.

Defined results: null and empty texts have zero statistics and are scored like any text; a null doc_id is never held
out and never labelled; repeated labels of an id that disagree count as bad; with labels of one class only, every
score is 0.5; repeated rows are scored each; an empty table gives no rows. Only doc_id and text are read; labels, lang,
source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .common import spread, text_slices

MAX_LABELLED, PARTNERS, RIDGE, THRESHOLD, SEED = 10_000, 20, 1e-3, 0.7, 17
FEATURES = (
    "symbols", "bangs", "capitals", "digits", "marks", "pipes", "stutter", "sameness", "line_repeats", "word_length", "short_words", "log_words", "line_words", "non_ascii", "symbols_any", "bangs_any", "stutter_any",
)
_SYMBOLS, _CAPITALS, _DIGITS, _MARKS = b"#*$%&|<>~^{}[]=\\@_", bytes(range(65, 91)), b"0123456789", b".,;:?"


def text_features(text: str | None) -> list[float]:
    """Bounded statistics of a whole text, in the order of FEATURES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, chars = max(1, len(words)), max(1, len(data) - sum(data.count(b) for b in b" \t\n\x0b\x0c\r"))
    count = lambda chosen: len(data) - len(data.translate(None, chosen))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    symbols, bangs, stutter = count(_SYMBOLS) / n, data.count(b"!") / n, sum(map(eq, words, words[1:])) / n
    soft = lambda x: x / (x + 0.1)
    return [
        min(symbols, 3.0), min(bangs, 3.0), count(_CAPITALS) / chars, count(_DIGITS) / chars, min(count(_MARKS) / n, 2.0), min(data.count(b"|") / n, 2.0), stutter,
        (1 - len(set(words)) / n) / math.log(n + 9), 1 - len(set(lines)) / max(1, len(lines)), min(chars / n, 20.0), sum(len(w) < 3 for w in words) / n, math.log(n), math.log1p(n / max(1, len(lines))),
        sum(len(w) for w in words if not w.isascii()) / chars, soft(symbols), soft(bangs), soft(stutter),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            x = pa.array([text_features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], ["doc_id", "x"])

    return spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))).mapInArrow(emit, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def pair_weights(good: np.ndarray, bad: np.ndarray, partners: int = PARTNERS, ridge: float = RIDGE, rounds: int = 50) -> np.ndarray:
    """Newton steps on the mean logistic loss of worth(good) - worth(bad) over ``partners`` pairs for each row."""
    rng = np.random.default_rng(SEED)
    n = max(len(good), len(bad)) * partners
    pick = lambda rows: rows[np.concatenate([rng.permutation(len(rows)) for _ in range(-(-n // len(rows)))])[:n]]
    d = pick(good) - pick(bad)
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w)), d.T @ p / n - ridge * w)
        w += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights of raw features, offset): worth = x . weights + offset, and 0 is the quantile cutoff."""
    every = np.concatenate([good, bad])
    mean, scale = every.mean(axis=0), every.std(axis=0)
    scale[scale < 1e-9] = np.inf
    w = pair_weights((good - mean) / scale, (bad - mean) / scale) / scale
    a, b = np.sort(good @ w), np.sort(bad @ w)
    cuts = np.quantile(every @ w, np.linspace(0.002, 0.998, 499))
    fair = 1 - np.searchsorted(a, cuts) / len(a) + np.searchsorted(b, cuts) / len(b)
    best = np.flatnonzero(fair >= fair.max() - 1e-12)
    return w, -float(cuts[best[len(best) // 2]])


def _sample(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """Vectors of the ``most`` rows with the smallest hashes ``o``.

    Hashes are uniform, so a threshold on them leaves little over ``most`` of the n rows before any are sorted: at
    twice the share and 100 more, and that fewer than ``most`` are left is beyond chance (all n are kept when n is small).
    """
    share = (2 * most + 100) / max(n, 1)
    if share < 1:
        rows = rows.where(F.col("o") < F.lit(int(share * 2**64) - 2**63))
    return np.array([r["x"] for r in rows.orderBy("o").limit(most).select("x").collect()])


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, worth: one row per document."""
    rows = materialise(features(docs), "features")
    known = labels.where(labels["doc_id"].isNotNull() & labels["quality"].isin(0, 1)).groupBy(labels["doc_id"].cast("long").alias("lid")).agg(F.min("quality").alias("q"))
    known = known.where(~held_out(F.col("lid")))
    taught = rows.join(known, rows["doc_id"] == F.col("lid")).select("q", "x", F.xxhash64("doc_id").alias("o"))
    sizes = {r["q"]: r["n"] for r in taught.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = {q: _sample(taught.where(F.col("q") == q), sizes.get(q, 0), max_labelled) for q in (1, 0)}
    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x")
    if len(sample[0]) and len(sample[1]):
        w, offset = fit(sample[1], sample[0])
        worth = F.lit(offset)
        for k, v in enumerate(w):
            worth = worth + F.get("x", F.lit(k)) * F.lit(float(v))
        score = 1 / (1 + F.exp(-(worth + F.lit(math.log(THRESHOLD / (1 - THRESHOLD))))))
    else:
        worth, score = F.lit(0.0), F.lit(0.5)
    return out.select("doc_id", "held_out", score.alias("score"), worth.alias("worth")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
