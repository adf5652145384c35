"""Document quality from overlapping heuristics, without labels.

Heuristic labellers vote "bad" or abstain.  Expectation-maximisation over the counts of their vote patterns estimates
how often each votes on good and on bad documents; the posteriors are the targets of a linear scorer over hashed
features, which then judges every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.words import Words, mixed, slices, words_of

#: Labellers: name of the measure and the value from which (or below which) it votes "bad".
VOTES = {
    "sign_words": 0.20, "sign_bytes": 0.20,          # words that end in runs of signs; share of sign bytes
    "capitals": 0.50, "shouted": 0.25,               # capitals among letters; words of capitals and "!!"
    "same_again": 0.15, "few_words": -0.25,          # word equal to the one before; distinct among the words
    "grams_again": 0.30, "most_common": 0.35,        # repeated runs of five words; share of the commonest word
    "bars": 0.10, "cells": 0.10,                     # words that are one sign; words between two such words
}
NAMES = list(VOTES)
#: Words below which measures of repetition, signs and capitals abstain.
ENOUGH_WORDS = 12
BUCKETS = 4096
#: Documents whose features are held at once.
FEATURE_ROWS = 512
#: Rows that the scorer is fitted on, at most about.
SAMPLE_ROWS = 12_000
ROUNDS, STEPS = 200, 300

_class = np.zeros(256, np.uint8)  # kinds of bytes: 0 other signs, 1 small, 2 capital, 3 digit, 4 non-ASCII, then signs
_class[97:123], _class[65:91], _class[48:58], _class[128:] = 1, 2, 3, 4
for _k, _c in enumerate(b".,!?*&$%#|-'\"():;/=<>_@+"):
    _class[_c] = 5 + _k
_sign = (_class == 0) | (_class >= 5)


@dataclass
class Model:
    """Weights of the hashed features and what EM found: prior of "bad", and each labeller's votes by class."""

    weights: np.ndarray
    prior: float
    good: np.ndarray
    bad: np.ndarray


def _share(values: np.ndarray, row: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    return np.bincount(row, values, n) / np.maximum(total, 1)


def _running(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, dtype=np.int32, out=out[1:])
    return out


def measures(w: Words) -> np.ndarray:
    """One row per document, one column per labeller's measure; documents without words have zeros."""
    n, data, row = len(w.counts), w.data, w.row
    words = w.counts.astype(float)
    size = w.ends - w.starts
    at = np.concatenate([w.starts, [len(data)]])
    kind = _class[data]
    ink, lower = _running(_sign[data] & (data > 32)), _running(kind == 1)
    # UTF-8 capitals of Latin-1 (0xC3 0x80-0x9E) count as capitals, other non-ASCII letters as small.
    wide = np.zeros(len(data), bool)
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = _running(wide | (kind == 2))
    signs = ink[w.ends] - ink[w.starts]
    uppers, lowers = upper[w.ends] - upper[w.starts], lower[w.ends] - lower[w.starts]
    h = w.hashes()
    last, before = data[at[:-1] + size - 1] if len(size) else data[:0], data[np.maximum(w.ends - 2, 0)]
    run = (size >= 3) & _sign[last] & (last == before)
    one = (size == 1) & _sign[last]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    between = np.zeros(len(h), bool)
    between[1:-1] = one[:-2] & one[2:] & ~one[1:-1] & (row[:-2] == row[2:])
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    begins = np.flatnonzero(new)
    runs = np.diff(np.append(begins, len(key)))
    of = (key[begins] >> np.uint64(48)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, runs)
    different = np.bincount(of, minlength=n)
    five = w.window_starts(5)
    gram = w.window_hashes(h, five, 5)
    gram_key = np.sort((row[five].astype(np.uint64) << np.uint64(48)) | (gram >> np.uint64(16)))
    gram_new = np.ones(len(gram_key), bool)
    gram_new[1:] = gram_key[1:] != gram_key[:-1]
    gram_row = (gram_key >> np.uint64(48)).astype(np.int64)
    grams = np.bincount(gram_row, minlength=n)
    letters = np.bincount(row, uppers + lowers, n)
    enough = words >= ENOUGH_WORDS
    out = np.stack([
        _share(run, row, n, words), np.where(enough, _share(signs, row, n, np.bincount(row, size, n)), 0),
        np.where(enough, np.bincount(row, uppers, n) / np.maximum(letters, 1), 0), _share((uppers > 0) & (lowers == 0) & run, row, n, words),
        np.where(enough, _share(again, row, n, words), 0), np.where(enough, different / np.maximum(words, 1), 1),
        np.where(enough, (grams - np.bincount(gram_row, gram_new, n)) / np.maximum(grams, 1), 0),
        np.where(enough, most / np.maximum(words, 1), 0), _share(one, row, n, words), _share(between, row, n, words),
    ], axis=1)
    return out


def votes(values: np.ndarray) -> np.ndarray:
    """1 where a labeller votes "bad"."""
    cut = np.array([VOTES[n] for n in NAMES])
    return np.where(cut >= 0, values >= cut, values <= -cut).astype(np.int64)


def features(w: Words, values: np.ndarray) -> np.ndarray:
    """Dense hashed features of a slice: shares of word shapes, and which tenth each measure falls into."""
    n, data = len(w.counts), w.data
    size = w.ends - w.starts
    first, before, last = (_class[data[np.maximum(at, 0)]].astype(np.int64) for at in (w.starts, w.ends - 2, w.ends - 1))
    shape = ((first * 64 + before) * 64 + last) * 16 + np.minimum(size, 12)
    out = np.zeros((n, BUCKETS))
    bucket = (mixed(shape.astype(np.uint64), 1) % np.uint64(BUCKETS)).astype(np.int64)
    counted = np.bincount(w.row * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    out += counted / np.maximum(w.counts, 1)[:, None]
    step = np.minimum((values * 10).astype(np.int64), 10)
    for k in range(values.shape[1]):
        place = (mixed((step[:, k] + 16 * k).astype(np.uint64), 2) % np.uint64(BUCKETS)).astype(np.int64)
        out[np.arange(n), place] += 1
    out[:, 0] += 1  # constant
    return out


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior of "bad" and each labeller's chance to vote, on good and on bad documents.

    A labeller is taken to vote more often on bad documents; chances stay within 0.001 and 0.999.
    """
    p = np.array([0.02, 0.60, 0.95])[np.minimum(patterns.sum(axis=1), 2)]  # to begin with: by the number of votes
    prior, good, bad = 0.0, np.zeros(0), np.zeros(0)
    for _ in range(rounds):
        in_bad, in_good = counts * p, counts * (1 - p)
        prior = float(np.clip((in_bad.sum() + 1) / (counts.sum() + 2), 0.001, 0.5))
        bad = np.clip((in_bad @ patterns + 1) / (in_bad.sum() + 2), 0.001, 0.999)
        good = np.clip((in_good @ patterns + 0.01) / (in_good.sum() + 2), 0.0005, 0.999)
        good = np.minimum(good, bad)
        p = _posterior(patterns, prior, good, bad)
    return prior, good, bad


def _posterior(patterns: np.ndarray, prior: float, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    def log(p: np.ndarray) -> np.ndarray:
        return patterns @ np.log(p) + (1 - patterns) @ np.log(1 - p)

    return 1 / (1 + np.exp(np.clip(np.log(1 - prior) + log(good) - np.log(prior) - log(bad), -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights by accelerated gradient descent on the cross entropy, with a little shrinkage."""
    weights = np.zeros(x.shape[1])
    ahead, rate = weights, 4.0 / max(float((x**2).sum(axis=1).max(initial=1)), 1.0)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -60, 60)))
        new = ahead - rate * (x.T @ (p - y) / len(y) + 1e-5 * ahead)
        ahead = new + k / (k + 3) * (new - weights)
        weights = new
    return weights


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Votes of every document for EM; the scorer on about ``sample_rows`` documents chosen by a hash of id and text.

    The driver gets one row per vote pattern (2**10 at most) and the weights.
    """
    text = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("pick"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                pattern = votes(measures(words_of(part.column("text")))) @ (1 << np.arange(len(NAMES)))
                found, counts = np.unique(pattern, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], ["pattern", "n"])

    rows = text.select("text").mapInArrow(vote, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    rows.sort()
    number = np.array([r[0] for r in rows], np.int64)
    counts = np.array([r[1] for r in rows], float)
    if not len(rows):
        return Model(np.zeros(BUCKETS), 0.1, np.full(len(NAMES), 0.01), np.full(len(NAMES), 0.5))
    prior, good, bad = expectation_maximisation(number[:, None] >> np.arange(len(NAMES)) & 1, counts)

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=FEATURE_ROWS):
                w = words_of(part.column("text"))
                values = measures(w)
                x = features(w, values)
                at, bucket = np.nonzero(x)
                lists = pa.ListArray.from_arrays(np.searchsorted(at, np.arange(len(x) + 1)).astype(np.int32), pa.array(bucket))
                shares = pa.ListArray.from_arrays(lists.offsets, pa.array(x[at, bucket]))
                target = _posterior(votes(values), prior, good, bad)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int64)), pa.array(target), lists, shares], ["one", "target", "bucket", "share"])

    def solve(table: pa.Table) -> pa.Table:
        x = np.zeros((table.num_rows, BUCKETS), np.float32)
        bucket, share = table["bucket"].combine_chunks(), table["share"].combine_chunks()
        x[np.repeat(np.arange(len(x)), np.asarray(bucket.value_lengths())), np.asarray(bucket.flatten())] = np.asarray(share.flatten())
        used = np.flatnonzero(x.any(axis=0))
        weights = np.zeros(BUCKETS)
        weights[used] = logistic(x[:, used], np.asarray(table["target"]))
        return pa.table({"bucket": np.arange(BUCKETS), "weight": weights})

    whole = 1 << 40
    part = min(whole, int(whole * sample_rows / max(counts.sum(), 1)))
    chosen = text.filter(F.pmod(F.col("pick"), F.lit(whole)) < part).select("text")
    fitted = chosen.mapInArrow(example, "one bigint, target double, bucket array<bigint>, share array<double>").groupBy("one").applyInArrow(
        solve, "bucket bigint, weight double").collect()
    weights = np.zeros(BUCKETS)
    for bucket, weight in fitted:
        weights[bucket] = weight
    return Model(weights, prior, good, bad)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with quality_score (0 to 1, higher: better) and quality_keep (score >= 0.5).

    A text without words, null included, has no evidence against it in the votes and gets the score of its constant
    features.  Columns that are named like the two new ones are replaced.
    """
    docs = docs.drop("quality_score", "quality_keep")
    names = docs.columns
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema] + ["quality_score double", "quality_keep boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=FEATURE_ROWS):
                w = words_of(part.column("text"))
                good = 1 / (1 + np.exp(np.clip(features(w, measures(w)) @ model.weights, -60, 60)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(good), pa.array(good >= 0.5)], [*names, "quality_score", "quality_keep"])

    return docs.mapInArrow(run, schema)
