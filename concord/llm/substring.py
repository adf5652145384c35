"""Removal of passages that occur in an earlier document.

Anchors are hashes of ANCHOR words at the places whose number modulo PERIOD lies in a difference cover: for any two
places some shift below PERIOD takes both onto the cover, so two equal windows of WINDOW = ANCHOR + PERIOD - 1 words
always share an aligned anchor.  Only windows around an anchor that texts share are then extended to their full
length, hashed and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.words import Words, long_ints, slices, span_hashes, text_bytes, words_of
from concord.session import settle

WINDOW = 50
#: A perfect difference set: every shift but 0 is the difference of exactly one pair.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def covers(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sequence_hash(w: Words, h: np.ndarray) -> np.ndarray:
    """One hash per row for all its words."""
    return span_hashes(h, w.first[:-1], w.first[1:])


def _anchor_places(w: Words, size: int) -> np.ndarray:
    at = w.window_starts(size)
    return at[np.isin((at - w.first[w.row[at]]) % PERIOD, COVER)] if len(at) else at


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its number of words, the hash of its words, and SHA-256 of all its words."""
    names = ["doc_id", "text_hash", "n_words", "sequence", "all_sha256"]
    for batch in batches:
        for part in slices(batch):
            w = words_of(part.column("text"))
            sums = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in _raw(part)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(w.counts), pa.array(long_ints(_sequence_hash(w, w.hashes()))), pa.array(sums, pa.string())], names)


def _raw(part: pa.RecordBatch) -> list[bytes]:
    data, at = text_bytes(part.column("text"))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _anchors(size: int, with_place: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words_of(part.column("text"))
                h = w.hashes()
                at = _anchor_places(w, size)
                key, row = long_ints(w.window_hashes(h, at, size)), w.row[at]
                if with_place:
                    doc = np.asarray(part.column("doc_id").fill_null(0))[row]
                    out = [key, doc, long_ints(_sequence_hash(w, h))[row], (at - w.first[row]).astype(np.int32)]
                    ok = np.asarray(part.column("doc_id").is_valid())[row]
                    yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in out], ["anchor", "doc_id", "sequence", "place"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(long_ints(_sequence_hash(w, h))[row])], ["anchor", "sequence"])

    return run


def _marked(places: np.ndarray, n: int, before: int, after: int) -> np.ndarray:
    """Of n, those from ``before`` ahead of a place to ``after`` past it (the latter excluded)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(places - before, 0), 1)
    np.add.at(step, np.minimum(places + after, n), -1)
    return np.cumsum(step[:-1]) > 0


def _windows(size: int):
    """Hashes of the full windows that hold a shared anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch):
                places = batch.column("places").slice(done, part.num_rows).to_pylist()
                done += part.num_rows
                w = words_of(part.column("text"))
                h = w.hashes()
                sequence = long_ints(_sequence_hash(w, h))
                own = sequence == np.asarray(part.column("sequence"))
                ask = np.zeros(len(h), bool)
                for row, at in enumerate(places):
                    a, b = w.first[row], w.first[row + 1]
                    ask[a:b] = own[row] and _marked(np.array(at, np.int64), b - a, PERIOD - 1, 1)
                starts = w.window_starts(size)
                starts = starts[ask[starts]]
                row = w.row[starts]
                yield pa.RecordBatch.from_arrays([
                    pa.array(long_ints(w.window_hashes(h, starts, size))), pa.array(np.asarray(part.column("doc_id"))[row]),
                    pa.array(sequence[row]), pa.array((starts - w.first[row]).astype(np.int32))], ["window", "doc_id", "sequence", "start"])

    return run


def _cut(size: int, with_text: bool):
    """What stays of documents with found windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch):
                starts = batch.column("starts").slice(done, part.num_rows).to_pylist()
                done += part.num_rows
                removed, sums, texts = [], [], []
                sequence = long_ints(_sequence_hash(w := words_of(part.column("text")), w.hashes()))
                own = sequence == np.asarray(part.column("sequence"))
                part, starts = part.filter(pa.array(own)), [x for x, o in zip(starts, own, strict=True) if o]
                for raw, at in zip(_raw(part), starts, strict=True):
                    words = raw.split()
                    gone = _marked(np.array(at, np.int64), len(words), 0, size)
                    kept = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])
                    removed.append(int(gone.sum()))
                    sums.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("sequence"), pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())],
                    ["doc_id", "sequence", "n_removed", "kept_sha256", "kept_text"])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, text_hash (xxhash64 of the text, to find the row again).
    With ``with_text`` also kept_text where something was removed.

    Removed is each word covered by a window of ``window`` words that also starts in a document with a smaller doc_id;
    windows are those of the input.  Kept words are joined by one space.  Null and empty texts have no words.  A
    document with a null doc_id neither loses words nor makes others lose them; rows that repeat a doc_id don't remove
    from one another.  Other columns are ignored.
    """
    size = window - PERIOD + 1
    if size < 1:
        raise ValueError(f"a window must have at least {PERIOD} words")
    text = _text(docs)
    every = settle(text.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _summaries, "doc_id bigint, text_hash bigint, n_words bigint, sequence bigint, all_sha256 string"))
    # Of documents with the same words only the first takes part below: the later ones go as a whole.
    first = every.filter(F.col("n_words") >= window).groupBy("sequence", "n_words").agg(F.min("doc_id").alias("first_id"))
    first = settle(first)
    # Anchors that different word sequences share; copies of one text make none.
    shared = settle(text.mapInArrow(_anchors(size, False), "anchor bigint, sequence bigint").groupBy("anchor").agg(
        F.min("sequence").alias("least"), F.max("sequence").alias("most")).filter(F.col("least") != F.col("most")).select("anchor"))
    places = text.mapInArrow(_anchors(size, True), "anchor bigint, doc_id bigint, sequence bigint, place int").join(
        shared.hint("shuffle_hash"), "anchor").groupBy("doc_id", "sequence").agg(F.collect_list("place").alias("places"))
    places = settle(places.join(first.select("sequence", F.col("first_id").alias("doc_id")), ["doc_id", "sequence"]))
    chosen = settle(text.join(places, "doc_id"))
    windows = chosen.mapInArrow(_windows(window), "window bigint, doc_id bigint, sequence bigint, start int")
    least = settle(windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter(
        F.col("least") < F.col("most")).select("window", "least"))
    found = windows.join(least.hint("shuffle_hash"), "window").filter(F.col("doc_id") > F.col("least")).groupBy("doc_id", "sequence").agg(
        F.collect_list("start").alias("starts"))
    cut = settle(chosen.drop("places").join(found, ["doc_id", "sequence"]).mapInArrow(
        _cut(window, with_text), "doc_id bigint, sequence bigint, n_removed bigint, kept_sha256 string, kept_text string"))
    # dealt by the keys of the join first, so what stays of the texts is shuffled once for both steps
    cut = cut.repartition("doc_id", "sequence").distinct()
    nothing = hashlib.sha256(b"").hexdigest()
    out = every.join(first, ["sequence", "n_words"], "left").join(cut, ["doc_id", "sequence"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    out = out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        "text_hash", F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out if with_text else out.drop("kept_text")
