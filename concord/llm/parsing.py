"""Document fingerprints from a locally consistent parse.

A text is parsed bottom up.  On every level runs of one symbol become a symbol of their own, deterministic coin tossing
(three rounds of "lowest bit in which a symbol differs from the one before it, and that bit") turns names into labels
below 8 of which neighbours differ, and a phrase begins wherever a label is larger than both its neighbours.  A phrase
is named by a hash of its symbols and is a symbol of the next level.  Where a phrase begins depends on a few symbols
around that place alone, so equal substrings get equal names away from their ends, whatever stands before them.

The fingerprint keeps, for short, middle and long phrases apart, minima of several hashes of the names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.words import long_ints, mixed, slices, span_hashes
from concord.session import settle

#: Places of a fingerprint given to phrases of the first level, of the second, and of all above.  A text that ends below
#: a level fills that level's places from the name of its whole.
PLACES = (8, 24, 32)
WIDTH = sum(PLACES)

_lowest = np.array([8 if not d else (d & -d).bit_length() - 1 for d in range(256)], np.uint8)
_odd = mixed(np.arange(WIDTH, dtype=np.uint64), 11) | np.uint64(1)
_flip = mixed(np.arange(WIDTH, dtype=np.uint64), 12)


def _without_runs(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each run of one symbol as one symbol, where runs begin, and each row's first one."""
    new = np.empty(len(symbols), bool)
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[first[:-1]] = True
    at = np.flatnonzero(new)
    if len(at) == len(symbols):
        return symbols, at, first
    size = np.diff(at, append=len(symbols))
    symbols, longer = symbols[at], np.flatnonzero(size > 1)
    symbols[longer] ^= (size[longer].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 8 * symbols.itemsize)).astype(symbols.dtype)
    return symbols, at, np.searchsorted(at, first)


def _labels(symbols: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Coin tossing: labels below 8; a row's first symbol is compared with its own opposite."""
    other = np.empty_like(symbols)
    other[1:] = symbols[:-1]
    other[heads] = ~symbols[heads]
    other ^= symbols
    bit = other & (~other + symbols.dtype.type(1))
    label = np.bitwise_count(bit - symbols.dtype.type(1)) << 1
    label |= (symbols & bit) != 0
    for _ in range(2):
        differs = np.empty_like(label)
        differs[1:] = label[1:] ^ label[:-1]
        differs[heads] = 1
        place = _lowest[differs]
        label = place << 1 | (label >> place & 1)
    return label


def level_up(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the phrases of non-empty rows of symbols, the symbol each begins at, and each row's first phrase.

    ``first`` has one more entry at the end.  A row of more than one symbol gets fewer phrases than symbols.
    """
    symbols, at, first = _without_runs(symbols, first)
    heads = first[:-1]
    label = _labels(symbols, heads)
    rises = label[1:] > label[:-1]
    begins = np.zeros(len(symbols), bool)
    np.greater(rises[:-1], rises[1:], out=begins[1:-1])
    begins[first[1:] - 1] = False
    begins[heads] = True
    starts = np.flatnonzero(begins)
    names = span_hashes(symbols.astype(np.uint64), starts, np.append(starts[1:], len(symbols)))
    return names, at[starts], np.searchsorted(starts, first)


def levels(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: rows that reach it, each one's first phrase (one more at the end), names, and code points they begin at.

    A row is left out once it is a single phrase; an empty one reaches no level.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = np.flatnonzero(size)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum(size[rows])])
    begin = first
    place = None
    while len(rows):
        symbols, at, first = level_up(symbols, first)
        place = at if place is None else place[at]
        yield rows, first, symbols, place - np.repeat(begin[:-1], np.diff(first))
        more = np.diff(first) > 1
        kept = np.repeat(more, np.diff(first))
        symbols, place, rows = symbols[kept], place[kept], rows[more]
        begin = np.append(begin[:-1][more], 0)
        first = np.concatenate([[0], np.cumsum(np.diff(first)[more])])


def sketch(texts: list[str]) -> np.ndarray:
    """A row of WIDTH 16-bit places for each text."""
    least = np.full((WIDTH, len(texts)), np.iinfo(np.uint64).max, np.uint64)
    band = np.repeat(np.arange(len(PLACES)), PLACES)
    for number, (rows, first, names, _) in enumerate(levels(texts)):
        for k in np.flatnonzero(band == min(number, len(PLACES) - 1)):
            low = np.minimum.reduceat((names ^ _flip[k]) * _odd[k], first[:-1])
            least[k, rows] = np.minimum(least[k, rows], low)
        if number + 1 < len(PLACES):
            alone = np.flatnonzero(np.diff(first) == 1)
            for k in np.flatnonzero(band > number):
                least[k, rows[alone]] = (names[first[alone]] ^ _flip[k]) * _odd[k]
    return (mixed(least) >> np.uint64(48)).astype(np.uint16).T


def _plain(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def phrases(docs: DataFrame, from_level: int = 2) -> DataFrame:
    """Every phrase of every text from a level on: doc_id, level, start and length in code points, name.

    Two texts that share a long substring share the names of the phrases inside it, so an equi-join on the name finds
    it.  Null and empty texts have no phrases; repeated rows give theirs again; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, texts = part.column("doc_id").fill_null(0).to_numpy(), part.column("text").to_pylist()
                nulls, size = part.column("doc_id").is_null().to_numpy(zero_copy_only=False), np.array([*map(len, texts)], np.int64)
                for number, (rows, first, names, start) in enumerate(levels(texts), 1):
                    if number < from_level:
                        continue
                    row = np.repeat(rows, np.diff(first))
                    end = np.append(start[1:], 0)
                    end[first[1:] - 1] = size[rows]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[row], mask=nulls[row]), pa.array(np.full(len(row), number, np.int32)),
                        pa.array(start), pa.array(end - start), pa.array(long_ints(names)),
                    ], ["doc_id", "level", "start", "length", "name"])

    return _plain(docs).mapInArrow(run, "doc_id bigint, level int, start bigint, length bigint, name bigint")


_FIELDS = (
    "kind string, part int, doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double, text string"
)


def _rows(kind: str, part: int, ids: list, texts: list[str] | None, **found) -> pa.RecordBatch:
    n = len(ids)
    given = {"kind": [kind] * n, "part": [part] * n, "doc_id": ids, "text": texts or [None] * n} | found
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    names = [f.split() for f in _FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(given.get(c, [None] * n), kinds[t]) for c, t in names], [c for c, _ in names])


def _compared(part: int, ids: list, texts: list[str], own: np.ndarray, following: list[str], theirs: np.ndarray) -> pa.RecordBatch:
    """Done rows: each text against its edited form and against the one that follows."""
    from hashlib import sha256

    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    changed = sketch(edited)
    return _rows(
        "done", part, ids, None, n_chars=[*map(len, texts)], edited_sha256=[sha256(t.encode("utf-8", "surrogatepass")).digest() for t in edited],
        fingerprint=[r.tobytes() for r in own], edited_fingerprint=[r.tobytes() for r in changed],
        near_edited=(own == changed).mean(1), near_next=(own == theirs).mean(1))


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range of ids in order: all but the last meet the one that follows; both end rows are handed on."""
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        for piece in slices(batch):
            ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
            own = sketch(texts)
            if last is None:
                yield _rows("first", part, ids[:1], texts[:1], fingerprint=[own[0].tobytes()])
            else:
                ids, texts, own = [last[0], *ids], [last[1], *texts], np.concatenate([last[2], own])
            if len(ids) > 1:
                yield _compared(part, ids[:-1], texts[:-1], own[:-1], texts[1:], own[1:])
            last = ids[-1], texts[-1], own[-1:]
    if last is not None:
        yield _rows("last", part, [last[0]], [last[1]], fingerprint=[last[2][0].tobytes()])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            own, theirs = (np.frombuffer(row[c], np.uint16)[None] for c in ("fingerprint", "next_fingerprint"))
            yield _compared(row["part"], [row["doc_id"]], [row["text"]], own, [row["next_text"]], theirs)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose second half is replaced by the next document's beginning.

    The next document is the one with the next smaller id; after the last comes the first.  Rows without an id come
    last, and rows of one id are ordered by a hash of their text, then the text.  Null text is empty.  Repeated rows give a
    row each; an only document follows itself.  Other columns are ignored.  A likeness is the share of equal places: 1
    for equal texts, two empty ones included.

    Texts are dealt once, by ranges of ids; a task goes along its range and holds one batch.  What lies across two ranges
    is one row per range, joined by the number of the range.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("_hash").asc()]
    dealt = _plain(docs).withColumn("_hash", F.xxhash64("text")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    made = settle(dealt.sortWithinPartitions(*order, "text").select("doc_id", "text").mapInArrow(_along, _FIELDS))
    begin = made.filter("kind = 'first'")
    by_range = Window.orderBy("part")  # over one number per range
    ranges = begin.select("part").select("part", F.coalesce(F.lead("part").over(by_range), F.first("part").over(by_range)).alias("_next"))
    ends = made.filter("kind = 'last'").select("part", "doc_id", "text", "fingerprint").join(ranges, "part").join(
        begin.select(F.col("part").alias("_next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")), "_next")
    across = ends.select("part", "doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_across, _FIELDS)

    def hexed(name: str) -> Column:
        return F.lower(F.hex(name)).alias(name)

    return made.filter("kind = 'done'").unionByName(across).select(
        "doc_id", "n_chars", hexed("edited_sha256"), hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")
