"""Packing token pieces into sequences by minimum bin slack.

Lengths are whole numbers up to the capacity, so the pieces are described by a histogram of at most ``capacity`` rows,
however many pieces there are.  Per bin, a bitset subset-sum finds the fullest combination of the lengths that are
left; it is then removed as often as its lengths last.  Each such step uses up at least one length, so the plan has no
more patterns than there are lengths.  Pieces take their places in the plan by their rank among those of equal length.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.words import distinct, slices, words_of
from concord.session import local_table, settle

CAPACITY = 4096
#: Words whose ids a worker remembers; then it forgets all of them.  Words of more bytes, such as whole texts without
#: a blank, are not remembered, so an entry has at most so many ids.
CACHE, LONGEST = 800_000, 64

_encoders: dict[str, Encoder] = {}


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Copies of each length whose sum comes closest to ``room`` from below, larger lengths first.

    Bit s of ``reach`` says that the sum s can be had.  Copies are offered in lots of 1, 2, 4, ...
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        left, lot = min(counts[length], room // length), 1
        while left:
            lot = min(lot, left)
            grown = (reach | reach << length * lot) & mask
            if grown != reach:
                steps.append((length, lot, reach))
                reach = grown
                if reach >> room:
                    break
            left -= lot
            lot *= 2
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for length, lot, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + lot
            total -= length * lot
    return used


def bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies)]) patterns; the largest length left opens each bin."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        used = fullest(lengths, counts, capacity - top)
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
        lengths = [k for k in lengths if counts[k]]
        out.append((times, sorted(used.items(), reverse=True)))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length, any other columns) with sequence_id and offset.

    Every sequence holds at most ``capacity``; a piece must not be longer.  Pieces of length 0 or null length get no
    place and are left out.  Columns that are named like the two new ones are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset").filter(F.col("length") > 0)
    # Rank within a length, without sending a frequent length to one task: rank within (length, share), then shares
    # laid one after another.
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in pieces.columns if c != "length"]
    placed = settle(pieces.withColumn("_share", F.pmod(F.xxhash64(*others) if others else F.monotonically_increasing_id(), F.lit(shares))))
    within = Window.partitionBy("length", "_share").orderBy(*others) if others else Window.partitionBy("length", "_share").orderBy("length")
    sizes = placed.groupBy("length", "_share").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1))
    ).select("length", "_share", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = placed.withColumn("_rank", F.row_number().over(within)).join(before, ["length", "_share"]).withColumn(
        "_rank", F.col("_rank") - 1 + F.col("before"))
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    if histogram and max(histogram) > capacity:
        raise ValueError("a piece is longer than a sequence")
    return _seat(spark, ranked, bins(histogram, capacity)).drop("_share", "_rank", "before")


def _seat(spark: SparkSession, ranked: DataFrame, plan: list[tuple[int, list[tuple[int, int]]]]) -> DataFrame:
    """Rank r of a length belongs to the pattern whose range of ranks holds r."""
    rows, taken, first_sequence = [], {}, 0
    for times, used in plan:
        at = 0
        for length, copies in used:
            begin = taken.get(length, 0)
            rows.append((int(length), int(begin), int(copies), int(first_sequence), int(at)))
            taken[length] = begin + copies * times
            at += length * copies
        first_sequence += times
    seats = local_table(spark, rows, "length bigint, begin bigint, copies bigint, first_sequence bigint, at bigint")
    # A length's ranges lie one after another, so a sorted list of their begins per length finds the range.
    lists = seats.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("begin", "copies", "first_sequence", "at"))).alias("seats"))
    joined = ranked.withColumn("length", F.col("length").cast("bigint")).join(F.broadcast(lists), "length")
    at = F.expr("filter(seats, s -> s.begin <= _rank)")
    joined = joined.withColumn("_seat", F.element_at(at, -1)).drop("seats")
    step = F.col("_rank") - F.col("_seat.begin")
    return joined.withColumn("sequence_id", F.col("_seat.first_sequence") + F.floor(step / F.col("_seat.copies"))).withColumn(
        "offset", F.col("_seat.at") + F.col("length") * (step % F.col("_seat.copies"))).drop("_seat")


#: Words made of these need no normalising but lower case, and split into the runs that PARTS finds.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Token ids of many texts at once; each distinct white-space separated run is encoded once and remembered.

    That is exact for a tokenizer that neither joins nor looks across white space, which ``by_word`` tries on loading;
    for any other one whole texts are encoded.  Runs of plain letters, digits and signs go to the vocabulary's model
    directly where ``direct`` holds (lower case, split by kind of character, byte-level letters), others through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.words: dict[int, bytes] = {}
        self.parts: dict[str, bytes] = {}
        probe = "Ab's\tcd  12é\u0301 ¿x\nΣΑΣ <|endoftext|>z  q r"
        self.direct = False
        self.by_word = self._whole(probe) == b"".join(map(self._whole, probe.split()))
        tries = "Über-GRÖßE! 12a3,b_c ÿÀ~{x}$$ [Éa]***"
        self.direct = self.by_word and all(self._direct(w) == self._whole(w) for w in tries.split())

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _direct(self, word: str) -> bytes:
        out, known = [], self.parts
        for part in _PARTS.findall(word.lower()):
            ids = known.get(part)
            if ids is None:
                if len(known) >= CACHE:
                    known.clear()
                named = part.encode().decode("latin-1").translate(self.letters)
                ids = struct.pack(f"<{len(made := self.tokenizer.model.tokenize(named))}I", *[t.id for t in made])
                if len(named) <= LONGEST:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        return self._direct(word) if self.direct and _PLAIN.fullmatch(word) and "<|" not in word else self._whole(word)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, and where each text's ids begin (one more at the end)."""
        if not self.by_word:
            each = [np.frombuffer(self._whole(t or ""), "<u4") for t in column.to_pylist()]
            return np.concatenate([*each, np.zeros(0, "<u4")]), np.cumsum([0, *map(len, each)])
        w = words_of(column)
        found, at, inverse = distinct(w.hashes())
        known, raw = self.words, w.data.tobytes()
        if len(known) + len(found) > CACHE:
            known.clear()
        out = list(map(known.get, found.tolist()))
        missing = [k for k, v in enumerate(out) if v is None]
        places = zip(missing, found[missing].tolist(), w.starts[at[missing]].tolist(), w.ends[at[missing]].tolist(), strict=True)
        for k, key, start, end in places:
            out[k] = self._word(raw[start:end].decode())
            if end - start <= LONGEST:
                known[key] = out[k]
        sizes = np.fromiter(map(len, out), np.int64, len(out)) // 4
        ids = np.frombuffer(b"".join(out), "<u4")
        begins = np.cumsum(sizes) - sizes
        each = sizes[inverse]
        total = np.concatenate([[0], np.cumsum(each)])
        gathered = ids[np.repeat(begins[inverse] - total[:-1], each) + np.arange(total[-1])]
        return gathered, total[w.first]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32 and, if asked for, its ids.

    Null text is empty; every document ends with ``end_id``, so an empty one still gives a piece of length 1.  A
    document longer than ``capacity`` is cut into pieces of that length, the last one shorter.  ``ids`` are
    little-endian unsigned 32-bit numbers.  Other columns are ignored; repeated rows give repeated pieces.
    """
    fields = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                ids, at = own.ids(part.column("text"))
                out: list[list] = [[], [], [], [], [], []]
                for doc, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(whole), capacity)):
                        data = whole[start : start + capacity].tobytes()
                        for column, value in zip(out, (doc, k, start, len(data) // 4, zlib.crc32(data), data if keep_ids else None), strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if keep_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], kinds[:n], strict=True)], names[:n])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, fields)
