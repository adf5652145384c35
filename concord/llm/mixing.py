"""A language model that mixes hashed-context bit predictors, and the scores of texts under it.

Tokens are coded as bits.  Frequent tokens have a prefix code of their own; any other token takes the code of "rare"
and is then named by its count in the corpus or, if the corpus lacks it, spelled letter by letter.  Every bit has
several predictions, from counts under hashed contexts of the whole training corpus and from what followed the same
two tokens earlier in the document.  Their logits are summed with weights that a gate chooses; weights, and a last
stage that scales and shifts the sum, are refined as the document goes on.  The logarithms of the mixed
probabilities add up to the score: ``-score * log2(10) / bytes`` are bits per byte.

Counts of all tokens grow with the corpus and meet the documents in a join.  Only tokens with at least one occurrence
in SHARE tokens, hence at most SHARE of them, and context tables of a fixed size are sent to every task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.words import Words, distinct, long_ints, mixed, slices, words_of
from concord.session import settle

#: A token is frequent with one occurrence in SHARE tokens (then there are at most so many of them) and LEAST at least.
SHARE, LEAST = 1 << 20, 8
#: Slots of each context table, for bits of tokens and for bits of letters.
SLOTS, LETTER_SLOTS = 1 << 19, 1 << 18
CONTEXTS, LETTER_CONTEXTS = 2, 3
#: Most frequent tokens: the last two of them are a context, which tells languages and styles apart.
COMMON = 64
#: Counters in a row of a table on its way; partial tables that one task adds up.
CHUNK, FAN_IN = 1 << 13, 64
#: Weights at a document's start: whole corpus, common tokens, token before, earlier in the document.
START = np.array([0.20, 0.70, 0.30, 1.00])
LETTER_WEIGHTS = (0.35, 0.35, 0.45)
#: Lengths of a run of right predictions, and depths of a bit, that choose the weights.
RUNS, DEPTHS = np.array([0, 1, 2, 4, 16]), np.array([2, 6])
#: Logits of "the same token as last time", by run.
TRUST = np.array([0.0, 0.5, 2.0, 3.0, 4.5, 6.0])
#: Tokens before the first update and at most between two; curvature that the starting weights count for; pace.
FIRST_BLOCK, LAST_BLOCK, INERTIA, PACE = 8, 512, 20.0, 0.6
#: Mixed logits stay within.
LIMIT = 14.0

END_HASH = np.uint64(0x656E64)
_log2_10 = np.log2(10)


def prefix_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Huffman code: bits of symbol s are places first[s] to first[s + 1] of (node, bit); and each node's chance of 1."""
    n = len(counts)
    if n == 1:
        return np.zeros(2, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int8), np.zeros(0)
    heap = [(int(c), s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side, one = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64), np.zeros(n - 1)
    for node in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = node
        side[y] = 1
        one[node - n] = (b + 0.5) / (a + b + 1)
        heapq.heappush(heap, (a + b, node))
    nodes, bits, first = [], [], [0]
    for s in range(n):
        at, path = s, []
        while at != 2 * n - 2:
            path.append((parent[at] - n, side[at]))
            at = parent[at]
        path.reverse()
        nodes += [p[0] for p in path]
        bits += [p[1] for p in path]
        first.append(len(nodes))
    return np.array(first, np.int32), np.array(nodes, np.int32), np.array(bits, np.int8), one


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def table_logits(table: np.ndarray) -> np.ndarray:
    """Logits of (zeros, ones) counts, drawn to 0 where there are few."""
    total = table.sum(axis=-1).astype(np.float64)
    return (logit((table[..., 1] + 0.4) / (total + 0.8)) * total / (total + 3)).astype(np.float32)


@dataclass
class Model:
    """What every task gets.  Symbols are ranks of the frequent tokens; the last symbol stands for all rare ones."""

    hashes: np.ndarray            # of the frequent tokens, ascending
    symbols: np.ndarray           # their symbols
    counts: np.ndarray            # by symbol, the rare one last
    code: tuple
    letter_code: tuple
    total: int = 0                # tokens of the training corpus
    different: int = 0            # distinct ones
    once: int = 0                 # distinct ones that occur once
    tables: np.ndarray = field(default_factory=lambda: np.zeros((CONTEXTS, SLOTS), np.float32))
    letter_tables: np.ndarray = field(default_factory=lambda: np.zeros((LETTER_CONTEXTS, LETTER_SLOTS), np.float32))

    @property
    def rare(self) -> int:
        return len(self.counts) - 1

    def symbol(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        if not len(self.hashes):
            return np.full(len(hashes), self.rare)
        return np.where(self.hashes[at] == hashes, self.symbols[at], self.rare)

    def unseen_share(self) -> float:
        """Chance that a rare token is a new one, from those that occurred once."""
        rare = float(self.counts[-1])
        return min(max((self.once + 1) / (rare + 2), 1e-6), 0.5)


@dataclass
class Tokens:
    """Tokens of a slice, each text's words and one end: hash, symbol, row, place in the row, first token of each row."""

    hash: np.ndarray
    symbol: np.ndarray
    row: np.ndarray
    place: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(w: Words, model: Model) -> Tokens:
        n = len(w.counts)
        first = w.first + np.arange(n + 1)
        h = np.empty(first[-1], np.uint64)
        h[np.arange(len(w.row)) + w.row] = w.hashes()
        h[first[1:] - 1] = END_HASH
        row = np.repeat(np.arange(n), np.diff(first))
        return Tokens(h, model.symbol(h), row, np.arange(len(h)) - first[row], first)


def token_contexts(t: Tokens) -> np.ndarray:
    """Hashed contexts of each token: the last two common tokens, and the token before."""
    at = np.arange(len(t.hash))
    common = t.symbol < COMMON

    def last_before(marked: np.ndarray) -> np.ndarray:
        """The last marked place before each place of the same row, or -1."""
        seen = np.maximum.accumulate(np.where(marked, at, -1))
        before = np.concatenate([[-1], seen[:-1]])
        return np.where(before >= t.first[t.row], before, -1)

    one = last_before(common)
    two = np.where(one >= 0, one[one], -1)
    pair = (np.where(one >= 0, t.symbol[one], COMMON) * (COMMON + 1) + np.where(two >= 0, t.symbol[two], COMMON)).astype(np.uint64)
    before = np.where(t.place > 0, t.hash[np.maximum(at - 1, 0)], np.uint64(0))
    return np.stack([mixed(pair, 1), mixed(before, 2)])


def slots(context: np.ndarray, node: np.ndarray, count: int) -> np.ndarray:
    """Slot of a context at a node of the code."""
    h = (context + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(40)).astype(np.int64) & (count - 1)


def spread(code: tuple, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each bit of the symbols' codes: number of the symbol in the list, depth, node, bit."""
    first, nodes, bits, _ = code
    begin = first[symbols]
    size = first[symbols + 1] - begin
    of = np.repeat(np.arange(len(symbols), dtype=np.int32), size)
    until = np.cumsum(size, dtype=np.int64)
    at = np.arange(len(of)) + np.repeat(begin - (until - size), size)
    return of, (at - begin[of]).astype(np.int32), nodes[at], bits[at]


def earlier(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place after the last occurrence of the two tokens before (or -1), whether it foretells this one, and the run of
    such places that did so just before."""
    n = len(t.hash)
    at = np.arange(n)
    key = mixed(t.hash[np.maximum(at - 1, 0)] * np.uint64(3) + mixed(t.hash[np.maximum(at - 2, 0)], 5), 6)
    key = t.row.astype(np.uint64) << np.uint64(48) | key >> np.uint64(16)
    order = np.argsort(key, kind="stable")
    same = np.zeros(n, bool)
    same[1:] = key[order][1:] == key[order][:-1]
    last = np.full(n, -1)
    last[order[1:]] = np.where(same[1:], order[:-1], -1)
    last[(t.place < 2) | (last >= 0) & (t.place[np.maximum(last, 0)] < 2)] = -1
    hit = (last >= 0) & (t.hash[np.maximum(last, 0)] == t.hash)
    missed = np.maximum.accumulate(np.where(hit, -1, at))
    run = np.zeros(n, np.int64)
    run[1:] = at[:-1] - missed[:-1]
    return last, hit, np.where(t.place == 0, 0, run)


class Letters:
    """Rare words as letters: bytes and a stop, coded by the letters' code, each bit under three contexts."""

    STOP = 0x20  # never part of a word

    @staticmethod
    def bits(w: Words, words: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each bit: number of its word in the list, node, bit, and slots under each context."""
        size = w.ends[words] - w.starts[words] + 1
        of = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        stop = place == size[of] - 1
        letter = np.where(stop, Letters.STOP, w.data[np.minimum(w.starts[words][of] + place, len(w.data) - 1)]).astype(np.int64)
        back = lambda k: np.where(place >= k, letter[np.maximum(np.arange(len(of)) - k, 0)], 0).astype(np.uint64)
        one, two, three, four = (back(k) for k in (1, 2, 3, 4))
        contexts = [mixed(one | two << np.uint64(8), 1), mixed(one | two << np.uint64(8) | three << np.uint64(16), 2),
                    mixed(one | two << np.uint64(8) | three << np.uint64(16) | four << np.uint64(24) | (np.minimum(place, 15).astype(np.uint64) << np.uint64(32)), 3)]
        letter_of, _, node, bit = spread(model.letter_code, letter)
        return of[letter_of], node, bit, np.stack([slots(c[letter_of], node, LETTER_SLOTS) for c in contexts])

    @staticmethod
    def log10(w: Words, words: np.ndarray, model: Model) -> np.ndarray:
        """Spelling's probability for each word of the list: the contexts' logits under fixed weights."""
        of, _, bit, at = Letters.bits(w, words, model)
        x = sum(LETTER_WEIGHTS[k] * model.letter_tables[k][at[k]] for k in range(LETTER_CONTEXTS))
        x = np.clip(x, -LIMIT, LIMIT)
        return np.bincount(of, -np.logaddexp(0, np.where(bit == 1, -x, x)), len(words)) / np.log(10)


def blocks(place: np.ndarray) -> np.ndarray:
    """Block of a token by its place: they grow by about four tenths from FIRST_BLOCK tokens on, up to LAST_BLOCK."""
    grown = (2 * np.log2(place / (2 * FIRST_BLOCK) + 1)).astype(np.int64)
    edge = 2 * FIRST_BLOCK * (LAST_BLOCK // FIRST_BLOCK)
    last = int(2 * np.log2(edge / (2 * FIRST_BLOCK) + 1))
    return np.where(place < edge, grown, last + 1 + (place - edge) // LAST_BLOCK)


def mix(t: Tokens, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the probability of each row's symbols (and of "again" for rare tokens), and which rare tokens remain to
    be named.  Rows don't influence each other."""
    n = len(t.first) - 1
    last, hit, run = earlier(t)
    block = blocks(t.place)
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
    contexts = token_contexts(t)
    chance = logit(np.clip(model.code[3], 1e-6, 1 - 1e-6)).astype(np.float32)
    first, nodes, bits, _ = model.code
    run_class = np.searchsorted(RUNS, run, "right").astype(np.int32)
    told, said = last >= 0, t.symbol[np.maximum(last, 0)]
    deep = len(DEPTHS) + 1
    gates = len(TRUST) * deep
    depth_class = np.searchsorted(DEPTHS, np.arange(int(np.diff(first).max(initial=0)) + 1), "right").astype(np.int32)
    trust = TRUST.astype(np.float32)
    weights = np.tile(START, (n * gates, 1)).T.copy()
    curve = np.full((4, n * gates), INERTIA)
    stretch, stretch_curve = np.ones(n), np.full(n, INERTIA)
    shift, shift_curve = np.zeros(n), np.full(n, INERTIA)
    out = np.zeros(n)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        tokens = order[a:b]
        of, depth, node, bit = spread(model.code, t.symbol[tokens])
        if not len(of):
            continue
        gate = (t.row[tokens] * gates).astype(np.int32)[of] + depth_class[depth]
        # Bits of tokens after a known pair, as long as they agree with the token that followed it last time.
        again = np.zeros(len(of), np.float32)
        at = np.flatnonzero(told[tokens][of])
        token = tokens[of[at]]
        there = first[said[token]] + depth[at]
        inside = there < first[said[token] + 1]
        at, token, there = at[inside], token[inside], there[inside]
        agree = nodes[there] == node[at]
        at, token, there = at[agree], token[agree], there[agree]
        again[at] = np.where(bits[there] == 1, trust[run_class[token]], -trust[run_class[token]])
        gate[at] += run_class[token] * deep
        # Bits of one gate and hence of one row stand together, so that sums are sums of stretches.
        # Two bytes are sorted by counting, which most slices allow.
        ranked = np.argsort(gate.astype(np.uint16) if n * gates <= 1 << 16 else gate, kind="stable")
        gate, of, node = gate[ranked], of[ranked], node[ranked]
        s = np.where(bit[ranked] == 1, np.float32(1), np.float32(-1))
        xs = np.empty((4, len(of)), np.float32)
        xs[0], xs[3] = chance[node], again[ranked]
        for k in range(CONTEXTS):
            xs[1 + k] = model.tables[k][slots(contexts[k][tokens][of], node, SLOTS)]
        begin = np.flatnonzero(np.diff(gate, prepend=-1))
        g, size = gate[begin], np.diff(begin, append=len(of))
        r = g // gates
        one_by_one = lambda v: np.repeat(v.astype(np.float32), size)  # noqa: E731, B023
        sums = lambda v: np.add.reduceat(v, begin, axis=-1)  # noqa: E731, B023
        inner = one_by_one(weights[0, g]) * xs[0]
        for k in range(1, 4):
            inner += one_by_one(weights[k, g]) * xs[k]
        z = one_by_one(stretch[r]) * inner + one_by_one(shift[r])
        np.clip(z, -LIMIT, LIMIT, out=z)
        against = np.exp(-s * z)
        wrong = against / (1 + against)
        out -= np.bincount(r, np.add.reduceat(np.log1p(against), begin, dtype=np.float64), n)
        error, flat = s * wrong, wrong * (1 - wrong)
        slopes, flats = error * xs, flat * xs
        flats *= xs
        curve[:, g] += sums(flats)
        weights[:, g] += PACE * sums(slopes) / curve[:, g]
        stretch_curve += np.bincount(r, sums(flat * inner * inner), n)
        stretch += PACE * np.bincount(r, sums(error * inner), n) / stretch_curve
        shift_curve += np.bincount(r, sums(flat), n)
        shift += PACE * np.bincount(r, sums(error), n) / shift_curve
    # A rare token that the document foretells: one more bit says whether it is that one.
    asked = (t.symbol == model.rare) & (last >= 0) & (t.symbol[np.maximum(last, 0)] == model.rare)
    where = np.flatnonzero(asked)
    key = t.row[where] * len(TRUST) + 1 + np.searchsorted(RUNS, run[where], "right") - 1
    yes = hit[where]
    # Adaptive counts of the document itself, starting from the trust in a run: occurrences before this one.
    order = np.argsort(key, kind="stable")
    ranked, before = yes[order].astype(float), np.zeros(len(order))
    begin = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, bool)
    total = np.cumsum(ranked) - ranked
    start = np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    before = total - (total[start] if len(order) else 0)
    seen = np.arange(len(order)) - start
    prior = 1 / (1 + np.exp(-TRUST[key[order] % len(TRUST)]))
    p = (before + 2 * prior) / (seen + 2)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    out += np.bincount(t.row[where][order], np.log(np.where(yes[order], p, 1 - p)), n)
    return out / np.log(10), (t.symbol == model.rare) & ~(asked & hit)


def learn(docs: DataFrame, train: Column) -> tuple[Model, DataFrame]:
    """The model of the rows for which ``train`` holds, and the written table (token, n) of all their tokens."""
    text = docs.filter(train).select(F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h = words_of(part.column("text"), lower=True).hashes()
                found, at, number = distinct(np.append(h, END_HASH))
                n = np.bincount(number, minlength=len(found))
                n[found == END_HASH] += part.num_rows - 1
                yield pa.RecordBatch.from_arrays([pa.array(long_ints(found)), pa.array(n)], ["token", "n"])

    table = settle(text.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")))
    total, different, once = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1))).first()
    rows = table.filter((F.col("n") * SHARE >= total) & (F.col("n") >= LEAST)).toArrow()  # at most SHARE rows
    h = np.asarray(rows["token"].combine_chunks()).astype(np.int64).view(np.uint64)
    n = np.asarray(rows["n"].combine_chunks()).astype(np.int64)
    ranked = np.lexsort((h, -n))
    counts = np.append(n[ranked], max(total - n.sum(), 1))
    order = np.argsort(h[ranked])
    letters = text.mapInArrow(_letter_counts, "letter bigint, n bigint").groupBy("letter").agg(F.sum("n")).collect()
    letter_counts = np.ones(256)
    for letter, found in letters:
        letter_counts[letter] += found
    model = Model(h[ranked][order], order, counts, prefix_code(counts), prefix_code(letter_counts), int(total), int(different), int(once))
    raw, letter_raw = _tables(text, model)
    model.tables, model.letter_tables = table_logits(raw), table_logits(letter_raw)
    return model, table


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = np.zeros(256, np.int64)
    for batch in batches:
        for part in slices(batch):
            w = words_of(part.column("text"), lower=True)
            own += np.bincount(w.data, minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(own)], ["letter", "n"])


def _tables(text: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) counts under all contexts: each task counts its documents, tasks are added up chunk by chunk."""
    sent = text.sparkSession.sparkContext.broadcast(model)
    sizes = [2 * SLOTS] * CONTEXTS + [2 * LETTER_SLOTS] * LETTER_CONTEXTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, any_rows = [np.zeros(s, np.int64) for s in sizes], False
        for batch in batches:
            for part in slices(batch):
                any_rows = True
                w = words_of(part.column("text"), lower=True)
                t = Tokens.of(w, sent.value)
                contexts = token_contexts(t)
                of, _, node, bit = spread(sent.value.code, t.symbol)
                for k in range(CONTEXTS):
                    own[k] += np.bincount(slots(contexts[k][of], node, SLOTS) * 2 + bit, minlength=sizes[k])
                word = np.delete(t.symbol, t.first[1:] - 1) == sent.value.rare
                _, at, _ = distinct(np.delete(t.hash, t.first[1:] - 1)[word])
                _, _, bit, at = Letters.bits(w, np.flatnonzero(word)[at], sent.value)
                for k in range(LETTER_CONTEXTS):
                    own[CONTEXTS + k] += np.bincount(at[k] * 2 + bit, minlength=sizes[CONTEXTS + k])
        if any_rows:
            rows = np.minimum(np.concatenate(own), 2**32 - 1).astype(np.uint32).reshape(-1, CHUNK)
            for k, row in enumerate(rows):
                if row.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([row.tobytes()], pa.binary())], ["chunk", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        out = np.zeros(CHUNK, np.uint64)
        for raw in rows["counts"].to_pylist():
            out += np.frombuffer(raw, np.uint32)
        return pa.table({"chunk": rows["chunk"].slice(0, 1), "counts": pa.array([np.minimum(out, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    fields = "chunk bigint, counts binary"
    parts = text.mapInArrow(count, fields).withColumn("task", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    some = parts.groupBy("task", "chunk").applyInArrow(lambda rows: add(rows.select(["chunk", "counts"])), fields)
    whole = np.zeros((sum(sizes) // CHUNK, CHUNK), np.uint32)
    for chunk, raw in some.groupBy("chunk").applyInArrow(add, fields).collect():
        whole[chunk] = np.frombuffer(raw, np.uint32)
    flat, cut = whole.reshape(-1), CONTEXTS * 2 * SLOTS
    return flat[:cut].reshape(CONTEXTS, SLOTS, 2), flat[cut:].reshape(LETTER_CONTEXTS, LETTER_SLOTS, 2)


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model is learned from the rows for which ``train`` holds.  Tokens are words, A-Z in lower case, and one end.
    base_score is the add-one unigram model's log10 probability, score the mixed model's.  A null text is empty and
    has the end only.  Other columns are ignored; of repeated rows each is scored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(train, F.lit(True)).alias("train"), F.monotonically_increasing_id().alias("row_no"))
    model, table = learn(rows, F.col("train"))
    sent = rows.sparkSession.sparkContext.broadcast(model)
    log_base = float(np.log10(model.total + model.different + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per document with what frequent tokens and mixing give, and one per rare token and document."""
        own = sent.value
        counts = own.counts.astype(float)
        for batch in batches:
            for part in slices(batch):
                w = words_of(part.column("text"), lower=True)
                t = Tokens.of(w, own)
                got, unnamed = mix(t, own)
                n, rare = part.num_rows, t.symbol == own.rare
                doc = np.asarray(part.column("row_no"))
                base = np.bincount(t.row, np.where(rare, 0, np.log10(counts[t.symbol] + 1) - log_base), n)
                known = np.bincount(t.row, ~rare, n)
                # Rare tokens: number of each in its document, and how many of them must be named.
                at = np.flatnonzero(rare)
                key = mixed(t.hash[at] + t.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 9)
                _, some, number = distinct(key)
                some = at[some]
                spelled = np.zeros(len(some))
                held = ~np.asarray(part.column("train"))[t.row[some]]
                # Only documents that the model hasn't read can hold tokens that it lacks.  An end is not spelled.
                words = some[held] - t.row[some[held]]
                spelled[held] = Letters.log10(w, np.minimum(words, max(len(w.starts) - 1, 0)), own) if len(w.starts) else 0
                spelled[t.hash[some] == END_HASH] = 0
                size = np.bincount(w.row, w.ends - w.starts + 1, n)
                named = np.bincount(number, unnamed[at], len(some))
                no = [np.zeros(len(some), np.int64)] * 4
                columns = [
                    np.concatenate([doc, doc[t.row[some]]]),
                    np.concatenate([np.zeros(n, np.int64), long_ints(t.hash[some])]),
                    np.concatenate([np.zeros(n, np.int64), np.bincount(number, minlength=len(some))]),
                    np.concatenate([np.zeros(n, np.int64), named.astype(np.int64)]),
                    np.concatenate([got, spelled]), np.concatenate([base, no[0].astype(float)]),
                    *(np.concatenate([c.astype(np.int64), z]) for c, z in zip((known, np.diff(t.first), size), no, strict=False)),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c) for c in columns), pa.concat_arrays([part.column("doc_id"), pa.nulls(len(some), pa.int64())]),
                     pa.concat_arrays([part.column("train"), pa.nulls(len(some), pa.bool_())])],
                    ["row_no", "token", "times", "named", "log10", "base", "known", "n_tokens", "size", "doc_id", "train"])

    parts = settle(rows.mapInArrow(
        run, "row_no bigint, token bigint, times bigint, named bigint, log10 double, base double, known bigint, n_tokens bigint, size bigint, "
        "doc_id bigint, train boolean"))
    rare = parts.filter("times > 0").select("row_no", "token", "times", "named", F.col("log10").alias("spelled")).join(
        table.hint("shuffle_hash"), "token", "left")
    unseen = model.unseen_share()
    name = F.when(F.col("n").isNotNull(), F.log10(F.col("n") * ((1 - unseen) / float(model.counts[-1])))).otherwise(
        F.col("spelled") + float(np.log10(unseen)))
    rare = rare.groupBy("row_no").agg(
        F.sum(F.col("named") * name).alias("rare_score"),
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - log_base)).alias("rare_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"))
    whole = parts.filter("times = 0").join(rare, "row_no", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return whole.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", plus("known", "rare_known").cast("bigint").alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"), plus("base", "rare_base").alias("base_score"),
        plus("log10", "rare_score").alias("score"),
        (-plus("log10", "rare_score") * float(_log2_10) / F.greatest("size", F.lit(1))).alias("bits_per_byte"))
