"""Aligning the tokens of two tokenizers on whole texts.

Both tokenizations spell the same bytes, so their tokens are two partitions of one range.  All documents of a lot are
merged in lockstep: one state vector holds each document's A pointer, B pointer and place in the output.  A step emits one
link per document, moves the pointer whose token ends first, or both where the tokens end together (a cut), and leaves
finished documents out of the vector.  A long document stands in it as several spans that begin at common ends, so that
the vector stays full.

How many documents hold an id pair is counted per chunk of documents first, then over all chunks.  The counts come back
per chunk, for the pairs that it holds, and meet the chunk's packed links there: texts and tokens are never shuffled.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.words import slices
from concord.session import settle

#: Bytes of text whose documents form a chunk, and tokens merged in one lot.  A longer document is a chunk or lot alone.
CHUNK_BYTES, LOT_TOKENS = 20_000_000, 1_500_000
#: Tokens after which a long document may be taken apart where both tokenizers' tokens end, and ends tried there.
SPAN, TRIES = 400, 16
#: After an id inside its group, after the last A id, after the last B id.
SIGNS = ",|;"

_loaded: dict[str, tuple] = {}


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """A byte-level BPE file: ids of a text without special tokens, and the bytes of every id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        letters, vocabulary = _byte_letters(), self.library.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        """The same tokenizer as ranks, many times faster, where the file is one that merges in the order of its ids."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, before = made["model"], made["pre_tokenizer"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", ())]
        vocabulary = model["vocab"]
        ids = [vocabulary["".join(m.split(" "))] for m in merges]
        plain = made["normalizer"] is None and before == before | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if not plain or ids != sorted(ids) or len(merges) + 256 > len(vocabulary) or model.get("ignore_merges") or model.get("dropout"):
            return None
        merged = set(ids)
        ranks = {self.bytes[i]: i for t, i in vocabulary.items() if i in merged or len(t) == 1}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """A sentencepiece file: ids of a text, and the bytes of every id (the mark of a space as a space, byte pieces as the byte)."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(self.library.id_to_piece(i)[3:5], 16)]) if self.library.is_byte(i) else self.library.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.library.get_piece_size())
        ]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def tokenizers(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens]:
    """Loaded once a worker."""
    for path, kind in ((path_a, ByteTokens), (path_b, PieceTokens)):
        if path not in _loaded:
            made = kind(path)
            if len(made.bytes) > 1 << 16:
                raise ValueError("a vocabulary has more than 65,536 ids")
            _loaded[path] = made, Spelling(made.bytes), _signed(len(made.bytes))
    return _loaded[path_a][0], _loaded[path_b][0]


class Spelling:
    """The bytes of many ids at once."""

    def __init__(self, each: list[bytes]):
        self.size = np.fromiter(map(len, each), np.int64, len(each))
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(each), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        total = np.cumsum(size)
        return self.data[np.repeat(self.begin[ids] - total + size, size) + np.arange(total[-1] if len(ids) else 0)]


def _signed(n: int) -> np.ndarray:
    """Each id in decimal with each of the signs of SIGNS after it, as eight bytes with zeros at the end."""
    return np.frombuffer(b"".join(f"{i}{sign}".encode().ljust(8, b"\0") for i in range(n) for sign in SIGNS), np.uint64)


def spelled_ids(texts: list[str], path_a: str, path_b: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the ids of space+text by A and of text by B; none where either doesn't spell space+text."""
    a, b = tokenizers(path_a, path_b)
    whole = [(" " + t).encode() if t else b"" for t in texts]
    data, size = np.frombuffer(b"".join(whole), np.uint8), np.array([*map(len, whole)])
    bounds = np.concatenate([[0], np.cumsum(size)])
    good, out = size > 0, []
    for spelling, each in ((_loaded[path_a][1], [a.encode(" " + t) if t else [] for t in texts]), (_loaded[path_b][1], b.encode_all(texts))):
        first = np.concatenate([[0], np.cumsum([*map(len, each)])])
        ids = np.fromiter((i for x in each for i in x), np.uint16, first[-1])
        length = np.diff(np.concatenate([[0], np.cumsum(spelling.size[ids])])[first])
        good &= length == size
        right = np.repeat(good, np.diff(first))
        same, wrong = spelling(ids[right]), data[np.repeat(good, size)]
        place = np.flatnonzero(same != wrong)
        good[np.flatnonzero(good)[np.searchsorted(np.cumsum(size[good]), place, "right")]] = False
        out.append([ids[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
    none = np.zeros(0, np.uint16)
    return [(x, y) if ok else (none, none) for x, y, ok in zip(*out, good.tolist(), strict=True)]


def spans(first_a: np.ndarray, end_a: np.ndarray, first_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where documents begin, and where long ones may be taken apart: both tokenizers' tokens end together before it.

    About every SPAN tokens the next few A ends are looked up among B's; where none of them is one, the span goes on.
    """
    some = np.flatnonzero(np.diff(first_a))
    begin, end = first_a[some], first_a[some + 1]
    n = (end - begin - 1) // SPAN
    at = np.repeat(begin, n) + SPAN * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
    tried = np.minimum(at[:, None] + np.arange(TRIES), np.repeat(end, n)[:, None] - 1)
    place = np.searchsorted(end_b, end_a[tried])
    meets = end_b[np.minimum(place, len(end_b) - 1)] == end_a[tried] if len(end_b) else np.zeros(tried.shape, bool)
    which = meets.argmax(1)
    row = np.flatnonzero(meets[np.arange(len(at)), which])
    cut_a, cut_b = tried[row, which[row]] + 1, place[row, which[row]] + 1
    return np.unique(np.concatenate([begin, cut_a[cut_a < first_a[-1]]])), np.unique(np.concatenate([first_b[some], cut_b[cut_b < first_b[-1]]]))


def lockstep(first_a: np.ndarray, end_a: np.ndarray, first_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of many texts' tokens in order: (A token, B token, whether both end there).

    ``end_a`` and ``end_b`` are all tokens' ends, ``first_*`` each text's first token.  Texts are not empty, their A and
    B tokens spell the same bytes, and no token is empty.
    """
    until_a, until_b = np.append(first_a[1:], len(end_a)), np.append(first_b[1:], len(end_b))
    most = np.cumsum(until_a - first_a + until_b - first_b)  # each text has fewer links than tokens
    room = np.concatenate([[0], most])
    out_a, out_b, cut = np.empty(room[-1], np.int32), np.empty(room[-1], np.int32), np.zeros(room[-1], bool)
    active, filled = np.arange(len(first_a)), room[:-1].copy()
    at_a, at_b, place, last = first_a.copy(), first_b.copy(), room[:-1].copy(), until_a - 1
    while len(active):
        out_a[place], out_b[place] = at_a, at_b
        here_a, here_b = end_a[at_a], end_b[at_b]
        moves_a, moves_b = here_a <= here_b, here_b <= here_a
        together = moves_a & moves_b
        cut[place] = together
        place += 1
        done = together & (at_a == last)
        at_a += moves_a
        at_b += moves_b
        if done.any():
            filled[active[done]] = place[done]
            going = ~done
            active, at_a, at_b, place, last = active[going], at_a[going], at_b[going], place[going], last[going]
    used = np.zeros(room[-1] + 1, np.int8)
    np.add.at(used, room[:-1], 1)
    np.add.at(used, filled, -1)
    kept = np.cumsum(used[:-1], dtype=np.int8).view(bool)
    return out_a[kept], out_b[kept], cut[kept]


def _group_texts(ids_a, ids_b, first_a, first_b, link_a, link_b, cut, signed_a, signed_b) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document: after a group's A ids a bar, after its B ids a semicolon but at the end."""
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[link_a[cut]] = True
    last_b[link_b[cut]] = True
    until_a, until_b = np.flatnonzero(last_a) + 1, np.concatenate([[0], np.flatnonzero(last_b) + 1])
    place_a = np.arange(len(ids_a)) + until_b[np.cumsum(last_a) - last_a]
    place_b = np.arange(len(ids_b)) + (until_a[np.cumsum(last_b) - last_b] if len(ids_b) else 0)
    out = np.empty(len(ids_a) + len(ids_b), np.uint64)
    out[place_a] = signed_a[ids_a.astype(np.int64) * len(SIGNS) + last_a * SIGNS.index("|")]
    out[place_b] = signed_b[ids_b.astype(np.int64) * len(SIGNS) + last_b * SIGNS.index(";")]
    raw, bounds = out.tobytes(), (first_a + first_b).tolist()
    return [raw[8 * i : 8 * j].translate(None, b"\0")[:-1] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


class Lot:
    """The links of one lot of documents, merged, with what each document's row needs."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], path_a: str, path_b: str, texts: bool):
        (_, spelling_a, signed_a), (_, spelling_b, signed_b) = _loaded[path_a], _loaded[path_b]
        ids_a, ids_b = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
        first_a, first_b = (np.concatenate([[0], np.cumsum([len(d[k]) for d in docs])]) for k in (0, 1))
        end_a, end_b = np.cumsum(spelling_a.size[ids_a]), np.cumsum(spelling_b.size[ids_b])
        span_a, span_b = spans(first_a, end_a, first_b, end_b)
        link_a, link_b, cut = lockstep(span_a, end_a, span_b, end_b)
        first = np.searchsorted(link_a, first_a)
        self.n_a, self.n_b, self.n_links = np.diff(first_a), np.diff(first_b), np.diff(first)
        self.n_groups = np.diff(np.concatenate([[0], np.cumsum(cut)])[first])
        groups = _group_texts(ids_a, ids_b, first_a, first_b, link_a, link_b, cut, signed_a, signed_b)
        self.sha = [sha256(g).hexdigest() if n else "" for g, n in zip(groups, self.n_a.tolist(), strict=True)]
        self.groups = [g.decode() for g in groups] if texts else [None] * len(docs)
        pairs = ids_a[link_a].astype(np.uint32) << np.uint32(16) | ids_b[link_b]
        keys = np.repeat(np.arange(len(docs), dtype=np.uint64) << np.uint64(32), self.n_links) | pairs
        keys.sort()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        self.times = np.diff(at, append=len(keys)).astype(np.uint32)
        self.pairs = keys[at].astype(np.uint32)
        self.kinds = np.bincount((keys[at] >> np.uint64(32)).astype(np.int64), minlength=len(docs))


_DOC = "doc_id: bigint, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string, groups: string, kinds: bigint"
_CHUNK = f"chunk bigint, docs array<struct<{_DOC}>>, pairs array<int>, held array<int>, packed binary, unpacked bigint"


def _packed(*arrays: np.ndarray) -> tuple[bytes, int]:
    data = b"".join(a.astype("<u4").tobytes() for a in arrays)
    return pa.compress(data, codec="zstd", asbytes=True), len(data)


def _chunk(number: int, ids: list, docs: list[tuple[np.ndarray, np.ndarray]], path_a: str, path_b: str, texts: bool) -> pa.RecordBatch:
    """One row: the documents' own figures, the distinct pairs with how many documents hold each, the packed links."""
    rows, lots, begin = [], [], 0
    total = np.cumsum([len(a) for a, _ in docs])
    while begin < len(docs):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + LOT_TOKENS, "right")))
        lot = Lot(docs[begin:end], path_a, path_b, texts)
        lots.append(lot)
        figures = (lot.n_a.tolist(), lot.n_b.tolist(), lot.n_groups.tolist(), lot.n_links.tolist(), lot.sha, lot.groups, lot.kinds.tolist())
        rows += [dict(zip([f.split(":")[0] for f in _DOC.split(", ")], f, strict=True)) for f in zip(ids[begin:end], *figures, strict=True)]
        begin = end
    pairs = np.concatenate([x.pairs for x in lots])
    known, held = np.unique(pairs, return_counts=True)
    at = np.searchsorted(known, pairs).astype(np.uint32)
    packed, unpacked = _packed(np.diff(at, prepend=np.uint32(0)), np.concatenate([x.times for x in lots]))
    kinds = pa.list_(pa.struct([(f.split(":")[0], pa.string() if "string" in f else pa.int64()) for f in _DOC.split(", ")]))
    lists = [pa.array([x.view(np.int32)], pa.list_(pa.int32())) for x in (known, held.astype(np.uint32))]
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([rows], kinds), *lists, pa.array([packed], pa.binary()), pa.array([unpacked])], [f.split()[0] for f in _CHUNK.replace(f"<{_DOC}>", "").replace("<struct>", "").split(", ")])


def _chunks(path_a: str, path_b: str, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        ids, docs, held = [], [], 0
        for batch in batches:
            for part in slices(batch):
                ids += part.column("doc_id").to_pylist()
                docs += spelled_ids(part.column("text").to_pylist(), path_a, path_b)
                held += part.column("text").nbytes
                if held >= CHUNK_BYTES:
                    yield _chunk(number, ids, docs, path_a, path_b, texts)
                    number, ids, docs, held = number + 1, [], [], 0
        if ids:
            yield _chunk(number, ids, docs, path_a, path_b, texts)

    return run


_OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's packed links with the corpus-wide counts of its pairs: each document's last two figures."""
    for batch in batches:
        for k in range(batch.num_rows):
            docs = batch.column("docs")[k].values
            kinds = docs.field("kinds").to_numpy(zero_copy_only=False)
            data = pa.decompress(batch.column("packed")[k].as_buffer(), batch.column("unpacked")[k].as_py(), codec="zstd") if batch.column("unpacked")[k].as_py() else b""
            steps, times = np.frombuffer(data, "<u4").reshape(2, -1)
            at = np.cumsum(steps, dtype=np.uint32).astype(np.int64)
            found = batch.column("counts")[k].values
            order = np.argsort(found.field("pair").to_numpy(zero_copy_only=False).view(np.uint32)) if len(at) else None
            totals = [np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)]
            if len(at):
                count, best = (found.field(c).to_numpy(zero_copy_only=False)[order] for c in ("total", "best"))
                row = np.repeat(np.arange(len(docs)), kinds)
                for total, worth in zip(totals, (times * best[at], times * count[at]), strict=True):
                    sums = np.concatenate([[0], np.cumsum(worth.astype(np.int64))])
                    ends = np.cumsum(np.bincount(row, minlength=len(docs)))
                    total += np.diff(np.concatenate([[0], sums[ends]]))
            given = {"n_best": pa.array(totals[0]), "count_sum": pa.array(totals[1])}
            names = [f.split()[0] for f in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([given.get(c) if c in given else docs.field(c) for c in names], names)


def align(docs: DataFrame, path_a: str, path_b: str, texts: bool = False) -> DataFrame:
    """Per document the groups and links of A's and B's tokens and how common its links are over all documents.

    Null and empty texts, and those that either tokenizer doesn't spell back, have no tokens: zeros and an empty
    groups_sha256.  A pair's count is the number of rows that hold it linked, so repeated rows count each; every row
    gives a row, those without an id too.  ``texts`` adds the groups themselves.  Other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = settle(plain.mapInArrow(_chunks(path_a, path_b, texts), _CHUNK))
    pairs = made.select("chunk", F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("chunk", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    totals = pairs.groupBy("pair").agg(F.sum("held").alias("total"))
    totals = settle(totals.withColumn("a", F.shiftrightunsigned("pair", 16)))
    most = totals.groupBy("a").agg(F.max("total").alias("most"))
    judged = totals.join(most, "a").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    back = pairs.select("chunk", "pair").join(judged, "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "total", "best")).alias("counts"))
    nothing = F.array().cast("array<struct<pair:int,total:bigint,best:boolean>>")
    joined = made.select("chunk", "docs", "packed", "unpacked").join(back, "chunk", "left").select("docs", "packed", "unpacked", F.coalesce("counts", nothing).alias("counts"))
    out = joined.mapInArrow(_counted, _OUT)
    return out if texts else out.drop("groups")
