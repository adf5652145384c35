"""SentencePiece encoding and decoding of a merge-type (BPE) vocabulary.

Encoding backtracks over Aho-Corasick longest matches: a token is accepted if its end is not known to fail and if it
is compatible with the token before it, that is, if merging both tokens' characters anew gives the same two tokens.
A bitfield remembers places from which no way leads on.  Texts fall into chunks that no token crosses (a run of space
signs and what follows it); each distinct chunk is encoded once per worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Pairs of tokens that a worker remembers, and bytes (about) of chunks; then it forgets all of them.  Longer chunks,
#: such as whole texts without a space, are not remembered.
CACHE, CACHE_BYTES, LONGEST = 400_000, 160 << 20, 64
#: Kinds of entries in the model file.
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6

_models: dict[str, PieceModel] = {}


class PieceModel:
    """Vocabulary of a model file: pieces by text, their merge order, byte pieces for characters without a piece.

    Read are models of type BPE with byte fallback, no normalisation and a leading space sign; others are refused.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or rules.precompiled_charsmap \
                or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or any(p.type == USER_DEFINED for p in proto.pieces):
            raise ValueError("a BPE model with byte fallback, a leading space and no normalisation is needed")
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type in (NORMAL, UNUSED)}
        self.text = {k: p for p, k in self.ids.items()}
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (NORMAL, UNUSED)}
        self.byte_id = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == BYTE}
        self.id_byte = {k: b for b, k in self.byte_id.items()}
        self.end_id = next(k for k, p in enumerate(proto.pieces) if p.piece == "</s>")
        self.letters = {c for p in self.ids for c in p}
        if not self.letters <= set(self.ids) or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("each letter must be a piece, and space signs may only begin one")
        self.machine = ahocorasick.Automaton()
        for piece in self.ids:
            self.machine.add_word(piece, len(piece))
        self.machine.make_automaton()
        # Longest proper prefix of each piece that is a piece.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), None) for p in self.ids}
        apart = "".join(c for c in "\n\t\r" if c not in self.letters)  # signs that no piece holds end a chunk, too
        none = re.escape(apart)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}{none}]+|{SPACE}+|[{none}]" if apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[str, str]] = {}
        self.held = 0

    def merged(self, text: str) -> list[str]:
        """The text's letters, merged pair by pair, best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def tokens(self, text: str) -> list[str]:
        """Pieces of a text of known letters."""
        longest = [0] * len(text)
        for end, size in self.machine.iter(text):  # ends ascend, so the longest match of a start comes last
            longest[end + 1 - size] = size
        pairs, shorter, n = self.pairs, self.shorter, len(text)
        fails = 0  # bit p: no way on from place p
        out: list[str] = []
        at, token, last = 0, text[: longest[0]], None
        while at < n:
            while token is not None:
                if not (fails and fails >> at + len(token) & 1):
                    if last is None:
                        break
                    fits = pairs.get((last, token))
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += len(token)
                last = token
                if at < n:
                    token = text[at : at + longest[at]]
            else:
                fails |= 1 << at
                token = out.pop()
                at -= len(token)
                last = out[-1] if out else None
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk; a letter without a piece gives the ids of its UTF-8 bytes."""
        if self.letters.issuperset(chunk):
            return [self.ids[t] for t in self.tokens(chunk)] if chunk else []
        out, begin = [], 0
        for k, c in enumerate(chunk):
            if c not in self.letters:
                out += self.chunk_ids(chunk[begin:k]) + [self.byte_id[b] for b in c.encode()]
                begin = k + 1
        return out + self.chunk_ids(chunk[begin:])

    def spelled(self, ids: list[int]) -> str:
        """Text of ids, with a leading space if there is one; unfinished byte sequences give U+FFFD."""
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i in self.id_byte:
                raw.append(self.id_byte[i])
                continue
            if raw:
                out.append(_from_bytes(bytes(raw)))
                raw.clear()
            out.append(self.text.get(i, "").replace(SPACE, " "))
        return "".join(out)

    def _chunk(self, chunk: str) -> tuple[str, str]:
        ids = self.chunk_ids(chunk)
        spelled = "".join(map(self.text.get, ids)).replace(SPACE, " ") if self.text.keys() >= set(ids) else self.spelled(ids)
        return " ".join(map(str, ids)), spelled

    def _chunks(self, text: str) -> list[tuple[str, str]]:
        found, known = self.chunk.findall((" " + text).replace(" ", SPACE)), self.known
        out = list(map(known.get, found))
        if None in out:
            for k, value in enumerate(out):
                if value is None:
                    value = known.get(found[k])
                    if value is None:
                        value = self._chunk(found[k])
                        if len(found[k]) <= LONGEST:
                            if self.held > CACHE_BYTES:
                                known.clear()
                                self.held = 0
                            known[found[k]] = value
                            self.held += 300 + 4 * (len(found[k]) + len(value[1])) + len(value[0])
                    out[k] = value
        return out

    def encode(self, text: str) -> list[int]:
        """Ids without an end id; an empty text has none."""
        return [int(i) for ids, _ in self._chunks(text) for i in ids.split()] if text else []

    def decode(self, ids: list[int]) -> str:
        ids = [i for i in ids if i != self.end_id]
        text = self.spelled(ids)
        return text[1:] if ids and self.text.get(ids[0], "").startswith(SPACE) else text

    def encoded_and_decoded(self, text: str) -> tuple[str, str]:
        """Decimal ids with the end id, joined by a space, and the text that these ids spell."""
        if not text:
            return str(self.end_id), ""
        parts = self._chunks(text)
        return " ".join([p[0] for p in parts]) + f" {self.end_id}", "".join([p[1] for p in parts]).removeprefix(" ")


def _from_bytes(raw: bytes) -> str:
    """UTF-8, each byte that fits nowhere as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + n].decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_decode(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also ids (a string) and decoded.

    Null text is empty and has the end id only.  Other columns are ignored; repeated rows give repeated results.
    """
    fields = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        names = [f.split()[0] for f in fields.split(", ")]
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part, out = batch.slice(begin, 500), []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids, decoded = own.encoded_and_decoded(text or "")
                    sums = [hashlib.sha256(x.encode()).hexdigest() for x in (ids, decoded)]
                    out.append((doc, ids.count(" ") + 1, *sums) + ((ids, decoded) if keep else ()))
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * (len(names) - 2)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)
