"""Cross-tokenizer links against a plain merge with the libraries' own ids."""

import hashlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from concord.llm import crosstok  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROWS = [
    (1, "The quick brown fox; jumps over the lazy dog's back."), (2, "the the the the"), (3, "Überraschung 中文 \U0001f600 naïve"), (4, None), (5, ""), (6, " "),
    (7, "tabs\tand\nlines\r\n\n  and   spaces  "), (8, "<|endoftext|> <s> </s> <0x41>"), (9, "▁ odd ▁▁ marks"), (10, "x" * 3000), (11, "The quick brown fox"),
    (11, "The quick brown fox"), (None, "The lazy dog"), (12, "word and another word. " * 900), (13, "é é \x00 ﻿"), (14, "中文字符没有空格" * 200),
]


def plain(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters, out = crosstok._byte_letters(), []
    for doc, text in rows:
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text)
        by_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        by_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(by_a) != (" " + text).encode() or b"".join(by_b) != (" " + text).encode():
            ids_a, ids_b, by_a, by_b = [], [], [], []
        i = j = x = y = 0
        links, groups, now = [], [], ([], [])
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            end_a, end_b = x + len(by_a[i]), y + len(by_b[j])
            if end_a <= end_b:
                now[0].append(ids_a[i])
            if end_b <= end_a:
                now[1].append(ids_b[j])
            if end_a == end_b:
                groups.append("|".join(",".join(map(str, s)) for s in now))
                now = ([], [])
            if end_a <= end_b:
                i, x = i + 1, end_a
            if end_b <= end_a:
                j, y = j + 1, end_b
        out.append((doc, len(ids_a), len(ids_b), links, ";".join(groups), len(groups)))
    held = Counter(p for r in out for p in set(r[3]))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [(d, n, m, g, len(s), sum(held[p] == best[p[0]] for p in s), sum(held[p] for p in s), hashlib.sha256(t.encode()).hexdigest() if n else "", t)
            for d, n, m, s, t, g in out]


@pytest.mark.parametrize("chunk", [1, 2_000, crosstok.CHUNK_BYTES])
def test_links_and_counts(spark, monkeypatch, chunk):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id bigint, text string, chunk int, pairs string").repartition(3)
    if chunk != crosstok.CHUNK_BYTES:
        rows = []  # the task's own code, cut into small chunks and lots
        monkeypatch.setattr(crosstok, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(crosstok, "LOT_TOKENS", 50)
        monkeypatch.setattr(crosstok, "SPAN", 7)
        run = crosstok._chunks(A, B, True)
        monkeypatch.setattr(crosstok.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
        import pyarrow as pa

        batches = [pa.RecordBatch.from_pydict({"doc_id": [r[0]], "text": [r[1] or ""]}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())])) for r in ROWS]
        for made in run(iter(batches)):
            rows += made.column("docs")[0].as_py()
        got = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"], r["groups"]) for r in rows]
        assert got == [(r[0], r[1], r[2], r[3], r[4], r[7], r[8]) for r in plain(ROWS)]
        return
    got = [tuple(r) for r in crosstok.align(df, A, B, texts=True).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups").collect()]
    assert sorted(got, key=str) == sorted(plain(ROWS), key=str)
    assert "groups" not in crosstok.align(df, A, B).columns


def test_empty_tables(spark):
    assert crosstok.align(spark.createDataFrame([], "doc_id bigint, text string"), A, B).count() == 0
    (r,) = crosstok.align(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), A, B).collect()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "")


def test_spans_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gammadelta", "x", "Überzug"], n)) for n in (1, 5, 900, 3000)]
    crosstok.tokenizers(A, B)
    docs = crosstok.spelled_ids(texts, A, B)
    whole = crosstok.Lot(docs, A, B, True)
    monkeypatch.setattr(crosstok, "SPAN", 5)
    cut = crosstok.Lot(docs, A, B, True)
    assert whole.groups == cut.groups and whole.n_links.tolist() == cut.n_links.tolist() and whole.pairs.tolist() == cut.pairs.tolist()


def test_fast_ids_equal_the_library():
    a, _ = crosstok.tokenizers(A, B)
    rng = np.random.default_rng(2)
    signs = list("ab eEstT'd12  \n\té中  .!?-") + ["'ll", "<|endoftext|>", "\U0001f600", "\r\n"]
    assert a.fast is not None
    for _ in range(400):
        text = "".join(rng.choice(signs, rng.integers(1, 40)))
        assert a.encode(text) == a.library.encode(text, add_special_tokens=False).ids
