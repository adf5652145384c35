"""The locally consistent parse against a symbol-by-symbol version, and the fingerprints made from it."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from concord.llm import parsing  # noqa: E402
from concord.llm.words import _STEP, mixed  # noqa: E402

MASK = (1 << 64) - 1


def _name(symbols):
    total = sum(s * pow(_STEP, k, 1 << 64) for k, s in enumerate(symbols)) + len(symbols)
    return int(mixed(np.array([total & MASK], np.uint64))[0])


def _toss(now, before):
    low = (now ^ before) & -(now ^ before)
    return 2 * (low.bit_length() - 1) + bool(now & low)


def slow_levels(text):
    """(names, code points they begin at) per level, symbol by symbol."""
    symbols, place, bits = [ord(c) for c in text], list(range(len(text))), 32
    while symbols:
        runs = []
        for s, p in zip(symbols, place, strict=True):
            if runs and runs[-1][0] == s:
                runs[-1][2] += 1
            else:
                runs.append([s, p, 1])
        symbols = [s if n == 1 else s ^ ((n * 0x9E3779B97F4A7C15 & MASK) >> (64 - bits)) for s, _, n in runs]
        place = [p for _, p, _ in runs]
        label = [_toss(s, symbols[k - 1]) if k else _toss(s, ~s & ((1 << bits) - 1)) for k, s in enumerate(symbols)]
        for _ in range(2):
            label = [_toss(v, label[k - 1]) if k else _toss(v, v ^ 1) for k, v in enumerate(label)]
        last = len(symbols) - 1
        starts = [k for k in range(last + 1) if k == 0 or (k < last and label[k - 1] < label[k] >= label[k + 1])]
        symbols = [_name(symbols[a:b]) for a, b in zip(starts, [*starts[1:], last + 1], strict=True)]
        place, bits = [place[k] for k in starts], 64
        yield symbols, place
        if len(symbols) == 1:
            return


TEXTS = ["", "a", "ab", "aaaa", "aaab" * 9, "the cat sat on the mat, the cat sat", "ß中\U0001f600\n" * 20, "x" * 500 + "y" * 300, "".join(chr(97 + (i * i) % 26) for i in range(800))]


def test_levels_equal_the_slow_parse():
    got = {k: [] for k in range(len(TEXTS))}
    for rows, first, names, place in parsing.levels(TEXTS):
        for k, a, b in zip(rows.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            got[k].append((names[a:b].tolist(), place[a:b].tolist()))
    assert got == {k: list(slow_levels(t)) for k, t in enumerate(TEXTS)}


def test_a_shared_passage_keeps_its_names_at_any_offset():
    shared = " ".join(f"word{i * i % 97}" for i in range(300))
    for before in ("", "q", "some other beginning "):
        a, b = (list(parsing.levels([t])) for t in (shared, before + shared + " end"))
        for (_, _, x, _), (_, _, y, _) in list(zip(a, b))[:4]:
            assert len(set(x.tolist()) - set(y.tolist())) <= 8


def test_phrases_cover_each_text(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "null id, some text"), (50, None), (2**60 + 1, "a long id, some text")]
    got = parsing.phrases(spark.createDataFrame(rows, "doc_id bigint, text string"), from_level=1).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.level), []).append((r.start, r.length))
    for (doc, _), spans in by.items():
        text = dict(rows)[doc]
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(text)
    assert {d for d, _ in by} == {k for k, t in rows if t}


def _expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, t), (_, f) in zip(order, [*order[1:], *order[:1]], strict=True):
        t, f = t or "", f or ""
        out.append((i, t, t[: len(t) - len(t) // 2] + f[: len(t) // 2], f))
    return out


def test_compare_with_next(spark):
    rows = [(k * 3, t) for k, t in enumerate(TEXTS)] + [(100, None), (101, "half and half of a longer text " * 400), (None, "no id")]
    rows += [(200 + k, f"document {k} " * (k + 1)) for k in range(40)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, part string, _hash int").repartition(5)
    got = {r.doc_id: r for r in parsing.compare_with_next(df).collect()}
    assert len(got) == len(rows)
    for i, text, edited, following in _expected(rows):
        r, (own, changed, nxt) = got[i], parsing.sketch([text, edited, following])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own.tobytes().hex(), changed.tobytes().hex())
        assert r.near_edited == (own == changed).mean() and r.near_next == (own == nxt).mean()


def test_few_and_repeated_rows(spark):
    def run(rows):
        return parsing.compare_with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()

    assert run([]) == []
    (only,) = run([(1, "abcd")])
    assert only.near_next == only.near_edited * 0 + 1 and only.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    same = run([(1, "one text"), (1, "one text"), (1, "one text")])
    assert len(same) == 3 and {r.near_next for r in same} == {1.0} and len({r.fingerprint for r in same}) == 1
    assert {r.near_edited for r in run([(1, ""), (2, None)])} == {1.0}


def test_edited_texts_are_nearer_than_strangers():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmno"), 6)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(60)]
    own = parsing.sketch(texts)
    edited = parsing.sketch([a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1])])
    near, far = (own == edited).mean(1), (own == np.roll(own, -1, 0)).mean(1)
    assert near.min() > far.max() and near.mean() > 0.25 and far.mean() < 0.1
