"""The dealt operators against plain Python on small tables with the odd cases in them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from concord.llm import exact, licences, mixing, near, packing, pieces, quality, substring, topk, toxicity  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
A = " ".join(f"w{i}" for i in range(120))
B = " ".join(f"v{i}" for i in range(80))
ROWS = [
    (1, A, "x"), (2, A, "x"), (3, A.replace("w60 ", "zz "), None), (4, B + " " + " ".join(A.split()[10:75]), "x"), (5, None, "x"), (6, "", "x"),
    (7, "  \n ", "x"), (8, "one", "x"), (9, "One", "x"), (10, "a b c d", "x"), (11, "ß 中 ́ <s> </s>\ttab", "x"), (12, A.upper(), "x"),
    (13, "word " * 3000, "x"), (14, B, "x"), (14, B, "x"), (None, A, "x"), (15, A, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, piece string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, piece string")


def _shingles(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_cover_reaches_every_shift():
    assert substring.covers(substring.PERIOD, substring.COVER)


def test_substring_dedup(docs, none):
    seen, want = {}, []
    for i, t, _ in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    want.append((None, 120, 0, hashlib.sha256(A.encode()).hexdigest()))
    got = [tuple(r) for r in substring.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substring.dedup(none).count() == 0


def test_substring_dedup_of_two_texts_under_one_id(spark):
    clean = " ".join(f"c{i}" for i in range(222))
    rows = [(1, A, "x"), (2, B + " " + A, "x"), (2, clean, "x"), (2, clean, "x")]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.dedup(spark.createDataFrame(rows, "doc_id bigint, text string, n_words string")).collect())
    assert got == {(1, 120, 0): 1, (2, 200, 120): 1, (2, 222, 0): 2}


def test_exact_dedup(docs, none):
    got = exact.mark(docs).collect()
    assert len(got) == len(ROWS) and exact.mark(none).count() == 0
    groups = Counter(t or "" for _, t, _ in ROWS)
    for r in got:
        same = [i for i, t, _ in ROWS if hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == max(i for i in same if i is not None)
    assert sum(r.kept for r in got) == len(groups)
    assert sorted((r.text or "") for r in exact.survivors(docs).collect()) == sorted(groups)
    assert exact.survivors(docs).columns == docs.columns


def test_hot_copies_are_split_off(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text")
    hot = [r for r in exact.mark(df).collect() if r.group_size > 1]
    assert len(hot) == 1000 and [r.doc_id for r in hot if r.kept] == [2997] and exact.survivors(df).count() == 2001


def test_near_duplicates(spark, docs, none):
    rng, rows = np.random.default_rng(5), [(i, t) for i, t, _ in ROWS if i is not None]
    base = [f"b{k}" for k in range(150)]
    for i in range(100, 190):  # near copies of one text, some linked to it, some only to one another
        words = list(base)
        for k in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            words[k] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = {i: _shingles(t, 4) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert near.near_duplicates(none).count() == 0
    assert near.near_duplicates(docs).count() == len(ROWS)


def test_near_duplicates_through_a_row_without_an_id(spark):
    words = [f"b{k}" for k in range(200)]
    step = lambda n: " ".join(words[n:] + [f"e{k}" for k in range(n)])
    rows = [(7, step(0), "x"), (None, step(10), "x"), (None, step(10), "x"), (8, step(20), "x"), (8, "other words are here", None), (None, None, "x"), (None, "alone " * 9, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, class string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(df).collect())
    assert not 100 * len(_shingles(step(0), 4) & _shingles(step(20), 4)) >= 85 * len(_shingles(step(0), 4) | _shingles(step(20), 4))
    assert got == {(7, 197, 7): 1, (None, 197, 7): 2, (8, 197, 7): 1, (8, 1, 8): 1, (None, 0, None): 1, (None, 1, None): 1}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("concord_")]


def test_differences_that_only_one_component_has_make_no_rows(spark, monkeypatch):
    monkeypatch.setattr(near, "FEW", 1)
    held = spark.createDataFrame([  # (class, hub, size, linked, root, missing, extra); hub 1: one component, hub 2: two
        (10, 1, 100, True, 1, [1, 2], [3]), (11, 1, 100, False, 1, [1, 2], [3]),
        (20, 2, 100, True, 2, [*range(9)], [50, 51]), (21, 2, 100, False, 21, [*range(12)], [50, 52]), (22, 2, 100, False, 21, [*range(12)], [50, 52]),
    ], "class bigint, hub bigint, size bigint, linked boolean, root bigint, missing array<bigint>, extra array<bigint>")
    got = near.differences(held, 85).collect()
    assert {(r["class"], r.member) for r in got if r["class"] == 21} == {(21, m) for m in [*range(9), 50]}
    assert near.apart_among_few(held, 85).count() == 0
    monkeypatch.setattr(near, "FEW", 3)
    assert near.differences(held, 85).count() == 0 and {tuple(r) for r in near.apart_among_few(held, 85).collect()} == {(20, 21), (20, 22)}
    assert {r.hub for r in got} == {2} and not {51, 52, 9, 10, 11} & {r.member for r in got}
    assert all(r.place == r.n - 10 + 1 + rank for r, rank in zip(sorted((r for r in got if r["class"] == 21), key=lambda r: r.place), range(10)))


def test_parities_rule_out_only_pairs_that_cannot_link(spark):
    rng, sets = np.random.default_rng(3), []
    for n in (1, 5, 63, 64, 65, 120, 128, 129, 500, 5000):
        base = rng.choice(1 << 40, n, replace=False)
        sets += [base, *(np.union1d(base[int(n * lost):], rng.choice(1 << 40, int(n * more))) for lost, more in ((0.02, 0), (0.1, 0), (0, 0.1), (0.07, 0.08), (0.5, 0.5)))]
    sizes = np.array([len(x) for x in sets])
    names = np.concatenate(sets).astype(np.uint64)
    bits = near.parities(np.repeat(np.arange(len(sets)), sizes), names, sizes).to_pylist()
    pairs = [(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b and 100 * min(sizes[a], sizes[b]) >= 85 * max(sizes[a], sizes[b])]
    rows = [(a, b, int(sizes[a]), int(sizes[b]), bits[a], bits[b]) for a, b in pairs]
    df = spark.createDataFrame(rows, "a int, b int, a_size bigint, b_size bigint, a_bits array<bigint>, b_bits array<bigint>")
    kept = {(r.a, r.b) for r in df.filter(near.similar_bits(85)).collect()}
    share = {p: len(np.intersect1d(sets[p[0]], sets[p[1]])) / len(np.union1d(sets[p[0]], sets[p[1]])) for p in pairs}
    assert {p for p in pairs if share[p] >= 0.85} <= kept
    assert not [p for p in kept if share[p] < 0.5 and min(sizes[list(p)]) > 64]


def test_pairs_spread_over_copies_of_a_busy_class(spark, monkeypatch):
    monkeypatch.setattr(near, "PAIRS", 3)
    pairs = spark.range(10).selectExpr("id as a", "if(id < 8, 20, 21) as b")
    table = spark.range(22).selectExpr("id as class", "concat('t', id) as text")
    got = sorted(tuple(r) for r in near.with_sides(pairs, table, ["text"]).select("a", "b", "a_text", "b_text").collect())
    assert got == [(i, b := 20 if i < 8 else 21, f"t{i}", f"t{b}") for i in range(10)]
    turned = {tuple(r) for r in near.busier_last(pairs.selectExpr("b as a", "a as b")).collect()}
    assert {p for p in turned if 20 in p} == {(i, 20) for i in range(8)}


def test_bins_fill_exactly_where_they_can():
    plan = packing.bins({7: 3, 3: 6, 2: 1, 10: 2}, 10)
    used = Counter()
    for times, lengths in plan:
        assert sum(n * k for n, k in lengths) <= 10
        for n, k in lengths:
            used[n] += k * times
    assert used == {7: 3, 3: 6, 2: 1, 10: 2} and sum(t for t, _ in plan) == 7


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    made = packing.token_pieces(docs, path, 1)
    got = packing.pack(made).collect()
    want = Counter()
    for i, t, _ in ROWS:
        ids = Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == math.ceil(sum(r.length for r in got) / 4096)
    assert packing.pack(packing.token_pieces(none, path, 1)).count() == 0


def test_pieces_equal_the_library(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path)
    rng = np.random.default_rng(3)
    signs = list("aabbeennsstt thehe  \n\t▁éß中😀<>0x") + ["ing", "</s>", "\x00"]
    odd = ["", " ", "▁▁a", "a" * 300, " " * 40] + ["".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(500)]
    for text in odd:
        ids = library.encode(text)
        assert own.encode(text) == ids and own.decode([*ids, 2]) == library.decode([*ids, 2])
    for _ in range(300):
        ids = rng.choice([3 + 0x20, 3 + 0xC3, 29871, 300, 5000, 130], rng.integers(1, 8)).tolist()
        assert own.decode(ids) == library.decode(ids)
    for r in pieces.encode_decode(docs, path, keep=True).collect():
        assert r.n_tokens == len(r.ids.split()) and hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256


def test_long_words_are_not_remembered(monkeypatch):
    import pyarrow as pa
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["中文没有空格" * 400, "abc " * 5 + "x" * 500, "é" * 65, "中文没有空格" * 400, "plain words twice plain words twice"]
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = packing.Encoder(path), Tokenizer.from_file(path)
    ids, at = own.ids(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, own.words.values())) <= 4 * packing.LONGEST and max(map(len, own.parts)) <= packing.LONGEST
    path = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(pieces, "CACHE_BYTES", 2000)
    own, library = pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in texts:
        assert own.encode(text) == library.encode(text)
        assert own.held <= 2000 + 4000 and all(len(c) <= pieces.LONGEST for c in own.known)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(120)] + [(7, [1.0] * 6), (200, [1.0, float("nan")]), (201, None), (None, [1.0] * 6), (202, [2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>").filter(topk.usable(topk.F.col("v"))).select("vec_id", topk.whole_parts(topk.F.col("v"), 64).alias("vector"))
    got = [tuple(r) for r in topk.top_k(df.filter("vec_id % 20 = 0"), df, 5, candidate_block=16, query_block=2).collect()]
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(map(math.isfinite, v))]
    want = []
    for i, q in fine[:120]:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in fine if j != i and len(c) == 6)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found)]
    assert sorted(got) == sorted(want)


def test_quality(spark, docs, none):
    good = [(i, " ".join(f"w{(i * 7 + k) % 97}x{k}" for k in range(60)) + ".") for i in range(60)]
    bad = [(100 + i, "again again again again " * 12) for i in range(10)] + [(200 + i, " ".join(f"q{i}{k}***" for k in range(40))) for i in range(10)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    kept = {r.doc_id for r in quality.score(df, quality.fit(df)).filter("quality_keep").collect()}
    assert kept == {i for i, _ in good}
    assert quality.score(docs, quality.fit(docs)).count() == len(ROWS) and quality.score(none, quality.fit(none)).count() == 0


def test_toxicity(spark, docs, none):
    rows = [(f"plain words number {i} here. nothing else {i * 3}", 0) for i in range(200)] + [(f"plain words {i}. you are a grumbo fool{i}", 1) for i in range(40)]
    grammar = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert any("grumbo".startswith(s) for s in grammar.stems)
    df = spark.createDataFrame([(1, "what a grumbo you are"), (2, "nothing"), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, grammar).collect()}
    assert got[1] > 0.5 > max(got[2], got[3]) and toxicity.score(none, grammar).count() == 0
    found, _ = toxicity.events("you are not a grumbo", {"grumbo": 1.0})
    assert found.count("insult_negated") == 1 and found.count("insult") == 0
    assert toxicity.learn(spark.createDataFrame([], "text string, toxic int")).stems == {}


def test_licences(spark, docs, none):
    rows = [(1, "lib/a/x", "code\nLicensed under the Apache License, Version 2.0.\n" + "other words " * 40), (2, "lib/COPYING", "Released under the MIT License."),
            (3, "lib/a/y", "code"), (4, "top", "code"), (5, "lib/b/c/z", None), (6, None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    got = {r.doc_id: (r.licence, r.how) for r in licences.inherit(df, licences.scan(df)).collect()}
    assert got == {1: ("Apache-2.0", "header"), 2: ("MIT", "file"), 3: ("MIT", "inherited"), 4: (None, None), 5: ("MIT", "inherited"), 6: (None, None)}
    assert licences.scan(none).count() == 0 and licences.scan(docs).count() == 0


def test_language_model(docs, none):
    held = topk.F.crc32(topk.F.col("doc_id").cast("string")) % 7 == 2
    got = {r.doc_id: r for r in mixing.score(docs, ~held).collect() if r.doc_id is not None}
    tokens = {i: [*WORD.findall((t or "").translate(LOW)), "\n"] for i, t, _ in ROWS if i is not None}
    counts = Counter()
    for i, t, _ in ROWS:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*WORD.findall((t or "").translate(LOW)), "\n"])
    total, different = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        r = got[i]
        assert r.n_tokens == len(words) and r.n_known == sum(counts[w] > 0 for w in words) and r.train_tokens == total
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + different + 1)) for w in words))
        assert -math.inf < r.score < 0
    assert mixing.score(none, ~held).count() == 0


def test_mixing_blocks_and_rows():
    """Blocks go on without a gap and stay short; what a document scores doesn't depend on its neighbours in a slice."""
    place = np.arange(200_000)
    block = mixing.blocks(place)
    assert block[0] == 0 and (np.diff(block) >= 0).all() and np.bincount(block).max() <= mixing.LAST_BLOCK
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) for _ in range(n)) for n in (0, 1, 3, 40, 900, 7000)]
    counts = np.array([900, 500, 300, 200, 100, 90, 30])
    words = mixing.words_of(mixing.pa.array(["alpha beta gamma delta"])).hashes()
    frequent = np.append(words, [mixing.END_HASH, np.uint64(1)])
    order = np.argsort(frequent)
    model = mixing.Model(frequent[order], order, counts, mixing.prefix_code(counts), mixing.prefix_code(np.ones(256)), 2120, 9, 2)
    model.tables = np.random.default_rng(3).normal(0, 1, model.tables.shape).astype(np.float32)
    run = lambda some: mixing.mix(mixing.Tokens.of(mixing.words_of(mixing.pa.array(some)), model), model)[0]
    together = run(texts)
    assert together == pytest.approx([run([t])[0] for t in texts], rel=1e-4) and (together < 0).all()
