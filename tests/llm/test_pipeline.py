"""The pipeline's stages one by one against plain Python, and as a whole."""

import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{seed}x{k}" for k in range(n)]
    return ". ".join(" ".join(words[i : i + 9]) for i in range(0, n, 9)) + ("." if rng.integers(2) else "!")


A, B = prose(1, 130), prose(2, 90)
ROWS = [(1, A), (2, A), (3, A.replace("w1x60 ", "zz ")), (4, B + " " + " ".join(WORD.findall(A)[10:75])), (5, prose(5, 300)), (6, B), (7, B), (8, "short text here."), (9, prose(9, 60) + " " + prose(5, 300)),
        (10, prose(10, 2500)), (11, B.upper())] + [(20 + k, prose(100 + k, 40 + 7 * k)) for k in range(20)]
JUNK = [(200 + k, "again again again again " * (12 + k)) for k in range(6)]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return str(tmp_path_factory.mktemp("pipeline"))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def run(spark, name, rows):
    out = STAGES[name](spark, frame(spark, rows), "")
    return out if name == "best-fit packing" else sorted((r.doc_id, r.text) for r in out.select(*SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")).collect())


def without_copies(rows):
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, i))
    return sorted((i, t) for t, i in last.items())


def without_near_copies(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t.translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, t) for i, t in rows if find(i) == i)


def without_repeated_passages(rows):
    seen, out = {}, []
    for i, t in sorted(rows):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        if not any(gone):
            out.append((i, t))
        elif kept:
            out.append((i, kept))
    return sorted(out)


def test_clean_documents_stay_and_junk_goes(spark):
    kept = run(spark, "quality classifier", ROWS + JUNK)
    assert {i for i, _ in ROWS if i != 8} <= {i for i, _ in kept} and not {i for i, _ in JUNK} & {i for i, _ in kept}
    assert all(dict(ROWS)[i] == t for i, t in kept)


def test_dedup_stages(spark):
    rows = ROWS
    for name, plain in (("exact dedup", without_copies), ("n-gram Jaccard join", without_near_copies), ("substring dedup", without_repeated_passages)):
        got, want = run(spark, name, rows), plain(rows)
        assert got == want and len(got) <= len(rows)
        rows = want
    assert 5 in dict(rows) and 1 not in dict(rows)


def test_texts_that_lost_words_are_dealt_once_to_each_join(spark):
    made = STAGES["substring dedup"](spark, frame(spark, ROWS), "")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"hashpartitioning\([^)]*kept_text", plan)


def test_packing_stage(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, "best-fit packing", ROWS).collect()
    want = []
    for i, t in ROWS:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            want.append((i, k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_empty_and_null_documents(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "no id"), (4, "one")]
    for name, stage in STAGES.items():
        out = stage(spark, frame(spark, rows), "")
        assert name == "best-fit packing" or out.columns == corpus_pipeline.COLUMNS
        out.collect()
        assert stage(spark, frame(spark, rows).filter("false"), "").count() == 0


def test_whole_run(spark, folder):
    frame(spark, ROWS + JUNK).write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    rows = run(spark, "quality classifier", ROWS + JUNK)
    for plain in (without_copies, without_near_copies, without_repeated_passages):
        rows = plain(rows)
    assert {r.doc_id for r in got} == {i for i, _ in rows}
