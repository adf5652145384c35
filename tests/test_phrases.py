import random

import pytest

from concord.operators import phrases


@pytest.mark.parametrize("limit", [100_000, 0])
def test_hits_are_all_containments(spark, limit):
    rng = random.Random(1)
    words = ["ab", "abc", "été", "the cat", "x", "中文", "long phrase here", "phrase", "Cat"] + ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    texts = [(k, "".join(rng.choice("abcd xéE中文") for _ in range(rng.randint(0, 90)))) for k in range(60)]
    texts += [(100, None), (101, ""), (102, "A LONG PHRASE HERE, the Cat, Été"), (103, "中文中文"), (104, "abcd" * 20_000)]
    got = {tuple(r) for r in phrases.phrase_hits(spark.createDataFrame(texts, "id int, t string"), "id", "t",
                                                 spark.createDataFrame([(w,) for w in words + [""]], "phrase string"), limit).collect()}
    low = {w.lower() for w in words if w}
    assert got == {(k, w) for k, t in texts if t for w in low if w in t.lower()}


def test_no_phrases_and_no_texts(spark):
    t, p = spark.createDataFrame([(1, "a")], "id int, t string"), spark.createDataFrame([], "phrase string")
    assert phrases.phrase_hits(t, "id", "t", p).count() == 0
    assert phrases.phrase_hits(t.filter("false"), "id", "t", spark.createDataFrame([("a",)], "phrase string")).count() == 0


def test_expanded_with_any_dictionary(spark):
    entries = spark.createDataFrame([(2, "cat", ["feline", "puss"]), (1, "dog", ["hound"]), (3, "bird", ["avian"])], "position int, phrase string, synonyms array<string>")
    texts = spark.createDataFrame([(1, "A Hound and a cat, a feline"), (2, "nothing"), (3, None)], "id int, t string")
    got = {r.id: r.text for r in phrases.expanded(texts, "id", "t", entries, "in:", "out:").collect()}
    assert got == {1: "in:\nA Hound and a cat, a feline\nout:\n- dog: hound\n- cat: feline, puss", 2: "in:\nnothing\nout:\n", 3: None}


@pytest.mark.parametrize("limit", [100_000, 0])
def test_only_phrases_leave_a_text(spark, limit):
    """A text's runs are not made one by one in column expressions, which took minutes a GB; characters are code points."""
    t = spark.createDataFrame([(1, "x\U0001F600yz-w" * 50), (2, "\U0001F600"), (None, "ab"), (1, "a\U0001F600yz-")], "id int, t string")
    p = spark.createDataFrame([("\U0001F600yz-",), ("\U0001F600",), ("AB",)], "phrase string")
    found = phrases.phrase_hits(t, "id", "t", p, limit)
    assert {tuple(r) for r in found.collect()} - {(None, "ab")} == {(1, "\U0001F600yz-"), (1, "\U0001F600"), (2, "\U0001F600")}
    if limit:
        assert "ArrowEvalPython" in found._jdf.queryExecution().optimizedPlan().toString()
