import itertools

import numpy as np
import pytest

pytest.importorskip("concord.llm")

from pyspark.sql import functions as F  # noqa: E402

from concord.llm import toxicity  # noqa: E402

REACH = toxicity.REACH


def plain_events(symbols):
    """The events of a clause by looking around each insult and threat."""
    words, quotes = [], []
    quoted = False
    for s in symbols:
        if s == "quote":
            quoted = not quoted
        else:
            words.append(s)
            quotes.append(quoted)
    kinds = []
    for i, s in enumerate(words):
        if s in ("insult", "threat"):
            if "negation" in words[max(0, i - REACH):i]:
                s += "_negated"
            elif quotes[i] or "report" in words[:i]:
                s += "_reported"
        kinds.append(s)
    out = []
    for i, s in enumerate(kinds):
        if s in ("insult", "threat"):
            after = kinds[i + 1:i + 1 + REACH]
            other = next((k for k, a in enumerate(after) if a in ("insult", "threat")), len(after))
            out.append(f"{s}_aimed" if "target" in kinds[max(0, i - REACH):i] or "target" in after[:other] else s)
        elif s.endswith(("_negated", "_reported")):
            out.append(s)
    return sorted(out)


def test_composed_machine_reads_every_short_clause_like_the_plain_rules():
    inputs = [w for w in toxicity.WORDS if w != "end"]
    for n in range(6):
        for symbols in itertools.product(inputs, repeat=n):
            got = [e for told in toxicity.CLAUSE.read([*symbols, "end"]) for e in told]
            assert sorted(got) == plain_events(symbols), symbols


def test_clauses_and_quotes():
    stems = {"grumbo": 5.0}
    read = lambda text: toxicity.events(text, stems)
    assert read("you are not a grumbo") == (["insult_negated"], 0.0)
    assert read("they said you are a grumbo") == (["insult_reported"], 0.0)
    assert read("he is a “grumbo” of sorts") == (["insult_reported"], 0.0)
    assert read("you are a grumbo") == (["insult_aimed"], 5.0)
    assert read("i will kill you") == (["threat_aimed"], 0.0)
    assert read("") == ([], 0.0)


def test_weights_keep_their_signs():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (300, len(toxicity.FEATURES) + 1)).astype(float)
    x[:, -1] = 1
    for y in (x[:, 4], 1 - x[:, 0], rng.integers(0, 2, 300).astype(float)):
        w = toxicity.weighted_logistic(x, y, np.ones(300))
        named = dict(zip(toxicity.FEATURES, w, strict=False))
        assert all(named[f] >= 0 for f in toxicity.AT_LEAST_ZERO) and all(named[f] <= 0 for f in toxicity.AT_MOST_ZERO)
    w = toxicity.weighted_logistic(x, x[:, 1], np.ones(300))
    assert np.mean((x @ w > 0) == (x[:, 1] > 0)) > 0.99


@pytest.fixture(scope="module")
def grammar(spark):
    rows = [(f"plain words number {i} here. you are a reader of {i * 3}", 0) for i in range(200)]
    rows += [(f"plain words {i}. you are a grumbo fool{i}", 1) for i in range(40)]
    return toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))


def test_whole_documents(spark, grammar):
    rows = [(1, "what a grumbo you are"), (2, "you are not a grumbo"), (3, "they said you are a grumbo"), (4, "I will kill you."),
            (5, "kill the lights"), (6, "plain words. " * 200_000 + "you grumbo"), (7, None), (8, ""), (1, "what a grumbo you are"), (None, "you grumbo")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("toxicity", F.lit("other")).withColumn("stem", F.lit(1))
    got = toxicity.score(df, grammar).collect()
    by_id = {r.doc_id: r.toxicity for r in got}
    assert len(got) == len(rows) and sum(r.doc_id == 1 for r in got) == 2
    assert {i for i, s in by_id.items() if s >= 0.5} == {1, 4, 6, None}
    assert by_id[7] == by_id[8] >= max(by_id[2], by_id[3]) and all(0 <= s <= 1 for s in by_id.values())
    assert grammar.clause_weight("you are not a grumbo") <= 0 < grammar.clause_weight("i will kill you")


def test_sampled_ids(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(2000)] + [(1, 0, "x"), (None, 1, "x"), (7000, None, "x")], "doc_id bigint, toxic int, text string")
    assert {(r.doc_id, r.toxic) for r in toxicity.sampled(labels).collect()} == {(i, i % 2) for i in range(2000)}
    assert 50 < toxicity.sampled(labels, 100).count() < 200
    assert toxicity.sampled(labels.limit(0)).count() == 0
