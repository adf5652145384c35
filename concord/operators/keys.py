"""Foreign key matching, and primary and foreign key comparison of mapped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import names, similarity, texts, vocab
from concord.operators import assign, pairs
from concord.session import settle


def fk_texts(fks: DataFrame, plain: bool = False) -> DataFrame:
    """Foreign keys with their description text from canonical (or plainly canonical) names."""
    fix = names.simple_canonical if plain else names.canonical
    return fks.withColumn("fk_text", texts.fk_text(
        fix("parent_table"), F.transform("parent_cols", lambda c: fix(c)),
        fix("ref_table"), F.transform("ref_cols", lambda c: fix(c)),
    ))


def translate_tables(fks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Student table names replaced by the answer tables they are mapped to, kept when unmapped.

    ``mapping`` (submission_id, ans_table, original_name).
    """
    known = mapping.filter("original_name is not null").select("submission_id", "ans_table", "original_name")
    out = fks
    for column in ("parent_table", "ref_table"):
        name = known.select("submission_id", F.col("original_name").alias(column), F.col("ans_table").alias("_to"))
        out = out.join(name, ["submission_id", column], "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
    return out


def fk_similarity(answer_texts: DataFrame, student_texts: DataFrame, min_similarity: float, measure: str) -> DataFrame:
    """(ans_text, stu_text, similarity) over distinct texts, at least ``min_similarity``.

    ``measure`` is 'cosine' (grams) or 'plain' (word Jaccard or share of equal positions).
    """
    a = answer_texts.select(F.col("fk_text").alias("ans_text")).distinct()
    # settled, as the optimizer would move conditions on scores to the rows before distinct ones are taken
    b = settle(student_texts.select(F.col("fk_text").alias("stu_text")).distinct())
    if measure == "cosine":
        scored = pairs.gram_edges(
            a.withColumn("text", F.col("ans_text")), b.withColumn("text", F.col("stu_text")), [], "ans_text", "stu_text"
        ).withColumnRenamed("cosine", "similarity")
        return scored.filter(F.col("similarity") >= min_similarity)
    def score(x, y):
        return F.greatest(similarity.jaccard(similarity.words(x), similarity.words(y)), similarity.char_similarity(x, y))

    kept = pairs.matching_items(pairs.spread(b), a, lambda item: score(item["ans_text"], F.col("stu_text")) >= min_similarity)
    return kept.withColumn("similarity", score(F.col("ans_text"), F.col("stu_text")))


def fk_match(
    answer_fks: DataFrame,
    student_fks: DataFrame,
    mapping: DataFrame,
    submissions: DataFrame,
    min_similarity: float = vocab.FK_MIN_SIMILARITY,
    measure: str = "cosine",
) -> DataFrame:
    """Every answer foreign key of every submission with its greedy one-to-one match."""
    ans = settle(fk_texts(answer_fks, plain=measure == "plain").select(F.col("fk_name").alias("ans_fk"), "fk_text"))
    # texts are made once per distinct relationship; a struct with nulls inside equals itself in a join
    relation = ["parent_table", "parent_cols", "ref_table", "ref_cols"]
    named = settle(translate_tables(student_fks, mapping).select("submission_id", F.col("fk_name").alias("stu_fk"), F.struct(*relation).alias("_fk")))
    described = settle(fk_texts(settle(named.select("_fk").distinct()).select("_fk", "_fk.*"), plain=measure == "plain").select("_fk", "fk_text"))
    stu = settle(pairs.join_back(named, described, ["_fk"]).select("submission_id", "stu_fk", "fk_text"))
    scored = settle(fk_similarity(ans, stu, min_similarity, measure))
    edges = (
        pairs.join_back(stu.withColumnRenamed("fk_text", "stu_text"), scored, ["stu_text"])
        .join(ans.withColumnRenamed("fk_text", "ans_text"), "ans_text")
        .select("submission_id", "ans_fk", "stu_fk", "similarity", "stu_text")
    )
    chosen = assign.greedy(edges, ["submission_id"], "ans_fk", "stu_fk", ["similarity"])
    every = pairs.per_submission(submissions, ans.withColumnRenamed("fk_text", "answer_fk"))
    return every.join(chosen, ["submission_id", "ans_fk"], "left").select(
        "submission_id", "ans_fk", "answer_fk", F.col("stu_text").alias("student_fk"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("similarity").isNotNull().alias("is_matched"),
    )


def pk_equal(answer_keys: DataFrame, student_keys: DataFrame, mapped: DataFrame) -> DataFrame:
    """(submission, ans_table, pk_ok): key columns equal as sets, by counting the common ones.

    ``answer_keys`` (ans_table, column_name), ``student_keys`` (submission_id, stu_table, column_name).
    """
    lead = ["submission_id", "ans_table", "stu_table"]
    m = mapped.select(*lead)
    ans = answer_keys.select("ans_table", "column_name").distinct().withColumn("a", F.lit(1))
    stu = student_keys.select("submission_id", "stu_table", "column_name").distinct().withColumn("b", F.lit(1))
    both = m.join(ans, "ans_table").select(*lead, "column_name", "a", F.lit(0).alias("b")).unionByName(
        m.join(stu, ["submission_id", "stu_table"]).select(*lead, "column_name", F.lit(0).alias("a"), "b")
    ).groupBy(*lead, "column_name").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    verdict = both.groupBy(*lead).agg(F.bool_and(F.col("a") == F.col("b")).alias("pk_ok"))
    return m.join(verdict, lead, "left").withColumn("pk_ok", F.coalesce("pk_ok", F.lit(True)))


def _column_sets(fks: DataFrame) -> DataFrame:
    return fks.withColumns({
        "parent_set": F.array_sort(F.array_distinct("parent_cols")), "ref_set": F.array_sort(F.array_distinct("ref_cols")),
    })


def fk_contained(answer_fks: DataFrame, student_fks: DataFrame, mapped: DataFrame) -> DataFrame:
    """(submission, ans_table, fk_ok): every answer foreign key of the table is also declared there.

    ``answer_fks`` (ans_table, parent_cols, ref_table, ref_cols), ``student_fks`` with
    (submission_id, stu_table, ...); column sets and referenced table must be equal.
    """
    lead = ["submission_id", "ans_table", "stu_table"]
    m = mapped.select(*lead)
    wanted = m.join(_column_sets(answer_fks).select("ans_table", "parent_set", "ref_table", "ref_set"), "ans_table")
    have = _column_sets(student_fks).select("submission_id", "stu_table", "parent_set", "ref_table", "ref_set").distinct()
    lacking = wanted.join(have, ["submission_id", "stu_table", "parent_set", "ref_table", "ref_set"], "left_anti").select(*lead).distinct()
    return m.join(lacking.withColumn("_lacks", F.lit(True)), lead, "left").select(*lead, F.col("_lacks").isNull().alias("fk_ok"))
