"""Matching answer tables with the tables of every submission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import similarity, texts, typerules, vocab
from concord.functions.names import simple_canonical
from concord.operators import assign, pairs
from concord.session import OPTIMAL_FOLD, settle

TABLE = ["submission_id", "cleaned_name"]

# Weight of any allowed table pair ahead of its columns and cosine, in whole units: a pair with
# no common column costs this much, so as many allowed pairs as possible are used.
PAIR_BONUS = 1_000_000


def table_shapes(columns: DataFrame) -> DataFrame:
    """(submission, table, original name, shape); equal shapes mean equal ordered columns and types.

    The shape is a count and two combined 64-bit hashes, so a table of any width is folded
    by partial aggregates without being collected.  Rows are first folded by original name too, where every
    aggregate is a number and is kept in a hash table; with the least name beside them all rows would be sorted.
    """
    parts = ["ordinal", "column_name", "data_type"]
    named = columns.groupBy(*TABLE, "original_name").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64(*parts)).alias("_one"), F.bit_xor(F.xxhash64(F.lit("second"), *parts)).alias("_two"))
    return named.groupBy(*TABLE).agg(
        F.min("original_name").alias("original_name"),
        F.concat_ws(":", F.sum("_n"), F.hex(F.bit_xor("_one")), F.hex(F.bit_xor("_two"))).alias("shape"),
    )


def shape_columns(columns: DataFrame, shapes: DataFrame) -> DataFrame:
    """The columns behind each distinct shape, read from one table that has it.

    Shapes are few against tables, so they go to the columns where these are.
    """
    sample = settle(shapes.groupBy("shape").agg(F.min(F.struct(*TABLE)).alias("t")).select("shape", "t.*"))
    return pairs.join_back(columns, sample, TABLE).select("shape", "ordinal", "column_name", "data_type")


def first_columns(columns: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """The column names per table in order, all or the first ``limit``."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda c: c["column_name"])
    return columns.groupBy(key).agg((F.slice(listed, 1, limit) if limit else listed).alias("first_columns"))


def answer_texts(answer: DataFrame) -> DataFrame:
    return first_columns(answer, "cleaned_name").select(
        F.col("cleaned_name").alias("ans_table"), texts.table_text(F.col("cleaned_name"), F.col("first_columns")).alias("text")
    )


def matching_columns(answer: DataFrame, content: DataFrame, hits: DataFrame) -> DataFrame:
    """First-fit count of answer columns found in each shape, by the name pairs in ``hits`` and loosely equal type."""
    a = answer.select(F.col("cleaned_name").alias("ans_table"), F.col("ordinal").alias("ans_ordinal"),
                      F.col("column_name").alias("ans_name"), F.col("data_type").alias("ans_type"))
    edges = (
        pairs.join_back(content, settle(hits.withColumnRenamed("stu_name", "column_name")), ["column_name"], salt_from="shape")
        .join(a, "ans_name")
        .filter(typerules.loose_type("ans_type", "data_type"))
        .select("shape", "ans_table", "ans_ordinal", F.col("ordinal").alias("stu_ordinal"))
    )
    taken = assign.greedy(
        edges, ["shape", "ans_table"], "ans_ordinal", "stu_ordinal", ["ans_ordinal", "stu_ordinal"], descending=False
    )
    return taken.groupBy("shape", "ans_table").agg(F.count(F.lit(1)).alias("n_cols"))


def table_edges(answer: DataFrame, columns: DataFrame, plain: bool = False, shapes: DataFrame | None = None) -> DataFrame:
    """Per submission, the table pairs with a common column: how many, and how similar the tables are.

    Columns count by fuzzy names and tables compare by the cosine of their texts, or with
    ``plain`` by word overlap of plainly canonical names alone.  Worked out once per distinct
    (table name, shape) and joined back.
    """
    shapes = settle(table_shapes(columns)) if shapes is None else shapes
    content = settle(shape_columns(columns, shapes))
    named = shapes.select("cleaned_name", "shape").distinct()
    if plain:
        counts = matching_columns(answer, content, pairs.plain_hits(answer, content))
        similar = plain_similarity(answer, named.join(content, "shape"), ["cleaned_name", "shape"]).select(
            "cleaned_name", "shape", "ans_table", F.col("similarity").alias("cosine"))
        scored = named.join(counts, "shape").join(similar, ["cleaned_name", "shape", "ans_table"], "left")
    else:
        counts = matching_columns(answer, content, pairs.name_hits(answer, content))
        text = texts.table_text(F.col("cleaned_name"), F.col("first_columns"))
        stu = settle(named.join(first_columns(content, "shape"), "shape").select(
            "cleaned_name", "shape", text.alias("text"), F.md5(text).alias("text_id")))
        cosines = pairs.gram_edges(answer_texts(answer), stu.select("text_id", "text").distinct(), [], "ans_table", "text_id")
        scored = stu.join(counts, "shape").join(cosines, ["ans_table", "text_id"], "left")
    scored = scored.select("cleaned_name", "shape", "ans_table", "n_cols", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
    return pairs.join_back(shapes, settle(scored), ["cleaned_name", "shape"]).select(
        "submission_id", "ans_table", F.col("cleaned_name").alias("stu_table"), "original_name", "shape", "n_cols", "cosine"
    )


def complete_map(matched: DataFrame, answer: DataFrame, submissions: DataFrame) -> DataFrame:
    """One row per submission and answer table; NULL where nothing was matched."""
    every = pairs.per_submission(submissions, answer.select(F.col("cleaned_name").alias("ans_table")).distinct())
    return every.join(matched, ["submission_id", "ans_table"], "left")


def table_map(
    answer: DataFrame,
    columns: DataFrame,
    submissions: DataFrame,
    min_cosine: float = vocab.TABLE_MIN_COSINE,
    plain: bool = False,
    shapes: DataFrame | None = None,
    cap: int = OPTIMAL_FOLD,
) -> DataFrame:
    """One-to-one table mapping by common columns first, cosine second; pairs under ``min_cosine`` are dropped."""
    edges = table_edges(answer, columns, plain, shapes).withColumn(
        "weight", (F.lit(PAIR_BONUS) + F.col("n_cols") * 1000) * 1000000 + pairs.micro(F.col("cosine"))
    )
    chosen = assign.optimal(edges, ["submission_id"], "ans_table", "stu_table", "weight", cap)
    return complete_map(chosen.filter(F.col("cosine") >= min_cosine).drop("weight"), answer, submissions)


def map_by_text(answer_texts: DataFrame, student_texts: DataFrame, min_cosine: float = vocab.TABLE_LEGACY_COSINE) -> DataFrame:
    """One-to-one table mapping by text cosine alone.

    ``answer_texts`` (ans_table, text); ``student_texts`` (submission_id, stu_table, text).
    """
    student_texts = student_texts.withColumn("text_id", F.md5("text"))
    distinct = student_texts.select("text_id", "text").distinct()
    scored = settle(pairs.gram_edges(answer_texts, distinct, [], "ans_table", "text_id"))
    edges = pairs.join_back(student_texts, scored, ["text_id"]).select(
        "submission_id", "ans_table", "stu_table", "cosine", pairs.micro(F.col("cosine")).alias("weight")
    )
    return assign.optimal(edges.filter("weight > 0"), ["submission_id"], "ans_table", "stu_table", "weight").drop(
        "weight"
    ).filter(F.col("cosine") >= min_cosine)


def column_containment(answer: DataFrame, columns: DataFrame) -> DataFrame:
    """Share of an answer table's column names that a submission's table has, pairs above 0 only.

    An equi-join on the raw name; ``position`` is the order of the submission's tables.
    """
    sizes = answer.groupBy(F.col("cleaned_name").alias("ans_table")).agg(F.count_distinct("column_name").alias("n"))
    a = answer.select(F.col("cleaned_name").alias("ans_table"), "column_name").distinct()
    return (
        columns.select(*TABLE, "column_name").distinct().join(a, "column_name")
        .groupBy(*TABLE, "ans_table").agg(F.count(F.lit(1)).alias("common"))
        .join(sizes, "ans_table")
        .select("submission_id", "ans_table", F.col("cleaned_name").alias("stu_table"), (F.col("common") / F.col("n")).alias("ratio"))
    )


def best_tables(containment: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` best tables per answer table, first by name among equals; not one-to-one."""
    w = Window.partitionBy("submission_id", "ans_table").orderBy(F.desc("ratio"), "stu_table")
    return containment.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def plain_similarity(answer: DataFrame, columns: DataFrame, lead: list[str] = TABLE) -> DataFrame:
    """Mean of table-name and column-set Jaccard on plainly canonical names, pairs above 0 only.

    Pairs meet on a shared column name or a shared name word; ``lead`` identifies a student
    table and includes its cleaned name.
    """
    def sets(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.collect_set(simple_canonical("column_name")).alias("cols")).withColumn(
            "words", similarity.words(simple_canonical("cleaned_name"))
        )

    a = sets(answer, ["cleaned_name"]).select(
        F.col("cleaned_name").alias("ans_table"), F.col("cols").alias("a_cols"), F.col("words").alias("a_words")
    )
    b = sets(columns, lead)

    def keys(cols: str, words: str):
        return F.explode(F.array_union(F.transform(cols, lambda c: F.concat(F.lit("c:"), c)),
                                       F.transform(words, lambda w: F.concat(F.lit("w:"), w))))

    meet = (
        b.select(*lead, keys("cols", "words").alias("k"))
        .join(a.select("ans_table", keys("a_cols", "a_words").alias("k")), "k")
        .select(*lead, "ans_table").distinct()
    )
    same = F.col("ans_table") == F.col("cleaned_name")
    name_sim = F.when(same, F.lit(1.0)).otherwise(similarity.jaccard(F.col("a_words"), F.col("words")))
    column_sim = similarity.jaccard(F.col("a_cols"), F.col("cols"))
    return meet.join(b, lead).join(a, "ans_table").select(
        *lead, "ans_table", name_sim.alias("name_similarity"), column_sim.alias("column_similarity"),
        ((name_sim + column_sim) / 2).alias("similarity"),
    )
