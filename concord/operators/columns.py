"""Matching columns inside mapped tables, and across whole schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import names, similarity, texts, typerules, vocab
from concord.operators import assign, pairs
from concord.operators.tables import shape_columns
from concord.session import settle

PAIR = ["ans_table", "stu_table", "shape"]


def answer_side(answer: DataFrame) -> DataFrame:
    return answer.select(
        F.col("cleaned_name").alias("ans_table"), F.col("ordinal").alias("ans_ordinal"),
        F.col("column_name").alias("ans_col"), F.col("data_type").alias("ans_type"),
        names.canonical("column_name").alias("ans_col_canon"),
    )


def student_side(content: DataFrame) -> DataFrame:
    return content.select(
        "shape", F.col("ordinal").alias("stu_ordinal"), F.col("column_name").alias("stu_col"),
        F.col("data_type").alias("stu_type"), names.canonical("column_name").alias("stu_col_canon"),
    )


def exact_columns(left: DataFrame, right: DataFrame, method: str = "two_phase") -> DataFrame:
    """First-fit matches of equal names inside a table pair: canonical, space-free or lower-case equal.

    ``left`` and ``right`` carry the pair; one equi-join per kind of equality.  'blended' counts
    canonical names only, 'plain' uses plainly canonical ones.
    """
    def meet(a: Column, b: Column) -> DataFrame:
        return left.withColumn("_k", a).join(right.withColumn("_k", b), [*PAIR, "_k"]).drop("_k")

    if method == "blended":
        edges = meet(F.col("ans_col_canon"), F.col("stu_col_canon"))
    else:
        # space-free equality covers canonical equality
        a, b = F.col("ans_col_canon"), F.col("stu_col_canon")
        if method == "plain":
            a, b = names.simple_canonical("ans_col"), names.simple_canonical("stu_col")
        edges = meet(names.squeeze(a), names.squeeze(b)).unionByName(
            meet(F.lower("ans_col"), F.lower("stu_col"))
        ).distinct()
    return assign.greedy(edges, PAIR, "ans_ordinal", "stu_ordinal", ["ans_ordinal", "stu_ordinal"], descending=False)


def _cosine_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """Residual columns of a pair joined through the cosines of distinct canonical names."""
    scored = settle(pairs.gram_edges(
        left.select(F.col("ans_col_canon").alias("a")).distinct().withColumn("text", F.col("a")),
        right.select(F.col("stu_col_canon").alias("b")).distinct().withColumn("text", F.col("b")),
        [], "a", "b",
    ))
    return left.withColumnRenamed("ans_col_canon", "a").join(scored, "a").join(
        right.withColumnRenamed("stu_col_canon", "b"), [*PAIR, "b"]
    ).select(*RESIDUAL)


RESIDUAL = [*PAIR, "ans_ordinal", "ans_col", "ans_type", "stu_ordinal", "stu_col", "stu_type", "cosine"]


def _text_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of a pair with the cosine of their texts 'table.column (type)'."""
    a = left.withColumn("text", texts.column_text(F.col("ans_table"), F.col("ans_col"), F.col("ans_type")))
    b = right.withColumn("text", texts.column_text(F.col("stu_table"), F.col("stu_col"), F.col("stu_type")))
    return pairs.gram_edges(a, b, PAIR, "ans_ordinal", "stu_ordinal")


def _blend_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """70 % cosine of column texts, 30 % token-set ratio of the names.

    A pair scores above 0 only if its texts share a gram or its names a letter.
    """
    ends = [*PAIR, "ans_ordinal", "stu_ordinal"]

    def letters(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(*PAIR, key, F.explode(F.array_distinct(F.split(name, ""))).alias("_letter"))

    by_letter = letters(left, "ans_ordinal", "ans_col_canon").join(
        letters(right, "stu_ordinal", "stu_col_canon"), [*PAIR, "_letter"]
    ).select(*ends, F.lit(0.0).alias("cosine"))
    meet = _text_edges(left, right).unionByName(by_letter).groupBy(*ends).agg(F.max("cosine").alias("text_cosine"))
    token = similarity.token_set_ratio("ans_col_canon", "stu_col_canon") / 100
    return meet.join(left, [*PAIR, "ans_ordinal"]).join(right, [*PAIR, "stu_ordinal"]).withColumn(
        "cosine", F.col("text_cosine") * 0.7 + token * 0.3
    )


def _plain_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """The larger of word Jaccard and share of equal positions.

    A pair scores above 0 only if it shares a word or has the same letter at the same place.
    """
    def marks(df: DataFrame, key: str, name: str) -> DataFrame:
        words = F.transform(similarity.words(names.simple_canonical(name)), lambda w: F.concat(F.lit("w:"), w))
        places = F.transform(F.split(F.lower(name), ""), lambda x, i: F.concat_ws(":", F.lit("p"), i.cast("string"), x))
        return df.select(*PAIR, key, F.explode(F.array_union(words, places)).alias("_mark"))

    meet = marks(left, "ans_ordinal", "ans_col").join(marks(right, "stu_ordinal", "stu_col"), [*PAIR, "_mark"]).select(
        *PAIR, "ans_ordinal", "stu_ordinal").distinct()
    a, b = F.col("ans_col"), F.col("stu_col")
    score = F.greatest(
        similarity.token_jaccard(names.simple_canonical(a), names.simple_canonical(b)), similarity.char_similarity(F.lower(a), F.lower(b)))
    return meet.join(left, [*PAIR, "ans_ordinal"]).join(right, [*PAIR, "stu_ordinal"]).withColumn("cosine", score)


def solve_pairs(answer: DataFrame, content: DataFrame, wanted: DataFrame, method: str = "two_phase") -> DataFrame:
    """Column matches of each wanted (answer table, table name, shape).

    'two_phase': equal names first (canonical, space-free or lower-case), the rest by cosine of
    the names, uncertain ones lifted by the cosine with types, matched from 0.75.
    'blended': equal canonical names first, the rest by 70 % text cosine and 30 % token set,
    matched from 0.82.  'text': everything by text cosine, matched from 0.82.  'plain': equal
    plain names first, the rest by words and letters, uncertain ones lifted by a shared word,
    matched from 0.75 with loosely equal types.
    """
    wanted = settle(wanted.select(*PAIR).distinct())
    left = settle(wanted.join(answer_side(answer), "ans_table"))
    right = settle(wanted.join(student_side(content), "shape").select(*PAIR, "stu_ordinal", "stu_col", "stu_type", "stu_col_canon"))
    fits = typerules.same_type("ans_type", "stu_type", "ans_col", "stu_col", "either" if method == "two_phase" else "both")
    if method == "plain":
        fits = typerules.loose_type("ans_type", "stu_type")
    keep = [*PAIR, "ans_ordinal", "stu_col", "stu_type", "score", "match"]
    matches = []
    rest_left, rest_right = left, right
    if method != "text":
        exact = settle(exact_columns(left, right, method))
        matches.append(exact.withColumn("score", F.lit(1.0)).withColumn("match", fits).select(*keep))
        rest_left = left.join(exact, [*PAIR, "ans_ordinal"], "left_anti")
        rest_right = right.join(exact, [*PAIR, "stu_ordinal"], "left_anti")
    if method == "two_phase":
        edges = _cosine_edges(rest_left, rest_right)
        typed = pairs.text_cosine(F.concat_ws(" ", "ans_col", "ans_type"), F.concat_ws(" ", "stu_col", "stu_type"))
        uncertain = F.col("cosine").between(vocab.UNCERTAIN_LOW, vocab.UNCERTAIN_HIGH)
        score = F.when(uncertain, F.greatest(F.col("cosine"), typed)).otherwise(F.col("cosine"))
        cutoff = vocab.COLUMN_MIN_SCORE
    elif method == "plain":
        edges = _plain_edges(rest_left, rest_right)
        score = similarity.shared_word_boost(F.col("cosine"), F.col("ans_col"), F.col("stu_col"), vocab.SHARED_WORDS)
        cutoff = vocab.COLUMN_MIN_SCORE
    else:
        if method == "blended":
            edges = _blend_edges(rest_left, rest_right)
        else:
            edges = _text_edges(left, right).join(left, [*PAIR, "ans_ordinal"]).join(right, [*PAIR, "stu_ordinal"])
        score, cutoff = F.col("cosine"), vocab.COLUMN_LEGACY_SCORE
    edges = edges.select(*RESIDUAL).withColumn("weight", pairs.micro(F.col("cosine"))).filter("weight > 0")
    chosen = assign.optimal(edges, PAIR, "ans_ordinal", "stu_ordinal", "weight")
    matches.append(chosen.withColumn("score", score).withColumn("match", (F.col("score") >= cutoff) & fits).select(*keep))
    return left.drop("ans_col_canon").join(reduce(DataFrame.unionByName, matches), [*PAIR, "ans_ordinal"], "left").withColumns({
        "score": F.coalesce("score", F.lit(0.0)), "match": F.coalesce("match", F.lit(False)),
    })


def column_pairs(answer: DataFrame, columns: DataFrame, mapping: DataFrame, method: str = "two_phase") -> DataFrame:
    """Every answer column of every submission with its match; unmapped tables give NULLs.

    Solved once per distinct (answer table, table name, shape), then joined to the mapping.
    """
    mapped = mapping.select("submission_id", "ans_table", "stu_table", "shape")
    shapes = mapped.filter("stu_table is not null").withColumnRenamed("stu_table", "cleaned_name")
    content = settle(shape_columns(columns, shapes))
    solved = settle(solve_pairs(answer, content, mapped.filter("stu_table is not null"), method))
    known = pairs.join_back(mapped.filter("stu_table is not null"), solved, PAIR)
    missing = mapped.filter("stu_table is null").join(
        answer_side(answer).drop("ans_col_canon"), "ans_table"
    ).withColumns({
        "stu_col": F.lit(None).cast("string"), "stu_type": F.lit(None).cast("string"), "score": F.lit(0.0), "match": F.lit(False),
    })
    out = ["submission_id", "ans_table", "ans_ordinal", "ans_col", "ans_type", "stu_table", "stu_col", "stu_type", "score", "match"]
    return known.select(*out).unionByName(missing.select(*out))


def schema_shapes(columns: DataFrame) -> DataFrame:
    """(submission, schema): equal schemas have equal cleaned tables, columns and types."""
    parts = ["cleaned_name", "ordinal", "column_name", "data_type"]
    return columns.groupBy("submission_id").agg(F.concat_ws(
        ":", F.count(F.lit(1)), F.hex(F.bit_xor(F.xxhash64(*parts))), F.hex(F.bit_xor(F.xxhash64(F.lit("second"), *parts)))
    ).alias("schema"))


def schema_columns(answer: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Optimal assignment over all columns of a schema at once, by column text cosine.

    Returns the matches per distinct schema and the schema of each submission.
    """
    schemas = settle(schema_shapes(columns))
    sample = schemas.groupBy("schema").agg(F.min("submission_id").alias("submission_id"))
    b = settle(student_column_texts(columns.join(sample, "submission_id"), ["schema"]).withColumnRenamed("text", "stu_text"))
    a = answer_column_texts(answer).withColumnRenamed("text", "ans_text")
    scored = settle(pairs.gram_edges(
        a.select("ans_text", F.col("ans_text").alias("text")),
        b.select("stu_text").distinct().withColumn("text", F.col("stu_text")), [], "ans_text", "stu_text",
    ))
    edges = b.select("schema", "stu_text").join(scored, "stu_text").withColumn("weight", pairs.micro(F.col("cosine")))
    chosen = assign.optimal(edges.filter("weight > 0"), ["schema"], "ans_text", "stu_text", "weight")
    matches = chosen.join(a, "ans_text").join(b, ["schema", "stu_text"]).select(
        "schema", "ans_table", "ans_col", "ans_type", "stu_table", "stu_col", "stu_type", "cosine",
        ((F.col("cosine") >= vocab.COLUMN_LEGACY_SCORE) & typerules.exact_type("ans_type", "stu_type")).alias("match"),
    )
    return settle(matches), schemas


def table_ratio(matches: DataFrame, answer: DataFrame, by: str) -> DataFrame:
    """Share of an answer table's columns matched in each table of the other side, pairs above 0 only."""
    sizes = answer.groupBy(F.col("cleaned_name").alias("ans_table")).agg(F.count(F.lit(1)).alias("n"))
    return matches.filter("match").groupBy(by, "ans_table", "stu_table").agg(F.count(F.lit(1)).alias("hits")).join(
        sizes, "ans_table"
    ).select(by, "ans_table", "stu_table", (F.col("hits") / F.col("n")).alias("ratio"))


def match_by_text(left: DataFrame, right: DataFrame, by: list[str], min_cosine: float = vocab.COLUMN_LEGACY_SCORE) -> DataFrame:
    """Optimal column assignment inside equal ``by`` values, on the cosine of the sides' ``text``.

    A match needs the cosine and the very same type; pairs below are kept with match false.
    """
    left, right = settle(left), settle(right)
    edges = pairs.gram_edges(left, right, by, "ans_ordinal", "stu_ordinal").withColumn("weight", pairs.micro(F.col("cosine")))
    chosen = assign.optimal(edges.filter("weight > 0"), by, "ans_ordinal", "stu_ordinal", "weight").drop("weight")
    return chosen.join(left.drop("text"), [*by, "ans_ordinal"]).join(right.drop("text"), [*by, "stu_ordinal"]).withColumn(
        "match", (F.col("cosine") >= min_cosine) & typerules.exact_type("ans_type", "stu_type")
    )


def answer_column_texts(answer: DataFrame) -> DataFrame:
    return answer_side(answer).drop("ans_col_canon").withColumn(
        "text", texts.column_text(F.col("ans_table"), F.col("ans_col"), F.col("ans_type"))
    )


def student_column_texts(columns: DataFrame, lead: list[str]) -> DataFrame:
    return columns.select(
        *lead, F.col("cleaned_name").alias("stu_table"), F.col("ordinal").alias("stu_ordinal"),
        F.col("column_name").alias("stu_col"), F.col("data_type").alias("stu_type"),
        texts.column_text(F.col("cleaned_name"), F.col("column_name"), F.col("data_type")).alias("text"),
    )


def refine_tables(matches: DataFrame, answer: DataFrame, columns: DataFrame, schemas: DataFrame) -> DataFrame:
    """Tables re-assigned by matched-column ratio, their columns then matched again by text cosine."""
    ratio = table_ratio(matches, answer, "schema").withColumn("weight", pairs.micro(F.col("ratio")))
    refined = settle(assign.optimal(ratio, ["schema"], "ans_table", "stu_table", "weight").select("schema", "ans_table", "stu_table"))
    sample = schemas.groupBy("schema").agg(F.min("submission_id").alias("submission_id"))
    return match_by_text(
        answer_column_texts(answer).join(refined, "ans_table"),
        student_column_texts(columns.join(sample, "submission_id"), ["schema"]).join(refined, ["schema", "stu_table"]),
        ["schema", "ans_table", "stu_table"],
    )
