"""From catalogs to marks: the whole batch as one sequence of joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import names, texts, vocab
from concord.operators import columns as col_ops
from concord.operators import counts, keys, pairs, scores, tables, views
from concord.session import local_table, plan_by_rows, settle
from concord.sources import catalog, folders, synthetic


class Batch:
    """One answer and many submissions, with every stage worked out once, when asked for.

    Inputs are DataFrames or functions giving one: ``submissions``, the catalog tables
    ``columns``, ``keys``, ``fks``, ``counts`` and ``views`` as in ``concord.sources.catalog``,
    and the same for the answer as ``answer_*`` without a submission id.
    """

    INPUTS = (
        "submissions", "answer_columns", "answer_keys", "answer_fks", "answer_counts", "answer_views",
        "columns", "keys", "fks", "counts", "views",
    )

    def __init__(
        self,
        expected: dict[str, int] = vocab.EXPECTED_DELTA,
        n_views: int = vocab.EXPECTED_VIEWS,
        baseline: str = "after",
        **inputs: DataFrame | Callable[[], DataFrame],
    ):
        self.expected, self.n_views, self.baseline = expected, n_views, baseline
        self._inputs = inputs

    def __getattr__(self, name: str) -> DataFrame:
        if name not in Batch.INPUTS:
            raise AttributeError(name)
        given = self._inputs[name]
        value = given() if callable(given) else given
        setattr(self, name, value)
        return value

    @cached_property
    def shapes(self) -> DataFrame:
        """Every student table with its original name and shape."""
        return settle(tables.table_shapes(self.columns))

    @cached_property
    def table_map(self) -> DataFrame:
        return settle(tables.table_map(self.answer_columns, self.columns, self.submissions, shapes=self.shapes))

    @cached_property
    def column_pairs(self) -> DataFrame:
        return col_ops.column_pairs(self.answer_columns, self.columns, self.table_map)

    @cached_property
    def fk_pairs(self) -> DataFrame:
        return keys.fk_match(catalog.fold_fks(self.answer_fks, []), catalog.fold_fks(self.fks), self.table_map, self.submissions)

    @cached_property
    def count_checks(self) -> DataFrame:
        by_table = self.answer_counts.join(
            self.answer_columns.select("original_name", F.col("cleaned_name").alias("ans_table")).distinct(), "original_name"
        )
        return settle(counts.count_checks(self.table_map, by_table, self.counts, self.expected))

    @cached_property
    def count_overall(self) -> DataFrame:
        return counts.count_overall(self.count_checks, self.expected)

    @cached_property
    def count_report(self) -> DataFrame:
        return counts.count_report(self.count_checks, self.count_overall, self.baseline)

    @cached_property
    def view_matches(self) -> DataFrame:
        return views.match_one_to_one(self.answer_views, self.views)

    @cached_property
    def summary(self) -> DataFrame:
        return scores.summary(
            self.submissions, self.column_pairs, self.fk_pairs, self.count_report, self.view_matches, self.n_views
        )

    def cleaned_fks(self, fks: DataFrame, lead: list[str], table: str) -> DataFrame:
        folded = catalog.fold_fks(fks, lead)
        return folded.select(
            *lead, "fk_name", names.clean_table("parent_table").alias(table), "parent_cols",
            names.clean_table("ref_table").alias("ref_table"), "ref_cols",
        )

    def full_texts(self, columns: DataFrame, pk: DataFrame, fks: DataFrame, lead: list[str], table: str) -> DataFrame:
        by = [*lead, table]
        cols = columns.withColumnRenamed("cleaned_name", table).groupBy(*by).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", F.col("column_name").alias("name"), F.col("data_type").alias("type")))),
            lambda c: F.struct(c["name"], c["type"])).alias("cols"))
        key = catalog.fold_keys(pk, by)
        ref = fks.groupBy(*by).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("fk_name", "parent_cols", "ref_table", "ref_cols"))),
            lambda f: F.struct(f["parent_cols"], f["ref_table"].alias("ref"), f["ref_cols"])).alias("refs"))
        joined = cols.join(key, by, "left").join(ref, by, "left")
        refs = F.transform("refs", lambda f: F.struct(F.col(table).alias("parent"), f["parent_cols"], f["ref"], f["ref_cols"]))
        empty_pk = F.array().cast("array<string>")
        empty_fk = F.filter(F.array(F.struct(F.lit("").alias("parent"), empty_pk.alias("parent_cols"), F.lit("").alias("ref"), empty_pk.alias("ref_cols"))),
                            lambda x: F.lit(False))
        return joined.select(*by, texts.table_text_full(
            F.col(table), F.col("cols"), F.coalesce("pk", empty_pk), F.coalesce(refs, empty_fk)).alias("text"))

    @cached_property
    def student_keys(self) -> DataFrame:
        """Declared keys attached to their tables by name, with the cleaned table name."""
        named = self.shapes.select("submission_id", "original_name", F.col("cleaned_name").alias("stu_table"))
        found, _ = catalog.attach_by_name(self.shapes, self.keys)
        return settle(found.drop("original_name").withColumnRenamed("table_name", "original_name").join(
            named, ["submission_id", "original_name"]).select("submission_id", "stu_table", "column_name", "position"))

    @cached_property
    def text_map(self) -> DataFrame:
        """Table mapping of the schema score: cosine of full texts, 0.80 and above."""
        ans_pk = self.answer_keys.withColumnRenamed("cleaned_name", "ans_table")
        ans = self.full_texts(self.answer_columns, ans_pk, self.cleaned_fks(self.answer_fks, [], "ans_table"), [], "ans_table")
        stu = self.full_texts(self.columns, self.student_keys, self.cleaned_fks(self.fks, ["submission_id"], "stu_table"), ["submission_id"], "stu_table")
        return settle(tables.map_by_text(ans, settle(stu)))

    @cached_property
    def table_results(self) -> DataFrame:
        """Per mapped table of the schema score: columns, key and references."""
        content = tables.shape_columns(self.columns, self.shapes)
        mapped = settle(self.text_map.join(self.shapes.select("submission_id", F.col("cleaned_name").alias("stu_table"), "shape"), ["submission_id", "stu_table"]))
        by = ["ans_table", "stu_table", "shape"]
        wanted = mapped.select(*by).distinct()
        left = wanted.join(col_ops.answer_column_texts(self.answer_columns), "ans_table")
        right = wanted.join(content.withColumnRenamed("column_name", "stu_col").withColumnRenamed("data_type", "stu_type").withColumnRenamed("ordinal", "stu_ordinal"), "shape")
        right = right.withColumn("text", texts.column_text(F.col("stu_table"), F.col("stu_col"), F.col("stu_type")))
        solved = col_ops.match_by_text(left, right, by).filter("match").groupBy(*by).agg(F.count(F.lit(1)).alias("matched_cols"))
        matches = pairs.join_back(mapped, settle(solved), by).select("submission_id", "ans_table", "matched_cols")
        ans_pk = self.answer_keys.withColumnRenamed("cleaned_name", "ans_table")
        pk = keys.pk_equal(ans_pk, self.student_keys, mapped)
        fk = keys.fk_contained(
            self.cleaned_fks(self.answer_fks, [], "ans_table"), self.cleaned_fks(self.fks, ["submission_id"], "stu_table"), mapped
        )
        return settle(scores.table_results(mapped, matches, pk, fk, self.answer_columns))

    @cached_property
    def schema_score(self) -> DataFrame:
        return scores.schema_score(self.table_results, self.submissions, self.answer_columns)


def folder_batch(spark: SparkSession, root: str, **settings) -> Batch:
    """The batch of a folder of Parquet submissions, the answer's folder among them.

    Footers know neither keys nor views, so the marks for these stay 0; give ``keys``, ``fks`` or ``views`` (and the
    answer's) where they are known from elsewhere.
    """
    plan_by_rows(spark)
    found = settle(folders.read_folder(spark, root))
    columns = catalog.prepare_columns(folders.columns_in(found))
    counts_of = folders.counts_in(found)
    key = "original_name string, column_name string, position int"
    fk = "fk_name string, parent_table string, fk_column string, ref_table string, pk_column string, ordinal int"
    view = "view_name string, num_columns int, num_rows bigint"
    none = {"keys": f"submission_id string, pk_name string, {key}", "answer_keys": key.replace("original", "cleaned"), "fks": f"submission_id string, {fk}",
            "answer_fks": fk, "views": f"submission_id string, {view}", "answer_views": view}
    inputs = {name: local_table(spark, [], schema) for name, schema in none.items()} | {
        "submissions": settle(folders.of_students(found).select("submission_id").distinct()),
        "columns": folders.of_students(columns), "answer_columns": folders.of_answer(columns),
        "counts": folders.of_students(counts_of), "answer_counts": folders.of_answer(counts_of)}
    return Batch(**(inputs | settings))


def star_batch(spark: SparkSession, sf: str) -> Batch:
    """The batch derived from the star tables: one submission per customer."""
    batch = Batch(
        expected=synthetic.EXPECTED_DELTA,
        n_views=len(synthetic.VIEWS),
        submissions=lambda: synthetic.submissions(spark, sf),
        answer_columns=lambda: synthetic.answer_columns(spark),
        answer_keys=lambda: synthetic.answer_keys(spark),
        answer_fks=lambda: synthetic.answer_fks(spark),
        answer_counts=lambda: synthetic.answer_counts(spark, sf),
        answer_views=lambda: settle(catalog.view_shapes(synthetic.answer_view_queries(spark, sf))),
        # settled, as several stages read them and each would make and clean all rows anew
        columns=lambda: settle(catalog.prepare_columns(synthetic.raw_columns(spark, sf))),
        keys=lambda: synthetic.raw_keys(spark, sf),
        fks=lambda: settle(synthetic.raw_fks(spark, sf)),
        counts=lambda: synthetic.raw_counts(spark, sf),
        views=lambda: synthetic.raw_views(spark, sf, batch.answer_views),
    )
    return batch
