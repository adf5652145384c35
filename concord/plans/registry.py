"""Every operator as a named query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import names, similarity, texts, typerules, vocab
from concord.operators import assign, counts, keys, lookup, order, pairs, phrases, records, scores, tables, views
from concord.operators import columns as col_ops
from concord.plans import reports
from concord.plans.batch import Batch, folder_batch, star_batch
from concord.session import dictionary, local_table, scratch_dir, settle
from concord.sources import catalog, folders, store, synthetic
from concord.sources.tables import read_table
from concord.streaming import intake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Dictionaries used by the queries on names.
COLUMN_ALIASES = {"r_name": "region_name", "value": "amount", "n_name": "nation_name"}
NAME_ALIASES = {**vocab.NAME_ALIASES, "custkey": "customer key", "ts": "event time"}
NAME_SYNONYMS = {**vocab.NAME_SYNONYMS, "p size": "part size", "nationkey": "nation key"}
ABBREVIATIONS = {" C ": "Customer", "o": "Orders", "qty": "quantity"}
SYNONYMS = {"Customer Name": "client name", "orders": "purchase", "Key": "id"}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.prepare_columns(synthetic.raw_columns(spark, sf))


def _same_table_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (answer column, student column) met in tables of the same cleaned name."""
    a = synthetic.answer_columns(spark).select(
        "cleaned_name", F.col("column_name").alias("ans_name"), F.col("data_type").alias("ans_type"))
    b = _columns(spark, sf).select(
        "cleaned_name", F.col("column_name").alias("stu_name"), F.col("data_type").alias("stu_type")).distinct()
    return b.join(a, "cleaned_name").select("ans_name", "ans_type", "stu_name", "stu_type").distinct()


def _canonical_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return settle(_same_table_pairs(spark, sf).select(
        names.canonical("ans_name").alias("a"), names.canonical("stu_name").alias("b")).distinct())


# --- catalogs -----------------------------------------------------------------------------

@query
def catalog_columns(spark, sf):
    return _columns(spark, sf)


@query
def alias_columns(spark, sf):
    return catalog.prepare_columns(synthetic.raw_columns(spark, sf), aliases=COLUMN_ALIASES)


@query
def ordered_catalog(spark, sf):
    """Every column in the order of its submission, table and ordinal, with a running number over all of them."""
    return order.numbered(_columns(spark, sf).drop("cleaned_name"), ["submission_id", "original_name", "ordinal"])


@query
def catalog_early_rows(spark, sf):
    return catalog.prepare_rows_early(synthetic.raw_columns(spark, sf), {**COLUMN_ALIASES, "events": "event_log"})


@query
def catalog_stats(spark, sf):
    return catalog.statistics(_columns(spark, sf), synthetic.raw_keys(spark, sf), synthetic.raw_fks(spark, sf))


def _composite_fks(spark, sf):
    """One constraint per parent table, of several columns."""
    return synthetic.raw_fks(spark, sf).select(
        "submission_id", F.concat(F.lit("FK_"), "parent_table").alias("fk_name"), "parent_table", F.lit("all").alias("ref_table"),
        F.substring("fk_name", 4, 1).cast("int").alias("ordinal"), "fk_column", "pk_column")


@query
def catalog_stats_composite(spark, sf):
    """The same figures where foreign keys have several columns."""
    return catalog.statistics(_columns(spark, sf), synthetic.raw_keys(spark, sf), _composite_fks(spark, sf))


@query
def nested_schema(spark, sf):
    folded = catalog.fold_schema(_columns(spark, sf))
    entry = F.transform("cols", lambda c: F.format_string("%s %s", c["name"], c["type"]))
    return folded.select("submission_id", "cleaned_name", "original_name", F.array_join(entry, ", ").alias("cols"), "collision")


@query
def star_catalog(spark, sf):
    """Column catalog of the star tables themselves, with their row counts."""
    star = synthetic.star_tables(spark, sf)
    return catalog.columns_of(star, vocab.ANSWER_ID).join(catalog.row_counts(star), "original_name")


@query
def distinct_submissions(spark, sf):
    cols = synthetic.raw_columns(spark, sf)
    answer = synthetic.answer_columns(spark).select(
        F.lit(vocab.ANSWER_ID).alias("submission_id"), "original_name", "ordinal", "column_name", "data_type")
    return catalog.grading_batch(cols.unionByName(answer))


@query
def base_tables(spark, sf):
    """Columns of base tables: J2 semi-join against the table list, empty tables dropped."""
    cols = synthetic.raw_columns(spark, sf)
    listed = cols.select("submission_id", "original_name").distinct().withColumn(
        "table_type", F.when(names.is_stage("original_name"), F.lit("VIEW")).otherwise(F.lit("BASE TABLE")))
    kept = catalog.only_base_tables(cols, listed)
    return catalog.drop_empty_tables(listed, kept).select("submission_id", "original_name")


@query
def key_usage(spark, sf):
    """Primary keys from constraint and key usage tables, folded in key order."""
    raw = synthetic.raw_keys(spark, sf)
    constraint = F.concat("pk_name", F.lit("_"), "original_name").alias("constraint_name")
    constraints = raw.select("submission_id", constraint, F.lit("PRIMARY KEY").alias("constraint_type")).distinct()
    usage = raw.select("submission_id", constraint, F.col("original_name").alias("table_name"), "column_name",
                       F.col("position").alias("ordinal_position"))
    folded = catalog.fold_keys(catalog.keys_from_constraints(constraints, usage), ["submission_id", "pk_name", "original_name"])
    return folded.withColumn("pk", F.concat_ws(",", "pk"))


@query
def clean_table_names(spark, sf):
    t = synthetic.raw_columns(spark, sf).select("original_name").distinct()
    return t.select(
        "original_name", names.clean_table("original_name").alias("cleaned"), names.clean_table("original_name", compat=True).alias("compat"),
        names.clean_table_plain("original_name").alias("plain"), names.is_system("original_name").alias("is_system"),
        names.is_stage("original_name").alias("is_stage"), names.is_stage("original_name", prefix_only=True).alias("stage_prefix"),
    )


@query
def normalize_names(spark, sf):
    """Whole documents and every column name in normal form."""
    docs = read_table(spark, sf, "documents").select(F.concat(F.lit("doc "), "doc_id").alias("item"), names.normalize("text").alias("normalized"))
    cols = synthetic.raw_columns(spark, sf).select("column_name").distinct().select(
        F.concat(F.lit("column "), "column_name").alias("item"), names.normalize("column_name").alias("normalized"))
    return docs.unionByName(cols)


def _all_names(spark, sf):
    raw = synthetic.raw_columns(spark, sf)
    return raw.select(F.col("column_name").alias("name")).union(raw.select("original_name")).union(
        read_table(spark, sf, "part").select("p_name")).distinct()


@query
def canonical_names(spark, sf):
    return _all_names(spark, sf).select("name", names.canonical("name", NAME_ALIASES, NAME_SYNONYMS).alias("canonical"))


@query
def canonical_tokens(spark, sf):
    abbr = catalog.domain_dictionary(local_table(spark, list(ABBREVIATIONS.items()), "k string, v string"), "k", "v", normalised=False)
    syn = catalog.domain_dictionary(local_table(spark, list(SYNONYMS.items()), "k string, v string"), "k", "v", normalised=True)
    abbr, syn = dictionary(abbr, "k", "v"), dictionary(syn, "k", "v")
    return _all_names(spark, sf).select("name", names.canonical_tokens("name", abbr, syn).alias("canonical"))


@query
def name_forms(spark, sf):
    return _all_names(spark, sf).select(
        "name", names.simple_canonical("name").alias("plain"), names.acronym("name").alias("acronym"),
        names.is_stage("name").alias("is_stage"), typerules.is_code_column("name").alias("is_code"),
        typerules.is_code_column("name", vocab.CODE_WORDS_EARLY).alias("is_code_early"))


@query
def submission_ids(spark, sf):
    return read_table(spark, sf, "pages").select(
        "page_id", names.file_stem("url").alias("stem"), names.submission_id("url").alias("submission_id"))


@query
def fk_fold(spark, sf):
    """One constraint per parent table, its columns in order."""
    return catalog.fold_fks(_composite_fks(spark, sf)).select(
        "submission_id", "fk_name", "parent_table", "ref_table",
        F.array_join("parent_cols", "|").alias("parent_cols"), F.array_join("ref_cols", "|").alias("ref_cols"))


@query
def fk_text(spark, sf):
    """Foreign keys to text and back, described by canonical names."""
    read = catalog.read_fk_info(catalog.fk_info(synthetic.raw_fks(spark, sf))).filter("submission_id is not null and fk_name is not null")
    described = keys.fk_texts(read).select("*", F.col("fk_text").alias("described"))
    return keys.fk_texts(described, plain=True).select(
        "submission_id", "fk_name", F.size("parent_cols").alias("n_columns"), F.col("described").alias("fk_text"), F.col("fk_text").alias("plain_text"))


@query
def fk_system_tables(spark, sf):
    """Foreign keys joined from system tables with surrogate ids."""
    raw = synthetic.raw_fks(spark, sf)
    cols = synthetic.raw_columns(spark, sf)
    table_id = F.xxhash64("submission_id", "original_name")
    t = cols.select("submission_id", "original_name").distinct().select("submission_id", table_id.alias("table_id"), F.col("original_name").alias("name"))
    c = cols.select("submission_id", table_id.alias("table_id"), F.xxhash64("column_name").alias("column_id"), F.col("column_name").alias("name"))
    fks = raw.select("submission_id", "fk_name", F.xxhash64("fk_name").alias("fk_id"),
                     F.xxhash64("submission_id", "parent_table").alias("parent_id"), F.xxhash64("submission_id", "ref_table").alias("ref_id"))
    fk_columns = raw.select("submission_id", F.xxhash64("fk_name").alias("fk_id"), "ordinal",
                            F.xxhash64("fk_column").alias("parent_column_id"), F.xxhash64("pk_column").alias("ref_column_id"))
    return catalog.fks_from_system_tables(fks, fk_columns, t, c)


@query
def fk_relationships(spark, sf):
    return catalog.relationships(synthetic.raw_fks(spark, sf))


@query
def fk_clean(spark, sf):
    return catalog.clean_fk_names(synthetic.raw_fks(spark, sf)).select(
        "submission_id", "fk_name", "parent_table", "fk_column", "ref_table", "pk_column")


@query
def attach_keys(spark, sf):
    found, _ = catalog.attach_by_name(_columns(spark, sf), synthetic.raw_keys(spark, sf))
    return found.select("submission_id", "table_name", "original_name", "column_name", "position")


@query
def unresolved_keys(spark, sf):
    _, missing = catalog.attach_by_name(_columns(spark, sf), synthetic.raw_keys(spark, sf))
    return missing.select("submission_id", "original_name", "column_name", "position")


@query
def key_ids(spark, sf):
    """Key columns with surrogate ids, and why the others have none."""
    cols = _columns(spark, sf)
    table_id = F.concat_ws("/", "submission_id", "original_name")
    t = cols.select("submission_id", "original_name").distinct().withColumn("table_id", table_id)
    c = cols.select("submission_id", table_id.alias("table_id"), "column_name").distinct().withColumn(
        "column_id", F.concat_ws("/", "table_id", "column_name"))
    found, missing = store.resolve_ids(synthetic.raw_keys(spark, sf), t, c)
    out = ["submission_id", "original_name", "column_name", "column_id", "missing"]
    return found.withColumn("missing", F.lit(None).cast("string")).select(*out).unionByName(missing.select(*out))


# --- names and types ----------------------------------------------------------------------

@query
def type_compat(spark, sf):
    p = _same_table_pairs(spark, sf)
    args = ("ans_type", "stu_type", "ans_name", "stu_name")
    return p.select(
        *args, typerules.family("stu_type").alias("family"), typerules.same_type(*args).alias("same_either"),
        typerules.same_type(*args, mode="both").alias("same_both"), typerules.loose_type("ans_type", "stu_type").alias("loose"),
        typerules.exact_type("ans_type", "stu_type").alias("exact"))


def _scored(spark, sf, score):
    return _canonical_pairs(spark, sf).select("a", "b", F.round(score("a", "b"), 6).alias("score"))


@query
def ratio_pairs(spark, sf):
    return _scored(spark, sf, similarity.ratio)


@query
def partial_ratio_pairs(spark, sf):
    return _scored(spark, sf, similarity.partial_ratio)


@query
def token_set_pairs(spark, sf):
    return _scored(spark, sf, similarity.token_set_ratio)


@query
def fuzzy_pairs(spark, sf):
    return _scored(spark, sf, similarity.fuzzy).withColumn("is_equal", F.col("score") >= vocab.FUZZY_MIN)


@query
def smart_pairs(spark, sf):
    return _scored(spark, sf, similarity.smart)


@query
def name_hits(spark, sf):
    return pairs.name_hits(synthetic.answer_columns(spark), _columns(spark, sf))


@query
def name_hits_joined(spark, sf):
    """The same pairs met through joins on letters, as for an answer of any length."""
    return pairs.name_hits(synthetic.answer_columns(spark), _columns(spark, sf), limit=0)


@query
def jaccard_pairs(spark, sf):
    p = _same_table_pairs(spark, sf).select("ans_name", "stu_name").distinct()
    plain = [names.simple_canonical(c) for c in ("ans_name", "stu_name")]
    return p.select("ans_name", "stu_name", F.round(similarity.token_jaccard(*plain) * 100, 6).alias("score"))


@query
def char_sim_pairs(spark, sf):
    p = _same_table_pairs(spark, sf).select("ans_name", "stu_name").distinct()
    return p.select("ans_name", "stu_name", F.round(similarity.char_similarity(F.lower("ans_name"), F.lower("stu_name")), 6).alias("score"))


@query
def pattern_boost(spark, sf):
    """Column similarity with the shared-word boost in the uncertain band."""
    p = _same_table_pairs(spark, sf).select("ans_name", "stu_name").distinct()
    a, b = F.col("ans_name"), F.col("stu_name")
    base = F.greatest(
        similarity.token_jaccard(names.simple_canonical(a), names.simple_canonical(b)), similarity.char_similarity(F.lower(a), F.lower(b)))
    p = p.withColumn("base", base)
    return p.select("ans_name", "stu_name", F.round("base", 6).alias("base"),
                    F.round(similarity.shared_word_boost(F.col("base"), a, b, vocab.SHARED_WORDS), 6).alias("score"))


@query
def plain_table_similarity(spark, sf):
    s = tables.plain_similarity(synthetic.answer_columns(spark), _columns(spark, sf))
    return s.select("submission_id", "ans_table", F.col("cleaned_name").alias("stu_table"), *[F.round(c, 6).alias(c) for c in ("name_similarity", "column_similarity", "similarity")])


# --- texts and vectors --------------------------------------------------------------------

@query
def table_texts(spark, sf):
    """Short description of every distinct student table."""
    cols = _columns(spark, sf)
    shapes = settle(tables.table_shapes(cols))
    first = settle(tables.first_columns(tables.shape_columns(cols, shapes), "shape"))
    return pairs.join_back(shapes, first, ["shape"]).select(
        "submission_id", "cleaned_name", texts.table_text(F.col("cleaned_name"), F.col("first_columns")).alias("text"))


@query
def wide_table_texts(spark, sf):
    """All columns of a submission as one table: texts hold every name."""
    wide = tables.first_columns(_columns(spark, sf), "submission_id")
    return wide.select("submission_id", texts.table_text(F.lit("WIDE"), F.col("first_columns")).alias("text"),
                       texts.table_text(F.lit("WIDE"), F.col("first_columns"), vocab.TABLE_TEXT_COLUMNS).alias("short_text"))


@query
def full_table_texts(spark, sf):
    """Table descriptions with types, keys and foreign keys."""
    b = star_batch(spark, sf)
    return b.full_texts(b.columns, b.student_keys, b.cleaned_fks(b.fks, ["submission_id"], "stu_table"), ["submission_id"], "stu_table")


@query
def column_texts(spark, sf):
    return _columns(spark, sf).select(
        "submission_id", "ordinal", texts.column_text(F.col("cleaned_name"), F.col("column_name"), F.col("data_type")).alias("text"))


@query
def hash_embed(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(texts.hash_vector(F.col("text"))).alias("place", "v")).select(
        "doc_id", "place", F.round("v", 6).alias("value"))


@query
def domain_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", texts.domain_text(F.col("text")).alias("text"))


@query
def domain_text_joined(spark, sf):
    """The same texts by the join that takes a dictionary of any size."""
    entries = local_table(spark, [(n, p, s) for n, (p, s) in enumerate(vocab.DOMAIN_PATTERNS.items())], "position int, phrase string, synonyms array<string>")
    return phrases.expanded(read_table(spark, sf, "documents"), "doc_id", "text", entries)


@query
def phrase_hits(spark, sf):
    """Part names, and every run of 24 characters that starts a third of a benchmark passage apart, found in whole documents."""
    starts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.substring("text", F.floor(k * F.length("text") / 3).cast("int") + 1, F.lit(24)))
    passages = read_table(spark, sf, "benchmark").select(F.explode(starts).alias("phrase"))
    wanted = passages.unionByName(read_table(spark, sf, "part").select(F.col("p_name").alias("phrase")))
    return phrases.phrase_hits(read_table(spark, sf, "documents"), "doc_id", "text", wanted)


@query
def gram_cosine(spark, sf):
    """Cosine of every answer table text with every distinct student table text."""
    ans = tables.answer_texts(synthetic.answer_columns(spark))
    stu = settle(table_texts(spark, sf).select("text").distinct())
    edges = pairs.gram_edges(ans, stu.withColumn("stu_text", F.col("text")), [], "ans_table", "stu_text")
    return edges.select("ans_table", "stu_text", F.round("cosine", 6).alias("cosine"))


@query
def embedding_cache(spark, sf):
    """Two passes over one cache: the second embeds only texts the first did not bring."""
    path = _scratch(spark, "embeddings")
    store.embed_cached(read_table(spark, sf, "benchmark").select("text"), path)
    both = read_table(spark, sf, "benchmark").select("text").union(read_table(spark, sf, "conversations").select("text"))
    done = store.embed_cached(both, path)
    return done.select("key", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.size(texts.pad(F.col("vector"))).alias("width"))


def _vector_cosines(spark, sf):
    v = read_table(spark, sf, "embeddings")
    return records.target_cosines(v, "embedding", records.centroids(v, "label", "embedding"), "label")


@query
def dense_cosine_topk(spark, sf):
    """The five label centroids nearest to every vector."""
    return records.nearest_targets(_vector_cosines(spark, sf), "vec_id", 5).withColumnRenamed("target", "label")


@query
def vector_link(spark, sf):
    """One vector per label centroid, greedily by cosine over all pairs at once."""
    return records.vector_link(_vector_cosines(spark, sf), "vec_id", 0.0).select("vec_id", F.col("target").alias("label"), "cosine")


def _halves(spark, sf):
    v = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    return v.filter("vec_id % 2 = 0"), v.filter("vec_id % 2 = 1"), "vec_id", "embedding", 0.3


@query
def vector_nearest(spark, sf):
    """The nearest vector of odd id for every vector of even id, from cosine 0.3 on."""
    return records.nearest_vectors(*_halves(spark, sf))


@query
def vector_pairs(spark, sf):
    """Vectors of even and of odd id linked one-to-one."""
    return records.link_vectors(*_halves(spark, sf)).select("a_id", "b_id", "cosine")


@query
def vector_assign(spark, sf):
    """One vector per label centroid with the largest total cosine; one group of all pairs, far over the fold's size given."""
    return records.vector_assign(_vector_cosines(spark, sf), "vec_id", 0.0, cap=1_000).select("vec_id", F.col("target").alias("label"), "cosine")


# --- tables and columns -------------------------------------------------------------------

@query
def first_fit_columns(spark, sf):
    """Columns of every answer table found in every distinct student table, first fit."""
    cols, answer = _columns(spark, sf), synthetic.answer_columns(spark)
    shapes = settle(tables.table_shapes(cols))
    content = settle(tables.shape_columns(cols, shapes))
    n = settle(tables.matching_columns(answer, content, pairs.name_hits(answer, content)))
    return pairs.join_back(shapes, n, ["shape"]).select("submission_id", "ans_table", F.col("cleaned_name").alias("stu_table"), "n_cols")


@query
def table_edges(spark, sf):
    e = tables.table_edges(synthetic.answer_columns(spark), _columns(spark, sf))
    return e.select("submission_id", "ans_table", "stu_table", "n_cols", F.round("cosine", 6).alias("cosine"))


@query
def table_map(spark, sf):
    m = tables.table_map(synthetic.answer_columns(spark), _columns(spark, sf), synthetic.submissions(spark, sf))
    return m.select("submission_id", "ans_table", "stu_table", "original_name", "n_cols", F.round("cosine", 6).alias("cosine"))


@query
def table_map_plain(spark, sf):
    """Table mapping without fuzzy names or embeddings."""
    m = tables.table_map(synthetic.answer_columns(spark), _columns(spark, sf), synthetic.submissions(spark, sf), plain=True)
    return m.select("submission_id", "ans_table", "stu_table", "n_cols", F.round("cosine", 6).alias("similarity"))


@query
def table_map_text(spark, sf):
    return star_batch(spark, sf).text_map.select("submission_id", "ans_table", "stu_table", F.round("cosine", 6).alias("cosine"))


@query
def unmapped_tables(spark, sf):
    """Answer tables without a student table, and student tables nothing was mapped to."""
    b = star_batch(spark, sf)
    m = b.table_map
    answer_side = m.filter("stu_table is null").select("submission_id", F.col("ans_table").alias("table_name"), F.lit("answer").alias("side"))
    own = b.shapes.select("submission_id", F.col("cleaned_name").alias("table_name"))
    used = m.filter("stu_table is not null").select("submission_id", F.col("stu_table").alias("table_name"))
    return answer_side.unionByName(own.join(used, ["submission_id", "table_name"], "left_anti").withColumn("side", F.lit("student")))


@query
def exact_column_match(spark, sf):
    """Equal names inside tables of the same cleaned name, with the type check."""
    cols, answer = _columns(spark, sf), synthetic.answer_columns(spark)
    shapes = settle(tables.table_shapes(cols))
    content = settle(tables.shape_columns(cols, shapes))
    wanted = shapes.select(F.col("cleaned_name").alias("ans_table"), F.col("cleaned_name").alias("stu_table"), "shape").distinct()
    left = wanted.join(col_ops.answer_side(answer), "ans_table")
    right = wanted.join(col_ops.student_side(content), "shape").select(
        *col_ops.PAIR, "stu_ordinal", "stu_col", "stu_type", "stu_col_canon")
    found = settle(col_ops.exact_columns(left, right))
    ok = typerules.same_type("ans_type", "stu_type", "ans_col", "stu_col")
    own = shapes.select("submission_id", F.col("cleaned_name").alias("stu_table"), "shape")
    return pairs.join_back(own, found, ["stu_table", "shape"]).select(
        "submission_id", "ans_table", "ans_col", "stu_col", ok.alias("match"))


def _pairs_out(p):
    return p.select("submission_id", "ans_table", "ans_col", "ans_type", "stu_table", "stu_col", "stu_type",
                    F.round("score", 6).alias("score"), "match")


@query
def column_pairs(spark, sf):
    return _pairs_out(star_batch(spark, sf).column_pairs)


@query
def column_pairs_blended(spark, sf):
    b = star_batch(spark, sf)
    return _pairs_out(col_ops.column_pairs(b.answer_columns, b.columns, b.table_map, "blended"))


@query
def column_pairs_single_phase(spark, sf):
    b = star_batch(spark, sf)
    return _pairs_out(col_ops.column_pairs(b.answer_columns, b.columns, b.table_map, "text"))


@query
def column_pairs_plain(spark, sf):
    b = star_batch(spark, sf)
    return _pairs_out(col_ops.column_pairs(b.answer_columns, b.columns, b.table_map, "plain"))


@query
def schema_columns(spark, sf):
    matches, schemas = col_ops.schema_columns(synthetic.answer_columns(spark), _columns(spark, sf))
    return pairs.join_back(schemas, matches, ["schema"]).select(
        "submission_id", "ans_table", "ans_col", "stu_table", "stu_col", F.round("cosine", 6).alias("cosine"), "match")


@query
def table_ratio(spark, sf):
    answer = synthetic.answer_columns(spark)
    matches, schemas = col_ops.schema_columns(answer, _columns(spark, sf))
    ratio = settle(col_ops.table_ratio(matches, answer, "schema"))
    return pairs.join_back(schemas, ratio, ["schema"]).select("submission_id", "ans_table", "stu_table", F.round("ratio", 6).alias("ratio"))


@query
def refined_columns(spark, sf):
    answer, cols = synthetic.answer_columns(spark), _columns(spark, sf)
    matches, schemas = col_ops.schema_columns(answer, cols)
    refined = settle(col_ops.refine_tables(matches, answer, cols, schemas))
    return pairs.join_back(schemas, refined, ["schema"]).select(
        "submission_id", "ans_table", "ans_col", "stu_table", "stu_col", F.round("cosine", 6).alias("cosine"), "match")


@query
def best_table(spark, sf):
    c = tables.column_containment(synthetic.answer_columns(spark), _columns(spark, sf))
    return tables.best_tables(c).select("submission_id", "ans_table", "stu_table", F.round("ratio", 6).alias("ratio"))


@query
def table_suggestions(spark, sf):
    """Up to five tables per answer table."""
    c = tables.column_containment(synthetic.answer_columns(spark), _columns(spark, sf))
    return tables.best_tables(c, k=5).select("submission_id", "ans_table", "stu_table", F.round("ratio", 6).alias("ratio"), "rank")


@query
def blocked_lookup(spark, sf):
    return lookup.blocked_lookup(synthetic.answer_columns(spark), _columns(spark, sf), synthetic.submissions(spark, sf))


@query
def blocked_lookup_joined(spark, sf):
    """The same lookup with table names met through joins on letters."""
    return lookup.blocked_lookup(synthetic.answer_columns(spark), _columns(spark, sf), synthetic.submissions(spark, sf), limit=0)


@query
def lookup_totals(spark, sf):
    return lookup.lookup_totals(blocked_lookup(spark, sf))


# --- keys ---------------------------------------------------------------------------------

def _fk_out(p):
    return p.select("submission_id", "ans_fk", "answer_fk", "student_fk", F.round("similarity", 6).alias("similarity"), "is_matched")


@query
def fk_match(spark, sf):
    return _fk_out(star_batch(spark, sf).fk_pairs)


@query
def fk_match_plain(spark, sf):
    """The dependency-free similarity of foreign key texts."""
    b = star_batch(spark, sf)
    return _fk_out(keys.fk_match(
        catalog.fold_fks(b.answer_fks, []), catalog.fold_fks(b.fks), b.table_map, b.submissions, measure="plain"))


@query
def fk_ratio(spark, sf):
    r = scores.match_ratio(star_batch(spark, sf).fk_pairs, "is_matched", "fk_ratio")
    return r.select("submission_id", F.round("fk_ratio", 6).alias("fk_ratio"))


@query
def pk_fk_check(spark, sf):
    """Key and reference equality of tables with the same cleaned name."""
    b = star_batch(spark, sf)
    answer = b.answer_columns.select(F.col("cleaned_name").alias("ans_table")).distinct()
    mapped = b.shapes.select("submission_id", F.col("cleaned_name").alias("stu_table")).join(
        answer, F.col("stu_table") == F.col("ans_table"))
    mapped = settle(mapped)
    pk = keys.pk_equal(b.answer_keys.withColumnRenamed("cleaned_name", "ans_table"), b.student_keys, mapped)
    fk = keys.fk_contained(b.cleaned_fks(b.answer_fks, [], "ans_table"), b.cleaned_fks(b.fks, ["submission_id"], "stu_table"), mapped)
    return pk.join(fk, ["submission_id", "ans_table", "stu_table"]).select("submission_id", "ans_table", "pk_ok", "fk_ok")


@query
def table_report(spark, sf):
    return scores.table_report(star_batch(spark, sf).table_results).withColumn("cosine", F.round("cosine", 6))


@query
def schema_score(spark, sf):
    return star_batch(spark, sf).schema_score.withColumn("column_ratio", F.round("column_ratio", 6))


# --- counts and views ---------------------------------------------------------------------

@query
def table_row_counts(spark, sf):
    return synthetic.answer_counts(spark, sf)


def _plain_checks(spark, sf):
    """Count checks over tables of the same cleaned name, in place of a table mapping."""
    b = star_batch(spark, sf)
    answer = b.answer_columns.select("original_name", F.col("cleaned_name").alias("ans_table")).distinct()
    matched = b.shapes.select("submission_id", F.col("cleaned_name").alias("ans_table"), F.col("cleaned_name").alias("stu_table"), "original_name").join(
        answer.select("ans_table"), "ans_table", "left_semi")
    mapping = tables.complete_map(matched, b.answer_columns, b.submissions)
    by_table = b.answer_counts.join(answer, "original_name")
    return settle(counts.count_checks(mapping, by_table, b.counts, b.expected)), b


@query
def count_checks(spark, sf):
    return _plain_checks(spark, sf)[0].select(
        "submission_id", "ans_table", "original_name", "answer_count", "student_count", "difference", "exact_match",
        "is_business", "expected_increase", "error", "status")


@query
def count_overall(spark, sf):
    checks, b = _plain_checks(spark, sf)
    return counts.count_overall(checks, b.expected)


@query
def count_report(spark, sf):
    checks, b = _plain_checks(spark, sf)
    return counts.count_report(checks, counts.count_overall(checks, b.expected))


@query
def count_report_before(spark, sf):
    checks, b = _plain_checks(spark, sf)
    return counts.count_report(checks, counts.count_overall(checks, b.expected), baseline="before")


@query
def count_summary(spark, sf):
    checks, b = _plain_checks(spark, sf)
    return counts.count_summary(checks, counts.count_overall(checks, b.expected))


@query
def row_count_reconcile(spark, sf):
    """Lineitem rows per supplier against the version without returned items."""
    items = read_table(spark, sf, "lineitem")
    return records.reconcile_counts(items, items.filter("l_returnflag <> 'R'"), ["l_suppkey"])


@query
def order_count_reconcile(spark, sf):
    """Orders per customer in all orders against those still open."""
    o = read_table(spark, sf, "orders")
    return records.reconcile_counts(o, o.filter("o_orderstatus <> 'F'"), ["o_custkey"])


def _delta(spark, sf):
    key = names.squeeze(names.canonical("original_name"))
    student = synthetic.raw_counts(spark, sf).select(
        "submission_id", names.squeeze(names.canonical(names.clean_table("original_name"))).alias("table_key"), "row_count")
    answer = synthetic.answer_counts(spark, sf).select(key.alias("table_key"), "row_count")
    return counts.business_delta(synthetic.submissions(spark, sf), synthetic.EXPECTED_DELTA, answer, student)


@query
def business_delta(spark, sf):
    return _delta(spark, sf)


@query
def score_distribution(spark, sf):
    return counts.score_distribution(_delta(spark, sf))


@query
def delta_statistics(spark, sf):
    return counts.delta_statistics(_delta(spark, sf))


@query
def customer_growth(spark, sf):
    """Rule check on rows: every customer is expected to have one open order more than finished ones."""
    o = read_table(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("answer_count"), F.count_if(F.col("o_orderstatus") == "O").alias("student_count"),
    ).withColumn("actual_increase", F.col("student_count") - F.col("answer_count")).withColumn("correct", F.col("actual_increase") == 1)


@query
def view_shapes(spark, sf):
    return catalog.view_shapes(synthetic.answer_view_queries(spark, sf))


def _views(spark, sf):
    answer = settle(view_shapes(spark, sf))
    return answer, synthetic.raw_views(spark, sf, answer)


@query
def view_definitions(spark, sf):
    return _views(spark, sf)[1].select("submission_id", "view_name", "definition")


@query
def view_match_shape(spark, sf):
    return views.match_by_shape(*_views(spark, sf))


@query
def view_match_name(spark, sf):
    return views.match_by_name(*_views(spark, sf))


@query
def view_match(spark, sf):
    return views.match_one_to_one(*_views(spark, sf)).select("submission_id", "view", "stu_view")


# --- rows ---------------------------------------------------------------------------------

@query
def key_check(spark, sf):
    checks = [
        records.key_check(read_table(spark, sf, t), synthetic.PRIMARY_KEYS[t], t) for t in synthetic.TABLES
    ] + [records.key_check(read_table(spark, sf, "conversations"), ["conv_id", "turn"], "conversations")]
    return reduce(DataFrame.unionByName, checks)


@query
def orphan_check(spark, sf):
    return reduce(DataFrame.unionByName, [
        records.orphan_check(read_table(spark, sf, p), [c], read_table(spark, sf, r), [rc], f"{p}.{c}") for p, c, r, rc in synthetic.FOREIGN_KEYS
    ] + [records.orphan_check(read_table(spark, sf, "documents"), ["doc_id"], read_table(spark, sf, "labels"), ["doc_id"], "documents.doc_id")])


@query
def record_link(spark, sf):
    """Supplier names linked with customer names."""
    a = read_table(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    b = read_table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    return records.record_link(a, b, 0.3, 60.0).select("a_name", "b_name", "score")


@query
def part_name_link(spark, sf):
    """Part names against their shape in upper case with the brand in front, linked one-to-one."""
    p = read_table(spark, sf, "part")
    a = p.select(F.col("p_name").alias("name"))
    b = p.select(F.upper(F.concat_ws(" ", "p_type", "p_name")).alias("name"))
    return records.record_link(a, b, 0.5, 70.0).select("a_name", "b_name", "score")


@query
def tied_pairs(spark, sf):
    """Parts handed to suppliers whose nation is numbered like their size, larger sizes first: large blocks of equal scores."""
    parts = read_table(spark, sf, "part").select("p_partkey", "p_size")
    handed_to = read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("p_size"), "s_suppkey")
    # parts of one size are linked with the same suppliers, so they are one class of ends
    sizes, nations = (settle(df.select("p_size").distinct()) for df in (parts, handed_to))
    edges = pairs.join_back(pairs.spread(sizes), nations, ["p_size"], salt_from="p_size").select(
        F.lit(0).alias("_all"), F.col("p_size").alias("_left"), F.col("p_size").alias("_right"), "p_size")
    ends = (parts.select(F.lit(0).alias("_all"), F.col("p_size").alias("_left"), "p_partkey"),
            handed_to.select(F.lit(0).alias("_all"), F.col("p_size").alias("_right"), "s_suppkey"))
    return assign.greedy(edges, ["_all"], "p_partkey", "s_suppkey", ["p_size"], ends=ends).drop("_all")


@query
def score_card(spark, sf):
    """Weighted marks per customer from checks on the orders."""
    o = read_table(spark, sf, "orders")
    return scores.score_card(o, "o_custkey", {
        "finished": (F.col("o_orderstatus") == "F", 4.0),
        "prioritised": (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 2.0),
        "large": (F.col("o_totalprice") > 250000, 4.0),
    })


# --- marks --------------------------------------------------------------------------------

@query
def summary(spark, sf):
    return star_batch(spark, sf).summary


@query
def batch_stats(spark, sf):
    return scores.batch_statistics(star_batch(spark, sf).schema_score, "schema_score")


@query
def report_enriched(spark, sf):
    b = star_batch(spark, sf)
    out = scores.enrich(b.schema_score, b.count_overall, b.fk_pairs, len(synthetic.TABLES))
    return out.withColumns({"fk_ratio": F.round("fk_ratio", 6), "business_percentage": F.round("business_percentage", 6),
                            "table_match_ratio": F.round("table_match_ratio", 6)})


# --- folders and report files -------------------------------------------------------------

def _folder(spark, sf):
    root = _scratch(spark, "submissions")
    synthetic.write_folders(spark, sf, root)
    return root


@query
def folder_catalog(spark, sf):
    """Column catalog of a folder of Parquet submissions, the answer included, from footers alone."""
    return catalog.prepare_columns(folders.columns_in(folders.read_folder(spark, _folder(spark, sf))))


@query
def folder_counts(spark, sf):
    """Row counts of the same folder; one table can't be read."""
    c = folders.counts_in(folders.read_folder(spark, _folder(spark, sf)))
    return c.select("submission_id", "original_name", "row_count", F.col("error").isNotNull().alias("failed"))


@query
def folder_summary(spark, sf):
    """Marks of the submissions in the folder."""
    return folder_batch(spark, _folder(spark, sf), expected=synthetic.EXPECTED_DELTA, n_views=len(synthetic.VIEWS)).summary


@query
def summary_from_files(spark, sf):
    """Every report written as one file per submission, and the summary worked out again from the files."""
    b, path = star_batch(spark, sf), _scratch(spark, "reports")
    reports.write_reports(b, path)
    return reports.summary_from_files(spark, path, b.n_views, b.submissions)


# --- stores and streams -------------------------------------------------------------------

@query
def store_replace(spark, sf):
    """Orders stored per customer nation, then the finished ones of every customer replace their rows."""
    path = _scratch(spark, "store")
    own = read_table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("submission_id"))
    o = read_table(spark, sf, "orders").join(own, F.col("o_custkey") == F.col("c_custkey")).select("submission_id", "o_orderkey", "o_orderstatus")
    store.replace_submissions(o, path)
    store.replace_submissions(o.filter("o_orderstatus = 'F'"), path)
    return store.read_store(spark, path).groupBy("submission_id").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query
def report_round_trip(spark, sf):
    """The view report written as CSV and read back."""
    path = _scratch(spark, "views")
    report = views.match_by_name(*_views(spark, sf))
    store.write_report(report, path)
    back = store.read_report(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in report.schema.fields))
    return scores.view_ratio(back, vocab.EXPECTED_VIEWS).select("submission_id", F.round("view_ratio", 4).alias("view_ratio"))


@query
def incremental_intake(spark, sf):
    """Events totalled per user as files arrive, one user a submission; every user's rows are spread over three files, one a batch."""
    folder, out, checkpoint = (_scratch(spark, n) for n in ("events", "intake", "intake-state"))
    events = read_table(spark, sf, "events")
    events.repartition(3).write.parquet(folder)

    def totals(batch):
        return batch.groupBy(F.col("user_id").cast("string").alias("submission_id")).agg(
            F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))

    def merge(parts):
        return parts.groupBy("submission_id").agg(F.sum("events").alias("events"), F.sum("errors").alias("errors"))

    intake.total_arrivals(spark, folder, events.schema, totals, merge, out, checkpoint, files_per_batch=1, merge_every=2).awaitTermination()
    return intake.read_totals(spark, merge, out)


@query
def order_intake(spark, sf):
    """Customers graded on their orders, which come in four files, two a batch: grades that do not add up, over all rows so far."""
    folder, out, rows, checkpoint = (_scratch(spark, n) for n in ("orders", "grades", "rows", "grades-state"))
    orders = read_table(spark, sf, "orders")
    orders.repartition(4).write.parquet(folder)

    def grade(o):
        return o.groupBy(F.col("o_custkey").cast("string").alias("submission_id")).agg(
            F.count_distinct("o_orderpriority").alias("priorities"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"),
            F.median("o_totalprice").alias("middle_price"))

    intake.grade_parts(spark, folder, orders.schema, grade, out, rows, checkpoint, 2, submission="o_custkey").awaitTermination()
    return store.read_store(spark, out).select("submission_id", "priorities", "last_order", F.round("middle_price", 4).alias("middle_price"))


@query
def catalog_intake(spark, sf):
    """Whole catalogs graded as their files arrive, one submission in one file: the column ratio of every submission."""
    folder, out, checkpoint = (_scratch(spark, n) for n in ("catalogs", "grades", "grades-state"))
    raw = synthetic.raw_columns(spark, sf)
    raw.repartition(4, "submission_id").write.parquet(folder)

    def grade(arrived):
        arrived = settle(pairs.spread(arrived, "submission_id"))  # a large file of one row group is one task
        b = Batch(
            submissions=arrived.select("submission_id").distinct(), answer_columns=synthetic.answer_columns(arrived.sparkSession),
            columns=settle(catalog.prepare_columns(arrived)),
        )
        return scores.match_ratio(b.column_pairs, "match", "column_ratio")

    intake.grade_arrivals(spark, folder, raw.schema, grade, out, checkpoint, files_per_batch=2).awaitTermination()
    return store.read_store(spark, out).select("submission_id", F.round("column_ratio", 6).alias("column_ratio"))
