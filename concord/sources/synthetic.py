"""Submissions derived from the star tables: one per customer, each a perturbed copy of the answer catalog.

All choices are integer arithmetic on the customer key, so any engine can rebuild them.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import local_table, with_each
from concord.sources import catalog, files
from concord.sources.tables import read_table

# The answer catalog: the star tables with their columns and types.
ANSWER = {
    "region": ["r_regionkey int", "r_name varchar"],
    "nation": ["n_nationkey int", "n_name varchar", "n_regionkey int"],
    "customer": ["c_custkey bigint", "c_name varchar", "c_nationkey int", "c_acctbal float", "c_mktsegment varchar"],
    "supplier": ["s_suppkey bigint", "s_name varchar", "s_nationkey int", "s_acctbal float"],
    "part": ["p_partkey bigint", "p_name varchar", "p_brand varchar", "p_type varchar", "p_size int", "p_retailprice float"],
    "orders": [
        "o_orderkey bigint", "o_custkey bigint", "o_orderstatus varchar", "o_totalprice float",
        "o_orderdate datetime", "o_orderpriority varchar",
    ],
    "lineitem": [
        "l_orderkey bigint", "l_partkey bigint", "l_suppkey bigint", "l_linenumber int", "l_quantity float",
        "l_extendedprice float", "l_discount float", "l_tax float", "l_returnflag varchar",
        "l_linestatus varchar", "l_shipdate datetime",
    ],
    "events": [
        "event_id bigint", "ts datetime", "user_id bigint", "event_type varchar", "value float", "props varchar",
    ],
}
TABLES = list(ANSWER)

# Two tables every reader has to drop again.
EXTRA = {"sysdiagrams": ["diagram_id int"], "StageOrders": ["o_orderkey bigint"]}

# (parent, column, referenced, column)
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
PRIMARY_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
}
EXPECTED_DELTA = {"customer": 1, "supplier": 1, "orders": 1, "lineitem": 1, "events": 1}

SWAPPED_TYPE = {"int": "bigint", "bigint": "varchar", "varchar": "nvarchar", "float": "int", "datetime": "varchar"}
ACCENTS = {"a": "á", "e": "ê", "o": "ố", "u": "ư"}


def name_variants(name: str) -> list[str]:
    """The column name under each of the ten variants (variant 3 is the missing column)."""
    short = re.sub(r"^[a-z]+_", "", name)
    camel = "".join(w.capitalize() for w in name.split("_"))
    accented = re.sub(r"[aeou]", lambda m: ACCENTS[m.group()], name, count=1)
    return [short, camel, name, name, name.upper(), accented, name, name, name, name]


def spec() -> list[tuple[int, str, int, str, str, list[str], str]]:
    """(table_no, table, ordinal, column, type, name variants, swapped type) for every catalog entry."""
    out = []
    for t, (table, columns) in enumerate({**ANSWER, **EXTRA}.items()):
        for o, entry in enumerate(columns, 1):
            name, dtype = entry.split()
            out.append((t, table, o, name, dtype, name_variants(name), SWAPPED_TYPE[dtype]))
    return out


def submission_of(key: Column) -> Column:
    return (key + 10000000).cast("string")


def _dropped(key: Column, t: Column) -> Column:
    return (
        ((t < 8) & ((key + t) % 11 == 0)) | ((t == 8) & (key % 3 != 0)) | ((t == 9) & (key % 4 != 0))
    )


def _table_name(key: Column, t: Column, table: Column) -> Column:
    number = F.concat(F.lpad((key % 97 + 1).cast("string"), 2, "0"), F.lit(". "))
    return F.when(
        (t < 8) & ((key + t) % 5 == 0),
        F.when(key % 2 == 0, F.concat(number, table)).otherwise(F.concat(F.lit("tbl_"), table)),
    ).otherwise(table)


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per submission, spread over the cluster because each becomes dozens of catalog rows."""
    key = F.col("c_custkey")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_table(spark, sf, "customer").select(submission_of(key).alias("submission_id"), key.alias("key")).repartition(n)


def _expand(spark: SparkSession, sf: str, entries: list[dict]) -> DataFrame:
    kinds = {int: "int", str: "string", list: "array<string>"}
    schema = ", ".join(f"`{name}` {kinds[type(value)]} not null" for name, value in entries[0].items())
    return with_each(submissions(spark, sf), local_table(spark, [tuple(e.values()) for e in entries], schema))


def raw_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Every column of every submission, system and stage tables included."""
    entries = [
        {"t": t, "table": table, "ordinal": o, "names": names, "dtype": dtype, "swapped": swapped}
        for t, table, o, _, dtype, names, swapped in spec()
    ]
    key, t = F.col("key"), F.col("t")
    v = ((key * 7 + t * 3 + F.col("ordinal")) % 10).cast("int")
    return (
        _expand(spark, sf, entries)
        .filter(~_dropped(key, t) & (v != 3))
        .select(
            "submission_id", _table_name(key, t, F.col("table")).alias("original_name"), "ordinal",
            F.get("names", v).alias("column_name"),
            F.when(v == 2, F.col("swapped")).otherwise(F.col("dtype")).alias("data_type"),
        )
    )


def raw_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Declared primary key columns; a key column that is missing is not declared."""
    facts = {(table, name): (t, o, names) for t, table, o, name, _, names, _ in spec()}
    entries = []
    for table, cols in PRIMARY_KEYS.items():
        for position, name in enumerate(cols, 1):
            t, o, names = facts[table, name]
            entries.append({"t": t, "table": table, "o": o, "position": position, "names": names})
    key, t = F.col("key"), F.col("t")
    v = ((key * 7 + t * 3 + F.col("o")) % 10).cast("int")
    name = _table_name(key, t, F.col("table"))
    return (
        _expand(spark, sf, entries)
        .filter(~_dropped(key, t) & (v != 3))
        .select(
            "submission_id", F.concat(F.lit("PK_"), F.col("table")).alias("pk_name"),
            # every seventh key was declared under another spelling of its table, every 13th under an unknown one
            F.when((key + t) % 13 == 0, F.concat(name, F.lit("_old")))
            .when((key + t) % 7 == 0, F.concat(F.lit(" "), F.upper(name))).otherwise(name).alias("original_name"),
            F.get("names", v).alias("column_name"), "position",
        )
    )


def raw_fks(spark: SparkSession, sf: str) -> DataFrame:
    """Declared foreign keys, one row per column pair; gone with either table or column."""
    facts = {(table, name): (t, o, names) for t, table, o, name, _, names, _ in spec()}
    entries = []
    for n, (parent, column, ref, ref_column) in enumerate(FOREIGN_KEYS, 1):
        pt, po, pnames = facts[parent, column]
        rt, ro, rnames = facts[ref, ref_column]
        entries.append({
            "n": n, "parent": parent, "ref": ref, "pt": pt, "po": po, "pnames": pnames, "rt": rt, "ro": ro, "rnames": rnames,
        })
    key, pt, rt = F.col("key"), F.col("pt"), F.col("rt")
    pv = ((key * 7 + pt * 3 + F.col("po")) % 10).cast("int")
    rv = ((key * 7 + rt * 3 + F.col("ro")) % 10).cast("int")
    return (
        _expand(spark, sf, entries)
        .filter(~_dropped(key, pt) & ~_dropped(key, rt) & (pv != 3) & (rv != 3))
        .select(
            "submission_id", F.format_string("FK_%d.%s_%d", F.col("n"), F.col("parent"), key % 5).alias("fk_name"),
            _table_name(key, pt, F.col("parent")).alias("parent_table"), F.get("pnames", pv).alias("fk_column"),
            _table_name(key, rt, F.col("ref")).alias("ref_table"), F.get("rnames", rv).alias("pk_column"),
            F.lit(1).alias("ordinal"),
        )
    )


def answer_columns(spark: SparkSession) -> DataFrame:
    rows = [(t, table, table.upper(), o, name, dtype) for t, table, o, name, dtype, _, _ in spec() if t < len(TABLES)]
    return local_table(
        spark, rows, "table_no int, original_name string, cleaned_name string, ordinal int, column_name string, data_type string"
    )


def answer_keys(spark: SparkSession) -> DataFrame:
    rows = [(t.upper(), c, n) for t, cols in PRIMARY_KEYS.items() for n, c in enumerate(cols, 1)]
    return local_table(spark, rows, "cleaned_name string, column_name string, position int")


def answer_fks(spark: SparkSession) -> DataFrame:
    rows = [
        (f"FK_{n}.{p}_0", p, c, r, rc, 1) for n, (p, c, r, rc) in enumerate(FOREIGN_KEYS, 1)
    ]
    return local_table(
        spark, rows, "fk_name string, parent_table string, fk_column string, ref_table string, pk_column string, ordinal int"
    )


def star_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, sf, t) for t in TABLES}


def answer_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of the star tables themselves."""
    return catalog.row_counts(star_tables(spark, sf))


# Fixed differences a submission's tables may have; variant 9 is a table that could not be counted.
COUNT_DELTA = [0, -1, 1, 0, 1, -1, 0, 1, 5, None]


def raw_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts per submission table: the answer count plus a difference; NULL when counting failed."""
    entries = [{"t": t, "table": n} for t, n in enumerate(TABLES)]
    key, t = F.col("key"), F.col("t")
    delta = F.get(F.array(*[F.lit(d).cast("int") for d in COUNT_DELTA]), ((key * 3 + t * 7) % 10).cast("int"))
    return (
        _expand(spark, sf, entries)
        .filter(~_dropped(key, t))
        .join(answer_counts(spark, sf).withColumnRenamed("original_name", "table"), "table")
        .select(
            "submission_id", _table_name(key, t, F.col("table")).alias("original_name"),
            (F.col("row_count") + delta).alias("row_count"),
        )
    )


VIEWS = ("v_orders_by_status", "v_lineitem_by_flag", "v_customers_by_segment")


def answer_view_queries(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Three named queries over the star tables, standing for the answer's views."""
    return {
        VIEWS[0]: read_table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")),
        VIEWS[1]: read_table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc")),
        VIEWS[2]: read_table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")),
    }


def raw_views(spark: SparkSession, sf: str, answer_views: DataFrame) -> DataFrame:
    """Views per submission: the answer's shapes, some with other columns, rows or names, some unreadable."""
    key, i = F.col("key"), F.col("i")
    entries = [{"i": n, "view_name": v} for n, v in enumerate(VIEWS)]
    return (
        _expand(spark, sf, entries)
        .join(answer_views, "view_name")
        .select(
            "submission_id",
            F.when((key + i) % 6 == 0, F.concat(F.lit("my_"), F.col("view_name"))).otherwise(F.col("view_name")).alias("view_name"),
            (F.col("num_columns") + ((key + i) % 4 == 0).cast("int")).alias("num_columns"),
            F.when((key + i) % 9 == 0, F.lit(None)).otherwise(F.col("num_rows") + ((key * 2 + i) % 5 == 0).cast("int")).alias("num_rows"),
            F.concat(F.lit("select * from "), F.col("view_name")).alias("definition"),
        )
    )


# Submissions that are also written as folders of real tables, and one with a table that can't be read.
FOLDER_KEYS = (1, 2, 3, 4)
UNREADABLE = (2, "audit_log")


def write_folders(spark: SparkSession, sf: str, root: str) -> None:
    """A folder of submissions: the answer's tables whole, each student's without a fifth of the rows.

    Tables, columns and their names are missing or changed as in ``raw_columns``; types stay.
    """
    star = star_tables(spark, sf)

    def write(job: tuple[DataFrame, str]) -> None:
        job[0].write.parquet(f"{root}/{job[1]}")

    jobs = [(df, f"dapan/{table}.parquet") for table, df in star.items()]
    for key in FOLDER_KEYS:
        for t, (table, df) in enumerate(star.items()):
            if (key + t) % 11 == 0:
                continue
            number = f"{key % 97 + 1:02d}. " if key % 2 == 0 else "tbl_"
            named = number + table if (key + t) % 5 == 0 else table
            kept = [F.col(col).alias(variants[(key * 7 + t * 3 + o) % 10]) for n, _, o, col, _, variants, _ in spec() if n == t and (key * 7 + t * 3 + o) % 10 != 3]
            jobs.append((df.filter(F.col(df.columns[0]) % 5 != key % 5).select(*kept), f"sv_{key + 10000000}/{named}"))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(write, jobs))
    key, table = UNREADABLE
    files.write_text(spark, f"{root}/sv_{key + 10000000}/{table}.parquet", "not a table")
