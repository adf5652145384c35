"""Where lineage is cut and where small sides are proven small."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

# A group folded inside one task never holds more edges than this; larger groups
# take the round-based path of the same operator.
GREEDY_FOLD = 2_048
OPTIMAL_FOLD = 16_384

# Bytes of rows for a byte of Parquet: a row of two short names takes 48 bytes in memory, one or two in a file.
ROWS_PER_FILE = 32.0

# Dictionaries turned into literal maps are configuration; more entries than this is an error.
DICTIONARY_LIMIT = 10_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    A cluster names it in spark.checkpoint.dir.  Only a local session, which has one
    machine anyway, may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
            named = tempfile.mkdtemp(prefix="concord-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts the lineage of round-based operators, survives lost executors and gives the
    optimizer real sizes for the joins that follow.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_by_rows(spark: SparkSession) -> None:
    """Has the optimizer take a file as ``ROWS_PER_FILE`` times its bytes, unless the job says otherwise.

    Catalogs repeat a few names and types, so their files take a few bytes a row; taken for the size of the rows, a table
    of millions of rows passes for a small one and is collected in the driver to be broadcast.  What is really small
    is still broadcast once it has been shuffled and its size is known.
    """
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) == 1.0:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(ROWS_PER_FILE))


def with_each(df: DataFrame, items: DataFrame) -> DataFrame:
    """Every row with every one of a few items, a local table.

    Unlike a literal array that is exploded, the join has an estimated size that grows with the items, so what is
    derived from it never passes for a small table.
    """
    return df.crossJoin(F.broadcast(items))


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table whose size the optimizer knows (a plain createDataFrame hides it)."""
    fields = DataType.fromDDL(schema).fields
    typed = pa.schema([pa.field(f.name, to_arrow_type(f.dataType), f.nullable) for f in fields])
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return spark.createDataFrame(pa.table([list(c) for c in columns], schema=typed))


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"double('{v!r}')"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(sql_literal(x) for x in v) + ")"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_rows(rows: list[dict]) -> Column:
    """A constant array of structs from a few Python rows, parsed in one go."""
    structs = [
        "named_struct(" + ", ".join(f"'{k}', {sql_literal(v)}" for k, v in row.items()) + ")" for row in rows
    ]
    return F.expr("array(" + ", ".join(structs) + ")")


def dictionary(df: DataFrame, key: str, value: str, limit: int = DICTIONARY_LIMIT) -> dict[str, str]:
    """A dictionary table as a Python dict, refused when it is larger than ``limit``."""
    rows = df.select(key, value).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"dictionary has more than {limit} entries")
    return {r[0]: r[1] for r in rows}
