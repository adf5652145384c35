"""Folders of Parquet submissions: catalogs and row counts from footers alone, reports as one file per submission.

Footers are read and reports written by Python data sources of Spark, report files are named and read in tasks, so the
work is dealt like any scan or write, and the driver holds no list of files.  Paths are opened through
pyarrow's file systems (local and shared folders, HDFS, object stores).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from concord.functions import names, vocab
from concord.session import settle
from concord.sources.catalog import SPARK_TYPES

CATALOG = "folder string, original_name string, ordinal int, column_name string, data_type string, row_count bigint, error string"

#: Tasks that read footers, at most.
READERS = 256


def _footers():
    """The data source; nested so that tasks receive it by value."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    spelling, schema, most = SPARK_TYPES, CATALOG, READERS

    class Folders(InputPartition):
        def __init__(self, listed: list[str]):
            self.listed = listed

    class Footers(DataSourceReader):
        def __init__(self, path: str):
            self.path = path

        def _open(self):
            from pyarrow import fs

            return fs.FileSystem.from_uri(self.path)

        def partitions(self) -> list[InputPartition]:
            """The names of the submissions' folders, dealt out in turn; nothing below them is looked at here."""
            from pyarrow import fs

            system, root = self._open()
            found = system.get_file_info(fs.FileSelector(root))
            listed = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", ".")))
            n = min(most, len(listed)) or 1
            return [Folders(listed[k::n]) for k in range(n)]

        def _tables(self, system, folder: str) -> Iterator[tuple[str, list[str]]]:
            """Each table of a folder with its files: a Parquet file, or a folder of them."""
            from pyarrow import fs

            for entry in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda f: f.base_name):
                name = entry.base_name.removesuffix(".parquet")
                if entry.base_name.startswith(("_", ".")):
                    continue
                if entry.type == fs.FileType.Directory:
                    parts = system.get_file_info(fs.FileSelector(entry.path, recursive=True))
                    yield name, sorted(p.path for p in parts if p.type == fs.FileType.File and p.path.endswith(".parquet") and not p.base_name.startswith(("_", ".")))
                elif entry.base_name.endswith(".parquet"):
                    yield name, [entry.path]

        def _footer(self, system, path: str) -> tuple[list[tuple[str, str]], int]:
            import pyarrow.parquet as pq
            from pyspark.sql.pandas.types import from_arrow_type

            def spelled(kind) -> str:
                try:
                    plain = from_arrow_type(kind).simpleString()
                except Exception:  # noqa: BLE001  a type that Spark has no name for keeps its own
                    plain = str(kind)
                return spelling.get(plain, plain)

            with system.open_input_file(path) as file:
                footer = pq.ParquetFile(file)
                return [(f.name, spelled(f.type)) for f in footer.schema_arrow], footer.metadata.num_rows

        def read(self, partition: Folders) -> Iterator[tuple]:
            import pyarrow as pa

            system, root = self._open()
            for folder in partition.listed:
                for table, files in self._tables(system, f"{root}/{folder}"):
                    try:
                        footers = [self._footer(system, f) for f in files]
                        if not footers:
                            raise ValueError("no Parquet file")
                        if any(columns != footers[0][0] for columns, _ in footers):
                            raise ValueError("files of different columns")
                    except (pa.ArrowException, OSError, ValueError) as failed:
                        yield folder, table, None, None, None, None, f"{type(failed).__name__}: {failed}"[:500]
                        continue
                    rows = sum(n for _, n in footers)
                    if not footers[0][0]:
                        yield folder, table, None, None, None, rows, None
                    for ordinal, (column, kind) in enumerate(footers[0][0], 1):
                        yield folder, table, ordinal, column, kind, rows, None

    class TableFolders(DataSource):
        @classmethod
        def name(cls) -> str:
            return "table_folders"

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Footers(self.options["path"])

    return TableFolders


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every table of every submission under ``path``/<submission>/<table>[.parquet]: a row per column, with the table's row count.

    A table is a Parquet file or a folder of them.  Only footers are read.  One that can't be read, or whose files
    disagree, is one row with its ``error``, without columns or count.  The submission id comes from the folder's name.
    """
    spark.dataSource.register(_footers())
    return spark.read.format("table_folders").load(path).withColumn("submission_id", names.submission_id("folder"))


def columns_in(catalog: DataFrame) -> DataFrame:
    """The column catalog of what ``read_folder`` found."""
    return catalog.filter("ordinal is not null").select("submission_id", "original_name", "ordinal", "column_name", "data_type")


def counts_in(catalog: DataFrame) -> DataFrame:
    """Row counts of what ``read_folder`` found; null with an error where a table could not be counted."""
    return catalog.groupBy("submission_id", "original_name").agg(F.max("row_count").alias("row_count"), F.max("error").alias("error"))


def of_answer(df: DataFrame) -> DataFrame:
    return df.filter(F.col("submission_id") == vocab.ANSWER_ID).drop("submission_id")


def of_students(df: DataFrame) -> DataFrame:
    return df.filter(F.col("submission_id") != vocab.ANSWER_ID)


def _report_files():
    """The data source that writes reports; nested so that tasks receive it by value."""
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    @dataclass
    class Written(WriterCommitMessage):
        listing: str

    class Reports(DataSourceWriter):
        def __init__(self, options: dict, columns: list[str]):
            self.path, self.report, self.run, self.columns = options["path"], options["report"], options["run"], columns

        def _open(self):
            from pyarrow import fs

            return fs.FileSystem.from_uri(self.path)

        def write(self, rows: Iterator) -> Written:
            """Rows come sorted by submission, so one file is open at a time; it is listed, with the name that it is to have, in a file of the task."""
            import csv
            import io
            import json
            import uuid

            system, root = self._open()
            folder, attempt = f"{root}/_writing-{self.run}", uuid.uuid4().hex
            system.create_dir(folder, recursive=True)
            system.create_dir(f"{root}/_listed-{self.run}", recursive=True)
            now, out, text = None, None, None
            with io.TextIOWrapper(system.open_output_stream(f"{root}/_listed-{self.run}/{attempt}"), "utf-8", newline="") as listing:
                for row in rows:
                    if out is None or row[0] != now:
                        if out is not None:
                            text.flush()
                            text.close()
                        now = row[0]
                        written = f"{folder}/{now}-{attempt}"
                        listing.write(json.dumps([written, f"{root}/{now}_{self.report}.csv"]) + "\n")
                        text = io.TextIOWrapper(system.open_output_stream(written), "utf-8", newline="")
                        out = csv.writer(text)
                        out.writerow(self.columns)
                    out.writerow(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row[1:]])
                if out is not None:
                    text.flush()
                    text.close()
            return Written(attempt)

        def commit(self, messages: list) -> None:
            """Only the listings of the tasks that count stay."""
            from pyarrow import fs

            system, root = self._open()
            counted = {m.listing for m in messages if m}
            for listing in system.get_file_info(fs.FileSelector(f"{root}/_listed-{self.run}", allow_not_found=True)):
                if listing.base_name not in counted:
                    system.delete_file(listing.path)

        def abort(self, messages: list) -> None:
            _clean(self.path, self.run)

    class ReportFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "report_files"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return Reports(dict(self.options), schema.fieldNames()[1:])

    return ReportFiles


def _clean(path: str, run: str) -> None:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    for folder in (f"{root}/_writing-{run}", f"{root}/_listed-{run}"):
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def _name_files(path: str):
    """Gives listed files their names; nested so that tasks receive it by value.  A task that is repeated finds some already named."""
    def name(batches: Iterator) -> Iterator:
        import io
        import json

        import pyarrow as pa
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            n = 0
            for listing in batch.column(0).to_pylist():
                with io.TextIOWrapper(system.open_input_stream(listing), "utf-8", newline="") as lines:
                    for line in lines:
                        written, named = json.loads(line)
                        try:
                            system.move(written, named)
                        except OSError:
                            kinds = [f.type for f in system.get_file_info([written, named])]
                            if kinds != [fs.FileType.NotFound, fs.FileType.File]:
                                raise
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return name


def write_reports(df: DataFrame, path: str, report: str) -> None:
    """One file ``path``/<submission_id>_<report>.csv per submission, with a header; no folder for each.

    Rows of a submission stand in the order of the other columns.  Files appear under their names once all are written; a failed write leaves
    what was there.  A submission without rows gets no file.
    """
    import uuid

    from pyarrow import fs

    spark, run = df.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(_report_files())
    others = [c for c in df.columns if c != "submission_id"]
    ordered = df.select(F.col("submission_id").cast("string"), *others).repartition("submission_id").sortWithinPartitions("submission_id", *others)
    ordered.write.format("report_files").mode("append").option("report", report).option("run", run).save(path)
    try:
        system, root = fs.FileSystem.from_uri(path)
        listings = [(f.path,) for f in system.get_file_info(fs.FileSelector(f"{root}/_listed-{run}", allow_not_found=True))]  # one a task
        if listings:
            dealt = spark.createDataFrame(listings, "listing string").repartition(len(listings))
            dealt.mapInArrow(_name_files(path), "n bigint").agg(F.sum("n")).collect()
    finally:
        _clean(path, run)


def _report_names(path: str, report: str):
    """Names of the report files of one kind, in one task that holds few at a time; nested so that tasks receive it by value."""
    suffix = f"_{report}.csv"

    def found(batches: Iterator) -> Iterator:
        import os
        from itertools import batched

        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)

        def listed() -> Iterator[str]:
            if isinstance(system, fs.LocalFileSystem):
                with os.scandir(root) as entries:
                    yield from (e.name for e in entries if e.name.endswith(suffix) and e.is_file())
            else:  # no other file system of pyarrow lists bit by bit
                yield from (f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name.endswith(suffix))

        for _ in batches:
            for some in batched((n for n in listed() if not n.startswith(("_", "."))), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["file"])

    return found


def _report_rows(path: str, width: int):
    """Rows of report files as text, after the file's name; nested so that tasks receive it by value."""
    def rows(batches: Iterator) -> Iterator:
        import csv
        import io
        from itertools import batched

        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)

        def read(file: str) -> Iterator[list]:
            with io.TextIOWrapper(system.open_input_stream(f"{root}/{file}"), "utf-8-sig", errors="replace", newline="") as text:
                lines = (r for r in csv.reader(text, quoting=csv.QUOTE_NOTNULL) if r)  # an empty value that is not quoted is null
                next(lines, None)
                for r in lines:
                    yield [file, *r[:width], *[None] * (width - len(r))]

        every = (r for batch in batches for file in batch.column(0).to_pylist() for r in read(file))
        for some in batched(every, 4_096):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], ["file", *[f"c{k}" for k in range(width)]])

    return rows


def read_reports(spark: SparkSession, path: str, report: str, schema: str) -> DataFrame:
    """The reports of one kind back, all submissions at once; the id is taken from the file's name.

    A folder has a file per submission and kind, so their names are listed in a task, kept in a table and dealt to the
    tasks that read them.  A value that is not of its column's type is null.
    """
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    if system.get_file_info(root).type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    fields = DataType.fromDDL(schema).fields
    listed = settle(spark.range(1).mapInArrow(_report_names(path, report), "file string"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    text = ", ".join(["file string", *[f"c{k} string" for k in range(len(fields))]])
    return listed.repartition(tasks, "file").mapInArrow(_report_rows(path, len(fields)), text).select(
        *[F.col(f"c{k}").try_cast(f.dataType).alias(f.name) for k, f in enumerate(fields)],
        F.regexp_replace(names.file_stem("file"), f"_{report}$", "").alias("submission_id"))
