"""CSV and Parquet contact tables, previews, file inventory, result sink."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlink.operators.mapping import check_names
from contactlink.operators.storage import materialize, scratch_path

ORDER = "_ord"
CORRUPT = "_corrupt_record"
_FORMAT = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
# Names of CSV files in a folder, in any case and compressed or not.
CSV_NAME = re.compile(r"\.csv(\.(gz|bz2|zst|lz4|snappy|deflate))?$", re.IGNORECASE)
CSV_GLOB = "*.[cC][sS][vV]*"
#: Bits of a record number that count the records of one split of a file.
PLACE_BITS = 40
#: Bytes up to which a file is read whole to find its first record, what opening one counts as, and a task size that no file reaches.
SMALL_FILE, SMALL_COST, ONE_TASK = 1 << 22, 1 << 16, 1 << 60


def csv_options(multi_line: bool = True) -> dict[str, object]:
    return {**_FORMAT, "multiLine": multi_line, "mode": "PERMISSIVE"}


def _plain(path: str) -> str:
    """A path without the differences between how files are listed, named and reported by a scan."""
    return re.sub(r"^([A-Za-z][\w+.-]*):/+", r"\1:/", path).rstrip("/")


def _with_sizes(spark: SparkSession, open_cost: int, task_bytes: int | None = None) -> SparkSession:
    """A session with its own settings of how files are dealt to tasks, and the other settings of ``spark``, such as those
    by which a store is reached."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if not key.startswith("spark.") or spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.files.openCostInBytes", open_cost)
    if task_bytes:
        session.conf.set("spark.sql.files.maxPartitionBytes", task_bytes)
    return session


def csv_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, length`` of the files to read: those named, whatever their name, and of a folder its CSV files. One job
    over the listing, whatever the number of paths; no content is read."""
    paths = [path] if isinstance(path, str) else list(path)
    # Named files are told from those of a folder by their whole path, of which a relative one is the end.
    named = F.array(*(F.lit("/" + re.sub(r"^[A-Za-z][\w+.-]*:/+[^/]*/|^(\./|/)+", "", _plain(p))) for p in paths))
    session = _with_sizes(spark, SMALL_COST, ONE_TASK)
    listed = session.read.format("binaryFile").load(paths).select("path", "length").distinct()
    return listed.filter(F.col("path").rlike(f"(?i){CSV_NAME.pattern}") | F.exists(named, lambda n: F.endswith("path", n)))


def _first_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first record of a task's file; what is left of it is not read."""
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def first_records(spark: SparkSession, listed: DataFrame, multi_line: bool) -> DataFrame:
    """``file, one_field, record``: the first record of every file that has one, as two jobs whatever the number of files.

    Files up to ``SMALL_FILE`` bytes are read whole, many to a task. Of a larger one a task of its own reads the first
    record and stops. ``file`` is the path as a scan reports it.
    """
    parts = []
    for small in (True, False):
        paths = [r.path for r in listed.filter((F.col("length") <= SMALL_FILE) == small).select("path").collect()]
        if not paths:
            continue
        # Many small files to a task; or a task for each file, which is given its records one by one.
        session = _with_sizes(spark, SMALL_COST) if small else _with_sizes(spark, ONE_TASK, ONE_TASK)
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
        # Records of more than one field do not fit this schema, so their text is kept as it is.
        reader = session.read.schema(f"_first string, {CORRUPT} string").options(**csv_options(multi_line) | {"header": False})
        scan = reader.option("columnNameOfCorruptRecord", CORRUPT).csv(paths)
        text = F.coalesce(CORRUPT, "_first", F.lit("")).alias("record")
        rows = scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.col(CORRUPT).isNull().alias("one_field"), text)
        if small:
            rows = rows.withColumn("_place", F.monotonically_increasing_id()).filter("_start = 0").groupBy("file").agg(
                F.min_by(F.struct("one_field", "record"), "_place").alias("first")).select("file", "first.*")
        else:
            rows = rows.drop("_start").mapInArrow(_first_only, "file string, one_field boolean, record string")
        path = scratch_path(spark, "first-records")
        rows.write.parquet(path)
        parts.append(path)
    return spark.read.schema("file string, one_field boolean, record string").parquet(*parts)


def _by_header(spark: SparkSession, path: str | list[str], multi_line: bool) -> dict[tuple[str, ...], list[str]]:
    """The files of each header, by path. Files whose first records are equal have one header, so only one of them is
    asked for its names. Paths reach the driver, as they do in any read; empty files are left out."""
    listed = materialize(csv_files(spark, path), "files")
    names = {_plain(r.path): r.path for r in listed.collect()}
    if not names:
        raise FileNotFoundError(f"no CSV file in {path}")
    groups = first_records(spark, listed, multi_line).groupBy("one_field", "record").agg(F.sort_array(F.collect_list("file")).alias("files")).select("files").collect()
    by_header: dict[tuple[str, ...], list[str]] = {}
    for group in sorted(r.files for r in groups):
        members = [names[_plain(unquote(f))] for f in group]
        header = tuple(spark.read.options(**csv_options(multi_line)).csv(members[0]).columns)
        check_names(list(header))
        by_header.setdefault(header, []).extend(members)
    return by_header or {(): sorted(names.values())}


def read_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = True, order: str | None = ORDER, keep_corrupt: bool = False
) -> DataFrame:
    """CSV files with a header row each; every column is text, so leading zeros survive.

    Columns are matched by name, file by file: the files of one header are read together, and a column that a file
    lacks is null there. ``multi_line`` allows line breaks inside quotes; such files are read one task each. Set it to
    False for large files without them: those are split. ``order`` names an added column with the record order (file by
    path, then place in the file); the numbered table is written once. ``keep_corrupt`` adds the text of records that
    do not fit their header, found in the same scan; ``run_match`` counts them.
    """
    parts = []
    for header, group in _by_header(spark, path, multi_line).items():
        fields = [T.StructField(c, T.StringType()) for c in (*header, CORRUPT)]
        reader = spark.read.schema(T.StructType(fields)).options(**csv_options(multi_line), enforceSchema=False)
        part = reader.option("columnNameOfCorruptRecord", CORRUPT).csv(group)
        # Found now, before later steps can leave columns out: a record is only checked as far as it is asked for.
        rest = [F.col(f"`{c}`") for c in header]
        bad = F.when(F.length(F.concat_ws("", *rest)) >= 0, F.col(CORRUPT))  # never null, but it asks for all columns
        part = part.withColumn(CORRUPT, bad)
        parts.append(_placed(part) if order else part)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not keep_corrupt:
        df = df.drop(CORRUPT)
    check_names([c for c in df.columns if c not in _PLACE])
    return _numbered(df, order) if order else df


def spread(scan: DataFrame) -> DataFrame:
    """Shuffle a plain scan that has fewer splits than the cluster has cores.

    Only small inputs have; a large one keeps its splits and is not moved. Not for input that is numbered afterwards.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


_PLACE = ("_file", "_start", "_row")


def _placed(df: DataFrame) -> DataFrame:
    """Where each record is: file, split, and a number that rises inside them. Tables that come from no file are one."""
    try:
        places = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
        df.select(*places)
    except AnalysisException:
        places = [F.lit(""), F.lit(0).cast("long")]
    return df.select("*", *(p.alias(n) for p, n in zip([*places, F.monotonically_increasing_id()], _PLACE)))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Number placed records: splits by path and place, records inside them as they come.

    Spark deals splits to tasks by size, so its own numbers are not in the order of files. The placed table is written
    first: numbers are made once, and cannot differ between two uses. Splits are few, so ranking them is small.
    """
    placed = materialize(df, "records")
    splits = placed.groupBy("_file", "_start").agg(F.min("_row").alias("_first")).collect()
    ranks = [(r["_file"], r["_start"], (i << PLACE_BITS) - r["_first"]) for i, r in enumerate(sorted(splits, key=lambda r: (r["_file"], r["_start"])))]
    shift = df.sparkSession.createDataFrame(ranks, "_file string, _start long, _shift long")
    return placed.join(shift, ["_file", "_start"]).withColumn(name, F.col("_row") + F.col("_shift")).drop(*_PLACE, "_shift")


def with_order(df: DataFrame, name: str = ORDER) -> DataFrame:
    """Number the records by file and place in it; the numbered table is written once."""
    return _numbered(_placed(df), name)


def profile(df: DataFrame, order: str, rows: int = 10) -> tuple[list[str], DataFrame, int]:
    """Header, first rows and number of records (records, not lines)."""
    names = [c for c in df.columns if c != order]
    return names, preview(df, order, rows), df.count()


def preview(df: DataFrame, order: str, rows: int = 100) -> DataFrame:
    """First rows in record order: a per-partition top-k, no full sort."""
    return df.orderBy(order).limit(rows)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """``filename, size, modified`` of the CSV files of a folder, newest first.

    Only file metadata is listed; no content is read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", CSV_GLOB).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    ).orderBy(F.desc("modified"), "filename")


def select_output(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The columns asked for, in that order; a name the table lacks gives blanks.

    Names are compared exactly, also by case.
    """
    if not columns:
        return df
    return df.select(
        [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", max_records: int = 0) -> None:
    """CSV part files with a header, of at most ``max_records`` records if that is given; blanks are empty, white space is
    kept as it is."""
    # Unquoted blanks, and no trimming of values, are not the writer's defaults.
    (
        df.write.mode(mode)
        .options(header=True, quote='"', escape='"', emptyValue="", nullValue="",
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxRecordsPerFile=max_records)
        .csv(path)
    )


def count_bad_rows(df: DataFrame) -> DataFrame:
    """``records, errors`` of a table read with ``keep_corrupt``."""
    return df.agg(F.count(F.lit(1)).alias("records"), F.count(CORRUPT).alias("errors"))
