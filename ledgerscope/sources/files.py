"""File sources and sinks: gzipped NDJSON, CSV, JSON reports, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DAY_US
from ..functions.columns import json_safe
from .schema import EPISODE_SCHEMA, LEDGER_SCHEMA


def read_ndjson(spark: SparkSession, path: str, schema: str = LEDGER_SCHEMA) -> DataFrame:
    """One JSON object per line; blank lines are skipped, gzip is recognised by suffix."""
    return spark.read.schema(schema).json(path)


def normalise(df: DataFrame) -> DataFrame:
    """JSON-safe numbers in every floating column."""
    return df.select(*[
        json_safe(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields])


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    normalise(df).write.mode(mode).option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Fixed column order; a listed column the table lacks is written empty."""
    out = normalise(df)
    cols = columns or out.columns
    have = set(out.columns)
    out.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in cols]).write.mode(
        mode).option("header", "true").csv(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report as JSON objects, one per row."""
    normalise(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


#: A task writes about so many rows of a day, in as many files as that takes.
TASK_ROWS = 500_000


def write_columnar(df: DataFrame, path: str, ts: str = "ts", mode: str = "errorifexists", rows_per_file: int = 5_000_000) -> None:
    """Parquet, one folder per UTC day, in files of at most ``rows_per_file`` rows.

    The rows of each day are counted first. A day gets a piece for every ``TASK_ROWS`` rows
    (or every file, if files are larger), dealt out by hash, so a busy day is written by many
    tasks and a quiet one is one file. Tasks grow with the rows and not with the files,
    as each of them reports to the driver.
    """
    day = F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(DAY_US)).cast("int"))
    dated = df.withColumn("dt", day)
    pieces = dated.groupBy("dt").agg(F.ceil(F.count(F.lit(1)) / max(rows_per_file, TASK_ROWS)).cast("int").alias("__pieces"))  # a row a day
    count = pieces.agg(F.sum("__pieces")).first()[0] or 1
    found = pieces.select(F.col("dt").alias("__dt"), "__pieces")
    cut = dated.join(F.broadcast(found), F.col("dt").eqNullSafe(F.col("__dt")))
    piece = F.pmod(F.xxhash64(*df.columns), F.col("__pieces"))
    dealt = cut.withColumn("__piece", piece).repartition(count, "dt", "__piece").drop("__dt", "__pieces", "__piece")
    dealt.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("dt").parquet(path)


def read_columnar(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Only the folders of the asked days are listed and read."""
    df = spark.read.parquet(path)
    if first:
        df = df.filter(F.col("dt") >= F.lit(first).cast("date"))
    if last:
        df = df.filter(F.col("dt") <= F.lit(last).cast("date"))
    return df


def dump(ledger: DataFrame, episodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Ledger and episodes side by side."""
    write_ndjson(ledger, f"{path}/transactions", mode)
    write_ndjson(episodes, f"{path}/episodes", mode)


def write_nested(
    rows: DataFrame, path: str, key: list[str], order: list[str], fields: list[str], name: str, mode: str = "errorifexists",
) -> None:
    """One gzipped JSON line per key: its constant columns, then ``name``, the array of its rows' ``fields`` in ``order``.

    Rows are dealt out by key, sorted inside each task, and joined to lines as they pass,
    each already JSON text; no row is gathered in an array. A line is as long as its key's text.
    """
    constant = [c for c in rows.columns if c not in {*order, *fields}]
    as_json = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    told = normalise(rows).select(*key, *order, F.xxhash64(*key).alias("__key"), as_json(constant).alias("__head"), as_json(fields).alias("__item"))
    sorted_ = told.repartition(*key).sortWithinPartitions("__key", "__head", *order, "__item").select("__head", "__item")

    def lines(batches):
        import pyarrow as pa

        head, items = None, []
        for batch in batches:
            done = []
            for h, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if h != head:
                    if head is not None:
                        done.append(_nested_line(head, name, items))
                    head, items = h, []
                items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["value"])
        if head is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_nested_line(head, name, items)], pa.string())], names=["value"])

    sorted_.mapInArrow(lines, "value string").write.mode(mode).option("compression", "gzip").text(path)


def _nested_line(head: str, name: str, items: list[str]) -> str:
    return f'{head[:-1]}{"," if len(head) > 2 else ""}"{name}":[{",".join(items)}]}}'


__all__ = [
    "EPISODE_SCHEMA", "LEDGER_SCHEMA", "dump", "normalise", "read_columnar", "read_ndjson", "read_report",
    "write_columnar", "write_csv", "write_ndjson", "write_nested", "write_report",
]
