"""Sources and sinks: CSV, JSON, Parquet (hive partitions too), Arrow IPC, databases, Arrow and pandas objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame, LazyFrame

SCHEMES = {"s3://": "s3a://", "gcs://": "gs://", "az://": "abfs://"}


def resolve(path: str) -> str:
    """Object store addresses in the form of Hadoop's connectors."""
    for a, b in SCHEMES.items():
        if path.startswith(a):
            return b + path[len(a) :]
    return path


def widen(df: DataFrame) -> DataFrame:
    """Narrow integers and floats as long and double; plain columns stay plain, so filters reach the scan."""
    new = {c: F.col(f"`{c}`").cast("bigint" if t in ("int", "smallint", "tinyint") else "double") for c, t in df.dtypes if t in ("int", "smallint", "tinyint", "float")}
    return df.withColumns(new) if new else df


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, widened: bool = False) -> LazyFrame:
    """A file or a directory tree; ``key=value`` folders are string columns. Unknown names in columns are ignored."""
    df = spark.read.parquet(resolve(path))
    if columns is not None:
        df = df.select(*[c for c in df.columns if c in set(columns)])
    return LazyFrame(widen(df) if widened else df)


def scan_csv(spark: SparkSession, path: str, has_header: bool = True, separator: str = ",", schema: str | None = None, quoted_newlines: bool = True) -> LazyFrame:
    """Fields may hold line breaks; where they do not, ``quoted_newlines=False`` lets Spark cut a large file into many tasks. A schema saves the pass that infers one."""
    r = spark.read.option("header", has_header).option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", quoted_newlines)
    df = (r.schema(schema) if schema else r.option("inferSchema", True)).csv(resolve(path))
    if not has_header and schema is None:
        df = df.toDF(*[f"column_{i + 1}" for i in range(len(df.columns))])
    return LazyFrame(widen(df))


def scan_json(spark: SparkSession, path: str, ndjson: bool = False, schema: str | None = None) -> LazyFrame:
    r = spark.read.option("multiLine", not ndjson)
    return LazyFrame(widen((r.schema(schema) if schema else r).json(resolve(path))))


def scan_ndjson(spark: SparkSession, path: str, schema: str | None = None) -> LazyFrame:
    return scan_json(spark, path, True, schema)


def scan_ipc(spark: SparkSession, path: str) -> LazyFrame:
    """An Arrow IPC file or stream."""
    import pyarrow as pa

    with pa.memory_map(path) as f:
        try:
            table = pa.ipc.open_file(f).read_all()
        except pa.ArrowInvalid:
            table = pa.ipc.open_stream(f).read_all()
    return LazyFrame(widen(spark.createDataFrame(table)))


def read_database(spark: SparkSession, url: str, query: str, **options: str) -> LazyFrame:
    return LazyFrame(spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load())


def _eager(scan):
    return lambda *a, **k: Frame(scan(*a, **k).df)


read_parquet, read_csv, read_json, read_ndjson, read_ipc = map(_eager, (scan_parquet, scan_csv, scan_json, scan_ndjson, scan_ipc))


def from_arrow(spark: SparkSession, table) -> Frame:
    return Frame(widen(spark.createDataFrame(table)))


def from_pandas(spark: SparkSession, pdf) -> Frame:
    return Frame(widen(spark.createDataFrame(pdf)))


def write(frame: Frame, path: str, kind: str, single: bool = False, partition_by: list[str] | None = None, **options) -> None:
    """A folder of part files; with single, one part file (for small results)."""
    df = frame.sorted_spark()
    w = (df.coalesce(1) if single else df).write.options(**options).mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).format(kind).save(resolve(path))


def write_ipc(frame: Frame, path: str) -> None:
    import pyarrow as pa

    table = frame.to_arrow()
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as out:
        out.write_table(table)


def write_database(frame: Frame, url: str, table: str, if_exists: str, options: dict) -> None:
    mode = {"fail": "error", "append": "append", "replace": "overwrite"}[if_exists]
    frame.to_spark().write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()
