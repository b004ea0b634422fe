"""Table scan (S6), JSON snapshot sink (S4) and versioned table sink.

Plain parquet supports neither MERGE nor UPDATE, so a table change is a new
version directory plus a pointer; a reader never sees a half-written version
and a job never overwrites the path it reads.  Tables that many batches change
in place of a full rewrite are committed through ``sources.commits``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyspark.sources.commits import TableState, data_path, load, table_schema, write_next

POINTER = StructType([StructField("version", LongType()), StructField("batch_id", LongType())])


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, fmt: str = "parquet",
         schema=None) -> DataFrame:
    """Read a table with only the needed columns (pruned at the scan)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    df = r.load(path)
    return df.select(*columns) if columns else df


def write_snapshot(df: DataFrame, path: str) -> None:
    """Overwrite the full JSON dump."""
    df.write.mode("overwrite").json(path)


def _pointer_path(root: str) -> str:
    return root.rstrip("/") + "/_pointer"


def current_pointer(spark: SparkSession, root: str) -> tuple[int, int] | None:
    try:
        row = spark.read.schema(POINTER).json(_pointer_path(root)).orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row is None else (int(row["version"]), -1 if row["batch_id"] is None else int(row["batch_id"]))


def read_table(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    ptr = current_pointer(spark, root)
    if ptr is None:
        raise FileNotFoundError(f"no committed version under {root}")
    return scan(spark, f"{root.rstrip('/')}/v{ptr[0]}", columns)


def commit_table(df: DataFrame, root: str, partition_by: list[str] | None = None, batch_id: int | None = None,
                 sort_within: list[str] | None = None) -> int:
    """Write ``df`` as the next version (partitioned by tenant by default),
    then move the pointer.  Returns the new version number."""
    spark = df.sparkSession
    ptr = current_pointer(spark, root)
    version = 0 if ptr is None else ptr[0] + 1
    parts = ["tenant_id"] if partition_by is None and "tenant_id" in df.columns else (partition_by or [])
    w = gathered(df, parts)
    w = w.sortWithinPartitions(*sort_within) if sort_within else w
    writer = w.write.mode("errorifexists")
    if parts:
        writer = writer.partitionBy(*parts)
    writer.parquet(f"{root.rstrip('/')}/v{version}")
    last_batch = batch_id if batch_id is not None else (None if ptr is None else ptr[1])
    # A new file per version; readers take the highest, so no moment is without a pointer.
    (spark.createDataFrame([(version, last_batch)], POINTER).coalesce(1)
     .write.mode("append").json(_pointer_path(root)))
    return version


def gathered(df: DataFrame, parts: list[str]) -> DataFrame:
    """Rows of one table partition brought together before the write, so it gets few files; AQE splits a large one."""
    return df.hint("rebalance", *parts) if parts else df


# ---------------------------------------------------------------------------
# Partition-scoped table (for incremental upserts): rows live in <root>/data,
# partitioned by tenant; a change rewrites only the partitions it touches and
# is committed through the table's state (sources.commits).
# ---------------------------------------------------------------------------

def read_state(spark: SparkSession, root: str, stream: str | None = None) -> tuple[int, int]:
    """(last applied batch id of a stream, or of any; largest id given so far)."""
    s = load(spark, root)
    return (s.last(stream) if stream is not None else max(s.applied.values(), default=-1)), s.max_id


def read_max_assignment(spark: SparkSession, root: str) -> int:
    """Largest id given to an entity assignment: they are numbered on their own, apart from the entities."""
    return load(spark, root).max_assignment


def read_buckets(spark: SparkSession, root: str) -> int | None:
    """Buckets per tenant of the table (None: partitioned by tenant only)."""
    return load(spark, root).buckets


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def entity_bucket(buckets: int) -> Column:
    """Second partition level: hash of the external id (of the row id for rows
    without one), so a change rewrites only the buckets of its keys."""
    return bucket_of(F.coalesce(F.col("qb_id"), F.concat(F.lit("#"), F.col("id").cast("string"))), buckets)


def init_partitioned(df: DataFrame, root: str, partition_by: str = "tenant_id", id_col: str = "id",
                     buckets: int | None = None, max_assignment: int = 0) -> None:
    """Create the table from ``df`` (one full write), partitioned by tenant and,
    with ``buckets``, by hashed external id inside each tenant.  An empty frame
    gives an empty table: its schema is kept in the state.
    ``max_assignment``: the largest id in an existing assignments table."""
    parts = [partition_by]
    if buckets:
        df = df.withColumn("bucket", entity_bucket(buckets))
        parts.append("bucket")
    gathered(df, parts).write.mode("errorifexists").partitionBy(*parts).parquet(data_path(root))
    mx = df.agg(F.max(id_col)).first()[0]
    schema = StructType([f for f in df.schema if f.name not in parts] + [df.schema[p] for p in parts])
    state = TableState(max_id=0 if mx is None else int(mx), max_assignment=max_assignment, buckets=buckets, schema=schema.json())
    if not write_next(df.sparkSession, root, -1, state):
        raise FileExistsError(f"{root} already has a state")


def read_data(spark: SparkSession, root: str) -> DataFrame:
    """The table's rows, read with its kept schema (an empty folder is an empty table)."""
    return spark.read.schema(table_schema(spark, root)).parquet(data_path(root))


def read_partitions(spark: SparkSession, root: str, tenants: list | DataFrame | None = None,
                    partition_by: str = "tenant_id") -> DataFrame:
    """Current rows, optionally only for some tenants: a list becomes an IN
    filter, a frame of ids a semi join; either leaves out the other folders."""
    df = read_data(spark, root)
    if tenants is None:
        return df
    if isinstance(tenants, DataFrame):
        return restrict_partitions(df, tenants, [partition_by])
    return df.where(F.col(partition_by).isin(list(tenants)))


def save_keys(df: DataFrame, path: str, cols: list[str]) -> DataFrame:
    """The distinct partition keys of a change, written once and read back.  As a written table Spark knows their size:
    it broadcasts them while they are small enough, and then a join with them prunes the partitions it scans."""
    df.select(*cols).distinct().write.mode("overwrite").parquet(path)
    keys = df.sparkSession.read.schema(df.select(*cols).schema).parquet(path)
    # A bound that all keys meet marks the keys as a filter worth pruning by.
    return keys.where(F.col(cols[-1]) >= F.lit(-2 ** 31)) if dict(keys.dtypes)[cols[-1]] in ("int", "bigint") else keys


def restrict_partitions(df: DataFrame, parts: DataFrame, cols: list[str], negate: bool = False) -> DataFrame:
    """Rows of ``df`` in (or, with ``negate``, not in) the partitions listed in
    ``parts``: a semi (anti) join on the partition columns.  With keys from
    ``save_keys`` the join prunes the scan (dynamic partition pruning); the keys
    never pass through the driver as values.  A key with a NULL part equals
    nothing."""
    return df.join(parts.select(*cols).distinct(), cols, "left_anti" if negate else "left_semi").select(*df.columns)


def replace_partitions(staged: DataFrame, root: str, partition_by: str | list[str] = "tenant_id") -> None:
    """Replace exactly the partitions present in ``staged`` (dynamic partition
    overwrite).  ``staged`` must not read from the table itself (write it to a
    staging folder first): the job never overwrites what it reads."""
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    (gathered(staged, parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts).parquet(data_path(root)))


def delete_partitions(keys: DataFrame, root: str, parts: list[str]) -> None:
    """Delete the partitions listed in ``keys`` (tasks do it; a folder that is gone already is no fault)."""
    base = data_path(root)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        store, path = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base.removeprefix("file:"))
        for b in batches:
            for row in b.to_pylist():
                folder = path + "/" + "/".join(f"{c}={row[c]}" for c in parts)
                if store.get_file_info(folder).type != fs.FileType.NotFound:
                    store.delete_dir(folder)
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], names=["n"])

    keys.select(*parts).mapInArrow(run, "n long").agg(F.sum("n")).collect()
