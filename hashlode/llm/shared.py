"""What several operators of this subpackage use: the shared folder, stored tables, exact selection."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
#: While a table is written (default, value): its shuffle files go at the end, nothing reads them again; batches to
#: Python are small, since a row may hold a whole text.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("false", "true"),
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
}
#: A key's rows in one task of ``dealt_join``, and how many keys can have more.
PART_ROWS = 1 << 12
HOT_KEYS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="hashlode-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {k: spark.conf.get(k, default) for k, (default, _) in _WRITING.items()}
    for k, (_, v) in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._hashlode_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    path = getattr(df, "_hashlode_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_all(*frames: DataFrame) -> None:
    for df in frames:
        drop_stored(df)


def broadcast_if_small(df: DataFrame, rows: int = 200_000, size: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows and bytes, both counted, are few; else as it is, so that a join shuffles."""
    n, held = df.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def dealt_join(rows: DataFrame, told: DataFrame, key: str, salt: list[str], n: str = "n") -> DataFrame:
    """``rows`` joined with ``told`` (one row per key, n: the key's rows; n itself is dropped).

    A key of more than ``most`` rows meets in several tasks, dealt by the hash of the columns ``salt``; its row of ``told``
    is repeated for each. No more than about ``HOT_KEYS`` keys can be that large, which proves the size of the broadcast.
    """
    total, largest = told.agg(F.sum(n), F.max(n)).first()
    most = max(PART_ROWS, (total or 0) // HOT_KEYS)
    if (largest or 0) <= most:
        return rows.join(told.drop(n), key)
    part, parts = free_names(rows.join(told, key), "part", "parts")
    parts_of = F.ceil(F.col(n) / F.lit(most)).cast("int")
    hot = told.where(F.col(n) > most).select(key, parts_of.alias(parts))
    mine = F.pmod(F.xxhash64(*salt), F.coalesce(F.col(parts), F.lit(1))).cast("int")
    left = rows.join(F.broadcast(hot), key, "left").withColumn(part, mine).drop(parts)
    right = told.withColumn(part, F.explode(F.sequence(F.lit(0), parts_of - 1))).drop(n)
    return left.join(right, [key, part]).drop(part)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, with underscores added until no column of ``df`` has the name (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
