"""Small helpers of the text operators: written stages, text forms, defined orders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing, a local session gets a temporary folder of its own;
    on a cluster that is an error, because executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in; other letters must stay as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that no other column of the input can clash with a derived one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def bucketed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(row, doc_id, text), and all other columns in ``rest`` if ``whole``, as a written table bucketed by row number.

    Later steps that bring something back to its document join to this table by ``row``, so that only the small side moves
    and texts stay where they are. ``row`` tells apart rows that are equal in everything. There are as many buckets as
    shuffle partitions, so a join never deals the texts anew.
    """
    spark = docs.sparkSession
    name = f"llm_texts_{uuid.uuid4().hex}"
    buckets = max(48, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = numbered(docs, whole)
    body.write.option("path", f"{shared_root(spark)}/llm/{name}").bucketBy(buckets, "row").saveAsTable(name)
    return spark.table(name)


def numbered(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(row, doc_id, text), and all other columns in ``rest`` if ``whole``, without writing."""
    others = [quoted(c) for c in docs.columns if c not in ("doc_id", "text")] if whole else []
    rest = [F.struct(*others).alias("rest")] if others else []
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *rest)


def by_row(df: DataFrame, name: str) -> DataFrame:
    """A written table bucketed by ``row``, one file a bucket: joins by ``row`` move only their other side."""
    spark = df.sparkSession
    name = f"llm_{name}_{uuid.uuid4().hex}"
    buckets = max(48, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(buckets, "row").write.option("path", f"{shared_root(spark)}/llm/{name}").bucketBy(buckets, "row").saveAsTable(name)
    return spark.table(name)


def quoted(name: str) -> str:
    """A column name as it is, with dots and quotes in it."""
    return "`" + name.replace("`", "``") + "`"


def rows_kept(table: DataFrame, kept: DataFrame, columns: list[str]) -> DataFrame:
    """The original rows of a whole ``bucketed`` table whose ``row`` is in ``kept``, with ``columns`` in their order."""
    rows = table.join(kept.select("row").hint("shuffle_hash"), "row")
    return rows.select(*[F.col(c if c in ("doc_id", "text") else f"rest.{quoted(c)}").alias(c) for c in columns])
