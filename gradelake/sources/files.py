"""Intake of files: PDFs, page images and pairing by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.schemas import RESPONSE_NAME_RE

# The usual size limit of an upload (only for callers that ask for one) and file signatures.
UPLOAD_BYTES = 25 * 1024 * 1024
PDF_MAGIC, PNG_MAGIC, JPEG_MAGIC = "25504446", "89504E470D0A1A0A", "FFD8FF"


def _hex(n: int) -> Column:
    return F.hex(F.substring("content", 1, n))


def judge_pdfs(files: DataFrame, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Split files (path, length, content) into accepted ones and rejects with the first failing rule.

    No size is too large unless the caller sets ``max_bytes``.

    Name and length rules come first, so content is looked at for survivors only.
    """
    reason = (
        F.when(~F.lower("path").endswith(".pdf"), "not_pdf").when(F.col("length") == 0, "empty")
        .when(F.lit(max_bytes is not None) & (F.col("length") > F.lit(max_bytes)), "too_large").when(_hex(4) != PDF_MAGIC, "no_pdf_header"))
    j = files.withColumn("reason", reason)
    return j.filter("reason IS NULL").drop("reason"), j.filter("reason IS NOT NULL").select("path", "length", "reason")


def scan_pdfs(spark: SparkSession, path: str, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected files under a folder. Spark's file source leaves out zero-byte
    files by itself, so those are neither accepted nor listed as rejects."""
    return judge_pdfs(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), max_bytes)


def image_mime() -> Column:
    """MIME type from the first bytes; anything unknown is taken for JPEG."""
    return F.when(_hex(8) == PNG_MAGIC, "image/png").when(_hex(3) == JPEG_MAGIC, "image/jpeg").otherwise("image/jpeg")


def judge_images(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with their MIME type, and empty files."""
    size = F.coalesce(F.length("content"), F.lit(0))
    return files.filter(size > 0).withColumn("mime", image_mime()), files.filter(size == 0)


def scan_page_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return judge_images(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def read_page_images(spark: SparkSession, path: str, name: str = r"([^/]+)/0*(\d+)\.[^./]+$") -> DataFrame:
    """PNG and JPEG files under a folder, decoded by Spark's image source: doc_id, page, image.

    ``name`` finds document and page in a file's path, by default ``<doc_id>/<page>.png``; files that it doesn't match have null for both. Files that
    are no image have height -1. Two files of one page are two rows. ``raster.rasters_from_images`` makes page rasters of them.
    """
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path)

    def part(n: int) -> Column:
        return F.nullif(F.regexp_extract(F.url_decode(F.col("image.origin")), name, n), F.lit(""))

    return images.select(part(1).alias("doc_id"), part(2).try_cast("int").alias("page"), "image")


def images_from_base64(df: DataFrame, col: str) -> DataFrame:
    """Decode a base64 column into content; unreadable text gives null."""
    return df.withColumn("content", F.try_to_binary(F.col(col), F.lit("base64")))


def pair_by_stem(responses: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Pair each response file with <stem>.pdf, else test_<stem>.pdf; others are left out.

    Both inputs have a file ``name``.
    """
    stem = F.regexp_extract("name", RESPONSE_NAME_RE, 1)
    r = responses.withColumn("stem", stem).filter("stem <> ''")
    names = pdfs.select(F.col("name").alias("pdf"))
    wanted = r.select("name", "stem", F.explode(F.array(
        F.struct(F.lit(1).alias("k"), F.concat("stem", F.lit(".pdf")).alias("pdf")),
        F.struct(F.lit(2).alias("k"), F.concat(F.lit("test_"), "stem", F.lit(".pdf")).alias("pdf")))).alias("c")).select("name", "stem", "c.k", "c.pdf")
    return wanted.join(names, "pdf").groupBy("name", "stem").agg(F.min_by("pdf", "k").alias("pdf"))
