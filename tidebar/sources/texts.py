"""Texts of a manifest of books, with a row for each book whose text is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file ({"books": [{slug, title, live, file}]}) as (n, slug, title, live, file), n its order; the file is named slug.txt by default."""
    row = "array<struct<slug:string,title:string,live:boolean,file:string>>"
    rows = spark.read.schema(f"books {row}").json(path, multiLine=True).select(F.posexplode("books").alias("n", "b"))
    return rows.select("n", "b.slug", F.coalesce("b.title", "b.slug").alias("title"), F.coalesce("b.live", F.lit(False)).alias("live"), F.coalesce("b.file", F.concat("b.slug", F.lit(".txt"))).alias("file"))


def default_slug(books: DataFrame) -> str | None:
    """The first live book, or else the first one."""
    first = books.orderBy(F.col("live").desc(), "n").select("slug").first()
    return first[0] if first else None


def texts(books: DataFrame, folder: str) -> DataFrame:
    """books (slug, file) -> (slug, path, text, chars, sha256, missing): each file of the folder read whole, as UTF-8.

    A book whose file isn't there has missing = true and no text; an empty file has an empty text. Files that no book names
    are left alone.
    """
    spark = books.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    there = spark.createDataFrame([(f.getPath().getName(), f.getPath().toString()) for f in listed if f.isFile()], "file string, path string")
    # Spark's readers pass over empty files
    found = spark.read.format("binaryFile").load(folder).select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("file"), F.decode("content", "UTF-8").alias("text"))
    met = books.join(there, "file", "left").join(found, "file", "left").withColumn("text", F.when(F.col("path").isNotNull(), F.coalesce("text", F.lit(""))))
    return met.select("slug", "path", "text", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"), F.col("path").isNull().alias("missing"))
