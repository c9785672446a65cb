"""Sections of marked texts: line marks, normalisation, hashes, canonical section and its duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How lines mark chapters, sections and special sections.
CHAPTER = r"^\s*(?:Chapter\s+(\d+)|(\d+)\s*장)\."
SECTION = r"^\s*(\d+-\d+)\."
SPECIAL = r"^\s*(프롤로그|에필로그)[:\s]"


def squeeze(t: Column) -> Column:
    """Without white space, and with the wide plus sign made narrow."""
    return F.replace(F.regexp_replace(t, r"\s+", ""), F.lit("＋"), F.lit("+"))


def letters(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9A-Za-z가-힣]+", "")


def lines(texts: DataFrame, slug: str, text: str, ahead: int = 0) -> DataFrame:
    """(slug, line, text), lines from 1; with so many of the lines after it as l1, l2, ..., null behind the end."""
    every = texts.select(F.col(slug).alias("slug"), F.split(text, "\n").alias("own"))
    after = [F.slice("own", k + 1, F.size("own")) for k in range(1, ahead + 1)]
    each = every.select("slug", F.posexplode(F.arrays_zip("own", *after) if ahead else "own").alias("n", "text"))
    names = {"text": "own", **{f"l{k}": str(k) for k in range(1, ahead + 1)}}
    return each.select("slug", (F.col("n") + 1).alias("line"), *([F.col("text")[v].alias(c) for c, v in names.items()] if ahead else ["text"]))


def _mark(t: Column) -> list[Column]:
    """kind, key and title of a marked line; nulls for others."""
    chapter = F.concat(F.regexp_extract(t, CHAPTER, 1), F.regexp_extract(t, CHAPTER, 2))
    kind = F.when(t.rlike(CHAPTER), "chapter").when(t.rlike(SECTION), "section").when(t.rlike(SPECIAL), "special")
    key = F.when(kind == "chapter", chapter).when(kind == "section", F.regexp_extract(t, SECTION, 1)).when(kind == "special", F.regexp_extract(t, SPECIAL, 1))
    title = F.when(kind == "chapter", F.regexp_replace(t, CHAPTER, "")).when(kind == "section", F.regexp_replace(t, SECTION, "")).when(kind == "special", F.regexp_replace(t, SPECIAL, ""))
    return [kind.alias("kind"), key.alias("key"), F.trim(title).alias("title")]


def marks(rows: DataFrame) -> DataFrame:
    """The marked lines: (slug, line, kind, key, title), and what else the rows have."""
    return rows.select("slug", "line", *_mark(F.col("text")), *[c for c in rows.columns if c not in ("slug", "line", "text")]).where("kind is not null")


def sections(rows: DataFrame) -> DataFrame:
    """(slug, kind, key, title, start_line, end_line, chars, sha256, canonical): a section runs to the next mark; of one
    key's sections the longest (then first) is canonical, the others are its duplicates."""
    w = Window.partitionBy("slug").orderBy("line")
    own = rows.select("slug", "line", "text", *_mark(F.col("text")))
    start = F.last(F.when(F.col("kind").isNotNull(), F.col("line")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    owned = own.withColumn("start_line", start).where("start_line is not null")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    out = owned.groupBy("slug", "start_line").agg(F.max("kind").alias("kind"), F.max("key").alias("key"), F.max("title").alias("title"), F.max("line").alias("end_line"), body.alias("body"))
    out = out.select("slug", "kind", "key", "title", "start_line", "end_line", F.length("body").cast("long").alias("chars"), F.sha2(squeeze(F.col("body")), 256).alias("sha256"))
    best = F.row_number().over(Window.partitionBy("slug", "kind", "key").orderBy(F.col("chars").desc(), "start_line"))
    return out.withColumn("canonical", best == 1)


#: A text is hard-wrapped below this median line length, and a title goes on over so many lines at most.
WRAP_MEDIAN, TITLE_LINES = 45, 3


def layout(rows: DataFrame) -> DataFrame:
    """(slug, median, p90, wrapped) of the lengths of lines that aren't blank: the values at places n div 2 and int(0.9 n)."""
    n = F.length(F.trim(F.regexp_replace("text", r"\s", " ")))
    lens = rows.select("slug", n.alias("len")).where("len > 0").groupBy("slug").agg(F.sort_array(F.collect_list("len")).alias("l"))
    at = lambda share: F.get("l", F.floor(F.size("l") * share).cast("int"))
    return lens.select("slug", at(F.lit(0.5)).alias("median"), at(F.lit(0.9)).alias("p90")).withColumn("wrapped", F.col("median") < WRAP_MEDIAN)


def per_chapter(found: DataFrame) -> DataFrame:
    """(slug, chapter, sections): canonical sections by the number before the dash."""
    return found.where("kind = 'section' and canonical").groupBy("slug", F.split_part("key", F.lit("-"), F.lit(1)).alias("chapter")).agg(F.count(F.lit(1)).alias("sections"))


def key_checks(source: DataFrame, book: DataFrame) -> DataFrame:
    """(slug, key, what): keys of the source that the book lacks (missing), and of the book that the source lacks (invented)."""
    a, b = source.select("slug", "key").distinct(), book.select("slug", "key").distinct()
    return a.join(b, ["slug", "key"], "left_anti").withColumn("what", F.lit("missing")).unionByName(b.join(a, ["slug", "key"], "left_anti").withColumn("what", F.lit("invented")))


def unwrap_titles(rows: DataFrame, found: DataFrame, contents: DataFrame) -> DataFrame:
    """marks and a table of contents (slug, key, toc) -> marks with title and body_line: a title that goes on over the next
    lines takes the contents' wording, as soon as its letters are the same; others stay."""
    w = Window.partitionBy("slug").orderBy("line")
    own = found.select("slug", "line", "kind", "key", "title").join(contents, ["slug", "key"], "left").withColumn("mark", F.lit(True))
    both = own.unionByName(rows.select("slug", "line", "text"), allowMissingColumns=True)
    after = [F.max("text").over(w.rangeBetween(k, k)).alias(f"l{k}") for k in range(1, TITLE_LINES + 1)]
    return unwrap_marks(both.select("slug", "line", "kind", "key", "title", "toc", "mark", *after).where("mark"))


def unwrap_marks(own: DataFrame) -> DataFrame:
    """unwrap_titles for marks that have their contents' wording (toc) and the lines after them (l1, l2, l3)."""
    after = [f"l{k}" for k in range(1, TITLE_LINES + 1)]
    # Letters of joined lines are the joined letters of each. As they are slow to take, whole texts are read only where the
    # letters of the texts' beginnings agree, and lines only while what stands before begins the contents' wording.
    toc, some = F.coalesce("toc", F.lit("")), lambda c: letters(F.substring(c, 1, 64))
    read = own.select("slug", "line", "kind", "key", "title", "toc", *after, some(toc).alias("begins"), some(F.col("title")).alias("begins0"))
    read = read.withColumn("target", F.when(F.col("begins").startswith(F.col("begins0")) | F.col("begins0").startswith(F.col("begins")), letters(toc)))
    read, target = read.withColumn("said0", F.when(F.col("target") != "", letters(F.col("title")))), F.col("target")
    for k, c in enumerate(after, 1):
        said = F.col(f"said{k - 1}")
        read = read.withColumn(f"said{k}", F.when(target.startswith(said) & (said != target) & (F.trim(c) != ""), F.concat(said, letters(F.col(c)))))
    read = read.withColumn("n", F.coalesce(*[F.when(F.col(f"said{k}") == target, k) for k in range(TITLE_LINES + 1)]))
    return read.select("slug", "line", "kind", "key", F.when(F.col("n").isNull(), F.col("title")).otherwise(F.col("toc")).alias("title"), (F.col("line") + 1 + F.coalesce("n", F.lit(0))).alias("body_line"))
