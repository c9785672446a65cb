"""A corpus, from raw documents to packed token sequences, in five stages of the library's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.llm import exact, langid, minhash, mixing, packing
from tidebar.llm.queries import held_out, tokenizer
from tidebar.llm.shared import cut, settled

LEAST_SCORE = 0.02  # cosine with the best language's prototype; word lists and prose score far more


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every language learnt, go; where none can be learnt, those without letters alone.

    Null and empty texts have no letters. Repeated rows stay or go alike; an empty table gives none; columns keep their names.
    """
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & lettered).isEmpty():
        return docs.where(lettered)
    found = langid.language_id(docs, docs.where(~held_out(F.col("doc_id"))))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays.

    Null counts as an empty text. Null ids are the least; of repeated rows, or ties of ids, one stays. An empty table gives none.
    """
    return exact.exact_dedup(docs).where("kept").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Texts without words, null ones too, are near to nothing and stay. Rows that repeat the kept one in id and text stay
    with it. An empty table gives none.
    """
    kept = cut(minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), "text_key").distinct(), "kept")
    key = F.substring(F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)), 1, 16)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & (key == kept["text_key"]), "left_semi")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents: a row per time that a document's words are taken.

    A copy that the mix takes whole keeps its text; one that it takes in part has the taken words, joined by blanks.
    Rows equal in id, source and text are numbered by their other columns, and the n-th has what the mix takes of the n-th.
    Null and empty texts, and those of white space, have no words and no rows. A null source is one of its own, and null ids
    are equal. An empty table gives none.
    """
    # a struct of nulls equals its like, so one key serves the numbers and the join, and texts are dealt once
    taken = mixing.mix_sources(docs).where("taken > 0").select(F.struct("doc_id", "source", "print").alias("mix_key"), F.col("size").alias("mix_size"), "parts")
    turns = taken.groupBy("mix_key").agg(F.max("mix_size").alias("mix_size"), F.sort_array(F.collect_list("parts"), asc=False).alias("turns"))
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    keyed = docs.withColumn("mix_key", F.struct("doc_id", "source", F.xxhash64("text").alias("print")))
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("mix_key").orderBy(*others or ["doc_id"])))
    met = keyed.join(turns, "mix_key").where(F.col("nth") <= F.size("turns")).withColumn("parts", F.col("turns")[F.col("nth") - 1]).drop("turns")
    rows = met.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max("parts.times"))))
    rows = rows.withColumn("own", F.filter("parts", lambda p: p["times"] >= F.col("copy")))
    words = F.filter(F.split("text", mixing.WHITE), lambda w: w != "")
    part = lambda w, p: F.slice(w, (p["start"] + 1).cast("int"), p["length"].cast("int"))
    # the words are bound by an outer lambda: named inside the inner one, they would be split again for each part
    some = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("own", lambda p: part(w, p))), " "))[0]
    whole = F.aggregate("own", F.lit(0).cast("long"), lambda a, p: a + p["length"]) == F.col("mix_size")
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids.

    A null or empty text is its end id; repeated rows are packed each; an empty table gives none.
    """
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [("language", known_language), ("exact", without_copies), ("near", without_near_copies), ("mix", mixed), ("pack", packed)]

#: SQL can't express language profiles, the pseudorandom mix or the tokenizer; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
