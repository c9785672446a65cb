"""The numbered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, codes, exact, langid, minhash, mixing, packing, pii, reputation, secrets, suffix, token_io, vectors
from .shared import fresh_path


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _joined(spans: Column, kind, start: str = "start", end: str = "end") -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s[start].cast("string"), s[end].cast("string"))), ",")


def held_out(id_: Column) -> Column:
    """Documents that are never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(documents(spark, sf_dir))
    kind = lambda s: F.split_part(s["rule"], F.lit(":"), F.lit(1))
    base = F.filter("findings", lambda s: kind(s).isin([r.kind for r in secrets.BASE]))
    count = lambda k: F.size(F.filter("findings", lambda s: kind(s) == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(r.kind) for r in secrets.BASE], F.sha2(_joined(base, kind), 256).alias("base_sha256"), _joined(F.col("findings"), kind).alias("spans"))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), size=2, percent=80).drop("text_key")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=2, capacity=4096, with_ids=False)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    kind = lambda s: s["kind"]
    return found.select("doc_id", *[count(k) for k in pii.PATTERNS], F.sha2(_joined(F.filter("spans", lambda s: s["base"]), kind), 256).alias("base_sha256"), _joined(F.col("spans"), kind).alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-file")
    token_io.write_tokens(documents(spark, sf_dir), path, tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_io.read_tokens(spark, path, with_ids=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = langid.language_id(docs.select("doc_id", "text"), docs.where(~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_spans(documents(spark, sf_dir), width=200)
    data = F.col("text").cast("binary")
    n = F.octet_length("text").cast("long")
    # what lies between the spans, byte by byte as Latin-1, so that all parts are joined once
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    gaps = F.arrays_zip(starts.alias("start"), F.concat(F.col("spans.start"), F.array(n)).alias("end"))
    part = lambda g: F.decode(F.substring(data, (g["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int")), "ISO-8859-1")
    kept = F.when(F.size("spans") == 0, data).otherwise(F.encode(F.array_join(F.transform(gaps, part), ""), "ISO-8859-1"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", n.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), with_groups=False).drop("groups")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_secrets, op2_vectors, op3_minhash, op4_packing, op5_pii, op6_mixing, op7_token_io, op8_exact, op9_langid, op10_suffix, op11_alignment, op12_codes, op13_url_filter)}

_FOLDED = f"translate(coalesce(text, ''), '{exact.UPPER}', '{exact.LOWER}')"
_COMPONENTS = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""
ORACLES = {
    "op2_vectors": f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
fit AS (SELECT * FROM nodes WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT p.id AS a, q.id AS b FROM fit p JOIN fit q ON p.id < q.id AND list_cosine_similarity(p.v, q.v) >= 0.9),
{_COMPONENTS}
SELECT n.id AS vec_id, (SELECT count(*) FROM both_ways w WHERE w.a = n.id) AS n_links, l.component_id, n.id = l.component_id AS kept
FROM nodes n JOIN least l USING (id)""",
    "op3_minhash": f"""
WITH RECURSIVE worded AS (SELECT doc_id AS id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
nodes AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM worded),
items AS (SELECT id, len(s) AS n, unnest(s) AS x FROM nodes),
common AS (SELECT p.id AS a, q.id AS b, p.n AS na, q.n AS nb, count(*) AS c FROM items p JOIN items q ON p.x = q.x AND p.id < q.id AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
{_COMPONENTS}
SELECT n.id AS doc_id, len(n.s)::BIGINT AS n_shingles, l.component_id, n.id = l.component_id AS kept FROM nodes n JOIN least l USING (id)""",
    "op8_exact": f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_FOLDED} AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op12_codes": codes.ORACLE,
    "op13_url_filter": reputation.ORACLE,
}
