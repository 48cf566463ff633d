"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import column_bwt, decontamination, exact_search, fm_index, language, main_text, merkle, near_dedup, oracles, packing, pieces, secrets, token_alignment, toxicity
from pagegrain.llm.common import fold, stored, table


def toxicity_model(spark: SparkSession, sf_dir: str) -> dict:
    """Learnt from the labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").where(fold("doc_id", 3) != 1)
    return toxicity.fit(docs, table(spark, sf_dir, "labels"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return placed.drop("row_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.remove_repeated_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = column_bwt.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = stored(secrets.scan(table(spark, sf_dir, "documents")), "secrets")
    found = secrets.find_secrets(scanned, secrets.limits(scanned))
    counts = [secrets.count_of(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secrets.shown("base"), 256).alias("base_sha256"), secrets.shown("spans").alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item that it holds; clean documents have no row."""
    return decontamination.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_search.exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10, 1024)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold("doc_id", 4) != 2))
    found = language.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids, joined in decimal, and of the text decoded from them."""
    encoded = pieces.encode(table(spark, sf_dir, "documents"), piece_model_path(), decoded=True)
    told = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), told.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and what the proofs say of documents of which some were tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tampered = F.when(hit, merkle.leaf_digest({"text": F.translate("text", LETTERS, LETTERS.lower())})).otherwise(merkle.leaf_digest())
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of groups and links of every document, and a digest of its groups as text."""
    found = token_alignment.Alignment(table(spark, sf_dir, "documents"), tokenizer_path(), piece_model_path()).summaries()
    return found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_main_text": op5_main_text,
    "op6_secrets": op6_secrets,
    "op7_decontamination": op7_decontamination,
    "op8_near_dedup": op8_near_dedup,
    "op9_exact_topk": op9_exact_topk,
    "op10_language": op10_language,
    "op11_pieces": op11_pieces,
    "op12_merkle": op12_merkle,
    "op13_alignment": op13_alignment,
}

ORACLES = {
    "op3_substring_dedup": oracles.REPEATED_WORDS,
    "op8_near_dedup": oracles.NEAR_COPIES,
    "op12_merkle": oracles.MANIFEST,
    "op9_exact_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 10""",
}
