"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalis.llm import chat_format, decontaminate, jaccard_join, language_id, language_model, media, pieces, ranked_search, reference_sql, substring_dedup, token_alignment, token_counts, toxicity, vector_links
from nivalis.llm.tables import read


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.edited_copies(media.rendered(read(spark, sf_dir, "embeddings")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"), threshold=0.8, shingle=5)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.strip_repeats(read(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizer_path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents")
    encoded = pieces.decode(pieces.encode(docs, path), path)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), _tokenizer_path("byte_bpe_50k.json"), limit=512)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.held_out_scores(read(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_control_case(read(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.prefix_examples(rows))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_predictions(read(spark, sf_dir, "documents"), top=300)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return decontaminate.report(found)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


def op12_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.9, recall=0.999)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignments(read(spark, sf_dir, "documents"), _tokenizer_path("byte_bpe_50k.json"), _tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict:
    return {
        "op1_media_copies": op1_media_copies,
        "op2_toxicity": op2_toxicity,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_pieces": op5_pieces,
        "op6_token_counts": op6_token_counts,
        "op7_language_model": op7_language_model,
        "op8_chat_format": op8_chat_format,
        "op9_language_id": op9_language_id,
        "op10_decontaminate": op10_decontaminate,
        "op11_ranked_search": op11_ranked_search,
        "op12_vector_links": op12_vector_links,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return dict(reference_sql.ORACLES)
