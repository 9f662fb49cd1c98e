"""The queries of this subpackage, with production parameters, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), capacity=2048, end=0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.toxicity import severity, train

    docs = table(spark, sf_dir, "documents")
    return severity(docs, train(docs, table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.line_dedup import removed_lines

    return removed_lines(table(spark, sf_dir, "documents"), percent=80)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.pieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), values=False)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.pieces import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.language_model import score

    return score(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_line_dedup, op4_license_scan, op5_piece_encoding, op6_token_counts, op7_language_model, op8_exact_dedup, op9_fingerprints, op10_ngram_jaccard)}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op8_exact_dedup": f"""
            WITH rows AS (SELECT doc_id, {LOWER} AS norm FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
            FROM rows""",
    }
