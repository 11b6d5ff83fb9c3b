"""The registered queries of this package and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers

from tallyscope.llm import (
    alignment,
    embedding_dedup,
    jaccard_join,
    langid,
    lattice_lm,
    merkle,
    mixing,
    pii,
    quality,
    toxicity,
    warc,
)
from tallyscope.llm.common import table
from tallyscope.llm.sentencepiece_codec import encoded_documents
from tallyscope.llm.token_counts import token_report

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_sentencepiece(spark, sf_dir):
    return encoded_documents(table(spark, sf_dir, "documents"), PIECES)


def op2_jaccard_join(spark, sf_dir):
    return jaccard_join.linked_documents(table(spark, sf_dir, "documents")).drop("key")


def op3_mixing(spark, sf_dir):
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark, sf_dir):
    return embedding_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return token_report(table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "labels"))


def op9_warc(spark, sf_dir):
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op10_language_id(spark, sf_dir):
    return langid.identified_languages(table(spark, sf_dir, "documents"))


def op11_lm_scores(spark, sf_dir):
    return lattice_lm.likelihoods(table(spark, sf_dir, "documents"), PIECES)


def op12_merkle_manifest(spark, sf_dir):
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op13_alignment(spark, sf_dir):
    return alignment.aligned_documents(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_jaccard_join, op3_mixing, op4_embedding_dedup, op5_quality_rules,
    op6_pii, op7_token_counts, op8_toxicity, op9_warc, op10_language_id,
    op11_lm_scores, op12_merkle_manifest, op13_alignment,
)}
ORACLE: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op5_quality_rules": quality.ORACLE,
                          "op9_warc": warc.ORACLE,
                          "op12_merkle_manifest": merkle.ORACLE}
