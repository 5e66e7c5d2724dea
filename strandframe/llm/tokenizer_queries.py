"""Queries of the tokenizer operators over all documents."""

from __future__ import annotations

import public_tokenizers

from strandframe.llm import byte_bpe, piece_counts, token_files
from strandframe.llm.registry import corpus_query, table


@corpus_query()
def op2_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@corpus_query()
def op5_token_counts(spark, sf_dir):
    return piece_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@corpus_query()
def op10_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
