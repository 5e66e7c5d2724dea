"""All queries of this subpackage; importing it registers them."""

from strandframe.llm import audit_queries, corpus_queries, language_queries, native_queries, page_queries, span_queries, tokenizer_queries, trie_queries  # noqa: F401
from strandframe.llm.registry import CORPUS  # noqa: F401
