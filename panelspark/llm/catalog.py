"""All queries of this folder, with SQL where SQL can express them."""

from __future__ import annotations

from . import queries_alignment, queries_dedup, queries_mixing, queries_ngram, queries_phrases, queries_quality, queries_secrets, queries_shards_chat, queries_tokens, queries_url, queries_warc

MODULES = [queries_alignment, queries_dedup, queries_mixing, queries_ngram, queries_phrases, queries_quality, queries_secrets, queries_shards_chat, queries_tokens, queries_url, queries_warc]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
