"""The queries of this subpackage and the SQL to compare them with."""

from __future__ import annotations

from samewise.llm import q_chat, q_codes, q_decontam, q_html, q_langid, q_mixing, q_prefixes, q_quality, q_shards, q_simhash, q_tokens, q_urls, q_warc

_MODULES = (q_quality, q_chat, q_tokens, q_langid, q_html, q_warc, q_urls, q_simhash, q_mixing, q_decontam, q_shards, q_prefixes, q_codes)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
