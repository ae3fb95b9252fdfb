"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from . import chat, fingerprint, langid, mixing, packing, quality, secrets, similarity, toxicity, warc

QUERIES = {
    "op1_jaccard_join": similarity.query,
    "op2_chat_format": chat.query,
    "op3_quality_rules": quality.query,
    "op4_language_id": langid.query,
    "op5_secret_scan": secrets.query,
    "op6_mix_sources": mixing.query,
    "op7_packing": packing.query,
    "op8_warc_packages": warc.query,
    "op9_toxicity": toxicity.query,
    "op10_fingerprints": fingerprint.query,
}

SQL: dict[str, str] = {"op2_chat_format": chat.SQL, "op3_quality_rules": quality.sql(), "op8_warc_packages": warc.SQL}
