"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, embed, lm, mixing, quality, secrets, simhash, substrings, toxicity, urls

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_secrets": secrets.op2_secrets,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_mixing": mixing.op4_mixing,
    "op5_language_model": lm.op5_language_model,
    "op6_urls": urls.op6_urls,
    "op7_substrings": substrings.op7_substrings,
    "op8_simhash": simhash.op8_simhash,
    "op9_embeddings": embed.op9_embeddings,
    "op10_quality": quality.op10_quality,
}

SQL: dict[str, str] = {"op3_decontamination": decontam.SQL, "op6_urls": urls.SQL, "op7_substrings": substrings.SQL, "op9_embeddings": embed.SQL}
