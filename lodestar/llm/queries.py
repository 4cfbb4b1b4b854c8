"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from . import byte_strings, decontamination, embeddings, html_text, jaccard, language_id, lexical, mixing, negatives, ogg, secrets, sharding, substrings

QUERIES = {
    "op1_substrings": substrings.op1,
    "op2_sharding": sharding.op2,
    "op3_decontamination": decontamination.op3,
    "op4_html_text": html_text.op4,
    "op5_language_id": language_id.op5,
    "op6_embeddings": embeddings.op6,
    "op7_jaccard": jaccard.op7,
    "op8_mixing": mixing.op8,
    "op9_byte_strings": byte_strings.op9,
    "op10_secrets": secrets.op10,
    "op11_negatives": negatives.op11,
    "op12_lexical": lexical.op12,
    "op13_ogg": ogg.op13,
}

ORACLES: dict[str, str] = {"op11_negatives": negatives.OP11_SQL, "op12_lexical": lexical.OP12_SQL}
