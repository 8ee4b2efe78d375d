"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from quillmatch.llm import decontamination, html_text, language, licenses, near_dedup, pieces, pii, secrets, token_counts, transport_stream


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1,
        "op2_near_duplicates": near_dedup.op2,
        "op3_pii": pii.op3,
        "op4_licenses": licenses.op4,
        "op5_language": language.op5,
        "op6_secrets": secrets.op6,
        "op7_decontamination": decontamination.op7,
        "op8_html_text": html_text.op8,
        "op9_pieces": pieces.op9,
        "op10_transport_stream": transport_stream.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_secrets": secrets.ORACLE_OP6}
