"""Queries of the operators of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, html_extract, language_id, minhash, pii, quality, substring_dedup, warc


def queries() -> dict:
    return {
        "op1_minhash": minhash.op1_minhash,
        "op2_language_id": language_id.op2_language_id,
        "op3_pii": pii.op3_pii,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_html_extract": html_extract.op6_html_extract,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_quality": quality.op8_quality,
        "op9_bpe": bpe.op9_bpe,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": minhash.OP1_SQL,
        "op4_substring_dedup": substring_dedup.OP4_SQL,
        "op7_decontaminate": decontaminate.OP7_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op10_warc": warc.OP10_SQL,
    }
