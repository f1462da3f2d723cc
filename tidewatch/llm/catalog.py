"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline  # at the repository's top
from tidewatch.llm import ann, byte_bpe, conversations, decontamination, jaccard, licenses, lm_scoring, periodic, quality, sharding, suffix_dedup, url_filter, warc


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op7_byte_bpe": byte_bpe.op7_byte_bpe,
        "op1_ann": ann.op1_ann,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_jaccard": jaccard.op3_jaccard,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_quality": quality.op5_quality,
        "op6_url_filter": url_filter.op6_url_filter,
        "op10_licenses": licenses.op10_licenses,
        "op8_lm_scoring": lm_scoring.op8_lm_scoring,
        "op9_sharding": sharding.op9_sharding,
        "op11_warc": warc.op11_warc,
        "op12_conversations": conversations.op12_conversations,
        "op13_periodic_runs": periodic.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontamination.OP2_SQL,
        "op3_jaccard": jaccard.OP3_SQL,
        "op4_suffix_dedup": suffix_dedup.OP4_SQL,
        "op6_url_filter": url_filter.OP6_SQL,
        "op9_sharding": sharding.OP9_SQL,
        "op11_warc": warc.OP11_SQL,
        "op12_conversations": conversations.OP12_SQL,
        "op13_periodic_runs": periodic.OP13_SQL,
    }
