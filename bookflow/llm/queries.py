"""The registered queries of this subpackage; none of them can be written in SQL, so tests hold them against brute force."""

from __future__ import annotations

from . import brown, covertree, decontaminate, langid, negatives, packing, pages, repair, secrets, sharding, simhash, tokencount, toxicity


def queries() -> dict:
    return {
        "op1_curve_packing": packing.op1,
        "op2_token_counts": tokencount.op2,
        "op3_simhash_dedup": simhash.op3,
        "op4_language_id": langid.op4,
        "op5_secrets": secrets.op5,
        "op6_main_text": pages.op6,
        "op7_brown_classes": brown.op7,
        "op8_bfd_sharding": sharding.op8,
        "op9_decontaminate": decontaminate.op9,
        "op10_cover_tree": covertree.op10,
        "op11_toxicity": toxicity.op11,
        "op12_hard_negatives": negatives.op12,
        "op13_turn_repair": repair.op13,
    }


def oracle_sql() -> dict:
    return {}
