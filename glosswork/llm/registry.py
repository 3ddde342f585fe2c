"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, chat, differencing, lm, manifest, media, near_dups, packing, quality_pu, quality_rules, search, sharding, toxicity

MODULES = {
    "op1_grouping_packing": packing,
    "op2_quality_rules": quality_rules,
    "op3_nbsvm_toxicity": toxicity,
    "op4_gru_scoring": lm,
    "op5_tree_bpe": bpe,
    "op6_external_shuffle": sharding,
    "op7_webp_media": media,
    "op8_chat_events": chat,
    "op9_pu_quality": quality_pu,
    "op10_icws_near_dups": near_dups,
    "op11_merkle_superblocks": manifest,
    "op12_threshold_search": search,
    "op13_differencing_packing": differencing,
}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name, m in MODULES.items() if getattr(m, "ORACLE", None)}
