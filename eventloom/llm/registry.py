"""The queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, importance, lattice_lm, licenses, mixing, near_join, packing, pii, quality, repeats, spelling, toxicity, vptree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_lattice_lm": lattice_lm.op3_lattice_lm,
    "op4_vantage_neighbours": vptree.op4_vantage_neighbours,
    "op5_pack_sequences": packing.op5_pack_sequences,
    "op6_jaccard_join": near_join.op6_jaccard_join,
    "op7_quality": quality.op7_quality,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_repeated_strings": repeats.op10_repeated_strings,
    "op11_personal_data": pii.op11_personal_data,
    "op12_importance_draw": importance.op12_importance_draw,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.ORACLE_SQL,
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_mix_sources": mixing.ORACLE_SQL,
    "op12_importance_draw": importance.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
