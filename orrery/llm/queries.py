"""Queries of this subpackage, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .bpe import op3_bpe
from .jaccard import op8_jaccard_join
from .lattice import op10_lattice_dedup
from .lloyd import op12_hamerly_codes, op12_sql
from .lmscore import OP6_ORDER3_SQL, OP6_SQL, op6_lm_scoring, op6_lm_scoring_order3
from .merkle import op13_merkle_manifest, op13_sql
from .mixing import op1_mixing, op1_sql
from .quality import op7_quality
from .repeats import op9_repeats
from .sharding import op2_sharding
from .topk import OP11_SQL, op11_columnar_topk
from .toxicity import op4_toxicity
from .winnow import op5_winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_winnowing": op5_winnowing,
    "op6_lm_scoring_order3": op6_lm_scoring_order3,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality": op7_quality,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_repeats": op9_repeats,
    "op10_lattice_dedup": op10_lattice_dedup,
    "op11_columnar_topk": op11_columnar_topk,
    "op12_hamerly_codes": op12_hamerly_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": op1_sql(),
    "op2_sharding": oracles.sharding(),
    "op6_lm_scoring_order3": OP6_ORDER3_SQL,
    "op6_lm_scoring": OP6_SQL,
    "op8_jaccard_join": oracles.JACCARD_JOIN,
    "op9_repeats": oracles.REPEATS,
    "op10_lattice_dedup": oracles.LATTICE,
    "op11_columnar_topk": OP11_SQL,
    "op12_hamerly_codes": op12_sql(),
    "op13_merkle_manifest": op13_sql(),
}
