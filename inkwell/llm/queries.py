"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.alignment import op13_shared_cuts
from inkwell.llm.covertree import OP11_SQL, op11_cover_tree_negatives
from inkwell.llm.decontaminate import OP10_SQL, op10_spaced_seeds
from inkwell.llm.lines import OP1_SQL, op1_line_templates
from inkwell.llm.maxent import op8_maxent_scores
from inkwell.llm.minhash import op2_superminhash
from inkwell.llm.mixing import op5_mix_sources
from inkwell.llm.oracle import OP2_SQL, OP5_SQL, OP9_SQL
from inkwell.llm.quality import op9_repetition_rules
from inkwell.llm.repeats import op7_suffix_repeats
from inkwell.llm.secrets import op4_secret_spans
from inkwell.llm.shards import op6_minimax_shards
from inkwell.llm.tokencount import op12_whole_token_counts
from inkwell.llm.warc import OP3_SQL, op3_warc_zstd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_templates,
    op2_superminhash,
    op3_warc_zstd,
    op4_secret_spans,
    op5_mix_sources,
    op6_minimax_shards,
    op7_suffix_repeats,
    op8_maxent_scores,
    op9_repetition_rules,
    op10_spaced_seeds,
    op11_cover_tree_negatives,
    op12_whole_token_counts,
    op13_shared_cuts,
)}
ORACLE: dict[str, str] = {
    "op2_superminhash": OP2_SQL,
    "op3_warc_zstd": OP3_SQL,
    "op5_mix_sources": OP5_SQL,
    "op9_repetition_rules": OP9_SQL,
    "op1_line_templates": OP1_SQL,
    "op10_spaced_seeds": OP10_SQL,
    "op11_cover_tree_negatives": OP11_SQL,
}
