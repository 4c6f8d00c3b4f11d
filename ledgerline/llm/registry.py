"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import edits, negatives, neighbours, packing, pages, quality, secrets, sharding, simhash, spelling, tokens, tools, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_edit_aware_counts": edits.op1_edit_aware_counts,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_quality_divergence": quality.op3_quality_divergence,
        "op4_secret_grammars": secrets.op4_secret_grammars,
        "op5_warc_dictionary": warc.op5_warc_dictionary,
        "op6_tool_call_linking": tools.op6_tool_call_linking,
        "op7_bpe_forced_boundary": tokens.op7_bpe_forced_boundary,
        "op8_collision_counting": neighbours.op8_collision_counting,
        "op10_min_cost_flow_reshard": sharding.op10_min_cost_flow_reshard,
        "op9_simhash_bk_tree": simhash.op9_simhash_bk_tree,
        "op11_inverted_multi_index": negatives.op11_inverted_multi_index,
        "op12_line_block_text": pages.op12_line_block_text,
        "op13_variable_gram_variants": spelling.op13_variable_gram_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_divergence": quality.oracle_sql(),
        "op5_warc_dictionary": warc.ORACLE_SQL,
        "op11_inverted_multi_index": negatives.ORACLE_SQL,
        "op12_line_block_text": pages.ORACLE_SQL,
    }
