"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexgrove.llm.clusters import OP13_SQL, op13_hamerly_clusters
from lexgrove.llm.jaccard import op1_forest_join
from lexgrove.llm.language import op2_language_id
from lexgrove.llm.lines import OP5_SQL, op5_line_dedup
from lexgrove.llm.mixing import op7_source_mixing
from lexgrove.llm.neighbours import op8_projected_neighbours
from lexgrove.llm.packing import op4_vector_packing
from lexgrove.llm.quality import op3_pu_quality
from lexgrove.llm.runs import op11_refined_runs
from lexgrove.llm.sharding import op10_rendezvous_sharding
from lexgrove.llm.spotsigs import op6_spotsigs, spotsigs_classes
from lexgrove.llm.tokens import op9_section_token_counts
from lexgrove.llm.topk import OP12_SQL, op12_tiled_top_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_forest_join,
        op2_language_id,
        op3_pu_quality,
        op4_vector_packing,
        op5_line_dedup,
        op6_spotsigs,
        op7_source_mixing,
        op8_projected_neighbours,
        op9_section_token_counts,
        op10_rendezvous_sharding,
        op11_refined_runs,
        op12_tiled_top_products,
        op13_hamerly_clusters,
        spotsigs_classes,
    )
}

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op12_tiled_top_products": OP12_SQL, "op13_hamerly_clusters": OP13_SQL}
