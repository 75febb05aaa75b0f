"""The numbered queries and the pipeline, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP7_SQL, op7_tool_calls
from .codes import OP11_SQL, op11_vector_codes
from .decontaminate import OP12_SQL, op12_decontaminate
from .divergence import OP13_SQL, op13_source_divergence
from .jaccard import op5_ngram_jaccard
from .language import op3_language_id
from .licenses import OP8_SQL, op8_license_scan
from .mixing import OP1_SQL, op1_mix_sources
from .packing import op6_best_fit_packing
from .pii import op2_personal_data
from .quality import op10_quality_rules
from .secrets import op4_secret_scan
from .vectors import op9_nearest_neighbours


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_personal_data, op3_language_id, op4_secret_scan, op5_ngram_jaccard, op6_best_fit_packing, op7_tool_calls, op8_license_scan, op9_nearest_neighbours, op10_quality_rules, op11_vector_codes, op12_decontaminate, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op7_tool_calls": OP7_SQL, "op8_license_scan": OP8_SQL, "op11_vector_codes": OP11_SQL, "op12_decontaminate": OP12_SQL, "op13_source_divergence": OP13_SQL}
