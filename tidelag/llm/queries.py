"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelag.llm import sql
from tidelag.llm.bpe import op9_bpe_codec
from tidelag.llm.decontaminate import op8_benchmark_leaks
from tidelag.llm.jaccard import op6_jaccard_components
from tidelag.llm.manifest import op12_merkle_manifest
from tidelag.llm.media import op10_media_columns
from tidelag.llm.mixing import op13_pareto_mixture
from tidelag.llm.negatives import op11_hard_negatives
from tidelag.llm.pii import op1_pii_bootstrap
from tidelag.llm.pitman_yor import op7_pitman_yor
from tidelag.llm.quality import op2_quality_nbsvm
from tidelag.llm.separators import op3_token_counts
from tidelag.llm.substrings import op4_repeated_substrings
from tidelag.llm.toxicity import op5_toxicity_ordinal


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_bootstrap, op2_quality_nbsvm, op3_token_counts, op4_repeated_substrings, op5_toxicity_ordinal, op6_jaccard_components, op7_pitman_yor, op8_benchmark_leaks, op9_bpe_codec, op10_media_columns, op11_hard_negatives, op12_merkle_manifest, op13_pareto_mixture)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
