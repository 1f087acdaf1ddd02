"""The corpus queries by name, and their SQL where SQL can state them. Modules load when their query runs."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from loopwright.llm.common import table

#: The tokenizer that the queries use; the operators take its path as an argument.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: query -> (module, function, tables handed over in order)
QUERIES = {
    "op1_divergence": ("divergence", "op1_divergence", ("documents",)),
    "op2_page_differencing": ("pagediff", "op2_page_differencing", ("pages",)),
    "op3_nbest": ("nbest", "op3_nbest", ("documents",)),
    "op4_suffix_lpf": ("suffix_dedup", "op4_suffix_lpf", ("documents",)),
    "op5_projection_forest": ("rp_forest", "op5_projection_forest", ("embeddings",)),
    "op6_positive_unlabelled": ("pu_quality", "op6_positive_unlabelled", ("documents", "labels")),
    "op7_byte_gru": ("byte_gru", "op7_byte_gru", ("documents",)),
    "op8_bbit_minhash": ("bbit_minhash", "op8_bbit_minhash", ("documents",)),
    "op9_sainte_lague": ("apportion", "op9_sainte_lague", ("documents",)),
    "op10_hypergeometric": ("hypershuffle", "op10_hypergeometric", ("documents",)),
    "op11_source_audit": ("source_audit", "op11_source_audit", ("documents",)),
    "op12_url_filter": ("url_filter", "op12_url_filter", ("pages",)),
    "op13_filtering_lloyd": ("filtering_lloyd", "op13_filtering_lloyd", ("embeddings",)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(module: str, function: str, tables: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            more = {"model": MODEL} if module == "nbest" else {}
            return getattr(import_module(f"loopwright.llm.{module}"), function)(*[table(spark, sf_dir, t) for t in tables], **more)

        return run

    return {name: bind(*spec) for name, spec in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from loopwright.llm.sql import ORACLE

    return dict(ORACLE)
