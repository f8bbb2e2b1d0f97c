"""Registered queries of this subpackage: each reads its whole table and applies one operator with production parameters."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name: (module, function, tables it reads)
_QUERIES = {
    "op8_masked_likelihood": ("lm_score", "digest", ("documents",)),
    "op6_site_template_text": ("html_template", "digest", ("pages",)),
    "op3_suffix_dedup": ("suffix_dedup", "digest", ("documents",)),
    "op7_fm_decontamination": ("decontam", "digest", ("documents", "benchmark")),
    "op1_toxicity_crf": ("toxicity", "digest", ("documents", "labels")),
    "op4_quality_gbdt": ("gbdt", "digest", ("documents", "labels")),
    "op5_simhash_multi_index": ("simhash", "digest", ("documents",)),
    "op2_best_fit_packing": ("packing", "digest", ("documents",)),
    "op10_minimax_sharding": ("sharding", "digest", ("documents",)),
    "op9_quality_rules": ("rules", "digest", ("documents",)),
    "op11_token_files": ("token_files", "digest", ("documents",)),
    "op12_collocations": ("collocations", "digest", ("documents",)),
    "op13_spelling_variants": ("spelling", "digest", ("documents",)),
}


def _query(module: str, function: str, tables: tuple[str, ...]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply = getattr(import_module(f"{__package__}.{module}"), function)
        return apply(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

    return run


def queries() -> dict:
    return {name: _query(*spec) for name, spec in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from . import collocations, decontam, rules

    return {"op7_fm_decontamination": decontam.ORACLE, "op9_quality_rules": rules.ORACLE, "op12_collocations": collocations.ORACLE}
