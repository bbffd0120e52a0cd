"""Operations of a training-data pipeline. Nothing outside this subpackage imports it."""

from importlib import import_module

MODULES = ("pii", "near_dedup", "neighbours", "suffix_dedup", "pieces", "decontaminate", "lm_score", "url_filter", "secrets", "quality", "merkle", "runs", "ngram_join")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"quern.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"quern.llm.{m}").ORACLES.items()}
