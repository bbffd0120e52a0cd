"""Projections and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text

STRUCTURAL = ("heading", "code", "table_header", "table_row", "lead_in", "markup", "field_meta", "block")
MAX_CHARACTERS = 512 * 1024

# File names, suffixes and path fragments that name a kind of rule file, and the kind.
BASENAMES = {
    "claude.md": "CLAUDE.md", "claude.local.md": "CLAUDE.md", "agents.md": "AGENTS.md", "agent.md": "AGENTS.md", "gemini.md": "GEMINI.md", "qwen.md": "QWEN.md",
    "skill.md": "SKILL.md", ".cursorrules": ".cursorrules", "cursorrules": "cursorrules", ".windsurfrules": ".windsurfrules", ".clinerules": ".clinerules",
    ".roorules": ".roorules", ".rules": ".rules", ".goosehints": ".goosehints", ".aider.conf.yml": ".aider.conf.yml", "copilot-instructions.md": "copilot-instructions.md",
    "rules.md": "RULES.md", "conventions.md": "CONVENTIONS.md", "prompt.md": "PROMPT.md", "system_prompt.md": "SYSTEM_PROMPT.md", "system-prompt.md": "system-prompt.md",
    "llms.txt": "llms.txt", "llms-full.txt": "llms-full.txt",
}
SUFFIXES = {".mdc": "mdc", ".instructions.md": "instructions.md"}
FRAGMENTS = {
    ".cursor/rules/": "mdc", ".github/copilot-instructions.md": ".github/copilot-instructions.md", ".github/instructions/": "instructions.md", ".continue/": ".continue/config.json",
    ".clinerules/": ".clinerules", ".roo/rules": ".roorules", ".junie/guidelines.md": "guidelines.md", ".idx/airules.md": "airules.md",
}
#: Comment openings by suffix; a file of one of these kinds, or with #!, is code.
OPENERS = {"py": "#", "sh": "#", "rb": "#", "toml": "#", "yml": "#", "yaml": "#", "js": "//", "ts": "//", "go": "//", "rs": "//", "java": "//", "c": "//", "sql": "--", "lua": "--", "html": "<!--", "css": "/*"}
NOT_CODE = ("md", "txt", "json", "lock", "csv", "png", "jpg", "svg", "pdf")


def is_structural(kind: Column) -> Column:
    return kind.isin(*STRUCTURAL)


def skip_reason(content: Column, repo: Column, path: Column, sha: Column, most: int = MAX_CHARACTERS) -> Column:
    """Why a file is not read, first reason that holds; null: it is read. Size counts characters."""
    missing = lambda c: c.isNull() | (F.trim(c) == "")
    return F.when(missing(content), "empty").when(F.length(content) > most, "too large").when(missing(repo) | missing(path), "missing repo/path").when(missing(sha), "missing sha")


def file_type(path: Column) -> Column:
    """Kind of a rule file: by name, then suffix, then a fragment of its path; else its own name."""
    whole = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    low = F.lower(whole)
    base = F.element_at(F.split(low, "/"), -1)
    names = F.create_map(*(F.lit(x) for kv in BASENAMES.items() for x in kv))
    out = F.when(F.try_element_at(names, base).isNotNull(), F.try_element_at(names, base))
    for suffix, kind in SUFFIXES.items():
        out = out.when(base.endswith(suffix), kind)
    for fragment, kind in FRAGMENTS.items():
        out = out.when(low.contains(fragment), kind)
    return out.otherwise(F.element_at(F.split(whole, "/"), -1))


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


def comment_form(path: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in OPENERS.items() for x in kv)), suffix_of(path))


def is_code(path: Column, content: Column) -> Column:
    """Known kinds first; then not with a NUL in its first 4 KiB; then by comment form or #!."""
    return F.when(suffix_of(path).isin(*NOT_CODE), False).when(F.instr(F.substring(content, 1, 4096), "\x00") > 0, False).otherwise(comment_form(path).isNotNull() | content.startswith("#!"))


def noise(path: Column, patterns: Sequence[str], prefixes: Sequence[str]) -> Column:
    """Whether a path is noise: one of the expressions matches it whole, or it lies under a prefix."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(rf"\A(?:{p})\z")
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def chosen_units(units: DataFrame, kinds: Sequence[str] = ("statement", "clause"), min_words: int = 1) -> DataFrame:
    return units.where(F.col("type").isin(*kinds) & (text.n_words(F.col("text")) >= min_words))


def full_triple(*axes: str) -> Column:
    out = F.lit(True)
    for a in axes:
        out = out & (F.coalesce(F.size(a), F.lit(0)) > 0)
    return out


def close_call(separation: Column, below: float = 1.2) -> Column:
    """Null (one choice only) is not close."""
    return F.coalesce(separation < below, F.lit(False))


def drop_reason(types: Column, stripped: Column) -> Column:
    """Why a document gives no clause; null: it does."""
    return F.when(F.size(types) == 0, "no units").when(F.forall(types, is_structural), "all structural").when(F.trim(stripped) == "", "empty after markup removal")


def problems(rules: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """key and problem of rows that may not enter: blank required values, a repeated key, judged not a rule."""
    blank = [F.when(F.col(c).isNull() | (F.trim(F.col(c)) == ""), F.lit(f"blank {c}")) for c in required]
    counts = rules.groupBy(key).agg(F.count("*").alias("_n"))
    many = F.when(F.col("_n") > 1, F.lit("repeated"))
    judged = [F.when(~F.col("is_rule"), F.lit("not a rule"))] if "is_rule" in rules.columns else []
    every = rules.join(counts, key, "left").withColumn("problem", F.explode(F.filter(F.array(*blank, many, *judged), lambda p: p.isNotNull())))
    return every.select(F.col(key).alias("key"), "problem")


def validated(rules: DataFrame, key: str, required: Sequence[str], known: Sequence[str]) -> DataFrame:
    """The rows with their known columns; an error that names at most ten offenders otherwise."""
    if bad := problems(rules, key, required).limit(10).collect():
        raise ValueError("rules may not enter: " + "; ".join(f"{r['key']}: {r['problem']}" for r in bad))
    return rules.select(*(c for c in known if c in rules.columns))


def conforming(df: DataFrame, schema) -> DataFrame:
    """df in the declared schema; an error that names missing and extra columns otherwise."""
    missing, extra = [c for c in schema.names if c not in df.columns], [c for c in df.columns if c not in schema.names]
    if missing or extra:
        raise ValueError(f"missing columns: {missing}; extra columns: {extra}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def kept_items(rounds: Column, keep) -> Column:
    """An array of structs with an array `items`, each with the items that pass."""
    return F.transform(rounds, lambda r: r.withField("items", F.filter(r["items"], keep)))
