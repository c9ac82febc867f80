"""The scoring rules as SQL functions, for users of spark.sql()."""

from __future__ import annotations

from pyspark.sql import SparkSession

from engrammatic import dims as D

#: Name: (parameters, what it returns, the expression). Null arguments give null unless the rule says otherwise.
SQL_FUNCTIONS = {
    "recency_decay": ("tier INT, age_days DOUBLE", "DOUBLE", f"greatest(0D, least(1D, exp(-ln(2D) / (CASE tier {' '.join(f'WHEN {t} THEN {h!r}D' for t, h in D.HALF_LIFE_DAYS.items())} ELSE {D.HALF_LIFE_DAYS[2]!r}D END) * age_days)))"),
    "tier_of": ("score DOUBLE", "INT", "CASE " + " ".join(f"WHEN score >= {least}D THEN {tier}" for least, tier in D.TIER_POLICIES["ml"][0]) + f" ELSE {D.TIER_POLICIES['ml'][1]} END"),
    "edge_strength": ("strength DOUBLE, idle_seconds DOUBLE", "DOUBLE", "least(1D, strength * exp(-1.2E-5D * idle_seconds) + 0.1D)"),
    "valid_at": ("as_of BIGINT, since BIGINT, until BIGINT", "BOOLEAN", "(since IS NULL OR since <= as_of) AND (until IS NULL OR until >= as_of)"),
    "edit_ratio": ("a STRING, b STRING", "DOUBLE", "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1D ELSE 1D - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END"),
    "token_estimate": ("text STRING", "BIGINT", "CAST(floor(length(text) / 4) AS BIGINT)"),
    "cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / nullif(sqrt(aggregate(a, 0D, (s, v) -> s + v * v) * aggregate(b, 0D, (s, v) -> s + v * v)), 0D)",
    ),
    "relation_category": ("relation STRING", "STRING", "CASE relation " + " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in D.CATEGORY_OF.items()) + " ELSE 'temporal' END"),
}


def register(spark: SparkSession, prefix: str = "mem_") -> list[str]:
    """Makes every function known to the session's SQL, under the prefix; Catalyst inlines them. Their names."""
    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {returns} RETURN {body}")
    return [prefix + n for n in SQL_FUNCTIONS]
