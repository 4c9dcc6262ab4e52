"""Named SQL functions of the library, as SQL expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_SQUARE = "aggregate({v}, 0D, (s, x) -> s + x * x)"
FUNCTIONS = {
    "vec_dot": ("a array<double>, b array<double>", "double", _DOT),
    "vec_cosine": ("a array<double>, b array<double>", "double", f"{_DOT} / nullif(sqrt({_SQUARE.format(v='a')} * {_SQUARE.format(v='b')}), 0D)"),
    "vec_l2": ("a array<double>, b array<double>", "double", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "concept_of": ("t string", "string", "regexp_replace(lower(t), '[^\\\\p{L}\\\\p{N}]', '')"),
    "file_extension": ("t string", "string", "nullif(lower(regexp_extract(t, '\\\\.([A-Za-z0-9]{1,16})$', 1)), '')"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to SQL in this session."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
