"""The text functions for Spark SQL: SQL functions, which the optimizer inlines, and a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import parse
from . import text as T


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(values: list[str]) -> str:
    return ", ".join(_quoted(v) for v in values)


def definitions() -> list[str]:
    """``name(parameters) returns type return body`` of each function; later ones call earlier ones."""
    words = "array_size(regexp_extract_all(lower(x), {}, 0)) > 0"
    whole = lambda ws: words.format(_quoted(r"(?<![a-z])(" + "|".join(ws) + r")(?![a-z])"))
    holds = lambda ps: " or ".join(f"contains(lower(x), {_quoted(p)})" for p in ps)
    key = _quoted(parse.key_pattern())
    no_row = " and ".join(f"not line rlike {_quoted(p)}" for p in (parse.COVERAGE_ROW, parse.ENDORSEMENT_ROW))
    return [
        f"query_tokens(x string) returns array<string> return filter(regexp_extract_all(lower(x), '[a-zA-Z]+', 0), w -> w not in ({_in(T.STOPWORDS)}))",
        f"seed_ids(x string) returns array<string> return array_distinct(regexp_extract_all(x, {_quoted(T.ID_PATTERN)}, 1))",
        f"claim_ids(x string) returns array<string> return array_distinct(regexp_extract_all(x, {_quoted(T.CLAIM_PATTERN)}, 0))",
        "value_tokens(x string) returns array<string> return filter(query_tokens(x), w -> not exists(seed_ids(x), i -> contains(lower(i), w)))",
        r"numeric_tokens(x string) returns array<bigint> return transform(regexp_extract_all(x, '\\$?\\d[\\d,]*', 0), s -> try_cast(regexp_replace(s, '[$,]', '') as bigint))",
        f"threshold_direction(x string) returns int return case when {whole(T.ABOVE)} then 1 when {whole(T.BELOW)} then -1 else 0 end",
        "singular(x string) returns string return case when endswith(x, 'ies') and length(x) > 4 then left(x, length(x) - 3) || 'y' when endswith(x, 'es') and length(x) > 4 then left(x, length(x) - 2) "
        "when endswith(x, 's') and length(x) > 3 and not endswith(x, 'ss') and not endswith(x, 'is') then left(x, length(x) - 1) else x end",
        "count_tokens(x string) returns bigint return case when coalesce(length(x), 0) = 0 then 0 else greatest(1, length(x) div 4) end",
        f"verdict(x string) returns string return case when {holds(T.UNKNOWN_PHRASES)} then 'UNKNOWN' when {holds(T.NO_PHRASES)} then 'NO' when {holds(['fraud'])} then 'YES' else 'UNKNOWN' end",
        "savings_percent(a double, b double) returns double return case when coalesce(a, 0) = 0 then 0 else greatest(round((1 - b / a) * 100, 2), 0) end",
        "key_values(x string) returns table (key string, value string) return select key, max_by(value, pos) as value from ("
        f"select pos, regexp_extract(line, {key}, 1) as key, trim(regexp_extract(line, {key}, 2)) as value from (select p.pos, trim(p.col) as line from posexplode(split(x, '\\\\r\\\\n|\\\\r|\\\\n')) p) where line rlike {key} and {no_row}) group by key",
    ]


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names.

    They are temporary: a session of its own registers them again.
    """
    made = definitions()
    for body in made:
        spark.sql(f"create or replace temporary function {body}")
    return [body.split("(", 1)[0] for body in made]
