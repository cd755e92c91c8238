"""Items whose values carry a type tag, such as ``{"id": {"S": "p1"}}``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.columns import col

_TEXT_LIKE_OBJECT = r':\s*"(\{|\\u007[bB])'


def first_tag_value(tagged: Column) -> Column:
    """Value under the first tag of a one-key JSON object; null for ``{}``."""
    return F.get(F.map_values(F.from_json(tagged, "map<string,string>")), F.lit(0))


def typed_json_fields(df: DataFrame, line_col: str) -> list[str]:
    """Names of the fields that occur, sorted. They become columns, so there is no limit but that of a table."""
    keys = F.json_object_keys(col(line_col))
    return sorted(row.key for row in df.select(F.explode(keys).alias("key")).distinct().collect())


def flatten_typed_json(
    df: DataFrame, line_col: str, fields: Sequence[str] | None = None
) -> DataFrame:
    """One text column per field, in the place of the JSON line.

    An object gives the value under its first tag, an empty object nothing, any
    other value its text. Rows stay where they are: no shuffle. Name the fields
    to spare the pass that finds them.

    Lines are read as maps, which keep tags in the order written; of a repeated name the first value counts. A VARIANT
    would sort the tags, write numbers anew and refuse lines with repeated names.
    """
    names = typed_json_fields(df, line_col) if fields is None else list(fields)
    line = col(line_col)
    # The types are parsed only where some text value opens like an object.
    typed = F.when(line.rlike(_TEXT_LIKE_OBJECT), F.from_json(line, "map<string,variant>"))
    parsed = df.withColumns({"__text": F.from_json(line, "map<string,string>"), "__typed": typed})
    rest = [c for c in df.columns if c != line_col]
    return parsed.select(*[col(c) for c in rest], *[_field(n).alias(n) for n in names])


def _field(field: str) -> Column:
    value, typed = F.col("__text")[F.lit(field)], F.col("__typed")
    is_object = typed.isNull() | F.schema_of_variant(typed[F.lit(field)]).startswith("OBJECT")
    return F.when(value.startswith("{") & is_object, first_tag_value(value)).otherwise(value)
