"""Flattening declared tools into the texts a model reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMS_TYPE = "properties MAP<STRING, VARIANT>"

# JSON spellings of values that count as absent
ABSENT_JSON = ["null", "false", "0", "0.0", '""', "[]", "{}"]


def present(value: Column) -> Column:
    """Whether a VARIANT holds something (not null, false, zero or empty)."""
    return F.coalesce(~F.to_json(value).isin(ABSENT_JSON), F.lit(False))


def as_text(value: Column) -> Column:
    """A VARIANT scalar as text; lists and objects keep their JSON spelling."""
    spelled = F.to_json(value)
    return (
        F.when(spelled == "true", F.lit("True"))
        .when(spelled == "false", F.lit("False"))
        .when(spelled == "null", F.lit("None"))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def param_texts(input_schema: Column) -> Column:
    """``array<struct<param, text>>`` of the described top-level parameters, in schema order.

    Members that are not objects and nested properties are not looked at. When a key is
    repeated its last value counts, as JSON readers agree.
    """
    params = F.from_json(input_schema, PARAMS_TYPE)["properties"]
    keys = F.map_keys(params)
    last = F.filter(
        F.map_entries(params),
        lambda e, i: i == F.size(keys) - F.array_position(F.reverse(keys), e["key"]),
    )
    described = F.transform(
        last,
        lambda e: F.struct(
            e["key"].alias("param"),
            F.when(
                present(F.try_variant_get(e["value"], "$.description", "variant")),
                as_text(F.try_variant_get(e["value"], "$.description", "variant")),
            ).alias("text"),
        ),
    )
    texts = F.filter(described, lambda p: p["text"].isNotNull())
    return F.coalesce(texts, F.array().cast("array<struct<param:string,text:string>>"))


def tool_entries(tools: DataFrame) -> DataFrame:
    """One row per tool with its text entries and their concatenation, all row-local.

    Columns: ``target, tool, entries array<struct<where, text>>, blob``.
    """
    with_params = tools.select(
        "target",
        "tool",
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        param_texts(F.col("input_schema")).alias("params"),
    )
    entries = F.concat(
        F.array(F.struct(F.lit("description").alias("where"), F.col("description").alias("text"))),
        F.transform(
            "params",
            lambda p: F.struct(F.concat(F.lit("param:"), p["param"]).alias("where"), p["text"].alias("text")),
        ),
    )
    return with_params.select(
        "target",
        "tool",
        F.filter(entries, lambda e: e["text"] != "").alias("entries"),
        F.concat_ws(" ", F.array("description"), F.transform("params", lambda p: p["text"])).alias("blob"),
    )


def tool_text(tools: DataFrame) -> DataFrame:
    """``(target, tool, where, text)``: the description and each described parameter."""
    return tool_entries(tools).select("target", "tool", F.inline("entries"))


def tool_blob(tools: DataFrame) -> DataFrame:
    """``(target, tool, blob)``: all text of a tool in schema order, joined by spaces."""
    return tool_entries(tools).select("target", "tool", "blob")
