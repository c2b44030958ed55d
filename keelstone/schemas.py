"""Explicit schemas of the knowledge tables, and the layer lattice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Layers whose rules are taken as given.
GROUNDED = ("c11_core", "c11_stdlib", "cpp_core", "cpp_stdlib", "cpp20_language", "cpp20_stdlib")

ERROR_TYPES = ("undefined_behavior", "unspecified", "implementation_defined", "constraint_violation", "syntax_error")
RULE_TYPES = ("precondition", "postcondition", "invariant", "exception", "effect", "constraint", "anti_pattern", "complexity")
DECISIONS = ("pending", "approved", "rejected", "modified", "skipped")

_STR = T.StringType()
_STRS = T.ArrayType(_STR)

VIOLATION = T.StructType().add("code", _STR).add("error_type", _STR).add("message", _STR)
SOURCE = T.StructType().add("file", _STR).add("module", _STR).add("line_start", "integer").add("line_end", "integer")

RULE = (
    T.StructType()
    .add("id", _STR).add("content", _STR).add("formal_spec", _STR).add("layer", _STR).add("confidence", "double")
    .add("source", SOURCE).add("violated_by", T.ArrayType(VIOLATION)).add("std_refs", _STRS).add("tags", _STRS).add("depends_on", _STRS)
    .add("function", _STR).add("header", _STR).add("signature", _STR).add("rule_type", _STR).add("on_violation", _STR).add("reviewed", "boolean")
    .add("pairs_with", _STRS).add("pairing_role", _STR).add("pairing_required", "boolean").add("pairing_source", _STR)
)

ERROR_CODE = T.StructType().add("code", _STR).add("internal_code", _STR).add("type", _STR).add("description", _STR).add("std_refs", _STRS).add("validates", _STRS)
PAIRING = T.StructType().add("opener_id", _STR).add("closer_id", _STR).add("required", "boolean").add("source", _STR).add("confidence", "double").add("cell", _STR).add("evidence", _STR)
IDIOM = T.StructType().add("id", _STR).add("name", _STR).add("participants", _STRS).add("template", _STR).add("source", _STR)
EDGE = T.StructType().add("src", _STR).add("dst", _STR)
HIT = (
    T.StructType().add("claim_id", "long").add("rank", "integer").add("id", _STR).add("content", _STR).add("formal_spec", _STR)
    .add("module", _STR).add("layer", _STR).add("confidence", "double").add("distance", "double")
)
OPERATION = (
    T.StructType().add("file", _STR).add("fn", _STR).add("ord", "integer").add("id", _STR).add("op_type", _STR).add("operator", _STR).add("snippet", _STR)
    .add("operands", _STRS).add("guards", _STRS).add("function_called", _STR).add("call_arguments", _STRS).add("parent_id", _STR).add("is_lvalue", "boolean")
    .add("line_start", "integer").add("line_end", "integer").add("col_start", "integer").add("col_end", "integer")
)



def with_defaults(rules: DataFrame) -> DataFrame:
    """A partial rule table in the full schema: missing columns and nulls get the model's defaults."""
    have = set(rules.columns)
    fallback = {"layer": F.lit("c11_core"), "confidence": F.lit(1.0), "reviewed": F.lit(False), "pairing_required": F.lit(False), "content": F.lit(""), "formal_spec": F.lit("")}
    out = []
    for f in RULE:
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in fallback:
            c = F.coalesce(c, fallback[f.name])
        elif isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        out.append(c.alias(f.name))
    return rules.select(*out)


def grounded(layer: Column) -> Column:
    return layer.isin(*GROUNDED)


def effective_confidence(layer: Column, confidence: Column, reviewed: Column) -> Column:
    """Trusted layers keep their confidence, reviewed rules get 0.9 of it, others 0.7; at most 1."""
    factor = F.when(grounded(layer), 1.0).when(reviewed, 0.9).otherwise(0.7)
    return F.when(grounded(layer), confidence).otherwise(F.least(factor * confidence, F.lit(1.0)))
