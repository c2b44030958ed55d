"""TOML rule collections: text to rows, rows to text, and a Spark data source.

``spark.dataSource.register(TomlRules)`` then ``spark.read.format("toml_rules").load(path)``
reads a file, or several separated by commas, one partition each; a missing file is left out.
Through Spark's readers (any store), use :func:`read_rules`.
"""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keelstone.schemas import ERROR_CODE, IDIOM, PAIRING, RULE

_SOURCE_KEYS = {"file": "source_file", "module": "source_module", "line_start": "source_line_start", "line_end": "source_line_end"}
_DEFAULTS = {"layer": "c11_core", "reviewed": False, "pairing_role": "none", "pairing_required": False, "pairing_source": ""}
_RENAMED = {"std_refs": "c_standard_refs"}
#: Lists of tables in a collection that are no rules.
_OTHER_LISTS = ("error_codes", "pairing", "pairings", "idiom", "idioms")


def _like(rec: dict, *tests):
    """The first value whose key passes a test, for keys that files name differently."""
    return next((v for k, v in rec.items() if any(t(k) for t in tests)), None)


def parse_rules(text: str) -> list[dict]:
    """The rules of a TOML text in the rule schema; a record without id, content and formal_spec is an error.

    Rules are the tables of any list but error codes, pairings and idioms.  Missing keys
    have defaults; ``error_codes`` become violations of type ``UNDEF``; the kind of a rule
    is under a key that ends with ``_type``.
    """
    data = tomllib.loads(text)
    out = []
    for section, records in data.items():
        if section in _OTHER_LISTS or not isinstance(records, list) or not all(isinstance(r, dict) for r in records):
            continue
        for rec in records:
            row = {}
            for f in RULE:
                key = _RENAMED.get(f.name, f.name)
                if f.name == "source":
                    row[f.name] = {k: rec.get(v, rec.get(k, "" if k in ("file", "module") else None)) for k, v in _SOURCE_KEYS.items()}
                elif f.name == "violated_by":
                    row[f.name] = [{"code": c, "error_type": "UNDEF", "message": ""} for c in rec.get("error_codes", [])]
                elif isinstance(f.dataType, T.ArrayType):
                    row[f.name] = list(rec.get(key, rec.get(f.name, [])))
                elif f.name in ("id", "content", "formal_spec"):
                    row[f.name] = rec[f.name]
                elif f.name == "rule_type":
                    row[f.name] = _like(rec, lambda k: k.endswith("_type"))
                elif f.name == "confidence":
                    row[f.name] = float(rec.get(key, 1.0))
                else:
                    row[f.name] = rec.get(key, _DEFAULTS.get(f.name))
            out.append(row)
    return out


def parse_error_codes(text: str) -> list[dict]:
    """The error codes of a TOML text."""
    out = []
    for rec in tomllib.loads(text).get("error_codes", []):
        if isinstance(rec, dict):
            out.append({"code": rec.get("code"), "internal_code": rec.get("internal_code"), "type": rec.get("type"), "description": rec.get("description"), "std_refs": list(rec.get("c_standard_refs", rec.get("std_refs", []))), "validates": list(_like(rec, lambda k: k.startswith("validates")) or [])})
    return out


def parse_pairings(text: str) -> tuple[list[dict], list[dict]]:
    """S3: pairings (required unless said otherwise, confidence 1) and idioms (id from the name) of a manifest."""
    data = tomllib.loads(text)
    pairs = [
        {"opener_id": p["opener"], "closer_id": p["closer"], "required": bool(p.get("required", True)), "source": p.get("source", "toml_manifest"), "confidence": float(p.get("confidence", 1.0)), "cell": p.get("cell"), "evidence": p.get("evidence", "")}
        for p in data.get("pairing", data.get("pairings", []))
    ]
    idioms = [{"id": "idiom_" + i["name"], "name": i["name"], "participants": list(i.get("participants", [])), "template": i.get("template", ""), "source": i.get("source", "toml_manifest")} for i in data.get("idiom", data.get("idioms", []))]
    return pairs, idioms


_PARSERS = {"rules": (RULE, parse_rules), "error_codes": (ERROR_CODE, parse_error_codes), "pairings": (PAIRING, lambda t: parse_pairings(t)[0]), "idioms": (IDIOM, lambda t: parse_pairings(t)[1])}


def read_rules(spark: SparkSession, path: str | list[str], table: str = "rules") -> DataFrame:
    """One of the tables of TOML files, read through Spark's own readers, so from any store."""
    schema, parse = _PARSERS[table]
    files = spark.read.text(path, wholetext=True)

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows = parse(text or "")
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return files.select("value").mapInArrow(run, schema)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.paths, self.table = schema, [p for p in options.get("path", "").split(",") if p], options.get("table", "rules")

    def partitions(self):
        return [_File(p) for p in self.paths if os.path.exists(p.removeprefix("file://"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        schema, parse = _PARSERS[self.table]
        with open(partition.path.removeprefix("file://"), encoding="utf-8") as f:
            for row in parse(f.read()):
                yield tuple(_nested(row[x.name], x.dataType) for x in schema)


def _nested(value, kind):
    """Dicts as tuples, as rows are given to Spark."""
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return tuple(_nested(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType) and value is not None:
        return [_nested(v, kind.elementType) for v in value]
    return value


class TomlRules(DataSource):
    """Reads rules (or, with ``table``, error_codes, pairings or idioms) of TOML files on a path that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "toml_rules"

    def schema(self):
        return _PARSERS[self.options.get("table", "rules")][0]

    def reader(self, schema):
        return _Reader(schema, self.options)


def quoted(c: Column) -> Column:
    """A TOML string: literal with three apostrophes, or basic and escaped if it has those."""
    basic = F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    awkward = F.contains(c, F.lit("'''")) | F.endswith(c, F.lit("'")) | c.rlike("[\\x00-\\x08\\x0B-\\x1F\\x7F]")
    return F.when(awkward, basic).otherwise(F.concat(F.lit("'''"), c, F.lit("'''")))


def toml_record(columns: dict[str, tuple[Column, object]], section: str = "rules") -> Column:
    """K1: a TOML table of (column, default) pairs; empty and default values are left out.

    A column is written by its kind, named by the default: a string, number, boolean or list of strings.
    """
    lines = [F.lit(f"[[{section}]]")]
    for name, (c, default) in columns.items():
        key = F.lit(f"{name} = ")
        if isinstance(default, list):
            items = F.array_join(F.transform(c, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), ", ")
            lines.append(F.when(F.size(c) > 0, F.concat(key, F.lit("["), items, F.lit("]"))))
        elif isinstance(default, bool):
            lines.append(F.when(c != F.lit(default), F.concat(key, F.lower(c.cast("string")))))
        elif isinstance(default, (int, float)):
            lines.append(F.when(c != F.lit(default), F.concat(key, c.cast("string"))))
        else:
            lines.append(F.when(c.isNotNull() & (c != "") & (c != F.lit(default or "")), F.concat(key, quoted(c))))
    return F.concat_ws("\n", *lines)
