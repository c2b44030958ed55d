"""File sources: error catalogues, source trees, ignore files, sessions, pages."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.functions import patterns as P

_LOG = logging.getLogger(__name__)
LANGUAGE_FILES = {"c": "*.{c,h}", "cpp": "*.{cpp,cc,cxx,hpp,h,hxx}"}


def error_catalogue(rows: DataFrame) -> DataFrame:
    """Error codes from rows ``c0`` to ``c3`` (code, description, references, type) of a header-less file.

    Kept are rows with four columns whose code has a known prefix; the internal code is
    what follows the first dash; an unknown type is undefined behaviour.
    """
    code = F.trim("c0")
    good = code.rlike("^(" + "|".join(P.CODE_PREFIXES) + ")-") & F.col("c3").isNotNull()
    kind = F.lower(F.trim("c3"))
    named = (
        F.when(kind.contains("constraint"), "constraint_violation").when(kind.contains("unspecified"), "unspecified").when(kind.contains("implementation"), "implementation_defined")
        .when(kind.contains("syntax"), "syntax_error").otherwise("undefined_behavior")
    )
    refs = F.filter(F.transform(F.split(F.coalesce("c2", F.lit("")), ","), lambda r: F.trim(r)), lambda r: r != "")
    return rows.where(good).select(code.alias("code"), F.get(F.split(code, "-", 2), 1).alias("internal_code"), named.alias("type"), F.trim("c1").alias("description"), refs.alias("std_refs"))


def read_error_csv(spark: SparkSession, path: str) -> DataFrame:
    return error_catalogue(spark.read.csv(path, schema="c0 string, c1 string, c2 string, c3 string", escape='"', multiLine=True))


def source_tree(spark: SparkSession, path: str, language: str = "cpp", recursive: bool = True) -> DataFrame:
    """Files of a tree as (path, content), by the language's extensions or a glob."""
    glob = LANGUAGE_FILES.get(language, language)
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def ignore_patterns(lines: DataFrame, column: str = "value") -> DataFrame:
    """Patterns of an ignore file, without blank lines and comments."""
    line = F.trim(F.col(column))
    return lines.select(line.alias("pattern")).where((F.col("pattern") != "") & ~F.startswith("pattern", F.lit("#")))


def page_sections(pages: DataFrame, body: Column, most: int = 40_000, mark: str = "\n[truncated]") -> DataFrame:
    """Page texts of at most ``most`` characters, marked where they are cut (the model's input limit)."""
    cut = F.length(body) > most
    return pages.withColumn("section", F.when(cut, F.concat(F.substring(body, 1, most), F.lit(mark))).otherwise(body))


def read_sessions(spark: SparkSession, path: str, schema: str, one_a_file: bool = True) -> DataFrame:
    """Review sessions of JSON files, one in each or, as :func:`write_sessions` writes them, one a line; what cannot be read is left out."""
    rows = spark.read.json(path, schema=schema + ", _corrupt_record string", multiLine=one_a_file, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def write_sessions(sessions: DataFrame, path: str) -> None:
    """Review sessions as JSON, one a line; null fields are left out."""
    sessions.write.json(path)


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there; the others are warned of."""
    conf, found = spark._jsc.hadoopConfiguration(), []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).globStatus(path):
            found.append(p)
        else:
            _LOG.warning("not found, left out: %s", p)
    return found


def table_or_empty(spark: SparkSession, name: str, schema) -> DataFrame:
    """A table, or an empty one of the schema if there is none."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)
