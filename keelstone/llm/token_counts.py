"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole.  The byte-level tokenizer is lossless, so the
running sum of its tokens' lengths gives every token's span; sections are spans of
the same text, and an interval join (a sorted search of the token's place among the
section starts) attributes each token.  A token that crosses a boundary is allocated
by an explicit rule: ``start`` gives it to the section of its first byte, ``end`` to
that of its last, and ``most`` to the section with most of its bytes, the first if
several.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = ("start", "end", "most")


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for piece, i in ranks.items():
        sizes[i] = len(piece)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def line_starts(raw: bytes) -> np.ndarray:
    """Where each line begins; a newline belongs to the line that it ends."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.concatenate(([0], breaks[breaks < len(raw)])).astype(np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section from token ends and section starts, and how many tokens cross a boundary."""
    if rule not in RULES:
        raise ValueError(f"rule has to be one of {RULES}")
    begins = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    owner = {"start": first, "end": last, "most": first.copy()}[rule]
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        stops = np.append(starts[1:], total)
        for i in crossing:
            s = np.arange(first[i], last[i] + 1)
            owner[i] = s[np.argmax(np.minimum(stops[s], ends[i]) - np.maximum(starts[s], begins[i]))]
    return np.bincount(owner, minlength=len(starts)), len(crossing)


def _count(path: str, pattern: str, rule: str, n_fields: int):
    def run(batches):
        enc, sizes = _encoding(path, pattern)
        for batch in batches:
            rows = []
            columns = [batch.column(i + 1).to_pylist() for i in range(n_fields)]
            for fields in zip(*columns, strict=True):
                raws = [(f or "").encode() for f in fields]
                text = "".join(f or "" for f in fields)
                cuts = np.cumsum([0] + [len(r) for r in raws])
                # a field's lines; an empty field has no section
                starts = np.concatenate([line_starts(r) + c for r, c in zip(raws, cuts, strict=False) if r] or [np.empty(0, np.int64)])
                field = np.repeat(np.arange(n_fields), [len(line_starts(r)) if r else 0 for r in raws])
                if not text:
                    rows.append((0, 0, [0] * n_fields, []))
                    continue
                ends = np.cumsum(sizes[enc.encode_ordinary(text)])
                counts, crossing = attribute(ends, starts, int(cuts[-1]), rule)
                rows.append((int(counts.sum()), crossing, np.bincount(field, weights=counts, minlength=n_fields).astype(np.int64), counts))
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], names=["id", "n_tokens", "n_crossing", "field_tokens", "section_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, fields: list[str] | None = None, id_col: str = "doc_id", rule: str = "start") -> DataFrame:
    """Tokens per field and per section (line) of each document's fields, written one after another.

    Returns a row per input row: ``id_col, n_tokens, n_crossing`` (tokens over a
    boundary), ``field_tokens`` (one count per field) and ``section_tokens`` (one per
    line of all fields, in order); both sum to ``n_tokens``.  Null fields are empty; an
    empty field has no section and no tokens.  Repeated rows and null ids stay; other
    columns are ignored; an empty table gives an empty result.
    """
    fields = fields or ["text"]
    id_type = docs.select(id_col).schema[0].dataType
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType()), T.StructField("field_tokens", longs), T.StructField("section_tokens", longs)])
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return rows.mapInArrow(_count(tokenizer_path, pattern, rule, len(fields)), schema).withColumnRenamed("id", id_col)
