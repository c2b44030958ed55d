"""Exact substring dedup by fixed-block anchors.

Words are maximal runs of characters other than ASCII white space, unchanged.  A
window is ``width`` consecutive words; one whose word sequence also starts
elsewhere (in the same text or another) is repeated, and every word that it covers
is removed.

1. *Blocks.* Every text is cut into blocks of ``(width + 1) // 2`` words that do not
   overlap; any window holds a whole block.  The blocks are the index.
2. *Probes.* The rolling window of a block's length at every word probes the index.
   Texts are dealt into parts; a part sends its distinct rolling hashes to range
   buckets, marked where they are blocks and where they occur twice in the part, so
   a passage of a third of all texts costs one entry a part.  A bucket returns to
   each part those of its hashes that are a block and occur twice or more.
3. *Extension.* Around each hit, the windows that hold it are hashed whole and
   counted over all parts in the same way; those that occur twice are repeats, and
   overlapping ones run together into maximal exact repeats.

Equal texts are one class; a class of two or more rows repeats all its windows.
Windows are compared by 64-bit hashes of their word sequences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm._common import buckets_for, free_name, hashable, n_rows, parts_for, release, spread_join, text_bytes, text_copies, text_key
from keelstone.llm._words import Buckets, _spans, chunks, ngrams, word_hashes
from keelstone.llm.ngram_jaccard import BUCKET_KEYS, dealt_texts, ranges

_BLOCK, _TWICE = 1, 2


def part_texts(table: pa.Table) -> tuple[list[int], list[int], list[bytes]]:
    """Of a part: its distinct keys and texts."""
    at = {}
    for i, key in enumerate(zip(table["k1"].to_pylist(), table["k2"].to_pylist(), strict=True)):
        at.setdefault(key, i)
    release(every=16)
    keys = sorted(at)
    texts = table["text"].cast(pa.large_binary()).take(pa.array([at[x] for x in keys], pa.int64())).to_pylist()
    return [x[0] for x in keys], [x[1] for x in keys], texts


def _runs(texts: list[bytes], width: int, block: int):
    """Of each run of texts: the places of whole windows' starts and of blocks, and hashes of blocks at every word.

    ``inside`` tells where a rolling block lies within one text that has a window;
    ``aligned`` where it is a block of the index; ``whole`` where a window starts.
    """
    for run in chunks(texts):
        words, cut = word_hashes(texts[run.start : run.stop])
        rolling = ngrams(words, block)
        inside = np.zeros(len(rolling), dtype=bool)
        aligned = np.zeros(len(rolling), dtype=bool)
        whole = np.zeros(len(words), dtype=bool)
        for i in range(len(run)):
            a, b = cut[i], cut[i + 1]
            if b - a >= width:
                inside[a : b - block + 1] = True
                aligned[a : b - block + 1 : block] = True
                whole[a : b - width + 1] = True
        yield run, words, cut, rolling, inside, aligned, whole


_SENT_SQL = "bucket int, part int, hashes binary, marks binary"
_SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("hashes", pa.binary()), ("marks", pa.binary())])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True) if rows else ([],) * 4, _SENT, strict=True)], schema=_SENT)


def _probe(buckets: Buckets, width: int, block: int):
    def run(table: pa.Table) -> pa.Table:
        _, _, texts = part_texts(table)
        keys, marks = [np.empty(0, np.uint64)], [np.empty(0, np.uint8)]
        for _, _, _, rolling, inside, aligned, _ in _runs(texts, width, block):
            k, first, inverse, n = np.unique(buckets.keys(rolling[inside]), return_index=True, return_inverse=True, return_counts=True)
            m = np.where(n > 1, _TWICE, 0).astype(np.uint8)
            m[inverse[aligned[inside]]] |= _BLOCK
            keys.append(k)
            marks.append(m)
        return _table(_merged(keys, marks, buckets, table["part"][0].as_py()))

    return run


def _merged(keys: list[np.ndarray], marks: list[np.ndarray], buckets: Buckets, part: int) -> list[tuple]:
    """The distinct keys of all runs, by bucket; what occurs in two runs occurs twice."""
    k, inverse, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    m = np.where(n > 1, _TWICE, 0).astype(np.uint8)
    np.bitwise_or.at(m, inverse, np.concatenate(marks))
    return [(b, part, low.tobytes(), m[s].tobytes()) for b, s, low in buckets.split(k)]


def _repeated(wanted: int, dtype):
    """Of a bucket: to each part its hashes that occur twice or more and have the wanted mark somewhere."""

    def run(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, dtype) for x in table["hashes"].to_pylist()]
        marks = [np.frombuffer(x, np.uint8) for x in table["marks"].to_pylist()]
        keep = [np.zeros(len(h), dtype=bool) for h in hashes]
        for cut in ranges(hashes, BUCKET_KEYS):
            keys, inverse, n = np.unique(np.concatenate([h[s] for h, s in zip(hashes, cut, strict=True)]), return_inverse=True, return_counts=True)
            any_mark = np.zeros(len(keys), np.uint8)
            np.bitwise_or.at(any_mark, inverse, np.concatenate([m[s] for m, s in zip(marks, cut, strict=True)]))
            good = ((n > 1) | (any_mark & _TWICE > 0)) & (any_mark & wanted == wanted)
            at = 0
            for x, s in zip(keep, cut, strict=True):
                x[s] = good[inverse[at : at + s.stop - s.start]]
                at += s.stop - s.start
        rows = [(table["bucket"][0].as_py(), part, h[x].tobytes(), b"") for h, x, part in zip(hashes, keep, table["part"].to_pylist(), strict=True) if x.any()]
        return _table(rows)

    return run


def _known(answers: pa.Table, buckets: Buckets) -> np.ndarray:
    """Sorted keys that buckets returned to a part."""
    if not answers.num_rows:
        return np.empty(0, np.uint64)
    rows = sorted(zip(answers["bucket"].to_pylist(), answers["hashes"].to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(h, np.uint32).astype(np.uint64) + buckets.low[b] for b, h in rows])


def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places are in a window that starts where ``starts`` is true."""
    step = np.zeros(n + width + 1, dtype=np.int32)
    at = np.flatnonzero(starts)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step)[:n] > 0


def _extend(buckets: Buckets, width: int, block: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _table([])
        known = _known(answers, buckets)
        _, _, texts = part_texts(table)
        found, marks = [np.empty(0, np.uint64)], [np.empty(0, np.uint8)]
        reach = width - block
        for _, words, _, rolling, inside, _, whole in _runs(texts, width, block):
            hit = inside & _in(known, buckets.keys(rolling))
            # windows that hold a hit: those that start up to ``reach`` words before it
            near = np.zeros(len(words) + reach, dtype=bool)
            near[: len(hit)] = hit
            near = _covered(near[::-1], reach + 1, len(near))[::-1][: len(words)] & whole
            at = np.flatnonzero(near)
            if len(at):
                h, n = np.unique(ngrams(words, width)[at], return_counts=True)
                found.append(h)
                marks.append(np.where(n > 1, _TWICE, 0).astype(np.uint8))
        h, inverse, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        m = np.where(n > 1, _TWICE, 0).astype(np.uint8)
        np.bitwise_or.at(m, inverse, np.concatenate(marks))
        part = table["part"][0].as_py()
        return _table([(b, part, h[s].tobytes(), m[s].tobytes()) for b, s, _ in buckets.split(buckets.keys(h))])

    return run


_KEPT_SQL = "k1 long, k2 long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,length:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_KEPT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", _SPAN)])


def _cut(width: int, block: int, as_is: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _KEPT.empty_table()
        k1, k2, texts = part_texts(table)
        hashes = [np.frombuffer(x, np.uint64) for x in answers["hashes"].to_pylist()]
        known = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        rows = []
        for run, words, cut, _, _, _, whole in _runs(texts, width, block):
            starts = np.zeros(len(words), dtype=bool)
            if len(known) and len(words) >= width:
                grams = ngrams(words, width)
                starts[: len(grams)] = whole[: len(grams)] & _in(known, grams)
            gone = _covered(starts, width, len(words))
            for i, j in enumerate(run):
                g = gone[cut[i] : cut[i + 1]]
                if not g.any():
                    rows.append((k1[j], k2[j], len(g), 0, (texts[j] if as_is else b" ".join(texts[j].split())).decode(), []))
                    continue
                raw = np.frombuffer(texts[j], np.uint8)
                a, b = _spans(raw)
                kept = b" ".join(texts[j][x:y] for x, y in zip(a[~g], b[~g], strict=True))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(np.int8), [0]))))
                spans = [{"start": int(x), "length": int(y - x)} for x, y in zip(edge[0::2], edge[1::2], strict=True)]
                rows.append((k1[j], k2[j], len(g), int(g.sum()), kept.decode(), spans))
        return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), _KEPT, strict=True)], schema=_KEPT)

    return run


def repeat_classes(docs: DataFrame, text_col: str = "text", width: int = 35, as_is: bool = False, copies: DataFrame | None = None) -> DataFrame:
    """One row per distinct text: ``k1, k2, n_words, n_removed, kept_text, kept_sha256, spans``.

    The digest is made before texts are shuffled, so a caller that takes only it moves no
    texts.  With ``as_is``, a text that loses nothing is its own ``kept_text``, white space
    and all.

    ``spans`` are the maximal exact repeats, in words.  Copies of a text are taken
    into account, so a text of two rows or more has no word left if it has a window;
    ``copies`` may give the rows of each text, as :func:`text_copies` counts them.  Null and
    empty texts are one class without words.  Other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    copies = text_copies(docs, text_col) if copies is None else copies
    block = (width + 1) // 2
    total = text_bytes(docs, text_col)
    parts, buckets = parts_for(total), Buckets(buckets_for(total))
    texts = dealt_texts(docs, text_col, parts)
    sent = texts.groupBy("part").applyInArrow(_probe(buckets, width, block), _SENT_SQL)
    hits = sent.groupBy("bucket").applyInArrow(_repeated(_BLOCK, np.uint32), _SENT_SQL)
    windows = texts.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(_extend(buckets, width, block), _SENT_SQL)
    again = windows.groupBy("bucket").applyInArrow(_repeated(0, np.uint64), _SENT_SQL)
    kept = texts.groupBy("part").cogroup(again.groupBy("part")).applyInArrow(_cut(width, block, as_is), _KEPT_SQL)
    kept = kept.withColumn("kept_sha256", F.sha2("kept_text", 256))
    all_gone = (F.col("n") > 1) & (F.col("n_words") >= width)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length")))
    return kept.join(copies, ["k1", "k2"]).select(
        "k1", "k2", "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(all_gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(all_gone, whole).otherwise(F.col("spans")).alias("spans"),
    )


def substring_dedup(docs: DataFrame, text_col: str = "text", width: int = 35, keep: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_words``, ``n_removed`` and ``kept_text`` (words left, joined by one space).

    Null and empty texts have no words and an empty ``kept_text``.  Texts of fewer
    than ``width`` words lose nothing.  With ``as_is``, the ``kept_text`` of a text that
    loses nothing is the text itself.  Every row keeps its own columns; of a column
    that has one of the new names, the new one takes its place.  An empty table gives
    an empty result.
    """
    copies = text_copies(docs, text_col)
    classes = repeat_classes(docs, text_col, width, as_is, copies).select("k1", "k2", "n_words", "n_removed", "kept_text")
    a, b = free_name(docs.columns, "k1"), free_name(docs.columns, "k2")
    keys = [x.alias(n) for x, n in zip(text_key(F.col(text_col)), (a, b), strict=True)]
    new = {"n_words", "n_removed", "kept_text"}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    own = [F.col(f"`{c}`") for c in names]
    rows = docs.select(*own, *keys)
    renamed = {"k1": a, "k2": b}
    # rows of one text are told apart by their other columns
    draw = hashable(docs, [c for c in names if c != text_col])
    out = spread_join(rows, classes.withColumnsRenamed(renamed), [a, b], draw, n_rows(copies), counts=copies.withColumnsRenamed(renamed))
    return out.select(*own, *sorted(new))
