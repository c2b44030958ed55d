"""Sequence packing by minimum bin slack over the histogram of lengths.

Documents are tokenised once and cut into full windows and a rest.  Pieces are counted
per length, at most one count per length up to the capacity, so the plan is made on
the driver whatever the corpus' size: the longest rest left opens a window, and a
bitset subset-sum over the remaining counts finds the multiset that fills it closest
to capacity; the counts are read back from the bitsets, and the pattern is used as
often as the counts allow.  A piece then finds its place from its length and its
number among the pieces of that length, without a shuffle of tokens.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
import zlib
from bisect import bisect_left
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keelstone.llm._common import materialise, release

#: Words whose ids a worker remembers, and the bytes that they and their ids may have.
KNOWN_WORDS, KNOWN_BYTES = 600_000, 48 << 20
#: Words that are encoded in one call.
TOGETHER = 4096
#: Bytes of text that are encoded at a time; a longer text is cut at white space.
RUN_BYTES = 4 << 20
#: Signs at the end of a chunk, after a letter or digit, are a token group of their own.
SIGNS = string.punctuation
_WHITE = re.compile(rb"[\x09-\x0D\x20]")
_LETTER_OR_DIGIT = np.array([chr(b) in string.ascii_lowercase + string.digits for b in range(256)])


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``values[starts[i] : starts[i] + sizes[i]]`` for each ``i`` of ``which``, put together."""
    out, done = np.empty(int(sizes[which].sum()), values.dtype), 0
    for at in range(0, len(which), 1 << 16):
        some = which[at : at + (1 << 16)]
        n = sizes[some]
        ends = np.cumsum(n)
        index = np.repeat(starts[some] - (ends - n), n)
        index += np.arange(len(index))
        out[done : done + len(index)] = values[index]
        done += len(index)
    return out


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of large strings, and where each of them begins and the last ends."""
    _, offsets, data = words.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset)


class ChunkEncoder:
    """Token ids of whole texts, by a tokenizer that drops white space and never joins across it.

    ``word_bpe_49k.json`` is one: it lower-cases, and its ids of a text are those of the
    text's chunks between ASCII white space, put together; signs that end a chunk are
    always apart from the letters before them.  So only the different words of a run of
    texts, without such signs, that are not remembered are encoded; ids of chunks and
    texts are put together in arrays.  A text with ``<|``, which may begin a special
    token, is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        # Words that are remembered, their ids, where those begin, and the last call that used each.
        self.words = pa.array([], pa.large_string())
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.used, self.calls = np.zeros(0, np.int64), 0

    def _plain(self, word: str) -> bool:
        """Whether a word is letters and stays so, so that just its last token ends a word."""
        return word.isalpha() and (word.isascii() or unicodedata.is_normalized("NFC", word) and word.lower().isalpha())

    def _forget(self) -> None:
        """Keeps the half of the words that was used last, if they are too many."""
        if len(self.words) > KNOWN_WORDS or self.words.nbytes + self.ids.nbytes > KNOWN_BYTES:
            kept = np.sort(np.argsort(-self.used, kind="stable")[: min(len(self.words), KNOWN_WORDS) // 2])
            sizes = np.diff(self.bounds)
            self.words, self.used = self.words.take(pa.array(kept)), self.used[kept]
            self.ids, self.bounds = _gather(self.ids, self.bounds, sizes, kept), _bounds(sizes[kept])

    def _learn(self, new: pa.Array) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """The words' numbers in the order in which they were encoded, their ids, and how many each has."""
        listed = new.to_pylist()
        order, ids, sizes, plain, rest = [], [], [], [], []
        for i, word in enumerate(listed):
            (plain if self._plain(word) else rest).append(i)
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            (together,) = self.tokenizer.encode_batch_fast([" ".join([listed[i] for i in some])], add_special_tokens=False)
            found = np.array(together.ids, dtype=np.uint32)
            stops = np.flatnonzero(self.ends[found]) + 1
            if len(stops) != len(some):
                rest += some
                continue
            order += some
            ids.append(found)
            sizes.append(np.diff(stops, prepend=0))
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([listed[i] for i in some], add_special_tokens=False)]
            order += some
            ids.append(np.array([x for e in found for x in e], dtype=np.uint32))
            sizes.append(np.array([len(e) for e in found], dtype=np.int64))
        return order, ids, sizes

    def _find(self, words: pa.Array) -> np.ndarray:
        """Numbers of different words among those that are remembered; the new ones are learned."""
        self._forget()
        self.calls += 1
        # The hash table is made of the fewer words.
        place = pc.index_in(self.words, value_set=words).fill_null(-1).to_numpy()
        there = np.flatnonzero(place >= 0)
        at = np.full(len(words), -1, dtype=np.int64)
        at[place[there]] = there
        new = np.flatnonzero(at < 0)
        if len(new):
            taken = words.take(pa.array(new))
            order, ids, sizes = self._learn(taken)
            at[new[order]] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, taken.take(pa.array(order, pa.int64()))])
            self.ids = np.concatenate([self.ids, *ids])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes))])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.used[at] = self.calls
        return at

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks, and how many each has: those of its word and of the signs at its end."""
        data, offsets = _bytes_of(chunks)
        trimmed = pc.ascii_rtrim(chunks, characters=SIGNS)
        sizes, whole = pc.binary_length(trimmed).to_numpy(), np.diff(offsets)
        cut = np.flatnonzero((sizes > 0) & (sizes < whole))
        cut = cut[_LETTER_OR_DIGIT[data[offsets[cut] + sizes[cut] - 1]]]
        is_cut = np.zeros(len(chunks), dtype=bool)
        is_cut[cut] = True
        signs = _gather(data, offsets[:-1] + sizes, whole - sizes, cut)
        signs = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(_bounds((whole - sizes)[cut])), pa.py_buffer(signs))
        parts = pa.concat_arrays([pc.if_else(pa.array(is_cut), trimmed, chunks), signs]).dictionary_encode()
        number = self._find(parts.dictionary)[parts.indices.to_numpy()]
        # A chunk's signs come right after its word.
        place = np.arange(len(chunks)) + np.cumsum(is_cut) - is_cut
        both = np.empty(len(number), np.int64)
        both[place], both[place[cut] + 1] = number[: len(chunks)], number[len(chunks) :]
        n = np.diff(self.bounds)
        total = n[number[: len(chunks)]]
        total[cut] += n[number[len(chunks) :]]
        return _gather(self.ids, self.bounds, n, both), total

    def _of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        offsets, chunks = split.offsets.to_numpy(), split.values.dictionary_encode()
        del split
        ids, sizes = self._of_chunks(chunks.dictionary)
        code = chunks.indices.to_numpy()
        return _gather(ids, np.cumsum(sizes) - sizes, sizes, code), _bounds(sizes[code])[offsets]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where those of each begin and the last end; a null text is empty."""
        # Taken first: ``ascii_lower`` misreads large strings whose first offset is not 0, which the cast of a slice would give.
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
        special = pc.match_substring(texts, "<|")
        at = np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()
        low = pc.ascii_lower(pc.if_else(special, "", texts) if at else texts)
        if len(low) == 1 and low.nbytes > RUN_BYTES:
            found = [self._of_texts(pa.array([x], pa.large_string()))[0] for x in _segments(low[0].as_buffer().to_pybytes())]
            ids = np.concatenate(found)
            bounds = np.array([0, len(ids)])
        else:
            ids, bounds = self._of_texts(low)
        if at:
            each = [ids[a:b] for a, b in pairwise(bounds.tolist())]
            for i in at:
                each[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            ids, bounds = np.concatenate(each), _bounds(np.array([len(x) for x in each]))
        return ids, bounds


def _segments(text: bytes):
    """A text in segments of about ``RUN_BYTES``, each but the last up to a white space."""
    at = 0
    while at < len(text):
        found = _WHITE.search(text, at + RUN_BYTES)
        stop = found.end() if found else len(text)
        yield text[at:stop]
        at = stop


@cache
def _encoder(path: str) -> ChunkEncoder:
    """One for each worker process, so that what it has learned serves its next tasks."""
    return ChunkEncoder(path)


def _runs(texts: pa.Array):
    """Runs of texts of at most ``RUN_BYTES``, unless a single one is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def _best_fill(left: dict[int, int], order: list[int], first: int, room: int) -> dict[int, int]:
    """The multiset of what is left beside one ``first`` whose sum is the largest within ``room``, by subset sums in a bitset."""
    reach, steps = 1, []
    for n in order[bisect_left(order, -room, key=lambda x: -x) :]:
        have, take = min(left[n] - (n == first), room // n), 1
        while have > 0:
            take = min(take, have)
            steps.append((n, take, reach))
            reach |= reach << (n * take)
            have -= take
            take *= 2
        if reach >> room & 1:
            break
    total = (reach & ((1 << (room + 1)) - 1)).bit_length() - 1
    fill: dict[int, int] = {}
    for n, take, before in reversed(steps):  # back through the bitsets: what could be done without is left out
        if not before >> total & 1:
            fill[n] = fill.get(n, 0) + take
            total -= n * take
    return fill


def _pair(left: dict[int, int], there: int, mirror: int, capacity: int, room: int, used: dict[int, int]) -> dict[int, int] | None:
    """Two lengths that sum to ``room``, beside ``used``, from the bitset of lengths and its mirror image."""
    both = there & (mirror >> (capacity - room)) & ((1 << room) - 1)
    while both:
        a = both.bit_length() - 1
        b = room - a
        if a < b:
            return None
        spare = lambda n: left[n] - used.get(n, 0)
        if spare(a) >= 2 if a == b else spare(a) >= 1 and spare(b) >= 1:
            return {a: 2} if a == b else {a: 1, b: 1}
        both ^= 1 << a
    return None


def _exact_fill(left: dict[int, int], order: list[int], there: int, mirror: int, capacity: int, first: int, room: int) -> dict[int, int] | None:
    """At most three lengths that fill ``room`` to the last, the longest first."""
    if room == 0:
        return {}
    if left.get(room, 0) - (room == first) >= 1:
        return {room: 1}
    if fill := _pair(left, there, mirror, capacity, room, {first: 1}):
        return fill
    for n in order[bisect_left(order, -room, key=lambda x: -x) :]:
        if 3 * n < room:
            return None
        used = {first: 1}
        used[n] = used.get(n, 0) + 1
        if left[n] >= used[n] and (fill := _pair(left, there, mirror, capacity, room - n, used)):
            fill[n] = fill.get(n, 0) + 1
            return fill
    return None


def fill_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (times, {length: pieces}), by minimum bin slack; all pieces are used up.

    The longest length left opens each window.  Up to three lengths that fill it exactly
    are found from the bitset of lengths and its mirror image; else subset sums of all
    that is left decide.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left, reverse=True)
    there = sum(1 << n for n in left)
    mirror = sum(1 << (capacity - n) for n in left)
    plan = []
    while order:
        first = order[0]
        room = capacity - first
        fill = _exact_fill(left, order, there, mirror, capacity, first, room)
        if fill is None:
            fill = _best_fill(left, order, first, room)
        pattern = {first: 1}
        for n, c in fill.items():
            pattern[n] = pattern.get(n, 0) + c
        times = min(left[n] // c for n, c in pattern.items())
        plan.append((times, pattern))
        for n, c in pattern.items():
            left[n] -= times * c
            if not left[n]:
                there ^= 1 << n
                mirror ^= 1 << (capacity - n)
        order = [n for n in order if left[n]]
    return plan


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches):
        encode = _encoder(path)
        task = TaskContext.get().partitionId()
        numbers: dict[int, int] = {}
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, out = [], []
            for i, ids_of_text in enumerate(found[a:b] for found, bounds in map(encode, _runs(texts)) for a, b in pairwise(bounds.tolist())):
                tokens = ids_of_text.astype("<u4", copy=False).tobytes() + end
                n = len(tokens) // 4
                for start in range(0, n, capacity):
                    size = min(capacity, n - start)
                    piece = tokens[4 * start : 4 * (start + size)]
                    number = numbers.get(size, 0)
                    numbers[size] = number + 1
                    at.append(i)
                    out.append((start, size, zlib.crc32(piece), n, task, number, piece if with_ids else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            types = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], names=["id", "start", "length", "ids_crc32", "doc_tokens", "task", "number", "ids"])
            del out, cols, texts
            release()

    return run


def _placed(lengths, froms, bases, pers, offsets):
    """Looks the runs of a plan up: piece ``k`` of a length is in the run that begins last before it."""
    shift = np.int64(1) << np.int64(48)

    def run(batches):
        keys = lengths * shift + froms
        for batch in batches:
            n = batch.column("length").to_numpy()
            k = batch.column("k").to_numpy()
            r = np.searchsorted(keys, n * shift + k, side="right") - 1
            j, s = np.divmod(k - froms[r], pers[r])
            names = [c for c in batch.schema.names if c != "k"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(bases[r] + j), pa.array(offsets[r] + s * n)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs every document's tokens, with ``end_id`` after each, into sequences of at most ``capacity``.

    Returns a row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and, with ``with_ids``, ``ids`` (little-endian unsigned 32-bit).  Full windows
    of a document are sequences of their own; its rest shares one.  A null or empty text
    is its ``end_id`` alone.  Repeated rows and null ids are packed like any other; other
    columns are ignored; an empty table gives an empty result.
    """
    id_type = docs.select(id_col).schema[0].dataType
    out = T.StructType([T.StructField("id", id_type), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")], T.StructField("task", T.IntegerType()), T.StructField("number", T.LongType()), T.StructField("ids", T.BinaryType())])
    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_pieces(tokenizer_path, end_id, capacity, with_ids), out)
    pieces = materialise(pieces if with_ids else pieces.drop("ids"), "pieces")
    tally = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # At most one row per length.
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, used, sequences = [], {}, 0
    for times, pattern in fill_plan(counts, capacity):
        offset = 0
        for n, c in pattern.items():
            runs.append((n, used.get(n, 0), sequences, c, offset))
            used[n] = used.get(n, 0) + times * c
            offset += n * c
        sequences += times
    arrays = [np.array(x, dtype=np.int64) for x in (zip(*sorted(runs), strict=True) if runs else [[]] * 5)]
    numbered = pieces.join(tally.select("task", "length", "base"), ["task", "length"]).withColumn("k", F.col("base") + F.col("number")).drop("task", "number", "base")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    schema = T.StructType([*[out[c] for c in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = numbered.select(*names, "k").mapInArrow(_placed(*arrays), schema)
    return placed.withColumnRenamed("id", id_col)
