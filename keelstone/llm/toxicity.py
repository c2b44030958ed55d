"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text are densities of toxic words (a general list, and words and
stems learned from labelled rows), how near they stand to a second person, capitals,
punctuation, and obfuscation (digits or signs inside words, spelled-out words, and
list words found once these are undone).  Learned words are cross-fitted: the
features of a training row use words learned from the other folds.  Trees are
calibrated by isotonic regression on out-of-fold scores.

Only the classifier is fitted on a bounded sample, ``MAX_TRAINING_ROWS`` labelled rows
in the order of a hash of their ids; every document is scored, over its whole text.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.llm._common import discard, materialise, release
from keelstone.llm.boosting import BoostedTrees, isotonic

#: Labelled rows that the model is fitted on, at most.
MAX_TRAINING_ROWS = 12_000
#: Words and stems that are learned, at most.
MAX_LEARNED = 600
FOLDS = 3
#: Characters between a toxic word and a second-person word that is near.
NEAR = 40

# Insults and abuse in English, German, French and Spanish, and second-person words.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb dumbass loser losers pathetic worthless trash garbage scum clown clowns disgusting imbecile cretin fool fools jerk jerks "
    "bastard bastards bitch asshole shit bullshit fuck fucking fucker crap whore slut retard retarded pig vermin filth freak creep hate kill die ugly "
    "dummkopf trottel arschloch scheisse scheiße hurensohn schlampe wichser vollidiot abschaum versager drecksau mistkerl "
    "connard connasse salaud salope merde putain crétin abruti débile ordure minable enculé "
    "imbécil estúpido estúpida gilipollas mierda puta cabrón pendejo basura escoria asqueroso inútil".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre tú ti tuyo usted ustedes vosotros".split())
_UNDO = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "*": "", "#": "", "-": "", ".": "", "_": "", "|": "l"})
_MIXED = re.compile(r"[^\W\d_]+(?:[0-9@$!*#|]+[^\W\d_]+)+")
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*][^\W\d_]){3,}(?![^\W_])")
_CAPS = re.compile(r"\b[A-Z]{3,}\b")
_SHOUT = re.compile(r"[!?]{2,}")
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_HIGH = bytes(range(128, 256))
_N_FEATURES = 24
_FULL, _STEM, _LIST, _YOU = 1, 2, 4, 8
_SUB = re.compile(r"[^\W_]+")


def _less(raw: bytes, gone: bytes) -> int:
    return len(raw) - len(raw.translate(None, gone))


class Featurizer:
    """Dense features of texts, given learned words and stems with their weights."""

    def __init__(self, learned: dict[str, float]):
        import ahocorasick

        kinds: dict[str, list] = {}
        for w in INSULTS:
            kinds.setdefault(w, [0, 0.0])[0] |= _LIST
        for w in SECOND_PERSON:
            kinds.setdefault(w, [0, 0.0])[0] |= _YOU
        for w, weight in learned.items():
            x = kinds.setdefault(w.rstrip("*"), [0, 0.0])
            x[0] |= _STEM if w.endswith("*") else _FULL
            x[1] = max(x[1], weight)
        self.automaton = ahocorasick.Automaton()
        for w, (kind, weight) in kinds.items():
            self.automaton.add_word(w, (len(w), kind, weight))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[float]:
        raw = text.encode()
        low = text.lower()
        n_words = max(1, len(raw.split()))
        n_bytes = max(1, len(raw))
        full, stems, listed, yous, strongest, weights = 0, 0, 0, [], 0.0, 0.0
        places = []
        length = len(low)
        for end, (size, kind, weight) in self.automaton.iter(low):
            start = end - size + 1
            if start and low[start - 1].isalnum():
                continue
            whole = end + 1 == length or not low[end + 1].isalnum()
            if kind & _YOU and whole:
                yous.append(start)
            hit = False
            if kind & _LIST and whole:
                listed += 1
                hit = True
            if kind & _FULL and whole:
                full += 1
                hit = True
            elif kind & _STEM:
                stems += 1
                hit = True
            if hit:
                places.append(start)
                weights += weight
                strongest = max(strongest, weight)
        near = 0
        if places and yous:
            y = np.array(yous)
            for p in places:
                i = np.searchsorted(y, p)
                near += bool(i < len(y) and y[i] - p <= NEAR or i and p - y[i - 1] <= NEAR)
        mixed = _MIXED.findall(low)
        spelled = _SPELLED.findall(low)
        undone = sum(m.translate(_UNDO) in INSULTS for m in mixed) + sum(_SUB.sub(lambda m: m[0], s).translate(_UNDO).replace(" ", "") in INSULTS for s in spelled)
        upper, bangs, asks = _less(raw, _UPPER), raw.count(b"!"), raw.count(b"?")
        shouts = len(_SHOUT.findall(text)) if bangs + asks > 1 else 0
        caps = len(_CAPS.findall(text)) if upper > 2 else 0
        hits = len(places)
        return [
            np.log1p(n_words), 100 * listed / n_words, np.log1p(listed), 100 * full / n_words, np.log1p(full), 100 * stems / n_words, np.log1p(stems),
            100 * weights / n_words, strongest, np.log1p(hits), 100 * hits / n_words, 100 * len(yous) / n_words, 100 * near / n_words, np.log1p(near),
            upper / n_bytes, caps / n_words, bangs / n_words, asks / n_words, shouts / n_words, _less(raw, _PUNCT) / n_bytes,
            (len(mixed) + len(spelled)) / n_words, np.log1p(undone), _less(raw, _DIGIT) / n_bytes, _less(raw, _HIGH) / n_bytes,
        ]


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learned_terms(rows: DataFrame) -> list[dict]:
    """Words and stems (``word*``) that toxic rows have far more often than others, with counts by fold.

    ``rows`` has ``text, y, fold``.  Counts are of rows.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    terms = F.filter(words, lambda w: (F.length(w) >= 3) & (F.length(w) <= 24))
    stems = F.array_distinct(F.flatten(F.transform(F.lit([4, 5, 6]), lambda n: F.transform(F.filter(terms, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, F.lit(1), n), F.lit("*"))))))
    each = rows.select("y", "fold", F.explode_outer(F.concat(terms, stems)).alias("term")).where("term is not null")
    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), 1).otherwise(0)).alias(f"n{y}_{f}") for f in range(FOLDS) for y in (0, 1)]
    total = [sum(F.col(f"n{y}_{f}") for f in range(FOLDS)) for y in (0, 1)]
    found = each.groupBy("term").agg(*sums).withColumn("n0", total[0]).withColumn("n1", total[1])
    size = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    rate = max(size["p"], 1) / max(size["n"], 1)
    # much more often toxic than rows are, and not by chance
    odds = (F.col("n1") + 0.5) / (F.col("n0") + 0.5) * ((1 - rate) / rate if rate < 1 else 1.0)
    good = found.where((F.col("n1") >= 3) & (odds >= 6))
    best = good.orderBy((F.log(odds) * F.sqrt("n1")).desc(), "term").limit(2 * MAX_LEARNED)
    return [r.asDict() for r in best.collect()]  # bounded


def _weights(terms: list[dict], without: int | None, rate: float) -> dict[str, float]:
    """Learned terms and weights from all folds but one."""
    out = {}
    for t in terms:
        n = [sum(t[f"n{y}_{f}"] for f in range(FOLDS) if f != without) for y in (0, 1)]
        odds = (n[1] + 0.5) / (n[0] + 0.5) * (1 - rate) / rate
        if n[1] >= 2 and odds >= 4 and len(out) < MAX_LEARNED:
            out[t["term"]] = float(np.log(odds))
    # a stem stands for the words and longer stems that begin with it
    stems = {s[:-1] for s in out if s.endswith("*")}
    return {w: v for w, v in out.items() if not any(w.rstrip("*")[:n] in stems for n in (4, 5, 6) if n < len(w.rstrip("*")))}


@cache
def _featurizer(learned: tuple) -> Featurizer:
    return Featurizer(dict(learned))


class ToxicityModel:
    """A fitted model; plain data, so that tasks get it with their code."""

    def __init__(self, trees: BoostedTrees | None, learned: dict[str, float], xs: np.ndarray, ys: np.ndarray, prior: float):
        self.trees, self.learned, self.xs, self.ys, self.prior = trees, tuple(sorted(learned.items())), xs, ys, prior

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        features = _featurizer(self.learned)
        raw = self.trees.raw(np.array([features(t) for t in texts]).reshape(len(texts), _N_FEATURES))
        # the calibrated value, and a little of the raw one to keep apart what it makes equal
        return np.clip(0.998 * np.interp(raw, self.xs, self.ys) + 0.002 / (1 + np.exp(-raw / 4)), 0.0, 1.0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAINING_ROWS) -> ToxicityModel:
    """Fits on labelled documents whose id is not held out, ``max_rows`` of them at most.

    Null labels and labels of no document are left out; of several labels of one id the
    largest counts, and of several texts the smallest.  Without both classes the model gives
    the prior to every text.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(max_rows).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(some), "id")
    # one text an id, so that repeated ids add no rows
    rows = rows.groupBy("id", "y", "fold").agg(F.min("text").alias("text"))
    rows = materialise(rows.select("id", "text", "y", "fold"), "training")
    terms = learned_terms(rows)
    size = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    prior = (size["p"] + 0.5) / (size["n"] + 2)
    if not 0 < size["p"] < size["n"]:
        discard(rows)
        return ToxicityModel(None, {}, np.empty(0), np.empty(0), prior)
    rate = size["p"] / size["n"]
    lexicons = [tuple(sorted(_weights(terms, f, rate).items())) for f in range(FOLDS)]

    def features(batches):
        for batch in batches:
            f = [_featurizer(lexicons[k])(t) for k, t in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("fold"), pa.array(f, pa.list_(pa.float64()))], names=["id", "y", "fold", "x"])

    schema = T.StructType([rows.schema["id"], rows.schema["y"], rows.schema["fold"], T.StructField("x", T.ArrayType(T.DoubleType()))])
    table = rows.mapInArrow(features, schema).orderBy("id").toArrow()  # at most max_rows rows of 24 numbers
    discard(rows)
    x = np.array(table["x"].to_pylist(), dtype=np.float64)
    y, fold = table["y"].to_numpy().astype(np.float64), table["fold"].to_numpy()
    # a leaf may be as small as a quarter of the rarer class, so few labels still split
    least = int(max(2, min(8, min(y.sum(), len(y) - y.sum()) // 4)))
    trees = lambda: BoostedTrees(rounds=60, least=least, penalty=least / 8)
    out = np.zeros(len(y))
    for f in range(FOLDS):
        own = fold == f
        if own.any():
            rest = ~own if 0 < y[~own].sum() < (~own).sum() else np.ones(len(y), bool)
            out[own] = trees().fit(x[rest], y[rest]).raw(x[own])
    xs, ys = isotonic(out, y)
    return ToxicityModel(trees().fit(x, y), _weights(terms, None, rate), xs, ys, prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score_col``, the probability that a text is toxic.

    Null texts are scored as empty ones.  Repeated rows stay; a column of that name in
    ``docs`` is replaced; an empty table is fine.
    """
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() != score_col.lower()]
    rest = [c for c in own if c != text_col]

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*([batch.column("row")] if rest else []), *([batch.column("text")] if text_col in own else []), pa.array(model.scores(texts), pa.float64())], names=names)
            del texts
            release()

    row = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")] if rest else []
    rows = docs.select(*row, F.col(text_col).alias("text"))
    names = [*(["row"] if rest else []), *(["text"] if text_col in own else []), "score"]
    schema = T.StructType([*[rows.schema[n] for n in names[:-1]], T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(run, schema)
    return out.select(*[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in own], F.col("score").alias(score_col))
