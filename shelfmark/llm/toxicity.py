"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding makes disguises plain: compatibility forms, accents and invisible characters go, look-alike letters of
other alphabets become Latin ones, and digits and signs inside a word become the letters they stand for.

The lexicon is learned from a bounded sample of labelled texts: whole words and beginnings of words that toxic
texts hold far more often than others. An entry's weight is its log-odds less a margin for chance. A
text's strength is the sum of weights (of entries that begin at the same place the longest counts, and nothing counts inside
an exception phrase), divided by what chance hits come to in a clean text of its length: a floor for short texts, the expected sum, and
some standard deviations. So the strength of clean texts has a bound that no length passes. One logistic step, fitted
on the same sample, turns the strength into a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 16_000  # labelled texts that the model is fitted on, about, at most
STEMS = (4, 5, 6, 7, 8)  # lengths of word beginnings that are entries of their own
LONGEST = 24  # letters of an entry
MIN_TEXTS = 4  # toxic texts that an entry must stand in
MIN_ODDS = 2.0  # log-odds of an entry after the margin
MARGIN = 1.5  # standard errors
MAX_ENTRIES = 20_000
COUNTED = 1 << 19  # features that a task holds before it passes their counts on
THRESHOLD = 0.7
FLOOR = 4.0  # sum of weights that any text is allowed, about that of one entry
DEVIATIONS = 3.0  # standard deviations of the sum of chance hits that a text is allowed
PRIOR_SIZE = 100_000  # characters' worth of CHANCE in what is learned about chance hits

# Phrases in which a lexicon word does no harm.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "clown car", "sore loser", "pathetic fallacy", "stupid question",
    "pond scum", "soap scum",
)

# Letters of other alphabets that look like Latin ones; signs that stand for letters.
_LOOKALIKES = dict(zip("аеорсухѕіјԁӏκυοανρτιΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХ", "aeopcyxsijdlkuoavptiABEZHIKMNOPTYXABEKMHOPCTX", strict=True))
_SUBSTITUTES = str.maketrans("013457@$!8", "oieastasib")
_HIDDEN = [0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x0300, 0x0370)]

_LETTERS = {ord(k): v for k, v in _LOOKALIKES.items()} | dict.fromkeys(_HIDDEN)
_SIGN = re.compile(r"[0-9@$!]")
_SIGNED = re.compile(r"(?<![\w@$!])(?=[\w@$!]*[0-9@$!])[\w@$](?:[\w@$!]*\w)?")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[\W\d_]+")


def _plain(found: re.Match) -> str:
    return found[0].translate(_SUBSTITUTES) if _LETTER.search(found[0]) else found[0]


def fold(text: str) -> str:
    """A text in lower case with its disguises undone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_LETTERS)
    text = text.lower()
    return _SIGNED.sub(_plain, text) if _SIGN.search(text) else text


def features(folded: str) -> set[str]:
    """Words ("idiot ") and beginnings ("idio*")."""
    words = {w for w in _WORD.findall(folded) if 3 <= len(w) <= LONGEST}
    return {w + " " for w in words} | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


@dataclass(frozen=True)
class Chance:
    """Sum of chance hits' weights in clean texts: mean and variance per character."""

    rate: float
    spread: float

    def allowed(self, size: float) -> float:
        return FLOOR + self.rate * size + DEVIATIONS * math.sqrt(self.spread * size)


CHANCE = Chance(5e-5, 2e-4)  # before labels say more


@dataclass
class Model:
    """``entries``: " idiot " is a word, " idio" a beginning."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    offset: float = -4.0
    chance: Chance = CHANCE
    key: str = field(default_factory=lambda: uuid4().hex)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.entries:
            return None
        machine = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        machine.make_automaton()
        return machine


def weighed(folded: str, machine: ahocorasick.Automaton | None) -> tuple[float, int]:
    """Sum of the weights of a text's hits, and its length in characters."""
    plain = " " + _BREAK.sub(" ", folded) + " "
    if machine is None:
        return 0.0, len(plain)
    best: dict[int, tuple[int, float]] = {}
    free: list[tuple[int, int]] = []
    for end, (length, weight) in machine.iter(plain):
        start = end - length + 1
        if weight is None:
            free.append((start, end))
        elif length > best.get(start, (0, 0.0))[0]:
            best[start] = (length, weight)
    # Exception phrases as spans that do not touch, in order.
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(free):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def excepted(at: int) -> bool:
        span = bisect_right(starts, at) - 1
        return span >= 0 and at < ends[span]

    return float(sum(weight for at, (_, weight) in best.items() if not excepted(at))), len(plain)


def strength(folded: str, machine: ahocorasick.Automaton | None, chance: Chance = CHANCE) -> float:
    total, size = weighed(folded, machine)
    return total / chance.allowed(size)


def chance_hits(totals: np.ndarray, sizes: np.ndarray) -> Chance:
    """From clean texts' sums and lengths."""
    whole = sizes.sum() + PRIOR_SIZE
    rate = (totals.sum() + CHANCE.rate * PRIOR_SIZE) / whole
    return Chance(float(rate), float((((totals - rate * sizes) ** 2).sum() + CHANCE.spread * PRIOR_SIZE) / whole))


def lexicon(counts: list[tuple[str, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Entries and weights from (feature, toxic texts, other texts)."""
    found = {}
    for feature, p, n in counts:
        odds = math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (other + 1))
        odds -= MARGIN * math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        if odds >= MIN_ODDS:
            found[feature] = odds
    entries = {}
    for feature, odds in found.items():
        stem, word = feature[:-1], feature.endswith(" ")
        shorter = [stem[:n] + "*" for n in STEMS if n < len(stem) or (word and n == len(stem))]
        if max((found.get(s, 0.0) for s in shorter), default=0.0) < odds - 0.5:  # else the beginning says as much
            entries[" " + (feature if word else stem)] = odds
    return entries


def logistic(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a light ridge; both classes weigh the same."""
    if not labels.any() or labels.all():
        return 1.0, -4.0
    weights = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum()) * len(labels)
    x = np.stack([values, np.ones_like(values)])
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        hessian = (x * (weights * p * (1 - p) + 1e-9)) @ x.T + ridge
        step = np.linalg.solve(hessian, x @ (weights * (p - labels)) + ridge @ beta)
        step *= min(1.0, 2.0 / abs(step).max()) if step.any() else 1.0
        beta = beta - step
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}

    def summed() -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.string())] + [pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1)]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, ["feature", "p", "n"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for feature in features(fold(text or "")):
                counts.setdefault(feature, [0, 0])[0 if label else 1] += 1
        if len(counts) >= COUNTED:
            yield summed()
    yield summed()


_MACHINES: dict[str, ahocorasick.Automaton | None] = {}


def _sums(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    model = sent.value
    if model.key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[model.key] = model.automaton()
    machine = _MACHINES[model.key]
    for batch in batches:
        values = [weighed(fold(text or ""), machine) for text in batch.column(1).to_pylist()]
        totals, sizes = pa.array([v[0] for v in values], pa.float64()), pa.array([v[1] for v in values], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), totals, sizes], ["id", "total", "size"])


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (id, text) to (id, total, size)."""
    fields = [T.StructField("id", rows.schema["id"].dataType), T.StructField("total", T.DoubleType()), T.StructField("size", T.LongType())]
    schema = T.StructType(fields)
    return rows.mapInArrow(partial(_sums, sent=rows.sparkSession.sparkContext.broadcast(model)), schema)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn lexicon and calibration from labelled rows; ``usable`` says which ids may be used.

    Rows with a NULL id or label are left out, an id counts once (with its largest label). Of more than ``sample`` labelled
    ids about so many are taken, by a hash of the id; only these, a bounded table, are broadcast to the
    scan of the texts. Without toxic rows, or without others, the model scores every text low.
    """
    rows = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).dropna()
    if usable is not None:
        rows = rows.filter(usable)
    rows = rows.groupBy("id").agg(F.max("label").alias("label"))
    share = min(1.0, sample / max(1, rows.count()))
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    known = texts.join(F.broadcast(chosen), "id").select("text", "label")
    sizes = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    summed = known.mapInArrow(_counts, "feature string, p bigint, n bigint").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    telling = summed.filter((F.col("p") >= MIN_TEXTS) & (F.col("p") * (other + 1) > 4 * (F.col("n") + 0.5) * (toxic + 1)))
    top = telling.orderBy(F.desc("p"), "feature").limit(MAX_ENTRIES).collect()
    model = Model(lexicon([(r.feature, r.p, r.n) for r in top], toxic, other))
    measured = _scored(known.select(F.col("label").alias("id"), "text"), model).collect()
    if measured:
        totals, sizes, marks = (np.array([r[name] for r in measured], dtype=float) for name in ("total", "size", "id"))
        model.chance = chance_hits(totals[marks == 0], sizes[marks == 0])
        values = totals / np.array([model.chance.allowed(size) for size in sizes])
        model.slope, model.offset = logistic(values, marks)
    return model


def toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on).

    NULL and empty texts hold no entry and get the score of a text without any. Whole texts are read; repeated rows get the
    same score, NULL ids are rows like others, other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    size = F.col("size")
    allowed = FLOOR + model.chance.rate * size + DEVIATIONS * F.sqrt(model.chance.spread * size)
    chance = 1 / (1 + F.exp(-(F.col("total") / allowed * model.slope + model.offset)))
    scored = _scored(rows, model).select(F.col("id").alias(id_column), chance.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
