"""Language ID by hierarchical discrimination.

A document's family is predicted first, then one-versus-one linear support vector machines separate
the languages within it.  Features are hashed character 1- to 3-grams of the letters of the whole
text, as square roots of relative frequencies, so length cancels out.  The machines are trained on
the driver, by dual coordinate descent, from a bounded sample of labelled rows; prediction is one
pass over Arrow batches with no shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Families of ISO 639-1 codes.  Labels that aren't here share families of GROUP labels, in order.
FAMILIES = {
    "ca": "romance", "es": "romance", "fr": "romance", "gl": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "af": "germanic", "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "bg": "slavic", "cs": "slavic", "hr": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "sl": "slavic", "sr": "slavic", "uk": "slavic",
}
UNKNOWN = "und"
BUCKETS, ORDERS = 2048, 3
GROUP = 8
#: Bounds of the training sample: distinct texts in all and of a label; every label may have MIN_PER_LABEL, however many there are.
MAX_ROWS, MAX_PER_LABEL, MIN_PER_LABEL = 2400, 400, 12
#: Characters handled at a time; n-grams go on across the cuts.
CHUNK = 1 << 20

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """None if the text is null or has no letter."""
    if not text:
        return None
    known, total = _letter_table(), np.zeros(BUCKETS * ORDERS, np.int64)
    low = text.lower()
    seen, carry = False, np.zeros(0, np.uint32)
    for at in range(0, len(low), CHUNK):
        c = np.frombuffer(low[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = known[c]
        seen = seen or bool(letter.any())
        c = np.where(letter, c, 32).astype(np.uint32)
        if not at:
            c = np.concatenate([np.full(1, 32, np.uint32), c])
        before = np.concatenate([carry[-1:] if at else np.zeros(1, np.uint32), c[:-1]])
        c = np.concatenate([carry, c[(c != 32) | (before != 32)]])  # runs of other characters count as one blank
        gram = np.zeros(len(c), np.uint32)
        for k in range(min(ORDERS, len(c))):
            gram = (gram[: len(c) - k] * np.uint32(0x01000193)) ^ (c[k:] * np.uint32(0x9E3779B1))
            bucket = (gram[max(0, len(carry) - k) :] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 11)
            total[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        carry = c[1 - ORDERS :]
    if not seen:
        return None
    x = total.reshape(ORDERS, BUCKETS) / np.maximum(1, total.reshape(ORDERS, BUCKETS).sum(1, keepdims=True))
    return np.sqrt(x / ORDERS).astype(np.float32).ravel()


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 32.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) of a linear machine with squared hinge loss; y holds -1 and 1."""
    pull = len(y) / 2 / np.maximum(1, np.array([(y < 0).sum(), (y > 0).sum()]))
    diag = 1 / (2 * cost * pull[(y > 0).astype(int)])
    # The features stay as they are, in single precision; the bias is a feature that is always 1.
    q, a, rng = np.einsum("ij,ij->i", x, x) + 1.0 + diag, np.zeros(len(x)), np.random.default_rng(seed)
    w, bias = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            step = max(a[i] - (y[i] * (x[i] @ w + bias) - 1 + diag[i] * a[i]) / q[i], 0.0) - a[i]
            if step:
                a[i] += step
                w += step * y[i] * x[i]
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return np.append(w, bias)


@dataclass
class OneVersusOne:
    """Machines for all pairs of classes; votes decide, the sum of margins breaks ties."""

    classes: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    slope: float = 1.0

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> OneVersusOne:
        classes = [str(v) for v in sorted(set(labels))]
        out = cls(classes, np.zeros((0, x.shape[1] + 1)))
        found = []
        for a, b in combinations(classes, 2):
            own = (labels == a) | (labels == b)
            found.append(train_svm(x[own], np.where(labels[own] == a, 1.0, -1.0)))
        if found:
            out.weights = np.array(found)
            near = np.median(np.abs(x @ out.weights[:, :-1].T + out.weights[:, -1]))
            out.slope = 4.0 / max(1e-6, float(near))  # the typical margin means 0.98
        return out

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        votes, sums = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        worst = np.full(len(self.classes), np.inf)
        for (a, b), m in zip(combinations(range(len(self.classes)), 2), self.weights[:, :-1] @ x + self.weights[:, -1], strict=True):
            votes[a if m >= 0 else b] += 1
            sums[a], sums[b] = sums[a] + m, sums[b] - m
            worst[a], worst[b] = min(worst[a], m), min(worst[b], -m)
        best = max(range(len(self.classes)), key=lambda i: (votes[i], sums[i], -i))
        return self.classes[best], 1.0 if np.isinf(worst[best]) else float(1 / (1 + np.exp(-self.slope * worst[best])))


@dataclass
class Model:
    family: OneVersusOne | None = None
    within: dict[str, OneVersusOne] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray, families: dict[str, str] = FAMILIES) -> Model:
        if not len(x):
            return cls()
        others = sorted({v for v in langs if v not in families})
        group = {v: f"others {k // GROUP}" for k, v in enumerate(others)}
        kinds = np.array([families.get(v) or group[v] for v in langs])
        return cls(OneVersusOne.fit(x, kinds), {k: OneVersusOne.fit(x[kinds == k], langs[kinds == k]) for k in sorted(set(kinds))})

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or self.family is None:
            return UNKNOWN, 0.0
        kind, sure = self.family.predict(x)
        lang, surer = self.within[kind].predict(x)
        return lang, sure * surer


def held_out(id_: Column) -> Column:
    """True if crc32 of the id as text is 2 modulo 4.  A null id counts as an empty text (not held out)."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of the distinct labelled texts that aren't held out and have a letter.

    Every label is learned, from at most MAX_PER_LABEL texts, and MAX_ROWS over all labels unless these are
    so many that MIN_PER_LABEL each makes more.  Repeated texts count once; of a label's texts those with the smallest
    hashes are taken.  An empty table, or one without a label, gives a model that knows nothing.
    """
    text = F.col(text_col)
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & text.rlike("\\p{L}"))
    rows = rows.select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not counts:
        return Model()
    most = max(MIN_PER_LABEL, min(MAX_PER_LABEL, MAX_ROWS // len(counts)))
    # A hash threshold leaves some three times as many texts as are wanted before any is moved.
    share = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], min(1.0, (3 * most + 30) / max(1, r["n"])))))
    u = F.shiftrightunsigned("h", 11) / F.lit(2.0**53)
    thin = rows.where(u < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(1.0)))
    thin = thin.groupBy("lang", "h").agg(F.min("text").alias("text"))
    few = thin.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                x = features(text.as_py())
                if x is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([x.tobytes()], pa.binary())], ["lang", "x"])

    got = sorted((r["lang"], bytes(r["x"])) for r in few.select("lang", "text").mapInArrow(run, "lang string, x binary").collect())
    if not got:
        return Model()
    return Model.fit(np.array([np.frombuffer(x, np.float32) for _, x in got]), np.array([v for v, _ in got], dtype=object))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score (0 to 1).

    lang_pred is a learned label, or `und` with score 0 if the text is null or has no letter, or nothing was
    learned.  Only the text enters a prediction.  Whole texts are read, very long ones in chunks with the same result.
    Of families or languages with equally many votes the one with the larger sum of margins wins, then the first by name.
    Repeated rows each get a row; other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    return _predicted(docs.select(F.col(id_col).alias(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text_")), model.predict)


def _predicted(rows: DataFrame, predict: Callable[[str | None], tuple[str, float]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            own = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    schema = rows.select(*rows.columns[:-1], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of docs with a language (not `und`) and a score of at least `least`, with all their columns."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(docs[c].alias(n) for c, n in zip(docs.columns, own, strict=True)), docs[text_col].alias("text_"))
    kept = _predicted(rows, model.predict).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, own, strict=True)))
