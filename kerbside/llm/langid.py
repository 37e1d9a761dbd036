"""Language ID by hierarchical discrimination.

Features are relative frequencies of byte 1-, 2- and 3-grams of the text in lower case (A-Z), hashed to DIMS. A family is
predicted first, by linear machines one against the rest; within it, linear support vector machines, one against one,
vote between its languages. Languages outside FAMILIES form one family more. A text's score for a family or a pair is the
mean of a weight over its grams, so predicting is one table lookup for each gram and machine.

Scale: fitted on a bounded sample: PER_LANGUAGE labelled rows of each language, those with the least hash of doc_id and text. Hashes
travel first (a group limit within tasks keeps that small); only the texts under each language's bound are shuffled, whole, and
reduced to DIMS counts before they leave the executors. Predicting
is a scan without a shuffle, whole texts, every row. The weights are a few tables of DIMS floats.

Defined cases: null text, or one without a letter: `und`, score 0; a language with labels but no text with letters is not
learned; no labelled rows: every text is `und`; one language only: it is predicted with score 1; ties: the alphabetically
first; repeated rows are judged alike; a null doc_id is in training; other columns are kept, but
input columns lang_pred or score give way to those that are added; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .words import utf8

#: Families of closely related languages.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
OTHER = "other"
DIMS = 4096
PER_LANGUAGE = 300
STEPS, LAMBDA = 200, 1e-4
#: Margins are scaled by this for scores.
SLOPE = 4.0
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), OTHER)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_codes(data: np.ndarray) -> list[np.ndarray]:
    """For n = 1, 2, 3 the hashed code of the n bytes from each place on."""
    b = _LOWER[data]
    two = (b[:-1] << 8) | b[1:] if len(b) > 1 else b[:0]
    three = (two[:-1] << 8) | b[2:] if len(b) > 2 else b[:0]
    spread = lambda x, m: ((x * np.uint32(m)) >> np.uint32(20)) & np.uint32(DIMS - 1)
    return [spread(b + np.uint32(1), 2654435761), spread(two + np.uint32(1 << 20), 2246822519), spread(three + np.uint32(1 << 25), 3266489917)]


def counts(text: bytes) -> np.ndarray:
    return sum(np.bincount(c, minlength=DIMS) for c in gram_codes(np.frombuffer(text, np.uint8))).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def sample(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and relative frequencies of the training rows: at most PER_LANGUAGE of each language."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    first = lambda df: df.withColumn("r", rank).where(F.col("r") <= PER_LANGUAGE)
    bounds = first(labelled.select("lang", "h")).groupBy("lang").agg(F.max("h").alias("bound"))  # hashes travel, not texts
    # A row for each language is broadcast; the model that every task gets holds a vector of weights for each pair of them.
    chosen = first(labelled.join(F.broadcast(bounds), "lang").where("h <= bound")).select("lang", "text")

    def reduce(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(lang, counts(t.encode()).astype(np.float32).tobytes()) for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if has_letter(t)]
            if rows:
                yield common.record_batch(pa.schema([("lang", pa.string()), ("counts", pa.binary())]), rows)

    got = chosen.mapInArrow(reduce, "lang string, counts binary").toArrow().sort_by([("lang", "ascending"), ("counts", "ascending")])
    x = np.stack([np.frombuffer(c.as_py(), np.float32) for c in got.column("counts")]) if got.num_rows else np.zeros((0, DIMS), np.float32)
    return got.column("lang").to_pylist(), x / np.maximum(x.sum(1, keepdims=True), 1)


def linear_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias that separate y = 1 from y = -1: accelerated gradient steps on the squared hinge loss, both sides
    weighted alike."""
    x = np.hstack([x, np.full((len(x), 1), 0.1)]).astype(np.float32)
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = np.float32(1 / (2 * float((weight * (x * x).sum(1)).sum()) + LAMBDA))
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (np.float32(LAMBDA) * v - 2 * ((weight * y * slack) @ x))
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return np.append(w[:-1], w[-1] * np.float32(0.1))


class Model:
    """families: name -> languages; machines: (kind, a, b) -> weights and bias."""

    def __init__(self, langs: list[str], x: np.ndarray) -> None:
        scale = x.std(0) + 1e-4 if len(x) else np.ones(DIMS)
        x = x / scale
        # A gram's weights act on its share of the text; x has three shares, one for each n, of a third each.
        norm = float(np.sqrt((x * x).sum(1).mean())) if len(x) else 1.0
        x = (x / norm).astype(np.float32)
        own = np.array(langs)
        self.languages: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.languages.setdefault(family(lang), []).append(lang)
        fam = np.array([family(v) for v in langs])
        self.names: list[tuple[str, str, str]] = []
        rows = []
        if len(self.languages) > 1:
            for f in sorted(self.languages):
                self.names.append(("family", f, ""))
                rows.append(linear_svm(x, np.where(fam == f, 1, -1)))
        for members in self.languages.values():
            for a, b in combinations(members, 2):
                pick = (own == a) | (own == b)
                self.names.append(("pair", a, b))
                rows.append(linear_svm(x[pick], np.where(own[pick] == a, 1, -1)))
        table = np.array(rows).reshape(len(rows), DIMS + 1)
        self.weights = (table[:, :-1] / (scale * norm)).astype(np.float32)
        self.bias = table[:, -1]

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """texts x machines: the mean weight over a text's grams, plus the bias."""
        n_texts = len(bounds) - 1
        out = np.zeros((n_texts, len(self.names)))
        codes = gram_codes(data)
        n = np.diff(bounds)
        total = np.maximum(n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0), 1)
        for k, code in enumerate(codes):
            ends = np.maximum(bounds[1:] - k, bounds[:-1])  # grams that lie within a text
            for m, w in enumerate(self.weights):
                sums = np.concatenate(([0.0], np.cumsum(w[code], dtype=np.float64)))
                last = np.minimum(ends, len(code))
                out[:, m] += np.where(last > np.minimum(bounds[:-1], len(code)), sums[last] - sums[np.minimum(bounds[:-1], len(code))], 0)
        return out / total[:, None] + self.bias

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        chance = 1 / (1 + np.exp(-SLOPE * np.clip(margins, -50, 50)))
        fams = sorted(self.languages)
        fam, score = fams[0], 1.0
        at = {n: i for i, n in enumerate(self.names)}
        if len(fams) > 1:
            marks = [margins[at["family", f, ""]] for f in fams]
            fam = fams[int(np.argmax(marks))]
            chances = np.array([chance[at["family", f, ""]] for f in fams])
            score = float(chances.max() / max(chances.sum(), 1e-12))
        members = self.languages[fam]
        votes = dict.fromkeys(members, 0.0)
        wins = dict.fromkeys(members, 0)
        for a, b in combinations(members, 2):
            p = float(chance[at["pair", a, b]])
            votes[a] += p
            votes[b] += 1 - p
            wins[a if p >= 0.5 else b] += 1
        lang = max(members, key=lambda v: (wins[v], votes[v], -members.index(v)))
        return lang, score * (votes[lang] / (len(members) - 1) if len(members) > 1 else 1.0)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, from text alone."""
    docs = common.without(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, columns = docs.columns.index("text"), docs.columns

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for part in parts:
            texts = part.column(at)
            langs, scores = [], []
            step = 500
            for low in range(0, len(texts), step):
                some = texts.slice(low, step)
                margins = model.margins(*utf8(some)) if model.languages else np.zeros((len(some), 0))
                for text, row in zip(some.to_pylist(), margins, strict=True):
                    lang, score = model.decide(row) if model.languages and has_letter(text) else (UNKNOWN, 0.0)
                    langs.append(lang)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    return docs.mapInArrow(predict, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string", "score double"]))


def identify(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Fits on labelled (docs, if not given) and predicts every row of docs."""
    common.prepare(docs.sparkSession)
    return predicted(docs, Model(*sample(docs if labelled is None else labelled)))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), docs)
    return out.select("doc_id", "held_out", "lang_pred", "score")
