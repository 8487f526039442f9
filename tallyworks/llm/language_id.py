"""Language identification in two steps: the family, then linear SVMs between its languages.

Features of a text are hashed byte trigrams of its lower-case letters (every run of other characters
is one blank), as square roots of relative counts, so a text of any length has length one.  One linear
support vector machine a family, one against the rest, picks the family; inside it a machine for each
pair of languages votes, ties going to the larger summed margin.  ``score`` is the product of the
logistic of the family's margin and of the mean logistic of the winner's duels.

The machines learn from at most SAMPLE labelled rows, an equal share a language, chosen by a hash of
the id: a bound that doesn't grow with the table.  Features are made by tasks; the driver gets them
as packed vectors and fits by dual coordinate descent in numpy.

Defined cases: null text and text without a letter are ``und`` with score 0; rows with null labels or
without doc_id are not learned; of more labels than SAMPLE the rarest have no row among those that are
learned; with no labelled row every text is ``und``; one label alone is predicted everywhere with score
1; very long texts are read whole, in pieces; other columns, whatever their names, are ignored by the
query and come through the stage as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

#: Labelled rows from which the machines learn, over all languages.
SAMPLE = 4_000
#: Hash buckets of trigrams.
BUCKETS = 4096
#: Bytes of text that are featurised at once.
CHUNK = 1 << 21
#: Rejected by the pipeline's stage below this score.
LEAST_SCORE = 0.2

# Families of ISO 639-1 codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}


def family(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), f"only {lang}")


def letters(text: str = "text") -> Column:
    """Lower-case letters of a text, other runs as one blank; empty if there is no letter."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+", " "))


def features(texts: list[bytes]) -> np.ndarray:
    """Rows of BUCKETS features; zero for an empty text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, raw in enumerate(texts):
        if not raw:
            continue
        count = np.zeros(BUCKETS, np.int64)
        data = np.frombuffer(b" " + raw + b" ", np.uint8)
        for at in range(0, len(data) - 2, CHUNK):
            b = data[at : at + CHUNK + 2].astype(np.uint32)
            h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(8)
            count += np.bincount((h ^ (h >> np.uint32(12))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        out[i] = np.sqrt(count / max(1, count.sum()))
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent; y is +1 or -1, the last column of x is the bias; ``rows`` of x are learned (they aren't copied), y has one for each."""
    rows = np.arange(len(x)) if rows is None else rows
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    diag, square = 1 / (2 * cost * weight), np.einsum("ij,ij->i", x, x)[rows]
    w, alpha, rng = np.zeros(x.shape[1], np.float32), np.zeros(len(rows)), np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * float(w @ x[rows[i]]) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / (square[i] + diag[i]))
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[rows[i]]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def svms(x: np.ndarray, signs: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """``svm`` of each column of ``signs`` (+1 or -1 a row of x): they learn together, so a row is read once a round for all."""
    yes = (signs > 0).sum(axis=0)
    weight = np.where(signs > 0, len(x) / (2 * np.maximum(1, yes)), len(x) / (2 * np.maximum(1, len(x) - yes)))
    diag, square = 1 / (2 * cost * weight), np.einsum("ij,ij->i", x, x)
    w, alpha, rng = np.zeros((signs.shape[1], x.shape[1]), np.float32), np.zeros(signs.shape), np.random.default_rng(0)
    open_ = np.arange(signs.shape[1])
    own = w.copy()
    for _ in range(rounds):
        moved = np.zeros(len(open_))
        for i in rng.permutation(len(x)):
            gradient = signs[i, open_] * (own @ x[i]).astype(np.float64) - 1 + diag[i, open_] * alpha[i, open_]
            new = np.maximum(0.0, alpha[i, open_] - gradient / (square[i] + diag[i, open_]))
            step = new - alpha[i, open_]
            on = np.flatnonzero(step)
            if len(on):
                own[on] += ((step * signs[i, open_])[on].astype(np.float32))[:, None] * x[i]
                np.maximum(moved, np.abs(step), out=moved)
                alpha[i, open_] = new
        w[open_] = own
        open_ = open_[moved >= 1e-3]
        if not len(open_):
            break
        own = w[open_]
    return w


class Model:
    """Family machines over duels of languages."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        self.families = sorted({family(v) for v in self.langs})
        own = np.array([family(v) for v in lang.tolist()])
        self.top = svms(x, np.where(own[:, None] == np.array(self.families)[None, :], 1, -1)) if len(self.families) > 1 else None
        self.duels = {}
        for f in self.families:
            for a, b in itertools.combinations([v for v in self.langs if family(v) == f], 2):
                use = np.flatnonzero((lang == a) | (lang == b))
                self.duels[a, b] = svm(x, np.where(lang[use] == a, 1, -1), rows=use)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each row."""
        n = len(x)
        x = np.hstack([x, np.ones((n, 1), np.float32)])
        sigmoid = lambda m: 1 / (1 + np.exp(-3 * m))
        margin = x @ self.top.T if self.top is not None else np.full((n, 1), 30.0)
        best = margin.argmax(axis=1)
        lang, score = np.empty(n, object), np.zeros(n)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            if not len(rows):
                continue
            own = [v for v in self.langs if family(v) == f]
            votes, sums, sure = (np.zeros((len(rows), len(own))) for _ in range(3))
            for (a, b), w in ((d, w) for d, w in self.duels.items() if family(d[0]) == f):
                m, i, j = x[rows] @ w, own.index(a), own.index(b)
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                sums[:, i] += m
                sums[:, j] -= m
                sure[:, i] += sigmoid(m)
                sure[:, j] += sigmoid(-m)
            pick = (votes + 1e-3 * np.tanh(sums)).argmax(axis=1)
            lang[rows] = np.array(own, object)[pick]
            duel = sure[np.arange(len(rows)), pick] / max(1, len(own) - 1) if len(own) > 1 else 1.0
            score[rows] = sigmoid(margin[rows, k]) * duel
        return lang, np.clip(score, 0, 1)


def _texts(column: pa.Array) -> list[bytes]:
    return [v.as_buffer().to_pybytes() if v.is_valid else b"" for v in column.cast(pa.binary())]


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model | None:
    """Learns from rows where ``learn`` holds and lang isn't null; None if there is none."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"))
    counts = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()]  # a row each at least
    if not counts:
        return None
    share = max(1, sample // len(counts))
    # The first of each language by hash.  What can't be among them goes before they are ranked, so no task ranks a language's rows.
    limits = [(lang, min(1.0, (1.3 * share + 50) / n)) for lang, n in counts]
    rank = F.xxhash64("doc_id", F.lit(1))
    near = rows.join(F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, part double")), "lang").withColumn("rank", rank).filter(F.pmod("rank", F.lit(1_000_000)) <= F.col("part") * 1_000_000)
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("rank", F.lit(1_000_000)), "rank", "doc_id"))
    picked = near.withColumn("k", order).filter(F.col("k") <= share).select(F.col("doc_id").alias("id_"), F.col("lang").alias("lang_")).distinct()
    texts = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text")).join(F.broadcast(picked), (F.col("doc_id") == F.col("id_")) & (F.col("lang") == F.col("lang_")), "left_semi")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = _texts(part.column(0))
                keep = [i for i, t in enumerate(texts) if t]
                x = features([texts[i] for i in keep]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(keep, pa.int64())), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = texts.select(letters().alias("l"), "lang").mapInArrow(pack, "lang string, x binary").orderBy("lang", F.xxhash64("x")).toArrow()  # about SAMPLE rows
    if not len(got):
        return None
    # One array, filled row by row, with the bias in its last column: the driver holds no second copy while it fits.
    x, lang = np.ones((len(got), BUCKETS + 1), np.float32), np.array(got.column("lang").to_pylist(), object)
    at = 0
    for chunk in got.column("x").chunks:
        for packed in chunk:
            x[at, :-1] = np.frombuffer(packed.as_buffer(), np.float16)
            at += 1
    del got
    return Model(x, lang)


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = _texts(part.column(1))
                lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                known = np.array([bool(t) for t in texts])
                if held.value is not None and known.any():
                    lang[known], score[known] = held.value.predict(features([t for t in texts if t]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), letters().alias("l")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1(docs: DataFrame) -> DataFrame:
    held = held_out(1, 3)
    out = predicted(docs, fit(docs, ~held))
    return out.select("doc_id", held_out(1, 3).alias("held_out"), "lang_pred", "score")


def stage(docs: DataFrame) -> DataFrame:
    """Rows whose language is known: not ``und`` and a score of LEAST_SCORE at least; rows without doc_id stay."""
    from .common import without, written

    out = predicted(docs, fit(docs, ~held_out(1, 3)))
    bad = out.filter(F.col("doc_id").isNotNull() & ((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)))
    return without(docs, written(bad.select("doc_id").distinct(), "rejected"))
