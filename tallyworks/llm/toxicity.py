"""Toxicity by a convolutional text classifier, trained in numpy.

Words are lower-case runs of letters.  A word's embedding is the sum of hashed embeddings of the word
itself and of its beginnings (PREFIXES letters), so forms of one stem share what is learned.  Filters of
several widths slide over the whole text, each filter's greatest value over all places is kept (max
pooling), and a logistic layer turns these into a score.

Training reads whole texts of all labelled rows, dealt by a hash of the id over parts that don't grow with
the table.  Counts of pieces by label, over all parts, set where embeddings start.  In each of ROUNDS jobs
every part takes mini-batch Adam steps from the same weights, and the weights that it moved are averaged
over the parts that moved them, by their rows.  A fifth of the rows, by the hash, is set aside: all of it
chooses the round, sets the scale of the scores (a logistic fit) and a threshold for each language.  The
driver holds weights and sums, never rows; sums are of integers, so reruns agree.

Each distinct word of a task, or of a training step, is projected on all filter slices once and kept
(CACHE words at most in a task, then the table starts anew); a filter of width w is then a sum of w
looked-up numbers.  Texts are pooled in pieces of CHUNK words.

Defined cases: null, empty and letterless texts get the score of a text without words; rows without a
label or doc_id aren't learned; with one label only every score is near 0 or 1; very long texts are
learned and scored whole, in pieces that overlap by a filter; a null language has a threshold of its own, and
one that wasn't learned has CUT; repeated rows count as often as they come; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, held_out, written

#: Labelled rows and letters of a part, about; there are as many parts as all rows need.
PART_ROWS, PART_LETTERS = 4_000, 16_000_000
#: Hash buckets of pieces of words, numbers of an embedding, widths of filters and filters a width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
#: Letters of the beginnings that are embedded besides the word.
PREFIXES = (4, 5, 6, 7)
#: Score from which the query predicts label 1.
CUT = 0.3
#: Words pooled at once, and words that a task keeps projected.
CHUNK, CACHE = 1 << 15, 150_000
#: Rounds over all rows, texts of a step and its size.
ROUNDS, BATCH, RATE = 4, 64, 1e-2
#: Steps of a round that few rows get at least, in more passes over them.
STEPS = 50
#: Rows from which a fifth is set aside; fewer choose, scale and cut by all.
APART = 50
#: What weights, losses and logits are multiplied by where they are summed as integers; bins of logits a unit.
UNIT, BINS = 1 << 24, 1 << 10
#: Weight of a piece's log-odds where its embedding starts, and the standard errors that are taken off them.
START, SURE = 2.0, 1.5
#: Labelled texts that must have a piece of a word, for it to be embedded.
LEAST_TEXTS = 3


def letters(text: str = "text") -> Column:
    """Lower-case letters of a text, other runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+", " "))


def pieces(word: str) -> list[int]:
    """Buckets of a word and of its beginnings; a short word repeats 0, which embeds as nothing."""
    h = xxhash.xxh3_64_intdigest
    return [h("=" + word) % (BUCKETS - 1) + 1, *(h(word[:n]) % (BUCKETS - 1) + 1 if len(word) >= n else 0 for n in PREFIXES)]


class Words(dict):
    """Number of each word, given as it is first met; 0 is no word."""

    def __init__(self):
        self.own: list[str] = []

    def __missing__(self, word: str) -> int:
        if not word:
            return 0
        self.own.append(word)
        self[word] = n = len(self.own)
        return n

    def ids(self, text: str | None) -> np.ndarray:
        own = (text or "").split()
        return np.array(itemgetter(*own, "")(self)[:-1] if own else (), np.int32)

    def buckets(self, first: int = 0) -> np.ndarray:
        """Pieces of the words numbered from ``first`` on, in order; (n, 1 + len(PREFIXES))."""
        new = self.own[max(first - 1, 0) :]
        rows = [[0] * (1 + len(PREFIXES))] * (first == 0) + [pieces(w) for w in new]
        return np.array(rows, np.int32).reshape(-1, 1 + len(PREFIXES))


class Cnn:
    """Weights: E (BUCKETS, DIM); W{w} (width, DIM, FILTERS); b{w}; v; c.  scale, shift: from logit to score."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {"E": rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32), "v": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "c": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.full(FILTERS, 0.1, np.float32)
        self.p["E"][0] = 0
        self.scale, self.shift, self.thresholds = 1.0, 0.0, {}

    def pooled(self, table: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's greatest value over a text (numbers of rows of ``table``), and the place of its window, counted from max(WIDTHS) blanks before the text."""
        pad = max(WIDTHS)
        text = np.concatenate([np.zeros(pad, np.int32), own, np.zeros(pad, np.int32)])
        top, at = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.int64)
        for low in range(0, len(text) - pad, CHUNK):
            words = table[text[low : low + CHUNK + pad]]
            for k, w in enumerate(WIDTHS):
                m, slot, mine = len(words) - w + 1, sum(WIDTHS[:k]) * FILTERS, slice(k * FILTERS, (k + 1) * FILTERS)
                z = words[:m, slot : slot + FILTERS]
                for i in range(1, w):
                    z = z + words[i : m + i, slot + i * FILTERS : slot + (i + 1) * FILTERS]
                place = z.argmax(axis=0)
                value = z[place, np.arange(FILTERS)] + self.p[f"b{w}"]
                better = value > top[mine]
                top[mine], at[mine] = np.where(better, value, top[mine]), np.where(better, low + place, at[mine])
        return top, at

    def step(self, buckets: np.ndarray, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, tuple[np.ndarray | None, np.ndarray]]:
        """Gradients of the weighted logistic loss over whole texts (numbers of rows of ``buckets``, row 0 a blank): (rows or None for all, gradient)."""
        n, pad = len(texts), max(WIDTHS)
        distinct, flat = np.unique(np.concatenate([np.zeros(1, np.int32), *texts]), return_inverse=True)
        own = buckets[distinct]
        table, found, first = self.project(own), [], 1
        for text in texts:
            found.append(self.pooled(table, flat[first : first + len(text)].astype(np.int32)))
            first += len(text)
        top, at = (np.stack([f[i] for f in found]) for i in (0, 1))
        h = np.maximum(top, 0)
        d = (weight * (1 / (1 + np.exp(-np.clip(h @ self.p["v"] + self.p["c"], -30, 30))) - y) / n).astype(np.float32)
        g: dict = {"v": (None, h.T @ d), "c": (None, d.sum(keepdims=True))}
        back, rows, moves = d[:, None] * self.p["v"] * (top > 0), [], []
        framed = [np.concatenate([np.zeros(pad, np.int32), t, np.zeros(2 * pad, np.int32)]) for t in texts]
        for k, w in enumerate(WIDTHS):
            dz, where = back[:, k * FILTERS : (k + 1) * FILTERS], at[:, k * FILTERS : (k + 1) * FILTERS]
            gw = np.zeros_like(self.p[f"W{w}"])
            for i in range(w):
                best = buckets[np.stack([t[a + i] for t, a in zip(framed, where, strict=True)])]  # pieces under each filter's best place: (n, FILTERS, pieces)
                gw[i] = np.einsum("nfd,nf->df", self.p["E"][best].sum(axis=2), dz)
                rows.append(best.ravel())
                moves.append(np.repeat((dz[:, :, None] * self.p[f"W{w}"][i].T[None]).reshape(-1, DIM), best.shape[2], axis=0))
            g[f"b{w}"], g[f"W{w}"] = (None, dz.sum(axis=0)), (None, gw)
        touched, place = np.unique(np.concatenate(rows), return_inverse=True)
        ge = np.zeros((len(touched), DIM), np.float32)
        np.add.at(ge, place, np.concatenate(moves))
        ge[touched == 0] = 0
        return g | {"E": (touched, ge)}

    def project(self, own: np.ndarray) -> np.ndarray:
        """Numbers of words (n, pieces) on all filter slices: (n, sum of widths * FILTERS)."""
        held = self.p["E"][own[:, 0]]
        for i in range(1, own.shape[1]):
            held += self.p["E"][own[:, i]]
        return held @ np.concatenate([self.p[f"W{w}"][i] for w in WIDTHS for i in range(w)], axis=1)

    def logits(self, table: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Logit of each text; texts are flat[offsets[i]:offsets[i+1]], numbers of rows of ``table`` (projected words)."""
        n, pad = len(offsets) - 1, max(WIDTHS)
        h = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        length = np.diff(offsets) + 2 * pad  # each text between blanks, so a filter reaches over its ends
        begin = np.concatenate([[0], np.cumsum(length)])
        padded = np.zeros(begin[-1], np.int32)
        padded[np.arange(len(flat)) + np.repeat(begin[:-1] + pad - offsets[:-1], np.diff(offsets))] = flat
        first = 0
        while first < n:
            last = min(n, max(first + 1, int(np.searchsorted(begin, begin[first] + CHUNK)) - 1))
            for low in range(begin[first], begin[last], CHUNK):
                words = table[padded[low : min(low + CHUNK + pad, begin[last])]]
                starts = np.maximum(begin[first:last], low) - low
                for k, w in enumerate(WIDTHS):
                    m = len(words) - w + 1
                    if m <= 0:
                        continue
                    slot = sum(WIDTHS[:k]) * FILTERS
                    z = words[:m, slot : slot + FILTERS]
                    for i in range(1, w):
                        z = z + words[i : m + i, slot + i * FILTERS : slot + (i + 1) * FILTERS]
                    block = h[first:last, k * FILTERS : (k + 1) * FILTERS]
                    np.maximum(block, np.maximum.reduceat(z, np.minimum(starts, m - 1), axis=0) + self.p[f"b{w}"], out=block)
            first = last
        return np.maximum(h, 0) @ self.p["v"] + self.p["c"]

    def scores(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*texts, np.zeros(0, np.int32)]).astype(np.int32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """scale and shift of the weighted logistic fit of y on x, lightly held to scale 1; Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 0.1 * (a - 1), (weight * (p - y)).sum() + 0.01 * b])
        s = weight * p * (1 - p)
        m = np.array([[(s * x * x).sum() + 0.1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.01]])
        move = np.clip(np.linalg.solve(m, g), -1, 1)
        a, b = a - move[0], b - move[1]
    return max(a, 0.05), b


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parts (part, dev, y, lang, letters), a part's one after another, with texts as numbers of words; a part ends in a row with the pieces of its words."""
    now, words = None, Words()

    def row(part: int, *values: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, *values), (pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["part", "dev", "y", "lang", "ids", "pieces"])

    for batch in batches:
        for part, dev, y, lang, letters_ in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if now is not None and part != now:
                yield row(now, None, None, None, None, words.buckets().tobytes())
                words = Words()
            now = part
            yield row(part, dev, y, lang, words.ids(letters_).tobytes(), None)
    if now is not None:
        yield row(now, None, None, None, None, words.buckets().tobytes())


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, list[str | None]]]:
    """(part, pieces of its words, texts as numbers of words, labels, which are set aside, languages) of each part that ``_numbered`` gave."""
    texts, y, dev, lang = [], [], [], []
    for batch in batches:
        for i in range(batch.num_rows):
            part, own_dev, own_y, own_lang, ids, pieces_ = (c[i] for c in batch.columns)
            if pieces_.is_valid:
                yield part.as_py(), np.frombuffer(pieces_.as_buffer(), np.int32).reshape(-1, 1 + len(PREFIXES)), texts, np.array(y, np.int64), np.array(dev, bool), lang
                texts, y, dev, lang = [], [], [], []
            else:
                texts.append(np.frombuffer(ids.as_py(), np.int32))
                y.append(own_y.as_py())
                dev.append(own_dev.as_py())
                lang.append(own_lang.as_py())


def _piece_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts with each piece, and those of label 1 among them, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_with, of_label_1 = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for _, buckets, texts, y, _, _ in _by_part(batches):
            for own, label in zip(texts, y.tolist(), strict=True):
                pieces_ = np.unique(buckets[own])
                texts_with[pieces_] += 1
                of_label_1[pieces_] += label == 1
        some = np.flatnonzero(texts_with)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(texts_with[some]), pa.array(of_label_1[some])], ["piece", "n", "n1"])

    sums = rows.mapInArrow(run, "piece long, n long, n1 long").groupBy("piece").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for held, name in zip(out, ("n", "n1"), strict=True):
        held[sums["piece"].to_numpy()] = sums[name].to_numpy()
    return out


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    """All weights but E as rows of DIM numbers."""
    every = np.concatenate([p[k].ravel() for k in sorted(p) if k != "E"])
    return np.pad(every, (0, -len(every) % DIM)).reshape(-1, DIM)


def _learn(net: Cnn, buckets: np.ndarray, texts: list[np.ndarray], y: np.ndarray, balance: np.ndarray, passes: int, rng: np.random.Generator) -> None:
    """A part's steps of one round."""
    order, t = np.arange(len(y)), 0
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    for _ in range(passes):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            t += 1
            for k, (only, g) in net.step(buckets, [texts[r] for r in own], y[own].astype(np.float32), balance[own]).items():
                only = slice(None) if only is None else only
                m = moment[k]
                m[0][only] = 0.9 * m[0][only] + 0.1 * g
                m[1][only] = 0.999 * m[1][only] + 0.001 * g * g
                net.p[k][only] -= RATE * (m[0][only] / (1 - 0.9**t)) / (np.sqrt(m[1][only] / (1 - 0.999**t)) + 1e-7)


def _round(rows: DataFrame, net: Cnn, known: np.ndarray, weights: tuple[float, float], apart: bool, passes: int, number: int) -> tuple[Cnn, float]:
    """The weights after a round over all rows, and the loss of those before it on what is set aside; the last round only gives the loss."""
    held = rows.sparkSession.sparkContext.broadcast((net, known))
    numbers = [f"v{i}" for i in range(DIM)]
    loss_row = BUCKETS + len(_flat(net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, known_ = held.value
        for part, buckets, texts, y, dev, _ in _by_part(batches):
            buckets = np.where(known_[buckets], buckets, 0)
            balance = np.where(y == 1, weights[1], weights[0]).astype(np.float32)
            own = np.flatnonzero(dev) if apart else np.arange(len(y))
            logit = start.logits(start.project(buckets), *_joined([texts[i] for i in own]))
            loss = (balance[own] * np.logaddexp(0, np.where(y[own] == 1, -logit, logit))).sum(dtype=np.float64)
            where, n, moved = [np.array([loss_row])], [np.array([len(own)])], [np.full((1, DIM), loss)]
            fit_ = np.flatnonzero(~dev) if apart else np.arange(len(y))
            if number < ROUNDS and len(fit_):
                net_ = Cnn()
                net_.p = {k: v.copy() for k, v in start.p.items()}
                _learn(net_, buckets, [texts[i] for i in fit_], y[fit_], balance[fit_], passes, np.random.default_rng([number, part]))
                touched = np.flatnonzero((net_.p["E"] != start.p["E"]).any(axis=1))
                dense = _flat(net_.p).astype(np.float64) - _flat(start.p)
                where += [touched, BUCKETS + np.arange(len(dense))]
                n += [np.full(len(touched), len(fit_)), np.full(len(dense), len(fit_))]
                moved += [len(fit_) * (net_.p["E"][touched].astype(np.float64) - start.p["E"][touched]), len(fit_) * dense]
            values = np.rint(np.concatenate(moved) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(where).astype(np.int64)), pa.array(np.concatenate(n).astype(np.int64)), *(pa.array(values[:, i].copy()) for i in range(DIM))], ["place", "n", *numbers])

    out = rows.mapInArrow(run, "place long, n long, " + ", ".join(f"{v} long" for v in numbers))
    out = out.groupBy("place").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in numbers]).toArrow()  # a row a piece and some dozens
    held.destroy()
    place, n = out["place"].to_numpy(), out["n"].to_numpy()
    mean = np.stack([out[v].to_numpy() for v in numbers], axis=1) / UNIT / np.maximum(n, 1)[:, None]
    after, dense = Cnn(), _flat(net.p).astype(np.float64)
    after.p = {k: v.copy() for k, v in net.p.items()}
    piece, other = place < BUCKETS, (place >= BUCKETS) & (place < loss_row)
    after.p["E"][place[piece]] += mean[piece].astype(np.float32)
    dense[place[other] - BUCKETS] += mean[other]
    flat, at = dense.ravel(), 0
    for k in sorted(after.p):
        if k != "E":
            after.p[k] = flat[at : at + after.p[k].size].reshape(after.p[k].shape).astype(np.float32)
            at += after.p[k].size
    return after, float(mean[place == loss_row][0, 0])


def _calibrate(rows: DataFrame, net: Cnn, known: np.ndarray, apart: bool) -> None:
    """Scale, shift and thresholds of ``net`` by all rows that are set aside, counted by bins of logits."""
    held = rows.sparkSession.sparkContext.broadcast((net, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known_ = held.value
        for _, buckets, texts, y, dev, lang in _by_part(batches):
            some = np.flatnonzero(dev) if apart else np.arange(len(y))
            logit = np.clip(own.logits(own.project(np.where(known_[buckets], buckets, 0)), *_joined([texts[i] for i in some])), -30, 30).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in some], pa.string()), pa.array(np.floor(logit * BINS).astype(np.int64)), pa.array(y[some]), pa.array(logit), pa.array(np.rint(logit * UNIT).astype(np.int64))], ["lang", "bin", "y", "logit", "units"])

    bins = rows.mapInArrow(run, "lang string, bin long, y long, logit double, units long").groupBy("lang", "bin").agg(
        F.count("*").alias("n"), F.sum("y").alias("n1"), F.sum("units").alias("units"), F.sum(F.col("units") * F.col("y")).alias("units1"), F.min("logit").alias("low"), F.max("logit").alias("high"))
    bins = written(bins, "logits")
    held.destroy()
    all_ = bins.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "n1", "units", "units1")]).orderBy("bin").toArrow().to_pydict()  # 60 * BINS rows at most
    n, n1, units, units1 = (np.array(all_[c], np.float64) for c in ("n", "n1", "units", "units1"))
    x = np.concatenate([(units - units1) / np.maximum(n - n1, 1), units1 / np.maximum(n1, 1)]) / UNIT
    weight = np.concatenate([n - n1, n1])
    net.scale, net.shift = _platt(x[weight > 0], np.repeat([0, 1], len(n))[weight > 0], weight[weight > 0])
    # For each language the bin from which down nothing is flagged: that of the greatest F1, the upper of equal ones; a language's bins fit one task.
    down = Window.partitionBy("lang").orderBy(F.desc("bin"))
    every = Window.partitionBy("lang")
    f1 = 2 * F.sum("n1").over(down) / (F.sum("n").over(down) + F.sum("n1").over(every))
    ranked = bins.select("lang", "bin", "low", F.lead("high").over(down).alias("next"), f1.alias("f1"), F.sum("n").over(every).alias("n"), F.sum("n1").over(every).alias("n1"))
    best = ranked.filter("n1 > 0 and n1 < n").groupBy("lang").agg(F.max_by(F.struct("low", "next"), F.struct("f1", "bin")).alias("at"))
    for r in best.collect():  # a row a language
        next_ = 0.0 if r["at"]["next"] is None else float(net.scores(np.float64(r["at"]["next"])))
        net.thresholds[r["lang"]] = (float(net.scores(np.float64(r["at"]["low"]))) + next_) / 2


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Cnn:
    """Learns ``labels.toxic`` of documents from all rows where ``learn`` holds."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).select("doc_id", F.col("toxic").cast("int").alias("y"))
    own = F.broadcast(own) if own.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else own
    hashed = F.xxhash64("doc_id", F.lit(5))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text")).join(own, "doc_id").select("doc_id", hashed.alias("rank"), "y", "lang", letters().alias("l"))
    rows = written(rows, "labelled")
    n, n1, size = rows.agg(F.count("*"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)), F.sum(F.length("l"))).first()
    if not n or n1 in (0, n):
        net = Cnn()
        net.p["v"][:] = 0
        net.shift = 30.0 if n and n1 else -30.0
        return net
    parts = max(1, -(-n // PART_ROWS), -(-size // PART_LETTERS))
    dealt = rows.select(F.pmod("rank", F.lit(parts)).cast("int").alias("part"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0).alias("dev"), (F.col("y") == 1).cast("int").alias("y"), "lang", "l", "rank", "doc_id")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "rank", "doc_id", "l", "y")
    dealt = dealt.drop("rank", "doc_id").mapInArrow(_numbered, "part int, dev boolean, y int, lang string, ids binary, pieces binary")
    rows = written(dealt, "parts")  # a part lies in one file
    apart = n >= APART and 0 < rows.filter("dev and y = 1").count() and 0 < rows.filter("not dev and y = 1").count()
    texts_with, of_label_1 = _piece_counts(rows)
    # Pieces that few texts have say nothing of other texts: they embed as nothing, in training and later.
    known = texts_with >= LEAST_TEXTS
    net = Cnn()
    # The first number starts from how surely a piece goes with label 1, so that the pooled places are telling ones from the first step on.
    one, other = of_label_1 + 0.5, texts_with - of_label_1 + 0.5
    odds = np.log(one / (n1 + 1) / (other / (n - n1 + 1)))
    net.p["E"][:, 0] += (START * np.sign(odds) * np.maximum(np.abs(odds) - SURE * np.sqrt(1 / one + 1 / other), 0)).astype(np.float32)
    net.p["E"][~known] = 0
    passes = max(1, -(-STEPS // -(-n // BATCH)))
    best = (np.inf, net)
    for number in range(ROUNDS + 1):
        after, loss = _round(rows, net, known, (0.5 * n / (n - n1), 0.5 * n / n1), apart, passes, number)
        best = min(best, (loss, net), key=lambda b: b[0])
        net = after
    _calibrate(rows, best[1], known, apart)
    return best[1]


def scored(docs: DataFrame, net: Cnn) -> DataFrame:
    """(doc_id, lang, score, threshold) of each row; the language chooses the threshold and has no part in the score."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        words, table = Words(), own.project(np.zeros((1, 1 + len(PREFIXES)), np.int32))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                if len(words) > CACHE:
                    words, table = Words(), table[:1]
                part = batch.slice(at, 256)
                flat, offsets = _joined([words.ids(t) for t in part.column(2).to_pylist()])
                if len(words) >= len(table):
                    table = np.concatenate([table, own.project(words.buckets(len(table)))])
                score = own.scores(own.logits(table, flat, offsets))
                cut = [own.thresholds.get(v, CUT) for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score.astype(np.float64)), pa.array(cut, pa.float64())], ["doc_id", "lang", "score", "threshold"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), letters().alias("l"))
    return rows.mapInArrow(run, "doc_id long, lang string, score double, threshold double")


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``predicted`` is the score against CUT, ``flagged`` against the threshold of the row's language."""
    out = scored(docs, fit(docs, labels, ~held_out(2, 4)))
    return out.select("doc_id", held_out(2, 4).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
