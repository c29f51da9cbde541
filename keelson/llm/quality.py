"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model on style shares and
hashed byte trigrams, minimising the non-negative unbiased risk
``pi R_p(+) + max(0, R_u(-) - pi R_p(-))`` with the logistic loss.  The class prior
``pi`` is estimated first, from positives and unlabelled text alone: the least ratio
of the shares that both have above a score.

The risk is that of all trusted positives and all unlabelled rows.  A sample
(``sample_positives``, ``sample_unlabelled``, by the hash of the id) only says where
to look: the driver minimises the sample's risk plus a linear term, by which its
gradient becomes that of all rows, and asks the cluster for that gradient anew at each
solution (a surrogate risk, ``ROUNDS`` times).  The gradient, the losses and the
histogram of the prior are sums over all rows; what reaches the driver of them does
not grow.

The scale of the scores is set last, by trusted positives that a fit hasn't seen: the
risk is minimised once more without every second id, and the level that all but
``MISSED`` of those ids' positives reach becomes the score ``THRESHOLD``; with few of
them the shift is the smaller (``STEADY``).  ``L2`` and ``HALF`` were chosen by cross-validation within the learning rows.

Defined results: null and empty texts score as text without words; ids may be null
or repeated (each row is scored by itself; rows of a null id have no label and are
not learned from); with no positives or no unlabelled text to learn from the score is
the prior 0.5; an empty table gives an empty result; a column of the
score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import give_back, release, settle, small_batches, trimmed
from .tokens import sliced
from .words import Words

#: Rows of the samples on which the driver searches.
POSITIVES, UNLABELLED = 4000, 8000
#: Times that the gradient of all rows corrects the sample's.
ROUNDS = 2
#: Bins of the scores from which the prior is estimated.
SCORES = 2048
BINS = 512
THRESHOLD = 0.3
#: Share of trusted positives unseen by a fit that may score below the threshold.
MISSED = 0.005
#: So many of them give the shift of the scores half its size.
STEADY = 100
#: Levels of z told apart: steps of 1 / 64 from -20 to 20.
LEVELS, STEP = 2560, 64
#: Weight decay at the full sample; smaller samples get more of it.
L2 = 3e-3

_LETTER, _UPPER, _DIGIT, _SPACE, _STOP, _MARK, _HIGH, _BREAK = range(8)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LETTER, _UPPER, _DIGIT, _HIGH
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = _SPACE, _BREAK
_CLASS[[ord(c) for c in ".,;:'\"?-()"]] = _STOP
STYLE = 17
#: A text of so many bytes gives half its evidence; shorter ones lean to the average.
HALF = 50


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(style, trigram shares): one row for each text."""
    n = len(texts)
    style, grams = np.zeros((n, STYLE)), np.zeros((n, BINS))
    at = 0
    while at < n:  # pieces of about 1 MB
        size, end = 0, at
        while end < n and (end == at or size + len(texts[end]) < 1 << 20):
            size += len(texts[end])
            end += 1
        _features(texts[at:end], style[at:end], grams[at:end])
        at = end
    return style, grams


def _features(texts: list[bytes], style: np.ndarray, grams: np.ndarray) -> None:
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(n), sizes + 1)
    kinds = np.bincount(doc * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8).astype(float)
    kinds[:, _BREAK] -= 1  # what stands between texts
    total = np.maximum(sizes, 1)[:, None]
    style[:, :8] = kinds / total
    letters = kinds[:, _LETTER] + kinds[:, _UPPER]
    style[:, 8] = kinds[:, _UPPER] / np.maximum(letters, 1)
    w = Words(texts)
    count = np.diff(w.first)
    same = np.append(False, w.hash[1:] == w.hash[:-1]) & np.append(False, w.doc[1:] == w.doc[:-1]) if len(w.hash) else np.zeros(0, bool)
    words = np.maximum(count, 1)
    style[:, 9] = np.bincount(w.doc[same], minlength=n) / words
    pair = np.unique(w.doc.astype(np.uint64) << np.uint64(40) | w.hash >> np.uint64(24))
    style[:, 10] = np.bincount((pair >> np.uint64(40)).astype(np.int64), minlength=n) / words ** 0.8
    style[:, 11] = np.minimum(sizes / words / 20, 2)
    style[:, 12] = np.log1p(count) / 10
    size1 = w.end - w.start
    bare = (size1 == 1) & ~np.isin(_CLASS[w.data[w.start]], (_LETTER, _UPPER, _DIGIT, _HIGH)) if len(size1) else np.zeros(0, bool)
    style[:, 13] = np.bincount(w.doc[bare], minlength=n) / words
    style[:, 14] = np.minimum(4 * style[:, 9], 1)
    style[:, 15] = np.minimum(4 * style[:, 13], 1)
    style[:, 16] = np.minimum(10 * style[:, _MARK], 1)
    if len(data) > 2:
        d = data.astype(np.uint32)
        h = (d[:-2] * 0x9E3779B1 + d[1:-1] * 0x85EBCA6B + d[2:] * 0xC2B2AE35) >> np.uint32(16)
        own = doc[:-2] == doc[2:]  # of one text and the break after it
        grams += np.bincount((doc[:-2] * BINS + (h % BINS))[own], minlength=BINS * n).reshape(n, BINS)
        grams /= np.maximum(grams.sum(axis=1, keepdims=True), 1)
        np.sqrt(grams, out=grams)


def _adam(gradient, start: np.ndarray, rounds: int) -> np.ndarray:
    """Adam from ``start`` (weights, then the intercept), averaged over the last half of the rounds."""
    w, mean, m, v = start, np.zeros(len(start)), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, rounds + 1):
        grad = gradient(w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        if 2 * t > rounds:
            mean += w
    return mean / (rounds - rounds // 2)


def _decay(w: np.ndarray, l2: float) -> np.ndarray:
    return np.append(l2 * w[:-1], 0.0)


def _gradient(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.append(x.T @ g, g.sum())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def style_scorer(x: np.ndarray, positive: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights that tell positives from unlabelled rows, each kind of the same weight."""
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1))
    return _adam(lambda w: _gradient(x, weight * (_sigmoid(x @ w[:-1] + w[-1]) - positive)) + _decay(w, 1e-4), np.zeros(x.shape[1] + 1), rounds)


def score_bin(z: np.ndarray) -> np.ndarray:
    return np.minimum(_sigmoid(z) * SCORES, SCORES - 1).astype(np.int64)


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled rows by best bin estimation, from the numbers of rows in each bin of scores."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    qp, qu = (np.cumsum(c[::-1])[::-1] / c.sum() for c in (positive, unlabelled))  # shares at or above a bin
    slack = np.sqrt(np.log(20) / 2 / n_p) + np.sqrt(np.log(20) / 2 / n_u)
    use = qp >= 0.1
    best = int(np.argmin(np.where(use, (qu + slack) / np.where(use, qp, 1), np.inf)))
    return float(np.clip(qu[best] / qp[best], 0.02, 0.98))


def risk_sums(x: np.ndarray, positive: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over rows, from which the risk at ``w`` and its gradient follow.

    sizes and losses of calling a row negative, of positives and of unlabelled rows; and
    gradients: of the positives called positive and negative, of the unlabelled called negative.
    """
    z = x @ w[:-1] + w[-1]
    s, loss, n = _sigmoid(z), np.logaddexp(0, z), int(positive.sum())
    p, u = (slice(n), slice(n, None)) if positive[:n].all() else (positive, ~positive)  # positives first: nothing is copied
    return {"sizes": np.array([n, len(z) - n, loss[p].sum(), loss[u].sum()], float), "p_positive": _gradient(x[p], s[p] - 1),
            "p_negative": _gradient(x[p], s[p]), "u_negative": _gradient(x[u], s[u])}


def risk_terms(sums: dict[str, np.ndarray], prior: float) -> tuple[np.ndarray, float, np.ndarray]:
    """pi R_p(+): its gradient; R_u(-) - pi R_p(-): its value and its gradient."""
    n_p, n_u, loss_p, loss_u = sums["sizes"]
    return prior * sums["p_positive"] / n_p, loss_u / n_u - prior * loss_p / n_p, sums["u_negative"] / n_u - prior * sums["p_negative"] / n_p


def _trust(sizes: np.ndarray) -> np.ndarray:
    return (sizes / (sizes + HALF))[:, None]


class Scaling:
    """Features in standard deviations of a sample, bounded; tasks get it without the sample."""

    def __init__(self, x: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = x - self.mean
        z /= self.scale
        return np.clip(z, -6, 6, out=z)


class Model:
    """Weights of one fit."""

    def __init__(self, mean, scale, w, b, prior):
        self.mean, self.scale, self.w, self.b, self.prior = mean, scale, w, b, prior

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.w is None:
            return np.full(len(texts), self.prior)
        x = np.concatenate(features(texts), axis=1) if texts else np.zeros((0, STYLE + BINS))
        sizes = np.array([len(t) for t in texts], float)
        x = _trust(sizes) * np.clip((x - self.mean) / self.scale, -6, 6)
        return _sigmoid((x * self.w).sum(axis=1) + self.b)  # row by row: a product of matrices rounds by their size


class Search:
    """The sample of a fit: its scaling, prior and risk."""

    def __init__(self, x: np.ndarray, positive: np.ndarray, like: Search | None = None):
        """``like``: the search whose scaling and prior hold here, too; then ``x`` is scaled already."""
        self.scaled = Scaling(x) if like is None else like.scaled
        self.x, self.p = (self.scaled(x) if like is None else x), positive
        self.l2 = L2 * max(1.0, POSITIVES / positive.sum())
        self.prior = 0.5 if like is None else like.prior

    def terms(self, w: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        return risk_terms(risk_sums(self.x, self.p, w), self.prior)

    def solve(self, start: np.ndarray | None = None, everywhere: tuple[np.ndarray, float, np.ndarray] | None = None, rounds: int = 200) -> np.ndarray:
        """Weights of least risk; ``everywhere``: the terms of all rows' risk at ``start``, which the sample's are to have there."""
        w0 = np.zeros(self.x.shape[1] + 1) if start is None else start
        a0, rest0, b0 = (0.0, 0.0, np.zeros(len(w0))) if everywhere is None else (f - o for f, o in zip(everywhere, self.terms(w0)))

        def gradient(w: np.ndarray) -> np.ndarray:
            a, rest, b = self.terms(w)
            a, rest, b = a + a0, rest + rest0 + b0 @ (w - w0), b + b0
            return (a + b if rest >= 0 else -b) + _decay(w, self.l2)  # below 0 the estimate is no risk: climb back

        return _adam(gradient, w0, rounds)

    def fit(self, every: DataFrame) -> np.ndarray:
        """Weights of least risk over the rows ``every``, of which this search has a sample."""
        w = self.solve()
        for _ in range(ROUNDS):
            sums = _sums(every, "x", lambda x, p, w=w: risk_sums(x, p, w))
            w = self.solve(w, risk_terms(sums, self.prior))
        return w

    def model(self, w: np.ndarray, shift: float = 0.0) -> Model:
        return Model(self.scaled.mean, self.scaled.scale, w[:-1], w[-1] + shift, self.prior)


NOTHING = Model(None, None, None, 0.0, 0.5)


def level(z: np.ndarray) -> np.ndarray:
    return np.clip((z + LEVELS / STEP / 2) * STEP, 0, LEVELS - 1).astype(np.int64)


def shift_of(unseen: np.ndarray) -> float:
    """What to add to z so that all but ``MISSED`` of the unseen positives score the threshold, from their number at each level."""
    n = unseen.sum()
    if not n:
        return 0.0
    cut = int(np.searchsorted(np.cumsum(unseen), int(MISSED * n), side="right")) / STEP - LEVELS / STEP / 2
    return float((np.log(THRESHOLD / (1 - THRESHOLD)) - cut) * n / (n + STEADY))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sums(rows: DataFrame, columns: str, of) -> dict[str, np.ndarray]:
    """Vectors of sums over ``rows`` (positive, x): ``of(x, positive)`` gives {name: vector} for a batch; the cluster adds them up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int8).reshape(b.num_rows, -1) / STEPS
                for name, v in of(x, b.column(0).to_numpy(zero_copy_only=False).astype(bool)).items():
                    total[name] = total.get(name, 0.0) + v
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v, pa.float64())], names=["name", "i", "v"])

    out: dict[str, np.ndarray] = {}
    got = rows.select("positive", columns).mapInArrow(trimmed(run), "name string, i int, v double").groupBy("name", "i").agg(F.sum("v").alias("v")).collect()  # as many rows as features
    for r in sorted(got):
        out.setdefault(r.name, []).append(r.v)
    return {k: np.array(v) for k, v in out.items()}


#: Steps of a standard deviation in which features are kept for the fit, a byte each.
STEPS = 21


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_positives: int = POSITIVES, sample_unlabelled: int = UNLABELLED) -> Model:
    """Fit on all rows labelled 1 and all rows without a label, none of them held out."""
    try:
        return _train(docs, labels, id_col, text_col, label_col, sample_positives, sample_unlabelled)
    finally:
        give_back()  # the sample and its rows


def _train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_positives: int, sample_unlabelled: int) -> Model:
    small_batches(docs.sparkSession)
    known = labels.filter(~held_out(id_col) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("good"))
    texts = docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    key = F.xxhash64("id", F.lit(11))
    good = known.filter("good = 1").select("id").orderBy(key, "id").limit(sample_positives)
    other = texts.select("id").distinct().join(known, "id", "left_anti").orderBy(key, "id").limit(sample_unlabelled)
    chosen = good.withColumn("positive", F.lit(True)).unionByName(other.withColumn("positive", F.lit(False)))
    # At most as many ids as the samples have rows: small enough to broadcast whatever the input.
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema))
    odd = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(2)) == 1

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            x = np.concatenate(features([t or b"" for t in b.column(2).to_pylist()]), axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["positive", "odd", "x"])

    got = texts.join(picked, "id").select("positive", odd.alias("odd"), "text").mapInArrow(trimmed(raw), "positive boolean, odd boolean, x binary").toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in got.columns)), key=lambda r: (not r[0], r[1], r[2]))  # sums come out alike, however the rows came
    del got
    positive, unseen = (np.array([r[i] for r in rows], bool) for i in (0, 1))
    if not positive.any() or positive.all():
        return NOTHING
    sample = np.array([np.frombuffer(r[2], np.float32) for r in rows], float)
    del rows
    search = Search(sample, positive)
    del sample
    scaled = search.scaled  # all that tasks need: the sample would go with each of them

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            x = np.concatenate([np.rint(scaled(np.concatenate(features(part), axis=1)) * STEPS).astype(np.int8) for part in sliced(texts)]) if texts else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[:STYLE].tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["id", "style", "x"])

    # A byte a feature meets its label; texts stay where they are.  Rows labelled otherwise than 1 are not used.
    every = settle(texts.mapInArrow(trimmed(kept), T.StructType([texts.schema["id"], T.StructField("style", T.BinaryType()), T.StructField("x", T.BinaryType())]))
                   .join(known, "id", "left").filter("good is null or good = 1")
                   .select("id", "style", "x", F.col("good").isNotNull().alias("positive")), "quality-rows")
    scorer = style_scorer(search.x[~unseen, :STYLE], search.p[~unseen])

    def binned(x: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
        bins = score_bin(x @ scorer[:-1] + scorer[-1])
        return {"p": np.bincount(bins[p], minlength=SCORES).astype(float), "u": np.bincount(bins[~p], minlength=SCORES).astype(float)}

    counts = _sums(every.filter(odd), "style", binned)
    search.prior = prior_of(counts.get("p", np.zeros(1)), counts.get("u", np.zeros(1)))
    w = search.fit(every)
    seen = search.p[~unseen]
    if not seen.any() or seen.all():
        return search.model(w)
    half = Search(search.x[~unseen], seen, search).fit(every.filter(~odd))
    levels = _sums(every.filter(odd & F.col("positive")), "x", lambda x, p: {"n": np.bincount(level(x @ half[:-1] + half[-1]), minlength=LEVELS).astype(float)})
    return search.model(w, shift_of(levels.get("n", np.zeros(1))))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a double ``score_col``, computed from the whole text alone."""
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            texts = [(t or "").encode() for t in b.column(at).to_pylist()]
            scores = np.concatenate([model.score(part) for part in sliced(texts)]) if texts else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, score_col])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
