"""Quality classifier by positive-unlabelled learning: a linear model of the least non-negative unbiased risk (nnPU)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, id_or_null, text_or_empty
from .textvec import slices

#: Rows of the bounded samples that the model is fitted on: trusted positives, and unlabelled web texts.
POSITIVES, UNLABELLED = 8_000, 16_000
FOLDS, THRESHOLD = 5, 0.3
#: Quantile bins of each feature, passes of gradient descent, its rate, and the weight decay.
BINS, PASSES, RATE, DECAY = 12, 1500, 0.05, 1e-4
_SYMBOLS = b"#*$%&|<>"
FEATURES = (
    ["log_words", "log_word_length", "upper", "digit", "punct", "symbol", "bang", "stop", "comma", "other", "space"]
    + ["words_once", "word_repeats", "pair_once", "lines", "line_repeats", "line_words", "longest", "alpha_words", "upper_words", "top_word", "non_ascii"]
    + [f"char_{chr(c)}" for c in _SYMBOLS]
)


def features(text: bytes) -> list[float]:
    """Shape of a text: rates of character classes, repetition of words, pairs and lines, lengths. Language-free."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    symbols = counts[list(_SYMBOLS)]
    punct = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    alpha = sum(w.isalpha() for w in words)
    upper = sum(w.isupper() for w in words)
    return [
        np.log1p(len(words)), np.log1p(len(text) / n), counts[65:91].sum() / max(1, letters), counts[48:58].sum() / size, punct / size, symbols.sum() / size,
        counts[33] / size, counts[46] / n, counts[44] / n, (counts[:9].sum() + counts[14:32].sum()) / size, (counts[32] + counts[9:14].sum()) / size,
        len(seen) / n, repeats / n, pairs / n, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        np.log1p(max(map(len, words), default=0)), alpha / n, upper / n, max(seen.values(), default=0) / n, counts[128:].sum() / size,
        *(symbols / n),
    ]


@dataclass
class Model:
    """A sum of one weight per feature bin."""

    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray  # features x BINS
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = self.weights[np.arange(len(self.edges)), self.bins(x)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _edges(x: np.ndarray) -> np.ndarray:
    """Bin edges: quantiles of the distinct values, so that a mass at one value doesn't hide the rest."""
    out = []
    for c in x.T:
        v = np.unique(c)
        out.append(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1]) if len(v) > 1 else np.full(BINS - 1, v[0] if len(v) else 0.0))
    return np.array(out)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk_and_step(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) of the logistic loss, and the direction to descend against.

    p and u hold the weights that a row uses, by number; the last weight is the bias. Where the bracket falls below zero
    the direction goes up its gradient instead (Kiryo et al., 2017), so the model cannot gain by fitting the positives
    among the unlabelled.
    """
    k, size = p.shape[1], len(w) - 1

    def back(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(x.ravel(), np.repeat(g, k), size), g.sum())

    zp, zu = w[:-1][p].sum(axis=1) + w[-1], w[:-1][u].sum(axis=1) + w[-1]
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    rise = back(u, _sigmoid(zu)) / len(u) - prior * back(p, _sigmoid(zp)) / len(p)
    risk = prior * np.logaddexp(0, -zp).mean() + max(0.0, negative)
    return risk, rise + prior * back(p, -_sigmoid(-zp)) / len(p) if negative >= 0 else -rise


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative risk; full batches, Adam, weight decay. Deterministic."""
    k = len(FEATURES)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((k, BINS - 1)), np.zeros((k, BINS)), float(np.log(prior / (1 - prior))), prior)
    model = Model(_edges(np.concatenate([positive, unlabelled])), np.zeros((k, BINS)), 0.0, prior)
    cell = lambda x: model.bins(x) + np.arange(k) * BINS
    p, u = cell(positive), cell(unlabelled)
    w, m, v = np.zeros(k * BINS + 1), np.zeros(k * BINS + 1), np.zeros(k * BINS + 1)
    for step in range(1, PASSES + 1):
        grad = risk_and_step(w, p, u, prior)[1] + DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias = w[:-1].reshape(k, BINS), float(w[-1])
    return model


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1, slack: float = 0.01) -> float:
    """Share of positives among the unlabelled, from scores of positives that the scorer has not seen, and of unlabelled texts.

    Above any score c, unlabelled texts hold at least prior times the share that positives have there, so the smallest
    ratio of both shares bounds the prior from above; it is taken where it is smallest with its confidence bound (best
    bin estimation, Garg et al., 2021).
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    error = np.sqrt(np.log(4 / doubt) / (2 * len(positive))) + np.sqrt(np.log(4 / doubt) / (2 * len(unlabelled)))
    best = int(np.argmin((u + (1 + slack) * error) / p))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def fit_with_prior(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """fit() under a prior that comes from positives and unlabelled texts alone.

    A first model of every other row scores the rest, from which the prior is estimated; the final one is fitted on all.
    """
    if not len(positive) or not len(unlabelled):
        return fit(positive, unlabelled, 0.5)
    first = fit(positive[::2], unlabelled[::2], 0.5)
    return fit(positive, unlabelled, estimated_prior(first.score(positive[1::2]), first.score(unlabelled[1::2])))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [np.asarray(features(t), np.float64) for t in b.column("x").to_pylist()]
        offsets = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
        flat = np.concatenate([*x, np.zeros(0)])
        yield pa.RecordBatch.from_arrays([b.column("kind"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["kind", "x"])


def held_out(doc_id: str = "doc_id"):
    """True for the fold that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _sampled(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """About `most` rows, 2 * most at the very most, by a hash of doc_id."""
    n = rows.count()
    part = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n))))
    return part.limit(2 * most)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on bounded samples outside the held-out fold.

    Trusted positives are texts labelled 1; the unlabelled sample is drawn from all of docs, labels unseen; the class
    prior is estimated from both, so labels 0 are never read. Labels without a document, null labels and null ids teach
    nothing. Repeated rows count as rows. Without positives or texts every document scores 0.5.
    """
    known = labels.filter(~held_out() & (F.col("quality") == 1))
    texts = docs.filter(~held_out()).select("doc_id", text_or_empty().cast("binary").alias("x"))
    good = _sampled(known.select("doc_id").distinct(), positives, 11)
    sample = texts.join(good, "doc_id").select(F.lit(1).alias("kind"), "x").limit(2 * positives)
    # Ids first: the sample's size is known before any text is read.
    web = _sampled(texts.select("doc_id"), unlabelled, 12).distinct()
    sample = sample.unionByName(texts.join(web, "doc_id").select(F.lit(0).alias("kind"), "x").limit(2 * unlabelled))
    rows = sample.mapInArrow(_featurize, "kind int, x array<double>").toArrow()
    kind = rows.column("kind").to_numpy()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if rows.num_rows else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, kind))  # rows come in any order
    kind, x = kind[order], x[order]
    mixed = np.random.default_rng(13).permutation(len(kind))  # neighbours in the sorted order are alike
    kind, x = kind[mixed], x[mixed]
    return fit_with_prior(x[kind == 1], x[kind == 0])


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, scores = b.column("x").to_pylist(), []
            for i, j in slices(texts):
                scores.append(model.score(np.array([features(t) for t in texts[i:j]])))
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("held_out"), pa.array(np.concatenate([*scores, np.zeros(0)]))], names=["d", "held_out", "score"])

    return run


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0).

    Only the text is scored; null texts count as empty, very long ones are read whole. Repeated rows come out alike, ties
    score alike, other columns don't matter, whatever their names, and an empty table gives no rows. Without a shuffle.
    """
    base = docs.select(doc_key().alias("d"), held_out().alias("held_out"), text_or_empty().cast("binary").alias("x"))
    out = base.mapInArrow(_scorer(model), "d long, held_out boolean, score double")
    return out.select(id_or_null("d").alias("doc_id"), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
