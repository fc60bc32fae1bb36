"""Quality classifier from trusted positives and unlabelled text: non-negative unbiased risk with an estimated prior."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspan.llm.common import free_names

_SYMBOLS = "#*$%&|<>{}[]\\^~="
N_SHAPE = 14
#: Buckets of hashed words, and as many of hashed pairs of words.
BUCKETS = 128
N_FEATURES = N_SHAPE + 2 * BUCKETS
#: Weight of a bucket beside a number of the shape, which keeps many weak features from outvoting few strong ones.
CONTENT_SCALE = 0.15
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(64 - BUCKETS.bit_length() + 1)


def content(text: str) -> np.ndarray:
    """Roots of the shares that each bucket has of the text's words, and of its pairs of words, in small letters."""
    h = np.fromiter(map(zlib.crc32, text.lower().encode("utf-8", "replace").split()), np.uint64)
    if not len(h):
        return np.zeros(2 * BUCKETS)
    pairs = h[:-1] * np.uint64(31) + h[1:]
    return np.concatenate([np.sqrt(np.bincount((k * _MIX >> _TOP).astype(np.int64), minlength=BUCKETS) / max(1, len(k))) for k in (h, pairs)])


def features(text: str | None) -> np.ndarray:
    """Shape of a text, apart from its length, and its content; an empty text has its own first feature and zeros."""
    out = np.zeros(N_FEATURES, np.float32)
    words = text.split() if text else []
    n = len(words)
    if not n:
        out[0] = 1.0
        return out
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    line_counts = Counter(lines)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lower = text.lower()
    raised = 0.0
    if len(lower) == len(text):
        raised = np.count_nonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) != np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)) / len(text)
    chars = sum(map(len, words))
    out[N_SHAPE:] = content(text)
    out[1:N_SHAPE] = (
        chars / n,
        np.log1p(20 * sum(map(text.count, _SYMBOLS)) / n),
        np.log1p(20 * text.count("!") / n),
        raised,
        len(counts) / n,
        pairs / max(1, n - 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        max(counts.values()) / n,
        1 - len(line_counts) / max(1, len(lines)),
        np.log1p(sum(map(text.count, ".,;:?")) / n),
        np.log1p(sum(map(text.count, "0123456789")) / chars),
        sum(1 for c in counts.values() if c == 1) / len(counts),
        sum(len(w) <= 3 for w in words) / n,
    )
    return out


def expand(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Standardised features: those of the shape also in size and beyond 1.5 to each side, those of the content weighed less."""
    z = np.clip((x - mean) / sd, -6, 6)
    z, rest = z[:, :N_SHAPE], z[:, N_SHAPE:]
    return np.concatenate([z, np.abs(z), np.maximum(0, z - 1.5), np.maximum(0, -z - 1.5), CONTENT_SCALE * rest, np.ones((len(z), 1))], axis=1, dtype=np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _adam(weights: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        g = gradient(weights)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights = (weights - rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(weights.dtype)
    return weights


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of a classifier that tells the two samples apart.

    Above any threshold the unlabelled hold at least the share of the positives that is above it; the tightest such bound,
    with a margin for the sizes of the samples, is the estimate.
    """
    cuts = np.quantile(positive, np.linspace(0.02, 0.98, 97))
    of_p = np.array([(positive >= c).mean() for c in cuts])
    of_u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    k = np.argmin((of_u + margin) / of_p)
    return float(np.clip(of_u[k] / of_p[k], 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 400, l2: float = 1e-3) -> dict:
    """Weights that minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) under the logistic loss.

    While the second part is negative, steps go against its gradient, as the non-negative estimator asks. The prior is
    estimated from scores of rows that the classifier behind them has not seen; small samples are held back more.
    """
    l2 = l2 + 1 / min(len(positive), len(unlabelled))
    every = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, sd = every.mean(0), every.std(0) + 1e-6
    p, u = expand(positive, mean, sd), expand(unlabelled, mean, sd)

    def tell_apart(p, u):
        return lambda w: -p.T @ _sigmoid(-p @ w) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + l2 * w

    if prior is None:
        seen = [_adam(np.zeros(p.shape[1], np.float32), tell_apart(p[k::2], u[k::2]), steps // 2, 0.05) for k in (0, 1) if len(p) > 1 and len(u) > 1]
        unseen = [(p[1 - k :: 2] @ w, u[1 - k :: 2] @ w) for k, w in enumerate(seen)]
        prior = float(np.mean([estimate_prior(*x) for x in unseen])) if unseen else 0.5

    def gradient(w):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        for_positive = -prior * (p.T @ (1 - sp)) / len(p)
        negative_risk = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        for_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        return (for_positive + for_negative if negative_risk >= 0 else -for_negative) + l2 * w

    return {"weights": _adam(np.zeros(p.shape[1], np.float32), gradient, steps, 0.05).astype(np.float64), "mean": mean, "sd": sd, "prior": prior}


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["doc_id", "x"])


def _scored(model: dict | None, text: str, score: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            scores = np.full(batch.num_rows, 0.5)
            for i in range(0, batch.num_rows if model is not None else 0, 512):
                x = np.stack([features(t.as_py()) for t in batch.column(at)[i : i + 512]])
                # Row by row: products of matrices may round differently in batches of another size.
                scores[i : i + 512] = _sigmoid((expand(x, model["mean"], model["sd"]) * model["weights"]).sum(axis=1))
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(scores)], names=[*(batch.schema.names[i] for i in keep), score])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, prior: float | None = None) -> dict | None:
    """Model from at most `sample` trusted positives and `sample` documents taken as unlabelled, by the least hash of their ids.

    Held-out rows are in neither sample. None where there are no positives or no documents.
    """
    long_id = F.col("doc_id").cast("long").alias("doc_id")
    trusted = labels.filter((F.col("quality") == 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select(long_id).distinct()
    pool = docs.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select(long_id)

    def least(ids: DataFrame, seed: int) -> DataFrame:
        return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)

    # Both lists of ids are bounded by `sample`, and so is what comes to the driver: one row for each id, in the order of
    # its hash, so that neither files nor partitions have a say in the model.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    x, y = [], []
    for out, ids in ((x, least(trusted, 1)), (y, least(pool, 2))):
        featured = texts.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(_featured, "doc_id long, x binary")
        rows = featured.groupBy("doc_id").agg(F.min("x").alias("x"), F.first(F.xxhash64("doc_id", F.lit(3))).alias("h")).collect()
        out += [np.frombuffer(r["x"], np.float32) for r in sorted(rows, key=lambda r: (r["h"], r["doc_id"]))]
    return fit(np.array(x), np.array(y), prior) if x and y else None


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 6000, threshold: float = 0.7, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score every whole text: columns, held_out, score (0 to 1, higher for better text) and predicted (1 from threshold on).

    Trusted positives are rows of labels with quality 1 that aren't held out; text is all that scores depend on.
    Training reads bounded samples of positives and of unlabelled documents (the parameter `sample` bounds each), whatever
    the order of rows; scoring is one scan without a shuffle.
    Null and empty texts are scored as texts without words. Null ids are scored and never held out or sampled; repeated
    rows are scored each, and learned from once, as are rows that share an id (the one with the least features counts). An
    empty table gives an empty table. Without positives every score is 0.5. Where `columns` hold a column named held_out,
    score or predicted, the new one has an underscore before its name; the three new ones are always the last.
    """
    model = train(docs, labels, sample)
    asked = docs.select(*[f"`{c}`" for c in columns])
    held, score, predicted, text = free_names(asked, "held_out", "score", "predicted", "_text")
    wide = docs.select(*[f"`{c}`" for c in columns], F.col("text").alias(text), held_out(F.col("doc_id")).alias(held))
    fields = [f for f in wide.schema.fields if f.name != text]
    schema = type(wide.schema)(fields).add(score, "double")
    return wide.mapInArrow(_scored(model, text, score), schema).withColumn(predicted, F.when(F.col(score) >= threshold, 1).otherwise(0))
