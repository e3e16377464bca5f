"""Toxicity by non-negative positive-unlabelled learning (a numpy logistic model on the words that a text has).

Confirmed toxic texts are the positives; everything else, labelled or not, is unlabelled. With the class prior q the
risk is q * R+(positives) + max(0, R-(unlabelled) - q * R-(positives)): the last term takes the hidden positives out of
the unlabelled, and is kept from turning negative, which is where such a model overfits.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.session import settle

_BUCKETS = 1 << 20
#: Entries that are looked up at once in fitting.
_BLOCK = 1 << 18
#: Labelled positives, and unlabelled texts, that are used for fitting at most (about).
MOST_POSITIVE = 4000
MOST_UNLABELLED = 12000
THRESHOLD = 0.7

_letters = regex.compile(r"\p{L}+").findall
#: Words count as a whole and by their first letters, as many as these; the rest is often an ending.
_STEMS = (4, 5, 6)
_buckets_of: dict[str, tuple[int, ...]] = {}


def _buckets(word: str) -> tuple[int, ...]:
    found = _buckets_of.get(word)
    if found is None:
        if len(_buckets_of) > 300_000:
            _buckets_of.clear()
        names = [word, *(f"{word[:n]}-" for n in _STEMS if n <= len(word))]
        found = _buckets_of[word] = tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) % _BUCKETS for n in names)
    return found


def features(text: str | None) -> np.ndarray:
    """Buckets of the distinct lower-cased words, and of their stems, of a whole text."""
    found = {b for w in set(_letters((text or "").lower())) for b in _buckets(w)}
    return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


@dataclass
class Classifier:
    weights: np.ndarray  # one for each bucket
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.weights[features(t)].sum() for t in texts], dtype=np.float64) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


class _Sums:
    """Sums of looked-up values over runs of `counts` entries of `index`, a block at a time to keep memory low."""

    def __init__(self, index: np.ndarray, counts: np.ndarray):
        self.index, self.n = index, len(counts)
        self.owner = np.flatnonzero(counts)
        self.ends = np.cumsum(counts[self.owner])
        self.starts = self.ends - counts[self.owner]
        cuts = np.searchsorted(self.ends, np.arange(_BLOCK, len(index), _BLOCK))
        self.cuts = np.unique(np.r_[0, cuts, len(self.owner)])

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            low = self.starts[a]
            found = values[self.index[low:self.ends[b - 1]]]
            out[self.owner[a:b]] = np.add.reduceat(found, self.starts[a:b] - low)
        return out


class _Rows:
    """Sparse 0/1 rows over the kept buckets, in the order of rows and in that of columns."""

    def __init__(self, rows: list[np.ndarray], column: np.ndarray, width: int):
        self.n = len(rows)
        counts = np.array([np.count_nonzero(column[r] >= 0) for r in rows], dtype=np.int64)
        flat = np.empty(counts.sum(), dtype=np.int32)
        at = 0
        for r, n in zip(rows, counts):
            k = column[r]
            flat[at:at + n] = k[k >= 0]
            at += n
        self.times = _Sums(flat, counts)
        row = np.repeat(np.arange(self.n, dtype=np.int32), counts)
        self.gradient = _Sums(row[np.argsort(flat, kind="stable")], np.bincount(flat, minlength=width))


def _frequency(rows: list[np.ndarray]) -> np.ndarray:
    """How many rows have each bucket; a row has a bucket once."""
    out = np.zeros(_BUCKETS, dtype=np.int64)
    for r in rows:
        out[r] += 1
    return out


def _evidence(share: np.ndarray, usual: np.ndarray, prior: float, n: int) -> np.ndarray:
    """Log ratio of a bucket's share of the positives to that of the clean texts.

    The unlabelled hold positives at the rate of the prior, whose part is taken out; one text of `n` smooths.
    """
    clean = np.maximum(usual - prior * share, 0.0) / (1 - prior)
    return np.log((share + 1 / n) / (clean + 1 / n))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 600, rate: float = 0.05,
        decay: float = 1e-3, least: int = 5) -> Classifier:
    """Minimises the non-negative PU risk under the logistic loss by Adam over full batches.

    All buckets in at least `least` positives are used. Each is scaled by its evidence, so that the decay holds down
    those that say little by themselves. Without positives or unlabelled texts the model says the prior for every text.
    """
    weights = np.zeros(_BUCKETS)
    prior = min(max(prior, 1e-4), 0.9)
    if not positive or not unlabelled:
        return Classifier(weights, float(np.log(prior / (1 - prior))))
    df, usual = _frequency(positive), _frequency(unlabelled) / len(unlabelled)
    kept = np.flatnonzero(df >= min(least, len(positive)))
    scale = _evidence(df[kept] / len(positive), usual[kept], prior, len(positive))
    column = np.full(_BUCKETS, -1, dtype=np.int32)
    column[kept] = np.arange(len(kept))
    width = len(kept)
    p, u = _Rows(positive, column, width), _Rows(unlabelled, column, width)
    w = np.zeros(width + 1)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        scaled = w[:-1] * scale
        zp, zu = p.times(scaled) + w[-1], u.times(scaled) + w[-1]
        hidden = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sign = 1.0 if hidden >= 0 else -1.0
        dp = np.zeros(p.n)
        if sign > 0:
            dp += prior * (_sigmoid(zp) - 1) / p.n
        dp -= sign * prior * _sigmoid(zp) / p.n
        du = sign * _sigmoid(zu) / u.n
        data = (p.gradient(dp) + u.gradient(du)) * scale
        g = np.append(data + decay * w[:-1] * prior, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    weights[kept] = w[:-1] * scale
    return Classifier(weights, float(w[-1]))


def _rate(most: int, n: int) -> float:
    return min(1.0, most / n) if n else 0.0


def _place(salt: str, column: str):
    return F.pmod(F.xxhash64(F.lit(salt), F.col(column)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
          most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Classifier:
    """Fits on about `most_positive` confirmed toxic rows and `most_unlabelled` other rows, chosen by hash of the key.

    The class prior is the share of toxic rows among all labelled rows. Rows without key or label are not used.
    """
    labels = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).select(key, toxic)
    counted = labels.agg(F.count("*").alias("n"), F.count_if(F.col(toxic) == 1).alias("yes")).first()
    yes = labels.where((F.col(toxic) == 1) & (_place("positive", key) < _rate(most_positive, counted["yes"])))
    yes = settle(yes.select(F.col(key).alias("__id")).distinct(), "toxic-ids")
    usable = docs.where(F.col(key).isNotNull()).select(key, text)
    rate = _rate(most_unlabelled, usable.count())
    # both lists of ids are bounded by the two parameters
    sample = usable.join(F.broadcast(yes), F.col(key) == F.col("__id"), "left")
    drawn = _place("unlabelled", key) < rate
    sample = sample.where(F.col("__id").isNotNull() | drawn).select(
        F.col("__id").isNotNull().alias("positive"), drawn.alias("drawn"), text)

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([features(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))],
                names=["positive", "drawn", "buckets"])

    rows = sample.mapInArrow(count, "positive boolean, drawn boolean, buckets array<int>").toArrow()
    positive, drawn = rows.column("positive").to_numpy(), rows.column("drawn").to_numpy()
    buckets = rows.column("buckets").combine_chunks()
    flat, ends = buckets.values.to_numpy(), buckets.offsets.to_numpy()
    lists = [flat[ends[i]:ends[i + 1]] for i in range(len(buckets))]
    prior = counted["yes"] / counted["n"] if counted["n"] else 0.0
    return fit([x for x, y in zip(lists, positive) if y], [x for x, y in zip(lists, drawn) if y], prior)


def score(docs: DataFrame, model: Classifier, carry: list[str], text: str = "text") -> DataFrame:
    """The columns `carry` with score (0 to 1) and predicted (1 from 0.7 on). Null and empty texts have the base score."""
    carry = [c for c in carry if c not in ("score", "predicted")]
    used = np.flatnonzero(model.weights)
    shipped = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.bias))

    def work(batches):
        at, values, bias = shipped.value
        weights = np.zeros(_BUCKETS)
        weights[at] = values
        own = Classifier(weights, bias)
        for batch in batches:
            s = own.score(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=[*carry, "score", "predicted"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return docs.select(*carry, F.col(text).alias("__text")).mapInArrow(work, kinds + "score double, predicted int")


def toxicity_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Held-out rows and their labels are not learned from.

    Null ids are never held out and never learned from; repeated rows score alike; without documents the result is
    empty, and without labels every score is the lowest prior.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out)
    model = train(rows.where("not held_out"), labels.select("doc_id", "toxic").where(~held_out), **options)
    return score(rows, model, ["doc_id", "held_out"])
