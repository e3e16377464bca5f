"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

The battery looks at every run of 20 or more characters of the encodings' common alphabet. The null hypothesis is that
a run is ordinary text written in its (inferred) encoding. Ordinary text is uneven over the alphabet, keeps to one
character class for long and has neighbours that depend on each other, so three p-values come from
  * chi-squared uniformity: how small the statistic is beside its noncentral distribution under ordinary text,
  * runs: how many changes of character class there are beside what ordinary text has,
  * serial correlation: how small the correlation of neighbouring codes is beside ordinary text.
They are combined by Fisher's method. What ordinary text does is measured over all documents, per encoding; the
false-discovery threshold (Benjamini-Hochberg) is found over all runs of the corpus, per encoding and length band.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.session import settle

KINDS = ("assign", "access", "hex", "random")
#: The patterns of the contract. Letters of the names in either case, ASCII only.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_NAMES = ("passw", "secret", "token", "api")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The alphabets, from the narrowest; a run has the encoding of the first that holds all of it. A uniformly
#: random string that happens to fit a narrower alphabet is uniform over that one, too. `mixed` is for runs that no
#: encoding holds.
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower26": _LOWER,
    "upper26": _UPPER,
    "base32": _UPPER + "234567",
    "lower32": _LOWER + "234567",
    "lower36": _LOWER + _DIGITS,
    "upper36": _UPPER + _DIGITS,
    "letters52": _UPPER + _LOWER,
    "base58": "".join(c for c in _UPPER + _LOWER + _DIGITS if c not in "0OIl"),
    "alnum62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "mixed": _UPPER + _LOWER + _DIGITS + "+/-_",
}
_CODES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
_ONE_CLASS = {name for name, letters in ALPHABETS.items() if letters in (_DIGITS, _LOWER, _UPPER)}
#: Bins of -log10 p, for the counts over the corpus.
_BINS, _PER_DECADE = 400, 10


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns: leftmost, not overlapping within a kind; failing matches go."""
    spans = []
    folded = text.lower()
    if any(name in folded for name in _NAMES):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed."""
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def encoding(run: str) -> str:
    letters = set(run.rstrip("="))
    return next((name for name, codes in _CODES.items() if letters <= codes.keys()), "mixed")


def band(length: int) -> int:
    """Length bands by powers of the square root of two, from 20 on."""
    return int(2 * math.log2(max(length, 20) / 20))


def measures(run: str) -> tuple[str, int, float, float, float] | None:
    """Encoding, length, chi-squared over length, rate of class changes, correlation of neighbours; None if too short."""
    name = encoding(run)
    codes = _CODES[name]
    x = np.array([codes[c] for c in run if c in codes], dtype=np.float64)
    n = len(x)
    if n < 20:
        return None
    k = len(codes)
    seen = np.bincount(x.astype(np.int64), minlength=k)
    chi = float(((seen - n / k) ** 2).sum() * k / n)
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in run if c in codes]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / (n - 1)
    y = x - x.mean()
    spread = float((y * y).sum())
    serial = float((y[1:] * y[:-1]).sum() / spread) if spread else 1.0
    return name, n, chi / n, changes, serial


def p_values(name: str, n: int, chi: float, changes: float, serial: float, ordinary) -> float:
    """Combined p-value of 'ordinary text' for a run; `ordinary` has the mean and spread of each measure there."""
    (chi_mean, chi_sd), (change_mean, change_sd), (serial_mean, serial_sd) = ordinary
    k = len(ALPHABETS[name])
    scale = math.sqrt(max(n, 20) / 20)  # the spread of a mean shrinks with the length
    noise = math.sqrt(2 * (k - 1)) / n
    z = [(chi_mean - chi) / max(chi_sd / scale, noise, 1e-3),
         (changes - change_mean) / max(change_sd / scale, math.sqrt(0.25 / n) / 2, 1e-3),
         (serial_mean - abs(serial)) / max(serial_sd / scale, 1 / math.sqrt(n))]
    if name in _ONE_CLASS:  # no run of such an encoding has a change, ordinary or not
        del z[1]
    p = [max(0.5 * math.erfc(v / math.sqrt(2)), 1e-300) for v in z]
    half = -sum(map(math.log, p))
    if len(p) == 2:
        return math.exp(-half) * (1 + half)  # Fisher, four degrees of freedom
    return math.exp(-half) * (1 + half + half * half / 2)  # Fisher, six degrees of freedom


def randomness(run: str) -> bool:
    """Whether none of the three tests rejects that the run is uniformly random (each at 0.1 %)."""
    found = measures(run)
    if found is None:
        return False
    name, n, chi, changes, serial = found
    k = len(ALPHABETS[name])
    counts = [sum(map(test, ALPHABETS[name])) for test in (str.isdigit, str.islower, str.isupper)]
    same = sum(c * c for c in (*counts, k - sum(counts))) / (k * k)
    expected = 1 - same
    chi_ok = chi * n <= k - 1 + 3.3 * math.sqrt(2 * (k - 1)) + 4
    change_ok = expected < 0.02 or abs(changes - expected) <= 3.3 * math.sqrt(expected * (1 - expected) * 2 / n)
    return chi_ok and change_ok and abs(serial) <= 3.3 / math.sqrt(n)


def _measured(batches):
    """Runs of a batch: one row each."""
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            for m in _RUN.finditer(text or ""):
                if found := measures(m.group()):
                    rows.append((*found, randomness(m.group())))
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=["encoding", "n", "chi", "changes", "serial", "random"])


#: What ordinary text is taken to do where the corpus has few ordinary runs of an encoding: mean and spread of
#: chi-squared over length, of the rate of class changes and of the absolute correlation of neighbours.
_PRIOR = ((2.5, 1.0), (0.1, 0.1), (0.3, 0.2))
_PRIOR_RUNS = 50


def ordinary_text(runs: DataFrame) -> dict[str, tuple]:
    """Mean and spread of the measures over the runs of the whole corpus that are not random, for each encoding."""
    rows = runs.where("not random").groupBy("encoding").agg(
        F.count("*").alias("n"), *[f(F.abs(c)).alias(f"{c}_{f.__name__}") for c in ("chi", "changes", "serial")
                                   for f in (F.avg, F.stddev_pop)]).collect()
    found = {r["encoding"]: r for r in rows}
    out = {}
    for name in ALPHABETS:
        r = found.get(name)
        n = r["n"] if r else 0
        out[name] = tuple(
            tuple((_PRIOR_RUNS * prior + n * (r[f"{c}_{f}"] if r else 0.0)) / (_PRIOR_RUNS + n)
                  for prior, f in zip(pair, ("avg", "stddev_pop")))
            for pair, c in zip(_PRIOR, ("chi", "changes", "serial")))
    return out


def thresholds(runs: DataFrame, ordinary: dict[str, tuple], rate: float) -> dict[tuple[str, int], float]:
    """Benjamini-Hochberg thresholds at `rate` for each encoding and length band, from binned p-values of all runs."""
    def binned(batches):
        for batch in batches:
            names, n, chi, changes, serial = (batch.column(i).to_pylist() for i in range(5))
            keys = [(e, band(k), _bin(p_values(e, k, a, b, c, ordinary[e])))
                    for e, k, a, b, c in zip(names, n, chi, changes, serial)]
            columns = list(zip(*keys)) if keys else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32()))],
                names=["encoding", "band", "bin"])

    rows = runs.mapInArrow(binned, "encoding string, band int, bin int").groupBy("encoding", "band", "bin").agg(
        F.count("*").alias("n")).collect()  # at most 15 encodings x some 60 bands x 400 bins
    counts: dict[tuple[str, int], np.ndarray] = {}
    for r in rows:
        counts.setdefault((r["encoding"], r["band"]), np.zeros(_BINS, dtype=np.int64))[r["bin"]] = r["n"]
    out = {}
    for key, by_bin in counts.items():
        total, best = by_bin.sum(), 0.0
        upto = np.cumsum(by_bin[::-1])[::-1]  # runs with a p-value of the bin or smaller
        for b in range(_BINS):
            p = 10.0 ** (-b / _PER_DECADE)
            if upto[b] and p * total / upto[b] <= rate:
                best = p
                break
        out[key] = best
    return out


def _bin(p: float) -> int:
    return min(_BINS - 1, int(-math.log10(max(p, 1e-300)) * _PER_DECADE))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = 0.01) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    `spans` has the spans of the fixed patterns and those that the battery adds (kind `random`): runs whose p-value is
    within the corpus' threshold, that pass as random, and that no fixed pattern touches. A null or empty text has none;
    repeated rows are alike; in an empty table nothing is measured and nothing returned.
    """
    runs = settle(docs.select(text).mapInArrow(
        _measured, "encoding string, n long, chi double, changes double, serial double, random boolean"), "runs")
    ordinary = ordinary_text(runs)
    limits = thresholds(runs, ordinary, rate)

    def work(batches):
        for batch in batches:
            counts, digests, spans = [[], [], []], [], []
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                for i, kind in enumerate(KINDS[:3]):
                    counts[i].append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                added = []
                for m in _RUN.finditer(t or ""):
                    if any(a < m.end() and m.start() < b for a, b, _ in base) or not randomness(m.group()):
                        continue
                    name, n, *rest = measures(m.group())
                    limit = limits.get((name, band(n)), 0.0)
                    if limit and _bin(p_values(name, n, *rest, ordinary[name])) >= _bin(limit):
                        added.append((m.start(), m.end(), "random"))
                spans.append(joined(base + added))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())],
                names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        work, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
