"""Language identification by segmentation-marginalised unigrams.

The pieces come from a fixed public vocabulary. Each language has a probability for every piece; the probability of a
word is the sum over all its segmentations, found by a forward algorithm. Pieces never cross words, so a text's
log-likelihood is the sum over its words, and each distinct word is solved once for all languages together.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import give_back

UNKNOWN = "und"
#: Fixed value: how the vocabulary writes the start of a word.
_START = "▁"
#: A task remembers about so many words; more are solved again.
_KNOWN_WORDS = 300_000
#: Words of up to so many places have probabilities far within the range of a double.
_SHORT = 30
#: Words are solved in groups of about so many places.
_GROUP = 1 << 17

_letters = regex.compile(r"\p{L}+").findall
_ascii_letters = re.compile("[a-z]+").findall
#: A character that no text has, to fill words up to one length; the base of the hash of pieces.
_PAD = "\U0010ffff"
_BASE = 0x9E3779B97F4A7C15


def pieces_of(model_file: str) -> list[str]:
    """The vocabulary's pieces that can stand within one word: letters, and letters after a word start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return sorted({p for p in found if (p[1:] if p[0] == _START else p).isalpha() or p == _START})


def words_of(text: str) -> list[str]:
    lower = text.lower()
    return _ascii_letters(lower) if lower.isascii() else _letters(lower)


class Unigrams:
    """Piece probabilities of every language, and word likelihoods under them."""

    def __init__(self, pieces: list[str], languages: list[str], logp: np.ndarray | None = None,
                 unseen: np.ndarray | None = None):
        self.pieces, self.languages = pieces, languages
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[hashes >> np.uint64(42)] = True
        self.other = len(pieces)  # one more piece, for any single character
        size = len(pieces) + 1
        self.p = np.full((size, len(languages)), 1.0 / size) if logp is None else logp
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(languages)))

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) % (1 << 64)
        return h

    def lattice(self, words: list[str]):
        """All places of pieces in the words: arrays (word, start, end, piece), by end and word; and the lengths.

        Substrings of one width are hashed and looked up together, for all words and starts.
        """
        lengths = np.array([len(w) + 1 for w in words])
        width = int(lengths.max())
        text = "".join([(_START + w).ljust(width, _PAD) for w in words])
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(len(words), width)
        codes = codes.astype(np.uint64) + np.uint64(1)
        h = np.zeros_like(codes)
        found = []
        for k in range(1, min(self.longest, width) + 1):
            h = h[:, :width - k + 1] * np.uint64(_BASE) + codes[:, k - 1:]
            if k == 1:
                word, start = np.nonzero(np.arange(width) < lengths[:, None])
            else:
                word, start = np.nonzero(self.maybe[h >> np.uint64(42)])
            own = h[word, start]
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            real = self.hashes[at] == own
            piece = np.where(real, self.by_hash[at], self.other)
            if k > 1:
                word, start, piece = word[real], start[real], piece[real]
            found.append((word, start, start + k, piece))
        arrays = [np.concatenate(x) for x in zip(*found)]
        order = np.lexsort((arrays[0], arrays[2]))
        return [a[order] for a in arrays], lengths

    @staticmethod
    def _steps(at: np.ndarray):
        """Slices of equal values of a sorted array."""
        edges = np.flatnonzero(np.diff(at)) + 1
        return zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(at)]))) if len(at) else []

    def forward(self, places, lengths: np.ndarray):
        """Logarithms of the summed probabilities of each prefix: [word, end, language]."""
        word, start, end, piece = places
        logs = np.zeros((len(lengths), lengths.max() + 1, len(self.languages)))
        for a, b in self._steps(end):
            w, s, e = word[a:b], start[a:b], end[a]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            value = logs[w, s]
            top = np.maximum.reduceat(value, first, axis=0)
            value -= np.repeat(top, np.diff(np.r_[first, len(w)]), axis=0)
            np.exp(value, out=value)
            value *= self.p[piece[a:b]]
            logs[w[first], e] = top + np.log(np.add.reduceat(value, first, axis=0))
        return logs

    def solve(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under each language."""
        out = np.empty((len(words), len(self.languages)))
        for chosen in self._groups(words):
            places, lengths = self.lattice([words[i] for i in chosen])
            prefix = self.forward(places, lengths) if lengths.max() > _SHORT else self.short_forward(places, lengths)
            out[chosen] = prefix[np.arange(len(chosen)), lengths]
        return out

    @staticmethod
    def _groups(words: list[str]):
        """Numbers of words of about one length, so many that their places stay within the bound."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at) * (len(words[order[to]]) + 2) <= _GROUP:
                to += 1
            yield order[at:to]
            at = to

    def short_forward(self, places, lengths: np.ndarray):
        """The same for words so short that their probabilities need no scaling."""
        word, start, end, piece = places
        sums = np.zeros((len(lengths), lengths.max() + 1, len(self.languages)))
        sums[:, 0] = 1.0
        p = self.p[piece]
        for a, b in self._steps(end):
            w = word[a:b]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            sums[w[first], end[a]] = np.add.reduceat(sums[w, start[a:b]] * p[a:b], first, axis=0)
        with np.errstate(divide="ignore"):
            return np.log(sums)

    def expect(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected piece counts of the words over all segmentations; weights[word, language] is the word's count."""
        counts = np.zeros_like(self.p)
        for chosen in self._groups(words):
            places, lengths = self.lattice([words[i] for i in chosen])
            word, start, end, piece = places
            ahead = self.forward(places, lengths)
            back = np.full_like(ahead, -np.inf)
            back[np.arange(len(chosen)), lengths] = 0.0
            turn = np.lexsort((word, -start))
            logp = np.log(self.p[piece])
            for a, b in self._steps(-start[turn]):
                i = turn[a:b]
                value = logp[i] + back[word[i], end[i]]
                first = np.flatnonzero(np.r_[True, word[i][1:] != word[i][:-1]])
                top = np.maximum.reduceat(value, first, axis=0)
                size = np.diff(np.r_[first, len(i)])
                total = np.add.reduceat(np.exp(value - np.repeat(top, size, axis=0)), first, axis=0)
                back[word[i][first], start[i][0]] = top + np.log(total)
            whole = ahead[np.arange(len(chosen)), lengths]
            share = np.exp(ahead[word, start] + logp + back[word, end] - whole[word])
            np.add.at(counts, piece, share * weights[chosen][word])
        return counts

    def fit(self, words: list[str], weights: np.ndarray, rounds: int = 2, smooth: float = 0.1) -> Unigrams:
        """Expectation maximisation from equal probabilities, with `smooth` added to each expected count."""
        for _ in range(rounds):
            counts = self.expect(words, weights) + smooth
            self.p = counts / counts.sum(axis=0)
        self.known.clear()
        return self

    def score(self, text: str) -> np.ndarray | None:
        """Log-likelihood of a text under each language; None if it has no letter."""
        return self.scores([text])[0]

    def scores(self, texts: list[str]) -> list[np.ndarray | None]:
        counts = [Counter(words_of(t)) for t in texts]
        new = list({w for c in counts for w in c if w not in self.known})
        if len(self.known) + len(new) > _KNOWN_WORDS:
            self.known.clear()
            new = list(set(chain.from_iterable(counts)))
        if new:
            at = len(self.known)
            if at + len(new) > len(self.table):
                self.table = np.concatenate((self.table[:at], np.zeros((len(new) + at, len(self.languages)))))
            self.table[at:at + len(new)] = self.solve(new)
            self.known.update(zip(new, range(at, at + len(new))))
        number = self.known.__getitem__
        out = []
        for c in counts:
            rows = self.table[np.fromiter(map(number, c), dtype=np.int64, count=len(c))]
            out.append(np.fromiter(c.values(), dtype=np.float64, count=len(c)) @ rows if c else None)
        return out


def train(labelled: DataFrame, model_file: str, text: str = "text", lang: str = "lang",
          rows_per_language: int = 800, rounds: int = 2, key: str = "doc_id", most_languages: int = 200) -> Unigrams | None:
    """Fits piece probabilities on at most about `rows_per_language` whole texts of each language; None without labels.

    Where a dirty column has more labels than `most_languages`, the most frequent are learned (ties by name).

    The rows are those whose hash lies below the rate that gives this number, so they are the same in every run. Key and
    text are hashed together, so that copies of a text under other keys are drawn one by one. Word counts are made in Spark; what comes to the driver is bounded by the sample and not by the corpus.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[lang]: r["n"] for r in labelled.groupBy(lang).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), lang).limit(most_languages).collect()}
    if not sizes:
        return None
    rate = F.create_map(*chain.from_iterable(
        (F.lit(k), F.lit(min(1.0, rows_per_language / n))) for k, n in sizes.items()))
    place = F.pmod(F.xxhash64(F.lit("language"), F.col(key), F.col(text)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = labelled.where(place < rate[F.col(lang)]).select(lang, text)

    def count(batches):
        seen: dict[str, Counter] = {}
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(k, Counter()).update(words_of(t))
        for k, c in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(c), pa.string()), pa.array(list(c), pa.string()),
                 pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    rows = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    column = {k: i for i, k in enumerate(languages)}
    words: dict[str, int] = {}
    at = [words.setdefault(w, len(words)) for w in rows.column("word").to_pylist()]
    weights = np.zeros((len(words), len(languages)))
    np.add.at(weights, (at, [column[k] for k in rows.column("lang").to_pylist()]), rows.column("n").to_numpy())
    return Unigrams(pieces_of(model_file), languages).fit(list(words), weights, rounds)


def identify(docs: DataFrame, model: Unigrams | None, carry: list[str], text: str = "text") -> DataFrame:
    """The columns `carry` with lang_pred and score (the posterior of the language, all equally likely before).

    A text that is null or has no letter gets `und` with score 0; so does every text where nothing could be learned.
    Equal likelihoods go to the first language in order. Carried columns of these names are replaced.
    """
    carry = [c for c in carry if c not in ("lang_pred", "score")]
    shipped = docs.sparkSession.sparkContext.broadcast(
        None if model is None else (model.pieces, model.languages, model.p))
    # a text that is carried anyway is sent once
    place = carry.index(text) if text in carry else len(carry)

    def work(batches):
        # the model and the words it remembers live as long as the task: the next stage finds the worker's memory free
        own = None if shipped.value is None else Unigrams(*shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(place).to_pylist()]
                langs, scores = [], []
                for ll in own.scores(texts) if own else [None] * len(texts):
                    if ll is None:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    odds = np.exp(ll - ll.max())
                    langs.append(own.languages[int(odds.argmax())])
                    scores.append(float(odds.max() / odds.sum()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(carry)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[*carry, "lang_pred", "score"])
        own = batch = part = texts = None
        give_back()

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    sent = carry if text in carry else [*carry, text]
    return docs.select(*sent).mapInArrow(work, kinds + "lang_pred string, score double")


def _held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame, model_file: str, key: str = "doc_id", **options) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Rows held out, and all labels of theirs, are not learned from.

    Null texts and texts without a letter are `und` with score 0; a null key is not held out; repeated rows stay, each with
    the same prediction; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(key, "text", "lang").withColumn("held_out", _held_out(key))
    model = train(rows.where("not held_out"), model_file, key=key, **options)
    return identify(rows, model, [key, "held_out"])


def known_language(docs: DataFrame, model_file: str, key: str = "doc_id", least: float = 0.5, **options) -> DataFrame:
    """The documents with a language: those predicted `und` or with a score below `least` go. Columns stay as they are.

    Learned from the labels of `docs` itself. Where there are no labels nothing can be told, and only texts without a
    letter go.
    """
    model = train(docs, model_file, key=key, **options)
    if model is None:
        return docs.where(F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    kept = identify(rows, model, list(names.values()), names["text"]).where(
        (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
