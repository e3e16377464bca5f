"""Alignment of two tokenizers, with corpus-wide counts of their token pairs by external spill counting.

A byte-level vocabulary (side A) and a piece vocabulary (side B) cut the same bytes. Offsets where tokens of both sides
end cut a text into groups; every piece between neighbouring ends of either side lies in one token of A and one of B, so
these pieces are the links. The count of an id pair needs the whole corpus:

1. Texts are taken in runs of bounded length. A run sorts its links by (part, B id, A id, document); the part is a radix
   of the B id. It leaves the dictionary of its pairs with their totals, as compressed blocks per part, and the postings
   (document, number) of every dictionary entry.
2. One task per part merges the dictionaries of all runs with a heap over the first keys of their blocks. The order is
   by B id first, so when a B id ends, the totals of all its pairs and the highest of them are final, and they go back
   to each run in the order of its dictionary.
3. Per run, totals meet postings and are summed by document. Postings and texts never leave their run.

A pair that is in every document costs one entry per run in step 2, so frequent tokens fill no task.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.byte_bpe import byte_table
from kerbline.session import settle

#: A run holds about so many characters (or one longer text) and at most 2^16 texts.
RUN_CHARS = 1 << 22
_RUN_TEXTS = 1 << 16
_BLOCK = 1 << 13
_BUFFER = 1 << 18
#: Characters that one part of the counting stands for, and the most parts; beyond, parts grow and are read in blocks.
_PART_CHARS = 1 << 24
_MOST_PARTS = 1 << 12
_STRETCH = 1 << 16
_GAP = "▁"
STATS = ["n_a", "n_b", "n_groups", "n_links"]


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unzip(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


class Bytes:
    """A byte-level vocabulary at work in one task: ids of a text, and the bytes of its tokens.

    Where ids follow the order of the merges they are ranks, and a rank encoder does the same work faster.
    """

    def __init__(self, definition: str, pattern: str):
        model = json.loads(definition)["model"]
        back = {c: b for b, c in enumerate(byte_table())}
        vocab = model["vocab"]
        self.bytes_of = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if merged == sorted(merged):
            import tiktoken

            ids = [*(vocab[c] for c in byte_table()), *merged]
            self.encode = tiktoken.Encoding("side-a", pat_str=pattern, special_tokens={},
                                            mergeable_ranks={self.bytes_of[i]: i for i in ids}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_str(definition)
            whole.encode_special_tokens = True
            self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model at work in one task: ids of `space + text`, and the bytes of its pieces.

    No piece of such a vocabulary goes on into the next word (this is checked), so long texts are encoded in stretches of
    whole words and need no more memory than those.
    """

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_GAP, " ").encode()
                         for i, p in enumerate(pieces)]
        self.by_word = all(_GAP not in p.lstrip(_GAP) for p in pieces)

    def encode(self, text: str) -> list[int]:
        if len(text) <= _STRETCH or not self.by_word:
            return self.model.encode(text, num_threads=1)
        out: list[int] = []
        at = 0  # behind the space that begins the stretch, which the model adds itself
        while True:
            end = text.find(" ", at + _STRETCH)
            while end > 0 and text[end - 1] in (" ", _GAP):
                end = text.find(" ", end + 1)
            out += self.model.encode(text[at:end] if end > 0 else text[at:], num_threads=1)
            if end < 0:
                return out
            if end + 1 == len(text):  # the model adds no space to nothing
                return [*out, self.model.piece_to_id(_GAP)]
            at = end + 1


class Pair:
    """Both tokenizers in one task."""

    def __init__(self, definition: str, pattern: str, proto: bytes):
        self.a, self.b = Bytes(definition, pattern), Pieces(proto)
        self.length_a, self.length_b = (np.array([len(x) for x in own.bytes_of], dtype=np.int64)
                                        for own in (self.a, self.b))
        # the digest's text of an id, where its side goes on and where it ends
        self.shown = [f"{i}{c}" for n, c in ((len(self.length_a), ","), (len(self.length_a), "|"),
                                             (len(self.length_b), ","), (len(self.length_b), ";")) for i in range(n)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides per text; none where the text is empty or a side does not give back its bytes."""
        out = []
        for text in texts:
            raw = (" " + text).encode("utf-8", "surrogatepass")
            a, b = (self.a.encode(" " + text), self.b.encode(text)) if text else ([], [])
            if any(b"".join(map(own.bytes_of.__getitem__, ids)) != raw for own, ids in ((self.a, a), (self.b, b))):
                a = b = []
            out.append((np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)))
        return out


_PAIRS: dict[str, Pair] = {}


def _pair(definition: str, pattern: str, proto: bytes) -> Pair:
    name = hashlib.sha256(b"\0".join([definition.encode(), pattern.encode(), proto])).hexdigest()
    if name not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[name] = Pair(definition, pattern, proto)
    return _PAIRS[name]


def align(ends_a: np.ndarray, ends_b: np.ndarray):
    """Links and groups of two cuts of the same bytes, given the token ends.

    Per link its position in A and in B; the ends that are common, which are the groups' ends; per token of A and of B
    its group. Ends are marked on one array of the bytes, so nothing is sorted.
    """
    marks = [np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, dtype=np.int8) for _ in "ab"]
    for marked, ends in zip(marks, (ends_a, ends_b)):
        marked[ends] = 1
    either = np.flatnonzero(marks[0] | marks[1])
    both = marks[0] & marks[1]
    before = np.cumsum(both, dtype=np.int64) - both
    # a link's position: how many ends of the side lie before the link's end
    at_a, at_b = (np.cumsum(m[either], dtype=np.int64) - m[either] for m in marks)
    return at_a, at_b, np.flatnonzero(both), before[ends_a], before[ends_b]


def _digest_codes(pair: Pair, a, b, ends_a, ends_b, aligned) -> np.ndarray:
    """Numbers into `pair.shown` that spell `a1,a2|b1;...` of all groups in order."""
    *_, common, group_a, group_b = aligned
    n_a, n_b = len(pair.length_a), len(pair.length_b)
    until_a, until_b = (np.cumsum(np.bincount(g, minlength=len(common))) for g in (group_a, group_b))
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    codes[np.arange(len(a)) + np.append(0, until_b[:-1])[group_a]] = a + n_a * (ends_a == common[group_a])
    codes[np.arange(len(b)) + until_a[group_b]] = b + 2 * n_a + n_b * (ends_b == common[group_b])
    return codes


class Run:
    """The texts of one run: statistics and digests per text, and the links sorted by part, B id, A id and text."""

    def __init__(self, pair: Pair, texts: list[str], part_of: np.ndarray):
        n_a = len(pair.length_a)
        ids = pair.encode(texts)
        a, b = (np.concatenate([x[i] for x in ids]) for i in (0, 1))
        ends_a, ends_b = np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b])
        aligned = align(ends_a, ends_b)
        at_a, at_b, common = aligned[:3]
        size_a, size_b = (np.array([len(x[i]) for x in ids], dtype=np.int64) for i in (0, 1))
        # where each text stops, in bytes of the run; texts end where both sides end
        stop = np.concatenate(([0], ends_a))[np.cumsum(size_a)]
        self.n_groups = np.diff(np.searchsorted(common, stop, side="right"), prepend=0)
        self.stats = size_a, size_b, self.n_groups, np.where(size_a > 0, size_a + size_b - self.n_groups, 0)
        codes = _digest_codes(pair, a, b, ends_a, ends_b, aligned)
        cuts = np.cumsum(size_a + size_b)
        self.digests = []
        for lo, hi in zip(np.append(0, cuts[:-1]), cuts):
            shown = "".join(map(pair.shown.__getitem__, codes[lo:hi].tolist()))
            self.digests.append(hashlib.sha256(shown[:-1].encode()).hexdigest() if shown else "")
        slot = np.repeat(np.arange(len(texts)), size_a)[at_a] if len(at_a) else np.zeros(0, dtype=np.int64)
        b_ids = b[at_b]
        slots = max(1, len(texts))
        wide = int(part_of.max(initial=0) + 1) * len(pair.length_b) * n_a * slots
        if wide >= 1 << 63:
            raise ValueError("the vocabularies are too large for one key of 63 bits")
        links = ((part_of[b_ids] * len(pair.length_b) + b_ids) * n_a + a[at_a]) * slots + slot
        links.sort()
        first = np.flatnonzero(np.append(True, links[1:] != links[:-1])) if len(links) else np.zeros(0, dtype=np.int64)
        self.number = np.diff(np.append(first, len(links)))  # per posting
        records = links[first]
        self.slot = records % slots
        keys = records // slots
        entry = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        self.postings = np.diff(np.append(entry, len(keys)))  # per dictionary entry
        self.total = np.add.reduceat(self.number, entry) if len(entry) else entry
        self.key = keys[entry] % (len(pair.length_b) * n_a)
        self.part = keys[entry] // (len(pair.length_b) * n_a)

    def dictionary(self):
        """(part, compressed blocks) of the pairs of this run, in order."""
        cuts = np.flatnonzero(np.append(True, self.part[1:] != self.part[:-1])) if len(self.part) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(self.part)]):
            blocks = []
            for at in range(lo, hi, _BLOCK):
                key, n = self.key[at:min(at + _BLOCK, hi)], self.total[at:min(at + _BLOCK, hi)]
                blocks.append((int(key[0]), _zip(np.diff(key, prepend=0)), _zip(n)))
            yield int(self.part[lo]), pickle.dumps(blocks)

    def posted(self) -> bytes:
        return pickle.dumps((_zip(self.postings.astype(np.uint32)), _zip(self.slot.astype(np.uint16)),
                             _zip(self.number.astype(np.uint32))))


def merged(dictionaries: list[bytes], n_a: int):
    """Merges the dictionaries of all runs in one part; yields (pairs, totals, highest, run, run's totals, highest).

    The heap holds the first key of the next block of every run. Once enough is buffered, all B ids below the heap's
    least key are final. Per run, what is yielded follows the order of its dictionary.
    """
    runs = [pickle.loads(x) for x in dictionaries]
    heap = [(blocks[0][0], r, 0) for r, blocks in enumerate(runs) if blocks]
    heapq.heapify(heap)
    none = np.zeros(0, dtype=np.int64)
    key, number, owner = none, none, none
    while heap or len(key):
        parts, room = [(key, number, owner)], _BUFFER
        while heap and room > 0:
            _, r, i = heapq.heappop(heap)
            _, keys, n = runs[r][i]
            k = np.cumsum(_unzip(keys, np.int64))
            parts.append((k, _unzip(n, np.int64), np.full(len(k), r)))
            runs[r][i] = None
            if i + 1 < len(runs[r]):
                heapq.heappush(heap, (runs[r][i + 1][0], r, i + 1))
            room -= len(k)
        key, number, owner = (np.concatenate(x) for x in zip(*parts))
        done = key < heap[0][0] // n_a * n_a if heap else np.ones(len(key), dtype=bool)
        k, n, r = key[done], number[done], owner[done]
        key, number, owner = key[~done], number[~done], owner[~done]
        if not len(k):
            continue
        pairs, which = np.unique(k, return_inverse=True)
        totals = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(totals, which, n)
        b = pairs // n_a
        side = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        highest = totals == np.repeat(np.maximum.reduceat(totals, side), np.diff(np.append(side, len(b))))
        order = np.lexsort((k, r))
        yield pairs, totals, highest, r[order], totals[which[order]], highest[which[order]]


def _prepared(docs: DataFrame, definition: str, pattern: str, proto: bytes, key: str, text: str):
    spark = docs.sparkSession
    n_a = len(Bytes(definition, pattern).bytes_of)
    n_b = len(Pieces(proto).bytes_of)
    chars = docs.agg(F.sum(F.char_length(text))).first()[0] or 0
    parts = min(_MOST_PARTS, max(1, chars // _PART_CHARS))
    part_of = ((np.arange(n_b, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
    shipped = spark.sparkContext.broadcast((definition, pattern, proto, part_of))
    return shipped, n_a


def _runs(docs: DataFrame, shipped, key: str, text: str) -> DataFrame:
    """Written rows of all runs: per text (run, slot, key, statistics, digest), per part a dictionary, per run postings."""
    kind = docs.schema[key].dataType
    names = ["run", "slot", "part", "key", *STATS, "groups_sha256", "dictionary", "posted"]
    long, string, binary = pa.int64(), pa.string(), pa.binary()

    def work(batches):
        definition, pattern, proto, part_of = shipped.value
        pair = _pair(definition, pattern, proto)
        base, made = TaskContext.get().partitionId() << 32, 0

        def rows(keys, texts):
            run = Run(pair, texts, part_of)
            n = len(texts)
            own = base + made
            empty = [pa.nulls(n, t) for t in (binary, binary)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([own] * n, long), pa.array(range(n), long), pa.nulls(n, long), keys,
                 *[pa.array(x, long) for x in run.stats], pa.array(run.digests, string), *empty], names=names)
            blobs = [(part, blob, None) for part, blob in run.dictionary()]
            if blobs:
                blobs.append((None, None, run.posted()))
            for at in range(0, len(blobs), 64):
                some = blobs[at:at + 64]
                m = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own] * m, long), pa.nulls(m, long), pa.array([x[0] for x in some], long),
                     pa.nulls(m, keys.type), *[pa.nulls(m, long)] * 4, pa.nulls(m, string),
                     pa.array([x[1] for x in some], binary), pa.array([x[2] for x in some], binary)], names=names)

        keys, texts, size = [], [], 0
        for batch in batches:
            taken = 0
            for i, t in enumerate(batch.column(1)):
                t = t.as_py() or ""
                texts.append(t)
                size += len(t)
                if size >= RUN_CHARS or len(texts) >= _RUN_TEXTS:
                    keys.append(batch.column(0).slice(taken, i + 1 - taken))
                    yield from rows(pa.concat_arrays(keys), texts)
                    keys, texts, size, taken, made = [], [], 0, i + 1, made + 1
            if taken < batch.num_rows:
                keys.append(batch.column(0).slice(taken))
        if texts:
            yield from rows(pa.concat_arrays(keys), texts)

    counts = "".join(f"{c} long, " for c in STATS)
    schema = (f"run long, slot long, part long, key {kind.simpleString()}, {counts}groups_sha256 string, "
              "dictionary binary, posted binary")
    return settle(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, schema), "token-runs")


def _dictionaries(runs: DataFrame) -> DataFrame:
    return runs.where("part is not null").select("part", "run", "dictionary")


def alignment_report(docs: DataFrame, definition: str, pattern: str, proto: bytes, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `definition` is a byte-level tokenizer (side A), `proto` a sentencepiece model (side B). `n_best` are the links whose
    pair count is the highest of their B id, ties included; `count_sum` adds the pair counts over the links. Texts that are
    null or empty, or that a side does not give back byte by byte, have zeros and an empty digest. Repeated rows and null
    keys are documents of their own; an empty table gives an empty result; other columns are not read.
    """
    shipped, n_a = _prepared(docs, definition, pattern, proto, key, text)
    runs = _runs(docs, shipped, key, text)

    def count(table):
        owners = table.column("run").to_numpy()
        back = [[] for _ in owners]
        for *_, run, totals, highest in merged(table.column("dictionary").to_pylist(), n_a):
            cuts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            for lo, hi in zip(cuts, [*cuts[1:], len(run)]):
                back[run[lo]].append(totals[lo:hi] * 2 + highest[lo:hi])
        return pa.table({"run": owners, "part": table.column("part"),
                         "back": pa.array([_zip(np.concatenate(x)) for x in back], pa.binary())})

    counted = _dictionaries(runs).groupBy("part").applyInArrow(count, "run long, part long, back binary")

    def give(own, back):
        at = own.column("slot").is_valid()
        rows = own.filter(at)
        slot = rows.column("slot").to_numpy()
        best, sums = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        if len(back):
            parts = back.column("part").to_numpy()
            blobs = back.column("back").to_pylist()
            total = np.concatenate([_unzip(blobs[i], np.int64) for i in np.argsort(parts)])
            posted = pickle.loads(own.filter(own.column("posted").is_valid()).column("posted")[0].as_py())
            postings, where, number = (_unzip(x, k) for x, k in zip(posted, (np.uint32, np.uint16, np.uint32)))
            total = np.repeat(total, postings)
            number = number.astype(np.int64)
            np.add.at(sums, where, number * (total >> 1))
            np.add.at(best, where, number * (total & 1))
        return pa.table([rows.column("key"), *[rows.column(c) for c in STATS], pa.array(best[slot]),
                         pa.array(sums[slot]), rows.column("groups_sha256")], names=result)

    result = [key, *STATS, "n_best", "count_sum", "groups_sha256"]
    kind = docs.schema[key].dataType.simpleString()
    longs = "".join(f"{c} long, " for c in result[1:-1])
    left = runs.where("part is null").select("run", "slot", "key", *STATS, "groups_sha256", "posted")
    return left.groupBy("run").cogroup(counted.groupBy("run")).applyInArrow(
        give, f"`{key}` {kind}, {longs}groups_sha256 string")


def pair_counts(docs: DataFrame, definition: str, pattern: str, proto: bytes, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """The id pairs that are linked anywhere: b_id, a_id, n_links, highest (whether no A id is linked more to that B id)."""
    shipped, n_a = _prepared(docs, definition, pattern, proto, key, text)

    def count(table):
        found = [x[:3] for x in merged(table.column("dictionary").to_pylist(), n_a)]
        pairs, totals, highest = (np.concatenate(x) for x in zip(*found))
        return pa.table({"b_id": pairs // n_a, "a_id": pairs % n_a, "n_links": totals, "highest": highest})

    return _dictionaries(_runs(docs, shipped, key, text)).groupBy("part").applyInArrow(
        count, "b_id long, a_id long, n_links long, highest boolean")


def aligned_groups(docs: DataFrame, definition: str, pattern: str, proto: bytes, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Per group of each row: key, place (from 0), start and end (bytes of space + text), a_ids, b_ids."""
    shipped = docs.sparkSession.sparkContext.broadcast((definition, pattern, proto))
    names = [key, "place", "start", "end", "a_ids", "b_ids"]

    def work(batches):
        pair = _pair(*shipped.value)
        for batch in batches:
            for i, t in enumerate(batch.column(1)):
                (a, b), = pair.encode([t.as_py() or ""])
                if not len(a):
                    continue
                ends_a, ends_b = np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b])
                common = align(ends_a, ends_b)[2]
                lists = [pa.ListArray.from_arrays(np.append(0, np.searchsorted(ends, common, side="right")).astype(np.int32),
                                                  pa.array(ids)) for ids, ends in ((a, ends_a), (b, ends_b))]
                n = len(common)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i] * n, pa.int64())), pa.array(range(n), pa.int64()),
                     pa.array(np.append(0, common[:-1])), pa.array(common), *lists], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        work, f"`{key}` {kind}, place long, start long, end long, a_ids array<long>, b_ids array<long>")
