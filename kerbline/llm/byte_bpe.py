"""Byte-level BPE: encoding with character offsets and decoding, by the tokenizers library over Arrow batches.

The driver reads the vocabulary once and ships it as text; tasks build the tokenizer from that. A text is encoded as
bytes shown as characters (the byte table); a token's bytes are then as many as its characters, so spans in bytes are
running sums and spans in characters follow from the UTF-8 lead bytes. Characters that are split between tokens belong
to each of them. Decoding joins the bytes before it reads them as UTF-8, so split characters come back whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts are handed to the library in groups of about so many characters.
GROUP_CHARS = 1 << 20
#: A worker remembers the ids of about so many pieces of text.
KNOWN_PIECES = 400_000

#: The bytes that the byte table shows as the character of the same number.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_table() -> list[str]:
    """The character for each byte: itself where it can be shown, else the next one from 256 on."""
    hidden = iter(range(256, 512))
    shown = set(_SHOWN)
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes `token`, when only lower ranks were merged before."""
    parts = [token[i:i + 1] for i in range(len(token))]
    top = ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1))
        if rank >= top:
            raise ValueError(f"rank {top} cannot be reached by merges")
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def from_ranks(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizer definition with these ranks, splitting text by `pattern` first."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    table = byte_table()
    show = {token: "".join(table[b] for b in token) for token in ranks}
    merges = [tuple(show[p] for p in _last_merge(t, ranks)) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    made = Tokenizer(models.BPE(vocab={show[t]: r for t, r in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made.to_str()


def _recent_letters():
    """Tells whether a text has letters or digits too new for Python's own tables, on which pattern engines disagree."""
    import unicodedata

    import regex

    late = "".join(c for c in map(chr, chain(range(0x80, 0xD800), range(0xE000, 0x110000)))
                   if unicodedata.category(c) == "Cn")
    recent = np.zeros(0x110000, dtype=bool)
    recent[[ord(c) for c in regex.findall(r"[\p{L}\p{N}\p{M}]", late)]] = True
    return lambda text: recent[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].any()


class Codec:
    """A tokenizer definition at work in one task.

    Text is split by the pattern here, and the library encodes each distinct piece once: pieces repeat far more often
    than texts do. The memory of pieces is bounded and only saves work.
    """

    def __init__(self, definition: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole = Tokenizer.from_str(definition)
        self.whole.encode_special_tokens = True
        self.pieces = regex.compile(pattern).findall
        self.recent = _recent_letters()
        self.known: dict[str, list[int]] = {}
        back = {c: b for b, c in enumerate(byte_table())}
        vocab = json.loads(definition)["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.length = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, without special tokens."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) <= GROUP_CHARS):
                text = texts[at]
                size += len(text)
                split = text.isascii() or not self.recent(text)
                group.append(self.pieces(text) if split else self.whole.encode(text, add_special_tokens=False).ids)
                at += 1
            if len(self.known) > KNOWN_PIECES:
                self.known.clear()
            new = list({p for pieces in group for p in pieces if p not in self.known and isinstance(p, str)})
            for piece, done in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                self.known[piece] = done.ids
            for pieces in group:
                ready = bool(pieces) and isinstance(pieces[0], int)
                yield pieces if ready else list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end character of each token. A token within a character spans that whole character."""
        ends = np.cumsum(self.length[np.asarray(ids, dtype=np.int64)])
        starts = ends - self.length[np.asarray(ids, dtype=np.int64)]
        if len(text) == (ends[-1] if len(ids) else 0):
            return starts, ends
        lead = (np.frombuffer(text.encode("utf-8"), dtype=np.uint8) & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        return char[starts], char[ends - 1] + 1

    def decode(self, ids: list[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


_CODECS: dict[str, Codec] = {}


def codec(definition: str, pattern: str) -> Codec:
    """One codec per worker process and definition."""
    name = hashlib.sha256(f"{pattern}\n{definition}".encode()).hexdigest()
    if name not in _CODECS:
        _CODECS[name] = Codec(definition, pattern)
    return _CODECS[name]


def _texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(docs: DataFrame, definition: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids, starts, ends (character spans). A null text counts as empty and has no tokens."""
    shipped = docs.sparkSession.sparkContext.broadcast(definition)

    def work(batches):
        own = codec(shipped.value, pattern)
        for batch in batches:
            texts = _texts(batch.column(1))
            ids = list(own.encode(texts))
            spans = [own.spans(t, i) for t, i in zip(texts, ids)]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, ints), pa.array([s[0] for s in spans], ints),
                 pa.array([s[1] for s in spans], ints)], names=[key, "ids", "starts", "ends"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, definition: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Per row of `encoded` (key, ids): key, bytes, text. Bytes that are no UTF-8 become U+FFFD in the text only."""
    shipped = encoded.sparkSession.sparkContext.broadcast(definition)

    def work(batches):
        own = codec(shipped.value, pattern)
        for batch in batches:
            raw = [own.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw])],
                names=[key, "bytes", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(work, f"`{key}` {kind}, bytes binary, text string")


def round_trip(docs: DataFrame, definition: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256, without moving the tokens themselves.

    Null texts count as empty (no tokens, digests of nothing); repeated rows and null keys stay; an empty table gives an
    empty result; other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(definition)

    def work(batches):
        own = codec(shipped.value, pattern)
        shown = [str(i) for i in range(len(own.bytes_of))]
        for batch in batches:
            count, ids_sha, raw_sha = [], [], []
            for ids in own.encode(_texts(batch.column(1))):
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([shown[i] for i in ids]).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(raw_sha, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        work, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
