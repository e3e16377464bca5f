"""Exact n-gram Jaccard join of documents with parity sketches, and the groups that its links make.

A set's shingles are dealt into p pieces by hash; each piece is the XOR of one 64-bit hash word per shingle. (One bit
per shingle would let small pieces agree by chance, more often the larger the corpus is.) A shingle that only one of two
sets has changes one piece, so the number of unequal pieces is at most the symmetric difference. In the size band of the
smaller set the difference of a linked pair is at most d, so of p = d + 1 + e pieces at least e + 1 are equal: sets that
share no piece are not linked. Empty pieces say nothing and are left out, which is safe for a set with at most e of
them; the few sets with more meet under keys of their own. A second sketch has 512 bits, of which each shingle flips
one: its Hamming distance is at most the symmetric difference, too.

Equal sets are one node. Per piece key, the node that shares most becomes the centre, and the others are compared with
it only, as far as sizes and a second sketch allow; components then grow from the verified links. Members of a key that are still outside their centre's
component are compared with that key's other members in the same way. Every pair that shares a key is thus linked, in
one component already, or compared: no link between components is lost.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import give_back
from kerbline.llm.components import components
from kerbline.llm.exact_dedup import fold, repeated, with_hits
from kerbline.session import discard, free_shuffles, settle

_FILTER_WORDS = 1 << 20
_COARSE = 8
_BANDS = [1]
while _BANDS[-1] < 1 << 40:
    _BANDS.append(max(_BANDS[-1] + 1, int(_BANDS[-1] * 1.25)))
#: Band g holds the sizes from _EDGES[g] to _EDGES[g + 1] - 1.
_EDGES = np.array(_BANDS, dtype=np.int64)

#: Keys are counted in so many parts, one after the other.
_KEY_PARTS = 4

#: A task remembers the hashes of about so many words.
_KNOWN_WORDS = 100_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of a public 64-bit hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text, A-Z lower-cased, words between white space.

    `known` remembers hashes of words from text to text.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = {} if known is None else known
    if len(known) > _KNOWN_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(width, len(words))
    x = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        x = _mix(x + h[i:len(words) - k + 1 + i])
    return np.unique(x)


def _band(size: int) -> int:
    return int(np.searchsorted(_EDGES, size, side="right")) - 1


def piece_keys(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The keys under which a set meets every set that it may be linked with, and how many of them the other set has
    at least, in the band of the smaller set, if none of its pieces differs."""
    n, keys, own = len(hashes), [], 0
    if not n:
        return np.zeros(0, dtype=np.int64), 0
    words = _mix(hashes + np.uint64(7))
    for g in range(_band(-(-n * percent // 100)), _band(n) + 1):
        d = (int(_EDGES[g + 1]) - 1) * (100 - percent) // percent
        if not d:
            continue  # only equal sets are linked
        e = 1 + -(-15 * d // 100)
        p = d + 1 + e
        # sorted hashes fall into the pieces in order
        piece = ((hashes >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        bits = np.zeros(p, dtype=np.uint64)
        bits[piece[first].astype(np.int64)] = np.bitwise_xor.reduceat(words, first)
        empty = np.count_nonzero(bits == 0)
        used = np.arange(p) if empty > e else np.flatnonzero(bits)
        keys.append(_mix(bits[used] ^ _mix(np.uint64(g << 34) + used.astype(np.uint64))))
        own = p - min(empty, e)  # the own band comes last
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64), own


def coarse(hashes: np.ndarray) -> np.ndarray:
    """A parity sketch of 512 bits over the whole set."""
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(64 * _COARSE - 1)).astype(np.int64),
                      minlength=64 * _COARSE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Per row: id, n (set size), h1 and h2 (the set's hash), keys, own (keys of its band that count), s0.. (second sketch)."""
    names = ["id", "n", "h1", "h2", "keys", "own", *[f"s{i}" for i in range(_COARSE)]]

    def work(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t, width, known) for t in part.column(1).to_pylist()]
                n = [len(s) for s in sets]
                h1 = np.array([np.add.reduce(s) for s in sets], dtype=np.uint64).view(np.int64)
                h2 = np.array([np.bitwise_xor.reduce(_mix(s + np.uint64(1))) for s in sets], np.uint64).view(np.int64)
                rough = np.array([coarse(s) for s in sets])
                keys, own = zip(*(piece_keys(s, percent) for s in sets))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(own, pa.int64()),
                     *[pa.array(np.ascontiguousarray(rough[:, i])) for i in range(_COARSE)]], names=names)
        known = batch = part = sets = keys = rough = None
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    more = "".join(f", s{i} long" for i in range(_COARSE))
    return docs.select(key, text).mapInArrow(work, f"id {kind}, n long, h1 long, h2 long, keys array<long>, own long" + more)


@contextmanager
def _conf(spark, name: str, value: str):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose whole texts are linked. Only texts that a pair may need are shuffled."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    folded = settle(fold(ids.select(F.xxhash64("id").alias("bit")), _FILTER_WORDS), "paired")
    texts = with_hits(docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(key).alias("__bit")),
                      "__bit", folded, _FILTER_WORDS).where("__hit and id is not null").select("id", "text")
    texts = settle(texts, "paired-texts")
    first = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")

    def work(batches):
        last: dict = {}
        known: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts_a, texts_b = part.column(2), part.column(3)
                kept = []
                for i in range(len(a)):
                    if last.get("id") != b[i] or last.get("text") != texts_b[i]:
                        last = {"id": b[i], "text": texts_b[i], "set": shingles(texts_b[i].as_py(), width, known)}
                    if linked(shingles(texts_a[i].as_py(), width, known), last["set"], percent):
                        kept.append(i)
                yield part.select([0, 1]).take(pa.array(kept, pa.int64()))
        last = known = batch = part = texts_a = texts_b = None
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    # a batch holds two whole texts a row
    with _conf(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "500"):
        found = settle(rows.mapInArrow(work, f"a {kind}, b {kind}"), "verified")
    discard(pairs, folded, texts)
    del pairs, ids, texts, first, second, rows
    free_shuffles(docs.sparkSession)
    return found


def _whole(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Adds `comp` by node; a node without links is its own component."""
    return nodes.join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def _shared(bits: DataFrame) -> DataFrame:
    """(bit, size) of the values that come more than once, written.

    Nearly every key is in one set only: summing up before the shuffle would fill memory and save nothing. Keys go in
    parts by their value, and a part's shuffle is freed before the next, so that the disk holds one part at a time.
    """
    spark = bits.sparkSession
    parts = []
    for part in range(_KEY_PARTS):
        own = bits.where(F.pmod("bit", F.lit(_KEY_PARTS)) == part)
        parts.append(settle(own.repartition("bit").groupBy("bit").agg(F.count("*").alias("size")).where("size > 1"),
                            "shared-keys"))
        del own
        free_shuffles(spark)
    together = settle(reduce(DataFrame.unionAll, parts), "shared-keys")
    discard(*parts)
    return together


def join_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5,
                percent: int = 80) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key reachable by links, itself included).

    Two rows are linked when 100 * shared >= percent * all of their distinct shingles of `width` words; a text with
    fewer words is one shingle; a null text or one without words has none and is linked with nothing. Rows with a null
    key link nothing and have a null component. Repeated rows are linked like other equal texts.
    """
    made = settle(sketches(docs, key, text, width, percent), "sketches")
    rows = settle(made.select(F.col("id").alias("node"), F.col("n").alias("n_shingles")), "set-sizes")
    usable = made.where("n > 0 and id is not null").withColumn("bit", F.xxhash64("h1", "h2"))
    copies = settle(fold(repeated(usable.select("bit")), _FILTER_WORDS), "copies")
    usable = with_hits(usable, "bit", copies, _FILTER_WORDS)
    sketch = ["n", "keys", "own", *[f"s{i}" for i in range(_COARSE)]]
    equal = usable.where("__hit").groupBy("h1", "h2")
    once = settle(equal.agg(F.min("id").alias("node"), *[F.first(c).alias(c) for c in sketch]), "equal-sets")
    same = settle(usable.where("__hit").select("id", "h1", "h2").join(once.select("h1", "h2", "node"), ["h1", "h2"])
                  .where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")), "equal-links")
    nodes = usable.where("not __hit").select(F.col("id").alias("node"), *sketch).unionByName(once.select("node", *sketch))

    keyed = nodes.select("node", F.explode("keys").alias("bit"))
    shared = _shared(keyed.select("bit"))
    folded = settle(fold(shared, _FILTER_WORDS), "shared-bits")
    found_keys = settle(with_hits(keyed, "bit", folded, _FILTER_WORDS).where("__hit").drop("__hit").join(
        shared, "bit"), "members")
    # only these keys are met again: two nodes have no other in common
    by_node = settle(found_keys.groupBy("node").agg(
        F.sum("size").alias("weight"), F.collect_list("bit").alias("keys")), "node-keys")
    about = settle(nodes.drop("keys").join(by_node.select("node"), "node"), "about")
    members = by_node.select(F.explode("keys").alias("key"), "node", "weight")
    discard(made, copies, once, shared, folded, found_keys)
    del made, usable, equal, once, nodes, keyed, shared, folded, found_keys
    free_shuffles(docs.sparkSession)
    centres = settle(members.groupBy("key").agg(
        F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre")), "centres")
    free_shuffles(docs.sparkSession)
    pairs = members.join(centres, "key").where("node <> centre").select(
        F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = pairs.join(_named(about, "a"), "a").join(_named(about, "b"), "b").where(_near(percent)).select("a", "b")
    links = verified(_enough_in_common(pairs, about, by_node, percent), docs, key, text, width, percent)
    found = settle(components(links), "components")
    free_shuffles(docs.sparkSession)

    placed = settle(_whole(members.select("key", "node"), found).join(
        _whole(centres.withColumnRenamed("centre", "node"), found).select("key", F.col("comp").alias("centre_comp")),
        "key"), "placed")
    outside = placed.where("comp <> centre_comp")
    left = outside.select("key", F.col("node").alias("a"), F.col("comp").alias("comp_a")).join(
        _named(about, "a"), "a")
    right = placed.join(outside.select("key").distinct(), "key").select(
        "key", F.col("node").alias("b"), F.col("comp").alias("comp_b")).join(_named(about, "b"), "b")
    more = left.join(right, (left["key"] == right["key"]) & (F.col("comp_a") != F.col("comp_b")) & _near(percent))
    more = more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = links.unionByName(verified(
        _enough_in_common(more, about, by_node, percent), docs, key, text, width, percent)).unionByName(same)
    found = settle(components(links), "components")
    discard(by_node, centres, about, placed, same)
    return _whole(rows, found).select(F.col("node").alias(key), "n_shingles", F.col("comp").alias("component_id"))


def _near(percent: int):
    """Whether sizes and second sketches leave room for a link: |A xor B| <= (|A| + |B|) (100 - p) / (100 + p)."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")))
                                        for i in range(_COARSE)])
    near = apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return near & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))


def _enough_in_common(pairs: DataFrame, about: DataFrame, by_node: DataFrame, percent: int) -> DataFrame:
    """Pairs with as many equal pieces as a link needs: in the band of the smaller set, each of the at most
    (|A| + |B|) (100 - p) / (100 + p) shingles of one set only can make one piece differ. Keys are the bulk of a node, so
    only those are shuffled that other nodes have too, and of nodes that a filter finds in a pair."""
    near = pairs = settle(pairs, "near-pairs")
    free_shuffles(about.sparkSession)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    folded = settle(fold(ids.select(F.xxhash64("id").alias("bit")), _FILTER_WORDS), "in-pairs")
    nodes = settle(with_hits(about.select("node", "n", "own", F.xxhash64("node").alias("__bit")), "__bit", folded,
                             _FILTER_WORDS).where("__hit").drop("__hit", "__bit").join(
        by_node.select("node", "keys"), "node"), "in-pairs")
    free_shuffles(about.sparkSession)
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *[
            F.col(c).alias(f"{c}_{side}") for c in ("n", "own", "keys")]), side)
    own = F.when(F.col("n_a") < F.col("n_b"), F.col("own_a")).when(F.col("n_a") > F.col("n_b"), F.col("own_b")).otherwise(
        F.least("own_a", "own_b"))
    least = own - F.floor((F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent))
    enough = settle(pairs.where(F.size(F.array_intersect("keys_a", "keys_b")) >= least).select("a", "b"), "pairs")
    discard(near, folded, nodes)
    return enough


def _named(about: DataFrame, side: str) -> DataFrame:
    return about.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"),
                        *[F.col(f"s{i}").alias(f"{side}{i}") for i in range(_COARSE)])
