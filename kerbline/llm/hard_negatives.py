"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Candidates are dealt into shards. A shard sorts its rows once per dimension; an anchor reads every list from its own end
(from the top where its component is positive, from the bottom where it is negative), scores each row when it meets it
first, and stops when the sum of what the lists have reached falls strictly below the score that it still needs. Rows
that tie with that score have then been met.

Two passes: the best rows of the anchor's label over all shards are its positives; their scores give the windows in
which the best rows of other labels are looked up. Anchors meet shards in blocks; a shard returns at most as many rows
as are asked for, and windows over them pick the best of all shards.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import settle

_SHARD_ROWS = 2048
_BLOCK_ANCHORS = 4096
_MOST_TASKS = 10_000
_FIRST_READ = 16
#: Integers up to here are exact as doubles.
_EXACT = 1 << 53


class Lists:
    """The rows of a shard with one sorted list per dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((rows, ids))
        self.rows, self.ids, self.labels = rows[order], ids[order], labels[order]
        self.x = x[order]
        self.order = np.argsort(self.x, axis=0, kind="stable").T
        self.values = np.take_along_axis(self.x.T, self.order, 1)
        self.most = [int(max(abs(int(v[0])), abs(int(v[-1])))) for v in self.values]

    def _numbers(self, anchor: np.ndarray):
        """The rows and the anchor in a type in which every score is exact."""
        reach = sum(abs(int(a)) * m for a, m in zip(anchor, self.most))
        if reach >= 1 << 63:
            raise OverflowError("scores of these vectors do not fit 64 bits")
        kind = np.float64 if reach < _EXACT else np.int64
        if self.x.dtype != kind:
            self.x, self.values = self.x.astype(kind), self.values.astype(kind)
        return anchor.astype(kind)

    def read(self, anchor: np.ndarray):
        """Yields (positions met anew, their scores, the highest score that a row not met yet can have).

        Every round reads twice as deep as the one before. After the last there is no such row: the bound is None.
        """
        n = len(self.ids)
        dims = np.flatnonzero(anchor)
        if not len(dims):
            yield np.arange(n), np.zeros(n, dtype=np.int64), None
            return
        a = self._numbers(anchor)
        up, down = dims[a[dims] > 0], dims[a[dims] < 0]
        met, scored = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        depth, step = 0, _FIRST_READ
        while depth < n:
            end = min(n, depth + step)
            met[self.order[up, n - end:n - depth]] = True
            met[self.order[down, depth:end]] = True
            new = np.flatnonzero(met & ~scored)
            scored[new] = True
            reached = a[up] @ self.values[up, n - end] + a[down] @ self.values[down, end - 1]
            depth, step = end, step * 2
            yield new, (self.x[new] @ a).astype(np.int64), None if end == n else int(reached)
            if scored.all():
                return

    def best_of_label(self, row: int, label: int, anchor: np.ndarray, k: int):
        """(positions, scores) of the k best other rows with the anchor's label, ties to the smaller id."""
        at, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for new, found, bound in self.read(anchor):
            mine = (self.labels[new] == label) & (self.rows[new] != row)
            at, scores = np.concatenate((at, new[mine])), np.concatenate((scores, found[mine]))
            top = np.lexsort((at, -scores))[:k]
            at, scores = at[top], scores[top]
            if bound is not None and len(at) == k and bound < scores[-1]:
                break
        return at, scores

    def best_in_windows(self, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int):
        """Per window (lowest, highest score): (positions, scores) of the k best rows of other labels inside it."""
        at, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        lowest = min(lo for lo, _ in windows)
        for new, found, bound in self.read(anchor):
            other = (self.labels[new] != label) & (found >= lowest)
            at, scores = np.concatenate((at, new[other])), np.concatenate((scores, found[other]))
            if bound is not None and all(bound <= hi for _, hi in windows) and all(
                    bound < self._needed(scores, lo, hi, k) for lo, hi in windows):
                break
        out = []
        for lo, hi in windows:
            inside = np.flatnonzero((scores >= lo) & (scores <= hi))
            top = inside[np.lexsort((at[inside], -scores[inside]))[:k]]
            out.append((at[top], scores[top]))
        return out

    @staticmethod
    def _needed(scores: np.ndarray, lo: int, hi: int, k: int) -> int:
        """The k-th best score inside the window so far, or its lowest score while there are fewer."""
        inside = scores[(scores >= lo) & (scores <= hi)]
        return int(np.partition(inside, -k)[-k]) if len(inside) >= k else lo


def usable(vectors: DataFrame, key: str, label: str, vector: str, shift: int, labels: int) -> DataFrame:
    """Distinct (id, label, v): v is floor(256 * x), and the label of ids divisible by `shift` is moved on by one.

    Rows with a null id, label or vector, and those with a null or non-finite component, take no part.
    """
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = F.col(label).cast("long")
    moved = F.when(F.col(key) % shift == 0, (own + 1) % labels).otherwise(own)
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull()).where(~bad)
    return rows.select(F.col(key).cast("long").alias("id"), moved.alias("label"), F.transform(
        x, lambda c: F.floor(F.lit(256.0) * c).cast("long")).alias("v")).distinct()


def _matrix(table: pa.Table) -> np.ndarray:
    v = table.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1).astype(np.int64)


def _small(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type."""
    top = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def _packed(rows: DataFrame, places: int, name: str, columns: list[str]) -> DataFrame:
    """(size, `name`, packed): rows of one vector length and hash in one value of bounded size."""
    def pack(keys, table):
        own = {c: table.column(c).to_pylist() if c == "windows" else table.column(c).to_numpy() for c in columns}
        return pa.table({"size": [keys[0].as_py()], name: [keys[1].as_py()],
                         "packed": pa.array([pickle.dumps(own | {"v": _small(_matrix(table))})], pa.binary())})

    placed = rows.withColumn("size", F.size("v").cast("long")).withColumn(
        name, F.pmod(F.xxhash64("row", F.lit(name)), F.lit(places)))
    return placed.select("size", name, *columns, "v").groupBy("size", name).applyInArrow(
        pack, f"size long, {name} long, packed binary")


def _met(shards: DataFrame, n_shards: int, blocks: DataFrame, n_blocks: int, answer, schema: str) -> DataFrame:
    """Every block of anchors at every shard of its vector length, one pair at a time."""
    tasks = min(_MOST_TASKS, n_shards * n_blocks)

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    keys = ["size", "shard", "block"]
    left = shards.withColumn("block", every(n_blocks)).repartition(tasks, *keys)
    right = blocks.withColumn("shard", every(n_shards)).repartition(tasks, *keys)

    def both(own, asked):
        if not len(own) or not len(asked):
            return pa.schema(answer_fields).empty_table()
        shard = pickle.loads(own.column("packed")[0].as_py())
        lists = Lists(shard["row"], shard["id"], shard["label"], shard["v"].astype(np.int64))
        found = list(answer(lists, pickle.loads(asked.column("packed")[0].as_py())))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * len(answer_fields)
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=[f[0] for f in answer_fields])

    answer_fields = [(f.split()[0], pa.int64()) for f in schema.split(", ")]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(both, schema)


def hard_negatives(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding",
                   every: int = 50, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
                   shift: int = 7, labels: int = 10) -> DataFrame:
    """Per anchor (ids divisible by `every`) and positive: anchor_id, positive_id, rank, negative_id and both scores.

    Scores are inner products of floor(256 * x). Positives are the best other rows of the anchor's label; negatives the
    best rows of other labels whose score is between `window` per cent of the positive's. Ties go to the smaller id.
    Fewer are returned where there are fewer. Rows with nulls or non-finite components take no part; repeated rows count
    once; rows of one id with other contents are rows of their own; vectors are compared with those of their own length;
    an empty table gives an empty result; other columns are not read. Scores beyond 64 bits are an error.
    """
    rows = settle(usable(vectors, key, label, vector, shift, labels).withColumn(
        "row", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where(F.col("id") % every == 0)
    n_shards = max(1, -(-rows.count() // _SHARD_ROWS))
    n_blocks = max(1, -(-anchors.count() // _BLOCK_ANCHORS))
    shards = settle(_packed(rows, n_shards, "shard", ["row", "id", "label"]), "shards")

    def positive(lists, asked):
        for row, own, a in zip(asked["row"], asked["label"], asked["v"].astype(np.int64)):
            at, scores = lists.best_of_label(row, own, a, positives)
            if len(at):
                yield np.full(len(at), row), lists.rows[at], lists.ids[at], scores

    blocks = _packed(anchors, n_blocks, "block", ["row", "label"])
    some = _met(shards, n_shards, blocks, n_blocks, positive, "anchor long, other long, positive_id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "positive_id", "other")
    best = settle(some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")

    lo, hi = window
    # scores below zero leave an empty window
    windows = best.where("score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(
        F.col("place").cast("long").alias("place"), F.expr(f"(score * {lo} + 99) div 100").alias("lo"),
        F.expr(f"score * {hi} div 100").alias("hi")))).alias("windows"))
    asking = anchors.join(windows, anchors["row"] == windows["anchor"]).select("row", "label", "v", "windows")

    def negative(lists, asked):
        for row, own, a, wanted in zip(asked["row"], asked["label"], asked["v"].astype(np.int64), asked["windows"]):
            found = lists.best_in_windows(own, a, [(w["lo"], w["hi"]) for w in wanted], negatives)
            for w, (at, scores) in zip(wanted, found):
                if len(at):
                    yield np.full(len(at), row), np.full(len(at), w["place"]), lists.rows[at], lists.ids[at], scores

    asking = settle(_packed(asking, n_blocks, "block", ["row", "label", "windows"]), "windows")
    some = _met(shards, n_shards, asking, n_blocks, negative,
                "anchor long, place long, other long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.col("negative_score").desc(), "negative_id", "other")
    found = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = best.select("anchor", F.col("place").cast("long").alias("place"), "positive_id",
                        F.col("score").alias("positive_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(named, ["anchor", "place"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
