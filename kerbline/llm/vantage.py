"""Approximate nearest neighbours: a vantage-point tree per shard, searched in blocks of queries.

The largest inner product becomes the smallest distance by one more coordinate: with m the longest norm of a shard, x
gets sqrt(m^2 - |x|^2) and a query 0, so that distance^2 = |q|^2 + m^2 - 2 q.x and the triangle inequality holds. A
child whose points lie between lo and hi of the vantage point is at least max(lo - d, d - hi) away from a query at
distance d; it is left out when `relax` times that exceeds the query's k-th best distance. `relax` = 1 is exact search:
bounds give way by more than rounding can amount to, and vectors whose products are equal up to rounding are told apart
by products summed in one fixed order, then by their smallest id.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import settle

_LEAF = 128
_SHARD_ROWS = 2048
_BLOCK_QUERIES = 4096
_QUERIES_AT_ONCE = 512
_SHARDS_A_TASK = 4
_MOST_TASKS = 10_000
#: Relative to the longest vector: more than rounding can change a distance by, and a product.
_LOOSE = 1e-6
_ROUNDING = 1e-12


class Tree:
    """A vantage-point tree over distinct vectors, each with its smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most_ids: int, seed: int = 3):
        order = np.argsort(ids, kind="stable")
        distinct, first, owner = np.unique(vectors[order], axis=0, return_index=True, return_inverse=True)
        owner = owner.reshape(-1)
        by_owner = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[by_owner], np.arange(len(distinct)))
        ends = np.append(starts[1:], len(owner))
        # equal vectors have equal scores, and ties go to the smaller id: more ids than asked for can never be returned
        self.ids = [np.unique(ids[order][by_owner[a:b]])[:most_ids] for a, b in zip(starts, ends)]
        self.x = distinct
        self.smallest = np.array([own[0] for own in self.ids], dtype=np.int64)
        norms = (distinct * distinct).sum(axis=1)
        self.m2 = float(norms.max())
        self.extra = np.sqrt(np.maximum(self.m2 - norms, 0.0))
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(distinct)))

    def _build(self, at: np.ndarray):
        if len(at) <= _LEAF:
            return at
        v = at[self.rng.integers(len(at))]
        inner = self.x[at] @ self.x[v] + self.extra[at] * self.extra[v]
        d = np.sqrt(np.maximum(2 * self.m2 - 2 * inner, 0.0))
        order = np.argsort(d, kind="stable")
        half = len(at) // 2
        parts = order[:half], order[half:]
        return v, [(d[p].min(), d[p].max(), self._build(at[p])) for p in parts]

    def search(self, q: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """Per query the positions (-1: none) and products of the k nearest distinct vectors found, in no order.

        Of vectors with equal products those with the smaller ids are kept.
        """
        best = np.full((len(q), k), -np.inf)
        where = np.full((len(q), k), -1, dtype=np.int64)
        q2 = (q * q).sum(axis=1)
        longest = np.sqrt(self.m2)
        near = _ROUNDING * np.sqrt(q2) * longest
        waiting = [(self.root, np.arange(len(q)), np.zeros(len(q)))]
        while waiting:
            node, who, least = waiting.pop()
            kth = best[who].min(axis=1)
            reach = np.where(np.isfinite(kth), np.sqrt(np.maximum(q2[who] + self.m2 - 2 * kth, 0.0)), np.inf)
            who = who[relax * least <= reach + _LOOSE * (longest + np.sqrt(q2[who]))]
            if not len(who):
                continue
            if isinstance(node, np.ndarray):
                both = np.concatenate((best[who], q[who] @ self.x[node].T), axis=1)
                names = np.concatenate((where[who], np.broadcast_to(node, (len(who), len(node)))), axis=1)
                if both.shape[1] > k:
                    top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                    kth = np.take_along_axis(both, top, 1).min(axis=1)
                    close = both >= (kth - near[who])[:, None]
                    for i in np.flatnonzero((close.sum(axis=1) > k) & np.isfinite(kth)):
                        top[i] = self._first(np.flatnonzero(close[i]), names[i], q[who[i]], k)
                    both, names = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
                best[who], where[who] = both, names
                continue
            v, children = node
            d = np.sqrt(np.maximum(q2[who] + self.m2 - 2 * (q[who] @ self.x[v]), 0.0))
            bounds = [np.maximum(np.maximum(lo - d, d - hi), 0.0) for lo, hi, _ in children]
            nearer = bounds[0] <= bounds[1]
            for first, chosen in ((0, nearer), (1, ~nearer)):
                if chosen.any():
                    waiting.append((children[1 - first][2], who[chosen], bounds[1 - first][chosen]))
                    waiting.append((children[first][2], who[chosen], bounds[first][chosen]))
        return where, best

    def _first(self, at: np.ndarray, names: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """The k first of the places `at`, by product in a fixed order of summing and then by smallest id."""
        exact = (self.x[names[at]] * q).sum(axis=1)
        return at[np.lexsort((self.smallest[names[at]], -exact))[:k]]

    def nearest(self, names: np.ndarray, q: np.ndarray, k: int, relax: float):
        """Arrays (query number, id, score): the k nearest of each query but itself, scores summed in a fixed order."""
        number, ids, scores = [], [], []
        where, _ = self.search(q, min(k + 1, len(self.x)), relax)
        for i in range(len(q)):
            at = where[i][where[i] >= 0]
            exact = (self.x[at] * q[i]).sum(axis=1)
            found = np.concatenate([self.ids[p] for p in at]) if len(at) else np.zeros(0, dtype=np.int64)
            score = np.repeat(exact, [len(self.ids[p]) for p in at])
            other = found != names[i]
            found, score = found[other], score[other]
            top = np.lexsort((found, -score))[:k]
            number.append(np.full(len(top), i))
            ids.append(found[top])
            scores.append(score[top])
        return np.concatenate(number), np.concatenate(ids), np.concatenate(scores)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct (id, v) with double components: no null id or vector, no null or non-finite component, not all zero."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(key).isNotNull() & v.isNotNull()).where(~bad & F.exists(v, lambda x: x != 0)).select(
        F.col(key).cast("long").alias("id"), v.alias("v")).distinct()


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = table.column("v").combine_chunks()
    return table.column("id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def search(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 20,
           relax: float = 1.2) -> DataFrame:
    """Per query: query_id, rank (from 1), vec_id, score, nearest first, ties to the smaller id.

    Rows that are null, zero or not finite take no part on either side; repeated rows count once; vectors are compared
    with those of their own length; with fewer than k candidates all are returned; empty tables give an empty result.
    Every row is in a tree. Queries meet all shards in blocks; each task returns k rows a query for several shards.
    """
    rows = settle(usable(vectors, key, vector).withColumn("size", F.size("v").cast("long")), "vectors")
    asked = settle(usable(queries, key, vector).withColumn("size", F.size("v").cast("long")), "queries")
    shards = max(1, -(-rows.count() // _SHARD_ROWS))
    blocks = max(1, -(-asked.count() // _BLOCK_QUERIES))
    groups = -(-shards // _SHARDS_A_TASK)

    def plant(keys, table):
        ids, x = _arrays(table)
        return pa.table({"size": [keys[0].as_py()], "part": [keys[1].as_py()],
                         "tree": pa.array([pickle.dumps(Tree(ids, x, k + 1))], pa.binary())})

    def pack(keys, table):
        return pa.table({"size": [keys[0].as_py()], "block": [keys[1].as_py()],
                         "asked": pa.array([pickle.dumps(_arrays(table))], pa.binary())})

    trees = settle(rows.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(shards))).groupBy("size", "part")
                   .applyInArrow(plant, "size long, part long, tree binary"), "trees")
    packed = settle(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("size", "block")
                    .applyInArrow(pack, "size long, block long, asked binary"), "blocks")
    def answer(planted, waiting):
        if not len(planted) or not len(waiting):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        names, q = pickle.loads(waiting.column("asked")[0].as_py())
        found = []
        for i in range(len(planted)):
            tree = pickle.loads(planted.column("tree")[i].as_py())
            for at in range(0, len(names), _QUERIES_AT_ONCE):
                some = names[at:at + _QUERIES_AT_ONCE]
                number, ids, scores = tree.nearest(some, q[at:at + _QUERIES_AT_ONCE], k, relax)
                found.append((some[number], ids, scores))
        query, ids, scores = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        fresh = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(query)) - np.repeat(fresh, np.diff(np.r_[fresh, len(query)]))
        kept = place < k
        return pa.table({"query_id": query[kept], "vec_id": ids[kept], "score": scores[kept]})

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # each pair of a block of queries and a group of trees is a task of its own, as far as there are tasks
    keys, tasks = ["size", "group", "block"], min(_MOST_TASKS, groups * blocks)
    left = trees.withColumn("group", F.pmod("part", F.lit(groups))).withColumn("block", every(blocks))
    right = packed.withColumn("group", every(groups))
    some = left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(
        answer, "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return some.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def neighbour_report(vectors: DataFrame, **options) -> DataFrame:
    """The nearest neighbours of every row whose vec_id is divisible by 20, among all rows.

    Vectors that are null, zero or hold null or non-finite components take no part; ties go to the smaller vec_id; repeated
    rows count once; with fewer candidates all are returned; an empty table gives an empty result.
    """
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0), "vec_id", "embedding", **options)
