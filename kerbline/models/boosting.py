"""Boosted trees over binned features, fitted for many models in the same Spark jobs.

Spark ML's boosted trees stop at the first step that gains too little, know no Poisson loss and no penalty, and fit one
model at a time. Here every feature is cut into at most 255 bins once and the rows are packed into blocks, a written
table. Where they are many, one Spark job per tree level serves all models together: tasks sum gradients per node, feature and bin over their
blocks, a shuffle by model adds the sums up, and only the best split of each node comes to the driver. These are many
small jobs on the same blocks, so they run on persisted partitions of blocks (planning a query takes longer than such a
job). Blocks carry the scores of their rows, brought up to date after each round and checkpointed every few rounds, so a
lost executor costs its partitions' last rounds and no more.

Up to eight million rows (some 300 MB of bins) the jobs would take longer than their work: thousands of them, each of which
hands all blocks to Python again. There one task per model makes all its rounds, as many models at a time as there are cores.
It takes from each block as it comes only what its model needs, keeps every node's rows from level to level, counts features
with few bins together, and sums the rows of the smaller of two nodes only: the other has what its parent has more.

The loss on the validation rows is known after every round. A model stops after `patience` rounds without gain and keeps
the trees up to its best round; a shorter ensemble is a prefix of a longer one.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.constants import CATEGORICAL_FEATURES
from kerbline.operators.features import learn_levels
from kerbline.session import discard, settle, shared_dir

LOSSES = ("log", "absolute", "poisson")
_BINS = 256                # bin 0 holds what is missing or unknown
_LEVELS = 254
_BLOCK_ROWS = 1 << 16
_PART_ROWS = 1 << 15       # rows whose scores are brought up to date at once
_TASK_ROWS = 1 << 23       # a table of no more rows takes one task per model
_ROUNDS_BETWEEN_CHECKPOINTS = 10
_STORAGE = StorageLevel.MEMORY_AND_DISK
_JOINT_BINS = 4096         # codes that features counted at once have together at most
_ROWS_PER_JOINT_BIN = 128
_WIDE_BINS = 1 << 16       # the same for nodes with as many rows each; a code has 16 bits
_KEPT_CODES = 1 << 20      # rows up to which both kinds of codes are kept
_RESIDUAL_BINS = 4096      # medians of leaves are exact to one such part of the range
_LEVEL_SMOOTH = 10.0       # fixed value: steadies the order of rare levels
_LEAST_GAIN = 1e-7
_PLACE_OF_BIT = np.zeros((1 << 15) + 1, dtype=np.intp)  # 2 to the k -> k
_PLACE_OF_BIT[1 << np.arange(16)] = np.arange(16)


@dataclass(frozen=True)
class Fit:
    """What to fit: rows with `fold` below `before` (all by default) and a label; nulls have none."""

    name: str
    label: str
    features: tuple[str, ...]
    loss: str = "log"
    trees: int = 600
    rate: float = 0.03
    leaves: int = 15
    min_leaf: int = 30
    l2: float = 1.0
    weight: str | None = None
    before: int | None = None
    patience: int = 10
    tolerance: float = 1e-7

    @property
    def depth(self) -> int:
        return max(2, self.leaves.bit_length())


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1. Masks tell which bins go left."""

    feature: np.ndarray
    mask: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray, depth: int = 64, at: np.ndarray | None = None) -> np.ndarray:
        """The nodes that rows reach in at most `depth` steps, from the root or from `at`."""
        n = bins.shape[1]
        at = np.zeros(n, dtype=np.int64) if at is None else at
        rows, flat = np.arange(n), bins.ravel()
        own = np.arange(len(self.feature))
        # leaves lead to themselves
        leaf = self.feature < 0
        feature, left, right = np.where(leaf, 0, self.feature), np.where(leaf, own, self.left), np.where(leaf, own, self.right)
        goes = np.unpackbits(self.mask, axis=1).ravel().astype(bool)
        for _ in range(min(depth, self.depth())):
            goes_left = goes[at * _BINS + flat[feature[at] * n + rows]]
            at = np.where(goes_left, left[at], right[at])
        return at

    def depth(self) -> int:
        deep = np.zeros(len(self.feature), dtype=np.int64)
        for node in range(len(deep) - 1, -1, -1):  # children come after their parents
            if self.feature[node] >= 0:
                deep[node] = 1 + max(deep[self.left[node]], deep[self.right[node]])
        return int(deep[0]) if len(deep) else 0

    @cached_property
    def _leaves(self) -> tuple[dict[int, np.ndarray], np.ndarray] | None:
        """Per feature and bin the leaves, as bits from left to right, that the splits on it leave open; the leaves' values."""
        order, below, stack = [], {}, [(0, False)]
        while stack:  # left before right; a node's bits are known once both sides are done
            node, done = stack.pop()
            if self.feature[node] < 0:
                below[node] = 1 << len(order)
                order.append(node)
            elif done:
                below[node] = below[self.left[node]] | below[self.right[node]]
            else:
                stack += [(node, True), (self.right[node], False), (self.left[node], False)]
        if len(order) > 64:
            return None
        kind = np.uint16 if len(order) <= 16 else np.uint32 if len(order) <= 32 else np.uint64
        every = (1 << 8 * kind().itemsize) - 1
        open_leaves: dict[int, np.ndarray] = {}
        for node in np.flatnonzero(self.feature >= 0).tolist():
            goes = np.unpackbits(self.mask[node]).astype(bool)
            kept = np.where(goes, kind(every), kind(every ^ below[self.left[node]]))
            place = int(self.feature[node])
            open_leaves[place] = kept & open_leaves[place] if place in open_leaves else kept
        return open_leaves, self.value[order]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_leaves"}  # made again where it is used

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """The value of each row's leaf: the leftmost that no split closes."""
        if self._leaves is None:
            return self.value[self.nodes(bins)]
        open_leaves, values = self._leaves
        if not open_leaves:
            return np.full(bins.shape[1], values[0])
        bits = None
        for place, kept in open_leaves.items():
            own = kept[bins[place]]
            bits = own if bits is None else np.bitwise_and(bits, own, out=bits)
        lowest = bits & (~bits + bits.dtype.type(1))
        if bits.dtype == np.uint16:
            return values[_PLACE_OF_BIT[lowest]]
        return values[np.frexp(lowest.astype(np.float64))[1] - 1]


class Bins:
    """How values become bins: cuts of numbers, levels of categories. Learned without labels."""

    def __init__(self, cuts: dict[str, list[float]], levels: dict[str, list[str]]):
        self.cuts, self.levels = cuts, levels
        self.features = [*cuts, *levels]

    @classmethod
    def learn(cls, table: DataFrame, features: Sequence[str]) -> Bins:
        cats = [c for c in features if c in CATEGORICAL_FEATURES]
        numbers = [c for c in features if c not in cats]
        probs = ", ".join(f"{i / _LEVELS!r}D" for i in range(1, _LEVELS))
        found = table.agg(*[F.expr(f"percentile_approx(nanvl(CAST(`{c}` AS DOUBLE), NULL), array({probs}), 10000)").alias(c)
                            for c in numbers]).first() if numbers else {}
        cuts = {c: sorted({float(x) for x in found[c] or []}) for c in numbers}
        return cls(cuts, learn_levels(table, cats, _LEVELS) if cats else {})

    def size(self, name: str) -> int:
        return (len(self.cuts[name]) + 2) if name in self.cuts else len(self.levels[name]) + 1

    def encode(self, name: str, column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if name in self.levels:
            known = pc.index_in(column.cast(pa.string()), pa.array(self.levels[name], pa.string()))
            return (pc.fill_null(known, -1).to_numpy(zero_copy_only=False) + 1).astype(np.uint8)
        x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        bins = np.searchsorted(np.array(self.cuts[name]), x, side="left") + 1
        return np.where(np.isnan(x), 0, bins).astype(np.uint8)


def _gradients(loss: str, y, f, w):
    if loss == "log":
        p = 1.0 / (1.0 + np.exp(-f))
        return w * (p - y), w * p * (1.0 - p)
    if loss == "poisson":
        mean = np.exp(np.minimum(f, 30.0))
        return w * (mean - y), w * mean
    return w * np.sign(f - y), w


def _losses(loss: str, y, f):
    if loss == "log":
        return np.logaddexp(0.0, f) - y * f
    return np.exp(np.minimum(f, 30.0)) - y * f if loss == "poisson" else np.abs(y - f)


def _outcome(loss: str, f):
    return 1.0 / (1.0 + np.exp(-f)) if loss == "log" else np.exp(np.minimum(f, 30.0)) if loss == "poisson" else f


def best_splits(hist: np.ndarray, sizes: list[int], cats: list[bool], min_leaf: int, l2: float):
    """Per node the best (gain, feature, bins that go left, sums left, sums right) or None.

    `hist` is [node, bin of all features in turn, (gradient, hessian, rows)]. Numbers split between neighbouring bins with
    missing values on either side; levels are first put in order of their mean gradient.
    """
    n = len(hist)
    wide = np.zeros((3, n, len(sizes), _BINS))
    for place, (size, end) in enumerate(zip(sizes, np.cumsum(sizes))):
        wide[:, :, place, :size] = hist[:, end - size:end].transpose(2, 0, 1)
    cats = np.array(cats, dtype=bool)
    total = wide[:, :, :1].sum(axis=3)
    natural = np.broadcast_to(np.arange(_BINS), wide.shape[1:])
    first = natural
    ordered = wide
    if cats.any():
        first = natural.copy()
        some = wide[:, :, cats]
        slope = np.where(some[2] > 0, some[0] / (some[1] + _LEVEL_SMOOTH), np.inf)
        first[:, cats] = np.argsort(slope, axis=2, kind="stable")
        ordered = wide.copy()
        ordered[:, :, cats] = np.take_along_axis(some, first[None, :, cats], 3)
    # without missing values both sides are the same
    with_missing = np.flatnonzero(~cats & (wide[2, :, :, 0] > 0).any(axis=0))
    sides = [(first, ordered, np.arange(len(sizes)))]
    if len(with_missing):
        sides.append((np.roll(natural, -1, axis=2), np.roll(wide[:, :, with_missing], -1, axis=3), with_missing))
    tried = []
    for order, sums, columns in sides:
        left = np.cumsum(sums, axis=3)
        right = total[..., None] - left
        fair = ((left[2] >= max(1, min_leaf)) & (right[2] >= max(1, min_leaf))
                & (left[1] > 1e-9) & (right[1] > 1e-9))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2)
                    - (total[0] ** 2 / (total[1] + l2))[..., None])
        gain = np.where(fair, gain, -np.inf).reshape(n, -1)
        at = gain.argmax(axis=1) if gain.shape[1] else np.zeros(n, dtype=np.int64)
        tried.append((gain, at, columns, order, left, right))
    best: list = []
    for node in range(n):
        found = None
        for gain, at, columns, order, left, right in tried:
            if not len(columns) or gain[node, at[node]] <= (found[0] * (1 + 1e-12) if found else _LEAST_GAIN):
                continue
            column, cut = divmod(int(at[node]), _BINS)
            goes = np.zeros(_BINS, dtype=bool)
            goes[order[node, columns[column], :cut + 1]] = True
            found = (float(gain[node, at[node]]), int(columns[column]), np.packbits(goes), left[:, node, column, cut],
                     right[:, node, column, cut])
        best.append(found)
    return best


class _Growing:
    """A tree while it grows: the driver's side of one model's round."""

    def __init__(self):
        self.feature, self.mask, self.left, self.right = [-1], [np.zeros(_BINS // 8, np.uint8)], [0], [0]
        self.sums: list = [None]
        self.open = [0]

    def split(self, found: list, leaves: int) -> None:
        """Takes the splits with the highest gains, as many as leaves are left."""
        room = leaves - sum(f < 0 for f in self.feature)
        ranked = sorted((i for i, x in enumerate(found) if x), key=lambda i: (-found[i][0], i))[:max(0, room)]
        before, self.open = self.open, []
        for i in sorted(ranked):
            _, place, mask, left, right = found[i]
            node = before[i]
            self.feature[node], self.mask[node] = place, mask
            for side, sums in ((self.left, left), (self.right, right)):
                side[node] = len(self.feature)
                self.open.append(len(self.feature))
                self.feature.append(-1)
                self.mask.append(np.zeros(_BINS // 8, np.uint8))
                self.left.append(0)
                self.right.append(0)
                self.sums.append(sums)

    def tree(self, values: np.ndarray) -> Tree:
        return Tree(np.array(self.feature), np.array(self.mask), np.array(self.left), np.array(self.right), values)


@dataclass
class Boosted:
    """A fitted ensemble. `curve` is the validation loss before the first tree and after each."""

    features: list[str]
    bins: Bins
    loss: str
    base: float
    trees: list[Tree]
    curve: list[float] = field(default_factory=list)

    def best_of(self, most: int) -> int:
        """The number of trees that an ensemble of at most `most` trees keeps."""
        if not self.curve or not np.isfinite(self.curve[0]):
            return min(most, len(self.trees))
        return int(np.argmin(self.curve[:most + 1]))

    def raw(self, bins: np.ndarray, most: int | None = None) -> np.ndarray:
        out = np.full(bins.shape[1], self.base)
        for tree in self.trees[:self.best_of(len(self.trees) if most is None else most)]:
            out += tree.predict(bins)
        return out

    def outcome(self, bins: np.ndarray, most: int | None = None) -> np.ndarray:
        return _outcome(self.loss, self.raw(bins, most))

    def to_json(self) -> str:
        trees = [[t.feature.tolist(), [m.tobytes().hex() for m in t.mask], t.left.tolist(), t.right.tolist(), t.value.tolist()]
                 for t in self.trees]
        return json.dumps({"features": self.features, "cuts": self.bins.cuts, "levels": self.bins.levels, "loss": self.loss,
                           "base": self.base, "trees": trees, "curve": self.curve})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        d = json.loads(text)
        trees = [Tree(np.array(f), np.array([np.frombuffer(bytes.fromhex(x), np.uint8) for x in m]), np.array(a), np.array(b),
                      np.array(v)) for f, m, a, b, v in d["trees"]]
        return cls(d["features"], Bins(d["cuts"], d["levels"]), d["loss"], d["base"], trees, d["curve"])


def scored(df: DataFrame, models: dict[str, Boosted | tuple[Boosted, int]]) -> DataFrame:
    """Adds one column per model: the probability (log), the mean (poisson) or the value (absolute).

    A pair (model, most) scores the ensemble of at most so many trees.
    """
    shipped = df.sparkSession.sparkContext.broadcast(
        {name: m if isinstance(m, tuple) else (m, None) for name, m in models.items()})
    names = [*df.columns, *models]

    def work(batches):
        for batch in batches:
            bins: dict = {}

            def encoded(model):
                rows = []
                for c in model.features:
                    key = c, id(model.bins)
                    if key not in bins:
                        bins[key] = model.bins.encode(c, batch.column(batch.schema.get_field_index(c)))
                    rows.append(bins[key])
                return np.array(rows, dtype=np.uint8).reshape(len(rows), batch.num_rows)

            made = [pa.array(model.outcome(encoded(model), most)) for model, most in shipped.value.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema)
    return df.mapInArrow(work, kinds + "".join(f", `{n}` double" for n in models))


def _work(fit: Fit) -> tuple:
    """Orders fits of one table by the work they are likely to be: rows, then features, trees and depth."""
    return float("inf") if fit.before is None else fit.before, len(fit.features) * fit.trees * fit.depth, 1 / fit.rate


def _add(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def _grown(fit: Fit, g: _Growing, medians: np.ndarray | None) -> Tree:
    """The tree with its leaves' values: medians, or Newton steps from the sums."""
    values = medians if medians is not None else np.array([0.0 if s is None else -s[0] / (s[1] + fit.l2) for s in g.sums])
    return g.tree(fit.rate * np.where(np.array(g.feature) < 0, values, 0.0))


def _joined(sizes: list[int], most: int) -> list[list[int]]:
    """Features in groups whose bins together make few enough codes: a group is counted at once."""
    groups: list[list[int]] = []
    codes: list[int] = []
    for place in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        group = next((i for i, n in enumerate(codes) if n * sizes[place] <= most), len(groups))
        if group == len(groups):
            groups.append([])
            codes.append(1)
        groups[group].append(place)
        codes[group] *= sizes[place]
    return groups


def _taken(fit: dict, shape: tuple[int, int], n: int, bins, values) -> list[list[np.ndarray]]:
    """Bins, labels and weights of a block's rows that a model trains on, then of those that validate."""
    features, numbers = shape
    values = np.frombuffer(values, np.float64).reshape(numbers, n)
    y, fold, validates = values[fit["y"]], values[-2], values[-1] > 0
    w = np.broadcast_to(1.0, n) if fit["w"] is None else values[fit["w"]]
    usable = ~np.isnan(y) & ~np.isnan(w) & (fold < fit["before"])
    own = np.frombuffer(bins, np.uint8).reshape(features, n)[fit["at"]]
    return [[own[:, rows], y[rows], w[rows]] for rows in (usable & ~validates, usable & validates)]


class _Rows:
    """All rows that a model trains on or validates with: their bins, labels, weights and scores.

    While a tree grows, `parts` holds the training rows of each node that can still be split, in their order, and `closed`
    those of the other leaves.
    """

    def __init__(self, blocks: Iterable[tuple], fit: dict, shape: tuple[int, int]):
        self._gather([_taken(fit, shape, *block) for block in blocks], fit)

    @classmethod
    def arriving(cls, batches, fit: dict, shape: tuple[int, int]) -> _Rows:
        """From batches of numbered blocks, put in the order of their numbers; a block goes before the next comes."""
        taken = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number, n, bins, values = (c[i] for c in batch.columns)
                taken[number.as_py()] = _taken(fit, shape, n.as_py(), bins.as_buffer(), values.as_buffer())
        rows = cls.__new__(cls)
        rows._gather([taken.pop(number) for number in sorted(taken)], fit)
        return rows

    def _gather(self, taken: list, fit: dict) -> None:
        taken = taken or [[[np.zeros((len(fit["at"]), 0), np.uint8), np.zeros(0), np.zeros(0)] for _ in range(2)]]

        def whole(side: int, k: int) -> np.ndarray:
            found = np.concatenate([t[side][k] for t in taken], axis=-1)
            for t in taken:
                t[side][k] = None
            return found

        (self.bins, self.y), (self.valid_bins, self.valid_y) = [[whole(side, k) for k in range(2)] for side in (0, 1)]
        self.w, self.valid_w = [np.broadcast_to(1.0, len(y)) if fit["w"] is None else whole(side, 2)
                                for side, y in ((0, self.y), (1, self.valid_y))]

    def start(self, base: float, sizes: list[int]) -> None:
        self.f, self.valid_f = np.full(len(self.y), base), np.full(len(self.valid_y), base)
        self.sizes = sizes
        self.groups = _joined(sizes, min(_JOINT_BINS, max(_BINS, len(self.y) // _ROWS_PER_JOINT_BIN)))
        self.wide_groups = _joined(sizes, _WIDE_BINS) if len(self.y) >= _WIDE_BINS else None
        self.wide_codes = [self._code(group) for group in self.wide_groups or []]
        # beside millions of rows' wide codes the others are for few rows at a time, and made when they are asked for
        self.codes = None if len(self.y) > _KEPT_CODES else [self._code(group) for group in self.groups]
        self.root_rows = None
        self.start_round()

    def _code(self, group: list[int], own: np.ndarray | None = None) -> np.ndarray:
        """The code in a group of every row, or of the rows in `own`."""
        code = np.zeros(len(self.y) if own is None else len(own), np.uint16)
        for place in group:
            code *= np.uint16(self.sizes[place])
            code += self.bins[place] if own is None else self.bins[place].take(own)
        return code

    def coded(self, own: np.ndarray | None, n_open: int):
        """Groups and codes of the rows in `own` (all by default): fewer groups of more codes where nodes have rows enough, as
        passes over the rows then cost most."""
        if self.wide_groups and (len(self.y) if own is None else len(own)) >= n_open * _WIDE_BINS:
            groups, codes = self.wide_groups, self.wide_codes
        elif self.codes is None:
            for group in self.groups:
                yield group, self._code(group, own)
            return
        else:
            groups, codes = self.groups, self.codes
        for group, code in zip(groups, codes):
            yield group, code if own is None else code.take(own)

    def gradients(self, loss: str) -> tuple[np.ndarray, np.ndarray]:
        """Of all training rows, a part at a time: what is made in between stays small."""
        g, h = np.empty(len(self.y)), np.empty(len(self.y))
        for start in range(0, len(g), _PART_ROWS):
            part = slice(start, start + _PART_ROWS)
            g[part], h[part] = _gradients(loss, self.y[part], self.f[part], self.w[part])
        return g, h

    def start_round(self) -> None:
        self.parts, self.closed = {0: None}, {}  # all rows

    def step(self, grown: _Growing, opened: list[int]) -> None:
        """Rows of nodes that were split go to the nodes below."""
        for node in opened:
            rows = self.parts.pop(node)
            place = grown.feature[node]
            if place < 0:
                self.closed[node] = rows
                continue
            goes = np.unpackbits(grown.mask[node]).astype(bool)
            goes = goes[self.bins[place] if rows is None else self.bins[place].take(rows)]
            for below, side in ((grown.left[node], goes), (grown.right[node], ~goes)):
                at = np.flatnonzero(side)
                self.parts[below] = at.astype(np.uint32) if rows is None else rows.take(at)

    def leaves(self) -> np.ndarray:
        """The node of every training row."""
        at = np.zeros(len(self.y), dtype=np.int32)
        for node, rows in (*self.closed.items(), *self.parts.items()):
            at[slice(None) if rows is None else rows] = node
        return at

    def add(self, tree: Tree, at: np.ndarray) -> None:
        """Brings the scores up to date; the training rows are in their leaves already."""
        for start in range(0, len(at), _PART_ROWS):
            part = slice(start, start + _PART_ROWS)
            self.f[part] += tree.value[at[part]]
        self.valid_f += tree.predict(self.valid_bins)


def _histogram(rows: _Rows, g: np.ndarray, h: np.ndarray, opened: list[int]) -> np.ndarray:
    """[open node, bin of all features in turn, (gradient, hessian, rows)], counted by groups of features.

    The root has the same rows in every round, so they are counted once.
    """
    n_open, ends = len(opened), np.cumsum(rows.sizes)
    hist = np.zeros((n_open, sum(rows.sizes), 3))
    parts = [rows.parts[node] for node in opened]
    own = None if parts[0] is None else np.concatenate(parts).astype(np.intp)
    limits = [0, len(rows.y)] if own is None else np.cumsum([0, *map(len, parts)]).tolist()
    spans = [slice(*x) for x in zip(limits, limits[1:])]
    weights = [g, h, None] if own is None else [g.take(own), h.take(own), None]
    if own is None and rows.root_rows is not None:
        hist[..., 2] = rows.root_rows
        weights.pop()

    for group, codes in rows.coded(own, n_open):
        sizes = [rows.sizes[place] for place in group]
        width = int(np.prod(sizes))
        code = codes.astype(np.intp)
        sums = np.empty((len(weights), n_open, width))
        for k, x in enumerate(weights):
            for node, span in enumerate(spans):
                sums[k, node] = np.bincount(code[span], None if x is None else x[span], minlength=width)
        for place, size in zip(group, sizes):  # a feature's own sums, then the others' without it
            sums = sums.reshape(len(weights), n_open, size, -1)
            hist[:, ends[place] - size:ends[place], :len(weights)] = sums.sum(axis=3).transpose(1, 2, 0)
            sums = sums.sum(axis=2)
    if own is None:
        rows.root_rows = hist[..., 2].copy()
    return hist


def _histograms_below(rows: _Rows, g: np.ndarray, h: np.ndarray, opened: list[int], above: np.ndarray) -> np.ndarray:
    """The same for pairs of nodes, a left and a right one of each row of `above`: the rows of the smaller node are summed,
    the other has the rest."""
    pairs = list(zip(opened[::2], opened[1::2]))
    fewer = [int(len(rows.parts[left]) > len(rows.parts[right])) for left, right in pairs]
    counted = _histogram(rows, g, h, [pair[side] for pair, side in zip(pairs, fewer)])
    rest = above - counted
    rest[rest[..., 2] == 0] = 0.0  # what rounding leaves in empty bins
    hist = np.empty((len(opened), *above.shape[1:]))
    at = np.arange(len(pairs))
    hist[2 * at + fewer], hist[2 * at + 1 - np.array(fewer)] = counted, rest
    return hist


def _residual_parts(rest: np.ndarray, leaf: np.ndarray, w: np.ndarray, reach: tuple[float, float], leaves: int) -> np.ndarray:
    """Weights per leaf over equal parts of the range of what is left to explain."""
    low, high = reach
    part = np.clip((rest - low) / max(high - low, 1e-12) * _RESIDUAL_BINS, 0, _RESIDUAL_BINS - 1).astype(np.int64)
    leaf = leaf.astype(np.int64)
    return np.bincount(leaf * _RESIDUAL_BINS + part, w, minlength=leaves * _RESIDUAL_BINS).reshape(leaves, -1)


def _base(loss: str, weight: float, total: float) -> float:
    """The log odds or the log mean."""
    mean = total / weight if weight else 0.0
    if loss == "log":
        odds = min(max(mean, 1e-9), 1 - 1e-9)
        return float(np.log(odds / (1 - odds)))
    return float(np.log(max(mean, 1e-9)))


def _rounds(rows: _Rows, fit: Fit, sizes: list[int], cats: list[bool]) -> tuple[float, list[Tree], list[float]]:
    """Base score, trees and losses of one model whose rows are all here."""
    base, reach = 0.0, (0.0, 0.0)
    if fit.loss != "absolute":
        base = _base(fit.loss, rows.w.sum(), (rows.w * rows.y).sum())
    elif len(rows.y):
        reach = float(rows.y.min()), float(rows.y.max())
        none = np.zeros(len(rows.y), dtype=np.int64)
        base = float(_medians({"reach": reach}, (_residual_parts(rows.y, none, rows.w, reach, 1),))[0])
        reach = reach[0] - reach[1], reach[1] - reach[0]
    rows.start(base, sizes)
    trees: list[Tree] = []
    curve: list[float] = []
    weight = float(rows.valid_w.sum())
    while True:
        lost = float((rows.valid_w * _losses(fit.loss, rows.valid_y, rows.valid_f)).sum())
        curve.append(lost / weight if weight else np.nan)
        if len(trees) >= fit.trees or is_over(curve, fit.patience, fit.tolerance):
            break
        rows.start_round()
        g, h = rows.gradients(fit.loss)
        grown, level = _Growing(), 0
        while grown.open and level < fit.depth:
            opened = grown.open
            if not level:
                hist = _histogram(rows, g, h, opened)
                grown.sums[0] = hist[0, :sizes[0]].sum(axis=0)
            else:
                hist = _histograms_below(rows, g, h, opened, hist[above])
            grown.split(best_splits(hist, sizes, cats, fit.min_leaf, fit.l2), fit.leaves)
            above = [i for i, node in enumerate(opened) if grown.feature[node] >= 0]
            rows.step(grown, opened)
            level += 1
        if len(grown.feature) == 1:  # no split is left that gains anything
            break
        medians, at = None, rows.leaves()
        if fit.loss == "absolute":
            parts = _residual_parts(rows.y - rows.f, at, rows.w, reach, len(grown.feature))
            medians = _medians({"reach": reach}, (parts,))
        trees.append(_grown(fit, grown, medians))
        rows.add(trees[-1], at)
    return base, trees, curve


def is_over(curve: Sequence[float], patience: int, tolerance: float) -> bool:
    """Whether the last `patience` rounds have gained nothing. Without validation rows (no loss) it never is."""
    if not curve or not np.isfinite(curve[0]):
        return False
    best, since = curve[0], 0
    for loss in curve[1:]:
        best, since = (loss, 0) if loss < best - tolerance else (best, since + 1)
    return since >= patience


class _Trainer:
    def __init__(self, table: DataFrame, fits: Sequence[Fit], fold: str | None, validation: str | None):
        self.fits, self.parts = list(fits), 1
        self.spark = table.sparkSession
        shared_dir(self.spark)
        features = sorted({c for f in fits for c in f.features})
        self.bins = Bins.learn(table, features)
        self.place = {c: i for i, c in enumerate(self.bins.features)}
        self.numbers = sorted({c for f in fits for c in (f.label, f.weight) if c})
        marks = [F.col(fold).cast("double") if fold else F.lit(-1.0),
                 F.col(validation).cast("double") if validation else F.lit(0.0)]
        self.packed = self._packed(table.select(
            *self.bins.features, *[F.col(c).cast("double").alias(f"__y{i}") for i, c in enumerate(self.numbers)],
            *[m.alias(f"__m{i}") for i, m in enumerate(marks)]))

    def _packed(self, rows: DataFrame) -> DataFrame:
        """Written blocks of rows: an id, n, bins and numbers."""
        bins, n_numbers = self.bins, len(self.numbers) + 2

        def block(number, waiting):
            table = pa.Table.from_batches(waiting)
            coded = np.array([bins.encode(c, table.column(i)) for i, c in enumerate(bins.features)], np.uint8)
            numbers = np.array([table.column(len(bins.features) + i).to_numpy() for i in range(n_numbers)], np.float64)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([len(table)], pa.int64()), pa.array([coded.tobytes()], pa.binary()),
                 pa.array([numbers.tobytes()], pa.binary())], names=["block", "n", "bins", "numbers"])

        def work(batches):
            number, waiting, size = TaskContext.get().partitionId() << 32, [], 0
            for batch in batches:
                waiting.append(batch)
                size += batch.num_rows
                if size >= _BLOCK_ROWS:
                    yield block(number, waiting)
                    number, waiting, size = number + 1, [], 0
            if size:
                yield block(number, waiting)

        self.n_rows = rows.count()
        full = max(1, -(-self.n_rows // _BLOCK_ROWS))
        return settle(rows.coalesce(full).mapInArrow(work, "block long, n long, bins binary, numbers binary"), "boost-rows")

    def _dealt(self):
        """Blocks with scores, one copy per part of the models, which are as many as keep all cores busy; with many blocks one."""
        packed = self.packed.drop("block")
        cores = self.spark.sparkContext.defaultParallelism
        n_blocks = packed.count()
        self.parts = max(1, min(len(self.fits), -(-cores // max(1, n_blocks))))
        self.tasks = max(1, min(4 * cores, n_blocks * self.parts))
        every = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)))
        table = settle(packed.withColumn("part", every).repartition(self.tasks), "boost-blocks")
        return table.rdd.map(lambda r: (r["part"], r["n"], bytes(r["bins"]), bytes(r["numbers"]), {})).persist(_STORAGE)

    def _context(self, active: Sequence[int]) -> dict:
        """What tasks need to know of the models at work."""
        fits = {}
        for i in active:
            f = self.fits[i]
            fits[i] = {"at": [self.place[c] for c in f.features], "loss": f.loss, "y": self.numbers.index(f.label),
                       "w": self.numbers.index(f.weight) if f.weight else None,
                       "before": float("inf") if f.before is None else f.before, "base": self.base.get(i, 0.0),
                       "sizes": [self.bins.size(c) for c in f.features], "min_leaf": f.min_leaf, "l2": f.l2,
                       "cats": [c in self.bins.levels for c in f.features]}
        return {"fits": fits, "parts": self.parts, "count": len(self.fits), "shape": (len(self.bins.features), len(self.numbers) + 2)}

    def _job(self, context: dict, each, finish, merge=_add):
        """{model: finish(what is needed of the model, sums over all blocks)}; `each` yields (model, sums) per block."""
        fits = context["fits"]
        sums = self.blocks.flatMap(lambda row: each(_Block(row, context))).reduceByKey(merge, min(len(fits), self.tasks))
        return dict(sums.map(lambda x: (x[0], finish(fits[x[0]], x[1]))).collect())

    def _begin(self) -> None:
        """Base scores: the log odds, the log mean, or the median."""
        def totals(block):
            for i, fit in block.fits():
                y, w, train, _ = block.target(fit)
                y, w = y[train], w[train]
                yield i, (w.sum(), (w * y).sum(), y.min(initial=np.inf), y.max(initial=-np.inf), len(y))

        def summed(a, b):
            return (a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3]), a[4] + b[4])

        every = range(len(self.fits))
        sums = self._job(self._context(every), totals, lambda _, x: x, summed)
        self.reach = {}
        for i, f in enumerate(self.fits):
            weight, total, low, high, n = sums.get(i, (0.0, 0.0, 0.0, 0.0, 0))
            if f.loss != "absolute":
                self.base[i] = _base(f.loss, weight, total)
            else:
                self.reach[i] = (float(low), float(high)) if n else (0.0, 0.0)
        middle = [i for i in every if i in self.reach]
        if middle:
            context = self._context(middle)
            for i in middle:
                context["fits"][i]["reach"] = self.reach[i]
            found = self._job(context, _residuals, _medians)
            for i in middle:
                self.base[i] = float(found[i][0]) if i in found else 0.0
                span = self.reach[i][1] - self.reach[i][0]
                self.reach[i] = -span, span

    def _made(self, f: Fit) -> DataFrame:
        """All rounds of one model in one task: base score, trees and losses, pickled."""
        known = self._context([self.fits.index(f)])
        fit, = known["fits"].values()

        def work(batches):
            made = _rounds(_Rows.arriving(batches, fit, known["shape"]), f, fit["sizes"], fit["cats"])
            yield pa.RecordBatch.from_arrays([pa.array([f.name]), pa.array([pickle.dumps(made)], pa.binary())], names=["name", "made"])

        return self.packed.coalesce(1).mapInArrow(work, "name string, made binary")

    def _fitted(self, f: Fit) -> tuple[float, list[Tree], list[float]]:
        if self.n_rows:
            return pickle.loads(self._made(f).first()["made"])
        known = self._context([self.fits.index(f)])
        fit, = known["fits"].values()
        return _rounds(_Rows([], fit, known["shape"]), f, fit["sizes"], fit["cats"])

    def _fitted_together(self, fits: list[Fit]) -> dict[str, tuple[float, list[Tree], list[float]]]:
        """All models in one stage: Spark deals its tasks over the executors in turn, where jobs of one task each could meet
        in the memory of one executor."""
        found = reduce(DataFrame.union, [self._made(f) for f in fits]).collect()
        return {r["name"]: pickle.loads(r["made"]) for r in found}

    def _boosted(self, f: Fit, base: float, trees: list[Tree], curve: list[float]) -> Boosted:
        return Boosted(list(f.features), self._own_bins(f), f.loss, base, trees[:self._kept(curve, len(trees))], curve)

    def run(self) -> dict[str, Boosted]:
        self.base: dict[int, float] = {}
        if self.n_rows <= _TASK_ROWS:
            # the longest first, so that no core waits long for the last model
            longest_first = sorted(self.fits, key=_work, reverse=True)
            if self.n_rows > _KEPT_CODES:
                made = self._fitted_together(longest_first)
            else:
                with ThreadPool(min(len(self.fits), self.spark.sparkContext.defaultParallelism)) as pool:
                    made = dict(pool.imap_unordered(lambda f: (f.name, self._fitted(f)), longest_first))
            discard(self.packed)
            return {f.name: self._boosted(f, *made[f.name]) for f in self.fits}
        self.blocks = self._dealt()
        self.older: list = []
        self._begin()
        trees: dict[int, list[Tree]] = {i: [] for i in range(len(self.fits))}
        curve: dict[int, list[float]] = {i: [] for i in trees}
        active = list(trees)
        while active:
            growing = {i: _Growing() for i in active}
            level = 0
            while True:
                asked = [i for i in active if growing[i].open and level < self.fits[i].depth]
                if not asked:
                    break
                context = self._context(asked)
                for i in asked:
                    g = growing[i]
                    context["fits"][i] |= {"tree": g.tree(np.zeros(len(g.feature))), "open": g.open, "level": level}
                found = self._job(context, _histograms, _splits)
                for i in asked:
                    loss, total, splits = found.get(i, (np.nan, np.zeros(3), []))
                    if not level:
                        growing[i].sums[0] = total
                        curve[i].append(loss)
                        if self._is_done(i, curve[i], len(trees[i])):
                            active.remove(i)
                            growing[i].open = []
                            continue
                    growing[i].split(splits, self.fits[i].leaves)
                level += 1
            self._finish_round(active, growing, trees)
        for blocks in [*self.older, self.blocks]:
            blocks.unpersist()
        return {f.name: self._boosted(f, self.base[i], trees[i], curve[i]) for i, f in enumerate(self.fits)}

    def _own_bins(self, f: Fit) -> Bins:
        return Bins({c: v for c, v in self.bins.cuts.items() if c in f.features},
                    {c: v for c, v in self.bins.levels.items() if c in f.features})

    @staticmethod
    def _kept(curve: list[float], made: int) -> int:
        return int(np.argmin(curve)) if curve and np.isfinite(curve[0]) else made

    def _is_done(self, i: int, curve: list[float], made: int) -> bool:
        fit = self.fits[i]
        return made >= fit.trees or is_over(curve, fit.patience, fit.tolerance)

    def _finish_round(self, active, growing, trees) -> None:
        grown = [i for i in active if len(growing[i].feature) > 1]
        medians = {}
        middle = [i for i in grown if self.fits[i].loss == "absolute"]
        if middle:
            context = self._context(middle)
            for i in middle:
                g = growing[i]
                context["fits"][i] |= {"tree": g.tree(np.zeros(len(g.feature))), "reach": self.reach[i]}
            medians = self._job(context, _residuals, _medians)
        for i in list(active):
            fit, g = self.fits[i], growing[i]
            if i not in grown:  # no split is left that gains anything
                active.remove(i)
                continue
            tree = _grown(fit, g, medians.get(i))
            trees[i].append(tree)
        if active:
            self._add_trees({i: trees[i][-1] for i in active}, len(trees[active[0]]))

    def _add_trees(self, made: dict[int, Tree], rounds: int) -> None:
        """Brings the scores up to date; the next job makes them. Every few rounds they are checkpointed."""
        context = self._context(list(made))
        for i, tree in made.items():
            context["fits"][i]["made"] = tree
        self.older.append(self.blocks)
        self.blocks = self.blocks.map(lambda row: (*row[:4], _Block(row, context).with_trees())).persist(_STORAGE)
        if rounds % _ROUNDS_BETWEEN_CHECKPOINTS == 0:
            self.blocks.checkpoint()
            self.blocks.count()
        while len(self.older) > 1:  # the last but one is made by now and nothing reads those before it
            self.older.pop(0).unpersist()


class _Block:
    """One block of rows for one part of the models, in a task."""

    def __init__(self, row: tuple, context: dict):
        features, numbers = context["shape"]
        self.context = context
        self.part, n, bins, values, self.stored = row
        self.bins = np.frombuffer(bins, np.uint8).reshape(features, n)
        self.numbers = np.frombuffer(values, np.float64).reshape(numbers, n)

    def fits(self):
        for i, fit in self.context["fits"].items():
            if i % self.context["parts"] == self.part:
                yield i, fit

    def of(self, fit: dict) -> np.ndarray:
        return self.bins[fit["at"]]

    def target(self, fit: dict):
        """Labels, weights, and which rows are trained on and which validate."""
        y = self.numbers[fit["y"]]
        w = np.ones(len(y)) if fit["w"] is None else self.numbers[fit["w"]]
        fold, validates = self.numbers[-2], self.numbers[-1] > 0
        usable = ~np.isnan(y) & ~np.isnan(w) & (fold < fit["before"])
        return y, w, usable & ~validates, usable & validates

    def scores(self, i: int, fit: dict) -> np.ndarray:
        return self.stored[i] if i in self.stored else np.full(self.bins.shape[1], fit["base"])

    def with_trees(self) -> dict[int, np.ndarray]:
        """The scores after each model's last tree; models that are done have none."""
        return {i: self.scores(i, fit) + fit["made"].predict(self.of(fit)) for i, fit in self.fits()}


def _histograms(block: _Block):
    """(validation loss, its weight, sums per open node and bin) of each model."""
    for i, fit in block.fits():
        y, w, train, valid = block.target(fit)
        f = block.scores(i, fit)
        lost = (0.0, 0.0)
        if not fit["level"]:
            lost = float((w[valid] * _losses(fit["loss"], y[valid], f[valid])).sum()), float(w[valid].sum())
        rows = np.flatnonzero(train)
        own = block.of(fit)[:, rows]
        g, h = _gradients(fit["loss"], y[rows], f[rows], w[rows])
        number = np.full(len(fit["tree"].feature), -1)
        number[fit["open"]] = np.arange(len(fit["open"]))
        node = number[fit["tree"].nodes(own, fit["level"])]
        inside = node >= 0
        own, g, h, node = own[:, inside], g[inside], h[inside], node[inside]
        width = sum(fit["sizes"])
        hist = np.zeros((len(fit["open"]), width, 3))
        at = 0
        for bins, size in zip(own, fit["sizes"]):
            place = node * size + bins
            for k, x in enumerate((g, h, None)):
                hist[:, at:at + size, k] = np.bincount(place, x, minlength=len(fit["open"]) * size).reshape(-1, size)
            at += size
        yield i, (*lost, hist)


def _splits(fit: dict, sums):
    """(validation loss, sums of the root, best splits) from the sums of all blocks."""
    loss, weight, hist = sums
    total = hist[0, :fit["sizes"][0]].sum(axis=0)
    return (loss / weight if weight else np.nan), total, best_splits(hist, fit["sizes"], fit["cats"], fit["min_leaf"], fit["l2"])


def _residuals(block: _Block):
    """Weights per leaf over equal parts of the range of what is left to explain."""
    for i, fit in block.fits():
        y, w, train, _ = block.target(fit)
        rest = y[train]
        leaf = np.zeros(len(rest), dtype=np.int64)
        leaves = 1
        if "tree" in fit:
            rest = rest - block.scores(i, fit)[train]
            leaf, leaves = fit["tree"].nodes(block.of(fit)[:, train]), len(fit["tree"].feature)
        yield i, (_residual_parts(rest, leaf, w[train], fit["reach"], leaves),)


def _medians(fit: dict, sums):
    low, high = fit["reach"]
    weight, = sums
    upto = np.cumsum(weight, axis=1)
    at = (upto < upto[:, -1:] / 2).sum(axis=1)
    return low + (np.minimum(at, _RESIDUAL_BINS - 1) + 0.5) * (high - low) / _RESIDUAL_BINS


def fit_all(table: DataFrame, fits: Sequence[Fit], fold: str | None = None,
            validation: str | None = "validation") -> dict[str, Boosted]:
    """Fits all models on one table together. Without validation rows a model has all its trees."""
    unknown = {f.loss for f in fits} - set(LOSSES)
    if unknown:
        raise ValueError(f"losses {unknown} are not among {LOSSES}")
    return _Trainer(table, fits, fold, validation).run() if fits else {}
