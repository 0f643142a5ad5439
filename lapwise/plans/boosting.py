"""Boosted regression trees on binned features, as a Spark ML estimator.

The trees are those of ``GBTRegressor`` with squared error: round after round, a tree of ``depth`` levels is fitted to
what is left of the label; a number is split at a threshold, a category into itself and all others (what a split of
its one-hot column is).  They are found by other means, as the rows are passed over hundreds of times:

- Rows are binned once and kept as one block of arrays a task.  A category is one column, whatever number of one-hot
  columns it stands for.  Columns of few bins share a byte: their bins are added up together and told apart afterwards.
- Thresholds are taken from all rows: midpoints of the distinct values, if they are no more than the bins, else
  quantiles by a mergeable sketch.
- A level is one job: each task adds up residuals and counts by node, column and bin.  Only the smaller child of a
  split is added up; the other is the parent less that one.  What tasks send has a bounded size, and many tasks'
  sums are added on the executors before the driver sees them.
- Rows in one partition need no sums of others, so all rounds run in the task that has them.
"""

import json
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

# Python workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ranks of the sketched quantiles are right to one part in so many.
QUANTILE_ACCURACY = 10_000
#: Rounds after which what is left is taken from the first blocks anew, so that lineage stays short.
RESTART_ROUNDS = 25
#: Rows added up at a time: what is made for them stays in a core's cache.
SLICE = 32_768
#: Combinations of the bins of columns that share a code.
MOST_SHARED = 256
#: Blocks are bytes already; to serialize them once more took half of a pass.
KEPT = StorageLevel.MEMORY_AND_DISK_DESER
#: Tasks whose sums the driver adds itself.
MOST_SENT = 64

#: Codes, packed, and labels (or what is left of them) of the rows to fit, and of the rows held back.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: For each node, level by level: column, bin, and whether the bin alone goes right (else all above it); None if not split.
Splits = list[tuple[int, int, bool] | None]
#: Splits, and for each node below the last level what is added to a prediction.
Tree = tuple[Splits, list[float]]


# Packed codes ------------------------------------------------------------------------------------


def _shared(bins: Sequence[int]) -> list[list[int]]:
    """Columns that share a code, first fit from the most bins down; one with many bins has its own."""
    groups: list[tuple[int, list[int]]] = []
    for column in sorted(range(len(bins)), key=lambda c: -bins[c]):
        for at, (cells, members) in enumerate(groups):
            if cells * bins[column] <= MOST_SHARED:
                groups[at] = cells * bins[column], [*members, column]
                break
        else:
            groups.append((bins[column], [column]))
    return [members for _, members in groups]


def _packed(codes: np.ndarray, bins: Sequence[int], kind: str) -> np.ndarray:
    """A row for each group of columns, in which the last member's bin counts one."""
    rows = []
    for members in _shared(bins):
        row = codes[members[0]].astype(kind)
        for column in members[1:]:
            row = row * np.array(bins[column], kind) + codes[column].astype(kind)
        rows.append(row)
    return np.stack(rows)


def _packed_splits(splits: Splits, bins: Sequence[int]) -> list[tuple | None]:
    """Splits of packed codes: the row in place of the column, and where it is shared also what ``_bins_of`` needs."""
    place = {}
    for row, members in enumerate(_shared(bins)):
        step = 1
        for column in reversed(members):
            shared = len(members) > 1
            place[column] = row, (step, None if column == members[0] else bins[column]) if shared else ()
            step *= bins[column]
    return [None if split is None else (place[split[0]][0], *split[1:], *place[split[0]][1]) for split in splits]


def _bins_of(row: np.ndarray, step: int, size: int | None) -> np.ndarray:
    """A column's bins in a row of packed codes; without a size, those of the row's first column."""
    above = row // step
    return above if size is None else above - row // (step * size) * size


# In tasks ----------------------------------------------------------------------------------------


def _codes(columns: Sequence[np.ndarray], thresholds: Sequence[list[float] | None], kind: str) -> np.ndarray:
    """Bins of the columns' values; a category's bin is its index."""
    return np.stack([
        np.asarray(values).astype(kind) if cuts is None else np.searchsorted(cuts, values).astype(kind)
        for values, cuts in zip(columns, thresholds, strict=True)
    ])


def _blocks(thresholds: Sequence[list[float] | None], bins: Sequence[int], kind: str) -> Callable:
    """Turns a task's rows (columns, label, whether held back) into one block."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, labels, held = [], [], []
        for batch in batches:
            *columns, label, back = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            codes.append(_packed(_codes(columns, thresholds, kind), bins, kind))
            labels.append(label)
            held.append(back.astype(bool))
        if labels:
            codes, labels, held = np.concatenate(codes, axis=1), np.concatenate(labels), np.concatenate(held)
            parts = [codes[:, ~held], labels[~held], codes[:, held], labels[held]]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], list("abcd"))

    return packed


def _arrays(row, groups: int, kind: str) -> Block:
    a, b, c, d = row
    return (
        np.frombuffer(a, kind).reshape(groups, -1), np.frombuffer(b), np.frombuffer(c, kind).reshape(groups, -1), np.frombuffer(d),
    )


def _reached(codes: np.ndarray, splits: list[tuple | None], levels: int) -> np.ndarray:
    """The node of each row among those of a level, from left to right.  Rows of a node without a split keep left.

    Splits are of columns, or packed as the codes are.
    """
    node = np.zeros(codes.shape[1], np.uint8)
    for level in range(levels):
        right = np.zeros(len(node), bool)
        for at, split in enumerate(splits[2**level - 1 : 2 ** (level + 1) - 1]):
            if split is not None:
                row, bin_, alone, *shared = split
                values = _bins_of(codes[row], *shared) if shared else codes[row]
                test = values == bin_ if alone else values > bin_
                right |= test & (node == at) if level else test
        node = node << 1 | right
    return node


def _sums(block: Block, splits: Splits, level: int, wanted: Sequence[int], bins: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts by wanted node of the level and bin; at the root, also squares and number of the rows held back."""
    codes, left, _, back = block
    groups = _shared(bins)
    cells = [int(np.prod([bins[c] for c in members])) for members in groups]
    packed = _packed_splits(splits, bins)
    slots = np.full(2**level, -1, np.int16)
    slots[list(wanted)] = np.arange(len(wanted))
    total = [np.zeros((2, len(wanted) * size)) for size in cells]
    for start in range(0, len(left), SLICE):
        part, weight = codes[:, start : start + SLICE], left[start : start + SLICE]
        if level:
            slot = slots[_reached(part, packed, level)]
            rows = np.flatnonzero(slot >= 0)
            part, weight, slot = part.take(rows, axis=1), weight[rows], slot[rows].astype(np.int64)
        for row, size in enumerate(cells):
            cell = slot * size + part[row] if level else part[row].astype(np.int64)
            total[row][0] += np.bincount(cell, weight, len(wanted) * size)
            total[row][1] += np.bincount(cell, minlength=len(wanted) * size)
    by_column: list = [None] * len(bins)
    for members, added in zip(groups, total, strict=True):
        split_up = added.reshape(2, len(wanted), *[bins[c] for c in members])
        for at, column in enumerate(members):
            by_column[column] = split_up.sum(axis=tuple(2 + i for i in range(len(members)) if i != at))
    error = np.array([np.dot(back, back), len(back)]) if level == 0 else np.zeros(2)
    return np.concatenate(by_column, axis=2), error


def _added(one: tuple, two: tuple) -> tuple:
    return one[0] + two[0], one[1] + two[1]


def _without(codes: np.ndarray, left: np.ndarray, trees: Sequence[Tree], depth: int, bins: Sequence[int]) -> np.ndarray:
    """What the trees leave."""
    ready = [(_packed_splits(splits, bins), np.array(values)) for splits, values in trees]
    after = np.empty(len(left))
    for start in range(0, len(left), SLICE):
        part, rest = codes[:, start : start + SLICE], left[start : start + SLICE]
        for splits, added in ready:
            rest = rest - added[_reached(part, splits, depth)]
        after[start : start + SLICE] = rest
    return after


def _advanced(block: Block, trees: Sequence[Tree], depth: int, bins: Sequence[int]) -> Block:
    codes, left, held, back = block
    return codes, _without(codes, left, trees, depth, bins), held, _without(held, back, trees, depth, bins)


class _Here:
    """Passes over blocks that are all in this process."""

    def __init__(self, blocks: list[Block], bins: Sequence[int], depth: int):
        self.blocks, self.bins, self.depth = blocks, bins, depth

    def sums(self, splits: Splits, level: int, wanted: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        total = _sums(self.blocks[0], splits, level, wanted, self.bins)
        for block in self.blocks[1:]:
            total = _added(total, _sums(block, splits, level, wanted, self.bins))
        return total

    def advance(self, tree: Tree) -> None:
        self.blocks = [_advanced(block, [tree], self.depth, self.bins) for block in self.blocks]


# On either side ----------------------------------------------------------------------------------


def _best(sums: np.ndarray, counts: np.ndarray, bins: Sequence[int], labels: Sequence[int | None], least: int):
    """The best split of a node, as column, bin, whether alone, and the left side's sum and count; None if there is none."""
    best, found = 0.0, None
    start = 0
    for column, (size, known) in enumerate(zip(bins, labels, strict=True)):
        s, n = sums[start : start + size], counts[start : start + size]
        start += size
        total, rows = s.sum(), n.sum()
        if known is None:
            left, before = np.cumsum(s)[:-1], np.cumsum(n)[:-1]
        else:
            left, before = total - s[:known], rows - n[:known]
        after = rows - before
        fits = np.flatnonzero((before >= least) & (after >= least))
        if len(fits):
            l, b, a = left[fits], before[fits], after[fits]
            gain = l * l / b + (total - l) ** 2 / a - total * total / rows
            at = int(np.argmax(gain))
            if gain[at] > best:
                best = float(gain[at])
                found = column, int(fits[at]), known is not None, float(l[at]), float(b[at])
    return found


def _grown(passes, root: np.ndarray, bins, labels, depth: int, least: int, scale: float) -> Tree:
    """One tree, level by level, from the root's sums.  A leaf adds ``scale`` times the mean of what is left in it."""
    splits: Splits = [None] * (2**depth - 1)
    values = [0.0] * 2**depth
    first = bins[0]
    at = {0: (root[0, 0], root[1, 0])}
    for level in range(depth):
        children, smaller, parents = {}, [], {}
        for node, (sums, counts) in at.items():
            total, rows = float(sums[:first].sum()), float(counts[:first].sum())
            found = _best(sums, counts, bins, labels, least)
            if found is None:
                values[node << depth - level] = scale * total / rows
                continue
            column, bin_, alone, left, before = found
            splits[2**level - 1 + node] = column, bin_, alone
            sides = {2 * node: (left, before), 2 * node + 1: (total - left, rows - before)}
            small = min(sides, key=lambda side: sides[side][1])
            if level + 1 < depth and max(n for _, n in sides.values()) >= 2 * least:
                smaller.append(small)
                parents[small] = sums, counts
            else:
                for side, (s, n) in sides.items():
                    values[side << depth - level - 1] = scale * s / n
        if not smaller:
            break
        told = passes.sums(splits, level + 1, smaller)[0]
        for slot, node in enumerate(smaller):
            sums, counts = parents[node]
            children[node] = told[0, slot], told[1, slot]
            children[node ^ 1] = sums - told[0, slot], counts - told[1, slot]
        at = children
    return splits, values


def _boosted(
    passes, bins: Sequence[int], labels: Sequence[int | None], rounds: int, depth: int, least: int, step: float, tolerance: float | None
) -> list[Tree]:
    """All rounds, or with a tolerance those before the first that does not lower the error on rows held back by it.

    The first tree counts whole and each later one ``step`` times twice its means, twice being the slope of the
    squared error.
    """
    trees: list[Tree] = []
    lowest, kept = np.inf, 0
    for done in range(rounds + 1):
        if done == rounds and (tolerance is None or rounds < 2):
            break
        root, (squares, held) = passes.sums([], 0, [0])
        if root[1, 0, : bins[0]].sum() == 0:
            raise ValueError("no rows to fit")
        if tolerance is not None and done and held:
            error = squares / held
            if done > 1 and lowest - error < tolerance * max(error, 0.01):
                break
            if error < lowest:
                lowest, kept = error, done
        if done < rounds:
            tree = _grown(passes, root, bins, labels, depth, least, 2 * step if done else 1.0)
            trees.append(tree)
            passes.advance(tree)
    return trees[: kept or len(trees)]


# On the driver -----------------------------------------------------------------------------------


class _Spread:
    """Passes over the blocks of many tasks, each a job."""

    def __init__(self, blocks: RDD, bins: Sequence[int], depth: int):
        self.first = self.blocks = blocks
        self.bins, self.depth, self.trees, self.kept = bins, depth, [], [blocks]
        self.steps = 1 if blocks.getNumPartitions() <= MOST_SENT else 2

    def sums(self, splits: Splits, level: int, wanted: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        bins = self.bins
        told = self.blocks.map(lambda block: _sums(block, splits, level, wanted, bins)).treeReduce(_added, self.steps)
        self.release(2)  # the blocks before these have served to make them
        return told

    def advance(self, tree: Tree) -> None:
        self.trees.append(tree)
        depth, bins = self.depth, self.bins
        anew = len(self.trees) % RESTART_ROUNDS == 0
        trees = list(self.trees) if anew else [tree]
        source = self.first if anew else self.blocks
        self.blocks = source.map(lambda block: _advanced(block, trees, depth, bins)).persist(KEPT)
        self.kept.append(self.blocks)

    def release(self, most: int) -> None:
        """Lets go of all but the first blocks and the last ones."""
        while len(self.kept) > most:
            self.kept.pop(1 if most else 0).unpersist()


def _thresholds(rows: DataFrame, columns: Sequence[str], most_bins: int) -> list[list[float]]:
    """Where each column may be split: at most ``most_bins - 1`` places, of all rows."""
    ranks = F.array(*[F.lit(i / most_bins) for i in range(1, most_bins)])
    told = rows.agg(
        *[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(c, ranks, QUANTILE_ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)],
    ).first()
    if told["q0"] is None:
        raise ValueError("no rows to fit")
    few = [i for i in range(len(columns)) if told[f"n{i}"] < 2 * most_bins]  # an estimate; exact ones decide below
    sets = rows.agg(*[F.sort_array(F.collect_set(columns[i])).alias(f"s{i}") for i in few]).first().asDict() if few else {}
    cuts = []
    for i in range(len(columns)):
        values = sets.get(f"s{i}")
        if values is not None and len(values) <= most_bins:
            cuts.append([(a + b) / 2 for a, b in zip(values, values[1:], strict=False)])
        else:
            cuts.append(sorted(set(told[f"q{i}"])))
    return cuts


class BoostedTrees(Estimator):
    """Fits numeric columns and indexed categories (as ``StringIndexer`` with ``keep`` makes them) to a label.

    ``held`` names a boolean column of rows to measure on, for early stopping with ``tolerance``.
    """

    @keyword_only
    def __init__(
        self, *, numeric: list[str], indexed: list[str], label: str, rounds: int, step: float, depth: int = 5,
        bins: int = 256, least: int = 20, held: str | None = None, tolerance: float | None = None,
    ):
        super().__init__()
        self.given = dict(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "BoostedTreesModel":
        given = {"depth": 5, "bins": 256, "least": 20, "held": None, "tolerance": None} | self.given
        numeric, indexed, depth = given["numeric"], given["indexed"], given["depth"]
        # The last of an index's values is that of unseen and missing ones, which no split singles out.
        known = [len(dataset.schema[c].metadata["ml_attr"]["vals"]) - 1 for c in indexed]
        held = F.col(given["held"]) if given["held"] else F.lit(False)
        rows = dataset.select(*[F.col(c).cast("double") for c in (*numeric, *indexed, given["label"])], held.alias("_held"))
        cuts = _thresholds(rows.where(~F.col("_held")), numeric, given["bins"])
        bins = [len(c) + 1 for c in cuts] + [n + 1 for n in known]
        labels = [None] * len(numeric) + known
        kind = np.min_scalar_type(max(bins) - 1).name
        thresholds, groups = [*cuts, *[None] * len(indexed)], len(_shared(bins))
        packed = rows.mapInArrow(_blocks(thresholds, bins, kind), "a binary, b binary, c binary, d binary")
        blocks = packed.rdd.map(lambda row: _arrays(row, groups, kind)).persist(KEPT)
        options = (bins, labels, given["rounds"], depth, given["least"], given["step"], given["tolerance"])
        if blocks.getNumPartitions() == 1:
            trees = blocks.mapPartitions(lambda part: _boosted(_Here(list(part), bins, depth), *options)).collect()
        else:
            passes = _Spread(blocks, bins, depth)
            try:
                trees = _boosted(passes, *options)
            finally:
                passes.release(0)
        blocks.unpersist()
        learned = {"columns": [*numeric, *indexed], "thresholds": thresholds, "kind": kind, "depth": depth, "trees": trees}
        model = BoostedTreesModel()
        model.set(model.learned, json.dumps(learned))
        return model


class BoostedTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``prediction``."""

    learned: Param[str] = Param(Params._dummy(), "learned", "columns, thresholds and trees, as JSON", TypeConverters.toString)

    @property
    def getNumTrees(self) -> int:  # named as in Spark ML's tree models
        return len(json.loads(self.getOrDefault(self.learned))["trees"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        learned = json.loads(self.getOrDefault(self.learned))
        thresholds, kind, depth = learned["thresholds"], learned["kind"], learned["depth"]
        trees = [(splits, np.array(values)) for splits, values in learned["trees"]]

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            codes = _codes([c.to_numpy() for c in columns], thresholds, kind)
            total = np.zeros(codes.shape[1])
            for splits, values in trees:
                total += values[_reached(codes, splits, depth)]
            return pd.Series(total)

        return dataset.withColumn("prediction", predicted(*[F.col(c).cast("double") for c in learned["columns"]]))
