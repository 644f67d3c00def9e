"""Hard negatives by angular triangle filtering, with integer scores.

Each row keeps its angles to a few reference directions. By the triangle inequality the angle between an anchor and a
row is at least the difference of their angles to any reference, and at most their sum; times the norms, its cosine is an
interval that holds the score. Bounds are widened by more than all rounding errors, so they never exclude a row
wrongly. Scores are computed only where the interval overlaps the window in which a score is wanted:

* positives: from the fifth best score known so far of the anchor's label;
* negatives: from four fifths of a positive's score up to it.

Rows are sorted by their nearest reference and the angle to it and cut into slices; a slice and a group of anchors have
intervals too, so most pairs of far slices never meet. A task gets one slice and one group of anchors, both of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archipelago.llm.arrays import pack, unpack
from archipelago.llm.tables import written

POSITIVES = 5
NEGATIVES = 5
ANCHOR_OF = 100
# Each component x counts as floor(SCALE * x).
SCALE = 256
# Reference directions, and the rows that they are chosen from (those with the smallest hashes of their ids).
REFERENCES = 16
SAMPLE = 2048
# Rows of a slice and anchors of a group at most, and the blocks of them that are compared at a time.
SLICE = 1 << 14
GROUP = 1 << 14
_ROWS, _ANCHORS = 1 << 12, 1 << 8
# Angles are stored with 24 bits: the error of a difference of two is below 1e-6.
_SLACK = 1e-5
_GUARD = 1e-6
# Larger products of norms than this have no exact score.
_MOST = 2.0**60
_NONE = -(2**62)


def prepared(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, ints``: the rows that take part, with integer components; one row for each id."""
    value = F.col(label).cast("bigint")
    moved = F.when(F.col(vec_id) % 7 == 0, (value + 1) % 10).otherwise(value)
    exact = F.transform(vector, lambda x: x.cast("double"))
    whole = F.forall(exact, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(exact, lambda x: F.floor(x * SCALE).cast("bigint"))
    given = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & whole)
    one = given.groupBy(F.col(vec_id).cast("bigint").alias("vec_id")).agg(
        F.min(F.struct(moved.alias("label"), ints.alias("ints"))).alias("row")
    )
    return one.select("vec_id", "row.label", "row.ints")


def _matrix(lists: pa.Array, least: int = 1) -> np.ndarray:
    """Lists of integers as rows; shorter ones go on with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max(least, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _wide(matrix: np.ndarray, width: int) -> np.ndarray:
    return matrix if matrix.shape[1] == width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _together(*matrices: np.ndarray) -> list[np.ndarray]:
    width = max(m.shape[1] for m in matrices)
    return [_wide(m, width) for m in matrices]


def references(rows: DataFrame, most: int = REFERENCES) -> np.ndarray:
    """Unit vectors far from each other, from a sample of at most ``SAMPLE`` rows; the results don't depend on them."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("ints").toArrow()
    units = _matrix(sample.column("ints")).astype(np.float64)
    norms = np.linalg.norm(units, axis=1)
    units = units[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.ones((1, 1))
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < most and nearest.min() < 1 - 1e-9:
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def _angles(ints: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of rows, and their angles to the reference directions."""
    exact = ints.astype(np.float64)
    norms = np.sqrt((exact * exact).sum(1))
    exact, directions = _together(exact, directions)
    cosines = (exact / np.where(norms > 0, norms, 1)[:, None]) @ directions.T
    return norms, np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def placed(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """``rows`` with ``cell``, the nearest reference, and ``near``, the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, angles = _angles(_matrix(batch.column(2)), directions)
            cell = angles.argmin(1)
            near = angles[np.arange(len(cell)), cell]
            names = [*batch.schema.names, "cell", "near"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(near)], names=names)

    return rows.mapInArrow(run, "vec_id bigint, label bigint, ints array<bigint>, cell int, near float")


@dataclass
class Rows:
    """Rows to compare; ``windows`` has, for anchors, positive ids and scores (``_NONE`` where there is none)."""

    ids: np.ndarray
    labels: np.ndarray
    ints: np.ndarray
    norms: np.ndarray
    angles: np.ndarray
    # Per anchor, a score that the fifth best positive has at least.
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    positives: np.ndarray = field(default_factory=lambda: np.zeros((0, POSITIVES), np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros((0, POSITIVES), np.int64))

    def take(self, at: np.ndarray | slice) -> Rows:
        parts = (self.ids, self.labels, self.ints, self.norms, self.angles)
        extra = [x[at] if len(x) else x for x in (self.least, self.positives, self.scores)]
        return Rows(*(x[at] for x in parts), *extra)

    def packed(self) -> bytes:
        small = next(kind for kind in ("<i2", "<i4", "<i8") if np.array_equal(self.ints.astype(kind), self.ints))
        shapes = np.array([len(self.ids), self.angles.shape[1]], np.int64)
        return pack(shapes, self.ids, self.labels, self.ints.astype(small).ravel(), self.norms, self.angles.ravel(),
                    self.least, self.positives.ravel(), self.scores.ravel())

    @classmethod
    def unpacked(cls, value: bytes) -> Rows:
        shapes, ids, labels, ints, norms, angles, least, positives, scores = unpack(value)
        rows, references = shapes.tolist()
        ints = ints.reshape(rows, -1).astype(np.int64)
        ends = positives.reshape(-1, POSITIVES), scores.reshape(-1, POSITIVES)
        return cls(ids, labels, ints, norms, angles.reshape(rows, references), least, *ends)


_SUMMARY = "lows array<float>, highs array<float>, norm_low double, norm_high double, least bigint"
_PACKED = f"number bigint, payload binary, {_SUMMARY}"


def _summed(number: int, rows: Rows, least: int) -> dict:
    """A row of ``_PACKED``: the rows, and between which bounds their angles and norms are."""
    return {
        "number": number,
        "payload": rows.packed(),
        "lows": rows.angles.min(0).tolist(),
        "highs": rows.angles.max(0).tolist(),
        "norm_low": float(rows.norms.min()),
        "norm_high": float(rows.norms.max()),
        "least": least,
    }


_ARROW = pa.schema(
    [("number", pa.int64()), ("payload", pa.binary()), ("lows", pa.list_(pa.float32())), ("highs", pa.list_(pa.float32())),
     ("norm_low", pa.float64()), ("norm_high", pa.float64()), ("least", pa.int64())]
)


def slices(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """Slices of at most ``SLICE`` rows (``_PACKED``), neighbours in angle together, numbered as they are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def cut(size: int) -> dict:
            nonlocal number, held
            table = pa.Table.from_batches(held)
            first, rest = table.slice(0, size).combine_chunks(), table.slice(size)
            held = rest.to_batches()
            ints = _matrix(first.column("ints"))
            norms, angles = _angles(ints, directions)
            own = Rows(first.column("vec_id").to_numpy(), first.column("label").to_numpy(), ints, norms, angles)
            number += 1
            return _summed(number - 1, own, _NONE)

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= SLICE:
                yield pa.RecordBatch.from_pylist([cut(SLICE)], _ARROW)
        if sum(map(len, held)):
            yield pa.RecordBatch.from_pylist([cut(SLICE)], _ARROW)

    in_order = placed(rows, directions).repartitionByRange("cell", "near", "vec_id")
    in_order = in_order.sortWithinPartitions("cell", "near", "vec_id")
    return written(in_order.mapInArrow(run, _PACKED), "row-slices")


def _bounds(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Between which numbers the score of each anchor and row is."""
    shape = len(a.ids), len(b.ids)
    gap, sum_ = np.zeros(shape, np.float32), np.full(shape, np.pi, np.float32)
    for k in range(a.angles.shape[1]):
        one, two = a.angles[:, k, None], b.angles[None, :, k]
        np.maximum(gap, np.abs(one - two), out=gap)
        both = one + two
        # Beyond a half turn, the way around the other side is shorter.
        np.minimum(sum_, np.minimum(both, np.float32(2 * np.pi) - both), out=sum_)
    size = a.norms[:, None] * b.norms[None, :]
    upper = size * (np.cos(np.maximum(gap - _SLACK, 0)) + _GUARD)
    lower = size * (np.cos(np.minimum(sum_ + _SLACK, np.pi)) - _GUARD)
    return lower, upper


def _scores(a: Rows, b: Rows) -> np.ndarray:
    """Exact integer scores of all anchors and rows."""
    most = float(a.norms.max() * b.norms.max())
    one, two = _together(a.ints, b.ints)
    if most < 2.0**53:
        # All partial sums are integers below 2 to the 53, so doubles are exact.
        return (one.astype(np.float64) @ two.T.astype(np.float64)).astype(np.int64)
    if most < _MOST:
        return one @ two.T
    raise ValueError("components are too large: scores must be below 2 to the 60")


class _Best:
    """The best few (score, id) of each of some lists, larger scores and then smaller ids first."""

    def __init__(self, lists: int, size: int) -> None:
        self._size = size
        self.scores = np.full((lists, size), _NONE, np.int64)
        self.ids = np.full((lists, size), np.iinfo(np.int64).max, np.int64)

    @property
    def least(self) -> np.ndarray:
        """The score of each list's last entry, ``_NONE`` while it isn't full."""
        return self.scores[:, -1]

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> None:
        """Offer the ``wanted`` scores (a row for each of ``lists``) of rows ``ids``."""
        wanted = wanted & (scores >= self.least[lists][:, None])
        if not wanted.any():
            return
        if scores.shape[1] > self._size:
            enough = np.partition(np.where(wanted, scores, _NONE), -self._size, axis=1)[:, -self._size]
            wanted &= scores >= enough[:, None]
        at, column = np.nonzero(wanted)
        touched = np.unique(at)
        own = lists[touched]
        row = np.concatenate((at, np.repeat(touched, self._size)))
        score = np.concatenate((scores[at, column], self.scores[own].ravel()))
        name = np.concatenate((ids[column], self.ids[own].ravel()))
        order = np.lexsort((name, -score, row))
        row, score, name = row[order], score[order], name[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self._size
        self.scores[lists[row[keep]], rank[keep]] = score[keep]
        self.ids[lists[row[keep]], rank[keep]] = name[keep]


def _blocks(a: Rows, b: Rows) -> Iterator[tuple[np.ndarray, Rows, Rows]]:
    for i in range(0, len(a.ids), _ANCHORS):
        at = np.arange(i, min(i + _ANCHORS, len(a.ids)))
        part = a.take(at)
        for j in range(0, len(b.ids), _ROWS):
            yield at, part, b.take(slice(j, j + _ROWS))


def best_positives(anchors: Rows, rows: Rows) -> _Best:
    """The best rows with each anchor's label, of those that reach ``anchors.least``."""
    best = _Best(len(anchors.ids), POSITIVES)
    for at, a, b in _blocks(anchors, rows):
        alike = (a.labels[:, None] == b.labels) & (a.ids[:, None] != b.ids)
        _, upper = _bounds(a, b)
        wanted = alike & (upper >= np.maximum(best.least[at], a.least)[:, None])
        some, near = wanted.any(0), wanted.any(1)
        if some.any():
            part, own = a.take(near), b.take(some)
            scores, wanted = _scores(part, own), wanted[near][:, some]
            best.add(at[near], scores, own.ids, wanted & (scores >= part.least[:, None]))
    return best


def best_negatives(anchors: Rows, rows: Rows) -> list[_Best]:
    """For each place among the positives, the best rows of other labels in the window of that positive's score."""
    high = anchors.scores
    low = np.where(high > _NONE, -((-4 * high) // 5), 1)
    best = [_Best(len(anchors.ids), NEGATIVES) for _ in range(POSITIVES)]
    nothing = high == _NONE
    least, most = np.where(nothing, 2**62, low).min(1), high.max(1)
    for at, a, b in _blocks(anchors, rows):
        lower, upper = _bounds(a, b)
        other = a.labels[:, None] != b.labels
        wanted = other & (upper >= least[at][:, None]) & (lower <= most[at][:, None])
        some, near = wanted.any(0), wanted.any(1)
        if not some.any():
            continue
        part, own = a.take(near), b.take(some)
        scores, wanted = _scores(part, own), wanted[near][:, some]
        for k in range(POSITIVES):
            inside = (scores >= low[at[near], k][:, None]) & (scores <= high[at[near], k][:, None])
            best[k].add(at[near], scores, own.ids, wanted & inside)
    return best


def _seeded(held: DataFrame) -> DataFrame:
    """Groups of at most ``GROUP`` anchors (``_PACKED``); each knows what its own slice has of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, gathered = TaskContext.get().partitionId() << 32, []

        def group() -> pa.RecordBatch:
            nonlocal number, gathered
            wide = _together(*(g.ints for g in gathered))
            parts = [np.concatenate([getattr(g, name) for g in gathered]) for name in ("ids", "labels", "norms", "angles", "least")]
            own = Rows(parts[0], parts[1], np.concatenate(wide), *parts[2:])
            number, gathered = number + 1, []
            return pa.RecordBatch.from_pylist([_summed(number - 1, own, int(own.least.min()))], _ARROW)

        for batch in batches:
            for payload in batch.column(0).to_pylist():
                rows = Rows.unpacked(payload)
                anchors = rows.take(rows.ids % ANCHOR_OF == 0)
                if not len(anchors.ids):
                    continue
                anchors.least = np.full(len(anchors.ids), _NONE, np.int64)
                anchors.least = best_positives(anchors, rows).least.copy()
                if gathered and sum(len(g.ids) for g in gathered) + len(anchors.ids) > GROUP:
                    yield group()
                gathered.append(anchors)
        if gathered:
            yield group()

    return written(held.select("payload").mapInArrow(run, _PACKED), "anchors")


def _nearest(a: str, b: str) -> Column:
    """The least angle between anything in one summary and anything in the other."""
    gaps = F.zip_with(
        F.arrays_zip(F.col(f"{a}.lows").alias("low"), F.col(f"{a}.highs").alias("high")),
        F.arrays_zip(F.col(f"{b}.lows").alias("low"), F.col(f"{b}.highs").alias("high")),
        lambda x, y: F.greatest(x["low"] - y["high"], y["low"] - x["high"], F.lit(0.0)),
    )
    return F.array_max(gaps)


def _meetings(groups: DataFrame, held: DataFrame) -> DataFrame:
    """``slice, group``: where a score of ``least`` at least is possible. Anchors are the query set, met in blocks."""
    lanes = 64
    names = ["lows", "highs", "norm_low", "norm_high", "least"]
    a = groups.select(F.col("number").alias("group"), F.struct(*names).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    b = held.select(F.col("number").alias("slice"), F.struct(*names).alias("b"), F.pmod(F.xxhash64("number"), F.lit(lanes)).cast("int").alias("lane"))
    cosine = F.cos(F.greatest(_nearest("a", "b") - _SLACK, F.lit(0.0)))
    sizes = F.when(cosine > 0, F.col("a.norm_high") * F.col("b.norm_high")).otherwise(F.col("a.norm_low") * F.col("b.norm_low"))
    upper = sizes * cosine + _GUARD * F.col("a.norm_high") * F.col("b.norm_high")
    return a.join(b, "lane").filter(upper >= F.col("a.least")).select("slice", "group")


def _met(groups: DataFrame, held: DataFrame, run: object, schema: str) -> DataFrame:
    """``run`` for every slice and group of anchors that meet, one pair at a time."""
    pairs = written(_meetings(groups, held), "meetings")
    left = pairs.join(held.select(F.col("number").alias("slice"), "payload"), "slice")
    right = pairs.select(F.col("slice").alias("to_slice"), F.col("group").alias("to_group")).join(
        groups.select(F.col("number").alias("to_group"), F.col("payload").alias("anchors")), "to_group"
    )
    return left.groupBy("slice", "group").cogroup(right.groupBy("to_slice", "to_group")).applyInArrow(run, schema)


def _both(rows: pa.Table, anchors: pa.Table) -> tuple[Rows, Rows]:
    return Rows.unpacked(anchors["anchors"][0].as_py()), Rows.unpacked(rows["payload"][0].as_py())


_FOUND = "group bigint, anchor_id bigint, positive_id bigint, positive_score bigint"
_MINED = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"


def _find(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    a, b = _both(rows, anchors)
    best = best_positives(a, b)
    at, rank = np.nonzero(best.scores > _NONE)
    group = np.full(len(at), key[1].as_py(), np.int64)
    return pa.table({"group": group, "anchor_id": a.ids[at], "positive_id": best.ids[at, rank], "positive_score": best.scores[at, rank]})


def _mine(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
    a, b = _both(rows, anchors)
    tables = []
    for k, best in enumerate(best_negatives(a, b)):
        at, rank = np.nonzero(best.scores > _NONE)
        tables.append([a.ids[at], a.positives[at, k], a.scores[at, k], best.ids[at, rank], best.scores[at, rank]])
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    return pa.table([np.concatenate(columns) for columns in zip(*tables, strict=True)], names=names)


def _window(key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
    """A group of anchors with their positives; anchors without any go."""
    a = Rows.unpacked(group["payload"][0].as_py())
    anchor, rank = found["anchor_id"].to_numpy(), found["rank"].to_numpy() - 1
    order = np.argsort(a.ids)
    at = order[np.searchsorted(a.ids[order], anchor)]
    a.positives = np.full((len(a.ids), POSITIVES), _NONE, np.int64)
    a.scores = a.positives.copy()
    a.positives[at, rank], a.scores[at, rank] = found["positive_id"].to_numpy(), found["positive_score"].to_numpy()
    a = a.take(np.unique(at))
    if not len(a.ids):
        return _ARROW.empty_table()
    held = a.scores > _NONE
    low = int(np.where(held, -((-4 * a.scores) // 5), 2**62).min())
    return pa.Table.from_pylist([_summed(group["number"][0].as_py(), a, low)], _ARROW)


def hard_negatives(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows without id, label or vector, or with a component that is null or not finite, take no part. Where the id is
    divisible by 7 the label is replaced by the next of ten. Components count as floor(256 * x); a score is the integer
    inner product, higher scores and then smaller ids come first, and a vector shorter than another goes on with zeros. Anchors
    are rows whose id is divisible by 100; an anchor's positives are its first 5 other rows of the same label. For each
    of them the first 5 rows of other labels with a score of at least 80 % of the positive's and not above it are given,
    fewer if there are fewer, none if the positive's score is negative.

    Rows of one id are one row, that with the smallest label and then vector. An empty table gives an empty result,
    and other columns are not read. Scores of 2 to the 60 or more fail the job.
    """
    given = written(prepared(rows, vec_id, vector, label), "vectors")
    held = slices(given, references(given))
    anchors = _seeded(held)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = _met(anchors, held, _find, _FOUND).withColumn("rank", F.row_number().over(first))
    found = found.filter(F.col("rank") <= POSITIVES)
    found = found.select(F.col("group").alias("of_group"), "anchor_id", "rank", "positive_id", "positive_score")
    windows = anchors.groupBy("number").cogroup(found.groupBy("of_group"))
    windows = written(windows.applyInArrow(_window, _PACKED), "windows")
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    mined = _met(windows, held, _mine, _MINED).withColumn("rank", F.row_number().over(first))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return mined.filter(F.col("rank") <= NEGATIVES).select(*names)
