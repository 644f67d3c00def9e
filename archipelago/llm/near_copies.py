"""Near-duplicate documents with HyperMinHash.

Each document's word shingles are hashed into registers, each the minimum of an own hash over all
shingles, kept as its leading-zero count and the bits that follow (the mantissa). Equal shingle sets are
one class from there on. Bands of registers name buckets. Members of a bucket whose registers agree enough,
corrected for chance collisions, belong to one family: first every member is compared with the bucket's
smallest, then those that are not near it are compared with the others in blocks. Only edges
that join families come out, never all pairs of a bucket. Within a family, the links are then
verified on full shingle sets, again in blocks of which only joining links come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from archipelago import connected_components
from archipelago.llm.arrays import (
    any_but_white,
    lower_case,
    mix,
    release,
    shingles,
    span_hashes,
    text_pieces,
    words,
)
from archipelago.llm.tables import run_tables, small_side, spread_join, union, written
from archipelago.operators import lookup

WORDS = 5
# Linked if LEAST percent of the union are shared.
LEAST = 75

# 40 bands of 4 registers: a pair at the limit shares no bucket with a chance of (1 - 0.75**4)**40 = 2.5e-7.
BAND = 4
BANDS = 40
REGISTERS = BAND * BANDS
# Bits of a register: leading zeros, then mantissa.
ZERO_BITS = 6
MANTISSA_BITS = 10
# Pairs with less agreement than this are hopeless: six standard deviations under the limit.
HOPELESS = LEAST / 100 - 6 * (0.75 * 0.25 / REGISTERS) ** 0.5
# Members of a bucket or family that are compared with as many others at a time, and shingles of a family's chunk.
BLOCK = 512
CHUNK = 1 << 21
# A key with more rows than this part of all is split where rows are joined by it; so there are few such keys.
HOT = 2000
# Columns of the tables of shingles that are multiplied at a time.
_WIDTH = 4096

_PIECE = 1 << 19


def _shingle_sets(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes row by row (repeats left in), and where each row begins and ends."""
    data = lower_case(data)
    starts, ends, counts = words(data, limits, any_but_white())
    hashes, found = shingles(span_hashes(data, starts, ends), counts, WORDS)
    return hashes, np.concatenate(([0], np.cumsum(found)))


def registers(hashes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of the non-empty rows, one row of the result each."""
    heads = limits[:-1][np.diff(limits) > 0]
    out = np.empty((len(heads), REGISTERS), np.uint16)
    if not len(heads):
        return out
    factors = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
    low = np.empty((len(heads), REGISTERS), np.uint64)
    # In slices that stay in the cache.
    for first in range(0, len(heads), 64):
        last = min(first + 64, len(heads))
        end = heads[last] if last < len(heads) else limits[-1]
        own = hashes[heads[first] : end]
        at = heads[first:last] - heads[first]
        for i, factor in enumerate(factors):
            low[first:last, i] = np.minimum.reduceat(own * factor, at)
    return compressed(low)


def compressed(low: np.ndarray) -> np.ndarray:
    """Minima as leading-zero count (at most 63) and the bits after the first one."""
    low = low | np.uint64(1 << MANTISSA_BITS)
    zeros = 63 - np.floor(np.log2(low.astype(np.float64))).astype(np.int64)
    # Rounding in the conversion can carry a number to the next power of two.
    zeros += ((low >> (63 - zeros).astype(np.uint64)) == 0).astype(np.int64)
    mantissa = (low << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of registers, corrected for registers that agree by chance.

    Two unrelated minima agree in zero count and mantissa with a chance of about a third of
    2 ** -MANTISSA_BITS.
    """
    chance = 2.0**-MANTISSA_BITS / 3
    equal = np.mean(a == b, axis=-1)
    return (equal - chance) / (1 - chance)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, node, n_shingles, a, b, registers``: set size, 128-bit digest of the set, and registers.

    The last three are null for documents without words.
    """
    names = ["doc_id", "node", "n_shingles", "a", "b", "registers"]
    schema = "doc_id bigint, node bigint, n_shingles bigint, a bigint, b bigint, registers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, limits in text_pieces(batch.column(2), _PIECE):
                hashes, at = _shingle_sets(data, limits)
                rows = end - first
                sizes, a, b = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for i in range(rows):
                    own = np.unique(hashes[at[i] : at[i + 1]])
                    sizes[i] = len(own)
                    a[i], b[i] = _digest(own)
                filled = sizes > 0
                found = iter(registers(hashes, at))
                values = [next(found).tobytes() if x else None for x in filled]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows),
                        batch.column(1).slice(first, rows),
                        pa.array(sizes),
                        pa.array(a, mask=~filled),
                        pa.array(b, mask=~filled),
                        pa.array(values, pa.binary()),
                    ],
                    names=names,
                )
        release()

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), node().alias("node"), "text")
    return own.mapInArrow(run, schema)


def _bands(classes: DataFrame) -> DataFrame:
    """``band, bucket, node``: the buckets of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 2048):
                own = batch.slice(first, 2048)
                value = np.frombuffer(b"".join(own.column(1).to_pylist()), np.int64).reshape(len(own), BANDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(own))),
                        pa.array(value.ravel()),
                        pa.array(np.repeat(own.column(0).to_numpy(), BANDS)),
                    ],
                    names=["band", "bucket", "node"],
                )

    return classes.select("node", "registers").mapInArrow(run, "band int, bucket bigint, node bigint")


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (``src, dst``) whose registers agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sides = [
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(len(batch), REGISTERS)
                    for i in (2, 3)
                ]
                yield batch.select([0, 1]).filter(pa.array(agreement(*sides) >= HOPELESS))

    own = classes.select("node", "registers")
    return (
        pairs.join(own.toDF("src", "left"), "src")
        .join(own.toDF("dst", "right"), "dst")
        .select("src", "dst", "left", "right")
        .mapInArrow(run, "src bigint, dst bigint")
    )


def _sets(docs: DataFrame, families: DataFrame) -> DataFrame:
    """``family, chunks, node, shingles``: the sorted shingle sets of the classes (``node``) in families.

    ``families`` has with each class the id ``of`` a document that has its set, and the set's digest: rows of that id
    with another text are others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, limits in text_pieces(batch.column(5), _PIECE):
                hashes, at = _shingle_sets(data, limits)
                sets = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(end - first)]
                own = batch.slice(first, end - first)
                digests = zip(own.column(3).to_pylist(), own.column(4).to_pylist(), strict=True)
                right = [_digest(held) == digest for held, digest in zip(sets, digests, strict=True)]
                columns = [*own.columns[:3], pa.array([held.tobytes() for held in sets], pa.binary())]
                names = ["family", "chunks", "node", "shingles"]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(right, pa.bool_()))
        release()

    texts = docs.select(node().alias("of"), "text").join(small_side(families, "members"), "of")
    shape = "family bigint, chunks bigint, node bigint, shingles binary"
    return texts.select("family", "chunks", "node", "a", "b", "text").mapInArrow(run, shape).dropDuplicates(["node"])


def _digest(held: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    both = np.array([np.bitwise_xor.reduce(held, initial=0), np.add.reduce(mix(held), initial=0)], np.uint64)
    return tuple(both.view(np.int64).tolist())


def node() -> Column:
    """The id a document has in the graph: its own, or a negative one made from its text."""
    made = -F.shiftrightunsigned(F.xxhash64("text"), 1) - 1
    return F.coalesce(F.col("doc_id").cast("bigint"), made)


def _join(label: np.ndarray, a: int, others: np.ndarray) -> Iterator[int]:
    """Give all ``others`` the label of ``a``; yields one of them for each label that goes."""
    gone, first = np.unique(label[others], return_index=True)
    for old, at in zip(gone.tolist(), first.tolist(), strict=True):
        if old != label[a]:
            label[label == old] = label[a]
            yield int(others[at])


def _edges(pairs: list[tuple[int, int]]) -> dict[str, pa.Array]:
    return {
        "src": pa.array([min(p) for p in pairs], pa.int64()),
        "dst": pa.array([max(p) for p in pairs], pa.int64()),
    }


def _split_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Join ``rows`` to ``keys``, which say in ``count`` how many rows they have; those of many rows are split."""
    limit = max(500, total // HOT)
    parts = F.ceil(F.col(count) / limit).cast("bigint")
    # At most HOT keys have that many rows.
    hot = F.broadcast(keys.filter(F.col(count) > limit).select(*on, parts.alias("_parts")))
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("node"), "_parts")).otherwise(0)
    spread = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col(count) > limit, parts).otherwise(1) - 1))
    salted = rows.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    return salted.join(keys.withColumn("_part", spread), [*on, "_part"]).drop("_part")


def _left_open(members: DataFrame, near: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Edges (``src, dst``) between members of a bucket that its smallest member doesn't join.

    That one has been compared with all others; ``near`` are its edges. ``few`` are the members without one. Each pair
    left to look at has one of them, so blocks of the few meet blocks of all members.
    """
    joined = near.toDF("leader", "node").withColumn("near", F.lit(True))
    labelled = (
        members.join(joined, ["leader", "node"], "left")
        .withColumn("few", F.col("near").isNull() & (F.col("node") != F.col("leader")))
        .withColumn("label", F.when(F.col("few"), F.col("node")).otherwise(F.col("leader")))
        .drop("near")
    )
    open_ = (
        labelled.groupBy("band", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("few").alias("n_few"))
        .filter((F.col("n") > 2) & (F.col("n_few") > 0))
        .withColumns({"all": F.col("n"), "n": F.ceil(F.col("n") / BLOCK), "n_few": F.ceil(F.col("n_few") / BLOCK)})
    )
    # Read twice, for the hot keys and for the join.
    open_ = written(open_, "open-buckets")
    rows = _split_join(labelled, open_, ["band", "bucket"], "all", total).drop("all")
    rows = rows.join(classes.select("node", "registers"), "node")

    def run(group: pa.Table) -> pa.Table:
        side, ids, label, few = (group.column(n).to_numpy() for n in ("side", "node", "label", "few"))
        sketch = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        label, others, pairs = label.copy(), np.flatnonzero(side == 0), []
        for a in np.flatnonzero(side == 1):
            # A pair of two of the few meets twice: once is enough.
            near = others[(label[others] != label[a]) & (~few[others] | (ids[others] > ids[a]))]
            near = near[agreement(sketch[near], sketch[a]) >= HOPELESS]
            pairs += [(int(ids[a]), int(ids[b])) for b in _join(label, a, near)]
        return pa.table(_edges(pairs))

    blocks = _blocks(rows, ["band", "bucket"], "n", "n_few", ["label", "registers"])
    return blocks.applyInArrow(run, "src bigint, dst bigint").distinct()


def _blocks(rows: DataFrame, by: list[str], chunks: str, few_chunks: str, columns: list[str]) -> GroupedData:
    """Groups in which a block of the ``few`` rows (side 1) meets a block of all rows (side 0)."""
    shape = [*by, "i", "j", "side", "node", "few", *columns]
    own = F.xxhash64("node")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))

    many = rows.withColumns({"side": F.lit(0), "i": every(few_chunks)})
    many = many.withColumn("j", F.pmod(own, chunks).cast("int"))
    few = rows.filter("few").withColumns({"side": F.lit(1), "j": every(chunks)})
    few = few.withColumn("i", F.pmod(own, few_chunks).cast("int"))
    return many.select(*shape).unionByName(few.select(*shape)).groupBy(*by, "i", "j")


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which of the sets ``left`` (rows) and ``right`` (columns) are similar enough, exactly."""
    sizes = np.array([len(x) for x in left + right])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values = np.concatenate(left + right)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    # A shingle that a single set holds adds nothing.
    several = np.bincount(column, minlength=1)[column] > 1
    owner, column = owner[several], column[several]
    column = np.cumsum(np.concatenate(([0], (column[1:] != column[:-1]).astype(np.int64)))) if len(column) else column
    shared = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _WIDTH):
        begin, end = np.searchsorted(column, (first, first + _WIDTH))
        held = np.zeros((len(sizes), min(_WIDTH, int(column[-1]) + 1 - first)), np.float32)
        held[owner[begin:end], column[begin:end] - first] = 1
        shared += held[: len(left)] @ held[len(left) :].T
    a, b = sizes[: len(left), None], sizes[None, len(left) :]
    return 100 * shared.astype(np.int64) >= LEAST * (a + b - shared.astype(np.int64))


def _arrays(group: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(value.as_buffer(), np.uint64) for value in group.column("shingles")]


def _family_components(sets: DataFrame) -> DataFrame:
    """``node, component``: members of a family that full sets link, directly or by others, share a component."""
    chunk = F.pmod(F.xxhash64("node"), "chunks").cast("int")
    rows = sets.filter("node <> family").withColumn("chunk", chunk)
    leaders = sets.filter("node = family").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1))
    )

    def within(group: pa.Table) -> pa.Table:
        ids, family = group.column("node").to_numpy(), group.column("family")[0].as_py()
        arrays = _arrays(group)
        near, label = linked(arrays, arrays), ids.copy()
        for a in range(len(ids)):
            for _ in _join(label, a, np.flatnonzero(near[a])):
                pass
        root = {old: int(ids[label == old].min()) for old in np.unique(label).tolist()}
        top = label[ids == family]
        if len(top):
            root[int(top[0])] = family
        return pa.table(
            {
                "family": group.column("family"),
                "chunks": group.column("chunks"),
                "node": group.column("node"),
                "root": pa.array([root[x] for x in label.tolist()], pa.int64()),
            }
        )

    shape = "family bigint, chunks bigint, node bigint, root bigint"
    labels = written(rows.unionByName(leaders).groupBy("family", "chunk").applyInArrow(within, shape), "labels")

    # Families of several chunks: members not linked to the smallest may be linked across chunks.
    several = labels.filter("chunks > 1").withColumn("few", F.col("root") != F.col("family"))
    open_ = several.groupBy("family").agg(F.count_if("few").alias("n_few")).filter("n_few > 0")
    open_ = open_.withColumn("n_few", F.ceil(F.col("n_few") / BLOCK))
    left = written(spread_join(several.dropDuplicates(["node"]).drop("chunks"), open_, ["family"], "node"), "open")
    across = left.join(sets.filter("chunks > 1").drop("family"), "node")

    def between(group: pa.Table) -> pa.Table:
        side, ids, label, few = (group.column(n).to_numpy() for n in ("side", "node", "root", "few"))
        a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        pairs: list[tuple[int, int]] = []
        if len(a) and len(b):
            arrays, label = _arrays(group), label.copy()
            near = linked([arrays[i] for i in a], [arrays[i] for i in b])
            for at, i in enumerate(a.tolist()):
                own = b[near[at] & (~few[b] | (ids[b] > ids[i]))]
                pairs += [(int(ids[i]), int(ids[j])) for j in _join(label, i, own)]
        return pa.table(_edges(pairs))

    blocks = _blocks(across, ["family"], "chunks", "n_few", ["root", "shingles"])
    across_links = blocks.applyInArrow(between, "src bigint, dst bigint")
    links = left.filter("root <> node").select(F.col("root").alias("src"), F.col("node").alias("dst"))
    settled = spread_join(labels, open_.select("family"), ["family"], "node", "left_anti")
    settled = settled.select("node", F.col("root").alias("component")).distinct()
    return settled.unionByName(_components(links.unionByName(across_links)))


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, node, n_shingles, component_id, kept``: the group of near copies of each document.

    A document's set has its distinct shingles of five words (A-Z in lower case, words between white space);
    with fewer words it is all of them as one; without words or with a null text it is empty and
    linked with nothing. Documents are linked if they share 75 % of the union of their sets, and
    ``component_id`` is the smallest ``doc_id`` that links lead to. ``kept`` marks the document that has
    it. Rows with the same ``doc_id`` are one document, whatever their texts are linked with, and stay or go together. A row
    without ``doc_id`` takes part, but stands for its group only if no other row of the group has an id; then
    ``component_id`` is null. An empty table gives an empty result. Other columns are not read.
    """
    given = docs.select("doc_id", "text")
    own = run_tables(docs.sparkSession).write(sketches(given), "sketches")
    total, own = own.rows, own.df
    limit = max(500, total // HOT)
    filled = own.filter("a is not null")
    # Equal sets are one class, with a number of its own; ``of`` is the smallest document that has the set.
    classes = written(
        filled.groupBy("a", "b")
        .agg(F.min("node").alias("of"), F.min("registers").alias("registers"), F.min("n_shingles").alias("n_shingles"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    bands = _bands(classes)
    leaders = (
        bands.groupBy("band", "bucket")
        .agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("leader") != F.col("last"))
        .drop("last")
    )
    leaders = written(leaders, "leaders")
    members = written(_split_join(bands, leaders, ["band", "bucket"], "n", BANDS * total).drop("n"), "members")
    stars = (
        members.filter(F.col("leader") != F.col("node"))
        .select(F.col("leader").alias("src"), F.col("node").alias("dst"))
        .distinct()
    )
    near = written(_promising(stars, classes), "promising")
    more = written(_left_open(members, near, classes, BANDS * total), "left-open")
    families = _components(near.unionByName(more))
    families = families.select("node", F.col("component").alias("family"))
    families = families.join(classes.drop("registers"), "node")
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / CHUNK))
    chunks = families.groupBy("family").agg(size.alias("chunks"))
    sets = written(_sets(given, spread_join(families.drop("n_shingles"), chunks, ["family"], "node")), "sets")
    component = written(_family_components(sets), "components")

    named = classes.select("a", "b", "node").join(component, "node", "left")
    named = named.select("a", "b", F.coalesce("component", "node").alias("group"))
    grouped = written(lookup(filled.drop("registers"), named, "b", ["a"], "inner", total, hot_rows=limit), "grouped")
    tied = run_tables(docs.sparkSession).write(_tied(grouped), "tied")
    if tied.rows:
        grouped = lookup(grouped, tied.df, "group", (), "left", total, hot_rows=limit)
        grouped = grouped.withColumn("group", F.coalesce("tied", "group")).drop("tied")

    # Rows without words have their document's group, if it has one, or none.
    known = grouped.groupBy("node").agg(F.min("group").alias("group"))
    alone = own.filter("a is null").drop("registers")
    alone = lookup(alone, known, "node", (), "left", total, hot_rows=limit)
    grouped = union(grouped, alone.filter("group is not null"))
    ids = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    grouped = lookup(grouped, ids, "group", (), "inner", total, hot_rows=limit)
    alone = alone.filter("group is null").withColumn("component_id", F.col("doc_id"))
    return union(grouped, alone.select(*grouped.columns)).select(
        "doc_id",
        "node",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _tied(rows: DataFrame) -> DataFrame:
    """``group, tied``: groups that rows of one document tie together, with the smallest of them."""
    several = rows.groupBy("node").agg(F.min("group").alias("src"), F.max("group").alias("last"))
    several = several.filter(F.col("src") < F.col("last")).drop("last")
    ties = rows.join(several, "node").filter(F.col("group") != F.col("src")).select("src", F.col("group").alias("dst"))
    return _components(ties).toDF("group", "tied")


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links, tables=run_tables(links.sparkSession))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    gone = near_copies(docs).filter(~F.col("kept")).select(F.col("node").alias("_copy")).distinct()
    keyed = docs.withColumn("_copy", node())
    return keyed.join(small_side(gone, "copies"), "_copy", "left_anti").select(*docs.columns)
