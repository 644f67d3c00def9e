"""Mix sources to target weights by balanced sampling with the cube method.

A source with target t and size s takes every document t / s times on average. The whole part is
taken of every document; the fraction is the document's inclusion probability. The cube method turns
the probabilities into zeros and ones while it holds, per source, the expected number of words and of
documents: it moves the probabilities of a few documents along a vector that changes neither
total until one of them reaches 0 or 1. Chunks of a source are treated apart; each leaves at most two
documents undecided, and these meet again in the next pass. When one chunk per source is
left, its last two documents land together with a few that waited, in the way that comes nearest to
the expected totals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archipelago.llm.tables import row_key, small_side, spread_join, written

# Fixed values of the mix: the weights in turn, the share of all sizes, and the cap.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
# Documents that one task decides at a time.
CHUNK = 4096

# Documents of a source that wait for the landing.
WAITING = 12

# Documents with so many times the mean words are decided first, against all others.
LARGE = 4

_EPS = 1e-9


def word_count(text: Column | str) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Add ``number``: 0, 1, ... in the order of some columns, without one task for all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        ranged.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    within = F.col("_at") - F.shiftleft("_part", 33)
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(sizes), "_part")
        .withColumn("number", F.col("_before") + within)
        .drop("_part", "_before", "_at")
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """Add ``target`` to ``missing, name, source_size`` (one row per source).

    Sources in the order of ``missing, name`` weigh ``weights`` in turn and share ``share`` times
    all sizes; a target stops at ``most`` times its source's size, and what is over is shared again by
    weight. Each pass over the sources raises the level (words per unit of weight) that those
    below their cap get, until no further source reaches its cap.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    ranked = written(
        numbered(sizes, "missing", "name").withColumn("weight", weight).drop("number"), "sources"
    )
    cap = most * F.col("source_size")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, None
    while total:
        over = level * F.col("weight") >= cap
        seen = ranked.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("spent"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("left"),
            F.count_if(over).alias("capped"),
        ).first()
        if seen["capped"] == capped or not seen["left"]:
            break
        capped = seen["capped"]
        level = (share * total - seen["spent"]) / seen["left"]
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap.cast("double")))


def _shifted(chance: np.ndarray, ones: np.ndarray, sizes: np.ndarray, rows: float, words: float) -> np.ndarray | None:
    """Chances with these totals of documents and words, the given ones mixed with extreme ones; None if there are none."""
    had, most = chance @ ones, ones.sum()
    if not 0 <= rows <= most:
        return None
    moved = chance * (rows / had) if rows <= had else 1 - (1 - chance) * ((most - rows) / (most - had))
    tokens = ones * sizes
    order = np.argsort(sizes if moved @ tokens > words else -sizes, kind="stable")
    extreme = np.zeros(len(chance))
    extreme[order] = np.clip((rows - np.cumsum(ones[order]) + ones[order]) / ones[order], 0, 1)
    apart, off = extreme @ tokens - moved @ tokens, words - moved @ tokens
    if abs(off) <= 1e-9 * tokens.sum():
        return moved
    return moved + off / apart * (extreme - moved) if 0 < off / (apart or -off) <= 1 else None


def _walked(
    unit: int, chance: np.ndarray, ones: np.ndarray, sizes: np.ndarray, draw: np.random.Generator
) -> np.ndarray | None:
    """Chances after ``unit`` has reached 0 or 1 in steps that move all others a little; None if these run out."""
    chance, kept = chance.copy(), np.vstack((ones * sizes / (ones[unit] * sizes[unit]), ones))
    while 0 < chance[unit] < 1:
        others = np.flatnonzero((chance > 0) & (chance < 1))
        others = others[others != unit]
        if len(others) < 3:
            return None
        pull = chance[others] * (1 - chance[others]) * kept[:, others]
        along = -np.linalg.lstsq(pull @ kept[:, others].T, kept[:, unit], rcond=1e-12)[0] @ pull
        if np.abs(kept[:, others] @ along + kept[:, unit]).max() > 1e-9:
            return None
        units, step = np.append(others, unit), np.append(along, 1.0)
        units, step = units[step != 0], step[step != 0]
        above, below = (1 - chance[units]) / np.abs(step), chance[units] / np.abs(step)
        up, down = np.where(step > 0, above, below).min(), np.where(step > 0, below, above).min()
        moved = chance[units] + (up if draw.random() * (up + down) < down else -down) * step
        chance[units] = np.where(moved < _EPS, 0.0, np.where(moved > 1 - _EPS, 1.0, moved))
    return chance


def decide_large(chances: np.ndarray, counts: np.ndarray, sizes: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Decide the units that are large beside the others, while those can still make up for them.

    Both totals are held by steps like those of :func:`flight`. If such steps run out, the unit is drawn and the
    others' chances are shifted: to both totals, else to that of the words, else as near to it as they come.
    """
    chance, ones, tokens = chances.astype(float), counts.astype(float), (counts * sizes).astype(float)
    for unit in np.argsort(-tokens, kind="stable"):
        others = np.flatnonzero((chance > 0) & (chance < 1))
        others = others[others != unit]
        # Documents without words make up for nothing.
        if len(others) < 3 or not tokens[others].any() or tokens[unit] <= LARGE * tokens[others].mean():
            break
        if not 0 < chance[unit] < 1:
            continue
        held, own, many = chance[others], ones[others], sizes[others].astype(float)
        drawn = float(draw.random() < chance[unit])
        tried = []
        for outcome in (drawn, 1 - drawn):
            off = chance[unit] - outcome
            rows, words = held @ own + off * ones[unit], held @ (own * many) + off * tokens[unit]
            tried.append((outcome, words, _shifted(held, own, many, rows, words)))
        walked = None
        if all(moved is not None for *_, moved in tried):
            walked = _walked(unit, chance, ones, sizes, draw)
        if walked is not None:
            chance = walked
            continue
        found = [(outcome, moved) for outcome, _, moved in tried if moved is not None]
        if found:
            outcome, moved = found[0]
        else:
            most = own @ many
            outcome, words, _ = min(tried, key=lambda t: max(0.0, -t[1], t[1] - most))
            had, words = held @ (own * many), min(max(words, 0.0), most)
            moved = held * (words / had) if words <= had else 1 - (1 - held) * ((most - words) / (most - had))
        chance[unit] = outcome
        chance[others] = np.where(moved < _EPS, 0.0, np.where(moved > 1 - _EPS, 1.0, moved))
    return chance


def flight(chances: np.ndarray, counts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Move inclusion probabilities to 0 or 1, keeping sum(chance * count) and sum(chance * count * size).

    At most two stay in between.
    """
    draw = np.random.Generator(np.random.PCG64(seed))
    chance = decide_large(chances, counts, sizes, draw).tolist()
    ones, tokens = counts.tolist(), (counts * sizes).tolist()
    held: list[int] = []

    def move(units: list[int], along: tuple[float, ...]) -> None:
        up = down = math.inf
        for unit, step in zip(units, along, strict=True):
            if step:
                above, below = (1 - chance[unit]) / abs(step), chance[unit] / abs(step)
                up = min(up, above if step > 0 else below)
                down = min(down, below if step > 0 else above)
        by = up if draw.random() * (up + down) < down else -down
        for unit, step in zip(units, along, strict=True):
            value = chance[unit] + by * step
            chance[unit] = 0.0 if value < _EPS else 1.0 if value > 1 - _EPS else value

    for unit in range(len(chance)):
        if 0 < chance[unit] < 1:
            held.append(unit)
        while len(held) == 3:
            a, b, c = held
            along = (
                ones[b] * tokens[c] - ones[c] * tokens[b],
                ones[c] * tokens[a] - ones[a] * tokens[c],
                ones[a] * tokens[b] - ones[b] * tokens[a],
            )
            if not any(along):
                along = (ones[b], -ones[a], 0)
            largest = max(map(abs, along))
            move(held, tuple(x / largest for x in along))
            held = [x for x in held if 0 < chance[x] < 1]
    return np.array(chance)


def landing(chances: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Decide a few units at once: of all outcomes the one nearest to the expected words, then documents."""
    n = len(chances)
    outcomes = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    off = np.abs(outcomes @ (counts * sizes) - chances @ (counts * sizes))
    off += 1e-3 * np.abs(outcomes @ counts - chances @ counts)
    return outcomes[int(np.argmin(off))].astype(float)


def waiting(moving: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Which of ``moving``, in descending order of words, wait for the landing: small ones of different sizes.

    With them it can even out what the flight leaves.
    """
    small = moving[tokens[moving] <= 2 * tokens[moving].mean()] if len(moving) else moving
    return small[np.unique(np.linspace(0, len(small) - 1, min(WAITING, len(small))).astype(int))]


def _balance(units: DataFrame, land: bool) -> DataFrame:
    """One pass: the chances of each chunk of a source, moved."""

    def run(group: pa.Table) -> pa.Table:
        # In descending order, so that small ones are left to the end.
        group = group.sort_by([("size", "descending"), ("a", "ascending"), ("b", "ascending")])
        value = {name: group.column(name).to_numpy() for name in ("chance", "rows", "size", "a", "chunk")}
        seed = int(np.bitwise_xor.reduce(value["a"])) & 0xFFFFFFFF ^ int(value["chunk"][0])
        chance, rows, size = value["chance"].copy(), value["rows"], value["size"]
        moving = np.flatnonzero((chance > 0) & (chance < 1))
        # One chunk of each that meet in the next pass holds small documents back.
        if land or value["chunk"][0] % (CHUNK // 2) == 0:
            moving = np.setdiff1d(moving, waiting(moving, rows * size))
        chance[moving] = flight(chance[moving], rows[moving], size[moving], seed)
        if land:
            last = np.flatnonzero((chance > 0) & (chance < 1))
            chance[last] = landing(chance[last], rows[last], size[last])
        moved = chance
        return group.set_column(group.column_names.index("chance"), "chance", pa.array(moved))

    # Dealt by chunk, or all chunks of a source would stay where a join by source has brought them.
    dealt = units.repartition("missing", "name", "chunk")
    return dealt.groupBy("missing", "name", "chunk").applyInArrow(run, units.schema)


def cube_sample(units: DataFrame) -> DataFrame:
    """Decide ``chance`` of all units (``a, b, missing, name, size, rows, chance``) to 0 or 1.

    ``a`` and ``b`` identify a unit, ``rows`` is how many equal rows it stands for.
    """
    by = ("missing", "name")
    chunks = units.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    most = chunks.agg(F.max("chunks")).first()[0]
    if most is None:
        return units
    open_ = spread_join(units, chunks, list(by), "a").withColumn("chunk", F.pmod(F.xxhash64("a", "b"), "chunks"))
    open_, decided = open_.drop("chunks"), None
    while True:
        moved = written(_balance(open_, land=most <= 1), "cube-pass")
        still = F.col("chance").between(_EPS, 1 - _EPS)
        done = moved.filter(~still).drop("chunk")
        decided = done if decided is None else decided.unionByName(done)
        if most <= 1:
            return decided
        # Two units of each chunk are left, so this many chunks fill one of the next pass.
        most = -(-most // (CHUNK // 2))
        open_ = moved.filter(still).withColumn("chunk", F.floor(F.col("chunk") / (CHUNK // 2)))


def mix_sources(docs: DataFrame) -> DataFrame:
    """How often the mix takes each document.

    Returns ``doc_id, source, a, b, rows, size, source_size, target, copies``: one row for each distinct
    (``doc_id``, ``source``, ``text``), which stands for ``rows`` equal rows of ``docs``; each of them is
    taken ``copies`` times, 0, 1 or 2. ``a`` and ``b`` are its :func:`key`. A null text has size 0; a null
    source is a source of its own, after all others; a source without words has target 0; an empty
    table gives an empty result. Other columns are not read. The same rows give the same mix in
    any order and number of partitions.
    """
    units = written(
        docs.select("doc_id", "source", key().alias("_key"), word_count("text").alias("size"))
        .groupBy("doc_id", "source", F.col("_key.a").alias("a"), F.col("_key.b").alias("b"), "size")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("missing", F.col("source").isNull())
        .withColumn("name", F.coalesce("source", F.lit(""))),
        "units",
    )
    by = ["missing", "name"]
    targets = written(
        source_targets(units.groupBy(*by).agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))),
        "targets",
    ).select(*by, "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + F.lit(_EPS))
    aimed = spread_join(units, targets, by, "a")
    open_ = aimed.select(
        "a", "b", *by, "size", "rows", F.greatest(rate - whole, F.lit(0.0)).alias("chance")
    )
    chosen = cube_sample(open_).select("a", "b", F.round("chance").cast("bigint").alias("chosen"))
    return (
        aimed.join(chosen, ["a", "b"])
        .withColumn("copies", whole + F.col("chosen"))
        .select("doc_id", "source", "a", "b", "rows", "size", "source_size", "target", "copies")
    )


def key() -> Column:
    """What identifies a document to :func:`mix_sources`."""
    return row_key("doc_id", "source", "text")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns."""
    copies = mix_sources(docs).filter("copies > 0").select("a", "b", "copies")
    key_a, key_b, times = "_mix_a", "_mix_b", "_mix_copies"
    copies = copies.toDF(key_a, key_b, times)
    return (
        docs.withColumn("_mix_key", key())
        .withColumns({key_a: F.col("_mix_key.a"), key_b: F.col("_mix_key.b")})
        .join(small_side(copies, "copies"), [key_a, key_b])
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
        .select(*docs.columns)
    )
