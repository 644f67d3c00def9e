"""Quality rules: minimum-covariance-determinant outliers among text statistics.

Each text becomes a vector of transformed statistics. For each language and source the minimum covariance
determinant is sought: the part of the documents, three in four, whose statistics spread least. It starts
at the medians with three covariances that outliers can't all spoil (see :func:`_starts`), and takes concentration
steps: distances under the present centre and covariance, then centre and covariance of the closest three quarters.
After two steps the start with the smallest determinant goes on alone, until the determinant of no group gets smaller.
A step is one aggregation: documents are summed per group and distance bin, so a group of any size arrives as a few
hundred rows. Documents too far from the final centre, by Mahalanobis distance, are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archipelago.llm.arrays import (
    any_but_white,
    mix,
    release,
    shingles,
    span_hashes,
    text_pieces,
    words,
)
from archipelago.llm.tables import BROADCAST_BYTES, row_key, run_tables, small_side, spread_join, written
from archipelago.sources.round_tables import RoundTable

# Fixed values of the base rules.
FEWEST_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

# Transformed statistics, in steps of 1 / GRID: shares, all but that of repeats as square roots.
VECTOR = ("word_length", "symbols", "stutter", "punctuation", "capitals", "repeats")
GRID = 4096
# Statistics are measured from their group's median in units of so many grid steps, as whole numbers of 1 / STEP.
UNIT = 160
STEP = 256
# No direction has a smaller variance than this, in these units: what is the same in three texts of four has none.
LEAST_VARIANCE = 0.1
# The share of a group that is sought; the concentration steps of all starts, and of the best of them at most.
PART = 0.75
FIRST_STEPS = 2
STEPS = 10
# The steps end when no group's determinant gets smaller by more than this part.
ENOUGH = 1e-2
# Groups of fewer documents that pass the base rules are judged together with the other small ones of their language.
FEWEST = 100
# A document is rejected beyond this squared distance. The statistics have longer tails than Gaussian ones (of which one in
# 10^39 is so far), so the limit is taken from what clean documents lose; see the README.
CUTOFF = 200.0
# Distance bins in a factor of two.
BINS = 16

_PIECE = 1 << 19


def _statistics(data: np.ndarray, limits: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of the rows of a string column."""
    rows = len(limits) - 1
    starts, ends, n_words = words(data, limits, any_but_white())

    def counted(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), limits))

    def member(characters: str) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(characters.encode())] = True
        return table[data]

    in_words = any_but_white().astype(bool)
    in_words[0x80:0xC0] = False  # later bytes of a character
    out = {"n_words": n_words, "word_chars": counted(in_words[data]), "n_symbols": counted(member(SYMBOLS))}
    out["capitals"] = counted((data >= 0x41) & (data <= 0x5A))
    out["punctuation"] = counted(member(".,;:!?'\"()-[]{}/\\_=+~^@`"))

    # Lines with a word, and equal lines.
    breaks = np.flatnonzero(data == 0x0A)
    heads = np.sort(np.concatenate((limits[:-1], breaks + 1)), kind="stable")
    tails = np.sort(np.concatenate((breaks, limits[1:])), kind="stable")
    held = np.searchsorted(starts, tails) > np.searchsorted(starts, heads)
    heads, tails = heads[held], tails[held]
    row = np.searchsorted(limits, heads, "right") - 1
    key = span_hashes(data, heads, tails) ^ mix(row.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)

    # Words equal to the word before.
    value = span_hashes(data, starts, ends)
    ends_at = np.concatenate(([0], np.cumsum(n_words)))
    again = np.zeros(len(starts), bool)
    again[1:] = value[1:] == value[:-1]
    again[ends_at[:-1][n_words > 0]] = False
    out["stutter"] = np.diff(np.searchsorted(np.flatnonzero(again), ends_at))

    # Words in windows that the text holds twice.
    window, found = shingles(value, n_words, REPEAT_WINDOW)
    row = np.repeat(np.arange(rows), found)
    window ^= mix(row.astype(np.uint64) + np.uint64(1))
    in_order = np.sort(window)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(twice):
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, window), len(twice) - 1)] == window)
        shift = ends_at[:-1] - np.concatenate(([0], np.cumsum(found)))[:-1]
        begin = at + shift[row[at]]
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + REPEAT_WINDOW, -1)
    hit = np.concatenate(([0], np.cumsum(np.cumsum(covered)[:-1] > 0)))
    out["n_repeat_words"] = hit[ends_at[1:]] - hit[ends_at[:-1]]
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs``, the counts of ``COUNTS`` and the vector of ``VECTOR``, per row.

    ``docs`` has those columns and ``text``; a null text has no words.
    """
    chosen = docs.select(*keep, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text"]
    schema = ", ".join([*fields, *(f"{n} bigint" for n in COUNTS), *(f"x_{n} bigint" for n in VECTOR)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, limits in text_pieces(batch.column(len(keep)), _PIECE):
                n = _statistics(data, limits)
                size = np.maximum(n["word_chars"], 1)
                share = {
                    "word_length": np.minimum(n["word_chars"] / np.maximum(n["n_words"], 1), 32) / 32,
                    "symbols": np.sqrt(n["n_symbols"] / size),
                    "stutter": np.sqrt(n["stutter"] / np.maximum(n["n_words"], 1)),
                    "punctuation": np.sqrt(n["punctuation"] / size),
                    "capitals": np.sqrt(n["capitals"] / size),
                    "repeats": n["n_repeat_words"] / np.maximum(n["n_words"], 1),
                }
                own = batch.slice(first, end - first)
                columns = [own.column(i) for i in range(len(keep))]
                columns += [pa.array(n[name], pa.int64()) for name in COUNTS]
                columns += [pa.array(np.rint(share[name] * GRID).astype(np.int64)) for name in VECTOR]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *COUNTS, *(f"x_{n}" for n in VECTOR)])
        release()

    return chosen.mapInArrow(run, schema)


def base_failed() -> Column:
    """Whether a document fails the fixed rules, from its counts."""
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def chi_square(x: float, freedom: float) -> float:
    """The chance that a chi-square variable is at most ``x``."""
    a, x = freedom / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a))) if x > 0 else 0.0


def chi_square_quantile(chance: float, freedom: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < chance else (low, middle)
    return high


def _group(rows: DataFrame) -> DataFrame:
    """Add ``grp``: language and source, or a pool of groups with few ``fit`` documents."""
    for columns in (("lang", "source"), ("lang",), ()):
        name = F.to_json(F.struct(F.lit(len(columns)).alias("columns"), *columns))
        if columns == ("lang", "source"):
            rows = rows.withColumn("grp", name)
            continue
        few = rows.groupBy("grp").agg(F.count_if("fit").alias("count")).filter(F.col("count") < FEWEST)
        small = few.select("grp", F.lit(True).alias("_few"))
        rows = spread_join(rows, small, ["grp"], "a", "left").withColumn("grp", F.when(F.col("_few"), name).otherwise(F.col("grp"))).drop("_few")
    return rows


def _standardised(rows: DataFrame) -> DataFrame:
    """Add ``z_*``: the statistics from the medians of their group, as whole numbers."""
    named = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"x_{n}").alias("x")) for n in VECTOR])
    bins = rows.filter("fit").select("grp", F.inline(named)).groupBy("grp", "name", "x").count()
    by = Window.partitionBy("grp", "name")
    upto = by.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    rank = bins.withColumns({"upto": F.sum("count").over(upto), "all": F.sum("count").over(by)})

    middle = F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col("x")))
    units = rank.groupBy("grp", "name").agg(middle.alias("middle"))
    units = units.groupBy("grp").pivot("name", list(VECTOR)).agg(F.first("middle"))
    for n in VECTOR:
        units = units.withColumnRenamed(n, f"u_{n}")

    def z(n: str) -> Column:
        return F.round((F.col(f"x_{n}") - F.col(f"u_{n}")) * F.lit(STEP / UNIT)).cast("bigint").alias(f"z_{n}")

    return spread_join(rows, units, ["grp"], "a", "left").select("a", "b", "grp", "fit", *map(z, VECTOR))


def _distance() -> Column:
    """Squared Mahalanobis distance under the centre and inverse covariance of the row."""
    off = [F.col(f"z_{n}") / STEP - F.get("centre", F.lit(i)) for i, n in enumerate(VECTOR)]
    total, size = F.lit(0.0), len(VECTOR)
    for i in range(size):
        for j in range(i, size):
            total = total + (1 if i == j else 2) * F.get("inverse", F.lit(i * size + j)) * off[i] * off[j]
    return total


_ESTIMATE = "grp string, start int, centre array<double>, inverse array<double>, logdet double"


def _estimate(sums: DataFrame, correction: float) -> DataFrame:
    """Centre, inverse covariance and its determinant per group and start, from sums over documents (``_ESTIMATE``)."""
    size, least = len(VECTOR), LEAST_VARIANCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                centre = np.array([row[f"s_{i}"] for i in range(size)], float) / row["n"]
                cov = np.zeros((size, size))
                for i in range(size):
                    for j in range(i, size):
                        cov[i, j] = cov[j, i] = row[f"p_{i}_{j}"] / row["n"] - centre[i] * centre[j]
                variances, axes = np.linalg.eigh(cov * correction / STEP**2)
                variances = np.maximum(variances, least)
                inverse = (axes / variances) @ axes.T
                about = {"centre": (centre / STEP).tolist(), "inverse": inverse.ravel().tolist()}
                rows.append({"grp": row["grp"], "start": row["start"], **about, "logdet": float(np.log(variances).sum())})
            kinds = [pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            names = ["grp", "start", "centre", "inverse", "logdet"]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds, strict=True))))

    return sums.mapInArrow(run, _ESTIMATE)


def _sums(weight: Column | None = None) -> dict[str, Column]:
    """Sums and sums of products of the statistics, or of these without a centre and times ``weight``."""
    z = [F.col(f"z_{n}") for n in VECTOR]
    size = range(len(z))
    nothing = F.lit(0).cast("bigint")
    sums = {f"s_{i}": F.sum(z[i]) if weight is None else F.sum(nothing) for i in size}
    times = F.lit(1) if weight is None else weight
    return sums | {f"p_{i}_{j}": F.sum(times * z[i] * z[j]) for i in size for j in size if i <= j}


def _with_estimates(rows: DataFrame, estimates: RoundTable, how: str = "inner") -> DataFrame:
    """Rows with the estimates of their group: as long as these are few, no row is moved for it."""
    size = len(VECTOR)
    if estimates.rows * 8 * (size * size + size + 8) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(estimates.df), ["grp"], how)
    return spread_join(rows, estimates.df, ["grp"], "a", how)


def _starts(fit: DataFrame) -> RoundTable:
    """First estimates (``_ESTIMATE``) of each group with enough documents, all around the medians, which are zero.

    One has the units as they are, one the products of all documents, and one the products of their directions, each
    document counting alike however far it is (the spatial sign covariance).
    """
    size = len(VECTOR)
    z = [F.col(f"z_{n}") for n in VECTOR]
    length = sum((x * x for x in z), F.lit(0)).cast("double")
    # Directions as if all documents were at a distance of one unit times the root of the statistics.
    sign = F.when(length > 0, STEP**2 * size / length).otherwise(F.lit(0.0))
    count = F.count(F.lit(1)).alias("n")
    frames = []
    for start, weight in ((1, F.lit(1.0)), (2, sign)):
        sums = fit.groupBy("grp").agg(count, *[column.alias(name) for name, column in _sums(weight).items()])
        frames.append(sums.filter(F.col("n") >= FEWEST).withColumn("start", F.lit(start)))
    identity = F.array(*[F.lit(float(i == j)) for i in range(size) for j in range(size)])
    plain = frames[0].select(
        "grp",
        F.lit(0).alias("start"),
        F.array(*[F.lit(0.0)] * size).alias("centre"),
        identity.alias("inverse"),
        F.lit(0.0).alias("logdet"),
    )
    starts = plain.unionByName(_estimate(frames[0].unionByName(frames[1]), 1.0))
    return run_tables(fit.sparkSession).write(starts, "starts")


def _concentrate(rows: DataFrame, estimates: RoundTable) -> RoundTable:
    """One concentration step: new estimates from the closest part of each group."""
    size = len(VECTOR)
    correction = PART / chi_square(chi_square_quantile(PART, size), size + 2)
    bin_ = F.floor(BINS * F.log2(1 + F.greatest(_distance(), F.lit(0.0))))
    sums = _sums()
    binned = (
        _with_estimates(rows.filter("fit"), estimates)
        .withColumn("bin", bin_)
        .groupBy("grp", "start", "bin")
        .agg(F.count(F.lit(1)).alias("n"), *[column.alias(name) for name, column in sums.items()])
    )
    by = Window.partitionBy("grp", "start")
    before = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    closest = (
        binned.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "all": F.sum("n").over(by)})
        .filter(F.col("before") < PART * F.col("all"))
        .groupBy("grp", "start")
        .agg(*[F.sum(name).alias(name) for name in ("n", *sums)])
    )
    return run_tables(rows.sparkSession).write(_estimate(closest, correction), "estimates")


def minimum_determinant(rows: DataFrame) -> RoundTable:
    """``grp, start, centre, inverse, logdet``: the estimate of each group that has ``FEWEST`` documents or more.

    ``rows`` has ``grp, fit, a`` and the statistics ``z_*``; a null ``fit`` or a false one takes no part.
    """
    estimates = _starts(rows.filter("fit"))
    for _ in range(FIRST_STEPS):
        estimates = _concentrate(rows, estimates)
    best = F.min_by(F.struct("start", "centre", "inverse", "logdet"), F.struct("logdet", "start"))
    chosen = estimates.df.groupBy("grp").agg(best.alias("best")).select("grp", "best.*")
    estimates = run_tables(rows.sparkSession).write(chosen, "best-start")
    for _ in range(STEPS):
        before, estimates = estimates, _concentrate(rows, estimates)
        smaller = before.df.select("grp", F.col("logdet").alias("was")).join(estimates.df, "grp")
        if not smaller.agg(F.max(F.col("was") - F.col("logdet") > ENOUGH)).first()[0]:
            break
    return estimates


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, a, b``, the counts, ``base_failed``, ``distance``, ``kept``: the verdict on every row.

    ``docs`` has ``doc_id, text, lang, source``; other columns are not read. ``base_failed`` documents are
    rejected and left out of the estimates. Others are rejected beyond a squared distance of ``CUTOFF``. Words count as 32
    characters long at most on average. Null languages and sources are groups of their own; a null or empty text has no words
    and fails. Groups are small by the documents that pass the base rules; if all
    small groups together have fewer than ``FEWEST`` of these, those are kept (their distance is null). Equal rows get equal verdicts; an empty table gives an empty result. ``a`` and
    ``b`` are the row's :func:`key`.
    """
    keyed = docs.select("doc_id", "lang", "source", "text", key().alias("_key")).select(
        "doc_id", "lang", "source", "text", F.col("_key.a").alias("a"), F.col("_key.b").alias("b")
    )
    rows = written(text_statistics(keyed, "doc_id", "lang", "source", "a", "b"), "statistics")
    rows = rows.withColumn("base_failed", base_failed())
    fit = rows.withColumn("fit", ~F.col("base_failed"))
    fit = fit.select("a", "b", "lang", "source", "fit", *[f"x_{n}" for n in VECTOR]).dropDuplicates(["a", "b"])
    z = written(_standardised(_group(fit)), "standardised")
    estimates = minimum_determinant(z)
    distances = _with_estimates(z, estimates, "left").select("a", "b", _distance().alias("distance"))
    near = F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return rows.join(distances, ["a", "b"]).select(
        "doc_id", "a", "b", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & near).alias("kept")
    )


def key() -> Column:
    """What identifies a document to :func:`judged`."""
    return row_key("doc_id", "lang", "source", "text")


def reject_outliers(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    names = {"a": "_verdict_a", "b": "_verdict_b"}
    gone = judged(docs).filter(~F.col("kept")).select("a", "b").distinct().withColumnsRenamed(names)
    keyed = docs.withColumn("_verdict", key()).withColumns({n: F.col(f"_verdict.{k}") for k, n in names.items()})
    return keyed.join(small_side(gone, "rejected"), list(names.values()), "left_anti").select(*docs.columns)
