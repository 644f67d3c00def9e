"""Drop lines that many documents repeat, with levelled sorted runs of line hashes.

The lines with a key are written once and arrive in batches of documents. A batch is reduced to one row per line key: how
many of its documents hold it and the largest of them. One merge join with the runs of earlier batches decides
what becomes of it: keys that no run has are the batch's own run, so a key is in one run only; the others are
updates of their counts. As soon as a level has ``FANOUT`` runs, they are compacted into one run of the next level and
updates are added to the keys they belong to, so a key is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archipelago.llm.tables import row_key, run_tables, spread_join, union, written
from archipelago.sources.round_tables import RoundTable

# Code points that a key needs, and documents that must hold it.
KEY_LENGTH = 40
DOCUMENTS = 5
# Lines of a batch, and the most batches that a table is dealt to; runs of a level that are compacted.
BATCH_LINES = 500_000
MOST_BATCHES = 16
FANOUT = 3

_WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, with A-Z in lower case."""
    bare = F.btrim(line, F.lit(_WHITE))
    # Where all characters are ASCII this is what lower() does, which is much faster.
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lines(text: Column | str) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    text = F.col(text) if isinstance(text, str) else text
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, length: int = KEY_LENGTH) -> DataFrame:
    """``doc_id, a, b, place, line``: the lines with a long key, by its 128-bit digest."""
    key = line_key(F.col("line"))
    return (
        docs.select("doc_id", row_key("doc_id", "text").alias("_key"), F.posexplode(lines("text")))
        .select("doc_id", "_key.a", "_key.b", F.col("pos").alias("place"), F.col("col").alias("line"))
        .filter(F.length(key) >= length)
        .withColumn("line", F.unhex(F.md5(key)))
    )


@dataclass(frozen=True)
class Run:
    """``line, documents, largest``: the keys that were new, and updates of keys in earlier runs.

    Both are parts of one table.
    """

    keys: RoundTable
    updates: RoundTable | None = None


def _merged(runs: list[Run]) -> DataFrame:
    """``line, documents, largest, own``: counts of all runs; ``own`` is false for keys that are in none of them."""
    frames = [run.keys.df.withColumn("own", F.lit(True)) for run in runs]
    frames += [run.updates.df.withColumn("own", F.lit(False)) for run in runs if run.updates is not None]
    return (
        union(*frames)
        .groupBy("line")
        .agg(F.sum("documents").alias("documents"), F.max("largest").alias("largest"), F.max("own").alias("own"))
    )


class LineRuns:
    """The line keys of all batches so far, as runs sorted by key, in levels."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self._tables = run_tables(spark)
        self._fanout = fanout
        self.levels: list[list[Run]] = [[]]

    def _write(self, rows: DataFrame, name: str) -> Run:
        """A run of ``line, documents, largest, own``, its updates apart: one table, sorted by key in each part."""
        rows = rows.select("line", "documents", "largest", "own").sortWithinPartitions("own", "line")
        written = self._tables.write(rows, name, partition_by=("own",), fresh=F.count_if("own"))
        fresh = written.sums["fresh"]
        keys, updates = (
            RoundTable(written.df.filter(chosen).drop("own"), written.path, number, {})
            for chosen, number in ((F.col("own"), fresh), (~F.col("own"), written.rows - fresh))
        )
        return Run(keys, updates if updates.rows else None)

    def _all(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> Run:
        """Add the keys of a batch of :func:`keyed_lines` and return its run.

        A batch must hold all rows of the documents in it. The run can be read until the next batch is added.
        """
        self._compact()
        own = (
            batch.select("line", "doc_id")
            .distinct()
            .groupBy("line")
            .agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("largest"))
        )
        earlier = self._all()
        if earlier:
            # No key is in two runs.
            known = union(*[run.keys.df.select("line") for run in earlier]).withColumn("known", F.lit(True))
            own = own.join(known.hint("merge"), "line", "left").withColumn("own", F.col("known").isNull())
        else:
            own = own.withColumn("own", F.lit(True))
        run = self._write(own, "run-0")
        self.levels[0].append(run)
        return run

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self._fanout:
                full, self.levels[level] = self.levels[level], []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(_merged(full), f"run-{level + 1}"))
                self._tables.drop(*[run.keys for run in full])
            level += 1

    def repeated(self, documents: int = DOCUMENTS) -> DataFrame:
        """``line, largest``: the keys that at least so many documents hold, and the last of these."""
        if not self._all():
            raise ValueError("no batch was added")
        return _merged(self._all()).filter(F.col("documents") >= documents).select("line", "largest")


def repeated_lines(keyed: DataFrame, rows: int, documents: int = DOCUMENTS, batches: int | None = None) -> DataFrame:
    """``line, largest`` for all documents, added to the runs in batches of about ``BATCH_LINES`` lines.

    ``keyed`` are :func:`keyed_lines` with ``bucket``, ``rows`` their number.
    """
    batches = batches or min(MOST_BATCHES, max(1, -(-rows // BATCH_LINES)))
    runs = LineRuns(keyed.sparkSession)
    for batch in range(batches):
        runs.add(keyed.filter(F.col("bucket") % batches == batch))
    return runs.repeated(documents)


def drop_repeated_lines(
    docs: DataFrame, batches: int | None = None, length: int = KEY_LENGTH, documents: int = DOCUMENTS
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``: the texts without repeated lines.

    A line's key is the line stripped of white space, A-Z in lower case. Keys of at least ``length``
    code points that ``documents`` documents hold lose all their lines, except in the largest
    ``doc_id`` that holds them. A null or empty text has one empty line. Rows with one ``doc_id`` are one
    document; rows without are one document too, which is never the largest, unless no
    other holds the key, and then loses its lines as well. Equal rows are treated alike, an empty
    table gives an empty result, and other columns are not read. The texts are read twice, for the lines and for the
    result. ``batches``, up to ``MOST_BATCHES``, follow the number of lines by default.
    """
    docs = docs.select("doc_id", "text")
    dealt = keyed_lines(docs, length).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(MOST_BATCHES)).cast("int"))
    keyed = run_tables(docs.sparkSession).write(dealt, "keyed-lines", partition_by=("bucket",))
    repeated = written(repeated_lines(keyed.df, keyed.rows, documents, batches), "repeated-lines")
    lost = (
        spread_join(keyed.df, repeated, ["line"], "a")
        .filter(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("largest")))
        .groupBy("a", "b")
        .agg(F.collect_set("place").alias("places"))
    )
    own = docs.withColumn("_key", row_key("doc_id", "text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "places")
    return (
        own.select("doc_id", "text", "_key.a", "_key.b")
        .join(lost, ["a", "b"], "left")
        .withColumn("all", lines("text"))
        .select(
            "doc_id",
            F.size("all").cast("bigint").alias("n_lines"),
            F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_dropped"),
            F.when(F.col("places").isNull(), F.coalesce("text", F.lit("")))
            .otherwise(F.array_join(F.transform(kept, lambda place: F.get("all", place)), "\n"))
            .alias("kept"),
        )
    )
