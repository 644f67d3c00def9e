"""The registered queries on the smallest tables, and the pipeline."""

from __future__ import annotations

import zlib
from pathlib import Path

import pytest

import corpus_pipeline
from archipelago.llm import mixing, near_copies, ppm, quality
from archipelago.llm.oracles import oracle_sql
from archipelago.llm.queries import queries
from archipelago.sources import RoundTables
from tests.llm import brute
from tests.llm.conftest import same

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in sorted(FOLDER.glob("*.parquet")):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(str(FOLDER / "documents.parquet")).collect()
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows]


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, database, name):
    result = queries()[name](spark, str(FOLDER))
    columns = sorted(result.columns)
    expected = database.execute(oracle_sql()[name])
    names = [column[0] for column in expected.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    same(result.select(*columns).collect(), [tuple(row[i] for i in order) for row in expected.fetchall()])


def test_scores(spark, texts):
    found = {r["doc_id"]: tuple(r) for r in queries()["op1_ppm_scores"](spark, str(FOLDER)).collect()}
    for row in brute.ppm([t[:2] for t in texts], ppm.ORDER):
        assert found[row[0]][:5] == row[:5]
        assert found[row[0]][5:] == pytest.approx(row[5:], rel=1e-5)
    assert len(found) == len(texts)


def test_tokens(spark, texts):
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    found = sorted(tuple(r) for r in queries()["op4_rans_tokens"](spark, str(FOLDER)).collect())
    start, expected = 0, []
    for doc_id, text, *_ in sorted(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        expected.append((doc_id, start, len(ids), zlib.crc32(raw)))
        start += len(ids)
    assert found == expected


def test_quality(spark, texts):
    found = {r["doc_id"]: r for r in queries()["op5_mcd_quality"](spark, str(FOLDER)).collect()}
    assert len(found) == len(texts)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(str(FOLDER / "labels.parquet")).collect()}
    for doc_id, text, *_ in texts:
        row, counts = found[doc_id], brute.text_counts(text)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert tuple(row[n] for n in (*quality.COUNTS, "base_failed")) == (*counts, failed)
        if labels.get(doc_id) == 1 and not failed:
            assert row["kept"]


def test_mix(spark, texts):
    found = queries()["op10_cube_mix"](spark, str(FOLDER)).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(t[0] for t in texts)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    sizes = {t[0]: len(brute.WORD.findall(brute.utf8(t[1]))) for t in texts}
    assert all(r["size"] == sizes[r["doc_id"]] for r in found)


def test_pipeline_stages(spark, texts):
    """Each stage against what its operator is tested to do, on what the stage before has kept."""
    kept_tables = RoundTables(spark)
    docs = spark.read.parquet(str(FOLDER / "documents.parquet"))
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = kept_tables.write(stage(spark, before, str(FOLDER)), name).df
        kept.append(docs.count())
        if name == "token_output":
            break
        assert docs.columns == columns
        if name == "quality_rules":
            bad = quality.judged(before).filter("not kept").select("doc_id")
            same(docs.select("doc_id").collect(), before.join(bad, "doc_id", "left_anti").select("doc_id").collect())
        elif name == "near_dedup":
            given = [tuple(r) for r in before.select("doc_id", "text").collect()]
            groups = brute.near_groups(given)
            least = {g: min(d for (d, _), o in zip(given, groups, strict=True) if o == g) for g in groups}
            same(docs.select("doc_id").collect(), [(d,) for d in least.values()])
        elif name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(str(FOLDER / "benchmark.parquet")).collect()]
            found = brute.passages([tuple(r) for r in before.select("doc_id", "text").collect()], items)
            same(docs.select("doc_id").collect(), [(d,) for d, _, hit, _ in found if not hit])
        elif name == "source_mix":
            copies = mixing.mix_sources(before).select("doc_id", "copies").collect()
            same(docs.select("doc_id").collect(), [(r["doc_id"],) for r in copies for _ in range(r["copies"])])
    assert all(n > 0 for n in kept) and kept[0] >= kept[1] >= kept[2]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and kept[3] == kept[4]
    assert near_copies.LEAST == 75


def test_pipeline_leaves_its_result_only(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    found = corpus_pipeline.run(spark, str(FOLDER))
    left = [d for run in set(shared.iterdir()) - before for d in run.iterdir()]
    assert [d.name.split("-", 1)[1] for d in left] == ["token_output"]
    rows = found.orderBy("start").collect()
    at = 0
    for row in rows:
        assert row["start"] == at
        at += row["n_tokens"]
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
