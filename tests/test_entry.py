"""The queries against their SQL, sources and streams, and that the library stands without its optional part."""

import glob
import os
import re
import subprocess
import sys

import pytest

from kindred.errors import ValidationError
from kindred.plans import similarity_join
from kindred.plans.catalog import ORACLE, QUERIES
from kindred.sources.tables import read_records, write_matches
from kindred.streaming.lookup import fuzzy_lookup

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, columns):
    return sorted(tuple("null" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_its_sql(spark, duck, name):
    agrees(spark, duck, name)


@pytest.mark.parametrize("name", ["dedupe_full", "fuzzy_join_left", "fuzzy_join_multi", "match_pairs", "schema_search_minmax", "token_set_search", "token_set_rare", "edit_range_search", "edit_nearest", "edit_similarity_search", "fuzzy_index_edit", "series_match"])
def test_query_agrees_with_its_sql_where_values_are_many(spark, duck, monkeypatch, name):
    monkeypatch.setattr(similarity_join, "FEW", 0)
    agrees(spark, duck, name)


def agrees(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    found = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(found.columns)
    want = [dict(zip(found.columns, r)) for r in found.fetchall()]
    assert plain([r.asDict() for r in got.collect()], sorted(got.columns)) == plain(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    assert QUERIES[name](spark, DATA).count() > 0


def test_filters_and_columns_reach_the_scan(spark, capsys):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    QUERIES["edit_range_search"](spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "html" not in re.findall(r"ReadSchema: (.*)", plan)[0] and "BatchEvalPython" not in plan


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    for fmt in ("parquet", "orc", "csv", "json"):
        write_matches(df.coalesce(1), f"file://{tmp_path}/{fmt}", fmt)
        schema = "id long, name string" if fmt in ("csv", "json") else None
        back = read_records(spark, f"file://{tmp_path}/{fmt}", fmt, schema, ["name"], **({"header": False} if fmt == "csv" else {}))
        assert sorted(r.name for r in back.collect()) == ["a", "b"]
    write_matches(df, f"file://{tmp_path}/parts", partition_by=["name"])
    for bad in ({"fmt": "xml"}, {"fmt": "csv"}):
        with pytest.raises(ValidationError):
            read_records(spark, "x", **bad)


def test_stream(spark, tmp_path):
    spark.createDataFrame([("Appel",), ("Zzz",)], "name string").write.parquet(f"{tmp_path}/in")
    reference = spark.createDataFrame([("Apple Inc.",), ("Google",)], "name string")
    got = []
    stream = spark.readStream.schema("name string").parquet(f"{tmp_path}/in")
    writer = fuzzy_lookup(stream, reference, lambda df, n: got.extend((r.name, r.name_right, n) for r in df.collect()), f"{tmp_path}/check", on="name", min_similarity=0.6)
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [g[:2] for g in got] == [("Appel", "Apple Inc.")]


def test_the_library_stands_without_the_optional_part(tmp_path):
    """A copy without it still imports, and lists its queries."""
    code = "import __spark_entry__ as e; n = e.queries(); assert 'fuzzy_join_inner' in n and 'pipeline' not in n and not [x for x in n if x.startswith('op')]; assert set(e.oracle_sql()) <= set(n)"
    for name in ("kindred", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/kindred/llm"], check=True)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    # the tests that remain without its own run there, too
    subprocess.run(["cp", "-r", f"{ROOT}/tests", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/tests/llm"], check=True)
    some = "lev_distance or fuzzy_join_inner or dedupe_blocked or ngram_search or test_components or test_known"
    run = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-k", f"({some}) and not optional", "tests"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0 and " passed" in run.stdout, run.stdout[-2000:]
    uses = [f for f in glob.glob(f"{ROOT}/kindred/**/*.py", recursive=True) if "/llm/" not in f and re.search(r"kindred\.llm|from \.llm", open(f).read())]
    assert not uses
