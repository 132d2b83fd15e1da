"""The driver's entry points, with and without the removable parts."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as spark_entry
from chargeloom import oracle, queries

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(queries.NAMES) <= set(spark_entry.queries())
    assert set(queries.NAMES) == set(oracle.oracle_sql())
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_imports_without_the_corpus_parts(tmp_path):
    """Neither the corpus operators nor the pipeline are needed by the rest."""
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".*"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert got.stdout.split() == [str(len(queries.NAMES))] * 2, got.stderr


def test_imports_where_the_corpus_parts_do_not(tmp_path):
    """A leftover folder, or a library that is not there, takes nothing else with it."""
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".*"))
    (tmp_path / "repo/chargeloom/llm/__pycache__").mkdir(parents=True)
    (tmp_path / "repo/corpus_pipeline.py").write_text("import a_library_that_is_not_there\n")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert got.stdout.split() == [str(len(queries.NAMES))] * 2, got.stderr


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", ["hourly_rollup", "quality_report", "split_stats", "scaler_standard", "iid_clients", "iid_clients_users", "baseline_metrics", "fedavg_parameters", "station_files", "hourly_files", "hourly_csv_files", "window_files", "experiment_metadata", "results_payload", "sample_universe_check", "scored_predictions", "federated_results", "run_history", "time_formats", "scaler_files", "prediction_files", "round_files", "skipped_stations", "task_violations", "first_rows"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(oracle.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA).select(*want.columns).collect()
    plain = lambda row: repr([None if isinstance(v, float) and v != v else v for v in row])
    assert sorted(map(plain, got)) == sorted(map(plain, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_metadata_names_every_station(spark):
    row = queries.queries()["experiment_metadata"](spark, DATA).first()
    valid = duckdb.sql(oracle.oracle_sql()["valid_stations"].replace("FROM events", f"FROM '{DATA}/events.parquet'")).fetchall()
    assert row.station_ids.split(",") == sorted(v[0] for v in valid) and row.stations == len(valid) > 1
