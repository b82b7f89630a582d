"""Reports counted while staging, versions behind one pointer, and pick-up of replaced files."""

import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from donorlens.operators import cleaning, observed, profiling
from donorlens.plans import etl
from donorlens.sources import files, tables, versions
from donorlens.streaming import ingest

from .conftest import rows
from .test_sources import exports  # noqa: F401

TWO = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


# Observed counts


def test_counts_are_those_of_the_reports(spark, tmp_path):
    text = spark.createDataFrame(
        [("1", "1", "2021-01-01", None), ("2", None, "never", None), ("x", "7", None, None)], "a string, b string, t string, `odd.name` string"
    ).repartition(3)
    converted = {"a": cleaning.whole_number(F.col("a")), "t": cleaning.moment_of("t"), "absent": F.lit(1)}
    staged, counts = observed.written(text, str(tmp_path / "s"), converted, [("a", "b"), ("a", "absent")])
    assert sorted(rows(staged), key=str) == sorted(rows(text), key=str)
    assert counts == observed.Counts(3, {"a": 3, "b": 2, "t": 2, "odd.name": 0}, {"a": 2, "t": 1}, {("a", "b"): 1})
    after = cleaning.to_timestamps(cleaning.to_integers(staged, ["a"]), ["t"])
    assert rows(counts.profile(after)) == rows(profiling.dataset_profile(after))
    assert rows(counts.null_rates(after)) == rows(profiling.null_rates(after))
    assert rows(counts.row_delta(after, "x")) == rows(profiling.row_delta(text, after, "x"))
    lost = cleaning.lost_values(text, after, ["a", "t"])
    assert counts.lost() == pytest.approx(lost)


def test_counts_of_an_empty_table(spark, tmp_path):
    for i, empty in enumerate((spark.createDataFrame([], "a string"), spark.range(9).selectExpr("string(id) a").where("a > 'z'"))):
        _, counts = observed.written(empty, str(tmp_path / str(i)), {"a": cleaning.whole_number(F.col("a"))})
        assert counts == observed.Counts(0, {"a": 0}, {"a": 0}, {})
        assert rows(counts.row_delta(empty, "e")) == [("e", 0, 0, None)]


def jobs_of(spark, work):
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, "")
    try:
        work()
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_reports_of_a_load_read_nothing(spark, exports):  # noqa: F811
    reports = etl.load(spark, exports, "users", "Orders", "actions_r", "donations_r")
    for report in reports.values():
        for df in (report.null_rates, report.row_delta):
            assert "FileScan" not in df._jdf.queryExecution().executedPlan().toString()
    text, _ = files.read_files(spark, files.split_by_token(files.csv_paths(spark, exports), "users")[0])
    staged, counts = etl.staged(spark, text, "jobs")
    assert jobs_of(spark, lambda: etl.report(staged, etl.clean_actions(staged, max_lost=0.5, counts=counts), "x", counts=counts)) == 0
    assert jobs_of(spark, lambda: etl.report(staged, etl.clean_actions(staged, max_lost=0.5), "x")) > 0
    with_counts, without = etl.clean_actions(staged, counts=counts), etl.clean_actions(staged)
    assert with_counts.schema == without.schema and sorted(rows(with_counts), key=str) == sorted(rows(without), key=str)


# Versions


def test_a_write_that_fails_leaves_all_old_tables(spark, tmp_path):
    store = str(tmp_path / "store")
    one, two = spark.range(3).toDF("a"), spark.range(5).toDF("b")
    assert versions.publish(spark, store, {"left_table": one, "right_table": two}) == 1
    broken = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken on purpose"))).otherwise(F.col("id")).alias("b"))
    with pytest.raises(Exception, match="broken on purpose"):
        versions.publish(spark, store, {"left_table": spark.range(100).toDF("a"), "right_table": broken})
    now = versions.tables(spark, store)
    assert (now["left_table"].count(), now["right_table"].count()) == (3, 5)
    assert len([p for p in os.listdir(f"{store}/left_table")]) == 1
    assert versions.publish(spark, store, {"left_table": now["left_table"].union(one)}) == 2
    now = versions.tables(spark, store)
    assert (now["left_table"].count(), now["right_table"].count()) == (6, 5)
    assert versions.tables(spark, store, 1)["left_table"].count() == 3
    with pytest.raises(KeyError):
        versions.tables(spark, store, 9)


def test_views_follow_the_pointer_and_old_versions_go(spark, tmp_path):
    store = str(tmp_path / "store")
    for n in (1, 2, 3):
        tables.load_tables(spark, {"versioned": spark.range(n)}, store)
        assert spark.table("versioned").count() == n
    assert len(versions.drop_old(spark, store, keep=2)) == 1
    assert len(os.listdir(f"{store}/versioned")) == 2
    assert versions.tables(spark, store, 2)["versioned"].count() == 2


def test_partitioned_versions(spark, tmp_path):
    store = str(tmp_path / "store")
    versions.publish(spark, store, {"t": spark.range(4).selectExpr("id", "id % 2 AS y")}, {"t": ["y"]})
    path = versions.current(spark, store)[1]["t"]
    assert sorted(p for p in os.listdir(path) if p.startswith("y")) == ["y=0", "y=1"]


# Replaced files


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, text, age=0):
        (folder / name).write_text(text)
        os.utime(folder / name, (1_700_000_000 + age, 1_700_000_000 + age))

    put.folder, put.target = folder, str(tmp_path / "out")
    put.name = f"replace-{uuid.uuid4()}"
    return put


def replaced(spark, landing, **more):
    ingest.replace_changed_files(spark, str(landing.folder), landing.target, TWO, landing.name, **more).awaitTermination()
    got = ingest.current_rows(spark, landing.target, TWO)
    return sorted((r["id"], r["name"], r["_file"]) for r in got.collect())


def test_replaced_files_replace_their_rows(spark, landing, monkeypatch):
    read = []
    plain = files.read_files
    monkeypatch.setattr(ingest, "read_files", lambda s, paths, *a, **k: read.extend(p.rsplit("/", 1)[-1] for p in paths) or plain(s, paths, *a, **k))
    landing("a b+1.csv", "id;name\n1;old\n2;old\n")
    landing("b.csv", "name;id\nkept;3\n")
    landing("other.csv", "id;name\n9;x\n")
    assert replaced(spark, landing, token="B") == [(1, "old", "a b+1.csv"), (2, "old", "a b+1.csv"), (3, "kept", "b.csv")]
    assert sorted(read) == ["a b+1.csv", "b.csv"]
    read.clear()
    assert len(replaced(spark, landing, token="B")) == 3 and read == []
    landing("a b+1.csv", "id;name\n5;new\n", age=60)
    assert replaced(spark, landing, token="B") == [(3, "kept", "b.csv"), (5, "new", "a b+1.csv")]
    assert read == ["a b+1.csv"]
    landing("b.csv", "name;id\n", age=60)
    assert replaced(spark, landing, token="B") == [(5, "new", "a b+1.csv")]


def test_removed_files_only_if_asked_for(spark, landing):
    landing("a.csv", "id;name\n1;a\n")
    landing("b.csv", "id;name\n2;b\n")
    assert len(replaced(spark, landing)) == 2
    (landing.folder / "a.csv").unlink()
    assert len(replaced(spark, landing)) == 2
    assert replaced(spark, landing, removed=True) == [(2, "b", "b.csv")]
    landing("a.csv", "id;name\n1;again\n", age=9)
    assert replaced(spark, landing, removed=True) == [(1, "again", "a.csv"), (2, "b", "b.csv")]


@pytest.mark.parametrize("after_write", [False, True])
def test_a_rerun_after_a_kill_gives_the_same_table(spark, landing, monkeypatch, after_write):
    landing("a.csv", "id;name\n1;a\n")
    assert len(replaced(spark, landing)) == 1
    landing("a.csv", "id;name\n1;b\n2;b\n", age=5)
    write = ingest._write

    def killed(made, target):
        if after_write:
            write(made, target)
        raise RuntimeError("killed")

    monkeypatch.setattr(ingest, "_write", killed)
    with pytest.raises(Exception, match="killed"):
        replaced(spark, landing)
    monkeypatch.setattr(ingest, "_write", write)
    assert replaced(spark, landing) == [(1, "b", "a.csv"), (2, "b", "a.csv")]
    assert replaced(spark, landing) == [(1, "b", "a.csv"), (2, "b", "a.csv")]


def test_an_empty_landing_folder(spark, landing):
    ingest.replace_changed_files(spark, str(landing.folder), landing.target, TWO, landing.name).awaitTermination()
    landing("a.csv", "id;name\n1;a\n")
    assert len(replaced(spark, landing)) == 1


# SQL with parameters, samples, large files


def test_values_stay_values(spark):
    spark.sql("SELECT * FROM VALUES ('x'), ('y; DROP TABLE t'), ('1 OR 1=1') AS t(name)").createOrReplaceTempView("named")
    query = "SELECT count(*) AS n FROM IDENTIFIER(:t) WHERE name = :name"
    for value, n in (("x", 1), ("1 OR 1=1", 1), ("' OR 'a'='a", 0), ("y; DROP TABLE t", 1)):
        assert tables.run_sql(spark, query, {"t": "named", "name": value}).first()["n"] == n
    assert tables.run_sql(spark, "SELECT count(*) AS n FROM named WHERE name IN (?, ?)", ["x", "z"]).first()["n"] == 1
    assert tables.run_sql(spark, "SELECT max(id) AS m FROM {given} WHERE id < :top", {"top": 5}, given=spark.range(9)).first()["m"] == 4
    with pytest.raises(Exception, match="IDENTIFIER|PARSE|not found|cannot"):
        tables.run_sql(spark, query, {"t": "named; SELECT 1", "name": "x"}).collect()


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(3000).selectExpr("id % 700 AS a", "nullif(string(id % 11), '3') AS b")
    picks = [profiling.random_rows(df.repartition(n), ["a", "b"], 40, seed=5) for n in (1, 200)]
    assert rows(picks[0]) == rows(picks[1])
    assert rows(picks[0]) != rows(profiling.random_rows(df, ["a", "b"], 40, seed=6))
    by_group = [sorted(rows(profiling.random_rows_by(df.repartition(n), "b", ["a"], 3, seed=5)), key=str) for n in (1, 7)]
    assert by_group[0] == by_group[1] and len(by_group[0]) == 33
    assert "TakeOrderedAndProject" in picks[1]._jdf.queryExecution().executedPlan().toString()


def test_large_files_without_line_breaks_are_split(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id;name\n" + "".join(f"{i};name {i}\n" for i in range(60_000)))
    (tmp_path / "broken.csv").write_text('id;name\n1;"two\nlines"\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        big = files.read_csv(spark, str(tmp_path / "big.csv"), TWO)
        assert big.rdd.getNumPartitions() > 4 and big.count() == 60_000
        both = files.read_by_name(spark, files.csv_paths(spark, str(tmp_path)))
        assert both.rdd.getNumPartitions() > 4 and both.count() == 60_001
        assert both.where("name LIKE 'two%'").first()["name"] == "two\nlines"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
