import datetime as dt
import os
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from donorlens.plans import etl
from donorlens.sources import files, tables
from donorlens.streaming import ingest

from .conftest import rows

TWO = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()

    def put(name, text):
        (folder / name).write_text(text, encoding="utf-8")

    put("x_Users_1.csv", "id;name\n1;a\n2;b\n")
    put("X_USERS_2.csv", "id;extra;name\n3;z;c\n")
    put("Платежи 100%+.csv", "id;name\n10;p\n")
    put("Платежи_старые.csv", "id;name\n11;q\n")
    put("skip.CSV", "id;name\n99;no\n")
    put("note.txt", "id;name\n98;no\n")
    return str(folder)


def test_csv_types(spark, landing):
    inferred = files.read_csv(spark, f"{landing}/x_Users_1.csv")
    assert [t for _, t in inferred.dtypes] == ["int", "string"]
    assert files.read_csv(spark, f"{landing}/x_Users_1.csv", TWO).schema == TWO


def test_listing_is_by_name_and_case_sensitive_suffix(spark, landing):
    names = [p.rsplit("/", 1)[-1] for p in files.csv_paths(spark, landing)]
    assert names == ["X_USERS_2.csv", "x_Users_1.csv", "Платежи 100%+.csv", "Платежи_старые.csv"]


def test_routing_by_token(spark, landing):
    users, others = files.read_routed(spark, landing, "users", TWO)
    assert sorted(r["id"] for r in users.collect()) == [1, 2, 3]
    assert sorted(r["id"] for r in others.collect()) == [10, 11]
    payments, rest = files.read_routed(spark, landing, "ПЛАТЕЖИ 100%+", TWO)
    assert [r["id"] for r in payments.collect()] == [10]
    assert rest.count() == 4


def test_read_by_name_fills_missing_columns(spark, landing):
    users, others = files.split_by_token(files.csv_paths(spark, landing), "users")
    table = files.read_by_name(spark, users).select("id", "name", "extra").orderBy("id")
    assert rows(table) == [("1", "a", None), ("2", "b", None), ("3", "c", "z")]
    assert files.first_named(others, "Платежи").endswith("Платежи 100%+.csv")
    assert files.first_named(others, "nothing") is None
    assert files.read_by_name(spark, []).count() == 0


def test_read_first_named(spark, landing):
    assert rows(files.read_first_named(spark, landing, "Платежи", TWO)) == [(10, "p")]
    assert rows(files.read_first_named(spark, landing, "USERS", TWO, exclude="users")) == []
    assert files.read_first_named(spark, landing, "nothing", TWO).schema == TWO


def test_unreadable_files_fail_or_are_named(spark, landing):
    for name, content in (("broken_users.csv", b"id;name\n77;\xff\xfe\x80\n"), ("empty_users.csv", b"")):
        with open(f"{landing}/{name}", "wb") as f:
            f.write(content)
    paths = files.csv_paths(spark, landing)
    with pytest.raises(ValueError, match="broken_users"):
        files.read_by_name(spark, paths)
    with pytest.raises(ValueError, match="empty_users"):
        files.read_routed(spark, landing, "users", TWO)
    users, _ = files.read_routed(spark, landing, "users", TWO, skip_unreadable=True)
    assert sorted(r["id"] for r in users.collect()) == [1, 2, 3]
    table, skipped = files.read_files(spark, paths, skip_unreadable=True)
    assert [p.rsplit("/", 1)[-1] for p in skipped] == ["broken_users.csv", "empty_users.csv"]
    assert table.count() == 5


def test_header_is_matched_by_name(spark, tmp_path):
    (tmp_path / "swapped.csv").write_text("name;id\ny;2\n")
    assert rows(files.read_first_named(spark, str(tmp_path), "swapped", TWO)) == [(2, "y")]
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(tmp_path / "swapped.csv"), TWO).collect()


def test_quotes_separators_and_line_breaks(spark, tmp_path):
    text = 'id;name\n1;"Fund ""Good"" one"\n2;"a;b"\n3;"two\nlines"\n'
    (tmp_path / "quoted.csv").write_text(text)
    want = [(1, 'Fund "Good" one'), (2, "a;b"), (3, "two\nlines")]
    assert sorted(rows(files.read_csv(spark, str(tmp_path / "quoted.csv"), TWO))) == want
    table = files.read_by_name(spark, files.csv_paths(spark, str(tmp_path)))
    assert sorted(rows(table)) == [(str(i), name) for i, name in want]


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    def jobs(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"Users_{i:02}.csv").write_text(f"id;{'name' if i % 2 else 'other'}\n{i};x\n")
        group = str(uuid.uuid4())
        spark.sparkContext.setJobGroup(group, "")
        try:
            assert files.read_by_name(spark, files.csv_paths(spark, str(folder))).count() == n
        finally:
            spark.sparkContext._jsc.sc().clearJobGroup()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(50) <= jobs(6) + 1


def test_union_by_name(spark):
    left, right = spark.sql("SELECT 1 AS a, 'x' AS b"), spark.sql("SELECT 2.5D AS c, 3 AS a")
    assert rows(files.union_all([left, right])) == [(1, "x", None), (3, None, 2.5)]


def test_newest_copies(spark, tmp_path):
    for folder, text, age in (("old", "id;name\n1;old\n", 0), ("new", "id;name\n1;new\n", 100)):
        (tmp_path / folder).mkdir()
        path = tmp_path / folder / "a.csv"
        path.write_text(text)
        os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))
    only_old = tmp_path / "old" / "b.csv"
    only_old.write_text("id;name\n2;kept\n")
    os.utime(only_old, (1_600_000_000, 1_600_000_000))
    newest = files.read_newest(spark, [str(tmp_path / "old"), str(tmp_path / "new")], TWO)
    assert sorted(rows(newest)) == [(1, "new"), (2, "kept")]
    since = dt.datetime.fromtimestamp(1_650_000_000, dt.timezone.utc)
    assert rows(files.read_modified_after(spark, str(tmp_path / "old"), since, TWO)) == [(1, "old")]


def test_tables(spark):
    one, two = spark.sql("SELECT 1 AS id"), spark.sql("SELECT 2 AS id")
    tables.overwrite_table(one, "written")
    tables.overwrite_table(two, "written")
    assert rows(tables.run_sql(spark, "SELECT * FROM written")) == [(2,)]
    assert not tables.write_if_absent(one, "written")
    assert rows(spark.table("written")) == [(2,)]
    assert tables.write_if_absent(one, "written_once")
    assert rows(spark.table("written_once")) == [(1,)]
    tables.register({"as_view": one})
    assert rows(tables.run_sql(spark, "SELECT id FROM as_view")) == [(1,)]
    with pytest.raises(AnalysisException):
        tables.run_sql(spark, "SELECT * FROM no_such_table")


def test_partitioned_path(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, 2021 AS y UNION ALL SELECT 2, 2022")
    tables.overwrite_path(df, str(tmp_path / "t"), ["y"])
    assert sorted(p.name for p in (tmp_path / "t").glob("y=*")) == ["y=2021", "y=2022"]


def test_ingest_reads_each_file_once(spark, tmp_path):
    landing, target, name = tmp_path / "in", str(tmp_path / "out"), f"ingest-{uuid.uuid4()}"
    landing.mkdir()
    (landing / "users_1.csv").write_text("id;name\n1;a\n")
    (landing / "other.csv").write_text("id;name\n50;x\n")

    def run():
        stream = ingest.new_files(spark, str(landing), TWO, token="USERS")
        ingest.append_new_files(stream, target, name).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(target).collect())

    assert run() == [1]
    (landing / "users_2.csv").write_text("id;name\n2;b\n")
    assert run() == [1, 2]
    assert run() == [1, 2]


ACTIONS_1 = """CustomerActionActionTemplateIdsSystemName;CustomerActionChannelIdsExternalId;CustomerActionDateTimeUtc;CustomerActionCreationDateTimeUtc;CustomerActionChannelIdsMindboxId;CustomerActionCustomerIdsMindboxId;CustomerActionChannelName;CustomerActionChannelUtmSource;Unused
t;site;2021-01-01 10:00:00;2021-01-01 10:00:01;7;1;site;ads;
t;site;not a date;2021-01-02 10:00:01;8.0;2;site;none;
"""
ACTIONS_2 = """CustomerActionChannelIdsExternalId;CustomerActionDateTimeUtc;CustomerActionCreationDateTimeUtc;CustomerActionChannelIdsMindboxId;CustomerActionCustomerIdsMindboxId;CustomerActionChannelName
app;2021-02-01 10:00:00;2021-02-01 10:00:01;x;3;app
"""
ORDERS = """OrderCustomerIdsMindboxId;OrderFirstActionDateTimeUtc;OrderFirstActionIdsMindboxId;OrderIdsWebsiteID;OrderTotalPrice;OrderLineStatusIdsExternalId;OrderCustomFieldsNewyear;OrderCustomFieldsRecurrent;OrderLinePriceOfLine;OrderLineBasePricePerItem;OrderDeliveryCost;OrderLineNumber;OrderLineLineNumber;OrderFirstActionChannelIdsExternalId
1;2021-01-05 12:30:00.5;11;21;100.5;Paid;True;False;100;100.0;0;1;1;site
2;2021-01-06 12:30:00;12;22;200;notpaid;;True;200;;0;1;1;site
"""


@pytest.fixture
def exports(tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    (folder / "Users_1.csv").write_text(ACTIONS_1)
    (folder / "users_2.csv").write_text(ACTIONS_2)
    (folder / "Orders.csv").write_text(ORDERS)
    return str(folder)


def test_load_exports(spark, exports):
    reports = etl.load(spark, exports, "users", "Orders", "actions_loaded", "donations_loaded")
    loaded = spark.table("actions_loaded").orderBy("customer_id")
    assert loaded.columns[4:] == ["CustomerActionCreationDateTimeUtc", "CustomerActionChannelIdsMindboxId"]
    assert rows(loaded.select(*loaded.columns[:4])) == [
        (1, dt.datetime(2021, 1, 1, 10), "site", "ads"),
        (2, None, "site", "none"),
        (3, dt.datetime(2021, 2, 1, 10), "app", None),
    ]
    gifts = spark.table("donations_loaded").orderBy("customer_id").collect()
    assert [g["OrderLinePriceOfLine"] for g in gifts] == ["100", "200"]
    assert "order_id" not in gifts[0]
    assert [float(g["total_price"]) for g in gifts] == [100.5, 200.0]
    assert gifts[0]["order_ts"] == dt.datetime(2021, 1, 5, 12, 30, 0, 500000)
    assert [(g["is_campaign"], g["is_recurrent"]) for g in gifts] == [(True, False), (None, True)]
    actions = reports["actions_loaded"]
    assert actions.removed_columns == ["CustomerActionActionTemplateIdsSystemName", "CustomerActionChannelIdsExternalId", "Unused"]
    assert actions.changed_types == [*etl.ACTION_TIMES, *etl.ACTION_INTEGERS]
    assert rows(actions.row_delta) == [("actions_loaded", 3, 3, 0.0)]
    assert dict(rows(actions.null_rates))["CustomerActionDateTimeUtc"] == 33.33333
    assert "OrderLineBasePricePerItem" in reports["donations_loaded"].removed_columns


def test_missing_orders_file(spark, exports):
    with pytest.raises(KeyError):
        etl.load(spark, exports, "users", "Nothing", "actions_x", "donations_x")
    etl.load(spark, exports, "users", "Nothing", "actions_x", "donations_x", strict=False)
    assert spark.table("donations_x").count() == 0


def test_day_first_times(spark, exports, tmp_path):
    day_first = tmp_path / "day_first"
    day_first.mkdir()
    for name, text in (("Users_1.csv", ACTIONS_2), ("Orders.csv", ORDERS)):
        (day_first / name).write_text(
            text.replace("2021-02-01 10:00:00", "31.12.2021 10:00:00").replace("2021-02-01 10:00:01", "31.12.2021 10:00:01")
            .replace("2021-01-05 12:30:00.5", "05.01.2021 12:30:00").replace("2021-01-06 12:30:00", "06.01.2021 12:30:00")
        )
    with pytest.raises(ValueError, match="times that cannot be read"):
        etl.load(spark, str(day_first), "users", "Orders", "actions_d", "donations_d")
    etl.load(spark, str(day_first), "users", "Orders", "actions_d", "donations_d", fmt="dd.MM.yyyy HH:mm:ss")
    assert spark.table("actions_d").first()["action_ts"] == dt.datetime(2021, 12, 31, 10)
    assert sorted(r["order_ts"] for r in spark.table("donations_d").collect()) == [dt.datetime(2021, 1, d, 12, 30) for d in (5, 6)]


def test_load_names_skipped_files(spark, exports):
    with open(f"{exports}/Users_9.csv", "wb"):
        pass
    with pytest.raises(ValueError, match="Users_9"):
        etl.load(spark, exports, "users", "Orders", "actions_s", "donations_s")
    reports = etl.load(spark, exports, "users", "Orders", "actions_s", "donations_s", skip_unreadable=True)
    assert [p.rsplit("/", 1)[-1] for p in reports["actions_s"].skipped_files] == ["Users_9.csv"]
    assert spark.table("actions_s").count() == 3
