import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanaq.sources import files, tables
from almanaq.sources.lookups import lookup


@pytest.mark.parametrize("raw, want", [
    ("#date", "X.date"), ("FECHA HECHO", "FECHA.HECHO"), ("1950-01", "X1950.01"), ("Std. Error", "Std..Error"), ("Pr(>|t|)", "Pr...t.."),
    ("#adm+level", "X.adm.level"), ("code", "code"), (".x", ".x"), (".2x", "X.2x"), ("Año", "Año"), ("", "X"), ("_a", "X_a"),
])
def test_legal_names(raw, want):
    assert files.legal_name(raw) == want


def test_repeated_names_stay_apart(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a b", "a-b", "a.b"])
    assert files.make_names(df).columns == ["a.b", "a.b.1", "a.b.2"]


def test_parts_are_one_scan_and_other_columns_are_ignored(spark, tmp_path):
    (tmp_path / "1.csv").write_text("date,unit,extra,rfh\n2020-01-01,CO05001,zz,1.5\n2020-01-11,CO05001,zz,NA\n")
    (tmp_path / "2.csv").write_text("date,unit,extra,rfh\n2020-01-21,CO05001,,NaN\n")
    (tmp_path / "3.csv").write_text("rfh,date,unit\n4,2020-02-01,CO25001\n")
    types = {"date": T.DateType(), "unit": T.StringType(), "rfh": T.DoubleType()}
    two = files.read_named(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")], types)
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "extra" not in plan.split("ReadSchema")[1]
    got = sorted((r["date"], r["rfh"]) for r in two.collect())
    assert got == [(dt.date(2020, 1, 1), 1.5), (dt.date(2020, 1, 11), None), (dt.date(2020, 1, 21), None)]
    three = files.read_named(spark, [str(tmp_path / f"{i}.csv") for i in (1, 2, 3)], types)
    assert three.count() == 4 and three.where("unit = 'CO25001'").first()["rfh"] == 4.0


def test_wide_series(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("code,name,1950-01,1950-02,2025-12\nC1,Colombia,20.5,,22\n")
    got = sorted(tuple(r) for r in files.read_wide_series(spark, str(path), ["code", "name"]).collect() if r["value"] is not None)
    assert got == [("C1", "Colombia", 1950, 1, 20.5), ("C1", "Colombia", 2025, 12, 22.0)]


def test_legacy_bytes(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("name,n\nMéxico,1\n".encode("latin-1") + b"M\x82xico,2\n")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])
    got = {r["n"]: r["name"] for r in files.read_csv(spark, str(path), schema, "ISO-8859-1").collect()}
    assert got == {1: "México", 2: "M\x82xico"}


def test_tables_round_trip(spark, tmp_path):
    df = spark.range(5).withColumn("b", F.col("id") * 1.5)
    tables.write_table(df, str(tmp_path / "t"))
    tables.write_table(df, str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t")).count() == 5
    tables.write_results({"a": df, "b": df.limit(1)}, str(tmp_path / "out"))
    assert tables.read_table(spark, str(tmp_path / "out" / "b")).count() == 1
    copy = tables.materialise(df)
    assert copy.dtypes == df.dtypes and sorted(copy.collect()) == sorted(df.collect())
    assert copy.inputFiles()[0].removeprefix("file://").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert [t.count() for t in tables.materialise_all(df, df.limit(2))] == [5, 2]


def test_small_lookup_is_broadcast_large_is_not(spark, monkeypatch):
    facts = spark.range(1000)
    rows = [(i, str(i)) for i in range(20)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda d: facts.join(d, facts.id == d.k)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan(lookup(spark, rows, ["k", "v"]))
        monkeypatch.setattr("almanaq.sources.lookups.BROADCAST_ROWS", 10)
        assert "BroadcastHashJoin" not in plan(lookup(spark, rows, ["k", "v"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quoted_fields_with_quotes_commas_and_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,what,on\n1,"Battery (""simple"", domestic)",2020-01-01\n2,"two\nlines",2020-01-02\n3,plain,2020-01-03\n')
    types = {"id": T.IntegerType(), "what": T.StringType(), "on": T.DateType()}
    got = {r["id"]: (r["what"], str(r["on"])) for r in files.read_named(spark, [str(tmp_path / "q.csv")], types).collect()}
    assert got == {1: ('Battery ("simple", domestic)', "2020-01-01"), 2: ("two\nlines", "2020-01-02"), 3: ("plain", "2020-01-03")}


def test_folder_with_mixed_headers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y.csv").write_text("b,a\n20,10\n")
    types = {"a": T.IntegerType(), "b": T.IntegerType()}
    want = [(1, 2), (10, 20)]
    assert sorted(map(tuple, files.read_named(spark, [str(tmp_path)], types).collect())) == want
    assert sorted(map(tuple, files.read_named(spark, [f"{tmp_path}/*.csv"], types).collect())) == want


def test_names_that_are_taken_already():
    assert files.unique_names(["a", "a", "a.1"]) == ["a", "a.2", "a.1"]


def test_headers_of_many_small_files_are_one_job(spark, tmp_path):
    folder = tmp_path / "many parts"
    folder.mkdir()
    for i in range(300):
        (folder / f"p{i:03}.csv").write_text(f"a,b\n{i},1\n" if i % 2 else f'b,"a"\n1,{i}\n')
    (folder / "empty.csv").write_text("")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    headers = files.file_headers(spark, [str(folder)])
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)
    assert len(headers) == 300 and {tuple(h) for h in headers.values()} == {("a", "b"), ("b", "a")} and len(jobs) <= 4
    got = files.read_named(spark, [str(folder)], {"a": T.IntegerType(), "b": T.IntegerType()})
    assert got.agg(F.sum("a"), F.sum("b")).first()[:] == (sum(range(300)), 300)


def test_bad_cells_by_file_and_column(spark, tmp_path):
    (tmp_path / "x.csv").write_text('n,d,s\n1,2020-01-01,a\n"1,5",2020-13-01,b\nNA,,c\n 7,NA,d\n"x ""y""",2020-02-30,e\n')
    (tmp_path / "y.csv").write_text("s,d,n\nq,2020-01-05,12\n")
    types = {"n": T.IntegerType(), "d": T.DateType(), "s": T.StringType()}
    got = {(r["file"].rsplit("/", 1)[1], r["column"]): (r["cells"], r["bad"], r["example"]) for r in files.bad_cells(spark, [str(tmp_path)], types).collect()}
    read = files.read_named(spark, [str(tmp_path)], types)
    empty = {c: read.where(F.col(c).isNull()).count() for c in ("n", "d")}
    assert got[("y.csv", "n")] == (1, 0, None) and got[("y.csv", "d")] == (1, 0, None)
    for c in ("n", "d"):  # what the reader turned into NULL is what was given and counted as bad, besides what was not given
        given, bad, _ = got[("x.csv", c)]
        assert empty[c] == bad + 5 - given
    assert got[("x.csv", "n")][2] in ("1,5", 'x "y"', " 7") and got[("x.csv", "n")][1] >= 2 and got[("x.csv", "d")][1] == 2


def test_headers_are_found_without_sorting_lines(spark, tmp_path, monkeypatch):
    """One long file: its lines pass by, the aggregate holds a number a file; blank lines and odd bytes as the scans see them."""
    (tmp_path / "long.csv").write_bytes(b"\n \t\na\xf1o,b\n" + b"1,2\n" * 20_000)
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfc,d\r\n3,4\r\n")
    plans, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), collect(df))[1])
    assert list(files.file_headers(spark, [str(tmp_path / "long.csv")], "ISO-8859-1").values()) == [["año", "b"]]
    assert list(files.file_headers(spark, [str(tmp_path / "bom.csv")]).values()) == [["c", "d"]]
    assert plans and not any("SortAggregate" in plan for plan in plans)


def test_city_events_are_written_without_sorting_shipments(spark, monkeypatch):
    """The lines meet their parts by hash: no task sorts its share of them."""
    from workload import queries

    class Seen(Exception):
        pass

    def see(df, path, encoding="UTF-8"):
        if "Incident Type" in df.columns:
            raise Seen(df._jdf.queryExecution().executedPlan().toString())
        return path

    monkeypatch.setattr(queries, "write_csv", see)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with pytest.raises(Seen) as seen:
            queries.QUERIES["city_models"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in str(seen.value) and "SortMergeJoin" not in str(seen.value)
