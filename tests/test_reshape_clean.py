"""Wide export -> long rows, and the cleaning operators, on hand-made tables."""

from pyspark.sql import functions as F

from dosewise.operators import cleaning as C
from dosewise.operators.reshape import day_groups, wide_to_long


def _wide(spark):
    # two patients, enrollment 01/01/2024; three days, slots time1..time3
    cols = ["PtID", "DateEnroll",
            "date001", "MEMS_date001_time1", "MEMS_date001_time2", "MEMS_date001_time3", "MEMS_date001_numtimes",
            "date002", "MEMS_date002_time1", "MEMS_date002_time2", "MEMS_date002_time3", "MEMS_date002_numtimes",
            "MEMS_date002_interval", "MEMS_date002_withinrange",
            "date003", "MEMS_date003_time1", "MEMS_date003_time2", "MEMS_date003_time3", "MEMS_date003_numtimes",
            "MEMS_date003_interval", "MEMS_date003_withinrange", "MEMS_date003_time12"]
    rows = [
        # day 1 is the enrollment day (dropped); day 2: two uses + one empty slot; day 3: repeated time
        ("1", "1/1/2024", "01/01/2024", "08:00:00", None, None, "1",
         "01/02/2024", "07:30:00", "19:05:10", None, "2", "0 days 23:30:00", "1",
         "01/03/2024", "09:00:00", "09:00:00", "21:00:00", "3", "1 days 01:30:00", "1", "10:00:00"),
        # bad date on day 2 (row dropped), bad time string on day 3 (kept as NULL datetime), blank numtimes
        ("2", "1/1/2024", "01/01/2024", None, None, None, None,
         "13/45/2024", "10:00:00", None, None, "1", None, None,
         "01/03/2024", "25:99:00", None, None, " ", "junk", None, None),
    ]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def test_day_groups_discovers_one_digit_slots(spark):
    g = day_groups(_wide(spark).columns)
    assert [d for d, *_ in g] == [1, 2, 3]
    assert g[2][2] == ["MEMS_date003_time1", "MEMS_date003_time2", "MEMS_date003_time3"]  # time12 ignored
    assert g[0][4] is None and g[0][5] is None  # first day: no interval / withinrange


def test_wide_to_long_rules(spark):
    out = wide_to_long(_wide(spark)).orderBy("PtID", "day_idx", "slot").collect()
    p1 = [(r.day_idx, r.slot, r.time, r.numtimes, r.interval_s, r.withinrange) for r in out if r.PtID == "1"]
    assert p1 == [
        (2, 1, "07:30:00", 2, 84600, 1), (2, 2, "19:05:10", 2, 84600, 1), (2, 3, None, 2, 84600, 1),
        (3, 1, "09:00:00", 3, 91800, 1), (3, 3, "21:00:00", 3, 91800, 1),  # repeated time collapsed
    ]
    p2 = [(r.day_idx, r.slot, r.time, r.datetime, r.numtimes, r.interval_s, r.withinrange) for r in out
          if r.PtID == "2"]
    assert p2 == [(3, 1, "25:99:00", None, 0, None, 0), (3, 2, None, None, 0, None, 0)]


def test_blank_and_profile_drops(spark):
    df = spark.createDataFrame(
        [("1", " ", None, "a", "x"), ("2", "\t", None, "b", "x"), ("3", "", None, None, None)],
        "PtID string, ws string, empty string, ok string, const string")
    b = C.blank_to_null(df)
    assert [r.ws for r in b.orderBy("PtID").collect()] == [None, None, ""]
    out = C.drop_empty_and_constant(b, protect=["PtID"])
    # ws keeps only '' (one distinct value) -> constant; empty -> all NULL; const -> one value
    assert out.columns == ["PtID", "ok"]


def test_map_binarize_reverse_onehot(spark):
    df = spark.createDataFrame(
        [(1, "2", "7", "1", "0", "0"), (2, "9", "free text", "0", "0", "0"), (3, None, None, None, None, None),
         (4, "x", "3.5", "1", "1", "0")],
        "PtID int, code string, other string, race_a string, race_b string, race_c string")
    m = C.map_codes(df, "code", {1: "one", 2: "two"}).orderBy("PtID").collect()
    assert [r.code for r in m] == ["two", None, None, None]
    b = C.binarize(df, "other").orderBy("PtID").collect()
    assert [r.other for r in b] == ["7", "1", None, "3.5"]
    r = C.reverse_onehot(df, "race_").orderBy("PtID").collect()
    assert [x.race for x in r] == ["a", "a", None, "a"]  # all-zero -> first column; two-hot -> first max
    rz = C.reverse_onehot(df, "race_", zero_is_null=True).orderBy("PtID").collect()
    assert [x.race for x in rz] == ["a", None, None, "a"]


def test_drop_columns_strict_and_rename(spark):
    df = spark.createDataFrame([(1, "a", "b")], "PtID int, Full_Name string, x string")
    assert C.drop_columns(df, contains=["_Name"]).columns == ["PtID", "x"]
    try:
        C.drop_columns(df, cols=["missing"])
        raise AssertionError("expected KeyError")
    except KeyError:
        pass
    assert C.rename(df, {"x": "y", "nope": "z"}).columns == ["PtID", "Full_Name", "y"]


def test_numeric_or_ignore_and_lookup(spark):
    df = spark.createDataFrame([("1", "a"), ("2.5", "3")], "n string, m string")
    out = C.numeric_or_ignore(df, ["n", "m"])
    assert dict(out.dtypes) == {"n": "double", "m": "string"}
    ev = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (2, 5, "only")], "k int, o int, v string")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    got = {r.k: r.v for r in C.lookup_first(ev, keys, "k", "v", "o").collect()}
    assert got == {1: "early", 2: "only", 3: None}


def test_assert_no_nulls(spark):
    C.assert_no_nulls(spark.createDataFrame([(1, 2)], "a int, b int"))
    try:
        C.assert_no_nulls(spark.createDataFrame([(1, None)], "a int, b int"))
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_wide_round_trip_from_events(spark):
    """events -> wide export -> long equals the direct long derivation."""
    from conftest import SF_SMALL
    from dosewise.sources.events import dose_events, wide_export

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    direct = dose_events(ev).select("user_id", "day_idx", "slot", "datetime", "numtimes", "interval_s",
                                    "withinrange")
    wide = wide_export(ev)
    back = wide_to_long(wide).select(F.col("PtID").alias("user_id"), "day_idx", "slot", "datetime", "numtimes",
                                     "interval_s", "withinrange")
    assert direct.exceptAll(back).count() == 0 and back.exceptAll(direct).count() == 0


def test_no_cap_on_openings(spark):
    """12 openings in a day survive the export and the way back."""
    from dosewise.sources.events import EXPORT_DATE_RE, EXPORT_SLOT_RE, dose_events, wide_export

    rows = [(1, i, f"2020-01-02 {8 + i // 6:02d}:{5 * (i % 6):02d}:00") for i in range(12)]
    rows += [(1, 100, "2020-01-01 08:00:00"), (2, 102, "2020-01-01 09:00:00")]
    ev = spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    cols = ["user_id", "day_idx", "slot", "datetime", "numtimes", "interval_s", "withinrange"]
    direct = dose_events(ev).select(*cols)
    assert direct.where("day_idx = 2 and datetime is not null").count() == 12
    wide = wide_export(ev)
    assert "MEMS_date002_time11" in wide.columns
    back = wide_to_long(wide, date_re=EXPORT_DATE_RE, slot_re=EXPORT_SLOT_RE).withColumnRenamed("PtID", "user_id").select(*cols)
    assert direct.exceptAll(back).count() == 0 and back.exceptAll(direct).count() == 0


def test_day_1000(spark):
    """The calendar reaches day 1000 and beyond, and its columns are read or refused, never skipped."""
    from dosewise.sources.events import EXPORT_DATE_RE, EXPORT_SLOT_RE, dose_events, export_size

    rows = [(1, 1, "2020-01-01 08:00:00"), (1, 2, "2022-09-26 09:00:00")]
    ev = spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert export_size(ev) == (1000, 1) and dose_events(ev).agg(F.max("day_idx")).first()[0] == 1000
    wide = spark.createDataFrame([("1", "1/1/2020", "09/26/2022", "09:00:00", "1")],
                                 "PtID string, DateEnroll string, date1000 string, MEMS_date1000_time0 string, MEMS_date1000_numtimes string")
    back = wide_to_long(wide, date_re=EXPORT_DATE_RE, slot_re=EXPORT_SLOT_RE).first()
    assert (back.day_idx, back.time) == (1000, "09:00:00")
    try:
        wide_to_long(wide)
        raise AssertionError("expected ValueError for date1000")
    except ValueError:
        pass


def test_checkpoint_folder_needs_a_name_off_a_local_master():
    from dosewise.session import local_folder

    assert local_folder("local[4]")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        try:
            local_folder(master)
            raise AssertionError(master)
        except RuntimeError:
            pass


def test_one_hot_vector_takes_any_number_of_levels(spark):
    from dosewise.operators.encoding import one_hot_vector

    df = spark.range(1500).select(F.col("id"), F.col("id").cast("string").alias("c")).unionByName(
        spark.createDataFrame([(2000, None)], "id long, c string"))
    rows = {r.id: r.c_vec for r in one_hot_vector(df, "c").collect()}
    assert rows[3].size == 1500 and rows[3].numNonzeros() == 1 and rows[2000].numNonzeros() == 0
