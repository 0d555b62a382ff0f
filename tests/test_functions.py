import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import (
    decode_key,
    is_blank,
    region_from_path,
    safe_pct,
    strip,
    to_bool,
    to_day,
    to_instant,
    to_int,
    to_long,
    utc_iso,
)
from tidemark.functions.casts import CSV_INSTANT


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_numbers_are_trimmed_and_bad_ones_are_null(spark):
    assert one(spark, to_long(F.lit(" 12 "))) == 12
    for bad in ("1.5", "1e3", "", "x", None):
        assert one(spark, to_long(F.lit(bad).cast("string"))) is None
    assert one(spark, to_int(F.lit("9999999999"))) is None
    assert [one(spark, to_long(F.lit(v))) for v in ("+5", "-5", "\t7\n", "--5")] == [5, -5, 7, None]


def test_the_shape_check_never_changes_a_cast(spark):
    pieces = ["", " ", "\t", "+", "-", "1", "007", "1.", ".5", "1e3", "x", "tRue", "N", "0", "1L", "\u0661", "2147483648", "9223372036854775808"]
    texts = [a + b for a in pieces for b in pieces]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind, cast in (("int", to_int), ("bigint", to_long), ("boolean", to_bool)):
        pairs = df.select("t", cast(F.col("t")).alias("a"), F.trim("t").try_cast(kind).alias("b"))
        assert pairs.filter("NOT (a <=> b)").collect() == []


def test_flags(spark):
    expected = {"TRUE": True, "False": False, " true ": True, "yes": True, "no": False, "maybe": None}
    assert {k: one(spark, to_bool(F.lit(k))) for k in expected} == expected


def test_days(spark):
    assert one(spark, to_day(F.lit("17.14.11"))) == dt.date(2017, 11, 14)
    assert one(spark, to_day(F.lit("99.99.99"))) is None


def test_instants_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session_zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session_zone)
            seconds = F.unix_timestamp(to_instant(F.lit("2026-08-13T17:42:06Z")))
            assert one(spark, seconds) == 1786642926
            millis = F.unix_timestamp(to_instant(F.lit("2026-08-13T17:42:06.000Z"), CSV_INSTANT))
            assert one(spark, millis) == 1786642926
            text = utc_iso(F.timestamp_seconds(F.lit(1786642926)))
            assert one(spark, text) == "2026-08-13T17:42:06.000000+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_instants_of_another_format_are_null(spark):
    assert one(spark, to_instant(F.lit("2026-08-13T17:42:06Z"), CSV_INSTANT)) is None
    assert one(spark, to_instant(F.lit("13/08/2026"))) is None
    assert one(spark, to_instant(F.lit(" 2026-08-13T17:42:06Z"))) is None


def test_rate_is_null_for_zero_and_rounds_half_up(spark):
    long = lambda n: F.lit(n).cast("bigint")
    assert one(spark, safe_pct(long(5), long(0))) is None
    assert one(spark, safe_pct(long(1), long(800))) == 0.13
    assert one(spark, safe_pct(F.lit(None).cast("bigint"), long(3))) is None


def test_paths(spark):
    path = F.lit("s3://b/raw/region=in/date=2026-08-15/hour=05/x.json")
    assert one(spark, region_from_path(path)) == "in"
    assert one(spark, region_from_path(F.lit("raw/x.json"))) == ""
    assert one(spark, region_from_path(F.lit("raw/x.json"), "unknown")) == "unknown"
    assert one(spark, decode_key(F.lit("raw/region%3Din/a+b.json"))) == "raw/region=in/a b.json"


def test_blank_and_strip(spark):
    assert [one(spark, is_blank(F.lit(v).cast("string"))) for v in (None, "", "  ", "a")] == [True, True, True, False]
    assert one(spark, strip(F.lit("\t a b\n"))) == "a b"
