"""Times in sessions of different zones."""

import datetime as dt

import pytest

from matchlake.functions import norm

CASES = {
    "2024-01-05T10:00:00": 1704448800000,
    "2024-01-05 10:00:00.5": 1704448800500,
    "2024-01-05T10:00:00.1234567": 1704448800123,
    "2024-01-05T10:00:00.1234567Z": 1704448800123,
    "2024-01-05T10:00:00+02:00": 1704441600000,
    "2024-01-05T10:00:00-05:00": 1704466800000,
    "2024-07-05T02:30:00": 1720146600000,
    "2024-01-05": 1704412800000,
    "yesterday": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_naive_times_are_utc(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(s,) for s in CASES], "s string")
        got = {r.s: r.ms for r in df.select("s", norm.ts_ms(norm.parse_ts(df.s)).alias("ms")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == CASES
    plain = lambda s: int(dt.datetime.fromisoformat(s[:26]).replace(tzinfo=dt.UTC).timestamp() * 1000)
    assert all(plain(s) == ms for s, ms in CASES.items() if ms and not s.endswith(("Z", "+02:00", "-05:00")))
