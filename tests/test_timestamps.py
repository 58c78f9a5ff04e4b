import datetime as dt
import zoneinfo

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamiz.operators.timestamps import class_mask, local_to_utc, normalise_batch, normalise_timestamps, parser_of, zone_table_version


def one(text, zone="Europe/Madrid", order="dma"):
    return normalise_batch(pd.Series([text]), pd.Series([zone]), pd.Series([order])).iloc[0]


CASES = [
    ("2023-01-02T02:00:30-06:00", "2023-01-02T08:00:30Z"),
    ("Mon, 02 Jan 2023 15:44:50 +0100", "2023-01-02T14:44:50Z"),
    ("3 ene. 2023 1:10 a. m.", "2023-01-03T00:10:00Z"),
    ("16 ene. 2023 12:25 a. m.", "2023-01-15T23:25:00Z"),
    ("miércoles 4 de enero de 2023 - 01:17", "2023-01-04T00:17:00Z"),
    ("12 de enero de 2023, 01:16 h", "2023-01-12T00:16:00Z"),
    ("10 de setiembre de 2023", "2023-09-10"),
    ("January 3, 2023", "2023-01-03"),
    ("January 11, 2023 8:44 PM", "2023-01-11T19:44:00Z"),
    ("2023-01-06 13:57 EST", "2023-01-06T18:57:00Z"),
    ("2024-02-13 12:56:14 America/Mexico_City", "2024-02-13T18:56:14Z"),
    ("2023-01-07 22:29:07 America/Bogota", "2023-01-08T03:29:07Z"),
    ("  2023/1/10 14:13:57", "2023-01-10T13:13:57Z"),
    ("20230105T073356Z", "2023-01-05T07:33:56Z"),
    ("1672622885", "2023-01-02T01:28:05Z"),
    ("1673050985477", "2023-01-07T00:23:05Z"),
    ("2023-01-02T20:18:18.089818Z", "2023-01-02T20:18:18Z"),
    ("05/01/23 10:53", "2023-01-05T09:53:00Z"),
    ("02/01/2023", "2023-01-02"),
    ("2023-02-30", None),
    ("2023-13-11 13:52", None),
    ("ayer", None),
    ("hace 18 horas", None),
    ("", None),
    ("   ", None),
    (None, None),
    ("2023-10-29 02:19:41", None),
    ("2024-03-31 02:30:00", None),
    ("9" * 500, None),
    ("x" * 100_000, None),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_notations(text, want):
    assert one(text) == want


def test_order_and_zone_of_the_source():
    assert one("02/01/2023 05:40", "America/New_York", "mda") == "2023-02-01T10:40:00Z"
    assert one("02/01/2023 05:40", "America/New_York", None) is None
    assert one("2023-01-01 05:40", None) is None
    assert one("2023-01-01 05:40", "No/Zone") is None
    assert one("2023-01-01", None) == "2023-01-01"


@settings(max_examples=300, deadline=None)
@given(
    st.datetimes(dt.datetime(1950, 1, 1), dt.datetime(2060, 1, 1)).map(lambda d: d.replace(microsecond=0)),
    st.sampled_from(["Europe/Madrid", "America/Santiago", "America/New_York", "America/Mexico_City", "UTC", "America/Bogota"]),
)
def test_local_times_against_brute_force(local, zone):
    tz, epoch = zoneinfo.ZoneInfo(zone), dt.datetime(1970, 1, 1)
    fits = {
        u
        for fold in (0, 1)
        for u in [local.replace(tzinfo=tz, fold=fold).astimezone(dt.UTC)]
        if u.astimezone(tz).replace(tzinfo=None) == local
    }
    seconds, good = local_to_utc(pd.Series([int((local - epoch).total_seconds())]).to_numpy(), zone)
    assert bool(good[0]) == (len(fits) == 1)
    if fits and good[0]:
        assert epoch.replace(tzinfo=dt.UTC) + dt.timedelta(seconds=int(seconds[0])) == fits.pop()


def test_mask():
    assert class_mask("mon, 02 jan 2023") == "D, 99 M 9999"
    assert class_mask("mar 7 de mar de 2023 utc") == "X 9 de X de 9999 W"
    assert parser_of("D, 99 M 9999")[0] == "mail_day"
    assert parser_of("W, 99 M 9999") is None


def test_a_mask_has_one_parser():
    values = [x for x, _ in CASES if x and len(x) < 80]
    alone = [one(x) for x in values]
    n = len(values)
    together = normalise_batch(pd.Series(values), pd.Series(["Europe/Madrid"] * n), pd.Series(["dma"] * n))
    assert [None if x is None else x for x in together] == alone


def test_long_values_and_other_digits():
    assert one(" " * 500 + "2023-01-02" + "\n" * 500) == "2023-01-02"
    assert one("2023-01-02T02:00:30.123456789-06:00:00"[:38]) is None
    assert one("2023-01-02 02:00:30.123456789 -06:00") == "2023-01-02T08:00:30Z"
    assert one("\u0662\u0660\u0662\u0663-01-02") is None
    assert one("2023-01-02 02:00 " + "zona/" * 40_000 + "x") is None


def test_version_of_the_zone_tables(spark):
    df = spark.createDataFrame([("2023-01-02 02:00", "UTC", "dma")], "fecha string, zona string, orden string")
    assert normalise_timestamps(df, "fecha", "zona", "orden", version="tablas").first()["tablas"] == zone_table_version()


def test_frame_with_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "2023-01-02", None, "dma", "keep"), (2, None, "UTC", None, "keep")], "pos long, fecha string, zona string, orden string, extra string")
    rows = {r.pos: (r.normal, r.extra) for r in normalise_timestamps(df, "fecha", "zona", "orden").collect()}
    assert rows == {1: ("2023-01-02", "keep"), 2: (None, "keep")}
    assert normalise_timestamps(df.limit(0), "fecha", "zona", "orden").count() == 0
