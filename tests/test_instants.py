import os
import uuid
from datetime import date
from zoneinfo import ZoneInfo

import pytest

from combline.functions.stamps import parse_stamp
from combline.operators import instants
from combline.operators.instants import Dictionary, normalise_instants, stamp_rows
from combline.session import shared_dir

NY = ZoneInfo("America/New_York")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1696027426", 1696027426), ("1695976671473637", 1695976671), ("1.695958675E+09", 1695958675), ("1696176130.73", 1696176130), ("2023-09-29T05:11:22-04:00", 1695978682),
        ("20230930T064453Z", 1696056293), (' "28.09.2023 17:07:11". ', 1695935231), ("10/06/2023 3:02:34 AM", 1696575754), ("Oct 15, 2023 1:48 PM", 1697392080), ("9/28/2023 22:10 EST", 1695957000),
        ("2023-10-28 21:38:27 America/New_York", 1698543507), ("2023-11-05 01:30:00", None), ("2024-03-10 02:30:00", None), ("2023-11-05 01:30:00 EDT", 1699162200), ("0", None), ("-1", None), ("N/A", None),
        ("2023-02-30 10:00:00", None), ("1999-12-31T23:59:59Z", None), ("2036-01-01T00:00:00Z", None), ("12:45", None), ("", None), (None, None),
    ],
)
def test_stamps(text, want):
    assert parse_stamp(text, NY) == want


@pytest.mark.parametrize(("text", "want"), [("19:00", 1688252400), ("1400", 1688234400), ("T23:17", 1688267820), ("6.06 p.m.", 1688249160), ("2pm", 1688234400), ("06:00 CDT", 1688209200), ("19h00", 1688252400), ("7:52 Uhr", 1688212320), ("22:28Z", 1688250480), ("dusk", None), ("25:00", None), ("7", None)])
def test_clock_times(text, want):
    assert parse_stamp(text, NY, date(2023, 7, 1)) == want


def test_dictionary_parses_once(spark, monkeypatch):
    rows = [(1, "1696027426"), (2, " 1696027426 "), (3, "never 5"), (4, None), (5, "28.09.2023 17:07:11"), (None, "1696027426"), (2, " 1696027426 ")]
    table = lambda r: stamp_rows(spark.createDataFrame(r, "raw_id long, ts_raw string").selectExpr("*", "1 as day", "2 as n"), "raw_id", "ts_raw", "sensor")
    path = f"{shared_dir(spark)}/dictionary-test-{uuid.uuid4().hex}"
    run = lambda r: sorted((x.row_id, x.epoch_s) for x in normalise_instants(table(r), path).collect())
    want = [(1, 1696027426), (2, 1696027426), (2, 1696027426), (5, 1695935231)]
    assert run(rows) == want
    kept = Dictionary(spark, path)
    assert len(kept.additions()) == 1 and kept.entries().count() == 3
    # nothing new: nothing is parsed or added, unreadable stamps included
    assert run(rows) == want and len(kept.additions()) == 1
    # an addition that was not finished does not count
    (unfinished := spark.createDataFrame([("sensor", "", "1696027426", "America/New_York", 1)], instants._ENTRY)).write.parquet(f"{path}/added-dead")
    os.remove(f"{path.removeprefix('file:')}/added-dead/_SUCCESS".replace("///", "/"))
    assert unfinished.count() == 1 and len(kept.additions()) == 1
    # only what is new is parsed
    assert run([*rows, (6, "1700000000")]) == [*want, (6, 1700000000)] and [spark.read.parquet(p).count() for p in kept.additions()].count(1) == 1
    # the same stamp parsed by two runs at once does not multiply rows
    kept.add(kept.entries())
    assert run(rows) == want
    assert normalise_instants(table(rows[:0]), path).collect() == []
