import glob
from datetime import date
from pathlib import Path

import pytest

from couponflow.plans import reports
from couponflow.session import shared_dir, table_path
from couponflow.sources import scans, schemas, sinks, standin


def test_csv_scan(spark, tmp_path):
    (tmp_path / "offline.csv").write_text(
        "User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received,Date\n"
        "1439408,2632,null,null,0,null,20160217\n"
        "1439408,2632,8591,20:1,null,20160217,null\n"
    )
    rows = scans.offline_csv(spark, str(tmp_path / "offline.csv")).collect()
    assert tuple(rows[0]) == (1439408, 2632, None, None, 0, None, date(2016, 2, 17))
    assert tuple(rows[1]) == (1439408, 2632, 8591, "20:1", None, date(2016, 2, 17), None)


def test_online_coupon_stays_text(spark, tmp_path):
    (tmp_path / "online.csv").write_text(
        "User_id,Merchant_id,Action,Coupon_id,Discount_rate,Date_received,Date\n"
        "1,2,1,fixed,fixed,20160101,20160101\n1,2,0,null,null,null,20160101\n"
    )
    rows = scans.online_csv(spark, str(tmp_path / "online.csv")).collect()
    assert [r.coupon_id for r in rows] == ["fixed", None]


def test_standin_counts(spark, tables):
    offline, online = standin.offline(spark, tables), standin.online(spark, tables)
    totals = reports.segment_totals(offline).first()
    assert offline.schema.names == schemas.OFFLINE.names
    assert [f.dataType for f in offline.schema] == [f.dataType for f in schemas.OFFLINE]
    assert [f.dataType for f in online.schema] == [f.dataType for f in schemas.ONLINE]
    assert (offline.count(), offline.distinct().count()) == (6000, 5827)
    assert totals.coupon_purchase + totals.coupon_unused == 3930
    assert (totals.coupon_purchase, totals.neither) == (1944, 0)
    actions = {r.action: r["count"] for r in online.groupBy("action").count().collect()}
    assert actions == {0: 599, 1: 202, 2: 199}


LINES = [
    "User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received,Date",
    "1,2,3,0.9,4,20160101,null",
    "x,2,3,0.9,4,20160101,null",
    "1,2,3,0.9,4,20161301,null",
    "1,2,3,0.9,4,20160230,null",
    "1,2,3,0.9",
    "1,2,3,0.9,4,20160101,null,surplus",
    "2,2,null,null,null,null,20160102",
]


def test_bad_lines_go_to_quarantine(spark, tmp_path):
    path = tmp_path / "offline.csv"
    path.write_text("\n".join(LINES) + "\n")
    found = scans.ingest_csv(spark, str(path), schemas.OFFLINE, str(tmp_path / "in"), most_bad=0.8)
    assert (found.total, found.bad) == (7, 5)
    assert sorted(r.user_id for r in found.rows.collect()) == [1, 2]
    assert found.rows.schema.names == schemas.OFFLINE.names
    assert sorted(r.line for r in found.quarantine.collect()) == sorted(LINES[2:7])
    assert [(r.good, r.bad) for r in found.counts.collect()] == [(2, 5)]
    with pytest.raises(scans.TooManyBadRows, match="5 of 7"):
        scans.ingest_csv(spark, str(path), schemas.OFFLINE, str(tmp_path / "strict"))
    # The lines can be looked at all the same.
    assert spark.read.parquet(str(tmp_path / "strict" / "quarantine")).count() == 5


def test_a_table_without_lines_and_one_without_bad_ones(spark, tmp_path):
    for name, lines, total in (("none", LINES[:1], 0), ("good", LINES[:2], 1)):
        path = tmp_path / f"{name}.csv"
        path.write_text("\n".join(lines) + "\n")
        found = scans.ingest_csv(spark, str(path), schemas.OFFLINE, str(tmp_path / name))
        assert (found.total, found.bad) == (total, 0) and found.rows.count() == total and found.quarantine.count() == 0


def test_parquet_scan_and_report(spark, tmp_path):
    """The form to keep tables in, and the report writer."""
    path = tmp_path / "offline.csv"
    path.write_text("\n".join(LINES[:2]) + "\n")
    scans.offline_csv(spark, str(path)).write.parquet(str(tmp_path / "table"))
    again = scans.read_parquet(spark, str(tmp_path / "table"), schemas.OFFLINE)
    assert again.first().user_id == 1
    sinks.write_report(again.groupBy("distance").count(), str(tmp_path / "report"))
    text = "".join(Path(p).read_text() for p in glob.glob(str(tmp_path / "report" / "*.csv")))
    assert text.splitlines() == ["distance,count", "4,1"]


def test_cache_builds_once(spark):
    path, calls = table_path(spark, "cache"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert sinks.cached_table(spark, path, build).count() == 3
    assert sinks.cached_table(spark, path, build).count() == 3
    assert len(calls) == 1


def test_submission_has_no_header(spark, tmp_path):
    rows = [(1, 2, "20160701", 0.5)]
    schema = "user_id long, coupon_id long, date_received string, probability double"
    sinks.write_submission(spark.createDataFrame(rows, schema), str(tmp_path / "out"))
    parts = glob.glob(str(tmp_path / "out" / "*.csv"))
    text = "".join(Path(part).read_text() for part in parts)
    assert text.strip() == "1,2,20160701,0.5"


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_csv_with_another_header_is_refused(spark, tmp_path):
    path = tmp_path / "batch.csv"
    path.write_text("User_id,Merchant_id,Coupon_id,Discount_rate,Distance,Date_received\n1,2,3,0.9,4,20160101\n")
    assert scans.offline_batch_csv(spark, str(path)).first().coupon_id == 3
    swapped = tmp_path / "swapped.csv"
    swapped.write_text("Merchant_id,User_id,Coupon_id,Discount_rate,Distance,Date_received\n1,2,3,0.9,4,20160101\n")
    with pytest.raises(ValueError, match="column 1"):
        scans.offline_batch_csv(spark, str(swapped))
    short = tmp_path / "short.csv"
    short.write_text("User_id,Merchant_id\n1,2\n")
    with pytest.raises(ValueError, match="2 columns"):
        scans.offline_batch_csv(spark, str(short))
