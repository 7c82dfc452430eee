"""Snapshots with pointers to the newest polls, and the table of a running query over them."""

import os

from vigilflow.sources import feeds
from vigilflow.streaming import scoring as st

SCHEMA = "value string, ioc_type string, source string, provenance string, first_seen double, last_seen double, confidence double, tags string, sightings int"


def records(spark, source, *values):
    return spark.createDataFrame([(v, "ipv4", source, "live", 10.0, 10.0, 0.5, "", 1) for v in values], SCHEMA)


def held(df):
    return sorted((r.source, r.poll_ts, r.value) for r in df.collect())


def newest(spark, path):
    return feeds.read_newest(spark, path, feeds.newest_polls(spark, path))


def test_newest_polls_equal_the_history_scan(spark, tmp_path):
    path = str(tmp_path / "s")
    for poll in range(1, 8):
        feeds.write_snapshot(records(spark, "a", f"1.1.1.{poll}"), path, poll)
    feeds.write_snapshot(records(spark, "b", "2.2.2.2").union(records(spark, "c", "3.3.3.3")), path, 4)
    feeds.write_snapshot(records(spark, "a"), path, 9)  # an empty poll is none
    want = [("a", 7, "1.1.1.7"), ("b", 4, "2.2.2.2"), ("c", 4, "3.3.3.3")]
    assert held(newest(spark, path)) == held(feeds.latest_snapshot(feeds.read_snapshots(spark, path))) == want
    assert {os.path.basename(os.path.dirname(f)) for f in newest(spark, path).inputFiles()} == {"poll_ts=7", "poll_ts=4"}
    assert len(os.listdir(f"{path}/_newest/source=a")) <= 2  # one pointer, and its checksum on a local disk


def test_a_repeated_poll_replaces_and_a_late_one_does_not_lead(spark, tmp_path):
    path = str(tmp_path / "s")
    feeds.write_snapshot(records(spark, "a", "1.1.1.1", "1.1.1.2"), path, 5)
    first = feeds.newest_polls(spark, path)
    feeds.write_snapshot(records(spark, "a", "1.1.1.3"), path, 5)
    assert held(newest(spark, path)) == [("a", 5, "1.1.1.3")] and feeds.newest_polls(spark, path) != first
    feeds.write_snapshot(records(spark, "a", "1.1.1.9"), path, 4)
    assert held(newest(spark, path)) == [("a", 5, "1.1.1.3")]
    assert feeds.read_snapshots(spark, path).count() == 2


def test_folders_without_pointers_are_listed(spark, tmp_path):
    path = str(tmp_path / "s")
    for poll in (9, 10):
        records(spark, "a", f"1.1.1.{poll}").selectExpr("*", f"{poll} as poll_ts").write.mode("append").partitionBy("source", "poll_ts").parquet(path)
    feeds.write_snapshot(records(spark, "b", "2.2.2.2"), path, 1)
    assert held(newest(spark, path)) == [("a", 10, "1.1.1.10"), ("b", 1, "2.2.2.2")]


def test_a_look_without_news_runs_no_job_and_tables_outlive_their_batches(spark, tmp_path):
    path, sc = str(tmp_path / "s"), spark.sparkContext
    feed = st.FeedTable(spark, path, 60.0, 3600.0, 0.0)
    assert not feed.refresh() and "no indicator" in feed.last_error
    feeds.write_snapshot(records(spark, "a", "1.1.1.1"), path, 1)
    assert feed.refresh() and len(feed.kept) == 1
    sc.setJobGroup("look", "look")
    assert not feed.refresh() and not feed.last_error
    assert not sc.statusTracker().getJobIdsForGroup("look")
    sc.setLocalProperty("spark.jobGroup.id", None)

    flows = spark.createDataFrame([(1, "1.1.1.1", "9.9.9.9", 100.0)], "flow_id long, src_ip string, dst_ip string, ts double")
    with feed.in_use() as old:
        late = feed.enrich(flows, 60.0, old)
        for poll in (2, 3, 4):
            feeds.write_snapshot(records(spark, "a", f"1.1.1.{poll}"), path, poll)
            assert feed.refresh()
        assert [r.ioc_src_match for r in late.collect()] == [1]  # read after three refreshes
        assert [r.ioc_src_match for r in feed.enrich(flows, 60.0).collect()] == [0]
        assert len(feed.kept) == 3
    assert len(feed.kept) == 2 and all(os.path.isdir(x) for x in feed.kept)
