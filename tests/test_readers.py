"""Readers over files on disk: log headers by position, benchmark parts, the loader registry."""

import random

import pytest

from vigilflow.sources import flows as fl

A = "ts id.orig_h id.orig_p id.resp_h id.resp_p proto orig_bytes".split()
B = "id.resp_h id.orig_h proto ts orig_bytes id.orig_p id.resp_p".split()


def log(rng, n):
    """Lines with changing, repeated and missing headers, and the rows a plain reader gets from them."""
    lines, want, head = ["# no header yet", "1.0\tlost\t1\tlost\t2\ttcp\t3"], [], None
    for i in range(n):
        if head is None or rng.random() < 0.05:
            head = rng.choice((A, B))
            lines.append("#fields\t" + "\t".join(head))
        cell = {"ts": str(float(i)), "id.orig_h": f"10.0.0.{rng.randint(1, 9)}", "id.orig_p": str(i), "id.resp_h": "10.1.1.1", "id.resp_p": "53",
                "proto": rng.choice(("tcp", "UDP")), "orig_bytes": str(i * 7)}
        lines.append("\t".join(cell[c] for c in head))
        want.append((cell["id.orig_h"], cell["id.resp_h"], i, 53, cell["proto"].lower(), float(i), float(i * 7)))
    return lines, want


def columns(df):
    return sorted(tuple(r) for r in df.select("src_ip", "dst_ip", "src_port", "dst_port", "proto", "ts", "sbytes").collect())


@pytest.fixture
def logs(tmp_path):
    rng, want = random.Random(5), []
    for k, n in enumerate((400, 3, 90)):
        lines, rows = log(rng, n)
        (tmp_path / f"conn{k}.log").write_text("\n".join(lines) + "\n")
        want += rows
    (tmp_path / "empty.log").write_text("")
    return str(tmp_path), sorted(want)


def test_headers_by_position_over_many_splits(spark, logs):
    path, want = logs
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("700", "4096", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert columns(fl.read_flows(spark, path + "/*.log")) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_headers_on_a_stream(spark, logs, tmp_path_factory):
    path, want = logs
    out = str(tmp_path_factory.mktemp("out"))
    q = fl.read_stream(spark, path, "zeek", max_files=1).writeStream.format("parquet").option("path", out + "/rows").option(
        "checkpointLocation", out + "/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert columns(spark.read.parquet(out + "/rows")) == want


def test_stream_reads_logs_in_splits(spark, logs, tmp_path_factory):
    """No row holds a whole file: a file of the stream is read by several tasks, headers found by position."""
    path, want = logs
    out, parts = str(tmp_path_factory.mktemp("out")), []

    def keep(rows, batch_id):
        rows.write.parquet(f"{out}/rows/batch={batch_id}")

    def seen(lines, batch_id):
        parts.append(lines.rdd.getNumPartitions())
        fl.zeek_batches(keep)(lines, batch_id)

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        fl.zeek_line_stream(spark, path, max_files=1).writeStream.option("checkpointLocation", out + "/state").foreachBatch(seen).trigger(
            availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert columns(spark.read.parquet(out + "/rows")) == want
    assert max(parts) > 3


def test_benchmark_parts_and_registry(spark, tmp_path):
    row = {c: "1" for c in fl.UNSW_COLUMNS} | {"srcip": " 10.0.0.1", "dstip": "10.0.0.2", "proto": "tcp", "attack_cat": " Fuzzers ", "Stime": "1421927414"}
    for k in (1, 2):
        (tmp_path / f"UNSW-NB15_{k}.csv").write_bytes((",".join({**row, "service": "caf\u00e9"}[c] for c in fl.UNSW_COLUMNS) + "\n").encode("latin-1") * (k + 1))
    (tmp_path / "UNSW-NB15_LIST_EVENTS.csv").write_text("not,a,part\n")
    got = fl.load_dataset(spark, "unsw_nb15", str(tmp_path)).collect()
    assert len(got) == 5 and {(r.src_ip, r.attack_cat, r.service, r.label, r.dataset) for r in got} == {("10.0.0.1", "Fuzzers", "caf\u00e9", 1, "unsw_nb15")}
    assert fl.load_dataset(spark, "unsw_nb15", str(tmp_path), max_rows=3).count() <= 3
    head = "Flow ID, Source IP, Source Port, Destination IP, Destination Port, Protocol, Timestamp, Flow Duration, Label\n"
    (tmp_path / "mon.csv").write_text(head + "a,10.0.0.1,1,10.0.0.2,2,6,3/7/2017 8:55,5,BENIGN\n")
    (tmp_path / "tue.csv").write_text(head.replace(" Flow Duration", " Extra") + "a,10.0.0.3,1,10.0.0.2,2,17,4/7/2017 8:55,6,DDoS\n")
    df = fl.load_dataset(spark, "cicids2017", [str(tmp_path / "mon.csv"), str(tmp_path / "tue.csv")])
    assert {"Flow Duration", "Extra"} <= set(df.columns)
    assert sorted((r.src_ip, r.proto, r.label, r.attack_cat) for r in df.collect()) == [("10.0.0.1", "6", 0, "Normal"), ("10.0.0.3", "17", 1, "DDoS")]
    with pytest.raises(KeyError):
        fl.load_dataset(spark, "other", "x")
