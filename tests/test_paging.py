"""Stop rules of paged listings: by hand, and a stream with a restart against the table."""

from gavelspark.streaming import paging

SCHEMA = "site string, page int, url string, titles array<string>"


def make():
    many = [f"t{i}" for i in range(30)]
    rows = [("a", 2, "u2", many[:10]), ("a", 3, "u3", []), ("a", 4, "u4", many[10:20]), ("a", 5, "u5", None), ("a", 6, "u6", []), ("a", 7, "u7", many[20:])]  # two empty at 6
    rows += [("b", 2, "u2", many[:10]), ("b", 3, "u3", many[2:11] + ["x"]), ("b", 4, "u4", many[2:11] + ["y"] * 5), ("b", 5, "u5", ["z"])]  # 8 of 10 are not more than four fifths, 9 of 10 are
    rows += [("c", 2, "u2", ["p"]), ("c", 3, "u3", ["q"]), ("c", 4, "u2", ["r"]), ("c", 5, "u9", ["s"])]  # a revisit at 4
    rows += [("d", 2, None, ["p"]), ("d", 3, None, ["q"])]
    return rows


EXPECTED = {("a", 6): "two empty", ("a", 7): "after a stop", ("b", 4): "same titles", ("b", 5): "after a stop", ("c", 4): "revisit", ("c", 5): "after a stop"}


def test_stops_by_hand(spark):
    out = paging.stops(spark.createDataFrame(make(), SCHEMA).repartition(3)).collect()
    assert {(r.site, r.page): r.reason for r in out if r.reason} == EXPECTED
    assert {(r.site, r.page) for r in out if r.kept} == {(s, p) for s, p, _, t in make() if t and (s, p) not in EXPECTED}


def test_stream_with_a_restart_gives_what_the_table_gives(spark, tmp_path):
    rows = make()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        low, high = [r for r in rows if r[1] <= 3], [r for r in rows if r[1] > 3]
        for data in (low, high):  # the query ends and is started again between them
            spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            out = paging.stops_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            assert out.awaitTermination(300)
        got = spark.read.parquet(str(tmp_path / "out")).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    table = paging.stops(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.site, r.page, r.reason or "", r.kept) for r in got) == sorted((r.site, r.page, r.reason or "", r.kept) for r in table)


def test_frames_of_titles_do_not_grow_with_a_site(spark):
    many = [("a", i, f"u{i % 60 if i > 90 else i}", [f"t{i}-{j}" for j in range(i % 4)] or None) for i in range(100) if i % 4 or i % 8]
    many += [("b", i, f"u{i}", [f"w{i % 5}", f"x{i // 25}"]) for i in range(100)]
    df = paging.stops(spark.createDataFrame(many, SCHEMA).repartition(3))
    assert "unboundedpreceding$(), -1" not in df._jdf.queryExecution().optimizedPlan().toString().lower().split("collect_list", 1)[-1].split("]", 1)[0]
    got = {(r.site, r.page): r.reason for r in df.collect()}
    for site in "ab":
        seen, last, empty, over = set(), [], False, False
        for _, page, url, titles in sorted(r for r in many if r[0] == site):
            own = set(titles or [])
            why = "after a stop" if over else "revisit" if url in seen else "two empty" if not own and empty else "same titles" if own and len(own & set(last)) > len(own) * 0.8 else None
            assert got[site, page] == why
            seen.add(url)
            last, empty, over = (last + (titles or []))[-20:], not own, over or why is not None
