"""Operators on small fixtures: sources, fuzzy duplicates, merges, streams, bad requests."""

import difflib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gavelspark.functions import text
from gavelspark.operators import dedup, merge, search
from gavelspark.schema import PROPERTIES
from gavelspark.sources import bank_csv, html_items, json_items, snapshot
from gavelspark.streaming import search_log


def test_unknown_sort_field(spark):
    """Means created_at, but is an error where requests are normalised."""
    with pytest.raises(ValueError):
        search.ordering(search.SearchRequest(sort_by="id; drop", normalised=True))
    order = [[str(c) for c in search.ordering(search.SearchRequest(sort_by=by))] for by in ("id; drop", "created_at")]
    assert order[0] == order[1]


def test_contains_takes_wildcards_as_they_are(spark):
    df = spark.createDataFrame([("100% casa",), ("100 casa",)], "t string")
    assert df.where(search.contains(F.col("t"), "0% C")).count() == 1


def test_bank_csv(spark, tmp_path):
    header = "Lista de imóveis\n\nN° do imóvel;UF;Cidade;Bairro;Endereço;Preço;Avaliação;Desconto;Descrição;Modalidade;Link\n"
    for uf in ("SP", "PR"):
        (tmp_path / f"{uf}.csv").write_text(header + f"144-1;{uf};SAO PAULO;CENTRO;RUA \"A\", 1;100.000,00;200.000,00;50,00;Apartamento, 50 m²;Venda Direta;https://x.y/d.asp?id=1\n", encoding="latin-1")
    rows = bank_csv.to_listings(bank_csv.read_bank_csv(spark, str(tmp_path))).collect()
    assert sorted(r.state for r in rows) == ["PR", "SP"]
    r = rows[0]
    assert (r.id, r.category, r.city, r.first_auction_value, r.discount_percentage) == ("caixa-1441", "Apartamento", "Sao Paulo", 100000.0, 50.0)


def test_header_aliases(spark):
    df = spark.createDataFrame([("1", "SP", None, "9,5")], "`N° do imóvel` string, UF string, Estado string, `Preço` string")
    r = bank_csv.renamed(df).first()
    assert (r.number, r.state, r.price, r.city) == ("1", "SP", "9,5", None)


def test_json_items(spark):
    df = spark.createDataFrame([('{"offers":[{"id":7,"product":{"shortDesc":"Casa","location":{"city":"A","state":"SP"}},"price":"1.000,50"},{"nome":"Lote"}]}', "x"), ("not json", "x"), (None, "x")], "text string, source string")
    rows = {r.title: r for r in json_items.normalized(df).collect()}
    assert set(rows) == {"Casa", "Lote"} and rows["Casa"].id == "x-7" and rows["Casa"].city == "A"


def test_nested_offers(spark):
    text = '{"offers":[{"id":1,"price":5.0,"product":{"shortDesc":"T","galleryJson":[{"link":"a","highlight":false},{"link":"b","highlight":true}],"location":{"city":"C","state":"SP"}},"auction":{"id":9},"stores":[{"id":1,"name":"S"}]},{"id":2,"product":{"thumbnailUrl":"z"}}]}'
    rows = {r.id: r for r in json_items.offers(spark.createDataFrame([(text,)], "text string")).collect()}
    assert rows[1].image_url == "b" and rows[1].auctioneer == "S" and rows[2].image_url == "z" and rows[2].auctioneer is None


def test_html_cards(spark):
    html = '<div class="card x"><h3>Casa &amp; lote</h3><a href="/lote/5">v</a> R$ 1.500,00 Curitiba/PR<img src="/foto/a.jpg"></div><div class="card"></div><article class="big-card"><a href="https://z.com/q">q</a></article>'
    rows = sorted(html_items.cards(spark.createDataFrame([("https://s.com/x", html)], "url string, html string")).collect(), key=lambda r: r.place)
    assert [(r.title, r.link, r.price) for r in rows] == [("Casa & lote", "https://s.com/lote/5", 1500.0), (None, "https://z.com/q", None)]
    assert (rows[0].city, rows[0].state, rows[0].image_url) == ("Curitiba", "PR", "/foto/a.jpg")


def test_snapshot_round_trip(spark, tmp_path):
    row = {f.name: None for f in PROPERTIES} | {"id": "1", "category": "Nave", "auction_type": "Judicial", "state": "SP"}
    df = spark.createDataFrame([tuple(row[f.name] for f in PROPERTIES)], PROPERTIES)
    snapshot.write_snapshot(df, str(tmp_path / "s"))
    r = snapshot.read_snapshot(spark, str(tmp_path / "s")).first()
    assert (r.id, r.category, r.auction_type) == ("1", "Outro", "Judicial")


def test_blocked_pairs_like_difflib(spark):
    words = ["casa no centro da cidade", "casa no centro da cidadde", "casa no centro", "apartamento novo", "apartamento novoo", None]
    data = [(i, b, w) for i, (b, w) in enumerate(itertools.product("xy", words))]
    df = spark.createDataFrame(data, "id int, block string, name string")
    mine = {(r.a, r.b): r.ratio for r in dedup.blocked_pairs(df, ["block"], "name", "id").collect()}
    expected = {}
    for (i, b, v), (j, c, w) in itertools.combinations(data, 2):
        if b == c and v and w and (ratio := difflib.SequenceMatcher(None, v, w, autojunk=False).ratio()) >= 0.85:
            expected[(i, j)] = ratio
    assert mine == pytest.approx(expected)


def similar(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


@pytest.mark.parametrize("least", [0.85, 0.7])
def test_no_similar_pair_is_lost(spark, least):
    r = random.Random(4)
    words = ["casa", "rua", "das", "flores", "avenida", "brasil", "n", "12", "apto", "centro", "ab", "abc"]
    data = []
    for i in range(250):
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 7)))
        t = t[: r.randint(1, 10)] if r.random() < 0.3 else t
        data.append((i, r.choice("xy"), t))
        at = r.randrange(len(t))
        data.append((1000 + i, data[-1][1], t[:at] + r.choice("abcxyz1") + t[at + 1 :]))
    data += [(2000, "x", "abc"), (2001, "x", "abc"), (2002, "x", "aaaaaaa"), (2003, "y", None)]
    mine = {(x.a, x.b): x.ratio for x in dedup.blocked_pairs(spark.createDataFrame(data, "id int, block string, name string"), ["block"], "name", "id", least).collect()}
    first, expected = {}, {}
    for i, b, v in sorted(data, key=lambda d: d[0]):
        if v is not None:
            first.setdefault((b, v), i)
    for ((b, v), i), ((c, w), j) in itertools.combinations(first.items(), 2):
        (i, v), (j, w) = sorted([(i, v), (j, w)])
        if b == c and (ratio := similar(v, w)) >= least:
            expected[(i, j)] = ratio
    assert mine == pytest.approx(expected) and expected


def test_scored_pairs(spark):
    columns = "id string, auctioneer_id int, title string, address string, neighborhood string, city string, state string, category string, evaluation_value double, first_auction_value double, area_total double, area_privativa double"
    base = ("Casa térrea", "Rua das Flores, 120", "Centro", "Santos", "SP", "Casa", 100000.0, 90000.0, 50.0, None)
    rows = [
        ("a", 1, *base), ("b", 2, "Casa terrea", "R. das Flores, 120", *base[2:]), ("c", 1, *base), ("d", 3, *base[:3], "Campinas", *base[4:]),
        ("e", 4, "Apartamento", *base[1:5], "Apartamento", 300000.0, None, 400.0, None), ("f", 5, *base[:4], "sp", *base[5:]), ("g", 6, *[None] * 10),
    ]
    found = {(r.a, r.b): r for r in dedup.scored_pairs(spark.createDataFrame(rows, columns)).collect()}
    assert set(found) == {("a", "b"), ("a", "a")}  # c and f are as a is, f of another auctioneer; d is of another city, e too unlike
    assert found[("a", "a")].score == pytest.approx(1.0) and found[("a", "a")].reasons == "address alike,title,category,value,area"
    assert (found[("a", "b")].n_a, found[("a", "b")].n_b) == (3, 1)
    members = {r.id: r.profile for r in dedup.profiles(spark.createDataFrame(rows, columns)).collect()}
    assert members == {"a": "a", "b": "b", "c": "a", "d": "d", "e": "e", "f": "a"}
    address, title = "rua das flores 120 centro santos sp", similar("casa terrea", "casa terrea")
    assert found[("a", "b")].score == pytest.approx(0.4 * min(1, similar(address, address) + 0.3) + 0.2 * title + 0.4)


def test_scored_pairs_as_all_pairs(spark):
    import random

    r = random.Random(8)
    columns = "id int, auctioneer_id int, title string, address string, neighborhood string, city string, state string, category string, evaluation_value double, first_auction_value double, area_total double, area_privativa double"
    rows = [
        (i, r.choice([1, 2, 3, None]), r.choice(["casa", "casa nova", "apartamento", None]), f"rua das flores {r.randrange(3)}" if r.random() < 0.8 else None, r.choice(["centro", None]), r.choice(["Santos", "santos", "Recife"]),
         "SP", r.choice(["Casa", "Apartamento", None]), r.choice([100.0, 105.0, 400.0, None, 0.0]), 90.0, r.choice([50.0, None]), None) for i in range(90)
    ]
    df = spark.createDataFrame(rows, columns)
    profile = {x.id: x.profile for x in dedup.profiles(df).collect()}
    seller = {x[0]: str(x[1] or "") for x in rows}
    found = {(x.a, x.b): x.score for x in dedup.scored_pairs(df, 0.75, 0.85).collect()}
    full = lambda x: ", ".join(v or "" for v in (x[3], x[4], x[5], x[6]))
    pairs = [(x, y) for n, x in enumerate(rows) for y in rows[n + 1 :] if x[5].lower() == y[5].lower() and seller[x[0]] != seller[y[0]]]
    schema = "a string, b string, " + ", ".join(f"{s}_{c} string" for s in "ab" for c in ("title", "category")) + ", " + ", ".join(f"{s}_{c} double" for s in "ab" for c in ("evaluation_value", "first_auction_value", "area_total", "area_privativa")) + ", x int, y int"
    flat = [(full(x), full(y), x[2], x[7], y[2], y[7], *x[8:12], *y[8:12], x[0], y[0]) for pair in pairs for x, y in (pair, pair[::-1])]  # difflib's ratio hangs on the order
    made = spark.createDataFrame(flat, schema).withColumns({c: text.long_address(F.col(c)) for c in "ab"})
    scores = {}
    for x in dedup.pair_score(dedup.with_address(made, "a", "b").withColumn("near", dedup.text_ratio("a", "b") >= 0.85), 0.0).collect():
        scores.setdefault(tuple(sorted((profile[x.x], profile[x.y]))), []).append(x.score if x.near else 0.0)
    assert {p for p, own in scores.items() if min(own) >= 0.75} <= set(found) <= {p for p, own in scores.items() if max(own) >= 0.75} and len(found) > 20
    assert all(any(score == pytest.approx(s) for s in scores[p]) for p, score in found.items())


def test_first_of_each_remembers_kept_items_only(spark):
    from gavelspark.operators.first_wins import first_of_each

    rows = spark.createDataFrame([(0, "1", "a"), (1, "1", "b"), (2, "2", "b"), (3, None, " "), (4, "", None), (5, "2", "z"), (6, "9", "z"), (7, "b", "1")], "at int, id string, url string")
    for few in (0, 2, 50_000):
        assert sorted(r.at for r in first_of_each(rows, "at", ["id", "url"], few=few).collect()) == [0, 2, 3, 4, 6, 7]
    old = spark.createDataFrame([("2", "q"), ("x", "a"), (None, "")], "id string, url string")
    assert sorted(r.at for r in first_of_each(rows, "at", ["id", "url"], existing=old).collect()) == [1, 3, 4, 6, 7]
    assert first_of_each(rows.limit(0), "at", ["id", "url"]).count() == 0


def test_first_of_each_as_item_after_item(spark):
    import random

    from gavelspark.operators.first_wins import first_of_each

    r = random.Random(3)
    rows = [(i, r.choice("xy"), f"i{r.randrange(60)}", f"u{r.randrange(60)}" if r.random() < 0.9 else None) for i in range(400)]
    rows += [(400 + i, "chain", f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(21)]  # each hangs on the one before
    rows += [(500 + i, "hot", "same", f"u{i}") for i in range(60)]
    taken, kept = set(), []
    for at, site, *keys in rows:
        own = {(site, n, k) for n, k in enumerate(keys) if k}
        if not own & taken:
            taken |= own
            kept.append(at)
    df = spark.createDataFrame(rows, "at int, site string, id string, url string").repartition(5)
    for few in (0, 50_000):
        assert sorted(x.at for x in first_of_each(df, "at", ["id", "url"], ["site"], few=few).collect()) == kept


def in_turn(pairs):
    out = {}
    for a, b in sorted(pairs):
        if a not in out:
            out.setdefault(b, a)
    return out


def test_absorbed_as_in_turn(spark):
    import random

    from gavelspark.operators.first_wins import absorbed

    r = random.Random(9)
    for n, edges in ((4, [(1, 2), (2, 3), (3, 4)]), (60, None), (200, None)):
        pairs = edges or list({tuple(sorted(r.sample(range(n), 2))) for _ in range(2 * n)}) + [(0, i) for i in range(1, n, 3)]
        df = spark.createDataFrame(pairs, "a int, b int")
        for few in (0, 50_000):
            assert {x.id: x.original_id for x in absorbed(df, few=few).collect()} == in_turn(pairs)
    assert absorbed(spark.createDataFrame([], "a int, b int"), few=0).count() == 0


def test_batch_duplicates(spark):
    import random

    r = random.Random(5)
    texts = [f"rua {r.choice(['das flores', 'da serra', 'do sol nascente'])} {r.randrange(130)} {r.choice(['centro', 'lado sul'])}" for _ in range(120)]
    rows = [(i, r.choice("st"), t) for i, t in enumerate(texts)]
    out = {}
    for n, (i, b, t) in enumerate(rows):
        if i not in out:
            for j, c, u in rows[n + 1 :]:
                if j not in out and b == c and similar(t, u) >= 0.85:
                    out[j] = i
    got = dedup.batch_duplicates(spark.createDataFrame(rows, "id int, site string, t string"), ["site"], "t", "id").collect()
    assert {x.id: x.original_id for x in got} == out and out


def test_probe_index(spark, tmp_path):
    import random

    from gavelspark.operators.probe_index import ProbeIndex

    r = random.Random(6)
    make = lambda ids: [(i, r.choice(["s", "t", None]), r.choice([None, "", "a", "ab"]) if i % 20 == 0 else f"{r.choice(['rua', 'avenida'])} {r.choice(['das flores', 'da serra', 'brasil'])} {r.randrange(70)} {r.choice(['centro', 'sul'])}") for i in ids]
    old, more, new = make(range(0, 80)), make(range(80, 130)), make(range(1000, 1150))
    df = lambda rows: spark.createDataFrame(rows, "id int, st string, t string")
    index = ProbeIndex(spark, str(tmp_path / "index"), ["st"], "t", buckets=3).create(df(old)).add(df(more))
    def first(block, text):
        return min((i for i, b, t in old + more if None not in (t, text) and b == block and (t == text or (t and text and similar(t, text) >= 0.85))), default=None)

    expected = {i: first(b, t) for i, b, t in new}
    assert {x.id: x.original_id for x in index.probe(df(new)).collect()} == expected and len(set(expected.values())) > 20
    later = ProbeIndex(spark, str(tmp_path / "index"), ["st"], "t", buckets=3)  # another session knows the folder only
    found = later.probe(df(new))
    assert {x.id: x.original_id for x in found.collect()} == expected
    read = {f.split("/index/")[1].split("/")[0] for f in found.inputFiles() if "/index/" in f}
    assert read == {"order", "texts", "tokens"}
    assert later.probe(df([])).count() == 0


def test_merge_last_posted_wins_and_null_keys_pass(spark):
    old = spark.createDataFrame([("a", "x"), (None, "p"), (None, "q"), ("b", "z"), ("c", "same")], "id string, v string")
    new = spark.createDataFrame([("a", "zz-first", 1), ("a", "aa-last", 2), (None, "n1", 3), (None, "n2", 4), ("d", "new", 5), ("c", "same", 6)], "id string, v string, at int")
    got = sorted((tuple(r) for r in merge.merge(old, new, "id", {"v": "replace"}, order="at").collect()), key=repr)
    assert got == sorted([("a", "aa-last", "updated"), (None, "p", "kept"), (None, "q", "kept"), ("b", "z", "kept"), ("c", "same", "unchanged"), ("d", "new", "inserted"), (None, "n1", "inserted"), (None, "n2", "inserted")], key=repr)
    done = merge.imported(old.withColumn("state", F.lit("SP")), new.withColumn("state", F.when(F.col("at") != 5, "RJ")), {"v": "track", "state": "keep"}, order="at")
    assert {(r.id, r.v, r.previous_v, r.action) for r in done.where("id is not null").collect()} == {("a", "aa-last", "x", "updated"), ("b", "z", None, "kept"), ("c", "same", None, "unchanged"), ("d", "new", None, "skipped")}


def test_separators_are_found(spark):
    row = ["144-1", "SP", "S", "C", "RUA A", "1", "2", "3", "D; x", "V", "https://x.y/?id=1"]
    lines = spark.createDataFrame([(s.join(row),) for s in (",", "\t")] + [("Lista; de, imóveis",)], "line string")
    assert [r.number for r in bank_csv.split_lines(lines).collect()] == ["144-1", "144-1"]


def test_sessions_as_a_stream_with_late_rows(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:10:00"), (2, "2024-01-05 10:00:00")]
    schema = "user_id long, ts timestamp_ntz"
    make = lambda data: spark.createDataFrame(data, "user_id long, t string").selectExpr("user_id", "cast(t as timestamp_ntz) as ts").coalesce(1)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = search_log.sessions(stream)
    for i, data in enumerate((rows, [(1, "2024-01-01 10:20:00"), (3, "2024-01-09 00:00:00")], [(4, "2024-01-20 00:00:00")])):
        make(data).write.mode("append").parquet(str(tmp_path / "in"))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    done = {(r.user_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (1, 2) in done and (2, 1) in done and (1, 3) not in done  # the late row of user 1 came after its session was closed


def test_losers_and_marks(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    points = spark.createDataFrame([(1, 5), (2, 5), (3, 9)], "id int, points int")
    lost = {r.id: r.original_id for r in dedup.losers(pairs, points).collect()}
    assert lost == {2: 1}
    rows = spark.createDataFrame([(1, False), (2, None)], "id int, is_duplicate boolean").withColumn("original_id", F.lit(None).cast("int"))
    assert {r.id: r.is_duplicate for r in dedup.mark_duplicates(rows, dedup.losers(pairs, points)).collect()} == {1: False, 2: True}


def test_latest_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert {r.k: r.v for r in merge.latest_by_key(df, "k", F.col("t")).collect()} == {"a": "y", "b": "z"}


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("ts", "event_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(str(tmp_path / "in"))
    q = search_log.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(spark.table("daily").collect()) == sorted(search_log.daily_counts(events).collect())


def test_pending_batches(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = search_log.process_pending(stream, lambda b: b.withColumn("done", F.lit(True)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_first_containing_as_all_pairs(spark):
    from gavelspark.operators.lookup import first_containing

    sites = [(3, "https://www.Leilao.com.br"), (1, "www.leilao-b.com"), (2, None), (4, ""), (0, "x"), (5, "https://ação.br")]
    parts = ["leilao", "LEILAO.com", "com", "b", "", None, "nowhere", "https://www.leilao.com.br", "ação", "x", "https://www.leilao.com.br/more", "com"]
    expected = [None if p is None else min((i for i, s in sites if s and p.lower() in s.lower()), default=None) for p in parts]
    rows = spark.createDataFrame(list(enumerate(parts)), "n int, p string")
    got = first_containing(rows, F.col("p"), spark.createDataFrame(sites, "id int, site string"), "site", "id", "found").orderBy("n").collect()
    assert [r.found for r in got] == expected


def test_located_in_order(spark):
    from gavelspark.operators.lookup import located

    rows = [(1, "São Paulo", " SP "), (2, "sao", "sp"), (3, "Santos, litoral", "SP"), (4, "Xyz", "rj"), (5, "Xyz", "??"), (6, None, "mg"), (7, "", "PR"), (8, "Curitiba", None)]
    got = {r.n: (r.latitude, r.matched) for r in located(spark.createDataFrame(rows, "n int, city string, state string")).collect()}
    assert got == {1: (-23.5505, "city"), 2: (-23.5505, "part"), 3: (-23.9608, "part"), 4: (-22.9068, "capital"), 5: (None, None), 6: (-19.9167, "capital"), 7: (-25.4284, "part"), 8: (None, None)}


def test_health_goes_on_from_a_summary(spark):
    import random
    from datetime import date, datetime, timedelta

    from gavelspark.operators import health

    r = random.Random(2)
    rows = [(s, date(2024, 1, 1) + timedelta(days=3 * i), r.randrange(30), r.randrange(3), 0, s != "never" and (s == "x" or r.random() < 0.4), datetime(2024, 1, 1, 8) + timedelta(days=3 * i)) for s in ("x", "y", "z", "never") for i in range(r.randrange(5, 40))]
    schema = "scraper string, day date, found long, failed long, redirected long, ok boolean, start_time timestamp_ntz"
    whole = health.run_summary(spark.createDataFrame(rows, schema), 4)
    expected = {}
    for s in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == s), key=lambda x: x[1], reverse=True)
        streak = next((i for i, x in enumerate(own) if x[5]), len(own))
        expected[s] = (len(own), streak, max((x[6] for x in own if x[5]), default=None), [x[1] for x in own[:4]])
    plain = lambda df: {x.scraper: (x.runs, x.streak, x.last_ok, [y.day for y in x["last"]]) for x in df.collect()}
    assert plain(whole) == expected
    cut = date(2024, 2, 10)
    old, new = (health.run_summary(spark.createDataFrame([x for x in rows if (x[1] < cut) == early], schema), 4) for early in (True, False))
    assert plain(health.merge_summaries(old, new, 4)) == expected
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_upserts_with_nulls_and_repeats(spark):
    from gavelspark.operators import upserts

    schema = "id string, title string, city string, neighborhood string, image_url string, source_url string, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
    df = lambda *rows: spark.createDataFrame([(*r, None, None) for r in rows], schema)
    old = df(("a", "A", "Santos", "Centro", None, "http://s.com/a", True), (None, "no id", None, None, None, None, True))
    new = df(("a", "first", "SAO PAULO", "JARDIM DA LUZ", "http://s.com/logo-of-the-house.png", "http://s.com/b", False), ("a", "last", "campinas", "", "http://s.com/photos/house.jpg", "nothing", True), (None, "also none", None, None, None, None, None))
    got = {(r.id, r.title): r for r in upserts.store(old, new.withColumn("at", F.when(F.col("title") == "last", 2).otherwise(1)), "2024-01-02", "at").collect()}
    assert set(got) == {("a", "last"), (None, "no id"), (None, "also none")}
    a = got[("a", "last")]
    assert (a.city, a.neighborhood, a.image_url, a.source_url, a.created_at, str(a.updated_at)) == ("Campinas", None, "http://s.com/photos/house.jpg", None, None, "2024-01-02 00:00:00")
    assert upserts.store(old, new.limit(0), "2024-01-02").count() == 2 and upserts.store(old.limit(0), new, "2024-01-02").count() == 3


def test_mapped_items_parse_an_item_once_and_read_values_as_they_stand(spark):
    items = ['{"titulo":"","title":"T","valor":0,"preco":1.50,"cidade":null,"city":["a",1],"uf":{"b":1},"id":12,"link":"../x?y=/./"}', '{"id":"a","data":true,"area":0.0,"m2":1e2,"foto":"/p/./q.jpg"}', '{"city":"no title"}', "[1]", "no json", None, '{"title":false}']
    rows = spark.createDataFrame(list(enumerate(items)), "key int, item string").where("length(item) < 1000 or item is null")
    out = json_items.mapped_items(rows, "item", F.lit("s"), F.lit("https://s.example/list/index.html"), ["key"])
    got = {r.key: r for r in out.collect()}
    assert set(got) == {0, 1}
    assert (got[0].title, got[0].price, got[0].city, got[0].state, got[0].url, got[0].external_id) == ("T", "1.5", '["a",1]', '{"b":1}', "https://s.example/x?y=/./", "s_12")
    assert (got[1].auction_date, got[1].area, got[1].image_url) == ("true", "100.0", "https://s.example/p/q.jpg")
    assert out._jdf.queryExecution().executedPlan().toString().lower().count("parsejson") == 1


def test_texts_of_a_block_that_have_much_in_common_meet_as_all_pairs(spark):
    rng = random.Random(5)
    end = lambda b: f", zone {b}, middle east 39, nation_24" if b else ""
    rows = [(i, b, rng.choice(["rua das flores", "avenida brasil", "praça 漢"]) + f", n {rng.randint(0, 40)}" + rng.choice(["", " apartamento 12", " bloco b" * 9]) + end(b)) for i, b in enumerate([1, 2, None] * 30)]
    df = spark.createDataFrame(rows, "id int, block int, t string")
    texts = {}
    for i, b, t in rows:
        texts.setdefault((b, t), i)
    expected = {}
    for ((b1, t1), i1), ((b2, t2), i2) in itertools.combinations(texts.items(), 2):
        if b1 == b2 and (ratio := difflib.SequenceMatcher(None, t1, t2, autojunk=False).ratio()) >= 0.85:
            expected[i1, i2] = ratio
    assert len(expected) > 100
    for most in (0, 29, 2048):  # by grams, either, all against all
        assert {(r.a, r.b): r.ratio for r in dedup.blocked_pairs(df, ["block"], "t", "id", 0.85, most).collect()} == expected
    made = []
    known, dedup._gram_pairs = dedup._gram_pairs, lambda *a: made.append(1) or known(*a)
    try:
        dedup.blocked_pairs(df, ["block"], "t", "id").collect()
        assert not made
    finally:
        dedup._gram_pairs = known


def test_ratios_of_many_pairs_like_difflib():
    from gavelspark.operators import matching

    r = random.Random(3)
    for letters, cells, long in [("ab", 1 << 22, 1 << 20), ("ab漢", 300, 1 << 20), ("abc", 1 << 22, 30), ("a", 1 << 22, 1 << 20)]:
        matching.CELLS, matching.LONG, known = cells, long, (matching.CELLS, matching.LONG)
        try:
            texts = ["", *("".join(r.choice(letters) for _ in range(r.randrange(15))) for _ in range(25)), "ab" * 150, "b" + "ab" * 140]
            i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
            expected = [difflib.SequenceMatcher(None, texts[x], texts[y], autojunk=False).ratio() for x, y in zip(i, j, strict=True)]
            assert matching.ratios(texts, i, j).tolist() == expected
        finally:
            matching.CELLS, matching.LONG = known
    assert matching.ratios([], np.zeros(0, int), np.zeros(0, int)).tolist() == []


def _odd_listings(spark, n=160):
    r = random.Random(11)
    columns = "id string, auctioneer_id int, title string, address string, neighborhood string, city string, state string, category string, evaluation_value double, first_auction_value double, area_total double, area_privativa double"
    number = lambda *some: r.choice([None, 0.0, float("nan"), float("inf"), -100.0, *some])
    rows = [
        (f"i{i}", r.choice([1, 2, None]), r.choice(["Casa térrea", "casa nova", "apartamento 2", "", None]), r.choice(["Rua das Flores, n. ", "R. das Flores ", "Av. Flores "]) + str(r.randrange(4)) if r.random() < 0.8 else None, r.choice(["centro", None]),
         r.choice(["Santos", "santos", "Recife", "", None]), r.choice(["SP", "sp", ""]), r.choice(["Casa", "Apartamento", None]), number(100.0, 105.0, 125.0, 400.0), number(90.0), number(50.0, 52.0), number(48.0)) for i in range(n)
    ]
    rows += [(f"e{i}", i, "casa", "", "", "", "", "Casa", 100.0, 90.0, 50.0, None) for i in range(3)]  # no address at all
    return spark.createDataFrame(rows, columns)


def test_scored_pairs_of_blocks_as_by_joins(spark):
    rows = _odd_listings(spark)
    in_blocks = sorted(tuple(x) for x in dedup.scored_pairs(rows, 0.5, 0.8).collect())
    for most, most_profiles in [(0, 32_768), (2048, 40), (2048, 0)]:  # all by joins, some by profiles, all by profiles
        assert sorted(tuple(x) for x in dedup.scored_pairs(rows, 0.5, 0.8, most, most_profiles).collect()) == in_blocks
    assert len(in_blocks) > 200 and len({x[-1] for x in in_blocks}) > 8


def test_scored_block_in_slices_of_any_size():
    profile = pa.struct({c: pa.string() for c in ("profile", "low", "high", "title", "category")} | {"n": pa.int64(), "value": pa.float64(), "area": pa.float64()})
    of = [[{"profile": f"{h}{i}", "low": str(i % 2), "high": str(i % 2), "title": f"casa {i % 3}", "category": "x", "n": i, "value": 100.0 + i, "area": None} for i in range(size)] for h, size in [("a", 9), ("c", 1), ("b", 4)]]
    heads = pa.table({"head": ["a0", "c0", "b0"], "_full": ["rua um 1", "avenida longe 9", "rua um 2"], "parts": [{"street_type": "rua", "street_name": "um", "number": None}] * 3, "of": pa.array(of, pa.list_(profile))})
    rows = lambda: [x for b in dedup._scored_block(heads, 0.5, 0.8) for x in b.to_pylist()]
    whole, known = rows(), dedup._PAIRS
    try:
        for dedup._PAIRS in (1, 7, 40):
            assert rows() == whole
    finally:
        dedup._PAIRS = known
    assert {(x["a"], x["b"]) for x in whole} == {(f"a{i}", f"a{j}") for i in range(9) for j in range(i, 9) if (i + j) % 2} | {(f"b{i}", f"b{j}") for i in range(4) for j in range(i, 4) if (i + j) % 2} | {(f"a{i}", f"b{j}") for i in range(9) for j in range(4) if (i + j) % 2}


def test_tables_of_duplicates_that_grow_with_the_data_are_not_broadcast(spark):
    rows = _odd_listings(spark, 40)
    joins = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert joins(dedup.scored_pairs(rows)) == []
    assert not any("[city#" in line or "[head#" in line for line in joins(dedup.batch_duplicates(rows.where("address <> ''"), ["city"], "address", "id")))
    assert all("_city#" in line and "_full#" not in line and "Left" in line for line in joins(dedup.scored_pairs(rows, most=0)))  # with the large blocks, which are few
