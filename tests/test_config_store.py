"""Settings that are saved, replaced and removed, by several writers at once."""

import json
from concurrent.futures import ThreadPoolExecutor

from gavelspark.sources.config_store import ConfigStore


def plain(df):
    return {r.site: json.loads(r.config.toJson()) for r in df.collect()}


def test_settings_come_back(spark, tmp_path):
    store = ConfigStore(spark, str(tmp_path / "s"))
    save = lambda *rows: store.save(spark.createDataFrame(list(rows), "site string, config string"))
    save(("a", '{"x": [1, {"y": "é"}]}'), ("b", "3"), ("c", '{"x": 5}'), (None, "1"))
    save(("b", '{"x": "text"}'))
    store.delete(spark.createDataFrame([("c",), ("never",)], "site string"))
    assert plain(store.all()) == {"a": {"x": [1, {"y": "é"}]}, "b": {"x": "text"}}
    assert [r.site for r in store.names().collect()] == ["a", "b"]
    assert plain(store.get("b")) == {"b": {"x": "text"}} and store.get("c").count() == 0 and store.get("zz").count() == 0
    assert {r.site: r.value for r in store.value("$.x").collect()} == {"a": '[1,{"y":"é"}]', "b": "text"}
    save(("c", "{}"))
    other = store.compact(str(tmp_path / "t"))
    assert plain(other.all()) == plain(store.all()) and other.history().count() == 3 and store.history().where("site = 'c'").count() == 3


def test_writers_at_once(spark, tmp_path):
    store = ConfigStore(spark, str(tmp_path / "s"))

    def write(n):
        store.save(spark.createDataFrame([(f"own{n}", str(n)), ("shared", json.dumps({"by": n, "also": n}))], "site string, config string"))

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(12)))
    held = plain(store.all())
    assert {k: v for k, v in held.items() if k != "shared"} == {f"own{n}": n for n in range(12)}
    assert held["shared"]["by"] == held["shared"]["also"] and store.history().count() == 24
