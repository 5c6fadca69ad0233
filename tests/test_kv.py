import pytest

from tessera.operators import dml
from tessera.operators.kv import KeyValueStore
from tessera.plans.statements import Engine
from tessera.sources.catalog import Catalog, CatalogError, Field


def test_latest_wins(spark, tmp_path):
    kv = KeyValueStore(spark, f"file://{tmp_path}/kv")
    rows = lambda *r: spark.createDataFrame(list(r), "key string, value string")
    kv.put(rows(("a", "1"), ("b", "2"), ("c", "3")))
    old = kv.pin()
    kv.put(rows(("a", "9")))
    kv.remove(rows(("b", "")))
    assert kv.get("a") == "9" and kv.get("b") is None and kv.get("b", old) == "2"
    assert sorted(map(tuple, kv.scan().collect())) == [("a", "9"), ("c", "3")]
    with pytest.raises(CatalogError):
        kv.put(rows(("z", "0")), old)
    kv.compact()
    assert sorted(map(tuple, kv.scan().collect())) == [("a", "9"), ("c", "3")]
    kv.put(rows(("a", "10")))
    assert kv.get("a") == "10" and kv.get("a", old) == "1"


def test_long_keys_and_values(spark, tmp_path):
    at = f"file://{tmp_path}/kv"
    rows = lambda *r: spark.createDataFrame(list(r), "key string, value string")
    a, b, value = "k" * 5000 + "a", "k" * 5000 + "b", "é" * 70_000 + "end"
    # A store made with bounded fields takes long strings too.
    Catalog(spark, at).create("old", [Field("key", "text", 4096), Field("value", "text", 4096, True), Field("seq", "int"), Field("gone", "int")])
    for kv in (KeyValueStore(spark, at), KeyValueStore(spark, at, "old")):
        kv.put(rows((a, value), (b, "2")))
        kv.put(rows((b, "3")))
        kv.compact()
        assert kv.get(a) == value and kv.get(b) == "3" and kv.get("k" * 4096) is None
        kv.remove(rows((a, "")))
        assert [tuple(r) for r in kv.scan().collect()] == [(b, "3")]


def test_compaction_keeps_rows(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    for s in ("create table t(id int)", "create index i on t(id)", *(f"insert into t values ({k})" for k in range(4))):
        assert e.execute(s).ok
    assert len(e.version("t").files) == 4
    dml.compact(e.catalog, "t", 1)
    assert len(e.version("t").files) == 1
    assert sorted(e.execute("select id from t").text().split()[1:]) == ["0", "1", "2", "3"]
