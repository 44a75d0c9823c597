import glob
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from pagewright.llm import sharding
from pagewright.llm.sharding import Store

SCHEMA = "doc_id long, text string, _arrival int"


def rows_of(n, seed):
    r = random.Random(seed)
    return [(r.choice([None, *range(50)]), r.choice([None, "", "x" * r.randrange(1, 3000), "é"]), i) for i in range(n)]


def same(df, rows):
    return sorted(map(str, (tuple(x) for x in df.collect()))) == sorted(map(str, rows))


def test_tiers_and_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "SMALLEST_TIER", 1000)
    store = Store(spark, f"file://{tmp_path}/store", target=20_000)
    assert store.manifest()["version"] == 0 and store.compact()["version"] == 0
    every = []
    for k in range(6):
        rows = rows_of(40, k)
        every += rows
        store.append(spark.createDataFrame(rows, SCHEMA).repartition(3))
        store.compact()
        assert same(store.rows(), every)
        tiers = [store.tier(r) for r in store.manifest()["runs"]]
        assert all(tiers.count(t) < store.fanout for t in tiers)
    more = rows_of(200, 99)
    before = store.manifest()["version"]
    store.append(spark.createDataFrame(more, SCHEMA), arrival=sharding.F.col("_arrival") % 5)
    assert same(store.rows(before), every)
    every += more
    last = store.compact()
    assert same(store.rows(), every) and last["version"] > before
    assert {r["path"] for r in store.shards().collect()} == {r["path"] for r in last["runs"]}
    store.vacuum()
    assert same(store.rows(), every)
    kept = sum(r["files"] for r in last["runs"])
    assert len(glob.glob(f"{tmp_path}/store/runs/**/*.parquet", recursive=True)) == kept


def test_writers_race_and_bad_columns(spark, tmp_path):
    a, b = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame(rows_of(5, 1), SCHEMA)
    a.append(df)
    stale = a.manifest()
    b.append(df)
    with pytest.raises(sharding.Conflict):
        a._commit(stale | {"version": stale["version"] + 1})
    a.append(df.limit(0))
    assert a.rows().count() == 10 and b.manifest()["version"] == 3
    with pytest.raises(ValueError):
        a.append(df.drop("text"))


def test_one_of_two_writers_wins(spark, tmp_path):
    """Commits of the same version at the same time: exactly one succeeds, and no append is lost."""
    stores = [Store(spark, f"file://{tmp_path}/s") for _ in range(4)]
    df = spark.createDataFrame(rows_of(3, 2), SCHEMA)
    stores[0].append(df)
    runs = stores[0].manifest()

    def commit(store, version):
        try:
            store._commit(runs | {"version": version})
            return 1
        except sharding.Conflict:
            return 0

    with ThreadPoolExecutor(4) as pool:
        for version in range(2, 12):
            assert sum(pool.map(lambda s: commit(s, version), stores)) == 1
        list(pool.map(lambda s: s.append(df), stores))
    assert stores[0].manifest()["version"] == 15 and stores[1].rows().count() == 15
    assert not glob.glob(f"{tmp_path}/s/_manifest/draft*")


def test_vacuum_spares_uncommitted_runs(spark, tmp_path):
    """A run written but not committed outlives another's vacuum; what a crash left goes once it is old."""
    a, b = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    rows = rows_of(30, 4) + [(1, "y" * 3_000_000, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for _ in range(4):
        a.append(df)
    flying = b._write(df, None)
    arrivals = b._write(df, sharding.F.col("_arrival") % 3)
    a.compact()
    a.vacuum()
    b._add(flying + arrivals, df.schema.json())
    assert same(a.rows(), rows * 6)
    debris = b._write(df, None)
    a.vacuum()
    assert glob.glob(debris[0]["path"].removeprefix("file://"))
    a.vacuum(orphan_seconds=-1)
    assert not glob.glob(debris[0]["path"].removeprefix("file://")) and same(b.rows(), rows * 6)


def test_another_file_system(spark, tmp_path):
    """Where a store is no local disk, a rename that does not overwrite publishes a version."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shards.link./s", f"file://{tmp_path}")
    store = Store(spark, "viewfs://shards/s/store")
    rows = rows_of(20, 7)
    store.append(spark.createDataFrame(rows, SCHEMA))
    with pytest.raises(sharding.Conflict):
        store._commit(store.manifest())
    store.append(spark.createDataFrame(rows, SCHEMA))
    assert store.manifest()["version"] == 2 and same(store.rows(), rows * 2)
