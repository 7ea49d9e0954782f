import pytest
from pyspark.sql import functions as F

from tallymart.sources.store import NULL_CHUNK, Conflict, Store, changed_chunks, merge_dimension, merge_fact

FACT = "id int, order_date date, x int"
FIRST = [(1, None, 1), (2, None, 2), (3, "2024-01-02", 3), (4, "2024-02-05", 4)]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def facts(store, **options):
    return sorted((r.id, str(r.order_date), r.x) for r in store.read("fact", **options).collect())


def folders(store):
    return {f for t in store.tables() for f in store._names(f"/{t}")}


@pytest.mark.parametrize("chunk", ["day", "week", "month"])
def test_merge_equals_a_merge_by_hand(store, rows, chunk):
    held, last = {}, 0
    for data in (FIRST, [(9, None, 9), (1, "2024-01-02", 10)], [(2, "2024-02-05", 5), (9, "2024-02-06", 1)], [(4, None, 8)], []):
        with store.transaction() as change:
            merge_fact(change, "fact", rows(FACT, *data), ["id"], chunk=chunk)
        held.update({i: (i, str(d), x) for i, d, x in data})
        assert facts(store) == sorted(held.values())
        assert store.version() >= last
        last = store.version()
    assert facts(store, version=1) == [(i, str(d), x) for i, d, x in FIRST]


def test_only_touched_chunks_are_written(store, rows):
    with store.transaction() as change:
        merge_fact(change, "fact", rows(FACT, *FIRST), ["id"], chunk="month")
    with store.transaction() as change:
        assert sorted(merge_fact(change, "fact", rows(FACT, (3, "2024-03-03", 7)), ["id"], chunk="month")) == ["2024-01-01", "2024-03-01"]
    one, two = (store.manifest(v)["tables"]["fact"] for v in (1, 2))
    assert changed_chunks(one, two) == ["2024-01-01", "2024-03-01"] and "2024-01-01" not in two["chunks"]
    assert one["chunks"][NULL_CHUNK] == two["chunks"][NULL_CHUNK] and changed_chunks(None, one) == sorted(one["chunks"])
    assert facts(store, chunks=["2024-03-01", NULL_CHUNK]) == [(1, "None", 1), (2, "None", 2), (3, "2024-03-03", 7)]


def test_a_writer_lost_before_publishing_changes_nothing(store, rows):
    with store.transaction() as change:
        merge_fact(change, "fact", rows(FACT, *FIRST), ["id"])
        merge_dimension(change, "dim", rows("k int, v int", (1, 1)), "k")
    before = facts(store), folders(store)
    lost = store.transaction().__enter__()  # its driver dies here
    merge_fact(lost, "fact", rows(FACT, (1, None, 99)), ["id"])
    assert facts(store) == before[0] and store.version() == 1
    with pytest.raises(RuntimeError, match="halfway"), store.transaction() as change:  # an error in the block
        merge_fact(change, "fact", rows(FACT, (1, None, 98)), ["id"])
        raise RuntimeError("halfway")
    assert facts(store) == before[0] and folders(store) > before[1]
    with store.transaction() as change:
        merge_fact(change, "fact", rows(FACT, (1, None, 50)), ["id"])
    assert store.vacuum(keep=2, running=(f"{lost.name}-1",)) == 0 and store.vacuum(keep=2) == 1
    assert (1, "None", 50) in facts(store) and facts(store, version=1) == before[0]


def test_of_two_writers_one_fails(store, rows):
    with store.transaction() as change:
        merge_fact(change, "fact", rows(FACT, *FIRST), ["id"])
    with pytest.raises(Conflict), store.transaction() as slow:
        merge_fact(slow, "fact", rows(FACT, (1, None, 7)), ["id"])
        with store.transaction() as fast:
            merge_fact(fast, "fact", rows(FACT, (2, None, 8)), ["id"])
    assert [x for i, _, x in facts(store) if i in (1, 2)] == [1, 8] and store.version() == 2
    assert len(folders(store)) == 2  # what the slow one wrote is gone


def test_dimensions_in_buckets(store, rows):
    for buckets, table in ((1, "one"), (8, "eight")):
        for data in ([(k, k) for k in range(100)], [(5, -5), (5, -6), (200, 1)]):
            with store.transaction() as change:
                written = merge_dimension(change, table, rows("k int, v int", *data), "k", order_by=-F.col("v"), buckets=buckets)
        assert {r.k: r.v for r in store.read(table).collect()} == {k: k for k in range(100)} | {5: -6, 200: 1}
        assert len(written) == (1 if buckets == 1 else len(set(written))) and len(written) <= 2


def test_appending_and_compacting_under_a_reader(store, rows):
    for i in range(5):
        with store.transaction() as change:
            change.append("fact", rows(FACT, (i, "2024-01-01", i), (10 + i, None, i)), "order_date")
    reader, want = store.read("fact"), facts(store)
    with store.transaction() as change:
        assert sorted(change.compact("fact", folders=4)) == sorted(["2024-01-01", NULL_CHUNK]) and change.compact("fact", folders=4) == []
    assert facts(store) == want and all(len(w) == 1 for w in store.manifest()["tables"]["fact"]["chunks"].values())
    assert reader.count() == 10  # its folders are still there
    assert store.vacuum(keep=1) == 5 and facts(store) == want


def test_nothing_to_change_publishes_nothing(store, rows):
    with store.transaction():
        pass
    assert store.version() == 0 and store.tables() == []
    with store.transaction() as change:
        change.replace("empty", rows(FACT), "order_date")
    assert store.read("empty").count() == 0 and store.read("empty").columns == ["id", "order_date", "x"]
    with pytest.raises(ValueError), store.transaction() as change:
        change.append("empty", rows("id int", (1,)), "order_date")


def test_a_view_follows_the_changed_chunks(store, rows):
    from tallymart.plans.views import refresh_view

    def build(facts):
        return facts.join(store.read("names"), "id", "left").groupBy("order_date_month", "name").agg(F.count("*").alias("n"), F.countDistinct("x").alias("kinds"))

    def refresh():
        done = sorted(refresh_view(store, "view", "fact", build, ("names",)))
        key = lambda r: tuple((v is not None, v) for v in r)
        columns = store.read("view").columns
        assert sorted(store.read("view").collect(), key=key) == sorted(build(store.read("fact")).select(*columns).collect(), key=key)
        return done

    with store.transaction() as change:
        change.replace("names", rows("id int, name string", (1, "a"), (2, "a"), (3, "b")))
        merge_fact(change, "fact", rows(FACT, *FIRST), ["id"], chunk="month")
    assert len(refresh()) == 3 and refresh() == []
    with store.transaction() as change:  # one row changes in place, one leaves the rows without a date
        merge_fact(change, "fact", rows(FACT, (4, "2024-02-05", 9), (1, "2024-02-07", 9)), ["id"], chunk="month")
    assert refresh() == sorted(["2024-02-01", NULL_CHUNK])
    with store.transaction() as change:  # the only row of January goes
        change.replace_chunks("fact", change.read("fact", ["2024-01-01"]).where("false"), "order_date_month", ["2024-01-01"])
    assert refresh() == ["2024-01-01"]
    with store.transaction() as change:
        merge_dimension(change, "names", rows("id int, name string", (2, "c")), "id")
    assert len(refresh()) == 2  # all that are left, as the names may be anywhere


def test_a_merge_writes_only_what_it_changes(store, rows):
    """Chunks that merely get new rows keep their folders, and new rows are written once; a chunk in many folders becomes one."""
    with store.transaction() as change:
        merge_fact(change, "fact", rows(FACT, *FIRST), ["id"], chunk="month")
    first = store.manifest()["tables"]["fact"]["chunks"]
    with store.transaction() as change:
        assert merge_fact(change, "fact", rows(FACT, (1, None, 7), (5, "2024-01-05", 5)), ["id"], chunk="month") == ["2024-01-01", NULL_CHUNK]
    then = store.manifest()["tables"]["fact"]["chunks"]
    assert then["2024-01-01"][:1] == first["2024-01-01"] and len(then["2024-01-01"]) == 2  # its stored rows are not written again
    assert len(then[NULL_CHUNK]) == 1 and then[NULL_CHUNK] != first[NULL_CHUNK] and then["2024-02-01"] == first["2024-02-01"]
    written = store.spark.read.parquet(f"{store.root}/fact/_w={then[NULL_CHUNK][0]}")
    assert sorted(r.id for r in written.collect()) == [1, 2, 5]  # the new rows and what is left beside a replaced one
    for i in range(10, 18):
        with store.transaction() as change:
            merge_fact(change, "fact", rows(FACT, (i, "2024-01-06", i)), ["id"], chunk="month")
    assert len(store.manifest()["tables"]["fact"]["chunks"]["2024-01-01"]) <= 8
    assert facts(store) == sorted([(1, "None", 7), (2, "None", 2), (3, "2024-01-02", 3), (4, "2024-02-05", 4), (5, "2024-01-05", 5), *((i, "2024-01-06", i) for i in range(10, 18))])
