"""Stores under failure, windows that close on a stream, threads kept up to date: each against the batch result."""

import datetime as dt
import random

import pytest
from emberline.operators import folding, threads
from emberline.operators.store import Store
from emberline.streaming import threads as live
from emberline.streaming import windows
from pyspark.sql import Row
from pyspark.sql import functions as F

CLAIMS = "claim_id string, subject_id string, claim_type string, valid_from timestamp, valid_to timestamp, is_current boolean, seen_at timestamp, note string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, windows.PROVIDER)
    yield spark
    spark.conf.unset(name)


def claims(seed, n):
    r, day = random.Random(seed), dt.timedelta(days=1)
    start = dt.datetime(2001, 1, 1)
    rows = []
    for i in range(n):
        at = None if r.random() < 0.1 else start + day * r.randrange(90)
        end = at + day * r.randrange(1, 40) if at and r.random() < 0.3 else None
        kind = r.choice(["WORKS_AT", "WORKS_AT", "REPORTS_TO", "MENTIONS"])
        rows.append((f"k{i}", r.choice(["hot", "hot", "hot", "a", "b", None]), kind, at, end, r.random() < 0.9, start + day * 50, "n"))
    return rows + rows[:20]


def wanted(spark, rows):
    some = spark.createDataFrame(rows, CLAIMS).filter("subject_id IS NOT NULL")
    return sorted((r.subject_id, r.claim_type, r.claim_id, r.valid_from, str(r.valid_to), r.is_current) for r in folding.closed_windows(some).collect())


def found(store):
    return sorted((r.subject_id, r.claim_type, r.claim_id, r.valid_from, str(r.valid_to), r.is_current) for r in store.read().collect())


def feed(spark, folder, rows, parts):
    r = random.Random(9)
    rows = r.sample(rows, len(rows))
    cuts = sorted(r.sample(range(1, len(rows)), parts - 1))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], CLAIMS).coalesce(1).write.parquet(f"{folder}/{k}")


def test_stream_of_windows_equals_batch(rocks, tmp_path):
    rows = claims(1, 400)
    feed(rocks, f"{tmp_path}/in", rows, 3)
    stream = rocks.readStream.schema(CLAIMS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    where = f"{tmp_path}/windows"
    windows.keep_windows(stream, where, f"{tmp_path}/cp", buckets=2).awaitTermination()
    assert found(Store(rocks, where)) == wanted(rocks, rows)
    # nothing new: no batch, no manifest
    before = Store(rocks, where).manifest()["number"]
    windows.keep_windows(stream, where, f"{tmp_path}/cp", buckets=2).awaitTermination()
    assert Store(rocks, where).manifest()["number"] == before
    # later arrivals between known starts reopen and split; a write that fails is repeated by the next run
    more = [(f"m{i}", "hot", "WORKS_AT", dt.datetime(2001, 1, 1, 12) + dt.timedelta(days=7 * i), None, True, None, "n") for i in range(9)]
    rocks.createDataFrame(more, CLAIMS).write.parquet(f"{tmp_path}/in/more")
    publish, calls = Store._publish, []

    def dies(self, manifest):
        calls.append(1)
        if len(calls) == 2:  # the windows are published, the late ones are not
            raise OSError("killed")
        publish(self, manifest)

    with pytest.MonkeyPatch.context() as patch, pytest.raises(Exception, match="killed"):
        patch.setattr(Store, "_publish", dies)
        windows.keep_windows(stream, where, f"{tmp_path}/cp", buckets=2).awaitTermination()
    windows.keep_windows(stream, where, f"{tmp_path}/cp", buckets=2).awaitTermination()
    assert found(Store(rocks, where)) == wanted(rocks, rows + more)
    assert Store(rocks, f"{where}-late").read().count() == 0


def test_horizon_forgets_and_marks_late(rocks, tmp_path):
    day = lambda n: dt.datetime(2001, 1, 1) + dt.timedelta(days=n)
    row = lambda i, n: (i, "s", "WORKS_AT", day(n), None, True, None, "n")
    for k, rows in enumerate([[row("a", 0), row("b", 40)], [row("c", 100)], [row("d", 20), row("e", 95)]]):
        rocks.createDataFrame(rows, CLAIMS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = rocks.readStream.schema(CLAIMS).parquet(f"{tmp_path}/in/*")
        windows.keep_windows(stream, f"{tmp_path}/w", f"{tmp_path}/cp", horizon=30 * 86400, buckets=2).awaitTermination()
    got = {r.claim_id: (r.valid_to, r.is_current) for r in Store(rocks, f"{tmp_path}/w").read().collect()}
    assert got == {"a": (day(40), False), "b": (day(95), False), "e": (day(100), False), "c": (None, True)}
    assert [r.claim_id for r in Store(rocks, f"{tmp_path}/w-late").read().collect()] == ["d"]


ROWS = "id string, v int, at int"


def test_keyed_writes_touch_their_buckets_only(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/t", buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    with pytest.raises(FileNotFoundError):
        store.read()
    store.upsert(frame([(f"i{k}", k, 1) for k in range(200)]), ["id"], "at")
    first = store.manifest()
    met = store.upsert(frame([("i7", 70, 2), ("i7", 71, 3), ("i8", 0, 0)]), ["id"], "at")
    second = store.manifest()
    assert {b for b in first["parts"] if first["parts"][b] != second["parts"].get(b)} == set(met) and len(met) <= 2
    assert store.lookup(frame([("i7", 0, 0)]), ["id"]).filter("id = 'i7'").first().v == 71
    assert store.lookup(frame([("i7", 0, 0)]), ["id"]).count() < 200 == store.read().count()
    store.insert_ignore(frame([("i7", 0, 0), ("new", 5, 5), ("new", 4, 4)]), ["id"], "at")
    got = {r.id: r.v for r in store.read().collect()}
    assert got["i7"] == 71 and got["new"] == 4 and got["i8"] == 0 and len(got) == 201
    store.append(frame([("i7", 1, 1)]))
    assert store.read().filter("id = 'i7'").count() == 2
    assert store.vacuum(keep=1) > 0 and store.read().count() == 202
    store.upsert(frame([]), ["id"], "at")
    assert store.read().count() == 202


@pytest.mark.parametrize("step", ["_write", "_put", "_publish"])
def test_a_write_that_dies_leaves_the_table(spark, tmp_path, monkeypatch, step):
    store = Store(spark, f"{tmp_path}/t", buckets=4)
    rows = spark.createDataFrame([(f"i{k}", k, 1) for k in range(20)], ROWS)
    store.upsert(rows, ["id"], "at")
    whole = getattr(Store, step)

    def dies(self, *a):
        if step != "_publish":
            whole(self, *a)
        raise OSError("killed")

    with monkeypatch.context() as patch, pytest.raises(OSError, match="killed"):
        patch.setattr(Store, step, dies)
        store.upsert(rows.withColumn("v", F.lit(-1)).withColumn("at", F.lit(9)), ["id"], "at")
    assert sorted(r.v for r in store.read().collect()) == list(range(20))
    store.upsert(rows.withColumn("v", F.lit(-1)).withColumn("at", F.lit(9)), ["id"], "at")
    assert {r.v for r in store.read().collect()} == {-1}


def test_a_repeated_batch_builds_on_the_one_before(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/t", buckets=2)
    for batch, rows in [(0, [("a", 1, 1)]), (1, [("b", 2, 2)]), (1, [("b", 2, 2)]), (2, [("c", 3, 3)]), (1, [("b", 2, 2)])]:
        store.append(spark.createDataFrame(rows, ROWS), batch=batch)
    assert sorted(r.id for r in store.read().collect()) == ["a", "b"]
    assert sorted(r.id for r in store.read(before=1).collect()) == ["a"]


def messages(seed, n):
    r, start = random.Random(seed), dt.datetime(2001, 5, 1)
    rows = []
    for i in range(n):
        refs = [f"m{r.randrange(n + 20):03d}" for _ in range(r.choice([0, 0, 0, 0, 1]))]
        reply = f"m{r.randrange(n + 20):03d}" if r.random() < 0.15 else None
        date = None if r.random() < 0.1 else start + dt.timedelta(days=r.random() * 150)
        people = r.sample("abcdefg", 3)
        rows.append((f"m{i:03d}", reply, refs, people[0], people[1:], r.choice(["Deal", "RE: deal", "Fw: Plan", "Plan", "", None, f"s{i}"]), date))
    return rows + rows[:5] + [(None, None, None, "a", None, "Deal", start)]


@pytest.mark.parametrize("parts", [3])
def test_threads_of_a_stream_equal_those_of_the_whole(spark, tmp_path, parts):
    rows = messages(parts, 120)
    r = random.Random(parts)
    mixed = r.sample(rows, len(rows))
    for k in range(parts):
        spark.createDataFrame(mixed[k::parts], live.MESSAGE).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(live.MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    publish, calls = Store._publish, []

    def dies(self, manifest):
        calls.append(1)
        if len(calls) == 9:  # in the middle of the second batch
            raise OSError("killed")
        publish(self, manifest)

    run = lambda: live.keep_threads(stream, f"{tmp_path}/state", f"{tmp_path}/cp", buckets=2).awaitTermination()
    with pytest.MonkeyPatch.context() as patch, pytest.raises(Exception, match="killed"):
        patch.setattr(Store, "_publish", dies)
        run()
    run()
    state = live.Threads(spark, f"{tmp_path}/state", buckets=2)
    got = {x.message_id: x.thread_id for x in state.read().collect()}
    want = {x.message_id: x.thread_id for x in threads.build_threads(spark.createDataFrame(rows, live.MESSAGE)).collect()}
    assert got == want and 1 < len(set(want.values())) < len(want)
    assert state.tables["rejected"].read().count() == 1 and state.tables["late"].read().count() == 0


def test_late_messages_are_kept_apart(spark, tmp_path):
    day = lambda n: dt.datetime(2001, 5, 1) + dt.timedelta(days=n)
    row = lambda i, n: (i, None, None, "a", ["b"], "Deal", day(n))
    state = live.Threads(spark, f"{tmp_path}/state", delay_days=10, buckets=1)
    for batch, rows in enumerate([[row("a", 0), row("b", 40)], [row("c", 5), row("d", 33), ("e", "a", None, "x", None, "", None)]]):
        state.add(spark.createDataFrame(rows, live.MESSAGE), batch)
    assert {x.message_id: x.thread_id for x in state.read().collect()} == {"a": "a", "b": "b", "d": "b", "e": "a"}
    assert [x.message_id for x in state.tables["late"].read().collect()] == ["c"]


class Value:
    """A state in memory that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def get(self):
        return self.getValue(())

    def exists(self):
        return self.get() is not None

    def update(self, value):
        self.updateValue((), value)

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]


def test_groups_of_a_key_are_read_and_written_together():
    state = windows.Closing(None)
    state.index, state.pages = Value(), Value()
    row = lambda s, i, day, end=None: Row(subject_id=s, claim_type="WORKS_AT", claim_id=i, start=day * 86400 * 10**6, ends=end)
    arrive = lambda rows: {(r.subject_id, r.claim_id): (r.valid_to, r.is_current) for r in state.handleInputRows((1,), iter(rows), None)}
    first = arrive([row(f"s{k}", f"a{k}", 100) for k in range(50)] + [row("old", "o", -900, -800 * 86400 * 10**6)])
    second = arrive([row(f"s{k}", f"b{k}", 60) for k in range(50)])
    assert state.index.calls <= 4 and state.pages.calls == 0
    assert first["s7", "a7"] == (None, True) and first["old", "o"] == (-800 * 86400 * 10**6, True)
    assert second["s7", "b7"] == (100 * 86400 * 10**6, False)
    # more than a few of one group go into pages; the others stay, and one arrival meets its neighbours alone
    many = 3 * windows.FEW
    arrive([row("s7", f"m{k:04d}", 200 + k) for k in range(many)])
    assert len(state.pages.held) > 20 and len(state.index.held[()][4]) == 101 - 2
    state.pages.calls = 0
    assert arrive([row("s7", "m0300x", 500)]) == {("s7", "m0300x"): (501 * 86400 * 10**6, False), ("s7", "m0300"): (500 * 86400 * 10**6, False)}
    assert state.pages.calls <= 4
    assert arrive([row("old", "p", -850)])["old", "o"] == (-850 * 86400 * 10**6, False)


def test_old_states_of_windows_are_deleted(rocks, tmp_path):
    rows = claims(3, 200)
    feed(rocks, f"{tmp_path}/in", rows, 4)
    stream = rocks.readStream.schema(CLAIMS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    windows.keep_windows(stream, f"{tmp_path}/w", f"{tmp_path}/cp", buckets=2).awaitTermination()
    store = Store(rocks, f"{tmp_path}/w")
    assert found(store) == wanted(rocks, rows)
    # before, the folders and manifests of all four batches stayed
    assert len(store._numbers()) == 2 and len(list((tmp_path / "w" / "data").iterdir())) == 2
    store.settle(3)
    assert found(store) == wanted(rocks, rows) and store.read(before=3).count() > 0


def test_upsert_shuffles_the_order_once(spark):
    from emberline.operators import writes

    row = spark.createDataFrame([(1, "a", "b", 1)], "k int, x string, y string, at int")
    new = spark.createDataFrame([(1, None, "c", 2), (2, "n", "o", 5)], "k int, x string, y string, at int")
    got = writes.upsert(row, new, ["k"], "at", ("y",))
    assert sorted(tuple(r) for r in got.collect()) == [(1, None, "b", 2), (2, "n", "o", 5)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("max_by(") == 1
