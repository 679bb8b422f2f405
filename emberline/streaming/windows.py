"""Windows that close on arrival: of the claims of one subject and an exclusive type only the last is current.

Claims come in any order, and the starts of each group are state. Groups are dealt into ``PARTS`` keys of state by hash: a call of a state is a
round trip to the JVM, which costs more than the few rows of a group, so those of one key are read and written together. A group of
more than ``FEW`` starts is in pages of some weeks instead, and an arrival reads the page that it falls into and its neighbours, not the history of a hot subject. An arrival between two starts splits the window there: it ends where the next
one starts, and the one before it, open or closed, now ends where it starts. Only windows that changed are sent on.

State ends at a horizon: a start more than ``horizon`` seconds before the latest of its group is final, and all but
the last such one are forgotten. An arrival before it is late; it is sent on marked so, and changes no window.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from emberline.operators.folding import EXCLUSIVE, started
from emberline.operators.store import Store

PAGE = 28 * 86400 * 1_000_000  # microseconds
PARTS, FEW = 1 << 14, 256  # keys of state, and starts of a group that are kept beside those of others
#: Of each group of a key its name, pages and number of rows (none where it has pages), and the rows of all groups one behind the other.
INDEX = "subjects array<string>, types array<string>, numbers array<array<long>>, sizes array<int>, starts array<long>, ids array<string>, ends array<long>"
WINDOWS = "subject_id string, claim_type string, claim_id string, valid_from timestamp, valid_to timestamp, is_current boolean, late boolean"
WINDOW = Row(*[c.split()[0] for c in WINDOWS.split(", ")])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pages:
    """Sorted (start, claim_id, own end) of a group, by page; loaded when touched, written back when changed.

    ``numbers`` are its pages in ``pages``; a group without them is small, and ``rows`` are all that it has.
    """

    def __init__(self, pages, name: tuple[str, str], numbers: list[int], rows: list[tuple]):
        self.pages, self.name = pages, name
        self.held: dict[int, list[tuple]] = {}
        self.changed: set[int] = set()
        self.small = not numbers
        for row in rows:
            self.held.setdefault(row[0] // PAGE, []).append(row)
        self.numbers = list(self.held) if self.small else list(numbers)

    def page(self, number: int) -> list[tuple]:
        if number not in self.held:
            self.held[number] = list(zip(*self.pages.getValue((*self.name, number)), strict=True)) if number in self.numbers else []
        return self.held[number]

    def add(self, entry: tuple) -> bool:
        """Whether the entry was new."""
        number = entry[0] // PAGE
        rows = self.page(number)
        at = bisect_left(rows, entry[:2], key=lambda x: x[:2])
        if at < len(rows) and rows[at][:2] == entry[:2]:
            return False
        rows.insert(at, entry)
        if number not in self.numbers:
            insort(self.numbers, number)
        self.changed.add(number)
        return True

    def before(self, entry: tuple) -> tuple | None:
        number = entry[0] // PAGE
        at = bisect_left(self.page(number), entry[:2], key=lambda x: x[:2])
        if at:
            return self.page(number)[at - 1]
        k = bisect_left(self.numbers, number)
        return self.page(self.numbers[k - 1])[-1] if k else None

    def after(self, entry: tuple) -> tuple | None:
        number = entry[0] // PAGE
        rows = self.page(number)
        at = bisect_left(rows, entry[:2], key=lambda x: x[:2]) + 1
        if at < len(rows):
            return rows[at]
        k = bisect_left(self.numbers, number) + 1
        return self.page(self.numbers[k])[0] if k < len(self.numbers) else None

    def latest(self) -> int | None:
        return self.page(self.numbers[-1])[-1][0] if self.numbers else None

    def forget(self, least: int) -> None:
        """Drop what starts before ``least``, but for the last of it."""
        first = self.before((least, "", None))
        if first is None:
            return
        for number in [n for n in self.numbers if n <= first[0] // PAGE]:
            rows = [x for x in self.page(number) if x[:2] >= first[:2]]
            if len(rows) < len(self.held[number]):
                self.held[number] = rows
                self.changed.add(number)

    def save(self) -> tuple[list[int], list[tuple]]:
        """``numbers`` and ``rows`` from now on."""
        if self.small:
            rows = [r for number in self.numbers for r in self.held[number]]
            if len(rows) <= FEW:
                return [], rows
            self.changed = {number for number in self.numbers if self.held[number]}
            self.numbers = sorted(self.changed)
        for number in self.changed:
            if rows := self.held[number]:
                self.pages.updateValue((*self.name, number), _columns(rows))
            else:
                self.pages.removeKey((*self.name, number))
                self.numbers.remove(number)
        return self.numbers, []


def _columns(rows: list[tuple]) -> tuple[list, list, list]:
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


class Closing(StatefulProcessor):
    def __init__(self, horizon: int | None):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getValueState("index", INDEX)
        self.pages = handle.getMapState("pages", "subject_id string, claim_type string, number long", "starts array<long>, ids array<string>, ends array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived: dict[tuple[str, str], list[tuple]] = {}
        for r in rows:
            arrived.setdefault((r.subject_id, r.claim_type), []).append((r.start, r.claim_id, r.ends))
        subjects, types, numbers, sizes, *columns = self.index.get() or ([],) * 7
        every = zip(*columns, strict=True)
        groups = {name: (pages, list(islice(every, n))) for name, pages, n in zip(zip(subjects, types, strict=True), numbers, sizes, strict=True)}
        changed = False
        for name, some in arrived.items():
            held = Pages(self.pages, name, *groups.get(name, ([], [])))
            yield from self._closed(name, held, some)
            if held.changed:
                groups[name] = held.save()
                changed = True
        if changed:
            names = list(groups)
            whole = [r for _, kept in groups.values() for r in kept]
            self.index.update(([n[0] for n in names], [n[1] for n in names], [p for p, _ in groups.values()], [len(kept) for _, kept in groups.values()], *_columns(whole)))

    def _closed(self, name: tuple[str, str], held: Pages, some: list[tuple]) -> Iterator[Row]:
        """What the arrivals ``some`` of a group change."""
        touched, late = set(), []
        for r in sorted(some, key=lambda x: x[:2]):
            newest = held.latest()
            if self.horizon is not None and newest is not None and r[0] < newest - self.horizon * 1_000_000:
                late.append(r)
            elif held.add(r):
                touched.add(r)
        out = set(touched)
        for r in touched:
            if (one := held.before(r)) is not None:
                out.add(one)
        for start, i, end in sorted(out, key=lambda x: x[:2]):
            later = held.after((start, i, end))
            to = end if later is None else later[0] if end is None else min(end, later[0])
            yield WINDOW(*name, i, start, to, later is None, False)
        for start, i, end in late:
            yield WINDOW(*name, i, start, end, False, True)
        if self.horizon is not None and held.numbers:
            held.forget(held.latest() - self.horizon * 1_000_000)

    def close(self) -> None:
        pass


def closing_windows(claims: DataFrame, types: tuple[str, ...] = EXCLUSIVE, horizon: int | None = None) -> DataFrame:
    """The windows (WINDOWS) that each micro-batch of ``claims`` opens, splits or closes.

    ``claims``: a stream of claim_id, subject_id, claim_type, valid_from, valid_to, is_current, seen_at. Only current claims of ``types`` take
    part; one without a start starts when it was seen, one without any of the two, a subject or an id is passed over. A claim with its
    start that came before changes nothing. The session's state store must be RocksDB (``PROVIDER``).
    """
    some = started(claims, types).filter("subject_id IS NOT NULL AND claim_id IS NOT NULL AND valid_from IS NOT NULL")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    keyed = some.select("subject_id", "claim_type", F.col("claim_id").cast("string").alias("claim_id"), micros("valid_from").alias("start"), micros("valid_to").alias("ends"))
    plain = WINDOWS.replace("timestamp", "long")
    part = F.pmod(F.xxhash64("subject_id", "claim_type"), F.lit(PARTS)).cast("int")
    out = keyed.withColumn("part", part).groupBy("part").transformWithState(Closing(horizon), plain, "Update", "None")
    back = lambda c: F.timestamp_micros(c).alias(c)
    return out.select("subject_id", "claim_type", "claim_id", back("valid_from"), back("valid_to"), "is_current", "late")


def keep_windows(claims: DataFrame, path: str, checkpoint: str, types: tuple[str, ...] = EXCLUSIVE, horizon: int | None = None, buckets: int = 16) -> StreamingQuery:
    """Keep the table ``path`` of windows up to date with what is new in ``claims``, then stop; late claims go to ``path``-late.

    A micro-batch writes the buckets of the claims that changed. One that is repeated after a failure leaves the same table; states of the
    table before the last batch that ended are deleted.
    """

    def each(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        Store(rows.sparkSession, path, buckets).settle(batch)
        windows = rows.filter("NOT late").drop("late").withColumn("batch", F.lit(batch).cast("long"))
        Store(rows.sparkSession, path, buckets).upsert(windows, ["claim_id", "valid_from"], "batch", batch=batch)
        Store(rows.sparkSession, f"{path}-late", buckets).append(rows.filter("late").drop("late"), batch=batch)
        rows.unpersist()

    stream = closing_windows(claims, types, horizon)
    return stream.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
