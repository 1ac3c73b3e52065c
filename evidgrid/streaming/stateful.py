"""Streams with state of their own: newest row per key, ordered run steps, exact corroboration.

Newest rows and run steps use ``transformWithState``, corroboration ``dropDuplicates``. Each emits a row
whenever the state of a key changes, and a matching batch function reads the final state from what was
written: a later newest row replaces earlier ones, witnesses are counted. State lives in the store of the
stream, so a lost executor costs one batch.

What a key receives is reduced inside the tasks first (see ``reduced``), so a heavily repeated key sends
one row per Arrow batch to its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from evidgrid import lexicon as lx
from evidgrid.functions.text import behavior_keys, fingerprint_tokens
from evidgrid.lexicon import DEFAULT_LEXICON, Lexicon
from evidgrid.operators.evidence import corroboration_keys

STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
#: Several states per key need a store with column families.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts that the sessions of one corroboration key belong to.
PARTS = 16


def column_store(spark: SparkSession) -> None:
    """Let streams that start from now on keep several states per key."""
    spark.conf.set(STORE_CONF, STORE)


def reduced(rows: DataFrame, choose: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Rows that ``choose`` keeps of every Arrow batch, before anything is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = choose(batch.to_pandas()).index.to_numpy()
            yield batch.take(pa.array(sorted(kept)))

    return rows.mapInArrow(run, rows.schema)


# --- newest row per key -----------------------------------------------------------------------------

COPY_KEY = ["session_key", "content_sha256"]
#: Parts that the keys are dealt to.
COPY_PARTS = 1_024


def latest_rows(events: DataFrame, keep: int | None = None) -> DataFrame:
    """A row (session_key, content_sha256, ts, event_id) whenever a key gets a newer event.

    Whenever an event arrives, it replaces an older one of its key, however far apart they are; on
    equal times the smaller event id stays, as in ``dedup_latest``. ``keep``: seconds without a change
    after which a key is forgotten (processing time); None keeps it for ever.
    """
    column_store(events.sparkSession)
    lasting = None if keep is None else keep * 1000

    class Latest(StatefulProcessor):
        def init(self, handle) -> None:
            self.latest = handle.getMapState(
                "latest", "session_key string, content_sha256 string", "at bigint, event_id string", lasting
            )

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            arrived: dict = {}
            for row in rows:
                copy, found = (row.session_key, row.content_sha256), (-row.at, row.event_id)
                arrived[copy] = min(found, arrived.get(copy, found))
            for copy, (age, event) in arrived.items():
                known = self.latest.getValue(copy)
                if known is None or (age, event) < (-known[0], known[1]):
                    self.latest.updateValue(copy, (-age, event))
                    yield Row(session_key=copy[0], content_sha256=copy[1], at=-age, event_id=event)

        def close(self) -> None:
            pass

    def newest(batch: pd.DataFrame) -> pd.DataFrame:
        ordered = batch.sort_values(["at", "event_id"], ascending=[False, True], kind="stable")
        return ordered.drop_duplicates(COPY_KEY)

    narrow = events.select(
        F.coalesce("session_id", F.lit("")).alias("session_key"),
        "content_sha256",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "event_id",
    ).where("at IS NOT NULL AND content_sha256 IS NOT NULL")
    # A key of the stream costs as much as two calls to its state; a part has many keys of copies.
    part = F.pmod(F.xxhash64(*COPY_KEY), F.lit(COPY_PARTS)).cast("int").alias("part")
    changes = (
        reduced(narrow, newest)
        .select(part, "*")
        .groupBy("part")
        .transformWithState(Latest(), narrow.schema, "Append", "ProcessingTime" if keep else "None")
    )
    return changes.select(*COPY_KEY, F.timestamp_micros("at").alias("ts"), "event_id")


def newest_of(changes: DataFrame) -> DataFrame:
    """The final row of every key among the written rows of ``latest_rows``."""
    first = F.min(F.struct((-F.unix_micros("ts")).alias("age"), "event_id"))
    return changes.groupBy(*COPY_KEY).agg(first.alias("f")).select(
        *COPY_KEY, F.timestamp_micros(-F.col("f.age")).alias("ts"), "f.event_id"
    )


# --- steps of runs ----------------------------------------------------------------------------------

#: Parts that runs are dealt to; the entries of a part wait together.
RUN_PARTS = 1_024
#: Entries that are gathered in a task before they are packed by part, and the most in one pack.
GATHERED, PACKED = 131_072, 8_192
STEP_SCHEMA = "run_id string, ts timestamp, event_id bigint, from_state string, state string, legal boolean"


class Packs:
    """Rows of one part as Arrow streams of their own: one state value, or one row, for many entries."""

    run, at = ("run_id", pa.string()), ("at", pa.int64())
    entry = pa.schema([run, at, ("event_id", pa.int64()), ("state", pa.string())])
    last = pa.schema([run, at, ("state", pa.string())])
    step = pa.schema(
        [run, at, ("event_id", pa.int64()), ("from_state", pa.string()), ("state", pa.string()), ("legal", pa.bool_())]
    )
    given = pa.schema([run, ("ts", pa.timestamp("us", tz="UTC")), *list(step)[2:]])


def packing() -> tuple[Callable, ...]:
    """Functions on packs. They are made here, so they travel to the tasks and need no installed package."""
    entry, given, gathered, packed = Packs.entry, Packs.given, GATHERED, PACKED

    def rows_of(pack: bytes) -> list[tuple]:
        table = pa.ipc.open_stream(pack).read_all()
        return list(zip(*(column.to_pylist() for column in table.columns)))

    def packs(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        """(latest time, pack) of pieces of a table."""
        for piece in table.combine_chunks().to_batches(max_chunksize=packed):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema) as writer:
                writer.write_batch(piece)
            yield max(piece.column("at").to_pylist()), sink.getvalue().to_pybytes()

    def packs_of(rows: list[tuple], schema: pa.Schema) -> list[tuple[int, bytes]]:
        columns = [pa.array(list(c), field.type) for c, field in zip(zip(*rows), schema)]
        return list(packs(pa.table(columns, schema=schema))) if rows else []

    def pack_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (part, run_id, at, event_id, state) as rows (part, at, pack)."""

        def by_part(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by("part")
            parts = table["part"].to_pylist()
            starts = [i for i, part in enumerate(parts) if i == 0 or part != parts[i - 1]]
            rows = table.select(entry.names).cast(entry)
            out = [
                (parts[start], *pack)
                for start, end in zip(starts, [*starts[1:], len(parts)])
                for pack in packs(rows.slice(start, end - start))
            ]
            names, kinds = ("part", "at", "pack"), (pa.int32(), pa.int64(), pa.binary())
            arrays = [pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=list(names))

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= gathered:
                yield by_part(held)
                held, size = [], 0
        if size:
            yield by_part(held)

    def unpack_steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (pack) as the steps in them."""
        for batch in batches:
            for pack in batch.column("pack").to_pylist():
                for rows in pa.ipc.open_stream(pack):
                    times = rows.column("at").cast(pa.timestamp("us")).cast(given.field("ts").type)
                    yield pa.RecordBatch.from_arrays([rows.column(0), times, *rows.columns[2:]], schema=given)

    return pack_parts, unpack_steps, packs_of, rows_of


def run_steps(
    log: DataFrame,
    transitions: Iterable[tuple[str, str]] | None = None,
    initial: str = "planned",
    delay: str = "1 hour",
    finished: Iterable[str] = (),
    keep: int = 86_400,
    parts: int = RUN_PARTS,
) -> DataFrame:
    """Every entry of a run log in the order of its time, with the state before it and whether the
    step is allowed: run_id, ts, event_id, from_state, state, legal.

    ``log``: run_id, ts, event_id, state, in any order of arrival. Entries wait in the state until the
    watermark (``delay`` behind the latest time) has passed them; one that comes after a later entry of its
    run was given out is dropped, and so is one that the watermark has passed if nothing is known of its run.
    A run whose last state is in ``finished`` ends ``keep`` seconds after it: its state is forgotten then, and
    an entry with a later time starts a new run.

    A call to the state costs far more than an entry. So runs are dealt to ``parts``, whose entries travel,
    wait and are given out in packs; a part must hold no more runs than a task can list.
    """
    column_store(log.sparkSession)
    legal, ends = set(transitions or lx.RUN_TRANSITIONS), set(finished)
    pack_parts, unpack_steps, packs_of, rows_of = packing()
    entry, ended, step = Packs.entry, Packs.last, Packs.step

    class Steps(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.last = handle.getListState("last", "at bigint, pack binary")
            self.waiting = handle.getListState("waiting", "at bigint, pack binary")

        def known(self) -> dict:
            return {run: (at, state) for row in self.last.get() for run, at, state in rows_of(row[1])}

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            fresh, first, known = [], [], None
            for row in rows:
                arrived, pack = rows_of(row.pack), [(row.at, row.pack)]
                earliest = min(found[1] for found in arrived)
                if 0 < passed and earliest <= passed:
                    known = self.known() if known is None else known
                    arrived = [
                        found for found in arrived
                        if found[1] > passed or (found[0] in known and found[1] >= known[found[0]][0])
                    ]
                    pack = packs_of(arrived, entry)
                    earliest = min((found[1] for found in arrived), default=None)
                if arrived:
                    fresh += pack
                    first.append(earliest)
            if fresh:
                self.waiting.appendList(fresh)
                self.handle.registerTimer(-(-min(first) // 1000))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            held = sorted(found for row in self.waiting.get() for found in rows_of(row[1]))
            known = self.known()
            later, steps = [], []
            for run, when, number, now in held:
                if when > passed:
                    later.append((run, when, number, now))
                    continue
                at, state = known.get(run, (None, None))
                if at is not None and when < at:
                    continue
                if state in ends and when - at > keep * 1_000_000:
                    state = None
                right = now == initial if state is None else (state, now) in legal
                steps.append((run, when, number, state, now, right))
                known[run] = (when, now)
            if len(later) < len(held):
                self.waiting.clear()
                if later:
                    self.waiting.put(packs_of(later, entry))
            waits = {found[0] for found in later}
            times = [-(-found[1] // 1000) for found in later]
            over = {run: at // 1000 + keep * 1000 for run, (at, state) in known.items() if state in ends and run not in waits}
            gone = [run for run, end in over.items() if end * 1000 <= passed]
            for run in gone:
                del known[run]
            if steps or gone:
                self.last.clear()
                if known:
                    self.last.put(packs_of([(run, *at) for run, at in known.items()], ended))
            times += [end for run, end in over.items() if run in known]
            if times:
                self.handle.registerTimer(min(times))
            return iter([Row(pack=pack) for _, pack in packs_of(steps, step)])

        def close(self) -> None:
            pass

    run = F.col("run_id").cast("string")
    entries = (
        log.where("run_id IS NOT NULL AND ts IS NOT NULL")
        .select(
            F.pmod(F.xxhash64(run), F.lit(parts)).cast("int").alias("part"),
            run.alias("run_id"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
            F.col("event_id").cast("bigint").alias("event_id"),
            "state",
        )
        .mapInArrow(pack_parts, "part int, at bigint, pack binary")
        # The latest entry of a pack moves the watermark.
        .withColumn("ts", F.timestamp_micros("at"))
        .withWatermark("ts", delay)
    )
    steps = entries.groupBy("part").transformWithState(Steps(), "pack binary", "Append", "EventTime")
    return steps.mapInArrow(unpack_steps, STEP_SCHEMA)


# --- corroboration ----------------------------------------------------------------------------------

WITNESS_KEY = ["kind", "key", "session"]


def session_counts(
    events: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, parts: int = PARTS
) -> DataFrame:
    """A row (kind, key, part, session) whenever a corroboration key is seen in a further session.

    Keys are the fingerprint of a text and every combination of three of its anchors, as in
    ``corroborate``; all events without a session are one. ``events``: session_id, text. What is known
    are the pairs of key and session, dealt to the tasks by both, so a key with very many sessions is
    not one task's. ``part``: one of ``parts`` that the session belongs to, for readers that count a key
    in parts.
    """
    column_store(events.sparkSession)

    def distinct(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.drop_duplicates()

    def pair(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    seen = events.select(
        F.coalesce("session_id", F.lit("")).alias("session"),
        fingerprint_tokens("text", lexicon).alias("tokens"),
    ).select("session", *corroboration_keys("tokens", lexicon))
    both = F.array(pair("fingerprint", F.col("fingerprint_key")), pair("anchors", F.col("anchor_set")))
    # Equal anchor sets of a session are expanded once per batch, whatever their fingerprints.
    few = reduced(seen.select("session", F.inline(both)).where("key IS NOT NULL"), distinct)
    expanded = F.when(F.col("kind") == "anchors", behavior_keys(F.split("key", " "), lexicon)).otherwise(F.array("key"))
    rows = reduced(few.select("kind", F.explode(expanded).alias("key"), "session"), distinct)
    # Almost every text has a fingerprint of its own: a call from Python for each would be most of the work.
    part = F.pmod(F.xxhash64("session"), F.lit(parts)).cast("int").alias("part")
    return rows.dropDuplicates(WITNESS_KEY).select("kind", "key", part, "session")


def witness_totals(changes: DataFrame) -> DataFrame:
    """(kind, key, witnesses) from the written rows of ``session_counts``."""
    return changes.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("witnesses"))


# --- landing ----------------------------------------------------------------------------------------


IDLE_CONF = "spark.sql.streaming.noDataMicroBatches.enabled"


def land(rows: DataFrame, path: str, checkpoint: str, idle: bool = True) -> DataFrame:
    """Run a stream over all that has arrived, append it to Parquet exactly once, and read that.

    ``idle``: go on with batches without data until the watermark has closed what it can. A stream with
    states that expire by the clock (``keep`` of ``latest_rows``) would never end so: it needs False.
    """
    spark = rows.sparkSession
    before = spark.conf.get(IDLE_CONF, "true")
    spark.conf.set(IDLE_CONF, str(idle).lower())
    try:
        query = (
            rows.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(IDLE_CONF, before)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)
