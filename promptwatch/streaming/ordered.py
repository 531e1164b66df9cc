"""Keyed folds over a stream in the order of event time, whatever order rows arrive in.

A row waits until the watermark has passed it; a timer then releases all that are due, in (time, id)
order, to the step function that the batch fold uses. So a stream gives what the batch gives, however its rows are
dealt to triggers, as long as they arrive within the watermark's delay; rows behind it are dropped by the engine and can
be kept by :func:`promptwatch.streaming.run.split_late`. An answer comes when the watermark passes the row: the delay
is the price of the right order, and a source that falls silent needs a heartbeat row to bring its last answers.

Keys share ``BUCKETS`` groups by their hash, and a group's state is a few tables in Arrow form: chunks of waiting rows with
their time spans, and the values or members of its keys. A call to the store then moves a table, not a row or a
key's value, so the cost of a trigger grows with its rows and the groups that they name. A state that has outlived its
lifetime has no effect; it goes when its group is next written, or by a timer when all of the group's have.
A group holds the rows of one delay and one trigger, never its past.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The engine's store for state variables, lists, maps and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups that keys are dealt to, and the column that names a row's group.
BUCKETS, BUCKET = 1024, "_bucket"
#: Rows of an output frame, at most.
OUT_ROWS = 50_000


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


def codes(table: pa.Table, names: list[str]) -> np.ndarray:
    """Equal numbers for rows that are equal in these columns; null equals null."""
    out = np.zeros(table.num_rows, np.int64)
    for n in names:
        column = table.column(n).combine_chunks().dictionary_encode(null_encoding="encode")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        own = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.unique(out * (len(column.dictionary) + 1) + own, return_inverse=True)[1]
    return out


class Lifetime:
    """A state variable: its columns, and when a value of it has no effect any more."""

    def __init__(self, columns: str, until_us: Callable[[tuple], int]):
        self.columns, self.until_us = columns, until_us


class OrderedProcessor(StatefulProcessor):
    """Waiting rows of a group of keys; :meth:`release` gets those that are due, in order within each key."""

    #: Name of an output column with the rows' event time, for an operator that follows.
    event_time: str | None = None

    def __init__(self, schema: pa.Schema, keys: list[str], ts: str, order: str, kept: list[str], outputs: dict[str, pa.DataType]):
        self.schema, self.keys, self.ts, self.order, self.kept, self.outputs = schema, keys, ts, order, kept, outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "low bigint, high bigint, rows binary")
        self.seen: tuple[int, set] = (-1, set())

    def chunk(self, rows: pa.Table) -> tuple[int, int, bytes]:
        t = rows.column(self.ts).to_numpy()
        return int(t.min()), int(t.max()), packed(rows)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        chunks = [self.chunk(pa.Table.from_pandas(pdf[self.schema.names], self.schema, preserve_index=False, safe=False)) for pdf in rows if len(pdf)]
        if chunks:
            self.waiting.appendList(chunks)
            self.wake(min(c[0] for c in chunks))
        return iter(())

    def wake(self, us: int) -> None:
        """A timer for when the watermark has passed this time."""
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if self.seen[0] != now:
            self.seen = (now, set())
        if key in self.seen[1]:
            return  # another timer of this group has done all that the watermark allows
        self.seen[1].add(key)
        due, rest, cut = [], [], False
        for low, high, rows in self.waiting.get():
            if low >= now:
                rest.append((low, high, bytes(rows)))
                continue
            table = unpacked(rows)
            cut = True
            if high >= now:
                passed = table.column(self.ts).to_numpy() < now
                rest.append(self.chunk(table.filter(pa.array(~passed))))
                table = table.filter(pa.array(passed))
            due.append(table)
        if cut:
            if rest:
                self.waiting.put(rest)
                self.wake(min(r[0] for r in rest))
            else:
                self.waiting.clear()
            yield from self.put_out(pa.concat_tables(due))
        else:
            self.forget(now)

    def put_out(self, due: pa.Table) -> Iterator[pd.DataFrame]:
        group = codes(due, self.keys)
        t = due.column(self.ts).to_numpy()
        order = due.column(self.order).combine_chunks().dictionary_encode(null_encoding="encode")
        order = order.combine_chunks() if isinstance(order, pa.ChunkedArray) else order
        place = np.empty(len(order.dictionary), np.int64)
        place[np.argsort(np.array(order.dictionary.to_pylist(), object), kind="stable")] = np.arange(len(place))
        due = due.take(pa.array(np.lexsort((place[order.indices.to_numpy()], t, group))))
        group = np.sort(group)
        columns = {n: due.column(n) for n in self.kept} | self.release(due, group)
        for at in range(0, due.num_rows, OUT_ROWS):
            out = pd.DataFrame({n: pd.Series(c[at : at + OUT_ROWS].to_pylist(), dtype="object") for n, c in columns.items()})
            if self.event_time:
                out[self.event_time] = pd.to_datetime(due.column(self.ts)[at : at + OUT_ROWS].to_numpy(), unit="us", utc=True)
            yield out

    def release(self, due: pa.Table, group: np.ndarray) -> dict[str, pa.Array]:
        """Output columns of rows in order of (key, time, id), ``group`` numbers their keys; moves the state on."""
        raise NotImplementedError

    def forget(self, now: int) -> None:
        """Remove state whose lifetime the watermark has passed."""

    def close(self) -> None:
        pass


class FoldProcessor(OrderedProcessor):
    """A step function over named state variables of each key: ``step(values, row) -> (values, outputs)``."""

    def __init__(self, schema, keys, ts, order, kept, outputs, inputs: list[str], step: Callable, states: dict[str, Lifetime]):
        super().__init__(schema, keys, ts, order, kept, outputs)
        self.inputs, self.step, self.states = inputs, step, states
        own = [schema.field(k) for k in keys]
        self.shapes = {n: pa.schema([*own, *to_arrow_schema(StructType.fromDDL(s.columns))]) for n, s in states.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.values = {n: handle.getValueState(n, "until bigint, rows binary") for n in self.states}

    def load(self, name: str) -> dict[tuple, tuple]:
        """Key -> value of a state variable."""
        state = self.values[name]
        if not state.exists():
            return {}
        columns = [c.to_pylist() for c in unpacked(state.get()[1]).columns]
        many = len(self.keys)
        return {r[:many]: r[many:] for r in zip(*columns)}

    def save(self, name: str, held: dict[tuple, tuple], now: int) -> None:
        """The values whose lifetime reaches ``now``, and a timer for when none does."""
        life, state = self.states[name], self.values[name]
        until = {k: life.until_us(v) for k, v in held.items()}
        held = {k: v for k, v in held.items() if until[k] >= now}
        if not held:
            state.clear()
            return
        last = max(until[k] for k in held)
        shape = self.shapes[name]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*[k + v for k, v in held.items()]), shape)]
        state.update((last, packed(pa.table(columns, schema=shape))))
        self.wake(last)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        """Values of the first state variable, from a table of earlier states: an array for each group."""
        name = next(iter(self.states))
        names = self.shapes[name].names
        held = self.load(name)
        for known in initialState["known"]:
            for row in known:
                value = tuple(row[n] for n in names)
                held[value[: len(self.keys)]] = value[len(self.keys) :]
        self.save(name, held, -(1 << 62))

    def release(self, due: pa.Table, group: np.ndarray) -> dict[str, pa.Array]:
        held = {n: self.load(n) for n in self.states}
        first = np.flatnonzero(np.diff(group, prepend=-1))
        keys = list(zip(*[due.column(k).take(pa.array(first)).to_pylist() for k in self.keys]))
        rows = list(zip(*[due.column(n).to_pylist() for n in self.inputs]))
        produced = []
        for key, a, b in zip(keys, first.tolist(), [*first[1:].tolist(), len(rows)]):
            values = tuple(h.get(key) for h in held.values())
            for row in rows[a:b]:
                values, out = self.step(values, row)
                produced.append(out)
            for h, value in zip(held.values(), values):
                if value is None:
                    h.pop(key, None)
                else:
                    h[key] = tuple(value)
        low = int(due.column(self.ts).to_numpy().min())
        for name, h in held.items():
            self.save(name, h, low)
        return {n: pa.array(c, t) for (n, t), c in zip(self.outputs.items(), zip(*produced))}

    def forget(self, now: int) -> None:
        for state in self.values.values():
            if state.exists() and state.get()[0] < now:
                state.clear()


class MemberProcessor(OrderedProcessor):
    """Distinct members of a key within a window before each row; rows of equal time see each other.

    For each kind of member a list of tables says when members were last seen: a trigger appends those that its rows name,
    and the list is written anew without those that have left the window when it has twice as many rows as are needed.
    Presence is interval arithmetic, as in :mod:`promptwatch.operators.correlation`: no step is taken row by row.
    """

    def __init__(self, schema, keys, ts, order, kept, outputs, members: dict[str, list[str]], window_us: int):
        super().__init__(schema, keys, ts, order, kept, outputs)
        self.members, self.window_us = members, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.lists = {n: handle.getListState(f"seen_{n}", "latest bigint, rows binary") for n in self.members}

    def release(self, due: pa.Table, group: np.ndarray) -> dict[str, pa.Array]:
        counts, last = {}, int(due.column(self.ts).to_numpy().max())
        for name, at in self.members.items():
            names = list(dict.fromkeys([*self.keys, *at]))
            earlier = [unpacked(r[1]) for r in self.lists[name].get()]
            now = due.select([*names, self.ts] if self.ts not in names else names)
            both = pa.concat_tables([*earlier, now])
            old = both.num_rows - due.num_rows
            t, key, member = both.column(self.ts).to_numpy(), codes(both, self.keys), codes(both, names)
            counts[name] = pa.array(self.counted(t, key, member, old), self.outputs[name])
            self.keep(name, both, t, member, old, last)
        self.wake(last + self.window_us)
        return counts

    def counted(self, t: np.ndarray, key: np.ndarray, member: np.ndarray, old: int) -> np.ndarray:
        """Members present at each row from ``old`` on."""
        order = np.lexsort((t, member))
        same = np.diff(member[order], prepend=-1) == 0
        near = same & (np.diff(t[order], prepend=0) <= self.window_us)
        starts = order[~near]
        ends = order[~np.append(near[1:], False)]
        rows = np.arange(old, len(t))
        times = np.concatenate([t[starts], t[ends] + self.window_us + 1, t[rows]])
        keys = np.concatenate([key[starts], key[ends], key[rows]])
        step = np.repeat([1, -1, 0], [len(starts), len(ends), len(rows)])
        # a key's steps sum to nothing, so the running sum begins at nothing in each key
        order = np.lexsort((step == 0, times, keys))
        present = np.empty(len(order), np.int64)
        present[order] = np.cumsum(step[order])
        return present[len(starts) + len(ends) :]

    def keep(self, name: str, both: pa.Table, t: np.ndarray, member: np.ndarray, old: int, now: int) -> None:
        """Append the latest times of the members that rows from ``old`` on name, or write all that count."""

        def latest(at: np.ndarray) -> pa.Table:
            at = at[np.lexsort((t[at], member[at]))]
            return both.take(pa.array(at[np.append(member[at][1:] != member[at][:-1], True)]))

        every = latest(np.arange(len(t)))
        # rows yet to come are behind every row that is due, and see no further than a window back
        live = every.filter(pa.array(every.column(self.ts).to_numpy() >= now - self.window_us))
        new = latest(np.arange(old, len(t)))
        chunk = new if old + new.num_rows <= 2 * live.num_rows + 64 else live
        value = (int(chunk.column(self.ts).to_numpy().max()), packed(chunk.combine_chunks()))
        if chunk is new:
            self.lists[name].appendList([value])
        else:
            self.lists[name].put([value])

    def forget(self, now: int) -> None:
        for state in self.lists.values():
            chunks = [(latest, bytes(rows)) for latest, rows in state.get()]
            if chunks and max(c[0] for c in chunks) < now - self.window_us:
                state.clear()


def _placed(stream: DataFrame, keys: list[str], carried: list[str], inputs: list[str], ts: str, order: str) -> tuple[pa.Schema, list[str]]:
    """Schema of the rows that wait, and the names that are passed through."""
    names = list(dict.fromkeys([*keys, *carried, *inputs, ts, order]))
    return to_arrow_schema(stream.select(*names).schema), list(dict.fromkeys([*keys, *carried]))


def _bucket(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias(BUCKET)


def _run(stream: DataFrame, keys: list[str], processor: OrderedProcessor, schema: str, initial: GroupedData | None, event_time: str) -> DataFrame:
    dealt = stream.select("*", _bucket(keys))
    return dealt.groupBy(BUCKET).transformWithStateInPandas(processor, schema, "append", "eventTime", initial, event_time)


def _types(outputs: dict[str, str]) -> dict[str, pa.DataType]:
    fields = to_arrow_schema(StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in outputs.items())))
    return {f.name: f.type for f in fields}


def ordered_fold(
    stream: DataFrame, keys: list[str], carried: list[str], inputs: list[str], step: Callable, states: dict[str, Lifetime],
    outputs: dict[str, str], ts: str = "ts_us", order: str = "request_id", initial: DataFrame | None = None,
) -> DataFrame:
    """Fold every key in (ts, order); ``carried`` columns pass through, ``outputs`` are added.

    The stream must carry a watermark. ``initial`` has a row of the first state variable for each known key.
    """
    schema, kept = _placed(stream, keys, carried, inputs, ts, order)
    processor = FoldProcessor(schema, keys, ts, order, kept, _types(outputs), inputs, step, states)
    types = dict(stream.dtypes)
    shape = ", ".join([f"`{n}` {types[n]}" for n in kept] + [f"`{n}` {t}" for n, t in outputs.items()])
    known = None
    if initial is not None:
        known = initial.groupBy(_bucket(keys)).agg(F.collect_list(F.struct(*initial.columns)).alias("known")).groupBy(BUCKET)
    return _run(stream, keys, processor, shape, known, "")


def members_in_window(
    stream: DataFrame, keys: list[str], carried: list[str], members: dict[str, list[str]], window_us: int,
    ts: str = "ts_us", order: str = "request_id", event_time: str = "event_time",
) -> DataFrame:
    """Add, for each entry of ``members`` (string columns), the distinct members of the key in [t - window, t].

    ``event_time`` is carried on with its watermark, so that another stateful operator can follow.
    """
    schema, kept = _placed(stream, keys, carried, sum(members.values(), []), ts, order)
    processor = MemberProcessor(schema, keys, ts, order, kept, _types(dict.fromkeys(members, "int")), members, window_us)
    processor.event_time = event_time
    types = dict(stream.dtypes)
    shape = ", ".join([f"`{n}` {types[n]}" for n in kept] + [f"`{n}` int" for n in members] + [f"`{event_time}` timestamp"])
    return _run(stream, keys, processor, shape, None, event_time)
