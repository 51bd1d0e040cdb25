"""Tables that micro-batches add to, behind one committed manifest.

A batch writes its rows to folders of their own and then publishes a manifest that names them; a reader looks at
the folders of the newest manifest only. So several tables change together or not at all, whatever a crash leaves
behind is never read, and a batch that comes again finds itself done. Every eight runs of a table are merged into one of the next
level by the table's own rule, so reading opens a few folders per level, not one per batch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete, list_names, read_text, write_new

#: Runs of a level that become one of the next.
FAN_IN = 8
#: Manifests kept, for readers that have just opened one.
KEPT = 8

Rows = Callable[[dict[str, DataFrame]], DataFrame]


def newest_of(keys: list[str], by: str = "batch_id") -> Callable[[DataFrame], DataFrame]:
    """A merging rule: of each key the row of the newest batch."""

    def merge(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        newest = F.max_by(F.struct(*values), by).alias("_v")
        return rows.groupBy(*keys).agg(newest).select(*keys, "_v.*").select(rows.columns)

    return merge


@dataclass(frozen=True)
class State:
    """What a manifest says. `runs` of a table are in the order of their batches."""

    version: int = 0
    runs: dict[str, list[dict]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)
    dropped: list[list[str]] = field(default_factory=list)
    caught_up: bool = False

    def changed(self, **values) -> State:
        return State(**{**self.__dict__, "version": self.version + 1, **values})


class Tables:
    """The tables below one path. `merges`: by table, how rows of several runs become one run's; None keeps them all.

    `partitions`: by table, the columns its folders are split by. Any number of streams may add to the same
    tables: who publishes second looks again at what the first has published and builds its rows anew.
    """

    def __init__(self, spark: SparkSession, path: str, merges: dict[str, Callable | None], partitions: dict[str, list[str]] | None = None):
        self.spark, self.path, self.merges, self.partitions = spark, path.rstrip("/"), merges, partitions or {}

    def state(self) -> State:
        names = list_names(self.spark, f"{self.path}/_manifests")
        return State(**json.loads(read_text(self.spark, f"{self.path}/_manifests/{max(names)}"))) if names else State()

    def _publish(self, state: State) -> bool:
        """False if someone else has published this version."""
        folder = f"{self.path}/_manifests"
        if not write_new(self.spark, f"{folder}/{state.version:020d}", json.dumps(state.__dict__)):
            return False
        for old in sorted(list_names(self.spark, folder))[:-KEPT]:
            delete(self.spark, f"{folder}/{old}")
        return True

    def _write(self, table: str, rows: DataFrame, level: int = 0) -> dict:
        run = uuid.uuid4().hex
        by = self.partitions.get(table, [])
        rows = rows.hint("rebalance", *by)
        writer = rows.write.partitionBy(*by) if by else rows.write
        writer.parquet(f"{self.path}/{table}/run={run}")
        return {"run": run, "level": level}

    def _read(self, table: str, runs: list[dict], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not runs:
            return self.spark.createDataFrame([], kind)
        base = f"{self.path}/{table}"
        rows = self.spark.read.schema(kind).option("basePath", base).parquet(*[f"{base}/run={r['run']}" for r in runs])
        return rows.select(kind.fieldNames())

    def read(self, table: str, state: State | None = None) -> DataFrame | None:
        """The rows of all runs, merged by the table's rule; None if nothing was ever published."""
        state = state or self.state()
        if table not in state.schemas:
            return None
        rows = self._read(table, state.runs[table], state.schemas[table])
        merge = self.merges[table]
        return merge(rows) if merge and len(state.runs[table]) > 1 else rows

    def commit(self, stream: str, batch_id: int, build: Callable[[State], dict[str, Rows]]) -> dict[str, DataFrame]:
        """Add a batch's rows; returns them as written, or nothing if the batch is there already.

        `build` gets the state and returns, by table, a function of the frames written before it, so that one table's rows
        can be made from another's. It is asked again if another stream published meanwhile.
        """
        while True:
            state = self.state()
            if state.done.get(stream, -1) >= batch_id:
                return {}
            runs, schemas, frames = dict(state.runs), dict(state.schemas), {}
            fresh: list[str] = []
            for table, make in build(state).items():
                rows = make(frames)
                schemas.setdefault(table, rows.schema.json())
                run = self._write(table, rows)
                fresh.append(f"{table}/run={run['run']}")
                runs[table] = [*runs.get(table, []), run]
                frames[table] = self._read(table, [run], rows.schema.json())
            if self._publish(state.changed(runs=runs, schemas=schemas, done={**state.done, stream: batch_id})):
                self.compact()
                return frames
            for folder in fresh:
                delete(self.spark, f"{self.path}/{folder}")

    def compact(self) -> None:
        """Merge full levels. What they were stays on disk until the compaction after the next."""
        while True:
            state = self.state()
            full = next(((t, runs) for t, runs in state.runs.items() if self._tail(runs)), None)
            if full is None:
                return
            table, runs = full
            old = runs[-self._tail(runs) :]
            rows = self._read(table, old, state.schemas[table])
            merge = self.merges[table]
            merged = self._write(table, merge(rows) if merge else rows, old[0]["level"] + 1)
            gone = [f"{table}/run={r['run']}" for r in old]
            after = state.changed(runs={**state.runs, table: [*runs[: -len(old)], merged]}, dropped=[*state.dropped[-1:], gone])
            if not self._publish(after):
                delete(self.spark, f"{self.path}/{table}/run={merged['run']}")
                continue
            for folder in (f for group in state.dropped[:-1] for f in group):
                delete(self.spark, f"{self.path}/{folder}")

    @staticmethod
    def _tail(runs: list[dict]) -> int:
        """How many runs at the end are of one level, if that level is full."""
        n = 0
        while n < len(runs) and runs[-1 - n]["level"] == runs[-1]["level"]:
            n += 1
        return n if n >= FAN_IN else 0

    def mark_caught_up(self) -> None:
        """Remember that a run of the stream has gone through everything its source held."""
        while not (state := self.state()).caught_up:
            if self._publish(state.changed(caught_up=True)):
                return
