"""Order inside a case over a stream: what follows each event, as events come in any order within the watermark's delay.

An event is held until the watermark has passed it, as one before it can come until then; it is then released in order and
given out once the next event of its case is released, or once the case has been quiet for so long that it counts as ended.
State holds the events ahead of the watermark and one event behind it for each running case, and nothing of ended ones.

The state store must be RocksDB: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Following(StatefulProcessor):
    """State of a case: `ahead`, its events that aren't released, and `last`, the released one that waits for the next."""

    def __init__(self, case: str, fields: T.StructType, quiet_us: int):
        self.case, self.fields, self.quiet_us = case, fields, quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", self.fields)
        self.last = handle.getValueState("last", self.fields)

    @staticmethod
    def _timer(us: int) -> int:
        """The millisecond at which an instant is passed."""
        return -(-us // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for batch in rows:
            batch = batch[self.fields.names]
            for values in batch.itertuples(index=False):
                self.ahead.appendValue(tuple(map(_plain, values, self.fields.fields)))
            for us in set(batch["at_us"].tolist()):
                self.handle.registerTimer(self._timer(us))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted((tuple(e) for e in self.ahead.get()), key=lambda e: e[:2]) if self.ahead.exists() else []
        ready, rest = [e for e in events if e[0] <= passed], [e for e in events if e[0] > passed]
        chain = ([tuple(self.last.get())] if self.last.exists() else []) + ready
        out, begun = [], 0
        for i, event in enumerate(chain):
            after = chain[i + 1] if i + 1 < len(chain) else None
            if after is None and event[0] + self.quiet_us > passed:
                break
            joined = after is not None and after[0] <= event[0] + self.quiet_us
            out.append((*key, *event, *(after if joined else (None,) * len(event))))
            begun = i + 1
        self.ahead.put(rest) if rest else self.ahead.clear()
        if begun < len(chain):
            self.last.update(chain[begun])
            self.handle.registerTimer(self._timer(chain[begun][0] + self.quiet_us))
        else:
            self.last.clear()
        if out:
            names = [self.case, *self.fields.names, *(f"next_{n}" for n in self.fields.names)]
            yield pd.DataFrame(out, columns=names).astype(object)

    def close(self) -> None:
        pass


def _plain(v, field: T.StructField):
    """A cell of pandas as Python has it: missing values are None, and whole numbers beside them whole again."""
    if pd.isna(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if isinstance(field.dataType, T.IntegralType) else v


def following(log: DataFrame, *cols: str, delay: str, quiet: str, case: str = "idcase") -> DataFrame:
    """case, timestamp, id and the given columns of each event, and next_ of all of them but the case: the next event of the case.

    delay: how late events come; later ones are dropped. quiet: an event without another of its case for so long is its last,
    and an event after that begins anew. Events of one instant are in order of id.
    """
    kinds = {f.name: f.dataType for f in log.schema.fields}
    fields = T.StructType([T.StructField("at_us", T.LongType()), T.StructField("id", kinds["id"]), *[T.StructField(c, kinds[c]) for c in cols]])
    out = T.StructType([T.StructField(case, kinds[case]), *fields.fields, *[T.StructField(f"next_{f.name}", f.dataType) for f in fields.fields]])
    timed = log.select(case, F.col("timestamp").cast("timestamp").alias("timestamp"), "id", *cols).withWatermark("timestamp", delay)
    timed = timed.withColumn("at_us", F.unix_micros("timestamp"))
    released = timed.groupBy(case).transformWithStateInPandas(_Following(case, fields, pd.Timedelta(quiet).value // 1000), out, outputMode="Append", timeMode="EventTime")
    when = lambda c: F.timestamp_micros(c).cast(kinds["timestamp"])
    ahead = [when("next_at_us").alias("next_timestamp"), "next_id", *[f"next_{c}" for c in cols]]
    return released.select(case, when("at_us").alias("timestamp"), "id", *cols, *ahead)


def directly_follows(log: DataFrame, delay: str, quiet: str, case: str = "idcase") -> DataFrame:
    """A row for each event that follows another in its case: case, id, timestamp, activity, next_activity, service (seconds between)."""
    steps = following(log, "activity", delay=delay, quiet=quiet, case=case).where("next_id is not null")
    second = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return steps.select(case, "id", "timestamp", "activity", "next_activity", (second("next_timestamp") - second("timestamp")).alias("service"))


def consecutive_repeats(log: DataFrame, delay: str, quiet: str, case: str = "idcase") -> DataFrame:
    """Events whose next one in the case has the same activity: case, id, activity, resource, next_resource."""
    steps = following(log, "activity", "resource", delay=delay, quiet=quiet, case=case).where("activity = next_activity")
    return steps.select(case, "id", "activity", "resource", "next_resource")
