"""Stack history of a stream: rows wait in state until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

HISTORY_DDL = "fight_id STRING, agent_id BIGINT, buff_id BIGINT, seq BIGINT, time_ms BIGINT, stacks BIGINT"
DAY_MS = 86_400_000


class StackHistory(StatefulProcessor):
    """Level and waiting rows of one (fight, agent, buff).

    Rows wait in a map by (time, seq), so a row that comes twice waits once. One timer stands at the earliest waiting row;
    when none waits, it stands at the end of the fight, and then the state goes. Rows behind the watermark never get here:
    Spark drops and counts them.
    """

    def __init__(self, start_of: Callable[[str], int], lifetime_ms: int) -> None:
        self.start_of, self.lifetime_ms = start_of, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "level BIGINT, timer BIGINT")
        self.waiting = handle.getMapState("waiting", "time_ms BIGINT, seq BIGINT", "kind STRING, stacks BIGINT")

    def _set(self, level: int, old: int | None, timer: int) -> None:
        if old != timer:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
        self.level.update((level, timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        start = self.start_of(key[0])
        level, timer = self.level.get() if self.level.exists() else (0, None)
        due = timer if timer is not None else start + self.lifetime_ms
        for r in rows:
            self.waiting.updateValue((r.time_ms, r.seq), (r.kind, r.stacks))
            due = min(due, start + r.time_ms)
        self._set(level, timer, due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if not self.level.exists():
            return
        start = self.start_of(key[0])
        level, _ = self.level.get()
        passed = timerValues.getCurrentWatermarkInMs() - start
        rows = sorted((tuple(at), tuple(change)) for at, change in self.waiting.iterator())
        done = [x for x in rows if x[0][0] <= passed]
        for (time_ms, seq), (kind, n) in done:
            level = level + n if kind == "apply" else max(0, level - n) if kind == "remove_single" else 0
            yield Row(fight_id=key[0], agent_id=key[1], buff_id=key[2], seq=seq, time_ms=time_ms, stacks=level)
        if len(done) == len(rows):
            self.waiting.clear()
        else:
            for at, _ in done:
                self.waiting.removeKey(at)
        end = start + self.lifetime_ms
        if len(done) < len(rows):
            self._set(level, None, start + rows[len(done)][0][0])
        elif end > timerValues.getCurrentWatermarkInMs():
            self._set(level, None, end)
        else:
            self.level.clear()

    def close(self) -> None:
        pass


def stack_history(events: DataFrame, start_of: Callable[[str], int], event_time: str = "ts", delay: str = "1 hour", lifetime_ms: int = DAY_MS) -> DataFrame:
    """Stack history per (fight, target, buff) as rows leave the watermark.

    ``events`` carry ``event_time`` next to the event columns; ``start_of`` gives the epoch milliseconds at which a fight
    begins, ``lifetime_ms`` after which its state is gone.
    """
    rows = events.filter("event_type = 'BOON_APPLY' and kind <> 'remove_manual'").withWatermark(event_time, delay).select(
        "fight_id", F.col("target_agent_id").cast("bigint").alias("agent_id"), F.col("skill_id").cast("bigint").alias("buff_id"),
        "seq", "time_ms", "kind", F.col("stacks").cast("bigint").alias("stacks"), event_time,
    )
    return rows.groupBy("fight_id", "agent_id", "buff_id").transformWithState(StackHistory(start_of, lifetime_ms), HISTORY_DDL, "append", "EventTime")
