"""Uploads that grow stale and deliveries that are retried, as state with timers.

A row is kept in state while it is open, with the moment at which something is due. The clock is the wall clock
("ProcessingTime") or the watermark ("EventTime", for replays and tests); it passes without any further row of the id. Every
change of a row comes out as a row of its own.

A call into the state store from Python costs far more than a step of a row, so ids share state by ``GROUPS`` hash groups:
a batch reads and writes the open rows of a group once, and a group has one timer, for the earliest moment due in it. Rows
cross to Python and back as one JSON text each: nulls and long ids stay exact, and pandas columns are quick.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from frayline.operators import ops

PROCESSING, EVENT = "ProcessingTime", "EventTime"


def _clock(mode: str, values: TimerValues) -> int:
    return values.getCurrentProcessingTimeInMs() if mode == PROCESSING else max(0, values.getCurrentWatermarkInMs())


GROUPS = 4_096  # fixed for the life of a checkpoint


class _OpenRows(StatefulProcessor):
    """The open rows of a group of ids: id -> (due, *values), and one timer for the earliest of them."""

    def __init__(self, mode: str) -> None:
        self.mode = mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "due BIGINT, rows BINARY")

    def step(self, open_rows: dict, r: SimpleNamespace) -> Iterator[dict]:
        """An arriving row: changes ``open_rows``, yields what comes out."""
        raise NotImplementedError

    def ring(self, open_rows: dict, id_: int, now: int) -> Iterator[dict]:
        """An open row that is due: stays with a later moment or goes."""
        raise NotImplementedError

    def arrival(self, r: SimpleNamespace) -> tuple:
        raise NotImplementedError

    def _load(self) -> tuple[int | None, bytes | None]:
        return self.state.get() or (None, None)

    def _save(self, timer: int | None, before: bytes | None, open_rows: dict) -> None:
        """``timer`` is the one that still stands."""
        due = min((row[0] for row in open_rows.values()), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if due is not None:
            rows = pickle.dumps(open_rows)
            if rows != before:
                self.state.update((due, rows))
        elif before is not None:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        timer, before = self._load()
        open_rows = {} if before is None else pickle.loads(before)
        arrived = [SimpleNamespace(**json.loads(text)) for frame in rows for text in frame["row"].tolist()]
        yield _texts(out for r in sorted(arrived, key=self.arrival) for out in self.step(open_rows, r))
        self._save(timer, before, open_rows)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, before = self._load()
        if before is None:
            return
        open_rows, now = pickle.loads(before), _clock(self.mode, timerValues)
        ringing = [i for i, row in open_rows.items() if row[0] <= now]
        yield _texts(out for id_ in ringing for out in self.ring(open_rows, id_, now))
        # the timer that has rung goes by itself
        self._save(None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer, before, open_rows)

    def close(self) -> None:
        pass


def _texts(rows: Iterable[dict]) -> pd.DataFrame:
    return pd.DataFrame({"row": pd.Series([json.dumps(r) for r in rows], dtype="object")})


def _changes(rows: DataFrame, processor: _OpenRows, ddl: str) -> DataFrame:
    texts = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(GROUPS)).alias("id_group"), "at",
        F.to_json(F.struct(*[c for c in rows.columns if c != "at"]), {"ignoreNullFields": "false"}).alias("row"),
    )
    out = texts.groupBy("id_group").transformWithStateInPandas(processor, "row STRING", "append", processor.mode)
    return out.select(F.from_json("row", ddl).alias("r")).select("r.*")


# -- uploads ------------------------------------------------------------------------------
UPLOAD_CHANGES = "id BIGINT, status STRING, error_message STRING, changed_ms BIGINT"


class UploadSweep(_OpenRows):
    """A pending upload that hears nothing within the threshold fails; a signal before that ends it.

    Rows of a batch are taken in the order of their time, pending ones first; a pending row after a final one opens the
    upload again.
    """

    def __init__(self, mode: str, threshold_s: int) -> None:
        super().__init__(mode)
        self.threshold_ms = 1000 * threshold_s
        self.message = ops.STUCK_MESSAGE.format(seconds=threshold_s)

    def arrival(self, r: SimpleNamespace) -> tuple:
        return r.changed_ms, r.status != "pending"

    def step(self, open_rows: dict, r: SimpleNamespace) -> Iterator[dict]:
        open_rows.pop(r.id, None)
        if r.status == "pending":
            # stuck means older than the threshold, so one millisecond more
            open_rows[r.id] = (r.uploaded_ms + self.threshold_ms + 1,)
        yield dict(id=r.id, status=r.status, error_message=r.error_message, changed_ms=r.changed_ms)

    def ring(self, open_rows: dict, id_: int, now: int) -> Iterator[dict]:
        del open_rows[id_]
        yield dict(id=id_, status="failed", error_message=self.message, changed_ms=now)


def upload_changes(uploads: DataFrame, threshold_s: int, mode: str = PROCESSING) -> DataFrame:
    """Changes of uploads: ``uploads`` is a stream of id, uploaded_at, status, error_message and ``at``, a row's own time.

    A row is an upload or a signal about one. With "EventTime" ``at`` carries the watermark.
    """
    rows = uploads.select("id", F.unix_millis("uploaded_at").alias("uploaded_ms"), "status", "error_message", F.unix_millis("at").alias("changed_ms"), "at")
    return _changes(rows, UploadSweep(mode, threshold_s), UPLOAD_CHANGES)


def newest_status(changes: DataFrame) -> DataFrame:
    """The last status of every upload; of changes at one time the final one."""
    order = F.struct("changed_ms", F.col("status") != "pending")
    return changes.groupBy("id").agg(F.max_by(F.struct("status", "error_message"), order).alias("u")).select("id", "u.*")


# -- deliveries -----------------------------------------------------------------------------
DELIVERY_CHANGES = "id BIGINT, subscription_id BIGINT, upload_id BIGINT, payload BINARY, change STRING, attempt INT, error STRING, at_ms BIGINT"
TIMEOUT_ERROR = "no answer within {seconds}s"


class DeliveryCourse(_OpenRows):
    """Attempt, wait, retry, dead letter.

    An undelivered row is due at its time; then its next attempt is asked for ("retry") and waits for an answer. A good
    answer ends it ("delivered"); a bad one, or none within the timeout, leads to the next wait, or after the last attempt
    to the dead letters ("dead"). An open row is (due, asked, subscription_id, upload_id, payload, attempt, error).
    """

    def __init__(self, mode: str, timeout_s: int) -> None:
        super().__init__(mode)
        self.timeout_ms = 1000 * timeout_s
        self.no_answer = TIMEOUT_ERROR.format(seconds=timeout_s)

    def arrival(self, r: SimpleNamespace) -> tuple:
        return r.at_ms, r.is_answer

    def _change(self, id_: int, row: tuple, change: str, at: int) -> dict:
        subscription, upload, payload, attempt, error = row
        return dict(id=id_, subscription_id=subscription, upload_id=upload, payload=payload, change=change, attempt=attempt, error=error, at_ms=at)

    def _failed(self, open_rows: dict, id_: int, row: tuple, at: int) -> Iterator[dict]:
        if row[3] >= ops.MAX_ATTEMPTS:
            del open_rows[id_]
            yield self._change(id_, row, "dead", at)
        else:
            open_rows[id_] = (at + 1000 * ops.BACKOFF_S[max(1, row[3])], False, *row)

    def step(self, open_rows: dict, r: SimpleNamespace) -> Iterator[dict]:
        good = r.status_code is not None and r.status_code < 300
        if r.is_answer:
            found = open_rows.get(r.id)
            if found is None or not found[1] or found[5] != r.attempt:
                return  # not asked for, or answered before
            row = (*found[2:6], r.error)
            if good:
                del open_rows[r.id]
                yield self._change(r.id, row, "delivered", r.at_ms)
            else:
                yield from self._failed(open_rows, r.id, row, r.at_ms)
        else:
            open_rows.pop(r.id, None)
            row = (r.subscription_id, r.upload_id, r.payload, r.attempt, r.error)
            if r.is_delivered:
                yield self._change(r.id, row, "delivered", r.at_ms)
            elif r.attempt >= ops.MAX_ATTEMPTS:
                yield self._change(r.id, row, "dead", r.at_ms)
            elif not good:
                open_rows[r.id] = (r.at_ms if r.next_ms is None else r.next_ms, False, *row)

    def ring(self, open_rows: dict, id_: int, now: int) -> Iterator[dict]:
        _, asked, *row = open_rows[id_]
        if asked:
            yield from self._failed(open_rows, id_, (*row[:4], self.no_answer), now)
        else:
            row = (*row[:3], row[3] + 1, row[4])
            open_rows[id_] = (now + self.timeout_ms, True, *row)
            yield self._change(id_, row, "retry", now)


def delivery_rows(deliveries: DataFrame) -> DataFrame:
    """Deliveries with their own time ``at`` as input of ``delivery_changes``."""
    return deliveries.select(
        "id", "subscription_id", "upload_id", "payload", F.col("attempt").cast("int").alias("attempt"), F.col("status_code").cast("int").alias("status_code"), "error",
        F.col("delivered_at").isNotNull().alias("is_delivered"), F.unix_millis("next_attempt_at").alias("next_ms"), F.unix_millis("at").alias("at_ms"), F.lit(False).alias("is_answer"), "at",
    )


def answer_rows(answers: DataFrame) -> DataFrame:
    """Answers (id, attempt, status_code, error, at) as input of ``delivery_changes``."""
    none = lambda kind: F.lit(None).cast(kind)
    return answers.select(
        "id", none("bigint").alias("subscription_id"), none("bigint").alias("upload_id"), none("binary").alias("payload"), F.col("attempt").cast("int").alias("attempt"),
        F.col("status_code").cast("int").alias("status_code"), "error", F.lit(False).alias("is_delivered"), none("bigint").alias("next_ms"), F.unix_millis("at").alias("at_ms"), F.lit(True).alias("is_answer"), "at",
    )


def delivery_changes(rows: DataFrame, timeout_s: int, mode: str = PROCESSING) -> DataFrame:
    """Changes of deliveries from a stream of ``delivery_rows`` and ``answer_rows``."""
    return _changes(rows, DeliveryCourse(mode, timeout_s), DELIVERY_CHANGES)
