"""A job queue as a stream: one state for each tenant, leases and intervals by timers.

Workers' and callers' messages are events; what they get are the actions that come out. A tenant's messages are handled in
one place in order of their time, so two workers that ask at once get different jobs, and a job is held by one lease only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A job dies at so many failures.
RETRIES = 3
ACTIONS = "tenant_id long, job_id string, worker string, action string, at timestamp"
_JOB = "status string, worker string, until long, failures int, doc_id string, since long"
ACTIVE = ("pending", "processing")


@dataclass
class Settings:
    """Slots of a tenant, seconds of a lease, seconds between scheduled jobs (0: none), how long an event is remembered."""

    slots: int = 2
    lease: int = 900
    interval: int = 0
    remember: int = 86400


class JobQueue(StatefulProcessor):
    """Events (tenant_id, event_id, ts, kind, job_id, doc_id, worker), kinds:

    enqueue: a job is known from then on, once. ask: a worker wants the oldest job that is free: its tenant has a slot and
    no job of its document is processing; it gets `claimed` or `idle`. beat: the lease is renewed. done, failed: by the
    worker that holds the job; others are `refused`. A lease that ends without a beat, and a failure, put the job back
    (`requeued`, `retry`), the RETRIES-th time for good (`dead_letter`). Every interval a job `scheduled:<time>` is made unless
    one is active. An event that comes again does nothing; one later than the watermark does not come at all.
    """

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id string", _JOB)
        self.seen = handle.getMapState("seen", "event_id string", "at long")
        self.clock = handle.getValueState("clock", "next long")

    # a tenant's jobs as plain values; done and dead ones are forgotten like events

    def _all(self) -> dict[str, list]:
        return {k[0]: list(v) for k, v in self.jobs.iterator()}

    def _put(self, name: str, job: list) -> None:
        self.jobs.updateValue((name,), tuple(job))

    def _back(self, name: str, job: list, at: int, why: str) -> tuple:
        job[3] += 1
        worker, dead = job[1], job[3] >= RETRIES
        job[:3] = ["dead" if dead else "pending", "", at if dead else 0]
        self._put(name, job)
        return name, worker, "dead_letter" if dead else why, at

    def _ask(self, jobs: dict[str, list], worker: str, at: int) -> tuple:
        busy = [j for j in jobs.values() if j[0] == "processing"]
        docs = {j[4] for j in busy}
        free = sorted((j[5], n) for n, j in jobs.items() if j[0] == "pending" and j[4] not in docs)
        if len(busy) >= self.settings.slots or not free:
            return "", worker, "idle", at
        name = free[0][1]
        job = jobs[name]
        job[:3] = ["processing", worker, at + self.settings.lease * 1000]
        self._put(name, job)
        self.handle.registerTimer(job[2])
        return name, worker, "claimed", at

    def _one(self, jobs: dict[str, list], e, at: int) -> list[tuple]:
        name, worker = e.job_id or "", e.worker or ""
        if e.kind == "enqueue":
            if name in jobs:
                return []
            jobs[name] = ["pending", "", 0, 0, e.doc_id or name, at]
            self._put(name, jobs[name])
            return [(name, "", "enqueued", at)]
        if e.kind == "ask":
            return [self._ask(jobs, worker, at)]
        job = jobs.get(name)
        if job is None or job[0] != "processing" or job[1] != worker:
            return [(name, worker, "refused", at)]
        if e.kind == "beat":
            job[2] = at + self.settings.lease * 1000
            self._put(name, job)
            self.handle.registerTimer(job[2])
            return []
        if e.kind == "done":
            job[:3] = ["done", "", at]
            self._put(name, job)
            return [(name, worker, "completed", at)]
        return [self._back(name, job, at, "retry")] if e.kind == "failed" else [(name, worker, "refused", at)]

    def _ended(self, jobs: dict[str, list], at: int) -> list[tuple]:
        """Leases that were over at a time."""
        return [self._back(n, j, j[2], "requeued") for n, j in sorted(jobs.items()) if j[0] == "processing" and j[2] <= at]

    def _scheduled(self, jobs: dict[str, list], at: int) -> list[tuple]:
        step = self.settings.interval * 1000
        if not step:
            return []
        due = self.clock.get()[0] if self.clock.exists() else (at // step + 1) * step
        out = []
        while due <= at:
            name = f"scheduled:{due // 1000}"
            if not any(n.startswith("scheduled:") and j[0] in ACTIVE for n, j in jobs.items()):
                jobs[name] = ["pending", "", 0, 0, name, due]
                self._put(name, jobs[name])
                out.append((name, "", "enqueued", due))
            due += step
        self.clock.update((due,))
        self.handle.registerTimer(due)
        return out

    def _frames(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            text = lambda k: pd.Series([o[k] for o in out], dtype=object)
            yield pd.DataFrame({"tenant_id": [key[0]] * len(out), "job_id": text(0), "worker": text(1), "action": text(2), "at": pd.to_datetime([o[3] for o in out], unit="ms")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        jobs, out = self._all(), []
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for e in events.itertuples(index=False):
            at = int(e.ts.timestamp() * 1000)
            if self.seen.containsKey((e.event_id,)):
                continue
            self.seen.updateValue((e.event_id,), (at,))
            out += self._ended(jobs, at) + self._scheduled(jobs, at) + self._one(jobs, e, at)
        # what the watermark keeps out needn't be remembered
        old = timerValues.getCurrentWatermarkInMs() - self.settings.remember * 1000
        for k, v in list(self.seen.iterator()):
            if v[0] < old:
                self.seen.removeKey(k)
        for n, j in jobs.items():
            if j[0] in ("done", "dead") and j[2] < old:
                self.jobs.removeKey((n,))
        yield from self._frames(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs, at = self._all(), expiredTimerInfo.getExpiryTimeInMs()
        yield from self._frames(key, self._ended(jobs, at) + self._scheduled(jobs, at))

    def close(self) -> None:
        pass


def queue_actions(events: DataFrame, settings: Settings | None = None, late: str = "1 minute") -> DataFrame:
    """(tenant_id, job_id, worker, action, at) of a stream of queue events with a column ts; see JobQueue.

    The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    e = events.withWatermark("ts", late)
    return e.groupBy("tenant_id").transformWithStateInPandas(JobQueue(settings or Settings()), ACTIONS, "append", "EventTime")
