"""Waiting for the jobs of a sanitization service."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from .jobs import FINAL, STATES

#: Columns of a job's record, as the latency summaries take them.
RECORD = "job_id string, final_status string, progress double, processing_started_at timestamp, completed_at timestamp, warning_count int, entity_count int, error string"


def poll(
    job_ids: Iterable[str], status: Callable[[str], dict], every: float = 2.0, at_most: float = 180.0,
    clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
) -> list[tuple]:
    """Rows of RECORD, in the order of the ids, once all jobs are done or ``at_most`` seconds are over.

    ``status`` asks for a job: status, progress, warnings, entities, error. A question that
    fails is asked again in the next round; unknown states count as failed. A job that is
    not done in time keeps its last state, with an error that says so.
    """
    rows = {j: {"status": STATES[0], "progress": 0.0, "error": None} for j in job_ids}
    waiting, end = list(rows), clock() + at_most
    while waiting:
        for j in list(waiting):
            row = rows[j]
            try:
                got = status(j)
            except OSError as e:
                row["error"] = str(e)
                continue
            state = got.get("status")
            row.update(status=state if state in STATES else "failed", progress=min(1.0, max(0.0, float(got.get("progress") or 0.0))), error=got.get("error"))
            if row["status"] == "processing":
                row.setdefault("started", now())
            if row["status"] in FINAL:
                row.update(done=now(), warnings=len(got.get("warnings") or []), entities=len(got.get("entities") or []))
                waiting.remove(j)
        if waiting:
            if clock() + every > end:
                for j in waiting:
                    rows[j]["error"] = rows[j]["error"] or f"not done in {at_most:g} seconds"
                break
            sleep(max(0.1, every))
    return [(j, r["status"], r["progress"], r.get("started"), r.get("done"), r.get("warnings"), r.get("entities"), r["error"]) for j, r in rows.items()]
