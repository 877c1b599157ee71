"""The sliding window of one client as a live service keeps it: event id -> milliseconds."""
from __future__ import annotations

import heapq
from collections.abc import Iterable

# A window is kept in this many buckets of time, and one or two more at its edges.
BUCKETS = 10


class Members:
    """Ids with their event times. Observing an event evicts what is older than its own
    window, sets the event's time, and counts what is left; a retried id moves, it is not
    added twice. Late events evict little and still count newer members.

    ``touched`` holds the buckets of time whose members changed, so that only those need to be
    written again."""

    def __init__(self, window_ms: int, members: Iterable[tuple[str, int]] = ()):
        self.window_ms = window_ms
        self.width = max(1, window_ms // BUCKETS)
        self.time_of = dict(members)
        self.by_time = [(t, i) for i, t in self.time_of.items()]
        heapq.heapify(self.by_time)
        self.touched: set[int] = set()

    def bucket(self, ms: int) -> int:
        return ms - ms % self.width

    def observe(self, event_id: str, ms: int) -> int:
        cutoff = ms - self.window_ms
        while self.by_time and self.by_time[0][0] < cutoff:
            t, old = heapq.heappop(self.by_time)
            if self.time_of.get(old) == t:
                del self.time_of[old]
                self.touched.add(self.bucket(t))
        before = self.time_of.get(event_id)
        if before != ms:
            if before is not None:
                self.touched.add(self.bucket(before))
            self.time_of[event_id] = ms
            heapq.heappush(self.by_time, (ms, event_id))
            self.touched.add(self.bucket(ms))
        return len(self.time_of)

    def changed(self) -> dict[int, dict[str, int]]:
        """The members of each touched bucket; empty ones have none left."""
        held: dict[int, dict[str, int]] = {start: {} for start in self.touched}
        for event_id, ms in self.time_of.items():
            if (start := self.bucket(ms)) in held:
                held[start][event_id] = ms
        return held
