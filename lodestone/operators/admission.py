"""Rate limits, quotas and an answer cache over request logs.

Whether a request is let in depends on the decisions before it, so logs are walked in order, in slices (see ``walks``):
neither a key with most of the requests nor a limit or a cache that all share puts a log into one task.
"""

from __future__ import annotations

import math
from collections import OrderedDict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .walks import Walk, walked


class Held:
    """Times of admitted requests within a window."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window, self.times = limit, window, deque()

    def wait(self, t: float) -> int:
        """0 if a request at ``t`` may come in, else the whole seconds until one may."""
        while self.times and self.times[0] <= t - self.window:
            self.times.popleft()
        return 0 if len(self.times) < self.limit else max(1, math.ceil(self.times[0] + self.window - t)) if self.times else max(1, math.ceil(self.window))

    def add(self, t: float) -> None:
        self.times.append(t)


def walk(times: list[float], limit: int, window: float) -> list[tuple[bool, int]]:
    """(admitted, seconds to wait) for each of a key's requests, in order of time; a limit of 0 admits all."""
    held, out = Held(limit, window), []
    for t in times:
        wait = held.wait(t) if limit > 0 else 0
        if not wait:
            held.add(t)
        out.append((not wait, wait))
    return out


class Quota:
    """What a limit for all and one for each key hold; the limit for all is asked first, and a refusal is held against neither."""

    def __init__(self, per_key: int, key_window: float, overall: int, overall_window: float):
        self.limits = per_key, key_window, overall, overall_window
        self.all, self.own, self.seen, self.now = Held(overall, overall_window), {}, 0, -math.inf

    def _forget(self) -> None:
        """Let go of what lies before the windows."""
        self.all.wait(self.now)
        for k in [k for k, h in self.own.items() if not (h.wait(self.now) or h.times)]:
            del self.own[k]

    def charge(self, key: object, t: float) -> tuple[str, int]:
        self.seen, self.now = self.seen + 1, t
        if self.seen % 4096 == 0:
            self._forget()
        mine = self.own.get(key) or Held(*self.limits[:2])
        for name, held in (("overall", self.all), ("key", mine)):
            if wait := held.wait(t):
                return name, wait
        self.own[key] = mine
        mine.add(t)
        self.all.add(t)
        return "ok", 0

    def dump(self) -> list:
        self._forget()
        return [list(self.all.times), sorted(([k, list(h.times)] for k, h in self.own.items()), key=repr)]

    def load(self, dumped: list) -> Quota:
        self.all.times = deque(dumped[0])
        for key, times in dumped[1]:
            self.own[key] = Held(*self.limits[:2])
            self.own[key].times = deque(times)
        return self


class Answers:
    """Names of kept answers, those not asked for longest go first."""

    def __init__(self, size: int):
        self.size, self.names = size, OrderedDict()

    def get(self, name: str) -> bool:
        if hit := name in self.names:
            self.names.move_to_end(name)
        return hit

    def put(self, name: str) -> None:
        if self.size > 0:
            self.names[name] = True
            self.names.move_to_end(name)
            if len(self.names) > self.size:
                self.names.popitem(last=False)

    def load(self, names: list[str]) -> Answers:
        self.names = OrderedDict.fromkeys(names, True)
        return self


def limited(requests: DataFrame, limit: int, window: float = 60.0, slices: int | None = None) -> DataFrame:
    """(key, event_id, at, admitted, retry_after) for requests (key, event_id, at in seconds); a limit of 0 admits all."""

    def step(held: Held, row: tuple) -> tuple:
        key, event, at = row
        wait = held.wait(at) if limit > 0 else 0
        if not wait and limit > 0:
            held.add(at)
        return key, event, at, not wait, wait

    def load(times: list[float]) -> Held:
        held = Held(limit, window)
        held.times = deque(times)
        return held

    walk = Walk(lambda: Held(limit, window), step, lambda held: list(held.times), load)
    return walked(requests.select("key", "event_id", "at"), "key", ["at", "event_id"], walk, "key long, event_id long, at double, admitted boolean, retry_after long", slices)


def charged(requests: DataFrame, per_key: int, key_window: float, overall: int, overall_window: float, slices: int | None = None) -> DataFrame:
    """(key, event_id, verdict, retry_after) under two quotas at once: overall is asked first, then the key's; a refusal is held against neither."""
    begin = lambda: Quota(per_key, key_window, overall, overall_window)

    def step(quota: Quota, row: tuple) -> tuple:
        _, key, event, at = row
        return key, event, *quota.charge(key, at)

    rows = requests.select(F.lit(0).alias("_one"), "key", "event_id", "at")
    return walked(rows, "_one", ["at", "event_id"], Walk(begin, step, Quota.dump, lambda x: begin().load(x)), "key long, event_id long, verdict string, retry_after long", slices)


def served(requests: DataFrame, size: int, per_key: int, key_window: float, overall: int, overall_window: float, slices: int | None = None) -> DataFrame:
    """(event_id, verdict, retry_after) of requests (key, event_id, at, name, passed, refused) that one cache and two quotas decide together.

    In the order of their times: an answer that is kept under the request's name is a hit (``cache``); what doesn't pass the first gate
    calls no model (``gate 1``); a call is charged or refused (``overall`` or ``key``); a charged call's answer is a refusal
    (``gate 2``) or good (``live``), and only then it is kept. So an answer that a quota refused is never there for a later request.
    """
    quota = lambda: Quota(per_key, key_window, overall, overall_window)

    def step(state: tuple[Answers, Quota], row: tuple) -> tuple:
        cache, left = state
        _, key, event, at, name, passed, refused = row
        if cache.get(name):
            return event, "cache", 0
        if not passed:
            return event, "gate 1", 0
        verdict, wait = left.charge(key, at)
        if verdict != "ok":
            return event, verdict, wait
        if refused:
            return event, "gate 2", 0
        cache.put(name)
        return event, "live", 0

    walk = Walk(lambda: (Answers(size), quota()), step, lambda s: [list(s[0].names), s[1].dump()], lambda x: (Answers(size).load(x[0]), quota().load(x[1])))
    rows = requests.select(F.lit(0).alias("_one"), "key", "event_id", "at", "name", "passed", "refused")
    return walked(rows, "_one", ["at", "event_id"], walk, "event_id long, verdict string, retry_after long", slices)


def quota_left(charges: DataFrame, per_key: int, window: float) -> DataFrame:
    """(event_id, remaining) after each request of ``charges`` (key, event_id, at, verdict): charged requests count, others don't."""
    micros = F.round(F.col("at") * 1_000_000).cast("long")
    of = Window.partitionBy("key").orderBy("us").rangeBetween(-int(window * 1_000_000) + 1, 0)
    return charges.withColumn("us", micros).select("event_id", F.greatest(F.lit(0), per_key - F.count_if(F.col("verdict") == "ok").over(of)).cast("long").alias("remaining"))


def cache_hits(requests: DataFrame, size: int, slices: int | None = None) -> DataFrame:
    """(event_id, hit) for requests (user, event_id, key) in order of event_id within a user's cache of ``size`` answers.

    Least recently used answers go first. With a column ``refused``, an answer that is a refusal is not kept; with a column
    ``generation``, answers of an earlier state of the index don't count. A size of 0 keeps nothing.
    """
    refused = F.col("refused") if "refused" in requests.columns else F.lit(False)
    version = F.col("generation").cast("long") if "generation" in requests.columns else F.lit(0).cast("long")
    rows = requests.select("user", "event_id", F.col("key").cast("string").alias("key"), refused.alias("refused"), version.alias("generation"))

    def step(cache: Answers, row: tuple) -> tuple:
        _, event, key, refused, version = row
        name = f"{version}:{key}"
        hit = cache.get(name)
        if not hit and not refused:
            cache.put(name)
        return event, hit

    walk = Walk(lambda: Answers(size), step, lambda cache: list(cache.names), lambda names: Answers(size).load(names))
    return walked(rows, "user", ["event_id"], walk, "event_id long, hit boolean", slices)


def cache_stats(hits: DataFrame) -> DataFrame:
    """One row: hits and misses."""
    return hits.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
