"""The limiter in batch against a plain loop."""

import random
from datetime import datetime, timedelta

from tidemark.streaming import limiter


def judged(events):
    state, out = {}, []
    for client, action, ts in sorted(events, key=lambda e: e[2]):
        if action in limiter.EXEMPT:
            out.append((client, action, ts, True, None))
            continue
        most, seconds = limiter.LIMITS.get(action, limiter.OTHER)
        count, ends = state.get((client, action), (0, datetime.min))
        if ts >= ends:
            count, ends = 0, ts + timedelta(seconds=seconds)
        state[client, action] = count + 1, ends
        out.append((client, action, ts, count + 1 <= most, max(0, most - count - 1)))
    return out


def test_limits_of_actions():
    assert [limiter._limit(a) for a in ("pagespeed", "site-audit", "contact", "anything")] == [(20, 60), (40, 60), (5, 600), (60, 60)]
    assert limiter.EXEMPT == ["health", "google-callback", "google-auth"]


def test_batch_agrees_with_a_loop(spark):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    events = []
    for client, action, gap in (("a", "contact", 90), ("a", "pagespeed", 1.3), (None, "site-audit", 0.7), ("b", None, 40), ("b", "health", 5), ("c", "contact", 5_000), ("c", "x", 59.9999)):
        at = start
        for _ in range(300):
            at += timedelta(microseconds=int(rng.choice([0, 1, 1, 2]) * gap * 1e6 * rng.random()))
            events.append((client, action, at))
    events += [("edge", "x", start + timedelta(seconds=60 * k)) for k in range(40)] + [("edge", "x", start + timedelta(seconds=60 * k - 1e-6)) for k in range(1, 40)] + [("none", "x", None)]
    schema = "client string, action string, ts timestamp"
    got = limiter.limit(spark.createDataFrame(events, schema).repartition(5))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, judged([e for e in events if e[2]])))
    assert limiter.limit(spark.createDataFrame([], schema)).count() == 0
