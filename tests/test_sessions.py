import random

from idloom.operators.sessions import sessionize


def brute(events, gap):
    seen, by = {}, {}
    for e, d, us in events:
        if d is None or us is None:
            continue
        if e is None:
            by.setdefault(d, []).append(us)
        elif e not in seen or (us, d) < seen[e]:
            seen[e] = (us, d)
    for us, d in seen.values():
        by.setdefault(d, []).append(us)
    out = []
    for d, ts in by.items():
        ts.sort()
        run = [ts[0]]
        for t in ts[1:]:
            if t - run[-1] > gap:
                out.append((d, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.append((d, run[0], run[-1], len(run)))
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    events = []
    for i in range(3000):
        d = rnd.choice(["hot"] * 5 + ["a", "b", None])
        us = rnd.choice([None, *[rnd.randrange(-2_000_000, 9_000_000)] * 30])
        events.append((None if rnd.random() < 0.02 else f"e{rnd.randrange(2500)}", d, us))
    events += [("g1", "edge", 0), ("g2", "edge", 1000), ("g3", "edge", 2001), ("g4", "far", 0), ("g5", "far", 1000 * 4096 * 3)]
    df = spark.createDataFrame([(*e, "x", 1) for e in events], "event_id string, dev string, us bigint, start_us string, _k int")
    for gap in (1000, 37):
        got = sorted((r.dev, r.start_us, r.end_us, r.n_events) for r in sessionize(df, "dev", "us", gap, "event_id").collect())
        assert got == brute(events, gap)


def test_empty_and_duration(spark):
    df = spark.createDataFrame([], "event_id string, dev string, us bigint")
    assert sessionize(df, "dev", "us", 10, "event_id").count() == 0
    df = spark.createDataFrame([("a", "d", 5), ("b", "d", 9)], "event_id string, dev string, us bigint")
    assert sessionize(df, "dev", "us", 10, "event_id").first().duration_us == 4
