import math
import os
import random

import pytest

from idloom.llm import encode as E
from idloom.llm.mix import frame_ends, mix, pfair, quotas


def test_pfair_deviates_by_less_than_a_block():
    rnd = random.Random(1)
    for _ in range(60):
        blocks = [rnd.randrange(0, 40) for _ in range(rnd.randint(1, 8))]
        order = pfair(blocks)
        n, seen = sum(blocks), [0] * len(blocks)
        assert len(order) == n
        for t, s in enumerate(order, 1):
            seen[s] += 1
            assert all(abs(seen[i] * n - t * blocks[i]) < n for i in range(len(blocks)))
        assert seen == blocks


def test_quotas_fill_from_the_rest():
    assert quotas([0.5, 0.5], [1000, 1000], 1000) == [500, 500]
    assert quotas([0.5, 0.5], [100, 10_000], 1000) == [100, 900]
    assert quotas([0.2, 0.8, 0.0], [10, 20, 99], 1000) == [10, 20, 0]
    assert quotas([], [], 0) == [] and quotas([0.0], [5], 5) == [0]


def test_frames_keep_every_source_within_a_block():
    """Two slots are a block: no source is two slots from its share at any slot of any frame."""
    rnd = random.Random(2)
    for _ in range(300):
        slots = [rnd.choice([0, 1, 2, rnd.randrange(0, 60), rnd.randrange(0, 9)]) for _ in range(rnd.randint(1, 9))]
        n, frame = sum(slots), rnd.choice([1, 2, 3, 5, 8, 16])
        if not n:
            continue
        before, seen, t = [0] * len(slots), [0] * len(slots), 0
        for now in frame_ends(slots, frame):
            assert all(x <= y for x, y in zip(before, now, strict=True)) and sum(now) == min(t + frame, n)
            assert all(abs(y * n - sum(now) * b) < n for y, b in zip(now, slots, strict=True))
            for s in pfair([y - x for x, y in zip(before, now, strict=True)]):
                t += 1
                seen[s] += 1
                assert all(abs(seen[i] * n - t * slots[i]) < 2 * n for i in range(len(slots)))
            before = now
        assert seen == slots


@pytest.mark.skipif(not os.path.isdir(E.TOKENIZERS), reason="no tokenizers here")
def test_mix(spark):
    rows = [(i, "word " * 20, " Mail ") for i in range(200)] + [(1000 + i, "other " * 20, "web") for i in range(10)] + [(2000, None, "web"), (2001, "", "web"), (2002, "x y", None), (2003, "x y", "none"), (2004, "x", "unasked")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, source string, n_tokens string")
    targets = spark.createDataFrame([("m", "mail", 0.5, 2), ("m", "WEB", 0.5, 3), ("m", "nowhere", 0.0, 1), ("n", "web", 1.0, 1), ("n", "mail", None, 4), (None, "web", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    m = mix(docs, targets, "doc_id", "text", "source")
    got = {(r.mix_id, r.source): r for r in m.report.collect()}
    assert set(got) == {("m", "mail"), ("m", "web"), ("m", "nowhere"), ("n", "web"), ("n", "mail")}
    assert got["m", "web"].records == 30 and got["m", "web"].max_pass == 3
    assert got["n", "web"].actual_share == 1.0 and got["n", "mail"].tokens == 0 and got["m", "nowhere"].actual_share == 0.0
    assert math.isclose(sum(r.actual_share for k, r in got.items() if k[0] == "m"), 1.0)
    rec = m.records.collect()
    assert len({(r.mix_id, r.doc_id, r["pass"]) for r in rec}) == len(rec)
    assert {r.doc_id for r in rec}.isdisjoint({2000, 2001, 2002, 2003, 2004})
    assert mix(docs.limit(0), targets, "doc_id", "text", "source").records.count() == 0
    assert mix(docs, targets.limit(0), "doc_id", "text", "source").records.count() == 0


@pytest.mark.skipif(not os.path.isdir(E.TOKENIZERS), reason="no tokenizers here")
def test_records_lie_in_order_and_in_their_shares(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 30), "ab"[i % 4 == 0]) for i in range(2000)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "a", 0.3, 1), ("m", "b", 0.7, 9)], "mix_id string, source string, target_share double, max_repeats int")
    m = mix(docs, targets, "doc_id", "text", "source", block_tokens=256)
    rec = sorted(m.records.collect(), key=lambda r: (r.slot, r.offset))
    # The records of a slot begin one after the other, but for the tokens of one that began in the slot before.
    for a, b in zip(rec, rec[1:], strict=False):
        assert a.slot < b.slot or a.offset + a.n_tokens == b.offset and a.source == b.source
    total, largest, got, quota = sum(r.n_tokens for r in rec), max(r.n_tokens for r in rec), {}, {r.source: r.quota for r in m.plans.collect()}
    share = {s: q / sum(quota.values()) for s, q in quota.items()}
    done = 0
    for r in rec:
        got[r.source] = got.get(r.source, 0) + r.n_tokens
        done += r.n_tokens
        assert all(abs(got.get(s, 0) - w * done) <= 256 + 2 * largest + 128 for s, w in share.items())
    assert {r.source: round(r.actual_share, 2) for r in m.report.collect()} == {s: round(w, 2) for s, w in share.items()} and total
