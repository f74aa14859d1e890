"""Mixing sources to target weights by Pfair scheduling.

A mix has a total size in tokens. Each source's quota is its share of it, at most what its records give when each is used
``max_repeats`` times; what capped sources leave goes to the others in proportion to their shares, as far as they reach.
The mix is laid out in slots of half a block of tokens, whatever its size. A source's slot i of weight w has the release
time floor(i / w) and the deadline ceil((i + 1) / w); of the released ones the one with the earliest deadline goes first, so
a source is less than a slot from its share. Mixes of many slots are scheduled frame by frame in parallel: at each frame's
end every source stands less than a slot from its share, and within a frame it is less than a slot from the frame's own
line, so it is never a whole block ahead or behind. A source's records fill its slots in a fixed shuffled order, pass
after pass.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idloom.functions.text import norm_text
from idloom.llm.encode import TOKENIZERS, VOCABULARY, token_counts
from idloom.operators.skew import join_label
from idloom.storage import cut

#: Tokens of a block; no source is ever this far from its share.
BLOCK_TOKENS = 8192
#: Slots of one frame, which one task schedules.
FRAME_SLOTS = 4096
#: Records of one prefix-sum bucket.
BUCKET_ROWS = 20_000


def quotas(shares: list[float], capacity: list[int], total: int) -> list[int]:
    """Tokens for each source: total x share, at most its capacity, the rest shared out among sources with room in
    proportion to their shares. Shares need not sum to 1; sources without share get nothing."""
    n = len(shares)
    got = [0.0] * n
    room = {i for i in range(n) if shares[i] > 0 and capacity[i] > 0}
    left = float(min(total, sum(capacity[i] for i in room)))
    while room and left > 0.5:
        weight = sum(shares[i] for i in room)
        full = {i for i in room if got[i] + left * shares[i] / weight >= capacity[i]}
        if not full:
            for i in room:
                got[i] += left * shares[i] / weight
            break
        for i in full:
            left -= capacity[i] - got[i]
            got[i] = float(capacity[i])
        room -= full
    return [min(capacity[i], round(got[i])) for i in range(n)]


def pfair(blocks: list[int]) -> list[int]:
    """The source of each slot when source i has blocks[i] blocks: earliest deadline first among released blocks, ties by
    the shorter window, then the source. len = sum(blocks)."""
    n = sum(blocks)
    waiting = []  # (release, source, block)
    for s, b in enumerate(blocks):
        if b:
            heapq.heappush(waiting, (0, s, 0))
    ready: list[tuple] = []
    out = []
    for t in range(n):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            deadline = -(-(i + 1) * n // blocks[s])
            # b-bit and weight as in PD2: a window that overlaps the next, then the heavier source.
            overlap = ((i + 1) * n) % blocks[s] != 0
            heapq.heappush(ready, (deadline, not overlap, -blocks[s], s, i))
        _, _, _, s, i = heapq.heappop(ready)
        out.append(s)
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, ((i + 1) * n // blocks[s], s, i + 1))
    return out


def frame_ends(slots: list[int], frame: int = FRAME_SLOTS) -> Iterator[list[int]]:
    """How many slots of each source lie before each frame's end: at time t either floor or ceil of t x weight, and never
    fewer than before. What is begun stays begun; then the earliest deadline goes first."""
    n = sum(slots)
    done = [0] * len(slots)
    for t in range(frame, n + frame, frame):
        t = min(t, n)
        least = [t * b // n for b in slots]
        open_ = [s for s, b in enumerate(slots) if t * b % n]
        free = t - sum(least)
        open_.sort(key=lambda s: (done[s] <= least[s], -(-(least[s] + 1) * n // slots[s]), -slots[s], s))
        done = least
        for s in open_[:free]:
            done[s] += 1
        yield done[:]


def plan(targets: DataFrame, sizes: DataFrame, slot_tokens: int) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, available, quota, slots): the quota of each source of each mix.

    targets: (mix_id, source, target_share, max_repeats); sizes: (source, available). The total of a mix is what its
    sources with a share hold once. Both tables have a row per source and are gathered by mix. Null, negative or
    not finite shares and null repeats count as 0, repeated targets of one source as their first by share.
    """

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("source").reset_index(drop=True)
        capacity = [int(a) * int(m) for a, m in zip(b["available"], b["max_repeats"], strict=True)]
        total = int(b.loc[(b["target_share"] > 0) & (b["max_repeats"] > 0), "available"].sum())
        q = quotas(list(b["target_share"]), capacity, total)
        return b.assign(quota=q, slots=[-(-x // slot_tokens) for x in q])[["mix_id", "source", "target_share", "max_repeats", "available", "quota", "slots"]]

    t = targets.select("mix_id", norm_text(F.col("source")).alias("source"), F.col("target_share").alias("_s"), F.col("max_repeats").alias("_m")).where("mix_id is not null and source is not null")
    share = F.when(F.col("_s").isNotNull() & ~F.isnan("_s") & (F.col("_s") > 0) & (F.col("_s") < float("inf")), F.col("_s")).otherwise(0.0)
    t = t.groupBy("mix_id", "source").agg(F.max(F.struct(share.alias("s"), F.greatest(F.coalesce("_m", F.lit(0)), F.lit(0)).alias("m"))).alias("x"))
    t = t.select("mix_id", "source", F.col("x.s").alias("target_share"), F.col("x.m").alias("max_repeats")).join(sizes, "source", "left").fillna(0, ["available"])
    return t.groupBy("mix_id").applyInPandas(run, "mix_id string, source string, target_share double, max_repeats int, available bigint, quota bigint, slots bigint")


def schedule(plans: DataFrame, frame: int = FRAME_SLOTS) -> DataFrame:
    """(mix_id, slot, source, part): which part of which source each slot takes.

    Only the frames' ends are found one after the other, in a task per mix; the slots within are scheduled frame by
    frame wherever there is room.
    """

    def ends(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("source").reset_index(drop=True)
        slots = [int(x) for x in b["slots"]]
        rows, before = [], [0] * len(slots)
        for f, now in enumerate(frame_ends(slots, frame)):
            rows += [(b.at[0, "mix_id"], f, b.at[s, "source"], x, y - x) for s, (x, y) in enumerate(zip(before, now, strict=True)) if y > x]
            before = now
        return pd.DataFrame(rows, columns=["mix_id", "frame", "source", "first", "n"])

    def within(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("source").reset_index(drop=True)
        order = pfair([int(x) for x in b["n"]])
        at, names, start = [int(x) for x in b["first"]], list(b["source"]), int(b.at[0, "frame"]) * frame
        parts = []
        for s in order:
            parts.append(at[s])
            at[s] += 1
        return pd.DataFrame({"mix_id": b.at[0, "mix_id"], "slot": range(start, start + len(order)), "source": [names[s] for s in order], "part": parts})

    frames = plans.where("slots > 0").groupBy("mix_id").applyInPandas(ends, "mix_id string, frame bigint, source string, first bigint, n bigint")
    return frames.groupBy("mix_id", "frame").applyInPandas(within, "mix_id string, slot bigint, source string, part bigint")


def positions(records: DataFrame, row_id: str) -> DataFrame:
    """(source, row_id, n_tokens, before): the tokens of a source before each record in its shuffled order.

    Two levels of prefix sums: records fall by a hash into buckets of about BUCKET_ROWS, sums run within a bucket and over
    the buckets, so no task holds a source, even one with most of the records.
    """
    rows = records.count()
    n = max(1, -(-rows // BUCKET_ROWS))
    r = records.withColumn("_h", F.xxhash64(F.col(row_id), F.lit(17))).withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(n)))
    sums = r.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_sum"))
    over = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_b", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    within = Window.partitionBy("source", "_b").orderBy("_h", row_id).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return r.join(sums, ["source", "_b"]).select("source", row_id, "n_tokens", (F.col("_base") + F.col("_in")).alias("before"))


class Mix:
    """The parts of a mixing run: ``records`` (mix_id, row_id, source, pass, slot, offset, n_tokens) and ``report``."""

    def __init__(self, records: DataFrame, report: DataFrame, plans: DataFrame, slots: DataFrame):
        self.records, self.report, self.plans, self.slots = records, report, plans, slots


def mix(documents: DataFrame, targets: DataFrame, row_id: str, text: str, source: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> Mix:
    """Combine records so that each source has its share of the tokens.

    A record is used whole: pass p of a source takes it while its first token lies within the quota, so a source passes
    its quota by less than one record. ``pass`` counts from 1 to max_repeats; ``slot`` is the place of its first token in
    the schedule and ``offset`` that token's place in the slot, so (slot, offset) orders a mix. Records without tokens
    (null and empty texts) and those of null-like sources or sources without a target are in no mix. Sources are compared
    trimmed and in lower case. A target without records, share or repeats reports 0.

    Nothing that grows with the documents or the mixes is broadcast: what a source owes to all mixes is one row, joined
    to its records in parts where it has many, and slots are joined by (mix, source, part), which a slot's tokens bound.
    """
    slot_tokens = max(1, block_tokens // 2)
    sized = token_counts(documents.select(F.col(row_id).alias("_id"), norm_text(F.col(source)).alias("source"), F.col(text).alias("_t")), "_t", tokenizers, vocabulary)
    sized = cut(sized.where("source is not null and n_tokens > 0")).df
    sizes = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("_rows"))
    plans = cut(plan(targets, sizes.select("source", "available"), slot_tokens)).df
    slots = cut(schedule(plans)).df
    used = plans.where("quota > 0").groupBy("source").agg(F.collect_list(F.struct("mix_id", "quota", "available")).alias("_mixes"))
    used = used.join(sizes.select("source", "_rows"), "source")
    rows = join_label(positions(sized, "_id"), used, "source", "_rows", "_id").withColumn("_m", F.explode("_mixes"))
    rows = rows.select("source", "_id", "n_tokens", "before", "_m.*")
    rows = rows.withColumn("_passes", F.expr("case when before < quota then (quota - before - 1) div available + 1 else 0 end")).where("_passes > 0")
    rows = rows.withColumn("_p", F.explode(F.expr("sequence(0L, _passes - 1)"))).withColumn("_at", F.expr("_p * available + before"))
    rows = rows.withColumns({"part": F.expr(f"_at div {slot_tokens}"), "offset": F.expr(f"_at % {slot_tokens}")})
    rows = rows.join(slots, ["mix_id", "source", "part"])
    records = rows.select("mix_id", F.col("_id").alias(row_id), "source", (F.col("_p") + 1).alias("pass"), "slot", "offset", "n_tokens")
    return Mix(records, report(records, plans), plans, slots)


def report(records: DataFrame, plans: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, actual_share, tokens, records, max_pass): the shares reached."""
    got = records.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"), F.max("pass").alias("max_pass"))
    r = plans.select("mix_id", "source", "target_share", "max_repeats", "available").join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "records", "max_pass"])
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return r.select("mix_id", "source", "target_share", F.coalesce(F.col("tokens") / F.when(total > 0, total), F.lit(0.0)).alias("actual_share"), "tokens", "records", "available", "max_repeats", "max_pass")
