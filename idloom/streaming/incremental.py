"""Incremental resolution and upserts over versioned Parquet state, driven by batches or Structured Streaming.

Watermarks are on ingestion time, so data late in world time is accepted. State is replaced by a new version, never
changed in place; a reader of the version before is not disturbed, and a failed batch leaves it current.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.functions.ids import make_id
from idloom.operators.graph import propagate, resolve
from idloom.operators.relational import latest
from idloom.storage import cut

MAPPING = "entity_type string, identifier_type string, identifier_value string, entity_id string, previous_entity_id string, resolution_reason string, resolved_at_watermark timestamp_ntz"


class State:
    """A table in numbered versions under a folder; the file CURRENT names the one that counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> dict[int, str]:
        root = self._p(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return {int(n[1:].split("-")[0]): n for n in names if n.startswith("v") and self._fs.exists(self._p(f"{self.path}/{n}/_SUCCESS"))}

    def version(self) -> int:
        return max(self._versions(), default=-1)

    def batch(self) -> int:
        """The last batch that the current version holds; -1 if none was named."""
        v = self._versions()
        name = v[max(v)] if v else ""
        return int(name.split("-b")[1]) if "-b" in name else -1

    def read(self, schema: str) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(schema).parquet(f"{self.path}/{v[max(v)]}") if v else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, batch: int | None = None) -> None:
        """A new version; it counts once its success marker exists, and so does the batch, as the folder's name holds it.
        Versions before the last one are dropped."""
        old = self._versions()
        v = max(old, default=-1) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{v}" + ("" if batch is None else f"-b{batch}"))
        for n, name in old.items():
            if n <= v - 2:
                self._fs.delete(self._p(f"{self.path}/{name}"), True)


def upgrade_guard(df: DataFrame, required: list[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError("the stored state lacks " + ", ".join(missing) + "; rebuild it with a full run")


def watermark(df: DataFrame, column: str = "_ingested_at"):
    """The greatest ingestion time, None if there is none."""
    return df.agg(F.max(column)).first()[0]


def after(df: DataFrame, mark, column: str = "_ingested_at") -> DataFrame:
    """Rows strictly later than a watermark (all rows without one)."""
    return df if mark is None else df.where(F.col(column) > F.lit(mark))


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], order: str = "_ingested_at") -> DataFrame:
    """The state with the batch's latest row of each key in place of its own; new columns are appended."""
    new = latest(batch, keys, [order])
    return state.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def touched_groups(upstream: DataFrame, rollup: DataFrame, keys: list[str], mark: str = "_watermark_ingested_at") -> DataFrame:
    """All rows of the groups that have rows past the rollup's watermark (null-safe), for the unchanged aggregation."""
    m = watermark(rollup, mark)
    if m is None:
        return upstream
    t = upstream.where(F.col("_ingested_at") > F.lit(m)).select(*[F.col(k).alias("_" + k) for k in keys]).distinct()
    cond = None
    for k in keys:
        c = upstream[k].eqNullSafe(t["_" + k])
        cond = c if cond is None else cond & c
    return upstream.join(t, cond, "left_semi")


def resolve_batch(state: DataFrame, identifiers: DataFrame, entity_type: str, max_iterations: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(new state, log rows) after the identifiers ingested past the state's watermark.

    The delta's identifiers are contracted: those that the state knows stand for their entity, the others for themselves.
    Components of this small graph are found by least labels. A component's survivor is the known entity with most rows
    (then the least id), or a new entity named by its least identifier. Log: born, accreted, repointed; a re-observed
    identifier only advances the watermark. An empty delta returns the state itself and no log.
    """
    ids = identifiers.where((F.col("entity_type") == entity_type) & F.col("identifier_value").isNotNull())
    own = state.where(F.col("entity_type") == entity_type)
    delta = after(ids, watermark(own, "resolved_at_watermark"))
    empty = state.sparkSession.createDataFrame([], MAPPING)
    if delta.isEmpty():
        return state, empty
    pair = ["identifier_type", "identifier_value"]
    mark = F.lit(watermark(delta)).cast("timestamp_ntz")
    d = cut(delta.select(*pair, "edge_id").distinct().join(own.select(*pair, "entity_id"), pair, "left")).df
    fresh = F.concat(F.lit("i\x01"), "identifier_type", F.lit("\x01"), "identifier_value")
    node = F.when(F.col("entity_id").isNotNull(), F.concat(F.lit("e\x01"), "entity_id")).otherwise(fresh)
    d = d.withColumn("node", node)
    labels = propagate(d.select("node").distinct(), d.where("edge_id is not null").select("node", F.col("edge_id").alias("link")).distinct(), max_iterations)
    sizes = own.groupBy("entity_id").agg(F.count("*").alias("n"))
    known = labels.where(F.col("node").startswith("e\x01")).withColumn("entity_id", F.substring("node", 3, 1_000_000)).join(sizes, "entity_id")
    old = known.groupBy("label").agg(F.min_by("entity_id", F.struct(-F.col("n"), "entity_id")).alias("kept"))
    least = labels.where(F.col("node").startswith("i\x01")).groupBy("label").agg(F.min("node").alias("first"))
    t, v = F.split_part("first", F.lit("\x01"), F.lit(2)), F.split_part("first", F.lit("\x01"), F.lit(3))
    name = labels.select("label").distinct().join(old, "label", "left").join(least, "label", "left").select("label", F.coalesce("kept", make_id(entity_type, t, v)).alias("survivor"), F.col("kept").isNull().alias("is_new"))
    named = cut(labels.join(name, "label").select("node", "survivor", "is_new")).df
    seen = d.select(*pair, "node", "entity_id").distinct().join(named, "node")
    cols = [c.split()[0] for c in MAPPING.split(", ")]
    born = seen.where("entity_id is null").select(F.lit(entity_type).alias("entity_type"), *pair, F.col("survivor").alias("entity_id"), F.lit(None).cast("string").alias("previous_entity_id"), F.when(F.col("is_new"), "born").otherwise("accreted").alias("resolution_reason"), mark.alias("resolved_at_watermark"))
    moved_to = named.where(F.col("node").startswith("e\x01")).select(F.substring("node", 3, 1_000_000).alias("entity_id"), "survivor").where("entity_id <> survivor")
    moved = own.join(moved_to, "entity_id").select("entity_type", *pair, F.col("survivor").alias("entity_id"), F.col("entity_id").alias("previous_entity_id"), F.lit("repointed").alias("resolution_reason"), mark.alias("resolved_at_watermark"))
    log = cut(born.unionByName(moved)).df
    again = seen.where("entity_id is not null").select(*pair).distinct().withColumn("_again", F.lit(True))
    rest = state.join(log.select("entity_type", *pair), ["entity_type", *pair], "left_anti").join(again.withColumn("entity_type", F.lit(entity_type)), ["entity_type", *pair], "left")
    rest = rest.withColumn("resolved_at_watermark", F.when(F.col("_again"), mark).otherwise(F.col("resolved_at_watermark"))).withColumn("resolution_reason", F.when(F.col("_again"), "reobserved").otherwise(F.col("resolution_reason")))
    return rest.select(*cols).unionByName(log.select(*cols)), log


def full_state(identifiers: DataFrame, entity_type: str, max_recursion: int | None = None) -> DataFrame:
    """The first state: a full resolution."""
    m = resolve(identifiers, entity_type, max_recursion)
    return m.select(F.lit(entity_type).alias("entity_type"), "identifier_type", "identifier_value", "entity_id", "previous_entity_id", "resolution_reason", "resolved_at_watermark")


PARTICIPANT_GRAIN = ("event_id", "entity_type", "entity_id", "role")


def repoint_participants(participants: DataFrame, log: DataFrame, state: DataFrame, log_mark=None) -> DataFrame:
    """Participants of merged entities moved to the current entity of their identifiers; their ids stay.

    Only log rows later than ``log_mark`` (all without one) are looked at. They lead to the current state rather than to
    the entity they name, so an unread merge of A into B followed by one of B into C leads from A to C at once. The
    identifiers of a merged entity stay together, so there is one current entity for it.
    """
    pair = ["entity_type", "identifier_type", "identifier_value"]
    lost = after(log, log_mark, "resolved_at_watermark").where("resolution_reason = 'repointed'").select(*pair, "previous_entity_id")
    lost = lost.join(state.select(*pair, F.col("entity_id").alias("_now")), pair).groupBy("entity_type", F.col("previous_entity_id").alias("entity_id")).agg(F.max("_now").alias("_now"))
    return participants.join(lost, ["entity_type", "entity_id"], "left").withColumn("entity_id", F.coalesce("_now", "entity_id")).drop("_now").select(*participants.columns)


def _grouped(rows: DataFrame) -> DataFrame:
    g = rows.groupBy("entity_type", "event_id", "entity_id", "role", "occurred_at").agg(F.max("_ingested_at").alias("_ingested_at"))
    return g.select(make_id("entity_participant", "event_id", "entity_id", "role").alias("entity_participant_id"), "entity_type", "event_id", "entity_id", "role", "occurred_at", "_ingested_at")


def new_participants(identifiers: DataFrame, state: DataFrame, mark=None) -> DataFrame:
    """Participants of resolved types from the identifiers ingested past ``mark``."""
    pair = ["entity_type", "identifier_type", "identifier_value"]
    return _grouped(after(identifiers, mark).join(state.select(*pair, "entity_id"), pair))


def new_registered_participants(identifiers: DataFrame, registered: dict[str, DataFrame], mark=None) -> DataFrame:
    """Participants of types that are registered, not resolved: the identifier's value is the entity's source id."""
    late = after(identifiers, mark)
    own = [r.select(F.lit(t).alias("entity_type"), F.col("source_id").alias("identifier_value"), "entity_id") for t, r in registered.items()]
    if not own:
        return _grouped(late.withColumn("entity_id", F.lit(None).cast("string")).limit(0))
    return _grouped(late.join(reduce(DataFrame.unionByName, own), ["entity_type", "identifier_value"]))


def append_participants(current: DataFrame, batch: DataFrame) -> DataFrame:
    """``current`` with the batch's rows merged in by id.

    A row offered again after a merge gets a new id for a grain (event, type, entity, role) that exists under the id from
    before the merge; such rows are left out. Rows of equal id replace the current ones.
    """
    known = current.select(*[F.col(c).alias("_" + c) for c in PARTICIPANT_GRAIN], F.col("entity_participant_id").alias("_id"))
    same = reduce(lambda a, b: a & b, [batch[c].eqNullSafe(known["_" + c]) for c in PARTICIPANT_GRAIN])
    fresh = batch.join(known, same & (batch["entity_participant_id"] != known["_id"]), "left_anti")
    return current.join(fresh.select("entity_participant_id"), "entity_participant_id", "left_anti").select(*current.columns).unionByName(fresh, allowMissingColumns=True)


def participants_step(current: DataFrame, identifiers: DataFrame, state: DataFrame, log: DataFrame, registered: dict[str, DataFrame] | None = None, mark=None, log_mark=None) -> tuple[DataFrame, object, object]:
    """(participants, mark, log mark) after one incremental run: merged entities are repointed first, then the rows of both
    kinds of types are appended. The marks returned are the greatest seen, to be handed to the next run."""
    moved = repoint_participants(current, log, state, log_mark)
    batch = new_participants(identifiers, state, mark)
    if registered:
        batch = batch.unionByName(new_registered_participants(identifiers, registered, mark))
    later = [m for m in (mark, watermark(identifiers)) if m is not None]
    log_later = [m for m in (log_mark, watermark(log, "resolved_at_watermark")) if m is not None]
    return append_participants(moved, batch), max(later, default=None), max(log_later, default=None)


def resolver_sink(state: State, log_path: str, entity_type: str):
    """A foreachBatch function that resolves each micro-batch into versioned state and an append-only log with a folder
    per batch.

    The log is written first, the state with the batch's number after it. A batch that the state holds already is not run
    again, so its log rows stay; one that failed between the two is, and gives the same rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if state.batch() >= batch_id:
            return
        old = state.read(MAPPING)
        new, changes = resolve_batch(old, batch, entity_type)
        changes.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        if new is not old:
            state.write(new, batch_id)

    return run
