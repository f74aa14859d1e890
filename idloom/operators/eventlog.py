"""The unified event log: source relations forced into fixed contracts and unioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.functions.ids import make_id
from idloom.operators.relational import latest, union_aligned

# The contracts' columns and types.
EVENT = {"event_id": "string", "occurred_at": "timestamp_ntz", "event_name": "string", "event_description": "string", "event_type": "string", "significance": "double", "source": "string", "source_table": "string", "_ingested_at": "timestamp_ntz"}
IDENTIFIER = {"entity_identifier_id": "string", "event_id": "string", "edge_id": "string", "entity_type": "string", "identifier_type": "string", "identifier_value": "string", "role": "string", "source": "string", "occurred_at": "timestamp_ntz", "_ingested_at": "timestamp_ntz"}
TRAIT = {"entity_trait_id": "string", "event_id": "string", "entity_type": "string", "identifier_type": "string", "identifier_value": "string", "trait_name": "string", "trait_value": "string", "source": "string", "occurred_at": "timestamp_ntz"}
DECLARATION = {
    "relationship_declaration_id": "string", "event_id": "string", "occurred_at": "timestamp_ntz", "entity_a_identifier": "string", "entity_a_identifier_type": "string", "entity_a_type": "string", "entity_a_role": "string",
    "entity_b_identifier": "string", "entity_b_identifier_type": "string", "entity_b_type": "string", "entity_b_role": "string", "relationship_type": "string", "relationship_direction": "string", "is_active": "boolean", "source": "string",
}
DIMENSION = {"event_dimension_id": "string", "event_id": "string", "dimension_name": "string", "dimension_value": "string", "occurred_at": "timestamp_ntz", "source": "string", "_ingested_at": "timestamp_ntz"}
MEASUREMENT = {"event_measurement_id": "string", "event_id": "string", "measurement_name": "string", "value": "double", "value_unit": "string", "occurred_at": "timestamp_ntz", "source": "string", "_ingested_at": "timestamp_ntz"}
STATE = {"entity_id": "string", "entity_type": "string", "state_name": "string", "state_value": "string", "state_numeric_value": "double", "state_category": "string", "state_entered_at": "timestamp_ntz", "state_exited_at": "timestamp_ntz", "is_current": "boolean", "trigger_event_id": "string"}
COMPUTED = {"computed_trait_id": "string", "entity_id": "string", "entity_type": "string", "trait_name": "string", "trait_value": "string", "source": "string", "computed_at": "timestamp_ntz"}


def conform(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """Exactly the contract's columns and types; missing ones are typed nulls."""
    return df.select(*[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in contract.items()])


def union(parts: list[DataFrame], contract: dict[str, str]) -> DataFrame:
    return union_aligned([conform(p, contract) for p in parts])


def require_ingested_at(parts: dict[str, DataFrame]) -> None:
    missing = [n for n, d in parts.items() if "_ingested_at" not in d.columns]
    if missing:
        raise ValueError("incremental mode needs _ingested_at in: " + ", ".join(sorted(missing)))


def events(parts: list[DataFrame], since=None) -> DataFrame:
    """The event log. With ``since`` only rows ingested later, the latest row of each event."""
    e = union(parts, EVENT)
    return e if since is None else latest(e.where(F.col("_ingested_at") > F.lit(since)), ["event_id"], ["_ingested_at"])


def identifiers(parts: list[DataFrame]) -> DataFrame:
    """Identifier rows with normalized_value (informational: resolution uses the raw value)."""
    i = union(parts, IDENTIFIER).withColumn("_ingested_at", F.coalesce("_ingested_at", "occurred_at"))
    t, v = F.col("identifier_type"), F.col("identifier_value")
    return i.withColumn("normalized_value", F.when(t.isin("email", "domain"), F.lower(v)).when(t == "phone", F.regexp_replace(v, "[^0-9]", "")).otherwise(v))


def traits(parts: list[DataFrame], person_emails: DataFrame | None = None, internal_emails: tuple[str, ...] = ()) -> DataFrame:
    """Trait rows, plus is_internal_user = 'true' for the identifier rows of internal addresses."""
    t = union(parts, TRAIT)
    if person_emails is None or not internal_emails:
        return t
    hit = person_emails.where((F.col("identifier_type") == "email") & F.lower("identifier_value").isin(*internal_emails) & (F.col("entity_type") == "person"))
    extra = hit.select(make_id("entity_trait", "event_id", "identifier_value", F.lit("is_internal_user")).alias("entity_trait_id"), "event_id", "entity_type", "identifier_type", "identifier_value", F.lit("is_internal_user").alias("trait_name"), F.lit("true").alias("trait_value"), "source", "occurred_at")
    return t.unionByName(conform(extra, TRAIT))


def declarations(parts: list[DataFrame]) -> DataFrame:
    return union(parts, DECLARATION)


def _lowered(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.lower(c) for c in cols})


def _since(df: DataFrame, since, key: str) -> DataFrame:
    return df if since is None else latest(df.where(F.col("_ingested_at") > F.lit(since)), [key], ["_ingested_at"])


def dimensions(parts: list[DataFrame], since=None) -> DataFrame:
    return _since(_lowered(union(parts, DIMENSION), "dimension_name", "source"), since, "event_dimension_id")


def measurements(parts: list[DataFrame], since=None) -> DataFrame:
    return _since(_lowered(union(parts, MEASUREMENT), "measurement_name", "value_unit", "source"), since, "event_measurement_id")


def computed_traits(parts: list[DataFrame]) -> DataFrame:
    return _lowered(union(parts, COMPUTED), "entity_type", "trait_name", "source")


def states(parts: list[DataFrame]) -> DataFrame:
    """State rows with their id; a missing category is 'dimension'."""
    s = union(parts, STATE).withColumn("state_category", F.coalesce("state_category", F.lit("dimension")))
    return s.select(make_id("state", "entity_id", "state_name", "state_value", "state_entered_at").alias("state_id"), *STATE)
