"""Deterministic prefixed identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of identifiers; any other kind takes its first three letters.
PREFIXES = {
    "event": "evt", "person": "per", "group": "grp", "membership": "mem", "relationship": "rel", "state": "st", "entity_state": "es", "person_identifier": "per_idfr", "group_identifier": "grp_idfr",
    "entity_identifier": "ent_idfr", "person_trait": "per_tr", "group_trait": "grp_tr", "entity_trait": "ent_tr", "relationship_declaration": "rel_decl", "person_edge": "per_edg", "group_edge": "grp_edg",
    "entity_edge": "ent_edg", "person_participant": "per_prt", "group_participant": "grp_prt", "touchpoint": "tch", "attribution_deduplication_key": "att_dedup", "touchpoint_path": "tch_path",
    "touchpoint_path_batch": "tch_batch", "attribution_model_result": "attr_res", "event_measurement": "evt_msr", "event_dimension": "evt_dim", "anomaly": "anom", "computed_trait": "ct", "scope": "scp", "auth_identity": "auth",
}
#: Fixed value: what a null part of a key is hashed as.
NULL_PART = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*parts: Column | str) -> Column:
    """MD5 of the parts as text joined by '-'."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit(NULL_PART)) for p in parts]
    return F.md5(F.concat_ws("-", *cols))


def make_id(kind: str, *parts: Column | str) -> Column:
    """``prefix_md5`` of a kind of record."""
    return F.concat(F.lit(PREFIXES.get(kind, kind[:3]) + "_"), surrogate_key(*parts))
