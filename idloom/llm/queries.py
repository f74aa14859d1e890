"""Queries of the training-data problems over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from idloom.llm.email import own_text_lines
from idloom.llm.encode import encode_corpus
from idloom.llm.groups import group_identifiers
from idloom.llm.mix import mix
from idloom.llm.residue import residue


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return group_identifiers(_read(spark, sf, "segment_entity_identifiers"), "entity_type", "edge_id", "identifier_type", "identifier_value")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return own_text_lines(_read(spark, sf, "gmail_message_bodies"), _read(spark, sf, "gmail_messages"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(_read(spark, sf, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The records of every mix in the order of its schedule's slots."""
    return mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"), "doc_id", "text", "source").records


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares every mix reaches."""
    return mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"), "doc_id", "text", "source").report


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue(_read(spark, sf, "documents"), "doc_id", "text", "title", "organization_id")


#: Closure over shared edges; meant for the small tables that the comparison uses.
_GROUPS = """
with recursive ids as (
  select distinct entity_type, identifier_type, lower(trim(identifier_value, E' \\t\\n\\r')) as v, edge_id
  from segment_entity_identifiers
  where entity_type is not null and identifier_type is not null and lower(trim(identifier_value, E' \\t\\n\\r')) not in ('', 'null', 'none')),
links as (select distinct entity_type || chr(1) || identifier_type || chr(1) || v as node, entity_type || chr(1) || edge_id as link from ids where edge_id is not null),
pairs as (select distinct a.node, b.node as other from links a join links b using (link)),
reach(node, other) as (select node, node from links union select r.node, p.other from reach r join pairs p on p.node = r.other),
keys as (select node, min(split_part(other, chr(1), 2) || ':' || split_part(other, chr(1), 3)) as k from reach group by node)
select distinct i.entity_type, i.identifier_type, i.v as identifier_value, coalesce(k.k, i.identifier_type || ':' || i.v) as group_key
from ids i left join keys k on k.node = i.entity_type || chr(1) || i.identifier_type || chr(1) || i.v
"""


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_found, p8_ids, p9_mix, p9_shares, p10_found)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _GROUPS}
