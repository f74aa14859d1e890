"""Engine configuration: entity types, sources and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EntityType:
    name: str
    entity_resolution: bool = True
    registration: str | None = None


@dataclass(frozen=True)
class SourceSpec:
    """One source and which layers it feeds."""

    name: str
    enabled: bool = True
    events: bool = True
    entities: bool = True
    relationships: bool = False
    dimensions: bool = False
    measurements: bool = False
    attribution: bool = False


@dataclass(frozen=True)
class Config:
    entity_types: tuple[EntityType, ...] = (EntityType("person"), EntityType("group"))
    sources: tuple[SourceSpec, ...] = ()
    max_recursion: int = 5
    critical_connections: int = 50
    error_connections: int = 20
    warning_connections: int = 10
    filter_critical: bool = False
    filter_error: bool = False
    incremental: bool = False
    internal_emails: tuple[str, ...] = ()
    internal_domains: tuple[str, ...] = ()
    referral_exclusions: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, entity_types: dict | list | None = None, **rest) -> Config:
        """entity_types: {name: {entity_resolution, registration_model}} or a list of resolved type names."""
        if isinstance(entity_types, dict):
            types = tuple(EntityType(k, bool(v.get("entity_resolution", True)), v.get("registration_model")) for k, v in entity_types.items())
            return cls(types, **rest)
        return cls(tuple(EntityType(n) for n in entity_types), **rest) if entity_types else cls(**rest)

    def resolved_types(self) -> list[str]:
        return [t.name for t in self.entity_types if t.entity_resolution]

    def registered_types(self) -> list[str]:
        return [t.name for t in self.entity_types if not t.entity_resolution]

    def enabled(self, parts: dict, layer: str) -> list:
        """Of ``parts`` (source name -> relation) those of sources that are on and feed the layer (events, entities,
        relationships, dimensions, measurements or attribution)."""
        on = {s.name for s in self.sources if s.enabled and getattr(s, layer)}
        return [p for n, p in parts.items() if n in on]

    def thresholds(self) -> dict[str, int | None]:
        """The edge filters that are on."""
        return {"critical": self.critical_connections if self.filter_critical else None, "error": self.error_connections if self.filter_error else None}

    def is_resolved(self, name: str) -> bool:
        return name in self.resolved_types()
