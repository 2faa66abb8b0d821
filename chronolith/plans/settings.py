"""Settings of builds and queries: dataclasses, read from a section of a file, with overrides."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from .prompts import read_tree
from .providers import Providers, QueryParam, kind_of


@dataclass
class Core:
    working_dir: str | None = None
    corpus_path: str | None = None
    enable_local: bool = True
    enable_naive: bool = False


@dataclass
class Chunking:
    chunk_size: int = 1200
    chunk_overlap: int = 100


@dataclass
class Models:
    provider: str | None = None
    model: str | None = None
    embedding_provider: str | None = None
    embedding_batch: int = 32
    enable_cache: bool = True
    max_gleaning: int = 1


@dataclass
class Graph:
    max_cluster_size: int = 10
    summary_tokens: int = 500
    disable_summaries: bool = False
    enable_community_summary: bool = True
    enable_incremental: bool = False
    enable_seasonal_matching: bool = False


@dataclass
class Settings:
    core: Core = field(default_factory=Core)
    chunking: Chunking = field(default_factory=Chunking)
    models: Models = field(default_factory=Models)
    graph: Graph = field(default_factory=Graph)
    query: QueryParam = field(default_factory=QueryParam)
    #: Whatever the section holds that no setting is named after.
    others: dict = field(default_factory=dict)


def raw(path: str | None, section: str, overrides: dict | None = None) -> dict:
    """The section ``building`` or ``querying`` of a file; overrides that aren't None come before it. A provider that isn't
    named follows from the model, that of the embeddings from the provider."""
    if section not in ("building", "querying"):
        raise ValueError(f"no section {section!r}")
    values = dict((read_tree(path).get(section) or {}) if path else {})
    values |= {k: v for k, v in (overrides or {}).items() if v is not None}
    if not values.get("provider") and values.get("model"):
        values["provider"] = kind_of(values["model"])
    if not values.get("embedding_provider") and values.get("provider"):
        values["embedding_provider"] = values["provider"]
    return values


def load(path: str | None = None, section: str = "building", overrides: dict | None = None) -> Settings:
    """Structured settings; values that are null in the file leave the defaults."""
    values, used = raw(path, section, overrides), set()
    parts = {}
    for name, cls in (("core", Core), ("chunking", Chunking), ("models", Models), ("graph", Graph), ("query", QueryParam)):
        own = {f.name for f in fields(cls)}
        used |= own
        parts[name] = cls(**{k: v for k, v in values.items() if k in own and v is not None})
    return Settings(**parts, others={k: v for k, v in values.items() if k not in used})


def engine(spark, settings: Settings, providers: Providers | None = None):  # noqa: ANN001, ANN201
    """A graph in the settings' folder."""
    from .engine import TemporalGraph

    if not settings.core.working_dir:
        raise ValueError("working_dir isn't set")
    limit = None if settings.graph.disable_summaries else settings.graph.summary_tokens
    return TemporalGraph(spark, settings.core.working_dir, providers, settings.chunking.chunk_size, settings.chunking.chunk_overlap, summary_tokens=limit, community_reports=settings.graph.enable_community_summary, cluster_size=settings.graph.max_cluster_size)
