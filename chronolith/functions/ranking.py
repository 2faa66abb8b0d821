"""Ranking weights and scores as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeexpr import temporal_distance, temporal_overlap

# Default weights of entity and edge ranks: alignment, proximity, degree, (edge weight,) relevance (fixed values).
ENTITY_WEIGHTS = {"alignment": 0.4, "proximity": 0.3, "degree": 0.2, "relevance": 0.1}
EDGE_WEIGHTS = {"alignment": 0.35, "proximity": 0.15, "degree": 0.05, "weight": 0.15, "relevance": 0.35}
# Weights by kind of query (fixed values).
PRESETS = {
    "general": {"alignment": 0.3, "proximity": 0.2, "degree": 0.3, "relevance": 0.2},
    "temporal": {"alignment": 0.5, "proximity": 0.3, "degree": 0.15, "relevance": 0.05},
    "enumeration": {"alignment": 0.25, "proximity": 0.2, "degree": 0.25, "relevance": 0.3},
    "comparison": {"alignment": 0.35, "proximity": 0.25, "degree": 0.25, "relevance": 0.15},
}


def ranking_config(kind: str = "general", temporal_focus: bool = True, override: dict[str, float] | None = None) -> dict[str, float]:
    """Weights that add up to one.

    With a temporal focus, alignment grows by a fifth (0.6 at most) and proximity by a tenth (0.4 at most); what they
    leave goes 60:40 to degree and relevance. Overrides of known names come last, before all are scaled to one.
    """
    weights = dict(PRESETS.get(kind, PRESETS["general"]))
    if temporal_focus:
        temporal = {"alignment": min(1.2 * weights["alignment"], 0.6), "proximity": min(1.1 * weights["proximity"], 0.4)}
        rest = 1.0 - sum(temporal.values())
        weights |= temporal | ({"degree": 0.6 * rest, "relevance": 0.4 * rest} if rest > 0 else {})
    weights |= {k: v for k, v in (override or {}).items() if k in weights}
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else weights


def lexical_relevance(query: Column, name: Column, description: Column) -> Column:
    """1 if one holds the other, a half if any word of the query stands in the text, else 0."""
    q, n, d = F.lower(query), F.lower(name), F.lower(F.coalesce(description, F.lit("")))
    whole = n.contains(q) | q.contains(n) | d.contains(q)
    word = F.exists(F.filter(F.split(q, " "), lambda w: w != ""), lambda w: n.contains(w) | d.contains(w))
    return F.when(whole, 1.0).when(word, 0.5).otherwise(0.0)


def semantic_relevance(query: Column, own: Column) -> Column:
    """The cosine of two vectors, 0 if it is negative or there is none."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.coalesce(dot(query, own) / F.nullif(F.sqrt(dot(query, query)) * F.sqrt(dot(own, own)), F.lit(0.0)), F.lit(0.0)))


def alignment(query_times: Column, own_times: Column) -> Column:
    """Share of the query's times that overlap one of the own ones."""
    hit = F.filter(query_times, lambda q: F.exists(own_times, lambda t: temporal_overlap(q, t)))
    return F.when(F.size(query_times) > 0, F.size(hit) / F.size(query_times)).otherwise(0.0)


def proximity(query_times: Column, own_times: Column) -> Column:
    """Mean over the query's times of 1 - least distance / 10, not below 0; 0 where nothing overlaps."""
    near = F.transform(query_times, lambda q: F.greatest(F.lit(0.0), 1 - F.array_min(F.transform(own_times, lambda t: temporal_distance(q, t))) / 10))
    total = F.aggregate(near, F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(own_times) > 0) & (alignment(query_times, own_times) > 0), total / F.size(query_times)).otherwise(0.0)


def entity_rank(query_times: Column, own_times: Column, degree: Column, relevance: Column, weights: dict[str, float] = ENTITY_WEIGHTS) -> Column:
    by_degree = F.least(degree / 100.0, F.lit(1.0))
    score = alignment(query_times, own_times) * weights["alignment"] + proximity(query_times, own_times) * weights["proximity"] + by_degree * weights["degree"] + relevance * weights["relevance"]
    return F.when(F.size(query_times) > 0, score).otherwise(by_degree)


def edge_rank(query_times: Column, own_times: Column, degree: Column, weight: Column, relevance: Column, weights: dict[str, float] = EDGE_WEIGHTS) -> Column:
    by_degree, by_weight = F.least(degree / 100.0, F.lit(1.0)), F.least(weight / 10.0, F.lit(1.0))
    score = (
        alignment(query_times, own_times) * weights["alignment"]
        + proximity(query_times, own_times) * weights["proximity"]
        + by_degree * weights["degree"]
        + by_weight * weights["weight"]
        + relevance * weights["relevance"]
    )
    return F.when(F.size(query_times) > 0, score).otherwise(by_degree * 0.7 + by_weight * 0.3)
