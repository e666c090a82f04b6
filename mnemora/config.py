"""Settings of the memory graph. Results depend on them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class GraphConfig:
    decay_rate: float = 0.015  # a day
    reinforcement_boost: float = 1.5
    visibility_threshold: float = 0.05
    co_occurrence_threshold: int = 2
    base_weights: dict[str, float] = field(default_factory=lambda: {"explicit": 1.0, "co-occurrence": 0.3, "temporal": 0.1, "causal": 0.8})

    @property
    def graduation(self) -> int:
        """Observations that make an edge: only a repeated sighting is ever tested."""
        return max(2, self.co_occurrence_threshold)


@dataclass(frozen=True)
class RecallConfig:
    semantic: float = 0.4
    graph: float = 0.3
    recency: float = 0.2
    importance: float = 0.1
    limit: int = 10
    hops: int = 2
    fuzzy_seeds: int = 5
    connections: int = 5
    episodes: int = 3
    excerpts: int = 5
    episode_discount: float = 0.8


DEFAULT = GraphConfig()
RECALL = RecallConfig()

NODE_TYPES = ("person", "project", "tool", "concept", "decision", "event", "lesson", "place", "tag")
EDGE_TYPES = ("explicit", "co-occurrence", "temporal", "causal")
EXCERPTS, EVIDENCE = 10, 20
TEMPORAL_PER_FILE = 50
NEW_NODE_CONFIDENCE = 0.5
CHUNK_MESSAGES, CHUNK_TOKENS, CHUNK_GAP_MINUTES, CHARS_PER_TOKEN = 20, 4000, 30, 4
ORIGIN_FACTOR = 0.6
EMBED_BATCH = 64
