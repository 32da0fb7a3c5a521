"""What a mining run is asked for, and the presets of the miners."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class MiningConfig:
    """Knobs of a run. ``labelled``: patterns carry node types or instances; else edge types only.

    ``enumeration``: ``bidirectional`` meets in the middle, ``reverse`` joins forward halves to an index grown from the
    context, ``forward`` only walks from the target; all find the same paths. ``context_level``: whether the context
    counts in a pattern's relevance. ``own_score``: whether the target's own score bounds a path's. ``mode``: the
    ``top_patterns`` best patterns, or with ``threshold`` all of relevance ``min_relevance`` or more. ``prune``: by which bounds patterns are let go
    unevaluated; the result is the same under all of them.
    """

    path_nodes: int = 4
    min_path_nodes: int = 2
    min_peers: int = 5
    top_patterns: int = 20
    top_facts: int = 10
    coverage: float = 0.8
    stop: float = 0.85
    hops: int = 8
    min_score: float = 1e-6
    labelled: bool = True
    enumeration: str = "bidirectional"
    context_level: bool = True
    own_score: bool = True
    drop_zero: bool = False
    diversify: bool = False
    mode: str = "top"
    min_relevance: float = 0.0
    prune: str = "both"

    def with_(self, **changes) -> MiningConfig:
        return replace(self, **changes)


BIDIRECTIONAL = MiningConfig(min_path_nodes=3)
REVERSE = MiningConfig(labelled=False, enumeration="reverse", context_level=False, own_score=False, drop_zero=True)
NAIVE = REVERSE.with_(enumeration="forward")
THRESHOLD = BIDIRECTIONAL.with_(mode="threshold", min_relevance=1e-6)
BLIND = MiningConfig(labelled=False, path_nodes=3, coverage=0.9, top_facts=100, drop_zero=True)
#: The miner with each choice of bounds, for comparing what they save.
ABLATIONS = {name: BIDIRECTIONAL.with_(prune=name) for name in ("none", "path scores", "peer means", "both")}
