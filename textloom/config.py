"""Settings of indexing, search and crawling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Defaults as one value; pass a changed copy where needed."""

    k1: float = 1.2
    b: float = 0.75
    top_k_retrieval: int = 1000
    top_k_rerank: int = 100
    min_score: float = 0.0
    window: int = 512
    step: int = 450
    chunks_per_document: int = 10
    lexical_share: float = 0.15
    relevance_threshold: float = 0.8
    per_domain: int = 1
    embedding_size: int = 64
    snippet: int = 200
    llm_windows: int = 10
    llm_window_chars: int = 4000
    expansion_term: str = ""
    max_depth: int = 5
    expand_score: float = 0.5
    round_urls: int = 99
    default_delay: float = 1.5
    decay: float = 0.2
    ban_average: float = 0.9
    ban_samples: int = 3


DEFAULT = Config()


def from_yaml(text: str, start: Config = DEFAULT) -> Config:
    """``start`` with the scalar settings of a YAML mapping; sections only group, unknown names are ignored."""
    kinds = {f.name: type(getattr(start, f.name)) for f in fields(start)}
    found: dict[str, object] = {}
    for line in text.splitlines():
        name, colon, value = line.partition(":")
        value = value.split(" #")[0].strip().strip("\"'")
        if colon and value and not line.lstrip().startswith("#") and name.strip() in kinds:
            found[name.strip()] = kinds[name.strip()](value)
    return replace(start, **found)


def view(config: Config | Mapping[str, object], secret: Sequence[str] = ("key", "token", "password")) -> dict[str, object]:
    """Settings for showing: a copy in which values of names that tell a secret are masked."""
    held = asdict(config) if isinstance(config, Config) else dict(config)
    return {k: view(v, secret) if isinstance(v, Mapping) else "***" if v and any(s in k.lower() for s in secret) else v for k, v in held.items()}


#: Session settings that suit this engine on any cluster; sizes of partitions are left to the cluster.
SPARK = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
