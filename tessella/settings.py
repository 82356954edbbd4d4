"""Search settings, their presets, and service settings from a small YAML or JSON file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class SearchSettings:
    """min_match: shortest run; distance: edits allowed; coverage: least share of a fragment; blocks:
    ask for equal block structure; semantic: least word similarity, or None; min_sum: least total length."""

    min_match: int = 10
    distance: int = 0
    coverage: float = 0.5
    blocks: bool = False
    semantic: float | None = None
    min_sum: int = 0

    def __post_init__(self):
        if self.min_match < 1 or self.distance < 0:
            raise ValueError("min_match must be 1 or more, distance 0 or more")

    @property
    def least_coverage(self) -> float:
        return min(max(self.coverage, 0.0), 1.0)

    def to_json(self) -> str:
        return json.dumps({WIRE_NAMES[k]: v for k, v in asdict(self).items() if v is not None})

    @classmethod
    def from_json(cls, text: str) -> SearchSettings:
        names = {v: k for k, v in WIRE_NAMES.items()}
        return cls(**{names[k]: v for k, v in json.loads(text).items()})


# Field names of the message format.
WIRE_NAMES = {
    "min_match": "minMatchLength",
    "distance": "levenshteinDistance",
    "coverage": "coveragePercentage",
    "blocks": "blockFiltering",
    "semantic": "semanticThreshold",
    "min_sum": "minSumResultLength",
}

SETTINGS_TYPE = T.StructType([
    T.StructField("minMatchLength", T.IntegerType()),
    T.StructField("levenshteinDistance", T.IntegerType()),
    T.StructField("coveragePercentage", T.DoubleType()),
    T.StructField("blockFiltering", T.BooleanType()),
    T.StructField("semanticThreshold", T.DoubleType()),
    T.StructField("minSumResultLength", T.IntegerType()),
])

# Presets (min_match, distance, coverage, blocks, semantic, min_sum).
HIGH = SearchSettings(15, 0, 0.8, True, 0.6, 30)
MEDIUM = SearchSettings(10, 0, 0.7, True, 0.4, 20)
LOW = SearchSettings(10, 0, 0.5, True, None, 20)
SURVEY = SearchSettings(10, 0, 0.7, True, 0.3, 30)
INTERACTIVE = SearchSettings(20, 0, 0.75, False, None, 0)
PRESETS = {"high": HIGH, "medium": MEDIUM, "low": LOW, "survey": SURVEY, "interactive": INTERACTIVE}
#: Shortest indexed run of a service.
INDEX_NGRAM = 10


@dataclass(frozen=True)
class ServiceSettings:
    """language: which fragments to serve; digits: last digits of the answer ids of this shard."""

    language: str
    digits: tuple[int, ...]
    question_tag: str = ""

    def __post_init__(self):
        if not self.digits:
            raise ValueError("digits must not be empty")


def read_service_settings(text: str) -> ServiceSettings:
    """From JSON, or from YAML of `key: value` lines with lists in brackets or as `- item` lines."""
    try:
        raw = json.loads(text)
    except ValueError:
        raw, last = {}, None
        for line in text.splitlines():
            line = line.split("#", 1)[0].rstrip()
            if line.lstrip().startswith("- ") and last:
                raw[last] = [*(raw[last] or []), int(line.lstrip()[2:])]
            elif ":" in line:
                last, value = (p.strip() for p in line.split(":", 1))
                raw[last] = [int(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") else value.strip("'\"") or None
    names = {f.name for f in fields(ServiceSettings)}
    known = {k: tuple(v) if k == "digits" else v for k, v in raw.items() if k in names and v is not None}
    return ServiceSettings(**{"digits": (), **known})


def with_overrides(settings: SearchSettings, **changes) -> SearchSettings:
    return replace(settings, **changes)
