"""Policies: weights, bands, thresholds and word lists of a profile, shipped or read from a file."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from glossa.sources.policies import POLICIES

DIMENSIONS = ["sentence_load", "morphology", "agency", "lexical_clarity", "structure", "redundancy"]
WEIGHTS = {name: list(p["weights"].values()) for name, p in POLICIES.items()}
#: Words that carry no content for the rules on repetition.
STOP_LEMMAS = "a an and any as at be before but by do for from have in into it not of on only or our out that the then this to with yet".split()
#: Word lists and phrase lists (label -> phrases) that a policy must have.
LISTS = [
    "abstract_evidence_heads", "nominalization_suffixes", "nominalization_exclusions", "nominalizations", "protected_concepts", "actor_terms", "allowed_compounds", "compound_modifier_suffixes", "known_acronyms", "qualifiers",
]
PHRASES = ["hidden_agency", "weak_verbs", "jargon", "bureaucratic_phrases", "indirect_predicates", "purpose_markers", "filler_phrases", "recommendation_action_groups"]
FLAGS = ["require_responsible_actor", "allow_implied_subject", "allow_implied_first_person", "count_repetition_across_blocks"]


@dataclass(frozen=True)
class Profile:
    """One policy; ``digest`` of its canonical form identifies it."""

    name: str
    version: str
    weights: dict[str, int]
    bands: list[tuple[str, float, float]]
    thresholds: dict[str, float]
    rules: dict[str, list | dict] = field(default_factory=dict)
    rewrite_policy: dict[str, float | bool] = field(default_factory=dict)

    def __post_init__(self):
        if list(self.weights) != DIMENSIONS or sum(self.weights.values()) != 100:
            raise ValueError(f"{self.name}: the six weights must total 100")
        edges = sorted((lo, hi) for _, lo, hi in self.bands)
        if not edges or edges[0][0] != 0 or edges[-1][1] != 100 or any(round(b[0] - a[1], 2) != 0.01 for a, b in zip(edges, edges[1:], strict=False)):
            raise ValueError(f"{self.name}: the bands must cover 0 to 100 without gap or overlap")
        if any(isinstance(v, str) or v < 0 for v in self.thresholds.values()):
            raise ValueError(f"{self.name}: thresholds must be numbers from 0 on")
        for key in LISTS:
            if not all(isinstance(x, str) and x for x in self.rules.get(key, [])):
                raise ValueError(f"{self.name}: {key} must be a list of words")
        for key in PHRASES:
            if not all(isinstance(v, list) and all(isinstance(x, str) and x for x in v) for v in dict(self.rules.get(key, {})).values()):
                raise ValueError(f"{self.name}: {key} must map labels to lists of phrases")

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.__dict__, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def flag(self, *names: str) -> bool:
        return any(bool(self.thresholds.get(name, 0)) for name in names)

    def words(self, key: str) -> list[str]:
        """A word list in lower case."""
        return [w.lower() for w in self.rules.get(key, [])]

    def phrases(self, key: str) -> dict[str, list[str]]:
        return dict(self.rules.get(key, {}))


def _of(name: str, p: dict) -> Profile:
    bands = [(b["name"], b["minimum"], b["maximum"]) if isinstance(b, dict) else tuple(b) for b in p["bands"]]
    weights = {d: p["weights"][d] for d in DIMENSIONS if d in p["weights"]}
    return Profile(name, p["version"], weights, [(b, float(lo), float(hi)) for b, lo, hi in bands], dict(p["thresholds"]), p["rules"], p.get("rewrite_policy", {}))


def load_profile(name: str = "architecture-review") -> Profile:
    """A shipped policy by name."""
    if name not in POLICIES:
        raise ValueError(f"unknown profile {name!r}; there are {', '.join(sorted(POLICIES))}")
    return _of(name, POLICIES[name])


def read_profile(path: str) -> Profile:
    """A policy from a JSON file; an error names what is missing or wrong."""
    with open(path, encoding="utf-8") as f:
        p = json.load(f)
    missing = [k for k in ("name", "version", "weights", "bands", "thresholds", "rules") if k not in p]
    if missing:
        raise ValueError(f"{path}: no {', '.join(missing)}")
    lacking = sorted(set(POLICIES["architecture-review"]["thresholds"]) - set(p["thresholds"])) + [k for k in LISTS + PHRASES if k not in p["rules"]]
    if lacking:
        raise ValueError(f"{path}: no {', '.join(lacking)}")
    return _of(p["name"], p)
