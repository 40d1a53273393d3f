"""Settings of a comparison, with their defaults, presets, and TOML and JSON forms."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path


@dataclass(frozen=True)
class SemanticConfig:
    enabled: bool = True
    locale: str = "en"
    explain: bool = True
    allow_probable_as_match: bool = False
    remove_diacritics: bool = True
    unicode_form: str = "NFC"
    split_camel_case: bool = True
    stopwords: tuple[str, ...] = ("tbl", "table", "tmp", "backup", "bak")
    pluralization: bool = True
    plural_exceptions: tuple[str, ...] = ()
    stemming: bool = False
    synonyms: bool = True
    synonym_groups: tuple[tuple[str, ...], ...] = (("id", "identifier"), ("num", "number", "no"))
    token_similarity: bool = True
    token_metric: str = "jaccard"
    fuzzy: bool = True
    fuzzy_algorithm: str = "jaroWinkler"
    ngrams: bool = True
    ngram_size: int = 3
    ngram_metric: str = "jaccard"
    weight_exact: float = 0.60
    weight_plural: float = 0.55
    weight_synonym: float = 0.70
    weight_token: float = 0.25
    weight_fuzzy: float = 0.15
    weight_ngram: float = 0.10
    match_threshold: float = 0.80
    probable_threshold: float = 0.55

    def fewest_shared_tokens(self) -> float:
        """The token similarity without which no other evidence reaches a match; 0 or less: none is needed."""
        if not self.token_similarity or self.weight_token <= 0:
            return 0.0
        level = self.probable_threshold if self.allow_probable_as_match else self.match_threshold
        f, g = self.weight_fuzzy * self.fuzzy, self.weight_ngram * self.ngrams
        return (level * (self.weight_token + f + g) - f - g) / self.weight_token


@dataclass(frozen=True)
class CompareConfig:
    exact_matching: bool = True
    normalized_matching: bool = True
    similarity_matching: bool = False
    similarity_threshold: float = 0.7
    check_type_compatibility: bool = True
    check_nullability: bool = True
    check_constraints: bool = True
    detect_collisions: bool = True
    semantic: SemanticConfig = field(default_factory=SemanticConfig)

    @staticmethod
    def all_features() -> CompareConfig:
        return CompareConfig(similarity_matching=True)

    @staticmethod
    def minimal() -> CompareConfig:
        return CompareConfig(normalized_matching=False, check_nullability=False, check_constraints=False, detect_collisions=False, semantic=SemanticConfig(enabled=False))

    @staticmethod
    def strict() -> CompareConfig:
        return CompareConfig(similarity_threshold=0.9)

    def with_similarity_threshold(self, value: float) -> CompareConfig:
        return replace(self, similarity_threshold=min(1.0, max(0.0, value)))


@dataclass(frozen=True)
class ResolutionConfig:
    """``resolve_unresolvable``: accept suggestions that suggest nothing too, as the report layout expects."""

    type_preference: str = "prefer_larger"
    nullability_preference: str = "always_nullable"
    length_preference: str = "use_maximum"
    allow_risky_suggestions: bool = True
    min_confidence: float = 0.0
    generate_alternatives: bool = True
    confidence_threshold: float = 0.9
    decision_id_prefix: str = "auto_dec"
    resolve_unresolvable: bool = True

    @staticmethod
    def conservative() -> ResolutionConfig:
        return ResolutionConfig(allow_risky_suggestions=False, min_confidence=0.7, generate_alternatives=False)

    @staticmethod
    def prefer_schema(side: str) -> ResolutionConfig:
        choice = f"prefer_schema_{side.lower()}"
        return ResolutionConfig(choice, choice, choice)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(text: str) -> ResolutionConfig:
        return ResolutionConfig(**json.loads(text))


OUTPUTS = {"generate_unified_schema": True, "generate_diff": True, "generate_decision_log": True, "generate_report": True, "generate_json_report": False}

SAMPLE = """# Settings of the schema comparison
[compare]
similarity_threshold = 0.7
default_output_dir = "output"

[resolution]
confidence_threshold = 0.9
decision_id_prefix = "auto_dec"
allow_risky_suggestions = true

[output]
generate_unified_schema = true
generate_diff = true
generate_decision_log = true
generate_report = true
generate_json_report = false
"""


@dataclass(frozen=True)
class Settings:
    """The TOML file of the command line."""

    compare: dict = field(default_factory=dict)
    resolution: dict = field(default_factory=dict)
    output: dict = field(default_factory=dict)

    @staticmethod
    def load(path: str | None = None) -> Settings:
        """``path``, or the first default place that can be read; an unreadable default is passed over."""
        if path:
            return Settings(**{k: v for k, v in tomllib.loads(Path(path).read_text()).items() if k in ("compare", "resolution", "output")})
        for place in (Path("loomline.toml"), Path.home() / ".loomline.toml", Path.home() / ".config/loomline/config.toml"):
            try:
                return Settings.load(str(place))
            except (OSError, tomllib.TOMLDecodeError):
                continue
        return Settings()

    def compare_config(self) -> CompareConfig:
        return CompareConfig().with_similarity_threshold(self.compare.get("similarity_threshold", 0.7))

    def resolution_config(self, threshold: float | None = None) -> ResolutionConfig:
        named = {k: v for k, v in self.resolution.items() if k in ResolutionConfig.__dataclass_fields__}
        return replace(ResolutionConfig(**named), **({} if threshold is None else {"confidence_threshold": threshold}))

    @property
    def output_dir(self) -> str:
        return self.compare.get("default_output_dir", "output")

    def generates(self, what: str) -> bool:
        return bool(self.output.get(what, OUTPUTS[what]))
