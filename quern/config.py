"""Settings: searchable fields, analysis, ranking, highlighting and search limits."""

from __future__ import annotations

from dataclasses import dataclass, field


class ConfigurationError(ValueError):
    """A setting that cannot work."""


@dataclass(frozen=True)
class Field:
    number: int
    name: str
    boost: float = 1.0


class FieldRegistry:
    """Named searchable fields with a number from 1 to 255 and a boost."""

    def __init__(self, *fields: Field):
        self._by_name: dict[str, Field] = {}
        self._by_number: dict[int, Field] = {}
        for f in fields:
            self.add(f)

    @classmethod
    def default(cls) -> FieldRegistry:
        return cls(Field(1, "title", 3.0), Field(2, "tags", 2.0), Field(3, "body", 1.0))

    def add(self, f: Field) -> None:
        if not f.name.strip():
            raise ConfigurationError("a field needs a name")
        if not 1 <= f.number <= 255:
            raise ConfigurationError(f"field number {f.number} is not within 1..255")
        if f.name in self._by_name or f.number in self._by_number:
            raise ConfigurationError(f"field {f.name} ({f.number}) is registered twice")
        self._by_name[f.name] = self._by_number[f.number] = f

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def __iter__(self):
        return iter(self._by_name.values())

    def names(self) -> list[str]:
        return list(self._by_name)

    def number(self, name: str) -> int:
        if name not in self._by_name:
            raise ConfigurationError(f"unknown field {name}; known: {', '.join(self._by_name)}")
        return self._by_name[name].number

    def name(self, number: int) -> str:
        return self._by_number[number].name

    def boost(self, number: int) -> float:
        return self._by_number[number].boost


@dataclass(frozen=True)
class AnalyzerConfig:
    stop_words: str = "english"  # or "none"
    stemmer: str = "porter"  # or "none"
    fold: bool = True
    min_length: int = 2
    max_length: int = 40
    normalise: bool = True  # False: tokenizer and lower-casing only

    @classmethod
    def minimal(cls) -> AnalyzerConfig:
        return cls(stop_words="none", stemmer="none", fold=False, min_length=1, max_length=1 << 30, normalise=False)

    def without_stemming(self) -> AnalyzerConfig:
        return AnalyzerConfig(self.stop_words, "none", self.fold, self.min_length, self.max_length, self.normalise)


@dataclass(frozen=True)
class Ranking:
    model: str = "bm25"  # or "tfidf"
    k1: float = 1.2
    b: float = 0.75
    length_norm: bool = True
    phrase_boost: float = 2.0
    coordination: bool = True


@dataclass(frozen=True)
class HighlightOptions:
    pre: str = "<mark>"
    post: str = "</mark>"
    fragment_size: int = 180
    fragments: int = 3
    ellipsis: str = "…"
    fields: tuple[str, ...] = ("title", "body")


@dataclass(frozen=True)
class Settings:
    fields: FieldRegistry = field(default_factory=FieldRegistry.default)
    analyzer: AnalyzerConfig = AnalyzerConfig()
    ranking: Ranking = Ranking()
    highlight: HighlightOptions = HighlightOptions()
    max_expansions: int = 64
    max_size: int = 100
    default_operator: str = "or"
    facet_limit: int = 12
    store_positions: bool = True
