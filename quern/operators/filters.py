"""Structured filters over document columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_date(value) -> datetime | None:
    if isinstance(value, datetime):
        return value
    try:
        return datetime.fromisoformat(str(value).strip())
    except ValueError:
        return None


def _values(parameters: Mapping, *keys: str) -> tuple[str, ...]:
    """The first key that holds anything: a comma-separated text or a list."""
    for key in keys:
        value = parameters.get(key)
        if isinstance(value, str) and value.strip():
            return tuple(x.strip() for x in value.split(","))
        if isinstance(value, list | tuple) and value:
            return tuple(x for x in (str(v).strip() for v in value if isinstance(v, str | int | float)) if x)
    return ()


@dataclass(frozen=True)
class Filters:
    categories: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    all_tags: bool = False
    since: datetime | None = None
    until: datetime | None = None

    @classmethod
    def of(cls, parameters: Mapping) -> Filters:
        """From request parameters; dates that can't be read are ignored, a date alone means its midnight."""
        flag = parameters.get("match_all_tags", False)
        first = lambda *keys: next((parameters[k] for k in keys if parameters.get(k) is not None), None)
        return cls(
            _values(parameters, "category", "categories"),
            _values(parameters, "author", "authors"),
            _values(parameters, "tag", "tags"),
            flag is True or str(flag) in ("1", "true", "yes"),
            parse_date(first("published_from", "from_date") or ""),
            parse_date(first("published_to", "to_date") or ""),
        )

    def __bool__(self) -> bool:
        return bool(self.categories or self.authors or self.tags or self.since or self.until)

    def conditions(self) -> list[Column]:
        """All must hold. Plain predicates, which reach the documents' scan; nulls never pass."""
        out = []
        if self.categories:
            out.append(F.col("category").isin(*self.categories))
        if self.authors:
            out.append(F.col("author").isin(*self.authors))
        if self.tags:
            wanted = F.array(*[F.lit(t) for t in dict.fromkeys(self.tags)])
            out.append(F.size(F.array_except(wanted, F.col("tags"))) == 0 if self.all_tags else F.arrays_overlap("tags", wanted))
        if self.since:
            out.append(F.col("published_at") >= F.lit(self.since))
        if self.until:
            out.append(F.col("published_at") <= F.lit(self.until))
        return out

    def apply(self, documents: DataFrame) -> DataFrame:
        for c in self.conditions():
            documents = documents.where(c)
        return documents
