"""BM25 and TF-IDF as numbers for the driver and expressions for Spark."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.config import ConfigurationError, Ranking


class Model:
    def __init__(self, ranking: Ranking):
        if ranking.model not in ("bm25", "tfidf"):
            raise ConfigurationError(f"unknown ranking model {ranking.model}; known: bm25, tfidf")
        self.r = ranking

    def idf(self, frequency: int, documents: int) -> float:
        if self.r.model == "tfidf":
            return 1 + math.log(documents / (1 + frequency)) if documents > 0 else 0.0
        if documents <= 0:
            return 0.0
        df = min(max(frequency, 0), documents)
        return math.log(1 + (documents - df + 0.5) / (df + 0.5))

    def score(self, idf: float, tf: int, length: int, average: float) -> float:
        if tf <= 0:
            return 0.0
        if self.r.model == "tfidf":
            return math.sqrt(tf) * idf * idf * (1 / math.sqrt(length) if self.r.length_norm and length > 0 else 1.0)
        ratio = length / average if average > 0 else 1.0
        under = tf + self.r.k1 * (1 - self.r.b + self.r.b * ratio)
        return idf * tf * (self.r.k1 + 1) / under if under > 0 else 0.0

    def column(self, idf: Column, tf: Column, length: Column, average: Column) -> Column:
        if self.r.model == "tfidf":
            norm = F.when(length > 0, 1 / F.sqrt(length.cast("double"))).otherwise(1.0) if self.r.length_norm else F.lit(1.0)
            return F.when(tf > 0, F.sqrt(tf.cast("double")) * idf * idf * norm).otherwise(0.0)
        ratio = F.when(average > 0, length / average).otherwise(1.0)
        under = tf + F.lit(self.r.k1) * (F.lit(1 - self.r.b) + F.lit(self.r.b) * ratio)
        return F.when((tf > 0) & (under > 0), idf * tf * F.lit(self.r.k1 + 1) / under).otherwise(0.0)
