"""The cascade for generated domain names: a Markov gate learned from benign names, then a classifier of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import scratch_path
from ..functions import text
from ..operators import markov
from .base import untrained
from .supervised import Supervised, dga_cascade


def lexical(rows: DataFrame, model: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` (key, domain) with the classifier's inputs, measured on each domain's first label."""
    labelled = rows.withColumn("s", text.domain_label(F.col("domain")))
    s = F.col("s")
    scored = labelled.join(markov.score(labelled, key, "s", model), key)
    measures = {
        "char_entropy": text.char_entropy(s), "bigram_entropy": text.ngram_entropy(s), "length": F.length(s).cast("double"), "digit_ratio": text.digit_ratio(s), "vowel_ratio": text.vowel_ratio(s),
        "markov_score": F.coalesce("score", F.lit(0.0)),
    }
    return scored.withColumns(measures).drop("s", "score")


class DgaCascade:
    """raw_score of rows (id, domain): 0 with status gated_benign where the Markov score reaches ``gate``, else the classifier's."""

    threat_class = "dga"

    def __init__(self, gate: float | None = None, rounds: int = 20):
        self.gate, self.rounds = gate, rounds
        self.markov: DataFrame | None = None
        self.classifier = Supervised("dga", rounds=rounds)

    def fit(self, rows: DataFrame) -> DgaCascade:
        """A new cascade; rows without a domain are left out. Transitions are counted over benign names only."""
        new, rows = DgaCascade(self.gate, self.rounds), rows.where("domain IS NOT NULL")
        benign = rows.where("label = 0").withColumn("s", text.domain_label(F.col("domain")))
        path = scratch_path(rows.sparkSession, "markov")
        markov.fit(benign, "s").write.parquet(path)
        new.markov = rows.sparkSession.read.parquet(path)
        new.classifier = self.classifier.fit(lexical(rows, new.markov))
        return new

    def score(self, rows: DataFrame) -> DataFrame:
        return untrained(rows) if self.markov is None else dga_cascade(lexical(rows, self.markov), self.gate, self.classifier)
