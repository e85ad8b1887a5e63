"""Pluggable models with deterministic defaults: embedders, tokenizers, text generators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import terms
from quillspark.functions.vector import let, normalised

DIM = 64


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """Signed hashing of terms into ``dim`` places, normalised; texts without terms give zeros."""
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int")
    sign = lambda t: F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    marks = F.transform(terms(text), lambda t: F.struct(place(t).alias("p"), sign(t).alias("s")))
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    sums = lambda ms: F.transform(places, lambda i: F.aggregate(ms, F.lit(0.0), lambda a, m: a + F.when(m.p == i, m.s).otherwise(0.0)))
    unit = lambda v: F.when(F.exists(v, lambda x: x != 0), normalised(v)).otherwise(v)
    return let(let(marks, sums), unit)


def token_count(text: Column) -> Column:
    """Words and marks: the default where no model's tokenizer is given."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\w+|[^\w\s])"), 1))


@dataclass
class TextGen:
    """What a language model would do to a question. Defaults need none: no rewrites, no guesses, the question itself."""

    rewrite: Callable[[str, int], Sequence[str]] = field(default=lambda q, n: [])
    hypothetical: Callable[[str, int], Sequence[str]] = field(default=lambda q, n: [])
    decompose: Callable[[str, int], Sequence[str]] = field(default=lambda q, n: [])
    keywords: Callable[[str], Sequence[str]] = field(default=lambda q: [])
    answer: Callable[[str], str] = field(default=lambda prompt: "")

    def expanded(self, question: str, n: int) -> list[str]:
        """The question first, then at most ``n`` rewrites, each once. A failure is the caller's to see."""
        return list(dict.fromkeys([question, *self.rewrite(question, n)[:n]]))

    def guesses(self, question: str, n: int) -> list[str]:
        """At most ``n`` hypothetical answers; none on failure."""
        try:
            return list(self.hypothetical(question, n))[:n]
        except Exception:
            return []

    def parts(self, question: str, n: int) -> list[str]:
        """The question and its sub-questions, at most ``n`` in all; the question alone on failure."""
        try:
            return list(dict.fromkeys([question, *self.decompose(question, n)]))[:n]
        except Exception:
            return [question]

    def frame(self, spark: SparkSession, texts: Sequence[str]) -> DataFrame:
        return spark.createDataFrame(list(enumerate(texts)), "query_idx int, text string")
