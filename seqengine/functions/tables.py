"""Table functions for SQL: explode_tokens and align_chars.  `register(spark)` adds them to a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> None:
    """Make explode_tokens(ids) and align_chars(ref, hyp) known to SQL; use them with LATERAL."""

    @udtf(returnType="place int, token int")
    class ExplodeTokens:
        """Each id of an array with its place; null and empty arrays give no rows."""

        def eval(self, ids: list) -> Iterator[tuple[int, int]]:
            for place, token in enumerate(ids or []):
                yield place, token

    @udtf(returnType="event string, ref string, hyp string")
    class AlignChars:
        """The chunks of a least-cost alignment of two strings; null is empty."""

        def eval(self, ref: str, hyp: str) -> Iterator[tuple[str, str, str]]:
            from seqengine.operators.metrics import align

            one, two = ref or "", hyp or ""
            for event, a, b, c, d in align(one, two):
                yield event, one[a:b], two[c:d]

    spark.udtf.register("explode_tokens", ExplodeTokens)
    spark.udtf.register("align_chars", AlignChars)
