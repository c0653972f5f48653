"""Submissions that a client sends again under the same token count once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(stream: DataFrame, token: str = "client_submission_uuid", arrived: str = "uploaded_at", delay: str = "2 hours", row: str = "id") -> DataFrame:
    """The rows of a stream whose token was not seen within the delay; a row without a token stands for itself.

    Tokens are kept until the delay has passed since their first row, so the state holds what arrived of late and not
    all there ever was; a token that comes back later counts again. Time is that of arrival, which only the way
    here delays: forms that were written long before they arrived are not late.
    """
    name = "token_"
    keyed = stream.withColumn(name, F.coalesce(F.concat(F.lit("t:"), F.col(token)), F.concat(F.lit("r:"), F.col(row).cast("string"))))
    return keyed.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([name]).drop(name)
