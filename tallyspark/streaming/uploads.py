"""Uploads: the state of each from its events, and the row that stands for it in the list until the store has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import documents as D

# Answers of the object store that mean success, and the message of a failure that gives none.
ACCEPTED, FAILED = (201, 204), "Upload failed"


def stored(code: Column) -> Column:
    """Whether the object store took the file."""
    return F.coalesce(code.isin(*ACCEPTED), F.lit(False))


def upload_states(events: DataFrame) -> DataFrame:
    """One row per upload that is still in the list: id, upload_id, status, error_message, image_grayscale, data, ord.

    events: (upload_id, ord, kind, code, data, message); kind is started, stored (with the store's code), finalized (with the new
    receipt's JSON), failed, removed or retried (whose new attempt starts under an id of its own, so this one is gone as well).
    The last event decides: an upload is ``uploading`` until it is finalized (``success``; the id is the receipt's if it is a text) or
    fails (``error``), also by an answer that isn't success. ``ord`` is that of its start, or of its first event; the newest
    belongs in front. A null kind, or another one, leaves an upload uploading. Works on a batch or, with update output, a stream."""
    last = events.groupBy("upload_id").agg(
        F.max_by(F.struct("kind", "code", "data", "message"), "ord").alias("last"), F.min("ord").alias("ord"), F.max_by(F.when(F.col("kind") == "started", F.col("data")), F.when(F.col("kind") == "started", F.col("ord"))).alias("first")
    )
    kind = F.coalesce("last.kind", F.lit(""))
    done, broken = kind == "finalized", (kind == "failed") | (kind == "stored") & ~stored(F.col("last.code"))
    document = F.try_parse_json(F.when(done, F.col("last.data")))
    status = F.when(done, "success").when(broken, "error").otherwise("uploading")
    message = F.when(broken, F.when(S.is_blank(F.col("last.message")), FAILED).otherwise(F.col("last.message")))
    gray = D.true_of(F.try_parse_json("first"), "image_grayscale") | D.true_of(document, "image_grayscale")
    return last.where(~kind.isin("removed", "retried")).select(
        F.coalesce(D.text_of(document, "id"), "upload_id").alias("id"), "upload_id", status.alias("status"), message.alias("error_message"), gray.alias("image_grayscale"), F.when(done, F.col("last.data")).alias("data"), "ord"
    )
