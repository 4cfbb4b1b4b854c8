"""Pages that other crawlers send to an index: who may, what is whole, and what becomes of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from ..operators.segments import Index

#: Bytes of a page's text at most.
MOST_BYTES = 1 << 20


def signed(secret: str, url: Column = None, text_hash: Column = None) -> Column:
    """The signature of a page under a shared secret: of its address and the digest of its text, a line each."""
    url, text_hash = F.col("url") if url is None else url, F.col("text_hash") if text_hash is None else text_hash
    return digests.hmac_sha256(F.concat_ws("\n", F.coalesce(url, F.lit("")), F.coalesce(text_hash, F.lit(""))), secret)


def checked(messages: DataFrame, allowed: DataFrame | None, secret: str | None, most: int = MOST_BYTES) -> DataFrame:
    """messages (doc_id, peer, url, title, text, text_hash, signature) with their outcome, the first reason against them or `accepted`.

    allowed lists peers (peer); without it all may send. Without a secret, signatures are
    not asked for. A null peer is on no list, a null text or signature is wrong.
    """
    rows = messages
    listed = F.lit(True)
    if allowed is not None:
        rows = rows.join(allowed.select(F.col("peer").alias("_peer")).distinct(), F.col("peer") == F.col("_peer"), "left")
        listed = F.col("_peer").isNotNull()
    whole = F.coalesce(F.sha2("text", 256) == F.col("text_hash"), F.lit(False))
    genuine = F.lit(True) if secret is None else F.coalesce(signed(secret) == F.col("signature"), F.lit(False))
    outcome = (
        F.when(~listed, "peer_not_allowed")
        .when(F.col("doc_id").isNull() | F.col("url").isNull() | F.col("text").isNull(), "incomplete")
        .when(F.octet_length("text") > most, "too_large")
        .when(~whole, "wrong_digest")
        .when(~genuine, "wrong_signature")
        .otherwise("accepted")
    )
    return rows.withColumn("outcome", outcome).select(*messages.columns, "outcome")


def into(index: Index) -> Callable[[DataFrame, int], None]:
    """What a stream of checked messages does with each micro-batch: the accepted ones are added to an index. A batch that is tried again replaces its own pages."""

    def add(rows: DataFrame, batch: int) -> None:
        good = rows.filter("outcome = 'accepted'")
        if not good.isEmpty():
            index.add(good.select("doc_id", "title", "text"))

    return add
