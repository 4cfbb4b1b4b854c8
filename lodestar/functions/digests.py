"""Keyed digests, tokens and a Bloom filter as column expressions."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 64


def pads(secret: str) -> tuple[bytes, bytes]:
    """Inner and outer pad of a secret."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(message: Column, secret: str) -> Column:
    """HMAC-SHA256 in hex."""
    inner, outer = pads(secret)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def _url64(data: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(data), "+/", "-_"), r"[=\r\n]", "")


def jwt(claims: Column, secret: str) -> Column:
    """A token of JSON claims, signed with HS256."""
    body = F.concat(_url64(F.lit('{"alg":"HS256","typ":"JWT"}').cast("binary")), F.lit("."), _url64(claims.cast("binary")))
    return F.concat(body, F.lit("."), _url64(F.unhex(hmac_sha256(body, secret))))


def jwt_valid(token: Column, secret: str, now: float) -> Column:
    """Whether a token has three parts, its signature and, if any, an expiry after now."""
    body = F.concat_ws(".", F.split_part(token, F.lit("."), F.lit(1)), F.split_part(token, F.lit("."), F.lit(2)))
    claims = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(claims, ((F.length(claims) + 3) / 4).cast("int") * 4, F.lit("="))
    expiry = F.get_json_object(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), "$.exp").try_cast("double")
    signed = _url64(F.unhex(hmac_sha256(body, secret))) == F.split_part(token, F.lit("."), F.lit(3))
    return F.coalesce((F.size(F.split(token, r"\.")) == 3) & signed & (expiry.isNull() | (expiry > now)), F.lit(False))


def bloom_size(capacity: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a filter for so many items at a rate of false positives."""
    bits = int(-capacity * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, int(bits / capacity * math.log(2)))


def bloom_bits(item: Column, bits: int, hashes: int) -> Column:
    """The bits of an item: double hashing over the halves of its MD5, little end first."""
    digest = F.md5(item.cast("binary"))
    half = lambda at: F.pmod(F.conv(F.concat(*[F.substring(digest, at + 2 * i, 2) for i in range(7, -1, -1)]), 16, 10).cast("decimal(20,0)"), F.lit(bits)).cast("long")
    a, b = half(1), half(17)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (a + i * b) % bits)


def bloom_seen(known: DataFrame, asked: DataFrame, item: str, capacity: int, rate: float = 0.01) -> DataFrame:
    """asked with seen: whether a filter of the known items may hold the item. Bits are a table of at most the filter's size."""
    bits, hashes = bloom_size(capacity, rate)
    held = known.select(F.explode(bloom_bits(F.col(item), bits, hashes)).alias("bit")).distinct()
    one = asked.select(item).distinct().select(item, F.explode(F.array_distinct(bloom_bits(F.col(item), bits, hashes))).alias("bit"))
    missing = one.join(held, "bit", "left_anti").select(item).distinct().withColumn("_no", F.lit(True))
    return asked.join(missing, item, "left").withColumn("seen", F.col("_no").isNull()).drop("_no")
