"""Signatures and encrypted tokens."""

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(body: Column, secret: str) -> Column:
    """HMAC-SHA256 in hex, of two digests over padded keys."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(F.coalesce(body, F.lit("")), "UTF-8")), 256))), 256)


def signature_holds(body: Column, header: Column, secret: str) -> Column:
    """Whether ``sha256=<hex>`` signs the body; without a secret or header never."""
    if not secret:
        return F.lit(False)
    return F.coalesce(header == F.concat(F.lit("sha256="), hmac_sha256(body, secret)), F.lit(False))


def _packed_once(packed: Column, cut) -> Column:
    """cut(packed) with packed evaluated once: every evaluation draws another initial vector."""
    return F.get(F.transform(F.array(F.lower(F.hex(packed))), cut), F.lit(0))


def encrypt_token(plain: Column, key_hex: str) -> Column:
    """AES-256-GCM as ``iv:ciphertext:tag`` in hex, in the order in which Spark's own function packs the three."""
    cut = lambda p: F.concat_ws(":", F.substring(p, 1, 24), F.substring(p, F.lit(25), F.length(p) - 56), F.right(p, F.lit(32)))
    return _packed_once(F.aes_encrypt(plain, F.unhex(F.lit(key_hex)), F.lit("GCM")), cut)


def decrypt_token(token: Column, key_hex: str) -> Column:
    """Null where the token or its tag was tampered with, or has not three parts."""
    return F.when(F.size(F.split(token, ":")) == 3, F.try_aes_decrypt(F.unhex(F.replace(token, F.lit(":"), F.lit(""))), F.unhex(F.lit(key_hex)), F.lit("GCM")).cast("string"))


def is_legacy_token(token: Column) -> Column:
    return F.size(F.split(token, ":")) == 2


def encrypt_legacy_token(plain: Column, key_hex: str) -> Column:
    """AES-256-CBC as ``iv:ciphertext`` in hex, the older form."""
    cut = lambda p: F.concat_ws(":", F.substring(p, 1, 32), F.substring(p, F.lit(33), F.length(p)))
    return _packed_once(F.aes_encrypt(plain, F.unhex(F.lit(key_hex)), F.lit("CBC")), cut)


def decrypt_any_token(token: Column, key_hex: str) -> Column:
    """Tokens of both forms; null where they can't be read."""
    old = F.try_aes_decrypt(F.unhex(F.replace(token, F.lit(":"), F.lit(""))), F.unhex(F.lit(key_hex)), F.lit("CBC")).cast("string")
    return F.when(is_legacy_token(token), old).otherwise(decrypt_token(token, key_hex))


def renewed_token(token: Column, key_hex: str) -> Column:
    """A token of the older form that can be read, encrypted anew; any other as it is."""
    plain = decrypt_any_token(token, key_hex)
    return F.when(is_legacy_token(token) & plain.isNotNull(), encrypt_token(plain, key_hex)).otherwise(token)
