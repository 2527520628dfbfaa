"""Key expressions: repository URL keys, canonical user ids (UUIDv5), HMAC-SHA256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import NAMESPACE_OID_HEX, ZERO_UUID


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def norm_url(url, mode: str = "suffix") -> Column:
    """Dedupe / join key of a repository URL.

    ``suffix``  : strip trailing ``/``, strip one trailing ``.git``, lower-case.
    ``charset`` : strip trailing ``/`` then trailing characters from the set ``{.,g,i,t}``
                  before lower-casing — reproduces the character-set strip of the
                  surveyed service (``…/a/digit`` becomes ``…/a/d``).
    """
    u = F.regexp_replace(F.coalesce(_c(url), F.lit("")), r"/+\z", "")
    if mode == "suffix":
        return F.lower(F.regexp_replace(u, r"\.git\z", ""))
    if mode == "charset":
        return F.lower(F.regexp_replace(u, r"[.git]+\z", ""))
    raise ValueError(mode)


#: What Python's str.strip() removes: the characters for which str.isspace() holds (fixed values).
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
               "\u200a\u2028\u2029\u202f\u205f\u3000")


def py_strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace (Spark ``trim`` only strips spaces)."""
    return F.btrim(_c(col), F.lit(WHITE_SPACE))


def _hyphenate(hex32: Column) -> Column:
    return F.concat_ws("-", F.substring(hex32, 1, 8), F.substring(hex32, 9, 4), F.substring(hex32, 13, 4),
                       F.substring(hex32, 17, 4), F.substring(hex32, 21, 12))


def uuid5_oid(name) -> Column:
    """RFC 4122 version-5 UUID of ``name`` in the OID name space, all JVM-side."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_OID_HEX)), F.encode(_c(name), "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def canonical_user_id(col) -> Column:
    """Valid UUID text -> canonical form; null / empty / zero UUID -> zero UUID;
    anything else -> UUIDv5(OID, text). UUID parsing accepts braces, ``urn:uuid:`` and
    missing hyphens, as Python's ``uuid.UUID`` does."""
    s = _c(col)
    hexed = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "urn:|uuid:", ""), r"^\{+|\}+$", ""), "-", "")
    is_uuid = hexed.rlike(r"^[0-9a-fA-F]{32}\z")
    return (F.when(s.isNull() | (s == "") | (s == ZERO_UUID), F.lit(ZERO_UUID))
             .when(is_uuid, _hyphenate(F.lower(hexed)))
             .otherwise(uuid5_oid(s)))


def hmac_pads(secret) -> tuple[Column, Column]:
    """HMAC-SHA256 inner and outer pads of a secret (BINARY), computed per row in the JVM.

    Keys longer than the 64-byte block are first hashed; the key is zero-padded to 64
    bytes and XOR-ed with 0x36 / 0x5c byte by byte.
    """
    key = _c(secret)
    key = F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)
    hexkey = F.rpad(F.hex(key), 128, "0")
    idx = F.sequence(F.lit(0), F.lit(63))

    def pad(x: int) -> Column:
        return F.when(key.isNotNull(), F.unhex(F.array_join(F.transform(
            idx, lambda i: F.lpad(F.hex(F.conv(F.substring(hexkey, i * 2 + 1, 2), 16, 10).cast("int")
                                        .bitwiseXOR(F.lit(x))), 2, "0")), "")))
    return pad(0x36), pad(0x5C)


def hmac_sha256_hex(ipad: Column, opad: Column, message: Column) -> Column:
    """hex(HMAC-SHA256) from precomputed pads: H(opad || H(ipad || m))."""
    inner = F.unhex(F.sha2(F.concat(ipad, message), 256))
    return F.sha2(F.concat(opad, inner), 256)
