"""JA3 and JA4 fingerprints of TLS ClientHellos, as column expressions over arrays of codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sixteen reserved GREASE codes (RFC 8701): 0x0A0A, 0x1A1A and so on.
GREASE = [0x0A0A + 0x1010 * n for n in range(16)]
#: JA4 codes of TLS and DTLS versions.
VERSIONS = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0x0002: "s2", 0xFEFF: "d1", 0xFEFD: "d2", 0xFEFC: "d3"}
SNI, ALPN = 0x0000, 0x0010
EMPTY = "000000000000"


def real(codes: Column) -> Column:
    """Codes that are not GREASE; a null array is an empty one."""
    return F.filter(F.coalesce(codes, F.array().cast("array<int>")), lambda x: ~x.isin(*GREASE))


def _all(codes: Column) -> Column:
    return F.coalesce(codes, F.array().cast("array<int>"))


def effective_version(supported: Column, legacy: Column) -> Column:
    return F.coalesce(F.array_max(real(supported)), legacy)


def ja3_text(legacy: Column, ciphers: Column, extensions: Column, groups: Column, formats: Column) -> Column:
    joined = [F.array_join(c.cast("array<string>"), "-") for c in (real(ciphers), real(extensions), real(groups), _all(formats))]
    return F.concat_ws(",", legacy.cast("string"), *joined)


def ja3(*hello: Column) -> Column:
    return F.md5(ja3_text(*hello))


def _hex4(codes: Column) -> Column:
    return F.transform(codes, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0"))


def _hash12(text: Column) -> Column:
    return F.substr(F.sha2(text, 256), F.lit(1), F.lit(12))


def ja4_alpn(protocols: Column) -> Column:
    """First and last character of the first protocol, of its hex form where either is no letter or digit."""
    hexed = F.lower(F.hex(F.try_element_at(protocols, F.lit(1))))
    first, last = F.substr(hexed, F.lit(1), F.lit(2)), F.right(hexed, F.lit(2))
    plain = lambda h: F.unhex(h).cast("string").rlike("^[0-9A-Za-z]$")
    text = F.concat(F.unhex(first).cast("string"), F.unhex(last).cast("string"))
    code = F.when(plain(first) & plain(last), text).otherwise(F.concat(F.left(hexed, F.lit(1)), F.right(hexed, F.lit(1))))
    return F.when(F.coalesce(F.length(hexed), F.lit(0)) == 0, "00").otherwise(code)


def ja4_cipher_hash(ciphers: Column) -> Column:
    kept = real(ciphers)
    return F.when(F.size(kept) == 0, EMPTY).otherwise(_hash12(F.array_join(F.array_sort(_hex4(kept)), ",")))


def ja4_extension_hash(extensions: Column, signatures: Column) -> Column:
    kept = F.filter(real(extensions), lambda x: ~x.isin(SNI, ALPN))
    listed, signed = F.array_join(F.array_sort(_hex4(kept)), ","), real(signatures)
    whole = F.when(F.size(signed) > 0, F.concat_ws("_", listed, F.array_join(_hex4(signed), ","))).otherwise(listed)
    return F.when(F.size(kept) == 0, EMPTY).otherwise(_hash12(whole))


def ja4(legacy: Column, supported: Column, sni: Column, ciphers: Column, extensions: Column, signatures: Column, alpn: Column, transport: str = "t") -> Column:
    codes = F.create_map(*[F.lit(x) for pair in VERSIONS.items() for x in pair])
    version = F.coalesce(F.try_element_at(codes, effective_version(supported, legacy)), F.lit("00"))
    count = lambda c: F.lpad(F.least(F.size(real(c)), F.lit(99)).cast("string"), 2, "0")
    head = F.concat(F.lit(transport), version, F.when(F.coalesce(F.length(sni), F.lit(0)) > 0, "d").otherwise("i"), count(ciphers), count(extensions), ja4_alpn(alpn))
    return F.concat_ws("_", head, ja4_cipher_hash(ciphers), ja4_extension_hash(extensions, signatures))


def structure(legacy: Column, supported: Column, sni: Column, ciphers: Column, extensions: Column, groups: Column, formats: Column, signatures: Column, alpn: Column, known_bad: Column) -> dict[str, Column]:
    """Nine integers that describe a ClientHello. GREASE does not count, except among signature algorithms."""
    return {
        "num_ciphers": F.size(real(ciphers)),
        "num_extensions": F.size(real(extensions)),
        "has_sni": F.when(F.coalesce(F.length(sni), F.lit(0)) > 0, 1).otherwise(0),
        "num_alpn_protocols": F.size(F.coalesce(alpn, F.array().cast("array<binary>"))),
        "num_supported_groups": F.size(real(groups)),
        "num_signature_algorithms": F.size(_all(signatures)),
        "num_ec_point_formats": F.size(_all(formats)),
        "tls_version": effective_version(supported, legacy),
        "ja4_known_bad": F.when(known_bad, 1).otherwise(0),
    }
