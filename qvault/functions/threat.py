"""The threat model's parts: families, counter-based draws, timelines, bands, lifetimes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qvault.functions.findings import lookup

# The generator's increment, scenario timelines (min, mode, max years), multipliers by key size, lifetimes and migration years by use.
INCREMENT = 0x6D2B79F5
OTHER_TIMELINE = (1, 4, 12)
SCENARIOS = {
    "optimistic": {"RSA": (18, 22, 28), "ECC": (20, 25, 30), "DH": (18, 22, 28), "AES": (35, 50, 80), "HASH": (35, 50, 80)},
    "median": {"RSA": (8, 12, 18), "ECC": (10, 15, 20), "DH": (8, 12, 18), "AES": (25, 40, 70), "HASH": (25, 40, 70)},
    "pessimistic": {"RSA": (3, 6, 10), "ECC": (4, 7, 12), "DH": (3, 6, 10), "AES": (15, 30, 60), "HASH": (15, 30, 60)},
}
KEY_SIZE_MULTIPLIERS = {
    "RSA": [(None, 2047, 0.98), (2048, 3071, 1.0), (3072, 4095, 1.03), (4096, None, 1.05)],
    "DH": [(None, 2047, 0.98), (2048, 3071, 1.0), (3072, 4095, 1.03), (4096, None, 1.05)],
    "AES": [(None, 127, 0.45), (128, 191, 0.6), (192, 255, 0.8), (256, None, 1.0)],
    "HASH": [(None, 255, 0.7), (256, None, 1.0)],
}
UNKNOWN_SIZE = {"AES": 0.55, "HASH": 0.7}
LIFETIME_YEARS = {"key_exchange": 20, "key_wrap": 20, "encryption": 20, "data_encryption": 20, "digital_signature": 0, "signature": 0, "auth": 0, "jwt": 0, "certificate": 0, "integrity_hashing": 10, "mac": 0, "unknown": 10}
_EXCHANGE = {"RSA": 2.5, "ECC": 2.0, "DH": 2.5, "AES": 1.5, "HASH": 1.0, "OTHER": 4.0, "PQC": 0.5}
_CIPHER = {"RSA": 2.0, "ECC": 2.0, "DH": 2.0, "AES": 1.5, "HASH": 1.0, "OTHER": 4.0, "PQC": 0.5}
_SIGNING = {"RSA": 3.0, "ECC": 3.0, "DH": 2.5, "AES": 1.5, "HASH": 1.5, "OTHER": 4.0, "PQC": 0.5}
MIGRATION_YEARS = {
    **dict.fromkeys(("key_exchange", "key_wrap"), _EXCHANGE),
    **dict.fromkeys(("encryption", "data_encryption", "integrity_hashing"), _CIPHER),
    **dict.fromkeys(("digital_signature", "signature", "auth", "jwt", "certificate"), _SIGNING),
    "mac": _CIPHER | {"HASH": 1.5},
    "unknown": {"RSA": 3.0, "ECC": 3.0, "DH": 3.0, "AES": 2.0, "HASH": 2.0, "OTHER": 4.0, "PQC": 0.5},
}
FAMILY_PATTERNS = [
    ("PQC", "^(ML-?KEM|ML-?DSA|SLH-?DSA|KYBER|DILITHIUM|SPHINCS|FALCON|BIKE|HQC|NTRU|XMSS|LMS)"),
    ("RSA", "^RSA(-|$)"),
    ("ECC", "^(ECC|ECDSA|ECDH|EDDSA|ED25519|X25519|SECP|P-[0-9])"),
    ("DH", "^(DH|DIFFIE|DSA)(-|$)"),
    ("AES", "^(AES|CHACHA|DES|3DES|TDES|RC[24]|BLOWFISH|FERNET)(-|$)"),
    ("HASH", "^(SHA|SHA[0-9]|MD[245]|HMAC|BLAKE|RIPEMD)(-|$)"),
]
WORD = 1 << 32


def risk_family(algorithm: Column) -> Column:
    name = F.regexp_replace(F.upper(F.coalesce(algorithm, F.lit(""))), "[ _]", "-")
    out = F.lit("OTHER")
    for family, pattern in reversed(FAMILY_PATTERNS):
        out = F.when(name.rlike(pattern), family).otherwise(out)
    return out


def uniform_draw(seed: int, i: Column) -> Column:
    """The i-th uniform draw, i from 1 on, of a 32-bit generator whose state is seed + i * INCREMENT; so each draw stands alone.

    32-bit products are made of 16-bit halves, which stay inside a long.
    """
    mask = F.lit(WORD - 1).cast("long")
    half = F.lit(65535).cast("long")
    state = (F.lit(seed % WORD).cast("long") + i.cast("long") * F.lit(INCREMENT).cast("long")).bitwiseAND(mask)

    def times(a: Column, b: Column) -> Column:
        high = (F.shiftrightunsigned(a, 16) * b.bitwiseAND(half)).bitwiseAND(half) * F.lit(65536).cast("long")
        return (a.bitwiseAND(half) * b + high).bitwiseAND(mask)

    def first(v: Column) -> Column:
        return times(v.bitwiseXOR(F.shiftrightunsigned(v, 15)), v.bitwiseOR(F.lit(1).cast("long")))

    def second(v: Column) -> Column:
        return v.bitwiseXOR((v + times(v.bitwiseXOR(F.shiftrightunsigned(v, 7)), v.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask))

    step = F.element_at(F.transform(F.array(F.element_at(F.transform(F.array(state), first), 1)), second), 1)
    last = F.element_at(F.transform(F.array(step), lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 14))), 1)
    return last / F.lit(float(WORD))


def triangular(u: Column, low: Column, mode: Column, high: Column) -> Column:
    split = (mode - low) / (high - low)
    return F.when(low == high, low).when(u < split, low + F.sqrt(u * (high - low) * (mode - low))).otherwise(high - F.sqrt((1 - u) * (high - low) * (high - mode)))


def standard_normal(u1: Column, u2: Column) -> Column:
    return F.sqrt(-2 * F.log(F.greatest(u1, F.lit(5e-324)))) * F.cos(F.lit(2 * 3.141592653589793) * u2)


def lognormal(u1: Column, u2: Column, mean: Column, sd: Column) -> Column:
    s2 = F.log1p(F.pow(sd / mean, 2))
    return F.exp(F.log(mean) - s2 / 2 + F.sqrt(s2) * standard_normal(u1, u2))


def key_size_multiplier(family: Column, key_size: Column) -> Column:
    out = F.lit(1.0)
    for name, rows in KEY_SIZE_MULTIPLIERS.items():
        own = F.lit(UNKNOWN_SIZE.get(name, 1.0))
        for low, high, value in reversed(rows):
            inside = key_size.isNotNull() & (F.lit(True) if low is None else key_size >= low) & (F.lit(True) if high is None else key_size <= high)
            own = F.when(inside, value).otherwise(own)
        out = F.when(family == name, own).otherwise(out)
    return out


def canonical_usage(usage: Column) -> Column:
    named = F.regexp_replace(F.trim(F.lower(F.regexp_replace(F.coalesce(usage, F.lit("unknown")), "([a-z])([A-Z])", "$1_$2"))), "[ -]+", "_")
    return (
        F.when(named.isin(*LIFETIME_YEARS), named).when(named.contains("signature"), "digital_signature").when(named.contains("certificate"), "certificate").when(named.contains("jwt"), "jwt").when(named.contains("auth"), "auth").otherwise("unknown")
    )


def is_signature(usage: Column) -> Column:
    return F.lower(F.coalesce(usage, F.lit(""))).rlike("signature|auth|jwt|certificate")


def lifetime_years(usage: Column, override: Column | None = None) -> Column:
    """How long data must stay secret; zero for signatures, where only a break before migration counts."""
    table = F.create_map(*[F.lit(x) for k, v in LIFETIME_YEARS.items() for x in (k, float(v))])
    default = table[canonical_usage(usage)]
    return F.when(is_signature(usage), 0.0).otherwise(default if override is None else F.coalesce(override, default))


def migration_years(usage: Column, family: Column, override: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for u, row in MIGRATION_YEARS.items() for f, years in row.items() for x in (f"{u}|{f}", years)])
    default = table[F.concat_ws("|", canonical_usage(usage), family)]
    return default if override is None else F.coalesce(override, default)


def risk_band(p: Column) -> Column:
    return F.when(p < 0.01, "MINIMAL").when(p < 0.05, "LOW").when(p < 0.2, "MODERATE").when(p < 0.5, "HIGH").otherwise("CRITICAL")


def confidence_value(c: Column) -> Column:
    """A label, a percentage or a number as 0 to 1."""
    text = F.lower(F.trim(c))
    number = F.regexp_replace(text, "%$", "").try_cast("double")
    named = lookup(text, {"confirmed": 0.95, "high": 0.9, "likely": 0.75, "medium": 0.6, "possible": 0.4, "low": 0.3})
    return F.coalesce(named, F.when(number.isNotNull() & text.endswith("%"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number / 100))), F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))), F.lit(0.5))
