"""Risk profiles of algorithms as structs: algorithm, severity, quantum_risk, category; null where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qvault.functions.inference import classify_algorithm

FIELDS = ("algorithm", "severity", "quantum_risk", "category")
# Hashes, signatures of web tokens and key derivations with what they are called, how severe they are, and their risk; weak ciphers, modes by kind, and the kinds of weak names.
HASHES = {"md5": ("MD5", "Critical", "Classical Risk"), "sha1": ("SHA-1", "High", "Classical Risk"), "ripemd160": ("RIPEMD-160", "High", "Classical Risk"), "sha256": ("SHA-256", "Informational", "Safe"), "sha384": ("SHA-384", "Informational", "Safe"), "sha3": ("SHA-3", "Informational", "Safe"), "sha512": ("SHA-512", "Informational", "Safe")}
TOKENS = {
    "hs256": ("HMAC-SHA256 (JWT)", "Informational", "Safe"), "hs384": ("HMAC-SHA384 (JWT)", "Informational", "Safe"), "hs512": ("HMAC-SHA512 (JWT)", "Informational", "Safe"), "rs256": ("RSA-2048-SHA256 (JWT)", "Critical", "Quantum-Broken"), "rs384": ("RSA-3072-SHA384 (JWT)", "Critical", "Quantum-Broken"),
    "rs512": ("RSA-4096-SHA512 (JWT)", "Critical", "Quantum-Broken"), "es256": ("ECDSA-P256-SHA256 (JWT)", "Critical", "Quantum-Broken"), "es384": ("ECDSA-P384-SHA384 (JWT)", "Critical", "Quantum-Broken"), "es512": ("ECDSA-P521-SHA512 (JWT)", "Critical", "Quantum-Broken"), "none": ("None (JWT)", "Critical", "Classical Risk"),
}
DERIVATIONS = {"bcrypt": ("bcrypt", "Informational", "Safe"), "scrypt": ("scrypt", "Informational", "Safe"), "pbkdf2": ("PBKDF2", "Informational", "Safe"), "pbkdf2hmac": ("PBKDF2-HMAC", "Informational", "Safe")}
WEAK_CIPHERS = ["DES", "3DES", "DES3", "TDES", "RC2", "RC4", "ARC4", "BLOWFISH"]
AUTHENTICATED, UNAUTHENTICATED = ["GCM", "CCM", "POLY1305", "CHACHA20-POLY1305", "OCB"], ["CBC", "CTR", "CFB", "OFB"]
WEAK_HASHES = ["MD5", "SHA-1", "RIPEMD-160"]


def profile(*values: str | Column) -> Column:
    """A profile of four values; the category is ``algorithm`` where only three are given."""
    values = [v if isinstance(v, Column) else F.lit(v) for v in (*values, "algorithm")[:4]]
    return F.struct(*[v.alias(n) for v, n in zip(values, FIELDS, strict=True)])


def listed(table: dict[str, tuple[str, str, str]], name: Column) -> Column:
    """The profile that a table has for a name."""
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), profile(*v))])[name]


def weak_profile(name: Column) -> Column:
    """The profile of a name that is weak by itself."""
    found = classify_algorithm(name)
    category = F.when(found["weak"].isin(*WEAK_HASHES), "hash").otherwise("symmetric-cipher")
    return F.when(found["weak"].isNotNull(), profile(found["weak"], found["severity"], "Classical Risk", category))


def symmetric_profile(cipher: Column, mode: Column, bits: Column) -> Column:
    """By cipher, then mode, then bits; without bits an authenticated mode counts as one of 256."""
    cipher, mode = F.upper(cipher), F.upper(F.coalesce(mode, F.lit("")))
    label = F.when(bits > 0, F.concat(cipher, F.lit("-"), bits.cast("string"), F.lit("-"), mode)).when(mode != "", F.concat(cipher, F.lit("-"), mode)).otherwise(cipher)
    large, known = F.coalesce(bits >= 256, F.lit(True)), F.coalesce(bits >= 256, F.lit(False))
    of = lambda severity, risk: profile(label, severity, risk)
    return (
        F.when(cipher.isin(*WEAK_CIPHERS) | (mode == "ECB"), of("Critical", "Classical Risk"))
        .when(mode.isin(*AUTHENTICATED), of(F.when(large, "Informational").otherwise("Medium"), F.when(large, "Safe").otherwise("Quantum-Weakened")))
        .otherwise(of(F.when(known, "Low").otherwise("Medium"), F.lit("Quantum-Weakened")))
    )


def rsa_profile(bits: Column) -> Column:
    return profile(F.when(bits > 0, F.concat(F.lit("RSA-"), bits.cast("string"))).otherwise("RSA"), "Critical", "Quantum-Broken")


def curve_profile(curve: Column, purpose: Column) -> Column:
    """A curve that signs or exchanges keys."""
    return profile(F.concat(F.when(purpose == "signature", "ECDSA (").otherwise("ECDH ("), curve, F.lit(")")), "Critical", "Quantum-Broken")


# Spellings of hashes.
SPELLINGS = {
    "sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha384": "sha384", "sha-384": "sha384", "sha512": "sha512", "sha-512": "sha512", "sha3": "sha3", "sha-3": "sha3", "sha3-256": "sha3", "sha-3-256": "sha3", "sha3-384": "sha3", "sha3-512": "sha3",
    "md5": "md5", "keccak": "sha3", "keccak256": "sha3", "keccak-256": "sha3",
}


def normal_hash(name: Column) -> Column:
    spelled = F.replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("_"), F.lit("-")), F.lit(" "), F.lit(""))
    return F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])[spelled]


def hash_profile(name: Column) -> Column:
    """The profile of a normal name of a hash."""
    return F.coalesce(weak_profile(name), listed(HASHES, name))
