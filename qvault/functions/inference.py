"""Columns that infer what a finding leaves unsaid: whether a named algorithm is weak, its key size, its library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qvault.functions.findings import lookup

# Names that are no cryptography, names that are strong, weak names by class with their severity, key sizes that names hold, and sizes by name.
NON_CRYPTO = [
    "gzip", "zstd", "snappy", "lz4", "deflate", "bzip2", "br", "brotli", "lzo", "none", "raw", "null", "plain", "round-robin", "least-connections", "random",
    "linear", "binary", "dijkstra", "astar", "kmeans", "pca", "auto", "default", "lru", "lfu", "fifo",
]
STRONG = [
    "sha256", "sha-256", "sha3", "sha-3", "sha384", "sha-384", "sha512", "sha-512", "aes-gcm", "aes-256-gcm", "aes-128-gcm", "chacha20-poly1305", "poly1305", "ml-kem", "ml-dsa", "slh-dsa", "ed25519", "x25519", "argon2", "argon2id",
    "bcrypt", "scrypt", "pbkdf2-sha256", "pbkdf2-sha512", "pbkdf2", "pbkdf2hmac", "hs256", "hs384", "hs512", "tls_aes_256_gcm_sha384", "tls_chacha20_poly1305_sha256", "tls_aes_128_gcm_sha256",
]
WEAK = {
    "MD5": ("Critical", ["md5", "md4", "md2"]),
    "SHA-1": ("High", ["sha1", "sha-1"]),
    "RIPEMD-160": ("Medium", ["ripemd160", "ripemd"]),
    "3DES/DES": ("Critical", ["des", "3des", "des3", "tripledes", "tdes"]),
    "RC4": ("Critical", ["rc4", "arc4", "rc2", "arc2"]),
    "Blowfish/Legacy": ("High", ["blowfish", "cast5", "idea"]),
}
OTHER_KNOWN = [
    "aes", "aes-128", "aes-256", "aes-cbc", "aes-ecb", "rsa", "dsa", "ecdh", "ecdsa", "ecc", "rs256", "rs384", "rs512", "es256", "es384", "es512", "ps256", "ps384", "ps512", "jwt",
]
KEY_SIZES = [8192, 4096, 3072, 2048, 1024, 512, 256, 192, 128, 56, 112]
SIZE_OF_NAME = {"3DES": 112, "DES": 56, "BLOWFISH": 128, "RC4": 128}
TAG_LIBRARIES = {"dockerfile": "Dockerfile", "nginx": "nginx", "apache": "apache", "terraform": "terraform", "k8s": "kubernetes"}
PYTHON_RULES = {"secrets": "secrets", "os.": "os", "hmac": "hmac", "random": "random"}


def classify_algorithm(value: Column) -> Column:
    """struct(weak, severity) of a configured name; nulls if it is strong, unknown or no cryptography.

    The whole name counts, and the part before its first separator.
    """
    name = F.regexp_replace(F.lower(F.trim(value)), "^[\"']+|[\"']+$", "")
    head = F.split(name, r"[/_\-\s]")[0]
    weak = F.create_map(*[F.lit(x) for k, (_, names) in WEAK.items() for n in names for x in (n, k)])
    severity = F.create_map(*[F.lit(x) for k, (s, _) in [*WEAK.items(), ("ECB Mode", ("Critical", []))] for x in (k, s)])
    fine = name.isin(*NON_CRYPTO, *STRONG) | head.isin(*NON_CRYPTO, *STRONG)
    ecb = F.array_contains(F.split(name, "-"), "ecb") | F.array_contains(F.split(name, "_"), "ecb")
    kind = F.when(~fine, F.coalesce(weak[name], weak[head], F.when(ecb, "ECB Mode")))
    return F.struct(kind.alias("weak"), severity[kind].alias("severity"))


def is_known_algorithm(value: Column) -> Column:
    """Whether a value, or the part before its first separator, is the name of an algorithm and no secret."""
    name = F.regexp_replace(F.lower(F.trim(value)), "^[\"']+|[\"']+$", "")
    known = [*NON_CRYPTO, *STRONG, *OTHER_KNOWN, *(n for _, names in WEAK.values() for n in names)]
    return name.isin(*known) | F.split(name, r"[/_\-\s]")[0].isin(*known)


def infer_key_size(algorithm: Column, rule_id: Column, snippet: Column) -> Column:
    """Bits that the algorithm, else the rule, else an RSA snippet states; else those that the algorithm always has."""
    name, rule = F.upper(F.coalesce(algorithm, F.lit(""))), F.coalesce(rule_id, F.lit(""))
    stated = lambda text, sizes: F.nullif(F.regexp_extract(text, rf"\b({'|'.join(map(str, sizes))})\b", 1), F.lit("")).cast("int")
    rsa = name.contains("RSA") | F.upper(rule).contains("RSA")
    known = F.lit(None).cast("int")
    for part, size in reversed(SIZE_OF_NAME.items()):
        known = F.when(name.contains(part), size).otherwise(known)
    return F.coalesce(stated(name, KEY_SIZES), stated(rule, KEY_SIZES), F.when(rsa, stated(F.coalesce(snippet, F.lit("")), [s for s in KEY_SIZES if s >= 512])), known)


def infer_library(library: Column, tags: Column, rule_id: Column, language: Column) -> Column:
    """The stated library, else what the tags, the rule and the language tell, in this order."""
    tags, rule = F.coalesce(tags, F.array().cast("array<string>")), F.coalesce(rule_id, F.lit(""))
    tagged = lambda word: F.exists(tags, lambda t: t.contains(word))
    either = lambda word, in_rule: tagged(word) | rule.contains(in_rule)
    package = F.get(F.filter(tags, lambda t: ~t.isin("sca", "npm", "pip", "maven")), F.lit(0))
    by_tag = F.coalesce(*[F.when(F.array_contains(tags, t), name) for t, name in TAG_LIBRARIES.items()])
    python = F.when(either("pycryptodome", "pycryptodome"), "pycryptodome").when(either("cryptography", "cryptography"), "cryptography")
    for part, name in PYTHON_RULES.items():
        python = python.when(rule.contains(part), name)
    by_language = F.when(language == "python", python.otherwise("hashlib")).otherwise(lookup(language, {"javascript": "Node Builtin crypto", "typescript": "Node Builtin crypto"}, "Standard Crypto API"))
    return F.coalesce(
        F.nullif(library, F.lit("")),
        F.when(F.array_contains(tags, "sca"), package),
        F.when(either("crypto-js", "cryptojs") | tagged("cryptojs"), "crypto-js").when(either("jsrsasign", "jsrsasign"), "jsrsasign"),
        by_tag,
        by_language,
    )
