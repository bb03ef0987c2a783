"""Sizes of keys, signatures and ciphertexts by algorithm, and names as texts spell them."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (name, family, kind, bytes of a public key, of a signature, of a ciphertext); symmetric algorithms and hashes change no payload.
ALGORITHMS = [
    ("RSA-2048", "RSA", "signature_kem", 256, 256, 256), ("RSA-3072", "RSA", "signature_kem", 384, 384, 384), ("RSA-4096", "RSA", "signature_kem", 512, 512, 512), ("ECDSA P-256", "ECDSA", "signature", 64, 64, None), ("ECDSA P-384", "ECDSA", "signature", 96, 96, None),
    ("Ed25519", "Ed25519", "signature", 32, 64, None), ("ECDH P-256", "ECDH", "kem", 65, None, 65), ("X25519", "X25519", "kem", 32, None, 32), ("ML-DSA-44", "ML-DSA", "signature", 1312, 2420, None), ("ML-DSA-65", "ML-DSA", "signature", 1952, 3309, None), ("ML-DSA-87", "ML-DSA", "signature", 2592, 4627, None),
    ("Falcon-512", "Falcon", "signature", 897, 666, None), ("Falcon-1024", "Falcon", "signature", 1793, 1280, None), ("SLH-DSA-SHA2-128s", "SLH-DSA", "signature", 32, 7856, None), ("SLH-DSA-SHA2-128f", "SLH-DSA", "signature", 32, 17088, None), ("SLH-DSA-SHA2-192s", "SLH-DSA", "signature", 48, 16224, None),
    ("SLH-DSA-SHA2-256s", "SLH-DSA", "signature", 64, 29792, None), ("SLH-DSA-SHA2-256f", "SLH-DSA", "signature", 64, 49856, None), ("ML-KEM-512", "ML-KEM", "kem", 800, None, 768), ("ML-KEM-768", "ML-KEM", "kem", 1184, None, 1088), ("ML-KEM-1024", "ML-KEM", "kem", 1568, None, 1568),
    ("X25519MLKEM768", "Hybrid", "kem", 1216, None, 1120), ("AES-ECB", "AES-ECB", "symmetric", None, None, None), ("AES-128", "AES", "symmetric", None, None, None), ("AES-256-GCM", "AES", "symmetric", None, None, None), ("DES", "DES", "symmetric", None, None, None), ("3DES", "DES", "symmetric", None, None, None),
    ("RC4", "RC4", "symmetric", None, None, None), ("MD5", "MD5", "hash", None, None, None), ("SHA-1", "SHA", "hash", None, None, None), ("SHA-256", "SHA", "hash", None, None, None), ("SHA-384", "SHA", "hash", None, None, None), ("SHA3-256", "SHA3", "hash", None, None, None),
]
# Patterns of upper-case texts that mean an algorithm, in the order that decides.
SPELLED = [
    ("ML-DSA-65|DILITHIUM3", "ML-DSA-65"), ("ML-DSA-44|DILITHIUM2", "ML-DSA-44"), ("ML-DSA-87|DILITHIUM5", "ML-DSA-87"), ("FALCON-?512", "Falcon-512"), ("FALCON-?1024", "Falcon-1024"), ("SLH-DSA-SHA2-128S", "SLH-DSA-SHA2-128s"), ("SLH-DSA-SHA2-128F", "SLH-DSA-SHA2-128f"), ("SLH-DSA-SHA2-192S", "SLH-DSA-SHA2-192s"),
    ("SLH-DSA-SHA2-256S", "SLH-DSA-SHA2-256s"), ("SLH-DSA-SHA2-256F", "SLH-DSA-SHA2-256f"), ("X25519MLKEM768|HYBRID X25519", "X25519MLKEM768"), ("ML-KEM-768|KYBER768", "ML-KEM-768"), ("ML-KEM-512|KYBER512", "ML-KEM-512"), ("ML-KEM-1024|KYBER1024", "ML-KEM-1024"), ("4096", "RSA-4096"), ("3072", "RSA-3072"), ("RSA", "RSA-2048"),
    ("P-384|SECP384R1", "ECDSA P-384"), ("P-256|SECP256R1|ECDSA|(^| )EC( |$)", "ECDSA P-256"), ("ED25519", "Ed25519"), ("ECDH", "ECDH P-256"), ("X25519", "X25519"), ("AES.*ECB|ECB.*AES", "AES-ECB"), ("AES-256", "AES-256-GCM"), ("AES", "AES-128"), ("3DES|TRIPLEDES", "3DES"), ("DES", "DES"), ("RC4", "RC4"),
    ("SHA-?384", "SHA-384"), ("SHA3", "SHA3-256"), ("SHA-?256", "SHA-256"), ("SHA-?1", "SHA-1"), ("MD5", "MD5"),
]
# What libraries are used for, where nothing else tells.
LIBRARIES = {
    "elliptic": "ECDSA P-256", "secp256k1": "ECDSA P-256", "ecdsa": "ECDSA P-256", "node-forge": "RSA-2048", "jsrsasign": "RSA-2048", "pyopenssl": "RSA-2048", "pycryptodome": "AES-128", "cryptography": "RSA-2048",
    "bouncycastle": "RSA-2048", "bcprov": "RSA-2048", "tweetnacl": "Ed25519", "ed25519": "Ed25519", "libsodium": "Ed25519", "nacl": "Ed25519", "noble-curves": "ECDSA P-256", "@noble/curves": "ECDSA P-256",
}
# Bytes that places of use allow, of a certificate besides key and signature, of the claims and the header of a token, and how many certificates are sent.
LIMITS = {"cookie": 4096, "header line": 8192, "first flight": 14600, "QR code": 2953, "radio frame": 20}
CERTIFICATE, CERTIFICATES, CLAIMS, HEADER, KEY_SHARE = 300, 3, 200, 36, 32


def holds(text: Column, pattern: str) -> Column:
    """Whether a text holds a pattern: plain words, some with a dash that may be missing, are looked for as they are, which takes a fraction of the time."""
    if not re.fullmatch(r"[A-Z0-9 |?-]+", pattern):
        return text.rlike(pattern)
    words = [w for p in pattern.split("|") for w in ([p.replace("-?", "-"), p.replace("-?", "")] if "-?" in p else [p])]
    return reduce(or_, [text.contains(w) for w in words])


def normal_algorithm(text: Column) -> Column:
    """The algorithm that a text means, by the first pattern that it holds; null if none."""
    first = lambda t: F.coalesce(*[F.when(holds(t, p), name) for p, name in SPELLED])
    return F.get(F.transform(F.array(F.upper(F.trim(text))), first), F.lit(0))  # the text is put in upper case once, not for each pattern


def library_algorithm(library: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LIBRARIES.items() for x in pair])[library]


def attributes(name: Column) -> Column:
    """struct(family, kind, key, signature, ciphertext) of an algorithm's name."""
    row = lambda r: F.struct(F.lit(r[1]).alias("family"), F.lit(r[2]).alias("kind"), *[F.lit(x).cast("long").alias(n) for n, x in zip(("key", "signature", "ciphertext"), r[3:], strict=True)])
    return F.create_map(*[x for r in ALGORITHMS for x in (F.lit(r[0]), row(r))])[name]
