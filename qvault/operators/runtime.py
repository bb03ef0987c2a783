"""Runtime events: validate, aggregate, match to findings, report, classify. The streaming forms are in qvault.streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qvault.functions.findings import lookup

# Operations that events may name, canonical algorithm names, and names that a quantum computer breaks.
OPERATIONS = ("hash", "encrypt", "decrypt", "sign", "verify", "keygen", "kdf", "hmac", "tls", "other")
CANONICAL = {
    "md5": "MD5", "sha1": "SHA-1", "sha-1": "SHA-1", "sha224": "SHA-224", "sha-224": "SHA-224", "sha256": "SHA-256", "sha-256": "SHA-256", "sha_256": "SHA-256", "sha384": "SHA-384", "sha-384": "SHA-384", "sha_384": "SHA-384",
    "sha512": "SHA-512", "sha-512": "SHA-512", "sha_512": "SHA-512", "sha3_256": "SHA3-256", "sha3-256": "SHA3-256", "sha3_512": "SHA3-512", "sha3-512": "SHA3-512", "blake2b": "BLAKE2b", "blake2s": "BLAKE2s",
    "aes": "AES", "aes128": "AES-128", "aes-128": "AES-128", "aes192": "AES-192", "aes-192": "AES-192", "aes256": "AES-256", "aes-256": "AES-256", "des": "DES", "3des": "3DES", "tripledes": "3DES", "rc4": "RC4",
    "chacha20": "ChaCha20", "chacha20-poly1305": "ChaCha20-Poly1305", "rsa": "RSA", "dsa": "DSA", "ecdsa": "ECDSA", "ec": "ECDSA", "ecdh": "ECDH", "ed25519": "Ed25519", "ed448": "Ed448", "dh": "DH",
    "pbkdf2": "PBKDF2", "scrypt": "scrypt", "argon2": "Argon2", "argon2i": "Argon2i", "argon2id": "Argon2id", "bcrypt": "bcrypt", "hkdf": "HKDF", "hmac": "HMAC", "hmac-sha256": "HMAC-SHA256",
}
#: How unlisted names begin, and what they hold, in the order that decides.
BEGINNINGS = {"aes": "AES", "rsa": "RSA", "ecdsa": "ECDSA", "ec-": "ECDSA", "secp256r1": "ECDSA"}
PARTS = {"sha256": "SHA-256", "sha-256": "SHA-256", "sha512": "SHA-512", "sha-512": "SHA-512", "sha1": "SHA-1", "sha-1": "SHA-1", "md5": "MD5", "hmac": "HMAC"}
BROKEN_BY_QUANTUM = ("RSA", "ECDSA", "ECDH", "DH", "DSA", "ED25519", "ED448")
MAX_COUNT = 1_000_000_000


def canonical_algorithm(name: Column) -> Column:
    """The one name of an algorithm: by the table, by how it begins, by what it holds, else in upper case."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    table = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    begun = [F.when(low.startswith(k), v) for k, v in BEGINNINGS.items()]
    held = [F.when(low.contains(k), v) for k, v in PARTS.items()]
    return F.when(low == "", "UNKNOWN").otherwise(F.coalesce(table[low], *begun, *held, F.upper(F.trim(name))))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+|[./]+$", ""), "/"), -1)


def validate_events(events: DataFrame) -> DataFrame:
    """Events with ``reject_reason``, null where they are accepted; nothing is dropped."""
    reason = (
        F.when(F.col("run_id").isNull(), "run_id missing").when(F.col("algorithm").isNull(), "algorithm missing").when(~F.col("operation").isin(*OPERATIONS), "operation unknown").when((F.col("count") < 1) | (F.col("count") > MAX_COUNT), "count out of range")
    )
    return events.withColumn("reject_reason", reason)


def event_identity(*columns: str) -> Column:
    """A hash over the fields that make events the same call."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 256)


def aggregate_events(events: DataFrame, identity: Sequence[str]) -> DataFrame:
    """One row per identity: counts add up, the first event's attributes stay."""
    return events.groupBy(*identity).agg(F.sum("count").alias("count"), F.min_by("host", F.struct("ts", "event_id")).alias("host"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def session_gate(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events with ``accepted``: their session is recording, and they are not after its stop."""
    joined = events.join(sessions.select("run_id", "status", "stopped_at"), "run_id", "left")
    ok = (F.col("status") == "recording") | (F.col("stopped_at").isNotNull() & (F.col("ts") <= F.col("stopped_at")))
    return joined.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("status", "stopped_at")


def session_progress(events: DataFrame, identity: Sequence[str], max_distinct: int = 10_000) -> DataFrame:
    return events.groupBy("run_id").agg(F.sum("count").alias("total"), F.max("ts").alias("last_event"), F.count_distinct(*identity).alias("distinct_events")).withColumn("over_limit", F.col("distinct_events") > max_distinct)


def first_per_line(findings: DataFrame, path: Column, keys: Sequence[str] = ()) -> DataFrame:
    """The finding with the smallest ordinal of each file (of a repository, by ``keys``), algorithm and line: no other of the line can be an event's match."""
    f = findings.where("finding_id is not null").select(*keys, path.alias("_file"), canonical_algorithm(F.col("algorithm")).alias("_algo"), F.col("line").alias("_line"), F.struct(F.col("ordinal").alias("_ordinal"), "finding_id").alias("_first"))
    return f.groupBy(*keys, "_file", "_algo", "_line").agg(F.min("_first").alias("_first")).select(*keys, "_file", "_algo", "_line", "_first.*")


def match_events(events: DataFrame, findings: DataFrame, tolerance: int = 15, full_path: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Events with the finding of the same file and algorithm: on the line, else the nearest within ``tolerance``, else the first in the file.

    ``keys`` (a repository, a scan) are columns of both that must be equal: over
    a fleet the same names of files are in many repositories.
    """
    path = F.col("file") if full_path else base_name(F.col("file"))
    f = first_per_line(findings, path, keys)
    e = events.withColumns({"_file": path, "_algo": canonical_algorithm(F.col("algorithm"))})
    distance = F.when((F.col("line") > 0) & (F.col("_line") > 0), F.abs(F.col("line") - F.col("_line"))).otherwise(9999)
    kind = F.when(distance == 0, 0).when(distance <= tolerance, 1).otherwise(2)
    # The best of each event by a plain aggregate: it combines before the shuffle, where a window would gather all candidates.
    joined = e.join(f, [*keys, "_file", "_algo"], "left")
    best = joined.groupBy("event_id").agg(F.min(F.when(F.col("finding_id").isNotNull(), F.struct(kind.alias("kind"), F.when(kind == 1, distance).otherwise(0).alias("distance"), F.col("_ordinal"), F.col("finding_id")))).alias("m"))
    reason = F.when(F.col("m").isNull(), "unmatched").otherwise(F.element_at(F.array(F.lit("exact_line"), F.lit("same_function"), F.lit("same_file_algorithm")), F.col("m.kind") + 1))
    certainty = F.when(F.col("m").isNull(), "none").otherwise(F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("m.kind") + 1))
    return best.select("event_id", F.col("m.finding_id").alias("matched_finding_id"), reason.alias("match_reason"), certainty.alias("match_confidence"))


def evidence_report(events: DataFrame) -> DataFrame:
    """One row per call site: count, first and last seen, first match, vulnerability."""
    site = ["run_id", "algorithm", "operation", "library", "file", "line"]
    out = events.groupBy(*site).agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("matched_finding_id", F.when(F.col("matched_finding_id").isNotNull(), F.struct("ts", "event_id"))).alias("matched_finding_id"))
    return out.withColumn("is_quantum_vulnerable", F.upper("algorithm").isin(*BROKEN_BY_QUANTUM))


def classify_runtime(events: DataFrame) -> DataFrame:
    """Events as findings: severity, risk and category by algorithm and operation; plain HTTP to a third party is one of its own."""
    algo = canonical_algorithm(F.col("algorithm"))
    of = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("severity", "quantum_risk", "category"), strict=True)])
    profile = (
        F.when(algo.isin("RSA", "ECDSA", "ECDH", "DH", "DSA", "Ed25519"), of("Critical", "Quantum-Broken", "asymmetric"))
        .when(algo.isin("MD5", "DES", "3DES", "RC4"), of("Critical", "Classical Risk", "weak"))
        .when(algo == "SHA-1", of("High", "Classical Risk", "hash"))
        .when(algo.isin("AES", "AES-128"), of("Medium", "Quantum-Weakened", "symmetric-cipher"))
        .otherwise(of("Informational", "Safe", "other"))
    )
    http = F.when(F.col("scheme") == "http", of("High", "Classical Risk", "tls"))
    both = F.array_compact(F.array(profile, http))
    return events.select("event_id", algo.alias("algorithm"), F.explode(both).alias("p")).select("event_id", "algorithm", "p.*")


def tls_fan_out(probes: DataFrame) -> DataFrame:
    """Up to three events per probe: key exchange, cipher, signature; absent ones are left out."""
    part = lambda op, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(op).alias("operation"), F.col(c).alias("algorithm")))
    listed = F.array_compact(F.array(part("keygen", "key_exchange"), part("encrypt", "cipher"), part("sign", "signature")))
    return probes.select("probe_id", F.explode(listed).alias("e")).select("probe_id", "e.operation", "e.algorithm")
