"""Queries of integrity and runtime evidence."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from qvault.operators import gate
from qvault.operators import integrity as op
from qvault.operators import runtime as rt
from qvault.operators import runtime_events as ev_rules
from qvault.plans.bindings import assets, findings, over, pick, plain, sql
from qvault.plans.q_inventory import GATE
from qvault.plans.registry import query
from qvault.storage import load

LEAF = "l AS (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY ordinal) - 1 AS idx, sha256('{\"algorithm\":\"' || algorithm || '\",\"file\":\"' || file || '\",\"line\":' || line || '}') AS h, count(*) OVER (PARTITION BY scan_id) AS n FROM findings)"
LEVEL = "{1} AS (SELECT scan_id, idx // 2 AS idx, CASE WHEN any_value(n) > 1 THEN sha256(min(h) || max(h)) ELSE min(h) END AS h, (any_value(n) + 1) // 2 AS n FROM {0} GROUP BY scan_id, idx // 2)"
LEVELS = ", ".join([LEAF, LEVEL.format("l", "l1"), LEVEL.format("l1", "l2"), LEVEL.format("l2", "l3"), LEVEL.format("l3", "l4")])


def leaves(spark, d):
    return op.merkle_leaves(findings(spark, d), "scan_id", ["ordinal"], "algorithm", "file", "line")


@query("a28_merkle_roots", over("findings", f"WITH {LEVELS} SELECT scan_id AS tree, h AS root FROM l4"))
def a28(spark, d):
    return op.merkle_roots(leaves(spark, d))


#: One tree over all findings, whatever their scan: as many levels as 2 million leaves have.
BATCH_LEVELS = "l0 AS (SELECT 0 AS scan_id, row_number() OVER (ORDER BY scan_id, ordinal) - 1 AS idx, sha256('{\"algorithm\":\"' || algorithm || '\",\"file\":\"' || file || '\",\"line\":' || line || '}') AS h, count(*) OVER () AS n FROM findings), " + ", ".join(LEVEL.format(f"l{i}", f"l{i + 1}") for i in range(21))


@query("a28_batch_tree", over("findings", f"WITH {BATCH_LEVELS} SELECT h AS root, (SELECT count(*) FROM findings) AS leaves FROM l21"))
def a28_batch(spark, d):
    all_of = op.merkle_leaves(findings(spark, d).withColumn("batch", F.lit(0)), "batch", ["scan_id", "ordinal"], "algorithm", "file", "line")
    return op.merkle_roots(all_of).select("root", F.lit(findings(spark, d).count()).alias("leaves"))


@query("a28_scan_batch", over("findings", f"WITH {LEVELS}, b0 AS (SELECT 0 AS scan_id, row_number() OVER (ORDER BY scan_id) - 1 AS idx, h, count(*) OVER () AS n FROM l4), {', '.join(LEVEL.format(f'b{i}', f'b{i + 1}') for i in range(21))} SELECT scan_id AS tree, idx, CASE WHEN idx % 5 = 0 THEN 'proof invalid' END AS reason, b21.h AS root FROM (SELECT l4.scan_id, row_number() OVER (ORDER BY l4.scan_id) - 1 AS idx FROM l4) l, (SELECT h FROM b21) b21"))
def a28_scans(spark, d):
    """All scans in one batch: their roots are the leaves, and every fifth claim was changed after the batch was anchored."""
    roots = op.merkle_roots(leaves(spark, d))
    numbered = op.batch_leaves(roots, F.lit(0))
    proofs = op.merkle_proofs(numbered).withColumnRenamed("tree", "batch")
    anchor = proofs.select("batch", "root").distinct()
    claims = proofs.withColumn("leaf", F.when(F.col("idx") % 5 == 0, F.reverse("leaf")).otherwise(F.col("leaf"))).drop("root")
    checked = op.verify_batch_proofs(claims, anchor)
    names = op.number_leaves(roots.withColumn("_b", F.lit(0)), "_b", ["tree"], F.col("tree").cast("string")).select("idx", F.col("hash").cast("long").alias("tree"))
    return checked.join(names, "idx").join(anchor, "batch").select("tree", "idx", "reason", "root")


#: Packages of scans: components as JSON in the findings' order, proofs and statements, some of each not right.
PACKED = """WITH c AS (SELECT scan_id, list('{"algorithm":"' || algorithm || '","line":' || line || '}' ORDER BY ordinal) AS cs FROM findings GROUP BY scan_id)
SELECT scan_id AS package_id, len(errors) = 0 AS valid, n_proofs, CASE WHEN scan_id % 13 = 0 THEN n_proofs WHEN scan_id % 11 = 0 AND n_proofs > 0 THEN 1 ELSE 0 END AS bad_proofs, array_to_string(errors, ',') AS errors FROM (
 SELECT scan_id, CAST(CASE WHEN scan_id % 17 = 0 THEN len(cs) - 1 ELSE len(cs) END AS BIGINT) AS n_proofs, list_filter([CASE WHEN scan_id % 7 = 0 THEN 'content hash' END, CASE WHEN scan_id % 13 = 0 THEN 'merkle root' END, CASE WHEN (scan_id % 11 = 0 OR scan_id % 13 = 0) AND NOT (scan_id % 17 = 0 AND len(cs) = 1) THEN 'component proof' END, CASE WHEN scan_id % 17 = 0 THEN 'proofs missing' END,
  CASE WHEN scan_id % 19 = 0 THEN 'no statement' END, CASE WHEN scan_id % 19 <> 0 AND scan_id % 23 = 0 THEN 'subject digest' END, CASE WHEN scan_id % 19 <> 0 AND scan_id % 29 = 0 THEN 'subject name' END, CASE WHEN scan_id % 19 <> 0 AND scan_id % 31 = 0 THEN 'predicate' END], lambda x: x IS NOT NULL) AS errors FROM c)"""


@query("j23_signed_packages", over("findings", PACKED))
def j23_signed(spark, d):
    rows = findings(spark, d).withColumn("json", op.canonical_json("algorithm", "line"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "json"))), lambda x: x["json"])  # a package bounds it
    packages = rows.groupBy("scan_id").agg(listed.alias("components")).withColumnRenamed("scan_id", "package_id")
    numbered = op.number_leaves(rows, "scan_id", ["ordinal"], F.sha2("json", 256))
    proofs = op.merkle_proofs(numbered).withColumnRenamed("tree", "package_id")
    roots = proofs.groupBy("package_id").agg(F.first("root").alias("root"))
    p, every = F.col("package_id"), lambda k: F.col("package_id") % k == 0
    content = F.sha2(F.concat(F.lit("["), F.array_join("components", ","), F.lit("]")), 256)
    stored = packages.join(roots, "package_id").select("package_id", "components", F.when(every(7), F.reverse(content)).otherwise(content).alias("content_hash"), F.when(every(13), F.reverse("root")).otherwise(F.col("root")).alias("merkle_root"))
    last = F.col("idx") == F.size("components") - 1
    kept = proofs.join(packages, "package_id").where(~(every(17) & last)).select("package_id", F.when(every(11) & (F.col("idx") == 0), "00").otherwise(F.col("leaf")).alias("leaf"), "proof")
    stated = stored.where(~every(19)).select("package_id", F.lit("statement/v1").alias("type"), F.when(every(31), "other").otherwise("inventory/v1").alias("predicate_type"), F.when(every(29), "").otherwise("cbom.json").alias("subject_name"), F.upper(F.when(every(23), "00").otherwise(F.col("content_hash"))).alias("subject_sha256"), F.lit(True).alias("has_summary"), F.lit(3).alias("n_fingerprints"))
    return op.verify_signed_packages(stored, kept, stated, "statement/v1", "inventory/v1")


@query("f22_merkle_proofs", over("findings", f"WITH {LEVELS} SELECT l.scan_id AS tree, CAST(l.idx AS BIGINT) AS idx, CAST(ceil(log2(l.n)) AS INTEGER) AS proof_length, true AS valid, l4.h AS root FROM l JOIN l4 USING (scan_id)"))
def f22(spark, d):
    p = op.merkle_proofs(leaves(spark, d))
    return p.select("tree", "idx", F.size("proof").alias("proof_length"), op.verify_proof(F.col("leaf"), F.col("proof"), F.col("root")).alias("valid"), "root")


@query("j19_verify_batch", over("findings", f"WITH {LEVELS} SELECT scan_id AS tree, CASE WHEN scan_id % 5 = 0 THEN 'not anchored' WHEN scan_id % 7 = 0 THEN 'root mismatch' END AS reason, NOT (scan_id % 5 = 0 OR scan_id % 7 = 0) AS valid FROM l4"))
def j19(spark, d):
    roots = op.merkle_roots(leaves(spark, d))
    anchors = roots.where("tree % 5 <> 0").withColumn("root", F.when(F.col("tree") % 7 == 0, "00").otherwise(F.col("root")))
    return op.verify_batch(roots, anchors).select("tree", "reason", "valid")


@query("j19_batch_proofs", over("findings", "WITH s AS (SELECT DISTINCT scan_id, scan_id // 64 AS batch FROM findings), r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY scan_id) - 1 AS idx FROM s) SELECT batch, idx, CASE WHEN batch % 5 = 0 THEN 'not anchored' WHEN idx % 7 = 0 THEN 'proof invalid' END AS reason, NOT (batch % 5 = 0 OR idx % 7 = 0) AS valid FROM r"))
def j19b(spark, d):
    """Scans committed in batches of neighbours; some batches are not anchored, some scans were changed since."""
    table = op.batch_leaves(op.merkle_roots(leaves(spark, d)), F.floor(F.col("tree") / 64))
    proofs = op.merkle_proofs(table).withColumnRenamed("tree", "batch")
    anchors = proofs.where("batch % 5 <> 0").select("batch", "root").distinct()
    changed = proofs.withColumn("leaf", F.when(F.col("idx") % 7 == 0, "00").otherwise(F.col("leaf")))
    return op.verify_batch_proofs(changed.drop("root"), anchors).select("batch", "idx", "reason", "valid")


@query("j23_verify_packages", over("findings", f"WITH {LEVELS} SELECT scan_id AS package_id, concat_ws(',', CASE WHEN scan_id % 4 = 0 THEN 'content hash' END, CASE WHEN scan_id % 6 = 0 THEN 'merkle root' END) AS errors, NOT (scan_id % 4 = 0 OR scan_id % 6 = 0) AS valid FROM l4"))
def j23(spark, d):
    roots = op.merkle_roots(leaves(spark, d))
    content = F.concat(F.lit("package "), F.col("tree").cast("string"))
    packages = roots.select(F.col("tree").alias("package_id"), content.alias("content"), F.when(F.col("tree") % 4 == 0, "x").otherwise(F.sha2(content, 256)).alias("content_sha256"), F.when(F.col("tree") % 6 == 0, "x").otherwise(F.col("root")).alias("root"))
    return op.verify_packages(packages, roots).select("package_id", "errors", "valid")


@query("a29_attestation_summary", over("assets", f"WITH {GATE} SELECT repo_id, count(DISTINCT fp) AS components, count(*) FILTER (WHERE vulnerable) AS vulnerable, count(*) FILTER (WHERE NOT vulnerable) AS compliant, sha256(array_to_string(list_sort(list_distinct(list(fp))), ',')) AS digest FROM g GROUP BY repo_id"))
def a29(spark, d):
    return op.attestation_summary(gate.gate_assets(assets(spark, d)), "repo_id")


@query("f3_canonical_json", over("findings", "SELECT scan_id, ordinal, sha256('{\"algorithm\":\"' || algorithm || '\",\"key_size\":' || coalesce(CAST(key_size AS VARCHAR), 'null') || ',\"line\":' || line || '}') AS digest FROM findings"))
def f3(spark, d):
    return findings(spark, d).select("scan_id", "ordinal", F.sha2(op.canonical_json("line", "key_size", "algorithm"), 256).alias("digest"))


EVENTS = f"""SELECT event_id, user_id AS run_id, ts, {pick('event_id', 'hash', 'encrypt', 'sign', 'click', 'keygen', 'tls', 'other')} AS operation,
 {pick('user_id + event_id', 'sha256', 'AES', 'rsa', 'MD5', 'ecdsa', 'SHA-1', None, 'hmac-sha256', 'AES-128-GCM')} AS algorithm, CAST(event_id % 4 AS BIGINT) AS count,
 {pick('event_id', 'openssl', 'hashlib', 'webcrypto')} AS library, 'app/' || {pick('user_id', 'login.py', 'tokens.js', 'cipher.py', 'main.tf')} AS file, CAST(user_id % 30 AS INTEGER) AS line,
 {pick('event_id', 'https', 'http', 'https', 'https')} AS scheme, 'host' || CAST(user_id % 5 AS STRING) AS host, event_type FROM {{events}}"""
CANON = "CASE WHEN algorithm IS NULL THEN 'UNKNOWN' ELSE CASE lower(trim(algorithm)) WHEN 'sha256' THEN 'SHA-256' WHEN 'aes' THEN 'AES' WHEN 'rsa' THEN 'RSA' WHEN 'md5' THEN 'MD5' WHEN 'ecdsa' THEN 'ECDSA' WHEN 'sha-1' THEN 'SHA-1' WHEN 'sha-256' THEN 'SHA-256' WHEN '3des' THEN '3DES' WHEN 'hmac-sha256' THEN 'HMAC-SHA256' ELSE CASE WHEN starts_with(lower(algorithm), 'aes') THEN 'AES' WHEN starts_with(lower(algorithm), 'rsa') THEN 'RSA' WHEN starts_with(lower(algorithm), 'ecdsa') THEN 'ECDSA' WHEN contains(lower(algorithm), 'sha256') OR contains(lower(algorithm), 'sha-256') THEN 'SHA-256' WHEN contains(lower(algorithm), 'hmac') THEN 'HMAC' ELSE upper(algorithm) END END END"
REJECT = "CASE WHEN run_id IS NULL THEN 'run_id missing' WHEN algorithm IS NULL THEN 'algorithm missing' WHEN operation NOT IN ('hash', 'encrypt', 'decrypt', 'sign', 'verify', 'keygen', 'kdf', 'hmac', 'tls', 'other') THEN 'operation unknown' WHEN count < 1 OR count > 1000000000 THEN 'count out of range' END"
IDENTITY = ["run_id", "operation", "algorithm", "library", "file", "line"]


def events(spark, d):
    return sql(spark, d, EVENTS)


def ev(text: str) -> str:
    return f"WITH events_ AS ({plain(EVENTS)})" + (", " + text[5:] if text.startswith("WITH ") else " " + text)


@query("s7_t1_validate_events", ev(f"SELECT event_id, {REJECT} AS reject_reason FROM events_"))
def s7(spark, d):
    return rt.validate_events(events(spark, d)).select("event_id", "reject_reason")


@query("f27_event_identity", ev("SELECT event_id, sha256('[\"' || run_id || '\",\"' || operation || '\",\"' || coalesce(algorithm, '') || '\"]') AS identity FROM events_"))
def f27(spark, d):
    return events(spark, d).select("event_id", rt.event_identity("run_id", "operation", "algorithm").alias("identity"))


@query("t2_aggregate_events", ev(f"SELECT {', '.join(IDENTITY)}, CAST(sum(count) AS BIGINT) AS count, arg_min(host, (ts, event_id)) AS host, min(ts) AS first_seen, max(ts) AS last_seen FROM events_ GROUP BY {', '.join(IDENTITY)}"))
def t2(spark, d):
    return rt.aggregate_events(events(spark, d), IDENTITY)


SESSIONS = "SELECT DISTINCT user_id AS run_id, CASE WHEN user_id % 3 = 0 THEN 'recording' ELSE 'stopped' END AS status, CASE WHEN user_id % 3 = 1 THEN TIMESTAMP '2024-01-15 00:00:00' END AS stopped_at FROM {events} WHERE user_id % 11 <> 0"


@query("t3_session_gate", ev(f"WITH s AS ({plain(SESSIONS)}) SELECT event_id, coalesce(status = 'recording' OR ts <= stopped_at, false) AS accepted FROM events_ LEFT JOIN s USING (run_id)"))
def t3(spark, d):
    return rt.session_gate(events(spark, d), sql(spark, d, SESSIONS)).select("event_id", "accepted")


@query("t4_session_progress", ev("SELECT run_id, CAST(sum(count) AS BIGINT) AS total, max(ts) AS last_event, count(DISTINCT (operation, library)) AS distinct_events, count(DISTINCT (operation, library)) > 12 AS over_limit FROM events_ GROUP BY run_id"))
def t4(spark, d):
    return rt.session_progress(events(spark, d), ["operation", "library"], 12)


MATCH_FINDINGS = "f AS (SELECT scan_id * 100 + ordinal AS finding_id, scan_id * 100 + ordinal AS ordinal, scan_id % 50 AS repo_id, string_split(file, '/')[-1] AS base, algorithm, line FROM findings)"
MATCH = f"""WITH f0 AS (SELECT min(finding_id) AS finding_id, min(ordinal) AS ordinal, repo_id, base, algorithm, line FROM f GROUP BY repo_id, base, algorithm, line), fc AS (SELECT finding_id, ordinal, repo_id, base, line AS fl, {CANON} AS ca FROM f0), ec AS (SELECT *, run_id % 50 AS repo_id, string_split(file, '/')[-1] AS base, {CANON} AS ca FROM events_),
j AS (SELECT event_id, finding_id, ordinal, CASE WHEN line > 0 AND fl > 0 THEN abs(line - fl) ELSE 9999 END AS dist FROM ec LEFT JOIN fc USING (repo_id, base, ca)),
k AS (SELECT *, CASE WHEN finding_id IS NULL THEN 3 WHEN dist = 0 THEN 0 WHEN dist <= 15 THEN 1 ELSE 2 END AS kind FROM j),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY kind, CASE WHEN kind = 1 THEN dist ELSE 0 END, ordinal) AS n FROM k) WHERE n = 1),
m AS (SELECT event_id, finding_id AS matched_finding_id, CASE kind WHEN 0 THEN 'exact_line' WHEN 1 THEN 'same_function' WHEN 2 THEN 'same_file_algorithm' ELSE 'unmatched' END AS match_reason, CASE kind WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS match_confidence FROM b)
"""


def scoped_findings(spark, d):
    """Findings of 50 repositories, which have the same paths."""
    f = findings(spark, d).withColumn("finding_id", F.col("scan_id") * 100 + F.col("ordinal"))
    return f.withColumn("ordinal", F.col("finding_id")).withColumn("repo_id", F.col("scan_id") % 50)


def scoped_events(spark, d):
    return events(spark, d).withColumn("repo_id", F.col("run_id") % 50)


def matched(spark, d):
    return rt.match_events(scoped_events(spark, d), scoped_findings(spark, d), keys=["repo_id"])


def with_match(select: str) -> str:
    return over("findings", f"WITH events_ AS ({plain(EVENTS)}), {MATCH_FINDINGS}, " + MATCH[5:] + select)


@query("j8_match_events", with_match("SELECT * FROM m"))
def j8(spark, d):
    return matched(spark, d)


@query("t7_stream_matches", with_match("SELECT * FROM m"))
def t7(spark, d):
    """Events written as JSON lines, read as a stream, and matched batch by batch."""
    from qvault.storage import new_path
    from qvault.streaming.events import match_stream, read_event_stream

    source, sink, state = (new_path(spark, f"stream-{x}") for x in ("events", "matches", "state"))
    e = scoped_events(spark, d).select("event_id", "repo_id", "file", "line", "algorithm")
    e.write.json(source)
    match_stream(read_event_stream(spark, source, e.schema), scoped_findings(spark, d), sink, state, keys=["repo_id"]).awaitTermination()
    return spark.read.parquet(sink).drop("epoch")


@query("a21_evidence_report", with_match("SELECT run_id, algorithm, operation, library, file, line, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(matched_finding_id, (ts, event_id)) FILTER (WHERE matched_finding_id IS NOT NULL) AS matched_finding_id, upper(algorithm) IN ('RSA', 'ECDSA', 'ECDH', 'DH', 'DSA', 'ED25519', 'ED448') AS is_quantum_vulnerable FROM events_ JOIN m USING (event_id) GROUP BY run_id, algorithm, operation, library, file, line"))
def a21(spark, d):
    return rt.evidence_report(events(spark, d).join(matched(spark, d), "event_id"))


@query("f26_classify_runtime", ev(f"""WITH c AS (SELECT event_id, scheme, {CANON} AS algorithm FROM events_)
SELECT event_id, algorithm, CASE WHEN algorithm IN ('RSA', 'ECDSA', 'MD5') THEN 'Critical' WHEN algorithm = 'SHA-1' THEN 'High' WHEN algorithm = 'AES' THEN 'Medium' ELSE 'Informational' END AS severity, CASE WHEN algorithm IN ('RSA', 'ECDSA') THEN 'Quantum-Broken' WHEN algorithm IN ('MD5', 'SHA-1') THEN 'Classical Risk' WHEN algorithm = 'AES' THEN 'Quantum-Weakened' ELSE 'Safe' END AS quantum_risk, CASE WHEN algorithm IN ('RSA', 'ECDSA') THEN 'asymmetric' WHEN algorithm = 'MD5' THEN 'weak' WHEN algorithm = 'SHA-1' THEN 'hash' WHEN algorithm = 'AES' THEN 'symmetric-cipher' ELSE 'other' END AS category FROM c
UNION ALL SELECT event_id, algorithm, 'High', 'Classical Risk', 'tls' FROM c WHERE scheme = 'http'"""))
def f26(spark, d):
    return rt.classify_runtime(events(spark, d))


@query("t5_runtime_findings", ev(f"SELECT DISTINCT run_id, {CANON} AS algorithm, substr(sha256(run_id || ':' || {CANON}), 1, 32) AS finding_id FROM events_ WHERE {REJECT} IS NULL"))
def t5(spark, d):
    ok = rt.validate_events(events(spark, d)).where("reject_reason is null")
    named = ok.select("run_id", rt.canonical_algorithm(F.col("algorithm")).alias("algorithm")).distinct()
    return named.withColumn("finding_id", F.substring(F.sha2(F.concat_ws(":", F.col("run_id").cast("string"), "algorithm"), 256), 1, 32))


#: Raw events as (JSON, why it is rejected, its findings as algorithm, severity, risk and category), made by hand.
INFO, WARN, BROKEN = ("Informational", "Safe"), ("High", "Classical Risk"), ("Critical", "Quantum-Broken")


def _event(source, algorithm, operation, key=None, reason=None, found=(), **more):
    return json.dumps({"source": source, "algorithm": algorithm, "operation": operation, "callerScript": "https://App.example:443/js/a.js?v=1:12:5"} | ({"keyInfo": key} if key is not None else {}) | more), reason, list(found)


RAW_EVENTS = [
    _event("crypto", "eth_signTypedData_v4", "wallet", found=[("ECDSA secp256k1", *BROKEN, "algorithm")]),
    _event("crypto", "Math.random", "random", found=[("Non-CSPRNG", *INFO, "algorithm")]),
    _event("crypto", "crypto.getRandomValues", "random", found=[("CSPRNG", *INFO, "algorithm")]),
    _event("crypto", "jwt HS512", "sign", found=[("HMAC-SHA512 (JWT)", *INFO, "algorithm")]),
    _event("crypto", "JWT PS256", "sign"),
    _event("crypto", "ES256", "sign", found=[("ECDSA-P256-SHA256 (JWT)", *BROKEN, "algorithm")]),
    _event("crypto", "AES-CBC", "encrypt", {"keySize": 256}, found=[("AES-256-CBC", "Low", "Quantum-Weakened", "algorithm")]),
    _event("crypto", "AES-256-GCM", "encrypt", found=[("AES-GCM", *INFO, "algorithm")]),
    _event("crypto", "aes", "encrypt", {"mode": "ecb", "keySize": "128"}, found=[("AES-128-ECB", "Critical", "Classical Risk", "algorithm")]),
    _event("crypto", "AES_KW", "wrapKey", {"keySize": 192}, found=[("AES-192-", "Medium", "Quantum-Weakened", "algorithm")]),
    _event("crypto", "AES-GCM", "encrypt", {"keySize": 128}, found=[("AES-128-GCM", "Medium", "Quantum-Weakened", "algorithm")]),
    _event("crypto", "RSASSA-PKCS1-v1_5", "sign", {"modulusLength": 4096, "hash": "SHA-256"}, found=[("RSA-4096", *BROKEN, "algorithm")]),
    _event("crypto", "ECDH", "deriveBits", {"curve": "P-256"}, found=[("ECDH (P-256)", *BROKEN, "algorithm")]),
    _event("crypto", "ECDSA", "sign", {"curve": "P-384"}, found=[("ECDSA (P-384)", *BROKEN, "algorithm")]),
    _event("crypto", "Ed25519", "verify", found=[("ECDSA (ed25519)", *BROKEN, "algorithm")]),
    _event("crypto", "wallet signing", "wallet", found=[("ECDSA (secp256k1)", *BROKEN, "algorithm")]),
    _event("crypto", "SHA-1", "digest", found=[("SHA-1", *WARN, "hash")]),
    _event("crypto", "keccak256", "digest", found=[("SHA-3", *INFO, "algorithm")]),
    _event("crypto", "PBKDF2", "deriveKey", found=[("PBKDF2", *INFO, "algorithm")]),
    _event("crypto", "HMAC", "sign", {"hash": "SHA-384"}, found=[("SHA-384", *INFO, "algorithm")]),
    _event("crypto", "hmac-sha1", "sign", found=[("SHA-1", *WARN, "hash")]),
    _event("crypto", "hmac md5", "sign", found=[("MD5", "Critical", "Classical Risk", "hash")]),
    _event("crypto", "HMAC", "sign"),
    _event("crypto", "des-ede3", "encrypt", found=[("3DES/DES", "Critical", "Classical Risk", "symmetric-cipher")]),
    _event("crypto", "rc4", "encrypt", found=[("RC4", "Critical", "Classical Risk", "symmetric-cipher")]),
    _event("crypto", "ChaCha20", "encrypt"),
    _event("network", "NETWORK", "network", scheme="http", hostOrigin="http://CDN.other:80/x?y", crossOrigin=True, port=80, found=[("Unencrypted transport", *WARN, "protocol"), ("Cross-origin host", *INFO, "network")]),
    _event("network", "NETWORK", "network", scheme="wss", hostOrigin="wss://app.example", found=[]),
    _event("network", "NETWORK", "network", scheme="https", hostOrigin="https://third.example:8443", found=[("Cross-origin host", *INFO, "network")]),
    _event("library", "forge", "library", found=[("forge", *INFO, "library")]),
    _event("wasm", "WASM", "wasm", found=[("WebAssembly module", *INFO, "library")]),
    _event("tls", "TLSv1.1", "handshake", {"cipherSuite": "AES128-SHA"}, found=[("TLSv1.1", *WARN, "protocol")]),
    _event("tls", "TLS", "load", {"version": "TLSv1.3"}, found=[("TLSv1.3", *INFO, "protocol")]),
    _event("tls", "TLSv1", "protocol", {"version": "TLSv1.3"}, found=[("TLSv1", *WARN, "protocol")]),
    _event("tls", "RSA", "certificate", {"keySize": 2048}, found=[("RSA-2048", *BROKEN, "certificate")]),
    _event("tls", "unheard", "certificate"),
    _event("tls", "ecdsa_with_SHA-256", "signature", {"keySize": 256}, found=[("SHA-256", *INFO, "algorithm")]),
    _event("tls", "rsaEncryption", "signature", {"keySize": 4096}, found=[("RSA", *BROKEN, "algorithm")]),
    _event("tls", "ECDHE_RSA", "key_exchange", found=[("ECDHE", *BROKEN, "protocol")]),
    _event("tls", "DHE", "key_exchange"),
    _event("crypto", "RSA", "sign", callerScript="C:\\x.py:3", reason="callerScript malformed"),
    _event("crypto", "SHA-256", "digest", callerScript="app\\main.py:7", found=[("SHA-256", *INFO, "algorithm")]),
    _event("crypto", "SHA-256", "digest", callerScript="inline:x:9", count=1_000_000, timestamp="2024-05-01T10:00:00.5Z", found=[("SHA-256", *INFO, "algorithm")]),
    _event("crypto", "SHA-256", "digest", callerScript="../x.py:7", reason="callerScript malformed"),
    _event("crypto", "SHA-256", "digest", callerScript="https://u:p@h/x:7", reason="callerScript malformed"),
    _event("crypto", "SHA-256", "digest", callerScript="https://h/x", reason="callerScript malformed"),
    _event("crypto", "SHA-256", "digest", secret="x", reason="field unknown"),
    _event("disk", "SHA-256", "digest", reason="source unknown"),
    _event("crypto", "SHA-256", "hash", reason="operation unknown"),
    _event("crypto", "a;b", "digest", reason="algorithm malformed"),
    _event("library", "left-pad", "library", reason="library unknown"),
    _event("network", "TCP", "network", reason="algorithm malformed"),
    _event("wasm", "asm", "wasm", reason="algorithm malformed"),
    _event("crypto", "RSA", "sign", [1], reason="keyInfo malformed"),
    _event("crypto", "RSA", "sign", {"key": "x"}, reason="keyInfo field unknown"),
    _event("crypto", "RSA", "sign", {"keySize": 0}, reason="keyInfo malformed"),
    _event("crypto", "RSA", "sign", {"bits": 1.5}, reason="keyInfo malformed"),
    _event("crypto", "RSA", "sign", {"curve": "a\"b"}, reason="keyInfo malformed"),
    _event("crypto", "RSA", "sign", scheme="ftp", reason="scheme unknown"),
    _event("crypto", "RSA", "sign", hostOrigin="nowhere", reason="hostOrigin malformed"),
    _event("crypto", "RSA", "sign", port=65536, reason="port out of range"),
    _event("network", "NETWORK", "network", scheme="http", reason="network without host"),
    _event("crypto", "RSA", "sign", crossOrigin="yes", reason="crossOrigin malformed"),
    _event("crypto", "RSA", "sign", count=0, reason="count out of range"),
    _event("crypto", "RSA", "sign", timestamp="yesterday", reason="timestamp malformed"),
    ("[1, 2]", "not an object", []), ("{broken", "not an object", []),
]
CASE = f"event_id % {len(RAW_EVENTS)}"
_text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
REASONS = f"(VALUES {', '.join(f'({i}, {_text(r)})' for i, (_, r, _) in enumerate(RAW_EVENTS))}) r(k, reject_reason)"
FOUND = "(VALUES " + ", ".join(f"({i}, {p}, {', '.join(map(_text, f))})" for i, (_, _, fs) in enumerate(RAW_EVENTS) for p, f in enumerate(fs)) + ") f(k, position, algorithm, severity, quantum_risk, category)"


def raw_events(spark, d):
    """The table's events, each with one of the raw events as its JSON."""
    cases = F.broadcast(spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(RAW_EVENTS)], "k long, value string"))  # a fixed number of rows
    e = load(spark, d, "events").select("event_id", F.col("user_id").alias("run_id"), (F.col("event_id") % len(RAW_EVENTS)).alias("k"))
    return e.join(cases, "k").drop("k").withColumn("target_origin", F.lit("https://app.example"))


@query("t1_normalise_events", f"SELECT event_id, reject_reason FROM events JOIN {REASONS} ON k = {CASE}")
def t1(spark, d):
    return ev_rules.normalise_events(raw_events(spark, d)).select("event_id", "reject_reason")


@query("f26_classify_events", f"SELECT event_id, CAST(position AS INTEGER) AS position, algorithm, severity, quantum_risk, category FROM events JOIN {FOUND} ON k = {CASE}")
def f26_rules(spark, d):
    return ev_rules.classify_events(ev_rules.normalise_events(raw_events(spark, d)).where("reject_reason is null"))


#: The identity in SQL for events of one form: a key with all its fields, out of order.
IDENTIFIED = "SELECT event_id, user_id, event_id % 50 AS size, event_id % 3 = 0 AS far FROM events"


@query("f27_identity_of_ten", f"""SELECT event_id, sha256('["' || user_id || '","crypto","RSA","sign","{{\\"curve\\":\\"P-' || size || '\\",\\"hash\\":\\"a/b\\",\\"keySize\\":' || (size + 1) || '}}","https://h.example/a.js:' || size || '","' || CASE WHEN far THEN 'https://far.example' ELSE '' END || '","' || CASE WHEN far THEN 'https' ELSE '' END || '",' || CASE WHEN far THEN 443 ELSE 0 END || ',' || CASE WHEN far THEN 'true' ELSE 'false' END || ']') AS identity FROM ({IDENTIFIED})""")
def f27_ten(spark, d):
    size, far = F.col("event_id") % 50, F.col("event_id") % 3 == 0
    key = F.struct((size + 1).alias("keySize"), F.lit("a/b").alias("hash"), F.concat(F.lit("P-"), size.cast("string")).alias("curve"))
    fields = [F.lit("crypto").alias("source"), F.lit("RSA").alias("algorithm"), F.lit("sign").alias("operation"), key.alias("keyInfo"), F.format_string("https://H.example:443/a.js?q:%d:9", size).alias("callerScript")]
    more = [F.when(far, "https://FAR.example:443/p").alias("hostOrigin"), F.when(far, "https").alias("scheme"), F.when(far, 443).alias("port"), F.when(far, True).alias("crossOrigin")]
    raw = load(spark, d, "events").select("event_id", F.col("user_id").alias("run_id"), F.to_json(F.struct(*fields, *more)).alias("value"))
    return ev_rules.normalise_events(raw).select("event_id", ev_rules.event_identity().alias("identity"))


@query("t5_session_findings", f"""WITH f AS (SELECT DISTINCT user_id AS run_id, k, position, algorithm, severity, quantum_risk, category FROM events JOIN {FOUND} ON k = {CASE}), c AS (SELECT user_id AS run_id, {CASE} AS k, count(*) AS n, count(DISTINCT user_id) FROM events GROUP BY ALL)
SELECT run_id, position, algorithm, severity, quantum_risk, category, CAST(sum(n * CASE WHEN k = {next(i for i, (v, _, _) in enumerate(RAW_EVENTS) if '"count": 1000000' in v)} THEN 1000000 ELSE 1 END) AS BIGINT) AS count, count(*) AS findings FROM f JOIN c USING (run_id, k) GROUP BY ALL""")
def t5_findings(spark, d):
    """All findings of all runs, as when each stops; how many there are of each kind, and how often their calls were seen."""
    ok = ev_rules.normalise_events(raw_events(spark, d)).where("reject_reason is null").withColumn("event_id", ev_rules.event_identity())
    found = ev_rules.session_findings(ok.select("event_id", "run_id", "source", "algorithm", "operation", "key_info", "caller", "scheme", "host_origin", "target_origin", "count", "seen"))
    once = found.dropDuplicates(["finding_id"])
    return once.groupBy("run_id", "position", "algorithm", "severity", "quantum_risk", "category").agg(F.sum("count").alias("count"), F.count("*").alias("findings"))


#: An hour of a user as requests: a start, events in batches of equal types, a stop for some, and more after it.
SESSION_SQL = """WITH RECURSIVE e AS (SELECT user_id AS run_id, event_id, event_type || ':' || (event_id % 7) AS call, event_id % 5 + 1 AS n, event_id // 16 AS slot FROM events),
q AS (SELECT run_id, min(event_id) * 10 + 1 AS request_id, 'events' AS kind, list(call ORDER BY event_id) AS calls, CAST(sum(n) AS BIGINT) AS inc FROM e GROUP BY run_id, slot
 UNION ALL SELECT run_id, min(event_id) * 10, 'start', [], 0 FROM e GROUP BY run_id UNION ALL SELECT run_id, max(event_id) * 10 - 5, 'stop', [], 0 FROM e WHERE run_id % 3 = 0 GROUP BY run_id),
o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY request_id) AS i FROM q),
s AS (SELECT run_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS request_id, 'ready' AS status, CAST(NULL AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS total, CAST([] AS VARCHAR[]) AS seen, '' AS kind FROM (SELECT DISTINCT run_id FROM e)
 UNION ALL SELECT run_id, i, request_id, CASE WHEN reason IS NULL AND kind = 'start' THEN 'recording' WHEN kind = 'stop' THEN 'stopped' ELSE status END, reason, CASE WHEN reason IS NULL THEN total + inc ELSE total END, CASE WHEN reason IS NULL THEN list_distinct(list_concat(seen, calls)) ELSE seen END, kind
 FROM (SELECT o.*, s.status, s.total, s.seen, CASE WHEN o.kind = 'start' THEN CASE WHEN s.status <> 'ready' THEN 'not ready' END WHEN o.kind = 'stop' THEN NULL WHEN len(o.calls) > 3 THEN 'batch too large' WHEN s.status <> 'recording' THEN 'not recording' WHEN s.total + o.inc > 120 THEN 'event limit' WHEN len(s.seen) + len(list_distinct(o.calls)) > 18 THEN 'aggregate limit' END AS reason FROM s JOIN o ON o.run_id = s.run_id AND o.i = s.i + 1))
SELECT run_id, request_id, kind, reason IS NULL AS accepted, reason, total, CAST(len(seen) AS BIGINT) AS distinct_events FROM s WHERE i > 0"""


def session_requests(spark, d):
    e = load(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts", F.concat("event_type", F.lit(":"), (F.col("event_id") % 7).cast("string")).alias("call"), (F.col("event_id") % 5 + 1).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("event_id", "call", "n")))  # a slot of 16 events bounds it
    batches = e.groupBy("run_id", F.floor(F.col("event_id") / 16).alias("slot")).agg(F.max("ts").alias("ts"), (F.min("event_id") * 10 + 1).alias("request_id"), listed.alias("c"))
    batches = batches.select("run_id", "request_id", F.lit("events").alias("kind"), "ts", F.col("c.call").alias("calls"), F.col("c.n").alias("counts"))
    none = [F.array().cast("array<string>").alias("calls"), F.array().cast("array<long>").alias("counts")]
    edge = lambda rows, at, kind: rows.groupBy("run_id").agg(at.alias("request_id"), F.min("ts").alias("ts")).select("run_id", "request_id", F.lit(kind).alias("kind"), "ts", *none)
    return batches.unionByName(edge(e, F.min("event_id") * 10, "start")).unionByName(edge(e.where("run_id % 3 = 0"), F.max("event_id") * 10 - 5, "stop"))


@query("t4_session_state", SESSION_SQL)
def t4_state(spark, d):
    """Requests written as JSON lines, in files by their order, and decided on as a stream whose state spans its triggers."""
    from qvault.storage import new_path
    from qvault.streaming import sessions as se

    source, out, state = (new_path(spark, f"sessions-{x}") for x in ("requests", "out", "state"))
    session = spark.newSession()  # the state store is a setting of the stream's own session
    se.use_state_store(session)
    cut = load(spark, d, "events").agg((F.min("event_id") + F.max("event_id")) * 5).first()[0] or 0  # half of the requests, about
    for part in ("request_id <= {}", "request_id > {}"):  # the stream starts again over what it has left
        session_requests(spark, d).where(part.format(cut)).write.mode("append").json(source)
        stream = session.readStream.schema(se.REQUEST).json(source)
        se.record_sessions(stream, out, state, max_batch=3, max_distinct=18, max_total=120).awaitTermination()
    columns = ["run_id", "request_id", "kind", "accepted", "reason", "total", "distinct_events"]
    return se.session_table(spark, out, "accepted").select(columns).unionByName(se.session_table(spark, out, "rejected").select(columns))


@query("t6_tls_fan_out", "SELECT s_suppkey AS probe_id, unnest(['keygen', 'encrypt', 'sign']) AS operation, unnest(['ECDHE', 'AES-256-GCM', 'RSA-PSS']) AS algorithm FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'encrypt', 'AES-256-GCM' FROM supplier WHERE s_suppkey % 2 = 1")
def t6(spark, d):
    even = F.col("s_suppkey") % 2 == 0
    probes = load(spark, d, "supplier").select(F.col("s_suppkey").alias("probe_id"), F.when(even, "ECDHE").alias("key_exchange"), F.lit("AES-256-GCM").alias("cipher"), F.when(even, "RSA-PSS").alias("signature"))
    return rt.tls_fan_out(probes)


@query("w9_top_k", ev("SELECT run_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY count DESC, event_id) AS n FROM events_) WHERE n <= 3"))
def w9(spark, d):
    from qvault.operators.findings import top_per_group

    return top_per_group(events(spark, d), ["run_id"], [F.desc("count"), F.col("event_id")], 3).select("run_id", "event_id")


@query("w11_first_anchor", ev("SELECT event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) = 1 AS accepted FROM events_"))
def w11(spark, d):
    return op.first_anchor(events(spark, d), "run_id", ["ts", "event_id"]).select("event_id", "accepted")


@query("w10_audit_chain", """WITH h AS (SELECT event_id, user_id, sha256(event_id || ':' || event_type) AS good FROM events), c AS (SELECT event_id, good, CASE WHEN event_id % 53 = 0 THEN 'bad' || event_id ELSE good END AS entry_hash, lag(good) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM h)
, p AS (SELECT event_id, good, entry_hash, CASE WHEN event_id % 97 = 0 AND prev IS NOT NULL THEN 'lost' || event_id ELSE prev END AS previous_hash FROM c)
SELECT event_id, CASE WHEN good <> entry_hash THEN 'tampered' WHEN previous_hash IS NOT NULL AND previous_hash NOT IN (SELECT entry_hash FROM p) THEN 'orphan' END AS problem FROM p""")
def w10(spark, d):
    from pyspark.sql import Window

    e = load(spark, d, "events").select("event_id", "user_id", "event_type")
    good = F.sha2(F.concat_ws(":", F.col("event_id").cast("string"), "event_type"), 256)
    log = e.withColumn("good", good).withColumn("prev", F.lag("good").over(Window.partitionBy("user_id").orderBy("event_id")))
    log = log.select("event_id", "event_type", F.expr("CASE WHEN event_id % 53 = 0 THEN concat('bad', event_id) ELSE good END").alias("entry_hash"), F.expr("CASE WHEN event_id % 97 = 0 AND prev IS NOT NULL THEN concat('lost', event_id) ELSE prev END").alias("previous_hash"))
    return op.verify_audit_chain(log, good).select("event_id", "problem")


@query("j16_manifest_drift", "WITH a AS (SELECT doc_id AS path, sha256(text) AS s FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN sha256(text || 'x') WHEN doc_id % 7 = 0 THEN NULL ELSE sha256(text) END AS s FROM documents WHERE doc_id % 4 <> 0) SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'ADDED' WHEN b.path IS NULL THEN 'DELETED' WHEN a.s <> b.s THEN 'MODIFIED' ELSE 'UNCHANGED' END AS status FROM a FULL OUTER JOIN b ON a.path = b.path")
def j16(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    a = docs.where("path % 5 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    b = docs.where("path % 4 <> 0").select("path", F.when(F.col("path") % 3 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).when(F.col("path") % 7 != 0, F.sha2("text", 256)).alias("sha256"))
    return op.manifest_drift(a, b)
