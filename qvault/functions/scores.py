"""Scores of findings and assets, as Spark SQL expressions over named columns; ``F.expr`` makes them columns.

Each function takes column names (or SQL expressions) and returns the text of
an expression, so it serves DataFrames and ``spark.sql`` alike. Half is rounded up.
"""

from __future__ import annotations

# Fixed values of the score tables.
WEIGHTS = {"quantum": 0.40, "strength": 0.20, "deprecation": 0.15, "criticality": 0.10, "exposure": 0.15}
HORIZON_YEARS, MIGRATION_YEARS, DEFAULT_LIFETIME = 7, 3, 10
BUSINESS = {"critical": 1.25, "high": 1.25, "important": 1.10, "medium": 1.0, "standard": 1.0, "low": 0.8}
USAGE = {"key_exchange": 90, "digital_signature": 90, "password_hashing": 85, "data_encryption": 80, "mac": 60, "random_generation": 70, "integrity_hashing": 55, "cloud_kms_managed": 25, "hardware_key_custody": 20}
DEPRECATED = {"MD5": 100, "SHA1": 90, "SHA-1": 90, "DES": 100, "3DES": 80, "RC4": 100, "RC2": 90, "ECB": 70}
PURPOSE_LIFETIME = {"data_encryption": 20, "key_exchange": 10, "password_hashing": 15, "digital_signature": 5, "mac": 5, "random_generation": 5, "integrity_hashing": 3}
SENSITIVITY_LIFETIME = {"HEALTH": 20, "PII": 15, "FINANCIAL": 12, "AUTH": 5}
PURPOSE_WORDS = {
    "password_hashing": ["password", "passwd", "login"], "key_exchange": ["exchange", "handshake", "kem"], "digital_signature": ["sign", "verify", "jwt", "certificate"],
    "data_encryption": ["encrypt", "cipher", "decrypt"], "mac": ["hmac", "mac"], "random_generation": ["random", "nonce", "token"], "integrity_hashing": ["checksum", "digest", "hash"],
}
GUIDANCE = {
    ("RSA", "key_exchange"): "ML-KEM-768", ("RSA", "digital_signature"): "ML-DSA-65", ("RSA", "unknown"): "ML-KEM-768 or ML-DSA-65", ("ECC", "key_exchange"): "ML-KEM-768", ("ECC", "digital_signature"): "ML-DSA-65", ("ECC", "unknown"): "ML-DSA-65",
    ("DH", "unknown"): "ML-KEM-768", ("AES", "unknown"): "AES-256-GCM", ("HASH", "password_hashing"): "Argon2id", ("HASH", "unknown"): "SHA-384",
}
EFFORT_DAYS = {"ML-KEM-768": 8, "ML-DSA-65": 10, "ML-KEM-768 or ML-DSA-65": 12, "AES-256-GCM": 3, "Argon2id": 4, "SHA-384": 2}


def case(expr: str, table: dict, default) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else "NULL" if v is None else str(v)
    return f"CASE {expr} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"


def half_up(x: str) -> str:
    return f"floor(({x}) + 0.5)"


def primitive(algorithm: str) -> str:
    """The bare name that score tables know."""
    u = f"upper({algorithm})"
    return f"CASE WHEN {u} LIKE 'RSA%' THEN 'RSA' WHEN {u} LIKE 'ECDSA%' THEN 'ECDSA' WHEN {u} LIKE 'DH%' THEN 'DH' WHEN {u} LIKE 'AES%' THEN 'AES' WHEN {u} LIKE 'SHA-1' OR {u} = 'SHA1' THEN 'SHA-1' WHEN {u} LIKE 'SHA-256%' OR {u} = 'SHA256' THEN 'SHA-256' WHEN {u} LIKE 'DES%' THEN 'DES' ELSE {u} END"


def quantum_vulnerability(p: str, size: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 50 WHEN {p} IN ('RSA', 'ECC', 'ECDSA', 'ECDH', 'DSA', 'DH', 'EDDSA', 'DES', '3DES', 'RC4', 'MD5', 'SHA1', 'SHA-1') THEN 100 WHEN {p} = 'AES' THEN CASE WHEN coalesce({size}, 0) < 192 THEN 60 WHEN {size} < 256 THEN 40 ELSE 20 END WHEN {p} = 'CHACHA20' THEN 20 WHEN {p} IN ('SHA-256', 'SHA256', 'SHA-384', 'SHA-512', 'SHA3-256', 'SHA3-512') THEN 15 ELSE 50 END"


def key_strength(p: str, size: str) -> str:
    return f"CASE WHEN {p} IS NULL OR coalesce({size}, 0) = 0 THEN 50 WHEN {p} IN ('RSA', 'DSA', 'DH') THEN CASE WHEN {size} < 2048 THEN 90 WHEN {size} = 2048 THEN 20 WHEN {size} < 3072 THEN 55 WHEN {size} < 4096 THEN 35 ELSE 20 END WHEN {p} IN ('ECC', 'ECDSA', 'ECDH', 'EDDSA') THEN CASE WHEN {size} < 256 THEN 80 WHEN {size} < 384 THEN 45 ELSE 25 END WHEN {p} = 'AES' THEN CASE WHEN {size} < 128 THEN 100 WHEN {size} < 192 THEN 50 WHEN {size} < 256 THEN 30 ELSE 10 END WHEN {p} IN ('DES', '3DES', 'RC4', 'RC2') THEN 100 ELSE 30 END"


def classical_deprecation(p: str, mode: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN 50 ELSE greatest({case(p, DEPRECATED, 0)}, {case(f'upper({mode})', DEPRECATED, 0)}) END"


def usage_criticality(purpose: str) -> str:
    return case(purpose, USAGE, 50)


def exposure_window(lifetime: str) -> str:
    return f"greatest(0, coalesce({lifetime}, {DEFAULT_LIFETIME}) + {MIGRATION_YEARS} - {HORIZON_YEARS})"


def quantum_exposure(lifetime: str) -> str:
    w = exposure_window(lifetime)
    return f"CASE WHEN {w} <= 0 THEN 0 WHEN {w} >= 15 THEN 100 ELSE {half_up(f'{w} * 100.0 / 15')} END"


def vulnerability_score(p: str, size: str, mode: str, purpose: str, lifetime: str, exposure: str, importance: str, variant: str = "service") -> str:
    """0 to 100 with business context; ``simple`` leaves exposure windows out and weighs the other four 0.4, 0.3, 0.2 and 0.1."""
    q = quantum_vulnerability(p, size)
    if variant == "simple":
        raw = f"({q}) * 0.4 + ({key_strength(p, size)}) * 0.3 + ({classical_deprecation(p, mode)}) * 0.2 + ({usage_criticality(purpose)}) * 0.1"
    else:
        e = half_up(f"({quantum_exposure(lifetime)}) * ({q}) / 100.0")
        raw = f"({q}) * {WEIGHTS['quantum']} + ({key_strength(p, size)}) * {WEIGHTS['strength']} + ({classical_deprecation(p, mode)}) * {WEIGHTS['deprecation']} + ({usage_criticality(purpose)}) * {WEIGHTS['criticality']} + {e} * {WEIGHTS['exposure']}"
    exposed = f"CAST(({raw}) AS DOUBLE) * CASE WHEN {exposure} IN ('external-facing', 'external') THEN CAST(1.15 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END"
    before = half_up(f"least(100, greatest(0, {exposed}))")
    return f"CAST({half_up(f'least(100, greatest(0, {before} * CAST({case(f"lower({importance})", BUSINESS, 1.0)} AS DOUBLE)))')} AS INT)"


def severity_label(score: str) -> str:
    return f"CASE WHEN {score} >= 80 THEN 'critical' WHEN {score} >= 60 THEN 'high' WHEN {score} >= 40 THEN 'medium' WHEN {score} >= 20 THEN 'low' ELSE 'info' END"


def bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is written and computed once however often ``body`` uses it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def detect_purpose(declared: str, text: str) -> str:
    """A declared purpose that is known, else that whose words occur most, the first on a tie, else unknown."""
    known = ", ".join(f"'{k}'" for k in USAGE)
    hits = ", ".join(f"named_struct('n', {' + '.join(f'CAST(contains(purpose_text, {chr(39)}{w}{chr(39)}) AS INT)' for w in ws)}, 'o', {-i}, 'k', '{k}')" for i, (k, ws) in enumerate(PURPOSE_WORDS.items()))
    most = bound(f"array_max(array({hits}))", "most", "CASE WHEN most.n = 0 THEN 'unknown' ELSE most.k END")
    return f"CASE WHEN {declared} IN ({known}) THEN {declared} ELSE {bound(f'lower(coalesce({text}, {chr(39) * 2}))', 'purpose_text', most)} END"


def pqc_guidance(family: str, purpose: str) -> str:
    table = "map(" + ", ".join(f"'{f}|{p}', '{v}'" for (f, p), v in GUIDANCE.items()) + ")"
    return bound(family, "guided_family", f"coalesce({table}[guided_family || '|' || {purpose}], {table}[guided_family || '|unknown'], 'manual review')")


def migration_effort(recommended: str, files: str) -> str:
    """Days: a base by recommendation and half a day per file beyond the first."""
    return f"({case(recommended, EFFORT_DAYS, 5)}) + 0.5 * greatest(0, {files} - 1)"


def agility(hardcoded: str, files: str, library: str) -> str:
    return f"greatest(0, 100 - CASE WHEN {hardcoded} THEN 40 ELSE 0 END - least(40, 5 * greatest(0, {files} - 1)) - CASE WHEN {library} IS NULL THEN 20 ELSE 0 END)"


def mosca_risk(x: str, y: str, z: str = "10") -> str:
    return f"CASE WHEN {x} + {y} > {z} THEN 'HIGH' WHEN {x} + {y} > {z} - 5 THEN 'MEDIUM' ELSE 'LOW' END"


def migration_time(files: str, hardcoded: str) -> str:
    return f"1.0 + least(3.0, ({files} - 1) * 0.5) + CASE WHEN {hardcoded} THEN 1.5 ELSE 0.5 END"


def data_lifetime(stated: str, sensitivity: str, purpose: str) -> str:
    return f"coalesce({stated}, {case(sensitivity, SENSITIVITY_LIFETIME, None)}, {case(purpose, PURPOSE_LIFETIME, 10)})"


def hndl_risk(quantum: str, x: str, y: str, z: str = "10") -> str:
    """Harvest-now-decrypt-later risk, 0 to 100."""
    window = f"greatest(0, {x} + {y} - {z})"
    return f"CAST(CASE WHEN {quantum} >= 80 THEN CASE WHEN {x} + {y} > {z} THEN least(100, {half_up(f'80 + {window} * 20.0 / 15')}) ELSE 60 END WHEN {quantum} >= 40 THEN least(100, {half_up(f'{quantum} * (0.4 + {window} * 0.6 / 20)')}) ELSE {half_up(f'{quantum} * 0.5')} END AS INT)"


def asset_type(text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    rules = [("hardware", ["hsm", "tpm"]), ("cloud", ["kms", "vault"]), ("certificate", ["cert", "x509"]), ("protocol", ["tls", "ssh", "ipsec"]), ("key", ["key"]), ("library", ["openssl", "lib"])]
    return "CASE " + " ".join("WHEN " + " OR ".join(f"{t} LIKE '%{w}%'" for w in ws) + f" THEN '{k}'" for k, ws in rules) + " ELSE 'algorithm' END"


def suggest_lifetime(confirmed: str, text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    return f"coalesce({confirmed}, CASE WHEN {t} LIKE '%certificate%' THEN 2 WHEN {t} LIKE '%password%' THEN 15 WHEN {t} LIKE '%file%' THEN 20 WHEN {t} LIKE '%jwt%' OR {t} LIKE '%token%' THEN 1 ELSE 10 END)"


def criticality(sensitivity: str, exposure: str, role: str, regulated: str) -> str:
    """0 to 100: data 0.30, exposure 0.25, role 0.25, regulation 0.20."""
    return half_up(f"CAST(0.30 AS DOUBLE) * ({case(sensitivity, {'HEALTH': 100, 'PII': 80, 'FINANCIAL': 80, 'AUTH': 70}, 30)}) + CAST(0.25 AS DOUBLE) * CASE WHEN {exposure} = 'internal' THEN 30 ELSE 100 END + CAST(0.25 AS DOUBLE) * ({case(role, {'auth': 100, 'payments': 100, 'api': 70}, 40)}) + CAST(0.20 AS DOUBLE) * CASE WHEN {regulated} THEN 100 ELSE 20 END")


def urgency(x: str, y: str, z: str = "10") -> str:
    margin = f"({z} - ({x} + {y}))"
    return f"CASE WHEN {margin} < 0 THEN 'overdue' WHEN {margin} < 2 THEN 'urgent' WHEN {margin} < 5 THEN 'soon' ELSE 'planned' END"


def cipher_mode(text: str) -> str:
    u = f"upper(coalesce({text}, ''))"
    return "CASE " + " ".join(f"WHEN {u} LIKE '%{m}%' THEN '{m}'" for m in ("GCM", "CCM", "POLY1305", "CBC", "CTR", "CFB", "OFB", "ECB")) + " END"


def service_of_path(path: str, duckdb: bool = False) -> str:
    part = lambda i: f"string_split({path}, '/')[{i}]" if duckdb else f"get(split({path}, '/'), {i - 1})"
    return f"CASE WHEN {part(1)} IN ('src', 'lib', 'services', 'apps') AND {part(3)} IS NOT NULL THEN {part(2)} ELSE {part(1)} END"
