"""Events of running programs: raw JSON is checked field by field, normalised and identified, and observed calls are classified by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qvault.functions import profiles as fp

# The fields that an event and its key may have, what they may hold, and how often an event may have been seen.
EVENT_FIELDS = ["source", "algorithm", "operation", "keyInfo", "callerScript", "hostOrigin", "scheme", "port", "crossOrigin", "count", "timestamp"]
KEY_NUMBERS, KEY_TEXTS = ["keySize", "modulusLength", "bits"], ["curve", "mode", "hash", "format", "version", "cipherSuite", "expiresAt"]
SOURCES = ["crypto", "network", "library", "wasm", "tls"]
OPERATIONS = ["digest", "generateKey", "importKey", "exportKey", "encrypt", "decrypt", "sign", "verify", "deriveKey", "deriveBits", "wrapKey", "unwrapKey", "random", "network", "wallet", "load", "library", "wasm", "handshake", "protocol", "certificate", "signature", "key_exchange"]
LIBRARIES = ["CryptoJS", "forge", "sjcl", "jsrsasign", "elliptic", "tweetnacl", "ethers", "web3"]
SCHEMES = ["", "http", "https", "ws", "wss"]
MAX_COUNT, MAX_PLACE = 1_000_000, 700
NAME, KEY_TEXT = r"^[A-Za-z0-9_.:+() /-]+$", r"^[A-Za-z0-9._:+() /_-]+$"
#: A URL without a user: scheme, host, port and path.
URL = r"^(?i)(https?|wss?)://([^/@?#:\s]+)(?::(\d+))?(/[^?#]*)?(?:[?#].*)?$"
PORTS = {"http": "80", "ws": "80", "https": "443", "wss": "443"}


def origin(url: Column) -> Column:
    """The scheme, host and port of a URL, without the scheme's own port; null if it is none, or names a user."""
    part = lambda i: F.regexp_extract(url, URL, i)
    scheme, port = F.lower(part(1)), part(3)
    own = F.create_map(*[F.lit(x) for pair in PORTS.items() for x in pair])[scheme]
    return F.when(url.rlike(URL), F.concat(scheme, F.lit("://"), F.lower(part(2)), F.when((port == "") | (port == own), "").otherwise(F.concat(F.lit(":"), port))))


def caller_place(caller: Column) -> Column:
    """Where a call came from, as a place with its line: a URL without its query, a Python file, or unknown; null if it is malformed."""
    line = F.regexp_extract(caller, r":(\d+)(?::\d+)?$", 1)
    source = F.regexp_replace(F.regexp_replace(caller, r":(\d+)(?::\d+)?$", ""), r"[?#].*$", "")
    path = F.regexp_extract(source, URL, 4)
    relative = F.replace(source, F.lit("\\"), F.lit("/"))
    at = lambda c: F.substring(F.concat(c, F.lit(":"), line), 1, MAX_PLACE)
    python = relative.rlike(r"(?i)^[A-Za-z0-9._~/-]+\.py$") & ~F.array_contains(F.split(relative, "/"), "..")
    place = (
        F.when((source == "unknown") | source.startswith("inline:"), F.concat(F.lit("unknown:"), line.cast("long").cast("string")))
        .when(source.rlike(URL) & F.lower(source).startswith("http"), at(F.concat(origin(source), F.when(path == "", "/").otherwise(path))))
        .when(python, at(F.concat(F.lit("python://"), relative)))
    )
    return F.when((F.length(caller) <= 1000) & (line != "") & (F.length(line) <= 15), place)


_KEY = ", ".join(f"{n} string" for n in sorted(KEY_NUMBERS + KEY_TEXTS))
_EVENT = f"source string, algorithm string, operation string, keyInfo struct<{_KEY.replace(' string', ':string')}>, callerScript string, hostOrigin string, scheme string, port string, crossOrigin string, count string, timestamp string"


def normalise_events(raw: DataFrame) -> DataFrame:
    """``raw`` (run_id, value and others; value is JSON) with the fields of its event, normalised, and ``reject_reason``, the first that holds, null where it is accepted.

    A field that no list has rejects the event, as do values outside their
    lists, patterns and ranges. Nothing is dropped.
    """
    e, keys = F.col("_e"), F.json_object_keys("value")
    parsed = raw.withColumn("_e", F.from_json("value", _EVENT, {"mode": "PERMISSIVE"}))
    info = e["keyInfo"]
    number = lambda c: c.try_cast("double")
    whole = lambda c, low, high: F.coalesce((number(c) == F.floor(number(c))) & number(c).between(low, high), F.lit(False))
    odd_numbers = F.lit(False)
    for n in KEY_NUMBERS:
        odd_numbers = odd_numbers | (info[n].isNotNull() & ~whole(info[n], 1, 65536))
    odd_texts = F.lit(False)
    for n in KEY_TEXTS:
        odd_texts = odd_texts | (info[n].isNotNull() & ((F.length(info[n]) > 100) | ~info[n].rlike(KEY_TEXT)))
    # An object inside keyInfo that is no field's text shows by its keys.
    key_names = F.json_object_keys(F.get_json_object("value", "$.keyInfo"))
    given_info = F.array_contains(keys, "keyInfo") & F.get_json_object("value", "$.keyInfo").isNotNull()
    scheme, host = F.coalesce(e["scheme"], F.lit("")), F.coalesce(e["hostOrigin"], F.lit(""))
    seen = F.to_timestamp(F.try_to_timestamp(e["timestamp"]))
    reason = (
        F.when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, EVENT_FIELDS)))) > 0, "field unknown")
        .when(~F.coalesce(e["source"].isin(*SOURCES), F.lit(False)), "source unknown")
        .when(~F.coalesce(e["operation"].isin(*OPERATIONS), F.lit(False)), "operation unknown")
        .when(~F.coalesce((F.length(e["algorithm"]) <= 100) & e["algorithm"].rlike(NAME), F.lit(False)), "algorithm malformed")
        .when((e["source"] == "library") & ~e["algorithm"].isin(*LIBRARIES), "library unknown")
        .when((e["source"] == "network") & (e["algorithm"] != "NETWORK"), "algorithm malformed")
        .when((e["source"] == "wasm") & (e["algorithm"] != "WASM"), "algorithm malformed")
        .when(given_info & key_names.isNull(), "keyInfo malformed")
        .when(F.size(F.array_except(F.coalesce(key_names, F.array().cast("array<string>")), F.array(*map(F.lit, KEY_NUMBERS + KEY_TEXTS)))) > 0, "keyInfo field unknown")
        .when(odd_numbers | odd_texts, "keyInfo malformed")
        .when(caller_place(e["callerScript"]).isNull(), "callerScript malformed")
        .when(~scheme.isin(*SCHEMES), "scheme unknown")
        .when((host != "") & origin(host).isNull(), "hostOrigin malformed")
        .when(e["port"].isNotNull() & ~whole(e["port"], 0, 65535), "port out of range")
        .when((e["source"] == "network") & ((scheme == "") | (host == "")), "network without host")
        .when(e["crossOrigin"].isNotNull() & ~e["crossOrigin"].isin("true", "false"), "crossOrigin malformed")
        .when(e["count"].isNotNull() & ~whole(e["count"], 1, MAX_COUNT), "count out of range")
        .when(e["timestamp"].isNotNull() & ((F.length(e["timestamp"]) > 40) | seen.isNull()), "timestamp malformed")
    )
    key = F.struct(*[(number(info[n]).cast("long") if n in KEY_NUMBERS else info[n]).alias(n) for n in sorted(KEY_NUMBERS + KEY_TEXTS)])
    key = F.when(info.isNotNull(), key).otherwise(F.struct(*[F.lit(None).cast("long" if n in KEY_NUMBERS else "string").alias(n) for n in sorted(KEY_NUMBERS + KEY_TEXTS)]))
    columns = {
        "source": e["source"], "algorithm": e["algorithm"], "operation": e["operation"], "key_info": key, "caller": caller_place(e["callerScript"]), "host_origin": F.coalesce(origin(host), F.lit("")), "scheme": scheme,
        "port": F.coalesce(number(e["port"]).cast("int"), F.lit(0)), "cross_origin": F.coalesce(e["crossOrigin"] == "true", F.lit(False)), "count": F.coalesce(number(e["count"]).cast("long"), F.lit(1)), "seen": seen,
    }
    return parsed.select("*", reason.alias("reject_reason"), *[c.alias(n) for n, c in columns.items()]).drop("_e")


def _json(text: Column) -> Column:
    """A string as JSON, in its quotes."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def event_identity() -> Column:
    """What makes normalised events the same call: SHA-256 of a JSON array of ten fields; the key's part is JSON with sorted names, without nulls."""
    texts = ["source", "algorithm", "operation"], ["caller", "host_origin", "scheme"]
    fields = [_json(F.col("run_id").cast("string")), *[_json(F.col(c)) for c in texts[0]], _json(F.to_json("key_info")), *[_json(F.col(c)) for c in texts[1]], F.col("port").cast("string"), F.col("cross_origin").cast("string")]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *fields), F.lit("]")), 256)


# Calls of wallets, weak and strong generators, names of curves, operations that exchange keys, and hashes as parts of signatures in the order that decides.
WALLET = ["eth_sendTransaction", "personal_sign", "eth_signTypedData", "eth_signTypedData_v3", "eth_signTypedData_v4", "eth_requestAccounts"]
WEAK_RANDOM, STRONG_RANDOM = ["Math.random", "Non-cryptographic PRNG", "random"], ["crypto.getRandomValues", "crypto.randomUUID", "secrets", "os.urandom", "uuid.uuid4", "CSPRNG"]
CURVES, EXCHANGES = ["ecdsa", "ecdh", "ed25519", "ed448", "secp256k1", "ec", "wallet signing"], ["derivekey", "derivebits", "key_exchange"]
SIGNED_HASHES = ["sha512", "sha384", "sha256", "sha1", "md5", "sha3"]
OLD_TLS = ["TLSv1", "TLSv1.1"]


def call_profile(algorithm: Column, operation: Column, key_info: Column) -> Column:
    """The profile of an observed call, by the first rule that knows its algorithm; null if none does."""
    algorithm = F.trim(F.coalesce(algorithm, F.lit("")))
    name, what = F.replace(F.lower(algorithm), F.lit("_"), F.lit("-")), F.lower(F.coalesce(operation, F.lit("")))
    bits = F.coalesce(key_info["keySize"], key_info["modulusLength"]).cast("int")
    mode = F.coalesce(F.nullif(F.upper(key_info["mode"]), F.lit("")), F.upper(F.regexp_extract(name, r"aes(?:-\d+)?-(gcm|cbc|ctr|ecb|ccm|ocb)", 1)))
    curve = F.coalesce(F.nullif(key_info["curve"], F.lit("")), F.when(name == "wallet signing", "secp256k1").otherwise(name))
    purpose = F.when((name == "ecdh") | what.isin(*EXCHANGES), "key_exchange").otherwise("signature")
    keyed = F.regexp_extract(name, r"^hmac[- ]?(sha[- ]?\d+|md5)?$", 1)
    inner = fp.normal_hash(F.coalesce(F.nullif(keyed, F.lit("")), key_info["hash"]))
    return (
        F.when(algorithm.isin(*WALLET), fp.profile("ECDSA secp256k1", "Critical", "Quantum-Broken"))
        .when(algorithm.isin(*WEAK_RANDOM) | name.startswith("python random.") | (name == "math.random"), fp.profile("Non-CSPRNG", "Informational", "Safe"))
        .when(algorithm.isin(*STRONG_RANDOM), fp.profile("CSPRNG", "Informational", "Safe"))
        .when(name.startswith("jwt "), fp.listed(fp.TOKENS, F.regexp_replace(name, "^jwt ", "")))
        .when(name.isin(*fp.TOKENS), fp.listed(fp.TOKENS, name))
        .when(name.contains("aes"), fp.symmetric_profile(F.lit("AES"), mode, bits))
        .when(name.startswith("rsa"), fp.rsa_profile(bits))
        .when(name.isin(*CURVES), fp.curve_profile(curve, purpose))
        .when(fp.normal_hash(algorithm).isNotNull(), fp.hash_profile(fp.normal_hash(algorithm)))
        .when(name.isin(*fp.DERIVATIONS), fp.listed(fp.DERIVATIONS, name))
        .when(name.rlike(r"^hmac[- ]?(sha[- ]?\d+|md5)?$") & inner.isNotNull(), fp.hash_profile(inner))
        .otherwise(fp.weak_profile(algorithm))
    )


def host_name(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, URL, 2)), F.lit(""))


def classify_events(events: DataFrame) -> DataFrame:
    """Findings of normalised events, none to two each: event_id, position, algorithm, severity, quantum_risk and category.

    ``events`` has event_id, source, algorithm, operation, key_info, scheme,
    host_origin and target_origin. All rules are one expression per event: the
    source decides, then the operation, then the algorithm.
    """
    c = F.col
    tls = c("source") == "tls"
    certificate, signature = tls & (c("operation") == "certificate"), tls & (c("operation") == "signature")
    signed = F.replace(F.replace(F.lower("algorithm"), F.lit("_"), F.lit("")), F.lit("-"), F.lit(""))
    digest = F.coalesce(*[F.when(signed.contains(h), h) for h in SIGNED_HASHES], c("algorithm"))
    # One evaluation of the call rules serves calls, certificates and signatures.
    asked = events.withColumns({"_name": F.when(signature, digest).otherwise(c("algorithm")), "_what": F.when(certificate, "sign").when(signature, "hash").otherwise(c("operation")), "_info": F.when(~signature, c("key_info"))})
    call = asked.withColumn("_call", call_profile(c("_name"), c("_what"), c("_info")))
    version = F.when(c("operation") == "protocol", c("algorithm")).otherwise(F.coalesce(F.nullif(c("key_info")["version"], F.lit("")), c("algorithm")))
    protocol = F.when(version.isin(*OLD_TLS), fp.profile(version, "High", "Classical Risk", "protocol")).otherwise(fp.profile(version, "Informational", "Safe", "protocol"))
    third = host_name(c("host_origin")).isNotNull() & host_name(c("target_origin")).isNotNull() & (host_name(c("host_origin")) != host_name(c("target_origin")))
    network = F.array(F.when(c("scheme").isin("http", "ws"), fp.profile("Unencrypted transport", "High", "Classical Risk", "protocol")), F.when(third, fp.profile("Cross-origin host", "Informational", "Safe", "network")))
    found = (
        F.when((c("source") == "crypto") | signature, F.array("_call"))
        .when(c("source") == "network", network)
        .when(c("source") == "library", F.array(fp.profile(F.coalesce("algorithm", F.lit("Observed operation")), "Informational", "Safe", "library")))
        .when(c("source") == "wasm", F.array(fp.profile("WebAssembly module", "Informational", "Safe", "library")))
        .when(tls & c("operation").isin("load", "handshake", "protocol"), F.array(protocol))
        .when(certificate, F.array(F.when(c("_call").isNotNull(), c("_call").withField("category", F.lit("certificate")))))
        .when(tls & (c("operation") == "key_exchange") & F.lower("algorithm").contains("ecdhe"), F.array(fp.profile("ECDHE", "Critical", "Quantum-Broken", "protocol")))
    )
    each = call.select("event_id", F.posexplode(F.array_compact(found)).alias("position", "p"))
    return each.select("event_id", "position", "p.*")


def session_findings(events: DataFrame) -> DataFrame:
    """What a stopped session's calls mean: the findings of each distinct call, with an id made of the run, the call, the finding's place and names.

    ``events`` are normalised ones, with event_id as their identity (see
    ``event_identity``), run_id, caller, count and seen beside what
    ``classify_events`` asks for. Calls are added up first, so ids do not depend
    on how often they came; a finding that is there already has the same id.
    """
    call = ["run_id", "event_id", "source", "algorithm", "operation", "key_info", "caller", "scheme", "host_origin", "target_origin"]
    calls = events.groupBy("run_id", "event_id").agg(*[F.first(c).alias(c) for c in call[2:]], F.sum("count").alias("count"), F.min("seen").alias("first_seen"))
    found = classify_events(calls)
    rows = found.join(calls.select("event_id", "run_id", "operation", "caller", "count", "first_seen"), "event_id")
    identity = F.concat_ws("|", F.col("run_id").cast("string"), "event_id", F.col("position").cast("string"), "algorithm", "operation")
    status = F.when(F.col("quantum_risk").contains("Broken"), "Quantum Vulnerable").when(F.col("quantum_risk").contains("Weakened"), "Quantum Weakened").when(F.col("quantum_risk").contains("Risk"), "Classical Risk").otherwise("Quantum Safe")
    line = F.nullif(F.regexp_extract("caller", r":(\d+)$", 1), F.lit("")).cast("long")
    return rows.withColumns({"finding_id": F.substring(F.sha2(identity, 256), 1, 32), "quantum_status": status, "file": F.regexp_replace("caller", r":\d+$", ""), "line": F.nullif(line, F.lit(0))})
