"""Properties and hand-made cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from qvault.functions import inference, scores, text, threat
from qvault.operators import cbom, detectors, findings, gate, integrity, rollups, rules, running, runtime
from qvault.operators import threat as model
from qvault.plans import bindings, q_detectors, q_integrity
from qvault.plans.all_queries import QUERIES

from oracle_helpers import DATA, rows_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dedup_does_not_depend_on_partitions(spark):
    rows = bindings.findings(spark, DATA)
    assert rows_of(findings.deduplicate(rows.repartition(1))) == rows_of(findings.deduplicate(rows.repartition(8)))


def test_draws_equal_the_sequential_generator(spark):
    def sequence(seed, n):
        state = seed
        for _ in range(n):
            state = (state + 0x6D2B79F5) & 0xFFFFFFFF
            v = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
            v ^= (v + (((v ^ (v >> 7)) * (v | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
            yield (v ^ (v >> 14)) / 4294967296

    got = [r["u"] for r in spark.range(1, 501).select(threat.uniform_draw(7, F.col("id")).alias("u"), "id").orderBy("id").collect()]
    assert got == list(sequence(7, 500))


def assess(spark, rows, seed=1, n=4000):
    table = spark.createDataFrame(rows, "asset_id long, family string, multiplier double, x double, y double")
    return {(r["asset_id"], r["scenario"]): r for r in model.threat_assessment(table, model.scenario_table(spark), n=n, seed=seed).collect()}


def test_threat_model_properties(spark):
    got = assess(spark, [(1, "RSA", 1.0, 5.0, 2.0), (2, "RSA", 1.0, 10.0, 2.0), (3, "RSA", 1.0, 5.0, 6.0), (4, "PQC", 1.0, 20.0, 4.0)])
    for s in threat.SCENARIOS:
        assert got[1, s]["p_violated"] <= got[2, s]["p_violated"] and got[1, s]["p_violated"] <= got[3, s]["p_violated"]
        assert got[4, s]["p_violated"] == 0 and got[4, s]["risk_band"] == "MINIMAL"
        assert 0 <= got[1, s]["p_violated_low"] <= got[1, s]["p_violated"] <= got[1, s]["p_violated_high"] <= 1
    assert got[1, "pessimistic"]["p_violated"] >= got[1, "median"]["p_violated"] >= got[1, "optimistic"]["p_violated"]
    again, other = assess(spark, [(1, "RSA", 1.0, 5.0, 7.0)]), assess(spark, [(1, "RSA", 1.0, 5.0, 7.0)], seed=99)
    p, q = again[1, "median"]["p_violated"], other[1, "median"]["p_violated"]
    assert p == assess(spark, [(1, "RSA", 1.0, 5.0, 7.0)])[1, "median"]["p_violated"]
    assert abs(p - q) <= 3 * math.sqrt(2 * p * (1 - p) / 4000)


def test_verhoeff_and_luhn(spark):
    assert one(spark, text.is_verhoeff(F.lit("2363"))) and not one(spark, text.is_verhoeff(F.lit("2364")))
    assert one(spark, text.is_luhn(F.lit("4111111111111111"))) and not one(spark, text.is_luhn(F.lit("4111111111111112")))


def test_values_are_masked_and_dates_are_not_taken(spark):
    lines = spark.createDataFrame([(1, "a", 1, "card 4111111111111111 ok"), (1, "a", 2, "2024-01-01 4111111111111111"), (1, "a", 3, "sha " + "4" * 40), (1, "a", 4, "ABCDE1234F and 2363 2363 2363"), (1, "a", 5, "")], "repo_id int, file string, line int, text string")
    got = {(r["line"], r["data_class"], r["evidence"]) for r in detectors.detect_values(lines).collect()}
    assert (1, "PAYMENT_CARD", "****1111") in got and (2, "PAYMENT_CARD", "****1111") in got and (4, "PAN", "****234F") in got
    assert not any(x[0] in (3, 5) for x in got)


def test_all_values_of_a_file_are_found(spark):
    lines = spark.range(450).selectExpr("1 AS repo_id", "'a' AS file", "CAST(id AS INT) AS line", "'card 4111111111111111 ok' AS text")
    assert detectors.detect_values(lines).count() == 450
    assert [r["line"] for r in detectors.detect_values(lines, cap=3).orderBy("line").collect()] == [0, 1, 2]


def test_a_very_long_line(spark):
    lines = spark.createDataFrame([(1, "a", 1, "1" * 900_000)], "repo_id int, file string, line int, text string")
    assert detectors.detect_values(lines).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_merkle_root_and_proofs(spark, n):
    import hashlib

    def root(level):
        while len(level) > 1:
            level = [hashlib.sha256("".join(sorted((level[i], level[min(i + 1, len(level) - 1)]))).encode()).hexdigest() for i in range(0, len(level), 2)]
        return level[0]

    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    leaves = spark.createDataFrame([(1, i, h, n) for i, h in enumerate(hashes)], "tree long, idx long, hash string, n long")
    assert integrity.merkle_roots(leaves).first()["root"] == root(hashes)
    proofs = integrity.merkle_proofs(leaves)
    assert proofs.where(integrity.verify_proof(F.col("leaf"), F.col("proof"), F.col("root"))).count() == n
    assert n == 1 or proofs.where(integrity.verify_proof(F.lit("00"), F.col("proof"), F.col("root"))).count() == 0


@pytest.mark.parametrize("large", [1 << 16, 40])
def test_merkle_trees_of_several_rounds(spark, monkeypatch, large):
    """Trees of one to three rounds beside each other, with leaves numbered by windows or by ranges, against plain Python."""
    import hashlib

    def levels(level):
        found = [level]
        while len(level) > 1:
            level = [hashlib.sha256("".join(sorted((level[i], level[min(i + 1, len(level) - 1)]))).encode()).hexdigest() for i in range(0, len(level), 2)]
            found.append(level)
        return found

    monkeypatch.setattr(integrity, "BLOCK_LEVELS", 3)
    monkeypatch.setattr(integrity, "LARGE_TREE", large)
    sizes = [1, 2, 5, 8, 9, 17, 63, 64, 65, 130, 513]
    rows = spark.createDataFrame([(n, -i, str(i)) for n in sizes for i in range(n)], "t long, o long, v string")
    leaves = integrity.number_leaves(rows, "t", ["o"], F.sha2("v", 256))
    want = {n: levels([hashlib.sha256(str(n - 1 - i).encode()).hexdigest() for i in range(n)]) for n in sizes}
    assert {r["tree"]: r["root"] for r in integrity.merkle_roots(leaves).collect()} == {n: w[-1][0] for n, w in want.items()}
    for r in integrity.merkle_proofs(leaves).collect():
        w, i = want[r["tree"]], r["idx"]
        assert r["leaf"] == w[0][i] and r["root"] == w[-1][0]
        assert r["proof"] == [level[min(i >> j ^ 1, len(level) - 1)] for j, level in enumerate(w[:-1])]


def test_proofs_join_no_level(spark):
    """Proofs of trees of one block come from one grouping, without a join, and one more table a level."""
    rows = spark.range(100).selectExpr("id % 7 AS t", "id AS o")
    plan = integrity.merkle_proofs(integrity.number_leaves(rows, "t", ["o"], F.sha2(F.col("o").cast("string"), 256)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_fingerprints_ignore_lines_and_slashes(spark):
    rows = spark.createDataFrame([("RSA", "sig", 2048, "./src/a.py", "sign"), ("rsa ", "sig", 2048, "src//a.py", "Sign")], "algorithm string, primitive string, key_size int, file string, usage string").withColumn("quantum_status", F.lit(None).cast("string"))
    assert gate.gate_assets(rows).select("fingerprint").distinct().count() == 1


def verdict(spark, base, head, waivers=None):
    schema = "repo_id int, ordinal int, algorithm string, primitive string, key_size int, file string, usage string, quantum_status string"
    b, h = (gate.gate_assets(spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], schema)) for rows in (base, head))
    return gate.gate_verdict(b, h, waivers).first()


RSA = ("RSA-2048", "sig", 2048, "src/a.py", "sign", "vulnerable")


def test_gate_verdicts(spark):
    assert verdict(spark, [RSA], [RSA])["verdict"] == "PASS"
    assert verdict(spark, [], [RSA])["verdict"] == "FAIL"
    assert verdict(spark, [RSA], [(*RSA[:3], "src/b.py", *RSA[4:])])["verdict"] == "PASS"  # moved
    waived = spark.createDataFrame([(1, "W1", None, "RSA", "src/*")], "waiver_ordinal int, waiver_id string, match_fingerprint string, match_algorithm string, match_path string")
    assert verdict(spark, [], [RSA], waived)["verdict"] == "PASS"
    assert verdict(spark, [], [("MD5", "hash", None, "x.py", "digest", "safe")])["prohibited"] == 1


def test_patched_scenarios_take_valid_timelines_only():
    got = model.patch_scenarios({"median": {"RSA": (5, 6, 7), "ECC": (9, 6, 7)}, "mine": {"AES": (1, 2, 3), "DH": (-1, 2, 3)}})
    assert got["median"]["RSA"] == (5, 6, 7) and got["median"]["ECC"] == threat.SCENARIOS["median"]["ECC"] and got["mine"] == {"AES": (1, 2, 3)} and got["optimistic"] == threat.SCENARIOS["optimistic"]


def test_policy_repairs_types():
    got = gate.load_policy({"waiver_max_days": "x", "unknown": 1, "prohibited_algorithms": "MD5", "max_new_quantum_vulnerable": "3"})
    assert got["waiver_max_days"] == 90 and got["max_new_quantum_vulnerable"] == 3 and isinstance(got["prohibited_algorithms"], list) and "unknown" not in got


def test_events_match_by_line_then_distance(spark):
    events = spark.createDataFrame([(1, "x/a.py", "sha256", 10), (2, "a.py", "SHA-256", 14), (3, "a.py", "sha256", 99), (4, "b.py", "sha256", 1)], "event_id int, file string, algorithm string, line int")
    known = spark.createDataFrame([("f1", "src/a.py", "SHA-256", 10, 1), ("f2", "src/a.py", "sha256", 12, 2)], "finding_id string, file string, algorithm string, line int, ordinal int")
    got = {r["event_id"]: (r["matched_finding_id"], r["match_reason"]) for r in runtime.match_events(events, known).collect()}
    assert got == {1: ("f1", "exact_line"), 2: ("f2", "same_function"), 3: ("f1", "same_file_algorithm"), 4: (None, "unmatched")}


def test_events_meet_one_finding_per_line(spark):
    known = spark.range(3000).selectExpr("cast(id as string) finding_id", "'a.py' file", "'SHA-256' algorithm", "cast(id % 3 + 10 as int) line", "3000 - id ordinal")
    assert runtime.first_per_line(known, F.col("file")).count() == 3
    events = spark.createDataFrame([(1, "a.py", "sha256", 11), (2, "a.py", "sha256", 14)], "event_id int, file string, algorithm string, line int")
    got = {r["event_id"]: (r["matched_finding_id"], r["match_reason"]) for r in runtime.match_events(events, known).collect()}
    assert got == {1: ("2998", "exact_line"), 2: ("2999", "same_function")}


def test_events_match_findings_of_late_scans(spark, tmp_path):
    spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_orderkey >= 400").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    assert q_integrity.matched(spark, str(tmp_path)).where("match_reason = 'exact_line'").count() > 0


def test_entropy_and_placeholders(spark):
    """Values by hand: whole-value placeholders only, four bits a character, and UUIDs that are named as secrets."""
    uuid = "6f9619ff-8b86-d011-b42d-00c04fc964ff"
    rows = [
        ("apiKey", "Zx81kLm20QpRt7vWnone", "high-confidence"), ("x", "aB3dE6gH9jK2mN5pQ8sT", "high-entropy-only"), ("password", "hunter2abc", "name-hint-only"), ("x", "aaaabbbbccccdddd", None), ("password", "${DB_PASSWORD}", None),
        ("password", "changeme", None), ("x", "1.2.3-beta.1", None), ("secret", "https://host/path/of/it", None), ("token", uuid, "name-hint-only"), ("id_of", uuid, None), ("secret", "/etc/ssl/private/key", None), ("token", "three words of prose", None),
    ]
    pairs = spark.createDataFrame([(1, "f", i, n, v) for i, (n, v, _) in enumerate(rows)], "repo_id int, file string, line int, name string, value string")
    got = {r["line"]: r["kind"] for r in detectors.entropy_secrets(pairs).collect()}
    assert got == {i: k for i, (_, _, k) in enumerate(rows) if k}
    plain = {r["line"] for r in detectors.plaintext_secrets(pairs).collect()}
    assert 0 in plain and 4 not in plain and 5 not in plain


def test_weak_directives_by_hand(spark):
    lines = [
        ("ssl_protocols TLSv1.2 TLSv1.3;", set()), ("ssl_protocols TLSv1 TLSv1.2;", {"nginx-weak-protocol"}), ("SSLProtocol all -SSLv3", {"apache-weak-protocol"}), ("SSLCipherSuite HIGH:!aNULL", set()), ("ssl_ciphers HIGH:RC4;", {"nginx-weak-cipher"}),
        ("MACs hmac-sha1-etm@openssh.com,hmac-sha2-256", set()), ("MACs hmac-sha1", {"ssh-weak-mac"}), ("HostKeyAlgorithms ssh-rsa-sha2-512", set()), ("ike=aes256-sha256-modp2048", set()), ("ike=3des-sha1-modp1024", {"ipsec-weak-ike"}), ("# Ciphers 3des-cbc", set()),
    ]
    table = spark.createDataFrame([(1, "f", i, t) for i, (t, _) in enumerate(lines)], "repo_id int, file string, line int, text string")
    got = detectors.weak_directives(table, [*rules.WEB_DIRECTIVES, *rules.SHELL_DIRECTIVES]).collect()
    assert {i: {r["rule_id"] for r in got if r["line"] == i} for i in range(len(lines))} == {i: w for i, (_, w) in enumerate(lines)}


def test_each_language_rule_finds_its_own(spark):
    assert len(rules.LANGUAGE_RULES) == 31
    table = spark.createDataFrame([(1, "f", i, lang, t) for i, (lang, t) in enumerate(q_detectors.CODE_SAMPLES)], "repo_id int, file string, line int, language string, text string")
    found = detectors.rule_scan(table).collect()
    assert {r["rule_id"] for r in found} == {r[1] for r in rules.LANGUAGE_RULES}
    quiet = [i for i, (_, t) in enumerate(q_detectors.CODE_SAMPLES) if t.startswith(("//", " *", "#")) or t in ("sha256.Sum256(data)", "$x = 1", "cmd5($x)", "x := 1")]
    assert not [r for r in found if r["line"] in quiet]


def test_inference_by_hand(spark):
    sizes = [("RSA-4096", "r", "", 4096), ("RSA", "rsa-1024-key", "", 1024), ("RSA", "r", "generate(3072)", 3072), ("AES", "r", "generate(3072)", None), ("3DES", "r", "", 112), ("DES", "r", "", 56), ("RC4", "r", "", 128), (None, None, None, None)]
    rows = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(sizes)], "i int, a string, r string, s string")
    got = {r["i"]: r["v"] for r in rows.select("i", inference.infer_key_size(F.col("a"), F.col("r"), F.col("s")).alias("v")).collect()}
    assert got == {i: r[3] for i, r in enumerate(sizes)}
    names = [("DES-EDE3", "3DES/DES"), ("'md5'", "MD5"), ("aes-256-gcm", None), ("gzip", None), ("aes-ecb", "ECB Mode"), ("x-ecb", "ECB Mode"), ("rc2", "RC4"), ("unknown", None), (None, None)]
    rows = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(names)], "i int, n string")
    got = {r["i"]: r["v"] for r in rows.select("i", inference.classify_algorithm(F.col("n"))["weak"].alias("v")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(names)}


def test_running_totals_of_one_large_group(spark):
    rows = spark.range(5000).selectExpr("1 as repo", "id", "id % 7 as size")
    got = {r["id"]: (r["b"], r["n"]) for r in running.running_totals(rows, ["repo"], ["id"], {"b": F.col("size"), "n": F.lit(1)}).collect()}
    total, want = 0, {}
    for i in range(5000):
        want[i] = (total, i)
        total += i % 7
    assert got == want


def test_suppressions_by_every_kind_of_rule(spark):
    found = spark.createDataFrame([(1, 1, "md5", "MD5", "src/a.py", 3, "x", False), (1, 2, "rsa", "RSA", "src/b.py", 4, "y", False), (1, 3, "des", "DES", "lib/a.py", 5, "z", False)], "scan_id int, ordinal int, rule_id string, algorithm string, file string, line int, code_snippet string, suppressed boolean")
    token = findings.finding_fingerprint(F.lit("des"), F.lit("DES"), F.lit("z"))
    fp = one(spark, token)

    def by(*rule):
        r = spark.createDataFrame([(1, *rule)], "ordinal int, rule_id string, path string, line int, token string")
        return {x["ordinal"] for x in findings.apply_suppressions(found, r).where("suppressed").collect()}

    assert by("md5", None, None, None) == {1} and by("RSA", None, None, None) == {2} and by(None, "a.py", None, None) == {1, 3} and by("*", "src/a.py", None, None) == {1, 3}
    assert by(None, None, 4, None) == {2} and by(None, None, None, fp) == {3} and by(None, None, None, None) == {1, 2, 3} and by("md5", "b.py", None, None) == set()


def test_field_links_by_signs(spark):
    fields = spark.createDataFrame([(1, 1, "src/a/m.py", 10, "a", True), (1, 2, "src/b/n.py", 10, "b", False)], "repo_id int, field_id int, file string, line int, service string, is_column boolean")
    assets = spark.createDataFrame([(1, 11, "src/a/m.py", 12, "a", True, False), (1, 12, "src/a/x.py", 1, "a", True, True), (1, 13, "src/c/y.py", 1, "c", False, False), (1, 14, "src/b/z.py", 1, "b", False, False)], "repo_id int, asset_id int, file string, line int, service string, encrypts boolean, runtime boolean")
    edges = spark.createDataFrame([(1, "src/b/n.py", "src/c/y.py")], "repo_id int, file string, imported string")
    got = {(r["field_id"], r["asset_id"]): (r["score"], r["rank"], r["ambiguous"]) for r in rollups.link_fields(fields, assets, imports=edges).collect()}
    assert got == {(1, 11): (0.7, 1, False), (1, 12): (round(1 - 0.85 * 0.9 * 0.85, 6), 2, False), (2, 13): (0.3, 1, False), (2, 14): (0.15, 2, False)}


def one_file(spark, n, seed):
    import random

    r = random.Random(seed)
    fields = [(1, i, f"s/{r.choice('ab')}.py", r.randint(0, 120), r.choice(["x", "y", None]), r.random() < 0.5) for i in range(n)]
    assets = [(1, i, f"s/{r.choice('abc')}.py", r.randint(0, 120), r.choice(["x", "y", None]), r.random() < 0.5, r.random() < 0.3) for i in range(n)]
    calls = [(1, f[2], r.randint(0, 120), f[1]) for f in fields for _ in range(r.choice([0, 0, 1, 2]))]
    tables = (
        spark.createDataFrame(fields, "repo_id int, field_id int, file string, line int, service string, is_column boolean"),
        spark.createDataFrame(assets, "repo_id int, asset_id int, file string, line int, service string, encrypts boolean, runtime boolean"),
        spark.createDataFrame(calls, "repo_id int, file string, line int, field_id int"),
    )
    return fields, assets, calls, tables


def test_field_links_equal_all_pairs(spark):
    fields, assets, calls, (f, a, c) = one_file(spark, 120, 5)

    def score(x, y):
        left = 0.85 if y[6] else 1.0
        if x[2] == y[2]:
            near = x[3] > 0 and y[3] > 0 and abs(x[3] - y[3]) <= 30
            called = any(g[3] == x[1] and abs(g[2] - y[3]) <= 30 for g in calls)
            return 1 - left * 0.4 * (0.75 if near else 1) * (0.55 if called else 1)
        return 1 - left * 0.85 * (0.9 if x[5] and y[5] and x[4] is not None and x[4] == y[4] else 1)

    want = {}
    for x in fields:
        best = sorted((-round(min(0.9, score(x, y)), 9), y[1]) for y in assets)[:3]
        want |= {(x[1], i): (round(-s, 6), n, best[-1][0] - best[0][0] < 1e-9) for n, (s, i) in enumerate(best, 1)}
    assert {(r["field_id"], r["asset_id"]): (r["score"], r["rank"], r["ambiguous"]) for r in rollups.link_fields(f, a, calls=c).collect()} == want


def test_field_links_of_a_file_make_no_pairs(spark):
    """No step of the plan gives anything like a row per field and asset of a file."""
    _, _, _, (f, a, _) = one_file(spark, 3000, 6)  # three million pairs of one file
    links = rollups.link_fields(f, a)
    links.collect()

    def rows(plan):
        inner = [getattr(plan, n)() for n, kind in (("executedPlan", "AdaptiveSparkPlan"), ("plan", "QueryStage")) if kind in plan.getClass().getSimpleName()]
        own = plan.metrics().get("numOutputRows")
        children = plan.children()
        return max([own.get().value() if own.isDefined() else 0, *map(rows, inner), *[rows(children.apply(i)) for i in range(children.size())]])

    assert 0 < rows(links._jdf.queryExecution().executedPlan()) < 200_000


def test_fields_meet_few_assets_of_other_files_and_move_once(spark, monkeypatch):
    """Places meet the first assets that score alike, not every one of a folder; written tables are joined where fields lie."""
    fields = spark.range(3000).selectExpr("1 AS repo_id", "id AS field_id", "concat('s/f', id % 100, '.py') AS file", "CAST(id % 50 AS INT) AS line", "'x' AS service", "true AS is_column")
    assets = spark.range(3000).selectExpr("1 AS repo_id", "id AS asset_id", "'s/a.py' AS file", "CAST(id % 50 AS INT) AS line", "'x' AS service", "id % 2 = 0 AS encrypts", "false AS runtime")
    calls = spark.range(0, 3000, 7).selectExpr("1 AS repo_id", "concat('s/f', id % 100, '.py') AS file", "5 AS line", "id AS field_id")

    def rows(plan):
        inner = [getattr(plan, n)() for n, kind in (("executedPlan", "AdaptiveSparkPlan"), ("plan", "QueryStage")) if kind in plan.getClass().getSimpleName()]
        own = plan.metrics().get("numOutputRows")
        children = plan.children()
        return max([own.get().value() if own.isDefined() else 0, *map(rows, inner), *[rows(children.apply(i)) for i in range(children.size())]])

    links = rollups.link_fields(fields, assets, calls=calls)
    assert "hashpartitioning" not in links._jdf.queryExecution().executedPlan().toString()
    want = {(i, a) for i in range(3000) for a in (0, 2, 4)}
    assert {(r["field_id"], r["asset_id"]) for r in links.collect()} == want
    monkeypatch.setattr(rollups, "materialize", lambda df, label: (df, label))
    whole = rollups.link_fields(fields, assets, calls=calls)  # all steps in one plan
    assert {(r["field_id"], r["asset_id"]) for r in whole.collect()} == want
    assert 0 < rows(whole._jdf.queryExecution().executedPlan()) < 20_000



def test_words_of_a_name_are_found_once_a_step(spark):
    """Phrases are looked for in words that are bound once, so a plan parts an identifier in a few places, not one a phrase list."""
    rows = spark.createDataFrame([("pan", "card payment"), ("userEmail", ""), ("total", "")], "name string, table string")
    named = detectors.detect_names(rows)
    assert {(r["name"], r["data_class"]) for r in named.collect()} == {("pan", "PAYMENT_CARD"), ("userEmail", "PII_OTHER")}
    assert named._jdf.queryExecution().optimizedPlan().toString().count("([A-Z]+)([A-Z][a-z])") <= 12


def test_plans_stay_small(spark):
    assert len(QUERIES["j21_pqc_size_impact"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    for name, scans in (("a9_gate_verdict", 3), ("w4_suppress_generic", 1), ("x4_apply_suppressions", 2)):
        df = QUERIES[name](spark, DATA)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert text.count("FileScan") <= scans and "NestedLoop" not in text and "Cartesian" not in text


def test_audit_chain_finds_forks(spark):
    log = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a")], "entry_hash string, previous_hash string")
    assert integrity.verify_audit_chain(log, F.col("entry_hash")).where("problem = 'fork'").count() == 2


def test_scores_stay_in_bounds(spark):
    rows = spark.createDataFrame([(p, s, m) for p in ("RSA", "AES", "MD5", None) for s in (None, 128, 4096) for m in (None, "ECB")], "p string, s int, m string")
    got = [r["v"] for r in rows.select(F.expr(scores.vulnerability_score("p", "s", "m", "'mac'", "20", "'external'", "'Critical'")).alias("v")).collect()]
    assert all(0 <= v <= 100 for v in got)


def test_timelines_that_cannot_be_drawn_from(spark):
    nan = float("nan")
    rows = [("triangular", 1.0, 2.0, 3.0, None, None, None), ("triangular", 3.0, 1.0, 5.0, None, None, "years do not ascend"), ("triangular", None, 1.0, 5.0, None, None, "parameters not finite"), ("normal", None, None, None, 0.0, 2.0, None), ("normal", None, None, None, 0.0, -1.0, "sd not positive")]
    rows += [("lognormal", None, None, None, 0.0, 1.0, "mean not positive"), ("lognormal", None, None, None, 10.0, nan, "parameters not finite"), ("uniform", None, None, None, None, None, "distribution unknown"), (None, 1.0, 2.0, 3.0, None, None, "distribution unknown")]
    table = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(rows)], "i int, distribution string, low double, mode double, high double, mean double, sd double")
    assert {r["i"]: r["reject_reason"] for r in model.check_timelines(table).collect()} == {i: r[6] for i, r in enumerate(rows)}


def test_mixed_draws_are_those_of_one_generator(spark):
    """Families take one or two draws a time in turn, as one sequential generator would give them."""
    state, draws = 5, []
    for _ in range(300):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        v = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        v ^= (v + (((v ^ (v >> 7)) * (v | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        draws.append((v ^ (v >> 14)) / 4294967296)
    take = iter(draws)
    gauss = lambda: math.sqrt(-2 * math.log(next(take))) * math.cos(2 * math.pi * next(take))
    want = {"AES": [max(0, 10 + 3 * gauss()) for _ in range(40)]}
    u = [next(take) for _ in range(40)]
    want["ECC"] = [1 + math.sqrt(x * 9 * 2) if x < 2 / 9 else 10 - math.sqrt((1 - x) * 9 * 7) for x in u]
    s2 = math.log1p((4 / 8) ** 2)
    want["RSA"] = [math.exp(math.log(8) - s2 / 2 + math.sqrt(s2) * gauss()) for _ in range(40)]
    table = model.timeline_table(spark, {"s": {"AES": ("normal", (10, 3)), "ECC": ("triangular", (1, 3, 10)), "RSA": ("lognormal", (8, 4)), "DH": ("normal", (5, -1))}})
    got = {}
    for r in model.draws(spark, table, ["RSA", "ECC", "AES", "PQC", "DH"], 40, 5).collect():
        got.setdefault(r["family"], []).append(r["z"])
    assert set(got) == set(want)
    assert all(math.isclose(a, b, rel_tol=1e-12) for f in want for a, b in zip(sorted(got[f]), sorted(want[f]), strict=True))


def test_rules_of_one_repository_leave_the_others(spark):
    """Waivers, suppressions, events and locks of a repository say nothing about the same path in another."""
    schema = "repo_id int, ordinal int, algorithm string, primitive string, key_size int, file string, usage string, quantum_status string"
    assets = gate.gate_assets(spark.createDataFrame([(r, 1, *RSA) for r in (1, 2, 3)], schema))
    waivers = spark.createDataFrame([(1, "W1", None, "rsa-2048-x", "src/*", 2), (2, "W2", None, "RSA", "lib/*", None), (3, "W3", None, "RSA", "src/*", 9)], "waiver_ordinal int, waiver_id string, match_fingerprint string, match_algorithm string, match_path string, repo_id int")
    assert {r["repo_id"]: r["waiver_id"] for r in gate.apply_waivers(assets, waivers).collect()} == {1: None, 2: "W1", 3: None}
    assert {r["waiver_id"] for r in gate.stale_waivers(waivers, assets).collect()} == {"W2", "W3"}
    found = spark.createDataFrame([(r, r, 1, "md5", "MD5", "src/a.py", 3, "x", False) for r in (1, 2)], "repo_id int, scan_id int, ordinal int, rule_id string, algorithm string, file string, line int, code_snippet string, suppressed boolean")
    rules_of = spark.createDataFrame([(1, "md5", None, None, None, 1)], "ordinal int, rule_id string, path string, line int, token string, repo_id int")
    assert {r["repo_id"]: r["suppressed"] for r in findings.apply_suppressions(found, rules_of).collect()} == {1: True, 2: False}
    events = spark.createDataFrame([(1, 1, "login.py", "sha256", 10), (2, 2, "login.py", "sha256", 10)], "event_id int, repo_id int, file string, algorithm string, line int")
    known = spark.createDataFrame([("f1", 1, "src/login.py", "SHA-256", 10, 1)], "finding_id string, repo_id int, file string, algorithm string, line int, ordinal int")
    assert {r["event_id"]: r["match_reason"] for r in runtime.match_events(events, known, keys=["repo_id"]).collect()} == {1: "exact_line", 2: "unmatched"}
    deps = spark.createDataFrame([(r, "npm", "Left-Pad", "^1.0.0") for r in (1, 2, 3)], "repo_id int, ecosystem string, library string, declared_version string")
    locks = spark.createDataFrame([(1, "a/package-lock.json", "npm", "left-pad", "9.9.9"), (1, "package-lock.json", "npm", "left-pad", "1.2.0"), (2, "package-lock.json", "npm", "left-pad", "2.0.0")], "repo_id int, path string, ecosystem string, library string, resolved_version string")
    safe = spark.createDataFrame([("npm", "left-pad", "1.3.0")], "ecosystem string, library string, min_safe_version string")
    got = rollups.sca_findings(deps, safe, locks)
    assert len(set(got.columns)) == len(got.columns)
    assert {r["repo_id"]: (r["version"], r["needs_bump"]) for r in got.collect()} == {1: ("1.2.0", True), 2: ("2.0.0", False), 3: ("1.0.0", True)}


def test_winners_inherit_signs_of_exposure(spark):
    schema = "scan_id int, ordinal int, file string, line int, detection_method string, algorithm string, category string, specificity int, mode string, exposure_signals array<string>, exposure_rationale string"
    rows = [(1, 1, "a", 1, "AST", "AES", "x", 1, "CBC", ["net"], ""), (1, 2, "a", 1, "AST", "AES", "x", 3, None, [], None), (1, 3, "a", 1, "AST", "AES", "x", 2, "GCM", None, "public"), (1, 4, "b", 1, "AST", "AES", "x", 1, None, [], "")]
    got = {r["ordinal"]: (r["mode"], r["exposure_signals"], r["exposure_rationale"]) for r in findings.collapse_same_layer(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2: ("CBC", ["net"], "public"), 4: (None, [], "")}


@pytest.mark.parametrize("name", ["w2_collapse_same_layer", "w3_corroborate", "w4_suppress_generic"])
def test_findings_of_a_scan_are_dealt_once(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_inventories_are_compared_by_one_join(spark):
    rows = lambda *fs: spark.createDataFrame([(r, f, f, i, "RSA", 1024, "a.py", True) for i, (r, f) in enumerate(fs)], "repo_id int, fingerprint string, moved_fingerprint string, ordinal int, algorithm string, key_size int, file string, vulnerable boolean")
    base, head = rows((1, "x"), (1, "x"), (1, "y"), (None, "x"), (1, None)), rows((1, "x"), (1, "z"), (2, "y"), (None, "x"), (1, None))
    diff = gate.asset_diff(base, head)
    assert diff._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = sorted((r["change"], str(r["repo_id"]), str(r["fingerprint"])) for r in diff.collect())
    assert got == [("added", "1", "None"), ("added", "1", "z"), ("added", "2", "y"), ("added", "None", "x"), ("removed", "1", "None"), ("removed", "1", "y"), ("removed", "None", "x"), ("unchanged", "1", "x")]
    # Only what one inventory lacks is ranked.
    verdict = gate.gate_verdict(base, head)
    assert "windowspecdefinition(repo_id, fingerprint" not in "".join(c for c in verdict._jdf.queryExecution().optimizedPlan().toString() if c not in "#0123456789")
    assert {r["repo_id"]: (r["base_vulnerable"], r["head_vulnerable"], r["unwaived"]) for r in verdict.collect()} == {1: (4, 3, 1), 2: (0, 1, 1), None: (1, 1, 0)}


def test_lines_made_of_a_small_table_are_dealt_first(spark, monkeypatch):
    monkeypatch.setattr(bindings, "ROWS_OF_PART", 20)
    made = bindings.dealt(spark, DATA, q_detectors.SURFACE, "part", "p_partkey")
    assert made.rdd.getNumPartitions() == 10
    for name in ("p20_random_context", "p22_exposure_surface", "p23_classify_exposure", "p29_resolve_retention"):
        assert "REPARTITION_BY_NUM" in QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_names_are_put_in_upper_case_once(spark):
    """A text is prepared once for all patterns, and plain words are found as the patterns find them."""
    import re

    from qvault.functions import sizes

    texts = ["falcon512", "FALCON-1024", "sha1", "SHA-384 digest", "an ec key", "sec key", "aes in ecb", "AES-256", "3des", "des", "hybrid x25519", " rsa ", "rot13", "", None]
    want = [next((n for p, n in sizes.SPELLED if re.search(p, t.strip().upper())), None) if t is not None else None for t in texts]
    named = spark.createDataFrame([(t,) for t in texts], "t string").select(sizes.normal_algorithm(F.col("t")).alias("n"))
    assert [r["n"] for r in named.collect()] == want
    assert named._jdf.queryExecution().analyzed().toString().count("upper(") == 1


def test_components_are_written_before_they_are_gathered(spark):
    import json

    rows = [(1, 2, "a.py", 7, 'R"SA', 2048, None, "High", "x"), (1, 1, "b.py", None, "AES", None, "CBC", "Low", None), (1, 3, "a.py", 3, 'R"SA', 2048, None, "Low", None)]
    found = spark.createDataFrame(rows, "scan_id int, ordinal long, file string, line int, algorithm string, key_size int, mode string, severity string, library string")
    docs = cbom.build_cbom_documents(cbom.cbom_components(found))
    assert "collect_list(struct(o, " in docs._jdf.queryExecution().analyzed().toString()
    (doc,) = [json.loads(r["content"]) for r in docs.collect()]
    assert (doc["bomFormat"], doc["specVersion"], [c["name"] for c in doc["components"]]) == ("CycloneDX", "1.6", ["AES", 'R"SA'])
    assert [(o["file"], o.get("line")) for o in doc["components"][1]["occurrences"]] == [("a.py", 3), ("a.py", 7)]
    assert {(r["algorithm"], r["file"], r["line"]) for r in cbom.explode_cbom(docs).collect()} == {(x[4], x[2], x[3]) for x in rows}


def test_exposure_sends_no_side_to_the_driver(spark):
    """A surface's names repeat, so what is small as it is shuffled is large when the driver builds it for all tasks."""
    df = QUERIES["p23_classify_exposure"](spark, DATA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
