"""Detectors of secrets, names and retention, by hand."""

import pytest
from pyspark.sql import functions as F

from qvault.operators import blocks, detectors

LINES = "repo_id int, file string, line int, text string"


def table(spark, text, file="a"):
    rows = text if isinstance(text, list) else text.split("\n")
    return spark.createDataFrame([(1, file, i + 1, t) for i, t in enumerate(rows)], LINES)


def test_assignments_in_all_quotes_and_without(spark):
    cases = [
        ("api_key = 'abcdef0123456789'", [("api_key", "abcdef0123456789")]), ("SECRET=abcdef0123456789", [("SECRET", "abcdef0123456789")]), ("const k = `tick`, o = {\"a\": \"b c\"}", [("k", "tick")]), ("export T=tok==  # of it", [("T", "tok==")]),
        ("x = r'raw\\n' + f\"y\"", [("x", "raw\n")]), ("y: 'it\\'s'; z = \"a\\\"b\"", [("y", "it\\'s"), ("z", "a\\\"b")]), ("# p = 'commented'", []), ("// q = \"x\"", []), ("a == 'b'", []), ("a=b(c)", []), ("$v = 'php'", [("$v", "php")]), ("e = ''", [("e", "")]), (None, []),
    ]
    found = detectors.extract_assignments(table(spark, [t for t, _ in cases])).collect()
    assert [sorted((r["name"], r["value"]) for r in found if r["line"] == i + 1) for i in range(len(cases))] == [sorted(w) for _, w in cases]


def test_a_long_line_of_escapes(spark):
    long = "k = \"" + "\\x" * 200_000 + "\""
    assert [len(r["value"]) for r in detectors.extract_assignments(table(spark, [long])).collect()] == [400_000]


def test_config_keys_in_quotes_and_objects(spark):
    cases = [
        ('"password": "abcdef",', ("password", "abcdef")), ("{ 'db-key' : 'v 1' }", ("db-key", "v 1")), ("port: 80 # http", ("port", "80")), ("ENV A_B=c", ("A_B", "c")), ("export X = \"y\"", ("X", "y")), ("u: ${VAR}", ("u", "${VAR}")), ("t: {{ tpl }}", ("t", "{{ tpl }}")), ('{"k": {"n": "v"}}', ("k", '{"n": "v')),
        ("# a: b", None), ("// a: b", None), ("just words", None), ("10:30 is late", None), ('"2fa": "on"', ("2fa", "on")), (None, None),
    ]
    found = {r["line"]: (r["name"], r["value"]) for r in detectors.extract_config_kv(table(spark, [t for t, _ in cases])).collect()}
    assert found == {i + 1: w for i, (_, w) in enumerate(cases) if w}


def test_kubernetes_sections(spark):
    text = "apiVersion: v1\nkind: Secret\nmetadata:\n  name: dbsecret\nstringData:\n  password: p@ss-w0rd!\n  short: abc\n  ref: ${X}\ntype: Opaque\n  after: longenough\ndata:\n  k: c2VjcmV0\n  bad: !!!!!\n  tiny: YWI=\n  bin: /////w==\n---\ndata:\n  k: c2VjcmV0\nkind: ConfigMap\nstringData:\n  x: longenough\n---\nkind: secret\ndata:\n# note: x\n  u: 'c2VjcmV0'"
    found = {(r["line"], r["name"], r["is_base64"]) for r in detectors.k8s_secrets(table(spark, text)).collect()}
    assert found == {(6, "password", False), (12, "k", True), (26, "u", True)}


def test_terraform_names(spark):
    text = 'db_password = "hunter2secret"\ntoken = "var.token_x1"\nname = "not a secret"\napi_key="abcde"\nclient_secret = "${var.x}"'
    assert [r["name"] for r in detectors.terraform_secrets(table(spark, text)).collect()] == ["db_password"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("function makeToken() {\n  return Math.random()\n}", {2}),
        ("function shuffle(a) {\n  if (a) { b() }\n  return Math.random()\n}\nconst sessionKey = 1 + Math.random()\nMath.random()", {5}),
        ("function newSecret()\n{\n  const f = () => 1\n  Math.random()\n}\nfunction other() {\n  Math.random() }", {4}),
        ("const token = () => Math.random()\nlet x = Math.random()", {1}),
        ("class A {\n  resetPassword(n) {\n    s = \"}\"\n    return Math.random()\n  }\n  paint() {\n    return Math.random()\n  }\n}", {4}),
        ("if (token == Math.random()) {}", set()),
        ("// token = Math.random()", set()),
    ],
)
def test_random_numbers_of_secrets(spark, text, want):
    found = detectors.crypto_call_sites(table(spark, text)).where("name = 'Math.random'").collect()
    assert {r["line"] for r in found} == want
    assert detectors.crypto_call_sites(table(spark, "x = random.randint(1, 2)")).count() == 1


def test_calls_on_odd_lines(spark):
    """Names and arguments as the plain pattern gives them; a word of any length is read once."""
    import re
    import time

    plain = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*\(([^()]*)\)", re.ASCII)
    odd = ["1abc(x)", "a1b2(3) c", "1.b(2)", "a.1(x) b.c::d  (y)", "f(g(x), h())", "f(x)g(y)", "$a_(1)$(2)", "9(x)", "a..b(c)", "a:b(c)", "é1x(z)", "no call", "open(", "close)", "hashlib.md5(x);MD5.new ()", "x.hashlib.md5(1)", ""]
    got = sorted((r["line"], r["name"], r["args"]) for r in detectors.call_sites(table(spark, odd)).collect())
    assert got == sorted((i + 1, *m) for i, t in enumerate(odd) for m in plain.findall(t))
    long = ["x" * 400_000, "a1" * 200_000 + " hashlib.md5(a)", "y" * 400_000 + " (" + "z" * 400_000 + ")=="]
    begun = time.monotonic()
    assert {(r["line"], r["name"]) for r in detectors.crypto_call_sites(table(spark, long)).collect()} == {(2, "hashlib.md5")}
    assert time.monotonic() - begun < 30


def test_nesting_by_indents_and_braces(spark):
    text = "def a():\n  def b():\n    x\n  y\n\nz\nclass C(D):\n  f = 1\n  def g(self):\n    h\ni\nmodel M {\n  id Int\n}\nconst s = new Schema({\n  k: {\n  }\n})\nend"
    rows = sorted(blocks.with_blocks(table(spark, text)).collect(), key=lambda r: r["line"])
    assert [(r["function"], r["table"]) for r in rows] == [
        ("a", None), ("b", None), ("b", None), ("a", None), ("a", None), (None, None), (None, "C"), (None, "C"), ("g", "C"), ("g", "C"), (None, None), (None, "M"), (None, "M"), (None, "M"), (None, "s"), (None, "s"), (None, "s"), (None, "s"), (None, None),
    ]
    assert [r["depth"] for r in rows][11:] == [0, 1, 1, 0, 1, 2, 1, 0]


def test_the_same_name_in_two_tables(spark):
    text = "CREATE TABLE payments (\n  pan VARCHAR(16),\n  note TEXT\n);\nCREATE TABLE taxpayer (\n  pan VARCHAR(10)\n);\nclass Visit {\n  has_diagnosis: boolean;\n  see(patientId: string, when = 1) { }\n}\ncreate table x (dob date, n int)"
    found = {(r["line"], r["name"], r["table"], r["data_class"], r["confidence"]) for r in detectors.detect_names(detectors.scoped_fields(table(spark, text))).collect()}
    assert found == {(2, "pan", "payments", "PAYMENT_CARD", 0.9), (6, "pan", "taxpayer", "PAN", 0.9), (9, "has_diagnosis", "Visit", "HEALTH", 0.35), (10, "patientId", "Visit", "HEALTH", 0.68), (12, "dob", "x", "PII_OTHER", 0.9)}


def test_retention_by_source(spark):
    lines = table(spark, ["user_phone here", *["x"] * 4, "kept 4 years", *["x"] * 6, "phones"], "a.py").unionByName(table(spark, ["uid_ttl_days: 1", "icd_retention: 730", "card_number.expiry = 36500"], "c.yaml"))
    fields = spark.createDataFrame([(1, 1, "phone", "PII_OTHER"), (1, 2, "icd", "HEALTH"), (1, 3, "cvv", "PAYMENT_CARD"), (1, 4, "card-number", "PAYMENT_CARD"), (1, 5, "uid", "AADHAAR"), (2, 6, "phone", "PII_OTHER")], "repo_id int, field_id int, name string, data_class string")
    own = spark.createDataFrame([(1, 5, 11.0)], "repo_id int, field_id int, years double")
    got = {r["field_id"]: (r["retention_years"], r["retention_source"]) for r in detectors.resolve_retention(fields, lines, own).collect()}
    assert got == {1: (4.0, "stated"), 2: (2.0, "inferred"), 3: (5.0, "default"), 4: (100.0, "inferred"), 5: (11.0, "stated"), 6: (3.0, "default")}


def test_bands_meet_as_a_plain_join(spark):
    left = spark.range(200).selectExpr("1 repo_id", "'a' file", "cast(id * 7 % 101 as int) line", "id")
    right = spark.range(150).selectExpr("1 repo_id", "'a' file", "cast(id * 5 % 97 as long) _l", "id k")
    got = detectors.within_lines(left, right, 5).select("id", "k").collect()
    want = {(i, k) for i in range(200) for k in range(150) if abs(i * 7 % 101 - k * 5 % 97) <= 5}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
