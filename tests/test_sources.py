"""Import edges and languages of files, by hand."""

from pyspark.sql import functions as F

from qvault.functions.languages import detect_language
from qvault.sources import imports


def edges(spark, files):
    rows = [(r, f, i, t) for r, f, text in files for i, t in enumerate(text.split("\n"))]
    return {tuple(x) for x in imports.import_edges(spark.createDataFrame(rows, "repo_id int, file string, line int, text string")).collect()}


def test_relative_imports_are_resolved(spark):
    files = [
        (1, "src/a.js", "const b = require('./b')\nimport d from '../lib/d';\nimport e from './sub';\nrequire('../../out')"), (1, "src/b.ts", "import a from \"./x/.././a.js\""), (1, "lib/d.mjs", "require('..//src/./b.js')"), (1, "src/sub/index.js", "import './b'; export { q } from '.'"),
        (2, "src/b.js", "require('./a')"), (1, "out.js", "require('lib/d')"), (1, "top.js", "require('./out'); require('./src/b.min')"), (1, "src/b.min.js", ""), (1, "win\\c.js", "require('./d')"), (1, "win/d.js", "// from nowhere"),
    ]
    assert edges(spark, files) == {(1, "src/a.js", "src/b.ts"), (1, "src/a.js", "lib/d.mjs"), (1, "src/a.js", "src/sub/index.js"), (1, "src/b.ts", "src/a.js"), (1, "lib/d.mjs", "src/b.ts"), (1, "top.js", "out.js"), (1, "top.js", "src/b.min.js"), (1, "top.js", "src/b.ts"), (1, "win\\c.js", "win/d.js")}


def test_python_imports(spark):
    files = [(1, "app/main.py", "from app.util import x\nimport lib\nimport os"), (1, "app/util.py", ""), (1, "lib/__init__.py", "import app.main")]
    assert edges(spark, files) == {(1, "app/main.py", "app/util.py"), (1, "app/main.py", "lib/__init__.py"), (1, "lib/__init__.py", "app/main.py")}


def test_normal_paths(spark):
    cases = {"a/./b//c": "a/b/c", "a/b/../c": "a/c", "../x": "../x", "a/../../x": "../x", "./": "", "a\\..\\b": "b", "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", imports.normal_path(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in got} == cases


def test_languages(spark):
    cases = [
        ("x/.github/workflows/ci.yml", None, "GitHub Actions"), ("a/Dockerfile", None, "Dockerfile"), ("a/dockerfile.dev", None, "Dockerfile"), ("a/POM.XML", None, "Maven POM"), (".env", None, "Dotenv"), ("a/.env.local", None, "Dotenv"), ("requirements-dev.txt", None, "pip requirements"),
        ("a.PY", None, "Python"), ("x.R", None, "R"), ("a.tar.tf", None, "Terraform/HCL"), (".hidden", None, "Unknown"), ("noext", None, "Unknown"), ("run", "#!/usr/bin/env python3\nx", "Python"), ("run", "#!/usr/local/bin/node18.2 --x", "JavaScript"), ("run", "#!/opt/my-ruby-wrap", "Ruby"),
        ("k", "text\n-----BEGIN EC PRIVATE KEY-----", "Private key"), ("k", "-----BEGIN CERTIFICATE-----", "Certificate"), ("k", "x " * 1200 + "\nFROM y", "Unknown"), ("k", "hello\nFROM scratch", "Dockerfile"), ("k", "", "Unknown"), ("c:\\k8s\\d.yaml", None, "Kubernetes manifest"),
    ]
    table = spark.createDataFrame([(i, p, c) for i, (p, c, _) in enumerate(cases)], "i int, path string, content string")
    got = {r["i"]: r["v"] for r in table.select("i", detect_language(F.col("path"), F.col("content")).alias("v")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}


def test_strings_of_binaries_equal_a_plain_scan(spark, tmp_path):
    import random
    import re

    from qvault.sources import binaries

    rnd = random.Random(4)
    contents = {f"f{i}.bin": b"".join(rnd.choice([b"\x00\xff", b"abc/def=", b"x" * rnd.randrange(1, 40), b" ", "é".encode(), b"MD5_Init\x01", b"Zq8Lw2Rt9Xc5Vb1Nm7Kj4\n"]) for _ in range(rnd.randrange(0, 60))) for i in range(12)}
    contents |= {"long.bin": b"y" * 1000, "empty.bin": b"", "edge.bin": b"abcdef\x00ghijkl", "big.bin": b"z" * 5000}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    files = binaries.read_binaries(spark, str(tmp_path), limit=4000)
    for chunk in (7, 64, 1 << 20):
        got = {}
        for r in sorted(binaries.printable_strings(files, chunk=chunk).collect(), key=lambda r: (r["at"], r["place"])):
            got.setdefault(r["file"].rsplit("/", 1)[-1], []).append(r["text"].encode())
        want = {n: re.findall(rb"[A-Za-z0-9_\-.:/=+%$@]{6,}", c) for n, c in contents.items() if n != "big.bin"}
        assert got == {n: s for n, s in want.items() if s}
    found = {(r["file"].rsplit("/", 1)[-1], r["rule_id"]): r for r in binaries.binary_signatures(files, chunk=7).collect()}
    for n, strings in want.items():
        first = [i + 1 for i, s in enumerate(strings) if b"MD5_Init" in s and re.search(rb"\bMD5_Init\b", s)]
        assert [found[n, "symbol-md5"]["line"]] == first[:1] if first else (n, "symbol-md5") not in found
    assert found["big.bin", "binary-size-exceeded"]["evidence"] == "File size: 5000 bytes"


def test_many_chunks_of_one_file_take_time_by_its_size(spark, tmp_path):
    """A chunk takes its own bytes: 65,536 chunks of one content are not as many copies of it."""
    import time

    from qvault.sources import binaries

    (tmp_path / "f.bin").write_bytes(b"abcdefg\n" * (1 << 19))
    files = binaries.read_binaries(spark, str(tmp_path))
    start = time.monotonic()
    assert binaries.byte_chunks(files, 64).agg(F.count("*"), F.sum(F.length("bytes"))).first() == (65536, 1 << 22)
    assert time.monotonic() - start < 10


def test_findings_written_as_text_are_compressed(spark, tmp_path):
    from qvault.sources import files

    rows = spark.createDataFrame([(i, "src/a.py", "RSA-2048") for i in range(3)], "scan_id long, file string, algorithm string")
    files.write_findings(rows, str(tmp_path / "f"))
    assert {p.suffix for p in (tmp_path / "f").glob("part-*")} == {".gz"}
    assert files.read_findings(spark, str(tmp_path / "f")).select(rows.columns).orderBy("scan_id").collect() == rows.collect()


def test_strings_of_all_documents(spark, duck, tmp_path):
    """Documents without a source, and with one that is no name of a folder, count as all others do."""
    from oracle_helpers import rows_of, rows_of_sql
    from qvault.plans.all_queries import ORACLES, QUERIES

    rows = [(0, "alpha-string beta", None), (1, None, None), (2, "in-the-empty-source", ""), (3, "x" * 700 + " short", "a/b:c d%41"), (4, "alpha-string", "web"), (5, "other-text " * 300, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = QUERIES["p17_file_strings"](spark, str(tmp_path))
    assert {r["source"]: r["strings"] for r in found.collect()} == {None: 304, "": 2, "a/b:c d%41": 1, "web": 2}
    assert rows_of(found) == rows_of_sql(con, ORACLES["p17_file_strings"])
