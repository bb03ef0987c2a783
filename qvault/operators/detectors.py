"""Detectors over the lines of source files: each takes lines (repo_id, file, line, text) and gives rows per hit.

Rules are data. A line is tested against all rules of a detector in one narrow
expression, an array of matches that is filtered and exploded; lines are never
joined to rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qvault.functions import text as ft
from qvault.functions.inference import is_known_algorithm
from qvault.functions.languages import detect_language
from qvault.operators import rules
from qvault.operators.blocks import assigned_name, with_blocks
from qvault.operators.running import running_totals
from qvault.storage import materialize

#: Rules by detector, as (rule, severity, pattern).
RULES: dict[str, list[tuple[str, str, str]]] = {
    "p6_tls_disabled": rules.TLS_DISABLED,
    "p7_key_custody": rules.KEY_CUSTODY,
}
COMMENT = r"^\s*(//|#[^!]|\*|--\s|<!--)"
#: A name that a literal in any quotes is assigned to; possessive, so that a long line takes no stack.
ASSIGNMENT = r"[A-Za-z_$][A-Za-z0-9_$]*+[ \t]*[:=][ \t]*(?:[brufBRUF]{1,2})?(?:\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`)"
#: A whole line that gives a variable of the environment a bare value.
BARE_ASSIGNMENT = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)=([^\s\"'`=(){};][^\s\"'`(){};]*)(?:\s+#.*)?$"
#: A key of a configuration line, bare or in quotes, perhaps after the brace of an object, and what follows it.
CONFIG_LINE = r"^[\s{]*(?:ENV\s+|ARG\s+|export\s+)?(?:[\"']([A-Za-z0-9_.-]+)[\"']|([A-Za-z_][A-Za-z0-9_.-]*))\s*[=:]\s*(\S.*)$"
CODE_COMMENT = r"^\s*(//|#|/\*|\*)"
TERRAFORM = r"^[ \t]*([A-Za-z0-9_-]+)[ \t]*=[ \t]*\"([^\"$][^\"]*)\""


def scan_patterns(lines: DataFrame, rules: Sequence[tuple[str, str, str]], *, first_only: bool = False, skip_comments: bool = True) -> DataFrame:
    """Lines by the rules that they match, or by the first such rule."""
    hit = lambda r: F.when(F.col("text").rlike(r[2]), F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("severity")))
    hits = F.array_compact(F.array(*map(hit, rules)))
    rows = lines.where(~F.col("text").rlike(COMMENT)) if skip_comments else lines
    return rows.select("repo_id", "file", "line", F.explode(F.slice(hits, 1, 1) if first_only else hits).alias("hit")).select("repo_id", "file", "line", "hit.*")


def rule_scan(lines: DataFrame, table: Sequence[tuple] = rules.LANGUAGE_RULES) -> DataFrame:
    """Lines (repo_id, file, line, language, text) by the rules of their language (see rules.LANGUAGE_RULES), comments left out."""
    names = ("rule_id", "algorithm", "category", "severity", "quantum_risk", "specificity")
    hit = lambda r: F.when((F.col("language") == r[0]) & F.col("text").rlike("(?i)" + r[7]), F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r[1:7], strict=True)]))
    code = lines.where(F.col("language").isin(*{r[0] for r in table}) & ~F.col("text").rlike(r"^\s*(//|#|/\*|\*)"))
    return code.select("repo_id", "file", "line", "language", F.explode(F.array_compact(F.array(*map(hit, table)))).alias("hit")).select("repo_id", "file", "line", "language", "hit.*")


def weak_directives(lines: DataFrame, table: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Configuration directives whose value holds something weak: (rule, severity, directive with its value, weak part) per row of ``table``."""

    def hit(r: tuple) -> Column:
        value = F.trim(F.regexp_extract("text", r[2], 1))
        return F.when((value != "") & value.rlike(r[3]), F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("severity")))

    rows = lines.where(~F.col("text").rlike(r"^\s*#"))
    return rows.select("repo_id", "file", "line", F.explode(F.array_compact(F.array(*map(hit, table)))).alias("hit")).select("repo_id", "file", "line", "hit.*")


def weak_factories(lines: DataFrame) -> DataFrame:
    """Factory calls that name a weak algorithm, with the name, its severity and what to use instead."""

    def hit(r: tuple) -> Column:
        name = F.upper(F.regexp_extract("text", r[1], 1))
        severity = F.when(name.contains("MD5") | (F.lit(r[0]) == "java-cipher-weak"), "Critical").otherwise("High")
        return F.when(F.col("text").rlike(r[1]), F.struct(F.lit(r[0]).alias("rule_id"), severity.alias("severity"), name.alias("algorithm"), F.lit(f"Use {r[2]}").alias("recommendation")))

    rows = lines.where(~F.col("text").rlike(r"^\s*(//|\*|#)"))
    return rows.select("repo_id", "file", "line", F.explode(F.array_compact(F.array(*map(hit, rules.FACTORIES)))).alias("hit")).select("repo_id", "file", "line", "hit.*")


def container_findings(lines: DataFrame) -> DataFrame:
    """Base images and service images out of support, and installed packages of cryptography."""
    any_of = lambda text, parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.lower(text).contains(p))
    base, image = F.regexp_extract("text", r"(?i)^\s*FROM\s+([^\s#]+)", 1), F.regexp_extract("text", r"(?i)^\s*image\s*:\s*[\"']?([^\s\"']+)[\"']?", 1)
    installed = F.regexp_extract("text", r"(?i)^\s*RUN\s+.*(?:apt-get|apt|pip|pip3|npm|apk|yum)\s+install\s+([^\n#&;]+)", 1)
    names = F.transform(F.filter(F.split(F.trim(installed), r"\s+"), lambda p: (p != "") & ~p.startswith("-")), lambda p: F.lower(F.split(p, "==|>=|=")[0]))
    severity = F.create_map(*[F.lit(x) for k, v in rules.PACKAGES.items() for x in (k, v[0])])
    risk = F.create_map(*[F.lit(x) for k, v in rules.PACKAGES.items() for x in (k, v[1])])
    row = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("rule_id", "name", "severity", "quantum_risk"), strict=True)])
    known = F.transform(F.filter(names, lambda p: p.isin(*rules.PACKAGES)), lambda p: row(F.concat(F.lit("container-crypto-pkg-"), p), p, severity[p], risk[p]))
    images = F.array(
        F.when(any_of(base, rules.LEGACY_BASES), row(F.lit("container-legacy-base-image"), base, F.lit("High"), F.lit("Classical Risk"))),
        F.when(any_of(image, rules.LEGACY_SERVICES), row(F.lit("container-compose-legacy-image"), image, F.lit("Medium"), F.lit("Classical Risk"))),
    )
    rows = lines.where(~F.col("text").rlike(r"^\s*#"))
    return rows.select("repo_id", "file", "line", F.explode(F.concat(F.array_compact(images), known)).alias("hit")).select("repo_id", "file", "line", "hit.*")


def binary_findings(lines: DataFrame) -> DataFrame:
    """The first line per file of each name in binaries, and strings of high entropy, each by its first eight characters."""
    named = first_per_file(scan_patterns(lines, rules.BINARY_NAMES, skip_comments=False)).withColumn("evidence", F.lit(None).cast("string"))
    each = lines.select("repo_id", "file", "line", F.explode(F.regexp_extract_all("text", F.lit(rules.PRINTABLE), F.lit(0))).alias("s"))
    dense = each.where((F.length("s") >= rules.BINARY_LENGTH) & ~F.col("s").startswith("http") & ~F.col("s").startswith("/")).where(ft.shannon_entropy(F.col("s")) >= rules.BINARY_ENTROPY)
    secrets = dense.groupBy("repo_id", "file", F.substring("s", 1, 8).alias("evidence")).agg(F.min("line").alias("line"))
    return named.unionByName(secrets.select("repo_id", "file", F.lit("binary-high-entropy-secret").alias("rule_id"), F.lit("High").alias("severity"), "line", "evidence"))


def pem_blocks(lines: DataFrame) -> DataFrame:
    """PEM blocks with their kind, first and last line; a private key is encrypted if its block says so."""
    w = Window.partitionBy("repo_id", "file").orderBy("line")
    begins = F.regexp_extract("text", "-----BEGIN ([A-Z0-9 ]+)-----", 1)
    numbered = lines.withColumn("kind", begins).withColumn("block", F.sum((F.col("kind") != "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("block > 0")
    ended = F.min(F.when(F.col("text").contains("-----END "), F.col("line"))).over(Window.partitionBy("repo_id", "file", "block"))
    inside = numbered.withColumn("until", ended).where("until is not null and line <= until")
    blocks = inside.groupBy("repo_id", "file", "block").agg(F.max("kind").alias("kind"), F.min("line").alias("line"), F.max("until").alias("last_line"), F.bool_or(F.col("text").contains("ENCRYPTED")).alias("encrypted"))
    private = F.col("kind").endswith("PRIVATE KEY")
    severity = F.when(private & ~F.col("encrypted"), "Critical").when(private, "Low").otherwise("Informational")
    return blocks.select("repo_id", "file", "line", "last_line", "kind", "encrypted", severity.alias("severity"))


def holds_any(texts: Sequence[str]) -> Column:
    """Whether a line holds one of ``texts`` as it is: most lines don't, and are spared a pattern that needs one."""
    found = F.lit(False)
    for x in texts:
        found = found | F.col("text").contains(x)
    return found


def call_sites(lines: DataFrame, named: Sequence[str] | None = None) -> DataFrame:
    """Every call on a line: its name and the text of its arguments; comments left out.

    With ``named``, lines that hold none of these names are left out, too.
    """
    # A match begins where letters and digits do and gives nothing back, so a long word is read once.
    pattern = r"(?<![\w$])[0-9]*+([A-Za-z_$][\w$]*+(?:(?:\.|::)[A-Za-z_$][\w$]*+)*+)\s*+\(([^()]*+)\)"
    names, args = F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
    able = holds_any(["("]) & holds_any([")"])
    rows = lines.where((able if named is None else able & holds_any(named)) & ~F.col("text").rlike(r"^\s*(//|#|/\*|\*)"))
    return rows.select("repo_id", "file", "line", F.explode(F.arrays_zip(names.alias("name"), args.alias("args"))).alias("c")).select("repo_id", "file", "line", "c.name", "c.args")


def crypto_call_sites(lines: DataFrame, table: Sequence[tuple] = rules.CALL_RULES) -> DataFrame:
    """Calls that a rule names (see rules.CALL_RULES), and comparisons of secrets that stop at the first difference."""

    def hit(r: tuple) -> Column:
        named = F.lit(False)
        for n in r[3]:
            named = named | (F.col("name") == n) | F.col("name").endswith("." + n)
        held = F.lit(True) if r[4] is None else F.col("args").rlike(r[4])
        return F.when(named & held, F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("severity"), F.lit(r[2]).alias("category")))

    known = sorted({n for r in table for n in r[3]})
    calls = call_sites(lines, known).select("repo_id", "file", "line", "name", F.explode(F.array_compact(F.array(*map(hit, table)))).alias("hit")).select("repo_id", "file", "line", "name", "hit.*")
    calls, _ = materialize(calls, "calls")  # few of all lines, and asked for more than once
    calls = calls.where(~needs_context(F.col("rule_id"), F.col("name"))).unionByName(secret_randoms(lines, calls))
    compared = lines.where(holds_any(["==", "!="]) & F.col("text").rlike(rules.COMPARISON) & ~F.col("text").rlike(r"^\s*(//|#|/\*|\*)"))
    of = {"name": "==", "rule_id": "timing-unsafe-comparison", "severity": "High", "category": "comparison"}
    return calls.unionByName(compared.select("repo_id", "file", "line", *[F.lit(v).alias(k) for k, v in of.items()]))


def needs_context(rule: Column, name: Column) -> Column:
    """Whether a call matters only where a secret is made: this generator draws for anything else, too."""
    return (rule == "weak-random") & (name == "Math.random")


def secret_randoms(lines: DataFrame, calls: DataFrame) -> DataFrame:
    """The calls of a weak generator whose line assigns to a name like a secret's, or that are inside a function with such a name.

    Only files with such a call are looked at for their functions. Their names
    are written, so that Spark knows whether they are few: then no other line
    moves.
    """
    asked = calls.where(needs_context(F.col("rule_id"), F.col("name"))).distinct()
    files, _ = materialize(asked.select("repo_id", "file").distinct(), "files")
    around = with_blocks(lines.join(files, ["repo_id", "file"], "left_semi"))
    secret = F.coalesce(ft.names_secret(assigned_name(F.col("text"))), F.lit(False)) | F.coalesce(ft.names_secret(F.col("function")), F.lit(False))
    return asked.join(around.where(secret).select("repo_id", "file", "line").distinct(), ["repo_id", "file", "line"], "left_semi").select(calls.columns)


class Adapters:
    """Detectors by language: functions from lines to hits, of which each language may have several."""

    def __init__(self):
        self.by_language: dict[str, list] = {}

    def register(self, language: str, detector) -> None:
        self.by_language.setdefault(language.lower(), []).append(detector)

    def languages(self) -> list[str]:
        return sorted(self.by_language)

    def run(self, lines: DataFrame) -> DataFrame:
        """The hits of every detector on the lines (with language) of its language, told apart by language."""
        found = [f(lines.where(F.lower("language") == k)).select("repo_id", "file", "line", "rule_id", "severity", F.lit(k).alias("language")) for k, fs in sorted(self.by_language.items()) for f in fs]
        if not found:
            raise ValueError("no detector is registered")
        out = found[0]
        for one in found[1:]:
            out = out.unionByName(one)
        return out


def first_per_file(hits: DataFrame) -> DataFrame:
    """The first hit of each rule in each file."""
    return hits.groupBy("repo_id", "file", "rule_id", "severity").agg(F.min("line").alias("line"))


def extract_assignments(lines: DataFrame) -> DataFrame:
    """Literal assignments: every name = "value" or name: 'value' on a line, in any of three quotes, and whole lines NAME=value without any; comments left out."""
    text = F.col("text")
    quoted = F.when(text.rlike("[:=][ \\t]*[brufBRUF]{0,2}[\"'`]"), F.regexp_extract_all(text, F.lit(ASSIGNMENT), F.lit(0)))
    literal = lambda m: F.replace(F.replace(F.regexp_extract(m, "^[^\"'`]*[\"'`](?s)(.*).$", 1), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    pair = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    each = F.transform(quoted, lambda m: pair(F.regexp_extract(m, "^[A-Za-z0-9_$]+", 0), literal(m)))
    bare = F.when(text.rlike(BARE_ASSIGNMENT), F.array(pair(F.regexp_extract(text, BARE_ASSIGNMENT, 1), F.regexp_extract(text, BARE_ASSIGNMENT, 2))))
    rows = lines.where(text.rlike("[:=]") & ~text.rlike(CODE_COMMENT))
    return rows.select("repo_id", "file", "line", F.explode(F.coalesce(bare, each)).alias("x")).select("repo_id", "file", "line", "x.name", "x.value")


def extract_config_kv(lines: DataFrame) -> DataFrame:
    """Keys and values of configuration lines, also of objects and in quotes; values without quotes, commas, closing braces and comments behind."""
    text, marks = F.col("text"), F.lit(",\"'")
    part = lambda i: F.regexp_extract(text, CONFIG_LINE, i)
    raw = F.trim(part(3))
    bare = F.trim(F.when(raw.rlike("^[\"']"), raw).otherwise(F.regexp_replace(raw, r"\s+#.*$", "")), marks)
    value = F.when(bare.endswith("}") & ~bare.startswith("${") & ~bare.startswith("{{"), F.trim(F.rtrim(bare, F.lit("} ")), marks)).otherwise(bare)
    rows = lines.where(text.rlike("[:=]") & ~text.rlike(r"^\s*(#|//)")).where(text.rlike(CONFIG_LINE))
    return rows.select("repo_id", "file", "line", F.concat(part(1), part(2)).alias("name"), value.alias("value"))


def terraform_secrets(lines: DataFrame) -> DataFrame:
    """Attributes that are named like a secret and given a literal of 6 characters or more; references to variables are none."""
    name, value = F.regexp_extract("text", TERRAFORM, 1), F.trim(F.regexp_extract("text", TERRAFORM, 2))
    rows = lines.where(F.col("text").rlike(TERRAFORM)).select("repo_id", "file", "line", name.alias("name"), value.alias("value"))
    held = rows.where((F.length("value") >= 6) & ~F.col("value").rlike(r"^(var|local|data)\.") & ft.names_secret(F.col("name")))
    return held.select("repo_id", "file", "line", "name", F.lit("tf-secret").alias("rule_id"), F.lit("High").alias("severity"))


def plaintext_secrets(pairs: DataFrame) -> DataFrame:
    """Pairs whose name means a secret and whose value is long enough, no placeholder and no algorithm's name."""
    return pairs.where(ft.names_secret(F.col("name")) & ~ft.is_placeholder(F.col("value"), config=True) & ~is_known_algorithm(F.col("value")) & (F.length("value") >= 4))


def entropy_secrets(pairs: DataFrame) -> DataFrame:
    """Pairs that look secret by entropy, by name, or both; the confidence tells which."""
    pairs = pairs.where(~ft.is_false_positive(F.col("value"), F.col("name"))).withColumn("entropy", F.round(ft.shannon_entropy(F.col("value")), 6))
    dense, named = (F.col("entropy") >= 4.0) & (F.length("value") >= 16), ft.names_secret(F.col("name")) & (F.length("value") >= 8)
    kind = F.when(dense & named, "high-confidence").when(dense, "high-entropy-only").when(named, "name-hint-only")
    return pairs.withColumn("kind", kind).where("kind is not null")


def carry_state(lines: DataFrame, marker: Column, name: str = "state") -> DataFrame:
    """Lines with the last marker seen above them in their file."""
    w = Window.partitionBy("repo_id", "file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(marker, ignorenulls=True).over(w))


def k8s_secrets(lines: DataFrame) -> DataFrame:
    """Entries of the sections data and stringData of Secret documents in YAML, with whether the section holds base64.

    The kind above a line decides, then the section above it, which a key
    without indent ends. Values shorter than 4 characters (of data, when
    decoded) and those that stand for others are none.
    """
    text, bare = F.col("text"), F.trim(F.col("text"))
    kind = F.when(bare == "---", "none").when(bare.rlike(r"(?i)^kind\s*:\s*[A-Za-z0-9]"), F.when(bare.rlike(r"(?i)^kind\s*:\s*Secret\b"), "Secret").otherwise("other"))
    stated = carry_state(lines, kind, "kind").where(~bare.rlike("^(#|$)"))
    section = F.when(F.col("kind") != "Secret", "none").when(bare.rlike(r"^stringData\s*:\s*$"), "stringData").when(bare.rlike(r"^data\s*:\s*$"), "data").when(~text.rlike(r"^\s") & bare.contains(":") & ~bare.rlike(r"^(stringData|data|(?i:kind\s*:))"), "none")
    inside = carry_state(stated, section, "section").where(F.col("section").isin("data", "stringData") & ~bare.rlike(r"^(stringData|data)\s*:\s*$") & ~bare.rlike(r"(?i)^kind\s*:") & bare.contains(":"))
    value = F.trim(F.trim(F.regexp_extract(bare, "^[^:]*:(.*)$", 1)), F.lit("\"'"))
    pairs = inside.select("repo_id", "file", "line", F.trim(F.split(bare, ":")[0]).alias("name"), value.alias("value"), "section").where(~F.col("value").rlike(r"^($|<|\$\{)") & (F.length("value") >= 4))
    decoded = F.trim(F.replace(F.make_valid_utf8(F.try_to_binary("value", F.lit("base64")).cast("string")), F.lit("\ufffd"), F.lit("")))
    held = (F.col("section") == "stringData") | (F.length(decoded) >= 4)
    return pairs.where(held).select("repo_id", "file", "line", "name", (F.col("section") == "data").alias("is_base64"))


# How sure a value of each class is, and numbers of cards that are made for tests.
VALUE_CONFIDENCE = {"AADHAAR": 0.95, "PAN": 0.95, "PAYMENT_CARD": 0.9}
TEST_CARDS = ["4111111111111111", "4012888888881881", "4242424242424242", "5555555555554444", "5105105105105100", "378282246310005", "371449635398431"]


def detect_values(lines: DataFrame, classes: Sequence[str] = ("AADHAAR", "PAN", "PAYMENT_CARD"), cap: int | None = None) -> DataFrame:
    """Sensitive values, checked and masked, with how sure their class is and whether a card's number is one for tests; all of them, or the first ``cap`` of each file, as short reports show."""
    # Every class has four digits in a row: other lines need no masks.
    safe = lines.where(F.col("text").rlike("[0-9]{4}")).withColumn("_safe", ft.mask_spans(F.col("text")))
    found = lambda pattern, group: F.regexp_extract_all("_safe", F.lit(pattern), group)
    kinds = {
        "AADHAAR": F.filter(F.transform(found(r"(?<!\d)([2-9]\d{11}|[2-9]\d{3} \d{4} \d{4}|[2-9]\d{3}-\d{4}-\d{4})(?!\d)", 1), lambda x: F.regexp_replace(x, "[ -]", "")), ft.is_verhoeff),
        "PAN": found(r"(?<![A-Za-z0-9])([A-Z]{5}[0-9]{4}[A-Z])(?![A-Za-z0-9])", 1),
        "PAYMENT_CARD": F.filter(found(r"(?<![A-Za-z0-9])(\d{13,19})(?![A-Za-z0-9])", 1), lambda x: ft.is_luhn(x) & ft.has_issuer_prefix(x)),
    }
    named = lambda c: lambda v: F.struct(F.lit(c).alias("data_class"), ft.masked_evidence(v).alias("evidence"), F.lit(VALUE_CONFIDENCE[c]).alias("confidence"), (F.lit(c == "PAYMENT_CARD") & v.isin(*TEST_CARDS)).alias("is_test"))
    each = F.concat(*[F.transform(kinds[c], named(c)) for c in classes])
    hits = safe.select("repo_id", "file", "line", F.posexplode(each).alias("k", "v")).select("repo_id", "file", "line", "k", "v.*")
    if cap is None:
        return hits.drop("k")
    w = Window.partitionBy("repo_id", "file").orderBy("line", "k")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n", "k")


# Folders and files that are not searched for values, and the size beyond which files are not.
SKIPPED_FOLDER = r"(?i)(^|/)(node_modules|vendor|dist|build|coverage|\.git|\.next|target|__pycache__)(/|$)"
LOCK_FILE = r"(?i)(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|[^/]+\.lock)$"
MAX_FILE_BYTES = 1 << 20


def skip_reason(path: Column, content: Column) -> Column:
    """Why a file is not searched, null if it is."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(content.isNull(), "no text").when(path.rlike(SKIPPED_FOLDER), "dependency or build folder").when(path.rlike(LOCK_FILE), "lock file").when(F.octet_length(content) > MAX_FILE_BYTES, "too large")


def scan_coverage(files: DataFrame) -> DataFrame:
    """Per repository how many files (repo_id, path, content) are searched, and how many are skipped for which reason, one row a reason; a null reason is of those searched."""
    return files.groupBy("repo_id", skip_reason(F.col("path"), F.col("content")).alias("reason")).agg(F.count("*").alias("files"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).alias("bytes"))


def pii_stats(values: DataFrame) -> DataFrame:
    return values.groupBy("repo_id", "data_class").agg(F.count("*").alias("values"), F.count_distinct("file").alias("files"))


# Names of sensitive fields by class in the order that decides, words around a field that tell of payments and of taxes,
# beginnings of names and types that tell booleans and enumerations, and how sure a name, a name with a fitting type, and a weak one are.
FIELD_NAMES = {
    "PAN": ["pan", "pan_number", "permanent_account"],
    "PAYMENT_CARD": ["card_number", "cc_num", "cvv", "expiry", "card_holder", "primary_account_number", "credit_card_number", "debit_card_number"],
    "AADHAAR": ["aadhaar", "aadhar", "adhaar", "uid", "uidai"],
    "HEALTH": ["diagnosis", "icd", "patient", "prescription", "medical_record", "abha", "blood_group"],
    "PII_OTHER": ["phone", "mobile", "email", "dob", "date_of_birth", "address"],
}
TAX_NAMES = ["pan_number", "permanent_account"]
PAYMENT_CUES = ["payment", "payments", "credit", "debit", "cc", "cc_num", "cvv", "expiry", "expiration", "issuer", "billing", "merchant", "card_holder", "primary_account_number"]
TAX_CUES = ["income_tax", "taxpayer", "tax_id", "tax", "permanent_account", "pan_number"]
WEAK_BEGINNINGS = ["has", "is", "was", "can", "should", "enabled", "valid", "verified"]
WEAK_TYPES = ["bool", "boolean", "enum", "choice", "yesno", "flag"]
NAME_ONLY, NAME_AND_TYPE, WEAK_NAME = 0.68, 0.9, 0.35
#: Forms in which a field is declared, the first that fits counts: (form, pattern with the name, the type and the length if it has them).
FIELD_FORMS = [
    ("column", r"(?i)^\s*[\"`]?([a-z_]\w*)[\"`]?\s+(varchar|char|text|bigint|integer|int|numeric|boolean|bool|enum|date)\b(?:\s*\(\s*(\d+))?"),
    ("model", r"(?i)^\s*([a-z_]\w*)\s*=\s*(?:models\.|db\.|sa\.)?(\w*field|column)\s*\((?:[^)]*?(?:max_length\s*=\s*|string\()(\d+))?"),
    ("schema", r"(?i)^\s*([a-z_]\w*)\s+(string|int|bigint|boolean|datetime)\b()"),
    ("object", r"(?i)^\s*[\"']?([a-z_]\w*)[\"']?\s*:\s*(?:(string|number|boolean|bigint)\b)?()"),
    ("variable", r"(?i)^\s*(?:let\s+|const\s+|var\s+|final\s+)?([a-z_]\w*)\s*=[^=]()()"),
]


def declared_fields(lines: DataFrame) -> DataFrame:
    """Fields that lines declare: form, name, type and length, from tables, models, schemas, objects and variables."""
    told = lambda r: F.when(F.col("text").rlike(r[1]), F.struct(F.lit(r[0]).alias("form"), *[F.regexp_extract("text", r[1], i).alias(n) for i, n in ((1, "name"), (2, "type"), (3, "length"))]))
    found = lines.withColumn("d", F.coalesce(*map(told, FIELD_FORMS))).where("d is not null")
    return found.select("repo_id", "file", "line", "d.form", "d.name", F.lower("d.type").alias("type"), F.col("d.length").try_cast("int").alias("length"))


#: Parameters between parentheses, and one of them with its name, also before a colon or after a type.
PARAMETERS, PARAMETER = r"\(([^()]*)\)", r"(?:^|\s)([A-Za-z_$][\w$-]*)\s*(?:\??\s*:.*)?$"
#: Definitions of columns that a line with CREATE TABLE holds itself.
INLINE_TABLE = r"(?i)\bCREATE\s+TABLE\s+[^(]*\((.*)$"


def scoped_fields(lines: DataFrame) -> DataFrame:
    """Fields that lines declare, with the table or class around them: form, name, type, length, table and the line as context.

    Besides the forms of whole lines, parameters of functions and methods count,
    and columns on the line of their CREATE TABLE.
    """
    around = with_blocks(lines.where(F.col("text").isNotNull()))
    held = F.regexp_extract("text", INLINE_TABLE, 1)
    # The table's own parenthesis, where this line closes it, holds no column.
    held = F.when(F.length(F.replace(held, F.lit(")"), F.lit(""))) < F.length(F.replace(held, F.lit("("), F.lit(""))), F.regexp_replace(held, r"\)[^)]*$", "")).otherwise(held)
    columns = F.transform(F.filter(F.split(held, r",(?![^(]*\))"), lambda c: F.trim(c) != ""), F.trim)
    own = around.where(F.col("text").rlike(INLINE_TABLE)).select("repo_id", "file", "line", "table", F.col("text").alias("context"), F.explode(columns).alias("text"))
    rows = around.where(~F.col("text").rlike(INLINE_TABLE)).select("repo_id", "file", "line", "table", F.col("text").alias("context"), "text").unionByName(own)
    rows = rows.where(~F.col("text").rlike(r"^\s*(//|#|--|/\*|\*|$)") & ~F.col("text").rlike(r"(?i)^\s*(constraint|primary|foreign|unique|check|index|key|create|class|model)\b"))
    told = lambda r: F.when(F.col("text").rlike(r[1]), F.struct(F.lit(r[0]).alias("form"), *[F.regexp_extract(F.col("text"), r[1], i).alias(n) for i, n in ((1, "name"), (2, "type"), (3, "length"))]))
    whole = rows.withColumn("d", F.coalesce(*map(told, FIELD_FORMS))).where("d is not null")
    groups = F.regexp_extract_all("text", F.lit(PARAMETERS), F.lit(1))
    named = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.regexp_extract(F.trim(F.split(x, "=")[0]), PARAMETER, 1))
    typed = F.struct(F.lit("parameter").alias("form"), F.col("p").alias("name"), F.lit("").alias("type"), F.lit("").alias("length"))
    given = around.where(F.col("text").rlike(PARAMETERS) & ~F.col("text").rlike(r"^\s*(//|#|--|/\*|\*)") & ~F.col("text").rlike(INLINE_TABLE)).select("repo_id", "file", "line", "table", F.col("text").alias("context"), F.explode(named).alias("p"))
    given = given.where("p <> ''").withColumn("d", typed)
    kept = ["repo_id", "file", "line", "table", "context", "d"]
    both = whole.select(kept).unionByName(given.select(kept))
    return both.select("repo_id", "file", "line", "table", "context", "d.form", "d.name", F.lower("d.type").alias("type"), F.col("d.length").try_cast("int").alias("length"))


def _phrases(words: Column, phrases: Sequence[str]) -> Column:
    """Whether words between blanks hold one of the phrases as whole words."""
    return F.exists(F.array(*[F.lit(f" {p.replace('_', ' ')} ") for p in phrases]), lambda p: words.contains(p))


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _spaced(name: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(ft.identifier_tokens(name), " "), F.lit(" "))


def detect_names(fields: DataFrame) -> DataFrame:
    """Fields (name, and type, length, table, context and file if known) that are sensitive by name: the words of the identifier hold a phrase of the class.

    A bare account number (``pan``) among payments, by its line, table and file,
    is one of a card, unless something there tells of taxes. A type that fits
    the class makes a name surer; a boolean or an enumeration, by type or by
    the beginning of the name, makes it weak.
    """
    known = lambda c: F.col(c) if c in fields.columns else F.lit(None)
    kind, length = F.coalesce(known("type").cast("string"), F.lit("")), known("length").cast("int")
    def named_class(words: Column) -> Column:
        of = F.lit(None).cast("string")
        for name, phrases in reversed(FIELD_NAMES.items()):
            of = F.when(_phrases(words, phrases), name).otherwise(of)
        return of

    def among_payments(words: Column) -> Column:
        around = _spaced(F.concat_ws(" ", known("context"), known("table"), known("file")))
        return ~_phrases(words, TAX_NAMES) & _once(around, lambda a: ~_phrases(a, TAX_CUES) & _phrases(a, PAYMENT_CUES))

    def decided(words: Column) -> Column:
        if "table" not in fields.columns:
            return named_class(words)
        return _once(named_class(words), lambda of: F.when((of == "PAN") & among_payments(words), "PAYMENT_CARD").otherwise(of))

    named = fields.withColumn("data_class", _once(_spaced(F.col("name")), decided)).where("data_class is not null")
    c = F.col("data_class")

    def fitting(words: Column) -> Column:
        fits = ((c == "AADHAAR") & ((length == 12) | (kind == "bigint"))) | ((c == "PAN") & (length == 10)) | ((c == "PAYMENT_CARD") & length.between(13, 19))
        return fits | ((c == "PII_OTHER") & ((_phrases(words, ["dob", "date_of_birth"]) & kind.rlike("^(date|datetime|timestamp)")) | (_phrases(words, ["phone", "mobile"]) & length.between(7, 20))))

    fits = _once(_spaced(F.col("name")), fitting)
    weak = F.exists(F.array(*map(F.lit, WEAK_TYPES)), lambda w: kind.contains(w)) | F.get(ft.identifier_tokens(F.col("name")), F.lit(0)).isin(*WEAK_BEGINNINGS)
    return named.withColumn("confidence", F.when(weak, WEAK_NAME).when(F.coalesce(fits, F.lit(False)), NAME_AND_TYPE).otherwise(NAME_ONLY))


# Keywords of each class of data, in the order that decides.
SENSITIVE_WORDS = {
    "HEALTH": ["health", "hipaa", "patient", "medical", "diagnosis", "ehr", "prescription"],
    "PII": ["ssn", "social_security", "dob", "birthdate", "passport", "national_id", "email", "phone", "user_address"],
    "FINANCIAL": ["credit_card", "card_number", "cvv", "iban", "bank_account", "pan", "payment_token", "billing"],
    "AUTH": ["password", "passwd", "auth_token", "api_key", "jwt", "secret_key", "session_id"],
}


def data_sensitivity(text: Column) -> Column:
    """The first class of which a keyword occurs, else GENERAL."""
    low = F.lower(text)
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    return F.coalesce(*[F.when(hit(ws), k) for k, ws in SENSITIVE_WORDS.items()], F.lit("GENERAL"))


#: Statements of retention, each with an amount, and a unit unless the third part gives it.
RETENTION = [
    (r"(?i)\bretain(?:ed)?\s+(?:for\s+)?(\d+)\s*(year|month|day)s?\b", None),
    (r"(?i)\bretention[_\s]days?\s*[:=]\s*(\d+)\b", "day"),
    (r"(?i)\bretention[_\s](?:period[_\s])?months?\s*[:=]\s*(\d+)\b", "month"),
    (r"(?i)\bretention[_\s](?:period[_\s])?years?\s*[:=]\s*(\d+)\b", "year"),
    (r"(?i)\bttl\s*[:=]\s*(\d+)\b", ""),
    (r"(?i)\bexpir(?:es?|y|ation)[_\s](?:after[_\s])?days?\s*[:=]\s*(\d+)\b", "day"),
    (r"(?i)\bexpir(?:es?|y|ation)[_\s](?:after[_\s])?months?\s*[:=]\s*(\d+)\b", "month"),
    (r"(?i)\bexpir(?:es?|y|ation)[_\s](?:after[_\s])?years?\s*[:=]\s*(\d+)\b", "year"),
    (r"(?i)\binterval\s+['\"]?(\d+)\s*(year|month|day)s?\b", None),
]


def retention_statements(lines: DataFrame) -> DataFrame:
    """Stated retention periods, in years: one row per statement on a line. A bare number means days, or seconds if it is large."""

    def stated(pattern: str, unit: str | None) -> Column:
        amounts = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        units = F.regexp_extract_all("text", F.lit(pattern), F.lit(2)) if unit is None else F.transform(amounts, lambda x: F.lit(unit))
        return F.arrays_zip(amounts.alias("amount"), units.alias("unit"))

    found = lines.select("repo_id", "file", "line", F.explode(F.concat(*[stated(*r) for r in RETENTION])).alias("s"))
    years = ft.to_years(F.col("s.amount").try_cast("double"), F.lower("s.unit"))
    return found.where(F.col("s.amount").try_cast("double") > 0).select("repo_id", "file", "line", years.alias("years"))


def within_lines(left: DataFrame, right: DataFrame, near: int, at: str = "_l") -> DataFrame:
    """Rows of ``left`` and ``right`` (line as ``at``) of one file whose lines are ``near`` or less apart.

    Lines fall into bands of near + 1; a row meets those of its own band and
    the two beside it by equality, so a large file is not joined with itself.
    """
    band = lambda c: F.floor(F.col(c) / (near + 1))
    placed = left.withColumn("_band", F.explode(F.sequence(band("line") - 1, band("line") + 1)))
    return placed.join(right.withColumn("_band", band(at)), ["repo_id", "file", "_band"]).where(F.abs(F.col("line") - F.col(at)) <= near).drop("_band")


def assign_retention(fields: DataFrame, statements: DataFrame, default_years: float = 7.0, near: int = 5) -> DataFrame:
    """Fields with the longest statement within ``near`` lines, else the longest of the repository, else the default."""
    close = within_lines(fields, statements.select("repo_id", "file", F.col("line").alias("_l"), "years"), near)
    local = close.groupBy("repo_id", "file", "line", "name").agg(F.max("years").alias("_near"), F.size(F.collect_set("years")).alias("_stated"))
    wide = statements.groupBy("repo_id").agg(F.max("years").alias("_wide"))
    joined = fields.join(local, ["repo_id", "file", "line", "name"], "left").join(wide, "repo_id", "left")
    source = F.when(F.col("_near").isNotNull(), "stated").when(F.col("_wide").isNotNull(), "repository").otherwise("default")
    return joined.withColumns({"retention_years": F.coalesce("_near", "_wide", F.lit(default_years)), "retention_source": source, "conflict": F.coalesce(F.col("_stated") > 1, F.lit(False))}).drop("_near", "_wide", "_stated")


# Years that data of a class is kept where nothing says so, amounts of time anywhere, keys that name a field and its retention in days, and files that such keys count in.
DEFAULT_YEARS = {"AADHAAR": 5.0, "PAN": 8.0, "PAYMENT_CARD": 5.0, "HEALTH": 7.0, "PII_OTHER": 3.0}
AMOUNT = r"(?i)\b(\d+)\s*(year|month|day)s?\b"
RETENTION_KEY = r"(?i)\b([a-z0-9_]+?)[_.](?:retention[_.]?(?:days?|months?|years?)?|ttl|expir[a-z]*)['\"]?\s*[:=]\s*(\d+)"
CONFIG_FILE = r"(?i)\.(json|yaml|yml|toml|ini|env|conf|config|properties|constants?)\b"


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "_")


def word_runs(text: Column) -> Column:
    """The runs of words inside each identifier of a text, joined by _: of user_phone_no also phone and user_phone."""
    words = lambda t: F.filter(F.split(t, "_"), lambda w: w != "")
    runs = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(i, F.size(w)), lambda j: F.array_join(F.slice(w, i, j - i + 1), "_"))))
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]*[a-z0-9][a-z0-9_]*)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(found, lambda t: F.when(F.size(words(t)) > 0, runs(words(t))).otherwise(F.array().cast("array<string>")))))


def resolve_retention(fields: DataFrame, lines: DataFrame, overrides: DataFrame | None = None, near: int = 5) -> DataFrame:
    """Fields (repo_id, field_id, name, data_class) with retention_years, retention_source and conflict, from the lines of their repository.

    An override of (repo_id, field_id, years) wins. Else the longest of what
    the repository states and of amounts of time within ``near`` lines of a
    mention of the field's name; else a configuration key that names the field,
    the first by file and line, in days; else the default of the class. Only
    lines near an amount are searched for names.
    """
    stated = retention_statements(lines).groupBy("repo_id").agg(F.collect_set("years").alias("_wide"))
    found = lambda i: F.regexp_extract_all("text", F.lit(AMOUNT), F.lit(i))
    amounts = lines.where(F.col("text").rlike(AMOUNT)).select("repo_id", "file", F.col("line").cast("long").alias("_l"), F.explode(F.arrays_zip(found(1).alias("n"), found(2).alias("unit"))).alias("a"))
    amounts = amounts.where(F.col("a.n").try_cast("double") > 0).select("repo_id", "file", "_l", ft.to_years(F.col("a.n").try_cast("double"), F.lower("a.unit")).alias("years"))
    beside = within_lines(lines.select("repo_id", "file", F.col("line").cast("long").alias("line"), "text"), amounts, near)
    mentioned = beside.select("repo_id", F.explode(word_runs(F.col("text"))).alias("_name"), "years").distinct().groupBy("repo_id", "_name").agg(F.collect_set("years").alias("_near"))
    keys = lines.where(F.col("file").rlike(CONFIG_FILE) & F.col("text").rlike(RETENTION_KEY)).select("repo_id", "file", "line", F.lower(F.regexp_extract("text", RETENTION_KEY, 1)).alias("_name"), F.regexp_extract("text", RETENTION_KEY, 2).try_cast("double").alias("n"))
    inferred = keys.where("n > 0").groupBy("repo_id", "_name").agg(F.min_by(ft.to_years(F.col("n"), F.lit("day")), F.struct("file", "line")).alias("_key"))
    rows = fields.withColumn("_name", normal_name(F.col("name"))).join(stated, "repo_id", "left").join(mentioned, ["repo_id", "_name"], "left").join(inferred, ["repo_id", "_name"], "left")
    none = F.array().cast("array<double>")
    rows = rows.join(overrides.select("repo_id", "field_id", F.col("years").alias("_own")), ["repo_id", "field_id"], "left") if overrides is not None else rows.withColumn("_own", F.lit(None).cast("double"))
    every = F.array_union(F.coalesce("_wide", none), F.coalesce("_near", none))
    default = F.create_map(*[F.lit(x) for pair in DEFAULT_YEARS.items() for x in pair])
    years = F.coalesce("_own", F.array_max(every), "_key", default[F.col("data_class")], F.lit(DEFAULT_YEARS["PII_OTHER"]))
    source = F.when(F.col("_own").isNotNull() | (F.size(every) > 0), "stated").when(F.col("_key").isNotNull(), "inferred").otherwise("default")
    conflict = F.col("_own").isNull() & (F.size(every) > 1)
    return rows.select(*fields.columns, years.alias("retention_years"), source.alias("retention_source"), conflict.alias("conflict"))


def backfill_language(findings: DataFrame) -> DataFrame:
    """Findings whose language is null, empty or Unknown get that of their path and content."""
    missing = F.coalesce("language", F.lit("")).isin("", "Unknown")
    return findings.withColumn("language", F.when(missing, detect_language(F.col("path"), F.col("content"))).otherwise(F.col("language")))


def file_manifest(files: DataFrame, *, max_bytes: int, max_total: int, max_files: int) -> DataFrame:
    """Every file with its status, reason, hash and size; limits count in file order per repository.

    A file without content could not be read: its status is ERROR. Running
    sums go over ranges of paths, so a repository may be of any size.
    """
    counted = running_totals(files, ["repo_id"], ["path"], {"_bytes": F.coalesce("size", F.lit(0)), "_files": F.lit(1)})
    reason = (
        F.when(F.col("content").isNull(), "unreadable").when(F.col("_files") >= max_files, "file limit").when(F.col("size") > max_bytes, "too large").when(F.col("_bytes") + F.col("size") > max_total, "total limit").when(F.col("size") == 0, "empty")
    )
    status = F.when(F.col("reason").isNull(), "SCANNED").when(F.col("reason") == "unreadable", "ERROR").otherwise("SKIPPED")
    return counted.withColumn("reason", reason).select("repo_id", "path", "size", status.alias("status"), "reason", F.sha2("content", 256).alias("sha256"))


def parse_suppressions(lines: DataFrame) -> DataFrame:
    """Suppression rules from lines: rule:path:line, rule:path:token, rule:path, path, or a rule or fingerprint alone."""
    clean = F.trim(F.regexp_replace("text", "#.*$", ""))
    parts = F.split(clean, ":")
    n = F.size(parts)
    path_like = clean.contains("/") | clean.rlike(r"\.\w{1,4}$")
    kind = F.when(n >= 3, F.when(F.get(parts, F.lit(2)).rlike("^[0-9]+$"), "line").otherwise("token")).when(n == 2, "path").when(path_like, "path only").otherwise("rule or fingerprint")
    return lines.where(clean != "").select("repo_id", "file", "line", kind.alias("kind"), F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("second"))
