"""Columns over findings: ranks, families, fingerprints, layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of severities, and the quality of rules where layers agree on a secret.
SEVERITY_RANK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1, "Informational": 0}
RULE_QUALITY = {
    "infra-k8s-secret-plaintext": 120,
    "infra-terraform-hardcoded-secret": 115,
    "aes-hardcoded-key": 110,
    "entropy-secret-high-confidence": 100,
    "entropy-secret-high-entropy-only": 80,
    "entropy-secret-name-hint-only": 60,
    "dockerfile-hardcoded-secret": 50,
    "config-plaintext-secret": 40,
    "tls-verification-disabled": 35,
}
OTHER_RULES = 30


def lookup(key: Column, table: dict, default=None) -> Column:
    """The value of ``key`` in a small fixed table; it stays one expression, without a join."""
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return lookup(severity, SEVERITY_RANK, 0).cast("int")


def severity_of_rank(rank: Column) -> Column:
    return lookup(rank, {v: k for k, v in SEVERITY_RANK.items()})


def algorithm_family(algorithm: Column) -> Column:
    """The name that findings of different layers share: without sizes and modes, in upper case."""
    first = F.split(algorithm, " ")[0]
    bare = F.regexp_replace(first, r"[-_]?\d{2,4}([-_].*)?$", "")
    named = F.upper(F.regexp_replace(F.trim(bare), "[-_/]", "-"))
    return F.when((F.coalesce(algorithm, F.lit("")) == "") | (named == ""), F.lit("unknown")).otherwise(named)


def finding_fingerprint(rule_id: Column, algorithm: Column, snippet: Column) -> Column:
    """16 hex digits that stay equal across scans of the same code."""
    return F.substring(F.sha2(F.concat_ws(":", rule_id, algorithm, F.trim(snippet)), 256), 1, 16)


def rule_quality(rule_id: Column) -> Column:
    return lookup(rule_id, RULE_QUALITY, OTHER_RULES)


def layer(language: Column, rule_id: Column) -> Column:
    """The detection layer that a finding comes from."""
    return (
        F.when(language.isin("python", "javascript") & ~rule_id.startswith("entropy-"), "ast")
        .when(rule_id.startswith("entropy-"), "entropy")
        .when((language == "infra") | rule_id.contains("infra"), "infra")
        .when((language == "manifest") | rule_id.startswith("sca-"), "manifest")
        .otherwise("config")
    )


def effective_severity(severity: Column, quantum_risk: Column) -> Column:
    """What a quantum computer breaks is critical, whatever the rule says."""
    return F.when(quantum_risk == "Quantum-Broken", "Critical").otherwise(severity)
