"""The quality rules: what each is called, how bad it is, and what is said about it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    seq: int
    name: str
    category: str
    severity: str  # "" means: graded by the affected percentage
    risk: str
    confidence: float
    description: str
    impact: str
    action: str
    remediation: str
    catalog: str | None  # name of the rule catalog row that switches it on


# Names, grades and texts that reports and downstream filters rely on.
# {n} affected rows, {pct} percentage, {groups} duplicate groups, {c} column, {t} table,
# {noun}/{parent} plural names of the table's and the parent's rows, others from the binding.
RULES = (
    Rule(1, "NULL_CHECK", "COMPLETENESS", "", "MEDIUM", 99.9,
         "{c} has {n} NULL values ({pct}%)", "Missing {c} breaks reporting", "Fill or investigate {c}",
         "-- UPDATE {t} SET {c} = '<default>' WHERE {c} IS NULL", "NULL_CHECK"),
    Rule(2, "BLANK_STRING", "COMPLETENESS", "MEDIUM", "LOW", 99.0,
         "{c} has {n} blank strings", "Empty {c} hides data gaps", "Convert blanks to NULL",
         "UPDATE {t} SET {c} = NULL WHERE trim({c}) = ''", "BLANK_STRING_CHECK"),
    Rule(3, "DUPLICATE_KEY", "UNIQUENESS", "CRITICAL", "HIGH", 99.9,
         "{groups} duplicate {c} values ({n} rows)", "Duplicates cause double-counting", "Deduplicate records",
         "SELECT {c}, count(*) FROM {t} WHERE {present} GROUP BY {c} HAVING count(*) > 1", "DUPLICATE_CHECK"),
    Rule(4, "EMAIL_FORMAT", "VALIDITY", "HIGH", "MEDIUM", 95.0,
         "{n} invalid emails in {c}", "Bad emails block communication", "Flag invalid emails",
         "UPDATE {t} SET {c} = NULL WHERE trim({c}) <> '' AND NOT {c} RLIKE '{pattern}'", "EMAIL_FORMAT"),
    Rule(5, "NEGATIVE_VALUE", "VALIDITY", "HIGH", "MEDIUM", 90.0,
         "{n} negative values in {c}", "Negative {c} distorts calculations", "Investigate or nullify",
         "UPDATE {t} SET {c} = NULL WHERE {c} < 0", "NUMERIC_RANGE"),
    Rule(6, "FUTURE_DATE", "VALIDITY", "HIGH", "MEDIUM", 95.0,
         "{n} future dates in {c}", "Future dates indicate errors", "Review or nullify",
         "UPDATE {t} SET {c} = NULL WHERE {c} > '{as_of}'", "DATE_RANGE"),
    Rule(7, "INVALID_CATEGORY", "VALIDITY", "MEDIUM", "LOW", 85.0,
         "{n} invalid values in {c}", "Bad categories break grouping", "Map or nullify",
         "UPDATE {t} SET {c} = NULL WHERE {c} NOT IN ({allowed})", "CATEGORICAL_VALIDITY"),
    Rule(8, "WHITESPACE", "CONSISTENCY", "LOW", "LOW", 99.9,
         "{n} values with whitespace in {c}", "Whitespace breaks joins", "Trim values",
         "UPDATE {t} SET {c} = trim({c}) WHERE {c} <> trim({c})", "WHITESPACE_CHECK"),
    Rule(9, "ORPHAN_REFERENCE", "INTEGRITY", "CRITICAL", "HIGH", 99.9,
         "{n} {noun} reference missing {parent}", "Orphans break revenue attribution", "Backfill or flag",
         "SELECT * FROM {t} WHERE {c} NOT IN (SELECT {parent_key} FROM {parent_table} WHERE {parent_key} IS NOT NULL)",
         "REFERENTIAL_INTEGRITY"),
    Rule(10, "DATE_ORDERING", "VALIDITY", "HIGH", "MEDIUM", 95.0,
         "{n} {noun} delivered before ordered", "Impossible dates hurt logistics", "Swap or flag",
         "UPDATE {t} SET {c} = {start}, {start} = {c} WHERE {c} < {start}", "DATE_ORDERING"),
    Rule(11, "AMOUNT_MISMATCH", "VALIDITY", "HIGH", "LOW", 98.0,
         "{n} {noun}: total != qty*price", "Revenue accuracy at risk", "Recalculate totals",
         "UPDATE {t} SET {c} = {quantity} * {price} WHERE abs({c} - {quantity} * {price}) > 0.01",
         "AMOUNT_CONSISTENCY"),
    Rule(12, "COST_EXCEEDS_PRICE", "VALIDITY", "HIGH", "HIGH", 95.0,
         "{n} {noun} selling at a loss", "Margin erosion", "Review pricing",
         "SELECT * FROM {t} WHERE {c} > {price}", None),
    # Declared in the rule catalog only; run when the rule set is "catalog".
    Rule(13, "DUPLICATE_ROW", "UNIQUENESS", "CRITICAL", "HIGH", 99.9,
         "{groups} duplicated rows ({n} rows)", "Duplicates cause double-counting", "Deduplicate records",
         "", "DUPLICATE_ROW_CHECK"),
    Rule(14, "PHONE_FORMAT", "VALIDITY", "MEDIUM", "MEDIUM", 95.0,
         "{n} invalid phones in {c}", "Bad phones block communication", "Flag invalid phones",
         "", "PHONE_FORMAT"),
    Rule(15, "DATE_RANGE", "VALIDITY", "HIGH", "MEDIUM", 95.0,
         "{n} impossible dates in {c}", "Impossible dates indicate errors", "Review or nullify",
         "", "DATE_RANGE"),
    Rule(16, "NUMERIC_RANGE", "VALIDITY", "HIGH", "MEDIUM", 90.0,
         "{n} out-of-range values in {c}", "Out-of-range {c} distorts calculations", "Investigate or nullify",
         "", "NUMERIC_RANGE"),
    Rule(17, "CASE_CONSISTENCY", "CONSISTENCY", "LOW", "LOW", 95.0,
         "{n} values with inconsistent case in {c}", "Mixed case splits groups", "Normalise case",
         "", "CASE_CONSISTENCY"),
    Rule(18, "FRESHNESS_CHECK", "FRESHNESS", "MEDIUM", "LOW", 95.0,
         "{c} has not been updated recently", "Stale data misleads reports", "Check the ingestion",
         "", "FRESHNESS_CHECK"),
    Rule(19, "OUTLIER_DETECTION", "ACCURACY", "MEDIUM", "MEDIUM", 80.0,
         "{n} outliers in {c}", "Outliers distort averages", "Review outliers",
         "", "OUTLIER_DETECTION"),
)

BY_NAME = {rule.name: rule for rule in RULES}
EXECUTED = frozenset(rule.name for rule in RULES if rule.seq <= 12)
CATALOG = frozenset(rule.name for rule in RULES)
RULE_SETS = {"executed": EXECUTED, "catalog": CATALOG}

# Severities with their score penalty, worst first, and the NULL_CHECK grades.
SEVERITY_PENALTY = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 3}
OTHER_PENALTY = 5
NULL_GRADES = ((20, "CRITICAL"), (10, "HIGH"), (5, "MEDIUM"))

# Score weights per dimension.
WEIGHTS = {
    "COMPLETENESS": "0.25",
    "UNIQUENESS": "0.20",
    "VALIDITY": "0.20",
    "CONSISTENCY": "0.15",
    "INTEGRITY": "0.15",
    "FRESHNESS": "0.05",
}
DIMENSIONS = tuple(WEIGHTS)
