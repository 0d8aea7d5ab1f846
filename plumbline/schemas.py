"""Stored schemas as DDL strings: the demo tables and the engine's own tables."""

from __future__ import annotations

# Column names and types of the stored tables.
CUSTOMERS = (
    "customer_id bigint, first_name string, last_name string, email string, phone string, address string, "
    "city string, state string, country string, postal_code string, date_of_birth date, "
    "registration_date timestamp_ntz, customer_segment string, credit_score bigint, "
    "annual_income decimal(15,2), is_active boolean, last_login timestamp_ntz"
)
PRODUCTS = (
    "product_id bigint, product_name string, category string, sub_category string, brand string, "
    "unit_price decimal(10,2), cost_price decimal(10,2), stock_quantity bigint, reorder_level bigint, "
    "weight_kg decimal(8,3), is_active boolean, created_date date, last_updated timestamp_ntz"
)
ORDERS = (
    "order_id bigint, customer_id bigint, product_id bigint, order_date timestamp_ntz, "
    "delivery_date timestamp_ntz, quantity bigint, unit_price decimal(10,2), total_amount decimal(12,2), "
    "discount_pct decimal(5,2), payment_method string, order_status string, shipping_address string, "
    "city string, state string, country string"
)
SCAN_RESULTS = (
    "scan_id string, scan_timestamp timestamp_ntz, database_name string, schema_name string, "
    "table_name string, total_rows bigint, total_columns bigint, issues_found bigint, "
    "critical_issues bigint, high_issues bigint, medium_issues bigint, low_issues bigint, "
    "health_score decimal(5,2), completeness_score decimal(5,2), uniqueness_score decimal(5,2), "
    "validity_score decimal(5,2), consistency_score decimal(5,2), integrity_score decimal(5,2), "
    "freshness_score decimal(5,2), scan_duration_seconds decimal(10,2), scan_type string"
)
SCAN_ISSUES = (
    "issue_id string, scan_id string, table_name string, column_name string, rule_category string, "
    "rule_name string, severity string, affected_rows bigint, total_rows bigint, "
    "affected_percentage decimal(7,4), issue_description string, business_impact string, "
    "recommended_action string, remediation_sql string, risk_level string, confidence_level decimal(5,2), "
    "detected_at timestamp_ntz"
)
QUALITY_RULES = (
    "rule_id bigint, rule_name string, rule_category string, rule_description string, "
    "applicable_data_types string, severity_default string, is_active boolean, created_at timestamp_ntz"
)
REMEDIATION_LOG = (
    "remediation_id string, scan_id string, issue_id string, table_name string, column_name string, "
    "issue_type string, severity string, affected_rows bigint, remediation_sql string, "
    "approval_status string, approved_by string, approved_at timestamp_ntz, executed_at timestamp_ntz, "
    "execution_result string, before_score decimal(5,2), after_score decimal(5,2), created_at timestamp_ntz"
)
QUALITY_CONTRACTS = (
    "contract_id bigint, contract_name string, table_name string, column_name string, "
    "natural_language_rule string, generated_sql_check string, severity string, is_active boolean, "
    "created_by string, created_at timestamp_ntz"
)
HEALTH_SCORE_HISTORY = (
    "record_id bigint, scan_id string, scan_date date, database_name string, schema_name string, "
    "table_name string, health_score decimal(5,2), completeness_score decimal(5,2), "
    "uniqueness_score decimal(5,2), validity_score decimal(5,2), consistency_score decimal(5,2), "
    "integrity_score decimal(5,2), freshness_score decimal(5,2), total_issues bigint, "
    "critical_issues bigint, rows_at_risk bigint, recorded_at timestamp_ntz"
)
SCORE_WEIGHTS = ("dimension string, weight decimal(5,2), description string")
FIX_IMAGES = (
    "table_name string, key_value string, rule_name string, column_name string, "
    "changes array<struct<column_name: string, old_value: string, new_value: string>>"
)
# What a rule of the catalog looks for, where it is no rule of `rules.RULES`: true on an offending row.
RULE_PREDICATES = "rule_name string, table_name string, column_name string, predicate string"
# The tables that rounds of scans and fixes write.
STORED = {
    "scan_results": SCAN_RESULTS, "scan_issues": SCAN_ISSUES, "health_score_history": HEALTH_SCORE_HISTORY,
    "remediation_log": REMEDIATION_LOG, "fix_images": FIX_IMAGES,
}
