"""Keyword lists, bounds and points of the scoring rules.

Everything here is an input of the rules: a caller passes another ``ScoringConfig`` to change a list or a bound.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: lists the rules look up ---------------------------------------------------------------------------
CRITICAL_KEYWORDS = ("payment", "transaction", "fraud", "balance", "account", "transfer", "regulatory", "compliance",
                     "audit", "security", "authentication")
CRITICAL_FILE_WORDS = ("payment", "fraud", "transaction", "security", "auth")
HIGH_FILE_WORDS = ("account", "balance", "transfer")
CRITICAL_TABLE_WORDS = ("transaction", "payment", "account", "balance", "fraud", "customer", "transfer")
DATA_LAYER_WORDS = ("DAO", "Table")
HEURISTIC_TABLES = (("account", "accounts"), ("transaction", "transactions"), ("customer", "customers"),
                    ("fraud", "fraud_alerts"), ("transfer", "transfer_records"), ("balance", "account_balances"))
API_PATH_WORDS = ("controller", "route", "api", "endpoint", "rest", "handler", "service.py", "router", "app.py")
API_DIFF_WORDS = ("@restcontroller", "@controller", "@getmapping", "@postmapping", "@putmapping", "@deletemapping",
                  "@requestmapping", "@app.route", "@router.", "app.get", "app.post", "app.put", "app.delete",
                  "fastapi", "flask", "express", "router.get", "router.post")
DIRECT_TYPES = ("CALL", "USE", "IMPORT", "CREATE", "EXTEND", "IMPLEMENT")
NOT_A_CONCERN = ("none", "n/a", "unable to parse")
KNOWN_COLLECTIONS = ("transactions", "accounts", "customers", "fraud_alerts", "transfers")
COLLECTION_STOP_WORDS = ("db", "client", "database", "mongo", "mongodb")
HIGH_RISK_COUNTRIES = ("XX", "YY", "ZZ")
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH")
CORPUS_EXTENSIONS = ("java", "py", "js", "ts", "sql")
CONSUMER_EXTENSIONS = ("js", "jsx", "ts", "tsx", "java", "py", "go", "rb")
SEARCH_EXTENSIONS = CONSUMER_EXTENSIONS + ("php", "cpp", "c")
CONTROL_COLLECTIONS = ("schema_notifications",)
LEVELS = ((7.5, "CRITICAL", "#dc3545"), (5.5, "HIGH", "#fd7e14"), (3.5, "MEDIUM", "#ffc107"))
LOWEST_LEVEL = ("LOW", "#28a745")
# ---------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ScoringConfig:
    """Inputs of the change-risk rules."""

    critical_keywords: tuple[str, ...] = CRITICAL_KEYWORDS
    critical_file_words: tuple[str, ...] = CRITICAL_FILE_WORDS
    high_file_words: tuple[str, ...] = HIGH_FILE_WORDS
    critical_table_words: tuple[str, ...] = CRITICAL_TABLE_WORDS
    data_layer_words: tuple[str, ...] = DATA_LAYER_WORDS
    not_a_concern: tuple[str, ...] = NOT_A_CONCERN
    levels: tuple[tuple[float, str, str], ...] = LEVELS
    lowest_level: tuple[str, str] = LOWEST_LEVEL
    code_scale: str = "1.11"
    schema_scale: str = "1.25"
    cap: int = 10
    count_heuristic_usages: bool = True


@dataclass(frozen=True)
class FraudConfig:
    """Inputs of the transaction rules."""

    max_amount: float = 50000.0
    unusual_factor: float = 10.0
    max_per_day: int = 10
    min_gap_minutes: int = 2
    travel_km: float = 500.0
    travel_hours: int = 2
    countries: tuple[str, ...] = HIGH_RISK_COUNTRIES
    new_device_amount: float = 10000.0
    model_score: float = 0.85
    young_account_days: int = 7
    young_account_amount: float = 5000.0


@dataclass(frozen=True)
class CustomerRiskConfig:
    """Inputs of the customer anomaly rules."""

    window_days: int = 90
    sigma: float = 3.0
    rapid_minutes: float = 5.0
    max_locations: int = 5
    new_device_factor: float = 5.0
    few_transactions: int = 5
    busy_per_day: float = 5.0
    many_devices: int = 3
    high_risk: str = "0.85"
    concerning_count: int = 10
