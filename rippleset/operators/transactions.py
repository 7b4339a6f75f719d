"""Transaction analytics: statistics, anomaly and fraud rules, fees, decisions, reports.

Inputs have ``txn_id, customer_id, ts, amount, device, location``. Windows run inside (customer, day) buckets, so a busy customer is
spread over tasks; what reaches over midnight is joined from a summary of days.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleset.config import CustomerRiskConfig, FraudConfig

D = lambda x: F.lit(Decimal(str(x)))


def daily_summary(txns: DataFrame) -> DataFrame:
    """Count, sum and mean of amounts for each day."""
    return txns.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(18,2)").alias("total"), F.round(F.avg("amount").cast("double"), 6).alias("mean"))


def customer_stats(txns: DataFrame) -> DataFrame:
    """Moments, extremes and distinct devices and locations of each customer's amounts; sums are combined before the shuffle."""
    x = F.col("amount").cast("double")
    return txns.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.min("amount").alias("least"), F.max("amount").alias("most"),
        F.countDistinct("location").alias("locations"), F.countDistinct("device").alias("devices"))


def customer_median(txns: DataFrame) -> DataFrame:
    """Exact median of each customer's amounts from counts per amount, so no customer's rows are held."""
    counts = txns.groupBy("customer_id", "amount").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("customer_id").orderBy("amount").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(counts.groupBy("customer_id").agg(F.sum("n").alias("all")), "customer_id").withColumn("upto", F.sum("n").over(upto))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor((F.col("all") + 2) / 2)
    at = lambda k: (F.col("upto") - F.col("n") < k) & (F.col("upto") >= k)
    middle = ranked.where(at(low) | at(high)).groupBy("customer_id").agg(F.min("amount").alias("a"), F.max("amount").alias("b"))
    return middle.select("customer_id", ((F.col("a") + F.col("b")) / 2).cast("decimal(18,3)").alias("median"))


def balances(txns: DataFrame, credit: str = "signup", debit: str = "purchase") -> DataFrame:
    """Credits less debits of each customer; other types count nothing."""
    signed = F.when(F.col("event_type") == credit, F.col("amount")).when(F.col("event_type") == debit, -F.col("amount")).otherwise(D(0))
    return txns.groupBy("customer_id").agg(F.sum(signed).cast("decimal(18,2)").alias("balance"))


def with_previous(txns: DataFrame) -> DataFrame:
    """``txns`` with the time and location of the customer's transaction before (ties by id)."""
    rows = txns.withColumn("_day", F.to_date("ts"))
    order = Window.partitionBy("customer_id", "_day").orderBy("ts", "txn_id")
    mark = F.struct("ts", "txn_id", "location")
    days = rows.groupBy("customer_id", "_day").agg(F.max(mark).alias("_last"))
    before = days.withColumn("_before", F.lag("_last").over(Window.partitionBy("customer_id").orderBy("_day"))).drop("_last")
    found = rows.withColumn("_here", F.lag(mark).over(order)).join(before, ["customer_id", "_day"])
    prev = F.coalesce("_here", "_before")
    return found.withColumn("prev_ts", prev["ts"]).withColumn("prev_location", prev["location"]).drop("_day", "_here", "_before")


def minutes_since_previous() -> Column:
    """Minutes, with fractions cut at the microsecond."""
    return (F.unix_micros("ts") - F.unix_micros("prev_ts")) / F.lit(60_000_000)


def rapid_succession(txns: DataFrame, minutes: float = 5.0) -> DataFrame:
    """Customers with transactions under ``minutes`` apart: how many, and the least gap in seconds (cut)."""
    rapid = with_previous(txns).where(minutes_since_previous() < minutes)
    return rapid.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_rapid"), F.floor(F.min((F.unix_micros("ts") - F.unix_micros("prev_ts"))) / 1_000_000).cast("long").alias("least_seconds"))


def velocity_24h(txns: DataFrame) -> DataFrame:
    """``txn_id`` with the number of the customer's other transactions in the 24 hours up to it.

    Every row is also copied into the next day's bucket, where it only counts.
    """
    day = F.to_date("ts")
    rows = txns.select("txn_id", "customer_id", "ts", F.explode(F.array(F.struct(day.alias("bucket"), F.lit(True).alias("own")), F.struct(F.date_add(day, 1).alias("bucket"), F.lit(False).alias("own")))).alias("b"))
    near = Window.partitionBy("customer_id", "b.bucket").orderBy(F.unix_micros("ts")).rangeBetween(-86_400_000_000, 0)
    return rows.withColumn("n_before", F.count(F.lit(1)).over(near) - 1).where("b.own").select("txn_id", "customer_id", "ts", "n_before")


def high_amount(txns: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Transactions above the customer's mean by ``sigma`` sample deviations; one transaction alone has no deviation."""
    x = F.col("amount").cast("double")
    bound = txns.groupBy("customer_id").agg((F.avg(x) + sigma * F.stddev_samp(x)).alias("bound"))
    return txns.join(bound, "customer_id").where(x > F.col("bound")).select("txn_id", "customer_id", "amount")


def new_device_high_amount(txns: DataFrame, factor: float = 5.0) -> DataFrame:
    """Transactions on a device that the customer used once, above ``factor`` times the mean."""
    once = txns.groupBy("customer_id", "device").agg(F.count(F.lit(1)).alias("n"), F.max("txn_id").alias("txn_id"), F.max("amount").alias("amount")).where("n = 1")
    mean = txns.groupBy("customer_id").agg(F.avg(F.col("amount").cast("double")).alias("mean"))
    return once.join(mean, "customer_id").where(F.col("amount").cast("double") > factor * F.col("mean")).select("txn_id", "customer_id", "device", "amount")


def fraud_alerts(txns: DataFrame, config: FraudConfig | None = None, devices: DataFrame | None = None) -> DataFrame:
    """The first rule each transaction breaks: R1 amount, R2 factor over the mean, R3 count in 24 hours, R4 gap, R5 travel, R6 country, R7 unknown
    device, R8 model score, R9 young account.

    R5, R6, R8 and R9 need ``distance_km`` (from the transaction before), ``country``, ``model_score`` and ``account_age_days``; R7 needs
    ``devices`` (``customer_id``, ``device``), the known ones. A column that is null or missing skips its rule.
    """
    config = config or FraudConfig()
    mean = txns.groupBy("customer_id").agg(F.avg(F.col("amount").cast("double")).alias("mean"))
    found = with_previous(txns).join(velocity_24h(txns).select("txn_id", "n_before"), "txn_id").join(mean, "customer_id")
    unknown = F.lit(False)
    if devices is not None:
        known = devices.select(F.col("customer_id").alias("_owner"), F.col("device").alias("_device")).where("_device is not null").distinct().withColumn("_known", F.lit(True))
        found = found.join(known, (found["customer_id"] == known["_owner"]) & (found["device"] == known["_device"]), "left").drop("_owner", "_device")
        unknown = F.col("_known").isNull()
    given = lambda name, kind: F.col(name) if name in txns.columns else F.lit(None).cast(kind)
    gap = minutes_since_previous()
    recent = gap < 24 * 60
    x = F.col("amount").cast("double")
    moved = ~F.col("location").eqNullSafe(F.col("prev_location"))
    rule = (
        F.when(x > config.max_amount, "R1").when(x > config.unusual_factor * F.col("mean"), "R2").when(F.col("n_before") > config.max_per_day, "R3")
        .when(recent & (F.floor(gap) < config.min_gap_minutes), "R4")
        .when(recent & moved & (given("distance_km", "double") > config.travel_km) & (F.floor(gap / 60) < config.travel_hours), "R5")
        .when(given("country", "string").isin(*config.countries), "R6").when(unknown & (x > config.new_device_amount), "R7")
        .when(given("model_score", "double") > config.model_score, "R8")
        .when((given("account_age_days", "int") < config.young_account_days) & (x > config.young_account_amount), "R9"))
    return found.withColumn("rule", rule).where("rule is not null").select("txn_id", "customer_id", "rule", F.lit("HIGH").alias("severity"))


def alerts_per_customer(alerts: DataFrame) -> DataFrame:
    """Alerts of each customer."""
    return alerts.groupBy("customer_id").agg(F.count(F.lit(1)).alias("alerts"))


def customer_risk(txns: DataFrame, config: CustomerRiskConfig | None = None) -> DataFrame:
    """Anomaly score (at most 1) and level of each customer."""
    config = config or CustomerRiskConfig()
    stats = customer_stats(txns)
    mark = lambda df, name: df.groupBy("customer_id").agg(F.count(F.lit(1)).alias(name))
    found = stats.join(mark(high_amount(txns, config.sigma), "high"), "customer_id", "left").join(rapid_succession(txns, config.rapid_minutes).select("customer_id", "n_rapid"), "customer_id", "left").join(mark(new_device_high_amount(txns, config.new_device_factor), "device_high"), "customer_id", "left")
    points = lambda test, value: F.when(test, D(value)).otherwise(D("0.00"))
    score = (
        points(F.col("n") < config.few_transactions, "0.20") + points(F.col("n") / config.window_days > config.busy_per_day, "0.10") + points(F.col("devices") > config.many_devices, "0.15")
        + points(F.col("high").isNotNull(), "0.25") + points(F.col("n_rapid").isNotNull(), "0.15") + points(F.col("locations") > config.max_locations, "0.15") + points(F.col("device_high").isNotNull(), "0.25"))
    scored = found.select("customer_id", F.least(score, D("1.00")).cast("decimal(4,2)").alias("score"))
    level = F.when(F.col("score") > D("0.85"), "CRITICAL").when(F.col("score") > D("0.65"), "HIGH").when(F.col("score") > D("0.45"), "MEDIUM").otherwise("LOW")
    return scored.withColumn("level", level)


def risk_profiles(txns: DataFrame, alerts: DataFrame, config: CustomerRiskConfig | None = None) -> DataFrame:
    """Customers' scores with their numbers of alerts."""
    return customer_risk(txns, config).join(alerts_per_customer(alerts), "customer_id", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0).cast("long")))


def daily_fraud_report(txns: DataFrame, risks: DataFrame, high_risk: str | None = None, concerning: int | None = None, config: CustomerRiskConfig | None = None) -> DataFrame:
    """Transactions, high-risk ones, mean risk over transactions and verdict of each day; bounds that are not given are those of ``config``."""
    config = config or CustomerRiskConfig()
    high_risk, concerning = config.high_risk if high_risk is None else high_risk, config.concerning_count if concerning is None else concerning
    joined = txns.join(risks.select("customer_id", "score"), "customer_id")
    out = joined.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("score") > D(high_risk)).cast("long")).alias("high_risk"), F.round(F.avg(F.col("score").cast("double")), 6).alias("mean_risk"))
    return out.withColumn("verdict", F.when(F.col("high_risk") > concerning, "CONCERNING").otherwise("ACCEPTABLE"))


def fees(payments: DataFrame) -> DataFrame:
    """Fee of each payment by type and tier, halved for premium customers, raised in office hours for large amounts.

    Office hours lie strictly between 08:00 and 17:00: of ``second_of_day`` where payments have it, else of the whole ``hour``.
    """
    second = F.col("second_of_day") if "second_of_day" in payments.columns else F.col("hour") * 3600
    x = F.col("amount")
    tier = F.when(x < 1000, D(5)).when(x < 5000, D(10)).when(x < 10000, D(25)).otherwise(D(45))
    abroad = F.least(F.greatest(x * D("0.03"), D(35)), D(250))
    base = F.when(F.col("type") == "DOMESTIC", tier).when(F.col("type") == "INTERNATIONAL", abroad).when(F.col("type") == "ACH", D(2)).when(F.col("type") == "WIRE", D(30)).otherwise(D(0)).cast("decimal(18,4)")
    fee = base * F.when(F.col("premium"), D("0.5")).otherwise(D("1.0")) * F.when((second > 8 * 3600) & (second < 17 * 3600) & (x > 50000), D("1.1")).otherwise(D("1.0"))
    return payments.select("payment_id", "type", F.round(fee, 2).cast("decimal(18,2)").alias("fee"))


def payment_decisions(payments: DataFrame, overdraft_limit: int = 100_000, review: str = "0.85", alerts: DataFrame | None = None) -> DataFrame:
    """Decision of each payment, in order of the checks, and its total with the fee when completed; ``alerts`` (``txn_id``) are those of the payments."""
    found = payments.join(fees(payments).select("payment_id", "fee"), "payment_id")
    fraud = F.lit(False)
    if alerts is not None:
        found = found.join(alerts.select(F.col("txn_id").alias("payment_id")).distinct().withColumn("_fraud", F.lit(True)), "payment_id", "left")
        fraud = F.col("_fraud").isNotNull()
    x, balance = F.col("amount"), F.col("balance")
    decision = (
        F.when(x <= 0, "INVALID").when(F.col("blocked"), "BLOCKED").when((balance < x) & ~F.col("overdraft"), "INSUFFICIENT").when(balance + overdraft_limit < x, "EXCEEDS_LIMIT")
        .when(fraud, "REJECTED").when(F.col("risk") > D(review), "MANUAL_REVIEW").otherwise("COMPLETED"))
    return found.withColumn("decision", decision).select("payment_id", "decision", F.when(F.col("decision") == "COMPLETED", x + F.col("fee")).cast("decimal(18,2)").alias("total"))


def latest_per_customer(txns: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` transactions of each customer (ties by id), first within each day."""
    by_day = Window.partitionBy("customer_id", F.to_date("ts")).orderBy(F.desc("ts"), F.desc("txn_id"))
    few = txns.withColumn("_k", F.row_number().over(by_day)).where(F.col("_k") <= n)
    order = Window.partitionBy("customer_id").orderBy(F.desc("ts"), F.desc("txn_id"))
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("customer_id", "rank", "txn_id", "amount")


def access_log_stats(log: DataFrame) -> DataFrame:
    """Requests and mean duration of each kind, and its share of failures."""
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("amount").cast("double")), 4).alias("mean_ms"), F.sum((F.col("event_type") == "error").cast("long")).alias("failures"))


def reversals(requests: DataFrame, payments: DataFrame) -> DataFrame:
    """Refund (amount and fee) of each asked reversal; an unknown payment fails."""
    paid = payments.join(fees(payments).select("payment_id", "fee"), "payment_id").select("payment_id", "amount", "fee")
    found = requests.join(paid, "payment_id", "left")
    known = F.col("amount").isNotNull()
    return found.select("request_id", "payment_id", F.when(known, F.col("amount") + F.col("fee")).cast("decimal(18,2)").alias("refund"), F.when(known, "REVERSED").otherwise("FAILED").alias("status"))
