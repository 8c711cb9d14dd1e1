"""The subscription schema derived from order, line-item and event tables.

The study's own exports are private, so demos, tests and benchmarks derive every source table from
a generic sales schema by key arithmetic. The texts below are plain SELECTs; ``{each:n}`` stands for
"one row per integer 1..n" and is filled in per dialect, so that another SQL engine can derive the
very same inputs.

All of them are narrow apart from the joins to orders/customers and the numbering of line items. That exchanges the lines of
ordinary orders once, by order; orders with very many lines are counted first and then numbered within small groups, so a hot
order key cannot pile up in one task. Every line item becomes a plan term and
an invoice, every part a plan of the catalogue.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenurekit.config import Calendar

CALENDAR = Calendar(pull_date=date(2001, 8, 2), label_cutoff=date(2001, 7, 31))
CONDITION = "alpha care"
# Declared, so that opening a table reads no file footers.
DRIVER_SCHEMAS = {
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
DRIVER_TABLES = tuple(DRIVER_SCHEMAS)

_CONDITION = """CASE k % 5 WHEN 0 THEN 'alpha care' WHEN 1 THEN 'Alpha Care' WHEN 2 THEN 'beta care'
    WHEN 3 THEN 'BETA CARE' ELSE 'gamma care' END"""

_STRENGTH = """CASE p % 7 WHEN 0 THEN '2.5mg' WHEN 1 THEN '5mg' WHEN 2 THEN '10mg' WHEN 3 THEN '20mg'
    WHEN 4 THEN '25mg' WHEN 5 THEN '50mg' ELSE '100mg' END"""

_DRUG = "CASE WHEN p % 13 = 0 THEN NULL WHEN p % 2 = 0 THEN 'drug_a' ELSE 'drug_b' END"

_KNOWN_LINE = "l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL AND l_partkey % 64 IS NOT NULL"

TEXTS = {
    # One row per order: key, customer, start day, and whether the subscriber paid and activated.
    "base": """
        SELECT k, user_key, d, priority, paid, paid AND k % 11 <> 0 AS activated
        FROM (SELECT o_orderkey AS k, o_custkey AS user_key, CAST(o_orderdate AS DATE) AS d,
                     o_orderpriority AS priority, o_orderkey % 8 <> 0 AND o_orderkey % 7 <> 0 AS paid
              FROM orders) o""",
    "users": """
        SELECT c_custkey AS common_id, n_name AS user_state
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    # Subscriptions without the home state, for every query that does not ask for it.
    "subscriptions_core": f"""
        SELECT k AS subscription_id, user_key AS common_id,
               CAST(d - CAST(k % 3 AS INT) AS TIMESTAMP) AS created_at,
               k % 8 <> 0 AS rx_is_written, paid AS is_paid, activated AS is_activated,
               CASE WHEN activated THEN CAST(d AS TIMESTAMP) END AS activated_at,
               CASE k % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'canceled' ELSE 'paused' END AS status,
               CASE WHEN k % 3 = 1 THEN CAST(d + 90 AS TIMESTAMP) END AS latest_canceled_at,
               CASE WHEN k % 3 = 2 THEN CAST(d + 45 AS TIMESTAMP) END AS latest_paused_at,
               CAST(1 + k % 3 AS INT) AS user_subscription_number,
               CASE WHEN k % 2 = 0 THEN 'web' ELSE 'app' END AS first_platform,
               CASE substr(priority, 1, 1) WHEN '1' THEN 'organic search' WHEN '2' THEN 'paid search'
                    WHEN '3' THEN 'direct' WHEN '4' THEN 'crm' END AS first_channel_grouping,
               CASE WHEN k % 4 = 0 THEN 'newsletter' ELSE 'search' END AS first_traffic_source,
               'campaign_' || CAST(k % 5 AS VARCHAR(20)) AS first_campaign,
               {_CONDITION} AS condition_name,
               CAST(CASE k % 7 WHEN 0 THEN 30 WHEN 1 THEN 32 WHEN 2 THEN 90 WHEN 3 THEN 96 WHEN 4 THEN 180
                    WHEN 5 THEN 192 ELSE 45 END AS INT) AS current_days_supply,
               CAST(10 + k % 20 AS INT) AS current_quantity,
               CASE WHEN k % 3 = 0 THEN 'DAILY' ELSE 'AS_NEEDED' END AS current_regimen,
               CAST(k % 5 AS INT) AS current_drug_id
        FROM base""",
    "subscriptions": "SELECT s.*, u.user_state FROM subscriptions_core s JOIN users u ON s.common_id = u.common_id",
    "subscription_terms": f"""
        SELECT subscription_id, subscription_term_id, term_number, is_new_start, condition_name,
               CAST(started AS TIMESTAMP) AS term_started_at, CAST(ended AS TIMESTAMP) AS term_ended_at,
               CAST(started + 60 AS TIMESTAMP) AS term_active_until,
               CAST(cancelled AS TIMESTAMP) AS cancel_requested_at,
               CASE WHEN cancelled IS NOT NULL THEN 'reason_' || CAST(k % 4 AS VARCHAR(20)) END AS cancel_reason,
               CASE WHEN ended IS NOT NULL AND k % 50 <> 4 THEN 'canceled' WHEN k % 13 = 0 THEN 'paused'
                    ELSE 'active' END AS term_status,
               CASE WHEN ended IS NULL THEN NULL WHEN cancelled IS NOT NULL THEN 'USER_REQUESTED'
                    WHEN payment_failed THEN 'DELINQUENCY' ELSE 'UNKNOWN' END AS termination_type,
               CASE WHEN NOT payment_failed THEN FALSE END AS is_failed_payment_canceled,
               paid AS is_paid, CAST(started AS TIMESTAMP) AS paid_at, k % 17 = 0 AS is_delinquent,
               k % 19 = 0 AS is_refunded,
               CASE WHEN k % 19 = 0 THEN CAST(started + 5 AS TIMESTAMP) END AS refunded_at
        FROM (
          SELECT k, paid, k AS subscription_id, k * 10 + seq AS subscription_term_id,
                 CAST(CASE WHEN seq = 1 OR k % 500 = 1 THEN 1 ELSE 2 END AS INT) AS term_number,
                 seq = 1 AS is_new_start, seq = 1 AND k % 12 = 3 AS payment_failed,
                 {_CONDITION} AS condition_name,
                 CASE WHEN NOT activated THEN NULL WHEN seq = 1 THEN d ELSE d + 200 END AS started,
                 CASE WHEN seq = 1 AND cancel_day <= DATE '2001-08-02' THEN cancel_day END AS cancelled,
                 CASE WHEN seq = 2 THEN NULL
                      WHEN cancel_day <= DATE '2001-08-02'
                      THEN CASE WHEN cancel_day + 20 <= DATE '2001-08-02' THEN cancel_day + 20 END
                      WHEN end_day <= DATE '2001-08-02' THEN end_day END AS ended
          FROM (
            SELECT k, d, paid, activated,
                   CASE WHEN k % 2 = 0 THEN d + CAST((k * 13) % 150 AS INT) END AS cancel_day,
                   CASE WHEN k % 6 = 3 THEN d + CAST(30 + k % 150 AS INT) END AS end_day,
                   {{each:CASE WHEN activated AND (k % 10 = 2 OR k % 500 = 1) THEN 2 ELSE 1 END}} AS seq
            FROM base) n) t""",
    # Line items by (order, line, part, supplier), numbered within the order without gaps. Places come from counts of
    # (order, line, part % 64), so no window runs over all line items of an order. Both inner queries state all that joins and
    # windows would infer for either, so that one scan and one exchange serve both.
    "numbered_lines": f"""
        SELECT i.l_orderkey, p, s, before + row_number() OVER (PARTITION BY i.l_orderkey, i.line, i.part_group ORDER BY p, s) AS n, n_plans
        FROM (SELECT l_orderkey, l_linenumber AS line, l_partkey AS p, l_suppkey AS s, l_partkey % 64 AS part_group
              FROM lineitem WHERE {_KNOWN_LINE} GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey) i
        JOIN (SELECT l_orderkey, line, part_group,
                     CAST(sum(n_items) OVER (PARTITION BY l_orderkey ORDER BY line, part_group) AS BIGINT) - n_items AS before,
                     CAST(sum(n_items) OVER (PARTITION BY l_orderkey) AS BIGINT) AS n_plans
              FROM (SELECT l_orderkey, line, part_group, count(*) AS n_items
                    FROM (SELECT l_orderkey, l_linenumber AS line, l_partkey AS p, l_suppkey AS s, l_partkey % 64 AS part_group
                          FROM lineitem WHERE {_KNOWN_LINE} GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey) g
                    GROUP BY l_orderkey, line, part_group) c) t
        ON i.l_orderkey = t.l_orderkey AND i.line = t.line AND i.part_group = t.part_group""",
    # One plan for each line item of an order; attributes come from its keys.
    "subscription_plan_terms": f"""
        SELECT k AS subscription_id, k * 10 + 1 AS subscription_term_id,
               (k * 10 + 1) * 1000000 + n AS subscription_plan_term_id, CAST(1 AS INT) AS term_number,
               CAST(n AS INT) AS plan_term_number, {_CONDITION} AS condition_name,
               CASE WHEN activated THEN CAST(d AS TIMESTAMP) END AS term_started_at,
               CAST(NULL AS TIMESTAMP) AS term_ended_at, 'active' AS term_status,
               CAST(d + CAST(25 * (n - 1) AS INT) AS TIMESTAMP) AS plan_term_started_at,
               CASE WHEN n < n_plans THEN CAST(d + CAST(25 * n AS INT) AS TIMESTAMP) END AS plan_term_ended_at,
               CASE WHEN n < n_plans THEN 'ended' ELSE 'active' END AS plan_term_status,
               n = n_plans AS is_latest_plan_term, p AS plan_id,
               CAST(NULL AS BIGINT) AS previous_plan_id, 'plan ' || CAST(p AS VARCHAR(20)) AS plan_name,
               'v' || CAST(s % 3 AS VARCHAR(20)) AS plan_variant,
               CAST(CASE p % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 6 END AS INT) AS term_months,
               CAST(p % 5 AS INT) AS drug_id, {_DRUG} AS drug_name, {_STRENGTH} AS drug_strength,
               CASE WHEN s % 3 = 0 THEN 'DAILY' ELSE 'AS_NEEDED' END AS regimen,
               CAST(CASE s % 4 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 16 ELSE 30 END AS INT) AS monthly_dose,
               CASE WHEN s % 9 = 0 THEN 'PICKUP' ELSE 'DELIVERY' END AS starting_fulfillment_type
        FROM base JOIN numbered_lines ON k = l_orderkey""",
    "subscription_plan_types": f"""
        SELECT plan_id, CAST(p % 5 AS INT) AS drug_id, drug_name, condition_name, term_months, fulfillment_method
        FROM (SELECT p_partkey AS plan_id, p_partkey AS p, p_partkey AS k,
                     CASE WHEN p_partkey % 2 = 0 THEN 'drug_a' ELSE 'drug_b' END AS drug_name,
                     CAST(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 6 END AS INT) AS term_months,
                     CASE p_partkey % 5 WHEN 0 THEN 'alpha care' WHEN 1 THEN 'alpha care' WHEN 2 THEN 'alpha care'
                          WHEN 3 THEN 'BETA CARE' ELSE 'gamma care' END AS condition_name,
                     'delivery' AS fulfillment_method
              FROM part) pt""",
    "subscription_invoices": f"""
        SELECT subscription_id, subscription_id * 10 + 1 AS subscription_term_id,
               (subscription_id * 10 + 1) * 1000000 + line AS subscription_plan_term_id,
               invoice_id, line AS invoice_number, CAST(1 AS INT) AS term_number, condition_name,
               condition_name AS subscription_subcategory,
               CASE WHEN is_paid THEN 'paid' WHEN is_failed THEN 'failed' ELSE 'open' END AS invoice_status,
               CAST(made AS TIMESTAMP) AS created_at,
               CASE WHEN is_paid THEN CAST(made AS TIMESTAMP) END AS paid_at,
               CASE WHEN is_failed THEN CAST(made + CAST(p % 5 AS INT) AS TIMESTAMP) END AS failed_at,
               CAST(made AS TIMESTAMP) AS first_charge_at,
               CAST(made + CAST(num_charges - 1 AS INT) AS TIMESTAMP) AS latest_charge_at,
               CASE WHEN is_refunded THEN CAST(made + 7 AS TIMESTAMP) END AS refunded_at,
               num_charges, amount_due, CASE WHEN is_paid THEN amount_due END AS gross_revenue,
               CASE WHEN is_paid AND NOT is_refunded THEN amount_due END AS net_revenue,
               is_paid, is_failed, is_refunded, is_delinquent,
               is_failed AND num_charges = 8 AS caused_cancellation, line >= 7 AS is_latest_term_invoice,
               subscription_id * 10 + line % 3 AS visit_id, 'rx' || CAST(p % 100 AS VARCHAR(20)) AS prescription_id,
               CASE WHEN p % 60 <> 0 THEN p END AS plan_id, CAST(p % 5 AS INT) AS drug_id,
               {_DRUG} AS drug_name, CASE WHEN activated THEN CAST(d AS TIMESTAMP) END AS term_started_at,
               CAST(NULL AS TIMESTAMP) AS term_ended_at, CAST(NULL AS TIMESTAMP) AS cancel_requested_at,
               line + 1 AS next_invoice_number, 'scheduled' AS next_invoice_status,
               CASE WHEN (subscription_id + line) % 7 < 4 THEN subscription_id END AS latest_order_id, card
        FROM (
          SELECT k AS subscription_id, d, activated, p, line, {_CONDITION} AS condition_name,
                 d + CAST(30 * (line - 1) AS INT) AS made,
                 CAST(k AS VARCHAR(20)) || '-' || CAST(line AS VARCHAR(20)) || '-' || CAST(p AS VARCHAR(20))
                   || '-' || CAST(s AS VARCHAR(20)) AS invoice_id,
                 CAST(1 + p % 8 AS INT) AS num_charges, CAST(price AS DECIMAL(18,2)) AS amount_due,
                 returned <> 'R' AS is_paid, returned = 'R' AND line_status = 'F' AS is_failed,
                 returned = 'R' AND line_status = 'O' AS is_delinquent,
                 returned = 'A' AND s % 5 = 0 AS is_refunded,
                 CASE s % 3 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' ELSE 'amex' END AS card
          FROM base JOIN (
            SELECT l_orderkey, l_partkey AS p, l_suppkey AS s, l_linenumber AS line, l_extendedprice AS price,
                   l_returnflag AS returned, l_linestatus AS line_status FROM lineitem) l
          ON k = l_orderkey) i""",
    # One row per attempt to collect an invoice; only the last one can succeed.
    "subscription_charges": """
        SELECT invoice_id || '-' || CAST(attempt AS VARCHAR(20)) AS charge_id, invoice_id, subscription_id,
               condition_name, CAST(made + CAST(attempt - 1 AS INT) AS TIMESTAMP) AS occurred_at,
               CAST(attempt AS INT) AS attempt_number, CAST(8 - attempt AS INT) AS attempts_remaining,
               attempt = num_charges AS is_latest_charge, amount_due,
               CASE WHEN succeeded THEN amount_due END AS gross_revenue,
               CASE WHEN succeeded AND NOT refunded THEN amount_due END AS net_revenue,
               succeeded AS is_paid, NOT succeeded AS is_failed, succeeded AS was_paid,
               succeeded AND refunded AS is_refunded,
               CASE WHEN succeeded AND refunded THEN refunded_at END AS refunded_at,
               CASE WHEN NOT succeeded THEN 'declined' END AS failure_reason, card AS card_brand,
               'charge' AS event_name
        FROM (
          SELECT invoice_id, subscription_id, condition_name, CAST(created_at AS DATE) AS made, num_charges,
                 amount_due, is_refunded AS refunded, refunded_at, card, attempt,
                 is_paid AND attempt = num_charges AS succeeded
          FROM (SELECT i.*, {each:num_charges} AS attempt FROM subscription_invoices i) a) c""",
    "subscriptions_churn": """
        SELECT common_id, t.subscription_id, subscription_term_id, t.term_number, is_activated,
               'Conditions: ' || s.condition_name AS subscription_name, term_started_at, term_ended_at,
               cancel_requested_at, t.term_number > 1 AS is_reactivated_term
        FROM subscription_terms t JOIN subscriptions_core s ON t.subscription_id = s.subscription_id""",
    "subscription_orders": """
        SELECT k AS order_id, CASE k % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'in_transit' ELSE 'canceled' END AS status,
               CAST(d AS TIMESTAMP) AS created_at, CAST(d + 1 AS TIMESTAMP) AS confirmed_at,
               CASE WHEN k % 3 = 0 THEN CAST(d + 6 AS TIMESTAMP) END AS completed_at
        FROM base""",
    "int_subs_kafka__events": f"""
        SELECT event_id, event_name, k AS subscription_id, user_key AS common_id,
               CAST(at_day AS TIMESTAMP) AS raw_occurred_at, CAST(at_day AS TIMESTAMP) AS occurred_at,
               CASE WHEN event_id % 50 <> 0 THEN CAST(old_day AS TIMESTAMP) END AS old_renewal_at,
               CASE WHEN event_id % 50 <> 0 THEN CAST(old_day + CAST(event_id % 45 AS INT) AS TIMESTAMP) END
                 AS new_renewal_at,
               CAST(d + 60 AS TIMESTAMP) AS current_term_end_at, CAST(d AS TIMESTAMP) AS subscription_created_at,
               CASE WHEN event_id % 4 = 0 THEN 'CHANGED_BY_SYSTEM' ELSE 'CHANGED_BY_USER' END AS changed_by,
               'reason_' || CAST(event_id % 3 AS VARCHAR(20)) AS reason, 'active' AS state, 'ACTIVE' AS raw_state,
               CASE WHEN event_name = 'canceled' THEN 'USER_REQUESTED' END AS termination_type,
               CAST(k % 5 AS INT) AS condition_id, {_CONDITION} AS condition_name,
               CAST(p % 5 AS INT) AS drug_id, {_DRUG} AS drug_name, {_STRENGTH} AS drug_strength,
               CAST(4 + event_id % 4 AS INT) AS monthly_dose, event_id % 1000 AS plan_id,
               'plan ' || CAST(event_id % 1000 AS VARCHAR(20)) AS plan_name,
               CASE WHEN event_name = 'plan_change_requested' THEN (event_id + 1) % 1000 END AS new_plan_id,
               CASE WHEN event_name = 'plan_change_requested' THEN event_id % 1000 END AS old_plan_id,
               CAST(value AS DECIMAL(18,2)) AS amount_due, CAST(1 + event_id % 8 AS INT) AS attempt_number,
               event_id % 3 <> 0 AS is_succeeded, event_id % 3 = 0 AS is_failed, FALSE AS is_charge,
               FALSE AS is_refund, CASE WHEN event_id % 3 = 0 THEN 'declined' END AS failure_reason,
               event_name = 'canceled' AS cancel_at_current_term_end,
               'inv' || CAST(event_id AS VARCHAR(20)) AS invoice_id, k AS order_id
        FROM (
          SELECT k, user_key, d, event_id, event_id AS p, value, event_name, at_day,
                 at_day + CAST(event_id % 10 AS INT) AS old_day
          FROM (
            SELECT k, user_key, d, event_id, value, d + CAST((event_id * 7) % 120 AS INT) AS at_day,
                   CASE event_type WHEN 'click' THEN 'term_renewal_time_changed'
                        WHEN 'view' THEN 'upcoming_term_renewal_notified'
                        WHEN 'signup' THEN 'condition_subscription_prescription_written'
                        WHEN 'purchase' THEN 'canceled' ELSE 'plan_change_requested' END AS event_name
            FROM base JOIN events ON k = CAST(floor(event_id / 3) AS BIGINT)) x) e""",
}

#: Orders with more line items than this are numbered by the SQL text, whose windows do not hold a whole order.
HOT_ORDER = 1 << 16

_EACH = re.compile(r"\{each:(.*?)\}", re.S)


def sql_text(name: str, each: str) -> str:
    """The SELECT of one derived table; ``each`` is the dialect's row generator, e.g. ``f(1, {n})``."""
    return _EACH.sub(lambda m: each.replace("{n}", m.group(1)), TEXTS[name])


class StandIn:
    """Derived source tables over one folder of driver tables, built on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._read(name) if name in DRIVER_TABLES else self._derive(name)
        return self._built[name]

    def _read(self, name: str) -> DataFrame:
        return self._spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{self._folder}/{name}.parquet")

    def _derive(self, name: str) -> DataFrame:
        if name == "numbered_lines":
            return self._cold_lines.unionByName(self._hot_lines)
        if name == "subscription_plan_terms":  # joined apart: the ordinary orders' lines already lie by order
            ordinary = self._sql(name, {"numbered_lines": self._cold_lines})
            hot_base = self["base"].join(F.broadcast(self._hot_orders), F.col("k") == F.col("l_orderkey"), "left_semi")
            return ordinary.unionByName(self._sql(name, {"base": hot_base, "numbered_lines": self._hot_lines}))
        return self._sql(name)

    def _sql(self, name: str, given: Mapping[str, DataFrame] | None = None) -> DataFrame:
        text = sql_text(name, "explode(sequence(1, {n}))")
        inputs = {}
        for source in (*DRIVER_TABLES, *TEXTS):
            text, used = re.subn(rf"\b(FROM|JOIN)\s+{source}\b", rf"\1 {{{source}}}", text)
            if used:
                inputs[source] = given[source] if given and source in given else self[source]
        return self._spark.sql(text, **inputs)

    @cached_property
    def _hot_orders(self) -> DataFrame:
        """Keys of orders with more than ``HOT_ORDER`` line items: at most one for so many rows, so they may be broadcast."""
        counts = self["lineitem"].where("l_orderkey IS NOT NULL").groupBy("l_orderkey").agg(F.count("*").alias("n"))
        return counts.where(F.col("n") > HOT_ORDER).select("l_orderkey")

    @cached_property
    def _hot_lines(self) -> DataFrame:
        lines = self["lineitem"].join(F.broadcast(self._hot_orders), "l_orderkey", "left_semi")
        return self._sql("numbered_lines", {"lineitem": lines})

    @cached_property
    def _cold_lines(self) -> DataFrame:
        """The rows of ``numbered_lines`` for all other orders. Their line items are exchanged once, by order: numbers, counts
        and the join to orders all read that one exchange."""
        line = self["lineitem"].where(_KNOWN_LINE).join(F.broadcast(self._hot_orders), "l_orderkey", "left_anti")
        items = line.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
        pieces = 4 * int(self._spark.conf.get("spark.sql.shuffle.partitions"))  # small ones: a task sorts and counts its piece
        items = items.repartition(pieces, "l_orderkey").distinct()
        place = Window.partitionBy("l_orderkey").orderBy("line", F.col("p") % 64, "p", "s")
        numbered = items.select("l_orderkey", "p", "s", F.row_number().over(place).cast("bigint").alias("n"))
        return numbered.join(items.groupBy("l_orderkey").agg(F.count("*").alias("n_plans")), "l_orderkey")
