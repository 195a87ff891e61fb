"""Domain views over the shared star-schema tables, and the configuration that fits their value ranges.

charges: order lines (confirmed `F`, draft `O`), exams and appointments: events, bank: orders, provider
names: suppliers, whose canonical name is their nation.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitledger.config import PracticeConfig, Threshold, Tier, literal_table
from visitledger.functions import dates
from visitledger.operators.dedup import keep_first
from visitledger.session import shared_dir
from visitledger.sources.loaders import derive_charges, derive_exams

EXAM_ALIASES = (("SIGNUP", "NATION_0"), ("VIEW", "NATION_1"), ("PURCHASE", "NATION_2"), ("CLICK", "NATION_3"))

CONFIG = PracticeConfig(
    as_of=date(2001, 8, 15),
    providers=tuple(f"NATION_{i}" for i in range(25)),
    fact_start=date(1995, 3, 1),
    forecast_start=date(1995, 1, 1),
    campaign_start=date(1995, 7, 1),
    exam_start=date(2024, 1, 1),
    outlier_weeks=(date(2001, 3, 2), date(2001, 5, 4), date(2001, 6, 15)),
    thresholds=(Threshold(date(1, 1, 1), 190, 330, 6, 10), Threshold(date(1998, 7, 3), 150, 280, 7, 12)),
    tiers=(Tier(80, 95, 25), Tier(95, 110, 30), Tier(110, None, 35)),
    adjusted_provider="NATION_0",
    hidden_providers=("NATION_7",),
    quarter_costs=((1995, 1, 9569), (1996, 2, 11223), (1998, 3, 13752), (2001, 3, 13063), (2024, 1, 13063)),
    exam_groups=(("a", "click"), ("b", "view")),
    exam_cap=300,
    name_fragments=("supplier",),
    earliest_date=date(1995, 2, 1),
    display_names=(("U1", "First, NP"),),
)

# Upper quantity bound -> procedure code of a line.
CODE_BY_QUANTITY = (
    (4, "FUNCTIONAL INITIAL"), (8, "FUNCTIONAL"), (12, "NEXUS"), (15, "DOT EXAM"), (18, "PHYSICAL"),
    (26, "99213"), (30, "99203"), (34, "99395"), (38, "G0438"), (42, "90471"), (45, "VACCINE ADMIN"),
)
LAST_CODE = "36415"
#: Supplier names up to this number (some 50 MB) may be sent to all tasks.
FEW_SUPPLIERS = 1 << 19


# Column types of the shared tables; given, so that no file is opened to plan a query.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,"
              " o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
                " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
                " l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf.rstrip('/')}/{name}.parquet")


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    """`(alias_norm, canonical)`: supplier name -> nation, exam provider -> nation."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    names = table(spark, sf, "supplier").join(nations, "s_nationkey").select(
        F.upper(F.trim("s_name")).alias("alias_norm"), F.col("n_name").alias("canonical"))
    return names.unionByName(literal_table(spark, EXAM_ALIASES, ("alias_norm", "canonical")))


def _code() -> str:
    arms = " ".join(f"WHEN l_quantity <= {bound} THEN '{name}'" for bound, name in CODE_BY_QUANTITY)
    return f"CASE {arms} ELSE '{LAST_CODE}' END"


def _cents(value: Column) -> Column:
    return value.cast("decimal(18,2)")


_CHARGE = "CAST(l_extendedprice AS DECIMAL(18,2))"
_ZERO = "CAST(0 AS DECIMAL(18,2))"


def lines(spark: SparkSession, sf: str, status: str | None = None, with_patient: bool = True) -> DataFrame:
    """Typed charge lines, not yet unique by line id. The join to the orders is left out when no report
    needs the patient."""
    return _as_lines(_items(spark, sf, status, with_patient), with_patient)


def _items(spark: SparkSession, sf: str, status: str | None, with_patient: bool, few_suppliers: bool = False) -> DataFrame:
    items = table(spark, sf, "lineitem")
    if status:
        items = items.filter(f"l_linestatus = '{status}'")
    suppliers = table(spark, sf, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_name")
    joined = items.join(F.broadcast(suppliers) if few_suppliers else suppliers, "l_suppkey")
    if with_patient:
        joined = joined.join(table(spark, sf, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey"), "l_orderkey")
    return joined


def _as_lines(joined: DataFrame, with_patient: bool) -> DataFrame:
    return joined.selectExpr(
        "CAST(l_shipdate AS DATE) AS service_date",
        "s_name AS provider_raw",
        f"{_CHARGE} AS charge_amount",
        f"CAST({_CHARGE} * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS pri_adjustment",
        f"{_ZERO} AS sec_adjustment", f"{_ZERO} AS oth_adjustment",
        f"CAST({_CHARGE} * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS pri_payment",
        f"{_ZERO} AS sec_payment", f"{_ZERO} AS oth_payment", f"{_ZERO} AS pat_payment", f"{_ZERO} AS other_adjustment",
        f"{_code()} AS procedure_code",
        f"concat_ws(' ', {_code()}, l_returnflag) AS code_text",
        "CAST(l_orderkey AS STRING) AS encounter_id",
        f"CAST({'o_custkey' if with_patient else 'NULL'} AS STRING) AS patient_id",
        "concat_ws('-', l_orderkey, l_linenumber) AS epid",
    )


def stored_lines(spark: SparkSession, sf: str, status: str | None = None) -> DataFrame:
    """`lines`, joined once and stored, for jobs that pull them several times. Suppliers go to all tasks if few are counted."""
    few = table(spark, sf, "supplier").count() <= FEW_SUPPLIERS
    joined = _items(spark, sf, status, True, few)
    rows, path = joined.select(*[c for c in joined.columns if c not in ("l_partkey", "l_suppkey", "l_linestatus")]), shared_dir(spark, "lines")
    rows.write.option("compression", "zstd").parquet(path)
    return _as_lines(spark.read.schema(rows.schema).parquet(path), True)


def charges(spark: SparkSession, sf: str, with_patient: bool = True) -> DataFrame:
    """Confirmed charges as the loader delivers them: unique by line id, derived columns added."""
    return derive_charges(keep_first(lines(spark, sf, "F", with_patient), ["epid"]), CONFIG)


def drafts(spark: SparkSession, sf: str, with_patient: bool = True) -> DataFrame:
    return derive_charges(lines(spark, sf, "O", with_patient).dropDuplicates(), CONFIG)


def _band(bounds: tuple[tuple[float, str], ...], last: str) -> Column:
    arms = " ".join(f"WHEN value < {bound} THEN '{name}'" for bound, name in bounds)
    return F.expr(f"CASE {arms} ELSE '{last}' END")


def raw_exams(spark: SparkSession, sf: str) -> DataFrame:
    """Events as exam rows; the bands follow the event value, errors are no-shows."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("cid_"), F.col("event_id").cast("string")).alias("case_id"),
        F.col("user_id").cast("string").alias("patient_id"),
        F.col("ts").cast("date").alias("service_date"),
        F.col("event_type").alias("provider_raw"),
        _band(((5, "lab"), (15, "0"), (40, "1-5"), (80, "6-10"), (150, "11-15")), "16+").alias("focused"),
        _band(((2, ""), (10, "0"), (25, "1-3"), (45, "4-6"), (60, "7-9"), (80, "10-12"), (110, "13-15"),
                      (160, "16-18")), "19+").alias("opinions"),
        _band(((20, "0"), (50, "1")), "r-tbi").alias("tbi"),
        _band(((8, "BP check"), (12, "0"), (30, "1-5"), (70, "6-10"), (120, "11-15")), "16+").alias("genmed"),
        F.when(F.col("event_type") == "error", F.lit("1.0")).otherwise(F.lit("0")).alias("no_show"),
    )


def exams(spark: SparkSession, sf: str) -> DataFrame:
    return derive_exams(raw_exams(spark, sf))


def bank(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("entry_date"), _cents(F.col("o_totalprice")).alias("amount"))


def supplemental(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders as extra exam payments."""
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return urgent.select(F.col("o_orderdate").cast("date").alias("pay_date"), _cents(F.col("o_totalprice")).alias("amount"))


def appointments(spark: SparkSession, sf: str) -> DataFrame:
    """Half-hour appointments of the user as provider, in clinic time; errors cancelled, sign-ups missed."""
    status = F.when(F.col("event_type") == "error", F.lit("Cancelled")).when(
        F.col("event_type") == "signup", F.lit("No Show")).otherwise(F.lit("Confirmed"))
    start = dates.clinic_local(F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("provider"),
        start.alias("start_at"), (start + F.expr("INTERVAL 30 MINUTES")).alias("end_at"), status.alias("status"))


def schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Every user works Monday to Friday, 8:00 to 17:00, with a break from 12 to 13."""
    users = table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("provider")).distinct()
    return users.select(
        "provider", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("day_of_week"),
        F.lit(8).alias("start_hour"), F.lit(0).alias("start_minute"), F.lit(17).alias("end_hour"),
        F.lit(0).alias("end_minute"), F.lit(30).alias("slot_minutes"), F.lit(12).alias("break_start_hour"),
        F.lit(13).alias("break_end_hour"), F.lit(True).alias("is_active"))


def days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("ts").cast("date").alias("day")).distinct()
