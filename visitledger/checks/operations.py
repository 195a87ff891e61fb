"""Cross-checks of scheduling, data quality and stream jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitledger.checks.oracle import build, friday
from visitledger.checks.registry import check
from visitledger.operators import slots
from visitledger.plans import facts, quality, scheduling
from visitledger.session import shared_dir
from visitledger.sources import shared_tables as V
from visitledger.streaming import ingest

CFG = V.CONFIG


@check("free_slots", "R24 J11 F10 F12 P19 P24", build("""
    WITH appt AS (SELECT 'U' || user_id AS provider, ts - INTERVAL 5 HOUR AS a, ts - INTERVAL 5 HOUR + INTERVAL 30 MINUTE AS b
                  FROM events WHERE event_type NOT IN ('error', 'signup')),
    cand AS (SELECT provider, day, day + INTERVAL 8 HOUR + i * INTERVAL 30 MINUTE AS a, day + INTERVAL 8 HOUR + (i + 1) * INTERVAL 30 MINUTE AS b
             FROM (SELECT DISTINCT 'U' || user_id AS provider FROM events), (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), range(18) r(i)
             WHERE isodow(day) <= 5)
    SELECT provider, day, a AS start_at, b AS end_at, ltrim(strftime(a, '%I:%M %p'), '0') AS label FROM cand
    WHERE NOT (a < day + INTERVAL 13 HOUR AND b > day + INTERVAL 12 HOUR)
      AND NOT EXISTS (SELECT 1 FROM appt WHERE appt.provider = cand.provider AND cand.a < appt.b AND cand.b > appt.a)"""))
def free_slots(spark, sf):
    return slots.free_slots(V.schedule(spark, sf), V.days(spark, sf), V.appointments(spark, sf))


@check("schedule_list", "T2 F12", build("""
    SELECT 'U' || user_id AS provider, CAST(d AS INT) AS day_of_week FROM (SELECT DISTINCT user_id FROM events), range(5) r(d)"""))
def schedule_list(spark, sf):
    return scheduling.schedule_list(V.schedule(spark, sf)).select("provider", "day_of_week")


@check("offered_providers", "T2 P23", build("""
    SELECT DISTINCT 'U' || user_id AS provider, CASE WHEN user_id = 1 THEN 'First, NP' ELSE 'U' || user_id END AS display FROM events"""))
def offered_providers(spark, sf):
    return scheduling.active_providers(V.schedule(spark, sf), CFG)


@check("recent_requests", "T1", build("""
    SELECT event_id AS request_id, ts AS created_at, event_type FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 20"""))
def recent_requests(spark, sf):
    rows = V.table(spark, sf, "events").filter("event_type = 'signup'")
    return scheduling.recent_requests(rows.select(
        F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"), "event_type"))


@check("recent_bookings", "T1 P37", build("""
    SELECT event_id AS booking_id, ts AS created_at, CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END AS external_id,
           CASE WHEN event_type = 'purchase' THEN 'booked' ELSE 'pending' END AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 50"""))
def recent_bookings(spark, sf):
    return scheduling.recent_bookings(V.table(spark, sf, "events").select(
        F.col("event_id").alias("booking_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).alias("external_id")))


# -- data quality -------------------------------------------------------------------------------------------

_ROW = "SELECT '{t}' AS table_name, '{n}' AS check_name, {v} {op} {b} AS passed, CAST({v} AS DOUBLE) AS measured, {b}::DOUBLE AS bound FROM m"


def _checks(table: str, rows: list[tuple[str, str, str, float]]) -> str:
    return " UNION ALL ".join(_ROW.format(t=table, n=n, v=v, op=op, b=b) for n, v, op, b in rows)


@check("charge_quality", "R26 2.12 A26 U6", build("""
    WITH m AS (SELECT (SELECT count(*) FROM lines) AS n, (SELECT date_diff('day', min(service_date), max(service_date)) FROM lines) AS span,
        (SELECT count(*) FROM lines WHERE service_date < DATE '1995-02-01') AS old, (SELECT count(*) FROM lines WHERE service_date > DATE '2001-11-13') AS ahead,
        (SELECT count(*) FROM lines WHERE length(patient_id) >= 5) AS rawp, (SELECT count(*) FROM lines WHERE length(encounter_id) >= 5) AS rawe,
        (SELECT (SELECT count(*) FROM lines) - count(*) FROM (SELECT DISTINCT * EXCLUDE (line_status) FROM lines)) AS exact,
        (SELECT (SELECT count(*) FROM lines) - count(DISTINCT epid) FROM lines) AS ids,
        (SELECT (SELECT count(*) FROM lines) - count(*) FROM (SELECT DISTINCT service_date, encounter_id, procedure_code FROM lines)) AS comp)
    """ + _checks("charges", [
        ("row count", "n", ">", 1000), ("unreadable dates", "0", "<=", 0.05), ("date span days", "span", ">=", 60),
        ("dates before start", "old", "<=", 0), ("dates far ahead", "ahead", "<=", 0), ("patient_id hashed", "0", ">=", 1),
        ("patient_id raw numbers", "rawp", "<=", 0), ("encounter_id hashed", "0", ">=", 1), ("encounter_id raw numbers", "rawe", "<=", 0),
        ("service_date missing", "0", "<=", 0.1), ("provider_raw missing", "0", "<=", 0.1), ("charge_amount missing", "0", "<=", 0.1),
        ("procedure_code missing", "0", "<=", 0.1), ("rows with a known name", "1", ">=", 0.8), ("exact duplicates", "exact", "<=", 0),
        ("line id duplicates", "ids", "<=", 0), ("composite duplicates", "comp", "<=", 0), ("unknown provider names", "0", "<=", 0.05)])))
def charge_quality(spark, sf):
    return quality.charge_checks(V.lines(spark, sf), V.aliases(spark, sf), CFG)


@check("landing_quality", "R26 2.12 P3", build("""
    WITH m AS (SELECT count(*) FILTER (procedure_code = 'NEXUS') AS bad, count(*) FILTER (procedure_code <> 'NEXUS' AND CAST(charge_amount * 1.005 AS DECIMAL(20,5)) <> CAST(round(charge_amount * 1.005, 2) AS DECIMAL(20,5))) AS cents,
        count(*) FILTER (l_returnflag = 'R') AS days, (SELECT count(*) FROM (SELECT alias_norm FROM alias GROUP BY 1 HAVING count(DISTINCT canonical) > 1)) AS names FROM lines)
    """ + _checks("charges", [
        ("missing columns", "1", "<=", 0), ("duplicate columns", "1", "<=", 0), ("artifact columns", "1", "<=", 0), ("conflicting provider columns", "0", "<=", 0),
        ("Service Charge Amount unreadable", "bad", "<=", 0), ("Service Charge Amount below cents", "cents", "<=", 0), ("Pat Payment Amount unreadable", "0", "<=", 0),
        ("Pat Payment Amount below cents", "0", "<=", 0), ("Date Of Service unreadable", "days", "<=", 0)])
    + " UNION ALL " + _checks("aliases", [("conflicting names", "names", "<=", 0)])))
def landing_quality(spark, sf):
    """The lines as a raw export with a repeated, an artifact and a missing column, odd amounts and unreadable dates."""
    charge = F.when(F.col("procedure_code") == "NEXUS", F.lit("n/a")).otherwise((F.col("charge_amount") * F.lit("1.005").cast("decimal(4,3)")).cast("string"))
    raw = V.lines(spark, sf).select(
        F.when(F.endswith("code_text", F.lit("R")), F.lit("soon")).otherwise(F.col("service_date").cast("string")).alias("Date Of Service"),
        "provider_raw", charge.alias("Service Charge Amount"), F.lit(" ").alias("Pat Payment Amount"))
    header = [*(h for h in quality.REQUIRED_CHARGES if h != "Patient ID"), "Unnamed: 9", "Procedure Code"]
    parts = [
        quality.header_checks("charges", raw, header, quality.REQUIRED_CHARGES),
        quality.landing_checks("charges", raw, ("Service Charge Amount", "Pat Payment Amount"), "Date Of Service"),
        quality.alias_checks(V.aliases(spark, sf))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("exam_quality", "R26 2.12", build("""
    WITH m AS (SELECT count(*) AS n, date_diff('day', min(service_date), max(service_date)) AS span, count(*) FILTER (opinions = '') / count(*) AS blank FROM exams)
    """ + _checks("exams", [
        ("row count", "n", ">", 2000), ("unreadable dates", "0", "<=", 0.05), ("date span days", "span", ">=", 60), ("case_id hashed", "1", ">=", 1),
        ("service_date missing", "0", "<=", 0.1), ("focused missing", "0", "<=", 0.1), ("opinions missing", "blank", "<=", 0.1),
        ("exact duplicates", "0", "<=", 0), ("case id duplicates", "0", "<=", 0)]), ratio=("measured",)))
def exam_quality(spark, sf):
    return quality.exam_checks(V.raw_exams(spark, sf), CFG)


@check("draft_and_fact_quality", "R26 J13 2.12", build("""
    WITH m AS (SELECT (SELECT count(DISTINCT epid) FROM lines WHERE line_status = 'O' AND epid IN (SELECT epid FROM lines WHERE line_status = 'F')) AS overlap,
        (SELECT count(*) FILTER (rvu > 0) / count(*) FROM fact WHERE source = 'confirmed') AS positive,
        (SELECT count(*) FROM fact WHERE source = 'confirmed' AND provider NOT IN (SELECT provider FROM registry)) AS unlisted)
    """ + _checks("drafts", [("drafts already confirmed", "overlap", "<=", 0)]) + " UNION ALL " + _checks("rvu_fact", [
        ("positive points", "positive", ">=", 0.5), ("unknown categories", "0", "<=", 0), ("rows of unlisted providers", "unlisted", "<=", 0)]),
    ratio=("measured",)))
def draft_and_fact_quality(spark, sf):
    fact = facts.rvu_fact(V.charges(spark, sf, False), V.exams(spark, sf), V.aliases(spark, sf), CFG)
    return quality.draft_checks(V.lines(spark, sf, "O", False), V.lines(spark, sf, "F", False)).unionByName(
        quality.fact_checks(fact, CFG))


@check("schedule_quality", "R26 2.12", build("""
    WITH m AS (SELECT 0 AS good, count(DISTINCT user_id) AS users FROM events WHERE user_id < 10)
    """ + _checks("schedule", [
        ("day out of range", "good", "<=", 0), ("hour out of range", "good", "<=", 0), ("minute out of range", "good", "<=", 0),
        ("slot length out of range", "users * 5", "<=", 0), ("end not after start", "good", "<=", 0), ("break end not after start", "good", "<=", 0)])))
def schedule_quality(spark, sf):
    short = F.when(F.length("provider") == 2, F.lit(3)).otherwise(F.col("slot_minutes"))
    return quality.schedule_checks(V.schedule(spark, sf).withColumn("slot_minutes", short))


@check("unknown_provider_names", "U6 A26", build("""
    SELECT provider_raw, count(*) AS rows, upper(provider_raw) AS provider FROM exams WHERE upper(provider_raw) NOT IN (SELECT alias_norm FROM alias) GROUP BY 1"""))
def unknown_provider_names(spark, sf):
    return quality.unknown_providers(V.raw_exams(spark, sf), V.aliases(spark, sf), CFG)


@check("provider_mapping", "2.12 P3 A26", build("""
    SELECT provider_raw, count(*) AS rows, canonical AS provider FROM lines JOIN alias ON alias_norm = upper(provider_raw) GROUP BY ALL"""))
def provider_mapping(spark, sf):
    return quality.provider_mapping(V.lines(spark, sf, with_patient=False), V.aliases(spark, sf))


@check("provider_value_counts", "A26", build("SELECT provider_raw, count(*) AS rows FROM lines GROUP BY 1"))
def provider_value_counts(spark, sf):
    return quality.value_counts(V.lines(spark, sf, with_patient=False), "provider_raw")


@check("column_profile", "A26", build("""
    SELECT column_name, missing_share, first_date, last_date FROM
        (SELECT 'opinions' AS column_name, count(*) FILTER (opinions = '') / count(*) AS missing_share, min(service_date) AS first_date, max(service_date) AS last_date FROM exams
         UNION ALL SELECT 'focused', 0, min(service_date), max(service_date) FROM exams)""", ratio=("missing_share",)))
def column_profile(spark, sf):
    return quality.column_profile(V.raw_exams(spark, sf), ("opinions", "focused"), "service_date")


@check("origin_split", "2.12", build("""
    SELECT CASE WHEN line_status = 'F' THEN 'interface' ELSE 'manual' END AS origin, provider_raw, count(*) AS rows FROM lines GROUP BY ALL"""))
def origin_split(spark, sf):
    tagged = V.lines(spark, sf, "F", False).withColumn("encounter_id", F.concat(F.lit("eid_"), "encounter_id"))
    return quality.origin_split(tagged.unionByName(V.lines(spark, sf, "O", False)))


_NATIONS = [f"NATION_{i}" for i in range(25)]


@check("provider_months", "R26 A3 W13", build(
    "SELECT CAST(date_trunc('month', service_date) AS DATE) AS month, "
    + ", ".join(f"count(*) FILTER (canonical = '{p}') AS {p}" for p in _NATIONS)
    + " FROM lines JOIN alias ON alias_norm = upper(provider_raw) GROUP BY 1 QUALIFY row_number() OVER (ORDER BY month DESC) <= 12"))
def provider_months(spark, sf):
    return quality.provider_months(V.lines(spark, sf, with_patient=False), V.aliases(spark, sf), CFG)


@check("provider_weeks", "R26 A3 W13", build(
    "SELECT week, " + ", ".join(f"coalesce(sum(rvu) FILTER (provider = '{p}'), 0) AS {p}" for p in _NATIONS)
    + " FROM fact WHERE source = 'confirmed' AND provider IN (SELECT provider FROM registry) GROUP BY week QUALIFY row_number() OVER (ORDER BY week DESC) <= 16",
    money=tuple(_NATIONS)))
def provider_weeks(spark, sf):
    fact = facts.rvu_fact(V.charges(spark, sf, False), V.exams(spark, sf), V.aliases(spark, sf), CFG)
    return quality.provider_weeks(fact, CFG)


# -- streams ------------------------------------------------------------------------------------------------


def _event_stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    rows = ingest.file_stream(spark, f"{sf.rstrip('/')}/events.parquet", schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@check("stream_weekly_totals", "E3 E4 A1", build(f"""
    SELECT {friday('CAST(ts AS DATE)')} AS week, event_type, sum(CAST(value AS DECIMAL(18,2))) AS total, count(*) AS rows FROM events
    GROUP BY 1, 2 HAVING week + 1 <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""", money=("total",)))
def stream_weekly_totals(spark, sf):
    out, state = shared_dir(spark, "weekly-out"), shared_dir(spark, "weekly-state")
    lines = _event_stream(spark, sf).withColumn("value", F.col("value").cast("decimal(18,2)"))
    ingest.drain(ingest.weekly_totals(lines, "ts", "value", ("event_type",), "2 days"), out, state).awaitTermination()
    return spark.read.parquet(out)


@check("batch_weekly_totals", "E3 E4", build(f"""
    SELECT {friday('CAST(ts AS DATE)')} AS week, event_type, sum(CAST(value AS DECIMAL(18,2))) AS total, count(*) AS rows FROM events GROUP BY 1, 2""",
    money=("total",)))
def batch_weekly_totals(spark, sf):
    rows = V.table(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    return ingest.batch_weekly_totals(rows, "ts", "value", ("event_type",))


@check("stream_unique_lines", "E1", build("SELECT DISTINCT user_id, event_type FROM events"))
def stream_unique_lines(spark, sf):
    out, state = shared_dir(spark, "unique-out"), shared_dir(spark, "unique-state")
    keyed = _event_stream(spark, sf).withColumn("epid", F.concat_ws("-", "user_id", "event_type"))
    unique = ingest.unique_lines(keyed, "epid", "ts").select("user_id", "event_type")
    ingest.drain(unique, out, state).awaitTermination()
    return spark.read.parquet(out)


@check("stream_merge", "E2 J2 S11", build("SELECT DISTINCT 'U' || user_id AS epid FROM events"))
def stream_merge(spark, sf):
    stored, state = shared_dir(spark, "merge-table"), shared_dir(spark, "merge-state")
    keyed = _event_stream(spark, sf).select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("epid"), F.col("ts").cast("date").alias("service_date"))
    ingest.merge_into(keyed, stored, state, "epid").awaitTermination()
    return spark.read.parquet(stored).select("epid")
