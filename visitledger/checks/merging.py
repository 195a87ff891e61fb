"""Cross-checks of de-duplication, incremental merges, unions and the draft filter."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from visitledger.checks.oracle import build
from visitledger.checks.registry import check
from visitledger.functions import dates
from visitledger.operators import dedup, merge
from visitledger.plans import facts, sync
from visitledger.sources import shared_tables as V
from visitledger.sources import tables

COLUMNS = ("epid", "service_date", "provider_raw", "charge_amount", "procedure_code")


def _existing(spark, sf):
    """Stored lines: returns and accepted ones."""
    return V.lines(spark, sf).filter(~F.endswith("code_text", F.lit("N")))


def _pulled(spark, sf):
    """A new pull: open lines, some of which overlap the stored keys."""
    return V.lines(spark, sf).filter(F.endswith("code_text", F.lit("N")))


FIRST = """row_number() OVER (PARTITION BY epid ORDER BY {pre}service_date, provider_raw, charge_amount, pri_adjustment,
           pri_payment, procedure_code, l_returnflag, encounter_id, patient_id) = 1"""


@check("unique_lines", "W10 U4", build(f"""
    SELECT epid, service_date, provider_raw, charge_amount, procedure_code FROM lines QUALIFY {FIRST.format(pre='')}""",
    money=("charge_amount",)))
def unique_lines(spark, sf):
    return dedup.keep_first(V.lines(spark, sf), ["epid"]).select(*COLUMNS)


@check("unique_lines_latest_pull", "W10 G4", build(f"""
    SELECT epid, service_date, provider_raw, charge_amount, procedure_code, l_returnflag FROM lines
    QUALIFY {FIRST.format(pre='l_returnflag, ')}""", money=("charge_amount",)))
def unique_lines_latest_pull(spark, sf):
    tagged = V.lines(spark, sf).withColumn("l_returnflag", F.element_at(F.split("code_text", " "), -1))
    return dedup.keep_first(tagged, ["epid"], order_by=["l_returnflag"]).select(*COLUMNS, "l_returnflag")


@check("keyless_lines_kept", "W10 U3 G2", build("""
    SELECT count(*) AS n, count(epid) AS keyed FROM (
        SELECT CASE WHEN procedure_code <> 'NEXUS' THEN epid END AS epid FROM lines
        QUALIFY row_number() OVER (PARTITION BY CASE WHEN procedure_code <> 'NEXUS' THEN epid
            ELSE concat_ws('|', service_date, provider_raw, charge_amount, pri_adjustment, pri_payment, l_returnflag, encounter_id) END) = 1)"""))
def keyless_lines_kept(spark, sf):
    lines = V.lines(spark, sf).withColumn(
        "epid", F.when(F.col("procedure_code") != "NEXUS", F.col("epid")).otherwise(F.lit(" ")))
    kept = dedup.keep_first(lines, ["epid"])
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim("epid") != "").alias("keyed"))


@check("exact_distinct", "U3", build("""
    SELECT DISTINCT epid, service_date, provider_raw, charge_amount, procedure_code FROM lines""", money=("charge_amount",)))
def exact_distinct(spark, sf):
    return V.lines(spark, sf, with_patient=False).select(*COLUMNS).dropDuplicates()


@check("drafts_not_confirmed", "J1 U2 F3", build("""
    SELECT epid, service_date, charge_amount FROM drafts WHERE epid NOT IN (SELECT epid FROM charges)""", money=("charge_amount",)))
def drafts_not_confirmed(spark, sf):
    pending = merge.not_confirmed(V.drafts(spark, sf), V.lines(spark, sf, "F", False), "epid")
    return pending.select("epid", "service_date", "charge_amount")


@check("draft_overlap", "J13", build("""
    SELECT count(DISTINCT epid) AS overlap FROM lines WHERE line_status = 'O' AND epid IN (SELECT epid FROM lines WHERE line_status = 'F')"""))
def draft_overlap(spark, sf):
    return merge.overlap_count(V.lines(spark, sf, "O", False), V.lines(spark, sf, "F", False), "epid")


@check("merge_by_line_id", "J2 U5 G5", build(f"""
    SELECT epid, service_date, provider_raw, charge_amount, procedure_code, l_returnflag = 'N' AS is_new FROM lines
    QUALIFY {FIRST.format(pre="l_returnflag = 'N', ")}""", money=("charge_amount",)))
def merge_by_line_id(spark, sf):
    narrower = _existing(spark, sf).drop("other_adjustment")
    return merge.merge_by_key(narrower, _pulled(spark, sf), "epid").select(*COLUMNS, "is_new")


@check("lines_to_append", "J2", build(f"""
    SELECT epid, service_date, provider_raw, charge_amount, procedure_code FROM lines
    WHERE l_returnflag = 'N' AND epid NOT IN (SELECT epid FROM lines WHERE l_returnflag <> 'N')
    QUALIFY {FIRST.format(pre='')}""", money=("charge_amount",)))
def lines_to_append(spark, sf):
    return merge.rows_to_append(_existing(spark, sf), _pulled(spark, sf), "epid").select(*COLUMNS)


@check("lines_to_append_by_columns", "J2 G6", build(f"""
    SELECT epid, service_date, provider_raw, charge_amount, procedure_code FROM lines n
    WHERE l_returnflag = 'N' AND NOT EXISTS (
        SELECT 1 FROM lines e WHERE e.l_returnflag <> 'N' AND e.service_date = n.service_date AND e.encounter_id = n.encounter_id
           AND e.procedure_code = n.procedure_code)
    QUALIFY {FIRST.format(pre='')}""", money=("charge_amount",)))
def lines_to_append_by_columns(spark, sf):
    columns = ("service_date", "encounter_id", "procedure_code")
    keyless = _existing(spark, sf).withColumn("epid", F.lit(""))
    return merge.additions(keyless, _pulled(spark, sf), "epid", columns).select(*COLUMNS)


@check("merge_exams", "J3 U5", build("""
    SELECT case_id, provider_raw, service_date, is_new FROM (
        SELECT 'cid_' || (event_id // 2) AS case_id, event_type AS provider_raw, CAST(ts AS DATE) AS service_date, event_type = 'click' AS is_new
        FROM events)
    QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY is_new, provider_raw, service_date) = 1"""))
def merge_exams(spark, sf):
    rows = V.table(spark, sf, "events").select(
        F.concat(F.lit("cid_"), F.expr("event_id div 2").cast("string")).alias("case_id"),
        F.col("event_type").alias("provider_raw"), F.col("ts").cast("date").alias("service_date"))
    clicked = F.col("provider_raw") == "click"
    return merge.merge_by_key(rows.filter(~clicked), rows.filter(clicked), "case_id")


@check("fact_rows", "R1 U1 U2 F1 F3", build("""
    SELECT source, category, provider, count(*) AS n, sum(rvu) AS rvu, min(week) AS first_week, max(week) AS last_week
    FROM fact GROUP BY ALL""", money=("rvu",)))
def fact_rows(spark, sf):
    fact = facts.rvu_fact(V.charges(spark, sf), V.exams(spark, sf), V.aliases(spark, sf), V.CONFIG, V.drafts(spark, sf))
    return fact.groupBy("source", "category", "provider").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rvu").alias("rvu"), F.min("week").alias("first_week"), F.max("week").alias("last_week"))


@check("fact_rows_by_selector", "R1 F3", build("""
    SELECT 'pc' AS selector, count(*) AS n, sum(rvu) AS rvu FROM fact WHERE NOT (service_date >= DATE '2024-01-01')
    UNION ALL SELECT 'va', count(*), sum(rvu) FROM fact WHERE service_date >= DATE '2024-01-01'""", money=("rvu",)))
def fact_rows_by_selector(spark, sf):
    inputs = (V.charges(spark, sf), V.exams(spark, sf), V.aliases(spark, sf), V.CONFIG, V.drafts(spark, sf))
    parts = [
        facts.rvu_fact(*inputs, source=s).agg(F.count(F.lit(1)).alias("n"), F.sum("rvu").alias("rvu")).select(
            F.lit(s).alias("selector"), "n", "rvu") for s in ("pc", "va")]
    return parts[0].unionByName(parts[1])


def _audit(spark, sf):
    """Events read as sync runs: sign-ups still running, errors failed."""
    event = F.col("event_type")
    status = F.when(event == "error", "error").when(event == "signup", "running").otherwise("success")
    done = F.col("ts").cast("timestamp")
    return V.table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("sync_type"), status.alias("status"),
        F.when(event != "signup", done).alias("completed_at"), F.col("ts").cast("date").alias("last_sync_date"))


@check("latest_success", "T6 S15", build("""
    SELECT 'U' || user_id AS sync_type, max(ts) AS completed_at, CAST(max(ts) AS DATE) AS last_sync_date
    FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1"""))
def latest_success(spark, sf):
    return tables.latest_success(_audit(spark, sf)).withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz"))


@check("sync_rollup", "S19 S15", build("""
    SELECT CASE WHEN bool_and(event_type <> 'error') THEN 'success' ELSE 'partial_error' END AS overall_status
    FROM (SELECT user_id, last(event_type ORDER BY ts) AS event_type FROM events WHERE event_type <> 'signup' GROUP BY 1)"""))
def sync_rollup(spark, sf):
    return tables.overall_status(_audit(spark, sf))


_WINDOW = (date(1994, 1, 1), date(1996, 12, 31))


@check("sync_rejects", "R25 S15 S16", build("""
    WITH w AS (SELECT epid, l_returnflag <> 'N' AND service_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' AS inside FROM lines)
    SELECT 'fetched' AS measure, count(*) AS n FROM w WHERE inside
    UNION ALL SELECT 'refused', count(*) FROM w WHERE NOT inside
    UNION ALL SELECT 'added', count(DISTINCT epid) FROM w WHERE inside
    UNION ALL SELECT 'stored', count(DISTINCT epid) FROM w WHERE inside
    UNION ALL SELECT 'rejected', count(DISTINCT epid) FROM w WHERE NOT inside
    UNION ALL SELECT 'added again', 0"""))
def sync_rejects(spark, sf):
    """Lines with code flag N have no readable date here; they and lines outside the window are kept apart, none is lost."""
    from visitledger.checks.scalars import DEMO_KEY
    from visitledger.session import shared_dir
    from visitledger.sources import schemas

    back = {typed: header for header, typed in schemas.CHARGE_HEADERS.items()}
    lines = V.stored_lines(spark, sf)
    day = F.when(F.endswith("code_text", F.lit("N")), F.lit("soon")).otherwise(dates.us_date_text(F.col("service_date")))
    raw = lines.withColumn("service_date", day).select(*[F.col(c).cast("string").alias(back[c]) for c in lines.columns])
    root = shared_dir(spark, "sync-rejects")
    table, audit = f"{root}/charges", f"{root}/audit"
    first, again = [
        sync.sync_charges(spark, raw, table, audit, V.CONFIG, DEMO_KEY, now=lambda: datetime(2001, 8, 15), window=_WINDOW)
        for _ in range(2)]
    for result in (first, again):
        if result.status != "success":
            raise RuntimeError(result.error_message)
    rows = [("fetched", first.records_fetched), ("refused", first.records_rejected), ("added", first.records_new), ("added again", again.records_new),
            ("stored", spark.read.parquet(table).count()), ("rejected", spark.read.parquet(f"{table}-rejected").count())]
    return spark.createDataFrame(rows, "measure string, n long")


@check("incremental_sync", "R25 S11 S15 J2", build("""
    SELECT 'first' AS run, count(*) AS fetched, count(DISTINCT epid) AS added FROM lines WHERE l_returnflag <> 'N'
    UNION ALL
    SELECT 'second', count(*), count(DISTINCT CASE WHEN epid NOT IN (SELECT epid FROM lines WHERE l_returnflag <> 'N') THEN epid END) FROM lines
    UNION ALL SELECT 'third', count(*), 0 FROM lines
    UNION ALL SELECT 'stored', count(DISTINCT epid), count(DISTINCT date_trunc('month', d)) FROM
        (SELECT epid, first(service_date ORDER BY l_returnflag = 'N', service_date, provider_raw, charge_amount, pri_adjustment, pri_payment, procedure_code, l_returnflag) AS d FROM lines GROUP BY epid)"""))
def incremental_sync(spark, sf):
    from visitledger.checks.scalars import DEMO_KEY
    from visitledger.session import shared_dir
    from visitledger.sources import schemas

    back = {typed: header for header, typed in schemas.CHARGE_HEADERS.items()}
    lines = V.stored_lines(spark, sf)
    raw = lines.withColumn("service_date", dates.us_date_text(F.col("service_date"))).select(
        *[F.col(c).cast("string").alias(back[c]) for c in lines.columns])
    root = shared_dir(spark, "sync-check")
    table, audit = f"{root}/charges", f"{root}/audit"
    pulls = {"first": raw.filter(~F.endswith("`Procedure Codes with Modifiers`", F.lit("N"))), "second": raw, "third": raw}
    rows = []
    for run, pull in pulls.items():
        result = sync.sync_charges(spark, pull, table, audit, V.CONFIG, DEMO_KEY, now=lambda: datetime(2001, 8, 15))
        if result.status != "success":
            raise RuntimeError(result.error_message)
        rows.append((run, result.records_fetched, result.records_new))
    stored = spark.read.parquet(table).agg(
        F.lit("stored").alias("run"), F.count(F.lit(1)).alias("fetched"), F.count_distinct("service_month").alias("added"))
    return spark.createDataFrame(rows, "run string, fetched long, added long").unionByName(stored)
