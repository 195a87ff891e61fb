"""Cross-checks of row functions, loaders and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitledger.checks.oracle import build, friday, payout, threshold
from visitledger.checks.registry import check
from visitledger.functions import dates, money, pii, rules
from visitledger.functions.sql import register_functions
from visitledger.plans import facts
from visitledger.plans.scheduling import best_reviews
from visitledger.sources import files, loaders, schemas, tables
from visitledger.sources import shared_tables as V

DEMO_KEY = b"demo-key-for-cross-checks-only"


def _raw_charges(spark, sf, status="F"):
    """The lines as an export file would hold them: text, with currency marks and US dates."""
    lines = V.lines(spark, sf, status)
    as_text = {
        "service_date": dates.us_date_text(F.col("service_date")),
        "charge_amount": F.concat(F.lit("$"), F.format_number("charge_amount", 2)),
        "pri_adjustment": F.format_number("pri_adjustment", 2),
        "pri_payment": F.concat(F.lit(" "), F.col("pri_payment").cast("string"), F.lit(" ")),
        "pat_payment": F.lit("n/a"),
    }
    back = {typed: header for header, typed in schemas.CHARGE_HEADERS.items()}
    return lines.withColumns(as_text).select(*[F.col(c).cast("string").alias(back[c]) for c in lines.columns])


@check("charges_loaded", "S1 S2 P4 P5 P7 P8 P9 P10 P11 U3 U4 W10", build("""
    SELECT epid, service_date, week, procedure_code, code_text, charge_amount, pri_adjustment AS total_adjustments,
           pri_payment AS total_payments, allowed, revenue_model FROM charges""",
    money=("charge_amount", "total_adjustments", "total_payments", "allowed", "revenue_model")))
def charges_loaded(spark, sf):
    loaded = loaders.load_charges(_raw_charges(spark, sf), V.CONFIG)
    return loaded.select("epid", "service_date", "week", "procedure_code", "code_text", "charge_amount",
                         "total_adjustments", "total_payments", "allowed", "revenue_model")


@check("drafts_loaded", "S5 P4 P5 U3 G10", build("""
    SELECT DISTINCT epid, service_date, week, code_text, charge_amount, pri_payment AS total_payments, allowed, 'draft' AS charge_status
    FROM drafts""", money=("charge_amount", "total_payments", "allowed")))
def drafts_loaded(spark, sf):
    loaded = loaders.load_drafts(_raw_charges(spark, sf, "O"), V.CONFIG)
    return loaded.select("epid", "service_date", "week", "code_text", "charge_amount", "total_payments", "allowed",
                         "charge_status").dropDuplicates()


@check("charge_csv_lines", "S1 S2 P1", build("""
    SELECT epid, service_date, charge_amount, pri_payment FROM charges""", money=("charge_amount", "pri_payment")))
def charge_csv_lines(spark, sf):
    raw = _raw_charges(spark, sf)
    line = raw.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in raw.columns])).alias("line"))
    schema = schemas.all_strings([f"c{i}" for i in range(len(raw.columns))])
    cells = line.select(F.from_csv("line", schema.simpleString()[7:-1].replace(":", " ")).alias("r")).select("r.*")
    named = cells.select(*[F.col(f"c{i}").alias(name) for name, i in files.unique_headers(raw.columns).items()])
    return loaders.load_charges(named, V.CONFIG).select("epid", "service_date", "charge_amount", "pri_payment")


@check("date_texts", "P5 P6", build("""
    SELECT epid, CASE WHEN l_returnflag IN ('A', 'N', 'R') THEN service_date END AS parsed,
           month(service_date) || '/' || day(service_date) || '/' || year(service_date) AS exported, CAST(NULL AS DATE) AS unreadable,
           service_date AS named, service_date AS day_named, service_date AS day_dashed, service_date AS compact, service_date AS dotted,
           CASE WHEN day(service_date) > 12 THEN service_date ELSE make_date(year(service_date), day(service_date), month(service_date)) END AS day_first
    FROM ranked"""))
def date_texts(spark, sf):
    day = F.col("service_date")
    text = (
        F.when(F.endswith("code_text", F.lit("A")), F.date_format(day, "M/d/yyyy"))
        .when(F.endswith("code_text", F.lit("N")), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(day, "MM/dd/yyyy"))
    )
    forms = {"named": "MMMM d, yyyy", "day_named": "d MMM yyyy", "day_dashed": "dd-MMMM-yyyy", "compact": "yyyyMMdd", "dotted": "M.d.yyyy",
             "day_first": "d/M/yyyy"}
    written = V.lines(spark, sf).select(
        "epid", text.alias("text"), F.concat(F.lit("on "), text).alias("prefixed"),
        *[F.date_format(day, form).alias(name) for name, form in forms.items()])
    read = written.select(
        "epid", dates.parse_date(F.col("text")).alias("parsed"), dates.parse_date(F.col("prefixed")).alias("unreadable"),
        *[dates.parse_date(F.col(name)).alias(name) for name in forms])
    return read.select("epid", "parsed", dates.us_date_text(F.col("parsed")).alias("exported"), "unreadable", *forms)


@check("elected_dates", "P5 S4", build("""
    SELECT epid, l_returnflag AS file, CASE WHEN procedure_code <> 'NEXUS' THEN service_date END AS service_date,
           procedure_code = 'NEXUS' AS refused FROM lines"""))
def elected_dates(spark, sf):
    """Three files, two of them with the day first; each file's own unambiguous dates decide how its others are read."""
    day, file = F.col("service_date"), F.element_at(F.split("code_text", " "), -1)
    text = F.when(F.col("procedure_code") == "NEXUS", F.lit("soon")).when(file == "A", F.date_format(day, "d/M/yyyy")).when(
        file == "R", F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "M/d/yyyy"))
    landed = V.lines(spark, sf).select("epid", file.alias("file"), text.alias("text"))
    read = dates.with_elected_dates(landed, "text", ["file"], "service_date")
    refused = (F.trim("text") != "") & F.col("service_date").isNull()
    return read.select("epid", "file", "service_date", refused.alias("refused"))


@check("calendar_keys", "P11 P20 P21 P22 P24", build(f"""
    SELECT DISTINCT service_date, {friday('service_date')} AS week_friday,
           CAST(service_date + ((1 - isodow(service_date) + 7) % 7)::INT AS DATE) AS week_monday,
           CAST(service_date + ((7 - isodow(service_date)) % 7)::INT AS DATE) AS week_sunday,
           CAST(date_trunc('month', service_date) AS DATE) AS month_start,
           'Q' || quarter(service_date) || ' ' || year(service_date) AS quarter_label,
           year(service_date) || 'Q' || quarter(service_date) AS quarter_key,
           strftime(service_date, '%Y-%m') || CASE WHEN day(service_date) <= 15 THEN '-H1' ELSE '-H2' END AS half_month,
           CAST(service_date - CAST(date_trunc('quarter', service_date) AS DATE) + 1 AS INT) AS days_elapsed,
           CAST(CAST(date_trunc('quarter', service_date) + INTERVAL 3 MONTH AS DATE) - CAST(date_trunc('quarter', service_date) AS DATE) AS INT) AS days_in_quarter,
           CAST(isodow(service_date) - 1 AS INT) AS weekday_index, strftime(service_date, '%a') AS weekday_name
    FROM lines"""))
def calendar_keys(spark, sf):
    day = F.col("service_date")
    start = dates.quarter_start(day)
    return V.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("service_date")).distinct().select(
        "service_date", dates.week_end(day).alias("week_friday"), dates.week_end(day, "MON").alias("week_monday"),
        dates.week_end(day, "SUN").alias("week_sunday"), dates.month_start(day).alias("month_start"),
        dates.quarter_label(day).alias("quarter_label"), dates.quarter_key(day).alias("quarter_key"),
        dates.half_month_key(day).alias("half_month"), (F.date_diff(day, start) + 1).alias("days_elapsed"),
        F.date_diff(dates.next_quarter_start(day), start).alias("days_in_quarter"),
        dates.weekday_index(day).alias("weekday_index"), F.date_format(day, "E").alias("weekday_name"))


@check("provider_names", "P3 P23 J9", build("""
    SELECT coalesce(canonical, upper(trim(raw))) AS provider, count(*) AS n,
           upper(left(coalesce(canonical, upper(trim(raw))), 1)) || lower(substr(coalesce(canonical, upper(trim(raw))), 2)) AS display
    FROM (SELECT '  ' || lower(provider_raw) || ' ' AS raw FROM lines UNION ALL SELECT provider_raw FROM exams) u
    LEFT JOIN alias ON alias_norm = upper(trim(raw)) GROUP BY ALL"""))
def provider_names(spark, sf):
    lines = V.lines(spark, sf, with_patient=False).select(
        F.concat(F.lit("  "), F.lower("provider_raw"), F.lit(" ")).alias("provider_raw"))
    counted = lines.unionByName(V.raw_exams(spark, sf).select("provider_raw")).groupBy("provider_raw").agg(
        F.count(F.lit(1)).alias("n"))
    named = rules.with_canonical_provider(counted, "provider_raw", V.aliases(spark, sf))
    return named.groupBy("provider").agg(F.sum("n").alias("n")).withColumn("display", rules.display_name(F.col("provider")))


@check("clinical_rules", "P13 P14 P17", build("""
    SELECT epid, code_text, rvu, category FROM points
    WHERE line_status = 'F'""", money=("rvu",)))
def clinical_rules(spark, sf):
    charges = V.charges(spark, sf, with_patient=False).withColumn(
        "code_text", rules.codes_with_modifiers(
            F.col("procedure_code"), F.element_at(F.split("code_text", " "), -1), F.lit(" "), F.lit(None).cast("string")))
    return facts.charge_points(charges, V.CONFIG).select("epid", "code_text", "rvu", "category")


@check("exam_fees", "S3 P2 P12 P15 P28", build("""
    SELECT case_id, service_date, week, exam_revenue, is_no_show, rvu, category FROM exam_points""",
    money=("exam_revenue", "rvu")))
def exam_fees(spark, sf):
    back = {typed: header for header, typed in schemas.EXAM_HEADERS.items()}
    typed = V.raw_exams(spark, sf)
    raw = typed.select(*[
        F.col(c).cast("string").alias(back[c]) for c in typed.columns if c in back and c != "provider_raw"],
        F.when(F.startswith("provider_raw", F.lit("c")), F.col("provider_raw")).alias("Provider"),
        F.col("provider_raw").alias("Legacy Provider "))
    exams = loaders.load_exams(files.repair_provider_header(raw, ("Legacy Provider ",)), V.CONFIG)
    return facts.exam_points(exams).select(
        "case_id", "service_date", "week", "exam_revenue", "is_no_show", "rvu", "category")


@check("hashed_ids", "P16", build(f"""
    SELECT c_custkey, 'pid_' || substr(sha256(unhex('{bytes(b ^ 0x5C for b in DEMO_KEY.ljust(64, bytes(1))).hex()}')
             || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in DEMO_KEY.ljust(64, bytes(1))).hex()}') || encode(CAST(c_custkey AS VARCHAR))))), 1, 32) AS patient_id,
           'cid_kept' AS kept
    FROM customer"""))
def hashed_ids(spark, sf):
    rows = V.table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("patient_id"), F.lit("cid_kept").alias("kept"))
    return pii.hash_columns_builtin(rows, {"patient_id": "pid_", "kept": "cid_"}, DEMO_KEY)


@check("hashed_ids_arrow", "P16", build(f"""
    SELECT c_custkey, 'pid_' || substr(sha256(unhex('{bytes(b ^ 0x5C for b in DEMO_KEY.ljust(64, bytes(1))).hex()}')
             || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in DEMO_KEY.ljust(64, bytes(1))).hex()}') || encode(CAST(c_custkey AS VARCHAR))))), 1, 32) AS patient_id
    FROM customer"""))
def hashed_ids_arrow(spark, sf):
    rows = V.table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("patient_id"))
    return pii.hash_columns(rows, {"patient_id": "pid_"}, DEMO_KEY)


@check("clinic_times", "P18 P19 S9", build("""
    SELECT event_id, CAST(date_trunc('second', ts) - INTERVAL 5 HOUR AS TIMESTAMP) AS start_at,
           CAST(date_trunc('second', ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS end_at,
           ltrim(strftime(date_trunc('second', ts) - INTERVAL 5 HOUR, '%I:%M %p'), '0') AS label,
           CASE event_type WHEN 'error' THEN 'Cancelled' ELSE 'Confirmed' END AS status
    FROM events"""))
def clinic_times(spark, sf):
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    record = F.struct(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("StartDate"),
        F.date_format(ts + F.expr("INTERVAL 30 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss").alias("EndDate"),
        F.when(F.col("event_type") == "error", "Cancelled").otherwise("Confirmed").alias("ConfirmationStatus"))
    payload = V.table(spark, sf, "events").select(
        "event_id", F.to_xml(record, {"rowTag": "AppointmentData"}).alias("xml"))
    rows = files.parse_appointment_xml(payload, "xml", keep=("event_id",))
    return rows.select("event_id", "start_at", "end_at", dates.slot_label(F.col("start_at")).alias("label"), "status")


@check("charge_xml_records", "S6 P17", build("""
    SELECT epid, month(service_date) || '/' || day(service_date) || '/' || year(service_date) AS service_date, provider_raw,
           CAST(charge_amount AS VARCHAR) AS charge, procedure_code, code_text, encounter_id, patient_id
    FROM ranked WHERE line_status = 'F'"""))
def charge_xml_records(spark, sf):
    lines = V.lines(spark, sf, "F")
    record = F.struct(
        F.date_format("service_date", "yyyy-MM-dd'T'HH:mm:ss").alias("ServiceStartDate"),
        F.col("provider_raw").alias("RenderingProviderName"), F.col("charge_amount").cast("string").alias("TotalCharges"),
        F.col("procedure_code").alias("ProcedureCode"), F.lit(" ").alias("ProcedureModifier1"),
        F.element_at(F.split("code_text", " "), -1).alias("ProcedureModifier2"),
        F.col("encounter_id").alias("EncounterID"), F.col("patient_id").alias("PatientID"),
        F.col("epid").alias("EncounterProcedureID"))
    rows = files.parse_charge_xml(lines.select(F.to_xml(record, {"rowTag": "ChargeData"}).alias("xml")), "xml")
    return rows.select(
        F.col("`Encounter Procedure ID`").alias("epid"), F.col("`Date Of Service`").alias("service_date"),
        F.col("`Rendering Provider`").alias("provider_raw"), F.col("`Service Charge Amount`").alias("charge"),
        F.col("`Procedure Code`").alias("procedure_code"), F.col("`Procedure Codes with Modifiers`").alias("code_text"),
        F.col("`Encounter ID`").alias("encounter_id"), F.col("`Patient ID`").alias("patient_id"))


@check("sheet_positions", "S8", build("""
    SELECT case_id, provider_raw, CAST(service_date AS VARCHAR) AS service_date, focused, opinions, tbi, genmed,
           CASE WHEN is_no_show THEN '1.0' ELSE '0' END AS no_show FROM exams WHERE provider_raw <> 'signup'"""))
def sheet_positions(spark, sf):
    rows = V.raw_exams(spark, sf)
    blank = F.when(F.col("provider_raw") == "signup", F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("case_id")))
    filled = {0: blank, 1: F.col("provider_raw"), 3: F.col("service_date").cast("string"), 4: F.col("focused"),
              5: F.col("opinions"), 6: F.col("tbi"), 7: F.col("genmed"), 15: F.col("no_show")}
    cells = rows.select(*[filled.get(i, F.lit("x")).alias(f"_c{i}") for i in range(16)])
    return files.sheet_rows(cells).withColumnsRenamed(schemas.EXAM_HEADERS)


@check("appointment_reasons", "S10", build("""
    SELECT CAST(event_id AS VARCHAR) AS id, event_type AS name,
           CASE WHEN event_type = 'error' THEN 30 ELSE CAST(floor(value) AS INT) END AS duration_minutes FROM events"""))
def appointment_reasons(spark, sf):
    duration = F.when(F.col("event_type") == "error", F.lit("soon")).otherwise(F.floor("value").cast("string"))
    record = F.struct(F.col("event_id").cast("string").alias("ID"), F.col("event_type").alias("Name"), duration.alias("Duration"))
    payload = V.table(spark, sf, "events").select(F.to_xml(record, {"rowTag": "AppointmentReasonData"}).alias("xml"))
    return files.parse_reason_xml(payload, "xml")


@check("markup_only", "P36", build("""
    SELECT page_id, regexp_replace(html, '>([^<]+)<', '><', 'g') AS markup FROM pages"""))
def markup_only(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", rules.markup_only(F.col("html")).alias("markup"))


@check("five_star_reviews", "S18 F11 T4", build("""
    SELECT 'U' || user_id AS author_name, event_type AS text, epoch_us(ts) AS time
    FROM events WHERE event_type <> 'error' AND value >= 100 ORDER BY ts DESC, 'U' || user_id DESC LIMIT 10"""))
def five_star_reviews(spark, sf):
    review = F.struct(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("author_name"),
        F.when(F.col("value") >= 100, 5).otherwise(3).alias("rating"),
        F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(F.col("event_type")).alias("text"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("time"))
    payload = F.to_json(F.struct(F.lit("OK").alias("status"), F.struct(F.array(review).alias("reviews")).alias("result")))
    parsed = V.table(spark, sf, "events").select(F.from_json(payload, schemas.REVIEW_PAYLOAD).alias("p")).select("p.*")
    return best_reviews(files.review_rows(parsed)).select("author_name", "text", "time")


@check("weekly_targets", "P25 J9", build(f"""
    SELECT DISTINCT week, {threshold('week', 190, 150)} AS company_breakeven, {threshold('week', 330, 280)} AS company_target,
           {threshold('week', 6, 7)} AS provider_breakeven, {threshold('week', 10, 12)} AS provider_target
    FROM ranked JOIN (SELECT DISTINCT service_date AS d, {friday('service_date')} AS week FROM lines) ON d = service_date"""))
def weekly_targets(spark, sf):
    week = dates.week_end(F.col("l_shipdate").cast("date"))
    weeks = V.table(spark, sf, "lineitem").select(week.alias("week")).distinct()
    return weeks.select("week", *[
        rules.threshold(F.col("week"), m, V.CONFIG).alias(m)
        for m in ("company_breakeven", "company_target", "provider_breakeven", "provider_target")])


@check("quarter_payouts", "P26 P27 P31 P32 P33 P34 P35", build(f"""
    SELECT provider, quarter, cost, points, {payout('points')} AS payout, projected, {payout('floor(projected)')} AS projected_payout,
           CASE WHEN revenue > 0 THEN points / revenue * 1000 ELSE 0 END AS points_per_thousand,
           least(greatest(points, 20), 60) AS clipped
    FROM (SELECT provider, quarter, cost, floor(CAST(total AS DOUBLE)) AS points, floor(CAST(total AS DOUBLE)) * 91 / 46 AS projected,
                 CAST(total_revenue AS DOUBLE) AS revenue
          FROM (SELECT provider, year(service_date) || 'Q' || quarter(service_date) AS quarter,
                       CASE year(service_date) * 10 + quarter(service_date) WHEN 19951 THEN 9569 WHEN 19962 THEN 11223
                            WHEN 19983 THEN 13752 WHEN 20013 THEN 13063 WHEN 20241 THEN 13063 ELSE 9569 END AS cost,
                       sum(rvu) AS total, sum(revenue) AS total_revenue
                FROM money_fact GROUP BY ALL))""",
    money=("cost",), ratio=("points", "payout", "projected", "projected_payout", "points_per_thousand", "clipped")))
def quarter_payouts(spark, sf):
    fact = facts.revenue_fact(V.charges(spark, sf, False), V.exams(spark, sf), V.aliases(spark, sf), V.CONFIG)
    totals = fact.groupBy(
        "provider", dates.quarter_start(F.col("service_date")).alias("start")
    ).agg(F.sum("rvu").alias("rvu"), F.sum("revenue").alias("revenue"))
    points = F.floor(F.col("rvu").cast("double")).cast("double")
    projected = points * 91.0 / 46.0
    return totals.select(
        "provider", dates.quarter_key(F.col("start")).alias("quarter"),
        rules.weekly_cost(F.col("start"), V.CONFIG).alias("cost"), points.alias("points"),
        money.tier_payout(points, V.CONFIG.tiers).alias("payout"), projected.alias("projected"),
        money.tier_payout(F.floor(projected), V.CONFIG.tiers).alias("projected_payout"),
        (money.ratio_or_zero(points, F.col("revenue")) * 1000.0).alias("points_per_thousand"),
        money.clip(points, 20.0, 60.0).alias("clipped"))


@check("sql_functions", "2.11 P4 P11 P12 P13 P14 P27", build(f"""
    SELECT l.epid, {friday('l.service_date')} AS week, l.charge_amount AS cleaned, p.rvu, p.category, {payout('CAST(p.rvu AS DOUBLE) * 30')} AS payout
    FROM charges l JOIN points p ON p.epid = l.epid AND p.source = 'confirmed'""", money=("cleaned", "rvu"), ratio=("payout",)))
def sql_functions(spark, sf):
    register_functions(spark, V.CONFIG)
    return V.charges(spark, sf, False).selectExpr(
        "epid", "week_end(service_date) AS week", "clean_money(concat('$', format_number(charge_amount, 2))) AS cleaned",
        "rvu_value(upper(code_text), charge_amount, code_text) AS rvu",
        "rvu_category(upper(code_text), charge_amount, code_text) AS category",
        "tier_payout(cast(rvu_value(upper(code_text), charge_amount, code_text) AS double) * 30D) AS payout")


@check("sql_exam_fee", "2.11 P12", build("SELECT case_id, exam_revenue AS fee FROM exams", money=("fee",)))
def sql_exam_fee(spark, sf):
    register_functions(spark, V.CONFIG)
    return V.raw_exams(spark, sf).selectExpr(
        "case_id", "exam_fee(focused, opinions, tbi, genmed, no_show) AS fee")


@check("date_chunks", "S16 S17", build("""
    SELECT o_custkey, chunk_start, least(CAST(chunk_start + 54 AS DATE), hi) AS chunk_end
    FROM (SELECT o_custkey, hi, CAST(unnest(generate_series(lo, hi, INTERVAL 55 DAY)) AS DATE) AS chunk_start
          FROM (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY 1))"""))
def date_chunks(spark, sf):
    ranges = V.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min(F.col("o_orderdate").cast("date")).alias("lo"), F.max(F.col("o_orderdate").cast("date")).alias("hi"))
    return tables.date_chunks(ranges, "lo", "hi").select("o_custkey", "chunk_start", "chunk_end")


@check("bank_months", "S4 R27", build("""
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount, count(*) AS entries
    FROM orders GROUP BY 1""", money=("amount",)))
def bank_months(spark, sf):
    from visitledger.plans.revenue import bank_by_month

    raw = V.bank(spark, sf).select(
        dates.us_date_text(F.col("entry_date")).alias("Date"), F.format_number("amount", 2).alias("Amount"),
        F.concat(F.lit("$"), F.format_number("amount", 2)).alias("Running Bal."))
    return bank_by_month(loaders.load_bank(raw))
