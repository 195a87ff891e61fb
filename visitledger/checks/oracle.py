"""Shared SQL of the cross-checks: the domain views as common table expressions, written for DuckDB."""

from __future__ import annotations

VIEWS = {
    "lines": """
        SELECT CAST(l_shipdate AS DATE) AS service_date, s_name AS provider_raw,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS charge_amount,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS pri_adjustment,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS pri_payment,
               CASE WHEN l_quantity <= 4 THEN 'FUNCTIONAL INITIAL' WHEN l_quantity <= 8 THEN 'FUNCTIONAL'
                    WHEN l_quantity <= 12 THEN 'NEXUS' WHEN l_quantity <= 15 THEN 'DOT EXAM'
                    WHEN l_quantity <= 18 THEN 'PHYSICAL' WHEN l_quantity <= 26 THEN '99213'
                    WHEN l_quantity <= 30 THEN '99203' WHEN l_quantity <= 34 THEN '99395'
                    WHEN l_quantity <= 38 THEN 'G0438' WHEN l_quantity <= 42 THEN '90471'
                    WHEN l_quantity <= 45 THEN 'VACCINE ADMIN' ELSE '36415' END AS procedure_code,
               l_returnflag, CAST(l_orderkey AS VARCHAR) AS encounter_id, CAST(o_custkey AS VARCHAR) AS patient_id,
               l_orderkey || '-' || l_linenumber AS epid, l_linestatus AS line_status
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey""",
    "ranked": """
        SELECT *, procedure_code || ' ' || l_returnflag AS code_text,
               row_number() OVER (PARTITION BY line_status, epid ORDER BY service_date, provider_raw, charge_amount,
                   pri_adjustment, pri_payment, procedure_code, l_returnflag, encounter_id, patient_id) AS rn
        FROM lines""",
    "derived": """
        SELECT *, CAST(service_date + ((5 - isodow(service_date) + 7) % 7)::INT AS DATE) AS week,
               CASE WHEN pri_adjustment = 0 AND pri_payment = 0 AND charge_amount > 0
                    THEN CAST(charge_amount * 0.3287 AS DECIMAL(22,6))
                    ELSE CAST(charge_amount - pri_adjustment AS DECIMAL(22,6)) END AS allowed,
               pri_payment AS revenue
        FROM ranked""",
    "charges": "SELECT *, CAST(allowed * 0.90 AS DECIMAL(22,6)) AS revenue_model FROM derived WHERE line_status = 'F' AND rn = 1",
    "drafts": """
        SELECT DISTINCT * EXCLUDE (rn) FROM derived WHERE line_status = 'O'""",
    "alias": """
        SELECT upper(trim(s_name)) AS alias_norm, n_name AS canonical FROM supplier JOIN nation ON n_nationkey = s_nationkey
        UNION ALL VALUES ('SIGNUP','NATION_0'), ('VIEW','NATION_1'), ('PURCHASE','NATION_2'), ('CLICK','NATION_3')""",
    "exams": """
        SELECT *, CAST(service_date + ((5 - isodow(service_date) + 7) % 7)::INT AS DATE) AS week,
               CAST(CASE focused WHEN '1-5' THEN 200 WHEN '6-10' THEN 280 WHEN '11-15' THEN 370 WHEN '16+' THEN 480 ELSE 0 END
               + CASE opinions WHEN '1-3' THEN 150 WHEN '4-6' THEN 260 WHEN '7-9' THEN 330 WHEN '10-12' THEN 350
                    WHEN '13-15' THEN 465 WHEN '16-18' THEN 525 WHEN '19+' THEN 600 ELSE 0 END
               + CASE WHEN tbi IN ('1', 'r-tbi', 'tbi') THEN 250 ELSE 0 END
               + CASE genmed WHEN '1-5' THEN 180 WHEN '6-10' THEN 360 WHEN '11-15' THEN 520 WHEN '16+' THEN 700 ELSE 0 END
               + CASE WHEN is_no_show THEN 60 ELSE 0 END AS DECIMAL(18,2)) AS exam_revenue
        FROM (SELECT 'cid_' || event_id AS case_id, CAST(user_id AS VARCHAR) AS patient_id, CAST(ts AS DATE) AS service_date,
                     event_type AS provider_raw, event_type = 'error' AS is_no_show,
                     CASE WHEN value < 5 THEN 'lab' WHEN value < 15 THEN '0' WHEN value < 40 THEN '1-5'
                          WHEN value < 80 THEN '6-10' WHEN value < 150 THEN '11-15' ELSE '16+' END AS focused,
                     CASE WHEN value < 2 THEN '' WHEN value < 10 THEN '0' WHEN value < 25 THEN '1-3' WHEN value < 45 THEN '4-6'
                          WHEN value < 60 THEN '7-9' WHEN value < 80 THEN '10-12' WHEN value < 110 THEN '13-15'
                          WHEN value < 160 THEN '16-18' ELSE '19+' END AS opinions,
                     CASE WHEN value < 20 THEN '0' WHEN value < 50 THEN '1' ELSE 'r-tbi' END AS tbi,
                     CASE WHEN value < 8 THEN 'BP check' WHEN value < 12 THEN '0' WHEN value < 30 THEN '1-5'
                          WHEN value < 70 THEN '6-10' WHEN value < 120 THEN '11-15' ELSE '16+' END AS genmed
              FROM events)""",
    "points": """
        SELECT service_date, provider_raw, week, charge_amount, allowed, epid, line_status, source, code_text,
               CASE WHEN code_text LIKE '%FUNCTIONAL%' AND code_text LIKE '%INITIAL%' THEN 3.75
                    WHEN code_text LIKE '%FUNCTIONAL%' THEN 2.50
                    WHEN code_text LIKE '%NEXUS%' OR charge_amount = 200 THEN 2.50
                    WHEN code_text LIKE '%DOT%' THEN 1.00
                    WHEN regexp_matches(code_text, '992[01][1-5]') THEN 1.30
                    WHEN regexp_matches(code_text, '993[89][0-9]') THEN 1.30
                    WHEN code_text LIKE '%ANNUAL%' OR code_text LIKE '%PHYSICAL%' THEN 1.30
                    WHEN regexp_matches(code_text, '90[4-7][0-9]{2}') OR code_text LIKE '%VACCINE%' OR code_text LIKE '%ADMIN%' THEN 0.50
                    ELSE 0.00 END AS rvu,
               CASE WHEN code_text LIKE '%FUNCTIONAL%' AND code_text LIKE '%INITIAL%' THEN 'Func Med Initial'
                    WHEN code_text LIKE '%FUNCTIONAL%' THEN 'Func Med Subsequent'
                    WHEN code_text LIKE '%NEXUS%' OR charge_amount = 200 THEN 'Nexus Letter'
                    WHEN code_text LIKE '%DOT%' THEN 'DOT Physical'
                    WHEN regexp_matches(code_text, '992[01][1-5]') THEN 'Primary Care Visit'
                    WHEN regexp_matches(code_text, '993[89][0-9]') THEN 'Primary Care Visit'
                    WHEN code_text LIKE '%ANNUAL%' OR code_text LIKE '%PHYSICAL%' THEN 'Primary Care Visit'
                    WHEN regexp_matches(code_text, '90[4-7][0-9]{2}') OR code_text LIKE '%VACCINE%' OR code_text LIKE '%ADMIN%' THEN 'Vaccine Only'
                    ELSE 'Other/Unclassified' END AS category
        FROM (SELECT service_date, provider_raw, week, charge_amount, allowed, epid, line_status, code_text, 'confirmed' AS source FROM charges
              UNION ALL
              SELECT service_date, provider_raw, week, charge_amount, allowed, epid, line_status, code_text, 'pipeline' FROM drafts
              WHERE epid NOT IN (SELECT epid FROM charges))""",
    "exam_points": """
        SELECT *, CASE WHEN is_no_show THEN 0.75 WHEN opinions IN ('0', '') THEN 2.50
                       WHEN opinions IN ('1-3', '1-5', '1', '2', '3') THEN 4.50 ELSE 6.50 END AS rvu,
               CASE WHEN is_no_show THEN 'No Show' WHEN opinions IN ('0', '') THEN 'VA Exam (0 IMOs)'
                    WHEN opinions IN ('1-3', '1-5', '1', '2', '3') THEN 'VA Exam (1-3 IMOs)' ELSE 'VA Exam (4+ IMOs)' END AS category
        FROM exams""",
    "fact": """
        SELECT service_date, coalesce(canonical, upper(trim(provider_raw))) AS provider, CAST(rvu AS DECIMAL(8,2)) AS rvu,
               category, source, week
        FROM (SELECT service_date, provider_raw, rvu, category, source, week FROM points
              UNION ALL SELECT service_date, provider_raw, rvu, category, 'confirmed', week FROM exam_points) u
        LEFT JOIN alias ON alias_norm = upper(trim(provider_raw))
        WHERE service_date >= DATE '1995-03-01'""",
    "registry": "SELECT 'NATION_' || i AS provider, i AS seq FROM range(25) t(i)",
    "money_fact": """
        SELECT service_date, coalesce(canonical, upper(trim(provider_raw))) AS provider, CAST(rvu AS DECIMAL(8,2)) AS rvu, revenue, week
        FROM (SELECT service_date, provider_raw, rvu, allowed AS revenue, week FROM points WHERE source = 'confirmed'
              UNION ALL SELECT service_date, provider_raw, rvu, CAST(exam_revenue AS DECIMAL(22,6)), week FROM exam_points) u
        LEFT JOIN alias ON alias_norm = upper(trim(provider_raw))
        WHERE service_date >= DATE '1995-03-01' AND coalesce(canonical, upper(trim(provider_raw))) IN (SELECT provider FROM registry)""",
    "owner_base": """
        SELECT week, provider, rvu FROM fact WHERE source = 'confirmed' AND week <= DATE '2001-08-08'""",
    "owner_weeks": "SELECT DISTINCT week FROM owner_base",
    "owner_grid": """
        SELECT w.week, r.provider, r.seq,
               CAST(coalesce(s.rvu, 0) AS DOUBLE)
               + CASE WHEN r.provider = 'NATION_0' THEN CAST(216 AS DOUBLE) / (SELECT count(*) FROM owner_weeks) ELSE 0 END AS rvu
        FROM owner_weeks w CROSS JOIN registry r
        LEFT JOIN (SELECT week, provider, sum(rvu) AS rvu FROM owner_base GROUP BY ALL) s
               ON s.week = w.week AND s.provider = r.provider""",
    "owner_company": "SELECT week, sum(rvu) AS rvu FROM owner_grid GROUP BY week",
    "first_visit": "SELECT patient_id, min(service_date) AS first_visit FROM charges GROUP BY patient_id",
    "visits_unique": """
        SELECT patient_id, service_date, provider_raw, first(is_no_show ORDER BY case_id) AS is_no_show
        FROM exams GROUP BY patient_id, service_date, provider_raw""",
}


def friday(day: str) -> str:
    return f"CAST({day} + ((5 - isodow({day}) + 7) % 7)::INT AS DATE)"


def threshold(week: str, before: int, after: int) -> str:
    return f"CASE WHEN {week} >= DATE '1998-07-03' THEN {after} ELSE {before} END"


def payout(points: str) -> str:
    return (f"(greatest(0, least({points}, 95) - 80) * 25.0::DOUBLE + greatest(0, least({points}, 110) - 95) * 30.0::DOUBLE"
            f" + greatest(0, {points} - 110) * 35.0::DOUBLE)")


def build(body: str, money: tuple[str, ...] = (), ratio: tuple[str, ...] = (), digits: int = 6,
          ints: tuple[str, ...] = ()) -> str:
    """Full statement: the views, the body, and the output types (cents, rounded doubles, 64-bit counts)."""
    needed = ", ".join(f"{name} AS ({sql})" for name, sql in VIEWS.items())
    casts = [f"CAST(CAST({c} AS DECIMAL(28,2)) AS DOUBLE) AS {c}" for c in money]
    casts += [f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in ratio]
    casts += [f"CAST({c} AS BIGINT) AS {c}" for c in ints]
    replaced = f" REPLACE ({', '.join(casts)})" if casts else ""
    return f"WITH {needed}, body AS ({body}) SELECT *{replaced} FROM body"
