"""Domain indicators, reports, and the staged models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import kpi
from strata.plans.registry import query
from strata.quality import relations
from strata.tables import VIEWS, view, view_sql, with_views
from strata.warehouse import marts

AS_OF = "2024-06-30"
ENTITIES = {domain: list(tables) for domain, tables in kpi.DOMAINS.items()}
OVERVIEW = {
    "health": ["patients", "encounters", "lab_results", "providers"], "finance": ["accounts", "transactions", "loan_applications"],
    "tech": ["servers", "incidents", "deployments", "metrics", "applications"],
    "university": ["students", "faculty", "courses", "enrollments", "research_grants", "departments"],
}


def _data(spark: SparkSession, sf: str, domain: str) -> dict[str, DataFrame]:
    return {name: view(spark, sf, name) for name in ENTITIES[domain]}


def _figure(entity: str, metric: str, expression: str) -> str:
    return f"SELECT '{entity}' AS entity, '{metric}' AS metric, NULL::VARCHAR AS category, CAST({expression} AS DOUBLE) AS value FROM {entity}"


def _spread(entity: str, metric: str, column: str, where: str = "true") -> str:
    return f"SELECT '{entity}', '{metric}', {column}, CAST(count(*) AS DOUBLE) FROM {entity} WHERE {where} GROUP BY {column}"


def _money(column: str) -> str:
    return f"CAST({column} AS DECIMAL(18,2))"


def _rate(condition: str) -> str:
    return f"round(count(CASE WHEN {condition} THEN 1 END) / count(*), 4)"


_AGE = f"floor(date_diff('day', date_of_birth, DATE '{AS_OF}') / 365)"
KPI_SQL = {
    "health": [
        _figure("patients", "total_patients", "count(*)"), _figure("patients", "active_patients", "count(CASE WHEN NOT is_deceased THEN 1 END)"),
        _figure("patients", "avg_patient_age", f"round(avg({_AGE}), 1)"), _figure("patients", "patient_age_std", f"round(stddev_samp({_AGE}), 1)"),
        _figure("encounters", "total_encounters", "count(*)"), _figure("encounters", "avg_encounter_charge", f"round(sum({_money('total_charges')}) / count(*), 2)"),
        _spread("encounters", "encounters_by_type", "encounter_type"), _figure("lab_results", "total_lab_results", "count(*)"),
        _figure("lab_results", "abnormal_lab_rate", _rate("abnormal_flag")), _figure("lab_results", "critical_lab_rate", _rate("critical_flag")),
    ],
    "finance": [
        _figure("accounts", "total_accounts", "count(*)"), _figure("accounts", "total_balance", f"sum({_money('current_balance')})"),
        _figure("accounts", "avg_balance", f"round(sum({_money('current_balance')}) / count(*), 2)"), _figure("accounts", "avg_aml_risk_score", "round(avg(aml_risk_score), 2)"),
        _figure("accounts", "high_risk_accounts", "count(CASE WHEN aml_risk_score > 50 THEN 1 END)"), _spread("accounts", "accounts_by_type", "account_type"),
        _figure("transactions", "total_transactions", "count(*)"), _figure("transactions", "total_transaction_volume", f"sum(abs({_money('amount')}))"),
        _figure("transactions", "avg_transaction_amount", f"round(sum(abs({_money('amount')})) / count(*), 2)"), _figure("transactions", "flagged_transaction_rate", _rate("is_flagged")),
        _figure("loan_applications", "total_loan_applications", "count(*)"), _figure("loan_applications", "loan_approval_rate", _rate("status = 'APPROVED'")),
        _figure("loan_applications", "total_loan_volume_requested", f"sum({_money('requested_amount')})"),
    ],
    "tech": [
        _figure("servers", "total_servers", "count(*)"), _figure("servers", "server_availability_rate", _rate("status = 'RUNNING'")),
        _spread("servers", "servers_by_status", "status"), _spread("servers", "servers_by_environment", "environment"),
        _figure("incidents", "total_incidents", "count(*)"), _figure("incidents", "mttr_minutes", "round(avg(time_to_resolve_minutes), 2)"),
        _figure("incidents", "incident_resolution_rate", _rate("status IN ('RESOLVED', 'CLOSED')")), _spread("incidents", "incidents_by_severity", "severity"),
        _figure("deployments", "total_deployments", "count(*)"), _figure("deployments", "deployment_success_rate", _rate("status = 'SUCCESS'")),
        _figure("deployments", "avg_deployment_duration_seconds", "round(avg(duration_seconds), 2)"),
        _figure("metrics", "avg_cpu_usage", f"round(sum({_money('cpu_usage_pct')}) / count(cpu_usage_pct), 2)"), _figure("metrics", "max_cpu_usage", "round(max(cpu_usage_pct), 2)"),
        _figure("metrics", "avg_memory_usage", "round(avg(memory_used_pct), 2)"), _figure("metrics", "max_memory_usage", "max(memory_used_pct)"),
    ],
    "university": [
        _figure("students", "total_students", "count(*)"), _figure("students", "avg_gpa", "round(sum(gpa) / count(gpa), 2)"), _figure("students", "gpa_std", "round(stddev_samp(gpa), 2)"),
        _figure("students", "honors_students", "count(CASE WHEN gpa >= 3.5 THEN 1 END)"), _figure("students", "retention_rate", _rate("enrollment_status = 'ACTIVE'")),
        _spread("students", "students_by_status", "enrollment_status"), _spread("students", "students_by_level", "academic_level"),
        _figure("faculty", "total_faculty", "count(*)"), _figure("faculty", "total_publications", "sum(publications_count)"),
        _figure("faculty", "avg_publications_per_faculty", "round(avg(publications_count), 2)"), _spread("faculty", "faculty_by_rank", "rank"),
        _figure("courses", "total_courses", "count(*)"), _figure("courses", "total_course_enrollment", "sum(enrolled_count)"),
        _figure("courses", "avg_course_fill_rate", "round(avg(enrolled_count / coalesce(capacity, 1)), 4)"),
        _figure("enrollments", "total_enrollments", "count(*)"),
        _figure("enrollments", "pass_rate", "round(count(CASE WHEN status = 'COMPLETED' AND grade <> 'F' THEN 1 END) / count(CASE WHEN status = 'COMPLETED' THEN 1 END), 4)"),
        _spread("enrollments", "grade_distribution", "grade", "grade <> ''"),
        _figure("research_grants", "total_grants", "count(*)"), _figure("research_grants", "total_grant_funding", f"sum({_money('total_amount')})"),
        _figure("research_grants", "active_grants", "count(CASE WHEN status = 'ACTIVE' THEN 1 END)"),
    ],
}
EXTRA_SQL = {
    "health": [_figure("patients", "international_patients", "count(CASE WHEN false THEN 1 END)"), _spread("patients", "gender_distribution", "gender")],
    "finance": [_spread("loan_applications", "loans_by_status", "status")],
}


def _register(domain: str) -> None:
    # Aliases in the first branch name the columns of the union.
    sql = f"{with_views(*ENTITIES[domain])} {' UNION ALL '.join(KPI_SQL[domain])}"

    @query(f"kpi_{domain}", sql)
    def kpis(spark: SparkSession, sf: str) -> DataFrame:
        return kpi.domain_kpis(domain, _data(spark, sf, domain), AS_OF)

    summary = ["server_availability_rate" if m == "availability_rate" else m for m in kpi.SUMMARIES[domain]]
    places = [("Summary", m) for m in summary] + [(s, m) for s, ms in kpi.SECTIONS.items() for m in ms]
    listed = ", ".join(f"('{s}', '{m}')" for s, m in places)
    rows = " UNION ALL ".join(KPI_SQL[domain] + EXTRA_SQL.get(domain, []))

    @query(f"report_{domain}", f"""{with_views(*ENTITIES[domain])}, k AS ({rows}), p(section, metric) AS (VALUES {listed})
        SELECT '{domain}' AS report, p.section, k.metric, k.category, k.value FROM k JOIN p ON k.metric = p.metric""")
    def report(spark: SparkSession, sf: str) -> DataFrame:
        return kpi.report(domain, _data(spark, sf, domain), AS_OF)


for _domain in kpi.DOMAINS:
    _register(_domain)


@query("overview", " UNION ALL ".join(
    f"SELECT '{d}' AS domain, '{e}' AS entity, count(*) AS records FROM ({view_sql(e)})" for d, es in OVERVIEW.items() for e in es))
def overview(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.overview({d: {e: view(spark, sf, e) for e in es} for d, es in OVERVIEW.items()})


_STG_P = r"""SELECT patient_id, 'Customer' AS first_name, last_name, first_name || ' ' || last_name AS full_name, date_of_birth, gender, NULL::VARCHAR AS blood_type, city, state, NOT is_deceased AS is_active FROM patients"""
_STG_E = "SELECT encounter_id, patient_id, provider_id, encounter_type, encounter_date, total_charges, 0 AS diagnosis_count FROM encounters"
# The encounters of every third patient go to a patient that does not exist, so that some patients have none.
_STRAY = "CASE WHEN patient_id % 3 = 0 THEN -patient_id ELSE patient_id END"
_INT_P = f"""SELECT p.*, coalesce(n, 0) AS encounter_count, coalesce(c, 0)::DOUBLE AS total_charges FROM ({_STG_P}) p
    LEFT JOIN (SELECT {_STRAY} AS pid, count(*) AS n, sum({_money('total_charges')}) AS c FROM ({_STG_E}) GROUP BY 1) ON p.patient_id = pid"""
_HEALTH = with_views("patients", "encounters")


@query("stg_patients", _HEALTH + _STG_P)
def stg_patients(spark: SparkSession, sf: str) -> DataFrame:
    return marts.stg_patients(view(spark, sf, "patients"))


@query("stg_encounters", _HEALTH + _STG_E)
def stg_encounters(spark: SparkSession, sf: str) -> DataFrame:
    return marts.stg_encounters(view(spark, sf, "encounters"))


@query("int_patient_encounters", _HEALTH + _INT_P)
def int_patient_encounters(spark: SparkSession, sf: str) -> DataFrame:
    return marts.int_patient_encounters(stg_patients(spark, sf), stg_encounters(spark, sf).withColumn("patient_id", F.expr(_STRAY)))


@query("mart_patient_summary", _HEALTH + f"""
    SELECT patient_id, full_name, state, is_active, encounter_count, total_charges, CASE WHEN encounter_count > 0 THEN ((2 * CAST(round(total_charges * 100) AS BIGINT) + encounter_count) // (2 * encounter_count)) / 100 ELSE 0 END AS avg_charge_per_encounter,
           CASE WHEN total_charges > 10000 THEN 'High Value' WHEN total_charges > 1000 THEN 'Medium Value' ELSE 'Low Value' END AS patient_segment
    FROM ({_INT_P})""")
def mart_patient_summary(spark: SparkSession, sf: str) -> DataFrame:
    return marts.mart_patient_summary(int_patient_encounters(spark, sf))


_STG_A = "SELECT account_number AS account_id, customer_id, account_type, current_balance, status, NULL::DATE AS opened_date FROM accounts"
_STG_T = "SELECT transaction_id, account_id, transaction_type, amount, transaction_date, merchant_name AS merchant, merchant_category AS category, is_flagged, fraud_score FROM transactions"
_INT_A = f"""SELECT a.*, coalesce(n, 0) AS transaction_count, coalesce(d, 0)::DOUBLE AS total_debit, coalesce(c, 0)::DOUBLE AS total_credit, coalesce(f, 0) AS flagged_transactions FROM ({_STG_A}) a
    LEFT JOIN (SELECT account_id AS aid, count(*) AS n, sum(CASE WHEN amount < 0 THEN -{_money('amount')} END) AS d, sum(CASE WHEN amount >= 0 THEN {_money('amount')} END) AS c,
               count(CASE WHEN is_flagged THEN 1 END) AS f FROM ({_STG_T}) GROUP BY account_id) ON a.account_id = aid"""
_FINANCE = with_views("accounts", "transactions")


@query("stg_accounts", _FINANCE + _STG_A)
def stg_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return marts.stg_accounts(view(spark, sf, "accounts"))


@query("stg_transactions", _FINANCE + _STG_T)
def stg_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return marts.stg_transactions(view(spark, sf, "transactions"))


@query("int_account_transactions", _FINANCE + _INT_A)
def int_account_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return marts.int_account_transactions(stg_accounts(spark, sf), stg_transactions(spark, sf))


@query("mart_account_summary", _FINANCE + f"""
    SELECT account_id, customer_id, account_type, current_balance, transaction_count, round(total_credit - total_debit, 2) AS net_flow,
           CASE WHEN transaction_count > 0 THEN round(flagged_transactions / transaction_count, 4) ELSE 0 END AS flagged_rate,
           CASE WHEN flagged_transactions > 5 THEN 'HIGH' WHEN flagged_transactions > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
           CASE WHEN current_balance > 0 THEN 'GOOD' WHEN current_balance > -1000 THEN 'WARNING' ELSE 'CRITICAL' END AS account_health
    FROM ({_INT_A})""")
def mart_account_summary(spark: SparkSession, sf: str) -> DataFrame:
    return marts.mart_account_summary(int_account_transactions(spark, sf))


@query("relationships", with_views("students", "faculty", "courses", "enrollments", "departments") + """
    SELECT c.term, f.department, count(*) AS enrollments, count(DISTINCT e.student_id) AS students, count(s.student_id) AS known_students
    FROM enrollments e JOIN courses c ON e.course_id = c.course_id LEFT JOIN faculty f ON c.instructor_id = f.faculty_id LEFT JOIN students s ON e.student_id = s.student_id
    GROUP BY c.term, f.department""")
def relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Declared foreign keys as plain joins: enrollment to course to instructor, and to student."""
    rows = (
        view(spark, sf, "enrollments")
        .join(view(spark, sf, "courses").select("course_id", "term", "instructor_id"), "course_id")
        .join(view(spark, sf, "faculty").select(F.col("faculty_id").alias("instructor_id"), "department"), "instructor_id", "left")
        .join(view(spark, sf, "students").select("student_id", F.lit(1).alias("known")), "student_id", "left")
    )
    return rows.groupBy("term", "department").agg(
        F.count(F.lit(1)).alias("enrollments"), F.count_distinct("student_id").alias("students"), F.count("known").alias("known_students"))


_RELATIONS = relations.present(relations.RELATIONS, {name: list(v.columns) for name, v in VIEWS.items()})


@query("relationship_audit", with_views(*sorted({t for r in _RELATIONS for t in (r.child, r.parent)})) + " UNION ALL ".join(f"""
    SELECT '{r.name}' AS relation, '{r.child}' AS child, '{r.parent}' AS parent, count(*) AS children, count(*) - count(k) AS nulls, count(CASE WHEN k IS NOT NULL AND p IS NULL THEN 1 END) AS orphans,
           count(DISTINCT CASE WHEN p IS NULL THEN k END) AS orphan_keys, (SELECT count(DISTINCT {r.key}) FROM {r.parent}) AS parents
    FROM (SELECT CAST({r.column} AS VARCHAR) AS k FROM {r.child}) LEFT JOIN (SELECT DISTINCT CAST({r.key} AS VARCHAR) AS p FROM {r.parent}) ON k = p""" for r in _RELATIONS))
def relationship_audit(spark: SparkSession, sf: str) -> DataFrame:
    """All declared relations whose two sides are there, in one pass."""
    return relations.audit(lambda name: view(spark, sf, name), _RELATIONS)


assert set(e for es in OVERVIEW.values() for e in es) <= set(VIEWS)
