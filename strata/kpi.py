"""Domain indicators as long frames (entity, metric, category, value): one aggregate for a table's figures and one for all its categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.dates import age_in_year_days
from strata.operators.aggregate import distribution, mean_ratio, share, std_or_zero

ROWS = "decimal(18,2)"


def _figures(df: DataFrame, entity: str, figures: Mapping[str, Column]) -> DataFrame:
    """Named aggregates of one table as rows; a figure over no values is left out."""
    wide = df.agg(*[c.cast("double").alias(n) for n, c in figures.items()])
    tall = wide.unpivot([], list(figures), "metric", "value").where(F.col("value").isNotNull())
    return tall.select(F.lit(entity).alias("entity"), "metric", F.lit(None).cast("string").alias("category"), "value")


def _by(df: DataFrame, entity: str, metric: str, column: str, unknown: str = "UNKNOWN") -> DataFrame:
    counts = distribution(df, column, unknown)
    return counts.select(F.lit(entity).alias("entity"), F.lit(metric).alias("metric"), F.col("value").alias("category"), F.col("n").cast("double").alias("value"))


def _by_each(df: DataFrame, entity: str, columns: Mapping[str, str], unknown: str = "UNKNOWN") -> DataFrame:
    """Counts of the values of several columns in one pass over the table, as ``distribution`` counts those of one."""
    pairs = [F.struct(F.lit(m).alias("metric"), (F.col(c).cast("string") if c in df.columns else F.lit(unknown)).alias("category")) for m, c in columns.items()]
    counts = df.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.metric", "p.category").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return counts.select(F.lit(entity).alias("entity"), "metric", "category", "value")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def _money(column: str, default_zero: bool = True) -> Column:
    value = F.col(column).cast(ROWS)
    return F.coalesce(value, F.lit(0).cast(ROWS)) if default_zero else value


COUNT = F.count


def patients(df: DataFrame, as_of: str) -> DataFrame:
    figures = {"total_patients": COUNT(F.lit(1)), "active_patients": F.count_if(~F.coalesce(F.col("is_deceased"), F.lit(False)))}
    if "date_of_birth" in df.columns:
        age = age_in_year_days("date_of_birth", F.lit(as_of)).cast("double")
        figures |= {"avg_patient_age": F.round(F.avg(age), 1), "patient_age_std": F.round(std_or_zero(age), 1)}
    return _figures(df, "patients", figures)


def encounters(df: DataFrame) -> DataFrame:
    charged = F.when(_money("total_charges", False) != 0, _money("total_charges", False))
    figures = {"total_encounters": COUNT(F.lit(1)), "avg_encounter_charge": F.round(F.avg(charged), 2)}
    return _union([_figures(df, "encounters", figures), _by(df, "encounters", "encounters_by_type", "encounter_type")])


def lab_results(df: DataFrame) -> DataFrame:
    return _figures(df, "lab_results", {
        "total_lab_results": COUNT(F.lit(1)), "abnormal_lab_rate": share(F.col("abnormal_flag")), "critical_lab_rate": share(F.col("critical_flag")),
    })


def accounts(df: DataFrame) -> DataFrame:
    balance, risk = _money("current_balance"), F.col("aml_risk_score")
    figures = {
        "total_accounts": COUNT(F.lit(1)), "total_balance": F.coalesce(F.sum(balance).cast("double"), F.lit(0.0)),
        "avg_balance": F.coalesce(F.round(F.avg(balance), 2).cast("double"), F.lit(0.0)),
        "avg_aml_risk_score": F.round(F.avg(risk), 2), "high_risk_accounts": F.when(F.count(risk) > 0, F.count_if(risk > 50)),
    }
    return _union([_figures(df, "accounts", figures), _by(df, "accounts", "accounts_by_type", "account_type")])


def transactions(df: DataFrame) -> DataFrame:
    size = F.abs(_money("amount"))
    return _figures(df, "transactions", {
        "total_transactions": COUNT(F.lit(1)), "total_transaction_volume": F.coalesce(F.sum(size).cast("double"), F.lit(0.0)),
        "avg_transaction_amount": F.coalesce(F.round(F.avg(size), 2).cast("double"), F.lit(0.0)),
        "flagged_transaction_rate": share(F.col("is_flagged")),
    })


def loan_applications(df: DataFrame) -> DataFrame:
    return _figures(df, "loan_applications", {
        "total_loan_applications": COUNT(F.lit(1)), "loan_approval_rate": share(F.col("status") == "APPROVED"),
        "total_loan_volume_requested": F.coalesce(F.sum(_money("requested_amount")).cast("double"), F.lit(0.0)),
    })


def servers(df: DataFrame) -> DataFrame:
    figures = {"total_servers": COUNT(F.lit(1)), "server_availability_rate": share(F.col("status") == "RUNNING")}
    return _union([
        _figures(df, "servers", figures), _by_each(df, "servers", {"servers_by_status": "status", "servers_by_environment": "environment"}),
    ])


def incidents(df: DataFrame) -> DataFrame:
    figures = {
        "total_incidents": COUNT(F.lit(1)), "mttr_minutes": F.round(F.avg("time_to_resolve_minutes"), 2),
        "incident_resolution_rate": share(F.col("status").isin("RESOLVED", "CLOSED")),
    }
    return _union([_figures(df, "incidents", figures), _by(df, "incidents", "incidents_by_severity", "severity")])


def deployments(df: DataFrame) -> DataFrame:
    return _figures(df, "deployments", {
        "total_deployments": COUNT(F.lit(1)), "deployment_success_rate": share(F.col("status") == "SUCCESS"),
        "avg_deployment_duration_seconds": F.round(F.avg("duration_seconds"), 2),
    })


def metrics(df: DataFrame) -> DataFrame:
    cpu, memory = F.col("cpu_usage_pct").cast(ROWS), F.col("memory_used_pct").cast(ROWS)
    return _figures(df, "metrics", {
        "avg_cpu_usage": F.round(F.avg(cpu), 2), "max_cpu_usage": F.round(F.max(cpu), 2),
        "avg_memory_usage": F.round(F.avg(memory), 2), "max_memory_usage": F.round(F.max(memory), 2),
    })


def students(df: DataFrame) -> DataFrame:
    gpa = F.col("gpa").cast("decimal(5,2)")
    figures = {
        "total_students": COUNT(F.lit(1)), "avg_gpa": F.round(F.avg(gpa), 2), "gpa_std": F.round(std_or_zero(gpa), 2),
        "honors_students": F.when(F.count(gpa) > 0, F.count_if(gpa >= 3.5)), "retention_rate": share(F.col("enrollment_status") == "ACTIVE"),
    }
    return _union([
        _figures(df, "students", figures), _by_each(df, "students", {"students_by_status": "enrollment_status", "students_by_level": "academic_level"}),
    ])


def faculty(df: DataFrame) -> DataFrame:
    papers = F.coalesce(F.col("publications_count"), F.lit(0))
    figures = {
        "total_faculty": COUNT(F.lit(1)), "total_publications": F.coalesce(F.sum(papers), F.lit(0)),
        "avg_publications_per_faculty": F.coalesce(F.round(F.avg(papers), 2), F.lit(0.0)),
    }
    return _union([_figures(df, "faculty", figures), _by(df, "faculty", "faculty_by_rank", "rank")])


def courses(df: DataFrame) -> DataFrame:
    return _figures(df, "courses", {
        "total_courses": COUNT(F.lit(1)), "total_course_enrollment": F.coalesce(F.sum("enrolled_count"), F.lit(0)),
        "avg_course_fill_rate": F.round(mean_ratio(F.col("enrolled_count"), F.col("capacity")), 4),
    })


def enrollments(df: DataFrame) -> DataFrame:
    done = F.col("status") == "COMPLETED"
    passed = done & F.col("grade").isNotNull() & (F.col("grade") != "F")
    figures = {"total_enrollments": COUNT(F.lit(1)), "pass_rate": F.when(F.count_if(done) > 0, F.round(F.count_if(passed) / F.count_if(done), 4))}
    graded = df.where(F.col("grade") != "")
    return _union([_figures(df, "enrollments", figures), _by(graded, "enrollments", "grade_distribution", "grade")])


def research_grants(df: DataFrame) -> DataFrame:
    return _figures(df, "research_grants", {
        "total_grants": COUNT(F.lit(1)), "total_grant_funding": F.coalesce(F.sum(_money("total_amount")).cast("double"), F.lit(0.0)),
        "active_grants": F.count_if(F.col("status") == "ACTIVE"),
    })


# Which tables each domain has indicators for, in report order.
DOMAINS = {
    "health": {"patients": patients, "encounters": encounters, "lab_results": lab_results},
    "finance": {"accounts": accounts, "transactions": transactions, "loan_applications": loan_applications},
    "tech": {"servers": servers, "incidents": incidents, "deployments": deployments, "metrics": metrics},
    "university": {"students": students, "faculty": faculty, "courses": courses, "enrollments": enrollments, "research_grants": research_grants},
}


def domain_kpis(domain: str, data: Mapping[str, DataFrame], as_of: str) -> DataFrame:
    """All indicators of a domain for the tables that are there."""
    frames = []
    for entity, fn in DOMAINS[domain].items():
        if entity in data:
            frames.append(fn(data[entity], as_of) if fn is patients else fn(data[entity]))
    if not frames:
        raise ValueError(f"no table of domain {domain!r} given")
    return _union(frames)


# Report section of each indicator.
SECTIONS = {
    "Patient Demographics": ["total_patients", "avg_patient_age", "international_patients", "gender_distribution"],
    "Encounter Analysis": ["encounters_by_type"],
    "Laboratory Results": ["total_lab_results", "abnormal_lab_rate", "critical_lab_rate"],
    "Account Overview": ["total_accounts", "avg_balance", "high_risk_accounts", "accounts_by_type"],
    "Transaction Analysis": ["total_transaction_volume", "avg_transaction_amount", "flagged_transaction_rate"],
    "Loan Portfolio": ["total_loan_applications", "loan_approval_rate", "total_loan_volume_requested", "loans_by_status"],
    "Infrastructure Overview": ["total_servers", "server_availability_rate", "servers_by_environment"],
    "Incident Analysis": ["total_incidents", "mttr_minutes", "incident_resolution_rate", "incidents_by_severity"],
    "Deployment Metrics": ["total_deployments", "deployment_success_rate", "avg_deployment_duration_seconds"],
    "Resource Utilization": ["avg_cpu_usage", "max_cpu_usage", "avg_memory_usage", "max_memory_usage"],
    "Student Overview": ["total_students", "avg_gpa", "honors_students", "retention_rate", "students_by_level"],
    "Faculty Overview": ["total_faculty", "total_publications", "avg_publications_per_faculty", "faculty_by_rank"],
    "Course Enrollment": ["total_courses", "total_course_enrollment", "avg_course_fill_rate"],
    "Academic Performance": ["total_enrollments", "pass_rate", "grade_distribution"],
    "Research Grants": ["total_grants", "active_grants", "total_grant_funding"],
}
SUMMARIES = {
    "health": ["total_patients", "total_encounters", "abnormal_lab_rate", "avg_patient_age"],
    "finance": ["total_accounts", "total_balance", "total_transactions", "loan_approval_rate"],
    "tech": ["total_servers", "availability_rate", "total_incidents", "deployment_success_rate"],
    "university": ["total_students", "total_faculty", "avg_gpa", "retention_rate"],
}


def report(domain: str, data: Mapping[str, DataFrame], as_of: str) -> DataFrame:
    """Report data (report, section, metric, category, value): the summary and the domain's sections."""
    rows = domain_kpis(domain, data, as_of)
    if domain == "health" and "patients" in data:
        people = data["patients"]
        foreign = F.count_if(F.col("is_international")) if "is_international" in people.columns else F.lit(0)
        rows = _union([rows, _figures(people, "patients", {"international_patients": foreign}), _by(people, "patients", "gender_distribution", "gender", "Unknown")])
    if domain == "finance" and "loan_applications" in data:
        rows = _union([rows, _by(data["loan_applications"], "loan_applications", "loans_by_status", "status", "Unknown")])
    summary = [m.replace("availability_rate", "server_availability_rate") if domain == "tech" else m for m in SUMMARIES[domain]]
    places = [("Summary", m) for m in summary] + [(s, m) for s, ms in SECTIONS.items() for m in ms]
    section = F.lit(None).cast("array<string>")
    for name in {m for _, m in places}:
        found = [s for s, m in places if m == name]
        section = F.when(F.col("metric") == name, F.array(*[F.lit(s) for s in found])).otherwise(section)
    placed = rows.withColumn("section", F.explode(section))
    return placed.select(F.lit(domain).alias("report"), "section", "metric", "category", "value")


def overview(data: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """Rows per table and domain."""
    return _union([
        df.agg(F.lit(domain).alias("domain"), F.lit(entity).alias("entity"), F.count(F.lit(1)).alias("records"))
        for domain, tables in data.items() for entity, df in tables.items()
    ])
