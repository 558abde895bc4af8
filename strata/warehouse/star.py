"""Star schemas of the four domains and the loaders that fill them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.strings import merchant_slug, row_hash
from strata.operators.dedup import deduplicate, derived_dimension
from strata.operators.joins import orphans
from strata.operators.windows import HOT_ROWS, number_rows
from strata.session import scratch_path
from strata.warehouse.dims import DEFAULT_GRAIN, date_dimension, date_dimension_of, map_columns, time_dimension


@dataclass(frozen=True)
class Dimension:
    name: str
    surrogate: str
    natural_key: tuple[str, ...]
    columns: tuple[str, ...]
    scd_type: int = 1


@dataclass(frozen=True)
class Fact:
    name: str
    primary_key: str
    degenerate: str
    foreign_keys: Mapping[str, str]
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Star:
    name: str
    fact: Fact
    dimensions: Mapping[str, Dimension] = field(default_factory=dict)

    def unknown_dimensions(self) -> list[str]:
        """Foreign keys whose name, without its suffix, is part of no dimension's name."""
        names = list(self.dimensions)
        missing = []
        for key in self.fact.foreign_keys:
            stem = key.replace("_sk", "").replace("_key", "")
            if not any(stem in n for n in names):
                missing.append(key)
        return missing


def _dims(*dims: Dimension) -> dict[str, Dimension]:
    return {d.name: d for d in dims}


# Tables, keys and columns of the four star schemas.
DIM_DATE = Dimension("dim_date", "date_sk", ("date_actual",), ("date_actual date",))
DIM_TIME = Dimension("dim_time", "time_sk", ("time_actual",), ("time_actual string",))
HEALTH = Star(
    "health_encounters",
    Fact(
        "fact_encounter", "encounter_sk", "encounter_id",
        {"patient_sk": "dim_patient", "provider_sk": "dim_provider", "date_sk": "dim_date", "time_sk": "dim_time", "encounter_type_sk": "dim_encounter_type"},
        ("encounter_id string", "duration_minutes int", "total_charges double", "insurance_paid double", "patient_paid double", "diagnosis_count int", "procedure_count int", "medication_count int"),
    ),
    _dims(
        Dimension("dim_patient", "patient_sk", ("patient_id",), ("patient_id string", "first_name string", "last_name string", "date_of_birth date", "gender string", "blood_type string", "city string", "state string", "zip_code string", "insurance_type string", "primary_care_provider string"), 2),
        Dimension("dim_provider", "provider_sk", ("provider_id",), ("provider_id string", "first_name string", "last_name string", "specialty string", "department string", "facility string", "npi string")),
        Dimension("dim_encounter_type", "encounter_type_sk", ("encounter_type_code",), ("encounter_type_code string", "encounter_type_name string", "category string", "is_emergency boolean", "is_inpatient boolean")),
        DIM_DATE, DIM_TIME,
    ),
)
FINANCE = Star(
    "finance_transactions",
    Fact(
        "fact_transaction", "transaction_sk", "transaction_id",
        {"account_sk": "dim_account", "customer_sk": "dim_customer", "merchant_sk": "dim_merchant", "date_sk": "dim_date", "time_sk": "dim_time"},
        ("transaction_id string", "transaction_type string", "amount double", "fee_amount double", "exchange_rate double", "fraud_score int", "is_flagged boolean"),
    ),
    _dims(
        Dimension("dim_account", "account_sk", ("account_number",), ("account_number string", "account_type string", "account_status string", "currency string", "opened_date date", "credit_limit double", "interest_rate double"), 2),
        Dimension("dim_customer", "customer_sk", ("customer_id",), ("customer_id string", "customer_name string", "customer_type string", "city string", "state string", "country string", "segment string", "risk_rating string"), 2),
        Dimension("dim_merchant", "merchant_sk", ("merchant_id",), ("merchant_id string", "merchant_name string", "merchant_category string", "merchant_category_code string", "city string", "state string", "country string")),
        DIM_DATE, DIM_TIME,
    ),
)
TECH = Star(
    "tech_metrics",
    Fact(
        "fact_server_metric", "metric_sk", "metric_id",
        {"server_sk": "dim_server", "application_sk": "dim_application", "date_sk": "dim_date", "time_sk": "dim_time"},
        ("cpu_usage_pct double", "memory_used_pct double", "disk_used_pct double", "network_in_mb double", "network_out_mb double", "request_count int", "error_count int", "latency_p50_ms double", "latency_p99_ms double"),
    ),
    _dims(
        Dimension("dim_server", "server_sk", ("server_id",), ("server_id string", "hostname string", "environment string", "datacenter string", "cloud_provider string", "instance_type string", "cpu_cores int", "memory_gb int", "os_name string", "os_version string", "owner_team string"), 2),
        Dimension("dim_application", "application_sk", ("app_id",), ("app_id string", "app_name string", "app_type string", "framework string", "language string", "version string", "owner_team string", "criticality string")),
        DIM_DATE, DIM_TIME,
    ),
)
UNIVERSITY = Star(
    "university_enrollments",
    Fact(
        "fact_enrollment", "enrollment_sk", "enrollment_id",
        {"student_sk": "dim_student", "course_sk": "dim_course", "instructor_sk": "dim_instructor", "term_sk": "dim_term"},
        ("enrollment_id string", "credits_attempted int", "credits_earned int", "grade_points double", "attendance_pct double", "is_passed boolean", "is_withdrawn boolean"),
    ),
    _dims(
        Dimension("dim_student", "student_sk", ("student_id",), ("student_id string", "first_name string", "last_name string", "major string", "minor string", "academic_level string", "enrollment_status string", "is_international boolean", "is_transfer boolean", "admission_year int"), 2),
        Dimension("dim_course", "course_sk", ("course_code",), ("course_code string", "course_title string", "department string", "credits int", "level string", "is_online boolean", "is_required boolean")),
        Dimension("dim_instructor", "instructor_sk", ("faculty_id",), ("faculty_id string", "first_name string", "last_name string", "department string", "rank string", "tenure_status string")),
        Dimension("dim_term", "term_sk", ("term_code",), ("term_code string", "term_name string", "academic_year int", "semester string", "start_date string", "end_date string", "is_current boolean")),
        DIM_DATE,
    ),
)
STARS = {s.name: s for s in (HEALTH, FINANCE, TECH, UNIVERSITY)}
# Rows of the encounter types and of the terms.
ENCOUNTER_TYPES = [
    ("OUTPATIENT", "Outpatient Visit", "Ambulatory", False, False),
    ("INPATIENT", "Inpatient Admission", "Inpatient", False, True),
    ("EMERGENCY", "Emergency Visit", "Emergency", True, False),
    ("TELEHEALTH", "Telehealth Visit", "Virtual", False, False),
]
TERMS = [
    ("FALL_2023", "Fall 2023", 2023, "Fall", "2023-08-25", "2023-12-15", False),
    ("SPRING_2024", "Spring 2024", 2024, "Spring", "2024-01-15", "2024-05-10", False),
    ("FALL_2024", "Fall 2024", 2024, "Fall", "2024-08-25", "2024-12-15", True),
]


def first_load(source: DataFrame, dim: Dimension, as_of: str, mapping: Mapping[str, str] | None = None, defaults: Mapping[str, object] | None = None, order_by: tuple[str, ...] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fill an empty dimension: one row per natural key (last wins), keys 1, 2, 3 … in key order.

    The rows are written to the shared folder first, so they are computed once however often they are used.
    """
    spark, path = source.sparkSession, scratch_path(source.sparkSession, dim.name)
    rows = deduplicate(map_columns(source, dim.columns, mapping, defaults), list(dim.natural_key), order_by, keep="last")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    numbered = number_rows(rows, list(dim.natural_key), dim.surrogate, tie_break=[], hot_rows=hot_rows)
    numbered = numbered.withColumn(dim.surrogate, F.col(dim.surrogate).cast("bigint"))
    if dim.scd_type == 2:
        numbered = numbered.withColumns({
            "effective_date": F.lit(as_of).cast("date"), "expiration_date": F.lit(None).cast("date"), "is_current": F.lit(True),
        })
    return numbered


def resolve(rows: DataFrame, dimensions: Mapping[str, tuple[Dimension, DataFrame]], links: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Add surrogate keys: ``links`` gives per key the dimension and the expression of its natural key.

    Only current versions are looked up; no match gives null. Several keys that hang on one other
    table are best resolved on that table, which is then joined to the facts once.
    """
    out = rows
    for key, (name, natural) in links.items():
        dim, table = dimensions[name]
        current = table.where("is_current") if "effective_date" in table.columns else table
        found = current.select(F.col(dim.natural_key[0]).alias("__natural"), F.col(dim.surrogate).alias(key))
        out = out.join(found, natural == F.col("__natural"), "left").drop("__natural")
    return out


def fact_rows(resolved: DataFrame, fact: Fact, mapping: Mapping[str, str] | None = None, row_id: tuple[str, ...] | None = None) -> DataFrame:
    """Fact table from rows with their surrogate keys: hashed row key, the keys there are, mapped measures.

    A hashed row key needs no order over all rows; it has 128 bits, so that no two of very many rows meet.
    """
    mapping = mapping or {}
    out = [row_hash(*(row_id or (mapping.get(fact.degenerate, fact.degenerate),))).alias(fact.primary_key)]
    out += [F.col(k) for k in fact.foreign_keys if k in resolved.columns]
    for item in fact.columns:
        name, kind = item.split()
        source = mapping.get(name, name)
        out.append((F.col(source) if source in resolved.columns else F.lit(None)).cast(kind).alias(name))
    return resolved.select(*out)


def time_slot(ts: str) -> Column:
    slot = F.floor(F.minute(ts) / DEFAULT_GRAIN) * DEFAULT_GRAIN
    return F.format_string("%02d:%02d:00", F.hour(ts), slot.cast("int"))


def _calendar(spark: SparkSession, events: DataFrame | None, ts: str) -> DataFrame:
    return date_dimension(spark) if events is None else date_dimension_of(events, ts)


def _assemble(makers: Mapping[str, Callable[[], DataFrame]], fact: str, make_fact: Callable[[dict[str, DataFrame]], DataFrame] | None, only: Sequence[str] | None) -> dict[str, DataFrame]:
    """The tables asked for (default: all), each made once; the fact table needs every dimension."""
    whole = only is None or fact in only
    tables = {name: make() for name, make in makers.items() if whole or name in only}
    if whole and make_fact:
        tables[fact] = make_fact(tables)
    return tables


def build_health(data: Mapping[str, DataFrame], as_of: str, spark: SparkSession, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Tables of the health star; type and time keys are filled when the source has the columns."""
    encounters, dims = data.get("encounters"), HEALTH.dimensions
    types = spark.createDataFrame(ENCOUNTER_TYPES, "encounter_type_code string, encounter_type_name string, category string, is_emergency boolean, is_inpatient boolean")
    makers = {"dim_date": lambda: _calendar(spark, encounters, "encounter_date"), "dim_time": lambda: time_dimension(spark), "dim_encounter_type": lambda: first_load(types, dims["dim_encounter_type"], as_of)}
    links: dict[str, tuple[str, Column]] = {}
    if "patients" in data:
        makers["dim_patient"] = lambda: first_load(data["patients"], dims["dim_patient"], as_of)
        links["patient_sk"] = ("dim_patient", F.col("patient_id").cast("string"))
    if "providers" in data:
        makers["dim_provider"] = lambda: first_load(data["providers"], dims["dim_provider"], as_of)
        links["provider_sk"] = ("dim_provider", F.col("provider_id").cast("string"))
    if encounters is None:
        return _assemble(makers, HEALTH.fact.name, None, only)
    links |= {"date_sk": ("dim_date", F.col("encounter_date").cast("date")), "time_sk": ("dim_time", time_slot("encounter_date")), "encounter_type_sk": ("dim_encounter_type", F.col("encounter_type"))}
    return _assemble(makers, HEALTH.fact.name, lambda tables: fact_rows(resolve(encounters, {n: (dims[n], t) for n, t in tables.items()}, links), HEALTH.fact), only)


def build_finance(data: Mapping[str, DataFrame], as_of: str, spark: SparkSession, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    accounts, transactions, dims = data["accounts"], data["transactions"], FINANCE.dimensions
    customers = derived_dimension(accounts, "customer_id", [c for c in ("customer_name", "customer_type") if c in accounts.columns], ["account_number"])
    merchant_columns = [c for c in ("merchant_category", "merchant_category_code") if c in transactions.columns]
    merchants = derived_dimension(transactions, "merchant_name", merchant_columns, ["transaction_id"]).withColumn("merchant_id", merchant_slug("merchant_name"))
    makers = {
        "dim_date": lambda: _calendar(spark, transactions, "transaction_date"),
        "dim_time": lambda: time_dimension(spark),
        "dim_account": lambda: first_load(accounts, dims["dim_account"], as_of, {"account_status": "status"}),
        "dim_customer": lambda: first_load(customers, dims["dim_customer"], as_of),
        "dim_merchant": lambda: first_load(merchants, dims["dim_merchant"], as_of),
    }

    def facts(tables: dict[str, DataFrame]) -> DataFrame:
        known = {n: (dims[n], t) for n, t in tables.items()}
        owners = deduplicate(accounts.select(F.col("account_number").cast("string").alias("__account"), F.col("customer_id").cast("string").alias("__owner")), ["__account"], keep="last")
        owners = resolve(owners, known, {"account_sk": ("dim_account", F.col("__account")), "customer_sk": ("dim_customer", F.col("__owner"))})
        rows = transactions.join(owners, F.col("account_id").cast("string") == F.col("__account"), "left")
        return fact_rows(resolve(rows, known, {
            "merchant_sk": ("dim_merchant", merchant_slug("merchant_name")),
            "date_sk": ("dim_date", F.col("transaction_date").cast("date")),
            "time_sk": ("dim_time", time_slot("transaction_date")),
        }), FINANCE.fact)

    return _assemble(makers, FINANCE.fact.name, facts, only)


def build_tech(data: Mapping[str, DataFrame], as_of: str, spark: SparkSession, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    metrics, dims = data["metrics"], TECH.dimensions
    makers = {
        "dim_date": lambda: _calendar(spark, metrics, "timestamp"),
        "dim_time": lambda: time_dimension(spark),
        "dim_server": lambda: first_load(data["servers"], dims["dim_server"], as_of),
    }
    links = {
        "server_sk": ("dim_server", F.col("server_id").cast("string")),
        "date_sk": ("dim_date", F.col("timestamp").cast("date")),
        "time_sk": ("dim_time", time_slot("timestamp")),
    }
    if "applications" in data:
        makers["dim_application"] = lambda: first_load(data["applications"], dims["dim_application"], as_of)
        if "application_id" in metrics.columns:
            links["application_sk"] = ("dim_application", F.col("application_id").cast("string"))
    mapping = {"network_in_mb": "network_in_mb_s", "network_out_mb": "network_out_mb_s"}
    row_id = ("metric_id",) if "metric_id" in metrics.columns else tuple(metrics.columns)  # no smaller key is unique

    def facts(tables: dict[str, DataFrame]) -> DataFrame:
        rows = resolve(metrics, {n: (dims[n], t) for n, t in tables.items()}, links)
        return fact_rows(rows, TECH.fact, {k: v for k, v in mapping.items() if v in metrics.columns}, row_id)

    return _assemble(makers, TECH.fact.name, facts, only)


def build_university(data: Mapping[str, DataFrame], as_of: str, spark: SparkSession, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Enrollments find their course through its code, instructor and term through the course row."""
    students, courses, enrollments, dims = data["students"], data["courses"], data["enrollments"], UNIVERSITY.dimensions
    terms = spark.createDataFrame(TERMS, "term_code string, term_name string, academic_year int, semester string, start_date string, end_date string, is_current boolean")
    makers = {
        "dim_date": lambda: date_dimension(spark) if "enrollment_date" not in enrollments.columns else date_dimension_of(enrollments, "enrollment_date"),
        "dim_student": lambda: first_load(students, dims["dim_student"], as_of),
        "dim_course": lambda: first_load(courses, dims["dim_course"], as_of, {"course_title": "title", "department": "department_id"}),
        "dim_term": lambda: first_load(terms, dims["dim_term"], as_of),
    }
    extra = [c for c in ("instructor_id", "term") if c in courses.columns]
    links = {"course_sk": ("dim_course", F.col("course_code").cast("string"))}
    if "faculty" in data:
        makers["dim_instructor"] = lambda: first_load(data["faculty"], dims["dim_instructor"], as_of)
        if "instructor_id" in extra:
            links["instructor_sk"] = ("dim_instructor", F.col("instructor_id").cast("string"))
    if "term" in extra:
        links["term_sk"] = ("dim_term", F.col("term"))

    def facts(tables: dict[str, DataFrame]) -> DataFrame:
        known = {n: (dims[n], t) for n, t in tables.items()}
        named = deduplicate(courses.select(F.col("course_id").alias("__course"), "course_code", *extra), ["__course"], keep="last")
        named = resolve(named, known, links).select("__course", *links)
        rows = enrollments.join(named, F.col("course_id") == F.col("__course"), "left")
        return fact_rows(resolve(rows, known, {"student_sk": ("dim_student", F.col("student_id").cast("string"))}), UNIVERSITY.fact)

    return _assemble(makers, UNIVERSITY.fact.name, facts, only)


def save(tables: Mapping[str, DataFrame], schema: str, path: str) -> None:
    """Write every table of a star below ``path/schema``; the partitions do the work, one job per table."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{schema}/{name}")


def table_counts(spark: SparkSession, names: list[str], schema: str, path: str) -> DataFrame:
    """Rows of the saved tables, counted from the parquet footers."""
    counts = None
    for name in names:
        one = spark.read.parquet(f"{path.rstrip('/')}/{schema}/{name}").agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


def star_orphans(fact: DataFrame, foreign_keys: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Fact rows per foreign key that point to no dimension row."""
    result = None
    for key, (dim, surrogate) in foreign_keys.items():
        one = orphans(fact, key, dim, surrogate).agg(F.lit(key).alias("foreign_key"), F.count(F.lit(1)).alias("orphans"))
        result = one if result is None else result.unionByName(one)
    return result
