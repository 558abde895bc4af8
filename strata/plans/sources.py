"""Round trips through files, incremental loads and model outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.plans.registry import query
from strata.session import scratch_path
from strata.sources import files, incremental, known_keys, models
from strata.tables import VIEWS, load, view, view_sql, with_views


@query("csv_roundtrip", """
    SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, 'a;"' || o_orderpriority || '", b' AS note, nullif(o_orderstatus, 'P') AS status FROM orders""")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders to CSV with another delimiter and back as texts, with one column renamed."""
    rows = load(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.concat(F.lit('a;"'), "o_orderpriority", F.lit('", b')).alias("note"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), F.lit(1).alias("_internal"))
    path = scratch_path(spark, "csv")
    files.write_files(rows, path, "csv")
    return files.read_csv(spark, path, ["o_orderkey", "amount", "note", "status"], column_mapping={"o_orderkey": "order_id"})


@query("json_roundtrip", "SELECT n_nationkey, n_name, r_name, c_custkey, c_acctbal FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """One document per customer with the records below a dotted path; read back through that path."""
    rows = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    record = F.struct("n_nationkey", "n_name", "r_name", "c_custkey", "c_acctbal")
    path = scratch_path(spark, "json")
    files.write_files(rows.select(F.struct(F.array(record).alias("items")).alias("data")), path, "json")
    schema = "data struct<items: array<struct<n_nationkey: int, n_name: string, r_name: string, c_custkey: bigint, c_acctbal: double>>>"
    return files.read_json(spark, path, schema, "data.items", multi_line=False)


@query("jsonl_append", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT event_type, count(*) FROM events GROUP BY event_type")
def jsonl_append(spark: SparkSession, sf: str) -> DataFrame:
    counts = load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "jsonl")
    for _ in range(2):
        files.write_files(counts, path, "jsonl", append=True)
    return spark.read.schema("event_type string, n bigint").json(path)


@query("partitioned_roundtrip", "SELECT o_orderkey, o_totalprice, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def partitioned_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders to folders by year and priority, and all of them back."""
    rows = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("year"))
    path = scratch_path(spark, "partitioned")
    files.write_partitioned(rows, path, ["year", "o_orderpriority"], "parquet")
    return spark.read.schema(rows.schema).parquet(path).select("o_orderkey", "o_totalprice", "o_orderpriority", "year")


_MARKED = "SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN ts END AS ts FROM events"


@query("incremental_scan", f"""
    WITH m AS ({_MARKED}), first AS (SELECT * FROM m WHERE ts <= TIMESTAMP '2024-01-20')
    SELECT 1 AS load_no, event_id, ts FROM first UNION ALL SELECT 2, event_id, ts FROM m WHERE ts > (SELECT max(ts) FROM first) UNION ALL SELECT 0, event_id, ts FROM m WHERE ts IS NULL""")
def incremental_scan(spark: SparkSession, sf: str) -> DataFrame:
    """First load of the events up to a day, then of those after the saved mark; events without a time arrive with the second and go aside."""
    base = scratch_path(spark, "incremental")
    events = load(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("ts"))

    def sink(number: int):
        return lambda rows: rows.write.mode("overwrite").parquet(f"{base}/out/load_no={number}")

    early = events.where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))
    incremental.load_increment(early, "ts", f"{base}/mark", sink(1), sink(0))
    incremental.load_increment(events, "ts", f"{base}/mark", sink(2), sink(0))
    return spark.read.schema(T.StructType([*events.schema.fields, T.StructField("load_no", T.IntegerType())])).parquet(f"{base}/out").select("load_no", "event_id", "ts")


@query("incremental_by_key", """
    SELECT o_orderkey, o_totalprice, CASE WHEN o_orderdate < DATE '1995-01-01' THEN 1 WHEN o_orderdate < DATE '1997-01-01' THEN 2 ELSE 3 END AS load_no FROM orders""")
def incremental_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Three overlapping loads of the orders, which have no mark: each brings the keys that none before it has brought."""
    base = scratch_path(spark, "by-key")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    parts = ["o_orderdate < DATE '1995-01-01'", "o_orderdate >= DATE '1994-01-01' AND o_orderdate < DATE '1997-01-01'", "true"]
    for number, part in enumerate(parts, 1):
        known_keys.load_new_keys(orders.where(part).drop("o_orderdate"), ["o_orderkey"], f"{base}/keys", lambda rows, n=number: rows.write.mode("overwrite").parquet(f"{base}/out/load_no={n}"))
    schema = T.StructType([*orders.drop("o_orderdate").schema.fields, T.StructField("load_no", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{base}/out")


@query("model_merge", with_views("accounts") + """
    SELECT account_number, account_type, CASE WHEN current_balance < 0 THEN 0 ELSE current_balance END AS current_balance FROM accounts""")
def model_merge(spark: SparkSession, sf: str) -> DataFrame:
    """An incremental model: first run with all accounts, second run merges the corrected ones."""
    base, config = scratch_path(spark, "model"), models.ModelConfig("incremental", "merge", ["account_number"], cluster_by=["account_number"])
    accounts = view(spark, sf, "accounts").select("account_number", "account_type", "current_balance")
    models.materialize(accounts, "account_model", config, base)
    fixed = accounts.where("current_balance < 0").withColumn("current_balance", F.lit(0.0))
    return models.materialize(fixed, "account_model", config, base)


@query("model_delete_insert", """
    SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN 'second' ELSE 'first' END AS run FROM orders""")
def model_delete_insert(spark: SparkSession, sf: str) -> DataFrame:
    base, config = scratch_path(spark, "model"), models.ModelConfig("incremental", "delete+insert", ["o_orderpriority"])
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.lit("first").alias("run"))
    models.materialize(orders, "priority_model", config, base)
    again = orders.where("o_orderpriority = '5-LOW'").withColumn("run", F.lit("second"))
    return models.materialize(again, "priority_model", config, base)


@query("model_append_partitioned", "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents UNION ALL SELECT lang FROM documents WHERE n_chars > 500) GROUP BY lang")
def model_append_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    base, config = scratch_path(spark, "model"), models.ModelConfig("incremental", "append", partition_by=["lang"])
    documents = load(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    models.materialize(documents, "document_model", config, base)
    stored = models.materialize(documents.where("n_chars > 500"), "document_model", config, base)
    return stored.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("domain_layer", " UNION ALL ".join(f"SELECT '{n}' AS entity, count(*) AS n, count(DISTINCT {next(iter(v.columns))}) AS keys FROM ({view_sql(n)})" for n, v in VIEWS.items()))
def domain_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Raw layer of all domains: every entity to JSON, all read back by name."""
    base, tables = scratch_path(spark, "raw"), {n: view(spark, sf, n) for n in VIEWS}
    files.write_domain(tables, base)
    back = files.read_domain(spark, base, {n: t.schema for n, t in tables.items()})
    counts = [t.agg(F.lit(n).alias("entity"), F.count(F.lit(1)).alias("n"), F.count_distinct(t.columns[0]).alias("keys")) for n, t in back.items()]
    return reduce(DataFrame.unionByName, counts)
