"""Views over the driver's tables that the catalogue's queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import ingest
from .contract import Contract, Field, Table, eligibility
from .mapping import Mapping, Step

#: Messy eligibility rows, one for each order: 16 text columns and source_row_number. The same text runs in Spark and DuckDB.
ELIG = """
WITH b AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, o.o_orderstatus AS st,
         CAST(o.o_orderdate AS DATE) AS od, cu.c_mktsegment AS seg,
         DATE '1960-01-01' + CAST((o.o_custkey * 37) % 14000 AS INT) AS dob,
         CAST(o.o_orderkey % 37 AS INT) AS m, CAST(o.o_custkey % 37 AS INT) AS mc,
         lpad(CAST((o.o_custkey * 7919) % 10000000 AS STRING), 7, '0') AS ph
  FROM {orders} o JOIN {customer} cu ON o.o_custkey = cu.c_custkey
), d AS (
  SELECT *, 'MEM' || lpad(CAST(c AS STRING), 6, '0') AS mem,
         CAST(year(dob) AS STRING) AS y, lpad(CAST(month(dob) AS STRING), 2, '0') AS mo,
         lpad(CAST(day(dob) AS STRING), 2, '0') AS dd
  FROM b
)
SELECT CAST(k + 2 AS BIGINT) AS source_row_number,
  mem AS member_number,
  CASE WHEN mc = 10 THEN '' ELSE ' First' || CAST(c % 20 AS STRING) || ' ' END AS first,
  CASE WHEN k % 1009 = 12 THEN 'Conflict' ELSE 'Last' || CAST(c % 16 AS STRING) END AS last,
  CASE WHEN mc = 0 THEN '1979-02-30' WHEN mc = 9 THEN '2999-01-01'
       WHEN k % 3 = 0 THEN y || '-' || mo || '-' || dd
       WHEN k % 3 = 1 THEN mo || '/' || dd || '/' || y ELSE y || '/' || mo || '/' || dd END AS dob,
  CASE c % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'Male' WHEN 3 THEN 'Female' ELSE 'O' END AS sex,
  CASE WHEN m = 1 THEN 'not-an-email' WHEN c % 12 = 0 THEN ''
       ELSE 'User' || CAST(c AS STRING) || '@Example.com' END AS email_address,
  CASE WHEN m = 2 THEN 'abc' WHEN k % 3 = 0 THEN '555' || ph
       WHEN k % 3 = 1 THEN '(555) ' || substr(ph, 1, 3) || '-' || substr(ph, 4, 4)
       ELSE '1-555-' || substr(ph, 1, 3) || '-' || substr(ph, 4, 4) END AS phone,
  CASE WHEN m = 11 THEN '' WHEN seg = 'AUTOMOBILE' THEN 'PPO-100' WHEN seg = 'BUILDING' THEN 'HMO-200'
       WHEN seg = 'FURNITURE' THEN 'HDHP-300' WHEN seg = 'HOUSEHOLD' THEN 'EPO-400' ELSE 'POS-500' END AS plan_code,
  CASE seg WHEN 'AUTOMOBILE' THEN 'Silver PPO' WHEN 'BUILDING' THEN 'Basic HMO'
       WHEN 'FURNITURE' THEN 'Saver HDHP' WHEN 'HOUSEHOLD' THEN 'Metro EPO' ELSE 'Choice POS' END AS plan_name,
  CASE WHEN m = 5 THEN 'MysteryPlan'
       WHEN seg = 'AUTOMOBILE' THEN CASE WHEN k % 2 = 0 THEN 'P.P.O' ELSE 'PPO' END
       WHEN seg = 'BUILDING' THEN 'HMO'
       WHEN seg = 'FURNITURE' THEN CASE WHEN k % 2 = 0 THEN 'High Deductible' ELSE 'HDHP' END
       WHEN seg = 'HOUSEHOLD' THEN 'EPO' ELSE 'POS' END AS plan_type,
  CASE WHEN seg IN ('AUTOMOBILE', 'BUILDING') THEN 'Acme Health' ELSE 'Northstar Benefits' END AS carrier,
  CASE WHEN m = 6 THEN '2025-06-01' WHEN m = 14 THEN '2024-01-01' ELSE CAST(od AS STRING) END AS effective_date,
  CASE WHEN m = 6 THEN '2024-01-01' WHEN m IN (13, 14) THEN ''
       WHEN st = 'F' THEN CAST(od + CAST(60 + k % 600 AS INT) AS STRING) ELSE '' END AS term_date,
  CASE WHEN m = 3 THEN 'UnknownStatus' WHEN st = 'F' THEN CASE WHEN k % 2 = 0 THEN 'T' ELSE 'Termed' END
       WHEN st = 'O' THEN CASE WHEN k % 2 = 0 THEN 'A' ELSE 'Active' END ELSE 'Pending' END AS status,
  CASE WHEN m = 4 THEN 'Partner' WHEN c % 4 IN (0, 1) THEN 'Self' WHEN c % 4 = 2 THEN 'Spouse' ELSE 'Child' END AS relation,
  CASE WHEN c % 4 IN (0, 1) THEN mem WHEN m = 7 THEN '' WHEN m = 8 THEN 'MEM999999'
       ELSE 'MEM' || lpad(CAST(c - c % 4 AS STRING), 6, '0') END AS subscriber_id
FROM d
"""
ELIG_SQL = ELIG.format(orders="orders", customer="customer")
COLUMNS = ["member_number", "first", "last", "dob", "sex", "email_address", "phone", "plan_code", "plan_name", "plan_type", "carrier", "effective_date", "term_date", "status", "relation", "subscriber_id"]
#: table, field and source column of the identity mapping.
PAIRS = [
    ("members", "member_id", "member_number"), ("members", "first_name", "first"), ("members", "last_name", "last"), ("members", "date_of_birth", "dob"), ("members", "gender", "sex"), ("members", "email", "email_address"), ("members", "phone", "phone"),
    ("plans", "plan_id", "plan_code"), ("plans", "plan_name", "plan_name"), ("plans", "plan_type", "plan_type"), ("plans", "carrier_name", "carrier"),
    ("member_coverage", "member_id", "member_number"), ("member_coverage", "plan_id", "plan_code"), ("member_coverage", "coverage_start_date", "effective_date"), ("member_coverage", "coverage_end_date", "term_date"), ("member_coverage", "coverage_status", "status"), ("member_coverage", "relationship_to_subscriber", "relation"), ("member_coverage", "subscriber_id", "subscriber_id"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ELIG, orders=ingest.spread(table(spark, sf_dir, "orders")), customer=table(spark, sf_dir, "customer"))


def identity_mappings(steps: dict[str, list[Step]] | None = None, **policy) -> list[Mapping]:
    return [Mapping(t, f, (c,), tuple((steps or {}).get(f, ())), **policy) for t, f, c in PAIRS]


#: Steps of the mapped projection: trims, a strict date, a phone, an e-mail address.
STEPS = {"first_name": [Step("trim", {}), Step("uppercase", {})], "date_of_birth": [Step("parse_date", {"accepted_formats": []})], "email": [Step("trim", {}), Step("normalize_email", {})], "phone": [Step("normalize_phone", {})]}


def order_book_contract() -> Contract:
    """A second contract: customers, orders and order lines."""

    def f(table: str, name: str, kind: str, required: bool = False, allowed: tuple[str, ...] = (), rules: tuple[dict, ...] = ()) -> Field:
        return Field(table, name, kind, rules[0]["kind"] if rules else "", required, not required, allowed=allowed, rules=rules)

    at_least_0 = ({"kind": "numeric_range", "severity": "warning", "parameters": {"minimum": 0}},)
    quantity = ({"kind": "numeric_range", "severity": "error", "parameters": {"minimum": 1, "maximum": 50}},)
    past = ({"kind": "not_future", "severity": "error", "parameters": {}},)
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    customers = Table("customers", (f("customers", "customer_id", "identifier", True), f("customers", "customer_name", "text", True), f("customers", "segment", "enum", allowed=segments), f("customers", "balance", "numeric", rules=at_least_0)), ("customer_id",), ("customer_id",))
    orders = Table("orders", (f("orders", "order_id", "identifier", True), f("orders", "customer_id", "identifier", True), f("orders", "order_date", "date", True, rules=past), f("orders", "order_status", "enum", allowed=("F", "O", "P")), f("orders", "total", "numeric")), ("order_id",), ("order_id",), (("customer_id", "customers", "customer_id"),))
    lines = Table("order_lines", (f("order_lines", "order_id", "identifier", True), f("order_lines", "line_number", "numeric", True), f("order_lines", "ship_date", "date"), f("order_lines", "quantity", "numeric", rules=quantity), f("order_lines", "price", "numeric")), ("order_id", "line_number"), ("order_id", "line_number"), (("order_id", "orders", "order_id"),))
    return Contract("order_book", "1.0.0", (customers, orders, lines), "Order book", "sales", status="published")


#: Order book columns: contract field and expression; the same in Spark and DuckDB.
BOOK = {"customer_id": "CAST(c_custkey AS STRING)", "customer_name": "c_name", "segment": "c_mktsegment", "balance": "CAST(c_acctbal AS STRING)", "order_id": "CAST(o_orderkey AS STRING)", "order_date": "CAST(CAST(o_orderdate AS DATE) AS STRING)", "order_status": "o_orderstatus", "total": "CAST(o_totalprice AS STRING)", "line_number": "CAST(l_linenumber AS STRING)", "ship_date": "CAST(CAST(l_shipdate AS DATE) AS STRING)", "quantity": "CAST(l_quantity AS STRING)", "price": "CAST(l_extendedprice AS STRING)"}
#: Columns of orders and customer that BOOK is made of.
BOOK_OF = ["o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice", "c_custkey", "c_name", "c_mktsegment", "c_acctbal"]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def order_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order and customer as text, sorted by all columns of lineitem: a total order, as its rows are distinct. Rows are numbered when they are written (ingest.numbered).

    Lines are shuffled once: they and the orders, with their customers, are dealt by ranges of the order's key, so that they meet in the partition where lines are sorted. What is
    shuffled has the types of the tables; texts are made of it afterwards.
    """
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.struct(*BOOK_OF).alias("_order")).where("l_orderkey is not null")
    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER).where("l_orderkey is not null")
    dealt = lines.unionByName(orders, allowMissingColumns=True).repartitionByRange("l_orderkey")
    met = dealt.withColumn("_orders", F.collect_list("_order").over(Window.partitionBy("l_orderkey"))).where("_order is null")
    rows = met.select(*LINE_ORDER, F.inline("_orders")).sortWithinPartitions(*LINE_ORDER)
    return rows.select(F.lit(None).cast("long").alias("source_row_number"), *[F.expr(e).alias(n) for n, e in BOOK.items()])


ORDER_BOOK_SQL = f"SELECT CAST(row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) + 1 AS BIGINT) AS source_row_number, {', '.join(f'{e} AS {n}' for n, e in BOOK.items())} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


def book_mappings(contract: Contract) -> list[Mapping]:
    return [Mapping(f.table, f.name, (f.name,)) for f in contract.fields]


CONTRACT = eligibility()
