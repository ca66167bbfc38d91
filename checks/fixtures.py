"""Views over the given tables, in SQL that Spark and DuckDB both run.

The tables hold no nulls and no bad values, so some views put them in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from auditloom.sources.tables import read_table

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

FIXTURES = {
    "fx_docs": """
SELECT l.doc_id, d.lang, d.source, d.n_chars, l.toxic, l.quality
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "fx_orders": """
SELECT o.o_orderkey, r.r_name AS region, n.n_name AS nation,
       c.c_mktsegment AS segment, o.o_orderpriority AS priority,
       o.o_totalprice, c.c_acctbal, o.o_orderstatus,
       CASE WHEN o.o_totalprice > 450000 THEN 1 ELSE 0 END AS big
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "fx_dirty": """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 11 = 0 THEN '?'
            WHEN o_orderkey % 13 = 0 THEN ' '
            WHEN o_orderkey % 17 = 0 THEN 'unknown'
            WHEN o_orderkey % 19 = 0 THEN 'x'
            WHEN o_orderkey % 23 = 0 THEN '   '
            ELSE o_orderpriority END AS priority_raw,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL
            WHEN o_orderkey % 31 = 0 THEN ''
            ELSE o_orderstatus END AS status_raw,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey AS STRING)
            WHEN o_orderkey % 7 = 0 THEN '1-2'
            WHEN o_orderkey % 41 = 0 THEN '2020-01-01'
            WHEN o_orderkey % 43 = 0 THEN '-3.5'
            ELSE 'n/a' END AS code_raw,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL
            WHEN o_orderkey % 47 = 0 THEN CAST(-999.0 AS DOUBLE)
            ELSE o_totalprice END AS price_raw,
       CASE WHEN o_orderkey % 53 = 0 THEN 99999
            WHEN o_orderkey % 59 = 0 THEN -1
            ELSE o_orderkey % 365 END AS days_raw
FROM orders""",
    "fx_textnum": """
SELECT CAST(o_orderkey AS STRING) AS order_txt,
       CASE WHEN o_orderkey % 4 = 0 THEN 'NA' ELSE CAST(o_custkey AS STRING) END AS cust_txt,
       CASE WHEN o_orderkey % 6 = 0 THEN '?' ELSE CAST(o_totalprice AS STRING) END AS price_txt,
       CASE WHEN o_orderkey % 9 = 0 THEN 'null' ELSE o_orderpriority END AS priority_txt
FROM orders""",
    "fx_num": """
SELECT l_orderkey,
       CAST(CASE WHEN l_orderkey % 97 = 0 THEN 1000 ELSE 1 END AS DOUBLE) AS rare,
       l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_extendedprice * (1 - l_discount) AS net,
       CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS qty_null,
       7 AS const_col
FROM lineitem""",
    "fx_dup": """
SELECT l_returnflag,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linestatus END AS l_linestatus,
       CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS l_quantity
FROM lineitem""",
    "fx_text": """
SELECT c_custkey, c_name, c_mktsegment,
       CASE WHEN c_custkey % 10 < 7 THEN 'common' ELSE c_mktsegment END AS skewed
FROM customer""",
    "fx_pred": """
SELECT o.o_orderkey, c.c_mktsegment AS segment, r.r_name AS region,
       CASE WHEN o.o_totalprice > 250000 THEN 1 ELSE 0 END AS y,
       CASE WHEN c.c_mktsegment = 'BUILDING' AND o.o_orderkey % 3 = 0 THEN 0
            WHEN r.r_name = 'ASIA' AND o.o_orderkey % 4 = 0 THEN 1
            WHEN o.o_totalprice > 240000 + (o.o_orderkey % 3) * 10000 THEN 1 ELSE 0 END AS yhat,
       CASE WHEN c.c_mktsegment = 'BUILDING' AND o.o_orderkey % 9 = 0 THEN 0
            WHEN o.o_totalprice > 240000 + (o.o_orderkey % 3) * 10000 THEN 1 ELSE 0 END AS yhat2
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "fx_pred3": """
SELECT o.o_orderkey, c.c_mktsegment AS segment, o.o_orderstatus AS y,
       CASE WHEN o.o_orderkey % 5 = 0 THEN 'F' WHEN o.o_orderkey % 7 = 0 THEN 'X'
            ELSE o.o_orderstatus END AS yhat
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "fx_groupnull": """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderpriority END AS priority,
       o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS y
FROM orders""",
    "fx_emb": """
SELECT vec_id, embedding, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings""",
    "fx_lines": """
SELECT l.l_orderkey, o.o_orderpriority AS priority, o.o_orderstatus AS status,
       sum(l.l_quantity) AS quantity, sum(l.l_extendedprice) AS price, max(l.l_tax) AS tax,
       CASE WHEN count(*) BETWEEN 3 AND 5 THEN 1 ELSE 0 END AS middling
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY l.l_orderkey, o.o_orderpriority, o.o_orderstatus""",
    "fx_events": "SELECT event_id, ts, user_id, event_type, value FROM events",
}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, f"{sf_dir}/{t}.parquet") for t in TABLES}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name]
    for t in TABLES:
        if re.search(rf"\b(FROM|JOIN) {t}\b", sql):
            read_table(spark, f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)
