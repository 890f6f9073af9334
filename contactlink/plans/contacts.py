"""Contact records derived from the ``orders`` and ``part`` tables.

The text runs unchanged in Spark and in an ANSI engine. All parts take turns. Every four orders form a company:
an original, a copy with the same data hash, a misspelt variant, and another company
with the same zip and phone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contactlink.sources.files import spread

CONTACTS_SQL = """
WITH b AS (
  SELECT o_orderkey AS rid, o_orderkey % 4 AS v, CAST((o_orderkey - o_orderkey % 4) / 4 AS BIGINT) AS e FROM {orders}
), k AS (
  SELECT b.rid, b.v, b.e, b.e % (SELECT count(*) FROM {part}) AS partkey FROM b
), n AS (
  SELECT k.rid, k.v, k.e, p.p_name, p.p_brand FROM k JOIN {part} p ON p.p_partkey = k.partkey
)
SELECT CAST(rid AS BIGINT) AS RID,
  CASE v WHEN 0 THEN 'CRM' WHEN 1 THEN ' crm' WHEN 2 THEN 'WEB' ELSE 'CRM' END AS SOURCE_TYPE,
  CAST(CASE WHEN v IN (0, 1) THEN e * 10 ELSE e * 10 + v END AS STRING) AS SOURCE_ID,
  CASE v WHEN 0 THEN concat(p_name, ' works ', CAST(e AS STRING), ', Inc.')
         WHEN 1 THEN concat(upper(p_name), ' WORKS ', CAST(e AS STRING), ' INC')
         WHEN 2 THEN concat('The ', p_name, ' wroks & ', CAST(e AS STRING), ' Co')
         ELSE concat(p_name, ' ', p_brand, ' holdings group') END AS COMPANY_NAME,
  CASE WHEN e % 5 = 0 THEN NULL
       WHEN v = 0 THEN concat(CAST(e % 900 + 1 AS STRING), ' North Main Street')
       WHEN v = 1 THEN concat(CAST(e % 900 + 1 AS STRING), ' north main street')
       WHEN v = 2 THEN concat(CAST(e % 900 + 1 AS STRING), ' N. Main St.')
       ELSE concat(CAST(e % 700 + 11 AS STRING), ' Harbour Boulevard') END AS ADDRESS_LINE_1,
  CASE WHEN e % 5 <> 0 AND v = 2 AND e % 2 = 0 THEN 'Suite 4' ELSE '' END AS ADDRESS_LINE_2,
  CASE WHEN e % 5 = 0 THEN '' ELSE lpad(CAST(e * 37 % 100000 AS STRING), 5, '0') END AS ZIP_CODE,
  CASE WHEN e % 11 = 0 THEN concat('800555', lpad(CAST(e % 10000 AS STRING), 4, '0'))
       WHEN v = 0 THEN concat('(415) 555-', lpad(CAST(e % 10000 AS STRING), 4, '0'))
       WHEN v = 1 THEN concat('415-555-', lpad(CAST(e % 10000 AS STRING), 4, '0'))
       WHEN v = 2 THEN concat('1 415.555.', lpad(CAST(e % 10000 AS STRING), 4, '0'))
       ELSE concat('415555', lpad(CAST(e % 10000 AS STRING), 4, '0')) END AS PHONE_NUMBER,
  CASE WHEN e % 13 = 0 THEN CAST(e % 90 + 10 AS STRING) ELSE '' END AS PHONE_EXTENSION,
  CASE e % 6 WHEN 0 THEN concat('Info@', replace(p_name, ' ', ''), '.com')
             WHEN 1 THEN concat('user', CAST(e AS STRING), '@gmail.com')
             WHEN 2 THEN 'not-an-email'
             WHEN 3 THEN concat('hr@', replace(p_name, ' ', '-'), '.co')
             WHEN 4 THEN NULL
             ELSE concat('admin@', replace(p_name, ' ', ''), '.com ') END AS EMAIL_ADDRESS
FROM n
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """The contact records; ``RID`` is the record order."""
    orders = spread(table(spark, folder, "orders").select("o_orderkey"))
    return spark.sql(CONTACTS_SQL, orders=orders, part=table(spark, folder, "part"))
