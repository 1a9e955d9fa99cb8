"""The derived listings table: business-like rows made from the customer, part, orders and nation tables.

One SQL text, valid in Spark and in other engines, so that both sides of a check see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: {customer}, {part} and {orders} are the tables.
LISTINGS = """
WITH o AS (
  SELECT o_custkey, CAST(count(*) AS BIGINT) AS n_all,
         CAST(sum(CASE WHEN o_orderkey % 4 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_old,
         substr(max(lpad(CAST(o_orderkey AS STRING), 12, '0') || o_orderstatus), 13, 1) AS last_status,
         max(o_orderdate) AS last_list, min(o_orderdate) AS last_detail
  FROM {orders} GROUP BY o_custkey),
b AS (
  SELECT c_custkey AS k, c_nationkey AS nation, c_mktsegment AS seg, c_acctbal AS bal, p_name, o.*
  FROM {customer} LEFT JOIN {part} ON p_partkey = c_custkey % 83 LEFT JOIN o ON o_custkey = c_custkey)
SELECT 'P' || lpad(CAST(k AS STRING), 9, '0') AS place_id, k,
  CASE WHEN k % 97 = 5 THEN NULL WHEN k % 17 = 3 THEN 'Starbucks ' || p_name WHEN k % 37 = 4 THEN 'McDonald''s ' || p_name
       WHEN k % 41 = 6 THEN 'AAA Best Cheap ' || p_name WHEN k % 43 = 7 THEN 'Quality Services ' || p_name
       WHEN k % 47 = 8 THEN 'TOP RATED EXPERT LICENSED ' || upper(p_name)
       WHEN k % 4 = 0 THEN p_name || ' Inc' WHEN k % 4 = 1 THEN 'The ' || p_name || ' Cafe' WHEN k % 4 = 2 THEN p_name || ' Co. Ltd' ELSE p_name END AS name,
  CASE WHEN k % 53 = 9 THEN NULL WHEN k % 6 = 0 THEN 'Plumber' WHEN k % 6 = 1 THEN 'Coffee shop' WHEN k % 6 = 2 THEN 'Law attorney'
       WHEN k % 6 = 3 THEN 'Hair Salon' WHEN k % 6 = 4 THEN 'Hardware store' ELSE lower(seg) END AS category,
  CASE WHEN k % 29 = 1 THEN NULL WHEN k % 31 = 2 THEN 5.0 ELSE CAST(10 + (k * 7) % 41 AS DOUBLE) / 10 END AS rating,
  CASE WHEN k % 59 = 10 THEN NULL WHEN k % 31 = 2 THEN CAST(k % 6 AS BIGINT) ELSE coalesce(n_all, 0) * (1 + k % 23) END AS reviews_count,
  CASE WHEN k % 13 = 2 THEN NULL WHEN k % 61 = 3 THEN '12345' ELSE
    CASE k % 4 WHEN 0 THEN '(' || ac || ') 555-' || line WHEN 1 THEN '+1 ' || ac || '-555-' || line WHEN 2 THEN ac || '.555.' || line || ' ext 12' ELSE 'tel:+1' || ac || '555' || line END END AS phone,
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 11 = 0 THEN 'PO Box ' || CAST(k % 70 AS STRING) || ', Springfield, TX 75001, USA'
       WHEN k % 23 = 1 THEN 'Hauptstr. ' || CAST(k % 90 AS STRING) || ', 1' || lpad(CAST(k % 9000 AS STRING), 4, '0') || ' Berlin, Germany'
       WHEN k % 23 = 2 THEN CAST(k % 90 AS STRING) || ' High Street, London, SW1A 1AA, United Kingdom'
       WHEN k % 23 = 3 THEN '100-000' || CAST(k % 10 AS STRING) || ' Tokyo, Japan'
       WHEN k % 23 = 4 THEN CAST(k % 90 AS STRING) || ' Rue X, Lyon, France'
       ELSE CAST(100 + k % 900 AS STRING) || ' Main St, City ' || CAST(nation AS STRING) || ', CA 9' || lpad(CAST(k % 9999 AS STRING), 4, '0') || ', USA' END AS address,
  CASE WHEN k % 9 = 0 THEN NULL WHEN k % 11 = 4 THEN 'http://shop' || CAST(k AS STRING) || '.xyz/' ELSE 'https://WWW.Shop' || CAST(k % 400 AS STRING) || '.example.com/?utm_source=maps&id=' || CAST(k AS STRING) END AS website,
  CASE WHEN k % 100 = 7 THEN NULL ELSE CAST(30 + nation AS DOUBLE) + CAST(k % 37 AS DOUBLE) * 0.002 + CAST(k % 5 AS DOUBLE) * 0.0001 END AS lat,
  CASE WHEN k % 100 = 7 THEN NULL ELSE CAST(nation * 2 - 20 AS DOUBLE) + CAST(k % 29 AS DOUBLE) * 0.003 END AS lng,
  CASE last_status WHEN 'F' THEN 'Permanently closed' WHEN 'P' THEN 'Temporarily closed' ELSE 'Open now' END AS status_text,
  CAST(coalesce(n_old, 0) AS BIGINT) * (1 + k % 23) AS old_reviews, bal, last_list, last_detail
FROM (SELECT b.*, CASE k % 6 WHEN 0 THEN '212' WHEN 1 THEN '310' WHEN 2 THEN '512' WHEN 3 THEN '206' WHEN 4 THEN '800' ELSE '415' END AS ac,
        lpad(CAST(CASE WHEN k % 5 = 0 THEN k % 60 ELSE 1000 + k % 8999 END AS STRING), 4, '0') AS line FROM b) AS c
"""

#: The same for other engines, with the tables by their names.
LISTINGS_SQL = LISTINGS.format(customer="customer", part="part", orders="orders")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of few bytes is one split of one file, so rows are spread over all cores: what is made of a listing costs more than its shuffle."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(LISTINGS, customer=read("customer"), part=read("part"), orders=read("orders")).repartition("k")
