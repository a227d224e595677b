"""Stand-in views: permit, parcel and import tables derived from the benchmark tables.

Each view is one SQL text for both engines: table names stand in braces and identifiers in
backticks, which the oracle side turns into plain names and double quotes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_parcel": """
SELECT lpad(CAST(c.c_custkey AS STRING), 8, '0') AS pid,
       CAST(100 + c.c_custkey % 400 AS STRING) AS street_number,
       CASE c.c_custkey % 7 WHEN 0 THEN 'MAIN' WHEN 1 THEN 'N MAIN' WHEN 2 THEN 'OAK' WHEN 3 THEN 'CEDAR HILL'
            WHEN 4 THEN 'ELM' WHEN 5 THEN 'BUSINESS PARK' ELSE 'WEST LAKE' END AS street_name,
       CASE c.c_custkey % 3 WHEN 0 THEN 'ST' WHEN 1 THEN 'AVE' ELSE 'RD' END AS street_type,
       n.n_name AS city, r.r_name AS state, lpad(CAST(c.c_nationkey AS STRING), 5, '9') AS zip_code,
       CAST(100 + c.c_custkey % 400 AS STRING) || ' ' ||
       CASE c.c_custkey % 7 WHEN 0 THEN 'Main' WHEN 1 THEN 'North Main' WHEN 2 THEN 'Oak' WHEN 3 THEN 'Cedar Hill'
            WHEN 4 THEN 'Elm' WHEN 5 THEN 'Business Park' ELSE 'West Lake' END || ' ' ||
       CASE c.c_custkey % 3 WHEN 0 THEN 'Street' WHEN 1 THEN 'Avenue' ELSE 'Road' END || ', ' || n.n_name AS situs_address
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
""",
    "fx_permit_raw": """
SELECT CASE WHEN o.o_orderkey % 97 = 0 THEN NULL WHEN o.o_orderkey % 89 = 0 THEN ' ## '
            ELSE ' BP#-' || CAST(o.o_orderkey - o.o_orderkey % 5 % 2 AS STRING) || '. ' END AS `Permit Number`,
       CASE o.o_orderkey % 12 WHEN 0 THEN ' new sfr' WHEN 1 THEN 'Addition' WHEN 2 THEN 'kitchen remodel' WHEN 3 THEN 'alt'
            WHEN 4 THEN 'Repair roof' WHEN 5 THEN 'demo' WHEN 6 THEN 'elec' WHEN 7 THEN 'plumb' WHEN 8 THEN 'mech'
            WHEN 9 THEN 'renewal' WHEN 10 THEN NULL ELSE 'Sign' END AS `Permit Type`,
       CASE WHEN o.o_orderkey % 53 = 0 THEN 'not a date'
            WHEN o.o_orderkey % 59 = 0 THEN '01/01/1901' WHEN o.o_orderkey % 61 = 0 THEN '01/01/2999'
            ELSE lpad(CAST(month(o.o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(day(o.o_orderdate) AS STRING), 2, '0')
                 || '/' || CAST(year(o.o_orderdate) AS STRING) END AS `Issue Date`,
       CASE WHEN o.o_orderkey % 41 = 0 THEN '  ' WHEN o.o_orderkey % 43 = 0 THEN 'PO 1'
            ELSE ' ' || CAST(100 + o.o_custkey % 400 AS STRING) || '  ' ||
            CASE o.o_custkey % 7 WHEN 0 THEN 'main' WHEN 1 THEN 'North Main' WHEN 2 THEN 'oak' WHEN 3 THEN 'Cedar  Hill'
                 WHEN 4 THEN 'elm' WHEN 5 THEN 'business park' ELSE 'West Lake' END || ' ' ||
            CASE o.o_orderkey % 4 WHEN 0 THEN 'St' WHEN 1 THEN 'Ave #101' WHEN 2 THEN 'Road Apt 4B' ELSE 'Street, Unit 9' END END AS `Address`,
       CASE WHEN o.o_orderkey % 19 = 0 THEN lower(c.c_name) ELSE 'o''neil mc-' || lower(c.c_mktsegment) END AS `Owner Name`,
       CASE WHEN o.o_orderkey % 31 = 0 THEN 'n/a' WHEN o.o_orderkey % 37 = 0 THEN '-$500.25'
            ELSE '$' || CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS STRING) || '.50' END AS `Valuation`,
       CASE o.o_orderkey % 6 WHEN 0 THEN 'New  Single Family Home, Parcel #' || CAST(10000000 + o.o_custkey AS STRING)
            WHEN 1 THEN 'Kitchen Remodel' WHEN 2 THEN 'Commercial Tenant Improvement APN: 123-456-' || lpad(CAST(o.o_custkey % 1000 AS STRING), 3, '0')
            WHEN 3 THEN 'Room  addition' WHEN 4 THEN 'Demolition (Parcel ID: ' || CAST(90000000 + o.o_custkey AS STRING) || ')'
            ELSE 'other work' END AS `Description`,
       CASE WHEN o.o_orderkey % 10 = 0 THEN lpad(CAST(o.o_custkey AS STRING), 8, '0') ELSE NULL END AS `Parcel ID`,
       lower(o.o_orderstatus) AS `Status`, o.o_orderkey AS src_row
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
""",
    "fx_property_raw": """
SELECT ' PP/' || CAST(c.c_custkey AS STRING) AS `Account Number`, 'o''hara ' || lower(c.c_name) AS `Owner Name`,
       CAST(100 + c.c_custkey % 400 AS STRING) || '   oak ave' AS `Owner Address`, lower(c.c_mktsegment) || ' co' AS `Business Name`,
       CASE WHEN c.c_custkey % 23 = 0 THEN NULL WHEN c.c_custkey % 29 = 0 THEN 'X 1'
            ELSE CAST(100 + c.c_custkey % 400 AS STRING) || ' oak  avenue' END AS `Property Location`,
       CASE c.c_custkey % 7 WHEN 0 THEN 'com' WHEN 1 THEN 'computer' WHEN 2 THEN 'res' WHEN 3 THEN 'ind' WHEN 4 THEN 'agr'
            WHEN 5 THEN 'man' ELSE 'furniture' END AS `Property Type`,
       CASE WHEN c.c_custkey % 50 = 0 THEN '25,000,000' ELSE '$' || CAST(CAST(floor(c.c_acctbal) AS BIGINT) AS STRING) END AS `Value`,
       'active' AS `Status`, c.c_custkey AS src_row
FROM {customer} c
""",
    "fx_import_job": """
SELECT e.user_id AS ImportJobID, CASE WHEN e.user_id % 2 = 0 THEN 'Permit' ELSE 'PersonalProperty' END AS ImportType,
       min(e.ts) AS ImportDate, CASE WHEN e.user_id % 11 = 0 THEN NULL ELSE max(e.ts) END AS CompletedDate,
       count(*) AS RecordsTotal, count(CASE WHEN e.event_type <> 'error' THEN 1 END) AS RecordsSuccessful,
       count(CASE WHEN e.event_type = 'error' THEN 1 END) AS RecordsFailed
FROM {events} e GROUP BY e.user_id
""",
    "fx_staging": """
SELECT e.event_id AS StagingID, e.user_id AS ImportJobID, 'P' || CAST(e.event_id % 700 AS STRING) AS PermitNumber,
       CASE WHEN e.event_type = 'error' THEN 'Failed' WHEN e.event_id % 10 = 0 THEN 'Skipped' WHEN e.event_id % 10 = 1 THEN 'Pending' ELSE 'Processed' END AS ProcessingStatus,
       e.ts AS CreatedDate, e.props AS SourceData
FROM {events} e
""",
    "fx_personal_property": """
SELECT c.c_custkey AS PersonalPropertyID, 'PP' || lpad(CAST(c.c_custkey AS STRING), 8, '0') AS AccountNumber,
       c.c_name AS OwnerName, c.c_mktsegment AS PropertyType FROM {customer} c
""",
    "fx_assessment": """
SELECT o.o_custkey AS PersonalPropertyID, CAST(year(o.o_orderdate) AS INT) AS AssessmentYear, max(o.o_totalprice) AS AssessedValue
FROM {orders} o GROUP BY o.o_custkey, CAST(year(o.o_orderdate) AS INT)
""",
    "fx_parcel_owner": """
SELECT lpad(CAST(o.o_custkey AS STRING), 8, '0') AS pid, 'OWNER ' || CAST(o.o_orderkey AS STRING) AS OwnerName,
       CASE WHEN row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) = 1 THEN 1 ELSE 0 END AS IsPrimary
FROM {orders} o
""",
    # Settings: up to one row per customer and order priority, and updates to them in sequence.
    "fx_settings": """
SELECT 'C' || CAST(o_custkey AS STRING) AS category, o_orderpriority AS name,
       'v' || CAST(max(o_orderkey) AS STRING) AS value, 'from order ' || CAST(min(o_orderkey) AS STRING) AS description,
       max(o_orderkey) AS seq
FROM {orders} GROUP BY o_custkey, o_orderpriority
""",
    "fx_setting_update": """
SELECT 'C' || CAST(o_custkey + o_orderkey % 3 AS STRING) AS category, o_orderpriority AS name,
       'u' || CAST(o_orderkey AS STRING) AS value,
       CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'note ' || CAST(o_orderkey AS STRING) END AS description,
       o_orderkey AS seq
FROM {orders}
""",
    # Feeds from tables: money and dates with types of their own, values over 10^7 and below 0.
    "fx_permit_typed": """
SELECT o.o_orderkey AS src_row, CAST(o.o_totalprice AS DOUBLE) * CASE o.o_orderkey % 5 WHEN 0 THEN 1000 WHEN 1 THEN -1 ELSE 1 END AS valuation,
       CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE CAST(o.o_orderdate AS TIMESTAMP) END AS issue_date
FROM {orders} o
""",
    "fx_property_typed": """
SELECT c.c_custkey AS src_row, CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE c.c_custkey * 10000000 - 25000000 END AS value FROM {customer} c
""",
    # Every date layout, by turns.
    "fx_date_text": """
SELECT src_row,
       CASE src_row % 16 WHEN 0 THEN m || '/' || d || '/' || y WHEN 1 THEN y || '-' || m || '-' || d WHEN 2 THEN y || '-' || m || '-' || d || 'T10:20:30'
            WHEN 3 THEN y || '-' || m || '-' || d || ' 10:20:30.123' WHEN 4 THEN m || '/' || d || '/' || y || ' 3:05 PM'
            WHEN 5 THEN m || '/' || d || '/' || y || ' 13:05:09' WHEN 6 THEN y || '/' || m || '/' || d WHEN 7 THEN m || '-' || d || '-' || y
            WHEN 8 THEN y || m || d WHEN 9 THEN d || '-Mar-' || y WHEN 10 THEN 'JAN ' || d || ', ' || y WHEN 11 THEN m || '/' || d || '/' || substring(y, 3, 2)
            WHEN 12 THEN ' ' || y || '-' || m || '-' || d || ' 10:20 ' WHEN 13 THEN '13/45/' || y WHEN 14 THEN m || '/' || d || '/' || y || ' 9:07:01 am' ELSE 'soon' END AS text
FROM (SELECT o.o_orderkey AS src_row, CAST(year(o.o_orderdate) AS STRING) AS y, lpad(CAST(month(o.o_orderdate) AS STRING), 2, '0') AS m,
             lpad(CAST(day(o.o_orderdate) AS STRING), 2, '0') AS d FROM {orders} o)
""",
    # As fx_parcel and the permits' addresses, but with many parcels on each street number.
    "fx_parcel_dense": """
SELECT lpad(CAST(c.c_custkey AS STRING), 8, '0') AS pid, CAST(100 + c.c_custkey % 3 AS STRING) AS street_number,
       CASE c.c_custkey % 5 WHEN 0 THEN 'MAIN' WHEN 1 THEN 'N MAIN' WHEN 2 THEN 'MAINLAND' WHEN 3 THEN 'OLD MAIN' ELSE 'ELM' END AS street_name,
       'ST' AS street_type, n.n_name AS city, 'X' AS state, '00000' AS zip_code,
       CAST(100 + c.c_custkey % 3 AS STRING) || ' ' ||
       CASE c.c_custkey % 5 WHEN 0 THEN 'Main' WHEN 1 THEN 'North Main' WHEN 2 THEN 'Mainland' WHEN 3 THEN 'Old Main' ELSE 'Elm' END || ' ' ||
       CASE WHEN c.c_custkey % 11 = 0 THEN 'Street, Unit 4' WHEN c.c_custkey % 13 = 0 THEN 'Street East' ELSE 'Street' END AS situs_address
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
""",
    "fx_dense_address": """
SELECT o.o_orderkey AS src_row,
       CASE WHEN o.o_orderkey % 7 = 0 THEN '' ELSE CAST(100 + o.o_custkey % 3 AS STRING) || ' ' END ||
       CASE o.o_orderkey % 4 WHEN 0 THEN 'Main St' WHEN 1 THEN 'north main street' WHEN 2 THEN 'Elm  St' ELSE 'Mainland St' END AS address
FROM {orders} o
""",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


class Tables:
    """The tables of one data folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        return self.spark.sql(sql, **{n: self.base(n) for n in _names(sql)})


def oracle_ctes(*names: str) -> str:
    """``name AS (...)`` for each view, joined by commas, for the oracle engine."""
    parts = []
    for name in names:
        sql = VIEWS[name].strip()
        sql = sql.format(**{n: n for n in _names(sql)}).replace("`", '"')
        parts.append(f"{name} AS ({sql})")
    return ",\n".join(parts)
