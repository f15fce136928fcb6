"""Named queries over the standard tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import dense_quarter, quarter_id
from ..session import RUNTIME_SETTINGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name; ``covers`` lists the operator ids of the inventory it exercises."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        QUERIES[name], COVERS[name] = run, covers
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return add


# Views shared by the SQL side: the same bindings as the methods of ``Tables`` below. Unit prices are whole numbers, so
# that interpolated quantiles are exact on both sides.
def sql_point(key: str) -> str:
    return f"40.45::double + (({key}) * 7919 % 5000)::double / 10000 AS lat, -74.30::double + (({key}) * 104729 % 6000)::double / 10000 AS lon"


VIEWS = {
    "sales": f"""SELECT o_orderkey AS id, o_totalprice AS price, o_orderdate AS ts, o_custkey AS parcel, n_regionkey AS borough,
        c_nationkey AS region, c_mktsegment AS kind, (500 + o_orderkey * 37 % 4500)::double AS area,
        floor(o_totalprice / (500 + o_orderkey * 37 % 4500)::double) AS psf,
        (year(o_orderdate) * 10 + quarter(o_orderdate))::int AS qid,
        ((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1)::int AS dq, {sql_point('o_custkey')}
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "deals": """SELECT l_orderkey, l_suppkey, n_name AS district, s_nationkey AS region, n_regionkey AS borough, l_returnflag AS kind,
        l_quantity AS area, l_extendedprice AS amount, floor(l_extendedprice / l_quantity) AS psqm, l_shipdate AS ts,
        (year(l_shipdate) * 10 + quarter(l_shipdate))::int AS qid
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "cust": f"SELECT c_custkey AS id, c_nationkey AS region, c_mktsegment AS kind, c_acctbal AS bal, {sql_point('c_custkey')} FROM customer",
    "poi": f"SELECT p_partkey AS id, p_brand AS brand, p_type AS kind, p_size AS size, p_retailprice AS worth, {sql_point('p_partkey')} FROM part",
    "stations": f"SELECT s_suppkey AS id, s_name AS name, s_nationkey AS line, s_acctbal AS bal, {sql_point('s_suppkey * 13 + 5')} FROM supplier",
    "ev": f"SELECT event_id AS id, ts, user_id, event_type AS kind, value, {sql_point('event_id * 17 + 3')} FROM events",
}


def with_views(sql: str) -> str:
    """Prepend the shared views a query mentions."""
    used = [n for n in VIEWS if n in _words(sql)]
    if not used:
        return sql
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    recursive = "RECURSIVE " if body[:15].upper().startswith("WITH RECURSIVE") else ""
    if body[:4].upper() == "WITH":
        return f"WITH {recursive}{head},\n{body[4:].lstrip()[len(recursive):] if recursive else body[4:]}"
    return f"WITH {head}\n{body}"


def _words(sql: str) -> set[str]:
    import re

    return set(re.findall(r"\b\w+\b", sql))


class Tables:
    """The standard tables of one folder, plus the property-style views the queries are bound to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        for key, value in RUNTIME_SETTINGS.items():
            spark.conf.set(key, value)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @staticmethod
    def point(key: Column) -> dict[str, Column]:
        k = key.cast("bigint")
        return {"lat": F.lit(40.45) + F.pmod(k * 7919, F.lit(5000)).cast("double") / F.lit(10000.0),
                "lon": F.lit(-74.30) + F.pmod(k * 104729, F.lit(6000)).cast("double") / F.lit(10000.0)}

    @property
    def sales(self) -> DataFrame:
        """Orders as property sales; the customer is the parcel, its nation the region, the nation's region the borough."""
        area = (F.lit(500) + F.col("o_orderkey") * 37 % 4500).cast("double")
        xy = self.point(F.col("o_custkey"))
        return (
            self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("ts"),
                    F.col("o_custkey").alias("parcel"), F.col("n_regionkey").alias("borough"), F.col("c_nationkey").alias("region"),
                    F.col("c_mktsegment").alias("kind"), area.alias("area"), F.floor(F.col("o_totalprice") / area).cast("double").alias("psf"),
                    quarter_id("o_orderdate").alias("qid"), dense_quarter("o_orderdate", 1995).alias("dq"),
                    xy["lat"].alias("lat"), xy["lon"].alias("lon"))
        )

    @property
    def deals(self) -> DataFrame:
        """Line items as deed transactions in the supplier's nation as district."""
        return (
            self.lineitem.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select("l_orderkey", "l_suppkey", F.col("n_name").alias("district"), F.col("s_nationkey").alias("region"),
                    F.col("n_regionkey").alias("borough"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("area"),
                    F.col("l_extendedprice").alias("amount"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("psqm"),
                    F.col("l_shipdate").alias("ts"), quarter_id("l_shipdate").alias("qid"))
        )

    @property
    def cust(self) -> DataFrame:
        xy = self.point(F.col("c_custkey"))
        return self.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("kind"),
                                    F.col("c_acctbal").alias("bal"), xy["lat"].alias("lat"), xy["lon"].alias("lon"))

    @property
    def poi(self) -> DataFrame:
        xy = self.point(F.col("p_partkey"))
        return self.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"),
                                F.col("p_size").alias("size"), F.col("p_retailprice").alias("worth"), xy["lat"].alias("lat"), xy["lon"].alias("lon"))

    @property
    def stations(self) -> DataFrame:
        xy = self.point(F.col("s_suppkey") * 13 + 5)
        return self.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("line"),
                                    F.col("s_acctbal").alias("bal"), xy["lat"].alias("lat"), xy["lon"].alias("lon"))

    @property
    def ev(self) -> DataFrame:
        xy = self.point(F.col("event_id") * 17 + 3)
        return self.events.select(F.col("event_id").alias("id"), "ts", "user_id", F.col("event_type").alias("kind"), "value",
                                  xy["lat"].alias("lat"), xy["lon"].alias("lon"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round for comparison; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})
