"""Facts derived from the order tables, so that every operator can run on them at any size.

Regions call nations, nations customers, customers orders, orders parts and suppliers; every fiftieth order calls its
customer back.  Effects, reasons, literals and entry points follow from column values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..facts import Facts
from ..plans.staging import Stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"app::{kind}::{kind[0]}"), F.col(key).cast("string"))


def facts(spark: SparkSession, sf_dir: str, baseline: bool = False) -> Facts:
    """The facts of now, or with ``baseline`` those of before: without the orders whose key is a multiple of seven."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")}
    if baseline:
        t["orders"], t["lineitem"] = t["orders"].where("o_orderkey % 7 <> 0"), t["lineitem"].where("l_orderkey % 7 <> 0")
    region, nation, customer, order = _name("region", "r_regionkey"), _name("nation", "n_nationkey"), _name("customer", "c_custkey"), _name("order", "o_orderkey")
    part, supplier = _name("part", "p_partkey"), _name("supplier", "s_suppkey")
    pairs = [
        t["nation"].select(_name("region", "n_regionkey").alias("src"), nation.alias("dst")),
        t["customer"].select(_name("nation", "c_nationkey").alias("src"), customer.alias("dst")),
        t["orders"].select(_name("customer", "o_custkey").alias("src"), order.alias("dst")),
        t["orders"].where("o_orderkey % 50 = 0").select(order.alias("src"), _name("customer", "o_custkey").alias("dst")),
        t["lineitem"].select(_name("order", "l_orderkey").alias("src"), _name("part", "l_partkey").alias("dst")),
        t["lineitem"].select(_name("order", "l_orderkey").alias("src"), _name("supplier", "l_suppkey").alias("dst")),
    ]
    edges = pairs[0]
    for more in pairs[1:]:
        edges = edges.union(more)
    seen = F.create_map(*[F.lit(x) for kv in (("signup", "Env"), ("purchase", "Exec"), ("error", "Log"), ("view", "Clock"), ("click", "Rand")) for x in kv])
    direct = t["part"].where("p_size % 10 = 0").select(part.alias("fn"), F.lit("Fs").alias("effect"))
    for more in (
        t["part"].where("p_size = 7").select(part.alias("fn"), F.lit("Unknown")),
        t["supplier"].where("s_acctbal < 0").select(supplier.alias("fn"), F.lit("Net")),
        t["orders"].where("o_orderstatus = 'F'").select(order.alias("fn"), F.lit("Db")),
        t["events"].where("event_type in ('signup', 'purchase', 'error', 'view', 'click')").select(_name("customer", "user_id").alias("fn"), F.element_at(seen, F.col("event_type"))),
    ):
        direct = direct.union(more)
    why = F.element_at(F.array(F.lit("dispatch:Owner.m"), F.lit("callback:x"), F.lit("reflect:y"), F.lit("native:z")), (F.col("p_partkey") % 4 + 1).cast("int"))
    reasons = t["part"].where("p_size = 7").select(part.alias("fn"), why.alias("why"))
    host = F.regexp_extract("url", "^[a-z]+://([^/?]*)", 1)
    literals = t["pages"].select((F.col("page_id") + 1).alias("s_suppkey"), host.alias("value")).join(t["supplier"].where("s_acctbal < 0").select("s_suppkey"), "s_suppkey").select(supplier.alias("fn"), F.lit("hosts").alias("kind"), "value")
    literals = literals.union(t["part"].where("p_size % 10 = 0").select(part.alias("fn"), F.lit("paths").alias("kind"), F.concat(F.lit("/data/"), F.lower("p_type"), F.lit("/"), F.col("p_partkey").cast("string"))))
    units = t["region"].select(region.alias("fn"), F.lit(True).alias("entry_point"))
    for frame, name in ((t["nation"], nation), (t["customer"], customer), (t["orders"], order), (t["part"], part), (t["supplier"], supplier)):
        units = units.union(frame.select(name.alias("fn"), F.lit(False)))
    known = units.select("fn")
    direct = direct.distinct().join(known, "fn", "left_semi")
    out = Facts(units, Stage(edges.distinct(), "edges").df, direct, reasons.distinct(), literals.distinct())
    out.calls = out.edges
    return out


#: The same facts as CTEs for DuckDB; {orders} and {lineitem} are the order tables.
SQL = """
edges AS (
  SELECT 'app::region::r' || n_regionkey AS src, 'app::nation::n' || n_nationkey AS dst FROM nation
  UNION SELECT 'app::nation::n' || c_nationkey, 'app::customer::c' || c_custkey FROM customer
  UNION SELECT 'app::customer::c' || o_custkey, 'app::order::o' || o_orderkey FROM {orders}
  UNION SELECT 'app::order::o' || o_orderkey, 'app::customer::c' || o_custkey FROM {orders} WHERE o_orderkey % 50 = 0
  UNION SELECT 'app::order::o' || l_orderkey, 'app::part::p' || l_partkey FROM {lineitem}
  UNION SELECT 'app::order::o' || l_orderkey, 'app::supplier::s' || l_suppkey FROM {lineitem}
), units AS (
  SELECT 'app::region::r' || r_regionkey AS fn, true AS entry_point FROM region
  UNION ALL SELECT 'app::nation::n' || n_nationkey, false FROM nation
  UNION ALL SELECT 'app::customer::c' || c_custkey, false FROM customer
  UNION ALL SELECT 'app::order::o' || o_orderkey, false FROM {orders}
  UNION ALL SELECT 'app::part::p' || p_partkey, false FROM part
  UNION ALL SELECT 'app::supplier::s' || s_suppkey, false FROM supplier
), direct AS (
  SELECT * FROM (
    SELECT 'app::part::p' || p_partkey AS fn, 'Fs' AS effect FROM part WHERE p_size % 10 = 0
    UNION SELECT 'app::part::p' || p_partkey, 'Unknown' FROM part WHERE p_size = 7
    UNION SELECT 'app::supplier::s' || s_suppkey, 'Net' FROM supplier WHERE s_acctbal < 0
    UNION SELECT 'app::order::o' || o_orderkey, 'Db' FROM {orders} WHERE o_orderstatus = 'F'
    UNION SELECT 'app::customer::c' || user_id, CASE event_type WHEN 'signup' THEN 'Env' WHEN 'purchase' THEN 'Exec' WHEN 'error' THEN 'Log' WHEN 'view' THEN 'Clock' ELSE 'Rand' END
      FROM events WHERE event_type IN ('signup', 'purchase', 'error', 'view', 'click')
  ) WHERE fn IN (SELECT fn FROM units)
), reasons AS (
  SELECT DISTINCT 'app::part::p' || p_partkey AS fn,
    CASE p_partkey % 4 WHEN 0 THEN 'dispatch:Owner.m' WHEN 1 THEN 'callback:x' WHEN 2 THEN 'reflect:y' ELSE 'native:z' END AS why
  FROM part WHERE p_size = 7
), literals AS (
  SELECT DISTINCT 'app::supplier::s' || s_suppkey AS fn, 'hosts' AS kind, regexp_extract(url, '^[a-z]+://([^/?]*)', 1) AS value
  FROM pages JOIN supplier ON page_id + 1 = s_suppkey WHERE s_acctbal < 0
  UNION ALL SELECT 'app::part::p' || p_partkey, 'paths', '/data/' || lower(p_type) || '/' || p_partkey FROM part WHERE p_size % 10 = 0
), inferred AS (
  SELECT fn, effect FROM direct
  UNION SELECT e.src, i.effect FROM inferred i JOIN edges e ON e.dst = i.fn
)"""


def sql(baseline: bool = False, suffix: str = "") -> str:
    """The CTEs' text (without WITH), their names with ``suffix``."""
    orders = "(SELECT * FROM orders WHERE o_orderkey % 7 <> 0)" if baseline else "orders"
    lineitem = "(SELECT * FROM lineitem WHERE l_orderkey % 7 <> 0)" if baseline else "lineitem"
    out = SQL.format(orders=orders, lineitem=lineitem)
    if suffix:
        for name in ("edges", "units", "direct", "reasons", "literals", "inferred"):
            out = out.replace(f"{name} AS (", f"{name}{suffix} AS (").replace(f"FROM {name}\n", f"FROM {name}{suffix}\n").replace(f"FROM {name} ", f"FROM {name}{suffix} ").replace(f"JOIN {name} ", f"JOIN {name}{suffix} ").replace(f"FROM {name})", f"FROM {name}{suffix})")
    return out
