"""Queries over attribute tables."""

from pyspark.sql import functions as F

from cellweave.operators import tables
from cellweave.plans.catalog import register, rounded, table


@register("SELECT o.*, c_mktsegment, c_acctbal FROM orders o LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark, sf_dir):
    return tables.lookup_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", ["c_mktsegment", "c_acctbal"])


@register("SELECT n_nationkey AS id, n_name AS label, n_regionkey FROM nation")
def rename_many(spark, sf_dir):
    return tables.rename_many(table(spark, sf_dir, "nation"), {"n_nationkey": "id", "n_name": "label", "none": "x"})


@register("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 3) OR p_size BETWEEN 7 AND 9 OR p_size BETWEEN 40 AND 45")
def extract_categories(spark, sf_dir):
    return table(spark, sf_dir, "part").where(tables.in_categories(F.col("p_size"), "1,3,7-9,40-45")).select("p_partkey", "p_size")


@register("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 1 WHEN p_size BETWEEN 11 AND 30 THEN 2 ELSE 0 END AS size_class FROM part")
def recode_attribute(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tables.recode(F.col("p_size"), [(1, 10, 1), (11, 30, 2)], 0).alias("size_class"))


@register("SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part")
def highest_points(spark, sf_dir):
    return tables.sort_points(table(spark, sf_dir, "part"), "p_retailprice", "p_partkey").select("p_partkey", "p_retailprice", "place")


@register(
    """
    SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey), c_custkey) AS k FROM customer) WHERE k <= 20
    """
)
def stratified_sample(spark, sf_dir):
    return tables.stratified_sample(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 20, "c_custkey", 7).select("c_mktsegment", "c_custkey")


def _nations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct(), s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()


_A, _B = "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000", "SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"


@register(f"SELECT * FROM ({_A}) INTERSECT SELECT * FROM ({_B})")
def overlay_and(spark, sf_dir):
    return tables.overlay(*_nations(spark, sf_dir), "and")


@register(f"SELECT * FROM ({_A}) UNION SELECT * FROM ({_B})")
def overlay_or(spark, sf_dir):
    return tables.overlay(*_nations(spark, sf_dir), "or")


@register(f"SELECT k FROM (SELECT * FROM ({_A}) UNION ALL SELECT * FROM ({_B})) GROUP BY k HAVING count(*) = 1")
def overlay_xor(spark, sf_dir):
    return tables.overlay(*_nations(spark, sf_dir), "xor")


@register(f"SELECT * FROM ({_A}) EXCEPT SELECT * FROM ({_B})")
def overlay_not(spark, sf_dir):
    return tables.overlay(*_nations(spark, sf_dir), "not")


@register("SELECT n_regionkey, n_nationkey, 'left' AS side, 1::BIGINT AS n FROM nation WHERE n_nationkey % 5 = 0")
def table_differences(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    return tables.differences(n, n.where("n_nationkey % 5 <> 0")).withColumn("n", F.col("n").cast("long"))


@register(
    r"""
    SELECT event_id, trim(regexp_replace(event_type || '   ' || user_id || ' ', '\s+', ' ', 'g')) AS neat FROM events
    """
)
def clean_cells(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.col("event_type"), F.lit("   "), F.col("user_id").cast("string"), F.lit(" ")).alias("neat"))
    return tables.clean_cells(e, ["neat"])


@register(
    """
    SELECT c_nationkey, count(*) AS count, round(sum(c_acctbal), 4) AS c_acctbal_sum, round(avg(c_acctbal), 6) AS c_acctbal_average, round(median(c_acctbal), 6) AS c_acctbal_median,
           min(c_acctbal) AS c_acctbal_minimum, max(c_acctbal) AS c_acctbal_maximum, round(max(c_acctbal) - min(c_acctbal), 6) AS c_acctbal_range,
           round(stddev_pop(c_acctbal), 4) AS c_acctbal_stddev, count(DISTINCT c_mktsegment) AS c_mktsegment_diversity
    FROM customer GROUP BY c_nationkey
    """
)
def statistics_matrix(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    one = tables.statistics_matrix(c, "c_nationkey", ["c_acctbal"], ["sum", "average", "median", "minimum", "maximum", "range", "stddev"])
    two = tables.statistics_matrix(c, "c_nationkey", ["c_mktsegment"], ["diversity"]).drop("count")
    return rounded(one.join(two, "c_nationkey")).withColumns({k: F.round(F.col(k) + 1e-9, 4) for k in ("c_acctbal_sum", "c_acctbal_stddev")})


@register(
    """
    WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, l_quantity AS mode, n AS occurrences FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) = 1
    """
)
def zonal_mode(spark, sf_dir):
    return tables.mode(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


@register("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size * 2 ELSE p_size END AS p_size FROM part")
def update_where(spark, sf_dir):
    return tables.update_where(table(spark, sf_dir, "part"), "p_size", "p_size > 25", "p_size * 2").select("p_partkey", "p_size")


@register(
    """
    SELECT l_orderkey, l_linenumber, round(CASE WHEN sum(l_quantity) OVER w = 0 THEN 0 ELSE o_totalprice * l_quantity / sum(l_quantity) OVER w END, 4) AS share
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY l_orderkey)
    """
)
def weights_by_area(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", F.round(tables.weights_by_area(j, "l_orderkey", "o_totalprice", "l_quantity") + 1e-9, 4).alias("share"))
