"""Queries: counters, engagement, tags, recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, relations
from .registry import Registry
from .tables import table

registry = Registry()
query = registry.query


@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS topic_count, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS post_count FROM nation")
def derived_counters(spark, sf_dir):
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    out = relations.counted(n, "n_nationkey", c.where("c_acctbal > 9000"), "c_nationkey", "topic_count")
    return relations.counted(out, "n_nationkey", s, "s_nationkey", "post_count").select("n_nationkey", "topic_count", "post_count")


@query("""SELECT n_name AS topic, sum(l_quantity)::BIGINT AS views, round(avg(l_quantity), 6) AS mean_views, rank() OVER (ORDER BY sum(l_quantity) DESC, n_name)::INTEGER AS rank
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def engagement_by_topic(spark, sf_dir):
    """Views of each topic over publications, drafts and ideas, best first."""
    from pyspark.sql import Window

    l, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = l.select("l_orderkey", "l_quantity").join(o.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.join(c.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.sum("l_quantity").alias("v"), F.count("*").alias("n"))
    out = rows.join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("topic")).agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return out.select("topic", F.col("v").cast("long").alias("views"), F.round(F.col("v") / F.col("n"), 6).alias("mean_views"), F.rank().over(Window.orderBy(F.desc("v"), "topic")).alias("rank"))


@query("SELECT tag, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks FROM (SELECT event_type, unnest(['u' || (user_id % 10), 'k' || (event_id % 4)]) AS tag FROM events) GROUP BY 1")
def tag_clicks(spark, sf_dir):
    tags = F.array(F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")), F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string")))
    e = table(spark, sf_dir, "events").select("event_type", F.explode(tags).alias("tag"))
    return e.groupBy("tag").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"))


_TAGGED = "tagged AS (SELECT doc_id AS id, unnest([lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END]) AS tag FROM documents)"


def _tagged(spark, sf_dir):
    size = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array("lang", "source", size)).alias("tag"))


@query(f"WITH {_TAGGED} SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM tagged x JOIN tagged y ON x.id = y.id AND x.tag < y.tag GROUP BY ALL")
def tag_pairs(spark, sf_dir):
    return graph.tag_pairs(_tagged(spark, sf_dir))


@query("SELECT n_name AS tag FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT 'customer ' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def dead_tags(spark, sf_dir):
    """Tags that nothing has, and objects that nothing refers to."""
    n, s, c, o = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer", "orders"))
    dead = n.join(s.where("s_acctbal > 5000"), F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select(F.col("n_name").alias("tag"))
    orphans = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("tag"))
    return dead.unionByName(orphans)


@query("""WITH i AS (SELECT p_partkey AS id, [p_brand, p_type, 's' || p_size] AS tags, p_size FROM part),
t AS (SELECT id, unnest(tags) AS tag FROM i), c AS (SELECT id AS other, unnest(tags) AS tag, (id % 10) / 100.0::DOUBLE AS penalty FROM i WHERE p_size > 10),
w AS (SELECT id, other, sum(CASE WHEN tag LIKE 'Brand%' THEN 0.5 WHEN tag LIKE 's%' THEN 1.0 ELSE 2.0 END::DOUBLE) - any_value(penalty) AS score FROM t JOIN c USING (tag) WHERE id <> other GROUP BY 1, 2)
SELECT id, other, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other)::INTEGER AS rank FROM w) WHERE rank <= 6""")
def related_items(spark, sf_dir):
    """Six cards for every item, by weighed shared tags less a penalty."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand", "p_type", F.concat(F.lit("s"), F.col("p_size").cast("string"))).alias("tags"), "p_size")
    tags = p.select(F.explode("tags").alias("tag")).distinct()
    weights = tags.withColumn("weight", F.when(F.col("tag").startswith("Brand"), 0.5).when(F.col("tag").startswith("s"), 1.0).otherwise(2.0))
    out = graph.related(p, p.where("p_size > 10"), weights=weights, penalty=(F.col("id") % 10) / F.lit(100.0))
    return out.select("id", "other", F.round("score", 6).alias("score"), "rank")
