"""Queries: vector retrieval, context, triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, metric, vectors
from ..operators.logstore import LogStore
from ..scratch import new_folder
from .registry import Registry
from .tables import NOTES_SQL, notes, table

registry = Registry()
query = registry.query

_NEAR = """d AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE))) AS distance
  FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND {0}), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM d)"""


def _queries(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"WITH {_NEAR.format('true')} SELECT query_id, vec_id, place::INTEGER AS place, round(distance, 5) AS distance FROM t WHERE place <= 5 AND distance <= 1.5")
def vector_topk(spark, sf_dir):
    """The five nearest by squared distance, then those within 1.5."""
    hits = vectors.nearest(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), key="vec_id")
    return hits.select("query_id", "vec_id", "place", F.round("distance", 5).alias("distance"))


@query(f"WITH {_NEAR.format('e.label IN (1, 2, 3)')} SELECT query_id, vec_id, place::INTEGER AS place, greatest(0, 100 - trunc(round(distance, 6) * 50)::INTEGER) AS relevance FROM t WHERE place <= 10 AND distance <= 1.3 AND vec_id % 10 <> 0")
def vector_topk_filtered(spark, sf_dir):
    """Restricted before, filtered after the top ten; no refill."""
    from ..functions.text import relevance

    hits = vectors.nearest(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), key="vec_id", k=10, max_distance=1.3, before=F.col("label").isin(1, 2, 3), after=F.col("vec_id") % 10 != 0)
    return hits.select("query_id", "vec_id", "place", relevance(F.round("distance", 6)).alias("relevance"))


@query(f"""WITH {NOTES_SQL}, {_NEAR.format('true')}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS i FROM t WHERE place <= 3 AND distance <= 1.3)
SELECT query_id, string_agg(chr(10) || '### Источник ' || i || ': ' || coalesce(title, '(фрагмент)') || ' [' || coalesce(wing, '?') || ']' || chr(10) || left(coalesce(content, ''), 1500), chr(10) ORDER BY i) AS context FROM h LEFT JOIN notes ON id = vec_id GROUP BY 1""")
def context_assembly(spark, sf_dir):
    """Three nearest sources within 1.3 in one text for each query."""
    hits = vectors.nearest(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), key="vec_id", k=3, max_distance=1.3)
    return vectors.context(hits.join(notes(spark, sf_dir), F.col("vec_id") == F.col("id"), "left"))


@query("""WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings),
d AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)) / (e.norm * q.norm) AS distance FROM n e, n q WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(abs(distance), 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM d) WHERE place <= 4""")
def vector_topk_cosine(spark, sf_dir):
    hits = vectors.nearest(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), key="vec_id", k=4, max_distance=9, metric="cosine")
    return hits.select("query_id", "vec_id", F.round(F.abs("distance"), 5).alias("distance"))


_TRIPLES = "triples AS (SELECT 'c' || o_custkey AS subject, l_returnflag AS predicate, 'p' || l_partkey AS object, CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS valid_from FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _triples(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    l = table(spark, sf_dir, "lineitem").join(o, "l_orderkey")
    return l.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject"), F.col("l_returnflag").alias("predicate"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("object"), F.when(F.col("l_linenumber") != 3, F.col("l_shipdate")).alias("valid_from"))


@query("""WITH v AS (SELECT min(vec_id) AS id, embedding FROM embeddings GROUP BY embedding), d AS (SELECT a.id AS a, b.id AS b, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)) AS distance FROM v a JOIN v b ON a.id < b.id)
SELECT a, b, round(distance, 5) AS distance FROM d WHERE distance <= 1.2""")
def idea_near_duplicates(spark, sf_dir):
    """Ideas whose embeddings are nearly the same, of equal ones the first."""
    pairs = metric.near_pairs(table(spark, sf_dir, "embeddings"), key="vec_id", max_distance=1.2)
    return pairs.select("a", "b", F.round("distance", 5).alias("distance"))


@query(f"WITH {_TRIPLES} SELECT * FROM triples WHERE subject = 'c7' AND (valid_from IS NULL OR valid_from <= TIMESTAMP '1997-06-01')")
def kg_as_of(spark, sf_dir):
    """What held of an entity at a time, outgoing."""
    return graph.facts(_triples(spark, sf_dir), "c7", as_of=F.to_timestamp_ntz(F.lit("1997-06-01 00:00:00")), direction="out")


@query(f"WITH {_TRIPLES} SELECT * FROM triples WHERE subject = 'p11' OR object = 'p11'")
def kg_both_directions(spark, sf_dir):
    return graph.facts(_triples(spark, sf_dir), "p11")


@query(f"WITH {_TRIPLES} SELECT 'triples' AS metric, '' AS name, count(*) AS n FROM triples UNION ALL SELECT 'entities', '', count(DISTINCT e) FROM (SELECT subject AS e FROM triples UNION ALL SELECT object FROM triples) UNION ALL SELECT 'predicate', predicate, count(*) FROM triples GROUP BY predicate")
def kg_stats(spark, sf_dir):
    return graph.graph_stats(_triples(spark, sf_dir))


@query(f"WITH {_NEAR.format('e.label = 3 AND e.vec_id % 2 = 1')} SELECT query_id, vec_id, place::INTEGER AS place FROM t WHERE place <= 5 AND distance <= 4")
def vector_two_key_filter(spark, sf_dir):
    """Both keys must match before the search."""
    hits = vectors.nearest(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), key="vec_id", max_distance=4, before=(F.col("label") == 3) & (F.col("vec_id") % 2 == 1))
    return hits.select("query_id", "vec_id", "place")


_ADDED = "SELECT 'c' || o_custkey AS subject, l_returnflag AS predicate, 'p' || l_partkey AS object, CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS valid_from, 'o' || o_orderkey AS source, l_linenumber % 3 AS batch, o_orderkey * 10 + l_linenumber AS seq, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
_ID = "sha256(subject || chr(31) || predicate || chr(31) || object || chr(31) || coalesce(strftime(valid_from, '%Y-%m-%d %H:%M:%S'), ''))"


@query(f"""WITH a AS (SELECT *, {_ID} AS id FROM ({_ADDED})), gone AS (SELECT id FROM a WHERE predicate = 'R' AND l_linenumber = 4)
SELECT id, subject, predicate, object, valid_from, arg_max(source, batch * 1000000000000 + seq) AS source FROM a WHERE id NOT IN (SELECT id FROM gone) GROUP BY ALL""")
def triple_store(spark, sf_dir):
    """Triples added in batches, one of them twice, some deleted, between compactions."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    added = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select(
        text("c", "o_custkey").alias("subject"), F.col("l_returnflag").alias("predicate"), text("p", "l_partkey").alias("object"), F.when(F.col("l_linenumber") != 3, F.col("l_shipdate")).alias("valid_from"),
        text("o", "l_orderkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_linenumber")
    store = LogStore(spark, new_folder(spark), "id", "binary", graph.TRIPLES, buckets=8)
    for batch in (0, 1, 0, 2):
        graph.add_triples(store, added.where(F.col("l_linenumber") % 3 == batch), batch)
        if batch == 1:
            store.compact()
    gone = added.where((F.col("predicate") == "R") & (F.col("l_linenumber") == 4))
    graph.delete_triples(store, gone, 3)
    return graph.stored_triples(store)
