"""Queries: searches, listings, lookups, unions, facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import cut, first_line_title, like_folded, preview
from ..operators import search
from ..operators.textindex import TextIndex
from .registry import Registry
from .tables import NO_TITLE, NOTES_SQL, TITLE_SQL, bare, dealt, notes, table

registry = Registry()
query = registry.query
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"WITH {NOTES_SQL} SELECT id, title, snippet FROM notes WHERE room = 'en' AND ({FOLD.format('title')} LIKE '%thing%' ESCAPE '#' OR {FOLD.format('snippet')} LIKE '%thing%' ESCAPE '#') ORDER BY id DESC LIMIT 20")
def note_search(spark, sf_dir):
    """Substring search in title or snippet, of one owner, the newest 20."""
    found = search.search(notes(spark, sf_dir), owner=F.col("room") == "en", text="ThInG", time_column="id")
    return found.select("id", "title", "snippet")


@query(f"WITH {NOTES_SQL} SELECT id, title FROM notes WHERE {FOLD.format('snippet')} LIKE '%e_%d%' ESCAPE '#' OR {FOLD.format('title')} LIKE '%e_%d%' ESCAPE '#' ORDER BY id DESC LIMIT 20")
def note_search_wildcards(spark, sf_dir):
    """Wildcards in the needle stay wildcards."""
    return search.search(notes(spark, sf_dir), text="E_%D", time_column="id").select("id", "title")


@query("SELECT event_id AS id, ts, event_type FROM events WHERE event_type = 'click' AND event_type IN ('click') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 20")
def note_search_tags_dates(spark, sf_dir):
    """All tags and both inclusive date bounds."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "event_type", F.array("event_type").alias("tags"))
    found = search.search(e, tags=["click"], since=F.to_timestamp_ntz(F.lit("2024-01-05 00:00:00")), until=F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")), time_column="ts")
    return found.select("id", "ts", "event_type")


@query("SELECT doc_id AS id, source FROM documents ORDER BY doc_id DESC LIMIT 20")
def note_list_all(spark, sf_dir):
    """The newest 20 without conditions."""
    return search.search(notes(spark, sf_dir), time_column="id").select("id", F.col("wing").alias("source"))


_DRAFTS = "drafts AS (SELECT d.doc_id AS id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'approved' WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 0 THEN 'raw' END AS lifecycle, d.n_chars AS size FROM documents d LEFT JOIN labels l USING (doc_id))"


def _drafts(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    state = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approved").when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "raw")
    return d.join(l, "doc_id", "left").select(F.col("doc_id").alias("id"), state.alias("lifecycle"), F.col("n_chars").alias("size"))


@query(f"WITH {_DRAFTS} SELECT id, lifecycle, size FROM drafts WHERE lifecycle = 'approved' ORDER BY size DESC NULLS LAST, id LIMIT 10")
def list_by_lifecycle(spark, sf_dir):
    return search.by_state(_drafts(spark, sf_dir), "approved", time_column="size")


@query("SELECT o_orderkey AS id, o_orderdate FROM (SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100) WHERE starts_with(o_orderkey::VARCHAR, '1')")
def prefix_lookup_after_topn(spark, sf_dir):
    """The prefix is only looked for among the newest 100."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderdate", "o_orderkey")
    found = search.newest(o, "o_orderdate", "o_orderkey", 100).where(F.col("id").startswith("1"))
    return found.select(F.col("o_orderkey").alias("id"), "o_orderdate")


@query("WITH t AS (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey::VARCHAR LIMIT 50), p AS (SELECT *, count(*) OVER () AS n FROM t WHERE starts_with(c_custkey::VARCHAR, '146')) SELECT c_custkey::VARCHAR AS id, c_acctbal FROM p WHERE n = 1")
def unique_prefix_lookup(spark, sf_dir):
    """A row of the newest 50 whose key begins so, if it is the only one."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_acctbal")
    return search.prefix_after_top(c, "146", time_column="c_acctbal", newest_rows=50, unique=True)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 UNION ALL (SELECT n_nationkey, n_name FROM nation WHERE n_name = 'FRANCE' ORDER BY n_nationkey LIMIT 1)")
def flag_and_code_lookup(spark, sf_dir):
    """Rows by a flag, and the first row with a code."""
    n = table(spark, sf_dir, "nation")
    flagged = n.where(F.col("n_regionkey") == 2).select("n_nationkey", "n_name")
    return flagged.unionByName(n.where(F.col("n_name") == "FRANCE").orderBy("n_nationkey").limit(1).select("n_nationkey", "n_name"))


@query(f"WITH t AS (SELECT doc_id, text, {bare('split_part(' + bare('coalesce(text, chr(32))') + ', chr(10), 1)')} AS line FROM documents) SELECT doc_id, {TITLE_SQL} AS title, length({TITLE_SQL})::INTEGER AS size FROM t")
def title_caps(spark, sf_dir):
    """First lines as titles of every document."""
    title = first_line_title(F.col("text"), NO_TITLE)
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.length(title).alias("size"))


@query("""SELECT doc_id, left(text, 80) || CASE WHEN length(left(text, 80)) = 80 THEN '…' ELSE '' END AS listed,
  replace(left(text, 200), chr(10), ' ') || CASE WHEN length(left(text, 200)) = 200 THEN '…' ELSE '' END AS one_line,
  CASE WHEN length(text) > 4000 THEN left(text, 3900) || '…' ELSE text END AS message, left(text, 60) AS name FROM documents""")
def truncations(spark, sf_dir):
    """The ways to shorten a text."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", preview(t, 80).alias("listed"), preview(t, 200, one_line=True).alias("one_line"), cut(t, 4000, 3900, "…").alias("message"), F.left(t, F.lit(60)).alias("name"))


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'apache license') AND lang = 'en'")
def site_search(spark, sf_dir):
    """All documents with a phrase in any case."""
    return table(spark, sf_dir, "documents").where((F.col("lang") == "en") & F.lower("text").contains("apache license")).select("doc_id", "lang", "source")


@query(r"""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x IN ('apache', 'license', 'software', 'the'))) AS found FROM documents WHERE lang = 'en')
SELECT doc_id, len(found)::INTEGER AS score FROM t WHERE len(found) > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def site_search_ranked(spark, sf_dir):
    """Documents by how many different words of a query they have."""
    english = table(spark, sf_dir, "documents").where(F.col("lang") == "en")
    return search.by_shared_words(english, "The Apache Software License", key="doc_id", most=50).select("doc_id", "score")


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_all, sum(len(w))::BIGINT AS l_all FROM w),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, floor(ln(1 + (n_all::DOUBLE - count(*) + 0.5) / (count(*) + 0.5)) * 1000000)::BIGINT AS weight FROM tf, s GROUP BY term, n_all),
q AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(phrase), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM (SELECT doc_id AS query_id, left(text, 80) AS phrase FROM documents WHERE doc_id % 100 = 0)),
r AS (SELECT query_id, doc_id AS id, sum((weight * 2200 * tf) // (1000 * tf + 300 + (900 * n * n_all) // l_all))::BIGINT AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY 1, 2 HAVING score > 0)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS place, id, score FROM r) WHERE place <= 10""")
def site_search_bm25(spark, sf_dir):
    """The ten best documents for the beginning of every hundredth, by an inverted index."""
    d = dealt(table(spark, sf_dir, "documents"))
    index = TextIndex.build(d, key="doc_id", text="text")
    return index.search(d.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), F.left("text", F.lit(80)).alias("phrase")))


_LOCAL = "local AS (SELECT doc_id AS id, text AS title FROM documents WHERE lang = 'fr' AND doc_id % 7 = 3 ORDER BY doc_id DESC LIMIT {0}), remote AS (SELECT doc_id AS id, text AS title FROM documents WHERE lang = 'fr' ORDER BY doc_id DESC LIMIT {0})"


def _union(spark, sf_dir, most):
    fr = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    local, remote = search.newest(fr.where("id % 7 = 3"), "id", "id", most), search.newest(fr, "id", "id", most)
    return search.local_then_remote(local, remote, key="id", most=most)


@query("WITH " + _LOCAL.format(5000) + " SELECT id, title, 0 AS source_rank FROM local UNION ALL SELECT id, title, 1 AS source_rank FROM remote WHERE id NOT IN (SELECT id FROM local) AND (SELECT count(*) FROM local) < 5000")
def union_local_remote(spark, sf_dir):
    """Local hits, then remote ones that aren't local, as local ones are too few."""
    return _union(spark, sf_dir, 5000)


@query("WITH " + _LOCAL.format(5) + " SELECT id, title, 0 AS source_rank FROM local UNION ALL SELECT id, title, 1 AS source_rank FROM remote WHERE id NOT IN (SELECT id FROM local) AND (SELECT count(*) FROM local) < 5")
def union_local_only(spark, sf_dir):
    """Local hits suffice, so no remote one is taken."""
    return _union(spark, sf_dir, 5)


@query("SELECT coalesce(source, '_unknown') AS wing, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT '_total', count(*) FROM documents")
def wing_facets(spark, sf_dir):
    """Documents per collection, and in total."""
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("_unknown")).alias("wing"))
    return d.rollup("wing").agg(F.count("*").alias("n")).select(F.coalesce("wing", F.lit("_total")).alias("wing"), "n")


@query("SELECT source AS wing, count(*) FILTER (doc_id % 50 <> 0) AS n, greatest(0, count(*) - 1) AS n_displayed FROM documents GROUP BY 1")
def wing_facets_without_placeholders(spark, sf_dir):
    """Exact counts without placeholder rows, beside the display rule that takes one off."""
    d = table(spark, sf_dir, "documents").withColumn("added_by", F.when(F.col("doc_id") % 50 == 0, "system_init").otherwise("user"))
    return d.groupBy(F.col("source").alias("wing")).agg(F.count_if(F.col("added_by") != "system_init").alias("n"), F.greatest(F.lit(0).cast("long"), F.count("*") - 1).alias("n_displayed"))


@query("SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%d.%m.%Y') AS shown, array_to_string([o_orderstatus, o_orderpriority], ', ') AS tags FROM orders")
def posts_by_date(spark, sf_dir):
    """Posts with tags joined and the date as shown."""
    o = table(spark, sf_dir, "orders")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "dd.MM.yyyy").alias("shown"), F.array_join(F.array("o_orderstatus", "o_orderpriority"), ", ").alias("tags"))


@query("SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS moment FROM orders UNION ALL SELECT 'event', event_id, ts FROM events) ORDER BY moment DESC, kind, id LIMIT 50")
def mixed_feed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment"))
    e = table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("moment"))
    return o.unionByName(e).orderBy(F.desc("moment"), "kind", "id").limit(50)


@query("SELECT p_partkey, p_name, p_brand, p_retailprice FROM part WHERE p_brand IN ('Brand#1', 'Brand#11', 'Brand#12', 'Brand#23') AND p_size BETWEEN 5 AND 30 AND p_retailprice BETWEEN 900 AND 1600 ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20")
def faceted_catalogue(spark, sf_dir):
    """Second page of a catalogue under several facets."""
    p = table(spark, sf_dir, "part").where(F.arrays_overlap(F.array("p_brand"), F.array(*map(F.lit, ["Brand#1", "Brand#11", "Brand#12", "Brand#23"]))) & F.col("p_size").between(5, 30) & F.col("p_retailprice").between(900, 1600))
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").offset(20).limit(20).select("p_partkey", "p_name", "p_brand", "p_retailprice")


@query("SELECT c_custkey, 'Customer' AS kind FROM customer WHERE c_name LIKE '%0000001%' ESCAPE '#'")
def literal_search(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(like_folded(F.col("c_name"), "0000001")).select("c_custkey", F.lit("Customer").alias("kind"))
