"""Queries: scalar rules, classification, relations and fan-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times
from ..operators import relations
from .registry import Registry
from .tables import bare, table

registry = Registry()
query = registry.query


@query("SELECT vec_id, greatest(0, 100 - trunc(coalesce(d, 0.0) * 50)::INTEGER) AS relevance FROM (SELECT vec_id, CASE WHEN vec_id % 11 <> 0 THEN (vec_id % 400) / 150.0::DOUBLE END AS d FROM embeddings)")
def relevance_score(spark, sf_dir):
    d = F.when(F.col("vec_id") % 11 != 0, (F.col("vec_id") % 400) / F.lit(150.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", tx.relevance(d).alias("relevance"))


@query(r"""WITH q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '  ' || text WHEN doc_id % 3 = 1 THEN ' wing:' || source || '  ' || text ELSE 'wing:' || source END AS q FROM documents),
t AS (SELECT doc_id, """ + bare("q") + r""" AS q FROM q)
SELECT doc_id, CASE WHEN starts_with(q, 'wing:') THEN regexp_extract(q, '^wing:(\S*)', 1) END AS wing,
  CASE WHEN starts_with(q, 'wing:') THEN """ + bare(r"regexp_replace(q, '^wing:\S*', '')") + r""" ELSE q END AS rest FROM t""")
def scoped_queries(spark, sf_dir):
    """Queries with and without ``wing:name`` in front."""
    d = F.col("doc_id") % 3
    q = F.when(d == 0, F.concat(F.lit("  "), "text")).when(d == 1, F.concat(F.lit(" wing:"), "source", F.lit("  "), "text")).otherwise(F.concat(F.lit("wing:"), "source"))
    wing, rest = tx.scoped_query(q)
    return table(spark, sf_dir, "documents").select("doc_id", wing.alias("wing"), rest.alias("rest"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'misc' END AS wing FROM events")
def domain_membership(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", F.when(e.isin("click", "view"), e).otherwise("misc").alias("wing"))


@query("""WITH e AS (SELECT event_id, date_trunc('minute', ts) AS s, CASE event_id % 3 WHEN 0 THEN (event_id % 200)::VARCHAR WHEN 1 THEN strftime(ts + INTERVAL 2 HOUR, '%d.%m.%Y %H:%M') ELSE 'later' END AS given FROM events),
p AS (SELECT *, CASE WHEN regexp_full_match(given, '[0-9]{1,9}') THEN s + to_minutes(given::INTEGER) ELSE try_strptime(given, '%d.%m.%Y %H:%M') END AS e FROM e)
SELECT event_id, s AS starts, e AS ends, strftime(s, '%d.%m.%Y %H:%M') || ' — ' || strftime(e, '%H:%M') AS shown, coalesce(e > s, false) AS valid FROM p""")
def date_parsing(spark, sf_dir):
    """Ends given in minutes, as a time, or not at all; what is shown, and whether the interval is one."""
    at = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    n = F.col("event_id") % 3
    given = F.when(n == 0, (F.col("event_id") % 200).cast("string")).when(n == 1, F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "dd.MM.yyyy HH:mm")).otherwise("later")
    e = table(spark, sf_dir, "events").select("event_id", at.alias("starts"), given.alias("given"))
    e = e.withColumn("ends", times.end_time(F.col("starts"), F.col("given")))
    shown = F.concat(F.date_format("starts", "dd.MM.yyyy HH:mm"), F.lit(" — "), F.date_format("ends", "HH:mm"))
    return e.select("event_id", "starts", "ends", shown.alias("shown"), times.valid_interval(F.col("starts"), F.col("ends")).alias("valid"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN lower(c_name) || '@x.org' END AS email, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'en' END, 'ru') AS lang FROM customer")
def email_normalise(spark, sf_dir):
    given = F.concat(F.lit(" \t"), "c_name", F.when(F.col("c_custkey") % 5 != 0, F.lit("@X.org")).otherwise(""), F.lit("  "))
    lang = F.when(F.col("c_custkey") % 4 == 0, "en")
    return table(spark, sf_dir, "customer").select("c_custkey", tx.normal_email(given).alias("email"), tx.or_default(lang, F.lit("ru")).alias("lang"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AS valid FROM orders")
def signature_check(spark, sf_dir):
    """Signatures in any case; every third is for another password."""
    total, invoice = F.floor("o_totalprice").cast("string"), F.col("o_orderkey").cast("string")
    password = F.when(F.col("o_orderkey") % 3 == 0, "no").otherwise("pw")
    signature = F.upper(F.md5(F.concat_ws(":", total, invoice, password).cast("binary")))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.signature_holds(total, invoice, "pw", signature).alias("valid"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM documents")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.html_escape(F.col("text")).alias("escaped"))


@query("SELECT page_id, CASE page_id % 2 WHEN 0 THEN url ELSE '/en' || url END AS path, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def locale_paths(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, url).otherwise(F.concat(F.lit("/en"), url)).alias("path"), F.parse_url(url, F.lit("HOST")).alias("host"))


_VALUE_SQL = "url_decode(replace(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: starts_with(x, '{0}='))[1][len('{0}=') + 1:], '+', ' '))"


@query(f"SELECT page_id, {_VALUE_SQL.format('utm_source')} AS source, {_VALUE_SQL.format('email')} AS email FROM (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'email=a%2Bb+' || page_id || '%40example.org#end' AS url FROM pages)")
def form_prefill(spark, sf_dir):
    """What a form is filled with from its page's address."""
    mail = F.concat(F.lit("email=a%2Bb+"), F.col("page_id").cast("string"), F.lit("%40example.org#end"))
    url = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), mail)
    return table(spark, sf_dir, "pages").select("page_id", tx.query_parameter(url, "utm_source").alias("source"), tx.query_parameter(url, "email").alias("email"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN '1' ELSE '2' END AS tone, CASE WHEN event_type IN ('signup', 'error', 'purchase') THEN 'medium' ELSE 'long' END AS length, coalesce(map {'click': '#112233', 'view': '#445566'}[event_type], '#000000') AS color FROM events")
def keyed_rules(spark, sf_dir):
    """Values by key, with a default."""
    e = F.col("event_type")
    colors = F.create_map(F.lit("click"), F.lit("#112233"), F.lit("view"), F.lit("#445566"))
    return table(spark, sf_dir, "events").select("event_id", F.when(e.isin("click", "view"), "1").otherwise("2").alias("tone"), F.when(e.isin("signup", "error", "purchase"), "medium").otherwise("long").alias("length"), F.coalesce(F.try_element_at(colors, e), F.lit("#000000")).alias("color"))


@query("SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END, ''), nullif(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, ''), 'none') AS value FROM orders")
def coalesce_chain(spark, sf_dir):
    first = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.or_default(first, F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")), F.lit("none")).alias("value"))


@query("SELECT user_id, bool_or(user_id IN (1, 5, 8)) AS listed, true AS open FROM events GROUP BY 1")
def allow_list(spark, sf_dir):
    """An empty list lets everyone in."""
    allowed = lambda ids: F.when(F.size(ids) == 0, True).otherwise(F.array_contains(ids, F.col("user_id")))
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", allowed(F.array(*(F.lit(i).cast("long") for i in (1, 5, 8)))).alias("listed"), allowed(F.array().cast("array<long>")).alias("open"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, string_agg(i || '. ' || o_orderkey || ' → ' || o_orderstatus, chr(10) ORDER BY i) FILTER (i <= 5) || CASE WHEN max(n) > 5 THEN chr(10) || '...и ещё ' || (max(n) - 5) ELSE '' END AS text, max(n) AS n FROM r GROUP BY 1""")
def numbered_lists(spark, sf_dir):
    """The first five of each group in one text, and how many more there are."""
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(" → "), "o_orderstatus")
    return relations.numbered(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], line, 5)


_RULES = [(1, "pics", ["1.html", "/a"], [], ""), (2, "docs", ["/B", "2.HTML"], ["image/", "text/x"], "D"), (3, "late", ["html"], ["video/mp4"], "Late")]
_RULES_SQL = """rules(id, kind, pos, pattern, dest) AS (VALUES (1, 0, 0, '1.html', 'pics'), (1, 0, 1, '/a', 'pics'), (2, 0, 0, '/b', 'D'), (2, 0, 1, '2.html', 'D'), (2, 1, 0, 'image/', 'D'), (2, 1, 1, 'text/x', 'D'), (3, 0, 0, 'html', 'Late'), (3, 1, 0, 'video/mp4', 'Late')),
files AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN upper(url) WHEN 1 THEN url || '2.html' WHEN 2 THEN url || '/B' ELSE url END AS name, CASE page_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'Image/png' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'video/mp4' WHEN 5 THEN 'application/zip' END AS mime FROM pages),
hits AS (SELECT page_id, dest, row_number() OVER (PARTITION BY page_id ORDER BY id, kind, pos) AS place FROM files JOIN rules ON (kind = 0 AND suffix(lower(name), pattern)) OR (kind = 1 AND starts_with(mime, pattern))),
sorted AS (SELECT f.page_id, f.name, f.mime, coalesce(h.dest, CASE WHEN starts_with(mime, 'image/') THEN 'Images' WHEN starts_with(mime, 'video/') THEN 'Videos' WHEN starts_with(mime, 'application/pdf') THEN 'Documents/PDF' WHEN starts_with(mime, 'application/zip') THEN 'Archives' WHEN starts_with(mime, 'text/') THEN 'TextFiles' END) AS destination FROM files f LEFT JOIN hits h ON h.page_id = f.page_id AND h.place = 1)"""


def _classified(spark, sf_dir, strategy="by_type"):
    rules = spark.createDataFrame(_RULES, "id long, name string, extension_patterns array<string>, mime_patterns array<string>, destination_folder_name string")
    n, url = F.col("page_id"), F.col("url")
    name = F.when(n % 4 == 0, F.upper(url)).when(n % 4 == 1, F.concat(url, F.lit("2.html"))).when(n % 4 == 2, F.concat(url, F.lit("/B"))).otherwise(url)
    mimes = ["image/png", "Image/png", "text/plain", "application/pdf", "video/mp4", "application/zip"]
    mime = F.get(F.array(*map(F.lit, mimes)), (n % 7).cast("int"))
    files = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), mime.alias("mime"))
    return relations.classify(files, rules, key="page_id", mime="mime", strategy=strategy)


@query(f"WITH {_RULES_SQL} SELECT page_id, name, mime, destination FROM sorted")
def classify_first_match(spark, sf_dir):
    """Destination of each file by the first rule that matches, else by its media type."""
    return _classified(spark, sf_dir)


@query(f"WITH {_RULES_SQL} SELECT CASE WHEN destination IS NULL THEN 'skipped' WHEN page_id % 13 = 0 THEN 'error' ELSE 'moved' END AS outcome, count(*) AS n FROM sorted GROUP BY 1")
def sort_outcomes(spark, sf_dir):
    outcome = F.when(F.col("destination").isNull(), "skipped").when(F.col("page_id") % 13 == 0, "error").otherwise("moved")
    return _classified(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {_RULES_SQL} SELECT DISTINCT destination AS folder FROM sorted WHERE destination IS NOT NULL AND destination NOT IN ('pics', 'Images')")
def folders_to_create(spark, sf_dir):
    """Destinations that don't exist yet."""
    have = spark.createDataFrame([("pics",), ("Images",)], "folder string")
    return _classified(spark, sf_dir).where("destination is not null").select(F.col("destination").alias("folder")).distinct().join(have, "folder", "left_anti")


@query("""SELECT o_orderkey, c.c_name AS customer, n.n_name AS nation, r.r_name AS region
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def relation_expand(spark, sf_dir):
    """Orders with customer and nation nested, and the region."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    out = relations.expand(o.select("o_orderkey", "o_custkey"), "customer", c, "o_custkey", "c_custkey", ["c_custkey", "c_name", "c_nationkey"])
    out = relations.expand(out.withColumn("c_nationkey", F.col("customer.c_nationkey")), "nation", n, "c_nationkey", "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])
    out = relations.expand(out.withColumn("n_regionkey", F.col("nation.n_regionkey")), "region", r, "n_regionkey", "r_regionkey", ["r_name"])
    return out.select("o_orderkey", F.col("customer.c_name").alias("customer"), F.col("nation.n_name").alias("nation"), F.col("region.r_name").alias("region"))


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, o.o_orderpriority FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') o ON o.o_orderkey = l.l_orderkey")
def key_lookup_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(o, "l_orderkey", "left")


_CHANNELS = [("site", "Site", True), ("tg", "Telegram", True), ("dzen", "Dzen", True), ("vk", "VK", False), ("fb", "Facebook", True)]
_CHANNELS_SQL = "channels(code, channel, enabled) AS (VALUES ('site', 'Site', true), ('tg', 'Telegram', true), ('dzen', 'Dzen', true), ('vk', 'VK', false), ('fb', 'Facebook', true))"


@query(f"WITH {_CHANNELS_SQL} SELECT o_orderkey, code, variant, CASE WHEN code IN ('site', 'dzen') THEN '1' ELSE '2' END AS tone, CASE WHEN code IN ('tg', 'fb', 'vk') THEN 'medium' ELSE 'long' END AS length FROM orders, channels, (VALUES ('A'), ('B')) v(variant) WHERE enabled")
def fanout_variants(spark, sf_dir):
    """Each idea for every enabled channel in two variants."""
    channels = spark.createDataFrame(_CHANNELS, "code string, channel string, enabled boolean").where("enabled").select("code")
    out = relations.fan_out(table(spark, sf_dir, "orders").select("o_orderkey"), channels, ["A", "B"])
    return out.select("o_orderkey", "code", "variant", F.when(F.col("code").isin("site", "dzen"), "1").otherwise("2").alias("tone"), F.when(F.col("code").isin("tg", "fb", "vk"), "medium").otherwise("long").alias("length"))


@query(f"WITH {_CHANNELS_SQL} SELECT o_orderkey, code FROM orders, channels WHERE enabled AND (o_orderstatus <> 'P' OR code = 'site')")
def channel_choice(spark, sf_dir):
    """Private ideas go to the site alone."""
    channels = spark.createDataFrame(_CHANNELS, "code string, channel string, enabled boolean").where("enabled").select("code")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return relations.fan_out(o, channels, ["A"]).where((F.col("o_orderstatus") != "P") | (F.col("code") == "site")).select("o_orderkey", "code")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, n_name) AS color, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END, n_regionkey) AS ornament FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def override_inherit(spark, sf_dir):
    """Own values before the parent's."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("color"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("ornament"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("color"), F.col("n_regionkey").alias("ornament"))
    return relations.inherit(c, n, "c_nationkey", "n_nationkey", ["color", "ornament"]).select("c_custkey", "color", "ornament")


@query("SELECT c_custkey, coalesce(n_regionkey, c_custkey % 5)::INTEGER AS direction FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END")
def direction_from_topic(spark, sf_dir):
    """A topic's direction wins over the row's own."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("topic"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("topic"), "n_regionkey")
    return c.join(n, "topic", "left").select("c_custkey", F.coalesce("n_regionkey", F.col("c_custkey") % 5).cast("int").alias("direction"))


@query("SELECT doc_id, concat_ws(chr(10) || chr(10), '## Канал' || chr(10) || source, '## Тон' || chr(10) || CASE WHEN doc_id % 3 = 1 THEN 'Тон 1 (Душевный)' ELSE 'Тон 2 (Живой)' END, CASE WHEN doc_id % 5 = 0 THEN '## Направление' || chr(10) || lang END, CASE WHEN doc_id % 2 = 0 THEN '## Тема' || chr(10) || lang END, CASE WHEN doc_id % 7 = 0 THEN '## Подход A' || chr(10) || 'A' END, '## Исходная идея' || chr(10) || text, '## Задача' || chr(10) || 'Напиши пост по этой идее' || CASE WHEN doc_id % 7 = 0 THEN ' и подходе A.' ELSE '.' END) AS prompt FROM documents")
def prompt_assembly(spark, sf_dir):
    """Sections apart by blank lines; those without a value are left out."""
    section = lambda head, value: F.concat(F.lit(f"## {head}\n"), value)
    every = lambda n: F.col("doc_id") % n == 0
    tone = F.when(F.col("doc_id") % 3 == 1, "Тон 1 (Душевный)").otherwise("Тон 2 (Живой)")
    task = F.concat(F.lit("Напиши пост по этой идее"), F.when(every(7), " и подходе A.").otherwise("."))
    topic = F.when(every(2), F.col("lang"))
    heads = [("Канал", F.col("source")), ("Тон", tone), ("Направление", F.when(every(5), F.col("lang"))), ("Тема", topic), ("Подход A", F.when(every(7), F.lit("A"))), ("Исходная идея", F.col("text")), ("Задача", task)]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n\n", *(section(head, value) for head, value in heads)).alias("prompt"))
