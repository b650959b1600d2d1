"""Queries: change logs, versions, limits, dialogs, calendars, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar, changes, dialogs, sequences
from ..operators.logstore import DELETE, PATCH, PUT, LogStore
from ..scratch import new_folder
from .registry import Registry
from .tables import bare, table

registry = Registry()
query = registry.query


@query("""WITH g AS (SELECT user_id, max((ts, event_id)) FILTER (event_type = 'error') AS last FROM events GROUP BY 1),
l AS (SELECT e.* FROM events e JOIN g USING (user_id) WHERE event_type <> 'error' AND (last IS NULL OR (ts, event_id) > last))
SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, min(ts) AS created_at, arg_max(event_type, (ts, event_id)) AS title, arg_max(value, (ts, event_id)) AS value, max(ts) AS updated_at FROM l GROUP BY 1""")
def upsert_fold(spark, sf_dir):
    """The table left by a log: what the first change since the last delete set, and what the last one did."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.col("event_id").alias("first_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("title"), "value", F.col("ts").alias("updated_at"))
    return changes.fold(e, "user_id", ["ts", "event_id"], keep_first=["first_id", "created_at"], take_last=["title", "value", "updated_at"], deleted=F.col("event_type") == "error")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) <> 'error' AS authenticated FROM events GROUP BY 1")
def authenticated_users(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = changes.fold(e, "user_id", ["ts", "event_id"], take_last=["event_type"])
    token = F.when(F.col("event_type") != "error", F.col("event_type"))
    return last.select("user_id", token.isNotNull().alias("authenticated"))


@query("SELECT 1 + coalesce(max(n_regionkey), 0) AS version, coalesce((SELECT max(n_regionkey) FROM nation WHERE n_name = 'nowhere'), 0) AS none FROM nation")
def schema_version(spark, sf_dir):
    """The largest version, 0 if there is none."""
    n = table(spark, sf_dir, "nation")
    return n.agg((F.coalesce(F.max("n_regionkey"), F.lit(0)) + 1).alias("version"), F.coalesce(F.max(F.when(F.col("n_name") == "nowhere", F.col("n_regionkey"))), F.lit(0)).alias("none"))


_CHAIN = "v AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS version, o_orderpriority || ' ' || o_orderstatus AS name, o_orderdate FROM orders)"


@query(f"WITH {_CHAIN} SELECT o_orderkey, o_custkey, version, CASE WHEN version = 1 THEN left(name, 70) ELSE '[v' || version || '] ' || left(name, 70) END AS version_name FROM v")
def version_chain(spark, sf_dir):
    name = F.concat("o_orderpriority", F.lit(" "), "o_orderstatus")
    return changes.version_chain(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], name).select("o_orderkey", "o_custkey", "version", "version_name")


@query(f"WITH {_CHAIN} SELECT o_custkey, max(version) AS version, arg_max(o_orderkey, version) AS o_orderkey, (CASE WHEN max(version) = 1 THEN 1 ELSE max(version) END + 1)::INTEGER AS next FROM v GROUP BY 1")
def latest_version(spark, sf_dir):
    o = changes.version_chain(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus"))
    last = o.groupBy("o_custkey").agg(F.max("version").alias("version"), F.max_by("o_orderkey", "version").alias("o_orderkey"))
    return last.withColumn("next", changes.next_version(F.col("version")))


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN 'processed' ELSE event_type END AS lifecycle, CASE WHEN event_type = 'signup' THEN TIMESTAMP '2024-02-01' END AS processed_at FROM events")
def state_transition(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("lifecycle"), F.lit(None).cast("timestamp_ntz").alias("processed_at"))
    return changes.transition(e, F.col("lifecycle") == "signup", "processed", F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")))


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10' AND event_type <> 'error' THEN 'refreshed' ELSE event_type END AS token FROM events")
def conditional_refresh(spark, sf_dir):
    """Expired rows that have a token get a new one."""
    expired = (F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))) & (F.col("event_type") != "error")
    return table(spark, sf_dir, "events").select("event_id", F.when(expired, "refreshed").otherwise(F.col("event_type")).alias("token"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, true AS accepted, [t] AS kept FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, len(list_filter(r.kept, lambda k: e.t - k < 86400000000)) < 5,
    CASE WHEN len(list_filter(r.kept, lambda k: e.t - k < 86400000000)) < 5 THEN list_append(list_filter(r.kept, lambda k: e.t - k < 86400000000), e.t) ELSE list_filter(r.kept, lambda k: e.t - k < 86400000000) END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, accepted FROM r""")
def rate_limit(spark, sf_dir):
    """At most five accepted events in any day for each user."""
    out = sequences.rate_limited(table(spark, sf_dir, "events"), user="user_id", time="ts", key="event_id", window_seconds=86400, most=5)
    return out.select("user_id", "event_id", "accepted")


@query(f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE (conv_id + turn) % 5 WHEN 0 THEN ' /skip ' WHEN 1 THEN ' Да ' ELSE coalesce(text, '') END AS text FROM conversations),
w AS (SELECT conv_id, max(text) FILTER (i = 1) AS title, max(text) FILTER (i = 2) AS content, max(text) FILTER (i = 3) AS tags, max(text) FILTER (i = 4) AS confirm FROM t GROUP BY 1)
SELECT conv_id, title, CASE WHEN {bare('content')} = '/skip' THEN '' ELSE content END AS content,
  CASE WHEN tags IS NULL THEN NULL WHEN {bare('tags')} = '/skip' THEN '' ELSE array_to_string(list_filter(regexp_split_to_array({bare('tags')}, '\\s+'), lambda x: x <> ''), '|') END AS tags,
  CASE WHEN confirm IS NULL THEN 'open' WHEN lower({bare('confirm')}) IN ('да', 'yes', 'д', 'y') THEN 'done' ELSE 'cancelled' END AS state FROM w""")
def dialog_fold(spark, sf_dir):
    """Four-step dialogs from their turns."""
    n = (F.col("conv_id") + F.col("turn")) % 5
    text = F.when(n == 0, " /skip ").when(n == 1, " Да ").otherwise(F.coalesce("text", F.lit("")))
    out = sequences.dialogs(table(spark, sf_dir, "conversations"), ["title", "content", "tags", "confirm"], key="conv_id", order=["turn"], text=text, optional=["content", "tags"], lists=["tags"])
    return out.withColumn("tags", F.array_join("tags", "|"))


#: What a user says at an event, so that users' events are conversations of many dialogs.
_SAYINGS = ["/event", "/note", "/add_rule", "25.12.2025 14:00", " 26.12.2025 09:30 ", "31.02.2025 10:00", "45", "0", "да", "Yes ", "нет", "/skip", " /skip ", "", "two  words\\there", "/cancel", "да", "d", "1.2.2026 7:05", "y"]


def _sayings_sql() -> str:
    answer = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SAYINGS)).replace("\\t", "' || chr(9) || '")
    no = f"({bare('e.text')} <> '/cancel')"
    step = "r.command || r.step"
    wait = "(r.command IS NOT NULL AND r.state IS NULL)"
    time_ok = f"try_strptime({bare('e.text')}, '%d.%m.%Y %H:%M') IS NOT NULL"
    digits = f"regexp_full_match({bare('e.text')}, '[0-9]+')"
    skipped = f"{bare('e.text')} = '/skip'"
    iso = "strftime({0}, '%Y-%m-%dT%H:%M:%S+00:00')"
    words = f"array_to_string(list_filter(regexp_split_to_array({bare('e.text')}, '\\s+'), lambda x: x <> ''), ' ')"
    confirms = f"lower({bare('e.text')}) IN ('да', 'yes', 'д', 'y')"
    # What an answer does in each state: is it taken, what is kept, in which state does it end the dialog.
    taken = f"""CASE WHEN {step} IN ('/note1', '/note2', '/event3') THEN {no} WHEN {step} = '/event1' THEN {no} AND {time_ok} WHEN {step} = '/event2' THEN {no} AND ({digits} OR {time_ok}) ELSE {no} AND e.text <> '' END"""
    value = f"""CASE WHEN {step} IN ('/note1', '/note2', '/event3') AND {skipped} THEN '' WHEN {step} IN ('/note2', '/add_rule1') THEN {words} WHEN {step} = '/add_rule2' THEN {bare('e.text')}
      WHEN {step} = '/event1' OR ({step} = '/event2' AND NOT {digits}) THEN {iso.format(f"try_strptime({bare('e.text')}, '%d.%m.%Y %H:%M')")}
      WHEN {step} = '/event2' THEN {iso.format(f"strptime(r.v[2], '%Y-%m-%dT%H:%M:%S+00:00') + to_minutes(try_cast({bare('e.text')} AS INTEGER))")} ELSE e.text END"""
    last = "(CASE r.command WHEN '/event' THEN 4 ELSE 3 END)"
    end = f"""CASE WHEN NOT {no} THEN 'cancelled' WHEN e.text = '' AND {step} NOT IN ('/note1', '/note2', '/event3') THEN 'ended'
      WHEN r.step = {last} AND NOT {confirms} THEN 'cancelled' WHEN r.step = {last} AND r.command = '/event' AND r.v[2] >= r.v[3] THEN 'rejected' WHEN r.step = {last} THEN 'done' END"""
    begins = f"{bare('e.text')} IN ('/event', '/note', '/add_rule')"
    return f"""WITH RECURSIVE e AS (SELECT user_id, i, CASE m {answer} END AS text, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, (event_id * 7 + floor(value)::BIGINT) % {len(_SAYINGS)} AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::VARCHAR AS command, NULL::VARCHAR AS state, 0 AS step, 0 AS number, 0 AS turns, []::VARCHAR[] AS v FROM e WHERE i = 1
  UNION ALL SELECT r.user_id, e.i, CASE WHEN {wait} THEN r.command WHEN {begins} THEN {bare('e.text')} END,
    CASE WHEN {wait} THEN {end} END,
    CASE WHEN {wait} THEN r.step + (CASE WHEN {taken} AND r.step < {last} THEN 1 ELSE 0 END) ELSE 0 END,
    r.number + (CASE WHEN NOT {wait} AND {begins} THEN 1 ELSE 0 END),
    CASE WHEN {wait} THEN r.turns + 1 ELSE 1 END,
    CASE WHEN {wait} THEN CASE WHEN {taken} AND r.step < {last} THEN list_append(r.v, {value}) ELSE r.v END ELSE [] END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT r.user_id, number::INTEGER AS number, command, coalesce(state, 'open') AS state,
  CASE WHEN state IS NULL THEN (CASE command WHEN '/note' THEN ['title', 'content', 'tags', 'confirm'] WHEN '/event' THEN ['title', 'start', 'end', 'description', 'confirm'] ELSE ['name', 'patterns', 'destination', 'confirm'] END)[step + 1] END AS waits_for,
  v[1] AS first, v[2] AS second, v[3] AS third, v[4] AS fourth, turns::INTEGER AS turns
FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i WHERE command IS NOT NULL AND (state IS NOT NULL OR r.i = n)"""


@query(_sayings_sql())
def dialog_automaton(spark, sf_dir):
    """All three dialogs, again and again in each user's turns, with answers that can't be read."""
    e = table(spark, sf_dir, "events")
    said = F.element_at(F.array(*(F.lit(s.replace("\\t", "\t")) for s in _SAYINGS)), ((F.col("event_id") * 7 + F.floor("value")) % len(_SAYINGS) + 1).cast("int"))
    out = dialogs.run(e, key="user_id", order=["ts", "event_id"], text=said)
    by_place = [F.coalesce(*(F.when(F.col("command") == d.command, F.element_at("values", F.lit(d.steps[i].field))) for d in (dialogs.NOTE, dialogs.EVENT, dialogs.RULE) if i < len(d.steps) - 1)) for i in range(4)]
    return out.select("user_id", "number", "command", "state", "waits_for", *(c.alias(n) for c, n in zip(by_place, ("first", "second", "third", "fourth"), strict=True)), "turns")


@query("SELECT event_id, ts AS starts, ts + to_minutes(floor(value)::INTEGER) AS ends, event_type FROM events WHERE ts + to_minutes(floor(value)::INTEGER) > TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-17' ORDER BY ts, event_id LIMIT 10")
def agenda_window(spark, sf_dir):
    """The first ten events that overlap a week."""
    ends = F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("starts"), ends.alias("ends"), "event_type")
    return calendar.agenda(e, F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00")), 7, start="starts", end="ends", key="event_id")


#: Rules by event, of every kind, and starts that don't take place.
_RULES = ["RRULE:FREQ=DAILY", "FREQ=DAILY;INTERVAL=3;COUNT=20", "RRULE:FREQ=WEEKLY", "RRULE:FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,WE,SU;COUNT=11", "FREQ=WEEKLY;BYDAY=FR,TU;UNTIL=20240309T120000Z", "FREQ=MONTHLY;COUNT=4", "FREQ=MONTHLY;INTERVAL=2", "FREQ=YEARLY", "", "FREQ=DAILY;UNTIL=20240303"]
#: Every day from the start to the window's end is looked at, and what the rule takes is numbered from the first.
_OCCURRENCES = f"""e AS (SELECT event_id, ts, to_minutes(floor(value)::INTEGER * 30 + 1) AS len, event_id % {len(_RULES)} AS k FROM events),
p AS (SELECT *, CASE k WHEN 1 THEN 3 WHEN 3 THEN 2 WHEN 6 THEN 2 ELSE 1 END AS step, CASE k WHEN 1 THEN 20 WHEN 3 THEN 11 WHEN 5 THEN 4 WHEN 8 THEN 1 END AS most,
  CASE k WHEN 4 THEN TIMESTAMP '2024-03-09 12:00:00' WHEN 9 THEN TIMESTAMP '2024-03-03 23:59:59' END AS last, CASE k WHEN 2 THEN [isodow(ts)] WHEN 3 THEN [1, 3, 7] WHEN 4 THEN [2, 5] END AS days FROM e),
d AS (SELECT *, ts + to_days(i::INTEGER) AS moment, i FROM (SELECT *, unnest(range(0, date_diff('day', ts, TIMESTAMP '2024-03-15') + 2)) AS i FROM p)),
t AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY moment) AS n FROM d WHERE CASE WHEN k IN (0, 1, 9) THEN i % step = 0
  WHEN k IN (2, 3, 4) THEN list_contains(days, isodow(moment)) AND (date_diff('day', date_trunc('week', ts), date_trunc('week', moment)) // 7) % step = 0
  WHEN k IN (5, 6) THEN day(moment) = day(ts) AND ((year(moment) - year(ts)) * 12 + month(moment) - month(ts)) % step = 0 WHEN k = 7 THEN day(moment) = day(ts) AND month(moment) = month(ts) ELSE i = 0 END),
o AS (SELECT event_id, n::INTEGER AS occurrence, moment AS starts, moment + len AS ends FROM t WHERE (most IS NULL OR n <= most) AND (last IS NULL OR moment <= last) AND moment + len > TIMESTAMP '2024-03-01' AND moment < TIMESTAMP '2024-03-15' AND NOT (event_id % 3 = 0 AND moment IN (ts + to_days(42), ts + to_days(45))))"""


def _occurrences(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rule = F.element_at(F.array(*map(F.lit, _RULES)), (F.col("event_id") % len(_RULES) + 1).cast("int"))
    day = lambda n: F.col("ts") + F.make_dt_interval(days=F.lit(n))
    e = e.select("event_id", F.col("ts").alias("starts"), (F.col("ts") + F.make_dt_interval(mins=(F.floor("value") * 30 + 1).cast("int"))).alias("ends"), rule.alias("rule"), F.when(F.col("event_id") % 3 == 0, F.array(day(42), day(45))).alias("except"))
    window = (F.to_timestamp_ntz(F.lit(f"2024-03-{d} 00:00:00")) for d in ("01", "15"))
    return calendar.occurrences(e, *window, start="starts", end="ends", rule="rule", except_="except").select("event_id", "occurrence", "starts", "ends")


@query(f"WITH {_OCCURRENCES} SELECT * FROM o")
def recurring_occurrences(spark, sf_dir):
    """What repeating events put into two weeks, each with its number since the first."""
    return _occurrences(spark, sf_dir)


@query(f"WITH {_OCCURRENCES} SELECT * FROM o WHERE ends > TIMESTAMP '2024-03-08' AND starts < TIMESTAMP '2024-03-09' ORDER BY starts, event_id LIMIT 10")
def recurring_agenda(spark, sf_dir):
    """The first ten occurrences of a day."""
    return calendar.agenda(_occurrences(spark, sf_dir), F.to_timestamp_ntz(F.lit("2024-03-08 00:00:00")), 1, start="starts", end="ends", key="event_id")


@query("SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'upcoming' ELSE 'past' END AS phase FROM orders")
def upcoming_and_past(spark, sf_dir):
    return calendar.split_at(table(spark, sf_dir, "orders"), F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), "o_orderdate").select("o_orderkey", "phase")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-01-01'")
def due_publications(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return calendar.due(o, F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")), at="o_orderdate", state="O", state_column="o_orderstatus").select("o_orderkey", "o_orderdate")


@query("SELECT event_id, h::INTEGER AS delay_hours, ts + to_hours(h) AS pull_at FROM events, (VALUES (1), (24), (168)) v(h) WHERE event_type = 'signup'")
def metric_pulls(spark, sf_dir):
    return calendar.pulls(table(spark, sf_dir, "events").where("event_type = 'signup'"), "ts").select("event_id", "delay_hours", "pull_at")


@query("""WITH d AS (SELECT arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY date_trunc('day', ts) ORDER BY date_trunc('day', ts) DESC LIMIT 7),
w AS (SELECT arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY date_trunc('week', ts) ORDER BY date_trunc('week', ts) DESC LIMIT 4),
m AS (SELECT arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY date_trunc('month', ts) ORDER BY date_trunc('month', ts) DESC LIMIT 6)
SELECT event_id, ts FROM events WHERE event_id IN (SELECT * FROM d UNION SELECT * FROM w UNION SELECT * FROM m)""")
def retention(spark, sf_dir):
    """Snapshots kept: seven daily, four weekly, six monthly."""
    return changes.retained(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "ts")


@query(registry.oracles["rate_limit"])
def streamed_rate_limit(spark, sf_dir):
    """The same limiter over a stream of events with state per user."""
    from ..streaming.jobs import limit_stream, verdicts
    from ..scratch import new_folder

    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    folder = new_folder(spark)
    limit_stream(events, f"{folder}/out", f"{folder}/state", window_seconds=86400, most=5, once=True).awaitTermination()
    return verdicts(spark, f"{folder}/out").select(F.col("user").alias("user_id"), F.col("id").alias("event_id"), "accepted")


@query("SELECT day, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type FROM events) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY day, event_type")
def streamed_daily_counts(spark, sf_dir):
    """Tumbling days closed by a watermark of one hour."""
    from ..streaming.once import run_once

    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    out = run_once(timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n"))
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("""WITH l AS (SELECT doc_id // 3 AS id, doc_id AS seq, text AS content, doc_id % 9 = 0 AS gone FROM documents),
k AS (SELECT id, arg_max(content, seq) AS content, arg_max(gone, seq) AS gone FROM l GROUP BY 1) SELECT id, content, count(*) OVER () AS total FROM k WHERE NOT gone""")
def drawer_store(spark, sf_dir):
    """Drawers written, written over and deleted by id, and how many there are."""
    log = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).alias("id"), F.col("doc_id").alias("seq"), F.col("text").alias("content"), (F.col("doc_id") % 9 == 0).alias("gone"))
    out = changes.fold(log, "id", ["seq"], take_last=["content"], deleted=F.col("gone"))
    return out.crossJoin(F.broadcast(out.agg(F.count("*").alias("total"))))  # one row


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 14 = 0 THEN 'again' WHEN o_orderkey % 3 = 0 THEN 'moved' ELSE o_orderpriority END AS summary,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 14 <> 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS start,
  CASE WHEN o_orderkey % 14 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS location FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 14 = 0""")
def event_store(spark, sf_dir):
    """Events created, patched and deleted in batches, one of which comes twice, between compactions; patches of events that aren't there do nothing."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(key.alias("id"), F.col("o_orderpriority").alias("summary"), F.col("o_orderdate").alias("start"), F.col("o_orderstatus").alias("location"))
    every = lambda n: orders.where(F.col("id") % n == 0)
    change = lambda rows, op, seq, **values: rows.withColumns(values | {"op": F.lit(op), "seq": F.lit(seq)})
    patch = lambda rows, seq, **values: change(rows, PATCH, seq, given=F.array(*map(F.lit, values)), **values)
    store = LogStore(spark, new_folder(spark), "id", "long", "summary string, start timestamp_ntz, location string", buckets=8)
    moved = patch(every(3), 0, summary=F.lit("moved"), start=F.col("start") + F.expr("INTERVAL 1 DAY"))
    unplaced = patch(every(5), 1, location=F.lit(None).cast("string"))
    absent = patch(orders.withColumn("id", -F.col("id")), 2, summary=F.lit("nobody"))
    patches = moved.unionByName(unplaced).unionByName(absent)
    store.append(change(orders, PUT, 0), 0)
    store.append(patches, 1)
    store.compact()
    store.append(patches, 1)
    store.append(change(every(7), DELETE, 0), 2)
    store.append(change(every(14), PUT, 0, summary=F.lit("again"), location=F.lit(None).cast("string")), 3)
    return store.read()
