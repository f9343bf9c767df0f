"""Queries over keyed state, rankings, hashed combat, masking and record lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Tables, query
from ..functions import hashing as H
from ..operators import ranges
from ..operators import state as ST


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status, o_custkey AS first_seen FROM orders UNION ALL SELECT -o_orderkey, 'new', 0 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey > 0")
def upsert_state(t: Tables) -> DataFrame:
    state = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("first_seen"))
    third = state.filter("id % 3 = 0")
    delta = third.select("id", F.lit("new").alias("status"), F.lit(0).cast("long").alias("first_seen")).union(third.filter("id > 0").select(-F.col("id"), F.lit("new"), F.lit(0).cast("long")))
    return ST.upsert(state, delta, "id", ["first_seen"])


@query("WITH s AS (SELECT o_custkey AS url, min(o_orderkey) AS ord FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey) SELECT url, ord FROM s UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT url FROM s) GROUP BY o_custkey")
def insert_ignore(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("url"), F.col("o_orderkey").alias("ord"))
    state = rows.filter("ord % 2 = 0").groupBy("url").agg(F.min("ord").alias("ord"))
    return ST.insert_or_ignore(state, rows.filter("ord % 2 = 1").withColumn("o", F.col("ord")), ["url"], "o")


@query("SELECT o_custkey AS key, arg_max(o_orderkey, o_orderkey) AS id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def merge_objects(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return ST.latest(rows, "key", "id")


@query("WITH e AS (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, CASE WHEN r = 1 THEN 'new' WHEN p = event_type THEN 'unchanged' ELSE 'changed' END AS outcome FROM e")
def change_detection(t: Tables) -> DataFrame:
    return ST.changes(t.events.select("event_id", "user_id", "event_type", "ts"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "outcome")


@query("""WITH RECURSIVE a AS (SELECT user_id, event_id, (event_id % 4)::INT AS expected, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT user_id, event_id, r, expected = 0 AS accepted, (expected = 0)::INT AS revision FROM a WHERE r = 1 UNION ALL SELECT a.user_id, a.event_id, a.r, a.expected = f.revision, f.revision + (a.expected = f.revision)::INT FROM f JOIN a ON a.user_id = f.user_id AND a.r = f.r + 1)
SELECT user_id, event_id, accepted, revision FROM f""")
def revision_conflicts(t: Tables) -> DataFrame:
    return ST.revisions(t.events.select("user_id", "event_id", (F.col("event_id") % 4).cast("int").alias("expected")), "user_id", "expected", "event_id")


@query("SELECT o_orderkey, sha256(o_orderkey || ':' || o_totalprice::INT) = sha256(o_orderkey || ':' || (o_totalprice::INT + (o_orderkey % 7 = 0)::INT)) AS intact, o_orderkey % 7 <> 0 AS same FROM orders")
def session_save_conflicts(t: Tables) -> DataFrame:
    price = F.round("o_totalprice").cast("int")
    sign = lambda p: F.sha2(F.concat_ws(":", "o_orderkey", p), 256)
    return t.orders.select("o_orderkey", (sign(price) == sign(price + (F.col("o_orderkey") % 7 == 0).cast("int"))).alias("intact"), (F.col("o_orderkey") % 7 != 0).alias("same"))


@query("SELECT o_custkey AS run, o_orderkey AS url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderpriority, o_orderkey)::INT AS r FROM orders QUALIFY r <= 3")
def frontier_claim(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderpriority", "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).filter("r <= 3").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("url"), "r")


@query("SELECT o_orderkey, o_orderdate + INTERVAL 6 HOUR AS next_run FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-01'")
def due_jobs(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderdate") <= F.lit("1995-06-01").cast("timestamp_ntz")).select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 6 HOURS")).alias("next_run"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def latest_success(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("WITH j AS (SELECT c_custkey AS job, unnest([c_custkey % 50, c_custkey % 7]) AS dep FROM customer), done AS (SELECT DISTINCT o_custkey AS job FROM orders WHERE o_orderstatus = 'F') SELECT c_custkey AS job FROM customer WHERE c_custkey NOT IN (SELECT job FROM j WHERE dep NOT IN (SELECT job FROM done))")
def job_dependencies(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    deps = t.customer.select(k.alias("job"), F.explode(F.array(k % 50, k % 7)).alias("dep"))
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("dep")).distinct()
    waiting = deps.join(done, "dep", "left_anti").select("job").distinct()
    return t.customer.select(k.alias("job")).join(waiting, "job", "left_anti")


@query("SELECT event_type, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 5")
def recent_listing(t: Tables) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("event_type", "event_id", "user_id")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def ordered_distinct(t: Tables) -> DataFrame:
    first = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ",")  # a kind once a user
    return first.groupBy("user_id").agg(kinds.alias("kinds"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def final_order(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('s|' || doc_id)) <= 10")
def sample_by_type(t: Tables) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(F.sha2(F.concat_ws("|", F.lit("s"), "doc_id"), 256))
    return t.documents.select("lang", "doc_id").withColumn("r", F.row_number().over(w)).filter("r <= 10").drop("r")


@query("SELECT event_type AS status, count(*) AS n, count(*) FILTER (value > 50) AS high FROM events GROUP BY ALL")
def status_counts(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"))


@query("SELECT CASE WHEN value < 10 THEN 'rejected' WHEN value < 60 THEN 'kept' ELSE 'new' END AS outcome, count(*) AS n FROM events GROUP BY ALL")
def outcome_counts(t: Tables) -> DataFrame:
    return t.events.groupBy(F.when(F.col("value") < 10, "rejected").when(F.col("value") < 60, "kept").otherwise("new").alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, bool_or(n_chars > 5000) AS any_long, arg_max(n_chars, doc_id) AS last_size FROM documents GROUP BY source")
def merge_metadata(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.bool_or(F.col("n_chars") > 5000).alias("any_long"), F.max_by("n_chars", "doc_id").alias("last_size"))


@query("SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, len(string_split(text, chr(10))) AS lines FROM documents")
def record_sizes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.char_length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS p50, list_sort(list(value))[(0.95 * count(*))::INT + CASE WHEN (0.95 * count(*))::INT > 0.95 * count(*) THEN 0 ELSE 1 END] AS p95 FROM events GROUP BY event_type")
def latency_percentiles(t: Tables) -> DataFrame:
    n = F.col("n")
    at = {"low": F.floor((n - 1) / 2), "high": F.ceil((n - 1) / 2), "p95": F.floor(0.95 * n)}
    found = ranges.values_at(t.events, "event_type", "value", at)
    return found.select("event_type", "n", F.round((F.col("low") + F.col("high")) / 2, 6).alias("p50"), "p95")


@query("SELECT event_type, user_id % 5 AS prompt, count(*) AS n, round(avg((value > 20)::INT), 6) AS pass_rate, bool_or(value < 1) AS degraded FROM events GROUP BY ALL")
def pass_rates(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", (F.col("user_id") % 5).alias("prompt")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 20).cast("int")), 6).alias("pass_rate"), F.bool_or(F.col("value") < 1).alias("degraded"))


def _roll(ns: F.Column) -> F.Column:
    return H.die(F.lit(17), ns, F.lit(0), F.lit(20))


_DIE = "(('0x' || substr(sha256('17:{}' || {} || ':0'), 1, 16))::UHUGEINT % 20)::BIGINT + 1"


@query(f"WITH c AS (SELECT c_nationkey AS fight, c_custkey AS id, {_DIE.format('i', 'c_custkey')} AS roll FROM customer) SELECT fight, id, roll, row_number() OVER (PARTITION BY fight ORDER BY roll + id % 4 DESC, roll DESC, id)::INT AS turn FROM c")
def initiative_order(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_nationkey").alias("fight"), F.col("c_custkey").alias("id"), _roll(F.concat(F.lit("i"), "c_custkey")).alias("roll"))
    w = Window.partitionBy("fight").orderBy((F.col("roll") + F.col("id") % 4).desc(), F.desc("roll"), "id")
    return c.withColumn("turn", F.row_number().over(w))


@query(f"WITH a AS (SELECT o_orderkey, {_DIE.format('a', 'o_orderkey')} AS roll, 8 + o_custkey % 10 AS ac, 5 + o_orderkey % 9 AS hp FROM orders), h AS (SELECT *, roll = 20 OR (roll <> 1 AND roll + 3 >= ac) AS hit FROM a) SELECT o_orderkey, roll, hit, CASE WHEN hit THEN greatest(0, hp - CASE WHEN roll = 20 THEN 8 ELSE 4 END) ELSE hp END AS hp_left FROM h")
def attack_resolution(t: Tables) -> DataFrame:
    a = t.orders.select("o_orderkey", _roll(F.concat(F.lit("a"), "o_orderkey")).alias("roll"), (8 + F.col("o_custkey") % 10).alias("ac"), (5 + F.col("o_orderkey") % 9).alias("hp"))
    hit = (F.col("roll") == 20) | ((F.col("roll") != 1) & (F.col("roll") + 3 >= F.col("ac")))
    left = F.when(hit, F.greatest(F.lit(0).cast("long"), F.col("hp") - F.when(F.col("roll") == 20, 8).otherwise(4))).otherwise(F.col("hp"))
    return a.select("o_orderkey", "roll", hit.alias("hit"), left.alias("hp_left"))


@query("SELECT event_id, event_id % 5 AS slot, (event_id % 5 + 1) % 5 AS next_slot, event_id // 5 + ((event_id % 5) = 4)::INT + 1 AS next_round, abs(event_id % 7 - event_id % 4) AS distance, abs(event_id % 7 - event_id % 4) <= 3 AS reachable FROM events")
def turn_cycle(t: Tables) -> DataFrame:
    e = F.col("event_id")
    distance = F.abs(e % 7 - e % 4)
    return t.events.select("event_id", (e % 5).alias("slot"), ((e % 5 + 1) % 5).alias("next_slot"), (F.floor(e / 5) + (e % 5 == 4).cast("int") + 1).cast("long").alias("next_round"), distance.alias("distance"), (distance <= 3).alias("reachable"))


@query("SELECT p_partkey, array_to_string(list_concat(list_filter(cur, lambda c: c <> gone), list_filter(['prone', 'stunned'], lambda c: NOT list_contains(list_filter(cur, lambda x: x <> gone), c))), ',') AS conditions FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN ['prone', 'charmed'] WHEN 1 THEN ['charmed'] ELSE ['deaf', 'stunned'] END AS cur, CASE p_size % 2 WHEN 0 THEN 'prone' ELSE 'charmed' END AS gone FROM part)")
def condition_merge(t: Tables) -> DataFrame:
    s = F.col("p_size")
    arr = lambda *xs: F.array(*map(F.lit, xs))
    cur = F.when(s % 3 == 0, arr("prone", "charmed")).when(s % 3 == 1, arr("charmed")).otherwise(arr("deaf", "stunned"))
    gone = F.when(s % 2 == 0, "prone").otherwise("charmed")
    return t.part.select("p_partkey", F.array_join(F.array_union(F.filter(cur, lambda c: c != gone), arr("prone", "stunned")), ",").alias("conditions"))


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'hidden' ELSE text END AS text, conv_id % 3 AS owner FROM conversations WHERE role <> 'assistant' OR conv_id % 3 = 1")
def visible_memory(t: Tables) -> DataFrame:
    owner = F.col("conv_id") % 3
    shown = F.when(F.col("role") == "system", "hidden").otherwise(F.col("text"))
    return t.conversations.filter((F.col("role") != "assistant") | (owner == 1)).select("conv_id", "turn", shown.alias("text"), owner.alias("owner"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS dm_notes, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 5 = 0 THEN c_acctbal END AS private, c_mktsegment AS public FROM customer")
def masked_view(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", F.when(k % 2 == 0, F.col("c_name")).alias("dm_notes"), F.when((k % 2 == 0) | (k % 5 == 0), F.col("c_acctbal")).alias("private"), F.col("c_mktsegment").alias("public"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS seq FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8")
def recent_actions(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn")
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    seq = F.count("*").over(Window.partitionBy("conv_id")) - F.row_number().over(back) + 1
    return c.withColumn("seq", seq.cast("int")).withColumn("b", F.row_number().over(back)).filter("b <= 8").drop("b")


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'bought for ' || round(value)::INT WHEN 'click' THEN 'clicked' ELSE event_type || ' by ' || user_id END AS summary FROM events")
def action_summaries(t: Tables) -> DataFrame:
    s = F.when(F.col("event_type") == "purchase", F.concat(F.lit("bought for "), F.round("value").cast("int"))).when(F.col("event_type") == "click", F.lit("clicked")).otherwise(F.concat_ws(" by ", "event_type", "user_id"))
    return t.events.select("event_id", s.alias("summary"))


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id HAVING count(*) > 2")
def session_listing(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn")).filter("turns > 2")


@query("WITH q AS (SELECT n_nationkey, lower(n_name) AS n FROM nation), c AS (SELECT c_custkey, CASE c_custkey % 13 WHEN 1 THEN 'nation_' || (c_custkey % 30) WHEN 2 THEN 'the nation_' || (c_custkey % 11) ELSE lower(regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g')) END AS m FROM customer) SELECT n_nationkey, c_custkey FROM q, c WHERE n = m OR contains(n, substr(m, 1, 2)) OR contains(m, n) QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY (n = m) DESC, c_custkey) = 1")
def name_resolution(t: Tables) -> DataFrame:
    """The customer that a nation's name names best: an exact name before a part of one, then the smallest key. Some names are planted, so that there are hits."""
    q = F.broadcast(t.nation.select("n_nationkey", F.lower("n_name").alias("n")))  # 25 rows by definition
    k = F.col("c_custkey")
    planted = F.when(k % 13 == 1, F.concat(F.lit("nation_"), k % 30)).when(k % 13 == 2, F.concat(F.lit("the nation_"), k % 11))
    c = t.customer.select("c_custkey", F.coalesce(planted, F.lower(F.regexp_replace("c_mktsegment", "[^A-Za-z]", ""))).alias("m"))
    hit = c.join(q, (F.col("n") == F.col("m")) | F.contains("n", F.substring("m", 1, 2)) | F.contains("m", "n"))
    return hit.groupBy("n_nationkey").agg(F.min_by("c_custkey", F.struct(F.col("n") != F.col("m"), "c_custkey")).alias("c_custkey"))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def scene_chain(t: Tables) -> DataFrame:
    small = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(small), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_orderkey) = 1 OR c_custkey % 10 = 0")
def actor_control(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("k", F.lit(0)).cast("long").alias("n")).filter("n = 1 or c_custkey % 10 = 0")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus AS known FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderkey % 2 = 0")
def state_lookup(t: Tables) -> DataFrame:
    known = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("known"))
    return t.lineitem.select("l_orderkey", "l_linenumber").join(known, "l_orderkey", "left")


@query("SELECT vec_id, label, doc_id IS NOT NULL AS found FROM embeddings LEFT JOIN (SELECT DISTINCT doc_id FROM documents) ON vec_id = doc_id")
def id_join(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("f")).distinct()
    return t.embeddings.select("vec_id", "label").join(d, "vec_id", "left").select("vec_id", "label", F.coalesce("f", F.lit(False)).alias("found"))


@query("SELECT o_orderkey, 'npc-' || lpad(o_orderkey::VARCHAR, 6, '0') AS id, ['elf', 'dwarf', 'human'][(('0x' || substr(sha256('r' || o_orderkey), 1, 2))::INT % 3) + 1] AS race, ['guard', 'smith', 'bard', 'cook'][(('0x' || substr(sha256('j' || o_orderkey), 1, 2))::INT % 4) + 1] AS job FROM orders")
def npc_rows(t: Tables) -> DataFrame:
    pick = lambda k, *xs: H.stable_choice(F.array(*map(F.lit, xs)), F.concat(F.lit(k), "o_orderkey"))
    return t.orders.select("o_orderkey", F.concat(F.lit("npc-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")).alias("id"), pick("r", "elf", "dwarf", "human").alias("race"), pick("j", "guard", "smith", "bard", "cook").alias("job"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.k'), 'none') AS best FROM events")
def event_props_json(t: Tables) -> DataFrame:
    get = lambda p: F.get_json_object("props", p)
    return t.events.select("event_id", get("$.k").alias("k"), F.coalesce(get("$.page"), get("$.k"), F.lit("none")).alias("best"))


@query("SELECT event_id, NOT (event_id % 4 = 0) AS ok, CASE WHEN event_id % 4 <> 0 THEN event_id % 6 END AS dc, CASE WHEN event_id % 4 = 0 THEN 'safe text' ELSE 'dc ' || event_id % 6 END AS answer FROM events")
def mechanics_json(t: Tables) -> DataFrame:
    body = F.concat(F.lit('```json\n{"dc": '), F.col("event_id") % 6, F.when(F.col("event_id") % 4 == 0, F.lit(",, ")).otherwise(F.lit(', "tags": ["a"]}\n```')))
    clean = F.regexp_replace(body, r"\A```(?:json)?\s*|\s*```\z", "")
    m = F.from_json(clean, "dc long, tags array<string>")
    rows = t.events.select("event_id", F.when(F.size(m["tags"]) > 0, m).alias("m"))
    return rows.select("event_id", F.col("m").isNotNull().alias("ok"), F.col("m.dc").alias("dc"), F.coalesce(F.concat(F.lit("dc "), F.col("m.dc")), F.lit("safe text")).alias("answer"))


@query("SELECT p_partkey, '# ' || p_name || chr(10) || 'Type: ' || p_type || chr(10) || 'Size ' || p_size AS note FROM part")
def rendered_notes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.format_string("# %s\nType: %s\nSize %d", "p_name", "p_type", "p_size").alias("note"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, grouping(l_linestatus)::INT AS rolled FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def revenue_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.grouping("l_linestatus").cast("int").alias("rolled"))
