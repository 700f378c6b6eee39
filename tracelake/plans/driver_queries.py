"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import diff, grammar, ids, paths, text, times
from tracelake.operators import agents, aggregate, graph, joins, live, search, verbatim

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = f.__code__.co_varnames[: f.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lines(conversations: DataFrame) -> DataFrame:
    """Conversations as transcript lines."""
    return conversations.select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("line_no"), "role", "text")


def turned(conversations: DataFrame) -> DataFrame:
    return search.with_turns(lines(conversations), F.col("role") == "user")


TURNS = """WITH l AS (SELECT conv_id AS session_id, turn + 1 AS line_no, role, text FROM conversations),
t AS (SELECT *, CAST(greatest(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no) - 1, 0) AS BIGINT) AS turn_index FROM l)
"""
X = TURNS + """, x AS (SELECT session_id, turn_index, count(*) AS n_rows, CAST(sum(CASE WHEN coalesce(regexp_matches(text, '{p}', 'i'), false) THEN 1 ELSE 0 END) AS BIGINT) AS n_hits,
 min(line_no) AS first_line, max(line_no) AS last_line, min(CASE WHEN regexp_matches(text, '{p}', 'i') THEN line_no END) AS first_hit FROM t GROUP BY 1, 2)
"""


@query(X.format(p="tion") + "SELECT * FROM x WHERE n_hits > 0")
def search_exchanges(conversations):
    return search.exchanges(turned(conversations), search.matches(F.col("text"), "tion"))


@query("SELECT doc_id, regexp_matches(text, 'The', '') AS upper, regexp_matches(text, 'the', 'i') AS lower FROM documents WHERE regexp_matches(text, 'the', 'i')")
def search_smart_case(documents):
    low, up = search.matches(F.col("text"), "the"), search.matches(F.col("text"), "The")
    return documents.filter(low).select("doc_id", up.alias("upper"), low.alias("lower"))


@query("""SELECT session_id, line_no, row_number() OVER (ORDER BY session_id, line_no) AS rank FROM (SELECT conv_id AS session_id, turn + 1 AS line_no, text FROM conversations)
WHERE regexp_matches(text, 'ing', 'i') ORDER BY 1, 2 LIMIT 25""")
def search_signed_cap_first(conversations):
    return search.ranked(lines(conversations).filter(search.matches(F.col("text"), "ing")).select("session_id", "line_no"), 25, ["session_id", "line_no"])


@query("""SELECT session_id, line_no, row_number() OVER (ORDER BY session_id, line_no) AS rank FROM (SELECT session_id, line_no FROM (SELECT conv_id AS session_id, turn + 1 AS line_no, text
FROM conversations) WHERE regexp_matches(text, 'ing', 'i') ORDER BY 1 DESC, 2 DESC LIMIT 25)""")
def search_signed_cap_last(conversations):
    return search.ranked(lines(conversations).filter(search.matches(F.col("text"), "ing")).select("session_id", "line_no"), -25, ["session_id", "line_no"])


@query(TURNS + """, m AS (SELECT *, coalesce(regexp_matches(text, 'tion', 'i'), false) AS hit FROM t), a AS (SELECT *, bool_or(hit) OVER (PARTITION BY session_id, turn_index) AS some_hit FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_index, role ORDER BY line_no) AS rank FROM a WHERE some_hit AND NOT hit)
SELECT session_id, line_no, role, turn_index FROM r WHERE rank <= CASE role WHEN 'assistant' THEN 1 WHEN 'system' THEN 2 ELSE 2147483647 END""")
def search_siblings(conversations):
    return search.siblings(turned(conversations), search.matches(F.col("text"), "tion"), {"assistant": 1, "system": 2}).select("session_id", "line_no", "role", "turn_index")


@query("SELECT doc_id, substr(text, greatest(1, strpos(text, 'tion') - 48), 100) AS excerpt FROM documents WHERE strpos(text, 'tion') > 0")
def excerpt_centered(documents):
    return documents.select("doc_id", text.match_excerpt(F.col("text"), "tion", 100).alias("excerpt")).filter("excerpt IS NOT NULL")


@query(X.format(p="and") + "SELECT count(*) AS exchanges, CAST(coalesce(sum(n_hits), 0) AS BIGINT) AS hits FROM x WHERE n_hits > 0")
def count_only(conversations):
    return search.exchanges(turned(conversations), search.matches(F.col("text"), "and")).agg(F.count(F.lit(1)).alias("exchanges"), F.coalesce(F.sum("n_hits"), F.lit(0)).alias("hits"))


@query("SELECT DISTINCT conv_id AS session_id FROM conversations WHERE regexp_matches(text, 'hain', 'i')")
def sessions_with_matches(conversations):
    return lines(conversations).filter(search.matches(F.col("text"), "hain")).select("session_id").distinct()


@query("SELECT role AS key, count(*) AS n FROM conversations WHERE role IS NOT NULL GROUP BY 1")
def census_role(conversations):
    return aggregate.census(conversations, F.col("role"))


@query("SELECT CAST(conv_id AS VARCHAR) AS key, count(*) AS n FROM conversations GROUP BY 1")
def census_session(conversations):
    return aggregate.census(conversations, F.col("conv_id").cast("string"))


@query(TURNS + "SELECT turn_index AS key, count(*) AS n FROM t GROUP BY 1")
def census_turn(conversations):
    return aggregate.census(turned(conversations), F.col("turn_index"))


@query("""WITH k AS (SELECT d.doc_id, unnest(list_distinct([d.lang, d.source, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE d.lang END])) AS key FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT key, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY 1""")
def census_label_multi(documents, labels):
    both = documents.select("doc_id", "lang", "source").join(labels.select("doc_id", "toxic"), "doc_id", "left")
    return aggregate.census_multi(both, F.array("lang", "source", F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("lang"))))


@query("SELECT count(CASE WHEN event_type <> 'error' THEN event_type END) AS counted, count(CASE WHEN event_type = 'error' THEN 1 END) AS excluded FROM events")
def census_tool_excluded(events):
    return aggregate.excluded(events, F.when(F.col("event_type") != "error", F.col("event_type")))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'harness.system.error' ELSE 'user.' || event_type END AS label FROM events WHERE event_type NOT IN ('error', 'click')")
def label_include_exclude(events):
    label = F.when(F.col("event_type") == "error", "harness.system.error").otherwise(F.concat(F.lit("user."), F.col("event_type")))
    out = events.select("event_id", label.alias("label"))
    return out.filter(grammar.selected(F.col("label"), F.lit(True), ["user.*"], ["user.click"]))


@query("SELECT event_id FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND ts <= (SELECT min(ts) FROM events) + INTERVAL 3 DAY")
def time_window_closed(events):
    low = events.agg(F.min("ts").alias("low"))
    return events.join(F.broadcast(low), (F.col("ts") >= F.col("low") + F.expr("INTERVAL 1 DAY")) & (F.col("ts") <= F.col("low") + F.expr("INTERVAL 3 DAY"))).select("event_id")


@query("SELECT count(*) AS n_all, count(CASE WHEN ts IS NOT NULL AND ts >= TIMESTAMP '1900-01-01' THEN 1 END) AS n_bounded FROM (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS ts FROM events)")
def time_window_null_ts(events):
    from datetime import datetime

    ts = F.when(F.col("event_id") % 3 != 0, F.col("ts"))
    inside = grammar.window(F.col("t"), datetime(1900, 1, 1), None)
    return events.select(ts.alias("t")).agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(inside, 1)).alias("n_bounded"))


@query("""SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1
HAVING min(ts) <= (SELECT min(ts) FROM events) + INTERVAL 12 HOUR AND max(ts) >= (SELECT min(ts) FROM events) + INTERVAL 6 HOUR""")
def span_intersects(events):
    low = events.agg(F.min("ts").alias("low"))
    spans = events.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    overlap = grammar.intersects(F.col("first_ts"), F.col("last_ts"), F.col("low") + F.expr("INTERVAL 6 HOUR"), F.col("low") + F.expr("INTERVAL 12 HOUR"))
    return spans.join(F.broadcast(low), overlap).drop("low")


@query(TURNS + ", s AS (SELECT *, max(turn_index) OVER (PARTITION BY session_id) + 1 AS turns FROM t) SELECT session_id, line_no, turn_index FROM s WHERE turn_index >= turns - 2 AND turn_index <= turns - 1")
def turn_range_from_end(conversations):
    return search.turn_range(turned(conversations), grammar.parse_range("-2..-1")).select("session_id", "line_no", "turn_index")


@query(TURNS + "SELECT session_id, turn_index, count(*) AS n_rows, min(line_no) AS first_line, max(line_no) AS last_line FROM t GROUP BY 1, 2")
def turn_groups(conversations):
    return turned(conversations).groupBy("session_id", "turn_index").agg(F.count(F.lit(1)).alias("n_rows"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query("""SELECT conv_id AS session_id, arg_min(text, turn) FILTER (role = 'user') AS first_user, arg_max(text, turn) FILTER (role = 'user') AS last_user,
 arg_max(text, turn) FILTER (role = 'assistant') AS last_assistant, count(*) AS n_rows FROM conversations GROUP BY 1""")
def session_summary_list(conversations):
    of = lambda role: F.when(F.col("role") == role, F.col("turn"))
    return conversations.groupBy(F.col("conv_id").alias("session_id")).agg(F.min_by("text", of("user")).alias("first_user"), F.max_by("text", of("user")).alias("last_user"), F.max_by("text", of("assistant")).alias("last_assistant"), F.count(F.lit(1)).alias("n_rows"))


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def stats_session(events):
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""SELECT coalesce(l_returnflag, 'TOTAL') AS l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def stats_total_rollup(lineitem):
    return aggregate.with_total(lineitem, "l_returnflag", [F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")])


@query("""SELECT l_orderkey, CAST(sum(q) AS BIGINT) AS q, count(*) AS messages FROM (SELECT l_orderkey, l_partkey, max(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def usage_dedupe_max(lineitem):
    return aggregate.deduped_usage(lineitem.withColumn("q", F.col("l_quantity").cast("long")), ["l_orderkey"], "l_partkey", ["q"])


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def type_census(events):
    return aggregate.census(events, F.col("event_type"))


@query("""SELECT coalesce(u.k, r.k) AS k, CASE WHEN u.k IS NULL THEN 'orphan' WHEN r.k IS NULL THEN 'pending' ELSE 'paired' END AS state
FROM (SELECT DISTINCT o_orderkey AS k FROM orders) u FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem) r ON u.k = r.k""")
def pairing_outer(orders, lineitem):
    return joins.pairing(orders.select(F.col("o_orderkey").alias("k")), lineitem.select(F.col("l_partkey").alias("k")), "k")


@query("SELECT o_orderkey AS k, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def pending_anti(orders, lineitem):
    return joins.pending(orders.select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderdate"), lineitem.select(F.col("l_orderkey").alias("k")), "k", "o_orderdate").select("k", "o_custkey")


@query("""SELECT a.event_id, (SELECT arg_max(b.event_id, b.ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'click' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 1 HOUR) AS event_id_asof
FROM events a WHERE a.event_type = 'purchase'""")
def asof_nearest(events):
    buys = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return joins.asof(buys, clicks, "user_id", "ts", "ts", "click", "INTERVAL 1 HOUR").select("event_id", F.col("click_asof").alias("event_id_asof"))


@query("""WITH v AS (SELECT user_id, epoch_us(ts) // 60000000 AS m, min(event_id) AS v, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2),
p AS (SELECT a.event_id, epoch_us(a.ts) // 60000000 AS m, v.m AS t, v.v, v.n, abs(v.m - epoch_us(a.ts) // 60000000) AS gap FROM events a JOIN v USING (user_id) WHERE a.event_type = 'signup'),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, t) AS k, count(*) OVER (PARTITION BY event_id, gap) AS as_near FROM p)
SELECT a.event_id, r.v AS view_near, r.gap, coalesce(r.as_near > 1 OR r.n > 1, false) AS tied FROM events a LEFT JOIN r ON r.event_id = a.event_id AND r.k = 1 WHERE a.event_type = 'signup'""")
def nearest_with_ties(events):
    minute = F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    ups = events.filter("event_type = 'signup'").select("event_id", "user_id", minute.alias("m"))
    views = events.filter("event_type = 'view'").select("user_id", minute.alias("t"), F.col("event_id").alias("view"))
    return joins.nearest(ups, views, "user_id", "m", "t", "view").select("event_id", "view_near", "gap", "tied")


@query("""WITH w AS (SELECT *, max(CASE WHEN event_type = 'view' THEN ts END) OVER v AS m, max(CASE WHEN event_type = 'click' THEN ts END) OVER v AS e FROM events
WINDOW v AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id FROM w WHERE event_type = 'view' AND m IS NOT NULL AND (e IS NULL OR e < m)""")
def range_no_event_between(events):
    return joins.no_event_between(events, "user_id", "ts", "event_type", "view", "click").select("event_id", "user_id")


@query("""WITH g AS (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders)
SELECT o_custkey, count(*) AS children, max(gap) AS widest FROM g GROUP BY 1 HAVING count(*) > 1""")
def branch_points(orders):
    return joins.branch_points(orders, "o_custkey", "o_orderkey")


EDGES = """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
 UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),"""


def edges_of(nation: DataFrame, customer: DataFrame, orders: DataFrame) -> DataFrame:
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        nation.select(tag("n", "n_nationkey").alias("child"), tag("r", "n_regionkey").alias("parent"))
        .unionByName(customer.select(tag("c", "c_custkey").alias("child"), tag("n", "c_nationkey").alias("parent")))
        .unionByName(orders.select(tag("o", "o_orderkey").alias("child"), tag("c", "o_custkey").alias("parent")))
    )


@query(EDGES + " w AS (SELECT child AS node, 1 AS depth FROM e WHERE parent = 'r2' UNION ALL SELECT e.child, w.depth + 1 FROM e JOIN w ON e.parent = w.node) SELECT node, depth FROM w")
def reverse_closure(nation, customer, orders):
    return graph.closure(edges_of(nation, customer, orders), ["r2"])


@query(EDGES + " w AS (SELECT parent AS node, 1 AS step FROM e WHERE child = 'o1' UNION ALL SELECT e.parent, w.step + 1 FROM e JOIN w ON e.child = w.node) SELECT node, step FROM w")
def chain_walk(nation, customer, orders):
    return graph.walk_up(edges_of(nation, customer, orders), "o1")


@query(EDGES + " w AS (SELECT DISTINCT parent AS node, 0 AS depth FROM e WHERE parent NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, w.depth + 1 FROM e JOIN w ON e.parent = w.node) SELECT depth, count(*) AS n FROM w GROUP BY 1")
def topology_depth(nation, customer, orders):
    return graph.depths(edges_of(nation, customer, orders)).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT o_orderkey AS root FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def abandoned_roots(orders, lineitem):
    return joins.unanswered(orders.select(F.col("o_orderkey").alias("root")), lineitem.filter("l_linenumber = 2").select(F.col("l_orderkey").alias("root")), "root")


@query("SELECT array_to_string(list_slice(string_split(regexp_replace(url, '[?#].*$', ''), '/'), 1, 4), '/') AS bucket, count(*) AS n, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def files_rollup_bucket(pages):
    path = F.regexp_replace("url", "[?#].*$", "")
    bucket = F.array_join(F.slice(F.split(path, "/", -1), 1, 4), "/")
    return pages.select(bucket.alias("bucket"), "url").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("urls"))


@query("SELECT source, count(*) AS n, count(CASE WHEN n_chars > 1000 THEN 1 END) AS long_ones, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def files_rollup_dir(documents):
    return documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n_chars") > 1000, 1)).alias("long_ones"), F.sum("n_chars").alias("chars"))


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dedup_identical(documents):
    return joins.identical(documents, "doc_id", F.col("text"))


@query("""WITH c AS (SELECT doc_id % 1000 AS g, doc_id AS i, text AS c FROM documents UNION ALL SELECT doc_id % 1000, -doc_id - 1, substr(text, 1, 200) FROM documents),
l AS (SELECT g, arg_max(c, (length(c), i)) AS l, count(*) AS copies FROM c GROUP BY 1)
SELECT g, any_value(copies) AS copies, ['identical', 'prefix', 'divergent'][max(CASE WHEN c = l THEN 1 WHEN starts_with(l, c) THEN 2 ELSE 3 END)] AS relation FROM c JOIN l USING (g) GROUP BY 1""")
def dedup_prefix_copies(documents):
    a = documents.select((F.col("doc_id") % 1000).alias("g"), F.col("doc_id").alias("i"), F.col("text").alias("c"))
    b = documents.select((F.col("doc_id") % 1000).alias("g"), (-F.col("doc_id") - 1).alias("i"), F.substring("text", 1, 200).alias("c"))
    return joins.prefix_copies(a.unionByName(b), "g", "i", F.col("c"))


@query("""WITH r AS (SELECT conv_id AS s, turn // 6 AS g, turn * 2 AS l, substr(text, 1, 90) AS x FROM conversations UNION ALL SELECT conv_id, turn // 6, turn * 2 + 1, text FROM conversations)
SELECT a.s, a.l, max(b.l) AS superseded_by FROM r a JOIN r b ON a.s = b.s AND a.g = b.g AND b.l > a.l AND length(a.x) >= 80 AND starts_with(lower(b.x), lower(a.x)) GROUP BY 1, 2""")
def resend_prefix(conversations):
    key = [F.col("conv_id").alias("s"), F.expr("turn div 6").alias("g")]
    a = conversations.select(*key, (F.col("turn") * 2).alias("l"), F.substring("text", 1, 90).alias("x"))
    b = conversations.select(*key, (F.col("turn") * 2 + 1).alias("l"), F.col("text").alias("x"))
    return verbatim.superseded(a.unionByName(b), ["s", "g"], "l", F.col("x")).filter("superseded_by IS NOT NULL").select("s", "l", "superseded_by")


@query(r"SELECT doc_id, substr(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 80) AS fp FROM documents")
def fingerprint80(documents):
    return documents.select("doc_id", text.fingerprint(F.col("text")).alias("fp"))


@query(r"""SELECT doc_id, regexp_matches(text, '\b[0-9]*[a-f][0-9a-f]{6,39}\b') AS has_hash, regexp_matches(text, '[A-Za-z0-9_/-]+\.[a-z]{1,4}:[0-9]+') AS has_file_line,
 regexp_matches(text, '`[^`]+`') AS has_code, regexp_matches(text, '\b[0-9]+ (tests|files|lines|errors|failures|rows)\b') AS has_number FROM documents""")
def richness_flags(documents):
    return documents.select("doc_id", *[c.alias(k) for k, c in text.richness(F.col("text")).items()])


@query("""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE substr(text, 1, 72) || ' … (+' || (length(text) - 120) || ' chars) … ' || substr(text, length(text) - 47, 48) END AS body FROM documents""")
def middle_truncate(documents):
    return documents.select("doc_id", text.middle_truncate(F.col("text"), 120, 0.6).alias("body"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE substr(text, 1, 50) || '… (+' || (length(text) - 50) || CASE WHEN length(text) = 51 THEN ' char)' ELSE ' chars)' END END AS body FROM documents""")
def elide_marker(documents):
    return documents.select("doc_id", text.elide(F.col("text"), 50).alias("body"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM documents")
def normalize_ws(documents):
    return documents.select("doc_id", text.normalize_ws(F.col("text")).alias("line"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' WHEN s < 86400 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm'
 ELSE (s // 86400) || 'd ' || (s // 3600 % 24) || 'h' END AS d FROM (SELECT event_id, event_id * 37 AS s FROM events)""")
def fmt_duration(events):
    return events.select("event_id", text.duration(F.col("event_id") * 37).alias("d"))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (n * 10 // 1024 // 10) || '.' || (n * 10 // 1024 % 10) || ' KB' ELSE (n * 10 // 1048576 // 10) || '.' || (n * 10 // 1048576 % 10) || ' MB' END AS size
FROM (SELECT doc_id, n_chars * 97 AS n FROM documents)""")
def human_bytes(documents):
    return documents.select("doc_id", text.human_bytes(F.col("n_chars") * 97).alias("size"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')), '') AS h1 FROM pages")
def xml_tag_extract(pages):
    return pages.select("page_id", text.xml_tag(F.col("html"), "h1").alias("h1"))


@query("""WITH i AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1, 's'), lambda x: trim(x)), lambda x: x <> '') AS l FROM pages)
SELECT page_id, CAST(len(l) AS INTEGER) AS n, coalesce(array_to_string(l, '|'), '') AS items FROM i""")
def xml_all_tags(pages):
    got = text.xml_tags(F.col("html"), "li")
    return pages.select("page_id", F.size(got).alias("n"), F.array_join(got, "|").alias("items"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract_string(props, '$.none') AS BIGINT) AS none FROM events")
def json_props(events):
    return events.select("event_id", text.json_long(F.col("props"), "k").alias("k"), text.json_long(F.col("props"), "none").alias("none"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS v FROM lineitem WHERE l_linenumber <> 3), g AS (SELECT *, v - row_number() OVER (PARTITION BY l_orderkey ORDER BY v) AS i FROM d),
r AS (SELECT l_orderkey, min(v) AS a, max(v) AS b FROM g GROUP BY l_orderkey, i)
SELECT l_orderkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1""")
def gaps_islands_ranges(lineitem):
    got = lineitem.filter("l_linenumber <> 3").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("v"))
    return got.select("l_orderkey", text.ranges(F.col("v")).alias("ranges"))


@query("""SELECT session_id, line_no, CAST(spent AS BIGINT) AS spent FROM (SELECT conv_id AS session_id, turn + 1 AS line_no, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spent FROM conversations) WHERE spent <= 1500""")
def budget_prefix(conversations):
    return aggregate.within_budget(lines(conversations), "session_id", [F.desc("line_no")], F.length("text"), 1500).select("session_id", "line_no", "spent")


@query("""WITH RECURSIVE o AS (SELECT conv_id AS s, turn AS i, length(text) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations),
g AS (SELECT s, k, i, CASE WHEN c <= 1200 THEN c ELSE 0 END AS spent, c <= 1200 AS taken FROM o WHERE k = 1
 UNION ALL SELECT o.s, o.k, o.i, CASE WHEN g.spent + o.c <= 1200 THEN g.spent + o.c ELSE g.spent END, g.spent + o.c <= 1200 FROM g JOIN o ON o.s = g.s AND o.k = g.k + 1)
SELECT s AS session_id, i AS turn FROM g WHERE taken""")
def budget_greedy(conversations):
    rows = conversations.select(F.col("conv_id").alias("session_id"), "turn", F.length("text").alias("c"))
    return aggregate.greedy_budget(rows, "session_id", "turn", "c", 1200, -F.col("turn"))


@query("""SELECT user_id, CASE arg_max(event_type, ts) WHEN 'error' THEN 'stale-dead' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'idle-eot' ELSE 'unknown' END AS verdict FROM events GROUP BY 1""")
def verdict_rank(events):
    return joins.last_state(events, "user_id", ["ts"], "event_type", {"error": "stale-dead", "click": "running", "purchase": "idle-eot"}, "unknown")


@query("SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rank FROM (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)")
def topn_recent_then_reorder(orders):
    return search.ranked(orders.select("o_orderkey", "o_orderdate"), -50, ["o_orderdate", "o_orderkey"])


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, text || chr(10) || text AS x FROM conversations WHERE length(text) > 0),
w AS (SELECT conv_id, turn, x, 0 AS window_no, '' AS part, CAST(1 AS BIGINT) AS p FROM t
UNION ALL SELECT conv_id, turn, x, window_no + 1, substr(x, p, n), p + n FROM (SELECT *, CASE WHEN length(x) - p + 1 <= 100 THEN length(x) - p + 1
 WHEN strpos(reverse(substr(x, p, 100)), chr(10)) > 0 THEN 101 - strpos(reverse(substr(x, p, 100)), chr(10)) ELSE 100 END AS n FROM w WHERE p <= length(x)))
SELECT conv_id, turn, window_no - 1 AS window_no, part FROM w WHERE window_no > 0""")
def slice_windows(conversations):
    both = conversations.filter(F.length("text") > 0).select("conv_id", "turn", text.windows(F.concat("text", F.lit("\n"), "text"), 100).alias("parts"))
    return both.select("conv_id", "turn", F.posexplode("parts").alias("window_no", "part"))


@query("""SELECT role AS label, count(*) AS n FROM conversations WHERE regexp_matches(text, 'ation', 'i') GROUP BY 1""")
def zero_match_probe(conversations):
    return search.zero_match_probe(conversations.withColumn("label", F.col("role")), search.matches(F.col("text"), "ation"), "label")


@query("""SELECT l_orderkey, min(v) AS first, max(v) AS last, count(*) AS size FROM (SELECT l_orderkey, v, v - row_number() OVER (PARTITION BY l_orderkey ORDER BY v) AS i
FROM (SELECT DISTINCT l_orderkey, l_linenumber AS v FROM lineitem WHERE l_linenumber <> 4)) GROUP BY l_orderkey, i""")
def islands(lineitem):
    return aggregate.islands(lineitem.filter("l_linenumber <> 4").select("l_orderkey", F.col("l_linenumber").alias("v")), ["l_orderkey"], "v")


RICH = f"""(length(text) >= 60 OR regexp_matches(lower(text), '{verbatim.NUMBER}') OR regexp_matches(lower(text), '{verbatim.FINDING}') OR regexp_matches(text, '\\b[0-9]*[a-f][0-9a-f]{{6,39}}\\b')
 OR regexp_matches(text, '[A-Za-z0-9_/-]+\\.[a-z]{{1,4}}:[0-9]+') OR regexp_matches(text, '`[^`]+`'))"""
SELECTED = (
    TURNS
    + f""", a AS (SELECT session_id, turn_index, line_no, length(text) AS n_chars, {RICH} AS rich, row_number() OVER w AS k, count(*) OVER p AS n,
 first_value(line_no) OVER (PARTITION BY session_id, turn_index ORDER BY length(text) DESC, line_no DESC) AS best FROM t WHERE role <> 'system' WINDOW w AS (PARTITION BY session_id, turn_index ORDER BY line_no), p AS (PARTITION BY session_id, turn_index)),
b AS (SELECT *, {{kept}} AS kept FROM a), c AS (SELECT *, sum(CAST(kept AS INT)) OVER (PARTITION BY session_id, turn_index ORDER BY line_no) AS run FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_index, run, kept ORDER BY line_no) AS j, count(*) OVER (PARTITION BY session_id, turn_index, run, kept) AS m FROM c)
SELECT session_id, turn_index, line_no, kept, CASE WHEN NOT kept AND j = 1 THEN m END AS dropped_run FROM d"""
)


def selected(conversations: DataFrame, mode: str) -> DataFrame:
    rows = verbatim.select_messages(turned(conversations).filter("role <> 'system'"), ["session_id", "turn_index"], "line_no", "text", mode, threshold=1, least=60)
    return rows.select("session_id", "turn_index", "line_no", "kept", "dropped_run")


@query(SELECTED.replace("{kept}", "best = line_no OR CASE WHEN k = 1 THEN n_chars >= 60 ELSE rich END"))
def messages_longest(conversations):
    return selected(conversations, "longest")


@query(SELECTED.replace("{kept}", "k = n"))
def messages_eot(conversations):
    return selected(conversations, "eot")


@query("""SELECT key, max(event_id) AS event_id FROM (SELECT user_id || ':' || (event_id % 7) AS key, event_type, event_id FROM events) e WHERE event_type = 'view'
AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'purchase' AND r.user_id || ':' || (r.event_id % 7) = e.key) GROUP BY 1""")
def open_questions(events):
    key = F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string"))
    phase = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "purchase", "resolved")
    markers = events.select(key.alias("key"), phase.alias("phase"), F.lit(None).cast("string").alias("ts"), F.col("event_id").alias("line_no"))
    return live.questions(markers).select("key", F.col("line_no").alias("event_id"))


@query("""WITH told AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' END AS state FROM events WHERE event_type IN ('click', 'error'))
SELECT u.user_id, coalesce(arg_max(state, event_id), 'running') AS state FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN told USING (user_id) GROUP BY 1""")
def background_tasks(events):
    task = F.concat(F.lit("t"), F.col("user_id").cast("string"))
    tasks = events.select(F.lit("s").alias("session_id"), F.col("user_id").alias("call_id"), task.alias("task_id")).distinct()
    state = F.when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "error", "failed")
    odd = F.col("event_id") % 2 == 1
    carriers = events.select(F.lit("s").alias("session_id"), F.col("event_id").alias("line_no"), F.when(odd, F.col("user_id")).alias("call_id"), F.when(~odd, task).alias("task_id"), state.alias("state"))
    return live.background(tasks, carriers).select(F.col("call_id").alias("user_id"), "state")


PLAN = TURNS + """, c AS (SELECT session_id AS s, turn_index AS turn, coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS u, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS a, max(line_no) AS latest,
 turn_index % 3 = 1 AS repeated, turn_index // 2 AS crossed FROM t GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY latest DESC, turn DESC) AS r, count(*) OVER (PARTITION BY s) AS n FROM c),
i AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY phase, repeated, r) AS k FROM o, (VALUES (1), (2)) p(phase)),
g AS (SELECT DISTINCT s, 0 AS k, CAST(0 AS BIGINT) AS spent, CAST(0 AS BIGINT) AS deep, false AS stop, map([CAST(-1 AS BIGINT)], ['']) AS chosen FROM o
UNION ALL SELECT s, k, CASE WHEN sides <> '' THEN spent + cost ELSE spent END, CASE WHEN sides <> '' THEN depth ELSE deep END, stop OR over, CASE WHEN sides <> '' THEN map_concat(chosen, map([turn], [sides])) ELSE chosen END
 FROM (SELECT *, CASE sides WHEN 'both' THEN u + a WHEN 'user' THEN u WHEN 'agent' THEN a ELSE 0 END AS cost, phase = 1 AND sides <> '' AND spent + u + a > 750 AS over
  FROM (SELECT g.s, i.k, g.spent, g.deep, g.stop, g.chosen, i.turn, i.u, i.a, i.phase, greatest(g.deep, i.crossed) AS depth, CASE
   WHEN map_contains(g.chosen, i.turn) THEN ''
   WHEN i.phase = 1 THEN CASE WHEN i.u > 0 AND i.a > 0 AND g.spent + i.u + i.a + 40 * greatest(g.deep, i.crossed) <= 1500 AND (g.spent + i.u + i.a <= 750 AND (i.repeated OR NOT g.stop) OR g.spent = 0 AND NOT i.repeated) THEN 'both' ELSE '' END
   WHEN i.u > 0 AND i.a > 0 AND g.spent + i.u + i.a + 40 * greatest(g.deep, i.crossed) <= 1500 THEN 'both'
   WHEN i.u > 0 AND g.spent + i.u + 40 * greatest(g.deep, i.crossed) <= 1500 THEN 'user'
   WHEN i.a > 0 AND g.spent + i.a + 40 * greatest(g.deep, i.crossed) <= 1500 THEN 'agent' ELSE '' END AS sides
   FROM g JOIN i ON i.s = g.s AND i.k = g.k + 1)))
SELECT s AS session_id, e.key AS turn, e.value AS sides FROM (SELECT s, unnest(map_entries(chosen)) AS e FROM g JOIN (SELECT s, max(k) AS k FROM i GROUP BY 1) USING (s, k)) WHERE e.key >= 0"""


@query(PLAN.replace("WITH l AS", "WITH RECURSIVE l AS", 1))
def budget_planner(conversations):
    cost = lambda role: F.sum(F.when(F.col("role") == role, F.length("text"))).alias(f"{'agent' if role == 'assistant' else role}_cost")
    turns = turned(conversations).groupBy("session_id", F.col("turn_index").alias("turn")).agg(cost("user"), cost("assistant"), F.max("line_no").alias("latest_line"))
    return verbatim.plan_budget(turns.withColumns({"repeated": F.col("turn") % 3 == 1, "crossed": F.expr("turn div 2")}), "session_id", 1500, banners=40)


@query()
def unified_diff(conversations):
    before = F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return conversations.withColumn("before", before).select("conv_id", "turn", diff.unified_diff(F.col("before"), F.col("text")).alias("diff"))


@query()
def char_diff(conversations):
    before = F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return conversations.withColumn("before", before).select("conv_id", "turn", diff.char_diff(F.col("before"), F.col("text")).alias("d")).select("conv_id", "turn", "d.*")


@query()
def changed_spans(conversations):
    before = F.lag("text").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return conversations.withColumn("before", before).select("conv_id", "turn", F.inline(diff.changed_spans(F.col("before"), F.col("text")))).withColumnRenamed("text", "fresh")


@query("SELECT doc_id, length(text) || CASE WHEN length(text) = 1 THEN ' char' ELSE ' chars' END AS size FROM documents")
def plural_noun(documents):
    return documents.select("doc_id", text.count_of(F.length("text"), "char").alias("size"))


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS l FROM documents)
SELECT doc_id, CASE WHEN length(l) <= 60 THEN l ELSE substr(l, 1, 60) || '… (+' || (length(l) - 60) || CASE WHEN length(l) = 61 THEN ' char)' ELSE ' chars)' END END AS line FROM n""")
def collapse_and_cut(documents):
    return documents.select("doc_id", text.one_line(F.col("text"), 60).alias("line"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' WHEN s < 86400 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm'
 ELSE (s // 86400) || 'd ' || (s // 3600 % 24) || 'h' END AS d FROM (SELECT event_id, (event_id * 1777 + 500) // 1000 AS s FROM events)""")
def fmt_duration_ms(events):
    return events.select("event_id", text.duration_ms(F.col("event_id") * 1777).alias("d"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, 'href=\"([^\"]*)\"', 1)), '') AS href FROM pages")
def xml_attribute(pages):
    return pages.select("page_id", text.xml_attribute(F.col("html"), "href").alias("href"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages) SELECT page_id, CASE WHEN strpos(u, '/') = 0 THEN '.' ELSE regexp_replace(u, '/[^/]*$', '') END AS folder, regexp_matches(u, '(^|/)index\.html$') AS is_index FROM p""")
def path_parts(pages):
    u = F.regexp_replace("url", "[?#].*$", "")
    return pages.select("page_id", paths.parent(u).alias("folder"), paths.names_file("index.html", u).alias("is_index"))


@query("""SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, strftime(make_timestamp(CAST(event_id AS BIGINT) * 3600000000), '%Y-%m-%dT%H:%M:%SZ') AS of_hours FROM events""")
def time_texts(events):
    raw = F.concat(F.regexp_replace(F.col("ts").cast("timestamp_ntz").cast("string"), " ", "T"), F.lit("Z"))
    return events.select("event_id", times.epoch_ms(raw).alias("ms"), times.utc_of_seconds(F.col("event_id") * 3600).alias("of_hours"))


@query("SELECT doc_id, CAST(list_sum(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN 2 ELSE 1 END)) AS BIGINT) AS units FROM documents WHERE length(text) > 0")
def utf16_length(documents):
    return documents.filter(F.length("text") > 0).select("doc_id", ids.utf16_units(F.col("text")).alias("units"))


@query("""WITH RECURSIVE n AS (SELECT l_orderkey AS order_key, l_linenumber AS k, lag(l_linenumber, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before,
lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS after FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20))
SELECT order_key, CAST(before + 1 AS BIGINT) AS first, CAST(k - 1 AS BIGINT) AS last FROM n WHERE k > before + 1
UNION ALL SELECT order_key, CAST(k + 1 AS BIGINT), CAST(7 AS BIGINT) FROM n WHERE after IS NULL AND k < 7""")
def line_gaps(lineitem):
    known = lineitem.filter("l_quantity > 20").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("at"))
    return known.select(F.col("l_orderkey").alias("order_key"), F.inline(text.gaps(F.col("at"), F.lit(7))))


@query("""WITH s AS (SELECT user_id AS name, ts, event_id FROM events WHERE event_type = 'signup'), a AS (SELECT user_id AS name, ts, event_id FROM events WHERE event_type = 'click')
SELECT a.event_id AS agent, coalesce((SELECT max(struct_pack(t := s.ts, i := s.event_id)) FROM s WHERE s.name = a.name AND s.ts <= a.ts).i,
(SELECT min(s.event_id) FROM s WHERE s.name = a.name)) AS spawn FROM a""")
def spawn_by_name(events):
    calls = events.filter("event_type = 'signup'").select(
        F.lit("s").alias("session_id"), F.lit(None).cast("string").alias("issuer"), F.col("event_id").alias("line_no"), F.col("event_id").cast("string").alias("call_id"), F.lit("Agent").alias("name"),
        F.to_json(F.struct(F.col("user_id").cast("string").alias("name"))).alias("input"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
    )
    mates = events.filter("event_type = 'click'").select(
        F.lit("s").alias("session_id"), F.col("event_id").cast("string").alias("agent_id"), F.col("user_id").cast("string").alias("name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("started")
    )
    return agents.by_name(mates, agents.spawns(calls)).select(F.col("agent_id").cast("long").alias("agent"), F.col("spawn_id").cast("long").alias("spawn"))
