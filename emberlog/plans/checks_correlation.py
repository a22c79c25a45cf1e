"""Queries over the driver's tables for correlation, chains, sessions and the graph, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions.storage import stage
from emberlog.operators import correlation as c
from emberlog.operators import graph as g
from emberlog.plans.checks_detection import E_SQL, table
from emberlog.sources.events import sec_events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{E_SQL}{sql if sql.startswith(',') else ' ' + sql}"
        return f

    return put


# Users, addresses and hosts of the view are functions of user_id; user_id % 20 is the least common part of all three.
GROUPED = ", g AS (SELECT e.*, CAST(substr(user_id, 2) AS BIGINT) % 20 AS component FROM e)"


@query("SELECT count(*) AS n, count(DISTINCT message || ip_address) AS texts FROM (SELECT DISTINCT message, ts, ip_address FROM e) t")
def c1_deduplicate(spark, sf_dir):
    df = sec_events(spark, sf_dir)
    return c.deduplicate(df.unionAll(df)).agg(F.count("*").alias("n"), F.countDistinct(F.concat("message", "ip_address")).alias("texts"))


@query(", x AS (SELECT 'ip_address=' || ip_address AS entity FROM e UNION ALL SELECT 'user_id=' || user_id FROM e UNION ALL SELECT 'host=' || host FROM e) SELECT entity, count(*) AS n FROM x GROUP BY entity")
def c2_entity_edges(spark, sf_dir):
    return c.entity_edges(sec_events(spark, sf_dir)).groupBy("entity").agg(F.count("*").alias("n"))


def _members(spark, sf_dir):
    df = sec_events(spark, sf_dir)
    return df.join(c.correlated_groups(df), "id")


@query(GROUPED + " SELECT count(*) AS n, min(id) AS first FROM g GROUP BY component")
def c3_components(spark, sf_dir):
    return _members(spark, sf_dir).groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("first")).drop("component")


GAPS = GROUPED + ", d AS (SELECT component, date_diff('microsecond', lag(ts) OVER (PARTITION BY component ORDER BY ts, id), ts) AS gap FROM g), m AS (SELECT component, min(gap) AS least, count(*) AS n FROM d GROUP BY component)"


@query(GAPS + " SELECT count(*) AS n FROM m WHERE n < 2 OR least <= 1000000")
def c4_time_filter(spark, sf_dir):
    return c.near_in_time(_members(spark, sf_dir), 1_000_000).agg(F.count("*").alias("n"))


@query(GROUPED + """, s AS (SELECT component, count(*) AS event_count, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS span, count(DISTINCT ip_address) AS ips, count(DISTINCT user_id) AS users, count(DISTINCT host) AS hosts, count(DISTINCT event_type) AS types, bool_or(contains(event_type, 'fail')) AS failed,
  max(CASE severity WHEN 'info' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END) AS rank FROM g GROUP BY component)
SELECT event_count, ips, users, hosts, types, concat_ws(',', CASE WHEN ips > 3 THEN 'multi_source' END, CASE WHEN span < 60 AND event_count >= 5 THEN 'burst_activity' END, CASE WHEN failed THEN 'auth_failures' END) AS tags, round(span, 3) AS span, round(least(3.0, event_count * 0.3) + rank * 0.75 + least(2.0, 100.0 / (span + 1) * 0.02) + least(2.0, ips * 0.4), 3) AS score FROM s""")
def c5_group_summary(spark, sf_dir):
    df = c.summarise_groups(_members(spark, sf_dir))
    return df.select("event_count", F.col("source_ips").alias("ips"), "users", "hosts", F.col("event_types").alias("types"), F.round("span_seconds", 3).alias("span"), "score", F.array_join("tags", ",").alias("tags"))


@query(GAPS + """ SELECT w AS "window", count(*) AS n FROM m, (VALUES ('1s', 1000000), ('1m', 60000000), ('1h', 3600000000)) v(w, us) WHERE n < 2 OR least <= us GROUP BY w""")
def c6_multi_window(spark, sf_dir):
    return c.multi_window(_members(spark, sf_dir), (("1s", 1), ("1m", 60), ("1h", 3600))).groupBy("window").agg(F.count("*").alias("n"))


@query("""SELECT 'ip' AS kind, ip_address AS entity, count(*) AS n, 0.6 AS confidence, least(10.0, count(*) * 0.5) AS risk FROM e GROUP BY ip_address HAVING count(*) > 1
UNION ALL SELECT 'user', user_id, count(*), 0.55, least(10.0, count(*) * 0.5) FROM e GROUP BY user_id HAVING count(*) > 1""")
def c7_entity_groups(spark, sf_dir):
    return c.entity_groups(sec_events(spark, sf_dir))


@query(", n AS (SELECT host, id AS src, lead(id) OVER (PARTITION BY host ORDER BY ts, id) AS dst FROM e) SELECT host, src, dst FROM n WHERE dst IS NOT NULL")
def c8_followed_by(spark, sf_dir):
    return c.followed_by(sec_events(spark, sf_dir), "host")


STEPS = """, t AS (SELECT id, ts, ip_address, CASE WHEN contains(lower(message), 'failed') THEN 1 ELSE 0 END AS s1,
  CASE WHEN contains(event_type, 'auth_success') OR contains(event_type, 'login') OR contains(lower(message), 'success') THEN 1 ELSE 0 END AS s2, CASE WHEN contains(lower(message), 'sudo') OR contains(lower(message), 'su ') THEN 1 ELSE 0 END AS s3 FROM e)"""


@query(STEPS + " SELECT 0 AS step, 0 AS n WHERE false UNION ALL SELECT 1, CAST(sum(s1) AS BIGINT) FROM t UNION ALL SELECT 2, CAST(sum(s2) AS BIGINT) FROM t UNION ALL SELECT 3, CAST(sum(s3) AS BIGINT) FROM t")
def k1_step_tags(spark, sf_dir):
    return c.step_tags(sec_events(spark, sf_dir)).filter("pattern = 'ACP001'").groupBy("step").agg(F.count("*").alias("n"))


GREEDY = STEPS + """, a AS (SELECT ip_address, min(ts) AS t1 FROM t WHERE s1 = 1 GROUP BY ip_address),
i AS (SELECT ip_address, count(*) AS events FROM e GROUP BY ip_address), a1 AS (SELECT i.*, a.t1 FROM i LEFT JOIN a USING (ip_address)),
b AS (SELECT a1.ip_address, events, t1, min(t.ts) AS t2 FROM a1 LEFT JOIN t ON t.ip_address = a1.ip_address AND s2 = 1 AND (t1 IS NULL OR t.ts > t1) GROUP BY ALL),
d AS (SELECT b.ip_address, events, t1, t2, min(t.ts) AS t3 FROM b LEFT JOIN t ON t.ip_address = b.ip_address AND s3 = 1 AND (coalesce(t2, t1) IS NULL OR t.ts > coalesce(t2, t1)) GROUP BY ALL),
m AS (SELECT *, CAST(t1 IS NOT NULL AS INT) + CAST(t2 IS NOT NULL AS INT) + CAST(t3 IS NOT NULL AS INT) AS matched FROM d)"""


@query(GREEDY + " SELECT ip_address, matched, matched / 4 AS ratio FROM m WHERE matched >= 2")
def k2_match_chains(spark, sf_dir):
    return c.match_chains(sec_events(spark, sf_dir), patterns=c.PATTERNS[:1]).select("ip_address", "matched", "ratio")


@query(GREEDY + " SELECT ip_address, round(matched / 4 * 0.7 + least(0.3, matched / events * 0.3), 3) AS confidence, matched < 4 AS is_partial FROM m WHERE matched >= 2")
def k3_chain_confidence(spark, sf_dir):
    return c.match_chains(sec_events(spark, sf_dir), patterns=c.PATTERNS[:1]).select("ip_address", "confidence", "is_partial")


def _fits(step: tuple) -> str:
    _, types, words = step
    kinds = [f"contains(lower(event_type), '{t.lower()}') OR (event_type <> '' AND contains('{t.lower()}', lower(event_type)))" for t in types]
    return " OR ".join(kinds + [f"contains(lower(message), '{w.lower()}')" for w in words])


ALL_STEPS = ", t AS (" + " UNION ALL ".join(f"SELECT ip_address, '{p.id}' AS pattern, {i} AS step, ts, id FROM e WHERE {_fits(s)}" for p in c.PATTERNS for i, s in enumerate(p.steps)) + ")"
SIZES = ", z(pattern, steps) AS (VALUES " + ", ".join(f"('{p.id}', {len(p.steps)})" for p in c.PATTERNS) + ")"
#: Per step, the first event after the one that the step before took; ties in time go by id.
WALK = ", i AS (SELECT ip_address, count(*) AS events FROM e GROUP BY ip_address), w0 AS (SELECT ip_address, events, pattern, steps, CAST(NULL AS TIMESTAMP) AS seen, CAST(NULL AS VARCHAR) AS seen_id, 0 AS matched FROM i, z)" + "".join(
    f""", h{n} AS (SELECT w.ip_address, w.pattern, t.ts, t.id, row_number() OVER (PARTITION BY w.ip_address, w.pattern ORDER BY t.ts, t.id) AS nth FROM w{n} w JOIN t ON t.ip_address = w.ip_address AND t.pattern = w.pattern AND t.step = {n} AND (w.seen IS NULL OR t.ts > w.seen OR (t.ts = w.seen AND t.id > w.seen_id))),
w{n + 1} AS (SELECT w.ip_address, events, w.pattern, steps, coalesce(h.ts, seen) AS seen, coalesce(h.id, seen_id) AS seen_id, matched + CAST(h.ts IS NOT NULL AS INT) AS matched FROM w{n} w LEFT JOIN h{n} h ON h.ip_address = w.ip_address AND h.pattern = w.pattern AND h.nth = 1)"""
    for n in range(max(len(p.steps) for p in c.PATTERNS))
)
ALL_CHAINS = ALL_STEPS + SIZES + WALK + f", m AS (SELECT * FROM w{max(len(p.steps) for p in c.PATTERNS)} WHERE matched / steps >= 0.5)"


@query(ALL_STEPS + " SELECT pattern, step, count(*) AS n FROM t GROUP BY pattern, step")
def k1_step_tags_all(spark, sf_dir):
    return c.step_tags(sec_events(spark, sf_dir)).groupBy("pattern", "step").agg(F.count("*").alias("n"))


@query(ALL_CHAINS + " SELECT ip_address, pattern, matched, matched / steps AS ratio FROM m")
def k2_match_chains_all(spark, sf_dir):
    return c.match_chains(sec_events(spark, sf_dir)).select("ip_address", "pattern", "matched", "ratio")


@query(ALL_CHAINS + " SELECT ip_address, pattern, round(least(1.0, matched / steps * 0.7 + least(0.3, matched / events * 0.3)), 3) AS confidence, matched < steps AS is_partial FROM m")
def k3_chain_confidence_all(spark, sf_dir):
    return c.match_chains(sec_events(spark, sf_dir)).select("ip_address", "pattern", "confidence", "is_partial")


SESSIONS = """, l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY ip_address, user_id, host ORDER BY ts, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY ip_address, user_id, host ORDER BY ts, id) AS nth FROM l),
x AS (SELECT *, row_number() OVER v AS rn, date_diff('microsecond', min(ts) OVER v, ts) / 1e6 AS sec, lag(country) OVER v AS lc, lag(ts) OVER v AS lt FROM s WINDOW v AS (PARTITION BY user_id, nth ORDER BY ts, id)),
z AS (SELECT user_id, nth, count(*) AS n, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS sec, bool_or(sec >= 1 AND rn / (CASE WHEN sec > 0 THEN sec END / 60) > 0.05) AS burst,
  bool_or(contains(lower(message), 'sudo') OR contains(lower(message), 'su ') OR contains(lower(message), 'root') OR contains(lower(message), 'admin')) AS priv, bool_or(lc <> country AND date_diff('microsecond', lt, ts) / 3.6e9 < 1500 / 700) AS jump FROM x GROUP BY user_id, nth)"""
SIX = 6 * 3_600_000_000


#: A session's name: address, user and host with the session's number.
SESSION_ID = "'192.0.2.' || CAST(CAST(substr(user_id, 2) AS BIGINT) % 60 AS VARCHAR) || '|' || user_id || '|h' || CAST(CAST(substr(user_id, 2) AS BIGINT) % 20 AS VARCHAR) || '#' || CAST(nth AS VARCHAR) AS session"


def _sessions(spark, sf_dir):
    return c.session_summary(c.sessionize(sec_events(spark, sf_dir), SIX, keep_parts=True), burst_per_minute=0.05)


@query(SESSIONS + f" SELECT {SESSION_ID}, n, round(sec, 3) AS seconds FROM z")
def e1_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir).select("session", "n", F.round((F.col("end_us") - F.col("start_us")) / 1e6, 3).alias("seconds"))


@query(SESSIONS + f" SELECT {SESSION_ID}, coalesce(burst, false) AS burst, priv FROM z")
def e2_e3_burst_and_privilege(spark, sf_dir):
    return _sessions(spark, sf_dir).select("session", F.col("burst_activity").alias("burst"), F.col("privilege_escalation").alias("priv"))


@query(SESSIONS + f" SELECT {SESSION_ID}, sec > 28800 AS long, coalesce(jump, false) AS jump FROM z")
def e4_e5_duration_and_travel(spark, sf_dir):
    return _sessions(spark, sf_dir).select("session", F.col("abnormal_duration").alias("long"), F.col("impossible_travel").alias("jump"))


@query(SESSIONS + f""" SELECT {SESSION_ID}, round(least(10.0, CASE WHEN burst THEN 2.5 ELSE 0 END + CASE WHEN priv THEN 3.0 ELSE 0 END + CASE WHEN sec > 28800 THEN 1.5 ELSE 0 END + CASE WHEN jump THEN 4.0 ELSE 0 END + least(2.0, n * 0.02)), 2) AS risk FROM z""")
def e6_session_risk(spark, sf_dir):
    return _sessions(spark, sf_dir).select("session", "risk")


@query(SESSIONS + f""", w AS (SELECT user_id, nth, max(ts) AS last FROM s GROUP BY 1, 2) SELECT {SESSION_ID}, CASE WHEN TIMESTAMP '2024-01-20' - last > INTERVAL 6 HOUR THEN 'expired' ELSE 'open' END AS state FROM w""")
def e7_session_states(spark, sf_dir):
    return c.session_states(_sessions(spark, sf_dir), 1_705_708_800_000_000, SIX).select("session", "state")


TRADE = ", o AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS src, 'n' || CAST(c_nationkey AS VARCHAR) AS dst FROM orders JOIN customer ON o_custkey = c_custkey)"


def _trade(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    ends = o.join(k, o.o_custkey == k.c_custkey).selectExpr("concat('c', o_custkey) AS src", "concat('n', c_nationkey) AS dst", "'orders_in' AS kind", "1D AS weight")
    return g.merge_edges(ends)


#: A component is named by its least entity, an address.
NAMED = GROUPED + ", k AS (SELECT component, 'alert:' || min('host=' || host) AS alert FROM g GROUP BY component)"


@query(NAMED + """, x AS (SELECT 'ip:' || ip_address AS src, alert AS dst, 'triggered' AS kind FROM g JOIN k USING (component) UNION SELECT 'user:' || user_id, alert, 'triggered' FROM g JOIN k USING (component)
UNION SELECT alert, 'host:' || host, 'attacked' FROM g JOIN k USING (component)) SELECT src, dst, kind, 1.0 AS weight FROM x""")
def g1_group_graph(spark, sf_dir):
    return g.group_edges(c.group_entities(_members(spark, sf_dir)))


@query("SELECT 'ip:' || ip_address AS src, 'alert:' || id AS dst, 'triggered' AS kind, severity FROM e WHERE severity <> 'info' UNION ALL SELECT 'user:' || user_id, 'alert:' || id, 'triggered', severity FROM e WHERE severity <> 'info'")
def g2_alert_graph(spark, sf_dir):
    return g.alert_edges(sec_events(spark, sf_dir).filter("severity <> 'info'")).drop("weight")


@query(TRADE + " SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM o GROUP BY src, dst")
def g3_merge_edges(spark, sf_dir):
    return _trade(spark, sf_dir).drop("kind")


@query(TRADE + " SELECT DISTINCT src AS node FROM o WHERE dst = 'n3'")
def g4_neighbours(spark, sf_dir):
    return g.neighbours(_trade(spark, sf_dir), "n3")


@query(TRADE + " SELECT count(DISTINCT src || dst) AS edges, count(DISTINCT src) AS customers FROM o WHERE dst <> 'n3'")
def g5_remove_nodes(spark, sf_dir):
    edges = _trade(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    _, left = g.remove_nodes(nodes, edges, spark.createDataFrame([("n3",)], "node string"))
    return left.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("customers"))


#: A graph with cycles and several hops: nations tied by the customers and suppliers that trade, weighted to a few ties each.
TIES = """, l AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b, o_orderkey % 97 AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey),
t AS (SELECT DISTINCT 'n' || CAST(a AS VARCHAR) AS src, 'n' || CAST(b AS VARCHAR) AS dst FROM l WHERE a <> b AND (b - a = 1 OR (a * 7 + b * 3) % 41 = k % 41 AND k < 3))"""


def _ties(spark, sf_dir):
    o, k, i, s = (table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "supplier"))
    rows = o.join(k, o.o_custkey == k.c_custkey).join(i, i.l_orderkey == o.o_orderkey).join(s, s.s_suppkey == i.l_suppkey)
    rows = rows.selectExpr("c_nationkey AS a", "s_nationkey AS b", "o_orderkey % 97 AS k").distinct()
    kept = rows.filter("a <> b AND (b - a = 1 OR ((a * 7 + b * 3) % 41 = k % 41 AND k < 3))")
    return stage(kept.selectExpr("concat('n', a) AS src", "concat('n', b) AS dst").distinct(), "ties")


WALKED = TIES + ", r AS (SELECT 'n0' AS node, 0 AS hops UNION SELECT t.dst, hops + 1 FROM r JOIN t ON t.src = r.node WHERE hops < 10), h AS (SELECT node, min(hops) AS hops FROM r GROUP BY node)"


@query(WALKED + " SELECT h.node, h.hops, (SELECT min(t.src) FROM t JOIN h p ON p.node = t.src WHERE t.dst = h.node AND p.hops = h.hops - 1) AS parent FROM h", recursive=True)
def g6_distances(spark, sf_dir):
    return g.distances(_ties(spark, sf_dir), "n0")


PATHS = TIES + ", p AS (SELECT ['n0'] AS path, 'n0' AS node UNION ALL SELECT list_append(path, t.dst), t.dst FROM p JOIN t ON t.src = p.node WHERE NOT list_contains(path, t.dst) AND len(path) < 5)"


@query(PATHS + " SELECT array_to_string(path, '>') AS path FROM p WHERE len(path) > 1 AND node IN ('n3', 'n5', 'n12')", recursive=True)
def g7_g10_simple_paths(spark, sf_dir):
    ends = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    return g.simple_paths(_ties(spark, sf_dir), ends("n0"), ends("n3", "n5", "n12"), 5).select(F.array_join("path", ">").alias("path"))


@query(TRADE + ", d AS (SELECT DISTINCT src, dst FROM o), t AS (SELECT dst AS node, count(*) AS total FROM d GROUP BY dst UNION ALL SELECT src, count(*) FROM d GROUP BY src) SELECT node, total FROM t ORDER BY total DESC, node LIMIT 10")
def g8_top_pivots(spark, sf_dir):
    return g.top_pivots(_trade(spark, sf_dir)).select("node", "total")


#: Users tied to the host that follows theirs in a chain of forty, broken every eighth: components of several hops.
CHAINED = """, x AS (SELECT DISTINCT CAST(substr(user_id, 2) AS BIGINT) % 40 AS n FROM e), y AS (SELECT 'c' || CAST(n AS VARCHAR) AS src, 'c' || CAST(n + 1 AS VARCHAR) AS dst, n FROM x WHERE n % 8 <> 7),
w AS (SELECT src AS node, src AS seed FROM y UNION SELECT dst, dst FROM y UNION SELECT CASE WHEN w.node = y.src THEN y.dst ELSE y.src END, seed FROM w JOIN y ON w.node IN (y.src, y.dst)), m AS (SELECT node, min(seed) AS component FROM w GROUP BY node)"""


@query(CHAINED + " SELECT component, count(*) AS n FROM m GROUP BY component", recursive=True)
def g9_communities(spark, sf_dir):
    n = F.substring("user_id", 2, 20).cast("long") % 40
    edges = sec_events(spark, sf_dir).select(n.alias("n")).distinct().filter("n % 8 <> 7")
    return g.communities(edges.selectExpr("concat('c', n) AS src", "concat('c', n + 1) AS dst"))


@query(TRADE + """ SELECT 'nodes' AS what, 'customer' AS kind, count(DISTINCT src) AS n FROM o UNION ALL SELECT 'nodes', 'host', count(DISTINCT dst) FROM o UNION ALL SELECT 'edges', 'orders_in', count(DISTINCT src) FROM o
UNION ALL SELECT 'communities', 'all', count(DISTINCT dst) FROM o UNION ALL SELECT 'communities', 'largest', max(n) FROM (SELECT 1 + count(DISTINCT src) AS n FROM o GROUP BY dst) t""")
def g11_graph_summary(spark, sf_dir):
    e = _trade(spark, sf_dir)
    customers = e.select(F.col("src").alias("node"), F.lit("customer").alias("kind"), F.col("src").alias("label"), F.lit(0).alias("seq"))
    return g.graph_summary(g.merge_nodes(customers, e), e)
