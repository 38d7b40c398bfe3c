"""Queries over the models, the scaffolds and the example application; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.operators import app, models, scan, snapshot
from siltlog.plans.registry import ORACLES, query
from siltlog.sources.log import DELETE, NOW, SET, VALUE, read_table

_KEY = "'key-' || lpad(CAST({} AS VARCHAR), 6, '0')"


@query("wl_sequential", f"SELECT id AS seq, CASE WHEN id < 500 THEN 'put' ELSE 'get' END AS kind, {_KEY.format('id % 500')} AS key, CAST(CASE WHEN id < 500 THEN 12 ELSE 0 END AS BIGINT) AS bytes FROM range(1000) t(id)")
def wl_sequential(spark, sf_dir):
    return models.sequential(spark, 500)


@query("wl_hotspot", f"SELECT id AS seq, CASE WHEN id < 300 THEN 'put' ELSE 'get' END AS kind, {_KEY.format('CASE WHEN id < 600 THEN id % 300 ELSE [1, 2, 7][(id - 600) % 3 + 1] END')} AS key, CAST(CASE WHEN id < 300 THEN 12 ELSE 0 END AS BIGINT) AS bytes FROM range(1000) t(id)")
def wl_hotspot(spark, sf_dir):
    return models.hotspot(spark, 300, 400, [1, 2, 7])


@query("wl_overwrite_hotset", f"SELECT id AS seq, 'put' AS kind, {_KEY.format('CASE WHEN id < 400 THEN id ELSE (id - 400) % 20 END')} AS key, CAST(64 AS BIGINT) AS bytes FROM range(1400) t(id)")
def wl_overwrite_hotset(spark, sf_dir):
    return models.overwrite_hotset(spark, 400, 1000, 20, 64)


@query("wl_small_values", f"SELECT id AS seq, 'put' AS kind, {_KEY.format('id')} AS key, CAST(32 AS BIGINT) AS bytes FROM range(700) t(id)")
def wl_small_values(spark, sf_dir):
    return models.overwrite_hotset(spark, 700, 0, 1, 32)


@query("wl_mixed", f"SELECT id AS seq, CASE WHEN id < 100 OR (id - 99) * 30 // 100 > (id - 100) * 30 // 100 THEN 'put' ELSE 'get' END AS kind, {_KEY.format('CASE WHEN id < 100 THEN id ELSE (id - 100) % 100 END')} AS key, CAST(64 AS BIGINT) AS bytes FROM range(1100) t(id)")
def wl_mixed(spark, sf_dir):
    return models.mixed(spark, 100, 1000, 30, 64)


@query("wl_cold_garbage", f"SELECT id AS seq, 'put' AS kind, {_KEY.format('CASE WHEN id < 500 THEN id ELSE id - 500 END')} AS key, CAST(128 AS BIGINT) AS bytes FROM range(620) t(id)")
def wl_cold_garbage(spark, sf_dir):
    return models.cold_garbage(spark, 500, 120, 128)


_LIMITS = {"signup": 100, "error": 0, "click": -1, "view": 1500}


@query(
    "fault_schedule",
    """SELECT event_id AS idx, event_type AS point, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS call, coalesce(lim >= 0 AND row_number() OVER (PARTITION BY event_type ORDER BY event_id) > lim, false) AS fails
    FROM (SELECT *, CASE event_type WHEN 'signup' THEN 100 WHEN 'error' THEN 0 WHEN 'click' THEN -1 WHEN 'view' THEN 1500 END AS lim FROM events)""",
)
def fault_schedule(spark, sf_dir):
    calls = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("event_type").alias("point"))
    return models.fault_schedule(calls, _LIMITS)


@query(
    "torn_write_enum",
    """SELECT region, CAST(o AS BIGINT) AS "offset", CAST(hi AS BIGINT) AS size, 'recovery/torn-write/region=' || region || '/offset=' || CAST(o AS VARCHAR) || '/size=' || CAST(hi AS VARCHAR) AS id
    FROM (SELECT region, unnest(range(lo, hi)) AS o, hi FROM (VALUES ('header', 0, 42), ('bucket', 42, 46), ('key', 46, 55), ('value', 55, 75)) t(region, lo, hi))""",
)
def torn_write_enum(spark, sf_dir):
    return models.torn_writes(spark, 42, 4, 9, 20)


_WRITES = "w AS (SELECT * FROM (VALUES " + ", ".join(str(w) for w in models.MANIFEST_WRITES) + ") t(kind, phase, occurrence)), st AS (SELECT unnest(" + str(models.MANIFEST_STAGES) + ") AS stage)"


@query("manifest_fault_matrix", f"WITH {_WRITES} SELECT kind, phase, CAST(occurrence AS BIGINT) AS occurrence, stage, 'manifest/' || kind || '/phase=' || phase || '/stage=' || stage || '/occurrence=' || CAST(occurrence AS VARCHAR) AS id FROM w, st ORDER BY id")
def manifest_fault_matrix(spark, sf_dir):
    return models.manifest_faults(spark).select("kind", "phase", "occurrence", "stage", "id")


@query(
    "manifest_action",
    f"""WITH {_WRITES} SELECT kind, phase, stage, CAST(count(*) AS BIGINT) AS n, CASE WHEN stage IN ('temp-write', 'file-sync') THEN 'ignore-attempt' WHEN stage = 'rename' THEN 'retain-source' WHEN phase IN ('installed', 'pointers-installed') THEN 'remove-source'
    WHEN phase IN ('source-removed', 'finalized') THEN 'clear-manifest' ELSE 'retain-source' END AS action FROM w, st GROUP BY ALL""",
)
def manifest_action(spark, sf_dir):
    return models.manifest_faults(spark).groupBy("kind", "phase", "stage", "action").agg(F.count("*").alias("n"))


_OPENED = [(s, p, t, n) for s in ("missing", "corrupt", "read") for p in ("prepared", "installed", "odd") for t, n in ((0, 0), (2, 1), (2, 2))]


@query(
    "merge_manifest_decision",
    "SELECT s AS state, p AS phase, CAST(t AS BIGINT) AS targets, CAST(n AS BIGINT) AS present, CASE WHEN s = 'missing' THEN 'nothing' WHEN s = 'corrupt' OR p = 'odd' THEN 'error' WHEN p = 'installed' AND n >= t THEN 'remove-source-and-clear' ELSE 'clear' END AS action FROM (VALUES "
    + ", ".join(str(o) for o in _OPENED)
    + ") v(s, p, t, n)",
)
def merge_manifest_decision(spark, sf_dir):
    return models.merge_manifest_decision(spark.createDataFrame(_OPENED, "state string, phase string, targets long, present long"))


def _literal(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"


_SCENARIOS = "sc AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, s)) + ")" for s in models.SCENARIOS) + ") t(scenario, fault_point, idx, kind, tx_id, key, value, committed, expires_at))"


@query(
    "recovery_scenarios",
    f"""WITH {_SCENARIOS} SELECT scenario, key, NOT gone AS found, CASE WHEN NOT gone THEN value END AS value FROM (SELECT s.*, kind = 'delete' OR (expires_at > 0 AND expires_at <= 100) AS gone FROM sc s
    WHERE EXISTS (SELECT 1 FROM sc m WHERE m.scenario = s.scenario AND m.tx_id = s.tx_id AND m.committed) QUALIFY row_number() OVER (PARTITION BY scenario, key ORDER BY idx DESC) = 1)""",
)
def recovery_scenarios(spark, sf_dir):
    return models.scenario_results(spark.createDataFrame(models.SCENARIOS, models.SCENARIO_SCHEMA).where("idx IS NOT NULL"), 100)


@query("recovery_scenario_ids", f"WITH {_SCENARIOS} SELECT DISTINCT 'recovery/' || scenario || '/fault=' || fault_point AS id FROM sc ORDER BY id")
def recovery_scenario_ids(spark, sf_dir):
    return spark.createDataFrame(models.SCENARIOS, models.SCENARIO_SCHEMA).select(F.format_string("recovery/%s/fault=%s", "scenario", "fault_point").alias("id")).distinct().orderBy("id")


@query(
    "lsm_overlay",
    """SELECT key, value FROM (SELECT user_id AS key, props AS value, event_id % 3 = 0 AS wal, event_id FROM events) QUALIFY row_number() OVER (PARTITION BY key ORDER BY wal DESC, event_id DESC) = 1""",
)
def lsm_overlay(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    return models.overlay(rows.where("seq % 3 <> 0"), rows.where("seq % 3 = 0"))


def _replicated(spark, sf_dir) -> DataFrame:
    """A log per user: batches of entries that mostly go on, sometimes repeat, rewrite or leave a gap."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("v"))
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows = e.withColumn("nth", nth)
    index = F.when(F.col("v") % 13 == 0, F.lit(0)).when(F.col("v") % 5 == 0, F.floor((F.col("nth") + 3) / 4)).otherwise(F.floor((F.col("nth") + 1) / 2))
    return rows.select("user_id", F.expr("event_id div 200").alias("batch"), "event_id", index.cast("long").alias("index"), F.expr("1 + nth div 20").alias("term"))


_RAFT = """WITH RECURSIVE n AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
    r AS (SELECT user_id, event_id // 200 AS batch, event_id, CAST(CASE WHEN v % 13 = 0 THEN 0 WHEN v % 5 = 0 THEN (nth + 3) // 4 ELSE (nth + 1) // 2 END AS BIGINT) AS idx, 1 + nth // 20 AS term, nth FROM n),
    s0 AS (SELECT user_id, batch, event_id, idx, term, nth FROM r),
    st AS (SELECT user_id, batch, event_id, idx, term, CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS terms, false AS failed, CAST(NULL AS BIGINT) AS b, '' AS effect FROM s0 WHERE nth = 1
    UNION ALL SELECT user_id, batch, event_id, idx, term, nth, CASE effect WHEN 'appended' THEN list_append(terms, term) WHEN 'replaced' THEN list_append(terms[:idx - 1], term) ELSE terms END, f OR effect = 'conflict', batch, effect
    FROM (SELECT *, CASE WHEN f THEN 'not reached' WHEN idx = 0 THEN 'conflict' WHEN idx <= len(terms) AND terms[idx] = term THEN 'present' WHEN idx <= len(terms) THEN 'replaced' WHEN idx = len(terms) + 1 THEN 'appended' ELSE 'conflict' END AS effect
      FROM (SELECT n.user_id, n.batch, n.event_id, n.idx, n.term, n.nth, s.terms, CASE WHEN s.b IS NOT DISTINCT FROM n.batch THEN s.failed ELSE false END AS f FROM st s JOIN s0 n ON n.user_id = s.user_id AND n.nth = s.nth + 1)))
    SELECT user_id, batch, event_id, idx AS "index", term, effect, len(terms) AS last_index FROM st WHERE nth > 0"""


@query(
    "raft_append",
    _RAFT,
)
def raft_append(spark, sf_dir):
    return models.replicated_append(_replicated(spark, sf_dir), ["user_id"], ["event_id"])


# The application store: products are parts, orders are orders, sessions are customers.


@query("product_stock", "SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS name, CAST(p_size * 10 AS BIGINT) AS stock FROM part")
def product_stock(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part")
    value = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("name"), (F.col("p_size") * 10).alias("stock")))
    live = parts.select(F.lit("products").alias("bucket"), F.col("p_partkey").cast("string").alias("key"), value.alias("value"))
    return app.records(live, "products", app.PRODUCT).select("sku", "name", "stock")


@query("session_lookup", "SELECT c_name AS user, md5(c_name) AS token FROM customer WHERE c_custkey % 7 <> 0")
def session_lookup(spark, sf_dir):
    """Sessions of every seventh customer have expired."""
    customers = read_table(spark, sf_dir, "customer")
    value = F.to_json(F.struct(F.col("c_name").alias("user"), F.md5("c_name").alias("token")))
    ttl = F.when(F.col("c_custkey") % 7 == 0, 10).otherwise(0).cast("long")
    index = customers.select(F.lit("sessions").alias("bucket"), F.col("c_custkey").cast("string").alias("key"), value.alias("value"), F.lit(SET).alias("flag"), ttl.alias("ttl"), F.lit(NOW - 60).alias("ts"))
    log = index.withColumns({"file_id": F.lit(0).cast("long"), "pos": F.col("key").cast("long"), "status": F.lit(1), "ds": F.lit(VALUE), "tx_id": F.lit(0).cast("long")})
    found = scan.get_many(log, index.select("bucket", "key")).where("outcome = 'found'")
    return app.records(found, "sessions", app.SESSION).select("user", "token")


def _orders(spark, sf_dir) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    value = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("user"), F.col("o_orderpriority").alias("sku"), F.floor("o_totalprice").alias("count")))
    key = F.concat(F.col("o_custkey").cast("string"), F.lit(":"), F.col("o_orderkey").cast("string"))
    return o.select(F.lit("user_orders").alias("bucket"), key.alias("key"), value.alias("value"), F.lit(SET).alias("flag"), F.lit(0).cast("long").alias("ttl"), F.lit(NOW - 60).alias("ts"))


@query("orders_by_user", "SELECT CAST(o_orderkey AS VARCHAR) AS order_key, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user, o_orderpriority AS sku, CAST(floor(o_totalprice) AS BIGINT) AS count FROM orders WHERE o_custkey = 37")
def orders_by_user(spark, sf_dir):
    return app.orders_by_user(_orders(spark, sf_dir), "37", NOW)


@query(
    "place_order_fold",
    """WITH RECURSIVE o AS (SELECT o_orderkey AS seq, o_custkey % 200 AS sku, CAST(floor(o_totalprice / 100000) AS BIGINT) + 1 AS n, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) AS rn FROM orders),
    stock AS (SELECT p_partkey AS sku, CAST(p_size * 5 AS BIGINT) AS stock FROM part WHERE p_partkey % 200 = p_partkey AND p_partkey % 10 <> 3),
    st AS (SELECT o.sku, seq, n, rn, s.stock IS NOT NULL AND s.stock >= n AS ok, CASE WHEN s.stock >= n THEN s.stock - n ELSE s.stock END AS left_ FROM o LEFT JOIN stock s ON s.sku = o.sku WHERE rn = 1
    UNION ALL SELECT o.sku, o.seq, o.n, o.rn, s.left_ IS NOT NULL AND s.left_ >= o.n, CASE WHEN s.left_ >= o.n THEN s.left_ - o.n ELSE s.left_ END FROM st s JOIN o ON o.sku = s.sku AND o.rn = s.rn + 1)
    SELECT CAST(sku AS VARCHAR) AS sku, seq, n AS count, ok AS accepted, coalesce(left_, 0) AS stock_after FROM st""",
)
def place_order_fold(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).cast("string").alias("sku"), F.col("o_orderkey").alias("seq"), (F.floor(F.col("o_totalprice") / 100000) + 1).alias("count"))
    stock = read_table(spark, sf_dir, "part").where((F.col("p_partkey") < 200) & (F.col("p_partkey") % 10 != 3)).select(F.col("p_partkey").cast("string").alias("sku"), (F.col("p_size") * 5).alias("stock"))
    return app.place_orders(stock, orders)


@query("raft_last_index", f"SELECT user_id, arg_max(last_index, event_id) AS last_index FROM ({_RAFT}) GROUP BY 1")
def raft_last_index(spark, sf_dir):
    return models.last_index(models.replicated_append(_replicated(spark, sf_dir), ["user_id"], ["event_id"]), ["user_id"], "event_id")


@query("fixed_values", "SELECT id AS size, list_aggregate(list_transform(range(id), lambda k: lpad(lower(to_hex(k % 251)), 2, '0')), 'string_agg', '') AS value FROM range(1, 600) t(id)")
def fixed_values(spark, sf_dir):
    return spark.range(1, 600).select(F.col("id").alias("size"), models.fixed_value(F.col("id")).alias("value"))


@query("put_objects", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_nationkey % 5 <> 0")
def put_objects(spark, sf_dir):
    """A batch of JSON objects is put, every fifth is deleted, and the rest is read back."""
    nation = read_table(spark, sf_dir, "nation")
    value = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    put = nation.select(F.lit(0).cast("long").alias("file_id"), F.col("n_nationkey").cast("long").alias("pos"), F.lit("objects").alias("bucket"), F.col("n_nationkey").cast("string").alias("key"), value.alias("value"), F.lit(SET).alias("flag"), F.lit(1).alias("status"), F.lit(0).alias("ds"), F.lit(0).cast("long").alias("ttl"), F.lit(NOW - 60).cast("long").alias("ts"), F.lit(1).cast("long").alias("tx_id"))
    gone = put.where("pos % 5 = 0").withColumns({"file_id": F.lit(1).cast("long"), "value": F.lit(None).cast("string"), "flag": F.lit(DELETE), "tx_id": F.lit(2).cast("long")})
    live = snapshot.live(snapshot.index_plain(put.unionByName(gone)))
    return app.records(live, "objects", "name string, region long").select("key", "name", "region")


@query("raft_entries", f"""SELECT user_id, "index", term FROM (SELECT user_id, "index", arg_max(term, event_id) AS term FROM ({_RAFT}) WHERE effect IN ('appended', 'replaced') GROUP BY ALL)
    JOIN (SELECT user_id, arg_max(last_index, event_id) AS last_index FROM ({_RAFT}) GROUP BY 1) USING (user_id) WHERE "index" <= last_index""")
def raft_entries(spark, sf_dir):
    return models.held_entries(models.replicated_append(_replicated(spark, sf_dir), ["user_id"], ["event_id"]), ["user_id"], "event_id")


@query(
    "lsm_flush",
    """SELECT key, value, seq FROM (SELECT user_id AS key, props AS value, event_id AS seq, [1, 2, 0][event_id % 3 + 1] AS level FROM events) QUALIFY row_number() OVER (PARTITION BY key ORDER BY level DESC, seq DESC) = 1""",
)
def lsm_flush(spark, sf_dir):
    """Two flushes: what a store holds that has been filled, flushed, opened again, filled and flushed once more."""
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    first = models.flush(rows.where("seq % 3 = 2"), rows.where("seq % 3 = 0"))
    return models.flush(first, rows.where("seq % 3 = 1"))


@query(
    "place_order_writes",
    f"""SELECT tx_id, CAST(pos AS BIGINT) AS pos, bucket, key, value, status FROM (SELECT p.seq AS tx_id, unnest([0, 1, 2]) AS pos, unnest(['products', 'orders', 'user_orders']) AS bucket, unnest([p.sku, CAST(p.seq AS VARCHAR), 'u' || CAST(o.o_custkey AS VARCHAR) || ':' || CAST(p.seq AS VARCHAR)]) AS key,
    unnest(['{{"sku":"' || p.sku || '","name":"' || t.p_name || '","stock":' || CAST(p.stock_after AS VARCHAR) || '}}', '{{"id":"' || CAST(p.seq AS VARCHAR) || '","user":"u' || CAST(o.o_custkey AS VARCHAR) || '","sku":"' || p.sku || '","count":' || CAST(p.count AS VARCHAR) || '}}',
      '{{"id":"' || CAST(p.seq AS VARCHAR) || '","user":"u' || CAST(o.o_custkey AS VARCHAR) || '","sku":"' || p.sku || '","count":' || CAST(p.count AS VARCHAR) || '}}']) AS value, unnest([0, 0, 1]) AS status
    FROM ({ORACLES["place_order_fold"]}) p JOIN orders o ON o.o_orderkey = p.seq JOIN part t ON CAST(t.p_partkey AS VARCHAR) = p.sku WHERE p.accepted)""",
)
def place_order_writes(spark, sf_dir):
    products = read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("name"))
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user"))
    return app.order_writes(place_order_fold(spark, sf_dir), products, orders)
