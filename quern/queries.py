"""The engine's queries over the shipped tables, and the SQL that other engines answer them with."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars, validate
from .operators import aggregates, dml, knowledge, reconcile, registry, retrieval
from .plans import expressions, paging, predicates, relations, scope
from .plans.predicates import Where
from .sources import io
from .sources.tables import table
from .streaming import events as ev

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31') AS total
FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31' ORDER BY o_orderkey DESC LIMIT 20 OFFSET 20""")
def orders_page_total(spark, d):
    conditions = [Where("o_orderstatus", "eq", "O"), *predicates.optional("o_orderpriority", "eq", " "), *predicates.date_range("o_orderdate", "1996-01-01", "1997-12-31")]
    rows = predicates.find_by(table(spark, d, "orders"), conditions).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return paging.page_with_total(rows, [F.desc("o_orderkey")], 2, 20)


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_size >= 10 AND p_size <= 40 AND (p_name LIKE '%red%' OR p_brand LIKE '%red%' OR p_type LIKE '%ECON%')")
def keyword_or_filter(spark, d):
    either = [*predicates.contains("p_name", " red "), *predicates.contains("p_brand", "red"), *predicates.contains("p_type", "ECON")]
    return predicates.find_by(table(spark, d, "part"), [Where("p_size", "ge", 10), Where("p_size", "le", 40)], either).select("p_partkey", "p_name", "p_brand", "p_type")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 7")
def tenant_scope(spark, d):
    return scope.tenant(table(spark, d, "customer"), "c_nationkey", 7).select("c_custkey", "c_name", "c_nationkey")


@query("""SELECT 'alive' AS scope, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'trashed', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'all', count(*) FROM orders""")
def soft_delete_scopes(spark, d):
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    deleted = scope.is_deleted(F.col("deleted_at"))
    one = rows.agg(F.count_if(~deleted).alias("alive"), F.count_if(deleted).alias("trashed"), F.count(F.lit(1)).alias("all"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("scope"), F.col(n).alias("n")) for n in one.columns))).alias("r")).select("r.*")


def tree_edges(spark, d):
    """Regions over nations over customers, in one numbering."""
    nation = table(spark, d, "nation").select((F.col("n_regionkey") + 1_000_000_000).cast("long").alias("parent"), (F.col("n_nationkey") + 900_000_000).cast("long").alias("child"))
    return nation.unionByName(table(spark, d, "customer").select((F.col("c_nationkey") + 900_000_000).cast("long").alias("parent"), F.col("c_custkey").alias("child")))


@query("""WITH RECURSIVE e AS (SELECT CAST(n_regionkey AS BIGINT) + 1000000000 AS parent, CAST(n_nationkey AS BIGINT) + 900000000 AS child FROM nation UNION ALL SELECT CAST(c_nationkey AS BIGINT) + 900000000, c_custkey FROM customer),
w AS (SELECT CAST(1000000001 AS BIGINT) AS node UNION SELECT e.child FROM w JOIN e ON e.parent = w.node)
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT node FROM w)""")
def scope_dept_and_sub(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return scope.data_scope(rows, "dept_and_sub", 1, 1_000_000_001, field="o_custkey", edges=tree_edges(spark, d))


def literal(spark, rows: str, columns: str):
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


EDGES = "(5L, 6L), (5L, 7L), (6L, 8L), (1L, 2L), (2L, 1L), (9L, 9L)"


@query("""WITH RECURSIVE e(parent, child) AS (VALUES (5, 6), (5, 7), (6, 8), (1, 2), (2, 1), (9, 9)), r(id) AS (VALUES (5), (1), (9)),
w AS (SELECT CAST(id AS BIGINT) AS root, CAST(id AS BIGINT) AS node FROM r UNION SELECT w.root, CAST(e.child AS BIGINT) FROM w JOIN e ON e.parent = w.node) SELECT root, node FROM w""")
def tree_closure_cyclic(spark, d):
    return scope.closure(literal(spark, EDGES, "parent, child"), literal(spark, "(5L), (1L), (9L)", "id"))


@query("""SELECT * FROM (VALUES (CAST(4 AS BIGINT), 'unreachable'), (5, 'unreachable'), (5, 'no_end'), (6, 'no_end')) t(node, problem)""")
def graph_reachability(spark, d):
    nodes = literal(spark, "(1L), (2L), (3L), (4L), (5L), (6L)", "node")
    edges = literal(spark, "(1L, 2L), (2L, 3L), (4L, 3L), (5L, 5L), (2L, 6L), (6L, 6L)", "parent, child")
    return scope.validate_graph(nodes, edges, 1, [3])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')")
def has_many(spark, d):
    parents = table(spark, d, "customer").filter("c_mktsegment = 'HOUSEHOLD'")
    return relations.has_many(table(spark, d, "orders"), parents, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey")
def has_one_first(spark, d):
    return relations.has_one(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer"), "o_custkey", "c_custkey", [F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000)")
def belongs_to(spark, d):
    return relations.belongs_to(table(spark, d, "nation"), table(spark, d, "customer").filter("c_acctbal > 5000"), "c_nationkey", "n_nationkey").select("n_nationkey", "n_name")


@query("SELECT s_suppkey, s_name FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_partkey IN (1, 2, 3)")
def belongs_to_many(spark, d):
    return relations.belongs_to_many(table(spark, d, "supplier"), table(spark, d, "lineitem"), "s_suppkey", "l_suppkey", F.col("l_partkey").isin(1, 2, 3)).select("s_suppkey", "s_name")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 3000)")
def morph_many(spark, d):
    return relations.morph_many(table(spark, d, "events"), "click", "event_type", "user_id", table(spark, d, "customer").filter("c_acctbal < 3000"), "c_custkey").select("event_id", "user_id", "event_type")


@query("SELECT event_id, event_type, c_name, NULL AS s_name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'click' UNION ALL SELECT event_id, event_type, NULL, s_name FROM events JOIN supplier ON user_id = s_suppkey WHERE event_type = 'view'")
def morph_to_union(spark, d):
    parents = {"click": (table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey"), "view": (table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")}
    return relations.morph_to(table(spark, d, "events"), "event_type", "user_id", parents).select("event_id", "event_type", "c_name", "s_name")


@query("SELECT event_type AS type, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS ids FROM events GROUP BY event_type")
def morph_groups(spark, d):
    return relations.morph_groups(table(spark, d, "events"), "event_type", "user_id").select("type", F.array_join("ids", ",").alias("ids"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(o_custkey) >= 12)")
def has_count_filter(spark, d):
    return relations.has_count(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", ">=", 12).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def with_join_left(spark, d):
    orders, customer = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").filter("c_acctbal > 0")
    return relations.with_join(orders, customer, orders["o_custkey"] == customer["c_custkey"], [customer["c_name"], customer["c_mktsegment"]])


@query("SELECT o_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS items, count(l_orderkey) AS n_items FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def order_with_items(spark, d):
    item = F.struct("l_linenumber", "l_partkey")
    out = relations.composite(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", item, "items")
    return out.select("o_orderkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("items"), F.size("items").cast("long").alias("n_items"))


@query("SELECT o_orderkey, count(l_orderkey) AS n_items, coalesce(sum(l_quantity), 0) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey")
def master_detail(spark, d):
    out = relations.composite(table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", F.col("l_quantity"), "items")
    return out.select("o_orderkey", F.size("items").cast("long").alias("n_items"), F.aggregate("items", F.lit(0.0), lambda s, x: s + x).alias("quantity"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS n_orders, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS n_items")
def cascade_delete(spark, d):
    orders, items = relations.cascade_delete(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", F.col("o_orderstatus") == "F")
    return orders.agg(F.count(F.lit(1)).alias("n_orders")).join(items.agg(F.count(F.lit(1)).alias("n_items")))


@query("""WITH s AS (SELECT (s_nationkey % 5) || '|' || lower(trim('Brand#' || (s_suppkey % 25))) AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey % 5, s_suppkey % 25 ORDER BY s_suppkey) AS n FROM supplier)
SELECT p_partkey, s_suppkey FROM part LEFT JOIN s ON s.k = (p_size % 5) || '|' || lower(trim(p_brand)) AND n = 1""")
def normalized_key_match(spark, d):
    supplier = table(spark, d, "supplier")
    right = reconcile.normalized(F.col("s_nationkey") % 5, F.concat(F.lit(" Brand#"), (F.col("s_suppkey") % 25).cast("string")))
    left = reconcile.normalized(F.col("p_size") % 5, F.col("p_brand"))
    return reconcile.match_first(table(spark, d, "part").select("p_partkey", "p_size", "p_brand"), supplier, left, right, [F.asc("s_suppkey")], ["s_suppkey"]).select("p_partkey", "s_suppkey")


@query("""SELECT count(*) FILTER (e AND i) AS n_update, count(*) FILTER (NOT e AND i) AS n_insert, count(*) FILTER (e AND NOT i AND x = 0) AS n_delete, count(*) FILTER (e AND NOT i AND x <> 0) AS n_unchanged
FROM (SELECT c_custkey % 2 = 0 AS e, c_custkey % 3 = 0 AS i, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS x FROM customer)""")
def merge_soft_delete_counts(spark, d):
    customer = table(spark, d, "customer").withColumn("is_delete", F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0))
    return reconcile.merge_counts(reconcile.merge_actions(customer.filter("c_custkey % 2 = 0"), customer.filter("c_custkey % 3 = 0"), "c_custkey", "is_delete"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def insert_if_absent(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_name")
    return reconcile.insert_if_absent(customer.filter("c_custkey % 2 = 0"), customer.filter("c_custkey % 3 = 0"), ["c_custkey"])


@query("SELECT l_partkey, CASE WHEN count(*) = 1 THEN min(l_suppkey) END AS owner, count(*) AS claims FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey")
def claim_conflicts(spark, d):
    return reconcile.claims(table(spark, d, "lineitem").filter("l_quantity > 45"), "l_suppkey", "l_partkey")


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'P') AS n_P, count(*) FILTER (o_orderstatus = 'X') AS n_X, CAST(greatest(946684800000 - min(epoch_us(o_orderdate)) FILTER (o_orderstatus = 'P') // 1000, 0) // 1000 AS BIGINT) AS oldest_seconds FROM orders")
def status_snapshot(spark, d):
    rows = table(spark, d, "orders").select("o_orderstatus", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("since"))
    return aggregates.status_snapshot(rows, "o_orderstatus", ["O", "F", "P", "X"], "since", "P", 946_684_800_000)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1998-12-31' GROUP BY 1, 2")
def dimension_report(spark, d):
    metrics = {"quantity": F.col("l_quantity"), "revenue": F.col("l_extendedprice") * (1 - F.col("l_discount"))}
    out = aggregates.report(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], metrics, "l_shipdate", "1996-01-01", "1998-12-31", sort="revenue")
    return out.withColumns({"quantity": F.round("quantity", 2), "revenue": F.round("revenue", 2)})


@query("SELECT s.o_orderpriority, count(o_orderkey) AS count, coalesce(round(sum(o_totalprice), 2), 0) AS amount FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NEVER'), ('5-LOW')) s(o_orderpriority) LEFT JOIN orders o ON s.o_orderpriority = o.o_orderpriority GROUP BY 1")
def stage_pipeline(spark, d):
    return aggregates.completed(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "9-NEVER", "5-LOW"], amount="o_totalprice").withColumn("amount", F.round("amount", 2))


@query("""SELECT le, CASE le WHEN '10' THEN count(*) FILTER (value <= 10) WHEN '50' THEN count(*) FILTER (value <= 50) WHEN '100' THEN count(*) FILTER (value <= 100) WHEN '250' THEN count(*) FILTER (value <= 250) ELSE count(*) END AS bucket, round(sum(value), 2) AS sum, count(*) AS count
FROM events, (VALUES ('10'), ('50'), ('100'), ('250'), ('+Inf')) b(le) GROUP BY le""")
def histogram_cumulative(spark, d):
    return aggregates.histogram(table(spark, d, "events"), "value", [50, 10, 250, 100]).withColumn("sum", F.round("sum", 2))


@query("SELECT user_id, round(coalesce(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'view'), 0), 0), 6) AS rate FROM events GROUP BY user_id")
def safe_ratio(spark, d):
    counted = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"))
    return counted.select("user_id", F.round(aggregates.ratio(F.col("a"), F.col("b")), 6).alias("rate"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_version(spark, d):
    return dml.Versions(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id").latest()


@query("""SELECT l_orderkey, CASE WHEN bool_or(s = 'rejected') THEN 'Rejected' WHEN bool_and(s = 'completed') THEN 'Completed' ELSE 'InProgress' END AS all_sign, CASE WHEN bool_or(s = 'completed') THEN 'Completed' WHEN bool_and(s = 'rejected') THEN 'Rejected' ELSE 'InProgress' END AS any_sign
FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'pending' ELSE 'rejected' END AS s FROM lineitem) GROUP BY l_orderkey""")
def approval_and_or(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "N", "pending").otherwise("rejected")
    all_sign, any_sign = aggregates.approval("s")
    return table(spark, d, "lineitem").select("l_orderkey", status.alias("s")).groupBy("l_orderkey").agg(all_sign.alias("all_sign"), any_sign.alias("any_sign"))


@query("""SELECT l_returnflag, v[least(len(v) * 50 // 100, len(v) - 1) + 1] AS p50, v[least(len(v) * 95 // 100, len(v) - 1) + 1] AS p95, v[least(len(v) * 99 // 100, len(v) - 1) + 1] AS p99
FROM (SELECT l_returnflag, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM lineitem GROUP BY l_returnflag)""")
def percentiles_nearest_index(spark, d):
    return aggregates.nearest_index(table(spark, d, "lineitem"), "l_extendedprice", [50, 95, 99], ["l_returnflag"])


@query("SELECT f AS first, o_orderkey AS duplicate FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) AS f FROM orders) WHERE f <> o_orderkey")
def duplicate_pairs(spark, d):
    return reconcile.duplicate_pairs(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate"], "o_orderkey")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY event_type")
def group_membership_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""SELECT event_id, status, CASE status WHEN 401 THEN 'AuthFailure' WHEN 403 THEN 'AccessDenied' ELSE 'HttpRequest' END AS class FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 403 WHEN 'signup' THEN 401 ELSE 200 END AS status FROM events)
WHERE status IN (401, 403, 413) OR md5(CAST(event_id AS VARCHAR)) < '1999999a'""")
def sampled_audit(spark, d):
    rows = table(spark, d, "events").withColumn("status", F.when(F.col("event_type") == "error", 403).when(F.col("event_type") == "signup", 401).otherwise(200))
    return predicates.sampled(rows, F.col("status").isin(401, 403, 413), 0.1, "event_id").select("event_id", "status", predicates.event_class(F.col("status")).alias("class"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey")
def csv_ids(spark, d):
    return aggregates.id_list(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "ids")


@query("""WITH l AS (SELECT regexp_replace('SELECT * FROM ' || event_type || ' WHERE user = ' || user_id || ' AND k = ''x''', '''[^'']*''?|"[^"]*"?|[0-9][0-9.]*', '?', 'g') AS template, epoch_us(ts) AS us FROM events),
w AS (SELECT template, us, count(*) OVER a AS n, max(us) OVER a AS last, count(*) OVER (PARTITION BY template) AS c FROM l WINDOW a AS (PARTITION BY template ORDER BY us RANGE BETWEEN CURRENT ROW AND 3600000000 FOLLOWING))
SELECT template, arg_min(c, us) AS count, arg_min(last - us, us) AS span_us FROM w WHERE n >= 5 GROUP BY template""")
def n_plus_one(spark, d):
    sql = F.concat(F.lit("SELECT * FROM "), F.col("event_type"), F.lit(" WHERE user = "), F.col("user_id").cast("string"), F.lit(" AND k = 'x'"))
    log = table(spark, d, "events").select(scalars.sql_template(sql).alias("template"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return ev.n_plus_one(log, "template", "us", 5, 3_600_000_000)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def last_n_messages(spark, d):
    return retrieval.last_messages(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3)


@query("""WITH s AS (SELECT conv_id, turn, role, CAST(floor(length(text) * 0.25) AS BIGINT) AS z, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS y FROM conversations),
w AS (SELECT *, sum(1 - y) OVER (PARTITION BY conv_id) AS others, sum(z * y) OVER (PARTITION BY conv_id) AS fixed, row_number() OVER k AS n, sum(z) OVER k AS used FROM s WINDOW k AS (PARTITION BY conv_id, y ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, turn, role FROM w WHERE CASE WHEN y = 0 THEN n = 1 OR fixed + used <= 300 ELSE others > 0 OR n = 1 OR used <= 300 END""")
def token_budget_truncate(spark, d):
    return retrieval.truncate(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", 300).select("conv_id", "turn", "role")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS o, source, text FROM documents),
u AS (SELECT *, sum(length('[' || o || '] ' || text || chr(10) || chr(10))) OVER (PARTITION BY source ORDER BY o) AS used FROM r) SELECT source, doc_id, CAST(o AS INTEGER) AS ordinal, CAST(used AS BIGINT) AS used FROM u WHERE used <= 4000""")
def context_budget(spark, d):
    return retrieval.within_budget(table(spark, d, "documents").select("source", "doc_id", "n_chars", "text"), [F.asc("n_chars"), F.asc("doc_id")], "text", 1000, ["source"]).select("source", "doc_id", "ordinal", "used")


@query("SELECT p_partkey, p_size FROM part ORDER BY coalesce(p_size, 0), p_partkey LIMIT 25 OFFSET 50")
def stable_sort_page(spark, d):
    return paging.listing(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", 3, 25)


@query("""SELECT doc_id, md5(regexp_replace(text, '''[^'']*''?|"[^"]*"?|[0-9][0-9.]*', '?', 'g')) AS template FROM documents""")
def sql_template(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(scalars.sql_template(F.col("text"))).alias("template"))


@query("""SELECT p_partkey, replace(p_name, ' ', '_') AS snake, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '') AS pascal, replace(p_name, ' ', '-') AS kebab FROM part""")
def case_convert(spark, d):
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    p = scalars.pascal(name)
    return table(spark, d, "part").select("p_partkey", scalars.snake(p).alias("snake"), p.alias("pascal"), scalars.kebab(p).alias("kebab"))


@query("""SELECT p_partkey, CASE WHEN w LIKE '%s' THEN w WHEN w LIKE '%y' THEN w[:-2] || 'ies' ELSE w || 's' END AS plural FROM (SELECT p_partkey, string_split(p_name, ' ')[-1] AS w FROM part)""")
def pluralize(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.pluralize(F.element_at(F.split("p_name", " "), -1)).alias("plural"))


@query("SELECT event_id, props FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 60 AND NOT (CAST(json_extract(props, '$.k') AS BIGINT) = 69 OR CAST(json_extract(props, '$.k') AS BIGINT) >= 90)")
def json_extract_guard(spark, d):
    return table(spark, d, "events").filter(expressions.guard("$.k > 60 and not ($.k == 69 or $.k >= 90)", "props")).select("event_id", "props")


@query("SELECT event_id, event_type, value FROM events WHERE (event_type = 'click' AND value >= 100) OR NOT (event_type <> 'error')")
def template_condition(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    return rows.filter(expressions.template("(type eq 'click' && value egt 100) || !(type neq 'error')", {"type": F.col("event_type"), "value": F.col("value").cast("string")}))


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN NOT (length(c_name) <= 17 OR c_name IS NULL) THEN 'c_name:max' END, CASE WHEN NOT (c_acctbal BETWEEN 0 AND 5000) THEN 'c_acctbal:between' END, CASE WHEN c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY') THEN 'c_mktsegment:in' END, CASE WHEN c_nationkey IN (3, 4) THEN 'c_nationkey:notIn' END) AS failures FROM customer""")
def validate_rows(spark, d):
    rules = {"c_name": "require|max:17", "c_acctbal": "number|between:0,5000", "c_mktsegment": "in:HOUSEHOLD,MACHINERY", "c_nationkey": "integer|notIn:3,4"}
    out = validate.validated(table(spark, d, "customer"), rules)
    return out.select("c_custkey", F.array_join("failures", ",").alias("failures"))


@query("SELECT c_custkey, '***' AS c_name, 0 AS c_nationkey, CAST(0.0 AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
def mask_sensitive(spark, d):
    kinds = {"c_name": "string", "c_nationkey": "int", "c_acctbal": "float"}
    return table(spark, d, "customer").withColumns({n: scalars.masked(F.col(n), k) for n, k in kinds.items()})


BM25 = """WITH t AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), lambda x: lower(x)) AS w FROM documents),
l AS (SELECT doc_id, len(w) AS n, w FROM t), s AS (SELECT count(*) AS n, avg(n) AS a FROM l),
p AS (SELECT doc_id, n, term, len(list_filter(w, lambda x: x = term)) AS tf FROM l, (VALUES ('the'), ('license'), ('apache')) q(term)),
f AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM p GROUP BY term),
r AS (SELECT p.doc_id, sum(CASE p.term WHEN 'license' THEN 2 ELSE 1 END * ln((s.n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * p.n / greatest(s.a, 1.0)))) AS score FROM p JOIN f USING (term), s WHERE tf > 0 GROUP BY p.doc_id)"""


@query(BM25 + " SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 20")
def bm25_topk(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), "doc_id", "text", "The license: Apache License", 20).withColumn("score", F.round("score", 6))


def probe(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").filter("vec_id = 7").select("embedding").first()[0])


VECTOR = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, {} AS score FROM embeddings, q) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20"


@query(VECTOR.format("list_cosine_similarity(CAST(embedding AS DOUBLE[]), v)"))
def vector_topk_cosine(spark, d):
    return retrieval.vector_top(table(spark, d, "embeddings"), "vec_id", "embedding", probe(spark, d), 20).withColumn("score", F.round("score", 6))


@query(VECTOR.format("list_dot_product(CAST(embedding AS DOUBLE[]), v)"))
def vector_topk_dot(spark, d):
    return retrieval.vector_top(table(spark, d, "embeddings"), "vec_id", "embedding", probe(spark, d), 20, "dot").withColumn("score", F.round("score", 6))


@query(VECTOR.format("0 - list_distance(CAST(embedding AS DOUBLE[]), v)"))
def vector_topk_l2(spark, d):
    return retrieval.vector_top(table(spark, d, "embeddings"), "vec_id", "embedding", probe(spark, d), 20, "l2").withColumn("score", F.round("score", 6))


@query(BM25 + """, k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM r), q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7),
c AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) DESC, vec_id) AS rv FROM embeddings, q),
b AS (SELECT doc_id, coalesce(0.5 / (60 + rv), 0) + coalesce(0.5 / (60 + rk), 0) AS score FROM (SELECT * FROM c WHERE rv <= 20) FULL JOIN (SELECT * FROM k WHERE rk <= 20) USING (doc_id)) SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20""")
def rrf_hybrid(spark, d):
    vectors = retrieval.vector_top(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", probe(spark, d), 20)
    words = retrieval.bm25(table(spark, d, "documents"), "doc_id", "text", "The license: Apache License", 20)
    return retrieval.fuse(retrieval.ranked(vectors, "doc_id", 20), retrieval.ranked(words, "doc_id", 20), "doc_id", 20).withColumn("score", F.round("score", 6))


@query("""WITH h AS (SELECT doc_id, text, (doc_id % 97) / 97 AS score FROM documents), m AS (SELECT min(strlen(text)) AS lo, max(strlen(text)) AS hi FROM h), s AS (SELECT doc_id, 0.7 * score + (1 - 0.7) * ((strlen(text) - lo) / greatest(hi - lo, 1)) AS score FROM h, m) SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20""")
def weighted_rerank(spark, d):
    hits = table(spark, d, "documents").select("doc_id", "text", ((F.col("doc_id") % 97) / 97).alias("score"))
    return retrieval.rerank(hits, "doc_id", "score", "text", 20).withColumn("score", F.round("score", 6))


def bigram_sql(c: str) -> str:
    return f"list_transform(range(1, length({c})), lambda i: substr({c}, i, 2))"


@query(f"SELECT item_id FROM benchmark WHERE strlen(text) >= 2 AND list_has_any({bigram_sql('text')}, {bigram_sql(chr(39) + 'Qu zx' + chr(39))})")
def fuzzy_bigram(spark, d):
    return table(spark, d, "benchmark").filter(knowledge.fuzzy(F.col("text"), F.lit("Qu zx"))).select("item_id")


@query("""SELECT source, id, score, md5(content) AS content FROM (SELECT 0 AS p, 'document' AS source, doc_id AS id, CAST(1.0 AS DOUBLE) AS score, text AS content FROM documents WHERE contains(text, 'License') UNION ALL SELECT 1, 'benchmark', item_id, 1.0, text FROM benchmark WHERE contains(text, 'the') ORDER BY p, score DESC, id LIMIT 40)""")
def federated_search(spark, d):
    docs = table(spark, d, "documents").filter(F.col("text").contains("License")).select(F.col("doc_id").alias("id"), F.lit(1.0).alias("score"), F.col("text").alias("content"))
    items = table(spark, d, "benchmark").filter(F.col("text").contains("the")).select(F.col("item_id").alias("id"), F.lit(1.0).alias("score"), F.col("text").alias("content"))
    return knowledge.federated([("document", docs), ("benchmark", items)], 40).withColumn("content", F.md5("content"))


@query()
def semantic_chunks(spark, d):
    return knowledge.chunks(table(spark, d, "pages"), "page_id", "html", 800)


def redaction_sql() -> str:
    out = "text"
    for pattern, left in knowledge.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{left}', 'g')"
    return f"SELECT doc_id, md5({out}) AS redacted FROM documents"


@query(redaction_sql())
def redact_secrets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(knowledge.redact(F.col("text"))).alias("redacted"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def incremental_skip(spark, d):
    journal = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"))
    return knowledge.not_done(table(spark, d, "documents").select("doc_id", "n_chars"), journal, "doc_id")


@query("SELECT event_id, user_id FROM events WHERE value / 500 * exp(-0.1 * ((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000)) >= 0.3")
def memory_decay(spark, d):
    rows = table(spark, d, "events").withColumn("importance", F.col("value") / 500)
    return retrieval.remembered(rows, "importance", "ts", F.lit("2024-02-01").cast("timestamp"), 0.1, 0.3).select("event_id", "user_id")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start_5m, count(*) FILTER (event_type = 'error') AS b, count(*) AS a FROM events GROUP BY 1),
x AS (SELECT start_5m, b AS b5, a AS a5, sum(b) OVER m AS b30, sum(a) OVER m AS a30, sum(b) OVER h AS b1, sum(a) OVER h AS a1, sum(b) OVER s AS b6, sum(a) OVER s AS a6 FROM w WINDOW m AS (PARTITION BY CAST(epoch(start_5m) AS BIGINT) // 1800), h AS (PARTITION BY CAST(epoch(start_5m) AS BIGINT) // 3600), s AS (PARTITION BY CAST(epoch(start_5m) AS BIGINT) // 21600)),
y AS (SELECT start_5m, round(b5 / a5 / (1 - 0.95), 6) AS burn_5m, round(b30 / a30 / (1 - 0.95), 6) AS burn_30m, round(b1 / a1 / (1 - 0.95), 6) AS burn_1h, round(b6 / a6 / (1 - 0.95), 6) AS burn_6h, round(1 - least(b6 / a6 / (1 - 0.95), 1.0), 6) AS budget_left FROM x)
SELECT *, burn_5m > 14.4 AND burn_1h > 14.4 AS page, burn_30m > 6 AND burn_6h > 6 AS ticket FROM y""")
def slo_burn_rate(spark, d):
    return ev.burn_rates(table(spark, d, "events"), "ts", F.col("event_type") == "error", 0.95)


def timed(spark, d):
    return table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query()
def sliding_limiter(spark, d):
    return ev.folded(timed(spark, d), "user_id", "us", "event_id", ev.sliding_window(3, 43_200_000_000))


@query()
def token_bucket(spark, d):
    return ev.folded(timed(spark, d), "user_id", "us", "event_id", ev.token_bucket(3, 3 / 43_200))


@query()
def circuit_breaker(spark, d):
    rows = timed(spark, d).withColumn("failed", F.col("event_type") == "error")
    return ev.folded(rows, "user_id", "us", "event_id", ev.circuit_breaker(86_400_000_000, 0.3, 43_200_000_000, 2), ("failed",))


@query()
def state_machine(spark, d):
    steps = {("draft", "signup"): ("review", None), ("review", "purchase"): ("done", lambda v: v > 100), ("review", "error"): ("draft", None)}
    return ev.folded(timed(spark, d), "user_id", "us", "event_id", ev.state_machine("draft", steps), ("event_type", "value"))


JOBS_SQL = "SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN 'pending' WHEN event_type = 'error' THEN 'running' ELSE 'succeeded' END AS status, CAST(event_id % 4 AS INTEGER) AS attempts, epoch_us(ts) // 1000 AS run_after, CASE WHEN event_type = 'error' THEN epoch_us(ts) // 1000 + 60000 END AS locked_until, epoch_us(ts) // 1000 AS created_at FROM events"


@query(f"""WITH j AS ({JOBS_SQL}), r AS (SELECT id, attempts, run_after, created_at, CASE WHEN status = 'running' AND locked_until < 1705276800000 - 60000 THEN 'pending' ELSE status END AS status FROM j),
c AS (SELECT id, attempts + 1 AS attempts, run_after FROM r WHERE status = 'pending' AND run_after <= 1705276800000 ORDER BY created_at, id LIMIT 200)
SELECT id, attempts, CASE WHEN id % 3 = 0 THEN 'succeeded' WHEN id % 3 = 1 AND attempts <= 3 THEN 'pending' ELSE 'dead' END AS status, CASE WHEN id % 3 = 1 AND attempts <= 3 THEN 1705276800000 + CAST(floor(least(2.0 * pow(2, least(attempts, 6)), 60.0) * 1000) AS BIGINT) ELSE run_after END AS run_after FROM c""")
def queue_claim_retry(spark, d):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    status = F.when(F.col("event_type").isin("click", "view"), "pending").when(F.col("event_type") == "error", "running").otherwise("succeeded")
    jobs = table(spark, d, "events").select(F.col("event_id").alias("id"), status.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"), ms.alias("run_after"), F.when(F.col("event_type") == "error", ms + 60_000).alias("locked_until"), ms.alias("created_at"))
    now = 1_705_276_800_000
    taken = ev.claimed(ev.reclaimed(jobs, now, 60_000), now, 60_000, 200)
    outcome = F.when(F.col("id") % 3 == 0, "ok").when(F.col("id") % 3 == 1, "temporary").otherwise("permanent")
    return ev.finished(taken.withColumn("outcome", outcome), "outcome", now, 3, 2.0, 60.0).select("id", "attempts", "status", "run_after")


@query("SELECT event_id, event_type, subscriber FROM events JOIN (VALUES ('click', 'a'), ('click', 'b'), ('error', 'a'), ('none', 'c')) s(event_type, subscriber) USING (event_type)")
def event_fanout(spark, d):
    subscriptions = literal(spark, "('click', 'a'), ('click', 'b'), ('error', 'a'), ('none', 'c')", "event_type, subscriber")
    return ev.fan_out(table(spark, d, "events"), subscriptions, "event_type").select("event_id", "event_type", "subscriber")


@query("""SELECT c_custkey, c_custkey || ',' || '"' || replace(c_name || ',"x"', '"', '""') || '"' || ',' || coalesce(c_mktsegment, '') || ',' AS line FROM customer""")
def csv_export_text(spark, d):
    return table(spark, d, "customer").select("c_custkey", io.csv_line(F.col("c_custkey"), F.concat("c_name", F.lit(',"x"')), F.col("c_mktsegment"), F.lit(None)).alias("line"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def row_to_json(spark, d):
    return io.row_json(table(spark, d, "nation"))


@query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)) WHERE r = 1")
def cart_merge_top(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.lit(1).cast("long").alias("n"))
    added = dml.add_up(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ["user_id", "event_type"], "n")
    return paging.top_per(added, ["user_id"], [F.desc("n"), F.asc("event_type")], 1).drop("rank")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE NOT (o_totalprice < 1000)")
def update_and_delete(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return dml.delete(dml.update(rows, {"o_orderstatus": F.lit("P")}, F.col("o_orderstatus") == "O"), F.col("o_totalprice") < 1000)


@query("""SELECT event_id, user_id, event_type FROM events WHERE event_id < 500 UNION ALL SELECT min(event_id), user_id, event_type FROM events WHERE event_id >= 500 AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id < 500) GROUP BY user_id, event_type""")
def insert_deduplicated(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return dml.insert_deduplicated(rows.filter("event_id < 500"), rows.filter("event_id >= 500"), ["user_id", "event_type"], "event_id")


@query("SELECT event_type, round(coalesce(s.v, 0) + coalesce(sum(CASE WHEN s.id IS NULL OR event_id > s.id THEN CASE event_id % 10 WHEN 1 THEN -value WHEN 0 THEN NULL ELSE value END END), 0), 2) AS value FROM events LEFT JOIN (SELECT event_type AS t, max(event_id) AS id, arg_max(value, event_id) AS v FROM events WHERE event_id % 10 = 0 GROUP BY 1) s ON s.t = event_type GROUP BY event_type, s.v")
def gauge_values(spark, d):
    kind = F.when(F.col("event_id") % 10 == 0, "set").when(F.col("event_id") % 10 == 1, "dec").otherwise("inc")
    rows = table(spark, d, "events").select("event_type", kind.alias("kind"), "value", "event_id")
    return registry.counters(rows, ["event_type"], "kind", "value", "event_id").withColumn("value", F.round("value", 2))


@query("SELECT event_id, map_extract_value(MAP {'k': '1', 'id': event_type}, 'id') AS id, CAST(value AS VARCHAR) AS value FROM events")
def merged_context(spark, d):
    context = F.create_map(F.lit("k"), F.lit("1"), F.lit("id"), F.col("event_type"))
    extra = F.create_map(F.lit("id"), F.lit("forged"), F.lit("value"), F.col("value").cast("string"))
    merged = registry.merged_context(context, extra, ["id"])
    return table(spark, d, "events").select("event_id", merged["id"].alias("id"), merged["value"].alias("value"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM (SELECT user_id, event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000)) WHERE n = 1")
def capped_first_seen(spark, d):
    return knowledge.first_seen(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], [F.desc("event_id")], 1000)


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS events FROM events GROUP BY user_id")
def grouped_in_order(spark, d):
    out = aggregates.grouped_in_order(table(spark, d, "events"), ["user_id"], "event_id", "event_type", "events")
    return out.select("user_id", F.array_join("events", ",").alias("events"))


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) AS total FROM orders")
def outcome_counts(spark, d):
    return registry.outcomes(table(spark, d, "orders"), "o_orderstatus", ["O", "F"])


@query("SELECT '# TYPE events counter' AS line UNION ALL SELECT 'events{type=\"' || event_type || '\"} ' || count(*) FROM events GROUP BY event_type")
def metric_text(spark, d):
    counted = table(spark, d, "events").groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return io.metric_text(counted, "events", "counter", "n", ["type"])


@query("SELECT o_orderkey, (o_orderstatus, o_next) IN (('O', 'P'), ('P', 'F')) AS allowed FROM (SELECT o_orderkey, o_orderstatus, CASE o_orderkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'F' ELSE 'O' END AS o_next FROM orders)")
def allowed_transitions(spark, d):
    after = F.when(F.col("o_orderkey") % 3 == 0, "P").when(F.col("o_orderkey") % 3 == 1, "F").otherwise("O")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", after.alias("next"))
    return dml.allowed(rows, "o_orderstatus", "next", {"O": ["P"], "P": ["F"]}).select("o_orderkey", "allowed")


@query("SELECT l_orderkey, round(sum(greatest(l_extendedprice - 20000, 0)), 2) AS total FROM lineitem GROUP BY l_orderkey")
def clamped_totals(spark, d):
    value = F.greatest(F.col("l_extendedprice") - 20000, F.lit(0.0))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(value), 2).alias("total"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'ip:10.0.0.' || user_id ELSE 'user:' || user_id END AS by_user, 'ip:' || CASE WHEN user_id % 2 = 0 THEN '1.1.1.' || user_id ELSE '10.0.0.' || user_id END || ':' || event_type AS by_route FROM events""")
def limiter_keys(spark, d):
    rows = table(spark, d, "events")
    ip = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))
    forwarded = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("1.1.1."), F.col("user_id").cast("string"), F.lit(", 9.9.9.9")))
    user = F.when(F.col("user_id") % 3 != 0, F.col("user_id"))
    return rows.select("event_id", ev.limiter_key(user, ip, F.col("event_type"), "user").alias("by_user"), ev.limiter_key(user, ip, F.col("event_type"), "ip_route", forwarded, True).alias("by_route"))


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS rank FROM events) WHERE rank <= 2")
def version_history(spark, d):
    return paging.top_per(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], [F.desc("event_id")], 2)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer""")
def optimistic_update(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.lit(1).alias("version"), "c_name")
    changes = rows.filter("c_custkey % 3 = 0 OR c_custkey % 7 = 1").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(9).alias("version"), F.lit("new").alias("c_name"))
    return dml.update_if_version(rows, changes, "c_custkey", "version")


@query("""WITH c AS (SELECT s_nationkey AS k, list(s_suppkey ORDER BY s_suppkey) FILTER (s_suppkey % 4 <> 0) AS free, count(*) AS n FROM supplier GROUP BY 1)
SELECT n_nationkey, CASE WHEN c.n IS NULL THEN 'unmatched' WHEN free IS NULL THEN 'claimed' WHEN len(free) = 1 THEN 'single' ELSE 'several' END AS outcome, coalesce(array_to_string(free, ','), '') AS free FROM nation LEFT JOIN c ON k = n_nationkey""")
def reconciliation_check(spark, d):
    candidates = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.when(F.col("s_suppkey") % 4 == 0, "other").alias("owner"), "s_suppkey")
    out = reconcile.checked(table(spark, d, "nation").select("n_nationkey", F.lit("me").alias("me")), candidates, ["n_nationkey"], "owner", "me", "s_suppkey")
    return out.select("n_nationkey", "outcome", F.array_join("free", ",").alias("free"))


@query("""WITH a AS (SELECT o_custkey AS g, o_orderkey AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'O'),
b AS (SELECT o_custkey AS g, o_orderkey AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'F') SELECT a.g AS g, a, b FROM a JOIN b ON a.g = b.g AND a.r = b.r AND a.n = b.n""")
def leftover_pairs(spark, d):
    side = lambda status, name: table(spark, d, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias(name))
    return reconcile.pair_up(side("O", "a"), side("F", "b"), ["g"], "a", "b").select("g", "a", "b")


@query("SELECT (SELECT count(*) FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 1000)) / (SELECT count(*) FROM labels WHERE quality = 1) AS recall")
def recall_at_k(spark, d):
    found = table(spark, d, "documents").filter("n_chars > 1000").select("doc_id")
    return retrieval.recall(found, table(spark, d, "labels").filter("quality = 1"), "doc_id")


@query("SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 64 AS BIGINT) AS batch FROM part")
def embedding_batches(spark, d):
    return retrieval.batches(table(spark, d, "part").select("p_partkey"), "p_partkey", 64)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 < 3 THEN 'error' END AS e FROM nation")
def expired_events(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", (3 - F.col("n_nationkey") % 4).alias("retry_count"))
    return rows.join(ev.exhausted(rows, most=1).select("n_nationkey", F.lit("error").alias("e")), "n_nationkey", "left").select("n_nationkey", "e")


@query("""SELECT c_custkey, '***' AS name, 0 AS nation, c_mktsegment AS segment FROM customer""")
def mask_nested(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("private"), F.col("c_mktsegment").alias("segment")).alias("r"))
    hidden = rows.select("c_custkey", scalars.masked_deep(F.col("r"), rows.schema["r"].dataType, {"private"}).alias("r"))
    return hidden.select("c_custkey", "r.private.name", "r.private.nation", "r.segment")


from . import row_queries  # noqa: E402, F401  registers more of them
