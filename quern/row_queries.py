"""More of the engine's queries: row-wise functions, validation rules, writes, tags and retrieval's small parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars, validate
from .operators import aggregates, dml, knowledge, registry, retrieval
from .plans import predicates, scope
from .queries import query
from .sources import tables
from .sources.tables import table
from .streaming import events as ev

#: Texts that the rules are tried on, dealt out by key.
SAMPLES = ("abc", "Abc1", "a-b_1", "13912345678", "00:1A:2b:3c:4d:5e", "10.0.0.256", "10.0.0.1", "200040", "https://a.b", "x.y@mail.org", "-42", "")
#: The rules' patterns as the other engine takes them: fixed values.
RULES = {
    "alpha": "^[A-Za-z]+$",
    "alphaNum": "^[A-Za-z0-9]+$",
    "alphaDash": "^[A-Za-z0-9_-]+$",
    "mobile": "^1[3-9][0-9]{9}$",
    "macAddr": "^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$",
    "email": "^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}$",
    "url": "^(http://|https://|ftp://|ftps://|mailto:|tel:|file://)",
    "integer": "^[+-]?[0-9]+$",
    "zip": "[0-9]{6}",
    "accepted": "^(yes|on|1)$",
}
SAMPLE_SQL = "CASE c_custkey % 12 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SAMPLES)) + " END"


def samples(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("c_custkey") % 12 + 1).cast("int")).alias("v"))


@query(f"SELECT c_custkey, {', '.join(f'regexp_matches(v, {chr(39)}{p}{chr(39)}) AS {n}' for n, p in RULES.items())} FROM (SELECT c_custkey, {SAMPLE_SQL} AS v FROM customer)")
def rule_patterns(spark, d):
    return samples(spark, d).select("c_custkey", *(F.coalesce(validate.check("v", n, []), F.lit(False)).alias(n) for n in RULES))


@query(f"""SELECT c_custkey, v <> '' OR c_nationkey <> 3 AS required_if, v <> '' OR false AS required_with, v = 'abc' OR v = '-42' AS listed, NOT (v = 'abc') AS unlisted, v = '10.0.0.1' AS allowed_ip, v <> '10.0.0.1' AS no_denied_ip,
length(v) BETWEEN 3 AND 5 AS sized, length(v) <= 4 AS short, v = CAST(c_custkey AS VARCHAR) AS confirmed, length(v) >= 0 AS odd_bound FROM (SELECT c_custkey, c_nationkey, {SAMPLE_SQL} AS v FROM customer)""")
def rule_fields(spark, d):
    rows = samples(spark, d)
    rules = {"required_if": ("requireIf", ["c_nationkey", "3"]), "required_with": ("requireWith", ["c_custkey"]), "listed": ("in", ["abc", "-42"]), "unlisted": ("notIn", ["abc"]), "allowed_ip": ("allowIp", [" 10.0.0.1 "]), "no_denied_ip": ("denyIp", ["10.0.0.1 "])}
    rules |= {"sized": ("length", ["3", "5"]), "short": ("max", ["4"]), "confirmed": ("confirm", ["c_custkey"]), "odd_bound": ("min", ["many"])}
    return rows.select("c_custkey", *(validate.check("v", n, a).alias(c) for c, (n, a) in rules.items()))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'flag:boolean' WHEN 2 THEN 'big:integer' ELSE 'tags:max' END AS failed FROM orders")
def rule_types(spark, d):
    k = F.col("o_orderkey") % 4
    rows = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k == 1, "true").otherwise("1").alias("flag"),
        F.when(k == 2, "99999999999999999999").otherwise("9223372036854775807").alias("big"),
        F.when(k == 3, F.array(*map(F.lit, "abc"))).otherwise(F.array(F.lit("a"), F.lit("bcdefg"))).alias("tags"),
        (k == 0).alias("sure"),
    )
    found = validate.failures(rows, {"flag": "boolean", "big": "integer", "tags": "must|array|max:2", "sure": "boolean"})
    return rows.select("o_orderkey", F.element_at(F.when(F.size(found) > 0, found), 1).alias("failed"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ie' WHEN 1 THEN 'city' WHEN 2 THEN 'class' WHEN 3 THEN 'part' ELSE 'sheep' END AS one FROM part")
def singular_names(spark, d):
    word = F.element_at(F.array(*map(F.lit, ("ies", "cities", "class", "parts", "sheep"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", scalars.singularize(word).alias("one"))


@query("SELECT event_id, CASE WHEN value > 50 THEN '1' ELSE '' END AS flag, event_type = 'error' AS empty, event_type || '|' || CAST(user_id AS VARCHAR) AS key, CASE WHEN event_id % 3 <> 0 THEN value END AS finite, CASE WHEN event_id % 3 = 0 THEN '+Inf' ELSE '5.0' END AS bound FROM events")
def text_forms(spark, d):
    odd = F.when(F.col("event_id") % 3 == 0, F.lit(float("inf")))
    return table(spark, d, "events").select(
        "event_id",
        scalars.as_text(F.col("value") > 50).alias("flag"),
        scalars.is_empty(F.when(F.col("event_type") == "error", F.lit("[]")).otherwise(F.col("event_type"))).alias("empty"),
        scalars.cache_key(F.col("event_type"), F.col("user_id")).alias("key"),
        scalars.finite(F.coalesce(odd, F.col("value"))).alias("finite"),
        scalars.bound_text(F.coalesce(odd, F.lit(5.0))).alias("bound"),
    )


@query("SELECT c_custkey, '***' AS token, c_name AS name FROM customer")
def masked_headers(spark, d):
    headers = F.create_map(F.lit("Authorization"), F.concat(F.lit("Bearer "), F.col("c_name")), F.lit("name"), F.col("c_name"))
    hidden = scalars.masked_map(headers, {"authorization", "Cookie"})
    return table(spark, d, "customer").select("c_custkey", hidden["Authorization"].alias("token"), hidden["name"].alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' END AS deleted_at FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 7 = 0")
def soft_deleted_and_restored(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when((F.col("o_orderkey") % 5 == 0) & (F.col("o_orderkey") % 3 != 0), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).alias("deleted_at"))
    gone = dml.soft_delete(rows, F.col("o_orderkey") % 3 == 0, at=F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    return dml.restore(gone, F.col("o_orderkey") % 7 == 0)


@query("SELECT count(*) FILTER (o_orderstatus <> 'F') AS alive, count(*) FILTER (o_orderstatus = 'F') AS trashed FROM orders")
def alive_and_trashed(spark, d):
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    alive = scope.alive(rows, "deleted_at").agg(F.count(F.lit(1)).alias("alive"))
    return alive.join(F.broadcast(scope.alive(rows, "deleted_at", "trashed").agg(F.count(F.lit(1)).alias("trashed"))))


@query("SELECT c_custkey, upper(c_mktsegment) || '!' AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0")
def hooked_update(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    hooks = {"before_write": lambda df: df.filter("c_custkey % 2 = 0"), "before_update": lambda df: df.withColumn("c_mktsegment", F.upper("c_mktsegment")), "before_insert": lambda df: df.limit(0)}
    return dml.with_hooks("update", rows, lambda df: dml.update(df, {"c_mktsegment": F.concat("c_mktsegment", F.lit("!"))}), hooks)


@query("SELECT p_partkey FROM part WHERE list_has_all(string_split(p_type, ' '), ['ECONOMY', 'BRASS']) AND p_brand = 'Brand#11'")
def member_and_status(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("tags"), "p_brand")
    return rows.filter(predicates.has_all("tags", ["ECONOMY"]) & predicates.member_with_status("tags", "BRASS", "p_brand", "Brand#11")).select("p_partkey")


@query("SELECT event_type, event_id, user_id FROM events WHERE list_contains([user_id % 5, user_id % 3], 2) AND event_type = 'click'")
def array_member_and_status(spark, d):
    rows = table(spark, d, "events").withColumn("members", F.array(F.col("user_id") % 5, F.col("user_id") % 3))
    return rows.filter(predicates.member_with_status("members", 2, "event_type", "click")).select("event_type", "event_id", "user_id")


@query("SELECT p_partkey, p_type FROM part WHERE (contains(lower(p_type), 'brass') OR contains(lower(p_name), 'brass')) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
def any_case_search(spark, d):
    return table(spark, d, "part").filter(predicates.contains_any_case("BRass", "p_type", "p_name") & predicates.excluded("p_brand", ["Brand#11", "Brand#12"])).select("p_partkey", "p_type")


@query("SELECT p_type AS name, 'local' AS source FROM (SELECT DISTINCT p_type FROM part) WHERE list_contains(string_split(p_type, ' '), 'BRASS')")
def tagged_capabilities(spark, d):
    rows = table(spark, d, "part").select(F.col("p_type").alias("name"), F.split("p_type", " ").alias("tags"), F.lit("local").alias("source")).dropDuplicates(["name"])
    return registry.by_tags(rows, ["BRASS"], "local").select("name", "source")


@query("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def counts_by_type(spark, d):
    return registry.counts_by(table(spark, d, "events"), "event_type")


@query("SELECT o_orderkey, CAST(list_filter([o_orderkey % 4, 3, o_orderkey % 4, 1], lambda x: list_contains([1, 2], x)) AS VARCHAR) AS kept FROM orders")
def ordered_intersection(spark, d):
    left = F.array(F.col("o_orderkey") % 4, F.lit(3), F.col("o_orderkey") % 4, F.lit(1))
    kept = registry.kept_in_order(left, F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("["), F.array_join(F.transform(kept, lambda x: x.cast("string")), ", "), F.lit("]")).alias("kept"))


@query("SELECT n_nationkey, upper(n_name) AS label, CAST(NULL AS VARCHAR) AS missing FROM nation")
def derived_columns(spark, d):
    return tables.project(registry.appended(table(spark, d, "nation"), {"label": F.upper("n_name"), "missing": None}), ["n_nationkey", "label", "missing"])


@query("SELECT o_orderkey, 'export-' || strftime(o_orderdate + INTERVAL 8 HOUR, '%Y%m%d%H%M%S') || '.csv' AS name FROM orders")
def stamped_names(spark, d):
    return table(spark, d, "orders").select("o_orderkey", registry.stamped_name("export-", F.col("o_orderdate").cast("timestamp"), ".csv").alias("name"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0")
def vectors_removed(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "label")
    gone = vectors.filter("vec_id % 3 = 0").select("vec_id").unionByName(vectors.selectExpr("-1 - vec_id AS vec_id"))
    return retrieval.removed(vectors, gone, ["vec_id"])


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'new' ELSE 'old' END AS state FROM embeddings UNION ALL SELECT -1 - vec_id, 'new' FROM embeddings WHERE vec_id % 4 = 0")
def vectors_upserted(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.lit("old").alias("state"), F.lit(0).alias("at"))
    new = rows.filter("vec_id % 4 = 0")
    new = new.unionByName(new.withColumn("vec_id", -1 - F.col("vec_id"))).withColumns({"state": F.lit("new"), "at": F.lit(1)})
    return retrieval.upsert(rows, new.unionByName(new.withColumns({"state": F.lit("older"), "at": F.lit(0)})), ["vec_id"], "at").select("vec_id", "state")


@query("WITH h AS (SELECT doc_id, text, (doc_id % 97) / 97 AS score FROM documents ORDER BY score DESC, doc_id LIMIT 15) SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS offset, CAST(strlen(text) AS INTEGER) AS length, md5(text) AS text FROM h")
def cited_hits(spark, d):
    hits = table(spark, d, "documents").select("doc_id", "text", ((F.col("doc_id") % 97) / 97).alias("score")).orderBy(F.desc("score"), "doc_id").limit(15)
    kept, warnings = retrieval.rerank_or_keep(hits, hits.limit(0))
    assert warnings
    return retrieval.citations(kept, [F.desc("score"), F.asc("doc_id")], "doc_id", "text").select("doc_id", "offset", "length", F.md5("text").alias("text"))


@query("SELECT max((doc_id % 97) / 97.0) AS top_score, max((doc_id % 97) / 97.0) < 0.999 AS low_recall FROM documents")
def weak_hits(spark, d):
    return knowledge.low_recall(table(spark, d, "documents").select(((F.col("doc_id") % 97) / 97).alias("score")), 0.999)


@query("SELECT p_partkey, p_size % 10 >= 1 AND p_size % 10 <= p_size AND p_size <= l.n AS valid FROM part LEFT JOIN (SELECT p_brand AS b, max(p_size) - 1 AS n FROM part GROUP BY 1) l ON p_brand = l.b")
def checked_sources(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("path"), (F.col("p_size") % 10).alias("line_start"), F.col("p_size").alias("line_end"))
    files = rows.groupBy("path").agg((F.max("line_end") - 1).alias("lines"))
    return knowledge.valid_sources(rows, files).select("p_partkey", "valid")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'succeeded' ELSE 'running' END AS status, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 4 END AS attempts, CASE WHEN o_orderstatus = 'F' THEN 77 ELSE 5 END AS run_after FROM orders")
def dead_jobs_retried(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "dead").when(F.col("o_orderstatus") == "O", "succeeded").otherwise("running")
    jobs = table(spark, d, "orders").select("o_orderkey", status.alias("status"), F.lit(4).alias("attempts"), F.lit(5).alias("run_after"))
    return ev.retry_dead(jobs, 77)


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS batch FROM nation")
def migration_history(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    first = dml.History(names.filter("n_nationkey % 2 = 0").select("name", F.lit(1).alias("batch")))
    return first.ran(names).ran(names).rolled_back().ran(names).listed()


@query("SELECT user_id, event_type, CASE WHEN event_type = 'error' THEN '1' END AS note, value FROM events UNION ALL SELECT DISTINCT user_id, 'added', NULL, NULL FROM events")
def inserted_rows(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.when(F.col("event_type") == "error", "1").alias("note"), "value")
    return dml.insert(rows, rows.select("user_id", F.lit("added").alias("event_type")).distinct())


@query("SELECT l_orderkey, CASE WHEN avg(l_discount) > 0.06 THEN 1 WHEN avg(l_tax) > 0.05 THEN -1 ELSE 0 END AS step FROM lineitem GROUP BY l_orderkey")
def scale_steps(spark, d):
    rates = aggregates.means_in_order(tables.placed(table(spark, d, "lineitem")), ["l_orderkey"], ["_file", "_row"], a="l_discount", b="l_tax")
    return rates.select("l_orderkey", ev.scale_step(F.when(F.col("a") > 0.06, 0.31).otherwise(0.3), F.when(F.col("b") > 0.05, 0.71).otherwise(0.7)).alias("step"))
