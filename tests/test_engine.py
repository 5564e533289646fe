"""The engine's parts on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import scalars, validate
from quern.operators import aggregates, dml, knowledge, reconcile, retrieval
from quern.plans import expressions, paging, predicates, relations, scope
from quern.plans.predicates import Where
from quern.sources import io, tables
from quern.streaming import events as ev


def values(df, *columns):
    return [tuple(r) if len(r) > 1 else r[0] for r in (df.select(*columns) if columns else df).collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_identifiers():
    assert tables.identifier("a_1") == "a_1"
    for bad in ("", "1a", "a b", "a;--", "x" * 64):
        with pytest.raises(ValueError):
            tables.identifier(bad)


def test_find_by_id_is_tenant_safe(spark):
    df = rows(spark, [(1, 7), (2, 8)], "id long, tenant long")
    assert values(tables.find_by_id(df, "id", 2, ("tenant", 8))) == [(2, 8)]
    assert values(tables.find_by_id(df, "id", 2, ("tenant", 7))) == []


def test_predicates(spark):
    df = rows(spark, [(1, "客户A", 10001), (2, "客户B", 10001), (3, "测试", 20002), (4, "50%", None)], "id long, name string, app long")
    assert values(predicates.find_by(df, [Where("app", "eq", 10001)]), "id") == [1, 2]
    assert values(predicates.find_by(df, predicates.contains("name", " 客户A ")), "id") == [1]
    assert values(predicates.find_by(df, predicates.contains("name", "%")), "id") == [4]
    assert values(predicates.find_by(df, [Where("id", "in", [])]), "id") == [] == values(predicates.find_by(df, [Where("id", "not_in", [])]), "id")
    assert values(predicates.find_by(df, [], [Where("id", "eq", 1), Where("app", "null")]), "id") == [1, 4]
    assert predicates.optional("x", "eq", " ") == [] == predicates.optional("x", "eq", None)
    tags = rows(spark, [(1, ["a", "b"]), (2, ["a"])], "id long, tags array<string>")
    assert values(tags.filter(predicates.has_all("tags", ["a", "b"])), "id") == [1]
    assert predicates.sampled(df, F.lit(False), 0, df.columns[0]).count() == 0 and predicates.sampled(df, F.lit(False), 1, df.columns[0]).count() == 4


def test_paging(spark):
    df = rows(spark, [(k, f"item_{k}", 10 * k) for k in range(1, 101)], "id long, name string, score long")
    assert [r.id for r in paging.page(df, [F.asc("id")], 0, 20).collect()] == list(range(1, 21))
    assert paging.page(df, [F.asc("id")], 10, 100).count() == 0
    assert {r.total for r in paging.page_with_total(df, [F.desc("id")], 2, 10).collect()} == {100}
    assert values(paging.listing(rows(spark, [(1, None), (2, -1), (3, 0)], "id long, sort int"), "sort", "id", export=True, limit=2), "id") == [2, 1]


def test_scopes(spark):
    edges = rows(spark, [(5, 6), (5, 7), (6, 8), (1, 2), (2, 1)], "parent long, child long")
    ids = rows(spark, [(5,), (1,)], "id long")
    assert sorted(values(scope.closure(edges, ids))) == [(1, 1), (1, 2), (5, 5), (5, 6), (5, 7), (5, 8)]
    assert sorted(r.node for r in edges.createOrReplaceTempView("edges_") or spark.sql(scope.closure_sql("edges_", "1")).collect()) == [1, 2]
    df = rows(spark, [(1, 5, 10), (2, 8, 11), (3, 9, 10)], "id long, dept long, owner long")
    see = lambda **k: sorted(values(scope.data_scope(df, user=10, department=5, **k), "id"))
    assert see(mode="all") == [1, 2, 3] == see(mode="dept", field="dept", is_super=True)
    assert see(mode="dept", field="dept") == [1] and see(mode="dept_and_sub", field="dept", edges=edges) == [1, 2] and see(mode="self", field="owner") == [1, 3]
    assert see(mode="custom", custom=lambda u, d: [F.col("id") > 1]) == [2, 3]
    for bad, code in (({"mode": "dept"}, "DATA_SCOPE_INVALID_RULE"), ({"mode": "custom", "custom": lambda u, d: []}, "DATA_SCOPE_UNSAFE_CUSTOM"), ({"mode": "nope", "field": "dept"}, "DATA_SCOPE_INVALID_RULE")):
        with pytest.raises(scope.ScopeError) as e:
            see(**bad)
        assert e.value.code == code
    dated = rows(spark, [(1, None), (2, "x")], "id long, deleted_at string")
    assert [values(scope.alive(dated, "deleted_at", w), "id") for w in ("alive", "trashed", "all")] == [[1], [2], [1, 2]]
    with pytest.raises(Exception, match="another tenant"):
        scope.stamped(rows(spark, [(8,)], "t long"), "t", 7).collect()
    assert values(scope.stamped(rows(spark, [(0,), (7,), (None,)], "t long"), "t", 7)) == [7, 7, 7]


def test_relation_names():
    assert [relations.snake(x) for x in ("User", "OrderItem", "URL", "HTTPServer", "plain")] == ["user", "order_item", "u_r_l", "h_t_t_p_server", "plain"]
    assert relations.foreign_key("app::model::OrderItem") == "order_item_id"
    assert relations.junction("User", "Role") == "user_role" and relations.junction("Role", "User") == "role_user"
    assert relations.nested("a.b.c") == ("a", "b.c") and relations.nested("a") == ("a", None)


def test_polymorphic_groups(spark):
    df = rows(spark, [("Post", 1), ("Post", 2), ("Video", 1), ("Post", 3), (None, 9), ("Post", None)], "commentable_type string, commentable_id long")
    assert {r.type: r.ids for r in relations.morph_groups(df, "commentable_type", "commentable_id").collect()} == {"Post": ["1", "2", "3"], "Video": ["1"]}


def test_aggregates(spark):
    deals = rows(spark, [(1, "won", 5.0), (2, "won", 7.0), (3, "other", 1.0)], "id long, stage string, amount double")
    assert values(aggregates.completed(deals, "stage", ["initial", "won"], total="amount")) == [("initial", 0, 0.0), ("won", 2, 12.0)]
    assert [r.bucket for r in aggregates.histogram(deals, "amount", [1, 6]).collect()] == [1, 2, 3]
    assert one(spark, aggregates.ratio(F.lit(1), F.lit(0))) == 0.0
    votes = lambda *s: tuple(rows(spark, [(x,) for x in s], "s string").agg(*aggregates.approval("s")).first())
    assert votes("completed", "rejected") == ("Rejected", "Completed") and votes("completed", "pending") == ("InProgress", "Completed")
    assert votes("completed", "completed") == ("Completed", "Completed") and votes("rejected", "rejected") == ("Rejected", "Rejected")
    numbers = rows(spark, [(float(k),) for k in range(1, 101)], "v double")
    assert tuple(aggregates.nearest_index(numbers, "v", [50, 95, 99]).first()) == (51.0, 96.0, 100.0)


def test_reconcile(spark):
    existing = rows(spark, [(1, 0), (2, 0), (3, 1)], "id long, gone int")
    actions = reconcile.merge_actions(existing, rows(spark, [(1,), (9,)], "id long"), "id", "gone")
    assert dict(values(actions)) == {1: "update", 2: "delete", 3: "unchanged", 9: "insert"}
    left = rows(spark, [(1, "me"), (2, "me"), (3, "me"), (4, "me")], "k long, who string")
    found = rows(spark, [(1, "other", 10), (2, None, 20), (3, None, 30), (3, "me", 31)], "k long, owner string, item long")
    assert {r.k: (r.outcome, r.free) for r in reconcile.checked(left, found, ["k"], "owner", "who", "item").collect()} == {1: ("claimed", []), 2: ("single", [20]), 3: ("several", [30, 31]), 4: ("unmatched", [])}
    a, b = rows(spark, [("g", 1), ("g", 2), ("h", 3)], "g string, a long"), rows(spark, [("g", 8), ("g", 9), ("h", 7), ("h", 6)], "g string, b long")
    assert sorted(values(reconcile.pair_up(a, b, ["g"], "a", "b"), "a", "b")) == [(1, 8), (2, 9)]


def test_dml(spark):
    df = rows(spark, [(1, 1, "a"), (2, 1, "b")], "id long, version int, v string")
    out = dml.update_if_version(df, rows(spark, [(1, 1, "x"), (2, 9, "y")], "id long, version int, v string"), "id", "version")
    assert sorted(values(out)) == [(1, 2, "x"), (2, 1, "b")]
    with pytest.raises(ValueError):
        dml.delete(df, None)
    store = dml.Versions(rows(spark, [], "k string, version int, v string"), ["k"]).add(rows(spark, [("a", "1")], "k string, v string"))
    store = store.update(rows(spark, [("a", "2")], "k string, v string"))
    assert values(store.latest()) == [("a", 2, "2")] and [r.version for r in store.history().collect()] == [2, 1]
    for wrong in (lambda: store.add(rows(spark, [("a", "3")], "k string, v string")), lambda: store.update(rows(spark, [("b", "3")], "k string, v string"))):
        with pytest.raises(Exception, match="key"):
            wrong().rows.collect()
    assert dml.next_batch(rows(spark, [], "batch int")).first()[0] == 1
    merged = dml.insert_deduplicated(rows(spark, [("a", "x", 1)], "k string, d string, n int"), rows(spark, [("a", "x", 2), ("a", None, 3), ("a", None, 4), ("b", "y", 5), ("b", "y", 6)], "k string, d string, n int"), ["k", "d"], "n")
    assert sorted(r.n for r in merged.collect()) == [1, 3, 4, 5]


def test_bm25(spark):
    docs = rows(spark, [("doc1", "Rust programming language memory safety"), ("doc2", "Python scripting language"), ("doc3", "Rust Cargo package manager"), ("doc4", "")], "id string, text string")
    found = retrieval.bm25(docs, "id", "text", "Rust", 5).collect()
    assert {r.id for r in found} == {"doc1", "doc3"} and found[0].id == "doc3"
    assert retrieval.bm25(docs, "id", "text", "", 5).count() == 0 == retrieval.bm25(docs, "id", "text", "Rust", 0).count()
    index, stats = retrieval.postings(docs, "id", "text")
    assert stats.first()["n"] == 4 and index.filter("term = 'rust'").count() == 2
    assert retrieval.replace_documents(index, "id", removed=docs.filter("id = 'doc1'")).filter("term = 'rust'").count() == 1


def test_vectors_and_context(spark):
    sim = lambda a, b, m: one(spark, retrieval.similarity(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)), m))
    assert sim([1.0, 0.0], [0.0, 0.0], "cosine") == 0 and sim([3.0, 4.0, 9.0], [3.0, 4.0], "dot") == 25 and sim([0.0, 0.0], [3.0, 4.0], "l2") == -5
    hits = rows(spark, [("short", 0.95, "ab"), ("long", 0.2, "abcdefghijklmnopqrstuvwxyz")], "id string, score double, text string")
    assert [r.id for r in retrieval.rerank(hits, "id", "score", "text", 2, 0.3).collect()] == ["long", "short"]
    assert [r.id for r in retrieval.rerank(hits, "id", "score", "text", 2, 1.0).collect()] == ["short", "long"]
    assert retrieval.assemble(hits, [F.desc("score")], "text", 3).first()[0] == "[1] ab\n\n"
    assert one(spark, retrieval.pseudo_embedding(F.lit("aé"), 5)) == [97 / 255, 195 / 255, 169 / 255, 0.0, 0.0]
    talk = rows(spark, [(1, k, role, "x" * 40) for k, role in enumerate(["system", "user", "assistant", "user"])], "c int, t int, role string, text string")
    assert [r.t for r in retrieval.truncate(talk, "c", "t", "role", "text", 30).orderBy("t").collect()] == [0, 2, 3]
    assert [r.t for r in retrieval.truncate(talk, "c", "t", "role", "text", 1).orderBy("t").collect()] == [0, 3]


def test_knowledge(spark):
    terms = rows(spark, [("称重", "按重量计价", ["散称"]), ("其他", "无关", [])], "name string, definition string, aliases array<string>")
    assert values(knowledge.search_terms(terms, "散称商品"), "name") == ["称重"]
    assert one(spark, knowledge.redact(F.lit("password = 'hunter2' and Bearer " + "a.b-" * 6))) == "***REDACTED*** and ***REDACTED***"
    assert one(spark, knowledge.fuzzy(F.lit("a"), F.lit("ab"))) is False
    text = "use x;\n\nfn one() {\n}\nstruct Two;\n" + "y" * 300
    got = list(knowledge.chunk_text(text, 200))
    assert [c[2] for c in got] == ["Other", "Function", "Struct"] and [c[:2] for c in got] == [(0, 2), (3, 4), (5, 6)] and "".join(c[3] for c in got) == text + "\n"
    assert list(knowledge.chunk_text("  \n\n", 200)) == []


def test_expressions(spark):
    context = rows(spark, [('{"amount":200,"name":"test","flag":true,"nested":{"value":50},"none":null}',)], "c string")
    guard = lambda e: context.select(expressions.guard(e, "c")).first()[0]
    assert guard("$.amount > 100") and not guard("$.nested.value > 60") and not guard("not $.flag == true") and guard("$.flag")
    assert guard("$.amount > 300 or $.name == 'test' and $.none == null") and not guard("$.name == 1")
    for bad in ("upper($.name)", "$.amount >", "($.flag", "'a' > 'b'", "$.flag ;", "1"):
        with pytest.raises(expressions.ExpressionError):
            guard(bad)
    with pytest.raises(Exception, match="unknown path"):
        guard("$.missing == 1")
    t = lambda e, **n: one(spark, expressions.template(e, {k: F.lit(v) for k, v in n.items()}))
    assert t("a eq 1.0", a="1") and not t("a heq 1.0", a="1") and t("a lt 1", a="x") and t("a || b", a="", b="y") and t("!a", a="0")


def test_scalars(spark):
    f = lambda c: one(spark, c)
    assert f(scalars.sql_template(F.lit("SELECT 'a' FROM t WHERE x = 1.5 AND y = 'open"))) == "SELECT ? FROM t WHERE x = ? AND y = ?"
    assert f(scalars.parse_ids(F.lit("[1, \"2\", x, 3]"))) == [1, 2, 3] and f(scalars.csv_ids(F.lit("1,0,b,2"))) == [1, 2]
    assert [f(scalars.is_numeric(F.lit(x))) for x in ("12", "12 ", "1e3", "", "x")] == [True, False, True, False, False]
    assert f(scalars.money_digits(F.lit("12.5"))) == list("伍零贰壹") and f(scalars.money_digits(F.lit("1.2.3"))) is None
    assert [f(scalars.pluralize(F.lit(x))) for x in ("city", "bus", "item")] == ["cities", "bus", "items"]
    assert f(scalars.pascal(F.lit("order_item"))) == "OrderItem" and f(scalars.camel(F.lit("order_item"))) == "orderItem" and f(scalars.kebab(F.lit("OrderItem"))) == "order-item"
    assert f(scalars.loose_equal(F.lit("1.0"), F.lit("1"))) and f(scalars.loose_compare(F.lit("b"), F.lit("10"))) == 1
    assert f(scalars.query_params(F.lit("a=1&b=x%20y&c"))) == {"a": "1", "b": "x y", "c": ""}
    assert f(scalars.parse_timestamp(F.lit("86400"))).isoformat() == "1970-01-02T00:00:00" and f(scalars.parse_timestamp(F.lit("nope"))) is None
    assert [f(scalars.backoff_ms(F.lit(n), 2.0, 60.0)) for n in (0, 3, 9)] == [2000, 16000, 60000]
    assert [f(scalars.json_type(F.lit(x))) for x in ("1", "1.5", '"a"', "[]", "{}", "true", "null")] == ["integer", "number", "string", "array", "object", "boolean", "null"]


def test_validation(spark):
    df = rows(spark, [("", "x", "5", "2024-01-02"), ("ab", "a@b.co", "50", "bad")], "name string, mail string, n string, day string")
    rules = {"name": "require|alpha", "mail": "email", "n": "integer|between:1,10", "day": "date"}
    assert [r.failures for r in validate.validated(df, rules).collect()] == [["name:require", "mail:email"], ["n:between", "day:date"]]
    assert [r.failures for r in validate.validated(df, rules, batch=False, scene=["mail", "n"]).collect()] == [["mail:email"], ["n:between"]]
    assert validate.parse_rules("between:1,2|regex:^a|b,c$") == [("between", ["1", "2"]), ("regex", ["^a|b,c$"])]
    items = rows(spark, [([(1, 2)],), ([(1, -2)],)], "items array<struct<a int, b int>>")
    assert values(items.select(validate.non_negative("items", "a", "b"))) == [True, False]


def test_csv_and_json(spark, tmp_path):
    line = lambda *v: one(spark, io.csv_line(*map(F.lit, v)))
    assert [line("hello", "world"), line("hello,world", "ok"), line('hello"world'), line("line1\nline2"), line("", "")] == ["hello,world", '"hello,world",ok', '"hello""world"', '"line1\nline2"', ","]
    io.write_csv(rows(spark, [(1, "a,b")], "id long, v string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "﻿id,v\n1,\"a,b\"\n"
    assert io.row_json(rows(spark, [(float("nan"), bytearray(b"\x0a"), None)], "x double, b binary, n string")).first()[0] == '{"x":null,"b":"0a","n":null}'
    assert io.json_documents(spark, str(tmp_path / "missing.json"), "a int").count() == 0
    (tmp_path / "log.jsonl").write_text('{"a":1}\nbroken\n{"a":2}\n')
    assert sorted(values(io.json_lines(spark, str(tmp_path / "log.jsonl"), "a int", strict=False))) == [1, 2]
    with pytest.raises(Exception):
        io.json_lines(spark, str(tmp_path / "log.jsonl"), "a int").collect()
    assert io.cell_place("B12") == (11, 1) and io.cell_place("AA1") == (0, 26)
    assert tables.conforms({"a": 1}, {"required": ["a", "b"], "properties": {"a": {"type": "number"}}}) == ["missing b"]


def test_repeated_queries(spark):
    log = rows(spark, [("users", 0)] + [("orders", 100 * k) for k in range(1, 7)], "template string, ms long")
    assert values(ev.n_plus_one(log, "template", "ms", 5, 1000)) == [("orders", 6, 500)]


def replica_alert(times, least, window):
    for t in sorted({t for t in times if t is not None}):
        inside = [x for x in times if x is not None and t <= x <= t + window]
        if len(inside) >= least:
            return len(times), max(inside) - t
    return (None, None) if times.count(None) >= least else None


def test_repeated_queries_of_a_hot_template(spark):
    times = {"edge": [9, 12, 19, 30, 35, 40], "ties": [-7, -7, -7, 3, 4], "late": [0, 11, 22, *range(100, 900)], "dense": [*range(-300, 300), None], None: [5, 5, 16, 15, 25], "untimed": [None] * 4 + [1], "few": [1, 2, None, None]}
    log = rows(spark, [(k, t) for k, v in times.items() for t in v], "template string, ms long").repartition(3)
    for least, window in ((3, 10), (4, 10), (3, 0), (1, 5), (5, 21)):
        found = ev.n_plus_one(log, "template", "ms", least, window)
        want = {k: replica_alert(v, least, window) for k, v in times.items()}
        assert {r.template: (r["count"], r.span_us) for r in found.collect()} == {k: v for k, v in want.items() if v}
    # No frame is counted through for each record, and what a task sorts of a stretch of time is cut before it is shuffled.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame" not in plan and "WindowGroupLimit" in plan


def replica_limiter(times, most, window):
    kept, out = [], []
    for t in times:
        kept = [x for x in kept if x > t - window]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out


def test_limiters_and_breaker(spark):
    times = [0, 10, 20, 30, 105, 111, 400, 401, 402, 403]
    df = rows(spark, [("k", t, n) for n, t in enumerate(times)], "key string, us long, id int")
    got = [r.accepted for r in ev.folded(df, "key", "us", "id", ev.sliding_window(3, 100)).orderBy("id").collect()]
    assert got == replica_limiter(times, 3, 100)
    bucket = [r.accepted for r in ev.folded(df, "key", "us", "id", ev.token_bucket(2, 1e4)).orderBy("id").collect()]
    assert bucket[:3] == [True, True, False] and bucket[6:9] == [True, True, False]
    calls = rows(spark, [("k", t, n, f) for n, (t, f) in enumerate([(0, False), (1, True), (2, True), (3, False), (60, False), (61, False), (62, True)])], "key string, us long, id int, failed boolean")
    states = [r.state for r in ev.folded(calls, "key", "us", "id", ev.circuit_breaker(100, 0.6, 50, 2), ("failed",)).orderBy("id").collect()]
    assert states == ["closed", "closed", "open", "open", "half_open", "closed", "open"]


def test_burn_rates(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts, id % 2 = 0 AS bad FROM range(10)")
    got = ev.burn_rates(df, "ts", F.col("bad"), 0.99).collect()
    assert len(got) == 2 and all(r.page and r.ticket and r.budget_left == 0 for r in got)
    assert ev.burn_rates(df, "ts", F.lit(False), 0.99).first()["budget_left"] == 1.0


def test_queue(spark):
    jobs = rows(spark, [(1, "running", 1, 0, 100, 0), (2, "pending", 0, 0, None, 1), (3, "pending", 0, 9999, None, 2)], "id long, status string, attempts int, run_after long, locked_until long, created_at long")
    assert dict(values(ev.reclaimed(jobs, 150, 60), "id", "status"))[1] == "running"
    again = ev.reclaimed(jobs, 161, 60)
    assert dict(values(again, "id", "status"))[1] == "pending"
    assert [(r.id, r.attempts) for r in ev.claimed(again, 161, 60, 5).collect()] == [(1, 2), (2, 1)]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    times = [0, 10, 20, 30, 105, 111]
    (folder / "a.json").write_text("\n".join(f'{{"key":"k","us":{t},"id":{n},"ts":"2024-01-01T00:0{n}:00"}}' for n, t in enumerate(times)))
    schema = "key string, us long, id int, ts timestamp"
    stream = ev.stream_limiter(io.message_stream(spark, str(folder), schema), "key", "us", "id", 3, 100)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.accepted for r in spark.table("limited").orderBy("id").collect()] == replica_limiter(times, 3, 100)
    burn = ev.stream_burn(io.message_stream(spark, str(folder), schema), "ts", F.col("id") > 3)
    q = burn.writeStream.format("memory").queryName("burnt").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.bad, r.all) for r in spark.table("burnt").collect()) == [(1, 1), (1, 5)]
    assert math.isclose(one(spark, ev.scale_step(F.lit(0.4), F.lit(0.9))), 1)
