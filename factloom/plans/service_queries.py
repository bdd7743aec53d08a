"""Queries of the catalog: filters, pages, aggregates, changes, comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from factloom.operators import catalog, diff, service
from factloom.plans.inputs import query, t


@query("SELECT doc_id, lang, source, (SELECT count(*) FROM documents WHERE lang = 'en' AND contains(lower(source), 'src1')) AS total FROM documents WHERE lang = 'en' AND contains(lower(source), 'src1') ORDER BY doc_id LIMIT 20 OFFSET 20")
def c11_e27_document_query(spark, sf):
    d = service.matching(t(spark, sf, "documents").select("doc_id", "lang", "source"), {"lang": "en", "status": None}, "SRC1", ["source"])
    return service.counted_page(d, ["doc_id"], 2, 20)


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), '12') ORDER BY c_name, c_custkey LIMIT 10")
def c12_c13_search(spark, sf):
    return service.matching(t(spark, sf, "customer"), None, "12", ["c_name", "c_mktsegment"]).orderBy("c_name", "c_custkey").limit(10).select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '1-URGENT' AND contains(CAST(o_custkey AS VARCHAR), '7')")
def c14_c15_client_filter(spark, sf):
    o = t(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status")
    return catalog.chosen_documents(o, {"o_orderpriority": "1-URGENT", "o_clerk": None}, ("O", "P"), {"o_custkey": "7"}).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END IS NULL")
def c16_unread(spark, sf):
    e = t(spark, sf, "events").withColumn("read_at", F.when(F.col("event_id") % 3 != 0, F.col("ts")))
    return catalog.unread(e, F.col("event_type") == "click").select("event_id")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def c18_d27_membership(spark, sf):
    n = t(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return service.members(t(spark, sf, "supplier"), n, "s_nationkey").select("s_suppkey", "s_name")


@query("""SELECT c_custkey, 'name' AS k, CAST(1 + c_custkey % 2 AS BIGINT) AS n FROM customer""")
def c17_secret_redaction(spark, sf):
    m = F.create_map(F.lit("name"), F.col("c_name"), F.concat(F.lit("token"), F.col("c_custkey") % 2), F.lit("x"))
    safe = catalog.without_secrets(m, ("token0",))
    return t(spark, sf, "customer").select("c_custkey", F.array_sort(F.map_keys(safe))[0].alias("k"), F.size(safe).cast("long").alias("n"))


@query("SELECT event_id, last IS NULL OR epoch_us(ts) - epoch_us(last) >= 60000000 AS due FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)")
def c19_throttle(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, sf, "events").withColumn("last", F.lag("ts").over(w)).select("event_id", service.throttle(F.col("last"), F.col("ts"), 60).alias("due"))


@query("SELECT 'f' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.cpp' WHEN 1 THEN '.h' WHEN 2 THEN '.hpp' ELSE '.txt' END AS file, p_partkey % 4 IN (1, 2) AS is_header, p_partkey % 4 = 0 AS is_tu FROM part")
def c20_file_kinds(spark, sf):
    k = F.col("p_partkey") % 4
    f = t(spark, sf, "part").select(F.concat(F.lit("f"), "p_partkey", F.when(k == 0, ".cpp").when(k == 1, ".h").when(k == 2, ".hpp").otherwise(".txt")).alias("file"))
    return f.select("file", catalog.is_header(F.col("file")).alias("is_header"), catalog.is_unit(F.col("file")).alias("is_tu"))


@query("SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE lower(replace(n_name, ' ', '-')) IN (SELECT lower(replace(n_name, ' ', '-')) FROM nation WHERE n_regionkey < 2)")
def c05_c06_component_filter(spark, sf):
    n = t(spark, sf, "nation")
    layers = n.select(F.concat(F.lit("Layer "), "n_regionkey").alias("layer"), F.col("n_name").alias("component"))
    allowed = catalog.components_in(layers, "layer 0").unionByName(catalog.components_in(layers, "LAYER-1"))
    s = t(spark, sf, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    return catalog.of_components(s, "n_name", allowed).select("s_suppkey")


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_size % 2 = 1 AND p_brand IN (SELECT p_brand FROM part WHERE p_size = 1)")
def c01_c07_visible_rows(spark, sf):
    p = t(spark, sf, "part").withColumn("file", F.concat("p_partkey", F.when(F.col("p_partkey") % 3 == 0, ".cpp").otherwise(".cc"))).withColumn("hidden", F.col("p_size") % 2 == 0)
    return service.visible(p, "file", "hidden", (".cpp",), p.where("p_size = 1").select("p_brand"), "p_brand").select("p_partkey")


@query("SELECT l_orderkey, l_partkey, p.p_brand NOT IN ('Brand#1', 'Brand#2') OR p.p_brand <> q.p_brand AS external FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1) l JOIN part p ON p.p_partkey = l_partkey JOIN part q ON q.p_partkey = l_orderkey")
def c08_external_unit(spark, sf):
    p = t(spark, sf, "part")
    li = t(spark, sf, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_partkey").distinct()
    x = li.join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("b")), "l_partkey").join(p.select(F.col("p_partkey").alias("l_orderkey"), F.col("p_brand").alias("own")), "l_orderkey")
    return x.select("l_orderkey", "l_partkey", catalog.is_external(F.col("b"), F.col("own"), ["Brand#1", "Brand#2"]).alias("external"))


@query("""SELECT p_partkey FROM part WHERE NOT (p_size % 4 = 0 AND p_size % 3 = 0)""")
def c10_include_guards(spark, sf):
    s = F.col("p_size")
    d = t(spark, sf, "part").select("p_partkey", F.concat(F.lit("FILE"), s, F.when(s % 3 == 0, "_H_").otherwise("_HIGH")).alias("name"), F.when(s % 4 == 0, " ").otherwise("1").alias("value"))
    return catalog.without_guards(d).select("p_partkey")


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'draft') AS draft FROM orders GROUP BY o_custkey")
def e07_status_counts(spark, sf):
    return service.status_counts(t(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "draft"])


@query("SELECT lang, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS done, count(*) FILTER (WHERE toxic = 1) AS hidden FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def e08_e09_review_progress(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels"), "doc_id")
    return service.review_progress(d, ["lang"], F.col("quality") == 1, F.col("toxic") == 1)


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS calls, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem GROUP BY 1, 2) SELECT * FROM g UNION ALL SELECT 'TOTAL', 'TOTAL', CAST(sum(calls) AS BIGINT), CAST(sum(l_linenumber) AS BIGINT) FROM g HAVING count(*) > 1""")
def e12_usage_totals(spark, sf):
    return service.totals_row(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_linenumber"])


@query("SELECT o_custkey, arg_max(o_orderkey, epoch(o_orderdate)::BIGINT * 10000000 + o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def e13_latest(spark, sf):
    return service.latest(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT layer, CASE layer WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END AS place, n, percent FROM (SELECT coalesce(nullif(lang, ''), 'Other') AS layer, count(*) AS n, CAST(floor(100.0 * count(*) FILTER (WHERE n_chars > 1000) / count(*) + 0.5) AS BIGINT) AS percent FROM documents GROUP BY 1)""")
def e22_e23_groups(spark, sf):
    d = t(spark, sf, "documents").withColumnRenamed("lang", "layer")
    long = catalog.in_order(d.where("n_chars > 1000"), "layer", ["fr", "en"], "Other").select("layer", F.col("n").alias("long"))
    out = catalog.in_order(d, "layer", ["fr", "en"], "Other").join(long, "layer", "left")
    return out.select("layer", "place", "n", catalog.percentage(F.coalesce("long", F.lit(0)), F.col("n")).alias("percent"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0) THEN 'approved' ELSE o_orderstatus END AS status FROM orders")
def e24_w05_bulk_update(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    chosen = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(True).alias("hit"))
    x = o.join(chosen, "o_orderkey", "left")
    return service.update_where(x, F.col("hit") & (F.col("status") == "O"), {"status": F.lit("approved")}).select("o_orderkey", "status")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def h01_h02_paging(spark, sf):
    return service.page(t(spark, sf, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 3, 50).select("o_orderkey")


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def h03_h06_sorted_sections(spark, sf):
    return service.in_order(t(spark, sf, "conversations"), ["conv_id"], "turn", "role", ">", "roles")


@query("SELECT o_orderkey, c_name, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY c_custkey) AS INTEGER) AS place FROM orders JOIN customer ON c_custkey IN (o_custkey, o_custkey + 1)")
def d26_assignees(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("ids"))
    return service.assignees(o, "ids", t(spark, sf, "customer").select("c_custkey", "c_name"), "o_orderkey", "c_custkey").select("o_orderkey", "c_name", "place")


@query("SELECT o.o_orderkey, v.tag, coalesce(o.o_orderkey = (SELECT max(o_orderkey) FROM orders), false) AS is_current FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS tag FROM lineitem GROUP BY l_orderkey) v ON v.l_orderkey = o.o_orderkey")
def d28_commits_with_tags(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey")
    tags = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("tag"))
    return service.commits_with_tags(o, tags, o.agg(F.max("o_orderkey").alias("o_orderkey")), "o_orderkey", "tag")


@query("""WITH v AS (SELECT o_custkey AS project, max(o_orderkey) AS version, count(*) AS n_versions FROM orders GROUP BY 1), s AS (SELECT l_orderkey AS version, count(*) AS n_documents, count(*) FILTER (WHERE l_returnflag = 'R') AS n_approved FROM lineitem GROUP BY 1),
j AS (SELECT user_id AS project, max(event_id) AS job FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT c_custkey AS project, version, n_versions, n_documents, n_approved, job FROM customer LEFT JOIN v ON project = c_custkey LEFT JOIN s USING (version) LEFT JOIN j ON j.project = c_custkey""")
def d29_dashboard(spark, sf):
    o, e = t(spark, sf, "orders"), t(spark, sf, "events")
    versions = o.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("version"), F.col("o_orderkey").alias("created_at"))
    docs = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("version"), F.when(F.col("l_returnflag") == "R", "approved").otherwise("draft").alias("status"))
    jobs = e.select(F.col("user_id").alias("project"), F.col("event_id").alias("job"), F.col("event_id").alias("started_at"), F.when(F.col("event_type") == "error", "cancelled").otherwise("done").alias("state"))
    return service.dashboard(t(spark, sf, "customer").select(F.col("c_custkey").alias("project")), versions, docs, jobs)


DOCS = """l AS (SELECT doc_id, lang, text FROM documents WHERE doc_id % 7 <> 0), r AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN text || ' x' ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0)"""


def _docs(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang", "text")
    return d.where("doc_id % 7 <> 0"), d.where("doc_id % 9 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")))


@query(f"""WITH {DOCS}, a AS (SELECT lang, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS fp FROM l WHERE lang <> 'fr' GROUP BY lang), b AS (SELECT lang, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS fp FROM r WHERE lang <> 'de' GROUP BY lang)
SELECT lang, CASE WHEN a.fp IS NULL THEN 'added' WHEN b.fp IS NULL THEN 'removed' WHEN a.fp = b.fp THEN 'unchanged' ELSE 'changed' END AS diff_type FROM a FULL JOIN b USING (lang)""")
def d30_compare_groups(spark, sf):
    fp = lambda df: diff.group_fingerprints(df, ["lang"], ["doc_id", "text"])
    a, b = _docs(spark, sf)
    return diff.sections(fp(a.where("lang <> 'fr'")), fp(b.where("lang <> 'de'")), "lang", "fp")


@query(f"WITH {DOCS} SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'added' WHEN r.doc_id IS NULL THEN 'removed' ELSE 'unchanged' END AS diff_type FROM l FULL JOIN r ON l.doc_id = r.doc_id")
def d31_compare_without_snapshots(spark, sf):
    a, b = _docs(spark, sf)
    return diff.sections(a.withColumn("v", F.lit(1)), b.withColumn("v", F.lit(1)), "doc_id", "v")


@query(f"WITH {DOCS} SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL AND r.doc_id IS NOT NULL AND l.text = r.text AND l.lang = r.lang THEN 'unchanged' ELSE 'changed' END AS diff_type FROM l FULL JOIN r ON l.doc_id = r.doc_id")
def d32_d33_j07_changed_sections(spark, sf):
    a, b = (x.select("doc_id", diff.json_fingerprint("lang", "text").alias("fp")) for x in _docs(spark, sf))
    return diff.sections_flat(a, b, "doc_id", "fp")


CONV = """a AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ordinal, text FROM conversations WHERE turn % 5 <> 3),
b AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ordinal, CASE WHEN conv_id % 3 = 0 THEN text || ' more' ELSE text END AS text FROM conversations WHERE turn % 7 <> 2),
x AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.role, b.role) AS role, CAST(coalesce(a.ordinal, b.ordinal) AS INTEGER) AS ordinal, CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed' WHEN a.text = b.text THEN 'unchanged' ELSE 'changed' END AS diff_type
  FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.role = b.role AND a.ordinal = b.ordinal)"""


def _conv(spark, sf):
    c = t(spark, sf, "conversations")
    return c.where("turn % 5 <> 3"), c.where("turn % 7 <> 2").withColumn("text", F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))


@query(f"WITH {CONV} SELECT conv_id, role, ordinal, diff_type FROM x")
def d34_f03_block_alignment(spark, sf):
    return diff.align_blocks(*_conv(spark, sf), ["conv_id"], "role", ["turn"], "text").select("conv_id", "role", "ordinal", "diff_type")


@query(f"WITH {CONV} SELECT conv_id, count(*) FILTER (WHERE diff_type = 'added') AS added, count(*) FILTER (WHERE diff_type = 'changed') AS changed, count(*) FILTER (WHERE diff_type = 'removed') AS removed, count(*) FILTER (WHERE diff_type = 'unchanged') AS unchanged FROM x GROUP BY conv_id")
def m02_x12_render_diff_summary(spark, sf):
    return diff.summary(diff.render_diff(*_conv(spark, sf), ["conv_id"], "role", ["turn"], "text"), ["conv_id"])


@query()
def m01_word_segments(spark, sf):
    d = diff.render_diff(*_conv(spark, sf), ["conv_id"], "role", ["turn"], "text")
    return d.select("conv_id", "role", "ordinal", F.to_json("segments").alias("segments"))


@query("""WITH a AS (SELECT l_orderkey AS g, CAST(l_partkey AS VARCHAR) AS k, CAST(l_suppkey AS VARCHAR) AS c, l_orderkey * 10 + l_linenumber AS o FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) WHERE l_linenumber % 4 <> 0),
last AS (SELECT g, k, arg_max(c, o) AS c FROM a GROUP BY g, k), b AS (SELECT l_orderkey AS g, CAST(l_partkey AS VARCHAR) AS k, CASE WHEN l_linenumber = 2 THEN 'x' ELSE CAST(l_suppkey AS VARCHAR) END AS c, l_orderkey * 10 + l_linenumber AS o FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) WHERE l_linenumber % 5 <> 0)
SELECT b.g, b.k, b.o AS ord, CASE WHEN last.c IS NULL THEN 'added,added' WHEN last.c = b.c THEN 'same,same' ELSE 'same,changed' END AS marks, CASE WHEN last.c IS NULL THEN 'added' WHEN last.c = b.c THEN 'unchanged' ELSE 'changed' END AS diff_type FROM b LEFT JOIN last ON last.g = b.g AND last.k = b.k
UNION ALL SELECT g, k, NULL, 'removed,removed', 'removed' FROM last WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.g = last.g AND b.k = last.k)""")
def d35_table_diff(spark, sf):
    x = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    rows = x.select(F.col("l_orderkey").alias("g"), "l_linenumber", F.col("p").cast("string").alias("p"), F.col("s").cast("string").alias("s"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    a = rows.where("l_linenumber % 4 <> 0").select("g", F.array("p", "s").alias("cells"), "o")
    b = rows.where("l_linenumber % 5 <> 0").select("g", F.array("p", F.when(F.col("l_linenumber") == 2, "x").otherwise(F.col("s"))).alias("cells"), "o")
    return diff.table_rows(a, b, "g", "cells", "o").select("g", "k", "ord", F.array_join("marks", ",").alias("marks"), "diff_type")


@query("SELECT conv_id, sha256(string_agg(regexp_replace(coalesce(text, ''), '(/assets/|https?://)[^ \\t\\n\\r]+', '', 'g'), chr(10) ORDER BY turn)) AS fp FROM conversations GROUP BY conv_id")
def m03_m04_document_fingerprint(spark, sf):
    return diff.document_fingerprint(t(spark, sf, "conversations"), "conv_id", "turn", "text")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 6 = 0")
def d45_w02_insert_missing(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return service.insert_missing(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N")), ["o_orderkey"])


@query("SELECT o_orderkey AS doc_id, r_regionkey AS user_id FROM orders, region UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus = 'F'")
def d46_w06_batch_assign(spark, sf):
    o, r = t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus"), t(spark, sf, "region").select(F.col("r_regionkey").alias("user_id"))
    return service.all_pairs_assign(o.where("o_orderstatus = 'F'").select("doc_id", F.lit(0).cast("long").alias("user_id")), o, r)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 6 <> 0 UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 6 = 0")
def w01_w03_w04_upsert_delete(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    put = service.upsert(o, o.where("o_orderkey % 6 = 0").withColumn("o_orderstatus", F.lit("N")), ["o_orderkey"])
    return service.delete(put, o.where("o_orderkey % 4 = 0 and o_orderkey % 6 <> 0").select("o_orderkey"), ["o_orderkey"])


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 AND user_id = 5 THEN 1 WHEN event_id % 3 = 0 THEN NULL ELSE 0 END AS read_at FROM events")
def w07_mark_read(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, 0).alias("read_at"))
    return service.update_where(e, F.col("read_at").isNull() & (F.col("user_id") == 5), {"read_at": F.lit(1)}).drop("user_id")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 50 = 0) UNION ALL SELECT DISTINCT l_orderkey, -1 FROM lineitem WHERE l_orderkey % 50 = 0")
def w08_replace_partition(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    fresh = li.where("l_orderkey % 50 = 0").select("l_orderkey").distinct().withColumn("l_partkey", F.lit(-1).cast("long"))
    return service.replace_partition(li, fresh, "l_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey = 3 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal <= 0 AND c_nationkey = 3 AND c_custkey % 2 = 0")
def w09_members(spark, sf):
    c = t(spark, sf, "customer").where("c_nationkey = 3").select("c_custkey", F.when(F.col("c_acctbal") > 0, "active").otherwise("pending").alias("state"))
    pending = service.delete(c.where("state = 'pending'"), c.where("c_custkey % 2 <> 0").select("c_custkey"), ["c_custkey"])
    return c.where("state = 'active'").unionByName(pending).select("c_custkey")


@query("""SELECT n_name AS component, 'graph TD' || chr(10) || string_agg('  U' || s_suppkey || '[' || s_name || ']', chr(10) ORDER BY s_suppkey) AS mermaid FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def w13_w15_mermaid_text(spark, sf):
    s = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    line = F.concat(F.lit("  U"), "s_suppkey", F.lit("["), "s_name", F.lit("]"))
    m = s.groupBy(F.col("n_name").alias("component")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("l")))).alias("m"))
    return m.select("component", F.concat(F.lit("graph TD\n"), F.array_join(F.transform("m", lambda x: x["l"]), "\n")).alias("mermaid"))


@query("SELECT DISTINCT p_brand || '/' || p_size AS path FROM part")
def w20_component_paths(spark, sf):
    from factloom.operators.derive import first_wins

    p = t(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("path"), "p_partkey")
    return first_wins(p, ["path"], ["p_partkey"]).select("path")


@query("SELECT user_id, count(*) AS n_lines, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END) AS phase, greatest(1, CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT)) AS duration, (4 - max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END)) * 120 AS eta FROM events GROUP BY user_id")
def n02_phase_state(spark, sf):
    from factloom.streaming.progress import job_state

    return job_state(t(spark, sf, "events"), "user_id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500")
def n01_log_cursor(spark, sf):
    from factloom.streaming.progress import read_log

    return read_log(spark, t(spark, sf, "events").select("event_id", "user_id", "event_type"), f"{sf}/events.parquet", 500)


PHASE_SQL = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END"


@query(f"""WITH e AS (SELECT user_id, event_id, ts, event_type, {PHASE_SQL} AS p FROM events),
o AS (SELECT *, coalesce(max(p) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT user_id, count(*) AS n_lines, CAST(max(p) AS INTEGER) AS phase, arg_max(event_type || ' ' || event_id, (ts, event_id)) AS activity,
  array_to_string([coalesce(min(epoch_us(ts)) FILTER (WHERE p = k AND p > before), -1) for k in [1, 2, 3, 4]], ',') AS began FROM o GROUP BY user_id""".replace(
    "array_to_string([coalesce(min(epoch_us(ts)) FILTER (WHERE p = k AND p > before), -1) for k in [1, 2, 3, 4]], ',')",
    " || ',' || ".join(f"CAST(coalesce(min(epoch_us(ts)) FILTER (WHERE p = {k} AND p > before), -1) AS VARCHAR)" for k in (1, 2, 3, 4))))
def n02_job_phases(spark, sf):
    """The log in three parts, tracked by three calls of one job: each goes on where the last one stopped."""
    from factloom.scratch import shared_dir
    from factloom.sources.tables import StoredTable
    from factloom.streaming import progress

    name = f"phases-{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/{name}"
    e = t(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", F.concat_ws(" ", "event_type", "event_id").alias("activity"))
    low, high = e.agg(F.expr("percentile_approx(ts, array(0.33, 0.66))")).first()[0]
    table = StoredTable(spark, f"{folder}/jobs", f"user_id {e.schema['user_id'].dataType.simpleString()}, {progress.STATE}", "user_id")
    for part in (e.where(F.col("ts") <= F.lit(low)), e.where((F.col("ts") > F.lit(low)) & (F.col("ts") <= F.lit(high))), e.where(F.col("ts") > F.lit(high))):
        part.write.mode("append").parquet(f"{folder}/log")
        done = progress.track_jobs(spark, progress.stream_log(spark, e.schema, f"{folder}/log"), name, table, job="user_id")
    return done.select("user_id", "n_lines", "phase", "activity", F.array_join(F.col("began").cast("array<string>"), ",").alias("began"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 = 2")
def n01_log_resumed(spark, sf):
    """What a second call of a job finds: only the lines that came after the first."""
    from factloom.scratch import shared_dir
    from factloom.streaming import progress

    job = f"resumed-{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/{job}"
    e = t(spark, sf, "events").select("event_id", "user_id")
    e.where("event_id % 3 <> 2").write.parquet(f"{folder}/log")
    stream = progress.stream_log(spark, e.schema, f"{folder}/log")
    progress.follow(spark, stream, job)
    e.where("event_id % 3 = 2").write.mode("append").parquet(f"{folder}/log")
    return progress.follow(spark, stream, job)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 97 <> 5 AND c_custkey % 89 <> 7 THEN upper(c_name) END AS answer,
  CASE WHEN c_custkey % 97 = 5 THEN 'ValueError: refused' WHEN c_custkey % 89 = 7 THEN 'no answer' END AS reason FROM customer""")
def x10_halving(spark, sf):
    """A provider that fails on a whole batch for one row in it, and has no answer to others: only those rows are lost."""
    from factloom.extensions import enrich_halving

    def provider(prompts):
        keys = [int(p.rpartition("#")[2]) for p in prompts]
        if any(k % 97 == 5 for k in keys):
            raise ValueError("refused")
        return [" " if k % 89 == 7 else p.upper() for k, p in zip(keys, [p.rpartition(" ")[0] for p in prompts], strict=True)]

    c = t(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" #"), "c_custkey").alias("prompt"))
    out = enrich_halving(c, "prompt", provider)
    return out.select("c_custkey", F.when(F.col("reason").isNull(), F.col("answer")).alias("answer"), "reason")
