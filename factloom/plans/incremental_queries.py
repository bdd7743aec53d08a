"""Queries of the incremental engine: change classes, impact, reuse, merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import graph, incremental as inc
from factloom.plans.inputs import ACCESS, ACYCLIC, CALLS, FUNCTIONS, PAIRS, SNAP, VERSIONS, access, calls, drop_files, functions, pairs, query, snapshots, t, versions


@query(f"WITH {SNAP} SELECT key, status FROM status")
def d07_version_diff(spark, sf):
    return inc.classify(*snapshots(spark, sf))


@query(f"WITH {SNAP} SELECT status, count(*) AS n FROM status GROUP BY status")
def e14_diff_summary(spark, sf):
    return inc.classify(*snapshots(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'c|u|n|int' WHEN 1 THEN 'c|u|n' WHEN 2 THEN 'M' || o_orderkey || '@f.h' ELSE 'ns::T' END AS key,
  CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'new' END AS status FROM orders)
SELECT status, CASE WHEN key LIKE '%@%' AND key NOT LIKE '%|%' THEN 'macro' WHEN len(string_split(key, '|')) > 3 THEN 'function' WHEN len(string_split(key, '|')) = 3 THEN 'global' ELSE 'type' END AS kind, count(*) AS n FROM k GROUP BY 1, 2""")
def e05_c23_counts_by_kind(spark, sf):
    o = t(spark, sf, "orders")
    m = F.col("o_orderkey") % 4
    key = F.when(m == 0, "c|u|n|int").when(m == 1, "c|u|n").when(m == 2, F.concat(F.lit("M"), "o_orderkey", F.lit("@f.h"))).otherwise("ns::T")
    return inc.bucket_counts(o.select(key.alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "changed").otherwise("new").alias("status")))


def _seeds(spark, sf):
    return functions(spark, sf).where("fid = 40 or size = 7 and fid % 50 = 7").select(F.col("fid").alias("key"))


SEEDS = "seeds AS (SELECT fid FROM functions WHERE fid = 40 OR size = 7 AND fid % 50 = 7)"
REACH = "reach AS (SELECT fid FROM seeds UNION SELECT c.caller FROM calls c JOIN reach r ON c.callee = r.fid)"


@query(f"WITH RECURSIVE {FUNCTIONS}, {CALLS}, {SEEDS}, {REACH} SELECT fid FROM reach")
def g01_impact_set(spark, sf):
    f = functions(spark, sf).select("fid")
    none = f.limit(0).select(F.col("fid").alias("key"), "fid")
    return inc.impact_set(_seeds(spark, sf), f, calls(spark, sf), none)


PLAN_STATUS = f"""{FUNCTIONS}, {CALLS},
b AS (SELECT fid, md5(name || '|' || size) AS hash FROM functions WHERE fid % 171 <> 0),
f AS (SELECT fid, md5(name || '|' || (size + CASE WHEN fid % 200 = 3 THEN 1 ELSE 0 END)) AS hash FROM functions WHERE fid % 190 <> 0),
st AS (SELECT coalesce(b.fid, f.fid) AS key, CASE WHEN b.fid IS NULL THEN 'new' WHEN f.fid IS NULL THEN 'deleted' WHEN b.hash = f.hash THEN 'unchanged' ELSE 'changed' END AS status FROM b FULL JOIN f ON b.fid = f.fid),
seeds AS (SELECT key AS fid FROM st WHERE status IN ('changed', 'new') UNION SELECT c.caller FROM calls c JOIN st ON st.key = c.callee AND st.status = 'deleted' JOIN f ON f.fid = c.caller)"""


def _plan(spark, sf):
    p = functions(spark, sf)
    b = p.where("fid % 171 <> 0").select(F.col("fid").alias("key"), F.md5(F.concat_ws("|", "name", "size")).alias("hash"))
    f = p.where("fid % 190 <> 0").select(F.col("fid").alias("key"), F.md5(F.concat_ws("|", "name", F.col("size") + F.when(F.col("fid") % 200 == 3, 1).otherwise(0))).alias("hash"))
    c, present = calls(spark, sf), f.select(F.col("key").alias("fid"))
    none = present.limit(0).select(F.col("fid").alias("key"), "fid")
    return inc.plan_incremental(inc.classify(b, f), present, c, c, none)


@query(f"WITH RECURSIVE {PLAN_STATUS}, {REACH} SELECT f.fid, CASE WHEN r.fid IS NULL THEN 'reuse' ELSE 'regenerate' END AS action FROM f LEFT JOIN (SELECT DISTINCT fid FROM reach) r ON f.fid = r.fid")
def g07_incremental_plan(spark, sf):
    return _plan(spark, sf)


@query(f"""WITH RECURSIVE {PLAN_STATUS}, {REACH}, plan AS (SELECT f.fid, r.fid IS NOT NULL AS hit FROM f LEFT JOIN (SELECT DISTINCT fid FROM reach) r ON f.fid = r.fid)
SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS regenerated, count(*) FILTER (WHERE NOT hit) AS reused, CAST(100 * count(*) FILTER (WHERE NOT hit) // greatest(count(*), 1) AS BIGINT) AS percent_reused FROM plan""")
def e06_reuse_report(spark, sf):
    return inc.reuse_report(_plan(spark, sf))


@query(f"""WITH RECURSIVE {FUNCTIONS}, {CALLS}, {ACCESS}, {SEEDS}, {REACH}
SELECT gid FROM (SELECT s_suppkey AS gid FROM supplier WHERE s_suppkey % 50 = 1 UNION SELECT a.gid FROM access a JOIN (SELECT DISTINCT fid FROM reach) r ON a.fid = r.fid) WHERE gid IN (SELECT s_suppkey FROM supplier)""")
def e19_impacted_globals(spark, sf):
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("gid"))
    status = s.select(F.col("gid").alias("key"), F.when(F.col("gid") % 50 == 1, "changed").otherwise("unchanged").alias("status"))
    return inc.impacted_globals(status, s, access(spark, sf), g01_impact_set(spark, sf))


@query(f"WITH RECURSIVE {FUNCTIONS}, {CALLS}, {SEEDS}, {REACH} SELECT DISTINCT file FROM functions JOIN reach USING (fid)")
def e20_impacted_files(spark, sf):
    return inc.files_of(g01_impact_set(spark, sf), functions(spark, sf).select("fid", "file"))


@query(f"""WITH {SNAP} SELECT key FROM status WHERE status <> 'deleted' EXCEPT SELECT key FROM status WHERE status IN ('changed', 'new')""")
def i02_reuse_set(spark, sf):
    s = inc.classify(*snapshots(spark, sf))
    return s.where("status <> 'deleted'").select("key").subtract(s.where("status in ('changed', 'new')").select("key"))


@query(f"""WITH {SNAP} SELECT key FROM (SELECT key FROM base INTERSECT SELECT key FROM target) UNION ALL SELECT key FROM (SELECT key FROM target EXCEPT SELECT key FROM base)""")
def i01_key_sets(spark, sf):
    b, g = (x.select("key") for x in snapshots(spark, sf))
    return b.intersect(g).unionByName(g.subtract(b))


@query(f"""WITH {SNAP} SELECT key FROM status WHERE status IN ('changed', 'new') AND key IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) AND key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)""")
def i03_direct_set(spark, sf):
    s, o = inc.classify(*snapshots(spark, sf)), t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    own = s.where("status = 'changed'").select("key").union(s.where("status = 'new'").select("key"))
    return own.join(o.where("key % 2 = 0"), "key", "left_semi").join(o.where("key % 5 = 0"), "key", "left_anti")


@query("""SELECT t.o_orderkey, coalesce(nullif(b.o_orderpriority, ''), t.note) AS note FROM (SELECT o_orderkey, 'none' AS note FROM orders WHERE o_orderkey % 13 <> 0) t
LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0) b USING (o_orderkey)""")
def d08_carry_forward(spark, sf):
    o = t(spark, sf, "orders")
    target = o.where("o_orderkey % 13 <> 0").select("o_orderkey", F.lit("none").alias("note"))
    base = o.where("o_orderkey % 11 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("note"))
    return inc.carry_forward(target, base, "o_orderkey", ["note"])


def _customer_fp(spark, sf, where="true"):
    o = t(spark, sf, "orders")
    h = t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.md5("c_mktsegment").alias("hash"))
    oh = o.select(F.concat(F.lit("o"), "o_orderkey").alias("key"), F.md5(F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("hash"))
    deps = o.where(where).select(F.concat(F.lit("c"), "o_custkey").alias("key"), F.concat(F.lit("o"), "o_orderkey").alias("dep"))
    return inc.fingerprints(h.unionByName(oh), deps).where("key like 'c%'")


def _fp_sql(name: str, where: str) -> str:
    return f"""{name} AS (SELECT 'c' || c_custkey AS key, sha256(md5(c_mktsegment) || coalesce(chr(31) || string_agg(h, chr(31) ORDER BY h), '')) AS fp FROM customer
  LEFT JOIN (SELECT o_custkey, md5(o_orderstatus || '|' || o_orderpriority) AS h FROM orders WHERE {where}) ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment)"""


@query(f"WITH {_fp_sql('a', 'true')} SELECT key, fp FROM a")
def l03_dependency_fingerprint(spark, sf):
    return _customer_fp(spark, sf)


@query("SELECT o_custkey, sha256(string_agg(md5(o_orderpriority), chr(31) ORDER BY o_orderkey)) AS fp FROM orders GROUP BY o_custkey")
def l03b_parse_fingerprint(spark, sf):
    return inc.parse_fingerprint(t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.md5("o_orderpriority").alias("h")), "o_custkey", "o_orderkey", "h")


@query(f"""WITH {_fp_sql('a', 'true')}, {_fp_sql('b', 'o_orderkey % 9 <> 0')}, idx AS (SELECT fp, min(key) AS key FROM b GROUP BY fp)
SELECT a.key, 'v1' AS version, idx.key AS source_key, 'p' || idx.key AS payload FROM a JOIN idx USING (fp)""")
def d09_cross_version_reuse(spark, sf):
    old = _customer_fp(spark, sf, "o_orderkey % 9 <> 0").withColumn("version", F.lit("v1"))
    index = inc.index_put(old.limit(0).select("fp", "version", "key"), old)
    rows = old.select("version", "key", F.concat(F.lit("p"), "key").alias("payload"))
    return inc.reuse_from_index(_customer_fp(spark, sf), index, rows, "v2")


@query(f"""WITH {_fp_sql('a', 'true')}, {_fp_sql('b', 'o_orderkey % 9 <> 0')}, i AS (SELECT fp, 'v1' AS version, min(key) AS key FROM b GROUP BY fp)
SELECT * FROM i UNION ALL SELECT fp, 'v2', min(key) FROM a WHERE fp NOT IN (SELECT fp FROM i) GROUP BY fp""")
def l04_reuse_index(spark, sf):
    old = _customer_fp(spark, sf, "o_orderkey % 9 <> 0").withColumn("version", F.lit("v1"))
    index = inc.index_put(old.limit(0).select("fp", "version", "key"), old)
    return inc.index_put(index, _customer_fp(spark, sf).withColumn("version", F.lit("v2")))


@query("""SELECT p_partkey, sha256(array_to_string(string_split(p_name, ' '), chr(31))) AS th, sha256('c' || chr(31) || array_to_string(string_split(p_name, ' '), chr(31))) AS ch,
  sha256(array_to_string(string_split(p_type, ' '), chr(31))) AS mh FROM part""")
def l01_l02_token_hashes(spark, sf):
    words = F.split("p_name", " ")
    messy = F.concat(F.lit("  "), F.replace("p_type", F.lit(" "), F.lit("  \\\n\t")), F.lit(" "))
    return t(spark, sf, "part").select("p_partkey", inc.token_hash(words).alias("th"), inc.token_hash(words, F.lit("c")).alias("ch"), inc.macro_hash(messy).alias("mh"))


@query("""WITH c AS (SELECT c_custkey AS key, substr(sha256(c_name), 1, 16) AS hash, 1 AS version, c_mktsegment AS value FROM customer WHERE c_custkey % 3 <> 0),
w AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'stale' ELSE substr(sha256(c_name), 1, 16) END AS hash, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS version FROM customer)
SELECT w.key, w.hash, w.version, c.value IS NOT NULL AS hit, c.value FROM w LEFT JOIN c USING (key, hash, version)""")
def l05_entity_cache(spark, sf):
    c = t(spark, sf, "customer")
    h = F.substring(F.sha2("c_name", 256), 1, 16)
    cache = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), h.alias("hash"), F.lit(1).alias("version"), F.col("c_mktsegment").alias("value"))
    wanted = c.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 5 == 0, "stale").otherwise(h).alias("hash"), F.when(F.col("c_custkey") % 7 == 0, 2).otherwise(1).alias("version"))
    return inc.cache_lookup(wanted, cache)


@query("""SELECT DISTINCT l_orderkey AS tu FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 7 UNION SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_orderkey WHERE p_size = 7""")
def d10_affected_tus(spark, sf):
    inc_rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tu"), F.col("l_partkey").alias("inc"))
    return inc.affected_tus(inc_rows, t(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("file")))


@query("""SELECT 'p' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.cpp' ELSE '.h' END AS file FROM part WHERE p_size = 7 AND p_partkey % 2 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)""")
def d11_new_tus(spark, sf):
    name = lambda c: F.concat(F.lit("p"), c, F.when(F.col(c) % 2 == 0, ".cpp").otherwise(".h"))
    changed = t(spark, sf, "part").where("p_size = 7").select(name("p_partkey").alias("file"))
    return inc.new_tus(changed, t(spark, sf, "lineitem").where("l_linenumber = 1").select(name("l_partkey").alias("tu")).distinct())


MERGED = """kept AS (SELECT fid, file, hash FROM vbase WHERE file NOT IN (SELECT file FROM vdrop)),
merged AS (SELECT * FROM kept UNION ALL SELECT fid, file, hash FROM vfresh WHERE file IN (SELECT file FROM vdrop) AND fid NOT IN (SELECT fid FROM kept))"""


@query(f"WITH {FUNCTIONS}, {VERSIONS}, {MERGED} SELECT fid, file, hash FROM merged")
def d12_merge_by_file(spark, sf):
    base, fresh = versions(spark, sf)
    return inc.merge_by_file(base, fresh, drop_files(spark, sf), "fid")


@query(f"""WITH {FUNCTIONS}, {VERSIONS}, {ACCESS}, e AS (SELECT 'type' AS axis, gid AS key, fid FROM access), gone AS (SELECT fid FROM functions WHERE file IN (SELECT file FROM vdrop))
SELECT DISTINCT axis, key, fid FROM (SELECT * FROM e WHERE key % 2 = 0 AND fid NOT IN (SELECT fid FROM gone) UNION ALL SELECT * FROM e WHERE key % 3 = 0 AND fid IN (SELECT fid FROM gone)) WHERE fid IN (SELECT fid FROM functions WHERE fid % 17 <> 0)""")
def d13_merge_edges(spark, sf):
    f, e = functions(spark, sf), access(spark, sf).select(F.lit("type").alias("axis"), F.col("gid").alias("key"), "fid")
    return inc.merge_edges(e.where("key % 2 = 0"), e.where("key % 3 = 0"), f.select("fid", "file"), drop_files(spark, sf), f.where("fid % 17 <> 0").select("fid"))


@query(f"""WITH {FUNCTIONS}, {VERSIONS}, {PAIRS}, gone AS (SELECT fid FROM functions WHERE file IN (SELECT file FROM vdrop))
SELECT DISTINCT ov, base FROM (SELECT * FROM pairs WHERE ov % 2 = 0 AND ov NOT IN (SELECT fid FROM gone) UNION ALL SELECT * FROM pairs WHERE ov IN (SELECT fid FROM gone))""")
def d14_merge_override_pairs(spark, sf):
    p = pairs(spark, sf)
    return inc.merge_override_pairs(p.where("ov % 2 = 0"), p, functions(spark, sf).select("fid", "file"), drop_files(spark, sf))


FAMILY = """family AS (SELECT base AS fam, base AS node FROM pairs UNION SELECT base, ov FROM pairs),
member AS (SELECT fam, node FROM family WHERE fam IN (SELECT fam FROM family GROUP BY fam HAVING count(*) >= 2))"""


@query(f"""WITH {CALLS}, {PAIRS}, {FAMILY} SELECT caller, callee FROM calls UNION SELECT c.caller, m2.node FROM calls c JOIN member m1 ON c.callee = m1.node JOIN member m2 ON m1.fam = m2.fam""")
def g03_virtual_families(spark, sf):
    return graph.spread_families(calls(spark, sf), pairs(spark, sf), functions(spark, sf).select("fid"))


@query(f"""WITH {CALLS}, {PAIRS}, k AS (SELECT p_partkey AS fid FROM part WHERE p_partkey % 23 <> 0), sound AS (SELECT caller, callee FROM calls WHERE caller IN (SELECT fid FROM k) AND callee IN (SELECT fid FROM k)),
f0 AS (SELECT base AS fam, base AS node FROM pairs UNION SELECT base, ov FROM pairs), family AS (SELECT fam, node FROM f0 WHERE node IN (SELECT fid FROM k)),
member AS (SELECT fam, node FROM family WHERE fam IN (SELECT fam FROM family GROUP BY fam HAVING count(*) >= 2))
SELECT caller, callee FROM sound UNION SELECT c.caller, m2.node FROM sound c JOIN member m1 ON c.callee = m1.node JOIN member m2 ON m1.fam = m2.fam""")
def d15_recompute_calls(spark, sf):
    return inc.recompute_calls(calls(spark, sf), pairs(spark, sf), functions(spark, sf).where("fid % 23 <> 0").select("fid"))


@query(f"""WITH {CALLS}, k AS (SELECT p_partkey AS fid FROM part), o AS (SELECT caller AS fid, string_agg(callee, ',' ORDER BY callee) AS calls_ids FROM calls GROUP BY 1), i AS (SELECT callee AS fid, string_agg(caller, ',' ORDER BY caller) AS called_by_ids FROM calls GROUP BY 1)
SELECT fid, coalesce(calls_ids, '') AS calls_ids, coalesce(called_by_ids, '') AS called_by_ids FROM k LEFT JOIN o USING (fid) LEFT JOIN i USING (fid)""")
def d01_call_adjacency(spark, sf):
    out = inc.adjacency(calls(spark, sf), functions(spark, sf).select("fid"))
    return out.select("fid", F.array_join(F.col("calls_ids").cast("array<string>"), ",").alias("calls_ids"), F.array_join(F.col("called_by_ids").cast("array<string>"), ",").alias("called_by_ids"))


def _models(spark, sf):
    (b, f), c, p = versions(spark, sf), calls(spark, sf), pairs(spark, sf)
    return ({"functions": b, "calls": c.where("caller % 17 <> 0"), "override_pairs": p}, {"functions": f, "calls": c.where("caller % 19 <> 0"), "override_pairs": p.where("ov % 2 = 0")})


@query(f"""WITH {FUNCTIONS}, {VERSIONS}, {MERGED}, {CALLS}, {PAIRS}, gone AS (SELECT fid FROM functions WHERE file IN (SELECT file FROM vdrop)),
mc AS (SELECT * FROM calls WHERE caller % 17 <> 0 AND caller NOT IN (SELECT fid FROM gone) UNION ALL SELECT * FROM calls WHERE caller % 19 <> 0 AND caller IN (SELECT fid FROM gone)),
mp AS (SELECT DISTINCT * FROM (SELECT * FROM pairs WHERE ov NOT IN (SELECT fid FROM gone) UNION ALL SELECT * FROM pairs WHERE ov % 2 = 0 AND ov IN (SELECT fid FROM gone))),
sound AS (SELECT DISTINCT caller, callee FROM mc WHERE caller IN (SELECT fid FROM merged) AND callee IN (SELECT fid FROM merged)),
f0 AS (SELECT base AS fam, base AS node FROM mp UNION SELECT base, ov FROM mp), family AS (SELECT fam, node FROM f0 WHERE node IN (SELECT fid FROM merged)),
member AS (SELECT fam, node FROM family WHERE fam IN (SELECT fam FROM family GROUP BY fam HAVING count(*) >= 2))
SELECT caller, callee FROM sound UNION SELECT c.caller, m2.node FROM sound c JOIN member m1 ON c.callee = m1.node JOIN member m2 ON m1.fam = m2.fam""")
def d16_merge_model(spark, sf):
    return inc.merge_model(*_models(spark, sf), drop_files(spark, sf))["calls"]


@query(f"""WITH {FUNCTIONS}, {VERSIONS} SELECT fid, what FROM (SELECT coalesce(a.fid, b.fid) AS fid, CASE WHEN a.fid IS NULL THEN 'only right' WHEN b.fid IS NULL THEN 'only left' WHEN a.hash <> b.hash THEN 'differs' END AS what FROM vbase a FULL JOIN vfresh b ON a.fid = b.fid) WHERE what IS NOT NULL ORDER BY fid LIMIT 50""")
def d17_diff_models(spark, sf):
    return inc.diff_models(*versions(spark, sf), "fid", ["hash"])


@query("""WITH n AS (SELECT o_orderkey AS name FROM orders WHERE o_orderkey % 13 <> 0), f AS (SELECT o_orderkey AS name, 'f' || o_orderkey AS payload, o_orderkey AS ord FROM orders WHERE o_orderkey % 7 = 0),
c AS (SELECT o_orderkey AS name, 'c' || o_orderkey AS payload, o_orderkey AS ord FROM orders WHERE o_orderkey % 5 = 0), b AS (SELECT o_orderkey AS name, 'b' || o_orderkey AS payload, -o_orderkey AS ord FROM orders WHERE o_orderkey % 3 = 0)
SELECT name, CASE WHEN f.payload IS NOT NULL THEN 'fresh' WHEN c.payload IS NOT NULL THEN 'cross' ELSE 'base' END AS source, coalesce(f.payload, c.payload, b.payload) AS payload, b.ord IS NULL AS appended, coalesce(b.ord, f.ord, c.ord) AS place
FROM n LEFT JOIN f USING (name) LEFT JOIN c USING (name) LEFT JOIN b USING (name) WHERE coalesce(f.payload, c.payload, b.payload) IS NOT NULL""")
def d21_flowchart_splice(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("name"))
    side = lambda m, p, s: o.where(f"name % {m} = 0").select("name", F.concat(F.lit(p), "name").alias("payload"), (F.col("name") * s).alias("ord"))
    out = inc.splice(side(7, "f", 1), side(5, "c", 1), side(3, "b", -1), o.where("name % 13 <> 0"))
    return out.select("name", "source", "payload", F.col("place.col1").alias("appended"), F.col("place.col2").alias("place"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'no include closure' WHEN p_size % 7 = 0 THEN 'header added' WHEN p_size % 11 = 0 THEN 'header deleted' WHEN p_brand <> 'Brand#1' THEN 'parse settings differ' END AS reason FROM part""")
def g16_reparse_gate(spark, sf):
    s = F.col("p_size")
    return t(spark, sf, "part").select("p_partkey", inc.full_reparse_reason(s % 5 != 0, s % 7 == 0, s % 11 == 0, F.lit("Brand#1"), F.col("p_brand")).alias("reason"))


@query("""SELECT user_id, arg_min(event_id, (abs(CAST(round(value * 100) AS BIGINT) - 5000), event_id)) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def d37_g17_nearest_ancestor(spark, sf):
    e = t(spark, sf, "events").where("event_type <> 'error'").withColumn("distance", F.abs(F.round(F.col("value") * 100).cast("long") - 5000))
    return inc.nearest_ancestor(e, "user_id", "event_id", "distance", "event_id")


@query(f"""WITH {ACCESS} SELECT gid, string_agg(fid, ',' ORDER BY fid) AS users FROM (SELECT DISTINCT gid, fid FROM access) GROUP BY gid""")
def e03_e04_inverted_use(spark, sf):
    a = access(spark, sf).select("gid", "fid").distinct()
    return a.groupBy("gid").agg(F.array_join(F.array_sort(F.collect_set("fid")).cast("array<string>"), ",").alias("users"))


# ---- graph ----------------------------------------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {CALLS}, b AS (SELECT CAST(40 AS BIGINT) AS node, 0 AS level UNION SELECT c.callee, b.level + 1 FROM b JOIN calls c ON c.caller = b.node WHERE b.level < 4) SELECT node, min(level) AS level FROM b GROUP BY node""")
def g02_bounded_bfs(spark, sf):
    return graph.bounded_bfs(calls(spark, sf), spark.range(40, 41).select(F.col("id").alias("node")), 4, "caller", "callee")


@query(f"""WITH RECURSIVE {CALLS}, f AS (SELECT DISTINCT l_partkey AS fid, l_suppkey AS gid FROM lineitem), r AS (SELECT fid, gid FROM f UNION SELECT c.caller, r.gid FROM calls c JOIN r ON c.callee = r.fid) SELECT fid, gid FROM r""")
def g04_transitive_access(spark, sf):
    facts = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("fid"), F.col("l_suppkey").alias("gid"))
    return graph.propagate_facts(calls(spark, sf), facts, ("gid",))


@query(f"""WITH RECURSIVE {ACYCLIC}, e AS (SELECT * FROM calls WHERE caller <> callee), l AS (SELECT p_partkey AS node, 0 AS level FROM part UNION SELECT e.caller, l.level + 1 FROM e JOIN l ON e.callee = l.node) SELECT node, max(level) AS level FROM l GROUP BY node""")
def g05_topological_levels(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    e = p.where("node % 5 <> 0").selectExpr("node AS src", "node div 2 AS dst")
    return graph.topological_levels(p, e)


@query(f"""WITH {FUNCTIONS}, {CALLS}, i AS (SELECT fid FROM functions WHERE size = 7), n AS (SELECT fid FROM i UNION SELECT caller FROM calls WHERE callee IN (SELECT fid FROM i) UNION SELECT callee FROM calls WHERE caller IN (SELECT fid FROM i)) SELECT DISTINCT unit FROM functions JOIN n USING (fid)""")
def g06_affected_units(spark, sf):
    f = functions(spark, sf)
    return graph.affected_units(f.where("size = 7").select("fid"), calls(spark, sf), f.select("fid", "unit"))


@query("""WITH RECURSIVE n AS (SELECT o_custkey % 50 AS fkey, o_orderkey AS node_id FROM orders), g AS (SELECT fkey, min(node_id) AS s, max(node_id) AS e FROM n GROUP BY fkey),
x AS (SELECT fkey, node_id, lag(node_id) OVER (PARTITION BY fkey ORDER BY node_id) AS prev FROM n),
e AS (SELECT fkey, prev AS source, node_id AS target FROM x WHERE prev IS NOT NULL AND node_id % 11 <> 0),
r AS (SELECT fkey, s AS node_id FROM g UNION SELECT e.fkey, e.target FROM e JOIN r ON e.fkey = r.fkey AND e.source = r.node_id)
SELECT n.fkey, 'unreachable' AS issue, CAST(n.node_id AS VARCHAR) AS node_id FROM n LEFT JOIN r USING (fkey, node_id) WHERE r.node_id IS NULL
UNION ALL SELECT n.fkey, 'empty label', CAST(node_id AS VARCHAR) FROM n JOIN g USING (fkey) WHERE node_id % 9 = 0 AND node_id <> s AND node_id <> e""")
def g08_validate_cfg(spark, sf):
    from pyspark.sql import Window

    n = t(spark, sf, "orders").selectExpr("o_custkey % 50 AS fkey", "o_orderkey AS node_id")
    g = n.groupBy("fkey").agg(F.min("node_id").alias("s"), F.max("node_id").alias("e"))
    nodes = n.join(g, "fkey").select("fkey", "node_id", F.when(F.col("node_id") == F.col("s"), "START").when(F.col("node_id") == F.col("e"), "END").otherwise("ACTION").alias("type"), F.when(F.col("node_id") % 9 == 0, " ").otherwise("x").alias("label"))
    x = n.withColumn("source", F.lag("node_id").over(Window.partitionBy("fkey").orderBy("node_id")))
    edges = x.where("source is not null and node_id % 11 <> 0").select("fkey", "source", F.col("node_id").alias("target"))
    return graph.validate_flow_graph(nodes, edges)


@query("""WITH RECURSIVE x AS (SELECT p_partkey AS id, CASE WHEN p_partkey < 4 THEN NULL ELSE p_partkey // 4 END AS parent FROM part), r AS (SELECT id, 0 AS depth FROM x WHERE parent IS NULL UNION ALL SELECT x.id, r.depth + 1 FROM x JOIN r ON x.parent = r.id) SELECT id, depth FROM r""")
def g13_tree_flatten(spark, sf):
    x = t(spark, sf, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey < 4 THEN NULL ELSE p_partkey div 4 END AS parent", "p_size AS ord")
    return graph.tree_order(x).select("id", "depth")


@query(f"""WITH {CALLS}, o AS (SELECT caller AS node, count(*) AS outs FROM calls GROUP BY 1), i AS (SELECT callee AS node, count(*) AS ins FROM calls GROUP BY 1) SELECT p_partkey AS node, coalesce(outs, 0) = 1 AND coalesce(ins, 0) = 1 AS linear FROM part LEFT JOIN o ON o.node = p_partkey LEFT JOIN i ON i.node = p_partkey""")
def g11_linear_chain(spark, sf):
    c = calls(spark, sf)
    o, i = c.groupBy(F.col("caller").alias("node")).agg(F.count("*").alias("outs")), c.groupBy(F.col("callee").alias("node")).agg(F.count("*").alias("ins"))
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    return p.join(o, "node", "left").join(i, "node", "left").select("node", (F.coalesce("outs", F.lit(0)) == 1).alias("a"), (F.coalesce("ins", F.lit(0)) == 1).alias("b")).select("node", F.expr("a and b").alias("linear"))
