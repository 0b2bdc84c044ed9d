"""Queries over the star schema: joins, aggregates, ranks, samples, set algebra, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringloom.operators import aggregates as agg
from ringloom.operators import joins, sampling, sets, tree, windows
from ringloom.plans.registry import query, table

LINE_TIES = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"]


@query("dist_rank_by_len", "SELECT l_linenumber, count(*) AS n, avg(l_quantity) AS mean, median(l_quantity) AS middle, count(*) FILTER (WHERE l_discount > 0.05) AS high, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def dist_rank_by_len(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.percentile("l_quantity", F.lit(0.5)).alias("middle"), F.count_if(F.col("l_discount") > 0.05).alias("high"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("quantiles_nearest", "SELECT o_orderstatus, quantile_disc(o_totalprice, 0.1) AS p10, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.9) AS p90, quantile_disc(o_totalprice, 0.99) AS p99 FROM orders GROUP BY 1")
def quantiles_nearest(spark, sf_dir):
    return agg.nearest_quantiles(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("part_minmax_delta", "SELECT l_orderkey, l_partkey, l_quantity, l_quantity - min(l_quantity) OVER w AS above_min, max(l_quantity) OVER w - l_quantity AS below_max FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def part_minmax_delta(spark, sf_dir):
    x = windows.group_extent(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity")
    return x.select("l_orderkey", "l_partkey", "l_quantity", F.col("l_quantity_above_min").alias("above_min"), F.col("l_quantity_below_max").alias("below_max"))


@query("group_argmax_row", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate) AS k FROM lineitem) WHERE k = 1")
def group_argmax_row(spark, sf_dir):
    return windows.best_row(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), *LINE_TIES]).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")


@query("rank_zero_based", "SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate) - 1 AS rank0 FROM lineitem")
def rank_zero_based(spark, sf_dir):
    return windows.rank_in_group(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_TIES, "rank0", 0).select("l_orderkey", "l_partkey", "rank0")


@query("value_counts", "SELECT size, count(*) AS groups FROM (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1) GROUP BY 1")
def value_counts(spark, sf_dir):
    return agg.value_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey"])


@query("semi_membership", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_membership(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("anti_uncovered", "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def anti_uncovered(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.remaining(table(spark, sf_dir, "orders"), lines, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("membership_flags", "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS returned, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) AS large FROM orders")
def membership_flags(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")  # noqa: E741
    out = joins.member(table(spark, sf_dir, "orders").select("o_orderkey"), l.where("l_returnflag = 'R'"), ["o_orderkey"], "returned")
    return joins.member(out, l.where("l_quantity >= 45"), ["o_orderkey"], "large")


@query("set_algebra", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48), b AS (SELECT p_partkey AS k FROM part WHERE p_size < 20) SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_b, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either")
def set_algebra(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("k"))
    b = table(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("k"))
    return sets.algebra(a, b, ["k"])


@query("venn_pivot", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS in_f, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS in_o, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS in_p FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O', 'P'))")
def venn_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    v = sets.venn({s.lower(): o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}, ["c_custkey"])
    return v.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query("cross_param_grid", "SELECT t.threshold, t.lazy, count(*) AS n, count(*) FILTER (WHERE l_quantity > t.threshold AND (NOT t.lazy OR l_discount > 0.02)) AS hits FROM lineitem CROSS JOIN (SELECT * FROM (VALUES (10), (25), (40)) a(threshold) CROSS JOIN (VALUES (true), (false)) b(lazy)) t GROUP BY 1, 2")
def cross_param_grid(spark, sf_dir):
    params = spark.createDataFrame([(t, z) for t in (10, 25, 40) for z in (True, False)], "threshold int, lazy boolean")
    hit = (F.col("l_quantity") > F.col("threshold")) & (~F.col("lazy") | (F.col("l_discount") > 0.02))
    return agg.parameter_grid(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount"), params, ["threshold", "lazy"], hit)


@query("override_left_coalesce", "SELECT d.doc_id, coalesce(l.quality, 1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def override_left_coalesce(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return joins.override(base, table(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"])


@query("nearest_theta", "SELECT c_custkey, arg_min(n_nationkey, (c_acctbal - n_nationkey * 400) * (c_acctbal - n_nationkey * 400) * 1000 + n_nationkey) AS nearest, min((c_acctbal - n_nationkey * 400) * (c_acctbal - n_nationkey * 400)) AS distance FROM customer CROSS JOIN nation GROUP BY 1")
def nearest_theta(spark, sf_dir):
    return joins.nearest(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), table(spark, sf_dir, "nation").select("n_nationkey"), lambda p: (F.col("c_acctbal") - p["n_nationkey"] * 400) * (F.col("c_acctbal") - p["n_nationkey"] * 400), "n_nationkey", ["c_custkey"], most=None)


@query("palette_join", "SELECT c_custkey, coalesce(n_name, 'none') AS n_name, coalesce(n_regionkey, -1) AS n_regionkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON c_nationkey = n_nationkey")
def palette_join(spark, sf_dir):
    few = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    return joins.lookup(table(spark, sf_dir, "customer"), few, F.col("c_nationkey") == F.col("n_nationkey"), {"n_name": "none", "n_regionkey": -1}).select("c_custkey", "n_name", "n_regionkey")


@query("first_member", "SELECT name, entry FROM (SELECT lower(p_name) AS name, p_partkey AS entry, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def first_member(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"), F.col("p_partkey").alias("entry"))
    return p.groupBy("name").agg(F.min("entry").alias("entry"))


@query("topk_count", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def topk_count(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("head_tail", "SELECT * FROM (SELECT 'top' AS part, user_id, count(*) AS n FROM events GROUP BY 2 ORDER BY n DESC, user_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'bottom' AS part, user_id, count(*) AS n FROM events GROUP BY 2 ORDER BY n, user_id LIMIT 5)")
def head_tail(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "user_id").limit(5).select(F.lit("top").alias("part"), "*").union(n.orderBy("n", "user_id").limit(5).select(F.lit("bottom").alias("part"), "*"))


@query("sample_k_seeded", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type = 'purchase' ORDER BY md5(event_id || '|42'), event_id) AS k FROM events) WHERE event_type = 'purchase' OR k <= 3")
def sample_k_seeded(spark, sf_dir):
    return sampling.k_per_group(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], 3, 42, F.col("event_type") == "purchase").select("event_id", "user_id", "event_type")


@query("group_folds", "SELECT fold, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, CAST(('0x' || substr(md5(user_id || '|0'), 1, 8)) AS BIGINT) % 5 AS fold FROM events) GROUP BY 1")
def group_folds(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", sampling.fold("user_id", 5).alias("fold"))
    return e.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("split_disjoint", "SELECT o_orderkey, CAST(('0x' || substr(md5(o_custkey || '|42'), 1, 8)) AS BIGINT) % 5 = 0 AS test FROM orders")
def split_disjoint(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (sampling.fold("o_custkey", 5, 42) == 0).alias("test"))


@query("first_n_groups", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) WHERE k <= 2")
def first_n_groups(spark, sf_dir):
    return windows.first_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber"], 2).select("l_orderkey", "l_linenumber", "l_partkey")


@query("conformance", "WITH f AS (SELECT l_orderkey, bool_and(l_quantity <= 45) AS a, bool_and(l_returnflag <> 'R') AS b, bool_and(l_discount < 0.09) AS c FROM lineitem GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (WHERE a) AS all_quantity, count(*) FILTER (WHERE b) AS all_unreturned, count(*) FILTER (WHERE c) AS all_discount FROM f")
def conformance(spark, sf_dir):
    return agg.conformance(table(spark, sf_dir, "lineitem"), ["l_orderkey"], {"quantity": F.col("l_quantity") <= 45, "unreturned": F.col("l_returnflag") != "R", "discount": F.col("l_discount") < 0.09})


@query("first_last_hits", "SELECT l_orderkey, count(*) AS hits, min(l_linenumber) AS first_hit, max(l_linenumber) AS last_hit, count(*) FILTER (WHERE l_linenumber >= 5) AS late FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def first_last_hits(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("hits"), F.min("l_linenumber").alias("first_hit"), F.max("l_linenumber").alias("last_hit"), F.count_if(F.col("l_linenumber") >= 5).alias("late"))


_HEAT = ", ".join(f'count(*) FILTER (WHERE greatest(-2, least(2, CAST(l_partkey % 9 AS INT) - 4)) = {c}) AS "c{c}"' for c in range(-2, 3))


@query("heatmap_pivot", f"SELECT l_returnflag, CAST(greatest(0, least(5, l_linenumber)) AS INT) AS row, {_HEAT} FROM lineitem GROUP BY 1, 2")
def heatmap_pivot(spark, sf_dir):
    return agg.heatmap(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_linenumber"), (F.col("l_partkey") % 9).cast("int") - 4, (0, 5), range(-2, 3))


@query("feature_collision", "SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT d.lang, d.source, d.n_chars // 100 AS size, count(DISTINCT quality) AS k, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2, 3) WHERE k > 1")
def feature_collision(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr("n_chars div 100").alias("size"))
    return agg.collisions(d.join(table(spark, sf_dir, "labels"), "doc_id"), ["lang", "source", "size"], "quality")


_SELECT = {"max_price": "l_extendedprice DESC", "min_price": "l_extendedprice", "max_part": "l_partkey DESC", "min_quantity": "l_quantity"}
_SELECT_SQL = " UNION ALL ".join(f"SELECT '{n}' AS selector, count(*) AS scenes, count(*) FILTER (WHERE hit) AS hits FROM (SELECT l_returnflag = 'R' AS hit, row_number() OVER (PARTITION BY l_orderkey ORDER BY {o}, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate, l_returnflag) AS k FROM lineitem) WHERE k = 1" for n, o in _SELECT.items())


@query("selector_grid", _SELECT_SQL)
def selector_grid(spark, sf_dir):
    by = {"max_price": -F.col("l_extendedprice"), "min_price": F.col("l_extendedprice"), "max_part": -F.col("l_partkey"), "min_quantity": F.col("l_quantity")}
    return agg.selector_rates(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [*LINE_TIES, "l_returnflag"], by, F.col("l_returnflag") == "R")


@query("listwise_eval", "WITH f AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS chosen FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, l_returnflag = 'R' AS hit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate) AS k FROM lineitem) SELECT count(*) AS scenes, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE hit) / count(*) AS accuracy FROM b JOIN f ON b.l_orderkey = f.l_orderkey WHERE k = 1 AND chosen = 1")
def listwise_eval(spark, sf_dir):
    """Argmax by score against the one chosen row, for groups with exactly one."""
    l = table(spark, sf_dir, "lineitem").withColumn("hit", F.col("l_returnflag") == "R")  # noqa: E741
    best = F.min_by("hit", F.struct(-F.col("l_extendedprice"), *LINE_TIES))
    g = l.groupBy("l_orderkey").agg(F.count_if("hit").alias("chosen"), best.alias("hit")).where("chosen = 1")
    return g.agg(F.count("*").alias("scenes"), F.count_if("hit").alias("hits"), (F.count_if("hit") / F.count("*")).alias("accuracy"))


@query("threshold_tallies", "WITH g AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS rate FROM orders GROUP BY 1) SELECT count(*) AS files, count(*) FILTER (WHERE rate >= 0.25) AS ge_25, count(*) FILTER (WHERE rate >= 0.5) AS ge_50, count(*) FILTER (WHERE rate >= 0.9) AS ge_90, count(*) FILTER (WHERE rate >= 1) AS full_match FROM g")
def threshold_tallies(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("rate"))
    return g.agg(F.count("*").alias("files"), *[F.count_if(F.col("rate") >= t).alias(n) for n, t in (("ge_25", 0.25), ("ge_50", 0.5), ("ge_90", 0.9), ("full_match", 1.0))])


@query("gini_split", "SELECT lang, CAST(sum(n) AS BIGINT) AS n, 1 - CAST(sum(n * n) AS DOUBLE) / (CAST(sum(n) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS gini FROM (SELECT lang, quality, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2) GROUP BY 1")
def gini_split(spark, sf_dir):
    return agg.gini(table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id"), ["lang"], "quality")


@query("best_split", """WITH v AS (SELECT CAST(n_chars AS DOUBLE) AS value, count(*) FILTER (WHERE quality = 0) AS c0, count(*) FILTER (WHERE quality = 1) AS c1 FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1),
  r AS (SELECT value, lead(value) OVER w AS following, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1, sum(c0) OVER () AS t0, sum(c1) OVER () AS t1 FROM v WINDOW w AS (ORDER BY value)),
  g AS (SELECT (value + following) / 2 AS threshold, CAST(t0 + t1 AS BIGINT) AS n, CAST(l0 AS DOUBLE) AS l0, CAST(l1 AS DOUBLE) AS l1, CAST(t0 - l0 AS DOUBLE) AS r0, CAST(t1 - l1 AS DOUBLE) AS r1, CAST(t0 AS DOUBLE) AS t0, CAST(t1 AS DOUBLE) AS t1 FROM r WHERE following IS NOT NULL),
  x AS (SELECT threshold, n, (1 - (t0 * t0 + t1 * t1) / ((t0 + t1) * (t0 + t1))) - ((l0 + l1) * (1 - (l0 * l0 + l1 * l1) / ((l0 + l1) * (l0 + l1))) + (r0 + r1) * (1 - (r0 * r0 + r1 * r1) / ((r0 + r1) * (r0 + r1)))) / (t0 + t1) AS gain FROM g)
  SELECT 'n_chars' AS feature, threshold, n, round(gain, 9) AS gain FROM x ORDER BY round(gain, 12) DESC, threshold LIMIT 1""")
def best_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return tree.best_splits(d, ["n_chars"], "quality").select("feature", "threshold", "n", F.round("gain", 9).alias("gain"))


EXAMPLE_TREE = tree.Node(None, "n_chars", 1500.5, tree.Node(None, "n_words", 40.0, tree.Node(0), tree.Node(1)), tree.Node(None, "unknown", 3.0, tree.Node(2), tree.Node(3)))


@query("tree_predict", r"SELECT doc_id, CASE WHEN n_chars > 1500.5 THEN 2 WHEN len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) > 40 THEN 1 ELSE 0 END AS choice FROM documents")
def tree_predict(spark, sf_dir):
    """A tree as nested CASE; a feature that the rows lack goes left."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", words.alias("n_words"))
    return d.select("doc_id", EXAMPLE_TREE.column(d.columns).alias("choice"))


@query("recode_kinds", "SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE -1 END AS code FROM events")
def recode_kinds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(-1).alias("code"))


@query("prefix_class", "SELECT CASE WHEN source LIKE 'src1%' THEN 'src1' WHEN source LIKE 'src2%' THEN 'src2' WHEN source = '' OR source IS NULL THEN '?' ELSE substr(source, 1, 1) END AS class, count(*) AS n FROM documents GROUP BY 1")
def prefix_class(spark, sf_dir):
    s = F.col("source")
    c = F.when(s.startswith("src1"), "src1").when(s.startswith("src2"), "src2").when((s == "") | s.isNull(), "?").otherwise(F.substring(s, 1, 1))
    return table(spark, sf_dir, "documents").groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("try_cast_rows", "SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT), 0) AS k, TRY_CAST(event_type AS INT) IS NULL AS dropped FROM events")
def try_cast_rows(spark, sf_dir):
    k = F.coalesce(F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT)"), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.expr("try_cast(event_type AS INT) IS NULL").alias("dropped"))


@query("json_step_get", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.absent') AS absent FROM events")
def json_step_get(spark, sf_dir):
    p = F.from_json("props", "k int, absent string")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), p["absent"].alias("absent"))


@query("modular_kernel", "SELECT event_id, (4078 + event_id) & 4095 AS ring, CASE WHEN event_id % 640 > 320 THEN event_id // 640 + 1 ELSE event_id // 640 END AS row_off, CASE WHEN event_id % 640 > 320 THEN event_id % 640 - 640 ELSE event_id % 640 END AS col_off, ((event_id % 256) - (user_id % 256) + 256) % 256 AS wrapped, lower(printf('%04x', xor(event_id % 65536, 255))) AS hex4 FROM events")
def modular_kernel(spark, sf_dir):
    from ringloom.functions import scalar as s

    e = F.col("event_id")
    row, col = s.signed_offset(e, 640)
    return table(spark, sf_dir, "events").select("event_id", s.ring_position(e).alias("ring"), row.alias("row_off"), col.alias("col_off"), s.wrapping_sub(e % 256, F.col("user_id") % 256).alias("wrapped"), s.hex_text((e % 65536).bitwiseXOR(F.lit(255)), 4).alias("hex4"))


@query("bit_kernel", """SELECT doc_id, CAST(sum(xor(b, 255)) AS BIGINT) AS flipped, CAST(sum((b >> 4) & 15) AS BIGINT) AS high, count(*) FILTER (WHERE b & 1 = 1) AS odd FROM
  (SELECT doc_id, CAST('0x' || unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS INT) AS b FROM documents) GROUP BY 1""")
def bit_kernel(spark, sf_dir):
    """Bytes of whole texts: inverted, shifted, masked."""
    from ringloom.functions import scalar as s

    b = table(spark, sf_dir, "documents").select("doc_id", F.explode(s.bytes_of(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("b"))
    return b.groupBy("doc_id").agg(F.sum(F.col("b").bitwiseXOR(F.lit(255))).alias("flipped"), F.sum(F.shiftright("b", 4).bitwiseAND(F.lit(15))).alias("high"), F.count_if(F.col("b").bitwiseAND(F.lit(1)) == 1).alias("odd"))


@query("size_model", "SELECT l_orderkey, count(*) AS tokens, CAST((count(*) + 7) // 8 + count(*) FILTER (WHERE l_returnflag = 'N') + 2 * count(*) FILTER (WHERE l_returnflag <> 'N') AS BIGINT) AS bytes FROM lineitem GROUP BY 1")
def size_model(spark, sf_dir):
    from ringloom.functions import scalar as s

    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("tokens"), s.framed_size(F.col("l_returnflag") != "N").alias("bytes"))


@query("tolerance_dedup", "WITH v AS (SELECT DISTINCT p_retailprice AS x FROM part), g AS (SELECT x, x - lag(x) OVER (ORDER BY x) AS gap FROM v), k AS (SELECT x FROM g WHERE gap IS NULL OR gap > 1e-9) SELECT x, (x + lead(x) OVER (ORDER BY x)) / 2 AS midpoint FROM k")
def tolerance_dedup(spark, sf_dir):
    """Distinct prices of a dimension table in one order: the list of thresholds is global, as in a tree's split search."""
    from pyspark.sql import Window

    w = Window.orderBy("x")
    v = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("x")).distinct()
    k = v.withColumn("gap", F.col("x") - F.lag("x").over(w)).where("gap is null or gap > 1e-9")
    return k.select("x", ((F.col("x") + F.lead("x").over(w)) / 2).alias("midpoint"))


@query("string_agg_sorted", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY 1")
def string_agg_sorted(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ";").alias("kinds"))


@query("best_variant", "WITH v AS (SELECT c_nationkey, c_mktsegment, count(*) AS hits FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY hits DESC, c_mktsegment) AS k, sum(hits) OVER (PARTITION BY c_nationkey) AS total FROM v) SELECT c_nationkey, c_mktsegment AS best, hits, CAST(hits AS DOUBLE) / CAST(total AS DOUBLE) AS ratio FROM r WHERE k = 1")
def best_variant(spark, sf_dir):
    v = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("hits"))
    g = v.groupBy("c_nationkey").agg(F.min(F.struct((-F.col("hits")).alias("k"), "c_mktsegment", "hits")).alias("b"), F.sum("hits").alias("total"))
    return g.select("c_nationkey", F.col("b.c_mktsegment").alias("best"), F.col("b.hits").alias("hits"), (F.col("b.hits") / F.col("total")).alias("ratio"))
