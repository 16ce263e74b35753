"""Queries over joins, overlap, deduplication, sets and filters (JN-*, SET-*, FLT-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylane.functions import normalize as N
from quarrylane.functions import sqlfeatures as S
from quarrylane.operators import dedup, overlap
from quarrylane.plans.cases import CTE, cases
from quarrylane.plans.registry import register
from quarrylane.plans.text import sql_collapse


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all documents: the text stands for the question, language and length for the SQL."""
    d = table(spark, sf_dir, "documents")
    keys = overlap.keyed(d, F.col("doc_id"), N.norm_q_lower(F.col("text")), F.concat_ws("|", "lang", F.col("n_chars").cast("string")))
    return keys.join(d.select("doc_id", "source"), keys["id"] == d["doc_id"]).drop("doc_id")


POOL = (
    f"pool AS (SELECT doc_id AS id, source, md5({sql_collapse('lower(text)')}) AS question, md5(lang || '|' || CAST(n_chars AS VARCHAR)) AS sql, "
    f"md5({sql_collapse('lower(text)')}) || '|' || md5(lang || '|' || CAST(n_chars AS VARCHAR)) AS pair FROM documents), "
    "test AS (SELECT * FROM pool WHERE source = 'src0'), train AS (SELECT * FROM pool WHERE source <> 'src0')"
)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rows of one source as test rows, all others as training rows."""
    p = pool(spark, sf_dir)
    return p.where("source = 'src0'"), p.where("source <> 'src0'")


IN = lambda k: f"{k} IN (SELECT {k} FROM train)"


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", F.col("quality").alias("m")), labels.select("doc_id", F.col("toxic").alias("m"))


register(
    "jn1_paired_cases",
    lambda spark, sf_dir: runs(spark, sf_dir)[0].withColumnRenamed("m", "zero").join(runs(spark, sf_dir)[1].withColumnRenamed("m", "few"), "doc_id")
    .join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id", "left")
    .select("doc_id", "zero", "few", "source", F.when((F.col("zero") == 0) & (F.col("few") == 1), "rescue").when((F.col("zero") == 1) & (F.col("few") == 0), "regression")
            .when(F.col("zero") == 1, "both_correct").otherwise("both_wrong").alias("case_group")),
    "SELECT doc_id, quality AS zero, toxic AS few, source, CASE WHEN quality = 0 AND toxic = 1 THEN 'rescue' WHEN quality = 1 AND toxic = 0 THEN 'regression' "
    "WHEN quality = 1 THEN 'both_correct' ELSE 'both_wrong' END AS case_group FROM labels LEFT JOIN documents USING (doc_id)",
)


def jn2(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("x"), (F.length("text") > 2000).cast("int").alias("flag"))
    b = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("other_id"), F.lit(1).alias("x2"), F.col("quality").alias("flag2"))
    j = a.join(b, a["doc_id"] == b["other_id"], "full_outer")
    status = F.when(F.col("x2").isNull(), "only_a").when(F.col("x").isNull(), "only_b").otherwise("both")
    differs = F.array_compact(F.array(F.when((F.col("x2") == 1) & ~F.col("flag").eqNullSafe(F.col("flag2")), F.lit("flag"))))
    return j.select(F.coalesce("doc_id", "other_id").alias("id"), status.alias("status"), F.array_join(F.when(status == "both", differs).otherwise(F.array().cast("array<string>")), ",").alias("differing"))


register(
    "jn2_full_outer_compare", jn2,
    "SELECT coalesce(a.doc_id, b.doc_id) AS id, CASE WHEN b.doc_id IS NULL THEN 'only_a' WHEN a.doc_id IS NULL THEN 'only_b' ELSE 'both' END AS status, "
    "CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND CAST(length(a.text) > 2000 AS INTEGER) IS DISTINCT FROM b.quality THEN 'flag' ELSE '' END AS differing "
    "FROM documents a FULL OUTER JOIN labels b ON a.doc_id = b.doc_id",
)
for name, pairwise, both in (("jn3_overlap_counts", True, IN("pair")), ("jn3b_overlap_counts_independent", False, f"{IN('question')} AND {IN('sql')}")):
    register(
        name,
        lambda spark, sf_dir, pairwise=pairwise: overlap.overlap_counts(*sides(spark, sf_dir), pairwise),
        f"WITH {POOL} SELECT count(*) AS n, count(*) FILTER (WHERE {IN('question')}) AS question_overlap, count(*) FILTER (WHERE {IN('sql')}) AS sql_overlap, "
        f"count(*) FILTER (WHERE {both}) AS both_overlap FROM test",
    )
register(
    "jn4_remove_pairs",
    lambda spark, sf_dir: overlap.remove_overlap(*sides(spark, sf_dir)[::-1], ("pair",)).select("id"),
    f"WITH {POOL} SELECT id FROM train WHERE pair NOT IN (SELECT pair FROM test)",
)
register(
    "jn4_hit_ids",
    lambda spark, sf_dir: sides(spark, sf_dir)[0].select("id", "pair").join(sides(spark, sf_dir)[1].select(F.col("pair").alias("p")).distinct(), F.col("pair") == F.col("p"), "left_semi").select("id"),
    f"WITH {POOL} SELECT id FROM test WHERE {IN('pair')}",
)


def jn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = sides(spark, sf_dir)
    f = overlap.flags(train, test, ("question", "sql"))
    return f.agg(
        F.count("*").alias("n"), F.count_if("in_question").alias("question_hits"), F.count_if("in_sql").alias("sql_hits"),
        F.count_if(F.col("in_question") | F.col("in_sql")).alias("dropped"), F.count_if(~(F.col("in_question") | F.col("in_sql"))).alias("kept"),
    )


T_IN = lambda k: f"{k} IN (SELECT {k} FROM test)"
register(
    "jn5_remove_question_or_sql", jn5,
    f"WITH {POOL} SELECT count(*) AS n, count(*) FILTER (WHERE {T_IN('question')}) AS question_hits, count(*) FILTER (WHERE {T_IN('sql')}) AS sql_hits, "
    f"count(*) FILTER (WHERE {T_IN('question')} OR {T_IN('sql')}) AS dropped, count(*) FILTER (WHERE NOT ({T_IN('question')} OR {T_IN('sql')})) AS kept FROM train",
)
KEY_SETS = "SELECT 'question' AS kind, question AS v FROM {0} UNION SELECT 'sql', sql FROM {0} UNION SELECT 'pair', pair FROM {0} UNION SELECT 'id', CAST(id AS VARCHAR) FROM {0}"
register(
    "jn6_key_intersections",
    lambda spark, sf_dir: overlap.intersections(*sides(spark, sf_dir)),
    f"WITH {POOL}, a AS ({KEY_SETS.format('test')}), b AS ({KEY_SETS.format('train')}) SELECT kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY kind",
)


def jn6b(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = sides(spark, sf_dir)
    keys = overlap.long_keys(train).select(F.col("kind").alias("k"), F.col("value").alias("v")).distinct()
    hit = overlap.long_keys(test).join(keys, (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")), "left_semi")
    return hit.groupBy("kind").agg(F.count("*").alias("rows_in_reference"))


register(
    "jn6b_membership_counts", jn6b,
    f"WITH {POOL} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS rows_in_reference FROM test WHERE {IN(k)} HAVING count(*) > 0" for k in overlap.KINDS),
)


def jn6c(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = sides(spark, sf_dir)
    flagged = overlap.flags(test, train)
    long = flagged.unpivot(["id"], [f"in_{k}" for k in overlap.KINDS], "check", "hit").where("hit")
    first = long.withColumn("r", F.row_number().over(Window.partitionBy("check").orderBy("id"))).where("r <= 10")
    ids = first.groupBy("check").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("first_ids"))
    return long.groupBy("check").agg(F.count("*").alias("n")).join(ids, "check").withColumn("status", F.lit("FAIL"))


register(
    "jn6c_leakage_report", jn6c,
    f"WITH {POOL}, hits AS (" + " UNION ALL ".join(f"SELECT 'in_{k}' AS \"check\", id FROM test WHERE {IN(k)}" for k in overlap.KINDS) + "), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY \"check\" ORDER BY id) AS r FROM hits) SELECT \"check\", count(*) AS n, "
    "string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE r <= 10) AS first_ids, 'FAIL' AS status FROM r GROUP BY \"check\"",
)


def jn6d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir)
    keys = overlap.long_keys(p, ("question", "sql")).join(p.select(F.col("id").alias("i"), "source"), F.col("id") == F.col("i")).select("source", "kind", "value").distinct()
    other = keys.select(F.col("source").alias("reference"), F.col("kind").alias("k"), F.col("value").alias("v"))
    return keys.join(other, (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")) & (F.col("source") != F.col("reference"))).groupBy("source", "reference", "kind").agg(F.count("*").alias("n"))


register(
    "jn6d_overlap_matrix", jn6d,
    f"WITH {POOL}, k AS (SELECT DISTINCT source, 'question' AS kind, question AS v FROM pool UNION SELECT DISTINCT source, 'sql', sql FROM pool) "
    "SELECT a.source, b.source AS reference, a.kind, count(*) AS n FROM k a JOIN k b ON a.kind = b.kind AND a.v = b.v AND a.source <> b.source GROUP BY ALL",
)


def jn7(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id")
    missing, extra = a.exceptAll(b).agg(F.count("*").alias("labels_without_document")), b.exceptAll(a).agg(F.count("*").alias("documents_without_label"))
    return missing.crossJoin(extra).withColumn("aligned", (F.col("labels_without_document") == 0) & (F.col("documents_without_label") == 0))


register(
    "jn7_alignment_check", jn7,
    "SELECT *, labels_without_document = 0 AND documents_without_label = 0 AS aligned FROM (SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)) AS labels_without_document, "
    "(SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) AS documents_without_label)",
)


def jn14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.length("text").cast("long").alias("n"))
    return c.groupBy("conv_id").pivot("role", ["user", "assistant", "system"]).agg(F.sum("n"))


register(
    "jn14_run_alignment", jn14,
    "SELECT conv_id, " + ", ".join(f'CAST(sum(length(text)) FILTER (WHERE role = \'{r}\') AS BIGINT) AS "{r}"' for r in ("user", "assistant", "system")) + " FROM conversations GROUP BY conv_id",
)


def jn16(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select(F.lit("documents").alias("path"), F.col("doc_id").alias("idx"), "text").unionByName(
        table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("path"), F.col("item_id").alias("idx"), "text"))
    wanted = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "documents").otherwise("benchmark").alias("p"), F.col("doc_id").alias("i"))
    found = wanted.join(sources, (F.col("p") == F.col("path")) & (F.col("i") == F.col("idx")), "left")
    return found.select("p", "i", F.md5("text").alias("text_md5"), F.col("text").isNotNull().alias("found"))


register(
    "jn16_positional_lookup", jn16,
    "WITH s AS (SELECT 'documents' AS path, doc_id AS idx, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark), "
    "w AS (SELECT CASE WHEN quality = 1 THEN 'documents' ELSE 'benchmark' END AS p, doc_id AS i FROM labels) SELECT p, i, md5(text) AS text_md5, text IS NOT NULL AS found FROM w LEFT JOIN s ON p = path AND i = idx",
)


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, words) of all documents."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return d.withColumn("words", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9]+"), F.lit(0))))


def jn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the five others whose tokens are the most alike."""
    t = worded(spark, sf_dir).select("id", "words")
    return overlap.token_jaccard(t, t, overlap.STOP_WORDS).withColumn("jaccard", F.round("jaccard", 9))


register(
    "jn10_token_jaccard", jn10,
    f"""WITH t AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), u AS (SELECT id, len(w) AS n, unnest(w) AS token FROM t),
    s AS (SELECT a.id, b.id AS other, a.n, b.n AS m, count(*) AS common, bool_or(length(a.token) >= 3 AND a.token NOT IN {overlap.STOP_WORDS}) AS indexed FROM u a JOIN u b ON a.token = b.token AND a.id <> b.id GROUP BY ALL),
    j AS (SELECT *, common / (n + m - common) AS jaccard FROM s WHERE indexed AND 100 * common >= 45 * (n + m - common)),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY jaccard DESC, other DESC) AS rank FROM j) SELECT id, other, round(jaccard, 9) AS jaccard, rank FROM r WHERE rank <= 5""",
)


def jn14_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as three runs that list them by key, by region and by name."""
    n = table(spark, sf_dir, "nation")
    at = lambda *order: n.select(F.col("n_nationkey").alias("case_id"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))
    return overlap.aligned({"by_key": at("n_nationkey"), "by_region": at("n_regionkey", "n_nationkey"), "by_name": at("n_name", "n_nationkey")}, "case_id", "place")


register(
    "jn14_run_order", jn14_order,
    "SELECT *, place_by_region = place_by_key AND place_by_name = place_by_key AS same_place FROM (SELECT n_nationkey AS case_id, row_number() OVER (ORDER BY n_nationkey) AS place_by_key, "
    "row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS place_by_region, row_number() OVER (ORDER BY n_name, n_nationkey) AS place_by_name FROM nation)",
)
register(
    "jn15_entities_in_question",
    lambda spark, sf_dir: cases(spark).select("id", F.lower("question").alias("q")).join(
        F.broadcast(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("entity")).unionByName(spark.createDataFrame([("customer",), ("nation",), ("part",), ("price",)], "entity string"))),
        F.expr("instr(q, entity) > 0")).select("id", "entity"),
    f"WITH {CTE}, e AS (SELECT lower(n_name) AS entity FROM nation UNION ALL SELECT * FROM (VALUES ('customer'), ('nation'), ('part'), ('price')) v(e)) SELECT id, entity FROM cases JOIN e ON contains(lower(question), entity)",
)

# Deduplication and sets.
register(
    "set1_first_wins",
    lambda spark, sf_dir: dedup.first_wins(pool(spark, sf_dir), [F.col("question"), F.col("sql")], [F.col("id")]).select("id"),
    f"WITH {POOL} SELECT min(id) AS id FROM pool GROUP BY question, sql",
)


def set2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = F.sha2(F.concat_ws("|||", F.lower(F.trim("lang")), N.norm_q_lower(F.col("text")), "source"), 256)
    return dedup.first_wins(d.select("doc_id", key.alias("row_hash")), [F.col("row_hash")], [F.col("doc_id")])


register(
    "set2_first_wins_by_hash", set2,
    f"SELECT min(doc_id) AS doc_id, h AS row_hash FROM (SELECT doc_id, sha256(lower(trim(lang)) || '|||' || {sql_collapse('lower(text)')} || '|||' || source) AS h FROM documents) GROUP BY h",
)
register(
    "set3_greedy_dedup",
    lambda spark, sf_dir: dedup.greedy_sequential(pool(spark, sf_dir).select("id", "question", "sql"), "id", "question", "sql").select("id"),
)
register(
    "set4_last_wins",
    lambda spark, sf_dir: dedup.last_wins(table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "click", F.col("user_id")).alias("step"), "event_id"), "step", "event_id"),
    "SELECT step, event_id FROM (SELECT CASE WHEN event_type <> 'click' THEN user_id END AS step, event_id FROM events) QUALIFY step IS NULL OR row_number() OVER (PARTITION BY step ORDER BY event_id DESC) = 1",
)
register(
    "set5_key_set_intersection",
    lambda spark, sf_dir: sides(spark, sf_dir)[0].select("question").intersect(sides(spark, sf_dir)[1].select("question")),
    f"WITH {POOL} SELECT question FROM test INTERSECT SELECT question FROM train",
)


def bag(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "gold":
        return table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return table(spark, sf_dir, "orders").where("o_totalprice > 1000").select("o_custkey", "o_orderstatus")


def set7(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = bag(spark, sf_dir, "gold"), bag(spark, sf_dir, "pred")
    counts = [
        gold.exceptAll(pred).agg(F.count("*").alias("missing_rows")), pred.exceptAll(gold).agg(F.count("*").alias("extra_rows")),
        pred.groupBy("o_custkey", "o_orderstatus").count().agg(F.sum(F.col("count") - 1).alias("duplicate_rows")),
    ]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).withColumn("match", (F.col("missing_rows") == 0) & (F.col("extra_rows") == 0))


register(
    "set6_set7_bag_difference", set7,
    "WITH g AS (SELECT o_custkey, o_orderstatus FROM orders), p AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 1000), x AS (SELECT "
    "(SELECT count(*) FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM p)) AS missing_rows, (SELECT count(*) FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM g)) AS extra_rows, "
    "(SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM p GROUP BY o_custkey, o_orderstatus)) AS duplicate_rows) SELECT *, missing_rows = 0 AND extra_rows = 0 AS match FROM x",
)


def set8(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return a.unionByName(b).withColumn("shuffle_key", S.stable_key(F.lit("7"), F.col("id")))


register(
    "set8_union_hash_order", set8,
    "SELECT id, sha256('7|' || id) AS shuffle_key FROM (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier)",
)
register(
    "set9_label_algebra",
    lambda spark, sf_dir: cases(spark).select("id", S.candidate_features(F.col("gold_sql")).alias("g"), S.candidate_features(F.col("pred_sql")).alias("p")).select(
        "id", F.array_join(F.array_sort(F.array_except("g", "p")), ",").alias("repaired"), F.array_join(F.array_sort(F.array_except("p", "g")), ",").alias("introduced"),
        F.array_join(F.array_sort(F.array_intersect("g", "p")), ",").alias("persistent")),
)


def set10_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.md5(N.norm_q_lower(F.col("text"))).alias("question"), F.concat_ws("|", "lang", "source", F.floor(F.col("n_chars") / 10).cast("string")).alias("sql"))


register(
    "set10_components", lambda spark, sf_dir: overlap.components(set10_rows(spark, sf_dir), ("question", "sql")),
    f"""WITH RECURSIVE r AS (SELECT doc_id AS id, md5({sql_collapse('lower(text)')}) AS q, lang || '|' || source || '|' || CAST(floor(n_chars / 10) AS BIGINT) AS s FROM documents),
    e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM r a JOIN r b ON a.q = b.q UNION SELECT DISTINCT a.id, b.id FROM r a JOIN r b ON a.s = b.s),
    w(id, reach) AS (SELECT id, id FROM r UNION SELECT w.id, e.b FROM w JOIN e ON w.reach = e.a) SELECT id, min(reach) AS component FROM w GROUP BY id""",
)


def set11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = set10_rows(spark, sf_dir)
    protected = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("p"))
    hit = overlap.components(rows, ("question", "sql")).join(protected, F.col("id") == F.col("p"), "left").withColumn("hit", F.col("p").isNotNull())
    forced = hit.groupBy("component").agg(F.max("hit").alias("forced_to_train"), F.count("*").alias("size"))
    return forced


register(
    "set11_component_conflicts", set11,
    f"""WITH RECURSIVE r AS (SELECT doc_id AS id, md5({sql_collapse('lower(text)')}) AS q, lang || '|' || source || '|' || CAST(floor(n_chars / 10) AS BIGINT) AS s FROM documents),
    e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM r a JOIN r b ON a.q = b.q UNION SELECT DISTINCT a.id, b.id FROM r a JOIN r b ON a.s = b.s),
    w(id, reach) AS (SELECT id, id FROM r UNION SELECT w.id, e.b FROM w JOIN e ON w.reach = e.a), c AS (SELECT id, min(reach) AS component FROM w GROUP BY id)
    SELECT component, bool_or(l.doc_id IS NOT NULL) AS forced_to_train, count(*) AS size FROM c LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) l ON c.id = l.doc_id GROUP BY component""",
)
# Filters and gates.
REASON = lambda: F.coalesce(
    F.when(F.col("text") == "", "empty"), F.when(F.col("n_chars") < 300, "too_short"), F.when(F.col("lang") != "en", "language"), F.when(F.col("source") == "src0", "source")
)
REASON_SQL = "CASE WHEN text = '' THEN 'empty' WHEN n_chars < 300 THEN 'too_short' WHEN lang <> 'en' THEN 'language' WHEN source = 'src0' THEN 'source' END"
register(
    "flt1_reason_counts",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").groupBy(F.coalesce(REASON(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")),
    f"SELECT coalesce({REASON_SQL}, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1",
)
register(
    "flt2_exclusion_cascade",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", REASON().alias("reason")),
    f"SELECT doc_id, {REASON_SQL} AS reason FROM documents",
)
register(
    "flt4_leakage_reasons",
    lambda spark, sf_dir: overlap.leakage_reasons(*sides(spark, sf_dir)),
    f"WITH {POOL} SELECT id, concat_ws('+', " + ", ".join(f"CASE WHEN {IN(k)} THEN '{k}' END" for k in overlap.KINDS) + ") AS reasons FROM test",
)
register(
    "flt9_anti_overlap",
    lambda spark, sf_dir: overlap.remove_overlap(*sides(spark, sf_dir), overlap.KINDS).select("id"),
    f"WITH {POOL} SELECT id FROM test WHERE NOT ({' OR '.join(map(IN, overlap.KINDS))})",
)
