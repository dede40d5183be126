"""Joins, quotas, donors, pairings, set and vector operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.text import same_answer
from tessera.functions.values import finite, flag, ratio, strict_bool, wide_bool
from tessera.operators import rows as R
from tessera.plans.catalogue import query, table


@query(
    "feature_table",
    """WITH e AS (SELECT user_id AS doc_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id)
SELECT d.doc_id, d.lang, l.quality AS label_quality, l.toxic AS label_toxic, strlen(b.text) AS bench_size, e.event_type AS event_event_type, e.value AS event_value FROM documents d LEFT JOIN labels l USING (doc_id)
LEFT JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN e USING (doc_id)""",
)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels, benchmark items and last events of the same number; sides keep their last row a key."""
    sides = [
        (table(spark, sf_dir, "labels").withColumn("o", F.lit(0)), "label_"),
        (table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.octet_length("text").cast("long").alias("size"), F.lit(0).alias("o")), "bench_"),
        (table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_type", "value", F.col("event_id").alias("o")), "event_"),
    ]
    return R.look_up_all(table(spark, sf_dir, "documents").select("doc_id", "lang"), sides, "doc_id", "o")


@query(
    "matched_counts",
    "SELECT (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS n_matched, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_unmatched",
)
def matched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, alone = R.matched(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")
    return both.agg(F.count("quality").alias("n_matched")).crossJoin(alone.agg(F.count("doc_id").alias("n_unmatched")))


@query("semi_pool", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("anti_pool", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("pool_overlap", "SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def pool_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where("lang = 'en'").select("source").intersect(docs.where("lang = 'fr'").select("source"))


@query("pool_difference", "SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 100")
def pool_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.where("event_type = 'purchase'").select("user_id").subtract(events.where("event_type = 'error' AND value > 100").select("user_id"))


_H = "(strpos('0123456789abcdef', substr(h, {0}, 1)) - 1) * {1}::BIGINT"
_H32 = " + ".join(_H.format(i + 1, 16 ** (7 - i)) for i in range(8))


@query(
    "mismatched_donor",
    f"""WITH o AS (SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) - 1 AS num, count(*) OVER () AS total, count(*) OVER (PARTITION BY label) AS size, md5('d7:' || vec_id) AS h FROM embeddings),
p AS (SELECT *, min(num) OVER (PARTITION BY label) AS start, ({_H32}) % nullif(total - size, 0) AS step FROM o), a AS (SELECT *, CASE WHEN step < start THEN step ELSE step + size END AS asked FROM p)
SELECT a.vec_id, a.label, o.vec_id AS donor, o.label AS donor_label FROM a LEFT JOIN o ON o.num = a.asked""",
)
def mismatched_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_mismatched_donor(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label", "d7")


@query("quota_per_group", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 30 AND count(*) OVER (PARTITION BY source) >= 30 AND source IN (SELECT source FROM documents GROUP BY source HAVING count(*) >= 30 ORDER BY source LIMIT 8)")
def quota_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quota(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 30, 8)


@query("first_k_per_group", "SELECT doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 5")
def first_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_k(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", [F.desc("n_chars"), F.col("doc_id")], 5)


@query("first_wins", "SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_by(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_by(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("sharded_rows", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE lang = 'en') WHERE i % 4 = 1")
def sharded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shard(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id", 4, 1)


@query("union_shards", "SELECT doc_id, lang FROM documents")
def union_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return R.union_all([docs.where(F.pmod("doc_id", F.lit(3)) == i) for i in range(3)])


@query("first_spelling", "SELECT lower(p_type) AS key, arg_min(p_type, p_partkey) AS spelling, count(*) AS n FROM part GROUP BY 1")
def first_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("key")).agg(F.min_by("p_type", "p_partkey").alias("spelling"), F.count(F.lit(1)).alias("n"))


@query("top_frequencies", "SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY event_type ORDER BY n DESC, min(event_id) LIMIT 3")
def top_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").where("value > 50").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("f"))
    return counts.orderBy(F.desc("n"), "f").limit(3).select("event_type", "n")


@query(
    "agreement_buckets",
    r"""WITH t AS (SELECT a.conv_id, a.turn, regexp_replace(lower(a.text), '[^a-z0-9]+', ' ', 'g') AS x, regexp_replace(lower(b.text), '[^a-z0-9]+', ' ', 'g') AS y, length(b.text) > 200 AS good FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
n AS (SELECT *, trim(x) AS k, trim(y) AS m FROM t), g AS (SELECT CASE WHEN k IS NULL OR m IS NULL OR k = '' OR m = '' THEN 'unknown' WHEN contains(k, m) OR contains(m, k) THEN 'agree' ELSE 'disagree' END AS bucket, good FROM n)
SELECT bucket, count(*) AS n, coalesce(avg(good::INT::DOUBLE), 0) AS accuracy FROM g GROUP BY bucket""",
)
def agreement_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    agree = same_answer(F.col("text"), F.col("next"))
    rows = turns.join(after, ["conv_id", "turn"], "left").select(F.when(agree.isNull(), "unknown").when(agree, "agree").otherwise("disagree").alias("bucket"), (F.length("next") > 200).alias("good"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col("good").cast("double")), F.lit(0.0)).alias("accuracy"))


@query(
    "casts",
    """SELECT s, CASE WHEN lower(trim(s)) IN ('true', '1', 'yes', 'y') THEN true WHEN lower(trim(s)) IN ('false', '0', 'no', 'n') THEN false END AS strict,
  CASE WHEN lower(trim(s)) = 't' THEN true WHEN lower(trim(s)) = 'f' THEN false WHEN lower(trim(s)) IN ('true', '1', 'yes', 'y') THEN true WHEN lower(trim(s)) IN ('false', '0', 'no', 'n') THEN false ELSE try_cast(s AS DOUBLE) <> 0 END AS wide,
  coalesce(lower(trim(s)) IN ('true', '1', 'yes', 'y'), false) AS flag, try_cast(s AS DOUBLE) AS number
FROM (SELECT DISTINCT CASE event_id % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' WHEN 2 THEN 't' WHEN 3 THEN '2.5' WHEN 4 THEN '0.0' WHEN 5 THEN event_type ELSE NULL END AS s FROM events)""",
)
def casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.pmod("event_id", F.lit(7))
    s = F.when(m == 0, "Yes").when(m == 1, " no").when(m == 2, "t").when(m == 3, "2.5").when(m == 4, "0.0").when(m == 5, F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(s.alias("s")).distinct()
    return rows.select("s", strict_bool(F.col("s")).alias("strict"), wide_bool(F.col("s")).alias("wide"), flag(F.col("s")).alias("flag"), finite(F.col("s")).alias("number"))


@query("json_props", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INT) > 90")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k > 90")


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"


@query(
    "vector_pairs",
    f"""WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, {_DOT.format('x', 'y')} AS xy, {_DOT.format('x', 'x')} AS xx, {_DOT.format('y', 'y')} AS yy, list_sum(list_transform(range(1, 65), lambda i: (x[i]::DOUBLE - y[i]) ** 2)) AS dd FROM p)
SELECT vec_id, round(sqrt(xx), 6) AS norm, round(sqrt(dd), 6) AS distance, round(xy / (sqrt(xx) * sqrt(yy)), 6) AS cosine, round(2 * (1 - xy / (sqrt(xx) * sqrt(yy))), 6) AS directional_error FROM s""",
)
def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = vectors.join(vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    x, y = F.col("embedding"), F.col("other")
    six = lambda c, name: F.round(c, 6).alias(name)
    return pairs.select("vec_id", six(V.norm(x), "norm"), six(V.distance(x, y), "distance"), six(V.cosine(x, y), "cosine"), six(V.directional_error(x, y), "directional_error"))


@query("rescaled_vectors", f"SELECT vec_id, round(embedding[1]::DOUBLE * 3 / sqrt({_DOT.format('embedding', 'embedding')}), 6) AS first, 3.0::DOUBLE AS norm FROM embeddings")
def rescaled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = table(spark, sf_dir, "embeddings").select("vec_id", V.rescaled(F.col("embedding"), F.lit(3.0)).alias("v"))
    return scaled.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(V.norm(F.col("v")), 6).alias("norm"))


@query(
    "vector_softmax",
    "WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), e AS (SELECT vec_id, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM t), p AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e) SELECT vec_id, round(max(p), 6) AS top, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY vec_id",
)
def vector_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = table(spark, sf_dir, "embeddings").select("vec_id", V.softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return shares.select("vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(V.entropy(F.col("p")), 6).alias("entropy"))


@query(
    "standardised",
    "WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS d, stddev_samp(value) AS e FROM events GROUP BY event_type) SELECT event_id, round((value - m) / d, 6) AS population, round((value - m) / e, 6) AS sample FROM events JOIN s USING (event_type)",
)
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    moments = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"), F.stddev_samp("value").alias("e"))
    guarded = F.when(F.col("d") < 1e-8, 1.0).otherwise(F.col("d"))
    return events.join(moments, "event_type").select("event_id", F.round((F.col("value") - F.col("m")) / guarded, 6).alias("population"), F.round((F.col("value") - F.col("m")) / F.greatest("e", F.lit(1e-6)), 6).alias("sample"))


@query(
    "variant_pairs",
    """WITH v AS (SELECT user_id, event_type, sum(round(value * 100)::BIGINT) AS cents FROM events GROUP BY ALL), s AS (SELECT * FROM (VALUES ('click_view', 'click', 'view'), ('signup_error', 'signup', 'error')) t(comparison, left_key, right_key))
SELECT s.comparison, a.user_id, (a.cents - b.cents)::BIGINT AS difference FROM s JOIN v a ON a.event_type = left_key JOIN v b ON b.event_type = right_key AND a.user_id = b.user_id""",
)
def variant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    pairs = R.compared_variants(sums, "user_id", "event_type", [("click_view", "click", "view"), ("signup_error", "signup", "error")])
    return pairs.select("comparison", "user_id", (F.col("left.cents") - F.col("right.cents")).alias("difference"))


@query(
    "paired_degradation",
    """WITH p AS (SELECT user_id, bool_or(value > 100) FILTER (event_type = 'click') AS orig, bool_or(value > 100) FILTER (event_type = 'view') AS swap FROM events GROUP BY user_id)
SELECT count(*) AS pairs, coalesce(count(*) FILTER (orig AND NOT swap)::DOUBLE / nullif(count(*), 0), 0) AS degraded FROM p WHERE orig IS NOT NULL""",
)
def paired_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.bool_or(F.col("value") > 100)).where("click IS NOT NULL")
    return wide.agg(F.count(F.lit(1)).alias("pairs"), ratio(F.count_if(F.col("click") & ~F.col("view")), F.count(F.lit(1))).alias("degraded"))
