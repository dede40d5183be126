"""Metrics, spreads, profiles, splits and models over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.functions.values import ratio
from tessera.operators import auditing, errors, learning, splits
from tessera.operators.judging import cell_means
from tessera.operators.rows import eligible
from tessera.plans.catalogue import query, table
from tessera.sources.scratch import written

#: Signals of a document and whether a greater value speaks for the label.
SIGNALS = (("n_chars", 1.0), ("source_number", -1.0), ("is_english", 1.0), ("id_mod", 1.0))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.coalesce(F.regexp_extract("source", r"(\d+)", 1).try_cast("double"), F.lit(-1.0)).alias("source_number"), (F.col("lang") == "en").cast("double").alias("is_english"), F.pmod("doc_id", F.lit(7)).cast("double").alias("id_mod")
    )
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    each = F.array(*[F.struct(F.lit(n).alias("signal"), (F.col(n) * d).alias("score")) for n, d in SIGNALS])
    return rows.withColumn("s", F.explode(each)).select("doc_id", (F.col("toxic") == 1).alias("label"), (F.col("quality") == 0).alias("poor"), "s.signal", "s.score")


_SIGNAL_SQL = """base AS (SELECT l.doc_id, l.toxic, l.quality, d.n_chars::DOUBLE AS n_chars, coalesce(try_cast(regexp_extract(d.source, '([0-9]+)', 1) AS DOUBLE), -1) AS source_number,
  CASE WHEN d.lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_english, (d.doc_id % 7)::DOUBLE AS id_mod FROM labels l JOIN documents d USING (doc_id)),
sig AS (SELECT doc_id, toxic = 1 AS label, quality = 0 AS poor, 'n_chars' AS signal, n_chars AS score FROM base UNION ALL SELECT doc_id, toxic = 1, quality = 0, 'source_number', -source_number FROM base
  UNION ALL SELECT doc_id, toxic = 1, quality = 0, 'is_english', is_english FROM base UNION ALL SELECT doc_id, toxic = 1, quality = 0, 'id_mod', id_mod FROM base)"""


@query(
    "auroc_signals",
    f"""WITH {_SIGNAL_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY signal ORDER BY score) + (count(*) OVER (PARTITION BY signal, score) - 1) / 2.0::DOUBLE AS mean_rank FROM sig)
SELECT signal, count(*) AS n, count(*) FILTER (label) AS positives,
  (sum(CASE WHEN label THEN mean_rank ELSE 0 END) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2.0::DOUBLE) / (count(*) FILTER (label) * count(*) FILTER (NOT label))::DOUBLE AS auroc
FROM r GROUP BY signal""",
)
def auroc_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auroc(_signals(spark, sf_dir), ["signal"])


@query(
    "average_precision",
    f"""WITH {_SIGNAL_SQL}, r AS (SELECT *, row_number() OVER w AS i, sum(label::INT) OVER w AS hits FROM sig WINDOW w AS (PARTITION BY signal ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))
SELECT signal, avg(hits / i::DOUBLE) FILTER (label) AS average_precision FROM r GROUP BY signal""",
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.average_precision(_signals(spark, sf_dir), ["signal"], "doc_id")


@query(
    "confusion_by_language",
    """WITH t AS (SELECT d.lang, l.quality = 0 AS y, d.n_chars < 400 OR d.n_chars > 6000 AS p FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND NOT y) AS tn, count(*) FILTER (NOT p AND y) AS fn FROM t GROUP BY lang)
SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS specificity, coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0) AS accuracy FROM c""",
)
def confusion_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return M.confusion(rows, ["lang"], F.col("quality") == 0, (F.col("n_chars") < 400) | (F.col("n_chars") > 6000))


@query(
    "crosstab_grid",
    """WITH g AS (SELECT * FROM (VALUES (false), (true)) a(poor), (VALUES (false), (true)) b(toxic)), t AS (SELECT quality = 0 AS poor, toxic = 1 AS toxic, count(*) AS n FROM labels GROUP BY 1, 2)
SELECT g.poor, g.toxic, coalesce(t.n, 0) AS n, coalesce(t.n, 0)::DOUBLE / (SELECT count(*) FROM labels) AS share FROM g LEFT JOIN t USING (poor, toxic)""",
)
def crosstab_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor, toxic = F.col("quality") == 0, F.col("toxic") == 1
    sums = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("all"), *[F.count_if((poor == p) & (toxic == t)).alias(f"c{p:d}{t:d}") for p in (False, True) for t in (False, True)])
    cells = [F.struct(F.lit(p).alias("poor"), F.lit(t).alias("toxic"), F.col(f"c{p:d}{t:d}").alias("n")) for p in (False, True) for t in (False, True)]
    return sums.withColumn("c", F.explode(F.array(*cells))).select("c.*", ratio(F.col("c.n"), F.col("all")).alias("share"))


@query(
    "answer_spread",
    """WITH c AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS f FROM events GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY user_id) AS n FROM c)
SELECT user_id, any_value(n)::BIGINT AS n_samples, count(*) AS unique_answers, arg_max(event_type, c * 1000000000 - f) AS top_answer, max(c)::DOUBLE / any_value(n) AS top_share,
  round(CASE WHEN any_value(n) > 1 THEN -sum(c / n::DOUBLE * ln(c / n::DOUBLE)) / ln(any_value(n)::DOUBLE) ELSE 0 END, 9) AS entropy FROM t GROUP BY user_id""",
)
def answer_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.answer_spread(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").withColumn("entropy", F.round("entropy", 9))


def _user_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole cents, so that sums don't depend on their order
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / 10000.0).alias("score"))


@query(
    "candidate_features",
    """WITH s AS (SELECT user_id, event_type, sum(round(value * 100)::BIGINT)::DOUBLE / 10000 AS score FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS i, exp(score - max(score) OVER (PARTITION BY user_id)) AS e FROM s),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id) AS p FROM r)
SELECT user_id, max(event_type) FILTER (i = 1) AS top1, round(max(score) FILTER (i = 1), 9) AS top1_score, round(max(score) FILTER (i = 1) - max(score) FILTER (i = 2), 9) AS margin, round(max(p) FILTER (i = 1), 9) AS top1_share,
  round(max(p) FILTER (i = 1) - max(p) FILTER (i = 2), 9) AS share_margin, round(-sum(p * ln(greatest(p, 1e-30::DOUBLE))), 9) AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(greatest(p, 1e-30::DOUBLE))) / ln(count(*)::DOUBLE) ELSE 0 END, 9) AS entropy_share FROM p GROUP BY user_id""",
)
def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learning.candidate_features(_user_scores(spark, sf_dir), "user_id", "event_type", "score")
    return found.select("user_id", "top1", *[F.round(c, 9).alias(c) for c in found.columns[2:]])


@query(
    "candidate_rank_mrr",
    """WITH c AS (SELECT c.range AS cand, (c.range - 5) / 10.0::DOUBLE AS place FROM range(10) c), s AS (SELECT vec_id, label, cand, -abs(embedding[1]::DOUBLE - place) AS score FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cand) AS rank FROM s)
SELECT label, count(*) AS n, round(avg((rank = 1)::INT::DOUBLE), 9) AS accuracy, round(avg((rank <= 5)::INT::DOUBLE), 9) AS top5, round(avg(1 / rank::DOUBLE), 9) AS mrr, round(avg(rank), 9) AS mean_rank FROM r WHERE cand = label GROUP BY label""",
)
def candidate_rank_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ten candidates for each row: an explode of a fixed list, not a join
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("cand"))
    ranked = learning.ranked_candidates(rows.withColumn("score", -F.abs(F.col("x") - (F.col("cand") - 5) / 10.0)), "vec_id", "cand", "score").where("cand = label")
    at = lambda ok: F.round(F.avg(ok.cast("double")), 9)
    return ranked.groupBy("label").agg(F.count(F.lit(1)).alias("n"), at(F.col("rank") == 1).alias("accuracy"), at(F.col("rank") <= 5).alias("top5"), F.round(F.avg(1.0 / F.col("rank")), 9).alias("mrr"), F.round(F.avg("rank"), 9).alias("mean_rank"))


@query(
    "hit_rates_by_source",
    """SELECT d.source, count(*) AS n, count(*) FILTER (l.quality = 1) AS hits, count(*) FILTER (l.quality = 1)::DOUBLE / count(*) AS rate FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source ORDER BY rate, source""",
)
def hit_rates_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    hit = F.count_if(F.col("quality") == 1)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), hit.alias("hits"), ratio(hit, F.count(F.lit(1))).alias("rate")).orderBy("rate", "source")


@query(
    "rate_differences",
    """WITH t AS (SELECT d.source, count(*) FILTER (l.quality = 1) - count(*) FILTER (l.toxic = 1) AS diff FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source)
SELECT 'high' AS tail, source, diff FROM (SELECT * FROM t ORDER BY diff DESC, source DESC LIMIT 20) UNION ALL SELECT 'low', source, diff FROM (SELECT * FROM t ORDER BY diff, source LIMIT 20)""",
)
def rate_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    diff = rows.groupBy("source").agg((F.count_if(F.col("quality") == 1) - F.count_if(F.col("toxic") == 1)).alias("diff"))
    high, low = diff.orderBy(F.desc("diff"), F.desc("source")).limit(20), diff.orderBy("diff", "source").limit(20)
    return high.select(F.lit("high").alias("tail"), "source", "diff").unionByName(low.select(F.lit("low").alias("tail"), "source", "diff"))


@query(
    "profile_nearest_rank",
    """WITH o AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, any_value(n) AS n, min(n_chars) AS least, max(n_chars) AS greatest, sum(n_chars)::DOUBLE / count(*) AS mean, max(n_chars) FILTER (i = least(n - 1, floor(n * 0.5::DOUBLE))) AS p50, max(n_chars) FILTER (i = least(n - 1, floor(n * 0.9::DOUBLE))) AS p90,
  max(n_chars) FILTER (i = least(n - 1, floor(n * 0.99::DOUBLE))) AS p99 FROM o GROUP BY lang""",
)
def profile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.profile(table(spark, sf_dir, "documents"), ["lang"], "n_chars", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query(
    "class_eligibility",
    "SELECT d.source, count(*) AS n, count(*) FILTER (l.quality = 1) AS n_good FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source HAVING count(*) FILTER (l.quality = 1) >= 15",
)
def class_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligible(table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id"), "source", F.col("quality") == 1, 15)


@query(
    "cell_means_verdict",
    """WITH t AS (SELECT d.lang, d.source IN ('src1', 'src2', 'src3') AS flagged, (d.n_chars % 97) / 97.0::DOUBLE AS v, coalesce(d.n_chars > 8000, false) AS x FROM documents d),
c AS (SELECT lang, flagged, count(*) FILTER (NOT x) AS n, round(avg(v) FILTER (NOT x), 9) AS mean_value, count(*) FILTER (x) AS n_excluded FROM t GROUP BY ALL), b AS (SELECT lang, max(mean_value) FILTER (flagged) AS y, max(mean_value) FILTER (NOT flagged) AS z FROM c GROUP BY lang)
SELECT c.*, CASE WHEN y IS NULL OR z IS NULL THEN 'undecided' WHEN y <= z + 0.02::DOUBLE THEN 'alike' ELSE 'apart' END AS verdict FROM c JOIN b USING (lang)""",
)
def cell_means_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.col("source").isin("src1", "src2", "src3").alias("flagged"), (F.pmod("n_chars", F.lit(97)) / 97.0).alias("v"), (F.col("n_chars") > 8000).alias("x"))
    found = cell_means(rows, "lang", "flagged", "v", F.col("x"), 0.02)
    return found.withColumn("mean_value", F.round("mean_value", 9))


@query(
    "value_diversity",
    """WITH c AS (SELECT floor(value) AS v, count(*) AS c FROM events GROUP BY 1) SELECT sum(c)::BIGINT AS n, count(*) AS distinct_values, count(*) FILTER (c = 1)::DOUBLE / count(*) AS once_share, max(c)::DOUBLE / sum(c) AS top_share,
  count(*) FILTER (c >= 0.02 * (SELECT count(*) FROM events)) AS near_constant FROM c""",
)
def value_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auditing.value_diversity(table(spark, sf_dir, "events").select(F.floor("value").alias("v")), "v", 0.02)


@query("presence_profile", "SELECT 'doc_id' AS field, count(doc_id) AS present FROM documents UNION ALL SELECT 'text', count(text) FROM documents UNION ALL SELECT 'lang', count(lang) FROM documents UNION ALL SELECT 'source', count(source) FROM documents UNION ALL SELECT 'n_chars', count(n_chars) FROM documents")
def presence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auditing.presence(table(spark, sf_dir, "documents"))


_BROKEN = r"""SELECT doc_id, 'duplicate_line' AS rule FROM documents WHERE len(string_split(text, chr(10))) > len(list_distinct(string_split(text, chr(10))))
UNION ALL SELECT doc_id, 'long_word' FROM documents WHERE regexp_matches(text, '[^ \n]{60,}') UNION ALL SELECT doc_id, 'symbols' FROM documents WHERE regexp_matches(text, '[#$%&]{3}') UNION ALL SELECT doc_id, 'wrong_size' FROM documents WHERE n_chars <> length(text)"""


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return auditing.violations(table(spark, sf_dir, "documents"), "doc_id", {"duplicate_line": F.size(F.array_distinct(lines)) < F.size(lines), "long_word": F.col("text").rlike(r"[^ \n]{60,}"), "symbols": F.col("text").rlike("[#$%&]{3}"), "wrong_size": F.length("text") != F.col("n_chars")})


@query("audit_violations", _BROKEN)
def audit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir)


@query("audit_report", f"WITH v AS ({_BROKEN}), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY doc_id) AS i FROM v) SELECT rule, count(*) AS n_violations, array_to_string(list(doc_id ORDER BY doc_id) FILTER (i <= 40), ' ') AS first_keys FROM r GROUP BY rule")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auditing.gate(_audited(spark, sf_dir)).withColumn("first_keys", F.array_join(F.col("first_keys").cast("array<string>"), " "))


_SIZES = "greatest(1, round_even(n * 0.8::DOUBLE, 0)::BIGINT) AS t0, greatest(1, round_even(n * 0.1::DOUBLE, 0)::BIGINT) AS v0"
_CUT = "CASE WHEN i <= t THEN 'train' WHEN i <= t + v THEN 'val' ELSE 'test' END"


def _cut_sql(cases: str, group: str, seed: str) -> str:
    return f"""(SELECT doc_id, {group}, {_CUT} AS split FROM (SELECT *, CASE WHEN t0 + v0 < n THEN t0 ELSE greatest(n - 2, 1) END AS t, CASE WHEN t0 + v0 < n THEN v0 ELSE 1 END AS v FROM (SELECT *, {_SIZES} FROM
  (SELECT doc_id, {group}, row_number() OVER (PARTITION BY {group} ORDER BY md5('{seed}:' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY {group}) AS n FROM ({cases})))))"""


@query("stratified_split", f"SELECT * FROM {_cut_sql('SELECT doc_id, lang FROM documents', 'lang', 's17')}")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", "s17")


@query("split_summary", f"SELECT lang, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val FROM {_cut_sql('SELECT doc_id, lang FROM documents', 'lang', 's17')} GROUP BY lang")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(spark, sf_dir).groupBy("lang").pivot("split", ["test", "train", "val"]).agg(F.count(F.lit(1))).na.fill(0)


@query(
    "heldout_class_split",
    f"""WITH h AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('h5:' || source), source LIMIT 4)
SELECT doc_id, source, CASE WHEN source IN (SELECT source FROM h) THEN 'heldout' ELSE split END AS split FROM {_cut_sql('SELECT doc_id, source FROM documents', 'source', 'h5')}""",
)
def heldout_class_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.held_out_groups(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", "h5", 4)


@query(
    "aligned_split",
    f"""WITH r AS (SELECT d.doc_id, d.source, l.quality = 1 AS good FROM documents d JOIN labels l USING (doc_id)), f AS (SELECT source FROM r GROUP BY source HAVING count(*) FILTER (good) >= 12),
k AS (SELECT * FROM r WHERE source IN (SELECT source FROM f)), c AS (SELECT * FROM {_cut_sql('SELECT doc_id, source FROM k WHERE good', 'source', 'a3')})
SELECT k.doc_id, k.source, coalesce(c.split, 'test') AS split FROM k LEFT JOIN c USING (doc_id)""",
)
def aligned_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return splits.aligned(rows, "source", "doc_id", F.col("quality") == 1, 12, "a3")


@query(
    "heldout_value_split",
    """WITH t AS (SELECT event_id, user_id, event_type || floor(value)::BIGINT AS cue FROM events), m AS (SELECT *, strpos('0123456789abcdef', substr(md5('v1:' || cue), 1, 1)) - 1 < 4 AS held, strpos('0123456789abcdef', substr(md5('v1:' || user_id), 1, 1)) - 1 < 3 AS test FROM t)
SELECT event_id, CASE WHEN held AND test THEN 'test_unseen' WHEN test THEN 'test_seen' WHEN held THEN 'dropped' ELSE 'train' END AS split FROM m""",
)
def heldout_value_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat("event_type", F.floor("value").cast("string")).alias("cue"))
    return splits.held_out_values(rows, "user_id", "cue", "v1", 4, 3).select("event_id", "split")


@query(
    "unseen_rate",
    """WITH t AS (SELECT DISTINCT user_id, event_type || floor(value)::BIGINT AS cue FROM events), k AS (SELECT DISTINCT cue FROM t WHERE user_id % 4 <> 0)
SELECT count(*) AS n, count(*) FILTER (cue NOT IN (SELECT cue FROM k)) AS n_unseen, count(*) FILTER (cue NOT IN (SELECT cue FROM k))::DOUBLE / count(*) AS unseen_rate FROM t WHERE user_id % 4 = 0""",
)
def unseen_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.concat("event_type", F.floor("value").cast("string")).alias("cue")).distinct()
    marked = splits.unseen(rows.where("user_id % 4 <> 0"), rows.where("user_id % 4 = 0"), "cue")
    new = F.count_if(~F.col("seen"))
    return marked.agg(F.count(F.lit(1)).alias("n"), new.alias("n_unseen"), ratio(new, F.count(F.lit(1))).alias("unseen_rate"))


@query("fold_assignment", "SELECT doc_id, ((row_number() OVER (PARTITION BY toxic ORDER BY md5('k:' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM labels")
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.folds(table(spark, sf_dir, "labels"), "toxic", "doc_id", 5, "k").select("doc_id", "fold")


@query("split_leaks", "SELECT user_id, count(DISTINCT event_type) AS n_splits FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leaks(table(spark, sf_dir, "events").withColumn("split", F.col("event_type")), "user_id")


@query("probe_multinomial")
def probe_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return learning.probe_metrics(learning.native_probe(rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0"), "embedding", "label", "vec_id"))


_ERRORS = """WITH r AS (SELECT d.doc_id, CASE WHEN d.doc_id % 11 > 0 THEN l.quality = 0 END AS label, CASE WHEN d.n_chars % 5 > 0 THEN d.n_chars % 3 > 0 END AS readout, CASE WHEN d.n_chars % 7 > 0 THEN l.toxic = 0 END AS probe, (d.n_chars % 97)::DOUBLE AS top, CASE WHEN d.doc_id % 4 > 0 THEN (d.doc_id % 89)::DOUBLE END AS entropy
  FROM labels l JOIN documents d USING (doc_id)),
x AS (SELECT doc_id, label, 'source_readout_disagree' AS signal, (NOT readout)::INT::DOUBLE AS score FROM r UNION ALL SELECT doc_id, label, 'source_probe_disagree', (NOT probe)::INT FROM r UNION ALL SELECT doc_id, label, 'probe_low_top1_prob', -top FROM r UNION ALL SELECT doc_id, label, 'source_entropy', entropy FROM r),
k AS (SELECT * FROM x WHERE label IS NOT NULL AND score IS NOT NULL)"""
_WINS = "avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END::DOUBLE)"


def _agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rest = lambda c, n: F.pmod(c, F.lit(n))
    return rows.select(
        "doc_id", F.when(rest("doc_id", 11) > 0, F.col("quality") == 0).alias("is_error"), F.when(rest("n_chars", 5) > 0, rest("n_chars", 3) > 0).alias("source_readout_answer_agree"), F.when(rest("n_chars", 7) > 0, F.col("toxic") == 0).alias("source_probe_answer_agree"),
        rest("n_chars", 97).cast("double").alias("probe_top1_prob"), F.when(rest("doc_id", 4) > 0, rest("doc_id", 89).cast("double")).alias("source_candidate_entropy_norm"),
    )


@query(
    "error_signals",
    _ERRORS
    + f""", o AS (SELECT *, row_number() OVER w AS i, sum(label::INT) OVER w AS hits FROM k WINDOW w AS (PARTITION BY signal ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT signal, count(*) AS n, round(avg(hits / i::DOUBLE) FILTER (label), 9) AS average_precision, count(*) FILTER (label AND score > 0) AS tp, count(*) FILTER (NOT label AND score > 0) AS fp, count(*) FILTER (label) AS pos FROM o GROUP BY signal),
c AS (SELECT a.signal, round({_WINS}, 9) AS auroc FROM k a JOIN k b ON a.signal = b.signal AND a.label AND NOT b.label GROUP BY a.signal)
SELECT signal, n, auroc, average_precision, CASE WHEN contains(signal, 'disagree') THEN tp END AS tp, CASE WHEN contains(signal, 'disagree') THEN fp END AS fp, CASE WHEN contains(signal, 'disagree') THEN round(tp::DOUBLE / pos, 9) END AS recall FROM p JOIN c USING (signal)""",
)
def error_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = errors.signal_report(_agreements(spark, sf_dir), "doc_id", "is_error")
    return found.select("signal", "n", *[F.round(c, 9).alias(c) for c in ("auroc", "average_precision")], "tp", "fp", F.round("recall", 9).alias("recall"))


@query(
    "paired_disagreement",
    _ERRORS
    + f""", b AS (SELECT label, (NOT readout)::INT AS readout, (NOT probe)::INT AS probe FROM r WHERE label IS NOT NULL AND readout IS NOT NULL AND probe IS NOT NULL),
a AS (SELECT {_WINS.replace("a.score", "p.readout").replace("b.score", "q.readout")} AS readout, {_WINS.replace("a.score", "p.probe").replace("b.score", "q.probe")} AS probe FROM b p JOIN b q ON p.label AND NOT q.label)
SELECT (SELECT count(*) FROM b) AS n, round(readout, 9) AS readout_auroc, round(probe, 9) AS probe_auroc, round(readout - probe, 9) AS difference FROM a""",
)
def paired_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = errors.paired_disagreement(_agreements(spark, sf_dir), "doc_id", "is_error")
    return found.select("n", *[F.round(c, 9).alias(c) for c in ("readout_auroc", "probe_auroc", "difference")])


@query("error_rate", _ERRORS + " SELECT count(label) AS n, count(*) FILTER (label) AS errors, count(*) FILTER (label)::DOUBLE / count(label) AS error_rate FROM r")
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.error_rate(_agreements(spark, sf_dir), "is_error")


@query("trained_probe")
def trained_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe for each variant of vectors and for two of them together, split by label."""
    rows = table(spark, sf_dir, "embeddings")
    variant = F.get(F.array(*[F.lit(v) for v in ("multi_cue_2", "multi_cue_3", "format")]), F.pmod("vec_id", F.lit(3)).cast("int"))
    cases = rows.select("vec_id", "label", "embedding", variant.alias("variant")).join(splits.stratified(rows, "label", "vec_id", "p17", 0.7, 0.15).select("vec_id", "split"), "vec_id")
    both = cases.where(F.startswith("variant", F.lit("multi_cue_"))).withColumn("variant", F.lit("multi_cue_all"))
    _, report = learning.trained_probe(cases.unionByName(both), "variant", "split", "embedding", "label", "vec_id", 10)
    return report.select("variant", "split", "n", *[F.round(c, 9).alias(c) for c in ("loss", "accuracy", "accuracy_at_5", "chance")], "best_epoch")


@query("cv_logistic")
def cv_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC of out-of-fold scores for three feature sets, and each one's gain over the first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("size"), F.regexp_count("text", F.lit("[#$%&|]")).cast("double").alias("symbols"), F.regexp_count("text", F.lit("\n")).cast("double").alias("lines"))
    rows = splits.folds(table(spark, sf_dir, "labels").join(docs, "doc_id"), "quality", "doc_id", 5, "cv").withColumn("poor", (F.col("quality") == 0).cast("int"))
    sets = {"size": ["size"], "symbols": ["symbols"], "all": ["size", "symbols", "lines"]}
    scored = learning.out_of_fold_scores(rows, sets, "poor", "fold", "doc_id", 5).withColumn("label", F.col("poor") == 1)
    found = written(M.auroc(scored, ["features"]).join(M.average_precision(scored, ["features"], "doc_id"), "features"))
    return found.crossJoin(found.where("features = 'size'").select(F.col("auroc").alias("_base"))).select("features", "n", "auroc", "average_precision", (F.col("auroc") - F.col("_base")).alias("gain"))


@query("windowed_answers", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.streaming.answers import windowed_answers as windows

    return windows(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")
