"""Quality rules by weak supervision, in DataFrame functions alone.

Rules look at counts of a text and vote that it is poor (0), abstain (1) or vote that it is good (2). Documents with
equal votes are one pattern; expectation-maximisation over the patterns' counts estimates for each rule how often it
is right on poor and on good documents where it votes, starting from "poor if any rule says so" and with a prior by
which false alarms are rare. A document is kept if its posterior probability of being good is at least ``KEEP`` and
the two base limits hold.

There are 3**7 patterns at most whatever the input, so that the estimates are one small row: the only shuffle is of
pattern counts, summed before it, and the only broadcast is of that row's patterns.

Defined cases: a null text has no words; such and empty texts fail the base limits. Repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NOT_SPACES, SPACES, stored

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Base limits: fewest words, and most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 50, 50
ITERATIONS, KEEP = 8, 0.5
#: Pseudo-counts as shares of all documents, of votes (poor, good): on poor documents, on good ones.
PRIOR = ((1e-4, 1e-4), (0.01, 5.0))
#: Chance of being poor at the start, of patterns with and without a vote for poor.
START = (0.99, 0.01)
#: Rules: what is measured against n_words (or lines), above what share the vote is poor, below what share good.
RULES = (
    ("n_symbols", "n_words", 0.2, 0.02),
    ("n_shouts", "n_words", 0.3, 0.05),
    ("n_capitals", "word_chars", 0.5, 0.1),
    ("n_repeat_words", "n_words", 0.35, 0.1),
    ("n_dup_lines", "n_lines", 0.5, 0.05),
    ("n_single", "n_words", 0.3, 0.12),
    ("word_chars", "n_words", 14.0, 9.0),
)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The counts that rules look at, beside ``docs``' columns, which must not be named like them."""
    t = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumn("_words", F.array_remove(F.split(t, SPACES), "")).withColumn(
        "_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACES))
    )
    n = F.size("_words")
    # windows by hash, in order of hash: equal ones stand side by side
    counted = counted.withColumn(
        "_windows",
        F.when(
            n >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), n - 3),
                    lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")),
                )
            ),
        ),
    )
    same = lambda x, k: (x["h"] == F.get("_windows", k - 1)["h"]) | (x["h"] == F.get("_windows", k + 1)["h"])
    starts = F.sort_array(F.transform(F.filter(F.col("_windows"), lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))
    # words under the windows: each start adds the words from it, or from the last window's end, to its own end
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    return counted.select(
        *[F.col(c) for c in docs.columns],
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_shouts"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: F.length(w) == 1)).cast("long").alias("n_single"),
    )


def votes() -> Column:
    """The rules' votes: 0 poor, 1 abstains, 2 good; a text without words or lines gets no vote of a rule that divides by them."""

    def vote(of: str, by: str, high: float, low: float) -> Column:
        of, by = F.col(of).cast("double"), F.col(by).cast("double")
        return F.when((by > 0) & (of > by * high), 0).when((by > 0) & (of < by * low), 2).otherwise(1)

    return F.array(*[vote(*rule) for rule in RULES])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _step(patterns: Column) -> Column:
    """One round: shares of each vote by class under the present posteriors, then the patterns' new posteriors."""
    k = len(RULES)
    total = lambda weight: F.aggregate(patterns, F.lit(0.0), lambda a, p: a + weight(p))
    poor, good = (lambda p: p["n"] * p["poor"]), (lambda p: p["n"] * (1.0 - p["poor"]))

    def logs(weight, everything: Column, prior: tuple[float, float]) -> Column:
        """By rule, the logs of the shares of votes for poor and for good."""
        cast = lambda j, v: F.aggregate(patterns, F.lit(0.0), lambda a, p: a + F.when(F.get(p["votes"], j) == v, weight(p)).otherwise(0.0)) + everything * prior[v // 2]
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: _let(F.struct(cast(j, 0).alias("no"), cast(j, 2).alias("yes")), lambda c: F.struct(F.log(F.try_divide(c["no"], c["no"] + c["yes"])).alias("no"), F.log(F.try_divide(c["yes"], c["no"] + c["yes"])).alias("yes"))))

    def posterior(share: Column) -> Column:
        sum_of = lambda p, table: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda a, j: a + F.when(F.get(p["votes"], j) == 0, F.get(share[table], j)["no"]).when(F.get(p["votes"], j) == 2, F.get(share[table], j)["yes"]).otherwise(0.0))
        return F.transform(
            patterns,
            lambda p: F.struct(
                p["votes"].alias("votes"),
                p["n"].alias("n"),
                (1.0 / (1.0 + F.exp(share["prior_good"] + sum_of(p, "good") - share["prior_poor"] - sum_of(p, "poor")))).alias("poor"),
            ),
        )

    def shares(t: Column) -> Column:
        everything = t["poor"] + t["good"]
        return F.struct(
            logs(poor, everything, PRIOR[0]).alias("poor"),
            logs(good, everything, PRIOR[1]).alias("good"),
            F.log(t["poor"] + everything * PRIOR[0][0]).alias("prior_poor"),
            F.log(t["good"] + everything * PRIOR[0][0]).alias("prior_good"),
        )

    return _let(F.struct(total(poor).alias("poor"), total(good).alias("good")), lambda t: _let(shares(t), posterior))


def pattern_posteriors(counted: DataFrame) -> DataFrame:
    """votes and poor: the posterior chance of being poor of each pattern of votes in ``counted``."""
    sums = counted.groupBy(votes().alias("votes")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    start = F.when(F.array_contains("votes", 0), START[0]).otherwise(START[1])
    gathered = sums.agg(F.sort_array(F.collect_list(F.struct("votes", "n", start.alias("poor")))).alias("patterns"))
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), F.col("patterns"), lambda p, _: _step(p))
    return gathered.select(F.explode(rounds).alias("p")).select("p.votes", "p.poor")


def judge(counted: DataFrame) -> DataFrame:
    """``counted`` (of features()) with base_failed, p_good and kept. It is written once, so that texts are counted once."""
    counted = stored(counted)
    known = pattern_posteriors(counted)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        counted.withColumn("_votes", votes())
        .join(F.broadcast(known.withColumnRenamed("votes", "_votes")), "_votes")  # 3**7 rows at most
        .withColumn("base_failed", failed)
        .withColumn("p_good", 1.0 - F.col("poor"))
        .withColumn("kept", ~failed & (F.col("p_good") >= KEEP))
        .drop("_votes", "poor")
    )


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with ``docs``' columns; columns named like the counts don't clash."""
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    return judge(features(packed, "_text").drop("_text")).where("kept").select("_row.*")


def oracle() -> str:
    """The same in DuckDB, a step at a time."""
    shares = "".join(f", CASE WHEN {by} > 0 AND {of} > {by} * {high}::DOUBLE THEN 0 WHEN {by} > 0 AND {of} < {by} * {low}::DOUBLE THEN 2 ELSE 1 END AS v{j}" for j, (of, by, high, low) in enumerate(RULES))
    names = ", ".join(f"v{j}" for j in range(len(RULES)))
    gone = lambda characters: f"length(t) - length(translate(t, '{characters}', ''))"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    ctes = [
        "t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        rf"w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {blanks}, '')) > 0) AS l FROM t)",
        "g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3)",
        "r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id)",
        f"""f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(translate(t, {blanks}, ''))::BIGINT AS word_chars, ({gone(SYMBOLS)})::BIGINT AS n_symbols,
          (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, ({gone("!")})::BIGINT AS n_shouts, ({gone(CAPITALS)})::BIGINT AS n_capitals,
          len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: length(x) = 1))::BIGINT AS n_single FROM w LEFT JOIN r ON r.doc_id = w.doc_id)""",
        f"v AS (SELECT *{shares} FROM f)",
        f"q0 AS (SELECT {names}, count(*)::DOUBLE AS n, CASE WHEN least({names}) = 0 THEN {START[0]}::DOUBLE ELSE {START[1]}::DOUBLE END AS poor FROM v GROUP BY {names})",
    ]
    for i in range(ITERATIONS):
        sums = "".join(f", sum(CASE WHEN v{j} = {v} THEN n * {w} ELSE 0 END) + sum(n) * {PRIOR[y][v // 2]}::DOUBLE AS {c}{j}_{v}" for j in range(len(RULES)) for v in (0, 2) for y, (c, w) in enumerate((("p", "poor"), ("g", "(1 - poor)"))))
        ctes.append(f"s{i} AS MATERIALIZED (SELECT sum(n * poor) AS p, sum(n * (1 - poor)) AS g, sum(n) * {PRIOR[0][0]}::DOUBLE AS e{sums} FROM q{i})")
        log = lambda c: f"ln({c} + e)" + "".join(f" + (CASE v{j} WHEN 0 THEN ln({c}{j}_0 / ({c}{j}_0 + {c}{j}_2)) WHEN 2 THEN ln({c}{j}_2 / ({c}{j}_0 + {c}{j}_2)) ELSE 0 END)" for j in range(len(RULES)))
        ctes.append(f"q{i + 1} AS MATERIALIZED (SELECT {names}, n, 1 / (1 + exp(({log('g')}) - ({log('p')}))) AS poor FROM q{i}, s{i})")
    failed = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, (NOT {failed} AND 1 - poor >= {KEEP}) AS kept FROM v JOIN q{ITERATIONS} USING ({names})"
