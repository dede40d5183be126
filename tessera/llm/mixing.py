"""Mixing sources to target weights by hierarchical budgeting.

Sources lie in a tree of domains, languages and sources, each with a weight among its siblings. A budget of tokens (words) is
handed down it. Each child is due its weight's share of its parent's budget, but gets no more than all that lies below it, a
document counting once an epoch; what it can't use goes to its siblings by weight, and only what none of them can use
is missed by the parent and so goes to the parent's siblings. As every parent's limit is known before, one pass down the
tree does that: children in order of limit over weight, the first of them filled up, the others sharing the rest.

A leaf reads its documents in epochs, each in an order of its own by a seeded hash: whole epochs first, then the prefix of the
next one that fits into the budget. To find its end, the leaf's tokens are summed by the upper ``BIN_DIGITS`` digits of the hash;
only the documents of the bin in which the budget ends are put in order. So no task needs a leaf's documents together.

Defined cases: null and empty texts have no tokens and are left out; a null language or source is the empty name; names
without a weight have ``default``, a weight of 0 leaves a branch out; rows of equal ids and leaves are in order of their
text's size; an empty table gives no rows. Weights are whole numbers, budgets are rounded down to whole tokens.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, stored

BIN_DIGITS = 4


@dataclass(frozen=True)
class Plan:
    """Weights by level, the domain of each source, and the budget: ``share`` = (a, b) is a/b of all tokens."""

    domain_of: dict[str, str]
    domains: dict[str, int]
    languages: dict[str, int]
    sources: dict[str, int] = field(default_factory=dict)
    other_domain: str = "other"
    default: int = 1
    epochs: int = 2
    share: tuple[int, int] = (1, 1)
    seed: int = 17


def _lookup(values: dict, name: Column, default) -> Column:
    if not values:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, name), F.lit(default))


def tokens(text: str) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), "")).cast("long")


def leaves_of(plan: Plan, lang: str, source: str) -> dict[str, Column]:
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    return {"_domain": _lookup(plan.domain_of, name, plan.other_domain), "_lang": F.coalesce(F.col(lang).cast("string"), F.lit("")), "_source": name}


def shared_out(children: DataFrame, parents: list[str], weight: Column) -> DataFrame:
    """``children`` (limit, due: the parent's budget) with ``budget``, and without due: each its share by weight, at most its limit."""
    by = Window.partitionBy(*parents)
    order = by.orderBy("_ratio", *[c for c in ("_domain", "_lang", "_source") if c in children.columns])
    upto, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = children.withColumn("_w", weight.cast("long")).withColumn("_ratio", F.when(F.col("_w") > 0, F.col("limit") / F.col("_w").cast("double")).otherwise(float("inf")))
    ranked = ranked.withColumn("_before", F.coalesce(F.sum("limit").over(upto), F.lit(0))).withColumn("_left", F.sum("_w").over(behind))
    ranked = ranked.withColumn("_full", (F.col("_w") > 0) & (F.col("limit") * F.col("_left") <= F.col("_w") * (F.col("due") - F.col("_before"))))
    ranked = ranked.withColumn("_used", F.coalesce(F.sum(F.when(F.col("_full"), F.col("limit"))).over(by), F.lit(0)))
    ranked = ranked.withColumn("_open", F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_w"))).over(by), F.lit(0)))
    rest = F.when(F.col("_open") > 0, F.expr("(_w * (due - _used)) div greatest(_open, 1)")).otherwise(0)
    return ranked.withColumn("budget", F.when(F.col("_full"), F.col("limit")).otherwise(rest)).drop("_w", "_ratio", "_before", "_left", "_full", "_used", "_open", "due")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """``leaves`` (_domain, _lang, _source, tokens) with limit and budget; a row a leaf, however many documents there are."""
    level = [("_domain", plan.domains), ("_lang", plan.languages), ("_source", plan.sources)]
    weights = {c: _lookup(w, F.col(c), plan.default) for c, w in level}
    # what a branch without weight holds is no part of its parent's limit
    counted = F.when(F.least(*[weights[c] for c, _ in level]) > 0, F.col("tokens") * plan.epochs).otherwise(F.lit(0).cast("long"))
    leaves = leaves.withColumn("limit", counted)
    languages = leaves.groupBy("_domain", "_lang").agg(F.sum("limit").alias("limit"))
    domains = languages.groupBy("_domain").agg(F.sum("limit").alias("limit"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    top = shared_out(domains.withColumn("due", F.lit(total * plan.share[0] // plan.share[1])), [], weights["_domain"])
    middle = languages.join(top.select("_domain", F.col("budget").alias("due")), "_domain")
    middle = shared_out(middle, ["_domain"], weights["_lang"])
    bottom = leaves.join(middle.select("_domain", "_lang", F.col("budget").alias("due")), ["_domain", "_lang"])
    return shared_out(bottom, ["_domain", "_lang"], weights["_source"])


LEAF = ["_domain", "_lang", "_source"]


def _in_order(frame: DataFrame, plan: Plan, key: str) -> DataFrame:
    """``frame`` (with whole, the leaf's whole epochs) with _h, the place in the epoch after them, and _bin, its upper digits."""
    h = F.md5(F.concat_ws("|", F.lit(str(plan.seed)), F.col("whole").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return frame.withColumn("_h", h).withColumn("_bin", F.conv(F.substring("_h", 1, BIN_DIGITS), 16, 10).cast("int"))


def mix_sources(docs: DataFrame, plan: Plan, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """row (that of ``docs``), domain, n_tokens, budget (the leaf's) and copies (epochs that take the document) of each row; copies may be 0."""
    leaf = leaves_of(plan, lang, source)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in leaf.items()], F.col(key).alias("_key"), tokens(text).alias("n_tokens"))
    lean = stored(rows.drop("row"))
    sums = stored(lean.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")))
    known = budgets(sums, plan).withColumn("whole", F.coalesce(F.expr("budget div nullif(tokens, 0)"), F.lit(0)))
    known = stored(known.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).drop("limit"))
    # the bin in which each leaf's last epoch ends, and how much of the budget is left there
    bins = _in_order(lean.join(known, LEAF), plan, "_key").groupBy(*LEAF, "_bin").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEAF).orderBy("_bin")))
    ends = bins.where("upto > rest").groupBy(*LEAF).agg(F.min(F.struct("_bin", (F.col("rest") - F.col("upto") + F.col("n")).alias("room"))).alias("end"))
    ends = stored(known.join(ends, LEAF, "left").select(*LEAF, "budget", "whole", F.coalesce("end._bin", F.lit(16**BIN_DIGITS)).alias("_last"), F.coalesce("end.room", F.lit(0)).alias("room")))
    placed = _in_order(rows.join(ends, LEAF), plan, "_key").where("n_tokens > 0")
    more = F.when(F.col("_bin") < F.col("_last"), 1).otherwise(0)
    order = Window.partitionBy(*LEAF).orderBy("_h", "_key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    sure = placed.where("_bin <> _last").withColumn("copies", F.col("whole") + more)
    last = placed.where("_bin = _last").withColumn("_upto", F.sum("n_tokens").over(order))
    last = last.withColumn("copies", F.col("whole") + F.when(F.col("_upto") <= F.col("room"), 1).otherwise(0)).drop("_upto")
    return sure.unionByName(last).select("row", F.col("_domain").alias("domain"), "n_tokens", "budget", F.col("copies").cast("long").alias("copies"))


def mixture(docs: DataFrame, plan: Plan, **columns: str) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, once an epoch, with ``docs``' columns."""
    taken = mix_sources(docs, plan, **columns)
    return taken.where("copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def oracle(plan: Plan) -> str:
    """The same in DuckDB, of documents."""

    def case(values: dict, name: str, default) -> str:
        say = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
        return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {say(v)}" for k, v in sorted(values.items())) + f" ELSE {say(default)} END" if values else say(default)

    def level(name: str, frame: str, parents: str, order: str, weight: str) -> list[str]:
        part = f"PARTITION BY {parents}" if parents else ""
        return [
            f"""{name}_a AS (SELECT *, sum(w) OVER ({part} ORDER BY ratio, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind,
              coalesce(sum(cap) OVER ({part} ORDER BY ratio, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM (SELECT *, CASE WHEN w > 0 THEN cap / w::DOUBLE ELSE 'inf'::DOUBLE END AS ratio FROM (SELECT *, ({weight})::BIGINT AS w FROM ({frame}))))""",
            f"{name}_b AS (SELECT *, w > 0 AND cap * behind <= w * (due - before) AS filled FROM {name}_a)",
            f"""{name} AS (SELECT * EXCLUDE (w, ratio, behind, before, filled, due, used, opened), CASE WHEN filled THEN cap WHEN opened > 0 THEN (w * (due - used)) // opened ELSE 0 END AS budget
              FROM (SELECT *, coalesce(sum(CASE WHEN filled THEN cap END) OVER ({part}), 0) AS used, coalesce(sum(CASE WHEN NOT filled THEN w END) OVER ({part}), 0) AS opened FROM {name}_b))""",
        ]

    weights = [case(plan.domains, "domain", plan.default), case(plan.languages, "lang", plan.default), case(plan.sources, "source", plan.default)]
    ctes = [
        rf"""d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {case(plan.domain_of, "coalesce(source, '')", plan.other_domain)} AS domain,
          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents)""",
        f"leaf AS (SELECT *, CASE WHEN least({', '.join(weights)}) > 0 THEN tokens * {plan.epochs} ELSE 0 END AS cap FROM (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM d GROUP BY domain, lang, source))",
        *level("top", f"SELECT domain, sum(cap) AS cap, (SELECT sum(tokens) * {plan.share[0]} // {plan.share[1]} FROM leaf) AS due FROM leaf GROUP BY domain", "", "domain", weights[0]),
        *level("mid", "SELECT m.*, top.budget AS due FROM (SELECT domain, lang, sum(cap) AS cap FROM leaf GROUP BY ALL) m JOIN top USING (domain)", "domain", "lang", weights[1]),
        *level("bot", "SELECT leaf.*, mid.budget AS due FROM leaf JOIN mid USING (domain, lang)", "domain, lang", "source", weights[2]),
        "k AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM bot)",
        f"""o AS (SELECT d.doc_id, d.domain, d.n_tokens, k.budget, k.whole, k.budget - k.whole * k.tokens AS rest,
          sum(d.n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('{plan.seed}|' || k.whole || '|' || d.doc_id), d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
          FROM d JOIN k USING (domain, lang, source))""",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, domain, n_tokens, budget::BIGINT AS budget, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM o WHERE n_tokens > 0"
