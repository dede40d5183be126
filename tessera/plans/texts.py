"""Keys, terms, tags, items, spans and sentences over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import cues as C
from tessera.functions import text as X
from tessera.operators.judging import first_class, scored_readouts
from tessera.operators.terms import term_matches as matches
from tessera.plans.catalogue import query, table

#: Terms looked for: single words stand alone, several words anywhere.
TERMS = ("the", "of", "and the", "on", "les", "der", "queen")


def _terms():
    return F.array(*[F.lit(t) for t in TERMS])


def _has(text: str, term: str) -> str:
    return f"contains(lower({text}), '{term}')" if " " in term else f"regexp_matches(lower({text}), '(^|[^a-z0-9]){term}($|[^a-z0-9])')"


@query(
    "text_keys",
    r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_replace(trim(replace(lower(p_name || '/' || p_type), '/', ' ')), '\s+', '_', 'g') AS candidate,
  trim(regexp_replace(lower(p_brand || '  ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS answer, trim(lower(' ' || p_name || ' ...'), ' .') AS bare FROM part""",
)
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    return p.select("p_partkey", X.slug(F.concat(name, F.lit(" / "), kind, F.lit("!"))).alias("slug"), X.candidate_key(F.concat(name, F.lit("/"), kind)).alias("candidate"), X.answer_key(F.concat(brand, F.lit("  "), kind)).alias("answer"), X.bare_answer(F.concat(F.lit(" "), name, F.lit(" ..."))).alias("bare"))


@query("term_hits", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_has('text', t)} THEN '{t}' END" for t in TERMS) + "], lambda x: x IS NOT NULL), '|') AS hits FROM documents")
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.terms_in(F.col("text"), _terms()), "|").alias("hits"))


@query(
    "term_matches",
    """WITH t AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM benchmark UNION SELECT DISTINCT array_to_string(string_split_regex(lower(text), '\\s+')[2:3], ' ') FROM benchmark),
w AS (SELECT DISTINCT event_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM (SELECT conv_id * 1000 + turn AS event_id, text FROM conversations))
SELECT event_id AS turn_id, term FROM w JOIN t USING (term) WHERE term <> '' UNION ALL SELECT c.conv_id * 1000 + c.turn, t.term FROM conversations c JOIN t ON contains(t.term, ' ') AND contains(lower(c.text), t.term)""",
)
def term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, and pairs of words, of the benchmark in turns."""
    benchmark = table(spark, sf_dir, "benchmark")
    words = benchmark.select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("term"))
    pairs = benchmark.select(F.array_join(F.slice(F.split(F.lower("text"), r"\s+"), 2, 2), " ").alias("term"))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return matches(turns, "turn_id", "text", words.unionByName(pairs), "term")


@query(
    "new_terms",
    "SELECT a.conv_id, a.turn, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(b.text), '(^|[^a-z0-9_]){t}($|[^a-z0-9_])') AND NOT regexp_matches(lower(a.text), '(^|[^a-z0-9_]){t}($|[^a-z0-9_])') THEN '{t}' END" for t in TERMS) + "], lambda x: x IS NOT NULL), '|') AS fresh FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'",
)
def new_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    fresh = X.new_terms(F.col("output"), F.col("text"), _terms())
    return turns.where("role = 'user'").join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join(fresh, "|").alias("fresh"))


@query("tag_bodies", "SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, regexp_matches(html, '(?is)<h1>(.*?)</h1>') AS has_heading FROM pages")
def tag_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.tag_body(F.col("html"), "title").alias("title"), X.tag_body(F.col("html"), "h1").isNotNull().alias("has_heading"))


@query("item_lists", r"SELECT item_id, len(list_filter(list_transform(regexp_split_to_array(text, '[\n;,]'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'), ' -*•')), lambda p: length(p) >= 2)) AS n_items, list_filter(list_transform(regexp_split_to_array(text, '[\n;,]'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'), ' -*•')), lambda p: length(p) >= 2)[1] AS first FROM benchmark")
def item_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = X.list_items(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(items).cast("long").alias("n_items"), F.get(items, F.lit(0)).alias("first"))


_STEM = "CASE WHEN length(w) > 4 AND ends_with(w, 'ing') THEN left(w, -3) WHEN length(w) > 4 AND ends_with(w, 'ed') THEN left(w, -2) WHEN length(w) > 4 AND ends_with(w, 'es') THEN left(w, -2) WHEN length(w) > 4 AND ends_with(w, 's') THEN left(w, -1) ELSE w END"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _tokens(text: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({text}), '[a-z0-9()]+'), lambda w: w NOT IN ({_STOP})), lambda w: {_STEM}))"


@query(
    "token_recall",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {_tokens('a.text')} AS x, {_tokens('b.text')} AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')
SELECT conv_id, turn, len(list_intersect(x, y))::DOUBLE / nullif(len(x), 0) AS recall FROM p""",
)
def token_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    return turns.where("role = 'user'").join(after, ["conv_id", "turn"]).select("conv_id", "turn", X.token_recall(F.col("text"), F.col("said")).alias("recall"))


@query(
    "odd_phrases",
    r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(text, '?') THEN 'leftover_question_mark' END, CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])your?($|[^\p{L}\p{N}_])') THEN 'second_person' END,
  CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])the patient[^\p{L}\p{N}_\n](.*[^\p{L}\p{N}_\n])?the patient($|[^\p{L}\p{N}_])') THEN 'double_subject' END, CASE WHEN regexp_matches(text, '(^|[^\p{L}\p{N}_])([A-Z]{2,}\d*|[A-Z]_?\d+)($|[^\p{L}\p{N}_])') THEN 'uppercase_code' END,
  CASE WHEN regexp_matches(text, '\(\s*\)') THEN 'empty_parens' END], lambda x: x IS NOT NULL), '|') AS flags FROM documents""",
)
def odd_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.odd_flags(F.col("text")), "|").alias("flags"))


@query("cjk_shares", "SELECT doc_id, coalesce(len(regexp_extract_all(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]'))::DOUBLE / nullif(length(text), 0), 0) AS cjk FROM documents")
def cjk_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.cjk_share(F.col("text")).alias("cjk"))


@query("shortened_texts", "SELECT item_id, CASE WHEN length(text) > 120 THEN left(text, 117) || '...' ELSE text END AS short FROM benchmark")
def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", X.shortened(F.col("text"), 120).alias("short"))


@query(
    "cut_chains",
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, (doc_id % 5) / 4::DOUBLE AS share FROM documents), h AS (SELECT *, left(text, floor(length(text) * share)::INT) AS head FROM t),
m AS (SELECT *, list_max(list_transform(['. ', '.' || chr(10), '! ', '? '], lambda m: CASE WHEN contains(head, m) THEN length(head) - length(m) - strpos(reverse(head), reverse(m)) + 1 ELSE -1 END)) AS mark FROM h)
SELECT doc_id, md5(CASE WHEN length(head) >= length(text) THEN text WHEN mark > 0 THEN rtrim(left(head, mark + 1), ' ' || chr(9) || chr(10) || chr(13)) ELSE rtrim(head, ' ' || chr(9) || chr(10) || chr(13)) END) AS head FROM m""",
)
def cut_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.pmod("doc_id", F.lit(5)) / 4.0
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.cut_chain(F.col("text"), share).cast("binary")).alias("head"))


@query(
    "stated_answers",
    """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN role WHEN 1 THEN NULL WHEN 2 THEN ': ' || role WHEN 3 THEN NULL ELSE role || ' of ' || turn END AS stated FROM conversations""",
)
def stated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that end by stating an answer: up to a period, in capitals, with a colon, with another line behind, and up to the end."""
    role, turn = F.col("role"), F.col("turn").cast("string")
    ends = [F.concat(F.lit(" The answer is "), role, F.lit(". Yes.")), F.concat(F.lit(" THE ANSWER IS "), role), F.concat(F.lit(" the  answer is : "), role, F.lit(".")), F.concat(F.lit(" The answer is "), role, F.lit("\nmore")), F.concat(F.lit(" The answer\nis "), role, F.lit("  of "), turn, F.lit(" \n"))]
    said = F.concat("text", F.get(F.array(*ends), F.pmod("turn", F.lit(5)).cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.stated_answer(said).alias("stated"))


@query("escaped", "SELECT page_id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.escape(F.col("url")).alias("escaped"))


@query("sentence_segments")
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of 4 to 14 words."""
    return table(spark, sf_dir, "benchmark").select("item_id", X.segments(X.collapse(F.col("text")), 4, 14).alias("segments"))


@query("plain_titles")
def plain_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without entities and with plain signs."""
    return table(spark, sf_dir, "pages").select("page_id", X.plain_signs(X.unescape(X.tag_body(F.col("html"), "title"))).alias("title"))


@query("shared_runs")
def shared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of words that a question shares with the turn that answers it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    return turns.where("role = 'user'").join(after, ["conv_id", "turn"]).select("conv_id", "turn", X.longest_shared_run(F.col("text"), F.col("said")).alias("run"))


def _hits(text: str) -> str:
    return f"len(list_filter([{', '.join(_has(text, t) for t in TERMS)}], lambda h: h))"


@query(
    "scored_readouts",
    rf"""WITH o AS (SELECT item_id, trim(regexp_replace(split_part(text, '.', 1), '\s+', ' ', 'g')) AS ans, trim(regexp_replace(text, '\s+', ' ', 'g')) AS obs FROM benchmark),
l AS (SELECT *, ans || '<' || obs AS whole, list_filter(list_transform(string_split_regex(obs, '[;,]'), lambda p: trim(p, ' -*•')), lambda p: length(p) >= 2) AS items FROM o)
SELECT item_id, {_hits('ans')} > 0 AS answer_hit, {_hits('whole')} > 0 AS output_hit, {_hits('obs')} / {len(TERMS)}::DOUBLE AS cue_recall, {_hits('whole')} / {len(TERMS)}::DOUBLE AS output_cue_recall,
  len(list_filter(items, lambda i: {' OR '.join(f"contains('{t}', lower(i)) OR contains(lower(i), '{t}')" for t in TERMS)}))::DOUBLE / nullif(len(items), 0) AS cue_precision FROM l""",
)
def scored_readout_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts dressed as readouts that answer with their first sentence, scored against all terms."""
    answer = F.concat(F.lit("<readout><answer>"), F.substring_index("text", ".", 1), F.lit("</answer><observed>"), F.col("text"), F.lit("</observed></readout>"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", answer.alias("output"), _terms().alias("aliases"), _terms().alias("cues"))
    return scored_readouts(rows, "output", "aliases", "cues").select("item_id", "answer_hit", "output_hit", "cue_recall", "output_cue_recall", "cue_precision")


@query("case_classes", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value > 150) THEN 'big' WHEN bool_or(event_type = 'error' AND value > 100) THEN 'failed' WHEN bool_or(event_type = 'click') THEN 'seen' ELSE 'none' END AS class FROM events GROUP BY user_id")
def case_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    rules = [("big", (kind == "purchase") & (value > 150)), ("failed", (kind == "error") & (value > 100)), ("seen", kind == "click")]
    return table(spark, sf_dir, "events").groupBy("user_id").agg(first_class(rules, "none").alias("class"))


@query(
    "entry_parts",
    """WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '_@_V' || user_id WHEN 1 THEN event_type || ':' || user_id ELSE event_type END AS entry FROM events)
SELECT event_id, CASE WHEN contains(entry, '_@_') THEN split_part(entry, '_@_', 1) WHEN contains(entry, ':') THEN split_part(entry, ':', 1) ELSE entry END AS item, CASE WHEN contains(entry, '_@_') THEN split_part(entry, '_@_', 2) WHEN contains(entry, ':') THEN split_part(entry, ':', 2) END AS value FROM e""",
)
def entry_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, user = F.pmod("event_id", F.lit(3)), F.col("user_id").cast("string")
    entry = F.when(m == 0, F.concat("event_type", F.lit("_@_V"), user)).when(m == 1, F.concat("event_type", F.lit(":"), user)).otherwise(F.col("event_type"))
    item, value = C.entry_parts(F.col("entry"))
    return table(spark, sf_dir, "events").select("event_id", entry.alias("entry")).select("event_id", item.alias("item"), value.alias("value"))


#: A small questionnaire, by event type.
QUESTIONS = {"click": "Do you have pain in your chest?", "view": "Are you coughing?", "signup": "Have you had a fever?", "error": "What colour is the rash?", "purchase": "Is your skin dry?"}


@query("rendered_cues")
def rendered_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different entries of the events, rendered once each, with how often they occur."""
    labels = F.array(*[F.lit(x) for x in ("yes", "no", "NA", "V_29", "3", "chest")])
    entries = table(spark, sf_dir, "events").select("event_type", F.get(labels, F.pmod("user_id", F.lit(6)).cast("int")).alias("value_label")).groupBy("event_type", "value_label").agg(F.count(F.lit(1)).alias("n"))
    asked = F.create_map(*[F.lit(x) for kv in QUESTIONS.items() for x in kv])
    return C.rendered(entries.withColumn("question", asked[F.col("event_type")]))
