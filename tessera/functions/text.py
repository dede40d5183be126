"""Text as columns: keys, terms, tags, spans, sentences. All are expressions but the two that need Unicode tables and the places of cues, which are sought from sign to sign."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Words without content of their own.
STOP_WORDS = (
    "a an the of or and is are am do does did their they them her his she he it its this that these those with in on at "
    "to for from by as was were be been being have has had feel feels felt like patient patients how what where when which why"
).split()
#: Words that a clause may start with and that say nothing about it. Negations are none of them.
CONNECTIVES = (
    "and but or nor yet so then thus therefore however moreover furthermore additionally also while whereas although though which who with"
).split()
#: What a period may follow inside a sentence.
ABBREVIATIONS = "dr mr mrs ms prof vs approx no fig e.g i.e etc yr yrs y.o wk hr min sec mg ml kg cm mm iu st b.i.d t.i.d q.d p.o i.v".split()


def collapse(x: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def stripped(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def label_key(x: Column) -> Column:
    """Collapsed, without quotes around it, lower case."""
    return F.lower(collapse(F.btrim(F.btrim(x), F.lit("\"'"))))


def slug(x: Column) -> Column:
    """Letters and digits joined by underscores; "unknown" if there are none."""
    s = F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", "unknown").otherwise(s)


def candidate_key(x: Column) -> Column:
    """Slashes and white space as underscores, other signs kept."""
    return F.regexp_replace(F.btrim(F.replace(F.lower(x), F.lit("/"), F.lit(" "))), r"\s+", "_")


def answer_key(x: Column) -> Column:
    """Letters and digits in lower case with single spaces."""
    return F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def bare_answer(x: Column) -> Column:
    """Collapsed, lower case, without spaces and periods at the ends."""
    return F.btrim(F.lower(collapse(x)), F.lit(" ."))


def item_key(x: Column) -> Column:
    """An item of a list: no bullet before it, no periods after it, lower case."""
    return F.lower(F.rtrim(F.btrim(collapse(x), F.lit(" -*•")), F.lit(".")))


def cue_key(x: Column) -> Column:
    return F.lower(collapse(x))


@F.udf(StringType(), useArrow=False)
def _compatible(x: str | None) -> str | None:
    return None if x is None else unicodedata.normalize("NFKC", x)


def compatible(x: Column) -> Column:
    """Compatible forms of signs. Python is given null for texts in ASCII, and 100 rows at a time, where Arrow would bring 10,000."""
    return F.coalesce(_compatible(F.when(x.rlike(r"[^\x00-\x7F]"), x)), x)


def plain_signs(x: Column) -> Column:
    """Compatible forms, straight quotes, hyphens, single spaces."""
    return collapse(F.translate(compatible(x), "’‘“”–—", "''\"\"--"))


@F.pandas_udf(StringType())
def _unescaped(x: pd.Series) -> pd.Series:
    import html

    return x.map(html.unescape, na_action="ignore")


def unescape(x: Column) -> Column:
    """HTML entities as signs, then collapsed. Python is given null for texts without an ampersand."""
    return collapse(F.coalesce(_unescaped(F.when(F.contains(x, F.lit("&")), x)), x))


def escape(x: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def has_term(text: Column, term: Column) -> Column:
    """A term of several words occurs anywhere; a single word between signs that are no letters or digits. Case doesn't matter."""
    text, term = F.lower(text), F.lower(F.btrim(term))
    alone = F.concat(F.lit(r"(?<![a-z0-9])\Q"), term, F.lit(r"\E(?![a-z0-9])"))
    return F.when(term == "", False).when(F.contains(term, F.lit(" ")), F.contains(text, term)).otherwise(F.regexp_like(text, alone))


def terms_in(text: Column, terms: Column) -> Column:
    """Those of ``terms`` that ``text`` has, in their order."""
    return F.filter(terms, lambda t: has_term(text, t))


def new_terms(output: Column, prompt: Column, terms: Column) -> Column:
    """Terms as whole words of ``output`` that ``prompt`` lacks."""
    word = lambda t: F.concat(F.lit(r"(?i)(?<!\w)\Q"), t, F.lit(r"\E(?!\w)"))
    return F.filter(terms, lambda t: F.regexp_like(output, word(t)) & ~F.regexp_like(prompt, word(t)))


def same_answer(a: Column, b: Column) -> Column:
    """Answers whose keys are equal or one within the other; null if either is empty."""
    a, b = answer_key(a), answer_key(b)
    return F.when((a != "") & (b != ""), (a == b) | F.contains(a, b) | F.contains(b, a))


def same_id(a: Column, b: Column) -> Column:
    a, b = answer_key(a), answer_key(b)
    return F.when((a != "") & (b != ""), a == b)


def _either_way(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def right_answer(answer: Column, gold: Column, aliases: Column) -> Column:
    """The answer lies in the gold name or an alias, or the other way; false without an answer."""
    said = bare_answer(answer)
    names = F.concat(F.array(gold), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.coalesce(F.exists(names, lambda n: _either_way(said, bare_answer(n))), F.lit(False))


def place_in(list_: Column, gold: Column) -> Column:
    """The first place (from 1) of a name that matches either way, or null."""
    hits = F.transform(list_, lambda n: F.coalesce(_either_way(bare_answer(n), bare_answer(gold)), F.lit(False)))
    at = F.array_position(hits, True)
    return F.when(at > 0, at)


#: How an answer is stated, up to a period or the text's end. In all but the answer, white space is of any kind.
STATED = r"(?dU)[Tt]he\s+answer\s+is\s+(.+?)\s*(?:\.|$)"


def stated_answer(x: Column) -> Column:
    """What is stated as the answer, collapsed; null if none is."""
    return F.when(x.rlike(STATED), collapse(F.regexp_extract(x, STATED, 1)))


def chosen_option(answer: Column, options: Column) -> Column:
    """Place of the option chosen: the first number of one to three digits in the first 120 signs that is one, else the only option named."""
    numbers = F.transform(F.regexp_extract_all(F.substring(F.btrim(answer), 1, 120), F.lit(r"(?<!\d)(\d{1,3})(?!\d)"), F.lit(1)), lambda n: n.cast("int"))
    number = F.get(F.filter(numbers, lambda n: n.between(1, F.size(options))), F.lit(0))
    named = F.filter(F.transform(options, lambda o, i: F.when(has_term(answer, o), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(number, F.when(F.size(named) == 1, F.get(named, F.lit(0))))


def listed_options(x: Column, after: str) -> Column:
    """Names of lines "N. name" behind a marker."""
    lines = F.split(F.substring_index(x, after, -1), "\n")
    return F.transform(F.filter(lines, lambda s: s.rlike(r"^\s*\d+\.\s+\S")), lambda s: F.btrim(F.regexp_extract(s, r"^\s*\d+\.\s+(.*)$", 1)))


def tag_body(x: Column, tag: str) -> Column:
    """Body of the first such tag, or null."""
    pattern = rf"(?is)<{tag}>(.*?)</{tag}>"
    return F.when(x.rlike(pattern), F.btrim(F.regexp_extract(x, pattern, 1)))


def list_items(x: Column) -> Column:
    """Items between line ends, semicolons, commas and bullets, of two signs at least."""
    parts = F.split(x, r"[\n;,]|(?:^|\s)[-*•](?=\s)")
    return F.filter(F.transform(parts, lambda p: F.btrim(collapse(p), F.lit(" -*•"))), lambda p: F.length(p) >= 2)


def supported(items: Column, known: Column) -> Column:
    """Items that lie in one of ``known`` or the other way; case doesn't matter."""
    return F.filter(items, lambda i: F.exists(known, lambda k: F.contains(F.lower(k), F.lower(i)) | F.contains(F.lower(i), F.lower(k))))


def distinct_by_case(x: Column) -> Column:
    """The first of each spelling, in order."""
    return F.filter(x, lambda v, i: F.array_position(F.transform(x, lambda w: F.lower(w)), F.lower(v)) == i + 1)


def stem(w: Column) -> Column:
    """Without a first ending of ing, ed, es, s while over four letters are there; each ending is tried once, in that order."""
    cut = F.lit(None).cast("string")
    for ending in reversed(("ing", "ed", "es", "s")):
        cut = F.when((F.length(w) > 4) & F.endswith(w, F.lit(ending)), F.substring(w, F.lit(1), F.length(w) - len(ending))).otherwise(cut)
    return F.coalesce(cut, w)


def content_tokens(x: Column) -> Column:
    """Distinct stems of the words that aren't stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"([a-z0-9()]+)"), F.lit(1)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), stem))


def token_recall(gold: Column, said: Column) -> Column:
    """Share of the gold's content tokens that are said; null if it has none."""
    return tokens_said(gold, content_tokens(said))


def tokens_said(gold: Column, said: Column) -> Column:
    """``token_recall`` where ``said`` is content tokens already."""
    tokens = content_tokens(gold)
    return F.try_divide(F.size(F.array_intersect(tokens, said)).cast("double"), F.size(tokens).cast("double"))


def nth_place(text: Column, part: Column, occurrence: Column) -> Column:
    """Start (from 0) of the n-th (from 0) place of ``part``, places not overlapping, case aside; -1 if there are fewer."""
    text, part = F.lower(text), F.lower(part)
    step = lambda at, _: F.when(at == 0, F.lit(0)).otherwise(F.call_function("locate", part, text, F.when(at < 0, 1).otherwise(at + F.length(part))))
    return F.aggregate(F.sequence(F.lit(0), occurrence), F.lit(-1), step) - 1


def _places(text: str, cues: Iterable[str | None], counted: bool) -> list[tuple | None]:
    """Of each cue start, end and, if counted, how often it stands before its start, places not overlapping."""
    out, ahead = [], 0
    for cue in cues:
        if cue is None or text is None:
            out.append(None)
            continue
        # an empty cue stands at the beginning
        at = 0 if cue == "" else text.find(cue, ahead)
        at = text.find(cue) if at < 0 else at
        if at >= 0:
            ahead = at + len(cue)
        out.append(None if at < 0 else (at, ahead, text.count(cue, 0, at) if cue else 0)[: 3 if counted else 2])
    return out


def _sought(fields: list[str], counted: bool):
    @F.pandas_udf(ArrayType(StructType([StructField(n, IntegerType()) for n in fields])))
    def found(texts: pd.Series, cues: pd.Series) -> pd.Series:
        return pd.Series([None if xs is None else _places(text, xs, counted) for text, xs in zip(texts, cues)], dtype=object)

    return found.asNondeterministic()  # so that no filter works it out again


_spans, _counted_spans = _sought(["start", "end"], False), _sought(["start", "end", "occurrence"], True)


def cue_spans(text: Column, cues: Column) -> Column:
    """start and end (from 0, half open) of each cue: from where the one before it ended, else from the beginning; null if it is nowhere."""
    return _spans(text, cues)


def counted_cue_spans(text: Column, cues: Column) -> Column:
    """``cue_spans`` with occurrence: places of the cue before its own."""
    return _counted_spans(text, cues)


def overlapping(spans: Column) -> Column:
    """Whether two of the spans share a sign."""
    by = F.array_sort(F.filter(spans, lambda s: s.isNotNull()))
    first = F.struct(F.lit(False).alias("met"), F.lit(0).alias("end"))
    return F.aggregate(by, first, lambda a, s: F.struct((a["met"] | (s["start"] < a["end"])).alias("met"), s["end"].alias("end")), lambda a: a["met"])


def put_at(text: Column, span: Column, other: Column) -> Column:
    """``text`` with ``other`` in place of the span."""
    return F.concat(F.substring(text, F.lit(1), span["start"]), other, F.substring(text, span["end"] + 1, F.length(text)))


def cut_at(text: Column, span: Column) -> Column:
    """``text`` without the span, spaces and commas tidied."""
    left = put_at(text, span, F.lit(""))
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(left, r"\s+", " "), r"\s+([,.;])", "$1"), r",(?:\s*,)+", ","))


def taken_out(text: Column, span: Column) -> Column:
    """``text`` without the span: two spaces as one, no space before a comma or a period, one comma of two that a space parts, nothing blank at the ends; each once from the left, in this order."""
    left = put_at(text, span, F.lit(""))
    for found, tidy in (("  ", " "), (" ,", ","), (" .", "."), (", ,", ",")):
        left = F.replace(left, F.lit(found), F.lit(tidy))
    return stripped(left)


def sentences(x: Column) -> Column:
    """Pieces between an end mark and a capital or digit; not behind an abbreviation."""
    known = F.array(*[F.lit(a) for a in ABBREVIATIONS])

    def short(s: Column) -> Column:
        last = F.rtrim(F.element_at(F.split(F.lower(F.rtrim(s)), r"[\s(]"), -1), F.lit("."))
        return F.endswith(F.rtrim(s), F.lit(".")) & F.array_contains(known, last)

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & short(last), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat_ws(" ", last, part)))).otherwise(F.concat(done, F.array(part)))

    joined = F.aggregate(F.split(x, r"(?<=[.!?])\s+(?=[A-Z0-9])"), F.array().cast("array<string>"), step)
    return F.filter(F.transform(joined, lambda s: F.btrim(s)), lambda s: s != "")


def clauses(sentence: Column, most: int) -> Column:
    """A sentence of over ``most`` words in its clauses."""
    parts = F.filter(F.transform(F.split(sentence, r";\s+|,\s+(?=(?:and|with|which|who|but)\s)"), lambda p: F.btrim(p, F.lit(" ,;"))), lambda p: p != "")
    return F.when(F.size(F.split(F.btrim(sentence), r"\s+")) <= most, F.array(sentence)).otherwise(parts)


def clean_clause(x: Column, least: int) -> Column:
    """Without end marks and leading connectives, as long as ``least`` words are left."""
    words = F.split(F.btrim(F.btrim(F.btrim(x), F.lit(".,;:!? "))), r"\s+")
    known = F.array(*[F.lit(w) for w in CONNECTIVES])
    start = F.aggregate(
        words,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, w: F.when(a["on"] & F.array_contains(known, F.btrim(F.lower(w), F.lit(","))) & (F.size(words) - a["n"] - 1 >= least), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("on"))),
        lambda a: a["n"],
    )
    return F.array_join(F.slice(words, start + 1, F.size(words)), " ")


def segments(x: Column, least: int, most: int, cap: int | None = None) -> Column:
    """Clauses of ``least`` to ``most`` words that have letters, none equal to or within another that was kept before."""
    found = F.transform(F.flatten(F.transform(sentences(x), lambda s: clauses(s, most))), lambda c: clean_clause(c, least))
    count = lambda c: F.size(F.split(c, r"\s+"))
    fit = F.filter(found, lambda c: count(c).between(least, most) & c.rlike("[A-Za-z]{3,}") & F.contains(x, c))
    lies = lambda a, b: F.contains(F.lower(a), F.lower(b))
    kept = F.aggregate(fit, F.array().cast("array<string>"), lambda done, c: F.when(F.exists(done, lambda d: lies(d, c) | lies(c, d)), done).otherwise(F.concat(done, F.array(c))))
    return kept if cap is None else F.slice(kept, 1, cap)


#: Words that ask, and what a question to the reader asks about.
ASKING = ("what", "which", "how")
ASKED_ABOUT = (r"diagnos\w*", "differential", "mechanism", "management", "next step", "work-?up")
#: What says that all is as usual.
FORMULAS = ("unremarkable", "within normal limits", "were normal", "was normal", "no abnormalit", "non-?contributory")


#: A sentence with a question mark in which a word that asks comes before one that it asks about.
QUESTION = rf"(?i)[^.!?]*\b(?:{'|'.join(ASKING)})\b[^.!?]*\b(?:{'|'.join(ASKED_ABOUT)})\b[^.!?]*\?"


def without_questions(x: Column) -> Column:
    """Questions put to the reader go."""
    return collapse(F.regexp_replace(x, QUESTION, " "))


def asks_reader(x: Column) -> Column:
    return x.rlike(QUESTION)


def is_formula(x: Column) -> Column:
    """Says that all is as usual."""
    return x.rlike(rf"(?i)\b({'|'.join(FORMULAS)})\b")


def mentions(text: Column, label: Column) -> Column:
    label = F.lower(collapse(label))
    return (label != "") & F.contains(F.lower(collapse(text)), label)


def quoted_parts(x: Column, least: int = 12, most: int = 400) -> Column:
    """What stands in double quote marks, in order, as it is and as often as it does."""
    return F.regexp_extract_all(x, F.lit(rf'["“]([^"“”]{{{least},{most}}})["”]'), F.lit(1))


def quotes(x: Column, least: int = 12, most: int = 400) -> Column:
    """What stands in quote marks, none within a longer one."""
    found = F.array_distinct(F.transform(quoted_parts(x, least, most), collapse))
    return F.filter(found, lambda q: ~F.exists(found, lambda o: (F.length(o) > F.length(q)) & F.contains(o, q)))


def longest_shared_run(a: Column, b: Column) -> Column:
    """Words of the longest run of ``a`` that ``b`` has too: at each word the longest run so far is grown by one while ``b`` has that."""
    words = F.filter(F.split(answer_key(a), " "), lambda w: w != "")
    padded = F.concat(F.lit(" "), answer_key(b), F.lit(" "))
    state = lambda ws, i, best: F.struct(ws.alias("ws"), i.alias("i"), best.alias("best"))

    def step(s: Column, _: Column) -> Column:
        longer = F.concat(F.lit(" "), F.array_join(F.slice(s["ws"], s["i"] + 1, s["best"] + 1), " "), F.lit(" "))
        fits = (s["i"] + s["best"] < F.size(s["ws"])) & F.contains(padded, longer)
        return state(s["ws"], F.when(fits, s["i"]).otherwise(s["i"] + 1), F.when(fits, s["best"] + 1).otherwise(s["best"]))

    # a step goes on by a word or grows the run by one
    steps = F.sequence(F.lit(0), 2 * F.size(words))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(steps, state(words, F.lit(0), F.lit(0)), step, lambda s: s["best"]))


def and_list(x: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(x)
    return F.when(n <= 2, F.array_join(x, " and ")).otherwise(F.concat(F.array_join(F.slice(x, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(x, -1)))


def numbered(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v)), "\n")


def shortened(x: Column, most: int) -> Column:
    """At most ``most`` signs, the last three dots where some were cut."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)


def cut_chain(x: Column, share: Column) -> Column:
    """The first ``share`` of a text, back to the last sentence end before which something stands: a period before a space or a line end, or another end mark before a space. Nothing is cut of a whole text; null is empty."""
    text = F.coalesce(x, F.lit(""))
    most = F.floor(F.length(text) * share).cast("int")
    head = F.substring(text, F.lit(1), most)
    ended = F.regexp_extract(head, r"(?s)^(.+(?:\.(?=[ \n])|[!?](?= )))", 1)
    cut = F.regexp_replace(F.when(ended != "", ended).otherwise(head), r"(?U)\s+$", "")
    part = F.when(most >= F.length(text), text).otherwise(cut)
    return F.when(share.between(0, 1), part).otherwise(F.raise_error(F.lit("share must lie between 0 and 1")).cast("string"))


def cjk_share(x: Column) -> Column:
    """Share of signs in the CJK, kana and hangul ranges; 0 for an empty text."""
    n = F.regexp_count(x, F.lit(r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"))
    return F.coalesce(F.try_divide(n.cast("double"), F.length(x).cast("double")), F.lit(0.0))


#: Signs of a phrase that was put together badly.
ODD_PATTERNS = {
    "leftover_question_mark": r"\?",
    "second_person": r"(?i)\byou(?:r)?\b",
    "double_subject": r"(?i)\bthe patient\b.*\bthe patient\b",
    "uppercase_code": r"\b(?:[A-Z]{2,}\d*|[A-Z]_?\d+)\b",
    "empty_parens": r"\(\s*\)",
}


def odd_flags(x: Column, known: tuple[str, ...] = ()) -> Column:
    """Names of the patterns found; codes that are all known don't count."""
    names = []
    for name, pattern in ODD_PATTERNS.items():
        # letters of any alphabet are part of a word, and only a line end ends a line
        found = F.regexp_extract_all(x, F.lit(f"(?Ud)({pattern})"), F.lit(1))
        left = F.array_except(found, F.array(*[F.lit(k) for k in known]).cast("array<string>")) if name == "uppercase_code" and known else found
        names.append(F.when(F.size(left) > 0, F.lit(name)))
    return F.filter(F.array(*names), lambda n: n.isNotNull())
