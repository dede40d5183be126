"""Prompts and training targets as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import cut_chain, stripped

#: Role, what ends an answer, what is asked.
ROLE = "You are an expert physician."
ANSWER_FORMAT = 'You MUST end your response with exactly "The answer is <diagnosis>."'
ANSWER_CUE = "The answer is"
DIRECT = f"What is the single most likely diagnosis?\n\n{ANSWER_FORMAT}"
REASONED = f"Work through this case as a natural reasoning process.\n\nThink about:\n- What the key clinical findings suggest\n- Which diagnoses fit the presentation and which do not\n- Whether your conclusion holds up under scrutiny\n\n{ANSWER_FORMAT}"
#: What stands before a question that is to be answered with a diagnosis, with and without a reason.
FIRST_ANSWER = "Answer the clinical question with the most likely diagnosis or syndrome first"
QUESTION = "\n\nQuestion: "
INSTRUCTIONS = {"direct": DIRECT, "cot": REASONED}


def descriptor(age: Column, sex: Column) -> Column:
    """"A 34-year-old woman" from an age and a sex (first letter M or F), each of which may be missing or odd."""
    years = F.when(age.cast("string").try_cast("double").isNotNull(), age.cast("string").try_cast("double").cast("int"))
    code = F.coalesce(F.substring(F.upper(stripped(sex)), 1, 1), F.lit(""))
    young = F.coalesce(years < 18, F.lit(False))
    noun = (
        F.when(code == "M", F.when(young, "boy").otherwise("man")).when(code == "F", F.when(young, "girl").otherwise("woman"))
        .otherwise(F.when(young, "child").otherwise("patient"))
    )
    return F.when(years.isNull(), F.concat(F.lit("A "), noun)).otherwise(F.concat(F.lit("A "), years.cast("string"), F.lit("-year-old "), noun))


def findings(cues: Column, age: Column, sex: Column) -> Column:
    """A presentation as a list of cues."""
    listed = F.array_join(F.transform(cues, lambda c: F.concat(F.lit("- "), c)), "\n")
    return F.concat(F.lit(ROLE + " "), descriptor(age, sex), F.lit(" presents with the following findings:\n"), listed)


def as_written(text: Column) -> Column:
    """A presentation as prose."""
    return F.concat(F.lit(f"{ROLE} A patient presents as follows:\n\n"), stripped(text))


def _known(condition: Column, choices: dict[str, Column]) -> Column:
    out = F.raise_error(F.concat(F.lit("unknown condition: "), F.coalesce(condition, F.lit("null")))).cast("string")
    for name, x in choices.items():
        out = F.when(condition == name, x).otherwise(out)
    return out


def instructed(prefix: Column, condition: Column) -> Column:
    """A presentation and its condition's instruction; an unknown condition is an error."""
    return _known(condition, {name: F.concat(prefix, F.lit("\n\n" + x)) for name, x in INSTRUCTIONS.items()})


def early_answer(prefix: Column, chain: Column, share: Column) -> Column:
    """The reasoned prompt with a part of its chain and the answer forced."""
    return F.concat(prefix, F.lit(f"\n\n{REASONED}\n\n"), cut_chain(chain, share), F.lit(f"\n\n{ANSWER_CUE}"))


def asked(prompt: Column, mode: Column) -> Column:
    """``prompt`` as it is (raw), or as a question whose answer is to start with the diagnosis, with a reason (diagnosis_first) or without one (question); another mode is an error."""
    reasoned = F.concat(F.lit(f"{FIRST_ANSWER}, in one short sentence. Then give one brief reason.{QUESTION}"), prompt)
    return _known(mode, {"raw": prompt, "diagnosis_first": reasoned, "question": F.concat(F.lit(f"{FIRST_ANSWER}.{QUESTION}"), prompt)})


def surface(prefix: Column, name: Column) -> Column:
    """A candidate as it follows ``prefix``: a space before it unless that is empty or ends in one."""
    return F.when((F.coalesce(prefix, F.lit("")) == "") | prefix.rlike(r"\s$"), name).otherwise(F.concat(F.lit(" "), name))


def option_surface(number: Column, name: Column, style: Column) -> Column:
    """A numbered option as an answer gives it: its number, or number and name (number_and_name); another style is an error."""
    n = number.cast("string")
    return _known(style, {"number": n, "number_and_name": F.concat(n, F.lit(". "), name)})
