"""Prompt texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores depend on the exact wording.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CHOICE_TASK = "The goal of this task is to correctly classify an image. Choose the correct option from the list below."
CHOICE_ASK = "Classify the query image. Output only the letter of the correct option."
LABEL_ASK = "Classify the query image. Output only its exact class label."
EXAMPLES = "Labeled reference examples:"
IMAGE = "<image>"


def _lines(*texts: str) -> Column:
    return F.array(*[F.lit(t) for t in texts])


def _examples(labels: Column | None, name: str, blank: int) -> Column:
    """A block for each label; nothing for null or no labels."""
    none = F.array().cast("array<string>")
    if labels is None:
        return none
    each = F.flatten(F.transform(labels, lambda x: F.concat(F.array(F.lit(IMAGE), F.concat(F.lit(f"{name}: "), x)), _lines(*[""] * blank))))
    return F.when(F.size(F.coalesce(labels, none)) > 0, F.concat(_lines(EXAMPLES), each)).otherwise(none)


def multiple_choice(options: Column, labels: Column | None = None) -> Column:
    """``options``: map of letter to label, listed by letter; ``labels``: array of the exemplars' labels, if any."""
    listed = F.transform(F.array_sort(F.map_keys(options)), lambda k: F.concat(k, F.lit(". "), F.element_at(options, k)))
    parts = F.concat(_lines(CHOICE_TASK), listed, _lines(""), _examples(labels, "Reference label", 2), _lines(CHOICE_ASK, IMAGE, "Answer:"))
    return F.array_join(parts, "\n")


def full_label(labels: Column | None = None) -> Column:
    """Without options; ends where the label is to follow."""
    return F.array_join(F.concat(_lines(LABEL_ASK, ""), _examples(labels, "Label", 1), _lines("Query image:", IMAGE, "Label:")), "\n")


def one_shot(label: Column) -> Column:
    """The prompt for one exemplar; a blank label is an error."""
    return F.when(F.trim(label) != "", full_label(F.array(label))).otherwise(F.raise_error(F.lit("the exemplar's label is blank")))
