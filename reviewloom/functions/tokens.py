"""The tokenizer as a Spark column: maximal runs of ASCII letters and digits, folded after the split."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column | str) -> Column:
    """Array of tokens; empty for null or token-less text.

    translate() folds ASCII only, which equals folding after the split: no other letter (such as U+212A) can turn
    into an ASCII one. All three calls are whole-stage-codegen expressions.
    """
    c = F.col(text) if isinstance(text, str) else text
    folded = F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(folded, "[^a-z0-9]+"), ""), F.array().cast("array<string>"))


def token_count(text: Column | str) -> Column:
    return F.size(tokens(text)).cast("bigint")


def fold(c: Column | str) -> Column:
    """Lookup arguments are lower-cased but not split."""
    return F.lower(F.col(c) if isinstance(c, str) else c)
