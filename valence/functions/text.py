"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


_BLANKS = " \t\n\x0b\f\r"  # fixed: what the regular expression \\s stands for


def tokens(text: Column | str) -> Column:
    """Lower-cased words, cut at every single whitespace character.

    Gives what ``pyspark.ml.feature.Tokenizer`` gives, as an expression inside codegen:
    inner empty words stay, trailing ones go, blank text has no words, null stays null.
    """
    text = F.col(text) if isinstance(text, str) else text
    trimmed = F.rtrim(text, F.lit(_BLANKS))
    return F.when((trimmed == "") & (text != ""), F.array().cast("array<string>")).otherwise(
        F.split(F.lower(trimmed), r"\s")
    )


def preview(text: Column | str, length: int = 50) -> Column:
    """The first characters of a text, followed by an ellipsis."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def percent(value: Column | str, decimals: int = 1) -> Column:
    """A number already in percent, formatted like ``%87.5``.

    Rounds the number as it is stored, and halves to even, as Python's formatting does.
    """
    return F.concat(F.lit("%"), F.translate(F.format_number(value, decimals), ",", ""))
