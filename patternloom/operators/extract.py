"""Variables of lines against their final templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clp
from ..functions.variables import classify, numeric_value


def display_templates(templates: DataFrame) -> DataFrame:
    """pattern_id, template, words: the template as text, variables inside tokens shown as wildcards too."""
    shown = F.array_join(F.transform("words", lambda w: F.when(w == clp.WILDCARD, w).otherwise(clp.display(w))), " ")
    return templates.select("pattern_id", shown.alias("template"), "words")


def extract_variables(assigned: DataFrame, templates: DataFrame) -> DataFrame:
    """line_number, pattern_id, slot (from 0), raw, var_type, num.

    Where the template has a wildcard, the line's whole token is one variable; elsewhere the variables inside the
    token are. Each token is looked at by itself, so no variable can be taken for another's.
    """
    rows = assigned.join(templates.select("pattern_id", "words"), "pattern_id")
    each = F.zip_with("words", clp.tokens(F.col("stripped")), lambda t, raw: F.when(t == clp.WILDCARD, F.array(raw)).otherwise(clp.variables(raw)))
    slots = rows.select("line_number", "pattern_id", F.posexplode(F.flatten(each)).alias("slot", "raw"))
    typed = slots.withColumn("var_type", classify(F.col("raw")))
    return typed.withColumn("num", numeric_value(F.col("raw"), F.col("var_type")))
