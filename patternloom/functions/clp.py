"""Tokenising lines into constants and variables, and the compact encoding of variables.

A variable is a maximal run of letters, digits and ``+-._`` that has a digit, or directly follows ``=`` and
has a letter, or is all hexadecimal and at least two long. In a logtype each variable is replaced by one
character that tells its kind. White space ends every run, so a line's logtype is its tokens' logtypes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: placeholders of integer, dictionary and float variables, and the escape character
INT, DICT, FLOAT, ESCAPE = "\x11", "\x12", "\x13", "\\"
WORD = r"A-Za-z0-9+\-._"
VARIABLE = rf"(?<![{WORD}])(?:(?=[A-Za-z+\-._]*[0-9])[{WORD}]++|(?<==)(?=[0-9+\-._]*[A-Za-z])[{WORD}]++|[0-9A-Fa-f]{{2,}}+(?![{WORD}]))"
#: White space of Unicode, as a character class.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
WILDCARD = "<*>"
#: Widths of an encoded variable in bytes: the largest integer and the largest float digits they hold.
LIMITS = {8: ("bigint", 2**54 - 1), 4: ("int", 2**25 - 1)}


def tokens(text: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(text, SPACE + "+"), lambda t: t != "")


def variables(text: Column) -> Column:
    """The variables of a text, in order."""
    return F.regexp_extract_all(text, F.lit(VARIABLE), F.lit(0))


def kind(var: Column, width: int = 8) -> Column:
    """"I", "F" or "D": how a variable is encoded."""
    int_type, most = LIMITS[width]
    digits = F.regexp_replace(var, "[-.]", "")
    is_int = var.rlike(r"^(0|-?[1-9][0-9]*)$") & var.try_cast(int_type).isNotNull()
    is_float = (F.octet_length(var) <= 18) & var.rlike(r"^-?[0-9]*\.[0-9]+$") & (digits.try_cast("decimal(20,0)") <= F.lit(most))
    return F.when(is_int, "I").when(is_float, "F").otherwise("D")


def escape(text: Column) -> Column:
    """Constants: an escape before placeholders and escapes."""
    return F.regexp_replace(text, r"([\\\x11\x12\x13])", r"\\$1")


def logtype(text: Column, width: int = 8) -> Column:
    """The text with variables replaced by placeholders."""
    mark = lambda v: F.when(kind(v, width) == "I", INT).when(kind(v, width) == "F", FLOAT).otherwise(DICT)
    marks = F.concat(F.transform(variables(text), mark), F.array(F.lit("")))
    marked = F.array_join(F.zip_with(F.split(text, VARIABLE, -1), marks, lambda c, m: F.concat(escape(c), m)), "")
    return F.when(text.rlike(VARIABLE), marked).otherwise(escape(text))


def display(logtype_text: Column) -> Column:
    """A logtype as people read it: placeholders as ``<*>``, escapes undone."""
    shown = F.regexp_replace(logtype_text, r"(?<!\\)((?:\\\\)*)[\x11\x12\x13]", "$1" + WILDCARD)
    shown = F.regexp_replace(shown, r"(?<!\\)((?:\\\\)*)[\x11\x12\x13]", "$1" + WILDCARD)  # neighbours
    return F.regexp_replace(shown, r"\\([\\\x11\x12\x13])", "$1")


def encode_int(var: Column, width: int = 8) -> Column:
    return var.try_cast(LIMITS[width][0])


def encode_float(var: Column, width: int = 8) -> Column:
    """Sign, digits, number of digits less one, and digits after the point less one, packed in 64 or 32 bits."""
    digits = F.regexp_replace(var, "[-.]", "")
    n = F.length(digits) - 1
    after = F.length(F.regexp_extract(var, r"\.([0-9]*)$", 1)) - 1
    value = digits.try_cast("bigint")
    negative = F.startswith(var, F.lit("-"))
    if width == 8:
        packed = F.shiftleft(value, 8).bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(15)), 4).cast("bigint")).bitwiseOR(after.bitwiseAND(F.lit(15)).cast("bigint"))
        return F.when(negative, packed.bitwiseOR(F.lit(-(2**63)))).otherwise(packed)
    packed = F.shiftleft(value, 6).bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(7)), 3).cast("bigint")).bitwiseOR(after.bitwiseAND(F.lit(7)).cast("bigint"))
    return F.when(negative, packed - F.lit(2**31)).otherwise(packed).cast("int")


def decode_int(code: Column) -> Column:
    return code.cast("string")


def decode_float(code: Column, width: int = 8) -> Column:
    """The text an encoded float stands for."""
    code = code.cast("bigint")
    if width == 8:
        value, n, after = F.shiftrightunsigned(code, 8).bitwiseAND(F.lit(2**54 - 1)), F.shiftrightunsigned(code, 4).bitwiseAND(F.lit(15)), code.bitwiseAND(F.lit(15))
    else:
        value, n, after = F.shiftrightunsigned(code.bitwiseAND(F.lit(2**31 - 1)), 6), F.shiftrightunsigned(code, 3).bitwiseAND(F.lit(7)), code.bitwiseAND(F.lit(7))
    n, after = F.greatest((n + 1).cast("int"), F.length(value.cast("string"))), (after + 1).cast("int")  # 17 digits overflow the field
    digits = F.lpad(value.cast("string"), n, F.lit("0"))
    return F.concat(F.when(code < 0, "-").otherwise(""), digits.substr(F.lit(1), n - after), F.lit("."), digits.substr(n - after + 1, after))


def encode_message(text: Column, width: int = 8) -> Column:
    """Struct of logtype, encoded_vars (integers and floats) and dictionary_vars (strings), in order."""
    found = variables(text)
    coded = F.transform(F.filter(found, lambda v: kind(v, width) != "D"), lambda v: F.when(kind(v, width) == "I", encode_int(v, width)).otherwise(encode_float(v, width)))
    return F.struct(logtype(text, width).alias("logtype"), coded.alias("encoded_vars"), F.filter(found, lambda v: kind(v, width) == "D").alias("dictionary_vars"))


def decode_message(logtype_text: Column, encoded_vars: Column, dictionary_vars: Column, width: int = 8) -> Column:
    """The text that :func:`encode_message` was given; variables that are missing are left out."""
    parts = F.regexp_extract_all(logtype_text, F.lit(r"(?s)\\.|[\x11\x12\x13]|[^\\\x11\x12\x13]+|\\$"), F.lit(0))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("e"), F.lit(0).alias("d"))

    def step(acc: Column, p: Column) -> Column:
        number = F.get(encoded_vars, acc["e"])
        value = (
            F.when(p == INT, F.coalesce(decode_int(number), F.lit("")))
            .when(p == FLOAT, F.coalesce(decode_float(number, width), F.lit("")))
            .when(p == DICT, F.coalesce(F.get(dictionary_vars, acc["d"]), F.lit("")))
            .when(F.startswith(p, F.lit(ESCAPE)), p.substr(F.lit(2), F.length(p)))
            .otherwise(p)
        )
        return F.struct(
            F.concat(acc["out"], value).alias("out"), (acc["e"] + F.when((p == INT) | (p == FLOAT), 1).otherwise(0)).alias("e"), (acc["d"] + F.when(p == DICT, 1).otherwise(0)).alias("d")
        )

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def placeholder_counts(logtype_text: Column) -> Column:
    """Struct of encoded and dictionary: how many placeholders of either sort a logtype has."""
    bare = F.regexp_replace(logtype_text, r"(?s)\\.", "")
    return F.struct(F.regexp_count(bare, F.lit(r"[\x11\x13]")).alias("encoded"), F.regexp_count(bare, F.lit(r"\x12")).alias("dictionary"))
