"""Semantic types of variables, and their numeric values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: type names in declaration order, which also breaks ties of a vote
TYPES = ("Integer", "Float", "Duration", "Timestamp", "IPv4", "IPv6", "UUID", "HexID", "Enum", "String")
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"
IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\z"
IPV6 = r"^([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}\z"
DURATION = r"^-?\d+\.?\d*(ns|us|µs|ms|s|m|h)\z"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
FLOAT = r"^(-[+-]?|\+?)([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INTEGER = r"^[+-]?[0-9]+\z"
HEX = r"^(0x)?[0-9a-fA-F]{4,}\z"
#: Milliseconds in a unit.
UNITS = (("ns", 1e-6), ("us", 1e-3), ("µs", 1e-3), ("ms", 1.0), ("s", 1e3), ("m", 6e4), ("h", 3.6e6))
NUMERIC = ("Integer", "Float", "Duration")


def classify(value: Column) -> Column:
    """The type of one value; the first rule that fits."""
    octets = F.split(F.regexp_extract(value, r"^[0-9.]+", 0), r"\.")
    ipv4 = value.rlike(IPV4) & F.forall(octets, lambda o: o.try_cast("int") <= 255)
    return (
        F.when(value.rlike(UUID), "UUID")
        .when(ipv4, "IPv4")
        .when(value.rlike(IPV6), "IPv6")
        .when(value.rlike(DURATION), "Duration")
        .when(value.rlike(TIMESTAMP), "Timestamp")
        .when(value.rlike(FLOAT), "Float")
        .when(value.rlike(INTEGER) & value.try_cast("bigint").isNotNull(), "Integer")
        .when(value.rlike(HEX) & F.regexp_replace(value, "^0x", "").rlike("[a-fA-F]"), "HexID")
        .otherwise("String")
    )


def declaration_order(var_type: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TYPES]), var_type)


def numeric_value(value: Column, var_type: Column) -> Column:
    """Numbers as they are, durations in milliseconds; null for other types."""
    number = F.regexp_extract(value, r"^-?\d+\.?\d*", 0).try_cast("double")
    unit = F.regexp_extract(value, r"([a-zµ]+)\z", 1)
    factor = F.lit(None).cast("double")
    for name, ms in UNITS:
        factor = F.when(unit == name, F.lit(ms)).otherwise(factor)
    plain = F.regexp_replace(value, r"^-?\+", "").try_cast("double")
    return F.when(var_type == "Duration", number * factor).when(var_type.isin("Integer", "Float"), plain)
