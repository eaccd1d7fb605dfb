"""Typed values: tags, inference, validation, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the value types in the change log's format, and in the sorted runs' format (fixed values).
LOG_CODES = {"int": 1, "float": 2, "string": 3}
RUN_CODES = {"int": 0, "float": 1, "string": 2}
INT, FLOAT = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"


def infer_type(text: str) -> Column:
    """int if it is a 64-bit integer, else float if it is a number, else string."""
    c = F.col(text)
    return F.when(c.rlike(INT) & c.try_cast("bigint").isNotNull(), "int").when(F.lower(c).rlike(FLOAT.lower()), "float").when(c.isNotNull(), "string")


def type_code(kind: str, codes: dict[str, int]) -> Column:
    """A tag's code; null for an unknown tag."""
    out = F.lit(None).cast("int")
    for name, code in codes.items():
        out = F.when(F.col(kind) == name, code).otherwise(out)
    return out


def render(kind: str = "type", int_value: str = "int_value", float_value: str = "float_value", string_value: str = "string_value") -> Column:
    """The value as text: whole floats without a point."""
    f = F.col(float_value)
    whole = (f == F.floor(f)) & (F.abs(f) < 1e15)
    return F.when(F.col(kind) == "int", F.col(int_value).cast("string")).when(F.col(kind) == "float", F.when(whole, F.floor(f).cast("string")).otherwise(f.cast("string"))).when(F.col(kind) == "string", F.col(string_value))


def value_error(kind: str, text: str) -> Column:
    """Why a tagged JSON value is refused, or null: strings in quotes, 64-bit integers, finite numbers."""
    k, c = F.col(kind), F.col(text)
    number = c.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$") & c.try_cast("double").isNotNull() & (F.abs(c.try_cast("double")) < float("inf"))
    return (
        F.when((k == "string") & ~c.rlike(r'^".*"$'), "string values must be JSON strings")
        .when((k == "int") & ~(c.rlike(r"^-?(0|[1-9]\d*)$") & c.try_cast("bigint").isNotNull()), "int values must be 64-bit integers")
        .when((k == "float") & ~number, "float values must be numbers")
        .when(~k.isin("string", "int", "float"), "type must be string, int, or float")
    )


def key_error(key: str) -> Column:
    """Why a key is refused, or null: it must not be empty or hold a slash."""
    bad = (F.coalesce(F.col(key), F.lit("")) == "") | F.col(key).contains("/")
    return F.when(bad, "expected a key at /kv/{key}")


def xor_bytes(data: str | Column) -> Column:
    """The 8-bit exclusive or of a binary column's bytes."""
    pairs = F.filter(F.split(F.hex(data), "(?<=\\G..)"), lambda x: x != "")
    return F.aggregate(F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int")), F.lit(0), lambda a, b: a.bitwiseXOR(b))


def xor_number(n: Column) -> Column:
    """The exclusive or of the eight bytes of a number that is not negative."""
    x = n.cast("long")
    for bits in (32, 16, 8):
        x = x.bitwiseXOR(F.shiftright(x, bits))
    return x.bitwiseAND(F.lit(255).cast("long")).cast("int")


def record_checksum(seq: str, deleted: str, kind: str, key: str, value: Column) -> Column:
    """The exclusive or of a whole log record: id, command (1 set, 2 delete), type of a set value, lengths, key, value."""
    code = F.when(F.col(deleted), 0).otherwise(F.coalesce(type_code(kind, LOG_CODES), F.lit(0)))
    text = F.concat(key, F.coalesce(value, F.lit("")))
    parts = [xor_number(F.col(seq)), F.when(F.col(deleted), 2).otherwise(1), code, xor_number(F.octet_length(key)), xor_number(F.coalesce(F.octet_length(value), F.lit(0))), xor_bytes(text.cast("binary"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseXOR(part)
    return out


def format_bytes(n: str) -> Column:
    """MB, KB or bytes; two decimals, halves to the even digit."""
    c = F.col(n)
    return F.when(c >= 1 << 20, F.format_string("%.2f MB", F.bround(c / (1 << 20), 2))).when(c >= 1 << 10, F.format_string("%.2f KB", F.bround(c / (1 << 10), 2))).otherwise(F.format_string("%d bytes", c.cast("long")))


def format_key(i: str, prefix: str = "key_") -> Column:
    """prefix and the number in six digits at least."""
    text = F.col(i).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text))


def percent_change(now: Column, base: Column) -> Column:
    return F.when(base == 0, 0.0).otherwise((now / base - 1) * 100)
