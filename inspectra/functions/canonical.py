"""A value's one JSON text, whatever order its fields came in, and its hash: for records whose content must be provable later."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The short escapes of JSON by UTF-16 code unit.
SHORT = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r"}


def json_text(text: Column) -> Column:
    """A JSON string in ASCII: what is not printable ASCII becomes \\uXXXX by UTF-16 code unit."""

    def unit(u: Column) -> Column:
        out = F.when((u >= "0020") & (u <= "007E"), F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))
        for code, short in SHORT.items():
            out = F.when(u == code, F.lit(short)).otherwise(out)
        return out

    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    plain = text.rlike(r"\A[ !#-\[\]-~]*\z")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(units, unit), "")), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON without blanks, keys sorted, nulls kept. Dates, times and decimals are their texts (a time in UTC, to the microsecond where it has any)."""
    if isinstance(kind, T.StringType):
        out = json_text(value)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        out = value.cast("string")
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        raise TypeError("binary fractions have no one text: store a decimal")
    elif isinstance(kind, T.TimestampType):
        utc = F.to_utc_timestamp(value, F.current_timezone())
        micros = F.when(F.unix_micros(value) % 1_000_000 != 0, F.date_format(utc, ".SSSSSS")).otherwise("")
        out = F.concat(F.lit('"'), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), micros, F.lit('+00:00"'))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = [F.concat(json_text(F.lit(f.name)), F.lit(":"), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")) if fields else F.lit("{}")
    else:
        out = json_text(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(out)


def content_hash(value: Column, kind: T.DataType) -> Column:
    """SHA-256 of the canonical JSON, lowercase hex."""
    return F.sha2(canonical_json(value, kind), 256)
