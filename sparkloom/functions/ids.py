"""Deterministic ids from record content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def hash36(c: Column | str) -> Column:
    """33-fold xor hash of the UTF-16 units, 32 bits, in base 36."""
    code = F.encode(col(c), "UTF-16BE")
    units = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(code), F.lit(1)), F.lit(2)), lambda i: F.conv(F.hex(F.substring(code, i, F.lit(2))), 16, 10).cast("bigint"))
    total = F.aggregate(F.filter(units, lambda x: x.isNotNull()), F.lit(5381).cast("bigint"), lambda h, u: ((h * 33) % 4294967296).bitwiseXOR(u))
    return F.lower(F.conv(total.cast("string"), 10, 36))


def synthetic(title: Column | str, department: Column | str, url: Column | str) -> Column:
    """h- and the hash of the parts that aren't blank; null if there is none, or only one that isn't the title."""
    parts = F.filter(F.array(*[F.trim(F.coalesce(col(c), F.lit(""))) for c in (title, department, url)]), lambda x: F.length(x) > 0)
    enough = (F.size(parts) > 1) | (F.length(F.trim(F.coalesce(col(title), F.lit("")))) > 0)
    return F.when(enough, F.concat(F.lit("h-"), hash36(F.array_join(parts, "|"))))
