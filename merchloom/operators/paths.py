"""Reading and writing one field of product documents by its path.

Paths are dotted, with a number for a place in an array (images.0.alt), or variants[<id>].field; provenance[<key>].member
reads where a field is from, the keys of variants' fields included.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VARIANT = re.compile(r"^variants\[([^\]]+)\]\.(\w+)$")
_PROVENANCE = re.compile(r"^provenance\[(.+)\]\.(\w+)$")
_PLACE = re.compile(r"^(\w+)\.(\d+)\.(\w+)$")


def read_path(path: str) -> Column:
    """The value at a path as a column; null where a variant of that id, or a holder, is missing."""
    if m := _VARIANT.match(path):
        return F.get(F.filter("variants", lambda v: v["id"] == m[1]), F.lit(0))[m[2]]
    if m := _PROVENANCE.match(path):
        return F.try_element_at("provenance", F.lit(m[1]))[m[2]]
    if m := _PLACE.match(path):
        return F.get(m[1], F.lit(int(m[2])))[m[3]]
    return F.col(path)


def write_path(products: DataFrame, product_id: str, path: str, value: object) -> DataFrame:
    """One product with another value at a path; a variant, holder or field that is missing changes nothing."""
    hit = F.col("id") == product_id
    if m := _VARIANT.match(path):
        known = {f.name: f.dataType for f in products.schema["variants"].dataType.elementType.fields}
        if m[2] not in known:
            return products
        changed = F.transform("variants", lambda v: F.when(v["id"] == m[1], v.withField(m[2], F.lit(value).cast(known[m[2]]))).otherwise(v))
        return products.withColumn("variants", F.when(hit, changed).otherwise(F.col("variants")))
    if (m := _PLACE.match(path)) and m[1] in products.columns:
        known = {f.name: f.dataType for f in getattr(getattr(products.schema[m[1]].dataType, "elementType", None), "fields", [])}
        if m[3] not in known:
            return products
        at = F.transform(m[1], lambda x, i: F.when(i == int(m[2]), x.withField(m[3], F.lit(value).cast(known[m[3]]))).otherwise(x))
        return products.withColumn(m[1], F.when(hit, at).otherwise(F.col(m[1])))
    top, _, rest = path.partition(".")
    if top not in products.columns:
        return products
    kind = products.schema[top].dataType
    if not rest:
        return products.withColumn(top, F.when(hit, F.lit(value).cast(kind)).otherwise(F.col(top)))
    for name in rest.split("."):
        found = {f.name: f.dataType for f in getattr(kind, "fields", [])}
        if name not in found:
            return products
        kind = found[name]
    return products.withColumn(top, F.when(hit & F.col(top).isNotNull(), F.col(top).withField(rest, F.lit(value).cast(kind))).otherwise(F.col(top)))
