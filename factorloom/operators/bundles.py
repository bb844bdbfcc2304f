"""Nested documents from several views: sorted arrays of structs by key, one JSON line a document, and back to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factorloom.sources.shared import new_path


def listed(df: DataFrame, by: str, name: str, order: list[str], fields: list[Column], most: int | None = None) -> DataFrame:
    """One row a key: an array of structs of the fields, sorted by `order`, the first `most` of them. A key's rows are one series."""
    held = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*fields).alias("_v"))))
    held = F.transform(held, lambda x: x["_v"])
    return df.groupBy(by).agg((held if most is None else F.slice(held, 1, most)).alias(name))


def joined(parts: list[DataFrame], by: str) -> DataFrame:
    """The documents: every key that any part has, with all parts' columns."""
    return reduce(lambda a, b: a.join(b, by, "full"), parts)


def written(documents: DataFrame, by: str) -> DataFrame:
    """Write one JSON line a document and read it back under the same schema."""
    path = new_path(documents.sparkSession)
    documents.select(F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return documents.sparkSession.read.schema(documents.schema).json(path)


def rows(documents: DataFrame, by: str) -> DataFrame:
    """Every number of a document: by, key, pos (its place in the array), label (the texts of its struct) and field, value."""
    out = []
    for f in documents.schema.fields:
        if f.name == by:
            continue
        one: StructType = f.dataType.elementType
        texts = [x.name for x in one if x.dataType.typeName() == "string"]
        numbers = [x.name for x in one if x.dataType.typeName() != "string"]
        each = documents.select(by, F.posexplode(f.name).alias("pos", "x"))
        values = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"x.{n}").cast("double").alias("value")) for n in numbers))
        label = F.concat_ws(" ", *(F.col(f"x.{t}") for t in texts)) if texts else F.lit("")
        out.append(each.select(by, F.lit(f.name).alias("key"), "pos", label.alias("label"), F.explode(values).alias("v")).select(by, "key", "pos", "label", "v.field", "v.value"))
    return reduce(DataFrame.unionByName, out)
