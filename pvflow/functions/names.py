"""PV names, topics and field requests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a PV URI and as a field request.
PV_URI = r"^(pva?|ca)://([a-zA-Z0-9_-]+(?::[a-zA-Z0-9_-]+)*)(\.([a-zA-Z0-9_-]+(?:\.[a-zA-Z0-9_]+)*))?$"
FIELD_REQUEST = r"field\(([^)]*)\)"
DEFAULT_FIELD = "value"


def is_pv_uri(uri: Column) -> Column:
    return uri.rlike(PV_URI)


def pv_parts(uri: Column) -> Column:
    """``struct<protocol, name, field, provider>``, null for text that is no PV URI."""
    protocol = F.regexp_extract(uri, PV_URI, 1)
    field = F.regexp_extract(uri, PV_URI, 4)
    return F.when(
        is_pv_uri(uri),
        F.struct(
            protocol.alias("protocol"),
            F.regexp_extract(uri, PV_URI, 2).alias("name"),
            F.when(field == "", DEFAULT_FIELD).otherwise(field).alias("field"),
            provider(protocol).alias("provider"),
        ),
    )


def provider(protocol: Column) -> Column:
    return F.when(protocol.startswith("pva"), "pva").otherwise("ca")


def snapshot_topic(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9-]", "_"))


def pv_topic(name: Column) -> Column:
    return F.replace(name, F.lit(":"), F.lit("_"))


def requested_fields(request: Column) -> Column:
    """``field(a, b,c)`` -> non-empty names in order, blanks removed."""
    inner = F.regexp_replace(F.regexp_extract(request, FIELD_REQUEST, 1), r"\s", "")
    return F.filter(F.split(inner, ","), lambda f: f != "")
