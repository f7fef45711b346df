"""Column names and types of the flow log and its side tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, types and order of the columns as the data have them.
#: Order of the 33 components of X.
FEATURES: list[str] = ["proto", *(f"f{i}" for i in range(32))]

FLOW_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.LongType()),
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("label", T.ByteType()),
        *(T.StructField(c, T.FloatType()) for c in FEATURES),
    ]
)

META_STRINGS = ["srcip", "dstip", "conn", "service", "seg_src", "seg_dst"]
META_NUMBERS = ["sport", "dport", "l3l4", "label_src", "label_dst", "ext_src", "ext_dst"]

SECOND = 1_000_000  # µs
