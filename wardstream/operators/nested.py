"""Deeply nested records into flat tables that keep their parents.

Everything is one projection of higher-order SQL over VARIANT values per content item. A fold walks the
levels: its state holds the containers of the present level, each with its path from the top; nested
``transform`` calls attach path and index to their children, ``flatten`` joins them into the next level,
and the nodes a table needs are kept. One ``inline`` per target table emits the rows. The fold stops working
when a level is empty; it may take as many turns as a text has opening brackets, so no depth is cut off. The whole expression sits inside the generator, so no tree is ever written to a row.

A key given twice in one object keeps its last value, as the session is told to read such objects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_END = "~~ end of the element ~~"  # no text of a record has this as its last element by chance
_NODE = "struct<p:string,v:variant,ips:boolean>"


def _object(s: str) -> str:
    """SQL: the VARIANT of a text that as a whole is a JSON object, else null.

    The parser itself stops after the first value and ignores what follows, so the text is parsed, once, as
    the first of two elements of an array; only if the second is ours was the whole text one value.
    """
    both = f"try_variant_get(try_parse_json(concat('[', {s}, ',\"{_END}\"]')), '$', 'array<variant>')"
    return f"if({s} rlike '^[ \\\\t\\\\r\\\\n]*[{{]', get(transform(array({both}), b -> if(size(b) = 2 and try_variant_get(b[1], '$', 'string') = '{_END}', b[0], null)), 0), null)"


_CHILDREN = f"""
flatten(transform(acc.f, n -> concat(
    coalesce(transform(map_entries(try_variant_get(n.v, '$', 'map<string,variant>')), e ->
      cast(struct(if(n.p = '', e.key, concat(n.p, '.', e.key)) as p,
           coalesce(if(e.key = 'IPs', cast(null as variant), {{parsed_e}}), e.value) as v, e.key = 'IPs' as ips) as {_NODE})), cast(array() as array<{_NODE}>)),
    coalesce(transform(try_variant_get(n.v, '$', 'array<variant>'), (x, k) ->
      cast(struct(concat(n.p, '[', k, ']') as p,
           coalesce(if(n.ips, cast(null as variant), {{parsed_x}}), x) as v, false as ips) as {_NODE})), cast(array() as array<{_NODE}>)))))
"""


def _text(v: str) -> str:
    """SQL: the value if it is a string that may hold an object."""
    return f"case when left(schema_of_variant({v}), 6) = 'STRING' then variant_get({v}, '$', 'string') end"


def _nodes(keep: str) -> str:
    """SQL: the nodes inside the report ``content_text`` for which ``keep`` (of ``n.p, n.v, n.ips``) holds; none if it is no report."""
    children = _CHILDREN.format(parsed_e=_object(_text("e.value")), parsed_x=_object(_text("x")))
    state = f"struct<f:array<{_NODE}>,o:array<{_NODE}>,q:int>"
    top = f"filter(array(cast(struct('' as p, {_object('content_text')} as v, false as ips) as {_NODE})), n -> n.v is not null)"
    most = "coalesce(length(content_text) - length(translate(content_text, '{[', '')), 0) + 1"
    step = f"(acc, i) -> if(size(acc.f) = 0, acc, cast(struct({children} as f, concat(acc.o, filter(acc.f, n -> {keep})) as o, acc.q as q) as {state}))"
    start = f"cast(struct({top} as f, array() as o, cast(ceil(power({most}, 0.25)) as int) as q) as {state})"
    loop = "acc"
    for _ in range(4):  # q ** 4 turns; a loop inside a loop, as the state is copied at each turn and an outer turn that finds no work has none inside
        loop = f"aggregate(if(size(acc.f) = 0, array(), sequence(1, acc.q)), {loop}, {step})"
        step = f"(acc, i) -> {loop}"
        loop = "acc"
    return f"get(transform(array({start}), acc -> {step.removeprefix('(acc, i) -> ')}), 0).o"


def _elements(narratives: DataFrame) -> DataFrame:
    lenient_objects(narratives.sparkSession)
    return narratives.select("narrative_id", F.posexplode("content").alias("content_pos", "content_text")).withColumn("content_pos", F.col("content_pos").cast("long"))


def lenient_objects(spark: SparkSession) -> None:
    """Let the session read an object with a key given twice (its last value holds) instead of refusing the whole text."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def content_items(narratives: DataFrame) -> DataFrame:
    """One row per element of ``content``: ``narrative_id, content_pos`` (from 0, nulls included), ``content_text``, ``is_report``.

    ``is_report`` tells whether the element, trimmed, is a JSON object. Null and empty arrays have no rows.
    """
    return _elements(narratives).withColumn("is_report", F.expr(f"({_object('content_text')}) is not null"))


_ADDRESS = "'^\\\\s*([0-9]+\\\\.[0-9]+\\\\.[0-9]+\\\\.[0-9]+)\\\\s*$'"


def addresses(narratives: DataFrame) -> DataFrame:
    """One row per IPv4 address under a key ``IPs`` of a report: ``narrative_id, content_pos, parent_path, json_path, ip``.

    An element of ``content`` is a report if, trimmed, it is a JSON object. A string that itself is a
    JSON object counts as that object, except under a key ``IPs``. Null and empty arrays, texts that don't
    parse and entries that are no address have no rows; one given twice has two.
    """
    keep = "struct(n.p as parent_path, {path} as json_path, regexp_extract({text}, " + _ADDRESS + ", 1) as ip)"
    many = f"transform(try_variant_get(n.v, '$', 'array<variant>'), (x, k) -> {keep.format(path="concat(n.p, '[', k, ']')", text=_text('x'))})"
    one = f"array({keep.format(path='n.p', text=_text('n.v'))})"
    flat = f"filter(flatten(transform({_nodes('n.ips')}, n -> coalesce({many}, {one}))), a -> a.ip <> '')"
    out = _elements(narratives).select("narrative_id", "content_pos", F.inline(F.expr(flat)))
    return out.withColumn("parent_path", F.expr("left(parent_path, length(parent_path) - if(parent_path = 'IPs', 3, 4))"))


def hosts(narratives: DataFrame) -> DataFrame:
    """One row per object of a report that has a key ``Hostname``: ``narrative_id, content_pos, host_path, hostname`` (null if no string), ``reported_at``, ``privileged`` (as text)."""
    get = lambda k: f"try_variant_get(n.v, '$.{k}', 'string')"
    keep = "array_contains(map_keys(try_variant_get(n.v, '$', 'map<string,variant>')), 'Hostname')"
    flat = f"transform({_nodes(keep)}, n -> struct(n.p as host_path, {get('Hostname')} as hostname, {get('Time')} as reported_at, {get('Privileged')} as privileged))"
    return _elements(narratives).select("narrative_id", "content_pos", F.inline(F.expr(flat)))


def narrative_table(narratives: DataFrame) -> DataFrame:
    """One row per narrative with its scalar fields; the category in lower case, trimmed, and the size of its arrays (0 for null)."""
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    return narratives.select("narrative_id", "subject", F.lower(F.trim("category")).alias("category"), "phase", size(F.col("segments")).alias("n_segments"), size(F.col("steps_submitted_time")).alias("n_steps"), size(F.col("content")).alias("n_items"))
