"""Nested records as flat tables, by Dewey labels.

Every node of a record gets the path of ordinals that leads to it (``[2, 0]`` is the
first child of the third element) and the path of its schema (``table[][]``).  The
label of the parent is the label without its last ordinal, so parent and child rows
can be joined without any generated key, and nodes of one schema path form a table.
The labels are built inside each record by array expressions of a size linear in the depth
of the schema: one scan, one explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import let

_NODE = "array<struct<path: string, label: array<int>, filled: boolean, value: string>>"
_BLANK = r"(?U)^[\s\p{Z}]*$"


def blank(c: Column) -> Column:
    """True for null and for nothing but white space, no-break spaces included."""
    return c.isNull() | c.rlike(_BLANK)


def _node(path: str, label: Column, filled: Column, value: Column) -> Column:
    return F.struct(
        F.lit(path).alias("path"), label.alias("label"), filled.alias("filled"), value.cast("string").alias("value")
    )


def _walk(c: Column, kind: T.DataType, path: str, label: Column) -> Column:
    """Nodes at and below ``c``, itself first; null containers have no children."""
    if isinstance(kind, T.ArrayType):
        step = lambda x, i: _walk(x, kind.elementType, f"{path}[]", F.concat(label, F.array(i)))
        below = F.coalesce(F.flatten(F.transform(c, step)), F.array().cast(_NODE))
    elif isinstance(kind, T.StructType):
        parts = [
            _walk(c.getField(f.name), f.dataType, f"{path}.{f.name}", F.concat(label, F.array(F.lit(i))))
            for i, f in enumerate(kind.fields)
        ]
        below = F.when(c.isNotNull(), F.concat(*parts)).otherwise(F.array().cast(_NODE)) if parts else F.array().cast(_NODE)
    elif isinstance(kind, T.MapType):
        return _walk(F.map_entries(c), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])), path, label)
    else:
        return F.array(_node(path, label, ~blank(c.cast("string")), c)).cast(_NODE)
    # the nodes below are named once: they are used twice, and again by every level above
    here = lambda nodes: _node(path, label, F.exists(nodes, lambda n: n["filled"]), F.lit(None))
    return let(below, lambda nodes: F.concat(F.array(here(nodes)).cast(_NODE), nodes))


def dewey_nodes(df: DataFrame, key: str, columns: list[str], more: Column | None = None) -> DataFrame:
    """(key, path, label, parent, filled, value): one row per node of ``columns``.

    ``label`` and ``parent`` are arrays of ordinals, which sort in the order of the record;
    the root of a column has an empty label and a null parent.  ``filled`` says whether
    a node or anything below it is not blank.  Null columns have a root and no children;
    columns of the same name elsewhere in ``df`` are not read.  ``more`` is an array of
    further nodes (path, label, filled, value) of each record.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    empty = F.array().cast("array<int>")
    nodes = F.concat(*[_walk(F.col(f"`{c}`"), kinds[c], c, empty) for c in columns], *([] if more is None else [more.cast(_NODE)]))
    flat = df.select(F.col(key), F.explode(nodes).alias("n")).select(key, "n.*")
    size = F.size("label")
    return flat.select(
        key,
        "path",
        "label",
        F.when(size > 0, F.slice("label", 1, F.greatest(size - 1, F.lit(0)))).alias("parent"),
        "filled",
        "value",
    )


def dotted(label: Column) -> Column:
    """A label as text, its ordinals joined by dots."""
    return F.array_join(F.transform(label, lambda x: x.cast("string")), ".")


def node_tables(nodes: DataFrame, paths: list[str]) -> dict[str, DataFrame]:
    """The table of each schema path, a filter over the same nodes."""
    return {p: nodes.where(F.col("path") == p).drop("path") for p in paths}


def unpack_json_lists(c: Column) -> Column:
    """An array of texts in which an element holding a JSON list stands for its elements."""
    one = lambda e: F.when(
        e.rlike(r"^\s*\["), F.coalesce(F.from_json(e, "array<string>"), F.array(e))
    ).otherwise(F.array(e))
    return F.flatten(F.transform(c, one))


def pointers(c: Column) -> Column:
    """Pointers of an array of references: (kind, number) of ``table_3``, ``TEXT_0`` and of the keys of dictionaries."""
    keys = lambda e: F.concat(
        F.regexp_extract_all(e, F.lit(r"(?i)^\s*((?:table|text)[_ -]?[0-9]+)\s*$"), 1),
        F.regexp_extract_all(e, F.lit(r"(?i)[{,]\s*[\"']\s*((?:table|text)[_ -]?[0-9]+)\s*[\"']\s*:"), 1),
    )
    found = F.flatten(F.transform(F.filter(c, lambda e: e.isNotNull()), keys))
    split = lambda p: F.struct(
        F.lower(F.regexp_extract(p, "(?i)(table|text)", 1)).alias("kind"),
        F.regexp_extract(p, "([0-9]+)", 1).try_cast("int").alias("number"),
    )
    return F.array_distinct(F.transform(found, split))


def report_children(records: DataFrame) -> DataFrame:
    """(rec_no, path, label, parent, filled, value) of report records, evidence links included.

    Sentences, table rows and cells are nodes of ``pre_text[]``, ``post_text[]``,
    ``table[]`` and ``table[][]``.  A pointer to row k is a node ``gold_table`` whose label
    is that of the row, a pointer to sentence k one of ``gold_text``; ``filled`` says
    whether the pointer leads to a row or sentence that is not blank, counting sentences
    through ``pre_text`` and on through ``post_text``.  A repeated pointer counts once.
    """
    texts = records.select(
        "rec_no",
        F.coalesce(unpack_json_lists(F.col("pre_text")), F.array().cast("array<string>")).alias("pre_text"),
        F.col("`table`").alias("table"),
        F.coalesce(unpack_json_lists(F.col("post_text")), F.array().cast("array<string>")).alias("post_text"),
        pointers(F.col("qa.gold_inds")).alias("links"),
    )
    sentences = F.concat("pre_text", "post_text")
    row_filled = lambda k: F.coalesce(F.exists(F.get("table", k), lambda x: ~blank(x)), F.lit(False))
    link = lambda kind, ok: F.transform(
        F.filter("links", lambda p: p["kind"] == kind), lambda p: _node(f"gold_{kind}", F.array(p["number"]), ok(p["number"]), F.lit(None))
    )
    links = F.concat(link("table", row_filled), link("text", lambda k: ~blank(F.get(sentences, k))))
    return dewey_nodes(texts, "rec_no", ["pre_text", "table", "post_text"], F.coalesce(links, F.array().cast(_NODE)))


# The kinds of child rows by schema path.
KINDS = {
    "pre_text[]": "pre_text",
    "post_text[]": "post_text",
    "table[]": "table_row",
    "table[][]": "table_cell",
    "gold_table": "gold_table",
    "gold_text": "gold_text",
}


def child_rows(records: DataFrame) -> DataFrame:
    """(rec_no, child_kind, pos, sub_pos, parent, value) of all children that are not blank."""
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return (
        report_children(records)
        .where(F.col("filled") & F.col("path").isin(*KINDS))
        .select(
            "rec_no",
            F.try_element_at(kinds, F.col("path")).alias("child_kind"),
            F.get("label", F.lit(0)).cast("long").alias("pos"),
            F.when(F.col("path") == "table[][]", F.get("label", F.lit(1))).otherwise(F.lit(-1)).cast("long").alias("sub_pos"),
            dotted(F.col("parent")).alias("parent"),
            "value",
        )
    )
