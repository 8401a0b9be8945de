import json
import random
import re

from ledgerloom.operators import nested

SCHEMA = (
    "rec_no long, id string, pre_text array<string>, `table` array<array<string>>, post_text array<string>, "
    "qa struct<question: string, program: string, exe_ans: string, gold_inds: array<string>>, filename string, path string, label string"
)


def blank(x):
    return x is None or not x.strip()


def unpack(texts):
    out = []
    for t in texts or []:
        if t is not None and t.lstrip().startswith("["):
            try:
                got = json.loads(t)
            except ValueError:
                got = [t]
            out += got
        else:
            out.append(t)
    return out


def brute(rows):
    out = set()
    for r in rows:
        no, pre, table, post, inds = r[0], unpack(r[2]), r[3] or [], unpack(r[4]), (r[5][3] if r[5] else None) or []
        for kind, texts in (("pre_text", pre), ("post_text", post)):
            out |= {(no, kind, i, -1) for i, t in enumerate(texts) if not blank(t)}
        for i, row in enumerate(table):
            for j, c in enumerate(row or []):
                if not blank(c):
                    out |= {(no, "table_cell", i, j), (no, "table_row", i, -1)}
        for e in inds:
            for kind, k in re.findall(r"(?:^\s*|[{,]\s*[\"'])(table|text)_(\d+)(?:\s*$|[\"']\s*:)", e or "", re.I):
                child = (no, "table_row", int(k), -1) if kind.lower() == "table" else None
                if child in out if child else int(k) < len(pre + post) and not blank((pre + post)[int(k)]):
                    out.add((no, f"gold_{kind.lower()}", int(k), -1))
    return out


def make(rng, no):
    texts = ["One.", "", None, " ", " \n", '["a", "b"]', '["c", "", null]', "[broken", "[]", "Two [1]."]
    some = lambda: None if rng.random() < 0.1 else [rng.choice(texts) for _ in range(rng.randint(0, 4))]
    table = None if rng.random() < 0.1 else [None if rng.random() < 0.1 else [rng.choice(["x", "", None, " ", "5"]) for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 3))]
    inds = ["table_0", "TEXT_1", " text_3 ", "{'table_1': 'a'}", '{"text_0": "x", "table_2": "y"}', None, "", "table_0", "text_99", "see table_1"]
    qa = None if rng.random() < 0.1 else ("q", None, "1", None if rng.random() < 0.1 else [rng.choice(inds) for _ in range(rng.randint(0, 4))])
    return (no, None, some(), table, some(), qa, None, "clash", "clash")


def test_children_against_brute_force(spark):
    rng = random.Random(9)
    rows = [make(rng, i) for i in range(80)]
    got = nested.child_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    found = [(r.rec_no, r.child_kind, r.pos, r.sub_pos) for r in got]
    assert len(found) == len(set(found))
    assert set(found) == brute(rows)


def test_empty_and_null(spark):
    assert nested.child_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nested.child_rows(spark.createDataFrame([(1,) + (None,) * 8], SCHEMA)).count() == 0


def test_dewey_labels(spark):
    df = spark.createDataFrame([(1, [("a", [1, 2]), ("b", None)])], "k long, items array<struct<name: string, values: array<int>>>")
    rows = nested.dewey_nodes(df, "k", ["items"]).collect()
    by = {(r.path, tuple(r.label)): r for r in rows}
    leaf = by["items[].values[]", (0, 1, 1)]
    assert leaf.value == "2" and leaf.parent == [0, 1]
    labels = [r.label for r in rows]
    assert all(r.parent is None or r.parent in labels for r in rows)
    assert by["items", ()].parent is None
    tables = nested.node_tables(nested.dewey_nodes(df, "k", ["items"]), ["items[].name"])
    assert sorted(r.value for r in tables["items[].name"].collect()) == ["a", "b"]


def test_long_text(spark):
    long = "word " * 200_000
    row = (5, None, [long], [["x"]], None, None, None, None, None)
    got = nested.child_rows(spark.createDataFrame([row], SCHEMA)).where("child_kind = 'pre_text'").first()
    assert got.value == long


def test_ordinals_of_seven_digits(spark):
    df = spark.range(1).selectExpr("id as k", "transform(sequence(0, 1000001), i -> if(i = 1000001, 'x', '')) as a")
    rows = nested.dewey_nodes(df, "k", ["a"]).where("filled and path = 'a[]'").collect()
    assert [(r.label, r.parent, r.value) for r in rows] == [([1_000_001], [], "x")]


def test_expression_is_linear_in_depth(spark):
    def plan(depth):
        kind, value = "string", "x"
        for _ in range(depth):
            kind, value = f"array<{kind}>", [value]
        df = spark.createDataFrame([(1, value)], f"k long, a {kind}")
        nodes = nested.dewey_nodes(df, "k", ["a"])
        if depth in (3, 12):
            assert nodes.count() == depth + 1 and nodes.where("filled").count() == depth + 1
        return len(nodes._jdf.queryExecution().analyzed().toString())

    sizes = {d: plan(d) for d in (3, 6, 12)}
    assert sizes[12] - sizes[6] < 3 * (sizes[6] - sizes[3])


def test_one_scan(spark, tmp_path):
    rows = [make(random.Random(1), i) for i in range(20)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "r"))
    plan = nested.child_rows(spark.read.parquet(str(tmp_path / "r")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 0
