"""Trees against plain recursion: sums from below, views, nested dumps, broken links."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import tree

NODES = "tree_id string, node_id string, parent_id string, child_pos int, depth int, step string, prior double, N long, W double, value double, terminal boolean, final_answer string"


def grown(rng, name, n, chain=0):
    """A random tree, and a chain of nodes below one of its leaves."""
    nodes = [{"tree_id": name, "node_id": f"{name}0", "parent_id": None, "child_pos": 0, "depth": 0}]
    for k in range(1, n):
        up = rng.choice(nodes[-chain:] if chain and k > n - chain else nodes) if not (chain and k > n - chain) else nodes[-1]
        nodes.append({"tree_id": name, "node_id": f"{name}{k}", "parent_id": up["node_id"], "child_pos": sum(x["parent_id"] == up["node_id"] for x in nodes), "depth": up["depth"] + 1})
    for x in nodes:
        leaf = not any(y["parent_id"] == x["node_id"] for y in nodes)
        x |= {"step": rng.choice(["", "Add  5\nand go on", "x" * 120, "é 日"]), "prior": rng.choice([0.25, 0.5]), "N": rng.randrange(1, 30), "value": rng.choice([None, 0.5, 0.125]), "terminal": leaf and rng.random() < 0.5, "final_answer": None}
        x["W"] = x["N"] * rng.choice([0.0, 0.25, 1.0])
        if x["terminal"]:
            x["final_answer"] = rng.choice([None, "13"])
    return nodes


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(7)
    return [grown(rng, "a", 40), grown(rng, "b", 1), grown(rng, "c", 30, chain=5)]


@pytest.fixture(scope="module")
def nodes(spark, trees):
    return spark.createDataFrame([tuple(x[f.split()[0]] for f in NODES.split(", ")) for t in trees for x in t], NODES).withColumn("virtual_loss", F.lit(0)).repartition(5).cache()


def below(t, x):
    return [x] + [z for y in t if y["parent_id"] == x["node_id"] for z in below(t, y)]


def test_sums_from_below_and_backup(nodes, trees):
    got = {(r.tree_id, r.node_id): (r.n, r.w) for r in tree.sums_below(nodes, {"n": F.lit(1), "w": F.col("W")}).collect()}
    assert got == {(x["tree_id"], x["node_id"]): (len(below(t, x)), sum(y["W"] for y in below(t, x))) for t in trees for x in t}
    leaves = nodes.where("terminal").select("tree_id", "node_id", F.lit(0.5).alias("value"))
    after = {r.node_id: (r.N, r.W) for r in tree.backup(nodes, leaves.unionByName(leaves)).collect()}
    for t in trees:
        for x in t:
            k = 2 * sum(y["terminal"] for y in below(t, x))
            assert after[x["node_id"]] == (x["N"] + k, x["W"] + 0.5 * k)
    assert tree.sums_below(nodes.limit(0), {"n": F.lit(1)}).count() == 0


def plain_lines(t, max_depth, least, width):
    def line(x):
        step = " ".join(x["step"].split())
        step = step[:width - 3] + "..." if len(step) > width else step
        prior = "" if x["parent_id"] is None else f"  P={x['prior']:.2f}"
        end = f"  [T] {x['final_answer'] or '(no answer)'}" if x["terminal"] else ""
        return f"N={x['N']:<3} Q={x['W'] / x['N']:.3f}{prior}  v={'-   ' if x['value'] is None else format(x['value'], '.2f')}{end}  {step or '(root)'}"

    out = []

    def visit(x):
        out.append((x["depth"], line(x)))
        children = sorted((y for y in t if y["parent_id"] == x["node_id"]), key=lambda y: (-y["N"], -y["prior"], y["child_pos"]))
        kept = [y for y in children if y["N"] >= least and (max_depth is None or y["depth"] <= max_depth)]
        for y in kept:
            visit(y)
        if len(kept) < len(children):
            out.append((x["depth"] + 1, f"... {len(children) - len(kept)} hidden"))

    visit(t[0])
    return out


@pytest.mark.parametrize(("max_depth", "least"), [(None, 0), (2, 12)])
def test_views_equal_recursion(nodes, trees, max_depth, least):
    lines = {}
    for r in tree.tree_lines(nodes, max_depth, least, 40).orderBy("at").collect():
        lines.setdefault(r.tree_id, []).append((r.depth, r.line))
    counts = {r.tree_id: r for r in tree.view_counts(nodes, max_depth, least).collect()}
    for t in trees:
        want = plain_lines(t, max_depth, least, 40)
        name = t[0]["tree_id"]
        assert lines[name] == want
        said = [int(x.split()[1]) for _, x in want if x.startswith("...")]
        assert counts[name].n_shown == len(want) - len(said) and counts[name].hidden_children == sum(said) and counts[name].n_shown + counts[name].n_hidden == len(t)


def test_nested_dumps_round_trip(spark, nodes, trees):
    raw = tree.nest(nodes).cache()

    def nested(t, x):
        return {"step": x["step"], "N": x["N"], "Q": x["W"] / x["N"], "prior": x["prior"], "value": x["value"], "terminal": x["terminal"], "final_answer": x["final_answer"], "children": [nested(t, y) for y in sorted(t, key=lambda y: y["child_pos"]) if y["parent_id"] == x["node_id"]]}

    texts = {r.tree_id: r.raw for r in raw.collect()}
    assert {k: json.loads(v) for k, v in texts.items()} == {t[0]["tree_id"]: nested(t, t[0]) for t in trees}
    flat = tree.flatten(raw)
    assert flat.count() == sum(map(len, trees)) and tree.broken_links(flat).count() == 0
    again = {r.tree_id: r.raw for r in tree.nest(flat).collect()}
    assert again == texts
    odd = spark.createDataFrame([("x", None), ("y", "no json"), ("z", "[1]"), ("w", '{"N": 1, "children": 5}')], "tree_id string, raw string")
    assert [(r.tree_id, r.N) for r in tree.flatten(odd).collect()] == [("w", 1)]


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_dumps_in_pieces(spark, nodes, most):
    pieces = tree.nest(nodes, most).cache()
    whole = tree.flatten(tree.nest(nodes))
    flat = tree.flatten(pieces)
    of = [F.col(c) for c in ("tree_id", "child_pos", "depth", "step", "N", "Q", "prior", "value", "terminal", "final_answer")]
    assert sorted(map(repr, flat.select(of).collect())) == sorted(map(repr, whole.select(of).collect()))
    assert tree.broken_links(flat).count() == 0
    assert max(r.raw.count('"step"') for r in pieces.collect()) <= most
    assert most < 1000 or pieces.count() == nodes.select("tree_id").distinct().count()


def test_dumps_are_cut_in_place(spark):
    raw = ' {"N": 2 , "children" : [ {"step": "a,]}\\"", "N":1,"children":[]} , 7, {"x":{"children":[1]}, "prior":0.25} ], "Q": 1e0, "step":"\\u00e9"} '
    assert [(i, p, k, d, json.loads(t)) for i, p, k, d, t in tree.cut_dump(raw)] == [("0.0", "0", 0, 1, {"step": 'a,]}"', "N": 1}), ("0.1", "0", 1, 1, 7), ("0.2", "0", 2, 1, {"x": {"children": [1]}, "prior": 0.25}), ("0", None, 0, 0, {"N": 2, "Q": 1.0, "step": "\u00e9"})]
    deep = "".join('{"N":%d,"children":[' % k for k in range(1500)) + "]}" * 1500
    bad = ["", '{"N":1', '{"N":1,}', '{"N":1,"N":2}', '{"N":NaN}', '{"children":[1,]}', '{"children":[{"N":1}', '{"N" 1}', '{,"N":1}', "{N:1}"]
    df = spark.createDataFrame([("deep", deep), *[(f"bad{k}", x) for k, x in enumerate(bad)]], "tree_id string, raw string")
    flat = tree.flatten(df)
    assert flat.groupBy("tree_id").agg(F.count("*").alias("n"), F.max("N").alias("m"), F.max("depth").alias("d")).collect() == [("deep", 1500, 1499, 1499)]


def test_broken_links_are_told(spark, nodes):
    slim = [("t", "r", None, 0), ("t", "a", "r", 1), ("t", "b", "gone", 2), ("t", "c", "d", 2), ("t", "d", "c", 2), ("t", "r2", None, 0), ("u", "r", None, 0), ("u", "r", None, 0), ("v", "r", None, 3)]
    df = spark.createDataFrame(slim, "tree_id string, node_id string, parent_id string, depth int")
    got = {(r.tree_id, r.node_id): r.fault for r in tree.broken_links(df.where("tree_id = 't'")).collect()}
    assert got == {("t", "b"): "its parent is absent", ("t", "c"): "it isn't a level below its parent", ("t", "d"): "it isn't a level below its parent", ("t", "r2"): "a second root"}
    assert {r.fault for r in tree.broken_links(df.where("tree_id <> 't'")).collect()} == {"a second root", "its id occurs twice", "a root below the top"}
    with pytest.raises(ValueError, match="broken trees"):
        tree.sums_below(df, {"n": F.lit(1)})
    assert tree.broken_links(nodes).count() == 0
