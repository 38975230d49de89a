"""Search trees as adjacency tables: nodes(tree_id, node_id, parent_id, child_pos, depth, step, prior, N, W, value, terminal, final_answer, virtual_loss)."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import batched
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.functions.probability import puct_score, q_effective, q_value
from marlstone.functions.text import preview, shorten
from marlstone.sources.shared import Written


def scored_children(nodes: DataFrame, c_puct: float = 1.5, unvisited: float = 0.0) -> DataFrame:
    """(tree_id, parent_id, node_id, child_pos, prior, score) of each child."""
    parents = nodes.select("tree_id", F.col("node_id").alias("parent_id"), (F.col("N") + F.col("virtual_loss")).alias("parent_n"))
    q = q_effective(F.col("N"), F.col("W"), F.col("virtual_loss"), unvisited)
    return nodes.join(parents, ["tree_id", "parent_id"]).select("tree_id", "parent_id", "node_id", "child_pos", "prior", puct_score(q, F.col("prior"), F.col("parent_n"), F.col("N") + F.col("virtual_loss"), c_puct).alias("score"))


def select_children(nodes: DataFrame, c_puct: float = 1.5) -> DataFrame:
    """(tree_id, parent_id, node_id): the child of the highest score, then the highest prior, then the first."""
    return scored_children(nodes, c_puct).groupBy("tree_id", "parent_id").agg(F.max_by("node_id", F.struct("score", "prior", -F.col("child_pos"))).alias("node_id"))


def most_visited_children(nodes: DataFrame) -> DataFrame:
    """(tree_id, parent_id, node_id): the child of the most visits, then by value, prior and place."""
    return nodes.where("parent_id is not null").groupBy("tree_id", "parent_id").agg(F.max_by("node_id", F.struct("N", q_value(F.col("N"), F.col("W")), "prior", -F.col("child_pos"))).alias("node_id"))


def walk(nodes: DataFrame, best: DataFrame) -> DataFrame:
    """(tree_id, depth, node_id): from the root along `best` to a terminal node or a leaf, a level of all trees at a time.

    The steps are written once; a level joins them with the paths that are still open, one row for each tree.
    """
    steps = Written(best.join(nodes.select("tree_id", "node_id", "terminal"), ["tree_id", "node_id"]).select("tree_id", F.col("parent_id").alias("at"), F.col("node_id").alias("next"), F.col("terminal").alias("ends")), "steps")
    level, levels = Written(nodes.where("parent_id is null").select("tree_id", F.lit(0).alias("depth"), "node_id", "terminal"), "paths"), []
    while level.df.limit(1).count():
        levels.append(level.df)
        open_ = level.df.where("not terminal")
        on = steps.df
        level = Written(open_.join(on, (open_["tree_id"] == on["tree_id"]) & (open_["node_id"] == F.col("at"))).select(open_["tree_id"], (F.col("depth") + 1).alias("depth"), F.col("next").alias("node_id"), F.col("ends").alias("terminal")), "paths")
    levels.append(level.df)
    steps.drop()
    return reduce(DataFrame.unionByName, levels).drop("terminal")


def most_visited_path(nodes: DataFrame) -> DataFrame:
    return walk(nodes, most_visited_children(nodes))


def selection_path(nodes: DataFrame, c_puct: float = 1.5) -> DataFrame:
    return walk(nodes, select_children(nodes, c_puct))


def broken_links(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, fault) of nodes that aren't where they say: of a parent that is absent, not a level below it, a second root, an id twice.

    A tree without these is whole: depths fall by one at each step up, so every path ends at its root, and no cycle can be.
    """
    slim = nodes.select("tree_id", "node_id", "parent_id", "depth")
    above = slim.select("tree_id", F.col("node_id").alias("parent_id"), F.col("depth").alias("above"), F.lit(True).alias("there")).distinct()
    linked = slim.where("parent_id is not null").join(above, ["tree_id", "parent_id"], "left")
    fault = F.when(F.col("there").isNull(), "its parent is absent").when(F.coalesce(F.col("depth") != F.col("above") + 1, F.lit(True)), "it isn't a level below its parent")
    wrong = linked.select("tree_id", "node_id", fault.alias("fault")).where("fault is not null")
    roots = slim.where("parent_id is null").groupBy("tree_id").agg(F.count("*").alias("c"), F.max("node_id").alias("node_id"), F.max("depth").alias("depth"))
    wrong_roots = roots.where("c > 1 or depth <> 0").select("tree_id", "node_id", F.when(F.col("c") > 1, "a second root").otherwise("a root below the top").alias("fault"))
    twice = slim.groupBy("tree_id", "node_id").count().where("count > 1").select("tree_id", "node_id", F.lit("its id occurs twice").alias("fault"))
    return wrong.unionByName(wrong_roots).unionByName(twice)


def _whole(nodes: DataFrame) -> int:
    """The depth of trees without broken links; an error otherwise."""
    found = broken_links(nodes).orderBy("tree_id", "node_id").limit(3).collect()  # for the message
    if found:
        raise ValueError("broken trees: " + "; ".join(f"{r.tree_id}/{r.node_id}: {r.fault}" for r in found))
    return nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]


def sums_below(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(tree_id, node_id, values): each value added up over a node and all below it. Give nodes that are cheap to read again.

    From the deepest level up: a level's sums are its own values and those of its children, one shuffle and one
    written table a level; no path is built, so a node's cost doesn't grow with its depth. Trees with broken links are an error.
    """
    names, depth = list(values), _whole(nodes)
    own = Written(nodes.select("tree_id", "node_id", "parent_id", "depth", *[v.alias(k) for k, v in values.items()]), "own")
    below, levels = None, []
    for d in range(depth, -1, -1):
        here = own.df.where(F.col("depth") == d).select("tree_id", "node_id", "parent_id", *names)
        if below is not None:
            children = below.df.select("tree_id", F.col("parent_id").alias("node_id"), *names)
            both = here.unionByName(children.withColumn("parent_id", F.lit(None).cast(here.schema["parent_id"].dataType)))
            summed = both.groupBy("tree_id", "node_id").agg(*[F.sum(k).alias(k) for k in names], F.max("parent_id").alias("parent_id"))
            here = summed.select("tree_id", "node_id", "parent_id", *names)
        below = Written(here, "level")
        levels.append(below.df.select("tree_id", "node_id", *names))
    own.drop()
    return reduce(DataFrame.unionByName, levels)


def backup(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Adds simulations that ended at `leaves` (tree_id, node_id, value; one row each): a visit and the value for each node from the leaf to the root. Sums commute, so a batch is exact."""
    ended = leaves.groupBy("tree_id", "node_id").agg(F.count("*").alias("own_n"), F.sum("value").alias("own_w"))
    told = Written(nodes.select("tree_id", "node_id", "parent_id", "depth").join(ended, ["tree_id", "node_id"], "left"), "told")
    added = sums_below(told.df, {"dn": F.coalesce("own_n", F.lit(0)), "dw": F.coalesce("own_w", F.lit(0.0))})
    return nodes.join(added, ["tree_id", "node_id"]).withColumn("N", F.col("N") + F.col("dn")).withColumn("W", F.col("W") + F.col("dw")).drop("dn", "dw")


def shown(nodes: DataFrame, max_depth: int | None = None, min_visits: int = 0) -> DataFrame:
    """The nodes with `hidden`: whether the node or one above it has fewer visits than asked for or lies too deep; and `top`: whether it is the first hidden one on its path. A root is always shown.

    From the top down, a level of all trees at a time.
    """
    depth = _whole(nodes)
    own = F.col("N") < min_visits
    own = (own | (F.col("depth") > max_depth) if max_depth is not None else own) & F.col("parent_id").isNotNull()
    slim = Written(nodes.select("tree_id", "node_id", "parent_id", "depth", own.alias("own")), "nodes")
    level, levels = Written(slim.df.where("depth = 0").select("tree_id", "node_id", F.lit(False).alias("hidden"), F.lit(False).alias("top")), "shown"), []
    for d in range(1, depth + 1):
        levels.append(level.df)
        above = level.df.select("tree_id", F.col("node_id").alias("parent_id"), F.col("hidden").alias("above"))
        level = Written(slim.df.where(F.col("depth") == d).join(above, ["tree_id", "parent_id"]).select("tree_id", "node_id", (F.col("own") | F.col("above")).alias("hidden"), (F.col("own") & ~F.col("above")).alias("top")), "shown")
    levels.append(level.df)
    slim.drop()
    return nodes.join(reduce(DataFrame.unionByName, levels), ["tree_id", "node_id"])


def view_counts(nodes: DataFrame, max_depth: int | None = None, min_visits: int = 0) -> DataFrame:
    """(tree_id, n_shown, n_hidden, hidden_children, largest_hidden): nodes shown and hidden, the hidden nodes whose parents are shown, and the size of the largest subtree among theirs."""
    seen = Written(shown(nodes, max_depth, min_visits), "shown")
    sizes = sums_below(seen.df, {"size": F.lit(1)})
    both = seen.df.select("tree_id", "node_id", "hidden", "top").join(sizes, ["tree_id", "node_id"])
    return both.groupBy("tree_id").agg(F.count_if(~F.col("hidden")).alias("n_shown"), F.count_if("hidden").alias("n_hidden"), F.count_if("top").alias("hidden_children"), F.coalesce(F.max(F.when(F.col("top"), F.col("size"))), F.lit(0)).alias("largest_hidden"))


def label(step_chars: int = 80) -> Column:
    """One line about a node: visits, value, prior but for the root, its judged value, its answer where it is terminal, and the beginning of its step."""
    q = F.format_string("%.3f", F.bround(q_value(F.col("N"), F.col("W")), 3))
    prior = F.when(F.col("parent_id").isNotNull(), F.concat(F.lit("  P="), F.format_string("%.2f", F.bround("prior", 2)))).otherwise("")
    value = F.when(F.col("value").isNull(), "-   ").otherwise(F.format_string("%.2f", F.bround("value", 2)))
    answer = F.when(F.col("terminal"), F.concat(F.lit("  [T] "), F.coalesce("final_answer", F.lit("(no answer)")))).otherwise("")
    step = shorten(F.coalesce("step", F.lit("")), step_chars)
    return F.concat(F.lit("N="), F.rpad(F.col("N").cast("string"), F.greatest(F.lit(3), F.length(F.col("N").cast("string"))), F.lit(" ")), F.lit(" Q="), q, prior, F.lit("  v="), value, answer, F.lit("  "), F.when(step == "", "(root)").otherwise(step))


def tree_lines(nodes: DataFrame, max_depth: int | None = None, min_visits: int = 0, step_chars: int = 80) -> DataFrame:
    """(tree_id, at, depth, line): the shown nodes in preorder (`at` sorts them), children by falling visits and prior, and after a node's shown children a line for how many are hidden."""
    seen = Written(shown(nodes, max_depth, min_visits), "shown")
    rank = F.row_number().over(Window.partitionBy("tree_id", "parent_id").orderBy(F.col("N").desc(), F.col("prior").desc(), "child_pos")) - 1
    ordered = Written(seen.df.where("not hidden").withColumn("child_pos", rank.cast("int")), "ordered")
    places = Written(positions(ordered.df), "places")
    lines = ordered.df.join(places.df, ["tree_id", "node_id"]).select("tree_id", "at", "depth", label(step_chars).alias("line"))
    counted = seen.df.where("top").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"), F.min("depth").alias("depth"))
    more = counted.join(places.df, ["tree_id", "node_id"]).select("tree_id", F.array_append("at", F.lit((1 << 31) - 1)).alias("at"), "depth", F.concat(F.lit("... "), F.col("n").cast("string"), F.lit(" hidden")).alias("line"))
    return lines.unionByName(more)


#: Fields of a nested dump besides its children.
_NODE = "step string, N long, Q double, prior double, value double, terminal boolean, final_answer string"
#: Nodes of a dump that are handed on at once.
NODES_AT_ONCE = 4096
_SPACE = re.compile(r"[ \t\n\r]*")


def _refuse(_: str) -> None:
    raise ValueError("no JSON number")


def _once(pairs: list[tuple]) -> None:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key occurs twice")


_READ = json.JSONDecoder(parse_constant=_refuse, object_pairs_hook=_once).raw_decode


def cut_dump(text: str) -> Iterator[tuple[str, str | None, int, int, str]]:
    """(node_id, parent_id, child_pos, depth, JSON of the node without its children) of a nested dump, each node after those below it; nothing if it is no object, a ValueError where it is no JSON.

    Beside the text, only the nodes on the way to the present one are held.
    """
    def after(at: int, mark: str = "") -> int:
        at = _SPACE.match(text, at).end()
        if not mark:
            return at
        if not text.startswith(mark, at):
            raise ValueError(f"{mark} is missing at {at}")
        return _SPACE.match(text, at + 1).end()

    at = after(0)
    if not text.startswith("{", at):
        return
    # id, parent's id, place, own members, keys, children so far, whether its list is open
    way, at = [["0", None, 0, [], set(), 0, False]], at + 1
    while way:
        node, at = way[-1], after(at)
        if node[6]:
            if text.startswith("]", at):
                node[6], at = False, at + 1
                continue
            at = after(at, ",") if node[5] else at
            place, name, node[5] = node[5], f"{node[0]}.{node[5]}", node[5] + 1
            if text.startswith("{", at):
                way.append([name, node[0], place, [], set(), 0, False])
                at += 1
            else:
                end = _READ(text, at)[1]
                yield name, node[0], place, len(way), text[at:end]
                at = end
        elif text.startswith("}", at):
            way.pop()
            yield node[0], node[1], node[2], len(way), "{" + ",".join(node[3]) + "}"
            at += 1
        else:
            at = after(at, ",") if node[4] else at
            if not text.startswith('"', at):
                raise ValueError(f"a key is missing at {at}")
            key, end = scanstring(text, at + 1, True)
            begin = after(end, ":")
            if key in node[4]:
                raise ValueError("a key occurs twice")
            node[4].add(key)
            if key == "children" and text.startswith("[", begin):
                node[6], at = True, begin + 1
            else:
                end = _READ(text, begin)[1]
                node[3].append(text[at:end])
                at = end


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            text = batch.column("raw")[k].as_py() or ""
            try:
                deque(cut_dump(text), maxlen=0)  # a text that ends badly has no nodes
            except (ValueError, RecursionError):
                continue
            for some in batched(cut_dump(text), NODES_AT_ONCE):
                tree = batch.column("tree_id").take(pa.array([k] * len(some)))
                if batch.num_columns > 2:
                    name, parent, pos, depth = (batch.column(c)[k].as_py() for c in ("node_id", "parent_id", "child_pos", "depth"))
                    some = [(f"{name}{i[1:]}", f"{name}{p[1:]}", c, n + depth, t) if p else (name, parent, pos, depth, t) for i, p, c, n, t in some]
                columns = [pa.array(x, kind) for x, kind in zip(zip(*some), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([tree, *columns], ["tree_id", "node_id", "parent_id", "child_pos", "depth", "node"])


def flatten(trees: DataFrame) -> DataFrame:
    """Nodes of nested dumps (tree_id, raw: JSON of a node with `children`): tree_id, node_id (places from the root, as `0.2.1`), parent_id, child_pos, depth and the fields of a node; W is N * Q.

    A dump is cut into its nodes from front to back, so no tree of it is in memory beside its text, and it may nest to any depth; Spark reads the fields.
    Pieces as `nest` makes them keep the place of their top node, and the nodes below it are named after it.
    Trees whose raw is null or no JSON object have no nodes.
    """
    cut = StructType([trees.schema["tree_id"], *StructType.fromDDL("node_id string, parent_id string, child_pos int, depth int, node string").fields])
    places = [c for c in ("node_id", "parent_id", "child_pos", "depth") if "node_id" in trees.columns]
    level = trees.select("tree_id", *[F.col(c).cast(kind).alias(c) for c, kind in zip(places, ("string", "string", "int", "int"))], "raw").mapInArrow(_cut, cut).withColumn("node", F.try_parse_json("node"))
    nodes = level.select("tree_id", "node_id", "parent_id", "child_pos", "depth", *[F.try_variant_get("node", f"$.{name}", kind).alias(name) for name, kind in (f.split() for f in _NODE.split(", "))])
    return nodes.withColumn("W", F.col("N") * F.col("Q")).withColumn("virtual_loss", F.lit(0))


#: Nodes of a piece of a dump, at most, where trees are dumped in pieces.
PIECE = 1 << 12


def nest(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(tree_id, raw): the trees as nested JSON, children in their order; from the deepest level up, so each text is written once a level.

    A whole tree is one value. With `most`, dumps come in pieces of at most so many nodes instead: (tree_id, node_id, parent_id, child_pos,
    depth, raw), where a node with more below it is a piece without children, and each of its children the top of another one.
    """
    depth = _whole(nodes)
    q = q_value(F.col("N"), F.col("W"))
    own = Written(nodes.select("tree_id", "node_id", "parent_id", "child_pos", "depth", F.to_json(F.struct("step", "N", q.alias("Q"), "prior", "value", "terminal", "final_answer"), {"ignoreNullFields": "false"}).alias("text")), "own")
    top, pieces = ["tree_id", "node_id", "parent_id", "child_pos", "depth", "raw"], []
    below, text = None, F.expr("substring(text, 1, length(text) - 1)")
    for d in range(depth, -1, -1):
        here = own.df.where(F.col("depth") == d)
        if below is None:
            level = Written(here.select(*top[:-1], F.concat(text, F.lit(',"children":[]}')).alias("raw"), F.lit(1).cast("long").alias("size")), "nested")
        else:
            given = below.df
            sizes = given.groupBy("tree_id", "parent_id").agg((F.sum("size") + 1).alias("size"))
            if most is not None:
                large = Written(sizes.where(F.col("size") > most), "large").df  # few, as each has many nodes below it
                pieces.append(given.join(F.broadcast(large.drop("size")), ["tree_id", "parent_id"], "left_semi").select(*top))
                given = given.join(F.broadcast(large.drop("size")), ["tree_id", "parent_id"], "left_anti")
            # grouped, not joined: the lists are as large as the trees, however small their files are
            given = given.select("tree_id", F.col("parent_id").alias("node_id"), F.struct("child_pos", "raw").alias("child"), "size")
            both = here.select("tree_id", "node_id", F.struct("parent_id", "child_pos", "depth", "text").alias("own")).unionByName(given, allowMissingColumns=True)
            if most is not None:
                both = both.unionByName(large.select("tree_id", F.col("parent_id").alias("node_id"), (F.col("size") - 1).alias("size")), allowMissingColumns=True)
            lists = both.groupBy("tree_id", "node_id").agg(F.max("own").alias("own"), F.array_sort(F.collect_list("child")).alias("c"), (F.coalesce(F.sum("size"), F.lit(0)) + 1).alias("size")).where("own is not null")
            here = lists.select("tree_id", "node_id", "own.*", "size", F.flatten(F.transform("c", lambda x: F.array(F.lit(","), x["raw"]))).alias("pieces"))
            raw = F.array_join(F.concat(F.array(text, F.lit(',"children":[')), F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0))), F.array(F.lit("]}"))), "")
            level = Written(here.select(*top[:-1], raw.alias("raw"), "size"), "nested")
            if most is None:
                below.drop()
        below = level
    own.drop()
    return below.df.select("tree_id", "raw") if most is None else reduce(DataFrame.unionByName, pieces, below.df.select(*top))


def tree_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tree_id").agg(F.count("*").alias("n_nodes"), F.count_if("terminal").alias("n_terminals"), F.max("depth").alias("max_depth"))


def positions(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, at): the places of a node's ancestors and its own, which order a tree in preorder; a level of all trees at a time."""
    slim = Written(nodes.select("tree_id", "node_id", "parent_id", F.col("child_pos").cast("int").alias("child_pos")), "nodes")
    level, levels = Written(slim.df.where("parent_id is null").select("tree_id", "node_id", F.array(F.lit(0)).alias("at")), "places"), []
    while level.df.limit(1).count():
        levels.append(level.df)
        above = level.df.withColumnRenamed("node_id", "parent_id")
        level = Written(slim.df.join(above, ["tree_id", "parent_id"]).select("tree_id", "node_id", F.array_append("at", F.col("child_pos")).alias("at")), "places")
    levels.append(level.df)
    slim.drop()
    return reduce(DataFrame.unionByName, levels)


def preorder(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, pre): numbers from 0 in preorder within each tree."""
    return positions(nodes).withColumn("pre", F.row_number().over(Window.partitionBy("tree_id").orderBy("at")) - 1).drop("at")


def terminal_leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("terminal").select("tree_id", "node_id", "final_answer", "N", "value")


def dump(nodes: DataFrame) -> DataFrame:
    """The flat form of a tree dump: preorder id, short step, rounded Q, prior and value."""
    return nodes.join(preorder(nodes), ["tree_id", "node_id"]).select("tree_id", F.col("pre").alias("id"), preview(F.col("step")).alias("step"), "N", F.bround(q_value(F.col("N"), F.col("W")), 4).alias("Q"), F.bround("prior", 4).alias("prior"), F.bround("value", 4).alias("value"), "terminal", "final_answer")
