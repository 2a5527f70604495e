"""Structure rules: oversized modules, import fan-out and import cycles."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions.paths import python_module, under_skip_dir
from arrears.operators.common import Rounds, stage
from arrears.operators.items import debt_items


def oversized_modules(facts: DataFrame) -> DataFrame:
    big = facts.filter((F.col("kind") == "file") & (F.col("n1") >= C.OVERSIZED_LINES)
                       & (F.col("n2") >= C.OVERSIZED_FUNCTIONS))
    return debt_items(big, "architecture", category="architecture", severity="high",
                      kind="oversized_module", hours=8.0, impact="high",
                      detail=python_module(F.col("path")))


def known_modules(source_files: DataFrame) -> DataFrame:
    path = F.col("path")
    return source_files.filter(path.endswith(".py") & ~under_skip_dir(path)).select(
        "repo_id", python_module(path).alias("module")).distinct()


def local_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges (importer -> longest known dotted prefix) from rows (repo_id, [path,] importer, name).

    With ``path`` an edge belongs to its file: ``a/b.py`` and ``a/b/__init__.py`` are one module.

    Names are resolved once per repository, not once per import; a name that most modules import
    is a skewed key of a plain join, which adaptive execution splits.
    """
    imports = imports.distinct()
    files = [c for c in imports.columns if c == "path"]
    names = imports.select("repo_id", "name").distinct()
    parts = F.split("name", r"\.")
    candidates = names.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).select(
        "repo_id", "name", "depth",
        F.array_join(F.slice(parts, F.lit(1), F.col("depth")), ".").alias("module"))
    resolved = (candidates.join(modules, ["repo_id", "module"])
                .groupBy("repo_id", "name").agg(F.max_by("module", "depth").alias("target")))
    return (imports.join(resolved, ["repo_id", "name"])
            .select("repo_id", *files, F.col("importer").alias("src"), F.col("target").alias("dst"))
            .distinct())


def import_rows(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'import'").select(
        "repo_id", "path", python_module(F.col("path")).alias("importer"), "name")


def high_fanout(edges: DataFrame) -> DataFrame:
    """Files with ten or more distinct local imports."""
    wide = (edges.groupBy("repo_id", "path", F.col("src").alias("module"))
            .agg(F.count("*").alias("fanout")).filter(F.col("fanout") >= C.FANOUT_IMPORTS))
    return debt_items(wide, "architecture",
                      category="architecture", severity="medium", kind="high_fanout_module",
                      hours=5.0, impact="medium", detail=F.col("module"))


HOPS = 3  # graph steps between two written states


def _trim(edges: DataFrame) -> DataFrame:
    """Drop edges out of nodes nothing enters and into nodes nothing leaves, a few steps deep.

    Such edges are on no cycle. This only saves work: most of an import graph falls away here.
    """
    for _ in range(HOPS):
        entered = edges.select("repo_id", F.col("dst").alias("src")).distinct()
        left = edges.select("repo_id", F.col("src").alias("dst")).distinct()
        edges = edges.join(entered, ["repo_id", "src"], "left_semi").join(
            left, ["repo_id", "dst"], "left_semi")
    return edges


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges between branching nodes only, and the nodes of the chains between them.

    A thin node has one edge in and one out, so it shares a component with its neighbours or has none. Each one finds
    the branching nodes before and behind its chain by pointer doubling, all in both directions at once; a chain
    becomes one edge. Rows of the second table: repo_id, node, src, dst - the edge the node is on. A ring of thin nodes
    has no branching node; there both ends are its smallest node.
    """
    ends = edges.select("repo_id", F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("repo_id", "e.*")
    thin = stage(ends.groupBy("repo_id", "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
                 .filter("o = 1 and i = 1").select("repo_id", "node"))
    most = thin.groupBy("repo_id").count().agg(F.max("count")).first()[0]
    if most is None:
        return edges, None
    links = edges.join(thin.withColumnRenamed("node", "src"), ["repo_id", "src"]).select(
        "repo_id", F.lit("dst").alias("way"), F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(
        edges.join(thin.withColumnRenamed("node", "dst"), ["repo_id", "dst"]).select(
            "repo_id", F.lit("src").alias("way"), F.col("dst").alias("node"), F.col("src").alias("next")))
    rounds = Rounds()
    pointers, _ = rounds.next(links.withColumn("low", F.col("node")))
    for _ in range(math.ceil(math.log2(most)) + 1):
        far = pointers.select("repo_id", "way", F.col("node").alias("next"), F.col("next").alias("_far"), F.col("low").alias("_low"))
        pointers, counts = rounds.next(
            pointers.join(far, ["repo_id", "way", "next"], "left").select(
                "repo_id", "way", "node", F.coalesce("_far", "next").alias("next"), F.least("low", "_low").alias("low"), "_far"),
            moved=F.count("_far"))
        pointers = pointers.drop("_far")
        if counts["moved"] == 0:
            break
    # What still points to a thin node is on a ring, whose smallest node it has seen.
    inside = thin.select("repo_id", F.col("node").alias("next"), F.lit(True).alias("_ring"))
    ended = pointers.join(inside, ["repo_id", "next"], "left").withColumn(
        "end", F.when(F.col("_ring"), F.col("low")).otherwise(F.col("next")))
    chains = stage(ended.groupBy("repo_id", "node").agg(*[
        F.max(F.when(F.col("way") == way, F.col("end"))).alias(way) for way in ("src", "dst")]))
    thick = edges.join(thin.withColumnRenamed("node", "src"), ["repo_id", "src"], "left_anti").join(
        thin.withColumnRenamed("node", "dst"), ["repo_id", "dst"], "left_anti")
    return thick.unionByName(chains.filter("src <> dst").select("repo_id", "src", "dst").distinct()).distinct(), chains


def _smallest_reaching(edges: DataFrame) -> DataFrame:
    """Per node the smallest node that reaches it (``fore``) and that it reaches (``back``).

    Both directions run together: a node carries one label per direction, and one join and one
    minimum per step move all labels along all edges. Each round ends with a jump - what holds for
    the label of a node holds for the node - so rounds grow with the logarithm of the longest path.
    """
    moves = edges.select("repo_id", F.lit("fore").alias("way"), F.col("src").alias("node"),
                         F.col("dst").alias("next")).unionByName(
        edges.select("repo_id", F.lit("back").alias("way"), F.col("dst").alias("node"),
                     F.col("src").alias("next")))
    key = ["repo_id", "way", "node"]
    labels = (moves.select(*key).unionByName(moves.select("repo_id", "way", F.col("next").alias("node")))
              .distinct().withColumn("label", F.col("node")))
    rounds = Rounds()
    while True:
        moved = labels.withColumn("before", F.col("label"))
        for _ in range(HOPS):
            offered = (moves.join(moved.select(*key, "label"), key)
                       .groupBy("repo_id", "way", F.col("next").alias("node"))
                       .agg(F.min("label").alias("offer")))
            moved = moved.join(offered, key, "left").withColumn(
                "label", F.least("label", "offer")).drop("offer")
        far = moved.select("repo_id", "way", F.col("node").alias("label"), F.col("label").alias("far"))
        moved = moved.join(far, ["repo_id", "way", "label"], "left").withColumn(
            "label", F.least("label", "far")).drop("far")
        moved, counts = rounds.next(moved, changed=F.count_if(F.col("label") != F.col("before")))
        labels = moved.drop("before")
        if counts["changed"] == 0:
            return labels.groupBy("repo_id", "node").agg(*[
                F.max(F.when(F.col("way") == way, F.col("label"))).alias(way)
                for way in ("fore", "back")])


def import_cycles(edges: DataFrame) -> DataFrame:
    """Members of every import cycle: rows (repo_id, component, module).

    A cycle is a strongly connected component with two or more modules, or a module that imports
    itself; its name is its smallest module. Each round contracts chains to edges, so that what is left branches, and finds,
    per node, the smallest node that reaches it and the smallest it reaches. Where both agree the node shares a component
    with it; edges between nodes whose pairs differ are on no cycle and go. In the end the nodes of a chain
    join the component that both ends of their edge are in. State stays linear in nodes and
    edges - no reachability pairs are built - and every round starts from a written table. The driver only sees
    counts.
    """
    edges = stage(edges.select("repo_id", "src", "dst").distinct())
    loops = edges.filter("src = dst").select("repo_id", F.col("src").alias("component"), F.col("src").alias("module"))
    found, chains = [loops.limit(0)], []
    rounds = Rounds()
    rest, counts = rounds.next(_trim(edges.filter("src <> dst")), left=F.count(F.lit(1)))
    while counts["left"]:
        thick, thin = _contract(rest)
        if thin is not None:
            chains.append(thin)
            thick = stage(thick)
            if thick.isEmpty():
                break
        pairs = stage(_smallest_reaching(thick))
        found.append(pairs.filter("fore = back").select("repo_id", F.col("fore").alias("component"), F.col("node").alias("module")))
        open_pairs = pairs.filter("fore <> back")
        kept = thick
        for end in ("src", "dst"):
            kept = kept.join(open_pairs.select(
                "repo_id", F.col("node").alias(end),
                F.struct("fore", "back").alias(f"{end}_pair")), ["repo_id", end])
        rest, counts = rounds.next(_trim(kept.filter("src_pair = dst_pair").select("repo_id", "src", "dst")), left=F.count(F.lit(1)))
    components = found[0]
    for part in found[1:]:
        components = components.unionByName(part)
    components = components.distinct()
    # Ends of later chains lie on earlier ones, so the last chains come first.
    for thin in reversed(chains):
        of = components.select("repo_id", F.col("module").alias("_end"), "component")
        at = thin
        for end in ("src", "dst"):
            at = (at.join(of.select("repo_id", F.col("_end").alias(end), F.col("component").alias(f"_{end}")), ["repo_id", end], "left")
                  .withColumn(f"_{end}", F.coalesce(f"_{end}", end)))
        joined = at.filter("_src = _dst")
        components = stage(components.unionByName(joined.select("repo_id", F.col("_src").alias("component"), F.explode(
            F.array("node", "src")).alias("module"))).distinct())
    # A component is named by its smallest module; single modules count only when they import themselves.
    names = components.groupBy("repo_id", F.col("component").alias("_component")).agg(F.min("module").alias("component"), F.count("*").alias("size"))
    sized = components.withColumnRenamed("component", "_component").join(names, ["repo_id", "_component"]).select(
        "repo_id", "component", "module", "size")
    large = sized.filter("size > 1").drop("size")
    return large.unionByName(loops.join(large.select("repo_id", "module"), ["repo_id", "module"], "left_anti"))


def cyclic_dependencies(cycles: DataFrame) -> DataFrame:
    groups = cycles.select("repo_id", "component").distinct().withColumn(
        "path", F.concat(F.replace(F.col("component"), F.lit("."), F.lit("/")), F.lit(".py")))
    return debt_items(groups, "architecture", category="architecture", severity="high",
                      kind="cyclic_dependency", hours=10.0, impact="high",
                      detail=F.col("component"))
