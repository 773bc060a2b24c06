"""The import graph: degrees, hubs, PageRank, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from skein.functions.paths import canonical_path, parent_dir
from skein.sources.tables import ensure_checkpoint_dir

HUB_DEGREE = 3
#: Rounds of PageRank that run as one job.
BLOCK_ROUNDS = 5


def import_graph(edges: DataFrame) -> DataFrame:
    """Distinct resolved edges ``(src, dst)``, one spelling a path; files importing themselves keep that edge."""
    pairs = edges.select(canonical_path(F.col("src_file")).alias("src"), canonical_path(F.col("dst_file")).alias("dst"))
    return pairs.dropna().distinct()


def degrees(graph: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(path, in_degree, out_degree)`` of every end of an edge, and of ``nodes(path)`` without edges."""
    ends = graph.select(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        graph.select(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    if nodes is not None:
        ends = ends.unionByName(nodes.select(canonical_path(F.col("path")).alias("path"), F.lit(0).alias("i"), F.lit(0).alias("o")).dropna())
    return ends.groupBy("path").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def hub_level(degree) -> F.Column:
    return F.when(degree >= 8, "critical").when(degree >= 5, "high").when(degree >= 3, "medium").when(degree >= 2, "low").otherwise("none")


def hub_score(degree: DataFrame) -> DataFrame:
    """``in * (1 + ln(1 + out))`` of files that are imported at all."""
    scored = degree.withColumn("hub_score", F.col("in_degree") * (1 + F.log1p("out_degree")))
    return scored.where("hub_score > 0")


def hubs(degree: DataFrame, *, threshold: int = HUB_DEGREE) -> DataFrame:
    return degree.where(F.col("in_degree") >= threshold).withColumn("level", hub_level(F.col("in_degree")))


def graph_stats(degree: DataFrame, *, threshold: int = HUB_DEGREE) -> DataFrame:
    """One row: files, edges, hubs, isolated files and mean degrees."""
    return degree.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("edges"), F.count_if(F.col("in_degree") >= threshold).alias("hubs"),
        F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("isolated"), F.avg("in_degree").alias("avg_in"), F.max("in_degree").alias("max_in"),
    )


def internal_edges(graph: DataFrame, files: DataFrame) -> DataFrame:
    """Edges between files of the index ``files(path)``, a file's import of itself aside."""
    known = files.select(canonical_path(F.col("path")).alias("path")).dropna().distinct()
    inside = graph.where("src <> dst").join(known.withColumnRenamed("path", "src"), "src", "left_semi")
    return inside.join(known.withColumnRenamed("path", "dst"), "dst", "left_semi").select("src", "dst")


def language_stats(degree: DataFrame, nodes: DataFrame, *, threshold: int = HUB_DEGREE) -> DataFrame:
    """``(language, files, edges, hubs, avg_in, avg_out)``; of a path given with several languages the greatest counts."""
    named = nodes.select(canonical_path(F.col("path")).alias("path"), F.lower(F.trim("language")).alias("language")).groupBy("path").agg(F.max("language").alias("language"))
    return (
        degree.join(named, "path", "left").groupBy("language")
        .agg(F.count("*").alias("files"), F.sum("out_degree").alias("edges"), F.count_if(F.col("in_degree") >= threshold).alias("hubs"), F.avg("in_degree").alias("avg_in"), F.avg("out_degree").alias("avg_out"))
    )


def dependency_flow(graph: DataFrame, degree: DataFrame, *, shown: int = 3) -> DataFrame:
    """``(dir, path, in_degree, imports, more)``: of each file that imports others the first ``shown`` of them, and how many more.

    ``dir`` is 'root' for files at the top.  Imports are numbered where they
    are, so a file's list is never longer than what is shown.
    """
    w = Window.partitionBy("src").orderBy("dst")
    first = graph.withColumn("k", F.row_number().over(w)).where(F.col("k") <= shown)
    lists = first.groupBy(F.col("src").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "dst"))), lambda x: x["dst"]).alias("imports"))
    folder = F.when(parent_dir(F.col("path")) == "", "root").otherwise(parent_dir(F.col("path")))
    return degree.join(lists, "path").select(folder.alias("dir"), "path", "in_degree", "imports", (F.col("out_degree") - F.size("imports")).alias("more"))


def connected(graph: DataFrame, path: str) -> DataFrame:
    """Files that import ``path`` or are imported by it, itself aside."""
    out = graph.where(F.col("src") == path).select(F.col("dst").alias("path"))
    return out.unionByName(graph.where(F.col("dst") == path).select(F.col("src").alias("path"))).distinct().where(F.col("path") != path)


def _rounds(links: DataFrame, state: DataFrame, carried: list[str], rounds: int, damping: float) -> DataFrame:
    """``state`` with ``v1 .. v<rounds>``: each the ranks that the one before passes on (``v0`` the first), damped.

    Every round is one join and one sum.  A file's own numbers travel along a
    link to itself (weight 0, ``own`` 1), so that the plan stays a chain.
    """
    for k in range(1, rounds + 1):
        met = links.join(state.withColumnRenamed("id", "src"), "src")
        kept = [F.sum(F.col(c) * F.col("own")).alias(c) for c in carried]
        state = met.groupBy(F.col("dst").alias("id")).agg(*kept, (F.lit(damping) * F.sum(F.col(f"v{k - 1}") * F.col("weight"))).alias(f"v{k}"))
        carried = [*carried, f"v{k}"]
    return state


def pagerank(graph: DataFrame, nodes: DataFrame | None = None, *, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, block: int = BLOCK_ROUNDS) -> DataFrame:
    """``(path, rank)``; ranks add up to 1 and files that import nothing pass theirs to all.

    Stops after ``iterations`` rounds or after the first that moves the ranks
    by less than ``files * tolerance`` in all (0: never).

    A round is linear: with ``A`` the passing on and ``u`` the even share,
    ``r' = dA r + b u``, where ``b`` needs the mass of files that import
    nothing.  So ``block`` rounds run as one job without that number: they give
    ``(dA)^k r``; as ``(dA)^k u`` is known from the first block, the masses,
    and with them the ranks of every round, follow from their sums.  Each round
    is a join on the importing file and a sum by imported file, with partial
    sums before the shuffle, so hubs do not weigh on one task.  Lineage is cut
    in the shared folder after each block.
    """
    ensure_checkpoint_dir(graph.sparkSession)
    graph = graph.checkpoint()
    known = degrees(graph, nodes).select("path", "out_degree").withColumn("id", F.monotonically_increasing_id()).checkpoint()
    n = known.count()
    if not n:
        return known.select("path", F.lit(0.0).alias("rank"))
    links = graph.join(known.select(F.col("path").alias("src"), F.col("id").alias("a"), "out_degree"), "src").join(known.select(F.col("path").alias("dst"), F.col("id").alias("b")), "dst")
    links = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.lit(1.0) / F.col("out_degree")).alias("weight"), F.lit(0.0).alias("own"))
    links = links.unionByName(known.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("own"))).checkpoint()
    state = known.select("id", F.when(F.col("out_degree") == 0, 1.0).otherwise(0.0).alias("idle"), F.lit(1.0 / n).alias("v0"))
    shared: list[float] = [known.where("out_degree = 0").count() / n]  # idle mass of (dA)^k u
    mass, columns, done = shared[0], [], 0
    even = lambda k: F.col(f"u{k}") if k else F.lit(1.0 / n)
    while done < iterations:
        rounds = min(block, iterations - done)
        facts = Observation()
        idle = [F.coalesce(F.sum(F.col("idle") * F.col(f"v{k}")), F.lit(0.0)).alias(f"v{k}") for k in range(1, rounds + 1)]
        found = _rounds(links, state, ["idle", *columns, "v0"], rounds, damping).observe(facts, *idle).checkpoint()
        if not done:
            # The ranks began even: what the first block passes on is (dA)^k u.
            found = found.withColumns({f"u{k}": F.col(f"v{k}") for k in range(1, rounds)})
            columns = [f"u{k}" for k in range(1, rounds)]
            shared += [facts.get[f"v{k}"] for k in range(1, rounds)]
        base, ranks = [], [F.col("v0")]
        for k in range(1, rounds + 1):
            base.append((1 - damping) + damping * mass)
            ranks.append(sum((F.lit(b) * even(k - 1 - i) for i, b in enumerate(base)), F.col(f"v{k}")))
            mass = facts.get[f"v{k}"] + sum(b * shared[k - 1 - i] for i, b in enumerate(base))
        last = rounds
        if tolerance > 0:
            moved = found.agg(*[F.sum(F.abs(ranks[k] - ranks[k - 1])) for k in range(1, rounds + 1)]).first()
            last = next((k for k, d in enumerate(moved, 1) if d < n * tolerance), 0) or rounds
            done = iterations if moved[last - 1] < n * tolerance else done
        state = found.select("id", "idle", *columns, ranks[last].alias("v0"))
        done += rounds
    return known.select("id", "path").join(state.select("id", F.col("v0").alias("rank")), "id").select("path", "rank")


def chains(graph: DataFrame, start: DataFrame, *, depth: int = 3, reverse: bool = False) -> DataFrame:
    """``(start, depth, node, trail)``: files reached in at most ``depth`` (1 to 10) imports, no file twice on a trail.

    ``start(path)`` names where trails begin; ``reverse`` follows importers.
    """
    step = graph.select(F.col("dst").alias("_from"), F.col("src").alias("_to")) if reverse else graph.select(F.col("src").alias("_from"), F.col("dst").alias("_to"))
    front = start.select(F.col("path").alias("start"), F.col("path").alias("node"), F.array("path").alias("path"))
    out = None
    for k in range(1, max(1, min(depth, 10)) + 1):
        front = (
            front.join(step, front["node"] == step["_from"]).where(~F.array_contains("path", F.col("_to")))
            .select("start", F.col("_to").alias("node"), F.concat("path", F.array("_to")).alias("path"))
        )
        level = front.select("start", F.lit(k).alias("depth"), "node", F.array_join("path", " > ").alias("trail"))
        out = level if out is None else out.unionByName(level)
    return out


def analyze(edges: DataFrame, nodes: DataFrame, **options) -> DataFrame:
    """Degrees, level, score and rank of every file."""
    graph = import_graph(edges)
    degree = degrees(graph, nodes)
    ranks = pagerank(graph, nodes, **options)
    return degree.join(ranks, "path").withColumn("level", hub_level(F.col("in_degree"))).withColumn("hub_score", F.col("in_degree") * (1 + F.log1p("out_degree")))
