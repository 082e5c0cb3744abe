"""Symbol graphs: imports, calls, reachability, components.

A graph is two tables: nodes (id, name, file, kind) and edges (src, dst,
edge_type). Iterations write their state to the session's checkpoint folder
through `cut`, so a lost executor never means starting over.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.js", "/index.tsx")
#: Edges of a graph small enough for one process, and rows that its search may reach there.
#: Larger graphs are searched by joins, with the same result.
SMALL_EDGES, SMALL_REACH = 100_000, 300_000
#: Rounds of a search after which its layers are written as one table.
COMPACT = 16
WORKSPACE_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a checkpoint in the shared folder.

    The folder is spark.checkpoint.dir; where that is unset, as in tests, a
    temporary one.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def few_rows(written: DataFrame, most: int) -> list | None:
    """The rows of a checkpointed table of at most `most` rows, None of a larger one."""
    rows = written.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def resolve_imports(imports: DataFrame, files: DataFrame, workspace: DataFrame | None = None) -> DataFrame:
    """`imports` (path, pos, source, ...) with `resolved`, the imported file or null.

    A relative source is tried with each suffix in turn against the known
    files. Others go through `workspace` (package, entry): a package's own
    name first, else the longest package that is a prefix of the source.
    """
    known = files.select(F.col("path").alias("k_path")).distinct()
    target = paths.normalize(F.concat(paths.parent_directory(F.col("path"), "."), F.lit("/"), paths.dotted_to_path(F.col("source"))))
    relative = F.col("source").startswith(".")

    def candidates(base, suffixes: tuple[str, ...]):
        return F.array(*[F.struct(F.lit(i).alias("turn"), F.concat(base, F.lit(s)).alias("candidate")) for i, s in enumerate(suffixes)])

    keyed = imports.withColumn("__row", F.struct("path", "pos"))
    tried = keyed.where(relative).select("__row", F.explode(candidates(target, SUFFIXES)).alias("c")).select("__row", "c.*")
    if workspace is not None:
        # Every prefix of the source that could be a package, by equality with a package name.
        parts = F.split("source", "/")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("package"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/").alias("rest")))
        named = keyed.where(~relative).select("__row", F.size(parts).alias("size"), F.explode(prefixes).alias("p")).select("__row", "size", "p.*").join(workspace, "package")
        exact = named.where(F.col("n") == F.col("size")).select("__row", F.lit(-1).alias("turn"), F.col("entry").alias("candidate"))
        longest = named.where(F.col("n") < F.col("size")).groupBy("__row").agg(F.max_by(F.struct("entry", "rest"), "n").alias("m"))
        root = paths.parent_directory(paths.parent_directory(F.col("m.entry"), "."), ".")
        deep = longest.select("__row", F.explode(candidates(F.concat(root, F.lit("/"), F.col("m.rest")), WORKSPACE_SUFFIXES)).alias("c")).select("__row", "c.*")
        tried = tried.unionByName(exact).unionByName(deep)
    found = tried.join(known, F.col("candidate") == F.col("k_path")).groupBy("__row").agg(F.min_by("candidate", "turn").alias("resolved"))
    return keyed.join(found, "__row", "left").drop("__row")


def build_nodes(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """One module node for each file and one for each defined name; the first of an id counts."""
    modules = files.select(F.col("path").alias("id"), paths.file_stem(F.col("path")).alias("name"), F.col("path").alias("file"), F.lit("Module").alias("kind"), F.lit(-1).cast("bigint").alias("pos"))
    symbols = definitions.select(F.concat_ws("::", "path", "name").alias("id"), "name", F.col("path").alias("file"), "kind", F.col("pos").cast("bigint").alias("pos"))
    return modules.unionByName(symbols).groupBy("id").agg(F.min_by(F.struct("name", "file", "kind"), "pos").alias("n")).select("id", "n.*")


def import_edges(resolved: DataFrame, nodes: DataFrame, reexports: DataFrame) -> DataFrame:
    """Import edges from modules to the symbols or modules that they import.

    `resolved` is (path, resolved, name, is_default, is_namespace), name null
    for an import for its side effects. `reexports` is (path, name, resolved):
    where a file passes a name on.
    """
    ids = nodes.select(F.col("id").alias("known"))
    wanted = resolved.where("resolved IS NOT NULL").withColumn("symbol", F.concat_ws("::", "resolved", "name"))
    met = wanted.join(ids.withColumnRenamed("known", "s_known"), F.col("symbol") == F.col("s_known"), "left")
    whole = F.col("name").isNull() | (F.col("s_known").isNull() & (F.col("is_default") | F.col("is_namespace")))
    direct = met.where(F.col("name").isNotNull() & F.col("s_known").isNotNull()).select("path", F.col("symbol").alias("dst"))
    modules = met.where(whole).select("path", F.col("resolved").alias("dst"))
    passed = met.where(F.col("name").isNotNull() & F.col("s_known").isNull() & ~F.col("is_default") & ~F.col("is_namespace"))
    through = reexports.select(F.col("path").alias("r_path"), F.col("name").alias("r_name"), F.col("resolved").alias("r_resolved"))
    onward = passed.join(through, (F.col("resolved") == F.col("r_path")) & (F.col("name") == F.col("r_name"))).select("path", F.concat_ws("::", "r_resolved", "name").alias("dst"))
    every = direct.unionByName(modules).unionByName(onward).select(F.col("path").alias("src"), "dst", F.lit("Imports").alias("edge_type"))
    return with_known_ends(every, nodes)


def call_edges(calls: DataFrame, bindings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Call edges: imported names first, then methods of imported names, then names of the own file.

    `calls` is (path, pos, callee, containing_function), `bindings` (path,
    local, target): what a local name stands for.
    """
    ids = nodes.select(F.col("id").alias("known"))

    def known(df: DataFrame, column: str, flag: str) -> DataFrame:
        return df.join(ids.select(F.col("known").alias(f"__{flag}")), F.col(column) == F.col(f"__{flag}"), "left").withColumn(flag, F.col(f"__{flag}").isNotNull()).drop(f"__{flag}")

    named = calls.withColumn("own", F.when(F.col("containing_function").isNull(), F.col("path")).otherwise(F.concat_ws("::", "path", "containing_function")))
    named = known(named, "own", "has_own").withColumn("src", F.when(F.col("has_own"), F.col("own")).otherwise(F.col("path")))
    whole = bindings.select(F.col("path").alias("w_path"), F.col("local").alias("w_local"), F.col("target").alias("imported"))
    met = named.join(whole, (F.col("path") == F.col("w_path")) & (F.col("callee") == F.col("w_local")), "left").drop("w_path", "w_local")
    head = F.when(F.col("callee").contains("."), F.substring_index("callee", ".", 1))
    part = bindings.select(F.col("path").alias("p_path"), F.col("local").alias("p_local"), F.col("target").alias("module"))
    met = met.withColumn("head", head).join(part, (F.col("path") == F.col("p_path")) & (F.col("head") == F.col("p_local")), "left").drop("p_path", "p_local")
    member = F.expr("substring(callee, length(head) + 2)")
    met = met.withColumn("member", F.when(F.col("module").isNotNull(), F.concat_ws("::", "module", member))).withColumn("local", F.concat_ws("::", "path", "callee"))
    for column, flag in (("imported", "i"), ("member", "m"), ("module", "d"), ("local", "l")):
        met = known(met, column, flag)
    other = lambda c: F.col(c) != F.col("src")
    dst = (
        F.when(F.col("imported").isNotNull(), F.when(F.col("i") & other("imported"), F.col("imported")))
        .when(F.col("m") & other("member"), F.col("member"))
        .when(F.col("d") & other("module"), F.col("module"))
        .when(F.col("l") & other("local"), F.col("local"))
    )
    return with_known_ends(met.select("src", dst.alias("dst"), F.lit("Calls").alias("edge_type")).where("dst IS NOT NULL"), nodes)


def import_bindings(resolved: DataFrame, definitions: DataFrame) -> DataFrame:
    """(path, local, target): what each imported name stands for; the last import of a name counts."""
    defined = definitions.select(F.col("path").alias("d_path"), F.col("name").alias("d_name")).distinct()
    met = resolved.where("resolved IS NOT NULL AND name IS NOT NULL").join(defined, (F.col("resolved") == F.col("d_path")) & (F.col("name") == F.col("d_name")), "left")
    module = F.col("is_namespace") | (F.col("d_name").isNull() & F.col("is_default"))
    target = F.when(module, F.col("resolved")).otherwise(F.concat_ws("::", "resolved", "name"))
    return met.groupBy("path", F.coalesce("alias", "name").alias("local")).agg(F.max_by(target, F.struct("pos", "name_pos")).alias("target"))


def with_known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst", "edge_type")


def distances(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(seed, node, dist): hops from each seed along src -> dst.

    `edges` is (src, dst), `seeds` (seed, node). Breadth first: a round joins
    the frontier with the edges and drops what was reached before; cycles end
    the rounds, and `depth` bounds them.
    """
    steps = cut(edges.select("src", "dst").distinct())
    layers = [cut(seeds.select("seed", "node", F.lit(0).alias("dist")).distinct())]
    reached, round_ = layers[0], 0
    small = few_rows(steps, SMALL_EDGES)
    starts = few_rows(reached, SMALL_REACH) if small is not None else None
    if small is not None and starts is not None and (found := _searched(small, starts, depth)) is not None:
        return edges.sparkSession.createDataFrame(found, reached.schema)
    while depth is None or round_ < depth:
        round_ += 1
        ahead = layers[-1].select("seed", F.col("node").alias("src")).join(steps, "src").select("seed", F.col("dst").alias("node")).distinct()
        new = cut(ahead.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(round_).alias("dist")))
        if new.isEmpty():
            break
        layers.append(new)
        reached = reached.unionByName(new)
        if len(layers) % COMPACT == 0:
            reached = cut(reached)
    return reached


def _searched(edges: list, starts: list, depth: int | None) -> list | None:
    """Breadth-first search in this process; None once it reaches too many rows."""
    after: dict = {}
    for src, dst in edges:
        after.setdefault(src, []).append(dst)
    reached = {(seed, node): 0 for seed, node, _ in starts}
    front, round_ = list(reached), 0
    while front and (depth is None or round_ < depth):
        round_ += 1
        ahead = []
        for seed, node in front:
            for dst in after.get(node, ()):
                if (seed, dst) not in reached:
                    reached[seed, dst] = round_
                    ahead.append((seed, dst))
        if len(reached) > SMALL_REACH:
            return None
        front = ahead
    return [(seed, node, dist) for (seed, node), dist in reached.items()]


def file_reachability(edges: DataFrame, nodes: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """(entrypoint, file, dist): files from each entrypoint, forward hops at 1 and backward hops at 2.

    `entrypoints` is (entrypoint, file, symbol); the search starts at the
    symbol and at the file's module. Its own file is at 0.
    """
    start = entrypoints.select(F.col("entrypoint").alias("seed"), F.explode(F.array(F.concat_ws("::", "file", "symbol"), F.col("file"))).alias("node"))
    seeds = start.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select("seed", "node")
    # Both directions are one search over a graph that holds every node twice.
    ahead = edges.select(F.struct(F.lit(1).alias("hop"), F.col("src").alias("id")).alias("src"), F.struct(F.lit(1).alias("hop"), F.col("dst").alias("id")).alias("dst"))
    back = edges.select(F.struct(F.lit(2).alias("hop"), F.col("dst").alias("id")).alias("src"), F.struct(F.lit(2).alias("hop"), F.col("src").alias("id")).alias("dst"))
    twice = seeds.select("seed", F.explode(F.array(F.lit(1), F.lit(2))).alias("hop"), "node").select("seed", F.struct("hop", F.col("node").alias("id")).alias("node"))
    found = distances(ahead.unionByName(back), twice)
    met = found.select("seed", F.col("node.id").alias("node"), (F.col("dist") * F.col("node.hop")).alias("dist")).join(nodes.select(F.col("id").alias("node"), "file"), "node")
    own = entrypoints.select(F.col("entrypoint").alias("seed"), "file", F.lit(0).alias("dist"))
    every = met.select("seed", "file", "dist").unionByName(own)
    return every.groupBy(F.col("seed").alias("entrypoint"), "file").agg(F.min("dist").alias("dist"))


def nearest_entrypoint(reach: DataFrame, files: DataFrame) -> DataFrame:
    """(path, entrypoint, dist): the nearest entrypoint of each changed file, the first of equals; null without one."""
    best = reach.groupBy("file").agg(F.min(F.struct("dist", "entrypoint")).alias("b"))
    return files.select("path").distinct().join(best, F.col("path") == F.col("file"), "left").select("path", F.col("b.entrypoint").alias("entrypoint"), F.col("b.dist").alias("dist"))


def internal_edges(edges: DataFrame, nodes: DataFrame, group_files: DataFrame) -> DataFrame:
    """(group_id, src, dst, edge_type): edges with both ends in files of one group."""
    file_of = nodes.select(F.col("id"), F.col("file"))
    ends = edges.join(file_of.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src").join(file_of.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst")
    a = group_files.select("group_id", F.col("path").alias("src_file"))
    b = group_files.select(F.col("group_id").alias("b_group"), F.col("path").alias("b_file"))
    return ends.join(a, "src_file").join(b, (F.col("dst_file") == F.col("b_file")) & (F.col("group_id") == F.col("b_group")), "left_semi").select("group_id", "src", "dst", "edge_type")


def call_chain(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(seed, node, dist): symbols over call edges only, up to a depth, without the start itself."""
    return distances(edges.where("edge_type = 'Calls'"), start, depth).where("dist > 0")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components, named by their least node.

    Stars are contracted alternately: larger neighbours move to a node's least
    neighbour, then smaller ones do. Rounds grow with the logarithm of the
    longest path, not with the path.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    star = cut(oriented(edges.select("a", "b")))
    small = few_rows(star, SMALL_EDGES)
    if small is not None:
        kind = star.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame(_joined(small), f"node {kind}, component {kind}")
    seen = digest(star)
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = oriented(both.join(least, both["a"] == least["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        star = cut(oriented(large.join(least, large["a"] == least["k"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))))
        now = digest(star)
        if now == seen:
            break
        seen = now
    roots = star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _joined(edges: list) -> list:
    """(node, component) by union of the least members, in this process."""
    up: dict = {}

    def root(x):
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = above
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
    return [(x, root(x)) for x in list(up)]
