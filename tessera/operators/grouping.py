"""Groups of files by directories, stems and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

SMALL_GROUP, MOST_MERGED, LARGE_CHANGE = 5, 12, 2000


def large_partitions(files: DataFrame) -> DataFrame:
    """(bucket, is_infra, files): coarse buckets of a very large change set, files sorted and distinct."""
    bucket = paths.partition_key(F.col("path"))
    return files.groupBy(bucket.alias("bucket")).agg(F.array_sort(F.collect_set("path")).alias("files")).select("bucket", F.col("bucket").startswith("infra:").alias("is_infra"), "files")


def by_directory(files: DataFrame) -> DataFrame:
    """(directory, name, files): one group for each parent directory."""
    groups = files.groupBy(paths.parent_directory(F.col("path"), "").alias("directory")).agg(F.array_sort(F.collect_set("path")).alias("files"))
    last = F.substring_index("directory", "/", -1)
    return groups.select("directory", F.concat(F.when(F.col("directory") == "", "root").otherwise(last), F.lit(" (directory)")).alias("name"), "files")


def renumbered(groups: DataFrame) -> DataFrame:
    """Groups numbered by their first file, then by name."""
    from .ranking import in_order

    key = F.coalesce(F.get("files", F.lit(0)), "name")
    return in_order(groups, [key, F.asc("name")], "number").withColumn("group_id", F.concat(F.lit("group_"), F.col("number").cast("string")))


def common_prefix(files: Column) -> Column:
    """Longest directory prefix that all files share, Mixed without one."""
    folders = F.transform(files, lambda p: F.split(p, "/"))
    shared = F.aggregate(
        F.slice(folders, 2, F.greatest(F.size(folders) - 1, F.lit(0))),
        F.slice(folders[0], 1, F.greatest(F.size(folders[0]) - 1, F.lit(0))),
        lambda s, x: F.slice(s, 1, _agreeing(s, x)),
    )
    alone = F.when(files[0].contains("/"), F.regexp_replace(files[0], "/[^/]*$", "/")).otherwise(files[0])
    return F.when(F.size(files) == 0, "Unknown").when(F.size(files) == 1, alone).when(F.size(shared) == 0, "Mixed").otherwise(F.concat(F.array_join(shared, "/"), F.lit("/")))


def _agreeing(a: Column, b: Column) -> Column:
    """Number of leading elements that agree."""
    same = F.zip_with(a, F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), lambda x, y: F.coalesce(x == y, F.lit(False)))
    same = F.slice(same, 1, F.least(F.size(a), F.size(b)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first.cast("int") - 1)


def merged_at(groups: DataFrame, depth: int) -> DataFrame:
    """Small groups without an entrypoint merged where they share a directory prefix.

    `groups` is (group_id, name, entrypoint, files). A bucket of more than
    `MOST_MERGED` groups is merged by the parent directory of each group's
    first file. The first group of a merged set, by order, gives its name.
    """
    prefixes = F.transform("files", lambda p: paths.directory_prefix(p, depth))
    agreed = (F.size("files") > 0) & F.forall(prefixes, lambda p: F.coalesce(p == prefixes[0], F.lit(False)))
    small = F.col("entrypoint").isNull() & (F.size("files") <= SMALL_GROUP) & agreed
    marked = groups.withColumn("prefix", F.when(small, prefixes[0])).withColumn("parent", paths.parent_directory(F.get("files", F.lit(0)), None))
    # Rows are groups here; those without a prefix stay by themselves.
    alike = Window.partitionBy(F.coalesce("prefix", F.lit("")), F.when(F.col("prefix").isNull(), F.col("number")).otherwise(-1))
    met = marked.withColumn("n", F.when(F.col("prefix").isNotNull(), F.count(F.lit(1)).over(alike)))
    parent = F.coalesce("parent", F.get("files", F.lit(0)))
    bucket = F.when(F.col("n") > MOST_MERGED, F.concat_ws("\0", F.lit("p"), "prefix", parent)).when(F.col("n") > 1, F.concat_ws("\0", F.lit("d"), "prefix")).otherwise(F.concat_ws("\0", F.lit("g"), F.col("number").cast("string")))
    first = F.min_by(F.struct("name", "entrypoint"), "number")
    merged = met.groupBy(bucket.alias("bucket")).agg(first.alias("first"), F.array_sort(F.flatten(F.collect_list("files"))).alias("files"), F.min("number").alias("prior"), F.count(F.lit(1)).alias("merged"))
    kept = merged.select(F.col("first.name").alias("name"), F.col("first.entrypoint").alias("entrypoint"), "files", "prior")
    # Groups are far fewer than files; their order by name is one sort of group rows.
    return kept.withColumn("number", F.row_number().over(Window.orderBy("name", "prior"))).drop("prior")


def consolidated(groups: DataFrame) -> DataFrame:
    """Small groups merged at directory depths 6 down to 0, then numbered by name."""
    out = groups.withColumn("number", F.row_number().over(Window.orderBy("name", F.get("files", F.lit(0)))))
    from .graph import cut

    for depth in range(6, -1, -1):
        out = cut(merged_at(out, depth))
    return out.withColumn("group_id", F.concat(F.lit("group_"), F.col("number").cast("string")))


def infrastructure_groups(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, category, files): infrastructure by category, then by connection, then by directory.

    `edges` is (from_file, to_file). What is left over is Unclassified.
    """
    from .graph import components

    own = files.select("path", paths.category(F.col("path")).alias("category")).distinct()
    named = own.where(F.col("category") != "Unclassified").groupBy("category").agg(F.array_sort(F.collect_list("path")).alias("files"))
    named = named.select(paths.lookup(F.col("category"), paths.CATEGORY_LABELS).alias("name"), "category", "files")
    rest = own.where(F.col("category") == "Unclassified").select("path")
    a, b = rest.select(F.col("path").alias("from_file")), rest.select(F.col("path").alias("to_file"))
    inner = edges.select("from_file", "to_file").where("from_file != to_file").join(a, "from_file", "left_semi").join(b, "to_file", "left_semi")
    linked = components(inner.select(F.col("from_file").alias("a"), F.col("to_file").alias("b")))
    connected = linked.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("files"))
    connected = connected.select(common_prefix(F.col("files")).alias("name"), F.lit("DirectoryGroup").alias("category"), "files")
    loose = rest.join(linked.select(F.col("node").alias("path")), "path", "left_anti")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "/")).otherwise("")
    near = loose.groupBy(folder.alias("name")).agg(F.array_sort(F.collect_list("path")).alias("files"))
    together = near.where(F.size("files") >= 2).select("name", F.lit("DirectoryGroup").alias("category"), "files")
    alone = near.where(F.size("files") < 2).agg(F.array_sort(F.flatten(F.collect_list("files"))).alias("files")).where(F.size("files") > 0)
    alone = alone.select(F.lit("Unclassified").alias("name"), F.lit("Unclassified").alias("category"), "files")
    return named.unionByName(connected).unionByName(together).unionByName(alone)


def nearest_by_directory(files: DataFrame, group_files: DataFrame, least: int = 2) -> DataFrame:
    """(path, group_no): the group with the longest shared path prefix, the first of equals.

    Prefixes of both sides are joined by equality, so no pair is made that
    shares nothing.
    """

    def prefixes(df: DataFrame, *keep: str) -> DataFrame:
        parts = F.split("path", "/")
        each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("prefix")))
        return df.select(*keep, F.explode(each).alias("p")).select(*keep, "p.depth", "p.prefix").where(F.col("depth") >= least)

    # One row for each prefix: the first group that has it.
    known = prefixes(group_files, "group_no").groupBy("prefix").agg(F.min("group_no").alias("group_no"))
    met = prefixes(files, "path").join(known, "prefix")
    return met.groupBy("path").agg(F.max_by("group_no", "depth").alias("group_no"))


def nearest_by_topic(files: DataFrame, group_files: DataFrame) -> DataFrame:
    """(path, group_no, score): the group with a file that shares most topic words.

    Two words suffice, the first group of equals then counts; a single word
    only if one group alone shares it.
    """
    left = files.select("path", F.explode(paths.topic_tokens(F.col("path"))).alias("token"))
    right = group_files.select("group_no", F.col("path").alias("other"), F.explode(paths.topic_tokens(F.col("path"))).alias("token"))
    shared = left.join(right, "token").groupBy("path", "group_no", "other").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("path", "group_no").agg(F.max("n").alias("score"))
    top = best.groupBy("path").agg(F.max("score").alias("score"))
    tops = best.join(top, ["path", "score"]).groupBy("path", "score").agg(F.min("group_no").alias("group_no"), F.count(F.lit(1)).alias("ties"))
    return tops.where((F.col("score") >= 2) | (F.col("ties") == 1)).select("path", "group_no", "score")


def unique_most(files: DataFrame, group_files: DataFrame, key) -> DataFrame:
    """(path, group_no): the one group with most files of the same key, none where two are equal."""
    left = files.select("path", key(F.col("path")).alias("k")).where("k IS NOT NULL")
    counts = group_files.select("group_no", key(F.col("path")).alias("k")).where("k IS NOT NULL").groupBy("k", "group_no").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("k").agg(F.max("n").alias("n"))
    only = counts.join(top, ["k", "n"]).groupBy("k").agg(F.min("group_no").alias("group_no"), F.count(F.lit(1)).alias("ties")).where("ties = 1")
    return left.join(only, "k").select("path", "group_no")


def tests_with_their_subjects(assigned: DataFrame) -> DataFrame:
    """(path, group_no): test files moved to the group of the file they test.

    `assigned` is (path, group_no). A subject is matched by directory context
    and stem, else by its bare name; of several the last by path counts.
    """
    kinds = assigned.select("path", "group_no", paths.is_test_file(F.col("path")).alias("test"), paths.contextual_stem(F.col("path")).alias("stem"))
    name = F.regexp_replace(paths.filename(F.col("path")), r"\.[^.]*$", "")
    unmarked = name
    for mark in (".test", ".spec", "_test", "test_"):
        unmarked = F.replace(unmarked, F.lit(mark), F.lit(""))
    kinds = kinds.withColumn("bare", F.when(F.col("test"), unmarked).otherwise(name))
    subjects = kinds.where(~F.col("test"))
    by_stem = subjects.groupBy("stem").agg(F.max_by("group_no", "path").alias("g_stem"))
    by_name = subjects.groupBy("bare").agg(F.max_by("group_no", "path").alias("g_bare"))
    met = kinds.join(by_stem, "stem", "left").join(by_name, "bare", "left")
    moved = F.when(F.col("test"), F.coalesce("g_stem", "g_bare", "group_no")).otherwise(F.col("group_no"))
    return met.select("path", moved.alias("group_no"))


def merged_by_stem(group_files: DataFrame) -> DataFrame:
    """(path, group_no): groups that share a stem between a test and what it tests become one.

    A stem counts where exactly two groups have it, one with a test and one
    with a file that is none. Merging makes no such stem invalid, so all of
    them are merged at once, round by round, until none is left; the largest
    group, the first of equals, gives its number.
    """
    from .graph import components, cut

    p = F.col("path")
    now = cut(group_files.select("path", "group_no", paths.bare_stem(p).alias("stem"), paths.is_test_file(p).alias("test")))
    while True:
        by_group = now.where("stem != ''").groupBy("stem", "group_no").agg(F.bool_or("test").alias("t"), F.bool_or(~F.col("test")).alias("i"))
        shared = by_group.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.bool_or("t").alias("t"), F.bool_or("i").alias("i"), F.min("group_no").alias("a"), F.max("group_no").alias("b"))
        links = cut(shared.where("n = 2 AND t AND i").select("a", "b").distinct())
        if links.isEmpty():
            return now.select("path", "group_no")
        sizes = now.groupBy("group_no").agg(F.count(F.lit(1)).alias("n"))
        named = components(links).join(sizes, F.col("node") == F.col("group_no"))
        largest = named.groupBy("component").agg(F.min_by("node", F.struct(-F.col("n"), "node")).alias("into"))
        to = named.join(largest, "component").select(F.col("node").alias("old"), "into")
        now = cut(now.join(to, F.col("group_no") == F.col("old"), "left").select("path", F.coalesce("into", "group_no").alias("group_no"), "stem", "test"))
