"""WARC fixity audit by Merkle trees.

Pages are laid out as records of WARC files; a record's offset follows from
the records before it in its file. Each file gets a tree: leaves hash single
records, a node hashes the concatenated hashes of up to `FANOUT` neighbours
and covers their ordered offset range, the root covers the file. A record's
slot in its file follows from its id, not from the records before it, so one
missing record changes one node of each level. To compare replicas, roots are
joined first; below a root that agrees nothing is read,
and every further level joins only the children of nodes that differ.

Only DataFrame functions are used. Files hold a bounded number of records, so
no window or list grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Records in a file at most, and children of a node.
FILE_RECORDS, FANOUT = 512, 8


def levels(file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> int:
    """Levels above the leaves until one node covers a file."""
    n, height = file_records, 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return max(1, height)


def serialize(url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record; null parts are empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, place, slot, page_id, copies, hash, begin, end): one leaf for each distinct record of `pages`.

    File = id div `file_records`, so a file holds the records of one id range
    in order of id; null ids have a file of their own. Rows that repeat a
    record are one leaf with their number in `copies`, which the offsets and
    the tree count. Where different records of repeated ids overfill a file,
    they spread by hash over parts of it. `place` is a leaf's number in its
    file; `slot` the id's offset in its range, in parts and for null ids a
    remainder of the record's hash. Leaves may share a slot, and slots may be empty.
    """
    body = serialize(F.col(f"`{url}`"), F.col(f"`{html}`"))
    leaf = pages.select(F.col(f"`{id}`").cast("bigint").alias("page_id"), F.sha2(body.cast("binary"), 256).alias("hash"), F.octet_length(body).cast("bigint").alias("size"))
    leaf = leaf.groupBy("page_id", "hash", "size").agg(F.count(F.lit(1)).alias("copies"))
    leaf = materialize(leaf.withColumn("range", F.floor(F.col("page_id") / file_records).cast("bigint")), "warc-leaves")
    over = leaf.groupBy("range").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > file_records)
    over = over.select(F.col("range").alias("o_range"), F.ceil(F.col("n") * 2 / file_records).cast("bigint").alias("parts"))
    spread = leaf.join(over, F.col("range").eqNullSafe(F.col("o_range")), "left")
    part = F.when(F.col("parts").isNull(), F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64("hash"), F.col("parts")))
    spread = spread.withColumn("file", F.concat_ws("-", F.coalesce(F.col("range").cast("string"), F.lit("none")), part.cast("string")))
    by = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_last(), "hash")
    bytes_of = F.col("size") * F.col("copies")
    before = F.coalesce(F.sum(bytes_of).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    placed = spread.withColumn("place", (F.row_number().over(by) - 1).cast("bigint")).withColumn("begin", before)
    by_hash = F.pmod(F.xxhash64("hash"), F.lit(file_records)).cast("bigint")
    placed = placed.withColumn("slot", F.when(F.col("page_id").isNull() | F.col("parts").isNotNull(), by_hash).otherwise(F.col("page_id") - F.col("range") * file_records))
    return placed.select("file", "place", "slot", "page_id", "copies", "hash", "begin", (F.col("begin") + bytes_of).alias("end"))


def tree(leaves: DataFrame, file_records: int = FILE_RECORDS, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of (file, slot, hash, begin, end) from the leaves up to the roots.

    A file that spreading by hash left a little overfull has a root with more children.
    """
    out = [materialize(leaves, "warc-placed")]
    height = levels(file_records, fanout)
    for level in range(1, height + 1):
        # At the top all that is left of a file joins in one node.
        up = F.lit(0).cast("bigint") if level == height else F.floor(F.col("slot") / fanout).cast("bigint")
        mark = F.concat_ws(":", "hash", F.col("copies").cast("string")) if level == 1 else F.col("hash")
        child = F.struct(F.col("slot"), F.col("page_id" if level == 1 else "slot").alias("id"), mark.alias("hash"))
        node = out[-1].select("file", up.alias("up"), child.alias("child"), "begin", "end").groupBy("file", "up")
        # The slot is hashed as well, so that a node tells where its children lie.
        hashed = F.sha2(F.array_join(F.transform(F.array_sort("children"), lambda c: F.concat_ws(":", c["slot"].cast("string"), c["hash"])), ","), 256)
        grown = node.agg(F.collect_list("child").alias("children"), F.min("begin").alias("begin"), F.max("end").alias("end"))
        out.append(grown.select("file", F.col("up").alias("slot"), hashed.alias("hash"), "begin", "end"))
    return out


def corpus_root() -> Column:
    """Order-free digest of all file roots: the sum of their hashes' leading 60 bits."""
    return F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", "file", "hash"), 256), 1, 15), 16, 10).cast("decimal(38,0)"))


def corpus_root_of(pages_tree: list[DataFrame]) -> DataFrame:
    """One row with the digest of a whole replica."""
    return pages_tree[-1].agg(corpus_root().alias("root"))


def audit(left: list[DataFrame], right: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(file, place, page_id, state, begin, end) of each record that differs.

    `left` is the replica trusted for offsets, `right` the other; both are
    `tree` results. State is `corrupt` where both have a record of the id at
    the place but the hashes differ, `missing` where only `left` has it and
    `extra` where only `right` has it. Equal replicas give no rows; so do two
    empty ones.
    """
    top = len(left) - 1
    differing: DataFrame | None = None
    for level in range(top, -1, -1):
        a, b = left[level], right[level]
        if differing is not None:
            # Children of a differing node only; the children of the root are all that is left of the file.
            up = F.lit(0).cast("bigint") if level == top - 1 else F.floor(F.col("slot") / fanout).cast("bigint")
            keys = differing.select(F.col("file").alias("d_file"), F.col("slot").alias("d_slot"))
            met = (F.col("file") == F.col("d_file")) & (up == F.col("d_slot"))
            a, b = a.join(keys, met, "left_semi"), b.join(keys, met, "left_semi")
        if level == 0:
            break
        x = a.select("file", "slot", F.col("hash").alias("x"))
        y = b.select(F.col("file").alias("r_file"), F.col("slot").alias("r_slot"), F.col("hash").alias("y"))
        both = x.join(y, (F.col("file") == F.col("r_file")) & (F.col("slot") == F.col("r_slot")), "full")
        differing = materialize(both.where(~F.col("x").eqNullSafe(F.col("y"))).select(F.coalesce("file", "r_file").alias("file"), F.coalesce("slot", "r_slot").alias("slot")), f"warc-{level}")
    # Inside the leaf ranges left, records that both replicas hold cancel out; of
    # the others those of one id are paired in order.
    mark = F.concat_ws(":", "hash", F.col("copies").cast("string"))
    x, y = (d.withColumn("hash", mark) for d in (a, b))

    def only(one: DataFrame, other: DataFrame) -> DataFrame:
        # Not by file: an overfull range may have another number of parts in the other replica.
        held = other.select(F.col("page_id").alias("o_id"), F.col("hash").alias("o_hash"))
        met = F.col("page_id").eqNullSafe(F.col("o_id")) & (F.col("hash") == F.col("o_hash"))
        return one.join(held, met, "left_anti").withColumn("turn", F.row_number().over(Window.partitionBy("file", "page_id").orderBy("place")))

    x, y = only(x, y), only(y, x).select(*[F.col(c).alias(f"r_{c}") for c in ("file", "place", "page_id", "hash", "begin", "end")], F.col("turn").alias("r_turn"))
    same = (F.col("file") == F.col("r_file")) & F.col("page_id").eqNullSafe(F.col("r_page_id")) & (F.col("turn") == F.col("r_turn"))
    pair = x.join(y, same, "full")
    state = F.when(F.col("r_hash").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("corrupt")
    return pair.select(*[F.coalesce(c, f"r_{c}").alias(c) for c in ("file", "place", "page_id")], state.alias("state"), *[F.coalesce(c, f"r_{c}").alias(c) for c in ("begin", "end")])
