"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The benchmark's windows (8 consecutive words, or all words of a shorter item)
become a table of hashes that every task holds. Each document's windows are
hashed, joined with it, and verified word by word. Only hits are shuffled:
they fold to one row for each text that has any, which is joined back to the
documents, so that clean documents cross no shuffle.

Both broadcast tables are counted first. Beyond `BROADCAST_WINDOWS` windows, or
`BROADCAST_HITS` texts with hits, the same join shuffles, with the same result.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: Everything between two words, after A-Z are lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A separator run with the word after it, and what follows the last word, in texts as they are written.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TAIL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z"
WINDOW = 8
#: Most windows, and most texts with hits, that are broadcast.
BROADCAST_WINDOWS, BROADCAST_HITS = 1_000_000, 500_000


def words(text: Column) -> Column:
    """Normalised words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows: words, hash, length and the ids of the items that hold them.

    Items without words have no window; repeated items and repeated windows
    count once, and a null item id is kept as no id.
    """
    cut = benchmark.select(F.col(f"`{item}`").alias("item"), words(F.col(f"`{text}`")).alias("ws")).where(F.size("ws") > 0)
    spans = F.when(F.size("ws") <= size, F.array(F.col("ws"))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - (size - 1), F.lit(1))), lambda i: F.slice(F.col("ws"), i, size))
    )
    each = cut.select("item", F.explode(F.array_distinct(spans)).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items")).select("window", F.xxhash64(F.transform("window", lambda w: F.xxhash64(w))).alias("hash"), F.size("window").alias("length"), "items")


def _row_windows(hashes: Column, length: int) -> Column:
    """Hash of every window of `length` words in order, given the words' hashes.

    Hashing one value after the other is what hashing their array does.
    """
    last = F.size(hashes) - (length - 1)
    window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(length)])
    return F.when(last >= 1, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), window)).otherwise(F.array().cast("array<bigint>"))


def _placed(place: Column, words: Column, lengths: list[int]) -> Column:
    """Length and 1-based start of the window at a place of the windows of all lengths laid end to end."""
    out = F.struct(F.lit(0).alias("length"), F.lit(0).alias("at"))
    before = [F.lit(0)]
    for k in lengths:
        before.append(before[-1] + F.greatest(F.size(words) - (k - 1), F.lit(0)))
    for i in reversed(range(len(lengths))):
        own = F.struct(F.lit(lengths[i]).alias("length"), (place - before[i] + 1).alias("at"))
        out = own if i == len(lengths) - 1 else F.when(place < before[i + 1], own).otherwise(out)
    return out


def _key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, item: str = "item_id", item_text: str = "text", size: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each row of `docs`: the columns of `keep` (all by default) in
    a struct `row`, n_words, n_hit, items (sorted as strings) and hits, the
    sorted 0-based [from, to) word ranges that benchmark windows cover.

    Null and empty texts have no words and no hits. Repeated rows and doc ids
    stay separate rows. Without benchmark windows nothing is hit. Columns of
    `docs` cannot clash: they travel inside `row`.
    """
    keep = docs.columns if keep is None else keep
    known = materialize(benchmark_windows(benchmark, item, item_text, size), "benchmark-windows")
    # One row for each length from 1 to `size`.
    lengths = {r["length"]: r["n"] for r in known.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    body = F.col(f"`{text}`")
    # Rows of one text have the same hits, so its digest is the key that hits travel by.
    base = docs.select(_key(body).alias("key"), words(body).alias("ws")).withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))
    sizes = sorted(lengths)
    every = F.concat(*[_row_windows(F.col("hs"), k) for k in sizes]) if sizes else F.array().cast("array<bigint>")
    each = base.select("key", "ws", F.posexplode(every).alias("place", "hash"))
    against = known.select(F.col("hash").alias("k_hash"), F.col("window").alias("k_window"), "items")
    against = F.broadcast(against) if sum(lengths.values()) <= broadcast_windows else against
    # Only the hash is a key of the join; words are compared where it is met.
    met = each.join(against, F.col("hash") == F.col("k_hash")).withColumn("w", _placed(F.col("place"), F.col("ws"), sizes)).select("key", "ws", "k_window", "items", "w.*")
    same = F.forall(F.zip_with(F.slice("ws", F.col("at"), F.col("length")), "k_window", lambda a, b: a.eqNullSafe(b)), lambda x: x)
    met = met.where((F.col("length") > 0) & same)
    span = F.struct((F.col("at") - 1).alias("from"), (F.col("at") - 1 + F.col("length")).alias("to"))
    hits = materialize(met.select("key", span.alias("span"), "items").groupBy("key").agg(F.collect_set("span").alias("spans"), F.collect_set("items").alias("items")), "hits")
    hits = F.broadcast(hits) if hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS else hits
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), _key(body).alias("key"), F.size(words(body)).cast("bigint").alias("n_words"))
    rows = rows.join(hits, "key", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")))
    rows = rows.withColumn("items", F.coalesce("items", F.array().cast(hits.schema["items"].dataType)))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(
        F.array_sort("spans"),
        start,
        lambda s, x: F.struct(F.greatest(s["end"], x["to"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["from"], s["end"]))).alias("n")),
        lambda s: s["n"],
    )
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten("items")), lambda x: x.cast("string")))
    return rows.select("row", "n_words", covered.alias("n_hit"), ids.alias("items"), F.array_sort("spans").alias("hits"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", drop_from: int = 2, **names) -> DataFrame:
    """`docs` without contaminated documents and with the hit words cut from the others.

    A document in which windows of `drop_from` items or more occur is dropped;
    with fewer, its hit words go with the separators before them and the rest
    stays. Documents without hits pass unchanged, null texts included. A
    column `n_chars` follows the new text if there is one.
    """
    found = find(docs, benchmark, text, **names).where(F.size("items") < drop_from)
    body = F.col("row")[text]
    pieces = F.regexp_extract_all(body, F.lit(PIECE), F.lit(0))
    kept = F.filter(pieces, lambda x, i: ~F.exists(F.col("hits"), lambda h: (i >= h["from"]) & (i < h["to"])))
    tail = F.regexp_extract(body, TAIL, 0)
    cut = F.when(F.size("hits") == 0, body).otherwise(F.concat(F.array_join(kept, ""), tail))
    out = found.withColumn("__text", cut)
    changed = {text: F.col("__text")} | ({"n_chars": F.when(F.size("hits") == 0, F.col("row")["n_chars"]).otherwise(F.length("__text")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])

