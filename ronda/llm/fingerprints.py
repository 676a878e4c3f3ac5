"""Document fingerprints: the smallest k hashes of a text's word shingles.

Everything is built from Spark SQL expressions.  Sketches of parts merge into
the sketch of the whole, and estimate resemblance, containment and the number
of distinct shingles; below k shingles they are exact.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ronda.llm.store import partitions

SHINGLE_WORDS = 5
K = 256
SALTS = 64
HASHES = 2.0**64
TASK_BYTES = 16 << 20  # of texts that a task takes; sketching them takes some ten seconds
COPIES = 4096  # equal rows that one row stands for


def words(text: Column) -> Column:
    """Words of a text in lower case: what stands between white space (ASCII)."""
    return F.array_remove(F.split(F.lower(text), "[ \\t-\\r]+"), "")


def sketch(words_col: str, k: int = K, size: int = SHINGLE_WORDS) -> Column:
    """The k smallest distinct hashes of shingles of ``size`` words, ascending.

    ``words_col`` names a column of words.  Fewer words than ``size`` are one
    shingle; no words, or null, have no shingle.
    """
    own = F.col(words_col)
    starts = F.sequence(F.lit(0), F.size(own) - size)
    hashed = F.transform(starts, lambda i: F.xxhash64(*(F.get(own, i + j) for j in range(size))))
    found = F.when(F.size(own) >= size, hashed).when(F.size(own) >= 1, F.array(F.xxhash64(own)))
    return F.slice(F.sort_array(F.array_distinct(F.coalesce(found, F.array().cast("array<bigint>")))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of both parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, from how densely the hashes lie."""
    kth = (F.element_at(a, -1).cast("double") + HASHES / 2) / HASHES
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second one has; an empty text is contained."""
    either = distinct_shingles(merged(a, b, k), k)
    shared = resemblance(a, b, k) * either
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merged_by(sketches: DataFrame, key: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """(key, sketch): one sketch for all parts of each key, null keys together.

    Hashes are dealt out by key and hash, so that no task holds a whole key, and
    each share keeps its k smallest before those of a key meet.
    """
    hashes = sketches.select(F.col(key), F.explode(sketch_col).alias("h")).distinct()
    shares = hashes.withColumn("share", F.pmod("h", F.lit(SALTS)))
    for by in ([key, "share"], [key]):
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
        shares = shares.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
    found = shares.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch_col))
    empty = F.array().cast("array<bigint>")
    keys = sketches.select(F.col(key).alias("_key")).distinct()
    return keys.join(found, F.col("_key").eqNullSafe(F.col(key)), "left").select(
        F.col("_key").alias(key), F.coalesce(sketch_col, F.lit(empty)).alias(sketch_col)
    )


def _bucket(id_col: Column, bounds: list[int]) -> Column:
    """How many bounds lie below an id, by binary search; -1 for a null id."""
    steps = len(bounds).bit_length()
    padded = F.lit([*bounds, *([2**63 - 1] * ((1 << steps) - len(bounds)))]).cast("array<bigint>")
    found = F.aggregate(
        F.lit([1 << s for s in range(steps - 1, -1, -1)]).cast("array<int>"),
        F.lit(0),
        lambda at, step: F.when(F.get(padded, at + step - 1) < id_col, at + step).otherwise(at),
    )
    return F.when(id_col.isNull(), -1).otherwise(found)


def _shares(own: DataFrame, task_bytes: int) -> tuple[int, list[int], dict[int | None, int]]:
    """(tasks, bounds of ids, shares of the ids that fill more than a range; None is the null id)."""
    n = F.count(F.lit(1)).alias("n")
    size = own.agg(F.sum(F.octet_length("text")).alias("bytes"), n, F.count_if(F.col("id").isNull()).alias("nulls")).first()
    tasks = max(partitions(own.sparkSession), -(-(size["bytes"] or 0) // task_bytes))
    count = 2 * tasks
    at = [k / count for k in range(1, count)]
    cuts = own.select(F.percentile_approx("id", at, max(10_000, 20 * count))).first()[0] or []
    shares: dict[int | None, int] = {i: times + 1 for i, times in Counter(cuts).items() if times > 1}
    nulls = -(-count * size["nulls"] // max(size["n"], 1))
    if nulls > 1:
        shares[None] = nulls
    return tasks, sorted(set(cuts)), shares


def with_next(docs: DataFrame, id_col: str, text_col: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(id, text, h, bucket, sub, guest, last, copies): documents dealt to ranges, with the one that follows each range.

    The order is by descending id, null ids last, then by the hash of the text;
    the first follows the last.  Ranges are as many as the texts' size asks for.
    An id that fills more than one of them, or the null id, is divided by the
    hash of the text, and its equal texts become one row for the last of them
    and rows of up to ``COPIES`` others (``last`` false), which are followed by
    their own text and may lie anywhere.  A range's guest is the first document
    of the next range.  The driver holds a few numbers for each range.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    tasks, bounds, shares = _shares(own, task_bytes)
    whole = 2 * tasks + 1  # above the number of shares of any id
    h = F.xxhash64("text").alias("h")
    named_ids = [i for i in shares if i is not None]
    full = F.coalesce(F.col("id").isin(named_ids), F.lit(None in shares)) if named_ids else F.col("id").isNull() & F.lit(None in shares)
    rows = own.where(~full).select("id", "text", h, F.lit(whole).alias("sub"), F.lit(True).alias("last"), F.lit(1).alias("copies"))
    others = None
    if shares:
        parts = F.when(F.col("id").isNull(), F.lit(shares.get(None, 1))).otherwise(
            F.get(F.lit([shares[i] for i in named_ids] or [1]), (F.array_position(F.lit(named_ids).cast("array<bigint>"), F.col("id")) - 1).cast("int"))
        )
        sub = F.least(F.floor((F.col("h") / HASHES + 0.5) * parts), parts - 1).cast("int").alias("sub")
        equal = own.where(full).groupBy("id", "text").count().select("id", "text", h, "count")
        rows = rows.union(equal.select("id", "text", "h", sub, F.lit(True), F.lit(1)))
        chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 2) / COPIES))).alias("chunk")
        more = equal.where("count > 1").select("id", "text", "h", "count", chunk)
        left = F.col("count") - 1 - F.col("chunk") * COPIES
        others = more.select(
            "id", "text", "h", F.pmod(F.xxhash64("h", "chunk"), F.lit(whole)).cast("int"), F.lit(False), F.least(left, F.lit(COPIES)).cast("int"),
            F.lit(-2), F.lit(False),
        )
    rows = rows.withColumn("bucket", _bucket(F.col("id"), bounds))
    found = rows.groupBy("bucket", "sub").agg(F.max("id").alias("id")).collect()
    firsts = sorted(((r["bucket"], r["sub"], r["id"] or 0) for r in found), key=lambda r: (-r[0], r[1]))
    follows = [(*firsts[(k + 1) % len(firsts)], bucket, sub) for k, (bucket, sub, _) in enumerate(firsts)]
    named = spark.createDataFrame(follows, "from_bucket int, from_sub int, first long, to_bucket int, to_sub int")
    met = (F.col("bucket") == F.col("from_bucket")) & (F.col("sub") == F.col("from_sub")) & (F.coalesce("id", F.lit(0)) == F.col("first"))
    first = F.min(F.struct("h", "text", "id")).alias("g")
    guests = rows.join(F.broadcast(named), met).groupBy("to_bucket", "to_sub").agg(first)
    rows = rows.withColumn("guest", F.lit(False)).union(
        guests.select("g.id", "g.text", "g.h", "to_sub", F.lit(True), F.lit(1), "to_bucket", F.lit(True))
    )
    return (rows if others is None else rows.union(others)).repartition(tasks, "bucket", "sub")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """(id_col, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next) per row.

    The edited text is the text with its last third replaced by the beginning
    of the next document in descending order of ids.  Ids that repeat are
    ordered by a hash of their text; null ids come last; a null text is an empty
    one, and two texts without words are alike.  Other columns are ignored; an
    empty table has no rows.  A task takes some ``task_bytes`` of texts, however
    many documents share an id or have none, and texts are never cut: one text
    costs memory in proportion to its length.  Many terabytes want larger tasks.
    """
    order = Window.partitionBy("bucket", "sub").orderBy("guest", F.desc_nulls_last("id"), "h", "text")
    rows = with_next(docs, id_col, text_col, task_bytes)
    follower = F.when(F.col("last"), F.lead("text").over(order)).otherwise(F.col("text"))
    rows = rows.withColumn("next", follower)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third))
    )
    rows = rows.withColumn("own_words", words(F.col("text"))).withColumn("edited_words", words(F.col("edited")))
    rows = rows.select(
        *("id", "bucket", "sub", "guest", "last", "copies", "h", "text", "n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch("own_words", k).alias("sketch"),
        sketch("edited_words", k).alias("edited_sketch"),
    )
    following = F.when(F.col("last"), F.lead("sketch").over(order)).otherwise(F.col("sketch"))
    rows = rows.withColumn("next_sketch", following).where(~F.col("guest"))
    rows = rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return rows.drop("copy")


def written(sketch_col: str) -> Column:
    """A sketch as text."""
    return F.concat_ws(",", F.col(sketch_col).cast("array<string>"))
