"""SpotSigs fingerprints and near-duplicate join, in DataFrame functions only.

A text's words are runs of letters and digits, lower-cased.  Common words are anchors.  After each anchor (and at the start of the text) the next
``CHAIN`` content words, later anchors skipped, form a signature; near the end chains are shorter.  A word with ``CHAIN`` words and no anchor before it starts
one too, so every word of every text, in whatever language, is in a signature.  The set of 32-bit signature hashes is
the fingerprint.  A text with characters but no content word has one signature, of the whole text.

The join compares sets only inside and between partitions of set length that can reach the threshold: sizes a <= b
with a / b >= t.  Inside, a pair must share one of the first floor((1 - t) n) + 1 signatures in hash order, and only then is
the Jaccard similarity computed.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.common import materialise

CHAIN, THRESHOLD, WORD_BREAK, MARK = 3, 0.8, r"[^\p{L}\p{N}]+", "\u0001"
#: Common words of four languages.
ANCHORS = (
    "a an and are as at be by for from had has he in is it not of on or that the this to was were which with "
    "der die das den dem des ein eine einer und ist in im zu von mit für auf sich nicht als auch es an "
    "le la les un une des du de et est en dans que qui pour par sur pas au aux avec il ce "
    "el los las una del y es que por con para se su al lo no como más"
).split()
ANCHORS = sorted(set(ANCHORS))
#: Buckets of ``in_next_order``: so many rows in one, at most so many.
ROWS_PER_BUCKET, MOST_BUCKETS = 250, 1 << 16


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def add_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN, anchors: list[str] = ANCHORS) -> DataFrame:
    """Adds ``out``: the sorted set of signature hashes (array of int) of the string column ``text``; empty for an empty text.

    The words and content words are columns of their own on the way, so that no expression is repeated for each
    element of an array.
    """
    words, anchor, content = f"{out}__w", f"{out}__a", f"{out}__c"
    df = df.withColumn(words, _words(F.col(text)))
    df = df.withColumn(anchor, F.transform(F.col(words), lambda w: w.isin(anchors)))

    def mark(w: Column, i: Column) -> Column:
        before = [F.get(F.col(anchor), i - k) for k in range(1, chain + 1)]
        uncovered = (i >= chain) & ~functools.reduce(Column.__or__, before)
        return F.when(~F.get(F.col(anchor), i), F.when((i == 0) | before[0] | uncovered, F.concat(F.lit(MARK), w)).otherwise(w))

    df = df.withColumn(content, F.filter(F.transform(F.col(words), mark), lambda w: w.isNotNull()))

    def signature(w: Column, i: Column) -> Column:
        rest = [F.get(F.col(content), i + k) for k in range(1, chain)]
        return F.when(w.startswith(MARK), F.hash(F.replace(F.concat_ws(" ", w, *rest), F.lit(MARK), F.lit(""))))

    found = F.filter(F.transform(F.col(content), signature), lambda s: s.isNotNull())
    bare = F.when(F.col(text) == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(F.col(text))))
    # a text that starts with anchors has its first content word marked; content without a mark cannot occur
    df = df.withColumn(out, F.when(F.size(content) == 0, bare).otherwise(F.array_sort(F.array_distinct(found))))
    return df.drop(words, anchor, content)


def length_band(n: Column, threshold: float) -> Column:
    """The partition of set length: lengths that can reach ``threshold`` lie in one or in two neighbours.  Empty sets are below all others."""
    return F.when(n == 0, F.lit(-2)).otherwise(F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold))).cast("int"))


def as_string(signatures: Column) -> Column:
    """Eight hexadecimal digits for each signature, in order."""
    return F.array_join(F.transform(signatures, lambda s: F.right(F.concat(F.lit("0000000"), F.lower(F.hex(s))), F.lit(8))), "")


def jaccard(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike (1).

    Pruned by length: sets whose sizes alone keep them below ``threshold`` are not compared and give 0.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(large == 0, F.lit(1.0)).when(small < threshold * large, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _constants(values: list, kind: str) -> Column:
    """A constant array from one literal: its length costs no expression, and it is computed once, not for each row."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(kind) if values else F.array().cast(kind)


def _bucket(cuts: list) -> Column:
    """How many of the rising ``cuts`` are below ``place``: a binary search, one step a bit of their number."""
    ends = _constants(cuts, "array<decimal(20,0)>")
    steps = _constants([1 << k for k in reversed(range(len(cuts).bit_length()))], "array<int>")
    place = F.col("place")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ends, at + step - 1) < place, at + step).otherwise(at))


def in_next_order(docs: DataFrame, id_col: str, text_col: str, per_bucket: int = ROWS_PER_BUCKET, most: int = MOST_BUCKETS) -> DataFrame:
    """doc_id, text, bucket, place and halo: documents dealt to ranges of doc_id, cut at approximate quantiles.

    A bucket has ``per_bucket`` rows on average, or more where that would give more than ``most`` buckets.  The largest document of each bucket also goes,
    as halo, to the bucket above, whose smallest document it follows in descending order; the largest of all goes to the lowest bucket.  So every
    document and its next one are in one bucket, each text moves once, and nothing is sorted globally: only the cuts, at most ``most``
    numbers, reach the driver, and only the buckets' tops are put in order.  Rows that repeat a doc_id are in one bucket.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low, n = source.agg(F.min("doc_id"), F.count("*")).first()
    low = 0 if low is None else low - 1  # the place of a null doc_id is below all others
    placed = source.withColumn("place", F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(low).cast("decimal(20,0)")))
    buckets = min(most, -(-n // per_bucket))
    cuts = []
    if buckets > 1:
        shares = F.split(F.lit(",".join(str(k / buckets) for k in range(1, buckets))), ",").cast("array<double>")
        cuts = sorted(set(placed.agg(F.percentile_approx("place", shares, max(10_000, 4 * buckets))).first()[0]))
    placed = placed.withColumn("bucket", _bucket(cuts))
    tops = materialise(placed.groupBy("bucket").agg(F.max("place").alias("place")), "spot-tops")  # a row for each bucket
    in_order = Window.orderBy("bucket")
    halo = tops.select("place", F.coalesce(F.lead("bucket").over(in_order), F.first("bucket").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    extra = placed.join(materialise(halo, "spot-halo"), "place").select("doc_id", "text", "place", F.col("to").alias("bucket"), F.lit(True).alias("halo"))
    return placed.select("doc_id", "text", "place", "bucket", F.lit(False).alias("halo")).unionByName(extra)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, signatures, fingerprint of every row.  Null texts are empty; an empty table gives an empty result."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return add_signatures(source, "text", "signatures").select("doc_id", "signatures", as_string(F.col("signatures")).alias("fingerprint"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edited form and against the next document, in descending doc_id (after the last: the first).

    The edited text has its last third (floor of its code points) replaced by the first as many code points of the next
    document.  Returns doc_id, n_chars, edited_text, signatures, edited_signatures, next_signatures, near_edited, near_next, and whether
    each is a near copy at THRESHOLD (set lengths in one partition or two neighbours, then the similarity).  A null text is
    empty; a null doc_id is the smallest; rows with one doc_id are ordered by text; a single document is its own next; an empty table gives an empty result.
    """
    rows = in_next_order(docs, id_col, text_col).repartition("bucket")
    rows = add_signatures(rows, "text", "signatures")
    order = Window.partitionBy("bucket").orderBy("halo", F.desc("place"), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_signatures", F.lead("signatures").over(order)).filter(~F.col("halo"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", "edited_text", "signatures", "next_signatures")
    rows = add_signatures(rows, "edited_text", "edited_signatures")
    for name in ("edited", "next"):
        other = F.col(f"{name}_signatures")
        rows = rows.withColumn(f"near_{name}", jaccard(F.col("signatures"), other))
        close = F.abs(length_band(F.size("signatures"), THRESHOLD) - length_band(F.size(other), THRESHOLD)) <= 1
        rows = rows.withColumn(f"copy_{name}", close & (F.col(f"near_{name}") >= THRESHOLD))
    return rows


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity) of classes at ``threshold`` or more, and (doc_id, class_id).

    A class is all rows with one fingerprint; its id is a hash-free number given when the classes are written.  Each class's signatures are ordered
    by how many classes hold them, rarest first, so a signature that many texts share leads only where a text has nothing
    rarer.  Set lengths are partitioned geometrically by the threshold: lengths that can reach it lie in one
    partition or in two neighbours.  Null texts are empty, and empty sets have no pairs; repeated rows share a class; an empty table gives two empty results.
    """
    rows = materialise(fingerprints(docs, id_col, text_col), "spot-rows")
    classes = materialise(rows.groupBy("fingerprint").agg(F.first("signatures").alias("signatures")).withColumn("class_id", F.monotonically_increasing_id()), "spot-classes")
    members = rows.select("doc_id", "fingerprint").join(classes.select("fingerprint", "class_id"), "fingerprint").select("doc_id", "class_id")
    each = classes.select("class_id", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    held = materialise(each.groupBy("s").agg(F.count("*").alias("df")), "spot-df")
    ranked = each.join(held, "s").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("by_df"))
    need = F.ceil(F.col("n") * F.lit(threshold)).cast("int")
    prefix = ranked.select("class_id", "n", F.posexplode(F.transform(F.slice("by_df", F.lit(1), F.col("n") - need + 1), lambda x: x["s"])).alias("at", "s"))
    prefix = materialise(prefix.withColumn("band", length_band(F.col("n"), threshold)).filter("n > 0"), "spot-prefix")
    left = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), "s", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    right = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), "s", "band")
    least = F.ceil((F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    possible = (
        (F.col("left.s") == F.col("right.s")) & (F.col("left.band") == F.col("right.band"))
        & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & (F.col("na") >= F.lit(threshold) * F.col("nb"))
        & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= least)
    )
    candidates = left.alias("left").join(right.alias("right"), possible).select("a", "b").distinct()
    sets = classes.select("class_id", "signatures")
    pairs = candidates.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", jaccard(F.col("sa"), F.col("sb"), threshold).alias("similarity"))
    return pairs.filter(F.col("similarity") >= threshold - 1e-12), members
