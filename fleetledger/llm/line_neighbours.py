"""Line dedup by deletion neighbourhoods; DataFrame functions only.

A line is what stands between two ``\\n``, without spaces at its ends; its words are what stands between single
spaces.  A line of at least ``EXACT_WORDS`` words is removed if an earlier line (by document id, then place) is equal, or, from
``NEAR_WORDS`` words on, if an earlier different line is within one edit of a word (one put in, left out or
changed).  The earliest always stays, so does everything shorter.  "Earlier" is meant among all lines, removed ones too.

1. Distinct lines with their first place: one shuffle of hashes and places, combined before it.
2. One edit leaves the first or the last ``ANCHOR`` words of a line of ``NEAR_WORDS`` words as they are, so
   only lines that share these with another distinct line can have a neighbour; only they go on.
3. Their deletion variants, the line without its i-th word, are emitted as hashed keys.  Two lines of n words and of equal
   keys (variant, i, n) differ in the i-th word; a variant that has the words of a whole line has a word more.  Each line of a key is paired
   with the earliest one only (two lines come out of the aggregation itself, more are joined back to it), so no pairs
   within a key are made.
4. The texts of the pairs found are compared word by word before anything is removed.
5. Removed places go back to their documents in one join.

Defined cases: a null text has no lines and stays null; empty lines and texts stay; rows of one id are one document: equal
lines at the same place of theirs are the same line; null ids come last; a document that loses lines keeps the
others in order; an empty table gives no rows; all columns of ``docs`` are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.names import free_name
from fleetledger.session import settle

#: Fewest words of a line that is removed as a copy, and as a near copy; words at each end of which one end survives an edit.
EXACT_WORDS, NEAR_WORDS, ANCHOR = 5, 10, 5
#: Rows of candidates (places and hashes, under 100 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _bounded(df: DataFrame) -> DataFrame:
    """``df``, stored before, with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _place(identity: Column, number: Column) -> Column:
    """Document id and line number as one number in order; null ids are last."""
    return F.coalesce(identity.cast("decimal(20,0)"), F.lit("99999999999999999999").cast("decimal(20,0)")) * F.lit(1 << 32).cast("decimal(10,0)") + number


def _has(line: Column, words: int) -> Column:
    """Whether a line has at least so many words."""
    return F.substring_index(line, " ", words - 1) != line


def _mark(number: Column, line: Column) -> Column:
    """What a removed line is known by within its document."""
    return F.xxhash64(number, F.xxhash64(line))


def _lines(docs: DataFrame) -> DataFrame:
    """place, _id, number and line of every line (trimmed) that may be removed."""
    each = docs.select("_id", F.posexplode(F.split("_text", "\n", -1)).alias("number", "line")).withColumn("line", F.trim("line"))
    return each.where(_has(F.col("line"), EXACT_WORDS)).withColumn("place", _place(F.col("_id"), F.col("number")))


def _end(line: Column, first: bool) -> Column:
    return F.xxhash64(F.lit(first), F.substring_index(line, " ", ANCHOR if first else -ANCHOR))


def removed_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """_id and mark of every line that an earlier equal or neighbouring line makes superfluous."""
    own = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    lines = _lines(own)
    ends = [F.when(_has(F.col("line"), NEAR_WORDS), _end(F.col("line"), first)) for first in (True, False)]
    keyed = lines.select("place", F.xxhash64("line").alias("h"), F.octet_length("line").alias("c"), ends[0].alias("e0"), ends[1].alias("e1"))
    distinct = settle(keyed.groupBy("h", "c").agg(F.min("place").alias("place"), F.min("e0").alias("e0"), F.min("e1").alias("e1")))

    by_end = distinct.where("e0 is not null").select("h", "c", F.explode(F.array("e0", "e1")).alias("end"))
    shared = by_end.groupBy("end").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("end")
    with_end = distinct.where("e0 is not null").select("place", F.explode(F.array("e0", "e1")).alias("end")).join(shared, "end", "left_semi")
    candidates = settle(with_end.select("place").distinct())

    # Words are needed only of candidates, and only once: at their first place.
    texts = settle(lines.where(_has(F.col("line"), NEAR_WORDS)).select("place", "line").join(_bounded(candidates), "place", "left_semi"))
    words = F.split("line", " ")
    hashed = texts.select(
        "place", F.transform(words, lambda w, i: F.xxhash64(w, i)).alias("placed"), F.transform(words, lambda w: F.xxhash64(w)).alias("bag"), F.size(words).alias("n")
    )
    both = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    summed = hashed.select("place", "n", both("placed").alias("all_placed"), both("bag").alias("all_bag"), F.arrays_zip("placed", "bag").alias("each"))
    variants = summed.select("place", "n", "all_placed", "all_bag", F.posexplode("each").alias("i", "word"))

    # Leaving out a word takes its hash out of the sum; what is left is that of the variant.
    changed = variants.select(F.xxhash64(F.col("all_placed").bitwiseXOR(F.col("word.placed")), "i", "n").alias("key"), "place")
    of_key = changed.groupBy("key").agg(F.min("place").alias("other"), F.max("place").alias("place"), F.count(F.lit(1)).alias("rows"))
    of_key = settle(of_key.where("rows > 1"))
    crowded = _bounded(settle(of_key.where("rows > 2").select("key", "other")))
    twos = of_key.select("place", "other")
    more = changed.join(crowded, "key").select("place", "other")
    # A longer line's variant has the words of a whole line, in whatever order; the check below tells.
    whole = _bounded(settle(summed.select(F.xxhash64("all_bag", "n").alias("key"), F.col("place").alias("other"))))
    longer = variants.select(F.xxhash64(F.col("all_bag").bitwiseXOR(F.col("word.bag")), F.col("n") - 1).alias("key"), "place").join(whole, "key")
    longer = longer.select(F.greatest("place", "other").alias("place"), F.least("place", "other").alias("other"))
    pairs = settle(twos.unionAll(more).unionAll(longer).where("other < place").distinct())

    left, right = texts.withColumnRenamed("line", "a"), texts.select(F.col("place").alias("other"), F.col("line").alias("b"))
    near = pairs.join(left, "place").join(right, "other").where(one_edit(F.split("a", " "), F.split("b", " "))).select("place").distinct()

    copies = lines.select("_id", "place", _mark(F.col("number"), F.col("line")).alias("mark"), F.xxhash64("line").alias("h"), F.octet_length("line").alias("c"))
    first = distinct.select("h", "c", F.col("place").alias("first")).join(near.select(F.col("place").alias("first"), F.lit(True).alias("near")), "first", "left")
    return copies.join(first, ["h", "c"]).where("place <> first or near").select("_id", "mark")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by exactly one word put in, left out or changed."""
    same_size = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x) == 1
    longer, shorter = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)
    # Words that agree from the front, and from the back, reach over all of the shorter.
    differ = F.zip_with(F.slice(longer, 1, F.size(shorter)), shorter, lambda x, y: x != y)
    at = F.coalesce(F.nullif(F.array_position(differ, True), F.lit(0)), F.size(longer).cast("long")).cast("int")
    rest = F.slice(longer, at + 1, F.size(longer)) == F.slice(shorter, at, F.size(longer))
    return F.when(F.size(a) == F.size(b), same_size).when(F.abs(F.size(a) - F.size(b)) == 1, rest).otherwise(False)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", into: str = "_dedup") -> DataFrame:
    """``docs`` without superfluous lines, and a struct ``into`` of n_lines, n_removed and emptied (a column of that name is replaced).

    emptied: lines were removed, and no line of EXACT_WORDS words is left.
    """
    rid, marks, kept = (free_name(docs, x) for x in ("_rid", "_marks", "_kept"))
    removed = removed_lines(docs, id_column, text).groupBy(F.col("_id").alias(rid)).agg(F.collect_list("mark").alias(marks))
    joined = docs.join(removed, F.col(f"`{id_column}`").eqNullSafe(F.col(rid)), "left")
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    rest = F.filter(lines, lambda line, number: ~F.array_contains(marks, _mark(number, F.trim(line))))
    done = joined.withColumn(kept, F.when(F.col(marks).isNull(), lines).otherwise(rest))
    own = F.exists(kept, lambda line: _has(F.trim(line), EXACT_WORDS))
    n_lines, n_kept = (F.greatest(F.size(x), F.lit(0)).cast("long") for x in (lines, F.col(kept)))
    emptied = F.coalesce((n_lines > n_kept) & ~own, F.lit(False))
    told = F.struct(n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_removed"), emptied.alias("emptied")).alias(into)
    columns = [F.array_join(kept, "\n").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != into]
    return done.select(*columns, told)


def with_own_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", into: str = "_dedup") -> DataFrame:
    """``dedup_lines`` without the rows that lost lines and keep only blank lines, or lines of any length that an earlier document has too."""
    key, of_key = free_name(docs, "_key"), free_name(docs, "_own_key")
    done = dedup_lines(docs, id_column, text, into)
    done = done.withColumn(key, F.when(F.col(into)["emptied"], F.xxhash64(F.col(f"`{id_column}`"), F.xxhash64(F.col(f"`{text}`")), F.octet_length(F.col(f"`{text}`")))))

    def cut(rows: DataFrame, *more: str) -> DataFrame:
        """place of the document, h and c of every line that is not blank."""
        each = rows.select(*more, _place(F.col("_id"), F.lit(0)).alias("place"), F.explode(F.split("_text", "\n", -1)).alias("line")).withColumn("line", F.trim("line"))
        return each.where(F.col("line") != "").select(*more, "place", F.xxhash64("line").alias("h"), F.octet_length("line").alias("c"), (~_has(F.col("line"), EXACT_WORDS)).alias("short"))

    own = [F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text}`").alias("_text")]
    # Emptied rows keep short lines only.
    left = settle(cut(done.where(F.col(key).isNotNull()).select(*own, F.col(key).alias("key")), "key").select("key", "place", "h", "c").distinct())
    sought = _bounded(settle(left.select("h", "c").distinct()))
    firsts = cut(docs.select(*own)).where("short").join(sought, ["h", "c"], "left_semi").groupBy("h", "c").agg(F.min("place").alias("place"))
    stays = settle(left.join(firsts, ["h", "c", "place"], "left_semi").select(F.col("key").alias(of_key)).distinct())
    joined = done.join(_bounded(stays), F.col(key) == F.col(of_key), "left")
    return joined.where(F.col(key).isNull() | F.col(of_key).isNotNull()).drop(key, of_key)
