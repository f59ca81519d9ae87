"""Spelling variants: words one edit apart, each led to a much commoner near form.

A pair of words one edit apart has a half that the edit leaves intact.  With ``m`` code
points in the shorter word, and the edit somewhere in the gap ``lo..hi`` of its positions,
either both words agree before the middle of the gap or both agree from the middle on.  The
forward dictionary lists every word by the part before the gap, the reversed one by the
part behind it; each word stands in both, once as the shorter (or equal) and once as the
longer word of a pair.  Entries with the same intact part are a block; sorted by it, blocks
are scanned by a sort-merge join and every pair in them is verified.

A block of more than ``most`` entries is subdivided: the gap is halved again, so its words
go to blocks with a longer intact part, until the gap is a single position.  A block of a
single position holds the words that differ just there, which are near by definition, so
its size is bounded by the alphabet.  Nothing is capped or dropped: every subdivision keeps
every near pair in at least one child.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsquall.llm.common import kept

#: Maximal runs of ASCII letters and of the letters (and two signs) from U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries of a block up to which it is scanned instead of subdivided.
BLOCK = 48


def thinned_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """``word, n``: the lower-cased runs of letters of all texts, some with a letter lost, and how often each occurs.

    Where the crc32 of ``<id>:<run>`` divides by ``every``, the run loses the code point that
    crc32 modulo its length points at.  Runs are counted by partial sums before the shuffle.
    A null text has no runs; a null id counts as the empty string.
    """
    low = F.translate(F.col(text_col), UPPER, LOWER)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(ident.alias("i"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run")).filter(F.length("run") >= least_length)
    h = F.crc32(F.concat("i", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, less).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _key() -> Column:
    """The hash of an entry's intact part, with the lengths and the gap that it belongs to."""
    before = F.substring("word", F.lit(1), F.col("lo"))
    behind = F.substring("word", F.col("hi") + F.col("long") + 1, F.length("word"))
    return F.xxhash64("m", "lo", "hi", "last", before, behind)


def _entries(words: DataFrame) -> DataFrame:
    """The entries of both dictionaries: gaps of half a word."""
    roles = words.select("word", F.explode(F.array(F.lit(0), F.lit(1))).alias("long"))
    whole = roles.select("word", "long", (F.length("word") - F.col("long")).alias("m"), F.lit(0).alias("lo"), (F.length("word") - F.col("long")).alias("hi"), F.lit(False).alias("last"))
    return _halved(whole)


def _halved(entries: DataFrame) -> DataFrame:
    """The children of entries: both halves of the gap, or what a gap of one position can hold.

    Such a gap hides a code point replaced there (between words of one length), or one
    inserted before or after it.
    """
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    gap = lambda lo, hi, last: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(last).alias("last"))
    lo, hi = F.col("lo"), F.col("hi")
    halves = F.array(gap(lo, mid, False), gap(mid, hi, False))
    inserted = F.array(gap(lo, lo, True), gap(hi, hi, True))
    replaced = F.array(gap(lo, lo, True), gap(hi, hi, True), gap(lo, hi, True))
    children = F.when(hi - lo > 1, halves).when(F.col("long") == 1, inserted).otherwise(replaced)
    return entries.select("word", "long", "m", F.explode(children).alias("g")).select("word", "long", "m", "g.*").withColumn("key", _key())


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """``a, b`` with a < b for all pairs of the distinct, non-null ``word``s that one inserted, deleted or replaced code point parts."""
    entries = kept(_entries(words), "entries")
    blocks: list[DataFrame] = []
    while True:
        size = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("long") == 0).alias("short"))
        sized = kept(entries.join(size.filter("size > 1 AND short > 0").drop("short"), "key"), "blocks")
        blocks.append(sized.filter((F.col("size") <= most) | F.col("last")).select("key", "word", "long"))
        crowded = sized.filter((F.col("size") > most) & ~F.col("last")).drop("key", "size")
        if crowded.isEmpty():
            break
        entries = kept(_halved(crowded), "entries")
    pairs = []
    for block in blocks:
        a = block.filter("long = 0").select("key", F.col("word").alias("x"))
        b = block.select("key", F.col("word").alias("y"), "long")
        near = a.join(b, "key").filter(((F.col("long") == 1) | (F.col("x") < F.col("y"))) & (F.levenshtein("x", "y", 1) == 1))
        pairs.append(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    found = pairs[0]
    for p in pairs[1:]:
        found = found.unionByName(p)
    return found.distinct()


def spelling_variants(words: DataFrame, ratio: int = 2, most: int = BLOCK) -> DataFrame:
    """For every row of ``word, n``: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word with the largest n (the least in code-point order on ties), if
    that is at least ``ratio`` times the word's own; else null, as is ``form_n``.  ``root`` is
    where following forms ends, the word itself without a form; n grows on the way, so there
    are no circles.  ``word`` is distinct and not null.  An empty table gives no rows.
    """
    words = kept(words.select("word", "n"), "words")
    pairs = near_words(words, most)
    both = kept(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near")
    other = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = other.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct("b", "m"), F.struct(-F.col("m"), F.col("b"))).alias("top"))
    strong = F.col("top.m") >= ratio * F.col("n")
    rated = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("top.b")).alias("form"), F.when(strong, F.col("top.m")).alias("form_n"))
    rated = kept(rated, "rated")
    up = rated.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each turn doubles the way that has been followed
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = kept(up.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return rated.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
