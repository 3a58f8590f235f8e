"""Grouping of spelling variants by bands of letter-parity masks.

A word's mask has a bit for each letter, set where the letter occurs an odd
number of times.  One inserted or deleted code point flips one bit, one replaced
code point two, so of three bands of the mask at least one stays as it is: words
are joined on equal bands and lengths that differ by at most one, and verified.

Masks tell words of few common letters poorly apart: over the 181,000 words of
0.1 GB of text, equal bands alone give 1.4 * 10^9 pairs.  One edit also leaves
either the half before a word's middle or the half behind it as it is, and the
hash of that half is a further part of the join key.  A pair that meets in
several bands or halves is tried in the first only.

A word's form is its near word of largest count (ties: the smallest in
code-point order) if that is at least ``ratio`` times its own; forms of forms
lead to the root.  Counts grow at each step, so there is no cycle, and doubling
the steps gives all roots in a few rounds.

Null and empty texts have no words; repeated rows count each.  A null id is
written as nothing.  An empty table gives no rows.  Only id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def typos(every: int = 199):
    """A change of runs: one code point goes where ``every`` divides the crc32 of "<id>:<run>"."""

    def change(head: int, word: str) -> str:
        h = zlib.crc32(word.encode(), head)
        if h % every:
            return word
        i = h % len(word)
        return word[:i] + word[i + 1 :]

    return change


def vocabulary(docs: DataFrame, least: int = 5, shortest: int = 6, change=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of ``shortest`` code points and more that occur ``least`` times and more.

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, of which
    only A-Z is lowered; change(crc32 of "<id>:", run) may shorten a run.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % max(1, shortest))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                for name, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    own = Counter(runs.findall(text.encode().translate(_LOWER).decode()))
                    if change:
                        head = zlib.crc32(f"{'' if name is None else name}:".encode())
                        for word, n in own.items():
                            word = change(head, word)
                            if len(word) >= shortest:
                                held[word] += n
                    else:
                        held.update(own)
                    if len(held) >= HELD:
                        yield out()
        if held:
            yield out()

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    counts = read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least)


def bands(word: Column) -> list[Column]:
    """The three bands of a word's letter-parity mask; letters are dealt to them in turn."""
    code = lambda c: F.when(F.ascii(c) <= 122, F.ascii(c) - 97).otherwise(F.ascii(c) - 192 + 26)
    letters = F.transform(F.split(word, ""), code)
    flip = lambda band: lambda mask, c: F.when(c % 3 == band, mask.bitwiseXOR(F.pow(F.lit(2), F.floor(c / 3)).cast("int"))).otherwise(mask)
    return [F.aggregate(letters, F.lit(0), flip(b)) for b in range(3)]


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of words (word, n) that differ by exactly one inserted, deleted or replaced code point, once."""
    w = words.select("word", "n", F.char_length("word").alias("size"), *[b.alias(f"b{i}") for i, b in enumerate(bands(F.col("word")))])

    def halves(size: Column) -> Column:
        """Both halves of a word as they are for a partner of this many code points, which is not longer."""
        behind = F.col("word").substr(F.col("size") - (size - F.floor(size / 2)).cast("int") + 1, F.lit(1 << 30))
        return F.array(F.xxhash64(F.col("word").substr(F.lit(1), F.floor(size / 2).cast("int"))), F.xxhash64(behind))

    def rows(size: Column, longer: bool) -> DataFrame:
        keyed = w.withColumn("halves", halves(size)).withColumn("at", size).withColumn("longer", F.lit(longer))
        keyed = keyed.select("*", F.posexplode(F.array("b0", "b1", "b2")).alias("band", "mask"))
        return keyed.select("*", F.posexplode("halves").alias("side", "half"))

    x, same = rows(F.col("size"), False).alias("x"), rows(F.col("size"), False)
    y = same.unionByName(rows(F.col("size") - 1, True)).alias("y")
    of = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    equal = lambda c: of(c)[0] == of(c)[1]
    flips = sum(F.bit_count(of(f"b{i}")[0].bitwiseXOR(of(f"b{i}")[1])) for i in range(3))
    first = ~((F.col("x.band") > 0) & equal("b0")) & ~((F.col("x.band") > 1) & equal("b1")) & ~((F.col("x.side") > 0) & (F.col("x.halves")[0] == F.col("y.halves")[0]))
    key = equal("band") & equal("mask") & equal("side") & equal("half") & equal("at")
    met = x.join(y, key & (F.col("y.longer") | (F.col("x.word") < F.col("y.word"))) & (flips <= 2) & first)
    return met.where(F.levenshtein(*of("word"), 1) == 1).select(F.col("x.word").alias("a"), F.col("x.n").alias("na"), F.col("y.word").alias("b"), F.col("y.n").alias("nb"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the steps of (word, form) end, for every word that has a form."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(at)
        at = far.select("word", "root")
        at._written_to = far._written_to
        if far.where("moved").isEmpty():
            return at


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, form, root, n_near, form_n of every word of (word, n)."""
    words = written(words.select("word", "n"), "spelling-words")
    links = written(near_words(words), "spelling-links")
    both = links.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(links.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    near = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    taken = F.col("form_n") >= ratio * F.col("n")
    near = near.select("word", "n", F.when(taken, F.col("best.other")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("form_n")).alias("form_n"))
    near = written(near, "spelling-near")
    discard(links)
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
