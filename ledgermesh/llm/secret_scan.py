"""Secret scan: fixed patterns, and a randomness test battery for what no pattern names.

All of it is built-in column functions over one row at a time: no shuffle, no Python.

The battery looks at runs of 20 or more characters that an encoding could have
made: hex (0-9a-f or 0-9A-F), base32 (A-Z2-7 or a-z2-7), base36 (0-9A-Z or
0-9a-z) or base64 (letters, digits and the marks of either alphabet); the
narrowest that fits is inferred.  For a uniform
random string of n characters over an alphabet of A, with n_c of each,

* chi-squared uniformity: A / n * sum(n_c ** 2) - n has mean A - 1 and variance 2 (A - 1) (n - 1) / n;
* the runs above and below the middle of the alphabet number 1 + (n - 1) / 2 with variance (n - 1) / 4;
* the lag-one correlation of the places in the alphabet has mean 0 and variance 1 / (n - 1).

Their p-values join as the least times 3 (Bonferroni); a run below ``alpha`` is
not random.  Short words can look uniform by luck, so a run must also be unlike
prose.  That test's p-value is the probability of the run's characters as prose
(letter frequencies, some digits and marks) over that as a uniform string, at
most 1: under prose the inverse of that ratio has mean 1 or less, so by Markov's
inequality a ratio of p or less has probability p or less.  It falls with the
length of a random run by a factor of about 2 for each character or faster.  The
p-values pass Benjamini-Hochberg at level ``q`` over the candidates of a
document, so more or shorter candidates need more evidence each.  Runs without a
digit, and base64 runs without both cases, count as words whatever their evenness.

Null text counts as empty; a document without a find gives zeros, the hash of
the empty string and an empty list; a repeated row gives its line again.  Other
columns are not read.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of [0-9a-f]+ of 24 or more
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Matches that are numbered at a time.
CHUNK = 64

SPAN = "struct<start:int,kind:int,end:int,text:string>"


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, kind, end, text) of the matches; the gaps between them come from a split."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(f"array<{SPAN}>")
    pairs = F.arrays_zip(F.transform(gaps, lambda g: F.char_length(g)).alias("gap"), found.alias("m"))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start, n = acc["at"] + x["gap"], F.char_length(x["m"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + n).alias("end"), x["m"].alias("text"))
        return F.struct((start + n).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def chunk(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    # an array grows by a match at a time within a chunk only, so texts of very many matches don't cost their square
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda k: F.slice(pairs, k * CHUNK + 1, CHUNK))
    spans = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _upper_p(z: Column) -> Column:
    """Upper tail of the normal distribution for z of 0 or more (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


#: The alphabets in the order of their values (fixed values).
HEX_ALPHABET = "0123456789abcdef"
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE64_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Percent of the letters a to z in English text (fixed values).
LETTER_PERCENT = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)


def _prose(letter: str, cased: bool) -> float:
    """Probability of a character in names and prose: a tenth digits, a tenth marks where there are any, a capital in eight letters where there is case."""
    if letter.isdigit():
        return 0.01
    if not letter.isalpha():
        return 0.05
    share = LETTER_PERCENT[ord(letter.lower()) - ord("a")] / 100
    return share * (0.8 * (0.125 if letter.isupper() else 0.875) if cased else 0.9)


def evidence(alphabet: str) -> Column:
    """Bits by which each character of an alphabet speaks for a uniform string against prose."""
    cased = alphabet == BASE64_ALPHABET
    return F.array(*[F.lit(-log2(len(alphabet)) - log2(_prose(c, cased))) for c in alphabet])


def battery(spans: Column) -> Column:
    """(start, end, p_random, p_prose) of each candidate span; each step names what the next one uses."""

    def inferred(x: Column) -> Column:
        t = x["text"]
        hexed, base32, base36 = t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), t.rlike("^([A-Z2-7]+|[a-z2-7]+)$"), t.rlike("^([0-9A-Z]+|[0-9a-z]+)$")
        letters = F.when(hexed, HEX_ALPHABET).when(base32, BASE32_ALPHABET).when(base36, BASE36_ALPHABET).otherwise(BASE64_ALPHABET)
        folded = F.when(hexed, F.lower(t)).when(base32 | base36, F.upper(t)).otherwise(F.translate(t, "-_", "+/"))
        shaped = t.rlike("[0-9]") & (base32 | base36 | (t.rlike("[a-z]") & t.rlike("[A-Z]")))
        bits = F.when(hexed, evidence(HEX_ALPHABET)).when(base32, evidence(BASE32_ALPHABET)).when(base36, evidence(BASE36_ALPHABET)).otherwise(evidence(BASE64_ALPHABET))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), shaped.alias("shaped"), folded.alias("t"), letters.alias("letters"), bits.alias("bits"))

    def placed(x: Column) -> Column:
        at = F.transform(F.split(x["t"], ""), lambda c: F.call_function("position", c, x["letters"]).cast("double"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["shaped"].alias("shaped"), at.alias("v"), F.char_length(x["t"]).cast("double").alias("n"), F.char_length(x["letters"]).cast("double").alias("a"), x["bits"].alias("bits"))

    def summed(x: Column) -> Column:
        squares = F.aggregate(
            F.array_sort(x["v"]),
            F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum")),
            # the k-th of equal characters adds k ** 2 - (k - 1) ** 2
            lambda s, c: F.struct(c.alias("last"), F.when(s["last"] == c, s["k"] + 1).otherwise(1.0).alias("k"), (s["sum"] + 2 * F.when(s["last"] == c, s["k"] + 1).otherwise(1.0) - 1).alias("sum")),
            lambda s: s["sum"],
        )
        mid = (x["a"] + 1) / 2
        moves = F.aggregate(
            x["v"],
            F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("serial")),
            lambda s, c: F.struct(c.alias("last"), (s["runs"] + F.when((s["last"] < 0) | ((s["last"] > mid) != (c > mid)), 1.0).otherwise(0.0)).alias("runs"), (s["serial"] + F.when(s["last"] < 0, 0.0).otherwise((s["last"] - mid) * (c - mid))).alias("serial")),
        )
        bits = F.aggregate(x["v"], F.lit(0.0), lambda s, c: s + F.element_at(x["bits"], c.cast("int")))
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "shaped", "n", "a")], bits.alias("bits"), squares.alias("squares"), moves.alias("moves"))

    def scored(x: Column) -> Column:
        n, a = x["n"], x["a"]
        z_chi = (a / n * x["squares"] - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        z_runs = (x["moves"]["runs"] - 1 - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        z_serial = x["moves"]["serial"] / ((a * a - 1) / 12) / F.sqrt(n - 1)
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "shaped", "bits")], F.greatest(z_chi, F.lit(0.0)).alias("z_chi"), F.greatest(F.abs(z_runs), F.abs(z_serial)).alias("z_two"))

    def judged(x: Column) -> Column:
        p = F.least(F.lit(1.0), 3 * F.least(_upper_p(x["z_chi"]), 2 * _upper_p(x["z_two"])))
        prose = F.when(x["shaped"], F.least(F.lit(1.0), F.pow(F.lit(2.0), -x["bits"]))).otherwise(1.0)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), p.alias("p_random"), prose.alias("p_prose"))

    out = spans
    for step in (inferred, placed, summed, scored, judged):
        out = F.transform(out, step)
    return out


def scan_secrets(docs: DataFrame, alpha: float = 1e-3, q: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random; spans are kind:start:end in code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    d = d.select(
        "doc_id",
        F.filter(_spans(F.col("text"), ASSIGN, "assign"), lambda x: F.char_length(F.regexp_extract(x["text"], ASSIGN, 2)) >= 6).alias("assign"),
        F.filter(_spans(F.col("text"), ACCESS, "access"), lambda x: F.char_length(x["text"]) >= 20).alias("access"),
        _spans(F.col("text"), HEX, "hex").alias("hex"),
        battery(_spans(F.col("text"), CANDIDATE, "random")).alias("candidates"),
    )
    # Benjamini-Hochberg: the largest i whose i-th least p is at most q * i / m
    ordered = F.array_sort(F.transform("candidates", lambda x: x["p_prose"]))
    m = F.size("candidates")
    bar = F.array_max(F.filter(F.transform(ordered, lambda p, i: F.when(p <= q * (i + 1) / m, p)), lambda p: p.isNotNull()))
    d = d.withColumn("base", F.concat("assign", "access", "hex")).withColumn("bar", bar)
    fresh = F.filter("candidates", lambda x: (x["p_prose"] <= F.col("bar")) & (x["p_random"] >= alpha) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    d = d.withColumn("random", F.transform(fresh, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"))))
    bare = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", *sizes[:3], F.sha2(joined(bare), 256).alias("base_sha256"), joined(F.concat(bare, F.col("random"))).alias("spans"), sizes[3])
