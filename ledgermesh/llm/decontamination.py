"""Benchmark decontamination by a generalised suffix automaton of test items.

A window is ``window`` consecutive words of an item; an item of fewer words, but
not none, is one window.  The automaton of all items has a state for each class
of word strings that end at the same places.  A text is streamed through it: at
each word it holds the longest string that ends there and occurs in an item.
Where that is as long as a window, the last ``window`` words are hit, and the
state of that window names the items; short items are found on the way of suffix
links from the state.  Runs of hit words are removed from a text; where hit words
make up more than ``coverage`` of its words, nothing of it is kept.

Items are dealt to blocks of at most ``block_words`` words, cut where longer (the
pieces of an item overlap by a window less a word), and a task builds each
block's automaton, so a broadcast is bounded by the block.  With one block the
texts are read once, without a shuffle; with several each block reads them and
writes what it found, and a last pass joins that.

Null and empty texts have no words.  Rows that repeat are documents of their own;
items that repeat an id are one item, and a null item id counts as the empty
string.  An empty table on either side gives no rows or no hits.  Only the ids
and texts are read.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .mixing import running

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: A-Z lowered; bytes that belong to no word become spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Splits a text into its words in SQL; A-Z is in no word there, so lower it first.
WORDS_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


class Automaton:
    """Suffix automaton of several word sequences, with the windows and short items at its states."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        """pieces: (item, words)."""
        self.window = window
        self.number: dict[bytes, int] = {}
        self.size, self.link, self.step = [0], [-1], [{}]
        items = [(item, [self.number.setdefault(w, len(self.number)) for w in words]) for item, words in pieces]
        for _, ids in items:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        # the state of the last ``window`` words of what a state stands for
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        self.last_window = list(range(len(self.size)))
        for s in order:
            if self.size[self.link[s]] >= window:
                self.last_window[s] = self.last_window[self.link[s]]
        found, whole = defaultdict(set), defaultdict(set)
        for item, ids in items:
            state = 0
            for i, c in enumerate(ids):
                state = self.step[state][c]
                if i + 1 >= window:
                    found[self.last_window[state]].add(item)
            if len(ids) < window:
                whole[state].add((len(ids), item))
        self.found = {s: tuple(sorted(x)) for s, x in found.items()}
        # short items at a state or at one that its suffix links lead to
        self.short: dict[int, tuple] = {}
        for s in order:
            here = (*sorted(whole.get(s, ())), *self.short.get(self.link[s], ()))
            if here:
                self.short[s] = here
        self.least = min([window, *(n for x in whole.values() for n, _ in x)])

    def _new(self, size: int, link: int, step: dict) -> int:
        self.size.append(size)
        self.link.append(link)
        self.step.append(step)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the strings of q that are at most one longer than p's: q itself or a new one."""
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._new(self.size[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:
            return self._split(last, c, q)
        made, p = self._new(self.size[last] + 1, 0, {}), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, c, self.step[p][c])
        return made

    def scan(self, words: list[bytes], spans: list[list[int]], items: set[str]) -> None:
        """Add the spans of words that are hit, by their ends, and the items."""
        step, link, size, last_window, found, short = self.step, self.link, self.size, self.last_window, self.found, self.short
        window, least, state, length = self.window, self.least, 0, 0
        for i, c in enumerate(map(self.number.get, words)):
            if c is None:
                state = length = 0
                continue
            to = step[state].get(c)
            if to is None:
                while to is None and state > 0:
                    state = link[state]
                    to = step[state].get(c)
                if to is None:
                    state = length = 0
                    continue
                length = size[state]
            state, length = to, length + 1
            if length < least:
                continue
            hit = 0
            if length >= window:
                hit = window
                items.update(found[last_window[state]])
            if state in short:
                for n, item in short[state]:
                    if n <= length:
                        hit = max(hit, n)
                        items.add(item)
            if hit:
                if spans and spans[-1][1] >= i + 1 - hit:
                    while len(spans) > 1 and spans[-2][1] >= i + 1 - hit:
                        spans.pop()
                    spans[-1][0], spans[-1][1] = min(spans[-1][0], i + 1 - hit), i + 1
                else:
                    spans.append([i + 1 - hit, i + 1])


def automata(items: DataFrame, window: int, block_words: int, id_col: str, text_col: str) -> DataFrame:
    """(block, image): the automata of the blocks of items, built in tasks."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    it = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lower, F.lit(f"({WORDS_SQL})"), F.lit(1)).alias("words")).where(F.size("words") > 0)
    # pieces of a long item share a window less a word, so each window lies in one of them; shorter items stay whole
    step = max(1, block_words - window + 1)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("words") - window) / step).cast("int")))
    it = it.select("item", F.explode(starts).alias("piece"), "words")
    it = it.select("item", "piece", F.slice("words", F.col("piece") * step + 1, F.lit(step + window - 1)).alias("words"))
    dealt = running(it, [F.col("item"), F.col("piece"), F.col("words")], upto=F.size("words").cast("long"))
    dealt = dealt.select(F.floor((F.col("upto") - 1) / block_words).alias("block"), "item", "words")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        rows = zip(table.column("item").to_pylist(), table.column("words").to_pylist(), strict=True)
        made = Automaton(sorted((item, [w.encode() for w in words]) for item, words in rows), window)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "image": pa.array([pickle.dumps(vars(made), protocol=5)], pa.binary())})

    return dealt.groupBy("block").applyInArrow(build, "block long, image binary")


SPANS = "array<struct<start:int,end:int>>"
FOUND = f"k1 long, k2 long, spans {SPANS}, items array<string>"
CLEANED = f"doc_id long, n_words long, n_hit long, spans {SPANS}, items array<string>, kept string"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _load(image: bytes) -> Automaton:
    made = Automaton.__new__(Automaton)
    made.__dict__.update(pickle.loads(image))
    return made


def _spans(runs: list[list[int]]) -> list[dict]:
    return [{"start": s, "end": e} for s, e in runs]


def _finished(rows: list[tuple], coverage: float) -> pa.RecordBatch:
    """CLEANED rows from (name, text, words, runs, items)."""
    out = []
    for name, text, words, runs, items in rows:
        n_hit = sum(e - s for s, e in runs)
        kept = text if not runs else cleaned(text, runs) if n_hit <= coverage * len(words) else None
        out.append((name, len(words), n_hit, _spans(runs), sorted(items), kept))
    types = (pa.int64(), pa.int64(), pa.int64(), _SPANS, pa.list_(pa.string()), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "n_words", "n_hit", "spans", "items", "kept"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, coverage: float = 0.5, block_words: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, spans (start and end of each maximal run of hit words), items (ids, sorted) and kept (the text without the runs; null beyond ``coverage``) of every row."""
    made = written(automata(items, window, block_words, item_col, item_text_col), "decontamination")
    # one block at a time is on the driver
    shared = [docs.sparkSession.sparkContext.broadcast(bytes(r["image"])) for r in made.orderBy("block").toLocalIterator()]
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def scanned(batches: Iterator[pa.RecordBatch], automaton: Automaton | None):
        """Slices of batches, each with (words, spans, items) of its texts, which are the last column."""
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some, found = batch.slice(i, 256), []
                for text in some.column(some.num_columns - 1).to_pylist():
                    words, spans, its = words_of(text), [], set()
                    if automaton:
                        automaton.scan(words, spans, its)
                    found.append((words, spans, its))
                yield some, found

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, found in scanned(batches, _load(shared[0].value) if shared else None):
            yield _finished([(name, text, *f) for name, text, f in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), found, strict=True)], coverage)

    if len(shared) <= 1:
        return named.mapInArrow(once, CLEANED)

    keyed = named.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"), "text")
    parts = [written(keyed.select("k1", "k2", "text").mapInArrow(_finder(b, scanned), FOUND), "decontamination-found") for b in shared]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    # rows that repeat found the same
    both = both.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("found"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256).to_pylist()
                yield _finished([(r["doc_id"], r["text"], words_of(r["text"]), merged([[x["start"], x["end"]] for x in r["found"] or ()]), r["items"] or ()) for r in rows], coverage)

    return keyed.join(both, ["k1", "k2"], "left").select("doc_id", "text", "found", "items").mapInArrow(last, CLEANED)


def _finder(shared, scanned):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, found in scanned(batches, _load(shared.value)):
            at = [i for i, (_, spans, _) in enumerate(found) if spans]
            cols = [some.column(k).take(pa.array(at, pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([_spans(found[i][1]) for i in at], _SPANS), pa.array([sorted(found[i][2]) for i in at], pa.list_(pa.string()))], ["k1", "k2", "spans", "items"])

    return find


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Maximal runs of spans in any order."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def cleaned(text: str, runs: list[list[int]]) -> str:
    """The text without the words of the runs and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_PLAIN))]
    parts, upto = [], 0
    for s, e in runs:
        parts.append(raw[upto : at[s][0]])
        upto = at[e - 1][1]
    return b"".join([*parts, raw[upto:]]).decode()
