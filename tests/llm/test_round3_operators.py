"""Prefix trie, spelling variants and decontamination against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgermesh.llm import decontamination, prefix_trie, spelling
from ledgermesh.llm.decontamination import decontaminate
from ledgermesh.llm.queries import QUERIES
from tests.conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- op11


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, x in sorted(built.items()):
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, m in members.items():
        own_saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own_saved
            leaves[k[:d]] += not children[k]
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(",".join(str(c) for c in m if len(built[c]) == len(k)))) for k, m in members.items())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_of(spark, rows, schema="conv_id long, turn long, role string, text string"):
    df = spark.createDataFrame(rows, schema)
    turns = prefix_trie.turns_of(df)
    trie = prefix_trie.prefix_trie(prefix_trie.shared_starts(turns, 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4), turns)
    out = trie.nodes.join(prefix_trie.joined_sha256(trie.ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(sha(""))))
    return sorted(tuple(r) for r in out.select(*NODE).collect())


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op11_prefix_trie"](spark, SF).select(*NODE).collect())
    assert got == brute_trie(rows)


def test_trie_of_random_conversations_with_nulls_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    r = random.Random(5)
    rows = []
    for c in [*range(0, 75), 100, 105, 119, None]:
        for _ in range(r.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, r.choice([None, 0, 1, 2, 3, 4, 5]), r.choice(["user", None, ""]), r.choice(["a", "a b", "", None, "  x y\tz "])))
    rows += rows[:20]
    rows += [(c, t, "user", "hello there") for c in range(200, 260) for t in range(6)]
    # ties of turn and role go by digest, so texts that tie must be equal in brute force: keep one text for each
    first = {}
    rows = [(c, t, role, first.setdefault((c, t, role or ""), text)) for c, t, role, text in rows]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_of_a_long_conversation_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 100)
    rows = [(20, t, "user", f"turn {t}") for t in range(1_000)] + [(21, t, "user", f"turn {t}") for t in range(700)] + [(22, None, None, None)]
    got = trie_of(spark, rows)
    assert len(got) > 1_000 and got[0][:2] == (20, 0)
    want = brute_trie(rows)
    assert got == want
    assert trie_of(spark, []) == []


def test_trie_passes_over_other_columns(spark):
    rows = [(1, 0, "user", "a b", "x", 7), (2, 0, "user", "a b", "y", 8)]
    assert trie_of(spark, rows, "conv_id long, turn long, role string, text string, depth string, p0 long") == brute_trie([x[:4] for x in rows])


def test_digest_of_many_members_goes_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ends = spark.range(1_000).selectExpr("5L as conv_id", "2L as depth", "id * 3 as member").unionByName(spark.createDataFrame([(6, 1, -4), (6, 1, 10), (6, 1, 9)], "conv_id long, depth long, member long"))
    got = {(r["conv_id"], r["depth"]): r["ends_sha256"] for r in prefix_trie.joined_sha256(ends).collect()}
    assert got == {(5, 2): sha(",".join(str(3 * i) for i in range(1_000))), (6, 1): sha("-4,9,10")}


# --- op12


def brute_words(rows, least=5):
    c = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 6 and n >= least}


def brute_groups(words):
    """Near words by deletion of every code point: a way that has no masks."""
    wild = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            wild[w[:i], w[i + 1 :]].add(w)
    near = {w: {v for i in range(len(w)) for v in wild[w[:i], w[i + 1 :]]} - {w} for w in words}
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def groups(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def test_spelling_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert groups(QUERIES["op12_spelling"](spark, SF)) == brute_groups(brute_words(rows))


def test_spelling_of_random_words_near_each_other(spark):
    r = random.Random(3)
    words = {}
    for _ in range(150):
        w = "".join(r.choice("abcéÉ×ÿz") for _ in range(r.randint(6, 9)))
        for _ in range(6):
            i, c = r.randrange(len(w)), r.choice("abcéÉ×ÿz")
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            if len(w) >= 6:
                words[w] = r.choice([5, 6, 25, 30, 130, 700, 4000, 20000])
    got = groups(spelling.group_variants(spark.createDataFrame(sorted(words.items()), "word string, n long")))
    assert got == brute_groups(words)
    assert any(x[2] != x[1] for x in got if x[1]), "a chain of forms"


def test_spelling_counts_edge_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 10)
    long_word = "straße" * 50_000
    rows = [(1, None), (2, ""), (None, "Größen größen GRÖSSEN"), (3, "Größen-größen,größen größen"), (3, "Größen-größen,größen größen"), (4, f"{long_word} " * 5), (5, "ab cd abcde " * 9), (6, "naïve×x " * 7)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, word int")
    got = {r["word"]: r["n"] for r in spelling.vocabulary(df, change=spelling.typos()).collect()}
    assert got == brute_words(rows) and long_word in got
    assert spelling.group_variants(spelling.vocabulary(df.limit(0))).count() == 0
    plain = {r["word"]: r["n"] for r in spelling.vocabulary(df, least=1).collect()}
    assert plain["größen"] == 10 and plain["grÖssen"] == 1


# --- op13


def brute_leaks(docs, items, window=10):
    rx = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: rx.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in items:
        ws = split(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1) if n else ():
            windows[tuple(ws[i : i + n])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        ws, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                w = tuple(ws[i : i + n])
                if w in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out.append((doc, len(ws), len(hit), len(found), sha(",".join(sorted(found)))))
    return sorted(out, key=str)


def leaks(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), sha(",".join(r["items"]))) for r in df.collect()), key=str)


def test_leaks_of_the_table(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = brute_leaks(docs, items)
    got = QUERIES["op13_decontamination"](spark, SF).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got), key=str) == want
    assert any(x[2] for x in want) and all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


@pytest.mark.parametrize("block_words", [200_000, 25])
def test_leaks_of_few_words_in_one_block_and_in_many(spark, block_words):
    r = random.Random(block_words)
    some = lambda n: " ".join(r.choice("ab") for _ in range(n))
    items = [(i, some(r.choice([3, 4, 5, 6, 30]))) for i in range(14)] + [(3, some(12)), (None, "c Aé d"), (90, None), (91, "?!"), (92, "c c")]
    docs = [(i, some(r.choice([1, 8, 40, 300])) + r.choice(["", " c", " Zé. C aé D c c"]) + " " + some(20)) for i in range(60)]
    docs += [(1, "c aé d"), (None, "C, Aé; D!"), (None, None), (5, ""), docs[3], docs[3], (70, "x" * 300_000), (71, "y " * 50_000)]
    d = spark.createDataFrame([(*x, "z", 3) for x in docs], "doc_id long, text string, items string, k1 int")
    i = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, doc_id int")
    assert leaks(decontaminate(d, i, window=4, block_words=block_words)) == brute_leaks(docs, items, 4)


def test_leaks_are_cut_out_of_texts(spark):
    items = spark.createDataFrame([(1, "one two three four five"), (2, "red fish")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before: One two, three FOUR five six. A red fish!  End of the clean words."), (2, "one two three four"), (3, "nothing here"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept"], [tuple(s) for s in r["spans"]], r["items"]) for r in decontaminate(docs, items, window=4, coverage=0.7).collect()}
    assert got == {1: ("Before:  six. A !  End of the clean words.", [(1, 6), (8, 10)], ["1", "2"]), 2: (None, [(0, 4)], ["1"]), 3: ("nothing here", [], []), 4: (None, [], [])}
    assert {r["kept"] for r in decontaminate(docs, items.limit(0)).collect()} == {r["text"] for r in docs.collect()}
    assert decontaminate(docs.limit(0), items).count() == 0


def test_automaton_of_one_word_repeated(spark):
    a = decontamination.Automaton([("1", [b"a"] * 500), ("2", [b"a"] * 3)], 10)
    spans, items = [], set()
    a.scan([b"a"] * 9 + [b"b"] + [b"a"] * 12, spans, items)
    assert spans == [[0, 9], [10, 22]] and items == {"1", "2"}
