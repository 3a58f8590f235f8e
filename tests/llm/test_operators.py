"""Brute-force versions of the training-data operators on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgermesh.llm.exact_dedup import exact_dedup
from ledgermesh.llm.language_id import identify, train
from ledgermesh.llm.mixing import mix
from ledgermesh.llm.packing import pack
from ledgermesh.llm.quality import classify_quality
from ledgermesh.llm.secret_scan import scan_secrets
from ledgermesh.llm.shingle_join import near_duplicates
from ledgermesh.llm.suffix_dedup import remove_repeats
from ledgermesh.llm.token_files import EliasFano, read_token_files, write_token_files
from ledgermesh.llm.vafile import exact_top_k

WS = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, pos int, n int, kept boolean, h long"


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "the", "or", "ein", "ü", "ld", "x1"]) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 160))) for _ in range(40)]
    texts += texts[:6] + [t.replace(" ", "\n ") for t in texts[6:9]] + [t + " more" for t in texts[9:14]] + [texts[20] + "\n" + texts[21], "ab" * 450, "x" * 401, "y" * 400]
    texts += [None, "", " ", "one", "a b", "\x01\x02 <|endoftext|> é", "token = abcdef secret: tok AKIA" + "B7" * 9 + " " + "0f" * 15, "word " * 3000]
    return [(i, t, None if i % 9 == 0 else ("en", "de")[i % 2], None if i % 7 == 0 else f"s{i % 3}", None, 1, 2, 3, True, 4) for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[re.sub(WS, " ", t or "")].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
    for budget in (96 << 20, 3000):
        assert {r[0]: tuple(r)[1:] for r in exact_dedup(docs, budget=budget).collect()} == want
    twice = docs.unionByName(docs)
    assert exact_dedup(twice).where("kept").count() == len(groups)
    assert exact_dedup(empty).count() == 0


def test_remove_repeats(docs, empty):
    raw = {i: (t or "").encode() for i, t, *_ in ROWS}
    seen = defaultdict(int)
    for b in raw.values():
        for p in range(len(b) - 399):
            seen[b[p : p + 400]] += 1
    got = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (bytes(got[i]["kept"]), got[i]["n_bytes"]) == (kept, len(b)), i
        assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == len(b) - len(kept)
    assert remove_repeats(empty).count() == 0


def test_near_duplicates(docs, empty):
    sets = {}
    for i, t, *_ in ROWS:
        w = [x for x in re.split(WS, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    got = {r[0]: tuple(r)[1:] for r in near_duplicates(docs).collect()}
    assert got == {i: (len(s), least[i]) for i, s in sets.items()}
    assert near_duplicates(empty).count() == 0


def test_token_files_and_packing(docs, empty):
    for name, end in (("word_bpe_49k.json", 2), ("byte_bpe_50k.json", 1)):
        path = public_tokenizers.path(name)
        tok = Tokenizer.from_file(path)
        ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for i, t, *_ in ROWS}
        start = 0
        for r in read_token_files(write_token_files(docs, path, end, shard_ids=500)).orderBy("doc_id").collect():
            assert tuple(r) == (r[0], start, len(ids[r[0]]), zlib.crc32(ids[r[0]].tobytes()))
            start += len(ids[r[0]])
        place, fill = defaultdict(int), defaultdict(int)
        pieces = pack(docs, path, end, window=128, segment_ids=1000).collect()
        for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
            assert r["start"] == place[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
            place[r["doc_id"]] += r["length"]
        for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == fill[r["sequence_id"]]
            fill[r["sequence_id"]] += r["length"]
        assert place == {i: len(x) for i, x in ids.items()} and max(fill.values()) <= 128
    assert read_token_files(write_token_files(empty, path, end)).count() == 0 and pack(empty, path, end).count() == 0
    v = np.sort(np.random.default_rng(0).integers(0, 10**6, 3000))
    ef = EliasFano.of(v)
    assert (ef.all() == v).all() and all(ef.select(i) == v[i] for i in range(0, 3000, 13))


def test_mix(docs, empty):
    got = mix(docs).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, want = sum(size.values()), set(size), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * size[s]
            left -= want[s]
            open_.remove(s)
    want |= share
    assert target == pytest.approx(want) and len(got) == len(ROWS)
    assert sorted(map(tuple, mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mix(empty).count() == 0


def test_secrets(docs):
    got = {r["doc_id"]: r for r in scan_secrets(docs).collect()}
    at = ROWS[-2][1].index("AKIA")
    assert (got[len(ROWS) - 2]["n_assign"], got[len(ROWS) - 2]["n_access"], got[len(ROWS) - 2]["n_hex"]) == (1, 1, 1)
    assert f"access:{at}:{at + 22}" in got[len(ROWS) - 2]["spans"]
    assert sum(r["n_random"] for r in got.values()) == 0


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(i, "é the key " + "".join(rng.choice(alphabet) for _ in range(40)) + " ends") for i in range(50)]
    rows += [(100 + i, "Internationalisation2024Report AAAAAAAAAAAAAAAAAAAAAAAA1a abcabcabcabcabcabcabcABC1") for i in range(5)]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_random"] == 1 for r in got if r["doc_id"] < 100) >= 45
    assert all(r["n_random"] == 0 for r in got if r["doc_id"] >= 100)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).round(2)
    v[50:150] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1050, [float("nan")] * 8), (1100, [1.0, None] * 4)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = np.floor(256 * v).astype(int)
    want = [(i, k + 1, j, q[i] @ q[j]) for i in range(0, 300, 50) for k, j in enumerate([j for j in np.lexsort((range(300), -(q @ q[i]))) if j != i][:5])]
    got = exact_top_k(e, e.where("vec_id % 50 = 0"), vector_block=64, query_block=4).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == want
    assert exact_top_k(e.limit(0), e.limit(0)).count() == 0


def test_language_and_quality(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(d, train(d)).join(d, "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()
    odd = {r["doc_id"]: r for r in identify(docs, train(docs)).collect()}
    assert odd[54]["lang_pred"] != "" and all(odd[i]["lang_pred"] == "und" for i, t, *_ in ROWS if not any(c.isalpha() for c in t or ""))
    assert identify(empty, train(empty)).count() == 0
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    q = classify_quality(d, labels, d["source"], d["lang"]).join(labels, "doc_id")
    assert q.where("(quality = 1) = keep").count() >= 0.95 * q.count()
    assert classify_quality(empty, labels.limit(0), empty["source"], empty["lang"]).count() == 0
