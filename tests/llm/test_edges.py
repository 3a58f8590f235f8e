"""Null ids, rows that repeat, clashing columns, very long words and empty tables of the earlier operators."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgermesh.llm.exact_dedup import exact_dedup
from ledgermesh.llm.language_id import identify, train
from ledgermesh.llm.mixing import mix
from ledgermesh.llm.packing import pack
from ledgermesh.llm.secret_scan import scan_secrets
from ledgermesh.llm.shingle_join import near_duplicates
from ledgermesh.llm.suffix_dedup import remove_repeats
from ledgermesh.llm.token_files import read_token_files, write_token_files
from ledgermesh.llm.vafile import exact_top_k

LONG = "x7" * 150_000
ROWS = [(1, "plain words of a text", "en", "a"), (1, "plain words of a text", "en", "a"), (None, "plain words of a text", "en", None), (None, None, None, "b"), (2, LONG, "en", "b"), (2, "", "fr", "b"), (3, "password = hunter2secret", "fr", "a"), (3, "password = hunter2secret", "fr", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns that operators use inside
    return spark.createDataFrame([(*r, 1, "z") for r in ROWS], SCHEMA + ", n int, key string").cache()


def test_vectors_in_several_sets_and_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(150)]
    rows += [rows[3], rows[3], (500, [float("nan")] * 6), (501, None), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (503, [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, group int, block int")
    got = sorted(tuple(r) for r in exact_top_k(df, df.where("vec_id % 10 = 0"), k=3, query_block=4, vector_block=16, group_files=1, set_blocks=1).collect())
    whole = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and i < 500]
    want = []
    for q in range(0, 150, 10):
        best = sorted((-int(v @ dict(whole)[q]), i) for i, v in whole if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert exact_top_k(df.limit(0), df.limit(0)).count() == 0


def test_mix_gives_each_row_a_line(docs):
    got = mix(docs).collect()
    assert len(got) == len(ROWS) and sorted(r["size"] for r in got) == sorted(len((t or "").split()) for _, t, *_ in ROWS)
    assert all(r["taken"] <= 3 * r["size"] for r in got) and {r["source"] for r in got} == {"a", "b", None}
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    for rows in by.values():
        # a document more or less is what a source may miss its target by
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows)


def test_token_files_and_packing_keep_every_row(docs):
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    got = read_token_files(write_token_files(docs, word, end_id=2)).collect()
    own = Tokenizer.from_file(word)
    want = sorted((len(own.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ROWS))
    assert sorted(r["n_tokens"] for r in got) == want and sum(r["doc_id"] is None for r in got) == 2
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    pieces = pack(docs, byte, end_id=1).collect()
    tok = Tokenizer.from_file(byte)
    assert sum(p["length"] for p in pieces) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ROWS)
    assert pack(docs.limit(0), byte, end_id=1).count() == 0


def test_secrets_of_rows_that_repeat_and_of_nothing(docs):
    got = scan_secrets(docs).select("doc_id", "n_assign", "n_hex").collect()
    assert len(got) == len(ROWS) and sorted(r["n_assign"] for r in got) == [0] * 6 + [1, 1]
    assert scan_secrets(docs.limit(0)).count() == 0


def test_exact_and_near_copies_with_null_ids(docs):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs).collect()), key=str)
    assert len(got) == len(ROWS) and sum(k for *_, k in got) == 4 and [g[2] for g in got if g[0] == 1] == [3, 3]
    near = near_duplicates(docs).collect()
    assert len(near) == len(ROWS) and {r["component_id"] for r in near if r["doc_id"] == 1} == {1}
    assert exact_dedup(docs.limit(0)).count() == near_duplicates(docs.limit(0)).count() == 0


def test_repeats_of_a_long_word(docs):
    got = {(r["doc_id"], r["n_bytes"]): (len(r["kept"]), len(r["spans"])) for r in remove_repeats(docs).collect()}
    assert got[2, 300_000] == (0, 1) and got[1, 21] == (21, 0)


def test_languages_of_every_row(spark, docs):
    rng = random.Random(1)
    texts = [(100 + i, " ".join(rng.choice(w) for _ in range(40)), lang) for i in range(40) for lang, w in (("en", ["the", "word", "and", "is"]), ("fr", ["le", "mot", "est", "où"]))]
    model = train(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    got = identify(docs, model).collect()
    assert len(got) == len(ROWS) and sum(r["lang_pred"] == "und" for r in got) == 2
    assert identify(docs.limit(0), model).count() == 0 and train(docs.where(F.lit(False)))[0] == []
