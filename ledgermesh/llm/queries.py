"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import LOWER, UPPER, WORDS_SQL, decontaminate
from .exact_dedup import exact_dedup
from .language_id import identify, train
from .mixing import mix
from .packing import pack
from .prefix_trie import joined_sha256, prefix_trie, shared_starts, turns_of
from .quality import classify_quality
from .secret_scan import scan_secrets
from .shingle_join import near_duplicates
from .spelling import group_variants, typos, vocabulary
from .suffix_dedup import remove_repeats
from .token_files import read_token_files, write_token_files
from .vafile import exact_top_k

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), length=400)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_chars_kept")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = F.col("source"), F.concat_ws("/", "source", "lang")
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host, path)


def op3_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, repeats=3)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), end_id=2)
    return read_token_files(files)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), end_id=1, window=2048)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turns_of(table(spark, sf_dir, "conversations"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    trie = prefix_trie(shared_starts(turns, every=20, heads=heads), turns)
    out = trie.nodes.join(joined_sha256(trie.ends), ["conv_id", "depth"], "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(table(spark, sf_dir, "documents"), least=5, shortest=6, change=typos(199)), ratio=5)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality, op3_vector_topk, op4_mixing, op5_token_files, op6_secrets, op7_exact_dedup, op8_language, op9_shingle_join, op10_packing, op11_prefix_trie, op12_spelling, op13_decontamination, pipeline)}

#: crc32 of the UTF-8 bytes of an expression, which must be no more than letters, digits and signs of Latin-1; needs CRC_TABLE in the WITH clause as c.
CRC_TABLE = """t0 AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
        c AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM t0)"""
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(strlen({0}) AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode({0})), 2 * i + 1, 2)) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"""

ORACLE_SQL = {
    "op3_vector_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op9_shingle_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n""",
    "op11_prefix_trie": rf"""
        WITH RECURSIVE {CRC_TABLE},
        o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
        h AS (SELECT conv_id, {CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o) CROSS JOIN c),
        b AS (SELECT h.conv_id, o.pos, o.role, o.text, 0 AS own FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND o.pos < h.h UNION ALL SELECT o.conv_id, o.pos, o.role, o.text, 1 FROM o JOIN h ON o.conv_id = h.conv_id AND o.pos >= h.h),
        r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, md5(length(role) || ':' || role || text) AS g, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM b),
        m AS (SELECT conv_id, depth, w, string_agg(g, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM h),
        l AS (SELECT conv_id, max(depth) AS d FROM m GROUP BY 1),
        n AS (SELECT depth, k, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(w) AS saved, coalesce(string_agg(m.conv_id, ',' ORDER BY m.conv_id) FILTER (l.d = depth), '') AS ends FROM m JOIN l USING (conv_id) GROUP BY 1, 2),
        a AS (SELECT m.conv_id, m.depth, n.conv_id AS node FROM m JOIN n USING (depth, k)),
        e AS (SELECT n.conv_id, n.depth, p.node AS parent, n.n_convs, n.saved, n.ends FROM n LEFT JOIN a p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
        ch AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM e WHERE depth > 0 GROUP BY 1, 2),
        f AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN ch USING (conv_id, depth)),
        u AS (SELECT a.node AS conv_id, a.depth, count(*) FILTER (x.n_children = 0) AS n_leaves, sum(x.saved) AS saved_tokens FROM f x JOIN a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY 1, 2)
        SELECT f.conv_id, f.depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256 FROM f JOIN u USING (conv_id, depth)""",
    "op12_spelling": rf"""
        WITH RECURSIVE {CRC_TABLE},
        d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
        o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s, w, count(*) AS n FROM (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM d) WHERE length(w) >= 6 GROUP BY 1, 2),
        x AS (SELECT w, n, {CRC.format("s")} AS h FROM o CROSS JOIN c),
        v AS (SELECT CASE WHEN h % 199 = 0 THEN w[: h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, sum(n) AS n FROM x GROUP BY 1),
        q AS (SELECT word, CAST(n AS BIGINT) AS n FROM v WHERE length(word) >= 6 AND n >= 5),
        g AS (SELECT word, n, i, word[: i - 1] AS a, word[i + 1 :] AS b FROM q, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
        p AS (SELECT DISTINCT x.word, y.word AS other, y.n AS m FROM g x JOIN g y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word),
        z AS (SELECT DISTINCT g.word, g.n, q.word AS other, q.n AS m FROM g JOIN q ON q.word = g.a || g.b),
        near AS (SELECT word, other, m FROM p UNION SELECT word, other, m FROM z UNION SELECT other, word, n FROM z),
        best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY 1),
        form AS (SELECT q.word, q.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * q.n THEN other END AS form, CASE WHEN m >= 5 * q.n THEN m END AS form_n FROM q LEFT JOIN best USING (word)),
        way AS (SELECT word, word AS spot, 0 AS k FROM form UNION ALL SELECT way.word, form.form, k + 1 FROM way JOIN form ON form.word = way.spot WHERE form.form IS NOT NULL)
        SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM form f JOIN (SELECT word, arg_max(spot, k) AS root FROM way GROUP BY 1) w USING (word)""",
    "op13_decontamination": rf"""
        WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS_SQL}') AS w FROM benchmark),
        v AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k) WHERE len(w) > 0),
        d AS (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS_SQL}') AS w FROM documents),
        s AS (SELECT DISTINCT m FROM v),
        g AS (SELECT n, m, k, array_to_string(w[k : k + m - 1], ' ') AS g FROM d CROSS JOIN s, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS k)),
        x AS (SELECT g.n, g.k, g.m, v.item FROM g JOIN v USING (m, g)),
        y AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(k, k + m)) AS p FROM x) GROUP BY 1),
        z AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item FROM x) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN y USING (n) LEFT JOIN z USING (n)""",
}
