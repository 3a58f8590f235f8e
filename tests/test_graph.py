import random

from ledgermesh.operators import graph


def closure(edges, n):
    out = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in edges:
            for s in out:
                if a in out[s]:
                    out[s].add(b)
    return out


def test_reach_and_cycles_on_random_graphs(spark):
    for seed in range(2):
        rng, n = random.Random(seed), 12
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(15)]
        want = closure(edges, n)
        e = spark.createDataFrame(edges, "src long, dst long")
        starts = spark.createDataFrame([(0, 0), (3, 3)], "source long, node long")
        assert {tuple(r) for r in graph.reach(e, starts).collect()} == {(s, x) for s in (0, 3) for x in want[s]}
        loops = {a for a, b in edges if a == b}
        groups = {i: min(j for j in want[i] if i in want[j]) for i in range(n) if i in loops or any(i in want[j] for j in want[i] if j != i)}
        assert {r["node"]: r["component"] for r in graph.circular_groups(e).collect()} == groups


def test_cycles_inside_books(spark):
    rng, rows = random.Random(5), []
    for book in range(6):
        rows += [(book, f"n{rng.randrange(15):02d}", f"n{rng.randrange(15):02d}") for _ in range(20)]
    # a chain of formulas that ends in a ring of three
    rows += [(99, f"c{k:05d}", f"c{k + 1:05d}") for k in range(5000)] + [(99, "c05000", "c04998")]
    edges = spark.createDataFrame(rows, "book int, src string, dst string")
    got = {(r["book"], r["node"]): r["component"] for r in graph.circular_in_books(edges).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 99} == dict.fromkeys(["c04998", "c04999", "c05000"], "c04998")
    small = edges.where("book < 99")
    assert {k: v for k, v in got.items() if k[0] < 99} == {(r["book"], r["node"]): r["component"] for r in graph.circular_in_books(small, most_edges=1).collect()}
    assert graph.circular_in_books(edges.limit(0)).count() == 0


def test_reads_of_cells_by_runs(spark):
    """Runs give what expanded ranges give: overlaps, whole columns, wide ranges past the cap, names that are no address."""
    rng, kinds = random.Random(3), []
    letter = lambda n: (chr(64 + (n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)
    for k in range(60):
        src, sheet = f"S!Z{k // 3}", rng.choice(["S", "My S"])
        c1, r1, w, h = rng.randint(1, 9), rng.randint(1, 9), rng.choice([1, 1, 2, 30, 60]), rng.choice([1, 3, 90, 5000])
        kinds += [("b", src, "range", f"{sheet}!{letter(c1)}{r1}:{letter(c1 + w - 1)}{r1 + h - 1}"), ("b", src, rng.choice(["ref", "cross_sheet"]), f"{sheet}!{letter(c1)}{rng.randint(1, 12)}")]
    kinds += [("b", "S!Z1", "range", "S!2:3"), ("b", "S!Z2", "range", "S!A:C"), ("b", "S!Z2", "ref", "S!ABCD7"), ("b", "S!Z2", "ref", "S!ABCD7"), ("b", "S!Z3", "external", "[1]X!A1"), ("c", "S!Z1", "ref", "S!A1")]
    edges = spark.createDataFrame(kinds, "workbook_id string, src string, kind string, dst string")
    pairs = [(b, r["src"], r["dst"]) for b in "bc" for r in graph.range_edges(edges.where(f"workbook_id = '{b}'")).collect()]
    want = {("c", "S!Q1"): [0, 0]}
    for b, src, dst in pairs:
        want.setdefault((b, src), [0, 0])[0] += 1
        want.setdefault((b, dst), [0, 0])[1] += 1
    runs = graph.read_runs(edges)
    cells = spark.createDataFrame([("c", "S!Q1")], "workbook_id string, ref string")
    assert {(r["workbook_id"], r["node"]): [r["n_reads"], r["n_read_by"]] for r in graph.nodes(runs, cells).collect()} == want
    assert {(r["workbook_id"], r["src"]): r["cells"] for r in graph.reads(runs).collect()} == {k: v[0] for k, v in want.items() if v[0]}
    # a long range is one row, not a row a cell
    long = spark.createDataFrame([("b", f"S!C{k}", "range", f"S!A1:A{k + 2000}") for k in range(50)], edges.schema)
    assert graph.read_runs(long).count() == 50


def test_reads_of_whole_ranges(spark):
    """Without a cap the runs of a cell hold every cell of its ranges once: long, wide, overlapping, whole columns and rows."""
    made = {
        "S!H1": [("range", "S!A1:A5000"), ("range", "S!A4000:A6000"), ("ref", "S!A6000")],
        "S!H2": [("range", "S!D9:DC108"), ("range", "S!B2:B2001")],
        "S!H3": [("range", "O!B:C"), ("range", "O!C5:C7")],
        "S!H4": [("range", "O!9:10")],
    }
    edges = spark.createDataFrame([("b", src, *e) for src, some in made.items() for e in some], "workbook_id string, src string, kind string, dst string")
    runs = graph.read_runs(edges, cap=None)
    assert {r["src"]: r["cells"] for r in graph.reads(runs).collect()} == {"S!H1": 6000, "S!H2": 104 * 100 + 2000, "S!H3": 2 * 1_048_576, "S!H4": 2 * 16_384}
    small = graph.nodes(runs.where("src in ('S!H1', 'S!H2')"), spark.createDataFrame([("b", "S!A2500"), ("b", "S!Q1")], "workbook_id string, ref string"))
    got = {r["node"]: (r["n_reads"], r["n_read_by"]) for r in small.collect()}
    # A1 to A6000, B2 to B2001, D9 to DC108, the two formulas and Q1
    assert len(got) == 6000 + 2000 + 10_400 + 2 + 1 and sum(n for _, n in got.values()) == 6000 + 12_400
    assert [got[n] for n in ("S!H1", "S!A2500", "S!A6000", "S!DC108", "S!Q1")] == [(6000, 0), (0, 1), (0, 1), (0, 1), (0, 0)]
    # A1 to A2000, A4000 to A5999 and A6000 are left with the cap
    assert graph.reads(graph.read_runs(edges.where("src = 'S!H1'"))).collect()[0]["cells"] == 4001


def test_what_books_read_in_one_walk(spark):
    """Rings, shared targets, starts without an edge; a chain of formulas takes no rounds, large books give the same."""
    from ledgermesh.operators.detectors import _in_books

    rng, rows = random.Random(8), []
    for book in range(8):
        rows += [(book, f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(14)]
    starts = [(book, f"n{rng.randrange(12)}") for book in range(8)] + [(8, "lone"), (9, "c0")]
    want = set(starts)
    while True:
        more = want | {(b, d) for b, s, d in rows if (b, s) in want}
        if more == want:
            break
        want = more
    chain = [(9, f"c{k}", f"c{k + 1}") for k in range(3000)] + [(9, "c3000", None)]
    edges = spark.createDataFrame(rows, "workbook_id long, src string, dst string")
    given = spark.createDataFrame(starts, "workbook_id long, ref string")
    whole = _in_books(edges.unionByName(spark.createDataFrame(chain, edges.schema)), given).collect()
    assert sorted((r[0], r[1]) for r in whole) == sorted(want | {(9, f"c{k}") for k in range(3001)})
    assert {(r[0], r[1]) for r in _in_books(edges, given, most_edges=5).collect()} == want
