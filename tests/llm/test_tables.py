import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.llm import duplicates, encoding, fusion, leakage, neighbours, packing, pairs

RECORD = "record_id long, query string, category string, output array<array<string>>, key string"


def test_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    base = [("How to get there?", "a", [["lex", "x y"], ["vec", "z"]]), ("place: Berlin; need: map", "b", [["hyde", "Straße 1"]]), (None, "b", None), ("", None, []), ("q", "c", [["lex", None]]), ("note: only one", "c", [["lex", "a"]])]
    rows, kind = [], {}
    for i in range(200):
        k = 0 if i % 3 == 0 else rng.randrange(len(base))
        q, c, o = base[k]
        if q and k == 1 and rng.random() < 0.5:
            q = "need:MAP | place : berlin"
        elif q:
            q = rng.choice([q, q.upper(), f"  {q} !"])
        if o:
            o = [[a, b.upper() if b and rng.random() < 0.5 else b] for a, b in rng.sample(o, len(o))]
        rows.append((i, q, c, o, "clash"))
        kind[i] = k
    groups, members = duplicates.duplicate_groups(spark.createDataFrame(rows, RECORD))
    want = {}
    for i, k in kind.items():
        want.setdefault(k, []).append(i)
    assert {(r[0], r[1]) for r in groups.collect()} == {(min(v), len(v)) for v in want.values()}
    assert {tuple(r) for r in members.collect()} == {(min(v), i) for v in want.values() for i in v if i != min(v)}
    salted, more = duplicates.duplicate_groups(spark.createDataFrame(rows, RECORD), 0.1, 20)  # every large group is hot
    assert {tuple(r) for r in salted.collect()} == {tuple(r) for r in groups.collect()} and {tuple(r) for r in more.collect()} == {tuple(r) for r in members.collect()}
    assert duplicates.duplicate_groups(spark.createDataFrame([], RECORD))[0].count() == 0


def test_duplicates_keep_apart_what_differs(spark):
    rows = [(1, "a1", "c", [["lex", "x"], ["lex", "x"]]), (2, "a1", "c", [["lex", "x"]]), (3, "a1", "c", [["vec", "x"], ["lex", "x"]]), (4, "a 1", "c", [["lex", "x"], ["lex", "X"]]), (5, "x: a; y: b", "c", None), (6, "y: b; x: a", "c", None), (7, "y b; x a", "c", None), (8, "yb xa", "c", None)]
    _, members = duplicates.duplicate_groups(spark.createDataFrame([(*r, "") for r in rows], RECORD))
    assert {tuple(r) for r in members.collect()} == {(1, 4), (5, 6), (7, 8)}


def test_leximin_order(spark):
    schema = "query_id long, node_id string, raw_score double, rrf_score double, fts_rank int, vector_rank int, rerank_score double, rank int"
    rows = [(1, "even", -5.0, 0.5, 2, 2, 5.0, 0), (1, "masked", -9.0, 0.9, 1, 4, 1e9, 0), (1, "low", -1.0, 0.1, 3, 3, 1.0, 0), (1, "gap", None, None, None, 1, math.nan, 0), (1, "none", None, None, None, None, None, 0), (1, "even", None, None, None, 2, None, 0), (2, "one", -1.0, 0.0, 1, None, math.inf, 0), (None, "lost", -1.0, 0.0, 1, 1, 1.0, 0)]
    df = spark.createDataFrame(rows, schema)
    got = fusion.leximin_rank(df, "query_id", "node_id")
    order = [r["node_id"] for r in got.where("query_id = 1").orderBy("rank").collect()]
    assert order[0] == "gap" and order.index("even") < order.index("masked") and len(order) == 5
    hot = fusion.leximin_rank(df, "query_id", "node_id", hot_rows=2)
    key = lambda d: sorted(map(str, d.select("query_id", "node_id", "worst_to_best", "rank").collect()))
    assert key(hot) == key(got)
    scaled = fusion.leximin_rank(df.withColumn("rerank_score", F.col("rerank_score") * 1000 - 7), "query_id", "node_id")
    assert key(scaled) == key(got)
    assert fusion.leximin_rank(df.where("false"), "query_id", "node_id").count() == 0


def test_ranking_quality(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1)], "q long, i string, rank int")
    judged = spark.createDataFrame([(1, "a", 3), (1, "b", 0), (1, "b", None), (2, "a", 0)], "q long, i string, relevance int")
    assert [tuple(r) for r in fusion.ranking_quality(ranked, judged, "q", "i").collect()] == [(1, 1.0)]


def _vectors(n, dims=32, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    m = (centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dims))).astype(np.float32)
    m[1] = m[0] * 3
    return m


def test_nearest_against_brute_force(spark):
    m = _vectors(600)
    bad = [("null", None), ("short", [1.0] * 31), ("zero", [0.0] * 32), ("nan", [float("nan")] * 32)]
    rows = [(f"n{i:04}", v.tolist()) for i, v in enumerate(m)] + bad + [("n0005", m[5].tolist())]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "node_id string, v array<float>, pivot int")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    for index in (neighbours.PermutationIndex(dims=32), neighbours.PermutationIndex(dims=32, part=50)):
        got = neighbours.nearest(df, "node_id", "v", 10, index).collect()
        found = {}
        for r in got:
            found.setdefault(r["id"], {})[r["neighbour"]] = (r["similarity"], r["rank"])
        assert set(found) == {f"n{i:04}" for i in range(600)}
        hits = [len({f"n{j:04}" for j in np.argsort(-sims[i])[:10]} & set(found[f"n{i:04}"])) for i in range(600)]
        assert sum(hits) / 6000 >= 0.9
        assert all(len(v) == 10 and k not in v for k, v in found.items())
        assert found["n0000"]["n0001"] == (pytest.approx(1.0, abs=1e-6), 1)
    assert neighbours.nearest(df.where("node_id in ('null', 'zero')"), "node_id", "v", 10, neighbours.PermutationIndex(dims=32)).count() == 0
    assert neighbours.nearest(df.where("node_id = 'n0001'"), "node_id", "v", 10, neighbours.PermutationIndex(dims=32)).count() == 0


def test_minimum_slack_is_feasible_and_full():
    rng = np.random.default_rng(5)
    for _ in range(20):
        cap = int(rng.integers(5, 60))
        lengths = rng.integers(1, cap + 1, int(rng.integers(1, 200))).tolist()
        hist = {x: lengths.count(x) for x in set(lengths)}
        plan = packing.minimum_slack(dict(hist), cap)
        used = {}
        for combo, times in plan:
            assert sum(a * m for a, m in combo.items()) <= cap and times > 0
            for a, m in combo.items():
                used[a] = used.get(a, 0) + m * times
        assert used == hist
    counts = np.zeros(21, int)
    counts[[3, 5, 7, 11]] = [2, 1, 3, 1]
    best = max(3 * a + 5 * b + 7 * c + 11 * d for a in range(3) for b in range(2) for c in range(4) for d in range(2) if 3 * a + 5 * b + 7 * c + 11 * d <= 19)
    assert sum(k * v for k, v in packing.fullest(counts, 19).items()) == best


def test_pack(spark):
    texts = [(i, "word " * (i % 37)) for i in range(300)] + [(1000, "long text " * 900), (1001, None), (1002, ""), (1003, "<|endoftext|>")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, piece int")
    for hot in (10, 1_000_000):
        rows = packing.pack(docs, 256, hot_rows=hot).collect()
        room, parts = {}, {}
        for r in rows:
            parts.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"]))
            if r["container"] is not None:
                room[r["container"]] = room.get(r["container"], 0) + r["n_tokens"]
        assert set(parts) == {i for i, _ in texts} and max(room.values()) <= 256
        encode = packing.encoder(packing.RANKS).encode_ordinary
        for i, t in texts:
            n = len(encode(t)) if t else 0
            assert sum(x for _, x in parts[i]) == n and len(parts[i]) == max(1, math.ceil(n / 256))
            assert [s for s, _ in sorted(parts[i])] == list(range(0, max(n, 1), 256))
        least = math.ceil(sum(room.values()) / 256)
        assert len(room) <= least + 1
    assert packing.pack(docs.where("false"), 256).count() == 0


def test_leakage(spark):
    rng = random.Random(2)
    vocabulary = [f"term{i}" for i in range(400)]
    item = [rng.choice(vocabulary) for _ in range(80)]
    fill = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    edited = item[10:45]
    edited[8], edited[20] = "changed", "altered"
    many = item[10:45]
    for i in range(0, 35, 4):
        many[i] = "x"
    docs = {
        1: (fill(5000) + item[20:50] + fill(3000), True), 2: (item[:25], True), 3: (item[:22], False), 4: (fill(50) + edited + fill(9), True), 5: (many, False), 6: (fill(400), False),
        7: (item[5:20] + ["added"] + item[20:40], True), 8: (item[:12] + fill(40) + item[40:52], False), 9: ([], False),
    }
    rows = [(k, " ".join(w)) for k, (w, _) in docs.items()]
    rows += [(10, "# " + "\n# ".join(" ".join(item[i : i + 6]).upper() for i in range(0, 36, 6)) + "!"), (11, "<b>" + "</b> *".join(item[:30]) + "*"), (12, item[0][:3] + "-\n> " + item[0][3:] + " " + ", ".join(item[1:28])), (13, None)]
    items = spark.createDataFrame([(7, " ".join(item), "q"), (8, "too short", "q"), (9, None, "q")], "item_id long, text string, kind string")
    table = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, item_id int")
    got = {tuple(r) for r in leakage.leaked(table, items).collect()}
    assert got == {(k, 7) for k, (_, hit) in docs.items() if hit} | {(10, 7), (11, 7), (12, 7)}
    assert {tuple(r) for r in leakage.leaked(table, items, leakage.Containment(most_chars=100)).collect()} == got
    assert leakage.leaked(table.where("false"), items).count() == 0 and leakage.leaked(table, items.where("false")).count() == 0


def test_forms_round_trip():
    for word in ("café", "größer", "Привет", "naïve", "“quoted”", "żółć"):
        for form, chain in ((f, c) for f, cs in encoding.garbled_forms(word).items() for c in cs):
            if "�" not in form and chain.startswith("utf-8>"):
                back = form.encode(chain.partition(">")[2], "replace") if not any("\x80" <= c < "\xa0" for c in form) else None
                assert back is None or back.decode("utf-8", "replace") == word


def test_repair(spark):
    clean = "Größe und Zähler für café naïve “gut” Müller — straße"
    russian = "Размер блока равен каждый узел имеет"
    rows = [(i, clean) for i in range(1, 6)] + [(i, russian) for i in range(6, 12)]
    rows += [(20, clean.encode().decode("cp1252", "replace").replace("�", "\x9d")), (21, "plain then " + "café Müller".encode().decode("latin-1")), (22, russian.encode("cp1251").decode("latin-1")), (23, clean.encode().decode("cp437")), (24, "Größe".encode().decode("cp1252").encode().decode("cp1252"))]
    rows += [(30, "a sample: `Ã¼` shows up"), (31, "SÃO and CHÂTEAU stay"), (32, None), (33, ""), (34, "ascii only"), (40, "lost Gr��e here and z��e"), (41, "größer " * 3), (42, "lost z��e alone")]
    rows += [(50, russian.encode("cp1251").decode("latin-1").encode().decode("cp437")), (51, "Größe".encode().decode("cp1252").encode().decode("mac_roman").encode().decode("cp850"))]
    got = {r["doc_id"]: r for r in encoding.repair(spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, word string")).collect()}
    assert set(got) == {20, 21, 22, 23, 24, 40, 50, 51}
    assert got[20]["text"] == clean and got[23]["text"] == clean and got[22]["text"] == russian and got[21]["text"] == "plain then café Müller" and got[24]["text"] == "Größe"
    assert got[40]["n_left"] == 1 and got[40]["text"].startswith("lost Größe here")
    assert got[50]["text"] == russian and got[51]["text"] == "Größe"  # chains above any encoding, however many
    assert encoding.repair(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs(spark, tiny):
    base = spark.read.parquet(tiny.replace("sf0.001", "sf0.01") + "/qmd_expansion_locations.parquet").select("record_id", "query", "output")
    q = "history of milotar senkel harbour before the flood"
    good = [["hyde", "A short guide to milotar senkel harbour with routes, fees and quiet hours."], ["lex", "milotar senkel harbour ticket prices"], ["vec", "how crowded milotar senkel harbour gets in the summer"]]
    made = [
        (900001, q, good, None), (900002, q, None, "empty"), (900003, q, [], "empty"), (900004, q, [["lex", None], ["vec", " — "]], "empty"), (900005, q, [["hyde", "I'm sorry, but I can't help with that."]] * 2, "refusal"),
        (900006, q, [["lex", q.upper()], ["vec", f"Query: {q}?"]], "copy"), (900007, q, [*good[:2], ["vec", "how crowded milotar senkel harbour gets in the su"]], "truncated"),
        (900008, q, [["hyde", "Der Bus 3 hält direkt vor milotar senkel harbour, der Weg dauert eine Stunde."], ["lex", "milotar senkel harbour Öffnungszeiten"], ["vec", "wie lange der Rundgang um milotar senkel harbour dauert"]], "other_language"),
        (900009, None, good, None), (900010, q, [["hyde", "Visitors cannot enter milotar senkel harbour after dusk, but the terrace stays open until 3 past ten."], *good[1:]], None),
    ]
    mine = spark.createDataFrame([r[:3] for r in made], "record_id long, query string, output array<array<string>>")
    got = {r["record_id"]: r["defect"] for r in pairs.defects(base.unionByName(mine)).collect()}
    for i, _, _, want in made:
        assert got.get(i) == want, i
    assert pairs.defects(base.where("false")).count() == 0


def test_refusals_that_were_never_listed(spark, tiny):
    base = spark.read.parquet(tiny.replace("sf0.001", "sf0.01") + "/qmd_expansion_locations.parquet").select("record_id", "query", "output")
    asked = [r["query"] for r in base.where("query is not null").orderBy("record_id").limit(400).collect()][::20]
    unseen = ["That topic is off limits for me.", "This falls outside what I am allowed to do.", "I'm not comfortable with that.", "Please ask someone else about that."]
    assert not any(u in listed for u in unseen for pool in pairs.REFUSALS.values() for listed in pool)
    rows = [(10**7 + 100 * i + j, q, [["hyde", text], ["lex", text]][: 1 + i % 2]) for i, q in enumerate(asked) for j, text in enumerate(unseen)]
    got = {r["record_id"]: r["defect"] for r in pairs.defects(base.unionByName(spark.createDataFrame(rows, base.schema))).where("record_id >= 10000000").collect()}
    assert sum(got.get(i) == "refusal" for i, *_ in rows) >= 0.9 * len(rows)


def test_field_learns_a_chain():
    rng = np.random.default_rng(0)
    seqs, tags = [], []
    for _ in range(200):
        t = [int(x) for x in np.cumsum(rng.integers(0, 2, 5)) % 3]
        x = np.zeros((5, 4))
        x[:, 0] = 1
        for i, k in enumerate(t):
            x[i, 1 + k] = 1
        seqs.append(x)
        tags.append(t)
    field = pairs.Field(4).fit(seqs, tags, 80, 0.5)
    assert np.mean([a == b for a, b in zip(field.tag(seqs), tags)]) > 0.95
