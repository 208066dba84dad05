import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phytoscape.llm import clusters as C
from phytoscape.llm.latex import words
from phytoscape.llm.leakage import leaked, overgrown
from phytoscape.llm.naming import Dictionary, map_names, weighted_distance
from phytoscape.llm.packing import first_fit_decreasing, pack, pack_groups
from phytoscape.llm.similar import Index, _hadamard, nearest_vectors
from phytoscape.llm.splitting import Split, landmarks, split_documents, split_text
from phytoscape.llm.tokens import TokenCounter


# --- similar vectors ---------------------------------------------------------
def test_hadamard_is_a_rotation():
    a = np.random.default_rng(1).normal(size=(3, 16))
    assert np.allclose(np.linalg.norm(_hadamard(a), axis=1), np.linalg.norm(a, axis=1)) and np.allclose(_hadamard(_hadamard(a)), a)


def vectors(spark, m, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids if ids is not None else range(len(m)), m)], "id long, vec array<double>")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    m = np.concatenate([rng.poisson(8, (500, 20)), np.repeat(rng.poisson(8, (10, 20)), 20, 0) + rng.poisson(1, (200, 20))])
    df = vectors(spark, m)
    got = nearest_vectors(df, df.where("id % 20 = 0").select("id"), 5, Index(chunk_rows=16)).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    hit = 0
    for i in range(0, 700, 20):
        s = u @ u[i]
        s[i] = -1
        hit += len({r["near"] for r in got if r["id"] == i} & set(np.lexsort((np.arange(700), -np.round(s, 12)))[:5].tolist()))
    assert hit / (35 * 5) >= 0.9 and all(r["similarity"] == pytest.approx(u[r["id"]] @ u[r["near"]]) for r in got)


def test_copies_ties_and_unusable_vectors(spark):
    m = [[1, 2, 3]] * 50 + [[3, 2, 1], [0, 0, 0]]
    df = vectors(spark, m).union(spark.createDataFrame([(60, None), (None, [1.0, 2.0, 3.0]), (61, [1.0, None, 2.0]), (62, [float("nan"), 1.0, 1.0])], "id long, vec array<double>"))
    got = nearest_vectors(df, spark.createDataFrame([(7,), (50,), (51,), (60,)], "id long"), 3, Index(chunk_rows=2))
    rows = sorted((r["id"], r["rank"], r["near"]) for r in got.collect())
    assert rows == [(7, 1, 0), (7, 2, 1), (7, 3, 2), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert nearest_vectors(df.limit(0), df.select("id"), 3).count() == 0


# --- clusters ------------------------------------------------------------------
def by_hand(m, limit, least):
    up = list(range(len(m)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(m)):
        for j in range(i):
            if np.abs(m[i] - m[j]).sum() <= limit:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    roots = [top(i) for i in range(len(m))]
    return {(i, r) for i, r in enumerate(roots) if roots.count(r) >= least}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_are_exact(spark, seed):
    rng = np.random.default_rng(seed)
    chain = np.cumsum(rng.integers(0, 3, (60, 8)), 0)  # long chains: ends far apart
    m = np.concatenate([rng.integers(0, 40, (250, 8)), chain, np.repeat(rng.integers(0, 40, (4, 8)), 15, 0) + rng.integers(0, 2, (60, 8)), np.full((30, 8), 7)])
    got = {(r["id"], r["cluster_id"]) for r in C.similarity_clusters(vectors(spark, m), 12, 3, leaf_rows=20, sample_rows=100, task_rows=60).collect()}
    assert got == by_hand(m, 12, 3)


def test_leaf_links_without_a_tree():
    rng = np.random.default_rng(4)
    m = rng.integers(0, 12, (900, 6)).astype(np.float32)
    label, unsure = C.link_leaf(m, 4.0)
    want = {i: r for i, r in by_hand(m, 4, 1)}
    assert [want[i] for i in range(len(m))] == label.tolist() and not unsure.any()


def test_leaves_are_compact_and_cuts_do_not_double():
    rng = np.random.default_rng(5)
    dense = np.unique(rng.poisson(2, (4000, 29)), axis=0).astype(np.float32)
    assert C.fit_top(dense, 500, 0.0, 18.0) == []  # a cut would hand most rows to both sides
    m = np.concatenate([rng.integers(0, 40, (3000, 29)), np.repeat(rng.integers(0, 40, (50, 29)), 40, 0) + rng.integers(0, 2, (2000, 29))]).astype(np.float32)
    pivot = C.compact_leaves(m, 18.0)
    assert np.abs(m - m[pivot]).sum(1).max() <= 18 and (pivot[pivot] == pivot).all() and len(set(pivot)) < 3300
    rows, leaf = C.route(C.fit_top(m, 500), m, 0.0)
    assert sorted(rows) == list(range(len(m))) and len(set(leaf)) > 4


def test_dense_tables_are_compared_in_blocks(spark):
    rng = np.random.default_rng(6)
    m = rng.poisson(3, (400, 12))
    df = vectors(spark, m)
    for limit in (4, 9):
        got = {(r["id"], r["cluster_id"]) for r in C.similarity_clusters(df, limit, 3, leaf_rows=30, sample_rows=100, task_rows=80).collect()}
        assert got == by_hand(m, limit, 3)


def test_bisecting_leaves(spark):
    df = vectors(spark, [[1, 1], [1, 2], [1, 1], [90, 90]])
    assert [tuple(r) for r in C.bisecting_leaves(df, 4).collect()] == [(0, 3, 1.0, "0,1")]
    assert C.bisecting_leaves(df.limit(0), 4).count() == 0


def test_descriptions_and_empty(spark):
    df = vectors(spark, [[1, 1], [1, 2], [1, 3], [90, 90]])
    rows = C.describe_clusters(df, C.similarity_clusters(df, 1, 3), 1).collect()
    assert [tuple(r) for r in rows] == [(0, 3, "1")]
    assert C.similarity_clusters(df.limit(0), 1).count() == 0


# --- names -----------------------------------------------------------------------
ENTRIES = [(1, "Quercus_alba", "QUAL", "Crannevium_alba", None), (2, "Acer_saccharum", "ACSA", None, "tall saxweed"), (3, "Athyrium_filix_femina", "ATFI", None, None), (4, "Solwenanthus_hirsutum", "SOHI", None, None), (5, "Solwenanthus_hirsuta", "SOHI2", None, None)]


@pytest.mark.parametrize(("typed", "ref"), [
    ("quercus alba", 1), ("Quercus  alba L.", 1), ("Q. alba", 1), ("qual", 1), ("alba (Quercus)", 1), ("alba, Quercus", 1), ("Quercus × alba", 1), ("Quercus alba var. minor", 1), ("Quercus cf. alba", 1), ("quercusalba", 1), ("Qurcus albba", 1), ("Crannevium alba", 1),
    ("Tall-saxweed", 2), ("Acer saccharum Merk. & Lunn", 2), ("Acr sacccharum", 2), ("Athyrium filix-femina", 3), ("Solwenanthus hirsuta", 5), ("Solwenanthus_hirsutum", 4),
    ("Quercus", 0), ("Quercus sp.", 0), ("Quercus spp", 0), ("Quercus rubra", 0), ("unknown", 0), ("dead wood", 0), ("moss indet.", 0), ("?", 0), ("x" * 5000, 0),
])
def test_lookup(typed, ref):
    assert Dictionary(ENTRIES).lookup(typed) == ref


def test_weighted_distance():
    assert weighted_distance("alba", "abla", 2) == 1 and weighted_distance("a1ba", "alba", 2) == 0.5 and weighted_distance("", "ab", 2) == 2 and weighted_distance("abcdef", "a", 2) > 2


def test_map_names(spark):
    rec = spark.createDataFrame([("t", 1, "Quercus_alba"), ("t", 2, "quercus alba"), ("t", 2, "quercus alba"), ("t", 3, None), ("t", 4, " \t"), ("t", 5, "nothing here")], "table_name string, record_id long, species string")
    ref = spark.createDataFrame(ENTRIES, "ref_id int, species string, short_code string, synonym string, vernacular string")
    assert {(r["record_id"], r["ref_id"]) for r in map_names(rec, ref).collect()} == {(2, 1), (5, 0)}
    assert map_names(rec.limit(0), ref).count() == 0
    assert {(r["record_id"], r["ref_id"]) for r in map_names(rec, ref, most_entries=2).collect()} == {(2, 1), (5, 0)}
    assert {r["ref_id"] for r in map_names(rec, ref.limit(0)).collect()} == {0}
    many = [("t", i, t) for i, t in enumerate(["Qurcus albba", "Q. alba", "tall saxweed", "QUAL", "Solwenanthus hirsutum", "nothing at all", "quercusalba"])]
    rec = spark.createDataFrame(many, rec.schema)
    assert sorted(map_names(rec, ref, most_entries=1).collect()) == sorted(map_names(rec, ref).collect())


def test_names_come_before_synonyms_and_short_names_are_looked_up():
    known = Dictionary([(1, "Alnus_rubra", None, "Quercus_alba", None), (2, "Quercus_alba", None, None, "1"), (3, "Poa_annua", "POAN", None, "Alnus rubra")])
    assert known.lookup("QUERCUS ALBA") == 2 and known.lookup("Poannua") == 3 and known.lookup("Alnus rubra") == 1 and known.lookup("Qu. alba") == 2 and known.lookup("poan") == 3
    assert known.lookup("Po annua") == 3 and known.lookup("Poa anua") == 3 and known.lookup("P. annuva") == 3


# --- packing -----------------------------------------------------------------------
def test_first_fit_decreasing_against_plain_search():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 37, 300):
        sizes = rng.integers(0, 101, n)
        room, want = [], np.zeros(n, int)
        for i in np.argsort(-sizes, kind="stable"):
            b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            room[b] -= sizes[i]
            want[i] = b
        assert first_fit_decreasing(sizes, 100).tolist() == want.tolist()


def test_pack(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(s)) for i, s in enumerate(rng.integers(1, 90, 400))] + [(900, 250), (901, 0), (902, 100), (902, 100), (903, 200), (None, 5)]
    df = spark.createDataFrame(rows, "key long, size long")
    out = pack(df, 100, group_rows=150).toPandas()
    assert out.groupby("sequence_id")["tokens"].sum().max() <= 100
    whole = out.groupby("key")["tokens"].sum().to_dict()
    assert all(whole[k] == s * (2 if k == 902 else 1) for k, s in rows if k is not None)
    assert out["tokens"].sum() / (out["sequence_id"].nunique() * 100) > 0.93
    assert sorted(out[out["key"] == 900]["tokens"]) == [50, 100, 100] and (out[out["key"] < 400].groupby("key").size() == 1).all()
    seq = out.sort_values(["sequence_id", "start"])
    assert (seq.groupby("sequence_id")["tokens"].cumsum() - seq["tokens"] == seq["start"]).all()
    assert pack(df.limit(0), 100).count() == 0
    assert pack_groups(df.where("key < 3").withColumn("grp", F.lit(1)), 100).count() == 3


# --- tokens and pieces -----------------------------------------------------------
TEXTS = ["", "a", "Hello  world,\n\n it's 42.\t x", "Bäume über  \r\n Öl — é 中文 🙂", "  lead", "x\n\n\ny   ", "\\section{A}~b% c", "a" * 3000, " ".join(map(str, range(500)))]


@pytest.mark.parametrize("text", TEXTS)
def test_counts_are_those_of_the_tokenizer(text):
    c = TokenCounter()
    assert c.count(text) == len(c._encode(text)) and "".join(c.pieces(text)) == text


def article(seed, n=60):
    r = random.Random(seed)
    w = ["moss", "canopy", "valley", "Nutrient", "supply", "rarely", "\\emph{plots}", "$x^2$", "soil,"]
    return "\n\n".join(" ".join(" ".join(r.choice(w) for _ in range(r.randint(5, 14))) + "." for _ in range(r.randint(1, 6))) for _ in range(n))


def test_pieces_rebuild_the_text_under_the_limit(spark):
    p, c = Split(96, 24, 12, 128), TokenCounter()
    texts = [article(1), article(2).replace("\n", "\r\n"), "word " * 4000, "é" * 2000, "z" * 5000, "short", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string").withColumn("text", F.lit("clash"))
    out = split_documents(df, "id", "body", p).toPandas().sort_values(["key", "piece"])
    assert set(out["key"]) == {0, 1, 2, 3, 4}
    for k, part in out.groupby("key"):
        assert "".join(t[a - s:] for t, s, a in zip(part["piece_text"], part["start"], part["core_start"])) == texts[k]
        assert max(c.count(t) for t in part["piece_text"]) <= 96 and part["tokens"].tolist() == [c.count(t) for t in part["piece_text"]]
        lap = [c.count(texts[k][s:a]) for s, a in zip(part["start"], part["core_start"])][1:]
        assert max(lap) <= 12 + 1
        assert k == 4 or k == 3 or min(lap) >= 6


def test_edits_alter_neighbouring_pieces_only():
    p, c, t = Split(96, 24, 0, 128), TokenCounter(), article(3, 200)
    edited = t[:5000] + " an inserted remark" + t[5000:]
    a = {t[s:e] for s, _, e, _ in split_text(t, c, p)}
    b = {edited[s:e] for s, _, e, _ in split_text(edited, c, p)}
    assert len(a) > 60 and len(b - a) <= 6


def test_cuts_lie_at_natural_boundaries():
    t, c = article(4, 200), TokenCounter()
    pieces = split_text(t, c, Split(96, 24, 12, 128))
    ends = [t[:e].rstrip(" ") for _, _, e, _ in pieces[:-1]]
    assert sum(x.endswith((".", "\n")) for x in ends) / len(ends) > 0.95


def test_landmarks_follow_the_text():
    t = article(5)
    a, b = landmarks(t, 64), landmarks("prefix " + t, 64)
    assert len(a) > len(t) / 256 and set(a[a > 40] + 7) <= set(b.tolist()) and len(landmarks("short", 8)) == 0


# --- leakage -----------------------------------------------------------------------
@pytest.mark.parametrize(("text", "want"), [
    ("Vari-\nance ~of  \\emph{soil}~moisture\\cite{a1,b2}.", "variance of soil moisture"), ("% a comment\n%% more-\n% over", "a comment moreover"), ("B\\\"aume {\\'e}t\\'{e} Stra\\ss e Größe \\c{c}a", "baume ete strasse grosse ca"),
    ("\\newcommand{\\ra}{relative abundance\\xspace}\\ra{} and \\ra\\ x", "relative abundance and relative abundance x"), ("\\def\\cc{canopy cover}the \\cc of", "the canopy cover of"), ("\\newcommand\\two[2]{#2 then #1}\\two{a}{b c}", "b c then a"), ("\\iffalse gone but counted\\fi", "gone but counted"),
    ("\\newcommand{\\x}{a", "a"), ("", ""), (None, ""),
    ("".join(f"\\newcommand{{\\m{a}}}{{\\m{b}}}" for a, b in zip("abcdef", "bcdefg")) + "\\newcommand{\\mg}{deep words}start \\ma end", "start deep words end"),
    ("\\newcommand{\\x}{one \\x two}a \\x b", "a one two b"), ("\\newcommand{\\w}[1]{<#1>}\\w{a \\w{b}} c", "a b c"), ("\\newcommand{\\x}{" + "word " * 2500 + "}\\x", " ".join(["word"] * 2500)),
])
def test_words(text, want):
    assert " ".join(words(text)) == want


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([8, 30, 60])))) for i in range(12)]
    docs = []
    for d in range(60):
        t = [r.choice(vocab) for _ in range(80)]
        w = r.choice(items)[1].split()
        n = r.randint(5, len(w))
        at = r.randint(0, len(w) - n)
        docs.append((d, " ".join(t[:40] + w[at:at + n] + t[40:])))
    docs += [(100, None), (101, ""), (None, items[2][1]), (102, "a"), (103, " ".join(["filler"] * 40_000) + " " + items[1][1])]

    def runs(doc, item, run):
        cover = set()
        for i in range(len(item) - run + 1):
            for j in range(len(doc) - run + 1):
                if doc[j:j + run] == item[i:i + run]:
                    cover.update(range(i, i + run))
        return len(cover)

    want = set()
    for d, t in docs:
        if d is not None and t:
            for i, x in items:
                w = x.split()
                if len(w) >= 12 and runs([y for y in t.split() if y != "filler"], w, 12) * 2 >= len(w):
                    want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id int, text string")
    for size, words_ in ((16 << 20, 1_500_000), (600, 500)):  # all items at once in one segment, and in several rounds over several segments
        got = {(x["key"], x["item"]) for x in leaked(df, "doc_id", "text", it, "item_id", "text", item_bytes=size, segment_words=words_).collect()}
        assert got == want and (103, 1) in got or not len(items[1][1].split()) >= 12
    assert leaked(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0


def test_proximity(spark):
    w = [f"w{i}" for i in range(40)]
    changed = w[:12] + ["new", "words"] + w[13:25] + w[27:]
    docs = [(1, " ".join(w)), (2, "before " + " ".join(changed)), (3, " ".join(w[:9] + ["x"] * 50 + w[9:18] + ["y"] * 50 + w[18:27])), (4, " ".join(reversed(w)))]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(w)), (None, "x"), (8, "too short")], "item_id int, text string")
    got = {(r["key"], r["covered"]) for r in leaked(df, "doc_id", "text", it, "item_id", "text", run=5, slop=10).collect()}
    assert got == {(1, 40), (2, 37)}
    assert {r["key"] for r in leaked(df, "doc_id", "text", it, "item_id", "text", run=5).collect()} == {1, 2, 3}


def test_overgrown_macros_are_reported(spark):
    bomb = "".join(f"\\newcommand{{\\m{a}}}{{" + f"\\m{b}" * 9 + "}" for a, b in zip("abcdefghijkl", "bcdefghijklm")) + "\\newcommand{\\mm}{soil} start \\ma end"
    df = spark.createDataFrame([(1, bomb), (2, "\\newcommand{\\x}{y}\\x"), (3, None)], "doc_id long, text string")
    assert [r["key"] for r in overgrown(df, "doc_id", "text").collect()] == [1] and words(bomb)[-2:] == ["start", "end"]


def test_queries_are_registered():
    import __spark_entry__ as E

    assert {"p2_found", "p5_found", "p6_found", "p7_sequences", "p8_found", "p9_pieces"} <= set(E.queries())
