"""Small frames with rows worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.operators import dedup, distill, frame, graph, lifecycle, mining, prepare, retrieve, sensitive, tagstats, windows
from corpusgraph.sources import corpus, sinks


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_builder_refuses(spark):
    q = frame.query(spark.range(5).toDF("id"))
    for bad in (lambda: q.limit(0), lambda: q.limit(True), lambda: q.where("id; drop", "=", 1), lambda: q.select("a b")):
        with pytest.raises(ValueError):
            bad()
    assert q.where("id", "??", 3).to_df().count() == 1


def test_sort_nulls(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "x int")
    assert [r.x for r in frame.sort_rows(df, "x").collect()] == [None, 1, 2]
    assert [r.x for r in frame.sort_rows(df, "x", "desc").collect()] == [2, 1, None]
    assert [r.x for r in frame.query(df).order_by("x").to_df().collect()] == [1, 2, None]
    assert [r.x for r in frame.query(df).order_by("x", "DESC").to_df().collect()] == [None, 2, 1]


def test_vectorized(spark):
    double = frame.vectorized(lambda s: s * 2, "long")
    assert [r.y for r in frame.transform_cols(spark.range(3), {"y": double("id")}).orderBy("id").collect()] == [0, 2, 4]


def test_vectorized_agg(spark):
    spread = frame.vectorized_agg(lambda v: float(v.max() - v.min()), "double")
    assert frame.agg_all(spark.range(5), {"s": spread("id")}).first().s == 4.0


@pytest.mark.parametrize(
    "ranges, expected",
    [([(0, 50), (100, 150), (1000, 1050)], [(0, 150), (1000, 1050)]), ([(0, 900), (10, 20), (1000, 1050)], [(0, 1050)]), ([(0, 50), (551, 560)], [(0, 50), (551, 560)]), ([], [])],
)
def test_coalesce(spark, ranges, expected):
    df = spark.createDataFrame([(1, a, b, 1.0, 0, ["t"]) for a, b in ranges], "compound_id long, start_byte long, end_byte long, score double, ts long, tags array<string>")
    assert sorted((r.start_byte, r.end_byte) for r in windows.coalesce_by_proximity(df).collect()) == expected


def test_coalesce_caps(spark):
    df = spark.createDataFrame([(1, i * 10_000, i * 10_000 + 5, float(i), 0, [f"t{j}" for j in range(20)]) for i in range(30)], "compound_id long, start_byte long, end_byte long, score double, ts long, tags array<string>")
    rows = windows.coalesce_by_proximity(df, most=10).collect()
    assert len(rows) == 3 and all(len(r.tags) == 15 for r in rows) and max(r.score for r in rows) == 29


def test_sessions(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 01:00:00", "2024-01-01 02:00:01"]
    df = spark.createDataFrame([("a", t, "x", i) for i, t in enumerate(times)], "s string, t string, tag string, i long").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.n for r in windows.session_clusters(df, "s", "t", "tag", "i").collect()) == [1, 2]


def test_budget_and_radius(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 4, 3])], "g int, i int, n int")
    assert windows.budget_prefix(df, ["g"], ["i"], F.col("n"), 9).count() == 2
    rows = windows.progressive_radius(spark.range(20).withColumn("g", F.lit(1)), ["g"], ["id"], 100).groupBy("radius").count().collect()
    assert {r.radius: r["count"] for r in rows} == {200.0: 2, 150.0: 8, 100.0: 10}


@pytest.mark.parametrize("shared, hop, bits, bonus, expected", [(5, 1, 0, 0, 0.425), (5, 2, 32, 0, 0.180625), (0, 1, 0, 1, 0.1), (20, 1, 0, 0, 1.0)])
def test_gravity(spark, shared, hop, bits, bonus, expected):
    got = spark.range(1).select(graph.gravity(F.lit(shared), F.lit(hop), F.lit(bonus), F.lit(0.0), F.lit(bits), 0.85, 1e-5)).first()[0]
    assert got == pytest.approx(expected)


def test_walk_leaves_out_anchors(spark):
    tags = spark.createDataFrame([("a", "t"), ("b", "t"), ("b", "u"), ("c", "u")], "node_id string, tag string")
    nodes = spark.createDataFrame([(n, dt.datetime(2024, 1, 1), 0, n, 0, 5) for n in "abc"], "node_id string, ts timestamp, simhash long, compound_id string, start_byte long, end_byte long")
    anchors = spark.createDataFrame([(1, "a")], "query_id int, node_id string")
    rows = graph.gravity_walk(anchors, nodes, tags, threshold=0.0).collect()
    assert [(r.node_id, r.hop) for r in rows] == [("b", 1)]
    assert {(r.node_id, r.hop) for r in graph.bfs_tags(anchors, tags, 3).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.gravity_walk(anchors.limit(0), nodes, tags).count() == 0


@pytest.mark.parametrize("profile", sorted(graph.PROFILES))
def test_near_nodes_are_one_hop_away(spark, profile):
    """A node that lies near the anchor and shares no tag is as far away as one that shares a tag, in every profile."""
    tags = spark.createDataFrame([("a", "t"), ("b", "t"), ("b", "u"), ("c", "u")], "node_id string, tag string")
    nodes = spark.createDataFrame([(n, dt.datetime(2024, 1, 1), 0, n if n == "b" else "x", 0, 5) for n in "abc"], "node_id string, ts timestamp, simhash long, compound_id string, start_byte long, end_byte long")
    rows = graph.gravity_walk(spark.createDataFrame([(1, "a")], "query_id int, node_id string"), nodes, tags, profile, threshold=0.0).collect()
    assert {(r.node_id, r.hop) for r in rows} == {("b", 1), ("c", 1)}


def test_walk_over_hubs(spark):
    from types import SimpleNamespace

    from corpusgraph.plans import retrieval_queries

    docs = [(0, "zebra common shared", "s"), *[(i, f"common shared {'x' * (i % 7 + 1)}", "s") for i in range(1, 2101)]]
    t = SimpleNamespace(documents=spark.createDataFrame(docs, "doc_id long, text string, source string"), benchmark=spark.createDataFrame([(1, "zebra")], "item_id long, text string"))
    rows = retrieval_queries.star_search(t).collect()
    assert [r.node_id for r in rows if r.via == "anchor"] == ["0:0"]
    assert len([r for r in rows if r.via == "walk"]) == 10


@pytest.mark.parametrize("rows", [graph.ANCHOR_ROWS, 0])
def test_walk_counts(spark, monkeypatch, rows):
    import random

    monkeypatch.setattr(graph, "ANCHOR_ROWS", rows)
    rng = random.Random(3)
    own = {f"n{i}": {t for t in range(8) if rng.random() < 0.9 / (t + 1) + 0.1} for i in range(120)}
    own["n5"] = set()  # only near others
    tags = spark.createDataFrame([(n, str(t)) for n, ts in own.items() for t in ts for _ in range(1 + t % 2)], "node_id string, tag string")
    nodes = spark.createDataFrame([(n, dt.datetime(2024, 1, 1), 0, n[:2], i * 300, i * 300 + 5) for i, n in enumerate(own)], "node_id string, ts timestamp, simhash long, compound_id string, start_byte long, end_byte long")
    starts = [(q, f"n{rng.randrange(120)}") for q in range(4) for _ in range(3)] + [(9, "n5"), (8, "n5")]
    anchors = spark.createDataFrame(starts, "query_id int, node_id string")
    at = {n: i * 300 for i, n in enumerate(own)}
    for least in (0.0, 0.1):
        want = {}
        for q, a in sorted(set(starts)):
            for n in own:
                if (q, n) in starts:
                    continue
                both, close = len(own[a] & own[n]), n[:2] == a[:2] and abs(at[n] - at[a]) <= 1005
                score = round(min(1.0, both / 10 * 0.85 + 0.1 * close), 6)
                if score > least and score > want.get((q, n), (0,))[0]:
                    want[q, n] = score, a, both
        got = graph.gravity_walk(anchors, nodes, tags, threshold=least, k=1000)
        assert {(r.query_id, r.node_id): (pytest.approx(r.score), r.best_anchor, r.shared) for r in got.collect()} == want


def _hit(node, compound, a, b, text, score, day=1, query=1):
    return query, node, compound, a, b, f"src/{compound}.md", text, dt.datetime(2024, 1, day), score


HIT = "query_id int, node_id string, compound_id string, start_byte long, end_byte long, source string, content string, ts timestamp, score double"


def test_format_results(spark):
    first, second = "alpha words gather slowly here", "alpha words gather slowly again"
    rows = [
        _hit("aaaaaaaaaa", "d1", 0, 10, "one", 0.5, 3), _hit("b", "d1", 400, 410, "two", 0.9, 2), _hit("c", "d1", 911, 920, first + " #tag", 0.4, 4),
        _hit("d", "d2", 0, 30, second, 0.3, 1), _hit("e", "d2", 0, 30, "", 0.2, 1, query=2),
    ]
    documents = spark.createDataFrame([("d1", "x" * 911 + "other text"), ("d2", second)], "doc_id string, text string")
    now = F.lit("2024-01-04 00:00:00").cast("timestamp")
    shown = retrieve.format_results(spark.createDataFrame(rows, HIT), now, documents=documents).orderBy("query_id", "place").collect()
    assert len(shown) == 4
    own = [r for r in shown if r.query_id == 1]
    assert [(r.place, r.start_byte, r.end_byte, r.n_atoms) for r in own] == [(1, 0, 30, 1), (2, 0, 410, 2), (3, 911, 920, 1)]
    assert own[1].snippet.startswith('[GROUP:2] [File:d1.md] [Range: 0x0000-0x019A] [Time: 2024-01-02T00:00:00.000Z] [Atoms: 2] [Chars: 410]\n<atom id="aaaaaaaa,b" relevance="0.900" ')
    plain = retrieve.format_results(spark.createDataFrame(rows, HIT), now, coalesce=False)
    assert sorted(r.node_ids[0] for r in plain.collect() if r.query_id == 1) == ["aaaaaaaaaa", "b", "c"]  # d shares its words with c
    stats = {r.query_id: r for r in retrieve.budget_stats(plain, 100).collect()}
    assert stats[1].content_chars == 3 + 3 + len(first) and stats[1].total_chars == stats[1].content_chars + stats[1].overhead_chars and stats[2].content_chars == 0
    assert retrieve.format_results(spark.createDataFrame([], HIT), now).count() == 0


def test_snippets_caps(spark):
    rows = [_hit(f"n{i}", "d1", i * 1000, i * 1000 + 10, f"t{i}", i / 10) for i in range(6)] + [_hit("m", "d2", 0, 5, "m", 0.01)]
    got = retrieve.snippets(spark.createDataFrame(rows, HIT), most=30).collect()
    assert sorted(r.node_ids[0] for r in got) == ["m", "n3", "n4", "n5"]  # three of a document
    assert sorted(r.node_ids[0] for r in retrieve.snippets(spark.createDataFrame(rows, HIT), most=2).collect()) == ["n4", "n5"]


def test_suggest_contained_tags(spark):
    nodes = spark.createDataFrame([(1, "Memory graphs keep notes"), (2, "nothing fits"), (3, None)], "node_id int, content string")
    tags = spark.createDataFrame([(9, "#memory"), (9, "#knowledge-graphs"), (1, "#notes"), (9, "#notes"), (9, "#keepsake")], "node_id int, tag string")
    got = {(r.node_id, r.tag, r.confidence) for r in mining.suggest_tags(nodes, tags, contained=True).collect()}
    assert got == {(1, "#memory", 0.8), (1, "#knowledge-graphs", 0.3), (1, "#keepsake", 0.3)}


def test_distill(spark):
    docs = spark.createDataFrame([(1, "User: Hi\n\nbye", "s"), (2, "hi", "t"), (3, " HI ", "u")], "doc_id long, text string, source string")
    rows = {r.content: r.n for r in distill.distill_lines(docs).collect()}
    assert rows == {"User: Hi": 3, "bye": 1}
    assert distill.distill_stats(docs).first().ratio == "2.00:1"
    assert distill.distill_stats(docs.limit(0)).first().total == 0
    assert distill.distill_lines(docs, strict=False).count() == 4


@pytest.mark.parametrize("n, tier", [(50, "light"), (5, "medium"), (4, "heavy")])
def test_density_tier(spark, n, tier):
    assert spark.range(1).select(tagstats.tier(F.lit(n))).first()[0] == tier


def test_dates(spark):
    inputs = ["on 2025-01-24 it", "2025/1/2", "01/24/2025", "Jan 24, 2025", "January 24th, 2025", "2025-13-32", "", "x" * 6000 + " 2025-01-24"]
    day = dt.date(2025, 1, 24)
    assert values(spark, T.first_date, inputs) == [day, dt.date(2025, 1, 2), day, day, day, None, None, None]


def test_text_expressions_reads_whole_text(spark):
    from types import SimpleNamespace

    from corpusgraph.plans import retrieval_queries

    rows = [(1, "x" * 6000 + " 2025-01-24", "s"), (2, "Jan 2, 2024 " + "word " * 1200 + "2025-01-24", "s"), (3, "none", "s")]
    t = SimpleNamespace(documents=spark.createDataFrame(rows, "doc_id long, text string, source string"))
    day = dt.date(2025, 1, 24)
    assert {r.doc_id: r.date for r in retrieval_queries.text_expressions(t).select("doc_id", "date").collect()} == {1: day, 2: day, 3: None}


def test_text_expressions(spark):
    assert values(spark, lambda x: T.content_terms(T.words(x)), ["The quick fox", "the of"]) == [["quick", "fox"], ["the", "of"]]
    assert values(spark, T.expand_camel, ["findAnchors", "HTMLParser"]) == [["findanchors", "find", "anchors"], ["htmlparser", "html", "parser"]]
    assert values(spark, T.strip_opening, ["tell me about star maps", "Show me find x"]) == ["star maps", "x"]
    assert values(spark, T.conversational_rewrites, ["What is the latest news", "hello"]) == [["news"], []]
    assert values(spark, T.query_intent, ["I feel sad", "when was it", "a fact"]) == ["emotional", "temporal", "factual"]
    assert values(spark, lambda x: T.truncate_sentence(x, 20), ["Short.", "One two three. Four five six seven"]) == ["Short.", "One two three...."]
    assert values(spark, T.normalize_tag, ["rust", "##AI", "x", "y" * 60]) == ["#Rust", "#AI", None, None]
    assert values(spark, T.is_noise_tag, ["#fff", "#12", "#href", "#Project", "#a1234567"]) == [True, True, True, False, True]
    assert values(spark, lambda x: T.numeric_value(x)["value"], ["1,500 PSI", "in 1999", "7 and 15%", ""]) == [1500.0, None, 15.0, None]
    assert values(spark, lambda x: T.temporal_years(x, F.lit(2025)), ["last 2 years", "from 2020 to 2022", "none"]) == [[2023, 2024, 2025], [2020, 2021, 2022], []]
    assert values(spark, T.time_drift_label, [5.0, 120.0, 3000.0, 90000.0, 1100000.0], "double") == ["5m ago", "2h ago", "2d ago", "2mo ago", "2y ago"]
    assert values(spark, lambda x: T.hamming(x, F.lit(0).cast("long")), [0, 1, -1, None], "long") == [0, 1, 64, 64]


def test_sanitize_and_transient(spark):
    got = values(spark, prepare.sanitize, ["a@b.com from 10.0.0.1\r\nok", "<|user|>hi score: 0.5", "x\n\n\n\ny"])
    assert got == ["[EMAIL_REDACTED] from [IP_REDACTED]\nok", "hi", "x\n\ny"]
    log = "Traceback (most recent call last)\nKeyError: x\nTypeError: y\nnpm install z\nfine"
    docs = spark.createDataFrame([(1, log), (2, "KeyError: x\nshort"), (3, "a\nb\nc\nd\ne")], "doc_id long, text string")
    assert sorted(r.doc_id for r in prepare.drop_transient(docs).collect()) == [2, 3]
    paths = spark.createDataFrame([("out/distilled_1.md",), ("MASTER_DISTILLED_x.md",), ("notes.md",)], "path string")
    assert [r.path for r in prepare.drop_self_output(paths).collect()] == ["notes.md"]


def test_clean(spark):
    page = "<html><nav>menu</nav><script>x</script><p>caf&eacute; &amp; &#233;</p>\r\n\r\n\r\n\r\n<b>z</b></html>"
    assert values(spark, lambda x: prepare.clean_text(x, unicode=True), [page, None]) == ["café & é \n\n z", None]


@pytest.mark.parametrize("kind", ["prose", "data"])
def test_byte_slices(spark, sf, kind):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    mols = prepare.split_molecules(docs, kind=kind).join(docs, "doc_id")
    wrong = mols.filter(retrieve.byte_slice(F.col("text"), F.col("start_byte"), F.col("end_byte")) != F.col("content"))
    assert mols.count() > 0 and wrong.count() == 0


def test_split_code(spark):
    code = "function a() {\n\n  x\n}\n\nfunction b() {}\n"
    docs = spark.createDataFrame([(1, code), (2, None), (3, "")], "doc_id long, text string")
    rows = prepare.split_code(docs).orderBy("doc_id", "seq").collect()
    assert ["".join(r.content.split()) for r in rows] == ["functiona(){x}", "functionb(){}"]
    assert all(code.encode()[r.start_byte : r.end_byte].decode() == r.content for r in rows)


def test_greedy_dedup(spark):
    rows = spark.createDataFrame(
        [(1, "c", "a", 0, 100, 0.9), (1, "c", "b", 50, 150, 0.8), (1, "c", "d", 5000, 5100, 0.1)], "query_id int, compound_id string, node_id string, start_byte long, end_byte long, score double"
    )
    assert sorted(r.node_id for r in dedup.dedup_geometric(rows).collect()) == ["a", "d"]
    texts = spark.createDataFrame([(1, "a", "alpha bravo charlie delta", 0.9), (1, "b", "alpha bravo charlie echos", 0.8), (1, "c", "other words stand here", 0.7)], "query_id int, node_id string, content string, score double")
    assert sorted(r.node_id for r in dedup.dedup_word_overlap(texts).collect()) == ["a", "c"]


def test_near_duplicates_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + base[:5]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, simhash long")
    pairs, members = dedup.near_duplicates(df, 3)
    rep = {}
    for i, p in enumerate(prints):
        rep.setdefault(p, i)
    want = {(min(a, b), max(a, b)) for x, a in rep.items() for y, b in rep.items() if a < b and bin(x ^ y).count("1") <= 3}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    assert members.count() == len(prints)


def test_near_duplicates_far(spark):
    import random

    rng = random.Random(6)
    base = [rng.getrandbits(63) for _ in range(20)]
    prints = base + [b ^ sum(1 << (8 * i + rng.randrange(7)) for i in range(8)) for b in base] + [b ^ sum(1 << i for i in rng.sample(range(63), 9)) for b in base]
    pairs, _ = dedup.near_duplicates(spark.createDataFrame(list(enumerate(prints)), "doc_id long, simhash long"), 8)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if bin(prints[i] ^ prints[j]).count("1") <= 8}
    assert len(want) >= 20 and {(r.a, r.b) for r in pairs.collect()} == want


@pytest.mark.parametrize("distance", range(9))
def test_near_duplicates_every_distance(spark, distance):
    """Every pair once: random prints, prints that differ in few bits of one block or of all, the sign bit, copies."""
    import random

    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(25)] + [0, (1 << 64) - 1, 1 << 63]
    prints = base + [b ^ sum(1 << i for i in rng.sample(range(*rng.choice([(0, 64), (0, 21), (32, 64), (50, 64)])), rng.randrange(0, 10))) for b in base for _ in range(6)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = [(r.a, r.b, r.distance) for r in dedup.near_duplicates(spark.createDataFrame(list(enumerate(signed)), "doc_id long, simhash long"), distance)[0].collect()]
    rep = {p: i for i, p in reversed(list(enumerate(prints)))}
    want = {(min(a, b), max(a, b), (x ^ y).bit_count()) for x, a in rep.items() for y, b in rep.items() if a < b and (x ^ y).bit_count() <= distance}
    assert len(found) == len(set(found)) and set(found) == want


def test_simhash_synonyms_brute_force(spark):
    import collections
    import random

    from corpusgraph.operators import mining

    rng = random.Random(8)
    words = [f"word{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    texts = [" ".join(rng.sample(words, rng.choice([3, 30, 60]))) for _ in range(12)]
    texts += texts[:4]
    prints = [(0b1 << 40), (0b1 << 40) | 0xFF, 1 << 50 | 0xFFF << 20]
    docs = [(i, x, rng.choice(prints)) for i, x in enumerate(texts)]
    count = collections.Counter()
    for i, x, p in docs:
        for j, y, q in docs[i + 1 :]:
            if bin(p ^ q).count("1") <= 8:
                count.update((min(v, w), max(v, w)) for v in set(x.split()) - set(y.split()) for w in set(y.split()) - set(x.split()))
    df = spark.createDataFrame(docs, "doc_id long, text string, simhash long")
    got = mining.synonyms_by_simhash(df.select("doc_id", "simhash"), df, k=1000)
    assert max(len(x.split()) for x in texts) == 60 and {(r.a, r.b): r.n for r in got.collect()} == count


def test_rings_by_simhash(spark, sf):
    from types import SimpleNamespace

    from corpusgraph.plans import graph_queries

    text = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma omega upsilon "
    documents = spark.createDataFrame([(1, text * 3 + "quick", "s"), (2, text * 3 + "rapid", "s")], "doc_id long, text string, source string")
    t = SimpleNamespace(documents=documents, lineitem=spark.read.parquet(f"{sf}/lineitem.parquet").limit(0))
    got = {(r.term, r.synonym) for r in graph_queries.synonym_rings(t).collect() if r.strategy == "simhash"}
    assert got == {("quick", "rapid"), ("rapid", "quick")}


def test_searches_with_synonyms(spark):
    from types import SimpleNamespace

    from corpusgraph.plans import retrieval_queries

    texts = ["Quick rapid river."] * 5 + ["Quick stone.", "Rapid water."]
    documents = spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], "doc_id long, text string, source string")
    benchmark = spark.createDataFrame([(1, "quick"), (2, "stone")], "item_id long, text string")
    t = SimpleNamespace(documents=documents, benchmark=benchmark)
    pairs = {(r.term, r.synonym) for r in retrieval_queries.synonym_table(t).collect()}
    assert {("quick", "rapid"), ("rapid", "quick"), ("quick", "river")} <= pairs
    want = {}
    for q, own in ((1, "quick"), (2, "stone")):
        other = sorted(y for x, y in pairs if x == own)[:5]
        for d, x in enumerate(texts):
            shares = [7000.0] * (own in x.lower()) + [3000.0 / len(other) for y in other if y in x.lower()[:-1].split()]
            if shares:
                want[q, d] = len(shares), pytest.approx((max(shares) + 0.2 * (sum(shares) - max(shares))) / 10_000, abs=2e-6)
    got = {(r.query_id, r.node_id): (r.hits, r.score) for r in retrieval_queries.distributed_search_synonyms(t).collect()}
    assert (1, 6) in got and got == want
    found = {(r.query_id, r.term, r.score) for r in retrieval_queries.expand_queries_synonyms(t).collect() if r.kind == "synonym"}
    assert found == {(q, y, 5) for q, own in ((1, "quick"), (2, "stone")) for x, y in pairs if x == own}


def test_sensitive(spark):
    docs = spark.createDataFrame([(1, "mail bob.smith@example.com now, 123-45-6789 password=abcdefgh12"), (2, None), (3, "")], "doc_id long, text string")
    text = docs.first().text
    rows = sensitive.scan_sensitive(docs).collect()
    assert {r.type for r in rows} == {"EMAIL", "SSN", "PASSWORD"}
    assert {text[r.start : r.end] for r in rows} == {"bob.smith@example.com", "123-45-6789", "abcdefgh12"}
    own = sensitive.matches(docs, [("NUMBER", "[0-9]{2}", 0, 0.0)])
    assert own.count() == 5
    assert values(spark, sensitive.shannon_entropy, ["aabb", "", "abcd"]) == [1.0, 0.0, 2.0]


def test_lifecycle(spark):
    nodes = spark.createDataFrame([(1, "internal", ["#a"]), (2, "internal", ["#b"])], "node_id long, provenance string, tags array<string>")
    ids = spark.createDataFrame([(1,)], "node_id long")
    held = lifecycle.quarantine(nodes, ids)
    assert [(r.provenance, r.tags) for r in held.orderBy("node_id").collect()] == [("quarantine", ["#a", "#manually_quarantined"]), ("internal", ["#b"])]
    assert {tuple(r.tags) for r in lifecycle.restore_quarantined(held, ids).collect()} == {("#a",), ("#b",)}
    assert lifecycle.delete_quarantined(held, nodes).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "inbox" / "notes").mkdir(parents=True)
    (tmp_path / "inbox" / "notes" / "a.md").write_text("hello")
    (tmp_path / "inbox" / "notes" / "b.bin").write_text("no")
    (tmp_path / "empty.txt").write_text("")
    rows = corpus.with_source_metadata(corpus.read_corpus(spark, str(tmp_path))).collect()
    assert [(r.text, r.bucket, r.kind, r.provenance) for r in rows] == [("hello", "notes", "md", "internal")]
    long = "w " * 80
    (tmp_path / "chat.jsonl").write_text('{"type":"user","message":{"parts":[{"text":"%s"},{"text":"x","thought":true}]}}\nnot json\n{"type":"telemetry","content":"t"}\n{"role":"assistant","content":"yes"}\n' % long)
    chat = corpus.read_chat_jsonl(spark, str(tmp_path / "chat.jsonl")).first().text
    assert chat == f"[User]: {long}\n\n[Assistant]: yes"


def test_chunks(spark):
    docs = spark.createDataFrame([("p", "ab\n" * 100), ("q", "short"), ("r", None)], "path string, text string")
    rows = corpus.pack_lines_into_chunks(docs, over=100, target=60).collect()
    assert "".join(r.content for r in sorted(rows, key=lambda r: r.chunk) if r.path == "p") == "ab\n" * 100
    assert max(len(r.content) for r in rows) <= 60 and any(r.virtual_path == "p#chunk-002" for r in rows)


@pytest.mark.parametrize("fmt", ["csv", "json", "yaml", "parquet", "table"])
def test_sinks(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'a "quoted", b', ["x"]), (2, None, None)], "i int, s string, t array<string>")
    sinks.write_results(df, str(tmp_path / fmt), fmt)
    if fmt == "csv":
        assert sorted((r.i, r.s) for r in spark.read.option("escape", '"').csv(str(tmp_path / fmt), header=True).collect())[0] == ("1", 'a "quoted", b')
    with pytest.raises(ValueError):
        sinks.write_results(df, str(tmp_path / "x"), "toml")


def test_commits(spark):
    rows = spark.createDataFrame([("r", "abcdef123", "ann", dt.datetime(2024, 1, 1), "first"), ("r", "fedcba321", "bob", dt.datetime(2024, 2, 1), "second")], "repo string, sha string, author string, ts timestamp, message string")
    text = prepare.commit_log_documents(rows).first().document
    assert text.index("second") < text.index("first") and text.startswith("# r")
