"""Names, categories, components, near-duplicate blocks and related tags on small frames, against plain versions."""

import math
import random
from collections import Counter, defaultdict

import pytest

from corpusgraph.operators import categories, dedup, distill, mining

DOCS = "doc_id long, text string"


def test_named_entities(spark):
    docs = [
        (1, "Today we saw Anna Berg and the Oak Street market in 1999."),
        (2, "Yesterday they met Anna Berg near Oak Street, and NATO, with sql."),
        (3, "Anna Berg left. Weather was fine. The Weather too."),  # a name at the beginning; Weather never stands inside
        (4, "They greeted Dr. Place in May. By then NATO, and May was over."),
        (5, "a Single hit"), (6, None), (7, ""), (8, "Ask Place about it"),
    ]
    found = {(r.doc_id, r.entity): (r.kind, r.tag) for r in categories.named_entities(spark.createDataFrame(docs, DOCS)).collect()}
    assert {k: v[0] for k, v in found.items()} == {
        (1, "Anna Berg"): "person", (1, "Oak Street"): "place", (1, "1999"): "date", (2, "Anna Berg"): "person", (2, "Oak Street"): "place", (2, "NATO"): "concept", (2, "sql"): "technical",
        (3, "Anna Berg"): "person", (4, "NATO"): "concept", (4, "Place"): "person",
    } | ({(4, "May"): "date"} if (4, "May") in found else {})
    assert (5, "Single") not in found and found[(4, "Place")][1] == "entity:place"


def test_derived_categories(spark):
    docs = spark.createDataFrame([(1, "He met them, but no sale"), (2, "quiet"), (3, "User: hi\nAssistant: yes"), (4, "run `x` today"), (5, None), (6, ""), (7, "HAPPY day"), (8, "met, secretly")], DOCS)
    entities = spark.createDataFrame([(1, "A", "person"), (2, "B", "person"), (2, "C", "person"), (2, "C", "person"), (4, "D", "person"), (5, "E", "technical"), (7, "F", "person"), (8, "G", "person"), (None, "H", "person"), (99, "I", "person")], "doc_id long, entity string, kind string")
    rules = [categories.Rule("#Met", ["met"], ["person", "place"], ["secret"]), categories.Rule("#Joy", ["happy"]), categories.Rule("#Met", ["a.b", "quiet"], ["place"])]
    got = defaultdict(set)
    for r in categories.derived_categories(docs, entities, rules).collect():
        got[r.doc_id].add(r.category)
    assert got == {1: {"#Met"}, 2: {"#Relationship"}, 3: {"#Narrative"}, 4: {"#Narrative", "#Code"}, 5: {"#Technical"}, 7: {"#Joy"}}
    assert [r.doc_id for r in categories.related_by_category(categories.derived_categories(docs, entities, rules), entities, ["b", "C"]).collect()] == [2]
    assert categories.derived_categories(docs.limit(0), entities).count() == 0


@pytest.mark.parametrize("kind", ["chain", "ordered", "star", "random", "none"])
def test_components(spark, kind):
    r = random.Random(7)
    ids = list(range(300))
    r.shuffle(ids)
    pairs = {"ordered": list(zip(range(299), range(1, 300))), "chain": list(zip(ids, ids[1:])), "star": [(ids[0], i) for i in ids[1:]], "random": [(r.choice(ids), r.choice(ids)) for _ in range(180)], "none": []}[kind]
    pairs = [(a, b) for a, b in pairs if a != b]
    root = {n: n for p in pairs for n in p}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(root[a], root[b])
            moved |= (root[a], root[b]) != (low, low)
            root[a] = root[b] = low
    got = dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {x.node: x.root for x in got} == root and len(got) == len(root)


def test_distill_tags_near(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    docs = spark.createDataFrame([(1, "s", f"{text}\nshared"), (2, "s", f"{text}\nShared"), (3, "t", "other words\nshared"), (4, "t", "!!!"), (5, "s", "!!!"), (6, "s", None), (7, "t", "")], "doc_id long, source string, text string")
    tags = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, "y"), (4, "z"), (5, "w"), (6, "v"), (7, "v")], "doc_id long, tag string")
    assert {tuple(r) for r in dedup.near_blocks(docs).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7)}
    got = {r.tag: tuple(r)[1:] for r in distill.distill_tags_near(docs, tags).select("tag", "blocks", "kept", "total", "unique_lines").collect()}
    assert got == {"x": (1, 1, 2, 2), "y": (2, 2, 4, 3), "z": (1, 1, 1, 1), "w": (1, 1, 1, 1), "v": (2, 2, 0, 0)}


def test_related_tags(spark):
    r = random.Random(5)
    rows = [(n, t) for n in range(60) for t in "abcdefgh" if r.random() < (0.5 if (n % 2) == (ord(t) % 2) else 0.15)]
    rows += rows[:20]
    tags = spark.createDataFrame(rows, "node_id long, tag string")
    own = set(rows)
    uses, nodes, held = Counter(t for _, t in own), len({n for n, _ in own}), defaultdict(set)
    for n, t in own:
        held[t].add(n)
    want = []
    for a in held:
        lifts = sorted((-len(held[a] & held[b]) * nodes / (uses[a] * uses[b]), b) for b in held if a != b and len(held[a] & held[b]) >= 2)
        want += [(a, b, len(held[a] & held[b]), round(math.log(-x), 6)) for x, b in [p for p in lifts if p[0] < -1][:3]]
    assert sorted(tuple(x) for x in mining.related_tags(tags, None, 2, 3).collect()) == sorted(want)
    asked = mining.named_tags(spark.createDataFrame([(1, "A or b"), (2, "none"), (3, None)], "query_id long, query string"), tags)
    assert sorted(map(tuple, asked.collect())) == [(1, "a"), (1, "b")]
    best = sorted({b: max(p for x, y, _, p in want if y == b and x in "ab") for x, b, _, _ in want if x in "ab" and b not in "ab"}.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert sorted(x.term for x in mining.expand_related(asked, tags, 2, 3).collect()) == sorted(b for b, _ in best)
