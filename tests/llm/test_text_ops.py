"""BPE, language, n-grams, chat, quality, secrets and decontamination against brute force, round trips and held-out accuracy."""

import collections
import contextlib
import functools
import hashlib
import io
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusgraph.llm import bpe, chat, decontaminate, language, ngram, quality, secrets
from corpusgraph.llm.common import text_bytes
from corpusgraph.llm.elias_fano import EliasFano

EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (4, "One two"), (None, "one two three"), (5, "x " * 30_000), (6, "éß 中文 😀 it's 're''s\r\n\u00a0 end  "), (7, "\x00\x01 <|endoftext|> </s>")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", -1.0) for i, t in rows], "doc_id long, text string, ids string, score double")


# --- BPE --------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40), max_size=6))
def test_pre_tokens(texts):
    import public_tokenizers
    import regex

    data, offsets = text_bytes(pa.array(texts, pa.string()))
    at, first = bpe.pre_tokens(data, offsets)
    raw = data.tobytes()
    for i, text in enumerate(texts):
        assert [raw[at[k] : at[k + 1]].decode() for k in range(first[i], first[i + 1])] == regex.findall(public_tokenizers.PATTERN, text)


@pytest.mark.parametrize("block", [bpe.BLOCK_BYTES, 50])
def test_bpe(spark, sf, block):
    rows = EDGE + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40").collect()]
    encoder = bpe._encoder(bpe.ranks_path())
    want = sorted(((i, encoder.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    got = [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), bytes(r.decoded)) for r in bpe.encode_decode(frame(spark, rows), block_bytes=block).collect()]
    assert sorted(got, key=str) == want
    assert bpe.encode_decode(frame(spark, rows).limit(0)).count() == 0


def test_bpe_with_other_blocks(spark):
    """A block whose words were numbered otherwise is still encoded right."""
    text = pa.table({"doc_id": pa.array([1], pa.int64()), "text": ["hello wide world"]})
    docs = next(bpe._packed()(text.to_batches()))
    none = pa.table({c: pa.array([], pa.binary()) for c in ("hashes", "sizes", "wide", "ids")})
    out = next(bpe._reassemble(bpe.ranks_path())(pa.Table.from_batches([docs]), none))
    assert bytes(out.column("decoded")[0].as_py()) == b"hello wide world"


def test_bpe_when_words_share_a_hash(spark, monkeypatch):
    """Whatever hashes say, a word's tokens decode to that word."""
    rows = [(1, "same hash for every word"), (2, "other words; the same hash")]
    packed = [b for r in rows for b in bpe._packed()(pa.table({"doc_id": pa.array([r[0]], pa.int64()), "text": [r[1]]}).to_batches())]
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    words = list(bpe._distinct_words()(pa.table({"doc_id": pa.array([1], pa.int64()), "text": [rows[0][1]]}).to_batches()))
    assert sum(b.num_rows for b in words) == 1
    encoded = pa.Table.from_batches(list(bpe._encode_words(bpe.ranks_path())(words)))
    encoder = bpe._encoder(bpe.ranks_path())
    out = pa.Table.from_batches(list(bpe._reassemble(bpe.ranks_path())(pa.Table.from_batches(packed), encoded)))
    assert [bytes(x.as_py()).decode() for x in out.column("decoded")] == [t for _, t in rows]
    assert [np.frombuffer(x.as_py(), "<u4").tolist() for x in out.column("ids")] == [encoder.encode_ordinary(t) for _, t in rows]


def test_structured_words_are_kept_apart(spark):
    """Words whose hashes agree under every polynomial modulo 2**64."""
    x = "a"
    while len(x) < 1024:
        x += x.translate({97: 98, 98: 97})
    y = x.translate({97: 98, 98: 97})
    df = frame(spark, [(1, x), (2, y), (3, f"{x} {y}")])
    encoder = bpe._encoder(bpe.ranks_path())
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in bpe.encode_decode(df).collect()} == {i: encoder.encode_ordinary(t) for i, t in [(1, x), (2, y), (3, f"{x} {y}")]}
    assert ngram.train(df, 1).distinct == 3  # both and the end
    items = spark.createDataFrame([(1, x)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contained_items(df, items).collect()] == [1]


# --- language ---------------------------------------------------------------------------------------


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    train, held = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    model = language.train(train)
    got = {r.doc_id: r for r in language.identify(held, model).collect()}
    truth = {r.doc_id: r.lang for r in held.collect()}
    assert sum(got[i].lang_pred == truth[i] for i in truth) >= 0.95 * len(truth)
    edge = language.identify(frame(spark, EDGE + [(8, "123 !?")]), model).collect()
    assert {r.doc_id for r in edge if r.lang_pred == "und"} == {1, 2, 3, 8} and all(0 <= r.score <= 1 for r in edge)
    kept = language.drop_unidentified(frame(spark, EDGE), model)
    assert kept.columns == ["doc_id", "text", "ids", "score"] and {r.doc_id for r in kept.collect()} <= {4, 5, 6, 7, None}
    untrained = language.train(train.limit(0))
    assert {r.lang_pred for r in language.identify(held, untrained).collect()} == {"und"}
    assert language.identify(held.limit(0), model).count() == 0


def brute_log_total(pieces, p, word):
    """Sum over all segmentations into pieces of any length, in exact powers of e."""
    number = {x: i for i, x in enumerate(pieces.pieces)}
    total = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        total[j] = functools.reduce(np.logaddexp, (total[i] + math.log(p[number[word[i:j]]]) for i in range(j) if word[i:j] in number), -math.inf)
    return total[-1]


def test_forward_sums_all_segmentations():
    pieces = language._pieces(None)
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(len(pieces.pieces)))[:, None]
    longest = max(pieces.pieces, key=len)
    words = [b"the", b"thing", b"a", "été".encode(), b"zzzzzzzz", b"relationship", longest.strip(), b"abcdef" * 40, "ж中".encode() * 60]
    assert max(len(w) for w in words) > language.LONG
    assert np.allclose(language.log_totals(pieces, words, p)[:, 0], [brute_log_total(pieces, p[:, 0], b" " + w) for w in words])
    words = words[:5]
    weight = np.array([3.0, 1, 1, 2, 1])
    counts = language.Lattice(pieces, words).expected(language.grown(pieces, p), weight)
    assert counts @ pieces.sizes == pytest.approx(sum(w * (len(x) + 1) for w, x in zip(weight, words)))


def test_language_brute_force(spark):
    """Prediction and score of every text from the training words up, by plain loops."""
    texts = {"a": ["Banana bandana", "ananas banana"], "b": ["Жук жуки", "жука ЖУК été"]}
    labelled = [(10 * k + i, t, lang) for k, (lang, own) in enumerate(texts.items()) for i, t in enumerate(own)]
    pieces = language._pieces(None)
    number = {x: i for i, x in enumerate(pieces.pieces)}
    model = {}
    for lang, own in texts.items():
        words = [b" " + w.lower().encode() for t in own for w in t.split()]
        p = np.full(len(pieces.pieces), 1 / len(pieces.pieces))
        for _ in range(language.ROUNDS):
            counts = np.full(len(p), language.SMOOTHING)
            for w in words:
                spans = [(i, j, number[w[i:j]]) for j in range(1, len(w) + 1) for i in range(j) if w[i:j] in number]
                ahead, behind = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
                for i, j, x in spans:
                    ahead[j] += ahead[i] * p[x]
                for i, j, x in sorted(spans, key=lambda s: -s[1]):
                    behind[i] += behind[j] * p[x]
                for i, j, x in spans:
                    counts[x] += ahead[i] * p[x] * behind[j] / ahead[-1]
            p = counts / counts.sum()
        model[lang] = p
    asked = [(1, "banana, ЖУК!"), (2, "BANANA 12 x"), (3, "жу" * 200), (4, "1 2 中。"), (5, "12"), (6, None), (7, "..."), (8, "été")]
    got = {r.doc_id: r for r in language.identify(frame(spark, asked), language.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))).collect()}
    for i, text in asked:
        words = ["".join(g) for ok, g in itertools.groupby((text or "").lower(), str.isalpha) if ok]
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        total = {lang: sum(brute_log_total(pieces, p, b" " + w.encode()) for w in words) for lang, p in model.items()}
        best = max(sorted(total), key=total.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 / sum(math.exp(t - total[best]) for t in total.values()), abs=1e-9)


# --- n-grams ----------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=80), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_elias_fano(values, others):
    v = np.sort(np.array(values, np.uint64))
    e = EliasFano.build(v)
    if len(v):
        assert (e.access(np.arange(len(v))) == v).all()
    asked = np.concatenate([v, np.array(others, np.uint64)])
    at = e.find(asked)
    assert [int(x) in set(values) for x in asked] == (at >= 0).tolist()
    assert (v[at[at >= 0]] == asked[at >= 0]).all()


@pytest.mark.parametrize("rows_per_file", [ngram.RANGE, 40])
def test_ngram_brute_force(spark, monkeypatch, rows_per_file):
    monkeypatch.setattr(ngram, "RANGE", rows_per_file)
    rng = random.Random(2)
    words = ["the", "of", "and", "rare", "wörd", "x1"] + [f"w{i}" for i in range(60)]
    rows = EDGE + [(i + 50, " ".join(rng.choices(words, weights=[30, 20, 10] + [1] * 63, k=rng.randint(1, 60)))) for i in range(60)]
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 10 == 0}
    tokens = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    count, pairs = collections.Counter(), collections.Counter()
    for i, w in tokens:
        if i is not None and i not in held:
            count.update(w)
            pairs.update(zip(w, w[1:]))
    total, distinct = sum(count.values()), len(count)
    kept = {k: n for k, n in pairs.items() if n >= 2}
    mass = collections.Counter()
    for (a, _), n in kept.items():
        mass[a] += n - 0.75
    single = lambda x: (count[x] + 0.1) / (total + 0.1 * (distinct + 1))
    df = frame(spark, rows)
    trie = ngram.train(df.filter(F.crc32(F.col("doc_id").cast("string")) % 10 != 0))
    assert (trie.total, trie.distinct) == (total, distinct)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in ngram.score(df, trie).collect()), key=str)
    want = []
    for i, w in tokens:
        s = 0.0
        for k, x in enumerate(w):
            before = w[k - 1] if k else None
            back = 1 - mass[before] / count[before] if before in mass else 1
            s += math.log10((kept[before, x] - 0.75) / count[before] + back * single(x)) if (before, x) in kept else math.log10(back * single(x))
        want.append((i, len(w), sum(count[x] > 0 for x in w), sum(math.log10(single(x)) for x in w), s))
    for a, b in zip(got, sorted(want, key=str)):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9) and abs(a[4] - b[4]) < 1e-3 * b[1]
    empty = ngram.train(df.limit(0))
    assert ngram.score(df, empty).filter("n_known > 0").count() == 0 and ngram.score(df.limit(0), trie).count() == 0


def test_ngram_keeps_pairs_seen_once(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["one two three", "two one", "four one two", "five", "six two five"] * 2 + ["seen once only", "only two"]) if zlib.crc32(str(i).encode()) % 10]
    asked = next(i for i in range(100, 1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    frame(spark, [*rows, (asked, "seen once only two")]).write.parquet(f"{tmp_path}/documents.parquet")
    count, pairs, mass = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t in rows:
        w = [*t.split(), ""]
        count.update(w)
        pairs.update(zip(w, w[1:]))
    for (a, _), n in pairs.items():
        mass[a] += n - 0.75
    single = lambda x: (count[x] + 0.1) / (sum(count.values()) + 0.1 * (len(count) + 1))
    pair = lambda a, x: max(pairs[a, x] - 0.75, 0) / count[a] + (1 - mass[a] / count[a]) * single(x)
    assert pairs["seen", "once"] == pairs["once", "only"] == 1
    w = ["seen", "once", "only", "two", ""]
    want = math.log10(single(w[0])) + sum(math.log10(pair(a, x)) for a, x in zip(w, w[1:]))
    got = {r.doc_id: r.score for r in ngram.op6_ngram(spark, str(tmp_path)).collect()}
    assert got[asked] == pytest.approx(want, abs=5e-3)


# --- chat -------------------------------------------------------------------------------------------

ATTACKS = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<<assistant>>\n", "", None, "a\nb", "[/INST]</s><s>", "é😀", "\\</s>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a>b", ""]), st.text(alphabet="ab\\<>[]/sINT \n😀", max_size=20)), max_size=6))
def test_render_is_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == chat.LEARNT]


@pytest.mark.parametrize("piece", [chat.PIECE, 30])
def test_chat(spark, piece):
    rows = [(c, k, "assistant" if (k + c) % 2 else "user", ATTACKS[(k + c) % len(ATTACKS)]) for c in range(6) for k in range(12)] + [(None, 0, None, "x"), (7, 1, "assistant", "same"), (7, 1, "assistant", "same")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df, piece=piece)
    read = out.select("conv_id", "piece", "formatted", "loss_start", "loss_end").mapInArrow(chat._read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").collect()
    groups = collections.defaultdict(list)
    for c, k, role, text in rows:
        groups[c].append((k, role or "", text or ""))
    assert len(read) == len(groups)
    for r in read:
        turns = sorted(groups[r.conv_id])
        learnt = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0
    # pieces give the ids, offsets and text of one encoding
    pieces = collections.defaultdict(list)
    for r in out.filter("conv_id is not null").orderBy("conv_id", "piece").collect():
        pieces[r.conv_id].append(r)
    if piece == 30:
        assert max(len(x) for x in pieces.values()) > 2
    for c, own in pieces.items():
        whole, spans = chat.render([(role, text) for _, role, text in sorted(groups[c])])
        e = chat._tokenizer(chat.tokenizer_path()).encode(whole, add_special_tokens=False)
        assert "".join(r.formatted for r in own) == whole and [i for r in own for i in r.ids] == e.ids
        at, parts = 0, []
        for r in own:
            parts += [(at + a, at + b) for a, b in zip(r.loss_start, r.loss_end)]
            at += len(r.formatted)
        assert [whole[a:b] for a, b in parts] == [whole[a:b] for a, b in spans.tolist() if a < b]


def test_chat_rows_without_a_conversation(spark):
    df = spark.createDataFrame([(None, k, "user", f"t{k}") for k in range(5)] + [(None, 0, "user", "t0")], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).collect()
    assert len(out) == 6 and all(r.conv_id is None and r.piece == 0 for r in out)
    with pytest.raises(ValueError):
        chat.parse("<s>[INST] <<user>>\nhi [/INST] and more")


def test_one_very_long_turn(spark):
    text = "word [x] " * 300_000
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    (r,) = chat.format_conversations(df).select("conv_id", "piece", "formatted", "loss_start", "loss_end").mapInArrow(chat._read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").collect()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


# --- quality ----------------------------------------------------------------------------------------


def test_quality_held_out(spark, sf):
    base = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    got = quality.score_quality(docs, labels, remainder != 1)
    held = got.filter(remainder == 1).join(labels.groupBy("doc_id").agg(F.min("quality").alias("q")), "doc_id").collect()
    assert sum(r.predicted == r.q for r in held) >= 0.93 * len(held)
    again = quality.score_quality(docs, labels.withColumn("quality", F.when(remainder == 1, 1 - F.col("quality")).otherwise(F.col("quality"))), remainder != 1)
    a, b = ({r.doc_id: r.score for r in d.collect()} for d in (got, again))
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)  # held-out labels say nothing


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    rows = quality.score_quality(frame(spark, EDGE), labels, F.lit(True)).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.score for r in quality.score_quality(frame(spark, EDGE), labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.score_quality(frame(spark, EDGE).limit(0), labels, F.lit(True)).count() == 0


def test_quality_brute_force(spark):
    """Risk, gradient, Hessian, prior and the fitted minimum against plain loops over a small fold."""
    rng = np.random.default_rng(3)
    positive = rng.random(400) < 0.15
    hidden = rng.random(400) < 0.3  # unlabelled rows that are good as well
    x = rng.normal(size=(400, quality.N_FEATURES)) + 1.5 * (positive | hidden)[:, None] * (np.arange(quality.N_FEATURES) < 3)
    rows = spark.createDataFrame([(v.tolist(), bool(p)) for v, p in zip(x, positive)], "x array<double>, positive boolean").repartition(3)
    z = np.column_stack([np.ones(len(x)), x])
    d, n_p, n_u = z.shape[1], int(positive.sum()), len(x)
    model = quality.Model(np.zeros(d), np.ones(d), rng.normal(size=d) * 0.3, 0.4)

    def sums(w):
        g = [sum(a * b for a, b in zip(row, w)) for row in z.tolist()]
        log1p = lambda t: max(t, 0) + math.log1p(math.exp(-abs(t)))
        return sum(map(log1p, g)), sum(log1p(t) for t, p in zip(g, positive) if p), sum(log1p(-t) for t, p in zip(g, positive) if p)

    got = quality._total(rows, quality._risk(model))
    assert got[:3] == pytest.approx(sums(model.weights))
    for k in (0, 1, 7):  # the gradient and a row of the Hessian by differences
        step = np.eye(d)[k] * 1e-5
        up, down = sums(model.weights + step)[0], sums(model.weights - step)[0]
        assert got[3 + k] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-4)
        side = [quality._risk(quality.Model(model.mean, model.scale, model.weights + t * step, 0.4))(z, positive)[3 : 3 + d] for t in (1, -1)]
        assert np.allclose(got[3 + d :].reshape(d, d)[k], (side[0] - side[1]) / 2e-5, rtol=1e-4, atol=1e-4)

    def risk(w, prior):
        u, p_bad, p_good = sums(w)
        return prior * p_good / n_p + max(0.0, u / n_u - prior * p_bad / n_p) + quality.RIDGE / 2 * sum(t * t for t in w), u / n_u - prior * p_bad / n_p

    prior = quality._prior(rows, model, n_p, n_u)
    scores = z @ model.weights
    best = (math.inf, None)
    for edge in np.linspace(-20, 20, quality.BINS + 1)[1:-1][::-1]:
        u, p = (scores > edge).mean(), (scores[positive] > edge).mean()
        if p >= 0.2:
            best = min(best, ((u + 2 * math.sqrt(p * (1 - p) / n_p + u * (1 - u) / n_u)) / p, u / p))
    assert prior == pytest.approx(min(0.999, max(n_p / n_u, best[1])), rel=0.02)
    fitted = quality._fit(rows, np.zeros(d), np.ones(d), z[positive].mean(axis=0), n_p, n_u, 0.4)
    least, negative = risk(fitted.weights, 0.4)
    assert negative >= 0 and least < risk(np.zeros(d), 0.4)[0]
    plain = quality._fit(rows, np.zeros(d), np.ones(d), z[positive].mean(axis=0), n_p, n_u, 0)  # without the bound
    least = risk(plain.weights, n_p / n_u)[0]
    for _ in range(30):  # no step nearby is better by more than the stopping rule allows
        assert risk(plain.weights + rng.normal(size=d) * 0.05, n_p / n_u)[0] > least - 2e-4


# --- secrets ----------------------------------------------------------------------------------------


def base_spans(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secrets(spark):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choices(alphabet, k=n))
    words = ["".join(rng.choices(["the", "tion", "er", "ing", "ble"], k=7)) for _ in range(300)]
    rows = EDGE + [
        (20, f"é😀 PassWord: '{key(14)}' password: token: abcdefghijkl"), (21, f"AKIA{key(16).upper()} AKIAshort AKIAAKIA12"), (22, f"{rng.randbytes(20).hex()} deadbeef {'0' * 16}"),
        (23, f"api_key={key(8)} ApiKey = \"{key(30)}\" \"{key(40)}\""), (24, "token=" * 50), (25, " ".join(words)), (26, f"{key(40)} {key(60)}"),
    ]
    got = secrets.find_secrets(frame(spark, rows)).collect()
    show = lambda r: sorted((x.s, x.k, x.e, x.name) for x in r.assign + r.access + r.hex)
    assert sorted(((r.doc_id, show(r)) for r in got), key=str) == sorted(((i, base_spans(t)) for i, t in rows), key=str)
    text = dict(rows)
    assert all(text[r.doc_id][x.s : x.e] == x.m for r in got for x in r.random)
    random_of = {r.doc_id: len(r.random) for r in got}
    assert random_of[26] == 2 and random_of[25] == 0
    assert secrets.find_secrets(frame(spark, rows).limit(0)).count() == 0


def test_many_secrets_in_one_text(spark):
    rng = random.Random(9)
    text = " ".join(f"{rng.randbytes(10).hex()}{'' if k % 3 else ' token=abcdefghijklmn'}" for k in range(1500))
    (r,) = secrets.find_secrets(frame(spark, [(1, text)])).collect()
    assert sorted((x.s, x.k, x.e, x.name) for x in r.assign + r.access + r.hex) == base_spans(text)
    assert len(r.hex) == 1500


def plain_deviates(token):
    """(encoding, length, chi-squared, runs and serial deviates) of a token, in loops."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    enc = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token) and re.search("[0-9]", token) else "base32" if re.fullmatch("[A-Z2-7]+=*", token) else "base64"
    symbols = secrets.ALPHABETS[enc]
    x = [symbols.find(c) for c in (body.lower() if enc == "hex" else body)]
    n, size, mean = len(x), len(symbols), sum(x) / len(x)
    chi = (size / n * sum(c * c for c in collections.Counter(x).values()) - n - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    up = [v > size / 2 - 0.5 for v in x]
    high, expected = sum(up), 2 * sum(up) * (n - sum(up)) / n + 1
    runs = 1 + sum(a != b for a, b in zip(up, up[1:]))
    runs = math.sqrt(1.4 * n) if high in (0, n) else abs((runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9)))
    serial = abs(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / max(sum((a - mean) ** 2 for a in x), 1e-9) * math.sqrt(n))
    return enc, n, chi, runs, serial


def plain_cell(token):
    enc, n, chi, runs, serial = plain_deviates(token)
    score = max(-12, min(4, -chi - max(0, runs - 1) ** 2 / 2 - max(0, serial - 1) ** 2 / 2))
    return enc, min(15, (n - 20) // 4), math.floor(score * 4)


def plain_decoys(text):
    h = np.uint64(xxhash.xxh64(text.encode(), seed=42).intdigest()).astype(np.int64).item()
    at = h % max(1, len(text) - 500)
    words = re.findall(secrets.DECOY_WORD, text[at : at + 500])
    number = lambda i: str((h + i * 7919) % 1000)
    cap = [w.capitalize() for w in words]
    style = ["".join(cap), "_".join(w + number(i) * (i % 2) for i, w in enumerate(words)), "".join(w + number(i) * (i % 3 == 2) for i, w in enumerate(cap))][h % 3]
    lengths = [20 + 4 * (4 * k + h % 4) for k in range(4)]
    return [x[:n] for x in (style, "".join(words).upper(), " ".join(words).encode().hex()) for n in lengths if n <= len(x)]


def plain_random(rows):
    """{row: spans} that the battery adds, in loops."""
    natural = re.compile("([A-Za-z]?[a-z]*([-_/][A-Za-z]?[a-z]*)*|[0-9]*)=*")
    every = [(k, m.start(), m.end(), m.group()) for k, (_, t) in enumerate(rows) for m in re.finditer(secrets.TOKEN, t or "")]
    tokens = [(k, a, e, plain_cell(x)) for k, a, e, x in every if not natural.fullmatch(x)]
    decoys = collections.defaultdict(list)
    for _, t in [*rows, *((None, [x]) for *_, x in every if natural.fullmatch(x))]:
        for x in t if isinstance(t, list) else plain_decoys(t or ""):
            enc, c, b = plain_cell(x)
            decoys[enc, c].append(b)
    found = []
    for *_, (enc, c, b) in tokens:
        pool, k = list(decoys[enc, c]), c - 1
        while len(pool) < 400 and k >= 0:
            pool, k = pool + decoys[enc, k], k - 1
        found.append((1 + sum(x >= b for x in pool)) / (1 + len(pool)))
    ordered = sorted(found)
    limit = max((p for i, p in enumerate(ordered) if p <= 0.05 * (i + 1) / len(ordered)), default=-1)
    return sorted((k, a, e) for (k, a, e, _), p in zip(tokens, found) if p <= limit)


def planted(rng, rows, n):
    """n random keys of 20 to 60 symbols and n natural identifiers and encoded words, each in a text of its own."""
    words = [w for _, t in rows for w in re.findall("[A-Za-z]+", t or "")]
    alphabets = [secrets.ALPHABETS["base64"][:62], secrets.ALPHABETS["base32"], secrets.ALPHABETS["hex"]]
    keys = [(10_000 + i, f"Some words, {''.join(rng.choices(alphabets[i % 3], k=rng.randint(20, 60)))} and more.") for i in range(n)]
    forms = [lambda w: "".join(x.capitalize() for x in w), lambda w: "_".join(x + (str(rng.randint(0, 99)) if rng.random() < 0.4 else "") for x in w), lambda w: "".join(w).upper(), lambda w: " ".join(w).encode().hex()]
    return keys + [(20_000 + i, f"Some words, {forms[i % 4](rng.choices(words, k=14))[: rng.randint(20, 60)]} and more.") for i in range(n)]


@pytest.mark.parametrize("table, least", [("sf0.001", 0.8), ("sf0.01", 0.9)])
def test_random_tokens_against_loops(spark, table, least):
    """Planted keys are found (the fewer documents, the fewer decoys), natural tokens left alone, and the spans are those of a plain version."""
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{table}/documents.parquet").select("doc_id", "text").collect()] + EDGE
    rows += planted(random.Random(5), rows, 600)
    got = secrets.find_secrets(frame(spark, rows)).select("doc_id", F.explode("random").alias("x")).select("doc_id", "x.s", "x.e").collect()
    want = plain_random(rows)
    assert sorted(((r.doc_id, r.s, r.e) for r in got), key=str) == sorted(((rows[k][0], a, e) for k, a, e in want), key=str)
    keys, others = (len({r.doc_id for r in got if lo <= (r.doc_id or 0) < lo + 10_000}) for lo in (10_000, 20_000))
    assert keys >= least * 600 and others <= 0.05 * (keys + others)


def test_given_tables_have_random_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert secrets.find_secrets(docs).agg(F.sum(F.size("random"))).first()[0] > 0


@pytest.mark.parametrize("symbol", list("=-_/+0a"))
def test_runs_of_one_symbol(spark, symbol):
    """Headings and rules are no secrets and stop nothing, alone or beside secrets."""
    rng = random.Random(3)
    rows = [(n, f"Title\n{symbol * n}\ntext") for n in (15, 16, 19, 20, 21, 63, 64, 100)] + [(200, f"token = {rng.randbytes(20).hex()}\n{symbol * 40}\n{symbol * 25}={symbol * 25}")] + [(300 + i, "Plain words stand here for the decoys of this test. " * 9) for i in range(30)]
    got = {r.doc_id: r for r in secrets.find_secrets(frame(spark, rows)).collect()}
    text = dict(rows)
    for i, r in got.items():
        assert sorted((x.s, x.k, x.e, x.name) for x in r.assign + r.access + r.hex) == base_spans(text[i])
        assert all(len(set(x.m)) > 2 for x in r.random)


def plain_whole_decoys(text):
    """All words of a text in every form, cut in turn into pieces of every length class, in loops."""
    out, left = [], [w for w in re.findall("(?<![A-Za-z0-9])[A-Za-z][a-z]*(?![A-Za-z0-9])", text) if len(w) < 20]
    while left:
        block, left = " ".join(left), []
        if len(block) > 840:
            end = block.rindex(" ", 0, 801)
            block, left = block[:end], block[end + 1 :].split(" ")
        h = np.uint64(xxhash.xxh64(block.encode(), seed=42).intdigest()).astype(np.int64).item()
        words = block.split(" ")
        cap, number = [w.capitalize() for w in words], lambda i, h=h: str((h + i * 7919) % 1000)
        forms = ["".join(cap), "_".join(w + number(i) * (i % 2) for i, w in enumerate(words)), "".join(w + number(i) * (i % 3 == 2) for i, w in enumerate(cap)), "".join(words).upper(), block.encode().hex()]
        for x in forms:
            k = h % 16
            while len(x) >= 20:
                n = 20 + 4 * k if len(x) >= 40 + 4 * k else len(x)
                out.append(x[:n])
                x, k = x[n:], (k + 1) % 16
    return out


def test_decoys_of_whole_texts(spark):
    """Every word of every text is in the decoys, wherever it stands, and their scores by set bits are those of loops."""
    rng = random.Random(8)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()] + EDGE
    rows += [(900 + i, " ".join("".join(rng.choices("abcdefxyz", k=rng.randint(1, 22))) for _ in range(n))) for i, n in enumerate((0, 1, 2, 5, 90, 400, 3000))]
    rows += [(910, "a " * 3000), (911, "ab cd " * 9), (912, "A b C d e F " * 200), (913, "z" * 19 + " " + "x1 " * 500 + "q" * 19), (914, "x1 7 \u00e9t\u00e9 Word camelCase WORD under_score " * 40)]
    docs = secrets._texts(frame(spark, rows))
    want = [x for _, t in rows for x in plain_whole_decoys(t or "")]
    assert collections.Counter(r.m for r in secrets._pieces(docs).collect()) == collections.Counter(want)
    got = secrets._piece_bins(secrets._pieces(docs)).groupBy("v.enc", "v.class", "v.bin").count().collect()
    assert {(r.enc, r["class"], r.bin): r["count"] for r in got} == collections.Counter(map(plain_cell, want))
    letters = sum(len(w) for _, t in rows for w in re.findall(secrets.WORD, t or ""))
    upper = sum(len(r.m) for r in secrets._pieces(docs).filter("form = 'base32'").collect())
    assert letters - 19 * len(rows) <= upper <= letters  # only texts of fewer than 20 letters give none


def test_scoring_is_compiled(spark):
    """Pieces of all lengths and encodings score as in loops, by code that the JVM compiles: no lambdas, no method of over 8000 bytes."""
    rng = random.Random(12)
    kinds = {"hex": ["0123456789abcdef"], "base32": ["ABCDEFGHIJKLMNOPQRSTUVWXYZ"], "caps": [secrets.ALPHABETS["base64"][:52], secrets.ALPHABETS["base32"], "ABCDEF0123456789"], "snake": [secrets.ALPHABETS["base64"][:62] + "_", "abcdef0123456789", "z", "9", "_"]}
    rows = [(form, "".join(rng.choices(symbols, k=n))) for form, all_ in kinds.items() for symbols in all_ for n in range(20, 100) for _ in range(3)]
    bins = secrets._piece_bins(spark.createDataFrame(rows, "form string, m string")).groupBy("v.enc", "v.class", "v.bin").count()
    assert {(r.enc, r["class"], r.bin): r["count"] for r in bins.collect()} == collections.Counter(plain_cell(m) for _, m in rows)
    assert "lambda" not in bins._jdf.queryExecution().executedPlan().toString()
    with contextlib.redirect_stdout(io.StringIO()) as out:
        bins.explain("codegen")
    sizes = [int(x) for x in re.findall("maxMethodCodeSize:([0-9]+)", out.getvalue())]
    assert sizes and max(sizes) < 8000


def test_whole_texts_against_loops(spark, monkeypatch):
    """The query's spans are those of a plain version with decoys of whole texts; planted keys are found, natural tokens left alone."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()] + EDGE
    rows += planted(random.Random(5), rows, 600)
    got = secrets.find_secrets(frame(spark, rows), whole=True).select("doc_id", F.explode("random").alias("x")).select("doc_id", "x.s", "x.e").collect()
    monkeypatch.setitem(globals(), "plain_decoys", plain_whole_decoys)
    want = plain_random(rows)
    assert sorted(((r.doc_id, r.s, r.e) for r in got), key=str) == sorted(((rows[k][0], a, e) for k, a, e in want), key=str)
    keys, others = (len({r.doc_id for r in got if lo <= (r.doc_id or 0) < lo + 10_000}) for lo in (10_000, 20_000))
    print("planted keys found", keys, "others", others)
    assert keys >= 0.8 * 600 and others <= 0.05 * (keys + others)


# --- decontamination --------------------------------------------------------------------------------


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


@pytest.mark.parametrize("limit", [decontaminate.INDEX_BYTES, 6000])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", limit)
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([6, 12, 25, 60, 200]))) for i in range(30)] + [(90, None), (91, ""), (92, "one two"), (93, "One  TWO")]
    docs = EDGE + [(i + 100, text(rng.choice([3, 50, 4000]))) for i in range(30)]
    for i, (_, item) in enumerate(items[:30]):
        words = item.split()
        part = words[: max(1, int(len(words) * rng.uniform(0.6, 1)))]
        docs.append((i + 200, f"{text(rng.choice([0, 10, 3000]))} {' '.join(part).upper()} {text(rng.choice([0, 10, 3000]))}"))
    sets = {i: shingle_set(t) for i, t in items}
    want = sorted(((d, i, len(s & x), len(s)) for d, t in docs for x in [shingle_set(t)] for i, s in sets.items() if s and 100 * len(s & x) >= 75 * len(s)), key=str)
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = decontaminate.contained_items(frame(spark, docs), benchmark)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    clean = decontaminate.drop_contaminated(frame(spark, docs), benchmark)
    dirty = collections.Counter(str(d) for d, *_ in {(d, t) for d, t in docs if any(s and 100 * len(s & shingle_set(t)) >= 75 * len(s) for s in sets.values())})
    assert not {str(r.doc_id) for r in clean.collect()} & set(dirty)
    assert decontaminate.contained_items(frame(spark, docs), benchmark.limit(0)).count() == 0 and decontaminate.contained_items(frame(spark, docs).limit(0), benchmark).count() == 0


def test_decontamination_repeated_items(spark, monkeypatch):
    """Items without ids and repeated items are found once each, in whichever file they are."""
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 3000)
    words = "alpha beta gamma delta epsilon zeta eta theta"
    benchmark = spark.createDataFrame([(None, words), (5, words), (5, words)] + [(i, f"{i} other words of item {i} here") for i in range(100, 120)], "item_id long, text string")
    docs = frame(spark, [(1, f"so {words} it ends"), (2, "nothing at all of these"), (None, words)])
    got = decontaminate.contained_items(docs, benchmark).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.n_shared, r.n_item) for r in got) == sorted((d, i, 4, 4) for d in ("1", "None") for i in ("None", "5", "5"))
    assert len(decontaminate._index_files(decontaminate._items(benchmark))) > 1
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, benchmark).collect()] == [2]
