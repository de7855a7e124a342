r"""Secret scan: fixed patterns and a randomness test battery, in DataFrame functions only.

Base spans are leftmost non-overlapping matches of three patterns. The battery adds spans: runs of
LEAST or more characters of `[A-Za-z0-9+/_-]` (and up to two `=`) are given an encoding (hex, base 32 or base 64), their
symbols become numbers of that alphabet, and three tests measure how far they are from random:
chi-squared uniformity over the alphabet, runs about the alphabet's middle, and lag-1 serial
correlation. The score of a token is minus the chi-squared deviate (in standard deviations, small is uniform), minus half the squares of
what the deviates of runs and correlation exceed one.
Natural text looks random now and then, too, the more so the shorter it is. So scores are turned into
p-values under "natural text of that length in that encoding" by decoys: all words of all texts as identifiers with capitals or numbers
(base 64, three forms), in capitals (base 32) and as the hex digits of their bytes, each string cut without a gap into pieces of every length
class in turn. (Without whole=True, find_secrets takes one place of each text, chosen by its hash, one form and every DECOY_EVERY-th length
class only; the query doesn't.) A token's p-value is the share of decoys of its encoding and class that score
as high, with the next smaller classes until there are ENOUGH; Benjamini-Hochberg at RATE over all tokens then decides. Tokens that
are nothing but words or nothing but digits are decoys, too, and no candidates.
What crosses the driver is one count for each (encoding, length class, score bin), a fixed number.

Positions are code points, ends exclusive. They come from the lengths of the pieces between matches
(split by the same pattern), so a text is scanned in place and nothing is shuffled. The deviates are
scores only: what decides is their rank among decoys of that length.
Defined cases: null and empty texts have no spans; repeated rows and null ids are scanned like others; very long texts are scanned
whole; an empty table gives no rows; other columns are not looked at; without any words in the documents there are no decoys, and no
token is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

# Fixed values of the contract
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the maximal runs of 16 and more are the matches of [0-9a-f]+ that are long enough
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Matches whose places are summed together.
BLOCK = 256
TOKEN, LEAST = r"[A-Za-z0-9+/_-]{20,}={0,2}", 20
RATE, ENOUGH = 0.05, 400
LENGTH_STEP, LENGTH_CLASSES, BINS_PER_UNIT, LOWEST, HIGHEST = 4, 16, 4, -12, 4
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


#: Words of decoys: runs of letters that stand alone, from so many characters of a text; each DECOY_EVERY-th length class gets one.
DECOY_WORD, DECOY_PIECE = r"(?<![A-Za-z0-9])[A-Za-z][a-z]{0,14}(?![A-Za-z0-9])", 500
DECOY_EVERY = 4

#: Decoys of whole texts: lone runs of letters (longer ones are tokens themselves) in blocks of about WORDS characters, the rest of a text with
#: the last block; each block's strings are cut into pieces of every length class in turn.
WORD = rf"(?<![A-Za-z0-9])[A-Za-z][a-z]{{0,{LEAST - 2}}}(?![A-Za-z0-9])"
WORDS = 800
WORD_BLOCK = rf"[A-Za-z][A-Za-z ]{{0,{WORDS + 2 * LEAST - 1}}}$|[A-Za-z][A-Za-z ]{{0,{WORDS - 1}}}(?![A-Za-z])"
#: Symbols of a piece as numbers of BITS bits, LANES of them in each of LONGS longs.
BITS, LANES, LONGS = 6, 10, 10


def _matches(text: str, pattern: str, name: str, group: int | None = None) -> dict[str, Column]:
    has = F.col(text).rlike(pattern)
    out = {f"{name}_p": F.when(has, F.split(text, pattern, -1)), f"{name}_m": F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))}
    if group:
        out[f"{name}_g"] = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    return out


def _spans(name: str, kind: str, order: int, keep: str = "true") -> Column:
    """array<struct<s, k, e, name, m>> of the matches that `keep` (over i) accepts, in order.

    Starts are sums of the lengths before: summed within blocks of BLOCK matches first, then over the blocks, so
    the work grows with the number of matches.
    """
    p, m = f"{name}_p", f"{name}_m"
    steps = f"zip_with({m}, slice({p}, 2, size({m})), (x, y) -> length(x) + length(y))"
    block = """aggregate(slice(steps, k * {n} + 1, {n}), named_struct('at', 0, 'out', cast(array() as array<int>)),
      (a, y) -> named_struct('at', a.at + y, 'out', concat(a.out, array(a.at))))""".format(n=BLOCK)
    blocks = f"transform(sequence(0, cast((size(steps) - 1) / {BLOCK} as int)), k -> {block})"
    starts = f"""aggregate({blocks}, named_struct('at', length({p}[0]), 'out', cast(array() as array<array<int>>)),
      (a, b) -> named_struct('at', a.at + b.at, 'out', concat(a.out, array(transform(b.out, x -> x + a.at)))), a -> flatten(a.out))"""
    # a lambda gives the steps a name, so that they are worked out once
    starts = f"transform(array({steps}), steps -> {starts})[0]"
    every = f"zip_with({starts}, {m}, (s, x) -> named_struct('s', s, 'k', {order}, 'e', s + length(x), 'name', '{kind}', 'm', x))"
    kept = every if keep == "true" else f"filter({every}, (x, i) -> {keep.replace('[m]', 'x.m')})"
    empty = "cast(array() as array<struct<s:int,k:int,e:int,name:string,m:string>>)"
    return F.expr(f"if({m} is null or size({m}) = 0, {empty}, {kept})")


def _score(token: Column) -> Column:
    """Encoding, alphabet and body of a token, and whether it is words or digits only."""
    is_hex = token.rlike("^([0-9a-f]+|[0-9A-F]+)$") & token.rlike("[0-9]")
    return F.struct(
        F.when(is_hex, "hex").when(token.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64").alias("enc"),
        F.translate(F.rtrim(token, F.lit("=")), "-_", "+/").alias("body"),
        token.rlike("^([A-Za-z]?[a-z]*([-_/][A-Za-z]?[a-z]*)*|[0-9]*)=*$").alias("natural"),
    )


def _numbered(v: str) -> str:
    """SQL that adds length, symbol numbers and the sum of squared counts to what _score gives."""
    enc = "CASE {v}.enc " + " ".join(f"WHEN '{e}' THEN {{{e}}}" for e in ALPHABETS) + " END"
    alphabet = enc.format(v=v, **{e: f"'{symbols}'" for e, symbols in ALPHABETS.items()})
    size = enc.format(v=v, **{e: f"{float(len(symbols))}D" for e, symbols in ALPHABETS.items()})
    body = f"if({v}.enc = 'hex', lower({v}.body), {v}.body)"
    named = f"transform(array(named_struct('b', {body}, 'abc', {alphabet})), w -> {{}})[0]"
    numbers = named.format("transform(split(w.b, ''), c -> instr(w.abc, c) - 1D)")
    squares = named.format("aggregate(array_distinct(split(w.b, '')), 0D, (a, c) -> a + power(length(w.b) - length(replace(w.b, c, '')), 2D))")
    return f"named_struct('enc', {v}.enc, 'n', cast(length({v}.body) as double), 'size', {size}, 'natural', {v}.natural, 'squares', {squares}, 'x', {numbers})"


def _tested(v: str) -> str:
    """SQL that adds counts about the middle, runs and the mean to what _numbered gives."""
    named = f"transform(array({v}.size / 2 - 0.5), mid -> {{}})[0]"
    high = named.format(f"aggregate({v}.x, 0D, (a, y) -> a + if(y > mid, 1D, 0D))")
    runs = named.format(f"aggregate({v}.x, named_struct('runs', 0D, 'up', cast(null as boolean)), (a, y) -> named_struct('runs', a.runs + if(a.up <=> (y > mid), 0D, 1D), 'up', y > mid), a -> a.runs)")
    mean = f"(aggregate({v}.x, 0D, (a, y) -> a + y) / {v}.n)"
    return f"named_struct('enc', {v}.enc, 'n', {v}.n, 'natural', {v}.natural, 'size', {v}.size, 'squares', {v}.squares, 'high', {high}, 'runs', {runs}, 'mean', {mean}, 'x', {v}.x)"


def _cell(v: str, serial: str | None = None) -> str:
    """SQL for the normal deviates of the three tests; serial: SQL of the correlation's, where {v} has no numbers x."""
    serial = serial or f"""(aggregate({v}.x, named_struct('sum', 0D, 'last', 0D), (a, y) -> named_struct('sum', a.sum + a.last * (y - {v}.mean), 'last', y - {v}.mean), a -> a.sum)
      / greatest(aggregate({v}.x, 0D, (a, y) -> a + (y - {v}.mean) * (y - {v}.mean)), 1e-9) * sqrt({v}.n))"""
    chi = f"(({v}.size / {v}.n * {v}.squares - {v}.n - ({v}.size - 1)) / sqrt(2 * ({v}.size - 1) * ({v}.n - 1) / {v}.n))"
    expected = f"(2 * {v}.high * ({v}.n - {v}.high) / {v}.n + 1)"
    runs = f"(({v}.runs - {expected}) / sqrt(greatest(({expected} - 1) * ({expected} - 2) / ({v}.n - 1), 1e-9)))"
    # all on one side of the middle: as unlikely as n equal coin tosses, in normal deviates
    runs = f"if({v}.high = 0 or {v}.high = {v}.n, sqrt(1.4 * {v}.n), abs({runs}))"
    return f"named_struct('enc', {v}.enc, 'n', {v}.n, 'natural', {v}.natural, 'chi', {chi}, 'runs', {runs}, 'serial', abs({serial}))"


def _binned(v: Column) -> Column:
    over = lambda test: F.pow(F.greatest(F.lit(0.0), v[test] - 1), F.lit(2.0)) / 2
    score = F.greatest(F.lit(float(LOWEST)), F.least(F.lit(float(HIGHEST)), -v["chi"] - over("runs") - over("serial")))
    length = F.least(F.lit(LENGTH_CLASSES - 1), F.floor((v["n"] - LEAST) / LENGTH_STEP).cast("int"))
    return F.struct(v["enc"].alias("enc"), F.greatest(F.lit(0), length).alias("class"), F.floor(score * BINS_PER_UNIT).cast("int").alias("bin"), v["natural"].alias("natural"))


def _decoys(text: str) -> Column:
    """array<string>: natural text of a document in each encoding, cut to the least length of every DECOY_EVERY-th class."""
    place = f"pmod(xxhash64({text}), greatest(1L, length({text}) - {DECOY_PIECE}L)) + 1"
    words = f"regexp_extract_all(substring({text}, cast({place} as int), {DECOY_PIECE}), r'{DECOY_WORD}', 0)"
    number = "cast(pmod(h + i * 7919, 1000) as string)"
    styles = f"""array(array_join(transform(ws, w -> initcap(w)), ''), array_join(transform(ws, (w, i) -> if(i % 2 = 1, concat(w, {number}), w)), '_'),
      array_join(transform(ws, (w, i) -> if(i % 3 = 2, concat(initcap(w), {number}), initcap(w))), ''))"""
    strings = f"array(element_at({styles}, cast(pmod(h, 3) + 1 as int)), upper(array_join(ws, '')), lower(hex(array_join(ws, ' '))))"
    lengths = f"transform(sequence(0, {LENGTH_CLASSES // DECOY_EVERY - 1}), k -> cast({LEAST} + {LENGTH_STEP} * ({DECOY_EVERY} * k + pmod(h, {DECOY_EVERY})) as int))"
    long_enough = f"flatten(transform({strings}, x -> transform(filter({lengths}, n -> n <= length(x)), n -> substring(x, 1, n))))"
    return F.expr(f"transform(array({words}), ws -> transform(array(xxhash64({text})), h -> {long_enough})[0])[0]")


def _cuts() -> str:
    """SQL of the places a and lengths n at which strings are cut, for each length class to start with; enough for a block's longest string."""
    rows = []
    for first in range(LENGTH_CLASSES):
        lengths = [LEAST + LENGTH_STEP * ((first + i) % LENGTH_CLASSES) for i in range(3 * LENGTH_CLASSES)]
        rows.append(", ".join(f"named_struct('a', {1 + sum(lengths[:i])}, 'n', {n})" for i, n in enumerate(lengths)))
    return f"array({', '.join(f'array({row})' for row in rows)})"


def _pieces(docs: DataFrame) -> DataFrame:
    """(form, m): all words of all texts (column t) in each form of base 64 and each other encoding, cut into pieces; what is left below LEAST goes with the last piece."""
    words = F.array_join(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), " ")
    blocks = docs.select(F.explode(F.regexp_extract_all(words, F.lit(WORD_BLOCK), F.lit(0))).alias("b"))
    blocks = blocks.selectExpr("b", "xxhash64(b) h", "split(b, ' ') ws", "split(initcap(b), ' ') caps")
    number = "cast(pmod(h + i * 7919, 1000) as string)"
    forms = f"""map('caps', array_join(caps, ''), 'snake', array_join(transform(ws, (w, i) -> if(i % 2 = 1, concat(w, {number}), w)), '_'),
      'numbers', array_join(transform(caps, (w, i) -> if(i % 3 = 2, concat(w, {number}), w)), ''), 'base32', upper(array_join(ws, '')), 'hex', lower(hex(b)))"""
    strings = blocks.select("h", F.explode(F.expr(forms)).alias("form", "x")).selectExpr("form", "x", "length(x) size", f"element_at({_cuts()}, cast(pmod(h, {LENGTH_CLASSES}) + 1 as int)) cuts")
    left = "size - c.a + 1"
    return strings.select("form", "x", "size", F.explode("cuts").alias("c")).filter(f"{left} >= {LEAST}").selectExpr("form", f"substring(x, c.a, if({left} < c.n + {LEAST}, {left}, c.n)) m")


def _piece_bins(pieces: DataFrame) -> DataFrame:
    """(v): what _tests gives, of pieces of up to LANES * LONGS - 1 symbols.

    Symbols are packed into longs by their base 64 numbers and sorted into planes, one for each bit; hex and base 32 are renumbered there. All that the
    tests need are counts of set bits: a symbol's count from the planes, sums of products from pairs of planes, those of neighbours with the second one
    moved by a symbol. Everything is a column of its own that is never null, no array; steps have over 100 columns where their code is long, so that
    Spark compiles them by themselves.
    """
    every = sum(1 << BITS * i for i in range(LANES))
    bits, halves = range(BITS), {"l": (0, 1, 2), "u": (3, 4, 5)}
    groups = {"f": range(BITS), "g": range(BITS, LONGS)}  # so many longs share one, each moved by another number of bits
    full = {w: sum(every << j for j in range(len(ks))) for w, ks in groups.items()}
    encoded = "CASE WHEN form IN ('hex', 'base32') THEN form WHEN m rlike '^([0-9a-f]+|[0-9A-F]+)$' AND m rlike '[0-9]' THEN 'hex' WHEN m rlike '^[A-Z2-7]+$' THEN 'base32' ELSE 'base64' END"
    digits, top = BITS * LANES // 4, BITS * (LANES - 1)
    p = pieces.selectExpr("m", f"{encoded} enc")
    p = p.selectExpr("enc", "coalesce(length(m), 0) n", f"hex(unbase64(rpad(if(enc = 'hex', lower(m), replace(m, '_', '/')), {LANES * LONGS}, 'A'))) w")
    p = p.selectExpr("enc", "n", *[f"if(n > {LANES * k}, coalesce(cast(conv(substring(w, {1 + digits * k}, {digits}), 16, 10) as bigint), 0L), 0L) x{k}" for k in range(LONGS)])
    fold = lambda ks, b: " | ".join(f"shiftleft(shiftright(x{k}, {b}) & {every}L, {j})" for j, k in enumerate(ks))
    p = p.selectExpr("enc", "n", "if(enc = 'hex', -1L, 0L) hexed", "if(enc = 'base64', 0L, -1L) fewer", *[f"{fold(ks, b)} {w}{b}" for w, ks in groups.items() for b in bits])
    # digits are 52 to 61 in base 64: less 52 is the low four bits less 4 (hex), less 28 is the low five bits plus 4 (base 32); a to f are 26 to 31 there
    number = lambda w: [f"{w}0 {w}x0", f"{w}1 {w}x1", f"{w}2 ^ ({w}5 & fewer) {w}x2", f"{w}3 ^ ({w}5 & fewer & ({w}2 ^ hexed)) {w}x3", f"{w}4 & ~hexed {w}x4", f"{w}5 & ~fewer {w}x5"]
    p = p.selectExpr("enc", "n", *number("f"), *number("g"))
    before = {"f": "shiftright(fx{b}, {s}) | shiftleft(fx{b} & 31, {t})", "g": "shiftright(gx{b}, {s}) | shiftleft(gx{b} & 7, {t}) | shiftleft(shiftright(fx{b}, 5) & 1L, {t} - 1)"}
    moved = lambda w, b: f"({before[w].format(b=b, s=BITS, t=top + 1)})"
    half = lambda w, part, v: " & ".join(f"{w}x{b}" if v >> i & 1 else f"~{w}x{b}" for i, b in enumerate(part))
    high = lambda of: f"CASE enc WHEN 'hex' THEN {of(3)} WHEN 'base32' THEN {of(4)} ELSE {of(5)} END"
    ups, turns = ([f(w) for w in groups] for f in (lambda w: high(lambda b: f"{w}x{b}"), lambda w: high(lambda b: f"{w}x{b} ^ {moved(w, b)}")))
    first = " + ".join(f"{1 << b} * cast(shiftright(fx{b}, {top}) & 1L as int)" for b in bits)
    last = " + ".join(f"{1 << b} * cast(shiftright(if(n > {LANES * BITS}, gx{b}, fx{b}), {top} - {BITS} * ((n - 1) % {LANES}) + cast((n - 1) / {LANES} as int) % {BITS}) & 1L as int)" for b in bits)
    p = p.selectExpr(
        "enc", "n", f"{first} first", f"{last} last", f"bit_count({ups[0]}) + bit_count({ups[1]}) high", f"1 + bit_count({turns[0]}) + bit_count({turns[1]}) turns",
        *[f"bit_count({w}x{b} & {moved(w, c)}) {w}p{b}{c}" for w in groups for b in bits for c in bits], *[f"bit_count({w}x{b} & {w}x{c}) {w}q{b}{c}" for w in groups for b in bits for c in bits if b <= c],
        *[f"({half(w, part, v)}) & {full[w]}L {w}{side}{v}" for w in groups for side, part in halves.items() for v in range(8)],
    )
    # doubles hold these numbers exactly, and their sums are not checked for overflow one by one
    summed = lambda name, weights: " + ".join(f"{weight}D * (cast(f{name}{k} as double) + cast(g{name}{k} as double))" for k, weight in weights.items())
    p = p.selectExpr(
        "enc", "cast(n as double) n", "first", "last", "high", "turns", summed("p", {f"{b}{c}": 1 << b + c for b in bits for c in bits}) + " pairs",
        summed("q", {f"{b}{b}": 1 << b for b in bits}) + " total", summed("q", {f"{b}{c}": 1 << b + c + (b < c) for b in bits for c in bits if b <= c}) + " power",
        *[f"cast(bit_count(fl{v & 7} & fu{v >> 3}) as double) + cast(bit_count(gl{v & 7} & gu{v >> 3}) as double)" + (f" - ({LANES * LONGS} - n)" if v == 0 else "") + f" c{v}" for v in range(1 << BITS)],
    )
    # the padding is low and numbered 0: it makes a turn after a high symbol, as the start does before one
    p = p.selectExpr(
        "enc", "n", "CASE enc WHEN 'hex' THEN 16D WHEN 'base32' THEN 32D ELSE 64D END size", "cast(high as double) high", "first", "last", "turns",
        "cast(first + last as double) ends", "pairs", "true natural", " + ".join(f"c{v} * c{v}" for v in range(1 << BITS)) + " squares", "total", "power",
    )
    p = p.withColumn("runs", F.expr("cast(turns - if(first >= size / 2, 1, 0) - if(last >= size / 2, 1, 0) as double)"))
    serial = "((d.pairs * d.n * d.n - d.total * d.n * (2 * d.total - d.ends) + (d.n - 1) * d.total * d.total) / (d.n * d.n) / greatest((d.n * d.power - d.total * d.total) / d.n, 1e-9D) * sqrt(d.n))"
    return p.alias("d").select(F.expr(_cell("d", serial)).alias("v")).select(_binned(F.col("v")).alias("v"))


def _tests(tokens: str) -> list[tuple[str, Column]]:
    """Steps that turn a column of strings into one of cells and bins, each under the column's name."""
    steps = [F.expr(f"transform({tokens}, tok -> {step('tok')})") for step in (_numbered, _tested, _cell)]
    return [(tokens, step) for step in (F.transform(tokens, _score), *steps, F.transform(tokens, _binned))]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))


def _prepared(docs: DataFrame, whole: bool) -> DataFrame:
    t = _texts(docs)
    decoys = F.expr("cast(array() as array<string>)") if whole else _decoys("t")
    t = t.withColumns(_matches("t", ASSIGN, "a", 2) | _matches("t", ACCESS, "k") | _matches("t", HEX, "h") | _matches("t", TOKEN, "r") | {"decoys": decoys}).drop("t")
    t = t.select(
        "doc_id",
        _spans("a", "assign", 0, f"length(a_g[i]) >= {ASSIGN_LEAST}").alias("assign"),
        _spans("k", "access", 1, f"length([m]) >= {ACCESS_LEAST}").alias("access"),
        _spans("h", "hex", 2).alias("hex"),
        _spans("r", "random", 3).alias("tokens"),
        "decoys",
    )
    t = t.withColumn("v", F.transform("tokens", lambda x: x["m"]))
    for name, step in _tests("v") + _tests("decoys"):
        t = t.withColumn(name, step)
    return t


def _least_bins(prepared: DataFrame, docs: DataFrame | None = None) -> dict[tuple[str, int], int]:
    """The smallest score bin that counts as random, by encoding and length class; docs: whole texts that give decoys, too."""
    both = F.concat(F.transform("v", lambda x: F.struct(x.alias("v"), x["natural"].cast("int").alias("decoy"))), F.transform("decoys", lambda x: F.struct(x.alias("v"), F.lit(1).alias("decoy"))))
    scored = prepared.select(F.explode(both).alias("x"))
    if docs is not None:
        scored = scored.union(_piece_bins(_pieces(_texts(docs))).select(F.struct("v", F.lit(1).alias("decoy"))))
    counts = scored.groupBy("x.v.enc", "x.v.class", "x.v.bin").agg(F.sum("x.decoy").alias("decoys"), F.sum(1 - F.col("x.decoy")).alias("others"))
    cells = [(r.enc, r["class"], r.bin, r.decoys, r.others) for r in counts.collect()]  # at most 3 * LENGTH_CLASSES * bins rows
    return thresholds(cells)


def thresholds(cells: list[tuple[str, int, int, int, int]]) -> dict[tuple[str, int], int]:
    """The smallest score bin that counts as random, by (encoding, class), from counts of decoys and other tokens by (encoding, class, bin)."""
    total = sum(o for *_, o in cells)
    valued = []
    for enc, c, b, _, others in cells:
        if others:
            # decoys of smaller classes look more random, which errs towards fewer discoveries
            all_, above, k = 0, 0, c
            while k >= 0 and all_ < ENOUGH:
                all_ += sum(w for e, of, _, w, _ in cells if (e, of) == (enc, k))
                above += sum(w for e, of, x, w, _ in cells if (e, of) == (enc, k) and x >= b)
                k -= 1
            valued.append(((1 + above) / (1 + all_), enc, c, b, others))
    valued.sort()
    limit, seen, at = -1.0, 0, 0
    while at < len(valued):
        p = valued[at][0]
        while at < len(valued) and valued[at][0] == p:
            seen += valued[at][4]
            at += 1
        if p <= RATE * seen / total:
            limit = p
    out: dict[tuple[str, int], int] = {}
    for p, enc, c, b, _ in valued:
        if p <= limit:
            out[enc, c] = min(b, out.get((enc, c), b))
    return out


def find_secrets(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, assign, access, hex, random): arrays of structs of start s, kind order k, end e, name and text m.

    whole: decoys of all words of all texts, as the query takes them, in place of one decoy text of each document.
    """
    prepared = materialize(_prepared(docs, whole), "secrets")  # spans and bins of tokens
    least = _least_bins(prepared, docs if whole else None)
    if least:
        table = F.create_map(*[x for (enc, c), b in sorted(least.items()) for x in (F.lit(f"{enc}{c}"), F.lit(b))])
        flagged = F.transform("v", lambda y: F.coalesce(y["bin"] >= F.element_at(table, F.concat(y["enc"], y["class"].cast("string"))), F.lit(False)) & ~y["natural"])
    else:
        flagged = F.transform("v", lambda y: F.lit(False))
    return prepared.withColumn("flag", flagged).select("doc_id", "assign", "access", "hex", F.expr("filter(tokens, (x, i) -> flag[i])").alias("random"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"), whole=True)
    shown = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.format_string("%s:%d:%d", x["name"], x["s"], x["e"])), ",")
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(F.concat("assign", "access", "hex")), 256).alias("base_sha256"), shown(F.concat("assign", "access", "hex", "random")).alias("spans"))
