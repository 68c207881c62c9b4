"""The training-data operators against brute force, and on nulls, ties, repeats, empty and odd tables."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from cairn.llm import ann, bpe, components, fingerprint, langid, linededup, lm, mixing, near, quality, registry, simhash, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, line int, word string, key string, node int, id int"
ODD = [None, "", " ", "a", "A b", "a b c", "The same text again and again here.", "The same text again and again here.", "x" * 300_000, "word " * 40_000, "\n\n\n", "Ünïcödé ﬁ ½ É É", "123 !!"]


def docs_of(spark, texts, ids=None):
    """Rows with extra columns whose names clash with those that operators use."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if n % 2 else None, f"s{n % 3}", len(t or ""), 0.5, 1, "w", "k", 2, 3) for n, (i, t) in enumerate(zip(ids, texts))], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD + ["repeated row", "repeated row", "no id"], [*range(len(ODD)), 50, 50, None])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def documents(sf):
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


# 1


def test_mixing_equals_sql(spark, sf, same_as_sql):
    same_as_sql(mixing.query(spark, sf), mixing.SQL)


def test_mixing_meets_targets_and_keeps_odd_rows(spark, odd, none, sf):
    d = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), {d: 0.5 for d in mixing.DIMS}, 0.3).toPandas()
    for dim in mixing.DIMS:
        mass = (d.n_tokens * d.weight).groupby(d[dim]).sum() / d.n_tokens.sum()
        want = d.n_tokens.groupby(d[dim]).sum() ** 0.5
        assert np.allclose(mass, want / want.sum(), atol=1e-3)
    assert abs((d.n_tokens * d.probability).sum() / d.n_tokens.sum() - 0.3) < 1e-3
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) + 3 and {r.lang for r in got} == {"en", mixing.NONE}
    assert mixing.mix(none).count() == 0


def test_many_cells_are_raked_alike(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 4)
    rows = [(f"s{i % 7}", f"l{i % 3}", f"t{i % 2}", float(i * i % 50)) for i in range(42)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    targets = {d: mixing.targets_of(cells, d, 0.5) for d in mixing.DIMS}
    a, b = (mixing.rake(cells, targets, 0.4, most).toPandas().sort_values(mixing.DIMS) for most in (1000, 1))
    assert np.allclose(a.weight, b.weight) and np.allclose(a.probability, b.probability)


# 2


def test_quality_learns(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["river", "stone", "green", "paper", "window"]) for _ in range(60)) + "." for _ in range(150)]
    bad = [" ".join(rng.choice(["$$$", "###", "buy!!", "%%%", "now!!"]) for _ in range(60)) for _ in range(150)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    held = quality.id_bucket("doc_id", 5)
    model = quality.fit(docs, labels, usable=held != 0)
    rows = quality.with_score(docs.select("doc_id", "text"), model).where(held == 0).collect()
    assert len(rows) > 40 and all((r.score >= 0.5) == (r.doc_id < 150) for r in rows)


def test_quality_of_odd_rows(spark, odd, none):
    net = quality.new_net()
    rows = quality.with_score(odd.select("doc_id", "text"), net).collect()
    assert len(rows) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in rows)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.text or ""].add(r.score)
    assert all(max(s) - min(s) < 1e-5 for s in by.values())  # sums of 32-bit numbers
    assert quality.with_score(none.select("doc_id", "text"), net).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 1)], "doc_id bigint, quality int")
    assert quality.fit(odd, labels) == pytest.approx(2 / 3) and quality.fit(odd, labels.where("false")) == 0.5


def slow_score(net, text):
    """The forward pass in plain loops."""
    windows = max(1, -(-len(text) // quality.STEP))
    data = text.ljust((windows + 1) * quality.STEP, b"\0")
    filters = np.concatenate([net.first, net.second]).astype(float)
    response = []
    for w in range(windows):
        x = np.concatenate([net.embed[b] for b in data[w * quality.STEP : w * quality.STEP + quality.WIDTH]]).astype(float)
        response.append(np.maximum(x @ filters + net.bias, 0))
    maxima, at = [], 0
    while True:
        maxima.append(np.max(response[at : at + quality.CHUNK], axis=0))
        if at + quality.CHUNK >= windows:
            break
        at += quality.CHUNK_STEP
    z = np.r_[np.max(maxima, axis=0), np.mean(maxima, axis=0)] @ net.out + net.base[0]
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("segment", [1024, 2])
def test_quality_equals_brute_force(monkeypatch, segment):
    monkeypatch.setattr(quality, "SEGMENT", segment)
    rng = np.random.default_rng(0)
    net = quality.new_net()
    net.bias[:] = rng.normal(size=quality.FILTERS)
    texts = [rng.integers(1, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 7, 8, 1020, 1024, 1028, 5000, 9001)]
    assert np.allclose(quality.score(net, texts), [slow_score(net, t) for t in texts], atol=1e-5)


@pytest.mark.parametrize("segment", [1024, 2])
def test_quality_gradients(monkeypatch, segment):
    monkeypatch.setattr(quality, "SEGMENT", segment)
    rng = np.random.default_rng(3)
    net = quality.new_net(2)
    for p in net.parameters():
        p[...] = p + 0.1 * rng.normal(size=p.shape).astype(np.float32)
    wide = quality.Net(*(p.astype(np.float64) for p in net.parameters()))
    texts = [rng.integers(1, 60, n, dtype=np.uint8).tobytes() for n in (0, 30, 3000)]
    label, weight = np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        s = np.array([slow_score(wide, t) for t in texts])
        return -(weight * (label * np.log(s) + (1 - label) * np.log(1 - s))).sum()

    for p, g in zip(wide.parameters(), quality._gradients(net, texts, label, weight)):
        for at in rng.choice(p.size, min(p.size, 4), replace=False):
            flat = p.reshape(-1)
            keep, step = flat[at], 1e-5
            flat[at] = keep + step
            up = loss()
            flat[at] = keep - step
            down = loss()
            flat[at] = keep
            assert np.asarray(g).reshape(-1)[at] == pytest.approx((up - down) / (2 * step), abs=2e-3, rel=2e-2)


def test_quality_replaces_a_column(spark, odd):
    out = quality.with_score(odd, quality.new_net())
    assert out.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in out.select("score").collect())
    assert quality.with_score(odd, 0.25).select("score").distinct().collect() == [(0.25,)]


# 3


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(*bpe.default_files())


@pytest.fixture(scope="module")
def tik(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.default_files()[1], mergeable_ranks=encoder.ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, odd, documents, encoder, tik):
    texts = [t or "" for t in ODD] + [r[1] for r in documents] + ["<|endoftext|>", "\0\x01", "😀" * 500, "é" * 4000]
    got = encoder.encode_texts(texts)
    assert all(tik.encode_ordinary(t) == ids.tolist() for t, ids in zip(texts, got))
    assert all(encoder.decode(ids) == t.encode() for t, ids in zip(texts, got))
    rows = bpe.digests(bpe.encode(odd, *bpe.default_files())).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(ODD):
            ids = tik.encode_ordinary(ODD[r.doc_id] or "")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest()


def test_bpe_of_no_rows(none):
    assert bpe.digests(bpe.encode(none, *bpe.default_files())).count() == 0


def test_bpe_forgets_and_goes_on(encoder, tik, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    for t in ("one two three four five six", "seven eight nine ten eleven", "one two"):
        assert encoder.encode_texts([t])[0].tolist() == tik.encode_ordinary(t)
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 40)
    for t in ("a" * 100, "one two three", "b" * 30 + " seven", "one"):
        assert encoder.encode_texts([t])[0].tolist() == tik.encode_ordinary(t)


# 4


def brute(x, ids, q, top=10):
    d = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(axis=1))
    order = np.lexsort((ids, d))
    return [(int(ids[i]), d[i]) for i in order if ids[i] != q][:top]


def test_ann_recall(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = ann.search(ann.usable(vectors).where("id % 50 = 0"), vectors).toPandas().sort_values(["query_id", "rank"])
    hits = 0
    for q, g in got.groupby("query_id"):
        want = brute(x, ids, q)
        hits += len({i for i, _ in want} & set(g.vec_id))
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(np.sort(g.score), g.score)
        assert np.allclose([d for i, d in brute(x, ids, q, len(ids)) if i in set(g.vec_id)], g.score)
    assert got.query_id.nunique() == (ids % 50 == 0).sum() and hits >= 0.9 * len(got)


def test_ann_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [1.0, 0.0]), (None, [1.0, 1.0]), (10, [3.0, 4.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(ann.usable(v).where("id % 10 = 0"), v).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 9), (0, 3, 2), (0, 4, 10), (10, 1, 2), (10, 2, 0), (10, 3, 1), (10, 4, 9)]
    assert ann.search(ann.usable(v.where("false")), v.where("false")).count() == 0


def test_split_cells_do_not_part_the_graph(spark, monkeypatch):
    """All nodes are in the same cells, and all cells are split into as many parts."""
    monkeypatch.setattr(ann, "CELL", 60)
    monkeypatch.setattr(ann, "PIVOTS", 6)
    x = np.random.default_rng(2).normal(size=(600, 4))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    got = ann.build_graph(nodes, ann._pivots(nodes, len(x))[1], len(x)).toPandas()
    hits = sum(len({i for i, _ in brute(x, np.arange(600), q)} & set(g.b)) for q, g in got.groupby("a"))
    assert hits >= 0.9 * 10 * len(x)


@pytest.mark.parametrize("kind", ["large", "small", "mixed", "offset"])
def test_ann_of_any_magnitude(spark, kind):
    x = np.random.default_rng(7).normal(size=(900, 8))
    if kind == "large":
        x *= 1e5
    elif kind == "small":
        x *= 1e-10
    elif kind == "mixed":
        x[::20] *= 1e5
        x[1::20] *= 1e-10
    else:
        x += 1e5
    x = x.astype(np.float32).astype(np.float64)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = ann.search(ann.usable(v).where("id % 20 < 2 AND id % 3 = 0"), v).toPandas().sort_values(["query_id", "rank"])
    hits = 0
    for q, g in got.groupby("query_id"):
        want = brute(x, np.arange(900), q)
        hits += len({i for i, _ in want} & set(g.vec_id))
        assert np.allclose(g.score, np.sqrt(((x[g.vec_id] - x[q]) ** 2).sum(axis=1)), rtol=1e-12)
    assert got.query_id.nunique() == 30 and len(got) == 300 and hits >= 0.9 * len(got)


def test_exact_scan_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    x = np.random.default_rng(8).integers(0, 3, size=(200, 3)).astype(float) + 1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>").repartition(3)
    found = collections.defaultdict(list)
    for r in ann.exact(rows.where("id % 10 = 0"), rows, 5).collect():
        found[r.query_id].append((r.d, r.id))
    assert {q: [i for _, i in sorted(f)[:5]] for q, f in found.items()} == {q: [i for i, _ in brute(x, np.arange(200), q, 5)] for q in range(0, 200, 10)}


# 5


def test_urls_equal_sql(spark, sf, same_as_sql):
    same_as_sql(url_filter.query(spark, sf), url_filter.SQL)


def test_urls_that_are_odd(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.net/en/a", "http://example.net", "http://net/", "ftp://a.org/fr/#x", "x://notexample.com/de/", "x://example.com/de/?q", "x://example.com?/de/", "a://b://net/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, "x://b.net/", "c"), (5, "http://net/", "c")], "page_id bigint, url string, rule string")
    entries = spark.createDataFrame([*url_filter.RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, entries).collect())
    want = [
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "example.net", "/en/a", "example.net/en/", "allow"),
        (4, "example.net", "", None, "allow"), (5, "net", "/", "net/", "block"), (5, "net", "/", "net/", "block"), (6, "a.org", "/fr/", "org/fr/", "allow"),
        (7, "notexample.com", "/de/", None, "allow"), (8, "example.com", "/de/", "example.com/de/", "block"), (9, "example.com", "", None, "allow"),
        (10, "b:", "//net/", None, "allow"), (None, "b.net", "/", "net/", "block"),
    ]
    assert got == collections.Counter(want)
    assert url_filter.judge_urls(pages, entries.where("false")).where("rule is not null").count() == 0
    assert url_filter.judge_urls(pages.where("false"), entries).count() == 0


def test_lists_of_many_shapes(spark):
    """Full URLs of all lengths as entries, against brute force."""
    rng = random.Random(3)
    name = lambda n: "".join(rng.choice("ab") for _ in range(n))
    entries = list({(f"{name(2)}.{name(1)}" if i % 3 else name(1), "/" + name(rng.randrange(60)), rng.choice(["block", "allow"])) for i in range(900)})
    entries = list({(h, p): (h, p, v) for h, p, v in entries}.values())
    urls = [f"x://{rng.choice(['', 'q.'])}{name(2)}.{name(1)}/{name(rng.randrange(80))}?{name(3)}" for _ in range(600)] + [f"x://s.{h}{p}z" for h, p, _ in entries[:200]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, spark.createDataFrame(entries, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        host, _, path = u.removeprefix("x://").partition("/")
        path = ("/" + path).partition("?")[0]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in entries if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow")), u


def test_long_lists_go_through_a_table(spark, monkeypatch):
    entries = spark.createDataFrame([(f"h{i}.example", f"/p{i % 3}/", "block") for i in range(500)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://www.h{i}.example/p{i % 3 if i % 2 else 9}/x") for i in range(800)], "page_id bigint, url string")
    want = {i for i in range(500) if i % 2}
    for most in (1 << 16, 1):
        monkeypatch.setattr(url_filter, "MAX_LITERAL_WORDS", most)
        assert {r.page_id for r in url_filter.judge_urls(pages, entries).where("verdict = 'block'").collect()} == want


# 6


def brute_keys(line):
    """(needed documents, template) of all that a line belongs to, spelled out."""
    toks = re.findall(r"[^\x20\x09-\x0D]+", line)
    chars = len(line.strip(" \t\n\r\v\f"))
    n, out = len(toks), []
    if not re.search(r"[A-Za-z\x80-\U0010ffff]", line):
        return out
    if n >= linededup.MIN_TOKENS and len(line.encode()) >= linededup.SHORT_CHARS or chars >= linededup.LONG_CHARS:
        out.append((linededup.MIN_DOCS, tuple(toks)))
    elif chars >= linededup.SHORT_CHARS:
        return [(linededup.SHORT_DOCS, tuple(toks))]
    if n < linededup.MIN_TOKENS or not out:
        return out
    masked = ["<*>" if re.search("[0-9]", t) else t for t in toks]
    open_blocks = [[]] if "<*>" in masked else []
    width = (n - linededup.DEPTH) // 4
    if width:
        open_blocks += [range(a, min(a + width, n)) for a in range(linededup.DEPTH, n, width)]
    for block in open_blocks:
        shown = tuple("<?>" if i in block else t for i, t in enumerate(masked))
        constant = sum(t not in ("<*>", "<?>") for t in shown)
        if constant >= linededup.CONSTANTS and 2 * constant >= n:
            out.append((linededup.TEMPLATE_DOCS, (tuple(block), shown)))
    return out


def brute_lines(rows):
    owners = collections.defaultdict(set)
    for at, (i, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            for k in brute_keys(line):
                owners[k].add((i, at))
    first = {k: min(o)[0] for k, o in owners.items() if len(o) >= k[0]}
    out = {}
    for i, text in rows:
        kept = [line for line in (text or "").split("\n") if all(first.get(k, i) == i for k in brute_keys(line))]
        out[i] = "\n".join(kept) if text is not None else None
    return out


LINES = [
    "Order 17 has been sent to you today.\nA line of its own stands here.", "Order 4711 has been sent to you today.", "Order 5 has been sent to us today.",
    "One two three four five six seven eight\nOne two three four five six seven nine", "One two three four five six seven ten",
    "Was erlytion that. Anea.", "Was erlytion that. Ansh.", "Was erlytion that. Bnsh.", "2019 12 3.5 7", "2020 11 3.6 8", "2021 10 3.7 9", "2019 12 3.5 7",
    "这是一个没有空格的句子它在许多文档中重复出现所以应当删除", "这是一个没有空格的句子它在许多文档中重复出现所以应当删除", *["Kept for all.\nYes"] * 11,
]


def test_lines_equal_brute_force(spark, sf, documents):
    rows = [(r[0], r[1]) for r in documents] + [(9000 + n, t) for n, t in enumerate(LINES)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in linededup.drop_recurring(df).collect()}
    want = brute_lines(rows)
    assert {i for i in want if got[i] != want[i]} == set()
    assert got[9000] == LINES[0] and got[9001] == "" and got[9002] == ""
    assert [got[9000 + n] for n in range(3, 12)] == LINES[3:12], "two documents, though three lines; too few constant tokens; only numbers"
    assert got[9012] == LINES[12] and got[9013] == "" and got[9014] == LINES[14] and got[9015] == "Yes"


def test_lines_equal_sql(spark, sf, same_as_sql):
    same_as_sql(linededup.query(spark, sf), linededup.SQL)


def test_lines_of_odd_rows(spark, odd, none):
    rows = linededup.drop_recurring(odd).collect()
    assert len(rows) == len(ODD) + 3
    got = {r.doc_id: r.text for r in rows}
    assert got[0] is None and got[1] == "" and got[6] == ODD[6] and got[7] == "" and got[10] == "\n\n\n" and got[8] == ODD[8]
    assert linededup.drop_recurring(none).count() == 0
    clash = spark.createDataFrame([(1, "the same line once more", "k", 7, "l"), (2, "the same line once more", "k", 7, "l")], "doc_id bigint, text string, _key string, n_dropped int, lost string")
    out = linededup.drop_recurring(clash)
    assert out.columns == ["doc_id", "text", "_key", "lost", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(1, "the same line once more", "k", "l", 0), (2, "", "k", "l", 1)]


# 7


def canonical(text):
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(r"\s+", " ", text).strip(" ")


def test_fingerprints_equal_brute_force(spark, sf, documents):
    got = {r.doc_id: r for r in fingerprint.query(spark, sf).collect()}
    texts = [r[1] or "" for r in documents]
    wide = lambda t: f"{xxhash.xxh64_intdigest(canonical(t).encode(), 42):016x}"
    for n, (i, *_) in enumerate(documents):
        t, after = texts[n], texts[(n + 1) % len(texts)]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint[:16] == wide(t) and r.edited_fingerprint[:16] == wide(edited)
        assert r.near_edited == (canonical(t) == canonical(edited)) and r.near_next == (canonical(t) == canonical(after))
    first = {}
    for (i, *_), t in zip(documents, texts):
        first.setdefault(canonical(t), i)
    assert all(got[i].group_id == first[canonical(t)] for (i, *_), t in zip(documents, texts)) and len(first) < len(texts)


def test_fingerprints_of_odd_rows(spark, odd, none):
    rows = fingerprint.edit_and_compare(odd).collect()
    assert len(rows) == len(ODD) + 3 and sum(r.doc_id == 50 for r in rows) == 2
    by = collections.defaultdict(set)
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(ODD):
            by[ODD[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(s) == 1 for s in by.values())
    assert fingerprint.edit_and_compare(none).count() == 0
    one = fingerprint.edit_and_compare(docs_of(spark, ["abcdefgh"])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_exact_groups(spark, odd):
    same = ["É", "E\u0301", " é ", "ﬁn", "FIN", "x"]
    got = {r.doc_id: r.group_id for r in fingerprint.exact_groups(docs_of(spark, same)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert fingerprint.exact_groups(odd).count() == len(ODD) + 3


def test_unequal_texts_of_one_fingerprint(spark, monkeypatch):
    """The comparison of bytes holds where digests say nothing."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprint, "digest", lambda canon: F.concat(F.lit("0"), F.substring(canon, 1, 1)))
    docs = docs_of(spark, ["ab", "ac", "AB", "b", "B ", "ab", "x"])
    assert {r.doc_id: r.group_id for r in fingerprint.exact_groups(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3, 5: 0, 6: 6}
    assert [r.near_next for r in fingerprint.edit_and_compare(docs).orderBy("doc_id").collect()] == [0, 0, 0, 1, 0, 0, 0]


def test_texts_that_occur_once_are_not_shuffled(spark):
    """However many fingerprints recur, too many to broadcast or not."""
    texts = [hashlib.shake_256(b"%d" % i).hexdigest(2000) for i in range(1500)]
    docs = docs_of(spark, texts + texts[:60]).repartition(4).localCheckpoint()
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    threshold, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), sent()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.group_id for r in fingerprint.exact_groups(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {i: i % 1500 for i in range(1560)}
    assert sent() - before < 0.3 * sum(map(len, texts))


def test_filter_of_fingerprints_loses_none(spark, monkeypatch):
    from pyspark.sql import functions as F

    keys = spark.range(0, 90_000, 3).select(F.col("id").cast("string").alias("k"))
    df = spark.range(100_000).select(F.col("id").cast("string").alias("k"))
    for most, passing in ((fingerprint.FILTER_BITS, 0.1), (1 << 15, 0.7)):
        monkeypatch.setattr(fingerprint, "FILTER_BITS", most)
        got = {int(r.k) for r in fingerprint.may_be_in(df, keys, "k").collect()}
        assert got >= set(range(0, 90_000, 3)) and len(got) < 30_000 + passing * 70_000
    assert fingerprint.may_be_in(df, keys.limit(0), "k").count() == 0


def test_neighbours_of_one_id_or_none(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_PART", 40)
    rows = [(None, f"n{i}") for i in range(500)] + [(77, f"s{i}") for i in range(900)] + [(i, f"t{i}") for i in range(300) if i != 77]
    got = collections.Counter((r.text, r.next_text) for r in fingerprint.with_next(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", ["text"]).collect())
    after = dict(got.keys())
    assert len(after) == len(rows) and set(after.values()) == {t for _, t in rows} and max(got.values()) == 1
    order, at = [], "t299"
    for _ in rows:
        at = after[at]
        order.append(at)
    kinds = [t[0] if t[0] != "t" else int(t[1:]) for t in order]
    assert kinds == ["n"] * 500 + list(range(77)) + ["s"] * 900 + list(range(78, 300))


def test_neighbours_over_many_ranges(spark):
    ids = [7 * i * i % 100_003 for i in range(3000)]
    df = spark.createDataFrame([(i, f"t{i}") for i in set(ids)] + [(10**15, "far")], "doc_id bigint, text string")
    got = {r.text: r.next_text for r in fingerprint.with_next(df, "doc_id", ["text"]).collect()}
    order = [f"t{i}" for i in sorted(set(ids))] + ["far"]
    assert got == dict(zip(order, order[1:] + order[:1]))


# 8


def test_languages(spark):
    rng = random.Random(2)
    words = {"en": "the of and to river stone green house".split(), "fr": "les des une être rivière maison verte où".split(), "ru": "река камень дом зелёный и это на где".split()}
    texts = [" ".join(rng.choice(words[k]) for _ in range(30)) for k in words for _ in range(20)]
    docs = spark.createDataFrame([(i, t, list(words)[i // 20]) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    mixed = "the river and green house of stone les maison verte où être une rivière река камень дом"
    asked = docs_of(spark, [mixed, None, "", "12 !", "это где"])
    got = {r.doc_id: r for r in langid.predict(asked, model).collect()}
    assert [(mixed[s.start : s.end].split()[0], s.lang) for s in got[0].spans] == [("the", "en"), ("les", "fr"), ("река", "ru")]
    assert [got[i].lang_pred for i in range(1, 5)] == ["und", "und", "und", "ru"] and got[1].score == 0 and got[4].score == 1
    nothing = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(asked, nothing).collect()} == {"und"}


def test_languages_held_out(spark, sf, documents):
    got = langid.query(spark, sf).collect()
    lang = {r[0]: r[2] for r in documents}
    held = [r for r in got if r.held_out]
    assert len(got) == len(documents) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_word_scores_equal_brute_force(monkeypatch):
    """Letters with their neighbours, one word at a time, and the script of the first letter by its range."""
    import bisect

    rng = np.random.default_rng(4)
    texts = ["Der Fluß, naïve Ärzte", "", "12 ab3cd", "река и дом 漢字かな", "İstanbul e\u0301te", "x"]
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), rng.choice([0, -1e4], (len(langid.SCRIPTS), 3)).astype(np.float32))
    want = []
    for n, t in enumerate(texts):
        for m in re.finditer(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*", t):
            low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in m[0]]
            score = np.zeros(3)
            for x, y, z in zip([0, *low[:-1]], low, [*low[1:], 0]):
                h = ((x << 42) ^ (y << 21) ^ z) * 0x9E3779B97F4A7C15 % 2**64
                score += model.logp[h >> 49]
            script = langid.RANGES[bisect.bisect([r for r, _ in langid.RANGES], ord(m[0][0])) - 1][1]
            want.append((n, m.start(), m.end(), score + model.barred[langid.SCRIPTS.index(script)]))
    for at_once in (2, 1 << 15):
        monkeypatch.setattr(langid, "WORDS_AT_ONCE", at_once)
        w = langid.words_of(texts)
        got = langid.word_scores(model, w)
        assert [(int(a), int(b), int(c)) for a, b, c in zip(w.text, w.start, w.end)] == [x[:3] for x in want]
        assert np.allclose(got, [x[3] for x in want], atol=1e-3)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    size = [5, 1, 3, 4]
    score = rng.normal(0, 3, (sum(size), 3)).astype(np.float32)
    text = np.repeat(np.arange(4), size)
    got = langid.viterbi(score, text, 2.0)
    at = 0
    for n in size:
        s = score[at : at + n]
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        value = s[np.arange(n), paths].sum(axis=1) - 2.0 * (paths[:, 1:] != paths[:, :-1]).sum(axis=1)
        assert got[at : at + n].tolist() == paths[value.argmax()].tolist()
        at += n


def test_languages_of_odd_rows(odd, none):
    model = langid.fit(odd)
    assert langid.predict(odd, model).count() == len(ODD) + 3 and langid.predict(none, model).count() == 0


# 9


def sim(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(prints, radius):
    up = list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [top(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark, sf, documents):
    got = {r.doc_id: r for r in simhash.query(spark, sf).collect()}
    prints = [sim(r[1]) for r in documents]
    group = groups_of(prints, 3)
    for n, (i, *_) in enumerate(documents):
        assert got[i].fingerprint == f"{prints[n]:016x}" and got[i].component_id == documents[group[n]][0]


@pytest.mark.parametrize("shape", ["near", "far", "chain", "mixed"])
def test_bit_sliced_links(shape):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    if shape == "near":
        prints = [flip(base, int(rng.integers(0, 3))) for _ in range(120)]
    elif shape == "far":
        prints = [int(x) for x in rng.integers(0, 2**63, 90)]
    elif shape == "chain":
        prints = [base]
        for b in range(60):
            prints.append(prints[-1] ^ 1 << b)
    else:
        prints = [int(x) for x in rng.integers(0, 2**63, 40)] + [flip(base, 2) for _ in range(40)]
    prints = list(dict.fromkeys(prints))
    rng.shuffle(prints)
    fp = np.array(prints, dtype=np.uint64)[:, None]
    node = np.arange(len(fp))
    want = groups_of(prints, 3)
    for small in (True, False):
        links = simhash.small_links if small else None
        bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
        a, b = links(np.zeros(len(fp), np.int64), bits, 3) if small else simhash.large_links(bits, 3)
        if small:
            assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == {(j, i) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3}
        low = simhash._forest(a, b, len(fp))
        assert low.tolist() == want
    a, b = simhash.links_of_sorted(np.zeros(len(fp), np.int64), node, fp, 3)
    assert simhash._forest(a, b, len(fp)).tolist() == want


def test_simhash_of_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) + 3
    by = {r.doc_id: r.component_id for r in got}
    assert by[0] == by[1] == by[2] == by[10] == 0 and by[6] == by[7] == 6 and by[50] == 50
    assert simhash.near_duplicates(none).count() == 0


def test_exact_masks_lose_no_link():
    rng = np.random.default_rng(0)
    masks = simhash.exact_masks(3, 3)[:, 0]
    for _ in range(300):
        difference = np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
        assert (masks & difference == 0).any()


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 20)] + [(1000, 2000 + i) for i in range(80)] + [(5, 5), (None, 3), (3000, 3001)] + [(rng.randrange(4000, 4050), rng.randrange(4000, 4050)) for _ in range(40)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    nodes = sorted({x for p in links if None not in p and p[0] != p[1] for x in p})
    up = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if None not in (a, b) and a != b and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    assert {r.node: r.component for r in components.connected_components(df).collect()} == up


# 10


def test_lm_base_equals_brute_force(spark, sf, documents):
    got = {r.doc_id: r for r in lm.query(spark, sf).collect()}
    tokens = [(t or "").encode().lower().split() + [None] for _, t, *_ in documents]
    learns = [zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in documents]
    c = collections.Counter(x for w, k in zip(tokens, learns) if k for x in w)
    n, v = sum(c.values()), len(c)
    for (i, *_), w, k in zip(documents, tokens, learns):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, not k)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    # The model itself, but for the rounding of its tables.
    pairs = collections.Counter((b, a) for w, k in zip(tokens, learns) if k for a, b in zip([b" start ", *w], w))
    follow = collections.Counter(a for w, k in zip(tokens, learns) if k for a in [b" start ", *w[:-1]])
    own = lambda a: float(lm.share(np.array([follow[a]]))[0])
    exact = lambda a, b: (1 - own(a)) * (c[b] + 1) / (n + v + 1) + own(a) * pairs[b, a] / max(follow[a], 1)
    off = [abs(got[i].score - sum(math.log10(exact(a, b)) for a, b in zip([b" start ", *w], w))) / len(w) for (i, *_), w in zip(documents, tokens)]
    assert np.mean(off) < 0.03
    held = [got[i] for (i, *_), k in zip(documents, learns) if not k]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_with_many_shards(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learn = lm.id_bucket("doc_id", 7) != 2
    one = {r.doc_id: r for r in lm.score_texts(docs, learn).collect()}
    monkeypatch.setattr(lm, "SHARD_TOKENS", 9000)
    many = {r.doc_id: r for r in lm.score_texts(docs, learn).collect()}
    assert all(math.isclose(one[i].base_score, many[i].base_score, rel_tol=1e-9) and one[i].n_known == many[i].n_known and abs(one[i].score - many[i].score) < 0.03 * one[i].n_tokens for i in one)


def test_lm_counts_every_predecessor_by_itself(spark):
    """A rare predecessor beside frequent ones, wherever their hashes fall: words that share 23 bits keep their counts."""
    from pyspark.sql import functions as F

    by = collections.defaultdict(list)
    for i in range(20_000):
        by[int(lm._context(np.array([xxhash.xxh64_intdigest(f"w{i}")], dtype=np.uint64))[0]) >> 9].append(f"w{i}")
    pairs = [p[:2] for p in by.values() if len(p) > 1][:10]
    assert len(pairs) == 10
    texts = [f"{rare} t{n}" for n, (rare, _) in enumerate(pairs)] + [f"{often} x " * 400 for _, often in pairs]
    got = {r.doc_id: r.score for r in lm.score_texts(docs_of(spark, texts), F.lit(True)).collect()}
    tokens = [t.split() + [None] for t in texts]
    c = collections.Counter(x for w in tokens for x in w)
    n, v = sum(c.values()), len(c)
    both = collections.Counter((a, b) for w in tokens for a, b in zip([None, *w], w))
    own = lambda a: float(lm.share(np.array([c[a]]))[0])
    p = lambda a, b: (1 - own(a)) * (c[b] + 1) / (n + v + 1) + own(a) * both[a, b] / c[a]
    for i, w in enumerate(tokens):
        assert abs(got[i] - sum(math.log10(p(a, b)) for a, b in zip([None, *w], w))) < 0.02 * len(w)


def test_lm_frequent_pairs_are_spread_and_models_last(spark, monkeypatch):
    """Empty texts and one repeated word fill pairs of their own; a kept model scores another table as the one pass does."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    texts = [""] * 300 + ["a a a a a a"] * 200 + [" ".join(rng.choice("b c d e f g h i".split()) for _ in range(20)) for _ in range(60)]
    docs = docs_of(spark, texts)
    one = {r.doc_id: r for r in lm.score_texts(docs, F.col("doc_id") % 2 == 0).collect()}
    monkeypatch.setattr(lm, "SHARD_TOKENS", 300)
    many = {r.doc_id: r for r in lm.score_texts(docs, F.col("doc_id") % 2 == 0).collect()}
    assert len(many) == len(texts)
    for i, r in one.items():
        assert math.isclose(r.base_score, many[i].base_score, rel_tol=1e-9) and abs(r.score - many[i].score) < 0.02 * r.n_tokens and r.n_known == many[i].n_known
    rows, ids = lm._keyed(docs, F.lit(True), "doc_id", "text")
    plan, _ = lm._plan(rows, ids)
    assert plan.shards > 3 and len(plan.hot.pair) >= 2
    empty = np.full(300, lm.END)
    at = lm._shards(empty, lm._context(np.full(300, lm.START)), plan.shards, plan.hot, np.arange(300, dtype=np.uint64))
    assert len(set(at.tolist())) == plan.shards
    model = lm.fit(docs.where("doc_id % 2 = 0"))
    kept = {r.doc_id: r for r in lm.score(model, docs.where("doc_id % 3 = 0")).collect()}
    assert len(kept) == sum(i % 3 == 0 for i in one)
    for i, r in kept.items():
        assert abs(r.score - one[i].score) < 0.02 * r.n_tokens and r.n_known == one[i].n_known and abs(r.base_score - one[i].base_score) < 0.01 * r.n_tokens


def test_lm_looks_up_each_pair_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = [f"the cat sat on mat {i % 7} and the cat slept" for i in range(700)] + ["", "unheard words"]
    rows, ids = lm._keyed(docs_of(spark, texts), F.col("doc_id") < 500, "doc_id", "text")
    plan, contexts = lm._plan(rows, ids)
    dealt = [r.asDict() for r in lm.route(rows, plan.shards, plan.hot).unionByName(contexts).collect()]
    sought, find = [], lm.EliasFano.successor
    monkeypatch.setattr(lm.EliasFano, "successor", lambda self, value: sought.append(len(value)) or find(self, value))
    sums = lm.score_shard(dealt, plan.n, plan.v, plan.hot)
    words = [["", *t.split(), "end"] for t in texts]
    pairs = {p for w in words for p in zip(w, w[1:])}
    assert plan.shards == 1 and sum(sums[1]) == sum(len(w) - 1 for w in words)
    assert 0 < sum(sought) <= len(pairs) + len({b for _, b in pairs})
    wording = {r.key: r.text for r in rows.collect()}
    assert len({(wording[k], round(x, 9)) for k, x in zip(sums[0].tolist(), sums[4].tolist())}) == 9  # texts of one wording score alike


def test_trie_keeps_pairs_apart():
    """More pairs than 24 bits can tell apart: all 32 are kept."""
    words = np.array([1 << 60], dtype=np.uint64)
    for contexts in (np.arange(5000, dtype=np.uint32), np.arange(0, 2**32, 2**20, dtype=np.uint64).astype(np.uint32)):
        log_p = np.linspace(-3, -1, len(contexts))
        trie = lm.Trie(lm.Trie.build(words, np.array([-5.0]), np.zeros(len(contexts), np.int64), contexts, log_p))
        got = trie.log10(np.full(len(contexts), words[0]), contexts, np.zeros(len(contexts)), -9.0)
        assert np.abs(got - log_p).max() < 0.01
        assert trie.log10(words, np.array([contexts[7] + 1 if len(contexts) < 5000 else 9999], np.uint32), np.array([0.5]), -9.0)[0] == pytest.approx(-5 + math.log10(0.5), abs=1e-3)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, universe in ((1, 10), (1000, 1001), (5000, 1 << 40), (3000, 3000 << 16)):
        v = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
        ef = lm.EliasFano(n, *lm.EliasFano.parts(v, universe))
        assert (ef.get(np.arange(n)) == v).all()
        q = rng.integers(0, universe, 500, dtype=np.uint64)
        at, equal = ef.successor(q)
        assert (at == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all()


def test_lm_of_odd_rows(odd, none):
    from pyspark.sql import functions as F

    got = lm.score_texts(odd, F.col("doc_id") != 3).collect()
    assert len(got) == len(ODD) + 3
    by = {r.doc_id: r for r in got}
    assert by[0].n_tokens == by[1].n_tokens == 1 and by[9].n_tokens == 40_001 and by[3].n_known == 2
    assert lm.score_texts(none, F.lit(True)).count() == 0
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in lm.score_texts(odd, F.lit(False)).collect())


# The pipeline


def test_pipeline(spark, sf, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mixing", "tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r[0] for r in documents}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, sf), "test")
        if name != "tokens":
            assert out.columns == docs.columns
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= ids and len(left) == out.count()
        if name == "line_dedup":
            assert left == ids
        if name == "near_dedup":
            by = {r.doc_id: r.component_id for r in near.near_copies(docs).collect()}
            assert left == set(by.values())
        docs, ids = out, left
    assert docs.where("n_tokens > 0").count() > 0


def jaccard_groups(texts, least=0.8):
    """Smallest index that pairs of similarity ``least`` reach, by brute force."""
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if (len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]))]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            changed |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    return low


def edited(rng, words, n, vocabulary):
    own = list(words)
    for at in rng.sample(range(len(own)), n):
        own[at] = rng.choice(vocabulary)
    return own


def test_near_copies_equal_brute_force(spark):
    """Pairs on both sides of the threshold, chains, a group of many, short and odd texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for n in range(60):  # similarities from 0.5 to 1
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 400))]
        texts += [" ".join(base), " ".join(edited(rng, base, max(1, len(base) * (n % 10) // 120), vocabulary)), " ".join(edited(rng, base, len(base) // 45, vocabulary))]
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(30):  # each like the one before, not like those before that
        chain = edited(rng, chain, 3, vocabulary)
        texts.append(" ".join(chain))
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts += [" ".join(edited(rng, base, rng.randrange(0, 6), vocabulary)) for _ in range(80)]
    texts += [t for t in ODD] + ["a b c d e", "A B c d e", "a b c d e f", "\t", "a b"]
    df = spark.createDataFrame([(i, t, "fp", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, fp string, node int")
    want = jaccard_groups(texts)
    assert 0.3 < len(set(want)) / len(want) < 0.9
    got = {r.doc_id: r.component_id for r in near.near_copies(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert near.near_copies(df.where("false")).count() == 0


def test_keys_of_near_copies_meet():
    """Of texts of similarity 0.8, nearly all share a key and are within the radius."""
    rng = np.random.default_rng(1)
    met = close = 0
    for n in range(400):
        size = int(rng.integers(20, 400))
        h = rng.integers(0, 2**63, size * 10, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(h[: size * 9]), np.sort(np.r_[h[: size * 8], h[size * 9 :]])
        (fa, ka), (fb, kb) = near.print_of(a), near.print_of(b)
        met += bool((ka == kb).any())
        close += (int.from_bytes(fa, "little") ^ int.from_bytes(fb, "little")).bit_count() <= near.RADIUS
    assert met >= 396 and close >= 398


def test_pipeline_keeps_odd_rows(spark, odd, none, sf):
    documents = [f for f in odd.columns if f in ("doc_id", "text", "lang", "source", "n_chars")]
    for frame in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf)
            assert out.columns == frame.columns and out.count() <= len(ODD) + 3
        assert corpus_pipeline.token_stage(spark, frame.select(*documents), sf).count() == frame.count()
    assert corpus_pipeline.line_stage(spark, odd.select(*documents), sf).count() == len(ODD) + 3


def test_mixing_stage_decides_row_by_row(spark, sf):
    """Rows of one id that fall into different cells have different probabilities."""
    rows = [(i % 40 if i % 9 else None, "some words of text here " * (1 + i % 5), ["en", "de", None][i % 3], f"s{i % 4}", 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    decided = mixing.mix(docs, corpus_pipeline.TEMPERATURES, corpus_pipeline.KEEP)
    kept = collections.Counter((r.doc_id, r.source, r.lang, r.n_tokens) for r in decided.where("kept").collect())
    got = corpus_pipeline.mixing_stage(spark, docs, sf).collect()
    assert collections.Counter((r.doc_id, r.source, r.lang or mixing.NONE, 5 * (len(r.text) // 24)) for r in got) == kept
    assert 0 < len(got) < len(rows)


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11)) and set(registry.SQL) <= set(registry.QUERIES)
