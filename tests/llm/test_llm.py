"""Operators of callwright.llm on edge cases and against brute force; SQL oracles on the small tables."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from callwright.llm import components, html_extract, jaccard_join, line_dedup, packing, quality_rules, sentencepiece_codec, sharding, substring_dedup, topk_search, url_lists
from callwright.llm.queries import ORACLES, QUERIES
from callwright.plans.compare import compare

from ..conftest import SF_SMALL

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, did string, th string, kept string, own_0 string, h string"
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(30_000))
PASSAGE = "one passage of more than thirteen words that stands in several of the documents here as it is"
TEXTS = [
    (1, "A line that repeats.\n" + PASSAGE + "\n\nend éß中"),
    (2, "a LINE that repeats.  \nsome other words come first " + PASSAGE),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b "),
    (6, LONG),
    (7, LONG + " more"),
    (8, "A line that repeats.\nA line that repeats.\nshort"),
    (8, "A line that repeats.\nA line that repeats.\nshort"),
    (None, "no id here " + PASSAGE),
    (None, None),
    (9, "<|endoftext|> don't ▁ ́x  two  spaces "),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, None if k % 3 else "en", None, None, "x", "y", "z", "o", "h") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck_small, name):
    result = compare(QUERIES[name](spark, SF_SMALL), ORACLES[name], duck_small)
    assert result["ok"], result


# ------------------------------------------------------------- 1 sentencepiece


def test_sentencepiece(edge, nothing):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    enc = sentencepiece_codec.encode(edge, PIECES)
    got = Counter((r.doc_id, tuple(r.ids)) for r in enc.collect())
    assert got == Counter((i, tuple(sp.encode(t or ""))) for i, t in TEXTS)
    for r in enc.collect():
        assert list(r.starts) == sorted(r.starts) and all(a <= b for a, b in zip(r.starts, r.ends))
    back = Counter((r.doc_id, r.text) for r in sentencepiece_codec.decode(enc, PIECES).collect())
    assert back == Counter((i, sp.decode(sp.encode(t or ""))) for i, t in TEXTS)
    for r in sentencepiece_codec.digests(edge, PIECES).collect():
        assert r.n_span_bytes in {len((t or "").encode()) for i, t in TEXTS if i == r.doc_id}
    assert sentencepiece_codec.digests(nothing, PIECES).count() == 0


def test_sentencepiece_spans_name_the_source():
    c = sentencepiece_codec.Codec(sentencepiece_codec.model_bytes(PIECES))
    data = "The café  中\U0001f600 end".encode()
    ids = c.ids(data)
    starts, ends = c.spans(data, ids)
    assert b"".join(data[a:b] for a, b in zip(starts, ends)) == data


def test_character_map_takes_the_longest_prefix():
    """A map built by the library: each replacement and its place in the source."""
    import sentencepiece

    normalizer = getattr(sentencepiece, "SentencePieceNormalizer", None)
    if normalizer is None:
        pytest.skip("this version of the library has no compiled maps")
    n = normalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(n.serialized_model_proto())
    own = sentencepiece_codec.Codec.__new__(sentencepiece_codec.Codec)
    own.rules, own.map, own.fixed, own.plain = proto.normalizer_spec, sentencepiece_codec.CharMap(proto.normalizer_spec.precompiled_charsmap), [], False
    for text in ("ﬁne ① ＡＢ é", "  ½㌔  x ", "plain", "", " "):
        normal, source = own.normalise(text.encode())
        assert normal.decode() == n.normalize(text) and len(source) == len(normal) + 1 and list(source) == sorted(source)


# ------------------------------------------------------------- 2 packing


def check_packing(rows, texts, ids_of):
    per, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        per[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    padding = total = 0
    for parts in windows.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    for i in {i for i, _ in texts}:
        expected = Counter()
        for _, t in (x for x in texts if x[0] == i):
            expected[len(ids_of(t))] += len(ids_of(t))
        got = Counter()
        for r in per[i]:
            got[r.doc_tokens] += r.length
        assert got == expected
    return padding, total


def test_packing(edge, nothing):
    w = packing.WordIds(open(WORDS, "rb").read())
    ids_of = lambda t: np.r_[w.whole([(t or "").encode()])[0], np.array([1], "<u4")]
    rows = packing.pack(edge, WORDS, rank_rows=2).collect()
    padding, total = check_packing(rows, TEXTS, ids_of)
    assert padding < 2048
    for r in rows:
        assert any(zlib.crc32(ids_of(t)[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i, t in TEXTS if i == r.doc_id)
    assert packing.pack(nothing, WORDS).count() == 0
    full = packing.sequences(packing.pack(edge, WORDS, with_ids=True)).collect()
    assert sum(r.n_tokens for r in full) == total and all(len(r.ids) == r.n_tokens <= r.tier for r in full)


def test_word_ids_equal_the_library():
    w = packing.WordIds(open(WORDS, "rb").read())
    draw = random.Random(3)
    signs = "aAzZéÉßñİΣσ'.,!?;:-0 \ń中<|"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 30))).encode() for _ in range(1500)]
    assert w.by_word
    assert [x.tolist() for x in w.ids(texts)] == [x.tolist() for x in w.whole(texts)]


def test_plan_uses_each_piece_once():
    draw = random.Random(5)
    counts = Counter(draw.randint(1, 2048) for _ in range(5000))
    used = Counter()
    for tier, n, parts in packing.plan(counts):
        assert sum(a * b for a, b in parts) <= tier
        for length, times in parts:
            used[length] += n * times
    assert used == counts


# ------------------------------------------------------------- 3 sharding


def test_sharding(edge, nothing):
    rows = sharding.shuffle_into_shards(edge, 5, rows=2).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [2, 2, 2, 3, 3]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert sharding.shuffle_into_shards(nothing).count() == 0


def test_matrix_has_the_hypergeometric_mean():
    sizes = [100, 300, 600]
    drawn = np.mean([sharding.matrix(sizes, 4, seed) for seed in range(400)], 0)
    assert np.abs(drawn - np.array(sizes)[:, None] / 4).max() < 2
    one = sharding.matrix(sizes, 4, 1)
    assert one.sum(1).tolist() == sizes and one.sum(0).tolist() == [250] * 4


# ------------------------------------------------------------- 4 quality rules


def test_quality_rules(edge, nothing):
    for r in quality_rules.judge(edge).collect():
        options = []
        for i, t in TEXTS:
            if i == r.doc_id:
                ws = [w.decode() for w in words(t)]
                seen = Counter(zip(ws, ws[1:], ws[2:]))
                hit = {k + j for k, x in enumerate(zip(ws, ws[1:], ws[2:])) if seen[x] > 1 for j in range(3)}
                full = [x for x in (t or "").split("\n") if x.encode().split()]
                options.append((len(ws), sum(map(len, ws)), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(hit)))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in options
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.judge(nothing).count() == 0 and quality_rules.keep(nothing).columns == nothing.columns


def test_quality_rules_tell_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_rules.judge(docs).join(docs.select("doc_id", "text"), "doc_id").where("not base_failed").collect()
    junk = [r for r in rows if r.n_symbols > 0.08 * len(r.text)]
    clean = [r for r in rows if r.n_symbols == 0]
    assert len(junk) > 5 and sum(r.kept for r in junk) <= 0.05 * len(junk)
    assert len(clean) > 300 and sum(r.kept for r in clean) >= 0.99 * len(clean)


def test_quality_rules_common_words(spark):
    """Plain letters without common words and texts under a wrong language go; clean texts stay."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    listed, langs = {w for v in quality_rules.COMMON.values() for w in v}, list(quality_rules.COMMON)
    clean = {k: [] for k in langs}
    for r in rows.where("doc_id % 7 = 0 and length(text) > 1000").collect():
        ws = (r.text or "").split()
        seen = Counter(zip(ws, ws[1:], ws[2:]))
        if r.lang in clean and len(ws) >= 200 and not set("#*$%&|<>") & set(r.text) and 3 * sum(n for n in seen.values() if n > 1) < len(ws) and sum(w in quality_rules.COMMON[r.lang] for w in ws) >= 0.08 * len(ws):
            clean[r.lang].append(r.text)
    docs, kind = [], {}

    def add(what, text, lang):
        kind[len(docs)] = what
        docs.append((len(docs), text, lang))

    for a in langs:
        assert len(clean[a]) >= 20
        for t in clean[a]:
            add("clean", t, a)
        for t in clean[a][:4]:
            add("letters", " ".join(w for w in t.split() if w not in listed), a)
            for b in langs:
                if b != a:
                    add(f"{a} as {b}", t, b)
    got = Counter((kind[r.doc_id], r.kept) for r in quality_rules.judge(spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect())
    wrong = [f"{a} as {b}" for a in langs for b in langs if a != b]
    assert got["clean", True] >= 0.995 * (got["clean", True] + got["clean", False])
    assert got["letters", True] == 0 and got["letters", False] == 16
    assert {k: got[k, True] for k in wrong if got[k, True]} == {}, got


# ------------------------------------------------------------- 5 URL lists


def test_url_lists(spark):
    day = lambda d: f"2024-01-{d:02d}"
    log = [("a.com", "domain", "add", day(2)), ("a.com", "domain", "add", day(3)), ("a.com", "domain", "remove", day(5)), ("a.com", "domain", "add", day(9)), ("b.org/x", "prefix", "add", day(1)), (None, "domain", "add", day(1)), ("c.net", None, "add", day(1)), ("d.net", "domain", "add", None), ("e.net", "domain", "add", day(4)), ("e.net", "domain", "remove", day(4))]
    entries = spark.createDataFrame(log, "pattern string, kind string, action string, at string").withColumn("at", F.to_date("at"))
    caps = [(1, "http://w.a.com/p", 2, True), (2, "http://a.com", 5, False), (3, "https://A.com:80/", 9, True), (4, "http://b.org/x/y", 3, True), (5, "http://b.org/xy", 3, False), (6, None, 3, False), (7, "no url", 3, False), (8, "http://a.com/", None, False), (None, "http://a.com/", 4, True), (9, "http://e.net/", 6, False), (9, "http://e.net/", 6, False)]
    pages = spark.createDataFrame([(i, u, d and day(d), "z") for i, u, d, _ in caps], "page_id bigint, url string, fetched_on string, pattern string").withColumn("fetched_on", F.to_date("fetched_on"))
    got = Counter((r.page_id, r.url, r.blocked) for r in url_lists.as_of(pages, url_lists.intervals(entries)).collect())
    assert got == Counter((i, u, b) for i, u, _, b in caps)
    assert url_lists.as_of(pages.where("false"), url_lists.intervals(entries.where("false"))).count() == 0


# ------------------------------------------------------------- 6 line dedup


def brute_lines(texts):
    key = lambda x: x.encode().strip().lower().decode()
    big = 2**63 - 1
    held = defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(big if i is None else i)
    out = Counter()
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == (big if i is None else i)]
        out[i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def test_line_dedup(spark, edge, nothing):
    got = Counter((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(edge).collect())
    assert got == brute_lines(TEXTS)
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert line_dedup.without_repeated_lines(edge).columns == edge.columns


def test_line_dedup_is_reversible(spark, edge):
    rest = edge.where("doc_id > 1 or doc_id is null")
    first = edge.where("doc_id = 1")
    state = lambda x: {(r.k1, r.k2): (r.n_docs, r.owner) for r in x.refs.collect()}
    whole, part = line_dedup.LineIndex.build(edge, shard_keys=2), line_dedup.LineIndex.build(rest, shard_keys=2)
    assert state(part.insert(first)) == state(whole)
    assert state(whole.delete(first)) == state(part)
    got = Counter((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in whole.delete(first).resolve(rest).collect())
    assert got == brute_lines([x for x in TEXTS if x[0] != 1])


def test_cuckoo_filter():
    draw = np.random.default_rng(1)
    keys = draw.integers(-(2**62), 2**62, (2, 40_000))
    made = line_dedup.filter_of(keys[0, :30_000], keys[1, :30_000])
    assert made.contains(keys[0, :30_000], keys[1, :30_000]).all()
    assert made.contains(keys[0, 30_000:], keys[1, 30_000:]).mean() < 0.001
    made.delete(keys[0, :100], keys[1, :100])
    assert not made.contains(keys[0, :100], keys[1, :100]).any() and made.contains(keys[0, 100:30_000], keys[1, 100:30_000]).all()


def test_lines_of_rows_without_id(spark):
    """Rows that share an id, or have none, fetch the keys of their own lines only."""
    texts = [(i, f"shared line number {i}\nonly here is {i}") for i in range(40)]
    texts += [(k, f"shared line number {i}\nrest of the row {i}x{k}") for i in range(40) for k in (None, 50)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    sizes = [r["count"] for r in line_dedup.LineIndex.build(df).dropped().groupBy("did", "th").count().collect()]
    assert sizes == [1] * 80
    got = Counter((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect())
    assert got == Counter(brute_lines(texts))


# ------------------------------------------------------------- 7 top-k search


def test_topk_search(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in draw.normal(0, 1 + i % 3, 6)]) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(40)] + [(40, rows[40][1])]
    bad = [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (320, [float("nan")] * 6), (340, [float("inf")] * 6), (None, [1.0] * 6)]
    other = [(400, [1.0, 2.0]), (401, [0.5, -2.0])]
    big = [(420, [1e11, 1e11, -1e11]), (421, [1e4, 3.0, 1.0])]
    df = spark.createDataFrame(rows + bad + other, "vec_id bigint, embedding array<double>").withColumn("x", F.lit(1))
    got = defaultdict(list)
    for r in topk_search.search(df, F.col("vec_id") % 20 == 0, k=7, block=16, query_block=4).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    fine = [(i, np.floor(64 * np.array(x))) for i, x in rows + other]
    for i, q in {i: x for i, x in fine if i % 20 == 0}.items():
        all_ = sorted((-int(q @ x), j) for j, x in fine if j != i and len(x) == len(q))[:7]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(all_)]
    assert set(got) == {i for i, _ in fine if i % 20 == 0}
    assert topk_search.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    exact = topk_search.search(spark.createDataFrame(big, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    x, y = (np.floor(64 * np.array(v)) for _, v in big)
    assert [(r.query_id, r.vec_id, r.score) for r in exact] == [(420, 421, sum(int(a) * int(b) for a, b in zip(x, y)))]


# ------------------------------------------------------------- 8 html


@pytest.fixture(scope="module")
def weights(spark):
    return html_extract.fit(html_extract.sample_of(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")))


def test_html_given_pages(spark, weights):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages, weights=weights).collect()}
    wrong = 0
    for r in pages.collect():
        inner = "\n\n".join(t for p, t, _ in html_extract.blocks(r.html) if "<article>" in p)
        wrong += inner != got[r.page_id]
    assert len(got) == pages.count() and wrong <= 0.01 * len(got)


def test_html_held_out_layouts(weights):
    draw = random.Random(99)
    texts = ["some words of a text that was not seen before, with a number of clauses.", "another paragraph; shorter."] * 3
    wrong = n = 0
    for _ in range(200):
        found = html_extract.blocks(html_extract.layout(draw, texts, "alpha beta gamma delta".split()))
        if found:
            score = html_extract.scores(weights, [html_extract.features([(p, t.replace("\x01", "") or "x", k) for p, t, k in found])])[0]
            wrong += sum((s > 0) != ("\x01" in t) for s, (_, t, _) in zip(score, found))
            n += len(found)
    assert n > 1000 and wrong < 0.03 * n


def test_html_edges(spark, weights):
    page = '<p>a &amp; b\n <b>c</b></p><script>var x="<p>no</p>"</script><!-- no --><style>p{}</style><article><h1>T</h1><p>d<br>e<p>f &lt;g&gt;</article><div class="comments"><p>no</p></div>'
    rows = [(1, "u", None, 0), (2, None, "", 0), (3, "u", "<div", 0), (3, "u", "<div", 0), (None, "u", page, 0), (4, "u", "<article>" + "<p>long text of a page.</p>" * 3000 + "</article>", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = [(r.page_id, r.text) for r in html_extract.extract(df, weights=weights).collect()]
    assert len(got) == 6 and dict(got)[1] == dict(got)[2] == ""
    assert dict(got)[None].endswith("T\n\nd e\n\nf <g>") and "no" not in dict(got)[None].split()
    assert dict(got)[4].count("\n\n") == 2999
    assert html_extract.extract(df.where("false"), weights=weights).count() == 0


# ------------------------------------------------------------- 9 substring dedup


def test_substring_dedup(edge, nothing):
    big = 2**62
    label = lambda i, t: big + int.from_bytes(hashlib.md5((t or "").encode()).digest()[:4]) if i is None else i
    owner = defaultdict(lambda: 2**63)
    for i, t in TEXTS:
        ws = words(t)
        for k in range(len(ws) - 12):
            owner[tuple(ws[k : k + 13])] = min(owner[tuple(ws[k : k + 13])], label(i, t))
    expected = Counter()
    for i, t in TEXTS:
        ws, gone = words(t), set()
        for k in range(len(ws) - 12):
            if owner[tuple(ws[k : k + 13])] < label(i, t):
                gone |= set(range(k, k + 13))
        expected[i, None if t is None else b" ".join(w for k, w in enumerate(ws) if k not in gone).decode(), len(ws), len(gone)] += 1
    for base in (7, 3, 13):
        got = Counter((r.doc_id, r.kept, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(edge, base=base).collect())
        assert got == expected
    assert substring_dedup.dedup_substrings(nothing).count() == 0
    out = substring_dedup.without_repeats(edge)
    assert out.columns == edge.columns and out.where("doc_id = 1").first().text == TEXTS[0][1]


# ------------------------------------------------------------- 10 Jaccard join


def brute_classes(texts):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in texts]
    links = [{b for b in range(len(sets)) if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} for a in range(len(sets))]
    root = list(range(len(sets)))
    for _ in sets:
        root = [min([root[a], *(root[b] for b in links[a])]) for a in range(len(sets))]
    ids = lambda a: min((texts[b][0] for b in range(len(sets)) if root[b] == root[a] and texts[b][0] is not None), default=None)
    return Counter((texts[a][0], ids(a), len(links[a])) for a in range(len(sets)))


def test_jaccard_join(spark, edge, nothing):
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(edge).collect())
    assert got == brute_classes(TEXTS)
    assert jaccard_join.near_duplicates(nothing).count() == 0


def test_jaccard_join_splits_and_blocks(spark):
    """A large group of near copies: buckets are split, then dealt out in pairs of blocks."""
    draw = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        ws = list(base)
        for _ in range(draw.randint(0, 5)):
            ws[draw.randrange(120)] = f"n{draw.randrange(10**6)}"
        texts.append((i, " ".join(ws)))
    texts += [(100 + i, " ".join(f"o{draw.randrange(50)}" for _ in range(40))) for i in range(20)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df, limit=4, block=8).collect())
    assert got == brute_classes(texts)
    kept = {r.doc_id for r in jaccard_join.one_of_each(df).collect()}
    assert kept == {c for _, c, _ in brute_classes(texts)}


def test_jaccard_join_misses_no_more_than_it_says(spark):
    """Pairs at the threshold whose buckets are all split twice."""
    n, miss = 3000, 0.01
    texts = []
    for i in range(n):
        shared = " ".join(f"s{i}x{j}" for j in range(44))  # 40 shingles, and 5 more on either side
        texts += [(2 * i + k, shared + "".join(f" e{i}x{k}x{j}" for j in range(5))) for k in range(2)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    out = jaccard_join.near_duplicates(df, limit=1, miss=miss)
    assert n - out.where("n_links = 1").count() / 2 <= miss * n


def test_jaccard_join_tokens():
    """Agreements of pairs at the threshold are spread as those of independent tokens; the runs share none."""
    n_runs, t = jaccard_join.runs_for(0.8), 0.8
    places = [*range(n_runs), *(jaccard_join.branch_at(r, d, b, n_runs) for r in range(n_runs) for d in range(jaccard_join.DEPTH) for b in range(jaccard_join.BRANCHES))]
    assert sorted(places) == list(range(jaccard_join.tokens_for(n_runs)))
    assert (1 - t * (1 - (1 - t) ** 2) ** 2) ** n_runs <= 1e-6
    draw = np.random.default_rng(5)
    new = lambda k: draw.integers(0, 2**64, k, np.uint64)
    same = []
    for _ in range(3000):
        both = new(160)
        a, b = (jaccard_join.tokens(np.r_[both, new(20)], len(places)) for _ in range(2))
        same.append(a == b)
    same = np.array(same)
    assert abs(same.mean() - t) < 0.004
    assert abs(np.corrcoef(same.T) - np.eye(len(places))).max() < 5 / 3000**0.5
    assert abs(same.sum(1).var() / (len(places) * t * (1 - t)) - 1) < 0.12


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


# ------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, held = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = corpus_pipeline.staged(stage(spark, docs, SF_SMALL), f"test-{k}")
        if k == 4:
            w = packing.WordIds(open(WORDS, "rb").read())
            padding, _ = check_packing(out.collect(), before, lambda t: np.r_[w.whole([(t or "").encode()])[0], np.array([1], "<u4")])
            assert padding < 2048
            break
        after = {r.doc_id: r.text for r in out.collect()}
        assert out.columns == columns and set(after) <= set(held)
        if k == 0:
            assert set(after) == {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
        if k == 1:
            assert after == {i: t for i, t, _, _ in brute_lines(before)}
        if k == 2:
            assert set(after) == {c for _, c, _ in brute_classes(before)} | {i for i, t in before if not words(t)}
        if k == 3:
            owner = {}
            for i, t in before:
                ws = words(t)
                for j in range(len(ws) - 12):
                    x = tuple(ws[j : j + 13])
                    owner[x] = min(owner.get(x, i), i)
            for i, t in before:
                ws, gone = words(t), set()
                for j in range(len(ws) - 12):
                    if owner[tuple(ws[j : j + 13])] < i:
                        gone |= set(range(j, j + 13))
                assert words(after[i]) == [x for j, x in enumerate(ws) if j not in gone]
        docs = out
