"""Lexical search, contiguous-rank BPE and cross-tokenizer alignment: edge cases and brute force."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from callwright.llm import lexical_search, token_alignment, word_bpe

from .test_llm import LONG, SCHEMA, TEXTS, edge, nothing  # noqa: F401

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------- 11 token alignment

ODD = [(20, "<|endoftext|> a  b\tc \u3000d </s> <0x0A>\n\n e "), (21, " lead"), (22, "\nlead line\x00nul 😀 ñandú"), (23, "▁meta"), (24, "x" * 3000), (25, "the the the")]


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute_align(both, text):
    """(A ids, B ids, links as places, groups) by comparing all byte ranges of the libraries' own offsets."""
    a, b = both
    full = f" {text or ''}".encode()
    a_ids, b_ids = a.encode(f" {text or ''}", add_special_tokens=False).ids, b.encode(text or "")
    a_len = [len(a.decode([i]).encode()) if "\ufffd" not in a.decode([i]) else len(a.id_to_token(i)) for i in a_ids]
    b_len = [1 if b.is_byte(i) else len(b.id_to_piece(i).replace("▁", " ").encode()) for i in b_ids]
    b_bytes = b"".join(bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids)
    if not text or b_bytes != full:
        return [], [], [], []
    a_end, b_end = np.cumsum(a_len).tolist(), np.cumsum(b_len).tolist()
    assert a_end[-1] == b_end[-1] == len(full)
    links = [(i, j) for i in range(len(a_ids)) for j in range(len(b_ids)) if a_end[i] - a_len[i] < b_end[j] and b_end[j] - b_len[j] < a_end[i]]
    cuts = sorted(set(a_end) & set(b_end))
    groups = [([x for x, e in zip(a_ids, a_end) if lo < e <= hi], [y for y, e in zip(b_ids, b_end) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
    return a_ids, b_ids, links, groups


def short_texts():
    return [(i, t if t is None or len(t) < 5000 else t[:4000]) for i, t in [*TEXTS, *ODD]]


def spelled(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def test_alignment_equals_brute_force(spark, nothing, both):
    rows = short_texts()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id bigint, text string, block string, pairs int").repartition(3)
    brute = {t: brute_align(both, t) for _, t in rows}
    got = Counter((r.doc_id, *(tuple(r[n]) for n in ("a_ids", "b_ids", "link_a", "link_b")), len(r.cuts)) for r in token_alignment.align(df, BYTES, PIECES).collect())
    want = Counter()
    for i, t in rows:
        a, b, links, groups = brute[t]
        links = sorted(links)
        want[i, tuple(a), tuple(b), tuple(x for x, _ in links), tuple(y for _, y in links), len(groups)] += 1
    assert got == want

    counts = Counter((a[x], b[y]) for _, t in rows for a, b, links, _ in [brute[t]] for x, y in links)
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    want = Counter()
    for i, t in rows:
        a, b, links, groups = brute[t]
        of = [counts[a[x], b[y]] for x, y in links]
        best = sum(n == top[b[y]] for n, (_, y) in zip(of, links))
        want[i, len(a), len(b), len(groups), len(links), best, sum(of), hashlib.sha256(spelled(groups).encode()).hexdigest() if a else ""] += 1
    out = token_alignment.digests(df, BYTES, PIECES)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == want
    assert token_alignment.digests(nothing, BYTES, PIECES).count() == 0 and token_alignment.align(nothing, BYTES, PIECES).count() == 0


def test_lanes_units_and_passes_change_nothing(both, monkeypatch):
    texts = [(t or "").encode() for _, t in [*TEXTS, *ODD]]
    ids = list(range(len(texts)))

    def rows():
        block = token_alignment._Block(1)
        block.add(token_alignment.TwoTokenizers(*token_alignment._files(BYTES, PIECES)), ids, texts)
        out = block.rows().to_pylist()
        pairs = dict(zip(out[-1]["pairs"], out[-1]["times"]))
        spell = [np.array(out[-1]["pairs"])[np.frombuffer(r["codes"], np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()].tolist() for r in out[:-1]]
        return [[r[k] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")] for r in out[:-1]], pairs, spell

    want = rows()
    for name, value in (("LANE_CHUNKS", 3), ("UNIT_CHUNKS", 50), ("PASS_CHUNKS", 70), ("CALL_BYTES", 1)):
        monkeypatch.setattr(token_alignment, name, value)
    assert rows() == want


def test_chunks_encode_like_whole_texts(both):
    two = token_alignment.TwoTokenizers(*token_alignment._files(BYTES, PIECES))
    r = random.Random(2)
    signs, whole = "ab Σéß'sS<|>́İ\t\n  12٣中ñ!.,-\x1c\x00\u3000\xa0\x85😀", ["<|endoftext|>", " ", "'s", "▁", "  ", "</s>", "<0x0A>", "the ", "of\n"]
    texts = ["".join(r.choice(signs) if r.random() < 0.8 else r.choice(whole) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    texts += [f"a{c}b {c} 1{c} {c}{c} x" for c in map(chr, range(0x3200))]
    for t, s in zip(texts, two.slots([t.encode() for t in texts])):
        if "▁" in t:
            assert not len(s)
        else:
            assert [two.ids[0].get(s)[0].tolist(), two.ids[1].get(s)[0].tolist()] == [both[0].encode(f" {t}", add_special_tokens=False).ids, both[1].encode(t)], t


# ------------------------------------------------------------- 12 lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_all = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return Counter(out)


ITEMS = [(1, "ONE passage, of words"), (1, "of repeats"), (2, None), (3, "?! --"), (4, "éß中 End\x00LINE"), (None, "no id here"), (5, "word1x1 word2x2 more"), (6, "nothing-known-here-zz")]


def test_search(spark, edge, nothing):
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id bigint, text string, doc_id string, score int")
    got = Counter(tuple(r) for r in lexical_search.search(edge, items).collect())
    assert got == brute_search(TEXTS, ITEMS)
    assert lexical_search.search(nothing, items).count() == 0
    assert lexical_search.search(edge, items.where("false")).count() == 0
    assert lexical_search.search(edge, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_in_blocks_with_ties(spark):
    r = random.Random(3)
    words = ["the", "of", "Ünï", "a1", "b2", "中文", "x_y", "tail"]
    docs = [(i % 90, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(200)]
    items = [(i, " ".join(r.sample(words, 3))) for i in range(25)]
    docs_df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    items_df = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_search(docs, items)
    assert Counter(tuple(x) for x in lexical_search.search(docs_df, items_df).collect()) == want
    assert Counter(tuple(x) for x in lexical_search.search(docs_df, items_df, block_bytes=90).collect()) == want


def test_scoring_in_slabs(spark, monkeypatch):
    docs = [(i, "b a" if i % 3 else "a a c") for i in range(50)]
    monkeypatch.setattr(lexical_search, "SLAB_BYTES", 256)
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(0, "a c"), (1, "b")], "item_id bigint, text string"))
    assert Counter(tuple(x) for x in got.collect()) == brute_search(docs, [(0, "a c"), (1, "b")])


def test_automaton_counts_terms_that_share_a_boundary():
    n, found = lexical_search.Automaton([b"a", b"aa", b"b"]).count(b"a a aa A,b ba")
    assert n == 6 and found == Counter({0: 3, 1: 1, 2: 1})


# ------------------------------------------------------------- 13 word BPE


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_bpe_equals_the_library(edge, nothing, word_tokenizer):
    want = {(i, t): word_tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in TEXTS}
    enc = word_bpe.encode(edge, WORDS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in enc.collect()) == Counter((i, tuple(want[i, t])) for i, t in TEXTS)
    back = Counter((r.doc_id, r.text) for r in word_bpe.decode(enc, WORDS).collect())
    assert back == Counter((i, word_tokenizer.decode(want[i, t], skip_special_tokens=False)) for i, t in TEXTS)
    digests = Counter(tuple(r) for r in word_bpe.digests(edge, WORDS).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == Counter((i, len(want[i, t]), sha(np.array(want[i, t], "<u4").tobytes()), sha(word_tokenizer.decode(want[i, t], skip_special_tokens=False).encode())) for i, t in TEXTS)
    assert word_bpe.digests(nothing, WORDS).count() == 0 and word_bpe.encode(nothing, WORDS).count() == 0


def test_bpe_on_every_sign_and_on_long_words(word_tokenizer):
    codec = word_bpe.Codec(word_bpe._file(WORDS))
    r = random.Random(5)
    texts = [f"a{c}b {c} 1{c}'{c} {c}{c}" for c in map(chr, [*range(0x3500), *range(0xF900, 0xFFFE)])]
    signs = "ab Σéß'sS<|>́İ\t\n ​12٣中ñ!.,-\x1c\x00"
    whole = ["<|endoftext|>", "<|startoftext|>", " ", "'s", "don't"]
    texts += ["".join(r.choice(signs) if r.random() < 0.9 else r.choice(whole) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 5000, "ab" * 3000 + "é" * 999, "x" * 64, "x" * 65, "thethe" * 40]
    got = [np.frombuffer(b"".join(w[0] for w in ws), "<u4").tolist() for ws in codec.encode([t.encode() for t in texts])]
    want = [e.ids for e in word_tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert codec.decode([320, 10**7, 49407]) == word_tokenizer.decode([320, 10**7, 49407], skip_special_tokens=False)


def test_both_merge_forms_agree():
    codec = word_bpe.Codec(word_bpe._file(WORDS))
    r = random.Random(6)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(1, 60))).encode() for _ in range(500)]
    matrix = codec._matrix(words)
    for row, ids in zip(matrix, codec.merges.short(matrix)):
        assert ids.tolist() == codec.merges.long(row[row >= 0]).tolist()
