"""Operators against brute force, exact round trips and held-out accuracy, and their defined cases."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ripplegraph.llm import bpe, chat, common, decontaminate, graph, langid, ngram_join, pii, quality, queries, repeats, token_counts, topk

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in common.read(spark, SMALL, "documents").select("doc_id", "text").collect()]


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


# -- exact top-k ---------------------------------------------------------------------------------


def brute_top(rows, k):
    out = set()
    for qi, q in rows:
        if qi % 20 == 0:
            s = sorted(((-sum(a * b for a, b in zip(q, x, strict=True)), i) for i, x in rows if i != qi and len(x) == len(q)))
            out |= {(qi, r + 1, i, -v) for r, (v, i) in enumerate(s[:k])}
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [int(v) for v in rng.integers(-3, 4, 6)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = topk.exact_top_k(df.where(topk.every_nth()), df, k=5, row_block=32, query_block=4, levels=3)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 5)
    wide = [(i, [int(v) for v in rng.integers(-(2**28), 2**28, 6)]) for i in range(100)]
    df = spark.createDataFrame(wide, "id long, v array<long>")
    assert {tuple(r) for r in topk.exact_top_k(df.where(topk.every_nth()), df, k=5, levels=4).collect()} == brute_top(wide, 5)


def test_bounds_hold_and_spare_exact_vectors():
    rng = np.random.default_rng(8)
    x, q = (rng.integers(-20, 21, (n, 32)) for n in (600, 20))
    about = topk.Approximation.of(x, 16)
    assert about.cells.max() < 32 and about.cells.dtype == np.uint8
    lower, upper = about.bounds(q, np.float64)
    assert (lower <= q @ x.T).all() and (q @ x.T <= upper).all()
    kth = np.sort(lower, axis=1)[:, -5]
    assert (upper >= kth[:, None]).mean() < 0.3


def test_repeated_rows_share_no_block(spark):
    df = spark.createDataFrame([(i % 2, [1, 2]) for i in range(400)] + [(20, [3, 1])], "id long, v array<long>")
    blocks, n = topk._blocks(df.withColumn("place", F.monotonically_increasing_id()), 401, 50, "rb")
    assert n == 9 and max(len(r["rb_ids"]) for r in blocks.collect()) < 100
    got = topk.exact_top_k(df.where(topk.every_nth()), df, k=3).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, r, 1, 5) for r in (1, 2, 3)] + [(20, r, 0, 5) for r in (1, 2, 3)]


def test_top_k_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "y"), (2, None, "z"), (3, [None, 1.0], ""), (4, [nan, 1.0], ""), (5, [inf, 0.0], ""), (6, [0.5, 0.5], ""), (7, [1.0], ""), (None, [1.0, 1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    got = topk.exact_top_k(v.where(topk.every_nth()), v, k=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 4096), (0, 2, 6, 2048)]
    assert topk.exact_top_k(v.limit(0), v, k=3).count() == 0


# -- personal data -------------------------------------------------------------------------------

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            s, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


TRICKY = [
    "a@b.c_d@e.f x@y@z.com .@-.- a@b..c a@b.c%d@e.f.", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.256 0000255.1.1.1 11.22.33.44", "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 1111 1111 4111111111111111 12",
    "+1 (743) 555-3824 +12 +1-2 ++1 743 555 38240. +1 743\n555", "é😀 a@b.co é 4111111111111111 \x01 4111\x011111 \x03 a\x03b@c\x03d.e", "", None, "1" * 5000, "a" * 20000 + "@b.c", "1 " * 3000, "a." * 3000 + "@" + "b." * 3000 + "c",
]


def test_base_spans_equal_brute_force(spark, docs):
    rows = docs + [(10_000 + i, t) for i, t in enumerate(TRICKY)]
    got = pii.detect(frame(spark, rows), []).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()
    want = {i: brute_spans(t) for i, t in rows}
    assert {r["doc_id"]: r["s"] for r in got} == want


def test_more_spans_and_redaction(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]
    rows = [(i, f'alpha token = "{h}" beta') for i, h in enumerate(hexes[:40])] + [(100 + i, "plain words and averyverylongcompoundwordwithoutdigits here") for i in range(40)] + [(200, "mail a@b.co now"), (201, None)]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, spans string")
    found = pii.detect(df, pii.fit(df))
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert all(got[i] == f"secret:15:{15 + 40}" for i in range(40)) and all(got[100 + i] == "" for i in range(40)) and got[200] == "email:5:11"
    red = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert red[0] == 'alpha token = "[SECRET]" beta' and red[200] == "mail [EMAIL] now" and red[201] is None
    assert pii.detect(df.limit(0), pii.fit(df.limit(0))).count() == 0


def test_em_prefers_agreeing_labelers():
    patterns = [((1, 1, 1, 0, 1), 50.0), ((-1, 0, 0, -1, -1), 50.0), ((1, 0, 0, 0, 1), 10.0)]
    _, _, post = pii.expectation_maximisation(patterns)
    assert post[0] > 0.9 and post[1] < 0.1 and post[2] > 0.5
    assert pii.train_classifier([]) == []


# -- language ------------------------------------------------------------------------------------


def brute_phrases(text, samples):
    n = i = 0
    while i < len(text):
        j = i
        while j < len(text) and any(text[i : j + 1] in s for s in samples):
            j += 1
        if j == len(text):
            break
        n, i = n + 1, max(j, i + 1)
    return n + 1


def test_phrase_counts_equal_brute_force():
    samples = [("aa", ["the cat sat on the mat", "a dog"]), ("bb", ["le chat est sur le tapis"])]
    m = langid.Model(samples, 400).ready()
    for text in ("the tapis sat", "chat on the dog", "zzz", "a"):
        codes = m.codes[langid.simple(text)]
        got = m.phrases([codes[j : j + 1] for j in range(len(codes))], 1)[:, 0]
        plain = "".join(map(chr, langid.simple(text)))
        for i, (_, texts) in enumerate(samples):
            parts, n, state = ["".join(map(chr, langid.simple(t))) for t in texts], 1, ""
            for c in plain:  # a phrase ends where the next character no longer extends it; that character begins the next
                if any(state + c in p for p in parts):
                    state += c
                else:
                    n, state = n + 1, c if any(c in p for p in parts) else ""
            assert got[i] == n, (text, i)


def test_language_held_out_accuracy(spark):
    d = common.read(spark, SMALL, "documents")
    out = langid.identify(d.select("doc_id", "text", "lang"), langid.fit(d.where(langid.learnable()))).where(common.fold(F.col("doc_id")) == 2)
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()
    assert out.where("score < 0 or score > 1").count() == 0


def test_language_cases(spark):
    train = frame(spark, [(i, "hello world this is english text", "en") for i in range(5)] + [(9, "bonjour le monde ceci est du texte", "fr"), (10, None, "de"), (11, "x", None)], "doc_id long, text string, lang string")
    m = langid.fit(train)
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "this is"), (4, "this is"), (None, "le monde"), (6, "漢字" * 3000)]
    got = [tuple(r) for r in langid.identify(spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, lang_pred string"), m).select("doc_id", "lang_pred").collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and got[3:6] == [(4, "en"), (4, "en"), (None, "fr")] and got[6][1] in ("en", "fr")
    empty = langid.fit(train.limit(0))
    assert langid.identify(frame(spark, [(1, "abc")]), empty).first()["lang_pred"] == "und"


# -- n-gram Jaccard join -------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in where[g])
        for j, o in shared.items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                parent[root(i)] = root(j)
        for g in s:
            where[g].append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows))


def near_copies(rng, n, words, changes):
    base = [f"w{i}" for i in range(words)]
    return [" ".join(f"x{rng.integers(1000)}" if i in set(rng.choice(words, changes, replace=False)) else w for i, w in enumerate(base)) for _ in range(n)]


def test_components_equal_brute_force(spark, docs):
    rng = np.random.default_rng(5)
    rows = docs + [(5000 + i, t) for i, t in enumerate(near_copies(rng, 60, 120, 3))] + [(6000 + i, t) for i, t in enumerate(["one two", "ONE\ttwo", "one", "", " \n", None, "a b c d e", "A b c d e", "a b c d e f"])]
    for options in ({}, {"block": 1000, "range_bytes": 20_000}):
        got = ngram_join.components(frame(spark, rows), **options).collect()
        assert sorted(tuple(r)[:3] for r in got) == brute_components(rows)


def test_component_cases(spark):
    assert ngram_join.components(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(7, "a b c d e f", 1), (7, "a b c d e f", 2), (3, "a b c d e f", 3), (None, "q r s", 4)], "doc_id long, text string, tag int")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_join.components(df).collect())
    assert got == [(-1, 1, None), (3, 2, 3), (7, 2, 3), (7, 2, 3)]


def test_divide_skip_equals_counts():
    rng = np.random.default_rng(2)
    sets = sorted((np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(300)), key=len)
    sizes = np.array([len(s) for s in sets])
    block = ngram_join.Block(sets, sizes)
    for i, s in enumerate(sets):
        wanted = rng.random(300) < 0.8
        both = np.array([len(np.intersect1d(s, x)) for x in sets])
        want = np.flatnonzero(wanted & (100 * both >= 60 * (sizes[i] + sizes - both)))
        assert block.search(s, int(sizes[i]), wanted, 60).tolist() == want.tolist()
    lists = [sorted(set(rng.integers(0, 30, 12).tolist())) for _ in range(9)]
    count = collections.Counter(x for y in lists for x in y)
    for need in range(1, 10):
        assert list(zip(*ngram_join.merge_skip(lists, need), strict=True)) == sorted((r, n) for r, n in count.items() if n >= need)


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_words_that_fool_polynomials_are_not_one(spark, tokens):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    df = frame(spark, [(1, one), (2, other), (3, f"{other} {one}")])
    assert [r["component_id"] for r in ngram_join.components(df).orderBy("doc_id").collect()] == [1, 2, 3]
    got = bpe.decode(bpe.encode(df, tokens), tokens).orderBy("doc_id").collect()
    assert [(bytes(r["ids"]), r["decoded"]) for r in got] == [brute_bpe(tokens, t) for t in (one, other, f"{other} {one}")]
    assert [r["n_removed"] for r in repeats.remove_repeats(df).orderBy("doc_id").collect()] == [r[2] for r in brute_removed([(1, one), (2, other), (3, f"{other} {one}")], 200)]


def test_connected(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {tuple(r) for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, root(x)) for x in parent if root(x) != x}


# -- token counts --------------------------------------------------------------------------------


def test_context_report_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(0, 40, 200)] + [5000, 0]
    df = spark.createDataFrame([(s, 1) for s in sizes], "n_tokens long, n_docs long")
    got = {r["context_limit"]: r for r in token_counts.context_report(token_counts.histogram(df), band=8).collect()}
    assert set(got) == set(sizes)
    for limit, r in got.items():
        assert r["truncated_tokens"] == sum(min(s, limit) for s in sizes) and r["lost_tokens"] == sum(max(0, s - limit) for s in sizes)
        assert r["fitting_docs"] == sum(s <= limit for s in sizes) and r["total_tokens"] == sum(sizes) and r["quantile"] == r["fitting_docs"] / len(sizes)
    assert token_counts.context_report(token_counts.histogram(df.limit(0))).count() == 0
    limits = spark.createDataFrame([(16,), (41,), (4096,), (9000,), (41,)], "context_limit int")
    more = {r["context_limit"]: r for r in token_counts.context_report(token_counts.histogram(df), limits, band=8).collect()}
    assert set(more) == set(sizes) | {16, 41, 4096, 9000} and all(more[x]["truncated_tokens"] == sum(min(s, x) for s in sizes) and more[x]["fitting_docs"] == sum(s <= x for s in sizes) for x in (16, 41, 4096, 9000))
    at = {r["q"]: r["n_tokens"] for r in token_counts.lengths_at(token_counts.context_report(token_counts.histogram(df)), [0.25, 0.5, 1.0]).collect()}
    assert at == {q: sorted(sizes)[-(-int(q * 100) * len(sizes) // 100) - 1] for q in (0.25, 0.5, 1.0)}


def test_encoded_lengths(spark, docs):
    import public_tokenizers

    ranks = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    some = docs[:40] + [(1, None), (2, ""), (3, "<|endoftext|>")]
    enc = token_counts.encoder(ranks, public_tokenizers.PATTERN)
    got = token_counts.histogram(token_counts.encoded_lengths(frame(spark, some), ranks, public_tokenizers.PATTERN)).collect()
    assert {r["n_tokens"]: r["n_docs"] for r in got} == collections.Counter(len(enc.encode_ordinary(t or "")) for _, t in some)


# -- decontamination -----------------------------------------------------------------------------


def edited(rng, text, k):
    s = list(text)
    for _ in range(k):
        i = int(rng.integers(len(s)))
        s[i : i + 1] = [["#"], [], [s[i], "#"]][int(rng.integers(3))]
    return "".join(s)


def test_leaks_of_edited_items(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(40)) for i in range(20)]
    rows = [(i, f"{text(30)} {edited(rng, t, 5).upper()}\n{text(30)}") for i, t in items] + [(100 + i, text(200)) for i in range(50)]
    found = decontaminate.contaminated(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in range(20)}
    split = decontaminate.contaminated(frame(spark, rows), frame(spark, items, "item_id long, text string"), chunk_chars=900)
    assert {(r["doc_id"], r["item_id"]) for r in split.collect()} == {(i, i) for i in range(20)}


def test_window_search_is_exact_for_the_budget():
    rng = np.random.default_rng(9)
    item = "".join(chr(97 + c) for c in rng.integers(0, 26, 110))
    index = decontaminate.Index([(1, item)], 120, 0.06, 48)
    k = int(index.edits[0])
    for edits in (0, 1, k, k + 8):
        for _ in range(20):
            doc = "zq" * 30 + edited(rng, item, edits) + "yw" * 30
            data = decontaminate.FOLD[np.frombuffer(doc.encode(), np.uint8)]
            offsets = np.array([0, len(data)])
            hits = [index.verify(w, low, data, 0, len(data)) for w, low in zip(*(x.tolist() for x in index.candidates(data, offsets)), strict=True)]
            best = int(decontaminate.align(index.windows[0], data).min())
            assert any(hits) == (best <= k)
            assert all(h is None or h[2] >= best for h in hits)


def test_leak_cases(spark):
    item = [(1, "some benchmark passage that is long enough to be found anywhere at all"), (2, "short"), (3, None), (1, "some benchmark passage that is long enough to be found anywhere at all")]
    b = frame(spark, item, "item_id long, text string")
    text = item[0][1]
    rows = [(1, None), (2, ""), (3, f"é😀 {text} end"), (3, f"é😀 {text} end"), (4, text[: len(text) // 2])]
    got = sorted(tuple(r) for r in decontaminate.leaks(frame(spark, rows), b).collect())
    assert got == [(3, 1, 3, 3 + len(text), 0)] * 2
    assert decontaminate.leaks(frame(spark, rows), b.limit(0)).count() == 0 and decontaminate.leaks(frame(spark, []), b).count() == 0


# -- repeated bytes ------------------------------------------------------------------------------


def brute_removed(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def repeat_rows(rng):
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 6, rng.integers(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(90), text(50)
    rows = [(i, f"{text(20)}{passage[: 150 + 20 * i]}é{text(20)}") for i in range(12)] + [(20 + i, text(10) + line[: 195 + i] + text(10)) for i in range(12)]
    return rows + [(40, "ab" * 400), (41, "abc" * 300), (42, "x" * 199), (43, "x" * 200), (44, None), (45, ""), (46, text(100)), (46, text(100)), (47, "same " * 60), (47, "same " * 60), (48, "\x00" * 210)]


def test_repeats_equal_brute_force(spark, docs):
    rows = repeat_rows(np.random.default_rng(8)) + docs[:60]
    for hot in (50_000, 2):
        got = repeats.digest(repeats.remove_repeats(frame(spark, rows), hot=hot)).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_removed(rows, 200)


def test_repeat_cases(spark):
    assert repeats.remove_repeats(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "abc " * 80, 1), (1, "abc " * 80, 2)], "doc_id long, text string, content int")
    got = repeats.remove_repeats(df).collect()
    assert [(r["n_removed"], bytes(r["kept"])) for r in got] == [(320, b"")] * 2 and {r["doc_id"] for r in got} == {None, 1}


def test_column_order_shares():
    rows = [b"abcdefgh", b"xbcdefgh", b"abcdxfgh", b"abcdefgz"]
    first, last = repeats.columns(np.array([list(r) for r in rows], np.uint16), np.zeros(4, np.int64), 4, 4)
    assert list(zip(first.tolist(), last.tolist(), strict=True)) == [(0, 4), (1, 4), (0, 0), (0, 3)]


# -- chat ----------------------------------------------------------------------------------------


def test_snapshots_collapse(spark):
    c = "conv_id long, turn long, role string, text string"
    one = [(0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "bye")]
    rows = [(1, *t) for t in one] + [(2, *t) for t in one[:2]] + [(3, *t) for t in one] + [(4, 0, "user", "hi"), (4, 1, "assistant", "HELLO"), (5, 0, "user", None), (6, 0, None, "x"), (None, 0, "user", "z")] + [(7, *t) for t in one[1:]]
    got = {r["conv_id"]: r for r in chat.collapse_and_render(spark.createDataFrame(rows, c)).collect()}
    assert set(got) == {1, 4, 5, 6, 7} and got[1]["n_collapsed"] == 1 and got[1]["n_turns"] == 3
    assert {i: r["n_snapshots"] for i, r in got.items()} == {1: 1, 4: 0, 5: 0, 6: 0, 7: 0}
    long = [(8, None, "user", "x" * 200_000), (9, None, "user", "x" * 200_000), (9, 1, "assistant", "y")]
    clash = spark.createDataFrame([(*r, 1, "z") for r in long], f"{c}, n_turns long, a string")
    assert [(r["conv_id"], r["n_snapshots"], len(r["text"])) for r in chat.collapse_and_render(clash).collect()] == [(9, 1, 9 + 200_000 + 1 + 14 + 2 + 7)]
    assert got[1]["text"] == "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nbye\n<|end|>" and got[5]["text"] == "<|user|>\n\n<|end|>" and got[6]["text"].startswith("<|unknown|>")
    assert chat.collapse_and_render(spark.createDataFrame([], c)).count() == 0


# -- quality -------------------------------------------------------------------------------------


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(8, 0.3, rng.normal(size=8 + quality.STATS), rng.normal(size=(8 + quality.STATS, 3)), np.zeros(quality.STATS), np.ones(quality.STATS))
    col, value, stats = np.array([1, 3, 6], np.int32), np.array([0.5, 1.0, 2.0]), rng.normal(size=(1, quality.STATS))
    x = np.zeros(8 + quality.STATS)
    x[col], x[8:] = value, stats[0]
    pairs = sum(x[i] * x[j] * (m.v[i] @ m.v[j]) for i in range(len(x)) for j in range(i))
    assert np.isclose(m.logits(np.array([0, 3]), col, value, stats)[0], m.bias + m.w @ x + pairs)


def test_quality_held_out(spark):
    got = queries.op9_quality(spark, SMALL).join(common.read(spark, SMALL, "labels"), "doc_id").where("held_out").collect()
    right = sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in got)
    assert right >= 0.85 * len(got)


def test_quality_cases(spark):
    d = spark.createDataFrame([(1, "good plain text", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (2, 7)], "doc_id long, quality int")
    assert [r["score"] for r in quality.score(d, quality.fit(d, labels)).collect()] == [0.5] * 4
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    s = [r["score"] for r in quality.score(d, quality.fit(d, labels)).collect()]
    assert all(0 <= x <= 1 for x in s) and s[1] == s[2] == s[3]


# -- BPE -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers

    return bpe.Tokens(open(public_tokenizers.path("word_bpe_49k.json")).read())


ODD = ["it's John'S don't '' 'sam x!'s", "İstanbul ẞ ǅ Ⱥ ŉ Å Å", "a<|endoftext|>b <|startoftext|> <|x|>", "1234 ½ ² ٣ Ⅷ", "日本語 テスト", "é     \x85 \x1c tab\tx", "ǰ J̌ ﬁ", "\x00 \x7f ﻿", "😀👍🏽", "", None, "   ", "ß É À ÿ Ǆ ŀ ª º µ ·"]


def brute_bpe(tokens, text):
    tok, _ = tokens.library()
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False)


def test_bpe_equals_library(spark, docs, tokens):
    rows = docs + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_000, ODD[0])] + [(20_000, "".join(chr(i) + " " for i in range(1, 0x250)))]
    for options in ({}, {"part_bytes": 100, "chunk_words": 50, "chunk_bytes": 5000}):
        got = bpe.decode(bpe.encode(frame(spark, rows), tokens, **options), tokens).collect()
        want = sorted((i, *brute_bpe(tokens, t)) for i, t in rows)
        assert sorted((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got) == want
    assert bpe.decode(bpe.encode(frame(spark, []), tokens), tokens).count() == 0
    clash = spark.createDataFrame([(1, "two words", "x", 5)] * 3, "doc_id long, text string, ids string, decoded int").repartition(3)
    got = bpe.decode(bpe.encode(common.cut(clash), tokens), tokens).collect()
    assert [(r["doc_id"], r["decoded"]) for r in got] == [(1, "two</w> words</w>")] * 3


def test_helpers():
    text = pa.array(["ab c", None, "", "é  x"])
    raw, offsets = common.bytes_of(text.slice(1))
    assert bytes(raw) == "é  x".encode() and offsets.tolist() == [0, 0, 0, 5]
    starts, ends, rows = common.word_spans(*common.bytes_of(pa.array(["a b", "b a", "ab"])))
    assert (starts.tolist(), ends.tolist(), rows.tolist()) == ([0, 2, 3, 5, 6], [1, 3, 4, 6, 8], [0, 0, 1, 1, 2])
    h = common.word_names(*[np.frombuffer(b"a b ba", np.uint8), np.array([0, 2, 4, 5]), np.array([1, 3, 5, 6])])
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]
    parts = list(common.slices(pa.RecordBatch.from_arrays([pa.array(["aaaa", None, "bb", "c" * 50, "", "d"])], names=["text"]), "text", rows=3, size=6))
    assert [p.column(0).to_pylist() for p in parts] == [["aaaa", None, "bb"], ["c" * 50], ["", "d"]]
