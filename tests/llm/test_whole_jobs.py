from __future__ import annotations

import re

import numpy as np

from ripplegraph.llm import bpe, decontaminate, langid, pii, quality, repeats

DOC = "doc_id long, text string"
ITEM = "item_id long, text string"


def test_leaks_at_every_offset(spark):
    rng = np.random.default_rng(12)
    noise = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    item = noise(300)
    cuts = [(a, n) for a in range(0, 180, 7) for n in (120, 140) if a + n <= 300]
    rows = [(i, f"{noise(90)} {item[a : a + n]} {noise(90)}") for i, (a, n) in enumerate(cuts)]
    for i, (a, n) in enumerate(cuts):  # edits at the ends and in the middle
        t = list(item[a : a + n])
        for at in (3, 40, 41, 60, 77, 90, 116):
            t[at] = "#"
        rows.append((1000 + i, f"{noise(90)} {''.join(t)} {noise(90)}"))
    rows += [(5000 + i, noise(100) + item[a : a + 90] + noise(100)) for i, a in enumerate(range(0, 200, 20))]
    found = decontaminate.leaks(spark.createDataFrame(rows, DOC), spark.createDataFrame([(1, item)], ITEM)).collect()
    assert {r["doc_id"] for r in found} == {d for d, _ in rows if d < 5000}
    for r in found:
        text, k = dict(rows)[r["doc_id"]], r["edits"]
        region = np.frombuffer(text[r["start"] : r["end"]].encode(), np.uint8)
        assert k <= 7 and int(decontaminate.align(region, np.frombuffer(item.encode(), np.uint8)).min()) <= k


def test_leaks_of_short_items(spark):
    items = [(n, "".join(chr(97 + (i * i * n + 7 * i + n) % 26) for i in range(n))) for n in (12, 17, 23, 33, 34, 47)] + [(5, "q9x z"), (0, "")]
    rows = [(n, f"12 {t} 34") for n, t in items] + [(100, "no such item, q9x zz"), (133, f"12 {items[3][1][:16]}#{items[3][1][17:]} 34")]
    found = decontaminate.leaks(spark.createDataFrame(rows, DOC), spark.createDataFrame(items, ITEM)).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in found} == {(n, n, 0) for n, t in items if t} | {(133, 33, 1)}


def test_texts_without_letters_are_und():
    m = langid.Model([("aa", ["some words of it"]), ("zh", ["\u4f60\u597d\u4e16\u754c"])], 384).ready()
    texts = ["\U0001f600 \U0001f680", "\u3000\u3001\u3002", "\uff11\uff12", "\u4f60\u597d\U0001f600", "some words \U0001f600"]
    assert langid.classify(m, texts, 1024)[0] == ["und", "und", "und", "zh", "aa"]


def test_rare_scripts_keep_their_letters():
    rng = np.random.default_rng(5)
    text = lambda first, n: "".join(chr(first + c) for c in rng.integers(0, 16, n))
    wide = [("".join(chr(0x430 + c) for c in range(32)) + "".join(chr(0x561 + c) for c in range(38)) + "abcdefghijklmnopqrstuvwxyz") * 4]
    m = langid.Model([("aa", wide), ("g1", [text(0x10D0, 100)]), ("g2", [text(0x10E0, 100)])], 384).ready()
    assert langid.classify(m, [text(0x10D0, 60), text(0x10E0, 60), "abcdef"], 1024)[0] == ["g1", "g2", "aa"]


def test_sample_is_of_different_texts_and_places(spark):
    rng = np.random.default_rng(6)
    head = "licence line that opens all documents " * 40
    body = lambda: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(2000))
    rows = [(i, head + body(), "en") for i in range(20)] + [(100 + i, head, "en") for i in range(200)]
    m = langid.fit(spark.createDataFrame(rows, f"{DOC}, lang string"))
    texts = m.samples[0][1]
    assert len(texts) == 21 and sum("licence line" in t[:384] for t in texts) <= 8


def test_candidates_of_any_length(spark):
    token = lambda n: ("a1B2c3D4e5" * (n // 10 + 1))[:n]
    long = "x" * 70 + ".y"
    rows = [(n, f"api key: {token(n)} end") for n in (19, 20, 128, 129, 5000)] + [(1, f"mail {long} (at) host (dot) com"), (2, f"mail {long[:20]} (at) host (dot) com")]
    docs = spark.createDataFrame(rows, DOC)
    got = {r["doc_id"]: [(c["kind"], c["start"], c["end"]) for c in r["c"]] for r in docs.select("doc_id", pii._candidates(docs["text"]).alias("c")).collect()}
    spoken = lambda n: ("spoken", 5, 5 + n + len(" (at) host (dot) com"))
    assert got == {19: [], **{n: [("secret", 9, 9 + n)] for n in (20, 128, 129, 5000)}, 1: [("secret", 5, 75), spoken(72)], 2: [("secret", 5, 25), spoken(20)]}


def test_recall_of_personal_data_and_secrets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs)).select("doc_id", "text", "spans").collect()
    planted = {
        "secret": r'token = "([0-9a-f]{40})"',
        "email": r"[a-z]+\.[0-9]+@mail[0-9]\.example\.com",
        "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])",
    }
    for kind, pattern in planted.items():
        known = [(r["text"], m.span(m.lastindex or 0), r["spans"]) for r in found for m in re.finditer(pattern, r["text"] or "")]
        hit = sum(any(s["start"] <= a and b <= s["end"] for s in spans) for _, (a, b), spans in known)
        assert not known or hit >= 0.9 * len(known), (kind, hit, len(known))
    plain = [r for r in found if r["text"] and not re.search(r"[0-9@]", r["text"])]
    assert sum(bool(r["spans"]) for r in plain) <= 0.01 * max(1, len(plain))


def test_many_spans_in_one_text(spark):
    text = "x a@b.co é " * 3000
    df = spark.createDataFrame([(1, text), (1, text), (2, "10.0.0.1 " * 130), (None, None), (3, "")], DOC)
    out = pii.redact(pii.detect(df, [])).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == [None, "x [EMAIL] é " * 3000, "x [EMAIL] é " * 3000, "[IP] " * 130, ""]


def long_text(seed, words):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(words))


def test_repeats_in_very_long_texts(spark):
    one, other, passage = long_text(1, 150_000), long_text(2, 150_000), long_text(3, 60)
    half = len(one) // 2
    rows = [(1, one[:half] + passage + one[half:]), (2, passage + other), (3, "short")]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: (len(passage), 1, one.encode()), 2: (len(passage), 1, other.encode()), 3: (0, 0, b"short")}


def test_very_long_texts_are_encoded_whole(spark):
    import public_tokenizers

    tokens = bpe.Tokens(open(public_tokenizers.path("word_bpe_49k.json")).read())
    text = long_text(4, 200_000) + " \u65e5\u672c " + "x" * 50_000
    got = bpe.decode(bpe.encode(spark.createDataFrame([(1, text), (2, "a b")], DOC), tokens), tokens).orderBy("doc_id").collect()
    tok, _ = tokens.library()
    for r, t in zip(got, (text, "a b"), strict=True):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == tok.decode(ids, skip_special_tokens=False)


def test_leaks_in_very_long_texts_and_clashing_columns(spark):
    item, text = long_text(5, 40), long_text(6, 300_000)
    docs = spark.createDataFrame([(1, text + item + text, 9, 9), (2, text, 9, 9)], f"{DOC}, item_id long, start long")
    found = decontaminate.leaks(docs, spark.createDataFrame([(7, item)], ITEM)).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in found} == {(1, 7, 0)} and min(r["start"] for r in found) == len(text)


def test_repeated_ids_of_differing_labels(spark):
    docs = spark.createDataFrame([(1, "good words here", "a"), (1, "other good words", "b"), (2, "#### 12 ## 9", "c"), (3, long_text(7, 200_000), "d")], f"{DOC}, y string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, quality int")
    machine = quality.fit(docs, labels)
    scores = {r["y"]: r["score"] for r in quality.score(docs, machine).collect()}
    assert set(scores) == set("abcd") and scores["a"] > 0.5 > scores["c"]  # a row of label 1 outweighs one of label 0
