"""Collocations against plain counting."""

from __future__ import annotations

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa

from ripplegraph.llm import collocations, oracles, queries

SMALL = "/root/testdata/sf0.001"
DOC = "text string, lang string"


def brute(rows, support, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang in n:
        found = []
        for p, a in f.items():
            if p[0] != lang or len(p) < 3 or a < support:
                continue
            if len(p) == 3 and any(100 * b >= 50 * a and b >= support and p[1:] in (q[1:3], q[2:4]) for q, b in f.items() if q[0] == lang and len(q) == 4):
                continue
            cuts = [(1_000_000 * a * a // (f[p[: k + 1]] * f[(lang, *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            s, k = min(cuts)
            found.append((-s, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(lang, *p[k + 1 :])]))
        for i, (s, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            out.add((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -s))
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_query_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = db.execute("select lang, rank, phrase, a, l, r, n, score from (" + oracles.ORACLE_SQL["op12_collocations"] + ")").fetchall()
    got = rows_of(queries.op12_collocations(spark, SMALL))
    assert got == set(want) and len(got) > 100


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(400):
        words = rng.choices(["a", "b", "Cd", "É", "e　f", "über", "x\x00", "gg"], [9, 5, 3, 2, 2, 1, 1, 1], k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ".", ", ", "\n", "\x0b"]) for w in words)
        rows.append((text, rng.choice(["en", "EN", None, "und", "l\nm", ""])))
    rows += [(None, "en"), ("", None), ("a b " * 5000, "en"), ("a\tb" + "z" * 5000, "lone")]
    want = brute(rows, 10, 12)
    df = spark.createDataFrame(rows, DOC)
    assert rows_of(collocations.mine(df, top=12, bits=16)) == want
    # a bitmap so small that nearly all is let through, and slices of a few phrases
    assert rows_of(collocations.mine(df.repartition(5), top=12, bits=8, slice_rows=40)) == want


def test_exact_scores_of_large_counts(spark):
    df = spark.createDataFrame([(10**13 - 7, 10**13 - 3, 3 * 10**13 + 1)], "a long, l long, r long")
    a, left, right = 10**13 - 7, 10**13 - 3, 3 * 10**13 + 1
    assert df.select(collocations.score(df.a, df.l, df.r)).first()[0] == 1_000_000 * a * a // (left * right)


def test_tries_count_like_sets():
    rng = np.random.default_rng(2)
    rows = np.unique(rng.integers(0, 40, (900, 3)).astype(np.int32), axis=0)
    text = np.append(rng.integers(-1, 40, 20_000), [-1, -1, -1]).astype(np.int32)
    trie = collocations.Trie(rows, 40)
    found = trie.count(text, 3)
    got = np.bincount(found[found >= 0], minlength=len(rows))
    seen = collections.Counter(map(tuple, np.stack([text[:-2], text[1:-1], text[2:]], axis=1).tolist()))
    assert got.tolist() == [seen[tuple(r)] for r in rows.tolist()]
    hub = np.stack([np.zeros(3000, np.int32), np.arange(3000, dtype=np.int32)], axis=1)
    trie = collocations.Trie(hub, 3000)
    assert sorted(trie.count(np.array([0, 7, 0, 0, -1, -1, -1], np.int32), 2).tolist()) == [0, 7]


def test_no_documents(spark):
    assert collocations.mine(spark.createDataFrame([], DOC)).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None)], DOC)).count() == 0
    assert collocations.mine(spark.createDataFrame([("a b c", "en"), ("a. " * 20, "en")], DOC)).count() == 0


def test_a_candidate_is_named_by_one_crew_of_shards():
    class Held:
        def __init__(self, value):
            self.value = value

    bits, every = 16, np.full(1 << 13, 255, np.uint8)
    texts = [f"w{i} same old words w{i}" for i in range(40)]
    shards = [list(collocations._encode(iter([pa.RecordBatch.from_pydict({"text": [t], "lang": ["en"]})]))) for t in texts]
    counts = [b for s in shards for b in collocations._hash_counts(Held([every]), bits, 10, 1)(iter(s))]
    often = collocations._frequent(10)(pa.Table.from_batches(counts))
    assert len(often) == 2  # same old, old words
    crews = [np.zeros(1 << 13, np.uint8) for _ in range(collocations.CREWS)]
    for h, crew in zip(often["hash"].to_numpy().view(np.uint64), often["crew"].to_pylist(), strict=True):
        slot = int(h >> np.uint64(64 - bits))
        crews[crew][slot >> 3] |= 1 << (slot & 7)
    named = [tuple(r.values()) for s in shards for b in collocations._named(Held(([every], crews)), bits)(iter(s)) for r in b.to_pylist()]
    wanted = {(b"en\nsame", b"en\nold"), (b"en\nold", b"en\nwords")}
    assert wanted <= set(named)
    assert sum(n in wanted for n in named) < 2 * len(texts)  # not by every shard that has it
