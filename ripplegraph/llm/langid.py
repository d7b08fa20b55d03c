"""Language identification by cross-parsing entropy.

A suffix automaton of some labelled text is kept for each language. A text is cut greedily into the
longest phrases that occur in that language's text; the fewer phrases, the closer the language. The
phrase count is normalised by the text length, and the language with the fewest phrases wins.

The labelled text is a bounded sample (a fitted model, not a corpus count): `docs_per_lang`
different texts of each language in the order of a hash of the text, and `chars_per_doc` letters of each
from a hashed position on, so that neither copies nor common openings are learnt again and again.
Every text to be labelled is parsed whole. Parsing restarts every `piece` characters, so that one
very long text is many independent pieces; a restart costs at most one phrase in `piece` characters.

The automata are compiled to transition tables (a missing edge leads to the successor of the root
and is marked as a cut), and all pieces of an Arrow batch advance together, one character a step.

Defined cases: a null text, or one without any letter, is `und` with score 0. Ties go to the language
that sorts first. No labelled row at all: every text is `und`. Rows are answered one by one, so
repeated rows and repeated ids give repeated answers; other columns are kept, but for the two added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters under this code point are symbols of their own; letters beyond share one symbol per 32 points.
TABLE = 0x3000


def simple(text: str) -> np.ndarray:
    """Lower-case letters as code points; every run of anything else is one space."""
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    far = low >= TABLE
    out = np.where(_letters()[low], np.where(far, (low >> np.uint32(5)) + np.uint32(TABLE), low), np.uint32(32))
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


class Automaton:
    """Suffix automaton of a sequence of small integers, grown one symbol at a time."""

    def __init__(self, symbols: list[int]):
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        edges, link, length = self.edges, self.link, self.length
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
        return new

    def table(self, alphabet: int) -> np.ndarray:
        """Transitions, flat; missing edges go to the root's successor and have the lowest bit set."""
        out = np.full((len(self.edges), alphabet), -1, np.int64)
        for s, edges in enumerate(self.edges):
            if edges:
                out[s, list(edges)] = list(edges.values())
        first = np.maximum(out[0], 0)
        cut = out < 0
        flat = np.where(cut, first[None, :], out) * alphabet
        flat = flat * 2 + cut
        return flat.astype(np.int32 if flat.max() < 2**31 else np.int64).ravel()


class Model:
    """Automata of all languages, each over the symbols of its own sample; a symbol of no sample, or of other samples, is the same foreign symbol."""

    def __init__(self, samples: list[tuple[str, list[str]]], chars_per_doc: int):
        self.samples, self.chars = sorted(samples), chars_per_doc
        self.languages = [x for x, _ in self.samples]
        self._tables: list[np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None, "_own": None, "codes": None}

    def ready(self) -> Model:
        if self._tables is None:
            parts = {lang: [simple(t)[: self.chars] for t in texts] for lang, texts in self.samples}
            every = np.concatenate([p for ps in parts.values() for p in ps]) if parts else np.empty(0, np.uint32)
            symbols = np.unique(every)
            self.codes = np.ones(TABLE + (0x110000 >> 5) + 1, np.int32)  # 1: a symbol of no sample; 0: end of a sample
            self.codes[symbols] = np.arange(len(symbols)) + 2
            self._tables, self._own = [], []
            for lang in self.languages:
                seq = np.concatenate([np.append(self.codes[p], 0) for p in parts[lang]])
                mine = np.unique(seq[seq > 0])
                own = np.ones(len(symbols) + 2, np.int32)  # code to code of this language
                own[0], own[mine] = 0, np.arange(len(mine)) + 2
                self._tables.append(Automaton(own[seq].tolist()).table(len(mine) + 2))
                self._own.append(own)
        return self

    def phrases(self, columns: list[np.ndarray], n: int) -> np.ndarray:
        """Phrases per language (rows) of n pieces; columns[j] has the j-th symbols of those pieces that are so long, longest first."""
        out = np.zeros((len(self.languages), n), np.int64)
        for i, (table, own) in enumerate(zip(self._tables, self._own, strict=True)):
            state = np.zeros(n, table.dtype)
            count = out[i]
            for codes in columns:
                m = len(codes)
                step = table[state[:m] + own[codes]]
                count[:m] += step & 1
                state[:m] = step >> 1
            count += 1  # the phrase that the end of the piece closes
        return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 96, chars_per_doc: int = 384) -> Model:
    """Sample `docs_per_lang` different labelled texts of each language (by text hash) and build the model.

    The number of different texts of each language (estimated) sets a hash threshold that passes about four times the rows needed,
    so what is sorted is small whatever the table holds.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    first = F.pmod(F.xxhash64("text", F.lit("at")), F.greatest(F.length("text") - chars_per_doc, F.lit(0)) + 1)
    samples = []
    for lang, n in sorted(sizes.items()):
        share = min(1.0, 4.0 * docs_per_lang / n + 1e-9) if n > 8 * docs_per_lang else 1.0
        top = int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1
        slices = rows.where((F.col("lang") == lang) & (F.col("h") <= top)).select("h", F.substring("text", first.cast("int") + 1, F.lit(4 * chars_per_doc)).alias("text"))
        some = slices.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(docs_per_lang)
        samples.append((lang, [r["text"] for r in some.collect()]))
    return Model([s for s in samples if s[1]], chars_per_doc)


def identify(docs: DataFrame, model: Model, text_col: str = "text", piece: int = 1024) -> DataFrame:
    """docs plus lang_pred (string) and score (double, the winner's lead: 1 - best / second best phrase count)."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    fields = [f.name for f in docs.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = shared.value.ready()
            texts = common.column(batch, text_col).to_pylist()
            labels, scores = classify(m, texts, piece)
            keep = [batch.column(i) for i, f in enumerate(fields) if f != text_col]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*(f for f in fields if f != text_col), "lang_pred", "score"])

    return docs.mapInArrow(named, f"{schema}, lang_pred string, score double")


def classify(m: Model, texts: list[str | None], piece: int) -> tuple[list[str], list[float]]:
    """Predicted language and lead of each text."""
    codes, owner = [], []
    for i, text in enumerate(texts):
        if not text or not m.languages:
            continue
        s = simple(text)
        if not (s != 32).any():
            continue
        c = m.codes[s]
        for at in range(0, len(c), piece):
            codes.append(c[at : at + piece])
            owner.append(i)
    labels, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not codes:
        return labels, scores
    sizes = np.array([len(c) for c in codes])
    order = np.argsort(-sizes, kind="stable")
    grid = np.zeros((int(sizes.max()), len(codes)), np.int32)
    for k, j in enumerate(order):
        grid[: sizes[j], k] = codes[j]
    alive = np.searchsorted(-sizes[order], -np.arange(len(grid)), side="left")
    counts = m.phrases([grid[j, : alive[j]] for j in range(len(grid))], len(codes))
    total = np.zeros((len(m.languages), len(texts)), np.int64)
    for i in range(len(m.languages)):
        np.add.at(total[i], np.array(owner)[order], counts[i])
    for t in set(owner):
        ranked = np.argsort(total[:, t], kind="stable")
        labels[t] = m.languages[ranked[0]]
        scores[t] = 1.0 - float(total[ranked[0], t] / total[ranked[1], t]) if len(ranked) > 1 else 1.0
    return labels, scores


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that a model may learn from: those whose crc32 of the id is not 2 modulo 4."""
    return common.fold(F.col(id_col)) != 2
