"""BPE encoding and decoding through a table of distinct words.

1. Texts are normalised and split into words. Consecutive documents of a task form a chunk: its words
   become a dictionary (words are compared, not hashes), each document a sequence of places in it. A
   chunk ends at `chunk_words` different words or `chunk_bytes` of text, so it is of bounded size.
2. The dictionaries are dealt out by word. A part of the word table meets a word once per chunk, never
   once per occurrence, so a frequent word is no hot key; each distinct word is encoded once there.
3. Ids come back to their chunk, and each document's ids follow from its sequence by position. Sequences
   are read off the documents a second time, which is cheaper than taking them through both shuffles.

There is one path for all sizes: the number of parts grows with the text (`part_bytes` each), rows are
packed, and no text, word table or corpus count passes the driver. Sequences meet ids by chunk name,
a digest of the chunk's texts in their order, so the input must keep the order of its rows when it is
read again, as a scan or a checkpoint does (any other order ends in an error, never in wrong ids).

Splitting is vectorised for texts of Latin letters (code points under 0x250, no apostrophe); any other
text is split by the tokenizer's own normaliser and splitter, so that words are the same everywhere.

Decoding joins each id to its piece (a table as large as the vocabulary) and puts blanks between the
pieces, as the tokenizer does that has no decoder.

Defined cases: null and empty texts have no ids and decode to the empty text. Repeated rows are
answered each. Strings of special tokens inside a text become those tokens, as in the library.
A text of white space only has no ids. A text longer than a slice is worked on alone, whole.
Other columns are kept, those added replace equal names. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

NEAR = 0x250
#: Code points whose lower case leaves the table or is two characters.
ODD = (0x130, 0x23A, 0x23E)
_KINDS: dict[str, np.ndarray] = {}
_LIBRARY: dict[int, object] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and kind (0 white space, 1 letter, 2 number, 3 other) of the code points under NEAR."""
    if not _KINDS:
        kind = np.full(NEAR, 3, np.uint8)
        lower = np.arange(NEAR, dtype=np.uint32)
        for i in range(NEAR):
            c = unicodedata.category(chr(i))[0]
            kind[i] = 0 if i in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else 1 if c == "L" else 2 if c == "N" else 3
            if i not in ODD:
                lower[i] = ord(chr(i).lower())
        _KINDS["lower"], _KINDS["kind"] = lower, kind
    return _KINDS["lower"], _KINDS["kind"]


class Tokens:
    """A tokenizer file's content; the library's object is built once per Python worker."""

    def __init__(self, text: str):
        self.text = text

    def library(self):
        key = hash(self.text)
        if key not in _LIBRARY:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(self.text)
            tok.no_truncation()
            tok.no_padding()
            added = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
            _LIBRARY[key] = tok, re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        return _LIBRARY[key]

    def pieces(self) -> list[str]:
        tok, _ = self.library()
        vocab = tok.get_vocab(with_added_tokens=True)
        out = [""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            out[i] = piece
        return out

    def words(self, text: str) -> list[str]:
        """Words of any text, by the tokenizer's own parts; strings of added tokens are words."""
        tok, added = self.library()
        out: list[str] = []
        for part in added.split(text) if added else [text]:
            if added and added.fullmatch(part):
                out.append(part)
            elif part:
                norm = tok.normalizer.normalize_str(part) if tok.normalizer else part
                out += [norm[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(norm)]
        return out


def split(tokens: Tokens, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends, rows) of the words of a batch, in order of rows and positions."""
    lower, kinds = _tables()
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    off = lead[offsets]
    odd = (cps >= NEAR) | (cps == 39) | np.isin(cps, ODD)
    pipe = np.zeros(len(cps), bool)
    if len(cps) > 1:
        pipe[:-1] = (cps[:-1] == 60) & (cps[1:] == 124)  # "<|" may open an added token
    count = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(odd | pipe, out=count[1:])
    slow = count[off[1:]] > count[off[:-1]]
    near = np.minimum(cps, NEAR - 1)
    low, kind = lower[near], kinds[near]
    edge = np.zeros(len(cps) + 1, bool)
    edge[off] = True
    change = np.ones(len(cps) + 1, bool)
    if len(cps):
        change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cuts = np.flatnonzero(change | edge)
    starts, ends = cuts[:-1], cuts[1:]
    if len(cps):
        word = kind[starts] > 0
        starts, ends = starts[word], ends[word]
    rows = np.searchsorted(off, starts, side="right") - 1
    if slow.any():
        fast = ~slow[rows]
        starts, ends, rows = starts[fast], ends[fast], rows[fast]
        more_s, more_e, more_r, extra, at = [], [], [], [low], len(low)
        for r in np.flatnonzero(slow):
            for w in tokens.words(cps[off[r] : off[r + 1]].tobytes().decode("utf-32-le", "surrogatepass")):
                c = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
                extra.append(c)
                more_s.append(at)
                at += len(c)
                more_e.append(at)
                more_r.append(r)
        low = np.concatenate(extra)
        starts, ends, rows = (np.concatenate([a, np.array(b, np.int64)]) for a, b in ((starts, more_s), (ends, more_e), (rows, more_r)))
        order = np.argsort(rows, kind="stable")
        starts, ends, rows = starts[order], ends[order], rows[order]
    return low, starts, ends, rows


def _distinct(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """Words as a dictionary of the different ones, in UTF-8."""
    cps = low[common.ragged_index(starts, ends - starts)]
    ends = np.concatenate([[0], np.cumsum(ends - starts)])
    if (cps < 128).all():
        raw = cps.astype(np.uint8)
    else:
        raw = cps.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        widths = np.concatenate([[0], np.cumsum(1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000))])
        ends = widths[ends]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()


def _fields(columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


DEALT = "part int, chunk string, place int, head binary, body binary"


class Chunk:
    """Dictionary, and if asked for sequences, of consecutive documents."""

    def __init__(self, sequences: bool):
        self.sequences, self.places, self.parts, self.size = sequences, {}, [], 0
        self.digest = xxhash.xxh3_128()

    def add(self, batch: pa.RecordBatch, tokens: Tokens, text_col: str, keep: list[str]) -> None:
        raw, offsets = common.bytes_of(common.column(batch, text_col))
        self.digest.update(np.diff(offsets).tobytes())
        self.digest.update(np.ascontiguousarray(raw))
        self.size += len(raw)
        low, starts, ends, rows = split(tokens, raw, offsets)
        words = _distinct(low, starts, ends)
        known = self.places
        if not self.sequences:
            for w in words.dictionary.to_numpy(zero_copy_only=False):
                known.setdefault(w, len(known))
            return
        place = np.fromiter((known.setdefault(w, len(known)) for w in words.dictionary.to_numpy(zero_copy_only=False)), np.uint32, len(words.dictionary))
        sequence = common.ragged(place[np.asarray(words.indices)], np.bincount(rows, minlength=len(batch)), pa.uint32())
        self.parts.append(common.write_batch(_fields([*(common.column(batch, c) for c in keep), sequence], [*keep, "word sequence"])))

    def rows(self, bits: int) -> Iterator[pa.RecordBatch]:
        """Either the dictionary cut by word (place 0), or the order of its words (place 1) and the sequences (from 2 on)."""
        name = self.digest.hexdigest()
        words = list(self.places)
        names = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        part = (names >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        if self.sequences:
            bodies = [common.write_batch(_fields([pa.array(order.astype(np.uint32))], ["order"])), *self.parts]
            out = [[-1] * len(bodies), list(range(1, len(bodies) + 1)), [b""] * len(bodies), bodies]
        else:
            sizes = np.fromiter(map(len, words), np.uint32, len(words))[order]
            cuts = np.searchsorted(part[order], np.arange((1 << bits) + 1))
            parts = np.flatnonzero(np.diff(cuts)).tolist()
            heads = [sizes[cuts[p] : cuts[p + 1]].tobytes() for p in parts]
            out = [parts, [0] * len(parts), heads, [b"".join([words[i] for i in order[cuts[p] : cuts[p + 1]].tolist()]) for p in parts]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        part, place, head, body = (pa.array(x, k) for x, k in zip(out, kinds, strict=True))
        whole = _fields([part, pa.array([name] * len(part), pa.string()), place, head, body], ["part", "chunk", "place", "head", "body"])
        for at in range(0, len(whole), 64):
            yield whole.slice(at, 64)


def encode(
    docs: DataFrame,
    tokens: Tokens,
    text_col: str = "text",
    keep: list[str] | None = None,
    part_bytes: int = 4 << 20,
    chunk_words: int = 200_000,
    chunk_bytes: int = 48 << 20,
) -> DataFrame:
    """The columns `keep` of docs (all, if not given) plus ids binary (little-endian unsigned 32-bit ids of the whole text)."""
    common.prepare(docs.sparkSession)
    docs = docs.drop("ids")
    keep = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(31, max(4, int(size // part_bytes).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    wide = "<u4" if len(tokens.pieces()) > 1 << 16 else "<u2"

    def read(sequences: bool):
        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = None
            for batch in batches:
                for some in common.slices(batch, text_col):
                    chunk = chunk or Chunk(sequences)
                    chunk.add(some, shared.value, text_col, keep)
                    if len(chunk.places) >= chunk_words or chunk.size >= chunk_bytes:
                        yield from chunk.rows(bits)
                        chunk = None
            if chunk:
                yield from chunk.rows(bits)

        return chunks

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        last = -1
        for batch in batches:
            if not len(batch):
                continue
            part = common.column(batch, "part").to_numpy()
            raw, offsets = common.bytes_of(common.column(batch, "head"))
            sizes = np.frombuffer(raw.tobytes(), "<u4").astype(np.int64)
            raw, _ = common.bytes_of(common.column(batch, "body"))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
            distinct = words.dictionary.to_numpy(zero_copy_only=False)
            if part[0] != last:
                known = {}
            new = [w for w in distinct if w not in known]
            tok, _ = shared.value.library()
            for at in range(0, len(new), 4096):
                some = new[at : at + 4096]
                text = [w.decode("utf-8", "surrogatepass") for w in some]
                known.update(zip(some, (np.array(e.ids, wide).tobytes() for e in tok.encode_batch(text, add_special_tokens=False)), strict=True))
            raw, first = common.bytes_of(pa.array([known[w] for w in distinct], pa.large_binary()))
            code, length = np.asarray(words.indices), np.diff(first)
            runs = length[code]
            counts = np.diff(offsets) // 4
            bounds = np.concatenate([[0], np.cumsum(runs)])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
            body = pa.py_buffer(np.ascontiguousarray(raw[common.ragged_index(first[code], runs)]))
            ids = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(bounds), body]).cast(pa.binary())
            head = common.blobs((runs // np.dtype(wide).itemsize).astype("<u4"), counts)
            yield _fields([*(common.column(batch, c) for c in ("part", "chunk", "place")), head, ids], batch.schema.names)
            last = int(part[-1])
            if (part != last).any():  # keep what the part that may go on has
                mine = np.unique(code[np.repeat(part == last, counts)])
                known = {distinct[i]: known[distinct[i]] for i in mine.tolist()}

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, last, sizes, ids, table = None, -1, [], [], None
        for batch in batches:
            for name, part, place, head, body in zip(*(common.column(batch, c) for c in ("chunk", "part", "place", "head", "body")), strict=True):
                name, part, place, body = name.as_py(), part.as_py(), place.as_py(), body.as_py()
                if name != chunk:
                    chunk, last, sizes, ids, table = name, -1, [], [], None
                if place == 0:
                    if part != last:  # chunks of equal texts share a name and a dictionary
                        sizes.append(head.as_py())
                        ids.append(body)
                    last = part
                    continue
                if place == 1 and table is not None:
                    continue
                if place == 1:
                    order = np.asarray(common.read_batch(body).column(0)).astype(np.int64)
                    n = np.frombuffer(b"".join(sizes), "<u4").astype(np.int64)
                    if len(n) != len(order):
                        raise ValueError("a chunk's words are not those it was cut from; are the rows of the input in a stable order?")
                    first, length = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
                    first[order], length[order] = np.cumsum(n) - n, n
                    table, sizes, ids = (first, length, np.frombuffer(b"".join(ids), wide)), [], []
                    continue
                if table is None:
                    raise ValueError("a chunk has no words; are the rows of the input in a stable order?")
                first, length, pool = table
                held = common.read_batch(body)
                sequence = held.column(held.num_columns - 1)
                word = np.asarray(sequence.flatten()).astype(np.int64)
                runs = length[word]
                ends = np.concatenate([[0], np.cumsum(runs)])
                counts = np.diff(ends[np.asarray(sequence.offsets)])
                yield _fields([*(held.column(i) for i in range(held.num_columns - 1)), common.blobs(pool[common.ragged_index(first[word], runs)].astype("<u4"), counts)], [*keep, "ids"])

    ids = docs.mapInArrow(read(False), DEALT).repartition("part").sortWithinPartitions("part").mapInArrow(look_up, DEALT)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.BinaryType())])
    both = ids.unionByName(docs.mapInArrow(read(True), DEALT))
    return both.repartition("chunk").sortWithinPartitions("chunk", "place", "part").mapInArrow(gathered, schema)


def decode(encoded: DataFrame, tokens: Tokens, slice_ids: int = 1 << 18) -> DataFrame:
    """encoded (with ids) plus decoded: the pieces of the ids, blanks between them."""
    common.prepare(encoded.sparkSession)
    encoded = encoded.drop("decoded")
    pieces = [p.encode() + b" " for p in tokens.pieces()]
    sizes = np.array([len(p) for p in pieces], np.int64)
    table = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes  # as large as the vocabulary
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, first, length = shared.value
        for whole in batches:
            for b in common.slices(whole, "ids", size=4 * slice_ids):
                raw, offsets = common.bytes_of(common.column(b, "ids"))
                ids = np.frombuffer(raw.tobytes(), "<u4")
                out = text[common.ragged_index(first[ids], length[ids])]
                ends = np.concatenate([[0], np.cumsum(length[ids])])
                bounds = ends[offsets // 4]
                keep = np.ones(len(out), bool)
                keep[bounds[1:][np.diff(bounds) > 0] - 1] = False  # the blank after the last piece
                starts = np.concatenate([[0], np.cumsum(np.diff(bounds) - (np.diff(bounds) > 0))])
                data = pa.py_buffer(np.ascontiguousarray(out[keep]))
                decoded = pa.Array.from_buffers(pa.large_string(), len(b), [None, pa.py_buffer(starts), data]).cast(pa.string())
                yield _fields([*b.columns, decoded], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(joined, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
