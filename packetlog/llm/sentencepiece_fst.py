"""SentencePiece encoding and decoding by a weighted finite-state transducer
(operator 4).

The model file is compiled once into three transducers that are composed with
each input:

* normaliser: the rules of the model's character map (a double-array trie with
  replacements), longest match first, then blanks: trimmed and run together if the
  model says so, written as U+2581, one put in front of the text;
* pieces: a trie over the vocabulary; an arc consumes a piece and emits its id;
* byte fallback: a character without a piece emits its UTF-8 bytes' ids.

The weights lie in the tropical semiring (sums along a path, minimum over paths).
For a unigram model a piece weighs minus its score and the shortest path is the
encoding: one relaxation per arc, in order of positions. BPE models merge the
adjacent pair with the best joined piece until none is left; that is no sum of piece
scores. It is a shortest path all the same once a state remembers the last
piece: two pieces may follow each other (weight 0) only if merging their joined text
gives back exactly these two, else the arc weighs infinity. BPE encodings are the
paths whose neighbours are all compatible, and each text has exactly one (van
Antwerpen and Neubeck, 2024, for merge rules that, as here, depend on the joined
piece only; the tests count them). With one path of finite weight the minimum is the
first one that arrives: the search goes depth first, long pieces first, and never
enters a state twice.

Where no piece holds U+2581 after another character (this is checked when the model
is compiled), no arc crosses a blank that follows another character: words are then
encoded one by one, and a bounded memo keeps those of late. Other models are encoded
text by text.

Decoding maps ids to pieces, joins runs of byte pieces as UTF-8 (invalid bytes
become U+FFFD), turns U+2581 back into blanks and drops the blank put in front.

Models with user-defined pieces, or with blanks as suffixes, are refused.

Edge cases: null and empty texts have no ids and decode to the empty text; a
text that holds U+2581 itself decodes with blanks in its place, as in the
library. Unigram paths of equal weight: the one whose last pieces start first (the
library adds in single precision and may see a difference). Rows with null or repeated ids are encoded like any other; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlog.llm import common as C

SPACE = "▁"
MAX_MODEL_BYTES = 64 << 20
#: Words of one generation of the memo, which keeps two; pairs of pieces.
MEMO, PAIRS = 300_000, 1_000_000
#: Rows whose ids are held at once.
ROWS = 512
#: Field numbers and piece types of the model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Weight of no path.
INFINITE = float("inf")


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    def number(k):
        n = shift = 0
        while True:
            n |= (raw[k] & 127) << shift
            shift, k = shift + 7, k + 1
            if raw[k - 1] < 128:
                return n, k

    k = 0
    while k < len(raw):
        tag, k = number(k)
        if tag & 7 == 0:
            value, k = number(k)
        else:
            size, k = number(k) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], k)
            value, k = raw[k:k + size], k + size
        yield tag >> 3, value


def load_model(path: str) -> dict:
    """Pieces and settings of a model file, checked for what is supported."""
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"model file above {MAX_MODEL_BYTES} bytes")
    with open(path, "rb") as fh:
        raw = fh.read()
    pieces, kind, rules, suffix = [], UNIGRAM, {}, 0
    for field, value in _fields(raw):
        if field == PIECES:
            p = dict(_fields(value))
            pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, bytes(4)))[0], p.get(3, NORMAL)))
        elif field == TRAINER:
            trainer = dict(_fields(value))
            kind, suffix = trainer.get(3, kind), trainer.get(24, suffix)
        elif field == NORMALIZER:
            rules |= dict(_fields(value))
    if any(t == USER for _, _, t in pieces):
        raise ValueError("user-defined pieces are not supported")
    if suffix or not rules.get(5, 1):
        raise ValueError("blanks must be escaped, and stand in front of a word")
    return {"pieces": pieces, "bpe": kind == BPE, "prefix": bool(rules.get(3, 1)), "trim": bool(rules.get(4, 1)),
            "rules": character_map(rules.get(2, b""))}


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a character map: its size, a double-array trie over UTF-8 bytes
    whose values are offsets into the replacements, each ended by a zero byte."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = struct.unpack_from(f"<{size // 4}I", blob, 4)
    texts = blob[4 + size:]
    # Fixed values of a unit: the offset to its children, whether one of them is a
    # value (the child of label 0), a value's bits, a label's bits.
    children = lambda unit: (unit >> 10) << ((unit >> 9 & 1) << 3)
    value, label = (1 << 31) - 1, 1 << 31 | 255
    rules, stack = {}, [(children(units[0]), b"")]
    while stack:
        base, read = stack.pop()
        for byte in range(1, 256):
            at = base ^ byte
            if at >= len(units) or units[at] & label != byte:
                continue
            below, longer = at ^ children(units[at]), read + bytes([byte])
            if units[at] >> 8 & 1:
                start = units[below] & value
                rules[longer.decode()] = texts[start:texts.index(0, start)].decode()
            stack.append((below, longer))
    return rules


class Normaliser:
    """Rewrites a text by the longest rules from left to right, then its blanks."""

    def __init__(self, rules: dict[str, str], trim: bool, prefix: bool):
        self.rules, self.trim, self.prefix = rules, trim, prefix
        self.longest = max(map(len, rules), default=0)
        first = "".join(re.escape(c) for c in sorted({r[0] for r in rules}))
        self.hits = re.compile(f"[{first}]").finditer if rules else None

    def rewritten(self, text: str) -> str:
        out, done = [], 0
        for hit in self.hits(text):
            at = hit.start()
            if at < done:
                continue
            for n in range(min(self.longest, len(text) - at), 0, -1):
                new = self.rules.get(text[at:at + n])
                if new is not None:
                    out += [text[done:at], new]
                    done = at + n
                    break
        return "".join([*out, text[done:]])

    def __call__(self, text: str) -> str:
        if self.hits:
            text = self.rewritten(text)
        if self.trim:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if text and self.prefix:
            text = " " + text
        text = text.replace(" ", SPACE)
        return text.rstrip(SPACE) if self.trim else text


class Transducer:
    """Encoder and decoder of one model."""

    def __init__(self, model: dict):
        self.prefix, self.bpe = model["prefix"], model["bpe"]
        self.normal = Normaliser(model.get("rules", {}), model.get("trim", False), self.prefix)
        self.text, self.kind = [p for p, _, _ in model["pieces"]], [t for _, _, t in model["pieces"]]
        self.ids = {p: k for k, (p, _, t) in enumerate(model["pieces"]) if t == NORMAL}
        self.score = [s for _, s, _ in model["pieces"]]
        self.byte = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(model["pieces"]) if t == BYTE}
        self.plain = frozenset(self.ids.values())
        self.unknown = next(k for k, (_, _, t) in enumerate(model["pieces"]) if t == UNKNOWN)
        # A character without a piece costs 10 more than the worst piece (a fixed
        # value of the library).
        self.missing = 10 - min((self.score[k] for k in self.plain), default=0.0)
        # The trie: a node maps characters to nodes; "" tells that a piece ends.
        self.trie: dict = {}
        for piece in self.ids:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = True
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        # A word: the blanks in front of it and what follows up to the next blank.
        whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.words = (lambda t: [t]) if whole else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    # ------------------------------------------------------------- encoding

    def merged(self, text: str) -> list[str]:
        """What merging leaves of a text: the best joined piece first, of equal
        ones the leftmost. Used to decide whether two pieces are compatible."""
        parts, ids, score = list(text), self.ids, self.score
        while len(parts) > 1:
            found = [score[ids[a + b]] if a + b in ids else -1e38 for a, b in zip(parts, parts[1:])]
            best = max(found)
            if best == -1e38:
                break
            k = found.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """May piece b follow piece a (or begin the word, if a is empty)?"""
        found = self.merged(a + b) == ([a, b] if a else [b])
        if len(self.pairs) < PAIRS:
            self.pairs[a, b] = found
        return found

    def arcs(self, word: str, at: int) -> list[str]:
        """The pieces that start at a position, short ones first; the first is the
        character itself, a piece or not."""
        found, node = [word[at]], self.trie.get(word[at])
        stop = at + 1
        while node and stop < len(word):
            node = node.get(word[stop])
            stop += 1
            if node and "" in node:
                found.append(word[at:stop])
        return found

    def merged_path(self, word: str) -> list[str]:
        """The path of finite weight through the composition with a word (BPE)."""
        size, known = len(word), self.pairs.get
        path, options, at = [""], [self.arcs(word, 0)], 0
        seen: set[tuple[int, str]] = set()  # states left in vain, by position and last piece
        while at < size:
            before, left = path[-1], options[-1]
            while left:
                piece = left.pop()
                fits = known((before, piece))
                if (fits if fits is not None else self.compatible(before, piece)) and (not seen or (at + len(piece), piece) not in seen):
                    path.append(piece)
                    at += len(piece)
                    if at < size:
                        options.append(self.arcs(word, at))
                    break
            else:  # no way on: back to the state before
                seen.add((at, before))
                options.pop()
                at -= len(path.pop())
        return path[1:]

    def scored_path(self, word: str) -> list[str]:
        """The shortest path by piece scores (unigram)."""
        size, ids, score = len(word), self.ids, self.score
        cost, last = [0.0] + [INFINITE] * size, [""] * (size + 1)
        for at in range(size):
            here = cost[at]
            for piece in self.arcs(word, at):
                k, stop = ids.get(piece), at + len(piece)
                weight = here + (self.missing if k is None else -score[k])
                if weight < cost[stop]:
                    cost[stop], last[stop] = weight, piece
        pieces, at = [], size
        while at:
            pieces.append(last[at])
            at -= len(last[at])
        return pieces[::-1]

    def word_ids(self, word: str) -> tuple[int, ...]:
        """A word's ids, from the memo's older generation or the composition."""
        found = self.old.get(word)
        if found is None:
            ids: list[int] = []
            unknown = False  # neighbouring unknown characters are one id
            for piece in self.merged_path(word) if self.bpe else self.scored_path(word):
                k = self.ids.get(piece)
                if k is not None:
                    ids.append(k)
                elif self.byte:
                    ids.extend(self.byte[b] for b in piece.encode("utf-8", "replace"))
                elif not unknown:
                    ids.append(self.unknown)
                unknown = k is None
            found = tuple(ids)
        if len(word) < 64:
            if len(self.new) >= MEMO:
                self.old, self.new = self.new, {}
            self.new[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if text:
            add = ids.extend
            for word in self.words(self.normal(text)):
                found = self.new.get(word)
                add(self.word_ids(word) if found is None else found)
        return ids

    # ------------------------------------------------------------- decoding

    def decode(self, ids: list[int]) -> str:
        if self.plain.issuperset(ids):
            text = "".join([self.text[k] for k in ids]).replace(SPACE, " ")
            return text[1:] if self.prefix and text.startswith(" ") else text
        out, run = [], bytearray()
        for k in ids:
            if self.kind[k] == BYTE:
                run.append(int(self.text[k][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if self.kind[k] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kind[k] != CONTROL:
                out.append(self.text[k])
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _mapped(rows: DataFrame, path: str, work, schema: str, kinds: list) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(load_model(path))

    def run(batches):
        model = shared.value  # the worker's copy keeps its transducer between tasks
        fst = model.get("fst") or model.setdefault("fst", Transducer(model))
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                out = [work(fst, x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(_column([x[i] for x in out], t) for i, t in enumerate(kinds))],
                    names=[f.strip().split(" ")[0] for f in schema.split(",")])

    return rows.mapInArrow(run, schema)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    flat = array("i")
    for v in values:
        flat.extend(v)
    stops = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (the whole text's piece ids), ``n_tokens``, and
    ``round_trip``: whether decoding the ids gives back the text."""
    def work(fst, text):
        ids = fst.encode(text)
        return ids, len(ids), fst.decode(ids) == text

    rows = docs.select(F.col(C.DOC_ID).alias("doc_id"), F.coalesce(F.col(C.TEXT).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _mapped(rows, path, work, f"doc_id {kind}, ids array<int>, n_tokens int, round_trip boolean", [pa.list_(pa.int32()), pa.int32(), pa.bool_()])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``doc_id`` and ``ids``; null ids are
    the empty text, ids outside the vocabulary raise IndexError."""
    rows = encoded.select(F.col(C.DOC_ID).alias("doc_id"), F.coalesce(F.col("ids").cast("array<int>"), F.expr("cast(array() as array<int>)")).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _mapped(rows, path, lambda fst, ids: (fst.decode(ids),), f"doc_id {kind}, text string", [pa.string()])


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
