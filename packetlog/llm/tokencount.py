"""Token counts with a whole-token shortcut (operator 2).

A byte-level BPE vocabulary is read once on the driver. Offline, every
vocabulary string is run through the merges; those that come back as one token
form the whole-token table. A text is cut into pre-tokens, each pre-token in the
table counts one, and only the rest is merged (with a bounded memo of results,
which changes speed but never counts). Added tokens such as ``<|endoftext|>``
inside a text count one each and cut the text, as in the library's default.

Texts are counted whole in one pass without a shuffle; the vocabulary is the
only broadcast (about 3 MB, fixed by the file; ``MAX_VOCAB_BYTES`` is enforced).

Edge cases: null text is the empty text (0 bytes, 0 tokens); null or repeated
ids and repeated rows are counted like any other; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlog.llm import common as C

TOKEN_LIMIT = 512
MAX_VOCAB_BYTES = 64 << 20
#: Fixed value: the pre-token pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Remembered results per worker: merged pre-tokens, and counts of words.
MEMO = 400_000
NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    visible Latin-1, else the next free one from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Merges:
    """Number of tokens that BPE merging leaves of a string of byte letters."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        self.ranks = ranks

    def count(self, word: str) -> int:
        if len(word) > 48:
            return self._count_long(word)
        parts, rank = list(word), self.ranks.get
        while len(parts) > 1:
            found = [rank(p, NONE) for p in zip(parts, parts[1:])]
            best = min(found)
            if best == NONE:
                break
            k = found.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return len(parts)

    def _count_long(self, word: str) -> int:
        """The same with a heap and linked neighbours, n log n for long words."""
        parts, ranks, n = list(word), self.ranks, len(word)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= n or parts[j] != b:
                continue  # one of the two was merged meanwhile
            parts[k], parts[j], after[k] = a + b, "", after[j]
            if after[j] < n:
                before[after[j]] = k
            left -= 1
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return left


class TokenCounter(dict):
    """Tokens of each pre-token: whole tokens, and what has been merged so far."""

    def __init__(self, vocab: dict):
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): letters[b] for b in range(256)})
        self.merges = Merges(vocab["ranks"])
        self.split = regex.compile(PRETOKEN).findall
        self.added = regex.compile("|".join(map(regex.escape, vocab["added"]))) if vocab["added"] else None
        super().__init__(dict.fromkeys(vocab["whole"], 1))
        self.room = len(self) + MEMO
        self.words = WordCounter(self)

    def __missing__(self, pretoken: str) -> int:
        n = self.merges.count(pretoken.encode().decode("latin-1").translate(self.letters))
        if len(self) < self.room and len(pretoken) < 100:
            self[pretoken] = n
        return n

    def plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.split(text)))

    def part(self, text: str) -> int:
        """A space between two characters that aren't white space always begins
        a pre-token, so words between such spaces count one by one."""
        first, *rest = text.split(" ")
        n = sum(map(self.words.__getitem__, rest))
        if n < 0 or first[-1:].isspace() or not first and rest:
            return self.plain(text)  # other white space next to a space
        return n + self.plain(first)

    def count(self, text: str) -> int:
        if self.added is None:
            return self.part(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.part, parts))


class WordCounter(dict):
    """Tokens of a word with the space before it; very negative if the word
    can't be counted by itself."""

    def __init__(self, tokens: TokenCounter):
        super().__init__()
        self.tokens = tokens

    def __missing__(self, word: str) -> int:
        alone = word and not word[0].isspace() and not word[-1].isspace()
        n = self.tokens.plain(" " + word) if alone else -NONE
        if len(self) < MEMO and len(word) < 100:
            self[word] = n
        return n


def load_vocabulary(path: str) -> dict:
    """Merge ranks, added tokens and the proven whole tokens of a byte-level BPE
    file in the tokenizers library's JSON format."""
    if os.path.getsize(path) > MAX_VOCAB_BYTES:
        raise ValueError(f"vocabulary file above {MAX_VOCAB_BYTES} bytes")
    with open(path, encoding="utf-8") as fh:
        spec = json.load(fh)
    kind = spec["model"]["type"], (spec.get("pre_tokenizer") or {}).get("type"), spec.get("normalizer")
    if kind != ("BPE", "ByteLevel", None) or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"not a plain byte-level BPE file: {kind}")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take in their surroundings are not supported")
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
    ranks = {p: k for k, p in enumerate(pairs)}
    merges, of_letter = Merges(ranks), {x: b for b, x in enumerate(byte_letters())}
    added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    whole = []
    for piece in spec["model"]["vocab"]:
        # Pieces that are not whole characters can't be a pre-token by themselves.
        if all(x in of_letter for x in piece) and merges.count(piece) == 1:
            raw = bytes(of_letter[x] for x in piece)
            text = raw.decode("utf-8", "ignore")
            if text and text.encode() == raw:
                whole.append(text)
    return {"ranks": ranks, "added": added, "whole": whole}


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def count(batches):
        # The worker's copy of the vocabulary also keeps its counter between tasks.
        vocab = shared.value
        counter = vocab.get("counter") or vocab.setdefault("counter", TokenCounter(vocab))
        for batch in batches:
            n = [counter.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(C.TEXT).cast("string"), F.lit(""))
    rows = docs.select(F.col(C.DOC_ID).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
