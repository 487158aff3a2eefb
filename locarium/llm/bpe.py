"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

A merge that happens near the end of the bytes read so far can be undone by
bytes still to come, and such a change travels to the left only along a chain of
merges of growing rank. :func:`sufficient_lookahead` bounds how many bytes such
a chain can span for a given merge list; a token that ends at least so many
bytes before the end of the window is stable and is emitted, so the window, and
with it the memory, is constant however long a run without a split may be.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import table, text_udf

#: Splits text before the merges (the pattern of byte-level BPE vocabularies).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 30


def latin_pattern() -> re.Pattern:
    """The same splits for texts of Latin-1 characters only, where a plain ``re`` is quicker."""
    every = [chr(c) for c in range(256)]
    letters = re.escape("".join(c for c in every if unicodedata.category(c)[0] == "L"))
    numbers = re.escape("".join(c for c in every if unicodedata.category(c)[0] == "N"))
    spaces = re.escape("".join(c for c in every if regex.match(r"\s", c)))
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


def byte_letters() -> dict[str, int]:
    """Letter -> byte: printable Latin-1 stands for itself, other bytes take the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end beyond which nothing can change it.

    Whether the merge (a, b) happens can depend on the right only through a merge
    of lower rank that takes b away, or that makes b: one whose left part or whose
    product is b. ``reach`` is the length of the longest such chain of products.
    """
    by_left: dict[bytes, int] = {}
    by_product: dict[bytes, int] = {}
    longest = 1
    for a, b in merges:
        reach = len(a) + len(b) + max(by_left.get(b, 0), by_product.get(b, 0))
        by_left[a] = max(by_left.get(a, 0), reach)
        by_product[a + b] = max(by_product.get(a + b, 0), reach)
        longest = max(longest, reach)
    return longest


class Utf8Machine:
    """Bytes to text piece by piece; only an unfinished sequence of up to 3 bytes is held."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:  # a lead byte: is its sequence complete?
                if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4):
                    cut = len(data) - back
                break
            if b < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Transducer(dict):
    """Piece of text -> its packed ids. Every piece goes through :meth:`stream`; results of pieces of
    up to 64 bytes are remembered, the last ``most`` of them at least and twice as many at most."""

    def __init__(self, path: str, most: int = 100_000):
        super().__init__()
        self.most, self.older = most, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normaliser and prefix space is supported")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for s, i in vocab.items():
            self.token_bytes[i] = raw(s)
        self.special = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that strip or need whole words aren't supported")
            self.special[t["content"]] = t["id"]
            self.token_bytes[t["id"]] = t["content"].encode()
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.byte_ids = [vocab[c] for c in sorted(letters, key=letters.get)]
        self.rank = {vocab[a] << 20 | vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.product = [vocab[a + b] for a, b in pairs]
        self.lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in pairs])
        self.window = 3 * self.lookahead
        self.pieces = regex.compile(PATTERN)
        self.latin = latin_pattern()

    def forget(self) -> None:
        """Give back what is remembered of pieces."""
        self.clear()
        self.older = {}

    def merged(self, data: bytes) -> list[int]:
        """All merges of one window, lowest rank first, then leftmost."""
        if len(data) > 64:
            return self._merged_long(data)
        ids, get, product = [self.byte_ids[b] for b in data], self.rank.get, self.product
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i : i + 2] = (product[best],)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], _NONE)
        return ids

    def _merged_long(self, data: bytes) -> list[int]:
        ids, n = [self.byte_ids[b] for b in data], len(data)
        after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank.get
        heap = [(k, i) for i in range(n - 1) if (k := get(ids[i] << 20 | ids[i + 1], _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            k, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 20 | ids[j], _NONE) != k:
                continue
            ids[i], ids[j] = self.product[k], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(ids[i] << 20 | ids[after[i]], _NONE)) < _NONE:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := get(ids[before[i]] << 20 | ids[i], _NONE)) < _NONE:
                heapq.heappush(heap, (r, before[i]))
        return [x for x in ids if x >= 0]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that arrives in chunks, each as soon as nothing to come can change it;
        holds a window of bytes at most (plus a chunk)."""
        held = b""
        for chunk in chunks:
            held += chunk
            while len(held) > self.window:
                at, stable = 0, self.window - self.lookahead
                for i in self.merged(held[: self.window]):
                    if at + len(self.token_bytes[i]) > stable:
                        break
                    at += len(self.token_bytes[i])
                    yield i
                held = held[at:]
        yield from self.merged(held)

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            data = piece.encode("utf-8", "surrogatepass")
            packed = array("I", self.stream((data,))).tobytes()
            if len(data) > 64:
                return packed
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = packed
        return packed

    def splits(self, text: str, start: int, end: int, step: int) -> Iterator[list[str] | tuple[int, int]]:
        """The pieces of text[start:end] in lists of about ``step`` characters; a piece longer than that
        as its place (start, end). The last pieces of a step may change with what follows and wait for it."""
        while start < end:
            stop = min(end, start + step)
            chunk = text[start:stop]
            found = (self.latin if _in_latin(chunk) else self.pieces).findall(chunk)
            if stop < end:
                if len(found) < 8:  # one that reaches beyond the step
                    m = self.pieces.match(text, start, end)
                    yield m.span()
                    start = m.end()
                    continue
                del found[-4:]
                stop = start + sum(map(len, found))
            yield found
            start = stop

    def emitted(self, text: str, step: int = 1 << 16) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, in blocks of bounded size."""
        at = 0
        for m in chain(self.split.finditer(text) if self.split else (), (None,)):
            for part in self.splits(text, at, m.start() if m else len(text), step):
                if isinstance(part, list):
                    yield b"".join(map(self.__getitem__, part))
                else:
                    ids = self.stream(text[k : min(part[1], k + self.window)].encode("utf-8", "surrogatepass") for k in range(*part, self.window))
                    while block := array("I", islice(ids, step)):
                        yield block.tobytes()
            if m:
                yield self.special[m[0]].to_bytes(4, "little")
                at = m.end()

    def packed(self, text: str) -> bytes:
        return b"".join(self.emitted(text))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: Iterable[int], step: int = 4096) -> Iterator[str]:
        """The text in pieces as ids arrive; ids outside the vocabulary add nothing."""
        machine, ids, size, of = Utf8Machine(), iter(ids), len(self.token_bytes), self.token_bytes.__getitem__
        while block := list(islice(ids, step)):
            if min(block) < 0 or max(block) >= size:
                block = [i for i in block if 0 <= i < size]
            yield machine.feed(b"".join(map(of, block)))
        yield machine.end()

    def digests(self, text: str, with_ids: bool) -> tuple:
        """(number of ids, their digest, digest of the decoded text, ids if wanted): ids are
        hashed, counted and decoded block by block, and kept only if wanted."""
        hashed, back, machine, n, kept = hashlib.sha256(), hashlib.sha256(), Utf8Machine(), 0, []
        of = self.token_bytes.__getitem__
        for block in self.emitted(text):
            n += len(block) // 4
            hashed.update(block)
            back.update(machine.feed(b"".join(map(of, memoryview(block).cast("I")))).encode("utf-8"))
            if with_ids:
                kept.append(block)
        back.update(machine.end().encode("utf-8"))
        return (n, hashed.hexdigest(), back.hexdigest(), *([b"".join(kept)] if with_ids else []))


def _in_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    """One per worker process and vocabulary."""
    return Transducer(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary lies; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(path: str | None = None, with_ids: bool = False):
    """A column function: text -> struct of n_tokens, ids_sha256, decoded_sha256 (and ids).

    Without a path, each executor uses its own copy of the installed vocabulary.
    """

    machine = lambda: transducer(path or vocabulary_path())

    def make():
        t = machine()
        return lambda text: t.digests(text, with_ids)

    return text_udf(make, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids, lambda: machine().forget())


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id with its tokens' count and digests (and ids, little-endian unsigned 32-bit).

    A null or empty text has no tokens; repeated rows are encoded each; other
    columns of docs aren't read. A text is split, encoded and decoded in steps of 65,536
    characters, and a piece beyond that in steps of a window, so that a text of any
    length takes constant memory besides itself (and its ids, if they are wanted). An
    empty table gives an empty one.
    """
    return docs.select("doc_id", encoded(path, with_ids)("text").alias("t")).select("doc_id", "t.*")


def decode_documents(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of packed ids (column ``ids``); null ids give the empty text, ids
    outside the vocabulary nothing; repeated rows are decoded each."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = transducer(path or vocabulary_path())
        for batch in batches:
            yield pa.array(["".join(t.decode(np.frombuffer(v.as_py() or b"", "<u4").tolist())) for v in batch], pa.string())

    return tokens.select("doc_id", F.arrow_udf(run, "string")("ids").alias("text"))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
