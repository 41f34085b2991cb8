r"""Byte-pair encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be joined, so every encoding has a cut between such
bytes. A text is cut at all of them, the fragments are encoded independently (each is a few bytes, and most repeat), and
the ids are concatenated. This holds for texts of any length by one path: the table of 65,536 pairs is looked up for all
bytes of a text at once.

The vocabulary's pre-tokenizer must not notice a cut either. It reads from left to right, looks back at nothing, and looks
ahead only past white space, so a cut is certain

* before an ASCII space: what ends there ends there anyway, and a run of spaces that is cut gives the same ids, as nothing
  joins across the cut;
* between characters of which the left one isn't a space: either a new pre-token begins there, or the cut is inside one;
* after a single space: it is a pre-token of its own or the beginning of the next one, across which nothing joins.

It isn't certain inside a character, after a longer run of spaces (the last one of which goes to the next pre-token), and
where the right part could be read as a contraction or the left one as part of it; there a fragment goes on.

Encodings of fragments are cached in a bounded dictionary per task. A fragment that isn't cached is pre-tokenized and merged,
by a compiled library where the vocabulary's ids follow the order of its merges, else by a heap over a linked list.

Defined results: a null text is an empty one and has no ids; invalid UTF-8 can't occur in a string column; an added
special token in the text is one id, as with the library's own default; repeated rows encode alike.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellcut.llm.common import ADDED, add_columns, prepare, texts

#: Encodings of fragments that a task keeps.
CACHE = 150_000
#: Bytes of a fragment that is worth keeping.
LONGEST = 64
#: The pre-tokenizer's pattern, a fixed value of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_BYTES = (0x20, *range(0x09, 0x0E))
ALNUM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Separators that are white space to some and control characters to others.
UNSURE = range(0x1C, 0x20)
#: White space beyond ASCII: C2 and one of the first, E2 80 and one of the second, E2 81 9F, E1 9A 80, E3 80 80.
LATIN_ENDS, GENERAL_ENDS = (0x85, 0xA0), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)
SPACE_ENDS = (*LATIN_ENDS, *GENERAL_ENDS, 0x9F)
#: What the table says of a pair: no cut, a certain cut, a cut after a single ASCII space, a cut after a character that isn't a space.
NO, CUT, AFTER_ONE, AFTER_OTHER = range(4)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _table(some: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(some)] = True
    return out


PLAIN_SPACE, LATIN_SPACE, GENERAL_SPACE = _table([*SPACE_BYTES, *UNSURE]), _table(LATIN_ENDS), _table(GENERAL_ENDS)


class Codec:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        model = spec["model"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        vocab = {to_bytes(k): v for k, v in model["vocab"].items() if k not in self.special}
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for k, v in [*vocab.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.tokens[v] = k
        self.vocab = vocab
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for i, m in enumerate(model["merges"]):
            a, b = map(to_bytes, m.split(" ") if isinstance(m, str) else m)
            self.rank[vocab[a], vocab[b]] = (i, vocab[a + b])
        inside = np.zeros((256, 256), bool)
        for t in vocab:
            if len(t) > 1:
                x = np.frombuffer(t, np.uint8)
                inside[x[:-1], x[1:]] = True
        self.inside = inside
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.kind = self._kinds()
        self.pattern = regex.compile(PATTERN)
        # where ids follow the order of the merges, compiled code can do the merges
        ordered = all(new == i + 256 for i, (_, new) in enumerate(self.rank.values())) and sorted(self.single) == list(range(256))
        self.fast = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={}) if ordered else None
        self.specials = regex.compile("|".join(regex.escape(k) for k in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.special_bytes = [k.encode() for k in self.special]
        self.cache: dict[bytes, bytes] = {}

    def _kinds(self) -> np.ndarray:
        """What each pair of bytes says of a cut between them, by 256 * left + right."""
        kind = np.full((256, 256), NO, np.uint8)
        for x in range(256):
            if x in UNSURE:
                continue
            left = AFTER_ONE if x in SPACE_BYTES else AFTER_OTHER if x in SPACE_ENDS else CUT
            for y in range(256):
                if y in SPACE_BYTES:
                    kind[x, y] = CUT
                elif not 0x80 <= y < 0xC0 and not (y == 0x27 and x not in ALNUM) and not (x == 0x27 and y in ALNUM):
                    kind[x, y] = left
        for y in SPACE_BYTES:
            kind[UNSURE, y] = CUT
        for pair in ("re", "ve", "ll"):
            kind[ord(pair[0]), ord(pair[1])] = NO
        kind[self.inside] = NO
        return kind.reshape(-1)

    def cuts(self, text: bytes) -> np.ndarray:
        """The places of a text's certain cuts, ascending."""
        x = np.frombuffer(text, np.uint8)
        kind = self.kind[(x[:-1].astype(np.uint16) << 8) | x[1:]]
        at = np.flatnonzero(kind) + 1
        check = kind[at - 1]
        if (check > CUT).any():
            one, other = check == AFTER_ONE, check == AFTER_OTHER
            fine = np.ones(len(at), bool)
            fine[one] = ~self._spaces(x, at[one] - 2)
            fine[other] = ~self._spaces(x, at[other] - 1)
            at = at[fine]
        return at

    @staticmethod
    def _spaces(x: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the characters with these last bytes may be white space; one before the text isn't."""
        back = lambda k: np.where(end >= k, x[np.maximum(end - k, 0)], 0)
        c, b, a = back(0), back(1), back(2)
        general = (b == 0x80) & GENERAL_SPACE[c] | (b == 0x81) & (c == 0x9F)
        return PLAIN_SPACE[c] | (b == 0xC2) & LATIN_SPACE[c] | (a == 0xE2) & general | (c == 0x80) & ((a == 0xE1) & (b == 0x9A) | (a == 0xE3) & (b == 0x80))

    def fragments(self, text: bytes) -> list[bytes]:
        """The text cut at its certain boundaries; concatenated they give the text."""
        at = self.cuts(text).tolist()
        return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]

    def _merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: merges in order of rank, the leftmost first, by a heap over a linked list."""
        ids: list[int] = [self.single[b] for b in piece]
        if len(ids) == 1:
            return ids
        n, rank = len(ids), self.rank
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank[a, b][1], -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if r := rank.get((ids[i], ids[nxt[i]])):
                    heapq.heappush(heap, (r[0], i, ids[i], ids[nxt[i]]))
            if prv[i] >= 0 and (r := rank.get((ids[prv[i]], ids[i]))):
                heapq.heappush(heap, (r[0], prv[i], ids[prv[i]], ids[i]))
        return [x for x in ids if x >= 0]

    def _fragment(self, fragment: bytes) -> bytes:
        """Little-endian ids of one fragment: pre-tokens, then merges."""
        if self.fast is not None:
            return array("I", self.fast.encode_ordinary(fragment.decode("utf-8"))).tobytes()
        out: list[int] = []
        for token in self.pattern.findall(fragment.decode("utf-8")):
            out += self._merge(token.encode("utf-8"))
        return np.array(out, "<u4").tobytes()

    def _around(self, text: bytes | None, special: bool, plain: Callable[[bytes], bytes]) -> bytes:
        """The ids of special strings, and what ``plain`` makes of the text around them."""
        if not text:
            return b""
        if special and self.specials is not None and any(s in text for s in self.special_bytes):
            out, at, whole = [], 0, text.decode("utf-8")
            for m in self.specials.finditer(whole):
                out += [plain(whole[at : m.start()].encode()), np.array([self.special[m[0]]], "<u4").tobytes()]
                at = m.end()
            return b"".join([*out, plain(whole[at:].encode())])
        return plain(text)

    def encode(self, text: bytes | None, special: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; with special=False the strings of special tokens are plain text."""
        return self._around(text, special, self._split)

    def ids(self, text: bytes | None, special: bool = True) -> bytes:
        """The same ids without splitting, where compiled code does the merges: for operators that only need ids."""
        return self._around(text, special, self._split if self.fast is None else self._fragment)

    def _split(self, text: bytes) -> bytes:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        out = []
        for f in self.fragments(text):
            ids = cache.get(f)
            if ids is None:
                ids = self._fragment(f)
                if len(f) <= LONGEST:
                    cache[f] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of little-endian ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """docs with wc__ids, the ids of each whole text as little-endian unsigned 32-bit integers. One narrow pass.

    ``path`` names a vocabulary file that is installed on every executor.
    """
    prepare(docs.sparkSession)
    return add_columns(docs, [("ids", T.BinaryType())], lambda b: [pa.array(map(codec(path).encode, texts(b)), pa.binary())], keep)


def decode(rows: DataFrame, path: str, column: str = f"{ADDED}ids") -> DataFrame:
    """The rows with wc__text, the text of a column of ids."""
    schema = T.StructType([*rows.schema.fields, T.StructField(f"{ADDED}text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array((None if x is None else codec(path).decode(x) for x in b.column(column).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, f"{ADDED}text"])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document: encoded, then decoded from the ids alone."""
    prepare(docs.sparkSession)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        c = codec(path)
        ids = [c.encode(x) for x in texts(b)]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array((sha(c.decode(x).encode("utf-8")) for x in ids), pa.string())]

    made = add_columns(docs, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], run, ["doc_id", "text"])
    return made.select("doc_id", *[F.col(ADDED + c).alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")])
