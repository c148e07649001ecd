"""Byte-level BPE as a bounded-lookahead streaming transducer.

Encoding reads the bytes of a piece left to right and keeps, for each position inside a short window, the
last token of the encoding of the prefix that ends there. That table is exact: the tokens before the last
token of a prefix's encoding are themselves the encoding of the shorter prefix, and a token may follow
another exactly when merging their joined bytes gives back the two. A path of last tokens is stable, and its
tokens are emitted, once all positions within the lookahead lead back through it. The lookahead comes from
the merge list (the longest token, since no later path can begin further back than that), so memory does
not grow with the text. Every piece goes through this transducer; what it gives for short pieces is cached.

Texts are read in windows that end where the splitting pattern must split, ids and decoded text leave window by
window into digests, and decoding maps each id to its bytes and feeds an incremental UTF-8 state machine. Beyond
the text itself only a window is in memory (and the ids of one text where the caller wants them returned).
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import bounded, per_worker

#: The splitting pattern of the byte-level pre-tokeniser (a fixed value of the vocabulary file's format), with classes to fill in.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{W}{L}{N}]+|[{W}]+(?![^{W}])|[{W}]+"
#: White space of the pattern (Unicode's White_Space, fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers that Unicode 16 added to the tables of this Python (15.1): fixed values.
MORE_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
MORE_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Entries of a worker's piece cache (about 150 bytes each) and of its pair cache.
CACHE = 300_000
BITS = 24
MASK = (1 << BITS) - 1
#: What the transducer gives for longer pieces isn't cached.
CACHED = 64
#: Characters of a window before it looks for a seam, and of a chunk fed to the transducer.
WINDOW = 1 << 14
#: In texts of these characters alone the plain ``re`` classes agree with the pattern's Unicode classes.
PLAIN = r"[^\t-\r -~\xC0-\xD6\xD8-\xF6\xF8-\u024F]"
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def _class(kind: str) -> str:
    """A regular expression class body of all code points of a major category, by this Python's tables and the additions."""
    spans = [list(x) for x in (MORE_LETTERS if kind == "L" else MORE_NUMBERS)]
    start = None
    for cp in range(0x110001):
        hit = cp < 0x110000 and unicodedata.category(chr(cp))[0] == kind
        if hit and start is None:
            start = cp
        elif not hit and start is not None:
            spans.append([start, cp - 1])
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in sorted(spans))


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: dict) -> None:
        model, alphabet = spec["model"], byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        for s in self.special:
            self.ids.pop(s.encode(), None)
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.size_of = {i: len(t) for i, t in self.bytes_of.items()}
        self.merges: dict[tuple[int, int], int] = {}  # rank and merged id in one number
        self.none = 1 << 62
        self.byte_ids = [self.ids.get(bytes([b]), -1) for b in range(256)]
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            if a in self.ids and b in self.ids and a + b in self.ids:
                key = (self.ids[a], self.ids[b])
                self.merges.setdefault(key, rank << BITS | self.ids[a + b])
                self.parts.setdefault(self.ids[a + b], (rank, *key))
        self.lookahead = max(map(len, self.ids), default=1)
        self.plain, self.odd = re.compile(PLAIN_PATTERN), re.compile(PLAIN)
        self.seam = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _merge(self, piece: bytes) -> list[int]:
        """The merge list applied to a short piece, lowest rank first, leftmost among equals."""
        get, none = self.merges.get, self.none
        t = [self.byte_ids[b] for b in piece]
        ranks = [get(p, none) for p in zip(t, t[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            t[k : k + 2] = [best & MASK]
            del ranks[k]
            if k:
                ranks[k - 1] = get((t[k - 1], t[k]), none)
            if k < len(ranks):
                ranks[k] = get((t[k], t[k + 1]), none)
        return t

    @cached_property
    def pattern(self) -> re.Pattern:
        return re.compile(PATTERN.format(L=_class("L"), N=_class("N"), W=WHITE))

    @cached_property
    def makes(self) -> dict[bytes, int]:
        """Tokens that the merges can make at all, by their own bytes."""
        return {t: i for t, i in self.ids.items() if len(t) == 1 or self._merge(t) == [i]}

    @cached_property
    def sizes(self) -> dict[bytes, tuple[int, ...]]:
        """By the last two bytes: the lengths of the tokens that end in them, longest first, and 1."""
        found: dict[bytes, set] = {}
        for t in self.makes:
            found.setdefault(t[-2:], set()).add(len(t))
        return {k: (*sorted(x - {1}, reverse=True), 1) for k, x in found.items()}

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges keep ``a`` and ``b`` apart when they stand side by side."""
        key = a << BITS | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Undo the merges of both tokens from the latest back: some merge across the seam comes first, or none does.

        ``a`` shrinks to its right part and ``b`` to its left part, whichever was merged later. A seam
        merge counts if it precedes the merge just undone; of equal ranks the left one is applied first.
        """
        none, limit = (-1, -1, -1), (1 << 60, 0)
        while True:
            seam = self.merges.get((a, b))
            if seam is not None and (seam >> BITS, 1) < limit:
                return False
            left, right = self.parts.get(a, none), self.parts.get(b, none)
            if left[0] < 0 and right[0] < 0:
                return True
            if left[0] > right[0]:
                limit, a = (left[0], 0), left[2]
            else:
                limit, b = (right[0], 2), right[1]

    def _last(self, held: bytes, last: list, n: int) -> int:
        """Last token of the prefix ``held[:n]``, -2 if it has none; ``last`` keeps what is known, of shorter prefixes too."""
        get, apart = self.makes.get, self.pairs.get
        for size in self.sizes.get(held[max(n - 2, 0) : n], (1,)):
            at = n - size
            if at < 0 or (t := get(held[at:n])) is None:
                continue
            before = last[at]
            if before is None:
                before = self._last(held, last, at)
            if before == -1 or before >= 0 and ((ok := apart(before << BITS | t)) or ok is None and self.follows(before, t)):
                last[n] = t
                return t
        last[n] = -2
        return -2

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Token ids of the bytes in ``chunks``, each emitted as soon as no later byte can change it.

        ``last[k]`` is looked up when a path needs it: at the end, or when the window is full and a cut is due."""
        reach = self.lookahead
        held = b""  # bytes after the last emitted token
        last: list = [-1]  # of the prefix held[:k]; at 0 the token emitted last, -1 at the start
        for chunk in chunks:
            for lo in range(0, len(chunk), reach):
                held += chunk[lo : lo + reach]
                last += [None] * (len(held) + 1 - len(last))
                if len(held) >= 4 * reach:
                    self._fill(held, last)
                    if cut := self._stable(last, len(held), reach):
                        out = self._path(last, cut)
                        yield from out
                        held, last = held[cut:], [out[-1], *last[cut + 1 :]]
        if len(held) > reach:
            self._fill(held, last)
        elif held:
            self._last(held, last, len(held))
        yield from self._path(last, len(held))

    def _fill(self, held: bytes, last: list) -> None:
        for n in range(1, len(last)):
            if last[n] is None:
                self._last(held, last, n)

    def _path(self, last: list, at: int) -> list[int]:
        out, size = [], self.size_of
        while at > 0:
            t = last[at]
            out.append(t)
            at -= size[t]
        out.reverse()
        return out

    def _stable(self, last: list, n: int, reach: int) -> int:
        """The furthest cut that the paths of all prefixes share which a later token may follow: their meeting point."""
        ends = [-e for e in range(n - reach, n + 1) if last[e] >= 0]
        heapify(ends)
        while (at := -ends[0]) > 0 and len(ends) > 1:
            heappop(ends)
            if at != -ends[0]:
                heappush(ends, self.size_of[last[at]] - at)
        return max(at, 0)

    def piece(self, text: str) -> tuple[int, ...]:
        """Token ids of one piece; of those seen lately from a cache of two generations."""
        known = self.young.get(text)
        if known is None:
            known = self.old.get(text) or self._encoded(text.encode())
            if len(text) <= CACHED:
                if len(self.young) >= CACHE // 2:
                    self.old, self.young = self.young, {}
                self.young[text] = known
        return known

    def _encoded(self, piece: bytes) -> tuple[int, ...]:
        n = len(piece)
        if not 0 < n <= self.lookahead:
            return tuple(self.stream((piece,)))
        last: list = [-1, *[None] * n]  # no cut can be due: the table is read off at the end
        self._last(piece, last, n)
        return tuple(self._path(last, n))

    def windows(self, text: str) -> Iterator[list[int]]:
        """Token ids of ``text``, a window at a time."""
        for part in self.splitter.split(text) if self.splitter and any(s in text for s in self.special) else (text,):
            if part in self.special:
                yield [self.special[part]]
                continue
            at = 0
            while at < len(part):
                seam = self.seam.search(part, at + WINDOW)
                end = seam.start() if seam else len(part)
                pattern = self.pattern if self.odd.search(part, at, end) else self.plain
                if end - at <= 4 * WINDOW:
                    yield list(chain.from_iterable(map(self.piece, pattern.findall(part[at:end]))))
                else:
                    yield from self._long(part, at, end, pattern)
                at = end

    def _long(self, part: str, at: int, end: int, pattern: re.Pattern) -> Iterator[list[int]]:
        """The same for a window without a seam: pieces one by one, long ones in chunks."""
        held: list[int] = []
        for m in pattern.finditer(part, at, end):
            a, b = m.span()
            for i in self.stream(part[k : min(k + WINDOW, b)].encode() for k in range(a, b, WINDOW)):
                held.append(i)
                if len(held) >= WINDOW:
                    yield held
                    held = []
        yield held

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.windows(text)))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text in parts, each as soon as its bytes are whole characters; broken bytes become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield machine.decode(self.bytes_of[i])
        yield machine.decode(b"", final=True)


def load(path: str) -> Transducer:
    with open(path, encoding="utf-8") as f:
        return Transducer(json.load(f))


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_tokens, ids?, ids_sha256, decoded_sha256, round_trip``.

    Null text counts as empty: no token, digests of the empty string. Repeated rows and null ids keep
    their rows; extra columns are ignored. The vocabulary (bounded by its file) is read once by the driver
    and broadcast, so executors need no copy of the file.
    """
    bounded(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    slim = json.dumps({"model": {k: spec["model"][k] for k in ("vocab", "merges")}, "added_tokens": spec.get("added_tokens")})
    sent = docs.sparkSession.sparkContext.broadcast(slim)
    key = hashlib.sha256(slim.encode()).hexdigest()

    def kernel(batches):
        import pyarrow as pa

        coder = per_worker(("bpe", key), lambda: Transducer(json.loads(sent.value)))
        names = [str(i) for i in range(max(coder.bytes_of, default=-1) + 1)]
        of = coder.bytes_of
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_tokens", "ids", "ids_sha256", "decoded_sha256", "round_trip")}
            for value in batch.column("text"):
                text = value.as_py() or ""
                machine = codecs.getincrementaldecoder("utf-8")("replace")
                digest, decoded, count, kept = hashlib.sha256(), hashlib.sha256(), 0, array("i")
                for ids in coder.windows(text):
                    if ids:
                        digest.update((("," if count else "") + ",".join([names[i] for i in ids])).encode())
                        decoded.update(machine.decode(b"".join([of[i] for i in ids])).encode())
                        count += len(ids)
                        if with_ids:
                            kept.extend(ids)
                decoded.update(machine.decode(b"", final=True).encode())
                rows["n_tokens"].append(count)
                rows["ids_sha256"].append(digest.hexdigest())
                rows["decoded_sha256"].append(decoded.hexdigest())
                rows["round_trip"].append(decoded.digest() == hashlib.sha256(text.encode()).digest())
                if with_ids:
                    rows["ids"].append(np.frombuffer(kept, dtype=np.int32) if kept else np.zeros(0, np.int32))
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(rows["n_tokens"], pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(rows["ids"], pa.list_(pa.int32()))
            columns |= {k: pa.array(rows[k], pa.string()) for k in ("ids_sha256", "decoded_sha256")}
            columns["round_trip"] = pa.array(rows["round_trip"], pa.bool_())
            yield pa.RecordBatch.from_pydict(columns)
        # the worker process lives on and serves other stages: it keeps the vocabulary, not the caches
        coder.young, coder.old = {}, {}
        coder.pairs.clear()
        pa.default_memory_pool().release_unused()

    fields = [f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", "n_tokens long", *["ids array<int>"] * with_ids]
    return docs.select("doc_id", "text").mapInArrow(kernel, ", ".join([*fields, "ids_sha256 string, decoded_sha256 string, round_trip boolean"]))
