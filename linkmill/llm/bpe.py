"""Byte-level BPE by corpus merge replay, and token counts with the whole-token shortcut."""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import json
import re
from array import array
from collections import defaultdict
from contextlib import contextmanager

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident

#: White space of Unicode's property, as the pattern's \s means it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Most chunks that a worker remembers; beyond it the memory is emptied, never the result. Chunks of over LONG characters are not remembered.
REMEMBER, LONG = 900_000, 48
#: Most pairs of tokens whose merge a worker remembers.
PAIRS = 800_000
#: Most texts, and characters of several texts, that are worked on at a time.
TEXTS, CHARACTERS = 512, 1 << 22


def blocks(texts: list[str]):
    """Runs of neighbouring texts; a text of over CHARACTERS is a block by itself."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= TEXTS or size + len(t) > CHARACTERS):
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:]


class Known(dict):
    """What each pair of tokens merges to, worked out once."""

    def __init__(self, pair):
        self.pair = pair

    def __missing__(self, key):
        got = self[key] = self.pair(*key)
        return got


class Replay:
    """Applies merges in rank order to many words at once.

    pair(left, right) gives (rank, token) or None. An inverted index holds, for each rank, the
    places of its pairs over all words; a heap gives the lowest rank. A merge touches only the
    two neighbouring pairs. Where a merge makes a pair of lower rank, the word's later places
    go back to the index, so every word sees its own merges lowest first and leftmost first.
    """

    def __init__(self, pair, single):
        self.single, self.known = single, Known(pair)

    def run(self, words: list[bytes]) -> list[list[int]]:
        if len(self.known) > PAIRS:
            self.known.clear()
        known, single = self.known, self.single
        token: list[int] = []
        word, starts, index = [], [], defaultdict(list)
        for w, text in enumerate(words):
            start = len(token)
            starts.append(start)
            ids = [single[b] for b in text]
            token += ids
            word += [w] * len(ids)
            for i, key in enumerate(zip(ids, ids[1:]), start):
                if got := known[key]:
                    index[got[0]].append(i)
        nxt, prv = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        for start in starts:
            if start < len(token):
                prv[start] = -1
            if start:
                nxt[start - 1] = -1
        if token:
            nxt[-1] = -1
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, ())
            if len(places) > 1:
                places.sort()
            held = -1  # the word whose later places wait for a lower rank
            for i in places:
                j = nxt[i]
                a = token[i]
                if a < 0 or j < 0 or not (got := known[a, token[j]]) or got[0] != rank:
                    continue
                if word[i] == held:
                    if rank not in index:
                        heapq.heappush(heap, rank)
                    index[rank].append(i)
                    continue
                t = token[i] = got[1]
                token[j] = -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prv[k] = i
                    if new := known[t, token[k]]:
                        if new[0] not in index:
                            heapq.heappush(heap, new[0])
                        index[new[0]].append(i)
                        if new[0] < rank:
                            held = word[i]
                h = prv[i]
                if h >= 0 and (new := known[token[h], t]):
                    if new[0] not in index:
                        heapq.heappush(heap, new[0])
                    index[new[0]].append(h)
                    if new[0] < rank:
                        held = word[i]
        starts.append(len(token))
        return [[t for t in token[a:b] if t >= 0] for a, b in zip(starts, starts[1:])]


def rank_rules(path: str):
    """pair, single and token bytes of a tiktoken rank file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = max(ranks.values()) + 1
    names = [b""] * size
    for k, v in ranks.items():
        names[v] = k

    def pair(a, b):
        r = ranks.get(names[a] + names[b])
        return None if r is None else (r, r)

    return pair, [ranks[bytes([b])] for b in range(256)], names


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def json_rules(path: str):
    """pair, single, token bytes and added special strings of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    letters, vocab = byte_letters(), d["model"]["vocab"]
    special = [x["content"] for x in d["added_tokens"]]
    names = {v: bytes(letters[c] for c in k) for k, v in vocab.items() if k not in special}
    rules = {(vocab[a] << 20) | vocab[b]: (r, vocab[a + b]) for r, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in d["model"]["merges"])}
    back = {b: c for c, b in letters.items()}
    return (lambda a, b: rules.get((a << 20) | b)), [vocab[back[b]] for b in range(256)], names, special


def chunks(text: str, clean=re.compile(f" [{SPACE}]|[{SPACE}] ").search, cut=re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])").split) -> list[str]:
    """Parts of a text that the pattern never crosses: cuts before a single space between two other characters."""
    parts = text.split(" ") if not clean(text) and text[:1] != " " and text[-1:] != " " else cut(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


class Encoder:
    """Encodes texts by a rank file; remembers what each of at most `remember` chunks gives."""

    def __init__(self, path: str, pattern: str, remember: int = REMEMBER):
        self.remember = remember
        pair, single, self.names = rank_rules(path)
        self.replay, self.find = Replay(pair, single), regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.done: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        if len(self.done) > self.remember:
            self.done.clear()
            self.pieces.clear()
        split = [self.find(c) for c in new]
        pieces = list({p for s in split for p in s if p not in self.pieces})
        for p, ids in zip(pieces, self.replay.run([p.encode() for p in pieces])):
            self.pieces[p] = array("I", ids).tobytes()
        for c, s in zip(new, split):
            self.done[c] = b"".join([self.pieces[p] for p in s])

    def forget(self, new: set[str]) -> None:
        """Drops what was learnt of long chunks: a run without blanks may be a whole text."""
        if long := [c for c in new if len(c) > LONG]:
            for c in long:
                del self.done[c]
            for p in [p for p in self.pieces if len(p) > LONG]:
                del self.pieces[p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for block in blocks(texts):
            parts = [chunks(t) for t in block]
            new = {c for p in parts for c in p if c not in self.done}
            if len(self.done) + len(new) > self.remember and new:
                new = {c for p in parts for c in p}
                self.done.clear()
                self.pieces.clear()
            self.learn(list(new))
            get = self.done.__getitem__
            out += [b"".join(map(get, p)) for p in parts]
            self.forget(new)
        return out

    def decode(self, ids: bytes) -> bytes:
        names = self.names
        return b"".join([names[i] for i in memoryview(ids).cast("I")])


@contextmanager
def worker(kind, *args):
    """One encoder for each Python worker; within a task no cycle collection runs.

    The lists made here hold no cycles, and walking them costs a sixth of the time. The
    collection is on again after the task: other stages may use the worker next.
    """
    gc.disable()
    try:
        yield resident((kind.__name__, *args), lambda: kind(*args))
    finally:
        gc.enable()


def encode_documents(docs: DataFrame, vocab: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded (binary).

    Every match of the pattern is merged by itself, so the result does not depend on how the
    corpus is dealt out: each task replays the merges over its own distinct pieces, without a
    shuffle. Null text is empty: no ids. Repeated rows are encoded alike; other columns are not read.
    """
    def run(batches):
        with worker(Encoder, vocab, pattern) as enc:
            for b in batches:
                ids = enc.encode(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([enc.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded binary")


def encoding_digests(docs: DataFrame, vocab: str, pattern: str, remember: int = REMEMBER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of encode_documents, taken in the same task.

    Null or empty text: no ids, the digests of nothing. Very long texts are encoded whole. Repeated rows are
    encoded alike; a null doc_id stays null. Empty table: empty result. Other columns are not read.
    """
    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        with worker(Encoder, vocab, pattern, remember) as enc:
            for b in batches:
                ids = enc.encode(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(sha, ids))), pa.array([sha(enc.decode(x)) for x in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def not_whole(vocab: str) -> tuple[bytes, ...]:
    """The proof: the vocabulary strings whose own merges do not end in one token. Every other one encodes alone as itself."""
    pair, single, names, _ = json_rules(vocab)
    words = list(names.values())
    return tuple(w for w, ids in zip(words, Replay(pair, single).run(words)) if len(ids) != 1)


class Counter(Encoder):
    """Counts tokens by a tokenizers file with the whole-token shortcut."""

    def __init__(self, path: str, pattern: str, split: tuple[bytes, ...]):
        pair, single, names, special = json_rules(path)
        self.replay, self.find = Replay(pair, single), regex.compile(pattern).findall
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.whole = set(names.values()) - set(split)
        self.done: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for block in blocks(texts):
            marks, parts = [], []
            for t in block:
                pieces = self.special.split(t) if self.special else [t]
                marks.append(len(pieces) - 1)
                parts.append([c for p in pieces if p for c in chunks(p)])
            new = {c for p in parts for c in p if c not in self.done}
            if len(self.done) + len(new) > REMEMBER:
                new = {c for p in parts for c in p}
                self.done.clear()
                self.pieces.clear()
            split = {c: self.find(c) for c in new}
            rest = list({p for s in split.values() for p in s if p not in self.pieces and p.encode() not in self.whole})
            for p, ids in zip(rest, self.replay.run([p.encode() for p in rest])):
                self.pieces[p] = len(ids)
            for c, s in split.items():
                self.done[c] = sum([self.pieces.get(p, 1) for p in s])
            get = self.done.__getitem__
            out += [m + sum(map(get, p)) for m, p in zip(marks, parts)]
            self.forget(new)
        return out


def count_tokens(docs: DataFrame, vocab: str, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. No shuffle.

    A piece that is proved to encode alone as one token counts one; only the rest is merged.
    Special strings inside a text count as one token each, as the library's default has it.
    Null or empty text has no token; very long texts are counted whole and long runs without blanks
    are not remembered. Repeated rows are counted alike; a null doc_id stays null. Empty table: empty
    result. Other columns, of whatever name, are not read.
    """
    split = not_whole(vocab)  # proved once, on the driver; few strings, shipped with the tasks

    def run(batches):
        with worker(Counter, vocab, pattern, split) as counter:
            for b in batches:
                n = counter.count(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
