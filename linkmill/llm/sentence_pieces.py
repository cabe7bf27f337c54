"""SentencePiece encoding and decoding for merge-type vocabularies."""

from __future__ import annotations

import codecs
import hashlib
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Replay, blocks, worker

#: The letter that stands for a blank in pieces.
BLANK = "▁"
#: Most words that a worker remembers, and the longest of them in characters.
REMEMBER, LONG = 600_000, 48
#: Letters of a word whose agenda is a plain row; bits of a symbol; rank of pairs that make no piece; most pairs that a worker remembers.
SHORT, WIDE, NEVER, PAIRS = 64, 21, 1 << 40, 800_000
#: What a control id decodes to until the text is whole: bytes on both sides of it are no letter together.
CONTROL = "\ud800"

codecs.register_error("linkmill-each-byte", lambda e: ("�", e.start + 1))


class Vocabulary:
    """A merge-type vocabulary: its pieces, which of them two symbols make, and how symbols become ids."""

    def __init__(self, path: str):
        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.names = [m.id_to_piece(i) for i in range(n)]
        self.normal = {self.names[i]: i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        self.bytes = {int(self.names[i][1:-1], 16): i for i in range(n) if m.is_byte(i)}
        self.end, self.size = m.eos_id(), n
        self.score = {i: m.get_score(i) for i in self.normal.values()}
        self.prove()
        order = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {i: order[s] for i, s in self.score.items()}

    def prove(self) -> None:
        """What the encoder rests on: no piece goes on past a blank, none is unused, every byte has a piece, texts are taken as they are."""
        m, probe = self.library, " a  b\t　ﬁé "
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.normal) or any(m.is_unused(i) for i in range(self.size)):
            raise ValueError("a piece goes on past a blank, or is not used")
        if len(self.bytes) != 256 or m.normalize(probe) != BLANK + probe.replace(" ", BLANK):
            raise ValueError("the vocabulary has no byte pieces, or changes texts before it encodes them")

    def name(self, symbol: int) -> str:
        return self.names[symbol] if symbol < self.size else chr(symbol - self.size)

    def pair(self, a: int, b: int):
        """Rank by score and id of the piece that two neighbouring symbols make, if there is one."""
        got = self.normal.get(self.name(a) + self.name(b))
        return None if got is None else (self.rank[got], got)

    def ids(self, symbols: list[int]) -> list[int]:
        """A letter without a piece becomes the pieces of its bytes."""
        if max(symbols, default=0) < self.size:
            return symbols
        return [i for s in symbols for i in ((s,) if s < self.size else [self.bytes[b] for b in chr(s - self.size).encode()])]


class Pairs(dict):
    """The rank of each pair of symbols (left << WIDE | right), worked out once; `made` has what a pair makes."""

    def __init__(self, pair):
        self.pair, self.made = pair, {}

    def __missing__(self, key: int) -> int:
        got = self.pair(key >> WIDE, key & ((1 << WIDE) - 1))
        rank = self[key] = NEVER if got is None else got[0]
        if got is not None:
            self.made[key] = got[1]
        return rank


class Agenda:
    """Joins adjacent symbols by score: the best pair first, the leftmost among equals, and only the joined symbol's two neighbours are looked at anew.

    A word's agenda is the row of its pairs' ranks, of which the best is taken; that of a word of over SHORT letters is a heap.
    """

    def __init__(self, pair, letters):
        self.pairs, self.letters, self.heap = Pairs(pair), letters, Replay(pair, letters)

    def run(self, words: list[str]) -> list[list[int]]:
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
            self.pairs.made.clear()
        pairs, made, letter = self.pairs, self.pairs.made, self.letters.__getitem__
        out = []
        for w in words:
            if len(w) > SHORT:
                out += self.heap.run([w])
                continue
            ids = list(map(letter, w))
            agenda = [pairs[a << WIDE | b] for a, b in zip(ids, ids[1:])]
            while agenda and (best := min(agenda)) != NEVER:
                i = agenda.index(best)
                t = ids[i] = made[ids[i] << WIDE | ids.pop(i + 1)]
                del agenda[i]
                if i:
                    agenda[i - 1] = pairs[ids[i - 1] << WIDE | t]
                if i < len(agenda):
                    agenda[i] = pairs[t << WIDE | ids[i + 1]]
            out.append(ids)
        return out


class Letters(dict):
    """The symbol of each letter: its piece, or a number beyond all pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, letter: str) -> int:
        v = self.vocabulary
        got = self[letter] = v.normal.get(BLANK if letter == " " else letter, v.size + ord(letter))
        return got


def words(text: str, runs=re.compile(r" +[^ ]+| +$").findall) -> list[str]:
    """The parts of a text that no piece crosses: each goes from a run of blanks to the next. The first blank of each, or the one put before the text, is left out."""
    if not text:
        return []
    text = text.replace(BLANK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in runs(" " + text)]


class Encoder:
    """Encodes texts word by word; remembers the ids of at most `remember` words, as decimal numbers.

    Every new word goes through the agenda, and its ids are compared with those of the library, a block
    of new words at a time.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        self.vocabulary = v = Vocabulary(path)
        self.agenda, self.remember = Agenda(v.pair, Letters(v)), remember
        self.done: dict[str, str] = {}
        self.decimal = {str(i): self.as_text(i) for i in range(v.size)}

    def as_text(self, i: int) -> str:
        """What an id decodes to; bytes from 128 on stand as escapes."""
        v = self.vocabulary
        if v.library.is_byte(i):
            b = int(v.names[i][1:-1], 16)
            return chr(b) if b < 128 else chr(0xDC00 + b)
        return CONTROL if v.library.is_control(i) else " ⁇ " if v.library.is_unknown(i) else v.names[i].replace(BLANK, " ")

    def learn(self, new: list[str]) -> None:
        found = [self.vocabulary.ids(s) for s in self.agenda.run([" " + w for w in new])]
        for w, ids, known in zip(new, found, self.vocabulary.library.encode(new, num_threads=1)):
            if w and ids != known:
                raise ValueError(f"{w!r} has other ids than the library gives")
            self.done[w] = " ".join(map(str, ids)) + " "

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text with the end id, as decimal numbers between single blanks."""
        out, end = [], str(self.vocabulary.end)
        for block in blocks(texts):
            parts = [words(t) for t in block]
            new = {w for p in parts for w in p if w not in self.done}
            if new and len(self.done) + len(new) > self.remember:
                self.done.clear()
                new = {w for p in parts for w in p}
            self.learn(list(new))
            get = self.done.__getitem__
            out += ["".join(map(get, p)) + end for p in parts]
            for w in new:
                if len(w) > LONG:
                    del self.done[w]
        return out

    def decode(self, ids: str) -> bytes:
        """The text of decimal ids, in UTF-8; bytes that are no UTF-8 become U+FFFD, each by itself."""
        text = "".join(map(self.decimal.__getitem__, ids.split(" ") if ids else ())).strip(CONTROL)
        text = text[text.startswith(" ") :]
        try:
            return text.encode()
        except UnicodeEncodeError:
            run = lambda m: m[0].encode("utf-8", "surrogateescape").decode("utf-8", "linkmill-each-byte")
            return re.sub("[\udc80-\udcff]+", run, text).replace(CONTROL, "").encode()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array), n_tokens, decoded of every row; see encoding_digests."""
    def run(batches):
        with worker(Encoder, model) as enc:
            for b in batches:
                ids = enc.encode(b.column(1).to_pylist())
                lists = [list(map(int, x.split(" "))) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32())), pa.array(list(map(len, lists)), pa.int64()), pa.array([enc.decode(x).decode() for x in ids])], ["doc_id", "ids", "n_tokens", "decoded"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded string")


def encoding_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row. No shuffle.

    A text is encoded as the library does, with the end id and no begin id. Pieces never go on
    past a blank (proved when the vocabulary is loaded), so words are encoded by themselves and
    each word's ids are checked against the library; the decoded text comes from the ids alone.

    Null or empty text has the end id only and decodes to nothing. Very long texts, also without any
    blank, are encoded whole. Letters without a piece become bytes. A text's own U+2581 is a blank, as for the
    library. Repeated rows are encoded alike; a null doc_id stays null. Empty table: empty
    result. Other columns are not read.
    """
    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        with worker(Encoder, model) as enc:
            for b in batches:
                ids = enc.encode(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.count(" ") + 1 for x in ids], pa.int64()), pa.array([sha(x.encode()) for x in ids]), pa.array([sha(enc.decode(x)) for x in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
