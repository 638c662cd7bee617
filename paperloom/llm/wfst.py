"""Encoding and decoding with a SentencePiece BPE vocabulary as a weighted finite-state transducer.

Three transducers are compiled from the vocabulary file:

* the normaliser has a start state, whose arc puts the meta symbol in front, and a state whose arcs
  map a space to the meta symbol and any other character to itself (the file's normaliser is the
  identity otherwise);
* the piece transducer reads a piece along the arcs of a trie and then takes the arc to the state of
  that piece, writing its id. The arc from the state of piece s to that of piece t weighs 0 if the
  vocabulary's merges leave s and t side by side when they meet, and 1 if a merge across their border
  would have come first, so a path's weight is the number of borders that the merges contradict;
* the byte transducer reads a character outside the vocabulary and writes its UTF-8 byte pieces; its
  arcs weigh 0.

The composition with an input has the states (position, last piece). Its shortest path in the
tropical semiring is the encoding: weights are added along a path and the least sum wins. Summing piece
scores instead would be a unigram model's criterion, not that of this merge (BPE) vocabulary, whose
segmentation is the one path of weight 0. The search settles states in the order of their distance,
and among equal ones those of longer pieces first, with two queues, as all weights are 0 or 1; arcs of
the composition and their weights are made when the search meets them.

No piece has a meta symbol after another character, or letters beside other characters (checked when
compiling), so every path passes the states at such borders, and the shortest path of a text is the
concatenation of those of its words. Two bounded tables keep the paths of words and of stretches
between spaces.

Decoding maps pieces to their characters, joins byte pieces, and undoes the normaliser. decode(encode(t))
is t for every text without the meta symbol itself, which decodes to a space. Null and empty texts
have no ids. Rows that repeat an id each get a row; other columns are ignored, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches

VOCABULARY = "piece_bpe_32k.model"
META = "▁"
#: Beside the pieces' ids: the state after a character outside the vocabulary, and of the start.
OTHER = (1 << 20) - 1
STATES = 1 << 20
#: Words and stretches remembered by a process; longer ones are composed anew each time.
TABLE = 200_000
TABLE_CHARS = 40
#: Stretches of a text with a space put in front, without their first space.
_STRETCHES = re.compile(" ( *[^ ]*)")
#: Runs of letters, of other characters, each with the meta symbols before it.
_WORDS = regex.compile(rf"{META}*+(?:[\p{{L}}\p{{M}}]++|[^\p{{L}}\p{{M}}{META}]++)|{META}++")
_BORDER = regex.compile(rf"[\p{{L}}\p{{M}}][^\p{{L}}\p{{M}}]|[^\p{{L}}\p{{M}}{META}][\p{{L}}\p{{M}}{META}]")


class Memo(dict):
    """Results by key, made when missing; two generations of TABLE keys, so that frequent keys stay. Longer keys are made anew."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        if (out := self.old.get(key)) is None:
            out = self.make(key)
        if len(key) <= TABLE_CHARS:
            if len(self) >= TABLE:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


class Transducer:
    """The compiled composition of normaliser, pieces and byte fall-back."""

    def __init__(self, name: str = VOCABULARY):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1)
        self.byte_of: dict[int, int] = {}
        usable = []
        for i in range(n):
            if sp.is_byte(i):
                value = int(self.text[i][3:5], 16)
                self.byte[value], self.byte_of[i] = i, value
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                usable.append(i)
        self.bytes_ = [b"" if i in self.byte_of else self.text[i].encode() for i in range(n)]
        for i, value in self.byte_of.items():
            self.bytes_[i] = bytes([value])
        self.plain = [b.replace(META.encode(), b" ") for b in self.bytes_]
        if crossing := [self.text[i] for i in usable if _BORDER.search(self.text[i])]:
            raise ValueError(f"pieces span borders between words: {crossing[:5]}")
        self.id = {self.text[i]: i for i in usable}
        merged = sorted((i for i in usable if len(self.text[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        #: When a piece is made: single characters are there from the start.
        self.rank = {self.text[i]: 0 for i in usable if len(self.text[i]) == 1} | {self.text[i]: k + 1 for k, i in enumerate(merged)}
        self.parts: dict[str, tuple[str, str]] = {}
        for i in merged:
            piece = self.text[i]
            if halves := self._last_merge(piece):
                self.parts[piece] = halves
            else:
                del self.rank[piece]
        self.trie: dict = {}
        for piece in self.rank:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = self.id[piece]
        #: The normaliser's arcs: what its start state writes, and what its other state writes for a character.
        self.front, self.normaliser = META, {ord(" "): META}
        self.weights: dict[int, int] = {}
        self.words = Memo(self._word)
        self.stretches = Memo(self._stretch)

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge completes the piece, or None if merges never arrive at it."""
        parts = list(piece)
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda k: (self.rank.get(parts[k] + parts[k + 1], 1 << 30), k))
            if parts[at] + parts[at + 1] not in self.rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1])

    def _contradicted(self, left: str, right: str) -> bool:
        """Whether a merge across the border of two pieces comes before those that make the pieces."""
        rank, parts = self.rank, self.parts
        before = 1 << 30  # merges from this rank on happen after the border was passed
        while True:
            cross = rank.get(left + right)
            if cross is not None and cross < before:
                return True
            a, b = rank[left], rank[right]
            if a == 0 and b == 0:
                return False
            if a > b:
                before, left = a, parts[left][1]
            else:
                before, right = b + 1, parts[right][0]

    def weight(self, arc: int) -> int:
        """Weight of the arc between the states of two pieces, given as left id * OTHER + right id."""
        left, right = divmod(arc, OTHER)
        out = int(self._contradicted(self.text[left], self.text[right]))
        if len(self.weights) > 2_000_000:
            self.weights.clear()
        self.weights[arc] = out
        return out

    def _shortest(self, chars: str) -> tuple[int, list[tuple[int, int]]]:
        """The least weight of a path over the normalised characters, and its (end, piece) states.

        OTHER stands for a character that the byte transducer reads, and for the start.
        """
        n, weights, trie = len(chars), self.weights, self.trie
        came: dict[int, int] = {}  # settled states, end * STATES + piece, with the state before each
        state, distance = OTHER, 0
        near: list[tuple[int, int]] = []  # arcs (from, to) that may lie on a path of this distance
        far: list[tuple[int, int]] = []  # arcs (-1 - from, to) whose weight of 1 is added already
        while state < n * STATES:
            at, left = divmod(state, STATES)
            node, k = trie.get(chars[at]), at + 1
            if node is None:
                near.append((state, k * STATES + OTHER))
            else:
                while node is not None:
                    if (t := node.get("")) is not None:
                        near.append((state, k * STATES + t))
                    if k == n:
                        break
                    node, k = node.get(chars[k]), k + 1
            while True:
                if not near:
                    near, far, distance = far, [], distance + 1
                a, b = near.pop()
                if b in came:
                    continue
                if a < 0:  # its weight is added already
                    a = -1 - a
                    break
                left, right = a % STATES, b % STATES
                if left != OTHER and right != OTHER:
                    arc = left * OTHER + right
                    if (w := weights.get(arc)) is None:
                        w = self.weight(arc)
                    if w:
                        far.append((-1 - a, b))
                        continue
                break
            came[b] = a
            state = b
        path = []
        while state != OTHER:
            path.append(divmod(state, STATES))
            state = came[state]
        return distance, path[::-1]

    def _word(self, chars: str) -> bytes:
        """Packed ids on the shortest path over one word."""
        ids: list[int] = []
        for end, piece in self._shortest(chars)[1]:
            if piece != OTHER:
                ids.append(piece)
            else:
                ids.extend(int(self.byte[b]) for b in chars[end - 1].encode("utf-8", "surrogatepass"))
        return array("i", ids).tobytes()

    def _stretch(self, stretch: str) -> bytes:
        """Packed ids of a stretch; its first space is left out of the argument."""
        return b"".join(map(self.words.__getitem__, _WORDS.findall(self.front + stretch.translate(self.normaliser))))

    def packed(self, text: str | None) -> np.ndarray:
        """The text's ids as an array."""
        if not text:
            return np.zeros(0, np.int32)
        text = text.replace(META, " ")
        parts = _STRETCHES.findall(" " + text) if "  " in text or text[0] == " " else text.split(" ")
        return np.frombuffer(b"".join(map(self.stretches.__getitem__, parts)), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.packed(text).tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace").replace(META, " ")
        return text[1:] if text.startswith(" ") else text


_compiled: dict[str, Transducer] = {}


def transducer(name: str = VOCABULARY) -> Transducer:
    """Compiled once in each process."""
    if name not in _compiled:
        _compiled[name] = Transducer(name)
    return _compiled[name]


def _encoded(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(name)
        for batch in batches:
            texts = column(batch, "text")
            sizes, flat, same = [0], [], []
            for text in texts:
                ids = t.packed(text)
                same.append(t.decode(ids.tolist()) == (text or "").replace(META, " "))
                flat.append(ids)
                sizes.append(sizes[-1] + len(ids))
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(sizes), pa.int64()), pa.array(same)], names=["id", "ids", "n_tokens", "round_trip"])

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, round_trip): the text's ids and whether they decode to the text."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = slim.mapInArrow(_encoded(vocabulary), f"id {dict(docs.dtypes)[id_col]}, ids array<int>, n_tokens long, round_trip boolean")
    return made.withColumnRenamed("id", id_col)


def _decoded(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(name)
        for batch in batches:
            texts = [t.decode(ids or []) for ids in column(batch, "ids")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def decode(rows: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from rows with ids."""
    small_batches(rows.sparkSession)
    slim = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return slim.mapInArrow(_decoded(vocabulary), f"id {dict(rows.dtypes)[id_col]}, text string").withColumnRenamed("id", id_col)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
