"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The pieces and scores of a model file are filed in an automaton. Reading a text once, at each position the pieces that end
there are met along the output links, longest first, and relax the best score of that position; a character that is no
piece costs the worst score less 10 and is written as its UTF-8 bytes' pieces (or the unknown piece, without such).
That is the unigram segmentation: the highest sum of scores; of equal sums that with the longer last piece. A
model trained as BPE only lends its pieces and scores: its own merges may cut a text otherwise.

Blanks become U+2581 and one is put before the text; nothing else is normalised. A U+2581 of the text itself is written in
bytes, so decoding gives every text back (but for what the unknown piece stands for, in models without bytes). No piece
goes on over the start of a run of blanks or a line feed unless some piece has one inside; then the best path is the sum of the best
paths of the parts, and a Python worker keeps the ids of CACHE_PARTS parts at a time. Else the text is one part.

Nulls: a null text is empty: no ids. Rows that repeat a doc_id are coded alone. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._common import begin, caches, ship, utf8

BLANK = "▁"
#: Stands for a U+2581 of the text; a private character that no piece has.
_OWN = "\U0010fffd"
CACHE_PARTS = 300_000


class Codec:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces: (text, score, kind) by id; kind is normal, byte, unknown or control."""
        self.pieces = pieces
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == "unknown"), 0)
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "normal" and p]
        self.lost = min((s for _, s, _ in normal), default=0.0) - 10
        inner = any(BLANK in p.lstrip(BLANK) for p, _, _ in normal)
        lines = any("\n" in p for p, _, _ in normal)
        self.parts = None if inner else re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if lines else f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
        self.moves: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, float, int] | None] = [None]  # of each node: length, score, id
        for p, s, i in normal:
            at = 0
            for c in p:
                to = self.moves[at].get(c)
                if to is None:
                    to = self.moves[at][c] = len(self.moves)
                    self.moves.append({})
                    self.ends.append(None)
                at = to
            self.ends[at] = (len(p), s, i)
        self.fail, self.output = [0] * len(self.moves), [0] * len(self.moves)
        queue = list(self.moves[0].values())
        for at in queue:
            for c, to in self.moves[at].items():
                f = self.fail[at]
                while f and c not in self.moves[f]:
                    f = self.fail[f]
                f = self.fail[to] = self.moves[f].get(c, 0)
                self.output[to] = f if self.ends[f] else self.output[f]
                queue.append(to)
        self.raw = [bytes([int(p[3:5], 16)]) if kind == "byte" else b"" if kind == "control" else " ⁇ ".encode() if kind == "unknown" else p.replace(BLANK, " ").encode() for p, _, kind in pieces]
        self.cached: dict[str, tuple[bytes, float]] = {}

    def _viterbi(self, text: str) -> tuple[bytes, float]:
        """Ids (unsigned 32-bit) and score of the best path."""
        moves, ends, fail, output = self.moves, self.ends, self.fail, self.output
        best, came = [0.0], [(0, -1)]
        at = 0
        for i, c in enumerate(text):
            while at and c not in moves[at]:
                at = fail[at]
            at = moves[at].get(c, 0)
            top, way, single = None, None, False
            node = at if ends[at] else output[at]
            while node:
                n, s, piece = ends[node]
                score = best[i + 1 - n] + s
                if top is None or score > top:
                    top, way = score, (n, piece)
                single = single or n == 1
                node = output[node]
            if not single and (top is None or best[i] + self.lost > top):
                top, way = best[i] + self.lost, (1, -1)
            best.append(top)
            came.append(way)
        ids: list[int] = []
        i = len(text)
        while i:
            n, piece = came[i]
            if piece >= 0:
                ids.append(piece)
            else:
                char = BLANK if text[i - 1] == _OWN else text[i - 1]
                data = char.encode("utf-8", "surrogatepass")
                ids += [self.bytes[b] for b in reversed(data)] if all(b in self.bytes for b in data) else [self.unknown]
            i -= n
        ids.reverse()
        return array("I", ids).tobytes(), best[-1]

    def encode(self, text: str) -> tuple[bytes, float]:
        """The ids of a text as native unsigned 32-bit numbers, and their score."""
        if not text:
            return b"", 0.0
        marked = BLANK + text.replace(BLANK, _OWN).replace(" ", BLANK)
        if self.parts is None:
            return self._viterbi(marked)
        cached, out, score = self.cached, [], 0.0
        for part in self.parts.findall(marked):
            found = cached.get(part)
            if found is None:
                if len(cached) >= CACHE_PARTS:
                    cached.clear()
                found = cached[part] = self._viterbi(part)
            out.append(found[0])
            score += found[1]
        return b"".join(out), score

    def decode(self, ids: bytes) -> str:
        """The text of ids as encode() gives them."""
        raw = self.raw
        return b"".join([raw[i] for i in array("I", ids)]).decode("utf-8", "replace")[1:]


@cache
def load(model: str) -> Codec:
    """The codec of a SentencePiece model file, built once in each Python worker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    kind = lambda i: "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "normal"
    return Codec([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])


caches("sentencepiece", load.cache_clear)


def code(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, score, decoded_sha256, round_trip) of each row."""
    ship(docs.sparkSession)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("sentencepiece")
        codec = load(model)
        for b in batches:
            rows = []
            for value in utf8(b.column(1)).to_pylist():
                ids, score = codec.encode(value)
                back = codec.decode(ids)
                rows.append((len(ids) // 4, zlib.crc32(ids), score, hashlib.sha256(back.encode()).hexdigest(), back == value))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.bool_()]
            yield pa.record_batch([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", "n_ids", "ids_crc32", "score", "decoded_sha256", "round_trip"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(both, "doc_id long, n_ids long, ids_crc32 long, score double, decoded_sha256 string, round_trip boolean")
