"""Encoding to the pieces of a SentencePiece vocabulary, and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each position the pieces that end there (the node and
its output links) relax the best score of that position: the segmentation of the highest sum of piece scores. A
character that no piece covers goes to its bytes. The text is not normalised: blanks become U+2581, one is put in
front, and decoding gives the very text back; a U+2581 of the text itself goes to bytes, so that it comes back too.

Pieces hold U+2581 at their start only (checked when the model is loaded; runs of it aside), so the best segmentation
is that of the parts that begin at a blank, joined; parts that come again are taken from a bounded store.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import Store, by_slices, only

BLANK = "▁"
#: What a byte costs more than the worst piece, as the format has it for unknown characters.
UNKNOWN_PENALTY = 10.0
_PARTS = re.compile(" +[^ ]*|^[^ ]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCoder:
    """Encoder and decoder for one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes_at.items()}
        if len(self.bytes_at) != 256:
            raise ValueError("the vocabulary has no piece for each byte")
        normal = {p: i for i, p in enumerate(self.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.by_blank = not any(BLANK in p[1:] and p.strip(BLANK) for p in normal)
        scores = [sp.get_score(i) for i in normal.values()]
        self.byte_score = min(scores) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, i in normal.items():
            self.automaton.add_word(p, (len(p), i, sp.get_score(i)))
        self.automaton.make_automaton()
        self.text_of = [bytes((self.byte_of[i],)) if i in self.byte_of else p.replace(BLANK, " ").encode() for i, p in enumerate(self.pieces)]
        self.store = Store("pieces", 112 << 20)

    def viterbi(self, part: str) -> array:
        """Best segmentation of a part in which blanks are U+2581 already."""
        n = len(part)
        low = -1e300
        best = array("d", [low]) * (n + 1)
        best[0] = 0.0
        # where the best last piece of a position starts, and its number; -1 for the bytes of one character
        begins, last = array("q", range(-1, n)), array("i", [-1]) * (n + 1)
        at = 0
        for end, (size, piece, score) in self.automaton.iter(part):
            end += 1
            while at < end:  # positions that no piece ends at can still be reached by bytes
                if at and best[at - 1] + self.byte_score > best[at]:
                    best[at], begins[at], last[at] = best[at - 1] + self.byte_score, at - 1, -1
                at += 1
            start = end - size
            if best[start] + score > best[end]:
                best[end], begins[end], last[end] = best[start] + score, start, piece
        while at <= n:
            if at and best[at - 1] + self.byte_score > best[at]:
                best[at], begins[at], last[at] = best[at - 1] + self.byte_score, at - 1, -1
            at += 1
        out = array("i")
        end = n
        while end:
            start, piece = begins[end], last[end]
            if piece >= 0:
                out.append(piece)
            else:
                raw = part[start:end].replace(BLANK, " ")
                out.extend(self.bytes_at[b] for b in reversed(raw.encode("utf-8", "surrogatepass")))
            end = start
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        return b"".join(self.encode_in_steps(text))

    def encode_in_steps(self, text: str) -> Iterator[bytes]:
        """The ids of a text, stretch by stretch."""
        if not text:
            return
        if not self.by_blank:
            yield _ids(self._with_marks(" " + text, self.viterbi))
            return
        for stretch in stretches(text):
            if BLANK in stretch:
                yield _ids(self._with_marks(stretch, self._by_parts))
                continue
            # each part stands for itself with one blank before it
            parts = _PARTS.findall(stretch) if "  " in stretch else stretch[1:].split(" ")
            got = list(map(self.store.get, parts))
            if None in got:
                got = [self._new(p) if x is None else x for p, x in zip(parts, got, strict=True)]
            yield b"".join(got)

    def _new(self, part: str) -> bytes:
        """The ids of a part: a word, which one blank stands before, or blanks and a word."""
        if (ids := self.store.get(part)) is None:
            blank = part if part[:1] == " " else " " + part
            ids = _ids(self.viterbi(blank.replace(" ", BLANK)))
            if len(part) < 64:
                self.store.keep(part, ids, 60 + 2 * len(part) + len(ids))
        return ids

    def _by_parts(self, stretch: str) -> list[int]:
        """A stretch in which blanks are U+2581; only its first part may have none before it."""
        parts = _PARTS.findall(stretch.replace(BLANK, " "))
        raw = b"".join(_ids(self.viterbi(p)) if p[0] != " " else self._new(p[1:] if p[1:2] not in ("", " ") else p) for p in parts)
        return np.frombuffer(raw, "<i4").tolist()

    def _with_marks(self, text: str, encode: Callable[[str], list[int] | array]) -> list[int]:
        """A text with U+2581 in it: that character itself goes to bytes, the stretches between are encoded apart."""
        out: list[int] = []
        raw = [self.bytes_at[b] for b in BLANK.encode()]
        for i, stretch in enumerate(text.split(BLANK)):
            if i:
                out += raw
            if stretch:
                out += encode(stretch.replace(" ", BLANK))
        return out

    def gives_back(self, ids: np.ndarray, text: str, step: int = 1 << 16) -> bool:
        """Whether decoding gives the very text, compared in steps of so many ids."""
        raw = (" " + text).encode("utf-8", "surrogatepass") if text else b""
        at = 0
        for i in range(0, len(ids), step):
            part = b"".join(map(self.text_of.__getitem__, ids[i : i + step].tolist()))
            if raw[at : at + len(part)] != part:
                return False
            at += len(part)
        return at == len(raw)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def stretches(text: str, size: int = 1 << 18) -> Iterator[str]:
    """A text with a blank before it, cut before the first blank of a run of them about every size characters, so that
    each stretch begins with a blank."""
    at, cut = 0, -1
    while True:
        cut = text.find(" ", max(at + size, cut + 1))
        while cut >= 0 and (cut + 1 == len(text) or text[cut - 1] == " "):
            cut = text.find(" ", cut + 1)
        whole = text[at:cut] if cut >= 0 else text[at:]
        yield whole if at else " " + whole
        if cut < 0:
            return
        at = cut


def _ids(ids: list[int] | array) -> bytes:
    return np.array(ids, "<i4").tobytes()


_opened: dict[str, PieceCoder] = {}


def opened(model_file: str) -> PieceCoder:
    """One for each file in each Python worker, so that what it has stored serves the worker's next tasks."""
    if model_file not in _opened:
        _opened[model_file] = PieceCoder(model_file)
    return _opened[model_file]


def encode_documents(docs: DataFrame, *, model_file: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip, ids) for every row: null texts count as empty and give no ids.

    ids_crc32 is that of the ids as little-endian unsigned 32-bit integers; round_trip tells whether decoding gives
    the text back, which it must.
    """
    model_file = model_file or default_model()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        only("pieces")
        coder = opened(model_file)
        for batch in batches:
            for part in by_slices(batch, size=1 << 20):
                texts = part.column(1).to_pylist()
                raws, back = [], []
                for text in texts:
                    raw = coder.encode(text or "")
                    raws.append(raw)
                    back.append(coder.gives_back(np.frombuffer(raw, "<i4"), text or ""))
                ends = np.cumsum([0, *(len(x) // 4 for x in raws)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0),
                    "n_pieces": pa.array(np.diff(ends).astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in raws], pa.int64()),
                    "round_trip": pa.array(back, pa.bool_()),
                    "ids": pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(raws))])),
                })

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, round_trip boolean, ids array<int>")


def decode_documents(encoded: DataFrame, *, model_file: str | None = None) -> DataFrame:
    """(doc_id, text) from the ids of encode_documents; null ids give a null text."""
    model_file = model_file or default_model()

    def run(batches):
        coder = opened(model_file)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every document with its ids."""
    return encode_documents(docs.select(F.col("doc_id"), "text"))
