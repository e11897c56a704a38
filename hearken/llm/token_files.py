"""Token ids in files of patched frame-of-reference blocks.

Documents are cut into ranges of ascending ids; each range is sorted, tokenized and written as segments. A segment
holds whole documents, about SEGMENT ids of them, as blocks of BLOCK ids. A block stores its minimum, the differences
to it packed at the width that PERCENTILE of them fit in, and a list of exceptions: places and upper bits of those
that do not fit. The segment's index has the byte at which each block starts, so that any id is found by decoding one
block. Segments are rows of a Parquet table, which any store that Spark writes to can hold.

Block: u32 minimum, u16 ids, u8 width, u8 zero, u16 exceptions, u16 zero, then 8 x width 64-bit words (eight lanes of
64 values each), then the exceptions' u16 places, then their u32 upper bits. All are little-endian.
"""

from __future__ import annotations

import json
import struct
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import Store, by_slices, id_bucket, id_splits, only, written

BLOCK, SEGMENT, PERCENTILE, END_ID = 512, 1 << 16, 98.0, 2
_HEAD = struct.Struct("<IHBBHH")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- blocks ---------------------------------------------------------------------------------------------------


def _lanes(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 512) values below 2 ** width to (blocks, width, 8) words."""
    v = values.reshape(len(values), 64, 8).astype(np.uint64)
    out = np.zeros((len(values), width + 1, 8), np.uint64)
    for p in range(64):
        word, shift = divmod(p * width, 64)
        out[:, word] |= v[:, p] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, p] >> np.uint64(64 - shift)
    return out[:, :width]


def _values(words: np.ndarray, width: int) -> np.ndarray:
    """The reverse of _lanes."""
    out = np.zeros((len(words), 64, 8), np.uint64)
    if width:
        mask = np.uint64((1 << width) - 1)
        for p in range(64):
            word, shift = divmod(p * width, 64)
            x = words[:, word] >> np.uint64(shift)
            if shift + width > 64:
                x = x | (words[:, word + 1] << np.uint64(64 - shift))
            out[:, p] = x & mask
    return out.reshape(len(words), BLOCK)


def bit_widths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def encode_blocks(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """(payload, byte at which each block starts) of unsigned 32-bit ids."""
    if not len(ids):
        return b"", []
    n = -(-len(ids) // BLOCK)
    padded = np.full(n * BLOCK, ids[-1], np.int64)
    padded[: len(ids)] = ids
    table = padded.reshape(n, BLOCK)
    lowest = table.min(axis=1)
    table = table - lowest[:, None]
    bits = bit_widths(table)
    k = min(BLOCK - 1, int(np.ceil(BLOCK * PERCENTILE / 100)) - 1)
    widths = np.partition(bits, k, axis=1)[:, k]
    out: list[bytes] = [b""] * n
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        part = table[rows]
        low = part & ((1 << width) - 1)
        packed = _lanes(low, width) if width else np.zeros((len(rows), 0, 8), np.uint64)
        over = bits[rows] > width
        for r, row in enumerate(rows.tolist()):
            at = np.flatnonzero(over[r])
            size = min(BLOCK, len(ids) - row * BLOCK)
            at = at[at < size]
            head = _HEAD.pack(int(lowest[row]), size, width, 0, len(at), 0)
            out[row] = head + packed[r].astype("<u8").tobytes() + at.astype("<u2").tobytes() + (part[r, at] >> width).astype("<u4").tobytes()
    sizes = np.cumsum([0, *map(len, out)])
    return b"".join(out), sizes[:-1].tolist()


def decode_blocks(payload: bytes, starts: list[int]) -> np.ndarray:
    """All ids of a payload, or with a part of the index those of its blocks."""
    if not starts:
        return np.zeros(0, np.uint32)
    heads = [_HEAD.unpack_from(payload, s) for s in starts]
    out = np.zeros((len(starts), BLOCK), np.int64)
    widths = np.array([h[2] for h in heads])
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        words = np.zeros((len(rows), width, 8), np.uint64)
        for r, row in enumerate(rows.tolist()):
            if width:
                words[r] = np.frombuffer(payload, "<u8", 8 * width, starts[row] + _HEAD.size).reshape(width, 8)
        out[rows] = _values(words, width)
    for row, (s, (_, _, width, _, extra, _)) in enumerate(zip(starts, heads, strict=True)):
        if extra:
            at = s + _HEAD.size + 64 * width
            where = np.frombuffer(payload, "<u2", extra, at).astype(np.int64)
            out[row, where] |= np.frombuffer(payload, "<u4", extra, at + 2 * extra).astype(np.int64) << width
    out += np.array([h[0] for h in heads], np.int64)[:, None]
    sizes = np.array([h[1] for h in heads])
    return out[np.arange(BLOCK)[None, :] < sizes[:, None]].astype(np.uint32)


# ---- tokens ---------------------------------------------------------------------------------------------------

_BLANK_AFTER_SPACE = r"\x01|[\s\p{Z}\x0B\x1C-\x1F\x{85}] "  # RE2, whose \s is that of ASCII only
_BARE = "\x01"  # stands before what no blank stands before
# A stop or comma after an ASCII letter, where the chunk ends: the library cuts before it whatever comes next.
_STOP, _STOP_APART = r"([A-Za-z])([.,])( |$)", rf"\1 {_BARE}\2\3"
_BLANK = "\u0120"  # how byte-level vocabularies write a blank


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def cuts_at_blanks(tokenizer_file: str) -> bool:
    """Whether the file is of a tokenizer that cuts texts as Tokens relies on: bytes as characters, the common pattern of words, and
    nothing that looks at the text before; added tokens have no blank, letter or stop on their own. Others get whole texts."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    cutter = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
    return plain and all(x["content"].startswith("<|") and " " not in x["content"] for x in spec.get("added_tokens", []))


class Tokens:
    """Ids of the tokenizers library, asked once for each chunk that comes again.

    The library cuts text before a blank that follows a character other than white space, whatever comes next; so the
    ids of a text are those of the chunks between such blanks, and of the stops and commas that end them after a letter. Texts with
    a blank after white space go whole.
    """

    JOINED = 256

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.by_chunks = cuts_at_blanks(tokenizer_file)
        places = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(places.values(), default=0) + 1, bool)  # by id, whether its first byte is a blank
        self.begins[[i for x, i in places.items() if x.startswith(_BLANK)]] = True
        self.store = Store("token_files", 80 << 20)  # by chunk without its blank

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [_little(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of each chunk, with its blank. Chunks that do not end in white space are asked JOINED at a time as one text:
        each has one blank, its first character, so the ids that begin with a blank are where the chunks begin."""
        out: dict[str, bytes] = {}
        joined = [x for x in chunks if x and not x[-1].isspace()]
        groups = [joined[at : at + self.JOINED] for at in range(0, len(joined), self.JOINED)]
        for group, raw in zip(groups, self._ask([" " + " ".join(x) for x in groups]), strict=True):
            starts = (np.flatnonzero(self.begins[np.frombuffer(raw, "<u4")]) * 4).tolist()
            if len(starts) == len(group):
                out.update(zip(group, map(raw.__getitem__, map(slice, starts, [*starts[1:], len(raw)])), strict=True))
        rest = [x for x in chunks if x not in out] if len(out) < len(chunks) else []
        out.update(zip(rest, self._ask([" " + x for x in rest]), strict=True))
        return out

    @staticmethod
    def _atoms(chunk: str) -> list[str]:
        """A chunk cut where the library always cuts too: at one line feed between characters other than white space, and
        around a stop or comma before that after an ASCII letter. What follows a cut begins with _BARE."""
        head, _, tail = chunk.partition("\n")
        if not head or head == _BARE or not tail or head[-1].isspace() or tail[0].isspace():
            return [chunk]
        stop = [_BARE + head[-1]] if len(head) > 2 and head[-1] in ".," and "A" <= head[-2] <= "z" and head[-2].isalpha() else []
        return [head[:-1] if stop else head, *stop, f"{_BARE}\n{tail}"]

    def _new(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks that are not in the store, which keeps them."""
        cut = {c: self._atoms(c) for c in chunks if "\n" in c}
        plain = [c for c in chunks if c not in cut and c[:1] != _BARE] if cut else [c for c in chunks if c[:1] != _BARE]
        bare = [c for c in chunks if c not in cut and c[:1] == _BARE]
        if cut:
            known = {*plain, *bare}
            for x in dict.fromkeys(x for atoms in cut.values() for x in atoms if x not in known and x not in self.store):
                (bare if x[:1] == _BARE else plain).append(x)
        found = self._ask_chunks(plain)
        found.update(zip(bare, self._ask([x[1:] for x in bare]), strict=True))
        self.store.keep_all(found)
        for c, atoms in cut.items():
            if len(atoms) > 1:
                found[c] = b"".join([found[x] if x in found else self.store[x] for x in atoms])
        return found

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        Texts are split and their chunks numbered by Arrow; Python meets each different chunk of the texts once.
        """
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return []
        whole = pc.match_substring_regex(texts, _BLANK_AFTER_SPACE).to_numpy(zero_copy_only=False) if self.by_chunks else np.ones(len(texts), bool)
        out: list[bytes] = [b""] * len(texts)
        at = np.flatnonzero(whole).tolist()
        for i, ids in zip(at, self._ask(texts.take(pa.array(at, pa.int64())).to_pylist()), strict=True):
            out[i] = ids
        at = np.flatnonzero(~whole).tolist()
        if not at:
            return out
        some = texts.take(pa.array(at, pa.int64())) if len(at) < len(texts) else texts
        lists = pc.split_pattern(pc.replace_substring_regex(some, _STOP, _STOP_APART), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        firsts = ends[:-1]  # the places of what no blank stands before
        numbered = lists.flatten().dictionary_encode()
        place = numbered.indices.to_numpy().astype(np.int64)
        chunks = numbered.dictionary.to_pylist()
        first_texts = [chunks[i] for i in place[firsts].tolist()]
        place[firsts] = np.arange(len(chunks), len(chunks) + len(firsts))
        met = np.zeros(len(chunks) + len(firsts), bool)
        met[place] = True
        got = list(map(self.store.get, chunks))
        missed = [i for i, (x, used) in enumerate(zip(got, met.tolist())) if x is None and used]
        new = self._new([chunks[i] for i in missed])
        for i in missed:
            got[i] = new[chunks[i]]
        ids = pa.array([*(x or b"" for x in got), *self._ask(first_texts)], pa.large_binary()).take(pa.array(place))
        _, bounds, data = ids.buffers()
        bounds = np.frombuffer(bounds, np.int64)[ends].tolist()
        data = memoryview(data) if data is not None else b""
        for i, begin, end in zip(at, bounds, bounds[1:], strict=False):
            out[i] = bytes(data[begin:end])
        return out


_opened: dict[str, Tokens] = {}


def opened(tokenizer_file: str) -> Tokens:
    """One for each file in each Python worker, so that what it has stored serves the worker's next tasks."""
    if tokenizer_file not in _opened:
        _opened[tokenizer_file] = Tokens(tokenizer_file)
    return _opened[tokenizer_file]


def write_token_files(docs: DataFrame, *, tokenizer_file: str | None = None, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Writes the ids of all documents, each with end_id after it, in ascending order of doc_id (nulls first, ties by
    text) and returns the table of segments, read from its files.

    Columns: part and segment (in order), start (ids of the part before the segment), doc_ids, doc_sizes, block_starts,
    payload. Null texts count as empty.
    """
    import os

    tokenizer_file = tokenizer_file or default_tokenizer()
    splits = id_splits(docs, "doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(id_bucket(F.col("doc_id"), splits, docs.schema["doc_id"].dataType.simpleString()).alias("part"), "doc_id", text.alias("text"))
    rows = rows.repartition(len(splits) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        only("token_files")
        tokens = opened(tokenizer_file)
        part, segment, start = None, 0, 0
        held: list[tuple] = []
        size = 0

        def closed():
            nonlocal segment, start, held, size
            ids = np.frombuffer(b"".join(x[1] for x in held), "<u4")
            payload, starts = encode_blocks(ids)
            row = {
                "part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "start": pa.array([start], pa.int64()),
                "doc_ids": pa.array([[x[0] for x in held]], pa.list_(pa.int64())), "doc_sizes": pa.array([[len(x[1]) // 4 for x in held]], pa.list_(pa.int64())),
                "block_starts": pa.array([starts], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary()),
            }
            segment, start, held, size = segment + 1, start + size, [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for piece in by_slices(batch, 8192, 16 << 20):
                found = tokens.encode(piece.column(2))
                for p, d, ids in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), found, strict=True):
                    if p != part:
                        if held:
                            yield closed()
                        part, segment, start = p, 0, 0
                    held.append((d, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= SEGMENT:
                        yield closed()
        if held:
            yield closed()

    table = rows.mapInArrow(run, "part int, segment int, start long, doc_ids array<bigint>, doc_sizes array<bigint>, block_starts array<bigint>, payload binary")
    if path is None:
        return written(table, "tokens")
    table.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def read_token_files(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; start counts all ids before it."""
    sizes = segments.groupBy("part").agg(F.sum(F.expr("aggregate(doc_sizes, 0L, (a, x) -> a + x)")).alias("n"))
    before, at = {}, 0
    for r in sorted(sizes.collect(), key=lambda r: r["part"]):  # a row for each part, whose number id_splits bounds
        before[r["part"]] = at
        at += r["n"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_blocks(row["payload"], row["block_starts"])
                ends = np.cumsum([0, *row["doc_sizes"]])
                raw = ids.astype("<u4")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(ends[:-1] + row["start"] + before[row["part"]], pa.int64()),
                    "n_tokens": pa.array(np.diff(ends), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[i:j].tobytes()) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64()),
                })

    return segments.select("part", "start", "doc_ids", "doc_sizes", "block_starts", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
