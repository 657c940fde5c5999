"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised (a space in front, spaces written as U+2581), cut into
characters, and from an agenda of adjacent symbol pairs the one whose
concatenation has the best score is merged, the leftmost of equals, until no
pair is in the vocabulary. Symbols outside the vocabulary fall back to their
UTF-8 bytes.

No piece of such a vocabulary crosses from a character into a following
U+2581, so the agenda runs per space-delimited chunk. The chunks of an Arrow
batch are encoded once each and together: row by row, the agenda is a vector of
pair ranks whose smallest entry is popped in every round. Long chunks and those
with unknown characters take a heap instead. A vocabulary with pieces across
spaces is encoded text by text. Rows are independent: no shuffle, and a lost
task is only run again.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from precis.llm.common import quoted

SPACE = "▁"
#: Vocabulary files beyond this size are refused, as they travel with every task.
MAX_MODEL_BYTES = 64 << 20
#: Up to this length the agenda is a row of a matrix, beyond it a heap.
SHORT_CHARS = 40
#: Characters of text and rows of a matrix that are worked on at a time.
BATCH_CHARS, BATCH_ROWS = 2_500_000, 40_000

# Fixed values of the published model format: piece types and field numbers.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_TYPE = 2


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        part = buf[at]
        at += 1
        value |= (part & 0x7F) << shift
        if part < 0x80:
            return value, at
        shift += 7


def _message(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialized protocol-buffer message."""
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(buf, at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                size, at = _varint(buf, at)
            value, at = buf[at:at + size], at + size
        yield key >> 3, value


class BpeModel:
    """Vocabulary and merge rules of a SentencePiece BPE model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.rank: dict[str, int] = {}
        scores: dict[str, float] = {}
        trainer: dict[int, int | bytes] = {}
        normalizer: dict[int, int | bytes] = {}
        for field, value in _message(data):
            if field == 1:
                row = dict(_message(value))
                piece, kind = row.get(1, b"").decode(), row.get(3, NORMAL)
                score = struct.unpack("<f", row[2])[0] if 2 in row else 0.0
                if kind in (USER_DEFINED, UNUSED):
                    raise NotImplementedError("vocabularies with user-defined or unused pieces are not supported")
                if kind == NORMAL:
                    scores[piece] = score
                self.pieces.append(piece)
                self.kinds.append(kind)
            elif field == 2:
                trainer = dict(_message(value))
            elif field == 3:
                normalizer = dict(_message(value))
        if trainer.get(3, 1) != BPE_TYPE:
            raise ValueError("not a merge-type vocabulary")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise NotImplementedError("only the identity normalizer without white-space removal is supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        # The agenda pops the best score first; equal scores share a rank and go left to right.
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unk = self.kinds.index(UNKNOWN)
        self.normal = frozenset(self.ids.values())
        many = [p for p in self.ids if len(p) > 1]
        #: No piece has a space mark after another character: chunks are independent.
        self.by_chunk = not any(SPACE in p[1:] and p.strip(SPACE) for p in many)
        #: A line break that no longer piece holds separates chunks as well.
        self.by_line = not any("\n" in p for p in many)
        self._pair_table()

    # encoding

    def _pair_table(self) -> None:
        """Sorted keys of all symbol pairs that can merge, with the merged piece."""
        first_char = len(self.pieces)  # characters without a piece follow the pieces
        self.char_symbol = np.arange(first_char, first_char + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = i
        pairs = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                parts = [self.ids.get(x, first_char + ord(x) if len(x) == 1 else None) for x in (p[:cut], p[cut:])]
                if None not in parts:
                    pairs[(parts[0] << 21) | parts[1]] = i
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_piece = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int32)
        self.none = len(self.pieces)  # the rank of a pair that can't merge
        self.piece_rank = np.array([self.rank.get(p, self.none) if k == NORMAL else self.none
                                    for p, k in zip(self.pieces, self.kinds)] + [self.none], dtype=np.int32)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols merges to (``none``: no piece)."""
        if not len(self.pair_keys):
            return np.full(a.shape, self.none, dtype=np.int32)
        keys = (a.astype(np.int64) << 21) | b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_piece[at], np.int32(self.none))

    def _merge_rows(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Agendas of many short chunks at once: ``rows`` are symbols, padded at
        the end. Returns the merged symbols, padded, and their number per row."""
        n, width = rows.shape
        out, left = np.zeros((n, width), dtype=np.int32), sizes.copy()
        who = np.arange(n)
        cols = np.arange(width)
        inside = cols[None, 1:] < sizes[:, None]
        piece = np.full((n, width - 1), self.none, dtype=np.int32)
        piece[inside] = self._merged(rows[:, :-1][inside], rows[:, 1:][inside])
        agenda = self.piece_rank[piece]
        while width > 1 and len(who):
            best = agenda.argmin(axis=1)  # the first, and so the leftmost, of equals
            at = np.arange(len(who))
            go = agenda[at, best] < self.none
            if not go.all():
                stop = ~go
                out[who[stop], :width] = rows[stop]
                rows, piece, agenda, best, who = rows[go], piece[go], agenda[go], best[go], who[go]
                at = at[:len(who)]
                if not len(who):
                    break
            rows[at, best] = piece[at, best]
            width -= 1
            take = cols[None, :width] + (cols[None, :width] > best[:, None])
            rows = np.take_along_axis(rows, take, axis=1)
            if width == 1:
                left[who] = 1
                break
            take = cols[None, :width - 1] + (cols[None, :width - 1] >= best[:, None])
            piece = np.take_along_axis(piece, take, axis=1)
            agenda = np.take_along_axis(agenda, take, axis=1)
            left[who] -= 1
            for i, ok in ((best - 1, best > 0), (best, best + 1 < left[who])):
                r, c = at[ok], i[ok]
                p = self._merged(rows[r, c], rows[r, c + 1])
                piece[r, c] = p
                agenda[r, c] = self.piece_rank[p]
        if len(who):
            out[who, :width] = rows[:, :width]
        return out, left

    def merge(self, chunk: str) -> list[int]:
        """Ids of one normalised chunk."""
        out: list[int] = []
        for s in self._merge_long(chunk):
            known = self.ids.get(s)
            if known is not None:
                out.append(known)
            elif self.byte_ids:
                out.extend([self.byte_ids[b] for b in s.encode()])
            elif not out or out[-1] != self.unk:  # a run of unknown characters is one id
                out.append(self.unk)
        return out

    def encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids one after another) of distinct chunks."""
        sizes = pc.utf8_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), "")[0].as_py()
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        symbols = self.char_symbol[points]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        unknown = np.concatenate(([0], np.cumsum(symbols >= len(self.pieces))))
        plain = (unknown[starts[1:]] == unknown[starts[:-1]]) & (sizes <= SHORT_CHARS)
        counts = np.zeros(len(chunks), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (rows' numbers repeated per id, ids)
        order = np.flatnonzero(plain & (sizes > 0))
        order = order[np.argsort(sizes[order], kind="stable")]
        for lo in range(0, len(order), BATCH_ROWS):
            who = order[lo:lo + BATCH_ROWS]
            size = sizes[who]
            cols = np.arange(size.max())
            inside = cols[None, :] < size[:, None]
            rows = np.zeros(inside.shape, dtype=np.int32)
            rows[inside] = symbols[(starts[who][:, None] + cols[None, :])[inside]]
            got, left = self._merge_rows(rows, size)
            counts[who] = left
            parts.append((np.repeat(who, left), got[cols[None, :] < left[:, None]]))
        for i in np.flatnonzero(~plain):
            ids = self.merge(text[starts[i]:starts[i + 1]])
            counts[i] = len(ids)
            parts.append((np.full(len(ids), i), np.array(ids, dtype=np.int32)))
        if not parts:
            return counts, np.zeros(0, dtype=np.int32)
        owner = np.concatenate([p[0] for p in parts])
        return counts, np.concatenate([p[1] for p in parts])[np.argsort(owner, kind="stable")].astype(np.int32)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of many texts."""
        flat: list[str] = []
        ends = [0]
        for text in texts:
            flat.extend(self.chunks(text))
            ends.append(len(flat))
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        del flat
        code = coded.indices.to_numpy()
        counts, ids = self.encode_chunks(coded.dictionary.cast(pa.string()))
        first = np.concatenate(([0], np.cumsum(counts)))
        size = counts[code]
        upto = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(upto[-1]) + np.repeat(first[code] - upto[:-1], size)
        return upto[np.array(ends)], ids[place]

    def _merge_long(self, chunk: str) -> list[str]:
        """The agenda as a heap over linked symbols, n log n for chunks of any length."""
        n, rank = len(chunk), self.rank
        symbols: list[str | None] = list(chunk)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int]] = []

        def propose(i: int, j: int) -> None:
            r = rank.get(symbols[i] + symbols[j])
            if r is not None:
                heapq.heappush(agenda, (r, i, j))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            r, i, j = heapq.heappop(agenda)
            # stale when either symbol has been merged away or has grown since
            if symbols[i] is None or symbols[j] is None or right[i] != j:
                continue
            both = symbols[i] + symbols[j]
            if rank.get(both) != r:
                continue
            symbols[i], symbols[j] = both, None
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                propose(i, after)
            if left[i] >= 0:
                propose(left[i], i)
        return [s for s in symbols if s is not None]

    def chunks(self, text: str) -> list[str]:
        """Pieces of the normalised text that are merged independently."""
        if not text:
            return []
        spaced = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        if not self.by_chunk:
            return [spaced]
        if SPACE * 2 not in spaced and SPACE + "\n" not in spaced and self.by_line:
            return spaced.replace("\n", " \n ").replace(SPACE, " " + SPACE).split(" ")
        if self.by_line:
            return re.findall(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n", spaced)
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", spaced)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text or ""])[1].tolist()

    # decoding

    def surface(self, ids) -> str:
        """Text of ids with space marks still in place; bytes are joined to characters."""
        if self.normal.issuperset(ids):
            return "".join([self.pieces[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kinds[i] != CONTROL:
                out.append(self.pieces[i])
        if raw:
            out.append(_utf8(raw))
        return "".join(out)

    def decode(self, ids) -> str:
        surface = self.surface(ids)
        if self.dummy_prefix and surface.startswith(SPACE):
            surface = surface[1:]  # the space put in front
        return surface.replace(SPACE, " ")

    def decode_batch(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Decoded texts; only texts with bytes beyond ASCII or special ids go id by id."""
        if not hasattr(self, "_surfaces"):
            known = [p if k == NORMAL else chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else ""
                     for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
            self._surfaces = pa.array(known, pa.string())
            self._single = np.array([bool(s) for s in known])
        joined = joined_rows(self._surfaces, offsets, ids, "")
        odd = np.concatenate(([0], np.cumsum(~self._single[ids])))
        odd = odd[offsets[1:]] > odd[offsets[:-1]]
        out = []
        for i, surface in enumerate(joined):
            if odd[i]:
                out.append(self.decode(ids[offsets[i]:offsets[i + 1]].tolist()))
            else:
                out.append((surface[1:] if self.dummy_prefix and surface[:1] == SPACE else surface).replace(SPACE, " "))
        return out


def joined_rows(strings: pa.Array, offsets: np.ndarray, ids: np.ndarray, between: str) -> list[str]:
    """For every row of ``offsets`` the strings of its ids, joined."""
    rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), strings.take(pa.array(ids)))
    return pc.binary_join(rows, between).to_pylist()


def _utf8(raw: bytes | bytearray) -> str:
    """Decoded bytes; each byte that starts no valid character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[at:at + size]).decode())
                break
            except UnicodeDecodeError:
                size = 0
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


_MODELS: dict[str, BpeModel] = {}


def _model(data: bytes) -> BpeModel:
    """One parsed model per Python worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = BpeModel(data)
    return _MODELS[key]


def read_model(path: str) -> bytes:
    """The vocabulary file's bytes (its size is checked, as tasks carry it)."""
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"vocabulary file over {MAX_MODEL_BYTES} bytes: {path}")
    with open(path, "rb") as f:
        return f.read()


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``BATCH_CHARS`` characters (a longer text is alone)."""
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and chars + len(text) > BATCH_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` array<int> (unless ``with_ids``
    is false), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Texts are encoded whole, without begin or end ids, and decoded again. A null
    or empty text has no ids (its digests are those of the empty string); a null
    id stays null; repeated rows stay repeated; other columns are not read; an
    empty table gives an empty result."""
    data = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    rows = docs.select(quoted(id_col).alias(id_col), quoted(text_col).alias(text_col))
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema = StructType([StructField(id_col, rows.schema[0].dataType)]
                        + StructType.fromDDL(("ids array<int>, " if with_ids else "") + kind).fields)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data.value)
        decimal = pa.array([str(i) for i in range(len(model.pieces))], pa.string())
        names = [f.name for f in schema.fields]
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _slices(texts):
                offsets, ids = model.encode_batch(texts[lo:hi])
                cols = [batch.column(0).slice(lo, hi - lo)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)))
                cols.append(pa.array(np.diff(offsets), pa.int64()))
                cols.append(pa.array([sha(x) for x in joined_rows(decimal, offsets, ids, ",")], pa.string()))
                cols.append(pa.array([sha(x) for x in model.decode_batch(offsets, ids)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(encoded, schema)


def decode_documents(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id and decoded ``text`` of every row of token ids (null ids: an empty text)."""
    data = tokens.sparkSession.sparkContext.broadcast(read_model(model_path))
    rows = tokens.select(quoted(id_col).alias(id_col), quoted(ids_col).alias(ids_col))
    schema = StructType([StructField(id_col, rows.schema[0].dataType)] + StructType.fromDDL("text string").fields)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data.value)
        for batch in batches:
            column = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            texts = model.decode_batch(offsets, column.flatten().to_numpy(zero_copy_only=False).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(decoded, schema)
