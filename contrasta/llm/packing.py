"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

Every sequence has an estimated cost ``linear * tokens + quadratic * sum(piece length ** 2)``
(the feed-forward part grows with the tokens, attention with the square of each piece).
Pieces are taken longest first and go to the cheapest sequence that can still hold them.

Each task packs the documents of its own input split in groups of about ``group_tokens``
tokens, so nothing is shuffled and a lost executor costs one split. A group opens exactly as
much capacity as it has tokens: sequences of ``capacity`` tokens, and for what is left over
one sequence for each power of two in it, so no sequence is padded. A piece that no open
sequence can hold whole is cut at the room of the emptiest one.

Defined cases: a null text counts as empty and yields the end id alone; repeated rows and
repeated or null ids are packed row by row; very long texts are cut into full sequences; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import give_back

SCHEMA = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")
#: A space before white space or the end: there the words of ``str.split`` are not tokenizer words.
_ODD_SPACE = re.compile(r" (?=\s|\Z)")
#: Words with known ids that a task holds, and rows whose texts it holds at once within an Arrow batch.
CACHE_WORDS, SLICE_ROWS = 300_000, 256
#: The added tokens of ``byte_bpe_50k.json``, which the rank file lacks.
SPECIAL = (("<|endoftext|>", 50256),)


class Encoder:
    """Ids of whole texts as little-endian uint16, with a bounded cache of words.

    The pre-tokenizer always starts a new word at a space that stands before a visible
    character, so such texts are encoded word by word. Others go through the encoder whole.
    Strings of ``special`` tokens become their id, and the parts between them are encoded apart,
    as ``tokenizers`` does; others count as ordinary text.
    """

    def __init__(self, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> None:
        import base64

        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._enc = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._words: dict[str, bytes] = {}
        self._special = {name: np.array([i], dtype="<u2").tobytes() for name, i in special}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")")

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._enc.encode_ordinary(text), dtype="<u2").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(name in text for name in self._special):  # every second part is a special string
            return b"".join([self._special[x] if i % 2 else self._ordinary(x) for i, x in enumerate(self._split.split(text))])
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        known = self._words
        try:
            ids = b"".join([known[w] for w in rest])
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in rest:
                if w not in known:
                    known[w] = self._whole(" " + w)
            ids = b"".join([known[w] for w in rest])
        return self._whole(first) + ids

    def forget(self) -> None:
        """Drop the known words: a worker outlives its task."""
        self._words.clear()


@lru_cache(maxsize=1)
def encoder(ranks_path: str | None, special: tuple[tuple[str, int], ...] = ()) -> Encoder:
    import public_tokenizers
    return Encoder(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special)


def capacities(total: int, capacity: int) -> list[int]:
    """Sequence lengths that hold ``total`` tokens without padding."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` for documents of the given lengths."""
    caps = capacities(sum(lengths), capacity)
    out, rests, seq = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):  # the longest pieces: one empty sequence each
            out.append((d, start, capacity, seq, 0))
            seq += 1
        if n % capacity:
            rests.append((n % capacity, d, n - n % capacity))
    size = np.array(caps[seq:], dtype=np.int64)
    room, cost = size.copy(), np.zeros(len(size))
    rests.sort(key=lambda x: (-x[0], x[1]))
    for n, d, start in rests:
        while n:
            fits = room >= n
            s = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            part = min(n, int(room[s]))
            out.append((d, start, part, seq + s, int(size[s] - room[s])))
            room[s] -= part
            cost[s] += linear * part + quadratic * part * part
            n, start = n - part, start + part
    return out


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0,
         ranks_path: str | None = None, group_tokens: int = 2_000_000, linear: float = 1.0,
         quadratic: float = 1 / 2048, special: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """One row per piece: its document's id, where it starts in the document and in its sequence.

    ``ids_crc32`` is the CRC-32 of the piece's ids as little-endian uint32; ``doc_tokens`` counts
    the end id. ``sequence_length`` is the whole sequence's number of tokens. ``special``: strings
    that become one id wherever they stand, with their ids (``SPECIAL`` for the JSON vocabulary).
    """
    id_type = docs.schema[id_col].dataType
    end = np.array([end_id], dtype="<u2").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, special)
        base, group, held, used = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = [np.frombuffer(x, dtype="<u2") for _, x in group]
            pieces = np.array(assign([len(x) for x in ids], capacity, linear, quadratic), dtype=np.int64)
            keys, sizes = pa.array([k for k, _ in group], type=arrow_id), np.array([len(x) for x in ids], dtype=np.int64)
            lengths = np.bincount(pieces[:, 3], weights=pieces[:, 2]).astype(np.int64)
            for at in range(0, len(pieces), 4096):
                d, start, length, seq, offset = pieces[at:at + 4096].T
                crc = np.array([zlib.crc32(ids[i][a:a + n].astype("<u4").tobytes()) for i, a, n in zip(d, start, length, strict=True)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(d)), *(pa.array(x) for x in (start, length, crc, sizes[d], base + used + seq, offset, lengths[seq]))],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"])

        for whole in batches:
            arrow_id = whole.schema.field(0).type
            for batch in (whole.slice(i, SLICE_ROWS) for i in range(0, whole.num_rows, SLICE_ROWS)):
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    group.append((key, encode(text or "") + end))
                    held += len(group[-1][1]) // 2
                    if held >= group_tokens:
                        yield from flush()
                        used += len(capacities(held, capacity))
                        group, held = [], 0
        if group:
            yield from flush()
        encode.forget()
        give_back()

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(packed, SCHEMA.format(id=id_type.simpleString())))
