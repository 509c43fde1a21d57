"""Bounded-space online packing of token sequences.

Each partition streams its documents once. Whole windows of a document are emitted as they are; its
rest goes, best-fit, into one of a fixed number of open windows. When none fits and all are taken,
the fullest is closed: its gap is filled by the head of the waiting piece if worth a cut, else left
as padding. When the partition ends its open windows are merged, so at most one stays unfilled. A
second step merges those of neighbouring partitions, a bounded group each.

Defined results: null text is the empty text (one end token); null ids are carried; repeated rows
are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, released, staged

#: The split rule of byte-level BPE vocabularies (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A gap of fewer tokens is padded rather than filled by cutting a document.
LEAST_CUT = 16

_encoders: dict[str, object] = {}


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in such vocabularies: itself, or the next free letter from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Token ids as the `tokenizers` library gives them for a byte-level BPE file.

    The same vocabulary and merges run in tiktoken where the file allows it (ids in merge order, the
    plain byte-level split, no normalizer, no special token's string in the text), else in
    `tokenizers` itself; both give equal ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", [])]
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer") and not spec["model"].get("ignore_merges")
        if plain and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                if len(text) > 200_000:
                    return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
                return np.array(self.fast.encode_ordinary(text), "<u4")
            except BaseException as error:  # its regex gives up on some very long runs, by a panic that is no Exception
                if not isinstance(error, ValueError) and type(error).__name__ != "PanicException":
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Open windows of one stream. Pieces are (doc_id, start, ids, doc_tokens); closed ones pile up as rows."""

    def __init__(self, length: int, slots: int, first: int):
        self.length, self.slots, self.next = length, slots, first
        self.open: list[list] = []  # [free, pieces]
        self.rows: list[tuple] = []

    def close(self, pieces: list, keep_ids: bool = False) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, ids.tobytes() if keep_ids else None))
            at += len(ids)
        self.next += 1

    def document(self, doc_id, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.length * self.length
        for at in range(0, whole, self.length):
            self.close([(doc_id, at, ids[at : at + self.length], total)])
        if whole < total:
            self.place((doc_id, whole, ids[whole:], total))

    def place(self, piece: tuple) -> None:
        doc_id, start, ids, total = piece
        n = len(ids)
        fits = [w for w in self.open if w[0] >= n]
        if fits:
            best = min(fits, key=lambda w: w[0])
            best[1].append(piece)
            best[0] -= n
            if not best[0]:
                self.open.remove(best)
                self.close(best[1])
        elif len(self.open) < self.slots:
            self.open.append([self.length - n, [piece]])
        else:
            fullest = min(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            gap = fullest[0]
            if gap >= LEAST_CUT:
                fullest[1].append((doc_id, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            self.close(fullest[1])
            self.place((doc_id, start, ids, total))

    def merge(self) -> None:
        """Fill the fullest open window from the emptiest until at most one is left open."""
        left = sorted(self.open, key=lambda w: w[0])
        while len(left) > 1:
            full, empty = left[0], left[-1]
            while full[0] and empty[1]:
                doc_id, start, ids, total = empty[1].pop()
                take = min(full[0], len(ids))
                full[1].append((doc_id, start, ids[:take], total))
                full[0] -= take
                empty[0] += take
                if take < len(ids):
                    empty[1].append((doc_id, start + take, ids[take:], total))
            if not full[0]:
                self.close(full[1])
                left.pop(0)
            if not empty[1]:
                left.pop()
        self.open = left

    def flush(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        out = pd.DataFrame(rows, columns=cols)
        out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
        return out


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, slots: int = 48, end_id: int = 0, group: int = 64) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most `length` tokens (see PIECES).

    slots: open windows per partition. group: partitions whose last windows are merged together.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        packer = Packer(length, slots, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], "<u4")
        for batch in blocks(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                packer.document(doc_id, np.concatenate([encode(text or ""), end]))
            yield pa.RecordBatch.from_pandas(packer.flush(), schema=arrow, preserve_index=False)
        packer.merge()
        for _, pieces in packer.open:
            packer.close(pieces, keep_ids=True)
        yield pa.RecordBatch.from_pandas(packer.flush(), schema=arrow, preserve_index=False)

    def last(key, rows: pd.DataFrame) -> pd.DataFrame:
        packer = Packer(length, slots, (1 << 30 | int(key[0])) << 32)
        for _, part in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id", sort=True):
            pieces = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens) for r in part.itertuples()]
            packer.open.append([length - int(part["length"].sum()), pieces])
        packer.merge()
        for _, pieces in packer.open:
            packer.close(pieces)
        return packer.flush().drop(columns="ids")

    arrow = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
    rows = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(stream), PIECES + ", ids binary"), "pack")
    final = rows.filter("ids is null").drop("ids")
    near = F.floor(F.shiftright("sequence_id", 32) / group).alias("near")
    rest = rows.filter("ids is not null").groupBy(near)
    return final.unionByName(rest.applyInPandas(last, PIECES))
