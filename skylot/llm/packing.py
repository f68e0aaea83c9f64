"""Hierarchical multi-length packing of tokenized documents into fixed windows.

Documents are tokenized where they are read, in Arrow batches, and cut only where they exceed a
window: what goes on is a narrow row a piece (document, start, length, checksum). Equal pieces are counted,
before the shuffle too, and go on as rows of at most COPIES of them, so that repeated rows spread like others.
Pieces are dealt to blocks by a hash; in a block each is routed to the smallest context size (tier) that holds it.
From the longest tier down, each tier's longest piece opens a context of the tier's own size, and the
gap is filled with the longest pieces that still fit, from that tier and the shorter ones. A context is
padded once, by a gap that no piece left in the block fits into. Contexts are laid side by side in windows of
4096, without gaps as their sizes are powers of two; attention stays within a context. Last, windows are
dealt in turn, by the attention that their contexts cost, to groups of steps, so that the groups cost alike.

Cases: a null text is empty, and an empty one still has its end token; pieces of repeated rows are
packed one by one, in as many blocks as their number asks for; very long documents are cut into full windows and a rest; an empty table gives an
empty one; further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylot.llm.common import staged

WINDOW, TIERS, END = 4096, (256, 512, 1024, 2048, 4096), 2
BLOCK, STEPS = 4096, 8
#: Equal pieces that a row stands for at most: a small part of a block.
COPIES = 256
#: Words that a Python worker keeps at most, but for one batch; then it starts anew.
CACHE = 800_000
#: Rows tokenized at once.
ROWS = 256

#: Letters and digits of Latin-1, and the tokenizer's split into words (fixed values).
_L, _N = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s\x00{_L}{_N}]+"
#: Bytes of Latin-1 texts that the fast way leaves to the tokenizer: controls and odd white space.
_ODD = bytes([*range(0x09), *range(0x0E, 0x20), *range(0x7F, 0xA1)])


class WordTokenizer:
    """Ids of texts under a lower-casing word BPE whose words end in </w>. It treats words apart, so the
    ids of what stands between white space are kept. New words go through a byte BPE with the same
    merges, a zero byte standing for </w>; texts beyond Latin-1, with control characters or with a
    special token go through the tokenizer whole."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # how byte-level BPE writes bytes
        shown = dict(zip([*shown, *(b for b in range(256) if b not in shown)], [*map(chr, shown), *map(chr, range(256, 512))], strict=False))
        byte = {c: b for b, c in shown.items()}
        end = model["end_of_word_suffix"]
        ranks, self.final = {}, np.zeros(max(model["vocab"].values()) + 2, bool)
        for token, i in model["vocab"].items():
            if token in self.special:
                continue
            last = token.endswith(end)
            raw = bytes(byte[c] for c in (token[:-len(end)] if last else token))
            ranks[raw + b"\x00" * last] = i
            self.final[i] = last
        ranks[b"\x00"] = len(self.final) - 1  # never left over: each byte merges with its end first
        self.bpe = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.pieces = re.compile(_WORDS)
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.n = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        """Ids of what stands between white space, at the places after those known."""
        split = [self.pieces.findall(w) for w in words]
        flat = np.array(self.bpe.encode_ordinary("".join(x + "\x00" for p in split for x in p)), np.uint32)
        piece_ends = np.flatnonzero(self.final[flat]) + 1
        ends = piece_ends[np.cumsum([len(p) for p in split]) - 1]
        used = int(self.starts[self.n])
        if used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.empty(used + 2 * len(flat), np.uint32)])
        if self.n + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts[:self.n + 1], np.empty(self.n + 2 * len(words) + 1, np.int64)])
        self.ids[used:used + len(flat)] = flat
        self.starts[self.n + 1:self.n + 1 + len(words)] = used + ends
        self.number.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        self.n += len(words)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain, words, counts = [], [], []
        for text in texts:
            try:
                raw = text.encode("latin-1")
                fast = len(raw.translate(None, _ODD)) == len(raw) and not any(s in text for s in self.special)
            except UnicodeEncodeError:
                fast = False
            plain.append(fast)
            if fast:
                own = text.lower().split()
                words += own
                counts.append(len(own))
        if self.n > CACHE:
            self.number.clear()
            self.n = 0
        if missing := [w for w in dict.fromkeys(words) if w not in self.number]:
            self._learn(missing)
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        first, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(first - ends + size, size) + np.arange(int(size.sum()))]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(int)]
        found = iter(ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        return [next(found) if fast else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                for text, fast in zip(texts, plain, strict=True)]


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One a Python worker: its words serve all the worker's tasks."""
    return WordTokenizer(path)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """(doc_id, text) -> PIECE: each document's ids and its end token, cut every `window` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer_path)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows = []
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at:at + window]
                    rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            names = [f.split()[0] for f in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE)


def contexts(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[int]]]:
    """(size, places in lengths) of each context, long contexts first: the hierarchical packing of one block."""
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable")[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    there = sorted(stacks)

    def pop(k: int) -> int:
        size = there[k]
        i = stacks[size].pop()
        if not stacks[size]:
            del there[k]
        return i

    found = []
    for low, size in zip((0, *tiers[:-1])[::-1], tiers[::-1], strict=True):
        while there and there[-1] > low:
            gap = size - there[-1]
            found.append((size, [pop(len(there) - 1)]))
            while there and (k := bisect.bisect_right(there, gap) - 1) >= 0:
                gap -= there[k]
                found[-1][1].append(pop(k))
    return found


def tiled(sizes: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window, start in it) of contexts laid side by side. Sizes that fall by powers of two leave no gap."""
    found, number, at = [], 0, 0
    for size in sizes:
        if at + size > window:
            number, at = number + 1, 0
        found.append((number, at))
        at += size
    return found


def side_by_side(found: list[tuple[int, list[int]]], window: int = WINDOW) -> list[list[int]]:
    """Contexts -> windows as lists of places."""
    windows: dict[int, list[int]] = {}
    for (number, _), (_, places) in zip(tiled([size for size, _ in found], window), found, strict=True):
        windows.setdefault(number, []).extend(places)
    return list(windows.values())


def fill(lengths: np.ndarray, window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> list[list[int]]:
    """Windows as lists of places in lengths."""
    return side_by_side(contexts(lengths, tiers), window)


def dealt(found: DataFrame) -> DataFrame:
    """PIECE -> PIECE, copies, block, blocks: equal pieces as rows of at most COPIES, dealt by a hash to blocks of about
    BLOCK pieces, whatever the partitioning."""
    blocks = max(1, math.ceil(found.count() / BLOCK))
    names = [f.split()[0] for f in PIECE.split(", ")]
    parts = found.groupBy(names).agg(F.count(F.lit(1)).alias("n")).select(
        *names, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("part"))
    return parts.select(*names, F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES).cast("int").alias("copies"),
                        F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "part"), F.lit(blocks)).alias("block"), F.lit(blocks).cast("long").alias("blocks"))


PACKED = PIECE + ", sequence_id long, offset long, tier int, step_group long, context int, context_start int, context_offset int"


def packed(found: DataFrame, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, steps: int = STEPS) -> DataFrame:
    """PIECE -> PACKED. tier: the context size that the piece was routed to; context: the size of the one
    that it was packed into, which is longer where it fills a gap. A piece stands in its window at
    context_start + context_offset; offset counts the ids before it in the window without padding.
    step_group: windows to be trained side by side; in a block every group of `steps` windows gets
    windows of long and of short contexts alike. The nth window of block b of B has the id n * B + b."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        block, blocks = int(rows["block"].iloc[0]), int(rows["blocks"].iloc[0])
        rows = rows.loc[rows.index.repeat(rows["copies"])].sort_values(["doc_id", "start", "ids_crc32"], ignore_index=True)
        lengths = rows["length"].to_numpy()
        found = contexts(lengths, tiers)
        sizes = np.array([size for size, _ in found])
        in_window, context_start = np.array(tiled(sizes.tolist(), window)).T
        windows = side_by_side(found, window)
        attention = np.bincount(in_window, sizes.astype(float) ** 2)  # each context attends to itself
        used = np.array([lengths[w].sum() for w in windows])
        groups = math.ceil(len(windows) / steps)
        turn = np.empty(len(windows), np.int64)
        turn[np.lexsort((-used, -attention))] = np.arange(len(windows))
        lap, place = np.divmod(turn, groups)
        group = np.where(lap % 2 == 0, place, groups - 1 - place)  # to and fro
        order = np.array([i for w in windows for i in w])
        size = np.array([len(w) for w in windows])
        number = np.repeat(np.arange(len(windows)), size)
        ends = np.cumsum(lengths[order])
        offset = ends - lengths[order] - np.repeat(np.concatenate([[0], np.cumsum(used)[:-1]]), size)
        out = rows.iloc[order].copy()
        out["sequence_id"], out["offset"] = number * blocks + block, offset
        out["tier"] = np.array(tiers, np.int32)[np.searchsorted(tiers, lengths[order])]
        out["step_group"] = group[number] * blocks + block
        of = np.repeat(np.arange(len(found)), [len(places) for _, places in found])
        full = np.array([lengths[places].sum() for _, places in found])
        out["context"], out["context_start"] = sizes[of].astype(np.int32), context_start[of].astype(np.int32)
        out["context_offset"] = (ends - lengths[order] - (np.cumsum(full) - full)[of]).astype(np.int32)
        return out.drop(columns=["copies", "block", "blocks"])

    return dealt(found).groupBy("block").applyInPandas(pack, PACKED)


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) -> PACKED."""
    return packed(staged(pieces(docs, tokenizer_path), "pieces"))
