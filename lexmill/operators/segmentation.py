"""Optimal segmentation of texts into pieces, with bytes where no piece serves.

A cut lies between two characters that stand next to each other in no piece. No piece crosses a
cut, so a text falls into stretches that are segmented on their own; common stretches are
segmented once and remembered. The only thing that passes a cut is whether the next stretch begins
with bytes. Costs of a stretch are packed into one integer each, so that comparing two
segmentations compares two integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.cluster import keep
from lexmill.operators.vocabulary import Index, collected

MODES = ("boundary", "min_tokens", "greedy", "pieces_first")
#: Stretches remembered per Python worker.
REMEMBERED = 200_000
#: Bits of a packed cost, from the lowest: penalty, runs, fallback tokens, tokens.
_BITS = 40
_RUN, _FALLBACK, _TOKEN = 1 << _BITS, 1 << 2 * _BITS, 1 << 3 * _BITS
_MASK = _RUN - 1

#: What a character costs when it falls back to bytes.
PENALTIES = {"\n": 4, "\t": 3, " ": 3, **dict.fromkeys(".,!?;:()[]{}\"'", 2)}


def penalty(c: str) -> int:
    return PENALTIES.get(c, 2 if c.isspace() else 0)


def _solve(index: Index, part: str, bytes_follow: bool, mode: str) -> tuple[tuple[int, ...], int, bool]:
    """Ids, packed cost, and whether the stretch begins with bytes. Costs count from the stretch's end."""
    n, ids, lengths = len(part), index.ids, index.lengths
    cost, step, by_bytes = [0] * (n + 1), [0] * n, [False] * n + [bytes_follow]
    for i in range(n - 1, -1, -1):
        best, size = -1, 0
        for k in lengths.get(part[i], ()):  # longest first: on equal cost the longest stays
            if i + k <= n and part[i : i + k] in ids:
                c = cost[i + k] + _TOKEN
                if best < 0 or c < best:
                    best, size = c, k
        if best < 0 or mode != "pieces_first":
            width = len(part[i].encode())
            if mode == "boundary":
                c = cost[i + 1] + width * (_TOKEN + _FALLBACK) + (0 if by_bytes[i + 1] else _RUN) + penalty(part[i])
            else:
                c = cost[i + 1] + width * _TOKEN
            # a one-character piece costs a boundary segmentation less, as bytes also cost a fallback
            if best < 0 or c < best:
                best, size, by_bytes[i] = c, 0, True
        cost[i], step[i] = best, size
    out: list[int] = []
    i = 0
    while i < n:
        if step[i]:
            out.append(ids[part[i : i + step[i]]])
            i += step[i]
        else:
            out.extend(index.byte_ids[b] for b in part[i].encode())
            i += 1
    return tuple(out), cost[0], by_bytes[0]


def _greedy(index: Index, part: str) -> tuple[int, ...]:
    out: list[int] = []
    i = 0
    while i < len(part):
        for k in index.lengths.get(part[i], ()):
            token = index.ids.get(part[i : i + k])
            if token is not None and len(part) - i >= k:
                out.append(token)
                i += k
                break
        else:
            out.extend(index.byte_ids[b] for b in part[i].encode())
            i += 1
    return tuple(out)


class Segmenter:
    """Texts to ids, with counts of fallback tokens and runs and the penalty of fallback characters."""

    def __init__(self, pieces: list[tuple[int, str]], mode: str = "boundary"):
        if mode not in MODES:
            raise ValueError(f"mode: one of {MODES}")
        self.index, self.mode = Index.of(pieces), mode
        self.bytes = frozenset(self.index.byte_ids)
        self._part = lru_cache(REMEMBERED)(lambda part, follow: _solve(self.index, part, follow, mode))
        self._greedy = lru_cache(REMEMBERED)(lambda part: _greedy(self.index, part))

    def _stretches(self, text: str) -> list[str]:
        inner, out, start = self.index.inner, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in inner:
                out.append(text[start:i])
                start = i
        out.append(text[start:])
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        parts = self._stretches(text)
        if self.mode == "greedy":
            return [t for part in parts for t in self._greedy(part)]
        solved, follow = [], False
        for part in reversed(parts):
            ids, _, follow = self._part(part, follow)
            solved.append(ids)
        return [t for ids in reversed(solved) for t in ids]

    def counts(self, ids: list[int]) -> tuple[int, int, int]:
        """(tokens, fallback tokens, runs of fallback tokens)."""
        fallback = runs = 0
        before = False
        for t in ids:
            now = t in self.bytes
            fallback += now
            runs += now and not before
            before = now
        return len(ids), fallback, runs

    def packed(self, text: str) -> tuple[int, int, int, int]:
        """(tokens, fallback tokens, runs, penalty) as the segmentation itself counts them."""
        total, follow = 0, False
        for part in reversed(self._stretches(text)) if text else ():
            _, c, follow = self._part(part, follow)
            total += c
        return total >> 3 * _BITS, total >> 2 * _BITS & _MASK, total >> _BITS & _MASK, total & _MASK

    def decode(self, ids: list[int]) -> str:
        pieces = {t: p.encode() for p, t in self.index.ids.items()} | {t: bytes([b]) for b, t in enumerate(self.index.byte_ids)}
        return b"".join(pieces[t] for t in ids).decode("utf-8", errors="replace")


def encoded(docs: DataFrame, vocab: DataFrame, mode: str = "boundary", ids: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, fallback_tokens, fallback_runs (and ids) of every text; null counts as empty.

    The result is not kept: put filters on docs, before this. The vocabulary is at most 65,536 pieces.
    """
    pieces = collected(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(pieces, mode)
        for b in batches:
            made = [segmenter.encode(t) for t in b.column(1).to_pylist()]
            counts = [segmenter.counts(x) for x in made]
            sizes = [len((t or "").encode()) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array(sizes, pa.int64()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))]
            names = ["doc_id", "n_bytes", "n_tokens", "fallback_tokens", "fallback_runs"]
            if ids:
                columns.append(pa.array(made, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, fallback_tokens bigint, fallback_runs bigint" + (", ids array<int>" if ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def compared(docs: DataFrame, vocab: DataFrame, baseline: str = "greedy", custom: str = "boundary") -> DataFrame:
    """Per document the token counts of two segmentations (kept, so that reports read it more than once)."""
    pieces = collected(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Segmenter(pieces, baseline), Segmenter(pieces, custom)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, fallback, runs = b.counts(b.encode(text))
                rows.append((doc, len((text or "").encode()), len(a.encode(text)), n, fallback, runs))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "n_bytes", "base_tokens", "custom_tokens", "fallback_tokens", "fallback_runs"])

    schema = "doc_id bigint, n_bytes bigint, base_tokens bigint, custom_tokens bigint, fallback_tokens bigint, fallback_runs bigint"
    return keep(docs.select("doc_id", "text").mapInArrow(run, schema), "compared")
