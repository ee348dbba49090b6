"""Looking into segmentations: totals by mode, decomposition of pieces, differences, gains and losses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.segmentation import MODES, Segmenter
from lexmill.operators.vocabulary import collected


def mode_totals(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per mode: documents, tokens, fallback tokens and runs, documents that decode to their text."""
    pieces = collected(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {m: Segmenter(pieces, m) for m in MODES}
        sums = {m: [0] * 5 for m in MODES}
        for b in batches:
            for text in b.column(0).to_pylist():
                for m, s in made.items():
                    ids = s.encode(text)
                    for k, v in enumerate((1, *s.counts(ids), int(s.decode(ids) == (text or "")))):
                        sums[m][k] += v
        columns = list(zip(*([m, *v] for m, v in sums.items())))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *(pa.array(c, pa.int64()) for c in columns[1:])], ["mode", "docs", "tokens", "fallback_tokens", "fallback_runs", "restored"])

    schema = "mode string, docs bigint, tokens bigint, fallback_tokens bigint, fallback_runs bigint, restored bigint"
    parts = docs.select("text").mapInArrow(run, schema)
    return parts.groupBy("mode").agg(*(F.sum(c).alias(c) for c in ("docs", "tokens", "fallback_tokens", "fallback_runs", "restored")))


def decomposed(vocab: DataFrame, others: DataFrame | None = None, most: int = 8) -> DataFrame:
    """id, piece, parts: each piece written with the other pieces (longest first), bytes last; null if it takes more than most."""
    pieces = collected(vocab)
    rest = collected(others) if others is not None else pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Segmenter(rest, "greedy")
        names = dict(rest)
        for b in batches:
            out = []
            for piece in b.column(1).to_pylist():
                if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
                    out.append([piece])
                    continue
                own = s.index.ids.pop(piece, None)
                s._greedy.cache_clear()
                ids = s.encode(piece)
                if own is not None:
                    s.index.ids[piece] = own
                out.append([names[t] for t in ids] if len(ids) <= most else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], ["id", "piece", "parts"])

    return vocab.where("piece is not null").select("id", "piece").mapInArrow(run, "id int, piece string, parts array<string>")


def differing_blocks(x: list[bytes], y: list[bytes]) -> list[tuple[list[bytes], list[bytes]]]:
    """Stretches between common boundaries in which two segmentations of the same bytes differ, in one pass."""
    out, i, k, at_x, at_y, left, right = [], 0, 0, 0, 0, [], []
    while i < len(x) or k < len(y):
        if at_x <= at_y and i < len(x):
            left.append(x[i])
            at_x += len(x[i])
            i += 1
        else:
            right.append(y[k])
            at_y += len(y[k])
            k += 1
        if at_x == at_y:
            if left != right:
                out.append((left, right))
            left, right = [], []
    return out


def differences(docs: DataFrame, vocab: DataFrame, a: str = "greedy", b: str = "boundary", most: int = 8) -> DataFrame:
    """doc_id, n_blocks and the first blocks in which two segmentations of a document differ."""
    pieces = collected(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Segmenter(pieces, a), Segmenter(pieces, b)
        names = {t: bytes([int(p[3:5], 16)]) if t in one.bytes else p.encode() for t, p in pieces}
        kind = pa.struct([("left", pa.string()), ("right", pa.string())])

        def shown(parts: list[bytes]) -> str:
            return "|".join(p.decode("utf-8", errors="backslashreplace") for p in parts)

        for batch in batches:
            ids, n, blocks = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = differing_blocks(*([names[t] for t in s.encode(text)] for s in (one, two)))
                if found:
                    ids.append(doc)
                    n.append(len(found))
                    blocks.append([{"left": shown(x), "right": shown(y)} for x, y in found[:most]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(blocks, pa.list_(kind))], ["doc_id", "n_blocks", "blocks"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_blocks int, blocks array<struct<left:string,right:string>>")


def gains_and_losses(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per piece: how often it is used more (gained) or less (lost) by b than by a, document by document."""
    x, y = (t.groupBy("doc_id", "piece").agg(F.count("*").alias(n)) for t, n in ((a, "n_a"), (b, "n_b")))
    both = x.join(y, ["doc_id", "piece"], "full").select("piece", (F.coalesce("n_b", F.lit(0)) - F.coalesce("n_a", F.lit(0))).alias("more"))
    return both.groupBy("piece").agg(F.sum(F.greatest("more", F.lit(0))).alias("gained"), F.sum(F.greatest(-F.col("more"), F.lit(0))).alias("lost")).where("gained > 0 or lost > 0")


def vocabulary_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids whose piece is another one; fails on reading where the sets of ids differ."""
    both = old.select("id", F.col("piece").alias("old_piece")).join(new.select("id", F.col("piece").alias("new_piece")), "id", "full")
    lost = F.raise_error(F.concat(F.lit("only one vocabulary has id "), F.col("id").cast("string"))).cast("boolean")
    return both.where(F.when(F.col("old_piece").isNull() | F.col("new_piece").isNull(), lost).otherwise(F.col("old_piece") != F.col("new_piece")))
