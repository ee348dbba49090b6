"""Vocabularies: loading, validation, and the index that tokenizers use."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token ids are stored as unsigned 16-bit numbers; this is also the bound on what reaches the driver.
MOST_PIECES = 65_536

# Words that make a piece structural.
STRUCTURE_WORDS = [
    "Chapter", "Section", "Volume", "Act", "Scene", "Article", "Part", "Book", "Page", "Terms", "Conditions", "Summary", "Introduction",
    "Appendix", "Table", "Figure", "Transcript", "Episode", "NEWS", "THE", "Text",
]


def is_byte_piece(piece: Column) -> Column:
    return piece.rlike("^<0x[0-9A-Fa-f]{2}>$")


def collected(vocab: DataFrame) -> list[tuple[int, str]]:
    """(id, piece) in order of id; refuses more pieces than ids can number."""
    rows = vocab.select("id", "piece").orderBy("id").limit(MOST_PIECES + 1).collect()
    if len(rows) > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces")
    return [(r.id, r.piece) for r in rows]


def validated(vocab: DataFrame) -> DataFrame:
    """vocab, which fails on reading unless ids run from 0 without gaps and all 256 byte pieces are there."""
    bytes_ = F.count_distinct(F.when(is_byte_piece(F.col("piece")), F.upper("piece")))
    facts = vocab.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"), bytes_.alias("bytes"))
    why = F.when((F.col("ids") != F.col("n")) | (F.col("low") != 0) | (F.col("high") + 1 != F.col("n")), "vocabulary ids are not 0..N-1").when(F.col("bytes") != 256, "vocabulary lacks byte pieces")
    checked = facts.select(F.when(why.isNotNull(), F.raise_error(why)).otherwise(F.lit(True)).alias("__ok"))
    return vocab.join(F.broadcast(checked)).where("__ok").drop("__ok")


@dataclass(frozen=True)
class Index:
    """What a tokenizer needs: literal pieces by text, byte pieces by value, and piece lengths by first character."""

    ids: dict[str, int]
    byte_ids: tuple[int, ...]
    lengths: dict[str, tuple[int, ...]] = field(repr=False)
    inner: frozenset[str] = field(repr=False)

    @staticmethod
    def of(pieces: list[tuple[int, str]]) -> Index:
        ids: dict[str, int] = {}
        byte_ids = [-1] * 256
        for token, piece in pieces:
            if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
                byte_ids[int(piece[3:5], 16)] = token
            elif piece and piece not in ids:
                ids[piece] = token
        if -1 in byte_ids:
            raise ValueError("vocabulary lacks byte pieces")
        by_first: dict[str, set[int]] = {}
        for piece in ids:
            by_first.setdefault(piece[0], set()).add(len(piece))
        inner = frozenset(piece[k : k + 2] for piece in ids for k in range(len(piece) - 1))
        return Index(ids, tuple(byte_ids), {c: tuple(sorted(n, reverse=True)) for c, n in by_first.items()}, inner)


def longest_match_pattern(pieces: list[str]) -> str:
    """A Java pattern that matches the longest piece at a place, else one character: a trie, written as nested groups."""
    root: dict = {}
    for piece in pieces:
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = {}

    def quoted(c: str) -> str:
        return c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}"

    def walk(node: dict) -> str:
        branches = [quoted(c) + walk(child) for c, child in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "|".join(branches)
        return f"(?:{body})?" if "" in node else f"(?:{body})"

    whole = walk(root)
    return f"(?s){whole}|." if whole else "(?s)."


def piece_bytes(piece: Column) -> Column:
    """UTF-8 bytes that a piece stands for."""
    return F.when(is_byte_piece(piece), F.lit(1)).otherwise(F.octet_length(piece))


def token_classes(vocab: DataFrame) -> DataFrame:
    """id, piece, and the exclusive-byte, space-led, phrase and structural flags of a piece."""
    p, byte = F.col("piece"), is_byte_piece(F.col("piece"))
    return vocab.select(
        "id",
        "piece",
        byte.alias("is_byte"),
        (~byte & p.startswith(" ")).alias("is_space_led"),
        (~byte & F.trim(p).contains(" ")).alias("is_phrase"),
        (~byte & (p.contains("\n") | F.arrays_overlap(F.regexp_extract_all(p, F.lit(r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*"), F.lit(0)), F.array(*map(F.lit, STRUCTURE_WORDS))))).alias("is_structural"),
    )


def byte_lookup(vocab: DataFrame) -> DataFrame:
    """id, base_bytes (without a leading space), has_leading_space, is_boundary (never, for a known piece)."""
    p, byte = F.col("piece"), is_byte_piece(F.col("piece"))
    led = ~byte & p.startswith(" ")
    return vocab.select("id", F.when(byte, 1).otherwise(F.octet_length(F.when(led, F.substring(p, 2, 1_000_000)).otherwise(p))).alias("base_bytes"), led.alias("has_leading_space"), F.lit(False).alias("is_boundary"))
