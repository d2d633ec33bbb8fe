"""Filling fixed-capacity containers with whole documents: best-fit decreasing over a segment tree."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom import scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how the public byte-level BPE cuts text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_ITEMS = 100_000
# White space runs that the tokenizer's look-ahead would take one stack frame a character for.
_LONG_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a ranks file, made once in each Python worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a whole text. Very long runs of white space are cut out where the tokenizer itself would cut, and
    counted as the one piece they are, so the number is the tokenizer's own."""
    if not text:
        return 0
    bpe = tokenizer(path)
    n = at = 0
    for m in _LONG_SPACE.finditer(text) if len(text) >= 1000 else ():
        end = m.end() if m.end() == len(text) else m.end() - 1  # the last one belongs to what follows
        n += len(bpe.encode_ordinary(text[at : m.start()])) + len(bpe._core_bpe.encode_single_piece(text[m.start() : end].encode()))
        at = end
    return n + len(bpe.encode_ordinary(text[at:] if at else text))


class OpenBins:
    """A segment tree whose leaf c holds the open bins with c places left; an inner node tells whether any leaf below does."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, bin_: int) -> None:
        self.bins[left].append(bin_)
        at = left + self.size
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room that is still enough, and its room."""
        tree, at = self.any, need + self.size
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at ^ 1]):
                at >>= 1
            if at <= 1:
                return None
            at ^= 1
            while at < self.size:
                at <<= 1
                if not tree[at]:
                    at += 1
        left = at - self.size
        bin_ = self.bins[left].pop()
        if not self.bins[left]:
            tree[at] = 0
            at >>= 1
            while at and not (tree[2 * at] or tree[2 * at + 1]):
                tree[at] = 0
                at >>= 1
        return left, bin_


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item, best fit in decreasing order of size; no size may exceed capacity."""
    out, tree, n = [0] * len(sizes), OpenBins(capacity), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if found := tree.take(sizes[i]):
            left, bin_ = found
        else:
            left, bin_, n = capacity, n, n + 1
        out[i] = bin_
        tree.put(left - sizes[i], bin_)
    return out


def token_sizes(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer_path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) by a public tokenizer, over whole texts."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [count_tokens(x, tokenizer_path) for x in b["text"]]})

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(measure, "doc_id long, n_tokens long")


def _fill(capacity: int, final: bool):
    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows["bin"] = best_fit(rows["size"].tolist(), capacity)
        room = (capacity - rows.groupby("bin")["size"].sum()).sort_values(ascending=False, kind="stable")
        rows["again"] = False if final else rows["bin"].isin(room.index[: max(1, len(room) // 100)])
        return rows[["block", "bin", "doc_id", "piece", "first_token", "size", "again"]]

    return fill


def pack(sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """(container_id, doc_id, piece, first_token, n_tokens) for sizes (doc_id long, n_tokens).

    Every document is whole in one container unless it has more tokens than fit: that one is cut into full containers
    and a rest (piece 0, 1, ...), which is packed like any document. Empty documents and null sizes take no room and go
    where the tightest bin is. Rows are items: a repeated doc_id is packed as often as it comes.

    Best-fit decreasing runs in blocks of about BLOCK_ITEMS items spread by hash; a block wastes a part of its few last
    bins. Those bins, at most the least filled hundredth of each block, are opened again and packed together in the
    next round with a hundredth of the blocks, until one block is left. No task holds more than a block.
    """
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"cast((n - 1) div {capacity} as int)"), F.lit(0)))).alias("piece")
    items = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n")).select("doc_id", "n", cut)
    items = items.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity).alias("size"))
    items = scratch.table(items, "items")
    blocks, level, done = max(1, -(-items.count() // BLOCK_ITEMS)), 0, []
    todo = items
    while True:
        final, fill = blocks == 1, _fill(capacity, blocks == 1)
        placed = todo.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(blocks))).groupBy("block").applyInPandas(fill, "block long, bin long, doc_id long, piece int, first_token long, size long, again boolean")
        placed = scratch.table(placed, "placed")
        done.append(placed.where("not again").select((F.lit(level).cast("long") * (1 << 56) + F.col("block") * (1 << 28) + F.col("bin")).alias("container_id"), "doc_id", "piece", "first_token", F.col("size").alias("n_tokens")))
        if final:
            break
        todo, blocks, level = placed.where("again").select("doc_id", "piece", "first_token", "size"), max(1, -(-blocks // 100)), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(documents: DataFrame, capacity: int = 2048, tokenizer_path: str = TOKENIZER) -> DataFrame:
    return pack(token_sizes(documents, tokenizer_path=tokenizer_path), capacity)


def packed_well(containers: DataFrame, sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """(n_documents, n_tokens, over_capacity, wrongly_cut, lost_tokens, tight), one row: what must hold of pack().

    wrongly_cut counts documents that fit one container and lie in several; tight says that at most a fiftieth more
    containers are used than the tokens need at least, one left over aside.
    """
    bins = containers.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("over_capacity"), F.count(F.lit(1)).alias("bins"))
    docs = containers.groupBy("doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces"))
    want = sizes.groupBy("doc_id").agg(F.sum(F.coalesce("n_tokens", F.lit(0))).alias("n"), F.count(F.lit(1)).alias("rows"))
    both = want.join(docs, "doc_id", "full")
    whole = both.agg(
        F.count("rows").alias("n_documents"), F.sum("n").alias("n_tokens"), F.count_if((F.col("n") <= capacity) & (F.col("pieces") > F.col("rows"))).alias("wrongly_cut"),
        F.sum(F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("got", F.lit(0)))).alias("lost_tokens"),
    )
    return whole.join(bins).select("n_documents", "n_tokens", "over_capacity", "wrongly_cut", "lost_tokens", (F.col("bins") <= F.ceil(F.col("n_tokens") / capacity) * 1.02 + 1).alias("tight"))
