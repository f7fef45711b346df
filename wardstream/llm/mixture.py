"""A mixture of token blocks in which every source holds its target share.

1. Documents are tokenised where they lie and packed, source by source, into blocks of ``block_tokens``
   tokens (a document may span blocks). What is left over at the end of a partition is packed again with
   its neighbours' leftovers, so only the very last blocks are shorter. The blocks are written once to the
   shared checkpoint folder, as counts are needed before the draw.
2. Each source gets a quota of slots: its target share of the corpus size in tokens, at most
   ``max_repeats`` times its own blocks. What a capped source cannot fill goes to the others in proportion
   to their targets, so the mixture is as large as the corpus as long as the caps allow it.
3. Which source a slot belongs to is drawn in tasks: the slots of all shards are mapped through one keyed
   pseudorandom permutation, and a source owns as many consecutive places of its image as its quota. The
   counts of a shard by source are thus a multinomial draw conditioned on the quotas, at any size, without
   a table of shards on the driver; totals are exact, shards vary.
4. A slot's number within its source is mapped through a pseudorandom permutation of the source's block
   indices (a keyed Feistel network with cycle walking; a new key for every pass), so a block is used once
   per pass and at most ``max_repeats`` times in all. Slots then meet their blocks by an equi-join on the
   index: keys are unique on the block side, so no source is a hot key.

:func:`plan` does the work that mixture and report share, so documents are tokenised once for both; the
blocks stay in the shared folder until :func:`wardstream.runtime.release` deletes them.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardstream.runtime import bounded_rows, stored

BLOCK_TOKENS = 256
SHARD_BLOCKS = 1024
TAILS_PER_GROUP = 4096
MAX_SOURCES = 10_000
#: Slots that one task draws.
SLOTS_PER_TASK = 1_000_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict = {}


def encoder(path: str, content: bytes | None = None):
    """The tokenizer of a vocabulary file, loaded once per Python worker; workers are sent the ``content``, as only the driver needs to have the file."""
    if path not in _ENCODERS:
        import tiktoken

        if content is None:
            with open(path, "rb") as f:
                content = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _ENCODERS[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


_BLOCK = pa.schema([("part", pa.int64()), ("source", pa.string()), ("seq", pa.int64()), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32()))])
_BLOCK_SQL = "part long, source string, seq long, n_tokens int, tokens array<int>, doc_ids array<long>, doc_tokens array<int>"


class Packer:
    """Cuts one source's stream of documents into blocks."""

    def __init__(self, size: int) -> None:
        self.size, self.seq = size, 0
        self.tokens: list[np.ndarray] = []
        self.docs: list[int] = []

    def add(self, doc: int, tokens: np.ndarray) -> None:
        if len(tokens):
            self.tokens.append(tokens)
            self.docs.append(doc)

    def take(self, part: int, source: str, rest: bool = False) -> pa.RecordBatch | None:
        """The full blocks so far, and with ``rest`` the last, shorter one."""
        lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        total = int(lengths.sum())
        n = -(-total // self.size) if rest else total // self.size
        if not n:
            return None
        flat = np.concatenate(self.tokens).astype(np.int32)
        ends = np.cumsum(lengths)
        cuts = np.minimum(np.arange(n + 1) * self.size, total)
        # Pieces: documents cut at block borders.
        borders = np.unique(np.concatenate([cuts, ends[ends < cuts[-1]]]))
        piece = np.diff(borders)
        doc = np.array(self.docs, dtype=np.int64)[np.searchsorted(ends, borders[:-1], side="right")]
        at = np.searchsorted(borders, cuts).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat[: cuts[-1]]))
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part)), pa.array([source] * n, pa.string()), pa.array(np.arange(self.seq, self.seq + n)), pa.array(np.diff(cuts).astype(np.int32)), tokens,
             pa.ListArray.from_arrays(pa.array(at), pa.array(doc)), pa.ListArray.from_arrays(pa.array(at), pa.array(piece.astype(np.int32)))],
            schema=_BLOCK,
        )
        self.seq += n
        k = int(np.searchsorted(ends, cuts[-1], side="right"))
        left = self.tokens[k:]
        if left:
            before = int(ends[k - 1]) if k else 0
            left[0] = left[0][int(cuts[-1]) - before :]
        self.tokens, self.docs = left, self.docs[k:]
        return batch


def pack(documents: DataFrame, sources: list[str], block_tokens: int = BLOCK_TOKENS, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token blocks per source: ``part, source, seq, n_tokens, tokens, doc_ids, doc_tokens``; (part, seq) is unique within a source.

    ``source`` is compared trimmed and in lower case. Documents of other sources (null too) come out as one
    row per partition with a null source, no tokens and their number of tokens, as they count for the
    corpus size. Null and empty texts have no tokens. ``doc_ids`` and ``doc_tokens`` tell which documents a
    block holds and how many tokens of each. Result is a table in the shared checkpoint folder.
    """
    spark = documents.sparkSession
    wanted = set(sources)
    with open(tokenizer, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary file
    d = documents.select("doc_id", F.lower(F.btrim("source", F.lit(" \t"))).alias("source"), "text").where("text is not null and text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, content.value), TaskContext.get().partitionId()
        open_, other = {}, 0
        for b in batches:
            for doc, src, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids = enc.encode_ordinary(text)
                if src in wanted:
                    open_.setdefault(src, Packer(block_tokens)).add(doc, np.array(ids, dtype=np.int32))
                else:
                    other += len(ids)
            yield from (r for s, p in open_.items() if (r := p.take(part, s)) is not None)
        yield from (r for s, p in open_.items() if (r := p.take(part, s, rest=True)) is not None)
        if other:
            yield pa.RecordBatch.from_pylist([{"part": part, "source": None, "seq": 0, "n_tokens": None, "tokens": [], "doc_ids": [other], "doc_tokens": []}], schema=_BLOCK)

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = Packer(block_tokens)
        for r in pdf.sort_values(["part", "seq"]).itertuples():
            at = 0
            for doc, n in zip(r.doc_ids, r.doc_tokens):
                p.add(doc, np.asarray(r.tokens[at : at + n], dtype=np.int32))
                at += n
        got = p.take(-1 - int(key[1]), key[0], rest=True)  # negative part: packed from leftovers
        return got.to_pandas()

    cut = stored(d.mapInArrow(run, _BLOCK_SQL), "blocks")
    short = (F.col("n_tokens") < block_tokens) & F.col("source").isNotNull()
    tails = cut.where(short).groupBy("source", F.floor(F.col("part") / TAILS_PER_GROUP).alias("__g")).applyInPandas(again, _BLOCK_SQL)
    return cut.where(~F.coalesce(short, F.lit(False))).unionByName(stored(tails, "tails"))


def quotas(sizes: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], corpus: int) -> dict[str, int]:
    """Slots per source. ``sizes``: blocks and tokens per source; ``targets``: share and most repeats; ``corpus``: tokens in all.

    Repeats below 1 and sources without blocks give 0. Shares are taken relative to their sum.
    """
    cap = {s: max(0, r) * sizes.get(s, (0, 0))[1] for s, (_, r) in targets.items()}
    want: dict[str, float] = {}
    left, free = float(corpus), {s for s, (t, _) in targets.items() if t > 0}
    while free:
        share = sum(targets[s][0] for s in free)
        full = {s for s in free if targets[s][0] / share * left > cap[s]}
        if not full:
            want |= {s: targets[s][0] / share * left for s in free}
            break
        want |= {s: float(cap[s]) for s in full}
        left -= sum(cap[s] for s in full)
        free -= full
    out = {}
    for s in targets:
        blocks, tokens = sizes.get(s, (0, 0))
        out[s] = min(max(0, targets[s][1]) * blocks, round(want.get(s, 0.0) * blocks / tokens)) if tokens else 0
    return out


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutations of [0, n): four Feistel rounds over the next even power of two, walked back into range."""
    half = np.maximum(1, -(-np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) // 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    key, n = key.astype(np.int64).view(np.uint64), n.astype(np.uint64)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        a, b = out[todo] >> h, out[todo] & m
        for r in range(4):
            with np.errstate(over="ignore"):
                z = (b + k + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
                z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            a, b = b, a ^ ((z ^ (z >> np.uint64(32))) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def round_keys(seed: int, source: np.ndarray, round_: np.ndarray) -> np.ndarray:
    """A 64-bit key for every pass over every source."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed % 2**64) + source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + round_.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
        for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):  # Fixed values: a published 64-bit finaliser
            z = (z ^ (z >> np.uint64(31))) * np.uint64(k)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def draw(g: np.ndarray, quota: np.ndarray, blocks: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Source number, slot within the source and block index of the slots ``g`` of the mixture."""
    ends = np.cumsum(quota)
    n = np.full(len(g), ends[-1])
    place = permute(g, n, np.full(len(g), round_keys(seed, np.array([len(quota)]), np.array([-1]))[0]))
    src = np.searchsorted(ends, place, side="right")
    slot = place - (ends - quota)[src]
    round_, i = np.divmod(slot, blocks[src])
    return src, slot, permute(i, blocks[src], round_keys(seed, src, round_))


def plan_slots(blocks: DataFrame, targets: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Slots ``shard, source, slot, part, seq, n_tokens``, and the table of sources with their quotas."""
    spark = blocks.sparkSession
    rows = bounded_rows(targets, MAX_SOURCES, "mix_targets")
    want: dict[str, tuple[float, int]] = {}
    for r in rows:  # equal names after trimming and lower-casing add their shares and keep the smaller cap
        s = (r.source or "").strip(" \t").lower()
        if s:
            old = want.get(s)
            want[s] = ((old[0] if old else 0.0) + float(r.target_share or 0), min(old[1], int(r.max_repeats or 0)) if old else int(r.max_repeats or 0))
    light = blocks.select("part", "source", "seq", "n_tokens", F.when(F.col("source").isNull(), F.get("doc_ids", F.lit(0))).alias("__other"))
    agg = light.groupBy("source").agg(F.count("n_tokens").alias("b"), F.sum("n_tokens").alias("t"), F.sum("__other").alias("o")).collect()  # one row per source of targets
    sizes = {r.source: (r.b, r.t) for r in agg if r.source is not None}
    corpus = sum(t for _, t in sizes.values()) + sum(r.o or 0 for r in agg)
    quota = quotas(sizes, want, corpus)
    summary = spark.createDataFrame(
        [(s, want[s][0], want[s][1], *map(int, sizes.get(s, (0, 0))), quota[s], corpus) for s in sorted(want)],
        "source string, target_share double, max_repeats int, source_blocks long, source_tokens long, slots long, corpus_tokens long",
    )
    names = sorted(s for s, n in quota.items() if n)
    total = sum(quota.values())
    if not total:
        return spark.createDataFrame([], "shard long, source string, slot long, part long, seq long, n_tokens int"), summary
    q, b = np.array([quota[s] for s in names], dtype=np.int64), np.array([sizes[s][0] for s in names], dtype=np.int64)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(0).to_numpy()
            if len(g):
                src, slot, ix = draw(g, q, b, seed)
                name = pa.DictionaryArray.from_arrays(pa.array(src.astype(np.int32)), pa.array(names)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(g // shard_blocks), name, pa.array(slot), pa.array(ix)], names=["shard", "source", "slot", "ix"])

    drawn = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, math.ceil(total / SLOTS_PER_TASK))).mapInArrow(slots, "shard long, source string, slot long, ix long")
    per = light.where("source is not null").groupBy("source", "part").agg(F.count("*").alias("c"), F.min("seq").alias("s0"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per task and source
    start = per.select("source", "part", (before - F.col("s0")).alias("__b"))
    dense = light.where("source is not null").join(start, ["source", "part"]).select("source", (F.col("__b") + F.col("seq")).alias("ix"), "part", "seq", "n_tokens")
    return drawn.join(dense, ["source", "ix"]).select("shard", "source", "slot", "part", "seq", "n_tokens"), summary


@dataclass
class Mixture:
    """What :func:`plan` has made: blocks, the slots that use them, and the table of sources."""

    blocks: DataFrame
    slots: DataFrame
    summary: DataFrame

    def rows(self) -> DataFrame:
        """``shard, slot, source, n_tokens, tokens, doc_ids, doc_tokens``, one row per slot (``slot`` counts within the source)."""
        heavy = self.blocks.where("source is not null").drop("n_tokens")
        return heavy.join(self.slots, ["source", "part", "seq"]).select("shard", "slot", "source", "n_tokens", "tokens", "doc_ids", "doc_tokens")

    def shard_counts(self) -> DataFrame:
        """``shard, source, n_blocks, n_tokens``."""
        return self.slots.groupBy("shard", "source").agg(F.count("*").alias("n_blocks"), F.sum("n_tokens").alias("n_tokens"))

    def shares(self) -> DataFrame:
        """``source, target_share, actual_share, max_repeats, most_uses, source_tokens, mixture_tokens, corpus_tokens``; sources without documents have zeros."""
        per = self.slots.groupBy("source", "part", "seq").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("t"))
        got = per.groupBy("source").agg(F.sum("t").alias("mixture_tokens"), F.max("uses").alias("most_uses"))
        all_ = got.agg(F.sum("mixture_tokens").alias("__all"))
        s = self.summary.join(got, "source", "left").join(F.broadcast(all_))  # one row
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        return s.select("source", "target_share", F.coalesce(F.try_divide("mixture_tokens", "__all"), F.lit(0.0)).alias("actual_share"), "max_repeats", zero("most_uses"), "source_tokens", zero("mixture_tokens"), "corpus_tokens")


def plan(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = 0, tokenizer: str = TOKENIZER) -> Mixture:
    """Tokenise, pack and draw once; the result gives the mixture, its counts per shard and its shares.

    An empty corpus or targets without matching sources give no slots.
    """
    blocks = pack(documents, _names(targets), block_tokens, tokenizer)
    slots, summary = plan_slots(blocks, targets, shard_blocks, seed)
    return Mixture(blocks, stored(slots, "slots"), summary)


def _names(targets: DataFrame) -> list[str]:
    rows = bounded_rows(targets.select("source").where("source is not null"), MAX_SOURCES, "mix_targets")
    return sorted({r.source.strip(" \t").lower() for r in rows} - {""})
