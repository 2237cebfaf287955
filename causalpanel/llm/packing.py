"""Conflict-constrained best-fit packing.

Documents, cut into pieces of at most a bin's capacity, are dealt by hash to groups of bounded size;
each group is packed by itself, largest piece first. Bins lie in order of their residual and carry
two bitmaps: the sources they hold (a bit for each of the places that a source may take) and the
duplicate clusters they hold. A piece goes to the first bin in that order, from its own size
upwards, whose bitmaps allow it: the tightest compatible bin.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, n_words, row_key, ship

CAPACITY, PER_SOURCE = 2048, 4
#: Pieces in one group, about.
GROUP = 16384


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece, in the order given; sizes from 1 to ``capacity``.

    No bin holds a cluster twice or a source more than ``per_source`` times (None: of no cluster, no
    source). Bins of one residual and one pair of bitmaps are alike and are kept together, so the
    search looks at each kind of bin once.
    """
    twice = {c for c, n in zip(*np.unique([str(c) for c in clusters if c is not None], return_counts=True), strict=True) if n > 1}
    cluster_bit = {c: 1 << k for k, c in enumerate(sorted(twice))}
    source_bits = {s: per_source * k for k, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    levels: list[int] = []  # residuals that some bin has, in order
    kinds: dict[int, dict[tuple[int, int], list[int]]] = {}
    bins, offsets, opened = [], [], 0
    full = (1 << per_source) - 1
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        mine = cluster_bit.get(str(cluster), 0) if cluster is not None else 0
        shift = source_bits.get(source)
        taken = None
        for residual in levels[bisect_left(levels, size) :]:
            for (held, dup), stack in kinds[residual].items():
                if not dup & mine and (shift is None or (held >> shift) & full != full):
                    taken = (residual, held, dup, stack)
                    break
            if taken:
                break
        if taken:
            residual, held, dup, stack = taken
            chosen = stack.pop()
            if not stack:
                del kinds[residual][held, dup]
                if not kinds[residual]:
                    del kinds[residual]
                    levels.pop(bisect_left(levels, residual))
        else:
            residual, held, dup, chosen, opened = capacity, 0, 0, opened, opened + 1
        bins.append(chosen)
        offsets.append(capacity - residual)
        if shift is not None:
            places = (held >> shift) & full
            held |= (places + 1) << shift  # one more place, from the lowest
        left = residual - size
        if left:
            if left not in kinds:
                insort(levels, left)
            kinds.setdefault(left, {}).setdefault((held, dup | mine), []).append(chosen)
    return bins, offsets


def pieces(docs: DataFrame, capacity: int, doc_id: str, text: str, source: str, cluster: Column | None) -> DataFrame:
    """A row for each run of up to ``capacity`` words of a document; one of size 0 for no words."""
    same = F.concat_ws(":", F.xxhash64(text), F.xxhash64(F.lit("second"), text)) if cluster is None else cluster
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), same.alias("cluster"), n_words(F.col(text)).alias("_words"), *row_key(F.col(doc_id), F.col(text), F.col(source)))
    last = F.greatest(F.ceil(F.col("_words") / capacity) - 1, F.lit(0))
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return d.select("doc_id", "piece", (F.col("piece") * capacity).alias("first_word"), F.least(F.lit(capacity), F.col("_words") - F.col("piece") * capacity).alias("n_words"), "source", "cluster", "_k1", "_k2", F.monotonically_increasing_id().alias("_tag"))


def pack(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, doc_id: str = "doc_id", text: str = "text",
    source: str = "source", cluster: Column | None = None,
) -> DataFrame:
    """Per piece: doc_id, piece, first_word, n_words, source, bin_id, bin_offset, bin_words.

    ``cluster`` names duplicates (the default: rows of equal text, told by 128 bits of hashes), which
    never share a bin: nor do two pieces of one document. Sources and named clusters are told apart
    exactly. ``bin_id`` is unique
    over all groups. A document of no words (null and empty texts) has one piece and no bin. Null
    sources are free of the source rule. Repeated rows are duplicates of each other; other columns
    are not read; an empty table gives an empty result.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    d = cut(pieces(docs, capacity, doc_id, text, source, cluster))
    groups = max(1, math.ceil(d.count() / GROUP))
    d = d.withColumn("_group", F.pmod(F.xxhash64("_k1", "_k2", "piece", "_tag"), F.lit(groups)))
    names = ["doc_id", "piece", "first_word", "n_words", "source", "bin_id", "bin_offset", "bin_words"]

    def packed(table):
        table = table.sort_by([("n_words", "descending"), ("_k1", "ascending"), ("_k2", "ascending"), ("piece", "ascending"), ("_tag", "ascending")])
        sizes = table.column("n_words").to_pylist()
        n = sum(1 for s in sizes if s)
        some = [table.column(c).to_pylist()[:n] for c in ("source", "cluster")]
        bins, offsets = best_fit(sizes[:n], *some, capacity, per_source)
        fill = np.bincount(bins, sizes[:n]).astype(np.int64) if n else np.empty(0, np.int64)
        base = table.column("_group")[0].as_py() << 32
        none = [None] * (len(sizes) - n)
        made = [pa.array([base + b for b in bins] + none, pa.int64()), pa.array(offsets + none, pa.int64()), pa.array([int(fill[b]) for b in bins] + none, pa.int64())]
        return pa.Table.from_arrays([*[table.column(c) for c in names[:5]], *made], names)

    kind = "doc_id long, piece long, first_word long, n_words long, source string, bin_id long, bin_offset long, bin_words long"
    return d.groupBy("_group").applyInArrow(packed, kind)
