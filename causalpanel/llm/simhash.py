"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets its Hamming distances to many fixed reference fingerprints. Pairs
are dealt by bit blocks that fingerprints within the threshold must share; within a bucket, sorted by
the first distance, a pair is discarded as soon as one coordinate differs by more than the threshold,
and the survivors are verified. A bucket gives a spanning forest of its links, not all pairs. Distances
to references alone can't deal pairs: those of unrelated 64-bit prints differ by 4 or less in over
half of all cases. ``similar`` holds texts to a Jaccard similarity by the same tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed, row_hash, row_key, ship
from .components import components

#: Reference fingerprints, and so coordinates of a print.
REFERENCES = 16
#: Large buckets that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 65_536
#: Prints in one chunk of a large bucket; every two chunks of it meet in one tile.
CHUNK = 1024
SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def references(count: int, width: int) -> np.ndarray:
    """The reference fingerprints, (count, width) words of 64 bits, by a fixed rule."""
    return mixed(np.arange(1, count * width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(count, width)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; of the whole sequence if it is shorter."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) < size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    one, spans = xxhash.xxh64_intdigest, zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([one(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray, width: int) -> np.ndarray:
    """``width`` words of 64 bits; the first takes the hashes as they are, the others remix them."""
    counts = np.zeros(64 * width, np.int64)
    salts = np.arange(width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255 * 16):
        some = hashes[at : at + 255 * 16]
        lanes = np.repeat(some[:, None], width, axis=1)
        if width > 1:
            with np.errstate(over="ignore"):
                lanes[:, 1:] = mixed(some[:, None] + salts[None, 1:])
        bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            counts += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, size: int, width: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, _k1, _k2, print (array of ``width`` longs) per row of ``docs``; whole texts."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def made(batches):
        for batch in batches:
            prints = []
            for at in range(0, batch.num_rows, 256):
                prints += [fingerprint(shingle_hashes(t, size), width) for t in batch.column("text").slice(at, 256).to_pylist()]
            flat = pa.array(np.concatenate(prints).view(np.int64) if prints else np.empty(0, np.int64))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "_k1", "_k2")] + [pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "_k1", "_k2", "print"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *row_key(F.col(doc_id), F.col(text)), F.col(text).alias("text"))
    return d.mapInArrow(made, "doc_id long, _k1 long, _k2 long, print array<bigint>")


def block_tables(rows: int, distance: int) -> list[tuple[int, int]]:
    """(word, mask) tables for one 64-bit print: prints within ``distance`` agree on one mask or more.

    Of b blocks at least b - distance are untouched. The fewest blocks are taken that leave about
    4096 prints of unrelated texts in a bucket at most: more blocks make smaller buckets, but of
    many more rows.
    """
    for blocks in range(distance + 1, distance + 5):
        kept = blocks - distance
        if kept * 64 // blocks + 12 >= max(rows, 2).bit_length():
            break
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [(0, sum(some)) for some in combinations(masks, kept)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hamming(a: Column, b: list[Column]) -> Column:
    """Differing bits of a print, an array, and another one's words."""
    parts = [F.bit_count(a[w].bitwiseXOR(x)) for w, x in enumerate(b)]
    return sum(parts[1:], parts[0])


def pivot_table(print_: Column, width: int) -> Column:
    """The distances of a print to the references: its coordinates."""
    return F.array(*[hamming(print_, [F.lit(_signed(int(x))) for x in r]).cast("short") for r in references(REFERENCES, width)])


def tile_links(group: np.ndarray, prints: np.ndarray, table: np.ndarray, distance: int) -> np.ndarray:
    """For rows sorted by (group, first coordinate): each row's root in its group's forest of links.

    Row i is held against row i + shift for growing shifts; rows whose partner lies in another group
    or beyond ``distance`` in the first coordinate are finished, as are groups that have become one
    component. Of the rest, those apart in another
    coordinate are discarded, then the full prints are compared; pairs that are already connected
    add nothing.
    """
    n = len(group)
    root, active, shift = np.arange(n), np.arange(n), 1
    first = table[:, 0]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, int)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    while True:
        active = active[active + shift < n]
        other = active + shift
        active = active[(group[active] == group[other]) & (first[other] - first[active] <= distance)]
        if not len(active):
            return root
        pair = active[root[active] != root[active + shift]]
        for k in range(1, table.shape[1]):
            if not len(pair):
                break
            pair = pair[np.abs(table[pair, k] - table[pair + shift, k]) <= distance]
        if len(pair):
            apart = np.bitwise_count(prints[pair] ^ prints[pair + shift]).sum(axis=1, dtype=np.int64)
            pair = pair[apart <= distance]
        if len(pair):
            for a, b in zip(pair.tolist(), (pair + shift).tolist(), strict=True):
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
            while not np.array_equal(flat := root[root], root):
                root = flat
            whole = np.minimum.reduceat(root, starts) == np.maximum.reduceat(root, starts)
            active = active[~whole[group[active]]]
        shift += 1


def in_tiles(dealt: DataFrame, bucket: list[str], chunk: int) -> DataFrame:
    """``dealt`` with a, b: rows of a bucket of more than ``chunk`` are cut into chunks by a hash of v, and
    a row comes once for every two chunks a <= b of which one is its own. No task holds a whole large
    bucket, and every two rows of a bucket meet."""
    large = dealt.groupBy(*bucket).agg(F.count("*").alias("_n")).where(F.col("_n") > chunk)
    large = cut(large.select(*bucket, F.ceil(F.col("_n") / chunk).cast("int").alias("_g")))
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    d = dealt.join(large, bucket, "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    others = F.when(F.col("_g") > 1, F.filter(F.sequence(F.lit(0), F.col("_g") - 1), lambda x: x != F.col("_own"))).otherwise(F.array(F.lit(0)))
    d = d.withColumn("_own", F.pmod(F.xxhash64("v"), F.col("_g")).cast("int")).withColumn("_o", F.explode(others))
    return d.select(*dealt.columns, F.least("_own", "_o").alias("a"), F.greatest("_own", "_o").alias("b"))


def links(prints: DataFrame, distance: int, tables: list[tuple[int, int]]) -> DataFrame:
    """(v, print) rows, distinct, of one word -> (u, v) edges that connect what is within ``distance`` bits.

    Buckets meet in tiles (``in_tiles``) of CHUNK prints a chunk.
    """
    import pyarrow as pa

    prints = prints.withColumn("table", pivot_table(F.col("print"), 1))
    keys = F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("print")[w].bitwiseAND(F.lit(_signed(mask))).alias("key")) for t, (w, mask) in enumerate(tables)])
    dealt = prints.withColumn("_b", F.explode(keys)).select("_b.t", "_b.key", "v", "print", "table")
    dealt = in_tiles(dealt, ["t", "key"], CHUNK)
    dealt = dealt.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b", F.col("table")[0])
    ship(prints.sparkSession)

    def forest(batches):
        kept = None

        def found(part):
            names = [part.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "a", "b")]
            new = np.zeros(len(part), bool)
            for x in names:
                new[1:] |= x[1:] != x[:-1]
            group = np.cumsum(new)
            return group, int(np.flatnonzero(new)[-1]) if new.any() else 0

        def edges(part, group):
            v = part.column("v").to_numpy()
            flat = [pa.concat_arrays([x.flatten() for x in part.column(c).chunks]).to_numpy() for c in ("print", "table")]
            root = tile_links(group, flat[0].view(np.uint64).reshape(-1, 1), flat[1].astype(np.int32).reshape(-1, REFERENCES), distance)
            at = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(v[root[at]])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = pa.concat_tables([kept, part]) if kept is not None else part
            group, last = found(part)
            if last:
                yield edges(part.slice(0, last), group[:last])
            kept = part.slice(last)
        if kept is not None and kept.num_rows:
            yield edges(kept, found(kept)[0])

    return dealt.mapInArrow(forest, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (hex), component_id, root, _k1, _k2.

    ``size``: words in a shingle. Fingerprints of 64 bits are linked at ``distance`` bits or fewer,
    exactly. A text of fewer words is one shingle, one of no words (null and empty) has the zero
    print, linked like any other. ``component_id`` is the least doc_id reachable; null ids count
    only where a component has no other. Repeated rows come back each time; other columns are not
    read; an empty table gives an empty result.
    """
    d = cut(fingerprints(docs, size, 1, doc_id, text))
    v = F.col("print")[0]
    known = cut(d.groupBy("print").agg(F.min("doc_id").alias("least")).withColumn("v", v))
    rooted = components(links(known.select("v", "print"), distance, block_tables(known.count(), distance)))
    known = known.select("v", "least").join(rooted.withColumnRenamed("node", "v"), "v", "left")
    known = cut(known.withColumn("root", F.coalesce("root", "v")))
    least = cut(known.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(known.select("v", "root").join(least, "root").select("v", "root", "component_id"))
    hexed = F.lower(F.lpad(F.hex(v), 16, "0"))
    return d.withColumn("v", v).join(named, "v").select("doc_id", hexed.alias("fingerprint"), "component_id", "root", "_k1", "_k2")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, with one row of each group: the one of the least doc_id.

    Rows without an id come last; among rows of one id a hash of the text decides, and of rows that
    repeat id and text the one of the least hash of all its columns stays.
    """
    doc_id, text = (options.get(k, k) for k in ("doc_id", "text"))
    found = near_duplicates(docs, **options)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")
    kept = found.groupBy("root").agg(F.min(order).alias("_first")).select("_first._k1", "_first._k2")
    return one_each(docs, keyed(docs, doc_id, text).join(kept, ["_k1", "_k2"], "left_semi"))


def one_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of the rows (_doc, _k1, _k2) of each key the one of the least hash of all its columns."""
    return found.groupBy("_k1", "_k2").agg(F.min_by("_doc", row_hash(docs)).alias("_doc")).select("_doc.*")
