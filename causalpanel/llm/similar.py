"""SimHash near-duplicates at a Jaccard similarity of shingle sets, exactly.

Every set has a SimHash print of 256 bits and a pivot table, its distances to the references of
``simhash``. A pair whose tables differ by more than DISTANCE in one coordinate is discarded, one whose
prints do so too, and the whole sets of the survivors are compared. No run of a print's bits is shared
by all pairs at a similarity, so the sets themselves deal the pairs: a set's shingles stand in one
order for all texts, by a level of how common they are in a sample, then by hash. Two sets of n
shingles or fewer at a similarity of 4/5 share one of their first n - ceil(4n/5) + 1 shingles (prefix
filtering), whatever the levels are, so no pair is missed. Pairs that meet are counted, those that
cannot reach the overlap are left out, and the rest go to the tables.

Buckets of more than LARGE sets would meet in too many pairs. Each of their sets first goes to a few homes,
by the least hashes of its large buckets, and is compared there with all that share the home, in tiles,
without a pair being written: most near copies share one. Pairs of one component, or of one home, need
no other meeting.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keyed, row_key, ship, stored
from .components import components
from .simhash import REFERENCES, SEED, fingerprint, hamming, in_tiles, one_each, pivot_table, shingle_hashes

#: The least similarity, as a fraction of whole numbers: sets at exactly this are linked.
SHARE, OF = 4, 5
#: Texts whose shingles are counted for the levels, and texts of those that make a shingle common.
SAMPLED, COMMON = 32_768, 16
#: Common shingles that are broadcast at most; the order stays one order without the others.
MOST_COMMON = 200_000
#: Texts that are looked up by broadcast names at most (24 bytes each); more meet them by a shuffle.
BROADCAST_ROWS = 262_144
LEVEL_BITS = 2
#: Words of 64 bits in a print, and differing bits that sets at the least similarity never have: about
#: 39 of 256 are expected of large ones, 48 of the least favourable (four shingles of five), where this is
#: over seven standard deviations away; unrelated ones differ in 128.
WIDTH, DISTANCE = 4, 96
#: Sets in a bucket that meet in pairs, homes of a set in larger ones, sets in a chunk of a home.
LARGE, HOMES, CHUNK = 32, 4, 256
#: Shingles that are counted at once in a tile.
COLUMNS = 4096


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes that leave room for the level and the sign."""
    return np.unique(shingle_hashes(text, size) >> np.uint64(LEVEL_BITS + 1)).astype(np.int64)


def ordered(found: np.ndarray, common: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """``found`` with levels on top, sorted."""
    if not len(common):
        return found
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return np.sort(found | np.where(common[at] == found, levels[at], 0) << (63 - LEVEL_BITS))


def prefix(n: int) -> int:
    """Shingles of a set of ``n`` of which one is shared with every set at the least similarity."""
    return n - -(-SHARE * n // OF) + 1 if n else 0


def _sets(docs: DataFrame, size: int, kind: str, made) -> DataFrame:
    """``made(batch, sets)`` over the texts of ``docs``; ``sets`` are the shingle sets, one by one."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield made(part, [shingle_set(t, size) for t in part.column("text").to_pylist()])

    return docs.mapInArrow(run, kind)


def _lists(sets: list):
    """A list column of int64 arrays."""
    import pyarrow as pa

    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))


def _common(plain: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles common in a sample of the texts, sorted, and their levels."""
    import pyarrow as pa

    def made(part, sets):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], ["s"])

    some = plain.where(F.pmod("_k1", F.lit(max(1, plain.count() // SAMPLED))) == 0).select("text")
    counted = _sets(some, size, "s long", made).groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON)
    found = counted.orderBy(F.desc("c"), "s").limit(MOST_COMMON).toArrow()
    common, times = (found.column(c).to_numpy() for c in ("s", "c"))
    order = np.argsort(common)
    return common[order], 1 + (times[order] >= 8 * COMMON) + (times[order] >= 64 * COMMON)


def _begun(plain: DataFrame, size: int) -> DataFrame:
    """doc_id, _k1, _k2, v (names the shingle set), n (its size), start (its prefix), print per row."""
    import pyarrow as pa
    import xxhash

    common, levels = (plain.sparkSession.sparkContext.broadcast(x) for x in _common(plain, size))

    def made(part, sets):
        v = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        n = np.array([len(s) for s in sets], np.int32)
        starts = _lists([ordered(s, common.value, levels.value)[: prefix(len(s))] for s in sets])
        prints = _lists([fingerprint(s.view(np.uint64) << np.uint64(LEVEL_BITS + 1), WIDTH).view(np.int64) for s in sets])
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "_k1", "_k2")), pa.array(v), pa.array(n), starts, prints], ["doc_id", "_k1", "_k2", "v", "n", "start", "print"])

    return _sets(plain, size, "doc_id long, _k1 long, _k2 long, v long, n int, start array<bigint>, print array<bigint>", made)


def _near(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of the (u, v) ``pairs`` those that neither a coordinate of their pivot tables nor their prints set apart."""
    table = known.select("v", "print", pivot_table(F.col("print"), WIDTH).alias("table"))
    both = pairs.join(table.select(F.col("v").alias("u"), F.col("print").alias("_p"), F.col("table").alias("_t")), "u").join(table, "v")
    most = F.array_max(F.zip_with("table", "_t", lambda a, b: F.abs(a - b)))
    return both.where(most <= DISTANCE).where(hamming(F.col("print"), [F.col("_p")[w] for w in range(WIDTH)]) <= DISTANCE).select("u", "v")


def _whole_sets(wanted: DataFrame, known: DataFrame, plain: DataFrame, size: int) -> DataFrame:
    """v, set: the whole shingle sets of the names in ``wanted``, from the text of one row of each."""
    import pyarrow as pa

    def made(part, sets):
        return pa.RecordBatch.from_arrays([part.column("v"), _lists(sets)], ["v", "set"])

    needed = cut(known.join(wanted, "v").select("v", "_k1", "_k2"))
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    texts = plain.join(needed, ["_k1", "_k2"]).select("v", "text")
    return cut(_sets(texts, size, "v long, set array<bigint>", made).dropDuplicates(["v"]))


def _alike(pairs: DataFrame, known: DataFrame, plain: DataFrame, size: int) -> DataFrame:
    """Of the (u, v) ``pairs`` whose whole sets are at the least similarity or above, enough to connect all."""
    import pyarrow as pa

    def checked(batches):
        root: dict[int, int] = {}  # of what this task has linked; pairs within add nothing

        def find(a):
            while (up := root.get(a, a)) != a:
                root[a] = a = root.get(up, up)
            return a

        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            x, y = a.flatten().to_numpy(), b.flatten().to_numpy()
            i, j = (np.cumsum(np.concatenate([[0], c.value_lengths().to_numpy()])).tolist() for c in (a, b))
            good = []
            for k, (u, v) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("u", "v")), strict=True)):
                u, v = find(u), find(v)
                if u != v:
                    one, two = x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if (SHARE + OF) * both >= SHARE * (len(one) + len(two)):
                        root[max(u, v)] = min(u, v)
                        good.append(k)
            yield batch.select(["u", "v"]).take(pa.array(good, pa.int32()))

    sets = _whole_sets(pairs.select(F.explode(F.array("u", "v")).alias("v")).distinct(), known, plain, size)
    both = pairs.join(sets.select(F.col("v").alias("u"), F.col("set").alias("a")), "u").join(sets.select("v", F.col("set").alias("b")), "v")
    return stored(both.select("u", "v", "a", "b").mapInArrow(checked, "u long, v long"))


def _near_in_size(a, b):
    return F.least(a, b) * OF >= F.greatest(a, b) * SHARE


def set_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of ``sets`` at the least similarity or above, enough to connect all such pairs.

    The overlaps of all pairs are products of the sets' rows over the shingles that two or more have.
    """
    m, n = len(sets), np.array([len(s) for s in sets], np.int64)
    _, name, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = np.flatnonzero(times[name] > 1)
    column, row = (np.cumsum(times > 1) - 1)[name[kept]], np.repeat(np.arange(m), n)[kept]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((m, m), np.float32 if n.max(initial=0) < 1 << 24 else np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (at, at + COLUMNS))
        block = np.zeros((m, COLUMNS), both.dtype)
        block[row[i:j], column[i:j] - at] = 1
        both += block @ block.T
    good = (SHARE + OF) * both.astype(np.float64) >= SHARE * (n[:, None] + n[None])
    root, found = list(range(m)), []
    for a, b in np.argwhere(np.triu(good, 1)).tolist():
        x, y = a, b
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((a, b))
    return found


def _groups(batches, names: list[str]):
    """The rows of each group of ``names``, which lie together, as tables."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if held is None else pa.concat_tables([held, part])
        keys = [part.column(c).to_numpy() for c in names]
        starts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        edges = [0, *starts.tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield part.slice(a, b - a)
        held = part.slice(edges[-1])
    if held is not None:
        yield held


def _wide(table, column: str, width: int) -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(table), width)


def close(prints: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Which rows have another one that neither a coordinate of the pivot tables nor the prints set apart."""
    found = np.zeros(len(prints), bool)
    for at in range(0, len(prints), 64):
        some = slice(at, at + 64)
        near = (np.abs(tables[some, None] - tables[None]) <= DISTANCE).all(axis=2)
        near &= np.bitwise_count(prints[some, None] ^ prints[None]).sum(axis=2, dtype=np.int64) <= DISTANCE
        found[some] = near.sum(axis=1) > 1  # itself is one
    return found


def _at_home(per: DataFrame, known: DataFrame, plain: DataFrame, size: int) -> DataFrame:
    """(u, v) edges that connect all pairs at the least similarity that share a home."""
    import pyarrow as pa

    tile, kind = ["nth", "home", "a", "b"], "nth int, home long, a int, b int"
    at = cut(per.where(F.size("homes") > 0).select("v", F.posexplode("homes").alias("nth", "home")))
    at = in_tiles(at, ["nth", "home"], CHUNK)
    table = known.select("v", "print", pivot_table(F.col("print"), WIDTH).alias("table"))
    at = at.join(table, "v").repartition(*tile).sortWithinPartitions(*tile)

    def survivors(batches):
        for part in _groups(batches, tile):
            good = close(_wide(part, "print", WIDTH).view(np.uint64), _wide(part, "table", REFERENCES).astype(np.int16))
            yield from part.select([*tile, "v"]).take(pa.array(np.flatnonzero(good))).to_batches()

    def linked(batches):
        for part in _groups(batches, tile):
            sets, v = [np.asarray(s.values) for s in part.column("set")], part.column("v").to_numpy()
            found = np.array(set_links(sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(v[found[:, 0]]), pa.array(v[found[:, 1]])], ["u", "v"])

    left = cut(at.mapInArrow(survivors, f"{kind}, v long"))
    sets = _whole_sets(left.select("v").distinct(), known, plain, size)
    left = left.join(sets, "v").repartition(*tile).sortWithinPartitions(*tile)
    return stored(left.mapInArrow(linked, "u long, v long"))


def links(known: DataFrame, plain: DataFrame, size: int) -> DataFrame:
    """(v, _k1, _k2, n, start, print) rows, one for each distinct set -> (u, v) edges, all at the least
    similarity, whose components are those of all such pairs."""
    dealt = known.select(F.explode("start").alias("key"), "v", "n", F.get("start", F.size("start") - 1).alias("last"))
    whole = Window.partitionBy("key")
    large = F.col("_c") > LARGE
    homes = [F.min(F.when(large, F.xxhash64("key", F.lit(k)))) for k in range(HOMES)]
    per = dealt.withColumn("_c", F.count("*").over(whole)).where("_c > 1").groupBy("v", "n", "last")
    per = cut(per.agg(F.collect_list("key").alias("keys"), F.array_compact(F.array(*homes)).alias("homes")))
    first = _at_home(per, known, plain, size)
    rooted = components(first, stored).withColumnRenamed("node", "v")
    open_ = per.join(rooted, "v", "left").select("v", "n", "last", "homes", F.coalesce("root", "v").alias("root"), F.explode("keys").alias("key"))
    open_ = open_.withColumns({"_a": F.min("root").over(whole), "_b": F.max("root").over(whole)}).where("_a <> _b").drop("_a", "_b")
    open_ = cut(open_)
    a, b = (open_.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("v", "n", "last", "root", "homes")]) for k in (1, 2))
    apart = (F.col("root1") != F.col("root2")) & ~F.arrays_overlap("homes1", "homes2")
    met = a.join(b, "key").where((F.col("v1") < F.col("v2")) & apart & _near_in_size(F.col("n1"), F.col("n2")))
    met = met.groupBy(F.col("v1").alias("u"), F.col("v2").alias("v")).agg(F.count("*").alias("_both"), *[F.first(c).alias(c) for c in ("n1", "n2", "last1", "last2")])
    # Up to the earlier of the two prefixes' ends every shared shingle has been counted.
    n = F.when(F.col("last1") <= F.col("last2"), F.col("n1")).otherwise(F.col("n2"))
    most = F.col("_both") + F.ceil(n * SHARE / OF) - 1
    pairs = cut(met.where(most * (SHARE + OF) >= (F.col("n1") + F.col("n2")) * SHARE).select("u", "v"))
    return first.unionByName(_alike(cut(_near(pairs, known)), known, plain, size))


def near_duplicates(docs: DataFrame, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, root (names its group), _k1, _k2.

    Two texts are linked exactly if the Jaccard similarity of their sets of ``size``-word shingles
    (ASCII letters in lower case; a text of fewer words is one shingle) is SHARE / OF or more; groups
    are the components of the links. Texts without words, null or empty, are one group. Shingles are
    told apart by 61 bits of hash. Other columns are not read; an empty table gives an empty result.
    """
    keys = row_key(F.col(doc_id), F.col(text))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *keys, F.col(text).alias("text"))
    d = cut(_begun(plain, size))
    one = cut(d.where("n > 0").groupBy("v").agg(F.min(F.struct("_k1", "_k2")).alias("_one")).select("_one.*"))
    known = cut(d.join(one, ["_k1", "_k2"]).select("v", "_k1", "_k2", "n", "start", "print").dropDuplicates(["v"]))
    rooted = components(links(known, plain, size), stored).withColumnRenamed("node", "v")
    return d.join(rooted, "v", "left").select("doc_id", F.coalesce("root", "v").alias("root"), "_k1", "_k2")


def drop_near_duplicates(docs: DataFrame, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group: the one of the least doc_id.

    Rows without an id come last; among rows of one id a hash of the text decides, and of rows that
    repeat id and text the one of the least hash of all its columns stays.
    """
    found = near_duplicates(docs, size, doc_id, text)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")
    kept = found.groupBy("root").agg(F.min(order).alias("_first")).select("_first._k1", "_first._k2")
    return one_each(docs, keyed(docs, doc_id, text).join(kept, ["_k1", "_k2"], "left_semi"))
