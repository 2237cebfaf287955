"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents are ordered by that key: the
key's leading bits deal them into equal ranges (the key is uniform, so no splitters need sampling),
prefix sums of the ranges' word counts give each range its offset, and a window inside each range
gives each document its own. The cut at the source's exact budget is then a comparison per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_offsets, cut, hash_bits, keyed, n_words, row_hash, row_key, words

#: Weights by a source's place in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix's words as a share of all words, and the most epochs that a source may give.
SHARE, MOST = 1.5, 2.0
SEED = "mix"
#: Rows in one range of keys, about.
PER_RANGE = 512


def mix_key(doc_id: Column, unnamed: Column, seed: str = SEED) -> Column:
    """60 hash-random bits of a document, as a long; ``unnamed`` tells rows without an id apart."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), unnamed)))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source key, source size) rows -> with ``target``, by weight, no more than ``most`` sizes each.

    Sources in order of ``most * size / weight`` fill up first; with the first k of them full, the
    rest share what is left at one rate per unit of weight. A source is full exactly if the rate
    before it reaches its own ratio; past the first that is not, the rate only falls. The table has one row per source.
    """
    by_name = Window.orderBy(F.col("_null"), F.col("_src"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_w", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1)))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_null", "_src")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rate = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    ranked = ranked.withColumn("_rate", rate).withColumn("_full", F.col("_rate") >= F.col("_cap") / F.col("_w"))
    final = F.max(F.when(~F.col("_full"), F.col("_rate"))).over(everything)
    return ranked.select(
        "_null", "_src", "source_size",
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * final).alias("target"),
    )


def _numbered(d: DataFrame) -> DataFrame:
    """``d`` with _copy: the rows without an id that repeat (_k1, _k2) are numbered from 0, others null.

    Copies are counted by input partition first, so that no window holds more than one partition's:
    their keys then lie as far apart as those of different documents, and no range is theirs alone.
    """
    named = d.where("doc_id is not null").withColumn("_copy", F.lit(None).cast("long"))
    rest = d.where("doc_id is null").withColumn("_part", F.spark_partition_id())
    rest = cut(rest)
    counts = rest.groupBy("_k1", "_k2", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_k1", "_k2").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_k1", "_k2", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_k1", "_k2", "_part").orderBy("size")) - 1
    rest = rest.withColumn("_nth", nth).join(counts, ["_k1", "_k2", "_part"])
    return named.unionByName(rest.withColumn("_copy", F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before"))


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, epochs, part.

    ``taken`` = ``epochs`` * size + ``part``: the source's order by key is gone through ``epochs``
    times in full, and once more up to the exact budget (the target's whole words); ``part`` is what
    that last round takes of the document, short of its size for one document a source at most.
    A null text has size 0; null sources form one source, last in order; a source of size 0 gets
    target 0. Rows that repeat (same doc_id and size) are interchangeable. Other columns of ``docs``
    are not read, whatever their names; an empty table gives an empty result.
    """
    d = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).isNull().alias("_null"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_src"), n_words(F.col(text)).alias("size"),
        *row_key(F.col(doc_id), F.col(text), F.col(source)),
    )
    d = cut(_numbered(d).withColumn("_key", mix_key(F.col("doc_id"), F.concat_ws(":", "_k1", "_k2", "_copy"), seed)).drop("_copy"))
    named = ["_null", "_src"]
    sizes = d.groupBy(*named).agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sizes = cut(sizes)
    bits = hash_bits(sizes.agg(F.sum("_rows")).first()[0] or 0, PER_RANGE)
    d = d.withColumn("_range", F.shiftright("_key", 60 - bits))
    totals = d.groupBy(*named, "_range").agg(F.sum("size").alias("_size"))
    offsets = bucket_offsets(totals, named, "_range", bits, "_size")
    per_range = offsets.join(targets(sizes.drop("_rows"), weights, share, most), named)
    inside = Window.partitionBy(*named, "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(per_range, [*named, "_range"])
    budget = F.floor("target").cast("long")
    d = d.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    left = budget - F.col("epochs") * F.col("source_size") - F.col("_offset") - F.col("_start")
    d = d.withColumn("part", F.greatest(F.lit(0), F.least("size", left)))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")
    return d.select("doc_id", "size", "source_size", "target", taken, "epochs", "part", "_k1", "_k2")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the mix takes it, all columns kept.

    The one document a source at which the budget ends gives its first ``part`` words, joined
    by single spaces; ``n_chars`` (if there is such a column) follows. Documents of no words
    come once per full epoch, as they cost nothing. The digest travels to the texts by row identity,
    so each text is shuffled once;
    rows that repeat share at most three different plans, which are handed out by count.
    """
    doc_id, text, source = (options.get(k, k) for k in ("doc_id", "text", "source"))
    plan = mix(docs, **options).groupBy("_k1", "_k2", "epochs", "part", "size").agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy("_k1", "_k2").orderBy("epochs", "part", "size")
    plan = plan.withColumn("_upto", F.sum("_n").over(so_far)).groupBy("_k1", "_k2")
    plan = plan.agg(F.sort_array(F.collect_list(F.struct("_upto", "epochs", "part", "size"))).alias("_plans"))
    nth = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy(row_hash(docs)))
    d = keyed(docs, doc_id, text, source).join(plan, ["_k1", "_k2"]).withColumn("_nth", nth)
    d = d.withColumn("_plan", F.element_at(F.filter("_plans", lambda p: p["_upto"] >= F.col("_nth")), 1))
    full = F.when(F.col("_plan.epochs") > 0, F.array_repeat(F.lit(-1).cast("long"), F.col("_plan.epochs").cast("int"))).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("_plan.part") > 0, F.array(F.when(F.col("_plan.part") < F.col("_plan.size"), F.col("_plan.part")).otherwise(F.lit(-1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    d = d.select("_doc", F.explode(F.concat(full, rest)).alias("_cut"))
    whole = F.col(f"_doc.{text}")
    first = F.concat_ws(" ", F.slice(words(whole), 1, F.greatest(F.col("_cut"), F.lit(1)).cast("int")))
    body = F.when(F.col("_cut") < 0, whole).otherwise(first)
    out = {c: F.col(f"_doc.`{c}`") for c in docs.columns}
    out[text] = body
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_cut") < 0, out["n_chars"]).otherwise(F.length(body).cast(docs.schema["n_chars"].dataType))
    return d.select(*[c.alias(name) for name, c in out.items()])
