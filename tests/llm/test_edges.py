"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, no rows and clashing columns."""

import json
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from causalpanel.llm import bitpack, chat, linededup, mixing, mtree, packing, quality, sharding, similar, simhash, toxicity
from causalpanel.llm.queries import op10_token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lang word " * 40_000
ROWS = [
    (1, "one two three four five six", "en", "a", 27),
    (1, "one two three four five six", "en", "a", 27),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "no id here at all", "en", "b", 17),
    (None, None, None, None, None),
    (4, LONG, "en", None, len(LONG)),
    (5, "one two three four five six", "fr", "c", 27),
    (6, " \n\t\n ", "fr", "c", 5),
    (6, "same id, other text", "fr", "c", 19),
    (7, "\x00 odd ퟿ é 😀", "fr", "", 9),
]
CLASH = ["_n_lines", "_n_dropped", "_copy", "_part", "n", "start", "table", "host_failed", "rule", "size", "shard", "_key", "_k1", "_k2", "v", "print", "root", "no", "leaf", "line", "target", "taken", "score", "predicted", "_plan", "_nth", "part", "drop", "bin_id", "_tag", "component_id", "epochs", "n_words", "_doc"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, 1, k % 2) for k in range(1, 8)] + [(None, None, None), (3, 0, None), (1, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def clashing(docs):
    return docs.withColumns({c: F.lit("clash") for c in CLASH})


DIGESTS = {
    "mix": lambda d, lab: mixing.mix(d),
    "quality": lambda d, lab: quality.judge(d),
    "shard": lambda d, lab: sharding.shard(d),
    "simhash": lambda d, lab: simhash.near_duplicates(d),
    "similar": lambda d, lab: similar.near_duplicates(d),
    "toxicity": lambda d, lab: toxicity.score(d, toxicity.train(d, lab)),
}


@pytest.mark.parametrize("name", DIGESTS)
def test_digest_has_a_row_per_row(docs, labels, name):
    found = DIGESTS[name](docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    assert DIGESTS[name](docs.limit(0), labels.limit(0)).count() == 0
    same = DIGESTS[name](clashing(docs), labels)
    assert sorted(map(str, same.collect())) == sorted(map(str, found)) or name == "shard"
    assert same.count() == len(ROWS)


def test_packing(docs):
    found = packing.pack(docs).collect()
    assert {str(r["doc_id"]) for r in found} == {str(r[0]) for r in ROWS}
    assert sum(r["n_words"] for r in found if r["doc_id"] == 4) == 80_000
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(clashing(docs)).count() == len(found)


def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, docs, labels, tmp_path, k):
    name, stage = stages()[k]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    n = out.count()
    if k < 4:
        assert out.columns == docs.columns
    if name in ("toxicity", "line dedup"):
        assert n == len(ROWS)
    if name == "near-duplicates":
        left = out.collect()
        assert sum(1 for r in left if not (r["text"] or "").strip()) == 1
        assert sum(1 for r in left if r["text"] == ROWS[0][1]) == 1
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    wide = stage(spark, clashing(docs), str(tmp_path))
    assert wide.count() == n
    if k < 4:
        assert wide.columns == clashing(docs).columns


def test_lines_of_odd_texts_are_untouched(docs):
    found = linededup.drop_recurring_lines(docs).collect()
    assert sorted(str(r["text"]) for r in found) == sorted(str(r[1]) for r in ROWS)
    assert all(r["_n_dropped"] == 0 for r in found)


def test_shards_on_disk(spark, docs, tmp_path):
    for k, d in enumerate((docs, clashing(docs))):
        sharding.write_shards(d, f"{tmp_path}/{k}")
        back = spark.read.parquet(f"{tmp_path}/{k}")
        name = "shard_" if k else "shard"
        assert back.columns == [*d.columns, name] and back.count() == len(ROWS)
        key = lambda rows: sorted((str(r["doc_id"]), str(r[name])) for r in rows)
        assert key(back.collect()) == sorted((str(r["doc_id"]), str(r["shard"])) for r in sharding.shard(docs).collect())
    sharding.write_shards(docs.limit(0), f"{tmp_path}/none")


def test_rows_without_an_id_are_taken_alike_on_reruns(spark):
    """A third of the rows have no id, many of them repeat: the same multiset whatever the partitions."""
    rows = [(None if k % 3 == 0 else k, f"word{k % 12 if k % 3 == 0 else k} and some more", "en", "a" if k % 2 else "b", 9) for k in range(300)]
    d = spark.createDataFrame(rows, SCHEMA)
    runs = [sorted(map(str, mixing.mix(d.repartition(n)).drop("_k1", "_k2").collect())) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 300
    keys = mixing._numbered(d.select("doc_id", F.lit(1).alias("_k1"), F.lit(2).alias("_k2"), F.lit(1).alias("size")).repartition(5))
    assert sorted(r["_copy"] for r in keys.where("doc_id is null").collect()) == list(range(100))


def test_search_keeps_large_vectors(spark):
    """Finite vectors of any size, in exact integers; scores beyond a long show its end."""
    rng = random.Random(6)
    rows = [(0, [1.0, 2.0]), (1, [300000.0, 1.0]), (2, [1.0, 1.0]), (50, [2.0**21, -(2.0**20)]), (3, [1e30, -5.0]), (4, [-1e30, 7.5]), (100, [3e29, 1.5])]
    rows += [(5 + k, [rng.choice([1.0, 2.0**18, 2.0**22, 2.0**27, 1e12]) * rng.uniform(-1, 1) for _ in range(2)]) for k in range(40)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    held = [(r["vec_id"], [math.floor(256 * Fraction(x)) for x in r["embedding"]]) for r in d.collect()]
    found = {}
    for r in mtree.top_k(d).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    low, high = -(1 << 63), (1 << 63) - 1
    for name, q in held:
        if name % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), k) for k, v in held if k != name)[:5]
            assert found[name] == [(k, min(max(-s, low), high)) for s, k in best]


def test_search(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, [1.0, 2.0]), (5, []), (100, [1.0]), (7, [3.0, 0.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = mtree.top_k(d).collect()
    first = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 0)
    best = 256 * 256 * 5
    assert first == [(1, 50, best), (2, 50, best), (3, None, best), (4, 7, 256 * 256 * 4)]
    assert not [r for r in found if r["query_id"] == 100]
    assert mtree.top_k(d.limit(0)).count() == 0
    wide = d.withColumns({c: F.lit("clash") for c in ("v", "tag", "dim", "centre", "sub", "far", "rank", "score", "block")})
    assert sorted(map(str, mtree.top_k(wide).collect())) == sorted(map(str, found))


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "x"), (None, 0, "user", "y"), (2, None, "user", "z"), (2, 0, None, None), (1, 0, "user", "hi"), (3, 0, "user", LONG), (3, 1, "tool", '{"broken'), (3, 2, "assistant", "{}")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.link(chat.exchanges(chat.events(d)), chat.EXCHANGE).collect()
    assert len(found) == len(rows)
    assert all(json.loads(r["json"]) is not None for r in found)
    assert sorted(r["position"] for r in found if r["conv_id"] == 1) == [0, 1, 2, 3]
    assert chat.link(chat.exchanges(chat.events(d.limit(0))), chat.EXCHANGE).count() == 0
    wide = d.withColumns({c: F.lit("clash") for c in ("kind", "call_id", "nth", "level", "status", "json", "position", "_tag")})
    assert chat.link(chat.exchanges(chat.events(wide)), chat.EXCHANGE).count() == len(rows)


def test_token_files(spark, docs, tmp_path):
    pytest.importorskip("public_tokenizers")
    clashing(docs).write.parquet(f"{tmp_path}/documents.parquet")
    found = op10_token_files(spark, str(tmp_path)).orderBy("start").collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    assert [r["doc_id"] for r in found][:2] == [None, None]
    assert [r["start"] for r in found] == [sum(r["n_tokens"] for r in found[:k]) for k in range(len(found))]
    clashing(docs).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op10_token_files(spark, f"{tmp_path}/none").count() == 0
