"""The pipeline's stages, chained, against what each must keep of its own input."""

import random
from collections import defaultdict

import corpus_pipeline


def fixture(spark, folder):
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for k in range(150):
        lines = [line(rng.randint(10, 30)) for _ in range(3)]
        if k % 5 == 0:
            lines[1] += " vilely"
        if k % 3 == 0:
            lines.append("subscribe to our weekly letter now")
        rows.append([k, "\n".join(lines), "en", f"s{k % 4}"])
        labels.append((k, 1, int(k % 5 == 0)))
    for k in range(150, 160):  # exact and near copies of clean documents
        text = rows[k - 149][1]
        rows.append([k, text if k % 2 else text + " end", "en", "s0"])
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {r[0]: r[1] for r in rows}


def test_stages_in_order(spark, tmp_path):
    texts = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        found.append(spark.read.parquet(f"{tmp_path}/{k}"))
    first, clean, cut, single, mixed, packed = (d.collect() for d in found)
    assert all(d.columns == docs.columns for d in found[:5])
    assert {r["doc_id"] for r in clean} == {k for k, t in texts.items() if "vilely" not in t}
    assert {r["doc_id"] for r in cut} == {r["doc_id"] for r in clean}
    holders = [r["doc_id"] for r in cut if "weekly letter now" in r["text"].split("\n")[-1][-17:]]
    assert holders == [min(r["doc_id"] for r in clean if "weekly letter" in r["text"])]
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    sets = {r["doc_id"]: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in cut for w in [r["text"].lower().split()]}
    kept = {r["doc_id"] for r in single}
    assert kept & set(range(150)) == {r["doc_id"] for r in cut if r["doc_id"] < 150}
    for k in sets.keys() - kept:
        assert any(len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j]) for j in kept)
    assert len(mixed) > 0 and {r["doc_id"] for r in mixed} <= kept
    words = defaultdict(int)
    for r in mixed:
        words[r["doc_id"]] += len(r["text"].split())
    got = defaultdict(int)
    for r in packed:
        got[r["doc_id"]] += r["n_words"]
    assert got == words
    assert len(first) == len(texts)


def test_run(spark, tmp_path):
    """The chain gives what its stages give one by one: the same words of the same documents."""
    fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    words = lambda d: sorted(map(str, d.groupBy("doc_id", "piece", "n_words").count().collect()))
    assert words(corpus_pipeline.run(spark, str(tmp_path))) == words(docs) != []
