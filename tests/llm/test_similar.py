"""The pipeline's near-duplicates against brute-force Jaccard over whole shingle sets."""

import random

import pytest

import corpus_pipeline
from causalpanel.llm import similar

DOCS = "doc_id long, text string"


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def first_of_groups(texts):
    """The least id of each component of pairs at 0.8 or more."""
    root, sets = {k: k for k in texts}, {k: shingles(t.lower()) for k, t in texts.items()}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    names = sorted(texts)
    for n, a in enumerate(names):
        for b in names[:n]:
            both = len(sets[a] & sets[b])
            if 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(k) for k in texts}


def changed(rng, text, similarity):
    """``text`` with words replaced until its similarity is just at or below ``similarity``."""
    one, words, n = shingles(text), text.split(), 0
    while True:
        two = shingles(" ".join(words))
        if len(one & two) / len(one | two) <= similarity:
            return " ".join(words)
        words[rng.randrange(len(words))] = f"new{n}"
        n += 1


def texts_of(rng, count, length):
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(length)) for _ in range(count)]


def kept(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), DOCS).repartition(3)
    return {r["doc_id"] for r in corpus_pipeline.remove_near_duplicates(spark, docs, "").collect()}


def test_pairs_below_the_similarity_stay(spark):
    rng, texts = random.Random(1), {}
    for k, text in enumerate(texts_of(rng, 60, 300)):
        texts |= {2 * k: text, 2 * k + 1: changed(rng, text, 0.79)}
    assert kept(spark, texts) == first_of_groups(texts) == set(texts)


def test_no_pair_at_the_similarity_is_lost(spark):
    """Every pair just at 0.8 is found; the wide SimHash rule lost one in seven of them."""
    rng, texts = random.Random(2), {}
    for k, text in enumerate(texts_of(rng, 150, 300)):
        near = text.split()
        while True:
            other = [*near]
            other[rng.randrange(300)] = f"new{k}x{len(texts)}x{rng.random()}"
            one, two = shingles(text), shingles(" ".join(other))
            if len(one & two) / len(one | two) < 0.8:
                break
            near = other
        texts |= {2 * k: text, 2 * k + 1: " ".join(near)}
    assert kept(spark, texts) == first_of_groups(texts) == set(range(0, 300, 2))


@pytest.mark.parametrize("common", [2, 10**9])
def test_levels_and_large_groups_lose_nothing(spark, monkeypatch, common):
    monkeypatch.setattr(similar, "COMMON", common)
    monkeypatch.setattr(similar, "LARGE", 4)
    rng = random.Random(3)
    base = texts_of(rng, 4, 60)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = {}
    for k in range(160):
        text = base[k % 4] if k < 120 else " ".join(f"w{rng.randrange(5000)}" for _ in range(60)) + " " + passage
        texts[k] = changed(rng, text, rng.choice([0.95, 0.85, 0.75, 0.65])) if k < 120 else text
    texts |= {200: "a b c d", 201: "A  b c\nd", 202: "a b c d e", 203: "", 204: " \n", 205: base[0].upper()}
    assert kept(spark, texts) == first_of_groups(texts)
