"""Operators against brute-force versions, exact round trips and held-out accuracy."""

import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalpanel.llm import bitpack, chat, components, linededup, mixing, mtree, packing, quality, sharding, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=3):
    """Texts of a small vocabulary, with exact copies, near copies and sources of uneven weight."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        if k and k % 7 == 0:
            text = rows[k - 1][1]
        if k and k % 11 == 0:
            parts = rows[k - 1][1].split()
            parts[len(parts) // 2] = "changed"
            text = " ".join(parts)
        rows.append((k, text, "en", f"s{k % 5 if k % 3 else 0}", len(text)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


# --- 1


def test_mix_meets_targets_and_order(docs, rows):
    found = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    target = {s: 0.0 for s in sizes}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    left, open_ = 1.5 * sum(sizes.values()), set(sizes)
    while True:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * rate >= 2 * sizes[s]}
        if not full:
            break
        left -= sum(2 * sizes[s] for s in full)
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    target |= {s: weight[s] * rate for s in open_}
    source = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in found:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(taken[s] == int(target[s] + 1e-9) for s in sizes)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))


def test_mixed_texts_hold_the_taken_words(docs):
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    assert out.select(F.sum(F.size(F.split("text", " ")))).first()[0] == taken


# --- 2


def test_line_templates(spark):
    rng = random.Random(1)
    prose = lambda: " ".join(f"p{rng.randint(0, 10**6)}x" for _ in range(12)).replace("0", "o").translate(str.maketrans("123456789", "abcdefghi"))
    rows = [(k, "\n".join([prose(), f"Posted by user {'abcdefghijklmnopqrst'[k]}{k} on day {k} of month {k % 12}", prose(), "All rights reserved by us"])) for k in range(20)]
    rows += [(100 + k, "\n".join([prose(), "All rights reserved by us"])) for k in range(3)] + [(200, "only one of this kind here\nAll rights"), (201, "a\n\nb")]
    found = {r["doc_id"]: r for r in linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0]["_n_dropped"] == 0  # the first occurrence stays
    assert all(found[k]["_n_dropped"] == 2 and found[k]["text"] == "\n".join(rows[k][1].split("\n")[::2]) for k in range(1, 20))
    assert all(found[k]["_n_dropped"] == 1 for k in (100, 101, 102))
    assert found[200]["text"] == rows[-2][1] and found[201]["text"] == "a\n\nb"


# --- 3


def links_of(prints, distance):
    root = {k: k for k in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    names = sorted(prints)
    for n, a in enumerate(names):
        for b in names[:n]:
            if sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True)) <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in prints}


def plain_print(text, size):
    """The fingerprint, bit by bit, from the shingles' hashes by the library itself."""
    import xxhash

    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [found[k : k + size] for k in range(len(found) - size + 1)] or ([found] if found else [])
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_prints_equal_the_plain_version():
    for text in [*(t for _, t, *_ in corpus(30)), "", " ", "one", "One TWO three", "É é A\x0bB\u00a0c d\u2003e f", "x " * 5000]:
        assert int(simhash.fingerprint(simhash.shingle_hashes(text, 4), 1)[0]) == plain_print(text, 4), text[:20]


@pytest.mark.parametrize(("size", "distance"), [(4, 4), (5, 3)])
def test_simhash_components(docs, rows, size, distance):
    prints = {k: [plain_print(t, size)] for k, t, *_ in rows}
    found = simhash.near_duplicates(docs, size, distance).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == links_of(prints, distance)
    assert all(r["fingerprint"] == f"{prints[r['doc_id']][0]:016x}" for r in found)


def test_block_tables_lose_no_pair():
    rng = random.Random(0)
    for rows in (10, 1 << 26, 1 << 35):
        tables = simhash.block_tables(rows, 4)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for bit in rng.sample(range(64), 4):
                y ^= 1 << bit
            assert any((x & m) == (y & m) for _, m in tables)


def test_large_buckets_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(2)
    base = rng.getrandbits(60)
    prints = {base ^ (1 << rng.randrange(13, 60)) ^ (1 << rng.randrange(13, 60)) for _ in range(80)} | {rng.getrandbits(60) for _ in range(40)}
    d = spark.createDataFrame([(p, [p]) for p in prints], "v long, print array<long>")
    found = components.components(simhash.links(d, 4, simhash.block_tables(len(prints), 4))).collect()
    expected = links_of({p: [p] for p in prints}, 4)
    groups, got = defaultdict(set), defaultdict(set)
    for p, r in expected.items():
        groups[r].add(p)
    for r in found:
        got[r["root"]].add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_one_of_each_group_stays(docs, rows):
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == set(links_of({k: [plain_print(t, 4)] for k, t, *_ in rows}, 4).values())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (7, 7), (None, 3)], "u long, v long")
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert found == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


# --- 4


def test_tool_calls(spark):
    call = lambda *calls: '{"tool_calls":[' + ",".join(calls) + "]}"
    one = lambda i, a, after="": f'{{"id":"{i}","name":"add","arguments":{a}{after}}}'
    rows = [
        (1, 0, "user", "please"), (1, 1, "assistant", call(one("b", '{"y":2,"x":1}', ',"after":["a"]'), one("a", '{"x": 1, "y": 2}'))),
        (1, 2, "tool", '{"tool_call_id":"b","content":"3"}'), (1, 3, "tool", '{"tool_call_id":"a","content":"3"}'), (1, 4, "tool", '{"tool_call_id":"zz","content":"?"}'),
        (1, 5, "assistant", call(one("a", '{"x":1,"y":2}'))), (1, 6, "assistant", call(one("c", '{"x":"1","z":0}'), one("d", "[1]"))),
        (1, 7, "assistant", call(one("e", '{"x":1,"y":1}', ',"after":["f"]'), one("f", '{"x":1,"y":1}', ',"after":["e"]'), '{"id":"g","name":"no","arguments":{}}')), (1, 8, "assistant", "done"),
    ]
    schemas = {"add": {"x": ("integer", True), "y": ("integer", True)}}
    d = chat.events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = sorted(chat.link(d, schemas).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in found] == list(range(len(found)))
    told = [(r["kind"], r["call_id"], r["status"], r["faults"]) for r in found]
    assert told[:5] == [("message", None, "message", ""), ("call", "a", "answered", ""), ("result", "a", "linked", ""), ("call", "b", "answered", ""), ("result", "b", "linked", "")]
    assert ("result", "zz", "orphan", "") in told and ("call", "a", "duplicate", "") in told
    assert ("call", "c", "invalid", "missing:y,type:x,unknown:z") in told and ("call", "d", "invalid", "json") in told
    assert ("call", "e", "cyclic", "") in told and ("call", "f", "cyclic", "") in told and ("call", "g", "invalid", "tool") in told
    assert found[3]["json"] == '{"arguments":{"x":1,"y":2},"call_id":"b","name":"add","role":"assistant"}'


def test_arguments_are_held_to_nested_schemas(spark):
    at = {"type": "object", "properties": {"city": {"type": "string"}, "it's": {"type": ["integer", "null"]}}, "required": ["city", "it's"], "additionalProperties": False}
    schema = {"type": "object", "properties": {"at": at, "unit": {"enum": ["C", "F", 1, None]}, "days": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}}}, "required": ["at"]}
    cases = [
        ({"at": {"city": "x", "it's": None}, "unit": "C", "days": [{"n": 1}, {"n": 2, "more": 0}], "more": 1}, ""),
        ({"at": {"city": 1, "sea": 2}, "unit": "K"}, "enum:unit,missing:at.it's,type:at.city,unknown:at.sea"),
        ({"days": [{"n": 1}, {"n": "2"}, {}, {"n": None}, 5]}, "missing:at,missing:days[].n,type:days[],type:days[].n"),
        ({"at": [], "days": {}}, "type:at,type:days"), ({"at": {"city": "", "it's": 2}, "unit": 1, "days": []}, ""), ({}, "missing:at"),
    ]
    call = lambda a: json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": a}]})
    found = linked(spark, [(k, 0, "assistant", call(a)) for k, (a, _) in enumerate(cases)], {"f": schema})
    assert [r["faults"] for r in found] == [told for _, told in cases]


def linked(spark, rows, schemas=None):
    d = chat.events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return sorted(chat.link(d, schemas or {"f": {}}).collect(), key=lambda r: (r["conv_id"], r["position"]))


def tool_call(name, *after):
    return json.dumps({"tool_calls": [{"id": name, "name": "f", "arguments": {}, "after": list(after)}]})


def test_long_chains_need_no_rounds(spark, monkeypatch):
    """A chain of 300 calls, each after the one before it, is in order as it stands."""
    rounds = []
    monkeypatch.setattr(chat, "cut", lambda d, plain=chat.cut: rounds.append(1) or plain(d))
    found = linked(spark, [(1, k, "assistant", tool_call(f"c{k}", *([f"c{k - 1}"] if k else []))) for k in range(300)])
    assert [r["call_id"] for r in found] == [f"c{k}" for k in range(300)] and {r["status"] for r in found} == {"unanswered"}
    assert len(rounds) < 15


def test_calls_come_after_all_that_they_wait_for(spark):
    """c waits for a, a for b, and b comes last: the order follows the whole chain."""
    rows = [(1, 1, "assistant", tool_call("a", "b")), (1, 2, "assistant", tool_call("c", "a")), (1, 3, "user", "hm"), (1, 5, "assistant", tool_call("b")), (2, 1, "assistant", tool_call("x", "x")), (2, 2, "assistant", tool_call("y", "x")), (2, 3, "assistant", tool_call("z", "none"))]
    found = linked(spark, rows)
    assert [r["call_id"] for r in found if r["conv_id"] == 1] == [None, "b", "a", "c"]
    assert {r["call_id"]: r["status"] for r in found if r["conv_id"] == 2} == {"x": "cyclic", "y": "cyclic", "z": "unanswered"}


# --- 5


def test_scores_equal_a_plain_noisy_or():
    model = toxicity.Model({"=vile": 7.0, "vile*": 1.5, "gri*": 2.0, "grim*": 4.0}, -5.0)
    for text in ["Vile things. Nothing here! grimly GRIM\nvile vilest", "no words. at all", "... !!", "", "vile", "a" * 9000 + " vile." * 300]:
        miss = 1.0
        for s in re.split(r"[.!?\n]+", text.lower()):
            found = re.findall(r"[^\W\d_]+", s)
            if found:
                told = {f for w in found for f in [f"={w}", *[f"{w[:k]}*" for k in toxicity.PREFIXES if len(w) > k]]}
                miss *= 1 - 1 / (1 + np.exp(-(-5.0 + sum(model.weights.get(f, 0.0) for f in told))))
        assert model.score(text)[0] == pytest.approx(1 - miss, abs=1e-9)


def test_fit_is_at_a_minimum_of_the_noisy_or_loss():
    """Finite differences of the plain loss (with the ridge) are about zero where the fit ends."""
    rng = np.random.default_rng(3)
    labels = (rng.random(200) < 0.3).astype(float)
    owner = np.repeat(np.arange(200), 3)
    column = np.where(rng.random(600) < 0.25 + 0.4 * labels[owner], 0, rng.integers(1, 4, 600))
    plain = rng.integers(0, 4, 200).astype(float)
    w, b = toxicity.fit_noisy_or(labels, plain, owner, np.arange(600), column, 4)

    def loss(x):
        total = np.bincount(owner, np.log1p(np.exp(x[4] + x[column])), 200) + plain * np.log1p(np.exp(x[4]))
        return np.where(labels == 1, -np.log(-np.expm1(-total)), total).mean() + toxicity.RIDGE / 400 * (x[:4] ** 2).sum()

    at = np.append(w, b)
    slope = [(loss(at + d) - loss(at - d)) / 2e-5 for d in 1e-5 * np.eye(5)]
    assert np.abs(slope).max() < 2e-3


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    plain, bad = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], ["vile", "nasty", "grimtoada", "grimtoadb", "grimtoadcc"]
    rows, labels = [], []
    for k in range(900):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randint(1, 12))]
        toxic = k % 4 == 0
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = f"{sentences[at]} {rng.choice(bad)}".upper()
        rows.append((k, ". ".join(sentences)))
        labels.append((k, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.score(d, toxicity.train(d, lab)).collect()
    truth = dict(labels)
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    for r in held:
        for span in r["offending"]:
            assert any(w.upper() in rows[r["doc_id"]][1][span["start"] : span["end"]] for w in bad)
    left = {r["doc_id"] for r in toxicity.drop_toxic(d, lab).collect()}
    assert left == {r["doc_id"] for r in found if not r["predicted"]}


def test_labels_of_the_held_out_fold_change_nothing(spark, docs):
    lab = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, toxic int")
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, lab) == toxicity.train(docs, flipped)


# --- 6


def plain_best_fit(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        fits = [k for k, b in enumerate(bins) if b["left"] >= size and cluster not in b["dup"] and b["src"][source] < per_source]
        left = min((bins[k]["left"] for k in fits), default=None)
        if left is None:
            bins.append({"left": capacity, "dup": set(), "src": Counter()})
            k = len(bins) - 1
        else:
            k = next(k for k in fits if bins[k]["left"] == left)
        bins[k]["left"] -= size
        bins[k]["dup"].add(cluster)
        bins[k]["src"][source] += 1
        out.append(left)
    return out, [b["left"] for b in bins]


def test_best_fit_is_tightest():
    rng = random.Random(4)
    for _ in range(30):
        n = rng.randint(1, 120)
        sizes = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        sources, clusters = [rng.randint(0, 3) for _ in range(n)], [rng.randint(0, n) for _ in range(n)]
        bins, offsets = packing.best_fit(sizes, sources, clusters, 100, 2)
        held = defaultdict(list)
        for k, b in enumerate(bins):
            before = [j for j in held[b]]
            assert offsets[k] == sum(sizes[j] for j in before) and offsets[k] + sizes[k] <= 100
            assert clusters[k] not in [clusters[j] for j in before] and [sources[j] for j in before].count(sources[k]) < 2
            able = [100 - sum(sizes[j] for j in js) for js in held.values() if js and 100 - sum(sizes[j] for j in js) >= sizes[k] and clusters[k] not in [clusters[j] for j in js] and [sources[j] for j in js].count(sources[k]) < 2]
            assert (not before and not able) or (100 - offsets[k]) == min(able)
            held[b].append(k)
        tight, left = plain_best_fit(sizes, sources, clusters, 100, 2)
        assert [None if o == 0 else 100 - o for o in offsets][:1] == tight[:1] == [None]
        assert len(left) <= len(held) + 2 and len(held) <= len(left) + 2  # ties among bins may part the two later


def test_packing_keeps_every_word(docs, rows):
    found = packing.pack(docs, capacity=50, per_source=2).collect()
    words = defaultdict(int)
    bins = defaultdict(list)
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    for r in found:
        words[r["doc_id"]] += r["n_words"]
        bins[r["bin_id"]].append(r)
    assert all(words[k] == len(text[k].split()) for k in text)
    for inside in bins.values():
        assert sum(r["n_words"] for r in inside) == inside[0]["bin_words"] <= 50
        assert len({text[r["doc_id"]] for r in inside}) == len(inside)
        assert max(Counter(source[r["doc_id"]] for r in inside).values()) <= 2


# --- 7


def test_quality_counts(spark):
    texts = ["a b c d e f a b c d e", "x\nx\n \n\nx y", "# $ a*b <|> &%", "one " * 30, "", "k l m n o k l m n o p q r s t u v w"]
    d = spark.createDataFrame([(k, t, "h") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in quality.judge(d).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if x.split()]
        r = found[k]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)


def test_bad_hosts_fail_with_their_documents(spark):
    rows = [(k, "good " + " ".join(f"w{j + k}" for j in range(20)), "good") for k in range(50)]
    rows += [(100 + k, "short", "bad") for k in range(45)] + [(200 + k, " ".join(f"v{j + k}" for j in range(20)), "bad") for k in range(5)]
    rows += [(300, " ".join(f"u{j}" for j in range(20)), None), (301, "few", None)]
    found = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(found[k] for k in range(50)) and not any(found[k] for k in range(100, 145)) and not any(found[200 + k] for k in range(5))
    assert found[300] and not found[301]


def test_small_hosts_are_shrunk_and_every_rule_has_its_rate(spark):
    """The same raw rate condemns a large host and not a small one; rates equal a plain version's."""
    fine = lambda k: " ".join(f"w{j + k}" for j in range(20))
    rows = [(k, fine(k), f"h{k % 10}") for k in range(600)]
    rows += [(1000 + k, "few" if k < 100 else fine(k), "large") for k in range(160)] + [(2000 + k, "few" if k < 5 else fine(k), "small") for k in range(8)]
    rows += [(3000 + k, fine(k) + " # # # # # # # # # # # #", "symbols") for k in range(60)] + [(4000 + k, fine(k) + "\nx\nx\nx\nx", "lines") for k in range(60)]
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    host = {r[0]: r[2] for r in rows}
    assert {host[r["doc_id"]] for r in found if r["host_failed"]} == {"large", "symbols", "lines"}
    counts = Counter(host.values())
    plain = [("few_words", h, n, {"large": 100, "small": 5}.get(h, 0)) for h, n in counts.items()]
    got = {r["_host"]: r for r in quality.shrunk_rates(spark.createDataFrame(plain, "rule string, _host string, docs long, failed long")).collect()}
    n, k = np.array([x[2] for x in plain], float), np.array([x[3] for x in plain], float)
    p = k.sum() / n.sum()
    excess = ((n * (k / n - p) ** 2).sum() / (p * (1 - p)) - (len(n) - 1)) / (n.sum() - (n**2).sum() / n.sum() - len(n) + 1)
    weight = min(1000.0, max(1.0, 1 / excess - 1))
    for x in plain:
        rate = (x[3] + p * weight) / (x[2] + weight)
        assert got[x[1]]["rate"] == pytest.approx(rate) and got[x[1]]["spread"] == pytest.approx((rate * (1 - rate) / (x[2] + weight + 1)) ** 0.5)
    assert got["small"]["rate"] - got["small"]["prior"] < got["large"]["rate"] - got["large"]["prior"]


# --- 8


def test_shards(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "PER_RANGE", 10)
    found = sharding.shard(docs).collect()
    order = sorted(((zlib.crc32(t.encode()), k, len(t.encode()) + 1) for k, t, *_ in rows))
    total, at, expected = sum(x[2] for x in order), 0, {}
    for _, k, size in order:
        expected[k] = (2 * at + size) * 16 // (2 * total)
        at += size
    assert {r["doc_id"]: r["shard"] for r in found} == expected
    told = {k: (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None) for k, t, *_ in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in found} == told
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == expected and back.count() == len(rows)


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """Keys that the first sample misses for their small share make a range that is sampled again."""
    monkeypatch.setattr(sharding, "PER_RANGE", 100)
    asked, plain = [], sharding._boundaries
    monkeypatch.setattr(sharding, "_boundaries", lambda rows, step, salt: asked.append((salt, rows)) or (plain(rows, step, salt).limit(2) if salt == "first" else plain(rows, step, salt)))
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(1000)], "doc_id long, text string")
    found = sharding.shard(docs).collect()
    assert [s for s, _ in asked] == ["first", "again"] and asked[1][1].count() > 0
    assert sorted(Counter(r["shard"] for r in found)) == list(range(16)) and max(Counter(r["shard"] for r in found).values()) < 70


# --- 9


@pytest.mark.parametrize("kind", ["random", "clusters", "copies"])
def test_top_k(spark, kind, monkeypatch):
    monkeypatch.setattr(mtree, "PART", 200)
    monkeypatch.setattr(mtree, "PAGE", 8)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 6))
    if kind == "clusters":
        x = rng.normal(size=(5, 6))[rng.integers(0, 5, 600)] + 0.01 * x
    if kind == "copies":
        x[:400] = x[0]
    x = x.astype(np.float32)
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    found = defaultdict(list)
    for r in mtree.top_k(d).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    for k in range(0, 600, 50):
        score = q @ q[k]
        best = sorted((-int(s), j) for j, s in enumerate(score) if j != k)[:5]
        assert found[k] == [(j, -s) for s, j in best]


def test_bounds_avoid_computations():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(20, 8))[rng.integers(0, 20, 5000)] * 4 + 0.05 * rng.normal(size=(5000, 8)))).astype(np.int64)
    tree = mtree.MTree(x)
    for k in range(20):
        tree.search(x[k], 5, np.arange(len(x)), k)
    assert tree.computed < 20 * len(x) / 2


# --- 10


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 24, 31])
def test_packed_images(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 4096, 9999):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        image = bitpack.Image(bitpack.write_image([None, 3, 4], np.array([0, n // 3, n // 3, n]), ids, bits))
        assert (image.ids() == ids).all() and len(image.document(1)) == 0 and (image.document(2) == ids[n // 3 :]).all()
        a, b = sorted(rng.integers(0, n + 1, 2))
        assert (image.ids(int(a), int(b)) == ids[a:b]).all()
    with pytest.raises(ValueError, match="image"):
        bitpack.Image(b"nothing of the kind at all")


ODD = ["", " ", "  ", " a", "a ", "a  b", "a\n\n b", "a\n \nb", "\n", "\nx y\n", "a\tb c", "x\r\ny", " \n", "don't we'll  'x", "a b 　c", "\x1cfoo \x1dbar a\x1c", "123 45a <|endoftext|> b", "é ñ \U0001f600 a\U0001f600 b‍", "!! ?? a!\x1c b", "﻿a b", "abc.,! d?e ª²x Ⅷ. ", "'s 'll. x's."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    coder, fresh = bitpack.Encoder(tokenizers.path(name)), Tokenizer.from_file(tokenizers.path(name))
    said = json.loads(fresh.to_str())
    for text in [*ODD, *[t for _, t, *_ in corpus(40)], " ".join(ODD)]:
        assert coder.encode(text).tolist() == fresh.encode(text, add_special_tokens=False).ids, text
    for token in said["added_tokens"]:
        for text in ("{}", "a {} b", "a{}b", "{} a", "a\n{}", "x y {}{} z", "a" * 500 + " {} b  c"):
            text = text.format(*[token["content"]] * 2)
            assert coder.encode(text).tolist() == fresh.encode(text, add_special_tokens=False).ids, text
    assert said["added_tokens"]


def test_encoder_remembers_within_bounds(monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(bitpack, "REMEMBERED", 50)
    monkeypatch.setattr(bitpack, "LONGEST", 40, raising=False)
    coder, fresh = bitpack.Encoder(tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    letters = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(400)]
    marks = ["!" * k + "," * (k % 7) + "$%&#*"[: k % 6] for k in range(1, 90)]
    texts = [" ".join(letters), "  ".join(letters), " ".join(f"w{m}" for m in marks), "\n".join(f"{a}{m}" for a, m in zip(letters, marks, strict=False)), "x" * 5000 + " y" + "z" * 41]
    for text in [*texts, *texts]:
        assert coder.encode(text).tolist() == fresh.encode(text, add_special_tokens=False).ids
        for known in (coder.spaced, coder.bare, coder.marks):
            assert len(known) <= 50 and max(map(len, known), default=0) <= 40


def test_token_files_read_back(spark, docs, rows, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.json")
    bitpack.write_token_files(docs, str(tmp_path / "ids"), path)
    found = {r["doc_id"]: r for r in bitpack.read_documents(spark, str(tmp_path / "ids")).collect()}
    from tokenizers import Tokenizer

    coder, at = Tokenizer.from_file(path), 0
    for k, text, *_ in rows:
        ids = np.append(coder.encode(text, add_special_tokens=False).ids, 0).astype("<u4")
        assert (found[k]["start"], found[k]["n_tokens"], found[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
