"""SimHash near-duplicates, the conversation trie and periodic runs against brute force."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import conversation_trie, near_dedup, periodic_runs, simhash_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, ddl="doc_id long, text string"):
    return spark.createDataFrame(rows, ddl)


def roots(nodes, links):
    """The smallest node that each one reaches."""
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


# ---- op11


def brute_print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(prints):
    ids = sorted(prints)
    return roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 3])


def test_simhash_groups(spark):
    edges = [None, "", " \n", "one", "ONE", "one two", "one two three", "a b c a b c a b c", "é😀 É x", "\x1c a\x85b c", " ".join(f"w{i % 977}" for i in range(30_000)), "w " * 400]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("fp"), F.lit("x").alias("key"))
    texts = {r.doc_id: r.text for r in docs.collect()} | {9000 + i: t for i, t in enumerate(edges)}
    d = frame(spark, [(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, fp int, key string").repartition(5)
    got = simhash_dedup.report(d).collect()
    want = {i: brute_print(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{x:016x}" for i, x in want.items()} and len(got) == len(want)
    assert {r.doc_id: r.component_id for r in got} == near(want)


@pytest.mark.parametrize("bucket", [3, 256])
def test_simhash_links_in_hot_buckets(spark, bucket):
    """Fingerprints about a few centres, so that buckets are cut again, and pairs at each distance across the segments' edges."""
    rng = random.Random(3)
    prints = set()
    for centre in (rng.getrandbits(64) for _ in range(3)):
        for _ in range(250):
            x = centre
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    for _ in range(100):
        x = rng.getrandbits(64)
        prints |= {x, x ^ sum(1 << b for b in rng.sample([0, 7, 8, 15, 16, 31, 32, 47, 48, 63], rng.choice([3, 4])))}
    signed = [int(np.uint64(x).astype(np.int64)) for x in prints]
    d = frame(spark, [(x,) for x in signed], "fp long")
    links = simhash_dedup._links(simhash_dedup._variants(d, 0), 0, simhash_dedup.SimHash(bucket=bucket)).distinct()
    found = {r.id: r.component for r in near_dedup.components(links).collect()}
    want = roots(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if simhash_dedup.forest(np.array([a, b], dtype=np.int64))])
    assert {x: found.get(x, x) for x in signed} == want


def test_simhash_of_repeated_rows_and_nothing(spark):
    d = frame(spark, [(1, "a b c d"), (1, "a"), (2, "A b C d"), (None, "a b c d"), (None, "a b c d"), (3, "q r s t u v")])
    got = sorted((tuple(r) for r in simhash_dedup.report(d).select("doc_id", "component_id", "n_shingles").collect()), key=repr)
    assert got == sorted([(1, 1, 2), (2, 1, 2), (3, 3, 4), (None, None, 2), (None, None, 2)], key=repr)
    assert simhash_dedup.report(d.limit(0)).collect() == []


# ---- op12


def brute_trie(rows, rebuild=True):
    """rows: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    digest = lambda r: hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", digest(r))):
        if r[0] is not None:
            own[r[0]].append((r[2] or "", r[3] or ""))
    convs = dict(own)
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        convs = {c: own.get(c - c % 5, [])[: h[c]] + t[h[c] :] for c, t in own.items()}
    members = collections.defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * len(p[-1][1].encode() if p else b"") + sum(saved[x] for x in children[p])
        ends = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURN = "conv_id long, turn long, role string, text string"


def told(d):
    return sorted((tuple(r) for r in d.select(*NODE).collect()), key=repr)


def test_trie_of_rebuilt_conversations(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice("ua"), rng.choice("xyé")) for c in range(60) for t in range(rng.choice([1, 2, 3, 5, 9, 20])) if c % 7]
    rows += [(70, None, None, None), (70, None, "u", None), (70, 3, "u", "x"), (70, 3, "u", "x"), (None, 1, "u", "x"), (71, 5, "a", "long " * 5000)]
    d = frame(spark, [(*r, 1, "n") for r in rows], TURN + ", depth int, name string").repartition(4)
    assert told(conversation_trie.report(d)) == brute_trie(rows)


def test_trie_of_long_and_equal_conversations(spark, monkeypatch):
    """A path deeper than a chunk, one conversation many times over, ids of several chunks."""
    monkeypatch.setattr(conversation_trie, "ENDS", 8)
    monkeypatch.setattr(conversation_trie, "DEPTHS", 16)
    rng = random.Random(2)
    long = [(rng.choice("ua"), rng.choice("xy")) for _ in range(77)]
    convs = {c: long[: rng.choice([3, 40, 77])] + [("u", str(c))] * (c % 3) for c in range(12)} | {c: [("u", "same"), ("a", "again")] for c in range(20, 60)}
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    assert told(conversation_trie.trie(frame(spark, rows, TURN))) == brute_trie(rows, rebuild=False)
    assert conversation_trie.report(frame(spark, [], TURN)).collect() == []


# ---- op13


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted((i, n, q) for (i, n), q in out.items())


def brute_report(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, s = g % n, w[:]
        p = 1 + (n - a) // (3 + g % 8)
        w = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark):
    rng = random.Random(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs if r.text.count(" ") < 1500]
    for i in range(300):
        w = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.choice([0, 5, 6, 7, 30, 120]))]
        a, p = rng.randrange(len(w) + 1), rng.randint(1, 12)
        rows.append((5000 + i, rng.choice([" ", "\n", "\t "]).join(w[:a] + (w[a : a + p] * 9)[: rng.randint(4, 100)] + w[a:])))
    rows += [(None, "a b " * 20), (None, "a b " * 20), (9001, None), (9002, " \n"), (9003, "é 😀 " * 9), (9003, "x"), (9004, "w " * 3000), (9005, "\x85 \x1c " * 7)]
    got = [tuple(r) for r in periodic_runs.report(frame(spark, [(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(5)).collect()]
    assert sorted(got, key=repr) == sorted((brute_report(i, t) for i, t in rows), key=repr)
    assert periodic_runs.report(frame(spark, [])).collect() == []


def test_runs_of_long_texts(monkeypatch):
    """Work in proportion to n log n, and the same runs whether or not keys can be packed."""
    rng = random.Random(2)
    root = [b"%d" % rng.randrange(50) for _ in range(5000)]
    texts = [[b"a"] * 60_000, root * 5, root + root[:50], [b"a", b"b"] * 700 + root]
    found = periodic_runs.runs_of(texts, periodic_runs.Runs())
    assert found[0] == [(0, 60_000, 1)] and (0, 25_000, 5000) in found[1] and found[3][0] == (0, 1400, 2)
    monkeypatch.setattr(periodic_runs, "_PACKED", 0)
    assert periodic_runs.runs_of(texts[1:], periodic_runs.Runs()) == found[1:]


def test_store_of_members_is_compacted():
    """A text that is split at every length moves more members than the store has room for."""
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 6000:
        a, b = b, b + a  # the Fibonacci word: repetitions of exponent under four, refined to the end
    assert [r for r in periodic_runs.runs_of([b], periodic_runs.Runs(least=2, powers=3))[0][:200] if r[1] < 3 * r[2]] == []
    small = b[:300]
    assert periodic_runs.runs_of([small], periodic_runs.Runs())[0] == sorted(brute_runs(small), key=lambda r: (r[0], r[2]))


def test_pairs_that_share_too_little_after_their_first_shingle_are_not_made(spark):
    """Classes that lose partners keep few shingles in common: those of a hot one are compared only where enough can follow it."""
    few, many, plain, gone = range(10), range(10, 210), range(210, 430), {}
    base, hot = list(range(87)), list(range(1000, 1005))
    sets = {i: base + hot + [2000 + 20 * i + k for k in range(8)] for i in few}
    sets |= {i: base[:80] + hot + [2000 + 20 * i + k for k in range(15)] for i in many}
    sets |= {i: base + [2000 + 20 * i + k for k in range(13)] for i in plain}  # so that the hot shingles are the rarer ones
    for i in list(sets):  # each own part is also held by a class that can't be linked
        part = [h for h in sets[i] if h >= 2000]
        gone[1000 + i] = part + base[: 65 - len(part)] + [100_000 + 40 * i + k for k in range(35)]
    sets |= gone
    content = spark.createDataFrame([(i, np.sort(np.array(s, dtype="<u8")).tobytes()) for i, s in sets.items()], "id long, set binary")
    classes = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "id long, n long")
    buckets = spark.createDataFrame([(1, i, 0) for i in sets], "bucket long, id long, hub long")
    label = spark.createDataFrame([], "id long, component long")
    pairs = near_dedup._open_pairs(buckets, label, classes, content, near_dedup.NearDup(percent=80, rounds=1))
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for a in few for b in few if a < b]
