"""SimHash, near-duplicates, substring and line dedup against brute force."""

import hashlib
import random
import re
import sys

import numpy as np
import pytest
import xxhash
from tests.llm.conftest import EDGE, prose

from tessella.llm import linededup, simhash, substringdedup
from tessella.llm.components import components


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def brute_fp(text):
    w = words(text)
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def smallest(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def test_simhash_components(table):
    rng = random.Random(5)
    docs = [(k, prose(rng, rng.randint(1, 60))) for k in range(60)]
    for k in range(60, 140):  # copies, case changes, and edits of the last word
        t = docs[rng.randrange(60)][1]
        docs.append((k, rng.choice([t, t.upper(), t + " extra", re.sub(r"\s", "\t", t)])))
    docs += [(200, ""), (201, None), (202, " \n")]
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(table(docs)).collect()}
    fps = {k: brute_fp(t) for k, t in docs}
    links = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3]
    comp = smallest(links, fps)
    assert got == {k: (fps[k], comp[k]) for k in fps}
    assert len({*comp.values()}) < len(comp) and got[202] == (0, 200)


def test_links_of_hot_buckets(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base ^ (rng.getrandbits(40) << 8) & 0xFFFFFFFFFFFFFFFF for _ in range(300)}
    fps |= {f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in [*fps][:60]}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.fingerprint_links(df, 3, hot=50).collect()]
    want = [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in got)
    assert smallest(got, fps) == smallest(want, fps)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (7, 8)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("radius", "width"), [(0, 1), (3, 1), (60, 4)])
def test_bit_sliced_comparison(radius, width):
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, (30, width), dtype=np.uint64)[rng.integers(0, 30, 500)]
    for _ in range(2 if width == 1 else 40):
        f[np.arange(500), rng.integers(0, width, 500)] ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    key = np.sort(rng.integers(0, 6, 500))
    got = {(int(a), int(b)) for i, j in simhash.close_pairs(key, f, radius, slab=300) for a, b in zip(i, j)}
    assert got == {(a, b) for a in range(500) for b in range(a + 1, 500) if key[a] == key[b] and int(np.bitwise_count(f[a] ^ f[b]).sum()) <= radius}


def test_near_duplicates(table):
    rng = random.Random(3)
    docs = [(k, prose(rng, rng.randint(40, 200))) for k in range(40)]
    for k in range(40, 120):
        w = docs[rng.randrange(40)][1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((k, " ".join(w)))
    docs += [(300, "too short"), (301, "Too  short"), (302, None), (303, "")]
    sets = {k: {tuple(words(t)[j : j + 5]) for j in range(max(1, len(words(t)) - 4))} if words(t) else set() for k, t in docs}
    sim = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    comp = smallest([(a, b) for a in sets for b in sets if a < b and sim(sets[a], sets[b]) >= 0.8], sets)
    got = {r["doc_id"]: r["class_id"] for r in simhash.near_duplicates(table(docs)).collect()}
    assert got == comp
    # hot buckets in tiles find the same
    assert {r["doc_id"]: r["class_id"] for r in simhash.near_duplicates(table(docs), tile=5).collect()} == comp
    kept = simhash.one_of_each(table(docs, extra=True))
    assert {r["doc_id"] for r in kept.collect()} == {k for k in comp if comp[k] == k} and "near_row" in kept.columns
    again = [(1, "b c d e f g"), (1, "b c d e f g"), (1, "other words are here now"), (None, None), (None, None)]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.one_of_each(table(again)).collect()) == [(0, None), (1, "b c d e f g"), (1, "other words are here now")]


def test_near_duplicates_among_many_poor_pairs(table):
    """Variants of one text, nearly all of them just below the threshold: rejected candidates may not crowd out the few links."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(400)]
    docs = []
    for k in range(500):
        w = base.copy()
        for p in rng.sample(range(2, 400, 5), 6):
            w[p] = f"v{k}x{p}"
        docs.append((k, " ".join(w)))
    number: dict = {}
    at = [[number.setdefault(tuple(w[j : j + 5]), len(number)) for j in range(396)] for w in (t.split() for _, t in docs)]
    held = np.zeros((len(docs), len(number)), np.float32)
    for k, x in enumerate(at):
        held[k, x] = 1
    both = held @ held.T
    i, j = np.nonzero(np.triu(both >= 0.8 * (2 * 396 - both), 1))
    comp = smallest(list(zip(i.tolist(), j.tolist())), range(len(docs)))
    assert len(i) > 50 and len({*comp.values()}) > 300
    assert {r["doc_id"]: r["class_id"] for r in simhash.near_duplicates(table(docs)).collect()} == comp


def test_poor_pairs_do_not_travel(table, monkeypatch):
    """Variants of one text that lie within the radius but below the threshold: no table holds more rows than a few for each document; tiles find the same."""
    rng = random.Random(13)
    base = [f"w{k}" for k in range(200)]
    docs = []
    for k in range(400):
        w = base.copy()
        for p in rng.sample(range(2, 200, 5), 6):
            w[p] = f"v{k}x{p}"
        docs.append((k, " ".join(w)))
        if k % 40 == 0:
            docs.append((1000 + k, " ".join([*w, "end"])))
    seen = []
    real = simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df: seen.append(real(df)) or seen[-1])
    monkeypatch.setattr(simhash, "discard", lambda df: None)
    sets = {k: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for k, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    comp = smallest(links, sets)
    assert len({*comp.values()}) > 100 and sum(comp[k] == comp[1000 + k] for k in range(0, 400, 40)) == 10
    assert {r["doc_id"]: r["class_id"] for r in simhash.near_duplicates(table(docs)).collect()} == comp
    # a row is in 40 buckets, and none of them adds more than a row to it
    assert max(df.count() for df in seen) <= 40 * len(docs)
    monkeypatch.setattr(simhash, "TILE_BYTES", 100_000)
    assert {r["doc_id"]: r["class_id"] for r in simhash.near_duplicates(table(docs)).collect()} == comp


def test_wide_fingerprints(monkeypatch):
    rng = random.Random(21)
    texts = [prose(rng, n) for n in (1, 4, 5, 6, 18, 19, 20, 34, 35, 300, 2000, 9000)] + ["", " \n", "word " * 400, prose(rng, 40)]
    monkeypatch.setattr(simhash, "STEP", 4000)
    calls = []
    real = simhash.majorities
    monkeypatch.setattr(simhash, "majorities", lambda *x: calls.append(len(x[1])) or real(*x))
    got = simhash.wide_fingerprints([x.encode() for x in texts], 5, 3)
    for text, (digest, wide, n) in zip(texts, got, strict=True):
        w = words(text)
        grams = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        h = np.array(sorted(xxhash.xxh64_intdigest(g.encode(), 42) for g in grams), np.uint64)
        assert n == len(h) and digest == (xxhash.xxh3_128_digest(h.tobytes()) if n else b"")
        bits = [2 * sum(int(z) >> b & 1 for z in simhash.mixed(h, k)) > n for k in range(3) for b in range(64)]
        assert wide == np.packbits(bits, bitorder="little").tobytes()
    assert max(calls) > 5  # many texts at once


def test_shingle_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 80), dtype=np.uint64)) for _ in range(40)] + [np.array([10**6], np.uint64)] * 2 + [np.array([7 * 10**6], np.uint64)]
    found = simhash.ShingleSets(sets)
    want = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))
    for i in range(42):
        for j in (np.arange(i + 1, 43), np.arange(i + 1, 43, 9), np.array([42])):
            assert found.similar(i, j, 0.6).tolist() == [want(i, k) for k in j]


def brute_removed(docs):
    first = {}
    for k, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], k)
    out = {}
    for k, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < k:
                gone[s : s + 50] = [True] * 50
        runs = sum(g and (s == 0 or not gone[s - 1]) for s, g in enumerate(gone))
        out[k] = (len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g))
    return out


def test_substring_dedup(table):
    rng = random.Random(7)
    docs = [(k, prose(rng, rng.randint(5, 120))) for k in range(40)]
    for k in range(40, 100):  # copies, passages at any offset, repeats within a text
        a, b = rng.choice(docs)[1], rng.choice(docs)[1]
        s = rng.randrange(len(a))
        docs.append((k, rng.choice([a, a[s : s + rng.randint(40, 200)] + b, b + "é" + a[s:], a * 2, "ab" * rng.randint(20, 80)])))
    docs += [(200, None), (201, ""), (202, "x" * 49), (203, "x" * 50), (204, "x" * 51), (205, "é" * 300), (206, "é" * 30)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substringdedup.substring_dedup(table(docs, extra=True)).collect()}
    assert got == brute_removed(docs)


def test_suffix_groups_sort():
    rng = random.Random(2)
    raw = "".join(rng.choice("ab") for _ in range(900)).encode() + b"ab" * 400 + bytes(range(97, 123)) * 10
    at = np.array(rng.sample(range(len(raw) - 50), 700))
    order, group = substringdedup.suffix_groups(raw + bytes(64), at)
    strings = [raw[at[k] : at[k] + 50] for k in order]
    assert strings == sorted(strings)
    assert [group[k] for k in range(1, 700) if strings[k] == strings[k - 1]] == [group[k - 1] for k in range(1, 700) if strings[k] == strings[k - 1]]
    assert len({*group.tolist()}) == len({*strings})


def test_suffix_groups_by_bucket():
    rng = random.Random(6)
    raw = "".join(rng.choice("ab") for _ in range(300)).encode() * 3 + b"c" * 90 + bytes(64)
    at = np.array(sorted(range(800), key=lambda k: raw[k : k + 2]))
    firsts = [raw[k : k + 2] for k in at.tolist()]
    starts = np.array([k for k in range(800) if not k or firsts[k] != firsts[k - 1]])
    order, group = substringdedup.suffix_groups(raw, at, starts)
    strings = [raw[at[k] : at[k] + 50] for k in order]
    assert strings == sorted(strings)
    assert group.tolist() == [strings.index(x) for x in strings]


def test_sorting_repeated_windows_takes_few_calls():
    """A passage that very many documents hold is sorted by array operations, not string by string."""
    rng = random.Random(12)
    part = "".join(rng.choice("abcdef") for _ in range(70)).encode()
    raw = b"".join(part[: rng.randint(55, 70)] + bytes([97 + k % 26]) * 60 for k in range(4000)) + bytes(64)
    at = np.arange(0, len(raw) - 120, 13)
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event == "call"

    sys.setprofile(count)
    try:
        order, group = substringdedup.suffix_groups(raw, at)
    finally:
        sys.setprofile(None)
    strings = [raw[at[k] : at[k] + 50] for k in order]
    assert strings == sorted(strings) and len({*group.tolist()}) == len({*strings}) < len(at) / 2
    assert calls[0] < len(at) / 10


def test_substring_dedup_of_a_hot_passage():
    """An anchor with more windows than a batch goes bucket by bucket, and none of its windows is lost."""
    rng = np.random.default_rng(4)
    anchor = np.sort(np.concatenate((np.zeros(500, np.int64), rng.integers(1, 40, 300))))
    count = rng.integers(1, 32, 800)
    offset = rng.integers(count - 1, 31)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(substringdedup, "SORT", 600)
        seen = {}
        for seg, k, starts in substringdedup.windows_of(np.arange(800), offset, count, anchor):
            assert len(seg) <= 600
            bucket = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(seg))))
            for b, s, w in zip(bucket.tolist(), seg.tolist(), k.tolist()):
                assert (s, w) not in seen
                seen[s, w] = (anchor[s], offset[s] - w)
            assert len({*zip(bucket.tolist(), (seen[x] for x in zip(seg.tolist(), k.tolist())))}) == len(starts)
    every = {(s, w): (anchor[s], offset[s] - w) for s in range(800) for w in range(count[s])}
    alone = [x for x in every if x not in seen]
    held = [*every.values()]
    assert all(held.count(every[x]) == 1 for x in alone) and all(seen[x] == every[x] for x in seen)


def test_line_dedup(table):
    rng = random.Random(4)
    lines = ["Short", "a longer line", "A LONGER LINE", " \ta longer line ", "ünïcödé lïn", "ééééé", "0123456789", "", "another one here", "last line of all"]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8)))) for k in range(50)] + [(60, None), (61, ""), (62, "only once in here\nonly once in here")]
    key = lambda x: lower(x.strip(" \t\n\r\x0b\x0c"))
    where = {}
    for k, t in docs:
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(k)
    want = {}
    for k, t in docs:
        every = (t or "").split("\n")
        stay = [x for x in every if len(key(x)) < 10 or len(where[key(x)]) < 2 or min(where[key(x)]) == k]
        want[k] = ("\n".join(stay), len(every), len(every) - len(stay))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.line_dedup(table(docs, extra=True)).collect()}
    assert got == want


def test_perfect_hash_and_index():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    h = linededup.PerfectHash(keys)
    assert sorted(h(keys)) == list(range(len(keys)))
    k, p = np.array([5, 5, 9, 5], np.uint64), np.array([1, 1, 2, 3], np.uint64)
    index = linededup.LineIndex(k, p, np.array([7, 4, 8, 6]), np.array([0, 0, 1, 0], np.uint8))
    count, first = index.probe(np.array([5, 9, 5, 1], np.uint64), np.array([1, 2, 3, 1], np.uint64))
    assert count.tolist()[:3] == [2, 2, 1] and first.tolist()[:3] == [4, 8, 6] and count[3] == 0
    # two keys whose mixtures agree lie beside the arrays
    a = np.array([1, 2], np.uint64)
    b = a * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(77)
    index = linededup.LineIndex(a, b, np.array([1, 2]), np.array([0, 1], np.uint8))
    assert index.probe(a, b)[0].tolist() == [1, 2]


def test_edges(table):
    docs = table(EDGE, extra=True)
    n = len(EDGE)
    assert simhash.simhash_components(docs).count() == n
    assert simhash.near_duplicates(docs).count() == n
    assert substringdedup.substring_dedup(docs).count() == n
    assert linededup.line_dedup(docs).count() == n
    none = table([])
    for f in (simhash.simhash_components, simhash.near_duplicates, simhash.one_of_each, substringdedup.substring_dedup, linededup.line_dedup):
        assert f(none).count() == 0


def test_query_columns(spark, tmp_path, table):
    from tessella.llm.queries import QUERIES

    table([(1, "The quick brown fox"), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in QUERIES["op1_simhash"](spark, str(tmp_path)).collect()}
    assert rows[2]["fingerprint"] == "0" * 16 and rows[1]["fingerprint"] == f"{brute_fp('The quick brown fox'):016x}"
    rows = {r["doc_id"]: r for r in QUERIES["op2_substring_dedup"](spark, str(tmp_path)).collect()}
    assert rows[1]["kept_sha256"] == hashlib.sha256(b"The quick brown fox").hexdigest() and rows[2]["n_bytes"] == 0
