"""Decontamination, URL filters, toxicity, quality rules and licence scans."""

import fnmatch
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from tests.llm.conftest import EDGE, WORDS, prose

from tessella.llm import decontaminate, licenses, quality, toxicity, urlfilter
from tessella.llm.queries import URL_RULES

BENCH = [(1, "Tom has 5 apples and gives 2 of them to Mary. How many apples does Tom have left after that?"), (2, prose(random.Random(1), 40)), (3, None), (4, ""), (5, "too short")]


def test_decontaminate(table, spark):
    rng = random.Random(2)
    verbatim, shuffled = BENCH[1][1], " ".join(rng.sample(BENCH[1][1].split(), 40))
    docs = [
        (1, prose(rng, 100)),
        (2, prose(rng, 50) + " " + verbatim + " " + prose(rng, 50)),
        (3, "Bob has 9 apples and gives 4 of them to Jane. How many apples does Bob have left after that?"),
        (4, BENCH[0][1].upper()),
        (5, shuffled),
        (6, " ".join(verbatim.split()[5:20])),
        (7, None),
        (8, prose(rng, 140000) + " " + verbatim),
    ]
    got = {r["doc_id"]: r["leak"] for r in decontaminate.decontaminate(table(docs), spark.createDataFrame(BENCH, "item_id long, text string")).collect()}
    assert {k for k, v in got.items() if v["contaminated"]} == {2, 3, 4, 6, 8}
    assert got[2]["items"] == [2] and got[3]["items"] == [1] and got[3]["reparameterised"] and not got[2]["reparameterised"]


def test_slots_must_be_consistent(table, spark):
    item = "if the first box holds 3 red pens and the other box holds 3 blue pens then how many"
    docs = [(1, item.replace("3", "7")), (2, item.replace("3", "7", 1).replace("3", "8"))]
    got = {r["doc_id"]: r["leak"]["contaminated"] for r in decontaminate.decontaminate(table(docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: True, 2: False}


def test_conflict_costs_only_its_own_windows(table, spark):
    rng = random.Random(4)
    item = "They counted 3 boats " + prose(rng, 20)[:-1] + " and again 3 boats " + prose(rng, 20)[:-1] + " while 9 men looked on from the old stone pier"
    edited = item.replace("3", "4", 1)
    docs = [(1, edited), (2, item.replace("9", "12").replace("3", "4", 1)), (3, prose(rng, 60))]
    # only the windows around 9 are left of the item
    end = " ".join(item.split()[-10:])
    docs += [(4, "if it has 3 then 3 " + end.replace("9", "12"))]
    got = {r["doc_id"]: r["leak"] for r in decontaminate.decontaminate(table(docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert {k: v["contaminated"] for k, v in got.items()} == {1: True, 2: True, 3: False, 4: True}
    assert got[2]["reparameterised"]


def test_items_of_few_words_and_many_values(table, spark):
    rng = random.Random(5)
    items = [
        (1, "Mix 5 kg flour, 3 kg sugar and 2 kg butter"),
        (2, "12 + 30 = 42, 17 + 25 = 42, 9 + 8 = 17"),
        (3, "Tom has 5 apples, Mary has 7 pears, Ann has 9 plums, Bob has 4 figs and Joe has none at all"),
        (4, "7 x 8 = 56"),
    ]
    around = lambda t: prose(rng, 30) + " " + t + " " + prose(rng, 30)
    docs = [(k, around(t)) for k, t in items]
    docs += [(11, around("Mix 6 kg flour, 3 kg sugar and 4 kg butter")), (12, around("12 + 31 = 43, 17 + 26 = 43, 9 + 9 = 18")), (14, around("7 x 9 = 63"))]
    docs += [(13, around("Jim has 6 apples, Eve has 8 pears, Kay has 2 plums, Max has 3 figs and Lee has none at all")), (15, around("MIX 5kg FLOUR, 3kg SUGAR and 2kg BUTTER"))]
    got = {r["doc_id"]: r["leak"] for r in decontaminate.decontaminate(table(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k: v["items"] for k, v in got.items() if v["contaminated"]} == {1: [1], 2: [2], 3: [3], 4: [4], 11: [1], 13: [3], 15: [1]}
    assert got[11]["reparameterised"] and got[13]["reparameterised"] and not got[1]["reparameterised"]


def brute_leaks(docs, items):
    """All windows of all documents against all windows of all items, template by template. Texts are plain words, numbers and names."""

    def tokens(text):
        out, begins = [], True
        for w in (text or "").split():
            core = w.rstrip(".")
            kind = "<num>" if core.isdigit() else ("<open>" if begins else "<name>") if core[0].isupper() else ""
            out.append((kind, core.lower()))
            begins = w.endswith(".")
        return out

    def windows(text, width):
        t, found = tokens(text), []
        if 0 < width < 3:
            return [(0, ("exact", *[x for _, x in t]), ())] if len(t) == width else []
        for at in range(len(t) - width + 1 if width else 0):
            for plain in (False, True):
                least = 5 if width == 8 else max(3, width - 3)
                word = [not k or (plain and k in ("<name>", "<open>")) for k, _ in t]
                end = at + width
                if sum(word[at:end]) < least:
                    if width < 8:
                        end = None
                    else:
                        end = next((e for e in range(at + 9, min(at + 32, len(t)) + 1) if sum(word[at:e]) == 5), None)
                    if plain:
                        found.append((at, ("exact", *[x for _, x in t[at : at + width]]), ()))
                if end and (not plain or any(k in ("<name>", "<open>") for k, _ in t[at:end])):
                    slots = [k + x for (k, x), w in zip(t[at:end], word[at:end]) if not w]
                    found.append((at, tuple(x if w else k for (k, x), w in zip(t[at:end], word[at:end])), tuple(slots)))
        return found

    out = {}
    for d, text in docs:
        leaked = set()
        for i, item in items:
            lines, width = {}, min(8, len(tokens(item)))
            for pos, template, slots in windows(text, width):
                for at, other, own in windows(item, width):
                    if template == other:
                        lines.setdefault(pos - at, []).append((own, slots))
            for met in lines.values():
                pairs = {p for own, slots in met for p in zip(own, slots)}
                left, right = [a for a, _ in pairs], [b for _, b in pairs]
                fits = lambda own, slots: own == slots or all(left.count(a) == 1 and right.count(b) == 1 for a, b in zip(own, slots))  # noqa: E731, B023
                if any(fits(own, slots) for own, slots in met):
                    leaked.add(i)
        out[d] = sorted(leaked)
    return out


def test_decontaminate_against_all_windows(table, spark, monkeypatch):
    rng = random.Random(12)
    few = WORDS[:9]

    def text(n):
        return " ".join(rng.choices([rng.choice(few), str(rng.randint(1, 4)), rng.choice(["Tom", "Ann", "Bob"])], [6, 2, 1])[0] + rng.choices(["", "."], [9, 1])[0] for _ in range(n))

    items = [(k, text(rng.randint(1, 20))) for k in range(25)] + [(30, "kilo"), (31, "lima mike"), (32, None), (33, "")]
    docs = [(k, text(rng.randint(1, 60))) for k in range(60)]
    for k in range(60, 110):  # items with other numbers and names, within other words
        t = " ".join(rng.choice([w, w, str(rng.randint(1, 4))]) if w.isdigit() else w for w in (rng.choice(items[:25])[1]).split())
        docs.append((k, rng.choice([t, text(9) + " " + t, t + " " + text(9)])))
    docs += [(120, "kilo"), (121, "Lima mike."), (122, "lima mike kilo"), (123, None)]
    want = brute_leaks(docs, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["leak"]["items"] for r in decontaminate.decontaminate(table(docs), bench).collect()}
    assert got == want and sum(map(bool, want.values())) > 25 and not all(want.values())


def test_pieces_change_nothing():
    """Windows and positions of a text that is cut are those of the whole text."""
    rng = random.Random(13)
    words = [rng.choice(["alpha", "bravo", "5", "kg", "7kg", "Tom", "-", ".", "delta.", "..."]).encode() for _ in range(400)] + [b"."] * 300 + [b"kg", b"echo"] * 40
    vocab = decontaminate.Words()

    def found(size):
        old, decontaminate.SLAB = decontaminate.SLAB, size
        try:
            out, past = [], 0
            for piece in decontaminate.pieces(0, words, vocab):
                t = decontaminate.Tokens([piece.words], vocab)
                lo, hi = np.searchsorted(t.word, [piece.own - piece.start, piece.end - piece.start])
                out += [(f, int(past + a - lo), int(n), int(h)) for f, at, ns, hs in t.windows(8) for a, n, h in zip(at, ns, hs) if lo <= a < hi]
                past += hi - lo
            return sorted(out)
        finally:
            decontaminate.SLAB = old

    assert found(1 << 17) == found(37) == found(100) == found(1)


def brute_url(url):
    _, mark, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if mark else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if mark else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    spam = any(fnmatch.fnmatchcase(host, g.host) for g in urlfilter.SPAM)
    return host, path, best and best.name, best.action if best else "block" if spam else "allow"


def test_url_verdicts(spark):
    rng = random.Random(3)
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/7", "http://com/en/", "http://xcom/en/", "ftp://a.example.net/de/8?x", "http://a.net/de/#y", "http://b.org/es", "http://b.org?/es/", "http://evil.io/x.com/en/", "http://Casino.example.fr/", "http://ü.com/en/ß", "http://a.com" + "/x" * 5000]
    urls += [f"http://{rng.choice(['a.', 'b.c.', ''])}{rng.choice(['example.com', 'example.net', 'example.org', 'ads-x.example.org', 'free-bets.io'])}{rng.choice(['/en/7', '/de/8', '/es/', '/fr/1', ''])}{rng.choice(['', '?q', '#f', '/more'])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as url_filter")
    got = {r["page_id"]: tuple(r["url_filter_"]) for r in urlfilter.url_verdicts(pages, URL_RULES).collect()}
    assert got == {k: brute_url(u) for k, u in enumerate(urls)}
    assert urlfilter.url_verdicts(pages.limit(0), URL_RULES).count() == 0


def test_automaton_against_fnmatch():
    rng = random.Random(6)
    pats = ["".join(rng.choice("ab*?") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    a = urlfilter.Automaton([urlfilter._elements(p, True) for p in pats])
    got = a.run([np.frombuffer(t.encode(), np.uint8).astype(np.uint16) for t in texts])
    assert got.tolist() == [[fnmatch.fnmatchcase(t, p) for p in pats] for t in texts]


def test_toxicity_held_out(table, spark):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(1200):
        bad = k % 4 == 0
        s = [prose(rng, 8) for _ in range(rng.randint(1, 12))]
        if bad:
            s[rng.randrange(len(s))] = "you " + rng.choice(["vermin", "verminous", "grobian"]) + rng.choice(["", "s", "ly"]) + " are here."
        docs.append((k, " ".join(s)))
        labels.append((k, 1, int(bad)))
    lab = spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.toxicity(table([*docs, (2000, None), (2001, "")]), lab).collect()}
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 4 == 2]
    right = sum((out[k]["score"] >= 0.3) == (k % 4 == 0) for k in held) / len(held)
    assert right > 0.97 and out[2000]["score"] == out[2001]["score"] == 0
    hit = next(k for k in held if k % 4 == 0 and out[k]["score"] >= 0.3)
    worst = max(out[hit]["sentences"], key=lambda s: s["score"])["number"]
    assert re.search("verm|grob", docs[hit][1].split(".")[worst])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["toxicity"]["score"] == 0 for r in toxicity.toxicity(table(docs[:5]), none).collect())


def test_noisy_or_gradient():
    """Against differences of the likelihood, document by document."""
    rng = np.random.default_rng(2)
    doc, sent = np.array([0, 0, 1, 2, 2, 2]), np.array([0, 0, 1, 2, 2, 3, 4, 5, 5])
    feat, yy = rng.integers(0, 4, 9), np.array([1, 0, 1])

    def loss(x):
        w, b, total = x[:-1], x[-1], 0.0
        for d in range(3):
            clean = 1.0
            for s in np.flatnonzero(doc == d):
                clean *= 1 - 1 / (1 + np.exp(-b - sum(w[f] for f in feat[sent == s])))
            total -= np.log(1 - clean) if yy[d] else np.log(clean)
        return total + toxicity.DECAY * (w @ w) / 2

    x = rng.normal(size=5)
    step = np.eye(5) * 1e-6
    assert np.allclose(toxicity.gradient(x[:-1], x[-1], doc, sent, feat, yy), [(loss(x + e) - loss(x - e)) / 2e-6 for e in step], atol=1e-5)


def test_training_and_scores_by_hand(table, spark):
    """Counts, screen, bags and scores in plain loops over the same documents."""
    rng = random.Random(18)
    docs = [(k, ". ".join(prose(rng, 6)[:-1] + (" vermin" if k % 3 == 0 and rng.random() < 0.7 else "") for _ in range(3))) for k in range(300)]
    y = {k: int("vermin" in t) for k, t in docs}
    labels = spark.createDataFrame([(k, 1, v) for k, v in y.items()], "doc_id long, quality int, toxic int")
    model = toxicity.train(table(docs), labels)
    learnt = [(k, t) for k, t in docs if zlib.crc32(str(k).encode()) % 4 != 2]
    n, n1 = len(learnt), sum(y[k] for k, _ in learnt)
    with_, kept = {}, []
    for k, t in learnt:
        for f in {f for w in re.findall(r"[a-z]+", t) for f in toxicity.features(w.encode())}:
            with_.setdefault(f, [0, 0])[y[k]] += 1
    for f, (c0, c1) in sorted(with_.items()):
        exp = [(c0 + c1) * (n - n1) / n, (c0 + c1) * n1 / n]
        g = 2 * sum(c * np.log(c / e) for c, e in zip((c0, c1), exp) if c)
        if c1 >= 3 and g >= 16 and c1 / n1 > 4 * c0 / (n - n1):
            kept.append(f)
    assert {*model.weights} <= {*kept} and kept
    out = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.scored(table(docs), model).collect()}
    for k, t in docs:
        clean = 1.0
        for sentence in t.split("."):
            got = [sum(model.weights.get(f, 0) for f in toxicity.features(w.encode())) for w in {*sentence.split()} if any(f in model.weights for f in toxicity.features(w.encode()))]
            if got:
                clean *= 1 - 1 / (1 + np.exp(-model.bias - sum(got)))
        assert np.isclose(out[k], 1 - clean)


def brute_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    cover = {j for k, x in enumerate(win) if win.count(x) > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len({*lines}), len(cover)


def test_quality(table):
    rng = random.Random(9)
    docs = [(k, "\n".join(prose(rng, rng.randint(5, 40)) for _ in range(rng.randint(3, 8))), rng.choice(["en", "de", None]), rng.choice(["a", "b"])) for k in range(400)]
    junk = {k: " ".join(w + "###|" for w in docs[k][1].split()) for k in range(0, 400, 40)}
    docs = [(k, junk.get(k, t), lang, src) for k, t, lang, src in docs] + [(500, None), (501, "a b c " * 40), (502, "x\nx\n y\n y\n\n\n")]
    got = {r["doc_id"]: r for r in quality.quality(table(docs)).collect()}
    for k, t, *_ in docs:
        s = brute_stats(t)
        assert tuple(got[k][c] for c in quality.FIELDS[:5]) == s
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        assert got[k]["base_failed"] == failed and not (failed and got[k]["kept"])
    good = [k for k in range(400) if k not in junk and not got[k]["base_failed"]]
    assert all(got[k]["kept"] for k in good) and not any(got[k]["kept"] for k in junk)


def det(x, noise, prior):
    """Log-determinant for a subset of rows, by its definition."""
    total = len(x) + prior.weight
    m = (x.sum(axis=0) + prior.weight * prior.mean) / total
    c = sum((np.outer(r - m, r - m) for r in x), prior.weight * (prior.cov + np.outer(prior.mean - m, prior.mean - m))) / total
    return np.linalg.slogdet(c + np.diag(noise))[1]


def test_mcd_is_the_least_of_all_subsets():
    rng = np.random.default_rng(0)
    priors = [quality.NONE, quality.Prior(5.0, np.array([1.0, 0, 0, 0]), np.diag([1.0, 2.0, 1.0, 1.0]), np.full(4, 0.01))]
    for k in range(12):
        x = rng.normal(size=(12, 4)) @ rng.normal(size=(4, 4))
        x[:3] += rng.normal(size=4) * 8
        noise, prior = np.full(4, 0.01), priors[k % 2]
        want = min(det(x[list(s)], noise, prior) for s in itertools.combinations(range(12), 9))
        got = quality.mcd(np.ones(12), x, np.zeros((12, 4, 4)), noise, prior, share=0.75)[2]
        assert np.isclose(got, want)
        # rows of one cell count like the rows themselves
        pairs = np.repeat(x, 2, axis=0) + rng.normal(size=(24, 4)) * 1e-9
        cells = quality.mcd(np.full(12, 2.0), x, np.zeros((12, 4, 4)), noise, prior)[2]
        assert np.isclose(cells, quality.mcd(np.ones(24), pairs, np.zeros((24, 4, 4)), noise, prior)[2])


def rows_of(spark, groups):
    data = [(f"v2:{g[0]}", g, *map(float, r), *[1e-4] * 4) for g, x in groups.items() for r in x]
    return spark.createDataFrame(data, ", ".join(["g0 string", "g1 string", *(f"{c}{i} double" for c in "xv" for i in range(4))]))


def test_estimates_find_the_bulk_and_lean_on_the_language(spark):
    rng = np.random.default_rng(0)
    clean = np.abs(rng.normal(size=(900, 4))) * [0.03, 0.1, 0.1, 0.1] + [2.3, 0.2, 0.1, 0.1]
    junk = rng.normal(size=(180, 4)) * 0.02 + [4.5, 0.9, 0.8, 0.7]
    got = {r["key"]: r for r in quality.estimates(rows_of(spark, {"a1": np.vstack((clean, junk)), "a2": clean[:2] + 0.3, "a3": clean[:1]})).collect()}
    assert got["a1"]["n"] == 1080 and np.allclose(got["a1"]["m"], clean.mean(axis=0), atol=0.05)
    assert np.allclose(got["a2"]["m"], got["a1"]["m"], atol=0.05)
    assert got["a3"]["n"] == 1


def test_covariance_decides(spark):
    """Two groups with the same means and variances: a row off the axis of one lies on that of the other."""
    rng = np.random.default_rng(1)
    t, e = rng.normal(size=(2, 1500)) * [[0.2], [0.01]]
    up = np.stack([3 + t, 1 + t + e, rng.normal(size=1500) * 0.05 + 0.3, rng.normal(size=1500) * 0.05 + 0.3], axis=1)
    down = up * [1, -1, 1, 1] + [0, 2, 0, 0]
    est = quality.estimates(rows_of(spark, {"a": up, "b": down}))
    probe = spark.createDataFrame([(3.4, 1.4, 0.3, 0.3), (3.4, 0.6, 0.3, 0.3)], "x0 double, x1 double, x2 double, x3 double")
    far = {(r["key"], r["x1"]): r["d"] for r in est.crossJoin(probe).select("key", "x1", quality._distance().alias("d")).collect()}
    assert max(far["a", 1.4], far["b", 0.6]) < quality.CUT / 2 and min(far["a", 0.6], far["b", 1.4]) > quality.CUT


def test_same_text_judged_by_its_group(table):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    text = lambda mean: " ".join(word(max(1, round(rng.gauss(mean, 1)))) for _ in range(200))
    docs = [(k, text(5), "aa", "s") for k in range(200)] + [(1000 + k, text(rng.uniform(4, 9)), "bb", "s") for k in range(200)]
    long_ = text(7.5)
    docs += [(2000, long_, "aa", "s"), (2001, long_, "bb", "s"), (2002, long_, None, "s"), (2003, long_, "cc", None)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(table(docs, extra=True)).collect()}
    assert not got[2000] and got[2001]
    assert sum(got[k] for k in range(200)) >= 199 and sum(got[1000 + k] for k in range(200)) >= 199


def test_licenses(table):
    mit = licenses.TEXTS["MIT"][0]
    docs = [
        (1, mit),
        (2, "The MIT Licence\r\n\r\nCopyright © 2021 Jane Doe. All rights reserved.\r\n\r\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE")),
        (3, licenses.TEXTS["BSD-3-Clause"][0].replace("1. ", "* ").replace("3. ", "* ")),
        (4, "code\n// SPDX-License-Identifier: Apache-2.0\nmore\nReleased under the MIT License."),
        (5, mit[:-30]),
        (6, None),
        (7, prose(random.Random(0), 30)),
    ]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(table(docs)).collect()}
    assert {k: v["name"] for k, v in got.items()} == {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: None, 5: None, 6: None, 7: None}
    assert got[4]["notices"] == ["Apache-2.0", "MIT"] and got[7]["notices"] == []


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts")
def test_long_licenses(table):
    found = {n: open(f"/usr/share/common-licenses/{n}", encoding="utf-8").read() for n in ("GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "Apache-2.0")}
    docs = [(k, t.replace("license", "licence").replace("\n", "\r\n  ")) for k, t in enumerate(found.values())]
    got = [r["license"]["name"] for r in licenses.scan(table(docs)).orderBy("doc_id").collect()]
    assert got == ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Apache-2.0"]


def test_licenses_of_the_caller(table, spark):
    mine = "My own licence.\n\n1. Do as you like."
    more = spark.createDataFrame([("Mine", mine), ("Later", mine.upper()), (None, "nameless"), ("Empty", None), ("My-MIT", licenses.TEXTS["MIT"][0])], "name string, text string")
    docs = table([(1, mine), (1, mine), (2, "Copyright 2021 Me\nMY OWN LICENSE\n(a) do as you like"), (3, licenses.TEXTS["MIT"][0]), (4, licenses.TEXTS["Zlib"][0]), (5, None), (6, "nameless"), (7, "x " * 100000)], extra=True)
    got = [(r["doc_id"], r["license_"]["name"]) for r in licenses.scan(docs, more).collect()]
    assert sorted(got) == [(1, "Later"), (1, "Later"), (2, "Later"), (3, "My-MIT"), (4, "Zlib"), (5, None), (6, None), (7, None)]


def test_edges(table, spark):
    docs, none = table(EDGE, extra=True), table([])
    bench, lab = spark.createDataFrame(BENCH, "item_id long, text string"), spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (lambda d: decontaminate.decontaminate(d, bench), lambda d: decontaminate.decontaminate(d, bench.limit(0)), lambda d: toxicity.toxicity(d, lab), quality.quality, licenses.scan):
        assert f(docs).count() == len(EDGE) and f(none).count() == 0
    assert "leak_" in decontaminate.decontaminate(docs, bench).columns
