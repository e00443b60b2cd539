"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm import bpe, chat, exact, licenses, neardup, packing, quality, token_counts, topk, urls
from kindred.llm.common import word_hashes

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " \n\t ", "a", "A b", "The quick brown fox", "the QUICK brown fox", "é ß 漢字 \x1c x\xa0y", "<|endoftext|> it's 12,5 </w>", "word " * 5000 + "end", "q" * 3000, "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten"]
#: Columns whose names clash with those that operators make.
SCHEMA = "doc_id long, text string, digest string, key string, n long, rank int, x string, page int, c double"


def docs(spark, texts=TEXTS, first=0):
    return spark.createDataFrame([(first + i, t, "d", "k", 1, 2, "x", 3, 0.5) for i, t in enumerate(texts)], SCHEMA)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# 1


def test_automaton_is_greedy_longest_match():
    rng = random.Random(4)
    for _ in range(3000):
        first, inner = (["".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(3)] for _ in range(2))
        a = token_counts.Automaton(first, inner)
        w = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        assert a.count(w) == token_counts.greedy(w, set(first), set(inner)), (first, inner, w)


def test_token_counts(spark):
    first, inner = token_counts.sentencepiece_vocabulary(PIECES)
    a, f, i = token_counts.Automaton(first, inner), set(first), set(inner)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.token_counts(docs(spark).union(docs(spark, ["the", "the"], 50)), first, inner).collect()}
    for k, t in enumerate(TEXTS):
        words = [w for c in re.findall(r"[^\s\x85\xa0]+" if "\x1c" not in (t or "") else r"[^ \t\n\xa0]+", t or "") for w in a._splits(c)]
        counts = [token_counts.greedy(w, f, i) for w in words]
        assert got[k] == (len(words), sum(c or 1 for c in counts), counts.count(None)), t
    assert got[50] == got[51] and token_counts.token_counts(docs(spark, []), first, inner).count() == 0


def test_automaton_with_bare_begin_and_bytes():
    rng = random.Random(6)
    for k in range(3000):
        first, inner = (["".join(rng.choice("abñ") for _ in range(rng.randint(1, 4))) for _ in range(3)] for _ in range(2))
        first += [""] * (k % 3 > 0)
        inner += [bytes([b]) for b in range(256) if k % 2 or b < 128]
        w = "".join(rng.choice("abñ字") for _ in range(rng.randint(1, 12)))
        assert token_counts.Automaton(first, inner).count(w) == token_counts.greedy(w, set(first), set(inner)), (first, w)


def test_no_length_is_lost_as_one_unknown(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a = token_counts.Automaton(*token_counts.sentencepiece_vocabulary(PIECES))
    # The model takes the mark itself for a blank; to the automaton it is a character.
    singles = [chr(c) for c in range(0x21, 0x3000) if chr(c) != "▁" and len(a._splits(chr(c))) == 1 and model.normalize(chr(c)) == "▁" + chr(c)]
    assert len(singles) > 5000
    for w in ["555", "2024", "3" * 40, "漢字", "\U00020000\U00020001", *singles]:
        assert a.count(w) == len(model.encode(w)), w
    got = token_counts.token_counts(docs(spark, ["2024 555 " + "7" * 500]), *token_counts.sentencepiece_vocabulary(PIECES)).first()
    assert tuple(got) == (0, 3, 5 + 4 + 501, 0)


# 2


def test_search_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(5)] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] + [0.0] * 7), (403, [float("inf")] + [0.0] * 7), (404, [1.0, 2.0]), (406, [2.0, 2.0]), (408, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1))
    for block in (1024, 7):
        got = topk.search(v, v.filter("vec_id % 10 = 0 OR vec_id > 400"), block=block)
        pdf = v.toPandas()
        pdf["embedding"] = [None if e is None or any(x is None or x != x for x in e) else e for e in pdf["embedding"]]
        own = pdf[(pdf.vec_id % 10 == 0) | (pdf.vec_id > 400)]
        assert sorted(map(tuple, got.collect())) == sorted(topk.brute(pdf, own))
    assert topk.search(v.filter("false"), v.filter("false")).count() == 0
    big = spark.createDataFrame([(0, [2e5, 1.0]), (1, [2e5, 2.0]), (2, [2e5, 3.0]), (3, [1e30, 1.0])], "vec_id long, embedding array<double>")
    assert [r["score"] for r in topk.search(big, big.filter("vec_id = 0")).orderBy("rank").collect()] == [1024**2 * (4 * 10**10 + 3), 1024**2 * (4 * 10**10 + 2)]


def test_large_components_are_scored(spark):
    rows = [(0, [1.0, 0.5]), (1, [2.0**29, 3.0]), (2, [-(2.0**29), 1.0]), (3, [2.0**60, 0.0]), (4, [0.25, 2.0**18]), (5, [3.0, 4.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (2, 10):
        got = sorted(map(tuple, topk.search(v, v, k=k).collect()))
        whole = [[int(1024 * x) for x in e] for _, e in rows]
        expected = []
        for i, q in enumerate(whole):
            own = sorted((-s, j) for j, x in enumerate(whole) if j != i and -(2**63) <= (s := sum(a * b for a, b in zip(q, x, strict=True))) < 2**63)
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(own[:k])]
        assert got == sorted(expected)


# 3


def test_classifier_on_held_out_documents(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(d, labels).join(labels, "doc_id").toPandas()
    own = got[got.held_out]
    good, bad = own[own.quality == 1].score.to_numpy(), own[own.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95 and (good >= 0.3).mean() > 0.97
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got.doc_id, got.held_out, strict=True))


def test_classifier_cases(spark):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (3, 1)], "doc_id long, quality int")
    got = quality.classify(docs(spark), labels).toPandas()
    assert len(got) == len(TEXTS) and got.score.between(0, 1).all() and got.predicted.isin([0, 1]).all()
    assert (quality.classify(docs(spark), labels.filter("false")).toPandas().score == 0.5).all()
    assert quality.classify(docs(spark, []), labels).count() == 0
    model = quality.Model(constant=0.2)
    assert quality.score(docs(spark), model, keep=True).count() == 0 and quality.score(docs(spark), quality.Model(constant=0.9), keep=True).columns == docs(spark).columns


def test_fit_reads_every_passage(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels: seen.append((bags, labels)) or quality.Model(constant=0.5))
    long = " ".join(["word"] * 48 * 999 + ["#$%&"] * 48 + ["word"] * 48 * 501)
    labels = spark.createDataFrame([(5, 0), (3, 1)], "doc_id long, quality int")
    quality.train(spark.createDataFrame([(5, long), (3, "a b")], "doc_id long, text string"), labels)
    bags = {len(b): b for b in seen[0][0]}
    assert 1501 in bags and np.flatnonzero(bags[1501][:, 9]).tolist() == [999]


def test_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(rng.integers(1, 6), quality.FEATURES)).astype(np.float32) for _ in range(60)]
    y = np.array([float(b[:, 0].max() > 1) for b in bags], np.float32)
    model = quality.fit(bags, y, epochs=150, batch=20)
    got = model.score(np.concatenate(bags), np.cumsum([0, *map(len, bags)]))
    assert ((got > 0.5) == y).mean() > 0.95


# 4


def rank_by_hand(pages, rules, damping=0.85, rounds=10):
    def parse(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")

    def rule(host, path):
        fits = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return max(fits)[1:] if fits else (None, None)

    total, t0, b0, links = Counter(), Counter(), Counter(), Counter()
    out = []
    for i, u, html in pages:
        h, p = parse(u)
        r, v = rule(h, p)
        out.append((i, h, p, r, v))
        if h:
            total[h] += 1
            t0[h] += v == "allow"
            b0[h] += v == "block"
            for link in set(re.findall(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", html or "")):
                to = parse("http:" + link if link.startswith("//") else link)[0] if re.match("(?i)([a-z][a-z0-9+.-]*:)?//", link) else ""
                if to and to != h:
                    links[h, to] += 1
    hosts = {*total, *(b for _, b in links)}
    outs, ins = Counter(), Counter()
    for (a, b), n in links.items():
        outs[a] += n
        ins[b] += n
    s = lambda c, h: c[h] / total[h] if total[h] else 0.0
    t, b = ({h: (1 - damping) * s(c, h) for h in hosts} for c in (t0, b0))
    for _ in range(rounds):
        nt, nb = ({h: (1 - damping) * s(c, h) for h in hosts} for c in (t0, b0))
        for (x, y), n in links.items():
            nt[y] += damping * t[x] * n / outs[x]
            nb[x] += damping * b[y] * n / ins[y]
        t, b = nt, nb
    return [(i, h, p, r, v or ("block" if h and b[h] - t[h] > (1 - damping) / 2 else "allow")) for i, h, p, r, v in out]


def test_urls(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    rng = random.Random(3)
    hosts = [f"h{k}.example.{e}" for k in range(6) for e in ("com", "net", "org")]
    pages = []
    for k in range(300):
        h = rng.choice(hosts)
        html = "".join(f'<a href="{rng.choice(["http://", "//"])}{rng.choice(hosts) if rng.random() < 0.7 else "h1.example.net"}/x">' for _ in range(rng.randint(0, 4)))
        pages.append((k, f"http://{h.upper() if k % 5 == 0 else h}/{rng.choice(['en', 'de', 'fr', 'xx'])}/{k}?q#f", html))
    pages += [(1000, None, None), (1001, "no scheme", ""), (1002, "http://a.net", '<a href="/en/">'), (1003, "x://B.net/y://z?#", ""), (1004, "http://", "")]
    pages += [(1100 + k, "http://hub.example.com/en/1", '<a href="http://only.net/en/">') for k in range(3)] + [(1200, "http://only.net/a", ""), (1201, "http://only.net/b", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    got = urls.judge(df, rules)
    expected = rank_by_hand(pages, rules)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert {v for i, *_, r, v in expected if r is None} == {"allow", "block"}
    assert urls.judge(df.filter("false"), rules).count() == 0


def test_relative_links_are_no_edges(spark):
    html = """<a href="/go?u=http://evil.net/x"> <a href='page//http://evil.net'> <a href=http:evil.net//x> <a HREF="HTTPS://Good.org/y"> <a href="//other.org">"""
    df = spark.createDataFrame([(1, "http://a.com/", html)], "page_id long, url string, html string")
    assert sorted(map(tuple, urls.edges(df).collect())) == [("a.com", "good.org", 1), ("a.com", "other.org", 1)]


def test_trust_spreads_until_it_converges(spark):
    rules = [("block", "net/"), ("allow", "org/")]
    link = lambda *to: "".join(f'<a href="http://{x}/">' for x in to)
    # x and y hand a sixth of z's distrust to and fro; x passes the threshold after more than ten rounds.
    pages = [(0, "http://z.net/", ""), (1, "http://x.com/", link("z.net", "y.com")), (2, "http://y.com/", link("x.com")), *((3 + k, f"http://w.com/{k}", link("z.net")) for k in range(5))]
    rng = random.Random(8)
    hosts = [f"h{k}.{rng.choice(['com', 'com', 'com', 'net', 'org'])}" for k in range(400)]
    pages += [(100 + k, f"http://{h}/", link(*rng.sample(hosts, 4))) for k, h in enumerate(hosts)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r) for r in urls.judge(df, rules).collect()}
    early, late = ({r[0]: r for r in rank_by_hand(pages, rules, rounds=n)} for n in (10, 300))
    assert got == late and late[1][4] == "block" and early[1][4] == "allow"


# 5


def shingles(text, words):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def near_by_hand(rows, words):
    sets = {i: shingles(t, words) for i, t in rows}
    holders, both, parent = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] += 1

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rng = random.Random(words)
    rows = list(enumerate(TEXTS))
    vocabulary = [f"w{k}" for k in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    for g in range(4):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(30):
            t = list(base)
            for _ in range(rng.randint(0, 10)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((100 + len(rows), " ".join(t if g else shared + t[:60])))
    rows += [(1000 + k, " ".join(shared + [rng.choice(vocabulary) for _ in range(30)])) for k in range(40)]
    df = spark.createDataFrame([(i, t, "d", "k", 1, 2, "x", 3, 0.5) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: tuple(r)[1:] for r in neardup.near_duplicates(df, words).collect()}
    assert got == near_by_hand(rows, words)
    assert neardup.near_duplicates(docs(spark, []), words).count() == 0
    lone = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in neardup.near_duplicates(lone, words).collect()) == [(0, None, True), (1, 1, True)]


def test_ids_with_different_texts_are_linked_by_each(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"{p}{rng.randrange(10**6)}" for _ in range(80)) for p in "abcd")
    rows = [(1, a), (1, b), (2, b + " more"), (3, "other " + a), (4, b), (5, c), (5, d), (6, d + " x"), (7, "alone"), (5, ""), (6, None), (None, a)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    expected = [(i, len(shingles(t, 2)), *((None, True) if i is None else (o := i if not t or i == 7 else 1 if i < 5 else 5, o == i))) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_min_max_is_unbiased():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 150, dtype=np.uint64)
        (la, lb), (ha, hb) = neardup.signatures([np.unique(x[:130]), np.unique(x[20:])])
        agree.append(((la == lb).mean() + (ha == hb).mean()) / 2)
    assert abs(np.mean(agree) - 110 / 150) < 0.02


def test_margin_covers_what_32_bits_count_too_many():
    rng = np.random.default_rng(4)
    for n in (2_000, 400_000, 1_000_000):
        x = rng.permutation(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)))
        cut = len(x) // 10 + 1  # just below 80 percent
        s, t = x[cut:], x[: len(x) - cut]
        both = np.isin((t >> np.uint64(32)).astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)).sum()
        true = len(x) - 2 * cut
        assert 100 * true < 80 * len(x) and 100 * both - 80 * (len(s) + len(t) - both) < neardup.margin(len(s), len(t), 80)
        assert n < 10**6 or 100 * both - 80 * (len(s) + len(t) - both) >= 1000
        # Sets well above the threshold join all the same.
        assert 100 * len(s) - 80 * len(s) > neardup.margin(len(s), len(s), 80)


def test_word_hashes_ignore_case_of_ascii_only():
    import pyarrow as pa

    h, d = word_hashes(pa.array(["Ab aB É é", "", "x\x0by"], pa.large_string()))
    assert h[0] == h[1] and h[2] != h[3] and d.tolist() == [0, 0, 0, 0, 2, 2]


# 6


def licenses_by_hand(rows, templates):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for name, sh, k, stride, width in licenses.shapes(templates):
            h = [tuple(words[a : a + k]) for a in range(len(words) - k + 1)]
            t = {tuple(s) for s in sh}
            hits = [(a, len(t & set(h[a : a + width])) / len(t)) for a in range(0, max(0, len(h) - width) + stride, stride)] if h else []
            hits = [x for x in hits if x[1] >= 0.8]
            if hits:
                out[i, name] = (max(c for _, c in hits), hits[0][0], len(hits))
    return out


def test_licenses(spark):
    grant = licenses.TEMPLATES["mit-grant"]
    rows = [*enumerate(TEXTS), (20, "Released under the MIT License."), (21, "xx " * 300 + "licensed UNDER cc by-nc, 4.0! " + "yy " * 50), (22, grant), (23, grant.replace("software", "SOFTWARE").replace("charge", "cost")), (24, "permission is hereby granted"), (25, "licensed under the apache license version 2 0 " * 3)]
    df = spark.createDataFrame([(i, t, "d", "k", 1, 2, "x", 3, 0.5) for i, t in rows], SCHEMA)
    got = {(r["doc_id"], r["license"]): (r["containment"], r["first_word"], r["n_windows"]) for r in licenses.scan(df).collect()}
    assert got == licenses_by_hand(rows, licenses.TEMPLATES) and {i for i, _ in got} >= {20, 21, 22, 25}
    assert licenses.scan(docs(spark, [])).count() == 0 and licenses.scan(df, {}).count() == 0


def test_whole_licenses_names_and_spdx_lines(spark):
    text = {n: licenses.TEMPLATES[f"{n}-text"] for n in ("mit", "isc", "apache-2.0", "gpl-3.0", "mpl-2.0", "unlicense")}
    broken = text["gpl-3.0"].split()
    broken = " ".join("changed" if k % 60 == 7 else w for k, w in enumerate(broken))
    rows = [*enumerate(text.values()), (20, "Released under the terms of the MIT License"), (21, "see Apache License 2.0"), (22, "# SPDX-License-Identifier: ISC"), (23, "xx " * 99 + broken), (24, "Licensed under CC BY 4.0"), (25, "Licensed under CC BY-SA 4.0"), (26, text["gpl-3.0"][:9000])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = defaultdict(set)
    for r in got:
        held[r["doc_id"]].add(r["license"])
    assert all(f"{n}-text" in held[i] for i, n in enumerate(text)) and "gpl-3.0-text" in held[23] and "gpl-3.0-text" not in held[26]
    assert held[20] == {"mit-name-1"} and held[21] == {"apache-2.0-name-1"} and held[22] == {"spdx-isc"}
    assert held[24] == {"cc-by-4.0-name-1"} and held[25] == {"cc-by-sa-4.0-name-1"}
    few = [r for r in rows if r[0] != 3 and r[0] < 26]
    assert {(r["doc_id"], r["license"]): (r["containment"], r["first_word"], r["n_windows"]) for r in got if r["doc_id"] in dict(few)} == licenses_by_hand(few, licenses.TEMPLATES)


def test_telling_words_lose_no_match():
    for _, shingles, *_ in licenses.shapes(licenses.TEMPLATES):
        words = licenses.telling(shingles)
        assert sum(not words & set(s) for s in shingles) < licenses.CONTAINED * len(shingles)


# 7


def test_index_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(exact, "HELD", 3)
    monkeypatch.setattr(exact, "SHARD", 4)
    d = docs(spark, [f"t{k % 17}" for k in range(100)]).coalesce(2)
    got = exact.deduplicate(d).collect()
    assert all(r["keep_id"] == max(k for k in range(100) if k % 17 == r["doc_id"] % 17) and r["group_size"] == len(range(r["doc_id"] % 17, 100, 17)) for r in got) and len(got) == 100


def test_cuckoo_index_inserts_deletes_and_grows():
    rng, live, index = random.Random(1), {}, exact.CuckooIndex(4)
    for k in range(20000):
        key = hashlib.sha256(str(rng.randint(0, 3000)).encode()).digest()
        if rng.random() < 0.6:
            assert index.insert(key, k) == (key not in live)
            live[key] = k
        else:
            assert index.delete(key) == (key in live)
            live.pop(key, None)
    assert dict(index.items()) == live and index.resized and index.live == len(live)
    assert all(index.get(k) == v for k, v in live.items()) and index.get(b"\0" * 32) is None


def test_exact_duplicates(spark):
    got = {r["doc_id"]: r for r in exact.deduplicate(docs(spark)).collect()}
    assert len(got) == len(TEXTS)
    own = defaultdict(list)
    for i, t in enumerate(TEXTS):
        own[t or ""].append(i)
    for t, ids in own.items():
        for i in ids:
            assert tuple(got[i])[1:] == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact.deduplicate(docs(spark, [])).count() == 0
    twice = docs(spark, ["a", "a", "b"]).union(docs(spark, ["x", "a"]))
    assert sorted((r["doc_id"], r["text"]) for r in exact.survivors(twice).collect()) == [(0, "x"), (1, "a"), (2, "b")]
    assert exact.survivors(twice).columns == twice.columns


def test_index_outlives_changes(spark):
    d = docs(spark)
    index = exact.build(d, 3)
    more = exact.apply_changes(index, exact.changes(docs(spark, ["new", "a"], 90), 1), 3, d.union(docs(spark, ["new", "a"], 90)))
    assert more.agg(F.sum("n")).first()[0] == len(TEXTS) + 2
    less = exact.apply_changes(more, exact.changes(docs(spark, ["new"], 90), -1), 3, d.union(docs(spark, ["a"], 91)))
    # The row that stays of "a" is 91; when it goes, 3 takes its place.
    after = exact.apply_changes(less, exact.changes(docs(spark, ["a"], 91), -1), 3, d)
    key = hashlib.sha256(b"a").digest()
    assert [r["doc_id"] for x in (less, after) for r in x.collect() if bytes(r["digest"]) == key] == [91, 3]
    known = {r["doc_id"]: r["known"] for r in exact.is_known(docs(spark, ["new", "a", "never"], 200), less).collect()}
    assert known == {200: False, 201: True, 202: False}


# 8


def test_plans_are_gapless_and_near_the_bound():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([5, 10, 17, 64])
        histogram = {x: rng.randint(1, 30) for x in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        p, used = packing.plan(histogram, capacity, rounds=25), defaultdict(list)
        for x, n in histogram.items():
            a, b = np.searchsorted(p.length, [x, x + 1])
            r = np.arange(n)
            k = a + np.searchsorted(p.start[a:b], r, side="right") - 1
            copy, slot = np.divmod(r - p.start[k], p.each[k])
            for q, o in zip((p.sequence[k] + copy).tolist(), (p.offset[k] + slot * x).tolist(), strict=True):
                used[q].append((o, x))
        for own in used.values():
            own.sort()
            assert [o for o, _ in own] == [0, *np.cumsum([x for _, x in own])[:-1].tolist()] and sum(x for _, x in own) <= capacity
        assert len(used) == p.sequences >= p.bound - 1e-6 and p.sequences <= 1.25 * p.bound + 2
    assert packing.plan({}, 10).sequences == 0
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_packing(spark):
    tok = Tokenizer.from_file(WORDS)
    d = docs(spark).union(docs(spark, ["a", None]))
    got = packing.pack(d, WORDS, 64, 0, rounds=10).toPandas()
    expected = Counter()
    for i, t in [*enumerate(TEXTS), (0, "a"), (1, None)]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            expected[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())] += 1
    assert Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == expected
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 64
    assert packing.pack(docs(spark, []), WORDS, 64).count() == 0


# 9


def test_template_reads_back():
    rng = random.Random(5)
    marks = ["\\", "###", "</turn>", "a", " ", "\n", ":", "#", "<", "### Assistant: "]
    for _ in range(5000):
        turns = [("".join(rng.choice(marks) for _ in range(rng.randint(0, 3))) if rng.random() < 0.5 else "assistant", "".join(rng.choice(marks) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        text, spans = chat.write(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    with pytest.raises(ValueError):
        chat.parse("### user: x")


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 2, "user", "c", 3.0), (1, 5, 3, "user", None, 1.0), (2, 1, 9, "user", "orphan", 0.0), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0), (3, 3, 2, "user", "below a loop", 1.0)]
    rows += [(4, k, k - 1 if k else None, "user" if k % 2 == 0 else "assistant", f"t{k}", 1.0) for k in range(40)] + [(4, 39, 38, "assistant", "t39", 1.0)]
    df = spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, score double")
    got = {(r["tree_id"], r["branch"]): (r["leaf_id"], r["score"], chat.parse(r["formatted"])) for r in chat.format_trees(df, None).collect()}
    assert got[1, 1] == (4, 4.0, [("user", "q"), ("assistant", "a"), ("user", "c")]) and got[1, 2] == (5, 3.0, [("user", "q"), ("assistant", "b"), ("user", "")])
    assert got[2, 1][2] == [("user", "orphan")] and not any(t == 3 for t, _ in got)
    assert [t for _, t in got[4, 1][2]] == [f"t{k}" for k in range(40)] and got[4, 1][1] == 40.0
    assert chat.format_trees(df, 1).count() == 3 and chat.format_trees(df.filter("false")).count() == 0


def test_large_ids_beside_null_ones(spark):
    rows = [(None, 0, "user", "a"), (2**60 + 1, 0, "assistant", "b"), (2**60 + 1, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = chat.read_back(chat.format_trees(chat.tree_of_turns(df)).withColumnRenamed("tree_id", "conv_id")).collect()
    assert sorted(((r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got), key=str) == [(2**60 + 1, 2, 1), (None, 1, 0)]


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, None, "system", "s"), (2, 1, None, "x"), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("x")).withColumn("depth", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_trees(chat.tree_of_turns(df)).withColumnRenamed("tree_id", "conv_id")).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest([("system", "s"), ("user", ""), ("assistant", "b")]) and got[1]["loss_chars"] == 1
    assert got[2]["turns_sha256"] == digest([("", "x"), ("assistant", "same"), ("assistant", "same")]) and got[2]["loss_chars"] == 8
    assert got[-7]["loss_sha256"] == hashlib.sha256(b"\\### Assistant: </turn> ok").hexdigest()


# 10


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(bpe.vocabulary(WORDS))


def test_encoder_equals_the_library(own):
    tok = Tokenizer.from_file(WORDS)
    rng = random.Random(1)
    alphabet = "abcdefgthein'sdlm  \n\t\x1c\xa0ÀéßİΣσςœ½²٣漢字é̈ñ!!..--0123</w>Ⅷ🙂ﬁǅͅᾼ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a<|endoftext|>b <|startoftext|>", "<|EndOfText|>", "ΑΣ ΑΣ.", "x</w>y", "", "z" * 5000]
    pdf = pd.read_parquet(f"{SF}/documents.parquet")
    texts += pdf["text"].tolist()
    library = bpe.WordBpe(bpe.vocabulary(WORDS), by_matrix=True)
    for t, ids, other, e in zip(texts, own.encode(texts), library.encode(texts), tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids and other == ids, t
        assert own.decode(ids) == tok.decode(e.ids, skip_special_tokens=False), t


def test_added_tokens_that_words_may_be_are_refused():
    spec = json.loads(bpe.vocabulary(WORDS))
    for change in ({"content": "plain"}, {"content": "<| a"}, {"lstrip": True}):
        with pytest.raises(ValueError):
            bpe.WordBpe(json.dumps(spec | {"added_tokens": [spec["added_tokens"][0] | change]}))


def test_encoder_on_tables(spark):
    tok = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(docs(spark), WORDS).collect()}
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    ids = bpe.encode(docs(spark), WORDS)
    assert bpe.decode(ids, WORDS).count() == len(TEXTS) and bpe.encode(docs(spark, []), WORDS).count() == 0
    assert json.loads(bpe.vocabulary(WORDS))["model"]["type"] == "BPE"
