"""Every operator against a brute-force version on a small fixture with the awkward cases."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ligature.llm import bpe, chat, common, components, decontaminate, exact_dedup, html_main, licences, near_copies, simhash, suffix_dedup, toxicity

R = random.Random(5)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(1, 7))) for _ in range(400)]


def say(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


LONG = say(2500)
PASSAGE = say(130)
BASE = say(300)
TEXTS = [None, "", " \t\n", "a", "A  b\x0bC", "abC", LONG, LONG + " tail", LONG.replace(" ", "\n", 3), PASSAGE, say(50) + PASSAGE + say(40), PASSAGE + PASSAGE, BASE, BASE + " x", BASE.replace(WORDS[0], "q", 1), "é漢字😀 " * 90, "a" * 1500, "<|endoftext|> x", say(30), say(30), "one two", "One, TWO! three", say(9)]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7]), (None, "null id"), (100, say(200) + " idiot"), (101, "Released under the MIT License.\nelse")]
ITEMS = [(1, say(12)), (2, "one two"), (3, ""), (None, "One Two three"), (2, "one two"), (5, " ".join(LONG.split()[700:730]))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, -1, "k", "f") for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uid long, key string, fp string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_exact_dedup(docs, empty):
    strip = lambda t: (t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})
    groups = defaultdict(list)
    for i, t in DOCS:
        groups[strip(t)].append((-len(t or ""), -1 if i is None else i))
    best = {x: None if min(g)[1] < 0 else min(g)[1] for x, g in groups.items()}
    want = Counter((i, best[strip(t)], len(groups[strip(t)]), hashlib.sha256(strip(t).encode()).hexdigest()) for i, t in DOCS)
    got = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_chunk_identifiers_with_several_contents_get_variants(spark):
    rows = [(1, 1, 1, 5, "", [7], [5], [1], [1]), (2, 2, 1, 5, "", [7], [5], [2], [1]), (3, 3, 1, 5, "", [7], [5], [1], [1])]
    found = exact_dedup.verified(spark.createDataFrame(rows, exact_dedup._DDL))
    v = {r.uid: tuple(r.variants) for r in found.collect()}
    assert v[1] == v[3] != v[2]


def test_cuts_are_content_defined():
    data = LONG.encode() * 3
    ends = exact_dedup.cuts(data)
    assert ends[-1] == len(data) and all(b - a <= exact_dedup.MOST for a, b in zip([0, *ends], ends, strict=False))
    shifted = exact_dedup.cuts(b"shift" + data)
    assert len({e - 5 for e in shifted} & set(ends)) > len(ends) // 2


def test_bpe_equals_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for i, x in DOCS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    coded = bpe.bpe_encode(docs)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded.collect()) == want
    back = Counter((r.doc_id, r.text) for r in bpe.bpe_decode(coded).collect())
    assert back == Counter((i, x or "") for i, x in DOCS)
    coder, r = bpe.encoder(bpe.default_path()), random.Random(1)
    for _ in range(1500):
        x = "".join(r.choice("abcdehnrstio'-.,01 \n\té漢😀 ") for _ in range(r.randint(0, 80)))
        assert np.frombuffer(coder.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def brute_words(text):
    import regex

    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = Counter()
    for i, t in DOCS:
        w, hit, items = brute_words(t), set(), set()
        for item, x in ITEMS:
            b = brute_words(x)
            for at in range(max(1, len(b) - 9) if b else 0):
                g = b[at : at + 10]
                for s in range(len(w) - len(g) + 1):
                    if w[s : s + len(g)] == g:
                        hit |= set(range(s, s + len(g)))
                        items.add("null" if item is None else str(item))
        want[i, len(w), len(hit), tuple(sorted(items))] += 1
    for block in (1 << 20, 20):
        got = decontaminate.decontaminate(docs, bench, block_bytes=block).collect()
        assert Counter((r.doc_id, r.n_words, sum(e - b for b, e in zip(r.begins, r.ends, strict=True)), tuple(r["items"])) for r in got) == want
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_proximity(docs):
    got = {(r.doc_id, r.start) for r in decontaminate.near_matches(docs, ["three", "one"], 3).collect()}
    assert got == {(21, 0)}
    assert decontaminate.near_matches(docs, ["three", "one"], 2).count() == 0


def test_suffix_dedup(docs, empty, monkeypatch):
    n = suffix_dedup.LENGTH
    seen = Counter()
    for _, t in DOCS:
        data = (t or "").encode()
        seen.update(data[s : s + n] for s in range(len(data) - n + 1))
    want = Counter()
    for i, t in DOCS:
        data = (t or "").encode()
        cut = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - n + 1):
            if seen[data[s : s + n]] > 1:
                cut[s : s + n] = True
        kept = bytes(b for b, c in zip(data, cut, strict=False) if not c)
        want[i, len(data), int(cut.sum()), int((np.diff(np.concatenate(([0], cut.view(np.int8)))) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert sum(k[2] for k in want) > 0
    for crowd in (suffix_dedup.CROWD, 1):
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        assert Counter(tuple(r) for r in suffix_dedup.suffix_dedup(docs).collect()) == want
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().translate(common.LOWER_SPACED).split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, empty):
    prints = [(i, brute_fingerprint(t)) for i, t in DOCS]
    label = list(range(len(prints)))
    for _ in prints:
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for (i, _), c in zip(prints, label, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = Counter((i, f, least[c]) for (i, f), c in zip(prints, label, strict=True))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_groups(docs).collect()) == want
    assert simhash.simhash_groups(empty).count() == 0


def test_golay_links_are_complete_and_single(spark):
    r, prints = random.Random(2), set()
    for _ in range(60):
        x = r.getrandbits(64)
        prints.add(x)
        for n in (1, 2, 3, 4):
            prints.add(x ^ sum(1 << b for b in r.sample(range(64), n)))
    prints = sorted(np.array(sorted(prints), np.uint64).view(np.int64).tolist())
    got = [(x.a, x.b) for x in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()]
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def brute_near_groups(texts):
    """Component by document of pairs with five-word Jaccard of 0.8 or more, and the number of such pairs."""
    words = [(t or "").encode().translate(common.LOWER_SPACED).split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    label = list(range(len(sets)))
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label, pairs


def edited(r, texts):
    line = say(25)
    for _ in range(25):
        w = say(r.randint(30, 200)).split() + line.split() * (r.random() < 0.5)
        texts.append(" ".join(w))
        for _ in range(3):
            w = list(w)
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = say(1)
            texts.append(" ".join(w))
    r.shuffle(texts)
    return texts


def test_plain_words_are_one_piece_without_the_pattern(monkeypatch):
    import tokenizers

    coder, library = bpe.Encoder(bpe.default_path()), tokenizers.Tokenizer.from_file(bpe.default_path())
    asked, find = [], coder.find
    monkeypatch.setattr(coder, "find", lambda text: asked.append(text) or find(text))
    text = "one two Three it's don't 's x2 naïve ab\ncd \u0345a ﬁne _ a"
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked and not {" two", " Three", " a"} & set(asked)


def test_keys_of_fingerprints_are_not_broadcast(spark):
    prints = common.written(spark.range(1000).select(F.xxhash64("id").alias("fp")), "prints")
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_copies_are_the_groups_of_all_pairs(spark):
    import corpus_pipeline as p

    texts = edited(random.Random(8), list(TEXTS))
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, uid long").repartition(3)
    label, pairs = brute_near_groups(texts)
    far = [1 for a, b in pairs if (brute_fingerprint(texts[a]) ^ brute_fingerprint(texts[b])).bit_count() > 3]
    assert len(far) > 5
    got = {x.doc_id: x.component_id for x in near_copies.near_groups(docs).collect()}
    # links are verified, so groups are never larger than those of all pairs
    assert got.keys() == set(range(len(texts))) and all(label[i] == label[c] and c <= i for i, c in got.items())
    found = {p: got[p[0]] == got[p[1]] for p in pairs}
    sets = [set(near_copies.shingles(t or "").tolist()) for t in texts]
    close = [p for p in pairs if not sets[p[0]] or len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) >= 0.85]
    assert len(close) > 20 and all(found[p] for p in close)
    assert sum(found.values()) >= 0.95 * len(pairs)
    kept = {x.doc_id for x in p.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(got.values())
    assert near_copies.near_groups(docs.limit(0)).count() == 0


def test_near_copies_of_one_large_group_and_repeated_rows(spark):
    r = random.Random(9)
    base = say(150).split()
    texts = []
    for _ in range(150):
        w = list(base)
        w[r.randrange(len(w))] = say(1)
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (500, None), (501, " ")], "doc_id long, text string")
    got = Counter((x.doc_id, x.component_id) for x in near_copies.near_groups(docs).collect())
    assert got == Counter({(i, 0): 1 + (i == 3) for i in range(150)}) + Counter([(None, 0), (500, 500), (501, 500)])


def test_buckets_of_the_same_members_are_split_once(spark):
    rows = [(key, fp) for key, members in ((16, (1, 2, 3)), (32, (1, 2, 3)), (17, (1, 2, 3)), (48, (1, 2)), (64, (2, 3)), (80, (5, 6))) for fp in members]
    shared, roots = spark.createDataFrame(rows, "key long, fp long"), spark.createDataFrame([(2, 2), (3, 2)], "fp long, root long")
    kept = lambda *by: Counter((x.key, x.fp) for x in near_copies._split(shared, roots, *by).select("key", "fp").collect())
    assert kept() == Counter(r for r in rows if r[0] in (16, 48, 80))
    assert kept(near_copies._group().alias("of")) == Counter(r for r in rows if r[0] in (16, 17, 48, 80))


def test_keys_of_one_set_send_only_their_rows(spark):
    def sent():
        held = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    r = random.Random(4)
    docs = common.written(spark.createDataFrame([(i, " ".join(r.choices(WORDS, k=80))) for i in range(1000)], "doc_id long, text string"), "docs")
    before = sent()
    assert near_copies.near_groups(docs).where("component_id = doc_id").count() == 1000
    # a key and a set are 16 bytes
    assert sent() - before < 1000 * len(near_copies.BANDS) * near_copies.PROBES * 32


def test_parities_never_differ_more_than_sets(spark):
    r = np.random.default_rng(3)
    rows = []
    for n in (0, 1, 63, 64, 65, 120, 128, 129, 1000):
        for fresh in (0, 1, n // 9, n // 5):
            a = r.integers(-(1 << 63), 1 << 63, n)
            b = np.concatenate([a[fresh // 2 :], r.integers(-(1 << 63), 1 << 63, fresh)])
            rows.append((near_copies.parities(a).tolist(), near_copies.parities(b).tolist(), len(set(a.tolist()) ^ set(b.tolist()))))
    found = spark.createDataFrame(rows, "x array<long>, y array<long>, differ int").select(near_copies._fewest_differing(F.col("x"), F.col("y")).alias("least"), "differ").collect()
    assert all(x.least <= x.differ and (x.least > 0 or x.differ % 2 == 0) for x in found)
    assert sum(x.least for x in found) > 0.7 * sum(x.differ for x in found)
    assert any(len(x) != len(y) for x, y, _ in rows)


def test_codewords_are_eight_apart():
    words = near_copies.code()
    fit = words @ words.T
    assert words.shape == (2048, 24) and set(np.unique(fit)) == {-8.0, 0.0, 8.0, 24.0} | ({-24.0} & set(np.unique(fit)))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in components.components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_toxicity(spark):
    r, rows = random.Random(3), []
    for i in range(700):
        toxic = i % 7 == 0
        w = [r.choice(WORDS) for _ in range(r.randint(20, 80))]
        for _ in range(5 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["zidiot", "zscum", "zmoron"]))
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    scores = {x.doc_id: x.score for x in toxicity.toxicity(docs, toxicity.trained(docs, labels)).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((scores[i] >= 0.3) == y for i, y in held) / len(held) > 0.97
    assert 0 <= scores[9000] == scores[9001] < 0.3
    assert set(x.score for x in toxicity.toxicity(docs, toxicity.trained(docs, labels.limit(0))).collect()) == {0.0}


def test_segments_are_maximal():
    r = random.Random(4)
    for _ in range(50):
        places = sorted(r.sample(range(60), 12))
        scores = [r.uniform(0.1, 4) for _ in places]
        got = toxicity.segments(np.array(scores), np.array(places), 0.5)
        line = [-0.5] * 60
        for p, s in zip(places, scores, strict=True):
            line[p] = s
        best = max(sum(line[a:b]) for a in range(60) for b in range(a + 1, 61))
        assert abs(max(s for *_, s in got) - best) < 1e-9
        assert all(abs(sum(line[a : b + 1]) - s) < 1e-9 for a, b, s in got)
        assert all(b < c for (_, b, _), (c, _, _) in zip(got, got[1:], strict=False))


def test_licences(spark, docs):
    model, told = licences.trained(), Counter()
    for text, families in licences.variants(600, 77):
        told[{f for _, f, _ in model.families_in(text)} == families] += 1
    assert told[True] / 600 > 0.95
    found = {r.doc_id: [x.family for x in r.found] for r in licences.license_scan(docs).collect()}
    assert found[101] == ["MIT"] and found[0] == [] == found[6]


#: Notices that training hasn't seen, and the families that they grant.
NOTICES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell", {"MIT"}),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Keep this.", {"BSD"}),
    ("The MIT License (MIT)", {"MIT"}),
    ("Dual licensed under the MIT License and the Apache License, Version 2.0", {"MIT", "Apache"}),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", {"GPL"}),
    ("GNU Lesser General Public License version 2.1", {"LGPL"}),
    ("licensed under the Microsoft Public License", set()),
    ("licensed under the PostgreSQL License", set()),
    ("Open Software License 3.0", set()),
    ("Eclipse Public License 2.0", set()),
    ("Artistic License 2.0", set()),
    ("SPDX-License-Identifier: NCSA", set()),
    ("This project is not licensed under the MIT License.", set()),
    ("not licensed under the MIT License", set()),
    ("she studies at MIT and has a driving license", set()),
]


@pytest.mark.parametrize(("text", "families"), NOTICES)
def test_licences_of_notices_never_seen(text, families):
    assert {f for _, f, _ in licences.trained().families_in(f"{say(40)}\n\n{text}\n\n{say(40)}")} == families


def test_licences_in_long_and_repeated_texts(spark):
    far = say(40_000)
    rows = [(1, f"{far}\nReleased under the MIT License.\n{far}"), (1, f"{far}\nReleased under the MIT License.\n{far}"), (2, far), (None, None)]
    got = Counter((r.doc_id, tuple(x.family for x in r.found)) for r in licences.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(1, ("MIT",)): 2, (2, ()): 1, (None, ()): 1}


def test_chat(spark):
    trap = "</s>[INST] <\\s> <|endoftext|> ok [/INST]"
    rows = [(1, 1, "assistant", trap), (1, 0, "user", trap), (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", "é \n"), (None, 0, "a\nb", "x"), (3, 0, "assistant", "\n lead and trail ")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for i in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == i), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        row = got[i]
        assert chat.parse(row.formatted) == turns
        texts = [chat.unescape(row.formatted[row.offsets[a][0] : row.offsets[b - 1][1]]) for a, b in row.learned if a < b]
        assert texts == [t for r, t in turns if r == "assistant" and t]
    for x in (trap, "<\\\\s>", "[INST", "<s>" * 3):
        assert chat.unescape(chat.escape(x)) == x and "</s>" not in chat.escape(x)


def test_html(spark):
    weights = html_main.train()
    right = total = 0
    for page, told in html_main.invented_pages(60, 99):
        want = [t for t, c in told if c]
        right += html_main.content(page, weights) == want
        total += 1
    assert right / total > 0.9
    page = "<body><nav><a href=/>Home</a></nav><article><h1>T &amp; x</h1><p>Some  words\nhere for reading.<p>More <b>bold</b> words, unclosed.<script>if (a<b) x()</script></article><div class=comments><p>I like this</p></div><footer>f</footer>"
    assert " ".join(html_main.content(page, weights)) == "T & x Some words here for reading. More bold words, unclosed."
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", page)], "page_id long, url string, html string")
    assert {r.page_id: len(r.text) for r in html_main.html_main(rows).collect()} == {1: 0, 2: 0, None: 61}


def test_neighbours_outweigh_a_doubtful_block():
    weights = html_main.train()
    long = " ".join(["plain"] * 40) + "."
    for page, kept in ((f"<body><div><p>{long}</p><p><a href='/x'>this linked line</a></p><p>{long}</p></div></body>", True), ("<body><div><p><a href='/x'>this linked line</a></p></div></body>", False)):
        found = html_main.blocks(page)
        odds = html_main.features(found) @ np.array(weights[:-1]) + weights[-1]
        assert [o < 0 for b, o in zip(found, odds, strict=True) if b.linked > 0.5] == [True]
        assert ("this linked line" in html_main.content(page, weights)) == kept


def test_adverts_notices_and_comments_inside_an_article_go():
    weights, long = html_main.train(), " ".join(["plain"] * 30) + "."
    for odd in ("<div class='ad'><p>Buy now this thing of ours for less money.</p></div>", "<p class='notice'>We use cookies on this site.</p>", f"<div class='comments'><p>{long} I agree.</p></div>", "<form>Your name <input></form>", "<aside><p>Read more here.</p></aside>"):
        page = f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{long}</p>{odd}<p>{long} two</p></article><footer>us</footer>"
        assert html_main.content(page, weights) == ["Title", long, f"{long} two"]


def test_deeply_nested_pages_take_linear_time(spark):
    import time

    weights = html_main.train()
    began = time.time()
    assert html_main.content("<div>" * 60_000 + "x</b></i>y" * 60_000, weights) != None  # noqa: E711
    assert html_main.content("<i>" * 60_000 + "<b>x</b></p>" * 20_000, weights) != None  # noqa: E711
    assert time.time() - began < 20
    rows = [(7, "u", "<p>one</p>"), (7, "u", "<p>one</p>"), (8, "v", "<p>" + "long text " * 100_000)]
    odd = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    assert Counter((r.page_id, len(r.text)) for r in html_main.html_main(odd).collect()) == {(7, 3): 2, (8, 999_999): 1}


def test_minimum_cut_is_minimal():
    r = random.Random(6)
    for _ in range(150):
        n = r.randint(1, 7)
        s, t = [r.randint(0, 9) for _ in range(n)], [r.randint(0, 9) for _ in range(n)]
        e = [(i, j, r.randint(0, 6)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.6]
        cost = lambda side: sum(b if x else a for x, a, b in zip(side, s, t, strict=True)) + sum(c for i, j, c in e if side[i] != side[j])  # noqa: E731, B023
        assert cost(html_main.minimum_cut(s, t, e)) == min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))


TOXIC = ["zidiot", "zscum", "zmoron"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with a labelled corpus: toxic, copied, nearly copied and contaminated documents, and two
    rows of one doc_id of which one has to go."""
    r, path = random.Random(11), f"file://{tmp_path_factory.mktemp('corpus')}"
    rows, labels = [], []
    for i in range(1000, 1700):
        w = [r.choice(WORDS) for _ in range(r.randint(20, 80))]
        toxic = i % 7 == 0
        for _ in range(5 * toxic):
            w.insert(r.randrange(len(w)), r.choice(TOXIC))
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(toxic)))
    rows += [(i, t) for i, t in DOCS] + list(enumerate(edited(r, []), 3000))
    rows += [(7000, say(60)), (7000, say(30) + " zidiot zscum zmoron zidiot zscum " + say(20)), (7001, say(60)), (7001, say(30) + " " + ITEMS[0][1] + " " + say(30)), (7002, say(20) + " " + ITEMS[0][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def has_item(text):
    w = brute_words(text)
    for _, x in ITEMS:
        b = brute_words(x)
        for at in range(max(1, len(b) - 9) if b else 0):
            g = b[at : at + 10]
            if any(w[s : s + len(g)] == g for s in range(len(w) - len(g) + 1)):
                return True
    return False


def test_each_pipeline_stage_equals_brute_force(spark, corpus):
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "bpe_encoding"]
    docs = common.read(spark, corpus, "documents")
    clean = common.written(p.drop_toxic(spark, docs, corpus), "t")
    assert clean.columns == docs.columns
    before, after = rows_of(docs), rows_of(clean)
    gone = before - after
    truth = lambda t: sum(w in TOXIC for w in (t or "").split()) >= 3
    assert not after - before and sum(truth(t) for _, t in gone) >= 0.97 * sum(truth(t) for _, t in before)
    assert sum(not truth(t) for _, t in gone) <= 0.02 * before.total()
    assert [i for i, _ in gone].count(7000) == 1 and [i for i, _ in after].count(7000) == 1
    once = common.written(p.drop_copies(spark, clean, corpus), "e")
    strip = lambda t: (t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})
    best = {}
    for i, t in after.elements():
        key = (-len(t or ""), i is not None, i or 0)
        best[strip(t)] = min(best.get(strip(t), (key, i, t)), (key, i, t), key=lambda x: x[0])
    assert Counter((i, len(t or "")) for i, t in rows_of(once).elements()) == Counter((i, len(t or "")) for _, i, t in best.values())
    single = common.written(p.drop_near_copies(spark, once, corpus), "n")
    held = sorted(rows_of(once).elements(), key=str)
    label, pairs = brute_near_groups([t for _, t in held])
    kept = rows_of(single)
    assert not kept - rows_of(once) and len(set(label)) <= kept.total() <= len(set(label)) + 2 < len(held)
    left = common.written(p.drop_benchmark(spark, single, corpus), "d")
    assert rows_of(left) == Counter({x: n for x, n in kept.items() if not has_item(x[1])}) and left.columns == docs.columns
    t = Tokenizer.from_file(bpe.default_path())
    coded = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows_of(left).elements())
    assert Counter((r.doc_id, r.n_tokens) for r in p.encode(spark, left, corpus).collect()) == coded
    assert Counter((r.doc_id, r.n_tokens) for r in p.run(spark, corpus).collect()) == coded
    assert [i for i, _ in rows_of(left)].count(7001) == 1 and 7002 not in [i for i, _ in rows_of(left)]


def test_pipeline_of_empty_tables(spark, corpus, tmp_path):
    import corpus_pipeline as p

    for name in ("documents", "labels", "benchmark"):
        common.read(spark, corpus, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


@pytest.fixture
def resplit(spark, monkeypatch):
    """After every write of Parquet, later scans of files are split otherwise."""
    from pyspark.sql import DataFrameWriter

    turn, old = [0], DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        old(self, *args, **kwargs)
        turn[0] += 1
        spark.conf.set("spark.sql.files.minPartitionNum", str((3, 17, 7, 1, 29)[turn[0] % 5]))

    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    yield turn
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_results_do_not_depend_on_how_scans_are_split(spark, corpus, resplit, tmp_path):
    docs = common.read(spark, corpus, "documents")
    docs.repartition(6).write.parquet(f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    told = lambda df: Counter(tuple(map(str, r)) for r in df.collect())
    in_blocks = decontaminate.decontaminate(docs, bench, block_bytes=20, terms=15).drop("uid")
    assert told(in_blocks) == told(decontaminate.decontaminate(docs, bench).drop("uid"))
    seen = Counter()
    held = [(t or "").encode() for _, t in rows_of(docs).elements()]
    for data in held:
        seen.update(data[s : s + 400] for s in range(len(data) - 399))
    want = 0
    for data in held:
        cut = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - 399):
            if seen[data[s : s + 400]] > 1:
                cut[s : s + 400] = True
        want += int(cut.sum())
    assert sum(r.n_removed for r in suffix_dedup.suffix_dedup(docs).collect()) == want > 0
    assert resplit[0] > 10


def test_repeated_bytes_across_segments_and_in_long_texts(spark):
    r = random.Random(12)
    block = "".join(r.choice("abcdefgh ") for _ in range(suffix_dedup.SEGMENT + 3000))
    other = "".join(r.choice("ijklmnop ") for _ in range(1500))
    texts = [block, other + block[suffix_dedup.SEGMENT - 700 : suffix_dedup.SEGMENT + 900], other[:399], "ab" * 100_000, other[:400] + "q" + other[:399]]
    got = {x.doc_id: x for x in suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in range(5)] == [(1600, 1), (1600 + 400, 2), (0, 0), (200_000, 1), (400, 1)]


def test_operators_take_empty_tables_and_clashing_columns(spark, docs, empty):
    assert bpe.bpe_encode(empty).count() == 0 and licences.license_scan(empty).count() == 0
    assert html_main.html_main(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(empty, toxicity.trained(empty, none)).count() == 0
    odd = docs.withColumn("score", docs.doc_id).withColumn("toxic", docs.doc_id).withColumn("token", docs.text)
    assert toxicity.toxicity(odd, toxicity.trained(odd, none)).count() == len(DOCS)
    assert toxicity.untoxic(odd, toxicity.Model({})).columns == odd.columns
    chats = spark.createDataFrame([(1, 0, "user", "hi", "k", 1), (1, 1, "assistant", "ho", "k", 2)], "conv_id long, turn long, role string, text string, formatted string, offsets long")
    assert chat.format_chats(chats).count() == 1


