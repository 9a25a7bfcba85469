"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varve.llm import bm25_search
from varve.llm.bm25_search import bm25_top_k
from varve.llm.decontaminate import compile_windows, contamination, find_windows, remove_spans
from varve.llm.html_text import extract_main_text, main_text
from varve.llm.langid import fit_languages, identify_language
from varve.llm.license_scan import fit_licences, scan_licences, train_licences
from varve.llm.mixing import block_quotas, mix_sources, mixed_documents, shard_quotas, source_targets
from varve.llm.near_dedup import near_duplicate_groups
from varve.llm.sharding import greedy_cuts, partition_cuts, shard_documents, smallest_capacity
from varve.llm.substring_dedup import substring_dedup
from varve.llm.tool_calls import link_tool_calls

KIND = "doc_id long, text string, lang string, source string, size string, shard string, slot string, taken string, spans string, label string, node string, n_words string"
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark, rows):
    """Rows (doc_id, text[, source]) with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", *["x"] * 8) for r in rows], KIND).repartition(3)


def odd_rows():
    """Null ids and texts, empty, blank and very long texts, a repeated row, copies."""
    rng = random.Random(1)
    long = " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) + str(rng.randrange(999)) for _ in range(60_000))
    text = " ".join(f"w{i}" for i in range(60))
    return [(1, text), (2, text), (3, None), (4, ""), (5, " \n\t"), (6, long), (7, "one"), (7, "one"), (None, text), (None, None), (8, "ONE"), (9, "w1 w2 w3"), (10, "%% !!")]


def test_near_groups_match_brute_force(spark):
    rng, rows = random.Random(3), []
    vocabulary = [f"v{i}" for i in range(400)]
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 120]))]
        for _ in range(5):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(copy)))
    rows += [(i + 100 if i else None, t) for i, t in odd_rows()]

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    smallest = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        smallest[root(i)].append(d)
    wanted = []
    for i, (d, _) in enumerate(rows):
        component = min((x for x in smallest[root(i)] if x is not None), default=None)
        wanted.append((d, len(sets[i]), component, d == component))
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicate_groups(docs_of(spark, rows), width=4).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    assert near_duplicate_groups(docs_of(spark, rows).limit(0), width=4).count() == 0


def test_a_crowded_bucket_loses_no_link(spark):
    """Many copies of one text, each changed elsewhere: the hub does not reach all, the blocks do."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(10_000)}" for _ in range(60)]
    rows = []
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(60), 2 + i % 3):
            copy[k] = f"c{i}-{k}"
        rows.append((i + 1, " ".join(copy)))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(57)} for _, t in rows]
    label = {d: d for d, _ in rows}
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i + 1] = min(label[i + 1], label[j + 1])
    got = {r.doc_id: r.component_id for r in near_duplicate_groups(docs_of(spark, rows), width=4).collect()}
    assert got == label


def test_long_repeats_match_brute_force(spark):
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(30)]
    rows = odd_rows()
    for i in range(25):
        own = [rng.choice("a b c d e f".split()) + rng.choice(["", "1", "2"]) for _ in range(rng.randrange(40))]
        at = rng.randrange(20)
        rows.append((100 + i, " ".join(own[:20] + shared[at : at + rng.randrange(25)] + own[20:] + ["r"] * rng.choice([0, 0, 15]))))
    width, texts = 10, [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + width]) for _, w in texts for i in range(len(w) - width + 1))
    wanted = []
    for d, w in texts:
        gone = {i + k for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for k in range(width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        wanted.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    found = substring_dedup(docs_of(spark, rows), width=width).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(wanted)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in found)
    assert substring_dedup(docs_of(spark, rows).limit(0)).count() == 0


def test_windows_match_brute_force():
    rng = random.Random(0)
    for _ in range(60):
        vocabulary = [f"w{i}" for i in range(rng.choice([2, 3, 8]))]
        texts = [" ".join(rng.choice(vocabulary + ["ZZ"]) for _ in range(rng.randrange(40))) for _ in range(8)] + [None, ""]
        items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(9))) for _ in range(4)]
        counts, spans, found = find_windows(pa.array(texts, pa.string()), compile_windows(list("abcd"), pa.array(items, pa.string()), 4))
        for text, n, span, items_found in zip(texts, counts, spans, found):
            words, hit, which = TOKEN.findall(fold(text)), set(), set()
            for k, item in enumerate(items):
                w = TOKEN.findall(fold(item))
                for x in {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else ():
                    for i in range(len(words) - len(x) + 1):
                        if tuple(words[i : i + len(x)]) == x:
                            hit.update(range(i, i + len(x)))
                            which.add(k)
            assert (n, {i for a, b in span for i in range(a, b)}, items_found) == (len(words), hit, which)


def test_contamination_on_odd_rows(spark):
    bench = spark.createDataFrame([("q1", "w1 W2 w3 w4"), ("q1", "w1 W2 w3 w4"), ("q2", None), ("q3", ""), (None, "w7 w8 w9")], "item_id string, text string")
    found = contamination(docs_of(spark, odd_rows()), bench, width=3)
    by = {(r.doc_id, r.text): r for r in remove_spans(found).withColumn("was", F.col("text")).collect()}
    hit = [r for r in by.values() if r.n_hit]
    assert {(r.doc_id, r.n_hit, tuple(r.items)) for r in hit} == {(1, 7, ("q1",)), (2, 7, ("q1",)), (None, 7, ("q1",)), (9, 3, ("q1",))}
    assert [r.text for r in hit if r.doc_id == 9] == [""] and all("w3" not in r.text.split() and "w5" in r.text for r in hit if r.doc_id == 1)
    assert found.count() == len(odd_rows()) and contamination(docs_of(spark, odd_rows()).limit(0), bench).count() == 0
    assert contamination(docs_of(spark, odd_rows()), bench.limit(0)).where("n_hit > 0").count() == 0


def test_mixing_meets_targets_and_caps(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 200)), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(400)] + [(r[0], r[1], None) for r in odd_rows()[:5]] + [(900, "", "zero")]
    got = mix_sources(docs_of(spark, [(i, " ".join(["w"] * (len(t or "") // 2)), s) for i, t, s in rows]))
    assert all(r.taken <= 3 * r.size for r in got.collect())
    by = {r.source: r for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.sum("size").alias("s"), F.max("source_size").alias("z")).collect()}
    total, sizes = sum(r.s for r in by.values()), {s: r.s for s, r in by.items()}
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full: set = set()
    while True:
        share = (total - sum(3 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in order if s not in full))
        more = {s for s in order if s not in full and weight[s] * share > 3 * sizes[s]}
        if not more:
            break
        full |= more
    for s in order:
        assert by[s].target == pytest.approx(3 * sizes[s] if s in full else weight[s] * share) and by[s].z == sizes[s]
        assert abs(by[s].t - by[s].target) <= 40
    assert mix_sources(docs_of(spark, rows).limit(0)).count() == 0


def test_quotas_follow_highest_quotients(spark):
    sizes = {"a": 3000, "b": 500, "c": 12_345, "d": 64, "e": 0}
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    quotas = block_quotas(source_targets(sources))
    rows = {r.source: r for r in quotas.collect()}
    v = {s: r.target * r.blocks / sizes[s] if sizes[s] else 0 for s, r in rows.items()}
    won: Counter = Counter()
    for _ in range(int(sum(v.values()) + 0.5)):
        won[max((s for s in v if won[s] < 3 * rows[s].blocks), key=lambda s: (v[s] / (2 * won[s] + 1), -rows[s].position))] += 1
    assert {s: r.quota for s, r in rows.items()} == {s: won[s] for s in sizes}
    dealt = shard_quotas(quotas, 4).collect()
    for key in ("source", "shard"):
        sums: Counter = Counter()
        for r in dealt:
            sums[r[key]] += r.blocks
        assert (dict(sums) == {s: won[s] for s in sizes}) if key == "source" else max(sums.values()) - min(sums.values()) <= 1


def test_mixed_documents_repeat_whole_rows(spark):
    docs = docs_of(spark, [(i, "a b c d e f g h " * 20, "rare" if i < 3 else "much") for i in range(60)])
    got = Counter(r.source for r in mixed_documents(docs).collect())
    assert mixed_documents(docs).columns == docs.columns
    assert abs(got["rare"] - 9) <= 1 and abs(got["much"] - 51) <= 2


def test_helper_columns_leave_the_tables_own_alone(spark):
    """Columns that are called like an operator's helpers keep their values, and columns that are missing count as null."""
    rows = [(i, f"word{i % 7} and more", f"s{i % 2}") + tuple(f"own{i}-{c}" for c in range(10)) for i in range(60)]
    names = ["_order", "_range", "_place", "_n", "_before", "_words", "_copies", "_copy", "_doc", "_Source"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    for out in (shard_documents(docs, 3), mixed_documents(docs)):
        got = out.toPandas()
        assert len(got) and list(got.columns)[: len(docs.columns)] == docs.columns
        for r in got.to_dict("records"):
            assert [r[c] for c in names] == [f"own{r['doc_id']}-{j}" for j in range(10)]
    shards = shard_documents(docs, 3).toPandas()
    assert len(shards) == 60 and all(sorted(s.slot) == list(range(len(s))) for _, s in shards.groupby("shard"))
    for gone in ("doc_id", "source"):
        assert mixed_documents(docs.drop(gone)).columns == docs.drop(gone).columns and mixed_documents(docs.drop(gone)).count() > 0
    assert mixed_documents(docs.drop("text")).count() == 0


def test_capacity_is_the_smallest():
    rng = random.Random(6)
    for _ in range(200):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 14))]
        prefix = [0]
        for s in sizes:
            prefix.append(prefix[-1] + s)
        best = smallest_capacity(prefix, 3, max(sizes))
        cuts = [max(prefix[a], prefix[b] - prefix[a], prefix[-1] - prefix[b]) for a in range(len(prefix)) for b in range(a, len(prefix))]
        assert best == min(cuts) and greedy_cuts(prefix, best, 3) is not None


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(300)) for i in range(500)] + [(i, "same text") for i in range(500, 620)] + odd_rows()[:5] + odd_rows()[6:]
    got = shard_documents(docs_of(spark, rows), shards=8).collect()
    assert len(got) == len(rows)
    groups, shards, slots = defaultdict(set), Counter(), defaultdict(list)
    sizes: Counter = Counter()
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 1
        groups[r.text].add(r.shard)
        sizes[hashlib.md5(r.text.encode()).hexdigest() if r.text is not None else "n"] += r["size"]
        shards[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in groups.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    prefix = [0]
    for k in sorted(sizes):
        prefix.append(prefix[-1] + sizes[k])
    assert max(shards.values()) == smallest_capacity(prefix, 8, max(max(sizes.values()), -(-prefix[-1] // 8)))
    assert shard_documents(docs_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("share", [0, 0.1, 0.6, 30])
def test_the_driver_holds_few_groups_beside_a_large_one(spark, monkeypatch, share):
    n, shards = 30_000, 8
    digest, size = F.md5(F.col("id").cast("string")), 20 + F.pmod(F.crc32(F.col("id").cast("string")), F.lit(100))
    groups = spark.range(n).select(digest.alias("digest"), F.when(F.col("id") == 17, size + int(share * 70 * n)).otherwise(size).cast("long").alias("bytes")).cache()
    rows = sorted((r.digest, r.bytes) for r in groups.collect())
    held, collect = [], type(groups).collect
    monkeypatch.setattr(type(groups), "collect", lambda df: held.append(collect(df)) or held[-1])
    cuts = partition_cuts(groups, shards)
    assert sum(map(len, held)) < 10_000  # 4,096 ranges
    prefix = [0]
    for _, b in rows:
        prefix.append(prefix[-1] + b)
    capacity = smallest_capacity(prefix, shards, max(max(b for _, b in rows), -(-prefix[-1] // shards)))
    assert cuts == [rows[c - 1][0] for c in greedy_cuts(prefix, capacity, shards)[:-1] if c < n]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = fit_languages(docs.where(~held))
    got = identify_language(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert got.where("lang_pred = lang").count() / got.count() > 0.97
    odd = {(r.doc_id, r.lang_pred == "und") for r in identify_language(docs_of(spark, odd_rows()), model).collect()}
    assert {d for d, und in odd if und} == {3, 4, 5, 10, None} and (1, False) in odd and (6, False) in odd
    assert identify_language(docs_of(spark, odd_rows()), fit_languages(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='cookie-notice'>c</div><article><h1>A &amp; B</h1><p>one<br>two\n three<p>four<b>five</b><script>if(a<b)x</script></p><section id=comments><p>me too</p></section></article><aside>s</aside><footer>&copy;</footer>"
    assert main_text(page) == "A & B\none two three\nfourfive"
    # No article: the box that every page of the host has goes, what differs stays.
    pages = [(i, f"http://h.example/{i}", f"<body><div class=box><p>Sign the guest book</p></div><div class=body><p>Text number {i} of {i * 7}</p></div>") for i in range(12)]
    pages += [(100, "http://one.example/", pages[0][2]), (101, None, None), (102, "http://h.example/", ""), (None, "u", "<p>x</p>" * 20_000), (5, *pages[5][1:])]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, host long")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract_main_text(df).collect()), key=str)
    wanted = [(i, f"Text number {i} of {i * 7}") for i in [*range(12), 5]] + [(100, "Sign the guest book\nText number 0 of 0"), (101, ""), (102, ""), (None, "\n".join(["x"] * 20_000))]
    assert got == sorted(((i, t, len(t)) for i, t in wanted), key=str)
    assert extract_main_text(df.limit(0)).count() == 0


def test_names_do_not_cut_the_article():
    story = "<h1>Title</h1><p>One two three four five.</p>"
    text = "Title\nOne two three four five."
    for name in ("layout has-sidebar", "content-with-sidebar", "page-sidebar"):
        assert main_text(f"<body><div class='{name}'><div class=body>{story}</div><div class=sidebar>s</div></div>") == text
        assert main_text(f"<body><div class='{name}'><article>{story}</article><div class=sidebar><article>teaser</article></div></div>") == text
    for name in ("post category-social", "comments-open", "social"):
        assert main_text(f"<body><article class='{name}'>{story}</article><p>x") == text
    assert main_text(f"<article><header class=entry-header><h1>Title</h1></header>{story[14:]}</article>") == text
    assert main_text(f"<article><div class=post-header><h1>Title</h1></div>{story[14:]}<div class=post-share>s</div></article>") == text
    assert main_text(f"<article>{story}<div id=comments><article>me too, and more than the story has in all of its words</article></div></article>") == text
    assert main_text("<body><p>Words <span class=ad>buy</span> go on</p><div class='top-banner'>b</div>") == "Words go on"


def test_main_text_keeps_what_names_and_forms_do_not_tell():
    framed = "<body><form id=aspnetForm><div class=menu>m</div><article><h1>T</h1><p>Body text.</p><form><label>Your mail</label></form></article></form>"
    assert main_text(framed) == "T\nBody text."
    assert main_text("<body><form>" + "<p>Long text of the page.</p>" * 20 + "<button>Go</button></form>").count("Long text") == 20
    assert main_text("<body><p>Hello</p><form><label>Your name</label></form>") == "Hello"
    assert main_text("<article><pre>x = 1 <span class='hljs-comment'># note</span></pre></article>") == "x = 1 # note"
    assert main_text("<article><h2 id=search>Search</h2><p>How.</p><h2 class=login>Login</h2><p>So.</p></article>") == "Search\nHow.\nLogin\nSo."
    story = "The long story. " * 20
    assert main_text(f"<body><article class=card><p>Teaser</p></article><div><p>{story}</p></div>") == f"Teaser\n{story.strip()}"
    assert main_text(f"<body><article><p>{story}</p></article><div><p>More links</p></div>") == story.strip()


def test_main_text_of_small_hosts(spark):
    """A block that all pages of a host have goes from two pages on; one page, copies of it, and a block of some pages do not decide."""
    box = "<div class=box><p>Sign the guest book</p></div>"
    page = lambda h, i, more="": f"<body>{box}<div class=body><p>Text {i} of {h}</p><p>More {i * 7}</p></div>{more}"
    pages = [(100 * n + i, f"http://h{n}.example/{i}", page(n, i)) for n in (1, 2, 3, 7) for i in range(n)]
    pages += [(900 + i, "http://copies.example/", page(9, 9)) for i in range(3)]
    pages += [(1000 + i, f"http://some.example/{i}", page(10, i, "<div class=gallery><p>Same picture</p></div>" if i < 2 else "")) for i in range(4)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    for n in (2, 3, 7):
        assert [got[100 * n + i] for i in range(n)] == [f"Text {i} of {n}\nMore {i * 7}" for i in range(n)]
    assert got[100].startswith("Sign") and all(got[900 + i].startswith("Sign") for i in range(3))
    assert got[1000] == "Text 0 of 10\nMore 0\nSame picture" and got[1003] == "Text 3 of 10\nMore 21"


def test_licences(spark):
    plain = [f"The {a} of the {b} is in this work and the author" for a in "sun moon tree river house".split() for b in "day night year city road".split()]
    model = train_licences(plain)
    rows = [(1, "Some text.\nReleased under the MIT License.\nMore."), (2, "Licensed under CC BY-NC 4.0."), (3, "I hold a driving licence and a fishing license."), *[(r[0] + 10 if r[0] else None, r[1]) for r in odd_rows()]]
    rows += [(4, "This work is licensed under the GNU General Public License, version 3.\nLicensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r for r in scan_licences(docs_of(spark, rows), model).collect()}
    assert (got[1].families, got[1].notices[0].paragraph, got[2].families, got[4].families) == ("mit", 1, "cc-by-nc", "apache,gpl")
    assert all(not got[d].families and not got[d].notices for d in got if d not in (1, 2, 4))
    assert scan_licences(docs_of(spark, rows).limit(0), model).count() == 0


def test_wrapped_licences(spark):
    wrapped = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
        "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted, provided that the above\r\ncopyright notice",
        "gpl": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or",
        "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either",
    }
    filler = " ".join(f"word{i}" for i in range(400))
    plain = [f"The {a} of the {b} is in this work and the author" for a in "sun moon tree river house".split() for b in "day night year city road".split()]
    rows = [(i, f"A title\n\n{t}\n\nMore.") for i, t in enumerate(wrapped.values())] + [(10 + i, f"{filler} {' '.join(t.split())} {filler}") for i, t in enumerate(wrapped.values())]
    rows += [(20, "\n\n".join(wrapped.values())), (21, wrapped["mit"].replace("\n", "\n\n"))]
    fitted = fit_licences(docs_of(spark, [(i, t) for i, t in enumerate([*plain, *wrapped.values()])]))
    for model in (train_licences(plain), fitted):
        got = {r.doc_id: r for r in scan_licences(docs_of(spark, rows), model).collect()}
        for i, family in enumerate(wrapped):
            assert [(n.paragraph, n.family) for n in got[i].notices] == [(2, family)]
            assert got[10 + i].families == family and len(got[10 + i].notices) == 1
        assert got[20].families == ",".join(sorted(wrapped)) and [n.paragraph for n in got[20].notices] == [0, 5, 8, 12, 16] and not got[21].notices


def test_search_matches_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"t{int(rng.expovariate(0.08))}" for _ in range(rng.randrange(1, 60)))) for i in range(1, 300)] + [(900 + i, t) for i, (_, t) in enumerate(odd_rows())]
    words = {d: Counter(TOKEN.findall(fold(t))) for d, t in rows}
    df = Counter(t for w in words.values() for t in w)
    n, mean = len(rows), sum(sum(w.values()) for w in words.values()) / len(rows)
    queries = [d for d, _ in rows if d % 40 == 0] + [900, 902, 903]
    got = defaultdict(list)
    asked = docs_of(spark, [r for r in rows if r[0] in queries]).withColumnRenamed("doc_id", "query_id")
    for r in bm25_top_k(docs_of(spark, rows), asked, k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, round(r.score, 6)))
    for q in queries:
        scores = {}
        for d, w in words.items():
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * sum(w.values()) / mean)) for t in words[q] if t in w)
            if any(t in w for t in words[q]):
                scores[d] = round(s, 6)
        assert got[q] == sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:7]
    assert bm25_top_k(docs_of(spark, rows).limit(0), asked).count() == 0


def test_search_over_many_shards_prunes_nothing_of_the_answer(monkeypatch):
    """A task that carries its scores from shard to shard finds what scoring every document in one piece finds, ties by id."""
    monkeypatch.setattr(bm25_search, "SHARD_BYTES", 1)
    rng = random.Random(10)
    for k in (1, 3, 10):
        texts = [" ".join(f"t{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(0, 120))) for _ in range(600)]
        texts += texts[:40]
        ids = np.arange(len(texts))
        asked = bm25_search.read_queries(ids[::25], pa.array(texts[::25]))
        counts, _, term, _ = bm25_search._occurrences(pa.array(texts), asked.vocabulary)
        df = np.bincount(term, minlength=len(asked.vocabulary))
        idf, mean = np.log1p((len(texts) - df + 0.5) / (df + 0.5)), counts.mean()
        whole, weight = bm25_search.Shard(pa.array(texts), ids, asked.vocabulary, idf, mean, 1.2, 0.75), np.zeros(len(asked.vocabulary))
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 90]), pa.array(texts[i : i + 90])], names=["doc_id", "text"]) for i in range(0, len(texts), 90)]
        shared = lambda value: type("Shared", (), {"value": value})
        found = defaultdict(list)
        for batch in bm25_search._searcher(shared(asked), shared((idf, mean)), k, 1.2, 0.75)(iter(batches)):
            for r in batch.to_pylist():
                found[r["query_id"]].append((r["doc_id"], round(r["score"], 6)))
        for q, query in enumerate(asked.ids):
            terms = asked.terms[asked.first[q] : asked.first[q + 1]]
            docs = np.arange(len(ids)) if len(terms) else np.zeros(0, np.int64)
            docs = docs[np.diff(whole.doc_first)[docs] > 0]
            scores = [(int(whole.doc_ids[d]), round(float(s), 6)) for d, s in zip(docs, whole._scores(docs, terms, weight)) if s > 0] if len(docs) else []
            assert found[query] == sorted(scores, key=lambda x: (-x[1], x[0]))[:k]


def test_search_scores_few_documents_in_full(monkeypatch):
    """Common terms are summed for all documents at once, so that few documents are left to score; the sums are those of the postings."""
    rng = random.Random(12)
    texts = [" ".join(f"t{int(rng.expovariate(0.01))}" for _ in range(rng.randrange(20, 120))) for _ in range(2_000)]
    ids, k, seen = np.arange(len(texts)), 5, []
    asked = bm25_search.read_queries(ids[::40], pa.array(texts[::40]))
    counts, _, term, _ = bm25_search._occurrences(pa.array(texts), asked.vocabulary)
    df = np.bincount(term, minlength=len(asked.vocabulary))
    shard = bm25_search.Shard(pa.array(texts), ids, asked.vocabulary, np.log1p((2_000 - df + 0.5) / (df + 0.5)), counts.mean(), 1.2, 0.75)
    weight, scores = np.zeros(len(asked.vocabulary)), bm25_search.Shard._scores
    monkeypatch.setattr(bm25_search.Shard, "_scores", lambda self, docs, *rest: (seen.append(len(docs)), scores(self, docs, *rest))[1])
    common = shard.common_sums(asked.terms, asked.first)
    assert 20 < len(shard.common_impact) < len(df)
    for q in range(len(asked.ids)):
        terms = asked.terms[asked.first[q] : asked.first[q + 1]]
        assert np.allclose(common[q], shard._sums(terms[shard.common_row[terms] >= 0]), rtol=1e-5)
        docs, found = shard.search(terms, k, 0.0, weight, common[q])
        best = np.sort(scores(shard, np.arange(2_000), terms, weight))[::-1][:k]
        assert np.allclose(np.sort(found)[::-1][:k], best) and not weight.any()
    assert sum(seen) <= 6 * k * len(asked.ids)


def test_tool_calls(spark):
    def call(conv, turn, id, args, name="f"):
        return (conv, turn, "assistant", '{"tool_calls":[{"id":%s,"function":{"name":"%s","arguments":%s}}]}' % (id, name, args))

    schemas = {"f": {"a": {"type": "integer", "required": True, "maximum": 9}, "s": {"type": "string", "enum": ["x", "y"]}, "after": {"type": "call"}}}
    rows = [
        call(1, 0, '"p"', r'"{\"s\": \"x\", \"a\": 3}"'), (1, 1, "tool", '{"tool_call_id":"p","content":"late"}'), (1, 1, "tool", '{"tool_call_id":"p","content":"early"}'),
        call(1, 2, '"q"', r'"{\"a\": 10, \"after\": \"r\", \"zz\": 1}"'), call(1, 3, '"r"', r'"{\"a\": \"no\"}"'), call(1, 4, '"p"', r'"{\"a\": 1}"'),
        call(2, 0, '"c"', r'"{\"a\": 1, \"after\": \"d\"}"'), call(2, 1, '"d"', r'"{\"a\": 1, \"after\": \"c\"}"'), call(2, 2, '"e"', r'"not json"'), call(2, 3, "null", r'"{\"a\":1, \"after\":\"gone\"}"'),
        call(None, 0, '"n"', '"{}"', "g"), (3, 0, "tool", '{"tool_call_id":"lost","content":null}'), (3, 1, "user", None), (3, 2, None, "x"), call(1, 0, '"p"', r'"{\"s\": \"x\", \"a\": 3}"'),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, step string, level int")
    got = {(r.conv_id, r.turn): r for r in link_tool_calls(df, schemas).collect()}
    assert len(got) == 9 + 1
    assert (got[1, 0].status, got[1, 0].result, got[1, 0].errors) == ("answered", "early", [])
    assert got[1, 0].line.startswith('{"arguments":{"a":3,"s":"x"},"call_id":"p"')
    assert got[1, 2].errors == ["a: against maximum", "zz: not an argument"] and got[1, 3].errors == ["a: not of type integer"]
    assert got[1, 4].status == "duplicate_id" and [got[1, t].step for t in (0, 3, 4, 2)] == [0, 1, 2, 3]
    assert got[2, 0].errors == got[2, 1].errors == ["refers in a circle"] and got[2, 2].errors == ["arguments: not an object"]
    assert got[2, 3].status == "no_id" and got[2, 3].errors == ["gone: no such call"] and {got[2, t].step for t in (0, 1)} == {2, 3}
    assert got[None, 0].errors == ["unknown function"] and got[3, 0].status == "orphan_result"
    assert link_tool_calls(df.limit(0), schemas).count() == 0


def test_each_result_without_a_call_has_a_row(spark):
    call = '{"tool_calls": [{"id": "a", "function": {"name": "f", "arguments": "{}"}}]}'
    tool = lambda i, c: f'{{"tool_call_id": "{i}", "content": "{c}"}}'
    rows = [(1, 0, "assistant", call), (1, 1, "tool", tool("a", "one")), (1, 2, "tool", tool("a", "two")), (1, 3, "tool", tool("b", "x")), (1, 4, "tool", tool("b", "y"))]
    got = link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"f": {}}).collect()
    wanted = [(0, "answered", "one"), (3, "orphan_result", "x"), (4, "orphan_result", "y")]
    assert sorted((r.turn, r.status, r.result) for r in got) == wanted
