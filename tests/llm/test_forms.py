"""Text operators on hard inputs and against loops: long runs, other scripts, sizes of groups, scores and labels."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, fertility, folds, jaccard, licenses, line_dedup, packing, pii, quality, queries, texts, toxicity, url_filter
from tests.llm.test_operators import FOLDER, ODD, SCHEMA, lines_left, operators, sets_of

MANY = 100_000


def test_very_long_runs_of_personal_data(spark):
    rows = [(1, "a@" + "b." * MANY + "com"), (2, "1" * MANY + "@x.com"), (3, "1." * MANY), (4, "1 " * MANY), (5, "+1" + " " * MANY), (6, "a1_" * MANY), (7, "x@y.com " * 20_000), (8, "0" * MANY)]
    got = {r.doc_id: r for r in pii.digest(pii.find(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert [got[i].n_email for i, _ in rows] == [1, 1, 0, 0, 0, 0, 20_000, 0] and got[3].n_ip == MANY // 4
    assert got[7].spans.startswith("email:0:7,email:8:15,") and got[7].spans.endswith(f"email:{8 * 19_999}:{8 * 20_000 - 1}")


def test_extra_spans_against_loops(spark):
    parts = ["token: sk-Abc123def456ghi789jkl0", "my key 00000000000000000000 end", "no_digits_in_this_long_name_at_all", "IBAN DE89 3704 0044 0532 0130 00.", "SSN 123-45-6789, not 1123-45-6789", "Dear Mr John Smith and Frau Müller", "path/to/Abc123def456ghi789jkl012x", "x" * 300 + "1"]
    texts_ = [(i, " ".join(parts[i % len(parts) :] + parts[: i % len(parts)])) for i in range(24)]
    frame = spark.createDataFrame(texts_, SCHEMA)
    forms = {
        "secret": (r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_/+=-])", lambda v: any(c.isdigit() for c in v)),
        "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda v: True),
        "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda v: True),
        "person": (r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau)\.? [A-ZÄÖÜ][a-zäöü]+(?: [A-ZÄÖÜ][a-zäöü]+)?", lambda v: True),
    }
    for kind, (form, passes) in forms.items():
        got = {r.doc_id: [(s.start, s.end) for s in r.s] for r in frame.select("doc_id", pii.spans_of(kind, F.col("text")).alias("s")).collect()}
        assert got == {i: [m.span() for m in re.finditer(form, t) if passes(m[0])] for i, t in texts_}, kind
    found = {r.doc_id: r for r in pii.find(frame).collect()}
    for i, t in texts_:
        values = {t[s.start : s.end] for s in found[i].added}
        assert {"sk-Abc123def456ghi789jkl0", "DE89 3704 0044 0532 0130 00"} <= values and "0" * 20 not in values
        assert not any(b.start < s.end and s.start < b.end for s in found[i].added for b in found[i].base)


def test_links_do_not_depend_on_the_size_of_a_group(spark):
    draw = np.random.default_rng(1)
    words = [f"w{i}" for i in range(110)]
    rows = []
    for k in range(150):
        own = list(words)
        for at in draw.integers(0, 110, draw.integers(0, 4)):
            own[at] = f"x{draw.integers(10**6)}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, "a text of which there are many copies") for k in range(1500)] + [(None, None), (3000, "...")]
    frame = spark.createDataFrame(rows, SCHEMA)
    sets = [sets_of(t) for _, t in rows[:150]]
    want = {i: sum(i != j and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    for size in (jaccard.WHOLE_GROUP, 1):
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(frame, whole_group=size).collect()}
        assert {i: got[i][1] for i in want} == want
        assert {got[1000 + k] for k in range(1500)} == {(1000, 1499)} and got[None] == (None, 0) and got[3000] == (3000, 0)


def test_lines_of_other_scripts_and_white_space(spark):
    chinese = ["".join(chr(0x4E00 + 37 * k + i) for i in range(30)) for k in range(4)]
    tabbed = ["\t".join(f"t{k}x{i}" for i in range(20)) for k in range(4)]
    spaced = ["  " + "   ".join(f"s{k}x{i}" for i in range(5)) + "  \r" for k in range(4)]  # 20 words in all
    rows = [(10 * n + i, f"begin {n} {i}\n" + "\n".join(own) + f"\nend {n} {i}") for n, own in enumerate((chinese, tabbed, spaced)) for i in (1, 2)]
    got = {r.doc_id: (r.text, r.n_removed_words) for r in line_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2] == ("begin 0 2\nend 0 2", 120) and got[12] == ("begin 1 2\nend 1 2", 80)
    assert all(got[i] == (t, 0) for i, t in rows if i not in (2, 12))


def test_recall_of_passages_by_shape(spark):
    """Passages of all shapes between lines of their own, every one twice: all are found."""
    rows, want = [], 0
    for shape, (lines, words) in enumerate([(6, 9), (10, 6), (6, 12), (12, 12), (3, 18), (50, 1), (1, 60)]):
        for k in range(10):
            passage = "\n".join(" ".join(f"q{shape}k{k}l{i}w{j}" for j in range(words)) for i in range(lines))
            for copy in (0, 1):
                rows.append((1000 * shape + 10 * k + copy, f"own {shape} {k} {copy} before\n{passage}\nown {shape} {k} {copy} after"))
            want += lines * words
    got = line_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.n_removed_words for r in got) == want
    assert {r.doc_id: r.text for r in got} == lines_left(rows)


def test_runs_that_differ_in_bytes_stay(spark):
    docs = spark.createDataFrame([(1, 11, "a\nb\nc"), (2, 22, "x\na\n\nb"), (3, 33, "a\nB")], "id long, hash long, text string")
    runs = spark.createDataFrame([(2, 22, 1, 3, 1, 11, 0, 1), (3, 33, 0, 1, 2, 22, 1, 3)], "id long, hash long, a int, e int, first_id long, first_hash long, first_a int, first_e int")
    assert [tuple(r) for r in line_dedup.differing(docs, runs).collect()] == [(2, 22, 1, 3)]


def test_only_the_run_that_differs_stays(spark):
    docs = spark.createDataFrame([(1, 11, "a\nb\nc"), (None, 22, "x\na\n\nb"), (3, 33, "a\nB"), (3, 33, "a\nB"), (4, 44, "a\nb")], "id long, hash long, text string")
    runs = spark.createDataFrame([(None, 22, 1, 3, 1, 11, 0, 1), (3, 33, 0, 1, 1, 11, 0, 1), (4, 44, 0, 1, 1, 11, 0, 1), (4, 44, 0, 0, 1, 11, 0, 0)], "id long, hash long, a int, e int, first_id long, first_hash long, first_a int, first_e int")
    places = line_dedup.differing(docs, runs)
    assert [tuple(r) for r in places.collect()] == [(1, 11, 0, 1)]
    assert [tuple(r)[:4] for r in line_dedup.unlike(docs, runs, places).collect()] == [(3, 33, 0, 1)]


def test_boundaries_keep_every_chunk_that_repeats(spark):
    """Random lines from few words: chunks of one line and of many, copies of rows, null ids, passages within one text."""
    draw = random.Random(7)
    rows = [(i if i % 9 else None, "\n".join(" ".join(draw.choice("abc") for _ in range(draw.choice([0, 1, 2, 3, 12]))) for _ in range(draw.randrange(30)))) for i in range(200)]
    rows += rows[:20] + [(500, "\n".join(["one two three four five six"] * 9)), (501, "t u v w x y z t"), (502, "t u v w x y z t")]
    docs = spark.createDataFrame(rows, SCHEMA).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    chunks = line_dedup._windows(docs, 8)
    places = {}
    for r in chunks.collect():
        places.setdefault(r.h, set()).add((r.id, r.hash, r.a))
    kept = {(r.h, r.id, r.hash, r.a) for r in line_dedup.bounded_chunks(chunks).collect()}
    want = {(h, *p) for h, found in places.items() if len(found) > 1 for p in found}
    assert want and want <= kept and len(kept) < sum(map(len, places.values()))


def test_components_of_hubs_paths_and_cycles(spark, monkeypatch):
    """Labels are those of a loop, where keys are hot and where none is."""
    edges = [(0, i) for i in range(1, 1300)] + [(i, i + 1) for i in range(2000, 2060)] + [(3000, 3001), (3001, 3002), (3002, 3000), (4000, 4000), (5001, 5000), (5001, 5000)]
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(70):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components.components(frame).collect()} == root
    assert components.components(frame.limit(0)).collect() == []


def test_tokens_and_verdicts_of_whole_texts(spark):
    model, is_byte = fertility.piece_model(queries.vocabulary("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, "漢字 " * 50), (-2, "a b\n\n\tc   d " * 40), (-3, "\u2605 " * 80), (-4, "same " * 500)], SCHEMA))
    whole = {r.doc_id: r.text for r in docs.collect()}
    reasons = set()
    for r in fertility.assess(docs, queries.vocabulary("piece_bpe_32k.model"), least_texts=10**9).collect():
        ids = model.encode(whole[r.doc_id] or "")
        if not ids or not (whole[r.doc_id] or "").split():
            continue
        shares = [ids.count(i) / len(ids) for i in set(ids)]
        entropy, fallback, chars = -sum(p * math.log2(p) for p in shares), sum(bool(is_byte[i]) for i in ids) / len(ids), r.word_chars / len(ids)
        assert (round(r.token_entropy, 6), round(r.byte_fallback, 9), round(r.chars_per_token, 9)) == (round(entropy, 6), round(fallback, 9), round(chars, 9))
        band = fertility.BANDS[r.script]
        bad = len(ids) >= 64 and (not band.chars_per_token[0] <= chars <= band.chars_per_token[1] or fallback > band.most_fallback or entropy < band.least_evenness * math.log2(min(len(ids), 1024)))
        assert r.kept == (not r.base_failed and not bad)
        reasons.add(r.reason)
    assert {None, "base", "token_entropy"} <= reasons
    assert [fertility.script_of(t) for t in ("abc", "漢字", "при", "123 [_]", "ה", "é×", "한글")] == ["latin", "cjk", "cyrillic", "other", "hebrew", "latin", "hangul"]


def band_of(values, measure):
    """Limits down and up from the nearest-rank quartiles of rounded values."""
    own = sorted(round(v, 3) for v in values)
    q1, md, q3 = (own[max(0, math.ceil(p * len(own)) - 1)] for p in (0.25, 0.5, 0.75))
    least = fertility.LEAST_DEVIATION[measure]
    reach = lambda way: fertility.REACH.get(f"{measure}_{way}", 0)
    return md - reach("down") * max((md - q1) / 0.6745, least), md + reach("up") * max((q3 - md) / 0.6745, least)


def test_bands_of_languages_and_each_reason(spark):
    """Bands by language against a loop; copies count once; texts of letters, of bytes and of few words fall out of their band."""
    odd = [(-1, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 6, "en"), (-2, " ".join(f"\u2603{chr(0x1F300 + i)} word{i}" for i in range(60)), "en"), (-3, " ".join(["one", "two", "three", "four", "five", "six", "seven"][i * i % 7] + "ab"[i % 2] for i in range(40)) + " " + " ".join("x" * (i % 9 + 1) for i in range(40)), "de"), (-4, None, None), (-5, "", "en"), (-6, "short text", "xx")]
    draw, model = np.random.default_rng(1), fertility.piece_model(queries.vocabulary("piece_bpe_32k.model"))[0]
    common = "information government development production company history between national public different".split()
    mixed = [" ".join(str(draw.choice(common)) if draw.random() < share else "of" if draw.random() < 0.5 else chr(0x1F300 + int(draw.integers(200))) for _ in range(200)) for share in np.arange(0.05, 0.9, 0.01)]
    near = min(mixed, key=lambda t: abs(len("".join(t.split())) / len(model.encode(t)) - 2.2))
    odd.append((-7, near, "en"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    copies = docs.filter("doc_id = 3").crossJoin(spark.range(400)).select((-1000 - F.col("id")).alias("doc_id"), "text", "lang")
    docs = docs.union(copies).union(spark.createDataFrame(odd, "doc_id long, text string, lang string")).withColumn("Kept", F.lit("clash"))
    rows = fertility.assess(docs, queries.vocabulary("piece_bpe_32k.model"), keep=["doc_id", "lang"], language="lang", least_texts=60).collect()
    even = lambda r: r.token_entropy / math.log2(min(r.n_tokens, 1024))
    limits = {}
    for lang in {r.lang for r in rows} - {None}:
        own = {(r.n_tokens, r.chars_per_token, r.byte_fallback, r.token_entropy): r for r in rows if r.lang == lang and not r.base_failed and r.n_tokens >= 64}.values()
        if len(own) >= 60:
            limits[lang] = [band_of([f(r) for r in own], m) for m, f in (("chars", lambda r: r.chars_per_token), ("fallback", lambda r: r.byte_fallback), ("even", even))]
    assert set(limits) >= {"en", "de", "fr"}
    for r in rows:
        fixed = fertility.BANDS[r.script or "other"]
        chars, fallback, least = limits.get(r.lang) or (fixed.chars_per_token, (0, fixed.most_fallback), (fixed.least_evenness, 1))
        want = "base" if r.base_failed else None if r.n_tokens < 64 else "chars_per_token" if not chars[0] <= r.chars_per_token <= chars[1] else "byte_fallback" if r.byte_fallback > fallback[1] else "token_entropy" if even(r) < least[0] else None
        assert r.reason == want or any(abs(a - b) < 1e-9 for a, b in ((r.chars_per_token or 0, chars[0]), (r.chars_per_token or 0, chars[1])))
        assert r.kept == (r.reason is None)
    assert {r.reason for r in rows} == {None, "base", "chars_per_token", "byte_fallback", "token_entropy"}
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    kept = {r.doc_id: r for r in rows}
    labelled = [kept[r.doc_id] for r in good.collect() if r.doc_id in kept and not kept[r.doc_id].base_failed]
    assert sum(r.kept for r in labelled) >= 0.98 * len(labelled)


LICENSED = {
    "Apache 2.4 web server": "", "PHP 3.0 was released": "", "my elastic 2.0 band": "", "available under Vim and Ruby": "", "boost 1.0": "", "ruby license plate": "",
    "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "Licensed under the Apache License, Version 2.0": "apache,apache-2.0,license-notice",
    "This is under the MIT License.": "mit", "GNU General Public License v3 or later": "gpl,gpl-3.0-or-later", "a BSD 3-Clause license": "bsd-3-clause",
    "Neither the name of the University of X nor the names of its contributors may be used": "bsd-3-clause", "CC BY-SA 4.0": "cc-by-sa-4.0", "": "",
}


def test_license_labels_and_suppression(spark):
    frame = spark.createDataFrame(list(enumerate(LICENSED)), SCHEMA)
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    assert [got[i].labels for i in range(len(LICENSED))] == list(LICENSED.values())
    for r in got.values():
        spans = [(d.first_word, d.end_word) for d in r.detections]
        assert all(0 <= a < b <= r.n_words for a, b in spans)
        assert r.score == max([d.weight for d in r.detections] + [0.7 * (r.n_base > 0)])
    # No detection lies inside another of the same or a higher priority, by loops over all matches.
    scanner = licenses.Scanner()
    for text in LICENSED:
        joined = " " + " ".join(w.decode() for w in texts.words_of(text.encode())) + " "
        found = [(m.start(), m.end(), s) for s, p in scanner.rules for m in p.finditer(joined)]
        left = {(a, b, s.label) for a, b, s in found if not any((c, d) != (a, b) and c <= a and b <= d and t.priority >= s.priority for c, d, t in found)}
        assert {(a, b, s.label) for a, b, s in scanner.detections(joined)} <= left | {(a, b, s.label) for a, b, s in found if (a, b) in {(c, d) for c, d, _ in left}}
    began = time.perf_counter()
    long = licenses.scan(spark.createDataFrame([(1, "mit license " * 300_000)], SCHEMA)).select("n_base", "last_word").first()
    assert tuple(long) == (300_000, 599_998) and time.perf_counter() - began < 60


def test_exchanges_keep_every_piece(spark):
    draw = np.random.default_rng(2)
    for low, high in ((1, 4097), (900, 1800), (1300, 2100)):
        rows = [(i, int(n)) for i, n in enumerate(draw.integers(low, high, 3000))]
        pieces = spark.createDataFrame(rows, "doc_id long, length long")
        got = packing.pack(pieces, per_partition=200).collect()
        held = {}
        for r in got:
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert sorted((r.doc_id, r.length) for r in got) == rows
        for parts in held.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert [at for at, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
        alone = sum(packing.best_fit_decreasing(np.array([n for _, n in rows[a : a + 200]]), 4096)[2].size for a in range(0, 3000, 200))
        assert packing.lower_bound(np.bincount([n for _, n in rows], minlength=4097), 4096) <= len(held) <= alone + 15


def test_rules_as_a_table_judge_alike(spark):
    rules = spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.tokens), r.rank) for r in url_filter.RULES] + [("", "block", "^nothing$", None, 1)], "name string, verdict string, pattern string, tokens array<string>, rank int")
    rows = [(1, None), (2, ""), (3, "http://A.example.org/es/x?y"), (3, "http://A.example.org/es/x?y"), (4, "x://h.com/fr/1#z"), (5, "http://www.cheap-pills.net/"), (6, "http://x.org/" + "a/" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({n: F.lit("clash") for n in ("host", "Verdict", "rule")})
    pages = pages.unionByName(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").withColumns({n: F.lit("clash") for n in ("host", "Verdict", "rule")}))
    one = url_filter.judge(pages)
    assert one.columns == ["page_id", "url", "host", "path", "rule", "verdict"] and one.filter("rule = 'clash' or verdict = 'clash'").count() == 0
    for most in (100_000, 1):
        many = url_filter.judge_by_table(pages, rules, most_broadcast=most)
        assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0
    assert url_filter.judge(pages.limit(0)).count() == url_filter.judge_by_table(pages.limit(0), rules).count() == 0
    more = url_filter.RULES + [url_filter.host_word_rule("block", f"w{i}-v{i}") for i in range(url_filter.MOST_IN_PLAN)]
    many = url_filter.judge(pages, more)
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0


def test_toxicity_scores_against_loops(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    lexicon = toxicity.fit(docs, labels)
    own = [(-1, "an 1d1ot and the id\u0456ot"), (-2, "idiot proof idiot light"), (-3, ""), (-4, None)]
    lexicon = toxicity.Lexicon((*lexicon.weights, ("^idiot$", 4.0)), lexicon.slope, lexicon.offset, ("idiot proof",))
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(own, SCHEMA))
    whole = {r.doc_id: r.text for r in frame.collect()}
    for r in toxicity.score(frame, lexicon).collect():
        words = toxicity.folded(whole[r.doc_id]).split()
        excused = {i for i in range(len(words) - 1) if words[i : i + 2] == ["idiot", "proof"]}
        excused |= {i + 1 for i in excused}
        total, n = 0.0, 0
        for i, word in enumerate(words):
            fits = [w for e, w in lexicon.weights if (word == e[1:-1] if e.endswith("$") else word.startswith(e[1:]))]
            if fits and i not in excused:
                total, n = total + max(fits), n + 1
        p = 1 / (1 + math.exp(-max(-40, min(40, lexicon.offset + lexicon.slope * total / math.log2(2 + len(words))))))
        assert r.n_matches == n and abs(r.score - p) < 1e-9 and r.predicted == int(p >= 0.3)
    held = {r.doc_id: r.n_matches for r in toxicity.score(spark.createDataFrame(own, SCHEMA), lexicon).collect()}
    assert held == {-1: 2, -2: 1, -3: 0, -4: 0}


def test_quality_scores_against_loops(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    ensemble = quality.fit(docs, labels)
    assert 0 < len(ensemble.rules) < 300
    for r in quality.score(docs, ensemble).collect():
        facts = dict(zip(quality.STATISTICS, quality.statistics((r.text or "").encode()), strict=True))
        total = ensemble.offset + sum(rule.weight for rule in ensemble.rules if all(facts[n] > t if greater else facts[n] <= t for n, greater, t in rule.conditions))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9 and r.predicted == int(r.score >= 0.3)


def test_held_out_recall_and_precision(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    toxic = [(r.toxic, r.predicted) for r in queries.op3_toxicity(spark, folder).filter("held_out").join(labels, "doc_id").collect()]
    assert sum(p for y, p in toxic if y) >= 0.8 * sum(y for y, _ in toxic) and sum(p for y, p in toxic if not y) <= 0.02 * len(toxic)
    good = [(r.quality, r.predicted) for r in queries.op5_quality_classifier(spark, folder).filter("held_out").join(labels, "doc_id").collect()]
    assert sum(p for y, p in good if y) >= 0.98 * sum(y for y, _ in good) and sum(p for y, p in good if not y) <= 0.1 * sum(1 - y for y, _ in good)


def test_repeated_ids_add_no_rows_to_a_fit(spark):
    docs = spark.createDataFrame([(i % 20, f"text {i}") for i in range(400)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    got = folds.fit_sample(docs, labels, "toxic", 4, 2, rows=10).collect()
    assert len(got) == len({r.doc_id for r in got}) <= 10


def test_added_columns_take_the_place_of_clashing_ones(spark):
    added = {"toxicity": ("score", "predicted"), "pii": ("base",), "quality": ("score", "predicted"), "licenses": ("n_words", "labels", "score"), "jaccard": ("class_id",), "lines": ("n_removed_words",), "fertility": ("n_words", "kept")}
    odd = spark.createDataFrame(ODD, SCHEMA)
    for name, columns in added.items():
        run = operators(spark)[name]
        clean, clashing = run(odd), run(odd.withColumns({c: F.lit("clash") for c in columns}).withColumn("other", F.lit(1)))
        assert set(clashing.columns) == {*clean.columns, "other"}, name
        key = lambda rows: sorted(str([r[c] for c in clean.columns]) for r in rows)
        assert key(clean.collect()) == key(clashing.collect()), name
    values = {r.text: r for r in operators(spark)["fertility"](odd).collect()}
    assert (values[None].n_words, values[None].kept, values[""].n_words, values["same text here"].n_words) == (0, False, 0, 3)
    same = [r.class_id for r in operators(spark)["jaccard"](odd).filter("text = 'same text here'").collect()]
    assert same == [5, 5]


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    frame = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, frame = frame, stage(spark, frame, FOLDER).cache()
        assert frame.columns == docs.columns and frame.count() <= before.count(), name
        assert stage(spark, before.limit(0), FOLDER).count() == 0, name
    # Null and blank texts are clean, so that they stay; copies go to one.
    kept = [(r.doc_id, r.text) for r in frame.filter("source = 's'").collect()]
    assert {(1, None), (2, ""), (3, "   \n")} <= set(kept) and kept.count((5, "same text here")) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER)
    assert packed.select("doc_id").distinct().count() == frame.select("doc_id").distinct().count()
    assert corpus_pipeline.STAGES[-1][1](spark, frame.limit(0), FOLDER).count() == 0
