"""Text operators against brute force, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, fertility, jaccard, licenses, line_dedup, packing, pii, quality, queries, toxicity, url_filter

FOLDER = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "word " * 30_000), (5, "same text here"), (5, "same text here"), (None, "no id, ünïcode 漢字"), (6, f"unique one\n{PASSAGE}\nend one"), (7, f"unique two\n{PASSAGE}\nend two")]
SCHEMA = "doc_id long, text string"


@pytest.fixture
def odd(spark):
    names = ("n_words", "score", "predicted", "piece", "length", "labels", "base", "class_id", "n_removed_words", "kept", "path")
    return spark.createDataFrame(ODD, SCHEMA).withColumns({n: F.lit("clash") for n in names})


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def operators(spark):
    lexicon, ensemble = toxicity.Lexicon((("^bad$", 5.0),), 8.0, -4.0), quality.learn(np.zeros((0, len(quality.STATISTICS))), np.zeros(0))
    benchmark = spark.createDataFrame([(1, "passage3 passage4 passage5"), (None, None)], "item_id long, text string")
    return {
        "pack": lambda d: packing.pack(packing.token_pieces(d, queries.vocabulary("word_bpe_49k.json"))),
        "toxicity": lambda d: toxicity.score(d, lexicon),
        "pii": pii.find,
        "quality": lambda d: quality.score(d, ensemble),
        "licenses": licenses.scan,
        "decontaminate": lambda d: decontamination.decontaminate(d, benchmark),
        "jaccard": jaccard.near_duplicates,
        "lines": line_dedup.remove_repeats,
        "fertility": lambda d: fertility.assess(d, queries.vocabulary("piece_bpe_32k.model")),
    }


@pytest.mark.parametrize("name", ["pack", "toxicity", "pii", "quality", "licenses", "decontaminate", "jaccard", "lines", "fertility"])
def test_odd_rows_and_empty_tables(spark, odd, name):
    run = operators(spark)[name]
    rows = run(odd).collect()
    assert len(rows) == len(ODD) + (7 if name == "pack" else 0)
    assert run(odd.limit(0)).collect() == []


def test_url_filter_odd_rows(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.example.org/es/x?y"), (3, "http://A.example.org/es/x?y"), (4, "x://h.com/fr/1#z"), (5, "http://www.cheap-pills.net/")]
    got = [tuple(r) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert got == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), *[(3, "a.example.org", "/es/x", "example.org/es/", "block")] * 2, (4, "h.com", "/fr/1", "com/fr/", "allow"), (5, "www.cheap-pills.net", "/", None, "block")]


def test_pieces_and_packing(spark, documents):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    got = queries.op2_best_fit_packing(spark, FOLDER).collect()
    want = set()
    for i, t in texts(documents).items():
        ids = [*made.encode(t, add_special_tokens=False).ids, 1]
        want |= {(i, a // 4096, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for a in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) == packing.lower_bound(np.bincount([r.length for r in got], minlength=4097), 4096)


def test_base_spans(spark, documents):
    def brute(t):
        luhn = lambda v: sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate([int(c) for c in v if c.isdigit()][::-1])) % 10 == 0
        kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, n: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, n: all(int(p) <= 255 for p in v.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda v, n: 13 <= n <= 19 and luhn(v)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, n: 9 <= n <= 15)]
        return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t) if ok(m[0], sum(c.isdigit() for c in m[0])))

    tricky = spark.createDataFrame([(-1, "a@b.c_d@e.f x@y @z.w é 漢 4111 1111 1111 1111 1.2.3.4.5.6.7.8 999.1.1.1 +1 (555) 123-4567. 20 a@b.co")], SCHEMA)
    both = documents.select("doc_id", "text").union(tricky)
    got = pii.digest(pii.find(both)).collect()
    want = {i: hashlib.sha256(brute(t).encode()).hexdigest() for i, t in texts(both).items()}
    assert {r.doc_id: r.base_sha256 for r in got} == want


def test_license_places(spark, documents):
    for r in queries.op6_license_scans(spark, FOLDER).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts(documents)[r.doc_id]))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_fertility_counts(spark, documents):
    whole = texts(documents)
    for r in queries.op10_quality_rules(spark, FOLDER).collect():
        t = whole[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        twice = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 3000 else None
        lines = t.split("\n")
        dup = sum(bool(x.split()) and x in lines[:i] for i, x in enumerate(lines))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup)
        if twice is not None:
            assert r.n_repeat_words == len({j for i, g in enumerate(grams) if g in twice for j in range(i, i + 8)})


def test_passages_go_from_later_places(spark, odd):
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(odd).collect()}
    assert PASSAGE in got[6] and PASSAGE not in got[7] and got[7] == "unique two\nend two" and got[1] is None


def lines_left(docs):
    """Loops over all windows of whole lines, in the order in which places stay."""
    seen, left = set(), {}
    for i, text in docs:
        lines = text.split("\n")
        own = [k for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for at in range(len(own)):
            for end in range(at, len(own)):
                key = tuple(lines[k] for k in own[at : end + 1])
                if sum(len(x.split(" ")) for x in key) < 50:
                    continue
                if key in seen:
                    gone |= set(range(own[at], own[end] + 1))
                seen.add(key)
        left[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return left


def test_blank_lines_do_not_break_passages(spark):
    paragraphs = [" ".join(f"p{k}word{i}" for i in range(n)) for k, n in enumerate((20, 40, 30))]
    rows = [(i, f"begin {i}\n" + "\n\n".join(paragraphs) + f"\nend {i}") for i in range(1, 4)] + [(4, "begin 4\n" + "\n \n\n".join(paragraphs) + "\nend 4")]
    got = {r.doc_id: (r.text, r.n_removed_words) for r in line_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (rows[0][1], 0)} | {i: (f"begin {i}\nend {i}", 90) for i in (2, 3, 4)}


def test_every_passage_of_whole_lines_goes(spark):
    draw = np.random.default_rng(5)
    pool = [" ".join(f"v{w}" for w in draw.integers(0, 9999, n)) for n in draw.choice([1, 5, 13, 17, 25, 60], 90)]
    own = iter(range(10**6))
    filler = lambda: [f"own{next(own)} line" for _ in range(draw.integers(1, 4))]
    rows = []
    for i in range(60):
        parts = filler()
        for a in draw.integers(0, 84, draw.integers(1, 5)):
            parts += [*pool[a : a + draw.integers(1, 7)], *([""] * draw.integers(0, 2)), *filler()]
        rows.append((i, "\n".join(parts)))
    # The first place of each line is in a document that shares nothing else with the rest.
    rows += [(i - 100, pool[i]) for i in range(90)]
    rows.sort()
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = lines_left(rows)
    assert got == want and sum(t != dict(rows)[i] for i, t in want.items()) > 10


def test_near_duplicates(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words[:-1], "other"])), (4, "something else entirely, of other words than those"), (5, None)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0), 5: (5, 0)}
    assert {r.doc_id for r in jaccard.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 4, 5}


def sets_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_of(texts):
    """Numbers of the groups that similarities of 0.8 and more connect, by loops."""
    sets, group = [sets_of(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * len(a & b) >= 4 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_one_of_each_with_null_and_repeated_ids(spark):
    texts = [" ".join(f"{name}{i}" for i in range(60)) for name in ("a", "b", "c", "d")]
    near = texts[0].replace("a59", "other")
    rows = [(None, texts[0]), (None, near), (None, texts[1]), (None, texts[2]), (9, texts[2]), (5, texts[3]), (5, "one unrelated text under the id of another"), (5, texts[3]), (None, "..."), (None, None)]
    got = [(r.doc_id, r.text) for r in jaccard.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == 7 and sum(t in (texts[0], near) and i is None for i, t in got) == 1
    assert {r for r in got if r[1] not in (texts[0], near)} == {(None, texts[1]), (9, texts[2]), (5, texts[3]), rows[6], (None, "..."), (None, None)}


def test_pipeline_stages_against_loops(spark, documents):
    import corpus_pipeline

    # Every third id is null, and every seventh is that of another document.
    docs = documents.withColumn("doc_id", F.expr("case when doc_id % 3 = 0 then null when doc_id % 7 = 0 then doc_id - 7 else doc_id end")).orderBy("text").limit(150).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    group = groups_of([t for _, t in rows])
    key = lambda i: (i is None, i or 0)
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g), key=key) for g in group}
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect()]
    at = {r: group[k] for k, r in enumerate(rows)}
    assert sorted(at[r] for r in kept) == sorted(set(group))
    assert all(i == least[at[i, t]] for i, t in kept)
    want = lines_left(sorted((r.doc_id, r.text) for r in documents.collect()))
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, documents, FOLDER).collect()}
    assert got == {i: t for i, t in want.items() if t.strip() or t == texts(documents)[i]}


def test_span_removal_and_blocks(spark, odd):
    items = spark.createDataFrame([(i, f"passage{i} passage{i + 1}") for i in range(3, 20, 4)], "item_id long, text string")
    one, many = ([(r.doc_id, r.hit_spans, r.item_ids) for r in decontamination.decontaminate(odd, items, block_words=n).orderBy("doc_id", "text").collect()] for n in (10_000, 4))
    assert one == many
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(odd, items, mode="spans").collect()}
    assert "passage3 " not in cut[6] and "passage5" in cut[6]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for query, label, least in ((queries.op3_toxicity, "toxic", 0.9), (queries.op5_quality_classifier, "quality", 0.9)):
        got = query(spark, folder).filter("held_out").join(labels, "doc_id").collect()
        assert sum(r.predicted == r[label] for r in got) / len(got) >= least


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
        docs = kept
