"""Each operator against brute force or its oracle, and on awkward tables."""

import base64
import hashlib
import itertools
import os
import random
import re
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vantage.llm import language, line_dedup, ngram_join, quality, queries, set_join, url_filter
from vantage.llm.bpe import decode, encode_documents, encode_texts, loaded
from vantage.llm.decontaminate import LEAST_WORDS, MASKS, decontaminated, leaks, longest_overlap, short_masks
from vantage.llm.exact_dedup import CountingQuotientFilter, exact_duplicates
from vantage.llm.line_dedup import characters, dedup_lines, jaccard, overlaps
from vantage.llm.ngram_join import near_duplicates
from vantage.llm.secrets import find_secrets, listed
from vantage.llm.set_join import PrefixTree
from vantage.llm.shared import components
from vantage.llm.warc import archive, lookup, opened, parse, read_records, read_seek_table

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False):
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)
    return df.withColumns({"group_size": F.lit(1), "score": F.lit("x"), "dropped": F.lit(0), "component": F.lit("c")}) if extra else df


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


AWKWARD = [None, "", " \n\t ", "a", "é" * 3000, "word " * 4000, "x\n\n\ny", "same text here", "same text here", "\x00\x01 odd \ud7ff", "1234 5678"]


# ---------------------------------------------------------------- shared


def test_components_by_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1


def test_url_rules_and_mining(spark):
    urls = ["http://A.Example.com/en/x?q=1", "https://www.example.com/en/", "http://shop.net/es/1", "http://shop.net/fr", "https://x.org/a#t", "no scheme", None, "http://example.com", "http://notexample.com/en/a", "x://h://com/"]
    pages = spark.createDataFrame([(k, u, "<p>") for k, u in enumerate(urls)], "page_id long, url string, html string").withColumn("verdict", F.lit(1))
    got = {r["page_id"]: r for r in url_filter.judge(pages, []).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) for k in range(len(urls))] == [
        ("a.example.com", "/en/x", "example.com/en/", "block"),
        ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("shop.net", "/es/1", "net/es/", "block"),
        ("shop.net", "/fr", None, "allow"),
        ("x.org", "/a", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("example.com", "", None, "allow"),
        ("notexample.com", "/en/a", "com/", "allow"),
        ("h:", "//com/", None, "allow"),
    ]
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        spam = k % 3 == 0
        rows.append((k, f"http://{'win-casino' if spam else rng.choice(['news', 'blog', 'win-prize', 'casino-guide'])}.site{rng.randrange(9)}.org/{rng.choice(['a', 'b'])}/{k}?ref=x", ""))
        labels.append((k, 0 if spam else 1, 0))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("url", F.lit(1))
    mined = url_filter.mine(pages.union(pages.limit(50)), labelled)
    tokens = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", url_filter.tokens_of(F.col("url")).alias("t")).collect()}
    assert {r.verdict for r in mined} == {"block", "allow"}
    for r in mined:  # support and confidence by counting
        having = [k for k in tokens if set(r.tokens) <= tokens[k]]
        suits = [k for k in having if (k % 3 == 0) == (r.verdict == "block")]
        assert (r.support, r.confidence) == (len(having), len(suits) / len(having))
        assert r.support >= url_filter.SUPPORT and r.confidence >= (url_filter.CONFIDENCE if r.verdict == "block" else url_filter.ALLOW_CONFIDENCE)
    for a in mined:
        assert not any(a.verdict == b.verdict and set(b.tokens) < set(a.tokens) and b.confidence >= a.confidence for b in mined)
    every = set().union(*tokens.values())
    alone = {t: [k for k in tokens if t in tokens[k]] for t in every}
    for t, having in alone.items():  # every token that by itself makes a rule is one
        bad = sum(k % 3 == 0 for k in having)
        if len(having) >= url_filter.SUPPORT and bad >= url_filter.CONFIDENCE * len(having) and (bad - len(having) / 3) / (len(having) * 2 / 9) ** 0.5 >= url_filter.DEVIATIONS:
            assert any(r.tokens == (t,) and r.verdict == "block" for r in mined)
    judged = url_filter.judge(pages, mined).select("page_id", "verdict", "matched").collect()
    for r in judged:  # by trying every rule
        fits = [m for m in mined if set(m.tokens) <= tokens[r["page_id"]]]
        best = max(fits, key=lambda m: (m.confidence, m.verdict == "block"), default=None)
        assert r["verdict"] == (best.verdict if best else "allow") and (r["matched"] is None) == (best is None)
        assert (r["verdict"] == "block") == (r["page_id"] % 3 == 0)
    noise = spark.createDataFrame([(k, rng.choice([0, 1, 1, 1]), 0) for k in range(600)], "doc_id long, quality int, toxic int")
    assert url_filter.mine(pages, noise) == []
    long = spark.createDataFrame([(None, "http://a.b/" + "x/" * 200_000), (1, "http://a.b/c"), (1, "http://a.b/c")], "page_id long, url string")
    assert [len(r["path"]) for r in url_filter.judge(long, mined).orderBy("page_id").collect()] == [400_001, 2, 2]
    assert url_filter.mine(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == []
    assert url_filter.judge(pages.limit(0), mined).count() == 0


# ---------------------------------------------------------------- 2


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(words(rng, 30)) for _ in range(40)]
    texts = []
    for k in range(120):
        own = []
        for _ in range(4):
            line = rng.choice(base).split()
            if rng.random() < 0.5:
                line[rng.randrange(30)] = "changed"
            own.append(" ".join(line) if rng.random() < 0.8 else " ".join(words(rng, 30)))
        texts.append("\n".join([*own, "short", "short"]))
    texts += AWKWARD
    got = {r["doc_id"]: r for r in dedup_lines(docs(spark, texts, True)).collect()}
    long = lambda line: line.strip() != ""
    distinct, first = [], {}
    for k, t in enumerate(texts):
        for i, line in enumerate((t or "").split("\n")):
            if long(line) and line not in first:
                first[line] = (k, i)
                distinct.append(line)
    parent = {x: x for x in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if jaccard(a, b) >= 0.8:
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y, key=first.get)] = min(x, y, key=first.get)
    want = {k: [i for i, line in enumerate((t or "").split("\n")) if long(line) and first[find(line)] != (k, i)] for k, t in enumerate(texts)}
    missed = sum(len(set(want[k]) - set(got[k]["dropped"])) for k in want)
    assert missed <= 0.02 * sum(map(len, want.values()))
    for k, t in enumerate(texts):
        assert set(got[k]["dropped"]) <= set(want[k])
        if t is None:
            assert got[k]["text"] is None and got[k]["n_lines"] == 0
        else:
            assert got[k]["text"] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in got[k]["dropped"])
    assert dedup_lines(docs(spark, []).limit(0)).count() == 0
    shared, union = overlaps(pa.array(["abcdefghij" * 3, ""]), pa.array(["abcdefghij" * 3, "abcdefghijk"]))
    assert shared[0] == union[0] and shared[1] == 0


def test_line_dedup_with_null_and_repeated_ids(spark):
    line = "the same line of some length stands here"
    df = spark.createDataFrame([(None, line), (None, line + "\nand another one that is long enough"), (3, line), (3, line)], "doc_id long, text string")
    got = dedup_lines(df).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == [(-1, ""), (-1, "and another one that is long enough"), (3, line), (3, line)]


@pytest.mark.parametrize("family", [20_000, 0])
def test_line_dedup_finds_twins_in_a_template_family(spark, monkeypatch, family):
    """Lines of one template (Jaccard 0.72), each with one twin (0.80): their buckets are crowded. Both ways of comparing them."""
    monkeypatch.setattr("vantage.llm.line_dedup.FAMILY", family)
    rng = random.Random(12)
    odd = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, tail, texts = odd(88), odd(88), []
    for _ in range(500):
        own = odd(24)
        texts += [head + own + tail, head + own[:10] + odd(14) + tail]
    assert jaccard(texts[0], texts[1]) >= 0.8 > 0.75 > jaccard(texts[0], texts[2])
    dropped = {r["doc_id"] for r in dedup_lines(docs(spark, texts)).collect() if r["dropped"]}
    assert not any(k % 2 == 0 for k in dropped)
    assert len(dropped) >= 0.98 * 500


def test_characters_and_shingles():
    text = "Ünïcode lines: añb " * 3 + "\ud55c\uad6d\uc5b4 " * 4
    data = np.frombuffer(text.encode(), np.uint8)
    points, before = characters(data)
    assert len(points) == before[-1] == len(text) and before[len("Ün".encode())] == 2
    assert jaccard("ééééééééx", "ééééééééx") == 1 and jaccard("abcdefgé", "abcdefgè") == 0
    a, b = "one line of text with é in it", "one line of text with è in it"
    grams = lambda t: {t[k : k + 8] for k in range(len(t) - 7)}
    assert jaccard(a, b) == len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    assert len(characters(np.frombuffer(b"\x80\xff\xc3", np.uint8))[0]) <= 3  # no UTF-8, no harm


def test_ids_met_before_are_not_sorted_again(monkeypatch):
    rng = np.random.default_rng(3)
    parts = [np.unique(rng.integers(0, 1 << 64, 40, np.uint64) >> np.uint64(57)) for _ in range(12)]
    for name in ("union1d", "isin", "sort"):
        monkeypatch.setattr(np, name, None)
    seen, met = np.zeros(0, np.uint64), set()
    for part in parts:
        new, seen = line_dedup._unmet(part, seen)
        assert set(part[new].tolist()) == set(part.tolist()) - met
        met |= set(part.tolist())
        assert seen.tolist() == sorted(met)


def test_line_dedup_with_string_ids_and_long_lines(spark):
    rng = random.Random(24)
    line = " ".join(words(rng, 40_000, 3000))
    df = spark.createDataFrame([("b", line + " more"), ("a", line), ("c", "other\n" + line)], "doc_id string, text string").withColumn("n_lines", F.lit(0)).withColumn("place", F.lit(1))
    got = {r["doc_id"]: r for r in dedup_lines(df).collect()}
    assert [got[k]["dropped"] for k in "abc"] == [[], [0], [1]] and got["c"]["place"] == 1


def test_line_dedup_of_short_lines(spark):
    texts = ["Les.\nof its own\n\n \t\nSee the Notes", "Les.\n\n \t\nx", "see the notes\nx\n\nOf, edti oner."]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "\n \t\nx", 2: "\nOf, edti oner."}


# ---------------------------------------------------------------- 3


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "é" * 200), (2, None, "é" * 200), (3, "u", None), (4, "u", ""), (5, "u", "tiny"), (6, "u", "tiny"), (None, "u", "é" * 200), (7, "u", "z" * 300_000), (1, "again", "é" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    index, folder = archive(pages)
    back = read_records(index, folder).collect()
    assert len(back) == len(rows)
    by = {r["page_id"]: r for r in back if r["page_id"] not in (1, None)}
    assert by[2]["record_type"] == "revisit" and by[2]["refers_to"] == 1 and by[2]["payload"] is None and by[2]["payload_bytes"] == 400
    assert by[6]["record_type"] == "response" and by[3]["payload_bytes"] == 0 and by[7]["payload"] == b"z" * 300_000
    for r in back:
        want = {p: (h or "").encode() for p, _, h in rows}[r["page_id"]]
        assert r["payload_digest"] == hashlib.sha256(want).hexdigest() and r["payload_bytes"] == len(want)
    assert [r["page_id"] for r in lookup(index, folder, [7]).collect()] == [7]
    # the bundle itself: frames stand alone, the footer lists them, offsets lead to records
    fs, root = opened(folder)
    import zstandard

    for r in index.collect():
        with fs.open_input_file(f"{root}/{r['bundle']}") as file:
            whole = file.read()
        sizes = read_seek_table(whole)
        assert struct.unpack_from("<I", whole, sum(p for p, _ in sizes))[0] == 0x184D2A5E
        assert sizes[r["frame"]][0] == r["frame_size"] and sum(p for p, _ in sizes[: r["frame"]]) == r["frame_at"]
        plain = zstandard.ZstdDecompressor().decompress(whole[r["frame_at"] : r["frame_at"] + r["frame_size"]])
        headers, _, end = parse(plain, r["at"])
        assert headers["WARC-Record-ID"] == f"<urn:page:{'' if r['page_id'] is None else r['page_id']}>" and end - r["at"] == r["size"]
        assert len(zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()) == sum(n for _, n in sizes)
    index, folder = archive(pages.limit(0))
    assert read_records(index, folder).count() == 0


def test_warc_with_string_ids_and_many_repeated_payloads(spark, monkeypatch):
    monkeypatch.setattr("vantage.llm.warc.small", lambda df: False)
    rows = [(f"p {k:02d}>", "u" * 50_000 if k == 3 else "u", "x" * 100 + "abc"[k % 3]) for k in range(30)] * 2
    index, folder = archive(spark.createDataFrame(rows, "page_id string, url string, html string"))
    back = read_records(index, folder).collect()
    assert len(back) == 60
    for r in back:
        first = f"p {int(r['page_id'][2:4]) % 3:02d}>"
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == first else ("revisit", first))
        assert len(r["url"]) == (50_000 if r["page_id"] == "p 03>" else 1)


# ---------------------------------------------------------------- 4


def brute_phrases(text, sample):
    """Phrases of a text parsed greedily into the longest stretches that a sample has; a letter that it lacks counts twice."""
    squeeze = lambda t: re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in t.lower()))
    x, s = squeeze(text).lstrip(), squeeze(sample)
    count, at = 0, 0
    while at < len(x):
        n = 1
        while at + n < len(x) and x[at : at + n + 1] in s:
            n += 1
        at, count = at + n, count + (1 if x[at] in s else 2)
    return count


def test_cross_parsing_by_brute_force():
    rng = random.Random(20)
    samples = {"x": "a banana and a bandana can", "y": "zz yy", "z": " ".join(words(rng, 300))}
    model = language.LanguageModel.of_samples(samples)
    long = " ".join(rng.choice([*samples["z"].split(), "banana", "xq", "Ünder"]) for _ in range(2000))
    texts = ["banana bandana can band 12 nab", "", " 12 a", "qq", "q a q", "zzz", long, long[:512], long[:513], long[7:2000]]
    for cells in (0, 1 << 30):
        parsers = model.parsers(cells)
        stream, bounds, letters = language.symbols(texts, model.alphabet)
        for lang, parser in zip(sorted(samples), parsers, strict=True):
            assert language.phrases(stream, bounds, parser).tolist() == [brute_phrases(t, samples[lang]) for t in texts]
        assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]


def test_languages_of_many_letters_and_ties(spark):
    rng = random.Random(21)
    scripts = {"p": [chr(0x4E00 + k) for k in range(3000)], "q": [chr(0xAC00 + k) for k in range(3000)]}
    make = lambda lang, n: "".join(rng.choice([*scripts[lang], " "]) for _ in range(n))
    rows = [(lang, make(lang, 4000)) for lang in scripts for _ in range(30)]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    tests = [(lang, make(lang, 20)) for lang in scripts for _ in range(100)]
    got = language.identify(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(tests)], "doc_id long, text string"), model).collect()
    assert all(r["lang_pred"] == tests[r["doc_id"]][0] for r in got)
    twins = language.LanguageModel.of_samples({"b": "some words", "a": "some words"})
    tied = language.identify(docs(spark, ["some words", "other"] * 2), twins).collect()
    assert {(r["lang_pred"], r["score"]) for r in tied} == {("a", 0.5)}


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars")
    got = queries.op4_language_id(spark, d).join(truth, "doc_id").where("held_out and n_chars >= 20")
    ok, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 100 and ok / n > 0.98
    model = language.fit(spark.read.parquet(f"{d}/documents.parquet").where("lang in ('en', 'de')"))
    odd = language.identify(docs(spark, AWKWARD, True), model).collect()
    for r in odd:
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letter) and 0 <= r["score"] <= 1
    assert language.identify(docs(spark, ["some text"]), language.LanguageModel({}, {})).first()["lang_pred"] == "und"
    assert language.fit(docs(spark, []).limit(0)).automata == {}


# ---------------------------------------------------------------- 5


def test_quality_held_out_accuracy_and_columns(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op5_quality(spark, d).join(truth, "doc_id").where("held_out")
    ok, n = got.agg(F.count_if(F.col("quality") == F.col("predicted")), F.count(F.lit(1))).first()
    assert n > 50 and ok / n > 0.93
    rng = np.random.default_rng(3)
    x = rng.random((800, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.4) & (x[:, 3] <= 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"stat_{s}" for s in quality.STATISTICS])
    scores = [r[0] for r in frame.select(model.score()).collect()]
    by_hand = []
    for row in x:
        total = model.intercept
        for tests, w in model.rules:
            if all((row[quality.STATISTICS.index(t.stat)] > t.bound) == t.above for t in tests):
                total += w
        by_hand.append(1 / (1 + np.exp(-total)))
    assert np.allclose(scores, by_hand) and ((np.array(scores) > 0.5) == y).mean() > 0.97 and "and" in str(model)
    assert quality.fit_rules(np.zeros((0, len(quality.STATISTICS))), np.zeros(0)).rules == ()
    odd = quality.scored(docs(spark, AWKWARD, True), model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in odd)


def test_statistics_by_hand():
    found = quality.statistics(pa.array(["Ab c1 *x*\nAb c1 *x*", None, "", "é\n"]))
    pick = lambda name: found[name].tolist()
    assert pick("n_words") == [6, 0, 0, 1] and pick("n_lines") == [2, 0, 0, 2] and pick("distinct_words") == [0.5, 0, 0, 1]
    assert pick("upper")[0] == 2 / 19 and pick("marked_words")[0] == 2 / 6 and pick("repeated_lines") == [0.5, 0, 0, 0] and pick("longest_word") == [3, 0, 0, 2]


# ---------------------------------------------------------------- 6


def test_leaks_by_planting(spark):
    rng = random.Random(6)
    items = [words(rng, n, 5000) for n in (40, 25, 13, 5, 30)]
    clean = [" ".join(words(rng, 300, 5000)) for _ in range(30)]
    planted = {}
    texts = list(clean)
    for k, item in enumerate(items):
        body = words(rng, 200, 5000)
        texts.append(" ".join(body[:100] + item + body[100:]))
        planted[len(texts) - 1] = k
    changed = list(items[0])
    for at in (4, 11, 17, 26, 33):
        changed[at] = "other"
    texts.append("Before. " + ", ".join(changed).upper() + " after")
    planted[len(texts) - 1] = 0
    texts.append(" ".join(items[4][5 : 5 + LEAST_WORDS]))
    planted[len(texts) - 1] = 4
    texts += AWKWARD
    bench = spark.createDataFrame([*((k, " ".join(i)) for k, i in enumerate(items)), (90, None), (91, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(docs(spark, texts, True), bench).collect()}
    assert set(got) == set(planted.items())
    full = got[len(clean), 0]
    assert (full["overlap"], full["agreeing"]) == (40, 40)
    assert got[len(clean) + 5, 0]["agreeing"] == 35
    kept = decontaminated(docs(spark, texts), bench)
    assert kept.count() == len(texts) - len(planted) and kept.columns == docs(spark, texts).columns[:5]
    assert leaks(docs(spark, texts), bench.limit(0)).count() == 0 and leaks(docs(spark, []).limit(0), bench).count() == 0


def test_leak_behind_a_weak_hit(spark):
    """Words 24 to 35 of the item agree in 7 places, 40 to 52 in all: only the later hit has an overlap around it."""
    rng = random.Random(14)
    item = [f"i{k}" for k in range(60)]
    for mask in MASKS:
        same = {24 + k for k, c in enumerate(mask) if c == "1"} | set(range(40, 53))
        text = " ".join(w if k in same else f"x{rng.randrange(10**9)}" for k, w in enumerate(item))
        got = leaks(docs(spark, [text]), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
        assert [(r["doc_id"], r["item_id"], r["overlap"], r["agreeing"]) for r in got] == [(0, 1, 13, 13)]


def test_longest_overlap_by_brute_force():
    rng = np.random.default_rng(16)
    for _ in range(400):
        same = rng.random(rng.integers(0, 40)) < rng.choice([0.3, 0.7, 0.9])
        n = len(same)
        spans = [(j - i, i) for i in range(n) for j in range(i + 1, n + 1) if same[i] and same[j - 1] and 5 * same[i:j].sum() >= 4 * (j - i)]
        at, length, agreeing = longest_overlap(same)
        assert length == max((s for s, _ in spans), default=0)
        assert not length or ((length, at) in spans and agreeing == same[at : at + length].sum())


def brute_leaks(texts, items):
    """Longest overlap of each text and item, by comparing every diagonal."""
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate({k: k + 32 for k in range(65, 91)}))
    out = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            x, y = cut(text), cut(item)
            best = 0
            for diagonal in range(-len(y), len(x)):
                same = [0 <= k + diagonal < len(x) and x[k + diagonal] == w for k, w in enumerate(y)]
                for a in range(len(y)):
                    for b in range(a + best, len(y)):
                        if same[a] and same[b] and 5 * sum(same[a : b + 1]) >= 4 * (b - a + 1):
                            best = b - a + 1
            if best and best >= min(LEAST_WORDS, len(y)):
                out[d, i] = best
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(17)
    items = [words(rng, n, 200) for n in (90, 30, 20, 14, 13, 9, 6)]
    texts = []
    for item in items * 4:
        a = rng.randrange(max(1, len(item) - 16))
        part = item[a : a + rng.randrange(9, 100)]
        changed = [rng.choice(["zz", w, w, w, w, w]) for w in part]
        texts.append(" ".join(words(rng, 30, 200) + changed + words(rng, 20, 200) + changed[: rng.randrange(20)]))
    texts.append(" ".join(["before", *items[0], "after"]))
    items = [" ".join(i) for i in items]
    got = {(r["doc_id"], r["item_id"]): r["overlap"] for r in leaks(docs(spark, texts).repartition(5), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == brute_leaks(texts, items) and max(got.values()) == 90


def test_masks_hit_every_overlap_that_is_allowed():
    hit = lambda same, mask: any(all(same[s + k] for k, c in enumerate(mask) if c == "1") for s in range(len(same) - len(mask) + 1))
    for n, changed in ((13, 2), (15, 3), (20, 4)):  # the lengths between have no more substitutions
        for places in itertools.combinations(range(n), changed):
            assert any(hit([k not in places for k in range(n)], m) for m in MASKS), places
    rng = random.Random(15)
    for _ in range(2000):
        places = rng.sample(range(25), 5)
        assert any(hit([k not in places for k in range(25)], m) for m in MASKS), places
    for n in range(1, LEAST_WORDS):
        assert all(len(m) == n for m in short_masks(n))
        for places in itertools.combinations(range(1, n - 1), n // 5):
            assert any(hit([k not in places for k in range(n)], m) for m in short_masks(n)), (n, places)


def test_leaks_of_short_items_with_substitutions(spark):
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (1, 2, 3, 5, 8, 10, 12, 13, 15)}
    texts = [" ".join("other" if 0 < k < n - 1 and k % 5 == 3 and n >= 5 else w for k, w in enumerate(item)) for n, item in items.items()]
    got = {(r["doc_id"], r["item_id"]) for r in leaks(docs(spark, texts), spark.createDataFrame([(n, " ".join(i)) for n, i in items.items()], "item_id long, text string")).collect()}
    assert got == set(enumerate(items))


# ---------------------------------------------------------------- 7


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        base = words(rng, rng.choice((4, 5, 9, 60, 200)), 3000)
        for _ in range(rng.choice((1, 3, 6))):
            own = list(base)
            for _ in range(rng.choice((0, 1, 2, 4))):
                own[rng.randrange(len(own))] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(own))
    passage = words(rng, 40, 3000)
    texts += [" ".join(words(rng, 60, 3000) + passage) for _ in range(30)]
    chain = words(rng, 120, 3000)
    for k in range(12):  # neighbours link, ends do not
        chain[8 * k] = f"c{k}"
        texts.append(" ".join(chain).upper())
    texts += AWKWARD
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs(spark, texts, True)).collect()}
    assert got == brute_components(texts)
    assert near_duplicates(docs(spark, []).limit(0)).count() == 0


def test_near_duplicates_store_the_sets_that_may_link_alone(spark, monkeypatch):
    rng = random.Random(11)
    texts = []
    for _ in range(30):  # a passage in two texts: leading tokens in common, and far from a link
        passage = words(rng, 12, 10**6)
        texts += [" ".join(words(rng, 88, 10**6) + passage) for _ in range(2)]
    copy = words(rng, 100, 10**6)
    texts += [" ".join(copy), " ".join([*copy[:-1], "other"])]
    kept = []

    def counted(df, name, own=ngram_join.stored):
        out = own(df, name)
        kept.append(out.count() if name == "sets" else 0)
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(texts)
    assert 2 <= sum(kept) <= 8


def test_near_duplicates_with_odd_ids(spark):
    t = [" ".join(words(random.Random(k), 50)) for k in range(3)]
    df = spark.createDataFrame([(5, t[0]), (5, t[1]), (2, t[0]), (9, t[1]), (None, t[2]), (None, t[2])], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in near_duplicates(df).collect())
    assert got == [(-1, None), (-1, None), (2, 2), (5, 2), (5, 2), (9, 2)]


def test_prefix_tree():
    rng = np.random.default_rng(7)
    base = np.sort(rng.choice(500, 80, replace=False)).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(50, 80), replace=False), rng.choice(500, 6).astype(np.uint64)])) for _ in range(60)] + [base, base[:1], base[:60]]
    sets += [np.arange(k, dtype=np.uint64) for k in range(1, 1500, 50)] + [np.arange(1400, dtype=np.uint64)]  # one long path
    got = {(k, p) for k, probes in PrefixTree(sets, (75, 100)).walk(sets) for p in probes.tolist()}
    want = {(k, p) for k, s in enumerate(sets) for p, probe in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 75 * len(np.union1d(s, probe))}
    assert got == want
    assert list(PrefixTree([], (75, 100)).walk([base])) == [] and list(PrefixTree(sets, (75, 100)).walk([])) == []
    deep = [np.arange(k, dtype=np.uint64) for k in range(1, 3000)]
    assert sum(len(p) for _, p in PrefixTree(deep, (75, 100)).walk(deep[-1:])) == 2999 - -(-3 * 2999 // 4) + 1


def test_sets_that_share_few_tokens_are_not_walked(monkeypatch):
    rng = np.random.default_rng(5)
    link, n = (75, 100), 300
    sets: list[np.ndarray] = []
    for k in range(n):
        size = int(rng.integers(4, 40))
        base = sets[int(rng.integers(k))][:size] if k % 3 == 2 else np.zeros(0, np.uint64)
        sets.append(np.unique(np.concatenate((base, rng.integers(0, 3000, 2 if len(base) else size).astype(np.uint64)))))
    sizes = np.array([len(x) for x in sets], np.int64)
    take = set_join.prefix_length(sizes, link)
    lead, at = [x[:k] for x, k in zip(sets, take, strict=True)], [np.arange(k, dtype=np.int32) for k in take]
    pairs = lambda found: {(int(k), int(j)) for k, js in found for j in js}
    tree = PrefixTree(sets, link).walk(sets), PrefixTree(lead, link, sizes, at).walk(lead, sizes, at)
    links, possible = map(pairs, tree)
    whole = {k: (x, k, len(x), None) for k, x in enumerate(sets)}
    assert links == {(a, b) for a in range(n) for b in range(n) if 100 * len(shared := np.intersect1d(sets[a], sets[b])) >= 75 * (sizes[a] + sizes[b] - len(shared))}
    monkeypatch.setattr(set_join, "PrefixTree", None)
    for held in (2_000, set_join.HELD):  # in slices too
        monkeypatch.setattr(set_join, "HELD", held)
        assert pairs(set_join._links(sets, sets, link)) == links
        assert pairs(set_join._possible(lead, lead, [sizes, sizes], [at, at], link)) == possible
    assert {tuple(sorted((a, b))) for a, _, b, _ in set_join._met_in(whole, whole, link)} <= links
    many = [np.arange(k, k + 100, dtype=np.uint64) for k in range(4)]
    assert set_join._common(many, many) is not None
    monkeypatch.setattr(set_join, "LISTED", 100)
    assert set_join._common(many, many) is None


# ---------------------------------------------------------------- 8


def test_bpe_equals_the_library(spark):
    import tiktoken

    path, pattern = queries.tokenizer()
    v = loaded(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(8)
    alphabet = "ab \n-é漢'l0😀ABCthe "
    texts = [t or "" for t in AWKWARD] + ["aaaaaaaaaaaa" * 60, " " * 700, "-=" * 400, "<|endoftext|>", "I'LL don't"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(400)]
    ids, bounds = encode_texts(texts, v)
    for k, t in enumerate(texts):
        own = ids[bounds[k] : bounds[k + 1]]
        assert own.tolist() == library.encode_ordinary(t)
        assert decode(own, v) == t.encode()
    got = {r["doc_id"]: r for r in encode_documents(docs(spark, [None, *texts[:40]], True), path, pattern).collect()}
    assert got[0]["n_tokens"] == 0 and got[0]["ids"] == [] and got[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    for k, t in enumerate(texts[:40]):
        want = library.encode_ordinary(t)
        assert got[k + 1]["ids"] == want and got[k + 1]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert got[k + 1]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert encode_documents(docs(spark, []).limit(0), path, pattern).count() == 0


def test_bpe_of_a_long_text():
    import tiktoken

    path, pattern = queries.tokenizer()
    vocabulary = loaded(path, pattern)
    library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    long = " ".join(words(random.Random(22), 400_000, 3000)) + "é\n" * 1000
    assert len(long) > 1_500_000 and encode_texts([long], vocabulary)[0].tolist() == library.encode_ordinary(long)


def test_bpe_replay_without_hashing_each_merge(monkeypatch):
    vocabulary = loaded(*queries.tokenizer())
    rng = random.Random(5)
    texts = [" ".join(words(rng, 300)) for _ in range(20)] + ["aaaaaaaa" * 9, ""]
    calls = []
    monkeypatch.setattr(np, "unique", lambda *a, own=np.unique, **b: calls.append(1) or own(*a, **b))
    ids, bounds = encode_texts(texts, vocabulary)
    assert [decode(ids[a:b], vocabulary).decode() for a, b in zip(bounds, bounds[1:], strict=False)] == texts
    assert not calls


def test_bpe_with_a_small_vocabulary():
    """Merges that open lower ranks on either side, against the plain rule of one merge at a time."""
    rng = random.Random(9)
    from vantage.llm.bpe import Vocabulary, encode_pieces

    for _ in range(30):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 300:
            tokens.add(bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 7))))
        multi = sorted(t for t in tokens if len(t) > 1)
        rng.shuffle(multi)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(multi)}
        v = Vocabulary(ranks, ".+")
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
        ids, bounds = encode_pieces(pieces, v)
        for k, piece in enumerate(pieces):
            parts = [bytes([b]) for b in piece]
            while True:
                found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
                if not found:
                    break
                _, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert ids[bounds[k] : bounds[k + 1]].tolist() == [ranks[p] for p in parts]


# ---------------------------------------------------------------- 9


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(9)
    parts = [rng.choice(np.concatenate([rng.integers(0, 1 << 63, 500), np.arange(20) << 40]), 800).astype(np.uint64) for _ in range(4)]
    merged = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(CountingQuotientFilter.of(p).to_bytes()) for p in parts])
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    got = merged.items()
    assert got[0].tolist() == values.tolist() and got[1].tolist() == counts.tolist()
    assert CountingQuotientFilter.merged([]).items()[0].tolist() == []


def test_exact_duplicates(spark, monkeypatch):
    texts = [*AWKWARD, "same text here", "", None]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "same text here"), (3, "a"), (None, "only null"), (None, "only null")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit(1), "fp": F.lit(2)})
    plain = {}
    for k, t in rows:
        plain.setdefault(t or "", []).append(k)
    want = sorted(((-1 if k is None else k), max((x for x in plain[t or ""] if x is not None), default=-1), len(plain[t or ""]), k == max((x for x in plain[t or ""] if x is not None), default=None), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)
    for most in (500_000, 0):  # broadcast, and salted shuffle
        monkeypatch.setattr("vantage.llm.exact_dedup.small", lambda df, most=most: df.count() <= most)
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["keep_id"] is None else r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_duplicates(df).collect())
        assert got == want
    assert exact_duplicates(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 10


def test_linking_of_thousands_of_parts(spark):
    """Weak parts by comparing all pairs, in a text with thousands; repeated rows are each judged."""
    rng = random.Random(23)
    make = {"key_id": lambda: "ASIA" + "A" * 16, "key": lambda: "k" * 40, "endpoint": lambda: "https://h/x", "assign": lambda: "secret=abcdefgh"}
    text = "".join(rng.choice([make[rng.choice(list(make))]() + " ", "w " * rng.randrange(400)]) for _ in range(6000))
    got = find_secrets(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    found = {k: [m.span() for m in re.finditer(p, text)] for k, p in (("key_id", "ASIA" + "A" * 16), ("key", "(?<![a-z])k{40}"), ("endpoint", "https://h/x"), ("assign", "secret=abcdefgh"))}
    near = lambda xs, ys: {x for x in xs if any(y[0] <= x[1] + 300 and y[1] >= x[0] - 300 for y in ys)}
    keys = found["assign"] + found["key"]
    want = near(found["key_id"], keys) | near(found["key"], found["key_id"]) | (near(found["endpoint"], found["key_id"]) & near(found["endpoint"], keys))
    assert len(want) > 500 and sum(map(len, found.values())) > 2500
    for r in got:
        assert {(x["start"], x["stop"]) for x in r["weak_spans"]} == want


def test_secrets(spark):
    key = "AKIA" + "A1" * 8
    secret = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEYx"[:40]
    texts = [
        f'api_key = "abcdef123" {key} PASSWD: short pass token=token : abcdefg',
        f"id {key}\nkey {secret}\nsee https://s3.example.com/x",
        f"key {secret} alone, https://example.com and ASIA{'B2' * 8} apart" + " word" * 200 + f" {secret}",
        "0123456789abcdef01234567 0123456789abcdef0123456 é" + "f" * 30,
        "Token:" + "x" * 5 + " SECRET='a.b-c=d/e'",
        *AWKWARD,
    ]
    got = {r["doc_id"]: r for r in find_secrets(docs(spark, texts, True)).withColumns({"base": listed(F.col("base_spans")), "weak": listed(F.col("weak_spans"))}).collect()}
    patterns = {"assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)}
    for k, t in enumerate(texts):
        found = sorted((m.start(), n, m.end(), kind) for n, (kind, (p, ok)) in enumerate(patterns.items()) for m in re.finditer(p, t or "", re.A) if ok(m))
        assert got[k]["base"] == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
    at = texts[1].index(secret)
    assert got[1]["weak"].split(",")[0] == f"key:{at}:{at + 40}" and "endpoint:" in got[1]["weak"]
    weak = got[2]["weak"]
    assert weak.count("key:") == 1 and "key_id:" in weak and "endpoint:" in weak  # the second key is out of reach
    assert got[0]["weak"] == "" and got[3]["weak"] == ""
    assert find_secrets(docs(spark, []).limit(0)).count() == 0


# ---------------------------------------------------------------- queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    cursor = con.execute(queries.SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted(map(repr, (tuple(r) for r in cursor.fetchall())))
    assert sorted(map(repr, (tuple(r) for r in queries.QUERIES[name](spark, DATA).select(*names).collect()))) == want


def test_op7_and_op8_over_a_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = brute_components([r["text"] for r in table])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_ngram_join(spark, DATA).collect()}
    assert got == {r["doc_id"]: (want[k][0], table[want[k][1]]["doc_id"]) for k, r in enumerate(table)}
    path, pattern = queries.tokenizer()
    with open(path, "rb") as lines:
        assert len({base64.b64decode(x.split()[0]) for x in lines}) == len(loaded(path, pattern).ranks)
    tokens = {r["doc_id"]: r["decoded_sha256"] for r in queries.op8_bpe(spark, DATA).collect()}
    assert tokens == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in table}


def test_pipeline_by_stage(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "bpe"]
    before = spark.read.parquet(f"{DATA}/documents.parquet")
    whole = p.run(spark, DATA)
    rows = {r["doc_id"]: r for r in whole.collect()}
    assert 0 < len(rows) <= before.count() and all(r["n_tokens"] == len(r["ids"]) for r in rows.values())
    kept = p.language_id(spark, before, DATA)
    assert kept.columns == list(p.COLUMNS)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    path, pattern = queries.tokenizer()
    v = loaded(path, pattern)
    final = [decode(np.array(r["ids"]), v).decode() for r in rows.values()]
    left = spark.createDataFrame([(k, t) for k, t in enumerate(final)], "doc_id long, text string")
    assert leaks(left, bench).count() == 0
    assert len(final) - len([1 for t in final if t == ""]) <= len(set(final))


def test_pipeline_stages_with_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, an empty table, columns with the operators' own names."""
    import corpus_pipeline as p

    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    rng = random.Random(25)
    long = " ".join(words(rng, 60_000, 3000))
    rows = [(1, long, None, None, None), (2, None, "en", "s", 0), (3, "", "en", None, 0), (None, "a text without an id", None, "s", 20), (None, None, None, None, None), (4, "before " + item + " after", "en", "s", 9), (None, item + " " + " ".join(words(rng, 200, 3000)), "en", "s", 9), (5, "twice the same row", "en", "s", 18), (5, "twice the same row", "en", "s", 18), (6, "12 34", "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    own = ["dropped", "n_lines", "place", "version", "lang_pred", "score", "rate", "component", "sid", "item_id"]
    odd = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in own})
    ids = lambda df: sorted((r["doc_id"] or 0) for r in df.select("doc_id").collect())
    want = {"language_id": [0, 0, 1, 4, 5, 5], "line_dedup": [0, 0, 0, 1, 2, 3, 4, 5, 5, 6], "ngram_join": [0, 0, 0, 1, 2, 3, 4, 5, 5, 6], "decontamination": [0, 0, 1, 2, 3, 5, 5, 6], "bpe": [0, 0, 0, 1, 2, 3, 4, 5, 5, 6]}
    for name, stage in p.STAGES:
        got = stage(spark, odd, DATA)
        assert ids(got) == want[name], name
        assert name == "bpe" or got.columns == list(p.COLUMNS)
        nothing = stage(spark, odd.limit(0), DATA)
        assert nothing.columns == got.columns and nothing.count() == 0
    texts = {r["doc_id"]: r["text"] for r in p.line_dedup(spark, odd, DATA).where("doc_id is not null").collect()}
    assert texts[1] == long and texts[2] is None and texts[3] == "" and texts[5] == "twice the same row"


def test_pipeline_keeps_documents_with_short_lines_left(spark):
    import corpus_pipeline as p

    shared = "a boilerplate line that stands in several documents"
    texts = [shared, shared + "\nown | row", shared + "\n \n\t", "clean"]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in p.line_dedup(spark, docs(spark, texts), DATA).collect()}
    assert got == {0: (shared, len(shared)), 1: ("own | row", 9), 3: ("clean", 5)}


def test_ported_entry_survives_without_llm():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys; sys.modules['vantage.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op')), len(e.queries()) > 40)"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert "op1_" not in out.stdout and "True" in out.stdout, out.stderr
