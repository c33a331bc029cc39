"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import hashlib
import itertools
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vtable.llm import decontaminate, exact, jaccard, langid, licenses, mixing, quality, tokens, urlfilter, warc
from vtable.llm.queries import DOMAINS, PATTERNS, QUERIES

from .test_brute import shingles

LONG = " ".join(f"word{i % 5000} goes on" for i in range(60_000))
PROSE = "the quick brown fox jumps over the lazy dog and then it runs away from the farm to the river bank at noon"
ITEM = "a benchmark question asks for the number of apples that remain in the basket after lunch"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate int, copy int, k1 int, block int, ws int, sha int, h int, item_id int, q int, comp int"
DOCS = [
    (1, PROSE, "en", "a"), (2, PROSE, None, "a"), (3, PROSE + " indeed", "en", None), (4, None, "en", "b"), (5, "", "en", "b"), (6, " \t\n", None, None),
    (7, LONG, "xx", "b"), (8, LONG + " end", "xx", "b"), (9, "x", "en", "zz"), (10, ITEM + " " + LONG, "en", "a"), (None, PROSE, "en", "a"), (None, None, None, None),
    (11, "Released under the MIT License.", "en", "a"), (11, "Released under the MIT License.", "en", "a"), (12, "ünïcödé ☃ 文字 \U0001f600", "en", "a"), (13, "12 34 !!", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for d in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "", 0), (None, ITEM, 0), (4, "too short", 0)], "item_id long, text string, doc_id int")


def test_jaccard(docs, none):
    out, links = jaccard.jaccard_components(docs, pairs=True)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)
    assert len(got) == len(DOCS)
    comp = {d: c for d, _, c in got}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[7] == comp[8] == comp[10] == 7
    assert all(comp[d] == d for d in (4, 5, 6, 9, 11, 12, 13)) and comp[None] is None
    assert {n for d, n, _ in got if d in (4, 5, 6)} == {0} and {n for d, n, _ in got if d in (9, 11, 12)} == {1}
    assert jaccard.jaccard_components(none)[0].count() == 0


def test_jaccard_copy_without_id_first(spark):
    """A row without doc_id takes no signatures from its copy, whose near copy is in another task."""
    rows = [(None, PROSE), (2, PROSE), (1, PROSE + " indeed")]
    parts = spark.createDataFrame(rows[:2], "doc_id long, text string").coalesce(1).union(spark.createDataFrame(rows[2:], "doc_id long, text string").coalesce(1))
    out, links = jaccard.jaccard_components(parts, pairs=True)
    assert {r.doc_id: r.component_id for r in out.collect()} == {None: None, 1: 1, 2: 1}
    assert [tuple(r) for r in links.collect()] == [(1, 2)]


def test_exact(docs, none):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(docs).collect()}
    assert got[1] == (2, 3, False) and got[2] == (2, 3, True)
    assert got[4] == (5, 3, False) and got[5] == (5, 3, True) and got[11] == (11, 2, True) and got[7] == (7, 1, True)
    assert exact.exact_dedup(none).count() == 0


def test_exact_query_keeps_every_row(spark, tmp_path):
    """Rows without a doc_id stay, and a doc_id of two texts has each text's own hash."""
    rows = [(None, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "b"), (4, "d"), (4, "d"), (None, "e"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.text_sha256, r.group_size) for r in QUERIES["op4_exact_dedup"](spark, str(tmp_path)).collect()]
    size = {"a": 2, "b": 2, "d": 2}
    assert sorted(got, key=str) == sorted(((d, hashlib.sha256((t or "").encode()).hexdigest(), size.get(t, 1)) for d, t in rows), key=str)


def test_leaks(docs, none, items):
    assert [(r.doc_id, r.item_id, r.words) for r in decontaminate.leaks(docs, items).collect()] == [(10, 1, len(ITEM.split()))]
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(DOCS) - 1
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_leaks_of_short_items(spark):
    """Items of 1 to 11 words with as many words changed as a leak may have, in any place, and with one too many."""
    docs, items, want = [], [], set()
    for n in range(1, 12):
        item = [f"i{n}w{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        may = n - -(-n * decontaminate.PERCENT // 100)
        for k in range(may + 2):
            for gone in itertools.combinations(range(n), k):
                docs.append((len(docs), " ".join(["before", *("other" if j in gone else w for j, w in enumerate(item)), "after"])))
                if k <= may:
                    want.add((len(docs) - 1, n, n - k))
    docs.append((len(docs), "i8w1 i8w2 i8w3 i8w4 i8w5 i8w6 i8w7"))
    want.add((len(docs) - 1, 8, 7))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want


def leak_words(doc, item):
    """The most equal words of an alignment that is a leak, by trying all; None if none is."""
    best, n = None, len(item)
    w = min(n, decontaminate.WINDOW)
    for off in range(-n + 1, len(doc)):
        eq = [0 <= off + q < len(doc) and doc[off + q] == item[q] for q in range(n)]
        if n and any(100 * sum(eq[s : s + w]) >= decontaminate.PERCENT * w for s in range(n - w + 1)):
            best = max(best or 0, sum(eq))
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_against_all_alignments(spark, seed):
    """Items of 1 to 40 words, documents that hold parts of them with words changed, of few distinct words so that alignments abound."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60 if seed == 1 else 6)]
    items = [[r.choice(vocabulary) for _ in range(n)] for n in range(1, 41)]
    docs = []
    for _ in range(150):
        item = list(r.choice(items))
        lo = r.randrange(max(1, len(item) - 11))
        part = item[lo:][: r.choice([len(item), 12, 14])]
        for _ in range(r.choice([0, 1, 2, 3])):
            part[r.randrange(len(part))] = r.choice(["other", *vocabulary])
        docs.append([r.choice(vocabulary) for _ in range(r.randrange(4))] + part + [r.choice(vocabulary) for _ in range(r.randrange(4))])
    want = {(d, i, leak_words(x, y)) for d, x in enumerate(docs) for i, y in enumerate(items)}
    got = decontaminate.leaks(
        spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    )
    assert {tuple(x) for x in got.collect()} == {x for x in want if x[2] is not None}


def test_leaks_in_repetitive_texts(spark):
    began = time.monotonic()
    docs = spark.createDataFrame([(1, "same " * 200_000), (2, "Same same " * 4)], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(1, "same " * 20)], "item_id long, text string"))
    assert [tuple(x) for x in got.collect()] == [(1, 1, 20)]
    assert time.monotonic() - began < 60


#: Rows without an id first, amid and last, one id of several texts, and rows repeated whole.
DIRTY = (
    [(None, PROSE)] * 3 + [(1, "alpha"), (1, "beta"), (2, "alpha"), (3, PROSE + " indeed"), (4, PROSE), (4, PROSE), (4, ITEM + " yes"), (None, ITEM + " no"), (4, "gamma"), (3, "beta")]
    + [(None, f"row {i} of many that have no number") for i in range(400)] + [(5, None), (None, None), (5, ""), (6, "alpha"), (7, PROSE.replace("fox", "cat"))]
)


@pytest.fixture(params=[1, 7], ids=["whole", "parted"])
def dirty(spark, request):
    return spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in DIRTY], "doc_id long, text string, lang string, source string, n_chars long").repartition(request.param)


def test_dirty_ids_exact(dirty):
    texts = Counter((t or "") for _, t in DIRTY)
    keep = {}
    for d, t in DIRTY:
        keep[t or ""] = max((x for x in (keep.get(t or ""), d) if x is not None), default=None)
    want = Counter((d, d if texts[t or ""] == 1 else keep[t or ""], texts[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in DIRTY)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.sha) for r in exact.exact_dedup(dirty, digest="sha").collect()) == want
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in exact.exact_dedup(dirty).collect()) == Counter(x[:3] for x in want.elements())
    left = exact.deduplicated(dirty)
    assert left.columns == dirty.columns
    got = [(r.doc_id, r.text or "") for r in left.collect()]
    assert sorted(got, key=str) == sorted(((keep[t], t) for t in texts), key=str)


def plain_components(rows, k, num):
    """Components of rows with an id, by all pairs."""
    sets = [shingles(t, k) if d is not None else frozenset() for d, t in rows]
    linked = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])] for i in range(len(rows))]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in linked[i]:
            a, b = comp[i], comp[j]
            comp = [a if c == b else c for c in comp]
    return linked, comp


def test_dirty_ids_jaccard(dirty):
    linked, comp = plain_components(DIRTY, 5, 80)
    least = {c: min(((d, t) for (d, t), x in zip(DIRTY, comp, strict=True) if x == c and d is not None), key=lambda x: x[0], default=(None, None))[0] for c in set(comp)}
    want = Counter((d, len(shingles(t, 5)), None if d is None else least[c], len(x)) for (d, t), x, c in zip(DIRTY, linked, comp, strict=True))
    assert Counter(tuple(r) for r in jaccard.jaccard_components(dirty)[0].select("doc_id", "n_shingles", "component_id", "n_links").collect()) == want
    out = jaccard.near_deduplicated(dirty)
    assert out.columns == dirty.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    # of each component one text stays, with the least id; all rows without an id or without words stay
    rows = Counter(DIRTY)
    assert all(got[x] == n for x, n in rows.items() if x[0] is None or not shingles(x[1], 5))
    for c in set(comp):
        own = {x for x, y in zip(DIRTY, comp, strict=True) if y == c and x[0] is not None and shingles(x[1], 5)}
        if own:
            (one,) = {x for x in own if got[x]}
            assert one[0] == least[c] and got[one] == rows[one]


def test_dirty_ids_leaks(dirty, items):
    got = Counter((r.doc_id, r.text) for r in decontaminate.decontaminate(dirty, items).collect())
    assert got == Counter((d, t) for d, t in DIRTY if ITEM not in (t or ""))


def test_dirty_ids_mixing(dirty):
    """Rows without an id are drawn one by one: about as many as the rate says come."""
    out = mixing.mix_sources(dirty, {"a": 1.0}, total=3 * len(DIRTY)).collect()
    free = [r for r in out if r.doc_id is None and (r.text or "").startswith("row ")]
    assert 1050 < len(free) < 1350 and len({r.shuffle_key for r in free}) == len(free)
    assert len({(r.text, r.copy) for r in free}) == len(free)
    a, b = ({(str(r.doc_id), r.text, r.copy, r.shuffle_key) for r in mixing.mix_sources(x, {"a": 1.0}, total=900).collect()} for x in (dirty, dirty.repartition(3)))
    assert a == b


def test_dirty_ids_row_by_row(dirty):
    """Operators that judge each row by its text return a row for each, the same for equal texts."""
    model = langid.learn(dirty)
    pieces = {"▁": -1.0, "a": -2.0, "o": -2.0}
    for out in (langid.identify(dirty, model, keep=("doc_id", "text")), quality.quality_scores(dirty.withColumn("n", F.xxhash64("text")), doc_id="n"), tokens.token_counts(dirty.withColumn("n", F.xxhash64("text")), pieces, doc_id="n")):
        rows = [tuple(r) for r in out.collect()]
        assert len(rows) == len(DIRTY)
        if "text" in out.columns:
            assert Counter((r[0], r[1]) for r in rows) == Counter(DIRTY)
        else:
            assert len(set(rows)) <= len({t for _, t in DIRTY})
    notice = licenses.NOTICES[9][1]
    got = licenses.license_scan(dirty.withColumn("text", F.concat_ws(" ", "text", F.lit(notice)))).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in DIRTY)


def test_dirty_ids_stages(dirty, spark, sf_dir, tmp_path):
    """No stage takes a text away that it has not found wanting."""
    stages = dict(corpus_pipeline.STAGES)
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {t or "" for _, t in DIRTY}
    assert {r.text or "" for r in stages["exact_dedup"](spark, dirty, sf_dir).collect()} == texts
    named = {(d, t) for d, t in DIRTY if ITEM not in (t or "")}
    assert {(r.doc_id, r.text) for r in stages["decontamination"](spark, dirty, str(tmp_path)).collect()} == named
    kept = Counter((r.doc_id, r.text) for r in stages["language_id"](spark, dirty, sf_dir).collect())
    assert all(kept[x] in (0, n) for x, n in Counter(DIRTY).items()) and not any(kept[x] for x in DIRTY if not x[1])
    near = {r.text for r in stages["ngram_jaccard"](spark, dirty, sf_dir).collect()}
    assert {"alpha", "beta", "gamma"} <= near


def test_mixing(docs, none):
    out = mixing.mix_sources(docs, {"a": 0.5, "b": 0.4, "": 0.1, "absent": 1.0}, total=2000)
    assert {"rate_", "copy_", "shuffle_key"} <= set(out.columns) and set(docs.columns) <= set(out.columns)
    got = out.collect()
    assert 1800 < len(got) < 2200 and {r.source for r in got} == {"a", "b", None}
    by = {s: sum(r.source == s for r in got) / len(got) for s in ("a", "b", None)}
    assert abs(by["a"] - 0.5) < 0.05 and abs(by["b"] - 0.4) < 0.05
    assert mixing.mix_sources(none, {"a": 1.0}).count() == 0 and mixing.mix_sources(docs, {}).count() == 0


def test_mixing_of_sources_without_a_weight(spark, tmp_path):
    rows = [(i, "t", ("src0", "other", None)[i % 3]) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_mixing"](spark, str(tmp_path)).collect()
    staged = dict(corpus_pipeline.STAGES)["mixing"](spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), str(tmp_path)).collect()
    for out in (got, staged):
        assert all(abs(sum(r.source == s for r in out) - 1000) < 150 and {r.rate for r in out if r.source == s} == {1.0} for s in ("src0", "other", None))


def test_language(docs, none):
    got = {(r.doc_id, r.held_out): (r.lang_pred, r.score) for r in langid.language_id(docs).collect()}
    preds = {d: p for (d, _), p in got.items()}
    assert preds[1][0] == "en" and preds[4] == preds[5] == preds[6] == preds[13] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values()) and langid.language_id(docs).count() == len(DOCS)
    assert langid.language_id(none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(none)).collect()} == {"und"}


def test_licenses(docs, none):
    assert [(r.doc_id, r.license, r.containment) for r in licenses.license_scan(docs).collect()] == [(11, "MIT", 1.0)] * 2
    assert licenses.license_scan(none).count() == 0


def test_quality(docs, none):
    got = quality.quality_scores(docs).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got) and {r.kept for r in quality.quality_scores(docs, least=0.0).collect()} == {True}
    assert quality.quality_scores(none).count() == 0


def test_tokens(docs, none):
    pieces = {"▁": -1.0, "▁the": -2.0, "x": -3.0, "t": -4.0, "h": -4.0, "e": -4.0}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokens.token_counts(docs, pieces).collect()}
    assert got[9] == (1, 2) and got[4] == got[5] == got[6] == (0, 0) and got[12] == (4, 4 + sum(2 if ord(c) > 127 else 1 for c in "ünïcödé") + 3 + 6 + 4)
    assert tokens.token_counts(none, pieces).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Net/x", "http://net", "http://net/", "http://x.example.net/en/1?q", "http://example.com/de/", "http://y.org/fr/a#b", "http://cheap-pills.example.org/en/", "http://1.2.3.4/", "a://b://c/d?x#y"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, "http://z/", None, None)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.url_verdicts(pages, DOMAINS, PATTERNS).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.net", "/x", "net/", "block") and got[5] == ("net", "", None, "allow") and got[6] == ("net", "/", "net/", "block")
    assert got[7] == ("x.example.net", "/en/1", "example.net/en/", "allow") and got[8][2:] == ("example.com/de/", "block") and got[9][2:] == ("org/fr/", "allow")
    assert got[10][2:] == (None, "block") and got[11][2:] == (None, "block") and got[12][:2] == ("b:", "//c/d") and got[None] == ("z", "/", None, "allow")
    assert urlfilter.url_verdicts(pages.limit(0), DOMAINS, PATTERNS).count() == 0 and urlfilter.url_verdicts(pages, [], []).count() == len(urls) + 1


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 3, LONG, LONG, "<p>a</p>"]
    pages = spark.createDataFrame([(5 - i if i else 7, f"http://h/{i}\r\nX: y", h, 0) for i, h in enumerate(html)] + [(None, None, "z", 0), (None, None, "z", 0)], "page_id long, url string, html string, payload int")
    manifest = warc.write_warc(pages, f"{tmp_path}/w").persist()
    got = warc.read_warc(manifest, f"{tmp_path}/w").collect()
    manifest.unpersist()
    assert len(got) == len(html) + 2 and manifest.agg({"records": "sum"}).first()[0] == len(got)
    by = {r.page_id: r for r in got}
    assert by[7].record_type == "revisit" and by[7].refers_to == -2 and by[7].payload_bytes == 8 and by[7].payload is None
    assert by[-2].record_type == "response" and by[-2].payload == b"<p>a</p>" and by[3].payload_bytes == 0 and by[3].refers_to == 2
    assert by[1].payload.decode() == "ééé" or by[1].payload_bytes == 6
    assert by[-1].record_type == "response" and by[0].refers_to == -1 and by[0].payload_digest == by[-1].payload_digest
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    few = warc.archive(spark, pages, min_bytes=7)
    assert {r.page_id for r in few.where("record_type = 'revisit'").collect()} == {7, 4, 0}
    assert warc.read_warc(warc.write_warc(pages.limit(0), f"{tmp_path}/e"), f"{tmp_path}/e").count() == 0


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, none, sf_dir, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    got = f(spark, docs, sf_dir)
    if stage != "mixing":
        assert got.columns == docs.columns and 0 < got.count() <= len(DOCS)
    else:
        got.collect()
    assert f(spark, none, sf_dir).count() == 0


def test_sha_is_of_whole_texts():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
