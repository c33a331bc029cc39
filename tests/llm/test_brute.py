"""Operators against plain versions of themselves."""

import io
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from vtable.llm import common, jaccard, langid, licenses, mixing, quality, tokens, urlfilter, warc
from vtable.llm import queries as Q
from vtable.llm.common import read

MODEL = f"{Q.TOKENIZERS}/{Q.MODEL}"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(Q.UPPER, Q.LOWER)))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute_components(docs, k, num, den):
    """By all pairs that share a shingle."""
    sets, holders, up = {d: shingles(t, k) for d, t in docs}, {}, {d: d for d, _ in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        shared = Counter(o for x in s for o in holders.get(x, ()))
        for o, n in shared.items():
            if den * n >= num * (len(s) + len(sets[o]) - n):
                a, b = sorted((top(d), top(o)))
                up[b] = a
        for x in s:
            holders.setdefault(x, []).append(d)
    return {d: (len(sets[d]), top(d)) for d in sets}


def variants(r, n):
    """Texts of few words in which copies, near copies and chains of them abound."""
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(r.choice([3, 5, 9, 14, 30, 60, 120]))] for _ in range(6)]
    out = []
    for _ in range(n):
        t = list(r.choice(base if r.random() < 0.6 or not out else [x.split() for x in out[-5:]]))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            if t:
                t[r.randrange(len(t))] = r.choice(words)
        out.append(" ".join(t + [r.choice(words)] * r.choice([0, 0, 1])))
    return out


@pytest.mark.parametrize(("seed", "k", "num", "small"), [(1, 4, 85, False), (2, 5, 80, True), (3, 1, 60, True)])
def test_jaccard(spark, monkeypatch, seed, k, num, small):
    if small:  # many blocks, small groups, frequent signatures
        monkeypatch.setattr(jaccard, "BLOCK", 4)
        monkeypatch.setattr(jaccard, "GROUP", 2)
        monkeypatch.setattr(jaccard, "OFTEN", 3)
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = list(enumerate(variants(random.Random(seed), 120)))
    out, links = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), k, num, 100, pairs=True)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_components(docs, k, num, 100)
    texts = dict(docs)
    for r in links.collect():
        a, b = shingles(texts[r.a], k), shingles(texts[r.b], k)
        assert 100 * len(a & b) >= num * len(a | b)


@pytest.mark.parametrize(("seed", "k", "num", "small"), [(4, 2, 60, False), (5, 2, 60, True)])
def test_jaccard_links(spark, monkeypatch, seed, k, num, small):
    """Every pair of similar different texts is a link, once, also in groups of many blocks."""
    if small:
        monkeypatch.setattr(jaccard, "BLOCK", 4)
        monkeypatch.setattr(jaccard, "GROUP", 2)
        monkeypatch.setattr(jaccard, "OFTEN", 3)
    docs = list(enumerate(variants(random.Random(seed), 120)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out, links = jaccard.jaccard_components(frame, k, num, 100, pairs=True)
    own = {d: shingles(x, k) for d, x in docs}
    count = {a: sum(a != b and 100 * len(own[a] & own[b]) >= num * len(own[a] | own[b]) and bool(own[a]) for b in own) for a in own}
    assert {r.doc_id: r.n_links for r in out.collect()} == count
    plain, none = jaccard.jaccard_components(frame, k, num, 100)
    assert none is None and {r.doc_id: r.n_links for r in plain.collect()} == count
    sets = {}
    for d, x in docs:
        sets.setdefault(shingles(x, k), d)
    pairs = [(a, b) for a in sets for b in sets if sets[a] < sets[b] and 100 * len(a & b) >= num * len(a | b)]
    assert len(pairs) > len(sets)
    assert sorted((r.a, r.b) for r in links.collect()) == sorted((sets[a], sets[b]) for a, b in pairs)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 80), st.sampled_from([(85, 100), (80, 100), (1, 2), (9, 10)]))
def test_similar_sets_share_a_signature(seed, n, ratio):
    r, t = np.random.default_rng(seed), jaccard.Threshold(*ratio)
    a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    b = np.unique(np.concatenate([a[r.random(len(a)) > r.choice([0.05, 0.15, 0.3])], r.integers(0, 2**64, r.integers(0, max(2, n // 4)), dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    if len(a) != both and len(b) and t.den * both >= t.num * (len(a) + len(b) - both) or (both < len(b) and t.den * both >= t.num * (len(a) + len(b) - both)):
        sums, sets = jaccard.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), t)
        assert set(sums[sets == 0]) & set(sums[sets == 1])


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 200 + i) for i in range(30)]
    up = {x: x for e in edges for x in e}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = common.components(common.Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.comp for x in got} == {x: top(x) for a, b in edges if a != b for x in (a, b)}


@lru_cache(None)
def pieces():
    return tokens.load_pieces(MODEL)


def brute_tokens(word, vocabulary):
    w, worst, most = "▁" + word, min(vocabulary.values()), max(map(len, vocabulary))
    best = [(0.0, 0)]
    for e in range(1, len(w) + 1):
        ways = [(best[b][0] + vocabulary[w[b:e]], best[b][1] - 1) for b in range(max(0, e - most), e) if w[b:e] in vocabulary]
        if w[e - 1] not in vocabulary:
            ways.append((best[e - 1][0] + worst - tokens.PENALTY, best[e - 1][1] - len(w[e - 1].encode())))
        best.append(max(ways))
    return -best[-1][1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters=" \t\n\r\x0b\x0c"), min_size=1, max_size=30), min_size=1, max_size=20, unique=True))
def test_token_counts(words):
    v = tokens.Vocabulary.of(pieces())
    assert tokens.count_words([w.encode() for w in words], v).tolist() == [brute_tokens(w, pieces()) for w in words]


def test_token_counts_of_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokens.token_counts(docs, pieces()).collect()}
    count = lru_cache(None)(lambda w: brute_tokens(w, pieces()))
    for r in docs.where("doc_id % 10 = 0").collect():
        words = [w.decode() for w in r.text.encode().split()]
        assert got[r.doc_id] == (len(words), sum(map(count, words)))


def test_token_counts_agree_with_the_library(spark, sf_dir):
    """The library's own segmentation by these scores, as a unigram model, differs only where scores tie."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    own = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    words = sorted({w for r in read(spark, sf_dir, "documents").where("doc_id < 60").collect() for w in r.text.split() if w.isalpha()})
    ours = tokens.count_words([w.encode() for w in words], tokens.Vocabulary.of(pieces()))
    theirs = [len(own.encode(w)) for w in words]
    assert np.mean(ours == np.array(theirs)) > 0.97


def test_licenses(spark):
    r, n = random.Random(3), [f"filler{i}" for i in range(50)]
    docs = []
    for i in range(200):
        name, text = r.choice(licenses.NOTICES)
        w = text.split()
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            w[r.randrange(len(w))] = r.choice(n)
        docs.append((i, " ".join([r.choice(n) for _ in range(r.randrange(60))] + (w if r.random() < 0.8 else []) + [r.choice(n) for _ in range(r.randrange(60))])))
    t = licenses.Templates.of(licenses.NOTICES)
    norm = lambda x: [tuple(w[i : i + 3]) for w in [x.encode().translate(licenses._SAME).split()] for i in range(len(w) - 2)]
    sets = [set(norm(x)) for _, x in licenses.NOTICES]
    want = {(d, k) for d, x in docs for k, s in enumerate(sets) if any(len(set(norm(x)[a : a + len(s)]) & s) >= t.contained * len(s) for a in range(len(x.split())))}
    got = {(x.doc_id, x.template) for x in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert want <= got and len(got - want) <= 2  # a window is longer than a template, so it may hold a little more
    assert licenses.bands_needed() < 40 and 1 - (1 - licenses.CONTAINED / (5 - licenses.CONTAINED)) ** licenses.bands_needed() >= licenses.SURE


def test_license_recall():
    """Whole license texts and notices within other words, a part of them changed: every template that a stretch of its length holds is found."""
    r, t = random.Random(7), licenses.Templates.of(licenses.TEMPLATES)
    filler = [f"filler{i}" for i in range(80)]
    norm = lambda x: x.encode().translate(licenses._SAME).split()
    texts, want = [], set()
    for i in range(60):
        words = []
        for _ in range(r.choice([1, 2])):
            own = norm(r.choice(licenses.TEMPLATES)[1])
            for _ in range(r.choice([0, 0, len(own) // 60, len(own) // 30])):
                own[r.randrange(len(own))] = r.choice(filler).encode()
            words += [r.choice(filler).encode() for _ in range(r.randrange(40))] + own
        texts.append(b" ".join(words))
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        for k, (_, template) in enumerate(licenses.TEMPLATES):
            y = norm(template)
            goal, n, held, most = {tuple(y[j : j + 3]) for j in range(len(y) - 2)}, len(y) - 2, Counter(), 0
            for j, g in enumerate(grams):
                if g in goal:
                    held[g] += 1
                if j >= n and grams[j - n] in goal:
                    held[grams[j - n]] -= 1
                    held += Counter()
                most = max(most, len(held))
            if most >= t.contained * len(goal):
                want.add((i, k))
    got = {(i, k) for i, k, *_ in t.scan(texts)}
    assert len(want) > 80 and want <= got


def test_url_index():
    assert urlfilter.literal_tokens(r"://(?:[^/?#]*\.)?cheap-pills\.") == ["cheap", "pills"] and urlfilter.literal_tokens(r"x(?:[^/]*\.)?a-b") == []
    assert urlfilter.literal_tokens(r"/(foo|bar)/baz/") == ["baz"] and urlfilter.literal_tokens(r"foo") == [] and urlfilter.literal_tokens(r"/foo?/") == []
    r = random.Random(1)
    rules = [urlfilter.PatternRule(f"r{i}", p) for i, p in enumerate([r"/ads/", r"[/.]track[/.]", r"\?id=[0-9]+$", r"/a(b|c)d/", r"//x-y\.", r"/ads/big/", r"q=(?:cat|dog)&", r"/Z/"])]
    f = urlfilter.Filter([], rules, {"ads": 100, "big": 1})
    assert any(n == "r5" for _, n, _ in f.index["big"])
    parts = ["ads", "big", "track", "?id=", "7", "abd", "acd", "x-y.", "/", "/", ".", "&", "q=cat", "q=dog", "Z"]
    for _ in range(3000):
        u = "http://" + "".join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        low = u.translate(f.lower)
        assert f.pattern(u)[0] == next((x.name for x in rules if re.search(x.pattern, low)), None), u


def test_warc_archive_layout():
    out = io.BytesIO()
    out.close, data = (lambda: None), out
    w = warc.Writer(out)
    records = [warc.page_record(i, f"http://h/{i}", f"<html>page {i} of many much alike</html>".encode() * 3, "X", None, False) for i in range(200)]
    for x in records:
        w.add(x)
    w.close()
    data.seek(0)
    assert data.read(4) == b"\x5d\x2a\x4d\x18"
    data.seek(0)
    assert [r.fields["WARC-Record-ID"] for r in warc.read_archive(data)] == [f"<urn:page:{i}>" for i in range(200)]
    data.seek(0)
    assert list(warc.read_archive(data))[7].block == records[7].block
    cut = io.BytesIO(data.getvalue()[:-5])
    with pytest.raises(ValueError, match="within a record"):
        list(warc.read_archive(cut))


def test_language_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    out = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 150 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98


def test_language_scores():
    texts = ["the cat and the dog", "le chat et le chien", "die katze und der hund", "", "12", None]
    bucket, counts, letters = langid.grams(texts)
    assert counts.tolist()[3:] == [0, 1 * 0 + counts[4], 0] and letters.tolist() == [15, 15, 18, 0, 0, 0]
    one = [langid.grams([t]) for t in texts]
    assert np.array_equal(bucket, np.concatenate([b for b, _, _ in one])) and counts.tolist() == [int(c[0]) for _, c, _ in one]


def test_pipeline_rejects_languages_without_a_label(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "xkcd qwrt zxcv bnmp lkjh gfds trwq plmk njbh vgcf xdrz wsqp mnbv zxqw rtpl kjhg fdsq wrtp lkjm nbvc",
    ]
    english = "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood."
    new = spark.createDataFrame([(-1 - i, t) for i, t in enumerate([english, *foreign])], "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["language_id"](spark, docs.unionByName(new, allowMissingColumns=True), sf_dir)
    assert [r.doc_id for r in out.where("doc_id < 0").collect()] == [-1]
    assert out.where("doc_id >= 0").count() >= 0.99 * docs.count()


def test_label_model():
    r = np.random.default_rng(0)
    good = r.random(20_000) < 0.85
    accuracy = np.linspace(0.7, 0.95, len(quality.LABELLERS))
    v = np.where(r.random((len(good), len(accuracy))) < accuracy, good[:, None], ~good[:, None]).astype(int)
    v[r.random(v.shape) < 0.3] = quality.NONE
    u, n = np.unique((v * 3 ** np.arange(v.shape[1])).sum(1), return_counts=True)
    m = quality.fit_labels(u, n)
    assert ((m.posterior(v) > 0.5) == good).mean() > 0.95 and abs(m.good - 0.85) < 0.05


def plain_votes(text):
    """Votes by plain loops."""
    w = (text or "").encode().split()
    if not w:
        return [quality.NONE] * len(quality.RULES)
    t, n = text.encode(), len(w)
    punctuation = set(range(33, 127)) - {c for c in range(128) if chr(c).isalnum()}
    letters = [c for c in t if 65 <= c <= 90 or 97 <= c <= 122]
    first = [t[i] for i in range(len(t)) if t[i] > 32 and (i == 0 or t[i - 1] <= 32)]
    lines = t.splitlines()
    shares = {
        "symbols": (sum(chr(c) in "#$%&*+<=>@[]^_`{}~\\" for c in t), len(t)),
        "capitals": (sum(c < 97 for c in letters), len(letters)),
        "repeats": (len(set(w)) * max(1, np.log10(max(10, n)) / 2), n),
        "columns": (sum(c in (124, 9) for c in t), n),
        "marks": (sum(c in punctuation for c in t), n),
        "doubled": (sum(a == b and a in punctuation for a, b in zip(t, t[1:], strict=False)), n),
        "starts": (sum(c >= 128 or 97 <= c <= 122 for c in first) / max(1, len(first)) * n, n),
        "sentences": (sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"', b"'") and x.rstrip() != b"" for x in lines), len(lines)),
        "stutter": (sum(a == b for a, b in zip(w, w[1:], strict=False)), n),
        "commonest": (max(Counter(w).values()), n),
    }
    out = []
    for name, bad, good, weight in quality.RULES:
        x = (shares[name][0] + weight * (bad + good) / 2) / (shares[name][1] + weight)
        out.append(0 if (x > bad if bad > good else x < bad) else 1 if (x < good if bad > good else x > good) else 2)
    return out


def test_quality(spark, sf_dir):
    """The whole query: votes by plain loops, a label model that a plain step of expectation-maximisation leaves as it is, weights where the
    plain loss is flat, scores and decisions from them."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = {r.doc_id: r.text for r in rows.collect()}
    scorer = quality.learn(rows)
    own = {d: plain_votes(t) for d, t in docs.items()}
    assert {d: v for d, v in zip(docs, quality.votes([(t or "").encode() for t in docs.values()]).tolist(), strict=True)} == own

    def posterior(v):
        p = [1 - scorer.labels.good, scorer.labels.good]
        for k, x in enumerate(v):
            p = [p[y] * scorer.labels.table[k][y][x] for y in (0, 1)]
        return p[1] / sum(p)

    label = {d: posterior(v) for d, v in own.items()}
    for k in range(len(quality.RULES)):
        for y in (0, 1):
            n = [sum((label[d] if y else 1 - label[d]) for d, v in own.items() if v[k] == x) for x in (0, 1)]
            n = [n[x] + quality.PRIOR[y][x] * (1 + quality.FIRM * sum(n)) for x in (0, 1)]
            assert abs(n[1] / sum(n) - scorer.labels.table[k][y][1]) < 1e-4
    w, flat, total = scorer.weights, scorer.weights * quality.DECAY, len(docs)
    texts = Counter(docs.values())
    score = {}
    for t, copies in texts.items():
        bucket, value, _ = quality.features([(t or "").encode()])
        score[t] = 1 / (1 + np.exp(-sum(w[b] * v for b, v in zip(bucket, value, strict=True)) - w[-1]))
        e = copies * (score[t] - posterior(plain_votes(t))) / total
        np.add.at(flat, bucket, e * value)
        flat[-1] += e
    assert np.abs(flat).max() < 3 * quality.TOLERANCE
    got = {r.doc_id: (r.score, r.kept) for r in quality.quality_scores(rows).collect()}
    assert all(abs(got[d][0] - score[t]) < 1e-4 for d, t in docs.items())

    def gap(least):
        good = sum(label[d] for d, t in docs.items() if score[t] >= least) / sum(label.values())
        return good - sum(1 - label[d] for d, t in docs.items() if score[t] >= least) / sum(1 - x for x in label.values())

    assert gap(scorer.least) >= max(gap(x) for x in score.values()) - 1e-6 and sum(got[d][1] != (score[t] >= scorer.least) for d, t in docs.items()) <= 1


def test_quality_of_labelled_documents(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = quality.quality_scores(docs).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in got if r.quality], [r.kept for r in got if not r.quality]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_a_hot_text_is_one_row_of_the_sample(spark):
    """Rows without an id are drawn by their texts, and equal texts are one weighted row."""
    text = "The river runs along the old town. People walk there in the evening."
    rows = [(None, f"{text} Number {i} of them is a little longer.") for i in range(3000)] + [(None, text)] * 2000 + [(None, f"x{i} | y | z | " * 20) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.quality_scores(docs, sample=600).groupBy("kept").count().collect()
    assert {r.kept: r["count"] for r in got} == {True: 5000, False: 1000}


def test_quality_is_learned_from_every_document(spark):
    """Of 4,000 different documents: the loss of all of them is flat at the weights, the threshold is the best for all of them, and neither
    depends on how they are dealt to tasks."""
    r = np.random.default_rng(5)
    words = np.array("the river runs along old town people walk there in evening and talk of rain".split())
    texts = []
    for i in range(4000):
        t = " ".join(r.choice(words, r.integers(4, 40))).capitalize() + "."
        texts.append(t.upper() + " || " * r.integers(0, 9) if i % 7 == 0 else t.replace(" ", " $# ") if i % 11 == 0 else f"{t} Number {i}.")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scorer = quality.learn(docs)
    encoded = [t.encode() for t in texts]
    bucket, value, sizes = quality.features(encoded)
    owner, w = np.repeat(np.arange(len(texts)), sizes), scorer.weights
    score = 1 / (1 + np.exp(-np.bincount(owner, weights=w[bucket] * value) - w[-1]))
    label = scorer.labels.posterior(quality.votes(encoded))
    error = (score - label) / len(texts)
    flat = np.append(np.bincount(bucket, weights=error[owner] * value, minlength=len(w) - 1), error.sum()) + quality.DECAY * w
    assert np.abs(flat).max() < 1.01 * quality.TOLERANCE

    def gap(least):
        return label[score >= least].sum() / label.sum() - (1 - label)[score >= least].sum() / (1 - label).sum()

    assert gap(scorer.least) >= max(map(gap, score)) - 1e-8
    dealt = quality.learn(docs.repartition(5))
    assert dealt.least == scorer.least and (dealt.weights == w).all()


def test_threshold_by_plain_sums(spark):
    r = np.random.default_rng(6)
    near = 1 - r.random(300) * 1e-9
    for score, p in (
        (np.concatenate([near, r.random(300), r.choice([0.25, 0.5], 200), r.random(100) * 1e-200]), 0.5),
        (near, 1.0),
        (near, 0.0),
        (np.full(50, 0.75), 0.5),
    ):
        good = np.rint(np.clip(p + (p == 0.5) * (score - r.random(len(score))), 0, 1) * quality.GOOD_ONE).astype(int).tolist()
        rows = list(zip(score.tolist(), good, strict=True))
        got = quality.best_threshold(spark.createDataFrame([*rows, (0.9, None)], "score double, good long"))
        goods, bads = (max(1, x) for x in (sum(good), sum(quality.GOOD_ONE - x for x in good)))
        gaps, over, under = {}, 0, 0
        for s, x in sorted(rows, reverse=True):
            over, under = over + x, under + quality.GOOD_ONE - x
            gaps[s] = over * bads - under * goods
        at = min(s for s, x in gaps.items() if x == max(gaps.values()))
        assert got == (at + max((s for s in gaps if s < at), default=0.0)) / 2
    assert quality.best_threshold(spark.createDataFrame([], "score double, good long")) == 0.5


def test_language_by_plain_counts(spark, sf_dir):
    """The whole query again by dictionaries of n-grams."""
    import zlib

    rows = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows}
    full = 2**64 - 1

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    @lru_cache(None)
    def bucket(gram):
        h = 0
        for n, c in enumerate(gram, 1):
            h = mixed((h + ord(c) + (n << 40)) & full)
        return h >> (64 - langid.BITS)

    def grams(text):
        if not text:
            return Counter()
        t = re.sub(r"(?:[^\w]|[\d_])+", " ", " " + text.lower() + " ")
        return Counter(bucket(t[i : i + n]) for n in langid.LENGTHS for i in range(len(t) - n + 1))

    counts, docs = {}, Counter()
    for r in rows:
        if not held[r.doc_id] and r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
            docs[r.lang] += 1
    sums = {k: sum(c.values()) + langid.SMOOTH * 2**langid.BITS for k, c in counts.items()}
    got = {r.doc_id: r for r in langid.language_id(read(spark, sf_dir, "documents")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own = grams(r.text)
        logs = {k: np.log(docs[k] / sum(docs.values())) + sum(n * np.log((counts[k][b] + langid.SMOOTH) / sums[k]) for b, n in own.items()) for k in sorted(counts)}
        best = max(logs, key=logs.get)
        want = best if any(c.isalpha() for c in r.text or "") else "und"
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (want, held[r.doc_id])
        if want != "und":
            assert abs(got[r.doc_id].score - 1 / sum(np.exp(x - logs[best]) for x in logs.values())) < 1e-6


def test_marks_do_not_cut_words():
    one, two = langid.grams(["हिन्दी"]), langid.grams(["ह न द"])
    assert one[1][0] == 3 * 6 + 2 + 1 and one[2][0] == 3 and two[2][0] == 3


def test_filter_rules_run_few_expressions(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").unionByName(spark.createDataFrame([(-1, "http://cheap-pills.x/", None), (-2, "http://a/deal/bets/x", None), (-3, "http://a/win.win/", None)], "page_id long, url string, html string"))
    got = urlfilter.url_verdicts(pages, [], Q.PATTERNS).collect()
    by = {r.page_id: r for r in got}
    assert by[-1].pattern == "||cheap-pills." and by[-2].pattern == "/deal/bets/*" and by[-3].verdict == "allow"
    assert len(Q.PATTERNS) > 2000 and max(r.regexes for r in got) < 150 and np.mean([r.regexes for r in got]) < 30
    with pytest.raises(ValueError, match="not a URL pattern"):
        urlfilter.parse_filters(["@@||x^"])
    assert [bool(re.search(urlfilter.parse_filters(["||x.y^"])[0].pattern, u)) for u in ("http://x.y/", "http://a.x.y", "http://ax.y/", "http://b/x.y/", "http://x.yz")] == [True, True, False, False, False]


def test_pipeline(spark, sf_dir):
    """Stage by stage against plain versions; each stage is judged on its own input."""
    import duckdb

    docs, duck = read(spark, sf_dir, "documents"), duckdb.connect()
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}

    def step(name, docs):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        return out, {r.doc_id for r in out.collect()}

    docs, ids = step("language_id", docs)
    assert all(any(c.isalpha() for c in texts[d]) for d in ids) and len(ids) >= 0.99 * sum(any(c.isalpha() for c in t) for t in texts.values())
    want = {max(d for d in ids if texts[d] == t) for t in {texts[d] for d in ids}}
    docs, ids = step("exact_dedup", docs)
    assert ids == want
    want = {c for _, c in brute_components([(d, texts[d]) for d in sorted(ids)], 5, 80, 100).values()}
    docs, ids = step("ngram_jaccard", docs)
    assert ids == want
    duck.execute("CREATE TABLE documents AS SELECT * FROM (VALUES " + ",".join(["(?::BIGINT, ?::VARCHAR)"] * len(ids)) + ") t(doc_id, text)", [x for d in ids for x in (d, texts[d])])
    duck.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet'")
    leaked = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({Q.SQL['op6_decontamination']}) WHERE contaminated").fetchall()}
    want = ids - leaked
    docs, ids = step("decontamination", docs)
    assert ids == want
    mixed = stages["mixing"](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in mixed} <= ids and Counter((r.doc_id, r.copy) for r in mixed).most_common(1)[0][1] == 1
    assert abs(len(mixed) - len(ids)) < 5 * len(ids) ** 0.5


@pytest.mark.parametrize("rate", [0.01, 0.7, 3.0, 40.0, 900.0, 30_000.0])
def test_poisson(rate):
    first, steps = mixing.poisson_steps(rate)
    p = np.diff(np.concatenate(([0.0], steps)))
    k = first + np.arange(len(p))
    assert abs(p.sum() - 1) < 1e-9 and abs((p * k).sum() - rate) < 1e-6 * max(1, rate) and abs((p * (k - rate) ** 2).sum() - rate) < 1e-4 * max(1, rate)
    assert len(steps) < 60 * rate**0.5 + 130


def test_mixing_is_the_same_in_any_partitioning(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2]) for i in range(3000)], "doc_id long, text string, source string")
    a, b = (mixing.mix_sources(d, {"a": 3.0, "b": 1.0}, seed=3).select("doc_id", "copy", "shuffle_key") for d in (docs, docs.repartition(7)))
    assert sorted(a.collect()) == sorted(b.collect())
    many = mixing.mix_sources(docs.limit(3), {"a": 1.0, "b": 1.0}, total=30_000).groupBy("source").count().collect()
    assert all(abs(r[1] - 15_000) < 800 for r in many)
    keys = [r.shuffle_key for r in mixing.mix_sources(docs, {"a": 1.0, "b": 1.0}, partitions=1).collect()]
    assert keys == sorted(keys) and abs(np.mean(keys) - 0.5) < 0.03
