"""Operators against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

import collections
import html
import html.parser
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from paperloom.llm import components, embedding, html_extract, langid, line_dedup, lm_score, minhash, mixing, quality, token_counts, wfst
from paperloom.llm.common import fresh_path

VOCAB = "the a of and to in on with river stone light green house tree road winter summer bread water fire glass paper sound night".split()


def text(rng, n):
    return " ".join(rng.choice(VOCAB) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "two words"), (6, "TWO words"), (7, "été 中文 \U0001f600 x")]
    base = [text(rng, rng.randint(40, 120)) for _ in range(25)]
    for i, b in enumerate(base):
        rows.append((10 + 10 * i, b))
        for k in range(rng.randint(0, 6)):
            words = b.split()
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 999)}"
            rows.append((11 + 10 * i + k, " ".join(words)))
    rows.append((999, text(rng, 15000)))
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def groups(links, ids):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_matches_brute_force(spark, corpus, k):
    sets = {i: shingles(t, k) for i, t in corpus}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, corpus), k=k).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert len(links) > 20


def test_minhash_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f", 5), (1, "a b c d e f", 6), (2, "A b c d e f", 7), (None, "x", 8)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == [(1, 1, True), (2, 1, False), (None, None, True)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_minhash_rows_of_one_id_link_by_their_own_texts(spark):
    a, b, c = ("one two three four five six seven", "nine ten red blue green white black", "river stone light house tree road winter")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, b), (4, c), (5, c)]
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (4, 4, True), (5, 4, False)])
    kept = [(r.doc_id, r.text) for r in minhash.deduplicated(frame(spark, rows)).collect()]
    assert sorted(kept) == sorted([(1, a), (1, b), (4, c)])


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_prefixes_of_similar_sets_meet(percent):
    rng = np.random.default_rng(percent)
    every = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    frequent, counts = every[::7], rng.integers(16, 99, len(every[::7]))
    similar = 0
    for _ in range(400):
        x = np.sort(rng.choice(every, rng.integers(1, 40), replace=False))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.95], rng.choice(every, rng.integers(0, 3))]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= percent * (len(x) + len(y) - both):
            similar += 1
            first = [minhash.prefix(s, percent / 100, frequent, counts) for s in (x, y)]
            assert len(np.intersect1d(*first))
    assert similar > 30


def test_minhash_residual_join_finds_links_that_stars_miss(spark):
    """Members of one bucket that link with each other, but not with the bucket's first."""
    rng = random.Random(12)
    base = [f"w{rng.getrandbits(40)}" for _ in range(200)]
    rows, i = [(0, " ".join(base))], 1
    for g in range(12):
        own = list(base)
        own[8 * g : 8 * g + 40] = [f"g{g}x{k}" for k in range(len(own[8 * g : 8 * g + 40]))]
        for k in range(4):
            rows.append((i, " ".join(own + [f"t{g}y{k}"])))
            i += 1
    sets = {j: shingles(t, 2) for j, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), k=2).collect()}
    assert got == want and len(set(want.values())) > 3


def test_deduplicated_keeps_one_row_of_an_id_and_text_and_null_ids(spark):
    t, u = "one two three four five six seven eight", "nine ten red blue green white black grey"
    rows = [(1, t, "b"), (1, t, "a"), (2, t, "a"), (3, u, "c"), (3, u, "c"), (None, t, "d"), (None, u, "e")]
    got = minhash.deduplicated(frame(spark, rows, "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, t, "a"), (3, u, "c"), (None, t, "d"), (None, u, "e")], key=str)


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    s = minhash.sketch(np.concatenate([a, b]), np.repeat([0, 1], 400), 2)
    assert (s != np.uint64(2**64 - 1)).all() and abs((s[0] == s[1]).mean() - 0.6) < 0.15
    assert (minhash.sketch(a[:1], np.zeros(1, np.int64), 1) != np.uint64(2**64 - 1)).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for label in (1, 2):
        for _ in range(350):
            v = rng.standard_normal(16)
            for k in range(rng.integers(1, 4)):
                rows.append((i, [float(x) for x in v + 0.12 * k * rng.standard_normal(16)], label))
                i += 1
    rows += [(i, rows[0][1], 1), (i + 1, rows[0][1], None), (i + 2, None, 1), (i + 3, [0.0] * 16, 1), (i + 4, [float("nan")] * 16, 1), (i + 5, [None] * 16, 1), (i + 6, [1.0], 1), (i + 7, [], 1)]
    got = {r.vec_id: r for r in embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    links = []
    for label in (1, 2):
        own = [(j, np.array(v, np.float32).astype(float)) for j, v, l in rows if l == label and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
        x = np.stack([v / np.linalg.norm(v) for _, v in own])
        links += [(own[p][0], own[q][0]) for p, q in zip(*np.nonzero(x @ x.T >= 0.93)) if p < q]
    degree = collections.Counter(j for pair in links for j in pair)
    assert sum(r.n_links for r in got.values()) >= 0.98 * 2 * len(links) and all(r.n_links <= degree[j] for j, r in got.items())
    want = groups(links, [r[0] for r in rows])
    assert np.mean([got[j].component_id == want[j] for j in want]) > 0.98 and len(got) == len(rows)


def test_embeddings_of_repeated_and_null_ids_long_labels_and_a_dense_cluster(spark):
    rng = np.random.default_rng(2)
    u, w = rng.standard_normal(8), rng.standard_normal(8)
    rows = [(1, u, 2**40), (1, w, 2**40), (2, u, 2**40), (3, 2 * w, 2**40), (None, u, 2**40), (4, u, 2**40 + 2**32), (5, u, None)]
    dense = rng.standard_normal(8)
    rows += [(100 + k, dense + 0.03 * rng.standard_normal(8), 7) for k in range(700)]
    schema = "vec_id long, embedding array<double>, label long, n_links int, id string"
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.near_vectors(spark.createDataFrame([(i, [float(c) for c in v], l, 5, "x") for i, v, l in rows], schema)).collect()]
    few = [r for r in got if r[0] is None or r[0] < 100]
    assert sorted(few, key=str) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 0, None, True), (4, 0, 4, True), (5, 0, 5, True)], key=str)
    x = np.stack([v / np.linalg.norm(v) for i, v, _ in rows if i and i >= 100])
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert want.sum() > 100_000 and {r[0]: r[1] for r in got if r[0] and r[0] >= 100} == {100 + k: n for k, n in enumerate(want)}
    assert embedding.near_vectors(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores_match_brute_force(spark, corpus, order):
    docs = {i: (t or "").encode().lower().split() for i, t in corpus}
    own = {i: collections.Counter(tuple(w[j - k + 1 : j + 1]) for k in range(1, order + 1) for j in range(k - 1, len(w))) for i, w in docs.items()}
    every = sum(own.values(), collections.Counter())
    n = sum(map(len, docs.values()))
    got = {r.doc_id: r for r in lm_score.lm_scores(frame(spark, corpus), order=order).collect()}
    for i, w in docs.items():
        total = 0.0
        for j in range(len(w)):
            top = min(order, j + 1)
            for k in range(top, 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                c = every[g] - own[i][g]
                if c > 0 or k == 1:
                    total += math.log((c or 0.5) / ((every[g[:-1]] - own[i][g[:-1]]) if k > 1 else n - len(w))) + (top - k) * math.log(0.4)
                    break
        assert got[i].n_words == len(w) and abs(got[i].log_sum - total) < 1e-6 * max(1, abs(total))
    assert got[0].score is None


def test_lm_counts_packing_and_odd_rows(spark, corpus):
    rng = np.random.default_rng(4)
    for x in ([], [0], [0, 0, 255], [256, 1], [2**63, 5, 2**64 - 1], rng.integers(0, 2**40, 999).tolist()):
        assert lm_score.unpacked(lm_score.packed(np.array(x, np.uint64))).tolist() == x
    for n in (1, 4, 7, 144, 100_003):
        h = np.sort(np.concatenate([rng.integers(0, 2**64, 5000, np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
        bucket = lm_score._split(h, n)
        place = lm_score._within(h, bucket, n)
        assert bucket.max() < n and (place < np.uint64(2**48)).all() and all((np.diff(place[bucket == k].astype(np.int64)) >= 0).all() for k in np.unique(bucket)[:50])
        assert len(set(zip(bucket.tolist(), place.tolist()))) == len(h)
    words = [w for _, t in corpus for w in [(t or "").encode().lower().split()]]
    want = collections.Counter(len(g) for g in {tuple(w[j : j + k]) for w in words for k in (1, 2, 3) for j in range(len(w) - k + 1)})
    rows = lm_score.ngram_counts(frame(spark, corpus)).collect()
    assert collections.Counter(r.k for r in rows) == want and sum(r.n for r in rows if r.k == 1) == sum(map(len, words))
    odd = frame(spark, [(1, "a b", 1), (1, "a b", 1), (None, "a b c", 2), (2, None, 3), (3, "  ", 3)], "doc_id long, text string, n_words int")
    got = sorted(((r.doc_id, r.n_words, r.score is None) for r in lm_score.lm_scores(odd).collect()), key=str)
    assert got == sorted([(1, 2, False), (1, 2, False), (None, 3, False), (2, 0, True), (3, 0, True)], key=str)
    assert lm_score.lm_scores(frame(spark, [])).count() == 0


def test_lm_query_uses_trigrams(spark, corpus, tmp_path):
    frame(spark, corpus).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = lambda df: {r.doc_id: r.score and round(r.score, 9) for r in df.collect()}
    got = scores(lm_score.op4_lm_scoring(spark, str(tmp_path)))
    assert got == scores(lm_score.lm_scores(docs, order=3)) != scores(lm_score.lm_scores(docs, order=2))


def test_token_counts_and_cache(spark, corpus):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    path = fresh_path(spark, "test-cache")
    rows = corpus + [(5, "two words"), (None, "<s> </s>")]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(frame(spark, rows), path).collect())
    assert got == sorted((i or -1, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows)
    before = spark.read.parquet(path).count()
    assert before == len({t or "" for _, t in rows})
    again = token_counts.token_counts(frame(spark, rows + [(77, "fresh text")]), path)
    assert again.count() == len(rows) + 1 and spark.read.parquet(path).count() == before + 1


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/x>Menu</a></nav>{body}<footer>&copy; x</footer></body></html>"


def test_html_extraction(spark):
    text_ = "Some words of the story, long enough to win. " * 4
    pages = [
        (1, "http://a.org/1", page(f"<div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p>{text_}<br>x<p><b>bold</b>ly&nbsp;so</article><div id=comments>nice {text_ * 3}</div>")),
        (2, "http://a.org/2", page("<article><p>Short</p><aside>no</aside><form>mail</form></article>")),
        (3, "http://b.org/1", page(f"<div id='wrap'><div class='post1'><p>{text_}</p><script>var a='</p>';</script></div><div class='sidebar'>links</div></div>")),
        (4, None, None), (5, "x", ""), (6, "http://c.org", "<p>un<i>closed"), (7, "http://c.org", "a < b &lt; c"),
    ]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    flat = " ".join(text_.split())
    assert got == {1: f"Head & more {flat} x boldly so", 2: "Short", 3: flat, 4: "", 5: "", 6: "unclosed", 7: "a < b < c"}


class Naive(html.parser.HTMLParser):
    """Containers and texts of a well-formed page, as (steps, text, text in links) for each block."""

    def __init__(self, page):
        super().__init__()
        self.open_, self.out, self.parts, self.linked, self.links = [], [], [], 0, 0
        self.feed(page)
        self.end_block()

    def end_block(self):
        t = " ".join("".join(self.parts).split())
        if t:
            steps = [x for x in self.open_ if x[0] not in ("a", "b", "i")]
            first = next((k for k, x in enumerate(steps) if x[0] == "article"), None)
            last = first if first is not None else max((k for k, x in enumerate(steps) if x[0] in ("body", "div", "section", "article")), default=None)
            if not any(x[0] in ("nav", "footer") or x[0] != "article" and "sidebar" in x[1] for x in steps):
                self.out.append((tuple(steps[: last + 1]) if last is not None else (), t, self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b", "i"):
            self.end_block()
        self.links += tag == "a"
        self.open_.append((tag, "".join("." + re.sub(r"\d", "", c) for c in sorted((dict(attrs).get("class") or "").split()))))

    def handle_endtag(self, tag):
        if tag not in ("a", "b", "i"):
            self.end_block()
        self.links -= tag == "a"
        self.open_.pop()

    def handle_data(self, data):
        self.parts.append(data)
        self.linked += len(data.strip()) if self.links else 0


def naive_extract(pages):
    votes, read = collections.defaultdict(collections.Counter), {}
    for i, host, page in pages:
        read[i] = Naive(page).out
        own = collections.Counter()
        plain = any(len(t) > l for _, t, l in read[i])
        for steps, t, l in read[i]:
            own[steps] += len(t) - l if plain else len(t)
        for steps, n in own.items():
            share = n / sum(own.values())
            for k in range(len(steps), 0, -1):
                if steps[k - 1][0] in ("body", "div", "section", "article"):
                    votes[host][steps[:k]] += share
                    votes[i][steps[:k]] += share
                    share *= 0.6
    top = lambda v: max(v, key=v.get) if v else None
    under = lambda i, path: " ".join(t for s, t, _ in read[i] if s[: len(path)] == path) if path else ""
    return {i: under(i, top(votes[host])) or under(i, top(votes[i])) for i, host, _ in pages}


def test_html_extraction_equals_a_naive_one_on_well_formed_pages(spark):
    rng = random.Random(41)
    words = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))

    def tree(depth):
        tag = rng.choice(["div", "div", "section", "ul", "p", "article"]) if depth else "p"
        inner = "".join(tree(depth - 1) if tag != "p" and rng.random() < 0.8 else words(rng.randint(1, 9)) + f" <a>{words(rng.randint(1, 3))}</a> <b>{words(1)}</b>" for _ in range(rng.randint(1, 4)))
        names = rng.choice(["", "", " class='x1 y'", " class='z'", " class='sidebar'"]) if tag != "p" else ""
        return f"<{tag}{names}>{inner}</{tag}>"

    pages = []
    for h in range(6):
        shape = tree(3)
        for k in range(8):
            story = tree(3) if k == 0 else re.sub(r"\bx\d", f"x{k}", shape).replace("the ", words(rng.randint(1, 12)) + " ")
            pages.append((10 * h + k, f"h{h}", f"<html><body><nav><a>menu</a></nav>{story}<footer>end</footer></body></html>"))
    want = naive_extract(pages)
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame([(i, f"http://{h}/p{i}", p) for i, h, p in pages], "page_id long, url string, html string")).collect()}
    assert got == want and sum(map(bool, want.values())) > 40


def test_html_odd_pages(spark):
    pages = [(1, "http://l.org/1", "<html><body><nav>no</nav><article><a href=x>All linked text here</a> <a>and more</a></article></body></html>"), (1, "http://l.org/1", "<article><p>Own</p></article>"), (2, "http://deep.org", "<div>" * 40_000 + "core &amp; more" + "</b>" * 40_000), (3, "http://deep.org/2", "<b>" * 20_000 + "<li>x" * 20_000)]
    clash = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, path string")
    got = sorted((r.page_id, r.text[:30], r.n_chars) for r in html_extract.extract(clash).collect())
    assert got == [(1, "All linked text here and more", 29), (1, "Own", 3), (2, "core & more", 11), (3, "x x x x x x x x x x x x x x x ", 39_999)]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_base_columns(spark, corpus):
    extra = [(2000, "a b c " * 40), (2001, "x # $ %\nline\nline\n\nline two\nline"), (2002, "p q r\np q r x")]
    rows = [(i, t, "en") for i, t in corpus + extra]
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        marked = {j + s for j, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for s in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_script_reads_the_whole_text():
    assert quality.script("") == "none" and quality.script("12 !\udce9") == "none"
    assert quality.script("ab " + "中文字" * 3) == "Han" and quality.script("Привет " * 9 + "word " * 3) == "Cyrillic"
    assert quality.script("abc " * 5000 + "мир" * 6000) == "Cyrillic"


def test_quality_bands_reject_symbols_and_keep_clean(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randint(80, 300)), "en") for i in range(300)]
    junk = [(1000 + i, " ".join(x + rng.choice(["###", "$$$", "%%%"]) for x in text(rng, 150).split()), "en") for i in range(10)]
    kept = {r.doc_id for r in quality.passing(frame(spark, rows + junk, "doc_id long, text string, lang string")).collect()}
    assert len(kept & {i for i, *_ in rows}) >= 298 and not kept & {i for i, *_ in junk}


def test_quality_judges_entropy_in_sparse_doublings(spark):
    rng = random.Random(25)
    words = ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    made = lambda n, of: " ".join(of[int(len(of) * rng.random() ** 2)] for _ in range(n))
    rows = [(i, made(rng.randint(70, 350), words), "en") for i in range(600)]
    long_ = [(1000 + i, made(rng.randint(2000, 3500), words), "en") for i in range(120)]
    junk = (2000, made(3000, words[:70]), "en")
    for more in (long_[:12], [], long_):  # few and no documents around the judged one, and its own band
        got = {r.doc_id: r for r in quality.quality(frame(spark, rows + more + [junk], "doc_id long, text string, lang string")).collect()}
        assert not got[2000].base_failed and not got[2000].kept and got[2000].shortfall > 4
        assert sum(got[i].kept for i, *_ in rows + more) >= len(rows + more) - 3
    few = {r.doc_id: r for r in quality.quality(frame(spark, rows[:50] + [junk], "doc_id long, text string, lang string")).collect()}
    assert few[2000].shortfall > 2 > max(few[i].shortfall for i, *_ in rows[:50]) and all(few[i].kept for i, *_ in rows[:50])


def test_quality_bands_equal_a_second_implementation(spark):
    """Bands of two languages, a script and the small groups, each doubling of which is large enough for its own quartiles or the group's only one."""
    import pandas as pd

    rng = random.Random(61)
    letters = {"en": "etaoinshrdlu", "xx": "qzkvwjpyxg", None: "αβγδεζηθικλμν", "s1": "etaoin", "s2": "rdlucm"}
    made = lambda l, n: " ".join("".join(rng.choice(letters[l]) for _ in range(rng.randint(2, 8))) for _ in range(n))
    junk = {l: [made(l, 1) for _ in range(25)] for l in letters}
    rows = [(i, made(l, 150 + rng.randint(0, 9)) if rng.random() < 0.95 else " ".join(rng.choice(junk[l]) for _ in range(170)), l) for i, l in enumerate(["en"] * 160 + ["xx"] * 140 + [None] * 130 + ["s1"] * 20 + ["s2"] * 15)]
    rows += [(900, made("en", 20), "en"), (901, None, "en"), (902, "", None), (5, rows[5][1], "en")]
    schema = "doc_id long, text string, lang string, n_words int, k_doc_id int, band string"
    got = pd.DataFrame([r.asDict() for r in quality.quality(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)).collect()])
    x = pd.DataFrame({"t": [t or "" for _, t, _ in rows], "lang": [l for *_, l in rows], "doc_id": [i for i, *_ in rows]})
    x = pd.concat([x, pd.DataFrame(dict(zip([n for n, _ in quality.COLUMNS], quality.measure(x.t.tolist()))))], axis=1)
    x["failed"] = (x.n_words < 50) | (2 * x.n_repeat_words > x.n_words)
    x["group"] = [l or s for l, s in zip(x.lang, x.script)]
    sizes = x[~x.failed].group.value_counts()
    x["band"] = [g if sizes.get(g, 0) >= 100 else "*" for g in x.group]
    x["doubling"] = np.floor(np.log2(x.n_tokens.clip(1))).astype(int)
    assert set(x.band) == {"en", "xx", "Greek", "*"}
    low = lambda v, q: v.sort_values().iloc[max(0, math.ceil(q * len(v)) - 1)]

    def outside(col, least, by, above=False):
        out = pd.Series(0.0, x.index)
        for _, own in x.groupby(by):
            v = own[~own.failed][col]
            if len(v):
                a, b = low(v, 0.25), low(v, 0.75)
                out[own.index] = ((own[col] - b if above else a - own[col]) / (max(b - a, least) * (1 + 20 / len(v)))).clip(lower=0)
        return out

    for z, c, n in (("z1", "chars_per_token", "n_tokens"), ("z2", "chars_per_token_2", "n_tokens_2"), ("zb", "byte_share", "n_tokens")):
        x[z] = (x[c] - x.band.map({g: low(own[~own.failed][c], 0.5) for g, own in x.groupby("band")})) * np.sqrt(x[n])
    x["shortfall"] = (outside("z1", 0.5, "band") + outside("z2", 0.5, "band")) / 2 + outside("token_entropy", 0.02, ["band", "doubling"]) + outside("token_entropy_2", 0.02, ["band", "doubling"])
    x["excess"] = outside("zb", 0.05, "band", above=True)
    cells = x[~x.failed].groupby(["band", "doubling"]).size()
    full = {k for k, n in cells.items() if n >= 100}
    x["sure"] = [k in full or f for k, f in zip(zip(x.band, x.doubling), x.failed)]
    assert x.sure.sum() > 380
    both = x[x.sure].sort_values(["doc_id", "n_words"]).merge(got.drop_duplicates("doc_id"), on="doc_id", suffixes=("", "_got"))
    sure = both[~both.failed]
    assert np.allclose(sure.shortfall, sure.shortfall_got, atol=1e-6) and np.allclose(sure.excess, sure.byte_excess, atol=1e-6)
    assert (both.kept == (~both.failed & (both.shortfall <= 3.75) & (both.excess <= 4.0))).all() and 5 < (~both.kept).sum() < 60 and len(got) == len(rows)
    assert quality.quality(frame(spark, [], "doc_id long, text string, lang string")).count() == 0


def test_transducer_equals_library_and_round_trips(spark, corpus):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    t = wfst.transducer()
    rng = random.Random(2)
    alphabet = list("aeioutnrs  ▁\n\t,.ÄéñЖм中字\U0001f600́") + ["<s>", "the", "ing"]
    for _ in range(3000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert t.encode(x) == sp.encode(x)
        assert t.decode(t.encode(x)) == x.replace("▁", " ")
    rows = wfst.encode(frame(spark, corpus)).collect()
    texts = dict(corpus)
    assert all(r.ids == sp.encode(texts[r.doc_id] or "") and r.round_trip for r in rows)
    clash = frame(spark, [(1, "the the", 5, 6), (1, "the the", 5, 6), (None, "x", 7, 8)], "doc_id long, text string, ids int, n_tokens int")
    assert sorted(((r.doc_id, r.ids) for r in wfst.encode(clash).collect()), key=str) == [(1, sp.encode("the the"))] * 2 + [(None, sp.encode("x"))]
    assert wfst.encode(frame(spark, [])).count() == 0
    back = wfst.decode(wfst.encode(frame(spark, corpus))).collect()
    assert all(r.text == (texts[r.doc_id] or "") for r in back)


def test_shortest_path_is_the_least_sum_of_weights():
    """Against dynamic programming over all segmentations, with made weights, so that paths of weight above 0 win too."""
    t = wfst.Transducer()
    rng = random.Random(9)
    t.weight = lambda arc: t.weights.setdefault(arc, rng.randint(0, 1))
    for _ in range(60):
        x = "▁" + "".join(rng.choice("aeiounrstzq") for _ in range(rng.randint(1, 9)))
        best = {(0, wfst.OTHER): 0}
        for end in range(1, len(x) + 1):
            for start in range(end):
                piece = t.id.get(x[start:end]) if x[start:end] in t.rank else None
                if piece is None:
                    continue
                for (at, left), cost in list(best.items()):
                    if at == start:
                        w = t.weight(left * wfst.OTHER + piece) if left != wfst.OTHER else 0
                        best[end, piece] = min(best.get((end, piece), 99), cost + w)
        distance, path = t._shortest(x)
        assert distance == min(c for (at, _), c in best.items() if at == len(x))
        assert "".join(t.text[p] for _, p in path) == x
        assert distance == sum(t.weights[a * wfst.OTHER + b] for (_, a), (_, b) in zip(path, path[1:]))
    t = wfst.transducer()
    assert all(t._shortest(x)[0] == 0 for x in ("▁the", "▁Straße", "▁qzxqzx", "▁日a"))


def brute_lines(rows, min_words, window):
    docs = {i: [b" ".join(x.split()) for x in t.encode().split(b"\n")] if t else [] for i, t in rows}
    prints = {i: line_dedup.fingerprints(*line_dedup.line_hashes(dict(rows)[i]), min_words, window) for i in docs}
    first = {}
    for i in sorted(docs):
        for f, at in prints[i]:
            first.setdefault(f, (i, at))
    gone = {i: set() for i in docs}
    for i in docs:
        for f, at in prints[i]:
            s, sat = first[f]
            if (s, sat) == (i, at):
                continue
            a, b = docs[i], docs[s]
            k = 0
            while at - k >= 0 and sat - k >= 0 and a[at - k] == b[sat - k]:
                gone[i].add(at - k)
                k += 1
            k = 0
            while at + k < len(a) and sat + k < len(b) and a[at + k] == b[sat + k]:
                gone[i].add(at + k)
                k += 1
    return {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]) if t else t for i, t in rows}, gone


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    passages = [[text(rng, rng.randint(1, 12)) for _ in range(rng.randint(6, 12))] for _ in range(5)]
    rows = [(0, None), (1, ""), (2, "\n\n")]
    for i in range(3, 60):
        lines = [text(rng, rng.randint(0, 10)) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 2)):
            lines += rng.choice(passages) + [text(rng, 4)]
        rows.append((i, "\n".join(lines)))
    rows.append((90, "\n".join(["same line here again"] * 60)))
    want, gone = brute_lines(rows, 20, 2)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows), min_words=20, window=2).collect()}
    assert {i: r.text for i, r in got.items()} == want and sum(map(len, gone.values())) > 100
    assert {i: r._n_removed for i, r in got.items()} == {i: len(x) for i, x in gone.items()}
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def repeated_lines(rows, least):
    """Lines of later places in all maximal equal runs of more than `least` words, by comparing every pair of lines."""
    docs = [(i, [x.split() for x in t.split("\n")]) for i, t in sorted(rows)]
    gone = {i: set() for i, _ in docs}
    for k, (i, a) in enumerate(docs):
        for j, b in docs[: k + 1]:
            for at in range(len(a)):
                for from_ in range(len(b) if i != j else at):
                    if a[at] != b[from_] or (at and from_ and a[at - 1] == b[from_ - 1]):
                        continue
                    n = 0
                    while at + n < len(a) and from_ + n < len(b) and a[at + n] == b[from_ + n]:
                        n += 1
                    if sum(map(len, a[at : at + n])) > least:
                        gone[i].update(range(at, at + n))
    return gone


def test_line_dedup_deletes_every_repeated_run(spark):
    rng = random.Random(18)
    fresh = lambda n: " ".join(f"u{rng.getrandbits(60)}" for _ in range(n))
    shared = [[fresh(51)], [fresh(13) for _ in range(4)], [fresh(39), fresh(900), fresh(1)], [fresh(3), fresh(39), fresh(39)], [fresh(5) for _ in range(11)]]
    texts = []
    for run in shared * 12:
        texts.append("\n".join([fresh(rng.randint(1, 60)) for _ in range(rng.randint(0, 3))] + run + [fresh(rng.randint(1, 60)) for _ in range(rng.randint(0, 3))]))
    texts += ["\n".join([fresh(2), shared[2][1], fresh(9)]), "\n".join([fresh(2), shared[3][1], fresh(9)])]  # a line of a run with other neighbours, first of all places
    rows = list(enumerate(reversed(texts)))
    want = repeated_lines(rows, 50)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    for i, t in rows:
        left = set(got[i].text.split("\n"))
        assert not [x for k, x in enumerate(t.split("\n")) if k in want[i] and x in left]
        assert got[i]._n_removed == len(want[i])
    assert sum(map(len, want.values())) > 150
    assert {x for _, t in rows for x in t.split("\n")} == {x for r in got.values() for x in r.text.split("\n")} - {""}


def test_line_dedup_of_repeated_and_null_ids_and_clashing_names(spark):
    rng = random.Random(31)
    a, b, c = ("\n".join(text(rng, 30) for _ in range(4)) for _ in range(3))
    rows = [(1, a, 9, "x"), (2, a, 9, "x"), (2, b, 9, "x"), (None, a, 9, "x"), (None, a, 9, "x"), (3, c, 9, "x"), (3, c, 9, "x"), (4, "x\n" + c, None, None), (5, "", 1, "y"), (6, None, 1, "y")]
    docs = frame(spark, rows, "doc_id long, text string, _n_lines int, runs string")
    got = [(r.doc_id, r.text, r._n_removed) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, a, 0), (2, "", 4), (2, b, 0), (None, a, 0), (None, a, 0), (3, c, 0), (3, c, 0), (4, "x", 4), (5, "", 0), (6, None, 0)], key=str)
    kept = line_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([r if r[0] != 4 else (4, "x", None, None) for r in rows if r != rows[1]], key=str)


def test_mixing_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 30, 200])), rng.choice(["b", "a", "c", None, "d"])) for i in range(400)] + [(9999, None, "a"), (9998, "w " * 5000, "a")]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    names = ["a", "b", "c", "d", None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    goals = mixing.targets(sizes, [3, 1, 2, 3, 1], 1.5 * sum(sizes), 2)
    assert abs(sum(goals) - min(1.5, 2) * sum(sizes)) < 1e-6 and all(g <= 2 * n + 1e-9 for g, n in zip(goals, sizes))
    for n, size, goal in zip(names, sizes, goals):
        own = [r for r in got if r.members == [n]]
        assert {(r.source_size, r.target) for r in own} == {(size, goal)} and abs(sum(r.taken for r in own) - goal) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in got) and len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    words = collections.Counter(r.doc_id for r in got for _ in range(r.taken))
    out = collections.Counter()
    for r in mixing.mixed(docs).collect():
        out[r.doc_id] += len(r.text.split())
    assert out == words
    assert mixing.mix_sources(frame(spark, [], "doc_id long, text string, source string")).count() == 0


def test_flow_prefers_fresh_words():
    flow = mixing.min_cost_flow([((0,), 10), ((0, 1), 10), ((1,), 10)], [15, 15], 2)
    assert [sum(f.values()) for f in flow] == [10, 10, 10] and sum(f.get(0, 0) for f in flow) == 15
    flow = mixing.min_cost_flow([((0,), 10), ((1,), 10)], [30, 5], 2)
    assert [sum(f.values()) for f in flow] == [20, 5]


def cheapest(patterns, quotas, repeats):
    """(words, cost) of a maximum flow of least cost: word by word along cheapest paths, found by Bellman-Ford."""
    n, end = len(patterns), len(patterns) + len(quotas) + 1
    arcs = []
    for p, (members, size) in enumerate(patterns):
        arcs += [[0, 1 + p, size, k * (k + 1) // 2] for k in range(repeats)] + [[1 + p, 1 + n + s, size * repeats, 0] for s in members]
    arcs += [[1 + n + s, end, q, 0] for s, q in enumerate(quotas)]
    arcs = [x for a in arcs for x in (a, [a[1], a[0], 0, -a[3]])]
    words = cost = 0
    while True:
        far, via = {0: 0}, {}
        for _ in range(end + 1):
            for i, (a, b, room, c) in enumerate(arcs):
                if room and a in far and far[a] + c < far.get(b, 1 << 40):
                    far[b], via[b] = far[a] + c, i
        if end not in far:
            return words, cost
        b = end
        while b:
            arcs[via[b]][2] -= 1
            arcs[via[b] ^ 1][2] += 1
            b = arcs[via[b]][0]
        words, cost = words + 1, cost + far[end]


def test_flow_is_a_cheapest_maximum_flow():
    rng = random.Random(14)
    for _ in range(60):
        m, repeats = rng.randint(1, 5), rng.randint(1, 3)
        names = {tuple(sorted(rng.sample(range(m), rng.randint(1, m)))) for _ in range(rng.randint(1, 6))}
        patterns = [(x, rng.randint(0, 7)) for x in sorted(names)]
        quotas = [rng.randint(0, 12) for _ in range(m)]
        flow = mixing.min_cost_flow(patterns, quotas, repeats)
        through = [sum(f.values()) for f in flow]
        assert all(t <= size * repeats for t, (_, size) in zip(through, patterns))
        assert all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quotas)) and all(set(f) <= set(x) for f, (x, _) in zip(flow, patterns))
        price = lambda t, size: sum(k * (k + 1) // 2 * min(size, max(0, t - k * size)) for k in range(repeats))
        assert (sum(through), sum(price(t, size) for t, (_, size) in zip(through, patterns))) == cheapest(patterns, quotas, repeats)


def test_mixing_of_overlapping_sources_repeated_ids_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rng = random.Random(15)
    rows = [(i, "w " * rng.randint(0, 90), sorted(rng.sample("abcd", rng.randint(1, 3))), 5) for i in range(300)] + [(7, "w " * 40, ["a"], 5), (7, "w " * 40, ["a"], 5), (None, "w w", ["b"], 5), (400, "w", [None], 5), (401, "w", [], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, members array<string>, taken int")
    got = mixing.mix_sources(docs, members=F.col("members"), max_repeats=3, budget=2.0).collect()
    names = ["a", "b", "c", "d", None]
    patterns, n_docs = collections.Counter(), len(rows)
    for _, t, m, _ in rows:
        patterns[tuple(names.index(x) for x in m)] += len(t.split())
    sizes = [sum(n for p, n in patterns.items() if s in p) for s in range(5)]
    goals = mixing.targets(sizes, [3, 1, 2, 3, 1], 2.0 * sum(patterns.values()), 3)
    words, _ = cheapest([(p, n) for p, n in patterns.items()], [round(g) for g in goals], 3)
    assert len(got) == n_docs and sum(r.taken for r in got) == words and all(0 <= r.taken <= 3 * r.size for r in got)


def test_language_id(spark):
    rng = random.Random(6)
    letters = {"en": "etaoinshr", "xx": "qzkvwjpy", "gr": "αβγδε"}
    rows = [(i, " ".join("".join(rng.choice(letters[l]) for _ in range(5)) for _ in range(30)), l) for i in range(200) for l in [rng.choice(list(letters))]]
    train = frame(spark, rows + [(900, None, "en"), (901, "abc", None)], "id long, text string, label string")
    labels, table = langid.fit(train)
    assert labels == ["en", "gr", "xx"] and np.allclose(np.exp(table.astype(float)).sum(axis=0), 1, atol=1e-3)
    test = rows + [(1000, None, None), (1001, "123 !?", None), (1002, "", None)]
    got = {r.id: r for r in langid.predict(frame(spark, [(i, t) for i, t, _ in test], "id long, text string"), (labels, table)).collect()}
    assert all(got[i].lang_pred == l for i, _, l in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert langid.fit(frame(spark, [], "id long, text string, label string"))[0] == []
    assert zlib.crc32(b"7") == spark.sql("select crc32(cast('7' as binary))").first()[0] and html


def test_language_query_equals_a_second_naive_bayes(spark, tmp_path):
    rng = random.Random(16)
    letters = {"en": "etaoin", "de": "etaoüß", "xx": "qzkvwj"}
    made = lambda l: " ".join("".join(rng.choice(letters[l]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(2, 25)))
    rows = [(i, made(l), l) for i in range(240) for l in [rng.choice(list(letters))]]
    rows += [(7, rows[7][1], "en"), (7, "qzk vwj", None), (None, "eta oin", "en"), (500, None, "en"), (501, "12 !", "xx"), (502, "", None), (503, made("en") * 400, None)]
    frame(spark, [(*r, 0.5, True) for r in rows], "doc_id long, text string, lang string, score double, held_out boolean").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in langid.op10_language_id(spark, str(tmp_path)).collect()), key=str)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    bag = lambda t: collections.Counter(int(f) for f in langid.features([t])[0])
    counts = collections.defaultdict(collections.Counter)
    for i, t, l in rows:
        if t is not None and l and not held(i):
            counts[l] += bag(t)
    sums = {l: sum(c.values()) + 0.5 * 2**16 for l, c in counts.items()}
    want = []
    for i, t, _ in rows:
        name, score = "und", 0.0
        if t and any(c.isalpha() for c in t):
            f = bag(t)
            mean = {l: sum(n * math.log((counts[l][x] + 0.5) / sums[l]) for x, n in f.items()) / sum(f.values()) for l in sorted(counts)}
            name = max(mean, key=mean.get)
            score = 1 / sum(math.exp(20 * (m - mean[name])) for m in mean.values())
        want.append((i, held(i), name, round(score, 4)))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=str)] and all(abs(g[3] - w[3]) < 2e-3 for g, w in zip(got, sorted(want, key=str)))
    frame(spark, [], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert langid.op10_language_id(spark, f"{tmp_path}/empty").count() == 0
    tie = langid.predict(frame(spark, [(1, "ab")], "id long, text string"), (["a", "b"], np.zeros((1 << langid.BITS, 2), np.float32))).first()
    assert (tie.lang_pred, tie.score) == ("a", 0.5)


def test_token_counts_of_an_empty_table_and_clashing_names(spark):
    path = fresh_path(spark, "test-cache")
    assert token_counts.token_counts(frame(spark, []), path).count() == 0
    rows = frame(spark, [(1, "a b", 7, "x"), (1, "a b", 7, "x"), (2, None, 7, "x")], "doc_id long, text string, n_tokens int, content string")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(rows, path).collect())
    assert got[0] == got[1] and got[0][:2] == (1, 3) and got[2] == (2, 0, 0)


def test_pipeline_stages_keep_odd_rows_and_drop_planted_ones(spark):
    import corpus_pipeline

    base = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id", "left_semi").where("length(text) between 800 and 4000").orderBy("doc_id").limit(60).collect()]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    one = rows[0]
    junk = " ".join(f"{w}{s}" for w, s in zip(one[1].split() * 3, itertools.cycle(["###", "$$$", "%%%", "&&&"])))
    rows += [(9001, *one[1:]), (None, *rows[1][1:]), (9002, None, "en", None, 0), (9003, "", None, "web", 0), (9004, "short", "en", "web", 5), (9005, junk, one[2], one[3], len(junk)), one]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.01").cache()
        seen[name] = [r.doc_id for r in docs.collect()]
    good = {r[0] for r in rows[:60]}
    assert not {9002, 9003, 9004, 9005} & set(seen["quality_rules"]) and len(good - set(seen["quality_rules"])) <= 2 and None in seen["quality_rules"]
    assert 9001 not in seen["line_dedup"] or 9001 not in seen["near_dedup"]
    assert seen["near_dedup"].count(one[0]) == 1 and seen["near_dedup"].count(None) == 1
    assert set(seen["source_mix"]) <= set(seen["near_dedup"]) and len(set(seen["source_mix"])) > 40
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.01")
    assert out.where("not round_trip or n_tokens = 0").isEmpty() and out.count() == docs.count()


def test_pipeline_runs_and_reduces(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() > 50, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.where("not round_trip").count() == 0 and out.count() == docs.count()
