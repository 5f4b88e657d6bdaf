"""The methods themselves, against brute force and known outcomes."""

import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from terrapanel.llm import decontamination, embeddings, language, minhash, pieces, quality, sharding, toxicity, urlrules, wrappers
from terrapanel.llm.common import components, least_labels

VOCABULARY = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]


# Components


def brute_components(edges):
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 100)], [(random.Random(3).randint(0, 80), i) for i in range(90)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])


def test_least_labels():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 40, 25), rng.integers(0, 40, 25)
        want = brute_components(list(zip(a.tolist(), b.tolist())))
        assert least_labels(40, a, b).tolist() == [want.get(i, i) for i in range(40)]


# Suffix arrays, lattices


@given(st.text(alphabet="abc\U0001F600é", min_size=1, max_size=60), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_suffix_array(text, longest):
    points = np.array([ord(c) for c in text], dtype=np.int64)
    got = [text[i : i + longest] for i in pieces.suffix_array(points, longest)]
    assert got == sorted(text[i : i + longest] for i in range(len(text)))


def test_suffix_array_of_long_ties():
    text = "abcabcabcabcabcabcabcabcabcabd" * 40
    points = np.array([ord(c) for c in text], dtype=np.int64)
    got = [text[i : i + 70] for i in pieces.suffix_array(points, 70)]
    assert got == sorted(text[i : i + 70] for i in range(len(text)))


def test_matches_are_all_occurrences():
    model = small_model("bpe")
    text = "abracadabra cab"
    points = np.array([ord(c) for c in text], dtype=np.int64)
    start, length, ids = pieces.match_pieces(points, model)
    want = {(i, len(p), n) for n, p in enumerate(model.pieces) if n for i in range(len(text)) if text.startswith(p, i)}
    assert set(zip(start.tolist(), length.tolist(), ids.tolist())) == want


def small_model(kind):
    own = ["<unk>", "a", "b", "c", "d", "r", "ab", "ra", "abra", "cad", "ca", "▁", "▁a", "▁ab", "bra", "abr"]
    scores = np.array([0.0, -4, -4, -4, -4, -4, -3, -3.5, -5, -6, -3, -2, -4.5, -5, -6.5, -7])
    return pieces.PieceModel(own, scores, kind, 0, np.zeros(256, dtype=np.int64), np.arange(1, len(own)))


@given(st.text(alphabet="abcdr ", min_size=1, max_size=14))
@settings(max_examples=80, deadline=None)
def test_best_path_is_the_best_of_all(text):
    model = small_model("unigram")
    ids, offsets = pieces.Encoder(model).encode([text])
    marked = "▁" + text.replace(" ", "▁")
    best = {0: 0.0}
    for i in range(len(marked)):
        for n, p in enumerate(model.pieces):
            if n and marked.startswith(p, i) and i in best:
                best[i + len(p)] = max(best.get(i + len(p), -1e9), best[i] + model.scores[n])
    assert "".join(model.pieces[i] for i in ids) == marked
    assert model.scores[ids].sum() == pytest.approx(best[len(marked)])


@given(st.lists(st.text(max_size=80), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_encodes_as_the_library_and_round_trips(texts):
    model, library = pieces.load_model(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids, offsets = pieces.Encoder(model).encode(texts)
    for i, text in enumerate(texts):
        own = ids[offsets[i] : offsets[i + 1]].tolist()
        if "▁" not in text:
            assert own == library.encode(text)
    assert pieces.decode_ids(ids, offsets, model) == texts


def test_long_units_encode_as_the_library():
    model, library = pieces.load_model(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text in ["ab" * 4000, " " * 500, "https://x.org/" + "path/to?q=1&" * 300, "\n\n a\n  b  \n", "日本語" * 200]:
        ids, _ = pieces.Encoder(model).encode([text])
        assert ids.tolist() == library.encode(text)


# Near-duplicates


def brute_classes(texts):
    def shingles(t):
        w = t.split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = brute_components(edges)
    return {i: label.get(i, i) for i in texts}


def families(seed, groups, members, words=60, edits=2):
    rng = random.Random(seed)
    texts = {}
    for g in range(groups):
        base = [f"{rng.choice(VOCABULARY)}{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(rng.randint(1, members)):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(words)] = f"new{rng.randint(0, 10**6)}"
            texts[len(texts)] = " ".join(own)
    return texts


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    texts = families(5, 40, 6) | {10_000 + i: t for i, t in enumerate(["a b", "a b c", "a b", "x"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_classes(texts)
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()} == want


def test_large_families_are_met_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 16)
    texts = families(9, 3, 80, words=80, edits=3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()} == brute_classes(texts)


@pytest.mark.parametrize("weights", [(np.ones(60), np.ones(60)), (np.arange(60) % 4 + 1.0, np.arange(60) % 3 + 0.5)])
def test_signatures_agree_as_weighted_jaccard(weights):
    keys = np.arange(90, dtype=np.uint64)
    a, b = keys[:60], keys[30:]
    wa, wb = weights
    agree = []
    for seed in range(60):
        moved = minhash.mix(keys + np.uint64(seed * 1000))
        order_a, order_b = np.argsort(moved[:60]), np.argsort(moved[30:])
        sig = minhash.dart_signatures(np.concatenate([moved[:60][order_a], moved[30:][order_b]]), np.concatenate([wa[order_a], wb[order_b]]), np.array([0, 60, 120]))
        agree.append((sig[0] == sig[1]).mean())
    low = sum(min(wa[i], wb[i - 30]) for i in range(30, 60))
    assert np.mean(agree) == pytest.approx(low / (wa.sum() + wb.sum() - low), abs=0.03)
    assert len(a) == len(b)


def test_count_weights_tell_repetition_apart(spark):
    docs = spark.createDataFrame([(1, "was " * 30), (2, "was " * 300)], "doc_id long, text string")
    assert {r["class_id"] for r in minhash.near_duplicates(docs).collect()} == {1}
    assert {r["class_id"] for r in minhash.near_duplicates(docs, weighting="count").collect()} == {1, 2}


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((25, 64))
    x = np.concatenate([base[i] + 0.12 * rng.standard_normal((12, 64)) for i in range(25)]).astype(np.float32)
    label = np.arange(len(x)) % 2
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    rows = [(int(i), [float(v) for v in x[i]], int(label[i])) for i in range(len(x))]
    got = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    found = sum(r["n_links"] for r in got.values())
    assert 0.98 * near.sum() <= found <= near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in got)
    want = brute_components([(int(a), int(b)) for a, b in zip(*np.nonzero(near))])
    assert sum(got[i]["component_id"] == want.get(i, i) for i in got) >= 0.97 * len(got)


def test_equal_vectors_are_one(spark, monkeypatch):
    """A third of all rows are copies of one vector: as many links, and no more work than one vector."""
    rng = np.random.default_rng(6)
    near = rng.standard_normal(16)
    vectors = [(i, [float(v) for v in near], 1) for i in range(4000)]
    vectors += [(4000 + i, [float(v) for v in near + 0.01 * rng.standard_normal(16)], 1) for i in range(5)]
    vectors += [(5000 + i, [float(v) for v in near * 2.0], 1) for i in range(3)] + [(6000 + i, [float(v) for v in near], 2) for i in range(7)]
    vectors += [(7000 + i, [float(v) for v in rng.standard_normal(16)], 1) for i in range(100)]
    seen = []
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    monkeypatch.setattr(embeddings, "components", lambda edges, a, b: seen.append(edges.count()) or components(edges, a, b))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicate_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i] == (4007, 0) for i in range(4008 - 3) if i < 4005) and all(got[5000 + i] == (4007, 0) for i in range(3))
    assert all(got[6000 + i] == (6, 6000) for i in range(7)) and all(got[7000 + i] == (0, 7000 + i) for i in range(100))
    assert seen[0] < 300


def test_an_id_stands_for_one_vector(spark):
    """Whichever of two vectors under one id is taken, its place in the tables and its cosines agree."""
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sorted((got[2], got[3])) in ([(0, 2), (1, 1)], [(0, 3), (1, 1)]) and got[1] == (1, 1)


# Decontamination, URL rules


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=9), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=30), min_size=1, max_size=4))
@settings(max_examples=6, deadline=None)
def test_decontamination_by_brute_force(spark, items, docs):
    size = 4
    got = decontamination.report(
        spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"), size=size
    )
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect()}
    for d, words in enumerate(docs):
        hit, named = set(), set()
        for n, item in enumerate(items):
            width = min(size, len(item))
            for k in range(len(item) - width + 1 if item else 0):
                for i in range(len(words) - width + 1):
                    if words[i : i + width] == item[k : k + width]:
                        hit |= set(range(i, i + width))
                        named.add(n)
        assert got[d] == (len(words), len(hit), len(named))


@pytest.mark.parametrize("key_bytes", [64 << 20, 100])
def test_decontamination_without_broadcast(spark, monkeypatch, key_bytes):
    """A benchmark larger than what may be sent at once: keys go out slice by slice, windows and hits are shuffled."""
    monkeypatch.setattr("terrapanel.llm.common.BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontamination, "send_if_small", lambda df, size, limit=0: df)
    monkeypatch.setattr(decontamination, "KEY_BYTES", key_bytes)
    docs = spark.createDataFrame([(1, "x y z one two three four x"), (2, "one two"), (3, "five six seven eight nine ten eleven " * 3), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three"), (8, "z"), (9, "seven eight nine ten eleven five six seven eight nine ten eleven")], "item_id long, text string")
    got = sorted((r["doc_id"], r["n_hit"], r["n_items"]) for r in decontamination.report(docs, items).collect())
    assert got == [(1, 4, 2), (2, 0, 0), (3, 0, 0), (3, 19, 1)]
    # Documents meet keys where they are: nothing of theirs is exchanged before it is a candidate.
    windows, lengths = decontamination.item_windows(items)
    rows = docs.select(*decontamination.identity("doc_id", "text"), decontamination.words(docs["text"]).alias("_words")).where("_words is not null")
    found = decontamination._candidates(rows, windows, lengths)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= -(-windows.count() * decontamination.BYTES_OF_KEY // key_bytes) and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_nested_rules_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "SWEEP_ROWS", 7)
    rng = random.Random(4)
    hosts = [".".join(rng.choice(["a", "b", "cc"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["/" + "/".join(rng.choice(["x", "xy", "z"]) for _ in range(rng.randint(0, 3))) for _ in range(60)]
    rules = sorted({(".".join(h.split(".")[-rng.randint(1, 3) :]) + p[: rng.randint(1, 5)]) for h, p in zip(hosts[:25], paths[:25])})
    table = [(rng.choice(["allow", "block"]), r) for r in rules]
    urls = [(i, f"http://{h}{p}") for i, (h, p) in enumerate(zip(hosts, reversed(paths)))]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlrules.judge(spark.createDataFrame(urls, "page_id long, url string"), urlrules.rule_table(spark, table)).collect()}
    for i, url in urls:
        host, slash, path = url[7:].partition("/")
        fits = [(len(r), r.index("/"), r, v) for v, r in table if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and (slash + path).startswith(r[r.index("/") :])]
        want = max(fits)[2:] if fits else (None, "allow")
        assert got[i] == want


# Learners


def test_pairs_raise_the_score_where_single_terms_do_not():
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for _ in range(3000):
        insult, group = rng.random(2) < 0.5
        docs.append(sorted({*(rng.integers(100, 160, 8).tolist()), *([1] if insult else []), *([2] if group else [])}))
        labels.append(float(insult and group))
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    fm = toxicity.train(np.concatenate(docs).astype(np.int64), offsets, np.array(labels))

    def score(*terms):
        return fm.scores(np.array(terms, dtype=np.int64), np.array([0, len(terms)]))[0]

    assert score(1, 2) > 0.8 and score(1) < 0.2 and score(2) < 0.2 and score(101) < 0.2
    pair = fm.factors[fm.slot_of[1]] @ fm.factors[fm.slot_of[2]]
    assert pair > 0.5


def test_estimation_finds_the_labellers_accuracies():
    rng = np.random.default_rng(7)
    truth = rng.random(20_000) < 0.8
    hit, false = [0.9, 0.6, 0.7, 0.5], [0.02, 0.01, 0.05, 0.02]
    vote = np.stack([np.where(rng.random(len(truth)) < np.where(truth, f, h), quality.BAD, quality.NOTHING) for h, f in zip(hit, false)], axis=1)
    patterns, counts = np.unique(quality.pattern_of(vote), return_counts=True)
    model = quality.estimate(quality.votes_of(patterns, 4), counts.astype(float))
    assert model.prior == pytest.approx(0.8, abs=0.02)
    assert np.allclose(model.table[0, :, quality.BAD], hit, atol=0.04) and np.allclose(model.table[1, :, quality.BAD], false, atol=0.02)


# Wrappers


def test_alignment_makes_optional_and_repeated_groups():
    pages = ["<ul><li>a</li></ul><p>x</p>", "<ul><li>a</li><li>b</li><li>c</li></ul><img><h2>t</h2><p>x</p>"]
    wrapper = wrappers.merge_all([wrappers.wrapper_of(wrappers.Page(p).tokens) for p in pages])
    li = (("li", False), ("#", False), ("/li", False))
    assert wrapper == (("ul", False), (("+", li), False), ("/ul", False), ("h2", True), ("#", True), ("/h2", True), ("p", False), ("#", False), ("/p", False))
    assert wrappers.from_text(wrappers.to_text(wrapper)) == wrapper


CHROME = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style></head><body><header class="site"><a href=/>Home</a></header>
<nav><ul><li><a>x</a></li></ul></nav><div id="cookie-notice">We use cookies</div><aside>side</aside><div class="sidebar">more</div>
<main><article><header><h1>Big &lt;title&gt;</h1></header><p>First <em>par</em>a&nbsp;graph<br>goes   on.<div class="advert">buy</div><p>Second &#8212; one
<script>var t = "</p>";</script><form><input name=q><button>Go</button></form><ul><li>item one<li>item two</ul>
<section class="comments"><h3>Comments</h3><p>nice</p></section></article></main><div class="comments"><article class="comment"><p>first!</p></article></div>
<footer><p>&copy; x</p></footer></body></html>"""


def test_only_the_article_is_text(spark):
    pages = [(1, "http://h/1", CHROME), (2, "http://h/2", CHROME.replace("Second", "Other").replace("<aside>side</aside>", ""))]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == "Big <title>\n\nFirst para graph goes on.\n\nSecond — one\n\nitem one\n\nitem two"
    assert got[2].split("\n\n")[2] == "Other — one"


def test_pages_without_an_article_keep_what_is_not_chrome():
    page = "<body><div class=menu>a</div><div class=content><h1>T</h1><p>text</p></div><footer>f</footer></body>"
    content = set(wrappers.content_slots(wrappers.wrapper_of(wrappers.Page(page).tokens)))
    assert wrappers.page_text(page, content) == "T\n\ntext"


@pytest.mark.parametrize("page", ["<", "<p", "a < b", "<!-- open", "<script>x", "</p></div>", "<p>a</b></i>c", "&", "&#xZZ;", "<a href='>'>x</a>"])
def test_broken_markup_is_survived(page):
    parsed = wrappers.Page(page)
    wrappers.page_text(page, set(wrappers.content_slots(wrappers.wrapper_of(parsed.tokens))))


def page_rows(*pages, host="h"):
    return [(i, f"http://{host}/{i}", page) for i, page in enumerate(pages)]


def texts_of(spark, pages):
    return {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_pages_of_mixed_containers_keep_their_paths():
    rng = random.Random(7)

    def piece(depth):
        name = rng.choice(["article", "div", "section", "p", "h1"])
        inside = "".join(piece(depth - 1) for _ in range(rng.randint(0, 4))) if depth and name not in ("p", "h1") else ""
        return f"<{name}>{rng.choice(['', 'x', 'y'])}{inside}</{name}>"

    for hosts in range(150):
        pages = [wrappers.Page("".join(piece(4) for _ in range(rng.randint(1, 3)))) for _ in range(5)]
        wrapper = wrappers.merge_all([wrappers.wrapper_of(p.tokens) for p in pages])
        assert wrappers.slots(wrapper) == {path for p in pages for path, _ in p.blocks}


def test_texts_of_mixed_containers_stay(spark):
    got = texts_of(spark, page_rows("<article><h1>t</h1><p>x</p><p>y</p></article>", "<div><h1>t</h1></div><article><h1>u</h1></article>") + [(7, "http://g/1", "<article><p>x</p></article>"), (8, "http://g/2", "<article><div><p>y</p></div></article>")])
    assert got == {0: "t\n\nx\n\ny", 1: "u", 7: "x", 8: "y"}


def test_every_page_has_its_own_zone(spark):
    plain, teaser = "<body><div><h1>t</h1><p>x</p></div></body>", "<body><article><p>card</p></article><p>rest</p></body>"
    got = texts_of(spark, page_rows(plain, teaser, "<body><main><p>m</p></main><p>o</p></body>") + [(7, None, plain), (8, "nowhere", "<article>a</article>")])
    assert got == {0: "t\n\nx", 1: "card", 2: "m", 7: "t\n\nx", 8: "a"}


@pytest.mark.parametrize("attributes", [
    "class='content no-sidebar'", "class='layout with-sidebar'", "class=overflow-hidden", "class='ad-free'", "id='search-results'", "data-id='menu'", "data-testid='comment-list'",
    "data-role=banner", "title='class=comments'", "class='sidebar'", "class='post sponsored'", "class=hidden",
])
@pytest.mark.parametrize("inner", ["<article><h1>t</h1><p>the text of it</p></article>", "<h1>t</h1><p>the text of it</p>"])
def test_marks_around_the_whole_text_are_not_believed(spark, attributes, inner):
    page = f"<body><nav>menu</nav><div {attributes}>{inner}</div><p>end</p></body>"
    content = set(wrappers.content_slots(wrappers.wrapper_of(wrappers.Page(page).tokens)))
    assert wrappers.page_text(page, content).startswith("t\n\nthe text of it")


def test_marked_elements_beside_the_text_go():
    page = "<body><div class=sidebar><article>card</article></div><article><p>text<div class='ad-slot'>buy</div><div class=comments>" + "<p>nice</p>" * 50 + "</div></article></body>"
    content = set(wrappers.content_slots(wrappers.wrapper_of(wrappers.Page(page).tokens)))
    assert wrappers.page_text(page, content) == "text"
    short = "<body><div class=widget><article>a</article></div><p>longer text outside</p><div class=menu>m</div></body>"
    assert wrappers.page_text(short, set(wrappers.content_slots(wrappers.wrapper_of(wrappers.Page(short).tokens)))) == "a\n\nlonger text outside"


@pytest.mark.parametrize("swallower", ["<svg viewBox='0 0 1 1'/>", "<svg/>", "<math />", "<select-box>", "<title-bar>b</title-bar>", "<svg><path d='x>y'/></svg>", "<svg><svg/>t</svg>"])
def test_foreign_and_custom_elements_end(swallower):
    page = f"<article>{swallower}<p>x</p></article>"
    text = wrappers.page_text(page, set(wrappers.content_slots(wrappers.wrapper_of(wrappers.Page(page).tokens))))
    assert text.split("\n\n")[-1] == "x" and "t" not in text


def test_template_texts_are_told_from_data(spark):
    """Slots with one text on all pages of a host are its template, if its pages differ; nothing marks them otherwise."""
    def page(body):
        return f"<body><div>Welcome to our site</div><div><h1>{body} title</h1><p>{body} text</p></div><div>All rights reserved 2020</div></body>"

    got = texts_of(spark, page_rows(page("one"), page("two")) + [(9, "http://alone/1", page("three")), (10, "http://twice/1", page("four")), (11, "http://twice/2", page("four"))])
    assert got[0] == "one title\n\none text" and got[1] == "two title\n\ntwo text"
    # One page, or copies of one, can't tell.
    assert all(got[i].startswith("Welcome to our site\n\n") and got[i].endswith("2020") for i in (9, 10, 11))
    # Without what the host's pages say together, the template stays: the wrapper decides.
    content = set(wrappers.content_slots(wrappers.wrapper_of(wrappers.Page(page("one")).tokens)))
    assert wrappers.page_text(page("one"), content) != got[0]


def test_template_texts_are_found_however_pages_are_dealt(spark, monkeypatch):
    """Many tasks, slices and few hosts at once give what one task gives."""
    def page(host, n):
        return f"<body><p>line of {host}</p><p>{host} {n}</p><ul><li>a {n}</li><li>b</li></ul></body>"

    rows = [(100 * h + n, f"http://h{h}/{n}", page(h, n)) for h in range(6) for n in range(8)]
    want = {100 * h + n: f"{h} {n}\n\na {n}" for h in range(6) for n in range(8)}
    assert texts_of(spark, rows) == want
    monkeypatch.setattr(wrappers, "HOSTS_AT_ONCE", 1)
    monkeypatch.setattr(wrappers, "SLICES", 2)
    frame = spark.createDataFrame(rows[::-1], "page_id long, url string, html string").repartition(9, "page_id")
    assert {r["page_id"]: r["text"] for r in wrappers.extract(frame).collect()} == want
    # An article's text is never template.
    same = [(i, f"http://s/{i}", f"<article><p>the same</p><p>{i}</p></article>") for i in range(3)]
    assert texts_of(spark, same) == {i: f"the same\n\n{i}" for i in range(3)}


@pytest.mark.parametrize("page, text", [
    ("<body><form id=aspnetForm><div><h1>t</h1><p>the text of it</p></div></form></body>", "t\n\nthe text of it"),
    ("<body><form id=aspnetForm><nav>menu</nav><article><p>the text of it</p></article></form></body>", "the text of it"),
    ("<body><div class='header-fixed'><main><p>the text of it</p></main></div></body>", "the text of it"),
    ("<body><div class='site header-sticky'><article><p>the text of it</p></article></div></body>", "the text of it"),
    ("<body><article class='post comment-count-5'><p>the text of it</p></article></body>", "the text of it"),
    ("<body><main><article><p>teaser</p></article><p>" + "main words " * 27 + "end</p></main></body>", "teaser\n\n" + "main words " * 27 + "end"),
    ("<body><article><section id=search><h2>How to search</h2><p>a</p></section><div class='related-work'>b</div><div class='skip-lists'>c</div></article></body>", "How to search\n\na\n\nb\n\nc"),
    ("<body><article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><object>an object</object></article></body>", "So x=2 holds.\n\nan object"),
    ("<body><header><h1>site</h1></header><form>mail <input></form><div><p>some text of the page that is long</p></div></body>", "some text of the page that is long"),
    ("<body><article><p>long enough a text</p><div class='related-posts'>x</div><div class='share-buttons'>y</div><div id=comments>z</div><form>w</form></article></body>", "long enough a text"),
    ("<body><aside><article>card</article></aside><footer><article>card</article></footer><article><p>text</p></article></body>", "text"),
])
def test_no_article_is_lost_to_what_is_around_it(page, text):
    content = set(wrappers.content_slots(wrappers.wrapper_of(wrappers.Page(page).tokens)))
    assert wrappers.page_text(page, content) == text


def test_classes_are_dropped_by_text_not_by_id(spark):
    def words(tag, changed=0):
        return " ".join(f"{tag}{i}" if i >= changed else f"{tag}new{i}" for i in range(60))

    one, two, three, four = words("a"), words("b"), words("c"), words("d")
    # Id 5 has the kept text of one class and a near copy in another; id 6 two texts without a duplicate, one of them twice.
    rows = [(5, one), (9, words("a", 2)), (1, two), (5, words("b", 2)), (6, three), (6, four), (6, four), (None, words("b", 1)), (None, "e " + words("e")), (None, words("e")), (None, ""), (None, ""), (7, "!"), (7, "!"), (7, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _id string")

    def left(**how):
        got = minhash.drop_near_duplicates(docs, **how)
        assert got.columns == docs.columns
        return sorted(((r["doc_id"] or -1, r["text"]) for r in got.collect()))

    named = [(5, one), (1, two), (6, three), (6, four), (7, "!"), (7, "")]
    assert left() == sorted(named + [(i or -1, t) for i, t in rows if i is None])
    got = left(unnamed=True)
    assert [x for x in got if x[0] > 0] == sorted(named)
    unnamed = [t for i, t in got if i < 0]
    assert unnamed.count("") == 2 and len(unnamed) == 3 and max(unnamed, key=len).endswith(words("e"))


@pytest.mark.parametrize("same", ["null as id", "5"])
def test_samples_are_bounded_whatever_the_ids(spark, same):
    from terrapanel.llm.linear import sample_of_distinct

    name = None if same == "null as id" else int(same)
    rows = spark.createDataFrame([(name if i % 3 == 0 else i, f"text {i}") for i in range(6000)] + [(name, "again")] * 3000, "id long, text string")
    chosen = sample_of_distinct(rows, ["id", "text"], 600).collect()
    assert 450 < len(chosen) < 750 and len({tuple(r) for r in chosen}) == len(chosen)
    assert 0.2 < sum(r["id"] == name for r in chosen) / len(chosen) < 0.47
    assert sample_of_distinct(rows, ["id", "text"], 10_000).count() == 6001


def test_toxicity_learns_from_a_bounded_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda terms, offsets, labels: seen.append(len(labels)))
    docs = spark.createDataFrame([(1 if i % 3 == 0 else i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"), max_docs=300)
    toxicity.fit(docs, docs.where("doc_id = 1").selectExpr("doc_id", "1 as toxic"), max_docs=300)
    assert seen[0] <= 400 and 200 < seen[1] < 400


# Language identification


def test_long_texts_are_read_by_pieces():
    text = "Être ou  ne pas être, là est la question!  12 Ähren  日本語 x" * 3
    buckets, _, letters = language.gram_buckets([text])
    whole = np.bincount(buckets, minlength=language.BUCKETS)
    for step in (1, 2, 3, 7, 50, 10_000):
        counts, n = language.long_gram_counts(text, step)
        assert (counts == whole).all() and n == letters[0]
    counts, n = language.long_gram_counts("")
    assert not counts.any() and n == 0


def counted_model(texts):
    """Plain counts of n-grams by language, as dictionaries."""
    grams, docs = {}, {}
    for text, lang in texts:
        docs[lang] = docs.get(lang, 0) + 1
        for b in language.gram_buckets([text])[0].tolist():
            grams.setdefault(lang, {}).setdefault(b, 0)
            grams[lang][b] += 1
    return grams, docs


@pytest.mark.parametrize("ids", ["none", "one", "own"])
def test_language_by_plain_counts(spark, monkeypatch, ids):
    """Log probabilities and predictions from dictionaries; ids may be missing or all the same."""
    monkeypatch.setattr(language, "_CHARS", 60)
    dice = random.Random(3)
    words = {"en": ["the", "thing", "which", "ought"], "de": ["der", "straße", "schön", "auch"], "fr": ["le", "été", "beauté", "aux"]}
    texts = [(" ".join(dice.choice(words[lang]) for _ in range(dice.randint(1, 40))), lang) for lang in words for _ in range(60)]
    rows = [({"none": None, "one": 3, "own": i}[ids], t, lang) for i, (t, lang) in enumerate(texts)] + [(1, None, "en"), (2, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    grams, count = counted_model(texts)
    assert model.languages == ["de", "en", "fr"]
    for c, lang in enumerate(model.languages):
        total = sum(grams[lang].values()) + language.SMOOTHING * language.BUCKETS
        assert model.log_prior[c] == pytest.approx(np.log(count[lang] / len(texts)))
        for b in list(grams[lang])[:50]:
            assert model.log_prob[b, c] == pytest.approx(np.log((grams[lang][b] + language.SMOOTHING) / total))
    got = language.predict(docs.where("text is not null"), model).collect()
    named = language.predict(docs.where("text is not null"), model).join(docs, "doc_id") if ids == "own" else None
    assert len(got) == len(texts) + 1 and {r["lang_pred"] for r in got} == {"de", "en", "fr"}
    if named is not None:
        assert named.where("lang is not null and lang <> lang_pred").count() <= 2
    report = language.report(docs).collect()
    assert any(r["lang_pred"] != "und" for r in report)


# Scorers against plain forms


def test_factorization_machine_is_a_sum_over_pairs(spark):
    """Scores of whole texts, term by term and pair by pair."""
    rng = np.random.default_rng(11)
    words = ["red", "green", "bluebird", "yellowish", "x"]
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(60)] + [(60, None), (61, ""), (62, "unseen words"), (63, "red " * 30_000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    keys = {r["doc_id"]: r["k"] for r in frame.select("doc_id", toxicity.term_keys(frame["text"]).alias("k")).collect()}
    known = sorted({k & (toxicity.TERMS - 1) for i in range(40) for k in keys[i]})
    slot_of = np.full(toxicity.TERMS, -1, dtype=np.int32)
    slot_of[known] = np.arange(len(known))
    model = toxicity.FactorizationMachine(-0.7, rng.normal(size=len(known)), rng.normal(size=(len(known), 5)), slot_of)
    got = {r["doc_id"]: r["score"] for r in toxicity.predict(frame, model).collect()}
    for i, _ in texts:
        slots = sorted({int(slot_of[k & (toxicity.TERMS - 1)]) for k in keys[i]} - {-1})
        logit = model.bias + sum(model.weights[s] for s in slots)
        logit += sum(float(model.factors[s] @ model.factors[t]) for n, s in enumerate(slots) for t in slots[:n])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-12)


def test_label_model_by_plain_expectation_maximisation():
    rng = np.random.default_rng(12)
    votes = np.unique(rng.integers(0, 3, (60, 4)), axis=0)
    counts = rng.integers(1, 50, len(votes)).astype(float)
    start = {1: [0.02, 0.38, 0.60], 0: [0.40, 0.10, 0.50]}
    table = {c: [list(start[c]) for _ in range(4)] for c in (0, 1)}
    prior = 0.8
    for _ in range(300):
        good = []
        for row in votes:
            a, b = prior, 1 - prior
            for k, v in enumerate(row):
                a, b = a * table[1][k][v], b * table[0][k][v]
            good.append(a / (a + b))
        for c in (0, 1):
            for k in range(4):
                sums = [4.0 * start[c][v] + sum(n * (g if c else 1 - g) for n, g, row in zip(counts, good, votes) if row[k] == v) for v in range(3)]
                table[c][k] = [x / sum(sums) for x in sums]
        prior = (sum(n * g for n, g in zip(counts, good)) + 3.2) / (counts.sum() + 4.0)
    model = quality.estimate(votes, counts, rounds=300)
    assert model.prior == pytest.approx(prior, abs=1e-6)
    np.testing.assert_allclose(model.table, [table[0], table[1]], atol=1e-5)


def plain_features(text):
    """Shares of runs of three character classes, of token shapes, and of repeated tokens, under their hashed names."""
    def name(value):
        return int(quality.mix(np.array([value], dtype=np.uint64))[0] % np.uint64(quality.FEATURES))

    kinds = [int(quality.class_table()[ord(c)]) for c in text + "\n"]
    groups = [[name(a * 256 + b * 16 + c + (1 << 20)) for a, b, c in zip(kinds, kinds[1:], kinds[2:])], [], []]
    tokens = [[]]
    for c, k in zip(text + "\n", kinds):
        if k in (quality._BLANK, quality._BREAK):
            tokens.append([])
        else:
            tokens[-1].append((c, k))
    before = None
    for token in [t for t in tokens if t]:
        again = token == before
        symbols = sum(k == quality._SYMBOL for _, k in token)
        shape = min(len(token), 15)
        for part in (token[0][1], token[-1][1], min(symbols, 3), int(again)):
            shape = shape * 16 + part
        groups[1].append(name(shape + (1 << 40)))
        groups[2].append(name((1 if again else 2) + (1 << 50)))
        before = token
    out = []
    for group in groups:
        out += [(f, (group.count(f) / len(group)) ** 0.5) for f in set(group)]
    return sorted(out)


@pytest.mark.parametrize("text", ["Hello, hello world. 12 #tags!!", "a a a b", "", "   ", "Ünïcode ΣΑΣ\n日本 x%% ##"])
def test_quality_features_by_plain_counts(text):
    feature, value, offsets = quality.features([text, "other text"])
    got = sorted(zip(feature[: offsets[1]].tolist(), value[: offsets[1]].tolist()))
    want = plain_features(text)
    assert [f for f, _ in got] == [f for f, _ in want]
    np.testing.assert_allclose([v for _, v in got], [v for _, v in want], atol=1e-12)


# Sharding


def test_shards_do_not_depend_on_how_a_table_is_split(spark):
    """Equal rows spread over buckets; ids, texts and shards are the same for any split and any setting."""
    rows = [(None, "one and the same")] * 400 + [(i, f"text {i % 50}") for i in range(300)] + [(7, "again")] * 50 + [(8, None)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    seen = set()
    for parts, width in ((1, 8), (3, 8), (17, 3)):
        spark.conf.set("spark.sql.shuffle.partitions", str(width))
        try:
            dealt = sharding.shuffle_into_shards(frame.repartition(parts), shards=5, bucket_bytes=500)
            seen.add(tuple(sorted(((str(r["doc_id"]), str(r["text"]), r["_shard"], r["_slot"]) for r in dealt.collect()))))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(seen) == 1
    shards = [r[2] for r in next(iter(seen)) if r[1] == "one and the same"]
    assert min(shards.count(k) for k in range(5)) > 50
