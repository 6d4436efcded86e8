"""Operators' inner parts against brute force, without Spark."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from tokenizers import Tokenizer

from factorloom.llm import hashing, html, langid, leaks, merkle, neardup, packing, quality, rans, secrets, spans, tokens

TEXT = hs.text(alphabet=hs.sampled_from(list("ab cdE.,!?'\n\t 19é日́İ_-|")), max_size=80)
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    return tokens.encoder(path), plain


@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_segments_encode_like_whole_texts(pair, text):
    ours, plain = pair
    assert ours.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b", "a \n b", "x\n\ny z\n", "don't we'll IT'S", "<|endoftext|> a", "a\x1cb \x85 c", "WORD!! it%%% &&& |", "tab\tand  more ", "  x"])
def test_odd_texts_encode_like_whole_texts(pair, text):
    ours, plain = pair
    assert ours.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 5000, 300_000])
def test_blocks_round_trip_whole_and_from_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 50_000).astype(np.uint16)
    token, count = np.unique(ids, return_counts=True)
    table = rans.FrequencyTable(token.astype(np.int64), rans.FrequencyTable.scale(count.astype(float)))
    block = rans.encode_block(ids, table)
    assert (rans.decode_block(block, table) == ids).all()
    for step, _, _ in rans.checkpoints(block):
        assert (rans.decode_steps(block, table, step) == ids[step * block["lanes"] :]).all()
    if n > 1000:
        assert len(block["words"]) < 2 * n
        with pytest.raises(ValueError):
            rans.decode_block(block | {"crc32": block["crc32"] ^ 1}, table)


def test_frequencies_sum_and_keep_every_token():
    f = rans.FrequencyTable.scale(np.array([1e12, 1, 1, 5]))
    assert f.sum() == 1 << rans.PRECISION and f.min() >= 1


def test_plans_pack_everything_without_gaps():
    rng = np.random.default_rng(1)
    for cap, lengths in ((100, rng.integers(1, 101, 3000)), (64, np.full(50, 33)), (10, np.array([10, 10, 5])), (50, rng.integers(1, 4, 500)), (20, np.array([], dtype=int))):
        h = np.bincount(lengths, minlength=cap + 1)
        plan = packing.Plan(h, cap)
        order = np.sort(lengths)
        rank = np.arange(len(order)) - np.searchsorted(order, order)
        seq, off = plan.find(order, rank)
        for s in np.unique(seq):
            o, ln = off[seq == s], order[seq == s]
            k = np.argsort(o)
            assert o[k].tolist() == [0, *np.cumsum(ln[k])[:-1]] and ln.sum() <= cap
        best = -(-int(lengths.sum()) // cap)
        assert plan.sequences <= max(best * 1.03 + 1, (lengths > cap // 2).sum())


def test_patterns_fit_and_the_fit_explains_the_histogram():
    h = np.bincount(np.repeat([30, 70, 50], [40, 40, 60]), minlength=101)
    patterns = packing.enumerate_patterns(np.flatnonzero(h), 100)
    assert all(sum(p) <= 100 for p in patterns) and (70, 30) in patterns and (50, 50) in patterns
    x = packing.fit_counts(patterns, h, 100)
    assert (x >= 0).all()
    made = np.zeros(101)
    for p, t in zip(patterns, x):
        for length in p:
            made[length] += t
    assert np.abs(made - h).max() < 5


@settings(max_examples=100, deadline=None)
@given(text=TEXT)
def test_word_hashes_are_those_of_the_words(text):
    raw = hashing.lowered(text)
    h, a, b = hashing.words(raw)
    want = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    assert [raw[i:j] for i, j in zip(a, b)] == want
    seen = {}
    for w, x in zip(want, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    n = len(want)
    grams = {tuple(want[i : i + 3]) for i in range(n - 2)} if n >= 3 else {tuple(want)} if n else set()
    assert len(hashing.shingles(text, 3)) == len(grams)


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 2000, dtype=np.uint64)
    for j in (0.95, 0.9, 0.85):
        k = int(round(2000 * (1 - j) / (1 + j)))
        other = np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 62, k, dtype=np.uint64)]))
        a, b = (np.frombuffer(neardup.odd_sketch(neardup.signature(np.unique(x), 128)), dtype=np.uint64) for x in (base, other))
        apart = int(np.bitwise_count(a ^ b).sum())
        assert abs(float(neardup.estimated_similarity(apart)) - j) < 0.12
        assert apart <= neardup.most_apart(0.85)


def test_forest_links_what_brute_force_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 120, dtype=np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        k = rng.integers(0, 14)
        s[rng.choice(120, k, replace=False)] = rng.integers(0, 1 << 62, k, dtype=np.uint64)
        sets.append(np.unique(s))
    sketches = np.frombuffer(b"".join(neardup.odd_sketch(neardup.signature(s, 128)) for s in sets), dtype=np.uint64).reshape(60, -1)

    def roots(links):
        t = neardup._Sets(60)
        for i, j in links:
            t.join(i, j)
        return [t.root(i) for i in range(60)]

    brute = [(i, j) for i in range(60) for j in range(i) if 100 * len(n := np.intersect1d(sets[i], sets[j])) >= 85 * (len(sets[i]) + len(sets[j]) - len(n))]
    whole = neardup.forest(sets, sketches, np.zeros(60), True, 85, 100)
    assert roots(whole) == roots(brute) and len(whole) < 60
    half = np.arange(60) >= 30
    parts = [(i, j) for m in (half, ~half) for i, j in ((np.flatnonzero(m)[a], np.flatnonzero(m)[b]) for a, b in neardup.forest([sets[i] for i in np.flatnonzero(m)], sketches[m], np.zeros(30), True, 85, 100))]
    parts += neardup.forest(sets, sketches, half.astype(int), False, 85, 100)
    assert roots(parts) == roots(brute)


BASE = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
]
PIECES = ["password", "Secret", "TOKEN", "api_key", "apikey", "ſecret", ": ", " = ", "'", '"', "abc12345xyz", "short", "AKIA", "ABCDEFGHIJKL1234", "0123456789abcdef" * 2, "deadbeef", " ", "\n", "é"]


@settings(max_examples=300, deadline=None)
@given(parts=hs.lists(hs.sampled_from(PIECES), max_size=12))
def test_base_spans_are_the_leftmost_matches(parts):
    text = "".join(parts)
    want = sorted((m.start(), i, m.end()) for i, (_, p, g, least) in enumerate(BASE) for m in p.finditer(text) if len(m[g]) >= least)
    assert [(a, k, b) for k, a, b, _ in secrets.find(text) if k < 3] == want


def test_masking_joins_overlaps():
    assert secrets._without("abcdefgh", [1, 6], [4, 7], "#") == "a#ef#h"
    assert secrets._without("abcdefgh", [1, 2, 6], [4, 5, 7], "#") == "a#f#h"
    assert secrets._without("abc", [0], [3], "#") == "#"


@settings(max_examples=200, deadline=None)
@given(text=TEXT)
def test_leaves_and_sentences_are_the_whole_text(text):
    assert "".join(x for p in text.splitlines(keepends=True) for x in merkle.leaves(p)) == text
    assert "".join(text[a:b] for a, b in spans.sentence_spans(text)) == text


def test_fingerprints_tell_equality_and_place():
    text = "\n".join(f"line {i} has some words in it that differ {i * i}" for i in range(40))
    other = text.replace("line 25 has", "line 25 had")
    a, b = merkle.Tree(text), merkle.Tree(other)
    assert a.fingerprint() == merkle.Tree(text).fingerprint() != b.fingerprint()
    assert merkle.differing(a, b) == [(3, 1)]
    assert 0.95 < merkle.likeness(a.fingerprint(), b.fingerprint()) < 1 == merkle.likeness(a.fingerprint(), a.fingerprint())
    assert merkle.likeness(a.fingerprint(), merkle.Tree("nothing at all alike here").fingerprint()) == 0
    assert merkle.likeness(merkle.Tree("").fingerprint(), merkle.Tree(None).fingerprint()) == 1


def brute_alignment(a, b):
    best, h = 0, np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


@settings(max_examples=100, deadline=None)
@given(a=hs.lists(hs.integers(0, 4), min_size=1, max_size=12), b=hs.lists(hs.integers(0, 4), min_size=1, max_size=20))
def test_alignment_scores_are_exact(a, b):
    a, b = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
    score, start, end = leaks.align(a, b)
    assert score == brute_alignment(a, b)
    if score:
        assert brute_alignment(a, b[start:end]) == score


def test_edited_copies_leak_and_other_texts_do_not():
    rng = random.Random(0)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    test = [(i, " ".join(say(40))) for i in range(20)]
    items = leaks.Items(test)
    items.keep_rare(np.ones(len(items.distinct), dtype=int))
    copy = test[7][1].split()
    for k in (4, 15, 22, 31):
        copy[k] = "edited"
    found = leaks.leaks_of(leaks.words_of(" ".join(say(300) + copy + say(200))), items)
    assert [f[0] for f in found] == [7] and 295 <= found[0][3] <= 305
    assert not leaks.leaks_of(leaks.words_of(" ".join(say(500))), items)
    assert not leaks.leaks_of(leaks.words_of(""), items)


PAGE = """<html><head><title>x &amp; y</title><style>p{}</style></head><body><header><div>Site name</div></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies a lot here</div><{tag}><h1>The  title</h1><p>First <b>bold</b>ly &lt;said&gt; words of a story.<br>Next line<p>Second paragraph that is open
<aside>Related things</aside><form><label>Mail</label></form><p>Last.</p></{tag}><div id="comments"><p>Some reader said this and much more</p></div><script>var t="</p>";</script><footer>&copy; Us</footer></body></html>"""
MAIN = "The title First boldly <said> words of a story. Next line Second paragraph that is open Last."


STORY = "<h1>Title</h1><p>" + "one two three four five six seven eight " * 4 + "</p>"
WRAPPERS = ['style="overflow: hidden"', 'class="overflow-hidden"', 'aria-hidden="false"', 'data-hidden="no"', 'class="layout has-sidebar"', 'class="sidebar"', 'id="form" class="menu layout"', 'hidden', 'aria-label="How to form a legal person"']


@pytest.mark.parametrize("attributes", WRAPPERS)
def test_a_wrapper_never_puts_the_article_out(attributes):
    want = " ".join(STORY.replace("<p>", " <p>").replace("<h1>", "").replace("</h1>", "").replace("<p>", "").replace("</p>", "").split())
    page = f"<html><body><nav>Home</nav><div {attributes}><main><div class='sidebar'><article>{STORY}</article><aside><article>Teaser text</article></aside></div></main></div><footer>us</footer></body></html>"
    assert html.main_text(page, {}) == want
    if attributes not in ("hidden", 'class="sidebar"', 'id="form" class="menu layout"'):
        assert html.main_text(f"<body><nav>Home</nav><div {attributes}>{STORY}</div></body>", {}) == want


@pytest.mark.parametrize("attributes", ["hidden", "aria-hidden=true", 'style="color: red; display: none"', 'class="sidebar"', 'class="cookie-notice x"', 'id="comments"', 'class="ad-300x250"', 'role="search"', 'aria-label="Main navigation"'])
def test_boilerplate_in_an_article_stays_out(attributes):
    page = f"<body><article>{STORY}<div {attributes}>left <article>out</article></div>{STORY}</article><div class='related'><article>Some teaser</article></div></body>"
    text = html.main_text(page, {})
    assert text.count("Title") == 2 and "left" not in text and "out" not in text and "teaser" not in text


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post"'])
def test_main_text_leaves_boilerplate_out(tag):
    weights = html.weights_of(html.kinds(PAGE.replace("{tag}", "article")))
    page = PAGE.replace("</{tag}>", f"</{tag.split()[0]}>").replace("{tag}", tag)
    assert html.main_text(page, weights) == MAIN
    assert html.main_text(page, {}).startswith(MAIN[: -len(' Last.')])  # without labels, a last word after a form is not worth its way


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>", "&amp", "</div></p>", "<nav>only menu</nav>", "plain words"])
def test_broken_pages_do_not_crash(page):
    assert html.main_text(page, {}) in ("", "&", "plain words")


@settings(max_examples=100, deadline=None)
@given(scores=hs.lists(hs.integers(-5, 5), max_size=12))
def test_best_region_is_the_best_contiguous_sum(scores):
    lo, hi = html.best_region([float(s) for s in scores])
    best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert sum(scores[lo:hi]) == best


def brute_marginals(unary, stay):
    n = len(unary)
    good, total = np.zeros(n), 0.0
    for k in range(1 << n):
        y = [(k >> i) & 1 for i in range(n)]
        w = np.exp(sum(u for u, v in zip(unary, y) if v) + sum(stay[a] for a, b in zip(y, y[1:]) if a == b))
        total += w
        good += w * np.array(y)
    return good / total


def test_marginals_are_exact():
    rng = np.random.default_rng(5)
    own = rng.normal(size=(6, quality.OWN)).astype(np.float32)
    m = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), rng.normal(0, 0.3, quality.FEATURES), np.array([0.7, 0.4]), 1, 0, 0.5)
    unary = quality.with_neighbours(own) @ m.weights
    assert np.allclose(m.marginals(own), brute_marginals(unary, m.stay))


def test_gradient_is_that_of_the_objective():
    rng = np.random.default_rng(6)
    lengths = np.array([4, 3, 1])
    x, label, weight = rng.normal(size=(8, 5)), np.array([1, 0, 1]), np.array([1.0, 0.5, 2.0])
    theta = rng.normal(0, 0.5, 7)
    f = lambda t: quality._objective(x, lengths, label, weight, t)
    numeric = [(f(theta + 1e-6 * e)[0] - f(theta - 1e-6 * e)[0]) / 2e-6 for e in np.eye(7)]
    assert np.allclose(f(theta)[1], numeric, atol=1e-5)


def test_classifier_separates_junk_lines_and_scores_empty_texts():
    rng = random.Random(1)
    clean = lambda: "\n".join(" ".join(rng.choice(["the", "river", "went", "slowly", "home", "again"]) for _ in range(12)).capitalize() + "." for _ in range(5))
    junk = lambda: "\n".join(" | ".join(rng.choice(["AAA!!", "BUY", "%%%", "###"]) for _ in range(12)) for _ in range(5))
    sample = [(1, *quality.own_features(clean())) for _ in range(40)] + [(0, *quality.own_features(junk())) for _ in range(40)]
    m = quality.train(sample, (0.5, 0.5))
    assert m.score(clean())[0] > 0.9 > 0.1 > m.score(junk())[0]
    assert 0 <= m.score(None)[0] == m.score("")[0] <= 1
    assert quality.train([], (0.0, 0.0)).score("x")[0] == 1.0


def test_language_of_short_and_odd_texts():
    m = langid.Classifier({"en": b"the cat sat on the mat and then the dog went home with the others " * 30, "de": "und der hund ist nicht nach hause gegangen weil die katze dort war ".encode() * 30})
    assert m.predict("then the dog went home and the cat sat on the mat")[0] == "en"
    assert m.predict("weil die katze nicht nach hause gegangen ist")[0] == "de"
    assert m.predict(None) == m.predict("") == m.predict("12 !!") == ("und", 0.0, 0.0)
    assert langid.Classifier({}).predict("words")[0] == "und"


def test_runs_cover_a_repeated_passage():
    passage = "One two three four five. Six seven eight nine ten eleven. Twelve thirteen fourteen. Fifteen sixteen seventeen eighteen. Nineteen."
    for before, after in (("Aa bb. ", " Cc dd. Ee."), ("", ""), ("X. Y. Z. ", " Q.")):
        a, b = (spans.sentence_runs(p + passage + q) for p, q in ((before, after), ("Other words here. ", " More words follow. And so on.")))
        shared = set(a[3].tolist()) & set(b[3].tolist())
        covered = {i for f, z, h in zip(*a[1:]) if h in shared for i in range(f, z + 1)}
        first = len(spans.sentence_spans(before + "P.")) - 1
        assert covered == set(range(first, first + 5))


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442") and zlib.crc32(b"") == 0
