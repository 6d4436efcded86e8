"""Operators against brute force: covered sentences, languages, likeness, ranges, ids of special tokens, regions of pages."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factorloom.llm import common, html, langid, leaks, merkle, neardup, packing, rans, secrets, spans, tokens

WIDE = "doc_id long, text string, lang string, source string, hash string, covered int, node long, shard int, uid long, first int, root long, tie long"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", "h", 1, 2, 3, 4, 5, 6, 7) for i, t in rows], WIDE)


def say(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ids -----------------------------------------------------------------------------------------------------------------

SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "<|startoftext|> X<|endoftext|>", "a<|endoftext|>", "<|EndOfText|>", "  <|endoftext|>  <|endoftext|>\n", "plain words", None, ""]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_are_the_librarys(name):
    path = public_tokenizers.path(name)
    plain, ours = Tokenizer.from_file(path), tokens.encoder(path, True)
    for text in SPECIAL:
        assert ours.ids(text).tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_token_files_and_pieces_hold_special_tokens(spark, tmp_path):
    docs = wide(spark, [(i, t) for i, t in enumerate(SPECIAL)] + [(None, SPECIAL[1])] * 40 + [(3, SPECIAL[1])])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    ids = lambda t, end: np.array(plain.encode(t or "", add_special_tokens=False).ids + [end], dtype="<u4")
    rans.write_corpus(docs, f"file://{tmp_path}/t", path, shards=6, block_ids=20)
    got = rans.read_corpus(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i is not None, i or 0, len(ids(t, 0)), zlib.crc32(ids(t, 0))) for i, t in rows)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i or 0))
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    packed = packing.pack(docs, path).collect()
    assert sorted((r["length"], r["ids_crc32"]) for r in packed) == sorted((len(ids(t, 1)), zlib.crc32(ids(t, 1))) for _, t in rows)


def test_ranges_cut_a_hot_key_by_its_ties(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else i, rng.randrange(-(1 << 62), 1 << 62)) for i in range(6000)] + [(7, 5)] * 3000
    df = spark.createDataFrame(rows, "k long, t long")
    r = common.ranges(df, "k", "t", 16)
    keys, ties = np.array([common.LOWEST if k is None else k for k, _ in rows]), np.array([t for _, t in rows])
    at = r.of(keys, ties)
    assert at.max() < r.count and np.bincount(at).max() < 1300
    order = np.lexsort((at, ties, keys))
    assert (np.diff(at[order]) >= 0).all()  # ranges ascend with (key, tie), whichever of equal rows comes first
    assert common.ranges(df.limit(0), "k", "t", 4).count == 1


def test_patterns_carry_sparse_histograms():
    rng = np.random.default_rng(3)
    lengths = np.minimum(4096, rng.lognormal(5.5, 1.2, 3000).astype(int) + 1)
    h = np.bincount(lengths, minlength=4097)
    plan = packing.Plan(h, 4096)
    assert plan.sequences == -(-int(lengths.sum()) // 4096)
    assert plan.fitted_tokens > 0.5 * lengths[lengths < 4096].sum()


# pages ---------------------------------------------------------------------------------------------------------------

BODY = "<p>" + "alpha beta gamma delta " * 12 + "</p>"


def learned():
    page = f"<html><body><nav><ul><li><a href=/x>Home</a></li></ul></nav><div class='promo-x1'>buy this now</div><article><h1>A title</h1>{BODY}<p>More <b>bold</b> words</p></article><footer>us</footer></body></html>"
    total = html.kinds(page)
    for _ in range(20):
        total += html.kinds(page)
    return html.weights_of(total)


@pytest.mark.parametrize("name", ["legal", "side", "popular", "discussion", "reply", "share", "related", "notice", "search", "trending"])
def test_names_that_an_article_may_use_stay(name):
    text = html.main_text(f"<body><nav>Home</nav><article>{BODY}<div class='{name}'><p>Kept words here</p></div>{BODY}</article><footer>us</footer></body>", learned())
    assert text.count("Kept words here") == 1 and "Home" not in text and "us" not in text.split()


def test_the_region_decides_where_the_article_is():
    w = learned()
    for tag in ("article", "div", "section class='z'"):
        page = f"<body><nav><ul><li><a href=/x>Home</a></li></ul></nav><div class='promo-x1'>buy this now</div><{tag}>{BODY}</{tag.split()[0]}><div class='promo-x1'>and that</div><footer>us</footer></body>"
        tokens_ = html.tokenize(page)
        lo, hi = html.best_region([html.score(t, w) for t in tokens_])
        assert "buy" not in "".join(t.text for t in tokens_[lo:hi]) and "that" not in "".join(t.text for t in tokens_[lo:hi])
        assert html.main_text(page, w) == " ".join(["alpha beta gamma delta"] * 12)
    inner = f"<body><div>{BODY}<div class='promo-x1'>learned advert</div>{BODY}</div></body>"
    assert "advert" not in html.main_text(inner, w) and "advert" in html.main_text(inner, {})


def test_weights_are_shares_without_bounds():
    w = learned()
    assert all(v >= 0 for k, v in w.items() if "<" not in k) and all(v <= 0 for k, v in w.items() if "<" in k)
    assert w["p"] > 5 > 0.1 > w["out a li"] and w["out <nav"] < -3 < -0.1 < w["<p"]


def test_long_pages_ties_and_clashing_columns(spark):
    long = f"<article>{BODY * 3000}</article>"
    tie = "<div><p>one two</p></div><nav>x</nav><div><p>one two</p></div>"
    rows = [(1, "u", long, "t", 1), (2, "u", tie, "t", 1), (2, "u", tie, "t", 1), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r["text"] for r in html.extract(pages, html.fit(pages)).collect()}
    assert len(got[1].split()) == 3000 * 48 and got[None] == "" and got[2].startswith("one two")


# fingerprints --------------------------------------------------------------------------------------------------------


def paper(rng, n):
    return "\n".join(say(rng, rng.randint(3, 30)) for _ in range(n))


def test_likeness_minds_order_and_place():
    rng = random.Random(1)
    lines = paper(rng, 40).split("\n")
    print_ = lambda ls: merkle.Tree("\n".join(ls) + "\n").fingerprint()
    whole = print_(lines)
    swapped = print_([*lines[:10], lines[11], lines[10], *lines[12:]])
    assert 0.85 < merkle.likeness(whole, swapped) < 1
    assert merkle.likeness(whole, print_(lines[::-1])) < 0.2
    assert 0.9 < merkle.likeness(whole, print_([*lines[:5], "one more line here", *lines[5:]])) < 1
    assert whole.count("|") == 4 and whole.count("/") == 35
    third = print_([*lines[:27], *paper(rng, 13).split("\n")])
    assert 0.5 < merkle.likeness(whole, third) < 0.85


@settings(max_examples=150, deadline=None)
@given(a=hs.lists(hs.sampled_from("abcd"), max_size=9), b=hs.lists(hs.sampled_from("abcd"), max_size=9))
def test_common_order_is_an_ascending_choice_of_equal_places(a, b):
    pairs = merkle.in_order(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    if sorted(set(a)) == sorted(a) and sorted(set(b)) == sorted(b):  # without repeats it is a longest common subsequence
        best = max((n for n in range(min(len(a), len(b)) + 1) for c in itertools.combinations(range(len(a)), n) if "".join(a[i] for i in c) in {"".join(b[j] for j in d) for d in itertools.combinations(range(len(b)), n)}), default=0)
        assert len(pairs) == best


def test_likeness_follows_the_order_of_rows(spark):
    rng = random.Random(2)
    rows = [(i, paper(rng, 6)) for i in range(30)] + [(None, "no id"), (None, "no id either"), (4, None), (4, None), (40, "")]
    rows += [(None, "hot")] * 30
    docs = wide(spark, rows)
    got = merkle.fingerprints(docs, shards=7).collect()
    assert len(got) == len(rows)
    texts = {r["doc_id"]: r for r in got}
    order = [i for i, _ in sorted((r for r in rows[:30] if r[0] != 4), reverse=True)]
    for i, j in zip(order, order[1:]):
        if j != 4 and i != 5:
            assert texts[i]["near_next"] == merkle.likeness(texts[i]["fingerprint"], texts[j]["fingerprint"])
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    one = texts[20]
    assert one["n_edited_paragraphs"] >= 1 and one["edited_section"] == 0 and one["edited_paragraph"] > 0


# sentences -----------------------------------------------------------------------------------------------------------


def naive_runs(text):
    cuts = spans.sentence_spans(text)
    words = [text[a:b].lower().split() for a, b in cuts]
    found = set()
    for i in range(len(cuts)):
        if len(words[i]) >= spans.LONE_WORDS:
            found.add((i, i))
            continue
        for j in range(i, len(cuts)):
            if j - i + 1 >= spans.RUN_SENTENCES and sum(map(len, words[i : j + 1])) >= spans.RUN_WORDS:
                found.add((i, j))
                break
        for h in range(i, -1, -1):
            if i - h + 1 >= spans.RUN_SENTENCES and sum(map(len, words[h : i + 1])) >= spans.RUN_WORDS:
                found.add((h, i))
                break
    return {(a, z): tuple(w for s in words[a : z + 1] for w in s) for a, z in found}


def naive_covered(rows):
    runs = [naive_runs(t or "") for _, t in rows]
    places = {}
    for d, of in enumerate(runs):
        for (a, z), words in of.items():
            places.setdefault(words, []).append(((rows[d][0] is None, rows[d][0] or 0), a, z, d))
    gone = {d: set() for d in range(len(rows))}
    for found in places.values():
        for _, a, z, d in sorted(found)[1:]:
            gone[d] |= set(range(a, z + 1))
    return [sorted(g) for g in gone.values()]


def test_covered_sentences_equal_brute_force(spark):
    rng = random.Random(6)
    pool = [say(rng, rng.randint(2, 45)).capitalize() + rng.choice([".", "!", "?", ".)"]) for _ in range(12)]
    rows = []
    for i in range(60):
        sentences = [rng.choice(pool) if rng.random() < 0.6 else say(rng, 9) + "." for _ in range(rng.randint(0, 14))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(sentences)))
    rows += [(100, None), (101, ""), (102, " \n "), (103, "x" * 50_000), (104, "." * 50_000), (105, " ".join([pool[0]] * 300))]
    got = {r["doc_id"]: r for r in spans.remove_repeats(wide(spark, rows).repartition(5)).collect()}
    for (i, text), gone in zip(rows, naive_covered(rows)):
        cuts = spans.sentence_spans(text)
        assert got[i]["removed_starts"] == [cuts[k][0] for k in gone], i
        assert got[i]["n_removed"] == len(gone) and got[i]["n_sentences"] == len(cuts)
        assert got[i]["text"] == (text if not gone else "".join(text[a:b] for k, (a, b) in enumerate(cuts) if k not in gone).rstrip())


def test_repeated_rows_of_one_document_are_one(spark):
    rng = random.Random(7)
    text = " ".join(say(rng, 12) + "." for _ in range(8))
    got = spans.remove_repeats(wide(spark, [(1, text)] * 3 + [(None, text)] * 3)).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in got) == [(False, 0)] * 3 + [(True, 8)] * 3


# languages -----------------------------------------------------------------------------------------------------------


def test_numbers_are_no_letters():
    m = langid.Classifier({"en": b"the cat sat on the mat " * 40, "de": b"der hund ist nicht nach hause " * 40})
    assert [m.predict(t)[0] for t in ("½ ²", "① Ⅷ 12", "१२", "_", " \n")] == ["und"] * 5
    assert m.predict("ª the cat sat on the mat")[0] == "en"


def test_languages_equal_plain_compression_of_whole_texts(spark):
    import zstandard

    rng = random.Random(8)
    stems = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["st", "er", "gh", "on"]}
    rows = [(i, " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randint(2, 4))) for _ in range(rng.choice([3, 40, 4000]))), k) for i in range(40) for k in [("aa", "bb")[i % 2]]]
    rows += [(40, rows[0][1], "aa"), (40, rows[0][1], "aa"), (41, None, "bb"), (42, "", "aa"), (43, "7", None), (44, "½", None)]
    d = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, h string, k int, n string")
    model = langid.fit(d)
    assert set(model) == {"aa", "bb"} and max(map(len, model.values())) > 8_000  # whole texts
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(d, model, F.lit(False)).collect()]
    assert len(got) == len(rows)
    want = {}
    for i, text, _ in rows:
        if not any(map(str.isalpha, text or "")):
            want[i] = "und"
            continue
        raw = langid.letters_of(text).encode()
        size = {}
        for k, content in model.items():
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            size[k] = sum(len(c.compress(raw[a : a + langid.WINDOW])) for a in range(0, len(raw), langid.WINDOW))
        if abs(size["aa"] - size["bb"]) > 8:  # one-off and prepared compression differ by a few bytes
            want[i] = min(size, key=size.get)
    assert all(dict(got)[i] == k for i, k in want.items()) and len(want) > 25
    assert langid.identify(d.limit(0), model, F.lit(False)).count() == 0


# leaks, secrets, near-duplicates -------------------------------------------------------------------------------------


def test_repeated_items_long_texts_and_places(spark):
    rng = random.Random(9)
    item = say(rng, 30, 5000)
    bench = spark.createDataFrame([(1, item, 2), (1, item, 3), (2, item, 2), (None, item, 0), (3, None, 0)], "item_id long, text string, doc_id int")
    docs = wide(spark, [(1, f"{say(rng, 60, 5000)} {item} {say(rng, 200, 5000)} {item}"), (2, say(rng, 40_000, 5000) + " " + item), (2, say(rng, 50, 5000)), (None, item), (5, None), (6, "")])
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["n_places"]) for r in leaks.find_leaks(docs, bench).collect())
    assert got == sorted((d, i, 2 if d == 1 else 1) for d in (0, 1, 2) for i in (0, 1, 2))


def test_owner_counts_equal_brute_force(spark):
    rng = random.Random(10)
    values = [f"Zq{rng.randrange(10**15):015d}xK" for _ in range(50)]
    rows = []
    for i in range(120):
        v = rng.choice(values)
        rows.append((i, rng.choice([f"password = {v}", f"see {v} there", f"t={v}.", "nothing here", f"api_key: {v} and secret={values[0]}0"]), f"o{rng.randrange(5)}" if rng.random() < 0.9 else None, f"r{rng.randrange(3)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repository string")
    got = {r["doc_id"]: r for r in secrets.scan(docs, repository_col="repository").collect()}
    owners, keyed = {}, set()
    for _, text, owner, _ in rows:
        for v in values:
            if v in text and f"{v}0" not in text:
                owners.setdefault(v, set()).add(owner)
                if f"= {v}" in text or f": {v}" in text:
                    keyed.add(v)
    for i, text, _, _ in rows:
        held = [v for v in values if v in text and f"{v}0" not in text]
        live = [v for v in held if len(owners[v]) < secrets.EXAMPLE_OWNERS]
        bare = [v for v in live if v in keyed and (f"see {v}" in text or f" t={v}" in f" {text}")]
        base = [v for v in held if f"= {v}" in text or f": {v}" in text]
        more = [f"{values[0]}0"] if "secret=" in text else []
        more_live = more if len({o for _, t, o, _ in rows if "secret=" in t}) < secrets.EXAMPLE_OWNERS else []
        assert got[i]["n_reuse"] == len(bare), text
        assert got[i]["n_live"] == len(bare) + len([v for v in base if v in live]) + len(more_live) and got[i]["n_example"] == len([v for v in base if v not in live]) + len(more) - len(more_live)


def test_intersections_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (6000, 8000, 5, 7000)]
    got = neardup.exact_intersections(sets, np.array([0, 2]), np.array([1, 3]))
    assert got.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in (1, 3)] for i in (0, 2)]


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda: "\n".join(say(rng, 25, 3000).capitalize() + "." for _ in range(4))
    texts = [text() for _ in range(12)] + [None, "", " \n", say(rng, 20_000, 3000) + "."]
    rows = [(i, t, "en", "s", 1, "x", 2, 3) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1, "x", 2, 3), (None, text(), None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    path = f"file://{tmp_path}"
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash string, node long, group int"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, text()), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for empty in (False, True):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        docs = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, path)
            if name != "packing":
                assert out.columns == docs.columns
            out.write.parquet(f"{path}/{name}{empty}")
            docs = spark.read.parquet(f"{path}/{name}{empty}")
        ids = [r["doc_id"] for r in docs.select("doc_id").distinct().collect()]
        assert set(ids) == (set() if empty else {*range(16), None})
