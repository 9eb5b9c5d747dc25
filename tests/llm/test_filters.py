"""Classifier, language identification, quality rules, decontamination, token counts, HTML extraction."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, frame, prose
from veilframe.llm import decontam, html, langid, quality, rules, tokencount
from veilframe.llm.common import crc_fold, table, tokenizer

# --- quality classifier


def labelled(spark, n=400):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        text = prose(k, r.randrange(20, 200), 300)
        rows.append((k, text if good else " ".join(w.upper() + "%%%" for w in text.split())))
        labels.append((k, int(good), 0))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_held_out(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels, ~quality.held_out(F.col("doc_id")))
    got = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert len(got) > 40 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in got) >= 0.95 * len(got)


def test_classifier_odd_rows(spark):
    docs, labels = labelled(spark, 200)
    model = quality.fit(docs, labels, F.lit(True))
    got = quality.score(frame(spark, ODD), model).collect()
    assert len(got) == len(ODD) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert quality.score(frame(spark, []), model).collect() == []
    none = quality.fit(frame(spark, []), labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(frame(spark, ODD), none).collect()} == {0.5}


def test_classifier_equals_brute_force(spark):
    """Scores follow from the compressed sizes of whole texts alone, worked out plainly."""
    import zstandard

    docs, labels = labelled(spark, 200)
    model = quality.fit(docs, labels, F.lit(True))
    clash = docs.withColumn("score", F.lit("clash")).withColumn("predicted", F.lit("clash"))
    got = {x.doc_id: x for x in quality.score(clash, model).collect()}
    dictionaries = [zstandard.ZstdCompressionDict(d) for d in model.dictionaries]
    for x in docs.collect():
        raw = x.text.encode()
        sizes = [0, 0]
        for k in range(0, len(raw), quality.PIECE):
            for i, d in enumerate(dictionaries):
                c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
                sizes[i] += len(c.compress(raw[k : k + quality.PIECE]))
        z = model.weights[0] + model.weights[1] * (sizes[1] - sizes[0]) / (len(raw) + quality.SHORT)
        assert got[x.doc_id].score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)
        assert got[x.doc_id].predicted == (got[x.doc_id].score >= 0.3)


def test_classifier_leaves_out_conflicting_labels(spark):
    docs, labels = labelled(spark, 200)
    flipped = labels.selectExpr("doc_id", "1 - quality as quality", "toxic")
    none = quality.fit(docs, labels.union(flipped), F.lit(True))
    assert {x.score for x in quality.score(docs, none).collect()} == {0.5}


def test_classifier_on_data(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    model = quality.fit(docs, labels, ~quality.held_out(F.col("doc_id")))
    got = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("score", "quality").collect()
    bad, good = ([r.score for r in got if r.quality == q] for q in (0, 1))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95


# --- language identification


def test_languages_held_out(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    held = crc_fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, ~held)
    got = langid.identify(docs, model).where(held).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got) and all(0 <= r.score <= 1 for r in got)


def mixture(spark):
    r = random.Random(2)
    syllables = {"aa": ["ka", "ti", "ro", "me"], "bb": ["ush", "zel", "orn", "ixt"], "cc": ["éa", "ôu", "çi", "ñe"]}
    word = lambda lang: "".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 5)))
    rows = [(k, " ".join(word(lang) for _ in range(40)), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 40)]
    return word, langid.fit(frame(spark, rows), F.lit(True))


def test_mixture_shares(spark):
    word, model = mixture(spark)
    text = " ".join([word("aa") for _ in range(70)] + [word("bb") for _ in range(30)])
    lang, score, shares = model.infer(text)
    assert lang == "aa" and 0.5 < shares[0] < 0.9 and 0.1 < shares[1] < 0.5 and shares[2] == 0
    lang, score, shares = model.infer(" ".join(word("cc") for _ in range(50)))
    assert lang == "cc" and shares == [0, 0, 1] and score > 0.9


def test_languages_odd_rows(spark):
    _, model = mixture(spark)
    rows = [*ODD, (8, "12 34 !!"), (9, "日本語")]
    got = {(r.doc_id, r.lang_pred == "und", r.score == 0) for r in langid.identify(frame(spark, rows), model).collect()}
    assert {(1, True, True), (2, True, True), (3, True, True), (8, True, True), (4, False, False)} <= got
    assert langid.identify(frame(spark, []), model).count() == 0
    empty = langid.fit(frame(spark, []), F.lit(True))
    assert {r.lang_pred for r in langid.identify(frame(spark, ODD), empty).collect()} == {"und"}


# --- quality rules


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


def test_base_counts_equal_brute_force(spark):
    r = random.Random(3)
    docs = {k: "\n".join(prose(r.randrange(6), r.randrange(0, 14), 9) for _ in range(r.randrange(0, 9))) + r.choice(["", " #*", "\x0b|<é>"]) for k in range(120)}
    docs |= {1000: None, 1001: "", 1002: "a b c d e f g h " * 4, 1003: "x﻿ y z"}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rules.quality_rules(frame(spark, docs.items()), labels).collect()}
    for k, text in docs.items():
        want = brute_stats(text)
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words) == want
        assert got[k].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert got[k].kept == (not got[k].base_failed) and got[k].failed_rules == []


def test_binomial_tail():
    for n, p in ((10, 0.3), (50, 0.01)):
        for k in range(n + 1):
            assert rules.binomial_cdf(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_cutoffs_are_proven(spark):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(4000):
        bad = k % 5 == 0
        words = prose(k, r.randrange(120, 200), 4000).split()
        rows.append((k, " ".join(w + "%%%" if bad else w for w in words)))
        labels.append((k, int(not bad), 0))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rules.quality_rules(docs, marks).join(marks, "doc_id").collect()
    assert all(not x.kept and "symbols" in x.failed_rules for x in got if x.quality == 0)
    assert sum(not x.kept for x in got if x.quality == 1) <= 0.02 * 3200
    few = rules.quality_rules(docs, marks.limit(100)).where("size(failed_rules) > 0").count()
    assert few == 0


def test_joint_false_rejections_hold_per_stratum():
    """Simulated holdouts: the level in force rejects more than the limit in at most the stated share of runs."""
    r, level, n = random.Random(9), 0.05, 400
    truth = [0.002 * k for k in range(25)]
    wrong = 0
    for _ in range(400):
        draws = [r.random() for _ in range(n)]
        k = rules.accepted([sum(x < p for x in draws) for p in truth], n, 0.02, level)
        wrong += k > 0 and truth[k - 1] > 0.02
    assert wrong <= 400 * level * 1.6


def test_strata_unite_where_labels_are_few():
    assert rules.strata({0: 500, 1: 500, 2: 500}) == [0, 100, 1000]
    assert rules.strata({0: 500, 1: 500, 2: 10}) == [0, 100]
    assert rules.strata({0: 10, 1: 500, 2: 300}) == [0, 1000]
    assert rules.strata({}) == [0]
    assert rules.least_rows(0.02, 0.05) == 149 and rules.binomial_cdf(0, 149, 0.02) <= 0.05 < rules.binomial_cdf(0, 148, 0.02)


def test_path_tightens_all_rules_together():
    """Against a plain reading: the strictest cutoff that rejects no good value, less the margin."""
    cutoffs = [1.0 - 0.1 * k for k in range(10)]
    values = [0.05, 0.25, 0.33, 0.61]
    reached = {"one": {}}
    for v in values:
        k = sum(c <= v for c in cutoffs)
        reached["one"][k] = reached["one"].get(k, 0) + 1
    levels = rules.path(reached, rules={"one": cutoffs})
    strictest = max(k for k, c in enumerate(cutoffs) if not any(v >= c for v in values))
    assert [x.get("one") for x in levels[: len(rules.MARGINS)]] == [cutoffs[strictest - m] if strictest >= m else None for m in rules.MARGINS]


def test_rules_take_effect_on_data(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    got = rules.quality_rules(docs.withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(0)), labels).join(labels, "doc_id").where("not base_failed").collect()
    assert any(x.failed_rules for x in got)
    good = [x for x in got if x.quality == 1]
    assert sum(not x.kept for x in good) <= rules.RISK * len(good)


def test_rules_leave_out_conflicting_labels(spark):
    docs = frame(spark, [(k, prose(k, 60, 900)) for k in range(400)])
    labels = spark.createDataFrame([(k, q, 0) for k in range(400) for q in (0, 1)], "doc_id long, quality int, toxic int")
    assert rules.quality_rules(docs, labels).where("size(failed_rules) > 0").count() == 0


def test_rules_odd_rows(spark):
    labels = spark.createDataFrame([(7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rules.quality_rules(frame(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(x.base_failed and not x.kept for x in got)
    assert rules.quality_rules(frame(spark, []), labels).count() == 0


# --- decontamination


def items(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


def test_tiling(spark):
    a, b = prose(50, 40, 5000), prose(51, 30, 5000)
    w = a.split()
    rows = [
        (1, f"{prose(1, 30)} {a} {prose(2, 30)}"),
        (2, " ".join(w[20:] + ["x"] + w[:20])),
        (3, a.upper().replace(" ", ", ")),
        (4, " ".join(w[:6])),
        (5, prose(5, 300, 5000)),
        (6, b + " " + a),
        (7, " ".join(x if k % 4 else "zz" for k, x in enumerate(w))),
        (8, None),
        (9, "only four words here"),
    ]
    bench = items(spark, a, b, None, "", "only four words")
    got = {r.doc_id: r for r in decontam.decontaminate(frame(spark, rows), bench).collect()}
    assert {k: r.item_ids for k, r in got.items()} == {1: [0], 2: [0], 3: [0], 4: [], 5: [], 6: [0, 1], 7: [], 8: [], 9: [4]}
    assert got[2].coverage == 1.0 and got[4].coverage == 6 / 40
    blocks = {r.doc_id: (r.item_ids, r.coverage) for r in decontam.decontaminate(frame(spark, rows), bench, block_chars=100).collect()}
    assert blocks == {k: (r.item_ids, r.coverage) for k, r in got.items()}


def test_decontamination_odd_rows(spark):
    got = decontam.decontaminate(frame(spark, ODD), items(spark)).collect()
    assert len(got) == len(ODD) and not any(r.contaminated for r in got)
    assert decontam.decontaminate(frame(spark, []), items(spark, "a b")).count() == 0


def test_every_whole_benchmark_passage_is_found(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    docs, bench = table(spark, big, "documents"), table(spark, big, "benchmark")
    found = {r.doc_id for r in decontam.decontaminate(docs, bench).where("contaminated").collect()}
    texts = [r.text for r in bench.collect()]
    assert {r.doc_id for r in docs.select("doc_id", "text").collect() if any(t in r.text for t in texts)} <= found


# --- token counts


def brute_tokens(word, pieces):
    rarest, longest = min(pieces.values()), max(map(len, pieces))
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * rarest, -best[end - 1][1] - n)]
        options += [(best[s][0] + pieces[word[s:end]], -best[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in pieces]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts_equal_brute_force(spark):
    path = tokenizer("piece_bpe_32k.model")
    pieces = tokencount.vocabulary(path)
    docs = {k: prose(k, 40) + " Thereon andstion überß 日本 ☃ the " + "x" * k for k in range(30)}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokencount.token_counts(frame(spark, docs.items()), path).collect()}
    for k, text in docs.items():
        words = text.split()
        assert got[k] == (len(words), sum(brute_tokens("▁" + w, pieces) for w in words))


def test_trie_shares_prefixes():
    pieces = {"▁": -1.0, "a": -1.5, "b": -1.5, "ab": -2.0, "▁ab": -2.5}
    trie = tokencount.Trie(pieces)
    assert [trie.insert(w) for w in ("▁ab", "▁aba", "▁abab", "▁")] == [1, 2, 2, 1]
    assert len(trie.best) == 6


def test_very_long_words(spark):
    """Equal to brute force beyond the trie's depth; a word of 300,000 characters leaves no nodes behind."""
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "aba": -3.1, "abab": -3.5, "bb": -4.0}
    r = random.Random(6)
    trie = tokencount.Trie(pieces)
    for n in (10, 199, 200, 201, 450):
        word = "▁" + "".join(r.choice("abc") for _ in range(n))
        assert trie.insert(word) == brute_tokens(word, pieces)
    trie.insert("▁" + "ab" * 150_000)
    assert len(trie.best) <= 6 * tokencount.TRIE_DEPTH
    path = tokenizer("piece_bpe_32k.model")
    docs = frame(spark, [(1, "the " + "x" * 300_000), (2, "the")]).withColumn("n_tokens", F.lit("clash"))
    got = {x.doc_id: x for x in tokencount.token_counts(docs, path).collect()}
    assert got[1].n_words == 2 and got[1].n_tokens > got[2].n_tokens == 1


def test_token_counts_odd_rows(spark):
    path = tokenizer("piece_bpe_32k.model")
    got = {(r.doc_id, r.n_words) for r in tokencount.token_counts(frame(spark, ODD), path).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, 1), (7, 1), (None, 4)} <= got
    assert tokencount.token_counts(frame(spark, []), path).count() == 0


# --- HTML extraction

ARTICLE = "<article><h1>T &amp; t</h1><p>One  two\n three <a href=x>four</a> <b>five</b>.<p>Next&nbsp;one &lt;x&gt;</p><ul><li>a b</li><li>c</li></ul></article>"
MAIN = "T & t\n\nOne two three four five.\n\nNext one <x>\n\na b\n\nc"
NOISE = [
    "<nav><ul><li><a href=/>Home</a></li></ul></nav>",
    "<header>Site name and more words</header>",
    "<aside>Side words to read</aside>",
    "<footer>&copy; footer words</footer>",
    '<div class="cookie-notice">We use cookies on this page</div>',
    '<div class="ad">Buy this thing now</div>',
    "<form><label>Name</label><input><button>Send this</button></form>",
    "<script>var t = '<p>not text</p>';</script>",
    "<style>p{margin:0}</style>",
    "<!-- a comment <p>hidden</p> -->",
    '<section id="comments"><p>Nice post, I like it a lot, thanks</p></section>',
]


def test_extraction_of_marked_articles():
    inside, outside = html.kind_counts("<html><body>" + "".join(NOISE) + ARTICLE + "</body></html>")
    weights = html.fit_weights(inside, outside)
    for noise in NOISE:
        page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{noise}{ARTICLE}{noise}</body></html>"
        assert html.main_text(page, weights) == MAIN, noise
        inner = ARTICLE.replace("</article>", noise + "</article>")
        if not noise.startswith("<header"):
            assert html.main_text(f"<body>{inner}", weights) == MAIN, noise
    assert weights["w"] > 0 and all(v < 0 for k, v in weights.items() if k not in ("w", "w:a"))


def test_extraction_without_marks():
    words = prose(3, 60)
    page = f"<html><body><div><a href=1>one</a> <a href=2>two</a></div><div><h2>Head</h2><p>{words}<p>{words}</div><div><a href=4>x</a><a href=5>y</a></div></body></html>"
    assert html.main_text(page, {}) == f"Head\n\n{words}\n\n{words}"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<a href='x>text", "</div></p>", "<script>never closed", "<!-- open", "<p>a<p>b</article>", "<b><i>x</b></i>", "&#xD800; &bogus; &#0;", "<li>" * 5000])
def test_extraction_of_broken_pages(page):
    assert isinstance(html.main_text(page, {}), str)


def test_extraction_rows(spark):
    rows = [(1, "u", f"<body>{NOISE[0]}{ARTICLE}{NOISE[3]}"), (1, "u", f"<body>{NOISE[0]}{ARTICLE}{NOISE[3]}"), (None, None, None), (3, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.extract(pages, html.fit(pages)).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, MAIN, len(MAIN))] * 2 + [(None, "", 0), (3, "", 0)]
    assert html.extract(pages.limit(0), html.fit(pages.limit(0))).collect() == []


def test_extraction_of_all_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = html.extract(pages, html.fit(pages)).join(pages.select("page_id", "html"), "page_id").collect()
    for r in got:
        words = re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S).group(1))
        import html as entities

        assert r.text.split() == entities.unescape(words).split()


def test_names_that_only_sound_like_noise():
    for page in (
        f'<body class="has-sidebar"><div class="layout with-nav has-ads">{ARTICLE}</div>',
        f'<div class="sidebar-layout"><nav>x y</nav>{ARTICLE}<div class="sidebar">side</div></div>',
        f'{ARTICLE}<div class="comments"><article><p>A reader says many words here</p></article></div>',
        f'{ARTICLE}<article class="related"><p>Another story that is told elsewhere</p></article>',
        ARTICLE.replace("<h1>", '<h1 class="page-header">'),
        ARTICLE.replace("<h1>", "<header><h1>").replace("</h1>", "</h1></header>"),
    ):
        assert html.main_text(page, {}) == MAIN, page
