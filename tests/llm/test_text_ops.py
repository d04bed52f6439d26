import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF, rows_of

from tidemill.llm import decontam, html_text, langid, queries, toxicity, url_filter
from tidemill.llm.base import slices


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def odd_docs(spark):
    rows = [(1, None, None, 3), (2, "", "en", 1), (3, "123 !!", "en", 1), (None, "the the and", None, 1), (3, "word " * 50_000, "en", 0), (3, "word " * 50_000, "en", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


# --- URLs


def test_urls_equal_sql(spark, duck):
    df = queries.op2_url_filter(spark, SF)
    want = duck.execute(url_filter.oracle())
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    assert sorted(df.columns) == names and rows_of(df.select(*names).collect()) == rows_of([tuple(r[i] for i in at) for r in want.fetchall()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "html" not in plan.split("ReadSchema")[1]


def test_url_rules(spark):
    urls = ["http://a.net/x", "http://example.net/en/1", "http://WWW.Example.NET/en/", "https://xexample.net/en/", "http://example.net/de/", "http://example.com/de", "http://example.com/de/?q", "http://a.org/fr/x#y", "http://org/fr/", "no scheme", None, "ftp://net", "http://net?x", "://x.net/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r.host, r.path, r.rule) for r in sorted(url_filter.filter_urls(df).collect(), key=lambda r: r.page_id)]
    assert got == [("a.net", "/x", "net/"), ("example.net", "/en/1", "example.net/en/"), ("www.example.net", "/en/", "example.net/en/"), ("xexample.net", "/en/", "net/"), ("example.net", "/de/", "net/"), ("example.com", "/de", None), ("example.com", "/de/", "example.com/de/"), ("a.org", "/fr/x", "org/fr/"), ("org", "/fr/", "org/fr/"), ("", "", None), ("", "", None), ("net", "", None), ("net", "", None), ("x.net", "/", "net/")]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_model():
    b, w = url_filter.weights()
    judge = lambda host, path="/en/1": b + sum(w[i] for i in url_filter.grams(host, path)) > 0
    assert judge("m.free-bets.example.org") and judge("casino-win.example.com") and judge("www.cheap-pills.shop")
    assert not judge("blog.old-town-museum.example.com") and not judge("", "") and not judge("cooking-school.example.org")
    assert b < 0  # the fitted one: most of the table's hosts are to allow


# --- HTML


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<p>plain &amp; simple &#233;&nbsp;x</p>", "plain & simple é x"),
        ("<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>One\n two<br>three <b>bo</b>ld<p>Four</article><footer>end</footer>", "Title One two three bold Four"),
        ("<nav>menu<article>Unclosed menu</article>", "Unclosed menu"),
        ('<article><p>Text.</p><div class="ad"><p>Buy</p></div><script>var a="</p>";</script><style>p{}</style><section id="comments"><p>First!</p></section><p>More.</p></article>', "Text. More."),
        ("<article><p>Cut in the mid", "Cut in the mid"),
        ('<body><div class="cookie-notice">We use cookies</div><main><p>Main.</p><aside>side</aside><form><input> name</form></main>', "Main."),
        ('<div class="content with-sidebar"><p>Kept.</p><div class="sidebar">gone</div></div>', "Kept."),
        ('<div id="banner"><p>All there is.</p></div>', "All there is."),
        ("<!-- a > b --><p title='a>b'>x < y</p>", "x < y"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_main_text_by_distribution():
    """Without an article the sums of line lengths tell text from menus."""
    body = "".join(f"<p>{'This sentence is long enough to be text. ' * 4}</p>" for _ in range(6))
    page = "<div>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(20)) + f"</div>{body}<p>Short end.</p>" + "".join(f"<div><a href=/{i}>More {i}</a></div>" for i in range(20))
    got = html_text.main_text(page)
    assert got.startswith("This sentence") and got.endswith("Short end.") and "Link" not in got and "More" not in got


LINE = "a line of about thirty letters"
LONG = f"<p>{'Text of a long paragraph. ' * 12}</p>"
LINKS = "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(5))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<p>{'<br>'.join([LINE] * 50)}</p>", [LINE] * 50),  # only short lines
        (LINKS + f"<p>{'<br>'.join([LINE] * 50)}</p>" + LINKS, [LINE] * 50),
        *((f"<p>{'<br>'.join(['x' * 24] * n)}</p>", ["x" * 24] * n) for n in (4, 5, 6)),  # about SURGE characters
        (LINKS + "<h1>Title</h1><p>One.</p><p>Two.</p><p>Three.</p><p>Four.</p>" + LONG + LONG + LINKS, ["Title", "One.", "Two.", "Three.", "Four."]),
        (LONG + LINKS + "<p>Alone.</p>" + LINKS + LONG, ["Alone."]),
        (LONG + "<p><a href=/>Link</a></p><p>Last.</p><p><a href=/>Link</a></p>", ["Last."]),
        (LINKS.join(["<p>First stanza.</p>", "<p>Second stanza.</p>", "<p>Third stanza.</p>"]), ["First stanza.", "Second stanza.", "Third stanza."]),
    ],
)
def test_no_text_is_lost_without_an_article(page, want):
    got = html_text.main_text(page)
    assert " ".join(want) in got and "Link" not in got
    assert got.count("Text of a long") == page.count("Text of a long")


def test_silent_lines_part_the_text_from_stray_lines():
    assert html_text.main_text("<p>Welcome, guest</p>" + LINKS + LONG + LINKS + "<p>© 2026</p>").split(". ")[0] == "Text of a long paragraph"
    assert html_text.main_text(LONG + LINKS + "<p>© 2026</p>").endswith("paragraph.")
    assert html_text.main_text(LINKS) == ""


BODY = "".join(f"<div>{'This sentence is long enough to be text. ' * 4}</div>" for _ in range(6))


@pytest.mark.parametrize(
    ("page", "gone", "kept"),
    [
        # plain boxes only: the sums and the page's peak decide
        (f"<div>Home</div><div>Example Site</div>{BODY}<div>Copyright 2026 Example Inc.</div>", ["Home", "Example Site", "Copyright"], []),
        (f"<div class='headline'>A title</div>{BODY}<div>The end.</div>", [], ["A title", "The end."]),
        (f"<h1>A title</h1><p>By Ann</p>{BODY}<div>© 2026</div>", ["©"], ["A title", "By Ann"]),
        # names inside an article
        ("<article><p>Text.</p><section class='related-work'><p>Prior work.</p></section><div class='side-effects'><p>Nausea.</p></div><div class='ad-slot'>Buy</div><div class='adBox'>Now</div></article>", ["Buy", "Now"], ["Text.", "Prior work.", "Nausea."]),
        # cards and unmarked comments in articles of their own, after the article or before it
        (f"<article><h2>Other</h2><p>A card.</p></article><article>{BODY}<p>Last line.</p></article><article><p>Nice post!</p></article>", ["card", "Nice"], ["Last line."]),
        (f"<main><article>{BODY}</article><article><h3>Next story</h3></article></main>", ["Next story"], []),
        # a page whose only article is a teaser beside a long text
        (f"<article><p>Subscribe to read us.</p></article>{LINKS}{BODY}{LINKS}", ["Subscribe"], []),
        # text outside a named article, however long its lines are
        (f"<div>{'About this site and its authors. ' * 8}</div><article>{BODY}<aside>x</aside>{LINKS}<p>Short close.</p></article><div>{'More of this site to read. ' * 9}</div>", ["About", "More of"], ["Short close.", "Link 4"]),
    ],
)
def test_distribution_decides(page, gone, kept):
    got = html_text.main_text(page)
    assert got.count("This sentence") == page.count("This sentence")
    assert not [x for x in gone if x in got] and not [x for x in kept if x not in got]


def test_pages_without_article_tags(spark):
    """The text of the test pages is found as well when nothing names it."""
    import re

    pages = [r.html for r in table(spark, "pages").collect() if r.html]
    plain = [re.sub(r"</?(article|main)\b[^>]*>", "", p) for p in pages]
    same = sum(html_text.main_text(a) == html_text.main_text(b) for a, b in zip(pages, plain, strict=True))
    assert same >= 0.98 * len(pages)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 3), (1, None, "<p>a</p>", 3), (None, "u", "x" * 100_000, 3)], "page_id long, url string, html string, n_chars int")
    got = html_text.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 1, 100_000] and html_text.extract(df.limit(0)).count() == 0
    pages = queries.op8_html_text(spark, SF).collect()
    assert len(pages) == table(spark, "pages").count() and all(r.n_chars == len(r.text) > 0 for r in pages)


# --- language


def test_languages(spark):
    docs = table(spark, "documents")
    model = langid.learn(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert sum(r.rejected for r in got) <= 0.02 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = sorted(langid.identify(odd_docs(spark), model).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score))
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and odd[0].rejected and odd[-1].lang_pred in model.langs and odd[-1].held_out is False
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    none = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd_docs(spark), none).collect()} == {"und"} and langid.identify(docs.limit(0), model).count() == 0


def test_rejection():
    """Junk goes; whole texts, short ones and texts of two languages stay."""
    rng = np.random.default_rng(3)
    syllables = {"aa": ["the", "ing", "tion", "er", "st", "wh", "and"], "bb": ["der", "ung", "sch", "ein", "lich", "ge", "keit"], "cc": ["que", "aux", "oi", "ment", "le", "eu", "ré"]}
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(n))
    langs = [str(x) for x in rng.choice(sorted(syllables), 600)]
    model = langid.train([say(x, int(rng.integers(5, 80))).encode() for x in langs], langs)
    kept = [say(x, n) for x in syllables for n in (8, 20, 200) for _ in range(30)] + [f"{say('aa', 30)} {say('cc', 30)}" for _ in range(30)]
    gone = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz "), 200)) for _ in range(60)] + [" ".join("".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(8)) for _ in range(60)]
    rejected = lambda texts: langid.predict(model, [t.encode() for t in texts])[2].mean()
    assert model.junk_rejected > 0.9 and rejected(gone) > 0.9 and rejected(kept) < 0.02
    best, score, _ = langid.predict(model, [t.encode() for t in gone])
    assert (best >= 0).all() and score.max() < 1


def test_learning_never_sees_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, "x y z", "held" if __import__("zlib").crc32(str(i).encode()) % 5 == 0 else "learnt") for i in range(50)], "doc_id long, text string, lang string")
    assert langid.learn(docs).langs == ["learnt"]


def test_learning_is_bounded(spark, monkeypatch):
    """One id with a third of all rows, equal rows, and long texts don't make what the driver gathers grow."""
    ids = [i for i in range(4000) if __import__("zlib").crc32(str(i).encode()) % 5]
    seen = []
    train, learnt = langid.train, lambda texts, labels: seen.append(texts) or train(texts, labels)
    monkeypatch.setattr(langid, "train", learnt)
    hot = [(ids[0], f"one two {i}", "en") for i in range(1500)]
    docs = spark.createDataFrame(hot + [(i, f"uno due {i}", "it") for i in ids[1:]], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    for most in (30, 100, 600):
        langid.learn(docs, most=most)
        monkeypatch.setattr(toxicity, "train", lambda texts, labels, language: seen.append(texts))
        toxicity.learn(docs, marks, most=most)
        assert all(len(x) < 3 * most for x in seen)
    seen.clear()
    langid.learn(docs.where(f"doc_id = {ids[0]}").select("doc_id", F.lit("the same text").alias("text"), "lang"), most=2000)
    assert seen.pop() == [b"the same text"]
    monkeypatch.setattr(langid, "TRAIN_TOTAL", 2000)
    langid.learn(docs.select("doc_id", F.repeat("text", F.lit(20)).alias("text"), "lang"), most=600)
    assert 0 < sum(map(len, seen.pop())) < 6000


# --- toxicity


def toxic_corpus(n=400, seed=5):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(300)]
    texts, labels = [], []
    for i in range(n):
        t = list(rng.choice(words, rng.integers(5, 80)))
        bad = i % 4 == 0
        if bad:
            t[int(rng.integers(len(t)))] = str(rng.choice(["idiot,", "Scum", "trash!"]))
        texts.append(" ".join(t).encode())
        labels.append(int(bad))
    return texts, np.array(labels)


def test_toxicity_learns():
    texts, labels = toxic_corpus()
    model = toxicity.train(texts, labels, epochs=12)
    more, want = toxic_corpus(seed=6)
    got = toxicity.scores(model, more)
    assert ((got >= 0.5) == want).mean() > 0.95 and got.min() >= 0 and got.max() <= 1
    alone = toxicity.scores(model, [more[0]])
    assert abs(alone[0] - got[0]) < 1e-5  # a text's score doesn't depend on its neighbours


def test_toxicity_rows(spark):
    texts, labels = toxic_corpus(100)
    docs = spark.createDataFrame([(i, t.decode(), "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, predicted string")
    marks = spark.createDataFrame([(i, int(x), 1) for i, x in enumerate(labels)], "doc_id long, toxic int, lang int")
    model = toxicity.learn(docs, marks)
    got = toxicity.score(odd_docs(spark), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    one_kind = toxicity.learn(docs, marks.where("toxic = 0"))
    assert all(r.predicted == 0 for r in toxicity.score(docs, one_kind).collect())
    nothing = toxicity.learn(docs, marks.limit(0))
    assert toxicity.score(docs, nothing).count() == 100 and toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_learns_languages_of_all_ids(spark, monkeypatch):
    """Also of those that appear at the highest ids only."""
    monkeypatch.setattr(langid, "TRAIN_DOCS", 20)
    docs = spark.createDataFrame([(i, f"{'the and of' if i < 80 else 'der und von'} {i}", "en" if i < 80 else "de") for i in range(100)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    assert toxicity.learn(docs, marks).language.langs == ["de", "en"]


# --- decontamination

ITEMS = ["A train leaves Paris at 9 and travels 120 km in 3 hours. How far does Anna get in 5 hours?", "short item of words here", "one two", None]


def found(spark, texts, items=ITEMS, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench, **more).collect()}


FILLER = " ".join(f"filler{i}" for i in range(50))


def test_templates(spark):
    same = f"{FILLER} {ITEMS[0]} {FILLER}"
    other = f"{FILLER} a TRAIN leaves Rome at 7 and travels 250 km in 4 hours!! how far does Berta get in 9 hours? {FILLER}"
    broken = f"{FILLER}. A train leaves Rome at 7 and travels 250 km in 4 hours. How far does Berta get in 4 hours? {FILLER}"
    half = f"{FILLER} train leaves Paris at 9 and {FILLER}"
    got = found(spark, [same, other, half, FILLER, None, "", f"x short item of words here y", "one two", same, broken])
    assert {k for k in got if k[1] == 0} >= {(0, 0), (1, 0), (8, 0)} and (2, 0) not in got and (6, 1) in got
    assert not got[(0, 0)].slots_changed and got[(1, 0)].slots_changed
    assert not any(d in (3, 4, 5, 7) for d, _ in got)


def test_names_that_open_a_sentence(spark):
    item = "Anna buys 3 kg of fresh flour. Then Anna sells 2 kg of it to her old friend Ben."
    other = "Peter buys 7 kg of fresh flour. Then Peter sells 5 kg of it to her old friend Max."
    mixed = "Peter buys 7 kg of fresh flour. Then Paul sells 5 kg of it to her old friend Max."
    got = found(spark, [f"{FILLER}. {other}", f"they say {other}", item, mixed.replace("Max", "Tom"), "Anna buys apples"], [item, "Anna buys 3 kg of fresh flour"])
    assert {(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (2, 1), (3, 1)} <= set(got) and not any(d == 4 for d, _ in got)
    assert got[0, 0].slots_changed and not got[2, 0].slots_changed and got[0, 0].n_matched == got[0, 0].n_windows
    if (3, 0) in got:  # Anna can't be Peter and Paul: the windows with one of both don't count
        assert got[3, 0].n_matched < got[3, 0].n_windows


def test_items_with_few_literal_words(spark):
    """A copy is found by literal words and slot values together; one with other values isn't."""
    items = ["Compute 3/4 + 5/6 of 20 kg.", "1 2 3 4 5 6 7 8 9 10 11 12", "one two", "", "Compute 3/4 + 5/6 of 20 kg"]
    texts = [f"{FILLER} compute 3/4 + 5/6 of 20 KG! {FILLER} {items[0]}", items[0], "compute 3/4 + 5/6 of 30 kg", "compute 3/4 + 5/6", "of 20 kg", f"{FILLER} 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12 {FILLER}", "1 2 3 4 5 6 7 8 9 10 11 13", "one two", ""]
    got = found(spark, texts, items)
    assert {k for k in got if k != (6, 1)} == {(0, 0), (0, 4), (1, 0), (1, 4), (5, 1)}
    assert got[(5, 1)].n_matched == 5 and got.get((6, 1), got[(5, 1)]).n_matched in (4, 5)


def test_inconsistent_slots(spark):
    item = "if 3 apples cost 3 coins then 3 more apples will cost 3 further coins today"
    swap = lambda *n: "if %s apples cost %s coins then %s more apples will cost %s further coins today" % n
    got = found(spark, [swap(5, 5, 5, 5), swap(1, 2, 4, 8)], [item])
    assert set(got) == {(0, 0)} and got[0, 0].slots_changed  # one value of the item would mean four


def brute_force(texts, items):
    """All items against all documents, one pair at a time: windows as tuples of readable words."""

    def words(text):
        out, opens, number = [], True, False
        for w in (text or "").split():
            bare = w.strip(decontam.TRIM)
            if bare:
                low = bare.lower()
                kind = "num" if decontam.NUMBER.fullmatch(bare) else "unit" if low in decontam.UNITS and number else "name" if low not in decontam.UNITS and bare[0].isupper() and bare[1:].islower() else None
                out.append((low, kind, opens and kind == "name"))
                number, opens = kind == "num", w[-1] in ".!?:|"
            elif any(c in ".!?" for c in w):
                opens = True
        return out

    def readings(ws):
        word = [(f"<{k}>", v) if k and not o else (v, None) for v, k, o in ws]
        name = [(f"<{k}>", v) if k else (v, None) for v, k, o in ws]
        plain = lambda r: sum(v is None for _, v in r)
        out = [word] if plain(word) >= 4 else [[(v, None) for v, _, _ in ws] + [("by value", None)]]
        if 4 <= plain(name) < plain(word):
            out.append(name)
        return out

    found = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            theirs, ours = words(item), words(text)
            if len(theirs) < 4:
                continue
            size = min(8, len(theirs))
            pairs = []
            for q in range(len(theirs) - size + 1):
                for a in readings(theirs[q : q + size]):
                    for p in range(len(ours) - size + 1):
                        for b in readings(ours[p : p + size]):
                            if [k for k, _ in a] == [k for k, _ in b]:
                                pairs.append((q, [(x, y) for (_, x), (_, y) in zip(a, b, strict=True) if x is not None]))
            n = len(theirs) - size + 1
            votes = {}
            for _, slots in pairs:
                for x, y in slots:
                    votes.setdefault(x, {}).setdefault(y, 0)
                    votes[x][y] += 1
            tied = any(sorted(v.values())[-2:] == [max(v.values())] * 2 for v in votes.values() if len(v) > 1)
            means = {x: max(v, key=v.get) for x, v in votes.items()}
            agree = len({q for q, slots in pairs if all(means[x] == y for x, y in slots)})
            if tied or agree >= 0.5 * n:
                found[d, i] = None if tied else (agree, n, any(x != y for x, y in means.items()))
    return found


@pytest.mark.parametrize("most", [0, 300_000])
def test_contamination_equals_brute_force(spark, most):
    rng = np.random.default_rng(4)
    names, plain = ["Anna", "Ben", "Carl", "Dora", "Emil"], [f"w{'abcdefghij'[k]}" for k in range(10)]
    shapes = [[("w", k) if rng.random() < 0.6 else ("n" if rng.random() < 0.5 else "#", int(rng.integers(3))) for k in rng.integers(0, 10, rng.integers(3, 24))] for _ in range(12)]

    def say(shape):
        who, what = rng.permutation(names), rng.permutation([3, 7, 12, 40])
        out = [plain[k] if kind == "w" else who[k] if kind == "n" else f"{what[k]}" for kind, k in shape]
        return " ".join(w + ("." if rng.random() < 0.15 else "") + (" kg" if w.isdigit() and rng.random() < 0.3 else "") for w in out)

    items = [say(shapes[k % 12]) for k in range(30)] + [None, ""]
    texts = [" ".join([say(shapes[int(rng.integers(12))]), say(shapes[int(rng.integers(12))])]) for _ in range(40)] + items[:5] + [None, ""]
    got, want = found(spark, texts, items, most=most), brute_force(texts, items)
    sure = {k for k, v in want.items() if v}
    assert len(sure) > 40 and sure <= set(got) <= set(want)
    for k in sure:
        assert (got[k].n_matched, got[k].n_windows, got[k].slots_changed) == want[k]


def test_large_benchmark(spark):
    """More items than fit the filter well, in one scan: what is found stays the same."""
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    key = lambda df: sorted((r.doc_id, r.item_id, r.n_matched) for r in df.collect())
    whole = key(decontam.contaminated(docs, bench))
    more = spark.range(8000).selectExpr("id + 1000 AS item_id", "concat_ws(' ', transform(sequence(1, 20), k -> concat('x', hash(id, k)))) AS text")
    assert key(decontam.contaminated(docs, bench.select("item_id", "text").unionByName(more))) == whole
    gone = {d for d, _, _ in whole}
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - gone
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0


def test_every_whole_item_is_found(spark):
    """Against a brute-force search for the items' words in the documents' words."""
    import re

    norm = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    docs, items = table(spark, "documents").collect(), table(spark, "benchmark").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text and norm(i.text) in norm(d.text)}
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, SF).collect()}
    assert want <= got


def test_slices():
    assert list(slices(np.array([5, 5, 5]), 10)) == [(0, 2), (2, 3)] and list(slices(np.array([50]), 10)) == [(0, 1)] and list(slices(np.zeros(0, int))) == []
