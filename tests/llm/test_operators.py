"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import chat_windows, exact_dedup, html_text, mixing, packing, pii, repeats, simhash, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, parts=3):
    rows = [(k, t, "en", f"s{k % 3}" if k and k % 7 else None, len(t or "")) for k, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def some_texts():
    r = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    texts = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 80)))) for k in range(60)]
    texts += [(100, None), (101, ""), (102, " \t\n "), (103, texts[0][1]), (104, texts[0][1].replace(" ", "\n\t")), (103, texts[0][1]), (None, texts[1][1]), (105, "x" * 50_000), (106, "a b " * 8_000)]
    return texts


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


EMPTY = []
CLASHING = ["digest", "content", "salt", "value", "best", "rows", "copy", "size", "source_size", "of", "fp", "tops", "spans", "id", "label", "uid", "starts"]


# 1


def plain_conversations(turns):
    by = {}
    for conv, turn, role, text in turns:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, ts in by.items():
        ts.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in ts)
        loss = "".join(x for _, _, r, x in ts if r == "assistant")
        out.append((conv, len(ts), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_turns():
    r = random.Random(5)
    turns = []
    for conv in range(12):
        if conv % 3 == 0:
            turns.append((conv, 0, "system", "be brief " * r.randint(0, 20)))
        turns += [(conv, k, ("user", "assistant")[k % 2], "word " * r.randint(0, 120)) for k in range(1, r.randint(2, 30))]
    turns += [(50, 0, "assistant", r"\### Assistant: </turn> \b \\l <turn>x"), (50, 0, None, None), (50, None, "user\nrole", "\n\n"), (51, 1, "user", "huge " * 5000), (51, 1, "user", "huge " * 5000), (None, 0, "assistant", "orphan")]
    return turns


def test_chat_reads_back(spark):
    df = spark.createDataFrame(some_turns(), "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    got = rows(chat_windows.read_back(chat_windows.windows(df, budget=120, history=30)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"))
    assert got == plain_conversations(some_turns())


@pytest.mark.parametrize("budget,history", [(300, 40), (140, 64), (130, 0)])
def test_chat_windows_keep_the_budget_and_repeat(spark, budget, history):
    turns = [t for t in some_turns() if t[0] is not None and t[0] < 12] + [(20, k, ("user", "assistant")[k % 2], "short " * 6) for k in range(90)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = chat_windows.windows(df, budget=budget, history=history).collect()
    assert any(w["repeated"] > 1 for w in found) == (history > 0)
    for w in found:
        pieces = w["text"].split("</turn>\n")[:-1]
        tokens = [len(p.removeprefix("<turn>").split("\n", 1)[1].split()) + 4 for p in pieces]
        system = tokens[0] if pieces[0].startswith("<turn>system\n") else 0
        new = tokens[max(w["repeated"], system > 0) :]
        assert sum(tokens) <= budget or len(new) == 1 and system + new[0] > budget and sum(tokens) == system + new[0]
        assert sum(tokens[: w["repeated"]]) - system * (w["window"] > 0) <= history
        if w["window"] and w["conv_id"] % 3 == 0 and w["conv_id"] < 12:
            assert pieces[0].startswith("<turn>system\n") and w["repeated"] >= 1


def test_chat_empty(spark):
    df = spark.createDataFrame(EMPTY, "conv_id long, turn long, role string, text string")
    assert rows(chat_windows.read_back(chat_windows.windows(df))) == []


# 2


def test_html_article_without_what_is_beside():
    page = """<html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice">We use</div><header>Site</header><nav><ul><li>Menu</li></ul></nav>
    <div class="wrap no-sidebar"><article><h1>Head &amp; line</h1><p><b>One<br>two&nbsp;  three<p>Four &lt;b&gt; &amp;amp;<script>x="</p>"</script><aside>Side</aside><div class="comments"><p>Nice</p></div>
    <form><p>Name</p></form></article></div><!-- x --><div id="sidebar">S</div><footer>&copy; me</footer>"""
    assert html_text.main_text(page) == "Head & line\n\nOne two three\n\nFour <b> &amp;"


@pytest.mark.parametrize("page", ["", None, "<", "<<<>", "a < b", "<p", "</p></p>", "<div>" * 3000 + "x", "<a href='x" * 500, '<a "' * 2000, "<!-- never ends"])
def test_html_broken_markup(page):
    html_text.main_text(page)


@pytest.mark.parametrize("quote", "\"'")
@pytest.mark.parametrize("size", [10, 4096, 5_000, 1_000_000])
def test_html_quoted_values_of_any_length(quote, size):
    value = f"<i>leak</i> > {'z' * size}"
    page = f"<body><div data-x={quote}{value}{quote} class=advert>Buy</div><div data-x={quote}{value}{quote}>Text</div></body>"
    assert html_text.main_text(page) == "Text"


@pytest.mark.parametrize("page", ['<a "' * 200_000, "<a '<b \"" * 100_000, "<a '\"" * 100_000, "<a \"<b '\"'" * 100_000, "<" + "a" * 200_000 + '"' + "x" * 200_000, '<a b="' + "<i x='" * 100_000, "<a " + '"<a \'" \'"\' ' * 50_000])
def test_html_quotes_take_linear_time(page):
    import time

    begun = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - begun < 10


def test_html_template_of_a_site_goes(spark):
    pages = [(k, f"http://a.example/{k}", f"<body><div>Best site ever</div><div><p>Own text {k}</p><p>Licence line</p></div></body>") for k in range(20)]
    pages += [(100 + k, "http://b.example/", f"<body><div>Best site ever</div><p>Other {k}</p></body>") for k in range(2)] + [(200, None, None), (201, "odd", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "template": F.lit(1)})
    got = {i: t for i, _, t in rows(html_text.extract(df))}
    assert got[3] == "Own text 3" and got[100] == "Best site ever\n\nOther 0" and got[200] == "" and got[201] == ""


def test_html_recurring_text_inside_an_article_stays(spark):
    pages = [(k, "http://a.example/", f"<nav>x</nav><article><p>Own {k}</p><p>Licence line</p></article>") for k in range(20)]
    got = rows(html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))
    assert got[0][2] == "Own 0\n\nLicence line"
    assert rows(html_text.extract(spark.createDataFrame(EMPTY, "page_id long, url string, html string"))) == []


def test_html_copies_of_a_page_are_no_template(spark):
    lone = "<body><div class='x{k}'><p>Only here</p><ul><li>Point</li></ul></div></body>"
    pages = [(k, "http://a.example/", "<body><article><div>In a division</div><ul><li>Listed</li></ul></article></body>") for k in range(7)]
    pages += [(10 + k, "http://b.example/", lone.format(k=k)) for k in range(7)]
    pages += [(20 + k, "http://c.example/", f"<body><div>Banner</div><article><p>Own {k}</p></article></body>") for k in range(3)]
    got = {i: t for i, _, t in rows(html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert {got[k] for k in range(7)} == {"In a division\n\nListed"} and {got[10 + k] for k in range(7)} == {"Only here\n\nPoint"}


@pytest.mark.parametrize("others", [0, 400])
def test_html_template_goes_alike_on_hosts_of_every_size(spark, others):
    pages = [(k, "http://a.example/", f"<body><div>Campaign of May</div><p>Own {k}</p></body>") for k in range(5)]
    pages += [(100 + k, "http://a.example/", f"<body><p>Other {k}</p></body>") for k in range(others)]
    got = {i: t for i, _, t in rows(html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert [got[k] for k in range(5)] == [f"Own {k}" for k in range(5)] and len(got) == 5 + others


@pytest.mark.parametrize("page", ["<main><p>x</p>" * 20_000, "<article><p>x</p>" * 20_000, "<body>x" * 20_000, "<p><main>" * 20_000 + "x"])
def test_html_nested_holders_take_linear_time(page):
    import time

    begun = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - begun < 10


def test_html_references_are_decoded_in_each_text():
    assert html_text.main_text("<article><p>AT&<b>amp;</b> R&amp;D &am<!-- x -->p;</p></article>") == "AT&amp; R&D &amp;"


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</span></p></b>" * 50_000, "<li><ul>" + "<div>" * 50_000 + "</li>" * 50_000, "<p>" + "<b>" * 50_000 + "<div><p></b>" * 50_000])
def test_html_end_tags_take_linear_time(page):
    import time

    begun = time.process_time()
    html_text.parse(page)
    assert time.process_time() - begun < 5


def test_html_menu_inside_the_article_and_cards_go(spark):
    """Nothing but the template tells that these are beside the text."""
    menu = "<div><ul><li>Home</li><li>World</li></ul></div>"
    card = "<article><p>Read our other story, which is longer than all of the articles of this site</p></article>"
    pages = [(k, "http://a.example/", f"<body><div>Top {k}</div><article>{menu}<h1>Head {k}</h1><p>Own {k}</p><p>Licence</p><section><p>Box</p></section></article></body>") for k in range(6)]
    pages += [(10 + k, "http://b.example/", f"<body><article><p>Own {k}</p></article>{card}</body>") for k in range(6)]
    pages += [(20 + k, "http://c.example/", f"<body><article>{menu}<p>Own {k}</p></article></body>") for k in range(4)]
    got = {i: t for i, _, t in rows(html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert got == {k: f"Head {k}\n\nOwn {k}\n\nLicence" for k in range(6)} | {10 + k: f"Own {k}" for k in range(6)} | {20 + k: f"Home\n\nWorld\n\nOwn {k}" for k in range(4)}


def plain_extract(pages, least=5):
    """Templates counted with dictionaries, host by host."""
    host = lambda u: (re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "") or [None, ""])[1].lower()
    seen = {}
    for _, u, h in pages:
        for x, c in html_text.page_hashes(h):
            seen.setdefault((host(u), x), set()).add(c)
    return sorted([(i, u, html_text.main_text(h, frozenset(x for (n, x), cs in seen.items() if n == host(u) and len(cs) >= least))) for i, u, h in pages], key=repr)


def plain_article(source):
    """The article of a page by Python's own parser and what the contract names, without any of the operator's lists: what stands outside of it, and in it beside it, is left out."""
    from html.parser import HTMLParser

    beside = set("script style nav header footer aside form button select textarea template noscript svg iframe".split())  # scripts, styles, menus, headers, footers, sidebars, forms
    adverts = {"ad", "advert", "notice", "sidebar", "comments", "menu"}  # as classes of their own
    void = set("area base br col embed hr img input link meta source track wbr".split())
    blocks = set("p div section article h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre figure figcaption dl dt dd main hr".split())

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.inside, self.skipped, self.parts = False, [], [[]]

        def handle_starttag(self, tag, attrs):
            words = {w for k, v in attrs if k == "class" for w in (v or "").lower().split()}
            if tag == "article":
                self.inside = True
            if self.skipped or tag in beside or words & adverts:
                if tag not in void:
                    self.skipped.append(tag)
            elif tag in blocks:
                self.parts.append([])
            elif tag == "br":
                self.parts[-1].append(" ")

        def handle_endtag(self, tag):
            if tag == "article" and not self.skipped:
                self.inside = False
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
                self.parts.append([])
            elif not self.skipped and tag in blocks:
                self.parts.append([])

        def handle_data(self, data):
            if self.inside and not self.skipped:
                self.parts[-1].append(data)

        def handle_entityref(self, name):
            self.handle_data(html_unescape(f"&{name};"))

        def handle_charref(self, name):
            self.handle_data(html_unescape(f"&#{name};"))

    from html import unescape as html_unescape

    reader = Reader()
    reader.feed(source or "")
    reader.close()
    return "\n\n".join(x for x in (" ".join("".join(p).split()) for p in reader.parts) if x)


def test_html_headings_and_text_blocks_stay():
    page = """<article><h2 id="related-work">Related work</h2><p>x</p><h2 id="social-impact">Impact</h2><p class="notice-period">y</p><section id="navigation"><h3 id="menu">Menus</h3>
      <p id="comments">On comments</p></section><div class="share-buttons">Share</div><p class="ad">Buy</p><div id="comments"><p>First!</p></div><ul class="skip-list"><li>item</li></ul></article>"""
    assert html_text.main_text(page).split("\n\n") == ["Related work", "x", "Impact", "y", "Menus", "On comments", "item"] == plain_article(page.replace('class="share-buttons"', 'class="ad"').replace('id="comments"><p>F', 'class="comments"><p>F')).split("\n\n")
    outside = '<body><div class="site-menu">Home</div><div id="footer">Imprint</div><p class="menu-of-the-day">Soup</p><p>Bread</p></body>'
    assert html_text.main_text(outside) == "Soup\n\nBread"


def test_html_deletion_decides_on_a_site_whose_templates_say_nothing_of_themselves(spark):
    """Without an article element and without telling classes, only what recurs on the host tells the menu and the offer from the text."""
    pages = [(k, "http://t.example/x", f'<body><div class="c1"><div>Home</div><div>News</div></div><div class="c2"><p>Own text {k}, which is long enough.</p></div><div class="c3">Buy our book now</div></body>') for k in range(8)]
    pages.append((9, "http://alone.example/x", pages[0][2]))
    got = {r[0]: r[2] for r in rows(html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert [got[k] for k in range(8)] == [f"Own text {k}, which is long enough." for k in range(8)]
    assert got[9] == "Home\n\nNews\n\nOwn text 0, which is long enough.\n\nBuy our book now"


def test_html_query_against_plain_versions(spark):
    """The query's rows over all pages of the smallest tables, and of a site whose pages hold templates."""
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    got = rows(html_text.op2_html_text(spark, "/root/testdata/sf0.001"))
    assert [r[:3] for r in got] == plain_extract(pages) and all(r[3] == len(r[2]) for r in got)
    articles = {i: plain_article(h) for i, _, h in pages}
    assert {r[0]: r[2] for r in got} == articles
    r = random.Random(2)
    block = lambda k: f"<{(t := r.choice(['div', 'section', 'p', 'ul', 'article', 'main']))}>{r.choice(['Menu', 'Box', f'Own {k}'])}{'' if t == 'p' else '<p>x</p>'}</{t}>"
    site = [(k, r.choice(["http://a.example/x", "HTTPS://me@A.example:80", "b", None]), "<body>" + "".join(block(k) for _ in range(6)) + "</body>") for k in range(60)]
    site += site[:5]
    assert rows(html_text.extract(spark.createDataFrame(site, "page_id long, url string, html string"))) == plain_extract(site)


# 3


def plain_groups(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in texts]
    out, seen = [], Counter()
    for (i, _), n in zip(texts, norm, strict=True):
        ids = [j for (j, _), m in zip(texts, norm, strict=True) if m == n and j is not None]
        keep = min(ids, default=None)
        seen[i, n] += 1
        out.append((i, keep, norm.count(n), i == keep and seen[i, n] == 1, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups(spark):
    df = docs_of(spark, some_texts())
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    assert rows(exact_dedup.exact_groups(df, salts=3)) == plain_groups(some_texts())
    assert rows(exact_dedup.exact_groups(docs_of(spark, EMPTY))) == []


def test_drop_copies_keeps_one_row_of_each_text_as_it_was(spark):
    df = docs_of(spark, some_texts())
    kept = rows(exact_dedup.drop_copies(df))
    assert len(kept) == len({g[4] for g in plain_groups(some_texts())})
    assert set(kept) <= set(rows(df))
    assert {r[0] for r in kept if r[0] is not None} == {g[0] for g in plain_groups(some_texts()) if g[3]}


# 4


def plain_components(prints):
    ids = list(range(len(prints)))
    root = ids[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids[:a]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in ids]


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    sh = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))]
    hs = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    for text in [None, "", "A", "a B", "a b c", "ÀB c\x1cd  e f A", *[t for _, t in some_texts()[:30]]]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("segments", [4, 5])
def test_golay_keys_miss_no_link(segments):
    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    y = x.copy()
    for k in range(400):
        for b in r.choice(64, k % 4, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    tables = {w: simhash.near_codewords(w) for _, w in simhash.segment_plan(segments)[0]}
    a, b = simhash.keys_of(x, segments, False, tables), simhash.keys_of(y, segments, True, tables)
    assert {o for _, o in {*zip(*map(np.ndarray.tolist, a))} & {*zip(*map(np.ndarray.tolist, b))}} == set(range(400))


def test_near_duplicates(spark):
    base = "the quick brown fox jumps over the lazy dog again and again until night falls on the hill " * 8
    texts = [*some_texts()[:40], (200, base), (201, base + " end"), (202, base.upper()), (203, base), (203, base), (204, None), (205, "")]
    ids = [i for i, _ in texts]
    prints = [plain_fingerprint(t) for _, t in texts]
    comp = plain_components(prints)
    expected = sorted([(i, f"{p:016x}", min(ids[k] for k in range(len(ids)) if comp[k] == c)) for i, p, c in zip(ids, prints, comp, strict=True)], key=repr)
    df = docs_of(spark, texts).withColumns({"fp": F.lit(1), "root": F.lit(2), "key": F.lit(3)})
    assert rows(simhash.near_duplicates(df)) == expected
    kept = [r[0] for r in simhash.one_of_each(df).collect()]
    assert sorted(kept) == sorted({e[2] for e in expected})
    assert rows(simhash.near_duplicates(docs_of(spark, EMPTY))) == []


def test_links_are_joined_without_broadcast(spark, monkeypatch):
    """The rows that a kernel makes of a node are more than Spark reckons with."""
    plans, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or components(edges))
    assert simhash.near_duplicates(docs_of(spark, some_texts()[:9])).count() == 9
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0], plans


def test_one_of_each_keeps_a_row_of_every_component(spark):
    """By texts, not ids: rows that share an id, rows without one, and other columns that decide."""
    r = random.Random(8)
    base = [" ".join(r.choice("abcdefghij") + str(r.randint(0, 999)) for _ in range(60)) for _ in range(6)]
    near = [b.upper() for b in base]  # other texts of the same fingerprint
    texts = [(7, base[0]), (7, base[1]), (3, base[2]), (7, near[2]), (None, base[3]), (None, near[3]), (None, near[0]), (9, near[4]), (9, base[4]), (None, "")]
    df = docs_of(spark, texts)
    prints = [plain_fingerprint(t) for _, t in texts]
    comp, whole = plain_components(prints), [tuple(x) for x in df.collect()]
    comp_of = {t: c for (_, t), c in zip(texts, comp, strict=True)}
    expected = [min((w for w in whole if comp_of[w[1]] == c), key=lambda w: (w[0] is None, w[0] or 0, w[2], w[3] is not None, w[3] or "", w[4], w[1])) for c in set(comp)]
    assert {base[0], base[1], base[2]} <= {e[1] for e in expected} and len(expected) == 6
    assert rows(simhash.one_of_each(df)) == sorted(expected, key=repr)
    assert rows(simhash.one_of_each(docs_of(spark, EMPTY))) == []



# 5


def test_mix(spark):
    df = docs_of(spark, some_texts()).withColumns({"target": F.lit(1), "weight": F.lit(2), "row": F.lit(3), "of": F.lit(4)})
    got = mixing.mix(df).collect()
    sizes = Counter()
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for i, t in some_texts():
        sizes[i] += len((t or "").split())
    targets = {(r["source_size"], r["target"]) for r in got}
    assert abs(sum(t for _, t in targets) - 1.5 * sum(s for s, _ in targets)) < 1e-6
    assert all(t <= 2 * s + 1e-9 for s, t in targets)
    assert rows(mixing.mix(df)) == rows(mixing.mix(df.repartition(7)))
    emitted = Counter(r["doc_id"] for r in mixing.emit(df).collect())
    assert mixing.emit(df).columns == df.columns
    assert sum(emitted.values()) == sum(r["copies"] for r in got)
    assert rows(mixing.mix(docs_of(spark, EMPTY))) == []


def test_targets_by_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 100, "d": 0, None: 500}
    sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    order = sorted([s for s in sizes if s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= over
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    assert all(abs(got[s] - target[s]) < 1e-6 for s in sizes)


# 6


def toxic_corpus(spark, n=240):
    r = random.Random(1)
    words = [a + b for a in ("lo", "mi", "ta", "re", "su") for b in ("na", "pe", "ki", "do", "ve", "")]
    texts, labels = [], []
    for k in range(n):
        ws = [r.choice(words) for _ in range(r.randint(20, 90))]
        bad = k % 4 == 0
        for _ in range(4 * bad):
            ws[r.randrange(len(ws))] = "vile" + r.choice(words)
        texts.append((k, " ".join(ws)))
        labels.append((k, int(bad)))
    return docs_of(spark, [*texts, (900, None), (901, ""), (902, "vile" * 20_000), (None, "lona")]), spark.createDataFrame([*labels, (5, None), (0, 1)], "doc_id long, toxic int")


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([scores[a] > scores[b] for a in held if a % 4 == 0 for b in held if b % 4]) > 0.95
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == 244
    kept = toxicity.not_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}


def test_toxicity_bounds_and_repeated_ids(spark):
    """Rows that repeat an id count as one document in training, so that the bounds hold; the column names are parameters."""
    docs, labels = toxic_corpus(spark, 80)
    known = toxicity.labelled(labels, "doc_id", "toxic")
    chosen = toxicity.training_docs(docs.unionByName(docs).unionByName(docs), known, "doc_id", "text", most=7)
    assert sorted(Counter(r["label"] for r in chosen.collect()).values()) == [7, 7]
    model = toxicity.fit(docs.unionByName(docs), labels, most_windows={0: 2, 1: 3})
    assert all(np.array_equal(v, model[k]) for k, v in toxicity.fit(docs, labels, most_windows={0: 2, 1: 3}).items())
    named = docs.withColumnsRenamed({"doc_id": "key", "text": "body"})
    kept = toxicity.not_toxic(named, labels.withColumnRenamed("doc_id", "key"), id_col="key", text_col="body")
    assert kept.columns == named.columns and {r["key"] for r in kept.collect()} == {r["doc_id"] for r in toxicity.not_toxic(docs, labels).collect()}


def plain_window_logits(p, text):
    """Every window by plain loops: the network as its formulas say."""
    ws = (text or "").split()
    starts = list(range(0, max(1, len(ws) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE))
    assert {k for s in starts for k in range(s, min(len(ws), s + toxicity.WINDOW))} == set(range(len(ws)))
    h, out = toxicity.HIDDEN, []
    for s in starts:
        xs = []
        for w in ws[s : s + toxicity.WINDOW]:
            word, grams, _ = toxicity.word_features([w])
            word, grams = toxicity.kept_rows(word, p["word_kept"]), toxicity.kept_rows(grams, p["gram_kept"])
            xs.append(np.concatenate([p["words"][word[0]], p["grams"][grams].mean(axis=0)]))
        both = []
        for d in "fb":
            state, states = np.zeros(h), []
            for x in xs if d == "f" else xs[::-1]:
                i, u = x @ p[f"W{d}"] + p[f"c{d}"], state @ p[f"U{d}"]
                z, r = 1 / (1 + np.exp(-(i[:h] + u[:h]))), 1 / (1 + np.exp(-(i[h : 2 * h] + u[h : 2 * h])))
                state = (1 - z) * np.tanh(i[2 * h :] + r * u[2 * h :]) + z * state
                states.append(state)
            both.append(states if d == "f" else states[::-1])
        if not xs:
            out.append(float(p["b"][0]))
            continue
        hs = np.concatenate([np.array(b) for b in both], axis=1)
        a = np.exp(np.tanh(hs @ p["A"]) @ p["v"])
        out.append(float((a / a.sum()) @ hs @ p["w"] + p["b"][0]))
    return sorted(out, reverse=True)


def test_toxicity_query_against_a_plain_network(spark, tmp_path):
    """The query's scores, over all windows of all texts, by plain loops; its columns, held-out rows and threshold."""
    docs, labels = toxic_corpus(spark, 60)
    docs = docs.where("doc_id is null or doc_id <> 902").unionByName(docs_of(spark, [(903, "vile lona " * 40), (904, " \n")]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit(docs, labels)
    w = model["fit"]
    got = toxicity.op6_toxicity(spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    found = {r["doc_id"]: r for r in got.collect()}
    for r in docs.collect():
        tops = plain_window_logits(model, r["text"])
        tops = [tops[min(k, len(tops) - 1)] for k in range(3)]
        score = 1 / (1 + np.exp(-(w[0] * tops[0] + w[1] * np.mean(tops) + w[2])))
        mine = found[r["doc_id"]]
        assert abs(mine["score"] - score) < 1e-4 and mine["predicted"] == (mine["score"] >= 0.3)
        assert mine["held_out"] == (zlib.crc32(str("null" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)


def test_toxicity_gradient():
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(1).items()}
    x, mask, y = r.standard_normal((5, 3, 2 * toxicity.WIDTH)), np.ones((5, 3)), np.array([1.0, 0, 1])
    mask[3:, 1] = 0

    def loss(q):
        states = [toxicity.recurrent(x @ q[f"W{d}"] + q[f"c{d}"], mask, q[f"U{d}"], d == "b", False)[0] for d in "fb"]
        s = toxicity.sigmoid(toxicity.pooled(q, np.concatenate(states, axis=2), mask)[0])
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g, _ = toxicity.gradient(p, x, mask, y)
    for k in g:
        at = tuple(r.integers(0, n) for n in p[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert abs(g[k][at] - (loss(up) - loss(down)) / 2e-3) < 1e-4


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, some_texts()[:5])
    none = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert [r["score"] for r in toxicity.score(docs, None).collect()] == [0.0] * 5
    assert toxicity.not_toxic(docs, none).count() == 5


# 7


def test_packing(spark):
    texts = [*some_texts(), (300, "don't STOP “quoted” 12 É <|endoftext|> \x1c x\x85y"), (301, "\x1d")]
    df = docs_of(spark, texts).withColumns({"start": F.lit(1), "ids": F.lit(2)})
    pieces = packing.pack(df, packing.tokenizer_path(), window=64).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    expected = Counter((i, tuple([*(t.encode(x or "", add_special_tokens=False).ids), 2])) for i, x in texts)
    sequences, whole = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and p["length"] == len(p["ids"]) > 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64 and at & (at - 1) == 0
    unique = [i for i, n in Counter(i for i, _ in texts).items() if n == 1]
    for p in sorted(pieces, key=lambda p: (p["doc_id"] or -1, p["start"])):
        whole.setdefault(p["doc_id"], []).extend(p["ids"])
    assert all(expected[i, tuple(whole[i])] == 1 for i in unique)
    assert sum(p["length"] for p in pieces) == sum(len(k[1]) * n for k, n in expected.items())
    # Each id of each row, those with a repeated id included, is in exactly one piece.
    covered, needed = Counter(), Counter()
    for p in pieces:
        covered.update((p["doc_id"], p["doc_tokens"], p["start"] + k, x) for k, x in enumerate(p["ids"]))
    for (i, ids), n in expected.items():
        needed.update({(i, len(ids), k, x): n for k, x in enumerate(ids)})
    assert covered == needed
    assert packing.pack(docs_of(spark, EMPTY), packing.tokenizer_path()).count() == 0


def test_packing_goes_on_in_pools(spark):
    """Remainders of 8 tasks in one pool, in several, and handed over early: all ids once, and little left that is shorter than a window."""
    texts = [(k, "word " * (k * 7 % 60)) for k in range(200)]
    df = docs_of(spark, texts, parts=8)
    total = sum(len((t or "").split()) + 1 for _, t in texts)
    for pool in (1 << 20, 200):
        pieces = packing.pack(df, packing.tokenizer_path(), window=64, with_ids=False, pool=pool, most_open=6).collect()
        assert sum(p["length"] for p in pieces) == total and "ids" not in pieces[0].asDict()
        ends = Counter()
        for p in pieces:
            ends[p["sequence_id"]] += p["length"]
        assert all(n <= 64 and n & (n - 1) == 0 for n in ends.values())
    assert rows(packing.pack(df, packing.tokenizer_path(), window=64)) == rows(packing.pack(df, packing.tokenizer_path(), window=64))


def test_packing_leaves_little_and_has_no_bound_on_open_windows(spark):
    """10,000 texts of 0.6 windows each leave as many windows open; nothing is laid before the last round, where short texts would still go in."""
    texts = [(k, "word " * 37) for k in range(10_000)] + [(20_000 + k, "word " * 25) for k in range(10_000)]
    df = docs_of(spark, texts, parts=1)
    pieces = packing.pack(df, packing.tokenizer_path(), window=64, with_ids=False, most_open=500).collect()
    assert sum(p["length"] for p in pieces) == 10_000 * (38 + 26)
    # All but a few sequences hold whole documents: pairs of 38 and 26 ids, which fill a window.
    cut = sum(p["length"] < p["doc_tokens"] for p in pieces)
    assert cut < 100, cut


def test_packer_closes_the_fullest_first_and_hands_over():
    handed = []
    packer = packing.Packer(lambda pieces: None, window=10, most_open=2, hand_over=handed.append)
    for size in (6, 9, 7):
        packer.place((size, 0, np.zeros(size, np.uint32), size))
    assert [[p[0] for p in pieces] for pieces in handed] == [[9, 7, 6]] and packer.n_open == 0 and not packer.counts.any()
    written = []
    packer = packing.Packer(written.append, window=8)
    packer.lay([("a", 0, np.arange(5), 5), ("b", 0, np.arange(8), 8), ("c", 0, np.arange(6), 6)])
    assert [[(p[0], p[1], len(p[2])) for p in w] for w in written] == [[("a", 0, 5), ("b", 0, 3)], [("b", 3, 5), ("c", 0, 3)], [("c", 3, 2)], [("c", 5, 1)]]


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    words, whole = packing.WordIds(path), Tokenizer.from_file(path)
    assert not words.cuts and packing.WordIds(packing.tokenizer_path()).cuts
    for x in ("Hello  World 123", "", "É don't"):
        assert words.encode([x])[0].tolist() == whole.encode(x, add_special_tokens=False).ids


def test_ids_of_every_plain_character():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    plain = [c for c in map(chr, range(0x250)) if packing.PLAIN.fullmatch(c)]
    assert len(plain) > 400
    capitals = [c for c in map(chr, range(0xC0, 0x250)) if c.isupper()]
    texts = [x for c in [*plain, *capitals] for x in (c, f"{c}liyev", f"mo{c}tu {c}{c} a{c}1", f"KO{c}")] + ["Əliyev", "Ɛyɛ Ɔkyerɛ", "Ƙasar Ɓauna da Ɗan"]
    for x, ids in zip(texts, words.encode(texts), strict=True):
        assert ids.tolist() == whole.encode(x, add_special_tokens=False).ids, x


def test_sum_of_squares_choice():
    r = random.Random(4)
    packer = packing.Packer(lambda pieces: None, window=20)
    for _ in range(300):
        size, counts = r.randint(1, 19), packer.counts.copy()

        def cost(level):
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + size < 20:
                after[level + size] += 1
            return int((after * after).sum())

        options = [0, *[h for h in range(1, 21 - size) if counts[h]]]
        assert cost(packer.best_level(size)) == min(map(cost, options))
        packer.place((None, 0, np.zeros(size, np.uint32), size))


# 8


def plain_removal(texts, length):
    bodies = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(b[p : p + length] for _, b in bodies for p in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = set()
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone.update(range(p, p + length))
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        out.append((i, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length,anchor,most_kinds", [(12, 6, 2000), (12, 6, 1), (12, 6, 3), (40, 20, 2000)])
def test_repeats(spark, length, anchor, most_kinds):
    r = random.Random(length)
    passage = "".join(r.choice("abcdefgh é") for _ in range(90))
    texts = [(k, "".join(r.choice("ab") for _ in range(r.randint(0, 50))) + (passage[r.randint(0, 20) :] if k % 3 == 0 else "")) for k in range(40)]
    texts += [(100, None), (101, ""), (102, "a" * 60), (103, texts[0][1]), (103, texts[0][1])]
    df = docs_of(spark, texts).withColumns({"uid": F.lit(1), "g": F.lit(2), "starts": F.lit(3)})
    got = repeats.remove_repeats(df, length=length, anchor=anchor, most_kinds=most_kinds).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == plain_removal(texts, length)
    assert all((r["kept"] is None) == (r["n_spans"] == 0) for r in got)


def test_stretches_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 40)
    r = random.Random(12)
    texts = ["".join(r.choice("ab") for _ in range(n)).encode() for n in (0, 11, 12, 39, 40, 41, 80, 200)]
    found = Counter()
    roll = repeats.Rolling(1)
    for k, lo, hi, _, _ in repeats.ranges(texts, roll, 12, 6):
        for a, b, c in zip(k.tolist(), lo.tolist(), hi.tolist(), strict=True):
            found.update((a, p) for p in range(b, c + 1))
    assert found == Counter((k, p) for k, t in enumerate(texts) for p in range(len(t) - 11))
    hashes = lambda lo, hi: np.concatenate(list(repeats.window_hashes(roll, np.frombuffer(texts[-1], np.uint8), lo, hi, 12)))
    assert hashes(3, 150).tolist() == np.concatenate([hashes(p, p) for p in range(3, 151)]).tolist()


def test_repeats_query_at_production_length(spark, tmp_path):
    r = random.Random(13)
    words = [f"w{k}" for k in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [say(110) for _ in range(3)]
    texts = [(k, f"{say(r.randint(0, 40))} {passages[k % 3][: r.randint(300, 450)]} {say(r.randint(0, 40))}") for k in range(24)]
    texts += [(50, None), (51, ""), (52, passages[0] * 3), (53, texts[0][1])]
    short = [" ".join(r.choice("abcdefgh") for _ in range(60)) for _ in range(4)]
    texts += [(60, f"{say(30)}\n{short[0]} {say(9)}"), (61, short[0].replace(" ", " \t")), (62, f"{say(20)} {' '.join(short[1].split()[:39])} {say(20)}"), (63, short[1]), (64, f"{short[2]} {short[2]}"), (65, short[3])]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = repeats.op8_repeats(spark, str(tmp_path))
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows(got.select(got.columns[:5])) == plain_removal(texts, 400)
    shared = {x["doc_id"]: x["n_shared"] for x in got.collect()}
    held = {i: {tuple(ws[k : k + n]) for ws in [(t or "").split()] for n in (40, 50) for k in range(len(ws) - n + 1)} for i, t in texts}
    for i in held:
        common = {g for j in held if j != i for g in held[i] & held[j]}
        assert (shared[i] > 0 or not any(len(g) == 50 for g in common)) and (shared[i] == 0 or common), i
    assert shared[60] and shared[61] and not shared[62] and not shared[63] and not shared[64] and not shared[65]


def test_phrases_of_long_texts(monkeypatch):
    """Cut into stretches or not, the same strings are chosen."""
    r = random.Random(14)
    texts = [" ".join("x" * r.randint(1, 9) + str(r.randint(0, 99)) for _ in range(n)).encode() for n in (0, 5, 49, 50, 51, 400, 3000)]
    roll = repeats.Rolling(1)
    pairs = lambda: {p for k, g in repeats.phrases(texts, roll) for p in zip(k.tolist(), g.tolist(), strict=True)}
    whole = pairs()
    monkeypatch.setattr(repeats, "CHUNK", 1500)
    assert pairs() == whole and {k for k, _ in whole} == {3, 4, 5, 6}
    assert list(repeats.phrases([b"y" * 5000 + b" z" * 60], roll))


def test_repeats_empty(spark):
    assert rows(repeats.remove_repeats(docs_of(spark, EMPTY))) == []


# 9


def test_top_k(spark):
    r = np.random.default_rng(6)
    vectors = [(k, [float(x) for x in r.integers(-3, 4, 5) / 4]) for k in range(120)]
    vectors += [(50, vectors[3][1]), (100, vectors[100][1]), (100, vectors[100][1]), *[(61, vectors[50][1])] * 9, (7, vectors[7][1]), (None, vectors[0][1]), (200, None), (201, []), (250, [1.0, None]), (251, [float("nan")] * 5), (300, [1.5, -2.0]), (301, [0.5, 100.0]), (302, [float("inf")] * 5)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit(2), "block": F.lit(3)})
    got = rows(topk.top_k(df, F.col("vec_id") % 50 == 0, k=4, block=16, queries=2))
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, a in good:
        if q is not None and q % 50 == 0:
            rest = list(good)
            rest.remove((q, a))
            found = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i is None, i or 0) for i, b in rest if len(a) == len(b)))[:4]
            expected += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(found)]
    assert got == sorted(expected, key=repr)
    assert rows(topk.top_k(spark.createDataFrame(EMPTY, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)) == []


# 10


def plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_base_kinds():
    r = random.Random(9)
    texts = ["".join(r.choice("ab.@+-0123456789 9().1") for _ in range(r.randint(0, 60))) for _ in range(5000)]
    for text in [*texts, "4111 1111 1111 1111", "a.b@c.d@e.f.g", "256.1.1.1 001.02.3.4", "é +1 (456) 555-2186"]:
        assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE] == plain_base(text)


def test_pii_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    kinds = lambda text: [s[0] for s in pii.spans(text) if s[0] in pii.ADDED]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("number 123-45-6789") == [] and kinds("ssn 123-45-6789") == ["ssn"] and kinds("ssn 666-45-6789") == []
    assert kinds("555-123-4567") == [] and kinds("call 555-123-4567") == ["local_phone"]


@pytest.mark.parametrize("text", ["a" * 100_000, "1" * 100_000, "1 " * 50_000, "a@" * 50_000, "1." * 50_000, "+1" * 50_000, "A1" * 50_000, "a." * 50_000 + "@"])
def test_pii_takes_linear_time(text):
    pii.spans(text)


def test_pii_query_against_a_plain_version(spark, tmp_path):
    """The query's rows over whole texts: counts, digest and written spans."""
    r = random.Random(11)
    texts = [(k, "".join(r.choice(["a.b@c.de ", "4111 1111 1111 1111 ", "1.2.3.4 ", "+1 (456) 555-2186 ", "999.1.1.1 ", "é word ", "ssn 123-45-6789 ", "DE89370400440532013000 "]) for _ in range(r.randint(0, 30)))) for k in range(40)]
    docs_of(spark, [*texts, (100, None), (101, ""), (None, "x@y.z"), (102, "word " * 50_000 + "q@r.st")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in pii.op10_pii(spark, str(tmp_path)).collect()}
    for i, t in [*texts, (100, ""), (101, ""), (None, "x@y.z"), (102, "word " * 50_000 + "q@r.st")]:
        order = {k: n for n, k in enumerate(pii.BASE)}
        base = sorted(plain_base(t), key=lambda s: (order[s[0]], s[1]))
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert {k: got[i][f"n_{k}"] for k in pii.BASE} == {k: sum(s[0] == k for s in base) for k in pii.BASE}
        assert [s for s in got[i]["spans"].split(",") if s.split(":")[0] in pii.BASE] == written


def test_pii_rows(spark):
    texts = [(1, "x a@b.c y"), (1, "x a@b.c y"), (2, None), (3, ""), (None, "1.2.3.4")]
    got = rows(pii.find_pii(docs_of(spark, texts).withColumn("spans", F.lit(1))))
    assert [(r[0], [tuple(s)[:3] for s in r[1]]) for r in got] == [(1, [("email", 2, 7)]), (1, [("email", 2, 7)]), (2, []), (3, []), (None, [("ip", 0, 7)])]
    assert rows(pii.find_pii(docs_of(spark, EMPTY))) == []
