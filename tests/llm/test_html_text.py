import random
import time

import pyarrow as pa
import pytest

from narrata.llm import html_text as H


def test_parse_keeps_the_article_only():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><header>Site</header>"
        "<div class='cookie-notice'>Cookies</div><article><h1>Head &amp; more</h1><p>One<b>two</b>&nbsp; three<br>four<p>five"
        "<script>var t='</p>';</script><div class='comments'><p>nice</p></div><aside>see also</aside><form>f</form></article><footer>&copy;</footer></body>"
    )
    article, silent, side, marked, _ = H.parse(page)
    assert marked and article == ["Head & more", "Onetwo three", "four", "five"] and silent == []
    assert "nice" in side and "Cookies" in side


def test_unclosed_and_empty():
    assert H.parse("") == ([], [], [], False, [])
    assert H.parse("plain 1 < 2 text")[1] == ["plain 1 < 2 text"]
    assert H.parse("<script>never ends")[:3] == ([], [], [])


def main_of(html):
    return " ".join(H.parse(html)[0])


def test_what_belongs_to_an_article():
    assert main_of('<article>Main</article><article class="comment">bad</article>') == "Main"
    assert main_of("<article><header>Site head</header><header><h1>T</h1> by A</header><p>x</article>") == "T by A x"
    assert main_of('<article><p class="promo">Buy<p>Article text<ul><li class="share">Share<li>item</ul><p>end</article>') == "Article text item end"
    assert main_of('<article><section class="related-work">Work</section><b class="alert">look</b><div class="cookie-box">c</div></article>') == "Work look"
    assert main_of("<article><table><tr><td class=ad>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl></article>") == "b c d e"
    assert main_of("<article><p>a<footer>f<p>g</footer><p hidden>h<p>i</article>") == "a i"


@pytest.mark.parametrize("mark", ["class=reader-comments", "class='user-comments'", "class=article-share", "class=entry-related", "class=ad-container-inline", "class=advertisement-label", "class='x cookie-banner-v2'", "class=sidebar-1", "id=google_ads_1"])
def test_names_with_words_beside_a_mark(mark):
    assert main_of(f"<article><p>Text<div {mark}><p>other</div><p>end</article>") == "Text end"


def test_links_named_for_search_are_text():
    assert main_of('<article>Search <a class="search">for</a> text</article>') == "Search for text"


def test_doubtful_blocks_of_an_article_go_by_the_hosts_repeats(spark):
    promo = "<div class='signup-walrus'><p>get every letter of ours by mail each week for free</div>"
    same = "<p>a sentence of the story that two stories of one host both tell"
    pages = [
        (1, "http://a.example/1", f"<article><p>Boats{same}{promo}</article>"),
        (2, "http://a.example/2", f"<article>{promo}<p>Hills{same}</article>"),
        (3, "http://b.example/3", f"<article><p>Seas{promo}</article>"),
        (4, "http://a.example/4", "<article><p>Woods<div class='related-work'>what others wrote about woods and trees before this page did</div></article>"),
        (5, "http://a.example/5", "<nav>Menu</nav>"),
        (6, "http://c.example/6", f"<article><p>One story{promo}</article>"),
        (7, "http://c.example/7", f"<article><p>One story{promo}</article>"),
    ]
    got = H.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == brute(pages, 8)
    texts = {r.page_id: r.text for r in got}
    sentence, letter = "a sentence of the story that two stories of one host both tell", "get every letter of ours by mail each week for free"
    assert texts[1] == f"Boats {sentence}" and texts[2] == f"Hills {sentence}"
    assert texts[3] == f"Seas {letter}" and texts[4].endswith("page did") and texts[6] == texts[7] == f"One story {letter}"
    assert all(r.marked for r in got if r.page_id != 5)


def test_no_page_takes_long():
    began = time.monotonic()
    for part in ('<foo "a b" ', "<a ", "<p>x</b>", '<foo "', "<li>", "<div>", "<!--", "<", "<header>", "<li><b>", "<script>", "</p>", "<p><table>", "&#"):
        H.parse(part * 20_000)
        H.parse(part * 20_000 + ">")
    assert time.monotonic() - began < 20


def brute(pages, depth):
    """Main texts by comparing all beginnings of all pages of a host in memory."""
    parsed = [(i, u, *H.parse(h or "")) for i, u, h in pages]
    parsed = [(i, u, a, [(b, k) for b, k in zip(a, d, strict=True)] if m and any(d) else [] if m else [(b, True) for b in s], s + o if m else o, m, d, s) for i, u, a, s, o, m, d in parsed]
    streams = [(H.host_of(u or ""), tuple(H.stream([b for b, _ in j]) + H.stream(o))) for _, u, _, j, o, *_ in parsed]
    about = [" ".join(b for b, k in zip(a, d, strict=True) if not k) if m else max(s, key=lambda b: (len(b), b), default="") for _, _, a, _, _, m, d, s in parsed]
    seen = {}
    for content, (host, tokens) in zip(about, streams, strict=True):
        for k in range(len(tokens) - depth + 1):
            seen.setdefault((host, tokens[k : k + depth]), set()).add(content)
    out = []
    for (i, _, a, j, _o, m, *_), (host, tokens) in zip(parsed, streams, strict=True):
        covered = {k + d for k in range(len(tokens) - depth + 1) if len(seen[host, tokens[k : k + depth]]) > 1 for d in range(depth)}
        at, kept = 0, []
        for block, open_ in j:
            n = len(block.split())
            kept += [block] if not open_ or set(range(at, at + n)) - covered else []
            at += n + 1
        out.append((i, " ".join(kept if j else a if m else [])))
    return sorted(out, key=str)


def test_shared_passages_of_a_host_go(spark):
    line = "<p>Please read our terms of use before you go on with this page</p>"
    pages = [
        (1, "http://a.example/1", f"<body>{line}<p>Unique story about boats</p></body>"),
        (2, "http://a.example/2", f"<body><p>Another tale of hills</p>{line}</body>"),
        (3, "http://b.example/3", f"<body>{line}</body>"),
        (4, "http://a.example/4", "<body><article><p>" + "same words here " * 20 + "</p></article></body>"),
        (5, "http://a.example/5", "<body><article><p>" + "same words here " * 20 + "</p></article></body>"),
        (6, None, None),
        (6, None, None),
        (7, "http://c.example/7", "<ul><li>First<li>Second</ul><p>" + "one article told twice in two places " * 3),
        (8, "http://c.example/8", "<ul><li>Third<li>Fourth</ul><p>" + "one article told twice in two places " * 3),
        (10, "http://a.example/10", "<p>Long story about the sea. Please read our terms of use before you go on with this page of mine"),
        (None, "http://a.example/9", ""),
    ]
    df = spark.createDataFrame([(*p, 1, "c") for p in pages], "page_id long, url string, html string, row int, text string")
    got = H.main_text(df)
    assert sorted(((r.page_id, r.text) for r in got.collect()), key=str) == brute(pages, 8)
    texts = {r.page_id: r.text for r in got.collect()}
    assert texts[1] == "Unique story about boats" and "terms of use" in texts[3] and texts[4] == texts[5] != ""
    assert texts[7].endswith("two places") and texts[8].startswith("Third Fourth one article") and "terms of use" in texts[10]
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert H.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<p><button>" + "<div>" * 100_000, "<ul><li>" + "<div>" * 100_000 + "<li>" * 50_000, "<p>" + "<table><p>" * 50_000])
def test_time_of_open_elements_grows_with_the_page(page):
    began = time.process_time()
    H.parse(page)
    assert time.process_time() - began < 8


def test_neighbours_of_the_sorted_suffixes_form_intervals():
    rnd = random.Random(3)
    for _ in range(200):
        rows = sorted({(bytes([rnd.randint(0, 6)]) * rnd.choice([3, 4]), rnd.randint(0, 4)) for _ in range(rnd.randint(0, 40))})
        pages = {}
        for suffix, page in rows:
            pages.setdefault(suffix, set()).add(page)
        cuts = sorted(rnd.choices(range(len(rows) + 1), k=4))
        found = {}
        for run in (rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True)):  # ranges of the sort
            at = sorted(rnd.choices(range(len(run) + 1), k=2))
            batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in b], pa.binary()), pa.array([p for _, p in b], pa.int64())], names=["suffix", "page"]) for b in (run[i:j] for i, j in zip([0, *at], [*at, len(run)], strict=True))]
            given = [r for out in H.repeats(iter(batches)) for r in out.to_pylist()]
            assert len({r["suffix"] for r in given}) == len(given) and sum(r["pages"] < 2 for r in given) <= 2
            for r in given:
                found[r["suffix"]] = found.get(r["suffix"], 0) + r["pages"]
        assert {k: n for k, n in found.items() if n > 1} == {k: len(p) for k, p in pages.items() if len(p) > 1}


def test_suffixes_sort_by_host_and_token():
    tokens = "a b a b a c".split()
    found = H.open_suffixes(b"hosthost", tokens, 2)
    assert len(found) == 5 and found[0] == found[2] != found[4] and all(k.startswith(b"hosthost") and len(k) == 16 for k in found)
    assert found[0][:12] == found[4][:12]  # a common prefix of one token
    assert H.open_suffixes(b"hosthost", ["a"], 2) == []
    kept = H.block_suffixes(b"hosthost", ["a b c", "a", "a b d", "a b", "a b c"], {4}, 2)
    assert [k for k, _ in kept] == [0, 2, 3] and len({key for _, key in kept}) == 3 and len({key[:16] for _, key in kept}) == 1


def test_notices_in_plain_paragraphs_of_articles_go(spark):
    notice, shared, short = "please read our terms of use before you leave", "a line of the story that half of the articles tell", "Read on"
    words = "boats hills seas woods lakes roads towns birds stones clouds rivers fields".split()

    def article(k, lines):
        return f"<nav>Menu</nav><article><h1>About {words[k]}</h1><p>{words[k]} are what this article tells of and of nothing else" + "".join(f"<p>{x}" for x in lines) + "</article>"

    pages = [(k, f"http://a.example/{k}", article(k, [notice, short] + [shared] * (k % 2) + ["last words"] * (k % 3))) for k in range(12)]
    pages += [(100 + k, f"http://few.example/{k}", article(k, [notice])) for k in range(9)]
    pages += [(200 + k, f"http://copies.example/{k}", article(k % 3, [notice])) for k in range(12)]
    pages += [(300 + k, f"http://some.example/{k}", article(k, [notice] if k < 9 else [])) for k in range(12)]
    pages.append((400, "http://a.example/400", f"<body><p>{notice}<p>A page of its own</body>"))
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert sorted(got) == sorted(i for i, *_ in pages)
    whole = {i: " ".join(H.parse(h)[0]) for i, _, h in pages}
    for i, text in got.items():
        assert text == (f"{notice} A page of its own" if i == 400 else whole[i].replace(f" {notice}", "") if i < 100 else whole[i])
