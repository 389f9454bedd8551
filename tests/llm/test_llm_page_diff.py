import random
from collections import Counter, defaultdict

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import page_diff as D
from kindred.llm.markup import BESIDE, MAYBE, NO, YES, lines_of


def test_markup_speaks_for_itself():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar">
    <nav><ul><li>Home<li>More</ul></nav><div class="ad-slot">Buy</div><header>Site</header>
    <article class="post comments-open"><header><h1>Head &amp; line</h1></header><p>One<br>two &nbsp; <b>three<p>Four <!-- no > -->five
    <div class="share-bar">tweet</div><figure><figcaption>cap</figcaption></figure><form>mail me<input></form></article>
    <section id="comments"><p>first!</section><footer>&copy; x</footer><p>loose"""
    lines, kinds = lines_of(page)
    assert [x for x, k in zip(lines, kinds, strict=True) if k == YES] == ["Head & line", "One two three", "Four five", "cap"]
    assert MAYBE not in kinds and "loose" in lines and kinds[lines.index("first!")] == NO


def test_pages_without_article_leave_lines_open():
    lines, kinds = lines_of('<div id="menu">A</div><div class=content><p>B<table><tr><td>c<td>d</table></div><div style="display: none">E</div><p hidden>F</p>tail <')
    assert dict(zip(lines, kinds, strict=True)) == {"A": NO, "B": MAYBE, "c d": MAYBE, "E": NO, "F": NO, "tail <": MAYBE}
    assert lines_of("") == ([], []) and lines_of("<p") == (["<p"], [MAYBE])
    assert lines_of("<script>never closed <p>x") == ([], [])


def test_wrappers_around_most_of_the_text_do_not_lose_it():
    of = lambda page: dict(zip(*lines_of(page), strict=True))
    body = "<nav>menu</nav><article><p>The <b>long</b> text of the page</article><p>loose"
    for wrapper in ("form id=aspnetForm", "div class='content has-sidebar'", "div class='page sidebar'"):
        assert of(f"<{wrapper}>{body}</{wrapper.split()[0]}><footer>foot</footer>") == {"menu": NO, "The long text of the page": YES, "loose": BESIDE, "foot": NO}
    assert of("<form><p>The <b>long</b> text</p></form><div class=ad>Buy</div>") == {"The long text": MAYBE, "Buy": NO}
    comments = "".join(f"<article class=comment>reader {k}</article>" for k in range(9))
    assert of(f"<div>The text itself</div><div id=comments>{comments}</div>") == {"The text itself": MAYBE, **{f"reader {k}": NO for k in range(9)}}
    assert set(of(f"<article class=post>The text {comments}</article>").values()) == {YES, NO}
    assert of("<div class=ad>An advert longer than the text</div><article>Text</article>") == {"An advert longer than the text": NO, "Text": YES}
    assert of("<article>Teaser</article><div class='content sidebar-right'>The long text</div>") == {"Teaser": YES, "The long text": BESIDE}
    assert of("<div class=ad>a</div><div class=promo>b</div>") == {"a": MAYBE, "b": MAYBE}


def test_lines_beside_an_article_are_differenced(spark):
    page = lambda k: f"<div>site name</div><div>lead {k}</div><form><article><p>shared words of the article<p>text {k}</article></form><div>imprint</div>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(3)]
    got = D.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: f"lead {k}\n\nshared words of the article\n\ntext {k}" for k in range(3)}


def test_pages_told_apart_by_query_are_differenced(spark):
    page = lambda k: f"<div>menu</div><div>text {k}</div><div>foot</div>"
    urls = {1: "?id=1", 2: "?id=1&copy=2", 3: "?id=2", 4: "?id=3#x", 5: "?id=3"}
    rows = [(k, f"http://q.example/index.php{u}", page({2: 1, 5: 4}.get(k, k))) for k, u in urls.items()]
    rows += [(6, "http://lone.example/?id=1", page(6)), (7, "http://lone.example/?id=2", page(6)), (8, "http://lone.example/?id=2", page(8))]
    rows += [(9, "http://once.example/x?id=1", page(9)), (10, "http://once.example/x?id=1", page(10))]
    got = D.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {1: "text 1", 2: "text 1", 3: "text 3", 4: "text 4", 5: "text 4", 6: "text 6", 7: "text 6", 8: "text 8"}
    want |= {k: f"menu\n\ntext {k}\n\nfoot" for k in (9, 10)}
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)


def test_paths_and_pages_of_many_rows_are_cut(spark, monkeypatch):
    """One path of one host, a third of its pages equal, and a path of many pages beside another: the same texts with and without cutting."""
    page = lambda k: f"<div>menu</div><div>text {k}</div><div>foot</div>"
    rows = [(k, f"http://q.example/index.php?id={k:02d}", page(0 if k % 3 == 0 else k)) for k in range(30)]
    rows += [(None, "http://two.example/a", page(f"a{k}")) for k in range(20)] + [(40, "http://two.example/b", page("b"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = Counter((k, url, html.split("<div>")[2].removesuffix("</div>")) for k, url, html in rows)
    for hot in (1, 1000):
        monkeypatch.setattr(D, "HOT", hot)
        assert Counter(map(tuple, D.main_text(frame).collect())) == want
    keyed = spark.createDataFrame([(k % 2, k) for k in range(50)], "key int, n int")
    groups = spark.createDataFrame([(0, "even"), (5, "none")], "key int, name string")
    monkeypatch.setattr(D, "HOT", 1)
    got = D.met_in_parts(keyed, groups, ["key"], ["n"], keyed, 50)
    assert sorted(map(tuple, got.select("n", "name").collect())) == [(k, None if k % 2 else "even") for k in range(50)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-pdivarticle \"'=&;x\n", max_size=80))
def test_any_input_is_taken(page):
    lines, kinds = lines_of(page)
    assert len(lines) == len(kinds) and all(x == " ".join(x.split()) != "" for x in lines)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    on = [x for x, s in zip(a, D.shared_lines(a, b), strict=True) if s]
    rest = iter(b)
    assert len(on) == best[-1][-1] and all(x in rest for x in on)


def test_lines_that_stand_very_often_are_aligned_like_others():
    rng = random.Random(4)
    a = [rng.choice([1, 1, 1, 2, 3]) for _ in range(4000)]
    b = [rng.choice([1, 1, 1, 2, 4]) for _ in range(3500)]
    best = np.zeros(len(b) + 1, int)
    for x in a:
        match = np.concatenate([[0], best[:-1] + (np.array(b) == x)])
        best = np.maximum.accumulate(np.maximum(best, match))
    on = [x for x, s in zip(a, D.shared_lines(a, b), strict=True) if s]
    rest = iter(b)
    assert len(on) == best[-1] and all(x in rest for x in on)
    assert D.shared_lines([1] * 5, [1] * 3).sum() == 3


def pages():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        host, path = f"h{rng.choice([0, 0, 0, 0, 1, 2, 3])}.example", f"/{rng.choice(['a', 'b', 'ab'])}/{rng.randrange(60)}"
        lines = [f"menu {k} of {host}" for k in range(rng.randrange(5))] + [f"own line {i} {k}" for k in range(rng.randrange(5))] + [f"foot {host}"]
        tag = rng.choice(["div", "p"])
        body = "".join(f"<{tag}>{x}</{tag}>" for x in lines)
        rows.append((i, f"http://{host.title()}{path}?q={i}", body if rng.random() < 0.8 else f"<nav>menu 0 of {host}</nav><article>{body}</article>"))
    rows += [(900, None, None), (901, "", ""), (902, "http://lone.example/x", "<p>only &lt;</p>"), (None, "http://h1.example/zz", "<p>null id</p>")]
    return rows + [rows[0], (903, rows[1][1], rows[1][2])]


def test_differencing_matches_brute_force(spark):
    rows = pages()
    low = lambda d: -1 if d is None else d
    by_path = defaultdict(list)
    for pid, url, html in rows:
        lines = lines_of(html or "")[0]
        by_path[D.host_and_path(url or "")].append((low(pid), D._hashes(lines), lines))
    order = sorted(by_path)
    near = {}
    for k, key in enumerate(order):
        options = [(D._common(key[1], order[o][1]), first, order[o]) for o, first in ((k - 1, 1), (k + 1, 0)) if 0 <= o < len(order) and order[o][0] == key[0]]
        near[key] = max(options)[2] if options else None
    want = Counter()
    for pid, url, html in rows:
        lines, kinds = lines_of(html or "")
        other = near[D.host_and_path(url or "")]
        other = max(by_path[other])[2] if other else []
        shared = D.shared_lines(lines, other)
        keep = [x for x, k, s in zip(lines, kinds, shared, strict=True) if (k == YES if MAYBE not in kinds else k == MAYBE and not s)]
        want[pid, url, "\n\n".join(keep)] += 1
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows], "page_id long, url string, html string, host string, lines string").repartition(5)
    for parts in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = D.main_text(frame).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert Counter(map(tuple, got)) == want
    assert D.main_text(frame.where("false")).count() == 0
