import random
import time

from tallow.llm import wrappers as w


def page(body, extra=""):
    return f"<html><head><title>t</title><script>var x='</p><article>';</script></head><body><nav><ul><li><a>menu</a></li></ul></nav><div class='ad'>buy</div>{body}<aside>side</aside>{extra}<footer>foot</footer></body></html>"


def test_article_without_boilerplate(spark):
    body = "<article><h1>T &amp; U</h1><p>One\n  two&nbsp;three<b>bold</b> x<br>y<p>Second &lt;p&gt; &eacute;<div class='share-buttons'>tweet</div><ul><li>i1<li>i2</ul><form>f</form><!-- c --><script>no</script><section class='comments'>rude</section></article>"
    pages = spark.createDataFrame(
        [(1, "http://a.com/1", page(body), "c"), (2, "http://a.com/2", page("<article><p>Only</p></article>"), "c"), (3, None, None, "c"), (4, "x", "", "c"), (5, "http://b.com", "plain <b>text</b> only", "c"), (5, "http://b.com", "plain <b>text</b> only", "c")],
        "page_id long, url string, html string, text string",
    )
    got = w.extract(pages).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert by[1].text == "T & U\nOne two threebold x y\nSecond <p> é\ni1\ni2"
    assert by[2].text == "Only" and by[3].text == by[4].text == "" and by[5].text == "plain text only"
    assert all(r.n_chars == len(r.text) for r in got) and by[1].url == "http://a.com/1"
    assert w.extract(spark.createDataFrame([], pages.schema)).collect() == []


def test_region_is_inferred_from_the_pages_of_a_host(spark):
    rows = [(k, f"http://h.org/{k}", page(f"<div class='content'><p>{'long story ' * 30}{k}</p><p>more {k}</p></div><div class='links'><p>l{k}</p></div>")) for k in range(6)]
    got = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"{('long story ' * 30)}{k}".strip() + f"\nmore {k}" for k in range(6))


def test_alignment_is_union_free():
    tree = lambda h: w.skeleton(w.tree(h))
    a, b = tree("<div><p>x</p><p>y</p><i>z</i></div>"), tree("<div><p>x</p><u>q</u></div>")
    both = w.aligned(a, b)
    div = both[2][0]
    assert [c[0] for c in div[2]] == ["p", "i", "u"] and div[2][0][1] & 2 and div[2][1][1] & 1 and div[2][2][1] & 1
    assert w.unpacked(w.packed(both)) == both and w.aligned(both, a)[2][0][2][0][1] & 2


def test_groups_of_several_labels_are_folded():
    div = w.skeleton(w.tree("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p><h2>f</h2><p>g</p><ul><li>x</ul></div>"))[2][0]
    assert [c[0] for c in div[2]] == ["", "ul"] and div[2][0][1] & 2 and [c[0] for c in div[2][0][2]] == ["h2", "p"] and div[2][0][2][1][1] & 2
    assert w.aligned(div, w.skeleton(w.tree("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p></div>"))[2][0])[2][1][1] & 1


def test_long_pages_take_seconds(spark):
    began = time.perf_counter()
    alternating = "<article>" + "<h2>a</h2><p>b</p>" * 10_000 + "</article>"
    rnd = random.Random(1)
    mixed = ["<article>" + "".join(f"<{t}>x</{t}>" for t in rnd.choices(["p", "ul", "h2", "pre", "table"], k=20_000)) + "</article>" for _ in range(3)]
    rows = [(k, "http://long.org/x", page(h)) for k, h in enumerate([alternating, *mixed])]
    got = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].count("\n") == 19_999 and all(got[k].count("\n") == 19_999 for k in (1, 2, 3))
    assert time.perf_counter() - began < 60


def template(k, host="h.org"):
    words = f"story {k} " * 20
    return (k, f"http://{host}/{k}", page(f"<article><h1>T{k}</h1><p>{words}</p><div>All rights reserved. Terms apply.</div><div class='related-work'>work {k}</div><div class='social history'>past {k}</div><p>end {k}</p></article>"))


def test_constant_slots_are_the_template(spark):
    """With its wrapper a host's constant line goes; without one, or on too few pages, it stays.  Names of subjects are no marks."""
    want = lambda k, line: f"T{k}\n{(f'story {k} ' * 20).strip()}\n{line}work {k}\npast {k}\nend {k}"
    rows = [template(k) for k in range(6)] + [template(10 + k, "few.org") for k in range(3)]
    got = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    line = "All rights reserved. Terms apply.\n"
    assert all(got[k] == want(k, "") for k in range(6)) and all(got[10 + k] == want(10 + k, line) for k in range(3))
    assert w.main_text(rows[0][2], [], {}) == want(0, line)


def test_copies_of_a_page_are_no_template(spark):
    same = template(1)
    rows = [(k, same[1], same[2]) for k in range(8)]
    got = {r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 1 and got.pop().startswith("T1\nstory 1")


def test_result_is_that_of_a_slow_version_whatever_the_partitions(spark):
    """Constant slots by counting texts page by page; expressions of pages in any order and partitions."""
    rnd = random.Random(2)
    rows = []
    for k in range(60):
        host = f"h{k % 4}.org"
        parts = [f"<p>{rnd.choice('abcdef')} {k} words</p>" * rnd.randint(1, 4), "<div>constant line</div>" if k % 4 != 3 or rnd.random() < 0.5 else "<div>odd</div>", f"<section><p>x{k}</p></section>" * rnd.randint(0, 2), f"<ul><li>{k}</li></ul>"]
        rows.append((k, f"https://{host}/p", page(f"<article><h1>head</h1>{''.join(parts)}</article>")))
    schema = "page_id long, url string, html string"
    got = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, schema).repartition(1)).collect()}
    rnd.shuffle(rows)
    assert got == {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, schema).repartition(7)).collect()}
    for k, url, source in rows:
        mine = [h for _, u, h in rows if u == url]
        lines = w.main_text(source, ["html", "body", "article"]).split("\n")
        common = sum("<div>constant line</div>" in h for h in mine) >= 0.95 * len(mine)
        want = [x for x in lines if not (common and x == "constant line")]
        assert got[k].split("\n") == want


def test_names_that_are_marks():
    for name in ("ad", "ad-slot", "share buttons", "post_comments", "relatedPosts", "cookie-notice", "sidebar left"):
        assert w.marked(name), name
    for name in ("", "related-work", "social history", "share price", "comments-on-policy", "content", "main", "shared", "adventure"):
        assert not w.marked(name), name


def test_controls_in_a_sentence_stay():
    assert w.main_text("<article><p>Press <button>OK</button> or the <label>name</label> now.</p><button>Send</button><form><label>x</label></form></article>", []) == "Press OK or the name now."


def test_broken_markup_and_depth():
    deep = "<div>" * 5000 + "x" + "</div>" * 10
    for html in ("<", "<p", "<a href=\"x>y", "<!--", "<script>never", "&amp;&#x41;&bogus;", "</p></p><p>a", "<p a='>'>b", deep):
        w.main_text(html, [])
    assert w.main_text("<p a='>'>b", []) == "b" and w.main_text(deep, []) == "x"
    assert w.main_text("<p>" + "word " * 200_000, []) == ("word " * 200_000).strip()


def test_elements_below_any_depth_keep_their_place(spark):
    deep = "<div>" * 3000 + "<nav>menu</nav><p>inner</p><div class='ad'>buy</div>" + "</div>" * 3000
    html = f"<body><article><p>before</p>{deep}<p>after</p></article><p>outside</p></body>"
    assert w.main_text(html, []) == "before\ninner\nafter"
    rows = [(k, "http://deep.org/x", html.replace("inner", f"inner {k}")) for k in range(3)]
    got = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"before\ninner {k}\nafter" for k in range(3)}
    one = w.skeleton(w.tree(page(deep)))
    assert w.packed(w.unpacked(w.packed(one))) == w.packed(one)


def slow_common(p, q):
    """The length of a longest common subsequence, by the table."""
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i, x in enumerate(p):
        for j, y in enumerate(q):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequence_by_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        p, q = ("".join(rnd.choices("abcd", k=rnd.randint(0, 40))) for _ in range(2))
        got = w.common(list(p), list(q))
        assert all(p[i] == q[j] for i, j in got) and len(got) == slow_common(p, q)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))


def test_alignment_is_the_same_at_any_size():
    """Children that differ become optional ones, never repeated ones, however many there are."""
    names = lambda k, n: "".join(f"<{t}>x</{t}>" for t in random.Random(k).choices([f"x{i}" for i in range(2000)], k=n))
    for n, m in ((600, 400), (600, 600), (3000, 2500)):
        a, b = (w.skeleton(w.tree(f"<article>{names(k, x)}</article>"))[2][0] for k, x in ((1, n), (2, m)))
        both = w.aligned(a, b)
        assert all(c[0] for c in both[2]) and {c[1] & 1 for c in both[2]} == {0, 1}, (n, m)
        kept = slow_common([c[0] for c in a[2]], [c[0] for c in b[2]]) if n * m < 500_000 else len(w.common([(c[0],) for c in a[2]], [(c[0],) for c in b[2]]))
        n, m = len(a[2]), len(b[2])  # neighbours of one name are one child
        assert sum(not c[1] & 1 for c in both[2]) == kept and len(both[2]) == n + m - kept


def test_groups_of_any_number_of_labels_are_folded():
    for period in (2, 7, 40):
        row = "".join(f"<i{k}>x</i{k}>" for k in range(period))
        div = w.skeleton(w.tree(f"<div><b0>x</b0>{row * 5}<b1>x</b1></div>"))[2][0]
        assert [c[0] for c in div[2]] == ["b0", "", "b1"] and len(div[2][1][2]) == period and div[2][1][1] & 2


def test_names_are_looked_at_after_the_slots(spark):
    """An article in an element named like a share bar stays; comments and adverts beside an article go, though their texts vary."""
    body = lambda k: f"<div class='social'><h2>T{k}</h2><p>{f'long story {k} ' * 30}</p><div class='ad-slot'>buy {k}</div></div><p>by {k}</p>"
    plain = lambda k: f"<div class='story'><p>{f'short {k} ' * 5}</p></div><div class='comments'><p>{f'rude {k} ' * 15}</p></div>"
    tagged = lambda k: f"<article><p>few {k}</p></article><div class='comments'><p>{f'rude {k} ' * 50}</p></div>"
    rows = [(100 * n + k, f"http://{n}.org/{k}", page(f(k))) for n, f in enumerate((body, plain, tagged)) for k in range(6)] + [(900, "http://one.org/x", page(body(900)))]
    got = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(6):
        assert got[k].startswith(f"T{k}\nlong story {k} long") and "buy" not in got[k], got[k]
        assert got[100 + k] == (f"short {k} " * 5).strip() and got[200 + k] == f"few {k}"
    assert got[900].startswith("T900\nlong story")


def test_many_different_pages_of_a_host_meet_in_a_tree(spark):
    rnd = random.Random(6)
    rows = [(k, "http://a.org/x", page("<article>" + "".join(f"<{t}>w{k}</{t}>" for t in rnd.choices(["p", "ul", "h2", "pre"], k=8)) + "</article>")) for k in range(150)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = w.wrappers(frame, fan=4).collect()
    assert len(found) == 1
    got = {r.page_id: r.text for r in w.extract(frame).collect()}
    assert all(got[k].split("\n") == [f"w{k}"] * 8 for k in range(150))


def test_columns_with_names_of_the_operator(spark):
    frame = spark.createDataFrame([(1, "http://a.org/1", page("<article><p>Only</p></article>"), "h", "l", "c", 5, "s")], "page_id long, url string, html string, host string, labels string, constant string, id int, shape string")
    assert [tuple(r) for r in w.extract(frame).collect()] == [(1, "http://a.org/1", "Only", 4)]
