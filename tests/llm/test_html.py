import random

from loomline.llm.html_extract import expression, extract, extract_alone, extract_pages, load_rules, merge, page_tree, rules, signature

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">x</a></li><li><a href="/y">y</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p><b>One  two&nbsp;three.<br><p>Second
para &lt;x&gt;.</p><ul><li>item 1<li>item 2</ul><aside>related</aside><form>mail <input></form></article>
<section id="comments"><article class="comment"><p>Nice post</p></article></section><footer>&copy; host</footer>"""
WANT = "Head & line\nOne two three.\nSecond para <x>.\nitem 1\nitem 2"


def of_host(pages):
    wrapper = page_tree(pages[0])
    for p in pages[1:]:
        wrapper = merge(wrapper, page_tree(p))
    rule = load_rules(rules(wrapper))
    return [extract(p, rule) for p in pages]


def test_extract_with_own_wrapper():
    assert extract_alone(PAGE) == WANT


def test_wrapper_is_union_free_and_order_free():
    other = PAGE.replace("<ul><li>item 1<li>item 2</ul>", "<table><tr><td>a</td></tr></table>").replace("Second", "Another")
    third = PAGE.replace("<ul><li>item 1<li>item 2</ul>", "<p>one<p>two")
    trees = [page_tree(x) for x in (PAGE, other, third)]
    one, two = expression(merge(merge(trees[0], trees[1]), trees[2])), expression(merge(trees[2], merge(trees[1], trees[0])))
    assert "(<table>" in one and ")?" in one and "(<p>#</>)+" in one and "(<h1>=</>)" in one and sorted(one) == sorted(two)


def test_unmarked_page_takes_the_dense_part():
    page = "<body><div class='menu'><a>a</a></div><div><p>" + "long text " * 50 + "</p><p>more</p></div><div><a href=x>link</a></div></body>"
    assert extract_alone(page).startswith("long text")


ABOUT = "About this site we say the same long words on every page of it. " * 12


def site(i, rng, about=ABOUT):
    """A page of a template without marks, and the text of its article."""
    words = lambda n: " ".join(rng.choices("abcde fghi jklmno pqr stu vw xyz".split(), k=n))
    parts = [f"Title {i} {words(3)}", *(words(rng.randint(5, 30)) for _ in range(rng.randint(1, 6)))]
    links = "".join(f"<a href=/{k}>{words(2)}</a> " for k in range(rng.randint(3, 9)))
    article = f"<h2>{parts[0]}</h2>" + "".join(f"<p>{x}</p>" for x in parts[1:-1]) + f"<blockquote>{parts[-1]}</blockquote>"
    return f"<body><div>{about}</div><div>{article}<div>{links}</div><section>Kept up by volunteers.</section></div><div>Terms and more terms</div></body>", "\n".join(parts)


def test_wrapper_tells_template_from_article():
    rng = random.Random(1)
    pages, want = zip(*(site(i, rng) for i in range(12)))
    assert of_host(list(pages)) == list(want)
    assert of_host(list(reversed(pages))) == list(reversed(want))
    # Without the host the template cannot be told: the wrapper decides the result.
    assert all(extract_alone(p) != w for p, w in zip(pages, want)) and extract_alone(pages[0]).startswith("About this site")


def test_template_text_inside_a_marked_article():
    pages = [f"<article><h1>Head {i}</h1><div>Read our magazine every week</div><p>Words {i * 7}</p><p>{'more' * i}</p></article>" for i in range(5)]
    out = of_host(pages)
    assert out[2] == "Head 2\nWords 14\nmoremore" and "magazine" in extract_alone(pages[2])


def test_copies_tell_nothing_about_the_template():
    same = "<body><div>menu {}</div><article><h1>One story</h1><p>told once</p></article></body>"
    assert of_host([same.format(i) for i in range(6)]) == ["One story\ntold once"] * 6
    assert of_host([PAGE] * 5) == [WANT] * 5
    two = ["<main><p>Opening words</p><p>first end</p></main>", "<main><p>Opening words</p><p>second end</p></main>"]
    assert of_host(two) == ["Opening words\nfirst end", "Opening words\nsecond end"]


def test_broken_markup_leaks_and_loses_nothing():
    for page, want in [
        ('<article><p>hello</p><p class="x', "hello"),
        ('<article><p title="5" tall">one', "one"),
        ('<article><p>a <a href=x title="q>link</a> b</p><p>c "d</p>', 'a link b\nc "d'),
        ('<article><p>a <a title="q>link</a> b</p><p>c " d</p></article>', 'a link b\nc " d'),
        ("<article><p title='it's'>one</p><p>it's two</p>", "one\nit's two"),
        ('<article><p title="a > b" data-x="<b>y</b>">one</p>', "one"),
        ("<article><p>1 < 2 and 3 > 2, <3</p><p/ x>two<p <b>three</b></article>", "1 < 2 and 3 > 2, <3\ntwo\nthree"),
        ("<article><p>x</p></ul></p>y</div></article>z", "x\ny"),
        ("<article><p>&lt;b&gt; &#8212; &copy &nosuch;</p>", "<b> \u2014 \u00a9 &nosuch;"),
        ('<article><p>' + 'a "b\' ' * 20_000 + "</p></article>", ("a \"b' " * 20_000).strip()),
        ("<article><p a=" + "\"'" * 20_000 + "<i>end", "end"),
    ]:
        assert extract_alone(page) == want, page[:80]


def test_names_that_only_hold_a_word_of_a_menu():
    for name, stays in [("social-history", True), ("register", True), ("has-sidebar", True), ("the-ad-hoc-method", True), ("cookie-notice", False), ("ad-300x250", False), ("site-footer", False), ("comments", False), ("main-nav", False)]:
        page = f"<article><p>one</p><div class='{name}'>two</div></article>"
        assert extract_alone(page) == ("one\ntwo" if stays else "one"), name
    assert signature("body", ' class="footer"') == "body"


def test_table(spark):
    rows = [(1, "http://h.org/a", PAGE, "t"), (2, "http://h.org/b", PAGE, "t"), (2, "http://h.org/b", PAGE, "t"), (3, None, None, "t"), (4, "x", "", "t"), (5, "http://g.org", "<div>" * 3000 + "deep" + "</div>" * 10, "t"), (6, "http://z.org/", "<p>un<b>closed", "t"), (7, "http://h.org/c", "plain words", "t")]
    out = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert len(out) == 7 and out[1].text == out[2].text == WANT and out[1].n_chars == len(WANT)
    assert out[3].text == out[4].text == "" and out[5].text == "deep" and out[6].text == "unclosed" and out[7].text == "plain words"
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_nesting_has_no_limit():
    for depth in (50, 130, 20_000):
        deep = "<div>" * depth + "inner" + "</div>" * depth
        page = f"<body><article><p>first</p>{deep}<p>last</p></article><div>outside</div></body>"
        assert extract_alone(page) == "first\ninner\nlast"
        inner = "<div>" * depth + "<script>var x;</script><nav>menu</nav><form>mail</form>text" + "</div>" * depth
        page = f"<article>{inner}</article>"
        assert extract_alone(page) == "text"
        assert expression(merge(page_tree(page), page_tree(page))).count("<div>") == depth


def test_unclosed_inline_tags_do_not_end_the_article():
    page = "<article>" + "<div><b>bold<i>more" * 100 + "</div>" * 100 + "<p>rest</p></article><div>outside</div>"
    assert extract_alone(page).endswith("\nrest")


def test_deep_wrappers_pass_between_tasks(spark):
    page = "<main>" + "<div>" * 6000 + "<p>deep words</p>" + "</div>" * 6000 + "<p>last</p></main>"
    rows = [(i, "http://d.org/", page) for i in range(4)]
    out = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert [r.text for r in out] == ["deep words\nlast"] * 4


def test_generated_hosts(spark):
    """Whole hosts against what their generator wrote, over any partitions."""
    rng, rows, want = random.Random(9), [], {}
    for host in ("a.org", "b.org"):
        for i in range(40):
            page, text = site(i, rng, about=f"{host} " + ABOUT)
            want[len(rows)] = text
            rows.append((len(rows), f"https://{host}/{i}", page))
    for parts in (1, 9):
        out = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()
        assert {r.page_id: r.text for r in out} == want and all(r.n_chars == len(r.text) for r in out)
