import html
import re
import time

import pytest

from pingscape.llm import catalog, html_text

CASES = [
    (None, ""), ("", ""), ("<p>", ""), ("plain  text\n", "plain text"), ("<div class=ad>x</div>", ""),
    ("<html><head><title>t</title><body><div id=nav><a href=x>a</a></div><div><p>Hello <b>wor</b>ld &amp; all.<p>Second para is here.</div><footer>f</footer>", "Hello world & all. Second para is here."),
    ("<body><article><h1>T</h1><p>One<br>two</p><form>f</form><script>if(a<b){}</script><style>p{}</style><!-- c --><section class='comments'>nice!</section><p>three</p></article><p>out</p></body>", "T One two three"),
    ("<body><header>site</header><main><header><h1>Head</h1></header><p>Body text of the page.</p></main><aside>side</aside></body>", "Head Body text of the page."),
    ("<div id='wrap'><div class='menu'><a>x</a></div><div id=main><p>Some good long text goes here and more.</p><p>More long text follows over here.</p><ul><li>one<li>two</ul></div><div id='comments'><p>nice post man this is a comment</p></div></div>",
     "Some good long text goes here and more. More long text follows over here. one two"),
    ("<a title=\"x>y\" href='q'>link</a> text <3 and 5<6 &lt;b&gt; & so &eacute;&#233;&#xe9; on", "link text <3 and 5<6 <b> & so ééé on"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<p>in<i>li</i>ne&nbsp;space<p>x</p>", "inline space x"),
    ("<article><p>cut off <a href=\"unfinished", "cut off"),
    ("<article><div class='share-buttons'>tweet</div><p>kept</p><div role=navigation>n</div><div style='display:none'>hidden</div></article>", "kept"),
    ("<article><p>a</p></div></span><p>b</p></article>", "a b"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    assert html_text.main_text(page) == want


def article(page):
    """The article element of the generated pages, tags removed by name."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    return " ".join(html.unescape(re.sub(r"</?(h1|p|br)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())


def test_query_on_generated_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = catalog.op4_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article(pages[r.page_id].html), len(r.text))


STORY = "".join(f"<p>Sentence {i} of the story, which goes on for some more words.</p>" for i in range(8))
TOLD = " ".join(f"Sentence {i} of the story, which goes on for some more words." for i in range(8))


@pytest.mark.parametrize("name", ["layout-with-sidebar", "has-sidebar", "no-header", "elementor-widget-container", "content-widget", "widget", "header"])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<div>{}</div>"])
def test_names_of_wrappers_lose_no_article(name, inner):
    page = f"<body><div class='menu'><a href=/>home</a></div><div class='{name}'>{inner.format(STORY)}<div class='sidebar'><p>aside</p></div></div></body>"
    assert html_text.main_text(page) == TOLD


def test_names_inside_an_article_lose_no_section():
    page = f"<article>{STORY}<section id='related-work'><h2 id='social-effects'>Effects</h2><div class='section-header'>Work</div><p id='tags'>on tags</p><h3 class=notice>End</h3></section><ul class='share-buttons'><li>tweet</li></ul></article>"
    assert html_text.main_text(page) == TOLD + " Effects Work on tags End"


@pytest.mark.parametrize("tag", [
    "<svg class='i' />", "<svg/>", "<math/>", "<iframe src='x'/>", "<svg-icon name=a></svg-icon>", "<select-box></select-box>", "<title-bar></title-bar>",
    "<template-part></template-part>", "<style-guide></style-guide>", "<script-x></script-x>", "<svg>", "<math>", "<select>", "<template>", "<noscript>",
    "<svg><title>t</title><text>x</text></svg>", "<SCRIPT>if (a </p> b) {}</SCRIPT >", "<select><option>x</select>", "<iframe src=http://x/>old browser</iframe>", "<style/>p{}</style>",
])
def test_left_out_elements_end_where_they_end(tag):
    assert html_text.main_text(f"<body><article><p>Before it.</p>{tag}{STORY}</article></body>") == "Before it. " + TOLD
    if tag != "<svg>":  # open, it would end with the later one
        assert html_text.main_text(f"<body><article><p>Before it.</p>{tag}{STORY}<svg><text>y</text></svg></article></body>") == "Before it. " + TOLD


def test_raw_text_without_an_end_tag_is_left_out():
    assert html_text.main_text("<article><p>text</p><script>var a = '<p>no</p>'") == "text"


def test_left_out_elements_are_read_in_linear_time():
    start = time.time()
    for page in ("<svg>" * 50_000, "<svg/>" * 50_000, "<template>x" * 30_000, "<svg><math><select>" * 20_000, "<svg></svg>" * 30_000):
        html_text.main_text(page)
    assert time.time() - start < 30


def test_a_marked_teaser_does_not_replace_the_core():
    for teaser in ("<article><p>Read this next.</p></article>", "<div class='related'><article><p>Read this next.</p></article></div>"):
        assert html_text.main_text(f"<body><div class='post'>{STORY}</div>{teaser}</body>") == TOLD


def test_an_article_in_several_elements_is_whole():
    parts = "".join(f"<article><h2>Part {i}</h2>{'<p>Some sentence of this part of it all.</p>' * n}</article>" for i, n in enumerate((3, 9, 2)))
    want = " ".join(f"Part {i}" + " Some sentence of this part of it all." * n for i, n in enumerate((3, 9, 2)))
    assert html_text.main_text(f"<body><div>{parts}</div></body>") == want
    assert html_text.main_text(f"<body><main>{parts}</main></body>") == want


def test_text_as_dense_as_the_path_is_kept_beside_an_article():
    more = "<div>" + "<p>" + "A long paragraph that goes on outside of the marked article. " * 12 + "</p></div>"
    got = html_text.main_text(f"<body><article>{STORY}</article>{more}</body>")
    assert TOLD in got and "outside of the marked article" in got


def test_named_furniture_is_set_aside():
    teasers = "<div class='related'><p>Read this other one next.</p></div>"
    comments = "<div id=comments>" + "".join(f"<article><p>Reader {i} has much to say about this story and goes on and on.</p></article>" for i in range(30)) + "</div>"
    assert html_text.main_text(f"<body><div class='siteHeader'>site</div><div>{STORY}</div>{teasers}{comments}<div id='cookie_notice'><p>We use cookies.</p></div></body>") == TOLD


def test_density_prefers_text_to_links():
    links = "<div>" + "".join(f"<li><a href=/{i}>entry number {i} of the list</a></li>" for i in range(60)) + "</div>"
    text = "<div>" + "".join(f"<p>Sentence {i} of a long text, without any link in it at all.</p>" for i in range(12)) + "</div>"
    got = html_text.main_text(f"<body>{links}{text}</body>")
    assert "Sentence 0" in got and "Sentence 11" in got and "entry number" not in got


def test_density_sums_are_of_the_children():
    root = html_text.parse("<div><p>abcd</p><p>ef</p></div>")
    html_text.measure(root)
    div = root.children[0]
    assert div.density_sum == pytest.approx(sum(c.density for c in div.children))
    assert (div.chars, div.tags, root.tags) == (6, 2, 3)


def test_hostile_markup_is_read_in_linear_time():
    start = time.time()
    for page in ("<" * 100_000, "<a '" * 20_000, "<div>" * 20_000 + "x", "<!--" * 20_000, "<p" * 50_000, "<script>" * 20_000):
        html_text.main_text(page)
    assert time.time() - start < 30


def test_awkward_rows(spark):
    df = spark.createDataFrame([(None, None, None, "a"), (1, "u", "<p>x</p>", "b"), (1, "u", "<p>x</p>", "c")], "page_id long, url string, html string, text string")
    assert sorted(html_text.extract(df).collect(), key=str) == sorted([(None, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1)], key=str)
    assert html_text.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("tag", ['<p class="a"">', "<p data-x=don't>", "<p title='it\"s'>", "<p a=b'c d=\"e>f\">", "<p '>", "<p x = 'y>z'>"])
def test_stray_quotes_in_a_tag_lose_no_text(tag):
    assert html_text.main_text(f"<body><div>{tag}First words.</p>{STORY}</div></body>") == "First words. " + TOLD


@pytest.mark.parametrize("page", ["<form>{}</form>", "<form id=aspnet><div class=menu><a href=/>x</a></div><div>{}</div></form>", "<form><main>{}</main></form>", "<header><div>{}</div></header>", "<dialog open>{}</dialog>"])
def test_an_element_around_the_whole_page_is_not_set_aside(page):
    assert html_text.main_text(f"<body>{page.format(STORY)}<footer>f</footer></body>") == TOLD


def test_forms_and_asides_beside_the_text_are_set_aside():
    for extra in ("<form><p>Your name and address, please.</p></form>", "<aside>" + "<p>Something else of some length for the side of the page.</p>" * 5 + "</aside>", "<dialog><p>We care.</p></dialog>"):
        assert html_text.main_text(f"<body><div>{STORY}{extra}</div></body>") == TOLD
        assert html_text.main_text(f"<body>{extra}<article>{STORY}</article></body>") == TOLD


def test_a_heading_beside_the_core_is_kept():
    assert html_text.main_text(f"<body><div><h1>Title</h1><div>{STORY}</div></div></body>") == "Title " + TOLD
    assert html_text.main_text(f"<body><div><h2>Title</h2><div>{STORY}</div><h2>Next</h2></div></body>") == "Title " + TOLD
    assert html_text.main_text(f"<body><h1>Site</h1><article>{STORY}</article></body>") == TOLD


def test_a_menu_that_is_text_stays_in_an_article():
    for wrap in ("<article>{}</article>", "<div>{}</div>"):
        assert html_text.main_text("<body>" + wrap.format(STORY + "<div id='menu'><p>Soup and bread are on the menu today.</p></div>") + "</body>") == TOLD + " Soup and bread are on the menu today."
        assert html_text.main_text("<body>" + wrap.format(STORY + "<div id='menu'><a href=/>home</a> <a href=/b>more</a></div>") + "</body>") == TOLD


def random_tree(rng, depth=0):
    """A tree of (name, children) with texts as strings, of plain blocks and links."""
    children = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        words = " ".join(rng.choice(["alpha", "be", "gamma", "delta", "epsilon"]) for _ in range(rng.randint(1, 30)))
        if kind < 0.35 and depth < 4:
            children.append(random_tree(rng, depth + 1))
        elif kind < 0.5:
            children.append(("div", [("a", [words.split()[0]])]))
        else:
            children.append(("div", [words]))
    return ("div", children)


def written(node):
    return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(written, node[1])) + f"</{node[0]}>"


def reference_text(body):
    """Composite text density written out a second time, over tuples."""
    import math

    stat = {}

    def count(n):
        c = t = lc = lt = 0
        for x in n[1]:
            if isinstance(x, str):
                c += len(x)
            else:
                a, b, d, e = count(x)
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e
        if n[0] == "a":
            lc, lt = c, lt + 1
        stat[id(n)] = (c, t, lc, lt)
        return stat[id(n)]

    all_c, _, all_lc, _ = count(body)

    def density(n):
        c, t, lc, lt = stat[id(n)]
        if not c:
            return 0.0
        inner = math.log(c / max(1, c - lc) * lc + all_lc / max(1, all_c) * c + math.e)
        return c / max(1, t) * (1 + math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt)))) / (1 + math.log(inner))

    def walk(n, path):
        yield n, path
        for x in n[1]:
            if not isinstance(x, str):
                yield from walk(x, [*path, n])

    def density_sum(n):
        return sum(density(x) for x in n[1] if not isinstance(x, str))

    best = max(((n, path) for n, path in walk(body, [])), key=lambda v: density_sum(v[0]))
    core, path = best
    threshold = min(density(n) for n in [core, *path])

    def text(n):
        return [n] if isinstance(n, str) else [w for x in n[1] for w in text(x)]

    def chosen(n, line):
        if n is core:
            return text(n)
        out = []
        for x in n[1]:
            if x is line[0]:
                out += chosen(x, line[1:])
            elif not isinstance(x, str) and density(x) >= threshold and 2 * stat[id(x)][2] < stat[id(x)][0]:
                out += text(x)
        return out

    return " ".join(chosen(body, [*path, core][1:] or [core]))


def test_density_equals_a_second_reference_on_pages_without_an_article():
    import random

    rng = random.Random(6)
    several = 0
    for _ in range(400):
        body = ("body", [random_tree(rng) for _ in range(rng.randint(1, 3))])
        got, want = html_text.main_text(written(body)), reference_text(body)
        assert got == want
        several += want != " ".join(w for x in body[1] for w in html_text.main_text(written(x)).split())
    assert several > 50
