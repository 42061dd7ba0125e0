from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sentrymill.llm import html_text
from tests.llm.conftest import DATA

CASES = [
    ("<p>a<p>b<ul><li>x<li>y<ol start=3><li>q<li>r</ol><li>z</ul>after<br>line<br><br>two",
     "a\n\nb\n\n- x\n- y\n  3. q\n  4. r\n- z\n\nafter\nline\n\ntwo"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>x<br>y<td>10</table>end", "Name       Qty\napple pie  3\nx          10\ny\n\nend"),
    ("<table><thead><tr><th colspan=2>Wide<th>C<tbody><tr><td rowspan=2>a<td>b<td>c<tr><td>日本<td>f</table>",
     "Wide        C\na     b     c\n      日本  f"),
    ("<head><title>t</title></head><style>.h, p.x{display:none}/* .v{display:none} */</style><div class='q h'>no</div><div class=v>v</div>"
     "<div style='color:red; display: none'>no</div><span hidden>no</span>yes &amp; &lt;ok&gt;<script>var a='</p>';</script><!-- c --> z",
     "v\nyes & <ok> z"),
    ("plain text", "plain text"), ("", ""), ("<pre>\n a\n  b\n</pre>x", " a\n  b\n\nx"), ("<b>one<p>two</b> three</p>", "one\n\ntwo three"),
    ("<table>stray<td>c</table>", "stray\n\nc"), ("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after", "deep\n\nafter"),
    ("<a title=\"x>y\">q</a> <a title='z>w", "q"), ("<ol><li><p>para</p><p>second</p></li></ol>", "1. para\n\n   second"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n    d\nu"), ("a < b and c > d <3", "a < b and c > d <3"),
    ("<SCRIPT>x</Script >a<style>b", "a"), ("a<!-- b -->c<!d>e", "ace"),
    ("<template>no</template><input type=hidden value=no><input type=submit value=Go>", "Go"),
    ("<select><option>a<option>b</select>", "a\nb"), ("x<hr>y", "x\n\ny"), ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_layout(source, text):
    assert html_text.render(source) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<b>", "</b>", "<div ", "'", '"', ">", "&amp;",
                                 "<!--", "-->", "<script>", "</script>", "x", " ", "\n", "<h1>", "</h1>", "<pre>", "</div>", "<select>", "<option>"]), max_size=40))
def test_broken_markup_never_raises(parts):
    assert isinstance(html_text.render("".join(parts)), str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <ul><li> </ul> <b> </b> <h2> </h2> <div> </div> <br> <table><tr><td> <td> </table> <i>".split()), max_size=30))
def test_no_visible_word_is_lost(tags):
    source = "".join(f"{tag} w{i} " for i, tag in enumerate(tags))
    assert sorted(w for w in html_text.render(source).split() if w != "-") == sorted(f"w{i}" for i in range(len(tags)))


class Words(HTMLParser):
    """Visible words of well-formed pages in their order."""

    def __init__(self):
        super().__init__()
        self.off, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_whole_table_against_a_plain_parser(spark):
    pages = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.html_text(pages).collect()}
    for r in pages.collect():
        parser = Words()
        parser.feed(r.html)
        parser.close()
        plain = "".join(parser.words).split()
        text = got[r.page_id].split()
        assert "".join(w for w in text if w != "-") == "".join(w for w in plain if w != "-")
    assert len(got) == pages.count()


def test_awkward_rows(spark):
    pages = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "<p>x", 5), (3, "<p>x", 5), (3, "<p>x", 5), (4, "<td>" * 50_000, 1), (5, "a " * 200_000, 1)],
                                  "page_id bigint, html string, n_chars int")
    got = sorted((tuple(r) for r in html_text.html_text(pages).collect()), key=repr)
    assert [g for g in got if g[0] != 5] == sorted([(1, "", 0), (2, "", 0), (None, "x", 1), (3, "x", 1), (3, "x", 1), (4, "", 0)], key=repr)
    assert html_text.html_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [100, 126, 127, 128, 200, 5000])
@pytest.mark.parametrize("source, words", [
    ("a <script>x</script>b <span hidden>no</span>c <i>d</i> e", "a b c d e"), ("<p hidden>no<b>no</b>no</p>f", "f"),
    ("<span hidden>no<table>no<td>no</table></span>z<ul><li hidden>no<li>y</ul>q", "z y q")])
def test_text_beyond_the_greatest_depth_is_as_visible_as_above_it(depth, source, words):
    for tag in ("div", "b", "font"):
        assert [w for w in html_text.render(f"<{tag}>" * depth + source).split() if w != "-"] == words.split()


@pytest.mark.parametrize("source, text", [
    ("<style>@media print { nav, .s { display: none } } .h { display: none }</style><nav>n</nav><p class=s>s<p class=h>no", "n\n\ns"),
    ("<style>@media screen { .h { display: none } } @media print { .s { display: none } .t { color: red } }</style><p class=h>no<p class=s>s", "s"),
    ("<style media=print>p { display: none }</style><p>p", "p"),
    ("<style>.m { display: none } .v { visibility: hidden } .m { display: block }</style><p class=m>m<p class=v>no", "m"),
    ("<style>.m { display: none; display: flex } .i { display: none !important } .i { display: block }</style><p class=m>m<p class=i>no", "m"),
    ("<style>.m { display: none }</style><style>.m { display: block }</style><p class=m>m", "m"),
    ('<a href="x"">q</a> r <b title="s">t</b>', "q r t"), ("<p don't>u</p><p>v's</p>", "u\n\nv's"), ("<a href=x'y>q</a> it's", "q it's"),
    ("<a title = \"x>y\" b='>'>q</a>", "q"), ("<head><title>t</title>text<p>more", "text\n\nmore"), ("<head> <title>t</title> </head>x", "x")])
def test_visible_text_is_not_lost(source, text):
    assert html_text.render(source) == text


@pytest.mark.parametrize("source, text", [
    ("<p style='display:none;display:block'>a", "a"), ("<p style='display:none;display:nonsense'>no", ""),
    ("<div style='visibility:hidden'>no <b style='visibility:visible'>b</b> no</div>", "b"),
    ("<style>.a{display:none}</style><p class=a style='display:block'>a<p class=a>no", "a"),
    ("<style>.a{display:none} p.a{display:block}</style><p class=a>a<div class=a>no", "a"),
    ("<style>p.a{display:block} .a{display:none}</style><p class=a>a", "a"),
    ("<style>#i{display:block} .a.b{display:none} .b{display:none}</style><p class='a b' id=i>a<p class='b a'>no", "a"),
    ("<style>p{display:none !important}</style><p style='display:block'>no<p style='display:block !important'>a", "a"),
    ("<style>*{visibility:hidden} b{visibility:visible}</style>x<p>no<b>b</b>", "x\n\nb"),
    ("<p hidden style='display:block'>a<p hidden>no", "a"), ("<style>p{display:none}</style><p style='display:revert'>a", "a"),
    ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>y<li><i style='visibility:visible'>z</i></ul>", "- y\nz"),
    ("<table><tr><td style='visibility:hidden'>no<td>b<tr><td>ccc<td>d</table>", "     b\nccc  d"),
    ("<div style='visibility:hidden'>" + "<div>" * 200 + "no<b style='visibility:visible'>b</b>", "b"),
    ("<div style='display:none'><b style='display:block; visibility:visible'>no</b></div>", "")])
def test_cascade(source, text):
    assert html_text.render(source) == text


VALUES = ["display:none", "display:block", "visibility:hidden", "visibility:visible", "display:none!important", "display:block !important",
          "visibility:hidden !important", "display:wrong", "visibility:inherit"]
SELECTORS = ["div", "b", ".x", ".y", ".x.y", "div.x", "b.y", "#k", "b#k", "div.x.y", "*"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(SELECTORS), st.sampled_from(VALUES)), max_size=6),
       st.lists(st.tuples(st.sampled_from(["div", "b"]), st.sampled_from(["", "x", "y", "x y"]), st.booleans(), st.lists(st.sampled_from(VALUES), max_size=2),
                          st.integers(0, 3)), max_size=8))
def test_cascade_against_all_rules(sheet, nodes):
    """Every element against every rule, with weights as one number."""
    source, stack, want = "<style>" + " ".join(f"{s} {{{v}}}" for s, v in sheet) + "</style>", [], []
    for n, (tag, classes, has_id, inline, up) in enumerate(nodes):
        for _ in range(min(up, len(stack))):
            source += f"</{stack.pop()[0]}>"
        place, visible = stack[-1][1:] if stack else (True, True)
        weights = {}
        rules = [(s, v, 0) for s, v in sheet] + [("*", v, 1) for v in inline]
        for order, (selector, value, is_inline) in enumerate(rules):
            name = selector.replace(".", " .").replace("#", " #").split()
            if any(not (p in ("*", tag) or (p[0] == "." and p[1:] in classes.split()) or (p == "#k" and has_id)) for p in name):
                continue
            prop, what = value.replace("!important", "").strip().split(":")
            if what != "wrong":
                weight = 10 ** 8 * ("!" in value) + 10 ** 7 * is_inline + 10 ** 5 * selector.count("#") + 10 ** 4 * selector.count(".") + 1000 * (
                    not is_inline and name[0] in ("div", "b")) + order
                weights[prop] = max(weights.get(prop, (-1, "")), (weight, what.strip()))
        place = place and weights.get("display", (0, "block"))[1] != "none"
        what = weights.get("visibility", (0, "inherit"))[1]
        visible = visible if what == "inherit" else what == "visible"
        stack.append((tag, place, visible))
        source += f"<{tag} class='{classes}' {'id=k' if has_id else ''} style='{';'.join(inline)}'>w{n} "
        want += [f"w{n}"] if place and visible else []
    assert html_text.render(source).split() == want
