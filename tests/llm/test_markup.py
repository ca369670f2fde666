import random

import pytest

from reviewloom.llm.markup import FAMILIES, clean_markup, convert, find_families

HOLDS = {
    "html": ["a <b>c</b>", "x<br/>y", "<!-- n -->", "it&#x2019;s", "Tea &amp; toast", "<em\tid=e1 >x</em >", "<img src=a.png\n alt='b' />", "&nbsp;"],
    "markdown": ["# Head", "Head\n====", "a *b* c", "a **b** c", "_b_", "~~b~~", "[a](http://x.y)", "![a](b.png)", "[a][r1]", "`x`", "```\nx\n```", "| a | b |\n| --- | --- |\n| 1 | 2 |", "__b__ c"],
    "wiki": ["== Head ==", "''a''", "'''b'''", "[[a]]", "[[a|b]]", "[https://x.y z]", "{{box|a|1}}", "{| class=\"t\"\n|-\n| a || b\n|}"],
    "latex": ["\\section{a}", "\\emph{a}", "$x=1$", "$$x$$", "\\[x\\]", "\\(x\\)", "33\\,\\%", "caf\\'e", "\\begin{itemize}\n\\item a\n\\end{itemize}", "{\\bf a}", "\\dots"],
}
PLAIN = [
    "- a\n- b", "1. a\n2. b", "* a\n* b", "45<60 or 60>45", "I <3 this one.", "<- this.", "Weight < 82 kg and height > 6 cm.", "Tea & toast; ok.", "Q&a nr 3.",
    "It is 7 * 8 * 9 cm.", "Stars: * * * *.", "Ranked #9 on my list.", "About ~37 days.", "Paid $22, not $84.", "57_x or 47^x.", "Saved as pic_13_of_90.",
    "See note [46].", "What a [sic] {52} price.", "Grade: 10 = 10 = fine.", "17% & rising.", "[PAD] [UNK] <|pad|>", "<|endoftext|>", "went from 74 -> 56.",
    "C:\\temp\\new", "a == b", "x -- y", "it's", "5' 6\"", "snake_case_name", "", "   ", "\n\n", "$5 and $6", "a | b",
]


@pytest.mark.parametrize("family", FAMILIES)
def test_families(family):
    for t in HOLDS[family]:
        assert find_families(t) == [family], t
        assert find_families(f"Before it. {t}" if "\n" not in t and t[0] not in "#=" else f"Before it.\n\n{t}\n\nafter") == [family], t


def test_plain_text_is_kept():
    for t in PLAIN:
        assert find_families(t) == [], t
        assert convert(t)[0] == t
    assert convert(None) == (None, [], [])


def test_html():
    t = "<h2>A head</h2>\n\n<p>One <a href='x'>link</a>, <FONT COLOR=red>two</FONT> &lt;b&gt;.</p><ul><li>x</li><li>y</li></ul><table><tr><td>a</td><td>1</td></tr></table><pre><code>if a &lt; b:\n    c</code></pre>"
    text, blocks, families = convert(t)
    assert families == ["html"]
    assert blocks == [("heading", 2, "A head"), ("paragraph", 0, "One link, two <b>."), ("list", 0, "x"), ("list", 0, "y"), ("table", 0, "a\t1"), ("code", 0, "if a < b:\n    c")]
    assert text == "A head\n\nOne link, two <b>.\n\n- x\n- y\n\na\t1\n\nif a < b:\n    c"
    assert convert("5 < 6 <b>x</b> <3 y")[0] == "5 < 6 x <3 y"
    assert convert("<p>open <b>never closed")[0] == "open never closed"


def test_tree_scoring():
    story = "".join(f"<p>The kettle, which we bought last year, boils water in about {i} minutes, and it is quiet.</p>" for i in range(6))
    menu = "".join(f"<a href='/{i}'>Section number {i} of the shop</a> " for i in range(30))
    page = f"<html><head><title>t</title><script>var a = '<p>no</p>';</script></head><body><nav>{menu}</nav><div id='main'>{story}</div><div class='links'>{menu}</div><footer>{menu}</footer></body></html>"
    text = convert(page)[0]
    assert "boils water in about 5 minutes" in text and text.count("kettle") == 6
    assert "Section" not in text and "var a" not in text
    # without a menu everything stays
    assert "Section number 3" in convert(f"<p>{menu}</p><p>x</p>")[0]


def test_markdown():
    t = "# Head\n\nSome *soft* **bold** ~~gone~~ `co*d*e` [a link](http://x.y) ![alt](p.png) and [ref][r1].\n\n| a | b |\n| --- | :-: |\n| 1 | 2 |\n\nUnder\n-----\n\n```py\nx = *1*\n```\n\n* item"
    text, blocks, _ = convert(t)
    assert text == "Head\n\nSome soft bold gone co*d*e a link alt and ref.\n\na\tb\n1\t2\n\nUnder\n\nx = *1*\n\n- item"
    assert [b[0] for b in blocks] == ["heading", "paragraph", "table", "table", "heading", "code", "list"]


def test_wiki():
    t = "== Head ==\n\n'''Bold''' and ''soft'' [[Item 1|the tea]] [[cup]] [https://x.y a page] {{note|kept}}.\n\n{| class=\"t\"\n|-\n| lid || 61\n|-\n| cup || 2\n|}\n\n set heat 5\n     wait 3\n\n* one"
    assert convert(t)[0] == "Head\n\nBold and soft the tea cup a page kept.\n\nlid\t61\ncup\t2\n\nset heat 5\n    wait 3\n\n- one"


def test_latex():
    t = "\\section{Head}\n\n\\textbf{Bold}\\footnote{seen} caf\\'e about 33\\,\\% \\dots {\\bf x} \\cite{k} $n=1$ end.\n\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}\n\n\\begin{tabular}{lr}\nlid & 61 \\\\\ncup & 2\n\\end{tabular}\n\n\\[\nx^2\n\\]\n\n\\begin{verbatim}\n  a_b $c$\n\\end{verbatim}"
    text, blocks, _ = convert(t)
    assert text == "Head\n\nBold (seen) café about 33 % …x n=1 end.\n\n- one\n- two\n\nlid\t61\ncup\t2\n\nx^2\n\n  a_b $c$"
    assert [b[0] for b in blocks] == ["heading", "paragraph", "list", "list", "table", "table", "formula", "code"]


def test_odd_input_never_fails():
    rnd = random.Random(1)
    parts = ["<b>", "</p>", "<div", "<!--", "&#99999999;", "&amp;", "**", "_", "`", "```\n", "[[", "]]", "{{", "}}", "{|\n", "|}", "==", "\\begin{verbatim}", "\\end{", "$", "$$", "\\[", "\\", "a", " ", "\n", "\ue000", "é", "''", "~~", "# ", "---", "|", "\x00"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60)))
        convert(t)
    assert convert("<b>" * 5000 + "deep" + "</b>" * 5000)[0] == "deep"
    for t in ("*" * 20_000, "`" * 20_000, "[" * 20_000, "<" * 20_000, "{{" * 10_000, "$x" * 10_000, "''" * 10_000, "_a " * 10_000, "= " * 10_000, "\\[" * 10_000, "~~a" * 5_000):
        convert(t)


def test_clean_markup(spark):
    df = spark.createDataFrame([(1, "<b>x</b>", "c"), (2, None, "c"), (3, "", "c"), (4, "plain\n\ntext", "c")], "doc_id bigint, text string, families string")
    got = {r.doc_id: (r.text, [b.kind for b in r.blocks], r.families) for r in clean_markup(df).collect()}
    assert got == {1: ("x", ["paragraph"], ["html"]), 2: (None, [], []), 3: ("", [], []), 4: ("plain\n\ntext", ["paragraph"] * 2, [])}
    assert clean_markup(df.limit(0)).count() == 0


def test_no_bound_on_length_or_nesting():
    formula = "x_1 + " * 100 + "y"
    assert find_families(f"we get ${formula}$ here") == ["latex"]
    assert convert(f"we get ${formula}$ here")[0] == f"we get {formula} here"
    deep = "core"
    for _ in range(40):
        deep = "{{a|" + deep + "}}"
    assert convert(f"so {deep} it is")[0] == "so core it is"
    deep = "core"
    for _ in range(40):
        deep = "\\emph{\\textbf{" + deep + "}}"
    assert convert(f"so {deep} it is")[0] == "so core it is"
    assert convert("so **a _b *c __d__ c* b_ a** it is")[0] == "so a b c d c b a it is"
    assert convert("{{Infobox\n| a = b\n| rest\n}}\ntext")[2] == ["wiki"]
    assert convert("Title\n--\ntext")[1][0] == ("heading", 2, "Title")
    assert convert("x = arr[1][2] and m[i][j]")[2] == [] and convert("see [1][2]")[2] == []
    assert convert("see [1][2]\n\n[2]: http://e.org")[2] == ["markdown"] and convert("see [the text][r1]")[2] == ["markdown"]
    assert convert("{{ a } b {{c {{{x")[0] == "{{ a } b {{c {{{x"


def test_what_stands_beside_the_best_container():
    body = "<p>" + "A long sentence, with commas, that says something. " * 5 + "</p>"
    page = (
        "<body><nav><a href='/'>Home page of this site</a></nav><div id='intro'>A short intro.</div>"
        f"<div><article><h1>One</h1>{body * 3}</article><ul><li>step one</li><li>step two</li></ul><ol><li>first</li></ol><dl><dt>term</dt><dd>meaning</dd></dl>"
        f"<article><h2>Two</h2><p>Short one.</p></article><div><a href='/x'>More links of this page</a> <a href='/y'>and more</a></div></div><footer>All rights reserved</footer></body>"
    )
    text, blocks, _ = convert(page)
    for part in ("A short intro.", "- step one\n- step two", "- first", "term", "meaning", "Two", "Short one."):
        assert part in text, part
    assert not any(x in text for x in ("Home page", "More links", "All rights"))
    assert [b[2] for b in blocks if b[0] == "heading"] == ["One", "Two"]


def test_time_is_linear_on_notation_never_closed():
    import time

    for t in ("{{a|" * 20_000, "}}" * 40_000, "\\emph{" * 20_000, "$x " * 40_000, "[a][" * 20_000, "*a _b " * 10_000, "<div" * 20_000, "&a" * 40_000, "{{a|" * 5_000 + "}}" * 5_000, "\\emph{" * 5_000 + "}" * 5_000):
        start = time.process_time()
        convert(t)
        assert time.process_time() - start < 20, t[:10]
