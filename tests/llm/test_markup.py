import pytest

from lodestrata.llm import markup as M

PLAIN = [
    "Salt & pepper; R&D; a && b.", "if a == b and c == d then", "~ 40% of 1.2_beta_3 ^ up", "2 * 3 * 4 and 24 * 2", "min_size and max_size", "issue #42", "Map<K,V> of List<String>", "from <here> to <there> ->",
    "{a} [x] (y) | or", "x < 5 and y > 3, or a<b&&c>d", "C:\\dir\\new\\textbf", "[[1,2],[3,4]]", "written as '' here", "costs $5 and $12 more", "f(*args, **kw)", "", "   ", None, "5*3*2",
]


@pytest.mark.parametrize("text", PLAIN)
def test_signs_that_only_look_like_markup(text):
    kinds, blocks = M.clean(text)
    assert kinds == [] and (not text or not text.strip() or blocks == [("text", 0, text)])


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("a <b>bold</b> word", ["html"]), ("line<br/>end", ["html"]), ("x <!-- no --> y", ["html"]), ("dash &mdash; and &#8217;", ["html"]), ("<P class=x>open", ["html"]),
        ("# Head", ["markdown"]), ("Head\n----", ["markdown"]), ("- item", ["markdown"]), ("1. item", ["markdown"]), ("> quote", ["markdown"]), ("a\n\n---\n\nb", ["markdown"]), ("|a|b|\n|---|---|\n|1|2|", ["markdown"]),
        ("```\n<b>x</b> '''y''' \\emph{z} $a$\n```", ["markdown"]), ("`<b>` code", ["markdown"]), ("an *em* word", ["markdown"]), ("__strong__ word", ["markdown"]), ("~~gone~~", ["markdown"]), ("[t](u.md)", ["markdown"]), ("![t](u.png)", ["markdown"]),
        ("== Head ==", ["wiki"]), ("''em'' and", ["wiki"]), ("a [[Link|text]]", ["wiki"]), ("{{T|x}}", ["wiki"]), ("{| class=x\n|-\n| a || b\n|}", ["wiki"]), ("== H ==\n* item\n# item", ["wiki"]),
        ("\\emph{x}", ["latex"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]), ("$x_{1}$", ["latex"]), ("\\(a\\)", ["latex"]), ("\\begin{verbatim}\n<b> '''x'''\n- a\n\\end{verbatim}", ["latex"]),
        ("<p>**x**</p> \\emph{y} [[z]]", ["html", "markdown", "wiki", "latex"]), ("<pre><code>- a\n''b''</code></pre>", ["html"]),
    ],
)
def test_kinds(text, kinds):
    assert M.clean(text)[0] == kinds


def test_structure_survives_in_each_kind():
    for text in (
        "## Head\n\nSome *em* text.\n\n- one\n- two\n\n```py\nx = '<b>'\n```\n\n$$a^2$$",
        "<h2>Head</h2><p>Some <em>em</em> text.</p><ul><li>one<li>two</ul><pre><code>x = '&lt;b&gt;'</code></pre>\n\n$$a^2$$",
        "== Head ==\n\nSome ''em'' text.\n\n* one\n* two\n\n<syntaxhighlight>\nx = '<b>'\n</syntaxhighlight>\n\n$$a^2$$",
        "\\section{Head}\n\nSome \\emph{em} text.\n\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}\n\n\\begin{verbatim}\nx = '<b>'\n\\end{verbatim}\n\n\\[a^2\\]",
    ):
        blocks = M.clean(text)[1]
        assert blocks == [("heading", 2, "Head"), ("text", 0, "Some em text."), ("list", 1, "one"), ("list", 1, "two"), ("code", 0, "x = '<b>'"), ("formula", 0, "a^2")], text
        assert M.render(blocks) == "## Head\n\nSome em text.\n\n- one\n- two\n\n```\nx = '<b>'\n```\n\n$$a^2$$"


def test_density_keeps_the_article_and_drops_the_links():
    links = "".join(f'<li><a href="/{n}">menu entry {n}</a></li>' for n in range(30))
    article = "".join(f"<p>{'This is a long paragraph of running text. ' * 8}{n}</p>" for n in range(6))
    text = M.render(M.clean(f"<html><body><div><ul>{links}</ul></div><div><h1>Title</h1>{article}</div><div><ul>{links}</ul></div></body></html>")[1])
    assert text.count("running text") == 48 and "# Title" in text and "menu entry" not in text


def test_long_deep_and_odd_texts():
    assert M.clean("<div>" * 5000 + "x" + "</div>" * 5000)[0] == ["html"]
    assert M.clean("**bold** " * 20_000)[0] == ["markdown"]
    assert M.clean("*" * 50_000) [0] in ([], ["markdown"])
    assert M.clean("$" * 20_000 + "`" * 20_000)[0] in ([], ["markdown"])
    assert M.clean("\ue000\ue002 *a*\x00\r\n# b")[0] == ["markdown"]


def test_nodes(spark, rows):
    data = [("s", "a", "docs", "# H", None), ("s", "a", "docs", "# H", None), ("s", "b", "code", "# H", "# H"), ("s", "c", "docs", None, "a <b>x</b> `y`"), (None, None, "docs", "", "''w''"), ("s", "d", None, "# H", "")]
    df = spark.createDataFrame([(*d, "clash") for d in data], "slug string, id string, corpus string, content string, embedding_text string, kinds string")
    assert rows(M.found_markup(df)) == sorted([("s", "a", "content", "markdown"), ("s", "c", "embedding_text", "html"), ("s", "c", "embedding_text", "markdown"), (None, None, "embedding_text", "wiki")], key=str)
    assert rows(M.found_markup(df.limit(0))) == []
    got = {(r.node_id, r.field_name): r.clean_text for r in M.clean_nodes(df).collect()}
    assert got["a", "content"] == "# H" and got["c", "embedding_text"] == "a x y"
    with pytest.raises(ValueError):
        M.clean_fields(df, ["kinds"], {"content": df.content})
