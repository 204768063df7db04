import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from townhall_spark.llm import html_text
from townhall_spark.llm.html_text import extract, visible_text

CASES = [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"),
    ("<title>t</title><style>p{}</style><script>var a='</p>'</script>x<!-- c -->", "x"),
    ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
    ("<div>a</div><div>b</div>", "a\nb"), ("a <b>bold</b>, <i> x </i>y", "a bold, x y"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ("<ol start=3><li>q<li>r</ol>", "3. q\n4. r"),
    ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\n  v\nl\n  w"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>fig<td>12</table>",
     "Name  | Qty\napple | 3\nfig   | 12"),
    ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide |   | z\na    | b | c"),
    ("<p hidden>no</p><p style='color:red; DISPLAY : none'>no</p><p>yes</p>", "yes"),
    ("<details><summary>more</summary>inside</details>", "more"),
    ("<details open><summary>more</summary>inside</details>", "more\ninside"),
    ("<pre>a  b\n  c</pre>", "a  b\n  c"), ("&lt;b&gt; &amp;&nbsp;x", "<b> &\xa0x"),
    ("x</div></p>y", "x\ny"), ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in | out"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_layout(html, text):
    assert visible_text(html) == text


@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<td>", "<tr>", "<table>", "</table>",
                                 "<li>", "<ul>", "</ul>", "<div>", "</div>", "w", " ", "< ", "&amp;"]),
                max_size=30).map("".join))
def test_no_word_is_lost_whatever_the_nesting(html):
    assert visible_text(html).count("w") == html.count("w")


@pytest.mark.parametrize(("html", "text"), [
    ("<html><head><title>T</title><h1>Hello</h1><p>World", "Hello\n\nWorld"),
    ("<head><meta charset=utf-8><script>x</script> text <b>bold</b>", "text bold"),
    ("<head>\n<title>T</title>\n<style>p{}</style>\n<noscript><p>no</p></noscript>"
     "<link rel=x></head>\n<body>yes", "yes"),
    ("<head><template><p>no</p></template><br>a<title>no</title>", "a"),
])
def test_an_open_head_ends_where_the_page_begins(html, text):
    assert visible_text(html) == text


def test_deep_and_long_pages():
    assert visible_text("<div>" * 50000 + "x") == "x"
    assert len(visible_text("<p>word</p>" * 50000)) == 50000 * 6 - 2


def test_table_of_pages(spark):
    rows = [(1, "<p>a", "x"), (1, "<p>a", "x"), (None, None, "x"), (2, "", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(df).collect())
    assert got == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert extract(df.limit(0)).count() == 0


def brute_grid(rows):
    """Cells on a board, each at the first free square of its row."""
    board, at = set(), []
    for r, row in enumerate(rows):
        c = 0
        for columns, height in row:
            while (r, c) in board:
                c += 1
            at.append((r, c))
            board |= {(r + i, c + j) for i in range(height) for j in range(columns)}
            c += columns
    return at


@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 4)), max_size=5), max_size=7))
def test_spans_against_a_board(rows):
    cells = [[html_text.Cell(["x"], c, r) for c, r in row] for row in rows]
    got = [(r, c) for r, row in enumerate(html_text._grid(cells)) for c, _ in row]
    want = brute_grid(rows)
    used = {c: n for n, c in enumerate(sorted({c for _, c in want}))}
    assert got == [(r, used[c]) for r, c in want]


@pytest.mark.parametrize(("html", "text"), [
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>", "A | b\n  | c\nd | e"),
    ("<table><tr><td rowspan=9>A<td>b<tr><td colspan=2>c<td>d</table>", "A | b\n  | c | d"),
    ("<style>.x{display:none} @media print{.y{display:none}} #z,p.q{visibility:hidden}</style>"
     "<div class='w x'>no</div><div class=y>yes</div><div id=z>no<b style='visibility: visible'>"
     "seen</b></div><p class=q>no</p><p class=r>ok", "yes\nseen\n\nok"),
    ("<style>.x{display:none}</style><style>/* .x{} */ .x{display:block}</style><p class=x>yes", "yes"),
    ("<style>.x{display:none}</style><p class=x style='display:block'>yes", "yes"),
    ("<div style='visibility:hidden'>no<br><p style='visibility:visible'>yes<i>too</i></p>no</div>",
     "yestoo"),
    ("<p>x <math><mi>a</mi><annotation>TeX</annotation></math> <svg><title>t</title><desc>d</desc>"
     "<text>label</text></svg>", "x a label"),
    ("<p>a</p><div hidden>b</div><style>div{", "a"),
])
def test_spans_and_visibility(html, text):
    assert visible_text(html) == text


def test_a_wide_cell_is_broken_and_pads_no_table_without_bound():
    rows = "".join(f"<tr><td>a{i}<td>b" for i in range(2000))
    for wide in ("w " * 10000, "w" * 20000):
        page = f"<table><tr><td>{wide}<td>z</tr>{rows}</table>"
        text = visible_text(page)
        assert len(text) < 10 * len(page) and text.count("w") == wide.count("w")
        assert re.search("a1999 {50,} [|] b", text)
    page = ("<table><tr>" + "<td>x" * 1000
            + "".join("<tr><td colspan=999><td>y" for _ in range(2000)) + "</table>")
    text = visible_text(page)
    assert len(text) < 10 * len(page) and text.count("y") == 2000 and text.count("x") == 1000
    cell = " ".join(f"word{i}" for i in range(40))
    lines = visible_text(f"<table><tr><td>{cell}<td>n</table>").split("\n")
    assert max(map(len, lines)) <= html_text.MOST_WIDTH + 4
    assert " ".join(line.split("|")[0].strip() for line in lines) == cell


@pytest.mark.parametrize(("head", "row", "line"), [
    ("".join(f"<td>column {i:02}" for i in range(20)), "<tr><td colspan=19>a<td>b",
     "a         | " + (" " * 9 + " | ") * 18 + "b"),
    ("<td>x" * 1000, "<tr><td colspan=999><td>y", "×999 | y"),
    ("<td>" + "w" * 60 + "<td>" * 5 + "w" * 60, "<tr><td>a<td><td><td><td>b<td>c",
     "a" + " " * 59 + " |  |  |  | b | c"),
    ("<td>" + ("w" * 60 + "<td>") * 6, "<tr>" + "<td>" * 5 + "b<br>c<td>d<td>",
     "×4 | b" + " " * 59 + " | d" + " " * 59 + " |\n×4 | c" + " " * 59 + " | " + " " * 60 + " |"),
])
def test_a_row_is_laid_out_alike_in_a_table_of_any_size(head, row, line):
    lines = line.split("\n")
    for n in (1, 20, 200, 2000):
        text = visible_text(f"<table><tr>{head}{row * n}</table>").split("\n")
        assert text[-n * len(lines):] == lines * n


def told(line):
    """Column and text of what a line shows."""
    column, out = 0, []
    for part in re.split(" [|](?: |$)", line):
        if part.startswith("×"):
            column += int(part[1:])
            continue
        if part.strip():
            out.append((column, part.strip()))
        column += 1
    return out


@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 4), st.sampled_from(
    ["", "a", "bc\nd", "w" * 50, "w" * 70])), min_size=1, max_size=9), max_size=7))
def test_the_column_of_each_text_can_be_told(rows):
    cells = [[html_text.Cell(t.split("\n"), c, r) for c, r, t in row] for row in rows]
    at = brute_grid([[(c, r) for c, r, _ in row] for row in rows])
    used = {c: n for n, c in enumerate(sorted({c for _, c in at}))}
    texts = [t for row in rows for *_, t in row]
    want = []
    for r in range(len(rows)):
        row = [(used[c], t.split("\n")) for (s, c), t in zip(at, texts, strict=True) if s == r]
        for n in range(max(len(t) for _, t in row)):
            want.append([(c, t[n]) for c, t in row if n < len(t) and t[n]])
    got = html_text._padded(cells)
    assert [told(line) for line in got] == want
    width = [min(60, max(len(x) for (_, c), t in zip(at, texts, strict=True) if used[c] == n
                         for x in t.split("\n"))) for n in range(len(used))]
    if sum(width) + 3 * len(width) <= html_text.MOST_BLANK:
        lasts = [max(used[c] for s, c in at if s == r) for r in range(len(rows))
                 for _ in range(max(t.count("\n") + 1 for *_, t in rows[r]))]
        assert got == [" | ".join(dict(line).get(c, "").ljust(width[c]) for c in range(last + 1))
                       .rstrip() for line, last in zip(want, lasts, strict=True)]


def test_blank_grows_no_faster_than_the_page():
    for n in (1000, 4000):
        page = "<table><tr>" + ("<td>" + "w" * 60) * (n // 10) + "<td>" + "x<br>" * n + "</table>"
        text = visible_text(page)
        assert len(text) < 2 * len(page) and text.count("x") == n
    page = "x"
    for depth in range(1, 13):
        page = ("<table><tr>" + ("<td>" + "w" * 40) * 3 + "<td>z<tr><td><td><td><td>"
                f"<ul><li>{page}</ul></table>")
        text = visible_text(page)
        assert len(text) < 8 * len(page) and text.count("w") == 120 * depth
    lines = visible_text("<table><tr><td>" + CASES[10][0].replace("fig", "f" * 60)
                         + "</table>").split("\n")
    assert lines[1:] == ["apple".ljust(60) + " | 3", "f" * 60 + " | 12"]
