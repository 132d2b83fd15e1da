"""Top-k search, chat formatting and page text."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chargeloom.llm import chat, html_text, topk
from chargeloom.llm.queries import op2_topk, op4_chat, op7_html


def vectors(seed=1, many=400, dim=12):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(many), rng.normal(0, 0.3, (many, dim)).astype(np.float32))]
    rows += [(50, rows[0][1]), (1000, None), (1001, [None] * dim), (1002, [float("nan")] * dim), (1003, [float("inf")] * dim), (1050, []), (None, rows[0][1])]
    rows += [(2000 + i, rows[3][1]) for i in range(20)] + [(3000, [1.0, 2.0]), (3001, [1.0, 1.0]), (3050, [0.5, 0.5]), (4000, [1.0] * 5)]
    return rows


def brute(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = set()
    for q, v in queries.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("options", [{}, {"max_broadcast": 1, "query_block": 3, "block": 40, "seeds": 20}, {"seeds": 0, "block": 64}])
def test_top_k(spark, options):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).repartition(3)
    assert {tuple(r) for r in topk.top_k(table, **options).collect()} == brute(rows)


def test_op2_query_and_empty(spark, tmp_path):
    rows = vectors(2, 120)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {tuple(r) for r in op2_topk(spark, str(tmp_path)).collect()} == brute(rows)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (8, 32)).repeat(4, axis=1)[:, :64]
    data = np.concatenate([c + rng.integers(-3, 4, (100, 64)) for c in centres])
    block = topk.Block.of(np.arange(len(data)), data)
    queries = topk.Block.of(np.arange(5000, 5010), data[::80] + 1)
    exact = queries.vectors @ block.vectors.T
    for a, b in zip(queries.stats, block.stats):
        assert (a @ b.T >= exact - 1e-6 * np.abs(exact) - 1e-3).all()
    best = topk.Best.empty(10, 5, np.full(10, np.iinfo(np.int64).min))
    topk.search(queries, topk.Block.of(np.arange(0, 800, 10), data[::10]), best)
    assert topk.search(queries, block, best) < 0.7 * exact.size


def test_products_of_any_size(spark):
    """Large components: products that fit are exact, others are the nearest long; nothing fails."""
    big = [(0, [2.0**30, 0.0]), (50, [0.0, 2.0**30]), (1, [2.0**22, 3.0]), (2, [1e300, 1e300]), (3, [-1e300, 0.0]), (4, [1.7e308, -1.0]), (5, [0.0, 0.0]), (6, [1.5, -0.25])]
    rows = spark.createDataFrame(big, "vec_id long, embedding array<double>").repartition(2)
    most = (1 << 63) - 1
    whole = {i: [int(x * 256 // 1) if abs(x) < 1e15 else min(int(x) * 256, int(np.finfo(float).max)) for x in v] for i, v in big}
    for options in ({}, {"seeds": 0, "block": 2}):
        got = {}
        for r in topk.top_k(rows, k=7, **options).collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        for q in (0, 50):
            want = sorted(((max(-most, min(most, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q), key=lambda x: (-x[0], x[1]))
            assert got[q] == [(i, s) for s, i in want]


def test_no_row_is_lost_where_terms_cancel():
    """Bounds of vectors whose large terms cancel, with the true last score as the threshold."""
    rng = np.random.default_rng(8)
    for n in range(300):
        data = rng.integers(-16_000, 16_000, (40, 48))
        query = data[0] + rng.integers(-1, 2, 48)
        data[1:] -= (data[1:] @ query / (query @ query))[:, None].astype(np.int64) * query
        exact = np.sort(data @ query)[::-1]
        best = topk.Best.empty(1, 5, np.array([exact[4]]))
        topk.search(topk.Block.of(np.array([-1]), query[None, :]), topk.Block.of(np.arange(40), data), best)
        assert (best.scores[0] == exact[:5]).all(), n


def test_op2_against_its_sql(spark, tmp_path):
    import duckdb

    rows = [r for r in vectors(4, 150) if r[0] != 50] + [(50, [0.5] * 12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    cursor = con.execute(topk.ORACLE_SQL)
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, op2_topk(spark, str(tmp_path)).select(*names).collect())) == sorted(cursor.fetchall())


TALK = [
    (1, 0, "system", "Be kind."),
    (1, 1, "ann", "Hi"),
    (1, 2, "bob", "Héllo 😀"),
    (1, 2, "bob", "Héllo 😀"),
    (1, 3, "ann", None),
    (2, 0, None, "x"),
    (2, None, "ann", "first"),
    (3, 0, "system", "alone"),
    (None, 0, "ann", "lost"),
]


def test_perspectives(spark):
    rows = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1)).repartition(3)
    got = {(r.conv_id, r.perspective): r for r in chat.rotate_perspectives(rows).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "ann"), (2, "unknown")}
    ann = got[1, "ann"]
    assert ann.text == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi<|end|>\n<|user|>\nbob: Héllo 😀<|end|>\n<|assistant|>\n<|end|>\n"
    assert [ann.text[m.start : m.end] for m in ann["mask"]] == ["Hi<|end|>\n", "<|end|>\n"] and ann.n_turns == 4
    assert got[2, "unknown"].text == "<|user|>\nann: first<|end|>\n<|assistant|>\nx<|end|>\n"
    assert chat.rotate_perspectives(rows.limit(0)).count() == 0


def brute_dialogues(rows):
    out, by = {}, {}
    for c, t, r, x in set(rows):
        if c is not None:
            by.setdefault(c, set()).add((t is not None, t or 0, r or "unknown", x or ""))
    for c, turns in by.items():
        said = [(r, x) for _, _, r, x in sorted(turns)]
        for who in {r for r, _ in said} - {"system"}:
            text, mask = chat.render(said, who)
            out[c, who] = (len(said), len(text), text, mask)
    return out


@pytest.mark.parametrize(("piece", "most"), [(512, 100), (16, -1), (20_000, 100)])
def test_long_conversations_are_whole(spark, piece, most):
    """10,000 turns, equal turn numbers and long texts: one row a participant, whatever the plan."""
    rows = [(9, i if i % 3 else 7, f"p{i % 4}" if i > 20 else "system", f"t{i}é" * (i % 4)) for i in range(10_000)] + [(8, 0, "solo", "s" * 100_000), *TALK]
    rows = [r for r in rows if piece < 20_000 or r[1] is None or r[1] < 1500]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("who", F.lit(1)).repartition(3)
    got = chat.rotate_perspectives(table, piece_turns=piece, max_broadcast_rows=most).collect()
    assert {(r.conv_id, r.perspective): (r.n_turns, r.n_chars, r.text, [(m.start, m.end) for m in r["mask"]]) for r in got} == brute_dialogues(rows)


def test_op4_against_its_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(chat.ORACLE_SQL)
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, op4_chat(spark, str(tmp_path)).select(*names).collect())) == sorted(cursor.fetchall())


PAGES = {
    "<p>one<p>two": "one\n\ntwo",
    "a<br>b<div>c</div>d": "a\nb\nc\nd",
    "<ul><li>a<li>b<ol start=7><li>x<li>y</ol><li>c</ul>": "- a\n- b\n  7. x\n  8. y\n- c",
    "<table><tr><td>ab<td>c<tr><td>d<td>ef</table>": "ab  c\nd   ef",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2<tr><td colspan=2>wide cell</table>": "r  1\n   2\nwide cell",
    "x<table><tr><td><p>in<br>two<td><table><tr><td>n</table></table>y": "x\n\nin   n\ntwo\n\ny",
    "<head><title>t</title><body><script>if (a<b) '</p>'</script>v<style>p{}</style><noscript>n</noscript>": "v",
    "<style>.no, #i {display: none}</style><p class='a no'>1<p id=i>2<p style='display:none'>3<p hidden>4<p>5": "5",
    "<p style='visibility:hidden'>a<b style='visibility:visible'>b</b></p>": "b",
    "<pre>  a\n   b</pre>": "  a\n   b",
    "&lt;b&gt; &amp;  &copy;  x": "<b> & © x",
    "<details><summary>s</summary>hid</details><details open>shown</details>": "s\nshown",
    "<!-- a > b --><!doctype html>t<!-- never closed": "t",
    "1 < 2 and <3": "1 < 2 and <3",
    "<b>a</p>b": "a\n\nb",
    "<h1>a</h1>\n\n  <p> b   c </p>": "a\n\nb c",
    "<blockquote>q</blockquote>z": "  q\n\nz",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "": "",
    "<p>": "",
    '<script src="x"/>code</script>v<style/>p{}</style>w': "vw",
    "<style>@media print{.n{display:none}} @media screen{.s{display:none}}</style><p class=n>a<p class=s>b<p>c": "a\n\nc",
    "<style>.n{display:none}.n.v{display:block} p{display:none!important} p#i{display:block}</style><div class=n>a</div><div class='v n'>b</div><p id=i>c</p>": "b",
    "<style>/* .a{display:none} */ .b{visibility:hidden} @font-face{display:none}</style><i class=a>x</i> <i class=b>y</i>": "x",
    "<p hidden>a<p hidden style='display:block'>b": "b",
    "<ol><li value=5>a<li>b</ol><ol reversed><li>c<li>d</ol>": "5. a\n6. b\n\n2. c\n1. d",
    "<select><option>a<option selected>b<option>c</select>": "b",
    "<ruby>x<rp>(<rt>y<rp>)</ruby>": "xy",
    "<svg><text>in</text><path d=''/></svg> <math><mi>z</mi></math>": "in z",
}


def simple(node):
    """A slow renderer of well-formed trees of blocks and words, by the rules alone: (lines, gap before, gap after)."""
    kind, children = node
    lines, gap, joins, before = [], False, False, False
    for child in children:
        inner, ahead, behind = ([child], False, False) if isinstance(child, str) else simple(child)
        if isinstance(child, str) and joins:
            lines[-1] += " " + child
            continue
        gap = gap or ahead
        if not lines:
            before = gap
        elif gap:
            lines.append("")
        lines += inner
        gap, joins = behind, isinstance(child, str)
    if kind == "blockquote":
        lines = [("  " + x) if x else x for x in lines]
    spaced = kind in ("p", "blockquote", "h2")
    return lines, spaced or before, spaced or gap


def test_against_a_slow_renderer():
    rng = random.Random(9)

    def tree(kind, depth):
        inner = ["div", "section", "blockquote", "p", "h2"] if kind not in ("p", "h2") and depth < 4 else []
        return kind, [f"w{rng.randrange(99)}" if not inner or rng.random() < 0.5 else tree(rng.choice(inner), depth + 1) for _ in range(rng.randrange(1, 5))]

    def page(node):
        return f"<{node[0]}>" + " ".join(c if isinstance(c, str) else page(c) for c in node[1]) + f"</{node[0]}>"

    for _ in range(300):
        made = tree("div", 0)
        assert html_text.render(page(made)) == "\n".join(simple(made)[0]), page(made)


def test_large_and_nested_pages_stay_linear():
    import time

    began = time.time()
    wide = "<table><tr>" + "<td>x" * 100_000 + "</table>"
    assert html_text.render(wide).count("x") == 100_000
    assert time.time() - began < 4
    deep = "<blockquote>x" * 70_000
    text = html_text.render(deep)
    assert text.count("x") == 70_000 and len(text) < 8_000_000
    nested = "<table><tr><td>y" * 2000
    assert html_text.render(nested).count("y") == 2000
    columns = "<table>" + "<tr><td>" + "z" * 500 + "<td>a" + "<tr><td><td>b" * 1000
    assert html_text.render(columns).count("b") == 1000


@pytest.mark.parametrize("page", list(PAGES))
def test_page_text(page):
    assert html_text.render(page) == PAGES[page]


def test_all_visible_words_stay_in_order():
    rng = random.Random(6)
    tags = "p div ul li b i span h2 table tr td section ol blockquote pre em".split()
    for _ in range(150):
        page, want = [], []
        for n in range(rng.randrange(1, 60)):
            kind = rng.random()
            if kind < 0.5:
                page.append(f" w{n} "), want.append(f"w{n}")
            else:
                page.append(f"<{'/' if kind > 0.8 else ''}{rng.choice([t for t in tags if not t.startswith('t')])}>")
        got = [w for w in html_text.render("".join(page)).split() if w.startswith("w")]
        assert got == want, page


def test_deep_and_long_pages():
    assert html_text.render("<div>" * 30_000 + "deep") == "deep"
    assert html_text.render("<p>" + "x " * 200_000).count("x") == 200_000


def test_op7_query(spark, tmp_path):
    rows = [Row(page_id=i, url="u", html=p) for i, p in enumerate([*PAGES, None])]
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.n_chars, r.text) for r in op7_html(spark, str(tmp_path)).collect()}
    assert got == {i: (len(t), t) for i, t in enumerate(PAGES.values())} | {len(PAGES): (None, None)}


def test_spans_that_are_no_numbers():
    cells = "<table><tr><td colspan='{0}' rowspan='{0}'>a<td>b<tr><td>cc<td>d</table>"
    for odd in ("²", "x", "", "-3", "0", "٣", "1.9"):
        assert html_text.render(cells.format(odd)) == "a   b\ncc  d"
    assert html_text.render("<table><tr><td>a<td rowspan=' +2px'>b<td>c<tr><td>d<td>e</table>") == "a  b  c\nd     e"
    assert html_text.render("<select size='²'><option>a<option>b</select><ol start='²'><li value='" + "9" * 5000 + "'>x</ol>") == "a\n\n1. x"


@pytest.mark.parametrize(
    "page",
    [
        lambda n: '<a "' * n,
        lambda n: "<a " * n,
        lambda n: "<a" * n,
        lambda n: "<a \"'<b '\"" * (n // 3) + ">",
        lambda n: "<table>" + "<td colspan=1000 rowspan=65534>x" * (n // 40) + "<tr><td>y" * (n // 5),
        lambda n: "<table>" + "".join(f"<td rowspan={i}>x" for i in range(n // 10, 0, -1)) + "<tr><td>y" * (n // 5),
        lambda n: "<table>" + "<td>x" * (n // 3) + "<tr><td>y" * (n // 5),
    ],
    ids=["quotes", "tags", "names", "mixed", "spans", "uneven", "wide"],
)
def test_time_grows_with_the_page(page):
    """Ten times the page, not a hundred times the work: unclosed tags and spans are not gone through again and again."""
    import time

    def seconds(n):
        text = page(n)
        began = time.perf_counter()
        html_text.render(text)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(250_000) < 30 * max(seconds(25_000), 0.02)


def test_a_tag_without_an_end_is_text():
    assert html_text.render("x <a href='y' z") == "x <a href='y' z"
    assert html_text.render("<p title=\"a>b\">c</p><b 'd>e</b>f' g>h") == "c\n\nh"
    assert html_text.render("1<a \"2<b>3</b>") == '1<a "23'
    assert html_text.render("a<!-- b > c --d") == "a" and html_text.render("a<!x>b<?y>c") == "abc"


def test_every_column_is_aligned():
    wide = "<table><tr><td>" + "x" * 300 + "<td>A2<td>A3<tr><td>short<td>B2<td>B3</table>"
    first, second = html_text.render(wide).split("\n")
    assert (first.index("A2"), first.index("A3")) == (second.index("B2"), second.index("B3")) == (302, 306)
    assert html_text.render(wide, max_aligned=256).split("\n")[1] == "short  B2  B3"
    deep = "<ul><li>x" * 100
    assert html_text.render(deep).split("\n")[-1] == " " * 198 + "- x"
    assert html_text.render(deep, max_indent=10).split("\n")[-1] == " " * 10 + "- x"
    nested = "<table><tr><td>a<td>b" * 3
    assert html_text.render(nested, max_tables=1) != html_text.render(nested)
    # Where padding would outgrow the page, cells stand two spaces apart, and none is lost.
    far = "<table><tr>" + "<td rowspan=65534>x" * 3000 + "<td>end" + "<tr><td>y" * 3000 + "</table>"
    found = html_text.render(far)
    assert found.count("y") == 3000 and len(found) < 8 * len(far)


def plain_text(node):
    """A second renderer, for trees of (tag, children): blocks, lists, tables of single-line cells, hidden elements."""
    blocks = []  # lines, and whether an empty line keeps them apart

    def walk(node, indent, mark):
        tag, children = node
        if tag == "hidden":
            return
        if tag == "p":
            blocks.append(([" " * indent + (mark or "") + " ".join(children)], not mark))
        elif tag == "ul":
            for i, child in enumerate(children):
                blocks.append(([" " * indent + "- " + child], i == 0 and indent == 0))
            blocks.append(([], True))
        elif tag == "table":
            widths = [max(len(row[c]) for row in children if c < len(row)) for c in range(max(map(len, children)))]
            blocks.append((["  ".join(cell.ljust(w) for cell, w in zip(row, widths)).rstrip() for row in children], True))
            blocks.append(([], True))
        else:
            for child in children:
                walk(child, indent, mark)

    walk(node, 0, None)
    out, gap = [], False
    for lines, spaced in blocks:
        gap = gap or spaced
        if lines:
            out += ([""] if out and gap else []) + lines
            gap = spaced and len(lines) == 1 and not lines[0].startswith("- ")
    return "\n".join(out)


def as_html(node):
    tag, children = node
    if tag == "p":
        return "<p>" + " ".join(children)
    if tag == "ul":
        return "<ul>" + "".join(f"<li>{c}" for c in children) + "</ul>"
    if tag == "table":
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in children) + "</table>"
    inner = "".join(map(as_html, children))
    return f"<section style='display: none'>{inner}</section>" if tag == "hidden" else f"<section>{inner}</section>"


def test_trees_with_lists_tables_and_hidden_parts():
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))

    def tree(depth):
        kind = rng.choice(["p", "ul", "table", "section", "section", "hidden"] if depth else ["p", "ul", "table"])
        if kind == "p":
            return kind, [word() for _ in range(rng.randrange(1, 5))]
        if kind == "ul":
            return kind, [word() for _ in range(rng.randrange(1, 4))]
        if kind == "table":
            return kind, [[word() for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 4))]
        return kind, [tree(depth - 1) for _ in range(rng.randrange(1, 4))]

    for _ in range(500):
        node = ("section", [tree(3) for _ in range(3)])
        assert html_text.render(as_html(node)) == plain_text(node), as_html(node)


def test_pages_that_clash_and_none(spark):
    rows = spark.createDataFrame([(1, "<p>a", "old"), (2, None, "old"), (1, "<p>a", "old")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in html_text.extract_text(rows).collect() if r.text) == [(1, "a"), (1, "a")]
    assert html_text.extract_text(rows).columns == rows.columns and html_text.extract_text(rows.limit(0)).collect() == []


def test_layout_does_not_depend_on_the_length_of_the_page():
    """Parts of a page are laid out alike, alone and behind or before a long text or other wide parts."""
    wide = "<table><tr><td>" + "z" * 500 + "<td>a" + "<tr><td><td>b" * 1000 + "</table>"
    tables = "<table><tr><td>a<td>b" * 20 + "</table>" * 20
    deep = "<ul><li>x" * 120 + "</ul>" * 120
    spans = "<table><tr>" + "".join(f"<td rowspan={i}>x" for i in range(400, 0, -1)) + "<tr><td>y" * 450 + "</table>"
    alone = [html_text.render(part) for part in (wide, tables, deep, spans)]
    assert alone[0].split("\n")[1:] == [" " * 502 + "b"] * 1000
    for long in ("", "<p>" + "w " * 1_500_000):
        assert html_text.render("".join(f"<div>{part}</div>" for part in (wide, tables, deep, spans)) + long) == "\n\n".join([*alone, *(["w " * 1_499_999 + "w"] if long else [])])


def test_cells_pass_over_every_span():
    """Where a cell goes is the first column that no span from above holds, however many there are."""
    rng = random.Random(8)
    for many in (5, 700):
        grid, taken, want = html_text.Grid(), {}, []
        for r in range(40):
            grid.row(), want.append([])
            column = 0
            for _ in range(many if r % 9 == 0 else rng.randrange(4)):
                across, down = rng.choice([1, 1, 2]), rng.choice([1, 1, 3, 30])
                while taken.get(column, 0) > r:
                    column += 1
                want[-1].append(column)
                grid.cell(["x"], across, down)
                own = range(column, column + across)
                taken |= {c: max(taken.get(c, 0), r + down) for c in own} if down > 1 else {}
                column += across
        assert [list(row) for row in grid.rows] == want
