from __future__ import annotations

import itertools
import json
import random
import re

import pytest
from cadastra.llm import chat
from cadastra.llm.html_text import ChainField, Block, block_features, extract, fit_on, leaf_blocks, main_text, page_labels, rebuilt, train_field

SF = "/root/testdata/sf0.001"


def test_blocks():
    page = "<html><head><title>t</title><style>p{}</style></head><body><div id='Main-Box'>a<p>x <b>y</b>z&eacute;\n &amp; <i>u<p>v</div><script>var s='<p>';</script>w<br>q<!-- <p>c --><p>broken &am"
    got = leaf_blocks(page + "<a hre")
    assert [b.text for b in got] == ["a", "x yzé &", "u", "v", "w q", "broken &am"] or [b.text for b in got] == ["a", "x yzé & u", "v", "w q", "broken &am"]
    assert {"as:main", "as:box", "in:div"} <= set(got[0].path)


def test_scripts_end_at_their_own_end_tag_only():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    for code in ("for(i=0;i<n;i++){f(i)}", "if(a<b){}", "x = 'it'+\"s", "s = 'a<b \"c'", "<!-- hidden", "'</p>' </scripts>", "a</ script>"):
        for tag in ("script", "style", "textarea", "noscript", "iframe", "title"):
            assert texts(f"<p>One.</p><{tag} a=b>{code}</{tag.upper()} ><p>Main text.</p>") == ["One.", "Main text."], (tag, code)
        assert texts(f"<template><script>{code}</script><p>Not seen.</p></template><p>Main text.</p>") == ["Main text."]
    assert texts("<p title=it's>One.</p><p>Two's.</p><p title='a>b' lang = \"x>y\" q=a\"b>Three.</p>") == ["One.", "Two's.", "Three."]
    assert texts("<svg><title>x</svg><p>Main text.</p>") == ["Main text."]
    assert texts("<p>One.</p><script>never ended <p>code</p>") == ["One."]


def test_viterbi_and_marginals_against_all_labellings():
    draw = random.Random(3)
    for _ in range(20):
        field = ChainField({}, [draw.uniform(-2, 2) for _ in range(4)])
        scores = [draw.uniform(-2, 2) for _ in range(draw.randint(1, 7))]

        def value(labels):
            return sum(s for s, y in zip(scores, labels) if y) + sum(field.transitions[2 * a + b] for a, b in zip(labels, labels[1:]))

        every = [[i >> k & 1 for k in range(len(scores))] for i in range(2 ** len(scores))]
        assert value(field.viterbi(scores)) == pytest.approx(max(map(value, every)))
        import math

        whole = sum(math.exp(value(y)) for y in every)
        main, counts = field.marginals(scores)
        for k in range(len(scores)):
            assert main[k] == pytest.approx(sum(math.exp(value(y)) for y in every if y[k]) / whole)
        assert sum(counts) == pytest.approx(len(scores) - 1)


def test_held_out_pages(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]
    pages += [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    field = train_field(pages[:120])
    for page in pages[120:]:
        inner = re.sub(r"<[^>]*(>|$)", " ", re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1])
        import html

        assert main_text(page, field) == " ".join(html.unescape(inner).split())
    draw, right, total = random.Random(8), 0, 0
    held = [leaf_blocks(p) for p in pages[120:]]
    strange = [b.text for blocks in held for b in blocks]
    for blocks in held:
        other, labels = rebuilt(blocks, page_labels(blocks), strange, draw)
        got = field.viterbi(field.emissions([block_features(b) for b in other]))
        right, total = right + sum(a == b for a, b in zip(got, labels)), total + len(labels)
    assert right / total > 0.99
    other_layout = (
        "<header><p>Site of it all.</p></header><div class='cookie-notice'><p>We use cookies.</p></div><div class='post-content'><h1>Title</h1><p>First text is here. It goes on.</p>"
        "<div class=ad>Buy this now.</div><p>The second text is here. It ends.</p></div><section class=comments><div class=comment><p>I like this. Thank you.</p></div></section>"
        "<form><p>Sign up to the letter now.</p></form><aside><ul><li><a href=x>One</a></ul></aside><footer>&copy; 2020</footer>"
    )
    assert main_text(other_layout, field) == "Title First text is here. It goes on. The second text is here. It ends."


def test_extract_tables(spark):
    rows = [(1, "u", "<article><p>One  text here.</p></article><nav><li>x</li></nav>", "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<article>two. three.</article>", "x"), (4, "u", "<nav>only</nav>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.text, r.n_chars) for r in extract(pages).collect()}
    assert got == {(1, "One text here.", 14), (2, "", 0), (3, "", 0), (None, "two. three.", 11), (4, "", 0)}
    assert extract(pages.limit(0)).count() == 0


CONTROL = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "[[INST]", "<<SYS>>\\<s>", "a\\\\[INST]", ""]


def test_template_round_trip():
    draw = random.Random(5)
    for _ in range(200):
        turns = [(draw.choice(["user", "assistant", "system", "tool", "[ROLE]", ""]), "".join(draw.choices([*CONTROL, "x", "[SAYS]", "[/ROLE]", "[OUT]"], k=draw.randint(0, 6)))) for _ in range(draw.randint(0, 5))]
        formatted, mask = chat.format_turns(turns)
        assert chat.parse_turns(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_fingerprints_choose_mappings(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"content": None, "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "do", "input": "this", "output": "done"},
        {"output": "done", "instruction": "do"},
        {"system": "s", "prompt": "p", "completion": "c"},
        {"question": "q", "answer": "a"},
        {"query": "q", "response": "a", "history": [["q0", "a0"]]},
        {"unknown": {"layout": [1]}},
    ]
    want = [
        ("messages", [("user", "q"), ("assistant", "")]), ("from_value", [("user", "q"), ("assistant", "a")]), ("instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        ("instruction", [("user", "do"), ("assistant", "done")]), ("prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ("question_answer", [("user", "q"), ("assistant", "a")]), ("history", [("user", "q0"), ("assistant", "a0"), ("user", "q"), ("assistant", "a")]), (None, None),
    ]
    rows = [(i, json.dumps(r), "x") for i, r in enumerate(records)] + [(None, None, "x"), (98, "not json", "x"), (99, "[1]", "x")]
    table = spark.createDataFrame(rows, "conv_id long, record string, formatted string")
    formatted = chat.format_records(table)
    names = {r.conv_id: r.mapping for r in formatted.collect()}
    back = {r.conv_id: None if r.turns is None else [(t.role, t.text) for t in r.turns] for r in chat.read_back(formatted).collect()}
    for i, (name, turns) in enumerate(want):
        assert (names[i], back[i]) == (name, turns)
    assert back[None] is None and back[98] is None and back[99] is None and len(names) == len(rows)
    assert chat.fingerprint(["a", "b"]) == chat.fingerprint(["b", "a", "a"])


def test_odd_turns(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 0, "user", "q"), (2, None, None, "x"), (None, 0, "user", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in chat.read_back(chat.format_records(chat.message_records(table))).collect()}
    assert back == {1: ([("user", "q"), ("user", "q"), ("assistant", "")], ""), 2: ([("", "x")], ""), None: ([("user", "y")], "")}
    assert chat.message_records(table.limit(0)).count() == 0


# --- pages of other layouts than the table's

SAYS = ("The storm reached the coast late on Monday night, and the harbour was closed.", "Officials said that repairs would take about three weeks.", "Residents were told to boil water.")
ITEMS = ("Two cups of flour and some salt.", "Butter", "Three eggs", "Stir for ten minutes.", "Bake until golden.")
CONTAINERS = (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div class="post-body">', "</div>"), ('<main><article class="entry">', "</article></main>"), ('<div id="main">', "</div>"))
BODIES = ("<body>", '<body class="no-sidebar comments-open">', '<body class="has-sidebar menu-fixed">')
LISTS = {
    "ul": "<ul>" + "".join(f"<li>{x}</li>" for x in ITEMS) + "</ul>", "ol": "<ol>" + "".join(f"<li>{x}" for x in ITEMS) + "</ol>",
    "table": "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in ITEMS) + "</table>", "quote": "<blockquote>" + "".join(f"<p>{x}</p>" for x in ITEMS) + "</blockquote>",
    "heads": "".join(f"<h2>{x}</h2>" for x in ITEMS), "dl": "<dl>" + "".join(f"<dt>{x}</dt>" for x in ITEMS) + "</dl>", "pre": "<pre>" + " ".join(ITEMS) + "</pre>",
    "links": "<ul>" + "".join(f'<li><a href="x">{x}</a></li>' for x in ITEMS) + "</ul>",
}


@pytest.fixture(scope="module")
def table_field(spark):
    return fit_on(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "page_id", "html")


@pytest.mark.parametrize("kind", LISTS)
def test_lists_tables_and_quotes_of_an_article(table_field, kind):
    for (begin, end), body in itertools.product(CONTAINERS, BODIES):
        page = (
            f"<html><head><title>T</title></head>{body}<header><h1>My Site</h1></header><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
            f'{begin}<h1>Storm over the coast</h1><p>{SAYS[0]}</p>{LISTS[kind]}<p>{SAYS[1]}</p><div class="ad"><p>Buy now.</p></div><p>{SAYS[2]}</p>{end}'
            '<div class="sidebar"><h3>Popular</h3><p>Popular this week</p></div><section class="comments"><h3>Comments</h3><p>I liked this a lot, thank you.</p></section>'
            "<form><p>Sign up now</p></form><footer><p>© 2020 My Site</p></footer></body></html>"
        )
        assert main_text(page, table_field) == " ".join(["Storm over the coast", SAYS[0], *ITEMS, *SAYS[1:]]), (begin, body)


def test_names_of_the_whole_page_say_nothing():
    for body in BODIES:
        (block,) = leaf_blocks(f'<html class="nav">{body}<p>Text.</p></body></html>')
        assert not [f for f in block.path if f.startswith("as:")]
    (block,) = leaf_blocks('<div class="no-ads article-text" id="story"><p>Text.</p></div>')
    assert [f for f in block.path if f.startswith("as:")] == ["as:article", "as:story", "as:text"]


def test_copies_of_a_page_are_one_page_of_the_sample(spark):
    pages = [f"<html><body><nav><ul><li>Home</li></ul></nav><article><p>Story {i} is told here.</p></article><div class='x{i % 3}'><p>Other {i}</p></div></body></html>" for i in range(12)]
    make = lambda rows: spark.createDataFrame([(i, h, "x") for i, h in enumerate(rows)], "page_id long, html string, draw string")
    once, often = (fit_on(make(rows), "page_id", "html", 8) for rows in (pages, pages + [pages[4], None] * 300))
    assert once.weights == often.weights and once.transitions == often.transitions
    assert fit_on(make(pages).limit(0), "page_id", "html").weights
