"""Trees of pages against Python's own parser, and cards that aren't list items."""

import random
from html.parser import HTMLParser

import pytest
from lotwise.sources import html as H

SALE = "$12.50 <i>Time remaining:</i> 2d"


def cards(page):
    return [(i, t) for i, t, _, _ in H.cards_of(H.parse(page))]


PAGES = {
    "list item": ('<ul><li><a href="/item/1">One</a> ' + SALE + "</li></ul>", [("1", "One")]),
    "div": ('<div class="c"><div><h3><a href="/item/1">One</a></h3></div><div>' + SALE + "</div></div>", [("1", "One")]),
    "table row": ('<table><tr><td><a href="/item/1">One</a><td>' + SALE + '<tr><td><a href="/item/2">Two</a><td>$3 Buy It Now</table>', [("1", "One"), ("2", "Two")]),
    "seven around": ("<div>" * 1 + "<section>" * 6 + '<a href="/item/1">One</a>' + "</section>" * 6 + SALE + "</div>", [("1", "One")]),
    "eight around": ("<div>" * 1 + "<section>" * 7 + '<a href="/item/1">One</a>' + "</section>" * 7 + SALE + "</div>", []),
    "no price": ('<li><a href="/item/1">One</a> Time remaining: 2d</li>', []),
    "no title": ('<li><a href="/item/1"><img src="x"></a>' + SALE + "</li>", []),
    "first of an id": ('<li><a href="/item/1">One</a>' + SALE + '</li><li><a href="/item/1">Again</a>' + SALE + "</li>", [("1", "One")]),
    "later link of an id": ('<p><a href="/item/1">Bare</a></p><div><a href="/item/1">One</a>' + SALE + "</div>", [("1", "One")]),
    "unclosed items": ('<ul><li><a href="/item/1">One</a> $1 Buy It Now<li><a href="/item/2">Two</a></ul>', [("1", "One"), ("2", "Two")]),
    "nested lists": ('<ul><li>$5 Buy It Now<ul><li><a href="/item/1">One</a></li></ul></li></ul>', [("1", "One")]),
    "hidden price": ('<div><a href="/item/1">One</a><script>"$1 Buy It Now"</script><!-- $1 Buy It Now --></div>', []),
    "split price": ('<div><a href="/item/1">One &amp; <b>more</b></a> <span>$</span><span>9</span> Buy It Now</div>', [("1", "One & more")]),
    "other links": ('<div><a href="/items/1">x</a><a name="y">z</a>' + SALE + "</div>", []),
    "quotes": ("<div><a title='>' href='https://x/item/77?a=1'>One</a>" + SALE + "</div>", [("77", "One")]),
    "empty": ("", []), "null": (None, []), "junk": ("<<<a href=/item/1>One</a> </b></div> < $1 Buy It Now", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_cards(name):
    page, want = PAGES[name]
    assert cards(page) == want


class Plain(HTMLParser):
    """Well-formed pages: elements with their parents, and what each shows."""

    def __init__(self):
        super().__init__()
        self.tags, self.parent, self.shown, self.open = [], [], [], []

    def handle_starttag(self, tag, attrs):
        self.parent.append(self.open[-1] if self.open else -1)
        self.tags.append(tag)
        self.shown.append("")
        if tag not in H.VOID:
            self.open.append(len(self.tags) - 1)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        for k in self.open:
            self.shown[k] += data


def test_trees_equal_another_parser():
    r = random.Random(1)

    def grow(depth):
        if depth == 0 or r.random() < 0.2:
            return r.choice(["text ", "a &lt; b ", "<br>", "<img src='x>y'>", "<!-- <b>no</b> -->", "é "])
        tag = r.choice(["div", "span", "b", "section", "em"])
        return f'<{tag} class="k{r.randrange(9)}">' + "".join(grow(depth - 1) for _ in range(r.randrange(4))) + f"</{tag}>"

    for _ in range(150):
        page = "".join(grow(6) for _ in range(3))
        plain, tree = Plain(), H.parse(page)
        plain.feed(page)
        plain.close()
        assert (tree.tag, tree.parent) == (plain.tags, plain.parent)
        assert ["".join(tree.text(k).split()) for k in range(len(tree.tag))] == ["".join(x.split()) for x in plain.shown]
        for k, up in enumerate(tree.parent):
            assert up < k and (up < 0 or tree.begin[up] <= tree.begin[k] <= tree.end[k] <= tree.end[up]) and tree.depth[k] == (tree.depth[up] + 1 if up >= 0 else 0)


def test_a_million_open_elements_and_tables(spark):
    assert len(H.parse("<div>" * 200_000).tag) == 200_000
    df = spark.createDataFrame([(1, PAGES["div"][0], "x"), (2, None, "x"), (1, PAGES["div"][0], "x")], "page_id long, html string, id string")
    assert [tuple(r)[:3] for r in H.cards(df, "page_id").collect()] == [(1, "1", "One")] * 2
    assert H.elements(df, "page_id").where("page_id = 1 and tag = 'a'").first()["depth"] == 3 and H.cards(df.limit(0), "page_id").count() == 0
