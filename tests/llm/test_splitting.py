import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm.splitting import all_pieces, oversized_items, split_oversized, split_text

TEXTS = ["a" * 5000, "é" * 3000, "\r\n" * 3000, " " * 4000, "🦊 " * 1000, "x\r\n" * 1500, "# h\n\n" + "word " * 900, "- item one\n" * 400, "```\n" + "    code();\n" * 300 + "```\n", "A sentence. " * 300, "\t" * 1300, "a\rb" * 900]


def check(text, limit=1200, overlap=100):
    at, spans = 0, split_text(text, limit, overlap)
    for k, (a, own, b) in enumerate(spans):
        assert own == at and a <= own < b
        assert k or a == own
        assert len(text[a:b].encode()) <= limit and len(text[a:own].encode()) <= overlap
        assert not k or a >= spans[k - 1][1]
        at = b
    assert at == len(text)
    return spans


@pytest.mark.parametrize("text", TEXTS)
def test_fixed(text):
    assert len(check(text)) > 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["# head\n", "text here. ", "\n\n", "- li\n", "    in\n", "é🦊中", "```\n", "longword" * 9, "\r\n", "\t", "<ul>", "<li>", "</li>", "</ul>", "<b>x</b>"]), max_size=60), st.integers(20, 90), st.integers(0, 12))
def test_property(parts, limit, overlap):
    check("".join(parts), limit, overlap)


def test_limit_is_no_case():
    assert len(split_text("x" * 1200)) == 1 and len(split_text("é" * 600)) == 1 and len(split_text("x" * 1201)) == 2 and split_text("") == []


def test_natural_boundaries():
    text = "".join(f"# Part {i}\n\n" + "Some words make a sentence here. " * 12 + "\n\n" for i in range(12))
    own = [text[o:b] for _, o, b in split_text(text)]
    assert all(p.startswith("# Part") for p in own)
    code = "".join(f"def f{i}():\n" + "    x = call(1)\n" * 20 for i in range(12))
    assert all(code[o:].startswith("def f") for _, o, _ in split_text(code))


def test_operator(spark):
    data = [("chunk", 1, 10, "l1\r\n" * 400), ("span", 2, 7, "wörd " * 400), ("chunk", 3, None, "x" * 3000), ("chunk", 4, 1, None), ("chunk", 5, 1, ""), ("span", 6, 1, "y" * 1200), ("chunk", 1, 10, "l1\r\n" * 400)]
    df = spark.createDataFrame([(*r, "extra", 0) for r in data], "origin string, item_id long, first long, text string, pieces string, piece int")
    got = split_oversized(df).collect()
    assert {r["item_id"] for r in got} == {1, 2, 3}
    for item, text, first, lines in ((1, "l1\r\n" * 400, 10, True), (2, "wörd " * 400, 7, False)):
        own = sorted({tuple(r) for r in got if r["item_id"] == item}, key=lambda r: r[2])
        at = 0
        for origin, _, piece, pieces, start, shared, part in own:
            begin = at - len(part.encode()[:shared].decode())
            assert text[begin:].startswith(part) and pieces == len(own)
            assert start == first + (text[:begin].count("\n") if lines else begin)
            at = begin + len(part)
        assert at == len(text)
    assert all(r["first"] is None for r in got if r["item_id"] == 3)
    assert sorted((r["origin"], r["item_id"]) for r in oversized_items(df).collect()) == [("chunk", 1), ("chunk", 1), ("chunk", 3), ("span", 2)]
    assert all_pieces(df).filter("item_id = 6").count() == 1 and all_pieces(df).filter("item_id IN (4, 5)").count() == 0
    assert split_oversized(df.limit(0)).count() == 0


def own_parts(text, **options):
    return [text[own:b] for _, own, b in split_text(text, **options)]


def test_markup_is_cut_between_elements():
    items = "".join(f"<li>item number {i} and some <b>words</b> in it. Twice so.</li>" for i in range(60))
    for text in (f"<html><body><ul>{items}</ul></body></html>", f"<p>Before it.</p>\n<ol>{items}</ol>", f"a < b <ul>{items}</ul> <unclosed> </other>"):
        parts = own_parts(text)
        assert "".join(parts) == text and len(parts) > 2
        for p in parts[1:-1]:
            assert p.startswith("<li>") and p.endswith("</li>")
    rows = "".join(f"<tr><td>{i}</td><td>{'cell ' * 30}</td></tr>" for i in range(40))
    assert all(p.endswith(("</tr>", "</table>")) for p in own_parts(f"<table>{rows}</table>"))
    nested = "<div>" * 300 + "word. " * 400 + "</div>" * 300
    assert "".join(own_parts(nested)) == nested


def test_deep_nesting_is_kept():
    """Outer blocks are boundaries before inner ones at any depth."""
    text = "".join(" " * (60 + 10 * (i % 5 > 0)) + f"line {i} of a deep block\n" for i in range(100))
    assert all(int(p.split()[1]) % 5 == 0 for p in own_parts(text))


def test_the_first_piece_has_all_the_room():
    text = "x" * 5000
    assert [len(p) for p in own_parts(text, limit=1200, overlap=100)] == [1200, 1100, 1100, 1100, 500]
    assert [b - a for a, _, b in split_text(text, limit=1200, overlap=100)][:4] == [1200] * 4
