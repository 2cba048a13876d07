import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from worldpulse.sources.selectors import Find, parse, steps

TAGS, CLASSES = ("div", "section", "b", "i"), ("x", "y")
tree = st.recursive(
    st.tuples(st.sampled_from(TAGS), st.lists(st.sampled_from(CLASSES), max_size=2), st.sampled_from((None, "p", "pq")), st.just(())),
    lambda inner: st.tuples(st.sampled_from(TAGS), st.lists(st.sampled_from(CLASSES), max_size=2), st.sampled_from((None, "p", "pq")), st.lists(inner, max_size=4)),
    max_leaves=14,
)
test = st.sampled_from(("", ".x", ".y", "[k]", "[k=p]", "[k^=p]", "[k*=q]", ":first-child"))
step = st.tuples(st.sampled_from(("*", *TAGS)), test).map("".join)
selector = st.tuples(st.lists(st.tuples(step, st.sampled_from((" ", " > ", ">"))), max_size=3), step, st.sampled_from(("", ":last-child"))).map(lambda s: "".join(a + b for a, b in s[0]) + s[1] + s[2])


def written(node, number):
    tag, classes, k, children = node
    mine = next(number)
    inside = "".join(written(c, number) for c in children)
    return f'<{tag} n="{mine}"' + (f' class="{" ".join(classes)}"' if classes else "") + (f' k="{k}"' if k else "") + f">{inside}</{tag}>"


def flat(node, parents, place, siblings, out):
    out.append((node, parents, place == 0, place == siblings - 1))
    for k, c in enumerate(node[3]):
        flat(c, parents + [(node, place == 0, place == siblings - 1)], k, len(node[3]), out)
    return out


def fits(step, node, first, last):
    tag, classes, k, _ = node
    if step.tag and step.tag != tag or step.first and not first or step.last and not last:
        return False
    own = {"class": " ".join(classes)} if classes else {}
    own |= {"k": k} if k else {}
    for name, how, value in step.tests:
        have = own.get(name)
        if have is None or not {"": True, "=": have == value, "~=": value in have.split(), "^=": have.startswith(value), "*=": value in have}[how]:
            return False
    return True


def plain(chain, node, parents, first, last):
    """From the last step inwards out, trying every element that can be the next one."""
    if not fits(chain[-1], node, first, last):
        return False
    if len(chain) == 1:
        return not chain[0].child or not parents
    nearest = range(len(parents) - 1, len(parents) - 2, -1) if chain[-1].child else range(len(parents) - 1, -1, -1)
    return any(k >= 0 and plain(chain[:-1], parents[k][0], parents[:k], parents[k][1], parents[k][2]) for k in nearest)


@settings(max_examples=500, deadline=None)
@given(tree, selector)
def test_same_elements_as_a_plain_matcher(root, text):
    html = written(root, iter(range(1000)))
    all_elements = flat(root, [], 0, 1, [])
    expected = [str(k) for k, (node, parents, first, last) in enumerate(all_elements) if plain(steps(text), node, parents, first, last)]
    assert [m.attributes["n"] for m in parse(html, [Find(text)])[0]] == expected


@settings(max_examples=200, deadline=None)
@given(tree, selector)
def test_parts_are_found_within_their_element(root, text):
    """A part's selector begins inside the element, so it sees nothing around it."""
    inner = root[3]
    html = written(root, iter(range(1000)))
    found = parse(html, [Find(root[0] + ":first-child", {"own": text})])[0][0].parts["own"]
    expected = []
    number = 1
    for k, c in enumerate(inner):
        elements = flat(c, [], k, len(inner), [])
        expected += [str(number + i) for i, (node, parents, first, last) in enumerate(elements) if plain(steps(text), node, parents, first, last)]
        number += len(elements)
    assert [m.attributes["n"] for m in found] == expected


def test_texts_and_places():
    html = "<table><tr><td>a <b>bold</b>x<td><a href='/u'>one</a> <a href='/v'>two</a><td>last<tr><td>next</table><ul><li>1<li>2</ul>"
    rows, items = parse(html, [Find("tr", {"cells": "td", "end": "td:last-child", "links": "td > a[href^='/']"}), Find("ul > li:last-child")])
    assert [[p.text() for p in r.parts["cells"]] for r in rows] == [["a boldx", "one two", "last"], ["next"]]
    assert [[p.text() for p in r.parts["end"]] for r in rows] == [["last"], ["next"]]
    assert [p.text() for p in rows[0].parts["links"]] == ["one", "two"] and [m.text() for m in items] == ["2"]
    assert parse(None, [Find("a")]) == [[]] and parse("", [Find("a")]) == [[]]


@pytest.mark.parametrize("text", ["", "a >", "> > a", "a:last-child b", "a:hover", "a,b", "a..b"])
def test_what_is_no_selector(text):
    with pytest.raises(ValueError):
        steps(text)
