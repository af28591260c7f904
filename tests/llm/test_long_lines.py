"""op9: the edits allowed grow with a line's length, and no link of long lines is lost, under hot keys either."""

import random

import pytest

from weftgraph.llm import op9_lines

from . import cases
from .test_lines import distance, edited


def prose(rng, chars):
    """A line of at least `chars` characters."""
    line = cases.prose(rng, 8)
    while len(line) < chars:
        line += " " + cases.prose(rng, 8)
    return line


def test_a_changed_word_is_linked(spark):
    rng = random.Random(3)
    line = prose(rng, 500)
    words = line.split(" ")
    other = " ".join([*words[:30], "altered", *words[31:]])
    assert 1 < distance(line, other) <= op9_lines.RULE.allowed(500)
    rows = op9_lines.line_classes(cases.frame(spark, [(1, line), (2, other), (3, prose(rng, 500))])).collect()
    told = {r.doc_id: (r["class"], r.n_links, r.first) for r in rows}
    assert told[1][0] == told[2][0] != told[3][0]
    assert [told[k][1:] for k in (1, 2, 3)] == [(1, True), (1, False), (0, True)]


@pytest.mark.parametrize("chars", [96, 200, 480, 960, 2500, 6000])
def test_long_lines_meet(chars):
    """A filed key is probed by every line within the edits allowed, wherever these are."""
    rng = random.Random(chars)
    for turn in range(30):
        x = "".join(rng.choice("abcdefghijklmnop ") for _ in range(chars + rng.randint(0, chars // 3)))
        allowed = op9_lines.RULE.allowed(len(x))
        assert allowed >= chars // 48
        if turn % 3:
            y = edited(rng, x, allowed)
        else:  # all at one place
            at = rng.randrange(len(x) - allowed)
            y = x[:at] + ("z" * allowed if turn % 2 else "") + x[at + (0 if turn % 2 else allowed) :]
        if not op9_lines.within(x, y, op9_lines.RULE.allowed(min(len(x), len(y)))):
            continue
        short, long = sorted((x, y), key=len)
        who, key, role, *_ = op9_lines.first_keys([short, long], op9_lines.RULE)
        filed = set(key[(who == 0) & (role & op9_lines.INDEX > 0)].tolist())
        assert filed & set(key[(who == 1) & (role & op9_lines.PROBE > 0)].tolist()), turn


def test_long_lines_of_a_hot_key(spark, monkeypatch):
    """Long copies with some edits each, more than a hot key's and than a block's, have all their links."""
    monkeypatch.setattr(op9_lines, "BLOCK", 8)
    rng = random.Random(11)
    line, rule = prose(rng, 330), op9_lines.Rule(hot=4)
    lines = sorted({edited(rng, line, rng.randint(0, 6)) for _ in range(30)})
    nodes = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    want = {(n, m) for m in range(len(lines)) for n in range(m) if distance(lines[n], lines[m]) <= rule.allowed(min(len(lines[n]), len(lines[m])))}
    assert 0 < len(want) < len(lines) * (len(lines) - 1) // 2
    found = [(min(r), max(r)) for r in op9_lines.links_of(nodes, rule).collect()]
    assert len(found) == len(set(found))
    assert set(found) == want
