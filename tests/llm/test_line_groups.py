"""op9: near copies that hot keys hold together have all their links, counted in rows in proportion to the lines."""

import collections
import random

import numpy as np
import pytest

from weftgraph.llm import op9_lines, store

from .test_lines import distance, edited
from .test_long_lines import prose


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "äöü語ab" + "".join(map(chr, range(0x4E00, 0x4F80)))])
def test_many_pairs_at_once(alphabet):
    rng = random.Random(9)
    lines = []
    for _ in range(12):
        x = "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 8, 9, 40, 64, 65, 130])))
        lines += [x, *(edited(rng, x, rng.randint(1, min(len(x), 7))) for _ in range(5))]
    lines.append("")
    a, b = (c.ravel() for c in np.indices((len(lines), len(lines))))
    most = np.array([rng.randint(0, 7) for _ in a])
    got = op9_lines.all_within(*op9_lines._packed_lines(lines), a, b, most)
    want = [op9_lines.within(lines[x], lines[y], m) for x, y, m in zip(a.tolist(), b.tolist(), most.tolist(), strict=True)]
    assert got.tolist() == want and 0 < sum(want) < len(want)


@pytest.mark.parametrize("chars", [118, 330])
def test_counts_of_a_group(spark, monkeypatch, chars):
    """Links of lines of one group and of several blocks, and of lengths apart, are all counted, and once."""
    monkeypatch.setattr(op9_lines, "BLOCK", 8)
    rng = random.Random(chars)
    line, rule = prose(rng, chars)[:chars], op9_lines.Rule(hot=4)
    most = rule.allowed(chars)
    lines = sorted({edited(rng, line, rng.randint(0, most)) for _ in range(30)} | {line + " z" * k for k in range(12)} | {prose(rng, 200)})
    nodes = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    want, of = collections.Counter(), list(range(len(lines)))
    for m, x in enumerate(lines):
        for n, y in enumerate(lines[:m]):
            if distance(x, y) <= rule.allowed(min(len(x), len(y))):
                want.update((n, m))
                of = [of[n] if c == of[m] else c for c in of]
    got = {r.node: (r.component, r.n_links) for r in op9_lines.linked_nodes(nodes, rule).collect()}
    assert {n: k for n, (_, k) in got.items()} == want
    assert len({c for c, _ in got.values()}) == len({of[n] for n in want})
    assert all((got[n][0] == got[m][0]) == (of[n] == of[m]) for n in got for m in got)


@pytest.mark.parametrize("chars", [118, 530])
def test_rows_of_near_copies(spark, monkeypatch, chars):
    """What is written for a group of near copies grows with its lines, not with its links."""
    rng = random.Random(chars)
    line, written, rows = prose(rng, chars)[:chars], store.written, []

    def counted(df, name):
        out = written(df, name)
        rows.append(out.count())
        return out

    made = {}
    for n in (150, 600):
        copies = set()
        while len(copies) < n:
            copies.add(edited(rng, line, rng.randint(1, 2)))
        nodes = spark.createDataFrame(list(enumerate(sorted(copies))), "node long, line string")
        rows.clear()
        with monkeypatch.context() as m:
            m.setattr(store, "written", counted)
            out = op9_lines.line_classes(nodes.selectExpr("node AS doc_id", "line AS text"))
        made[n] = sum(rows)
        assert out.where("n_links > 0").count() > n // 2
    assert made[600] < 6 * made[150]
