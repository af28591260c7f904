"""op9: the distance, the completeness of segments and probes at every depth, and the query against brute force."""

import collections
import hashlib
import random

import pytest

from weftgraph.llm import op9_lines

from . import cases
from .test_big_ops import WORD, query, union


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


RULES = (op9_lines.RULE, op9_lines.Rule(hot=2), op9_lines.Rule(chars=40, edits=4, hot=3))


def linked(a, b, rule=op9_lines.RULE):
    allowed = rule.allowed(min(len(a), len(b)))
    return a != b and abs(len(a) - len(b)) <= allowed and distance(a, b) <= allowed


def test_banded_distance():
    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        b = "".join(c for c in a if rng.random() > 0.1) + rng.choice(["", "a", "bc"])
        for most in (1, 2, 3):
            assert op9_lines.within(a, b, most) == (distance(a, b) <= most)


def edited(rng, x, edits):
    x = list(x)
    for _ in range(edits):
        k = rng.randrange(len(x))
        x[k : k + 1] = rng.choice([[], [x[k], rng.choice("abz")], [rng.choice("abz")]])
    return "".join(x)


def meets(x, y, depth=0):
    """Whether x, filed, and y, probing, share a chain of keys down to a leaf."""
    filed = [r for r in x if r[1] & op9_lines.INDEX]
    probes = collections.defaultdict(list)
    for r in y:
        if r[1] & op9_lines.PROBE:
            probes[r[0]].append(r)
    for a in filed:
        for b in probes[a[0]]:
            if a[1] & op9_lines.LEAF:
                return True
            further = [list(op9_lines.further_keys(r[0], role, r[2][r[4] + r[5] :], r[3] + r[2][: r[4]], r[6], r[7])) for r, role in ((a, op9_lines.INDEX), (b, op9_lines.PROBE))]
            if meets(*further, depth + 1):
                return True
    return False


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnopqrstuvwxyz "])
def test_every_link_meets(alphabet, rule):
    rng = random.Random(7)
    tried = 0
    for _ in range(80):
        x = "".join(rng.choice(alphabet) for _ in range(rng.choice([24, 30, 40, 47, 79, 80, 119, 120, 160, 240])))
        y = edited(rng, x, rng.randint(1, max(1, rule.allowed(len(x)))))
        if not linked(x, y, rule):
            continue
        tried += 1
        short, long = sorted((x, y), key=len)
        who, key, role, at, size, left, total = (c.tolist() for c in op9_lines.first_keys([short, long], rule))
        rows = [[(key[n], role[n], (short, long)[w], "", at[n], size[n], left[n], total[n]) for n, w in enumerate(who) if w == side] for side in (0, 1)]
        assert meets(*rows), (short, long)
    assert tried > 25


@pytest.mark.parametrize("rule", RULES)
def test_lines(spark, monkeypatch, rule):
    monkeypatch.setattr(op9_lines, "RULE", rule)
    rng = random.Random(5)
    base = [*(cases.prose(rng, 8) for _ in range(12)), *(cases.prose(rng, 30) for _ in range(4)), cases.prose(rng, 60)]
    lines = [*base]
    for x in base * 3:
        lines.append(rng.choice([edited(rng, x, rng.randint(1, 3)), x, "## " + x]))
    lines += [f"a template of log lines with the value {i:04d}" for i in range(40)] + [f"{i:04d} starts a line whose end is always the same text, however long it may be, so that it is hot" for i in range(20)]
    lines += ["short", "short", "shorts", "under 24 characters", "under 24 characterz", "", " ", "\t"]
    rng.shuffle(lines)
    data = [(i, "\n".join(lines[5 * i : 5 * i + 5])) for i in range(len(lines) // 5 + 1)]
    data += [(390, None), (391, ""), data[3]]
    texts = sorted({x for _, t in data for x in (t or "").split("\n") if WORD.search(x)})
    links = [(a, b) for n, a in enumerate(texts) for b in texts[:n] if linked(a, b, rule)]
    of, degree = union(links, texts), collections.Counter(x for p in links for x in p)
    first, want = {}, {}
    for i, t in sorted(data[:-1], key=lambda x: x[0]):
        kept, gone, ties = [], 0, 0
        for n, x in enumerate((t or "").split("\n")):
            if WORD.search(x):
                ties += degree[x]
                if first.setdefault(of[x], (i, n)) != (i, n):
                    gone += 1
                    continue
            kept.append(x)
        want[i] = (gone, ties, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    got = query(monkeypatch, spark, "op9_lines", cases.frame(spark, data)).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r.n_removed, r.n_links, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert query(monkeypatch, spark, "op9_lines", cases.empty(spark)).count() == 0
    out = op9_lines.dedup_lines(cases.frame(spark, [*data, (None, "a line that stands nowhere else at all")]))
    assert out.columns == cases.frame(spark).columns and {r.doc_id for r in out.collect()} >= {390, 391, None}


def test_template_lines(spark):
    """Lines that differ in a counter form candidates in proportion to their links."""
    made = {}
    for n in (500, 1500):
        lines = [f"a template that stands before a counter of ten digits {i:010d} and some more words after it" for i in range(n)]
        nodes = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
        made[n] = op9_lines.candidates(nodes).count()
        links = sum(linked(lines[0], x) for x in lines[1:])
        assert made[n] < 60 * n + 4 * n * links
    assert made[1500] < 4 * made[500]
