import random

import pytest

from mirador.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    lines = [(i, k, line.strip(" ")) for i, t in rows for k, line in enumerate((t or "").split("\n"))]
    lines = sorted(x for x in lines if len(x[2]) >= ld.MIN_CHARS)
    first, out = {}, set()
    for i, k, line in lines:
        if line in first:
            out.add((i, k, "equal"))
        else:
            first[line] = (i, k)
    for line, place in first.items():
        if any(p < place and abs(len(o) - len(line)) <= ld.TAU and distance(o, line) <= ld.TAU for o, p in first.items()):
            out.add((*place, "near"))
    return out


@pytest.fixture(scope="module")
def edited():
    rng, rows = random.Random(3), []
    letters = "abcdefghé東 "
    bases = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 60))).strip(" ").ljust(20, "x") for _ in range(12)]
    for i in range(60):
        lines = []
        for _ in range(3):
            s = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 4)):
                at, what = rng.randrange(len(s)), rng.randrange(3)
                if what == 0:
                    s[at] = rng.choice(letters)
                elif what == 1:
                    s.insert(at, rng.choice(letters))
                else:
                    del s[at]
            lines.append("".join(s))
        rows.append((i, "\n".join(lines + ["short"])))
    return rows


def found(df, **kw):
    return {(r.doc_id, r.line_no, r.kind) for r in ld.line_matches(df, **kw).collect()}


def test_equals_brute_force(spark, edited):
    want = brute(edited)
    assert len({x[2] for x in want}) == 2
    assert found(spark.createDataFrame(edited, "doc_id long, text string")) == want


def test_without_broadcasts(spark, edited, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_ROWS", -1)
    assert found(spark.createDataFrame(edited, "doc_id long, text string")) == brute(edited)


def brute_classes(rows):
    """(doc_id, line_no, class_doc_id, class_line_no, n_links, kind), by all pairs of lines."""
    lines = sorted((i, k, line.strip(" ")) for i, t in rows for k, line in enumerate((t or "").split("\n")))
    at = {}
    for i, k, line in lines:
        if len(line) >= ld.MIN_CHARS:
            at.setdefault(line, []).append((i, k))
    near = {x: [y for y in at if x != y and abs(len(x) - len(y)) <= ld.TAU and distance(x, y) <= ld.TAU] for x in at}
    out, seen = set(), set()
    for line in at:                                   # in order of their first places
        group, todo = {line}, [line]
        while todo and line not in seen:
            for y in set(near[todo.pop()]) - group:
                group.add(y)
                todo.append(y)
        if line in seen or len(group) == len(at[line]) == 1:
            continue
        seen |= group
        out |= {(*p, *at[line][0], len(near[x]), "equal" if p != at[x][0] else "first" if x == line else "near")
                for x in group for p in at[x]}
    return out


def test_classes_and_links_equal_brute_force(spark, edited):
    df = spark.createDataFrame(edited, "doc_id long, text string")
    got = [tuple(r) for r in ld.line_classes(df).drop("th").collect()]
    want = brute_classes(edited)
    assert len(got) == len(set(got)) and set(got) == want and {r[5] for r in want} == {"first", "equal", "near"}


def test_one_line_of_a_chain_stays(spark):
    base = "a line of words that is long enough"
    rows = [(1, base + "12"), (2, base + "3456"), (3, base + "1234"), (4, "quite another line of words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rows = sorted(tuple(r) for r in ld.line_classes(df).drop("th").collect())
    assert {r[:5] for r in rows} == {x[:5] for x in brute_classes([(r.doc_id, r.text) for r in df.collect()])}
    assert sorted(r.doc_id for r in ld.remove_lines(df).collect()) == sorted({1, 2, 3, 4} - {r[0] for r in rows if r[5] != "first"})


def test_awkward_rows(spark, documents, clashing):
    got = found(clashing)
    assert (25, 0, "equal") in got and (25, 1, "equal") in got
    assert not {x for x in got if x[0] in (4, 20, 21, 26, None)} - {(4, 0, "near"), (4, 1, "near")}
    kept = ld.remove_lines(clashing)
    assert kept.columns == clashing.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert 25 not in texts and texts[20] is None and texts[21] == "" and texts[None] == "no id here but some words"


def test_empty_table_and_small_minimum(spark, documents):
    none = documents.limit(0)
    assert ld.line_matches(none).count() == 0 and ld.remove_lines(none).count() == 0
    with pytest.raises(ValueError):
        ld.line_matches(documents, tau=2, min_chars=8)


def test_no_python_in_the_plan(spark, documents):
    plan = ld.remove_lines(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
