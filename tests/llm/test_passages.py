import random

import pytest

from mirador.llm import passages


def windows(rows, n):
    """place -> window of n words, and place -> (start, end), for rows (doc_id, text)."""
    out, span = {}, {}
    for i, t in rows:
        found = list(passages.WORDS.finditer(t or ""))
        words = [m.group().encode().lower() for m in found]
        for k in range(len(words) - n + 1):
            out[i, k] = tuple(words[k:k + n])
            span[i, k] = found[k].start(), found[k + n - 1].end()
    return out, span


def brute(rows, n):
    """(doc_id, word, start, end, n_words, first_doc_id, first_word, first_start), by all windows."""
    at, span = windows(rows, n)
    first, out = {}, []
    for place in sorted(at):
        if first.setdefault(at[place], place) == place:
            continue
        f = first[at[place]]
        near = [r for r in out if r[0] == place[0] and r[1] + r[4] - n + 1 == place[1] and r[5] == f[0]
                and r[6] - r[1] == f[1] - place[1]]
        if near:
            near[0][3], near[0][4] = span[place][1], near[0][4] + 1
        else:
            out.append([*place, *span[place], n, *f, span[f][0]])
    return sorted(map(tuple, out))


def found(df, **kw):
    return sorted(tuple(r) for r in passages.repeated_passages(df, **kw).drop("th").collect())


@pytest.fixture(scope="module")
def laid_out():
    """Passages inside longer lines, over lines cut elsewhere and over lines of a few words."""
    rng = random.Random(8)

    def words(n):
        return [rng.choice(["é東", "Word", "x"]) + str(rng.randrange(10 ** 6)) for _ in range(n)]

    def lines(w, n):
        return "\n".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))

    a, b, c, d = words(50), words(53), words(90), words(49)
    rows = [(1, " ".join(words(30) + a + words(37))), (2, " ".join(words(61) + [x.encode().upper().decode() for x in a] + words(5))),
            (3, lines(words(7) + b + words(9), 25)), (4, lines(words(2) + b + words(40), 31)),
            (5, lines(c, 7)), (6, lines(words(3) + c, 11) + "\t" + " ".join(b)),
            (7, " ".join(words(20) + d + words(20))), (8, " ".join(words(10) + d + words(20))),
            (9, "same words again " * 60), (10, None), (11, ""), (12, " ".join(a[:49]))]
    rng.shuffle(rows)
    return rows


def test_passages_do_not_depend_on_lines(spark, laid_out):
    df = spark.createDataFrame(laid_out, "doc_id long, text string")
    got = found(df)
    assert got == brute(laid_out, 50)
    assert {(r[0], r[4], r[5]) for r in got} >= {(2, 50, 1), (4, 53, 3), (6, 90, 5), (6, 53, 3)}
    assert not {r[0] for r in got} & {1, 3, 5, 7, 8, 12}
    assert not passages.repeated_units(df).filter("doc_id <> 9").count()      # the lines have none of them


@pytest.mark.parametrize("n, gram", [(4, 4), (5, 2), (9, 3), (6, 1)])
def test_equal_to_all_windows(spark, n, gram, monkeypatch):
    rng = random.Random(n)
    rows = [(i, rng.choice(" \n").join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, n_words=n, gram=gram) == brute(rows, n)
    monkeypatch.setattr(passages, "BROADCAST_PRINTS", -1)
    assert found(df, n_words=n, gram=gram) == brute(rows, n)


def test_awkward_passages(spark, documents, clashing):
    got = passages.repeated_passages(clashing, n_words=5, gram=3).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got if r.doc_id == 25} >= {(25, 3)}
    # rows that repeat an id and its text have one place, as lines have
    one = documents.filter("doc_id = 4")
    assert one.count() == 3 and passages.repeated_passages(one, n_words=5, gram=3).count() == 0
    assert passages.repeated_passages(clashing.limit(0)).count() == 0
