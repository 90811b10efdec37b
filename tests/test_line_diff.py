"""Every pair of consecutive documents has its diff, shared lines or not."""

import random

from plumbline.operators import diff
from plumbline import plans


def test_query_keeps_rewritten_documents(spark, tmp_path):
    rows = [(1, "s", "a\nb"), (2, "s", "c\nd\ne"), (3, "s", None), (4, "s", "f"), (5, "t", "a"), (6, "t", "a\ng")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["added"], r["removed"], r["hunks"]) for r in plans.QUERIES["line_diff"](spark, str(tmp_path)).collect()}
    assert got == {2: (3, 2, 1), 3: (1, 3, 1), 4: (1, 1, 1), 6: (1, 0, 1)}


def whole_table(old, new):
    best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i, x in enumerate(old):
        for j, y in enumerate(new):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    out, i, j = [], len(old), len(new)
    while i or j:
        if i and j and old[i - 1] == new[j - 1]:
            i, j = i - 1, j - 1
            out.append((" ", old[i]))
        elif j and (not i or best[i][j - 1] >= best[i - 1][j]):
            j -= 1
            out.append(("+", new[j]))
        else:
            i -= 1
            out.append(("-", old[i]))
    return out[::-1]


def test_script_is_that_of_the_whole_table():
    r = random.Random(6)
    for _ in range(300):
        k = r.choice([3, 8, 30])
        old, new = ([f"{r.randrange(k)}" for _ in range(r.randint(0, 14))] for _ in range(2))
        assert diff.edit_script(old, new) == whole_table(old, new)
