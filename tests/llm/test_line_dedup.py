from collections import Counter, defaultdict

from docgrain.llm import line_dedup as L

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, ratio, least):
    total, pages = Counter(), defaultdict(Counter)
    for site, text in rows:
        total[site] += 1
        for line in {x.strip(BLANK) for x in (text or "").split("\n")} - {""}:
            pages[site][line] += 1
    out = []
    for site, text in rows:
        lines = (text or "").split("\n")
        bad = [x for x in lines if x.strip(BLANK) and pages[site][x.strip(BLANK)] >= least and pages[site][x.strip(BLANK)] > ratio * total[site]]
        kept = [x for x in lines if x not in bad]
        if bad and any(x.strip(BLANK) for x in kept):
            out.append((site, "\n".join(kept), len(bad)))
        else:
            out.append((site, text, 0))
    return sorted(out, key=str)


def test_against_brute_force(spark, clashing):
    rows = [(f"s{i % 3}", f"Menu of s{i % 3}\n  page {i}  \n\n" + ("Copyright\n" if i % 2 else "") + f"tail {i % 5}\t") for i in range(60)]
    rows += [("s0", "Menu of s0"), ("s0", None), (None, "Menu of s0\nx"), ("s1", "")]
    df = spark.createDataFrame(rows, "source string, text string")
    got = [(r["source"], r["text"], r["dg_dropped"]) for r in L.drop_boilerplate(df, ratio=0.3, min_pages=4, counts=True).collect()]
    assert sorted(got, key=str) == brute(rows, 0.3, 4)
    assert any(n for _, _, n in got)
    assert ("s0", "Menu of s0", 0) in got  # nothing would be left


def test_all_columns_and_rows_come_back(clashing, no_docs):
    out = L.drop_boilerplate(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    assert L.drop_boilerplate(no_docs).count() == 0


def test_main_path_runs_no_python(edge_docs):
    plan = L.drop_boilerplate(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
