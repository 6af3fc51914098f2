import math
import re
import unicodedata
from collections import Counter
from itertools import product

from docgrain.llm import quality_rules as Q

from .conftest import prose


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force(spark, clashing):
    extra = [(100, "a b c d e a b c d e"), (101, "a a a a a a"), (102, "a b c d"), (103, "# $ x\n# $ x\n y"), (104, "x y z w v q x y z w v r x y z w v")]
    df = clashing.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = Q.with_features(df, ["doc_id", "text"]).collect()
    assert len(got) == df.count()
    for r in got:
        assert tuple(r[c] for c in Q.FEATURES) == brute(r["text"]), r["text"] and r["text"][:50]


def test_junk_goes_and_prose_stays(spark):
    good = [prose(i, 60 + i) for i in range(200)]
    loud = [prose(i, 80).upper().replace(" ", "!! ") for i in range(10)]
    signs = [" ".join(w + "%%%" for w in prose(i, 80).split()) for i in range(10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + loud + signs)], "doc_id long, text string")
    kept = {r["doc_id"] for r in Q.judged(df, ["doc_id"]).where("kept").collect()}
    assert kept == set(range(200))
    assert {r["doc_id"] for r in Q.accept(df).collect()} == kept


def test_estimate_learns_accuracies_and_holds_without_rows():
    good, tables = Q.estimate([], 3)
    assert abs(good - Q.PRIOR_GOOD) < 1e-9 and tables == [Q.PRIOR_JUNK_VOTE] * 3
    # Votes drawn from known accuracies (three rules that say something are what makes classes known): the last rule says nothing.
    truth = {True: (0.01, 0.3, 0.1, 0.05, 0.2), False: (0.95, 0.6, 0.7, 0.5, 0.2)}
    patterns = []
    for votes in product((-1, 1), repeat=5):
        n = sum(share * math.prod(p if v < 0 else 1 - p for v, p in zip(votes, truth[c])) for c, share in ((True, 0.8), (False, 0.2)))
        patterns.append((votes, round(1_000_000 * n)))
    good, tables = Q.estimate(patterns, 5)
    assert abs(good - 0.8) < 0.01 and all(abs(tables[r][c] - truth[c][r]) < 0.02 for r in range(5) for c in truth)


def test_estimate_overturns_the_prior():
    # Three rules agree; a fourth cries junk on a third of good texts. The prior trusts its vote as any other.
    patterns = [((1, 1, 1, 1), 6000), ((1, 1, 1, -1), 3000), ((-1, -1, -1, 1), 300), ((-1, -1, 1, 1), 200), ((1, 0, 0, -1), 500), ((-1, 0, 0, 1), 50)]
    prior = (Q.PRIOR_GOOD, [Q.PRIOR_JUNK_VOTE] * 4)
    found = Q.estimate(patterns, 4)
    verdict = lambda votes, model: Q.posterior(votes, *model) >= 0.5
    assert verdict((-1, 0, 0, 1), prior) and not verdict((-1, 0, 0, 1), found)
    assert not verdict((0, -1, 0, -1), prior) or Q.posterior((0, 0, 0, -1), *found) > Q.posterior((0, 0, 0, -1), *prior)
    assert verdict((1, 1, 1, -1), found) and not verdict((-1, -1, 1, 1), found)


def votes_of(text):
    """The rules, written out for one text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n_words, word_chars, n_symbols, n_dup, n_repeat = brute(text)
    n, chars = max(1, n_words), max(1, word_chars)
    lines = max(1, len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]))
    upper = sum(unicodedata.category(c) == "Lu" for c in text or "") / chars
    stops = len(re.findall(r"[.!?](?=[\x20\x09-\x0D]|\Z)", text or "")) / n
    symbols, dup, repeat, kinds, mean = n_symbols / n, n_dup / lines, n_repeat / n, len(set(words)) / n, chars / n
    pick = lambda junk, good: -1 if junk else 1 if good else 0
    return (
        pick(n < 20, n >= 60),
        pick(mean < 3 or mean > 6.5, 4.3 <= mean <= 6),
        pick(symbols > 0.1, symbols < 0.02),
        pick(upper > 0.3, upper < 0.1),
        pick(n >= 20 and (stops < 0.03 or stops > 0.4), 0.05 <= stops <= 0.2),
        pick(dup > 0.3 and n_dup > 1, lines >= 4 and n_dup == 0),
        pick(repeat > 0.1, n >= 30 and repeat < 0.02),
        pick(30 <= n < 2000 and kinds < 0.55, n >= 30 and kinds > 0.65),
    )


def test_verdicts_against_brute_force(spark, edge_docs):
    extra = [prose(i, 40 + 3 * i) for i in range(120)] + [" ".join(w + "$$" * (i % 3) for w in prose(i, 30 + i).split()) for i in range(60)] + [prose(i, 50).upper() for i in range(9)] + [prose(i, 12 + i) for i in range(20)]
    df = edge_docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    failed = lambda t: brute(t)[0] < 10 or 100 * brute(t)[4] > 20 * brute(t)[0]
    texts = [r["text"] for r in df.collect()]
    model = Q.estimate(sorted(Counter(votes_of(t) for t in texts if not failed(t)).items()), len(Q.rules()))
    got = Q.judged(df, ["text"]).collect()
    assert Counter(r["text"] for r in got) == Counter(texts)
    for r in got:
        want = Q.posterior(votes_of(r["text"]), *model)
        assert abs(r["quality"] - want) < 1e-8 and r["base_failed"] == failed(r["text"])
        assert r["kept"] == (not failed(r["text"]) and want >= 0.5), r["text"] and r["text"][:60]


def test_edges_columns_and_plan(clashing, no_docs):
    out = Q.accept(clashing)
    assert out.columns == clashing.columns
    assert Q.judged(no_docs, ["doc_id"]).count() == 0 and Q.accept(no_docs).columns == no_docs.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
