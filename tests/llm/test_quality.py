import re
from collections import Counter

import numpy as np
import pytest

from pingscape.llm import catalog, quality

from .helpers import CLASHING, documents

SF = "/root/testdata/sf0.001"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:], w[3:], w[4:]))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


AWKWARD = [
    None, "", " \t\n\r\x0b\x0c", "a", "a b c d e a b c d e", "x " * 40, "a\n\na\n \nb\na ", "é ü\x85ñ\xa0x　y \x1c z", "a\x00b <#*$%&|>",
    "w" * 50_000, "\n".join(["same line"] * 5), "one two three four five six seven eight nine ten", "a\r\na\r\na", "word " * 30_000 + "end",
]


def counts(spark, texts):
    df, name = quality.text_statistics(documents(spark, list(enumerate(texts)), CLASHING))
    rows = df.select("doc_id", f"`{name}`").collect()
    return {r[0]: tuple(r[1][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rows}


def test_statistics_equal_brute_force(spark):
    got = counts(spark, AWKWARD)
    assert got == {i: brute(t) for i, t in enumerate(AWKWARD)}


def test_query_equals_brute_force_on_the_smoke_table(spark):
    rows = catalog.op1_quality_rules(spark, SF).collect()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for r in rows:
        b = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert not (r.kept and r.base_failed)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"  # about 2,000 held-out rows
    x, bad = quality.labelled_sample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "text")
    half = np.arange(len(bad)) % 2 == 0
    rules = quality.learn_rules({f: v[half] for f, v in x.items()}, bad[half])
    kept, truth = rules.keeps({f: v[~half] for f, v in x.items()}), bad[~half]
    assert 1 <= len(rules.rules) <= 6
    assert (~kept[truth]).mean() > 0.95
    assert kept[~truth].mean() > 0.99


def test_rules_as_columns_equal_rules_in_numpy(spark):
    docs = documents(spark, list(enumerate(AWKWARD)))
    df, name = quality.text_statistics(docs)
    rules = quality.DecisionList([quality.Rule((("symbols_per_word", ">", 0.5), ("mean_word_chars", "<=", 9.0))), quality.Rule((("repeat_share", ">", 0.4),))])
    rows = df.select("doc_id", rules.verdict(name).alias("k"), *[quality.feature(f, name).alias(f) for f in quality.FEATURES]).collect()
    x = {f: np.array([r[f] for r in rows]) for f in quality.FEATURES}
    assert [r.k for r in rows] == rules.keeps(x).tolist()
    assert "CASE WHEN" in str(rules.verdict(name)).upper()


def test_learning_prunes_and_stops():
    rng = np.random.default_rng(0)
    a, b = rng.random(2000), rng.random(2000)
    bad = (a > 0.8) | (b < 0.1)
    rules = quality.learn_rules({"symbols_per_word": a, "repeat_share": b}, bad)
    assert 2 <= len(rules.rules) <= 8
    agree = ~rules.keeps({"symbols_per_word": a, "repeat_share": b}) == bad
    assert agree.mean() > 0.97
    assert quality.learn_rules({"repeat_share": b}, rng.random(2000) < 0.1).rules == []
    assert quality.learn_rules({"repeat_share": np.zeros(0)}, np.zeros(0, bool)).rules == []


@pytest.mark.parametrize("labels", [[], [(1, None, 0), (None, 0, 0)], [(1, 0, 0), (1, 1, 0), (2, 1, None)]])
def test_without_usable_labels_only_the_base_rule_holds(spark, labels):
    docs = documents(spark, [(1, "a b c"), (2, " ".join(f"w{i}" for i in range(30))), (2, " ".join(f"w{i}" for i in range(30))), (None, None)], CLASHING)
    df, name, verdict = quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted((r[0] or -1, r[1]) for r in df.select("doc_id", verdict).collect()) == [(-1, False), (1, False), (2, True), (2, True)]


def test_empty_table(spark):
    docs, labels = documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df, _, verdict = quality.judge(docs, labels)
    assert df.select("doc_id", verdict).collect() == []
