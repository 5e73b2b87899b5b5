"""Quality rules: how many labels certify a cutoff."""

import pytest
from flowpanel.llm import quality_rules

COLUMNS = "doc_id bigint, stratum string, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"


def good(spark, **strata):
    """Statistics of good documents, and their labels. `strata`: documents, and words of those with few."""
    rows = [(s, few if i < 30 else 200) for s, (n, few) in strata.items() for i in range(n)]
    rows = [(i, s, words, 5 * words, 0, 10, 0, 0) for i, (s, words) in enumerate(rows)]
    return spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([(r[0], 1) for r in rows], "doc_id bigint, quality int")


def certified(cuts, stratum):
    return {c["rule"]: c["cutoff"] for c in cuts if c["stratum"] == stratum}


def test_a_rule_needs_no_correction_for_its_grid(spark):
    strata = {"a": (620, 200), "b": (610, 200)}
    cuts = quality_rules.thresholds(*good(spark, **strata), error=0.025).collect()  # 12 sequences: 0.99**n <= 0.025 / 12 from n = 615
    # What "a" has certified to the end is passed on, so "b" has enough labels too.
    strictest = {r: float(c[-1]) for r, (_, _, c) in quality_rules.RULES.items()}
    assert certified(cuts, "a") == strictest and certified(cuts, "b") == strictest


def test_only_sequences_that_are_safe_to_their_end_pass_on_their_share(spark):
    # 30 documents of 65 words stop few_words at 60, so one sequence of "a" keeps its share.
    cuts = quality_rules.thresholds(*good(spark, a=(1000, 65), b=(530, 200))).collect()  # 0.99**530 = 0.0049 <= 0.05 / 7
    assert certified(cuts, "a")["few_words"] == 60.0 and len(certified(cuts, "b")) == 6
    cuts = quality_rules.thresholds(*good(spark, a=(1000, 65), b=(485, 200))).collect()  # 0.05 / 7 < 0.99**485 = 0.0076 <= 0.05 / 6
    assert certified(cuts, "b") == {} and len(certified(cuts, "a")) == 6


@pytest.mark.parametrize("n, rules", [(475, 0), (477, 6)])
def test_labels_needed_by_one_stratum(spark, n, rules):
    cuts = quality_rules.thresholds(*good(spark, a=(n, 200))).collect()  # 0.99**477 <= 0.05 / 6
    assert len(cuts) == rules
