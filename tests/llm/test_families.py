import random

import pytest

from cardlake.llm import linededup


@pytest.mark.parametrize("template", [0.0, 0.3, 0.6, 0.75, 0.8, 0.85])
def test_near_pairs_of_a_host_with_a_template_are_found(spark, template):
    """Pairs of pages of 300 words that differ in one word, all sharing a site's template."""
    r = random.Random(int(100 * template))
    site = [f"site{i}" for i in range(int(300 * template))]
    rows = []
    for k in range(150):
        own = [f"own{k}_{i}" for i in range(300 - len(site))]
        other = list(own)
        other[r.randrange(len(own))] = f"new{k}"
        rows += [("h", 2 * k, " ".join(site + own)), ("h", 2 * k + 1, " ".join(site + other))]
    pages = spark.createDataFrame(rows, "host string, page long, text string")
    got = {x.page: x.family for x in linededup.families(pages, 0.8).collect()}
    found = sum(got.get(2 * k, 2 * k) == got.get(2 * k + 1, 2 * k + 1) for k in range(150)) / 150
    assert found >= 0.9
    if template <= 0.8:  # unrelated pages are at most 0.67 similar: they stay apart
        assert len(set(got.values())) >= 0.9 * 150 * found
