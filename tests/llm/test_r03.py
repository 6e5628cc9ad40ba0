"""Round 3: rules as the contracts state them."""

from __future__ import annotations

from foliate.llm import url_filter


def test_url_rules_are_those_of_the_contract(spark):
    """Every rule's word, alone and where a longer or shorter one fits too; a model that says the contrary changes none."""
    rules = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert ", ".join(f"{r.verdict} {r.name}" for r in url_filter.RULES) == rules
    urls = ["s://a.com/en/1", "s://example.com/en/7", "s://a.net/de/1", "s://www.example.net/de/7", "s://www.example.net/de/81", "s://org/es/"]
    p = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for bias in (-9.0, 9.0):
        got = sorted((r["page_id"], r["verdict"]) for r in url_filter.judge(p, url_filter.Model(bias, [0.0] * url_filter.CELLS)).collect())
        assert [v for _, v in got] == ["block", "allow", "allow", "allow", "block", "block"]
