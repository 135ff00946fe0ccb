"""op9's rules, word for word as its contract lists them."""

from strandline.llm import urls

CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_rules_are_the_contracts():
    listed = {(word, *rule.partition("/")[::2]) for word, rule in (part.split() for part in CONTRACT.split(", "))}
    assert {(verdict, host, path[1:]) for verdict, host, path in urls.RULES} == listed


def test_verdicts_of_rules(spark):
    texts = ["http://a.com/en/1", "http://example.com/en/71", "http://b.net/de/8", "http://m.example.net/de/7", "http://m.example.net/de/80", "http://c.org/es/"]
    rows = urls.judge(spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")).collect()
    assert [r["verdict"] for r in sorted(rows)] == ["block", "allow", "allow", "allow", "block", "block"]
