"""Addresses that most rows share, and rows without any."""

import pytest

from sijill.llm import urls
from sijill.llm.text import importable


@pytest.mark.parametrize("common", [None, "http://www.example.com/en/a", "no scheme"])
def test_one_address_in_most_rows(spark, monkeypatch, common):
    importable(spark)
    monkeypatch.setattr(urls, "HOT_ROWS", 50)
    others = ["http://x.net/es/", "http://m.example.com/en/1", "http://com/", None, "http://org/"]
    rows = [(i, common if i % 10 else others[i // 10 % 5]) for i in range(1000)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string"),
                                                                               urls.rule_table(spark)).collect()}
    want = {None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://org/": ("org", "/", None, "allow"),
            "http://www.example.com/en/a": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
            "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"), "http://com/": ("com", "/", "com/", "allow"),
            "http://m.example.com/en/1": ("m.example.com", "/en/1", "example.com/en/", "block")}
    assert got == {i: want[u] for i, u in rows}
