"""The declaration of a page counts wherever it stands."""

import time

from ledgerloom.llm.langid import declared_language, fit_text_model


def test_a_late_declaration_counts():
    assert declared_language("<!--" + "x" * 200_000 + "--><html class=a lang='fr-CA'>") == "fr"
    assert declared_language("<html><HTML LANG = de>" + "x" * 70_000) == "de"
    assert declared_language("<html " + "a " * 100_000 + 'lang="es">') == "es"
    assert declared_language("<p lang=de>") == declared_language(None) == declared_language("<html>lang=de") == ""


def test_pages_of_open_tags_take_linear_time():
    began = time.time()
    assert declared_language("<html " * 200_000) == ""
    assert time.time() - began < 5


def test_the_model_is_fitted_by_tasks_that_all_scan(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i} of them", ("en", "de")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")

    def refuse(*_):
        raise AssertionError("coalesce() would scan the whole table in a few tasks")

    monkeypatch.setattr(type(docs), "coalesce", refuse)
    assert fit_text_model(docs.repartition(7), sample=5) == fit_text_model(docs.repartition(2), sample=5)


def test_page_text_equals_its_rule_and_takes_linear_time():
    import random
    import re
    import time
    from html import unescape

    from ledgerloom.llm.langid import page_text

    drop = re.compile(r"<(script|style|nav|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<div class=\"ad\">.*?</div>", re.S | re.I)
    rng = random.Random(8)
    parts = ["<script>", "</script >", "</SCRIPT>", "<scripts>", "<style a=1>", "</style>", "<!--", "-->", "--", '<div class="ad">', "</div>", "<div>", "<", ">", "text", "&amp;", "<nav", "</nav\n>", "<b>", " ", "<noscript>", "</noscript>"]
    for _ in range(4000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert page_text(page) == unescape(re.sub("<[^>]*>", " ", drop.sub(" ", page)))
    for piece in ("<script>", "<", "<!--", '<div class="ad">', "</script ", "<script></style>"):
        began = time.perf_counter()
        page_text(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 2
