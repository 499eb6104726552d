import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscule.llm import chat_format, html_extract, url_filter


def test_chats_equal_plain_formatting(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"é{c}·{t}" * (t * c % 7)) for c in range(40) for t in range(c % 6 + 1)]
    rows += [(1, 0, "user", "again"), (1, 0, "user", "again"), (2, None, None, None), (None, 1, "user", "x"), (None, 0, "system", "y"), (99, 0, "user", "long" * 600_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    low = lambda x: (x is not None, x if x is not None else 0)
    expected, alone = {}, []
    for c, t, r, x in sorted(rows, key=lambda v: (low(v[1]), (v[2] is not None, v[2] or ""), (v[3] is not None, v[3] or ""))):
        turn = f"<|im_start|>{r or 'unknown'}\n{x or ''}<|im_end|>\n"
        if c is None:
            alone.append(turn)
        else:
            expected[c] = expected.get(c, "") + turn
    got = chat_format.format_chats(table.select("*", F.lit(1).alias("n_turns"), F.lit("z").alias("header"))).collect()
    assert {r.conv_id: r.text for r in got if r.conv_id is not None} == expected and len(got) == len(expected) + len(alone)
    assert sorted(r.text for r in got if r.conv_id is None) == sorted(alone) and all(r.n_turns == 1 for r in got if r.conv_id is None)
    assert sum(r.n_turns for r in got) == len(rows)
    most = max(len(x.encode()) for c, x in expected.items() if c != 99)
    short = chat_format.format_chats(table, most_bytes=most).collect()
    assert {r.conv_id: r.text for r in short if r.conv_id is not None} == expected | {99: None} and sum(r.n_turns for r in short) == len(rows)
    assert chat_format.format_chats(table.limit(0)).count() == 0


RULES = ["bad.example.com", "example.org/ads", "Ünï.example", "", None, "example.org/ads"]
URLS = [
    ("http://bad.example.com/x", "bad.example.com"), ("https://sub.BAD.example.com", "bad.example.com"), ("https://notbad.example.com/", None), ("example.org/ads/1?x#y", "example.org/ads"),
    ("http://example.org/adsense", None), ("http://EXAMPLE.org/ADS", None), ("", None), (None, None), ("http://ünï.example/", None), ("://", None), ("http://Ünï.example/", None), ("x" * 100_000, None),
]


@pytest.mark.parametrize("most", [100, 1])
def test_urls_equal_set_membership(spark, most):
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)] + [(0, URLS[0][0]), (None, URLS[0][0])], "page_id long, url string")
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    got = url_filter.filter_urls(pages.withColumn("rule", F.lit("own")).withColumn("blocked", F.lit(True)), rules.withColumn("url", F.lit(1)), most).collect()
    assert len(got) == len(URLS) + 2
    listed = {r for r in RULES if r}
    for r in got:
        hits = [k for k in url_filter.keys_of(r.url) if k in listed]
        assert r.blocked == bool(hits) and r.rule == (max(hits, key=lambda h: (len(h), h)) if hits else None)
    assert all(r.rule == URLS[r.page_id][1] for r in got if r.page_id is not None)
    assert url_filter.filter_urls(pages.limit(0), rules, most).count() == 0
    assert not any(r.blocked for r in url_filter.filter_urls(pages, rules.limit(0), most).collect())


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 7)
    path = tmp_path / "d"
    path.write_bytes(url_filter.digest(["a", "bb", "ccc"]))
    keys = ["a", "b", "bb", "ccc", "cc", ""]
    assert url_filter.Digest(str(path)).find(keys, np.full(6, 7, np.uint64)).tolist() == [True, False, True, True, False, False]


def test_long_lists_make_many_files_with_the_same_result(spark):
    """3,000 rules in one file and in 64."""
    rules = spark.range(3_000).selectExpr("concat('h', id, '.example') as rule")
    pages = spark.range(9_000).selectExpr("id as page_id", "concat('http://www.h', id % 4500, '.example/', id) as url")
    for n in (10_000, 60):
        got = url_filter.filter_urls(pages, rules, n)
        assert got.where("blocked").count() == got.where("page_id % 4500 < 3000").count() == 6_000
        assert got.where("blocked and rule <> concat('h', page_id % 4500, '.example')").count() == 0


def page(i, words="some words of the article here, and more of them."):
    return (
        f"<html><head><title>t{i}</title><script>var a='</p>';</script></head><body><div class='nav top'><ul>{''.join(f'<li><a href=/{k}>link {k}</a></li>' for k in range(6))}</ul></div>"
        f"<article><h1>Title {i}</h1>{''.join(f'<p>Part {k} has {words} {words}</p>' for k in range(i % 5 + 3))}</article><footer>&copy; owner</footer></body></html>"
    )


@pytest.fixture(scope="module")
def model():
    return html_extract.fit_pages([page(i) for i in range(120)])


def test_held_out_pages_without_telling_markup(model):
    for i in range(200, 230):
        source = page(i).replace("article>", "div>").replace("footer>", "div>")
        p = html_extract.Page(source)
        text = html_extract.text_of(p, html_extract.decode(p, model.score(html_extract.describe([p]))))
        assert f"Title {i}" in text and text.count("Part") == i % 5 + 3 and "link" not in text and "owner" not in text


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(0)
    for trial in range(60):
        p = html_extract.Page("<body>" + "".join(rng.choice(["<div>a", "<div>bb", "</div>", "<p>ccc</p>"], 7)) + "</body>")
        n = len(p.tag)
        odds = rng.normal(size=n)
        own = np.zeros(n)
        for node, text in p.texts:
            own[node] += len(text)
        gain = odds * np.log1p(own)

        def best(i):
            children = [j for j in range(i + 1, n) if p.parent[j] == i]
            opened = max(gain[i], 0) + sum(map(best, children)) - html_extract.OPEN_COST if children else -1
            return max(0.0, gain[i : p.end[i]].sum(), opened)

        kept = html_extract.decode(p, odds)

        def value(i):
            inside = kept[i : p.end[i]]
            children = [j for j in range(i + 1, n) if p.parent[j] == i]
            opened = max(gain[i], 0) + sum(map(value, children)) - html_extract.OPEN_COST if children else -1
            return max(gain[i : p.end[i]].sum() if inside.all() else 0.0 if not inside.any() else -9e9, opened if kept[i] == (gain[i] > 0) else -9e9)

        assert value(0) == pytest.approx(best(0)), trial


def test_odd_pages(spark, model):
    rows = [(1, None), (2, ""), (3, "plain text"), (4, "<p>a<p>b<p"), (5, "<div>" * 3_000 + "x"), (6, page(1)), (6, page(1)), (None, page(2)), (7, "<script>only"), (8, "<p \"'>q</p>" * 500), (9, "&lt;b&gt; & <")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1)).withColumn("n_nodes", F.lit(2))
    got = html_extract.extract_pages(pages, model).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[7].text == "" and "Title 1" in by[6].text
    assert all(r.n_kept <= r.n_nodes for r in got)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
    assert all(r.text in ("", None) for r in html_extract.extract_pages(pages.where("page_id = 3")).collect())


def test_rare_telling_pages_are_fitted_on(spark):
    """40 of 4,000 pages tell content; the fit takes them wherever their hashes lie."""
    plain = lambda i: page(i).replace("article>", "div>").replace("footer>", "div>")
    rows = [(i, page(i) if i % 100 == 0 else plain(i)) for i in range(4_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    model = html_extract.fit(pages, 5)
    assert len(model.leaf) == html_extract.TREES
