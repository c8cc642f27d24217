"""URL rules against SQL, and page differencing against a table-filling LCS and hand-made pages."""

import random

import duckdb
import pytest

from ledgerloom.llm import html_text, url_filter


def test_rules_match_sql(spark, sf_dir):
    got = url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.RULES).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{sf_dir}/pages.parquet'")
    want = con.execute(url_filter.SQL).df()
    key = lambda df: sorted(map(repr, df[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(df.notna(), None).values.tolist()))
    assert key(got) == key(want)


URLS = {
    None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/es/": ("", "", None, "allow"),
    "http://EXAMPLE.org/es/x?y#z": ("example.org", "/es/x", "example.org/es/", "block"),
    "http://a.example.org/en/12": ("a.example.org", "/en/12", "example.org/en/1", "block"),
    "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"), "http://x.org": ("x.org", "", None, "allow"),
    "http://com/de/": ("com", "/de/", "com/de/", "block"), "x://É.com/de/#": ("É.com", "/de/", "com/de/", "block"),
    "a://b://c.org/": ("b:", "//c.org/", None, "allow"), "http://" + "s." * 500 + "org/" + "p" * 5000: ("s." * 500 + "org", "/" + "p" * 5000, "org/", "allow"),
}


def test_odd_urls(spark):
    rows = [(k, u, "kept out") for k, u in enumerate(URLS)] + [(0, None, "again")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string"), url_filter.RULES)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(k, *URLS[u]) for k, u, _ in rows], key=repr)
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), url_filter.RULES).count() == 0
    none = url_filter.judge_urls(spark.createDataFrame([(1, "http://a.b/")], "page_id bigint, url string"), [], default="block")
    assert none.first()["verdict"] == "block"


def test_colliding_keys_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x: 7)
    rules = [("block", "a", "/"), ("allow", "b", "/"), ("block", "c", "/")]
    (tmp_path / "d").write_bytes(url_filter.digest_file(rules))
    d = url_filter.Digest(str(tmp_path / "d"))
    assert [d.rule(i) if i >= 0 else None for i in d.find(["b/", "x/", "c/", "a/"])] == [b"b/", None, b"c/", b"a/"]


def test_bad_rules_are_refused():
    for rules in ([("maybe", "a", "/")], [("allow", "", "/")], [("allow", "a", "/"), ("block", "a", "/")]):
        with pytest.raises(ValueError):
            url_filter.digest_file(rules)


def table_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(1500):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2))
        found = sorted(html_text.shared_lines(a, b))
        rest = iter(b)
        assert len(found) == table_lcs(a, b) and all(any(a[i] == y for y in rest) for i in found)


PAGES = {
    None: "", "": "", "plain": "plain", "<p>a&amp;&nbsp; b<br>c<p>d": "a& b c\nd", "<!-- x": "", "a < b <c": "a < b",
    "<nav><a>m</a></nav><p>x<script>if(a</p>b)</script>y</p><footer>f": "xy",
    "<div class='top-ad'>ad</div><div class='main-ad-free'>ok</div>": "ok",
    "<p>x <span class=notice>n</span>y</p>": "x y",
    "out<article><header><h1>T</h1></header><aside>no</aside><p>x</article>out": "T\nx",
    "<article><p>a<form><p>f</form><div id='comments'><p>c</div><p>b": "a\nb",
    "<style>p{}</style><title>t</title><svg><text>s</text></svg><p hidden>h</p><p>v &am": "v &am",
}


def test_hand_made_pages(spark):
    rows = [(k, f"http://h{k}.org/", html, "x") for k, html in enumerate(PAGES)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {k: PAGES[html] for k, _, html, _ in rows}
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_lines_of_the_site_go_and_copies_of_articles_stay(spark):
    frame = "<p>Home</p>{}<p>All rights reserved</p>"
    rows = [(k, f"http://one.org/a/{k}", frame.format(f"<p>only {k}</p>")) for k in range(6)]
    rows += [(10 + k, f"http://two.org/{k}", frame.format("<article><p>the same</p></article>")) for k in range(3)]
    rows += [(20, None, "<p>alone</p>"), (21, "http://three.org/x", frame.format("<p>single</p>"))]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).repartition(1))
    want = {k: f"only {k}" for k in range(6)} | {10 + k: "the same" for k in range(3)} | {20: "alone", 21: "Home\nsingle\nAll rights reserved"}
    # One partition here, so that every page meets its neighbour.
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {r["page_id"]: r["text"] for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def cut_into(spark, n):
    """Settings under which rows are dealt over n partitions, which stay as they are."""
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true" if n == 4 else "false")


def test_unmarked_copies_keep_their_text(spark):
    frame = "<p>Home</p>{}<p>All rights reserved</p>"
    a, b = (frame.format(f"<p>{x} of an article long enough</p><p>and its end {x}</p>") for x in ("text one", "text two"))
    near = a.replace("Home</p>", "Home</p><p>7</p>")
    rows = [(1, "http://h.org/a", a), (2, "http://h.org/a?page=2", a), (3, "http://h.org/a#x", a), (4, "http://h.org/a2", a),
            (4, "http://h.org/a2", a), (5, "http://h.org/a3", near), (6, "http://h.org/b", b), (7, "http://h.org/b?p", b),
            (8, "http://only.org/a", a), (9, "http://only.org/b", a), (10, None, a), (11, None, b), (12, "http://h.org/c", None)]
    one, two = ("\n".join(f"{x} of an article long enough|and its end {x}".split("|")) for x in ("text one", "text two"))
    whole = lambda text: f"Home\n{text}\nAll rights reserved"
    want = {1: one, 2: one, 3: one, 4: one, 5: f"7\n{one}", 6: two, 7: two, 8: whole(one), 9: whole(one), 10: whole(one), 11: whole(two), 12: ""}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for n in (1, 9):
        cut_into(spark, n)
        try:
            got = html_text.extract(df).collect()
        finally:
            cut_into(spark, 4)
        assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got} == want


def test_cuts_between_partitions_change_nothing(spark):
    frame = "<p>Home</p><p>{}</p><p>All rights reserved by {}</p>"
    rows = [(k, f"http://h{k // 40}.org/{k % 40:02}", frame.format(f"only {k // 12 if k % 40 > 20 else k}", k // 40)) for k in range(120)]
    # Of 12 copies the neighbours are beyond the group, which fills whole partitions.
    want = {k: f"only {k // 12 if k % 40 > 20 else k}" for k, *_ in rows}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for n in (1, 7, 60):
        cut_into(spark, n)
        try:
            got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
        finally:
            cut_into(spark, 4)
        assert got == want


def test_articles_of_the_table(spark, sf_dir):
    import html
    import re

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(rows).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<br>|<b>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_odd_pages_take_no_longer():
    for page in ('<a "' * 20_000, "<" * 100_000, "<div>" * 30_000 + "</p>" * 30_000, "<p>x" * 30_000):
        html_text.page_lines(page)
    same = ["x"] * 9_000
    assert len(html_text.shared_lines([*same, "a"], ["b", *same])) == 9_000
    for tag in ("<a '>' ", '<a ">" ', "<a \"'> ", "<b x='\"' y=\">' "):
        html_text.page_lines(tag * 60_000)


def test_tags_of_any_length_end_outside_quotes():
    """Also beyond the number of parts that the pattern reads, and where no end is outside quotes."""
    for n in (1, 80, 120, 5_000):
        tag = "<div " + " ".join(f"a{k}='x>{k}'" for k in range(n)) + ">"
        assert html_text.page_lines(f"{tag}<p>one</p></div>two") == [("one", html_text.OUTSIDE), ("two", html_text.OUTSIDE)]
        frame = "<div " + "".join(f'a{k}=">" ' for k in range(n)) + "class='sidebar'>"
        assert html_text.page_lines(f"{frame}<p>one</p></div>two") == [("one", html_text.FRAME), ("two", html_text.OUTSIDE)]
        assert html_text.page_lines("<div " + "a=1 b='2' " * n + "c='>one") == [("one", html_text.OUTSIDE)]


def test_long_alignments_are_exact(monkeypatch):
    """4,100 lines in the same order behind 9,000 others that both have too; and small tables that are halved."""
    same, other = [f"s{k}" for k in range(4_100)], [f"o{k}" for k in range(9_000)]
    a, b = [*same, *other], [*other[::-1], *same]
    assert len(html_text.shared_lines(a, b)) >= 4_100
    assert html_text.shared_lines(a, b) >= set(range(1, 4_100))
    rng = random.Random(5)
    for stretch in (1, 2, 3):
        monkeypatch.setattr(html_text, "STRETCH", stretch)
        for _ in range(400):
            a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2))
            found = sorted(html_text.shared_lines(a, b))
            rest = iter(b)
            assert len(found) == table_lcs(a, b) and all(any(a[i] == y for y in rest) for i in found)


def test_marked_pages_are_differenced_too(spark, tmp_path):
    """Their marks correct the result, they do not take the place of the step."""
    from ledgerloom.llm.scratch import Scratch

    page = "<nav>Home</nav><p>Top</p><article><p>Said by all</p><p>only {}</p></article><p>All rights reserved</p>"
    rows = [(k, f"http://h.org/{k}", page.format(k)) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    source = df.selectExpr("page_id _key", "url _url", "page_id h1", "page_id h2", "'h.org' _host", "concat('/', page_id) _path", "html _html")
    shared = {r["h1"]: r["shared"] for r in html_text.shared_places(source, Scratch(spark, "pages")).collect()}
    assert set(shared) == set(range(6)) and all(len(x) >= 3 for x in shared.values())
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == {k: f"Said by all\nonly {k}" for k in range(6)}
