import random
import re
import time

from pyspark.sql import functions as F

from kindling.llm.chat import Template, format_chats, parse_chats
from kindling.llm.decontaminate import contamination
from kindling.llm.line_rules import line_rules
from kindling.llm.queries import QUERIES, URL_RULES
from kindling.llm.reputation import filter_urls, match_rules, suffix_and_domain, url_document, url_host, url_path
from tests_paths import SF001

WORD, ITEM_WORD = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def test_chats_read_back_whatever_the_texts_hold(spark):
    rows = [(1, 0, "user", "a [INST] \\1 \\ <s> <<SYS>> <|role:x|> |>"), (1, 1, "assistant", "x\n\n </s>[INST] ok [/INST]"),
            (2, 0, "tool<|end|>", "z"), (2, 1, "", None), (3, None, None, None), (4, 0, "system", "<<s>\\0"),
            (4, 1, "user", "<"), (4, 2, "assistant", "[[INST]"), (5, 0, "assistant", " </s"), (5, 1, "user", " [/INST"),
            (None, 0, "user", "u"), (None, 1, "assistant", "v" * 50000), (6, 0, "user", "same"), (6, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1))
    got = {r.conv_id: r for r in format_chats(df).withColumn("back", parse_chats(F.col("formatted"))).collect()}
    for conv in {r[0] for r in rows}:
        assert [(b.role, b.text) for b in got[conv].back] == [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
        assert [s.loss for s in got[conv].segments[1::3]] == [r[2] == "assistant" for r in rows if r[0] == conv]
        assert not any(s.loss for s in got[conv].segments[::3])
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, None: True, 6: False}
    assert format_chats(df.limit(0)).collect() == []


def test_control_strings_open_with_escaped_characters():
    t = Template()
    assert all(c[0] in "<[|" and "\\" not in c for c in t.control)
    assert all(b.strip() in t.control and a.strip() in t.control for b, a in t.marks.values())


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    gone = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(8)} if len(runs) < 3500 else (
        set(range(len(words))) if len(set(runs)) == 1 else set())
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(gone))


def test_line_rules_base_counts(spark, docs, corpus, empty):
    out = line_rules(docs).collect()
    short = [r for r in corpus if r[1] is None or len(r[1]) < 10000 or r[1].startswith("x x")]
    expected = sorted(repr((r[0], *brute_base(r[1]))) for r in short)
    got = [repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in out]
    assert set(expected) <= set(got) and len(out) == len(corpus)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in out)
    assert line_rules(empty).collect() == []


def test_line_rules_remove_common_lines_of_a_host(spark):
    body = lambda i: " ".join(f"w{i}_{k}" for k in range(25))
    rows = [(i, f"Menu  HOME about us\n{body(i)}", "h") for i in range(8)]
    rows += [(20 + i, "menu home about us\n" * 6 + "just four words here", "h") for i in range(2)]
    rows += [(40 + i, f"menu home about us\n{body(40 + i)}", "other") for i in range(3)] + [(50, body(50), None)]
    out = {r.doc_id: r for r in line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0].kept_text == body(0) and out[0].kept and out[0].n_line_words == 4
    assert out[20].kept_text == "just four words here" and not out[20].kept
    assert out[40].n_line_words == 0 and out[40].kept and out[50].kept


def test_common_line_goes_whatever_the_size_of_its_host(spark):
    body = lambda i: " ".join(f"w{i}_{k}" for k in range(25))
    rows = [(i, (f"Read more\n{body(i)}" if i < 8 else body(i)), "large") for i in range(400)]
    rows += [(1000 + i, (f"read  more\n{body(1000 + i)}" if i < 8 else body(1000 + i)), "small") for i in range(10)]
    rows += [(2000 + i, f"read more\n{body(2000 + i)}", "few") for i in range(5)]
    out = line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in out if r.n_line_words} == {*range(8), *range(1000, 1008)}
    assert all(r.kept and r.kept_text == body(r.doc_id) for r in out if r.doc_id < 2000)


def test_urls(spark):
    urls = ["http://A.b.EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "http://example.com", "//x/y", None, "", "a://b://c/d",
            "http://x.co.uk/p", "http://h.net/es/1", "http://h.net?es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "i long, url string")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), URL_RULES)
    rows = df.select("i", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("verdict")).orderBy("i").collect()
    assert [(r.host, r.path) for r in rows] == [
        ("a.b.example.com", "/en/x"), ("www.example.com", "/en/"), ("example.com", ""), ("", ""), ("", ""), ("", ""),
        ("b:", "//c/d"), ("x.co.uk", "/p"), ("h.net", "/es/1"), ("h.net", "")]
    assert [r.rule for r in rows] == ["example.com/en/", "www.example.com/en/", None, None, None, None, None, None, "net/es/", None]
    suffix, domain = suffix_and_domain(F.col("h"))
    got = spark.createDataFrame([("a.x.co.uk",), ("b.c.org",), ("org",)], "h string").select(suffix, domain).collect()
    assert [tuple(r) for r in got] == [("co.uk", "x.co.uk"), ("org", "c.org"), ("org", "org")]


def test_reputation_blocks_only_what_is_surely_bad(spark):
    pages = [(i, f"http://bad.example.org/{i}") for i in range(60)] + [(100 + i, f"http://good.example.org/{i}") for i in range(60)]
    pages += [(300, "http://bad.example.org/new"), (301, "http://unseen.example.org/"), (302, None)]
    labels = [(i, int(i % 20 == 0)) for i in range(60)] + [(100 + i, 1) for i in range(60)] + [(0, None), (None, 0)]
    p, l = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")
    got = {r.page_id: r for r in filter_urls(p, l, URL_RULES).collect()}
    assert len(got) == len(pages)
    assert got[300].verdict == "block" and got[301].verdict == "allow" and got[100].verdict == "allow" and got[302].verdict == "allow"
    assert got[300].reputation < got[301].reputation < got[100].reputation
    assert filter_urls(p.limit(0), l, URL_RULES).collect() == []
    assert {r.verdict for r in filter_urls(p, l.limit(0), URL_RULES).collect()} == {"allow"}


def test_outcome_of_a_page_is_its_documents(spark, tmp_path):
    """Page numbers are not document numbers: the documents of a bad host's pages are labelled under other numbers."""
    hosts = ["bad.example.org", "good.example.org"]
    pages = [(i, f"http://{hosts[i % 2]}/en/{1000 - i}{('', '/', '.html', '?page=2', '#top')[i % 5]}") for i in range(120)]
    pages += [(200, f"http://{hosts[0]}/about"), (201, None)]
    labels = [(1000 - i, i % 2) for i in range(120)] + [(i, 1 - i % 2) for i in range(120)]  # under page numbers: reversed
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r.verdict for r in QUERIES["op7_url_filter"](spark, str(tmp_path)).collect()}
    assert got == {**{i: "allow" if i % 2 else "block" for i in range(120)}, 200: "block", 201: "allow"}
    numbers = spark.createDataFrame([(u,) for u in ("http://h/en/7", "http://h/7", "http://h/en/7x", "http://h/en/7/8", None)], "u string")
    assert [r[0] for r in numbers.select(url_document(F.col("u"))).collect()] == [7, None, None, None, None]


def test_decontamination_equals_brute_force(spark, docs, corpus, empty):
    words = lambda t: ITEM_WORD.findall((t or "").translate(ASCII_LOWER))
    texts = [" ".join(corpus[k][1].split()[a:b]) for k, a, b in ((1, 0, 20), (2, 3, 16), (5, 0, 12), (7, 2, 5), (9, 1, 2))]
    items = [(n, t.upper() if n == 1 else t) for n, t in enumerate(texts)] + [(10, None), (11, "--"), (None, texts[0]), (1, texts[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = set()
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        windows |= {(str(i), tuple(w[k:k + n])) for k in range(len(w) - n + 1)} if n and i is not None else set()
    expected = []
    for r in corpus:
        w, hit, found = words(r[1]), set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k:k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found.add(item)
        expected.append((r[0], len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    for rows in (500000, 0):  # broadcast, shuffle
        got = contamination(docs, bench, broadcast_rows=rows).collect()
        assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, expected))
    assert contamination(empty, bench).collect() == []
    assert {r.n_hit for r in contamination(docs, bench.limit(0)).collect()} == {0}


def test_benchmark_rows_without_id_contaminate(spark):
    own, named = " ".join(f"p{k}" for k in range(20)), " ".join(f"q{k}" for k in range(20))
    bench = spark.createDataFrame([(None, own), (None, "tiny"), (7, named)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + own), (2, "a tiny one"), (3, own + " " + named), (4, "clean")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in contamination(docs, bench).collect()}
    assert got == {1: (20, [], True), 2: (1, [], True), 3: (40, ["7"], True), 4: (0, [], False)}


def test_decontamination_is_linear_in_the_hits_of_a_text(spark):
    """A text of 60,000 benchmark words: with a lookup or a copy of the text per window this took minutes."""
    rng = random.Random(6)
    item = [f"b{rng.randrange(5000)}" for _ in range(400)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(item * 150)), (1, " ".join(item * 150)), (2, " ".join(["x"] * 60000))],
                                 "doc_id long, text string")
    t0 = time.time()
    got = sorted((r.doc_id, r.n_words, r.n_hit) for r in contamination(docs, bench).collect())
    assert got == [(1, 60000, 60000), (1, 60000, 60000), (2, 60000, 0)]
    assert time.time() - t0 < 90


def test_native_queries_run_no_python(spark):
    for name in ("op2_chat_format", "op4_quality_rules", "op7_url_filter", "op9_decontamination"):
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|InArrow", plan), name


def test_many_shared_lines_take_linear_time(spark):
    import time

    def run(n):
        lines = [f"line {i} of all" if i % 3 else f"own {i}" for i in range(n)]
        rows = [(k, "\n".join(x if x.startswith("line") else f"{x} {k}" for x in lines), "h") for k in range(6)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        start = time.time()
        out = {r.doc_id: r for r in line_rules(df).collect()}
        for k, text, _ in rows:
            kept = [x for x in text.split("\n") if x.startswith("own")]
            assert out[k].kept_text == "\n".join(kept) and out[k].n_line_words == 4 * (n - len(kept))
        return time.time() - start

    run(1000)
    assert run(100_000) < 60


def brute_reputation(outcomes, hosts, z=1.645):
    """Means and upper bounds level by level, in plain Python."""
    def parts(h):
        labels = h.split(".")
        long = ".".join(labels[-2:]) in ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
        return ".".join(labels[-1 - long:]), ".".join(labels[-2 - long:])

    def shrink(units, priors):
        seen = {u: (n, g) for u, (n, g) in units.items() if n}
        s = sum(n * (g / n - priors[u]) ** 2 for u, (n, g) in seen.items())
        w = sum(priors[u] * (1 - priors[u]) for u in seen)
        v = sum(n * priors[u] * (1 - priors[u]) for u, (n, g) in seen.items())
        k = 1000.0 if not seen or v <= w or s <= w else min(1000.0, max(2.0, (v - w) / (s - w) - 1))
        return k, {u: (k * priors[u] + g) / (k + n) for u, (n, g) in units.items()}

    def add(key):
        out = {}
        for h in hosts:
            n, g = out.get(key(h), (0, 0))
            out[key(h)] = (n + outcomes.get(h, (0, 0))[0], g + outcomes.get(h, (0, 0))[1])
        return out

    n, good = (sum(outcomes.get(h, (0, 0))[i] for h in hosts) for i in (0, 1))
    suffixes = add(lambda h: parts(h)[0])
    _, means = shrink(suffixes, {s: (good + 1) / (n + 2) for s in suffixes})
    domains = add(lambda h: parts(h)[1])
    of = {parts(h)[1]: parts(h)[0] for h in hosts}
    _, means = shrink(domains, {d: means[of[d]] for d in domains})
    k, final = shrink(add(lambda h: h), {h: means[parts(h)[1]] for h in hosts})
    return {h: (m, m + z * (m * (1 - m) / (k + outcomes.get(h, (0, 0))[0] + 1)) ** 0.5) for h, m in final.items()}


def test_reputation_equals_the_formulas(spark):
    import random

    import pytest

    from kindling.llm.reputation import host_reputation

    rng = random.Random(4)
    hosts = [f"{a}.{b}" for b in ("x.com", "y.com", "z.net", "q.co.uk", "w.co.uk") for a in ("www", "a", "b")] + ["", "plain"]
    for good in (0.5, 0.95, None):
        outcomes = {} if good is None else {h: (n, sum(rng.random() < (0.1 if h == "a.x.com" else good) for _ in range(n)))
                                            for h in hosts[::2] for n in [rng.randint(1, 60)]}
        seen = spark.createDataFrame([(h, *v) for h, v in outcomes.items()], "host string, n long, good long")
        pages = spark.createDataFrame([(h, 1) for h in hosts * 2], "host string, n int")
        got = {r.host: (r.reputation, r.upper) for r in host_reputation(seen, pages).collect()}
        expected = brute_reputation(outcomes, hosts)
        assert got.keys() == expected.keys()
        for h, (m, u) in expected.items():
            assert got[h] == (pytest.approx(m, abs=1e-9), pytest.approx(u, abs=1e-9))


def test_repeated_pages_and_clashing_columns(spark):
    long_url = "http://a.com/en/" + "x" * 100_000
    rows = [(1, "http://a.com/en/7"), (1, "http://a.com/en/7"), (2, long_url), (None, "http://b.com/"), (3, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "good": F.lit("x"), "n": F.lit(0)})
    labels = spark.createDataFrame([(7, 1, "y"), (7, 0, "y"), (None, 1, "y")], "doc_id long, quality int, host string")
    out = filter_urls(pages, labels, URL_RULES, good_col="quality", by=url_document(F.col("url")), by_col="doc_id").collect()
    assert sorted(r.page_id or 0 for r in out) == [0, 1, 1, 2, 3] and {len(r.path) for r in out if r.page_id == 2} == {100_004}
