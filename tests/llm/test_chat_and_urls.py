"""Chat windows and url rules against plain versions."""

import pytest
from pyspark.sql import functions as F
from spectraframe.llm import chat, queries, url_filter

from . import brute

TURNS = "conv_id long, turn long, role string, text string, window string, t string, at string"


@pytest.fixture(scope="module")
def turns():
    rows = [(1, 0, "system", "be brief"), *((1, k, "user" if k % 2 else "assistant", f"turn {k} " * (k % 5 * 12 + 1)) for k in range(1, 40))]
    rows += [(2, 0, "user", None), (2, 1, "assistant", ""), (3, None, None, None), (3, 5, "assistant", "x"), (None, 0, "assistant", "no conversation")]
    rows += [(4, 1, "user", "tie"), (4, 1, "assistant", "tie"), (4, 1, "assistant", "tie"), (5, 0, "assistant", "long " * 20_000), (5, 1, "user", "short"), (5, 2, "assistant", "~1<~1|<|end|>~0</s>[INST] ok [/INST]<")]
    rows += [(6, k, "assistant", f"{k}") for k in range(5000)]
    rows += [(7, 0, "user<|text|>\n~", "<|"), (7, 1, "assistant", "😀 <|turn|>é" * 3)]
    return rows


@pytest.fixture(scope="module")
def table(spark, turns):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in turns], TURNS).repartition(4)


def test_round_trip(spark, table, turns, tmp_path):
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op1_chat_formatting(spark, str(tmp_path)).collect()}
    rows = [dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in turns]
    rows += [{"conv_id": -1, "turn": k, "role": role, "text": queries.SAYING} for k, role in enumerate(("user", "assistant"))]
    assert got == brute.chat(rows)


def test_windows(table):
    out = chat.windows(table, budget=256, history=64)
    rows = out.withColumn("cost", chat.n_tokens(F.col("formatted"))).orderBy("conv", "window").collect()
    first = [r for r in rows if r.conv == 1]
    assert len(first) > 3
    assert first[0].n_past == 0
    assert all(r.formatted.startswith("<|past|>system<|text|>be brief<|end|>") for r in first[1:])
    assert any(r.n_past > 1 for r in first)
    for r in rows:
        assert r.formatted.count("<|turn|>") == r.n_new
        assert r.formatted.count("<|past|>") == r.n_past
        body = r.formatted
        assert all(body[:s.start].endswith("<|turn|>assistant<|text|>") and body[s.end :].startswith("<|end|>") for s in r.loss)
        if r.n_new > 1:
            assert chat_cost(body) <= 256


def test_history_crosses_stretches(spark, monkeypatch):
    """Every later window repeats history, whatever the turn numbers; and the system turn, once it has been said."""
    monkeypatch.setattr(chat, "STRETCH", 3)
    rows = [(c, k * step, "assistant" if k % 2 else "user", f"turn {k} " * (1 + k % 7)) for c, step in ((1, 1), (2, 10**7)) for k in range(1000)]
    rows += [(3, k, "system" if k == 400 else "user", "be brief" if k == 400 else f"turn {k}") for k in range(1000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.windows(table, budget=200, history=60).orderBy("conv", "window").collect()
    for conv in (1, 2, 3):
        own = [r for r in out if r.conv == conv]
        assert sum(r.n_new for r in own) == 1000
        assert own[0].n_past == 0
        assert all(r.n_past > 0 for r in own[1:])
        assert all(chat_cost(r.formatted) <= 200 for r in own)
        said = [k for k, r in enumerate(own) if "<|turn|>system" in r.formatted]
        assert [r.formatted.startswith("<|past|>system<|text|>be brief") for r in own] == [bool(said) and k > said[0] for k in range(len(own))]
        turns = [x for r in own for x in r.formatted.split("<|end|>")]
        for a, b in zip(own[:-1], own[1:], strict=True):  # what is repeated are the turns before, in order
            texts = [x.split("<|text|>")[1] for x in b.formatted.split("<|end|>") if x.startswith("<|past|>") and not x.startswith("<|past|>system")]
            news = [x.split("<|text|>")[1] for r in own[: own.index(b)] for x in r.formatted.split("<|end|>") if x.startswith("<|turn|>")]
            assert a.window < b.window
            assert texts
            assert texts == [x for x in news if x != "be brief"][-len(texts) :]
    assert len(turns) > 1000


def chat_cost(formatted):
    """The budget's count: each turn's text and 4 for its marks."""
    import re

    texts = [x.split("<|text|>", 1)[1] for x in formatted.split("<|end|>")[:-1]]
    return sum(4 + len(re.findall(r"[^\W_]{1,5}|[^\s\w]|_", chat_plain(t))) for t in texts)


def chat_plain(text):
    return text.replace("~1", "").replace("~0", "~")


def test_empty(spark):
    assert chat.windows(spark.createDataFrame([], TURNS)).count() == 0


def test_urls(spark, sf_dir):
    for u, r in ((p.url, p) for p in queries.op9_url_filters(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), "page_id").collect()):
        host, path, rule, verdict = brute.url(u)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG", "HTTP://Example.ORG/es/x?y#z", "x://example.org/en/12", "x://notexample.org/es/", "x://org/a://b", "x://a.com/fr/?q=1&q=2", "x://com/de/1.html", "x://ÄB.net:80/é", "x://a..org//", "x://a.net\n/b", "x://example.org/es/", "x://example.org/es/"]
    urls += ["x://long.com/fr/" + "y/" * 200_000, "x://" + "a." * 5_000 + "example.org/es/" + "z" * 100_000 + "?" + "&".join(f"q{k}=1" for k in range(5_000))]
    clashes = ["used", "own", "given", "mined_verdict", "page", "n", "host", "path", "rule", "verdict", "tokens", "token", "needs"]
    pages = spark.createDataFrame([(k, u, *"houpgn", *["clash"] * 7) for k, u in enumerate(urls)], "page_id long, url string, " + ", ".join(f"{c} string" for c in clashes))
    out = url_filter.judge(pages, queries.URL_RULES)
    assert [c for c in out.columns if c not in ("rule", "verdict", "host", "path")] == [c for c in pages.columns if c not in ("rule", "verdict", "host", "path")]
    rows = out.orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in rows] == [brute.url(u)[:3] for u in urls]
    assert [(r.used, r.own, r.given, r.mined_verdict, r.page, r.n) for r in rows] == [tuple("houpgn")] * len(urls)
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_mined_verdicts_against_brute_force(spark, sf_dir, monkeypatch, most):
    """Of a whole test table; with the sets' verdicts broadcast, and beyond the bound of that."""
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", most)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(-1, None), (-2, "x")], "page_id long, url string"))
    want = brute.judged({r.page_id: r.url for r in pages.collect()})
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, queries.URL_RULES).collect()} == want


def test_ties_between_mined_rules(spark):
    """Of rules with one confidence the one with more support decides, then allow."""
    rows = [("x://a.b/spam", "block")] * 30 + [("x://a.b/news", "allow")] * 30 + [("x://a.b/rare", "block")] * 10
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    pages = spark.createDataFrame([("x://c.d/spam/news",), ("x://c.d/news/rare",), ("x://c.d/rare",)], "url string")
    got = {r.url: r.verdict for r in url_filter.judge(pages, [], labelled=labelled).collect()}
    assert got == {"x://c.d/spam/news": "allow", "x://c.d/news/rare": "allow", "x://c.d/rare": "block"}


def test_many_tokens_that_go_together(spark):
    """Sixty parameters that always occur together are one item, not 2 ** 60 sets; any of them gives the rule."""
    query = "&".join(f"p{k}=1" for k in range(60))
    rows = [(f"x://s{k}.net/{'a' if k % 2 else 'b'}?{query if k % 2 else 'q=1'}", "block" if k % 2 else "allow") for k in range(60)]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    pages = spark.createDataFrame([("x://new.org/?p7=3",), ("x://new.org/?p59=3&p1=2",), ("x://new.org/?q=3",)], "url string")
    assert [r.verdict for r in url_filter.judge(pages, [], otherwise="none", labelled=labelled).orderBy("url").collect()] == ["block", "block", "allow"]


def test_mined_rules(spark):
    """What goes with a label is found, pruned to its shortest form, and decides unlabelled urls."""
    rows = [(f"https://{'spam' if k % 3 == 0 else 'good'}{k % 5}.net/{'pills' if k % 3 == 0 else 'news'}/{k}", "block" if k % 3 == 0 else "allow") for k in range(300)]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    mined = url_filter.mine(labelled.select(url_filter.tokens(F.col("url")).alias("tokens"), "verdict"), 0.01)
    assert any(needs == (("path:pills",),) and (v, c) == ("block", 1.0) for needs, v, c, _ in mined)
    assert not any(("path:pills",) in needs and len(needs) > 1 for needs, *_ in mined)
    pages = spark.createDataFrame([("http://x.org.uk/pills/1",), ("http://x.org.uk/news/a",), ("http://x.org.uk/else",)], "url string")
    got = {r.url: r.verdict for r in url_filter.judge(pages, [], labelled=labelled).collect()}
    assert got == {"http://x.org.uk/pills/1": "block", "http://x.org.uk/news/a": "allow", "http://x.org.uk/else": "allow"}


def test_mined_rules_of_four_tokens(spark):
    """Only all four tokens together predict the label."""
    names = ["w", "x", "y", "z"]
    rows = [([c for c in names if c not in out], "block" if not out else "allow") for out in ([], [], [], [], ["w"], ["x"], ["y"], ["z"]) for _ in range(20)]
    mined = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.01)
    assert [m[:3] for m in mined] == [(tuple((c,) for c in names), "block", 1.0)]
