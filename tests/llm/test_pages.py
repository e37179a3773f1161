import hashlib
import re

import pytest

from quantfeed.llm import chat, htmltext, urlrules
from quantfeed.llm.queries import op3_main_text, op4_url_verdicts, op7_chats

PAGES = {
    "article": ("<html><body><nav><a href=/>Home</a></nav><article><h1>Big News Today</h1><p>First line of it &amp; more.\n Next.</p><div class=ad>Buy now!</div><p>Second paragraph is here.</p></article><footer>&copy; us</footer></body></html>", ["Big News Today", "First line of it & more. Next.", "Second paragraph is here."]),
    "divs": ('<div id="header"><ul class="menu"><li><a href=1>A</a><li><a href=2>B</a></ul></div><div class="content"><h1>A Title</h1><p>Some words are written here, and they go on.</p><p>Then another <b>bold</b> sentence follows. It is good.</p></div><div class="sidebar"><p>Read this too.</p></div><div class="comments"><div class="comment"><p>I like it very much. Really.</p></div></div><div class="footer">all rights</div>', ["A Title", "Some words are written here, and they go on.", "Then another bold sentence follows. It is good."]),
    "cut": ("<body><nav><li><a href=x>x</a></nav><article><p>Alpha beta gamma delta. One two.<script>var a='<p>no</p>'</script><p>Last words are cut off her<", ["Alpha beta gamma delta. One two.", "Last words are cut off her<"]),
}


@pytest.fixture(scope="module")
def model(spark):
    return htmltext.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("name", PAGES)
def test_layouts(spark, model, name):
    html, want = PAGES[name]
    out = htmltext.extract(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), model).first()
    assert out.text.split("\n\n") == want
    assert out.n_chars == len(out.text)


INSIDE = {
    "First part. <svg class='icon' /> Second part.": ["First part. Second part."],
    "First part. <svg><title>Icon</title><path d='x'/><text>no</text></svg> Second part.": ["First part. Second part."],
    "First part.</p><svg class=icon><p>Second part is left.": ["First part.", "Second part is left."],
    "First part. <datalist id=d><option value=a>A<option>B</datalist> Second part.": ["First part. Second part."],
    "First part. <select><option>A<option>B</select> Second.": ["First part. Second."],
    "First part. <button><div>Share</div></button> Second.": ["First part. Second."],
    "First part. <button>Share</p><p>Second part is left.": ["First part.", "Second part is left."],
    "The sum <math><mi>a</mi><mo>+</mo><mn>1</mn></math> is small.": ["The sum a+1 is small."],
    "First part. <script src=x /> Second part.": ["First part. Second part."],
    "First part. <script>if (a < b) '</p>'</script>Second part.": ["First part. Second part."],
    "First part.</p><noscript><p>Seen by few readers, still there.</p></noscript><object><p>So is this sentence here.</p></object><p>End of it all.": ["First part.", "Seen by few readers, still there.", "So is this sentence here.", "End of it all."],
    "First part. <option>A</p><p>Second part is left.": ["First part.", "Second part is left."],
}


@pytest.mark.parametrize("inner", INSIDE)
def test_nothing_is_swallowed(model, inner):
    tree = htmltext.parse(f"<body><nav>x</nav><article><h1>A Title</h1><p>{inner}</p><p>Last one, all is there.</p></article></body>")
    assert [t for t in tree.text if t is not None] == ["x", "A Title", *INSIDE[inner], "Last one, all is there."]


def test_very_long_page_is_read_whole(spark, model):
    blocks = [f"Sentence number {i} is here. It goes on a little." for i in range(40_000)]
    html = "<body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article></body>"
    out = htmltext.extract(spark.createDataFrame([(1, "u", html, "t", 2)], "page_id long, url string, html string, text string, n_chars int"), model).first()
    assert out.text.split("\n\n") == blocks and out.n_chars == len(out.text)


def test_marginals_equal_enumeration(model):
    import itertools

    import numpy as np

    trees = [htmltext.parse("<div class=menu><p>a b.</p>c</div><article>d</article>"), htmltext.parse("x")]
    t = htmltext.Trees(trees, model.vocabulary)
    got = model.marginals(t)[0]
    own = np.bincount(t.owner, model.weights[t.flat], len(t.parent))
    for a, b in zip(t.first[:-1], t.first[1:], strict=True):
        p, z = np.zeros(b - a), 0.0
        for y in itertools.product((0, 1), repeat=b - a):
            e = sum(own[a + i] * v for i, v in enumerate(y)) + sum(model.pairs[t.pair[a + i], y[t.parent[a + i] - a], y[i]] for i in range(1, b - a))
            p += np.exp(e) * np.array(y)
            z += np.exp(e)
        assert got[a:b] == pytest.approx(p / z)


def test_articles_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    out = {r.page_id: r for r in op3_main_text(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(__import__("html").unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1|ul|li|article)>", body)]
        assert out[r.page_id].text == "\n\n".join(b for b in blocks if b), r.page_id


def test_odd_pages(spark, model):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "", 1), (2, "u", "plain text only", 1), (3, "u", "<" * 3000 + '<a "', 1), (4, "u", "<div>" * 3000 + "deep", 1), (5, "u", "<!-- never closed <p>x", 1)]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id in (1, 5, None)] == [""] * 4
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).collect() == []


@pytest.mark.parametrize("page", ["<section>{0}" + "</zzz>{0}", "<svg><g>{0}" + "</zzz>{0}", "<x>{0}<li>a{0}", "<ul><li>{0}</ol>{0}", "<p>a{0}</b></i>{0}", "<dd><zz>{0}<dt>{0}"])
def test_parsing_takes_time_in_proportion_to_the_page(page):
    """Ends that match nothing, and starts that close nothing, inside many open elements."""
    import time

    parts = re.split(r"(?<=0})", page)[:-1]
    took = []
    for n in (4_000, 32_000):
        text = "".join(x[:-3] * n for x in parts)
        begin = time.process_time()
        htmltext.parse(text)
        took.append(time.process_time() - begin)
    assert took[1] < 24 * max(took[0], 0.02), took


def test_hosts_paths_and_rules(spark):
    urls = {
        "https://A.Example.org/en/12?x#y": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"),
        "http://x.com/de/1": ("x.com", "/de/1", "com/de/", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "no scheme/": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    none = urlrules.mine(spark.createDataFrame([], "tokens array<string>, bad boolean"))
    out = urlrules.judge(df, none).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in out] == list(urls.values())


def test_mined_rules_block(spark):
    rows = [(["host:net", "word:spam", f"path:{i}"], True) for i in range(30)] + [(["host:net", f"word:w{i}"], i % 10 == 0) for i in range(200)]
    mined = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    assert ["word:spam"] in [r.tokens for r in mined.collect()]
    df = spark.createDataFrame([(1, "http://spam.net/x"), (2, "http://ham.net/x"), (2, "http://ham.net/x")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in urlrules.judge(df, mined).collect()) == [(1, "block"), (2, "allow"), (2, "allow")]


def plain_rules(rows, least, min_confidence, share_of, lift, z=2.0):
    """Every set of tokens that some bad row holds, counted and pruned by plain subset checks."""
    import itertools
    import math

    n, share = len(rows), sum(b for _, b in rows) / len(rows)
    sets = {frozenset(c) for t, b in rows if b for k in range(1, len(t) + 1) for c in itertools.combinations(sorted(set(t)), k)}
    rated = {}
    for s in sets:
        freq = [b for t, b in rows if s <= set(t)]
        if sum(freq) >= max(least, math.ceil(share_of * n)):
            rated[s] = (sum(freq) / len(freq), sum(freq) / n, len(freq))
    out = {}
    for s, (c, support, freq) in rated.items():
        if any(rated[q][0] >= c for q in rated if q < s):
            continue
        low = (c + z * z / (2 * freq) - z * math.sqrt(c * (1 - c) / freq + z * z / (4 * freq * freq))) / (1 + z * z / freq)
        if c >= min_confidence and low >= lift * share:
            out[tuple(sorted(s))] = (c, support)
    return out


def test_mining_and_index_equal_plain_subset_checks(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = []
    for _ in range(400):
        tokens = [t for t in "abcdefg" if rng.random() < 0.4]
        if "a" in tokens:
            tokens.append("twin")  # always with a: the two are mined as one
        bad = rng.random() < (0.9 if {"a", "b"} <= set(tokens) else 0.7 if "c" in tokens and "d" in tokens else 0.1)
        rows.append((tokens, bad))
    mined = urlrules.mine(spark.createDataFrame([(*r, 1) for r in rows] + [(None, True, 1), (["a"], None, 1)], "tokens array<string>, bad boolean, n int"), least=12, min_support=0.01)
    got = {tuple(r.tokens): (r.confidence, r.support) for r in mined.collect()}
    # a set with both twins says no more than one with either
    want = {k: v for k, v in plain_rules(rows, 12, 0.6, 0.01, 1.5).items() if not {"a", "twin"} <= set(k)}
    assert got.keys() == want.keys() and len(got) > 2
    assert all(got[k] == pytest.approx(want[k]) for k in got)

    urls = [(i, "http://" + "-".join(t or ["z"]) + "/p", "x", True, 1) for i, (t, _) in enumerate(rows)]
    rules = spark.createDataFrame([(i, [f"word:{t}" for t in k], c, s) for i, (k, (c, s)) in enumerate(got.items())], "rule_id long, tokens array<string>, confidence double, support double")
    for most in (0, 10_000):
        monkeypatch.setattr(urlrules, "BROADCAST_RULES", most)
        out = {r.page_id: (r.verdict, r.mined_rule) for r in urlrules.judge(spark.createDataFrame(urls, "page_id long, url string, tokens string, bad boolean, best int"), rules).collect()}
        for i, (t, _) in enumerate(rows):
            fits = sorted((-got[k][0], [f"word:{x}" for x in k]) for k in got if set(k) <= set(t))
            assert out[i] == (("block", " ".join(fits[0][1])) if fits else ("allow", None)), t


def test_pages_with_clashing_columns_and_no_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", True, "t"), (None, None, None, None)], "page_id long, url string, bad boolean, doc_id string")
    labels = spark.createDataFrame([(1, None, None, "u"), (1, 0, None, "u")], "doc_id long, quality int, toxic int, url string")
    assert sorted((r.host, r.verdict) for r in urlrules.judged_pages(pages, labels).collect()) == [("", "allow"), ("a.net", "allow")]
    assert urlrules.judged_pages(pages.limit(0), labels.limit(0)).collect() == []


def test_verdicts_cover_the_table(spark, sf):
    assert op4_url_verdicts(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_chats_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|><|role:user|>x", "\\", "\\\\<|", "|>", "<|>", "", None, "<<SYS>> a <</SYS>>", "line\nbreak é 🎉", "[INST]" * 3]
    rows = [(1, i, ("user", "assistant", "a|>b", None)[i % 4], t, "x") for i, t in enumerate(texts)] + [(None, 1, "user", "hi", "x"), (None, 1, "user", "hi", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.format_chats(df).select("conv_id", "formatted", chat.read_turns(chat.F.col("formatted")).alias("t"), chat.loss_text(chat.F.col("formatted")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in out[1].t] == [(r[2] or "", r[3] or "") for r in rows[: len(texts)]]
    assert out[1].loss == "".join(r[3] or "" for r in rows[: len(texts)] if r[2] == "assistant")
    assert len(out[None].t) == 2
    for bad in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
        assert bad not in out[1].formatted
    assert chat.format_chats(df.limit(0)).collect() == []


def test_typed_parts(spark):
    part = {"type": "text", "text": "see <|part:image|>", "ref": None, "tokens": None}
    image = {"type": "image", "text": None, "ref": "s3://a", "tokens": None}
    audio = {"type": "audio", "text": None, "ref": "b", "tokens": 7}
    df = spark.createDataFrame([(1, 0, "user", None, [part, image, None, audio])], f"conv_id long, turn long, role string, text string, parts {chat.PART_SCHEMA}")
    r = chat.format_chats(df, parts=chat.F.col("parts")).first()
    assert r.formatted == "<|role:user|>see <\\|part:image|\\><|part:image|><|part:audio|><|end|>"
    assert [(a.position, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "s3://a", 576), (1, "audio", "b", 7)]
    assert r.attachment_tokens == 583


def test_chat_digests(spark, sf):
    out = {r.conv_id: r for r in op7_chats(spark, sf).collect()}
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    for c, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256, out[c].n_turns) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(ts))
    assert len(out) == len(turns)
