"""Row-by-row operators: URL filter, secrets, page text, toxicity, decontamination."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import pyarrow as pa
import zstandard
from gazeframe.llm.grams import PUNCTUATION, raw, words
from gazeframe.llm import decontaminate, html_text, secrets, toxicity, url_filter

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_urls(spark):
    urls = ["http://A.example.COM/en/7x?q", "https://b.com/en/1", "http://xcom/en/1", "no scheme", None, "http://m.bad.org/p.html#f", "http://bad.org/p/", "http://good.org/p", "a://b://c/d", "http://example.net/de/81", "http://net/de/8", "http://com"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(0, urls[0], "x", "y")], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("bad.org/p",), ("bad.org/p",), (None,), ("zzz.org",)], "canon string")
    got = url_filter.judge(pages, RULES, listed).collect()
    assert len(got) == len(urls) + 1
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert by[1] == ("b.com", "/en/1", "com/en/", "block")
    assert by[2] == ("xcom", "/en/1", None, "allow")
    assert by[3] == by[4] == ("", "", None, "allow")
    assert by[5][3] == by[6][3] == "block" and by[7][3] == "allow"
    assert by[8][:2] == ("b:", "//c/d") and by[9][2] == "example.net/de/8" and by[10][2] == "net/de/" and by[11][:2] == ("com", "")
    assert url_filter.judge(pages.limit(0), RULES, listed).count() == 0
    assert url_filter.judge(pages, RULES, listed.limit(0)).where("listed").count() == 0


def test_bloom_has_no_false_negatives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h/"), "id").alias("canon"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("x://h/"), "id").alias("url"))
    got = url_filter.judge(pages, [], listed, n_blocks=4)  # a filter that is far too full
    assert got.where("verdict = 'block'").count() == 3000 == got.where("page_id < 3000 and listed").count()


BASE = [
    ("assign", re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def brute_secrets(text):
    found = []
    for n, (kind, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), n, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets(spark):
    rng = random.Random(5)
    parts = ["password=", "SECRET : '", "api_key:\"", "apikey = ", "AKIA", "ABCDEF0123456789XY", "abcdef0123456789", "é", " ", "\n", "token", "=short", "x" * 30, "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----", "ſecret=", "0" * 15]
    texts = ["", None, "  ", "z" * 50_000 + " password=abcdefghijklmnop"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(7, texts[7], "s"), (None, "token=abcdefghijklmnop", "s")], "doc_id long, text string, spans string")
    got = secrets.scan(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        base = brute_secrets(texts[r["doc_id"]] if r["doc_id"] is not None else "token=abcdefghijklmnop")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), r
        assert [base.count(f"{k}:") for k in ("assign", "access", "hex")] == [r["n_assign"], r["n_access"], r["n_hex"]]
        assert set(base.split(",")) - {""} <= set(r["spans"].split(","))
    assert any("github" in r["spans"] for r in got) and any("pem" in r["spans"] for r in got)
    assert secrets.scan(docs.limit(0)).count() == 0


def test_trigram_queries():
    q = secrets.trigram_query(BASE[0][1].pattern)
    assert q[0] == "or" and {"pas", "sec", "tok", "api"} <= secrets.trigrams(q)
    assert secrets.trigrams(secrets.trigram_query(r"AKIA[A-Z0-9]+")) == {"aki", "kia"}
    assert secrets.trigram_query(r"[0-9a-f]{16,}") is True and secrets.trigram_query(r"(abc)?x*") is True


@pytest.mark.parametrize("rule", [*secrets.BASE, *secrets.ADDED], ids=lambda r: r.kind)
def test_hostile_texts_of_a_megabyte(rule):
    """Time grows with the text: what nearly matches again and again, and then fails."""
    pieces = ["eyJ", "eyJa", "eyJaaaaaaaaaaaa.", "password" + " " * 50, "password password ", "secret'  ", "token=", "AKIA", "AKIA" + "A" * 9 + " ", "0", "0" * 15 + "g", "-----BEGIN ", "-----BEGIN AAAA ", "ghp_", "ghp_" + "a" * 35 + "-", "xoxb-", "xoxb-a ", "api_api_key", "-", "a.eyJ"]
    found = re.compile(rule.pattern)
    for piece in pieces:
        text = piece * (1_000_000 // len(piece)) + " .eyJ"
        began = time.process_time()
        for m in found.finditer(text):
            m.span()
        assert time.process_time() - began < 2, piece


def test_redact(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefghijklmnop b", 26, "s"), (2, None, None, None), (3, "clean", 5, "s")], "doc_id long, text string, n_chars long, source string")
    got = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert (got[1]["text"], got[1]["n_chars"]) == ("a [secret] b", 12) and got[2]["text"] is None and got[3]["text"] == "clean"
    assert secrets.redact(docs).schema == docs.schema


PAGES = {
    "<p>a<p>b &amp; c": "a\n\nb & c",
    "<ul><li>x<li>y<ol start=3><li>z</ol></ul>": "- x\n- y\n  3. z",
    "<table><tr><th>k<th>long<tr><td>value<td>v</table>": "k     | long\nvalue | v",
    "<div>a<span hidden>no</span><script>var x='</p>'</script> b</div>": "a b",
    '<div style="display: none">no</div>yes<br>line': "yes\nline",
    "<pre>a\n  b</pre>": "a\n  b",
    "</p></div>stray <b>text": "stray text",
    "": "",
    "<div>" * 3000 + "deep": "deep",
}


def test_page_text(spark):
    pages = spark.createDataFrame([(i, h, "t") for i, h in enumerate(PAGES)] + [(99, None, "t"), (0, "<p>a<p>b &amp; c", "t")], "page_id long, html string, text string")
    got = html_text.extract(pages).collect()
    want = dict(enumerate(PAGES.values())) | {99: None}
    assert len(got) == len(PAGES) + 2
    for r in got:
        assert (r["text"] or "").strip("\n") == (want[r["page_id"]] or ""), r
    assert next(r for r in got if r["page_id"] == 99)["text"] is None and html_text.extract(pages.limit(0)).count() == 0


def test_all_visible_text_is_kept():
    rng = random.Random(2)
    tags = ["p", "div", "li", "ul", "td", "tr", "table", "b", "h2", "pre", "blockquote", "dd", "span", "option", "caption"]
    for _ in range(300):
        words, html = [], ""
        for k in range(30):
            if rng.random() < 0.4:
                words.append(f"w{k}")
                html += f" w{k} "
            else:
                html += f"<{'/' if rng.random() < 0.4 else ''}{rng.choice(tags)}>"
        assert sorted(re.findall(r"w\d+", html_text.render(html))) == sorted(words), html


SHOWN = {
    "a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b": "a x=2 b",
    "<svg>no<title>no</title><desc>no</desc><path/><defs/><g><text>left</text> <text>right</text></g>no</svg> after": "left right after",
    "<svg><g>no<p>out</svg> after": "out after",
    "<select><option>one<option>two</select>": "one two",
    '<span aria-hidden="true">seen</span>': "seen",
}


@pytest.mark.parametrize("html", SHOWN)
def test_what_a_browser_shows_is_kept(html):
    assert html_text.render(html) == SHOWN[html]


@pytest.mark.parametrize("depth", [150, 250, 30_000])
def test_depth_changes_nothing(depth):
    deep = "<div>" * depth
    assert html_text.render(deep + "a<script>no</script><style>no</style><span hidden>no<b>no</b></span> b") == "a b"
    assert html_text.render("<div hidden>no" + deep + "<b>no</b><i></i></div>no</div>" + "</div>" * (depth - 1) + "yes") == "yes"
    assert html_text.render(deep + "<table><tr><th>k<th>long<tr><td>value<td>v</table><ul><li>x</ul>") == "k     | long\nvalue | v\n\n- x"
    for tags in ("<ul><li>", "<blockquote>", "<table><tr><td>", "<dl><dd>", "<pre>"):
        assert re.findall(r"w\d+", html_text.render("".join(f"{tags}w{k} " for k in range(depth)))) == [f"w{k}" for k in range(depth)]


def test_toxicity(spark):
    rng = random.Random(1)
    common = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    bad = ["grumblex", "vilethorn", "scornwick"]

    def make(toxic):
        words = [rng.choice(common) for _ in range(rng.randint(20, 200))]
        for _ in range(max(2, len(words) // 15) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    rows = [(i, make(i % 3 == 0), "s", 0.5) for i in range(360)] + [(1000, None, "s", 0.5), (1001, "", "s", 0.5), (None, "x", "s", 0.5), (1, "again", "s", 0.5), (1002, "wort " * 30_000, "s", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(None, 1), (1000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    held = [(s >= 0.5) == (i % 3 == 0) for i, s in got if i is not None and 240 <= i < 360]
    assert sum(held) / len(held) > 0.95
    kept = toxicity.keep_clean(docs, model, 0.7)
    assert kept.schema == docs.schema and kept.where("doc_id between 240 and 359 and doc_id % 3 <> 0").count() >= 76
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def brute_alignment(item, words):
    h, best = [0] * (len(words) + 1), 0
    for x in item:
        g = [0]
        for j, y in enumerate(words):
            g.append(max(0, h[j] + (2 if x == y else -1), h[j + 1] - 1, g[j] - 1))
        best, h = max(best, *g), g
    return best / (2 * len(item))


def test_decontamination(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)] + ["the"] * 60
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(14, 40)))) for i in range(12)] + [(50, None), (51, "two words"), (None, "a b c d e f g h"), (52, "")]
    docs = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if i % 3 == 0:
            copy = items[i % 12][1].split()
            for _ in range(rng.randint(0, len(copy) // 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            words[len(words) // 2 : len(words) // 2] = copy
        docs.append((i, ", ".join(words).upper() if i % 2 else " ".join(words), "s"))
    rows = docs + [(500, None, "s"), (501, "", "s"), (None, items[0][1], "s"), docs[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict((d[0], d[1]) for d in rows)[r["doc_id"]] or ""
        words = re.findall(r"[a-z0-9]+", text.lower())
        want = sorted(i for i, t in items if i is not None and t and len(t.split()) >= 3 and words and brute_alignment(t.split(), words) >= 0.5)
        assert r["item_ids"] == want and r["contaminated"] == bool(want), r
    clean = decontaminate.clean(df, bench)
    assert clean.schema == df.schema and clean.count() == sum(not r["contaminated"] for r in got)
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("held", [1 << 22, 50])
def test_edited_copies_are_found(spark, monkeypatch, held):
    monkeypatch.setattr(decontaminate, "HELD", held)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(8)]
    edits = [lambda t, e=e: [f"new{k}" if k % e == e - 1 else x for k, x in enumerate(t)] for e in (2, 3, 4, 5, 6)]  # every e-th word is another
    edits += [lambda t: [y for k, x in enumerate(t) for y in ((x, f"put{k}") if k % 2 else (x,))], lambda t: [x for k, x in enumerate(t) if k % 4]]
    docs = [["start"] * 9 + edit(t) + ["end"] * 9 for edit in edits for t in items] + [rng.choices(vocabulary, k=200) for _ in range(8)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["score"]) for r in decontaminate.contaminated(df, bench).collect()}
    for i, t in enumerate(docs):
        scores = [brute_alignment(item, t) for item in items]
        want = [k for k, s in enumerate(scores) if s >= 0.5]
        assert got[i] == (want, round(max(scores), 6) if want else None)
    assert all(got[i][0] for i in range(8, 56)) and not any(got[i][0] for i in range(8))


@pytest.mark.parametrize("block", [3])
def test_items_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    bench = spark.createDataFrame([(i, " ".join(f"u{i}x{k}" for k in range(20))) for i in range(8)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "start " + " ".join(f"u{i}x{k}" for k in range(20))) for i in range(10)], "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {i: [i] if i < 8 else [] for i in range(10)}
    assert decontaminate.clean(docs, bench).count() == 2


def test_a_stem_that_all_items_share_costs_no_alignments(spark):
    """A common stem is known from the counts: documents that hold it alone are aligned with no item."""
    rng = random.Random(7)
    stem = [f"stem{k}" for k in range(12)]
    items = [(i, " ".join([*stem, *(f"i{i}x{k}" for k in range(18))])) for i in range(400)]
    docs = [(i, " ".join([*(f"d{rng.randrange(500)}" for _ in range(50)), *stem, "end"])) for i in range(300)] + [(900, items[7][1]), (901, " ".join(stem * 4000))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.contaminated(df, bench).collect()}
    assert got[900] == [7] and got[901] == [] and sum(map(len, got.values())) == 1
    (shared,) = decontaminate._shared(df, bench, decontaminate.N, decontaminate.THRESHOLD)
    value, _, number = words(*raw(pa.array([docs[0][1], docs[-1][1]])), PUNCTUATION)
    assert len(decontaminate._stretches(shared.value, value, number)[0]) == 0


def test_scores_equal_plain_compression():
    """Scores again, from the model's parts, with the library's plain calls."""
    rng = random.Random(4)
    common = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(common) for _ in range(80)) for _ in range(120)]
    bad = [t.replace(" ", " grumblex ", 4) for t in texts[:60]]
    model = toxicity.fit_texts(bad, texts[60:])
    tries = ["", "x", "grumblex", texts[0], bad[1], "\u00e9" * 400, "no blanks" * 50, "Mixed CASE\nlines " * 40, "w " * 20_000]
    for text, got in zip(tries, toxicity._scores(model, tries).tolist(), strict=True):
        data, parts = text.lower().encode().replace(b"\n", b" "), []
        while data:
            end = len(data) if len(data) <= 96 else next((k for k in range(96, min(128, len(data))) if data[k : k + 1] == b" "), 96)
            parts.append(data[:end])
            data = data[end:]
        parts = parts or [b""]
        press = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d + model.base, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=9, write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.ordinary, model.toxic)]
        length = {w: [len(c.compress(w)) for c in press] for w in set(parts)}
        saved = [length[w][0] - length[w][1] for w in parts]
        n = len(saved)
        total = sum(model.odds[max(-3, min(6, x)) + 3] for x in saved)
        x = [max(-10, min(20, total)) / 10, max(-4, min(8, total / n**0.5)), *[3 * min(0.3, sum(v >= k for v in saved) / n) for k in (1, 2, 4)]]
        z = sum(a * b for a, b in zip(x, model.weights, strict=True)) + model.bias
        assert abs(got - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 0.02, text[:40]


def test_two_kinds_of_toxic_texts_in_different_words():
    """Neither of two disjoint toxic vocabularies crowds out the other, one being four times as frequent."""
    rng = random.Random(8)
    common = [["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(400)] for letters in ("abcdeilnorst", "fghjkmpquvwy")]
    bad = [["grumblex", "vilethorn", "scornwick"], ["huvyjkm", "qumpfyg", "wykuhpj"]]

    def make(kind, toxic):
        words = [rng.choice(common[kind]) for _ in range(rng.randint(40, 200))]
        for _ in range(max(3, len(words) // 15) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad[kind]))
        return " ".join(words)

    model = toxicity.fit_texts([make(i % 5 == 0, True) for i in range(250)], [make(i % 2, False) for i in range(800)])
    for kind in (0, 1):
        assert all(w.encode() in model.toxic and w.encode() not in model.base + model.ordinary for w in bad[kind])
        toxic = toxicity._scores(model, [make(kind, True) for _ in range(60)])
        clean = toxicity._scores(model, [make(kind, False) for _ in range(200)])
        assert (clean >= 0.7).mean() <= 0.01 and (toxic[:, None] > clean[None, :]).mean() > 0.9


def tree(rng, depth, number):
    """(html, words that are seen) of a random tree; each word once."""
    html, seen = [], []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "block", "inline", "list", "table", "hidden", "script", "pre", "comment"]) if depth else "text"
        number[0] += 1
        word = f"w{number[0]}"
        if kind == "text":
            html.append(f" {word} ")
            seen.append(word)
        elif kind == "script":
            html.append(rng.choice(["<script>{}</script>", "<style>{}</style>", "<template>{}</template>", "<title>{}</title>"]).format(word))
        elif kind == "comment":
            html.append(f"<!-- {word} -->")
        elif kind == "hidden":
            html.append(rng.choice(['<div hidden>{}</div>', '<span style="display: none">{}</span>', '<p style="visibility:hidden">{}</p>']).format(tree(rng, 0, number)[0]))
        elif kind == "list":
            parts = [tree(rng, depth - 1, number) for _ in range(rng.randint(1, 3))]
            html.append("<ul>" + "".join(f"<li>{h}" + rng.choice(["", "</li>"]) for h, _ in parts) + "</ul>")
            seen += [x for _, s in parts for x in s]
        elif kind == "table":
            rows = [[tree(rng, 0, number) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
            html.append("<table>" + "".join("<tr>" + "".join(f"<td{rng.choice(['', ' rowspan=2', ' colspan=3'])}>{h}" for h, _ in row) for row in rows) + "</table>")
            seen += [x for row in rows for _, s in row for x in s]
        else:
            h, s = tree(rng, depth - 1, number)
            tag = {"block": rng.choice(["div", "section", "blockquote", "article"]), "inline": rng.choice(["b", "i", "span", "code"]), "pre": "pre"}[kind]
            html.append(f"<{tag}>{h}</{tag}>")
            seen += s
    return "".join(html), seen


def test_every_visible_word_and_no_other():
    rng = random.Random(11)
    for _ in range(600):
        html, seen = tree(rng, rng.randint(1, 4), [0])
        assert re.findall(r"w\d+", html_text.render(html)) == seen, html


def test_tables_with_spans_and_bounded_padding():
    page = "<table><tr><th>Name<th>Qty<th>Price<tr><td rowspan=2>apple<td>1<td>2.50<tr><td>10<td>20<tr><td colspan=2>total<td>22.5</table>"
    assert html_text.render(page).split("\n") == ["Name  | Qty | Price", "apple | 1   | 2.50", "      | 10  | 20", "total |     | 22.5"]
    for page in (
        "<table><tr><td>" + "x" * 20_000 + "<tr><td>a<td>b" * 1000 + "</table>",
        "<table>" + "<tr><td rowspan=65534>a" * 4000 + "</table>",
        "<table><tr>" + "<td>q" * 3000 + "<tr><td colspan=1000>a<td>b" * 3000 + "</table>",
        "<div>" * 30_000 + "<p>" + "word " * 200_000,
    ):
        text = html_text.render(page)
        assert len(text) < 10 * len(page) and sorted(re.findall(r"\w+", text)) == sorted(re.findall(r"\w+", re.sub("<[^>]*>", " ", page)))
    assert html_text.render('<math><mi>x</mi></math> <img src=a alt="a cat"> y').split() == ["x", "y"]


def test_nesting_does_not_multiply_a_page():
    rows = "<tr><td>a<td>b" * 5000
    quotes = "<blockquote>" * 150 + "<p>x" * 5000
    lists = "<ul><li>" * 150 + "<p>x" * 3000
    for page in ("<table><tr><td>" * 190 + f"<table>{rows}</table>" + "<td>z</table>" * 190, "<table><tr><td>q<td>" * 190 + f"<table>{rows}</table>", quotes, lists, "<table><tr><td>" * 60 + quotes):
        began = time.process_time()
        text = html_text.render(page)
        assert len(text) < 10 * len(page) + 10_000 and time.process_time() - began < 20
        assert sorted(re.findall(r"\w+", text)) == sorted(re.findall(r"\w+", re.sub("<[^>]*>", " ", page)))


VISIBLE = [
    ('<div style="visibility:hidden">a<b style="visibility: visible">b</b>c</div>d', "bd"),
    ('<p style="visibility:collapse;color:red">a<i>b</i><span style="visibility:hidden;visibility:visible">c</span></p>', "c"),
    ('<div style="content-visibility:hidden">a<b style="visibility:visible">b</b></div>c', "c"),
    ("<dialog>a</dialog><dialog open>b</dialog>c", "bc"),
    ("<details>a<summary>b</summary><p>c</p><summary>d</summary></details>e", "be"),
    ("<details open>a<summary>b</summary><p>c</p></details>e", "abce"),
    ("<details><details open><summary>x</summary>y</details><summary>b</summary></details>", "b"),
    ("<div popover>a</div>b", "b"),
    ("<textarea>a <b>c</b> &lt;d&gt; &amp;amp;</textarea><i>e</i>", "a<b>c</b><d>&amp;e"),
    ("<table><tr><td style='visibility:hidden'>a<td>b</table>", "|b"),
]


@pytest.mark.parametrize(("html", "shown"), VISIBLE)
def test_what_is_shown(html, shown):
    assert re.sub(r"\s+", "", html_text.render(html)) == shown


@pytest.mark.parametrize(
    ("html", "lines"),
    [
        ("<ol start=3><li>a<li value=9>b<li>c</ol>", ["3. a", "9. b", "10. c"]),
        ("<ol reversed><li>a<li>b<li>c</ol>", ["3. a", "2. b", "1. c"]),
        ("<ol reversed start=-1><li>a<li value=5>b<li>c</ol>", ["-1. a", "5. b", "4. c"]),
        ("<ul><li value=4>a<li value=x>b</ul>", ["- a", "- b"]),
    ],
)
def test_numbers_of_lists(html, lines):
    assert html_text.render(html).split("\n") == lines


def laid_out(rng, depth):
    """(html, lines) of a random page whose layout is put together piece by piece."""
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    kind = rng.choice(["p", "div", "list", "quote", "table", "pre"]) if depth else "p"
    if kind == "p":
        w = [word() for _ in range(rng.randint(1, 3))]
        return "<p>" + rng.choice([" ", "\n  ", "<b> </b>"]).join(w) + "</p>", [" ".join(w)]
    if kind == "pre":
        w = [word() + "  " + word() for _ in range(2)]
        return "<pre>\n" + "\n".join(w) + "</pre>", w
    if kind == "table":
        grid = [[word() for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
        wide = [max(len(r[c]) for r in grid if c < len(r)) for c in range(max(map(len, grid)))]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in r) for r in grid) + "</table>", [" | ".join(x.ljust(wide[c]) for c, x in enumerate(r)).rstrip() for r in grid]
    parts = [laid_out(rng, depth - 1) for _ in range(rng.randint(1, 3))]
    if kind == "list":
        lines = []
        for _, inner in parts:
            lines += [("- " if k == 0 else "  ") + x if x else "" for k, x in enumerate(inner)]
        return "<ul>" + "".join(f"<li>{h}</li>" for h, _ in parts) + "</ul>", lines
    lines = []
    for _, inner in parts:
        lines += ([""] if lines else []) + inner
    if kind == "quote":
        return "<blockquote>" + "".join(h for h, _ in parts) + "</blockquote>", [("> " + x).rstrip() if x else "" for x in lines]
    return "<div>" + "".join(h for h, _ in parts) + "</div>", lines


def test_layout_of_random_pages():
    rng = random.Random(21)
    for _ in range(500):
        html, lines = laid_out(rng, rng.randint(0, 3))
        assert html_text.render(html).split("\n") == lines, html
