"""Every operator on awkward rows (nulls, empty and very long texts, ties, repeats, clashing columns), on an
empty table and through its hot-group path, against the brute-force versions."""

import os
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidemark.llm import chat_format, decontaminate, html_extract, line_dedup, packing, quality_classifier, quality_rules, simhash, url_filter, warc  # noqa: E402
from tidemark.llm.queries import URL_RULES, tokenizer_path  # noqa: E402

LINE = "This line of more than forty characters is shared by many documents"
CLASHING = ("id", "doc", "row", "fp", "h1", "c", "kept", "drop", "n_words", "spans", "rank", "part", "at", "whole", "gone_id", "lang_", "page")
ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "tiny item"), (3, None), (4, "..."),
         (10, "ONE two three four five six seven eight nine ten"), (None, "a null item id of five"), (2, "tiny item")]


def texts():
    rng = np.random.default_rng(3)
    vocabulary = ["w%d" % i for i in range(3000)]
    some = " ".join(rng.choice(vocabulary, 60))
    out = [None, "", " ", "\n", "\n\n \t", "one", "one two", "Éa ÉA \u212a \u0130x 日本語 <|endoftext|> it's don't 12,345 \u00a0 e\u0301",
           "x" * 5000, " ".join(rng.choice(vocabulary, 30_000)), "\n".join([LINE] * 3 + ["short", " " + LINE.upper() + "\r"]),
           "so ONE, two; three-four five six seven eight nine ten eleven! tiny item", "one two three four five six seven eight nine",
           "tiny\nITEM tiny item", "a null item id of five", "the same " * 40, some, some + " w1", some]
    out += [f"{LINE}\nown words {i} " + " ".join(rng.choice(vocabulary, 25)) for i in range(8)]
    return out


def awkward(spark, rows=None):
    rows = [(i, t, "en", "s%d" % (i % 3)) for i, t in enumerate(texts())] if rows is None else rows
    rows = rows + [rows[10], rows[11], (3, "another text of id 3", None, None), (None, LINE, None, "s1"), (None, "no id " + "z " * 30, "en", None),
                   (None, LINE, "en", None)] if rows else rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(f"<{c}>") for c in CLASHING}).repartition(5), [(r[0], r[1]) for r in rows]


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://COM/", "http://com", "http://a.com", "http://a.com/x", "x://Example.com/en/y?q=/es/",
            "http://www.example.com/en/", "http://q.www.example.com/en/a#b", "http://notexample.com/en/", "http://b.net/es/1", "http://net/es",
            "http://.net/fr/", "http://b.net?/es/", "http://b.net#://c.net/es/", "http://b.net/es/1\n2", "http://ÉX.com/É", "http://b..net//fr/", "a://b://c.com/",
            "http://u.net/" + "a/" * 3000]
    rows = [(i if i % 5 else None, u) for i, u in enumerate(urls)] + [(7, urls[7])] * 3
    rules = [*URL_RULES, ("www.example.com", "/en/", "block"), ("b.net", "/es/1", "allow"), ("NET", "/fr", "block"), ("", "/", "block"), ("x.com", "", "block")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "id")})
    for use in (URL_RULES, rules):
        got = url_filter.judge_urls(df, url_filter.rules_frame(spark, use)).select("id", "url", "host", "path", "rule", "verdict").collect()
        same(got, [(p, u, *brute.url(u, [(h.lower(), *r) for h, *r in use if h])) for p, u in rows])
    assert url_filter.judge_urls(df.limit(0), url_filter.rules_frame(spark, rules)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, url_filter.rules_frame(spark, [])).collect()} == {"allow"}


def test_quality_counts(spark):
    df, rows = awkward(spark)
    got = quality_rules.quality_rules(df).collect()
    same([(r.id, *r.c[:4], r.c.n_repeat_words, r.base_failed) for r in got], [(d, *brute.quality_counts(t)) for d, t in rows])
    assert all(not r.kept for r in got if r.base_failed)
    kept = quality_rules.keep_quality(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.kept for r in got)
    empty, _ = awkward(spark, [])
    assert quality_rules.quality_rules(empty).count() == 0 == quality_rules.keep_quality(empty).count()


def test_quality_thresholds_adapt(spark):
    """A source's own sketch sets its limits; a junk source falls back on its language."""
    clean = [(i, " ".join(f"word{i}x{j}" for j in range(60)), "en", "a" if i % 2 else "b") for i in range(300)]
    tables = [(1000 + i, " ".join(f"cell{i}x{j} |" for j in range(30)), "en", "tables") for i in range(40)]
    odd = [(2000, " ".join(f"odd{j}### ***" for j in range(30)), "en", "a")]
    df = spark.createDataFrame(clean + tables + odd, "doc_id long, text string, lang string, source string")
    kept = {r.id: r.kept for r in quality_rules.quality_rules(df).collect()}
    assert all(kept[i] for i, *_ in clean)
    assert not kept[2000] and not any(kept[i] for i, *_ in tables)


def test_quantile_sketch_is_close_and_mergeable(spark):
    values = np.random.default_rng(1).lognormal(5, 2, 5000).astype(int)
    df = spark.createDataFrame([(int(v), i % 7) for i, v in enumerate(values)], "v long, g int").select(
        "g", F.lit("m").alias("measure"), quality_rules.bucket(F.col("v")).alias("bucket")).groupBy("g", "measure", "bucket").agg(F.count("*").alias("n"))
    q = quality_rules.quantiles(df, [], {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    for name, at in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
        exact = np.sort(values)[int(np.ceil(at * len(values))) - 1]
        assert exact * 31 / 32 - 1 <= q[name] <= exact


def conversations():
    base = [("user", "hi"), ("assistant", "yes"), ("user", "more"), (None, None)]
    rows = [(c, t, *base[t]) for c, n in ((1, 4), (2, 2), (3, 2), (4, 4), (5, 1), (6, 3)) for t in range(n)]
    rows += [(7, 0, "user", "hi"), (7, 1, "assistant", "other"), (8, 10, "user", "hi"), (8, 20, "assistant", "yes"), (9, 0, "user", None), (10, 0, "user", ""),
             (11, 1, "user", "a"), (11, 1, "user", "b"), (12, 1, "user", "a"), (13, None, "user", "b"), (13, 5, None, "a"), (None, 1, "user", "null"),
             (None, 2, "user", "conv")]
    rows += rows[:6] + [(14, i, "user", f"t{i}") for i in range(400)] + [(15, i, "user", f"t{i}") for i in range(399)]
    return rows


@pytest.mark.parametrize("partitions", ["3", "50"])
def test_chats(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "place", "a", "_pid", "chat")})
    got = chat_format.format_chats(df).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {r.conv_id: (r.n_turns, r.n_copies) for r in got} == brute.maximal(rows)
    chats = {r.conv_id: r.chat for r in got}
    assert chats[1] == "<|user|>\nhi\n<|assistant|>\nyes\n<|user|>\nmore\n<||>\n\n"
    assert chats[14] == "".join(f"<|user|>\nt{i}\n" for i in range(400))
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_line_dedup(spark):
    df, rows = awkward(spark)
    got = line_dedup.dedup_lines(df).select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    want = brute.line_dedup(rows)
    same(got, want)
    assert any(w[2] for w in want)
    out = line_dedup.without_shared_lines(df)
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    assert out.where("text is null").count() == sum(t is None for _, t in rows)
    empty, _ = awkward(spark, [])
    assert line_dedup.dedup_lines(empty).count() == 0


def test_decontamination(spark):
    df, rows = awkward(spark)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("item", F.lit(1))
    want = brute.contamination(rows, ITEMS)
    assert sum(w[5] for w in want) >= 4
    for block_bytes in (1 << 20, 60):
        found = decontaminate.find_contamination(df, bench, ["doc_id"], block_bytes=block_bytes)
        n_hit = decontaminate.n_hit()
        same(found.select("doc.doc_id", "n_words", n_hit, F.size("items"), F.sha2(F.array_join("items", ","), 256), n_hit > 0).collect(), want)
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not w[5] for w in want)
    empty, _ = awkward(spark, [])
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == len(rows)


def test_wu_manber_on_random_words():
    rng = np.random.default_rng(5)
    import pyarrow as pa
    for window in (1, 2, 3, 4, 10):
        docs = [(i, " ".join(rng.choice(list("abcde"), rng.integers(0, 120)))) for i in range(60)]
        items = [(i, " ".join(rng.choice(list("abcde"), rng.integers(0, 14)))) for i in range(25)]
        hasher, lengths = decontaminate.Patterns([(str(i), t) for i, t in items], window).compiled()
        n, hits, found = decontaminate.search(pa.array([t for _, t in docs]), hasher, lengths)
        for k, (d, w) in enumerate(zip(docs, brute.contamination(docs, items, window))):
            spans = decontaminate.merged(hits[k])
            assert (n[k], sum(s["last"] - s["first"] + 1 for s in spans), len(found[k])) == w[1:4]


@pytest.mark.parametrize("max_list", [64, 2])
def test_simhash(spark, max_list):
    df, rows = awkward(spark)
    fps = [(d, brute.fingerprint(t)) for d, t in rows]
    comp = brute.components(fps)
    got = simhash.near_duplicates(df, max_list=max_list).select("id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    same(got, [(d, "%016x" % f, comp[d, f]) for d, f in fps])
    empty, _ = awkward(spark, [])
    assert simhash.near_duplicates(empty).count() == 0 == simhash.drop_near_duplicates(empty).count()
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {d for d, _ in rows if d is not None and any(comp[x, f] == d for x, f in fps if x == d)}
    assert {r.doc_id for r in kept.select("doc_id").collect()} - {None} == want


@pytest.mark.parametrize("bits,max_list", [(0, 2), (1, 2), (2, 2), (2, 8), (2, 64)])
def test_links_of_dense_families(spark, bits, max_list):
    """Families of fingerprints a few bits apart, chains among them: every component is found, by pairs and by stars."""
    rng = np.random.default_rng(11)
    fps = set()
    for _ in range(12):
        f = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        for _ in range(40):
            fps.add(f)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                f ^= 1 << int(b)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from tidemark.llm.common import connected_components
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(df, bits, max_list)
    pairs = edges.collect()
    assert all(((p.a ^ p.b) & (1 << 64) - 1).bit_count() <= bits for p in pairs)
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    comp = brute.components([(f, f & (1 << 64) - 1) for f in signed], bits)
    for f in signed:
        assert roots.get(f, f) == comp[f, f & (1 << 64) - 1]


def test_packing(spark):
    from tokenizers import Tokenizer
    df, rows = awkward(spark)
    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, k // 512, k, len(ids[k:k + 512]), zlib.crc32(np.array(ids[k:k + 512], "<u4").tobytes())) for k in range(0, len(ids), 512)]
    packed = packing.pack(df, tokenizer_path(), capacity=512, with_ids=True)
    got = packed.collect()
    same([tuple(r)[:5] for r in got], want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 512
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == sum(w[3] for w in want)
    empty, _ = awkward(spark, [])
    assert packing.pack(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(25))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, rng.integers(2, 101), rng.integers(1, 400))
    values, n = np.unique(sizes, return_counts=True)
    counts = dict(zip(values.tolist(), n.tolist()))
    fill, ranks = defaultdict(list), defaultdict(list)
    for s, first, pieces, copies, seq, offset in packing.plan(counts, 100, groups=8).tolist():
        for r in range(pieces):
            ranks[s].append(first + r)
            fill[seq + r // copies].append((offset + r % copies * s, s))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(c)) for s, c in counts.items()}
    for at in fill.values():
        end = 0
        for offset, s in sorted(at):
            assert offset == end
            end += s
        assert end <= 100
    assert len(fill) <= 1.25 * -(-int(sizes.sum()) // 100) + 1


PAGES = {
    "<article><h1>T&amp;t</h1><p>a<b>b</b>c<p>d<br>e</article><footer>f</footer>": "T&t abc d e",
    "<body><nav><a>n</a></nav><div id=main><p>x y</p><aside>no</aside><form>no</form><p>z</p></div><div class='ad-box'>no no no no no</div>": "x y z",
    "<article><p>one</p><div class='comments'><p>no no</p></div><p>two<script>x('</p>')</script><style>p{}</style><!-- no --></article>": "one two",
    "<body><header>h h</header><p>just &lt;b&gt; &#233; text</p><p>more</p><footer>f f</footer></body>": "just <b> é text more",
    "<article><p>unclosed <i>tags <p>and <b>more": "unclosed tags and more",
    "<script>never ends <p>x</p>": "", "": "", None: "", "plain words only": "plain words only", "<p></p><br>": "", "a < b and c > d": "a < b and c > d",
    "<article><p>x<!-- not closed <p>y</p>": "x",
    "<article><div><p>deep</p><ul><li>i1<li>i2</ul></div><table><tr><td>c1<td>c2</table></article>": "deep i1 i2 c1 c2",
}


def test_html(spark):
    rows = [(i, f"u{i}", h) for i, h in enumerate(PAGES)] + [(None, None, "<article><p>id</p></article>")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "tag", "n_chars")})
    want = [(i, u, PAGES.get(h, "id")) for i, u, h in rows]
    same(html_extract.extract(df).select("page_id", "url", "text").collect(), want)
    unlabelled = df.where("page_id is not null and not html like '%<article%'")
    assert html_extract.learn(unlabelled)[""] == html_extract.WORD_WEIGHT
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_long_pages():
    weights = html_extract.weights_from({})
    page = "<nav>" + "<a>menu</a>" * 2000 + "</nav><article>" + "<p>some words</p>" * 20_000 + "</article>"
    assert len(html_extract.main_text(page, weights).split()) == 40_000
    assert html_extract.main_text("<div>" * 20_000 + "word", weights) == "word"


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', "style=overflow:hidden", 'title="The hidden valley"', 'data-hidden="false"', 'data-id="comments"',
                                        'style = "overflow: hidden" id=wrap', "data-x='a \"b\" hidden'", 'aria-hidden="false"', "href=/a?id=comments&hidden"])
def test_html_names_inside_other_attributes(attributes):
    weights = html_extract.weights_from({})
    assert html_extract.main_text(f"<body><div {attributes}><p>all the text</p></div></body>", weights) == "all the text"
    assert html_extract.main_text(f"<article><p>one</p><p {attributes}>two</p><a {attributes}><p>three</p></a></article>", weights) == "one two three"


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', "class=x hidden", 'title="a"hidden', "HIDDEN", "aria-hidden=true", "style='x' class=\"ad\"", "data-a=b role = 'navigation'"])
def test_html_names_read_after_other_attributes(attributes):
    assert html_extract.main_text(f"<article><p>one</p><div {attributes}><p>no</p></div></article>", html_extract.weights_from({})) == "one"


LONG = " ".join(["word"] * 400)


@pytest.mark.parametrize("page", [
    "<body><section>{lead}</section><aside>{side}</aside><section>{rest}</section></body>",
    "<body><p>{lead}</p><aside>{side}</aside><p>{rest}</p></body>",
    "<body><p>{rest}</p><aside>{side}</aside><p>{lead}</p></body>",
    "<p>{lead}</p><nav><ul><li><a>n</a><li><a>n</a></ul></nav><p>{rest}</p><aside>{side}</aside><p>end</p>",
])
def test_html_text_around_furniture(page):
    lead = " ".join(f"lead{k}" for k in range(20))
    text = html_extract.main_text(page.format(lead=lead, side="side " * 50, rest=LONG), html_extract.weights_from({}))
    assert lead in text and LONG in text and "side" not in text
    assert "<p>end" not in page or text.endswith(" end")


PROSE = "some words of prose, " * 12


@pytest.mark.parametrize("inner", [
    '<section id="discussion"><h2 id="d"><a href="#d">Discussion</a></h2><p>{}</p></section>', '<section id="related-work"><p>Short.</p><p>{}</p></section>',
    '<h2 id="social-contract">Social contract</h2><p>{}</p>', '<h2 id="search-results" class="header">Search</h2><p>{}</p>', '<h2 id="responses">Responses</h2><p>{}</p>',
    '<div class="modal-logic"><p>{}</p></div>', '<div class="alert" role="alert"><p>Short.</p><p>{}</p></div>', '<div id="related-work"><h3><a href="#r">Related</a></h3><p>Short.</p></div><p>{}</p>',
    '<div class="section" id="comments"><p>{}</p></div>', '<fieldset><legend>Note</legend><p>{}</p></fieldset>', '<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><p>{}</p>',
    '<div class="paywall">{} <a href="/x">link</a></div>'])
def test_html_names_that_mark_no_furniture(inner):
    inner = inner.format(PROSE)
    words = re.sub(r"\s+", " ", re.sub(r"<(?!/?m)[^>]*>", " ", re.sub(r"</?m[^>]*>", "", inner))).strip()
    for page in (f"<article><p>Before.</p>{inner}<p>After.</p></article>", f"<body><nav><a>no</a></nav><div><p>Before.</p>{inner}<p>After.</p></div></body>"):
        assert html_extract.main_text(page, html_extract.weights_from({})) == f"Before. {words} After."


@pytest.mark.parametrize("inner", [
    '<div class="share-bar"><ul><li><a>no</a><li><a>no</a></ul></div>', '<section class="related-stories"><ul><li><a>no no no</a><li><a>no no</a></ul></section>',
    '<div id="commentsArea"><a>no</a></div>', '<div class="x ad_slot">no no no no no no</div>', '<div role="complementary"><p>no no no no no</p></div>', '<div class="comments">no no no</div>',
    '<math><mi>x</mi><annotation encoding="t">no</annotation></math>'])
def test_html_names_that_mark_furniture(inner):
    page = f"<article><p>{PROSE}</p>{inner}<p>After.</p></article>"
    assert html_extract.main_text(page, html_extract.weights_from({})).replace(" x ", " ") == f"{PROSE.strip()} After."


def test_html_deep_names():
    page = '<div class="x-menu">' * 3000 + "<a>no</a>" + "</div>" * 3000 + f"<p>{PROSE}</p>"
    assert html_extract.main_text(page, html_extract.weights_from({})) == PROSE.strip()


@pytest.mark.parametrize("page,text", [
    ("<p>Hello <button>Subscribe now</button> world</p>", "Hello world"), ("<p>Hello <label>Name</label><select><option>opt one</select> world</p>", "Hello world"),
    ("<p>Hi <span hidden>secret</span> there <span class='ad'>Buy now</span> you</p>", "Hi there you"),
    ("<p>Hello <a title=it's href=x>link text</a> more words don't stop</p><p>second para</p>", "Hello link text more words don't stop second para"),
    ('<p>a <a href=foo/>b</a> c <img alt="x>y"/> d</p>', "a b c d"), ("<p>x <5 y</p><p>u <b", "x <5 y u <b"),
    *((f"<article><p>one</p>{x}<p>two</p></article>", "one two") for x in (
        "<div class=notice>no no</div>", "<div class=sponsored-content>no no</div>", "<div class=promo>no</div>", "<ol class=commentlist><li>no<li>no</ol>",
        "<section id=comments><p>no</p></section>", "<p style='color:red; display: none'>no</p>", "<div style='visibility:hidden'>no</div>",
        "<div class=x-comments><div class=comment-item>no no no</div><div class=comment-item>no</div></div>")),
    ("<article><p>t <span class='x-promo'><a>no</a><a>no</a></span> u</p></article>", "t u")])
def test_html_furniture_inside_text(page, text):
    assert html_extract.main_text(page, html_extract.weights_from({})) == text


HOSTILE = {"<a ": 0, "<div>x ": 0, '<a x="': 0, '<a x=">" ': 0, "<a x='>": 0, "<!x": 0, "<br": 0, "<": 0, "</": 0, "<ul><li>": 0, '<div class="x-menu">x ': 0, "<p =": 0,
           "<svg>": 0, "<!--": 0, "<a x= ": 0, "<b>|</i>x": 1, "<p>|<b>|<br>x": 1, "<b>|<h1>x</h1>": 1, "<i><div>|<b>|</i>x": 1, "<div class=x-menu>|<a>x</a>": 1}


@pytest.mark.parametrize("shape", HOSTILE)
def test_html_is_linear(shape):
    """A megabyte of each hostile shape, with and without an end, takes seconds at most."""
    import time
    n = 1 << 20
    parts = shape.split("|") if HOSTILE[shape] else [shape]
    page = "".join(p * (n // len(parts) // len(p)) for p in parts)
    for whole in (page, page + ">"):
        began = time.time()
        html_extract.main_text(whole, html_extract.weights_from({}))
        assert time.time() - began < 6


@pytest.mark.parametrize("seed", range(20))
def test_html_best_run_is_the_greatest(seed):
    """The linear scan against every contiguous run."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 25))
    scores, between = rng.integers(0, 6, n).astype(float).tolist(), (-rng.integers(0, 8, n)).astype(float).tolist()
    sums = {(i, j): sum(scores[i:j + 1]) + sum(between[i + 1:j + 1]) for i in range(n) for j in range(i, n)}
    found = html_extract.best_run(scores, between)
    assert (found is None) == (max(sums.values(), default=0) <= 0)
    assert found is None or sums[found] == max(sums.values())


def test_html_container_of_random_pages():
    """The run's container holds the same blocks as the longest common path of open containers, for random nesting."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        page, depth, k = "<body>", 0, 0
        for _ in range(40):
            step = rng.integers(3)
            if step == 0:
                page, depth = page + "<div>", depth + 1
            elif step == 1 and depth:
                page, depth = page + "</div>", depth - 1
            else:
                page, k = page + f"<p>w{k}</p>", k + 1
        blocks = html_extract.read_page(page).blocks
        for i in range(len(blocks)):
            for j in range(i, len(blocks)):
                paths = []
                for b in blocks[i:j + 1]:
                    at, path = b.at, []
                    while at:
                        path, at = [id(at), *path], at.up
                    paths.append(path)
                common = os.path.commonprefix(paths)
                low = min([blocks[i].at.depth, *(x for b in blocks[i + 1:j + 1] for x in (b.low, b.at.depth))])
                assert low == len(common) - 1


def test_warc(spark, tmp_path):
    pages = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", "é" * 3000), (None, "n", "same"), (None, "n", "lone"),
             (2, "http://b", "same"), (6, "v", "x" * 100_000), (1, "http://a2", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("sha1", "refers_to", "bundle")})
    folder = warc.write(df.repartition(3), f"file://{tmp_path}/w", frame_bytes=400, bundle_bytes=300)
    got = warc.read(spark, folder, with_payload=True)
    rows = got.collect()
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], brute.warc([(p, h) for p, _, h in pages]))
    same([(r.page_id, r.payload) for r in rows if r.record_type == "response"],
         [(p, h or "") for (p, _, h), w in zip(pages, brute.warc([(p, h) for p, _, h in pages])) if w[3] == "response"])
    five = next(r for r in rows if r.page_id == 5)
    some = warc.read(spark, folder, spark.createDataFrame([(five.record_id,)], "record_id string"), with_payload=True).collect()
    assert [r.payload for r in some] == ["é" * 3000]
    large = warc.write(df, f"file://{tmp_path}/x", revisit_bytes=5)
    assert warc.read(spark, large).where("record_type = 'revisit'").count() == 0
    assert warc.read(spark, warc.write(df.limit(0))).count() == 0


def test_classifier(spark):
    rng = np.random.default_rng(2)
    words = ["w%d" % i for i in range(500)]
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = " ".join([w + ("###" if bad else "") for w in rng.choice(words, 50)] + (["nasty"] if toxic else []))
        rows.append((i, text, "en", "s%d" % (i % 4)))
        if i < 300:
            labels.append((i, int(not bad), int(toxic)))
    df, _ = awkward(spark, rows)
    lab = spark.createDataFrame(labels + [(None, 1, 0), (9999, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.classify(df, lab).collect()}
    for i in range(300, 400):
        assert got[i].is_toxic == (i % 7 == 0)
        assert got[i].kept == (i % 5 != 0 and i % 7 != 0)
    assert quality_classifier.classify(df, lab).count() == df.count()
    assert quality_classifier.classify(df.limit(0), lab).count() == 0
    assert quality_classifier.classify(df, lab.limit(0)).count() == df.count()


def test_heads_are_fitted_on_their_own_labels(spark):
    """Labels with one judgement missing give the model of the other; clashing labels of one id count as the greatest."""
    rows = [(i, "plain words %d " % (i % 3) + ("awful stuff" if i % 2 else "lovely stuff") + " end%d" % i, "en", "s") for i in range(200)]
    df, _ = awkward(spark, rows)
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(200)], schema)
    model = quality_classifier.fit(df, labels)
    assert model["toxic"] == (0.0, 0.0, {}) and model["quality"][2][b"lovely"] > 0 > model["quality"][2][b"awful"]
    other = labels.unionByName(spark.createDataFrame([(i, None, i % 2) for i in range(200)] + [(None, 1, 1), (5, None, None)], schema))
    both = quality_classifier.fit(df, other)
    assert both["quality"][2].keys() == model["quality"][2].keys() and both["toxic"][2][b"awful"] > 0
    clash = quality_classifier.fit(df, labels.unionByName(spark.createDataFrame([(i, 0, 0) for i in range(200)], schema)))
    assert clash["quality"] == model["quality"]


def brute_sites(rows, priors):
    """(quality_site, toxic_site) of every row, by plain sums."""
    out = [[] for _ in rows]
    for k, prior in enumerate(priors):
        p = [1 / (1 + np.exp(-(r[2 + k] + prior))) for r in rows]
        hosts, paths = defaultdict(list), defaultdict(list)
        for r, x in zip(rows, p):
            hosts[r[0]].append(x)
            paths[r[0], r[1]].append(x)
        mean = sum(p) / len(p)

        def strength(groups):
            n = sum(len(v) for g in groups for v in g)
            ss = n2 = noise = k = 0
            for g in groups:
                size = sum(map(len, g))
                centre = sum(map(sum, g)) / size
                k += len(g) - 1
                for v in g:
                    ss += len(v) * (sum(v) / len(v) - centre) ** 2
                    n2 += len(v) ** 2 / size
                    noise += len(v) * centre * (1 - centre) / n
            if k == 0:
                return 100.0
            between = (ss - k * noise) / max(1e-9, n - n2)
            return min(1e4, max(5.0, noise / between - 1)) if between > 0 else 1e4

        k_host = strength([list(hosts.values())])
        k_path = strength([[v for (h, _), v in paths.items() if h == host] for host in hosts])
        for i, (r, x) in enumerate(zip(rows, p)):
            h, q = hosts[r[0]], paths[r[0], r[1]]
            host = (sum(h) - x + k_host * mean) / (len(h) - 1 + k_host)
            out[i].append((sum(q) - x + k_path * host) / (len(q) - 1 + k_path))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_site_posteriors_by_plain_sums(spark, seed):
    rng = np.random.default_rng(seed)
    bias = {h: rng.normal() for h in ("a", "b", "c", None)}
    rows = [(h, str(rng.integers(1 + seed)), float(bias[h] + rng.normal()), float(rng.normal())) for h in rng.choice(list(bias), 150)]
    priors = {"quality": 0.3, "toxic": -1.0}
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, host string, path string, quality double, toxic double")
    got = {r.id: (r.quality_site, r.toxic_site) for r in quality_classifier.combine(df, {h: (x, 0.0, {}) for h, x in priors.items()}).collect()}
    want = brute_sites(rows, priors.values())
    assert len(got) == len(rows)
    assert all(abs(x - y) < 1e-9 for i in got for x, y in zip(got[i], want[i]))


def test_sparse_sites_shrink(spark):
    """A site with one document leans on the global prior, a large poor site keeps its own."""
    model = {h: (0.0, 0.0, {}) for h in quality_classifier.HEADS}
    rows = [("poor", "p", -2.0, 0.0)] * 200 + [("good", "p", 2.0, 0.0)] * 800 + [("lone", "p", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "host string, path string, quality double, toxic double").withColumn("id", F.monotonically_increasing_id())
    site = {r.host: r.quality_site for r in quality_classifier.combine(df, model).select("host", "quality_site").distinct().collect()}
    assert site["poor"] < 0.3 < 0.6 < site["lone"] < 0.85 < site["good"] + 0.05


def test_stages_keep_columns_and_take_awkward_rows(spark):
    docs, rows = awkward(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").checkpoint()
        assert docs.columns == columns, name
        empty = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert empty.count() == 0 and empty.columns == columns, name
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, "").select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_goes_on_behind_the_last_written_stage(spark, monkeypatch):
    """A run that stops in its third stage leaves the second's result; the next run of that name starts there and ends with one folder."""
    from tidemark.session import ensure_checkpoint_dir
    calls = []

    def stage(k, fail=False):
        def run(spark, docs, sf_dir):
            calls.append(k)
            if fail:
                raise RuntimeError("lost")
            return docs.limit(100 - k)
        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage(0)), ("b", stage(1)), ("c", stage(2, True)), ("d", stage(3))])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, "/root/testdata/sf0.001", "resumed")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage(0)), ("b", stage(1)), ("c", stage(2)), ("d", stage(3))])
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001", "resumed")
    assert calls == [0, 1, 2, 2, 3] and got.count() == 97
    folder = ensure_checkpoint_dir(spark).replace("file:", "").replace("//", "/") + "/pipeline-resumed"
    assert os.listdir(folder) == ["3-d"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001", "resumed").count() == 97 and len(calls) == 5
