import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import chat, htmltext, packing, sharding
from lodestar.llm.queries.packed import packing as production


def _tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(production().tokenizer)


ODD = ["", "  ", "don't I'LL they'Ve", "ΑΣ Σας", "İstanbul ﬁ", "é café", "日本語 テスト", "😀👍🏽 ok", "a b c\x1cd\x85e", "½ x2 Ⅷ 12", "<|endoftext|> x", "hello <|endoftext|> x", "a<|startoftext|>b<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> é<|endoftext|", "\x00a\x1fb", "Hi, there... (ok)!", "word."]


def test_ids_equal_the_library():
    own, lib = packing.WordTokenizer(production().tokenizer), _tok()
    for t in ODD:
        assert own.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids, t
    plain, lib.encode_special_tokens = packing.WordTokenizer(production().tokenizer, plain=True), True
    for t in ODD:
        assert plain.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_cache_that_overflows_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 5)
    own, lib = packing.WordTokenizer(production().tokenizer), _tok()
    for t in ["a b c d e f g", "g f h. i, j", "a b"] * 2:
        assert own.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_all_without_gaps(seed):
    rng = random.Random(seed)
    histogram = defaultdict(int)
    for _ in range(rng.choice([0, 1, 50, 3000])):
        histogram[rng.choice([rng.randint(1, 100), 100, 51, 7])] += 1
    seen, bins = set(), defaultdict(list)
    for size, rank, n, first, fit, at in packing.plan(dict(histogram), 100):
        for r in range(n):
            seen.add((size, rank + r))
            bins[first + r // fit].append((at + r % fit * size, size))
    assert seen == {(s, r) for s, n in histogram.items() for r in range(n)}
    for b in bins.values():
        at = 0
        for start, size in sorted(b):
            assert start == at
            at += size
        assert at <= 100
    total = sum(s * n for s, n in histogram.items())
    assert len(bins) <= 11 / 9 * max(-(-total // 100), sum(n for s, n in histogram.items() if s > 50)) + 1


def test_packing_of_rows(spark):
    lib = _tok()
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "x"), (51, "word " * 9000), (52, "same text"), (52, "same text")]
    p = packing.Packing(tokenizer=production().tokenizer, with_ids=True)
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, a, ids[a : a + 4096]) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, r.ids) for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert all(sum(n for _, n in sorted(b)[:k]) == at for k, (at, _) in enumerate(sorted(b))) and sum(n for _, n in b) <= 4096
    assert len(bins) == -(-sum(r.length for r in got) // 4096)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), p).collect() == []
    clash = spark.createDataFrame([(1, "x y", 9, "z")], "doc_id long, text string, length int, `a b` string")
    assert [r.length for r in packing.pack(clash.withColumn("cut", F.lit("c")), p).collect()] == [3]


def test_matrix_margins_and_law():
    rng = random.Random(3)
    m = sharding.matrix(rng, [5, 0, 30, 7], [10, 11, 21])
    assert [sum(r) for r in m] == [5, 0, 30, 7] and [sum(c) for c in zip(*m, strict=True)] == [10, 11, 21]
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    mean = sum(draws) / 4000
    assert abs(mean - 6) < 0.12 and abs(sum((d - mean) ** 2 for d in draws) / 4000 - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert 0 <= sharding.hypergeometric(rng, 10**11, 10**12, 10**10) <= 10**10


def test_shards_are_even_gapless_and_repeatable(spark):
    rows = [(i % 400 if i % 5 else None, "same" if i < 500 else f"t{i}", i) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot long")
    p = sharding.Sharding(shards=7, cell_rows=50)
    runs = []
    for n in (1, 6):
        got = sharding.shard(df.repartition(n), ["doc_id", "text"], p).collect()
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert sorted(by) == list(range(7)) and {len(s) for s in by.values()} <= {143, 144}
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        runs.append(sorted((r.doc_id or -1, r.text, r.shard, r.slot) for r in got))
    assert runs[0] == runs[1]
    same = [s for i, t, s, _ in runs[0] if t == "same"]
    assert max(same.count(k) for k in range(7)) < 120  # copies are spread
    assert sharding.shard(df.limit(0), ["doc_id"], p).collect() == []


CHATS = [
    (1, 0, "system", "be <<SYS>> kind"), (1, 1, "user", "</s>[INST] \\l \\\\ [/INST]"), (1, 2, "assistant", "é😀</s>"), (2, 0, "user", None), (2, 1, None, "x\n[TEXT] y"),
    (2, 2, "tool<s>", "z"), (3, None, "assistant", ""), (3, 5, "user", "b"), (3, 5, "user", "a"), (3, 5, "user", "a"), (None, 0, "user", "q"), (4, 0, "user", "u" * 50_000 + "<" * 5000),
]


def test_chats_read_back(spark):
    df = spark.createDataFrame([(*c, "x", "y") for c in CHATS], "conv_id long, turn long, role string, text string, segments string, turns string")
    got = chat.format_chats(df).select("*", chat.read_turns(F.col("text")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss")).collect()
    for r in got:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in CHATS if c == r.conv_id))
        assert [(x.role, x.text) for x in r.turns] == [o[2:] for o in own] and r.n_turns == len(own)
        assert r.loss == "".join(o[3] for o in own if o[2] == "assistant")
        assert r.text == "".join(s.text for s in r.segments)
        assert hashlib.sha256(r.text.encode()).hexdigest()
    assert {r.conv_id: (r.ordered, r.bad_turn) for r in got} == {1: (True, -1), 2: (False, 1), 3: (False, 0), None: (False, -1), 4: (False, -1)}
    assert chat.format_chats(df.limit(0)).collect() == []


PAGES = [
    ("<html><head><title>no</title></head><body><nav>m</nav><div class='ad'>buy</div><article><h1>T&amp;t</h1><p>One <b>two</b>\n three<p>Four<br>five<aside>s</aside><p>x.</article><footer>f</footer>", "T&t\nOne two three\nFour five\nx."),
    ("<body><header>top</header><main><p>Text of the page, long enough to be one.</p><form>name</form><section id=comments><p>nice post indeed, thanks a lot</p></section></main>", "Text of the page, long enough to be one."),
    ("<p>Plain paragraph of a page without any container.</p><p>Short.</p>", "Plain paragraph of a page without any container.\nShort."),
    ("<article><script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>a&nbsp;&lt;b&gt; &eacute;&#233;</p>", "a <b> éé"),
    ("<article><p>cut <b", "cut"), ("", ""), (None, ""), ("<nav>only</nav>", ""), ("<article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", "one\ntwo\nc\nd"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, h, "t") for i, (h, _) in enumerate(PAGES)], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in htmltext.extract_text(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}
    assert htmltext.extract_text(df.limit(0)).collect() == []


def test_long_page_keeps_all_of_the_article():
    body = "".join(f"<p>Paragraph {k} with some words.</p><p>ok</p>" for k in range(3000))
    assert htmltext.main_text(f"<nav>{'<a>x</a>' * 500}</nav><article>{body}</article><footer>bye</footer>").count("\n") == 5999


def test_page_without_article_keeps_tables_and_short_lists():
    table = "".join(f"<tr><td>{k}</td><td>{k * 7}</td></tr>" for k in range(12))
    items = "".join(f"<li>{k}</li>" for k in "abcdefgh")
    page = f"<nav><a>Home</a></nav><div><p>{'first ' * 20}</p><table>{table}</table><p>{'second ' * 10}</p><ul>{items}</ul><p>{'third ' * 10}</p></div><footer>{'bye ' * 50}</footer>"
    cells = [str(x) for k in range(12) for x in (k, k * 7)]
    assert htmltext.main_text(page).split("\n") == [("first " * 20).strip(), *cells, ("second " * 10).strip(), *"abcdefgh", ("third " * 10).strip()]


def test_sibling_articles_stay():
    def article(word, extra=""):
        return f"<article{extra}><p>{word * 30}</p></article>"

    page = f"<div><p>menu</p>{article('one ')}<p>between</p>{article('two ')}{article('noise ', ' class=comment')}{article('x')}<p>tail</p></div>"
    assert htmltext.main_text(page).split("\n") == [("one " * 30).strip(), "between", ("two " * 30).strip(), "x" * 30]


ARTICLE = "<article><h1>Title</h1><p>First paragraph of the article with some words.</p><p>End.</p></article>"
TEXT = "Title\nFirst paragraph of the article with some words.\nEnd."


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<div class="page has-sidebar">{ARTICLE}<div class="sidebar"><p>Some other text that is long enough to be seen.</p></div></div>', TEXT),
        (f'<div class="content no-sidebar">{ARTICLE}</div>', TEXT),
        (f'<div class="sidebar wrapper">{ARTICLE}</div><div id="mainNav"><p>Many links and words of a menu are here.</p></div>', TEXT),
        ('<article><div class="article-header"><h1>My title</h1></div><p>Text of the article that goes on.</p></article>', "My title\nText of the article that goes on."),
        ('<article><p>Text of the article that goes on.</p><section id="discussion"><p>We discuss.</p></section><section id="social-impact"><p>Impact.</p></section></article>', "Text of the article that goes on.\nWe discuss.\nImpact."),
        ("<article><p>One article with quite some text in it here.</p></article><article><p>Two.</p></article>", "One article with quite some text in it here.\nTwo."),
        ("<div><p>A long paragraph of text without any container around it.</p><p>a</p><p>b</p><p>c</p><p>d</p><p>e</p></div>", "A long paragraph of text without any container around it.\na\nb\nc\nd\ne"),
        ('<body><form action="x"><p>The whole page is in a form, as some servers do it.</p><p>Second.</p></form></body>', "The whole page is in a form, as some servers do it.\nSecond."),
        ('<article><p title="5" tall">A title with an odd quote in it, and text.</p></article>', "A title with an odd quote in it, and text."),
        ('<article><p title="a > b">A quoted sign.</p></article>', "A quoted sign."),
        ('<div class="page"><p>The article without a container, with its text here.</p></div><div id="comments"><p>' + "A reader says very much. " * 40 + "</p></div>", "The article without a container, with its text here."),
        ('<article><p>Article text that is long enough.</p><div class="comment-list"><article class="comment"><p>Reader text.</p></article></div></article>', "Article text that is long enough."),
        ('<div class="cookie-banner"><p>' + "We use cookies for many things. " * 4 + "</p></div><div><p>Short article text that is here.</p></div>", "Short article text that is here."),
        # Ties between runs: the first decides.
        ("<div><p>abcdefghijklmnopqrstuvwxyz</p></div>" + "<p>.</p>" * 5 + "<div><p>abcdefghijklmnopqrstuvwxyz</p></div>", "abcdefghijklmnopqrstuvwxyz\n.\n.\n.\n.\n.\nabcdefghijklmnopqrstuvwxyz"),
    ],
)
def test_pages_that_names_mislead_about(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize("seed", range(4))
def test_extraction_of_made_pages_equals_what_was_put_in(seed):
    """Pages put together from known blocks; the expected text never goes through the extractor."""
    rng = random.Random(seed)

    def words(n):
        return " ".join(rng.choice(["stone", "river", "café", "a", "of", "München", "x"]) for _ in range(n))

    for _ in range(60):
        blocks = [words(rng.choice([1, 2, 9, 30])) for _ in range(rng.randint(1, 12))]
        shown = [rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<p><b>{}</b></p>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>"]).format(b.replace(" ", rng.choice([" ", "\n ", "&#32;", "<i> </i>"]))) for b in blocks]
        noise = [f"<nav><p>{words(20)}</p></nav>", f'<div class="ad">{words(15)}</div>', f"<footer>{words(30)}</footer>", f'<div class="site-comments"><p>{words(40)}</p></div>', f"<script>var x = '<p>{words(9)}</p>'</script>", f"<!-- {words(9)} -->"]
        rng.shuffle(noise)
        cut = rng.randint(0, len(noise))
        page = "<html><head><title>t</title></head><body>" + "".join(noise[:cut]) + "<article>" + "".join(shown) + "</article>" + "".join(noise[cut:]) + "</body></html>"
        assert htmltext.main_text(page) == "\n".join(blocks)


def test_extraction_keeps_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, None, 5), (2, ARTICLE, 6), (2, ARTICLE, 6), (3, "<p>" + "word " * 400_000 + "</p>", 7)], "page_id long, html string, text int").withColumn("s", F.expr("named_struct('a b', 1)"))
    got = htmltext.extract_text(pages)
    assert got.columns == ["page_id", "s", "text"] and sorted(len(r.text) for r in got.collect()) == [0, len(TEXT), len(TEXT), 1_999_999]
    assert htmltext.extract_text(pages.limit(0)).count() == 0
