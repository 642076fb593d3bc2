import random

import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from scholia.llm import token_counts as T  # noqa: E402
from scholia.llm.textvec import string_hashes  # noqa: E402
from scholia.llm.token_counts import Counter, point_classes, proved_strings, token_counts  # noqa: E402


def test_counts_equal_the_library(spark, monkeypatch):
    import numpy as np

    path = public.path("byte_bpe_50k.json")
    c = Counter(path, np.unique(string_hashes(proved_strings(path))), point_classes())
    r = random.Random(2)
    parts = ["'s", "'t", "'re", "'ve", "'ll", "'", "''", " ", "  ", "\n", "\n\n", "\t", " \n", "a", "Sun", "re", "llama", "12", "3", ".", "!!", "é", "ß", "中", "文字", "、", "\u3000", " ", "<|endoftext|>", "<|end", "½", "€", "\x85", "d", "́", "😀", "\x1c", " ", "͸"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(5000)] + ["word " * 5000, "<|endoftext|>" * 9]
    want = [len(e.ids) for e in c.tok.encode_batch(texts, add_special_tokens=False)]
    assert c.count(pa.array(texts)).tolist() == want
    rows = list(enumerate(texts[:200])) + [(None, "a b"), (5, None), (5, "")]
    got = token_counts(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_tokens int"), path).collect()
    assert len(got) == len(rows)
    by = dict(zip(range(200), want))
    for x in got[:200]:
        assert x.n_tokens == by[x.doc_id] and x.n_bytes == len(texts[x.doc_id].encode()) and not x.over_limit
    assert sorted((x.n_bytes, x.n_tokens) for x in got[200:]) == [(0, 0), (0, 0), (3, 2)]


def test_long_texts_are_counted_in_parts(monkeypatch):
    import numpy as np

    path = public.path("byte_bpe_50k.json")
    c = Counter(path, np.unique(string_hashes(proved_strings(path))), point_classes())
    r = random.Random(4)
    parts = ["'s", "'re", "'", " ", "  ", "\n", " \n", "a", "Sun", "12", "3", ".", "é", "中", "文字", "、", "\u3000", "<|endoftext|>", "<|end", "😀", "\x85"]
    texts = ["".join(r.choices(parts, k=r.randint(50, 300))) for _ in range(200)] + ["x" * 500, "<|endoftext|>" * 60, "文" * 300, ""]
    want = [len(e.ids) for e in c.tok.encode_batch(texts, add_special_tokens=False)]
    for size in (40, 64, 200):
        monkeypatch.setattr(T, "SLICE_BYTES", size)
        assert c.count(pa.array(texts)).tolist() == want


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        proved_strings(public.path("word_bpe_49k.json"))


def test_pages(spark, sf):
    import html
    import re

    from scholia.llm.html_blocks import add_features, leaf_blocks
    from scholia.llm.html_text import fit, main_text
    from scholia.llm.html_training import MARK, labelled_page

    model = fit()
    right = total = 0
    for seed in range(50_000, 50_150):
        blocks = add_features(leaf_blocks(labelled_page(seed)))
        labels = model.decode([blocks])[0]
        right += sum((MARK in b.text) == bool(y) for b, y in zip(blocks, labels))
        total += len(blocks)
    assert right >= 0.98 * total
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in main_text(pages).collect():
        body = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split()) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, "u", None, "x"), (None, None, "", "y"), (1, "u", "<p", "z"), (2, "v", "<" * 5000, "w")], "page_id long, url string, html string, text string")
    got = main_text(odd).collect()
    assert len(got) == 4 and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert main_text(odd.limit(0)).count() == 0


def test_blocks():
    from scholia.llm.html_blocks import leaf_blocks

    page = '<title>T</title><p>one <b>t</b>wo<br>three<p class="x" title="a>b">four&amp;<!-- c --><script>no</script><ul><li>x<li>y</ul>end'
    assert [b.text for b in leaf_blocks(page)] == ["one two three", "four&", "x", "y", "end"]


def test_broken_pages_take_linear_time():
    import time

    from scholia.llm.html_blocks import leaf_blocks

    began = time.time()
    for part in ("<a ", "</ ", '<a ="', "<!-- ", "<script", "<script>", "<x y=z ", "<"):
        leaf_blocks(part * (1_000_000 // len(part)))
    leaf_blocks("<div>" * 100_000 + "</p>" * 100_000)
    assert time.time() - began < 60
    assert [b.text for b in leaf_blocks('<p>Area <math>x</math> is <object>so</object> big<p a="1" b">q')] == ["Area x is so big", "q"]


SENTENCES = [
    "The river rose slowly over the winter and the farmers moved their herds.", "Nobody in the valley had seen such water since the old bridge fell.", "By March the mill had stopped and the road was closed to carts.",
    "The council met twice and sent for engineers from the coast.", "They measured the banks and wrote a report of forty pages.", "In the end the dam was built two miles further up.",
]
COMMENTS = ["I remember that bridge well, great article!", "This is wrong, the mill stopped in April.", "Thanks for sharing this story."]
_each = lambda form, texts: "".join(form.format(t) for t in texts)
#: Layouts and names that the training pages have, and those held back from them: dd, center and the names beginning with zq.
LAYOUTS = {
    "div, name that says nothing": '<div class="zq8"><h1>River</h1>' + _each('<div class="zqx">{}</div>', SENTENCES) + "</div>",
    "div, content": '<div class="content"><h1>River</h1>' + _each("<div>{}</div>", SENTENCES) + "</div>",
    "comments below a heading": '<div class="content"><h1>River</h1>' + _each("<p>{}</p>", SENTENCES) + '</div><div class="zq9"><h3>Comments</h3>' + _each("<p>{}</p>", COMMENTS) + "</div>",
    "comments beside an article": "<article><h1>River</h1>" + _each("<p>{}</p>", SENTENCES) + '</article><div class="zq9">' + _each("<p>{}</p>", COMMENTS) + "</div>",
    "comments inside": '<div class="zqp"><h1>River</h1>' + _each("<p>{}</p>", SENTENCES) + '<div class="zq9"><h3>3 comments</h3>' + _each("<p>{}</p>", COMMENTS) + "</div></div>",
    "br": '<div class="zq1"><h1>River</h1>' + "<br><br>".join(SENTENCES) + "</div>",
    "section": "<main><h1>River</h1>" + _each("<section>{}</section>", SENTENCES) + "</main>",
    "td": "<table><tr><td><h1>River</h1>" + _each("<p>{}</p>", SENTENCES) + "</td></tr></table>",
    "body, div": "<h1>River</h1>" + _each("<div>{}</div>", SENTENCES),
    "body, p": "<h1>River</h1>" + _each("<p>{}</p>", SENTENCES),
    "boxes and a list aside": '<div class="zw1"><div class="zw2"><h1>River</h1>' + _each("<div><p>{}</p></div>", SENTENCES) + '</div><div class="zw3"><h4>Popular</h4><ul>' + _each('<li><a href="#">{}</a></li>', COMMENTS) + "</ul></div></div>",
    "dd": '<dl class="zk"><dt>River</dt>' + _each("<dd>{}</dd>", SENTENCES) + "</dl>",
    "center": "<center><h1>River</h1>" + _each("<center>{}</center>", SENTENCES) + "</center>",
    "span in boxes": "<article><header><h1>River</h1></header>" + _each('<div class="zq"><div><span>{}</span></div></div>', SENTENCES) + "</article>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    from scholia.llm.html_text import extract, fit

    page = (
        '<!DOCTYPE html><html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
        f"{LAYOUTS[layout]}<footer>&copy; 2024 Valley Press. All rights reserved.</footer></body></html>"
    )
    assert extract([page], fit()) == [" ".join(["River", *SENTENCES])]


def test_attributes_without_a_bound():
    from scholia.llm.html_blocks import leaf_blocks

    many = " ".join(f'd{i}="v>"' for i in range(10_000))
    assert [b.text for b in leaf_blocks(f"<p {many}>one</p><script {many}>var x;</script><p {many}>two")] == ["one", "two"]
    # a quote without an end: the tags behind it still count
    assert [b.text for b in leaf_blocks('<p>one</p><p title="x>two</p><p>three</p>')] == ["one", "two", "three"]
