"""Exact round trips of the piece encoder, and page extraction."""

import random

import pytest

pytest.importorskip("sentencepiece")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402

from rowloom.llm import pagetext, pieces  # noqa: E402

from .test_operators import texts  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "identity"])
def test_normaliser_equals_the_library(rule):
    known = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=True, remove_extra_whitespaces=True)
    spec = next(v for k, v in pieces._fields(known.serialized_model_proto()) if k == 3)
    own = pieces.Normaliser.of_spec(spec)
    rng = random.Random(rule)
    for _ in range(500):
        text = "".join(rng.choice(["a", "  ", " ", "ﬁ", "①", "㌔", "ｱ", "が", "Å", "É", "　", "\t", "ｶﾞ", "½", "​", "…", "\xa0", "▁"]) for _ in range(rng.randint(0, 14)))
        data, source = own(text.encode())
        assert data.decode() == known.normalize(text)
        assert len(source) == len(data) + 1 and (source[1:] >= source[:-1]).all() and source[-1] <= len(text.encode())


def test_codec(library):
    codec = pieces.PieceCodec(open(MODEL, "rb").read())
    samples = [t for _, t in texts()] + ["▁a ▁▁b", "  lead", "tail  ", "\x00", "🎉🎉", "ا ب", "a\r\n\tb"]
    for text, (ids, starts, ends) in zip(samples, codec.encode(samples)):
        assert ids.tolist() == library.encode(text or "")
        assert codec.decode([ids.tolist()]) == [library.decode(ids.tolist())]
        data = (text or "").encode()
        assert len(ids) == 0 or ends[-1] == len(data) and (starts <= ends).all() and (starts[1:] <= ends[1:]).all()
        if "▁" not in (text or ""):
            assert b"".join(data[s:e] for s, e in zip(starts, ends)) == data


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_codec_of_a_model_with_a_character_map(rule):
    """The model's pieces under another normaliser: ids as the library's, spans that cover the source in order."""
    spec = next(v for k, v in pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if k == 3)
    size, more = len(spec), bytearray()
    while size > 127:
        more.append(size & 127 | 128)
        size >>= 7
    model = open(MODEL, "rb").read() + bytes([0x1A]) + bytes(more) + bytes([size]) + spec
    known, codec = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.PieceCodec(model)
    assert codec.normalise.units is not None
    samples = ["ﬁne ① ㌔ ｶﾞ  double", "Ｆｕｌｌ　ｗｉｄｔｈ", "plain words only", " lead and tail ", "½ cup … É e\u0301"] + [t for _, t in texts() if t and len(t) < 5000]
    for text, (ids, starts, ends) in zip(samples, codec.encode(samples)):
        data = text.encode()
        assert ids.tolist() == known.encode(text)
        assert len(ids) == 0 or ends[-1] <= len(data) and (starts <= ends).all() and (starts[1:] >= starts[:-1]).all() and (starts[1:] <= ends[1:]).all()
    (ids, starts, ends), text = codec.encode(["x ﬁ y"])[0], "x ﬁ y".encode()
    assert any("ﬁ" in text[s:e].decode("utf-8", "replace") for s, e in zip(starts, ends))


class PlainArticle(__import__("html.parser").parser.HTMLParser):
    """A second extractor for pages that mark their article: its text, cut at block elements, without what is never text."""

    CUTS = set("p h1 h2 h3 ul ol li div section article blockquote pre table tr td".split())
    NEVER = {"script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.hidden, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.hidden += tag in self.NEVER
        if tag in self.CUTS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.hidden -= tag in self.NEVER
        if tag in self.CUTS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.blocks[-1] += data


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_against_a_plain_extractor(spark, sf):
    from rowloom.llm import queries

    want = {}
    for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id", "html").collect():
        plain = PlainArticle()
        plain.feed(r["html"] or "")
        want[r["page_id"]] = "\n".join(b for x in plain.blocks if (b := " ".join(x.split())))
    got = {r["page_id"]: r["text"] for r in queries.op8_tree_scored_text(spark, f"/root/testdata/{sf}").collect()}
    assert got == want


def test_encode_documents(spark, library):
    rows = [(i, t, 7) for i, t in texts()]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in pieces.encode_documents(df, MODEL).collect()), key=str)
    assert got == sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows), key=str)
    assert pieces.encode_documents(df.limit(0), MODEL).isEmpty()


PAGE = """<!DOCTYPE html><html><body><header><h1>Site</h1><p>Header text, long, with commas, more than twenty-five</p></header><div class="cookie-notice">We use cookies, really, lots of them, please accept</div>
<div id="wrap"><div class="sidebar"><p>Popular, posts, and other things that are long enough</p></div><div class="content"><h2>Title</h2><p>First paragraph, which is long, with commas, and   more
text here.<div class="ad">Buy, this, now, and save money today folks</div><p>Second &amp; last &lt;paragraph&gt;<br>line two, with <a href=x>a link</a> inside.</p><ul><li>item one<li>item two</ul></div>
<div class="comments"><p>Reader comment, which is long, with commas, and more text than the rest, by far, truly, honestly.</p></div></div><form><p>Subscribe, to our newsletter, it is great and free</p></form><script>var a = "<p>no, not this, never</p>";</script><footer>&copy; c</footer></body></html>"""


def test_main_text():
    assert pagetext.main_text(PAGE) == "Title\nFirst paragraph, which is long, with commas, and more text here.\nSecond & last <paragraph> line two, with a link inside.\nitem one\nitem two"


PROSE = "This is a sentence of the article, with commas, that goes on for some time, and ends here."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<form action=x><div><p>{PROSE}</p><p>{PROSE}</p><input value=z><button>Send</button></div></form>", f"{PROSE}\n{PROSE}"),
        (f"<div><p>{PROSE}</p><form><p>Your name, please</p></form></div>", PROSE),
        *[(f"<div id=a><p>{PROSE}</p></div><div class='{c}'><p>{PROSE} Not this.</p></div>", PROSE) for c in ("sidebar-content", "comment-content", "cookie-text", "sidebar content", "reader-comments")],
        *[(f"<div class='{c}'><p>{PROSE}</p></div>", PROSE) for c in ("post share-enabled", "content has-sidebar", "with-sidebar", "story")],
        (f"<div><section><div><p>{PROSE}</p><p>{PROSE} One.</p></div></section><nav><a href=x>n</a></nav><section><div><p>{PROSE} Two.</p><p>{PROSE}</p></div></section></div>", f"{PROSE}\n{PROSE} One.\n{PROSE} Two.\n{PROSE}"),
        (f"<article><header><h1>Title</h1></header><p>{PROSE}</p></article>", f"Title\n{PROSE}"),
        (f"<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>{PROSE}</p></main>", f"Title\n{PROSE}"),
        (f"<p>Before <img src=x.png alt=y> after, <x-note>and more</x-note>, {PROSE}<br/>End</p>", f"Before after, and more, {PROSE} End"),
    ],
)
def test_boilerplate_and_containers(page, text):
    assert pagetext.main_text(f"<html><body>{page}</body></html>") == text


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), (" ", ""), ("<p>", ""), ("<", "<"), ("a<b>c", "ac"), ("<div", ""), ("<script>x", ""), ("<p>short</p>", "short"), ("no tags &eacute;", "no tags é"), ("<!-- x", ""), ("a</p></div>b", "ab")])
def test_odd_pages(page, text):
    assert pagetext.main_text(page) == text


def test_deep_and_long_pages_are_linear():
    assert pagetext.main_text("<div>" * 20_000 + "deep text, with words, and a comma or two in it" + "</div>" * 20_000)
    body = "".join(f"<p>Paragraph number {i}, with a comma and some words.</p>" for i in range(20_000))
    assert pagetext.main_text(f"<article>{body}</article>").count("\n") == 19_999


def test_extract(spark):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 2), (None, None, None, 3), (2, "v", "", 4)]
    got = pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert sorted((r["page_id"] or 0, len(r["text"]) > 0) for r in got.collect()) == [(0, False), (1, True), (1, True), (2, False)]
