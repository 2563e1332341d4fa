import html
import re

from fixtures_llm import rows

from revisit.llm.density import extract, main_text
from revisit.llm.queries import LLM_QUERIES

A = "The first long paragraph of the article says a good deal about its subject, at some length."
B = "A second one follows &amp; adds more detail, with a <a href=x>link</a> and <em>stress</em> in it."
B_TEXT = "A second one follows & adds more detail, with a link and stress in it."
C = "Finally, the third paragraph ends the article with some more words of ordinary prose."
MENU = "<ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About us</a></ul>"


def by_hand(page):
    """The article element of the test pages, taken apart with patterns."""
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|div)>", body)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_query_equals_patterns(spark, tiny):
    made = {r.page_id: r for r in LLM_QUERIES["op9_density"](spark, tiny).collect()}
    pages = rows(tiny, "pages")
    assert len(made) == len(pages)
    for p in pages:
        r = made[p["page_id"]]
        assert (r.url, r.text, r.n_chars) == (p["url"], by_hand(p["html"]), len(r.text))


def test_layout_of_plain_divisions():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body>
      <div id="top-nav">{MENU}</div><div class="cookie-notice">We use cookies, lots of them, and we
      would like you to agree to all of that before you read on, please.</div>
      <div class=wrap><div class="content"><h1>Title</h1><p>{A}<p>{B}
      <div class="ad-slot">Buy this now, it is a very good thing to have.</div>
      <p>{C}</p></div><div class="sidebar"><p>{A}</p>{MENU}</div></div>
      <section id="comments"><p>{C} I wrote this comment.</p><p>{A}</p><p>{A}</p></section>
      <form>Subscribe <input> <button>Send</button></form><script>var x = "<p>no</p>"</script>
      <footer>&copy; somebody</footer></body></html>"""
    assert main_text(page).split("\n\n") == ["Title", A, B_TEXT, C]


def test_semantic_layout_with_unclosed_tags():
    page = f"""<body><header><h1>Site</h1>{MENU}</header><nav>{MENU}<main><article>
      <header><h1>Head</h1><span>by somebody</span></header><p><b>{A}<br><p>x<br>y</b> z
      <table><tr><td>1<td>2<tr><td>3</table><pre>a   b
      c</pre><blockquote>{C}</blockquote><aside>{A}</aside>{MENU}</article></main><foo"""
    assert main_text(page).split("\n\n") == ["Head", A, "x y z", "1 2", "3", "a b c", C]


def test_dense_block_beside_the_subtree():
    page = f"<body><p>{A}</p><div><p>{A}</p><p>{B}</p><p>{C}</p></div><div>{MENU}</div></body>"
    assert main_text(page).split("\n\n") == [A, A, B_TEXT, C]


def test_several_articles_and_text_beside_one():
    two = f"<body><nav>{MENU}</nav><article><p>{A}<p>{B}</article><article><p>{C}<p>{A}</article>"
    assert main_text(two).split("\n\n") == [A, B_TEXT, C, A]
    inside = f"<main><h1>Title</h1><p>{A}</p><article><p>{B}</p><p>{C}</p></article></main>"
    assert main_text(inside).split("\n\n") == ["Title", A, B_TEXT, C]
    beside = f"<body><p>{A}</p><article><p>{B}</p><p>{C}</p><p>{A}</p></article><div>{MENU}</div></body>"
    assert main_text(beside).split("\n\n") == [A, B_TEXT, C, A]


def test_names_and_links_inside_an_article():
    names = "".join(f"<li><a href={i}>Somebody Longer-Name {i}</a>" for i in range(4))
    table = "".join(f"<tr><td><a href={i}>City of Number {i}</a>" for i in range(4))
    page = f"""<article><h2 id="related-work">Related work</h2><p id="notice-2">{A}</p>
      <section id="social-policy"><h3 class="comment">Policy</h3><p>{B}</p></section>
      <section id="related"><p>{C}</p></section><section class="related">{names}</section>
      <div class="ad">Buy this.</div><ol>{names}</ol><table>{table}</table></article>
      <div class="share-box">{A}</div>"""
    listed = [f"Somebody Longer-Name {i}" for i in range(4)]
    cities = [f"City of Number {i}" for i in range(4)]
    assert main_text(page).split("\n\n") == ["Related work", A, "Policy", B_TEXT, C, *listed, *cities]


def test_form_or_named_box_around_the_page():
    text = f"<h1>Title</h1><p>{A}</p><p>{B}</p><p>{C}</p>"
    for box in ('<form id="aspnetForm"><input type=hidden>', '<div class="content widget">', '<div id="modal">'):
        page = f"<body><nav>{MENU}</nav>{box}<div>{text}</div></body>"
        assert main_text(page).split("\n\n") == ["Title", A, B_TEXT, C], box
    comments = f'<body><div><p>{A}</p></div><div class="comments">{text * 9}</div></body>'
    assert main_text(comments) == A
    login = "<body><form>Name <input> Word <input> <button>Go</button></form></body>"
    assert main_text(login) == ""
    beside = f"<body><div>{text}</div><form><p>Your name and address</p><input></form></body>"
    assert main_text(beside).split("\n\n") == ["Title", A, B_TEXT, C]


def test_heading_before_the_text():
    text = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
    for box in ("div", "article"):
        page = f"<body><header><h1>Site</h1></header><h1>A title</h1><div>{MENU}</div><{box}>{text}</{box}></body>"
        assert main_text(page).split("\n\n") == ["A title", A, B_TEXT, C]
    near = f"<body><div><h2>Menu</h2>{MENU}</div><h2>A title</h2><article>{text}</article></body>"
    assert main_text(near).split("\n\n") == ["A title", A, B_TEXT, C]
    far = f"<body><h1><a href=/>Site</a></h1><div><h2>Menu</h2>{MENU}</div><article>{text}</article></body>"
    assert main_text(far).split("\n\n") == [A, B_TEXT, C]


def test_bare_text_around_the_text():
    page = f"<body>Log in<div>{MENU}</div>{A} <b>Really.</b><div><p>{A}</p><p>{B}</p><p>{C}</p></div>{C}</body>"
    assert main_text(page).split("\n\n") == [f"{A} Really.", A, B_TEXT, C, C]


def test_paragraphs_named_as_adverts():
    page = f"""<article><p>{A}</p><p class="advert">Buy this.</p><p>{B} <span class="ad">Buy!</span></p>
      <p class="add-on">{C}</p></article>"""
    assert main_text(page).split("\n\n") == [A, B_TEXT, C]


def test_odd_pages(spark):
    deep = "<div>" * 30_000 + "text" + "</div>" * 30_000
    pages = [
        (None, ""), ("", ""), ("<", "<"), ("plain text only", "plain text only"), ("<p", ""), ("a<b", "a"),
        ("<!-- only --><script>x</script>", ""), ("<p>a &lt;b&gt; &#233;&nbsp;x</p>", "a <b> é x"),
        (deep, "text"), ("<p>" + "word " * 200_000 + "</p>", ("word " * 200_000).strip()),
        ("</p></div></body>x", "x"), ("<article></article>", ""), ("<article>e</article>", "e"),
        ("<article>e</article>", "e"),
    ]
    data = [(None if i == 3 else i, h, "text", 1) for i, (h, _) in enumerate(pages)]
    frame = spark.createDataFrame(data, "page_id bigint, html string, text string, n_chars int")
    made = {r.page_id: r for r in extract(frame).collect()}
    for i, (_, wanted) in enumerate(pages):
        r = made[None if i == 3 else i]
        assert (r.text, r.n_chars) == (wanted, len(wanted))
    assert extract(frame.limit(0)).count() == 0
