import random
import time
from html.parser import HTMLParser

from pagewright.llm import html_extract as H
from pagewright.session import table

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></nav>
<div class="cookie-notice">We use the cookies of this site and all of that.</div><article><h1>A&amp;B</h1><p>The first of the words
is in   this line &copy; and it is that.<p>Short.<script>var t = "</p>";</script><aside>The related of the and in this.</aside><p>Last one</article>
<section id="comments"><p>The first comment is of no use to the page and it is here for all.</p></section><footer>&copy; 2024</footer><p hidden>x"""


def test_article_only():
    assert H.extract(PAGE) == "A&B\nThe first of the words is in this line © and it is that.\nShort.\nLast one"


def test_page_without_article():
    text = "The story of the man and the sea is that he was in it for a long time and it was not as he had thought. " * 3
    page = f"<body><div><a href=a>One</a> <a href=b>Two</a></div><div>{text}</div><div>It went on.</div><div>{text}</div><div><a href=c>Next page of the list</a></div></body>"
    assert H.extract(page) == "\n".join([text.strip(), "It went on.", text.strip()])


def test_broken_pages():
    for page in (None, "", "<", "<p", "text", "<p>a<b>c", "<!-- open", "<script>open", "</div></p>", "&#xZZ; &am"):
        assert isinstance(H.extract(page), str)


def test_sample_pages_keep_the_article(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    found = H.query(pages).toPandas()
    assert len(found) == pages.count() and (found.n_chars == found.text.str.len()).all() and (found.n_chars > 0).all()
    assert not found.text.str.contains("©").any()


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>The and of it", "x"), (None, "u", "", "x")], "page_id long, url string, html string, text string")
    assert len(H.query(rows).collect()) == 3 and H.query(rows.limit(0)).count() == 0


FINNISH = "Tämä on ensimmäinen lause suomeksi ja se kertoo pitkästä matkasta maan halki. Toinen lause jatkaa kertomusta talvesta ja kylmästä tuulesta järvellä. Kolmas lause puhuu ystävistä, jotka odottavat kotona. Neljäs lause päättää tarinan."


def test_languages_without_a_list():
    page = f"<body><nav><a href=x>Koti</a></nav><div><p>{FINNISH}</p><p>Loppu.</p></div><div><a href=y>Lue lisää tästä</a></div></body>"
    assert H.extract(page) == f"{FINNISH}\nLoppu."


def test_quotes_that_are_not_closed():
    assert H.extract('<article><p title="abc>One of the texts.</p><p class="x">Two of the texts.</p></article>') == "One of the texts.\nTwo of the texts."
    assert H.extract("<article><p data-x='a > b'>It's the one.</p><p onclick=\"f('<b>')\">And the other.</p></article>") == "It's the one.\nAnd the other."


def test_raw_elements_that_are_not_closed():
    for name in ("select", "button", "textarea", "svg", "iframe", "head", "noscript", "video"):
        page = f"<article><p>The first of the texts.</p><{name}><option>A<option>B<p>The second of the texts.</p><p>The third.</p></article>"
        assert H.extract(page) == "The first of the texts.\nThe second of the texts.\nThe third."
    assert H.extract("<article><p>A<svg/>B</p><select><option>x</select><p>C</p></article>") == "AB\nC"


def test_links_in_an_article_decide_nothing():
    text = "The story is that he was in the house for a long time, and it was not as he had thought it to be at all."
    assert H.extract(f"<article><h1>T</h1><p>{text}</p><p><a href=x>link to somewhere</a></p></article>") == f"T\n{text}"


def test_time_grows_with_the_page_only():
    for piece in ('<p title="abc>', "<a ", '<a "', "<select>", "<div>", "</b>", "<a x='>", "<b><i>"):
        times = []
        for n in (4000, 16_000):
            start = time.perf_counter()
            H.extract("<article>" + piece * n)
            times.append(time.perf_counter() - start)
        assert times[1] < 0.2 or times[1] < 9 * times[0]


class Plain(HTMLParser):
    """A second reader for well-formed pages: text of the blocks in an article, furniture left out."""

    def __init__(self):
        super().__init__()
        self.out, self.depth, self.bad, self.inside = [""], 0, 0, False

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in H.VOID_TAGS:
            self.out[-1] += " " * (tag in H.SPACE_TAGS)
            return
        self.depth += 1
        if self.bad or tag in H.BAD_TAGS or tag in H.RAW_TAGS:
            self.bad += 1
        if tag in H.BLOCK_TAGS:
            self.out.append("")

    def handle_endtag(self, tag):
        self.bad -= bool(self.bad)
        if tag in H.BLOCK_TAGS:
            self.out.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside and not self.bad:
            self.out[-1] += data

    def text(self):
        return "\n".join(" ".join(x.split()) for x in self.out if x.strip())


def test_same_as_a_second_reader():
    rnd = random.Random(3)
    words = "the of and house sea time long story man was had thought &amp; &lt; caf&eacute; 1 < 2 “so”".split()

    def part(depth):
        kind = rnd.choice(["p", "p", "p", "h2", "ul", "div", "nav", "aside", "script", "blockquote"] if depth else ["p"])
        if kind in ("div", "blockquote"):
            return f'<{kind} class="x">' + "".join(part(depth - 1) for _ in range(rnd.randint(1, 3))) + f"</{kind}>"
        body = " ".join(rnd.choices([w for w in words if w != "<"], k=rnd.randint(1, 40)))
        if kind == "ul":
            return f"<ul><li>{body}</li><li>{body}<br>x</li></ul>"
        return f"<{kind}>{body if kind != 'script' else 'var a = 1'}</{kind}>"

    for _ in range(300):
        page = "<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><article>" + "".join(part(2) for _ in range(rnd.randint(1, 6))) + "</article><footer>of the end</footer></body></html>"
        reader = Plain()
        reader.feed(page)
        assert H.extract(page) == reader.text(), page
