"""HTML extraction: hard markup, time, and generated pages whose content is known."""

import html
import random
import time

import pytest

from pixelframe.llm import html_extract

KIND = "page_id long, url string, html string"


def text_of(page):
    return html_extract.main_text(html_extract.parse(page), set())


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p title=it's>Hello there</p><p>Don't lose this</p><p>End</p></article>", "Hello there\n\nDon't lose this\n\nEnd"),
        ('<p class=x">Hello</p><a href="u">World</a>', "Hello\n\nWorld"),
        ("<p a='>' b=\">\" c=>One</p><P\nID = '1' >Two</P >", "One\n\nTwo"),
        ('<p a="never closed>Text</p><p>More</p>', "Text\n\nMore"),
        ("1 < 2 and a <b and <c", "1 < 2 and a <b and <c"),
        ("<!-->a<!--->b<!-- > -->c<!DOCTYPE x><?y z?>d<!-- end", "abcd"),
        ("<title><b>no</title><script>'</p>'</SCRIPT x>yes<style>p > a", "yes"),
        ("<a href=http://x.y/>link</a><br/>z", "link z"),
        ("<p data-id='comment'>kept</p><p id='comment'>gone</p>", "kept"),
    ],
)
def test_hard_markup(page, text):
    assert text_of(page) == text


def test_time_is_linear():
    for piece in ('<a "', '<a x="', "<a x='", '<a x=">"', "<script ", "</script ", "<", "</a", "<!-", "<p a='\"", "<b></i>", "<p>", "<li>x", "&amp;"):
        began = time.time()
        text_of(piece * (1_000_000 // len(piece)))
        assert time.time() - began < 20, piece


def test_no_pages(spark):
    assert html_extract.extract_pages(spark.createDataFrame([], KIND)).count() == 0


def test_generated_pages(spark):
    """Hosts with templates of their own, with and without article elements; the words of the content are known."""
    r, want, pages = random.Random(17), {}, []
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(3, 8))) + r.choice(["", "", "", ",", ".", "'s", ' "', " <", " &"])
    attribute = lambda: r.choice(["", " title=it's", ' data-x="a > b"', " lang=en\"", " hidden", "\n class = 'text'", ' style="p{}"'])
    words = lambda n: " ".join(word() for _ in range(n))

    def inline(text):
        parts = html.escape(text, quote=False).split(" ")
        for _ in range(r.randrange(3)):
            k = r.randrange(len(parts))
            tag = r.choice(["b", "I", "span", "a"])
            parts[k] = f"<{tag}{attribute()}>{parts[k]}</{tag}>"
        return r.choice([" ", "\n ", "&#32;", " <!-- > -->"]).join(parts)

    for host in range(8):
        menu, foot, box = [words(2) for _ in range(4)], words(6), words(5)
        article = host % 2
        for k in range(8):
            blocks = [words(r.randint(3, 30)) for _ in range(r.randint(1, 6))]
            body = "".join(f"<{t}{attribute()}>{inline(b)}{'' if t == 'p' and r.random() < 0.5 else f'</{t}>'}" for b, t in ((b, r.choice(["p", "p", "h2", "blockquote"])) for b in blocks))
            body = f"<article{attribute()}>{body}</article>" if article else f"<div><section>{body}</section></div>"
            links = "".join(f"<li><a href='/{n}'>{html.escape(m, quote=False)}</a>" for n, m in enumerate(menu))
            escaped = html.escape(box, quote=False)
            page = f"<!DOCTYPE html><html><head><title>{html.escape(blocks[0])}</title><script>if (a<b) x='<p>'</script></head><body><nav><ul>{links}</ul></nav><div>{escaped}</div>{body}<form>{words(1)}</form><div class='ad'>{words(4).replace('<', '')}</div><footer>{html.escape(foot)}</footer></body></html>"
            pages.append((len(pages), f"https://h{host}.org/{k}", page))
            want[len(pages) - 1] = "\n\n".join(" ".join(b.split()) for b in blocks)
    got = {x.page_id: x.text for x in html_extract.extract_pages(spark.createDataFrame(pages, KIND)).collect()}
    for k in want:
        assert got[k].split("\n\n") == want[k].split("\n\n")
