"""Tags whose content is skipped, without an end tag of their own."""

import pytest

from ballotlake.llm import html

FIRST, REST = "First paragraph, with some text.", "The rest of it, with more text."


@pytest.mark.parametrize("tag", ["<svg/>", "<svg viewBox='0 0 1 1' />", "<math />", "<math display=\"block\"/>", "<button>", "<select name=x>", "<object data='a'>", "<iframe src=http://a/>", "<canvas>"])
@pytest.mark.parametrize("later", ["", "<button>Send</button><select><option>One</select><svg><path/></svg><iframe></iframe><canvas></canvas>"])
def test_the_article_goes_on(tag, later):
    page = f"<article><p>{FIRST}</p>{tag}<p>{REST}</p>{later}</article>"
    assert html.main_text(page) == f"{FIRST}\n{REST}"


def test_closed_ones_are_skipped_whole():
    page = f"<article><p>{FIRST}</p><svg><svg><text>a</text></svg><text>b</text></svg><script>x <p>y</p></script><button>Send</button><p>{REST}</p></article><script>var z = '<p>lost</p>'"
    assert html.main_text(page) == f"{FIRST}\n{REST}"
