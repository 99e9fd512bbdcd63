"""Layouts of pages that the test tables do not have."""

import pytest

from couponflow.llm.html_text import default_tree, main_text

LONG = " ".join(f"word{i}" for i in range(60)) + "."
MENU = "<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>"
FOOTER = "<footer><p>Copyright notice of the site.</p></footer>"


def text(body):
    return main_text(f"<html><body>{MENU}{body}{FOOTER}</body></html>", default_tree())


@pytest.mark.parametrize(
    "start, end",
    [
        ("<div class='content-sidebar-wrap'><article>", "</article></div>"),
        ("<div class='site no-sidebar'><article>", "</article></div>"),
        ("<div class='site no-sidebar'><div>", "</div></div>"),
        ("<div id='page' class='has-header'><div class='text'>", "</div></div>"),
        ("<div class='post category-privacy'>", "</div>"),
        ("<form action=/p><article>", "</article></form>"),
        ("<form action=/p><h1>Title words</h1><div>", "</div></form>"),
        ("<div class='widget'><main>", "</main></div>"),
        ("<div class='header'><div id='content'>", "</div></div>"),
    ],
)
def test_wrappers_keep_the_article(start, end):
    found = text(f"{start}<p>{LONG}</p><p>{LONG} again</p>{end}")
    assert LONG in found and f"{LONG} again" in found
    assert "Copyright" not in found and "Home" not in found


@pytest.mark.parametrize(
    "start, end",
    [
        ("<div class='sidebar'>", "</div>"),
        ("<div class='site-footer'>", "</div>"),
        ("<aside><article>", "</article></aside>"),
        ("<div class='comments'><article class='comment'>", "</article></div>"),
        ("<form action=/s>", "</form>"),
    ],
)
def test_frames_stay_frames(start, end):
    found = text(f"<article><p>{LONG}</p></article>{start}<p>Some words {LONG[:90]} of the frame</p>{end}")
    assert found == LONG


@pytest.mark.parametrize("words", [20, 30, 60, 90])
def test_blocks_beside_link_lists_are_kept(words):
    block = " ".join(f"w{i}" for i in range(words))
    links = "<ul><li><a href=/1>First other page</a></li><li><a href=/2>Second page</a></li></ul>"
    article = f"<p>{LONG}</p><p>{block}</p>"
    assert text(f"<article>{article}</article><aside>{links}</aside>") == f"{LONG} {block}"
    kept = text(f"<div>{article}{links}<p>{block} after</p></div>")
    assert LONG in kept and f"{block} " in kept and f"{block} after" in kept
    kept = text(f"<article><h2>Part two</h2>{links}<p>{block}</p><p><a href=/3>see there</a></p></article>")
    assert kept == f"Part two First other page Second page {block} see there"


def test_link_lists_outside_the_article_are_dropped():
    links = "<ul><li><a href=/1>First other page</a></li><li><a href=/2>Second page</a></li></ul>"
    assert text(f"<article><p>{LONG}</p></article><div>{links}</div>") == LONG


@pytest.mark.parametrize(
    "piece",
    [
        "<svg viewBox='0 0 1 1'/>",
        "<svg><path d='M0'/><text>drawn</text></svg>",
        "<svg viewBox='0 0 1 1'><path d='M0'>",
        "<div><select><option>drawn<option>drawn</div>",
        "<div><object data=x>drawn</div>",
        "<noscript>drawn",
        "<div><template>drawn</div>",
        "<select><option>drawn</option></select>",
        "<template><p>drawn</p></template>",
        "<script>if (a < b) '<p>drawn</p>'</script>",
    ],
)
def test_skipped_elements_end(piece):
    page = f"<html><body><article><p>{LONG}</p>{piece}<p>{LONG} again</p></article></body></html>"
    assert main_text(page, default_tree()) == f"{LONG} {LONG} again"


def test_formulas_are_text():
    assert text(f"<article><p>{LONG} <math><mi>a</mi><mo>+</mo><mn>1</mn></math> holds</p></article>") == f"{LONG} a+1 holds"


@pytest.mark.parametrize("anchor", ["<a name=x>", "<a href=/x>", "<p><a href=/x>link</p>"])
def test_an_open_link_ends_with_its_block(anchor):
    found = main_text(f"<div>{anchor}<p>{LONG}</p><p>{LONG} again</p></div>", default_tree())
    assert LONG in found and f"{LONG} again" in found
