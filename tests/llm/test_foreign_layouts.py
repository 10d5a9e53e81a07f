"""Pages written by hand in layouts that the training pages do not have: the article stays whole, the rest goes."""

import pytest

from seriesmith.llm import html_extraction

A = "The council met on Tuesday to discuss the plan. Members spoke for two hours about costs. A vote follows in March."
B = "Nobody expected the bridge to open before winter, said the engineer. Steel had arrived late, and the river was high."
C = "It rained."
D = "Prices rose by four percent in the second quarter, the office reported, while wages stood still for a third year."
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'

LAYOUTS = {
    "aside between paragraphs": (f"<html><body><article><p>{A}</p><aside>Read also this.</aside><p>{B}</p></article></body></html>", f"{A} {B}"),
    "negative word on the article": (f'<article class="article sidebar-left"><p>{A}</p><p>{B}</p></article>', f"{A} {B}"),
    "advert between short paragraphs": ('<article><p>Body text one.</p><div class="advert">Buy now!</div><p>Body two.</p><aside>..</aside><p>End.</p></article>', "Body text one. Body two. End."),
    "slot between short paragraphs": ('<article><p>Body text one.</p><div class="ad-slot">Buy now!</div><p>Body two.</p><aside>..</aside><p>End.</p></article>', "Body text one. Body two. End."),
    "form inside the article": (f'<article><p>{A}</p><form><label>Mail</label><textarea>x</textarea><select><option>One</option></select><button>Go</button></form><p>{B}</p></article>', f"{A} {B}"),
    "text without tags": (A, A),
    "paragraphs without anything around": (f"<p>{A}</p><p>{B}</p><p>{C}</p>", f"{A} {B} {C}"),
    "blog theme": (
        f'<body class="single has-sidebar"><div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">The Blog</a></p>{MENU}</header><div id="content" class="site-content">'
        f'<main id="main" class="site-main"><article id="post-12" class="post hentry"><h1 class="entry-title">Bridge</h1><div class="entry-content"><p>{A}</p><p>{B}</p></div></article></main>'
        f'<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent</h2><ul><li><a href="/a">Old post</a></li></ul></section></aside></div><footer class="site-footer">Proudly made.</footer></div></body>',
        f"Bridge {A} {B}",
    ),
    "named divs only": (f'<body><div id="header">My paper</div><div id="menu"><a href="/">Home</a> <a href="/x">X</a></div><div id="content"><h1>Prices</h1><p>{D}</p><p>{A}</p></div><div id="sidebar"><a href="/1">More</a></div><div id="footer">© Paper</div></body>', f"Prices {D} {A}"),
    "main without article": (f"<body>{MENU}<main><h1>Prices</h1><p>{D}</p><p>{B}</p></main><footer>© 2024 Paper</footer></body>", f"Prices {D} {B}"),
    "page in one form": (f'<body><form id="aspnetForm" method="post"><div class="header"><a href="/">Home</a></div><div class="content"><h1>Rain</h1><p>{A}</p><p>{D}</p></div><div class="footer">© Rain Ltd</div></form></body>', f"Rain {A} {D}"),
    "comments as articles": (
        f'<body><article><h1>Rain</h1><p>{A}</p><p>{B}</p></article><section class="comments"><h2>2 comments</h2><article class="comment"><p>I do not agree at all with this, it was dry here.</p></article><article class="comment"><p>Same here, since Monday.</p></article></section></body>',
        f"Rain {A} {B}",
    ),
    "comments inside the article": (f'<article><p>{A}</p><p>{B}</p><div id="comments"><ol class="comment-list"><li class="comment"><p>I do not agree at all with this.</p></li></ol></div></article>', f"{A} {B}"),
    "cookie dialog first": (f'<body><div class="cookie-banner" role="dialog"><p>We use cookies to improve this site. Please accept them all.</p><button>Accept</button></div><article><p>{A}</p><p>{B}</p></article></body>', f"{A} {B}"),
    "related links between paragraphs": (f'<article><p>{A}</p><ul class="related-posts"><li><a href="/1">Bridge closed</a></li><li><a href="/2">Bridge open</a></li></ul><p>{B}</p><p>{D}</p></article>', f"{A} {B} {D}"),
    "two adverts": (f'<article><h1>Bridge</h1><p>{A}</p><div class="ad">Buy two, pay one.</div><p>{B}</p><div class="sponsored"><p>Sponsored by nobody.</p></div><p>{D}</p></article>', f"Bridge {A} {B} {D}"),
    "list and quotation": (f"<article><h1>Bridge</h1><p>{A}</p><ul><li>Steel came late.</li><li>The river was high.</li></ul><blockquote><p>{B}</p></blockquote><p>{C}</p></article>", f"Bridge {A} Steel came late. The river was high. {B} {C}"),
    "table of figures": (f"<article><p>{D}</p><table><tr><th>Quarter</th><th>Price</th></tr><tr><td>First</td><td>104</td></tr></table><p>{A}</p></article>", f"{D} Quarter Price First 104 {A}"),
    "subheadings": (f"<main><article><h1>One</h1><p>{A}</p><h2>Two words</h2><p>{B}</p><h2>Three more words</h2><p>{D}</p></article></main>", f"One {A} Two words {B} Three more words {D}"),
    "deep plain divs": (f"<body>{MENU}<div><div><div><div><h1>Bridge</h1><p>{A}</p><p>{B}</p><p>{D}</p></div></div></div></div><footer>© 2024</footer></body>", f"Bridge {A} {B} {D}"),
    "breadcrumbs inside": (f'<main><nav class="breadcrumb"><a href="/">Home</a> › <a href="/n">News</a></nav><article><h1>Rain</h1><p>{A}</p></article></main>', f"Rain {A}"),
    "newsletter box": (f'<article><p>{A}</p><div class="newsletter-signup"><h3>Newsletter</h3><p>Get our letter every morning.</p><form><input name="m"><button>Subscribe</button></form></div><p>{B}</p></article>', f"{A} {B}"),
    "sidebar before": (f'<body><div class="container"><aside class="sidebar"><h3>Popular</h3><p>Ten things you should know about rain, by our reporter.</p></aside><article class="content"><p>{A}</p><p>{B}</p></article></div></body>', f"{A} {B}"),
    "content inside the sidebar": (f'<body><article><p>{A}</p><p>{B}</p></article><div class="sidebar"><div class="content"><p>Ten things you should know about rain, by our reporter.</p></div></div></body>', f"{A} {B}"),
    "footer with prose": (f"<body><article><p>{A}</p><p>{D}</p></article><footer><div class='inner'><p>This site is run by a society of readers. It has no owner.</p><p>© 2024 Readers</p></div></footer></body>", f"{A} {D}"),
    "roles": (f'<body><div role="banner">The Paper</div><div role="navigation"><a href="/">Home</a></div><div role="main"><div class="article"><h1>Bridge</h1><p>{A}</p><p>{B}</p></div></div><div role="contentinfo">© Paper</div></body>', f"Bridge {A} {B}"),
    "unclosed paragraphs": (f"<body>{MENU}<article><h1>Bridge<p>{A}<p>{B}<p>{C}</article><footer>© 2024</footer>", f"Bridge {A} {B} {C}"),
    "inline marks": (f'<article><p>{A} <a href="/x">More of it</a> and <b>so on</b>.</p><p><em>{B}</em></p></article>', f"{A} More of it and so on. {B}"),
    "advert as a paragraph": (f'<article><p>{A}</p><p class="advert">Buy two, pay one, today only.</p><p>{B}</p><p>{D}</p></article>', f"{A} {B} {D}"),
    "one paragraph": (f"<html><body><article><p>{C}</p></article></body></html>", C),
    "short article among long furniture": (f'<body><div class="notice"><p>{D}</p></div><article><h1>Rain</h1><p>{C}</p></article><aside><p>{B}</p><p>{A}</p></aside></body>', f"Rain {C}"),
    "read more inside": (f'<article><p>{A}</p><div class="read-more"><a href="/1">Why the bridge is late</a></div><p>{B}</p></article>', f"{A} {B}"),
    "no article": (f'<body>{MENU}<div class="login"><form><label>Name</label><input><label>Word</label><input><button>Enter</button></form></div><footer>© 2024 Paper</footer></body>', ""),
    "empty page": ("<html><body></body></html>", ""),
}


@pytest.fixture(scope="module")
def field():
    return html_extraction.trained_field()


@pytest.mark.parametrize("name", LAYOUTS)
def test_foreign_layout(field, name):
    page, text = LAYOUTS[name]
    assert html_extraction.main_text(page, field) == text
